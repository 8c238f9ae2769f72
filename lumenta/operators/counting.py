"""Counts of what a document holds, made where its text lies: nothing is exploded and shuffled to be counted."""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenta.sources.durable import shuffle_width

#: Rows of a batch that are turned into Python values together.
SLICE = 256


def gathered(docs: DataFrame, key: str) -> DataFrame:
    """docs with the rows of a key next to each other in one partition. Where no key repeats, rows stay where they lie; only keys are shuffled to see that."""
    again = docs.groupBy(key).agg(F.count("*").alias("__rows")).where("__rows > 1")
    return docs if again.isEmpty() else docs.repartition(shuffle_width(docs), key).sortWithinPartitions(key)


def slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The batches in slices of few rows; what Arrow has freed goes back to the machine, as workers live on."""
    for batch in batches:
        for start in range(0, batch.num_rows, SLICE):
            yield batch.slice(start, SLICE)
    pa.default_memory_pool().release_unused()


def kept_kind(batches: Iterator[pa.RecordBatch], kinds: list[pa.DataType]) -> Iterator[pa.RecordBatch]:
    """The batches; kinds gets the type of their first column, which rows that are sent back need."""
    for batch in batches:
        kinds[:] = [batch.schema.types[0]]
        yield batch


def counted(batches: Iterator[pa.RecordBatch], kind: pa.DataType, parts: Callable[[str | bytes], Iterable]) -> Iterator[tuple[object, Counter]]:
    """(key, counts) of the parts of each key's texts, from gathered rows (key, text); texts come as kind. Keys without parts are left out."""
    key, held = None, Counter()
    for batch in slices(batches):
        for own, text in zip(batch.column(0).to_pylist(), batch.column(1).cast(kind).to_pylist(), strict=True):
            if own != key:
                if held:
                    yield key, held
                key, held = own, Counter()
            if text:
                held.update(parts(text))
    if held:
        yield key, held
