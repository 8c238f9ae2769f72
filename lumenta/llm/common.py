"""Helpers shared by the operators: table reading, streaming over sorted partitions, durable cuts of lineage."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DataType, StructField, StructType

from lumenta.sources.durable import BROADCAST_BYTES, durable, shared_folder, shuffle_width, small

__all__ = ["BROADCAST_BYTES", "bounds", "col", "durable", "fresh", "read", "scratch", "shared_folder", "shuffle_width", "slices", "small", "sorted_groups", "table", "widened"]


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def col(name: str) -> Column:
    """The column of that very name, whatever characters it has."""
    return F.col(f"`{name.replace('`', '``')}`")


def fresh(name: str, *frames: DataFrame) -> str:
    """name, made longer until no frame has a column of that name."""
    taken = {c.lower() for df in frames for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def sorted_groups(batches: Iterator[pa.RecordBatch], key: str, cut: int = 1 << 18) -> Iterator[pa.Table]:
    """Tables of whole groups from a partition sorted by key; a table has about cut rows, more only if one group has.

    Groups never span two tables, so callers can work on many small groups with one vectorised pass.
    """
    held: list[pa.RecordBatch] = []
    rows = 0
    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        rows += batch.num_rows
        if rows < cut:
            continue
        table = pa.Table.from_batches(held)
        keys = table[key]
        last, edge = keys[-1], rows - 1
        while edge > 0 and keys[edge - 1] == last:
            edge -= 1
        if edge:
            yield table.slice(0, edge)
        held = table.slice(edge).combine_chunks().to_batches()
        rows -= edge
        cut = max(cut, 2 * rows)
    if rows:
        yield pa.Table.from_batches(held)


def slices(batches: Iterator[pa.RecordBatch], rows: int = 512) -> Iterator[pa.RecordBatch]:
    """The batches in slices of at most rows, so that what a worker holds besides the batch itself stays small."""
    for batch in batches:
        for start in range(0, batch.num_rows, rows):
            yield batch.slice(start, rows)
    pa.default_memory_pool().release_unused()  # workers live on


def bounds(keys: np.ndarray) -> np.ndarray:
    """Starts of the runs of equal values, and the length at the end."""
    if not len(keys):
        return np.zeros(1, np.int64)
    return np.concatenate(([0], np.flatnonzero(keys[1:] != keys[:-1]) + 1, [len(keys)]))


def _array(values: list, kind: str) -> pa.Array:
    if kind == "string" and isinstance(next((x for x in values if x is not None), None), bytes):
        return pa.array(values, pa.binary()).view(pa.string())
    return pa.array(values, ARROW[kind])


def widened(df: DataFrame, fn: Callable[..., list[list]], sources: list[str], added: list[tuple[str, str]], drop: tuple[str, ...] = ()) -> DataFrame:
    """The columns of df, without those in drop, and added ones that fn computes from lists of the sources' values; strings come as bytes.

    fn returns one list for each added column; strings may be bytes. A name in added takes the place of a column of that name; others follow.
    Each column is sent to Python once.
    """
    given = df.columns
    names = [c for c in given if c not in drop]
    names += [n for n, _ in added if n not in names]
    kinds = {f.name: f.dataType for f in df.schema} | {n: DataType.fromDDL(t) for n, t in added}
    places = [given.index(x) for x in sources]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            values = [c.cast(pa.binary()) if pa.types.is_string(c.type) else c for c in (batch.column(i) for i in places)]
            made = fn(*(c.to_pylist() for c in values))
            columns = dict(zip(given, batch.columns, strict=True)) | {n: _array(x, t) for x, (n, t) in zip(made, added, strict=True)}
            yield pa.RecordBatch.from_arrays([columns[n] for n in names], names=[f"c{i}" for i in range(len(names))])

    # plain names on the way, whatever characters the columns' own have
    plain = df.toDF(*[f"c{i}" for i in range(len(given))])
    return plain.mapInArrow(run, StructType([StructField(f"c{i}", kinds[n]) for i, n in enumerate(names)])).toDF(*names)


ARROW = {
    "long": pa.int64(), "int": pa.int32(), "double": pa.float64(), "boolean": pa.bool_(), "string": pa.string(), "binary": pa.binary(),
    "array<string>": pa.list_(pa.string()), "array<long>": pa.list_(pa.int64()), "array<int>": pa.list_(pa.int32()), "array<binary>": pa.list_(pa.binary()), "array<double>": pa.list_(pa.float64()),
}


_MADE: list[str] = []


def table(df: DataFrame, lasting: bool = False) -> DataFrame:
    """Like durable(), but as a compressed table, for many rows: a folder of its own beside the checkpoints. A lasting one outlives the scratch() around it."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/table-{uuid.uuid4().hex}"
    if not lasting:
        _MADE.append(path)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Removes on leaving what table() wrote inside; for work whose results are written by then."""
    before = len(_MADE)
    try:
        yield
    finally:
        sc = spark.sparkContext
        for path in _MADE[before:]:
            at = sc._jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(sc._jsc.hadoopConfiguration()).delete(at, True)
        del _MADE[before:]
