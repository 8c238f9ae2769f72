"""Tf-idf vectors of character n-grams, in blocks of documents.

A block keeps its documents as counts of words, and each distinct word once. Its n-grams come from the distinct words, so
a gram is shuffled once for each block and not once for each document: to add up document frequencies, and back to the
block. A document's vector is built from its words where the block lies and is never written.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from lumenta.operators.counting import counted, gathered, kept_kind
from lumenta.sources.durable import durable

LOW, HIGH = 3, 5
#: A block is closed at so many counts of words, or bytes of distinct words.
COUNTS, WORD_BYTES = 1 << 21, 1 << 21
#: Grams of documents that are laid out together.
LAID_OUT = 1 << 20


def numbered(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(number of each value among the distinct ones, where each distinct one is found first); in the order in which they come."""
    coded = pa.array(values).dictionary_encode()
    number, first = coded.indices.to_numpy(), np.empty(len(coded.dictionary), np.int64)
    first[number[::-1]] = np.arange(len(values))[::-1]
    return number, first


def grams_of(words: list[bytes]) -> tuple[list[str], np.ndarray, np.ndarray]:
    """(grams, which, edges): distinct n-grams of words with a space at both ends; word i has grams which[edges[i]:edges[i + 1]], repeats included."""
    padded = [f" {w.decode()} " for w in words]
    text, lengths = "".join(padded), np.array([len(p) for p in padded], np.int64)
    codes, used = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32), np.zeros(0x110000, bool)
    used[codes] = True
    codes = (np.cumsum(used, dtype=np.int32) - 1)[codes]
    left = np.repeat(np.cumsum(lengths), lengths)
    left -= np.arange(len(codes))
    bits = max(1, int(used.sum()).bit_length())
    names: list[str] = []
    places = np.full((len(codes), HIGH - LOW + 1), -1, np.int32)
    for n in range(LOW, HIGH + 1):
        at = np.flatnonzero(left >= n)
        packed, width = codes[at].astype(np.int64), bits
        for j in range(1, n):
            if width + bits > 63:  # many letters: beginnings are numbered
                packed = numbered(packed)[0].astype(np.int64)
                width = max(1, int(packed.max(initial=0)).bit_length())
            packed, width = (packed << bits) | codes[at + j], width + bits
        number, first = numbered(packed)
        places[at, n - LOW] = number + len(names)
        names += [text[i : i + n] for i in at[first].tolist()]
    sizes = sum(np.maximum(lengths - n + 1, 0) for n in range(LOW, HIGH + 1)) if len(words) else lengths
    return names, places[places >= 0], np.concatenate(([0], np.cumsum(sizes)))


def vectors(sizes: np.ndarray, word: np.ndarray, n: np.ndarray, which: np.ndarray, edges: np.ndarray, grams: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(grams, tf) of each document, from the number of its words, its words and their counts."""
    ends = np.concatenate(([0], np.cumsum(sizes)))
    width = edges[word + 1] - edges[word]
    total = np.concatenate(([0], np.cumsum(width)))[ends]  # of the documents before each one
    last, tf, d = np.zeros(grams, np.int64), np.zeros(grams), 0
    while d < len(sizes):
        to = max(d + 1, int(np.searchsorted(total, total[d] + LAID_OUT, "right")) - 1)
        own, w = slice(ends[d], ends[to]), width[ends[d] : ends[to]]
        every = which[np.repeat(edges[word[own]] - np.cumsum(w) + w, w) + np.arange(w.sum())]
        times = np.repeat(n[own], w).astype(float)
        for a, b in zip((total[d:to] - total[d]).tolist(), (total[d + 1 : to + 1] - total[d]).tolist(), strict=True):
            g, order = every[a:b], np.arange(b - a)
            last[g] = order
            once = g[last[g] == order]
            np.add.at(tf, g, times[a:b])
            yield once, tf[once]
            tf[once] = 0.0
        d = to


def _packed(lists: dict[str, pa.Array]) -> bytes:
    batch = pa.RecordBatch.from_arrays([pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), x) for x in lists.values()], names=list(lists))
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, batch.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
        out.write_batch(batch)
    return sink.getvalue().to_pybytes()


def _lists(packed: bytes) -> dict[str, pa.Array]:
    batch = pa.ipc.open_stream(packed).read_next_batch()
    return {name: column.flatten() for name, column in zip(batch.schema.names, batch.columns, strict=True)}


def _posts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """block, place, gram, here of rows (block, posts)."""
    for batch in batches:
        for block, packed in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            own = _lists(packed.as_py())
            n = len(own["gram"])
            made = [pa.array(np.full(n, block)), pa.array(np.arange(n, dtype=np.int32)), own["gram"], own["here"]]
            yield pa.RecordBatch.from_arrays(made, names=["block", "place", "gram", "here"])


def blocks(docs: DataFrame, key: str, text: str) -> DataFrame:
    """block, payload, posts: a block's documents; its distinct grams, and how many of its documents have each."""

    def closed(number: int, kind: pa.DataType, keys: list, words: dict[bytes, int], sizes: list[int], word: list[np.ndarray], n: list[np.ndarray]) -> pa.RecordBatch:
        known, size, word, n = list(words), np.array(sizes, np.int32), np.concatenate(word), np.concatenate(n)
        names, which, edges = grams_of(known)
        here = np.zeros(len(names), np.int32)
        for once, _ in vectors(size, word, n, which, edges, len(names)):
            here[once] += 1
        payload = _packed({"keys": pa.array(keys, kind), "words": pa.array(known, pa.binary()), "sizes": pa.array(size), "word": pa.array(word), "n": pa.array(n)})
        made = [pa.array([number], pa.int64()), pa.array([payload], pa.binary()), pa.array([_packed({"gram": pa.array(names, pa.string()), "here": pa.array(here)})], pa.binary())]
        return pa.RecordBatch.from_arrays(made, names=["block", "payload", "posts"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds: list[pa.DataType] = []
        number, held = TaskContext.get().partitionId() << 32, ([], {}, [], [], [])
        counts = size = 0
        for own, found in counted(kept_kind(batches, kinds), pa.binary(), bytes.split):
            keys, words, sizes, word, n = held
            before = len(words)
            word.append(np.fromiter((words.setdefault(w, len(words)) for w in found), np.int32, len(found)))
            n.append(np.fromiter(found.values(), np.int32, len(found)))
            keys.append(own), sizes.append(len(found))
            counts += len(found)
            if len(words) > before:
                size += sum(len(w) for w, i in zip(found, word[-1].tolist(), strict=True) if i >= before)
            if counts >= COUNTS or size >= WORD_BYTES:
                yield closed(number, kinds[0], *held)
                number, held, counts, size = number + 1, ([], {}, [], [], []), 0, 0
        if held[0]:
            yield closed(number, kinds[0], *held)

    rows = gathered(docs.select(key, text), key).select(key, F.lower(F.col(text)).alias("__text"))
    return rows.mapInArrow(run, "block long, payload binary, posts binary")


def cosines(docs: DataFrame, key: str, asked: dict[str, int], text: str = "text") -> DataFrame:
    """key, cosine of sublinear tf-idf vectors with the one of asked (counts of a query's grams), of documents that share a gram with it."""
    total, made = docs.count(), durable(blocks(docs, key, text))
    posts = made.select("block", "posts").mapInArrow(_posts, "block long, place int, gram string, here int")
    idf = lambda df: np.log((1 + total) / (1 + df)) + 1
    few = posts.where(F.col("gram").isin(*asked)).groupBy("gram").agg(F.sum("here").alias("df")).collect()  # a row for each gram of the query
    weights = {r.gram: float((1 + np.log(asked[r.gram])) * idf(r.df)) for r in few}
    norm = float(np.sqrt(sum(w * w for w in weights.values()))) or 1.0

    def score(left: pa.Table, right: pa.Table) -> pa.Table:
        own = _lists(left["payload"][0].as_py())
        names, which, edges = grams_of(own["words"].to_pylist())
        df = np.zeros(len(names), np.int64)
        df[right["place"].to_numpy()] = right["df"].to_numpy()
        weight = idf(df)
        query = np.array([weights.get(g, 0.0) for g in names])  # a gram that is asked weighs more than 0
        out = np.full(len(own["sizes"]), np.nan)
        for i, (once, tf) in enumerate(vectors(*(own[c].to_numpy() for c in ("sizes", "word", "n")), which, edges, len(names))):
            w, q = (1 + np.log(tf)) * weight[once], query[once]
            if q.any():
                out[i] = w @ q / (np.sqrt(w @ w) * norm)
        keep = ~np.isnan(out)
        return pa.table({key: own["keys"].filter(pa.array(keep)), "cosine": pa.array(out[keep])})

    # as many rows for a gram as there are blocks with it
    dfs = posts.select("block", "place", F.sum("here").over(Window.partitionBy("gram")).alias("df"))
    schema = StructType([StructField(key, docs.schema[key].dataType), *StructType.fromDDL("cosine double").fields])
    return made.select("block", "payload").groupBy("block").cogroup(dfs.groupBy("block")).applyInArrow(score, schema)
