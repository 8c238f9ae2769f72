"""SimHash near-dedup by pigeonhole blocks.

A fingerprint is cut into b blocks. Two fingerprints that differ in at most d bits share at least b - d blocks, so they
meet under the key of some choice of b - d blocks. Equal fingerprints are one node; under each key, links within d bits
are verified, and a spanning forest of them is kept instead of all pairs. b is chosen so that keys are long enough for the
number of fingerprints; any b gives the same links. Keys with very many fingerprints are dealt out as pairs of chunks.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations
from math import comb, log2

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenta.llm.common import bounds, durable, fresh, shuffle_width, sorted_groups
from lumenta.llm.components import components

SHINGLE, BITS, SEED = 4, 4, 42
#: Fingerprints under one key that a single task compares; more are dealt out as pairs of chunks of this size.
CHUNK = 1 << 13
_LANES = np.uint64(0x0101010101010101)


def shingle_hashes(text: bytes | None, n: int = SHINGLE) -> list[int]:
    """XXH64 (seed 42) of each n-word shingle, repeats included; of the whole sequence if it has fewer words."""
    words = text.lower().split() if text else []
    if not words:
        return []
    joined = b" ".join(words)
    if len(words) <= n:
        return [xxhash.xxh64_intdigest(joined, SEED)]
    size = np.fromiter(map(len, words), np.int64, len(words)) + 1
    end = np.cumsum(size)
    digest = xxhash.xxh64_intdigest
    return [digest(joined[a:b], SEED) for a, b in zip((end - size)[: 1 - n].tolist(), (end[n - 1 :] - 1).tolist(), strict=True)]


def fingerprint(h: np.ndarray) -> int:
    """A bit is 1 if over half of the hashes have it; 0 without hashes."""
    if not len(h):
        return 0
    if len(h) == 1:
        return int(h[0])
    counts = np.zeros((8, 8), np.int64)
    for k in range(8):
        lanes = (h >> np.uint64(k)) & _LANES  # byte j's lowest bit is bit 8 j + k
        pad = -len(lanes) % 255
        if pad:
            lanes = np.concatenate((lanes, np.zeros(pad, np.uint64)))
        counts[:, k] = lanes.reshape(-1, 255).sum(axis=1).view(np.uint8).reshape(-1, 8).sum(axis=0, dtype=np.int64)
    bits = (2 * counts.reshape(64) > len(h)).astype(np.uint8)
    return int(np.packbits(bits, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, n: int = SHINGLE) -> DataFrame:
    """(doc_id, fp) for each row; fp is the fingerprint as a signed long."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = np.fromiter((fingerprint(np.array(shingle_hashes(t, n), np.uint64)) for t in batch.column(1).to_pylist()), np.uint64, batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps.view(np.int64))], names=["doc_id", "fp"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("binary").alias("text")).mapInArrow(run, "doc_id long, fp long")


def masks(n: int, bits: int = BITS) -> list[int]:
    """The fewest choices of blocks whose keys are about as long as log2(n) bits, at least."""
    best = []
    for blocks in range(bits + 1, bits + 6):
        edges = [64 * k // blocks for k in range(blocks + 1)]
        own = [((1 << (b - a)) - 1) << a for a, b in zip(edges[:-1], edges[1:], strict=True)]
        best = [sum(x) for x in combinations(own, blocks - bits)]
        if 64 * (blocks - bits) / blocks >= log2(max(2, n)):
            break
    assert len(best) == comb(blocks, bits)
    return best


def forest(fps: np.ndarray, bits: int) -> list[tuple[int, int]]:
    """Links (index, index) that join all fingerprints reachable over steps of at most bits, one less than each tree's nodes."""
    if len(fps) == 2:
        return [(0, 1)] if int(fps[0] ^ fps[1]).bit_count() <= bits else []
    out, rest = [], np.arange(len(fps))
    while len(rest):
        root, rest = rest[0], rest[1:]
        front = [root]
        while front and len(rest):
            near = np.bitwise_count(fps[rest] ^ fps[front.pop()]) <= bits
            if near.any():
                met = rest[near]
                rest = rest[~near]
                out += [(root, x) for x in met.tolist()]
                front += met.tolist()
    return out


def _linked(rows: DataFrame, bits: int, chunk: int) -> DataFrame:
    """(u, v) for rows (key, part, side, fp, node): links of a spanning forest within each (key, part)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in sorted_groups(batches, "group"):
            group, fp, node = (table[c].to_numpy() for c in ("group", "fp", "node"))
            edges, fp = bounds(group), fp.view(np.uint64)
            u, v = [], []
            for a, b in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
                if b - a > 1:
                    for i, j in forest(fp[a:b], bits):
                        u.append(node[a + i])
                        v.append(node[a + j])
            yield pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64())], names=["u", "v"])

    return rows.repartition(shuffle_width(rows), "group").sortWithinPartitions("group").mapInArrow(run, "u long, v long")


def links(nodes: DataFrame, bits: int = BITS, chunk: int = CHUNK) -> DataFrame:
    """(u, v): links whose components are those of all pairs of nodes (node, fp) within bits of each other. node and fp are unique."""
    nodes = durable(nodes.select("node", "fp"))
    n = nodes.count()
    keys = F.array(*[F.xxhash64(F.lit(k), F.col("fp").bitwiseAND(m - (1 << 64) if m >> 63 else m)) for k, m in enumerate(masks(n, bits))])
    rows = nodes.select("node", "fp", F.explode(keys).alias("group"))
    # a key with one fingerprint links nothing; sizes are summed before they are shuffled
    sizes = durable(rows.groupBy("group").agg(F.count("*").alias("n")).where("n > 1"))
    rows = rows.join(sizes, "group")
    small = rows.where(F.col("n") <= chunk).select("group", "fp", "node")
    # a large key's rows are in chunks; chunk i meets chunk j in group (key, i, j), where i <= j
    parts = F.ceil(F.col("n") / chunk).cast("int")
    own = F.pmod(F.xxhash64("fp", F.lit("chunk")), parts).cast("int")
    large = rows.where(F.col("n") > chunk).select("group", "fp", "node", own.alias("own"), F.explode(F.sequence(F.lit(0), parts - 1)).alias("met"))
    large = large.select(F.xxhash64("group", F.least("own", "met"), F.greatest("own", "met")).alias("group"), "fp", "node")
    return _linked(small.unionByName(large), bits, chunk)


def classes(docs: DataFrame, n: int = SHINGLE, bits: int = BITS) -> DataFrame:
    """(doc_id, fp, component_id) for each row of docs (doc_id, text).

    Words are parted by white space, A-Z lower-cased; null and empty texts have fingerprint 0 and link like any other.
    Rows with a null doc_id get their fingerprint, and as component the least id that it reaches (null if none). Repeated
    rows stay. Equal fingerprints are one node, so copies make no pairs.
    """
    own = durable(fingerprints(docs, n))
    nodes = durable(own.groupBy("fp").agg(F.min("doc_id").alias("id")))
    # fingerprints stand for themselves; a component's id is the least id of its fingerprints
    linked = components(links(nodes.select(F.col("fp").alias("node"), "fp"), bits))
    named = nodes.join(linked, nodes["fp"] == linked["node"], "left").select("fp", "id", F.coalesce("component", "fp").alias("component"))
    least = named.groupBy("component").agg(F.min("id").alias("component_id"))
    return own.join(named.join(least, "component").select("fp", "component_id"), "fp")


def report(docs: DataFrame) -> DataFrame:
    return classes(docs).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def representatives(docs: DataFrame, n: int = SHINGLE, bits: int = BITS) -> DataFrame:
    """Rows of docs, with all their columns, that stand for their group: those with the least doc_id. Rows without id stay."""
    gone = fresh("__gone", docs)
    late = classes(docs, n, bits).where("doc_id <> component_id").select(F.col("doc_id").alias(gone)).distinct()
    return docs.join(late, docs["doc_id"].cast("long") == late[gone], "left_anti")
