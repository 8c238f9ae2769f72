"""Near copies: SimHash pigeonhole blocks first, then the rest exactly, at a Jaccard similarity of at least 0.8 of five-word shingles.

SimHash links (fingerprints within a few bits, met on blocks) join most copies at once; each link is verified on the texts.
They can't be all: at similarity 0.8 about 10 of 64 bits differ, and often 16, which no affordable choice of blocks covers.
The rest comes from a prefix filter, which loses no pair: in any one order of all shingles, two sets of similarity 0.8 or
more share one of the first |x| - ceil(0.8 |x|) + 1 shingles of both. The order has shingles that a sample finds common
last, which keeps groups small and changes no result. Each group's members are first compared with one of them; members
that are joined by then make no more pairs with each other, all others do. Every pair is verified on the texts.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lumenta.llm import simhash
from lumenta.llm.common import bounds, durable, fresh, shuffle_width, slices, small, sorted_groups, table
from lumenta.llm.components import components
from lumenta.llm.simhash import fingerprint, shingle_hashes

SHINGLE = 5
#: One text of so many is asked which shingles are common, and so many of these texts must have one; at most so many shingles are moved to the end.
SAMPLE, SAMPLE_DOCS, MOST_COMMON = 16, 4, 1 << 18
#: Times that each group is compared with one of its members before all that are still apart are compared.
ROUNDS = 1
#: Keys of fingerprints' rows are turned by this, and their place is -1.
TURN = 0x5DEECE66D
#: Rows of one key that a single task compares; more are dealt out as pairs of chunks of this size.
GROUP = 1 << 12
#: Bits of a set's parity map.
PARITY = 512
ROW = "key long, node long, size int, place int, bits binary"
#: Texts that one row of candidates is compared with.
CHUNK = 64


def shingles(text: bytes | None, n: int = SHINGLE) -> set[int]:
    """The set of a text's n-word shingles, as hashes; texts without words share one."""
    return set(shingle_hashes(text, n)) or {0}


def parity(h: np.ndarray) -> bytes:
    """For each of PARITY residues whether an odd number of the set's hashes has it: two sets differ in at least as many members as their maps in bits."""
    return np.packbits((np.bincount((h & np.uint64(PARITY - 1)).astype(np.int64), minlength=PARITY) & 1).astype(np.uint8)).tobytes()


def _common(texts: DataFrame, n: int) -> np.ndarray:
    """Hashes that many sampled texts hold, the rarest first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            own = [np.fromiter(shingles(t, n), np.uint64) for t in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(own).view(np.int64))], names=["h"])

    found = texts.where(F.pmod("node", F.lit(SAMPLE)) == 0).select(F.col("text").cast("binary").alias("text")).mapInArrow(run, "h long").groupBy("h").agg(F.count("*").alias("n")).where(F.col("n") >= SAMPLE_DOCS)
    found = durable(found)
    # the count from which at most MOST_COMMON shingles are left; there are far fewer different counts than shingles
    total, least = 0, 0
    for r in found.groupBy("n").agg(F.count("*").alias("k")).orderBy(F.col("n").desc()).toLocalIterator():
        if total + r.k > MOST_COMMON:
            least = r.n + 1
            break
        total += r.k
    rows = found.where(F.col("n") >= least).toArrow()  # at most MOST_COMMON
    order = np.lexsort((rows["h"].to_numpy(), -rows["n"].to_numpy()))
    return rows["h"].to_numpy()[order][::-1].view(np.uint64)


def _prefixes(texts: DataFrame, common: np.ndarray, n: int) -> DataFrame:
    """(key, node, size, place, bits) of each text's first shingles in the order, and a row for its fingerprint, which has the text's parity map."""
    order = np.argsort(common)
    held = texts.sparkSession.sparkContext.broadcast((common[order], order + 1))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, ranks = held.value
        for batch in slices(batches):
            out, sizes, lengths, maps = [], [], [], []
            for text in batch.column(1).to_pylist():
                every = np.array(shingle_hashes(text, n), np.uint64)
                h = np.unique(every) if len(every) else np.zeros(1, np.uint64)
                rank = np.zeros(len(h), np.int64)
                if len(keys):
                    at = np.minimum(np.searchsorted(keys, h), len(keys) - 1)
                    rank = np.where(keys[at] == h, ranks[at], 0)
                length = len(h) - -(-4 * len(h) // 5) + 1
                out.append(np.array([fingerprint(every) ^ TURN], np.uint64))
                out.append(h[np.lexsort((h, rank))[:length]])
                sizes.append(len(h))
                lengths.append(length + 1)
                maps += [parity(h), *[None] * length]
            place = np.concatenate([np.arange(-1, x - 1) for x in lengths])
            node, size = np.repeat(batch.column(0).to_numpy(), lengths), np.repeat(sizes, lengths)
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(out).view(np.int64)), pa.array(node), pa.array(size, pa.int32()), pa.array(place, pa.int32()), pa.array(maps, pa.binary())], names=["key", "node", "size", "place", "bits"])

    return texts.select("node", F.col("text").cast("binary").alias("text")).mapInArrow(run, ROW)


def _shared(rows: DataFrame) -> DataFrame:
    """The rows whose key more than one node has, and those of fingerprints. Only a batch is held at a time, however many rows a key has."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, before = None, None  # the last row so far, and the key before it
        for batch in batches:
            if not batch.num_rows:
                continue
            own = pa.Table.from_batches([batch] if held is None else [held, batch]).combine_chunks().to_batches()[0]
            key, place = own.column(0).to_numpy(), own.column(3).to_numpy()
            same = np.concatenate(([key[0] == before] if before is not None else [False], key[1:] == key[:-1]))
            keep = same[:-1] | same[1:] | (place[:-1] < 0)
            yield own.slice(0, len(key) - 1).filter(pa.array(keep))
            held, before = own.slice(len(key) - 1), key[-2] if len(key) > 1 else before
        if held is not None and (held.column(0)[0].as_py() == before or held.column(3)[0].as_py() < 0):
            yield held

    return rows.repartition(shuffle_width(rows), "key").sortWithinPartitions("key").mapInArrow(run, ROW)


def _possible(size: np.ndarray, place: np.ndarray, i: int, j: np.ndarray) -> np.ndarray:
    """Whether i and each of j can be similar, by their sizes and the places of the shingle that they share."""
    before, after = np.minimum(place[i], place[j]), np.minimum(size[i] - place[i], size[j] - place[j])
    return 9 * (before + after) >= 4 * (size[i] + size[j])


def _dealt(rows: DataFrame) -> DataFrame:
    """rows with the group that compares them and their chunk in it: a key, or for a key with more than GROUP rows each pair of its chunks."""
    sizes = durable(rows.groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") > GROUP))
    plain = rows.withColumns({"group": F.col("key"), "chunk": F.lit(0)})
    n = sizes.count()
    if not n:
        return plain
    parts = F.ceil(F.col("n") / GROUP).cast("int")
    large = rows.join(small(sizes, n, 16), "key").withColumn("chunk", F.pmod(F.xxhash64("node", F.lit("chunk")), parts).cast("int")).withColumn("met", F.explode(F.sequence(F.lit(0), parts - 1)))
    large = large.select(*rows.columns, F.xxhash64("key", F.least("chunk", "met"), F.greatest("chunk", "met")).alias("group"), F.when(F.col("chunk") == F.col("met"), F.lit(0)).otherwise(F.col("chunk") + 1).alias("chunk"))
    return plain.join(small(sizes.select("key"), n, 8), "key", "left_anti").unionByName(large)


def _crossing(rows: DataFrame) -> DataFrame:
    """(u, v): possible pairs of nodes that share a key and are not joined yet.

    A pair is possible if its sizes, the places of the shared key and the parity maps of both sets allow a similarity of 0.8:
    sets of that similarity differ in at most a ninth of their members together. Both prefixes hold all shared shingles up
    to the end of the one that ends first, so pairs that share too few keys for what is left are dropped last.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for own in sorted_groups(batches, "group"):
            group, node, size, place, part, chunk = (own[c].to_numpy() for c in ("group", "node", "size", "place", "component", "chunk"))
            bits = np.frombuffer(b"".join(own["bits"].to_pylist()), np.uint64).reshape(len(node), -1)
            size, place, edges = size.astype(np.int64), place.astype(np.int64), bounds(group)
            u, v, need, held = [], [], [], 0  # nodes are sorted within a group, so u < v
            for a, b in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
                if (part[a:b] == part[a]).all():
                    continue
                across = chunk[a:b].any()  # of two chunks, each is compared within itself in a group of its own
                for i in range(a, b - 1):
                    j = np.arange(i + 1, b)
                    j = j[(part[j] != part[i]) & _possible(size, place, i, j) & (~across | (chunk[j] != chunk[i]))]
                    j = j[9 * np.bitwise_count(bits[j] ^ bits[i]).sum(axis=1) <= size[i] + size[j]]
                    u.append(np.full(len(j), node[i]))
                    v.append(node[j])
                    need.append(-(-4 * (size[i] + size[j]) // 9) - np.maximum(-(-4 * size[i] // 5), -(-4 * size[j] // 5)) + 1)
                    held += len(j)
                    if held > 1 << 18:
                        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in (u, v, need)], names=["u", "v", "need"])
                        u, v, need, held = [], [], [], 0
            if held:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in (u, v, need)], names=["u", "v", "need"])

    rows = _dealt(rows).select("group", "chunk", "node", "size", "place", "component", "bits")
    made = rows.repartition(shuffle_width(rows), "group").sortWithinPartitions("group", "node").mapInArrow(run, "u long, v long, need long")
    return made.groupBy("u", "v").agg(F.count("*").alias("n"), F.first("need").alias("need")).where("n >= need").select("u", "v")


def verified(pairs: DataFrame, texts: DataFrame, n: int = SHINGLE) -> DataFrame:
    """(u, v): the pairs (u < v) of texts (node, text) whose shingle sets have a Jaccard similarity of 0.8 or more."""
    # a node with many partners is met in chunks of them, so its text is sent once for each chunk
    own = pairs.distinct().withColumn("part", F.pmod(F.xxhash64("v"), F.greatest(F.lit(1), F.ceil(F.count("*").over(Window.partitionBy("u")) / CHUNK))))
    own = durable(own.select(F.xxhash64("u", "part").alias("chunk"), "u", "v"))
    members = own.select("chunk", F.col("u").alias("node"), F.lit(True).alias("first")).distinct().unionByName(own.select("chunk", F.col("v").alias("node"), F.lit(False).alias("first")))
    rows = members.join(texts.select("node", F.col("text").cast("binary").alias("text")), "node")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunk, head, mine = None, None, set()
        for batch in slices(batches):
            u, v = [], []
            for c, node, first, text in zip(*(batch.column(k).to_pylist() for k in range(4)), strict=True):
                if first:
                    chunk, head, mine = c, node, shingles(text, n)
                    continue
                assert c == chunk
                other = shingles(text, n)
                if 9 * len(mine & other) >= 4 * (len(mine) + len(other)):
                    u.append(head)
                    v.append(node)
            yield pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64())], names=["u", "v"])

    rows = rows.select("chunk", "node", "first", "text").repartition(shuffle_width(rows), "chunk").sortWithinPartitions("chunk", F.col("first").desc())
    return rows.mapInArrow(run, "u long, v long")


def _near_fingerprints(shared: DataFrame) -> DataFrame:
    """(u, v): nodes whose fingerprints are equal or linked by pigeonhole blocks, as stars."""
    own = durable(shared.where("place < 0").select("node", F.col("key").bitwiseXOR(F.lit(TURN)).alias("fp")))
    first = durable(own.groupBy("fp").agg(F.min("node").alias("u")))
    equal = own.join(first, "fp").where("u <> node").select("u", F.col("node").alias("v"))
    met = simhash.links(first.select(F.col("fp").alias("node"), "fp"))
    met = met.join(first.select(F.col("fp").alias("u"), F.col("u").alias("a")), "u").join(first.select(F.col("fp").alias("v"), F.col("u").alias("b")), "v")
    return equal.unionByName(met.select(F.col("a").alias("u"), F.col("b").alias("v")))


def links(texts: DataFrame, n: int = SHINGLE) -> DataFrame:
    """(u, v) of texts (node, text), nodes unique: links whose components are those of all pairs of similarity 0.8 or more."""
    every = table(_shared(_prefixes(texts, _common(texts, n), n)))
    shared, found = every.where("place >= 0").drop("bits"), durable(verified(_near_fingerprints(every), texts, n))
    for k in range(ROUNDS + 1):
        joined = durable(components(found))
        rows = shared.join(small(joined, joined.count(), 16), "node", "left").withColumn("component", F.coalesce("component", "node"))
        if k == ROUNDS:
            # keys whose rows are all joined make no pairs
            apart = durable(rows.groupBy("key").agg(F.min("component").alias("a"), F.max("component").alias("b")).where("a <> b").select("key"))
            left = rows.join(small(apart, apart.count(), 8), "key").join(every.where("place < 0").select("node", "bits"), "node")
            return found.unionByName(durable(verified(_crossing(left), texts, n)))
        hubs = rows.groupBy("key").agg(F.min_by(F.struct("node", "size", "place", "component"), F.xxhash64("key", "node", F.lit(k))).alias("hub"))
        fits = 9 * (F.least("place", "hub.place") + F.least(F.col("size") - F.col("place"), F.col("hub.size") - F.col("hub.place"))) >= 4 * (F.col("size") + F.col("hub.size"))
        met = rows.join(hubs, "key").where((F.col("component") != F.col("hub.component")) & fits)
        found = found.unionByName(durable(verified(met.select(F.least("node", "hub.node").alias("u"), F.greatest("node", "hub.node").alias("v")), texts, n)))


def representatives(docs: DataFrame, n: int = SHINGLE) -> DataFrame:
    """Rows of docs, with all their columns, but those of whose group of near copies another has a smaller doc_id. Rows without id stay.

    A group is all that is reached over pairs of similarity 0.8 or more. Texts of under n words are one shingle; null and
    empty ones are copies of each other. Equal texts are one node, so copies make no pairs.
    """
    node = F.xxhash64(F.coalesce("text", F.lit("")))
    nodes = table(docs.select(node.alias("node"), "text", F.col("doc_id").cast("long").alias("doc")).groupBy("node").agg(F.first("text").alias("text"), F.min("doc").alias("low"), F.max("doc").alias("high")))
    joined = components(links(nodes.select("node", "text"), n))
    named = nodes.select("node", "low", "high").join(joined, "node", "left").withColumn("component", F.coalesce("component", "node"))
    least = named.groupBy("component").agg(F.min("low").alias("least"))
    own, gone = fresh("__node", docs), fresh("__gone", docs)
    late = durable(named.join(least, "component").where("high > least").select(F.col("node").alias(own), "least"))
    rows = docs.select(F.col("doc_id").cast("long").alias(gone), node.alias(own)).join(small(late, late.count(), 16), own).where(F.col(gone) > F.col("least"))
    rows = rows.select(gone, own).distinct()
    return docs.join(rows, (docs["doc_id"].cast("long") == rows[gone]) & (node == rows[own]), "left_anti")
