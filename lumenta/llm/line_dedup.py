"""Reversible line dedup: sharded cuckoo filters in front of exact reference-count tables.

A line's key is the line stripped of white space, A-Z lower-cased. The exact table counts, for each key and document, how
often the document refers to it; keys found in enough documents are common, and lose all lines except in the largest
doc_id that holds them. Cuckoo filters (one for each shard of keys, each of bounded size) hold the common keys'
fingerprints, so that most lines are passed without a look-up in the exact table; the table has the last word on the
rest. Filters and counts take insertions and deletions, so LineIndex can take documents in and out.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenta.llm.common import BROADCAST_BYTES, bounds, col, durable, fresh, shuffle_width, slices, sorted_groups, widened

MIN_CODE_POINTS, MIN_DOCS = 40, 5
#: Keys a shard's filter is meant for.
SHARD_KEYS = 1 << 16
SLOTS, KICKS = 4, 500
#: Reference rows of a shard that one task takes at most, about, where filters are dealt out.
PART = 1 << 20
#: An index writes all its filters once in so many changes, so that readers pass over older ones.
WHOLE_EVERY = 16
#: Stands for a null doc_id: smaller than any other id.
NO_ID = -(1 << 63)
STRIPPED = b" \t\n\v\f\r"
_MIX = np.uint64(0x9E3779B97F4A7C15)


def line_key(line: bytes, least: int = MIN_CODE_POINTS) -> bytes | None:
    """The key's 16-byte hash, or None if it has too few code points. line: A-Z lower-cased."""
    own = line.strip(STRIPPED)
    if len(own) < least or len(own) < 4 * least and len(own.decode("utf-8", "replace")) < least:
        return None
    return xxhash.xxh3_128_digest(own)


class CuckooFilter:
    """Partial-key cuckoo filter: buckets of four 16-bit fingerprints; 0 is an empty slot. Copies of a key may be held at most eight times."""

    def __init__(self, buckets: int, table: np.ndarray | None = None):
        self.mask = np.uint64(buckets - 1)
        self.table = np.zeros((buckets, SLOTS), np.uint16) if table is None else table

    @classmethod
    def for_keys(cls, n: int) -> CuckooFilter:
        return cls(1 << max(2, int(np.ceil(np.log2(max(1, n) / (SLOTS * 0.85))))))

    @classmethod
    def from_bytes(cls, data: bytes) -> CuckooFilter:
        table = np.frombuffer(data, np.uint16).reshape(-1, SLOTS).copy()
        return cls(len(table), table)

    def to_bytes(self) -> bytes:
        return self.table.tobytes()

    def places(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Fingerprints and both buckets of 64-bit key hashes."""
        fp = ((keys >> np.uint64(48)) % np.uint64(65535) + np.uint64(1)).astype(np.uint16)
        first = (keys >> np.uint64(8)) & self.mask
        return fp, first, self.other(first, fp)

    def other(self, bucket: np.ndarray, fp: np.ndarray) -> np.ndarray:
        return (bucket ^ ((np.asarray(fp).astype(np.uint64) * _MIX) >> np.uint64(32))) & self.mask

    def holds(self, keys: np.ndarray) -> np.ndarray:
        fp, a, b = self.places(keys)
        return ((self.table[a] == fp[:, None]) | (self.table[b] == fp[:, None])).any(axis=1)

    def insert(self, keys: np.ndarray) -> bool:
        """False if a key found no place; the filter must then be built anew, larger."""
        turn = np.random.default_rng(len(keys))
        for fp, a, b in zip(*self.places(keys), strict=True):
            for bucket in (a, b):
                if len(free := np.flatnonzero(self.table[bucket] == 0)):
                    self.table[bucket, free[0]] = fp
                    break
            else:
                bucket = b
                for _ in range(KICKS):
                    slot = int(turn.integers(SLOTS))
                    fp, self.table[bucket, slot] = self.table[bucket, slot], fp
                    bucket = self.other(bucket, fp)
                    if len(free := np.flatnonzero(self.table[bucket] == 0)):
                        self.table[bucket, free[0]] = fp
                        break
                else:
                    return False
        return True

    def delete(self, keys: np.ndarray) -> None:
        for fp, a, b in zip(*self.places(keys), strict=True):
            for bucket in (a, b):
                if len(own := np.flatnonzero(self.table[bucket] == fp)):
                    self.table[bucket, own[0]] = 0
                    break


def built(keys: np.ndarray, room: int = 1) -> CuckooFilter:
    """A filter of the keys, for room times as many."""
    own, size = CuckooFilter.for_keys(room * len(keys)), room * len(keys)
    while not own.insert(keys):
        size *= 2
        own = CuckooFilter.for_keys(size)
    return own


def hashes(keys: list[bytes]) -> np.ndarray:
    """64-bit hashes for shards and filters: the first half of the keys."""
    return np.frombuffer(b"".join(keys), "<u8")[::2]


def shard_of(h: np.ndarray, shards: int) -> np.ndarray:
    return ((h & np.uint64(0xFFFFFFFF)) * np.uint64(shards)) >> np.uint64(32)


def _apart(docs: DataFrame) -> Column:
    """Tells rows without doc_id apart by their texts; 0 for all others. They count as one document, but each loses its own lines only."""
    return F.when(F.col("doc_id").cast("long").isNull(), F.xxhash64("text")).otherwise(F.lit(0)).cast("long")


def references(docs: DataFrame, least: int = MIN_CODE_POINTS, filters=None) -> DataFrame:
    """(key, doc, apart, n): how often each row's document refers to each key. With filters (a broadcast dict of shards): only keys they hold."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shards = None if filters is None else filters.value
        for batch in batches:
            keys, ids, aparts, counts = [], [], [], []
            for doc, apart, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                own: dict[bytes, int] = {}
                for line in text.lower().split(b"\n") if text else ():
                    if key := line_key(line, least):
                        own[key] = own.get(key, 0) + 1
                keys += own
                ids += [doc] * len(own)
                aparts += [apart] * len(own)
                counts += own.values()
            rows = [pa.array(keys, pa.binary()), pa.array(ids, pa.int64()), pa.array(aparts, pa.int64()), pa.array(counts, pa.int64())]
            if shards is not None and keys:
                h = hashes(keys)
                shard, hit = shard_of(h, len(shards)), np.zeros(len(h), bool)
                for s in np.unique(shard).tolist():
                    if s in shards:
                        at = np.flatnonzero(shard == s)
                        hit[at] = shards[s].holds(h[at])
                rows = [x.filter(pa.array(hit)) for x in rows]
            yield pa.RecordBatch.from_arrays(rows, names=["key", "doc", "apart", "n"])

    own = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("doc"), _apart(docs).alias("apart"), F.col("text").cast("binary").alias("text"))
    return own.mapInArrow(run, "key binary, doc long, apart long, n long")


def counted(refs: DataFrame) -> DataFrame:
    """The exact table: (key, n_docs, max_doc) from reference rows, whose n may be negative where documents went."""
    held = refs.groupBy("key", "doc").agg(F.sum("n").alias("n")).where("n > 0")
    return held.groupBy("key").agg(F.count("*").alias("n_docs"), F.max("doc").alias("max_doc"))


def shard_filters(common: DataFrame, n_keys: int) -> DataFrame:
    """(shard, shards, data): a filter for each shard of the common keys, built where its keys are."""
    shards = max(1, -(-n_keys // SHARD_KEYS))

    def name(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            h = hashes(batch.column(0).to_pylist())
            yield pa.RecordBatch.from_arrays([pa.array(shard_of(h, shards).astype(np.int64)), pa.array(h.view(np.int64))], names=["shard", "h"])

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in sorted_groups(batches, "shard"):
            own, h = table["shard"].to_numpy(), table["h"].to_numpy().view(np.uint64)
            edges = bounds(own)
            data = [built(h[a:b]).to_bytes() for a, b in zip(edges[:-1], edges[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(own[edges[:-1]]), pa.array([shards] * len(data), pa.int64()), pa.array(data, pa.binary())], names=["shard", "shards", "data"])

    named = common.select("key").mapInArrow(name, "shard long, h long")
    return named.repartition(min(shards, shuffle_width(common)), "shard").sortWithinPartitions("shard", "h").mapInArrow(build, "shard long, shards long, data binary")


def _met(refs: DataFrame, filters: DataFrame, shards: int, per_shard: int) -> DataFrame:
    """The reference rows whose key its shard's filter holds. Filters and rows meet by shard; each shard is dealt out in salted parts of about PART rows."""
    salts = max(1, -(-per_shard // PART))

    def name(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array(shard_of(hashes(batch.column(0).to_pylist()), shards).astype(np.int64)), *batch.columns], names=["shard", *batch.schema.names])

    def pick(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, own = None, None
        for batch in slices(batches, 1 << 14):
            part, data, key = (batch.column(i).to_pylist() for i in range(3))
            hit, edges = np.zeros(batch.num_rows, bool), bounds(np.array(part))
            for a, b in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
                if part[a] != at:
                    at, own = part[a], None
                if data[a] is not None:  # a part's filter comes first
                    own, a = CuckooFilter.from_bytes(data[a]), a + 1
                if own is not None and a < b:
                    hit[a:b] = own.holds(hashes(key[a:b]))
            yield pa.RecordBatch.from_arrays(batch.columns[2:], names=batch.schema.names[2:]).filter(pa.array(hit))

    rows = refs.mapInArrow(name, "shard long, key binary, doc long, apart long, n long")
    rows = rows.select((F.col("shard") * salts + F.pmod(F.xxhash64("doc", "apart"), F.lit(salts))).alias("part"), F.lit(None).cast("binary").alias("data"), "key", "doc", "apart", "n")
    held = filters.select("shard", "data", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("salt"))
    held = held.select((F.col("shard") * salts + F.col("salt")).alias("part"), "data", F.lit(None).cast("binary").alias("key"), *[F.lit(None).cast("long").alias(c) for c in ("doc", "apart", "n")])
    every = rows.unionByName(held)
    return every.repartition(shuffle_width(refs), "part").sortWithinPartitions("part", F.col("data").isNull()).mapInArrow(pick, "key binary, doc long, apart long, n long")


def dropped_keys(docs: DataFrame, table: DataFrame, least: int = MIN_CODE_POINTS, min_docs: int = MIN_DOCS, filters: DataFrame | None = None) -> DataFrame:
    """(doc, apart, keys): for each document the keys whose lines it loses.

    Lines first meet the cuckoo filters. Filters of up to BROADCAST_BYTES in all are handed to every task; larger ones are
    dealt out by shard, and the lines' keys with them.
    """
    common = durable(table.where(F.col("n_docs") >= min_docs))
    made = durable(shard_filters(common, common.count()) if filters is None else filters)
    size = made.agg(F.coalesce(F.sum(F.length("data")), F.lit(0)).alias("b"), F.coalesce(F.max("shards"), F.lit(1)).alias("shards")).first()
    if size.b <= BROADCAST_BYTES:
        own = {r.shard: CuckooFilter.from_bytes(r.data) for r in made.collect()}
        asked = references(docs, least, docs.sparkSession.sparkContext.broadcast({s: own.get(s, CuckooFilter(4)) for s in range(size.shards)}))
    else:
        refs = durable(references(docs, least))
        asked = _met(refs, made, size.shards, refs.count() // size.shards)
    lost = asked.join(common, "key").where(F.col("doc") != F.col("max_doc"))
    return lost.groupBy("doc", "apart").agg(F.collect_set("key").alias("keys"))


def _apply(docs: DataFrame, decisions: DataFrame, least: int) -> tuple[DataFrame, str, str]:
    """docs with the text less its lost lines, and the names of two added columns: lines before, and lines dropped."""
    doc, apart, keys, n_lines, n_dropped = (fresh(x, docs) for x in ("__doc", "__apart", "__keys", "__n_lines", "__n_dropped"))
    rows = docs.withColumns({doc: F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)), apart: _apart(docs)})
    rows = rows.join(decisions.select(F.col("doc").alias(doc), F.col("apart").alias(apart), F.col("keys").alias(keys)), [doc, apart], "left")

    def lines(texts: list[bytes | None], lost: list[list[bytes] | None]) -> list[list]:
        out: list[list] = [[], [], []]
        for text, keys in zip(texts, map(set, (k or () for k in lost)), strict=True):
            own = (text or b"").split(b"\n")
            kept = [x for x in own if line_key(x.lower(), least) not in keys] if keys else own
            for to, x in zip(out, (None if text is None else b"\n".join(kept) if keys else text, len(own), len(own) - len(kept)), strict=True):
                to.append(x)
        return out

    made = widened(rows.drop(doc, apart), lines, ["text", keys], [("text", "string"), (n_lines, "long"), (n_dropped, "long")], (keys,))
    return made.select(*[col(c) for c in docs.columns], n_lines, n_dropped), n_lines, n_dropped


def deduplicated(docs: DataFrame, least: int = MIN_CODE_POINTS, min_docs: int = MIN_DOCS, counts: bool = True) -> DataFrame:
    """docs with the text less its common lines; with counts, __n_lines and __n_dropped are added (longer names where docs has these).

    Lines are parted by line feeds; null and empty texts are one empty line (null stays null). Rows that share a doc_id are one document when
    documents are counted; null doc_ids are one document, with an id below all others. A key in many lines of one
    document counts once. The largest doc_id keeps all its lines of a key. Extra columns stay as they are.
    """
    made, *names = _apply(docs, dropped_keys(docs, counted(references(docs, least)), least, min_docs), least)
    return made if counts else made.drop(*names)


def report(docs: DataFrame, least: int = MIN_CODE_POINTS, min_docs: int = MIN_DOCS) -> DataFrame:
    out = deduplicated(docs.select("doc_id", "text"), least, min_docs)
    return out.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("__n_lines").alias("n_lines"), F.col("__n_dropped").alias("n_dropped"), F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


class LineIndex:
    """Reference counts and filters on shared storage, that documents are put into and taken out of again.

    path/refs is a log of reference rows by version (deletions have negative n), path/filters one of the filters that a
    version changed; every WHOLE_EVERY-th version has all of them. A change counts once its filters are written whole: until
    then readers, and whoever opens the index, pass over it, and a retry overwrites what it left. A filter that overflows
    is built anew from the table, for twice its keys. An index that exists is opened, with the settings it was made with.
    """

    def __init__(self, spark: SparkSession, path: str, least: int = MIN_CODE_POINTS, min_docs: int = MIN_DOCS, shards: int = 16, shard_keys: int = SHARD_KEYS):
        self.spark, self.path, self.version = spark, path, -1
        done = [int(x.rpartition("=")[2]) for x in self._list("filters") if self._list(f"filters/{x}", "_SUCCESS")]
        if done:
            self.version = max(done)
            made = spark.read.parquet(f"{path}/settings").first()
            self.least, self.min_docs, self.shards, self.shard_keys = made.least, made.min_docs, made.shards, made.shard_keys
            return
        self.least, self.min_docs, self.shards, self.shard_keys = least, min_docs, shards, shard_keys
        spark.createDataFrame([(least, min_docs, shards, shard_keys)], "least int, min_docs int, shards int, shard_keys int").coalesce(1).write.mode("overwrite").parquet(f"{path}/settings")
        spark.createDataFrame([], "key binary, doc long, n long").write.mode("overwrite").parquet(f"{path}/refs/version=0")
        spark.createDataFrame([], FILTERS).write.mode("overwrite").parquet(f"{path}/filters/version=0")
        self.version = 0

    def _list(self, folder: str, name: str | None = None) -> list[str]:
        """Names in a folder of the index (with name: only that one, if it is there)."""
        sc = self.spark.sparkContext
        at = sc._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{folder}")
        fs = at.getFileSystem(sc._jsc.hadoopConfiguration())
        found = [f.getPath().getName() for f in fs.listStatus(at)] if fs.exists(at) else []
        return [x for x in found if name is None or x == name]

    def _read(self, folder: str, schema: str, first: int, version: int) -> DataFrame:
        paths = [f"{self.path}/{folder}/version={v}" for v in range(first, version + 1)]
        return self.spark.read.option("basePath", f"{self.path}/{folder}").schema(f"{schema}, version int").parquet(*paths)

    def refs(self, version: int | None = None) -> DataFrame:
        return self._read("refs", "key binary, doc long, n long", 0, self.version if version is None else version).drop("version")

    def table(self) -> DataFrame:
        return counted(self.refs())

    def filters(self) -> DataFrame:
        """(shard, shards, data): each shard's filter as the last change left it."""
        every = self._read("filters", FILTERS, self.version - self.version % WHOLE_EVERY, self.version)
        last = every.groupBy("shard").agg(F.max("version").alias("version"))
        return every.join(last, ["shard", "version"]).select("shard", "shards", "data")

    def insert(self, docs: DataFrame) -> None:
        self._change(durable(references(docs, self.least).drop("apart")))

    def delete(self, docs: DataFrame) -> None:
        """Takes out all references of the documents with these doc_ids (their texts aren't needed)."""
        ids = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("doc")).distinct()
        gone = self.refs().join(ids, "doc", "left_semi").groupBy("key", "doc").agg(F.sum("n").alias("n")).where("n > 0")
        self._change(durable(gone.select("key", "doc", (-F.col("n")).alias("n"))))

    def _change(self, rows: DataFrame) -> None:
        touched, version = rows.select("key").distinct(), self.version + 1
        common = lambda refs: counted(refs).where(F.col("n_docs") >= self.min_docs).select("key")
        before = durable(common(self.refs().join(touched, "key", "left_semi")))
        rows.write.mode("overwrite").parquet(f"{self.path}/refs/version={version}")
        after = durable(common(self.refs(version).join(touched, "key", "left_semi")))
        moved = after.exceptAll(before).withColumn("up", F.lit(True)).unionByName(before.exceptAll(after).withColumn("up", F.lit(False)))
        shards, shard_keys, held, whole = self.shards, self.shard_keys, self.filters(), version % WHOLE_EVERY == 0
        schema = pa.schema([("shard", pa.int64()), ("shards", pa.int64()), ("data", pa.binary())])

        def name(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                h = hashes(batch.column(0).to_pylist())
                yield pa.RecordBatch.from_arrays([pa.array(shard_of(h, shards).astype(np.int64)), pa.array(h.view(np.int64)), batch.column(1)], names=["shard", "h", "up"])

        def update(key, own, changes):
            """The shard's filter after the changes; null if it is full. No row if nothing changes, but in a whole version."""
            h, up = changes["h"].to_numpy().view(np.uint64), changes["up"].to_numpy()
            data = own["data"].to_pylist()
            if not len(h):
                return pa.table({"shard": own["shard"], "shards": own["shards"], "data": own["data"]} if whole else {"shard": [], "shards": [], "data": []}, schema=schema)
            filter_ = CuckooFilter.from_bytes(data[0]) if data else CuckooFilter.for_keys(shard_keys)
            filter_.delete(h[~up])
            made = filter_.to_bytes() if filter_.insert(h[up]) else None
            return pa.table({"shard": [key[0].as_py()], "shards": [shards], "data": [made]}, schema=schema)

        def rebuild(key, own):
            return pa.table({"shard": [key[0].as_py()], "shards": [shards], "data": [built(own["h"].to_numpy().view(np.uint64), 2).to_bytes()]}, schema=schema)

        named = moved.mapInArrow(name, "shard long, h long, up boolean")
        made = durable(held.groupBy("shard").cogroup(named.groupBy("shard")).applyInArrow(update, FILTERS))
        full = [r.shard for r in made.where("data is null").select("shard").collect()]
        if full:
            every = common(self.refs(version)).withColumn("up", F.lit(True)).mapInArrow(name, "shard long, h long, up boolean")
            anew = every.where(F.col("shard").isin(full)).groupBy("shard").applyInArrow(rebuild, FILTERS)
            made = made.where("data is not null").unionByName(anew)
        made.write.mode("overwrite").parquet(f"{self.path}/filters/version={version}")
        self.version = version

    def apply(self, docs: DataFrame) -> tuple[DataFrame, str, str]:
        """docs with the text less the index's common lines, and the names of two added columns: lines before, and lines dropped."""
        return _apply(docs, dropped_keys(docs, self.table(), self.least, self.min_docs, self.filters()), self.least)


FILTERS = "shard long, shards long, data binary"
