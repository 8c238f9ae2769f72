"""Lexical and dense retrieval: chunks, postings, BM25, character n-grams, cosine, and rank fusion.

An index is postings and sums; new documents are appended, nothing is rebuilt. Queries join their few terms to postings.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from lumenta.operators import char_vectors
from lumenta.operators.counting import counted, gathered, kept_kind, slices
from lumenta.sources.durable import durable, running

K1, B, RRF, LEAST_TOKEN = 1.5, 0.75, 60, 2
TOKEN = "[a-z0-9£$%]+"
LONG_TOKEN = re.compile(f"{TOKEN[:-1]}{{{LEAST_TOKEN},}}")
#: Rows that Python sends back together.
BATCH_ROWS = 1 << 14
#: Characters of chunks that Python sends back together.
BATCH_CHARS = 1 << 20
# Suffixes in the order in which they are tried, and the shortest stem.
SUFFIXES = ["ations", "ation", "ising", "izing", "ised", "ized", "ements", "ement", "ingly", "ing", "ies", "ied", "ical", "ally", "als", "ers", "est", "ed", "ly", "al", "s"]
LEAST_STEM = 4


def stem(token: Column) -> Column:
    """-ies becomes -y; else the first suffix that leaves four letters goes; then a last e of six letters or more goes."""
    n = F.length(token)
    cut = F.when(F.lit(False), "")
    for s in SUFFIXES:
        cut = cut.when(token.endswith(s) & (n - len(s) >= LEAST_STEM), F.substring(token, F.lit(1), n - len(s)))
    cut = F.coalesce(cut, token)
    bare = F.when(cut.endswith("e") & (F.length(cut) >= 6), F.substring(cut, F.lit(1), F.length(cut) - 1)).otherwise(cut)
    return F.when(token.endswith("ies") & (n >= 5), F.concat(F.substring(token, F.lit(1), n - 3), F.lit("y"))).otherwise(bare)


def tokens(docs: DataFrame, key: str, text: str = "text") -> DataFrame:
    """key, token: every token of two characters or more, unstemmed."""
    found = F.regexp_extract_all(F.lower(F.col(text)), F.lit(f"({TOKEN})"), F.lit(1))
    return docs.select(key, F.explode(F.filter(found, lambda t: F.length(t) >= LEAST_TOKEN)).alias("token"))


@lru_cache(maxsize=1 << 16)
def stem_of(token: str) -> str:
    """stem() of one token."""
    if token.endswith("ies") and len(token) >= 5:
        return token[:-3] + "y"
    cut = next((token[: -len(s)] for s in SUFFIXES if token.endswith(s) and len(token) - len(s) >= LEAST_STEM), token)
    return cut[:-1] if cut.endswith("e") and len(cut) >= 6 else cut


def _term_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[object, Counter]]:
    """(key, tf by term) of gathered rows (key, lower-cased text)."""
    for key, found in counted(batches, pa.string(), LONG_TOKEN.findall):
        tf: Counter = Counter()
        for token, n in found.items():
            tf[stem_of(token)] += n
        yield key, tf


def _lowered(docs: DataFrame, key: str, text: str) -> DataFrame:
    return gathered(docs.select(key, text), key).select(key, F.lower(F.col(text)).alias("__text"))


def _with_key(docs: DataFrame, key: str, ddl: str) -> StructType:
    return StructType([StructField(key, docs.schema[key].dataType), *StructType.fromDDL(ddl).fields])


def postings(docs: DataFrame, key: str, text: str = "text") -> DataFrame:
    """key, term, tf, counted where a text lies: neither tokens nor counts are shuffled."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds: list[pa.DataType] = []
        keys, found, tfs = [], [], []

        def made() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(keys, kinds[0]), pa.array(found, pa.string()), pa.array(tfs, pa.int64())], names=[key, "term", "tf"])

        for own, tf in _term_counts(kept_kind(batches, kinds)):
            keys += [own] * len(tf)
            found += tf
            tfs += tf.values()
            if len(keys) >= BATCH_ROWS:
                yield made()
                keys, found, tfs = [], [], []
        if keys:
            yield made()

    return _lowered(docs, key, text).mapInArrow(run, _with_key(docs, key, "term string, tf long"))


def terms(spark: SparkSession, query: str) -> DataFrame:
    """query, term, qf of one query text."""
    own = spark.createDataFrame([(query,)], "query string")
    return postings(own, "query", "query").select("query", "term", F.col("tf").alias("qf"))


def bm25(posts: DataFrame, key: str, asked: DataFrame) -> DataFrame:
    """key, bm25 of documents that share a term with asked (term, qf; a term counts as often as it is asked). asked is one query, so it is small."""
    lengths = posts.groupBy(key).agg(F.sum("tf").alias("length"))
    whole = lengths.agg(F.count("*").alias("n"), F.avg("length").alias("mean"))
    hits = posts.join(F.broadcast(asked.select("term", "qf")), "term")
    df = hits.groupBy("term").agg(F.count("*").alias("df"))
    rows = hits.join(F.broadcast(df), "term").join(lengths, key).crossJoin(F.broadcast(whole))
    idf = F.log(1 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    part = idf * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("length") / F.col("mean")))
    return rows.groupBy(key).agg(F.sum(F.col("qf") * part).alias("bm25"))


def char_grams(docs: DataFrame, key: str, text: str = "text", low: int = 3, high: int = 5) -> DataFrame:
    """key, gram, tf of character n-grams within words, each word with a space at both ends; a shorter word is one gram."""
    word = F.explode(F.filter(F.split(F.lower(F.col(text)), r"\s+"), lambda w: F.length(w) > 0)).alias("w")
    words = docs.select(key, word).groupBy(key, "w").agg(F.count("*").alias("n")).withColumn("p", F.concat(F.lit(" "), "w", F.lit(" ")))
    # lengths that the word has; a word shorter than the least gives itself once
    sizes = F.filter(F.array(*[F.lit(n) for n in range(low, high + 1)]), lambda n: n <= F.length("p"))
    made = F.flatten(F.transform(sizes, lambda n: F.transform(F.sequence(F.lit(1), F.length("p") - n + 1), lambda i: F.substring(F.col("p"), i, n))))
    own = F.when(F.length("p") < low, F.array("p")).otherwise(made)
    return words.select(key, "n", F.explode(own).alias("gram")).groupBy(key, "gram").agg(F.sum("n").alias("tf"))


def bm25_texts(docs: DataFrame, key: str, query: str, text: str = "text") -> DataFrame:
    """bm25() straight from texts, in one pass over them; of a document only its length and its counts of asked terms are written."""
    asked = {r.term: r.qf for r in terms(docs.sparkSession, query).collect()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds: list[pa.DataType] = []
        rows: list[tuple] = []

        def made() -> pa.RecordBatch:
            keys, lengths, hits = zip(*rows, strict=True)
            return pa.RecordBatch.from_arrays([pa.array(keys, kinds[0]), pa.array(lengths, pa.int64()), pa.array(hits, pa.map_(pa.string(), pa.int64()))], names=[key, "length", "hits"])

        for own, tf in _term_counts(kept_kind(batches, kinds)):
            rows.append((own, sum(tf.values()), [(t, tf[t]) for t in asked if t in tf]))
            if len(rows) >= BATCH_ROWS:
                yield made()
                rows = []
        if rows:
            yield made()

    base = durable(_lowered(docs, key, text).mapInArrow(run, _with_key(docs, key, "length long, hits map<string,bigint>")))
    whole = base.agg(F.count("*").alias("n"), F.avg("length").alias("mean")).first()
    hits = base.select(key, "length", F.explode("hits").alias("term", "tf"))
    df = {r.term: r.df for r in hits.groupBy("term").agg(F.count("*").alias("df")).collect()}  # a row for each asked term
    weights = F.create_map(*[F.lit(x) for t, d in sorted(df.items()) for x in (t, float(asked[t] * math.log(1 + (whole.n - d + 0.5) / (d + 0.5))))]) if df else None
    part = F.lit(0.0) if weights is None else weights[F.col("term")] * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("length") / F.lit(whole["mean"])))
    return hits.groupBy(key).agg(F.sum(part).alias("bm25"))


def char_tfidf(docs: DataFrame, key: str, query: str, text: str = "text") -> DataFrame:
    """key, cosine of sublinear tf-idf vectors of character n-grams, for documents that share one with query; documents' grams are never written."""
    own = char_grams(docs.sparkSession.createDataFrame([(0, query)], "q int, text string"), "q")
    return char_vectors.cosines(docs, key, {r.gram: r.tf for r in own.collect()}, text)  # one query's grams


def dense_cosine(vectors: DataFrame, key: str, vector: str, query: list[float]) -> DataFrame:
    """key, cosine to one query vector; zero and null vectors and those of another length have none."""
    q = F.array(*[F.lit(float(x)) for x in query])
    dot = lambda a, b: F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)
    v = F.col(vector).cast("array<double>")
    rows = vectors.select(key, v.alias("v")).where(F.size("v") == len(query))
    norm = F.sqrt(dot(F.col("v"), F.col("v")))
    return rows.select(key, (dot(F.col("v"), q) / F.nullif(norm * F.sqrt(dot(q, q)), F.lit(0.0))).alias("cosine")).where("cosine is not null")


def placed(frame: DataFrame, key: str, score: str) -> DataFrame:
    """key, place: ranks by score (largest first, then smaller keys) of all rows, counted over sorted ranges."""
    own = running(frame.select(key, score), [F.col(score).desc(), key], {"before": F.lit(1)})
    return own.select(key, (F.col("before") + 1).alias("place"))


def fused(signals: dict[str, DataFrame], key: str, limit: int = 10, least_signals: int = 1) -> DataFrame:
    """key, rrf, signals, places, rank from frames (key, score) by signal: all scores over 0 count; ties go to smaller keys.

    places maps each signal that has the document to the document's rank in it.
    """
    parts = None
    for name, frame in signals.items():
        score = next(c for c in frame.columns if c != key)
        own = placed(durable(frame.where(F.col(score) > 0).select(key, score)), key, score).withColumn("signal", F.lit(name))
        parts = own if parts is None else parts.unionByName(own)
    places = F.map_from_entries(F.array_sort(F.collect_list(F.struct("signal", "place"))))  # one for each signal
    out = parts.groupBy(key).agg(F.sum(1 / (RRF + F.col("place"))).alias("rrf"), places.alias("places")).withColumn("signals", F.map_keys("places")).where(F.size("signals") >= least_signals)
    return out.orderBy(F.round("rrf", 12).desc(), key).limit(limit).withColumn("rank", F.row_number().over(Window.orderBy(F.round("rrf", 12).desc(), key)))  # sums in another order differ in the last bits


CHUNKS = "doc_key string, chunk_id string, ordinal int, text string, start_char int, end_char int, heading_path array<string>, kind string, oversized boolean"
_ARROW = {"string": pa.string(), "int": pa.int32(), "array<string>": pa.list_(pa.string()), "boolean": pa.bool_()}
CHUNK_KINDS = pa.schema([(name, _ARROW[kind]) for name, kind in map(str.split, CHUNKS.split(", "))])
HEADING, ROW, SENTENCE = re.compile(r"^(#{1,6})\s+(.*)$"), re.compile(r"^\s*\|.*\|\s*$"), re.compile(r"(?<=[.!?])\s+")


def chunk_id(doc: Column, ordinal: Column, text: Column) -> Column:
    return F.substring(F.sha2(F.concat_ws(":", doc, ordinal.cast("string"), text), 256), 1, 16)


def _units(text: str) -> Iterator[tuple[str, int, int, tuple[str, ...], str]]:
    """(text, start, end, heading path, kind) of a document's paragraphs, tables and code blocks."""
    trail: list[str] = []
    lines: list[str] = []
    start, at, kind = 0, 0, ""

    def close(end: int):
        nonlocal lines, kind
        body = "\n".join(lines).strip()
        lines, was, kind = [], kind, ""
        return [(body, start, end, tuple(trail), was)] if body else []

    for raw in text.splitlines(keepends=True):
        line, begin = raw.rstrip("\n"), at
        at += len(raw)
        fence = line.strip().startswith("```")
        if kind == "code":
            lines.append(line)
            if fence:
                yield from close(at)
                start = at
            continue
        now = "code" if fence else "heading" if HEADING.match(line) else "table" if ROW.match(line) else "prose" if line.strip() else "blank"
        if now in ("heading", "blank") or lines and now != kind:
            yield from close(begin)
        if now == "heading":
            marks, title = HEADING.match(line).groups()
            trail[len(marks) - 1 :] = [title.strip()]
        if now in ("heading", "blank"):
            continue
        if not lines:
            start, kind = begin, now
        lines.append(line)
    yield from close(at)


def _pieces(text: str, kind: str, size: int, overlap: int) -> Iterator[tuple[str, bool]]:
    """Parts of at most size characters: of tables and code by lines, of prose by sentences with an overlap. The flag marks forced cuts."""
    if len(text) <= size:
        yield text, False
        return
    by_line = kind in ("table", "code")
    held = ""
    for part in text.splitlines() if by_line else SENTENCE.split(text):
        if not by_line and len(part) > size:
            if held:
                yield held.strip(), False
            held = ""
            yield from ((part[i : i + size], True) for i in range(0, len(part), size))
            continue
        glue = "\n" if by_line else " "
        if held and len(held) + len(part) + (not by_line) > size:
            yield held if by_line else held.strip(), by_line
            held = part if by_line or not overlap else held[-overlap:] + " " + part
        else:
            held = held + glue + part if held else part
    if held.strip():
        yield held if by_line else held.strip(), by_line


def chunks_of(doc: str, text: str, size: int = 1200, overlap: int = 150, least: int = 80) -> Iterator[tuple]:
    """Chunks of one document: units are gathered up to size, never across a change of heading."""
    if size < least or overlap >= size:
        raise ValueError("size must be at least the minimum, and more than the overlap")
    groups: list[list] = []
    for unit in _units(text):
        group = groups[-1] if groups else None
        if group is None or group[-1][3] != unit[3] or sum(len(u[0]) + 2 for u in group) + len(unit[0]) > size:
            groups.append([unit])
        else:
            group.append(unit)
    ordinal = 0
    for group in groups:
        kinds = {u[4] for u in group}
        kind = kinds.pop() if len(kinds) == 1 else "prose"
        for piece, forced in _pieces("\n\n".join(u[0] for u in group), kind, size, overlap):
            if piece.strip():
                own = hashlib.sha256(f"{doc}:{ordinal}:{piece}".encode()).hexdigest()[:16]
                yield doc, own, ordinal, piece, group[0][1], group[-1][2], list(group[0][3]), kind, forced
                ordinal += 1


def chunk_batches(batches: Iterator[pa.RecordBatch], **options) -> Iterator[pa.RecordBatch]:
    """Chunks of rows (doc_key, body) in batches of BATCH_CHARS characters or little more, whatever the size of those that come in."""
    rows, held = [], 0

    def made() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*rows, strict=True), CHUNK_KINDS, strict=True)], schema=CHUNK_KINDS)

    for batch in slices(batches):
        for doc, body in zip(batch.column(0), batch.column(1), strict=True):
            for row in chunks_of(str(doc.as_py()), body.as_py() or "", **options):
                rows.append(row)
                held += len(row[3])
                if held >= BATCH_CHARS:
                    yield made()
                    rows, held = [], 0
    if rows:
        yield made()


def chunked(docs: DataFrame, key: str, text: str = "text", **options) -> DataFrame:
    """One row for each chunk of each document; null and empty texts have none."""
    rows = docs.select(F.col(key).cast("string").alias("doc_key"), F.col(text).alias("body"))
    return rows.mapInArrow(lambda batches: chunk_batches(batches, **options), CHUNKS)
