"""Suffix-array dedup: removal of repeated passages by distributed prefix doubling.

A passage of `length` bytes that starts in two places is found by ranking what starts where, for growing prefixes, until a
rank is unique or the prefix is past the threshold. Ranking every byte's suffix would move many times the text, so only
anchors are ranked: in each window of `length` bytes the place of its least `seed`-gram hash. Equal windows have equal
anchors at equal offsets, and a run of windows shares one anchor; no repeated window is missed.

A row is an anchor with a block of offsets, that is of windows around it. All of them hold one core of bytes; the row's
extent is all their bytes. Spark sorts the rows' pairs (rank of the core so far, name of the bytes it grows by) over ranges; a
pair's place in that order is the new rank. A unique pair ends the row, since none of its windows occurs elsewhere; an
extent held twice settles all of its windows as repeated. What is neither goes on, one row for each extent, in smaller
blocks whose cores are twice as long, and past half of the threshold in quarters, until cores are whole windows. As the
places where a core grows are no anchors, the second half of a pair is a hash of its bytes and not a rank of its own.

The same runs over words: a text is then the row of its words' 8-byte hashes, places are words, and a passage counts if
another text holds it. What it finds is reported beside what is removed; it removes nothing.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenta.llm.common import bounds, scratch, slices, small, table

LENGTH, SEED_BYTES, SPLIT = 400, 128, 4
#: Passages of over 50 words, whatever their bytes.
WORDS, SEED_WORDS, SPLIT_WORDS = 51, 16, 20
#: Bytes of text that are hashed in one pass; longer texts are passes of their own.
PASS_BYTES = 1 << 21
#: Contexts that a worker holds before it sends them; a text that repeats itself has many.
CONTEXTS = 1 << 14
_BASE, _MIX = 0x9E3779B97F4A7C15 | 1, np.uint64(0xBF58476D1CE4E5B9)


@lru_cache(maxsize=1)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    with np.errstate(over="ignore"):
        up, down = np.full(n, _BASE, np.uint64), np.full(n, pow(_BASE, -1, 1 << 64), np.uint64)
        up[0] = down[0] = 1
        return np.cumprod(up, dtype=np.uint64), np.cumprod(down, dtype=np.uint64)


def _sums(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    up, down = _powers(1 << max(21, int(len(data)).bit_length()))
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(data.astype(np.uint64, copy=False) * up[: len(data)], out=sums[1:])
    return sums, down


def _mixed(h: np.ndarray) -> np.ndarray:
    h ^= h >> np.uint64(31)
    h *= _MIX
    return h


def gram_keys(data: np.ndarray, k: int) -> np.ndarray:
    """For each k-gram its hash in the upper 32 bits and its place in the lower ones."""
    sums, down = _sums(data)
    h = _mixed((sums[k:] - sums[:-k]) * down[: len(data) - k + 1])
    return (h & np.uint64(0xFFFFFFFF00000000)) | np.arange(len(h), dtype=np.uint64)


def window_minima(keys: np.ndarray, w: int) -> np.ndarray:
    """The least of each w keys in a row."""
    n = len(keys)
    full = np.full(-(-n // w) * w, np.uint64(0xFFFFFFFFFFFFFFFF))
    full[:n] = keys
    rows = full.reshape(-1, w)
    ahead = np.minimum.accumulate(rows, axis=1).ravel()
    back = np.minimum.accumulate(rows[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(back[: n - w + 1], ahead[w - 1 : n])


def passes(texts: list[bytes]) -> Iterator[tuple[int, list[bytes]]]:
    """(first text's number, texts) of each pass."""
    first, held, total = 0, [], 0
    for k in range(len(texts) + 1):
        if k == len(texts) or held and total + len(texts[k]) > PASS_BYTES:
            yield first, held
            first, held, total = k, [], 0
        if k < len(texts):
            held.append(texts[k])
            total += len(texts[k])


def runs(texts: list[bytes], length: int, seed: int) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """(text's number, first windows, last windows, anchors) for each text that has windows; places within the text."""
    for first, held in passes(texts):
        if sum(map(len, held)) >= length:
            yield from _runs(first, held, length, seed)


def _runs(first: int, texts: list[bytes], length: int, seed: int):
    sizes = np.fromiter(map(len, texts), np.int64, len(texts))
    ends = np.cumsum(sizes)
    use = np.flatnonzero(sizes >= length)
    if not len(use):
        return
    anchor = (window_minima(gram_keys(np.frombuffer(b"".join(texts), np.uint8), seed), length - seed + 1) & np.uint64(0xFFFFFFFF)).astype(np.int64)
    for i in use.tolist():
        start = int(ends[i] - sizes[i])
        own = anchor[start : int(ends[i]) - length + 1] - start
        at = bounds(own)
        yield first + i, at[:-1], at[1:] - 1, own[at[:-1]]


def _pair(data: bytes) -> tuple[int, int]:
    h = xxhash.xxh3_128_intdigest(data)
    return (h >> 64) - (1 << 63), (h & ((1 << 64) - 1)) - (1 << 63)


def _name(data: bytes, place: int = 0) -> int:
    return xxhash.xxh3_64_intdigest(data, place) - (1 << 63)


#: A row: the rank of its core so far and the name of what it grows by (no name: settled); its extent's hashes; its text
#: (k1, k2), anchor, and first and last offset of its windows before the anchor; its block's first and last offset.
OCC = ["k1", "k2", "anchor", "low", "high"]
PAIR = "rank long, name long, e1 long, e2 long, k1 long, k2 long, anchor long, low int, high int, b0 int, b1 int"
_KINDS = [pa.int64()] * 7 + [pa.int32()] * 4
_NAMES = ["rank", "name", "e1", "e2", *OCC, "b0", "b1"]


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    columns = zip(*rows, strict=True) if rows else [()] * len(_KINDS)
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, _KINDS, strict=True)], names=_NAMES)


def first_pairs(texts: DataFrame, length: int, seed: int) -> DataFrame:
    """The first rows of texts (k1, k2, text binary). Where one text repeats an extent more than twice, the rest is settled at once: rows without a name."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            k1, k2, data = (c.to_pylist() for c in batch.columns)
            data = [t or b"" for t in data]
            rows: list[tuple] = []
            for i, firsts, lasts, anchors in runs(data, length, seed):
                text, seen = data[i], {}
                for p, q, a in zip(firsts.tolist(), lasts.tolist(), anchors.tolist(), strict=True):
                    e = _pair(text[p : q + length])
                    seen[e] = n = seen.get(e, 0) + 1
                    if n <= 2:
                        rows.append((0, _name(text[a : a + seed]), *e, k1[i], k2[i], a, a - q, a - p, 0, length - seed))
                    elif rows[-1][1] is None and rows[-1][4:6] == (k1[i], k2[i]) and rows[-1][6] - rows[-1][7] + 1 == p and q - rows[-1][6] + rows[-1][8] < 1 << 30:
                        a0, _, high = rows[-1][6:9]
                        rows[-1] = (0, None, 0, 0, k1[i], k2[i], a0, a0 - q, high, 0, 0)
                    else:
                        rows.append((0, None, 0, 0, k1[i], k2[i], a, a - q, a - p, 0, 0))
            yield _batch(rows)

    return texts.mapInArrow(run, PAIR)


class _WordIds(dict):
    """The hash of each word; a bounded number is held."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= 1 << 17:
            self.clear()
        self[word] = h = xxhash.xxh3_64_intdigest(word)
        return h

    def of(self, text: bytes) -> np.ndarray:
        words = text.split()
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


def word_pairs(texts: DataFrame, length: int, seed: int) -> DataFrame:
    """The first rows of texts as rows of words. Places, length and seed count words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids = _WordIds()
        for batch in slices(batches):
            k1, k2 = (batch.column(i).to_numpy() for i in (0, 1))
            for first, held in passes([t or b"" for t in batch.column(2).to_pylist()]):
                own = [ids.of(t) for t in held]
                sizes = np.fromiter(map(len, own), np.int64, len(own))
                if sizes.sum() < length:
                    continue
                words, text = np.concatenate(own), np.repeat(np.arange(len(own)), sizes)
                anchors = (window_minima(gram_keys(words, seed), length - seed + 1) & np.uint64(0xFFFFFFFF)).astype(np.int64)
                windows = np.flatnonzero(text[: len(words) - length + 1] == text[length - 1 :])
                if not len(windows):
                    continue
                # an anchor lies in its windows, so all of them are of one text
                at = bounds(anchors[windows])
                p, q, a = windows[at[:-1]], windows[at[1:] - 1], anchors[windows[at[:-1]]]
                sums, down = _sums(words)
                name, e1 = _mixed((sums[a + seed] - sums[a]) * down[a]), _mixed((sums[q + length] - sums[p]) * down[p])
                sums, down = _sums(_mixed(words))
                e2, t = _mixed((sums[q + length] - sums[p]) * down[p]), text[p]
                columns = [name.view(np.int64), e1.view(np.int64), e2.view(np.int64), k1[first + t], k2[first + t], a - (np.cumsum(sizes) - sizes)[t], (a - q).astype(np.int32), (a - p).astype(np.int32)]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=_NAMES[1:9])

    rows = texts.mapInArrow(run, "name long, e1 long, e2 long, k1 long, k2 long, anchor long, low int, high int")
    return rows.select(F.lit(0).cast("long").alias("rank"), "*", F.lit(0).alias("b0"), F.lit(length - seed).alias("b1"))


def next_pairs(contexts: DataFrame, length: int, block: int, unit: int = 1) -> DataFrame:
    """The rows of the next round, from rows with their context text[anchor - high : anchor - low + length]: blocks are cut into smaller ones.

    A place has unit bytes.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[tuple] = []
            for k1, k2, a, low, high, rank, b0, b1, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                for j in range((low - b0) // block, (high - b0) // block + 1):
                    c0 = b0 + j * block
                    c1 = min(c0 + block - 1, b1)
                    x, y = max(low, c0), min(high, c1)
                    grown = text[(high - c0) * unit : (high - b0) * unit] + text[(high - b1 + length) * unit : (high - c1 + length) * unit]  # before and after the core
                    rows.append((rank, _name(grown, j), *_pair(text[(high - y) * unit : (high - x + length) * unit]), k1, k2, a, x, y, c0, c1))
            yield _batch(rows)

    return contexts.mapInArrow(run, PAIR)


def ranked(pairs: DataFrame, across: bool = False) -> tuple[DataFrame, DataFrame]:
    """Settled rows, and one row with its new rank for each extent of a tied pair that has several.

    Pairs are counted first (sums leave the map side), so that only tied ones are sorted and go any further. With across,
    pairs are tied and extents settled by several texts only; two rows go on for a settled extent, and all of another one.
    """
    e = F.xxhash64("e1", "e2")
    count = F.when(F.min("k1") != F.max("k1"), 2).otherwise(1) if across else F.count("*")
    tied = pairs.where("name is not null").groupBy("rank", "name").agg(count.alias("n"), F.min(e).alias("a"), F.max(e).alias("b")).where("n > 1")
    order = tied.repartitionByRange("rank", "name").sortWithinPartitions("rank", "name")
    order = table(order.select("rank", "name", (F.col("a") != F.col("b")).alias("several"), F.monotonically_increasing_id().alias("next")))
    shared = table(pairs.join(small(order, order.count(), 25), ["rank", "name"]).drop("rank", "name"))
    occ = F.struct(*OCC)
    extents = table(shared.groupBy("next", "e1", "e2", "several", "b0", "b1").agg(F.min(occ).alias("o"), F.max(occ).alias("p")))
    repeats = F.expr("o.k1 <> p.k1 or o.k2 <> p.k2" if across else "o <> p")
    twice = extents.where(repeats).select("next", "e1", "e2")
    held = small(twice, twice.count(), 24)
    settled = shared.select("next", "e1", "e2", *OCC).join(held, ["next", "e1", "e2"]).select(*OCC)
    rest = [F.col("next").alias("rank"), "b0", "b1"]
    if not across:
        return settled, extents.where("several").select("o.*", *rest)
    # two texts stand for a settled extent, so that each of them meets another one
    two = extents.where("several").where(repeats).select(F.explode(F.array("o", "p")).alias("o"), *rest).select("o.*", "rank", "b0", "b1")
    return settled, two.unionByName(shared.where("several").join(held, ["next", "e1", "e2"], "left_anti").select(*OCC, *rest))


_LIVE = [*OCC, "rank", "b0", "b1"]


def contexts_of(texts: DataFrame, pairs: DataFrame, length: int, unit: int = 1) -> DataFrame:
    """pairs with the bytes of their windows, cut from texts (k1, k2, text) at most once for each text; where a place has 8 bytes, with its words' hashes."""
    inner = _LIVE[2:]
    own = pairs.groupBy("k1", "k2").agg(F.collect_list(F.struct(*inner)).alias("own"))  # as many as the text has
    kinds = {"anchor": pa.int64(), "rank": pa.int64()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids = _WordIds()
        types = (pa.int64(), pa.int64(), *(kinds.get(c, pa.int32()) for c in inner), pa.binary())
        made = lambda rows: pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], kind) for i, kind in enumerate(types)], names=[*_LIVE, "context"])
        for batch in slices(batches):
            rows = []
            for k1, k2, text, own in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                text = text if unit == 1 else ids.of(text).tobytes()
                for x in own:
                    rows.append((k1, k2, *(x[c] for c in inner), text[(x["anchor"] - x["high"]) * unit : (x["anchor"] - x["low"] + length) * unit]))
                    if len(rows) == CONTEXTS:
                        yield made(rows)
                        rows = []
            yield made(rows)

    schema = "k1 long, k2 long, " + ", ".join(f"{c} {'long' if c in kinds else 'int'}" for c in inner) + ", context binary"
    return texts.join(small(own, pairs.count(), 48), ["k1", "k2"]).select("k1", "k2", "text", "own").mapInArrow(run, schema).dropDuplicates(OCC)


def repeated(texts: DataFrame, length: int = LENGTH, seed: int = SEED_BYTES, split: int = SPLIT, words: bool = False) -> DataFrame:
    """(k1, k2, spans): for each text of texts (k1, k2, text; no text twice) the first and last windows that start elsewhere too.

    With words, places are words instead of bytes, and the windows are those that another text holds.
    """
    seed = min(seed, length)
    core, unit = seed, 8 if words else 1
    # rows of words are made twice and never written: most of them end here
    pairs = word_pairs(texts, length, seed) if words else table(first_pairs(texts, length, seed))
    done = [] if words else [pairs.where("name is null").select(*OCC)]
    settled, live = ranked(pairs, words)
    done.append(settled)
    contexts = table(contexts_of(texts, live, length, unit)) if core < length else None
    while core < length:
        core = 2 * core if 2 * core < length else length + 1 - -(-(length - core + 1) // split)
        pairs = table(next_pairs(contexts, length, length - core + 1, unit))
        settled, live = ranked(pairs, words)
        done.append(settled)
        if core == length or not live.limit(1).count():
            break
        # the next round's bytes lie within this round's
        outer = contexts.select("k1", "k2", "anchor", F.col("low").alias("l"), F.col("high").alias("h"), "context")
        inner = live.join(outer, ["k1", "k2", "anchor"]).where("low >= l and high <= h")
        cut = F.col("context").substr((F.col("h") - F.col("high")) * unit + 1, (F.col("high") - F.col("low") + length) * unit)
        contexts = table(inner.select(*_LIVE, cut.alias("context")))
    every = done[0]
    for x in done[1:]:
        every = every.unionByName(x)
    return every.groupBy("k1", "k2").agg(F.collect_set(F.struct((F.col("anchor") - F.col("high")).alias("a"), (F.col("anchor") - F.col("low")).alias("b"))).alias("spans"))


def cover(spans: list[tuple[int, int]], length: int) -> list[tuple[int, int]]:
    """Maximal runs of bytes under windows from first to last places."""
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], b + length))
        else:
            out.append((a, b + length))
    return out


def shared_words(texts: DataFrame, words: int = WORDS, seed: int = SEED_WORDS, split: int = SPLIT_WORDS) -> DataFrame:
    """(k1, k2, shared): for the texts of texts (k1, k2, text; no text twice) that share passages of that many words or more with others, alternating starts and ends, in words, of the passages."""
    kinds = [pa.int64(), pa.int64(), pa.list_(pa.int64())]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            k1, k2, spans = (c.to_pylist() for c in batch.columns)
            shared = [[y for g in cover([(s["a"], s["b"]) for s in own], words) for y in g] for own in spans]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip((k1, k2, shared), kinds, strict=True)], names=["k1", "k2", "shared"])

    held = texts.where(F.length("text") >= 2 * words - 1)  # so many bytes have that many words
    return repeated(held, words, seed, split, words=True).mapInArrow(run, "k1 long, k2 long, shared array<long>")


def removals(docs: DataFrame, length: int = LENGTH, words: int = WORDS, word_options: dict | None = None, **options) -> DataFrame:
    """For each row of docs (doc_id, text): doc_id, n_bytes, kept (binary), spans (alternating starts and ends, in bytes, of what goes) and shared (those, in words, of passages of that many words or more that another row holds).

    Texts are bytes; null and empty ones, and those shorter than length, lose nothing. Matches don't cross rows. Rows with
    equal texts of length bytes or more repeat each other and lose everything; one of them stands for all against the rest.
    Passages that are shared stay, unless their bytes go.
    """
    text = F.coalesce(F.col("text").cast("binary"), F.lit(b""))
    least = min(length, 2 * words - 1)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text")).withColumns({"k1": F.xxhash64("text"), "k2": F.xxhash64(F.lit("second"), "text")})
    copies = table(rows.where(F.length("text") >= least).groupBy("k1", "k2").agg(F.count("*").alias("n"), F.min("doc_id").alias("one")).where("n > 1"))
    marked = small(copies.select("k1", "k2", "one", F.lit(True).alias("copied")), copies.count(), 32)
    joined = rows.where(F.length("text") >= least).join(marked, ["k1", "k2"], "left")
    texts = joined.where("copied is null or doc_id <=> one").select("k1", "k2", "text")
    with scratch(docs.sparkSession):
        shared = table(shared_words(texts, words, **word_options or {}), lasting=True)
    found = table(repeated(texts.where(F.length("text") >= length), length, **options).join(shared, ["k1", "k2"], "full"))
    size = found.agg(F.sum((F.greatest(F.size("spans"), F.lit(0)) + F.greatest(F.size("shared"), F.lit(0))) * 16 + 32)).first()[0] or 0

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            out: list[list] = [[], [], [], []]
            for data, copied, spans, shared in zip(*(c.to_pylist() for c in batch.columns[1:]), strict=True):
                gone = [(0, len(data))] if copied and len(data) >= length else cover([(s["a"], s["b"]) for s in spans or ()], length)
                if copied:
                    shared = [0, n] if (n := len(data.split())) >= words else []
                kept, at = [], 0
                for a, b in gone:
                    kept.append(data[at:a])
                    at = b
                kept.append(data[at:])
                for to, x in zip(out, (len(data), b"".join(kept), [y for g in gone for y in g], shared or []), strict=True):
                    to.append(x)
            kinds = (pa.int64(), pa.binary(), pa.list_(pa.int64()), pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(x, k) for x, k in zip(out, kinds, strict=True))], names=["doc_id", "n_bytes", "kept", "spans", "shared"])

    final = rows.join(small(found, size, 1), ["k1", "k2"], "left").join(marked.drop("one"), ["k1", "k2"], "left")
    return final.select("doc_id", "text", "copied", "spans", "shared").mapInArrow(run, "doc_id long, n_bytes long, kept binary, spans array<long>, shared array<long>")


def report(docs: DataFrame, length: int = LENGTH, words: int = WORDS, **options) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 for each row of docs; then what stays: its bytes, its characters, and its text; and the words, and the number, of passages of that many words or more that another row holds too.

    Bytes go, so a character that is cut in two leaves a replacement character in the text (the digest is of the bytes).
    """
    out = removals(docs, length, words, **options)
    inside = lambda c: F.aggregate(c, F.lit(0).cast("long"), lambda s, x: x - s, lambda s: s)  # noqa: E731 ends less starts: (e - (s - sum))
    number = lambda c: (F.size(c) / 2).cast("long")
    text = F.make_valid_utf8(F.col("kept").cast("string"))
    kept = [F.sha2("kept", 256).alias("kept_sha256"), F.length("kept").cast("long").alias("n_kept"), F.length(text).cast("long").alias("n_kept_chars"), text.alias("kept_text")]
    return out.select("doc_id", "n_bytes", inside("spans").alias("n_removed"), number("spans").alias("n_spans"), *kept, inside("shared").alias("n_shared_words"), number("shared").alias("n_shared_passages"))
