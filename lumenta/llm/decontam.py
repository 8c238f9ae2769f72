"""Benchmark decontamination by suffix arrays over training shards.

The documents of a partition are cut into shards of bounded size. Each shard's words get a suffix array (prefix doubling,
sorted down to the length that is searched), and every suffix of the test set is binary-searched in it. All hits have
places, so the words they cover, the items they come from and the documents to remove follow from one pass over the
documents, without a shuffle. The test set is read in blocks of bounded size; every block passes over all documents.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenta.llm.common import fresh, slices, widened

#: Words of documents in a shard, and words of the test set in a block.
SHARD_WORDS, BLOCK_WORDS = 1 << 19, 1 << 20
#: A-Z lower-cased; digits, letters and bytes of other scripts are words, all else parts them.
FOLD = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def words(text: bytes | None) -> list[bytes]:
    return text.translate(FOLD).split() if text else []


def suffix_array(ids: np.ndarray, depth: int) -> np.ndarray:
    """Places of the positive ids, sorted by what follows them, at least down to depth ids. 0 ends a text."""
    places = np.flatnonzero(ids)
    if not len(places):
        return places
    order = np.argsort(ids[places], kind="stable")
    sa, first = places[order], ids[places][order]
    rank = np.zeros(2 * len(ids) + 1, np.int64)  # of a place: where its group starts in the array, from 1; 0 past an end
    new = np.concatenate(([True], first[1:] != first[:-1]))
    starts = np.flatnonzero(new)
    group = starts[np.cumsum(new) - 1]
    rank[sa] = group + 1
    step = 1
    while step < depth:
        sizes = np.diff(np.concatenate((starts, [len(sa)])))
        tied = np.flatnonzero(np.repeat(sizes > 1, sizes))
        if not len(tied):
            break
        at = sa[tied]
        pair = (rank[at] << 32) | rank[np.minimum(at + step, len(rank) - 1)]
        order = np.argsort(pair, kind="stable")
        sa[tied], pair = at[order], pair[order]
        fresh = np.concatenate(([True], pair[1:] != pair[:-1]))
        new[tied] |= fresh
        starts = np.flatnonzero(new)
        group = starts[np.cumsum(new) - 1]
        rank[sa[tied]] = group[tied] + 1
        step *= 2
    return sa


def _order(ids: np.ndarray, at: np.ndarray, tests: np.ndarray, start: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sign of suffix against test over length ids, and how many ids they share."""
    sign, shared = np.zeros(len(at), np.int8), np.zeros(len(at), np.int64)
    open_, j = np.arange(len(at)), 0
    while len(open_ := open_[length[open_] > j]):
        x = at[open_] + j
        a, b = np.where(x < len(ids), ids[np.minimum(x, len(ids) - 1)], 0), tests[start[open_] + j]
        sign[open_] = np.sign(a - b)
        open_ = open_[a == b]
        j += 1
        shared[open_] = j
    return sign, shared


def search(ids: np.ndarray, sa: np.ndarray, tests: np.ndarray, start: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each test (length ids from start) the range of the suffix array that begins with it."""

    def edge(after: bool) -> np.ndarray:
        lo, hi = np.zeros(len(start), np.int64), np.full(len(start), len(sa), np.int64)
        while len(open_ := np.flatnonzero(lo < hi)):
            mid = (lo[open_] + hi[open_]) // 2
            sign, _ = _order(ids, sa[mid], tests, start[open_], length[open_])
            right = sign <= 0 if after else sign < 0
            lo[open_[right]] = mid[right] + 1
            hi[open_[~right]] = mid[~right]
        return lo

    return edge(False), edge(True)


class Tests:
    """A block of items as ids of their own words: ids with 0 after each item, and the windows' starts and lengths.

    Equal windows are one: item holds the items of all windows in turn, from edge[w] to edge[w + 1] those of window w.
    """

    def __init__(self, items: list[tuple[str | None, list[bytes]]], n: int):
        self.ids_of: dict[bytes, int] = {}
        self.names = [name for name, _ in items]
        ids, first, size, windows = [], [], [], {}
        for k, (_, words_) in enumerate(items):
            first.append(len(ids))
            size.append(len(words_))
            own = [self.ids_of.setdefault(w, len(self.ids_of) + 1) for w in words_]
            for s in range(max(1, len(own) - n + 1) if own else 0):
                windows.setdefault(tuple(own[s : s + n]), (len(ids) + s, []))[1].append(k)
            ids += [*own, 0]
        held = [sorted(set(own)) for _, own in windows.values()]
        self.ids, self.first, self.size = np.array(ids, np.int64), np.array(first, np.int64), np.array(size, np.int64)
        self.start, self.length = np.array([s for s, _ in windows.values()], np.int64), np.array([len(w) for w in windows], np.int64)
        self.item, self.edge = np.array([k for own in held for k in own], np.int64), np.cumsum([0, *map(len, held)])


def blocks(benchmark: DataFrame, n: int, limit: int = BLOCK_WORDS) -> Iterator[Tests]:
    """The test set in blocks of about limit words each, read partition by partition. Repeated rows are read once."""
    held, total = [], 0
    for row in benchmark.select(F.col("item_id").cast("string").alias("i"), F.col("text").cast("binary").alias("t")).distinct().toLocalIterator():
        own = words(bytes(row.t) if row.t is not None else None)
        if total and total + len(own) > limit:
            yield Tests(held, n)
            held, total = [], 0
        held.append((row.i, own))
        total += len(own)
    yield Tests(held, n)


def shards(texts: list[bytes | None], ids_of: dict[bytes, int], limit: int = SHARD_WORDS) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, word ids with a 0 after each text, starts of texts and the length) for runs of texts; one text is never cut."""
    first, parts, sizes, total = 0, [], [], 0
    for k, text in enumerate(texts):
        own = words(text)
        if parts and total + len(own) > limit:
            yield first, np.concatenate(parts), np.cumsum([0, *sizes])
            first, parts, sizes, total = k, [], [], 0
        parts.append(np.fromiter(map(ids_of.get, own, repeat(0)), np.int64, len(own)))
        parts.append(np.zeros(1, np.int64))
        sizes.append(len(own) + 1)
        total += len(own)
    if parts:
        yield first, np.concatenate(parts), np.cumsum([0, *sizes])


def _spread(lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each range's number and each of its members."""
    sizes = hi - lo
    of = np.repeat(np.arange(len(lo)), sizes)
    return of, np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes) + lo[of]


def hits(texts: list[bytes | None], tests: Tests) -> tuple[list[list[int]], list[list[str]]]:
    """For each text: the words inside any occurrence of a window, as alternating starts and ends, and the items that occur."""
    spans: list[list[int]] = [[] for _ in texts]
    items: list[list[str]] = [[] for _ in texts]
    if not len(tests.start):
        return spans, items
    depth = int(tests.length.max())
    for first, ids, edges in shards(texts, tests.ids_of):
        sa = suffix_array(ids, depth)
        lo, hi = search(ids, sa, tests.ids, tests.start, tests.length)
        window, place = _spread(lo, hi)
        if not len(window):
            continue
        at = sa[place]
        change = np.zeros(len(ids) + 1, np.int64)
        np.add.at(change, at, 1)
        np.add.at(change, at + tests.length[window], -1)
        inside = np.concatenate(([0], (np.cumsum(change[:-1]) > 0).astype(np.int8), [0]))
        turn = np.flatnonzero(np.diff(inside))
        doc = np.searchsorted(edges, turn[::2], "right") - 1
        for d, s, e in zip(doc.tolist(), turn[::2].tolist(), turn[1::2].tolist(), strict=True):
            spans[first + d] += [s - int(edges[d]), e - int(edges[d])]
        doc = np.searchsorted(edges, at, "right") - 1
        both = np.unique(doc * len(tests.start) + window)  # a window counts once in a text before its items are listed
        which, place = _spread(tests.edge[both % len(tests.start)], tests.edge[both % len(tests.start) + 1])
        for p in np.unique(both[which] // len(tests.start) * len(tests.names) + tests.item[place]).tolist():
            if (name := tests.names[p % len(tests.names)]) is not None:
                items[first + p // len(tests.names)].append(name)
    return spans, items


def union(spans: list[int]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for s, e in sorted(zip(spans[::2], spans[1::2], strict=True)):
        if out and s <= out[-1][1]:
            out[-1] = (out[-1][0], max(e, out[-1][1]))
        else:
            out.append((s, e))
    return out


def matched(docs: DataFrame, benchmark: DataFrame, n: int = 10) -> tuple[DataFrame, str, str]:
    """docs with the hit words (array of alternating starts and ends) and item ids of each row in two added columns, and their names.

    A window is n words in a row of one item; an item with fewer, but not none, is one window. Null and empty texts have
    no words; null item_ids cover words but can't be named; an empty test set hits nothing; repeated rows of docs are
    judged each on its own, and an item given twice counts once.
    """
    spans, items = fresh("__hit_spans", docs), fresh("__hit_items", docs)
    out = docs.withColumns({spans: F.array().cast("array<long>"), items: F.array().cast("array<string>")})
    for tests in blocks(benchmark, n):
        held = docs.sparkSession.sparkContext.broadcast(tests)  # at most BLOCK_WORDS words

        def more(texts: list, old_spans: list, old_items: list, held=held) -> list[list]:
            new = hits(texts, held.value)
            return [[a + b for a, b in zip(x, y, strict=True)] for x, y in zip((old_spans, old_items), new, strict=True)]

        out = widened(out, more, ["text", spans, items], [(spans, "array<long>"), (items, "array<string>")])
    return out, spans, items


def report(docs: DataFrame, benchmark: DataFrame, n: int = 10) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated, hit spans and item ids for each row of docs."""
    found, *hit = matched(docs.select("doc_id", "text"), benchmark, n)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, texts, spans, items = (batch.column(batch.schema.names.index(x)).to_pylist() for x in ("doc_id", "text", *hit))
            runs = [union(x) for x in spans]
            named = [sorted(set(x)) for x in items]
            n_hit = [sum(e - s for s, e in x) for x in runs]
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids, pa.int64()), pa.array([len(words(t)) for t in texts], pa.int64()), pa.array(n_hit, pa.int64()), pa.array([len(x) for x in named], pa.int64()), pa.array([hashlib.sha256(",".join(x).encode()).hexdigest() for x in named]), pa.array([x > 0 for x in n_hit]), pa.array([[y for z in x for y in z] for x in runs], pa.list_(pa.int64())), pa.array(named, pa.list_(pa.string()))],
                names=["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated", "hit_spans", "item_ids"],
            )

    return found.withColumns({"doc_id": F.col("doc_id").cast("long"), "text": F.col("text").cast("binary")}).mapInArrow(run, "doc_id long, n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean, hit_spans array<long>, item_ids array<string>")


def decontaminated(docs: DataFrame, benchmark: DataFrame, n: int = 10) -> DataFrame:
    """Rows of docs, with all their columns, that hold no window of the test set. Odd rows are judged as in matched()."""
    plain = [f"c{i}" for i in range(len(docs.columns))]  # names on the way, whatever characters the columns' own have
    place, out = docs.columns.index("text"), docs.toDF(*plain)
    for tests in blocks(benchmark, n):
        held = docs.sparkSession.sparkContext.broadcast(tests)  # at most BLOCK_WORDS words

        def clean(batches: Iterator[pa.RecordBatch], held=held) -> Iterator[pa.RecordBatch]:
            for batch in slices(batches):
                spans, _ = hits(batch.column(place).cast(pa.binary()).to_pylist(), held.value)
                yield batch.filter(pa.array([not x for x in spans], pa.bool_()))

        out = out.mapInArrow(clean, out.schema)
    return out.toDF(*docs.columns)


def longest_matches(docs: DataFrame, benchmark: DataFrame, least: int = 5) -> DataFrame:
    """The longest verbatim match of each item in each document that shares least or more words in a row.

    Rows: item_id, doc_id, item_start, doc_start (words), length; of equal lengths the first place in item and document.
    Every suffix of the test set is searched; its neighbours in a shard's suffix array share most words with it.
    """
    sc = docs.sparkSession.sparkContext
    rows, schema = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("binary").alias("text")), "item_id string, doc_id long, item_start long, doc_start long, length long"
    out = None
    for tests in blocks(benchmark, 1):
        held = sc.broadcast(tests)

        def run(batches: Iterator[pa.RecordBatch], held=held) -> Iterator[pa.RecordBatch]:
            t = held.value
            for batch in batches:
                ids_, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
                best: dict[tuple[int, int], tuple[int, int, int]] = {}
                for first, ids, edges in shards(texts, t.ids_of) if len(t.start) else ():
                    item = np.repeat(np.arange(len(t.size)), t.size)
                    start = np.arange(len(item)) + item  # a 0 follows each item
                    left = t.first[item] + t.size[item] - start
                    sa = suffix_array(ids, int(left.max()))
                    # matches of least words give the documents; each is then extended to its full length
                    use = np.flatnonzero(left >= least)
                    lo, hi = search(ids, sa, t.ids, start[use], np.full(len(use), least))
                    which, place = _spread(lo, hi)
                    at, s, own = sa[place], start[use][which], item[use][which]
                    _, shared = _order(ids, at, t.ids, s, left[use][which])
                    doc = np.searchsorted(edges, at, "right") - 1
                    for d, k, a, b, n in zip(doc.tolist(), own.tolist(), (s - t.first[own]).tolist(), (at - edges[doc]).tolist(), shared.tolist(), strict=True):
                        key, new = (first + d, k), (-n, a, b)
                        if key not in best or new < best[key]:
                            best[key] = new
                yield pa.RecordBatch.from_arrays([pa.array([f(k, v) for k, v in best.items()], kind) for f, kind in ((lambda k, v: t.names[k[1]], pa.string()), (lambda k, v: ids_[k[0]], pa.int64()), (lambda k, v: v[1], pa.int64()), (lambda k, v: v[2], pa.int64()), (lambda k, v: -v[0], pa.int64()))], names=["item_id", "doc_id", "item_start", "doc_start", "length"])

        found = rows.mapInArrow(run, schema)
        out = found if out is None else out.unionByName(found)
    return out
