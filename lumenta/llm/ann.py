"""Approximate nearest neighbours by collision counting over single projections.

The rows are dealt out in shards of bounded size. In a shard each random projection of the vectors is kept as one sorted
array. A query opens a window around its own projection in every array and widens all windows step by step (virtual
rehashing: a window of width w·R is a bucket at radius R, centred on the query). Narrow windows are walked; wide ones are
counted by comparing each vector's places in the arrays with the windows' ends, which costs less there. A vector that
lies in many windows at once collides often; windows widen until enough vectors pass the collision threshold, and of
those the ones that collide most are verified by their exact inner product. Each shard gives its best; the best of those
are the answer. The stated query set is searched against all rows, in blocks, so work grows with rows times queries.

Inner products are searched as distances: vectors get one more component that makes all of one length, queries a zero.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lumenta.llm.common import durable

#: Vectors in a shard, queries in a block, projections, share of them that must collide, share of a shard verified.
SHARD, QUERIES, PROJECTIONS, THRESHOLD, VERIFIED = 1 << 14, 1 << 12, 128, 0.6, 0.16
#: Vectors that a shard verifies at least, times k.
LEAST = 16
#: First half-width of windows in standard deviations of the projections, and the factor of each step.
FIRST, GROWTH = 0.6, 1.2


class SortedProjections:
    """A shard's index: vectors (n, d) with their ids and row numbers, and for each projection their order and sorted values."""

    def __init__(self, ids: np.ndarray, rows: np.ndarray, vectors: np.ndarray, projections: int = PROJECTIONS, seed: int = 7):
        # equal vectors are one entry: they share all windows and scores
        order = np.lexsort((rows, ids, *vectors.T[::-1])) if vectors.size else np.arange(len(ids))
        ids, self.rows, vectors = ids[order], rows[order], vectors[order]
        new = np.ones(len(ids), bool)
        new[1:] = (vectors[1:] != vectors[:-1]).any(axis=1)
        self.first = np.flatnonzero(new)
        self.last = np.append(self.first[1:], len(ids))
        self.ids, self.vectors = ids, vectors[self.first]
        squares = (self.vectors**2).sum(axis=1)
        self.length = np.sqrt(squares.max(initial=0.0))
        extra = np.sqrt(np.maximum(0.0, self.length**2 - squares))
        d = vectors.shape[1] + 1
        turn = np.random.default_rng(seed)
        blocks = [np.linalg.qr(turn.standard_normal((d, d)))[0] for _ in range(-(-projections // d))]
        self.axes = np.vstack(blocks)[:projections]
        values = np.hstack((self.vectors, extra[:, None])) @ self.axes.T
        # all sorted arrays lie in one, each shifted past the one before it, so that one search finds a window's end in all
        n = len(self.vectors)
        self.shift = 4 * (self.length or 1.0) * np.arange(len(self.axes))
        order = np.argsort(values, axis=0, kind="stable").T
        self.values = (np.take_along_axis(values.T, order, axis=1) + self.shift[:, None]).ravel()
        self.order = np.ascontiguousarray(order, np.intp).ravel()
        self.starts = np.arange(len(self.axes)) * n
        self.place = np.empty((len(self.axes), n), np.uint16 if n < 1 << 16 else np.uint32)
        np.put_along_axis(self.place, order, np.arange(n, dtype=self.place.dtype)[None, :], axis=1)
        self.step = 0
        self.scale = self.length / np.sqrt(d) or 1.0

    def collisions(self, centre: np.ndarray, reach: float) -> np.ndarray:
        """In how many windows of half-width reach each entry lies: narrow windows are walked, wide ones compared with the entries' places."""
        n = len(self.vectors)
        low = np.clip(self.values.searchsorted(centre - reach), self.starts, self.starts + n)
        high = np.clip(self.values.searchsorted(centre + reach, "right"), low, self.starts + n)
        width = high - low
        if width.sum() < len(self.values) >> 5:
            return np.bincount(np.concatenate([self.order[i:j] for i, j in zip(low.tolist(), high.tolist(), strict=True)]), minlength=n)
        first, width, counts = (low - self.starts).astype(self.place.dtype)[:, None], width.astype(self.place.dtype)[:, None], np.zeros(n, np.int32)
        for i in range(0, len(width), 16):  # places before a window wrap round to large numbers
            own = slice(i, i + 16)
            counts += (self.place[own] - first[own] < width[own]).view(np.uint8).sum(axis=0, dtype=np.uint8)
        return counts

    def candidates(self, query: np.ndarray, least: int, threshold: int) -> np.ndarray:
        """Entries in at least threshold windows, at a radius where there are least of them: those in the most windows, least at the least."""
        n = len(self.vectors)
        if n <= least:
            return np.arange(n)
        centre = self.axes[:, :-1] @ (query * (self.length / np.sqrt(query @ query))) + self.shift
        at = lambda step: self.collisions(centre, FIRST * self.scale * GROWTH**step)
        enough = lambda c: np.count_nonzero(c >= threshold) >= least
        # the first step with enough of them, looked for from where the last query's windows ended: wider windows only count more
        counts = at(self.step)
        if enough(counts):
            while self.step and enough(narrower := at(self.step - 1)):
                self.step, counts = self.step - 1, narrower
        else:
            while not enough(counts):
                self.step += 1
                counts = at(self.step)
        edge = np.partition(counts, n - least)[n - least]
        return np.flatnonzero(counts >= edge)

    def search(self, own: int, query: np.ndarray, k: int, threshold: float = THRESHOLD, verified: float = VERIFIED) -> tuple[np.ndarray, np.ndarray]:
        """(places in ids, scores) of the k best found, the query's own row left out; ties to smaller ids."""
        at = self.candidates(query, max(LEAST * k, int(verified * len(self.vectors))), int(threshold * len(self.axes)))
        if len(at) > k + 1:  # one fast product rules out what is beyond rounding below the k + 1 best; the rest is added up in order
            rough = self.vectors.take(at, axis=0) @ query
            edge = np.partition(rough, len(rough) - k - 1)[len(rough) - k - 1]
            at = at[rough >= edge - 1e-12 * self.length * np.sqrt(query @ query)]
        scores = exact(self.vectors[at], query)
        if len(at) > k + 1:
            edge = np.partition(scores, len(scores) - k - 1)[len(scores) - k - 1]
            at, scores = at[scores >= edge], scores[scores >= edge]
        rows = [np.arange(self.first[i], min(self.last[i], self.first[i] + k + 1)) for i in at]  # the smallest of a run of equal vectors
        every, s = np.concatenate(rows) if rows else np.zeros(0, np.int64), np.repeat(scores, [len(x) for x in rows])
        other = self.rows[every] != own
        every, s = every[other], s[other]
        best = np.lexsort((self.rows[every], self.ids[every], -s))[:k]
        return every[best], s[best]


def exact(vectors: np.ndarray, query: np.ndarray) -> np.ndarray:
    """Inner products in double precision, added up in the order of the components, so that equal vectors score alike everywhere."""
    return np.cumsum(vectors * query, axis=1)[:, -1] if vectors.size else np.zeros(len(vectors))


def usable(embeddings: DataFrame) -> DataFrame:
    """(id, v): rows with an id and a vector that is not null, empty or zero and has no null or non-finite component."""
    v = F.col("embedding").cast("array<double>")
    fine = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))) & F.exists("v", lambda x: x != 0)
    return embeddings.select(F.col("vec_id").cast("long").alias("id"), v.alias("v")).where("id is not null and v is not null").where(fine)


def neighbours(embeddings: DataFrame, k: int = 20, every: int = 20, shard: int = SHARD, block: int = QUERIES) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest found for each row whose vec_id is divisible by every.

    Vectors that are unusable take no part. Every row but the query's own is a candidate, also one that repeats its vec_id or
    all of it; rows that repeat a query are queries of their own. Vectors of another length than a query's are no
    candidates for it. Fewer than k candidates give fewer rows. Of equal vectors only the k + 1 rows with the smallest ids
    can be in any answer, so no others are dealt out. Queries meet all shards in blocks, so neither side has to fit one task.
    """
    rows = durable(usable(embeddings).withColumns({"d": F.size("v"), "row": F.monotonically_increasing_id()}))
    queries = rows.where(F.pmod("id", F.lit(every)) == 0)
    equal = Window.partitionBy("v").orderBy("id", "row")
    kept = durable(rows.withColumn("place", F.row_number().over(equal)).where(F.col("place") <= k + 1).drop("place"))
    n, q = kept.count(), queries.count()
    shards, blocks = max(1, -(-n // shard)), max(1, -(-q // block))
    number = lambda name, of: F.pmod(F.xxhash64(F.lit(name), "row"), F.lit(of)).cast("int")
    data = kept.select("id", "row", "v", "d", number("shard", shards).alias("s")).withColumn("b", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    asked = queries.select("id", "row", "v", "d", number("block", blocks).alias("b")).withColumn("s", F.explode(F.sequence(F.lit(0), F.lit(shards - 1))))

    def search(left: pa.Table, right: pa.Table) -> pa.Table:
        out: list[list] = [[], [], [], []]
        if left.num_rows and right.num_rows:
            index = SortedProjections(left["id"].to_numpy(), left["row"].to_numpy(), matrix(left["v"]))
            for own, query_id, query in zip(right["row"].to_pylist(), right["id"].to_pylist(), matrix(right["v"]), strict=True):
                at, scores = index.search(own, query, k)
                for to, x in zip(out, (np.full(len(at), own), np.full(len(at), query_id), index.ids[at], scores), strict=True):
                    to.append(x)
        names, kinds = ("row", "query_id", "vec_id", "score"), (np.int64, np.int64, np.int64, np.float64)
        return pa.table({name: pa.array(np.concatenate(x).astype(kind) if x else np.zeros(0, kind)) for name, x, kind in zip(names, out, kinds, strict=True)})

    found = data.groupBy("d", "s", "b").cogroup(asked.groupBy("d", "s", "b")).applyInArrow(search, "row long, query_id long, vec_id long, score double")
    # a shard sends k rows for each query, and each map task at most k of them over the shuffle
    order = Window.partitionBy("row").orderBy(F.col("score").desc(), "vec_id")
    ranked = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")


def matrix(column: pa.ChunkedArray) -> np.ndarray:
    column = column.combine_chunks()
    return column.flatten().to_numpy().reshape(len(column), -1)

