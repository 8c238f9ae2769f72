"""What moved a metric between two periods: additive drivers, and the mix/rate split of a ratio.

Both periods and all dimensions come from one scan: rows are summed for each combination of dimensions first, and only
those sums are unpivoted.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumenta.sources.durable import durable

LEAST_CONTRIBUTION, COVERAGE_TOP = 0.005, 5


def _side(value: str, condition: Column) -> Column:
    return F.coalesce(F.sum(F.when(condition, F.col(value))), F.lit(0.0))


def paired(frame: DataFrame, dims: list[str], value: str, is_current: Column, is_previous: Column) -> DataFrame:
    """dims, prev, curr: the value of each combination in either period. Written once: segments, dimensions and totals are sums of it."""
    return durable(frame.where(is_current | is_previous).groupBy(*dims).agg(_side(value, is_previous).alias("prev"), _side(value, is_current).alias("curr")))


def ratio_pairs(frame: DataFrame, dims: list[str], is_current: Column, is_previous: Column) -> tuple[DataFrame, DataFrame]:
    """Pairs of a ratio from num and den: (dims, prev, curr), parts of the ratio that add up to it; and (dims, prev_num, ..., curr_den).

    A combination's part is its numerator over the whole period's denominator, so drivers' contributions add up to the
    ratio's change as those of a sum do.
    """
    sums = {f"{side}_{c}": _side(c, condition) for side, condition in (("prev", is_previous), ("curr", is_current)) for c in ("num", "den")}
    own = durable(frame.where(is_current | is_previous).groupBy(*dims).agg(*[x.alias(n) for n, x in sums.items()]))
    whole = own.agg(F.sum("prev_den").alias("p"), F.sum("curr_den").alias("c")).first()
    part = lambda c, d: (F.col(c) / F.lit(float(d))) if d else F.lit(0.0)
    return own.select(*dims, part("prev_num", whole.p).alias("prev"), part("curr_num", whole.c).alias("curr")), own


def totals(pairs: DataFrame) -> DataFrame:
    """prev_total, curr_total, absolute_change, pct_change (null from zero)."""
    t = pairs.agg(F.coalesce(F.sum("prev"), F.lit(0.0)).alias("prev_total"), F.coalesce(F.sum("curr"), F.lit(0.0)).alias("curr_total"))
    change = F.col("curr_total") - F.col("prev_total")
    return t.select("prev_total", "curr_total", change.alias("absolute_change"), (change / F.nullif(F.col("prev_total"), F.lit(0.0))).alias("pct_change"))


def segments(pairs: DataFrame, dims: list[str]) -> DataFrame:
    """dim, seg, prev, curr for each value of each dimension; a null value is a segment too, with a null name."""
    cells = F.explode(F.array(*[F.struct(F.lit(d).alias("dim"), F.col(d).cast("string").alias("seg")) for d in dims])).alias("cell")
    return pairs.select(cells, "prev", "curr").groupBy("cell.dim", "cell.seg").agg(F.sum("prev").alias("prev"), F.sum("curr").alias("curr"))


def sized(segs: DataFrame, total: DataFrame) -> DataFrame:
    """Segments with their part in the total's change. The total is one row by construction."""
    delta = F.col("curr") - F.col("prev")
    out = segs.crossJoin(F.broadcast(total))
    return out.select(
        "dim", "seg", "prev", "curr", "prev_total", "curr_total", "pct_change", delta.alias("delta"),
        (delta / F.nullif(F.col("prev"), F.lit(0.0))).alias("segment_pct_change"),
        F.coalesce(delta / F.nullif(F.col("prev_total"), F.lit(0.0)), F.lit(0.0)).alias("contribution_pct"),
        (F.abs(delta) / F.nullif(F.abs(F.col("absolute_change")), F.lit(0.0))).alias("share_of_change"),
        F.when((F.col("prev") != 0) & (F.col("curr") != 0), "changed").when(F.col("prev") == 0, "new").otherwise("lost").alias("status"),
    )


def usable(segs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Dimensions with two or more values over both periods, and those skipped because they have fewer."""
    counts = segs.groupBy("dim").agg(F.count("*").alias("n_values"))
    return counts.where("n_values >= 2"), counts.where("n_values < 2")


def drivers(pairs: DataFrame, dims: list[str], least: float = LEAST_CONTRIBUTION) -> DataFrame:
    """Segments that moved the total by at least least of its former value, of dimensions that can tell segments apart."""
    segs = segments(pairs, dims)
    keep, _ = usable(segs)
    out = sized(segs, totals(pairs)).join(F.broadcast(keep.select("dim")), "dim", "left_semi")  # one row for each dimension
    return out.where(((F.col("prev") != 0) | (F.col("curr") != 0)) & (F.abs("contribution_pct") >= least))


def top(rows: DataFrame, n: int) -> DataFrame:
    return rows.orderBy(F.abs("contribution_pct").desc(), "dim", "seg").limit(n)


def reconciliation(pairs: DataFrame, dims: list[str]) -> DataFrame:
    """dim, contribution_sum, pct_change, error: contributions of all segments, before any filter, add up to the change."""
    own = sized(segments(pairs, dims), totals(pairs)).groupBy("dim").agg(F.sum("contribution_pct").alias("contribution_sum"), F.max("pct_change").alias("pct_change"))
    return own.withColumn("error", F.abs(F.col("contribution_sum") - F.col("pct_change")))


def coverage(pairs: DataFrame, dims: list[str]) -> DataFrame:
    """top_dim, coverage: how much of the change the five largest drivers of the leading driver's dimension make up, 1 at most."""
    rows = drivers(pairs, dims)
    lead = rows.agg(F.max_by("dim", F.struct(F.abs("contribution_pct"), "dim")).alias("top_dim"))
    own = rows.join(F.broadcast(lead), F.col("dim") == F.col("top_dim")).orderBy(F.abs("contribution_pct").desc(), "seg").limit(COVERAGE_TOP)
    return own.groupBy("top_dim").agg(F.least(F.lit(1.0), F.sum(F.abs("delta")) / F.abs(F.max(F.col("curr_total") - F.col("prev_total")))).alias("coverage"))


def mix_rate(pairs: DataFrame, dim: str) -> DataFrame:
    """From dim, prev_num, prev_den, curr_num, curr_den: mix, rate and interaction effects of a ratio, and which is largest.

    mix: segments' weights move at former rates; rate: rates move at former weights; interaction: both.
    """
    total = pairs.agg(F.sum("prev_den").alias("pd"), F.sum("curr_den").alias("cd"))
    pw, cw = F.coalesce(F.col("prev_den") / F.nullif(F.col("pd"), F.lit(0)), F.lit(0.0)), F.coalesce(F.col("curr_den") / F.nullif(F.col("cd"), F.lit(0)), F.lit(0.0))
    pr, cr = F.coalesce(F.col("prev_num") / F.nullif(F.col("prev_den"), F.lit(0)), F.lit(0.0)), F.coalesce(F.col("curr_num") / F.nullif(F.col("curr_den"), F.lit(0)), F.lit(0.0))
    sums = pairs.crossJoin(F.broadcast(total)).agg(F.sum((cw - pw) * pr).alias("mix_effect"), F.sum((cr - pr) * pw).alias("rate_effect"), F.sum((cw - pw) * (cr - pr)).alias("interaction_effect"))
    m, r, i = F.abs("mix_effect"), F.abs("rate_effect"), F.abs("interaction_effect")
    return sums.withColumn("dominant", F.when((m >= r) & (m >= i), "mix").when(r >= i, "rate").otherwise("interaction"))


def aligned(previous: DataFrame, current: DataFrame, key: str, value: str) -> DataFrame:
    """key, prev, curr: a full outer join of two grouped frames; what is missing on a side is 0."""
    a, b = previous.select(key, F.col(value).alias("prev")), current.select(key, F.col(value).alias("curr"))
    return a.join(b, key, "full_outer").select(key, F.coalesce("prev", F.lit(0.0)).alias("prev"), F.coalesce("curr", F.lit(0.0)).alias("curr"))
