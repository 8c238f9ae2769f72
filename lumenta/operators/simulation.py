"""Scenario simulation: levers on segments of a daily baseline, their paths, shares, sensitivity and break-even."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

LEVERS = "lever string, segment string, change double, ramp_days int"


def levers(spark: SparkSession, rows: list[tuple[str, str, float, int]]) -> DataFrame:
    """(lever, segment, change as a share, days until it is in full effect); a list that a user types in."""
    return spark.createDataFrame(rows, LEVERS)


def unknown_segments(baseline: DataFrame, own: DataFrame) -> DataFrame:
    return own.join(baseline, "segment", "left_anti").select("segment").distinct()


def unaddressed(baseline: DataFrame, own: DataFrame) -> DataFrame:
    return baseline.join(own, "segment", "left_anti").select("segment")


def _factor():
    return 1 + F.col("change") * F.least(F.lit(1.0), (F.col("day") + 1) / F.greatest(F.col("ramp_days"), F.lit(1)))


def _days(frame: DataFrame, horizon: int) -> DataFrame:
    return frame.withColumn("day", F.explode(F.sequence(F.lit(0), F.lit(horizon - 1))))


def paths(baseline: DataFrame, own: DataFrame, horizon: int) -> DataFrame:
    """segment, day, baseline, scenario from baseline (segment, daily): levers on one segment multiply."""
    factors = _days(own, horizon).groupBy("segment", "day").agg(F.product(_factor()).alias("factor"))
    out = _days(baseline.select("segment", "daily"), horizon).join(factors, ["segment", "day"], "left")
    return out.select("segment", "day", F.col("daily").alias("baseline"), (F.col("daily") * F.coalesce("factor", F.lit(1.0))).alias("scenario"))


def summary(baseline: DataFrame, own: DataFrame, horizon: int, interval: float = 0.1) -> DataFrame:
    t = paths(baseline, own, horizon).agg(F.sum("baseline").alias("baseline_total"), F.sum("scenario").alias("scenario_total"))
    s = F.col("scenario_total")
    return t.select("baseline_total", "scenario_total", (s - F.col("baseline_total")).alias("absolute_change"), ((s - F.col("baseline_total")) / F.nullif(F.col("baseline_total"), F.lit(0.0))).alias("pct_change"), (s * (1 - interval)).alias("lower"), (s * (1 + interval)).alias("upper"))


def per_lever(baseline: DataFrame, own: DataFrame, horizon: int) -> DataFrame:
    """lever, segment, impact (of the lever alone), share of all levers' impacts."""
    alone = _days(own, horizon).join(baseline.select("segment", "daily"), "segment")
    out = alone.groupBy("lever", "segment").agg(F.sum(F.col("daily") * (_factor() - 1)).alias("impact"))
    total = out.agg(F.sum("impact").alias("total"))
    return out.crossJoin(F.broadcast(total)).select("lever", "segment", "impact", (F.col("impact") / F.nullif(F.col("total"), F.lit(0.0))).alias("share"))


def sensitivity(baseline: DataFrame, own: DataFrame, horizon: int, low: float = 0.5, high: float = 1.5) -> DataFrame:
    """lever, low, high, swing: the total change when one lever is that many times as strong and the rest stay."""
    other = own.select(F.col("lever").alias("varied")).distinct()
    scale = own.sparkSession.createDataFrame([("low", low), ("high", high)], "side string, scale double")
    # levers x levers x 2: all lists that a user types in
    cases = own.crossJoin(F.broadcast(other)).crossJoin(F.broadcast(scale)).withColumn("change", F.when(F.col("lever") == F.col("varied"), F.col("change") * F.col("scale")).otherwise(F.col("change")))
    factors = _days(cases, horizon).groupBy("varied", "side", "segment", "day").agg(F.product(_factor()).alias("factor"))
    moved = factors.join(baseline.select("segment", "daily"), "segment").groupBy("varied", "side").agg(F.sum(F.col("daily") * (F.col("factor") - 1)).alias("impact"))
    out = moved.groupBy(F.col("varied").alias("lever")).agg(F.sum(F.when(F.col("side") == "low", F.col("impact"))).alias("low"), F.sum(F.when(F.col("side") == "high", F.col("impact"))).alias("high"))
    return out.withColumn("swing", F.abs(F.col("high") - F.col("low")))


def break_even(baseline: DataFrame, segment: str, target: float, horizon: int) -> DataFrame:
    """segment, unit_delta (of +100 % at once), required_change that moves the total by target; null if the segment has no baseline."""
    own = baseline.where(F.col("segment") == segment).select("segment", (F.col("daily") * horizon).alias("unit_delta"))
    return own.withColumn("required_change", F.lit(target) / F.nullif(F.col("unit_delta"), F.lit(0.0)))
