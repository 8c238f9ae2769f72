"""Anomalies of daily series by robust scores, for one series or many at once (partitioned by a series column)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lumenta.sources.durable import durable

SIGMA, THRESHOLD, PERIOD, LEAST_POINTS = 1.4826, 3.0, 7, 8
SEASONAL, ROLLING, ROBUST = "seasonal_residual", "rolling_deviation", "robust_zscore"
SERIES = "series_id"


def prepared(frame: DataFrame, ds: str, y: str, series: str | None = None) -> DataFrame:
    """series_id, ds, y without null values."""
    return frame.select((F.col(series) if series else F.lit("all")).cast("string").alias(SERIES), F.col(ds).alias("ds"), F.col(y).cast("double").alias("y")).where("y is not null")


def _ordered() -> Window:
    return Window.partitionBy(SERIES).orderBy("ds")


def median_of(values: Column) -> Column:
    """The middle of an array, or the mean of its two middle values; null of an empty one."""
    own, n = F.array_sort(values), F.size(values)
    return F.when(n > 0, (F.element_at(own, F.floor((n + 1) / 2).cast("int")) + F.element_at(own, F.floor(n / 2).cast("int") + 1)) / 2)


def lagged(series: DataFrame, n: int = PERIOD) -> DataFrame:
    return series.withColumn("lag_y", F.lag("y", n).over(_ordered()))


def autocorrelation(series: DataFrame, n: int = PERIOD) -> DataFrame:
    """series_id, n_pairs, autocorr between each value and the one n rows before."""
    return lagged(series, n).where("lag_y is not null").groupBy(SERIES).agg(F.count("*").alias("n_pairs"), F.corr("y", "lag_y").alias("autocorr"))


def _backfilled(rows: DataFrame) -> DataFrame:
    return rows.withColumn("expected", F.first("e0", ignorenulls=True).over(_ordered().rowsBetween(0, Window.unboundedFollowing)))


def expected_seasonal(series: DataFrame, n: int = PERIOD) -> DataFrame:
    """expected: the median of up to n values that lie n to 2n - 1 rows back; the first rows take the first value there is."""
    rows = lagged(series, n)
    frame = _ordered().rowsBetween(-(n - 1), 0)
    return _backfilled(rows.withColumn("e0", median_of(F.collect_list("lag_y").over(frame)))).drop("lag_y", "e0")


def expected_rolling(series: DataFrame, least: int = 3) -> DataFrame:
    """expected: the median of the last max(7, min(28, n/4)) values, from the third on."""
    rows = series.withColumn("n", F.count("*").over(Window.partitionBy(SERIES))).withColumn("w", F.greatest(F.lit(7), F.least(F.lit(28), F.floor(F.col("n") / 4).cast("int"))))
    last = F.collect_list("y").over(_ordered().rowsBetween(-27, 0))
    own = F.slice(last, F.greatest(F.lit(1), F.size(last) - F.col("w") + 1), F.col("w"))
    return _backfilled(rows.withColumn("own", own).withColumn("e0", F.when(F.size("own") >= least, median_of(F.col("own"))))).drop("n", "w", "own", "e0")


def expected_level(series: DataFrame) -> DataFrame:
    """expected: the series' median."""
    return series.join(series.groupBy(SERIES).agg(F.median("y").alias("expected")), SERIES)


def chosen(series: DataFrame, n: int = PERIOD) -> DataFrame:
    """series_id, method: seasonal if the lag correlation is over 0.55, rolling if the last third has moved by more than a deviation."""
    rows = series.withColumns({"i": F.row_number().over(_ordered()), "n": F.count("*").over(Window.partitionBy(SERIES))}).withColumn("third", F.greatest(F.lit(3), F.floor(F.col("n") / 3).cast("int")))
    shift = F.abs(F.avg(F.when(F.col("i") > F.col("n") - F.col("third"), F.col("y"))) - F.avg(F.when(F.col("i") <= F.col("third"), F.col("y"))))
    own = rows.groupBy(SERIES).agg(F.count("*").alias("n"), shift.alias("shift"), F.stddev_samp("y").alias("sd")).join(autocorrelation(series, n), SERIES, "left")
    method = F.when((F.col("n") >= 3 * n) & (F.col("n_pairs") > 5) & (F.col("autocorr") > 0.55), SEASONAL).when((F.col("sd") > 0) & (F.col("shift") > F.col("sd")), ROLLING).otherwise(ROBUST)
    return own.select(SERIES, "n", "autocorr", "shift", "sd", method.alias("method"))


def severity(score: Column) -> Column:
    s = F.abs(score)
    return F.when(s >= 6, "critical").when(s >= 4, "high").when(s >= 3, "medium").otherwise("low")


def scored(rows: DataFrame) -> DataFrame:
    """Rows with expected, and each residual's robust score: over the residuals' scaled median deviation, or their deviation if that is none."""
    r = rows.withColumn("residual", F.col("y") - F.col("expected"))
    centre = r.groupBy(SERIES).agg(F.median("residual").alias("centre"), F.stddev_samp("residual").alias("sd"), F.count("*").alias("points"))
    r = r.join(centre, SERIES)
    mad = r.groupBy(SERIES).agg(F.median(F.abs(F.col("residual") - F.col("centre"))).alias("mad"))
    scale = F.when(F.col("mad") * SIGMA > 1e-12, F.col("mad") * SIGMA).when(F.col("sd") > 0, F.col("sd")).otherwise(F.lit(1e-9))
    return r.join(mad, SERIES).where(F.col("points") >= LEAST_POINTS).withColumn("score", F.col("residual") / scale)


def flagged(rows: DataFrame, method: str, threshold: float = THRESHOLD) -> DataFrame:
    """series_id, ds, observed, expected, deviation_pct, score, severity, direction, method of points past the threshold."""
    out = scored(rows).where(F.abs("score") >= threshold)
    return out.select(SERIES, "ds", F.col("y").alias("observed"), "expected", (F.col("residual") / F.nullif(F.col("expected"), F.lit(0.0))).alias("deviation_pct"), "score", severity(F.col("score")).alias("severity"), F.when(F.col("score") > 0, "spike").otherwise("drop").alias("direction"), F.lit(method).alias("method"))


def detect(series: DataFrame, method: str = "auto", threshold: float = THRESHOLD) -> DataFrame:
    """Anomalies of each series; auto takes the method that suits it. Series of fewer than eight points have none."""
    makers = {SEASONAL: expected_seasonal, ROLLING: expected_rolling, ROBUST: expected_level}
    if method != "auto":
        return flagged(makers[method](series), method, threshold)
    series = durable(series)  # a value for each day: the choice and each method read it
    methods = durable(chosen(series).select(SERIES, "method"))
    out = None
    for name, maker in makers.items():
        own = series.join(methods.where(F.col("method") == name).select(SERIES), SERIES, "left_semi")
        found = flagged(maker(own), name, threshold)
        out = found if out is None else out.unionByName(found)
    return out
