"""Forecasts of many daily series at once: damped Holt-Winters against seasonal naive, by rolling-origin backtests.

Backtest work is one row for each (series, parameters), so the grid is spread over the cluster, not looped on the driver.
"""

from __future__ import annotations

from datetime import timedelta
from itertools import product

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

PERIOD, LEAST_HISTORY = 7, 21
#: Fixed grid of smoothing parameters: level, trend, season, damping.
GRID = list(product((0.15, 0.35, 0.6), (0.02, 0.1, 0.3), (0.05, 0.2), (0.85, 0.98)))


def holt_winters(y: np.ndarray, horizon: int, period: int, alpha: float, beta: float, gamma: float, phi: float) -> np.ndarray:
    """Damped additive smoothing, started from the first two periods; without two full periods there is no season."""
    if len(y) < 2 * period:
        period = 1
    seasonal = period > 1
    first = y[:period]
    level = first.mean()
    slope = (y[period : 2 * period].mean() - level) / period if seasonal else 0.0
    season = first - level if seasonal else np.zeros(1)
    for t, value in enumerate(y):
        s = season[t % period]
        carried = phi * slope
        moved = alpha * (value - s) + (1 - alpha) * (level + carried)
        slope = beta * (moved - level) + (1 - beta) * carried
        level = moved
        if seasonal:
            season[t % period] = gamma * (value - level) + (1 - gamma) * s
    steps = np.arange(horizon)
    return level + slope * np.cumsum(phi ** (steps + 1)) + season[(len(y) + steps) % period]


def seasonal_naive(y: np.ndarray, horizon: int, period: int) -> np.ndarray:
    return np.resize(y[-period:] if 1 < period <= len(y) else y[-1:], horizon)


def is_seasonal(y: np.ndarray, period: int = PERIOD) -> bool:
    if len(y) < 3 * period or len(y) - period < 5 or np.ptp(y[period:]) == 0 or np.ptp(y[:-period]) == 0:
        return False
    return bool(np.corrcoef(y[period:], y[:-period])[0, 1] > 0.5)


def cuts(n: int, horizon: int) -> tuple[int, list[int]]:
    """The length of a fold, and up to five origins from the latest back, none before 60 % of the history."""
    h = min(horizon, max(1, n // 6))
    return h, [c for c in range(n - h, int(n * 0.6), -h)][:5]


def errors(y: np.ndarray, horizon: int, predict) -> np.ndarray:
    h, origins = cuts(len(y), horizon)
    return np.concatenate([predict(y[:c], min(h, len(y) - c)) - y[c : c + h] for c in origins]) if origins else np.zeros(0)


def _history(series: DataFrame) -> DataFrame:
    """series_id, last (date), ys (values in order of date): series are days long, so each fits a row."""
    own = series.groupBy("series_id").agg(F.array_sort(F.collect_list(F.struct("ds", "y"))).alias("points"))
    return own.select("series_id", F.element_at("points.ds", -1).alias("last"), F.col("points.y").alias("ys"))


def backtest(series: DataFrame, horizon: int) -> DataFrame:
    """series_id, alpha, beta, gamma, phi, mase, n_folds: every grid point of every series of at least LEAST_HISTORY points."""
    grid = series.sparkSession.createDataFrame([(i, *g) for i, g in enumerate(GRID)], "grid int, alpha double, beta double, gamma double, phi double")
    work = _history(series).where(F.size("ys") >= LEAST_HISTORY).crossJoin(F.broadcast(grid))  # a grid of fixed size

    def score(batches):
        for pdf in batches:
            out = []
            for row in pdf.itertuples(index=False):
                y = np.asarray(row.ys, float)
                period = PERIOD if is_seasonal(y) else 1
                base = np.abs(errors(y, horizon, lambda a, h: seasonal_naive(a, h, period))).mean() or 1e-9
                own = errors(y, horizon, lambda a, h: holt_winters(a, h, period, row.alpha, row.beta, row.gamma, row.phi))
                out.append((row.series_id, row.grid, row.alpha, row.beta, row.gamma, row.phi, float(np.abs(own).mean() / base), len(cuts(len(y), horizon)[1])))
            yield pd.DataFrame(out, columns=["series_id", "grid", "alpha", "beta", "gamma", "phi", "mase", "n_folds"])

    return work.select("series_id", "ys", "grid", "alpha", "beta", "gamma", "phi").repartition("series_id", "grid").mapInPandas(score, "series_id string, grid int, alpha double, beta double, gamma double, phi double, mase double, n_folds int")


def best(scores: DataFrame) -> DataFrame:
    """Each series' least error; of equal ones the first of the grid."""
    order = Window.partitionBy("series_id").orderBy("mase", "grid")
    return scores.withColumn("place", F.row_number().over(order)).where("place = 1").drop("place")


SCHEMA = "series_id string, ds date, step int, predicted double, lower_80 double, upper_80 double, lower_95 double, upper_95 double, model string, mae double, rmse double, mape double, mase double, n_folds int, direction string, seasonal boolean, caveat string"


def forecast(series: DataFrame, horizon: int = 30) -> DataFrame:
    """Predictions with intervals from the backtest's own errors, widened by the root of the step.

    The smoothed model is used only where it beats seasonal naive; a non-negative history gives no negative values; series
    shorter than LEAST_HISTORY repeat their last value. mape is taken within folds, over actual values that are not zero.
    """
    rows = _history(series).join(best(backtest(series, horizon)), "series_id", "left")

    def predict(batches):
        for pdf in batches:
            out = [x for row in pdf.itertuples(index=False) for x in _predict(row, horizon)]
            yield pd.DataFrame(out, columns=[c.split()[0] for c in SCHEMA.split(", ")])

    return rows.select("series_id", "last", "ys", "alpha", "beta", "gamma", "phi", "mase", "n_folds").mapInPandas(predict, SCHEMA)


def _predict(row, horizon: int):
    y, caveat, mape = np.asarray(row.ys, float), None, None
    grow, seasonal = np.sqrt(np.arange(1, horizon + 1)), is_seasonal(y)
    period = PERIOD if seasonal else 1
    if len(y) < LEAST_HISTORY:
        sd = float(y.std()) if len(y) > 1 else 0.0
        model, mase, folds, mae, rmse, seasonal = "naive_last_value", 1.0, 0, sd, sd, False
        caveat = f"only {len(y)} observations, fewer than {LEAST_HISTORY}"
        point = np.repeat(y[-1], horizon)
        low80, high80, low95, high95 = (point + k * sd for k in (-1.28, 1.28, -1.96, 1.96))
    else:
        smooth = row.mase is not None and row.mase < 1
        model = "damped_holt_winters" if smooth else "seasonal_naive"
        own = (lambda a, h: holt_winters(a, h, period, row.alpha, row.beta, row.gamma, row.phi)) if smooth else (lambda a, h: seasonal_naive(a, h, period))
        if not smooth:
            caveat = "seasonal naive was not beaten"
        point, residuals = own(y, horizon), errors(y, horizon, own)
        h, origins = cuts(len(y), horizon)
        actual = np.concatenate([y[c : c + h] for c in origins]) if origins else np.zeros(0)
        mase, folds = (float(row.mase) if smooth else 1.0), len(origins)
        mae, rmse = (float(np.abs(residuals).mean()), float(np.sqrt((residuals**2).mean()))) if len(residuals) else (0.0, 0.0)
        if (actual != 0).any():
            mape = float(np.abs(residuals[actual != 0] / actual[actual != 0]).mean())
        if len(residuals) >= 4:
            low80, high80, low95, high95 = (point + q * grow for q in np.quantile(residuals, [0.1, 0.9, 0.025, 0.975]))
        else:
            sd = float(point.std()) or 1.0
            low80, high80, low95, high95 = (point + k * sd for k in (-1.28, 1.28, -1.96, 1.96))
        if y.min() >= 0:
            point, low80, low95 = (np.maximum(x, 0.0) for x in (point, low80, low95))
    slope = float(np.polyfit(np.arange(horizon), point, 1)[0]) if horizon > 1 else 0.0
    direction = "flat" if abs(slope * horizon) <= 0.1 * (float(y.std()) or 1.0) else "increasing" if slope > 0 else "decreasing"
    for i in range(horizon):
        yield (row.series_id, row.last + timedelta(days=i + 1), i + 1, *(float(x[i]) for x in (point, low80, high80, low95, high95)), model, mae, rmse, mape, mase, folds, direction, seasonal, caveat)


def naive(series: DataFrame, horizon: int, period: int = PERIOD) -> DataFrame:
    """series_id, ds, predicted: the last period over and over, with built-in functions only."""
    tail = Window.partitionBy("series_id").orderBy(F.col("ds").desc())
    last = series.withColumn("back", F.row_number().over(tail)).where(F.col("back") <= period)
    ends = series.groupBy("series_id").agg(F.max("ds").alias("end"))
    steps = ends.select("series_id", "end", F.explode(F.sequence(F.lit(1), F.lit(horizon))).alias("step"))
    steps = steps.withColumn("back", F.lit(period) - F.pmod(F.col("step") - 1, F.lit(period)))
    return steps.join(last.select("series_id", "back", "y"), ["series_id", "back"]).select("series_id", F.expr("date_add(end, step)").alias("ds"), F.col("y").alias("predicted"))


def naive_errors(series: DataFrame, horizon: int, period: int = PERIOD) -> DataFrame:
    """series_id, mae, rmse of seasonal naive on the last horizon rows."""
    order = Window.partitionBy("series_id").orderBy(F.col("ds").desc())
    rows = series.withColumn("back", F.row_number().over(order))
    actual = rows.where(F.col("back") <= horizon).select("series_id", (F.lit(horizon + 1) - F.col("back")).alias("step"), F.col("y").alias("actual"))
    known = rows.where((F.col("back") > horizon) & (F.col("back") <= horizon + period)).select("series_id", (F.col("back") - horizon).alias("k"), F.col("y").alias("predicted"))
    joined = actual.withColumn("k", F.lit(period) - F.pmod(F.col("step") - 1, F.lit(period))).join(known, ["series_id", "k"])
    e = F.col("predicted") - F.col("actual")
    return joined.groupBy("series_id").agg(F.avg(F.abs(e)).alias("mae"), F.sqrt(F.avg(e * e)).alias("rmse"))


def spine(series: DataFrame) -> DataFrame:
    """series_id, ds, y on every calendar day between a series' ends; 0 where there was no row."""
    days = series.groupBy("series_id").agg(F.min("ds").alias("a"), F.max("ds").alias("b")).select("series_id", F.explode(F.sequence("a", "b", F.expr("interval 1 day"))).alias("ds"))
    return days.join(series, ["series_id", "ds"], "left").select("series_id", "ds", F.coalesce("y", F.lit(0.0)).alias("y"))
