"""Daily series: anomalies, tests, forecasts and alerts. The series are events' values summed by day and type."""

from __future__ import annotations

from pyspark.sql import functions as F

from lumenta.functions import stats
from lumenta.operators import alerts, anomaly, forecast
from lumenta.queries.metrics import rounded
from lumenta.sources import tables

RULES = [
    (1, "click", alerts.Rule("value", "threshold", "lt", 900.0, 7)),
    (2, "view", alerts.Rule("value", "threshold", "gt", 100.0, 3)),
    (3, "error", alerts.Rule("value", "change", "lt", 0.05, 7, 7)),
    (4, "purchase", alerts.Rule("value", "change", "gt", 0.05, 7, 7)),
    (5, "signup", alerts.Rule("value", "anomaly", window_days=30, min_severity="medium")),
]


def daily(spark, folder):
    events = tables.table(spark, folder, "events")
    return events.groupBy(F.col("event_type").alias("series_id"), F.col("ts").cast("date").alias("ds")).agg(F.sum("value").alias("y"))


def _flagged(method):
    return lambda s, f: rounded(anomaly.detect(daily(s, f), method, 2.0).select("series_id", "ds", "observed", "expected", "deviation_pct", "score", "severity", "direction"), 4)


def _choose(spark, folder):
    return rounded(anomaly.chosen(daily(spark, folder)), 4)


def _moments(spark, folder):
    own = daily(spark, folder).withColumn("late", F.col("ds") > F.lit("2024-01-15").cast("date"))
    return rounded(own.groupBy("series_id", "late").agg(F.count("y").alias("n"), F.avg("y").alias("mean"), F.var_samp("y").alias("var")), 4)


def _welch(spark, folder):
    """Both halves' moments are two rows a series; the test itself is arithmetic on them."""
    rows, out = {(r.series_id, r.late): r for r in _moments(spark, folder).collect()}, []
    for key in sorted({k for k, _ in rows}):
        if (key, False) in rows and (key, True) in rows:
            a, b = rows[key, False], rows[key, True]
            t = stats.welch(a.n, a.mean, a["var"] or 0.0, b.n, b.mean, b["var"] or 0.0)
            out.append((key, float(t.p_value), float(t.effect_size), bool(t.significant)))
    return spark.createDataFrame(out, "series_id string, p_value double, effect_size double, significant boolean")


def _proportions(spark, folder):
    events = tables.table(spark, folder, "events")
    late = F.col("ts").cast("date") > F.lit("2024-01-15").cast("date")
    return events.groupBy(late.alias("late")).agg(F.sum((F.col("event_type") == "error").cast("long")).alias("successes"), F.count("*").alias("n"))


def _slope(spark, folder):
    own = daily(spark, folder).withColumn("x", F.datediff("ds", F.lit("2024-01-01").cast("date")).cast("double"))
    return rounded(own.groupBy("series_id").agg(F.regr_slope("y", "x").alias("slope")), 6)


def _confidence(spark, folder):
    parts = {"data": 0.752, "statistical": 0.041, "model": 0.631, "reasoning": 1.0}
    return spark.createDataFrame([(k, round(float(v), 9)) for k, v in stats.combine(parts).items() if isinstance(v, int | float) and not isinstance(v, bool)], "field string, value double")


def _alerts(spark, folder):
    out = alerts.evaluate(alerts.rule_table(spark, RULES), daily(spark, folder))
    return rounded(out.select("rule_id", "series_id", "condition", "observed", "evaluated", "triggered", "severity"), 6)


def _sweep(spark, folder):
    rules, own = alerts.rule_table(spark, RULES), daily(spark, folder)
    return alerts.evaluate(rules, own).select("rule_id", "series_id", "triggered").unionByName(alerts.evaluate_anomalies(rules, own).select("rule_id", "series_id", "triggered"))


def _backtest(spark, folder):
    return rounded(alerts.backtest(alerts.rule_table(spark, RULES), daily(spark, folder), 180).select("rule_id", "series_id", "ds", "observed", "triggered", "fired"), 6)


QUERIES = {
    "series_daily": lambda s, f: rounded(daily(s, f), 4),
    "series_autocorr": lambda s, f: rounded(anomaly.autocorrelation(daily(s, f)), 6),
    "window_lag": lambda s, f: rounded(anomaly.lagged(daily(s, f)), 4),
    "anomaly_robust_z": _flagged(anomaly.ROBUST),
    "anomaly_seasonal": _flagged(anomaly.SEASONAL),
    "anomaly_rolling": _flagged(anomaly.ROLLING),
    "anomaly_choose": _choose,
    "anomaly_auto": _flagged("auto"),
    "anomaly_severity": lambda s, f: tables.table(s, f, "events").select("event_id", anomaly.severity(F.col("value") / 25).alias("severity")),
    "welch_moments": _moments,
    "welch_test": _welch,
    "proportion_counts": _proportions,
    "confidence_geomean": _confidence,
    "forecast_naive": lambda s, f: rounded(forecast.naive(daily(s, f), 10), 4),
    "forecast_naive_metrics": lambda s, f: rounded(forecast.naive_errors(daily(s, f), 7), 4),
    "forecast_backtest": lambda s, f: rounded(forecast.best(forecast.backtest(forecast.spine(daily(s, f)), 5)), 4),
    "forecast_intervals": lambda s, f: rounded(forecast.forecast(forecast.spine(daily(s, f)), 7).select("series_id", "ds", "lower_95", "lower_80", "predicted", "upper_80", "upper_95"), 4),
    "forecast_hw": lambda s, f: rounded(forecast.forecast(forecast.spine(daily(s, f)), 7), 4),
    "date_spine": lambda s, f: rounded(forecast.spine(daily(s, f).where("dayofmonth(ds) % 3 <> 0")), 4),
    "trend_slope": _slope,
    "alert_threshold": lambda s, f: _alerts(s, f).where("condition = 'threshold'"),
    "alert_change": lambda s, f: _alerts(s, f).where("condition = 'change'"),
    "alert_anomaly": lambda s, f: rounded(alerts.evaluate_anomalies(alerts.rule_table(s, RULES), daily(s, f)), 4),
    "alert_sweep": _sweep,
    "alert_backtest": _backtest,
}

_DAILY = "daily as (select event_type as series_id, cast(ts as date) as ds, sum(value) as y from events group by all)"
_W = "partition by series_id order by ds"
_EXPECTED = {
    "robust_z": "x as (select *, median(y) over (partition by series_id) as expected from daily)",
    "seasonal": f"l as (select *, lag(y, 7) over ({_W}) as lag_y from daily), e as (select *, median(lag_y) over ({_W} rows between 6 preceding and current row) as e0 from l), x as (select series_id, ds, y, first_value(e0 ignore nulls) over ({_W} rows between current row and unbounded following) as expected from e)",
    "rolling": f"""n as (select *, count(*) over (partition by series_id) as n, row_number() over ({_W}) as i from daily), e as (select a.series_id, a.ds, a.y, case when count(b.y) >= 3 then median(b.y) end as e0 from n a join n b on a.series_id = b.series_id and b.i <= a.i and b.i > a.i - greatest(7, least(28, a.n // 4)) group by all),
 x as (select series_id, ds, y, first_value(e0 ignore nulls) over ({_W} rows between current row and unbounded following) as expected from e)""",
}


def _scores(expected: str, least: float = 2) -> str:
    return f"""with {_DAILY}, {expected}, r as (select *, y - expected as residual from x), c as (select series_id, median(residual) as centre, stddev_samp(residual) as sd, count(*) as points from r group by 1), m as (select series_id, median(abs(residual - centre)) as mad from r join c using (series_id) group by 1),
 s as (select *, residual / case when mad * 1.4826 > 1e-12 then mad * 1.4826 when sd > 0 then sd else 1e-9 end as score from r join c using (series_id) join m using (series_id) where points >= 8)
 select series_id, ds, round(y, 4) as observed, round(expected, 4) as expected, round(residual / nullif(expected, 0), 4) as deviation_pct, round(score, 4) as score, case when abs(score) >= 6 then 'critical' when abs(score) >= 4 then 'high' when abs(score) >= 3 then 'medium' else 'low' end as severity, case when score > 0 then 'spike' else 'drop' end as direction from s where abs(score) >= {least}"""


_AT = f"{_DAILY}, last as (select series_id, max(ds) as final from daily group by 1), d as (select daily.*, date_diff('day', ds, final) as back from daily join last using (series_id))"
_CHOOSE = f"""with {_DAILY}, l as (select *, lag(y, 7) over ({_W}) as lag_y from daily), a as (select series_id, count(*) as pairs, corr(y, lag_y) as autocorr from l where lag_y is not null group by 1),
 r as (select *, row_number() over ({_W}) as i, count(*) over (partition by series_id) as points from daily), t as (select *, greatest(3, points // 3) as third from r),
 o as (select series_id, count(*) as n, abs(avg(y) filter (i > points - third) - avg(y) filter (i <= third)) as shift, stddev_samp(y) as sd from t group by 1)
 select series_id, n, round(autocorr, 4) as autocorr, round(shift, 4) as shift, round(sd, 4) as sd, case when n >= 21 and pairs > 5 and autocorr > 0.55 then 'seasonal_residual' when sd > 0 and shift > sd then 'rolling_deviation' else 'robust_zscore' end as method from o left join a using (series_id)"""


def _auto(least: float = 2) -> str:
    """Each series by the method that is chosen for it."""
    methods = {"seasonal_residual": "seasonal", "rolling_deviation": "rolling", "robust_zscore": "robust_z"}
    return " union all ".join(f"select s.* from ({_scores(_EXPECTED[x], least)}) s join ({_CHOOSE}) c using (series_id) where c.method = '{m}'" for m, x in methods.items())


_ANOMALY_RULE = f"""select cast(5 as int) as rule_id, 'signup' as series_id, 'value' as metric, count(*) filter (near) as n_found, max(score) filter (near) as worst_score, count(*) filter (near) > 0 as triggered
 from (select series_id, abs(score) as score, date_diff('day', ds, (select max(cast(ts as date)) from events where event_type = 'signup')) < 30 and severity <> 'low' as near from ({_auto(3)}) where series_id = 'signup')"""
_BACK = f"""with {_DAILY}, last as (select series_id, max(ds) as final from daily group by 1), days_at as (select series_id, ds as d from daily join last using (series_id) where date_diff('day', ds, final) < 180),
 rules(rule_id, series_id, is_change, down, t, w, c) as (values (1, 'click', false, true, 900.0, 7, 7), (2, 'view', false, false, 100.0, 3, 7), (3, 'error', true, true, 0.05, 7, 7), (4, 'purchase', true, false, 0.05, 7, 7)),
 m as (select rule_id, days_at.series_id, d, is_change, down, t, c, avg(y) filter (date_diff('day', ds, d) < w) as cm, avg(y) filter (date_diff('day', ds, d) >= w) as pm, count(*) filter (date_diff('day', ds, d) >= w) as pn from days_at join rules using (series_id) join daily on daily.series_id = days_at.series_id and date_diff('day', ds, d) between 0 and w + c - 1 group by all),
 o as (select *, (cm - pm) / nullif(abs(pm), 0) as change, not is_change or coalesce(pn / c >= 0.6 and abs(pm) >= 1e-12, false) as ok from m)"""
ORACLE = {
    "anomaly_choose": _CHOOSE,
    "anomaly_auto": _auto(),
    "alert_anomaly": _ANOMALY_RULE,
    "alert_backtest": f"""{_BACK}, x as (select cast(rule_id as int) as rule_id, series_id, d as ds, round(case when ok then case when is_change then change else cm end end, 6) as observed, ok and coalesce(case when is_change then case when down then change <= -t else change >= t end else case when down then cm < t else cm > t end end, false) as triggered from o)
 select *, triggered as fired from x""",
    "confidence_geomean": "select 'score' as field, round(exp(0.3 * ln(0.752) + 0.3 * ln(0.041) + 0.2 * ln(0.631) + 0.2 * ln(1.0)), 9) as value",
    "anomaly_severity": "select event_id, case when abs(value / 25) >= 6 then 'critical' when abs(value / 25) >= 4 then 'high' when abs(value / 25) >= 3 then 'medium' else 'low' end as severity from events",
    "series_daily": f"with {_DAILY} select series_id, ds, round(y, 4) as y from daily",
    "series_autocorr": f"with {_DAILY}, l as (select *, lag(y, 7) over ({_W}) as lag_y from daily) select series_id, count(*) as n_pairs, round(corr(y, lag_y), 6) as autocorr from l where lag_y is not null group by 1",
    "window_lag": f"with {_DAILY} select series_id, ds, round(y, 4) as y, round(lag(y, 7) over ({_W}), 4) as lag_y from daily",
    **{f"anomaly_{k}": _scores(x) for k, x in _EXPECTED.items()},
    "welch_moments": f"with {_DAILY} select series_id, ds > date '2024-01-15' as late, count(y) as n, round(avg(y), 4) as mean, round(var_samp(y), 4) as var from daily group by all",
    "proportion_counts": "select cast(ts as date) > date '2024-01-15' as late, count(*) filter (event_type = 'error') as successes, count(*) as n from events group by all",
    "forecast_naive": f"with {_DAILY}, r as (select *, row_number() over (partition by series_id order by ds desc) as back, max(ds) over (partition by series_id) as e from daily), s as (select unnest(range(1, 11)) as step) select series_id, cast(e + cast(step as int) as date) as ds, round(y, 4) as predicted from r, s where back <= 7 and back = 7 - (step - 1) % 7",
    "forecast_naive_metrics": f"with {_DAILY}, r as (select *, row_number() over (partition by series_id order by ds desc) as back from daily) select a.series_id, round(avg(abs(b.y - a.y)), 4) as mae, round(sqrt(avg((b.y - a.y) * (b.y - a.y))), 4) as rmse from r a join r b on a.series_id = b.series_id and a.back <= 7 and b.back = a.back + 7 group by 1",
    "date_spine": f"with {_DAILY}, own as (select * from daily where day(ds) % 3 <> 0), e as (select series_id, unnest(generate_series(min(ds), max(ds), interval 1 day))::date as ds from own group by 1) select series_id, ds, round(coalesce(y, 0), 4) as y from e left join own using (series_id, ds)",
    "trend_slope": f"with {_DAILY} select series_id, round(regr_slope(y, cast(ds - date '2024-01-01' as double)), 6) as slope from daily group by 1",
    "alert_threshold": f"""with {_AT}, o as (select 1 as rule_id, 'click' as series_id, avg(y) as v, 900.0 as t, true as down from d where series_id = 'click' and back < 7 union all select 2, 'view', avg(y), 100.0, false from d where series_id = 'view' and back < 3)
 select cast(rule_id as int) as rule_id, series_id, 'threshold' as condition, round(v, 6) as observed, true as evaluated, case when down then v < t else v > t end as triggered, case when abs(v - t) / t >= 0.5 then 'critical' when abs(v - t) / t >= 0.2 then 'high' else 'medium' end as severity from o""",
    "alert_change": f"""with {_AT}, o as (select series_id, avg(y) filter (back < 7) as c, avg(y) filter (back between 7 and 13) as p, count(*) filter (back between 7 and 13) as n from d where series_id in ('error', 'purchase') group by 1), x as (select *, (c - p) / abs(p) as v, n / 7.0 >= 0.6 as ok from o)
 select cast(case when series_id = 'error' then 3 else 4 end as int) as rule_id, series_id, 'change' as condition, round(case when ok then v end, 6) as observed, ok as evaluated, ok and case when series_id = 'error' then v <= -0.05 else v >= 0.05 end as triggered, case when abs(v) / 0.05 >= 3 then 'critical' when abs(v) / 0.05 >= 1.5 then 'high' else 'medium' end as severity from x""",
}
ORACLE["alert_sweep"] = " union all ".join(f"select rule_id, series_id, triggered from ({x})" for x in (ORACLE["alert_threshold"], ORACLE["alert_change"], ORACLE["alert_anomaly"]))
