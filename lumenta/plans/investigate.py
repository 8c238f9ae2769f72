"""An investigation: why did a metric move? Stages share one written frame of sums by day and dimension.

Each stage gives an event with its state and the progress so far. Refusals are results. Only result-sized rows are collected.
"""

from __future__ import annotations

from collections.abc import Iterator
from datetime import date

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenta.functions import stats
from lumenta.operators import anomaly, forecast, profiling, rootcause
from lumenta.plans import critic
from lumenta.plans.admission import admit
from lumenta.plans.semantic import Metric, NotApproved, Registry, metric_frame, metric_sql, periods, rolled_up
from lumenta.sources.durable import durable
from lumenta.sources.tables import within

STAGES = ("understand", "plan", "build", "validate", "execute", "profile", "anomaly", "root_cause", "significance", "forecast", "recommend", "narrate", "verify", "complete")


def infer_metric(registry: Registry, question: str, default: str = "revenue") -> str:
    found = registry.search(question, 1)
    return found[0][0] if found else default


def recommendations(drivers: list[dict], pct_change: float | None) -> list[dict]:
    """For the three worst negative drivers: half of the loss is assumed to be recoverable."""
    out = []
    for d in [d for d in drivers if d["delta"] < 0][:3]:
        out.append({"recommendation": f"Look into {d['dim']} {d['seg']}", "expected_impact_absolute": -d["delta"] / 2, "assumption": "half of the loss is recovered", "risk": "high" if abs(d["contribution_pct"]) > 0.05 else "moderate"})
    return out


def narrative(metric: Metric, total: dict, drivers: list[dict], significant: bool) -> str:
    if total["pct_change"] is None:
        return f"{metric.label} has no former value to compare with."
    move = "rose" if total["pct_change"] >= 0 else "fell"
    text = f"{metric.label} {move} by {abs(total['pct_change']) * 100:.1f}%."
    if drivers:
        d = drivers[0]
        text += f" The largest contribution is {d['dim']} {d['seg']} with {d['contribution_pct'] * 100:.1f}% of the former total."
    return text + ("" if significant else " The change is not statistically significant.")


def investigate(frame: DataFrame, registry: Registry, question: str, last: date, metric_key: str | None = None, days: int = 31, dims: list[str] | None = None, horizon: int = 14) -> Iterator[dict]:
    """Events {stage, state, progress, ...}; the last has the result. frame: base rows of the metric with its date column and dimensions."""

    def event(stage: str, state: str, **more) -> dict:
        return {"stage": stage, "state": state, "progress": (STAGES.index(stage) + (0.5 if state == "running" else 1)) / len(STAGES), **more}

    key = metric_key or infer_metric(registry, question)
    yield event("understand", "running")
    try:
        metric = registry.approved(key)
    except (KeyError, NotApproved) as error:
        yield event("understand", "failed", reason=str(error))
        return
    yield event("understand", "done", metric=key)
    previous, current = periods(last, days)
    yield event("plan", "done", previous=previous, current=current, steps=list(STAGES[4:]))
    own = metric_frame(frame, metric, previous[0], current[1], dims)
    have = [c for c in own.columns if c not in ("ds", "num", "den", key)]
    plan = metric_sql(metric, previous[0], current[1], have)
    yield event("build", "done", sql=plan, missing=[d for d in (metric.dimensions if dims is None else dims) if d not in have])
    admission = admit(frame.sparkSession, plan, {metric.base: frame})
    yield event("validate", "done" if admission.ok else "failed", validated=admission.ok, findings=[f.message for f in admission.findings if f.severity == "error"])
    if not admission.ok:
        return
    base = frame.where(within(F.col(metric.date_column).cast("timestamp_ntz"), *current))
    yield from _analyse(durable(own), base, metric, key, have, previous, current, plan, admission.ok, event, horizon)  # sums by day and dimensions of two periods


def _analyse(own, base, metric, key, have, previous, current, plan, validated, event, horizon):
    rows = own.count()
    yield event("execute", "done", rows=rows)
    if not rows:
        yield event("complete", "done", status="insufficient_evidence", reason="no rows")
        return
    in_current = F.col("ds").between(F.lit(current[0]), F.lit(current[1]))
    quality = profiling.quality(profiling.issues(base)).first()
    yield event("profile", "done", quality=quality.quality_score)
    daily = rolled_up(metric, own, ["ds"])
    series = anomaly.prepared(daily, "ds", key)
    found = [r.asDict() for r in anomaly.detect(series).orderBy(F.abs("score").desc()).limit(10).collect()]
    yield event("anomaly", "done", anomalies=found)
    in_previous, mix = F.col("ds").between(F.lit(previous[0]), F.lit(previous[1])), None
    if "den" in own.columns:
        pairs, sides = rootcause.ratio_pairs(own, have, in_current, in_previous)
    else:
        pairs, sides = rootcause.paired(own, have, "num", in_current, in_previous), None
    total = rootcause.totals(pairs).first().asDict()
    drivers = [r.asDict() for r in rootcause.top(rootcause.drivers(pairs, have), 20).collect()] if have else []
    error = max((r.error or 0.0 for r in rootcause.reconciliation(pairs, have).collect()), default=0.0) if have else 0.0
    scale = max(1.0, abs(total["pct_change"] or 0.0))
    if sides is not None and drivers:
        lead = drivers[0]["dim"]
        parts = sides.groupBy(lead).agg(*[F.sum(c).alias(c) for c in ("prev_num", "prev_den", "curr_num", "curr_den")])
        mix = rootcause.mix_rate(parts, lead).first().asDict()
    yield event("root_cause", "done", drivers=drivers, reconciliation=error, mix_rate=mix)
    m = daily.groupBy(in_current.alias("is_current")).agg(F.count(key).alias("n"), F.avg(key).alias("mean"), F.var_samp(key).alias("var"))
    side = {r.is_current: r for r in m.collect()}
    test = stats.welch(*(v for s in (False, True) for v in ((side[s].n, side[s].mean, side[s]["var"] or 0.0) if s in side else (0, 0.0, 0.0))))
    yield event("significance", "done", test=test)
    seen = daily.agg(F.count("*").alias("n"), F.max("ds").alias("last")).first()
    points = seen.n
    if points >= forecast.LEAST_HISTORY:
        first = forecast.forecast(series, horizon).orderBy("step").collect()
        outlook = {"model": first[0].model, "mase": first[0].mase, "mape": first[0].mape, "folds": first[0].n_folds, "predicted": [r.predicted for r in first]}
        yield event("forecast", "done", forecast=outlook)
    else:
        outlook = None
        yield event("forecast", "skipped", reason=f"{points} points")
    advice = recommendations(drivers, total["pct_change"])
    yield event("recommend", "done", recommendations=advice)
    text = narrative(metric, total, drivers, test.significant)
    yield event("narrate", "done", narrative=text)
    evidence = {"sql": plan, "metric": key, "total": total, "drivers": drivers, "forecast": outlook}
    checks = critic.review(text, evidence, validated=validated, reconciliation=error / scale, significance={"significant": test.significant}, beats_baseline=outlook["model"] == "damped_holt_winters" if outlook else None, rows=rows)
    good = critic.approved(checks)
    confidence = stats.combine({
        "data": stats.score_data(quality.quality_score / 100, rows, (current[1] - seen.last).days),
        "statistical": stats.score_statistical(test.p_value, test.effect_size),
        "model": stats.score_model(outlook["mape"], outlook["model"] == "damped_holt_winters", outlook["folds"]) if outlook else 0.5,
        "reasoning": stats.score_reasoning(sum(c.passed for c in checks), len(checks), not good),
    })
    yield event("verify", "done", checks=checks, approved=good, confidence=confidence)
    answered = good and test.significant and bool(drivers)
    yield event("complete", "done", status="answered" if answered else "insufficient_evidence", narrative=text, drivers=drivers, total=total, test=test, confidence=confidence, recommendations=advice)


def markdown(result: dict) -> str:
    """A report of an investigation's last event."""
    lines = ["# Investigation", "", result["narrative"], "", f"Confidence: {result['confidence']['score']:.0%} ({result['confidence']['label']}), limited by {result['confidence']['limiting_factor']}.", "", "| dimension | segment | change | contribution |", "|-|-|-|-|"]
    lines += [f"| {d['dim']} | {d['seg']} | {d['delta']:,.2f} | {d['contribution_pct']:.1%} |" for d in result["drivers"]]
    lines += ["", *(f"- {r['recommendation']}: up to {r['expected_impact_absolute']:,.2f} if {r['assumption']}" for r in result["recommendations"])]
    return "\n".join(lines)
