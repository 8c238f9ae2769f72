"""Unit-by-period panels, and difference-in-differences on them."""

from __future__ import annotations

from dataclasses import dataclass, field
from datetime import date, datetime

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenta.functions.stats import t_critical, t_p
from lumenta.sources.durable import durable

LEAST_COVERAGE = 0.8


def panel(frame: DataFrame, unit: str, ds: str, y: str, grain: str) -> DataFrame:
    """unit, period, outcome: sums by period (day, week from Monday, or month); rows with a null in any of the three don't count."""
    rows = frame.select(F.col(unit).cast("string").alias("unit"), F.col(ds).cast("date").alias("ds"), F.col(y).cast("double").alias("y")).dropna()
    return rows.groupBy("unit", F.date_trunc(grain, "ds").cast("date").alias("period")).agg(F.sum("y").alias("outcome"))


def coverage(frame: DataFrame, ds: str, grain: str) -> DataFrame:
    """period, days, expected, coverage, is_boundary, kept: a first or last period with under 80 % of its days is dropped."""
    days = frame.select(F.col(ds).cast("date").alias("ds")).dropna().groupBy(F.date_trunc(grain, "ds").cast("date").alias("period")).agg(F.countDistinct("ds").alias("days"))
    expected = {"day": F.lit(1), "week": F.lit(7), "month": F.dayofmonth(F.last_day("period"))}[grain]
    ends = days.agg(F.min("period").alias("first"), F.max("period").alias("last"))
    out = days.crossJoin(F.broadcast(ends)).withColumn("expected", expected).withColumn("coverage", F.col("days") / F.col("expected"))
    edge = (F.col("period") == F.col("first")) | (F.col("period") == F.col("last"))
    return out.select("period", "days", "expected", "coverage", edge.alias("is_boundary"), (~edge | (F.col("coverage") >= LEAST_COVERAGE)).alias("kept"))


def trimmed(frame: DataFrame, unit: str, ds: str, y: str, grain: str) -> DataFrame:
    kept = coverage(frame, ds, grain).where("kept").select("period")
    return panel(frame, unit, ds, y, grain).join(kept, "period", "left_semi").select("unit", "period", "outcome")


def balance(rows: DataFrame) -> DataFrame:
    """n_units, least, most, ratio of rows by unit."""
    sizes = rows.groupBy("unit").agg(F.count("*").alias("n"))
    return sizes.agg(F.count("*").alias("n_units"), F.min("n").alias("least"), F.max("n").alias("most"), (F.max("n") / F.min("n")).alias("ratio"))


def double_difference(rows: DataFrame, treated: list[str], cut) -> DataFrame:
    """treated_pre, treated_post, control_pre, control_post (means of outcomes) and effect; exact for balanced panels."""
    t, post = F.col("unit").isin(treated), F.col("period") >= F.lit(cut)
    mean = lambda c: F.avg(F.when(c, F.col("outcome")))
    m = rows.agg(mean(t & ~post).alias("treated_pre"), mean(t & post).alias("treated_post"), mean(~t & ~post).alias("control_pre"), mean(~t & post).alias("control_post"))
    return m.withColumn("effect", (F.col("treated_post") - F.col("treated_pre")) - (F.col("control_post") - F.col("control_pre")))


def design(rows: DataFrame, treated: list[str], cut) -> DataFrame:
    """n_treated, n_control, unknown_treated, pre_periods, post_periods, usable."""
    t, post = F.col("unit").isin(treated), F.col("period") >= F.lit(cut)
    distinct = lambda c, x: F.countDistinct(F.when(c, F.col(x)))
    d = rows.agg(distinct(t, "unit").alias("n_treated"), distinct(~t, "unit").alias("n_control"), distinct(~post, "period").alias("pre_periods"), distinct(post, "period").alias("post_periods"))
    d = d.withColumn("unknown_treated", F.lit(len(set(treated))) - F.col("n_treated"))
    return d.select("n_treated", "n_control", "unknown_treated", "pre_periods", "post_periods", ((F.col("n_treated") > 0) & (F.col("n_control") > 0) & (F.col("unknown_treated") == 0) & (F.col("pre_periods") >= 3) & (F.col("post_periods") >= 3)).alias("usable"))


@dataclass
class Effect:
    refused: str | None = None
    effect: float | None = None
    se: float | None = None
    p_value: float | None = None
    interval: tuple[float, float] | None = None
    diagnostics: dict = field(default_factory=dict)
    caveats: list[str] = field(default_factory=list)

    @property
    def significant(self) -> bool:
        return self.p_value is not None and self.p_value < 0.05

    @property
    def credible(self) -> bool:
        return self.refused is None and all(d["passed"] for d in self.diagnostics.values())

    def text(self) -> str:
        if self.refused:
            return f"No estimate: {self.refused}."
        if not self.credible:
            return f"The estimate {self.effect:,.2f} is not credible: {', '.join(k for k, d in self.diagnostics.items() if not d['passed'])} failed."
        low, high = self.interval
        return f"Effect {self.effect:,.2f} (95 % interval {low:,.2f} to {high:,.2f}, p = {self.p_value:.3f}){'' if self.significant else '; not significant'}."


def _fit(rows: DataFrame) -> tuple[float, float, float, float]:
    """(estimate, se, p, degrees of freedom) of term beside unit and period effects, clustered by unit, from rows (unit, period, y, term).

    Unit effects go by taking units' means off, so only periods meet in a matrix; it is made of sums, and so is each unit's
    score. The driver gets sums by period and by pairs of periods, nothing by unit.
    """
    means = rows.groupBy("unit").agg(F.avg("y").alias("y_u"), F.avg("term").alias("term_u"), F.count("*").alias("n_u"))
    own = durable(rows.join(means, "unit").select("unit", "period", "n_u", (F.col("y") - F.col("y_u")).alias("y"), (F.col("term") - F.col("term_u")).alias("x")))
    by = {r.period: r for r in own.groupBy("period").agg(F.count("*").alias("n"), F.sum("y").alias("y"), F.sum("x").alias("x")).collect()}
    at = {p: i for i, p in enumerate(sorted(by)[1:], 1)}  # the first period is the base
    total = own.agg(F.count("*").alias("n"), F.sum(F.col("x") * F.col("x")).alias("xx"), F.sum(F.col("x") * F.col("y")).alias("xy"), F.countDistinct("unit").alias("g")).first()
    k = len(at) + 1
    xtx, xty = np.zeros((k, k)), np.zeros(k)
    xtx[0, 0], xty[0] = total.xx, total.xy
    for p, i in at.items():
        xtx[i, i], xtx[0, i], xtx[i, 0], xty[i] = by[p].n, by[p].x, by[p].x, by[p].y
    held = own.groupBy("unit", "n_u").agg(F.collect_list("period").alias("ps"))  # as long as a unit's history
    pairs = held.select("n_u", "ps", F.explode("ps").alias("p")).select("n_u", "p", F.explode("ps").alias("q")).groupBy("p", "q").agg(F.sum(1 / F.col("n_u")).alias("s"))
    for r in pairs.collect():
        if r.p in at and r.q in at:
            xtx[at[r.p], at[r.q]] -= r.s
    bread = np.linalg.pinv(xtx)
    beta = bread @ xty
    spark = rows.sparkSession
    known = spark.createDataFrame([(p, float(beta[at[p]]) if p in at else 0.0, float(bread[0, at[p]]) if p in at else 0.0) for p in by], rows.select("period").schema.add("b", "double").add("w", "double"))
    joined = own.join(F.broadcast(known), "period")  # one row for each period
    unit = joined.groupBy("unit").agg(F.avg("b").alias("b_u"), F.avg("w").alias("w_u"))
    resid = F.col("y") - float(beta[0]) * F.col("x") - (F.col("b") - F.col("b_u"))
    scores = joined.join(unit, "unit").groupBy("unit").agg(F.sum((float(bread[0, 0]) * F.col("x") + F.col("w") - F.col("w_u")) * resid).alias("s"))
    meat = scores.agg(F.sum(F.col("s") * F.col("s"))).first()[0] or 0.0
    n, g = total.n, total.g
    v = g / max(1, g - 1) * (n - 1) / max(1, n - (g + k)) * meat
    se, dof = float(np.sqrt(max(v, 0.0))), g - 1
    return float(beta[0]), se, t_p(beta[0] / se, dof) if se > 1e-12 and dof > 0 else 1.0, dof


def difference_in_differences(rows: DataFrame, treated: list[str], cut) -> Effect:
    """Two-way fixed effects over the panel (unit, period, outcome), with a pre-trend and a placebo test. cut may be an ISO date."""
    checks = design(rows, treated, cut).first()
    if not checks.usable:
        why = "no control units" if not checks.n_control else "treated units are not in the panel" if checks.unknown_treated or not checks.n_treated else "fewer than 3 periods before or after the cut"
        return Effect(refused=why)
    rows = rows.where("unit is not null and period is not null and outcome is not null")
    periods = sorted(r.period for r in rows.select("period").distinct().collect())
    if isinstance(cut, str) and isinstance(periods[0], date):
        cut = datetime.fromisoformat(cut) if isinstance(periods[0], datetime) else date.fromisoformat(cut[:10])
    n_pre = sum(p < cut for p in periods)
    order = rows.sparkSession.createDataFrame([(p, i) for i, p in enumerate(periods)], rows.select("period").schema.add("order", "integer"))
    own = durable(rows.join(F.broadcast(order), "period").select(F.col("unit").cast("string").alias("unit"), "period", "order", F.col("outcome").cast("double").alias("y")))
    is_treated, post = F.col("unit").isin(treated).cast("double"), F.col("order") >= n_pre
    fit = lambda frame, term: _fit(frame.select("unit", "period", "y", term.cast("double").alias("term")))
    b, se, p, dof = fit(own, is_treated * post.cast("double"))
    half = t_critical(dof) * se
    out = Effect(None, b, se, p, (b - half, b + half))
    pre = own.where(~post)
    m = pre.agg(F.avg("order").alias("mean"), F.stddev_pop("order").alias("sd")).first()
    tb, _, tp, _ = fit(pre, is_treated * (F.col("order") - m["mean"]) / (m.sd or 1.0))
    out.diagnostics["parallel_trends"] = {"slope": tb, "p_value": tp, "passed": n_pre >= 3 and tp >= 0.10}
    if n_pre >= 6:
        pb, _, pp, _ = fit(pre, is_treated * (F.col("order") >= n_pre // 2).cast("double"))
        out.diagnostics["placebo"] = {"effect": pb, "p_value": pp, "passed": pp >= 0.05}
    sizes = own.groupBy("unit").agg(F.count("*").alias("n")).agg(F.max("n").alias("most"), F.min("n").alias("least")).first()
    if dof + 1 < 10:
        out.caveats.append(f"only {dof + 1} clusters; intervals are wide and approximate")
    if checks.n_control == 1:
        out.caveats.append("a single control unit carries the comparison")
    if sizes.most / sizes.least > 3:
        out.caveats.append("the panel is unbalanced")
    return out
