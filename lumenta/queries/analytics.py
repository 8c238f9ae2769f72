"""What changed between two periods, panels, experiments and scenarios."""

from __future__ import annotations

from datetime import date

from pyspark.sql import functions as F

from lumenta.operators import panels, rootcause, simulation
from lumenta.queries.metrics import LINES, SALES, rounded
from lumenta.sources import tables

DIMS = ["region", "segment", "channel"]
TREATED, CUT = ["ASIA", "EUROPE"], date(2000, 1, 1)
LEVERS = [("discount", "ASIA", -0.1, 7), ("campaign", "ASIA", 0.25, 14), ("launch", "EUROPE", 0.05, 1)]


def _year(y: int):
    return F.col("order_date").between(F.lit(date(y, 1, 1)), F.lit(date(y, 12, 31)))


def pairs(spark, folder, dims=DIMS):
    return rootcause.paired(tables.sales(spark, folder, date(1999, 1, 1), date(2000, 12, 31)), dims, "total_amount", _year(2000), _year(1999))


def _drivers(spark, folder):
    out = rootcause.drivers(pairs(spark, folder), DIMS)
    return rounded(out.select("dim", "seg", "prev", "curr", "delta", "segment_pct_change", "contribution_pct", "share_of_change", "status"), 4)


def _skipped(spark, folder):
    own = pairs(spark, folder).where(F.col("region") == "ASIA")
    return rootcause.usable(rootcause.segments(own, DIMS))[1]


def _new_lost(spark, folder):
    segs = rootcause.segments(pairs(spark, folder, ["channel"]).where("channel <> '1-URGENT' or prev > 0"), ["channel"])
    return segs.select("seg", F.when((F.col("prev") != 0) & (F.col("curr") != 0), "changed").when(F.col("prev") == 0, "new").otherwise("lost").alias("status"))


def _mix_rate(spark, folder):
    rows = tables.sales_lines(spark, folder)
    side = lambda y, c: F.coalesce(F.sum(F.when(_year(y), F.col(c))), F.lit(0.0))
    own = rows.where(_year(1999) | _year(2000)).groupBy("category").agg(side(1999, "discount_amount").alias("prev_num"), side(1999, "gross_amount").alias("prev_den"), side(2000, "discount_amount").alias("curr_num"), side(2000, "gross_amount").alias("curr_den"))
    return rounded(rootcause.mix_rate(own, "category"), 8)


def _aligned(spark, folder):
    by = lambda y: tables.sales(spark, folder).where(_year(y)).groupBy("customer_id").agg(F.sum("total_amount").alias("v"))
    return rounded(rootcause.aligned(by(1999), by(2000), "customer_id", "v"), 4)


def _semi(spark, folder):
    some = tables.table(spark, folder, "region").where(F.col("r_name").isin(TREATED)).select(F.col("r_name").alias("region"))
    return tables.sales(spark, folder).join(some, "region", "left_semi").select("order_id", "region")


def _union(spark, folder):
    own = tables.sales(spark, folder)
    both = own.where(_year(1999)).withColumn("period", F.lit("prev")).unionByName(own.where(_year(2000)).withColumn("period", F.lit("curr")))
    return both.groupBy("period").agg(F.count("*").alias("n"))


def _panel(grain):
    return lambda spark, folder: rounded(panels.panel(tables.sales(spark, folder, date(1999, 1, 1), date(2000, 12, 31)), "region", "order_date", "total_amount", grain), 4)


def _panel_rows(spark, folder):
    return panels.panel(tables.sales(spark, folder, date(1999, 1, 1), date(2000, 12, 31)), "region", "order_date", "total_amount", "month")


def _trim(spark, folder):
    return panels.coverage(tables.sales(spark, folder, date(1999, 1, 4), date(2000, 12, 10)), "order_date", "month").select("period", F.col("days").cast("long").alias("days"), F.col("expected").cast("long").alias("expected"), "is_boundary", "kept")


def _baseline(spark, folder):
    return tables.sales(spark, folder, date(2000, 1, 1), date(2000, 12, 31)).groupBy(F.col("region").alias("segment")).agg((F.sum("total_amount") / 366).alias("daily"))


def _simulated(fn):
    return lambda spark, folder: rounded(fn(_baseline(spark, folder), simulation.levers(spark, LEVERS)), 2)


def _effect(spark, folder):
    """The whole estimate (two-way effects, clustered errors) of a panel that is sums by region and month."""
    e = panels.difference_in_differences(_panel_rows(spark, folder), TREATED, CUT)
    own = {k: v for k, v in vars(e).items() if isinstance(v, int | float | str | bool)}
    return spark.createDataFrame([(k, str(v)) for k, v in own.items()], "field string, value string")


QUERIES = {
    "rootcause_total": lambda s, f: rounded(rootcause.totals(pairs(s, f)), 4),
    "rootcause_drivers": _drivers,
    "rootcause_skipped": _skipped,
    "rootcause_reconcile": lambda s, f: rounded(rootcause.reconciliation(pairs(s, f), DIMS), 6),
    "rootcause_coverage": lambda s, f: rounded(rootcause.coverage(pairs(s, f), DIMS), 6),
    "mix_rate": _mix_rate,
    "join_full_outer_align": _aligned,
    "join_semi": _semi,
    "union_periods": _union,
    "segments_new_lost": _new_lost,
    "panel_week": _panel("week"),
    "panel_month": _panel("month"),
    "panel_trim": _trim,
    "panel_balance": lambda s, f: rounded(panels.balance(_panel_rows(s, f))),
    "did_means": lambda s, f: rounded(panels.double_difference(_panel_rows(s, f), TREATED, CUT), 2),
    "did_design_checks": lambda s, f: panels.design(_panel_rows(s, f), TREATED, CUT),
    "did_estimate": _effect,
    "simulate_paths": _simulated(lambda b, own: simulation.paths(b, own, 30)),
    "simulate_summary": _simulated(lambda b, own: simulation.summary(b, own, 30)),
    "simulate_levers": _simulated(lambda b, own: simulation.per_lever(b, own, 30)),
    "simulate_sensitivity": _simulated(lambda b, own: simulation.sensitivity(b, own, 30)),
    "simulate_break_even": _simulated(lambda b, own: simulation.break_even(b, "ASIA", 1e6, 30)),
}

_PAIRS = f"""pairs as (select region, segment, channel, coalesce(sum(case when year(order_date) = 1999 then total_amount end), 0) as prev, coalesce(sum(case when year(order_date) = 2000 then total_amount end), 0) as curr
 from {SALES} where year(order_date) in (1999, 2000) group by all)"""
_SEGS = " union all ".join(f"select '{d}' as dim, {d} as seg, sum(prev) as prev, sum(curr) as curr from pairs group by {d}" for d in DIMS)
_SEGS_ASIA = _SEGS.replace("from pairs", "from pairs where region = 'ASIA'")
_SIZED = f"""with {_PAIRS}, segs as ({_SEGS}), total as (select sum(prev) as pt, sum(curr) as ct from pairs), sized as (select dim, seg, prev, curr, curr - prev as delta, (curr - prev) / nullif(prev, 0) as segment_pct_change,
 (curr - prev) / pt as contribution_pct, abs(curr - prev) / abs(ct - pt) as share_of_change, case when prev <> 0 and curr <> 0 then 'changed' when prev = 0 then 'new' else 'lost' end as status, (ct - pt) / pt as pct_change, ct - pt as change from segs, total)"""
_PANEL = f"panel as (select region as unit, cast(date_trunc('month', order_date) as date) as period, sum(total_amount) as outcome from {SALES} where year(order_date) in (1999, 2000) group by all)"
_BASE = f"base as (select region as segment, sum(total_amount) / 366 as daily from {SALES} where year(order_date) = 2000 group by all)"
_LEVERS = "levers(lever, segment, change, ramp) as (values ('discount', 'ASIA', -0.1, 7), ('campaign', 'ASIA', 0.25, 14), ('launch', 'EUROPE', 0.05, 1)), days as (select unnest(range(30)) as day)"
_FACTOR = "(1 + change * least(1.0, (day + 1)::double / greatest(ramp, 1)))"
_PATHS = f"with {_BASE}, {_LEVERS}, f as (select segment, day, product({_FACTOR}) as factor from levers, days group by all), paths as (select segment, day, daily as baseline, daily * coalesce(factor, 1.0) as scenario from base cross join days left join f using (segment, day))"

ORACLE = {
    "rootcause_total": f"with {_PAIRS} select round(sum(prev), 4) as prev_total, round(sum(curr), 4) as curr_total, round(sum(curr) - sum(prev), 4) as absolute_change, round((sum(curr) - sum(prev)) / nullif(sum(prev), 0), 4) as pct_change from pairs",
    "rootcause_drivers": f"{_SIZED} select dim, seg, round(prev, 4) as prev, round(curr, 4) as curr, round(delta, 4) as delta, round(segment_pct_change, 4) as segment_pct_change, round(contribution_pct, 4) as contribution_pct, round(share_of_change, 4) as share_of_change, status from sized where abs(contribution_pct) >= 0.005",
    "rootcause_skipped": f"with {_PAIRS}, segs as ({_SEGS_ASIA}) select dim, count(*) as n_values from segs group by dim having count(*) < 2",
    "rootcause_reconcile": f"{_SIZED} select dim, round(sum(contribution_pct), 6) as contribution_sum, round(max(pct_change), 6) as pct_change, round(abs(sum(contribution_pct) - max(pct_change)), 6) as error from sized group by dim",
    "rootcause_coverage": f"{_SIZED}, own as (select * from sized where abs(contribution_pct) >= 0.005), lead as (select dim from own order by abs(contribution_pct) desc, dim desc limit 1) select dim as top_dim, round(least(1.0, sum(abs(delta)) / abs(max(change))), 6) as coverage from (select own.* from own join lead using (dim) order by abs(contribution_pct) desc, seg limit 5) group by dim",
    "mix_rate": f"""with p as (select category, coalesce(sum(case when year(order_date) = 1999 then discount_amount end), 0) as pn, coalesce(sum(case when year(order_date) = 1999 then gross_amount end), 0) as pd, coalesce(sum(case when year(order_date) = 2000 then discount_amount end), 0) as cn,
 coalesce(sum(case when year(order_date) = 2000 then gross_amount end), 0) as cd from {LINES} where year(order_date) in (1999, 2000) group by category), w as (select coalesce(pd / nullif(sum(pd) over (), 0), 0) as pw, coalesce(cd / nullif(sum(cd) over (), 0), 0) as cw, coalesce(pn / nullif(pd, 0), 0) as pr, coalesce(cn / nullif(cd, 0), 0) as cr from p),
 e as (select sum((cw - pw) * pr) as m, sum((cr - pr) * pw) as r, sum((cw - pw) * (cr - pr)) as i from w) select round(m, 8) as mix_effect, round(r, 8) as rate_effect, round(i, 8) as interaction_effect, case when abs(m) >= abs(r) and abs(m) >= abs(i) then 'mix' when abs(r) >= abs(i) then 'rate' else 'interaction' end as dominant from e""",
    "join_full_outer_align": f"select coalesce(a.customer_id, b.customer_id) as customer_id, round(coalesce(a.v, 0), 4) as prev, round(coalesce(b.v, 0), 4) as curr from (select customer_id, sum(total_amount) as v from {SALES} where year(order_date) = 1999 group by 1) a full join (select customer_id, sum(total_amount) as v from {SALES} where year(order_date) = 2000 group by 1) b on a.customer_id = b.customer_id",
    "join_semi": f"select order_id, region from {SALES} where region in (select r_name from region where r_name in ('ASIA', 'EUROPE'))",
    "union_periods": f"select case when year(order_date) = 1999 then 'prev' else 'curr' end as period, count(*) as n from {SALES} where year(order_date) in (1999, 2000) group by 1",
    "segments_new_lost": f"with {_PAIRS}, s as (select channel as seg, sum(prev) as prev, sum(curr) as curr from pairs group by 1) select seg, case when prev <> 0 and curr <> 0 then 'changed' when prev = 0 then 'new' else 'lost' end as status from s where seg <> '1-URGENT' or prev > 0",
    **{f"panel_{g}": f"select region as unit, cast(date_trunc('{g}', order_date) as date) as period, round(sum(total_amount), 4) as outcome from {SALES} where year(order_date) in (1999, 2000) group by all" for g in ("week", "month")},
    "panel_trim": f"""with d as (select cast(date_trunc('month', order_date) as date) as period, count(distinct order_date) as days from {SALES} where order_date between date '1999-01-04' and date '2000-12-10' group by all), x as (select *, cast(day(last_day(period)) as bigint) as expected, period = min(period) over () or period = max(period) over () as is_boundary from d)
 select period, days, expected, is_boundary, not is_boundary or days / expected >= 0.8 as kept from x""",
    "panel_balance": f"with {_PANEL}, n as (select unit, count(*) as n from panel group by unit) select count(*) as n_units, min(n) as least, max(n) as most, round(max(n) / min(n), 6) as ratio from n",
    "did_means": f"""with {_PANEL}, m as (select avg(case when unit in ('ASIA', 'EUROPE') and period < date '2000-01-01' then outcome end) as a, avg(case when unit in ('ASIA', 'EUROPE') and period >= date '2000-01-01' then outcome end) as b, avg(case when unit not in ('ASIA', 'EUROPE') and period < date '2000-01-01' then outcome end) as c,
 avg(case when unit not in ('ASIA', 'EUROPE') and period >= date '2000-01-01' then outcome end) as d from panel) select round(a, 2) as treated_pre, round(b, 2) as treated_post, round(c, 2) as control_pre, round(d, 2) as control_post, round((b - a) - (d - c), 2) as effect from m""",
    "did_design_checks": f"""with {_PANEL}, d as (select count(distinct unit) filter (unit in ('ASIA', 'EUROPE')) as n_treated, count(distinct unit) filter (unit not in ('ASIA', 'EUROPE')) as n_control, count(distinct period) filter (period < date '2000-01-01') as pre_periods, count(distinct period) filter (period >= date '2000-01-01') as post_periods from panel)
 select n_treated, n_control, 2 - n_treated as unknown_treated, pre_periods, post_periods, n_treated > 0 and n_control > 0 and n_treated = 2 and pre_periods >= 3 and post_periods >= 3 as usable from d""",
    "simulate_paths": f"{_PATHS} select segment, cast(day as int) as day, round(baseline, 2) as baseline, round(scenario, 2) as scenario from paths",
    "simulate_summary": f"{_PATHS} select round(sum(baseline), 2) as baseline_total, round(sum(scenario), 2) as scenario_total, round(sum(scenario) - sum(baseline), 2) as absolute_change, round((sum(scenario) - sum(baseline)) / sum(baseline), 2) as pct_change, round(sum(scenario) * 0.9, 2) as lower, round(sum(scenario) * 1.1, 2) as upper from paths",
    "simulate_levers": f"with {_BASE}, {_LEVERS}, i as (select lever, segment, sum(daily * ({_FACTOR} - 1)) as impact from levers join base using (segment) cross join days group by all) select lever, segment, round(impact, 2) as impact, round(impact / sum(impact) over (), 2) as share from i",
    "simulate_sensitivity": f"""with {_BASE}, {_LEVERS}, sides(side, scale) as (values ('low', 0.5), ('high', 1.5)), varied as (select distinct lever as varied from levers),
 cases as (select varied, side, segment, ramp, case when lever = varied then change * scale else change end as change from levers, varied, sides), f as (select varied, side, segment, day, product({_FACTOR}) as factor from cases, days group by all),
 m as (select varied, side, sum(daily * (factor - 1)) as impact from f join base using (segment) group by all), o as (select varied as lever, sum(impact) filter (side = 'low') as low, sum(impact) filter (side = 'high') as high from m group by 1) select lever, round(low, 2) as low, round(high, 2) as high, round(abs(high - low), 2) as swing from o""",
    "simulate_break_even": f"with {_BASE} select segment, round(daily * 30, 2) as unit_delta, round(1e6 / (daily * 30), 2) as required_change from base where segment = 'ASIA'",
}
