"""The governed metrics, their daily frames, aggregates and the anchors of evaluations."""

from __future__ import annotations

from datetime import date

from pyspark.sql import functions as F

from lumenta.plans import semantic
from lumenta.sources import tables

START, END = date(2000, 1, 1), date(2000, 12, 31)
#: The governed view of completed sales, in DuckDB's words.
SALES = """(select o_orderkey as order_id, o_custkey as customer_id, cast(o_orderdate as date) as order_date, o_orderstatus as status, o_totalprice as total_amount,
 o_orderpriority as channel, c_mktsegment as segment, r_name as region from orders join customer on o_custkey = c_custkey join nation on c_nationkey = n_nationkey
 join region on n_regionkey = r_regionkey where o_orderstatus = 'F')"""
LINES = """(select l_orderkey as order_id, cast(o_orderdate as date) as order_date, p_type as category, l_extendedprice as gross_amount, l_extendedprice * l_discount as discount_amount
 from lineitem join orders on l_orderkey = o_orderkey left join part on l_partkey = p_partkey where o_orderstatus = 'F')"""
TICKETS = "(select cast(ts as date) as created_date, event_type as category, value as hours, least(5.0, greatest(1.0, value)) as csat from events)"
IN_2000 = "order_date between date '2000-01-01' and date '2000-12-31'"


def rounded(df, digits: int = 6):
    """Doubles to a number of digits: sums in another order differ in the last bits."""
    return df.select(*[F.round(c, digits).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


def _metric(key: str, view, dims: list[str], grain: str = "month", digits: int = 4):
    def run(spark, folder):
        metric = semantic.default_registry().approved(key)
        out = semantic.metric_frame(view(spark, folder), metric, START if metric.date_column == "order_date" else None, END if metric.date_column == "order_date" else None, dims, grain)
        return rounded(out.select("ds", *dims, F.col(key).cast("double").alias(key)), digits)

    return run


def _agg(name: str, column):
    return lambda spark, folder: rounded(tables.sales(spark, folder).groupBy("region").agg(column().alias(name)))


def _churn(spark, folder):
    out = semantic.churn(tables.sales(spark, folder), "customer_id", "order_date", START, END, ["region"])
    return rounded(out.select("region", "churned", "active_at_start", "churn_rate"))


def _daily_by_dims(spark, folder):
    metric = semantic.default_registry().approved("revenue")
    return rounded(semantic.metric_frame(tables.sales(spark, folder), metric, START, END).select("ds", "region", "segment", "channel", "revenue"), 4)


def _conditional_distinct(spark, folder):
    big = F.when(F.col("total_amount") > 100000, F.col("customer_id"))
    return tables.sales(spark, folder).groupBy("region").agg(F.countDistinct(big).alias("big_buyers"))


def _ratio(spark, folder):
    own = tables.sales_lines(spark, folder).groupBy("category").agg((F.sum("discount_amount") / F.nullif(F.sum("gross_amount"), F.lit(0.0))).alias("discount_rate"))
    return rounded(own, 8)


def _series_segment(spark, folder):
    metric = semantic.default_registry().approved("average_order_value")
    own = semantic.metric_frame(tables.sales(spark, folder).where(F.col("region") == "ASIA"), metric, START, END, [])
    return rounded(own.select("ds", F.col("average_order_value").alias("y")))


def _baseline(spark, folder):
    return rounded(semantic.segment_baseline(tables.sales(spark, folder, START, END), "region", "total_amount", 366), 4)


def _anchor(spark, folder):
    return tables.anchor(tables.table(spark, folder, "orders"), "o_orderdate", date(2001, 8, 15))


def _search(spark, folder):
    hits = semantic.default_registry().search("average order value by region")
    return spark.createDataFrame([(k, s) for k, s in hits], "metric string, score int")


def _row_cap(spark, folder):
    return tables.capped(tables.table(spark, folder, "orders"), 1000)[1].select(F.col("row_count").cast("long").alias("row_count"), "truncated")


def _topk(spark, folder):
    return tables.table(spark, folder, "orders").select("o_orderkey", "o_totalprice").orderBy(F.col("o_totalprice").desc(), "o_orderkey").offset(10).limit(20)


def _approx(spark, folder):
    return tables.approx_rows(tables.table(spark, folder, "lineitem"))


_DIMS = ["region"]
QUERIES = {
    "metric_revenue": _metric("revenue", tables.sales, _DIMS),
    "metric_order_count": _metric("order_count", tables.sales, _DIMS),
    "metric_average_order_value": _metric("average_order_value", tables.sales, _DIMS, digits=6),
    "metric_churn_rate": _churn,
    "metric_support_first_response_hours": _metric("support_first_response_hours", tables.tickets, ["category"], "week", 8),
    "metric_csat": _metric("csat", tables.tickets, ["category"], "week", 8),
    "metric_discount_rate": _metric("discount_rate", tables.sales_lines, ["category"], digits=8),
    "metric_daily_by_dims": _daily_by_dims,
    "metric_series_segment": _series_segment,
    "metric_search": _search,
    "segment_baseline": _baseline,
    "agg_sum": _agg("v", lambda: F.sum("total_amount")),
    "agg_avg": _agg("v", lambda: F.avg("total_amount")),
    "agg_min": _agg("v", lambda: F.min("total_amount")),
    "agg_max": _agg("v", lambda: F.max("total_amount")),
    "agg_count": _agg("v", lambda: F.count("order_id")),
    "agg_count_distinct": _agg("v", lambda: F.countDistinct("customer_id")),
    "agg_ratio_nullif": _ratio,
    "agg_conditional_distinct": _conditional_distinct,
    "evaluation_anchor": _anchor,
    "row_cap": _row_cap,
    "approx_rows": _approx,
    "topk_offset": _topk,
}


def _monthly(key: str, measure: str, digits: int = 4) -> str:
    return f"select cast(date_trunc('month', order_date) as date) as ds, region, round({measure}, {digits}) as {key} from {SALES} where {IN_2000} group by all"


def _weekly(key: str) -> str:
    column = "hours" if key.endswith("hours") else "csat"
    return f"select cast(date_trunc('week', created_date) as date) as ds, category, round(avg({column}), 8) as {key} from {TICKETS} group by all"


ORACLE = {
    "metric_revenue": _monthly("revenue", "sum(total_amount)"),
    "metric_order_count": _monthly("order_count", "cast(count(order_id) as double)"),
    "metric_average_order_value": _monthly("average_order_value", "sum(total_amount) / count(order_id)", 6),
    "metric_churn_rate": f"""select region, cast(sum(case when l <= date '2000-12-31' then 1 else 0 end) as bigint) as churned, count(*) as active_at_start, round(sum(case when l <= date '2000-12-31' then 1 else 0 end) / count(*), 6) as churn_rate
 from (select customer_id, region, min(order_date) as f, max(order_date) as l from {SALES} group by all) where f < date '2000-01-01' and l >= date '2000-01-01' group by region""",
    "metric_support_first_response_hours": _weekly("support_first_response_hours"),
    "metric_csat": _weekly("csat"),
    "metric_discount_rate": f"select cast(date_trunc('month', order_date) as date) as ds, category, round(sum(discount_amount) / nullif(sum(gross_amount), 0), 8) as discount_rate from {LINES} where {IN_2000} group by all",
    "metric_daily_by_dims": f"select order_date as ds, region, segment, channel, round(sum(total_amount), 4) as revenue from {SALES} where {IN_2000} group by all",
    "metric_series_segment": f"select order_date as ds, round(sum(total_amount) / count(*), 6) as y from {SALES} where {IN_2000} and region = 'ASIA' group by all",
    "segment_baseline": f"select region, round(sum(total_amount) / 366, 4) as daily from {SALES} where {IN_2000} group by all",
    **{f"agg_{n}": f"select region, {e} as v from {SALES} group by region" for n, e in (("sum", "round(sum(total_amount), 6)"), ("avg", "round(avg(total_amount), 6)"), ("min", "min(total_amount)"), ("max", "max(total_amount)"), ("count", "count(order_id)"), ("count_distinct", "count(distinct customer_id)"))},
    "agg_ratio_nullif": f"select category, round(sum(discount_amount) / nullif(sum(gross_amount), 0), 8) as discount_rate from {LINES} group by category",
    "agg_conditional_distinct": f"select region, count(distinct case when total_amount > 100000 then customer_id end) as big_buyers from {SALES} group by region",
    "evaluation_anchor": "select d as latest_date, cast(date '2001-08-15' - d as int) as days_behind, date '2001-08-15' - d > 7 as is_stale from (select cast(max(o_orderdate) as date) as d from orders)",
    "row_cap": "select least(count(*), 1000) as row_count, count(*) > 1000 as truncated from orders",
    "approx_rows": "select least(count(*), 1000000) as approx_rows from lineitem",
    "topk_offset": "select o_orderkey, o_totalprice from orders order by o_totalprice desc, o_orderkey limit 20 offset 10",
}
