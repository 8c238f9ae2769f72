"""Profiles of tables, personal data in columns, and the parts of gated model training."""

from __future__ import annotations

from pyspark.sql import functions as F

from lumenta.operators import ml, profiling
from lumenta.queries.metrics import rounded
from lumenta.sources import tables


def _orders(spark, folder):
    return tables.table(spark, folder, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderpriority")


def _held(spark, folder):
    return tables.table(spark, folder, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity")


def _lines(spark, folder):
    return tables.table(spark, folder, "lineitem").select("l_quantity", "l_extendedprice", "l_discount", "l_tax")


def training(spark, folder):
    """doc_id, toxic, n_chars, n_words, share_upper, lang of labelled documents."""
    docs, labels = tables.table(spark, folder, "documents"), tables.table(spark, folder, "labels")
    n = F.length("text")
    own = docs.select("doc_id", "lang", F.col("n_chars").cast("double").alias("n_chars"), F.size(F.split("text", " ")).cast("double").alias("n_words"), (F.length(F.regexp_replace("text", "[^A-Z]", "")) / F.nullif(n, F.lit(0))).alias("share_upper"))
    return own.join(labels.select("doc_id", "toxic", (1 - F.col("quality")).alias("bad")), "doc_id")


def _trained(spark, folder):
    return ml.train(training(spark, folder), "bad", key="doc_id", skip=("doc_id", "toxic"))


def _training(spark, folder):
    return spark.createDataFrame([(k, str(v)) for k, v in _trained(spark, folder).record().items()], "field string, value string")


def _importance(spark, folder):
    """The features by how much the error grows without their order, the most important first."""
    return spark.createDataFrame([(c, float(x)) for c, x in _trained(spark, folder).importances], "feature string, importance double")


QUERIES = {
    "profile_nulls": lambda s, f: rounded(profiling.nulls(_orders(s, f))),
    "profile_numeric": lambda s, f: rounded(profiling.numeric(_lines(s, f)), 6),
    "profile_outliers": lambda s, f: rounded(profiling.outliers(_lines(s, f)), 6),
    "profile_top_values": lambda s, f: profiling.top_values(_orders(s, f), ["o_orderstatus", "o_orderpriority", "o_custkey"]).select("column_name", "value", "count"),
    "profile_duplicates": lambda s, f: profiling.duplicates(tables.table(s, f, "lineitem").select("l_orderkey", "l_linenumber")),
    "profile_key_unique": lambda s, f: profiling.key_repeats(tables.table(s, f, "lineitem"), ["l_orderkey", "l_linenumber"]),
    "profile_correlation": lambda s, f: rounded(profiling.correlations(_lines(s, f), least=0.0)),
    "profile_roles": lambda s, f: profiling.roles(_orders(s, f)),
    "profile_issues": lambda s, f: profiling.issues(_held(s, f), [["l_orderkey", "l_linenumber"]]),
    "quality_score": lambda s, f: profiling.quality(profiling.issues(tables.table(s, f, "lineitem").select("l_orderkey", "l_linenumber"))),
    "pii_scan": lambda s, f: profiling.personal_columns(tables.table(s, f, "customer")),
    "ml_task_detect": lambda s, f: ml.task(training(s, f), "toxic"),
    "ml_guards": lambda s, f: ml.guards(training(s, f), "toxic"),
    "ml_temporal_split": lambda s, f: ml.temporal_split(_orders(s, f).select("o_orderkey", "o_totalprice"), "o_totalprice", "o_orderkey").select("o_orderkey", "is_train"),
    "ml_baseline": lambda s, f: rounded(ml.baseline(training(s, f), "toxic")),
    "ml_auc_rank": lambda s, f: rounded(ml.auc(training(s, f), "n_chars", "toxic")),
    "ml_average_precision": lambda s, f: rounded(ml.average_precision(training(s, f), "n_chars", "toxic")),
    "ml_brier": lambda s, f: rounded(ml.brier(training(s, f).withColumn("p", F.lit(0.2)), "p", "toxic")),
    "ml_leakage_auc": lambda s, f: rounded(ml.leakage(training(s, f).withColumn("leak", F.col("toxic") * 2.0), ["n_chars", "leak"], "toxic")),
    "ml_train": _training,
    "ml_importance": _importance,
}

_TRAIN = "t as (select doc_id, toxic, cast(n_chars as double) as x from documents join labels using (doc_id))"
_NUMBER = "when count(distinct {0}) > 20 then 'measure' else 'dimension'"
_OTHER = "when count(distinct {0}) <= greatest(50.0, count(*) * 0.05) then 'dimension' else 'text'"
_QUANT = ("l_quantity", "l_extendedprice", "l_discount", "l_tax")


def _auc(score: str, name: str) -> str:
    return f"select '{name}' as feature, round((sum(case when toxic = 1 then r end) - max(np) * (max(np) + 1) / 2) / max(np * nn), 6) as auc from (select toxic, (count(*) over (order by {score} range between unbounded preceding and current row) + count(*) over (order by {score} range between unbounded preceding and current row exclude group) + 1) / 2 as r, sum(toxic) over () as np, sum(1 - toxic) over () as nn from t)"


ORACLE = {
    "profile_nulls": " union all ".join(f"select '{c}' as column_name, count(*) as row_count, count({c}) as non_null, round(1 - count({c}) / count(*), 6) as null_pct, count(distinct {c}) as unique_count from orders" for c in ("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderpriority")),
    "profile_numeric": " union all ".join(
        f"select '{c}' as column_name, round(min({c}), 6) as min, round(max({c}), 6) as max, round(avg({c}), 6) as mean, round(stddev_samp({c}), 6) as std, round(quantile_cont({c}, 0.25), 6) as p25, round(quantile_cont({c}, 0.5), 6) as median, round(quantile_cont({c}, 0.75), 6) as p75, round(quantile_cont({c}, 0.95), 6) as p95, count(*) filter ({c} = 0) as zeros, count(*) filter ({c} < 0) as negatives from lineitem"
        for c in _QUANT
    ),
    "profile_outliers": " union all ".join(
        f"select '{c}' as column_name, round(max(lo), 6) as lower, round(max(hi), 6) as upper, count(*) filter ({c} < lo or {c} > hi) as outlier_count from lineitem, (select quantile_cont({c}, 0.25) - 1.5 * (quantile_cont({c}, 0.75) - quantile_cont({c}, 0.25)) as lo, quantile_cont({c}, 0.75) + 1.5 * (quantile_cont({c}, 0.75) - quantile_cont({c}, 0.25)) as hi from lineitem)"
        for c in _QUANT
    ),
    "profile_top_values": " union all ".join(f"(select '{c}' as column_name, cast({c} as varchar) as value, count(*) as count from orders where {c} is not null group by {c} order by count(*) desc, cast({c} as varchar) limit 5)" for c in ("o_orderstatus", "o_orderpriority", "o_custkey")),
    "profile_duplicates": "select cast(sum(n) as bigint) as row_count, count(*) as distinct_rows, cast(sum(n) - count(*) as bigint) as duplicate_rows from (select count(*) as n from lineitem group by l_orderkey, l_linenumber)",
    "profile_key_unique": "select cast(sum(n) as bigint) as row_count, count(*) as distinct_keys, cast(sum(n) - count(*) as bigint) as repeated, sum(n) = count(*) as is_unique from (select count(*) as n from lineitem group by l_orderkey, l_linenumber)",
    "profile_correlation": "select a, b, round(r, 6) as pearson_r, case when abs(r) >= 0.8 then 'strong' else 'moderate' end as strength from (" + " union all ".join(f"select '{a}' as a, '{b}' as b, corr({a}, {b}) as r from lineitem" for i, a in enumerate(_QUANT) for b in _QUANT[i + 1 :]) + ")",
    "profile_roles": " union all ".join(
        f"select '{c}' as column_name, case when count(distinct {c}) = count(*) and count(*) > 0 then 'identifier' {kind} end as role from orders"
        for c, kind in (("o_orderkey", _NUMBER.format("o_orderkey")), ("o_custkey", _NUMBER.format("o_custkey")), ("o_totalprice", _NUMBER.format("o_totalprice")), ("o_orderstatus", _OTHER.format("o_orderstatus")), ("o_orderpriority", _OTHER.format("o_orderpriority")))
    ),
    "profile_issues": """with d as (select count(*) as rows, count(distinct (l_orderkey, l_linenumber, l_quantity)) as whole, count(distinct (l_orderkey, l_linenumber)) as keys from lineitem)
 select 'duplicate_rows' as code, case when (rows - whole) / rows > 0.02 then 'high' else 'medium' end as severity, cast(null as varchar) as column_name, rows - whole as affected_rows, case when (rows - whole) / rows > 0.02 then 10.0 else 4.0 end::double as penalty from d where rows > whole
 union all select 'key_not_unique', 'critical', 'l_orderkey,l_linenumber', rows - keys, 20.0::double from d where rows > keys""",
    "quality_score": "select greatest(0.0, 100.0 - case when count(*) = count(distinct (l_orderkey, l_linenumber)) then 0.0 when (count(*) - count(distinct (l_orderkey, l_linenumber))) / count(*) > 0.02 then 10.0 else 4.0 end)::double as quality_score, cast(count(*) > count(distinct (l_orderkey, l_linenumber)) as bigint) as n_issues from lineitem",
    "ml_task_detect": f"with {_TRAIN} select count(distinct toxic) as n_values, case when count(distinct toxic) = 2 then 'binary' when count(distinct toxic) > 20 then 'regression' else 'refused' end as task from t",
    "ml_guards": f"with {_TRAIN}, c as (select toxic, count(*) as n from t group by 1) select cast(sum(n) as bigint) as n_rows, min(n) as least_class, sum(n) >= 200 as enough_rows, min(n) >= 20 as enough_of_each from c",
    "ml_temporal_split": "select o_orderkey, row_number() over (order by o_totalprice nulls last, o_orderkey) <= 1 + 0.75 * (count(*) over () - 1) as is_train from orders",
    "ml_baseline": f"with {_TRAIN} select count(toxic) as n, round(avg(toxic), 6) as prior, round(avg(toxic) * (1 - avg(toxic)), 6) as brier, round(greatest(avg(toxic), 1 - avg(toxic)), 6) as accuracy, 0.5::double as auc from t",
    "ml_auc_rank": f"with {_TRAIN} select auc, (select cast(sum(toxic) as bigint) from t) as positives, (select cast(sum(1 - toxic) as bigint) from t) as negatives from ({_auc('x', 'n_chars')})",
    "ml_average_precision": f"with {_TRAIN}, c as (select x, sum(toxic) as p, count(*) as n from t group by x), r as (select p, sum(p) over (order by x desc) as tp, sum(n) over (order by x desc) as seen from c) select round(sum(p * tp / seen) / sum(p), 6) as average_precision from r",
    "ml_brier": f"with {_TRAIN} select round(avg((0.2 - toxic) * (0.2 - toxic)), 6) as brier, round(avg(case when toxic = 1 then 0.0 else 1.0 end), 6) as accuracy from t",
    "ml_leakage_auc": f"with {_TRAIN} select feature, auc, greatest(auc, 1 - auc) >= 0.98 as leaks from ({_auc('x', 'n_chars')} union all {_auc('toxic', 'leak')})",
}
