"""Scans and sinks, each by writing a small table to the shared folder and reading it back; crawls and JSON rows."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from lumenta.sources import tables
from lumenta.sources.durable import shared_folder


def _place(spark, name: str) -> str:
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def _csv(spark, folder):
    own, path = tables.table(spark, folder, "nation"), _place(spark, "scan-csv")
    tables.write(own, path, "csv")
    return tables.csv(spark, path, own.schema)


def _round_trip(spark, folder):
    own, path = tables.table(spark, folder, "supplier"), _place(spark, "sink")
    tables.write(own, path, partition_by=["s_nationkey"])
    return spark.read.parquet(path).where("s_nationkey < 12").select(*own.columns)


def _crawl(spark, folder):
    return tables.crawled({t: tables.table(spark, folder, t) for t in tables.TABLES})


QUERIES = {
    "scan_csv": _csv,
    "scan_parquet": lambda s, f: tables.table(s, f, "orders").where("o_totalprice > 200000").select("o_orderkey", "o_totalprice"),
    "sink_roundtrip": _round_trip,
    "crawl_schema": _crawl,
    "json_output": lambda s, f: tables.json_safe(tables.table(s, f, "nation").select("n_nationkey", "n_name", "n_regionkey")),
    "pii_names": lambda s, f: s.createDataFrame([("email",), ("user_phone",), ("c_name",), ("zip",), ("total",)], "name string").select("name", F.coalesce(_named(), F.lit("none")).alias("category")),
}


def _named():
    from lumenta.operators.profiling import classify_names

    return classify_names(F.col("name"))


ORACLE = {
    "scan_csv": "select * from nation",
    "scan_parquet": "select o_orderkey, o_totalprice from orders where o_totalprice > 200000",
    "sink_roundtrip": "select * from supplier where s_nationkey < 12",
    "json_output": "select '{\"n_nationkey\":' || n_nationkey || ',\"n_name\":\"' || n_name || '\",\"n_regionkey\":' || n_regionkey || '}' as json from nation",
    "pii_names": "select * from (values ('email', 'email'), ('user_phone', 'phone'), ('c_name', 'none'), ('zip', 'address'), ('total', 'none')) t(name, category)",
}
