"""Scans, the governed views, schema crawling, row estimates and sinks."""

from __future__ import annotations

from datetime import date, datetime, timedelta

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")
#: What 'completed' is called in the orders table.
COMPLETED = "F"
#: Rows beyond which an estimate stops counting.
ESTIMATE_CAP = 1_000_000


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def csv(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    """A CSV scan with a header and a declared schema; nothing is inferred."""
    return spark.read.schema(schema).option("header", True).csv(path)


def jdbc(spark: SparkSession, url: str, name: str, partition: tuple[str, int, int, int] | None = None, **options: str) -> DataFrame:
    """A database table (its driver jar must be on the class path); partition: column, least, most, number of readers."""
    reader = spark.read.format("jdbc").options(url=url, dbtable=name, **options)
    if partition:
        column, low, high, n = partition
        reader = reader.options(partitionColumn=column, lowerBound=str(low), upperBound=str(high), numPartitions=str(n))
    return reader.load()


READERS = {"parquet": lambda spark, path, **_: spark.read.parquet(path), "csv": lambda spark, path, schema, **_: csv(spark, path, schema), "jdbc": lambda spark, path, name, **o: jdbc(spark, path, name, **o)}


def source(spark: SparkSession, kind: str, path: str, **options) -> tuple[DataFrame | None, str]:
    """A source after a probe of one row: (frame, 'healthy') or (None, why not)."""
    if kind not in READERS:
        return None, f"unsupported kind {kind!r}; one of {', '.join(sorted(READERS))}"
    try:
        frame = READERS[kind](spark, path, **options)
        frame.limit(1).collect()
    except Exception as error:  # the probe's whole purpose is to turn any failure into a state
        return None, f"unreachable: {type(error).__name__}"
    return frame, "healthy"


def within(column: str | Column, start: date | None, end: date | None) -> Column:
    """Both days included, as a predicate on the raw column, so that it reaches the scan."""
    column = F.col(column) if isinstance(column, str) else column
    out = F.lit(True)
    if start is not None:
        out = column >= F.lit(datetime(start.year, start.month, start.day)).cast("timestamp_ntz")
    if end is not None:
        after = end + timedelta(days=1)
        late = column < F.lit(datetime(after.year, after.month, after.day)).cast("timestamp_ntz")
        out = late if start is None else out & late
    return out


def places(spark: SparkSession, folder: str) -> DataFrame:
    """customer_id, segment, region. Nations and regions are fixed small tables; Spark broadcasts them by their size."""
    nation, region = table(spark, folder, "nation"), table(spark, folder, "region")
    named = nation.join(region, nation.n_regionkey == region.r_regionkey).select("n_nationkey", F.col("r_name").alias("region"))
    customer = table(spark, folder, "customer").select("c_custkey", "c_nationkey", "c_mktsegment")
    return customer.join(named, F.col("c_nationkey") == F.col("n_nationkey")).select(F.col("c_custkey").alias("customer_id"), F.col("c_mktsegment").alias("segment"), "region")


def sales(spark: SparkSession, folder: str, start: date | None = None, end: date | None = None, completed: bool = True) -> DataFrame:
    """order_id, customer_id, order_date, status, total_amount, region, segment, channel."""
    orders = table(spark, folder, "orders").where(within("o_orderdate", start, end))
    if completed:
        orders = orders.where(F.col("o_orderstatus") == COMPLETED)
    orders = orders.select(F.col("o_orderkey").alias("order_id"), F.col("o_custkey").alias("customer_id"), F.col("o_orderdate").cast("date").alias("order_date"), F.col("o_orderstatus").alias("status"), F.col("o_totalprice").alias("total_amount"), F.col("o_orderpriority").alias("channel"))
    return orders.join(places(spark, folder), "customer_id")


def sales_lines(spark: SparkSession, folder: str, completed: bool = True) -> DataFrame:
    """order_id, order_date, category, gross_amount, discount_amount of order lines."""
    lines = table(spark, folder, "lineitem").select("l_orderkey", "l_partkey", F.col("l_extendedprice").alias("gross_amount"), (F.col("l_extendedprice") * F.col("l_discount")).alias("discount_amount"))
    orders = table(spark, folder, "orders")
    if completed:
        orders = orders.where(F.col("o_orderstatus") == COMPLETED)
    orders = orders.select(F.col("o_orderkey").alias("order_id"), F.col("o_orderdate").cast("date").alias("order_date"))
    parts = table(spark, folder, "part").select("p_partkey", F.col("p_type").alias("category"))
    return lines.join(orders, F.col("l_orderkey") == F.col("order_id")).join(parts, F.col("l_partkey") == F.col("p_partkey"), "left").select("order_id", "order_date", "category", "gross_amount", "discount_amount")


def tickets(spark: SparkSession, folder: str) -> DataFrame:
    """Events in the role of support tickets: created_date, user_id, category, hours, csat (the value within 1 to 5)."""
    events = table(spark, folder, "events")
    return events.select(F.col("ts").cast("date").alias("created_date"), "user_id", F.col("event_type").alias("category"), F.col("value").alias("hours"), F.least(F.lit(5.0), F.greatest(F.lit(1.0), F.col("value"))).alias("csat"))


def latest_date(frame: DataFrame, column: str) -> DataFrame:
    """latest_date: the anchor that evaluations count back from."""
    return frame.agg(F.max(column).cast("date").alias("latest_date"))


def anchor(frame: DataFrame, column: str, today: date, stale_after: int = 7) -> DataFrame:
    """latest_date, days_behind, is_stale against a given day."""
    behind = F.datediff(F.lit(today), F.col("latest_date"))
    return latest_date(frame, column).select("latest_date", behind.alias("days_behind"), (behind > stale_after).alias("is_stale"))


CRAWLED = "table_name string, column_name string, data_type string, nullable boolean, role string"


def crawled(frames: dict[str, DataFrame]) -> DataFrame:
    """table_name, column_name, data_type, nullable, role: schemas as rows, read from metadata alone."""
    from lumenta.operators.profiling import named_role

    rows = [(t, f.name, f.dataType.simpleString(), f.nullable, named_role(f.name, f.dataType.simpleString())) for t, df in frames.items() for f in df.schema]
    spark = next(iter(frames.values())).sparkSession
    return spark.createDataFrame(rows, CRAWLED)


def approx_rows(frame: DataFrame, cap: int = ESTIMATE_CAP) -> DataFrame:
    """approx_rows: exact up to cap, and cap beyond it, so that huge tables are not counted out."""
    return frame.limit(cap).agg(F.count("*").alias("approx_rows"))


def capped(frame: DataFrame, cap: int) -> tuple[DataFrame, DataFrame]:
    """The first cap rows, and (row_count, truncated) from a probe of one row more."""
    probe = frame.limit(cap + 1).agg(F.count("*").alias("n"))
    return frame.limit(cap), probe.select(F.least(F.col("n"), F.lit(cap)).alias("row_count"), (F.col("n") > cap).alias("truncated"))


def write(frame: DataFrame, path: str, kind: str = "parquet", partition_by: list[str] | None = None) -> None:
    """Replaces what is at path. Partition columns make later date filters skip files."""
    writer = frame.write.mode("overwrite")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    if kind == "csv":
        writer.option("header", True).csv(path)
    elif kind in ("parquet", "json"):
        getattr(writer, kind)(path)
    else:
        raise ValueError(f"no sink for {kind!r}")


def append(frame: DataFrame, path: str, day: str | None = None) -> None:
    """Adds rows to a parquet table (of runs, alerts, ...), by day if a date column is named; readers see whole commits only."""
    writer = frame.write.mode("append")
    (writer.partitionBy(day) if day else writer).parquet(path)


def json_safe(frame: DataFrame) -> DataFrame:
    """One JSON text for each row: ISO dates, null where a number is not finite."""
    safe = [F.when(F.isnan(c) | (F.abs(F.col(c)) == float("inf")), None).otherwise(F.col(c)).alias(c) if t in ("double", "float") else F.col(c) for c, t in frame.dtypes]
    return frame.select(F.to_json(F.struct(*safe), {"ignoreNullFields": "false"}).alias("json"))
