"""Cuts of lineage on shared storage, sizes of sides that are broadcast, and running sums over sorted ranges."""

from __future__ import annotations

import tempfile
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Bytes that a side may have to be broadcast; larger sides are joined by a shuffle instead.
BROADCAST_BYTES = 32 << 20


def shared_folder(spark: SparkSession) -> str:
    """The session's checkpoint folder, by default that in spark.checkpoint.dir. A session on one machine gets a temporary one if it has none."""
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        path = sc.getConf().get("spark.checkpoint.dir")
        if not path and sc.master.split("[")[0] != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all machines share")
        sc.setCheckpointDir(path or tempfile.mkdtemp(prefix="lumenta-checkpoint-"))
    return sc._jsc.sc().getCheckpointDir().get()


def durable(df: DataFrame) -> DataFrame:
    """Writes the rows to the shared folder and cuts the lineage there."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


def shuffle_width(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def small(df: DataFrame, rows: int, row_bytes: int) -> DataFrame:
    """df, marked to be broadcast if rows of row_bytes are few enough; else it is joined by a shuffle.

    A row takes four times its bytes, and 32 more, in the relation that is broadcast.
    """
    return F.broadcast(df) if rows * (4 * row_bytes + 32) <= 4 * BROADCAST_BYTES else df


def running(frame: DataFrame, order: Sequence[Column | str], sums: dict[str, Column | str]) -> DataFrame:
    """frame with running sums (named) of columns over the rows before each one in an order of all rows.

    Rows are sorted over ranges; each partition adds up its own, and gets the totals of those before it: one row for each
    partition. Rows that are equal in order stand next to each other in no given order.
    """
    parts = durable(frame.repartitionByRange(shuffle_width(frame), *order).withColumn("__part", F.spark_partition_id()))  # must be the same in both passes
    totals = parts.groupBy("__part").agg(*[F.sum(c).alias(f"__t_{n}") for n, c in sums.items()])
    before = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    starts = totals.select("__part", *[F.coalesce(F.sum(f"__t_{n}").over(before), F.lit(0)).alias(f"__s_{n}") for n in sums])
    inside = Window.partitionBy("__part").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    out = parts.withColumns({n: F.coalesce(F.sum(c).over(inside), F.lit(0)) for n, c in sums.items()}).join(F.broadcast(starts), "__part")
    return out.select(*[c for c in frame.columns if c not in sums], *[(F.col(n) + F.col(f"__s_{n}")).alias(n) for n in sums])
