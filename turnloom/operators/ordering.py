"""Places and running sums within groups of any size.

A window over a group runs in one task, whatever the group's size. Here rows are
range-partitioned by (group, order), so that a large group spans many partitions;
sums within a partition are windows of bounded size, and what comes before a
partition is one row for each (group, partition). The partitioning is written to the
shared folder once: both sides see the same.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from turnloom.sources.tables import cut, new_folder


def running(df: DataFrame, by: list[str], order: list[Column], value: str | Column, out: str) -> DataFrame:
    """``df`` with ``out``: the sum of ``value`` over the rows of the same group that
    come before in ``order`` (which should have few ties), 0 for the first."""
    placed = df.withColumn("_v", F.col(value) if isinstance(value, str) else value).repartitionByRange(*[F.col(b) for b in by], *order).withColumn("_part", F.spark_partition_id())
    placed = cut(placed, new_folder(df.sparkSession, "order"))
    inner = Window.partitionBy("_part", *by).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    # one row for each group and partition
    whole = placed.groupBy("_part", *by).agg(F.sum("_v").alias("_s"))
    outer = Window.partitionBy(*by).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    base = whole.withColumn("_base", F.coalesce(F.sum("_s").over(outer), F.lit(0))).drop("_s")
    here = placed.withColumn("_here", F.coalesce(F.sum("_v").over(inner), F.lit(0)))
    return here.join(base, ["_part", *by]).withColumn(out, F.col("_base") + F.col("_here")).drop("_part", "_v", "_here", "_base")


def numbered(df: DataFrame, by: list[str], order: list[Column], out: str) -> DataFrame:
    """``df`` with ``out``: 0, 1, ... within each group, in ``order`` (no ties)."""
    return running(df, by, order, F.lit(1).cast("long"), out)


def places(df: DataFrame, cols: list[str], within: list[str]) -> DataFrame:
    """One row for each group, column of ``cols`` and value: ``which``, ``value``, ``n``
    (rows with it), ``below`` (rows with a smaller one) and ``total`` (rows with any).
    Ranks of any kind are functions of these."""
    cells = F.array(*[F.struct(F.lit(c).alias("which"), F.col(c).cast("double").alias("value")) for c in cols])
    seen = df.select(*within, F.explode(cells).alias("x")).select(*within, "x.*").where("value IS NOT NULL").groupBy(*within, "which", "value").agg(F.count("*").alias("n"))
    found = running(seen, [*within, "which"], [F.col("value")], "n", "below")
    return found.join(seen.groupBy(*within, "which").agg(F.sum("n").alias("total")), [*within, "which"])
