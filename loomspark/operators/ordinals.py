"""Gapless positions over a whole table, without a window on one partition."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from loomspark.storage import written


def with_ordinal(df: DataFrame, order: list[str | Column], name: str = "ordinal") -> DataFrame:
    """df with a 0-based position by order.

    Rows are sorted by range partitioning and stored; each partition's first
    position follows from the counts of those before it, one row each.
    """
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    placed = df.repartitionByRange(parts, *order).sortWithinPartitions(*order).withColumn("_id", F.monotonically_increasing_id())
    placed = written(placed, "ordinal").withColumn("_p", F.shiftright("_id", 33))
    counts = placed.groupBy("_p").agg(F.count("*").alias("_n"), F.min("_id").alias("_low"))
    before = F.coalesce(F.sum("_n").over(W.orderBy("_p").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))  # a row for each partition
    starts = counts.select("_p", "_low", before.alias("_before"))
    return placed.join(F.broadcast(starts), "_p").withColumn(name, F.col("_id") - F.col("_low") + F.col("_before")).drop("_id", "_p", "_n", "_low", "_before")
