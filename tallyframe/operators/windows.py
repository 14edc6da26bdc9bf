"""Operators of ordered groups: first matches, leads, ranks, top rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.tables import stored


def first_match(rows: DataFrame, keys: list[str], order: list[str | Column]) -> DataFrame:
    """The first row of each key. The rank is bounded, so Spark cuts groups before the shuffle."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return rows.withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n")


def top_per_group(rows: DataFrame, keys: list[str], order: list[str | Column], k: int) -> DataFrame:
    w = Window.partitionBy(*keys).orderBy(*order)
    return rows.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def temporal_edges(facts: DataFrame, most: int = 2) -> DataFrame:
    """Each fact to the next of its indicator and district, when at most ``most`` years lie between."""
    w = Window.partitionBy("indicator", "district").orderBy("year", "ord")
    nxt = facts.withColumn("n", F.lead(F.struct("fact_id", "year")).over(w)).where("n is not null")
    gap = F.col("n.year") - F.col("year")
    near = nxt.withColumn("gap", gap).where(F.col("gap") <= most)
    tenths = F.greatest(F.lit(5), 10 - 2 * F.col("gap"))
    return near.select(F.col("fact_id").alias("source"), F.col("n.fact_id").alias("target"), "gap", (tenths / F.lit(10.0)).alias("strength"), F.when(F.col("gap") > 0, "forward").otherwise("backward").alias("direction"))


def ranked(rows: DataFrame, score: str, tie: str, k: int) -> DataFrame:
    """The ``k`` best rows and their ranks; only those rows reach the one task that numbers them."""
    best = rows.orderBy(F.desc(score), tie).limit(k)
    return best.withColumn("rank", F.row_number().over(Window.orderBy(F.desc(score), tie)))


def numbered(rows: DataFrame, order: list[str], name: str) -> DataFrame:
    """``name``: the rows' numbers from 1 in the order of columns, without a window over all rows in one task.

    Rows are dealt into ranges of the order, sorted and counted there, and written; a range starts after the rows of those
    before it, of which there is one count for each. Equal rows are numbered in any order.
    """
    sorted_ = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    # the lower 33 bits of the id count a partition's rows from 0
    dealt = stored(sorted_.withColumns({"__p": F.spark_partition_id(), "__i": F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1) + 1}), "ranges")
    starts = dealt.groupBy("__p").agg(F.count(F.lit(1)).alias("__n"))
    earlier = Window.orderBy("__p").rowsBetween(Window.unboundedPreceding, -1)  # a row for each range
    starts = starts.select("__p", F.coalesce(F.sum("__n").over(earlier), F.lit(0)).alias("__start"))
    return dealt.join(F.broadcast(starts), "__p").withColumn(name, F.col("__start") + F.col("__i")).drop("__p", "__i", "__start")
