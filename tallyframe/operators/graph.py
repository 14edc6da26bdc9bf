"""Property graphs as node and edge frames."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StructField, StructType

from ..sources.tables import folder, stored
from .windows import first_match


def undirected(edges: DataFrame) -> DataFrame:
    return edges.select("source", "target").union(edges.select(F.col("target").alias("source"), F.col("source").alias("target"))).distinct()


def upserted(nodes: DataFrame, updates: DataFrame, key: str) -> DataFrame:
    """The latest row of each key; updates follow nodes."""
    both = nodes.withColumn("__o", F.lit(0)).unionByName(updates.withColumn("__o", F.lit(1)))
    return first_match(both, [key], [F.desc("__o"), F.desc("version")]).drop("__o")


def neighbours(edges: DataFrame, start: DataFrame, k: int = 10) -> DataFrame:
    """Up to ``k`` one-hop neighbours of each start id, smallest ids first."""
    near = start.join(undirected(edges), F.col("id") == F.col("source")).select("id", F.col("target").alias("neighbour"))
    return first_k(near, "id", "neighbour", k)


def first_k(rows: DataFrame, key: str, order: str, k: int) -> DataFrame:
    from .windows import top_per_group

    return top_per_group(rows, [key], [order], k).drop("rank")


def search(edges: DataFrame, start: DataFrame, depth: int) -> DataFrame:
    """``id, node, distance, before`` of all nodes within ``depth`` undirected hops of each start id.

    ``before`` is the smallest node that precedes the node on a shortest path (null at the start itself). A hop goes
    on from the nodes that the last one found. As edges have no direction, its neighbours are as far away, or a hop
    nearer or farther, so that the last two hops tell the new ones. Each hop is written as a part of one table, so a plan
    is of one hop whatever the depth.
    """
    spark = edges.sparkSession
    path, both = folder(spark, "search"), stored(undirected(edges))
    schema = StructType([StructField("id", start.schema["id"].dataType), StructField("node", start.schema["id"].dataType), StructField("before", start.schema["id"].dataType)])

    def put(level: DataFrame, hop: int) -> DataFrame:
        level.write.parquet(f"{path}/distance={hop}")
        return spark.read.schema(schema).parquet(f"{path}/distance={hop}")

    none = F.lit(None).cast(schema["before"].dataType).alias("before")
    earlier, level = None, put(start.select("id", F.col("id").alias("node"), none).distinct(), 0)
    for hop in range(1, depth + 1):
        reached = level.join(both, F.col("node") == F.col("source")).groupBy("id", F.col("target").alias("node")).agg(F.min("source").alias("before"))
        for known in (level, earlier):
            if known is not None:
                reached = reached.join(known.select("id", "node"), ["id", "node"], "left_anti")
        earlier, level = level, put(reached.select("id", "node", "before"), hop)
        if level.isEmpty():
            break
    return spark.read.schema(StructType([*schema.fields, StructField("distance", IntegerType())])).parquet(path).select("id", "node", "distance", "before")


def distances(edges: DataFrame, start: DataFrame, depth: int) -> DataFrame:
    """``id, node, distance`` of all nodes within ``depth`` undirected hops."""
    return search(edges, start, depth).drop("before")


def shortest(edges: DataFrame, pairs: DataFrame, depth: int = 5) -> DataFrame:
    """``source, target, distance, path`` of the pairs within ``depth`` hops: the nodes from source to target.

    Of several shortest paths, the one whose nodes are smallest, read from the target back. Paths are walked back hop
    by hop over the predecessors that the search has kept.
    """
    reach = search(edges, pairs.select(F.col("source").alias("id")).distinct(), depth)
    found = pairs.join(reach, (F.col("source") == F.col("id")) & (F.col("target") == F.col("node")))
    walk = stored(found.select("source", "target", "distance", F.array("target").alias("path"), F.col("before").alias("at")))
    step = reach.select(F.col("id").alias("source"), F.col("node").alias("at"), F.col("before").alias("next"))
    while not walk.where("at is not null").isEmpty():
        longer = walk.join(step, ["source", "at"], "left")
        path = F.when(F.col("at").isNotNull(), F.concat(F.array("at"), "path")).otherwise(F.col("path"))
        walk = stored(longer.select("source", "target", "distance", path.alias("path"), F.col("next").alias("at")))
    return walk.drop("at")


def trails(edges: DataFrame, start: DataFrame, depth: int = 2) -> DataFrame:
    """``id, length, path``: every undirected path of 1 to ``depth`` hops that uses no edge twice, as its nodes.

    The paths are what is asked for, so rows grow with the product of degrees; each hop is made once and written.
    """
    one = edges.select("source", "target").distinct().withColumn("edge", F.struct("source", "target"))
    both = stored(one.union(one.select("target", "source", "edge")).distinct())
    level = start.select("id", F.col("id").alias("node"), F.array("id").alias("path"), F.array().cast(ArrayType(both.schema["edge"].dataType)).alias("used")).distinct()
    found = []
    for hop in range(1, depth + 1):
        more = level.join(both, F.col("node") == F.col("source")).where(~F.array_contains("used", F.col("edge")))
        level = stored(more.select("id", F.col("target").alias("node"), F.concat("path", F.array("target")).alias("path"), F.concat("used", F.array("edge")).alias("used")))
        found.append(level.select("id", F.lit(hop).alias("length"), "path"))
    return reduce(DataFrame.union, found)


def related_within(nodes: DataFrame, key: str, group: str) -> DataFrame:
    """Both directions between different nodes of one group. Pairs weigh more than nodes, so groups are dealt to many tasks."""
    spark = nodes.sparkSession
    nodes = nodes.repartition(max(int(spark.conf.get("spark.sql.shuffle.partitions")), 8 * spark.sparkContext.defaultParallelism), group)
    other = nodes.select(F.col(key).alias("target"), F.col(group).alias("g"))
    return nodes.join(other, F.col(group) == F.col("g")).where(F.col(key) != F.col("target")).select(F.col(key).alias("source"), "target")


def label(name: Column, urban: list[str]) -> Column:
    return F.when(name.isin(urban), "urban").otherwise("rural")


def stats(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    kinds = nodes.groupBy("kind").count().select(F.lit("node").alias("what"), "kind", F.col("count").alias("n"))
    return kinds.union(edges.groupBy("kind").count().select(F.lit("edge"), "kind", "count"))


def union_search(facts: DataFrame, policies: DataFrame, links: DataFrame, words: str) -> DataFrame:
    """Three branches of one search: facts named by the words, facts under policies so named, facts of linked indicators."""
    w = words.lower()
    direct = facts.where(F.lower("indicator").contains(w)).select("fact_id", F.lit(3).alias("relevance"), F.lit(0.9).alias("score"))
    governed = policies.where(F.lower("policy").contains(w)).join(facts, "indicator").select("fact_id", F.lit(2), F.lit(0.6))
    named = undirected(links).where(F.lower("source").contains(w)).select(F.col("target").alias("indicator")).distinct()
    linked = named.join(facts, "indicator").select("fact_id", F.lit(1), F.lit(0.3))
    return direct.distinct().union(governed.distinct()).union(linked.distinct())
