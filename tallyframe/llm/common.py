"""Shared plumbing: written intermediate tables, and connected components by contraction."""

from __future__ import annotations

import atexit
import re
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

CHECKPOINT_CONF = "spark.checkpoint.dir"
CLEANUP_CONF = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share. Where the session names none, the warehouse holds it, and on a single machine a
    folder of its own that is removed at exit."""
    where = spark.conf.get(CHECKPOINT_CONF, None)
    if not where and not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
        where = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_scratch"
    elif not where:
        own = tempfile.mkdtemp(prefix="tallyframe-")
        atexit.register(shutil.rmtree, own, ignore_errors=True)
        where = f"file://{own}"
        spark.conf.set(CHECKPOINT_CONF, where)
    return where.rstrip("/")


BATCH_CONFS = {"spark.sql.execution.arrow.maxRecordsPerBatch": 2000, "spark.sql.execution.arrow.maxBytesPerBatch": 16 << 20}


def small_batches(spark: SparkSession) -> None:
    """Bounds the rows and bytes of the Arrow batches in which texts reach Python; smaller settings stay."""
    for name, most in BATCH_CONFS.items():
        number, unit = re.fullmatch(r"(-?\d+)([kmgt]?)b?", spark.conf.get(name).lower()).groups()
        if not 0 < int(number) << 10 * " kmgt".index(unit or " ") <= most:
            spark.conf.set(name, str(most))


class Scratch:
    """Intermediate tables, written as Parquet in the shared folder so that a lost executor costs no lineage.

    ``put`` writes and rereads a table; its shuffle files go when the write ends. ``drop`` deletes tables
    that no later plan reads; what the last plan reads goes when the session ends.
    """

    def __init__(self, spark: SparkSession, name: str) -> None:
        small_batches(spark)
        self.spark, self.root, self.n = spark, f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}", 0
        where, system = self.located(self.root)
        system.mkdirs(where)
        system.deleteOnExit(where)

    def located(self, path: str):
        """A path and its file system, as the JVM has them."""
        where = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        return where, where.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def path(self, name: str) -> str:
        self.n += 1
        return f"{self.root}/{self.n:03d}-{name}"

    def put(self, df: DataFrame, name: str) -> DataFrame:
        path = self.path(name)
        before = self.spark.conf.get(CLEANUP_CONF, "false")
        self.spark.conf.set(CLEANUP_CONF, "true")
        try:
            df.write.parquet(path)
        finally:
            self.spark.conf.set(CLEANUP_CONF, before)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._tallyframe_path = path
        return out

    def drop(self, *tables: DataFrame) -> None:
        for t in tables:
            self.delete(t._tallyframe_path)

    def delete(self, path: str) -> None:
        where, system = self.located(path)
        system.delete(where, True)


def connected_components(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """``(a, b)`` edges of longs -> ``(id, component)``, component being the smallest id reachable.

    Each round maps every vertex to the first of itself and its neighbours and contracts the edges. Vertices are
    ordered by a hash that maps longs one to one, so whatever the order of ids (chains of ascending ids, say), rounds
    grow with the logarithm of the longest path. The maps are composed by joins at the end. Only vertices with an edge
    are returned; no edges give no rows.
    """
    links = edges.where("a <> b")
    hashed = links.select(F.xxhash64(F.col("a").cast("long")).alias("a"), F.xxhash64(F.col("b").cast("long")).alias("b"))
    rest = scratch.put(hashed.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    maps: list[DataFrame] = []
    while not rest.isEmpty():
        both = rest.select(F.col("a").alias("v"), F.col("b").alias("to")).union(rest.select(F.col("b").alias("v"), F.col("a").alias("to")))
        step = scratch.put(both.groupBy("v").agg(F.least("v", F.min("to")).alias("to")), "step")
        left, right = step.withColumnsRenamed({"v": "a", "to": "x"}), step.withColumnsRenamed({"v": "b", "to": "y"})
        moved = rest.join(left, "a").join(right, "b").where("x <> y")
        after = scratch.put(moved.select(F.greatest("x", "y").alias("a"), F.least("x", "y").alias("b")).distinct(), "edges")
        scratch.drop(rest)
        rest = after
        maps.append(step)
    scratch.drop(rest)
    if not maps:
        return scratch.put(links.select(F.col("a").alias("id"), F.col("b").alias("component")), "components")
    root = maps[-1]
    for step in reversed(maps[:-1]):
        end = root.select(F.col("v").alias("to"), F.col("to").alias("end"))
        root = step.join(end, "to", "left").select("v", F.coalesce("end", "to").alias("to"))
    vertices = links.select(F.col("a").cast("long").alias("id")).union(links.select(F.col("b").cast("long"))).distinct()
    rooted = scratch.put(vertices.withColumn("v", F.xxhash64("id")).join(root, "v").select("id", F.col("to").alias("root")), "roots")
    low = rooted.groupBy("root").agg(F.min("id").alias("component"))
    out = scratch.put(rooted.join(low, "root").select("id", "component"), "components")
    scratch.drop(rooted, *maps)
    return out
