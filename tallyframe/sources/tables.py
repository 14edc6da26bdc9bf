"""Tables that iterative operators keep between rounds."""

from __future__ import annotations

import atexit
import re
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

CONF = "spark.checkpoint.dir"


def checkpoint_dir(spark: SparkSession) -> str:
    """The session's shared folder; where it names none, one below the warehouse, and a local one on a single machine."""
    where = spark.conf.get(CONF, None)
    if not where and re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
        own = tempfile.mkdtemp(prefix="tallyframe-")
        atexit.register(shutil.rmtree, own, ignore_errors=True)
        where = f"file://{own}"
    return where or spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_checkpoints"


def deleted_at_exit(spark: SparkSession, path: str) -> None:
    """Makes a folder that goes with the session."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    system = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    system.mkdirs(where)
    system.deleteOnExit(where)


def kept(df: DataFrame) -> DataFrame:
    """``df``, checkpointed: computed once, without lineage, on storage that outlives executors but not the session."""
    context = df.sparkSession.sparkContext
    if not context._jsc.sc().getCheckpointDir().isDefined():
        context.setCheckpointDir(checkpoint_dir(df.sparkSession))
    deleted_at_exit(df.sparkSession, context._jsc.sc().getCheckpointDir().get())
    return df.checkpoint()


def folder(spark: SparkSession, name: str) -> str:
    """A new folder's path in the shared folder, deleted with the session."""
    path = f"{checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    deleted_at_exit(spark, path)
    return path


def stored(df: DataFrame, name: str = "table") -> DataFrame:
    """``df``, written once as Parquet in the shared folder and read again, so that a round's plan begins with a scan.

    Unlike a checkpoint, it is computed once, and nothing of its plan (such as the constraints on its columns, which
    double with each round of joins) goes on.
    """
    path = folder(df.sparkSession, name)
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
