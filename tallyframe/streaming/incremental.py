"""Incremental ingestion: a file stream whose batches are upserted, with the tracker of what was seen."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.windows import first_match
from ..sources.facts import FACT_SCHEMA


def fact_stream(spark: SparkSession, path: str) -> DataFrame:
    """Facts of JSON files as they arrive, with the file they came from."""
    return spark.readStream.schema(FACT_SCHEMA).json(path).withColumn("file", F.input_file_name())


def upsert_into(target: str):
    """A batch function that keeps the last row of each fact_id in versions of a Parquet table.

    A batch writes version ``batch + 1`` from version ``batch``; running it again overwrites the same version, so a
    failed batch may be repeated.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        new = batch.drop("file").withColumn("__o", F.lit(1))
        if batch_id:
            old = spark.read.schema(FACT_SCHEMA).parquet(f"{target}/version={batch_id}")
            new = old.withColumn("__o", F.lit(0)).unionByName(new)
        last = first_match(new, ["fact_id"], [F.desc("__o"), F.desc("ord")]).drop("__o")
        last.write.mode("overwrite").parquet(f"{target}/version={batch_id + 1}")

    return write


def ingest(spark: SparkSession, source: str, target: str, checkpoint: str) -> StreamingQuery:
    """Takes in all files that arrived since the last call and stops."""
    stream = fact_stream(spark, source).writeStream.foreachBatch(upsert_into(target))
    return stream.option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def late_counts(events: DataFrame, late: str = "10 minutes", width: str = "1 hour") -> DataFrame:
    """Events and their value by type and tumbling window, accepting rows up to ``late`` behind; batch or stream."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", width), "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("value").cast("decimal(18,2)")).cast("double").alias("total"))
