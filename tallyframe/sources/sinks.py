"""Writers of facts, bridges, vectors, graphs and reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def write_facts(facts: DataFrame, path: str, kind: str = "json") -> None:
    """Facts as JSON lines, CSV with a header, or Parquet by year."""
    out = facts.write.mode("overwrite")
    {"json": lambda: out.json(path), "csv": lambda: out.option("header", True).csv(path), "parquet": lambda: out.partitionBy("year").parquet(path)}[kind]()


def vector_rows(facts: DataFrame) -> DataFrame:
    """The vector store's rows, nulls replaced by its defaults."""
    return facts.fillna({"district": "Unknown", "indicator": "Unknown", "category": "Unknown", "unit": "Unknown", "source_document": "Unknown", "value": 0.0, "year": 0, "confidence_score": 0.0})


def write_bridges(bridges: DataFrame, path: str) -> None:
    """All bridge types in one table, partitioned by type, and an index of their counts."""
    bridges.write.mode("overwrite").partitionBy("bridge_type").parquet(f"{path}/bridges")
    index = load_bridges(bridges.sparkSession, path).groupBy("bridge_type").agg(F.count(F.lit(1)).alias("n"))
    index.write.mode("overwrite").json(f"{path}/index")


def load_bridges(spark: SparkSession, path: str) -> DataFrame:
    """The bridges of all types that ``write_bridges`` wrote."""
    return spark.read.parquet(f"{path}/bridges")


def write_bridge_vectors(facts: DataFrame, bridges: DataFrame, path: str) -> None:
    """The vector store's two classes, dropped and made anew: facts with defaults, and bridges with their texts."""
    vector_rows(facts).write.mode("overwrite").parquet(f"{path}/facts")
    text = F.concat_ws(" | ", F.concat(F.lit("Bridge type: "), "bridge_type"), F.concat(F.lit("Facts: "), F.size("fact_ids").cast("string")))
    bridges.withColumn("content", text).write.mode("overwrite").parquet(f"{path}/bridges")


def write_entities(entities: DataFrame, links: DataFrame, path: str) -> None:
    """A graph of entities: a node for each dataset and id, and links in capitals between nodes that exist, each once."""
    nodes = entities.select(F.concat_ws(":", "dataset", "entity_id").alias("id"), F.initcap("entity_type").alias("label"), "name").dropDuplicates(["id"])
    known = nodes.select("id")
    edges = links.join(known.withColumnRenamed("id", "source"), "source", "left_semi").join(known.withColumnRenamed("id", "target"), "target", "left_semi")
    nodes.write.mode("overwrite").parquet(f"{path}/nodes")
    edges.select("source", "target", F.upper("kind").alias("kind"), "confidence").dropDuplicates(["source", "target", "kind"]).write.mode("overwrite").parquet(f"{path}/edges")


def write_state(files: DataFrame, path: str) -> None:
    """The tracker of processed files (key, hash); a key that comes again replaces its row."""
    files.dropDuplicates(["key"]).write.mode("overwrite").parquet(path)


def write_text_report(lines: DataFrame, path: str) -> None:
    """A report of ordered lines (n, line) as one text file."""
    lines.coalesce(1).sortWithinPartitions("n").select("line").write.mode("overwrite").text(path)


def star_nodes(facts: DataFrame) -> DataFrame:
    """``kind, name``: a node for each district, indicator, year and source, from one pass over the facts."""
    each = F.explode(F.array(*[F.struct(F.lit(k).alias("kind"), F.col(c).cast("string").alias("name")) for k, c in (("district", "district"), ("indicator", "indicator"), ("year", "year"), ("source", "source_document"))]))
    return facts.select(each.alias("n")).select("n.*").where("name is not null").distinct()


def star_edges(facts: DataFrame) -> DataFrame:
    """``fact_id, kind, name``: the four edges of each fact."""
    each = F.explode(F.array(*[F.struct(F.lit(k).alias("kind"), F.col(c).cast("string").alias("name")) for k, c in (("MEASURED_BY", "indicator"), ("LOCATED_IN", "district"), ("OBSERVED_IN", "year"), ("REPORTED_BY", "source_document"))]))
    return facts.select("fact_id", each.alias("e")).select("fact_id", "e.*").where("name is not null")


def write_graph(facts: DataFrame, path: str) -> None:
    star_nodes(facts).write.mode("overwrite").parquet(f"{path}/nodes")
    star_edges(facts).write.mode("overwrite").partitionBy("kind").parquet(f"{path}/edges")


def write_report(row: DataFrame, path: str) -> None:
    """A report of one row as JSON."""
    row.coalesce(1).write.mode("overwrite").json(path)
