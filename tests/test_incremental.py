"""Incremental ingestion, schemas, and the library without its training-data part."""

from __future__ import annotations

import json
import pathlib
import shutil
import subprocess
import sys

from tallyframe.operators import registry, reports
from tallyframe.sources.facts import FACT_SCHEMA
from tallyframe.streaming import incremental

ROOT = pathlib.Path(__file__).resolve().parent.parent


def test_ingest_upserts_new_files(spark, tmp_path):
    source = tmp_path / "in"
    source.mkdir()

    def put(name, rows):
        (source / name).write_text("\n".join(json.dumps(r) for r in rows))

    def run():
        incremental.ingest(spark, str(source), str(tmp_path / "out"), str(tmp_path / "check")).awaitTermination()

    put("a.json", [{"fact_id": "a", "value": 1.0, "ord": 1}, {"fact_id": "b", "value": 2.0, "ord": 2}])
    run()
    put("b.json", [{"fact_id": "b", "value": 3.0, "ord": 3}, {"fact_id": "c", "value": 4.0, "ord": 4}])
    run()
    last = max((tmp_path / "out").glob("version=*"), key=lambda p: int(p.name.split("=")[1]))
    rows = spark.read.schema(FACT_SCHEMA).parquet(str(last)).collect()
    assert {r.fact_id: r.value for r in rows} == {"a": 1.0, "b": 3.0, "c": 4.0}


def test_repeated_batch_changes_nothing(spark, tmp_path):
    write = incremental.upsert_into(str(tmp_path))
    batch = spark.createDataFrame([("a", "x", 1.0, 1)], "fact_id string, district string, value double, ord long").withColumn("file", __import__("pyspark").sql.functions.lit("f"))
    full = spark.createDataFrame([], FACT_SCHEMA).unionByName(batch, allowMissingColumns=True)
    write(full, 0)
    write(full, 0)
    assert spark.read.parquet(str(tmp_path / "version=1")).count() == 1


def test_schemas():
    got = registry.inferred("/x/scores.csv", {"School Code": "123", "District": "Guntur", "Date": "01/02/2020", "open": True})
    assert got["source_type"] == "csv" and got["extraction_method"] == "structured"
    assert got["key_fields"] == {"school_code": "string_numeric", "district": "string", "date": "date", "open": "integer"}
    assert got["bridge_potential"] == ["school_code", "district", "date"]
    assert registry.inferred("/x/a.bin", {"k": 1.5})["entity_types"] == ["document"]


def test_application_lists(spark):
    rows = [("d", "Guntur", "12345678 a name"), ("d", "Guntur", "12345678 another"), ("d", "Guntur", "short"), ("d", None, "no district here"), ("d", "Krishna", "no code at all")]
    got = {(r.district, r.indicator): r.value for r in reports.application_lists(spark.createDataFrame(rows, "doc_id string, district string, text string")).collect()}
    assert got == {("Guntur", "Applications"): 2, ("Guntur", "Schools"): 1, ("Krishna", "Applications"): 1}


def test_library_stands_without_training_data_part(tmp_path):
    shutil.copytree(ROOT, tmp_path / "r", ignore=shutil.ignore_patterns(".git", "__pycache__"))
    shutil.rmtree(tmp_path / "r/tallyframe/llm", ignore_errors=True)
    shutil.rmtree(tmp_path / "r/tests/llm", ignore_errors=True)
    (tmp_path / "r/corpus_pipeline.py").unlink(missing_ok=True)
    code = "import __spark_entry__ as e; q, s = e.queries(), e.oracle_sql(); assert q and set(s) <= set(q) and not any(n.startswith('op') for n in q); print(len(q))"
    done = subprocess.run([sys.executable, "-c", code], cwd=tmp_path / "r", capture_output=True, text=True)
    assert done.returncode == 0, done.stderr
