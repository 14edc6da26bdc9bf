"""The keyword index against scores over all texts, and the reader of one large JSON array."""

from __future__ import annotations

import json
import random

import pytest
from pyspark.sql import functions as F

from tallyframe.operators import keyword_index, retrieval
from tallyframe.sources import files


def test_questions_of_an_index_score_as_a_scan(spark):
    rnd = random.Random(2)
    words = ["the", "of", "rare", "rate", "school", "x1", "guntur"]
    docs = [(i, " ".join(rnd.choices(words, weights=[40, 30, 1, 5, 5, 3, 2], k=rnd.randint(0, 40)))) for i in range(300)] + [(900, None), (901, ""), (902, "The, the; THE rare!")]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    questions = {"a": ["the"], "b": ["the", "rare"], "c": ["RARE", "guntur", "of", "of"], "d": ["none"], "e": words, "f": ["rare", None]}
    asked = spark.createDataFrame([(q, t) for q, ts in questions.items() for t in ts], "question string, term string")
    index = keyword_index.build(df, "doc_id", "text")
    got = {}
    for r in keyword_index.answers(index, asked, 7).collect():
        got.setdefault(r.question, []).append((r.rank, r.doc_id, r.score))
    for q, terms in questions.items():
        scan = retrieval.bm25(df, "doc_id", "text", sorted({t.lower() for t in terms if t})).collect()
        best = sorted(((-round(r.score, 9), r.doc_id) for r in scan))[:7]
        assert [(d, pytest.approx(s)) for _, d, s in sorted(got.get(q, []))] == [(d, -s) for s, d in best], q
    assert "d" not in got


def test_a_question_reads_its_terms_only(spark):
    df = spark.createDataFrame([(i, f"word{i} the") for i in range(50)], "doc_id long, text string")
    index = keyword_index.build(df, "doc_id", "text")
    asked = spark.createDataFrame([("q", "word7")], "question string, term string")
    plan = keyword_index.answers(index, asked, 3)._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [In(term, [word7])" in plan or "EqualTo(term,word7)" in plan
    assert index.terms.where("term = 'the'").first().d == 50


ITEM = "id long, text string, tags array<string>, inner struct<a:int,b:string>"


def test_one_large_array_is_read_by_many_tasks(spark, tmp_path):
    rnd = random.Random(3)
    pool = ["{", "}", "[", "]", '"', "\\", "\\\\", ",", "é", "日本", "\n", "}}", '"}', "{[", "plain", " "]
    items = [{"id": i, "text": "".join(rnd.choices(pool, k=rnd.randint(0, 30))), "tags": ["".join(rnd.choices(pool, k=4)) for _ in range(rnd.randint(0, 3))], "inner": {"a": i, "b": rnd.choice(pool)}} for i in range(4000)]
    items[1] |= {"text": "x}" * 6000}  # longer than a range
    (tmp_path / "a.json").write_text(json.dumps(items[:2500], ensure_ascii=False))
    (tmp_path / "b.json").write_text(json.dumps(items[2500:], indent=2))
    (tmp_path / "empty.json").write_text("[]\n")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "8192")
    try:
        tasks = spark.read.text(str(tmp_path)).rdd.getNumPartitions()
        got = [r.asDict(True) for r in files.json_array(spark, str(tmp_path), ITEM).collect()]
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert tasks > 30
    assert sorted(got, key=lambda r: r["id"]) == items


def test_arrays_of_odd_objects(spark, tmp_path):
    (tmp_path / "x.json").write_text('[ {} , {"id": 1, "other": {"x": [{}]}}, 5, "{}", {"id": 2, "text": "\\\\\\"}"}]')
    got = files.json_array(spark, str(tmp_path), ITEM).orderBy(F.col("id").asc_nulls_first()).collect()
    assert [(r.id, r.text) for r in got] == [(None, None), (1, None), (2, '\\"}')]


def test_objects_of_lists_are_read_by_many_tasks(spark, tmp_path):
    rnd = random.Random(9)
    pool = ["{", "}", "[", "]", '"', "\\", ",", ":", "é", "\n", '": [', '"}', "plain"]
    lists = {}
    for i in range(60):
        key = f"doc {i}" + "".join(rnd.choices(pool, k=rnd.randint(0, 3)))
        lists[key] = [{"fact_id": f"f{i}-{j}" + "".join(rnd.choices(pool, k=3)), "value": float(j), "other": [{"x": [{}]}]} for j in range(rnd.choice([0, 0, 1, 5, 80]))]
    (tmp_path / "a.json").write_text(json.dumps(lists, indent=1))
    (tmp_path / "b.json").write_text(json.dumps(lists, ensure_ascii=False, separators=(",", ":")))
    (tmp_path / "c.json").write_text(json.dumps(lists["doc 0" if "doc 0" in lists else next(iter(lists))] + [{"fact_id": "in a list", "value": None}]))
    (tmp_path / "d.json").write_text("{}")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "8192")
    try:
        got = [tuple(r) for r in files.json_items(spark, str(tmp_path), "fact_id string, value double").collect()]
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    want = 2 * [(k, x["fact_id"], x["value"]) for k, v in lists.items() for x in v]
    want += [(None, x["fact_id"], x["value"]) for x in json.loads((tmp_path / "c.json").read_text())]
    assert sorted(got, key=str) == sorted(want, key=str)


def test_profiles_of_mixed_records(spark):
    from tallyframe.operators import registry

    a = [{"School Code": "12", "n": 1, "m": 1, "d": "date of issue", "x": None, "deep": {"a": 1}}, {"School Code": "x", "n": 2.5, "m": "1", "d": "01/02/2020", "flag": True}, {"n": 3, "m": None}]
    rows = [("p/a.csv", json.dumps(r)) for r in a] + [("b.pdf", json.dumps({"t": "a Table of teachers"})), ("c", "{}"), ("d.json", None)]
    df = spark.createDataFrame(rows, "path string, json string")
    got = {(r.path, r.field): (r.kind, pytest.approx(r.null_share)) for r in registry.field_profiles(df).collect() if r.field}
    want = {"school_code": ("string", 1 / 3), "n": ("float", 0), "m": ("string", 1 / 3), "d": ("date", 1 / 3), "x": ("unknown", 1), "deep": ("unknown", 2 / 3), "flag": ("integer", 2 / 3)}
    assert got == {("p/a.csv", f): (k, s) for f, (k, s) in want.items()} | {("b.pdf", "t"): ("string", 0)}
    found = {r.path: r for r in registry.profiled(df).collect()}
    assert found["p/a.csv"].name == "a_school" and found["p/a.csv"].bridge_potential == ["school_code"]
    assert (found["b.pdf"].method, found["b.pdf"].entity_types, found["c"].source_type, found["d.json"].method) == ("table_extraction", ["teacher"], "unknown", "structured")


def test_rows_are_numbered_without_gaps(spark):
    from tallyframe.operators.windows import numbered

    rows = spark.range(5000).select((F.col("id") * 7919 % 1000).alias("x"), F.lit("a").alias("y")).repartition(13)
    got = [r.x for r in numbered(rows, ["x"], "ord").orderBy("ord").collect()]
    assert got == sorted(got)
    assert [r.ord for r in numbered(rows, ["x"], "ord").orderBy("ord").collect()] == list(range(1, 5001))
    assert numbered(rows.limit(0), ["x"], "ord").count() == 0


def test_texts_are_split_once_for_an_index(spark):
    df = spark.createDataFrame([(1, "b a b"), (2, None), (3, ""), (4, "a"), (4, "a a c"), (4, "c a a"), (5, "d")], "doc_id long, text string")
    plan = keyword_index.counted(df, "doc_id", "text")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("split(") == 1 and "Exchange" not in plan
    index = keyword_index.build(df, "doc_id", "text")
    want = [("a", 1, 3, 1), ("b", 1, 3, 2), ("a", 4, 1, 1), ("a", 4, 3, 4), ("c", 4, 3, 2), ("d", 5, 1, 1)]  # rows of one key and length are one
    assert sorted(tuple(r) for r in index.postings.select("term", "key", "n", "f").collect()) == sorted(want)
    assert (index.docs, index.mean) == (7, 11 / 6)
    none = keyword_index.build(df.where("text is null"), "doc_id", "text")
    assert (none.docs, none.mean, none.postings.count()) == (1, 1.0, 0)
