"""Operators on small tables whose results were worked out by hand."""

from __future__ import annotations

import json

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tallyframe.functions import similarity
from tallyframe.functions.vocabulary import DISTRICT_SPELLINGS
from tallyframe.operators import aggregates, bridges, entities, filters, graph, legal, normalise, retrieval, routing, scoring, validation
from tallyframe.sources import files, sinks
from tallyframe.sources.facts import FACT_SCHEMA


def fact(i, district, indicator, value, year=2022, unit="count", doc="cse_a.pdf", category=None):
    return (f"fact_{i:03}", district, indicator, category, year, value, unit, doc, 1, 0.9, i)


@pytest.fixture(scope="module")
def three(spark):
    rows = [fact(1, "Anantapur", "Total Enrollment", 125000.0), fact(2, "Invalid District", "Total Enrollment", 999999.0), fact(3, "Chittoor", "Dropout Rate", 150.0, unit="%")]
    return spark.createDataFrame(rows, FACT_SCHEMA)


def test_validator(three):
    rows = {r.fact_id: r for r in validation.validated(three, 2024).collect()}
    assert (rows["fact_001"].is_valid, rows["fact_001"].confidence) == (True, 1.0)
    assert (rows["fact_002"].errors, rows["fact_002"].confidence) == (["DIST_001", "VAL_001"], 0.5)
    assert (rows["fact_003"].errors, rows["fact_003"].confidence) == (["VAL_001"], 0.8)
    assert all(r.warnings == [] for r in rows.values())


def test_validator_edges(spark):
    rows = [fact(1, "Guntur", "Total Enrollment", 1000.0), fact(2, "Guntur", "Boys Enrollment", 475.0), fact(3, "Guntur", "Girls Enrollment", 475.0), fact(4, "Krishna", "Total Enrollment", 1000.0), fact(5, "Krishna", "Boys Enrollment", 474.0), fact(6, "Krishna", "Girls Enrollment", 475.0)]
    rows += [fact(7, "Guntur", "Dropout Rate", None, unit="%"), fact(8, "Guntur", "Dropout Rate", 10.0, None, "%"), fact(9, None, None, 1.0), fact(10, "Nellore", "Dropout Rate", 10.0, 2020, "%"), fact(11, "Nellore", "Dropout Rate", 15.0, 2021, "%"), fact(12, "Nellore", "Dropout Rate", 22.6, 2022, "%")]
    got = {r.fact_id: r for r in validation.validated(spark.createDataFrame(rows, FACT_SCHEMA), 2024).collect()}
    assert got["fact_001"].warnings == [] and got["fact_004"].warnings == ["CONS_001"]
    assert got["fact_007"].errors == ["VAL_001"] and got["fact_007"].confidence == 0.7
    assert got["fact_008"].errors == ["YEAR_001"] and got["fact_008"].confidence == 0.9
    assert got["fact_009"].confidence == 0.5
    assert got["fact_011"].warnings == [] and got["fact_012"].warnings == ["TEMP_001"]


def test_outliers_exclude_the_own_district(spark):
    rows = [fact(i, d, "Dropout Rate", v, unit="%") for i, (d, v) in enumerate([("Guntur", 10.0), ("Krishna", 10.0), ("Nellore", 10.0), ("Kadapa", 10.0), ("Kurnool", 40.0)])]
    stats = validation.peer_statistics(spark.createDataFrame(rows, FACT_SCHEMA))
    got = {r.fact_id: r for r in stats.withColumn("out", validation.outlier(*[F.col(c) for c in ("value", "mean", "deviation", "q1", "q3")])).collect()}
    assert got["fact_004"].peers == 4 and got["fact_004"].deviation == 0 and not got["fact_004"].out
    assert got["fact_000"].mean == 17.5


def test_cross_district_ties(spark):
    rows = [fact(1, "Guntur", "Dropout Rate", 5.0), fact(2, "Krishna", "Dropout Rate", 5.0), fact(3, "Nellore", "Dropout Rate", 5.0)]
    row = aggregates.cross_district(spark.createDataFrame(rows, FACT_SCHEMA)).first()
    assert (row.highest_district, row.lowest_district, row.performance_gap) == ("Guntur", "Nellore", 0.0)


def test_edges_are_closed_form(spark):
    rows = [fact(i, "Guntur", "Dropout Rate", float(i), doc=None) for i in range(6)]
    df = spark.createDataFrame(rows, FACT_SCHEMA)
    assert bridges.edges(df, "district_year", ["district", "year"], 0.8).count() == bridges.edge_counts(df, ["district", "year"]).first().edges == 15
    assert {r.strength for r in bridges.fact_graph(df).collect()} == {1.0}


LEGAL = """Government Order No. 45/2023
hereby supersedes G.O. No. 12/2019
1. Applicability
(a) all schools
(b) all teachers
"School" means any recognised institution
w.e.f. 1st June 2023"""


def test_legal_order(spark):
    docs = spark.createDataFrame([(1, LEGAL)], "doc_id long, text string")
    row = legal.supersessions(docs).first()
    assert (row.superseding, row.superseded, row.kind) == ("GO 45/2023", "GO 12/2019", "full")
    assert [(r.term, r.meaning.split("\n")[0]) for r in legal.definitions(docs).collect()] == [("School", "any recognised institution")]
    assert legal.effective_dates(docs).count() == 0
    assert legal.analysed(docs).first().kind == "government_order"


def test_hierarchy_levels_reset(spark):
    text = "PART 1 One\nCHAPTER I Two\n1. Three\n(a) four\nPART 2 Five\n2. Six\n(b) seven\nCHAPTER II Eight\n3. Nine"
    rows = legal.hierarchy(spark.createDataFrame([(1, text)], "doc_id long, text string")).orderBy("line").collect()
    assert [(r.level, r.parent) for r in rows] == [(1, None), (2, "Part 1"), (3, "Chapter I"), (4, "Section 1"), (1, None), (3, None), (4, "Section 2"), (2, "Part 2"), (3, "Chapter II")]


def test_graph_paths(spark):
    e = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "d"), ("x", "y")], "source string, target string")
    pairs = spark.createDataFrame([("a", "d"), ("a", "y"), ("d", "a")], "source string, target string")
    assert sorted((r.source, r.target, r.distance) for r in graph.shortest(e, pairs).collect()) == [("a", "d", 3), ("d", "a", 3)]
    label = {r.id: r.component for r in entities.components(e).collect()}
    assert label == {"a": "a", "b": "a", "c": "a", "d": "a", "x": "x", "y": "x"}


def test_similarity():
    assert similarity.sequence_ratio("abcd", "bcde") == 0.75
    assert similarity.ratio("guntur", "guntoor") == 77 and similarity.ratio("", "a") == 0
    assert similarity.partial_ratio("guntur", "the guntur district") == 100


@settings(max_examples=30, deadline=None)
@given(st.text("abc", max_size=8), st.text("abc", max_size=8))
def test_similarity_bounds(a, b):
    assert 0 <= similarity.partial_ratio(a, b) <= 100 and similarity.ratio(a, a) in (0, 100)


def test_fuzzy_names(spark):
    rows = spark.createDataFrame([("gunturr",), ("Krishna",), ("zzz",), (None,)], "d string")
    got = {r.d: r.name for r in normalise.fuzzy(rows, "d", DISTRICT_SPELLINGS, "name", similarity.partial_ratio, 80).collect()}
    assert got["gunturr"] == "Guntur" and got["Krishna"] == "Krishna" and got["zzz"] is None


def test_fuzzy_entities(spark):
    rows = [("udise", "school", "s1", "Govt High School Guntur", 2020), ("cse", "school", "s2", "Govt High School, Guntur", 2010), ("cse", "school", "s3", "Another Place", 2010)]
    found = entities.links(spark.createDataFrame(rows, "dataset string, entity_type string, entity_id string, name string, year int"), fuzzy=True).collect()
    assert [(r.source, r.target, r.kind) for r in found] == [("cse:s2", "udise:s1", "fuzzy")] and found[0].confidence > 0.8


def test_answers(spark):
    df = spark.createDataFrame([("It always grew by 10%, 20%, 30% and 40%. Studies show that all is well.", "It grew.")], "a string, c string")
    assert df.select(scoring.hallucination_risk(F.col("a"), F.col("c"))).first()[0] == pytest.approx(0.2 + 0.1 + 0.15 + 0.1)
    assert df.select(routing.question_type(F.lit("compare trends in enrollment"))).first()[0] == "statistical"
    lines = spark.createDataFrame([(2, "two"), (1, "one"), (3, "three"), (4, "four")], "n int, t string")
    assert retrieval.bullets(lines, "t", "n").first().answer == "- one\n- two\n- three"


def test_hybrid(spark):
    v = spark.createDataFrame([(1, 0.9), (2, 0.1)], "id long, score double")
    k = spark.createDataFrame([(2, 5.0), (3, 1.0)], "id long, score double")
    got = [(r.id, round(r.score, 6)) for r in retrieval.hybrid(v, k, "id", 0.7, 10).collect()]
    assert got == [(1, 0.7), (2, 0.3), (3, 0.0)]
    assert [r.id for r in retrieval.hybrid(v, k, "id", 1.0, 1).collect()] == [1]


def test_sources(spark, tmp_path):
    (tmp_path / "items.json").write_text(json.dumps({"doc": [{"page": 1, "text": "a"}, {"page": 2, "text": "b"}]}))
    got = files.json_items(spark, str(tmp_path / "items.json"), "page:int,text:string").collect()
    assert [(r.source_document, r.page, r.text) for r in got] == [("doc", 1, "a"), ("doc", 2, "b")]
    (tmp_path / "stats.csv").write_text("Dist Name,Metric,Total,Academic Year\nGuntur,GER,1.5,2020\nKrishna,GER,none,2021\n")
    assert [tuple(r) for r in files.statistics_csv(spark, str(tmp_path / "stats.csv")).collect()] == [("Guntur", "GER", 1.5, 2020), ("Krishna", "GER", None, 2021)]
    assert files.corpus_index(spark, str(tmp_path / "none.csv")).columns == files.INDEX_COLUMNS
    seen = files.hashed_files(spark, str(tmp_path))
    assert seen.count() == 2
    tracker = spark.createDataFrame([r for r in seen.collect() if "csv" in r.key], "key string, hash string")
    assert files.changed(seen, tracker).count() == 1
    assert files.texts(spark, str(tmp_path / "stats.csv")).first().text.startswith("Dist")


def test_sinks(spark, three, tmp_path):
    for kind in ("json", "csv", "parquet"):
        sinks.write_facts(three, str(tmp_path / kind), kind)
    assert files.facts_json(spark, str(tmp_path / "json/*.json")).count() == 3 or spark.read.schema(FACT_SCHEMA).json(str(tmp_path / "json")).count() == 3
    assert spark.read.parquet(str(tmp_path / "parquet")).count() == 3
    sinks.write_graph(three, str(tmp_path / "graph"))
    assert spark.read.parquet(str(tmp_path / "graph/edges")).count() == 12
    sinks.write_report(three.groupBy().count(), str(tmp_path / "report"))
    assert spark.read.json(str(tmp_path / "report")).first()["count"] == 3
    assert sinks.vector_rows(spark.createDataFrame([(None,) * 11], FACT_SCHEMA)).first().district == "Unknown"


def test_empty_tables(spark, three):
    none = three.limit(0)
    assert validation.validated(none, 2024).count() == 0 and aggregates.cross_district(none).count() == 0 and bridges.fact_graph(none).count() == 0
    assert filters.valid_normalised(none).count() == 0
