"""Queries of legal documents, orders, generated texts, single link strategies and search compositions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import similarity
from ..functions.vocabulary import EDGE_THRESHOLDS
from ..operators import bridges as B
from ..operators import documents as D
from ..operators import entities as E
from ..operators import legal as L
from ..operators import retrieval as T
from ..operators import routing as R
from ..operators import validation as V
from ..operators import windows as W
from ..operators.aggregates import document_type
from ..sources.facts import facts, legal_texts, table
from . import structured  # noqa: F401  its twins are counted here
from .registry import ORACLES, query
from .textual import ASKED, SHIFTED, SOUGHT, WORDS, asked, shifted, unnested


COVERS = "'This order covers Section 12(a) of The Education Act, ' || (year(o_orderdate) + 19) || ' and Rule 7 as amended by notice of ' || (year(o_orderdate) + 19)"
EFFECT = "'effective from ' || day(o_orderdate) || '/' || month(o_orderdate) || '/' || year(o_orderdate) || CASE WHEN o_orderkey % 5 = 0 THEN chr(10) || 'in Guntur by order of the education department' ELSE '' END || chr(10) || 'Step 1: apply'"


@query(f"SELECT o_orderkey AS doc_id, '1' AS number, 'Short title' || chr(10) || '(a) ' || {COVERS} AS text FROM orders UNION ALL SELECT o_orderkey, '2', 'Effect' || chr(10) || '(b) ' || {EFFECT} FROM orders")
def lg2_clauses(spark: SparkSession, sf: str) -> DataFrame:
    return D.paragraphs(legal_texts(spark, sf), D.CLAUSE)


@query(f"SELECT o_orderkey AS doc_id, 'a' AS number, {COVERS} || chr(10) || '2. Effect' AS text FROM orders UNION ALL SELECT o_orderkey, 'b', {EFFECT} FROM orders")
def lg2_rule_clauses(spark: SparkSession, sf: str) -> DataFrame:
    return D.paragraphs(legal_texts(spark, sf), D.LETTERED)


@query("SELECT o_orderkey AS doc_id, (o_custkey % 5 + 1)::VARCHAR AS number, length('Schools' || chr(10) || '1. Short title' || chr(10) || '(a) This order covers Section 12(a) of The Education Act, 2014 and Rule 7 as amended by notice of 2014' || chr(10) || '2. Effect' || chr(10) || '(b) effective from ' || day(o_orderdate) || '/' || month(o_orderdate) || '/' || year(o_orderdate) || CASE WHEN o_orderkey % 5 = 0 THEN chr(10) || 'in Guntur by order of the education department' ELSE '' END || chr(10) || 'Step 1: apply')::INTEGER AS length FROM orders")
def lg2_sections(spark: SparkSession, sf: str) -> DataFrame:
    return D.paragraphs(legal_texts(spark, sf), D.SECTIONED).select("doc_id", "number", F.length("text").alias("length"))


@query("SELECT n_nationkey, CASE WHEN n_nationkey % 2 = 0 THEN 'GOVERNMENT OF ' || n_name ELSE 'Untitled Document' END AS title FROM nation")
def lg2_title(spark: SparkSession, sf: str) -> DataFrame:
    text = F.concat(F.lit("Intro\n  "), F.when(F.col("n_nationkey") % 2 == 0, F.concat(F.lit("GOVERNMENT OF "), "n_name")).otherwise("Some Title Here"), F.lit("\nbody"))
    return table(spark, sf, "nation").select("n_nationkey", L.title(text).alias("title"))


@query("SELECT doc_id, nullif(regexp_extract(text, '([A-Z][A-Za-z\\s,]+(?:Act|LAW),?\\s*[0-9]{4})', 1), '') AS act, nullif(regexp_extract(text, '([A-Z][A-Za-z\\s]+Rules?,?\\s*[0-9]{4})', 1), '') AS rule FROM {legal} t")
def lg2_parent_act(spark: SparkSession, sf: str) -> DataFrame:
    t = F.col("text")
    return legal_texts(spark, sf).select("doc_id", D.first(t, D.PARENT_ACT).alias("act"), D.first(t, D.PARENT_RULE).alias("rule"))


@query(unnested(L.JUDGMENT, [2, 3, 4], "doc_id, g2 AS reporter, g3 AS number, g4 AS court"))
def lg_judgment_refs(spark: SparkSession, sf: str) -> DataFrame:
    return L.found(legal_texts(spark, sf), L.JUDGMENT, 4).select("doc_id", F.col("g2").alias("reporter"), F.col("g3").alias("number"), F.col("g4").alias("court"))


GO = "SELECT o_orderkey AS doc_id, o_orderkey::VARCHAR AS go_number, 'School Education' AS department, CASE o_orderkey % 3 WHEN 0 THEN 'Krishna' WHEN 1 THEN 'Guntur' END AS district FROM orders"


def go_texts(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("o_orderkey")
    place = F.when(k % 3 == 0, " for KRISHNA and guntur").when(k % 3 == 1, " for Guntur").otherwise("")
    return table(spark, sf, "orders").select(k.alias("doc_id"), F.concat(F.lit("G.O.MS.No. "), k.cast("string"), place, F.lit("\nDepartment: School Education 5")).alias("text"))


@query(GO)
def go_entities(spark: SparkSession, sf: str) -> DataFrame:
    return D.order_entities(go_texts(spark, sf))


@query(f"SELECT 'AP_GO_' || go_number AS fact_id, coalesce(district, 'Unknown') AS district, 'Government Order' AS indicator, 2024 AS year, 1.0::DOUBLE AS value, 'AP_GO_' || go_number AS source_document FROM ({GO})")
def go_bridges(spark: SparkSession, sf: str) -> DataFrame:
    return D.order_facts(D.order_entities(go_texts(spark, sf)), 2024)


@query("SELECT n_nationkey, CASE WHEN n_nationkey % 2 = 0 THEN 'Govt High School' ELSE '' END AS names FROM nation")
def fn_school_names(spark: SparkSession, sf: str) -> DataFrame:
    text = F.when(F.col("n_nationkey") % 2 == 0, "GOVT HIGH SCHOOL, 12").otherwise("12 none")
    return table(spark, sf, "nation").select("n_nationkey", F.array_join(D.school_names(text), "|").alias("names"))


@query(f"SELECT fact_id, CASE WHEN contains(l, 'dropout') THEN CASE WHEN contains(l, 'sc') THEN 'DROPOUT_SC' WHEN contains(l, 'st') THEN 'DROPOUT_ST' ELSE 'DROPOUT_RATE' END WHEN contains(l, 'enroll') THEN CASE WHEN contains(l, 'sc') THEN 'ENROLL_SC' WHEN contains(l, 'st') THEN 'ENROLL_ST' WHEN contains(l, 'girl') OR contains(l, 'female') THEN 'ENROLL_GIRL' ELSE 'ENROLL_TOTAL' END WHEN contains(l, 'school') THEN CASE WHEN contains(l, 'govt') OR contains(l, 'government') THEN 'SCHOOLS_GOVT' WHEN contains(l, 'private') THEN 'SCHOOLS_PRIVATE' ELSE 'SCHOOLS_TOTAL' END WHEN contains(l, 'teacher') THEN CASE WHEN contains(l, 'ratio') OR contains(l, 'ptr') THEN 'PTR' ELSE 'TEACHERS_TOTAL' END WHEN contains(l, 'budget') THEN CASE WHEN contains(l, 'expend') THEN 'BUDGET_EXPENDITURE' ELSE 'BUDGET_ALLOCATION' END END AS code FROM (SELECT fact_id, lower(q) AS l FROM {ASKED})")
def fn_norm_indicator_dp(spark: SparkSession, sf: str) -> DataFrame:
    return asked(spark, sf).select("fact_id", D.indicator_code(F.col("q")).alias("code"))


@query("SELECT fact_id, indicator || ' is ' || printf('%.2f', value) || ' ' || unit || ' in ' || district || ' for ' || year || '. This data pertains to education statistics in Andhra Pradesh. Source: ' || source_document AS text FROM {facts} f")
def fn_searchable_text(spark: SparkSession, sf: str) -> DataFrame:
    c = F.col
    return facts(spark, sf).select("fact_id", D.searchable(c("indicator"), F.format_string("%.2f", "value"), c("unit"), c("district"), c("year"), c("source_document")).alias("text"))


@query("SELECT district, 'Bridge type: district_year | district: ' || district || ' | Facts: ' || count(*) || ' | Indicators: ' || array_to_string(list_sort(list(DISTINCT indicator))[1:3], ', ') AS content FROM {facts} f GROUP BY district")
def fn_bridge_content(spark: SparkSession, sf: str) -> DataFrame:
    g = facts(spark, sf).groupBy("district").agg(F.count(F.lit(1)).alias("n"), F.array_sort(F.collect_set("indicator")).alias("i"))
    return g.select("district", F.concat_ws(" | ", F.lit("Bridge type: district_year"), F.concat(F.lit("district: "), "district"), F.concat(F.lit("Facts: "), F.col("n").cast("string")), F.concat(F.lit("Indicators: "), F.array_join(F.slice("i", 1, 3), ", "))).alias("content"))


@query("SELECT a.fact_id AS source, b.fact_id AS target, 'Same indicator (' || a.indicator || ') across years ' || a.year || '-' || b.year AS reason FROM {facts} a JOIN {facts} b ON a.indicator = b.indicator AND a.district = b.district AND a.ord < b.ord")
def sc_connection_reason(spark: SparkSession, sf: str) -> DataFrame:
    p = B.pairs_within(facts(spark, sf), ["indicator", "district"])
    return p.select(F.col("a.fact_id").alias("source"), F.col("b.fact_id").alias("target"), D.reason("indicator_temporal", F.col("a"), F.col("b")).alias("reason"))


@query("SELECT a.fact_id AS source, b.fact_id AS target, least(10, 4 + 3 * (a.indicator = b.indicator)::INT + CASE WHEN abs(a.year - b.year) <= 1 THEN 3 WHEN abs(a.year - b.year) <= 3 THEN 2 ELSE 0 END + 2 * (a.source_document = b.source_document)::INT) / 10.0::DOUBLE AS strength FROM {facts} a JOIN {facts} b ON a.district = b.district AND a.ord < b.ord")
def sc_relationship(spark: SparkSession, sf: str) -> DataFrame:
    p = B.pairs_within(facts(spark, sf), ["district"])
    return p.select(F.col("a.fact_id").alias("source"), F.col("b.fact_id").alias("target"), (B.relation_tenths(F.col("a"), F.col("b")) / F.lit(10.0)).alias("strength"))


@query("SELECT a.fact_id AS source, b.fact_id AS target, CASE WHEN a.district = b.district THEN 'district' ELSE 'indicator' END AS kind FROM {facts} a JOIN {facts} b ON a.indicator = b.indicator AND a.year = b.year AND a.ord < b.ord")
def sc_relationship_type(spark: SparkSession, sf: str) -> DataFrame:
    p = B.pairs_within(facts(spark, sf), ["indicator", "year"])
    return p.select(F.col("a.fact_id").alias("source"), F.col("b.fact_id").alias("target"), B.relation_kind(F.col("a"), F.col("b")).alias("kind"))


#: kinds of edges: the attributes of their groups, and the query whose twin makes them
EDGE_GROUPS = {"district_year": (["district", "year"], "join_pairs_in_group"), "indicator_temporal": (["indicator", "district"], "sc_connection_strength"), "policy_hierarchy": (["doc_type", "indicator"], "edge_policy"), "cross_district": (["indicator", "year"], "edge_cross")}


@query(" UNION ALL ".join(f"SELECT '{k}' AS kind, {v}::DOUBLE AS threshold, count(*) AS edges, min(strength) AS weakest FROM ({ORACLES[EDGE_GROUPS[k][1]]})" for k, v in EDGE_THRESHOLDS.items()))
def sc_thresholds(spark: SparkSession, sf: str) -> DataFrame:
    """The edges of each kind that its threshold leaves."""
    f = facts(spark, sf).withColumn("doc_type", document_type(F.col("source_document")))
    counts = [B.edges(f, k, EDGE_GROUPS[k][0], v).agg(F.lit(k).alias("kind"), F.lit(v).alias("threshold"), F.count(F.lit(1)).alias("edges"), F.min("strength").alias("weakest")) for k, v in EDGE_THRESHOLDS.items()]
    return reduce(DataFrame.union, counts)


@query(f"SELECT fact_id, round(least(1, ({WORDS} / 20.0::DOUBLE + {SOUGHT} / 10.0::DOUBLE) / 4), 6) >= 0 AS positive FROM {ASKED}")
def sc_query_complexity(spark: SparkSession, sf: str) -> DataFrame:
    return asked(spark, sf).select("fact_id", (R.complexity(F.col("q")) >= 0).alias("positive"))


@query("SELECT f.fact_id, p.value > 0 AND abs(f.value - p.value) / p.value > 0.5::DOUBLE AS jump FROM {facts} f JOIN {facts} p ON p.district = f.district AND p.indicator = f.indicator AND f.year = p.year + 1")
def sc_temporal(spark: SparkSession, sf: str) -> DataFrame:
    v, p = F.col("value"), F.col("previous")
    return V.previous_year(facts(spark, sf)).select("fact_id", ((p > 0) & (F.abs(v - p) / p > 0.5)).alias("jump"))


def linked(rows: DataFrame) -> DataFrame:
    return rows.select(F.concat_ws(":", "a.dataset", "a.entity_id").alias("source"), F.concat_ws(":", "b.dataset", "b.entity_id").alias("target"))


SIDES = f"(SELECT * FROM {SHIFTED} WHERE dataset = 'left') a JOIN (SELECT * FROM {SHIFTED} WHERE dataset = 'right') b"
ENDS = "'left:' || a.entity_id AS source, 'right:' || b.entity_id AS target"


@query(f"SELECT {ENDS} FROM {SIDES} ON a.entity_id = b.entity_id")
def er_exact(spark: SparkSession, sf: str) -> DataFrame:
    return linked(E.matched(shifted(spark, sf), F.col("entity_id"), "exact", 95))


@query(f"SELECT {ENDS} FROM {SIDES} ON split_part(a.entity_id, '_', 2) = split_part(b.entity_id, '_', 2)")
def er_code(spark: SparkSession, sf: str) -> DataFrame:
    e = shifted(spark, sf)
    return linked(E.matched(e, E.code_of(F.col("entity_id"), 4), "code", 90))


@query("SELECT DISTINCT a.t AS source, b.t AS target FROM (SELECT lower(split_part(source_document, '_', 1)) AS t, district FROM {facts} f) a JOIN (SELECT lower(split_part(source_document, '_', 1)) AS t, district FROM {facts} f) b ON a.district = b.district AND a.t < b.t")
def er_geo(spark: SparkSession, sf: str) -> DataFrame:
    e = E.extracted(facts(spark, sf)).where("entity_type = 'district'")
    return E.matched(e, F.lower("name"), "geographic", 70).select(F.col("a.dataset").alias("source"), F.col("b.dataset").alias("target")).distinct()


@query("SELECT source_document AS entity_id, count(*) AS degree FROM {facts} f GROUP BY 1")
def er_graph(spark: SparkSession, sf: str) -> DataFrame:
    return facts(spark, sf).groupBy(F.col("source_document").alias("entity_id")).agg(F.count(F.lit(1)).alias("degree"))


@query()
def fn_seq_ratio(spark: SparkSession, sf: str) -> DataFrame:
    c = table(spark, sf, "customer")
    return c.select("c_custkey", similarity.sequence_ratio_udf("c_name", "c_mktsegment").alias("ratio"))


@query("WITH q AS (SELECT embedding::DOUBLE[] AS x FROM embeddings WHERE vec_id = 3) SELECT vec_id, round((1 + list_cosine_similarity(embedding::DOUBLE[], q.x)) / 2, 6) AS certainty FROM embeddings, q ORDER BY list_cosine_similarity(embedding::DOUBLE[], q.x) DESC, vec_id LIMIT 10")
def rt_facts_certainty(spark: SparkSession, sf: str) -> DataFrame:
    v = table(spark, sf, "embeddings")
    near = T.nearest(v, "vec_id", "embedding", list(v.where("vec_id = 3").first().embedding), 10)
    return near.select("vec_id", F.round((1 + F.col("score")) / 2, 6).alias("certainty"))


@query("SELECT content, max(score) AS score FROM (SELECT district AS content, confidence_score AS score FROM {facts} f WHERE year = 2018 UNION ALL SELECT district, 0.75::DOUBLE FROM {facts} f WHERE year = 2019) GROUP BY content")
def fu_merge(spark: SparkSession, sf: str) -> DataFrame:
    f = facts(spark, sf)
    both = f.where("year = 2018").select(F.col("district").alias("content"), F.col("confidence_score").alias("score")).union(f.where("year = 2019").select("district", F.lit(0.75)))
    return both.groupBy("content").agg(F.max("score").alias("score"))


@query("SELECT fact_id, CASE WHEN confidence_score > 0.8::DOUBLE THEN 'Highly relevant to your query' WHEN confidence_score > 0.6::DOUBLE THEN 'Good match for your query' ELSE 'Related to your search terms' END || '. ' || CASE WHEN ord % 2 = 0 THEN 'Contains temporal/trend information' ELSE 'Contains statistical data' END || '.' AS said FROM {facts} f")
def en_explain(spark: SparkSession, sf: str) -> DataFrame:
    kind = F.when(F.col("ord") % 2 == 0, "temporal").otherwise("statistical")
    return facts(spark, sf).select("fact_id", D.explanation(F.col("confidence_score"), kind).alias("said"))


@query("SELECT conv_id, turn, replace(replace('**' || role || '** __' || turn || '__', '**', ''), '__', '') AS text FROM conversations")
def gen_enforce(spark: SparkSession, sf: str) -> DataFrame:
    marked = F.concat(F.lit("**"), "role", F.lit("** __"), F.col("turn").cast("string"), F.lit("__"))
    return table(spark, sf, "conversations").select("conv_id", "turn", D.plain(marked).alias("text"))


@query("SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d') AS date FROM orders")
def fn_normalize_date(spark: SparkSession, sf: str) -> DataFrame:
    text = F.when(F.col("o_orderkey") % 2 == 0, F.date_format("o_orderdate", "M/d/yyyy")).otherwise(F.date_format("o_orderdate", "d MMMM yyyy"))
    return table(spark, sf, "orders").select("o_orderkey", D.iso_date(text).alias("date"))


@query("SELECT fact_id, confidence_score FROM {facts} f ORDER BY confidence_score DESC, fact_id LIMIT 10")
def topk_relevance(spark: SparkSession, sf: str) -> DataFrame:
    return W.ranked(facts(spark, sf), "confidence_score", "fact_id", 10).select("fact_id", "confidence_score")
