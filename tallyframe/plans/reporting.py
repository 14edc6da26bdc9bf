"""Queries of table parsing, schemas, reports, citations and incremental figures."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.vocabulary import DISTRICTS
from ..operators import entities as E
from ..operators import reports as P
from ..operators import retrieval as T
from ..operators import scoring as S
from ..operators import tables as B
from ..operators.bridges import fact_graph
from ..operators.communities import modularity_communities
from ..sources.facts import facts, legal_texts, table
from ..streaming import incremental
from .registry import query
from .relational import DOC_TYPE
from .structured import NET, net
from .textual import SUPERSEDED


def shown(tables: DataFrame) -> DataFrame:
    return tables.select("n_nationkey", F.array_join("headers", "|").alias("headers"), F.array_join(F.transform("rows", lambda r: F.array_join(r, "|")), ";").alias("rows"), "method", "confidence")


def nation_texts(spark: SparkSession, sf: str, *parts: str) -> DataFrame:
    return table(spark, sf, "nation").select("n_nationkey", F.expr(" || ".join(parts)).alias("text"))


@query("SELECT n_nationkey, 'District|Value|Additional Info' AS headers, 'Guntur|' || (n_nationkey + 5) || '|;Krishna|1,234|7' AS rows, 'district_table' AS method, 0.7::DOUBLE AS confidence FROM nation")
def tp_district(spark: SparkSession, sf: str) -> DataFrame:
    return shown(B.parsed(nation_texts(spark, sf, "'About Krishna 1,234 and 7, Guntur has '", "cast(n_nationkey + 5 as string)", "' pupils'"), "n_nationkey", "text"))


@query("SELECT n_nationkey, 'Serial|District|Application ID|Applicant Name' AS headers, '1|Alpha|AP' || (202300000000 + n_nationkey) || '|Some One;2|Beta|AP202300000099|Other Name' AS rows, 'application_table' AS method, 0.9::DOUBLE AS confidence FROM nation")
def tp_application(spark: SparkSession, sf: str) -> DataFrame:
    return shown(B.parsed(nation_texts(spark, sf, "'1 Alpha AP'", "cast(202300000000 + n_nationkey as string)", "' Some One 2 Beta AP202300000099 Other Name'"), "n_nationkey", "text"))


@query("SELECT n_nationkey, 'Indicator|Value_1|Value_2|Value_3' AS headers, 'Boys|' || n_nationkey || '|20|30;Girls|1,000|2|' AS rows, 'statistical_table' AS method, 0.6::DOUBLE AS confidence FROM nation")
def tp_statistical(spark: SparkSession, sf: str) -> DataFrame:
    return shown(B.parsed(nation_texts(spark, sf, "'Boys '", "cast(n_nationkey as string)", "' 20 30\\nGirls 1,000 2\\nno numbers'"), "n_nationkey", "text"))


@query("SELECT n_nationkey, 'Scheme/Department|Allocation|Currency' AS headers, 'Meals|' || n_nationkey || '.5|crore;Books|7|lakh' AS rows, 'budget_table' AS method, 0.7::DOUBLE AS confidence FROM nation")
def tp_budget(spark: SparkSession, sf: str) -> DataFrame:
    return shown(B.parsed(nation_texts(spark, sf, "'Meals '", "cast(n_nationkey as string)", "'.5 crore\\nBooks 7 Lakh'"), "n_nationkey", "text"))


@query("SELECT n_nationkey, 'Sl.No|Name|Town' AS headers, '1|alpha|x' || ';2|beta|y' AS rows, 'numbered_list' AS method, 0.8::DOUBLE AS confidence FROM nation")
def tp_numbered(spark: SparkSession, sf: str) -> DataFrame:
    return shown(B.parsed(nation_texts(spark, sf, "'Sl.No Name Town\\n1 alpha x\\n2 beta y'"), "n_nationkey", "text"))


@query("SELECT n_nationkey, n_nationkey % 2 = 0 AS well, 'a b' AS first FROM nation")
def tp_well_structured(spark: SparkSession, sf: str) -> DataFrame:
    headers = F.array(F.lit("a\n  b"), F.when(F.col("n_nationkey") % 2 == 0, "Name").otherwise("12"), F.lit("x"), F.lit("3.5"))
    return table(spark, sf, "nation").select("n_nationkey", B.well_structured(headers).alias("well"), B.clean_headers(headers)[0].alias("first"))


@query("SELECT n_nationkey, CASE WHEN n_nationkey % 2 = 0 THEN 'Table ' || n_name ELSE 'statistics x' END AS caption FROM nation")
def fn_caption(spark: SparkSession, sf: str) -> DataFrame:
    rows = F.array(F.array(F.lit("a"), F.lit("b")), F.when(F.col("n_nationkey") % 2 == 0, F.array(F.lit("Table"), F.col("n_name"))).otherwise(F.array(F.lit("c"))), F.array(F.lit("statistics"), F.lit("x")))
    return table(spark, sf, "nation").select("n_nationkey", B.caption(rows).alias("caption"))


COMM = "SELECT r_name AS community, fact_id, district, indicator, year, ord FROM {facts} f JOIN (SELECT n_nationkey, n_regionkey FROM nation) ON n_nationkey = ord // 1000 JOIN region ON r_regionkey = n_regionkey"


@query(f"WITH m AS ({COMM}), t AS (SELECT community, indicator AS theme, row_number() OVER (PARTITION BY community ORDER BY count(*) DESC, min(ord)) AS i FROM m GROUP BY 1, 2) SELECT m.community, count(*) AS n, count(DISTINCT district) AS districts, count(DISTINCT indicator) AS indicators, min(year) AS first_year, max(year) AS last_year, any_value(theme) AS theme FROM m JOIN t ON t.community = m.community AND i = 1 GROUP BY 1")
def agg_community_summary(spark: SparkSession, sf: str) -> DataFrame:
    n, r = table(spark, sf, "nation").select("n_nationkey", "n_regionkey"), table(spark, sf, "region")
    members = facts(spark, sf).join(n, F.floor(F.col("ord") / 1000) == F.col("n_nationkey")).join(r, F.col("r_regionkey") == F.col("n_regionkey"))
    return P.community_summaries(members.withColumn("community", F.col("r_name")))


@query("SELECT district, round(least(1, 0.3::DOUBLE * (district IN ('Guntur', 'Krishna'))::INT + 0.4::DOUBLE * count(DISTINCT indicator) FILTER (WHERE indicator IN ('Dropout Rate')) + CASE WHEN max(year) >= 2020 THEN 0.3::DOUBLE ELSE 0 END), 6) AS score FROM {facts} f GROUP BY district")
def sc_community_relevance(spark: SparkSession, sf: str) -> DataFrame:
    g = facts(spark, sf).groupBy("district").agg(F.collect_set("indicator").alias("i"), F.max("year").alias("y"))
    score = P.community_relevance(F.array("district"), F.col("i"), F.col("y") >= 2020, F.array(*map(F.lit, ("Guntur", "Krishna", "Dropout Rate"))))
    return g.select("district", F.round(score, 6).alias("score"))


@query("SELECT district, concat_ws('; ', CASE WHEN q < 0.7::DOUBLE THEN 'improve data quality' END, CASE WHEN c < 0.8::DOUBLE THEN 'extend district coverage' END, CASE WHEN n > 40 THEN 'review superseded orders' END, CASE WHEN y < 2020 THEN 'add recent data' END) AS advice FROM (SELECT district, round(sum(confidence_score::DECIMAL(10, 4))::DOUBLE / count(*), 6) AS q, count(DISTINCT year) / 7.0::DOUBLE AS c, count(*) AS n, max(year) AS y FROM {facts} f GROUP BY 1)")
def agg_recommendations(spark: SparkSession, sf: str) -> DataFrame:
    g = facts(spark, sf).groupBy("district").agg(F.round(F.sum(F.col("confidence_score").cast("decimal(10,4)")).cast("double") / F.count(F.lit(1)), 6).alias("q"), (F.countDistinct("year") / F.lit(7.0)).alias("c"), F.count(F.lit(1)).alias("n"), F.max("year").alias("y"))
    advice = P.recommendations(F.col("q"), F.col("c"), F.lit(1.0), F.greatest(F.col("n") - 40, F.lit(0)), F.col("y"), F.lit(0.0), 2021)
    return g.select("district", F.array_join(advice, "; ").alias("advice"))


@query("SELECT source AS doc_id, lang AS district, 'Applications' AS indicator, count(*) AS value, 0.8::DOUBLE AS confidence FROM documents WHERE length(text) >= 10 AND lang IS NOT NULL GROUP BY 1, 2 UNION ALL SELECT * FROM (SELECT source, lang, 'Schools', count(DISTINCT nullif(regexp_extract(text, '([0-9]{8,})', 1), '')) AS n, 0.7::DOUBLE FROM documents WHERE length(text) >= 10 AND lang IS NOT NULL GROUP BY 1, 2) WHERE n > 0")
def agg_app_list(spark: SparkSession, sf: str) -> DataFrame:
    return P.application_lists(table(spark, sf, "documents").select(F.col("source").alias("doc_id"), F.col("lang").alias("district"), "text"))


ANSWERS = "(SELECT c_mktsegment AS category, CASE c_nationkey % 3 WHEN 0 THEN 'easy' WHEN 1 THEN 'medium' ELSE 'hard' END AS difficulty, c_acctbal > 0 AND c_nationkey % 4 <> 1 AND c_custkey % 10 >= 3 AS passed FROM customer)"


def answers(spark: SparkSession, sf: str) -> DataFrame:
    """An answer for each customer, with what it cites and what it should."""
    c, k = table(spark, sf, "customer"), F.col("c_nationkey")
    return c.select(
        "c_custkey", F.col("c_mktsegment").alias("category"), F.when(k % 3 == 0, "easy").when(k % 3 == 1, "medium").otherwise("hard").alias("difficulty"), F.lit(2).alias("citations_min"), F.when(F.col("c_acctbal") > 0, 2).otherwise(1).alias("citations"),
        F.array(F.lit("legal")).alias("expected_sources"), F.when(k % 4 == 1, F.array(F.lit("data"))).otherwise(F.array(F.lit("legal"), F.lit("data"))).alias("sources"), (F.col("c_custkey") % 10 / F.lit(5.0)).alias("confidence"), F.lit(0).alias("warnings"),
    )


@query(f"SELECT 'overall' AS dimension, 'all' AS item, count(*) AS n, count(*) FILTER (WHERE passed) AS passed, round(count(*) FILTER (WHERE passed) / count(*), 6) AS rate FROM {ANSWERS} a UNION ALL SELECT 'category', category, count(*), count(*) FILTER (WHERE passed), round(count(*) FILTER (WHERE passed) / count(*), 6) FROM {ANSWERS} a GROUP BY category UNION ALL SELECT 'difficulty', difficulty, count(*), count(*) FILTER (WHERE passed), round(count(*) FILTER (WHERE passed) / count(*), 6) FROM {ANSWERS} a GROUP BY difficulty")
def agg_test_summary(spark: SparkSession, sf: str) -> DataFrame:
    return P.pass_rates(P.evaluated(answers(spark, sf)))


@query("SELECT c_custkey, c_acctbal > 0 AND c_nationkey % 4 <> 1 AND c_custkey % 10 >= 3 AS passed FROM customer")
def sc_test_eval(spark: SparkSession, sf: str) -> DataFrame:
    return P.evaluated(answers(spark, sf)).select("c_custkey", "passed")


@query("SELECT fact_id, CASE WHEN ord % 3 = 0 THEN 'conflicting' ELSE 'verified' END AS status FROM {facts} f WHERE confidence_score >= 0.8::DOUBLE")
def sc_final_verify(spark: SparkSession, sf: str) -> DataFrame:
    rows = facts(spark, sf).select("fact_id", F.col("confidence_score").alias("confidence"), F.lit("verified").alias("status"), F.when(F.col("ord") % 3 == 0, 0.2).otherwise(0.9).alias("consistency"))
    return P.final_verified(rows, 0.8).select("fact_id", "status")


@query("SELECT fact_id, indicator || ', Section ' || source_page || coalesce(', Clause ' || category, '') || ', (' || year || ')' || ', Page 3' AS citation FROM {facts} f")
def fn_citation_string(spark: SparkSession, sf: str) -> DataFrame:
    c = P.citation_text(F.col("indicator"), F.col("source_page"), F.col("category"), F.col("year").cast("string"), F.lit(3))
    return facts(spark, sf).select("fact_id", c.alias("citation"))


@query("SELECT doc_type, fact_id, CASE doc_type WHEN 'act' THEN 1 WHEN 'rule' THEN 2 WHEN 'government_order' THEN 3 ELSE 4 END AS rank FROM (SELECT fact_id, ord, " + DOC_TYPE + " AS doc_type FROM {facts} f) QUALIFY row_number() OVER (PARTITION BY doc_type ORDER BY ord DESC) = 1")
def sc_legal_chain(spark: SparkSession, sf: str) -> DataFrame:
    from ..operators.aggregates import document_type

    return P.legal_chain(facts(spark, sf).select("fact_id", "ord", document_type(F.col("source_document")).alias("doc_type"))).select("doc_type", "fact_id", "rank")


@query("SELECT child, min(parent) AS parent FROM (SELECT o_orderkey AS child, 'rule ' || (o_custkey % 50) AS ref FROM orders) JOIN (SELECT c_custkey AS parent, 'The Act of Rule ' || (c_custkey % 60) || ' and more' AS title FROM customer) ON contains(lower(title), ref || ' and') GROUP BY child")
def join_legal_parent(spark: SparkSession, sf: str) -> DataFrame:
    children = table(spark, sf, "orders").select(F.col("o_orderkey").alias("child"), F.concat(F.lit("Rule "), (F.col("o_custkey") % 50).cast("string")).alias("reference"))
    parents = table(spark, sf, "customer").select(F.col("c_custkey").alias("parent"), F.concat(F.lit("The Act of Rule "), (F.col("c_custkey") % 60).cast("string"), F.lit(" and more")).alias("title"))
    return P.legal_parents(children, parents)


@query("SELECT fact_id FROM {facts} f WHERE year = 2019 AND value > 30")
def join_common_results(spark: SparkSession, sf: str) -> DataFrame:
    f = facts(spark, sf)
    return P.common_results(f.where("year = 2019").select("fact_id", F.lit(1).alias("query")).union(f.where("value > 30").select("fact_id", F.lit(2))), 2)


@query("SELECT a.vec_id AS claim_id, b.vec_id AS citation_id FROM embeddings a JOIN embeddings b ON a.label = b.label AND a.vec_id % 2 = 0 AND b.vec_id % 2 = 1 WHERE list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) >= 0.1")
def join_claims_citations(spark: SparkSession, sf: str) -> DataFrame:
    # even rows stand for claims and odd ones for citations of an answer, the label
    v = table(spark, sf, "embeddings").withColumnRenamed("label", "answer")
    claims = v.where("vec_id % 2 = 0").select("answer", F.col("vec_id").alias("claim_id"), F.col("embedding").alias("claim"))
    cited = v.where("vec_id % 2 = 1").select("answer", F.col("vec_id").alias("citation_id"), F.col("embedding").alias("citation"))
    return T.claims_cited(claims, cited, 0.1)


@query(f"WITH RECURSIVE e AS MATERIALIZED (SELECT source, target FROM {NET} UNION SELECT target, source FROM {NET}), r(id, node) AS (SELECT source, source FROM e UNION SELECT r.id, e.target FROM r JOIN e ON e.source = r.node) SELECT id, min(node) AS component FROM r GROUP BY id")
def gr_components(spark: SparkSession, sf: str) -> DataFrame:
    return E.components(net(spark, sf))


@query()
def gr_communities(spark: SparkSession, sf: str) -> DataFrame:
    """Communities of the graph of related facts."""
    return modularity_communities(fact_graph(facts(spark, sf)))


@query(f"SELECT DISTINCT a.source AS node, b.target AS parent FROM {NET} a JOIN {NET} b ON a.target = b.source UNION SELECT source, target FROM {NET} c WHERE kind = 'IN'")
def gr_parents(spark: SparkSession, sf: str) -> DataFrame:
    e = net(spark, sf)
    two = e.select(F.col("source").alias("node"), F.col("target").alias("mid")).join(e.select(F.col("source").alias("mid"), F.col("target").alias("parent")), "mid").select("node", "parent")
    return two.union(e.where("kind = 'IN'").select("source", "target")).distinct()


@query("SELECT doc_id, text, source FROM (SELECT conv_id AS doc_id, string_agg(text, chr(10) || chr(10) ORDER BY turn) AS text, count(*) AS source FROM conversations WHERE length(text) > 10 GROUP BY conv_id)")
def fn_combine_text(spark: SparkSession, sf: str) -> DataFrame:
    items = table(spark, sf, "conversations").select(F.col("conv_id").alias("doc_id"), F.col("turn").alias("ord"), "text")
    n = items.where(F.length("text") > 10).groupBy("doc_id").agg(F.count(F.lit(1)).alias("source"))
    return P.combined_text(items).join(n, "doc_id")


@query("""SELECT r_regionkey, md5('{"a":' || r_regionkey || ',"b":"' || r_name || '"}') AS checksum FROM region""")
def fn_checksum(spark: SparkSession, sf: str) -> DataFrame:
    r = table(spark, sf, "region").select(F.col("r_regionkey"), F.col("r_name").alias("b"), F.col("r_regionkey").alias("a"))
    return r.select("r_regionkey", P.checksum(["b", "a"]).alias("checksum"))


@query("SELECT '- ' || string_agg(line, chr(10) || '- ' ORDER BY ord) AS answer FROM (SELECT ord, indicator || ' in ' || district AS line FROM {facts} f ORDER BY ord LIMIT 3)")
def ans_fallback(spark: SparkSession, sf: str) -> DataFrame:
    return T.bullets(facts(spark, sf).select("ord", F.concat_ws(" in ", "indicator", "district").alias("line")), "line", "ord", 3)


@query("SELECT c_custkey, c_name FROM customer ORDER BY c_custkey LIMIT 100")
def scan_structured_entities(spark: SparkSession, sf: str) -> DataFrame:
    from ..sources.files import sample

    return sample(table(spark, sf, "customer").select("c_custkey", "c_name"), "c_custkey", 100)


@query("SELECT substr(text, 1, 1000) AS text FROM documents")
def scan_sample(spark: SparkSession, sf: str) -> DataFrame:
    from ..sources.files import text_sample

    return text_sample(table(spark, sf, "documents"), "text")


@query("SELECT event_type, time_bucket(INTERVAL '1 hour', ts) AS hour, count(*) AS n, sum(value::DECIMAL(18, 2))::DOUBLE AS total FROM events GROUP BY 1, 2")
def stream_late_counts(spark: SparkSession, sf: str) -> DataFrame:
    return incremental.late_counts(table(spark, sf, "events")).select("event_type", F.col("window.start").alias("hour"), "n", "total")


@query(f"SELECT round(count(DISTINCT district) FILTER (WHERE district IN ({', '.join(repr(d) for d in DISTRICTS)})) / 13, 6) AS coverage, count(DISTINCT indicator) AS indicators, (SELECT count(*) FROM ({SUPERSEDED})) AS supersessions FROM {{facts}} f")
def agg_pipeline_report(spark: SparkSession, sf: str) -> DataFrame:
    from ..operators.legal import supersessions

    known = F.countDistinct(F.when(F.col("district").isin(DISTRICTS), F.col("district")))
    one = facts(spark, sf).agg(F.round(known / 13, 6).alias("coverage"), F.countDistinct("indicator").alias("indicators"))
    return one.crossJoin(supersessions(legal_texts(spark, sf)).agg(F.count(F.lit(1)).alias("supersessions")))


@query("SELECT conv_id, turn, least(100, 20 * (len(list_distinct(regexp_extract_all(text, '\\b[0-9]+(?:\\.[0-9]+)?%?'))) > 2)::INT + 10 * (len(list_filter(regexp_split_to_array(text, '\\s+'), lambda w: w <> '')) > 3 * 1.5)::INT + 10 * regexp_matches(lower(text), '\\b(always|never|all|none|every|must|will definitely)\\b')::INT) / 100.0::DOUBLE AS risk FROM conversations WHERE text IS NOT NULL")
def sc_hallucination(spark: SparkSession, sf: str) -> DataFrame:
    c = table(spark, sf, "conversations").where("text is not null")
    return c.select("conv_id", "turn", S.hallucination_risk(F.col("text"), F.lit("some three words")).alias("risk"))
