"""Queries of joins, the validator, bridges and graphs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.vocabulary import DISTRICTS
from ..operators import aggregates as A
from ..operators import bridges as B
from ..operators import graph as G
from ..operators import validation as V
from ..sources.facts import facts, facts_rows, table
from ..sources.tables import kept, stored
from .registry import query
from .relational import AS_OF, DOC_TYPE, KNOWN, SQL_RANGES


@query("SELECT f.fact_id, g.value AS boys FROM {facts} f LEFT JOIN (SELECT district, year, value FROM {facts} x WHERE indicator = 'Boys Enrollment') g USING (district, year) WHERE f.indicator = 'Total Enrollment'")
def join_match_fact(spark: SparkSession, sf: str) -> DataFrame:
    f = facts(spark, sf)
    return f.where("indicator = 'Total Enrollment'").join(V.lookup(f, "Boys Enrollment", "boys"), ["district", "year"], "left").select("fact_id", "boys")


@query("WITH g AS (SELECT * REPLACE (CASE WHEN year = 2018 THEN 2030 ELSE year END AS year) FROM {facts} f) SELECT f.fact_id, f.value, p.value AS previous FROM g f JOIN g p ON p.district = f.district AND p.indicator = f.indicator AND f.year = p.year + 1")
def join_prev_year(spark: SparkSession, sf: str) -> DataFrame:
    return V.previous_year(facts(spark, sf).withColumn("year", F.when(F.col("year") == 2018, 2030).otherwise(F.col("year"))))


@query("SELECT fact_id, value, previous FROM (SELECT f.fact_id, f.value, p.value AS previous FROM {facts} f JOIN {facts} p ON p.district = f.district AND p.indicator = f.indicator AND f.year = p.year + 1) WHERE previous > 0 AND abs(value - previous) / previous > 0.5::DOUBLE")
def win_yoy_growth(spark: SparkSession, sf: str) -> DataFrame:
    return V.previous_year(facts(spark, sf)).where("previous > 0 and abs(value - previous) / previous > 0.5D")


PEERS = "SELECT f.fact_id, f.value, count(p.value) AS peers, sum(p.value::DECIMAL(28, 2))::DOUBLE / count(p.value) AS mean, stddev_pop(p.value) AS deviation, quantile_cont(p.value, 0.25) AS q1, quantile_cont(p.value, 0.75) AS q3 FROM {facts} f JOIN {facts} p ON p.indicator = f.indicator AND p.year = f.year AND p.district <> f.district GROUP BY 1, 2 HAVING count(p.value) >= 3"


@query(f"SELECT fact_id, peers, floor(mean * 1000 + 0.5::DOUBLE) / 1000 AS mean, round(deviation, 4) AS deviation, round(q1, 4) AS q1, round(q3, 4) AS q3 FROM ({PEERS})")
def join_peers(spark: SparkSession, sf: str) -> DataFrame:
    return V.peer_statistics(kept(facts(spark, sf))).select("fact_id", "peers", (F.floor(F.col("mean") * 1000 + 0.5) / 1000).alias("mean"), *[F.round(c, 4).alias(c) for c in ("deviation", "q1", "q3")])


OUT = f"SELECT fact_id, coalesce(deviation > 0 AND abs(value - mean) / deviation > 3, false) OR coalesce(q3 - q1 > 0 AND (value < q1 - 1.5::DOUBLE * (q3 - q1) OR value > q3 + 1.5::DOUBLE * (q3 - q1)), false) AS outlier FROM ({PEERS})"


@query(OUT)
def sc_outlier(spark: SparkSession, sf: str) -> DataFrame:
    c = F.col
    return V.peer_statistics(kept(facts(spark, sf))).select("fact_id", V.outlier(c("value"), c("mean"), c("deviation"), c("q1"), c("q3")).alias("outlier"))


LOGICAL = "SELECT f.fact_id, (coalesce(f.indicator = 'Total Enrollment' AND abs(f.value - (b.value + g.value)) > 0.05::DOUBLE * f.value, false)::INT + coalesce(f.indicator = 'Pupil Teacher Ratio' AND t.value > 0 AND abs(f.value - e.value / t.value) > 0.1::DOUBLE * f.value, false)::INT) AS issues FROM {facts} f " + " ".join(
    f"LEFT JOIN (SELECT district, year, value FROM {{facts}} x WHERE indicator = '{n}') {k} ON {k}.district = f.district AND {k}.year = f.year" for k, n in (("b", "Boys Enrollment"), ("g", "Girls Enrollment"), ("e", "Total Enrollment"), ("t", "Number of Teachers"))
)


@query(LOGICAL)
def sc_logical(spark: SparkSession, sf: str) -> DataFrame:
    m = V.with_matches(facts(spark, sf))
    return m.select("fact_id", V.inconsistencies(m).alias("issues"))


CHECKED = f"""SELECT *, errors = 0 AS is_valid, greatest(0, 100 - lost) / 100.0::DOUBLE AS confidence FROM (
SELECT f.*, low IS NOT NULL AS known_indicator,
  (district NOT IN ({KNOWN}))::INT + (low IS NULL)::INT + coalesce(f.value NOT BETWEEN low AND high, false)::INT + (f.year NOT BETWEEN 2010 AND {AS_OF + 1})::INT AS errors,
  (low IS NOT NULL AND unit <> expected_unit)::INT + (o.outlier AND district IN ({KNOWN}) AND low IS NOT NULL)::INT + l.issues + coalesce(j.jump, false)::INT AS warnings,
  (coalesce(o.outlier, false) AND district IN ({KNOWN}) AND low IS NOT NULL)::INT AS anomalies,
  30 * (district NOT IN ({KNOWN}))::INT + 20 * (low IS NULL)::INT + 20 * coalesce(f.value NOT BETWEEN low AND high, false)::INT + 10 * (f.year NOT BETWEEN 2010 AND {AS_OF + 1})::INT
  + 5 * (low IS NOT NULL AND unit <> expected_unit)::INT + 10 * (coalesce(o.outlier, false) AND district IN ({KNOWN}) AND low IS NOT NULL)::INT + 5 * l.issues + 5 * coalesce(j.jump, false)::INT AS lost
FROM {{facts}} f LEFT JOIN {SQL_RANGES} USING (indicator) LEFT JOIN ({OUT}) o ON o.fact_id = f.fact_id JOIN ({LOGICAL}) l ON l.fact_id = f.fact_id
LEFT JOIN (SELECT f.fact_id, p.value > 0 AND abs(f.value - p.value) / p.value > 0.5::DOUBLE AS jump FROM {{facts}} f JOIN {{facts}} p ON p.district = f.district AND p.indicator = f.indicator AND f.year = p.year + 1) j ON j.fact_id = f.fact_id)"""


def checked(spark: SparkSession, sf: str) -> DataFrame:
    """The validated facts; the facts are made once, as the rules read them several times."""
    return V.validated(kept(facts(spark, sf)), AS_OF)


@query(f"SELECT fact_id, is_valid, confidence, errors AS n_errors, coalesce(warnings, 0) AS n_warnings, anomalies AS n_anomalies FROM ({CHECKED})")
def sc_validation_penalty(spark: SparkSession, sf: str) -> DataFrame:
    return checked(spark, sf).select("fact_id", "is_valid", "confidence", "n_errors", "n_warnings", "n_anomalies")


@query(f"SELECT d.district, count(c.fact_id) AS total_facts, count(*) FILTER (WHERE is_valid) AS valid_facts, coalesce(round(avg(confidence), 6), 0) AS avg_confidence, coalesce(sum(warnings), 0)::BIGINT AS warnings, coalesce(sum(errors), 0)::BIGINT AS errors, coalesce(sum(anomalies), 0)::BIGINT AS anomalies FROM (SELECT unnest([{KNOWN}]) AS district) d LEFT JOIN ({CHECKED}) c USING (district) GROUP BY 1")
def agg_district_summary(spark: SparkSession, sf: str) -> DataFrame:
    return A.district_summary(checked(spark, sf))


@query(f"SELECT indicator, count(*) AS total_facts, min(value) AS lowest, max(value) AS highest, round(sum(value::DECIMAL(28, 2))::DOUBLE / count(value), 4) AS average, round(stddev_pop(value), 4) AS deviation, sum(anomalies)::BIGINT AS anomalies FROM ({CHECKED}) GROUP BY 1")
def agg_indicator_summary(spark: SparkSession, sf: str) -> DataFrame:
    return A.indicator_summary(checked(spark, sf))


@query(f"SELECT year, count(*) AS total_facts, count(*) FILTER (WHERE is_valid) AS valid_facts, round(avg(confidence), 6) AS avg_confidence, count(DISTINCT coalesce(district, '')) AS districts, count(DISTINCT indicator) AS indicators FROM ({CHECKED}) GROUP BY 1")
def agg_year_summary(spark: SparkSession, sf: str) -> DataFrame:
    return A.year_summary(checked(spark, sf))


@query(f"SELECT round(count(*) FILTER (WHERE is_valid) / count(*), 6) AS validity, round(count(*) FILTER (WHERE district <> '') / count(*), 6) AS district_completeness, round(count(*) FILTER (WHERE indicator <> '') / count(*), 6) AS indicator_completeness, round(count(value) / count(*), 6) AS value_completeness, round(count(year) / count(*), 6) AS year_completeness, round(count(*) FILTER (WHERE warnings > 0) / count(*), 6) AS warning_rate, round(count(*) FILTER (WHERE anomalies > 0) / count(*), 6) AS anomaly_rate, round(count(DISTINCT district) FILTER (WHERE district IN ({KNOWN})) / 13, 6) AS district_coverage, round(count(DISTINCT indicator) FILTER (WHERE known_indicator) / 22, 6) AS indicator_coverage, count(DISTINCT year) AS years, round(avg(confidence), 6) AS avg_confidence FROM ({CHECKED})")
def agg_quality_metrics(spark: SparkSession, sf: str) -> DataFrame:
    return A.quality_metrics(checked(spark, sf))


@query(f"SELECT rule_id, coalesce(n, 0) AS n FROM (SELECT unnest(['DIST_001', 'IND_001', 'VAL_001', 'YEAR_001', 'UNIT_001', 'STAT_001', 'CONS_001', 'TEMP_001']) AS rule_id) LEFT JOIN (SELECT 'DIST_001' AS rule_id, count(*) AS n FROM {{facts}} f WHERE district NOT IN ({KNOWN}) UNION ALL SELECT 'VAL_001', count(*) FROM {{facts}} f JOIN {SQL_RANGES} USING (indicator) WHERE f.value NOT BETWEEN low AND high) USING (rule_id)")
def agg_rule_violations(spark: SparkSession, sf: str) -> DataFrame:
    from ..functions.vocabulary import RULES

    rules = spark.createDataFrame([(r,) for r in RULES], "rule_id string")
    seen = checked(spark, sf).select(F.explode("errors").alias("rule_id")).groupBy("rule_id").agg(F.count(F.lit(1)).alias("n"))
    return F.broadcast(rules).join(seen, "rule_id", "left").fillna({"n": 0})


@query(f"SELECT round(avg(confidence), 6) AS score, count(*) FILTER (WHERE is_valid) AS valid, count(*) FILTER (WHERE NOT is_valid) AS invalid, count(*) FILTER (WHERE warnings > 0) AS warned FROM ({CHECKED})")
def agg_overall_score(spark: SparkSession, sf: str) -> DataFrame:
    return checked(spark, sf).agg(F.round(F.avg("confidence"), 6).alias("score"), F.count_if("is_valid").alias("valid"), F.count_if(~F.col("is_valid")).alias("invalid"), F.count_if(F.col("n_warnings") > 0).alias("warned"))


@query("SELECT fact_id, district, indicator, category, year, value, unit, source_document, source_page, confidence_score, ord FROM {rows} f")
def scan_fact_rows(spark: SparkSession, sf: str) -> DataFrame:
    """One fact for each sale."""
    return facts_rows(spark, sf)


STATS_ROWS = "(WITH f AS MATERIALIZED (SELECT * FROM {rows} r) SELECT d.indicator, d.year, d.district, count(p.value) AS peers, sum(p.value::DECIMAL(28, 2))::DOUBLE / count(p.value) AS mean, stddev_pop(p.value) AS deviation, quantile_cont(p.value, 0.25) AS q1, quantile_cont(p.value, 0.75) AS q3 FROM (SELECT DISTINCT indicator, year, district FROM f) d JOIN f p ON p.indicator = d.indicator AND p.year = d.year AND p.district <> d.district GROUP BY 1, 2, 3 HAVING count(p.value) >= 3)"


@query(f"SELECT indicator, year, district, peers, floor(mean * 1000 + 0.5::DOUBLE) / 1000 AS mean, round(deviation, 3) AS deviation, round(q1, 3) AS q1, round(q3, 3) AS q3 FROM {STATS_ROWS}")
def win_peer_stats_rows(spark: SparkSession, sf: str) -> DataFrame:
    """Statistics over other districts' sales, for each district, indicator and year."""
    return V.district_statistics(stored(facts_rows(spark, sf).select("indicator", "year", "district", "value"), "facts")).select("indicator", "year", "district", "peers", (F.floor(F.col("mean") * 1000 + 0.5) / 1000).alias("mean"), *[F.round(c, 3).alias(c) for c in ("deviation", "q1", "q3")])


BAD_ROW = f"(district NOT IN ({KNOWN}) OR low IS NULL OR value NOT BETWEEN low AND high OR year NOT BETWEEN 2010 AND {AS_OF + 1})"


@query(f"SELECT x.district, count(*) AS facts, count(*) FILTER (WHERE NOT {BAD_ROW}) AS valid, coalesce(sum((x.district IN ({KNOWN}) AND low IS NOT NULL AND (coalesce(deviation > 0 AND abs(value - mean) / deviation > 3, false) OR coalesce(q3 - q1 > 0 AND (value < q1 - 1.5::DOUBLE * (q3 - q1) OR value > q3 + 1.5::DOUBLE * (q3 - q1)), false)))::INT), 0)::BIGINT AS anomalies FROM {{rows}} x LEFT JOIN {SQL_RANGES} USING (indicator) LEFT JOIN {STATS_ROWS} s ON s.indicator = x.indicator AND s.year = x.year AND s.district = x.district GROUP BY 1".replace("value NOT BETWEEN", "x.value NOT BETWEEN").replace("(district NOT IN", "(x.district NOT IN").replace("OR year NOT", "OR x.year NOT"))
def agg_validation_rows(spark: SparkSession, sf: str) -> DataFrame:
    """All rules of the validator on one fact for each sale, counted by district."""
    f = facts_rows(spark, sf).select("district", "indicator", "year", "value", "unit", "ord")
    done = V.validated(stored(f, "facts"), AS_OF)
    return done.groupBy("district").agg(F.count(F.lit(1)).alias("facts"), F.count_if("is_valid").alias("valid"), F.sum("n_anomalies").cast("long").alias("anomalies"))


@query("SELECT district, year, (count(*) * (count(*) - 1) / 2)::BIGINT AS edges FROM {rows} f GROUP BY 1, 2")
def bridge_edge_counts_rows(spark: SparkSession, sf: str) -> DataFrame:
    return B.edge_counts(facts_rows(spark, sf), ["district", "year"])


@query("SELECT a.fact_id AS source, b.fact_id AS target, CASE WHEN a.indicator = b.indicator THEN 0.9::DOUBLE ELSE 0.8::DOUBLE END AS strength FROM {facts} a JOIN {facts} b ON a.district = b.district AND a.year = b.year AND a.ord < b.ord")
def join_pairs_in_group(spark: SparkSession, sf: str) -> DataFrame:
    return B.edges(facts(spark, sf), "district_year", ["district", "year"], 0.8)


@query("SELECT * FROM (SELECT a.fact_id AS source, b.fact_id AS target, greatest(40, 90 - 15 * abs(a.year - b.year)) / 100.0::DOUBLE AS strength FROM {facts} a JOIN {facts} b ON a.district = b.district AND a.indicator = b.indicator AND a.ord < b.ord) WHERE strength >= 0.7::DOUBLE")
def sc_connection_strength(spark: SparkSession, sf: str) -> DataFrame:
    return B.edges(facts(spark, sf), "indicator_temporal", ["indicator", "district"], 0.7)


@query("SELECT a.fact_id AS source, b.fact_id AS target, 0.7::DOUBLE AS strength FROM {facts} a JOIN {facts} b ON a.year = b.year AND a.indicator = b.indicator AND a.ord < b.ord WHERE a.district <> b.district")
def edge_cross(spark: SparkSession, sf: str) -> DataFrame:
    return B.edges(facts(spark, sf), "cross_district", ["indicator", "year"], 0.5)


@query("SELECT a.fact_id AS source, b.fact_id AS target, CASE WHEN a.source_document = b.source_document THEN 0.8::DOUBLE ELSE 0.6::DOUBLE END AS strength FROM (SELECT *, " + DOC_TYPE + " AS t FROM {facts} f) a JOIN (SELECT *, " + DOC_TYPE + " AS t FROM {facts} f) b ON a.t = b.t AND a.indicator = b.indicator AND a.ord < b.ord")
def edge_policy(spark: SparkSession, sf: str) -> DataFrame:
    f = facts(spark, sf).withColumn("doc_type", A.document_type(F.col("source_document")))
    return B.edges(f, "policy_hierarchy", ["doc_type", "indicator"], 0.6)


@query("WITH p AS (SELECT a.fact_id AS source, b.fact_id AS target, a.district = b.district AS d, a.indicator = b.indicator AS i, a.year = b.year AS y, a.source_document = b.source_document AS s, abs(a.year - b.year) AS g FROM {facts} a JOIN {facts} b ON a.ord < b.ord), t AS (SELECT *, least(10, 4 * d::INT + 3 * i::INT + CASE WHEN g <= 1 THEN 3 WHEN g <= 3 THEN 2 ELSE 0 END + 2 * s::INT) AS t FROM p) SELECT source, target, t / 10.0::DOUBLE AS strength, CASE WHEN d THEN 'district' WHEN i THEN 'indicator' WHEN y THEN 'year' WHEN s THEN 'document' ELSE 'related' END AS kind FROM t WHERE t > 3")
def join_fact_graph(spark: SparkSession, sf: str) -> DataFrame:
    return B.fact_graph(facts(spark, sf))


@query("SELECT district, year, (count(*) * (count(*) - 1) / 2)::BIGINT AS edges FROM {facts} f GROUP BY 1, 2")
def bridge_edge_counts(spark: SparkSession, sf: str) -> DataFrame:
    return B.edge_counts(facts(spark, sf), ["district", "year"])


BRIDGES = "SELECT 'DY' AS bridge_type, 'DY_' || district || '_' || year AS bridge_id, list(fact_id) AS fact_ids FROM {facts} f GROUP BY district, year UNION ALL SELECT 'IT', 'IT_' || indicator || '_' || district, list(fact_id) FROM {facts} f GROUP BY indicator, district"


def bridge_rows(spark: SparkSession, sf: str) -> DataFrame:
    f = facts(spark, sf)
    dy = f.groupBy("district", "year").agg(F.collect_list("fact_id").alias("fact_ids")).select(F.lit("DY").alias("bridge_type"), F.concat_ws("_", F.lit("DY"), "district", "year").alias("bridge_id"), "fact_ids")
    it = f.groupBy("indicator", "district").agg(F.collect_list("fact_id").alias("fact_ids")).select(F.lit("IT").alias("bridge_type"), F.concat_ws("_", F.lit("IT"), "indicator", "district").alias("bridge_id"), "fact_ids")
    return dy.union(it)


@query(f"SELECT fact_id, string_agg(bridge_id, ',' ORDER BY bridge_id) AS bridges FROM (SELECT bridge_id, unnest(fact_ids) AS fact_id FROM ({BRIDGES})) GROUP BY 1")
def sink_back_reference(spark: SparkSession, sf: str) -> DataFrame:
    return B.back_references(bridge_rows(spark, sf))


@query(f"SELECT bridge_type, count(*) AS n, string_agg(bridge_id, ',' ORDER BY bridge_id) AS keys FROM ({BRIDGES}) GROUP BY 1")
def agg_bridge_index(spark: SparkSession, sf: str) -> DataFrame:
    return B.bridge_index(bridge_rows(spark, sf))


NET = "(SELECT 'n' || n_nationkey AS source, 'r' || n_regionkey AS target, 'IN' AS kind FROM nation UNION ALL SELECT 's' || s_suppkey, 'n' || s_nationkey, 'AT' FROM supplier)"


def net(spark: SparkSession, sf: str) -> DataFrame:
    n, s = table(spark, sf, "nation"), table(spark, sf, "supplier")
    at = lambda p, c: F.concat(F.lit(p), F.col(c).cast("string"))
    return n.select(at("n", "n_nationkey").alias("source"), at("r", "n_regionkey").alias("target"), F.lit("IN").alias("kind")).union(s.select(at("s", "s_suppkey"), at("n", "s_nationkey"), F.lit("AT")))


BOTH = f"(SELECT source, target FROM {NET} UNION SELECT target, source FROM {NET})"


def starts(spark: SparkSession, *ids: str) -> DataFrame:
    return spark.createDataFrame([(i,) for i in ids], "id string")


@query(f"SELECT id, neighbour FROM (SELECT source AS id, target AS neighbour, row_number() OVER (PARTITION BY source ORDER BY target) AS i FROM {BOTH} WHERE source IN ('r1', 'n3')) WHERE i <= 10")
def gr_related(spark: SparkSession, sf: str) -> DataFrame:
    return G.neighbours(net(spark, sf), starts(spark, "r1", "n3"), 10)


HOPS = f"WITH RECURSIVE e AS MATERIALIZED (SELECT * FROM {BOTH}), r(id, node, distance) AS (SELECT source, source, 0 FROM e WHERE source IN ('r1', 'n3') UNION SELECT r.id, e.target, r.distance + 1 FROM r JOIN e ON e.source = r.node WHERE r.distance < DEPTH) SELECT id, node, min(distance) AS distance FROM r GROUP BY 1, 2"


@query(HOPS.replace("DEPTH", "2"))
def gr_distances(spark: SparkSession, sf: str) -> DataFrame:
    return G.distances(net(spark, sf), starts(spark, "r1", "n3"), 2)


NAMED = f"(SELECT source, target, source || '>' || target AS edge FROM {NET} UNION SELECT target, source, source || '>' || target FROM {NET})"


@query(f"WITH RECURSIVE e AS MATERIALIZED (SELECT * FROM {NAMED}), r AS (SELECT s AS id, s AS node, [s] AS path, []::VARCHAR[] AS used FROM (VALUES ('r1'), ('n3')) v(s) UNION ALL SELECT r.id, e.target, list_append(path, e.target), list_append(used, edge) FROM r JOIN e ON e.source = r.node WHERE len(used) < 2 AND NOT list_contains(used, edge)) SELECT id, len(used)::INT AS length, array_to_string(path, '>') AS path FROM r WHERE len(used) > 0")
def gr_context(spark: SparkSession, sf: str) -> DataFrame:
    return G.trails(net(spark, sf), starts(spark, "r1", "n3"), 2).select("id", "length", F.array_join("path", ">").alias("path"))


@query(f"WITH RECURSIVE e AS MATERIALIZED (SELECT * FROM {BOTH}), r AS (SELECT s AS id, s AS node, [s] AS path FROM (VALUES ('r1'), ('n3')) v(s) UNION ALL SELECT r.id, e.target, list_append(path, e.target) FROM r JOIN e ON e.source = r.node WHERE len(path) <= 5 AND NOT list_contains(path, e.target)), b AS (SELECT *, row_number() OVER (PARTITION BY id, node ORDER BY len(path), list_reverse(path)) AS i FROM r) SELECT id AS source, node AS target, (len(path) - 1)::INT AS distance, array_to_string(path, '>') AS path FROM b WHERE i = 1 AND node IN ('s7', 'n8', 'r2')")
def gr_shortest(spark: SparkSession, sf: str) -> DataFrame:
    pairs = spark.createDataFrame([(a, b) for a in ("r1", "n3") for b in ("s7", "n8", "r2")], "source string, target string")
    return G.shortest(net(spark, sf), pairs, 5).withColumn("path", F.array_join("path", ">"))


@query(f"SELECT 'edge' AS what, kind, count(*) AS n FROM {NET} GROUP BY kind UNION ALL SELECT 'node', kind, count(*) FROM (SELECT 'nation' AS kind FROM nation UNION ALL SELECT 'region' FROM region) GROUP BY kind")
def gr_stats(spark: SparkSession, sf: str) -> DataFrame:
    nodes = table(spark, sf, "nation").select(F.lit("nation").alias("kind")).union(table(spark, sf, "region").select(F.lit("region")))
    return G.stats(nodes, net(spark, sf))


@query("SELECT n_nationkey, CASE WHEN n_name IN ('NATION_1', 'NATION_5') THEN 'urban' ELSE 'rural' END AS label FROM nation")
def gr_labels(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "nation").select("n_nationkey", G.label(F.col("n_name"), ["NATION_1", "NATION_5"]).alias("label"))


@query("SELECT c_custkey AS id, coalesce(o.v, c_acctbal) AS value FROM customer LEFT JOIN (SELECT o_custkey, arg_max(o_totalprice, o_orderkey) AS v FROM orders GROUP BY 1) o ON o_custkey = c_custkey")
def gr_upsert(spark: SparkSession, sf: str) -> DataFrame:
    nodes = table(spark, sf, "customer").select(F.col("c_custkey").alias("id"), F.col("c_acctbal").alias("value"), F.lit(0).cast("long").alias("version"))
    new = table(spark, sf, "orders").select(F.col("o_custkey").alias("id"), F.col("o_totalprice").alias("value"), F.col("o_orderkey").alias("version"))
    known = new.join(nodes.select("id"), "id", "left_semi")
    return G.upserted(nodes, known, "id").select("id", "value")


@query("SELECT a.p_partkey AS source, b.p_partkey AS target FROM part a JOIN part b ON a.p_brand = b.p_brand AND a.p_type = b.p_type AND a.p_size = b.p_size AND a.p_partkey <> b.p_partkey")
def join_related_indicators(spark: SparkSession, sf: str) -> DataFrame:
    kind = F.concat_ws("|", "p_brand", "p_type", F.col("p_size").cast("string"))
    return G.related_within(table(spark, sf, "part").select("p_partkey", kind.alias("kind")), "p_partkey", "kind")


@query("SELECT f.fact_id, coalesce(d.district, 'Unknown') AS place FROM {facts} f LEFT JOIN (SELECT unnest([" + KNOWN + "]) AS district) d USING (district)")
def join_demo_district(spark: SparkSession, sf: str) -> DataFrame:
    d = spark.createDataFrame([(x, x) for x in DISTRICTS], "district string, place string")
    return facts(spark, sf).join(F.broadcast(d), "district", "left").select("fact_id", F.coalesce("place", F.lit("Unknown")).alias("place"))


@query("SELECT o_orderkey, c_name FROM orders LEFT JOIN (SELECT * FROM customer WHERE c_mktsegment = 'BUILDING') c ON o_custkey = c_custkey")
def join_graph_optional(spark: SparkSession, sf: str) -> DataFrame:
    c = table(spark, sf, "customer").where("c_mktsegment = 'BUILDING'").select("c_custkey", "c_name")
    return table(spark, sf, "orders").join(c, F.col("o_custkey") == F.col("c_custkey"), "left").select("o_orderkey", "c_name")


POLICIES = [("Teacher Act", "Number of Teachers"), ("Dropout Policy", "Dropout Rate"), ("Enrollment Mission", "Girls Enrollment")]
LINKS = [("Number of Teachers", "Pupil Teacher Ratio"), ("Dropout Rate", "Total Enrollment"), ("Girls Enrollment", "Total Enrollment")]
SQL_POLICIES = "(VALUES " + ", ".join(f"('{a}', '{b}')" for a, b in POLICIES) + ") p(policy, indicator)"
SQL_LINKS = "(VALUES " + ", ".join(f"('{x}', '{y}')" for a, b in LINKS for x, y in ((a, b), (b, a))) + ") l(source, target)"


def policies(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(POLICIES, "policy string, indicator string")


@query(f"SELECT policy, fact_id FROM {SQL_POLICIES} JOIN {{facts}} f USING (indicator)")
def join_graph_policy_hop(spark: SparkSession, sf: str) -> DataFrame:
    return F.broadcast(policies(spark)).join(facts(spark, sf), "indicator").select("policy", "fact_id")


@query(f"SELECT source, fact_id FROM {SQL_LINKS} JOIN {{facts}} f ON f.indicator = target")
def join_graph_indicator_hop(spark: SparkSession, sf: str) -> DataFrame:
    both = G.undirected(spark.createDataFrame(LINKS, "source string, target string"))
    return F.broadcast(both).join(facts(spark, sf), F.col("target") == F.col("indicator")).select("source", "fact_id")


UNION = f"SELECT fact_id, 3 AS relevance, 0.9::DOUBLE AS score FROM {{facts}} f WHERE contains(lower(indicator), 'dropout') UNION ALL SELECT fact_id, 2, 0.6::DOUBLE FROM {SQL_POLICIES} JOIN {{facts}} f USING (indicator) WHERE contains(lower(policy), 'dropout') UNION ALL SELECT fact_id, 1, 0.3::DOUBLE FROM {{facts}} f WHERE indicator IN (SELECT target FROM {SQL_LINKS} WHERE contains(lower(source), 'dropout'))"


@query(UNION)
def set_union_all_graph(spark: SparkSession, sf: str) -> DataFrame:
    return G.union_search(facts(spark, sf), policies(spark), spark.createDataFrame(LINKS, "source string, target string"), "Dropout")


@query(f"SELECT fact_id, relevance, year FROM ({UNION}) JOIN (SELECT fact_id, year FROM {{facts}} f) USING (fact_id) ORDER BY relevance DESC, year DESC, fact_id LIMIT 30")
def topk_graph_search(spark: SparkSession, sf: str) -> DataFrame:
    f = facts(spark, sf)
    found = G.union_search(f, policies(spark), spark.createDataFrame(LINKS, "source string, target string"), "Dropout")
    return found.join(f.select("fact_id", "year"), "fact_id").orderBy(F.desc("relevance"), F.desc("year"), "fact_id").limit(30).select("fact_id", "relevance", "year")


@query("SELECT doc_id AS key, md5(text) AS hash FROM documents d WHERE NOT (doc_id % 3 <> 0 AND doc_id % 5 <> 0)")
def scan_detect_new(spark: SparkSession, sf: str) -> DataFrame:
    from ..sources.files import changed

    docs = table(spark, sf, "documents").select(F.col("doc_id").alias("key"), F.md5(F.col("text").cast("binary")).alias("hash"))
    tracker = docs.where("key % 3 <> 0").withColumn("hash", F.when(F.col("key") % 5 == 0, "old").otherwise(F.col("hash")))
    return changed(docs, tracker)


@query("SELECT kind, count(*) AS n FROM (SELECT DISTINCT 'district' AS kind, district AS name FROM {facts} f UNION ALL SELECT DISTINCT 'indicator', indicator FROM {facts} f UNION ALL SELECT DISTINCT 'year', year::VARCHAR FROM {facts} f UNION ALL SELECT DISTINCT 'source', source_document FROM {facts} f) GROUP BY kind")
def sink_graph_facts(spark: SparkSession, sf: str) -> DataFrame:
    from ..sources.sinks import star_nodes

    return star_nodes(facts(spark, sf)).groupBy("kind").agg(F.count(F.lit(1)).alias("n"))
