"""Queries of filters, aggregates, windows, sorts and set operations over the fact view."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.vocabulary import DISTRICTS
from ..operators import aggregates as A
from ..operators import filters as P
from ..operators import windows as W
from ..sources.facts import facts, table
from .registry import query

AS_OF = 2021
KNOWN = ", ".join(f"'{d}'" for d in DISTRICTS)
RANGE_ROWS = ", ".join(f"('{n}', {a}::DOUBLE, {b}::DOUBLE, '{u}')" for n, a, b, u in P.RANGES)
SQL_RANGES = f"(VALUES {RANGE_ROWS}) r(indicator, low, high, expected_unit)"


def words_sql(column: str, words: list[str]) -> str:
    return "(" + " OR ".join(f"contains(lower({column}), '{w}')" for w in words) + ")"


@query(f"SELECT doc_id FROM documents WHERE {words_sql('text', P.POLICY_WORDS)} AND length(trim(text)) > 50")
def flt_policy_text(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").where(P.is_policy_text(F.col("text"))).select("doc_id")


@query("""SELECT p_partkey FROM part WHERE len(list_filter([p_size::VARCHAR, replace(p_retailprice::DECIMAL(12,2)::VARCHAR, '.', ''), p_name, p_brand, p_type, p_name], lambda x: regexp_matches(x, '^[0-9]+$'))) >= 0.3 * 6 AND p_size % 4 >= 1""")
def flt_table_structure(spark: SparkSession, sf: str) -> DataFrame:
    cells = [F.col("p_size").cast("string"), F.col("p_retailprice").cast("decimal(12,2)").cast("string"), "p_name", "p_brand", "p_type", "p_name"]
    rows = F.array(F.array(F.lit("a"), F.lit("b"), F.lit("c")), F.array(*cells[:3]), F.array(*cells[3:]))
    return table(spark, sf, "part").where(P.is_table(rows, F.col("p_size") % 4 + 1, F.lit(3))).select("p_partkey")


@query("SELECT fact_id FROM {facts} f WHERE category IS NOT NULL AND unit IS NOT NULL AND year IS NOT NULL")
def flt_required_fields(spark: SparkSession, sf: str) -> DataFrame:
    return P.with_fields(facts(spark, sf), ["category", "unit", "year"]).select("fact_id")


@query(f"SELECT fact_id, f.value FROM {{facts}} f LEFT JOIN {SQL_RANGES} USING (indicator) WHERE (low IS NULL OR f.value BETWEEN low AND high) AND district <> 'Unknown'")
def flt_validate_norm(spark: SparkSession, sf: str) -> DataFrame:
    return P.valid_normalised(facts(spark, sf)).select("fact_id", "value")


@query(f"SELECT fact_id FROM {{facts}} f WHERE year BETWEEN 2000 AND {AS_OF + 1} AND value >= 0 AND district IN ({KNOWN}, 'Unknown')")
def flt_validate_fact(spark: SparkSession, sf: str) -> DataFrame:
    return P.valid_facts(facts(spark, sf), AS_OF).select("fact_id")


@query("SELECT fact_id FROM (SELECT fact_id, CASE WHEN ord % 5 = 0 THEN 0 ELSE value END AS value, year FROM {facts} f) WHERE value <> 0 AND year <> 0")
def flt_prep_fact(spark: SparkSession, sf: str) -> DataFrame:
    zeroed = facts(spark, sf).withColumn("value", F.when(F.col("ord") % 5 == 0, 0.0).otherwise(F.col("value")))
    return P.truthy_facts(zeroed).select("fact_id")


@query("SELECT fact_id, district, indicator, year, value, unit, coalesce(category, 'N/A') AS category, source_document AS source, source_page AS page, confidence_score AS confidence FROM {facts} f")
def proj_prep_fact(spark: SparkSession, sf: str) -> DataFrame:
    return P.prepared_facts(facts(spark, sf))


@query(f"SELECT fact_id, c AS confidence FROM (SELECT fact_id, CASE WHEN f.value BETWEEN low AND high THEN confidence_score ELSE confidence_score * 0.5::DOUBLE END AS c FROM {{facts}} f JOIN {SQL_RANGES} USING (indicator)) WHERE c >= 0.7::DOUBLE")
def flt_data_point(spark: SparkSession, sf: str) -> DataFrame:
    return P.accepted_points(facts(spark, sf))


@query("SELECT fact_id, value FROM {facts} f WHERE indicator = 'Dropout Rate' AND district = 'Guntur' AND year = 2018")
def flt_by_indicator(spark: SparkSession, sf: str) -> DataFrame:
    return P.by_indicator(facts(spark, sf), "Dropout Rate", "Guntur", 2018).select("fact_id", "value")


@query("SELECT fact_id FROM {facts} f WHERE indicator = 'Number of Teachers' AND district = 'Krishna'")
def flt_store_equality(spark: SparkSession, sf: str) -> DataFrame:
    return P.by_indicator(facts(spark, sf), "Number of Teachers", "Krishna", 0).select("fact_id")


@query("SELECT fact_id FROM {facts} f WHERE year BETWEEN 2016 AND 2018 AND district IN ('Guntur', 'Krishna') AND indicator IN ('Dropout Rate')")
def flt_store_range(spark: SparkSession, sf: str) -> DataFrame:
    return P.in_years(facts(spark, sf), 2016, 2018, ["Guntur", "Krishna"], ["Dropout Rate"]).select("fact_id")


@query("SELECT fact_id FROM {facts} f WHERE starts_with(source_document, 'cse_') OR starts_with(source_document, 'scert_') OR district = 'Guntur' OR year = 2019")
def flt_data_source_or_observed(spark: SparkSession, sf: str) -> DataFrame:
    return P.from_sources(facts(spark, sf), ["cse_", "scert_"], "Guntur", 2019, widen=True).select("fact_id")


@query("SELECT fact_id FROM {facts} f WHERE (starts_with(source_document, 'cse_') OR starts_with(source_document, 'scert_')) AND district = 'Chittoor' AND year = 2019")
def flt_data_source_or_intent(spark: SparkSession, sf: str) -> DataFrame:
    return P.from_sources(facts(spark, sf), ["cse_", "scert_"], "Chittoor", 2019, widen=False).select("fact_id")


@query("SELECT o_orderkey FROM orders WHERE o_orderpriority LIKE '%HIGH%' AND contains(strftime(o_orderdate, '%Y-%m-%d'), '1998')")
def flt_legal_year_like(spark: SparkSession, sf: str) -> DataFrame:
    o = table(spark, sf, "orders")
    return o.where(F.col("o_orderpriority").contains("HIGH") & F.date_format("o_orderdate", "yyyy-MM-dd").contains("1998")).select("o_orderkey")


@query("SELECT fact_id, confidence_score FROM {facts} f WHERE contains(lower(indicator), 'enrollment') AND confidence_score >= 0.8::DOUBLE")
def flt_precision(spark: SparkSession, sf: str) -> DataFrame:
    f = facts(spark, sf)
    return f.where(F.lower("indicator").contains("enrollment") & (F.col("confidence_score") >= 0.8)).select("fact_id", "confidence_score")


@query("SELECT fact_id, year, value FROM {facts} f WHERE indicator = 'Total Enrollment' AND district = 'Nellore' AND year IS NOT NULL ORDER BY year")
def proj_time_series(spark: SparkSession, sf: str) -> DataFrame:
    return P.by_indicator(facts(spark, sf), "Total Enrollment", "Nellore").where("year is not null").orderBy("year").select("fact_id", "year", "value")


@query("SELECT district, value FROM {facts} f WHERE indicator = 'Total Enrollment' AND year = 2017 AND district IS NOT NULL ORDER BY district")
def proj_district_comparison(spark: SparkSession, sf: str) -> DataFrame:
    return P.by_indicator(facts(spark, sf), "Total Enrollment", None, 2017).where("district is not null").orderBy("district").select("district", "value")


HEADERS = "[n_name, 'Mandal ' || n_nationkey, 'Total', 'Boys count', CASE WHEN n_nationkey % 2 = 0 THEN 'District' ELSE 'Area' END]"


@query(f"SELECT n_nationkey, coalesce(list_position(list_transform(h, lambda x: {words_sql('x', [d.lower() for d in DISTRICTS] + ['district', 'mandal'])}), true), 0)::BIGINT AS district_at, array_to_string(list_filter(range(1, 6), lambda i: {words_sql('h[i]', P.VALUE_WORDS)}), ',') AS values_at FROM (SELECT n_nationkey, {HEADERS} AS h FROM nation)")
def find_columns(spark: SparkSession, sf: str) -> DataFrame:
    n = table(spark, sf, "nation")
    headers = F.array("n_name", F.concat(F.lit("Mandal "), F.col("n_nationkey").cast("string")), F.lit("Total"), F.lit("Boys count"), F.when(F.col("n_nationkey") % 2 == 0, "District").otherwise("Area"))
    return n.select("n_nationkey", P.district_column(headers).alias("district_at"), F.array_join(P.value_columns(headers).cast("array<string>"), ",").alias("values_at"))


@query(f"""SELECT source, {' + '.join(f"contains(lower(s), '{w}')::INT" for w in P.LIST_MARKERS)} >= 2 AS is_list FROM (SELECT source, string_agg(substr(text, 1, 200) || CASE WHEN doc_id % 2 = 0 THEN ' Sl.No parent' ELSE '' END, ' ' ORDER BY doc_id) AS s FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS i FROM documents WHERE text IS NOT NULL) WHERE i <= 3 GROUP BY source)""")
def is_application_list(spark: SparkSession, sf: str) -> DataFrame:
    sample = F.concat(F.substring("text", 1, 200), F.when(F.col("doc_id") % 2 == 0, " Sl.No parent").otherwise(""))
    first = W.top_per_group(table(spark, sf, "documents").where("text is not null").select("source", "doc_id", sample.alias("s")), ["source"], ["doc_id"], 3)
    joined = first.groupBy("source").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "s"))), lambda x: x["s"]), " ").alias("s"))
    return joined.select("source", P.is_application_list(F.col("s")).alias("is_list"))


CROSS = "SELECT indicator, year, count(*) AS n_districts, round(avg(mean), 4) AS state_average, arg_max(district, (mean, -seen)) AS highest_district, arg_min(district, (mean, -seen)) AS lowest_district, round(max(mean) - min(mean), 4) AS performance_gap FROM (SELECT indicator, year, district, sum(value::DECIMAL(28, 2))::DOUBLE / count(value) AS mean, min(ord) AS seen FROM {facts} f GROUP BY 1, 2, 3) GROUP BY 1, 2 HAVING count(*) >= 3"


@query(CROSS)
def agg_cross_district(spark: SparkSession, sf: str) -> DataFrame:
    return A.cross_district(facts(spark, sf))


@query("SELECT district, year, count(*) AS fact_count, sum(value::DECIMAL(28, 2))::DOUBLE AS total, round(sum(value::DECIMAL(28, 2))::DOUBLE / count(value), 6) AS average, max(value) AS highest, min(value) AS lowest, round(max(value) - min(value), 6) AS span, count(DISTINCT indicator) AS indicators, round(sum(coalesce(confidence_score, 0.5)::DECIMAL(10, 4))::DOUBLE / count(*), 6) AS confidence FROM {facts} f GROUP BY 1, 2 HAVING count(*) >= 2")
def agg_district_year(spark: SparkSession, sf: str) -> DataFrame:
    return A.district_year(facts(spark, sf))


@query("SELECT *, CASE WHEN slope > 0 THEN 'increasing' WHEN slope < 0 THEN 'decreasing' ELSE 'stable' END AS trend, last_year - first_year + 1 AS year_span FROM (SELECT *, CASE WHEN last_year > first_year THEN round((latest - earliest) / (last_year - first_year), 6) ELSE 0 END AS slope FROM (SELECT indicator, district, count(*) AS data_points, min(year) AS first_year, max(year) AS last_year, arg_min(value, (year, ord)) AS earliest, arg_max(value, (year, ord)) AS latest, round(sum(value::DECIMAL(28, 2))::DOUBLE / count(value), 6) AS average FROM {facts} f GROUP BY 1, 2 HAVING count(*) >= 2))")
def agg_indicator_temporal(spark: SparkSession, sf: str) -> DataFrame:
    return A.indicator_temporal(facts(spark, sf))


DOC_TYPE = "CASE WHEN coalesce(source_document, '') = '' THEN 'unknown' WHEN contains(lower(source_document), 'go_') OR contains(lower(source_document), 'government_order') THEN 'government_order' WHEN contains(lower(source_document), 'cse_') THEN 'cse_document' WHEN contains(lower(source_document), 'scert_') THEN 'scert_document' WHEN contains(lower(source_document), 'act') THEN 'act' WHEN contains(lower(source_document), 'rule') THEN 'rule' ELSE 'general_document' END"


@query(f"SELECT doc_type, indicator, count(*) AS fact_count, count(DISTINCT source_document) AS documents, count(DISTINCT district) AS districts, count(DISTINCT year) AS years, CASE WHEN count(DISTINCT district) > 1 THEN 'multi_district' ELSE 'single_district' END AS scope FROM (SELECT *, {DOC_TYPE} AS doc_type, count(*) OVER (PARTITION BY {DOC_TYPE}) AS of_type FROM {{facts}} f) WHERE of_type >= 3 GROUP BY 1, 2 HAVING count(*) >= 2")
def agg_policy_hierarchy(spark: SparkSession, sf: str) -> DataFrame:
    return A.policy_hierarchy(facts(spark, sf))


@query(f"SELECT fact_id, {DOC_TYPE} AS doc_type FROM {{facts}} f")
def fn_doc_type(spark: SparkSession, sf: str) -> DataFrame:
    return facts(spark, sf).select("fact_id", A.document_type(F.col("source_document")).alias("doc_type"))


@query("SELECT 'district' AS dimension, district AS item, count(*) AS n FROM {facts} f GROUP BY district UNION ALL SELECT 'indicator', indicator, count(*) FROM {facts} f GROUP BY indicator UNION ALL SELECT 'year', year::VARCHAR, count(*) FROM {facts} f GROUP BY year UNION ALL SELECT 'category', category, count(*) FROM {facts} f GROUP BY category")
def agg_summary_report(spark: SparkSession, sf: str) -> DataFrame:
    return A.value_counts(facts(spark, sf), ["district", "indicator", "year", "category"])


@query("SELECT count(*) AS total, count(DISTINCT district) AS districts, count(DISTINCT indicator) AS indicators, count(DISTINCT year) AS years FROM {facts} f")
def agg_retriever_stats(spark: SparkSession, sf: str) -> DataFrame:
    return A.distinct_dimensions(facts(spark, sf))


@query("SELECT district, year, 'SUMMARY_' || district || '_' || year AS fact_id, sum(value::DECIMAL(28, 2))::DOUBLE AS value, 0.95::DOUBLE AS confidence_score, 'AGGREGATED' AS source_document, 0 AS source_page FROM {facts} f WHERE indicator = 'Total Enrollment' GROUP BY 1, 2")
def agg_total_applications(spark: SparkSession, sf: str) -> DataFrame:
    sums = facts(spark, sf).where("indicator = 'Total Enrollment'").groupBy("district", "year").agg(A.exact_sum("value").alias("value"))
    return sums.select("district", "year", F.concat_ws("_", F.lit("SUMMARY"), "district", "year").alias("fact_id"), "value", F.lit(0.95).alias("confidence_score"), F.lit("AGGREGATED").alias("source_document"), F.lit(0).alias("source_page"))


@query("WITH y AS (SELECT year, count(*) AS n, sum(value::DECIMAL(28, 2))::DOUBLE AS total, sum(value::DECIMAL(28, 2))::DOUBLE / count(value) AS mean, min(value) AS lowest, max(value) AS highest FROM {facts} f WHERE indicator = 'Total Enrollment' AND year BETWEEN 2015 AND 2020 AND value <> 0 GROUP BY year), e AS (SELECT (arg_max(mean, year) - arg_min(mean, year)) / arg_min(mean, year) * 100 AS change FROM y) SELECT year, n, total, round(mean, 6) AS mean, lowest, highest, CASE WHEN change > 5 THEN 'increasing' WHEN change < -5 THEN 'decreasing' ELSE 'stable' END AS direction FROM y, e")
def agg_trend_yearly(spark: SparkSession, sf: str) -> DataFrame:
    return A.trend_yearly(P.by_indicator(facts(spark, sf), "Total Enrollment"), 2015, 2020)


@query("SELECT source_document, count(*) AS facts, count(DISTINCT indicator) AS indicators, count(DISTINCT district) AS districts, min(year) AS first_year, max(year) AS last_year, round(sum(confidence_score::DECIMAL(10, 4))::DOUBLE / count(*), 6) AS confidence FROM {facts} f GROUP BY source_document")
def agg_data_stats(spark: SparkSession, sf: str) -> DataFrame:
    mean = F.round(F.sum(F.col("confidence_score").cast("decimal(10,4)")).cast("double") / F.count(F.lit(1)), 6)
    return facts(spark, sf).groupBy("source_document").agg(F.count(F.lit(1)).alias("facts"), F.countDistinct("indicator").alias("indicators"), F.countDistinct("district").alias("districts"), F.min("year").alias("first_year"), F.max("year").alias("last_year"), mean.alias("confidence"))


@query("SELECT count(*) AS total_facts, count(category) AS with_category, count(DISTINCT fact_id) AS ids, count(DISTINCT indicator) AS indicators, count(DISTINCT district) AS districts, round(sum(confidence_score::DECIMAL(10, 4))::DOUBLE / count(*), 6) AS avg_confidence FROM {facts} f")
def agg_sql_fact_stats(spark: SparkSession, sf: str) -> DataFrame:
    mean = F.round(F.sum(F.col("confidence_score").cast("decimal(10,4)")).cast("double") / F.count(F.lit(1)), 6)
    return facts(spark, sf).agg(F.count(F.lit(1)).alias("total_facts"), F.count("category").alias("with_category"), F.countDistinct("fact_id").alias("ids"), F.countDistinct("indicator").alias("indicators"), F.countDistinct("district").alias("districts"), mean.alias("avg_confidence"))


@query("SELECT count(*) AS documents, count(DISTINCT lang) AS languages, count(DISTINCT source) AS sources FROM documents")
def agg_sql_doc_stats(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").agg(F.count(F.lit(1)).alias("documents"), F.countDistinct("lang").alias("languages"), F.countDistinct("source").alias("sources"))


@query("SELECT count(*) AS entities, count(DISTINCT c_mktsegment) AS kinds FROM customer")
def agg_sql_entity_stats(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "customer").agg(F.count(F.lit(1)).alias("entities"), F.countDistinct("c_mktsegment").alias("kinds"))


@query("SELECT indicator, year, round(sum(value::DECIMAL(28, 2))::DOUBLE / count(value), 6) AS average FROM {facts} f GROUP BY 1, 2")
def agg_indicator_trends(spark: SparkSession, sf: str) -> DataFrame:
    return facts(spark, sf).groupBy("indicator", "year").agg(A.exact_avg("value").alias("average")).orderBy("indicator", "year")


@query("SELECT source_document, indicator, count(*) AS n FROM {facts} f GROUP BY 1, 2")
def agg_source_comparison(spark: SparkSession, sf: str) -> DataFrame:
    return facts(spark, sf).groupBy("source_document", "indicator").agg(F.count(F.lit(1)).alias("n")).orderBy("source_document", F.desc("n"), "indicator")


@query("SELECT 2018 AS year, count(*) AS n, array_to_string(list_sort(list(DISTINCT indicator))[1:10], '|') AS indicators FROM {facts} f WHERE year = 2018")
def agg_year_context(spark: SparkSession, sf: str) -> DataFrame:
    found = facts(spark, sf).where("year = 2018").agg(F.count(F.lit(1)).alias("n"), F.array_join(F.slice(F.array_sort(F.collect_set("indicator")), 1, 10), "|").alias("indicators"))
    return found.select(F.lit(2018).alias("year"), "n", "indicators")


@query("SELECT district, degree FROM (SELECT district, count(*) AS degree FROM {facts} f GROUP BY district) ORDER BY degree DESC, district LIMIT 10")
def agg_graph_counts(spark: SparkSession, sf: str) -> DataFrame:
    return facts(spark, sf).groupBy("district").agg(F.count(F.lit(1)).alias("degree")).orderBy(F.desc("degree"), "district").limit(10)


@query(f"SELECT total, unknown, out_of_range, unknown <= (1 - 0.9::DOUBLE) * total AS passed FROM (SELECT count(*) AS total, count(*) FILTER (WHERE low IS NULL OR district NOT IN ({KNOWN})) AS unknown, count(*) FILTER (WHERE f.value NOT BETWEEN low AND high) AS out_of_range FROM {{facts}} f LEFT JOIN {SQL_RANGES} USING (indicator))")
def agg_normalization_metrics(spark: SparkSession, sf: str) -> DataFrame:
    f = facts(spark, sf)
    known = f.join(F.broadcast(P.ranges(f)), "indicator", "left")
    out = known.agg(F.count(F.lit(1)).alias("total"), F.count_if(F.col("low").isNull() | ~F.col("district").isin(DISTRICTS)).alias("unknown"), F.count_if(~F.col("value").between(F.col("low"), F.col("high"))).alias("out_of_range"))
    return out.withColumn("passed", F.col("unknown") <= (1 - F.lit(0.9)) * F.col("total"))


@query("SELECT fact_id FROM (SELECT district FROM (SELECT DISTINCT district FROM {facts} f)) d JOIN LATERAL (SELECT d.district AS fact_id) l ON true WHERE district LIKE 'NATION%'")
def set_except(spark: SparkSession, sf: str) -> DataFrame:
    known = spark.createDataFrame([(d,) for d in DISTRICTS], "fact_id string")
    return facts(spark, sf).select(F.col("district").alias("fact_id")).distinct().join(known, "fact_id", "left_anti")


@query("SELECT before, year FROM (SELECT year, lag(year) OVER (ORDER BY year) AS before FROM (SELECT DISTINCT 3 * p_size AS year FROM part)) WHERE year - before > 1")
def win_year_gaps(spark: SparkSession, sf: str) -> DataFrame:
    return A.year_gaps(table(spark, sf, "part").select((3 * F.col("p_size")).alias("year")))


@query("WITH c AS (SELECT p_brand AS indicator, count(*) AS n FROM part GROUP BY 1) SELECT indicator, n FROM c WHERE n < 0.9::DOUBLE * (SELECT avg(n) FROM c)")
def agg_dataset_anomalies(spark: SparkSession, sf: str) -> DataFrame:
    return A.sparse_indicators(table(spark, sf, "part").select(F.col("p_brand").alias("indicator")), 0.9)


@query("SELECT source, target, gap, greatest(5, 10 - 2 * gap) / 10.0::DOUBLE AS strength, CASE WHEN gap > 0 THEN 'forward' ELSE 'backward' END AS direction FROM (SELECT fact_id AS source, lead(fact_id) OVER w AS target, lead(year) OVER w - year AS gap FROM (SELECT * REPLACE (CASE WHEN year >= 2019 THEN year + 2 ELSE year END AS year) FROM {facts} g) f WINDOW w AS (PARTITION BY indicator, district ORDER BY year, ord)) WHERE gap <= 2")
def win_temporal_lead(spark: SparkSession, sf: str) -> DataFrame:
    return W.temporal_edges(facts(spark, sf).withColumn("year", F.when(F.col("year") >= 2019, F.col("year") + 2).otherwise(F.col("year"))))


@query("SELECT source_document, fact_id, ord FROM (SELECT *, row_number() OVER (PARTITION BY source_document ORDER BY ord) AS i FROM {facts} f) WHERE i = 1")
def win_first_match(spark: SparkSession, sf: str) -> DataFrame:
    return W.first_match(facts(spark, sf), ["source_document"], ["ord"]).select("source_document", "fact_id", "ord")


@query("SELECT district, fact_id, value, i::INTEGER AS rank FROM (SELECT *, row_number() OVER (PARTITION BY district ORDER BY value DESC, fact_id) AS i FROM {facts} f) WHERE i <= 3")
def win_topk_per_group(spark: SparkSession, sf: str) -> DataFrame:
    return W.top_per_group(facts(spark, sf), ["district"], [F.desc("value"), "fact_id"], 3).select("district", "fact_id", "value", "rank")


@query("SELECT doc_id, substr(text, 1, 100) AS head FROM (SELECT *, row_number() OVER (PARTITION BY substr(text, 1, 100) ORDER BY doc_id) AS i FROM documents) WHERE i = 1")
def win_dedup_first(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents").select("doc_id", F.substring("text", 1, 100).alias("head"))
    return W.first_match(docs, ["head"], ["doc_id"])


@query("SELECT fact_id, value, row_number() OVER (ORDER BY value DESC, fact_id)::INTEGER AS rank FROM {facts} f QUALIFY rank <= 10")
def win_rank_results(spark: SparkSession, sf: str) -> DataFrame:
    return W.ranked(facts(spark, sf), "value", "fact_id", 10).select("fact_id", "value", "rank")


@query("SELECT fact_id, district, value FROM {facts} f WHERE indicator = 'Dropout Rate' AND year = 2020 ORDER BY value DESC, fact_id LIMIT 5")
def topk_graph_district(spark: SparkSession, sf: str) -> DataFrame:
    return P.by_indicator(facts(spark, sf), "Dropout Rate", None, 2020).orderBy(F.desc("value"), "fact_id").limit(5).select("fact_id", "district", "value")


@query("SELECT district, year, value FROM {facts} f WHERE indicator = 'Pupil Teacher Ratio' ORDER BY district, year")
def sort_ger_by_district(spark: SparkSession, sf: str) -> DataFrame:
    return P.by_indicator(facts(spark, sf), "Pupil Teacher Ratio").select("district", "year", "value").orderBy("district", "year")


@query("SELECT fact_id, year FROM {facts} f WHERE contains(lower(indicator), 'enroll') ORDER BY year DESC, fact_id LIMIT 25")
def topk_bridge_search(spark: SparkSession, sf: str) -> DataFrame:
    return facts(spark, sf).where(F.lower("indicator").contains("enroll")).orderBy(F.desc("year"), "fact_id").limit(25).select("fact_id", "year")


@query("SELECT o_orderkey, coalesce(nullif(y, 1999), 0) AS year FROM (SELECT o_orderkey, year(o_orderdate) AS y FROM orders) ORDER BY 2, 1")
def sort_temporal(spark: SparkSession, sf: str) -> DataFrame:
    o = table(spark, sf, "orders").select("o_orderkey", F.nullif(F.year("o_orderdate"), F.lit(1999)).alias("y"))
    return o.select("o_orderkey", F.coalesce("y", F.lit(0)).cast("long").alias("year")).orderBy("year", "o_orderkey")


@query("SELECT DISTINCT doc_type FROM (SELECT " + DOC_TYPE + " AS doc_type FROM {facts} f) ORDER BY doc_type")
def sort_parents(spark: SparkSession, sf: str) -> DataFrame:
    return facts(spark, sf).select(A.document_type(F.col("source_document")).alias("doc_type")).distinct().orderBy("doc_type")


@query("SELECT fact_id FROM (SELECT fact_id, 1 AS q FROM {facts} f WHERE year = 2019 UNION ALL SELECT fact_id, 2 FROM {facts} f WHERE indicator = 'Dropout Rate' UNION ALL SELECT fact_id, 3 FROM {facts} f WHERE value > 30) GROUP BY fact_id HAVING count(DISTINCT q) = 3")
def set_intersect_queries(spark: SparkSession, sf: str) -> DataFrame:
    f = facts(spark, sf)
    return f.where("year = 2019").select("fact_id").intersect(f.where("indicator = 'Dropout Rate'").select("fact_id")).intersect(f.where("value > 30").select("fact_id"))


@query("SELECT fact_id FROM (SELECT fact_id FROM {facts} f WHERE district = 'Guntur' AND year = 2019 UNION SELECT fact_id FROM {facts} f WHERE indicator = 'Dropout Rate' AND district = 'Guntur' UNION SELECT fact_id FROM {facts} f WHERE indicator = 'Dropout Rate' AND year = 2019) ORDER BY fact_id LIMIT 20")
def set_union_related(spark: SparkSession, sf: str) -> DataFrame:
    f = facts(spark, sf)
    three = [f.where("district = 'Guntur' and year = 2019"), f.where("indicator = 'Dropout Rate' and district = 'Guntur'"), f.where("indicator = 'Dropout Rate' and year = 2019")]
    a, b, c = (x.select("fact_id") for x in three)
    return a.union(b).union(c).distinct().orderBy("fact_id").limit(20)


@query("SELECT a.source_document AS a, b.source_document AS b FROM (SELECT source_document, list(DISTINCT category) AS cs FROM {facts} f WHERE category IS NOT NULL GROUP BY 1) a JOIN (SELECT source_document, list(DISTINCT category) AS cs FROM {facts} f WHERE category IS NOT NULL GROUP BY 1) b ON a.source_document < b.source_document AND list_has_any(a.cs, b.cs)")
def set_overlap(spark: SparkSession, sf: str) -> DataFrame:
    pairs = facts(spark, sf).where("category is not null").select("source_document", "category").distinct()
    other = pairs.withColumnRenamed("source_document", "b")
    return pairs.join(other, "category").where("source_document < b").select(F.col("source_document").alias("a"), "b").distinct()


@query("SELECT district FROM {facts} f GROUP BY district HAVING count(DISTINCT indicator) FILTER (WHERE indicator IN ('Dropout Rate', 'Total Enrollment')) = 2")
def set_superset(spark: SparkSession, sf: str) -> DataFrame:
    wanted = F.array(F.lit("Dropout Rate"), F.lit("Total Enrollment"))
    return facts(spark, sf).groupBy("district").agg(F.collect_set("indicator").alias("has")).where(F.size(F.array_except(wanted, "has")) == 0).select("district")


@query("SELECT fact_id, 'observed' AS kind, value FROM {facts} f WHERE year = 2015 UNION ALL SELECT 'S_' || district, 'summed', sum(value::DECIMAL(28, 2))::DOUBLE FROM {facts} f WHERE year = 2015 GROUP BY district")
def set_union_results(spark: SparkSession, sf: str) -> DataFrame:
    f = facts(spark, sf).where("year = 2015")
    summed = f.groupBy("district").agg(A.exact_sum("value").alias("value")).select(F.concat(F.lit("S_"), "district").alias("fact_id"), F.lit("summed").alias("kind"), "value")
    return f.select("fact_id", F.lit("observed").alias("kind"), "value").unionByName(summed)
