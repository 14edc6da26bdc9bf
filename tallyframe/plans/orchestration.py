"""Queries of search modes and compositions, retrieval by kind, citations, contexts and exports."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import citations as C
from ..operators import graph as G
from ..operators import reports as RP
from ..operators import retrieval as T
from ..operators import routing as R
from ..operators import search as S
from ..operators.bridges import fact_graph
from ..operators.communities import modularity_communities
from ..operators.filters import any_of
from ..sources.facts import facts, legal_texts, table
from ..sources.tables import kept
from .registry import query
from .structured import LINKS, SQL_LINKS, UNION, policies
from .textual import ASKED, SOUGHT, WORDS, asked, words_sql
from ..functions import vocabulary as V

TERMS, ASKED_VECTOR, VECTORS = ("dropout", "guntur"), 7, "(SELECT count(*) FROM embeddings)"
CONTENT = "indicator || ' in ' || district || ' | Year ' || year || ' | Value: ' || printf('%.2f', value) || ' ' || unit || coalesce(' | Category: ' || category, '') || ' | Source: ' || source_document"
FV = f"(SELECT f.*, e.embedding, {CONTENT} AS content FROM {{facts}} f JOIN embeddings e ON e.vec_id = ((f.ord // 1000) * 37 + f.ord) % {VECTORS})"
LV = f"(SELECT t.doc_id, t.text AS content, year(o_orderdate) + 20 AS issued, e.embedding FROM {{legal}} t JOIN orders ON o_orderkey = t.doc_id JOIN embeddings e ON e.vec_id = t.doc_id % {VECTORS})"


def valued(spark: SparkSession, sf: str, f: DataFrame | None = None) -> DataFrame:
    """Facts (``f``, if they are made already) with their text and one of the given vectors each."""
    vectors = table(spark, sf, "embeddings").select(F.col("vec_id").alias("place"), "embedding")
    place = (F.floor(F.col("ord") / 1000) * 37 + F.col("ord")) % vectors.count()
    f = facts(spark, sf) if f is None else f
    return f.withColumn("place", place).join(vectors, "place").withColumn("content", T.fact_content()).drop("place")


def legal(spark: SparkSession, sf: str) -> DataFrame:
    """Orders with their text, their year of issue and one of the given vectors each."""
    vectors = table(spark, sf, "embeddings").select(F.col("vec_id").alias("place"), "embedding")
    issued = table(spark, sf, "orders").select(F.col("o_orderkey").alias("doc_id"), (F.year("o_orderdate") + 20).alias("issued"))
    return legal_texts(spark, sf).withColumnRenamed("text", "content").join(issued, "doc_id").withColumn("place", F.col("doc_id") % vectors.count()).join(vectors, "place").drop("place")


def question(spark: SparkSession, sf: str, terms: tuple[str, ...] = TERMS, vector: int = ASKED_VECTOR) -> S.Question:
    row = table(spark, sf, "embeddings").where(F.col("vec_id") == vector).select("embedding").first()
    return S.Question(terms, tuple(float(x) for x in row.embedding))


def vec_sql(src: str, key: str, vector: int = ASKED_VECTOR) -> str:
    return f"(SELECT {key}, list_cosine_similarity(embedding::DOUBLE[], (SELECT embedding::DOUBLE[] FROM embeddings WHERE vec_id = {vector})) AS score FROM {src})"


def bm_sql(src: str, key: str, terms: tuple[str, ...] = TERMS) -> str:
    counts = ", ".join(f"len(list_filter(w, lambda x: x = '{t}')) AS f{i}" for i, t in enumerate(terms))
    held = ", ".join(f"count(*) FILTER (WHERE f{i} > 0) AS d{i}" for i in range(len(terms)))
    score = " + ".join(f"ln(1 + (docs - d{i} + 0.5::DOUBLE) / (d{i} + 0.5::DOUBLE)) * f{i} * 2.2::DOUBLE / (f{i} + 1.2::DOUBLE * (1 - 0.75::DOUBLE + 0.75::DOUBLE * n / mean))" for i in range(len(terms)))
    return f"(WITH w AS (SELECT {key}, list_filter(regexp_split_to_array(lower(content), '[^a-z0-9]+'), lambda x: x <> '') AS w FROM {src}), c AS (SELECT {key}, len(w) AS n, {counts} FROM w), s AS (SELECT count(*) AS docs, avg(n) AS mean, {held} FROM c), r AS (SELECT {key}, {score} AS score FROM c, s) SELECT * FROM r WHERE score > 0)"


def top_sql(rows: str, key: str, k: int) -> str:
    return f"(SELECT {key}, score FROM {rows} ORDER BY score DESC, {key} LIMIT {k})"


def scaled_sql(rows: str, key: str, name: str) -> str:
    return f"(SELECT {key}, CASE WHEN high = low THEN 1.0::DOUBLE ELSE (score - low) / (high - low) END AS {name} FROM {rows}, (SELECT min(score) AS low, max(score) AS high FROM {rows}))"


def hybrid_sql(src: str, key: str, k: int, alpha: float = S.SEARCH_ALPHA, terms: tuple[str, ...] = TERMS, vector: int = ASKED_VECTOR) -> str:
    v, w = scaled_sql(vec_sql(src, key, vector), key, "v"), scaled_sql(bm_sql(src, key, terms), key, "w")
    return f"(SELECT {key}, {alpha}::DOUBLE * coalesce(v, 0) + (1 - {alpha}::DOUBLE) * coalesce(w, 0) AS score FROM {v} FULL JOIN {w} USING ({key}) ORDER BY score DESC, {key} LIMIT {k})"


def rounded(df: DataFrame) -> DataFrame:
    return df.withColumn("score", F.round("score", 6))


@query(f"SELECT fact_id, round(score, 6) AS score FROM {hybrid_sql(FV, 'fact_id', 25)}")
def rt_search(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(S.search(valued(spark, sf), "fact_id", question(spark, sf), 25))


GUNTUR = f"(SELECT * FROM {FV} WHERE district = 'Guntur' AND year = 2018)"


@query(f"SELECT fact_id, round(score, 6) AS score FROM {hybrid_sql(GUNTUR, 'fact_id', 25, 0.5)}")
def rt_search_filtered(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(S.search(valued(spark, sf), "fact_id", question(spark, sf), 25, 0.5, (F.col("district") == "Guntur") & (F.col("year") == 2018)))


@query(f"SELECT fact_id, policy, source AS related FROM (SELECT fact_id, indicator FROM {FV} WHERE contains(lower(content), 'guntur') OR contains(lower(indicator), 'guntur')) LEFT JOIN (VALUES ('Teacher Act', 'Number of Teachers'), ('Dropout Policy', 'Dropout Rate'), ('Enrollment Mission', 'Girls Enrollment')) p(policy, indicator) USING (indicator) LEFT JOIN {SQL_LINKS} ON target = indicator")
def rt_bridge_search(spark: SparkSession, sf: str) -> DataFrame:
    f = facts(spark, sf).withColumn("content", T.fact_content())
    found = f.where(F.lower("content").contains("guntur") | F.lower("indicator").contains("guntur")).select("fact_id", "indicator")
    near = G.undirected(spark.createDataFrame(LINKS, "source string, target string"))
    return found.join(F.broadcast(policies(spark)), "indicator", "left").join(F.broadcast(near.select(F.col("target").alias("indicator"), F.col("source").alias("related"))), "indicator", "left").select("fact_id", "policy", "related")


BEST_GRAPH = f"(SELECT fact_id, max(score) AS score FROM ({UNION}) GROUP BY 1)"


def graph_found(spark: SparkSession, sf: str, k: int, f: DataFrame | None = None) -> DataFrame:
    return S.graph_search(facts(spark, sf) if f is None else f, policies(spark), spark.createDataFrame(LINKS, "source string, target string"), "Dropout", k)


@query(f"SELECT * FROM {top_sql(BEST_GRAPH, 'fact_id', 30)}")
def rt_graph_search(spark: SparkSession, sf: str) -> DataFrame:
    return graph_found(spark, sf, 30)


LEGAL_TERMS = ("guntur", "2016")
ISSUED = f"(SELECT * FROM {LV} WHERE issued::VARCHAR LIKE '%2016%')"


def legal_found(spark: SparkSession, sf: str, k: int) -> DataFrame:
    return S.search(legal(spark, sf), "doc_id", question(spark, sf, LEGAL_TERMS), k, S.LEGAL_ALPHA, F.col("issued").cast("string").contains("2016"))


@query(f"SELECT doc_id, round(score, 6) AS score FROM {hybrid_sql(ISSUED, 'doc_id', 10, S.LEGAL_ALPHA, LEGAL_TERMS)}")
def rt_legal(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(legal_found(spark, sf, 10))


@query(f"SELECT bucket, count(*) AS n, min(doc_id) AS first FROM (SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN 'acts' WHEN 1 THEN 'rules' WHEN 2 THEN 'gos' ELSE 'other' END AS bucket FROM {hybrid_sql(ISSUED, 'doc_id', 20, S.LEGAL_ALPHA, LEGAL_TERMS)}) GROUP BY 1")
def rt_hierarchy(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("doc_id") % 4
    kind = F.when(k == 0, "Education Act").when(k == 1, "Service Rule").when(k == 2, "GO").otherwise("circular")
    return legal_found(spark, sf, 20).groupBy(S.hierarchy_bucket(kind).alias("bucket")).agg(F.count(F.lit(1)).alias("n"), F.min("doc_id").alias("first"))


DATA = f"(SELECT * FROM {FV} WHERE lower(split_part(source_document, '_', 1)) IN ('udise', 'scert', 'cse') OR district = 'Guntur' OR year = 2018)"


def data_found(spark: SparkSession, sf: str, k: int) -> DataFrame:
    return S.search(valued(spark, sf), "fact_id", question(spark, sf), k, S.DATA_ALPHA, S.data_filter(["Guntur"], [2018]))


@query(f"SELECT fact_id, round(score, 6) AS score FROM {hybrid_sql(DATA, 'fact_id', 10, S.DATA_ALPHA)}")
def rt_data(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(data_found(spark, sf, 10))


@query(f"SELECT 'legal' AS part, doc_id::VARCHAR AS id FROM {hybrid_sql(ISSUED, 'doc_id', 10, S.LEGAL_ALPHA, LEGAL_TERMS)} UNION ALL SELECT 'data', fact_id FROM {hybrid_sql(DATA, 'fact_id', 10, S.DATA_ALPHA)} UNION ALL SELECT 'Guntur', indicator FROM (SELECT DISTINCT indicator FROM {{facts}} f WHERE district = 'Guntur') UNION ALL SELECT 'Dropout Rate', district FROM (SELECT DISTINCT district FROM {{facts}} f WHERE indicator = 'Dropout Rate')")
def rt_graph_context(spark: SparkSession, sf: str) -> DataFrame:
    f = facts(spark, sf)
    found = legal_found(spark, sf, 10).select(F.lit("legal").alias("part"), F.col("doc_id").cast("string").alias("id")).union(data_found(spark, sf, 10).select(F.lit("data"), "fact_id"))
    near = f.select(F.col("district").alias("source"), F.col("indicator").alias("target"))
    context = G.distances(near, spark.createDataFrame([("Guntur",), ("Dropout Rate",)], "id string"), 1).where("distance = 1")
    return found.union(context.select("id", "node"))


SPAN = f"(SELECT * FROM {DATA} WHERE year BETWEEN 2016 AND 2019)"


@query(f"SELECT fact_id, year, row_number() OVER (ORDER BY year, fact_id) AS place FROM (SELECT fact_id FROM {hybrid_sql(SPAN, 'fact_id', 10, S.DATA_ALPHA)}) JOIN (SELECT fact_id, year FROM {{facts}} f) USING (fact_id)")
def rt_temporal(spark: SparkSession, sf: str) -> DataFrame:
    rows = valued(spark, sf)
    found = S.search(rows, "fact_id", question(spark, sf), 10, S.DATA_ALPHA, S.data_filter(["Guntur"], [2018]) & F.col("year").between(2016, 2019))
    dated = found.join(facts(spark, sf).select("fact_id", "year"), "fact_id")
    return dated.select("fact_id", "year", F.row_number().over(Window.orderBy("year", "fact_id")).cast("long").alias("place"))  # ten rows


@query(f"SELECT * FROM (SELECT fact_id, year, row_number() OVER (ORDER BY year, fact_id) AS place FROM (SELECT fact_id FROM {hybrid_sql(DATA, 'fact_id', 10, S.DATA_ALPHA)}) JOIN (SELECT fact_id, year FROM {{facts}} f) USING (fact_id))")
def rt_temporal_observed(spark: SparkSession, sf: str) -> DataFrame:
    dated = data_found(spark, sf, 10).join(facts(spark, sf).select("fact_id", "year"), "fact_id")
    return dated.select("fact_id", "year", F.row_number().over(Window.orderBy("year", "fact_id")).cast("long").alias("place"))


PAIR = [("Guntur", ("dropout", "rate", "guntur", "2018"), 7), ("Krishna", ("dropout", "rate", "krishna", "2018"), 8)]


@query(" UNION ALL ".join(f"SELECT '{e}' AS entity, fact_id, round(score, 6) AS score FROM {hybrid_sql(DATA, 'fact_id', 5, S.DATA_ALPHA, t, v)}" for e, t, v in PAIR))
def rt_comparative(spark: SparkSession, sf: str) -> DataFrame:
    rows, keep = valued(spark, sf), S.data_filter(["Guntur"], [2018])
    each = [S.search(rows, "fact_id", question(spark, sf, t, v), 5, S.DATA_ALPHA, keep).select(F.lit(e).alias("entity"), "fact_id", F.round("score", 6).alias("score")) for e, t, v in PAIR]
    return each[0].union(each[1])


def vectors_found(spark: SparkSession, sf: str, k: int, f: DataFrame | None = None) -> DataFrame:
    return S.vector_search(valued(spark, sf, f), "fact_id", question(spark, sf), k)


def words_found(spark: SparkSession, sf: str, k: int, f: DataFrame | None = None) -> DataFrame:
    return S.keyword_search(valued(spark, sf, f), "fact_id", question(spark, sf), k)


def hybrid_found(spark: SparkSession, sf: str, k: int, f: DataFrame | None = None) -> DataFrame:
    return S.search(valued(spark, sf, f), "fact_id", question(spark, sf), k)


TOP_VEC, TOP_BM = (lambda k: top_sql(vec_sql(FV, "fact_id"), "fact_id", k)), (lambda k: top_sql(bm_sql(FV, "fact_id"), "fact_id", k))


def voted_sql(k: int) -> str:
    lists = [TOP_VEC(2 * k), TOP_BM(2 * k), top_sql(BEST_GRAPH, "fact_id", 2 * k)]
    return "(SELECT fact_id, count(*) AS votes, max(s) AS score FROM (" + " UNION ALL ".join(f"SELECT * FROM {scaled_sql(x, 'fact_id', 's')}" for x in lists) + f") GROUP BY 1 ORDER BY votes DESC, score DESC, fact_id LIMIT {k})"


def ensemble(spark: SparkSession, sf: str, k: int, f: DataFrame | None = None) -> DataFrame:
    """The votes of three searches over the same facts, which are made once."""
    f = kept(facts(spark, sf)) if f is None else f
    return S.voted([vectors_found(spark, sf, 2 * k, f), words_found(spark, sf, 2 * k, f), graph_found(spark, sf, 2 * k, f)], "fact_id", k)


METHOD_COUNT = " + ".join(["1", f"{words_sql('q', V.COMPARISON_WORDS)}::INT", f"{words_sql('q', V.TIME_WORDS)}::INT", f"({SOUGHT} > 0)::INT"])
COMPLEXITY = f"least(1, ({WORDS} / 20.0::DOUBLE + {SOUGHT} / 10.0::DOUBLE + {words_sql('q', V.COMPARISON_WORDS)}::INT + {words_sql('q', V.TIME_WORDS)}::INT) / 4)"


@query(f"SELECT fact_id, CASE WHEN {COMPLEXITY} > 0.7::DOUBLE THEN 'advanced' WHEN {METHOD_COUNT} > 2 THEN 'hybrid' ELSE 'vector' END AS mode FROM {ASKED}")
def ms_intelligent(spark: SparkSession, sf: str) -> DataFrame:
    q = F.col("q")
    methods = 1 + any_of(q, V.COMPARISON_WORDS).cast("int") + any_of(q, V.TIME_WORDS).cast("int") + (F.size(R.sought(q)) > 0).cast("int")
    return asked(spark, sf).select("fact_id", S.intelligent_mode(R.complexity(q), methods).alias("mode"))


INTELLIGENT = {
    "plain": "dropout in guntur",
    "mixed": "compare the dropout rate of guntur over the years",
    "complex": "compare and contrast the trends over time of the dropout rate, the pupil teacher ratio and the girls enrollment of guntur with those of krishna between 2015 and 2020 and explain which of the two districts has improved more than the other since then",
}
BY_MODE = "(" + " UNION ALL ".join(f"SELECT '{mode}' AS mode, fact_id, score FROM {rows}" for mode, rows in (("vector", TOP_VEC(12)), ("hybrid", hybrid_sql(FV, "fact_id", 12)), ("advanced", voted_sql(12)))) + ")"
MODE_SQL = f"CASE WHEN {COMPLEXITY} > 0.7::DOUBLE THEN 'advanced' WHEN {METHOD_COUNT} > 2 THEN 'hybrid' ELSE 'vector' END"


@query(f"SELECT question, mode, fact_id, round(score, 6) AS score FROM (SELECT question, {MODE_SQL} AS mode FROM (VALUES " + ", ".join(f"('{n}', '{q}')" for n, q in INTELLIGENT.items()) + f") t(question, q)) JOIN {BY_MODE} USING (mode)")
def ms_intelligent_search(spark: SparkSession, sf: str) -> DataFrame:
    """The results of the search that fits each question: by votes, by a mixture, or by vectors alone."""
    q = F.col("q")
    methods = 1 + any_of(q, V.COMPARISON_WORDS).cast("int") + any_of(q, V.TIME_WORDS).cast("int") + (F.size(R.sought(q)) > 0).cast("int")
    questions = spark.createDataFrame(list(INTELLIGENT.items()), "question string, q string")
    modes = questions.select("question", S.intelligent_mode(R.complexity(q), methods).alias("mode"))
    searches = {"vector": vectors_found, "hybrid": hybrid_found, "advanced": lambda *a: ensemble(*a).select("fact_id", "score")}
    # a mode is a question's, so only the searches that some question needs are planned
    f = kept(facts(spark, sf))
    each = [searches[r.mode](spark, sf, 12, f).select(F.lit(r.question).alias("question"), F.lit(r.mode).alias("mode"), "fact_id", F.round("score", 6).alias("score")) for r in modes.collect()]
    return reduce(DataFrame.union, each)


@query(f"SELECT fact_id, round(score, 6) AS score, part FROM (SELECT *, row_number() OVER (PARTITION BY fact_id ORDER BY part) AS i FROM (SELECT fact_id, score, 0 AS part FROM {TOP_VEC(7)} UNION ALL SELECT fact_id, score, 1 FROM {top_sql(BEST_GRAPH, 'fact_id', 7)} UNION ALL SELECT fact_id, score, 2 FROM {TOP_BM(7)})) WHERE i = 1 ORDER BY part, score DESC, fact_id LIMIT 21")
def ms_multi_modal(spark: SparkSession, sf: str) -> DataFrame:
    k = 21
    return rounded(S.multi_modal(vectors_found(spark, sf, k // 3), graph_found(spark, sf, k // 3), words_found(spark, sf, k // 3), "fact_id", k))


NEAR = "(SELECT a.fact_id AS source, b.fact_id AS target FROM {facts} a JOIN {facts} b ON a.district = b.district AND a.indicator = b.indicator AND abs(a.year - b.year) = 1)"


@query(f"SELECT fact_id, round(score, 6) AS score, coalesce(related, 0) AS related FROM {TOP_VEC(10)} LEFT JOIN (SELECT a.source AS fact_id, count(DISTINCT t) AS related FROM {NEAR} a, LATERAL (SELECT a.target AS t UNION SELECT b.target FROM {NEAR} b WHERE b.source = a.target AND b.target <> a.source) GROUP BY 1) USING (fact_id)")
def ms_contextual(spark: SparkSession, sf: str) -> DataFrame:
    f = facts(spark, sf)
    nxt = f.select("district", "indicator", (F.col("year") - 1).alias("year"), F.col("fact_id").alias("target"))
    edges = f.join(nxt, ["district", "indicator", "year"]).select(F.col("fact_id").alias("source"), "target")
    return rounded(S.with_context(vectors_found(spark, sf, 10), edges, "fact_id", 2))


@query(f"SELECT fact_id, round(score, 6) AS score, i AS rank FROM (SELECT fact_id, score, row_number() OVER (PARTITION BY indicator ORDER BY score DESC, fact_id) AS i FROM {hybrid_sql(FV, 'fact_id', 30)} JOIN (SELECT fact_id, indicator FROM {{facts}} f) USING (fact_id)) WHERE i <= 15 ORDER BY i, score DESC, fact_id LIMIT 15")
def ms_exploratory(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(S.diverse(hybrid_found(spark, sf, 30), facts(spark, sf), "fact_id", ["indicator"], 15))


@query(f"SELECT fact_id, round(score, 6) AS score FROM {TOP_BM(40)} WHERE score >= 0.8::DOUBLE")
def ms_precision(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(S.precise(words_found(spark, sf, 40)))


@query(f"SELECT fact_id, votes, round(score, 6) AS score FROM {voted_sql(20)}")
def ms_comprehensive(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(ensemble(spark, sf, 20))


@query(f"SELECT fact_id, round(score, 6) AS score, 'hybrid' AS search_type, CASE WHEN score > 0.8::DOUBLE THEN 'Highly relevant to your query' WHEN score > 0.6::DOUBLE THEN 'Good match for your query' ELSE 'Related to your search terms' END || '. Contains statistical data.' AS said FROM {hybrid_sql(FV, 'fact_id', 10)}")
def ms_entry(spark: SparkSession, sf: str) -> DataFrame:
    from ..operators.documents import explanation

    return hybrid_found(spark, sf, 10).select("fact_id", F.round("score", 6).alias("score"), F.lit("hybrid").alias("search_type"), explanation(F.col("score"), F.lit("statistical")).alias("said"))


@query(f"WITH r AS (SELECT 'words' AS query, fact_id FROM {TOP_BM(40)} UNION ALL SELECT 'graph', fact_id FROM {top_sql(BEST_GRAPH, 'fact_id', 60)}), c AS (SELECT fact_id FROM r GROUP BY 1 HAVING count(DISTINCT query) = 2) SELECT query, count(*) AS found, count(*) FILTER (WHERE fact_id IN (SELECT fact_id FROM c)) AS common, count(*) FILTER (WHERE fact_id NOT IN (SELECT fact_id FROM c)) AS own FROM r GROUP BY 1")
def ms_compare(spark: SparkSession, sf: str) -> DataFrame:
    both = words_found(spark, sf, 40).select(F.lit("words").alias("query"), "fact_id").union(graph_found(spark, sf, 60).select(F.lit("graph"), "fact_id"))
    return S.compared(both)


@query(f"SELECT year, count(*) AS n, round(sum(value::DECIMAL(28, 2))::DOUBLE / count(*), 4) AS mean, min(value) AS low, max(value) AS high FROM (SELECT fact_id FROM {voted_sql(50)}) JOIN (SELECT fact_id, year, value FROM {{facts}} f) USING (fact_id) WHERE year BETWEEN 2016 AND 2020 GROUP BY 1")
def ms_trend(spark: SparkSession, sf: str) -> DataFrame:
    f = kept(facts(spark, sf))
    return S.trend(ensemble(spark, sf, 50, f), f, 2016, 2020).withColumn("mean", F.round("mean", 4))


@query(f"SELECT 'vector' AS method, fact_id, round(score, 6) AS score FROM {TOP_VEC(10)}")
def sota_vector(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(vectors_found(spark, sf, 10)).select(F.lit("vector").alias("method"), "fact_id", "score")


@query(f"SELECT 'hybrid' AS method, fact_id, round(score, 6) AS score FROM {hybrid_sql(FV, 'fact_id', 10)}")
def sota_hybrid(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(hybrid_found(spark, sf, 10)).select(F.lit("hybrid").alias("method"), "fact_id", "score")


@query(f"SELECT 'graph' AS method, fact_id, score FROM {top_sql(BEST_GRAPH, 'fact_id', 10)}")
def sota_graph(spark: SparkSession, sf: str) -> DataFrame:
    return graph_found(spark, sf, 10).select(F.lit("graph").alias("method"), "fact_id", "score")



@query(f"SELECT h.fact_id, round(h.score, 6) AS score, 'DY_' || f.district || '_' || f.year AS bridge_id, c.n AS connected FROM {hybrid_sql(FV, 'fact_id', 10)} h JOIN {{facts}} f USING (fact_id) JOIN (SELECT district, year, count(*) - 1 AS n FROM {{facts}} g GROUP BY 1, 2) c USING (district, year)")
def sota_bridge(spark: SparkSession, sf: str) -> DataFrame:
    f = facts(spark, sf)
    sizes = f.groupBy("district", "year").agg((F.count(F.lit(1)) - 1).alias("connected"))
    beside = hybrid_found(spark, sf, 10).join(f.select("fact_id", "district", "year"), "fact_id").join(sizes, ["district", "year"])
    return beside.select("fact_id", F.round("score", 6).alias("score"), F.concat_ws("_", F.lit("DY"), "district", F.col("year").cast("string")).alias("bridge_id"), "connected")


STATED = f"indicator || ' in ' || district || ' for ' || year || ': ' || printf('%.2f', value) || ' ' || unit"
REASONED = "['Retrieved from ' || fact_id, 'Extracted numerical value: ' || printf('%.2f', value) || ' ' || unit, 'Verification status: ' || status]"
CHECKED_SQL = "CASE WHEN c > 0.8::DOUBLE THEN 'verified' WHEN c > 0.5::DOUBLE THEN 'uncertain' ELSE 'conflicting' END"


def structured_results(df: DataFrame, confidence: str) -> DataFrame:
    """``content, confidence, status, reasoning`` of results, as the last step of the agents gives them."""
    c = F.coalesce(confidence, F.lit(0.5))
    status = F.when(c > 0.8, "verified").when(c > 0.5, "uncertain").otherwise("conflicting")
    amount = F.concat(F.format_string("%.2f", "value"), F.lit(" "), F.col("unit"))
    content = F.concat("indicator", F.lit(" in "), "district", F.lit(" for "), F.col("year").cast("string"), F.lit(": "), amount)
    steps = F.array(F.concat(F.lit("Retrieved from "), "fact_id"), F.concat(F.lit("Extracted numerical value: "), amount), F.concat(F.lit("Verification status: "), status))
    return df.select("fact_id", content.alias("content"), c.alias("confidence"), status.alias("status"), F.array_join(steps, "|").alias("reasoning"))


@query(f"SELECT fact_id, {STATED} AS content, c AS confidence, status, array_to_string({REASONED}, '|') AS reasoning FROM (SELECT *, {CHECKED_SQL} AS status FROM (SELECT *, coalesce(confidence_score, 0.5::DOUBLE) AS c FROM {{facts}} f))")
def rag_structure(spark: SparkSession, sf: str) -> DataFrame:
    return structured_results(facts(spark, sf), "confidence_score")


@query(f"SELECT fact_id, {STATED} AS content, c AS confidence, status, array_to_string({REASONED}, '|') AS reasoning FROM (SELECT *, {CHECKED_SQL} AS status FROM (SELECT f.*, round(h.score, 6) AS c FROM {hybrid_sql(FV, 'fact_id', 12)} h JOIN {{facts}} f USING (fact_id)))")
def sota_advanced(spark: SparkSession, sf: str) -> DataFrame:
    return structured_results(rounded(hybrid_found(spark, sf, 12)).join(facts(spark, sf), "fact_id"), "score")


@query(f"SELECT fact_id, round(max(score), 6) AS score, CASE sum(o) WHEN 3 THEN 'both' WHEN 1 THEN 'exploratory' ELSE 'cited' END AS origin FROM (SELECT fact_id, score, 1 AS o FROM {hybrid_sql(FV, 'fact_id', 20)} UNION ALL SELECT fact_id, score, 2 FROM {hybrid_sql(DATA, 'fact_id', 10, S.DATA_ALPHA)}) GROUP BY 1")
def hyb_balanced(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(S.balanced(hybrid_found(spark, sf, 20), data_found(spark, sf, 10), "fact_id"))


@query()
def rag_build(spark: SparkSession, sf: str) -> DataFrame:
    """The graph of related facts, its communities by modularity, their summaries, and those that a question is about."""
    f = kept(facts(spark, sf))
    members = f.join(modularity_communities(fact_graph(f)).withColumnRenamed("id", "fact_id"), "fact_id")
    named = members.groupBy("community").agg(F.collect_set("district").alias("ds"), F.collect_set("indicator").alias("is"))
    score = RP.community_relevance(F.col("ds"), F.col("is"), (F.col("first_year") <= 2018) & (F.col("last_year") >= 2018), F.array(*map(F.lit, ("Guntur", "Krishna", "Dropout Rate"))))
    found = RP.community_summaries(members).join(named, "community").withColumn("relevance", F.round(score, 6)).where("relevance > 0.3")
    return found.select("community", "n", "districts", "indicators", "first_year", "last_year", "theme", "relevance")


@query(f"SELECT doc_id::VARCHAR AS doc_id, 'Untitled' AS title, 'go' AS doc_type, substr(content, 1, 500) AS excerpt, round(score, 6) AS confidence FROM {hybrid_sql(ISSUED, 'doc_id', 10, S.LEGAL_ALPHA, LEGAL_TERMS)} JOIN {LV} USING (doc_id) UNION ALL SELECT fact_id, source_document, 'statistics', indicator || ': ' || printf('%.2f', value) || ' (' || year || ')', round(score, 6) FROM {hybrid_sql(DATA, 'fact_id', 10, S.DATA_ALPHA)} JOIN {{facts}} f USING (fact_id)")
def ci_extract(spark: SparkSession, sf: str) -> DataFrame:
    docs = legal_found(spark, sf, 10).join(legal_texts(spark, sf), "doc_id").withColumns({"title": F.lit(None).cast("string"), "doc_type": F.lit(None).cast("string")})
    both = C.legal_citations(docs).union(C.data_citations(data_found(spark, sf, 10).join(facts(spark, sf), "fact_id")))
    return both.withColumn("confidence", F.round("confidence", 6))


KIND = "CASE o_orderkey % 4 WHEN 0 THEN 'act' WHEN 1 THEN 'rule' WHEN 2 THEN 'go' ELSE 'other' END"


@query(f"SELECT o_custkey AS answer, concat_ws(' → ', 'Act: ' || max(t) FILTER (WHERE k = 'act'), 'Rule: ' || max(t) FILTER (WHERE k = 'rule'), 'GO: ' || max(t) FILTER (WHERE k = 'go')) AS chain FROM (SELECT o_custkey, k, arg_max('Order ' || o_orderkey, o_orderkey) AS t FROM (SELECT *, {KIND} AS k FROM orders) WHERE k <> 'other' GROUP BY 1, 2) GROUP BY 1")
def ci_chain(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("o_orderkey")
    kind = F.when(k % 4 == 0, "act").when(k % 4 == 1, "rule").when(k % 4 == 2, "go").otherwise("other")
    docs = table(spark, sf, "orders").select(F.col("o_custkey").alias("answer"), k.alias("ord"), kind.alias("doc_type"), F.concat(F.lit("Order "), k.cast("string")).alias("title"))
    return C.chain(docs, "answer")


CITED = f"(SELECT fact_id AS result_id, substr(md5(source_document || district || indicator), 1, 8) AS citation_id, source_document AS source, district, indicator, year, source_page::VARCHAR AS page, confidence_score AS confidence, CASE WHEN length(content) > 200 THEN substr(content, 1, 200) || '...' ELSE content END AS excerpt FROM {FV})"


def cited(spark: SparkSession, sf: str) -> DataFrame:
    f = facts(spark, sf).withColumn("content", T.fact_content())
    return C.result_citations(f.select(F.col("fact_id").alias("result_id"), "source_document", "district", "indicator", "year", F.col("source_page").alias("page"), F.col("confidence_score").alias("score"), "content", F.lit(None).cast("string").alias("text")))


@query(f"SELECT * FROM {CITED}")
def ci_from_results(spark: SparkSession, sf: str) -> DataFrame:
    return cited(spark, sf)


@query(f"SELECT f.fact_id, substr(md5(f.source_document || f.district || f.indicator), 1, 8) AS citation_id FROM {{facts}} f")
def fn_citation_id(spark: SparkSession, sf: str) -> DataFrame:
    return facts(spark, sf).select("fact_id", T.citation_id(F.col("source_document"), F.col("district"), F.col("indicator")).alias("citation_id"))


NUMBERED = "(SELECT *, row_number() OVER (PARTITION BY district, year ORDER BY ord) AS n FROM " + FV + ")"
BLOCK = "'Document ' || n || ':' || chr(10) || 'Source: ' || source_document || chr(10) || 'District: ' || district || chr(10) || 'Indicator: ' || indicator || chr(10) || 'Year: ' || year || chr(10) || 'Content: ' || content || chr(10) || repeat('-', 50)"


def numbered(spark: SparkSession, sf: str) -> DataFrame:
    n = F.row_number().over(Window.partitionBy("district", "year").orderBy("ord"))
    return facts(spark, sf).withColumn("content", T.fact_content()).withColumn("n", n).withColumn("answer", F.concat_ws("_", "district", F.col("year").cast("string")))


@query(f"SELECT district || '_' || year AS answer, '{C.CONTEXT_LEAD}' || chr(10) || chr(10) || string_agg({BLOCK}, chr(10) ORDER BY n) AS context FROM {NUMBERED} GROUP BY 1")
def ci_context(spark: SparkSession, sf: str) -> DataFrame:
    return C.numbered_context(numbered(spark, sf), "answer")


REFS = "'[' || n || '] ' || source_document || ' - ' || district || ' (' || year || ') - ' || indicator"


@query(f"SELECT answer, md5('CONTEXT:' || chr(10) || context || chr(10) || chr(10) || 'QUERY: What of ' || answer || '?' || chr(10) || chr(10) || 'CITATION REFERENCES:' || chr(10) || refs || chr(10) || chr(10) || 'Cite your sources.') AS prompt FROM (SELECT district || '_' || year AS answer, '{C.CONTEXT_LEAD}' || chr(10) || chr(10) || string_agg({BLOCK}, chr(10) ORDER BY n) AS context, string_agg({REFS}, chr(10) ORDER BY n) AS refs FROM {NUMBERED} GROUP BY 1)")
def gen_prompt(spark: SparkSession, sf: str) -> DataFrame:
    rows = numbered(spark, sf)
    both = C.numbered_context(rows, "answer").join(C.references(rows.withColumnRenamed("source_document", "source"), "answer"), "answer")
    made = C.prompt(F.concat(F.lit("What of "), "answer", F.lit("?")), F.col("context"), F.col("refs"), "Cite your sources.")
    return both.select("answer", F.md5(made.cast("binary")).alias("prompt"))


@query(f"SELECT ord AS number, citation_id AS id, source || ' - ' || c.indicator AS title, printf('%.2f', confidence) AS confidence, page FROM {CITED} c JOIN {{facts}} f ON fact_id = result_id")
def ci_display(spark: SparkSession, sf: str) -> DataFrame:
    beside = cited(spark, sf).join(facts(spark, sf).select(F.col("fact_id").alias("result_id"), F.col("ord").alias("n")), "result_id")
    return C.displayed(beside)


@query("SELECT doc_id, md5(coalesce(CASE WHEN doc_id % 3 = 0 THEN lang END, CASE WHEN doc_id % 3 = 1 THEN source END, substr(text, 1, 1000))) AS said FROM documents")
def ci_texts(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("doc_id") % 3
    said = C.citation_texts(F.when(k == 0, F.col("lang")), F.when(k == 1, F.col("source")), F.col("text"))
    return table(spark, sf, "documents").select("doc_id", F.md5(said.cast("binary")).alias("said"))


REPORT = "'" + "=" * 60 + "' || chr(10) || 'CITATION VALIDATION REPORT' || chr(10) || '" + "=" * 60 + "' || chr(10) || chr(10) || 'Status: ' || CASE WHEN v THEN '✅ VALID' ELSE '❌ INVALID' END || chr(10) || 'Confidence: ' || printf('%.1f%%', 100 * c) || chr(10) || 'Hallucination Risk: ' || printf('%.1f%%', 100 * (1 - c)) || chr(10) || chr(10) || 'Citation Coverage:' || chr(10) || '  Total Claims: 4' || chr(10) || '  Cited Claims: ' || (4 - u) || chr(10) || '  Uncited Claims: ' || u || chr(10) || '  Coverage: ' || printf('%.1f%%', 25.0::DOUBLE * (4 - u)) || CASE WHEN v THEN '' ELSE chr(10) || chr(10) || '❌ Errors (1):' || chr(10) || '  - too few' END || CASE WHEN u > 0 THEN chr(10) || chr(10) || '📝 Uncited Claims:' || repeat(chr(10) || '  - ' || indicator || '...', u) ELSE '' END || chr(10) || chr(10) || '" + "=" * 60 + "'"


@query(f"SELECT fact_id, md5({REPORT}) AS report FROM (SELECT *, (ord % 4)::INT AS u, ord % 4 < 2 AS v, confidence_score AS c FROM {{facts}} f)")
def ci_report(spark: SparkSession, sf: str) -> DataFrame:
    u = (F.col("ord") % 4).cast("int")
    c, none = F.col("confidence_score"), F.array().cast("array<string>")
    text = C.report(u < 2, c, 1 - c, F.lit(4), F.array_repeat(F.col("indicator"), u), F.when(u >= 2, F.array(F.lit("too few"))).otherwise(none), none)
    return facts(spark, sf).select("fact_id", F.md5(text.cast("binary")).alias("report"))


LAW = "(SELECT o_custkey % 50 AS answer, o_orderkey, 'Order ' || o_orderkey AS title, 'text ' || o_totalprice::DECIMAL(18, 2) AS text, row_number() OVER (PARTITION BY o_custkey % 50 ORDER BY o_orderkey) AS n FROM orders)"
POINT = "(SELECT *, ord % 60 AS answer, row_number() OVER (PARTITION BY ord % 60 ORDER BY ord) AS n FROM {facts} f)"


@query(f"SELECT answer, concat_ws(chr(10), laws, stats) AS context FROM (SELECT answer, '{C.LEGAL_HEAD}' || chr(10) || string_agg('- ' || title || ': ' || text, chr(10) ORDER BY n) AS laws FROM {LAW} WHERE n <= 5 GROUP BY 1) FULL JOIN (SELECT answer, chr(10) || '{C.DATA_HEAD}' || chr(10) || string_agg('- ' || indicator || ': ' || printf('%.2f', value) || ' (' || district || ', ' || year || ')', chr(10) ORDER BY n) AS stats FROM {POINT} WHERE n <= 5 GROUP BY 1) USING (answer)")
def pol_context(spark: SparkSession, sf: str) -> DataFrame:
    o = table(spark, sf, "orders").withColumn("answer", F.col("o_custkey") % 50)
    law = o.withColumn("n", F.row_number().over(Window.partitionBy("answer").orderBy("o_orderkey"))).select("answer", "n", F.concat(F.lit("Order "), F.col("o_orderkey").cast("string")).alias("title"), F.concat(F.lit("text "), F.col("o_totalprice").cast("decimal(18,2)").cast("string")).alias("text"))
    f = facts(spark, sf).withColumn("answer", F.col("ord") % 60)
    return C.policy_context(law, f.withColumn("n", F.row_number().over(Window.partitionBy("answer").orderBy("ord"))), "answer")


MARKDOWN = "'# Query: ' || indicator || '?' || chr(10) || chr(10) || '## Answer' || chr(10) || district || chr(10) || chr(10) || '## Legal Chain' || chr(10) || 'Act: A' || chr(10) || chr(10) || '## Citations' || chr(10) || chr(10) || CASE WHEN ord % 2 = 0 THEN '1. ' || source_document || chr(10) || '2. ' || fact_id || chr(10) ELSE '' END || chr(10) || '## Metadata' || chr(10) || '- Confidence: ' || printf('%.2f%%', 100 * confidence_score) || chr(10) || '- Processing Time: ' || printf('%.2fs', (ord % 7) / 4.0::DOUBLE) || chr(10) || '- Method: hybrid' || CASE WHEN ord % 2 = 1 THEN chr(10) || chr(10) || '⚠️ **Warnings:**' || chr(10) || '- No citations provided - response may be unreliable' ELSE '' END"


@query(f"SELECT fact_id, md5({MARKDOWN}) AS markdown FROM {{facts}} f")
def export_response(spark: SparkSession, sf: str) -> DataFrame:
    none = F.array().cast("array<string>")
    found = F.when(F.col("ord") % 2 == 0, F.array("source_document", "fact_id")).otherwise(none)
    _, warning = C.validated(found)
    text = C.markdown(F.concat("indicator", F.lit("?")), F.col("district"), F.lit("Act: A"), found, F.col("confidence_score"), (F.col("ord") % 7) / F.lit(4.0), F.lit("hybrid"), F.array_compact(F.array(warning)))
    return facts(spark, sf).select("fact_id", F.md5(text.cast("binary")).alias("markdown"))


@query("SELECT fact_id, ord % 2 = 0 AS valid, CASE WHEN ord % 2 = 1 THEN '" + C.NO_CITATIONS + "' END AS warning FROM {facts} f")
def pol_validate(spark: SparkSession, sf: str) -> DataFrame:
    valid, warning = C.validated(F.when(F.col("ord") % 2 == 0, F.array("source_document")).otherwise(F.array().cast("array<string>")))
    return facts(spark, sf).select("fact_id", valid.alias("valid"), warning.alias("warning"))


@query("SELECT fact_id AS data_id, lower(split_part(source_document, '_', 1)) AS source, indicator, printf('%.2f', value) AS value, unit, district, year, category, source_document, source_page AS page_number, confidence_score AS confidence, indicator || ': ' || printf('%.2f', value) || ' ' || unit || ' (' || district || ', ' || year || ')' AS text FROM {facts} f")
def export_vector_rec(spark: SparkSession, sf: str) -> DataFrame:
    return C.vector_record(facts(spark, sf))


@query("SELECT fact_id, indicator, CASE WHEN district LIKE 'NATION%' THEN 'Unknown' ELSE district END AS place, year, value, unit, 0.9::DOUBLE AS confidence FROM " + FV + " WHERE contains(lower(content), 'dropout guntur') OR contains(lower(indicator), 'dropout guntur') OR contains(lower(content), 'dropout') OR contains(lower(content), 'guntur')")
def demo_search(spark: SparkSession, sf: str) -> DataFrame:
    """Facts whose text or indicator holds the whole question, or whose text holds one of its words."""
    from ..functions.vocabulary import DISTRICTS

    asked_for = "Dropout Guntur".lower()
    content = F.lower(T.fact_content())
    hit = content.contains(asked_for) | F.lower("indicator").contains(asked_for)
    for w in asked_for.split():
        hit = hit | content.contains(w)
    place = F.when(F.col("district").isin(DISTRICTS), F.col("district")).otherwise("Unknown")
    return facts(spark, sf).where(hit).select("fact_id", "indicator", place.alias("place"), "year", "value", "unit", F.lit(0.9).alias("confidence"))


@query("SELECT fact_id, related, 'same indicator' AS relation FROM (SELECT a.fact_id, b.fact_id AS related FROM {facts} a JOIN {facts} b ON a.indicator = b.indicator AND a.district <> b.district AND a.year = b.year WHERE a.district = 'Guntur' AND a.year = 2018)")
def demo_related(spark: SparkSession, sf: str) -> DataFrame:
    f = facts(spark, sf)
    mine = f.where("district = 'Guntur' AND year = 2018").select("fact_id", "indicator", "year")
    other = f.where("district <> 'Guntur'").select("indicator", "year", F.col("fact_id").alias("related"))
    return mine.join(other, ["indicator", "year"]).select("fact_id", "related", F.lit("same indicator").alias("relation"))
