"""Queries of sources and sinks read back, registries, fuzzy names, tables, groups, stores and entity strategies."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import similarity
from ..functions import vocabulary as V
from ..operators import aggregates as A
from ..operators import documents as D
from ..operators import entities as E
from ..operators import filters as P
from ..operators import legal as L
from ..operators import maintenance as M
from ..operators import normalise as N
from ..operators import registry as G
from ..operators import scoring as S
from ..operators import tables as B
from ..operators import validation as C
from ..operators import windows as W
from ..sources import files, sinks
from ..sources.facts import FACT_SCHEMA, facts, table
from ..sources.tables import folder, kept
from .documentary import GO, SIDES, go_texts
from .registry import query
from .relational import AS_OF, DOC_TYPE
from .structured import BRIDGES, KNOWN, bridge_rows
from .textual import ASKED, ENT, SHIFTED, asked, shifted

FACT_COLUMNS = ", ".join(FACT_SCHEMA.fieldNames())


@query("SELECT a.fact_id, count(*) AS peers, round(sum(b.value::DECIMAL(28, 2))::DOUBLE / count(*), 6) AS mean, round(stddev_pop(b.value), 6) AS deviation, round(quantile_cont(b.value, 0.25), 6) AS q1, round(quantile_cont(b.value, 0.75), 6) AS q3 FROM {facts} a JOIN {facts} b ON a.indicator = b.indicator AND a.year = b.year AND a.district <> b.district GROUP BY 1 HAVING count(*) >= 3")
def win_peer_stats(spark: SparkSession, sf: str) -> DataFrame:
    stats = C.peer_statistics(kept(facts(spark, sf)))
    return stats.select("fact_id", "peers", *[F.round(c, 6).alias(c) for c in ("mean", "deviation", "q1", "q3")])


@query("SELECT indicator || '_' || district AS key, count(*) AS n, string_agg(fact_id, ',' ORDER BY ord) AS members FROM {facts} f GROUP BY 1")
def grp_indicator_temporal(spark: SparkSession, sf: str) -> DataFrame:
    return A.grouped(facts(spark, sf), ["indicator", "district"])


@query(f"SELECT {DOC_TYPE} AS key, count(*) AS n, string_agg(fact_id, ',' ORDER BY ord) AS members FROM {{facts}} f GROUP BY 1")
def grp_policy(spark: SparkSession, sf: str) -> DataFrame:
    return A.grouped(facts(spark, sf).withColumn("kind", A.document_type(F.col("source_document"))), ["kind"])


@query("SELECT indicator AS key, count(*) AS n, string_agg(fact_id, ',' ORDER BY ord) AS members FROM {facts} f GROUP BY 1")
def grp_relevance(spark: SparkSession, sf: str) -> DataFrame:
    return A.grouped(facts(spark, sf), ["indicator"])


BANK = f"(SELECT fact_id AS id, q AS query, ['legal', 'data', 'combined', 'temporal', 'comparative'][(ord % 5 + 1)::INT] AS category, ['easy', 'medium', 'hard'][(ord % 3 + 1)::INT] AS difficulty FROM {ASKED})"


def bank(spark: SparkSession, sf: str) -> DataFrame:
    pick = lambda names: F.get(F.array(*map(F.lit, names)), (F.col("ord") % len(names)).cast("int"))
    return asked(spark, sf).select(F.col("fact_id").alias("id"), F.col("q").alias("query"), pick(["legal", "data", "combined", "temporal", "comparative"]).alias("category"), pick(["easy", "medium", "hard"]).alias("difficulty"))


@query(f"SELECT 'id' AS by, id, query FROM {BANK} WHERE id = 'F03_2_2018' UNION ALL SELECT 'category', id, query FROM {BANK} WHERE category = 'temporal' UNION ALL SELECT 'difficulty', id, query FROM {BANK} WHERE difficulty = 'hard' UNION ALL SELECT 'both', id, query FROM {BANK} WHERE category = 'legal' AND difficulty = 'easy'")
def tq_filter(spark: SparkSession, sf: str) -> DataFrame:
    b = bank(spark, sf)
    each = [("id", P.bank_filter(b, id="F03_2_2018")), ("category", P.bank_filter(b, category="temporal")), ("difficulty", P.bank_filter(b, difficulty="hard")), ("both", P.bank_filter(b, category="legal", difficulty="easy"))]
    parts = [rows.select(F.lit(n).alias("by"), "id", "query") for n, rows in each]
    return parts[0].union(parts[1]).union(parts[2]).union(parts[3])


METHODS = "['camelot_stream', 'ocr_tesseract', 'pdfplumber'][(source_page % 3 + 1)::INT]"


@query(f"SELECT method, n, round(mean, 6) AS mean, documents, items, round(confidence, 6) AS confidence, CASE WHEN confidence >= 0.95::DOUBLE THEN 'passed' ELSE 'warning' END AS status FROM (SELECT {METHODS} AS method, count(*) AS n, avg(confidence_score) AS mean FROM {{facts}} f GROUP BY 1), (SELECT count(DISTINCT source_document) AS documents, count(*) AS items, avg(confidence_score) AS confidence FROM {{facts}} f)")
def agg_extraction_metrics(spark: SparkSession, sf: str) -> DataFrame:
    method = F.get(F.array(*map(F.lit, ("camelot_stream", "ocr_tesseract", "pdfplumber"))), F.col("source_page") % 3)
    items = facts(spark, sf).select(F.col("source_document").alias("doc_id"), method.alias("method"), F.col("confidence_score").alias("confidence"))
    return A.extraction_metrics(items).withColumns({c: F.round(c, 6) for c in ("mean", "confidence")})


@query(f"SELECT store, n, round(n / a, 6) AS share, n / a >= 0.98::DOUBLE AS consistent FROM (SELECT 'relational' AS store, count(*) AS n FROM {{facts}} f UNION ALL SELECT 'graph', count(*) FROM {{facts}} f WHERE district IN ({KNOWN})), (SELECT count(*) AS a FROM {{facts}} f)")
def agg_consistency(spark: SparkSession, sf: str) -> DataFrame:
    f = facts(spark, sf)
    stores = [("normalised", f), ("relational", f), ("graph", f.where(F.col("district").isin(V.DISTRICTS)))]
    counts = [rows.agg(F.count(F.lit(1)).alias("n")).select(F.lit(n).alias("store"), "n") for n, rows in stores]
    return A.consistency(counts[0].union(counts[1]).union(counts[2]), "normalised").withColumn("share", F.round("share", 6))


@query("SELECT o_custkey AS run, CASE WHEN bool_and(o_orderstatus = 'F') THEN 'passed' WHEN bool_or(o_orderstatus = 'P') THEN 'failed' ELSE 'warning' END AS overall FROM orders GROUP BY 1")
def agg_stage_status(spark: SparkSession, sf: str) -> DataFrame:
    s = F.col("o_orderstatus")
    stages = table(spark, sf, "orders").select(F.col("o_custkey").alias("run"), F.when(s == "F", "passed").when(s == "P", "failed").otherwise("warning").alias("status"))
    return A.overall_status(stages, "run")


@query("SELECT source_document AS doc_id, arg_min(year, ord) AS year, arg_min(source_page, ord) AS total_pages, arg_min(district, ord) AS district FROM {facts} f GROUP BY 1")
def sink_vector_docs(spark: SparkSession, sf: str) -> DataFrame:
    one = W.first_match(facts(spark, sf), ["source_document"], ["ord"])
    return one.select(F.col("source_document").alias("doc_id"), "year", F.col("source_page").alias("total_pages"), "district")


SAMPLE = "(SELECT string_agg({1}, ',' ORDER BY {1}) FROM (SELECT {1} FROM {0} ORDER BY {1} LIMIT 3))"


@query(f"SELECT 'facts' AS store, count(*) AS n, {SAMPLE.format('{facts} g', 'fact_id')} AS sample FROM {{facts}} f UNION ALL SELECT 'documents', count(DISTINCT source_document), {SAMPLE.format('(SELECT DISTINCT source_document FROM {facts} h) g', 'source_document')} FROM {{facts}} f UNION ALL SELECT 'bridges', count(*), {SAMPLE.format(f'({BRIDGES}) g', 'bridge_id')} FROM ({BRIDGES}) b")
def sum_store(spark: SparkSession, sf: str) -> DataFrame:
    f = facts(spark, sf)
    return A.store_summary(f, "facts", "fact_id").union(A.store_summary(f.select("source_document").distinct(), "documents", "source_document")).union(A.store_summary(bridge_rows(spark, sf), "bridges", "bridge_id"))


@query("SELECT (SELECT count(DISTINCT district) + count(DISTINCT indicator) + count(DISTINCT year) + count(DISTINCT source_document) FROM {facts} f) AS nodes, (SELECT 4 * count(*) FROM {facts} f) AS edges, CASE WHEN (SELECT count(*) FROM {facts} f) > 0 THEN 'passed' ELSE 'failed' END AS status")
def val_graph(spark: SparkSession, sf: str) -> DataFrame:
    f = facts(spark, sf)
    return A.graph_status(sinks.star_nodes(f), sinks.star_edges(f))


@query(f"SELECT {FACT_COLUMNS} FROM {{facts}} f")
def sink_json(spark: SparkSession, sf: str) -> DataFrame:
    """Facts written as JSON lines and read again by the schema of facts."""
    where = folder(spark, "facts-json")
    sinks.write_facts(facts(spark, sf), where, "json")
    return spark.read.schema(FACT_SCHEMA).json(where)


@query(f"SELECT {FACT_COLUMNS} FROM {{facts}} f")
def scan_facts_json(spark: SparkSession, sf: str) -> DataFrame:
    """A JSON array of all facts in one file, read by byte ranges."""
    where = folder(spark, "facts-array")
    f = facts(spark, sf)
    lines = f.select("ord", F.to_json(F.struct(*FACT_SCHEMA.fieldNames())).alias("value")).join(F.broadcast(f.agg(F.min("ord").alias("first"))))
    lines = lines.select("ord", F.concat(F.when(F.col("ord") == F.col("first"), "").otherwise(", "), "value").alias("value"))
    ends = spark.createDataFrame([(-1, "["), ((1 << 62), "]")], "ord long, value string")
    lines.union(ends).repartition(1).sortWithinPartitions("ord").select("value").write.mode("overwrite").text(where)
    return files.facts_json(spark, where)


@query("SELECT source_document, count(*) AS n, sum(value::DECIMAL(28, 2)) AS total FROM {facts} f GROUP BY 1")
def scan_json_items(spark: SparkSession, sf: str) -> DataFrame:
    """One JSON object of lists by document, as extraction leaves it, read as tagged items."""
    where = folder(spark, "items")
    lists = facts(spark, sf).groupBy("source_document").agg(F.collect_list(F.struct("fact_id", "value")).alias("items"))
    lists.agg(F.to_json(F.map_from_entries(F.collect_list(F.struct("source_document", "items")))).alias("value")).write.mode("overwrite").text(where)
    items = files.json_items(spark, where, "fact_id: string, value: double")
    return items.groupBy("source_document").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("value").cast("decimal(28,2)")).alias("total"))


@query("SELECT district, indicator, value, year FROM {facts} f")
def scan_csv(spark: SparkSession, sf: str) -> DataFrame:
    """A CSV file whose columns are told by words in their names."""
    where = folder(spark, "statistics")
    named = facts(spark, sf).select(F.col("district").alias("Dist Name"), F.col("indicator").alias("Metric"), F.col("value").alias("Total Value"), F.col("year").alias("Academic_Year"))
    named.write.mode("overwrite").option("header", True).csv(where)
    return files.statistics_csv(spark, where)


@query("SELECT doc_id // 50 AS file, md5(string_agg(replace(text, chr(10), ' '), chr(10) ORDER BY doc_id)) AS hash FROM documents WHERE text IS NOT NULL AND trim(text) <> '' GROUP BY 1")
def scan_txt(spark: SparkSession, sf: str) -> DataFrame:
    """Whole text files, of the texts of fifty ids each."""
    where = folder(spark, "texts")
    docs = table(spark, sf, "documents").where("text is not null and trim(text) <> ''").withColumn("file", F.floor(F.col("doc_id") / 50))
    flat = docs.select("file", "doc_id", F.translate("text", "\n", " ").alias("value")).repartition("file").sortWithinPartitions("file", "doc_id")
    flat.select("file", "value").write.mode("overwrite").partitionBy("file").text(where)
    read = files.texts(spark, f"{where}/*")
    return read.select(F.regexp_extract("path", "file=([0-9]+)", 1).cast("long").alias("file"), F.md5(F.regexp_replace("text", "\n$", "").cast("binary")).alias("hash"))


@query("SELECT n_nationkey, md5(n_name || chr(10)) AS hash FROM nation")
def scan_all_pdfs(spark: SparkSession, sf: str) -> DataFrame:
    """All files of the known kinds below a folder, hashed in parallel by file; a file of another kind is passed over."""
    where = folder(spark, "files")
    n = table(spark, sf, "nation").select("n_nationkey", F.col("n_name").alias("value"))
    n.repartition("n_nationkey").write.mode("overwrite").partitionBy("n_nationkey").text(f"{where}/txt")
    n.coalesce(1).write.mode("overwrite").parquet(f"{where}/other")
    return files.hashed_files(spark, where).select(F.regexp_extract("key", "n_nationkey=([0-9]+)", 1).cast("int").alias("n_nationkey"), "hash")


@query(f"SELECT 'absent' AS index, 0 AS n, {len(files.INDEX_COLUMNS)} AS columns UNION ALL SELECT 'present', (SELECT count(*) FROM nation), 2")
def scan_corpus_index(spark: SparkSession, sf: str) -> DataFrame:
    where = folder(spark, "index")
    table(spark, sf, "nation").select(F.col("n_nationkey").alias("doc_id"), F.col("n_name").alias("title")).write.mode("overwrite").option("header", True).csv(where)
    parts = [(n, files.corpus_index(spark, p)) for n, p in (("absent", f"{where}-absent"), ("present", where))]
    each = [rows.agg(F.count(F.lit(1)).cast("int").alias("n")).select(F.lit(n).alias("index"), "n", F.lit(len(rows.columns)).alias("columns")) for n, rows in parts]
    return each[0].union(each[1])


@query("SELECT fact_id, confidence_score FROM {facts} f")
def scan_vector_all(spark: SparkSession, sf: str) -> DataFrame:
    """All facts of the vector store, without the cap of a thousand."""
    return sinks.vector_rows(facts(spark, sf)).select("fact_id", "confidence_score")


DEMO = "SELECT 'n' || n_nationkey AS id, n_name AS name, 'district' AS kind FROM nation UNION ALL SELECT 'r' || r_regionkey, r_name, 'region' FROM region"


@query(DEMO)
def scan_demo_graph(spark: SparkSession, sf: str) -> DataFrame:
    """The offline graph: a JSON file of its nodes, read as rows."""
    where = folder(spark, "demo-graph")
    n, r = table(spark, sf, "nation"), table(spark, sf, "region")
    nodes = n.select(F.concat(F.lit("n"), "n_nationkey").alias("id"), F.col("n_name").alias("name"), F.lit("district").alias("kind")).union(r.select(F.concat(F.lit("r"), "r_regionkey"), "r_name", F.lit("region")))
    nodes.write.mode("overwrite").json(where)
    return spark.read.schema("id string, name string, kind string").json(where)


@query("SELECT fact_id, coalesce(category, 'Unknown') AS category, value FROM {facts} f")
def sink_vector_facts(spark: SparkSession, sf: str) -> DataFrame:
    return sinks.vector_rows(facts(spark, sf)).select("fact_id", "category", "value")


@query(f"SELECT bridge_type, bridge_id, len(fact_ids) AS n FROM ({BRIDGES})")
def load_bridges(spark: SparkSession, sf: str) -> DataFrame:
    """Bridges of all types, written by type and read back."""
    where = folder(spark, "bridges")
    sinks.write_bridges(bridge_rows(spark, sf), where)
    return sinks.load_bridges(spark, where).select("bridge_type", "bridge_id", F.size("fact_ids").cast("long").alias("n"))


@query(f"SELECT bridge_type, count(*) AS n FROM ({BRIDGES}) GROUP BY 1")
def sink_bridge_json(spark: SparkSession, sf: str) -> DataFrame:
    where = folder(spark, "bridge-index")
    sinks.write_bridges(bridge_rows(spark, sf), where)
    return spark.read.schema("bridge_type string, n long").json(f"{where}/index")


@query(f"SELECT 'bridge' AS class, bridge_id AS id, 'Bridge type: ' || bridge_type || ' | Facts: ' || len(fact_ids) AS content FROM ({BRIDGES}) UNION ALL SELECT 'fact', fact_id, coalesce(category, 'Unknown') FROM {{facts}} f")
def sink_vector_bridge(spark: SparkSession, sf: str) -> DataFrame:
    where = folder(spark, "vector-bridges")
    sinks.write_bridge_vectors(facts(spark, sf), bridge_rows(spark, sf), where)
    made = spark.read.parquet(f"{where}/bridges").select(F.lit("bridge").alias("class"), F.col("bridge_id").alias("id"), "content")
    return made.union(spark.read.parquet(f"{where}/facts").select(F.lit("fact"), "fact_id", "category"))


@query("SELECT 'node' AS part, kind, count(*) AS n FROM (SELECT DISTINCT 'district' AS kind, district AS name FROM {facts} f UNION ALL SELECT DISTINCT 'indicator', indicator FROM {facts} f UNION ALL SELECT DISTINCT 'year', year::VARCHAR FROM {facts} f UNION ALL SELECT DISTINCT 'source', source_document FROM {facts} f) GROUP BY 2 UNION ALL SELECT 'edge', unnest(['MEASURED_BY', 'LOCATED_IN', 'OBSERVED_IN', 'REPORTED_BY']), (SELECT count(*) FROM {facts} f)")
def sink_graph_export(spark: SparkSession, sf: str) -> DataFrame:
    where = folder(spark, "graph")
    sinks.write_graph(facts(spark, sf), where)
    parts = [spark.read.parquet(f"{where}/{p}s").groupBy("kind").agg(F.count(F.lit(1)).alias("n")).select(F.lit(p).alias("part"), "kind", "n") for p in ("node", "edge")]
    return parts[0].union(parts[1])


@query("SELECT fact_id, year, value FROM {facts} f WHERE district <> '' AND value <> 0")
def sink_educationfact(spark: SparkSession, sf: str) -> DataFrame:
    """Facts that pass the loader's tests, prepared, written and read back."""
    where = folder(spark, "education-facts")
    P.prepared_facts(P.truthy_facts(facts(spark, sf))).write.mode("overwrite").parquet(where)
    return spark.read.parquet(where).select("fact_id", "year", "value")


@query("SELECT count(*) AS facts, round(avg(confidence_score), 6) AS confidence FROM {facts} f")
def sink_report_json(spark: SparkSession, sf: str) -> DataFrame:
    where = folder(spark, "report")
    sinks.write_report(facts(spark, sf).agg(F.count(F.lit(1)).alias("facts"), F.round(F.avg("confidence_score"), 6).alias("confidence")), where)
    return spark.read.schema("facts long, confidence double").json(where)


@query("SELECT 'districts: ' || count(DISTINCT district) AS line FROM {facts} f UNION ALL SELECT 'facts: ' || count(*) FROM {facts} f")
def sink_report_txt(spark: SparkSession, sf: str) -> DataFrame:
    where, f = folder(spark, "report-text"), facts(spark, sf)
    lines = f.agg(F.concat(F.lit("facts: "), F.count(F.lit(1)).cast("string")).alias("line")).select(F.lit(1).alias("n"), "line").union(f.agg(F.concat(F.lit("districts: "), F.countDistinct("district").cast("string")).alias("line")).select(F.lit(2), "line"))
    sinks.write_text_report(lines, where)
    return spark.read.text(where).withColumnRenamed("value", "line")


@query("SELECT doc_id AS key, md5(text) AS hash, CASE WHEN doc_id % 7 = 0 THEN 'failed' ELSE 'processed' END AS status, CASE WHEN doc_id % 3 = 0 AND doc_id % 7 <> 0 THEN 2 ELSE 1 END AS run FROM documents WHERE text IS NOT NULL")
def sink_state(spark: SparkSession, sf: str) -> DataFrame:
    """The tracker: a second run replaces the rows of changed files; failed ones keep their hash and aren't tried again."""
    where = folder(spark, "tracker")
    key = F.col("key")
    docs = table(spark, sf, "documents").where("text is not null").select(F.col("doc_id").alias("key"), F.md5(F.col("text").cast("binary")).alias("hash"))
    first = docs.withColumn("hash", F.when((key % 3 == 0) & (key % 7 != 0), "old").otherwise(F.col("hash")))
    status = F.when(key % 7 == 0, M.FAILED).otherwise(M.PROCESSED).alias("status")
    sinks.write_state(first.select("key", "hash", status, F.lit(1).alias("run")), f"{where}/1")
    known = spark.read.parquet(f"{where}/1")
    fresh = files.changed(docs, known)
    sinks.write_state(known.join(fresh.select("key"), "key", "left_anti").unionByName(fresh.select("key", "hash", status, F.lit(2).alias("run"))), f"{where}/2")
    return spark.read.parquet(f"{where}/2")


@query(f"SELECT bridge_type, bridge_id, array_to_string(list_sort(fact_ids), ',') AS fact_ids FROM ({BRIDGES.replace('{facts}', "(SELECT * FROM {facts} x WHERE NOT (source_document LIKE '%2016%' OR source_document LIKE 'cse%2017%'))")})")
def sink_bridges_incremental(spark: SparkSession, sf: str) -> DataFrame:
    """Bridges after three runs over files of facts: all come, some change while one fails, one goes."""
    # the runs read the facts many times, and each time would join and sum the sales again
    f = kept(facts(spark, sf).select(F.col("source_document").alias("key"), "fact_id", "district", "indicator", "year"))
    gone, bad = F.col("key").contains("2016"), F.col("key").startswith("cse") & F.col("key").contains("2017")
    names = f.select("key").distinct()
    hashed = lambda run: names.select("key", F.concat("key", F.when(F.col("key").contains("2018"), F.lit(run)).otherwise(F.lit(0)).cast("string")).alias("hash"))
    failed = names.where(bad)
    state = M.updated(M.first_state(f), hashed(1), f.where(~F.col("key").contains("2018") | (F.col("fact_id") < "F1")), failed, 1)
    state = M.updated(state, hashed(2), f, failed.where("false"), 2)
    state = M.updated(state, hashed(2).where(~gone), f.where(~gone), failed, 3)
    return state.bridges.select("bridge_type", "bridge_id", F.array_join("fact_ids", ",").alias("fact_ids"))


LINKED = "SELECT a.dataset || ':' || a.entity_id AS source, b.dataset || ':' || b.entity_id AS target FROM (SELECT DISTINCT dataset, entity_id FROM {e}) a JOIN (SELECT DISTINCT dataset, entity_id FROM {e}) b ON a.entity_id = b.entity_id AND a.dataset < b.dataset".format(e=ENT)


@query(f"SELECT 'node' AS part, dataset || ':' || entity_id AS id, '' AS target FROM (SELECT DISTINCT dataset, entity_id FROM {ENT}) UNION ALL SELECT 'edge', source, target FROM ({LINKED})")
def sink_graph_entities(spark: SparkSession, sf: str) -> DataFrame:
    where, e = folder(spark, "entities"), E.merged(E.extracted(facts(spark, sf)))
    pairs = E.matched(e, F.col("entity_id"), "exact", 95).select(F.concat_ws(":", "a.dataset", "a.entity_id").alias("source"), F.concat_ws(":", "b.dataset", "b.entity_id").alias("target"), "kind", (F.col("c") / 100).alias("confidence"))
    sinks.write_entities(e, pairs, where)
    nodes, edges = spark.read.parquet(f"{where}/nodes"), spark.read.parquet(f"{where}/edges")
    return nodes.select(F.lit("node").alias("part"), "id", F.lit("").alias("target")).union(edges.select(F.lit("edge"), "source", "target"))


#: file: table, and its fields by column
REGISTERED = {
    "in/nation.csv": ("nation", {"District": "n_name", "School Code": "n_nationkey"}),
    "in/orders.json": ("orders", {"o_orderkey": "o_orderkey", "Department": "o_orderstatus", "o_totalprice": "o_totalprice", "GO Number": "CAST(o_orderkey AS STRING)", "Circular": "CASE WHEN o_orderkey % 3 = 0 THEN o_orderpriority END"}),
    "customer.pdf": ("customer", {"District": "c_mktsegment", "c_name": "c_name", "c_acctbal": "c_acctbal", "c_custkey": "c_custkey"}),
    "documents.txt": ("documents", {"doc_id": "doc_id", "Department": "lang", "text": "text"}),
    "pages.xlsx": ("pages", {"page_id": "page_id", "Date": "'2020/01/0' || CAST(page_id % 9 AS STRING)"}),
}


def records(spark: SparkSession, sf: str) -> DataFrame:
    """Records of five files, one JSON object each."""
    each = [table(spark, sf, name).select(F.lit(path).alias("path"), F.to_json(F.struct(*[F.expr(c).alias(f) for f, c in fields.items()])).alias("json")) for path, (name, fields) in REGISTERED.items()]
    return reduce(DataFrame.union, each)


def sql_kind(c: str) -> str:
    text = f"CASE WHEN count({c}) = 0 THEN 'unknown' WHEN bool_and(regexp_full_match({c}::VARCHAR, '[0-9]+')) THEN 'string_numeric' WHEN bool_and(NOT regexp_full_match({c}::VARCHAR, '[0-9]+') AND (contains(lower({c}::VARCHAR), 'date') OR (length({c}::VARCHAR) = 10 AND contains({c}::VARCHAR, '/')))) THEN 'date' ELSE 'string' END"
    return f"CASE WHEN any_value(typeof({c})) IN ('INTEGER', 'BIGINT') THEN 'integer' WHEN any_value(typeof({c})) = 'DOUBLE' THEN 'float' ELSE {text} END"


def sql_of(c: str) -> str:
    return "(" + c.replace("AS STRING", "AS VARCHAR") + ")"


FIELDS = "(" + " UNION ALL ".join(f"SELECT '{path}' AS path, '{f.lower().replace(' ', '_')}' AS field, {sql_kind(sql_of(c))} AS kind, 1 - count({sql_of(c)}) / count(*) AS null_share FROM {name}" for path, (name, fields) in REGISTERED.items() for f, c in fields.items()) + ")"
HELD = "(" + " UNION ALL ".join(f"SELECT '{path}' AS path, lower('{' '.join(fields)} ' || concat_ws(' ', {', '.join(sql_of(c) + '::VARCHAR' for c in fields.values())})) AS low FROM {name}" for path, (name, fields) in REGISTERED.items()) + ")"
KINDS_SQL = "(VALUES " + ", ".join(f"('{e}', '{w}', {i})" for i, (e, ws) in enumerate(G.ENTITY_WORDS.items()) for w in ws) + ") k(entity, word, place)"
ENTITIES = f"(SELECT path, coalesce(e, ['document']) AS entities FROM (SELECT DISTINCT path FROM {FIELDS}) LEFT JOIN (SELECT path, list(entity ORDER BY place) AS e FROM (SELECT DISTINCT path, entity, place FROM {HELD} JOIN {KINDS_SQL} ON contains(low, word)) GROUP BY 1) USING (path))"
BRIDGED = f"(SELECT path, coalesce(string_agg(field, ',' ORDER BY field) FILTER (WHERE " + " OR ".join(f"contains(field, '{b}')" for b in G.BRIDGES) + f"), '') AS bridges FROM {FIELDS} GROUP BY 1)"
SUFFIXED = "CASE regexp_extract(path, '[.]([a-z]+)$', 1) WHEN 'csv' THEN 'csv' WHEN 'json' THEN 'json' WHEN 'pdf' THEN 'pdf' WHEN 'xlsx' THEN 'excel' ELSE 'unknown' END"
TABULAR = f"(SELECT path, bool_or(contains(low, 'table') OR len(string_split(low, chr(10))) > 20) AS tabular FROM {HELD} GROUP BY 1)"
METHODS = f"(SELECT path, CASE {SUFFIXED} WHEN 'pdf' THEN CASE WHEN tabular THEN 'table_extraction' ELSE 'nlp_extraction' END WHEN 'unknown' THEN 'nlp_extraction' ELSE 'structured' END AS method FROM {TABULAR})"
NAMES = f"(SELECT path, array_to_string(list_prepend(regexp_extract(path, '([^/]+)[.][a-z]+$', 1), list_sort(entities)[1:2]), '_') AS name FROM {ENTITIES})"
PROFILES = f"SELECT path, name, {SUFFIXED} AS source_type, array_to_string(entities, ',') AS entities, fields, bridges, method FROM {ENTITIES} JOIN {NAMES} USING (path) JOIN {BRIDGED} USING (path) JOIN {METHODS} USING (path) JOIN (SELECT path, string_agg(field || ':' || kind, ',' ORDER BY field || ':' || kind) AS fields FROM {FIELDS} GROUP BY 1) USING (path)"


def flat(df: DataFrame, **arrays: str) -> DataFrame:
    return df.withColumns({c: F.array_join(c, ",") for c in arrays}).withColumnsRenamed(arrays)


def profiles(spark: SparkSession, sf: str) -> DataFrame:
    return flat(G.profiled(records(spark, sf)), entity_types="entities", fields="fields", bridge_potential="bridges")


@query(PROFILES)
def fn_auto_schema(spark: SparkSession, sf: str) -> DataFrame:
    """What the registry infers of five files from their names and all their records."""
    return profiles(spark, sf)


@query(f"SELECT path, field, kind, round(null_share, 9) AS null_share FROM {FIELDS}")
def reg_key_fields(spark: SparkSession, sf: str) -> DataFrame:
    return G.field_profiles(records(spark, sf)).withColumn("null_share", F.round("null_share", 9))


@query(f"SELECT kind, count(*) AS fields FROM {FIELDS} GROUP BY 1")
def fn_infer_type(spark: SparkSession, sf: str) -> DataFrame:
    return G.field_profiles(records(spark, sf)).groupBy("kind").agg(F.count(F.lit(1)).alias("fields"))


@query(f"SELECT path, array_to_string(entities, ',') AS entities FROM {ENTITIES}")
def fn_detect_entities(spark: SparkSession, sf: str) -> DataFrame:
    return profiles(spark, sf).select("path", "entities")


@query(f"SELECT * FROM {BRIDGED}")
def fn_bridge_fields(spark: SparkSession, sf: str) -> DataFrame:
    return profiles(spark, sf).select("path", "bridges")


@query(f"SELECT * FROM {METHODS}")
def fn_extraction_method(spark: SparkSession, sf: str) -> DataFrame:
    return profiles(spark, sf).select("path", "method")


@query(f"SELECT * FROM {NAMES}")
def fn_schema_name(spark: SparkSession, sf: str) -> DataFrame:
    return profiles(spark, sf).select("path", "name")


@query(PROFILES)
def reg_load(spark: SparkSession, sf: str) -> DataFrame:
    """The registry's whole records, saved and loaded again."""
    where = folder(spark, "registry")
    G.save(G.profiled(records(spark, sf)), where)
    return flat(G.load(spark, where), entity_types="entities", fields="fields", bridge_potential="bridges")


@query(f"SELECT a.path AS a, b.path AS b, string_agg(field, ',' ORDER BY field) AS fields FROM (SELECT path, unnest(string_split(bridges, ',')) AS field FROM {BRIDGED}) a JOIN (SELECT path, unnest(string_split(bridges, ',')) AS field FROM {BRIDGED}) b USING (field) WHERE a.path < b.path AND field <> '' GROUP BY 1, 2")
def join_schema_compat(spark: SparkSession, sf: str) -> DataFrame:
    """Files whose inferred fields can bridge them."""
    return G.compatible(G.profiled(records(spark, sf)).select(F.col("path").alias("name"), "bridge_potential"))


def variants(names: DataFrame, name: str) -> DataFrame:
    """Each name in ten spellings, from its own to ones that no rule should take for it."""
    n = F.col(name)
    cut = lambda k: F.substr(n, F.lit(1), F.greatest(F.lit(1), F.length(n) - k))
    each = [n, F.concat(F.lit(" "), F.upper(n), F.lit(" ")), cut(1), cut(2), cut(4), F.concat(F.substr(n, F.lit(1), F.lit(2)), F.lit("q"), F.substr(n, F.lit(4))), F.concat(n, F.lit(" District")), F.concat(F.lit("the rate of "), n, F.lit(" in all schools")), F.reverse(n), F.array_join(F.reverse(F.split(n, " ")), "  ")]
    return names.select(F.explode(F.array(*each)).alias("typed")).distinct()


def typed(spark: SparkSession, sf: str) -> DataFrame:
    return variants(facts(spark, sf).select("district").distinct(), "district")


def mistyped(spark: SparkSession, sf: str) -> DataFrame:
    return variants(facts(spark, sf).select("indicator").distinct(), "indicator")


def exactly(names: list[str]) -> dict[str, list[str]]:
    return {n: [n.lower()] for n in names}


INDICATORS = [r[0] for r in V.RANGES]


@query()
def fn_norm_district_s2(spark: SparkSession, sf: str) -> DataFrame:
    """The name of the best weighted ratio over 80, else Unknown."""
    found = N.fuzzy(typed(spark, sf), "typed", exactly(V.DISTRICTS), "name", similarity.weighted_ratio, 81)
    return found.select("typed", F.coalesce("name", F.lit("Unknown")).alias("name"))


@query()
def fn_norm_district_enh(spark: SparkSession, sf: str) -> DataFrame:
    """The name of the best ratio of parts from 80 on."""
    return N.fuzzy(typed(spark, sf), "typed", exactly(V.DISTRICTS), "name", similarity.partial_ratio, 80).select("typed", "name")


@query()
def fn_norm_district_dp(spark: SparkSession, sf: str) -> DataFrame:
    """A ratio from 85 on with the canonical names; equal ratios go to the earlier name."""
    return N.fuzzy(typed(spark, sf), "typed", exactly(V.DISTRICTS), "name", similarity.ratio, 85).select("typed", "name")


@query()
def fn_norm_indicator_s2(spark: SparkSession, sf: str) -> DataFrame:
    """The name of the best weighted ratio over 70, else Unknown."""
    found = N.fuzzy(mistyped(spark, sf), "typed", exactly(INDICATORS), "name", similarity.weighted_ratio, 71)
    return found.select("typed", F.coalesce("name", F.lit("Unknown")).alias("name"))


@query()
def fn_norm_indicator_enh(spark: SparkSession, sf: str) -> DataFrame:
    """The name of the best ratio of parts from 70 on."""
    return N.fuzzy(mistyped(spark, sf), "typed", exactly(INDICATORS), "name", similarity.partial_ratio, 70).select("typed", "name")


@query("SELECT doc_id, 1990 + doc_id % 40 AS year FROM documents")
def fn_year_dp(spark: SparkSession, sf: str) -> DataFrame:
    y = 1990 + F.col("doc_id") % 40
    text = F.when(F.col("doc_id") % 2 == 0, F.concat(F.lit("Report 12/"), y.cast("string"), F.lit(" v20181"))).otherwise(F.concat(F.lit("AY "), y.cast("string"), F.lit("-"), F.lpad((F.pmod(y + 1, F.lit(100))).cast("string"), 2, "0")))
    return table(spark, sf, "documents").select("doc_id", N.year_or_span(text).cast("long").alias("year"))


@query(f"SELECT source_document AS doc_id, CASE WHEN y BETWEEN 2010 AND {AS_OF} THEN y ELSE 2023 END AS year FROM (SELECT source_document, arg_min(CASE WHEN year % 4 = 0 THEN 2023 ELSE year END, ord) AS y FROM {{facts}} f GROUP BY 1)")
def fn_year_items(spark: SparkSession, sf: str) -> DataFrame:
    items = facts(spark, sf).select(F.col("source_document").alias("doc_id"), "ord", F.when(F.col("year") % 4 != 0, F.col("year")).alias("year"))
    return N.year_of_items(items, AS_OF)


@query("SELECT n_nationkey, n_nationkey % 4 <> 3 AS is_table FROM nation")
def is_table_data(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("n_nationkey") % 4
    words = F.array(F.lit("a"))
    return table(spark, sf, "nation").select("n_nationkey", P.is_table_item(F.when(k == 0, "ocr_tesseract").otherwise("text"), F.when(k == 1, words), F.when(k == 9, F.array(words)), F.when(k == 2, "T1")).alias("is_table"))


@query("SELECT n_nationkey, CASE n_nationkey % 4 WHEN 0 THEN 1 WHEN 1 THEN 0 WHEN 2 THEN 2 END AS place FROM nation")
def find_district_col_enh(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("n_nationkey") % 4
    headers = F.array(F.when(k == 1, "Region").otherwise("Sl No"), F.when(k == 0, "Dist.").otherwise("Total"), F.when(k == 2, "Pupils in Guntur").otherwise("Boys"))
    return table(spark, sf, "nation").select("n_nationkey", P.district_header(headers).alias("place"))


@query("SELECT n_nationkey, CASE WHEN n_nationkey % 3 <> 2 THEN 'District Boys' END AS headers, CASE WHEN n_nationkey % 3 <> 2 THEN 'x ' || n_nationkey END AS rows FROM nation")
def fn_ocr_parse(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("n_nationkey")
    text = F.when(k % 3 == 2, "single\nline two").otherwise(F.concat(F.lit("District  Boys\nnoise\n\nx "), k.cast("string"), F.lit("\n")))
    t = B.ocr_table(text)
    return table(spark, sf, "nation").select("n_nationkey", t.alias("t")).select("n_nationkey", F.array_join("t.headers", " ").alias("headers"), F.array_join(F.flatten("t.rows"), " ").alias("rows"))


@query("SELECT n_nationkey, CASE WHEN n_nationkey % 4 = 0 THEN 'skipped' WHEN n_nationkey % 4 = 3 THEN 'failed' ELSE 'enhanced' END AS outcome, CASE n_nationkey % 4 WHEN 2 THEN 'Indicator|Value_1|Value_2' WHEN 1 THEN 'Name|Count' ELSE '1|2' END AS headers FROM nation")
def tp_enhance(spark: SparkSession, sf: str) -> DataFrame:
    k, s = F.col("n_nationkey") % 4, F.lit
    numbers = F.array(s("1"), s("2"))
    counted = F.array(F.array(s("Boys"), s("10"), s("20")), F.array(s("Girls"), s("7"), s("8")))
    items = table(spark, sf, "nation").select(
        "n_nationkey", F.when(k == 0, "text").otherwise("ocr_tesseract").alias("extraction_method"), F.when(k == 1, F.array(s("Name"), s("Count"))).otherwise(numbers).alias("headers"), F.when(k == 3, F.array(F.array(s("x"), s("y")))).otherwise(counted).alias("rows")
    )
    return B.enhanced(items, "n_nationkey").select("n_nationkey", "outcome", F.array_join("headers", "|").alias("headers"))


@query("SELECT n_nationkey AS table_id, 0 AS row, 'Guntur' AS district, 'Dropout Rate' AS indicator, n_nationkey + 0.5::DOUBLE AS value, 0.9::DOUBLE AS confidence FROM nation")
def fn_table_to_facts_enh(spark: SparkSession, sf: str) -> DataFrame:
    """Tables whose second column holds districts; headers and places that aren't known give no facts."""
    s = F.lit
    known = F.array((F.col("n_nationkey") + s(0.5)).cast("string"), s("GUNTUR"), s("none"), s("4"))
    t = table(spark, sf, "nation").select(F.col("n_nationkey").alias("table_id"), F.array(s("Dropout"), s("District"), s("PTR"), s("No such thing")).alias("headers"), F.array(known, F.array(s("3"), s("Nowhere"), s("4"), s("5"))).alias("rows"))
    return N.resolved_facts(t, P.district_header(F.col("headers")))


@query("SELECT n_nationkey, CASE n_nationkey % 3 WHEN 0 THEN 'structured' WHEN 1 THEN 'text' ELSE 'none' END AS route FROM nation")
def fn_norm_table_route(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("n_nationkey") % 3
    some = F.array(F.lit("a"))
    return table(spark, sf, "nation").select("n_nationkey", N.table_route(some, F.array(some), F.when(k == 0, 2).otherwise(0), F.when(k < 2, "text")).alias("route"))


@query("SELECT 'FCT_' || fact_id || '_1' AS fact_id, 'dropout' AS indicator, value FROM {facts} f WHERE indicator = 'Dropout Rate' UNION ALL SELECT 'FCT_' || fact_id || '_2', 'literacy', year::DOUBLE FROM {facts} f WHERE indicator = 'Dropout Rate'")
def fn_text_to_facts_s2(spark: SparkSession, sf: str) -> DataFrame:
    f = facts(spark, sf).where("indicator = 'Dropout Rate'")
    return N.numbered_facts(f.select(F.col("fact_id").alias("doc_id"), F.concat(F.format_string("%.2f", "value"), F.lit("% dropout, then "), F.col("year").cast("string"), F.lit("% Literacy")).alias("text")))


@query(f"SELECT doc_id, count(*) AS n FROM (SELECT doc_id FROM ({GO}) WHERE district IS NOT NULL UNION ALL SELECT doc_id FROM ({GO})) GROUP BY 1")
def ext_table_entities(spark: SparkSession, sf: str) -> DataFrame:
    """Entities of tables, which are found by reading their text: an order and the district it names, if any."""
    found = D.order_entities(go_texts(spark, sf))
    each = F.explode(F.array_compact(F.array("go_number", "district")))
    return found.select("doc_id", each.alias("e")).groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT n_nationkey, 'a b|Name|12' AS headers FROM nation")
def fn_clean_headers(spark: SparkSession, sf: str) -> DataFrame:
    headers = F.array(F.lit(" a\n  b"), F.lit("Name\t"), F.lit("12"))
    return table(spark, sf, "nation").select("n_nationkey", F.array_join(B.clean_headers(headers), "|").alias("headers"))


@query("SELECT n_nationkey, CASE WHEN n_nationkey % 2 = 0 THEN 'Sl No|' || n_name ELSE 'Sl|No|' || n_name END AS headers, 'x y|3' AS cells FROM nation")
def tp_headers(spark: SparkSession, sf: str) -> DataFrame:
    line = F.concat(F.lit("Sl No"), F.when(F.col("n_nationkey") % 2 == 0, "   ").otherwise(" "), F.col("n_name"))
    return table(spark, sf, "nation").select("n_nationkey", F.array_join(B.headers_of(line), "|").alias("headers"), F.array_join(B.cells_of(F.lit("x y\t3")), "|").alias("cells"))


@query("SELECT n_nationkey, n_nationkey % 4 = 0 AS valid FROM nation")
def tp_validate(spark: SparkSession, sf: str) -> DataFrame:
    k, s = F.col("n_nationkey") % 4, F.lit
    two, one = F.array(s("a"), s("b")), F.array(s("a"))
    t = F.struct(F.when(k == 1, one).otherwise(two).alias("headers"), F.when(k == 2, F.array(one)).when(k == 3, F.array(F.array(s(""), s(" ")))).otherwise(F.array(two)).alias("rows"))
    return table(spark, sf, "nation").select("n_nationkey", t.alias("t")).select("n_nationkey", B.valid(F.col("t")).alias("valid"))


def defined(spark: SparkSession, sf: str) -> DataFrame:
    """Orders that define a term, every second one twice; a meaning ends before a line that begins with a letter."""
    k = F.col("o_orderkey")
    again = F.when(k % 2 == 0, F.concat(F.lit("\n\n\"School\" means place "), k.cast("string"))).otherwise("")
    return table(spark, sf, "orders").select(k.alias("doc_id"), F.concat(F.lit("\"School\" means a house\nof lessons\n\n\"Pupil\" mean one who learns"), again).alias("text"))


@query("SELECT o_orderkey AS doc_id, 'School' AS term, CASE WHEN o_orderkey % 2 = 0 THEN 'place ' || o_orderkey ELSE 'a house' END AS meaning FROM orders UNION ALL SELECT o_orderkey, 'Pupil', 'one who learns' FROM orders")
def lg_definitions(spark: SparkSession, sf: str) -> DataFrame:
    return L.definitions(defined(spark, sf))


@query("SELECT fact_id, least(100, least(10 * (ord % 5), 30) + least(5 * (ord % 7), 20) + least(5 * (ord % 3), 10) + least(3 * (ord % 6), 10) + least(10 * (ord % 4), 20) + CASE ord % 4 WHEN 0 THEN 30 WHEN 1 THEN 20 WHEN 2 THEN 25 ELSE 10 END) / 100.0::DOUBLE AS complexity FROM {facts} f")
def lg_complexity(spark: SparkSession, sf: str) -> DataFrame:
    o = F.col("ord")
    kind = F.when(o % 4 == 0, "act").when(o % 4 == 1, "government_order").when(o % 4 == 2, "judgment").otherwise("rule")
    return facts(spark, sf).select("fact_id", L.complexity(o % 5, o % 7, o % 3, o % 6, o % 4, kind).alias("complexity"))


def described(spark: SparkSession, sf: str) -> DataFrame:
    """Orders, acts, rules and others, each read for what its kind has."""
    k = F.col("o_orderkey")
    text = F.when(k % 4 == 0, F.concat(F.lit("G.O.MS.No. "), k.cast("string"), F.lit("\nDepartment: School Education 5\n1. one\n2. two"))).when(k % 4 == 1, "Section 4: Schools are open\nand free").when(k % 4 == 2, "made under The Education Act, 2010\n(a) first\n(b) second").otherwise("a notice")
    docs = table(spark, sf, "orders").select(k.alias("doc_id"), F.when(k % 4 == 0, "order").when(k % 4 == 1, "act").when(k % 4 == 2, "rule").otherwise("generic").alias("kind"), text.alias("text"))
    return D.described(docs)


@query("SELECT o_orderkey AS doc_id, o_orderkey::VARCHAR AS number, 'School Education' AS department, 2 AS clauses FROM orders WHERE o_orderkey % 4 = 0")
def lg2_go(spark: SparkSession, sf: str) -> DataFrame:
    return described(spark, sf).where("kind = 'order'").select("doc_id", "number", "department", "clauses")


@query("SELECT o_orderkey AS doc_id, 1 AS sections, 0 AS clauses FROM orders WHERE o_orderkey % 4 = 1")
def lg2_act(spark: SparkSession, sf: str) -> DataFrame:
    return described(spark, sf).where("kind = 'act'").select("doc_id", "sections", "clauses")


@query("SELECT o_orderkey AS doc_id, 2 AS clauses, 'The Education Act, 2010' AS act, NULL::VARCHAR AS rule FROM orders WHERE o_orderkey % 4 = 2")
def lg2_rule(spark: SparkSession, sf: str) -> DataFrame:
    return described(spark, sf).where("kind = 'rule'").select("doc_id", "clauses", "act", "rule")


@query("SELECT o_orderkey AS doc_id, 0 AS found FROM orders WHERE o_orderkey % 4 = 3")
def lg2_generic(spark: SparkSession, sf: str) -> DataFrame:
    some = F.col("number").isNotNull() | F.col("department").isNotNull() | F.col("act").isNotNull() | F.col("rule").isNotNull()
    return described(spark, sf).where("kind = 'generic'").select("doc_id", (some.cast("int") + F.col("sections") + F.col("clauses")).alias("found"))



DATED = f"(SELECT * REPLACE (CASE WHEN dataset = 'right' THEN 2000 + split_part(entity_id, '_', 2)::INT % 60 ELSE year END AS year) FROM {SHIFTED})"


def dated(spark: SparkSession, sf: str) -> DataFrame:
    """The entities of both sides, all with a year of their own."""
    number = F.substring_index("entity_id", "_", -1).cast("int")
    return shifted(spark, sf).withColumn("year", F.when(F.col("dataset") == "right", 2000 + number % 60).otherwise(F.col("year")))


@query(f"SELECT 'link' AS part, NULL::VARCHAR AS entity_id, a.dataset AS source, b.dataset AS target, a.year AS source_year, b.year AS target_year, a.n AS sources, b.n AS targets, a.n * b.n AS links FROM (SELECT dataset, year, count(*) AS n FROM {DATED} GROUP BY 1, 2) a JOIN (SELECT dataset, year, count(*) AS n FROM {DATED} GROUP BY 1, 2) b ON a.dataset < b.dataset AND abs(a.year - b.year) <= 1 UNION ALL SELECT 'member', entity_id, dataset, NULL, year, NULL, NULL, NULL, NULL FROM {DATED}")
def er_temporal(spark: SparkSession, sf: str) -> DataFrame:
    """Links by year of all entities: linked classes, and each entity's class; every entity of one is linked with every one of the other."""
    e = dated(spark, sf)
    links = E.timed_classes(e).select(F.lit("link").alias("part"), F.lit(None).cast("string").alias("entity_id"), "*")
    members = e.select(F.lit("member").alias("part"), "entity_id", F.col("dataset").alias("source"), F.col("year").alias("source_year"))
    return links.unionByName(members, allowMissingColumns=True)


@query(f"SELECT a.entity_id AS source, b.entity_id AS target FROM {DATED} a JOIN {DATED} b ON a.dataset < b.dataset AND abs(a.year - b.year) <= 1 WHERE a.entity_id = (SELECT min(entity_id) FROM {DATED})")
def er_temporal_of(spark: SparkSession, sf: str) -> DataFrame:
    """The classes' links made out, for one entity that is asked for."""
    e = dated(spark, sf)
    asked = e.join(e.agg(F.min("entity_id").alias("entity_id")), "entity_id").where("dataset = 'left'")
    return E.timed(asked.unionByName(e.where("dataset = 'right'").select(asked.columns))).select(F.col("a.entity_id").alias("source"), F.col("b.entity_id").alias("target"))


def governed(spark: SparkSession, sf: str) -> DataFrame:
    """Districts of facts and orders whose names hold a district's."""
    d = E.merged(E.extracted(facts(spark, sf))).where("entity_type = 'district'").select(*E.ENTITY)
    k = F.col("o_orderkey")
    place = F.when(k % 3 == 0, " for Krishna").when(k % 3 == 1, " for guntur").otherwise("")
    return d.union(table(spark, sf, "orders").select(F.lit("orders"), F.lit("policy"), F.concat(F.lit("go_"), k.cast("string")), F.concat(F.lit("order "), k.cast("string"), place), F.year("o_orderdate")))


PLACES = "(SELECT DISTINCT lower(split_part(source_document, '_', 1)) AS dataset, district FROM {facts} f)"


@query(f"SELECT least(d.dataset, 'orders') AS first, 'district_' || lower(district) AS district, 'go_' || o_orderkey AS policy FROM {PLACES} d JOIN orders ON (lower(district) = 'krishna' AND o_orderkey % 3 = 0) OR (lower(district) = 'guntur' AND o_orderkey % 3 = 1)")
def er_semantic(spark: SparkSession, sf: str) -> DataFrame:
    found = E.semantic(governed(spark, sf))
    of = lambda kind: F.when(F.col("a.entity_type") == kind, F.col("a.entity_id")).otherwise(F.col("b.entity_id"))
    return found.select(F.col("a.dataset").alias("first"), of("district").alias("district"), of("policy").alias("policy"))


@query(f"SELECT count(*) AS links FROM {PLACES} d JOIN orders ON (lower(district) = 'krishna' AND o_orderkey % 3 = 0) OR (lower(district) = 'guntur' AND o_orderkey % 3 = 1)")
def join_semantic_types(spark: SparkSession, sf: str) -> DataFrame:
    """How many links the rules by types make; only that of districts and policies can fire."""
    return E.semantic(governed(spark, sf)).agg(F.count(F.lit(1)).alias("links"))


BLOCKED = f"SELECT 'left:' || a.entity_id AS source, 'right:' || b.entity_id AS target, CASE WHEN a.entity_id = b.entity_id THEN 'exact' WHEN lower(a.name) = lower(b.name) THEN 'exact' ELSE 'code' END AS kind, CASE WHEN a.entity_id = b.entity_id THEN 0.95::DOUBLE WHEN lower(a.name) = lower(b.name) THEN 0.85::DOUBLE ELSE 0.9::DOUBLE END AS confidence FROM {SIDES} ON a.entity_id = b.entity_id OR lower(a.name) = lower(b.name) OR split_part(a.entity_id, '_', 2) = split_part(b.entity_id, '_', 2)"


@query(BLOCKED)
def join_entities_blocked(spark: SparkSession, sf: str) -> DataFrame:
    """Links by all strategies but the ratio of names, which SQL lacks."""
    return E.links(shifted(spark, sf), fuzzy=False)


@query()
def join_entities(spark: SparkSession, sf: str) -> DataFrame:
    """Links by all six strategies in order; tests hold them against brute force."""
    return E.links(shifted(spark, sf))


@query()
def er_fuzzy(spark: SparkSession, sf: str) -> DataFrame:
    pairs = E.similar(shifted(spark, sf), only=("key",))
    return pairs.select(F.col("a.key").alias("source"), F.col("b.key").alias("target"), (F.col("c") / F.lit(100.0)).alias("confidence"))


@query("SELECT fact_id, round(s, 6) AS score FROM (SELECT fact_id, least(1, 0.4::DOUBLE * confidence_score + CASE WHEN ord % 2 = 0 THEN 0.3::DOUBLE ELSE 0 END + 0.2::DOUBLE + 0.1::DOUBLE) AS s FROM {facts} f) ORDER BY s DESC, fact_id LIMIT 20")
def topk_rank_results(spark: SparkSession, sf: str) -> DataFrame:
    source = F.when(F.col("ord") % 2 == 0, "table").otherwise("graph")
    score = S.rank_score(F.col("confidence_score"), F.lit("statistical"), source, F.lit("verified"), F.col("value"))
    return W.ranked(facts(spark, sf).withColumn("score", score), "score", "fact_id", 20).select("fact_id", F.round("score", 6).alias("score"))


WANTED = {"district": ["district", "dist"], "value": ["total", "count"], "year": ["year", "yr"], "colour": ["steel", "tin"]}
HEADERS = "(SELECT p_partkey, [p_name, 'Sl No ' || p_size, CASE WHEN p_partkey % 2 = 0 THEN 'Dist ' || p_brand END, p_type || ' Total', CASE WHEN p_partkey % 3 = 0 THEN 'Academic_Year' ELSE 'x' END] AS headers FROM part)"


@query(f"SELECT p_partkey, " + ", ".join("list_filter(headers, lambda h: " + " OR ".join(f"contains(lower(h), '{w}')" for w in ws) + f")[1] AS {k}" for k, ws in WANTED.items()) + f" FROM {HEADERS}")
def find_column(spark: SparkSession, sf: str) -> DataFrame:
    """The first header with a word for what is wanted, in the headers of as many tables as there are parts."""
    k = F.col("p_partkey")
    headers = F.array("p_name", F.concat(F.lit("Sl No "), "p_size"), F.when(k % 2 == 0, F.concat(F.lit("Dist "), "p_brand")), F.concat("p_type", F.lit(" Total")), F.when(k % 3 == 0, "Academic_Year").otherwise("x"))
    return table(spark, sf, "part").select("p_partkey", *[P.header_with(headers, words).alias(name) for name, words in WANTED.items()])
