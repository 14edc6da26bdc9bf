"""Queries of questions, scores, legal texts, parsing, entities and retrieval."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import vocabulary as V
from ..operators import entities as E
from ..operators import keyword_index as I
from ..operators import legal as L
from ..operators import normalise as N
from ..operators import retrieval as T
from ..operators import routing as R
from ..operators import scoring as S
from ..sources.facts import facts, legal_texts, table
from .registry import query
from .relational import AS_OF, words_sql

ASKED = "(SELECT fact_id, ord, district, indicator, year, value, confidence_score, CASE ord % 6 WHEN 0 THEN 'Compare ' || indicator || ' in ' || district || ' versus Guntur' WHEN 1 THEN 'What is the ' || indicator || ' of ' || district || ' in ' || year || '?' WHEN 2 THEN 'Trend of ' || indicator || ' over time since ' || year || ' by district' WHEN 3 THEN 'Which policy or GO order covers ' || district || ' in the last 5 years' WHEN 4 THEN 'Why did ' || indicator || ' change? analyze causes' ELSE 'Give an overview summary for ' || year || ' and ' || (year + 1) || ' of all schools and teachers in the state now please' END AS q FROM {facts} f)"


def asked(spark: SparkSession, sf: str) -> DataFrame:
    i, d, y, k = F.col("indicator"), F.col("district"), F.col("year").cast("string"), F.col("ord") % 6
    lit = F.lit
    q = (
        F.when(k == 0, F.concat(lit("Compare "), i, lit(" in "), d, lit(" versus Guntur")))
        .when(k == 1, F.concat(lit("What is the "), i, lit(" of "), d, lit(" in "), y, lit("?")))
        .when(k == 2, F.concat(lit("Trend of "), i, lit(" over time since "), y, lit(" by district")))
        .when(k == 3, F.concat(lit("Which policy or GO order covers "), d, lit(" in the last 5 years")))
        .when(k == 4, F.concat(lit("Why did "), i, lit(" change? analyze causes")))
        .otherwise(F.concat(lit("Give an overview summary for "), y, lit(" and "), (F.col("year") + 1).cast("string"), lit(" of all schools and teachers in the state now please")))
    )
    return facts(spark, sf).withColumn("q", q)


def ladder_sql(column: str, ladder: list, default: str) -> str:
    return "CASE " + " ".join(f"WHEN {words_sql(column, w)} THEN '{n}'" for n, w in ladder) + f" ELSE '{default}' END"


def pairs_sql(column: str, pairs: list, default: str | None) -> str:
    return "CASE " + " ".join(f"WHEN contains(lower({column}), '{k}') THEN '{v}'" for k, v in pairs) + (f" ELSE '{default}' END" if default else " END")


COUNTS = {n: " + ".join(f"contains(lower(q), '{w}')::INT" for w in words) for n, words in V.QUESTION_PHRASES.items()}
BEST = "greatest(" + ", ".join(COUNTS.values()) + ")"


@query(f"SELECT fact_id, CASE WHEN {BEST} = 0 THEN 'complex' " + " ".join(f"WHEN {c} = {BEST} THEN '{n}'" for n, c in COUNTS.items()) + f" END AS kind FROM {ASKED}")
def qc_classify(spark: SparkSession, sf: str) -> DataFrame:
    return asked(spark, sf).select("fact_id", R.question_type(F.col("q")).alias("kind"))


@query(f"SELECT fact_id, {ladder_sql('q', V.INTENTS, 'find')} AS intent FROM {ASKED}")
def qc_intent(spark: SparkSession, sf: str) -> DataFrame:
    return asked(spark, sf).select("fact_id", R.intent(F.col("q")).alias("intent"))


@query(f"SELECT fact_id, CASE WHEN len(y) > 0 THEN list_min(y)::INT WHEN contains(lower(q), 'last 5 years') THEN {AS_OF - 5} END AS first, CASE WHEN len(y) > 0 THEN list_max(y)::INT WHEN contains(lower(q), 'last 5 years') THEN {AS_OF} END AS last FROM (SELECT fact_id, q, regexp_extract_all(q, '\\b(20[0-2][0-9])\\b', 1) AS y FROM {ASKED})")
def qc_scope(spark: SparkSession, sf: str) -> DataFrame:
    first, last = R.temporal_scope(F.col("q"), AS_OF)
    return asked(spark, sf).select("fact_id", first.alias("first"), last.alias("last"))


@query(f"SELECT fact_id, concat_ws(',', CASE WHEN contains(lower(q), 'district') THEN 'district' END, CASE WHEN {words_sql('q', ['year', 'time', 'temporal'])} THEN 'temporal' END, CASE WHEN {words_sql('q', ['indicator', 'metric', 'measure'])} THEN 'indicator' END) AS dims FROM {ASKED}")
def qc_dims(spark: SparkSession, sf: str) -> DataFrame:
    return asked(spark, sf).select("fact_id", F.array_join(R.dimensions(F.col("q")), ",").alias("dims"))


NAMED = ", ".join([f"CASE WHEN contains(lower(q), '{d}') THEN '{d.title()}' END" for d in V.NAMED_DISTRICTS] + [f"CASE WHEN contains(lower(q), '{i}') THEN '{i.upper() if i in ('ger', 'ner', 'ptr') else i.title()}' END" for i in V.NAMED_INDICATORS])


@query(f"SELECT fact_id, concat_ws(',', {NAMED}, nullif(array_to_string(regexp_extract_all(q, '\\b(20[0-2][0-9])\\b', 1), ','), '')) AS entities FROM {ASKED}")
def rt_entities(spark: SparkSession, sf: str) -> DataFrame:
    return asked(spark, sf).select("fact_id", F.array_join(R.entities(F.col("q")), ",").alias("entities"))


SOUGHT = "len(list_filter([" + ", ".join(f"contains(lower(q), '{w}')" for w in [*V.NAMED_DISTRICTS, "tirupati", *V.SOUGHT_INDICATORS]) + "], lambda x: x))"
WORDS = "len(regexp_split_to_array(trim(q), '\\s+'))"


@query(f"SELECT fact_id, CASE WHEN {words_sql('q', V.COMPARISON_WORDS)} THEN 'comparison' WHEN {words_sql('q', V.TIME_WORDS)} THEN 'temporal' WHEN {SOUGHT} > 0 THEN 'entity_specific' WHEN {WORDS} > 10 THEN 'complex' WHEN regexp_matches(q, '[0-9]') THEN 'statistical' ELSE 'general' END AS kind, round(least(1, ({WORDS} / 20.0::DOUBLE + {SOUGHT} / 10.0::DOUBLE + {words_sql('q', V.COMPARISON_WORDS)}::INT + {words_sql('q', V.TIME_WORDS)}::INT) / 4), 6) AS complexity FROM {ASKED}")
def qc_enhanced(spark: SparkSession, sf: str) -> DataFrame:
    return asked(spark, sf).select("fact_id", R.search_type(F.col("q")).alias("kind"), F.round(R.complexity(F.col("q")), 6).alias("complexity"))


@query(f"SELECT fact_id, CASE WHEN {words_sql('q', V.METHODS[0][1])} THEN 'bridge' WHEN {words_sql('q', V.METHODS[1][1])} THEN 'advanced' WHEN {words_sql('q', V.METHODS[2][1])} THEN 'graph' WHEN {WORDS} > 10 THEN 'advanced' ELSE 'hybrid' END AS method FROM {ASKED}")
def qc_method(spark: SparkSession, sf: str) -> DataFrame:
    return asked(spark, sf).select("fact_id", R.method(F.col("q")).alias("method"))


@query(f"SELECT fact_id, {ladder_sql('q', V.POLICY_ROUTES, 'general')} AS route FROM {ASKED}")
def qc_policy(spark: SparkSession, sf: str) -> DataFrame:
    return asked(spark, sf).select("fact_id", R.policy_route(F.col("q")).alias("route"))


# Words that choose a mode, in order.
MODES = [("citation_first", ["legal", "act", "rule", "go", "official", "policy", "law"]), ("exploratory", ["compare", "trend", "analysis", "research", "insight"])]


@query(f"SELECT fact_id, {ladder_sql('q', MODES, 'balanced')} AS mode FROM {ASKED}")
def qc_mode(spark: SparkSession, sf: str) -> DataFrame:
    return asked(spark, sf).select("fact_id", R.first_match_of(F.col("q"), MODES, "balanced").alias("mode"))


@query("SELECT fact_id, round(least(1, (3 * (district = 'Guntur')::INT + 4 * (indicator = 'Dropout Rate')::INT + 2 * (year = 2018)::INT + 2) / 10.0::DOUBLE + confidence_score * 0.3::DOUBLE), 6) AS score FROM {facts} f")
def sc_result_relevance(spark: SparkSession, sf: str) -> DataFrame:
    wanted = F.array(*map(F.lit, ("Guntur", "dropout rate", "2018")))
    score = S.result_relevance(F.col("district"), F.col("indicator"), F.col("year"), F.col("value"), F.col("confidence_score"), wanted, F.lit(True))
    return facts(spark, sf).select("fact_id", F.round(score, 6).alias("score"))


@query(f"SELECT fact_id, round(c, 6) AS confidence, CASE WHEN c > 0.8::DOUBLE THEN 'verified' WHEN c > 0.5::DOUBLE THEN 'uncertain' ELSE 'conflicting' END AS status FROM (SELECT fact_id, confidence_score * CASE WHEN v < 0 THEN 0.5::DOUBLE ELSE 1 END * CASE WHEN contains(lower(indicator), 'rate') AND v > 100 THEN 0.7::DOUBLE ELSE 1 END * CASE WHEN year NOT BETWEEN 2000 AND {AS_OF + 1} THEN 0.6::DOUBLE ELSE 1 END AS c FROM (SELECT *, CASE WHEN ord % 4 = 0 THEN -value ELSE value * 3 END AS v FROM {{facts}} f))")
def sc_verify_correct(spark: SparkSession, sf: str) -> DataFrame:
    v = F.when(F.col("ord") % 4 == 0, -F.col("value")).otherwise(F.col("value") * 3)
    c, status = S.verified(v, F.col("indicator"), F.col("year"), F.col("confidence_score"), AS_OF)
    return facts(spark, sf).select("fact_id", F.round(c, 6).alias("confidence"), status.alias("status"))


@query("SELECT fact_id, round(least(1, 0.4::DOUBLE * confidence_score + CASE WHEN ord % 2 = 0 THEN 0.3::DOUBLE ELSE 0 END + 0.2::DOUBLE + 0.1::DOUBLE), 6) AS score FROM {facts} f")
def sc_rank(spark: SparkSession, sf: str) -> DataFrame:
    source = F.when(F.col("ord") % 2 == 0, "table").otherwise("graph")
    score = S.rank_score(F.col("confidence_score"), F.lit("statistical"), source, F.lit("verified"), F.col("value"))
    return facts(spark, sf).select("fact_id", F.round(score, 6).alias("score"))


@query("SELECT fact_id, round(greatest(0, 1 - abs(value - mean) / deviation / 3), 4) AS consistency FROM {facts} f JOIN (SELECT indicator, avg(value) AS mean, stddev_pop(value) AS deviation FROM {facts} g GROUP BY 1) USING (indicator)")
def sc_consistency(spark: SparkSession, sf: str) -> DataFrame:
    return S.consistency(facts(spark, sf)).select("fact_id", F.round("consistency", 4).alias("consistency"))


@query("SELECT fact_id, round(least(1, confidence_score + 0.2::DOUBLE * ((lower(district) = 'guntur')::INT + contains(lower(indicator), 'dropout')::INT) + CASE WHEN year > 2018 THEN 0.1::DOUBLE ELSE 0 END), 6) AS score FROM {facts} f")
def sc_query_relevance(spark: SparkSession, sf: str) -> DataFrame:
    found = F.array(F.lit("district:guntur"), F.lit("indicator:dropout"))
    score = S.query_relevance(F.col("confidence_score"), found, F.col("district"), F.col("indicator"), F.col("year") > 2018)
    return facts(spark, sf).select("fact_id", F.round(score, 6).alias("score"))


@query("SELECT a.fact_id, abs(a.value - b.value) / greatest(abs(b.value), 1) <= 0.01::DOUBLE AS agree FROM {facts} a JOIN {facts} b ON a.district = b.district AND a.indicator = b.indicator AND b.year = a.year + 1")
def sc_numeric_claim(spark: SparkSession, sf: str) -> DataFrame:
    f = facts(spark, sf)
    nxt = f.select("district", "indicator", (F.col("year") - 1).alias("year"), F.col("value").alias("b"))
    return f.join(nxt, ["district", "indicator", "year"]).select("fact_id", S.numbers_agree(F.col("value"), F.col("b")).alias("agree"))


@query("SELECT conv_id, turn, len(list_filter(list_transform(regexp_split_to_array(text, '[.!?]+'), lambda x: trim(x)), lambda s: length(s) >= 20 AND NOT regexp_matches(lower(s), 'according to|based on|as per|source:'))) AS claims FROM conversations WHERE text IS NOT NULL")
def sc_claims(spark: SparkSession, sf: str) -> DataFrame:
    c = table(spark, sf, "conversations").where("text is not null")
    return c.select("conv_id", "turn", F.size(S.claims(F.col("text"))).cast("long").alias("claims"))


HEDGED = "|".join(V.HEDGES)


@query(f"SELECT conv_id, turn, round(len(list_filter(s, lambda x: regexp_matches(lower(x), '{HEDGED}'))) / greatest(len(s), 1), 6) AS hedged FROM (SELECT conv_id, turn, list_filter(list_transform(regexp_split_to_array(text, '[.!?]+'), lambda x: trim(x)), lambda x: length(x) > 20) AS s FROM conversations WHERE text IS NOT NULL)")
def sc_hedging(spark: SparkSession, sf: str) -> DataFrame:
    c = table(spark, sf, "conversations").where("text is not null")
    return c.select("conv_id", "turn", F.round(S.hedging(F.col("text")), 6).alias("hedged"))


@query("SELECT fact_id, round(0.5::DOUBLE * confidence_score + 0.3::DOUBLE * (1 - (ord % 10) / 10.0::DOUBLE) + 0.2::DOUBLE * least((ord % 5) / 3.0::DOUBLE, 1), 6) AS confidence FROM {facts} f")
def sc_citation_conf(spark: SparkSession, sf: str) -> DataFrame:
    c = S.citation_confidence(F.col("confidence_score"), (F.col("ord") % 10) / F.lit(10.0), F.col("ord") % 5, 3)
    return facts(spark, sf).select("fact_id", F.round(c, 6).alias("confidence"))


G1 = L.ORDER
REF = "'GO ' || {0} || CASE WHEN {1} <> '' THEN '/' || {1} ELSE '' END"


def unnested(pattern: str, groups: list[int], columns: str, where: str = "true") -> str:
    parts = ", ".join(f"unnest(regexp_extract_all(text, '{pattern}', {g})) AS g{g}" for g in groups)
    return f"SELECT {columns} FROM (SELECT doc_id, {parts} FROM {{legal}} t) WHERE {where}"


@query(unnested(G1, [1, 2], f"doc_id, {REF.format('g1', 'g2')} AS ref_id"))
def lg_go_refs(spark: SparkSession, sf: str) -> DataFrame:
    return L.order_references(legal_texts(spark, sf)).select("doc_id", "ref_id")


@query(unnested(L.ACT, [1, 2], "doc_id, trim(g1) AS name, g2 AS year"))
def lg_act_refs(spark: SparkSession, sf: str) -> DataFrame:
    return L.found(legal_texts(spark, sf), L.ACT, 2).select("doc_id", F.trim("g1").alias("name"), F.col("g2").alias("year"))


@query(unnested(L.SECTION, [1], "doc_id, g1 AS section"))
def lg_section_refs(spark: SparkSession, sf: str) -> DataFrame:
    return L.found(legal_texts(spark, sf), L.SECTION, 1).select("doc_id", F.col("g1").alias("section"))


REFERENCES = " UNION ALL ".join(
    [
        unnested(G1, [1, 2], f"doc_id, 'go' AS kind, {REF.format('g1', 'g2')} AS ref_id, 0.9::DOUBLE AS confidence"),
        unnested(L.ACT, [1, 2], "doc_id, 'act', trim(g1) || ', ' || g2, 0.85::DOUBLE"),
        unnested(L.JUDGMENT, [2, 3, 4], "doc_id, 'judgment', g2 || ' ' || g3 || ' ' || g4, 0.8::DOUBLE"),
        unnested(L.SECTION, [1], "doc_id, 'section', 'Section ' || g1, 0.7::DOUBLE"),
        unnested(L.RULE, [1], "doc_id, 'rule', 'Rule ' || g1, 0.7::DOUBLE"),
    ]
)


@query(REFERENCES)
def lg_references(spark: SparkSession, sf: str) -> DataFrame:
    return L.references(legal_texts(spark, sf))



SUPERSEDED = f"SELECT doc_id, {REF.format('n', 'y')} AS superseding, {REF.format('g1', 'g2')} AS superseded, CASE WHEN contains(lower(g0), 'part') THEN 'partial' WHEN regexp_matches(lower(g0), 'amend|modify|substitute') THEN 'amendment' ELSE 'full' END AS kind FROM (SELECT doc_id, regexp_extract(text, '{G1}', 1) AS n, regexp_extract(text, '{G1}', 2) AS y, " + ", ".join(f"unnest(regexp_extract_all(text, '{L.SUPERSEDES}', {g})) AS g{g}" for g in (0, 1, 2)) + " FROM {legal} t) WHERE n <> ''"


@query(SUPERSEDED)
def lg_supersession(spark: SparkSession, sf: str) -> DataFrame:
    return L.supersessions(legal_texts(spark, sf))


@query(f"SELECT doc_id, kind FROM ({SUPERSEDED})")
def lg_supersession_type(spark: SparkSession, sf: str) -> DataFrame:
    return L.supersessions(legal_texts(spark, sf)).select("doc_id", "kind")


@query(f"SELECT doc_id FROM {{legal}} t WHERE 'GO ' || doc_id NOT IN (SELECT split_part(superseded, '/', 1) FROM ({SUPERSEDED}))")
def flt_active_docs(spark: SparkSession, sf: str) -> DataFrame:
    docs = legal_texts(spark, sf)
    old = L.supersessions(docs).select(F.substring_index("superseded", "/", 1).alias("ref")).distinct()
    return docs.join(old, F.concat(F.lit("GO "), F.col("doc_id").cast("string")) == F.col("ref"), "left_anti").select("doc_id")


@query(f"SELECT a.doc_id AS source, b.doc_id AS target FROM ({SUPERSEDED}) a JOIN {{legal}} b ON split_part(a.superseded, '/', 1) = 'GO ' || b.doc_id")
def join_supersession(spark: SparkSession, sf: str) -> DataFrame:
    docs = legal_texts(spark, sf)
    old = L.supersessions(docs).select(F.col("doc_id").alias("source"), F.substring_index("superseded", "/", 1).alias("ref"))
    return old.join(docs.select(F.col("doc_id").alias("target")), F.concat(F.lit("GO "), F.col("target").cast("string")) == F.col("ref")).select("source", "target")


@query("SELECT doc_id, line::INTEGER AS line, level::INTEGER AS level, identifier, CASE level WHEN 2 THEN 'Part ' || p WHEN 3 THEN 'Chapter ' || c WHEN 4 THEN 'Section ' || CASE WHEN line = 5 THEN 1 ELSE 2 END END AS parent FROM (SELECT doc_id, p, c, unnest([2 + s, 3 + s, 4 + s, 5 + s, 6 + s, 7 + s]) AS line, unnest([1, 2, 3, 4, 3, 4]) AS level, unnest(['Part ' || p, 'Chapter ' || c, 'Section 1', 'Subsection (a)', 'Section 2', 'Subsection (b)']) AS identifier FROM (SELECT o_orderkey AS doc_id, o_orderkey % 4 + 1 AS p, o_custkey % 5 + 1 AS c, 0 AS s FROM orders))")
def lg_hierarchy(spark: SparkSession, sf: str) -> DataFrame:
    return L.hierarchy(legal_texts(spark, sf))


@query(unnested(L.STEP, [1, 2], "doc_id, g1::INTEGER AS step, trim(g2) AS what"))
def lg_procedures(spark: SparkSession, sf: str) -> DataFrame:
    return L.procedures(legal_texts(spark, sf))


@query(unnested(L.AMENDED, [0, 1], "doc_id, g1::INTEGER AS year, CASE WHEN contains(lower(g0), 'substituted') THEN 'substitution' WHEN contains(lower(g0), 'inserted') THEN 'insertion' WHEN contains(lower(g0), 'omitted') THEN 'omission' WHEN contains(lower(g0), 'amended') THEN 'amendment' ELSE 'modification' END AS kind"))
def lg_amendments(spark: SparkSession, sf: str) -> DataFrame:
    return L.amendments(legal_texts(spark, sf))


@query(unnested(L.EFFECTIVE, [1], "doc_id, g1 AS date"))
def lg_effective_dates(spark: SparkSession, sf: str) -> DataFrame:
    return L.effective_dates(legal_texts(spark, sf))


@query("SELECT doc_id, CASE WHEN regexp_matches(lower(text), 'andhra\\s+pradesh|a\\.?p\\.?') THEN 'Andhra Pradesh' END AS state, CASE WHEN contains(lower(text), 'guntur') THEN 'Guntur' END AS district, CASE WHEN regexp_matches(lower(text), 'school education|education department|cse') THEN 'School Education' END AS department, CASE WHEN contains(lower(text), 'guntur') THEN 'district' WHEN regexp_matches(lower(text), 'andhra\\s+pradesh|a\\.?p\\.?') THEN 'state' ELSE 'unknown' END AS scope FROM {legal} t")
def lg_jurisdiction(spark: SparkSession, sf: str) -> DataFrame:
    return L.jurisdiction(legal_texts(spark, sf))


@query("SELECT doc_id, 'government_order' AS kind, 6::BIGINT AS n_references, 6::BIGINT AS n_headings, 0::BIGINT AS n_definitions, 1::BIGINT AS n_procedures, 1::BIGINT AS n_supersessions, 0.83::DOUBLE AS complexity FROM {legal} t")
def lg_analyze(spark: SparkSession, sf: str) -> DataFrame:
    return L.analysed(legal_texts(spark, sf))


@query("SELECT doc_id, CASE WHEN contains(lower(text), 'government order') OR contains(lower(text), 'g.o.') THEN 'government_order' WHEN contains(lower(text), 'act') OR contains(lower(text), 'statute') THEN 'act' WHEN contains(lower(text), 'rule') THEN 'rule' WHEN contains(lower(text), 'judgment') OR contains(lower(text), 'order') OR contains(lower(text), 'writ') THEN 'judgment' WHEN contains(lower(text), 'policy') THEN 'policy' WHEN contains(lower(text), 'circular') THEN 'circular' WHEN contains(lower(text), 'notification') THEN 'notification' ELSE 'unknown' END AS kind FROM documents")
def fn_legal_doc_type(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select("doc_id", L.document_kind(F.col("text")).alias("kind"))


@query(f"SELECT fact_id, {pairs_sql('q', N.spelled(V.CATEGORY_SPELLINGS), None)} AS category FROM {ASKED}")
def fn_extract_category_enh(spark: SparkSession, sf: str) -> DataFrame:
    return asked(spark, sf).select("fact_id", N.category(F.col("q")).alias("category"))


@query(f"SELECT fact_id, {pairs_sql('q', V.CATEGORY_FIRST, 'total')} AS category FROM {ASKED}")
def fn_extract_category_s2(spark: SparkSession, sf: str) -> DataFrame:
    return asked(spark, sf).select("fact_id", N.category_first(F.col("q")).alias("category"))


@query(f"SELECT fact_id, {pairs_sql('q', V.UNIT_SPELLINGS, 'count')} AS unit FROM {ASKED}")
def fn_unit_enh(spark: SparkSession, sf: str) -> DataFrame:
    return asked(spark, sf).select("fact_id", N.unit(F.col("q")).alias("unit"))



@query("SELECT fact_id, CASE WHEN contains(u, '%') OR contains(u, 'percentage') THEN 'percentage' WHEN contains(u, 'ratio') THEN 'ratio' WHEN contains(u, 'count') OR contains(u, 'number') OR contains(u, 'total') THEN 'count' ELSE 'unknown' END AS unit FROM (SELECT fact_id, lower(indicator || ' ' || unit) AS u FROM {facts} f)")
def fn_extract_unit_s2(spark: SparkSession, sf: str) -> DataFrame:
    return facts(spark, sf).select("fact_id", N.unit_first(F.concat_ws(" ", "indicator", "unit")).alias("unit"))


@query(f"SELECT fact_id, {pairs_sql('q', N.spelled(V.DISTRICT_SPELLINGS), None)} AS district FROM {ASKED}")
def fn_district_text(spark: SparkSession, sf: str) -> DataFrame:
    return asked(spark, sf).select("fact_id", N.district_in(F.col("q")).alias("district"))


@query("SELECT fact_id, CASE WHEN contains(lower(source_document), 'cse') THEN 'CSE' WHEN contains(lower(source_document), 'scert') THEN 'SCERT' WHEN contains(lower(source_document), 'go') THEN 'GO' ELSE 'Unknown' END AS kind FROM {facts} f")
def fn_source_type(spark: SparkSession, sf: str) -> DataFrame:
    return facts(spark, sf).select("fact_id", N.source_kind(F.col("source_document")).alias("kind"))


@query("SELECT fact_id, coalesce(nullif(regexp_extract(source_document, '([0-9]{4})', 1), '')::INTEGER, 2023) AS year FROM {facts} f")
def fn_year_filename(spark: SparkSession, sf: str) -> DataFrame:
    return facts(spark, sf).select("fact_id", N.year_of_name(F.col("source_document"), 2023).alias("year"))


@query(f"SELECT fact_id, coalesce(CASE WHEN y BETWEEN 2000 AND {AS_OF + 1} THEN y END, 2023) AS year FROM (SELECT fact_id, nullif(regexp_extract(q, '\\b(20[12][0-9])\\b', 1), '')::INTEGER AS y FROM {ASKED})")
def fn_year_text(spark: SparkSession, sf: str) -> DataFrame:
    return asked(spark, sf).select("fact_id", N.year_of_text(F.col("q"), AS_OF).alias("year"))


CELL = "CASE p_partkey % 6 WHEN 0 THEN 'Rs ' || p_size || ',' || lpad((p_partkey % 1000)::VARCHAR, 3, '0') || '.5 %' WHEN 1 THEN '-' || p_size || ' pupils' WHEN 2 THEN 'n/a' WHEN 3 THEN p_size || '.2.3' WHEN 4 THEN '*' || p_size || '* of 2,000' END"


def cells(spark: SparkSession, sf: str) -> DataFrame:
    """Cells of tables in six shapes: grouped, negative, none, with two points, starred, null."""
    k, n = F.col("p_partkey"), F.col("p_size").cast("string")
    grouped = F.concat(F.lit("Rs "), n, F.lit(","), F.lpad((k % 1000).cast("string"), 3, "0"), F.lit(".5 %"))
    s = F.when(k % 6 == 0, grouped).when(k % 6 == 1, F.concat(F.lit("-"), n, F.lit(" pupils"))).when(k % 6 == 2, "n/a").when(k % 6 == 3, F.concat(n, F.lit(".2.3"))).when(k % 6 == 4, F.concat(F.lit("*"), n, F.lit("* of 2,000")))
    return table(spark, sf, "part").select("p_partkey", s.alias("s"))


@query(f"SELECT p_partkey, try_cast(nullif(regexp_extract(regexp_replace(s, '[,%*]', '', 'g'), '([0-9.]+)', 1), '') AS DOUBLE) AS value FROM (SELECT p_partkey, {CELL} AS s FROM part)")
def fn_parse_value_s2(spark: SparkSession, sf: str) -> DataFrame:
    return cells(spark, sf).select("p_partkey", N.number(F.col("s")).alias("value"))


@query(f"SELECT p_partkey, try_cast(nullif(replace(regexp_extract(regexp_replace(s, '[^0-9.,%\\s-]', '', 'g'), '([0-9,]+(?:\\.[0-9]+)?)', 1), ',', ''), '') AS DOUBLE) AS value FROM (SELECT p_partkey, {CELL} AS s FROM part)")
def fn_parse_value_enh(spark: SparkSession, sf: str) -> DataFrame:
    return cells(spark, sf).select("p_partkey", N.grouped_number(F.col("s")).alias("value"))



@query("SELECT n_nationkey AS table_id, r AS row, c AS column, d AS district, h AS header, v AS value FROM (SELECT n_nationkey, 0 AS r, 1 AS c, n_name AS d, 'Boys' AS h, n_nationkey * 10.0::DOUBLE AS v FROM nation UNION ALL SELECT n_nationkey, 0, 2, n_name, 'Girls', n_regionkey * 1.5::DOUBLE FROM nation UNION ALL SELECT n_nationkey, 1, 2, 'x', 'Girls', 7.0::DOUBLE FROM nation)")
def fn_table_to_facts_s2(spark: SparkSession, sf: str) -> DataFrame:
    n = table(spark, sf, "nation")
    one = F.array(F.col("n_name"), (F.col("n_nationkey") * 10).cast("string"), F.format_string("%.1f%%", F.col("n_regionkey") * F.lit(1.5)))
    t = n.select(F.col("n_nationkey").alias("table_id"), F.array(F.lit("District"), F.lit("Boys"), F.lit("Girls")).alias("headers"), F.array(one, F.array(F.lit("x"), F.lit("none"), F.lit("7"))).alias("rows"))
    return N.facts_of_tables(t)


@query("SELECT fact_id AS doc_id, 'dropout' AS indicator, value FROM {facts} f WHERE indicator = 'Dropout Rate'")
def fn_text_patterns(spark: SparkSession, sf: str) -> DataFrame:
    docs = facts(spark, sf).where("indicator = 'Dropout Rate'").select(F.col("fact_id").alias("doc_id"), F.concat(F.lit("About "), F.format_string("%.2f", "value"), F.lit("% Dropout was seen")).alias("text"))
    return N.percent_facts(docs)


@query("SELECT fact_id AS doc_id, district AS label, district, NULL::VARCHAR AS indicator, year::DOUBLE AS value FROM {facts} f WHERE district NOT LIKE 'NATION%'")
def fn_stat_text(spark: SparkSession, sf: str) -> DataFrame:
    docs = facts(spark, sf).select(F.col("fact_id").alias("doc_id"), F.concat(F.col("district"), F.lit(": "), F.format_string("%d", "year")).alias("text"))
    return N.labelled_facts(docs)


@query("SELECT DISTINCT f.district, f.district AS name FROM {facts} f WHERE district NOT LIKE 'NATION%' UNION SELECT DISTINCT district, NULL FROM {facts} f WHERE district LIKE 'NATION%'")
def join_dict_lookup(spark: SparkSession, sf: str) -> DataFrame:
    return N.canonical(facts(spark, sf).select("district").distinct(), "district", V.DISTRICT_SPELLINGS, "name")


@query("SELECT fact_id, indicator || ' in ' || district || ' | Year ' || year || ' | Value: ' || printf('%.2f', value) || ' ' || unit || coalesce(' | Category: ' || category, '') || ' | Source: ' || source_document AS content FROM {facts} f")
def fn_fact_content(spark: SparkSession, sf: str) -> DataFrame:
    return facts(spark, sf).select("fact_id", T.fact_content().alias("content"))


@query("SELECT doc_id, CASE WHEN length(text) > 200 THEN substr(text, 1, 200) || '...' ELSE text END AS excerpt, substr(md5(coalesce(lang, '') || source), 1, 8) AS cid FROM documents")
def fn_excerpt(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select("doc_id", T.excerpt(F.col("text")).alias("excerpt"), T.citation_id(F.coalesce("lang", F.lit("")), F.col("source")).alias("cid"))


ENT = "(SELECT lower(split_part(source_document, '_', 1)) AS dataset, year, 'district' AS entity_type, 'district_' || lower(district) AS entity_id, district AS name FROM {facts} f UNION ALL SELECT lower(split_part(source_document, '_', 1)), year, 'policy', source_document, source_document FROM {facts} f WHERE contains(source_document, 'go_'))"


@query(f"SELECT dataset, entity_type, entity_id, count(*) AS n FROM {ENT} GROUP BY 1, 2, 3")
def er_extract(spark: SparkSession, sf: str) -> DataFrame:
    return E.extracted(facts(spark, sf)).groupBy("dataset", "entity_type", "entity_id").agg(F.count(F.lit(1)).alias("n"))


MERGED = f"SELECT dataset, entity_type, entity_id, arg_max(name, (year, name)) AS name, max(year) AS year, string_agg(DISTINCT name, '|' ORDER BY name) AS aliases FROM {ENT} GROUP BY 1, 2, 3"


@query(MERGED)
def er_merge(spark: SparkSession, sf: str) -> DataFrame:
    return E.merged(E.extracted(facts(spark, sf)))


SHIFTED = "(SELECT 'left' AS dataset, 'school' AS entity_type, 'school_' || (100000 + p_partkey) AS entity_id, p_name AS name, 2000 + p_size AS year FROM part UNION ALL SELECT 'right', CASE WHEN p_partkey % 2 = 0 THEN 'school' ELSE 'district' END, CASE WHEN p_partkey % 3 = 0 THEN 'school_' ELSE 'unit_' END || (100000 + p_partkey), CASE WHEN p_partkey % 5 = 0 THEN upper(p_name) ELSE p_name || 'x' END, 2100 FROM part)"


def shifted(spark: SparkSession, sf: str) -> DataFrame:
    p, k = table(spark, sf, "part"), F.col("p_partkey")
    code = (100000 + k).cast("string")
    left = p.select(F.lit("left").alias("dataset"), F.lit("school").alias("entity_type"), F.concat(F.lit("school_"), code).alias("entity_id"), F.col("p_name").alias("name"), (2000 + F.col("p_size")).alias("year"))
    right = p.select(F.lit("right"), F.when(k % 2 == 0, "school").otherwise("district"), F.concat(F.when(k % 3 == 0, "school_").otherwise("unit_"), code), F.when(k % 5 == 0, F.upper("p_name")).otherwise(F.concat("p_name", F.lit("x"))), F.lit(2100))
    return left.union(right)


@query("WITH q AS (SELECT embedding::DOUBLE[] AS x FROM embeddings WHERE vec_id = 7) SELECT vec_id, round(list_cosine_similarity(embedding::DOUBLE[], q.x), 6) AS score FROM embeddings, q ORDER BY list_cosine_similarity(embedding::DOUBLE[], q.x) DESC, vec_id LIMIT 15")
def rt_vector(spark: SparkSession, sf: str) -> DataFrame:
    v = table(spark, sf, "embeddings")
    asked_for = v.where("vec_id = 7").select("embedding").first()
    return T.nearest(v, "vec_id", "embedding", list(asked_for.embedding), 15).select("vec_id", F.round("score", 6).alias("score"))


BM = "WITH w AS (SELECT doc_id, list_filter(regexp_split_to_array(lower(text), '[^a-z0-9]+'), lambda x: x <> '') AS w FROM documents), c AS (SELECT doc_id, len(w) AS n, len(list_filter(w, lambda x: x = 'license')) AS f0, len(list_filter(w, lambda x: x = 'the')) AS f1 FROM w), s AS (SELECT count(*) AS docs, avg(n) AS mean, count(*) FILTER (WHERE f0 > 0) AS d0, count(*) FILTER (WHERE f1 > 0) AS d1 FROM c), r AS (SELECT doc_id, ln(1 + (docs - d0 + 0.5::DOUBLE) / (d0 + 0.5::DOUBLE)) * f0 * 2.2::DOUBLE / (f0 + 1.2::DOUBLE * (1 - 0.75::DOUBLE + 0.75::DOUBLE * n / mean)) + ln(1 + (docs - d1 + 0.5::DOUBLE) / (d1 + 0.5::DOUBLE)) * f1 * 2.2::DOUBLE / (f1 + 1.2::DOUBLE * (1 - 0.75::DOUBLE + 0.75::DOUBLE * n / mean)) AS score FROM c, s)"


@query(f"{BM} SELECT doc_id, round(score, 5) AS score FROM r WHERE score > 0")
def rt_keyword(spark: SparkSession, sf: str) -> DataFrame:
    return T.bm25(table(spark, sf, "documents"), "doc_id", "text", ["license", "the"]).select("doc_id", F.round("score", 5).alias("score"))


QUESTIONS = {"licenses": ["license", "the", "of"], "common": ["the", "and"], "mixed": ["email", "de", "la", "permission"], "unknown": ["zzzz"], "one": ["copyright"], "long": ["the", "of", "and", "de", "in", "software", "contact", "phone"]}
SQL_QUESTIONS = ", ".join(f"('{q}', '{t}')" for q, ts in QUESTIONS.items() for t in ts)


@query(f"WITH w AS (SELECT doc_id, list_filter(regexp_split_to_array(lower(text), '[^a-z0-9]+'), lambda x: x <> '') AS w FROM documents), s AS (SELECT count(*) AS docs, avg(len(w)) AS mean FROM w), f AS (SELECT doc_id, n, term, count(*) AS f FROM (SELECT doc_id, len(w) AS n, unnest(w) AS term FROM w) GROUP BY ALL), d AS (SELECT term, count(*) AS d FROM f GROUP BY 1), r AS (SELECT question, doc_id, round(sum(ln(1 + (docs - d + 0.5::DOUBLE) / (d + 0.5::DOUBLE)) * f * 2.2::DOUBLE / (f + 1.2::DOUBLE * (1 - 0.75::DOUBLE + 0.75::DOUBLE * n / mean))), 9) AS score FROM (VALUES {SQL_QUESTIONS}) q(question, term) JOIN f USING (term) JOIN d USING (term), s GROUP BY 1, 2) SELECT question, doc_id, round(score, 5) AS score, rank FROM (SELECT *, row_number() OVER (PARTITION BY question ORDER BY score DESC, doc_id)::INT AS rank FROM r) WHERE rank <= 10")
def rt_keyword_many(spark: SparkSession, sf: str) -> DataFrame:
    """Ten documents for each of several questions, from one index."""
    asked_ = spark.createDataFrame([(q, t) for q, ts in QUESTIONS.items() for t in ts], "question string, term string")
    return I.answers(I.build(table(spark, sf, "documents"), "doc_id", "text"), asked_, 10).withColumn("score", F.round("score", 5))


@query("SELECT fact_id AS result_id, content, score FROM (SELECT *, row_number() OVER (PARTITION BY substr(content, 1, 100) ORDER BY score DESC, fact_id) AS i FROM (SELECT fact_id, indicator || ' ' || year AS content, confidence_score AS score FROM {facts} f WHERE year = 2019 UNION ALL SELECT fact_id, indicator || ' ' || year, 0.75::DOUBLE FROM {facts} f WHERE indicator = 'Dropout Rate')) WHERE i = 1 ORDER BY score DESC, fact_id LIMIT 20")
def fu_fuse(spark: SparkSession, sf: str) -> DataFrame:
    f = facts(spark, sf).select(F.col("fact_id").alias("result_id"), F.concat_ws(" ", "indicator", F.col("year").cast("string")).alias("content"), F.col("confidence_score").alias("score"), "year", "indicator")
    a, b = f.where("year = 2019"), f.where("indicator = 'Dropout Rate'").withColumn("score", F.lit(0.75))
    return T.fused([x.select("result_id", "content", "score") for x in (a, b)], 20)
