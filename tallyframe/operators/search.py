"""Search over facts and documents that carry a text and a vector: modes, compositions, trends and comparisons.

Rows are ``key, content, embedding`` and their own columns. A question is its words and its vector, as no model is at
hand to embed it. Results are ``key, score``; ties go to the smaller key.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import graph as G
from . import retrieval as T
from .windows import first_match, top_per_group

# Weights of the vector score by kind of search, and the modes' thresholds.
SEARCH_ALPHA, LEGAL_ALPHA, DATA_ALPHA, VECTOR_ONLY = 0.7, 0.7, 0.6, 1.0
COMPLEX, MANY_METHODS, PRECISION = 0.7, 2, 0.8
DATA_SOURCES = ["udise", "scert", "cse"]


@dataclass(frozen=True)
class Question:
    """What is asked: its words and its vector."""

    terms: tuple[str, ...]
    vector: tuple[float, ...]


def scored(rows: DataFrame, key: str, question: Question) -> tuple[DataFrame, DataFrame]:
    """The vector scores of all rows and the keyword scores of those that hold a word."""
    asked = F.array(*[F.lit(x) for x in question.vector])
    return rows.select(key, T.cosine(F.col("embedding"), asked).alias("score")), T.bm25(rows, key, "content", list(question.terms))


def search(rows: DataFrame, key: str, question: Question, k: int, alpha: float = SEARCH_ALPHA, where: Column | None = None) -> DataFrame:
    """Vector search from ``alpha`` 0.9 on, keyword search up to 0.1, and a mixture between, of the rows that a filter leaves."""
    vector, keyword = scored(rows if where is None else rows.where(where), key, question)
    return T.hybrid(vector, keyword, key, alpha, k)


def vector_search(rows: DataFrame, key: str, question: Question, k: int) -> DataFrame:
    return search(rows, key, question, k, VECTOR_ONLY)


def keyword_search(rows: DataFrame, key: str, question: Question, k: int) -> DataFrame:
    return search(rows, key, question, k, 0.0)


def graph_search(facts: DataFrame, policies: DataFrame, links: DataFrame, words: str, k: int) -> DataFrame:
    """``fact_id, score``: the best branch of the graph's three by which a fact is found."""
    found = G.union_search(facts, policies, links, words).groupBy("fact_id").agg(F.max("score").alias("score"))
    return found.orderBy(F.desc("score"), "fact_id").limit(k)


def combined(results: list[DataFrame], key: str, k: int) -> DataFrame:
    """``key, score, part``: the first list that holds a key keeps it, lists and their scores in order, ``k`` rows in all."""
    parts = [r.select(key, "score", F.lit(i).alias("part")) for i, r in enumerate(results)]
    every = parts[0]
    for p in parts[1:]:
        every = every.unionByName(p)
    return first_match(every, [key], ["part"]).orderBy("part", F.desc("score"), key).limit(k)


def multi_modal(vector: DataFrame, graph: DataFrame, keyword: DataFrame, key: str, k: int) -> DataFrame:
    """A third of the places for each kind of search, without repeats; the lists are a third of ``k`` long already."""
    return combined([vector, graph, keyword], key, k)


def precise(keyword: DataFrame, least: float = PRECISION) -> DataFrame:
    return keyword.where(F.col("score") >= least)


def voted(lists: list[DataFrame], key: str, k: int) -> DataFrame:
    """``key, score, votes`` of an ensemble: the lists that hold a key, then its best score over them, each list from 0 to 1."""
    every = None
    for rows in lists:
        rows = T.scaled(rows.select(key, "score"))
        every = rows if every is None else every.unionByName(rows)
    return every.groupBy(key).agg(F.count(F.lit(1)).alias("votes"), F.max("score").alias("score")).orderBy(F.desc("votes"), F.desc("score"), key).limit(k)


def diverse(found: DataFrame, rows: DataFrame, key: str, by: list[str], k: int) -> DataFrame:
    """The best ``k`` of twice as many results, the first of each group before the second of any."""
    beside = found.join(rows.select(key, *by), key)
    ranked = top_per_group(beside, by, [F.desc("score"), key], k)
    return ranked.orderBy("rank", F.desc("score"), key).limit(k).select(key, "score", "rank")


def with_context(found: DataFrame, edges: DataFrame, key: str, depth: int) -> DataFrame:
    """``key, score, related``: how many other nodes stand within ``depth`` hops of each result."""
    reach = G.distances(edges, found.select(F.col(key).alias("id")), depth).where("distance > 0")
    counts = reach.groupBy(F.col("id").alias(key)).agg(F.count(F.lit(1)).alias("related"))
    return found.join(counts, key, "left").select(key, "score", F.coalesce("related", F.lit(0)).alias("related"))


def intelligent_mode(complexity: Column, methods: Column) -> Column:
    """Which search answers a question: advanced for a complex one, hybrid where many methods fit, else vectors."""
    return F.when(complexity > COMPLEX, "advanced").when(methods > MANY_METHODS, "hybrid").otherwise("vector")


def compared(results: DataFrame) -> DataFrame:
    """``query, found, common, own``: the results of each query (``query, fact_id``), those that all share, and the rest."""
    distinct = results.distinct()
    asked = distinct.agg(F.countDistinct("query").alias("queries"))
    shared = distinct.groupBy("fact_id").agg(F.count(F.lit(1)).alias("n")).crossJoin(F.broadcast(asked)).where("n = queries").select("fact_id", F.lit(1).alias("c"))
    beside = distinct.join(shared, "fact_id", "left")
    return beside.groupBy("query").agg(F.count(F.lit(1)).alias("found"), F.count("c").alias("common"), (F.count(F.lit(1)) - F.count("c")).alias("own"))


def trend(found: DataFrame, facts: DataFrame, first: int | None = None, last: int | None = None) -> DataFrame:
    """``year, n, mean, low, high`` of the values that a search found, within a span of years."""
    rows = found.select("fact_id").join(facts.select("fact_id", "year", "value"), "fact_id").where("year is not null and value is not null")
    rows = rows.where(F.col("year") >= first) if first is not None else rows
    rows = rows.where(F.col("year") <= last) if last is not None else rows
    return rows.groupBy("year").agg(F.count(F.lit(1)).alias("n"), (F.sum(F.col("value").cast("decimal(28,2)")).cast("double") / F.count(F.lit(1))).alias("mean"), F.min("value").alias("low"), F.max("value").alias("high"))


def data_filter(districts: list[str], years: list[int]) -> Column:
    """Rows of a statistics source, of a named district or of a named year."""
    source = F.lower(F.substring_index("source_document", "_", 1)).isin(DATA_SOURCES)
    return F.coalesce(source | F.col("district").isin(districts) | F.col("year").isin(years), F.lit(False))


def hierarchy_bucket(doc_type: Column) -> Column:
    low = F.lower(doc_type)
    return F.when(low.contains("act"), "acts").when(low.contains("rule"), "rules").when(low.contains("go"), "gos").otherwise("other")


def balanced(exploratory: DataFrame, cited: DataFrame, key: str) -> DataFrame:
    """``key, score, origin``: exploratory results and citations side by side; a key of both is ``both`` with its better score."""
    both = exploratory.select(key, "score", F.lit(1).alias("o")).unionByName(cited.select(key, "score", F.lit(2).alias("o")))
    out = both.groupBy(key).agg(F.max("score").alias("score"), F.sum("o").alias("o"))
    return out.select(key, "score", F.when(F.col("o") == 3, "both").when(F.col("o") == 1, "exploratory").otherwise("cited").alias("origin"))
