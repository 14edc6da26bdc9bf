"""An inverted index as tables: written once, pruned by term, and asked many questions in one join.

``postings`` holds ``h, term, key, n, f`` (the term's hash, the document's length and the occurrences). Each file holds
some documents' rows, so that a common term's lie in many, sorted by the hash, a number, so that a question's terms reach
the scan as a filter. ``terms`` holds each term's documents and the most that it adds to any score.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.tables import stored
from .retrieval import B, K1, tokens
from .windows import top_per_group

#: Distinct terms of all questions that are handed to the scan as a filter; more are only joined.
FILTERED = 1000
#: Scores that differ by less are the same.
SMALL = 1e-9


@dataclass(frozen=True)
class Index:
    """An index's tables, the number of documents and their mean length."""

    key: str
    postings: DataFrame
    terms: DataFrame
    docs: int
    mean: float


def rarity(docs: int) -> Column:
    return F.log(1 + (docs - F.col("d") + 0.5) / (F.col("d") + 0.5))


def saturation(mean: float) -> Column:
    return F.col("f") * (K1 + 1) / (F.col("f") + K1 * (1 - B + B * F.col("n") / mean))


def impact(docs: int, mean: float) -> Column:
    """What a term adds to a document's score: its rarity by its saturated frequency."""
    return rarity(docs) * F.col("f") * (K1 + 1) / (F.col("f") + K1 * (1 - B + B * F.col("n") / mean))


def counted(docs: DataFrame, key: str, column: str) -> DataFrame:
    """``key, n, term, f``: each text's words with their occurrences, counted inside its row as runs of its sorted words.

    The runs are exploded as an outer generator: for a plain one, Spark would put a filter below that splits texts again.
    """
    words = docs.select(F.col(key).alias("key"), F.sort_array(tokens(F.col(column))).alias("w"))
    ends = F.array_compact(F.transform("w", lambda x, i: F.when(~x.eqNullSafe(F.get("w", i + 1)), i + 1)))
    runs = words.select("key", F.size("w").alias("n"), "w", ends.alias("ends"))
    each = runs.select("key", "n", "w", "ends", F.posexplode_outer("ends").alias("i", "end")).where("end is not null")
    return each.select("key", "n", F.get("w", F.col("end") - 1).alias("term"), (F.col("end") - F.coalesce(F.get("ends", F.col("i") - 1), F.lit(0))).cast("long").alias("f"))


def build(docs: DataFrame, key: str, column: str) -> Index:
    """Indexes a text column by its words (of a-z and 0-9, in lower case). Null texts count as documents without words.

    Texts are split once and their counts written where they were made; only if keys repeat are they shuffled, as rows of
    one key and length count as one. The mean length comes from the postings, as a text's words are the sum of its counts.
    """
    size = docs.agg(F.count(F.lit(1)).alias("docs"), F.count(column).alias("texts")).first()
    rows = counted(docs, key, column).withColumn("h", F.xxhash64("term"))
    if not docs.groupBy(key).count().where("count > 1").isEmpty():
        rows = rows.repartition("h", "key").groupBy("h", "term", "key", "n").agg(F.sum("f").alias("f"))
    postings = stored(rows.sortWithinPartitions("h"), "postings")
    mean = (postings.agg(F.sum("f")).first()[0] or 0) / (size.texts or 1) or 1.0
    held = postings.groupBy("h", "term").agg(F.count(F.lit(1)).alias("d"), F.max(saturation(mean)).alias("most"))
    terms = stored(held.select("term", "d", (rarity(size.docs) * F.col("most")).alias("most")), "terms")
    return Index(key, postings, terms, size.docs, mean)


def answers(index: Index, questions: DataFrame, k: int) -> DataFrame:
    """``question, <key>, score, rank``: the ``k`` best documents of each question (``question, term``), ties to the smaller key.

    The term that can add most gives a score that ``k`` documents reach at least. Terms that together add less than
    that can't bring a document in by themselves: only documents of the other terms are scored, by all terms.
    """
    asked = questions.select("question", F.lower("term").alias("term")).where("term is not null").distinct()
    postings, terms = index.postings, index.terms
    few = [r.term for r in asked.select("term").distinct().limit(FILTERED + 1).collect()]
    if len(few) <= FILTERED:
        hashes = [F.xxhash64(F.lit(t)) for t in few]
        postings, terms = postings.where(F.col("h").isin(hashes) & F.col("term").isin(few)), terms.where(F.col("term").isin(few))
    known = asked.join(terms, "term")
    scores = postings.join(known, "term").select("question", "term", "key", "most", F.round(impact(index.docs, index.mean), 12).alias("s"))
    lead = known.groupBy("question").agg(F.max_by("term", F.struct("most", "term")).alias("term"))
    reached = top_per_group(scores.join(lead, ["question", "term"]), ["question"], [F.desc("s"), "key"], k).groupBy("question").agg(F.count(F.lit(1)).alias("have"), F.min("s").alias("floor"))
    # each term with what it and the weaker ones add together
    mine = known.select("question", "term", "most")
    weaker = known.select("question", F.col("term").alias("other"), F.col("most").alias("less"))
    sums = mine.join(weaker, "question").where((F.col("less") < F.col("most")) | ((F.col("less") == F.col("most")) & (F.col("other") <= F.col("term")))).groupBy("question", "term").agg(F.sum("less").alias("together"))
    floor = F.when(F.col("have") == k, F.col("floor")).otherwise(0.0)
    needed = sums.join(reached, "question").where(F.col("together") + SMALL >= floor).select("question", "term")
    candidates = scores.join(needed, ["question", "term"], "left_semi").select("question", "key").distinct()
    found = scores.join(candidates, ["question", "key"], "left_semi").groupBy("question", "key").agg(F.round(F.sum("s"), 9).alias("score"))
    return top_per_group(found, ["question"], [F.desc("score"), "key"], k).select("question", F.col("key").alias(index.key), "score", "rank")
