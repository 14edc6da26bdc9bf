"""Scores of results, claims and answers: column arithmetic."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.vocabulary import GENERIC_CLAIMS, HEDGES

NUMBERS = r"\b[0-9]+(?:\.[0-9]+)?%?"


def one(*terms: Column) -> Column:
    return F.least(F.lit(1.0), sum(terms, F.lit(0.0)))


def result_relevance(district: Column, indicator: Column, year: Column, value: Column, confidence: Column, entities: Column, statistical: Column) -> Column:
    low = F.transform(entities, F.lower)
    has = lambda c: F.coalesce(F.array_contains(low, F.lower(c)), F.lit(False)).cast("int")
    tenths = 3 * has(district) + 4 * has(indicator) + 2 * has(year.cast("string")) + 2 * (statistical & value.isNotNull()).cast("int")
    return one(tenths / F.lit(10.0), F.coalesce(confidence, F.lit(0.5)) * 0.3)


def verified(value: Column, indicator: Column, year: Column, confidence: Column, as_of_year: int) -> tuple[Column, Column]:
    """Confidence after three corrections, and its status."""
    low = F.lower(indicator)
    c = confidence * F.when(value < 0, 0.5).otherwise(1.0)
    c = c * F.when((low.contains("rate") | low.contains("percentage")) & (value > 100), 0.7).otherwise(1.0)
    c = c * F.when(~year.between(2000, as_of_year + 1), 0.6).otherwise(1.0)
    return c, F.when(c > 0.8, "verified").when(c > 0.5, "uncertain").otherwise("conflicting")


def rank_score(confidence: Column, kind: Column, source: Column, status: Column, value: Column) -> Column:
    statistical = kind == "statistical"
    matched = (statistical & (source == "table")) | (kind.isin("comparative", "temporal") & (source == "graph"))
    return one(0.4 * confidence, F.when(matched, 0.3).otherwise(0.0), F.when(status == "verified", 0.2).when(status == "uncertain", 0.1).otherwise(0.0), F.when(statistical & value.isNotNull(), 0.1).otherwise(0.0))


def consistency(facts: DataFrame) -> DataFrame:
    """``fact_id, consistency``: one less a third of the fact's z-score among its indicator's facts, from one aggregation."""
    stats = facts.groupBy("indicator").agg(F.count("value").alias("n"), F.avg("value").alias("mean"), F.stddev_pop("value").alias("deviation"))
    z = F.abs(F.col("value") - F.col("mean")) / F.col("deviation")
    score = F.when((F.col("n") < 2) | (F.col("deviation") == 0), 1.0).otherwise(F.greatest(F.lit(0.0), 1 - z / 3))
    return facts.join(F.broadcast(stats), "indicator").select("fact_id", score.alias("consistency"))


def query_relevance(score: Column, entities: Column, district: Column, indicator: Column, boosted: Column) -> Column:
    matches = F.size(F.filter(entities, lambda e: (e == F.concat(F.lit("district:"), F.lower(district))) | (e.startswith("indicator:") & F.contains(F.lower(indicator), F.substring(e, 11, 100)))))
    return one(F.coalesce(score, F.lit(0.5)), 0.2 * matches, F.when(boosted, 0.1).otherwise(0.0))


def sentences(text: Column) -> Column:
    return F.filter(F.transform(F.split(text, "[.!?]+"), lambda s: F.trim(s)), lambda s: F.length(s) > 20)


def claims(text: Column) -> Column:
    """Sentences of 20 characters or more that aren't attributions."""
    kept = F.filter(F.transform(F.split(text, "[.!?]+"), lambda s: F.trim(s)), lambda s: F.length(s) >= 20)
    return F.filter(kept, lambda s: ~F.lower(s).rlike("according to|based on|as per|source:"))


def hedging(text: Column) -> Column:
    """Share of factual sentences with a hedge."""
    words = "|".join(HEDGES)
    return F.size(F.filter(sentences(text), lambda s: F.lower(s).rlike(words))) / F.greatest(F.size(sentences(text)), F.lit(1))


def hallucination_risk(answer: Column, cited: Column) -> Column:
    """Unsupported numbers, definite words, generic claims and length, in hundredths."""
    numbers = lambda t: F.array_distinct(F.regexp_extract_all(t, F.lit(NUMBERS), F.lit(0)))
    low, corpus = F.lower(answer), F.lower(cited)
    risk = F.when(F.size(F.array_except(numbers(answer), numbers(cited))) > 2, 20).otherwise(0)
    risk = risk + F.when(low.rlike(r"\b(always|never|all|none|every|must|will definitely)\b|\b(it is certain|without doubt|undoubtedly)\b"), 10).otherwise(0)
    for phrase in GENERIC_CLAIMS:
        risk = risk + F.when(low.contains(phrase) & ~corpus.contains(phrase), 15).otherwise(0)
    count = lambda t: F.size(F.filter(F.split(t, r"\s+"), lambda w: w != ""))
    risk = risk + F.when(count(answer) > count(cited) * 1.5, 10).otherwise(0)
    return F.least(F.lit(100), risk) / F.lit(100.0)


def citation_confidence(coverage: Column, risk: Column, n: Column, least: int) -> Column:
    return 0.5 * coverage + 0.3 * (1 - risk) + 0.2 * F.least(n / F.lit(float(max(least, 1))), F.lit(1.0))


def numbers_agree(a: Column, b: Column) -> Column:
    return F.abs(a - b) / F.greatest(F.abs(b), F.lit(1.0)) <= 0.01
