"""Titles, sections, clauses and parents of legal documents, order entities, and texts made for search and answers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .legal import found

# Numbered and lettered paragraphs with their continuation lines, parents, orders, school names.
CLAUSE = r"(?:^|\n)(\d+)\.\s+([^\n]+(?:\n(?!\d+\.)[^\n]+)*)"
LETTERED = r"\(([a-z])\)\s+([^\n]+(?:\n(?!\([a-z]\))[^\n]+)*)"
SECTIONED = r"(?i)(?:Section|Article|Chapter)\s+(\d+[A-Z]?)[\s:.-]+([^\n]+(?:\n(?!(?:Section|Article|Chapter)\s+\d)[^\n]+)*)"
PARENT_ACT = r"([A-Z][A-Za-z\s,]+(?:Act|LAW),?\s*\d{4})"
PARENT_RULE = r"([A-Z][A-Za-z\s]+Rules?,?\s*\d{4})"
ORDER_NUMBER = r"(?i)G\.O\.(?:MS\.)?\s*No\.?\s*(\d+)"
DEPARTMENT = r"(?i)Department[:\s]+([A-Za-z\s&,]+)"
ORDER_DISTRICTS = ["Krishna", "Guntur", "Prakasam", "Nellore", "Chittoor"]
SCHOOL_NAMES = [r"(?i)([A-Z][A-Z\s]+(?:SCHOOL|COLLEGE|ACADEMY))", r"(?i)(\w+\s+(?:EM|ENGLISH|HIGH)\s+SCHOOL)", r"(?i)(SRI\s+\w+\s+\w+\s+SCHOOL)"]


def paragraphs(docs: DataFrame, pattern: str) -> DataFrame:
    """``doc_id, number, text``; the last paragraph of a number counts."""
    return found(docs, pattern, 2).groupBy("doc_id", F.col("g1").alias("number")).agg(F.max_by(F.trim("g2"), "ordinal").alias("text"))


def first(text: Column, pattern: str) -> Column:
    return F.nullif(F.regexp_extract(text, pattern, 1), F.lit(""))


def order_entities(docs: DataFrame) -> DataFrame:
    """``doc_id, go_number, department, district`` of an order's text."""
    low, district = F.lower("text"), F.lit(None).cast("string")
    for d in reversed(ORDER_DISTRICTS):
        district = F.when(low.contains(d.lower()), d).otherwise(district)
    return docs.select("doc_id", first(F.col("text"), ORDER_NUMBER).alias("go_number"), F.trim(first(F.col("text"), DEPARTMENT)).alias("department"), district.alias("district"))


def order_facts(entities: DataFrame, year: int) -> DataFrame:
    """Orders as facts of value 1."""
    number = F.coalesce("go_number", F.lit("unknown"))
    return entities.select(
        F.concat(F.lit("AP_GO_"), number).alias("fact_id"), F.coalesce("district", F.lit("Unknown")).alias("district"), F.lit("Government Order").alias("indicator"), F.lit(year).alias("year"), F.lit(1.0).alias("value"), F.concat(F.lit("AP_GO_"), number).alias("source_document")
    )


def school_names(text: Column) -> Column:
    """Names by the first pattern that finds any, in title case."""
    each = [F.regexp_extract_all(text, F.lit(p), F.lit(1)) for p in SCHOOL_NAMES]
    out = F.array().cast("array<string>")
    for e in reversed(each):
        out = F.when(F.size(e) > 0, e).otherwise(out)
    return F.transform(out, lambda s: F.initcap(s))


def indicator_code(text: Column) -> Column:
    """A ladder of substrings: "school" holds "sc" and so do its dropouts."""
    low = F.lower(text)
    has = low.contains
    return (
        F.when(has("dropout"), F.when(has("sc"), "DROPOUT_SC").when(has("st"), "DROPOUT_ST").otherwise("DROPOUT_RATE"))
        .when(has("enroll"), F.when(has("sc"), "ENROLL_SC").when(has("st"), "ENROLL_ST").when(has("girl") | has("female"), "ENROLL_GIRL").otherwise("ENROLL_TOTAL"))
        .when(has("school"), F.when(has("govt") | has("government"), "SCHOOLS_GOVT").when(has("private"), "SCHOOLS_PRIVATE").otherwise("SCHOOLS_TOTAL"))
        .when(has("teacher"), F.when(has("ratio") | has("ptr"), "PTR").otherwise("TEACHERS_TOTAL"))
        .when(has("budget"), F.when(has("expend"), "BUDGET_EXPENDITURE").otherwise("BUDGET_ALLOCATION"))
    )


def searchable(indicator: Column, value: Column, unit: Column, district: Column, year: Column, source: Column) -> Column:
    return F.concat(indicator, F.lit(" is "), value, F.lit(" "), unit, F.lit(" in "), district, F.lit(" for "), year.cast("string"), F.lit(". This data pertains to education statistics in Andhra Pradesh. Source: "), source)


def reason(kind: str, a: Column, b: Column) -> Column:
    """Why two facts are linked."""
    if kind == "district_year":
        return F.concat(F.lit("Same district ("), a["district"], F.lit(") and year ("), a["year"].cast("string"), F.lit(")"))
    if kind == "indicator_temporal":
        return F.concat(F.lit("Same indicator ("), a["indicator"], F.lit(") across years "), a["year"].cast("string"), F.lit("-"), b["year"].cast("string"))
    if kind == "cross_district":
        return F.concat(F.lit("Comparison of "), a["indicator"], F.lit(" between "), a["district"], F.lit(" and "), b["district"])
    return F.lit("Related policy documents")


def explanation(relevance: Column, kind: Column) -> Column:
    lead = F.when(relevance > 0.8, "Highly relevant to your query").when(relevance > 0.6, "Good match for your query").otherwise("Related to your search terms")
    more = F.when(kind == "comparison", "Suitable for comparison analysis").when(kind == "temporal", "Contains temporal/trend information").when(kind == "statistical", "Contains statistical data")
    return F.concat(F.concat_ws(". ", lead, more), F.lit("."))


def plain(text: Column) -> Column:
    """Text without bold and underline marks."""
    return F.regexp_replace(text, r"\*\*|__", "")


def iso_date(text: Column) -> Column:
    """A date in one of four forms, month first where a number could be either, as ISO; else the text."""
    parsed = F.coalesce(*[F.try_to_date(text, p) for p in ("yyyy-MM-dd", "M/d/yyyy", "d/M/yyyy", "d MMMM yyyy")])
    return F.coalesce(F.date_format(parsed, "yyyy-MM-dd"), text)


def described(docs: DataFrame) -> DataFrame:
    """``doc_id, kind, number, department, sections, clauses, act, rule`` of documents (doc_id, kind, text).

    Orders are read for number, department, clauses and both parents, acts for sections, rules for clauses and the act
    above them; a generic document has none of them.
    """
    text, order, act, rule = F.col("text"), F.col("kind") == "order", F.col("kind") == "act", F.col("kind") == "rule"
    above = F.when(order | rule, first(text, PARENT_ACT)), F.when(order, first(text, PARENT_RULE))
    count = lambda pattern: F.regexp_count(text, F.lit(pattern))
    return docs.select(
        "doc_id", "kind", F.when(order, first(text, ORDER_NUMBER)).alias("number"), F.when(order, F.trim(first(text, DEPARTMENT))).alias("department"), F.when(act, count(SECTIONED)).otherwise(0).alias("sections"),
        F.when(order, count(CLAUSE)).when(rule, count(LETTERED)).otherwise(0).alias("clauses"), above[0].alias("act"), above[1].alias("rule"),
    )
