"""Parsing of values, years, categories, units and districts, and tables into facts."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import vocabulary as V

# Percentages in text and what they measure; labels with numbers.
PERCENT_PATTERNS = [r"([0-9]+(?:\.[0-9]+)?)%\s+(dropout|retention|enrolment|enrollment|literacy)"]
LABELLED = r"([A-Z][a-z]+(?:\s[A-Z][a-z]+)*)[:\s]+([0-9]+(?:,[0-9]{3})*(?:\.[0-9]+)?)"


def number(text: Column) -> Column:
    """The first number without commas, percent signs and stars."""
    return F.nullif(F.regexp_extract(F.regexp_replace(text, "[,%*]", ""), r"([0-9.]+)", 1), F.lit("")).try_cast("double")


def grouped_number(text: Column) -> Column:
    """The first number with its thousands commas, letters dropped first."""
    found = F.regexp_extract(F.regexp_replace(text, r"[^0-9.,%\s-]", ""), r"([0-9,]+(?:\.[0-9]+)?)", 1)
    return F.nullif(F.regexp_replace(found, ",", ""), F.lit("")).try_cast("double")


def ladder(text: Column, pairs: list[tuple[str, str]], default: str | None) -> Column:
    """The value of the first key, in order, that stands in lower-cased text."""
    low, out = F.lower(text), F.lit(default)
    for key, value in reversed(pairs):
        out = F.when(low.contains(key), value).otherwise(out)
    return out


def spelled(names: dict[str, list[str]]) -> list[tuple[str, str]]:
    return [(k, name) for name, keys in names.items() for k in keys]


def category(text: Column) -> Column:
    return ladder(text, spelled(V.CATEGORY_SPELLINGS), None)


def category_first(text: Column) -> Column:
    return ladder(text, V.CATEGORY_FIRST, "total")


def unit(text: Column) -> Column:
    return ladder(text, V.UNIT_SPELLINGS, "count")


def unit_first(text: Column) -> Column:
    return ladder(text, [("%", "percentage"), ("percentage", "percentage"), ("ratio", "ratio"), ("count", "count"), ("number", "count"), ("total", "count")], "unknown")


def source_kind(path: Column) -> Column:
    return ladder(path, [("cse", "CSE"), ("scert", "SCERT"), ("go", "GO")], "Unknown")


def year_of_text(text: Column, as_of_year: int, default: int = 2023) -> Column:
    """The first of four patterns that gives a year from 2000 to next year."""
    patterns = [r"\b(20[12][0-9])[-–—][0-9]{2}\b", r"\b(20[12][0-9])\b", r"\bYear[:\s]+(20[12][0-9])\b", r"\b(20[01][0-9])\b"]
    each = [F.nullif(F.regexp_extract(text, p, 1), F.lit("")).cast("int") for p in patterns]
    return F.coalesce(*[F.when(y.between(2000, as_of_year + 1), y) for y in each], F.lit(default))


def year_of_name(name: Column, default: int) -> Column:
    return F.coalesce(F.nullif(F.regexp_extract(name, "([0-9]{4})", 1), F.lit("")).cast("int"), F.lit(default))


def district_in(text: Column) -> Column:
    return ladder(text, spelled(V.DISTRICT_SPELLINGS), None)


def canonical(rows: DataFrame, column: str, names: dict[str, list[str]], to: str) -> DataFrame:
    """Exact spellings to names by a join with the vocabulary, whose size is fixed."""
    vocabulary = rows.sparkSession.createDataFrame(spelled(names), f"__k string, {to} string")
    return rows.join(F.broadcast(vocabulary), F.lower(F.trim(column)) == F.col("__k"), "left").drop("__k")


def fuzzy(rows: DataFrame, column: str, names: dict[str, list[str]], to: str, score: Callable[[str, str], float], least: float) -> DataFrame:
    """The best-scoring spelling's name for each distinct value (the earlier on ties), null under ``least``.

    Distinct values are scored once in Arrow batches and joined back.
    """
    pairs = spelled(names)

    @F.pandas_udf("string")
    def match(values: pd.Series) -> pd.Series:
        def one(v: str | None) -> str | None:
            best, name = least, None
            for k, n in pairs:
                s = score((v or "").lower().strip(), k)
                if s > best or (s == best and name is None):
                    best, name = s, n
            return name

        return values.map(one)

    known = rows.select(column).distinct().withColumn(to, match(column))
    return rows.join(known, column, "left")


def facts_of_tables(tables: DataFrame, parse: Callable[[Column], Column] = number) -> DataFrame:
    """``table_id, row, column, district, header, value``: every cell beside the first column whose value parses."""
    rows = tables.select("table_id", "headers", F.posexplode("rows").alias("row", "cells"))
    cells = rows.select("table_id", "row", "headers", F.col("cells")[0].alias("district"), F.posexplode("cells").alias("column", "cell")).where("column > 0")
    return cells.select("table_id", "row", "column", "district", F.get("headers", F.col("column")).alias("header"), parse(F.col("cell")).alias("value")).where("value is not null")


def percent_facts(docs: DataFrame) -> DataFrame:
    """``doc_id, indicator, value`` of percentages in text."""
    each = F.explode(F.arrays_zip(*[F.regexp_extract_all(F.lower("text"), F.lit(PERCENT_PATTERNS[0]), F.lit(g)).alias(f"g{g}") for g in (1, 2)]))
    return docs.select("doc_id", each.alias("m")).select("doc_id", F.col("m.g2").alias("indicator"), F.col("m.g1").cast("double").alias("value"))


def labelled_facts(docs: DataFrame) -> DataFrame:
    """``doc_id, label, district, indicator, value`` of labels followed by numbers that name either."""
    each = F.explode(F.arrays_zip(*[F.regexp_extract_all("text", F.lit(LABELLED), F.lit(g)).alias(f"g{g}") for g in (1, 2)]))
    m = docs.select("doc_id", each.alias("m")).select("doc_id", F.col("m.g1").alias("label"), F.regexp_replace("m.g2", ",", "").cast("double").alias("value"))
    return canonical(canonical(m, "label", V.DISTRICT_SPELLINGS, "district"), "label", V.INDICATOR_SPELLINGS, "indicator").where("district is not null or indicator is not null")


def year_or_span(text: Column) -> Column:
    """The first year of 1900 to 2099 that stands as a word; a span like 2016-17 gives its first year."""
    return F.nullif(F.regexp_extract(text, r"\b((?:19|20)[0-9]{2})\b", 1), F.lit("")).cast("int")


def year_of_items(items: DataFrame, as_of_year: int, default: int = 2023) -> DataFrame:
    """``doc_id, year``: the year of a document's first item (doc_id, ord, year) from 2010 to now, else the default.

    An item without a year counts as one of the default year, so the first item decides.
    """
    filled = items.withColumn("year", F.coalesce("year", F.lit(default)))
    fine = F.col("year").between(2010, as_of_year)
    return filled.groupBy("doc_id").agg(F.coalesce(F.min_by(F.when(fine, F.col("year")), F.when(fine, F.col("ord"))), F.lit(default)).alias("year"))


def numbered_facts(docs: DataFrame) -> DataFrame:
    """``fact_id, indicator, value`` of percentages in text, numbered from 1 in each text as ``FCT_<id>_<n>``."""
    pairs = F.arrays_zip(*[F.regexp_extract_all(F.lower("text"), F.lit(PERCENT_PATTERNS[0]), F.lit(g)).alias(f"g{g}") for g in (1, 2)])
    each = docs.select("doc_id", F.posexplode(pairs).alias("i", "m"))
    return each.select(F.concat_ws("_", F.lit("FCT"), F.col("doc_id").cast("string"), (F.col("i") + 1).cast("string")).alias("fact_id"), F.col("m.g2").alias("indicator"), F.col("m.g1").cast("double").alias("value"))


def resolved_facts(tables: DataFrame, district_at: Column, confidence: float = 0.9) -> DataFrame:
    """``table_id, row, district, indicator, value, confidence`` of tables (table_id, headers, rows).

    Every cell outside the district's column whose value parses, whose header names a known indicator and whose row a
    known district. ``district_at`` is the column's place from 0; a table without one gives no facts.
    """
    rows = tables.withColumn("at", district_at).where("at is not null").select("table_id", "headers", "at", F.posexplode("rows").alias("row", "cells"))
    cells = rows.select("table_id", "row", "headers", "at", F.get("cells", F.col("at")).alias("place"), F.posexplode("cells").alias("column", "cell")).where("column <> at")
    parsed = cells.select("table_id", "row", "place", F.get("headers", F.col("column")).alias("header"), grouped_number(F.col("cell")).alias("value")).where("value is not null")
    known = canonical(canonical(parsed, "place", V.DISTRICT_SPELLINGS, "district"), "header", V.INDICATOR_SPELLINGS, "indicator")
    return known.where("district is not null and indicator is not null").select("table_id", "row", "district", "indicator", "value", F.lit(confidence).alias("confidence"))


def table_route(headers: Column, rows: Column, structured_facts: Column, text: Column) -> Column:
    """How a table item is read: by its structure if that yields facts, else by its text if it has any."""
    structured = headers.isNotNull() & rows.isNotNull() & (F.coalesce(structured_facts, F.lit(0)) > 0)
    return F.when(structured, "structured").when(text.isNotNull(), "text").otherwise("none")
