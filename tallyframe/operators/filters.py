"""Filters, projections and column finders over facts and extracted tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.vocabulary import DISTRICTS, RANGES

# Words that mark a policy text, markers of application lists, words in value columns.
POLICY_WORDS = ["policy", "guideline", "directive", "instruction", "order", "education", "school", "teacher", "student", "curriculum", "enrolment", "dropout", "retention", "assessment", "evaluation"]
LIST_MARKERS = ["application id", "applicant name", "parent", "guardian", "school code", "admission", "student id", "roll number", "sl.no", "s.no", "serial number"]
VALUE_WORDS = ["boys", "girls", "total", "count", "number", "rate", "ratio"]


def any_of(text: Column, words: list[str]) -> Column:
    """Whether lower-cased text contains any of the words."""
    low = F.lower(text)
    out = F.lit(False)
    for w in words:
        out = out | low.contains(w)
    return out


def is_policy_text(text: Column) -> Column:
    return any_of(text, POLICY_WORDS) & (F.length(F.trim(text)) > 50)


def is_application_list(sample: Column) -> Column:
    """At least two of the eleven markers."""
    low = F.lower(sample)
    return sum((low.contains(w).cast("int") for w in LIST_MARKERS), F.lit(0)) >= 2


def is_table(rows: Column, n_rows: Column, n_cols: Column) -> Column:
    """Two rows and columns at least, and 30 % of the body's cells numeric without points and commas."""
    cells = F.flatten(F.slice(rows, 2, 1_000_000))
    numeric = F.filter(cells, lambda c: F.regexp_replace(c, "[.,]", "").rlike("^[0-9]+$"))
    return (n_rows >= 2) & (n_cols >= 2) & ((F.size(cells) == 0) | (F.size(numeric) >= 0.3 * F.size(cells)))


def with_fields(df: DataFrame, names: list[str]) -> DataFrame:
    """Rows whose named fields are all present."""
    for n in names:
        df = df.where(F.col(n).isNotNull())
    return df


def ranges(df: DataFrame) -> DataFrame:
    """The indicators' ranges as a frame of 22 rows."""
    return df.sparkSession.createDataFrame(RANGES, "indicator string, low double, high double, expected_unit string")


def valid_normalised(facts: DataFrame) -> DataFrame:
    """District known, and the value within the range of its indicator if that has one."""
    known = facts.join(F.broadcast(ranges(facts)), "indicator", "left")
    return known.where((F.col("low").isNull() | F.col("value").between(F.col("low"), F.col("high"))) & (F.col("district") != "Unknown")).select(facts.columns)


def valid_facts(facts: DataFrame, as_of_year: int) -> DataFrame:
    """Ids and names present, year 2000 to next year, value not negative, district canonical or unknown."""
    named = [F.coalesce(F.col(c), F.lit("")) != "" for c in ("fact_id", "district", "indicator")]
    return facts.where(named[0] & named[1] & named[2] & F.col("year").between(2000, as_of_year + 1) & (F.col("value") >= 0) & F.col("district").isin([*DISTRICTS, "Unknown"]))


def truthy_facts(facts: DataFrame) -> DataFrame:
    """Facts without an empty field; a value or year of 0 counts as empty."""
    ok = F.lit(True)
    for c in ("fact_id", "district", "indicator"):
        ok = ok & (F.coalesce(F.col(c), F.lit("")) != "")
    return facts.where(ok & (F.coalesce(F.col("value"), F.lit(0.0)) != 0) & (F.coalesce(F.col("year"), F.lit(0)) != 0))


def prepared_facts(facts: DataFrame) -> DataFrame:
    """The store's columns with its defaults."""
    return facts.select(
        "fact_id", "district", "indicator", F.col("year").cast("int").alias("year"), F.col("value").cast("double").alias("value"),
        F.coalesce("unit", F.lit("N/A")).alias("unit"), F.coalesce("category", F.lit("N/A")).alias("category"),
        F.coalesce("source_document", F.lit("N/A")).alias("source"), F.coalesce("source_page", F.lit(0)).alias("page"), F.coalesce("confidence_score", F.lit(0.0)).alias("confidence"),
    )


def accepted_points(facts: DataFrame, least: float = 0.7) -> DataFrame:
    """Known indicators with district and year; a value out of range halves the confidence, and ``least`` is needed."""
    known = facts.join(F.broadcast(ranges(facts)), "indicator").where("district is not null and year is not null")
    halved = F.when(F.col("value").between(F.col("low"), F.col("high")), F.col("confidence_score")).otherwise(F.col("confidence_score") * 0.5)
    return known.withColumn("confidence", halved).where(F.col("confidence") >= least).select("fact_id", "confidence")


def by_indicator(facts: DataFrame, indicator: str, district: str | None = None, year: int | None = None) -> DataFrame:
    """Equality on the given dimensions; an empty district and year 0 are not given."""
    out = facts.where(F.col("indicator") == indicator)
    out = out.where(F.col("district") == district) if district else out
    return out.where(F.col("year") == year) if year else out


def in_years(facts: DataFrame, first: int, last: int, districts: list[str], indicators: list[str]) -> DataFrame:
    """Years in a range, and any of the districts and of the indicators where some are given."""
    out = facts.where(F.col("year").between(first, last))
    out = out.where(F.col("district").isin(districts)) if districts else out
    return out.where(F.col("indicator").isin(indicators)) if indicators else out


def from_sources(facts: DataFrame, prefixes: list[str], district: str, year: int, widen: bool) -> DataFrame:
    """Facts of some sources; with ``widen`` the district and year add rows (as observed), else they narrow (as meant)."""
    source = F.lit(False)
    for p in prefixes:
        source = source | F.col("source_document").startswith(p)
    here, then = F.col("district") == district, F.col("year") == year
    return facts.where(source | here | then if widen else source & here & then)


def district_column(headers: Column) -> Column:
    """Position from 1 of the first header that names districts, 0 if none."""
    return F.array_position(F.transform(headers, lambda h: any_of(h, [d.lower() for d in DISTRICTS] + ["district", "mandal"])), True)


def value_columns(headers: Column) -> Column:
    """Positions from 1 of the headers that hold values."""
    return F.filter(F.transform(headers, lambda h, i: F.when(any_of(h, VALUE_WORDS), i + 1)), lambda i: i.isNotNull())


def find_column(columns: list[str], words: list[str]) -> str | None:
    """The first column whose lower-cased name contains any of the words."""
    return next((c for c in columns if any(w in c.lower() for w in words)), None)


def header_with(headers: Column, words: list[str]) -> Column:
    """The first header that contains any of the words in lower case, null if none does; null headers are passed over."""
    return F.get(F.filter(headers, lambda h: F.coalesce(any_of(h, words), F.lit(False))), F.lit(0))


def district_header(headers: Column) -> Column:
    """Place from 0 of the first header with a word for districts or a district's name, null if none."""
    place = F.array_position(F.transform(headers, lambda h: any_of(h, ["district", "dist", "area", "region", *[d.lower() for d in DISTRICTS]])), True)
    return F.when(place > 0, (place - 1).cast("int"))


def is_table_item(method: Column, headers: Column, rows: Column, table_id: Column) -> Column:
    """Whether an extracted item is a table: by its method, or by having headers, rows or a table's id."""
    return F.coalesce(method.isin("camelot_stream", "camelot_lattice", "ocr_tesseract"), F.lit(False)) | headers.isNotNull() | rows.isNotNull() | table_id.isNotNull()


def bank_filter(bank: DataFrame, id: str | None = None, category: str | None = None, difficulty: str | None = None) -> DataFrame:
    """Questions of a bank by id, category and difficulty, where given."""
    for name, value in (("id", id), ("category", category), ("difficulty", difficulty)):
        bank = bank.where(F.col(name) == value) if value is not None else bank
    return bank
