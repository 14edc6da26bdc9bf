"""Strategies that read tables out of running text, the first valid one winning.

Each strategy gives ``struct(headers, rows, method, confidence)`` or null; ``parsed`` takes the first that validates.
Rows of districts come in alphabetical order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.vocabulary import DISTRICTS
from .filters import any_of

# Gates and patterns of the strategies.
NUMBER = r"[0-9]+(?:,[0-9]{3})*(?:\.[0-9]+)?"
STATISTICS = ["enrollment", "enrolment", "teachers", "schools", "students", "boys", "girls"]
MONEY = ["budget", "allocation", "amount", "crore", "lakh", "rupees"]
APPLICATION = r"(?i)([0-9]+)\s+([A-Za-z\s]+?)\s+(AP[0-9]{12})\s+([A-Za-z\s]+?)(?=[0-9]+\s+|$)"
AMOUNT = r"([0-9]+(?:\.[0-9]+)?)\s*(crore|lakh|rupees?)"
NUMBERED = r"([0-9]+)\s+(.*?)(?=[0-9]+\s+|$)"
SHORTEST = 20


def result(headers: Column, rows: Column, method: str, confidence: float) -> Column:
    return F.struct(headers.alias("headers"), rows.alias("rows"), F.lit(method).alias("method"), F.lit(confidence).alias("confidence"))


def words(*names: str) -> Column:
    return F.array(*map(F.lit, names))


def lines(text: Column) -> Column:
    return F.split(F.trim(text), "\n")


def headers_of(line: Column) -> Column:
    """Up to ten headers: parts between two spaces or tabs, else words."""
    wide = F.filter(F.split(F.trim(line), r"\s{2,}|\t"), lambda s: s != "")
    single = F.filter(F.split(F.trim(line), r"\s+"), lambda s: s != "")
    return F.slice(F.when(F.size(wide) >= 2, wide).otherwise(single), 1, 10)


def cells_of(row: Column) -> Column:
    wide = F.filter(F.split(F.trim(row), r"\s{2,}|\t"), lambda s: s != "")
    return F.when(F.size(wide) >= 2, wide).otherwise(F.filter(F.split(F.trim(row), r"\s+"), lambda s: s != ""))


def numbered(text: Column) -> Column:
    rest = F.when(F.size(lines(text)) > 1, F.array_join(F.slice(lines(text), 2, 1_000_000), " ")).otherwise(text)
    pairs = F.arrays_zip(F.regexp_extract_all(rest, F.lit(NUMBERED), F.lit(1)).alias("n"), F.regexp_extract_all(rest, F.lit(NUMBERED), F.lit(2)).alias("r"))
    rows = F.transform(F.filter(pairs, lambda p: F.trim(p["r"]) != ""), lambda p: F.concat(F.array(p["n"]), cells_of(p["r"])))
    return F.when(F.lower(text).rlike(r"sl\.?no|s\.?no|serial") & (F.size(rows) > 0), result(headers_of(lines(text)[0]), rows, "numbered_list", 0.8))


def by_district(text: Column) -> Column:
    """The numbers between a district's name and the next name."""
    names = [d.lower() for d in sorted(DISTRICTS)]
    low, others = F.lower(text), "|".join(names)
    found = []
    for name in names:
        span = F.regexp_extract(low, rf"(?s)\b{name}\b(.*?)(?=\b(?:{others})\b|$)", 1)
        numbers = F.regexp_extract_all(span, F.lit(f"({NUMBER})"), F.lit(1))
        found.append(F.when(F.size(numbers) > 0, F.array(F.lit(name.title()), numbers[0], F.array_join(F.slice(numbers, 2, 1_000_000), ", "))))
    rows = F.array_compact(F.array(*found))
    return F.when(F.size(rows) >= 2, result(words("District", "Value", "Additional Info"), rows, "district_table", 0.7))


def applications(text: Column) -> Column:
    parts = F.arrays_zip(*[F.regexp_extract_all(text, F.lit(APPLICATION), F.lit(g)).alias(f"g{g}") for g in range(1, 5)])
    rows = F.transform(parts, lambda m: F.array(*[F.trim(m[f"g{g}"]) for g in range(1, 5)]))
    return F.when((F.regexp_count(text, F.lit("AP[0-9]{12}")) >= 2) & (F.size(rows) > 0), result(words("Serial", "District", "Application ID", "Applicant Name"), rows, "application_table", 0.9))


def statistics(text: Column) -> Column:
    each = F.transform(lines(text), lambda s: F.concat(F.array(F.trim(F.regexp_extract(s, r"^([^0-9]*)", 1))), F.regexp_extract_all(s, F.lit(f"({NUMBER})"), F.lit(1))))
    kept = F.filter(each, lambda r: (F.size(r) >= 3) & (r[0] != ""))
    width = F.array_max(F.transform(kept, lambda r: F.size(r)))
    rows = F.transform(kept, lambda r: F.concat(r, F.array_repeat(F.lit(""), width - F.size(r))))
    headers = F.concat(F.array(F.lit("Indicator")), F.transform(F.sequence(F.lit(1), F.greatest(width - 1, F.lit(1))), lambda i: F.concat(F.lit("Value_"), i.cast("string"))))
    return F.when(any_of(text, STATISTICS) & (F.size(kept) >= 2), result(headers, rows, "statistical_table", 0.6))


def budgets(text: Column) -> Column:
    each = F.transform(lines(text), lambda s: F.array(F.trim(F.regexp_extract(s, rf"(?i)^(.*?){AMOUNT}", 1)), F.regexp_extract(F.lower(s), AMOUNT, 1), F.regexp_extract(F.lower(s), AMOUNT, 2)))
    rows = F.filter(each, lambda r: (r[0] != "") & (r[1] != ""))
    return F.when(any_of(text, MONEY) & (F.size(rows) >= 2), result(words("Scheme/Department", "Allocation", "Currency"), rows, "budget_table", 0.7))


def valid(t: Column) -> Column:
    """Two headers, one row, rows as wide as the headers, and at least as many filled cells as rows."""
    same = F.forall(t["rows"], lambda r: F.size(r) == F.size(t["headers"]))
    filled = F.size(F.filter(F.flatten(t["rows"]), lambda c: F.trim(c) != ""))
    return F.coalesce((F.size(t["headers"]) >= 2) & (F.size(t["rows"]) >= 1) & same & (filled >= F.size(t["rows"])), F.lit(False))


def parsed(docs: DataFrame, key: str, text: str) -> DataFrame:
    """``key, headers, rows, method, confidence`` of the texts that hold a table; shorter than 20 characters hold none."""
    names = ["numbered", "by_district", "applications", "statistics", "budgets"]
    t = F.col(text)
    tried = docs.where(F.length(F.trim(t)) >= SHORTEST).select(key, *[f(t).alias(n) for n, f in zip(names, (numbered, by_district, applications, statistics, budgets), strict=True)])
    best = F.coalesce(*[F.when(valid(F.col(n)), F.col(n)) for n in names])
    return tried.select(key, best.alias("t")).where("t is not null").select(key, "t.*")


def well_structured(headers: Column) -> Column:
    """Whether at least half of the headers are longer than one character and no numbers."""
    fine = F.size(F.filter(headers, lambda h: (F.length(F.trim(h)) > 1) & ~F.trim(h).rlike("^[0-9.,]+$")))
    return (F.size(headers) > 0) & (fine >= 0.5 * F.size(headers))


def clean_headers(headers: Column) -> Column:
    return F.transform(headers, lambda h: F.trim(F.regexp_replace(h, r"\s+", " ")))


def caption(rows: Column) -> Column:
    """The first of the first three rows that reads like a caption."""
    joined = F.transform(F.slice(rows, 1, 3), lambda r: F.array_join(r, " "))
    return F.get(F.filter(joined, lambda s: F.lower(s).rlike("table|figure|enrolment|statistics")), 0)


def ocr_table(text: Column) -> Column:
    """``struct(headers, rows)`` of lines of two words or more, the first being the headers; null with fewer than two."""
    cells = F.filter(F.transform(F.split(F.trim(text), "\n"), lambda s: F.filter(F.split(s, r"\s+"), lambda w: w != "")), lambda r: F.size(r) >= 2)
    return F.when((F.size(F.split(F.trim(text), "\n")) >= 2) & (F.size(cells) >= 2), F.struct(cells[0].alias("headers"), F.slice(cells, 2, 1_000_000).alias("rows")))


def running_text(headers: Column, rows: Column) -> Column:
    """A table's headers and rows as lines of words; null without rows."""
    head = F.when(F.size(headers) > 0, F.array_join(headers, " "))
    line = F.transform(F.filter(rows, lambda r: F.size(r) > 0), lambda r: F.array_join(F.filter(r, lambda c: c != ""), " "))
    return F.when(F.size(rows) > 0, F.concat_ws("\n", head, F.array_join(line, "\n")))


def enhanced(items: DataFrame, key: str) -> DataFrame:
    """Table items (key, extraction_method, headers, rows) with better structure, and ``outcome``.

    Other kinds of items are skipped, well-structured ones stay, and the rest is written out as text and parsed anew;
    an item whose text holds no table keeps what it has.
    """
    kind = F.coalesce(F.col("extraction_method").isin("camelot_stream", "ocr_tesseract"), F.lit(False))
    fine = F.coalesce((F.size("rows") > 0) & (F.size(F.filter("headers", lambda h: ~h.rlike("^[0-9]+$") & (F.length(h) > 1))) >= 0.5 * F.size("headers")) & (F.size("headers") > 0), F.lit(False))
    marked = items.withColumns({"__kind": kind, "__fine": fine, "__text": running_text(F.col("headers"), F.col("rows"))})
    anew = parsed(marked.where("__kind and not __fine and __text is not null"), key, "__text").select(key, F.col("headers").alias("h"), F.col("rows").alias("r"), "method")
    beside = marked.join(anew, key, "left")
    outcome = F.when(~F.col("__kind"), "skipped").when(F.col("__fine") | F.col("method").isNotNull(), "enhanced").otherwise("failed")
    return beside.withColumns({"outcome": outcome, "headers": F.coalesce("h", "headers"), "rows": F.coalesce("r", "rows")}).drop("__kind", "__fine", "__text", "h", "r")
