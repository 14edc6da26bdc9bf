"""References, supersession, hierarchy and attributes of legal texts, by patterns and windows over lines."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.vocabulary import NAMED_DISTRICTS
from .filters import any_of

# What references, amendments, dates and procedures look like. Where a step's three names or a date's three
# leads differ in nothing but their words, they share one pattern, as Spark reads groups by number.
ORDER = r"(?i)(?:G\.?O\.?\s*(?:No\.?)?|Government\s+Order\s+(?:No\.?)?)\s*(\d+)(?:/(\d{4}))?"
ACT = r"(?i)(?:The\s+)?([A-Z][A-Za-z\s]+(?:Act|Rule))\s*,?\s*(\d{4})"
SECTION = r"(?i)Section\s+(\d+(?:\([a-z]\))?(?:\([i-v]+\))?)"
RULE = r"(?i)Rule\s+(\d+(?:\([a-z]\))?(?:\([i-v]+\))?)"
JUDGMENT = r"(?i)(?:(\d{4})\s+)?(\w+)\s+(\d+)\s+(SC|HC|SCC|AIR|WLR)"
SUPERSEDES = r"(?is)(?:hereby\s+supersedes?|is\s+superseded\s+by|replaces?|cancels?\s+and\s+supersedes?)\s+.*?G\.?O\.?\s*(?:No\.?)?\s*(\d+)(?:/(\d{4}))?"
AMENDED = r"(?is)(?:as\s+amended\s+by|amended\s+vide|substituted\s+by|inserted\s+by|omitted\s+by)\s+.*?(\d{4})"
EFFECTIVE = r"(?i)(?:effective\s+from|comes?\s+into\s+force(?:\s+on)?|w\.?e\.?f\.?)\s+(\d{1,2}[/-]\d{1,2}[/-]\d{4})"
STEP = r"(?i)(?:Step|Procedure|Process)\s+(\d+):\s*(.+)"
DEFINITION = r'(?is)"([^"]+)"\s+means?\s+(.+?)(?=\n\n|\n[A-Z]|$)'
HEADINGS = [(1, r"(?i)^PART\s+([IVX]+|\d+)[\s\-:]*(.+)$", "Part "), (2, r"(?i)^CHAPTER\s+([IVX]+|\d+)[\s\-:]*(.+)$", "Chapter "), (3, r"^(\d+)\.?\s+(.+)$", "Section "), (4, r"^\((\d+|[a-z])\)\s+(.+)$", "Subsection (")]

# Where a search would try every letter of long runs, what is searched for first: an act's run of letters and blanks, from its
# start, with its year; a judgment from the starts of words, of four digits, or after the match before. The first holds
# one match of its pattern at most, the second is the match.
NARROWED = {
    ACT: r"(?<![A-Za-z\s])[A-Za-z\s]++,?\s*+\d{4}",
    JUDGMENT: r"(?i)(?:(?<!\w)|\G|(?=\d{4}\s))(?:\d{4}\s+)?\w++\s+\d+\s+(?:SC|HC|SCC|AIR|WLR)",
}


def occurrences(text: Column, pattern: str, groups: list[int]) -> Column:
    """An array of a pattern's matches, as structs of the groups asked for (g0 is the whole); absent ones are empty.

    A text is searched once, not once for each group: groups come from the match alone, which is its own first match as
    long as the pattern looks at nothing beside it. The patterns that look ahead are searched for each group.
    """
    if "(?=" in pattern:
        return F.arrays_zip(*[F.regexp_extract_all(text, F.lit(pattern), F.lit(g)).alias(f"g{g}") for g in groups])
    whole = F.regexp_extract_all(text, F.lit(NARROWED.get(pattern, pattern)), F.lit(0))
    if pattern == ACT:
        whole = F.filter(F.transform(whole, lambda m: F.regexp_extract(m, pattern, 0)), lambda m: m != "")
    return F.transform(whole, lambda m: F.struct(*[F.regexp_extract(m, pattern, g).alias(f"g{g}") if g else m.alias("g0") for g in groups]))


def found(docs: DataFrame, pattern: str, groups: int) -> DataFrame:
    """``doc_id, ordinal, g1..`` of every match of a pattern; absent groups are empty."""
    each = F.posexplode(occurrences(F.col("text"), pattern, list(range(1, groups + 1))))
    return docs.select("doc_id", each.alias("ordinal", "m")).select("doc_id", "ordinal", *[F.col(f"m.g{g}") for g in range(1, groups + 1)])


def order_references(docs: DataFrame) -> DataFrame:
    """``doc_id, ref_id`` of government orders: ``GO n`` or ``GO n/yyyy``."""
    return found(docs, ORDER, 2).select("doc_id", "ordinal", F.concat(F.lit("GO "), "g1", F.when(F.col("g2") != "", F.concat(F.lit("/"), "g2")).otherwise("")).alias("ref_id"))


def references(docs: DataFrame) -> DataFrame:
    """All references in one pass: ``doc_id, kind, ref_id, confidence``."""

    def matches(pattern: str, groups: int, kind: str, confidence: float, name: Callable[[list[Column]], Column]) -> Column:
        return F.transform(occurrences(F.col("text"), pattern, list(range(1, groups + 1))), lambda m: F.struct(F.lit(kind).alias("kind"), name([m[f"g{g}"] for g in range(1, groups + 1)]).alias("ref_id"), F.lit(confidence).alias("confidence")))

    every = F.concat(
        matches(ORDER, 2, "go", 0.9, lambda g: F.concat(F.lit("GO "), g[0], F.when(g[1] != "", F.concat(F.lit("/"), g[1])).otherwise(""))),
        matches(ACT, 2, "act", 0.85, lambda g: F.concat_ws(", ", F.trim(g[0]), g[1])),
        matches(JUDGMENT, 4, "judgment", 0.8, lambda g: F.concat_ws(" ", g[1], g[2], g[3])),
        matches(SECTION, 1, "section", 0.7, lambda g: F.concat(F.lit("Section "), g[0])),
        matches(RULE, 1, "rule", 0.7, lambda g: F.concat(F.lit("Rule "), g[0])),
    )
    return docs.select("doc_id", F.explode(every).alias("r")).select("doc_id", "r.*")


def supersession_kind(text: Column) -> Column:
    low = F.lower(text)
    return F.when(low.contains("part"), "partial").when(low.rlike("amend|modify|substitute"), "amendment").otherwise("full")


def supersessions(docs: DataFrame) -> DataFrame:
    """``doc_id, superseding, superseded, kind``: the first order in the first ten lines over each order it names."""
    head = F.array_join(F.slice(F.split("text", "\n"), 1, 10), "\n")
    number, year = F.regexp_extract(head, ORDER, 1), F.regexp_extract(head, ORDER, 2)
    own = F.concat(F.lit("GO "), number, F.when(year != "", F.concat(F.lit("/"), year)).otherwise(""))
    each = F.explode(occurrences(F.col("text"), SUPERSEDES, [0, 1, 2]))
    m = docs.select("doc_id", own.alias("superseding"), number.alias("n"), each.alias("m")).where("n <> ''")
    old = F.concat(F.lit("GO "), "m.g1", F.when(F.col("m.g2") != "", F.concat(F.lit("/"), "m.g2")).otherwise(""))
    return m.select("doc_id", "superseding", old.alias("superseded"), supersession_kind(F.col("m.g0")).alias("kind"))


def hierarchy(docs: DataFrame) -> DataFrame:
    """``doc_id, line, level, identifier, parent``: headings with the open heading one level up.

    A heading closes all deeper ones, so a parent is the last heading of the level above, if no shallower one followed.
    """
    lines = docs.select("doc_id", F.posexplode(F.split("text", "\n")).alias("line", "raw")).withColumn("t", F.trim("raw"))
    level, name = F.lit(None).cast("int"), F.lit(None).cast("string")
    for n, pattern, prefix in reversed(HEADINGS):
        hit = F.col("t").rlike(pattern)
        level = F.when(hit, n).otherwise(level)
        name = F.when(hit, F.concat(F.lit(prefix), F.regexp_extract("t", pattern, 1), F.lit(")" if n == 4 else ""))).otherwise(name)
    heads = lines.select("doc_id", "line", level.alias("level"), name.alias("identifier")).where("level is not null")
    before = Window.partitionBy("doc_id").orderBy("line").rowsBetween(Window.unboundedPreceding, -1)
    for n in (1, 2, 3):
        place = F.max(F.when(F.col("level") == n, F.col("line"))).over(before)
        shallower = F.coalesce(F.max(F.when(F.col("level") < n, F.col("line"))).over(before), F.lit(-1))
        text = F.last(F.when(F.col("level") == n, F.col("identifier")), ignorenulls=True).over(before)
        heads = heads.withColumn(f"up{n}", F.when(place > shallower, text))
    parent = F.when(F.col("level") == 2, F.col("up1")).when(F.col("level") == 3, F.col("up2")).when(F.col("level") == 4, F.col("up3"))
    return heads.select("doc_id", "line", "level", "identifier", parent.alias("parent"))


def definitions(docs: DataFrame) -> DataFrame:
    """``doc_id, term, meaning``; the last of a term's definitions counts."""
    every = found(docs, DEFINITION, 2)
    return every.groupBy("doc_id", F.col("g1").alias("term")).agg(F.max_by(F.regexp_replace(F.trim("g2"), r"\s+", " "), "ordinal").alias("meaning"))


def procedures(docs: DataFrame) -> DataFrame:
    return found(docs, STEP, 2).select("doc_id", F.col("g1").cast("int").alias("step"), F.trim("g2").alias("what"))


def amendment_kind(text: Column) -> Column:
    low = F.lower(text)
    out = F.lit("modification")
    for word, kind in (("amended", "amendment"), ("omitted", "omission"), ("inserted", "insertion"), ("substituted", "substitution")):
        out = F.when(low.contains(word), kind).otherwise(out)
    return out


def amendments(docs: DataFrame) -> DataFrame:
    each = F.explode(occurrences(F.col("text"), AMENDED, [0, 1]))
    return docs.select("doc_id", each.alias("m")).select("doc_id", F.col("m.g1").cast("int").alias("year"), amendment_kind(F.col("m.g0")).alias("kind"))


def effective_dates(docs: DataFrame) -> DataFrame:
    return found(docs, EFFECTIVE, 1).select("doc_id", F.col("g1").alias("date"))


def document_kind(text: Column) -> Column:
    """First match; "act" is a substring test, as is "rule" without it."""
    low = F.lower(text)
    out = F.when(low.contains("government order") | low.contains("g.o."), "government_order").when(any_of(text, ["act", "statute"]), "act").when(low.contains("rule"), "rule")
    out = out.when(any_of(text, ["judgment", "order", "writ"]), "judgment")
    for word in ("policy", "circular", "notification"):
        out = out.when(low.contains(word), word)
    return out.otherwise("unknown")


def jurisdiction(docs: DataFrame) -> DataFrame:
    low, district = F.lower("text"), F.lit(None).cast("string")
    for d in reversed(sorted(NAMED_DISTRICTS)):
        district = F.when(low.contains(d), d.title()).otherwise(district)
    state = F.when(low.rlike(r"andhra\s+pradesh|a\.?p\.?(?:\s+government)?"), "Andhra Pradesh")
    department = F.when(low.rlike("school education|education department|cse"), "School Education")
    out = docs.select("doc_id", state.alias("state"), district.alias("district"), department.alias("department"))
    return out.withColumn("scope", F.when(F.col("district").isNotNull(), "district").when(F.col("state").isNotNull(), "state").otherwise("unknown"))


def complexity(n_references: Column, n_headings: Column, n_definitions: Column, n_procedures: Column, n_supersessions: Column, kind: Column) -> Column:
    """Capped sums, in hundredths until the end."""
    cap = lambda c, each, most: F.least(c * each, F.lit(most))
    base = F.when(kind == "act", 30).when(kind == "government_order", 20).when(kind == "judgment", 25).otherwise(10)
    total = cap(n_references, 10, 30) + cap(n_headings, 5, 20) + cap(n_definitions, 5, 10) + cap(n_procedures, 3, 10) + cap(n_supersessions, 10, 20) + base
    return F.least(total, F.lit(100)) / F.lit(100.0)


def title(text: Column) -> Column:
    """The first of twenty lines that is over ten characters and upper-case."""
    lines = F.filter(F.transform(F.slice(F.split(text, "\n"), 1, 20), lambda s: F.trim(s)), lambda s: (F.length(s) > 10) & (s == F.upper(s)) & (s != F.lower(s)))
    return F.coalesce(F.get(lines, 0), F.lit("Untitled Document"))


def analysed(docs: DataFrame) -> DataFrame:
    """Each document of 100 characters or more with its kind, counts of what it holds, and complexity."""
    used = docs.where(F.length("text") >= 100)
    text = F.col("text")
    size = lambda pattern: F.size(occurrences(text, pattern, [0]))
    heading = lambda t: reduce(Column.__or__, [t.rlike(pattern) for _, pattern, _ in HEADINGS])
    terms = F.array_distinct(F.regexp_extract_all(text, F.lit(DEFINITION), F.lit(1)))
    own = F.regexp_extract(F.array_join(F.slice(F.split(text, "\n"), 1, 10), "\n"), ORDER, 1) != ""
    counts = {
        "n_references": reduce(Column.__add__, [size(p) for p in (ORDER, ACT, JUDGMENT, SECTION, RULE)]),
        "n_headings": F.size(F.filter(F.split(text, "\n"), lambda t: heading(F.trim(t)))),
        "n_definitions": F.size(terms),
        "n_procedures": size(STEP),
        "n_supersessions": F.when(own, size(SUPERSEDES)).otherwise(0),
    }
    each = used.select("doc_id", document_kind(text).alias("kind"), *[c.cast("long").alias(n) for n, c in counts.items()])
    return each.withColumn("complexity", complexity(*[F.col(n) for n in counts], F.col("kind")))
