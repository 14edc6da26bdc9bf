"""Classification and routing of questions by first matches and counts of phrases."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions import vocabulary as V
from .filters import any_of


def first_match_of(text: Column, ladder: list[tuple[str, list[str]]], default: str) -> Column:
    out = F.lit(default)
    for name, words in reversed(ladder):
        out = F.when(any_of(text, words), name).otherwise(out)
    return out


def hits(text: Column, words: list[str]) -> Column:
    low = F.lower(text)
    return sum((low.contains(w).cast("int") for w in words), F.lit(0))


def question_type(text: Column) -> Column:
    """The kind with most phrases, the earlier on ties, complex without any."""
    counts = [(name, hits(text, words)) for name, words in V.QUESTION_PHRASES.items()]
    best = F.greatest(*[c for _, c in counts])
    out = F.lit("complex")
    for name, c in reversed(counts):
        out = F.when(c == best, name).otherwise(out)
    return F.when(best > 0, out).otherwise("complex")


def intent(text: Column) -> Column:
    return first_match_of(text, V.INTENTS, "find")


def years_in(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(r"\b(20[0-2][0-9])\b"), F.lit(1))


def temporal_scope(text: Column, as_of_year: int) -> tuple[Column, Column]:
    """The smallest and largest year named, or the last five or three years, or nulls."""
    years, low = years_in(text), F.lower(text)
    last = F.when(low.contains("last 5 years") | low.contains("past 5 years"), 5).when(low.contains("last 3 years") | low.contains("past 3 years"), 3)
    named = F.size(years) > 0
    first = F.when(named, F.array_min(years).cast("int")).otherwise(as_of_year - last)
    return first, F.when(named, F.array_max(years).cast("int")).when(last.isNotNull(), as_of_year)


def dimensions(text: Column) -> Column:
    kinds = [("district", ["district"]), ("temporal", ["year", "time", "temporal"]), ("indicator", ["indicator", "metric", "measure"])]
    return F.array_compact(F.array(*[F.when(any_of(text, w), n) for n, w in kinds]))


def entities(text: Column) -> Column:
    """Districts and indicators named, in vocabulary order, then years as written."""
    low = F.lower(text)
    named = [F.when(low.contains(d), d.title()) for d in V.NAMED_DISTRICTS]
    named += [F.when(low.contains(i), i.upper() if i in ("ger", "ner", "ptr") else i.title()) for i in V.NAMED_INDICATORS]
    return F.concat(F.array_compact(F.array(*named)), years_in(text))


def sought(text: Column) -> Column:
    """Tagged districts and indicators of a search."""
    low = F.lower(text)
    named = [F.when(low.contains(d), f"district:{d}") for d in [*V.NAMED_DISTRICTS[:-1], "kadapa", "tirupati"]]
    return F.array_compact(F.array(*named, *[F.when(low.contains(i), f"indicator:{i}") for i in V.SOUGHT_INDICATORS]))


def search_type(text: Column) -> Column:
    words = F.size(F.split(F.trim(text), r"\s+"))
    return F.when(any_of(text, V.COMPARISON_WORDS), "comparison").when(any_of(text, V.TIME_WORDS), "temporal").when(F.size(sought(text)) > 0, "entity_specific").when(words > 10, "complex").when(text.rlike("[0-9]"), "statistical").otherwise("general")


def complexity(text: Column) -> Column:
    """Mean of length over 20 words, entities over 10, comparison and time flags."""
    words = F.size(F.split(F.trim(text), r"\s+"))
    flags = any_of(text, V.COMPARISON_WORDS).cast("int") + any_of(text, V.TIME_WORDS).cast("int")
    return F.least(F.lit(1.0), (words / F.lit(20.0) + F.size(sought(text)) / F.lit(10.0) + flags) / 4)


def method(text: Column) -> Column:
    words = F.size(F.split(F.trim(text), r"\s+"))
    found = first_match_of(text, V.METHODS, "")
    return F.when(found != "", found).when(words > 10, "advanced").otherwise("hybrid")


def policy_route(text: Column) -> Column:
    return first_match_of(text, V.POLICY_ROUTES, "general")
