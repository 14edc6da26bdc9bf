"""Pairwise edges inside bridge groups, fact graphs by blocked joins, and back-references."""

from __future__ import annotations

from functools import reduce
from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .aggregates import document_type

SIDE = ["fact_id", "ord", "district", "indicator", "year", "source_document"]


def pairs_within(facts: DataFrame, keys: list[str]) -> DataFrame:
    """Unordered pairs of facts alike in ``keys``, as ``a`` and ``b`` structs, the earlier first."""
    a = facts.select(*[F.col(k).alias(f"__{k}") for k in keys], F.struct(*SIDE).alias("a"))
    b = facts.select(*[F.col(k).alias(f"__{k}") for k in keys], F.struct(*SIDE).alias("b"))
    return a.join(b, [f"__{k}" for k in keys]).where("a.ord < b.ord").select("a", "b")


def strength_hundredths(kind: str) -> Column:
    """The strength of an edge of a kind, in hundredths."""
    a, b = lambda c: F.col(f"a.{c}"), lambda c: F.col(f"b.{c}")
    same = lambda c: F.coalesce(a(c) == b(c), F.lit(False))
    gap = F.abs(a("year") - b("year"))
    if kind == "district_year":
        return F.when(same("district") & same("year"), F.when(same("indicator"), 90).otherwise(80)).when(same("district"), F.greatest(F.lit(30), 70 - 10 * gap)).otherwise(0)
    if kind == "indicator_temporal":
        return F.when(same("indicator") & same("district"), F.greatest(F.lit(40), 90 - 15 * gap)).otherwise(0)
    if kind == "cross_district":
        return F.when(same("indicator") & same("year") & ~same("district"), 70).otherwise(0)
    return F.when(same("source_document"), 80).when(document_type(a("source_document")) == document_type(b("source_document")), 60).otherwise(0)


def edges(facts: DataFrame, kind: str, keys: list[str], threshold: float) -> DataFrame:
    """Edges of one kind inside its groups, from ``threshold`` on."""
    s = strength_hundredths(kind)
    return pairs_within(facts, keys).withColumn("s", s).where(F.col("s") >= round(threshold * 100)).select(F.col("a.fact_id").alias("source"), F.col("b.fact_id").alias("target"), (F.col("s") / F.lit(100.0)).alias("strength"))


def relation_tenths(a: Column, b: Column) -> Column:
    """How related two facts are, in tenths: district 4, indicator 3, year 3 or 2, document 2, at most 10."""
    same = lambda c: F.coalesce(a[c] == b[c], F.lit(False))
    gap = F.abs(a["year"] - b["year"])
    year = F.when(gap <= 1, 3).when(gap <= 3, 2).otherwise(0)
    total = 4 * (same("district") & (a["district"] != "Unknown")).cast("int") + 3 * same("indicator").cast("int") + F.coalesce(year, F.lit(0)) + 2 * same("source_document").cast("int")
    return F.least(F.lit(10), total)


def relation_kind(a: Column, b: Column) -> Column:
    same = lambda c: F.coalesce(a[c] == b[c], F.lit(False))
    return F.when(same("district"), "district").when(same("indicator"), "indicator").when(same("year"), "year").when(same("source_document"), "document").otherwise("related")


#: What makes two facts related, in tenths: equal attributes, and years so many apart at most.
EQUAL = {"district": 4, "indicator": 3, "source_document": 2}
YEARS = {1: 3, 3: 2}


def passing(equal: dict[str, int], near: dict[int, int], over: int) -> list[tuple[tuple[str, ...], int | None]]:
    """The least sets of conditions, equal attributes and perhaps a gap, whose scores add up to more than ``over``.

    A gap is as wide as still passes. No set holds another's conditions, so every pair that passes meets one at least.
    """
    sets = []
    for n in range(len(equal) + 1):
        for names in combinations(equal, n):
            have = sum(equal[c] for c in names)
            gaps = [None] if have > over else [g for g, s in near.items() if have + s > over]
            sets += [(names, None if None in gaps else max(gaps))] if gaps else []
    weaker = lambda x, y: x != y and set(x[0]) <= set(y[0]) and (x[1] is None or y[1] is not None and x[1] >= y[1])
    return [y for y in sets if not any(weaker(x, y) for x in sets)]


def scored_pairs(rows: DataFrame, side: list[str], order: str, equal: dict[str, int], number: str, near: dict[int, int], over: int) -> DataFrame:
    """Pairs ``a, b`` (structs of ``side``) that score more than ``over``, the earlier first, each once.

    Attributes that are equal and not null score ``equal``, numbers of a gap of g at most the most of ``near``. One
    equi-join is made for each least set of conditions that passes, on its attributes and, for a gap, on ranges of the
    number (each row meets its own range and the two beside it). So every pair that a join makes passes, but for the ends
    of ranges. A pair that meets several sets comes from the first.
    """
    both = lambda c: F.col(f"a.{c}") == F.col(f"b.{c}")
    gap = F.abs(F.col(f"a.{number}") - F.col(f"b.{number}"))
    held = lambda names, g: F.coalesce(reduce(Column.__and__, [*map(both, names), *([gap <= g] if g is not None else [])]), F.lit(False))
    parts, sets = [], passing(equal, near, over)
    for i, (names, g) in enumerate(sets):
        have = rows.dropna(subset=[*names, *([number] if g is not None else [])])
        keys = [F.col(c).alias(f"__{c}") for c in names]
        at = F.floor(F.col(number) / (g + 1)) if g is not None else F.lit(0)
        wide = F.explode(F.array(*[at + d for d in (-1, 0, 1)])) if g is not None else at
        left = have.select(*keys, at.alias("__at"), F.struct(*side).alias("a"))
        right = have.select(*keys, wide.alias("__at"), F.struct(*side).alias("b"))
        pairs = left.join(right, [*(f"__{c}" for c in names), "__at"]).where(F.col(f"a.{order}") < F.col(f"b.{order}")).select("a", "b")
        parts.append(reduce(DataFrame.where, [~held(*s) for s in sets[:i]], pairs.where(gap <= g) if g is not None else pairs))
    return reduce(DataFrame.union, parts)


def fact_graph(facts: DataFrame) -> DataFrame:
    """All pairs related by more than 0.3, without making others (``scored_pairs``)."""
    known = facts.withColumn("district", F.nullif("district", F.lit("Unknown")))
    every = scored_pairs(known, SIDE, "ord", EQUAL, "year", YEARS, 3).withColumn("t", relation_tenths(F.col("a"), F.col("b")))
    return every.select(F.col("a.fact_id").alias("source"), F.col("b.fact_id").alias("target"), (F.col("t") / F.lit(10.0)).alias("strength"), relation_kind(F.col("a"), F.col("b")).alias("kind"))


def edge_counts(facts: DataFrame, keys: list[str]) -> DataFrame:
    """The number of pairs in each group, without making them."""
    return facts.groupBy(*keys).agg((F.count(F.lit(1)) * (F.count(F.lit(1)) - 1) / 2).cast("long").alias("edges"))


def back_references(bridges: DataFrame) -> DataFrame:
    """``bridge_id, fact_ids`` -> each fact's bridges, in order."""
    return bridges.select("bridge_id", F.explode("fact_ids").alias("fact_id")).groupBy("fact_id").agg(F.array_join(F.array_sort(F.collect_set("bridge_id")), ",").alias("bridges"))


def bridge_index(bridges: DataFrame) -> DataFrame:
    return bridges.groupBy("bridge_type").agg(F.count(F.lit(1)).alias("n"), F.array_join(F.array_sort(F.collect_list("bridge_id")), ",").alias("keys"))
