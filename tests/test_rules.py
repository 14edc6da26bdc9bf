"""Weighted ratios, normalisation rules and leave-one-out statistics against plain definitions."""

from __future__ import annotations

import random
import statistics

import numpy as np
import pytest

from tallyframe.functions import similarity as S
from tallyframe.functions import vocabulary as V
from tallyframe.operators import entities, validation
from tallyframe.plans import catalog

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize(
    ("a", "b", "want"),
    [
        ("fuzzy wuzzy was a bear", "wuzzy fuzzy was a bear", 95),  # the same words in another order
        ("fuzzy fuzzy was a bear", "fuzzy was a bear", 95),  # the same set of words
        ("this is a test!", "This is, a test", 97),  # 28 of 29 letters, against 95 for words
        ("guntur", "the rate of guntur in all schools", 90),  # a part: one side is five times as long
        ("ab", "ab cd ef gh ij kl mn op", 60),  # eight times as long and more
        ("guntur", "guntoor", 77),
        ("guntur", "", 0),
        ("...", "guntur", 0),
        ("Krishna", "krishna", 100),
        ("pupil ratio", "ratio of pupils", 81),  # sorted, 22 of 26 letters: 85, less a twentieth
    ],
)
def test_weighted_ratio_of_known_pairs(a, b, want):
    assert S.weighted_ratio(a, b) == S.weighted_ratio(b, a) == want


def test_weighted_ratio_differs_from_the_plain_one():
    assert S.ratio("guntur", "guntur district") == 57 and S.weighted_ratio("guntur", "guntur district") == 90
    assert S.ratio("rate dropout", "dropout rate") < 71 < S.weighted_ratio("rate dropout", "dropout rate") == 95


RULES = {
    "fn_norm_district_s2": (V.DISTRICTS, S.weighted_ratio, 81, "Unknown"),
    "fn_norm_district_enh": (V.DISTRICTS, S.partial_ratio, 80, None),
    "fn_norm_district_dp": (V.DISTRICTS, S.ratio, 85, None),
    "fn_norm_indicator_s2": ([r[0] for r in V.RANGES], S.weighted_ratio, 71, "Unknown"),
    "fn_norm_indicator_enh": ([r[0] for r in V.RANGES], S.partial_ratio, 70, None),
}


@pytest.mark.parametrize("name", RULES)
def test_names_on_both_sides_of_the_threshold(spark, name):
    names, score, least, none = RULES[name]
    rows = catalog.QUERIES[name](spark, SF).collect()
    scores = []
    for r in rows:
        best = max(names, key=lambda n, r=r: score(r.typed.lower().strip(), n.lower()))
        scores.append(score(r.typed.lower().strip(), best.lower()))
        assert r.name == (best if scores[-1] >= least else none), r
    assert len({r.typed for r in rows}) == len(rows) > 40
    assert any(least <= s < 100 for s in scores) and any(s < least for s in scores) and 100 in scores


FACT = "fact_id string, district string, indicator string, value double, year int"


def plain_statistics(rows):
    out = {}
    for fact, district, indicator, value, year in rows:
        other = [r[3] for r in rows if r[2] == indicator and r[4] == year and None not in (r[1], r[3], district) and r[1] != district]
        if len(other) >= 3:
            out[fact] = (value, len(other), statistics.fmean(other), statistics.pstdev(other), float(np.quantile(other, 0.25)), float(np.quantile(other, 0.75)))
    return out


def test_statistics_leave_the_own_district_out(spark):
    rnd = random.Random(4)
    rows = [(f"f{i}", rnd.choice(["a", "b", "c", "d", None]), rnd.choice(["x", "y"]), rnd.choice([None, 1.0, 2.5, 2.5, 7.25, rnd.randint(0, 900) / 4]), rnd.choice([2000, 2001])) for i in range(150)]
    rows += [(f"s{i}", f"d{i}", "same", 5.0, 2000) for i in range(5)] + [("s9", "d9", "same", 6.0, 2000), ("n1", "a", None, 1.0, 2000), ("n2", "a", "x", 1.0, None), ("few1", "a", "few", 1.0, 2000), ("few2", "b", "few", 1.0, 2000)]
    got = {r.fact_id: tuple(r)[1:] for r in validation.peer_statistics(spark.createDataFrame(rows, FACT)).collect()}
    want = plain_statistics(rows)
    assert set(got) == set(want)
    for fact, values in want.items():
        assert got[fact] == pytest.approx(values, nan_ok=True), fact
    assert got["s9"][3] == 0.0  # five equal values, without a remainder
    assert validation.peer_statistics(spark.createDataFrame([], FACT)).count() == 0


def test_a_group_of_a_hundred_thousand_facts(spark):
    big = spark.range(100_000).selectExpr("concat('f', id) fact_id", "concat('d', id % 40) district", "'x' indicator", "double(id % 1000) value", "2000 year")
    got = validation.peer_statistics(big)
    assert got.count() == 100_000
    one = got.where("fact_id = 'f7'").first()
    other = [float(i % 1000) for i in range(100_000) if i % 40 != 7]
    assert tuple(one)[1:] == pytest.approx((7.0, len(other), statistics.fmean(other), statistics.pstdev(other), np.quantile(other, 0.25), np.quantile(other, 0.75)))


def test_classes_of_years_say_all_links(spark):
    rnd = random.Random(6)
    rows = [(rnd.choice(["l", "m", "r", None]), "school", f"e{i}", "n", rnd.choice([None, *range(2000, 2008)])) for i in range(80)]
    df = spark.createDataFrame(rows, "dataset string, entity_type string, entity_id string, name string, year int")
    classes = entities.timed_classes(df).collect()
    assert sum(r.links for r in classes) == entities.timed(df).count() > 100
    assert all(abs(r.source_year - r.target_year) <= 1 and r.source < r.target for r in classes)


def test_groups_of_a_match_are_those_of_the_text(spark):
    """One search a text; each group as a search for it alone gives it, on texts made of what the patterns look for."""
    import random

    from pyspark.sql import functions as F

    from tallyframe.operators import legal

    rnd = random.Random(9)
    parts = ["G.O. No. ", "GO ", "Government Order No ", "12", "2014", "/", " ", "\n", "The ", "Education Act", ", ", "Rule ", "Section ", "7(a)", "(ii)", "AIR ", "SC", " 45 SCC", "hereby supersedes ", "replaces x\n", "as amended by ", "w.e.f. ", "1/2/2014", "Step 1: ", "Process 2:", "apply\r\n", '"Term" means ', "é", " ", "a thing\n\n", "\nB", "x", "1", "Schools", "hc", "5 SC", "12014 ", "act", "rule,  ", ",", "The  Act 2010"]
    rows = [(i, "".join(rnd.choices(parts, k=rnd.randint(0, 25)))) for i in range(4000)] + [(4000, None), (4001, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    asked = {legal.ORDER: 2, legal.ACT: 2, legal.SECTION: 1, legal.RULE: 1, legal.JUDGMENT: 4, legal.SUPERSEDES: 2, legal.AMENDED: 1, legal.EFFECTIVE: 1, legal.STEP: 2, legal.DEFINITION: 2}
    for pattern, n in asked.items():
        groups = list(range(n + 1))
        each = F.arrays_zip(*[F.regexp_extract_all("text", F.lit(pattern), F.lit(g)).alias(f"g{g}") for g in groups])
        both = docs.select(legal.occurrences(F.col("text"), pattern, groups).alias("a"), each.alias("b"))
        assert both.where("not (a <=> b)").count() == 0, pattern
        assert both.where("size(a) > 0").count() > 0, pattern
    plan = legal.found(docs, legal.JUDGMENT, 4)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_extract_all") == 1


def test_claims_in_blocks_are_those_by_pairs(spark, monkeypatch):
    """Blocks give what the plain comparison gives, also for odd vectors and cosines at the bound."""
    import random

    from pyspark.sql import functions as F

    from tallyframe.operators import retrieval as T

    monkeypatch.setattr(T, "FEW", 50)
    monkeypatch.setattr(T, "CELL", 16)
    rnd = random.Random(4)
    vector = lambda: [rnd.choice([0.0, 1.0, -1.0, rnd.gauss(0, 1)]) for _ in range(3)]
    odd = [None, [], [0.0] * 3, [1.0, None, 0.0], [float("nan"), 0.0, 1.0], [float("inf"), 1.0, 0.0], [1.0, 1.0], [3.0, 4.0, 0.0], [1e-170] * 3, [1e170] * 3]
    rows = lambda n, k: [(rnd.choice(["a", "b", None]), i, vector()) for i in range(n)] + [("a", n + i, v) for i, v in enumerate(odd)] + [(f"s{i}", 900 + i, vector()) for i in range(k)]
    claims = spark.createDataFrame(rows(120, 5), "answer string, claim_id long, claim array<double>")
    cited = spark.createDataFrame(rows(90, 5), "answer string, citation_id long, citation array<double>")
    for least in (0.6, 0.0, -0.2):
        want = claims.join(cited, "answer").where(T.cosine(F.col("claim"), F.col("citation")) >= least).select("claim_id", "citation_id")
        got = T.claims_cited(claims, cited, least)
        assert "FlatMapCoGroupsInArrow" in got._jdf.queryExecution().executedPlan().toString()
        assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect())), least


def test_comparisons_search_the_named_rows_too():
    from tallyframe.plans import catalog

    assert "OR district = 'Guntur' OR year = 2018" in catalog.ORACLES["rt_comparative"]


def test_links_by_year_name_their_members(spark):
    from tallyframe.plans import catalog

    rows = catalog.QUERIES["er_temporal"](spark, "/root/testdata/sf0.001").where("part = 'member'")
    n = spark.read.parquet("/root/testdata/sf0.001/part.parquet").count()
    assert rows.select("source", "entity_id").distinct().count() == 2 * n


def test_related_nodes_are_dealt_to_many_tasks(spark):
    from tallyframe.operators import graph

    nodes = spark.range(400).coalesce(1).selectExpr("id", "cast(id % 40 as string) as kind")
    got = graph.related_within(nodes, "id", "kind")
    assert got.rdd.getNumPartitions() >= 32
    assert got.count() == 400 * 9


def test_facts_meet_what_they_are_compared_with_in_one_join(spark):
    from tallyframe.operators.windows import numbered
    from tallyframe.sources.facts import FACT_SCHEMA

    fact = lambda i, value, year, ord_, district="Guntur": (i, district, "Total Enrollment", None, year, value, "count", "a.pdf", 1, 1.0, ord_)
    # one id twice, and a group's first fact by its order, not its place; nulls come first, values may be missing
    rows = [fact("a", 10.0, 2020, 5), fact("b", 1000.0, 2020, 2), fact("c", 20.0, 2021, 3), fact("c", 1100.0, 2021, 4), fact("d", 4.0, 2022, 9), fact("e", None, 2022, None), fact("f", 1.0, 2023, 10)]
    rows += [fact("g", 1.0, 2020, 1, None), fact("h", 9.0, 2021, 1, None), fact("i", 9.0, None, 1)]
    done = validation.validated(spark.createDataFrame(rows, FACT_SCHEMA), 2024)
    got = sorted((r.fact_id, str(r.value), "TEMP_001" in r.warnings) for r in done.collect())
    assert got == [("a", "10.0", False), ("b", "1000.0", False), ("c", "1100.0", False), ("c", "20.0", True), ("d", "4.0", True), ("e", "None", False), ("f", "1.0", False), ("g", "1.0", False), ("h", "9.0", False), ("i", "9.0", False)]
    for r in done.collect():
        assert (r.n_errors, r.n_anomalies, r.is_valid) == (len(r.errors), int("STAT_001" in r.warnings), not r.errors)
    plan = done._jdf.queryExecution().executedPlan().toString()
    assert "Exchange hashpartitioning" not in plan and "Window" not in plan  # the facts stay where they are
    ordered = numbered(spark.range(100), ["id"], "n")._jdf.queryExecution().executedPlan().toString()
    assert ordered.count("Exchange hashpartitioning(__p") == 1  # that of the ranges' counts


def test_runs_of_equal_values_hold_the_ranks(spark):
    """Long runs, which span several lookups, beside short ones."""
    rows = [(f"f{i}", f"d{i % 3}", "x", float(i % 2 if i < 12_000 else i % 50), 2000) for i in range(13_000)] + [("n", "d0", "x", -3.0, 2000), ("m", "d9", "x", 99.5, 2000)]
    df = spark.createDataFrame(rows, FACT)
    got = {r.district: tuple(r)[3:] for r in validation.district_statistics(df).collect()}
    for d in ("d0", "d1", "d2", "d9"):
        other = [r[3] for r in rows if r[1] != d]
        want = (len(other), statistics.fmean(other), statistics.pstdev(other), float(np.quantile(other, 0.25)), float(np.quantile(other, 0.75)))
        assert got[d] == pytest.approx(want), d
