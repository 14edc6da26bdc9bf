"""Entity strategies, components and title look-ups against brute force, past the limits they once had."""

from __future__ import annotations

import random
import time

import pytest
from compare import connect
from pyspark.sql import functions as F

from tallyframe.functions import similarity
from tallyframe.operators import entities, reports
from tallyframe.plans import catalog
from tallyframe.plans.textual import shifted

SF = "/root/testdata/sf0.001"
ENTITY = "dataset string, entity_type string, entity_id string, name string, year int"


def test_components_of_a_long_chain(spark):
    chain = spark.range(400).select(F.format_string("%05d", "id").alias("source"), F.format_string("%05d", F.col("id") + 1).alias("target"))
    odd = spark.createDataFrame([("b", "a"), ("c", "c"), (None, "z"), ("b", "a")], "source string, target string")
    got = {r.id: r.component for r in entities.components(chain.union(odd)).collect()}
    assert len(got) == 404 and all(c == "00000" for i, c in got.items() if i < "a")
    assert (got["a"], got["b"], got["c"]) == ("a", "a", "c")
    assert entities.components(chain.limit(0)).count() == 0


def random_names(n, seed):
    rng = random.Random(seed)
    names = {"", "a", "ab", "krishna", "crishna", "akrishna", "guntur", "untur", "gunturu"}
    while len(names) < n:
        word = "".join(rng.choice("abcde") for _ in range(rng.randrange(1, 14)))
        names.add(word)
        for _ in range(3):  # variants at the edge of the ratio
            w = list(word)
            for _ in range(rng.randrange(1, 4)):
                i = rng.randrange(len(w) + 1)
                w[i : i + rng.randrange(2)] = rng.choice(["", "a", "e", "zz"])
            names.add("".join(w))
    return sorted(names)


def test_no_similar_pair_is_lost(spark):
    names = random_names(400, 3)
    df = spark.createDataFrame([("t", x) for x in names] + [("t", None)], "entity_type string, x string")
    got = {(r.x, r.y): r.r for r in entities.alike(df).collect()}
    want = {(a, b): r for a in names for b in names if (r := similarity.sequence_ratio(a, b)) > 0.8 and a + b}
    assert {k: v for k, v in got.items() if k != ("", "")} == want


def brute_links(rows):
    """All pairs of datasets under the six strategies in order."""
    out = {}
    for a in rows:
        for b in rows:
            if not a[0] < b[0]:
                continue
            code = [x[2].rsplit("_", 1)[-1] for x in (a, b)]
            ratio = similarity.sequence_ratio(a[3].lower(), b[3].lower())
            kinds = (a[1], b[1])
            d, p = (a, b) if kinds == ("district", "policy") else (b, a)
            if len(a[2]) > 5 and a[2] == b[2]:
                found = ("exact", 0.95)
            elif a[3].lower() == b[3].lower():
                found = ("exact", 0.85)
            elif a[1] == b[1] and ratio > 0.8 and round(ratio * 90) > 60:
                found = ("fuzzy", round(ratio * 90) / 100)
            elif code[0] == code[1] and len(code[0]) > 4 and code[0].isdigit():
                found = ("code", 0.9)
            elif abs(a[4] - b[4]) <= 1:
                found = ("temporal", 0.65)
            elif {*kinds} == {"district", "policy"} and d[3].lower() in p[3].lower().split():
                found = ("semantic", 0.8)
            else:
                continue
            out[f"{a[0]}:{a[2]}", f"{b[0]}:{b[2]}"] = found
    return out


def test_entities_by_six_strategies(spark):
    rng = random.Random(5)
    places = ["krishna", "guntur", "nellore", "kurnool", "Guntur"]
    rows = []
    for i in range(120):
        dataset, kind = rng.choice(["cse", "scert", "udise"]), rng.choice(["school", "district", "policy"])
        name = rng.choice(places) if kind == "district" else f"{rng.choice(['order', 'scheme', 'schemes'])} {rng.choice(places)} {rng.randrange(4)}"
        rows.append((dataset, kind, f"{kind}_{rng.choice([i, 10000 + i % 30])}", name, 2000 + rng.randrange(40)))
    rows = list({(r[0], r[2]): r for r in rows}.values())
    got = {(r.source, r.target): (r.kind, r.confidence) for r in entities.links(spark.createDataFrame(rows, ENTITY)).collect()}
    want = brute_links(rows)
    assert set(got) == set(want)
    assert got == want


def test_join_entities_on_the_part_table(spark):
    rows = [tuple(r) for r in shifted(spark, SF).where("cast(substring_index(entity_id, '_', -1) as int) < 100120").collect()]
    got = {(r.source, r.target): (r.kind, round(r.confidence, 4)) for r in entities.links(spark.createDataFrame(rows, ENTITY)).collect()}
    assert got == brute_links(rows)
    assert catalog.QUERIES["er_fuzzy"](spark, SF).where("confidence <= 0.72 or confidence > 0.9").count() == 0


def test_references_of_any_length(spark):
    title = "The Andhra Pradesh Compulsory Free Education Of Children Up To Fourteen Years Act 2010"
    children = spark.createDataFrame([(1, "free education of children up to fourteen years act"), (2, title.lower()), (3, "no such act"), (4, ""), (5, None), (6, "act 2010")], "child int, reference string")
    parents = spark.createDataFrame([(10, title), (11, "Other Act 2010"), (12, None)], "parent int, title string")
    got = {r.child: r.parent for r in reports.legal_parents(children, parents).collect()}
    assert got == {1: 10, 2: 10, 6: 10}
    assert reports.legal_parents(children.limit(0), parents).count() == 0


@pytest.mark.parametrize("name", ["scan_json_items", "load_bridges"])
def test_written_tables_are_read_back_whole(spark, name):
    con = connect(SF)
    assert catalog.QUERIES[name](spark, SF).count() == con.sql(f"SELECT count(*) FROM ({catalog.ORACLES[name]})").fetchall()[0][0]


def test_ratios_of_the_customer_table(spark):
    from difflib import SequenceMatcher

    want = {r.c_custkey: SequenceMatcher(None, r.c_name, r.c_mktsegment).ratio() for r in spark.read.parquet(f"{SF}/customer.parquet").collect()}
    assert {r.c_custkey: r.ratio for r in catalog.QUERIES["fn_seq_ratio"](spark, SF).collect()} == want


def test_references_and_titles_of_many_rows(spark):
    """Fifty references and sixty titles of thousands of rows each: pairs of rows would be 24 million."""
    n = 40000
    children = spark.range(n).select(F.col("id").alias("child"), F.concat(F.lit("Rule "), (F.col("id") % 50).cast("string")).alias("reference"))
    parents = spark.range(n).select(F.col("id").alias("parent"), F.concat(F.lit("Act of RULE "), (F.col("id") % 60).cast("string")).alias("title"))
    tracker = spark.sparkContext._jsc.sc().statusStore()
    before = tracker.stageList(None, False, False, spark.sparkContext._gateway.new_array(spark._jvm.double, 0), None).size()
    got = reports.legal_parents(children, parents).groupBy("parent").count().collect()
    after = tracker.stageList(None, False, False, spark.sparkContext._gateway.new_array(spark._jvm.double, 0), None)
    seen = [after.apply(i).shuffleReadRecords() for i in range(after.size() - before)]
    assert {(r.parent, r["count"]) for r in got} == {(i, n // 50) for i in range(50)}
    assert max(seen) <= 2 * n


def test_rows_of_one_dataset_never_meet(spark):
    """A hundred thousand entities of one year beside three of another dataset: ten billion pairs would not end in a minute."""
    n = 100_000
    of = lambda rows, dataset: rows.select(F.lit(dataset).alias("dataset"), F.lit("school").alias("entity_type"), F.format_string(f"{dataset}_%d", "id").alias("entity_id"), F.lit("N").alias("name"), F.lit(2000).alias("year"))
    rows = of(spark.range(n), "a").union(of(spark.range(3), "b"))
    began = time.time()
    assert entities.timed(rows).count() == 3 * n
    got = entities.links(rows, fuzzy=False).groupBy("kind").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("source", "target").alias("d")).collect()
    assert [(r.kind, r.n, r.d) for r in got] == [("exact", 3 * n, 3 * n)]
    assert time.time() - began < 60


def test_repeated_entities_link_once(spark):
    rows = [("a", "school", "s_10001", "One", 2000), ("a", "school", "s_10001", "Two", 2001), ("a", "school", "s_10001", "One", 2000), ("b", "school", "t_10001", "two", 2001), ("b", "school", "t_2", "one", 2050), ("b", "school", "t_2", "Onex", 1900), ("b", "school", "t_3", "zzz", 2002)]
    got = sorted((r.source, r.target, r.kind, r.confidence) for r in entities.links(spark.createDataFrame(rows, ENTITY)).collect())
    assert got == [("a:s_10001", "b:t_10001", "exact", 0.85), ("a:s_10001", "b:t_2", "exact", 0.85), ("a:s_10001", "b:t_3", "temporal", 0.65)]


def one_name(spark, n):
    """``n`` entities of one name in each of two datasets."""
    return spark.range(2 * n).selectExpr("if(id % 2 = 0, 'a', 'b') AS dataset", "'school' AS entity_type", "concat('s_', id) AS entity_id", "'Krishna' AS name", "CAST(2000 + 10 * (id % 2) AS INT) AS year")


def test_lists_that_meet_make_few_rows_at_once(spark):
    """All rows that a row is exploded to are held together: 1,500 times 1,500 names would be two million."""
    rows = one_name(spark, 3000)
    cells = entities.dealt(rows.select("name", "dataset", F.struct("entity_id").alias("a")), ["name", "dataset"], "a")
    sizes = [r.n for r in cells.select(F.size("a").alias("n")).collect()]
    assert sum(sizes) == 6000 and max(sizes) ** 2 < 200_000
    assert entities.similar(rows).count() == 3000**2


def test_plain_entities_are_not_paired_again(spark):
    """Only pairs with an entity of many rows are ranked by strategy; those of plain ones are made once."""
    rows = one_name(spark, 500).withColumn("plain", F.col("entity_id") != "s_0")
    assert entities.named(rows).count() == 500
    assert entities.timed(rows.withColumn("year", F.lit(2000))).count() == 500
    assert entities.named(rows.drop("plain")).count() == 500**2


def test_repeated_entities_by_six_strategies(spark):
    """Each pair of entities has the first strategy that links any two of their rows, whether repeated or not."""
    rng = random.Random(11)
    rows = []
    for i in range(70):
        dataset, kind = rng.choice(["cse", "scert"]), rng.choice(["school", "district", "policy"])
        name = f"{rng.choice(['order', 'orders', 'scheme'])} {rng.choice(['krishna', 'Guntur'])} {rng.randrange(3)}" if kind != "district" else rng.choice(["Krishna", "guntur", "nellore"])
        rows.append((dataset, kind, f"{kind}_{10000 + rng.randrange(12) if i % 2 else i}", name, 2000 + rng.randrange(40)))
    order = ["exact", "fuzzy", "code", "geographic", "temporal", "semantic"]
    want = {}
    for a in rows:
        for b in rows:
            for ends, (kind, c) in brute_links([a, b]).items():
                if ends[0] == f"{a[0]}:{a[2]}" and a[0] < b[0]:
                    want[ends] = min(want.get(ends, (9, 0, "")), (order.index(kind), -c, kind))
    found = entities.links(spark.createDataFrame(rows, ENTITY)).collect()
    got = {(r.source, r.target): (r.kind, r.confidence) for r in found}
    assert len(got) == len(found) and len({(r[0], r[2]) for r in rows}) < len(set(rows))
    assert got == {k: (kind, -c) for k, (_, c, kind) in want.items()}
