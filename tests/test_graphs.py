"""Graph searches, communities and related pairs against brute force."""

from __future__ import annotations

import random
from collections import Counter, defaultdict
from itertools import combinations

import pytest
import xxhash
from pyspark.sql import functions as F

from tallyframe.operators import bridges, communities, graph
from tallyframe.plans import catalog, orchestration
from tallyframe.sources.facts import facts

SF = "/root/testdata/sf0.001"
EDGES = "source string, target string"


def around(edges):
    near = defaultdict(set)
    for a, b in edges:
        near[a].add(b)
        near[b].add(a)
    return near


def shortest_paths(edges, start, depth):
    """The path to each node that is smallest read from its end, of the shortest."""
    near, found = around(edges), {start: [start]}
    level = {start: [start]}
    for _ in range(depth):
        after = {}
        for node, path in level.items():
            for x in near[node] - set(found):
                if x not in after or path[::-1] < after[x][::-1][1:]:
                    after[x] = [*path, x]
        found |= after
        level = after
    return found


def test_paths_of_a_long_chain_at_a_plan_of_one_hop(spark):
    chain = spark.range(1000).select(F.format_string("%04d", "id").alias("source"), F.format_string("%04d", F.col("id") + 1).alias("target"))
    start = spark.createDataFrame([("0500",)], "id string")
    plans = {}
    for depth in (2, 20):
        reach = graph.search(chain, start, depth)
        plans[depth] = len(reach._jdf.queryExecution().optimizedPlan().toString())
        assert reach.count() == 2 * depth + 1
    assert abs(plans[20] - plans[2]) < 100
    pairs = spark.createDataFrame([("0500", "0515"), ("0500", "0500"), ("0500", "0900"), ("0500", "none")], EDGES)
    got = {(r.source, r.target): (r.distance, r.path) for r in graph.shortest(chain, pairs, 20).collect()}
    assert got == {("0500", "0515"): (15, [f"{i:04d}" for i in range(500, 516)]), ("0500", "0500"): (0, ["0500"])}


@pytest.mark.parametrize("seed", range(3))
def test_paths_equal_brute_force(spark, seed):
    rnd = random.Random(seed)
    names = [f"v{i}" for i in range(18)]
    edges = [(rnd.choice(names), rnd.choice(names)) for _ in range(26)]
    df = spark.createDataFrame([*edges, *edges[:3]], EDGES)
    pairs = [(a, b) for a in names[:3] for b in names]
    got = {(r.source, r.target): r.path for r in graph.shortest(df, spark.createDataFrame(pairs, EDGES), 4).collect()}
    want = {(a, b): path for a in names[:3] for b, path in shortest_paths(edges, a, 4).items() if b in names}
    assert got == want
    trails = []

    def walk(node, path, used):
        if path[1:]:
            trails.append(tuple(path))
        if len(used) < 3:
            for a, b in set(edges):
                for x, y in {(a, b), (b, a)}:
                    if x == node and (a, b) not in used:
                        walk(y, [*path, y], [*used, (a, b)])

    walk(names[0], [names[0]], [])
    found = graph.trails(df, spark.createDataFrame([(names[0],)], "id string"), 3).collect()
    assert sorted(tuple(r.path) for r in found) == sorted(trails) and all(r.length == len(r.path) - 1 for r in found)


def plain_communities(edges, directed=True):
    """The same rounds of moves over dictionaries, and the modularity that they reach."""
    weights = defaultdict(int)
    for e in edges:
        weights[e[:2]] = 1 if len(e) == 2 else weights[e[:2]] + e[2]
    if not directed:
        both = defaultdict(int)
        for (a, b), w in weights.items():
            both[a, b] += w
            both[b, a] += w
        weights = both
    total, out, into = sum(weights.values()), defaultdict(int), defaultdict(int)
    near = defaultdict(lambda: defaultdict(int))
    for (a, b), w in weights.items():
        out[a], into[b], out[b], into[a] = out[a] + w, into[b] + w, out[b], into[a]
        if a != b:
            near[a][b] += w
            near[b][a] += w
    final = {v: v for v in out}

    def quality(at):
        o, i = sums(at)
        between = sum(w for v in near for x, w in near[v].items() if at[v] != at[x]) // 2
        return (total - between) * total - sum(o[c] * i[c] for c in o)

    def sums(at):
        o, i = defaultdict(int), defaultdict(int)
        for v, c in at.items():
            o[c] += out[v]
            i[c] += into[v]
        return o, i

    turn = 0
    while True:
        at = {v: v for v in out}
        first = best = quality(at)
        idle = 0
        while idle < 2:
            (o, i), after = sums(at), dict(at)
            for v in at:
                h = xxhash.xxh64_intdigest((turn // 2).to_bytes(4, "little"), xxhash.xxh64_intdigest(v.encode(), 42))
                if (h + turn) % 2:
                    continue
                around = defaultdict(int, {at[v]: 0})
                for x, w in near[v].items():
                    around[at[x]] += w
                own = lambda c, n, v=v: n[v] if c == at[v] else 0
                after[v] = max((total * w - out[v] * (i[c] - own(c, into)) - into[v] * (o[c] - own(c, out)), c == at[v], c) for c, w in around.items())[2]
            turn += 1
            if quality(after) > best:
                at, best, idle = after, quality(after), 0
            else:
                idle += 1
        if best <= first:
            break
        final = {v: at[c] for v, c in final.items()}
        (out, into), old, near = sums(at), near, defaultdict(lambda: defaultdict(int))
        for v in old:
            for x, w in old[v].items():
                if at[v] != at[x]:
                    near[at[v]][at[x]] += w
    names = defaultdict(set)
    for v, c in final.items():
        names[c].add(v)
    return {v: min(vs) for vs in names.values() for v in vs}, best / total**2 if total else 0


def found_communities(df, **how):
    return {r.id: r.community for r in communities.modularity_communities(df, **how).collect()}


def groups(*members):
    return [e for m in members for e in combinations(m, 2)]


def test_two_dense_groups_and_a_bridge(spark):
    edges = [*groups([f"a{i}" for i in range(6)], [f"b{i}" for i in range(7)]), ("a5", "b0")]
    want = {f"{c}{i}": f"{c}0" for c, n in (("a", 6), ("b", 7)) for i in range(n)}
    odd = [("z", None), (None, "z"), ("loop", "loop")]
    for directed in (True, False):
        assert plain_communities(edges, directed)[0] == want
        assert found_communities(spark.createDataFrame([*edges, *edges[:4], *odd], EDGES), directed=directed) == want | {"loop": "loop"}
    assert found_communities(spark.createDataFrame([], EDGES)) == {}


@pytest.mark.parametrize("directed", [True, False])
def test_communities_of_random_graphs_equal_plain_rounds(spark, directed):
    rnd = random.Random(11 + directed)
    names = [f"n{i:02d}" for i in range(60)]
    edges = [(a, b, rnd.randint(1, 9)) for a, b in combinations(names, 2) if rnd.random() < (0.5 if names.index(a) // 15 == names.index(b) // 15 else 0.04)]
    df = spark.createDataFrame(edges, f"{EDGES}, t int")
    want, quality = plain_communities(edges, directed)
    assert found_communities(df, weight="t", directed=directed) == want
    assert quality > 0.45 and len(set(want.values())) <= 8
    assert found_communities(df, directed=directed) == plain_communities([e[:2] for e in edges], directed)[0]


def test_communities_of_the_fact_graph(spark, monkeypatch):
    edges = bridges.fact_graph(facts(spark, SF)).select("source", "target")
    want, quality = plain_communities([tuple(r) for r in edges.collect()])
    assert {r.id: r.community for r in catalog.QUERIES["gr_communities"](spark, SF).collect()} == want
    assert quality > 0.5
    known = spark.createDataFrame(list(want.items()), "id string, community string")
    monkeypatch.setattr(orchestration, "modularity_communities", lambda edges: known)
    built = catalog.QUERIES["rag_build"](spark, SF).collect()
    sizes = Counter(want.values())
    assert built and all(r.n == sizes[r.community] and r.relevance > 0.3 for r in built)


def test_least_sets_of_conditions():
    assert bridges.passing({"d": 4, "i": 3, "s": 2}, {1: 3, 3: 2}, 3) == [(("d",), None), (("i",), 3), (("s",), 3), (("i", "s"), None)]
    assert bridges.passing({"d": 4}, {1: 3, 5: 1}, 4) == [(("d",), 5)]
    assert bridges.passing({"d": 1}, {2: 3}, 2) == [((), 2)]


def test_only_pairs_that_pass_are_made(spark):
    rnd = random.Random(5)
    rows = [(f"f{i}", i, rnd.choice(["A", "B", "Unknown", None]), rnd.choice(["x", "y", "z", None]), rnd.choice([None, *range(2000, 2012)]), rnd.choice(["p", "q", None])) for i in range(120)]
    df = spark.createDataFrame(rows, "fact_id string, ord long, district string, indicator string, year int, source_document string")
    want = {}
    for a, b in combinations(rows, 2):
        same = [x is not None and x == y for x, y in zip(a, b, strict=True)]
        gap = abs(a[4] - b[4]) if None not in (a[4], b[4]) else 9
        tenths = min(10, 4 * (same[2] and a[2] != "Unknown") + 3 * same[3] + (3 if gap <= 1 else 2 if gap <= 3 else 0) + 2 * same[5])
        if tenths > 3:
            want[a[0], b[0]] = tenths / 10
    got = bridges.fact_graph(df).collect()
    assert {(r.source, r.target): r.strength for r in got} == want and len(got) == len(want)
