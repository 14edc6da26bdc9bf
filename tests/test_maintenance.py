"""Three runs of delta maintenance against a full rebuild."""

from __future__ import annotations

import random

from tallyframe.operators import maintenance as M

FACT = "key string, fact_id string, district string, indicator string, year int, value double"


def content(rnd, key, n):
    return [(key, f"{key}-{i}", rnd.choice(["a", "b", "c", None]), rnd.choice(["x", "y"]), rnd.choice([2000, 2001, None]), float(rnd.randint(0, 9))) for i in range(n)]


def test_three_runs_equal_a_full_rebuild(spark):
    rnd = random.Random(3)
    first = {k: content(rnd, k, 8) for k in "pqrstu"}
    second = {k: v for k, v in first.items() if k != "u"} | {"q": content(rnd, "q", 5), "r": content(rnd, "r", 5), "v": content(rnd, "v", 4), "w": []}
    third = second | {"s": content(rnd, "s", 6)}
    frame = lambda files: spark.createDataFrame([f for v in files.values() for f in v], FACT)
    listed = lambda files: spark.createDataFrame([(k, str(hash(tuple(v)))) for k, v in files.items()], "key string, hash string")
    keys = lambda *ks: spark.createDataFrame([(k,) for k in ks], "key string")
    rows = lambda df: sorted((r.bridge_type, r.bridge_id, r.fact_ids) for r in df.collect())
    full = lambda files: rows(M.bridges_of(M.groups_of(frame(files))))

    state = M.updated(M.first_state(frame(first)), listed(first), frame(first), keys("t"), 1)
    assert rows(state.bridges) == full(first | {"t": []})
    assert {r.key: (r.status, r.run) for r in state.tracker.collect()} == {k: ("failed" if k == "t" else "processed", 1) for k in first}

    # r fails after it changed: its old facts stay; t hasn't changed, so it isn't tried again
    state = M.updated(state, listed(second), frame(second), keys("r"), 2)
    held = second | {"r": first["r"], "t": []}
    assert rows(state.bridges) == full(held)
    status = {r.key: (r.status, r.run) for r in state.tracker.collect()}
    assert status == {"p": ("processed", 1), "q": ("processed", 2), "r": ("failed", 2), "s": ("processed", 1), "t": ("failed", 1), "v": ("processed", 2), "w": ("processed", 2)}

    state = M.updated(state, listed(third), frame(third), keys(), 3)
    assert rows(state.bridges) == full(held | {"s": third["s"]})
    again = M.updated(state, listed(third), frame(third), keys(), 4)
    assert rows(again.bridges) == rows(state.bridges) and again.tracker.where("run = 4").count() == 0
    assert sorted(map(tuple, again.facts.collect()), key=str) == sorted(map(tuple, state.facts.collect()), key=str)


def test_queries_over_facts_sum_the_sales_once(spark):
    """Each reading of the facts would shuffle the sales again: the plans left over read what is kept."""
    from tallyframe.plans import catalog

    for name in ("ms_trend", "ms_intelligent_search", "sink_bridges_incremental"):
        plan = catalog.QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
        assert "l_extendedprice" not in plan, name
