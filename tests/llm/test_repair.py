"""Conversation repair against a plain search over edits, across blocks and partitions."""

from __future__ import annotations

import hashlib
import heapq
import random
import re
import zlib

from pyspark.sql import functions as F

from tallyframe.llm import queries, repair

SF = "/root/testdata/sf0.001"
SCHEMA = "conv_id long, turn long, role string, text string"


def damage(rows):
    out = []
    for conv, turn, role, text in rows:
        say = lambda x: " " if x is None else str(x)
        role, text, fault = say(role), say(text), zlib.crc32(f"{say(conv)}:{say(turn)}".encode()) % 20
        if fault == 0:
            continue
        text = "" if fault == 1 else re.sub("[.!?]", "", text) if fault == 2 else text
        out += [(conv, turn, "user" if fault == 4 else role, text)] * (2 if fault == 3 else 1)
    return out


def search(turns):
    """The cheapest (cost, audit) and what it leaves, by best-first search over (turns read, state)."""
    after = {"": "su", "s": "u", "u": "a", "a": "u"}
    heap, done = [(0, "", 0, "", ())], set()
    while heap:
        cost, audit, n, last, out = heapq.heappop(heap)
        if n == len(turns) and last in ("", "a"):
            return cost, audit, out
        if (n, last) in done:
            continue
        done.add((n, last))
        for name in ("user", "assistant"):
            if name[0] in after[last]:
                heapq.heappush(heap, (cost + 2, audit + "I", n, name[0], (*out, (name, ""))))
        if n < len(turns):
            role, text, forced, cut = turns[n]
            heapq.heappush(heap, (cost + 3, audit + "D", n + 1, last, out))
            if not forced:
                if role[:1] and role[:1] in after[last]:
                    heapq.heappush(heap, (cost + cut, audit + "K", n + 1, role[0], (*out, (role, text))))
                for name in ("user", "assistant"):
                    if name[0] in after[last]:
                        heapq.heappush(heap, (cost + 2 + cut, audit + "R", n + 1, name[0], (*out, (name, text))))


def expected(rows):
    by = {}
    for conv, turn, role, text in rows:
        by.setdefault(conv, []).append((turn is not None, turn or 0, role, text, turn))
    out = {}
    for conv, turns in by.items():
        turns.sort()
        seen, faults, judged = set(), {"b": 0, "d": 0, "t": 0}, []
        for _, _, role, text, _ in turns:
            body = text.strip(" \t\n\x0b\x0c\r")
            fault = "b" if not body else "d" if (role, text) in seen else "t" if body[-1] not in ".!?" else ""
            seen.add((role, text))
            if fault:
                faults[fault] += 1
            judged.append((role, text, fault in ("b", "d"), int(fault == "t")))
        cost, audit, left = search(judged)
        known = [t[4] for t in turns if t[4] is not None]
        gaps = max(known) - min(known) + 1 - len(set(known)) if known else 0
        illegal = sum((a[2][:1] + b[2][:1]) not in ("su", "ua", "au") for a, b in zip(turns, turns[1:], strict=False))
        digest = hashlib.sha256("\n".join(f"{r}:{t}" for r, t in left).encode()).hexdigest()
        out[conv] = (gaps, faults["b"], faults["d"], faults["t"], illegal, cost, audit, digest, left)
    return out


def rows_of(df):
    return {r.conv_id: (r.gaps, r.blank, r.duplicate, r.truncated, r.illegal, r.cost, r.audit, r.repaired_sha256) for r in df.collect()}


def some(rnd, convs, most):
    said = ["Yes.", "yes", "", " \t", "No!", "Why?", "and", "é.", "a\nb.", None]
    roles = ["user", "assistant", "system", "tool", "", None, "user", "assistant"]
    return [(c if c else None, rnd.choice([None, t, t, t]), rnd.choice(roles), rnd.choice(said) if rnd.random() < 0.5 else f"{rnd.randint(0, 99)}{rnd.choice('.!x')}") for c in range(convs) for t in range(rnd.randint(0, most))]


def plain(rows):
    return [(c, t, " " if r is None else r, " " if x is None else x) for c, t, r, x in rows]


def test_semiring_products_may_be_grouped_freely():
    rnd = random.Random(1)
    for _ in range(200):
        kinds = "".join(rnd.choice("bdsuaoSUAO") for _ in range(rnd.randint(1, 12)))
        left = repair.ONE
        for k in kinds:
            left = repair.product(left, repair.step(k))
        cut = rnd.randint(0, len(kinds))
        assert repair.scan(kinds) == left == repair.product(repair.scan(kinds[:cut]), repair.scan(kinds[cut:]))


def test_short_conversations_equal_a_search(spark):
    rows = some(random.Random(2), 250, 9)
    want = {c: x[:8] for c, x in expected(plain(rows)).items()}
    assert rows_of(repair.repair(spark, spark.createDataFrame(rows, SCHEMA))) == want


def test_blocks_and_partitions_make_no_difference(spark, monkeypatch):
    monkeypatch.setattr(repair, "BLOCK", 4)
    monkeypatch.setattr(repair, "LEVEL_BITS", 1)
    rnd = random.Random(3)
    rows = some(rnd, 8, 12) + [(77, t if t % 7 else None, rnd.choice(["user", "assistant", "system"]), f"{rnd.randint(0, 60)}{rnd.choice('.x')}") for t in range(160)]
    want = expected(plain(rows))
    df = spark.createDataFrame(rows, SCHEMA).withColumn("block", F.lit("clash"))
    assert rows_of(repair.repair(spark, df)) == {c: x[:8] for c, x in want.items()}
    got = {}
    for r in sorted(repair.repaired_turns(spark, df).collect(), key=lambda r: (r.segment, r.place)):
        got.setdefault(r.conv_id, []).append((r.role, r.text))
    assert got == {c: list(x[8]) for c, x in want.items() if x[8]}


def test_the_query_repairs_damaged_rows(spark, tmp_path):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    rows += [(None, None, "user", "No id."), (900, None, None, None), *((901, t, "user", "same.") for t in range(30))]
    gone = next(c for c in range(1000, 3000) if zlib.crc32(f"{c}:0".encode()) % 20 == 0)
    rows.append((gone, 0, "user", "All of it is dropped."))
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{tmp_path}/conversations.parquet")
    want = {c: x[:8] for c, x in expected(damage(rows)).items()}
    for c in {r[0] for r in rows} - set(want):
        want[c] = (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())
    assert gone in want
    assert rows_of(queries.op12_repair(spark, str(tmp_path))) == want


def test_empty_table(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert repair.repair(spark, none).count() == 0 and repair.repaired_turns(spark, none).count() == 0
