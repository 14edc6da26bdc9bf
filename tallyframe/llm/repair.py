"""Structure repair of conversations by a min-plus matrix scan.

A repaired conversation's roles are ``(system? (user assistant)+)?``, known by four states: nothing yet, after system,
after user, after assistant. Each turn is a 4x4 matrix from the state before it to the state after it, whose entries
are pairs of cost and audit: the cheapest way to keep, rerole or delete the turn, after any turns inserted before it
(the insert closure). Matrices multiply over the semiring whose sum is the lesser pair (by cost, then audit in ASCII
order) and whose product adds costs and joins audits. As an audit and its turns tell its cost, no audit can be a proper
prefix of another of the same cost, so products keep the order, the semiring is sound and products may be grouped freely.

Turns are sorted across partitions by conversation and turn. A task multiplies what it holds of a conversation; what
begins and ends inside a partition is done there. A conversation that crosses partitions, or is longer than a block, goes on
as blocks, whose matrices meet in a tree by partition numbers. The cheapest audit is then cut again for the blocks.
"""

from __future__ import annotations

import functools
import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, small_batches

#: Turns and characters of a block; bits of a block's number within its partition, and of each level of the tree.
BLOCK, BLOCK_CHARS, BLOCK_BITS, LEVEL_BITS = 128, 1 << 18, 30, 5
BLANKS = " \t\n\x0b\x0c\r"
START, SYSTEM, USER, ASSISTANT = range(4)
STATES = range(4)
ENDS = (START, ASSISTANT)
LEGAL = {"su", "ua", "au"}
REROLE, DELETE, INSERT, TRUNCATED = 2, 3, 2, 1
#: Moves by the initial of a role that is put out.
MOVES = {"s": {START: SYSTEM}, "u": {START: USER, SYSTEM: USER, ASSISTANT: USER}, "a": {USER: ASSISTANT}}
#: A turn's kind: b blank, d duplicate; else the initial of its role (o for others), a capital if truncated.
FORCED = "bd"

Entry = tuple[int, str]
Matrix = tuple[tuple[Entry | None, ...], ...]
ONE: Matrix = tuple(tuple((0, "") if i == j else None for j in STATES) for i in STATES)


def product(a: Matrix, b: Matrix) -> Matrix:
    out = []
    for row in a:
        line = []
        for j in STATES:
            ways = [(x[0] + b[k][j][0], k) for k, x in enumerate(row) if x is not None and b[k][j] is not None]
            if not ways:
                line.append(None)
                continue
            least = min(ways)[0]
            line.append((least, min(row[k][1] + b[k][j][1] for cost, k in ways if cost == least)))
        out.append(tuple(line))
    return tuple(out)


def total(a: Matrix, b: Matrix) -> Matrix:
    """The lesser entry at each place."""
    return tuple(tuple(min((z for z in (x, y) if z is not None), default=None) for x, y in zip(r, s, strict=True)) for r, s in zip(a, b, strict=True))


def matrix(moves: list[tuple[int, int, Entry]]) -> Matrix:
    """The lesser of the entries at each place."""
    found: dict[tuple[int, int], Entry] = {}
    for i, j, entry in moves:
        found[i, j] = min(found.get((i, j), entry), entry)
    return tuple(tuple(found.get((i, j)) for j in STATES) for i in STATES)


def insert_closure() -> Matrix:
    once = matrix([(i, j, (INSERT, "I")) for c in "ua" for i, j in MOVES[c].items()])
    out, power = ONE, ONE
    for _ in range(len(STATES) - 1):
        power = product(power, once)
        out = total(out, power)
    return out


CLOSURE = insert_closure()


@functools.cache
def step(kind: str) -> Matrix:
    """A turn after any insertions."""
    moves = [(i, i, (DELETE, "D")) for i in STATES]
    if kind not in FORCED:
        more = TRUNCATED if kind.isupper() else 0
        moves += [(i, j, (more, "K")) for i, j in MOVES.get(kind.lower(), {}).items()]
        moves += [(i, j, (REROLE + more, "R")) for c in "ua" for i, j in MOVES[c].items()]
    return product(CLOSURE, matrix(moves))


@functools.lru_cache(50_000)
def short_run(kinds: str) -> Matrix:
    half = len(kinds) // 2
    return step(kinds) if len(kinds) == 1 else product(short_run(kinds[:half]), short_run(kinds[half:]))


def scan(kinds: str) -> Matrix:
    """The product of a run of turns."""
    return tree([short_run(kinds[i : i + 8]) for i in range(0, len(kinds), 8)])


def tree(parts: list[Matrix]) -> Matrix:
    while len(parts) > 1:
        parts = [product(*parts[i : i + 2]) if i + 1 < len(parts) else parts[i] for i in range(0, len(parts), 2)]
    return parts[0] if parts else ONE


def cheapest(whole: Matrix) -> Entry:
    return min(e for j, e in enumerate(product(whole, CLOSURE)[START]) if j in ENDS and e is not None)


def kind_of(role: str, text: str) -> str:
    body = text.rstrip(BLANKS)
    if not body:
        return "b"
    initial = role[:1] if role[:1] in MOVES else "o"
    return initial if body[-1] in ".!?" else initial.upper()


def rebuilt(audit: str, roles: list[str], texts: list[str], state: int) -> tuple[list[str], list[str], list[str], int]:
    """Roles, texts and edits of the turns that an audit's letters put out, and the state after them."""
    out, said, how, turn = [], [], [], iter(zip(roles, texts, strict=True))
    for letter in audit:
        role, text = ("", "") if letter == "I" else next(turn)
        if letter == "D":
            continue
        if letter != "K":
            role = "assistant" if state == USER else "user"
        out.append(role)
        said.append(text)
        how.append(letter)
        state = MOVES[role[0]][state]
    return out, said, how, state


def lines(roles: list[str], texts: list[str]) -> str:
    return "\n".join(map("{}:{}".format, roles, texts))


STATS = "n_turns long, blank long, duplicate long, truncated long, illegal long, first_initial string, last_initial string, low long, high long, n_distinct long"
BLOCKS = f"conv_id long, block long, done boolean, {STATS}, kinds string, marks array<binary>, roles array<string>, texts array<string>, cost long, audit string, repaired_sha256 string, edits array<string>"
NAMES = [f.split()[0] for f in BLOCKS.split(", ")]


def schema(ddl: str) -> pa.Schema:
    kinds = {"long": pa.int64(), "string": pa.string(), "boolean": pa.bool_(), "array<string>": pa.list_(pa.string()), "array<binary>": pa.list_(pa.binary()), "array<long>": pa.list_(pa.int64()), "array<int>": pa.list_(pa.int32())}
    return pa.schema([(n, kinds[k]) for n, k in (f.split() for f in ddl.split(", "))])


def batch_of(rows: list[dict], ddl: str) -> pa.RecordBatch:
    return pa.RecordBatch.from_pylist(rows, schema(ddl))


def counted(turns: list[int | None], roles: list[str], kinds: str) -> dict:
    known = [t for t in turns if t is not None]
    initials = [r[:1] for r in roles]
    return {
        "n_turns": len(roles), "blank": kinds.count("b"), "duplicate": kinds.count("d"), "truncated": sum(map(str.isupper, kinds)),
        "illegal": sum(a + b not in LEGAL or not a or not b for a, b in zip(initials, initials[1:], strict=False)),
        "first_initial": initials[0], "last_initial": initials[-1], "low": min(known, default=None), "high": max(known, default=None), "n_distinct": len(set(known)),
    }


def blocks(turns: DataFrame, keep: bool) -> DataFrame:
    """``BLOCKS`` of sorted turns: whole conversations, done, and blocks of those that may go on beyond the partition."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = (TaskContext.get().partitionId() if TaskContext.get() else 0) << BLOCK_BITS
        held: tuple[list, list, list] = ([], [], [])
        now, whole, chars, begun = None, False, 0, False

        def flushed(done: bool) -> dict:
            nonlocal number
            at, roles, texts = held
            seen, kinds = set(), []
            for said in zip(roles, texts, strict=True):
                kind = kind_of(*said)
                kinds.append("d" if kind != "b" and said in seen else kind)
                seen.add(said)
            kinds = "".join(kinds)
            row = {"conv_id": now, "block": number, "done": done, **counted(at, roles, kinds)}
            number += 1
            if not done:
                marks = [b"" if k in FORCED else hashlib.blake2b(f"{len(r)}:{r}{t}".encode(), digest_size=16).digest() for k, r, t in zip(kinds, roles, texts, strict=True)]
                return row | {"kinds": kinds, "marks": marks, "roles": roles, "texts": texts}
            cost, audit = cheapest(scan(kinds))
            out, said, how, _ = rebuilt(audit, roles, texts, START)
            row |= {"cost": cost, "audit": audit, "repaired_sha256": hashlib.sha256(lines(out, said).encode()).hexdigest()}
            return row | {"roles": out, "texts": said, "edits": how} if keep else row

        for batch in batches:
            found = []
            for conv, turn, role, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if held[0] and conv != now:
                    found.append(flushed(whole))
                    held, chars, whole = ([], [], []), 0, True
                elif len(held[0]) >= BLOCK or chars > BLOCK_CHARS:
                    found.append(flushed(False))
                    held, chars, whole = ([], [], []), 0, False
                now = conv
                for column, x in zip(held, (turn, role, text), strict=True):
                    column.append(x)
                chars += len(text)
            begun = begun or batch.num_rows > 0
            yield batch_of(found, BLOCKS)
        if begun:  # what a partition ends with may go on in the next
            yield batch_of([flushed(False)], BLOCKS)

    return turns.mapInArrow(run, BLOCKS)


ELEMENT = f"conv_id long, block long, {STATS}, costs array<long>, audits array<string>, blocks array<long>, sizes array<long>, level long"


def entries(m: Matrix) -> dict:
    flat = [e for row in m for e in row]
    return {"costs": [e and e[0] for e in flat], "audits": [e and e[1] for e in flat]}


def matrix_of(row: dict) -> Matrix:
    flat = [None if c is None else (c, a) for c, a in zip(row["costs"], row["audits"], strict=True)]
    return tuple(tuple(flat[4 * i : 4 * i + 4]) for i in STATES)


def elements(open_: DataFrame) -> DataFrame:
    """Each block as an element of the scan; ``repeats`` lists the turns that an earlier block has said."""

    def run(batches):
        for batch in batches:
            out = []
            for row in batch.to_pylist():
                kinds = list(row["kinds"])
                for i in row.pop("repeats") or ():
                    row["truncated"] -= kinds[i].isupper()
                    row["duplicate"] += 1
                    kinds[i] = "d"
                del row["kinds"]
                out.append(row | entries(scan("".join(kinds))) | {"blocks": [row["block"]], "sizes": [row["n_turns"]], "level": row["block"] >> BLOCK_BITS})
            yield batch_of(out, ELEMENT)

    stats = [f.split()[0] for f in STATS.split(", ")]
    return open_.select("conv_id", "block", *stats, "kinds", "repeats").mapInArrow(run, ELEMENT)


def joined(group: pa.Table) -> pa.Table:
    """A run of neighbouring elements as one."""
    rows = sorted(group.to_pylist(), key=lambda r: r["block"])
    out, last = dict(rows[0]), rows[0]["high"]
    for row in rows[1:]:
        for name in ("n_turns", "blank", "duplicate", "truncated", "illegal"):
            out[name] += row[name]
        pair = out["last_initial"] + row["first_initial"]
        out["illegal"] += pair not in LEGAL
        out["last_initial"] = row["last_initial"]
        out["n_distinct"] += row["n_distinct"] - (last is not None and last == row["low"])
        last = row["high"] if row["high"] is not None else last
        out["low"] = row["low"] if out["low"] is None else out["low"]
        out["blocks"], out["sizes"] = out["blocks"] + row["blocks"], out["sizes"] + row["sizes"]
    out["high"] = last
    out |= entries(tree([matrix_of(r) for r in rows])) | {"level": rows[0]["level"] >> LEVEL_BITS}
    return pa.Table.from_batches([batch_of([out], ELEMENT)])


SOLVED = f"conv_id long, {STATS}, cost long, audit string, blocks array<long>, slices array<string>, states array<int>"


def solved(whole: DataFrame) -> DataFrame:
    """Each conversation's cheapest audit, and its slice and first state for each block."""

    def run(batches):
        names = [f.split()[0] for f in SOLVED.split(", ")]
        for batch in batches:
            out = []
            for row in batch.to_pylist():
                cost, audit = cheapest(matrix_of(row))
                slices, states, at, state = [], [], 0, START
                edits = [i for i, c in enumerate(audit) if c != "I"]
                put, turns = 0, 0
                system = (len(audit) - audit.count("D")) % 2  # all but a first system turn come in pairs
                for i, size in enumerate(row["sizes"]):
                    turns += size
                    end = len(audit) if i + 1 == len(row["sizes"]) else edits[turns - 1] + 1
                    slices.append(audit[at:end])
                    states.append(state)
                    put += end - at - audit.count("D", at, end)
                    at = end
                    state = START if not put else SYSTEM if put == system else USER if (put - system) % 2 else ASSISTANT
                out.append({n: row.get(n) for n in names} | {"cost": cost, "audit": audit, "slices": slices, "states": states})
            yield batch_of(out, SOLVED)

    return whole.mapInArrow(run, SOLVED)


def rebuilt_blocks(cut: DataFrame) -> DataFrame:
    """``conv_id, block, roles, texts, edits`` of blocks that bring their slice and state."""

    def run(batches):
        for batch in batches:
            out = []
            for row in batch.to_pylist():
                roles, texts, edits, _ = rebuilt(row["slice"], row["roles"], row["texts"], row["state"])
                out.append({"conv_id": row["conv_id"], "block": row["block"], "roles": roles, "texts": texts, "edits": edits})
            yield batch_of(out, SEGMENTS)

    return cut.mapInArrow(run, SEGMENTS)


SEGMENTS = "conv_id long, block long, roles array<string>, texts array<string>, edits array<string>"
HASHES = "conv_id long, repaired_sha256 string"


def hashed(segments: DataFrame) -> DataFrame:
    """The hash of each conversation's lines, its segments read one after the other."""

    def run(batches):
        now, digest = None, None
        for batch in batches:
            out = []
            for row in batch.to_pylist():
                if digest is None or row["conv_id"] != now:
                    if digest is not None:
                        out.append({"conv_id": now, "repaired_sha256": digest.hexdigest()})
                    now, digest, empty = row["conv_id"], hashlib.sha256(), True
                said = lines(row["roles"], row["texts"])
                if row["roles"]:
                    digest.update((said if empty else "\n" + said).encode())
                    empty = False
            yield batch_of(out, HASHES)
        if digest is not None:
            yield batch_of([{"conv_id": now, "repaired_sha256": digest.hexdigest()}], HASHES)

    return segments.repartition("conv_id").sortWithinPartitions("conv_id", "block").mapInArrow(run, HASHES)


def analysed(spark: SparkSession, turns: DataFrame, keep: bool) -> tuple[DataFrame, DataFrame | None, DataFrame | None]:
    """Done conversations, and the solved ones of several blocks with their rebuilt segments, if any."""
    scratch = Scratch(spark, "repair")
    said = [F.coalesce(F.col(c).cast("string"), F.lit(" ")).alias(c) for c in ("role", "text")]
    rows = turns.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), *said)
    # turns of one number are told apart by the start of what they say, so that equal turns stay together
    dealt = rows.repartitionByRange("conv_id", "turn", "role", F.substring("text", 1, 32)).sortWithinPartitions("conv_id", "turn", "role", "text")
    found = scratch.put(blocks(dealt, keep), "blocks")
    open_ = found.where("not done")
    last = open_.agg(F.max(F.shiftright("block", BLOCK_BITS))).first()[0]
    if last is None:
        return found, None, None
    thin = open_.select("conv_id", "block", F.posexplode("marks").alias("place", "mark")).where(F.length("mark") > 0).withColumn("at", F.struct("block", "place"))
    first = thin.groupBy(F.col("conv_id").alias("c"), F.col("mark").alias("m")).agg(F.min("at").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1")
    repeats = thin.join(first, F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("mark") == F.col("m"))).where("at > first").groupBy("block").agg(F.collect_list("place").alias("repeats"))
    tree_ = elements(open_.join(repeats, "block", "left"))
    for _ in range(1 + -(-int(last).bit_length() // LEVEL_BITS)):
        tree_ = tree_.groupBy("conv_id", "level").applyInArrow(joined, ELEMENT)
    answers = scratch.put(solved(tree_), "solved")
    cut = answers.select(F.explode(F.arrays_zip("blocks", "slices", "states")).alias("x")).select(F.col("x.blocks").alias("block"), F.col("x.slices").alias("slice"), F.col("x.states").alias("state"))
    return found, answers, rebuilt_blocks(open_.select("conv_id", "block", "roles", "texts").join(cut, "block"))


def repair(spark: SparkSession, turns: DataFrame) -> DataFrame:
    """One row for each conv_id of ``turns`` (conv_id, turn, role, text; others are ignored):
    ``conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256``.

    Turns are read in the order of turn (nulls first), those of one number by role and text. Null roles and texts are
    a blank each, a null conv_id is a conversation of its own, a role that begins with none of s, u and a can't be
    kept. A turn is blank, or a duplicate of an earlier one's role and text, or truncated (its last character, blanks
    left out, is none of ``.!?``), by the first that holds; blank and duplicate turns must go. gaps counts the numbers
    that are missing between the least and the greatest turn, illegal the neighbours whose initials aren't su, ua or
    au. The edits, K (keep, 0), R (role becomes user or assistant, 2), D (delete, 3) and I (insert an empty turn, 2), and 1
    for a truncated turn that isn't deleted, are the cheapest that give ``(s?(ua)+)?``; audit has their letters in
    order, the least in ASCII of several. The hash is of the repaired ``role:text`` lines. An empty table gives no rows.
    """
    small_batches(spark)
    found, answers, segments = analysed(spark, turns, keep=False)
    gaps = F.coalesce(F.col("high") - F.col("low") + 1 - F.col("n_distinct"), F.lit(0)).alias("gaps")
    columns = ["conv_id", gaps, "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
    done = found.where("done").select(*columns)
    if answers is None:
        return done
    hashes = hashed(segments).withColumnRenamed("conv_id", "c")
    return done.unionByName(answers.join(hashes, F.col("conv_id").eqNullSafe(F.col("c"))).select(*columns))


def repaired_turns(spark: SparkSession, turns: DataFrame) -> DataFrame:
    """The repaired turns, ``conv_id, segment, place, role, text, edit`` (K, R or I): in a conversation, segments and
    the places in them ascend. Turns are read as by ``repair``; a conversation without turns after repair has no rows."""
    small_batches(spark)
    found, answers, segments = analysed(spark, turns, keep=True)
    out = found.where("done").select("conv_id", "block", "roles", "texts", "edits")
    out = out if answers is None else out.unionByName(segments)
    each = out.select("conv_id", F.col("block").alias("segment"), F.posexplode(F.arrays_zip("roles", "texts", "edits")).alias("place", "x"))
    return each.select("conv_id", "segment", "place", F.col("x.roles").alias("role"), F.col("x.texts").alias("text"), F.col("x.edits").alias("edit"))


def damaged(turns: DataFrame) -> DataFrame:
    """Faults for tests of the repair, by ``crc32(conv_id:turn) % 20`` (nulls are a blank): 0 drops a turn, 1 empties its
    text, 2 takes ``.!?`` out of it, 3 repeats it, 4 makes its role user."""
    blank = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    fault = (F.crc32(F.concat(blank("conv_id"), F.lit(":"), blank("turn"))) % 20).alias("fault")
    rows = turns.select("conv_id", "turn", blank("role").alias("role"), blank("text").alias("text"), fault).where("fault <> 0")
    text = F.when(F.col("fault") == 1, "").when(F.col("fault") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    copies = F.explode(F.sequence(F.lit(1), F.when(F.col("fault") == 3, 2).otherwise(1)))
    return rows.select("conv_id", "turn", F.when(F.col("fault") == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"), copies.alias("copy")).drop("copy")
