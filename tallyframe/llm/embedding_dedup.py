"""Embedding near-deduplication by collision-counting projections.

Unit vectors are projected on many random directions. Each projection is sorted and only its two ends count, where
few vectors stand: two vectors collide when they stand in the same end and one is in the other's query-centred
window. Over all directions the collisions of a pair follow a binomial law that depends on its cosine alone, so the
count that a pair must reach is calibrated to miss pairs at the threshold with a stated chance, whatever the data.
Pairs that reach it are verified in double precision.

An end is a list of bounded expected length. Its rows carry the vector and its places in all lists, so a task counts
a pair's collisions and verifies it in the first list where they collide, and returns sums: each vector's number of
links and its smallest linked neighbour in the list. No pair is ever written. Lists that a dense group makes long
are dealt out in pairs of blocks. Equal vectors share one representative.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, connected_components
from .vectors import component_type, most_count, packed_vectors, stacked, tail_point, together, usable

#: Expected list length and collisions at the threshold, half-width of a window, chance of missing a pair there.
LIST, COLLISIONS, WIDTH, MISS = 48, 14.0, 1.25, 1e-3
LEAST_SHARE, BLOCK, PAIRS = 1e-4, 1024, 1 << 14
#: Bytes of directions that a worker keeps.
DIRECTION_BYTES = 128 << 20
CELLS = "list long, low int, high int, block int, id long, copies long, vec binary, lists binary, places binary"


@dataclass(frozen=True)
class Plan:
    """Directions, where their ends begin, and the collisions that a pair must reach."""

    directions: int
    end: float
    count: int

    @classmethod
    def of(cls, n: int, cosine: float) -> Plan:
        share = min(0.25, max(LEAST_SHARE, LIST / max(n, 1)))
        end = tail_point(share)
        chance = 2 * share * together(end, cosine, WIDTH)
        directions = math.ceil(COLLISIONS / chance)
        return cls(directions, end, most_count(directions, chance, MISS))


def placed(reps: DataFrame, plan: Plan, kind: type) -> DataFrame:
    """One row for each end that a vector stands in: ``list, id, copies, vec, lists, places``."""
    slab = 4096

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made: dict[tuple[int, int], np.ndarray] = {}
        for batch in batches:
            dims = batch.column("dim").to_numpy()
            for dim in np.unique(dims):
                part = batch.filter(pa.array(dims == dim))
                unit = stacked(part.column("vec"), kind)
                unit = (unit / np.linalg.norm(unit, axis=1, keepdims=True)).astype(np.float32)
                rows, ends, places = [], [], []
                for k in range(0, plan.directions, slab):
                    slab_of = made.get((dim, k))
                    if slab_of is None:
                        slab_of = np.random.default_rng([19, int(dim), k]).standard_normal((dim, min(slab, plan.directions - k)), np.float32)
                        if 4 * dim * (k + slab) <= DIRECTION_BYTES:  # the rest is made anew for each batch
                            made[dim, k] = slab_of
                    for a in range(0, len(unit), 1024):
                        y = unit[a : a + 1024] @ slab_of
                        i, j = np.nonzero(np.abs(y) >= plan.end)
                        rows.append(i + a)
                        ends.append(2 * (j + k) + (y[i, j] > 0))
                        places.append(np.abs(y[i, j]))
                rows, ends, places = np.concatenate(rows), np.concatenate(ends), np.concatenate(places)
                order = np.lexsort((ends, rows))
                rows, ends, places = rows[order], ends[order].astype(np.int32), places[order].astype(np.float32)
                bounds = np.searchsorted(rows, np.arange(len(unit) + 1))
                lists = pa.array([ends[a:b].tobytes() for a, b in zip(bounds, bounds[1:], strict=False)], pa.binary())
                where = pa.array([places[a:b].tobytes() for a, b in zip(bounds, bounds[1:], strict=False)], pa.binary())
                for a in range(0, len(rows), 4096):  # a row for each end
                    at = pa.array(rows[a : a + 4096])
                    key = pa.array(ends[a : a + 4096].astype(np.int64) | (int(dim) << 40))
                    yield pa.RecordBatch.from_arrays([key, part.column("id").take(at), part.column("copies").take(at), part.column("vec").take(at), lists.take(at), where.take(at)], ["list", "id", "copies", "vec", "lists", "places"])

    return reps.mapInArrow(run, "list long, id long, copies long, vec binary, lists binary, places binary")


def padded(column: pa.Array, kind: type, blank: float) -> np.ndarray:
    parts = [np.frombuffer(x, kind) for x in column.to_pylist()]
    out = np.full((len(parts), max(map(len, parts))), blank, kind)
    for row, part in zip(out, parts, strict=True):
        row[: len(part)] = part
    return out


def collisions(lists: np.ndarray, places: np.ndarray, here: int) -> tuple[np.ndarray, np.ndarray]:
    """Collisions of all pairs of rows, and those in lists before ``here``.

    Presence matrices of the lists that two rows share give pairs that stand in one end; where an end is wider than a
    window, the pairs outside each other's windows are taken off again.
    """
    row, column = np.nonzero(lists >= 0)
    found, at, size = np.unique(lists[row, column], return_inverse=True, return_counts=True)
    common = np.flatnonzero(size >= 2)
    kept = size[at] >= 2
    row, at, place = row[kept], np.searchsorted(common, at[kept]), places[row, column][kept]
    present = np.zeros((len(lists), len(common)), np.float32)
    present[row, at] = 1
    before = int(np.searchsorted(found[common], here))
    every, earlier = present @ present.T, present[:, :before] @ present[:, :before].T
    order = np.argsort(at, kind="stable")
    row, place = row[order], place[order]
    first = np.searchsorted(at[order], np.arange(len(common)))
    if len(common):
        spread = np.maximum.reduceat(place, first) - np.minimum.reduceat(place, first)
        for c in np.flatnonzero(spread > WIDTH):
            mine = slice(first[c], first[c + 1] if c + 1 < len(common) else len(row))
            apart = (np.abs(place[mine][:, None] - place[mine]) > WIDTH).astype(np.float32)
            every[np.ix_(row[mine], row[mine])] -= apart
            if c < before:
                earlier[np.ix_(row[mine], row[mine])] -= apart
    return every, earlier


def linked_in(cell: pa.Table, plan: Plan, cosine: float, kind: type) -> pa.RecordBatch | None:
    """Links found in one cell: ``id, n, low``, the links of each vector and the smallest id it is joined with.

    A pair belongs to the first list in which it collides, if it collides often enough.
    """
    here = cell["list"][0].as_py() & ((1 << 40) - 1)
    two = cell["low"][0].as_py() != cell["high"][0].as_py()
    cell = cell.combine_chunks()
    lists, places = padded(cell["lists"].chunk(0), np.int32, -1), padded(cell["places"].chunk(0), np.float32, np.nan)
    mine = places[np.arange(len(lists)), (lists == here).argmax(axis=1)]
    ids, copies, block = (cell[c].to_numpy() for c in ("id", "copies", "block"))
    every, earlier = collisions(lists, places, here)
    owned = (every >= plan.count) & (earlier == 0) & (np.abs(mine[:, None] - mine) <= WIDTH)
    if two:
        owned &= block[:, None] != block
    a, b = np.nonzero(np.triu(owned, 1))
    vectors = stacked(cell["vec"].chunk(0), kind)
    vectors = vectors / np.linalg.norm(vectors, axis=1, keepdims=True)
    near = np.zeros(len(a), bool)
    for k in range(0, len(a), PAIRS):
        near[k : k + PAIRS] = np.einsum("ij,ij->i", vectors[a[k : k + PAIRS]], vectors[b[k : k + PAIRS]]) >= cosine
    a, b = a[near], b[near]
    if not len(a):
        return None
    n = np.bincount(a, copies[b], len(ids)) + np.bincount(b, copies[a], len(ids))
    low = ids.copy()
    while True:
        before = low.copy()
        np.minimum.at(low, a, before[b])
        np.minimum.at(low, b, before[a])
        if (low == before).all():
            break
    some = n > 0
    return pa.RecordBatch.from_arrays([pa.array(ids[some]), pa.array(n[some].astype(np.int64)), pa.array(low[some])], ["id", "n", "low"])


def links(cells: DataFrame, plan: Plan, cosine: float, kind: type) -> DataFrame:
    """Runs ``linked_in`` over cells that stand together in sorted partitions."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.Table | None = None
        for batch in batches:
            table = pa.Table.from_batches([batch])
            table = table if held is None else pa.concat_tables([held, table])
            key = np.stack([table[c].to_numpy().astype(np.int64) for c in ("list", "low", "high")], axis=1)
            cut = np.r_[0, np.flatnonzero((np.diff(key, axis=0) != 0).any(axis=1)) + 1]
            for a, b in zip(cut, cut[1:], strict=False):
                if b - a > 1 and (found := linked_in(table.slice(a, b - a), plan, cosine, kind)) is not None:
                    yield found
            held = table.slice(cut[-1])
        if held is not None and len(held) > 1 and (found := linked_in(held, plan, cosine, kind)) is not None:
            yield found

    return cells.mapInArrow(run, "id long, n long, low long")


def near_vectors(spark: SparkSession, rows: DataFrame, cosine: float = 0.9, key: str = "vec_id", column: str = "embedding") -> DataFrame:
    """``vec_id, n_links, component_id, kept`` for every row.

    Vectors are linked when their cosine in double precision is at least ``cosine``; n_links counts a vector's
    direct links, component_id is the smallest id reachable and kept marks it. Every returned link is verified; a
    pair at the threshold is missed with a chance of about ``MISS``, a nearer one more rarely. Vectors that are null,
    empty, zero, or hold null or non-finite components link with nothing, as do vectors of different lengths. Rows
    that repeat a vector are linked; rows that repeat an id share its links and component. An empty table gives no rows, and
    other columns are ignored.
    """
    scratch = Scratch(spark, "embedding-dedup")
    kind = component_type(rows, column)
    base = rows.select(F.col(key).cast("long").alias("id"), F.col(column).alias("vector"))
    good = scratch.put(packed_vectors(base.where(usable("vector") & F.col("id").isNotNull()), "vector"), "vectors")
    reps = scratch.put(good.groupBy("vec", "dim").agg(F.min("id").alias("rep"), F.count(F.lit(1)).alias("copies")), "representatives")
    n = reps.count()
    plan = Plan.of(n, cosine)
    # a few hundred vectors fill a task: projecting is most of the work
    dealt = reps.select(F.col("rep").alias("id"), "copies", "vec", "dim").repartition(max(1, min(-(-n // 512), 4096)), "id")
    ends = scratch.put(placed(dealt, plan, kind), "ends")
    sizes = ends.groupBy("list").count().where(F.col("count") > BLOCK)
    long_lists = scratch.put(sizes.select("list", F.ceil(F.col("count") / (BLOCK // 2)).cast("int").alias("blocks")), "long-lists")
    cells = ends.withColumn("blocks", F.lit(1))
    if not long_lists.isEmpty():
        cells = ends.join(long_lists, "list", "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
    cells = cells.withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))
    cells = cells.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    cells = cells.select("list", F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high"), "block", "id", "copies", "vec", "lists", "places")
    spread = max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    found = scratch.put(links(cells.repartition(spread, "list", "low", "high").sortWithinPartitions("list", "low", "high"), plan, cosine, kind), "links")
    scratch.drop(ends)
    label = connected_components(found.where("id <> low").select(F.col("id").alias("a"), F.col("low").alias("b")), scratch)
    counted = found.groupBy("id").agg(F.sum("n").alias("n")).join(label, "id", "left").select(F.col("id").alias("rep"), "n", "component")
    classes = reps.join(counted, "rep", "left").select("vec", "dim", (F.col("copies") - 1 + F.coalesce("n", F.lit(0))).alias("n_links"), F.coalesce("component", "rep").alias("component_id"))
    alike = good.join(classes, ["vec", "dim"]).select("id", "n_links", "component_id")
    alone = base.where(~(usable("vector") & F.col("id").isNotNull())).select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"))
    both = alike.unionByName(alone)
    return both.select(F.col("id").alias(key), "n_links", "component_id", F.coalesce(F.col("id") == F.col("component_id"), F.lit(True)).alias("kept"))
