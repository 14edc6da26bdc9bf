"""MinHash near-deduplication with Odd sketches.

Every distinct set of word shingles gets MinHash samples; bands of samples propose candidates, and the samples
folded into a parity bitmap (an Odd sketch) discard unlikely ones: the population count ``d`` of the XOR of two
bitmaps of ``n`` bits over ``k`` samples estimates the Jaccard similarity as ``1 + n / (4 k) * ln(1 - 2 d / n)``.
What passes is confirmed on full shingle sets, so no false link is returned.

Each member of a band bucket first proposes its nearest partners by their sketches, and buckets that still span several
components propose again, across components, with more partners each time. When hardly any proposal is a link, a last
turn compares what is left whole: every pair across components that the sketches let pass, block against block, once.
Copies share one representative.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, connected_components
from .words import U64, mix, rolling, word_chunks

#: MinHash samples; bands and the samples of each; bits of a sketch, which folds all samples.
SAMPLES, BANDS, ROWS, BITS = 512, 36, 7, 512
#: The Odd sketch discards a pair whose estimate is this much below the threshold, over four standard errors.
MARGIN = 0.1
#: The turns of nearest partners end when one in so many proposals is a link at most.
FEW = 50
#: Rows of a matrix of shingles, and of a batch; members of a bucket compared at once; partners that a member proposes
#: in a bucket at the first, second and later turns; pairs whose bands are compared at once.
BLOCK, CELL, PARTNERS, PAIRS = 1024, 1024, (1, 2, 3), 1 << 14


def shingle_sets(column: pa.Array, k: int) -> Iterator[np.ndarray]:
    """Each row's distinct shingle hashes, ascending; fewer words than ``k`` are one shingle, none are no shingle."""
    for w in word_chunks(column, fold=True):
        grams = rolling(w.hashes, k, 11)
        for i in range(w.last - w.first):
            a, b = int(w.bounds[i]), int(w.bounds[i + 1])
            if b - a >= k:
                yield np.unique(grams[a : b - k + 1])
            elif b > a:
                yield mix(rolling(w.hashes[a:b], b - a, 11) + U64(b - a))
            else:
                yield np.zeros(0, U64)


def samples_of(sets: list[np.ndarray]) -> np.ndarray:
    """MinHash samples, one row for each set; each of ``SAMPLES`` affine permutations keeps its smallest value."""
    rng = np.random.default_rng(5)
    scale = rng.integers(0, 1 << 31, SAMPLES, dtype=np.uint32) * np.uint32(2) + np.uint32(1)
    shift = rng.integers(0, 1 << 32, SAMPLES, dtype=np.uint32)
    out = np.full((len(sets), SAMPLES), 0xFFFFFFFF, np.uint32)
    for i, s in enumerate(sets):
        x = (s >> U64(32)).astype(np.uint32)
        for a in range(0, len(x), BLOCK):
            np.minimum(out[i], (x[a : a + BLOCK, None] * scale + shift).min(axis=0), out=out[i])
    return out


def bands_of(samples: np.ndarray) -> np.ndarray:
    rng = np.random.default_rng(6)
    factors = rng.integers(1, 1 << 63, ROWS, dtype=np.uint64) * U64(2) + U64(1)
    rows = samples[:, : BANDS * ROWS].astype(U64).reshape(len(samples), BANDS, ROWS)
    return mix((rows * factors).sum(axis=2, dtype=U64) + np.arange(1, BANDS + 1, dtype=U64) * U64(0xD1B54A32D192ED03))


def odd_sketches(samples: np.ndarray) -> np.ndarray:
    """Parity bitmaps of the set of (position, sample) pairs, as unsigned 64-bit words."""
    place = mix(samples.astype(U64) + (np.arange(1, SAMPLES + 1, dtype=U64) << U64(32)))
    bit = (place >> U64(64 - BITS.bit_length() + 1)).astype(np.int64) + np.arange(len(samples))[:, None] * BITS
    odd = np.bincount(bit.ravel(), minlength=len(samples) * BITS).astype(np.uint8) & 1
    return np.packbits(odd.reshape(len(samples), BITS), axis=1).view(U64)


def longs(rows: np.ndarray) -> pa.Array:
    """A two-dimensional array as a list column."""
    n, width = rows.shape
    return pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * width), pa.array(np.ascontiguousarray(rows).reshape(-1).view(np.int64)))


def slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches of at most ``BLOCK`` rows, whose sets and samples are held at once."""
    for batch in batches:
        for a in range(0, max(1, batch.num_rows), BLOCK):
            yield batch.slice(a, BLOCK)


SIGNATURE = "doc_id long, n_shingles long, set_a long, set_b long, bands array<long>, sketch array<long>"


def signatures(docs: DataFrame, k: int) -> DataFrame:
    """``SIGNATURE`` of every document; set_a and set_b identify the set of shingles."""

    def run(batches):
        for batch in slices(batches):
            sets = list(shingle_sets(batch.column(1), k))
            samples = samples_of(sets)
            ids = np.zeros((len(sets), 2), U64)
            for i, s in enumerate(sets):
                ids[i] = mix(s).sum(dtype=U64), mix(s ^ U64(0xA5A5A5A5A5A5A5A5)).sum(dtype=U64)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([len(s) for s in sets], pa.int64()), pa.array(ids[:, 0].view(np.int64)), pa.array(ids[:, 1].view(np.int64)), longs(bands_of(samples)), longs(odd_sketches(samples))],
                ["doc_id", "n_shingles", "set_a", "set_b", "bands", "sketch"],
            )

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, SIGNATURE)


def full_sets(docs: DataFrame, k: int) -> DataFrame:
    def run(batches):
        for batch in slices(batches):
            sets = list(shingle_sets(batch.column(1), k))
            ends = np.cumsum([0, *map(len, sets)]).astype(np.int32)
            values = np.concatenate(sets).view(np.int64) if sets else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(pa.array(ends), pa.array(values))], ["id", "grams"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "id long, grams array<long>")


def most_odd_bits(threshold: float) -> int:
    """The largest XOR population count whose estimate is at least ``threshold - MARGIN``."""
    least = max(0.0, threshold - MARGIN)
    return int(BITS / 2 * (1 - math.exp((least - 1) * 4 * SAMPLES / BITS)))


def near_duplicates(spark: SparkSession, docs: DataFrame, threshold: int = 80, shingle: int = 5) -> DataFrame:
    """``doc_id, n_shingles, component_id, kept`` for every row of ``docs`` (doc_id, text; others are ignored).

    Documents are linked when 100 * |A & B| >= threshold * |A | B| over their sets of ``shingle``-word shingles
    (A-Z lower-cased). component_id is the smallest doc_id reachable by links and kept marks that document. Null,
    empty and blank texts have no shingles and link with nothing; texts shorter than a shingle are one shingle.
    Rows that repeat a doc_id and text return one row each; a null doc_id is its own unlinked row. An empty table
    gives no rows. Every document is read whole, and no bucket, candidate or component is capped.
    """
    scratch = Scratch(spark, "near-dedup")
    docs = docs.select("doc_id", "text")
    sig = scratch.put(signatures(docs, shingle), "signatures")
    classes = scratch.put(sig.where("n_shingles > 0 and doc_id is not null").groupBy("set_a", "set_b", "n_shingles").agg(F.min("doc_id").alias("id")), "classes")
    reps = scratch.put(sig.join(classes.select(F.col("id").alias("doc_id")), "doc_id", "left_semi").dropDuplicates(["doc_id"]).select(F.col("doc_id").alias("id"), "n_shingles", "bands", "sketch"), "representatives")
    banded = reps.select("id", F.explode("bands").alias("key"))
    # written, so that the join has an exchange of its own, whose large keys Spark can split
    shared = scratch.put(banded.groupBy("key").agg(F.count(F.lit(1)).alias("size")).where("size > 1"), "buckets")
    members = scratch.put(banded.join(shared, "key").join(reps.select("id", "n_shingles", "sketch"), "id"), "members")
    sets = scratch.put(full_sets(docs.join(members.select(F.col("id").alias("doc_id")).distinct(), "doc_id", "left_semi").dropDuplicates(["doc_id"]), shingle), "sets")

    label: DataFrame | None = None
    tested: DataFrame | None = None
    turn, last = 0, False
    while True:
        at = members.withColumn("component", F.col("id"))
        if label is not None:
            at = members.join(label, "id", "left").withColumn("component", F.coalesce("component", "id"))
        if turn:
            shares = at.groupBy("key", "component").agg(F.count(F.lit(1)).alias("n")).groupBy("key")
            open_ = shares.agg(F.max_by("component", F.struct("n", "component")).alias("major"), (F.sum("n") - F.max("n")).alias("minors")).where("minors > 0")
            at = at.join(scratch.put(open_, f"open{turn}"), "key")
        found = crossings(at.join(reps.select("id", "bands"), "id"), threshold) if last else candidates(at, turn, threshold).distinct()
        if tested is not None:
            found = found.join(tested, ["a", "b"], "left_anti")
        found = scratch.put(found, f"candidates{turn}")
        tested = found if tested is None else tested.union(found)
        linked = scratch.put(confirmed(found, sets, threshold), f"links{turn}")
        links = linked.count()
        if links:
            label = joined_up(linked, label, scratch)
        if last:
            break
        # once most proposals are refuted, nearest partners tell no more: the rest is compared whole
        turn, last = turn + 1, turn > 0 and links * FEW <= found.count()
    if label is None:
        label = linked.select(F.col("a").alias("id"), F.col("b").alias("component"))
    scratch.drop(sets, members, reps)
    final = sig.join(classes, ["set_a", "set_b", "n_shingles"], "left").join(label, "id", "left")
    component = F.when(F.col("n_shingles") > 0, F.coalesce("component", "id")).otherwise(F.col("doc_id"))
    return final.select("doc_id", "n_shingles", F.coalesce(component, "doc_id").alias("component_id")).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def joined_up(linked: DataFrame, label: DataFrame | None, scratch: Scratch) -> DataFrame:
    """The components of ``label`` joined by new links: only the new links, between components, are contracted."""
    if label is None:
        return connected_components(linked, scratch)
    ends = linked
    for c in ("a", "b"):
        ends = ends.join(label.select(F.col("id").alias(c), F.col("component").alias("to")), c, "left").withColumn(c, F.coalesce("to", c)).drop("to")
    roots = connected_components(ends, scratch)
    known = label.join(roots.select(F.col("id").alias("component"), F.col("component").alias("to")), "component", "left").select("id", F.coalesce("to", "component").alias("component"))
    return scratch.put(known.unionByName(roots.join(label.select("id"), "id", "left_anti")), "labels")


def candidates(members: DataFrame, turn: int, threshold: int) -> DataFrame:
    """Pairs ``(a, b)`` of different components that share a bucket and that the Odd sketches don't rule out.

    Each member proposes only its nearest partners in its bucket by their sketches (one at first, more at each turn),
    so the pairs follow the rows. Buckets of more than ``CELL`` members are dealt into cells, anew at each turn.
    """
    cells = F.ceil(F.col("size") / CELL)
    dealt = members.select("key", F.pmod(F.xxhash64("id", "key", F.lit(turn)), cells).alias("cell"), "id", "n_shingles", "component", "sketch", F.lit(True).alias("left"), F.lit(True).alias("right"))
    return proposed(dealt, threshold, PARTNERS[min(turn, len(PARTNERS) - 1)])


def crossings(members: DataFrame, threshold: int) -> DataFrame:
    """All pairs ``(a, b)`` of different components that share a bucket and that the Odd sketches don't rule out.

    The members of a bucket outside its largest component (``major``) are compared with one another and with that
    component: both are dealt into blocks of about ``CELL``, and every two blocks meet in a cell of their own. A pair
    of several buckets comes from the first of them alone, which its two lists of bands tell.
    """
    minor = F.col("component") != F.col("major")
    minors, majors = F.ceil(F.col("minors") / CELL), F.ceil((F.col("size") - F.col("minors")) / CELL)
    block = F.pmod(F.xxhash64("id", "key"), F.when(minor, minors).otherwise(majors))
    held = members.select("key", "id", "n_shingles", "component", "sketch", "bands", minor.alias("minor"), minors.alias("minors"), majors.alias("majors"), block.alias("block"))

    def cell(i: Column, j: Column) -> Column:
        return F.struct((i * (F.col("minors") + F.col("majors")) + j).alias("cell"), (F.col("minor") & (i == F.col("block"))).alias("left"), (~F.col("minor") | (j == F.col("block"))).alias("right"))

    # cell (i, j): block i of the others on the left, and on the right their block j, or that of the major component
    own = F.transform(F.sequence("block", F.col("minors") + F.col("majors") - 1), lambda j: cell(F.col("block"), j))
    later = F.transform(F.sequence(F.lit(0).cast("long"), "block"), lambda i: cell(i, F.col("block")))
    major = F.transform(F.sequence(F.lit(0).cast("long"), F.col("minors") - 1), lambda i: cell(i, F.col("minors") + F.col("block")))
    met = F.when(F.col("minor"), F.array_distinct(F.concat(own, later))).otherwise(major)
    dealt = held.withColumn("met", F.explode(met)).select("key", "met.cell", "id", "n_shingles", "component", "sketch", "bands", "met.left", "met.right")
    return proposed(dealt, threshold, None)


def proposed(dealt: DataFrame, threshold: int, nearest: int | None) -> DataFrame:
    """The pairs ``(a, b)`` of left and right rows of a cell, each left row with its nearest partners or with all."""
    dealt = dealt.repartition("key", "cell").sortWithinPartitions("key", "cell")
    limit = most_odd_bits(threshold / 100)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.Table | None = None
        for batch in batches:
            table = pa.Table.from_batches([batch])
            table = table if held is None else pa.concat_tables([held, table])
            key = np.stack([table["key"].to_numpy(), table["cell"].to_numpy()], axis=1)
            last = int(np.r_[0, np.flatnonzero((np.diff(key, axis=0) != 0).any(axis=1)) + 1][-1])
            yield proposals(table.slice(0, last), limit, threshold, nearest)
            held = table.slice(last)
        if held is not None:
            yield proposals(held, limit, threshold, nearest)

    return dealt.mapInArrow(run, "a long, b long")


def rows_of(column: pa.Array) -> np.ndarray:
    """A list column of one width as a matrix."""
    return column.flatten().to_numpy().reshape(len(column), -1)


def first_shared(bands: np.ndarray, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """The first band key that two rows share (they share one)."""
    return bands[x, (bands[x] == bands[y]).argmax(axis=1)]


def proposals(table: pa.Table, limit: int, threshold: int, nearest: int | None) -> pa.RecordBatch:
    """The nearest, or all, right partners of each left row of its cell (whole cells, standing together)."""
    table = table.combine_chunks()
    left, right = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    if len(table):
        ids, sizes, component, lefts, rights = (table[c].to_numpy() for c in ("id", "n_shingles", "component", "left", "right"))
        words = rows_of(table["sketch"].chunk(0)).view(U64)
        bands = rows_of(table["bands"].chunk(0)) if "bands" in table.column_names else None
        key = np.stack([table["key"].to_numpy(), table["cell"].to_numpy()], axis=1)
        cut = np.r_[0, np.flatnonzero((np.diff(key, axis=0) != 0).any(axis=1)) + 1, len(ids)]
        for a, b in zip(cut, cut[1:], strict=False):
            if b - a < 2:
                continue
            from_, to = a + np.flatnonzero(lefts[a:b]), a + np.flatnonzero(rights[a:b])
            for lo in range(0, len(from_) if len(to) else 0, 256):
                x = from_[lo : lo + 256]
                odd = np.bitwise_count(words[x, None] ^ words[None, to]).sum(axis=2, dtype=np.int32)
                small = np.minimum(sizes[x, None], sizes[None, to])
                large = np.maximum(sizes[x, None], sizes[None, to])
                odd[(component[x, None] == component[None, to]) | (small * 100 < large * threshold)] = BITS + 1
                if nearest is None or nearest >= len(to) - 1:
                    row, other = np.nonzero(odd <= limit)
                    row, other = x[row], to[other]
                    if bands is not None:
                        mine = np.concatenate([np.zeros(0, bool), *(first_shared(bands, row[i : i + PAIRS], other[i : i + PAIRS]) == key[a, 0] for i in range(0, len(row), PAIRS))])
                        row, other = row[mine], other[mine]
                    left.append(ids[row])
                    right.append(ids[other])
                    continue
                for _ in range(nearest):
                    best = odd.argmin(axis=1)
                    row = np.flatnonzero(odd[np.arange(len(x)), best] <= limit)
                    if not len(row):
                        break
                    left.append(ids[x[row]])
                    right.append(ids[to[best[row]]])
                    odd[row, best[row]] = BITS + 1
    x, y = np.concatenate(left), np.concatenate(right)
    pairs = np.unique(np.stack([np.maximum(x, y), np.minimum(x, y)], axis=1), axis=0)
    return pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(pairs[:, 0])), pa.array(np.ascontiguousarray(pairs[:, 1]))], ["a", "b"])


def confirmed(pairs: DataFrame, sets: DataFrame, threshold: int) -> DataFrame:
    """The pairs whose full shingle sets reach the threshold."""
    left, right = sets.select(F.col("id").alias("a"), F.col("grams").alias("x")), sets.select(F.col("id").alias("b"), F.col("grams").alias("y"))
    common = F.size(F.array_intersect("x", "y"))
    return pairs.join(left, "a").join(right, "b").withColumn("n", common).where(F.col("n") * 100 >= (F.size("x") + F.size("y") - F.col("n")) * threshold).select("a", "b")
