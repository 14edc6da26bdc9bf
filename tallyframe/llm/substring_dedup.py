"""Removal of long word passages that occur more than once, by compaction of a de Bruijn graph.

The edges of the graph are the ``window``-word k-mers of the corpus; a path is the run of consecutive edges that
share a minimiser (the smallest hash of an inner k-mer, its anchor). Equal windows have equal anchors at equal
offsets, so only paths of one anchor can share an edge:

* an anchor met once carries no repeated edge; its paths go at once;
* an anchor whose occurrences all carry the same path is nonbranching: the path is compacted into one repeated edge
  by a join on the anchor, and its source coordinates are marked whole;
* at a branching anchor, equal paths are compacted by a join on their hash, and one source of every distinct path is
  read again and expanded into its edges, which are compared within the anchor.

Only a few hundredths of the windows are shuffled, as one row for each path. Anchors and windows, and anchors and
paths, are compared as pairs of independent 64-bit hashes.
"""

from __future__ import annotations

from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch
from .words import TABLE, U64, Powers, hash_words, mix, rolling, text_buffer, word_chunks

ANCHOR_WORDS = 10
#: Paths hold at most this many windows, so a place packs a start and a count in one long.
PLACE = 256
STEP = U64(0xC2B2AE3D27D4EB4F)
STEPS = Powers(STEP, U64(pow(int(STEP), -1, 1 << 64)))
PATHS = "anchor long, path long, id long, crc long, place long"
EDGES = "anchor long, edge long, id long, crc long, place long, whole boolean"


def prefix_sums(hashes: np.ndarray) -> np.ndarray:
    total = np.zeros(len(hashes) + 1, U64)
    np.cumsum(hashes * STEPS.get(len(hashes) + 1)[0][: len(hashes)], out=total[1:])
    return total


def span_hashes(total: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """Hashes of the word spans [first, last), from sums that may belong to any longer sequence."""
    return mix((total[last] - total[first]) * STEPS.get(len(total))[1][first] + (last - first).astype(U64))


def paths_of(hashes: np.ndarray, bounds: np.ndarray, window: int, anchor: int) -> tuple[np.ndarray, ...]:
    """For each path: row, first window (absolute), number of windows, anchor hash and path hash."""
    empty = np.zeros(0, np.int64)
    inner = window - anchor + 1
    if len(hashes) < window:
        return empty, empty, empty, empty.astype(U64), empty.astype(U64)
    grams = rolling(hashes, anchor, 23)
    low = np.lib.stride_tricks.sliding_window_view(grams, inner).argmin(axis=1) + np.arange(len(grams) - inner + 1)
    lengths = np.diff(bounds)
    row = np.repeat(np.arange(len(lengths)), lengths)
    at = np.arange(len(low))
    valid = at + window <= bounds[1:][row[: len(low)]]
    at = at[valid]
    if not len(at):
        return empty, empty, empty, empty.astype(U64), empty.astype(U64)
    mine, where = low[at], row[at]
    cut = np.flatnonzero(np.r_[True, (np.diff(mine) != 0) | (np.diff(where) != 0) | (np.diff(at) != 1)])
    count = np.diff(np.r_[cut, len(at)])
    total = prefix_sums(hashes)
    return where[cut], at[cut], count, grams[mine[cut]], span_hashes(total, at[cut], at[cut] + count - 1 + window)


def paths(docs: DataFrame, window: int, anchor: int) -> DataFrame:
    def run(batches):
        for batch in batches:
            ids, crcs = batch.column(0).to_numpy(zero_copy_only=False), batch.column(1).to_numpy(zero_copy_only=False)
            for w in word_chunks(batch.column(2), fold=False):
                row, first, count, key, path = paths_of(w.hashes, w.bounds, window, anchor)
                place = (first - w.bounds[row]) * PLACE + count
                yield pa.RecordBatch.from_arrays(
                    [pa.array(key.view(np.int64)), pa.array(path.view(np.int64)), pa.array(ids[w.first + row]), pa.array(crcs[w.first + row], pa.int64()), pa.array(place.astype(np.int64))],
                    ["anchor", "path", "id", "crc", "place"],
                )

    return docs.mapInArrow(run, PATHS)


def edges_of(docs: DataFrame, window: int) -> DataFrame:
    """The windows of the paths listed in ``paths`` (anchor, place, whole) beside each text."""

    def run(batches):
        for batch in batches:
            data, offsets = text_buffer(batch.column(2))
            out: list[list] = [[], [], [], [], [], []]
            for i, (key, crc, listed) in enumerate(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(3), strict=True)):
                part = data[offsets[i] : offsets[i + 1]]
                total = prefix_sums(hash_words(part, np.array([0, len(part)]), 0, 1, TABLE).hashes)
                flat = listed.values.flatten()
                anchors, places, whole = (x.to_numpy(zero_copy_only=False) for x in flat)
                count = places % PLACE
                at = np.repeat(places // PLACE, count) + np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
                for column, values in zip(out, (np.repeat(anchors, count), span_hashes(total, at, at + window).view(np.int64), np.full(len(at), key), np.full(len(at), crc), at * PLACE + 1, np.repeat(whole, count)), strict=True):
                    column.append(values)
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) if c else pa.array([]) for c in out], ["anchor", "edge", "id", "crc", "place", "whole"])

    return docs.mapInArrow(run, EDGES)


def stripped(docs: DataFrame, window: int) -> DataFrame:
    """``docs`` with text, n_words and n_removed, given the places beside each text."""
    kept = [c for c in docs.columns if c not in ("places", "kept_text", "n_words", "n_removed")]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(kept).schema) + ", kept_text string, n_words long, n_removed long"

    def run(batches):
        for batch in batches:
            texts, words, removed = [], [], []
            for text, places in zip(batch.column("text"), batch.column("places"), strict=True):
                found = (text.as_py() or "").encode().split()
                gone = 0
                if places.is_valid:
                    p = places.values.to_numpy()
                    step = np.zeros(len(found) + 1, np.int64)
                    np.add.at(step, p // PLACE, 1)
                    np.add.at(step, p // PLACE + p % PLACE - 1 + window, -1)
                    keep = np.cumsum(step)[:-1] == 0
                    gone = len(found) - int(keep.sum())
                    words.append(len(found))
                    found = list(compress(found, keep))
                else:
                    words.append(len(found))
                texts.append(b" ".join(found))
                removed.append(gone)
            columns = [batch.column(c) for c in kept]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(texts, pa.binary()).cast(pa.string()), pa.array(words, pa.int64()), pa.array(removed, pa.int64())], [*kept, "kept_text", "n_words", "n_removed"])

    return docs.mapInArrow(run, schema)


def remove_repeats(spark: SparkSession, docs: DataFrame, window: int = 35) -> DataFrame:
    """``docs`` with ``kept_text, n_words, n_removed`` added (columns of those names are replaced).

    A word goes if a ``window``-word sequence that covers it also starts anywhere else, in this row or another; rows
    are judged as they come in, not after removal, so every copy of a passage goes. kept_text is the rest, joined by
    one space. Words are ``[^\\x20\\x09-\\x0D]+``, unchanged. Null, empty and blank texts have no words and keep an
    empty text; texts shorter than the window keep all. Rows that repeat a doc_id, or have none, are told apart by
    a 64-bit hash of their text; rows alike in both are copies of each other. Other columns pass through. An empty table gives no rows.
    """
    if not ANCHOR_WORDS < window <= ANCHOR_WORDS + PLACE - 2:
        raise ValueError(f"window must be {ANCHOR_WORDS + 1} to {ANCHOR_WORDS + PLACE - 2} words")
    scratch = Scratch(spark, "substring-dedup")
    key = [F.coalesce(F.col("doc_id").cast("long"), F.lit(0)).alias("id"), F.xxhash64("text").alias("crc")]
    slim = docs.select(*key, F.col("text").cast("string").alias("text"))
    found = scratch.put(paths(slim, window, ANCHOR_WORDS), "paths")
    anchors = found.groupBy("anchor").agg(F.count(F.lit(1)).alias("n"), F.min("path").alias("low"), F.max("path").alias("high")).where("n > 1").select("anchor", (F.col("low") != F.col("high")).alias("branching"))
    # written first, so that the join has an exchange of its own, whose large keys Spark can split
    anchors = scratch.put(anchors, "anchors")
    shared = scratch.put(found.join(anchors, "anchor"), "shared")
    scratch.drop(found, anchors)

    branching = shared.where("branching")
    sources = scratch.put(branching.groupBy("anchor", "path").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("id", "crc", "place")).alias("s")), "sources")
    read = sources.groupBy("s.id", "s.crc").agg(F.collect_list(F.struct("anchor", "s.place", (F.col("n") > 1).alias("whole"))).alias("paths"))
    edges = scratch.put(edges_of(slim.join(read, ["id", "crc"]).select("id", "crc", "text", "paths"), window), "edges")
    again = edges.groupBy("anchor", "edge").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("anchor", "edge")
    again = scratch.put(again, "repeated-edges")
    marks = shared.where("not branching").select("id", "crc", "place")
    marks = marks.union(branching.join(sources.where("n > 1").select("anchor", "path"), ["anchor", "path"]).select("id", "crc", "place"))
    marks = marks.union(edges.where("not whole").join(again, ["anchor", "edge"]).select("id", "crc", "place"))
    marks = scratch.put(marks.groupBy("id", "crc").agg(F.collect_list("place").alias("places")), "marks")
    scratch.drop(shared, sources, edges)
    taken = {"id", "crc", "places"} & set(docs.columns)
    plain = docs.withColumnsRenamed({c: f"__{c}" for c in taken})
    beside = plain.join(marks, (F.coalesce(plain["doc_id"].cast("long"), F.lit(0)) == marks["id"]) & (F.xxhash64(plain["text"]) == marks["crc"]), "left").drop(marks["id"], marks["crc"])
    return stripped(beside, window).withColumnsRenamed({f"__{c}": c for c in taken})
