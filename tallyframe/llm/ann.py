"""Nearest neighbours by collision-counting hashing.

Each candidate is hashed by single random projections, kept as sorted arrays. A query's windows are centred on its own
projections and widened by virtual rehashing: the same arrays are read again with a larger radius. A candidate that
collides in enough windows is verified on the original vectors, and widening stops once enough candidates were
verified. Larger inner products become smaller distances by one more component, ``sqrt(R^2 - |x|^2)``, for the
largest norm R.

How many are enough depends on how far the neighbours stand out from the rest, so it is calibrated: a bounded sample
of rows is searched with growing shares of verified candidates until its own true neighbours are found (``TARGET``).

Candidates are dealt to shards and queries to blocks of bounded size; each shard meets each block once, a task
holding one of both, and returns its best few for each query. The best over all shards are kept by a window that
drops the rest before the shuffle.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import Scratch
from .vectors import component_type, packed_vectors, stacked, usable

#: Most candidates of a shard and queries of a block, bytes of their vectors, candidates that are worth a task, projections.
SHARD, QUERIES, SHARD_BYTES, LEAST_SHARD, PROJECTIONS = 1 << 14, 1 << 14, 32 << 20, 1024, 128
#: Collisions that make a candidate, as a share of the projections; the first radius and its growth. Places in a sorted array are
#: kept in 256 steps, and counts fit 8 bits.
SHARE, RADIUS, WIDEN, STEPS = 0.5, 0.5, 1.04, 256
#: Calibration: candidates and queries of the sample, the shares tried, and the recall that is asked for.
SAMPLE, ASKED, SHARES, TARGET = 4096, 128, (0.01, 0.02, 0.04, 0.07, 0.1, 0.15, 0.2, 0.3, 0.4, 0.55, 0.7, 0.85, 1.0), 0.96
FOUND = "query_id long, vec_id long, score double"


def lifted(vectors: np.ndarray, largest: float) -> np.ndarray:
    """Vectors of one norm whose distances order as inner products."""
    rest = np.sqrt(np.maximum(largest * largest - (vectors * vectors).sum(axis=1), 0))
    return np.hstack([vectors, rest[:, None]]) / largest


def shard_search(
    ids: np.ndarray, vectors: np.ndarray, query_ids: np.ndarray, queries: np.ndarray, largest: float, k: int, share: float, radius: float = RADIUS
) -> Iterator[tuple[int, np.ndarray, np.ndarray, float]]:
    """For each query its up to ``k`` best verified candidates: ids and inner products, and the radius they took.

    At least ``share`` of the candidates are verified for each query. A window of a sorted array is a span of places,
    so a candidate's collisions are the arrays in which its place falls into the query's span.
    """
    n, dim = vectors.shape
    directions = np.random.default_rng([23, dim]).standard_normal((dim + 1, PROJECTIONS))
    hashed = lifted(vectors, largest) @ directions
    order = np.argsort(hashed, axis=0, kind="stable").T
    arrays = np.take_along_axis(hashed.T, order, axis=1)
    step = max(1, -(-n // STEPS))
    places = np.empty((PROJECTIONS, n), np.uint8)
    np.put_along_axis(places, order, (np.arange(n) // step).astype(np.uint8)[None, :], axis=1)
    centres = (np.hstack([queries / np.linalg.norm(queries, axis=1, keepdims=True), np.zeros((len(queries), 1))]) @ directions).T
    need, least = int(SHARE * PROJECTIONS), min(n, max(k, math.ceil(share * n)))
    place, inside = np.empty_like(places), np.empty(places.shape, bool)
    open_ = np.arange(len(queries))
    while len(open_):
        # virtual rehashing: the same arrays, read with the windows of the next radius
        left = np.stack([np.searchsorted(a, c[open_] - radius, "left") for a, c in zip(arrays, centres, strict=True)])
        right = np.stack([np.searchsorted(a, c[open_] + radius, "right") for a, c in zip(arrays, centres, strict=True)])
        low, last = np.minimum(left, n - 1) // step, np.maximum(right - 1, 0) // step
        span = np.where(right > left, last - low, 0).astype(np.uint8)
        low, every = low.astype(np.uint8), (right - left == n).all(axis=0)
        rest = []
        for i, q in enumerate(open_):
            np.subtract(places, low[:, i, None], out=place)
            np.less_equal(place, span[:, i, None], out=inside)
            picked = np.flatnonzero(np.add.reduce(inside.view(np.uint8), axis=0, dtype=np.uint8) >= need)
            if len(picked) < least and not every[i]:
                rest.append(q)
                continue
            picked = picked[ids[picked] != query_ids[q]]
            scores = vectors[picked] @ queries[q]
            if len(scores) > 4 * k:  # the k best and what ties with the last of them
                top = scores >= np.partition(scores, -k)[-k]
                picked, scores = picked[top], scores[top]
            best = np.lexsort((ids[picked], -scores))[:k]
            yield int(query_ids[q]), ids[picked][best], scores[best], radius
        radius, open_ = radius * WIDEN, np.array(rest, np.int64)


def calibrated(ids: np.ndarray, vectors: np.ndarray, query_ids: np.ndarray, queries: np.ndarray, largest: float, k: int) -> tuple[float, float]:
    """The least of ``SHARES`` that finds ``TARGET`` of the ``k`` true neighbours of each query, and where its radius may start."""
    truth = []
    for q, x in zip(query_ids, queries, strict=True):
        scores = np.where(ids == q, -np.inf, vectors @ x)
        truth.append(set(ids[np.lexsort((ids, -scores))[:k]].tolist()))
    at = {int(q): t for q, t in zip(query_ids, truth, strict=True)}
    radius = RADIUS
    for share in SHARES:
        found = list(shard_search(ids, vectors, query_ids, queries, largest, k, share, radius))
        radii = [r for *_, r in found]
        hits = sum(len(at[q] & set(i.tolist())) for q, i, _, _ in found)
        if hits >= TARGET * sum(map(len, truth)):
            break
        radius = max(RADIUS, min(radii))
    return share, max(RADIUS, float(np.percentile(radii, 10)))


def nearest(spark: SparkSession, rows: DataFrame, is_query: Column, k: int = 20, key: str = "vec_id", column: str = "embedding") -> DataFrame:
    """``query_id, rank, vec_id, score``: each query's ``k`` nearest by inner product in double precision.

    Queries are the rows where ``is_query`` holds, candidates all rows but the query's own id; ranks start at 1 and
    ties go to the smaller id. Fewer candidates than ``k`` are all returned. Vectors that are null, empty or zero, or
    hold null or non-finite components, and rows without an id, take no part; vectors meet only vectors of their
    length. Rows that repeat an id count once (the least vector). An empty table, or one without queries, gives no
    rows; other columns are ignored. The calibration's sample has at most ``SAMPLE`` rows and ``ASKED`` queries.
    """
    scratch = Scratch(spark, "nearest")
    base = rows.withColumn("__query", F.coalesce(is_query, F.lit(False))).select(F.col(key).cast("long").alias("id"), F.col("__query").alias("query"), F.col(column).alias("vector"))
    good = base.where(usable("vector") & F.col("id").isNotNull()).groupBy("id").agg(F.max("query").alias("query"), F.min("vector").alias("vector"))
    norm = F.sqrt(F.aggregate("vector", F.lit(0.0), lambda s, x: s + x.cast("double") * x))
    kind = component_type(rows, column)
    vectors = scratch.put(packed_vectors(good.withColumn("norm", norm), "vector"), "vectors")
    size = vectors.agg(F.count(F.lit(1)).alias("n"), F.count_if("query").alias("q"), F.max("norm").alias("r"), F.max("dim").alias("dim")).first()
    most = max(1, min(SHARD, SHARD_BYTES // (8 * (size.dim or 1))))
    blocks = max(1, -(-size.q // max(1, min(QUERIES, SHARD_BYTES // (8 * (size.dim or 1))))))
    spread = max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    shards = max(1, -(-size.n // most), min(-(-size.n // LEAST_SHARD), -(-spread // blocks)))
    deal = F.xxhash64("id")
    largest = size.r or 1.0

    # the shares of verified candidates, by length of vectors; lengths of few sampled rows are verified whole
    few = max(256, min(SAMPLE, SHARD_BYTES // (8 * (size.dim or 1))))
    sampled, asking = (part.select("id", "vec", "dim").orderBy(F.xxhash64("id", F.lit(29)), "id").limit(m).toArrow() for part, m in ((vectors, few), (vectors.where("query"), ASKED)))
    effort = {}
    for dim in set(asking["dim"].to_pylist()):
        cell, asked = (t.filter(pc.equal(t["dim"], dim)) for t in (sampled, asking))
        if len(cell) >= 4 * k:
            near = max(1, min(k, round(k * len(sampled) / size.n)))
            effort[dim] = calibrated(cell["id"].to_numpy(), stacked(cell["vec"].combine_chunks(), kind), asked["id"].to_numpy(), stacked(asked["vec"].combine_chunks(), kind), largest, near)

    left = vectors.select("id", "vec", "dim", F.pmod(deal, F.lit(shards)).alias("shard"), F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"))
    right = vectors.where("query").select("id", "vec", "dim", F.pmod(deal, F.lit(blocks)).cast("int").alias("block"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(shards - 1).cast("long"))).alias("shard"))

    def search(cell, asked):
        out = []
        if len(cell) and len(asked):
            share, radius = effort.get(cell["dim"][0].as_py(), (1.0, RADIUS))
            for query, ids, scores, _ in shard_search(cell["id"].to_numpy(), stacked(cell["vec"].combine_chunks(), kind), asked["id"].to_numpy(), stacked(asked["vec"].combine_chunks(), kind), largest, k, share, radius):
                out.append((np.full(len(ids), query), ids, scores))
        parts = [np.concatenate(c) for c in zip(*out, strict=True)] if out else [np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)]
        return pa.table({"query_id": parts[0], "vec_id": parts[1], "score": parts[2]})

    cells = ["shard", "block", "dim"]
    found = left.groupBy(*cells).cogroup(right.groupBy(*cells)).applyInArrow(search, FOUND)
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
