"""Vectors as packed doubles, and the normal-distribution arithmetic of random projections."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import FloatType


def usable(column: str) -> Column:
    """Whether an array column is a vector: not null or empty, all components finite, not all zero."""
    fine = F.forall(column, lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))), F.lit(False)))
    return F.coalesce(F.col(column).isNotNull() & (F.size(column) > 0) & fine & F.exists(column, lambda x: x != 0), F.lit(False))


def component_type(rows: DataFrame, column: str) -> type:
    """How the components of an array column are packed: floats as they are, all other numbers as doubles."""
    kind = rows.schema[column].dataType
    return np.float32 if isinstance(getattr(kind, "elementType", None), FloatType) else np.float64


def stacked(column: pa.Array, kind: type) -> np.ndarray:
    """Packed components of one width as a matrix of doubles."""
    return np.frombuffer(b"".join(column.to_pylist()), kind).reshape(len(column), -1).astype(np.float64, copy=False)


def packed_vectors(rows: DataFrame, column: str) -> DataFrame:
    """``rows`` (all usable) with ``vec binary`` in place of ``column``, and ``dim int``."""
    kind = component_type(rows, column)
    keep = [c for c in rows.columns if c != column]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.select(keep).schema) + ", vec binary, dim int"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            vectors = batch.column(column)
            dims = np.diff(vectors.offsets.to_numpy())
            flat = vectors.values.to_numpy(zero_copy_only=False)[vectors.offsets[0].as_py() :].astype(kind, copy=False)
            ends = np.cumsum(dims)
            out = [flat[e - d : e].tobytes() for d, e in zip(dims, ends, strict=True)]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), pa.array(out, pa.binary()), pa.array(dims, pa.int32())], [*keep, "vec", "dim"])

    return rows.mapInArrow(run, schema)


def tail_point(q: float) -> float:
    """The t that a standard normal exceeds with probability ``q`` (at most a half)."""
    low, high = 0.0, 40.0
    for _ in range(80):
        mid = (low + high) / 2
        low, high = (mid, high) if math.erfc(mid / math.sqrt(2)) / 2 > q else (low, mid)
    return low


def together(t: float, cosine: float, width: float) -> float:
    """The chance that a vector's projection is past ``t`` and within ``width`` of another's that is past ``t``."""
    rng = np.random.default_rng(3)
    if t > 0.5:
        x = np.sqrt(t * t - 2 * np.log(rng.random(400_000)))
        x = x[rng.random(len(x)) * x <= t]
    else:
        x = rng.standard_normal(800_000)
        x = x[x >= t]
    y = cosine * x + math.sqrt(1 - cosine * cosine) * rng.standard_normal(len(x))
    return float(((y >= t) & (np.abs(x - y) <= width)).mean())


def most_count(n: int, p: float, miss: float) -> int:
    """The largest count that a binomial variable misses with a chance of ``miss`` at most (1 at least)."""
    log, total, k = n * math.log1p(-p), 0.0, 0
    while True:
        total += math.exp(log)
        if total > miss or k >= n:
            return max(1, k)
        log += math.log((n - k) / (k + 1)) + math.log(p) - math.log1p(-p)
        k += 1
