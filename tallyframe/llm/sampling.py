"""Bounded, deterministic samples of labelled rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def label_sample(rows: DataFrame, label: str, per_label: int, most: int) -> DataFrame:
    """About ``per_label`` rows of each value of ``label``, and ``most`` over all, drawn by a hash of doc_id.

    A count of each label (one row for each value) sets its share; rows whose hash falls below the share are taken,
    so the draw needs no sort and is the same on every run. Rows with a null label or doc_id are not drawn.
    """
    rows = rows.where(F.col(label).isNotNull() & F.col("doc_id").isNotNull())
    counts = {r[0]: r[1] for r in rows.groupBy(label).count().orderBy(F.desc("count"), label).limit(most).collect()}
    if not counts:
        return rows.limit(0)
    each = max(1, min(per_label, most // len(counts)))
    unit = F.shiftrightunsigned(F.xxhash64(F.col("doc_id"), F.lit(17)), 11) / float(1 << 53)
    share = F.lit(0.0)
    for value, n in counts.items():
        share = F.when(F.col(label) == F.lit(value), F.lit(min(1.0, each / n))).otherwise(share)
    return rows.where(unit < share)
