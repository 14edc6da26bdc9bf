"""Vector, keyword and hybrid retrieval, fusion and answers."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.tables import kept, stored

K1, B = 1.2, 0.75
#: Vectors of a cell, rows multiplied at once, and pairs up to which an answer isn't compared in blocks.
CELL, SLICE, FEW = 2048, 256, 4096
#: Cosines this near to a bound, and products of lengths this small, are computed in order.
NEAR, TINY = 1e-9, 1e-200


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    """Cosine in double precision, 0 where a vector is zero."""
    return F.coalesce(F.try_divide(dot(a, b), F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))), F.lit(0.0))


def nearest(rows: DataFrame, key: str, column: str, vector: list[float], k: int) -> DataFrame:
    """The ``k`` rows of largest cosine with a vector, ties to the smaller key."""
    asked = F.array(*[F.lit(float(x)) for x in vector])
    return rows.select(key, cosine(F.col(column), asked).alias("score")).orderBy(F.desc("score"), key).limit(k)


def tokens(text: Column) -> Column:
    return F.filter(F.split(F.lower(text), "[^a-z0-9]+"), lambda w: w != "")


def bm25(docs: DataFrame, key: str, column: str, terms: list[str]) -> DataFrame:
    """``key, score`` of the documents that hold any of the terms (of a-z and 0-9).

    The texts are read once, into a narrow table of lengths and counts that is kept: its size, mean length and document
    frequencies (one row) and the scores come from that.
    """
    words = docs.select(key, tokens(F.col(column)).alias("w"))
    held = [F.size(F.filter("w", F.lit(t).__eq__)).alias(f"f{i}") for i, t in enumerate(terms)]
    counted = kept(words.select(key, F.size("w").alias("n"), *held))
    stats = counted.agg(F.count(F.lit(1)).alias("docs"), F.avg("n").alias("mean"), *[F.count_if(F.col(f"f{i}") > 0).alias(f"d{i}") for i in range(len(terms))])
    both = counted.crossJoin(F.broadcast(stats))
    score = F.lit(0.0)
    for i in range(len(terms)):
        f, d = F.col(f"f{i}"), F.col(f"d{i}")
        idf = F.log(1 + (F.col("docs") - d + 0.5) / (d + 0.5))
        score = score + idf * f * (K1 + 1) / (f + K1 * (1 - B + B * F.col("n") / F.col("mean")))
    return both.select(key, score.alias("score")).where("score > 0")


def scaled(rows: DataFrame) -> DataFrame:
    """Scores from 0 to 1 over all rows."""
    ends = rows.agg(F.min("score").alias("low"), F.max("score").alias("high"))
    return rows.crossJoin(F.broadcast(ends)).withColumn("score", F.coalesce(F.try_divide(F.col("score") - F.col("low"), F.col("high") - F.col("low")), F.lit(1.0))).drop("low", "high")


def hybrid(vector: DataFrame, keyword: DataFrame, key: str, alpha: float, k: int) -> DataFrame:
    """``alpha`` of the vector score and the rest of the keyword score; alone from 0.9 and up to 0.1."""
    if alpha >= 0.9:
        return vector.orderBy(F.desc("score"), key).limit(k)
    if alpha <= 0.1:
        return keyword.orderBy(F.desc("score"), key).limit(k)
    v, w = scaled(vector).withColumnRenamed("score", "v"), scaled(keyword).withColumnRenamed("score", "w")
    mixed = alpha * F.coalesce("v", F.lit(0.0)) + (1 - alpha) * F.coalesce("w", F.lit(0.0))
    return v.join(w, key, "full").select(key, mixed.alias("score")).orderBy(F.desc("score"), key).limit(k)


def fused(results: list[DataFrame], k: int) -> DataFrame:
    """Union of ``result_id, content, score``; one row for each first 100 characters, the best score, best rows first."""
    every = results[0]
    for r in results[1:]:
        every = every.unionByName(r)
    w = Window.partitionBy(F.substring("content", 1, 100)).orderBy(F.desc("score"), "result_id")
    return every.withColumn("n", F.row_number().over(w)).where("n = 1").drop("n").orderBy(F.desc("score"), "result_id").limit(k)


def claims_cited(claims: DataFrame, citations: DataFrame, least: float = 0.6) -> DataFrame:
    """``claim_id, citation_id`` of each answer's claims and its own citations, by cosine.

    The pairs of an answer with many of them are compared in blocks, as matrix products: both sides are dealt into cells of
    about ``CELL`` vectors, and each cell of claims meets each of citations in one group. Cosines within ``NEAR`` of the
    bound, or too large for a product, are taken again as ``cosine`` takes them. Answers of few pairs, and vectors that
    are null or hold null or non-finite components, are compared pair by pair.
    """
    count = lambda rows, name: rows.groupBy("answer").agg(F.count(F.lit(1)).alias(name))
    counts = count(claims, "n").join(count(citations, "m"), "answer").where(F.col("n") * F.col("m") > FEW)
    large = stored(counts.select("answer", F.ceil(F.col("n") / CELL).alias("rows"), F.ceil(F.col("m") / CELL).alias("columns")), "answers")
    whole = lambda v: F.coalesce(F.forall(v, lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) < float("inf")), F.lit(False))), F.lit(False))
    a, b = claims.withColumn("whole_a", whole(F.col("claim"))), citations.withColumn("whole_b", whole(F.col("citation")))
    by_pair = a.join(large, "answer", "left_anti").join(b, "answer")
    far = ~F.col("whole_a") | ~F.col("whole_b") if least > 0 else ~F.col("whole_a") | ~F.col("whole_b") | (F.size("claim") != F.size("citation"))
    hot_a, hot_b = a.join(large.select("answer"), "answer", "left_semi"), b.join(large.select("answer"), "answer", "left_semi")
    odd = hot_a.where("not whole_a").join(hot_b, "answer").union(hot_a.where("whole_a").join(hot_b.where("not whole_b"), "answer")) if least > 0 else hot_a.join(hot_b, "answer").where(far)
    plain = by_pair.union(odd.select(by_pair.columns)).where(cosine(F.col("claim"), F.col("citation")) >= least).select("claim_id", "citation_id")

    def dealt(rows: DataFrame, key: str, vector: str, own: str, other: str) -> DataFrame:
        cell, others = F.pmod(F.xxhash64(key), F.col(own)), F.explode(F.sequence(F.lit(0).cast("long"), F.col(other) - 1))
        both = rows.join(large, "answer").select(F.col("answer").alias("of"), F.size(vector).alias("dim"), cell.alias(own), others.alias(other), F.col(key).alias("id"), F.col(vector).cast("array<double>").alias("v"))
        return both.groupBy("of", "dim", "rows", "columns")

    left = dealt(hot_a.where("whole_a"), "claim_id", "claim", "rows", "columns")
    right = dealt(hot_b.where("whole_b"), "citation_id", "citation", "columns", "rows")
    types = [claims.schema["claim_id"].dataType.simpleString(), citations.schema["citation_id"].dataType.simpleString()]
    blocks = left.cogroup(right).applyInArrow(lambda x, y: near_pairs(x, y, least), f"claim_id {types[0]}, citation_id {types[1]}")
    return plain.union(blocks)


def near_pairs(left: pa.Table, right: pa.Table, least: float) -> pa.Table:
    """``claim_id, citation_id`` of two cells' vectors (``id, v``, of one length) whose cosine is ``least`` or more."""
    out = pa.schema([("claim_id", left["id"].type), ("citation_id", right["id"].type)])
    if not left.num_rows or not right.num_rows:
        return out.empty_table()
    x, y = (t["v"].combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(t.num_rows, -1) for t in (left, right))
    ids, others = (t["id"].combine_chunks() for t in (left, right))
    found = []
    in_order = lambda u, v: np.cumsum(u * v)[-1] if len(u) else 0.0
    with np.errstate(all="ignore"):
        lengths = [np.sqrt(np.einsum("ij,ij->i", m, m)) for m in (x, y)]
        for start in range(0, len(x), SLICE):
            scale = lengths[0][start : start + SLICE, None] * lengths[1]
            cos = np.where(scale == 0, 0.0, (x[start : start + SLICE] @ y.T) / scale)
            passed = cos >= least
            for i, j in zip(*np.nonzero((~np.isfinite(cos) | (np.abs(cos - least) <= NEAR) | (scale < TINY)) & (scale != 0)), strict=True):
                u, v = x[start + i], y[j]
                size = np.sqrt(in_order(u, u)) * np.sqrt(in_order(v, v))
                exact = in_order(u, v) / size if size != 0 else 0.0
                passed[i, j] = np.isnan(exact) or exact >= least
            i, j = np.nonzero(passed)
            found.append(pa.RecordBatch.from_arrays([ids.take(pa.array(i + start)), others.take(pa.array(j))], schema=out))
    return pa.Table.from_batches(found, out)


def fact_content() -> Column:
    """``ind in dist | Year y | Value: v u | Category: c | Source: s``, leaving out what is null."""
    part = lambda label, c: F.when(c.isNotNull(), F.concat(F.lit(label), c))
    col = F.col
    return F.concat_ws(" | ", F.concat(col("indicator"), F.lit(" in "), col("district")), part("Year ", col("year").cast("string")), part("Value: ", F.concat(F.format_string("%.2f", "value"), F.lit(" "), col("unit"))), part("Category: ", col("category")), part("Source: ", col("source_document")))


def excerpt(text: Column, n: int = 200) -> Column:
    return F.when(F.length(text) > n, F.concat(F.substring(text, 1, n), F.lit("..."))).otherwise(text)


def citation_id(*parts: Column) -> Column:
    return F.substring(F.md5(F.concat(*parts).cast("binary")), 1, 8)


def bullets(rows: DataFrame, text: str, order: str, k: int = 3) -> DataFrame:
    """One answer row of the first ``k`` lines."""
    first = rows.orderBy(order).limit(k).agg(F.array_sort(F.collect_list(F.struct(order, text))).alias("l"))
    return first.select(F.array_join(F.transform("l", lambda x: F.concat(F.lit("- "), x[text])), "\n").alias("answer"))
