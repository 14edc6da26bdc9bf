"""Toxicity scores from subword-bag embeddings averaged into a linear softmax.

A word is its bag of hashed character n-grams (its ends included), so unseen misspellings share vectors with what
was learned. The vectors of a text's distinct words are averaged over windows of ``WINDOW`` (a short window is
filled up with zeros) and a two-class softmax reads each average; a text is as toxic as its most toxic window, which
keeps long texts whole without diluting them. Embeddings and
softmax are trained jointly by Adam over the full sample: first every window bears its text's label, then only the
likeliest window of each text. The trained layers multiply out to one number for each bucket, so scoring is a table
look-up for each n-gram.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .bpe import with_column
from .common import small_batches
from .sampling import label_sample
from .words import BREAK, U64, Words, mix, word_chunks

LOW, HIGH, BUCKET_BITS, SIZE, WINDOW = 3, 6, 17, 4, 24
#: Steps of the embeddings, the softmax and its bias, and what the embeddings lose in a round.
STEPS, DECAY = (4.0, 0.05, 0.05), 0.002
FACTORS = np.random.default_rng(41).integers(1, 1 << 63, HIGH, dtype=np.uint64) * U64(2) + U64(1)
SEED_BYTES = np.random.default_rng(42).integers(1, 1 << 63, 256, dtype=np.uint64)
SEED_BYTES[ord("A") : ord("Z") + 1] = SEED_BYTES[ord("a") : ord("z") + 1]
SEED_BYTES[BREAK] = U64(0x1234567)


def distinct_words(w: Words) -> tuple[np.ndarray, np.ndarray]:
    """Each row's distinct words, where they first stand, and the bounds of the rows among them."""
    row = np.repeat(np.arange(w.last - w.first, dtype=np.int64), np.diff(w.bounds))
    _, at = np.unique(mix(w.hashes + row.astype(U64) * FACTORS[0]), return_index=True)
    at.sort()
    return at, np.searchsorted(row[at], np.arange(w.last - w.first + 1))


def word_grams(w: Words, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of all n-grams of the words ``at``, and the place of each one's word in ``at``."""
    starts, sizes = w.starts[at], w.ends[at] - w.starts[at] + 2
    first = np.cumsum(sizes) - sizes
    word = np.repeat(np.arange(len(sizes)), sizes)
    code = np.full(len(word), SEED_BYTES[32], U64)
    inner = np.ones(len(code), bool)
    inner[first] = inner[first + sizes - 1] = False
    place = np.arange(len(code)) - first[word] - 1 + starts[word]
    code[inner] = SEED_BYTES[w.data[place[inner]]]
    buckets, words = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    h = np.zeros(len(code), U64)
    for k in range(min(HIGH, len(code))):
        h = h[: len(code) - k] + code[k:] * FACTORS[k]
        if k + 1 >= LOW:
            inside = word[: len(h)] == word[k:]
            buckets.append((mix(h[inside] + U64(k)) >> U64(64 - BUCKET_BITS)).astype(np.int64))
            words.append(word[: len(h)][inside])
    return np.concatenate(buckets), np.concatenate(words)


def window_bounds(bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First words of the windows of each row (the last may be short), and the row of each window."""
    count = -(-np.diff(bounds) // WINDOW)
    row = np.repeat(np.arange(len(count)), count)
    return bounds[:-1][row] + (np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)) * WINDOW, row


class Sums:
    """Sums by an index, which stays the same, of what a second index takes from rows of values."""

    def __init__(self, index: np.ndarray, take: np.ndarray, n: int) -> None:
        order = np.argsort(index, kind="stable")
        index = index[order]
        self.take, self.first, self.n = take[order], np.flatnonzero(np.r_[True, np.diff(index) != 0][: len(index)]), n
        self.found = index[self.first]

    def __call__(self, values: np.ndarray) -> np.ndarray:
        out = np.zeros((len(values), self.n), np.float32)
        if len(self.take):
            for to, row in zip(out, values, strict=True):
                to[self.found] = np.add.reduceat(row[self.take], self.first)
        return out


class Model:
    """One weight for each bucket, and a bias: the logit of a window is the bias and its words' mean weight."""

    def __init__(self, rows: list[tuple[str, int]], rounds: int = 40, seed: int = 7) -> None:
        self.weights, self.bias = np.zeros(1 << BUCKET_BITS, np.float32), 0.0
        rows = sorted(rows)
        label = np.array([bool(y) for _, y in rows])
        if not label.any() or label.all():
            self.bias = 4.0 if len(label) and label.all() else -4.0
            return
        self.train([t for t, _ in rows], label, rounds, np.random.default_rng(seed))

    def train(self, texts: list[str], label: np.ndarray, rounds: int, rng: np.random.Generator) -> None:
        hashes, bags, kinds_of, firsts, window_rows, seen, words = [], [], [], [], [], np.zeros(0, U64), 0
        for w in word_chunks(pa.array(texts, pa.large_string()), fold=True):
            at, bounds = distinct_words(w)
            f, r = window_bounds(bounds)
            firsts.append(f + words)
            window_rows.append(r + w.first)
            hashes.append(w.hashes[at])
            # words of one spelling share a bag: only the first needs it
            new, example = np.unique(w.hashes[at], return_index=True)
            fresh = ~np.isin(new, seen, assume_unique=True)
            g, o = word_grams(w, at[example[fresh]])
            bags.append(g.astype(np.int32))
            kinds_of.append((o + len(seen)).astype(np.int32))
            seen = np.concatenate([seen, new[fresh]])
            words += len(at)
        if not words:
            return
        firsts, rows, bag, of = (np.concatenate(x) for x in (firsts, window_rows, bags, kinds_of))
        order = np.argsort(seen)
        kind = order[np.searchsorted(seen[order], np.concatenate(hashes))].astype(np.int32)
        del hashes, bags, kinds_of
        kinds = len(seen)
        per_kind = np.maximum(np.bincount(of, minlength=kinds), 1).astype(np.float32)
        used, bag = np.unique(bag, return_inverse=True)
        bag = bag.astype(np.int32)
        window = np.repeat(np.arange(len(firsts), dtype=np.int32), np.diff(np.r_[firsts, words]))
        by_kind, by_bucket, by_word = Sums(of, bag, kinds), Sums(bag, of, len(used)), Sums(kind, window, kinds)

        # one row for each dimension, as sums over long rows are the fastest
        emb = np.ascontiguousarray((rng.standard_normal((len(used), SIZE)) * 0.01).astype(np.float32).T)
        out, bias = (rng.standard_normal((SIZE, 2)) * 0.5).astype(np.float32), np.zeros(2, np.float32)
        state = [[np.zeros_like(x), 0.0] for x in (emb, out, bias)]
        truth = label[rows]
        each = np.bincount(rows, minlength=len(texts))[rows]
        share = np.where(label, 0.5 / label.sum(), 0.5 / (~label).sum())[rows].astype(np.float32)
        for turn in range(1, rounds + 1):
            kind_vec = by_kind(emb) / per_kind
            mean = np.stack([np.add.reduceat(row[kind], firsts) for row in kind_vec]) / WINDOW
            logit = mean.T @ out + bias
            p = 1 / (1 + np.exp(np.clip(logit[:, 0] - logit[:, 1], -30, 30)))
            if turn <= rounds // 4:
                weight = share / each
            else:  # the likeliest window of each text
                rank = np.lexsort((-p, rows))
                top = rank[np.r_[True, np.diff(rows[rank]) != 0]]
                weight = np.zeros_like(share)
                weight[top] = share[top]
            slope = (weight * (p - truth)).astype(np.float32)
            d = np.stack([-slope, slope], axis=1)
            d_kind = by_word(out @ d.T / WINDOW) / per_kind
            grads = [by_bucket(d_kind), mean @ d, d.sum(axis=0)]
            # one step size for each layer, not for each weight: buckets of few texts learn little
            for x, g, s, step in zip((emb, out, bias), grads, state, STEPS, strict=True):
                s[0] = 0.8 * s[0] + g
                s[1] = 0.9 * s[1] + 0.1 * float((g * g).sum())
                x -= step * s[0] / (np.sqrt(s[1] / (1 - 0.9**turn)) + 1e-12)
            emb *= 1 - DECAY
        self.weights[used] = (out[:, 1] - out[:, 0]) @ emb
        self.bias = float(bias[1] - bias[0])

    def scores(self, column: pa.Array) -> Iterator[np.ndarray]:
        """Scores of the rows of a text column, a chunk at a time; texts without words get the bias alone."""
        for w in word_chunks(column, fold=True):
            logit = np.full(w.last - w.first, self.bias)
            if len(w.hashes):
                at, bounds = distinct_words(w)
                g, o = word_grams(w, at)
                word = np.bincount(o, self.weights[g], len(at)) / np.maximum(np.bincount(o, minlength=len(at)), 1)
                first, row = window_bounds(bounds)
                mean = np.add.reduceat(word, first) / WINDOW
                best = np.full(len(logit), -np.inf)
                np.maximum.at(best, row, mean)
                logit += np.where(np.isfinite(best), best, 0)
            yield 1 / (1 + np.exp(-np.clip(logit, -30, 30)))


def fit(docs: DataFrame, labels: DataFrame, per_label: int = 800) -> Model:
    """A model from the ``toxic`` labels (doc_id, toxic 0 or 1) of at most about ``per_label`` documents of each.

    Null labels and texts, and labels without a document, are not learned from; a document with several labels is toxic
    if any says so. At most eight times ``per_label`` rows reach the driver, however often a doc_id repeats. With
    labels of one kind only, every score is that kind's.
    """
    marked = labels.where("toxic in (0, 1)").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    sample = label_sample(marked, "toxic", per_label, 2 * per_label)
    rows = docs.select("doc_id", "text").where("text is not null").join(F.broadcast(sample.limit(4 * per_label)), "doc_id")
    return Model([(r.text, r.toxic) for r in rows.select("text", "toxic").limit(8 * per_label).collect()])


def score(spark: SparkSession, docs: DataFrame, model: Model) -> DataFrame:
    """``docs`` with ``score double`` in 0 to 1 for each whole text (a column ``score`` is replaced).

    Null, empty and blank texts get the score of no words. Rows are independent: repeats and extra columns pass
    through, and an empty table gives no rows.
    """
    small_batches(spark)
    shared = spark.sparkContext.broadcast(model)

    def run(batches):
        for batch in batches:
            rest = [n for n in batch.schema.names if n != "score"]
            found = np.concatenate([np.zeros(0), *shared.value.scores(batch.column("text"))])
            yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in rest), pa.array(found)], [*rest, "score"])

    return docs.withColumn("text", F.col("text").cast("string")).mapInArrow(run, with_column(docs, "score", "double"))
