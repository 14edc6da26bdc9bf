"""Language identification by string kernels.

A text is the set of its 1- to 4-grams of lower-cased letters (other characters count as one space): the blended
spectrum kernel of presence, ``k(x, y) = |x & y| / sqrt(|x| |y|)``. Landmarks drawn from the labelled sample give a
Nyström map, and kernel ridge regression is fitted one language against the rest. The grams that count are all those
of the sampled texts, so the sample's bound is theirs. Batches of texts become presence matrices, so scoring is two
matrix products for each batch, of the columns of landmarks' grams that the batch holds.
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
from .words import U64, mix

GRAMS, SLOT_BITS = 4, 20
BATCH_ROWS, BATCH_CHARS = 64, 1 << 19
UNDETERMINED = "und"
FACTORS = np.random.default_rng(31).integers(1, 1 << 63, (GRAMS, GRAMS), dtype=np.uint64) * U64(2) + U64(1)
SHARPNESS = 6.0


def letter_table() -> np.ndarray:
    return np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)


def groups(texts: list[str]) -> Iterator[tuple[int, int]]:
    """Runs of rows that make one matrix."""
    first = size = 0
    for i, t in enumerate(texts):
        if i > first and (i - first == BATCH_ROWS or size + len(t) > BATCH_CHARS):
            yield first, i
            first, size = i, 0
        size += len(t)
    if first < len(texts):
        yield first, len(texts)


class Grams:
    """Hashes of the letter grams of texts, with the row of each."""

    def __init__(self) -> None:
        self.letters = letter_table()

    def of(self, texts: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        lowered = [t.lower() for t in texts]
        points = np.frombuffer("\0".join(lowered).encode("utf-32-le", "surrogatepass") + b"\0\0\0\0", np.uint32)
        row = np.repeat(np.arange(len(lowered)), [len(t) + 1 for t in lowered])
        code = np.where(self.letters[points], points, np.uint32(32)).astype(U64)
        ends = np.cumsum([len(t) + 1 for t in lowered]) - 1
        code[ends] = 0
        for n in range(1, GRAMS + 1):
            size = len(code) - n + 1
            if size <= 0:
                return
            h = np.full(size, U64(n))
            inside = np.ones(size, bool)
            for j in range(n):
                h += code[j : j + size] * FACTORS[n - 1, j]
                inside &= code[j : j + size] != 0
            yield mix(h)[inside], row[:size][inside]


class Model:
    """Landmarks and one-versus-rest weights, fitted on (text, language) rows.

    ``hashes`` are the sample's grams by column of the presence matrices; the landmarks' grams come first, one row of
    ``landmarks`` for each. ``slots`` tells the column by a hash's first bits; the few grams whose slot another one
    holds are in ``more``.
    """

    def __init__(self, rows: list[tuple[str, str]], landmarks: int, ridge: float) -> None:
        grams = Grams()
        rows = sorted((t, lang) for t, lang in rows if any(map(str.isalpha, t)))
        texts, self.languages = [t for t, _ in rows], sorted({lang for _, lang in rows})
        rng = np.random.default_rng(2)
        label = np.array([self.languages.index(lang) for _, lang in rows], np.int64)
        chosen = [rng.permutation(np.flatnonzero(label == c))[: max(1, landmarks // len(self.languages))] for c in range(len(self.languages))]
        chosen = np.concatenate([np.zeros(0, np.int64), *chosen])
        none = np.zeros(0, U64)
        sets = [np.unique(np.concatenate([none, *(h for h, _ in grams.of([t]))])) for t in texts]
        marked = np.unique(np.concatenate([none, *(sets[i] for i in chosen)]))
        others = np.setdiff1d(np.concatenate([none, *sets]), marked)
        self.hashes = np.concatenate([marked, others, np.zeros(1, U64)])
        self.width = width = len(marked) + len(others)
        slot = (self.hashes[:width] >> U64(64 - SLOT_BITS)).astype(np.int64)
        self.slots = np.full(1 << SLOT_BITS, width, np.int32)
        self.slots[slot] = np.arange(width, dtype=np.int32)
        rest = np.flatnonzero(self.slots[slot] != np.arange(width))
        rest = rest[np.argsort(self.hashes[rest])]
        self.more, self.more_at, self.crowded = self.hashes[rest], rest.astype(np.int32), np.zeros(1 << SLOT_BITS, bool)
        self.crowded[slot[rest]] = True
        self.landmarks = np.zeros((len(marked), len(chosen)), np.uint8)
        for i, at in enumerate(chosen):
            self.landmarks[np.searchsorted(marked, sets[at]), i] = 1
        sizes = np.array([len(sets[i]) for i in chosen], np.float64)
        self.scale = (1 / np.sqrt(np.maximum(sizes, 1))).astype(np.float32)
        k = np.concatenate([np.zeros((0, len(chosen)), np.float32), *(self.kernel(texts[a:b], grams) for a, b in groups(texts))]).astype(np.float64)
        w, v = np.linalg.eigh((k[chosen] + k[chosen].T) / 2) if rows else (np.zeros(0), np.zeros((0, 0)))
        solid = w > 1e-6 * max(w.max(initial=0), 1e-12)
        root = v[:, solid] / np.sqrt(w[solid])
        z = np.hstack([k @ root, np.ones((len(rows), 1))])
        size = np.bincount(label, minlength=len(self.languages))[label]
        weight = (len(rows) / np.maximum(size, 1) / max(1, len(self.languages)))[:, None]
        target = np.where(label[:, None] == np.arange(len(self.languages)), 1.0, -1.0)
        beta = np.linalg.solve(z.T @ (z * weight) + ridge * np.eye(z.shape[1]), z.T @ (target * weight))
        self.weights, self.bias = (root @ beta[:-1]).astype(np.float32), beta[-1].astype(np.float32)

    def columns(self, hashes: np.ndarray) -> np.ndarray:
        """The columns of grams, and one after the last for those that no sampled text has."""
        at = self.slots[(hashes >> U64(64 - SLOT_BITS)).astype(np.int64)]
        wrong = np.flatnonzero(self.hashes[at] != hashes)
        at[wrong], asked = self.width, hashes[wrong]
        if len(self.more):
            few = np.flatnonzero(self.crowded[(asked >> U64(64 - SLOT_BITS)).astype(np.int64)])
            wrong, asked = wrong[few], asked[few]
            place = np.minimum(np.searchsorted(self.more, asked), len(self.more) - 1)
            same = self.more[place] == asked
            at[wrong[same]] = self.more_at[place[same]]
        return at

    def kernel(self, texts: list[str], grams: Grams) -> np.ndarray:
        """The kernel of a few texts with the landmarks; a text's size counts the grams that the sample knows."""
        present = np.zeros((len(texts), self.width + 1), bool)
        flat = present.reshape(-1)
        for h, row in grams.of(texts):
            flat[row * (self.width + 1) + self.columns(h)] = True
        norm = np.maximum(np.sqrt(present[:, : self.width].sum(axis=1, dtype=np.float32)), 1)[:, None]
        held = present[:, : len(self.landmarks)]
        some = np.flatnonzero(held.any(axis=0))
        return held[:, some].astype(np.float32) @ self.landmarks[some].astype(np.float32) * self.scale / norm

    def predict(self, texts: list[str], grams: Grams) -> tuple[list[str], np.ndarray]:
        """The likeliest language and its share of a softmax; texts without a letter are ``und`` with 0."""
        out, score = [UNDETERMINED] * len(texts), np.zeros(len(texts))
        for a, b in groups(texts):
            if not self.languages:
                continue
            margin = (self.kernel(texts[a:b], grams) @ self.weights + self.bias).astype(np.float64)
            share = np.exp(SHARPNESS * (margin - margin.max(axis=1, keepdims=True)))
            share /= share.sum(axis=1, keepdims=True)
            best = share.argmax(axis=1)
            for i in range(a, b):
                if any(map(str.isalpha, texts[i])):
                    out[i], score[i] = self.languages[best[i - a]], share[i - a, best[i - a]]
        return out, score


def fit(rows: DataFrame, per_language: int = 400, most_rows: int = 4000, landmarks: int = 160, ridge: float = 0.05) -> Model:
    """A model of ``rows`` (doc_id, text, lang) from a sample of about ``per_language`` rows a language and ``most_rows`` in all.

    No more than twice ``most_rows`` rows reach the driver, however often a doc_id repeats. Null texts or languages are
    not learned from; without any labelled row every text is ``und``.
    """
    sample = label_sample(rows.where("text is not null").select("doc_id", "text", "lang"), "lang", per_language, most_rows)
    return Model([(r.text, r.lang) for r in sample.select("text", "lang").limit(2 * most_rows).collect()], landmarks, ridge)


def predict(spark: SparkSession, docs: DataFrame, model: Model) -> DataFrame:
    """``docs`` with ``lang_pred string, score double`` of each whole text (columns of those names are replaced).

    Null texts and texts without a letter are ``und`` with score 0. Rows are independent: repeats, nulls in other
    columns and extra columns pass through, and an empty table gives no rows.
    """
    small_batches(spark)
    shared = spark.sparkContext.broadcast(model)
    schema = with_column(docs.select([c for c in docs.columns if c not in ("lang_pred", "score")]), "lang_pred", "string") + ", `score` double"

    def run(batches):
        grams = Grams()
        for batch in batches:
            rest = [n for n in batch.schema.names if n not in ("lang_pred", "score")]
            lang, score = shared.value.predict([t or "" for t in batch.column("text").to_pylist()], grams)
            yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in rest), pa.array(lang, pa.string()), pa.array(score)], [*rest, "lang_pred", "score"])

    return docs.withColumn("text", F.col("text").cast("string")).mapInArrow(run, schema)
