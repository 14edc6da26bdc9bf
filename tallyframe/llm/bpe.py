"""Byte-level BPE encoding and decoding through a sentencepiece model built from a rank file.

The model is serialised here, field by field: each token's bytes become printable characters, one for each byte, and
the piece scores minus its rank, so sentencepiece's merge order (best score first, leftmost on ties) is the order of
the ranks. The normaliser is the identity and nothing is added or escaped. Texts are split by the vocabulary's
pattern and each match is encoded by itself; ids are decoded through the inverse of the byte mapping.
"""

from __future__ import annotations

import base64
import functools
import struct

import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import small_batches
from .pretokens import PretokenCache, byte_characters, id_lists, spelled

# Fixed values of the sentencepiece model format: field numbers and enumerations.
PIECES, TRAINER, NORMALISER = 1, 2, 3
PIECE_TEXT, PIECE_SCORE, PIECE_TYPE = 1, 2, 3
NORMAL, UNKNOWN = 1, 2
MODEL_TYPE, BPE = 3, 2
VOCAB_SIZE, UNK_ID, BOS_ID, EOS_ID, PAD_ID = 4, 40, 41, 42, 43
NAME, DUMMY_PREFIX, REMOVE_SPACES, ESCAPE_SPACES = 1, 3, 4, 5
UNKNOWN_PIECE = "<unk>"


def varint(n: int) -> bytes:
    out = bytearray()
    n &= (1 << 64) - 1
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    return bytes([*out, n])


def number(field: int, value: int) -> bytes:
    return varint(field << 3) + varint(value)


def block(field: int, value: bytes) -> bytes:
    return varint(field << 3 | 2) + varint(len(value)) + value


@functools.lru_cache(4)
def read_ranks(path: str) -> list[bytes]:
    """Token bytes by rank."""
    with open(path, "rb") as f:
        rows = sorted((int(rank), base64.b64decode(token)) for token, rank in (line.split() for line in f if line.strip()))
    if [r for r, _ in rows] != list(range(len(rows))):
        raise ValueError("ranks must run from 0 without gaps")
    return [t for _, t in rows]


def serialise(tokens: list[bytes]) -> bytes:
    """A sentencepiece BPE model whose piece i is token i, and an unknown piece after the last."""
    chars = byte_characters()
    out = [block(PIECES, block(PIECE_TEXT, "".join(chars[b] for b in t).encode()) + varint(PIECE_SCORE << 3 | 5) + struct.pack("<f", -float(i)) + number(PIECE_TYPE, NORMAL)) for i, t in enumerate(tokens)]
    out.append(block(PIECES, block(PIECE_TEXT, UNKNOWN_PIECE.encode()) + varint(PIECE_SCORE << 3 | 5) + struct.pack("<f", 0.0) + number(PIECE_TYPE, UNKNOWN)))
    out.append(block(TRAINER, number(MODEL_TYPE, BPE) + number(VOCAB_SIZE, len(tokens) + 1) + number(UNK_ID, len(tokens)) + number(BOS_ID, -1) + number(EOS_ID, -1) + number(PAD_ID, -1)))
    out.append(block(NORMALISER, block(NAME, b"identity") + number(DUMMY_PREFIX, 0) + number(REMOVE_SPACES, 0) + number(ESCAPE_SPACES, 0)))
    return b"".join(out)


class Codec:
    """Encodes and decodes by the ranks in ``path``, splitting texts by ``pattern``."""

    def __init__(self, path: str, pattern: str) -> None:
        self.tokens = read_ranks(path)
        self.model = sentencepiece.SentencePieceProcessor(model_proto=serialise(self.tokens))
        self.chars, self.pattern = byte_characters(), pattern
        # decoding: all tokens' bytes in a row, mapped back from the model's pieces
        back = {c: b for b, c in enumerate(self.chars)}
        pieces = [bytes(back[c] for c in self.model.id_to_piece(i)) for i in range(len(self.tokens))]
        self.flat = np.frombuffer(b"".join(pieces), np.uint8)
        self.sizes = np.array([len(p) for p in pieces], np.int64)
        self.first = np.cumsum(self.sizes) - self.sizes

    @functools.cached_property
    def cache(self) -> PretokenCache:
        """Made by the workers that encode."""
        return PretokenCache(self.pattern, self.match_ids)

    def match_ids(self, matches: list[str]) -> list[list[int]]:
        return self.model.encode([spelled(m) for m in matches], num_threads=1)

    def decode(self, ids: np.ndarray) -> bytes:
        sizes = self.sizes[ids]
        ends = np.cumsum(sizes)
        at = np.arange(ends[-1] if len(ends) else 0) + np.repeat(self.first[ids] - (ends - sizes), sizes)
        return self.flat[at].tobytes()


@functools.lru_cache(2)
def codec(path: str, pattern: str) -> Codec:
    """One codec for each worker process."""
    return Codec(path, pattern)


def with_column(df: DataFrame, name: str, kind: str) -> str:
    """The schema of ``df`` without ``name``, then ``name``."""
    return ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema if f.name != name), f"`{name}` {kind}"])


def encode(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """``docs`` with ``ids array<int>`` for its whole ``text`` (a column ``ids`` is replaced).

    No special tokens are read or added. Null and empty texts have no ids. Rows are independent, so repeated rows,
    null keys and extra columns pass through; an empty table gives no rows.
    """

    small_batches(docs.sparkSession)

    def run(batches):
        c = codec(path, pattern)
        for batch in batches:
            rest = [n for n in batch.schema.names if n != "ids"]
            ids = id_lists(*c.cache.batch(batch.column("text").to_pylist()))
            yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in rest), ids], [*rest, "ids"])

    return docs.withColumn("text", F.col("text").cast("string")).mapInArrow(run, with_column(docs, "ids", "array<int>"))


def decode(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """``docs`` with ``decoded binary``, the bytes of its ``ids`` (null ids: none; an id outside the vocabulary fails)."""

    def run(batches):
        c = codec(path, pattern)
        for batch in batches:
            rest = [n for n in batch.schema.names if n != "decoded"]
            out = [c.decode(x.values.to_numpy()) if x.is_valid else b"" for x in batch.column("ids")]
            yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in rest), pa.array(out, pa.binary())], [*rest, "decoded"])

    return docs.mapInArrow(run, with_column(docs, "decoded", "binary"))
