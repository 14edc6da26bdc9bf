"""Packing of token sequences by Karmarkar-Karp multiway differencing.

Documents become pieces in one pass: whole windows of ``capacity`` tokens, and a rest cut at multiples of ``grain``.
Windows stand alone. The rests are dealt to groups of bounded size, and each group is partitioned into windows:
every piece starts as a partition of its own, and the two partitions of largest imbalance are merged with their
windows opposed, the fullest of one on the emptiest of the other, until one partition of near-equal windows is left.
The number of windows starts at the group's tokens over the capacity and rises whenever a window exceeds it.
"""

from __future__ import annotations

import functools
import heapq
import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from tokenizers import Tokenizer
from tokenizers.pre_tokenizers import ByteLevel

from .common import Scratch
from .pretokens import PretokenCache, spelled

GROUP = 1024
PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, deal long"
PACKED = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


class Encoder:
    """Ids of whole texts by the tokenizer in ``path``; ``special`` reads the strings of special tokens as their ids."""

    def __init__(self, path: str, pattern: str, special: bool) -> None:
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = not special
        added = self.tokenizer.get_added_tokens_decoder() if special else {}
        self.special = {t.content: i for i, t in added.items()}
        self.plain = not any(t.single_word or t.lstrip or t.rstrip for t in added.values())
        self.cut = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")") if added else None
        before = self.tokenizer.pre_tokenizer
        self.direct = self.tokenizer.normalizer is None and isinstance(before, ByteLevel) and before.use_regex and not before.add_prefix_space
        self.cache = PretokenCache(pattern, self.match_ids)

    def match_ids(self, matches: list[str]) -> list[list[int]]:
        if self.direct:
            return [[t.id for t in self.tokenizer.model.tokenize(spelled(m))] for m in matches]
        return [e.ids for e in self.tokenizer.encode_batch_fast(matches, add_special_tokens=False)]

    def batch(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the texts, and the bounds of each text's; null texts have none."""
        if self.cut is None or not any(t and self.cut.search(t) for t in texts):
            return self.cache.batch(texts)
        # what stands between special tokens is encoded by itself
        parts = [self.cut.split(t or "") if self.plain else [t or ""] for t in texts]
        flat = [p for part in parts for p in part]
        ids, bounds = self.cache.batch(["" if p in self.special else p for p in flat])
        out = [np.array([self.special[p]], np.uint32) if p in self.special else ids[a:b] for p, a, b in zip(flat, bounds, bounds[1:], strict=False)]
        if not self.plain:
            out = [np.array(self.tokenizer.encode(p, add_special_tokens=False).ids, np.uint32) if self.cut.search(p) else x for p, x in zip(flat, out, strict=True)]
        ends = np.cumsum(np.r_[0, [len(x) for x in out]])
        return np.concatenate([np.zeros(0, np.uint32), *out]), ends[np.cumsum([0, *map(len, parts)])]


@functools.lru_cache(4)
def encoder(path: str, pattern: str, special: bool = False) -> Encoder:
    """One encoder for each worker process."""
    return Encoder(path, pattern, special)


def difference(sizes: np.ndarray, windows: int) -> list[list[int]]:
    """A partition of the items into ``windows`` sets of near-equal sums, as lists of item numbers."""
    # a partition: its non-empty windows' sums, largest first, and their items as nested pairs
    heap = []
    for i in np.argsort(-sizes, kind="stable"):
        heap.append((-int(sizes[i]), len(heap), np.array([sizes[i]], np.int64), [int(i)]))
    count = len(heap)
    while len(heap) > 1:
        _, _, a, x = heapq.heappop(heap)
        _, _, b, y = heapq.heappop(heap)
        both = len(a) + len(b) - windows
        if both <= 0:
            sums, items = np.concatenate([a, b]), [*x, *y]
        else:
            # the emptiest windows of one take the fullest of the other, the rest meet empty windows
            p, q = len(a) - both, len(b) - both
            sums = np.concatenate([a[:p], b[:q], a[p:] + b[q:][::-1]])
            items = [*x[:p], *y[:q], *((m, n) for m, n in zip(x[p:], reversed(y[q:]), strict=True))]
        order = np.argsort(-sums, kind="stable")
        sums, items = sums[order], [items[i] for i in order]
        least = int(sums[-1]) if len(sums) == windows else 0
        heapq.heappush(heap, (least - int(sums[0]), count, sums, items))
        count += 1
    if not heap:
        return []
    out = []
    for tree in heap[0][3]:
        flat, stack = [], [tree]
        while stack:
            node = stack.pop()
            if isinstance(node, tuple):
                stack.extend(node)
            else:
                flat.append(node)
        out.append(flat)
    return out


def fill(sizes: np.ndarray, capacity: int) -> list[list[int]]:
    """Sets of items within ``capacity``: the fewest windows whose differencing stays within it, counting up."""
    windows = max(1, -(-int(sizes.sum()) // capacity))
    while True:
        found = difference(sizes, windows)
        over = max((int(sizes[s].sum()) for s in found), default=0) - capacity
        if over <= 0:
            return found
        windows += max(1, windows * over // (4 * capacity))


def pieces(docs: DataFrame, path: str, pattern: str, capacity: int, grain: int) -> DataFrame:
    """Every document's ids and a closing 0, cut into pieces; ``deal`` is negative for whole windows."""

    def run(batches):
        encode = encoder(path, pattern, True).batch
        deal = (TaskContext.get().partitionId() * 7919) if TaskContext.get() else 0
        for batch in batches:
            ids, bounds = encode(batch.column(1).to_pylist())
            ids = np.insert(ids, bounds[1:], 0).astype("<u4")
            total = np.diff(bounds) + 1
            whole = total // capacity
            count = whole + -(-(total - whole * capacity) // grain)
            row = np.repeat(np.arange(len(total)), count)
            nth = np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)
            rest = np.maximum(nth - whole[row], 0)
            full = nth < whole[row]
            start = np.minimum(nth, whole[row]) * capacity + rest * grain
            length = np.where(full, capacity, np.minimum(grain, total[row] - start))
            at = (bounds[:-1] + np.arange(len(total)))[row] + start
            packed = memoryview(ids.tobytes())
            crc = [zlib.crc32(packed[a:b]) for a, b in zip((4 * at).tolist(), (4 * (at + length)).tolist(), strict=True)]
            order = deal + np.cumsum(~full) - 1
            deal += int((~full).sum())
            columns = [batch.column(0).take(pa.array(row)), *(pa.array(x, pa.int64()) for x in (start, length, crc, total[row], np.where(full, -1, order)))]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "deal"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, PIECES)


def packed_groups(capacity: int):
    def run(key, group):
        group = group.sort_by([("length", "descending"), ("doc_id", "ascending"), ("start", "ascending"), ("deal", "ascending")])
        sizes = group["length"].to_numpy()
        sequence, offset = np.zeros(len(sizes), np.int64), np.zeros(len(sizes), np.int64)
        for i, items in enumerate(fill(sizes, capacity)):
            items = np.sort(items)
            sequence[items] = i
            offset[items] = np.cumsum(sizes[items]) - sizes[items]
        base = key[0].as_py() << 21
        out = group.select(["doc_id", "start", "length", "ids_crc32", "doc_tokens"])
        return out.append_column("sequence_id", pa.array((base + sequence) * 2)).append_column("offset", pa.array(offset))

    return run


def pack(spark: SparkSession, docs: DataFrame, path: str, pattern: str, capacity: int = 1024, grain: int = 256) -> DataFrame:
    """One row for each piece: ``doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset``.

    A document's tokens are its text's ids as the tokenizer gives them (no special token is added, but the string of
    one is read as its id) and a closing 0; a null or empty text is that 0 alone. Each token lies in one piece, each piece in one sequence of at most ``capacity`` tokens, without gaps. Rows
    are packed one by one, so repeated rows and null doc_ids keep their pieces; columns other than doc_id and text
    are ignored; an empty table gives no rows. Even sequence ids are groups' windows, odd ones whole windows.
    """
    scratch = Scratch(spark, "packing")
    cut = scratch.put(pieces(docs, path, pattern, capacity, grain), "pieces")
    n_groups = max(1, -(-cut.where("deal >= 0").count() // GROUP))
    rests = cut.where("deal >= 0").withColumn("part", F.pmod(F.xxhash64("deal"), F.lit(n_groups)))
    shared = rests.groupBy("part").applyInArrow(packed_groups(capacity), PACKED)
    columns = ["doc_id", "start", "length", "ids_crc32", "doc_tokens"]
    alone = cut.where("deal < 0").select(*columns, (F.monotonically_increasing_id() * 2 + 1).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    return alone.unionByName(shared)
