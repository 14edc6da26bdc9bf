"""Best-fit packing by sums of squares.

Documents become pieces: whole windows of ``capacity`` tokens and a shorter rest. Whole windows stand alone. The rests
are dealt to groups of bounded size, and each group's rests are placed one by one, largest first: of all open bins
that have room, and a new one, a rest goes where the sum of the squared counts of open bins per residual gap becomes
smallest, and to the smallest gap where several do. New bins compete until a group has as many as its tokens need at
least; from then on one is opened only if a rest fits nowhere.
"""

from __future__ import annotations

import functools
import json
import re
import unicodedata
import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from .common import Scratch
from .pretokens import CHUNK, NUMBER, POINTS, POWERS, SPACE, PretokenCache, character_classes, chunks, pieces_of, spelled
from .words import U64, mix

#: Rests that a group holds on average.
GROUP = 4096
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long, deal long"
COLUMNS = ["doc_id", "piece", "start", "length", "ids_crc32"]
PACKED = "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"


# What the fast path knows of a tokenizer file, and its contractions by first letter.
NORMALISERS = ["NFC", "Replace", "Lowercase"]
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
SINGLE, DOUBLE = "stmd", {"r": "e", "v": "e", "l": "l"}
BLANKS = "\t\n\x0b\x0c\r "


def settled_points() -> tuple[np.ndarray, np.ndarray]:
    """Each code point in lower case, and whether that is all that normalising does to it, wherever it stands.

    Not settled are marks and other points that compose, points that lower case makes longer, points that old
    versions of Unicode don't assign, and white space but ``BLANKS``.
    """
    lower, settled = np.arange(POINTS, dtype=np.uint32), np.zeros(POINTS, bool)
    for i in [*range(0xD800), *range(0xE000, 0x20000)]:
        c = chr(i)
        kind = unicodedata.ucd_3_2_0.category(c)
        if kind[0] in "LNPS" and not 0x1100 <= i < 0x1200 and len(c.lower()) == 1 and unicodedata.normalize("NFC", c) == c and unicodedata.normalize("NFC", c.lower()) == c.lower() or c in BLANKS:
            lower[i], settled[i] = ord(c.lower()), True
    return lower, settled


class WordEncoder:
    """Ids of whole texts by a tokenizer for which white space only parts words.

    Where the file normalises and splits as ``NORMALISERS`` and ``SPLIT`` say, each distinct match in lower case is
    encoded once. Words that hold a point that isn't settled, or the string of a special token (read as its id, as the
    tokenizer does), and all words of other files, are encoded by the whole tokenizer.
    """

    def __init__(self, path: str) -> None:
        self.tokenizer = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        added = spec["added_tokens"]
        if any(t["single_word"] or t["lstrip"] or t["rstrip"] or t["content"].split() != [t["content"]] for t in added) or self.whole(["a b", " a\t\n", "b"]) != [x + y for x, y in zip(self.whole(["a", "a", ""]), self.whole(["b", "", "b"]), strict=True)]:
            raise ValueError(f"white space does more than part words in {path}")
        normal, before = spec["normalizer"] or {}, spec["pre_tokenizer"] or {}
        parts = before.get("pretokenizers", [{}])
        known = [n["type"] for n in normal.get("normalizers", [])] == NORMALISERS and parts[0].get("pattern") == {"Regex": SPLIT} and [p["type"] for p in parts[1:]] == ["ByteLevel"] and not parts[1]["add_prefix_space"] and not parts[1]["use_regex"]
        self.lower, self.settled = settled_points()
        self.settled &= known
        self.settled[list(map(ord, BLANKS))] = True
        self.special = re.compile("|".join(re.escape(t["content"]) for t in added) or r"(?!)")
        self.kinds = character_classes()
        self.kinds[list(map(ord, BLANKS))] = SPACE
        self.table = mix(np.arange(1, POINTS + 1, dtype=U64)) | U64(1)
        self.cache = PretokenCache(r"\S+", self.match_ids)

    def whole(self, words: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch_fast(words, add_special_tokens=False)]

    def match_ids(self, matches: list[tuple[bool, str]]) -> list[list[int]]:
        rest = iter(self.whole([m for odd, m in matches if odd]))
        tokenize = self.tokenizer.model.tokenize
        # letter by letter, so no sigma is a final one
        return [next(rest) if odd else [t.id for t in tokenize(spelled(m.replace("Σ", "σ").lower()))] for odd, m in matches]

    def batch(self, texts: list[str | None]):
        """(number of texts, ids, bounds of each text's ids) of whole texts at a time; null texts have no ids."""
        for run in chunks([t or "" for t in texts]):
            found = [self.chunk(part) for part in parted(run)]
            ids = np.concatenate([x for x, _ in found])
            if len(found) == 1:
                yield len(run), ids, found[0][1]
            else:  # a single long text, cut before blanks
                yield 1, ids, np.array([0, len(ids)])

    def chunk(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the texts, and the bounds of each text's."""
        if self.cache.count > MOST_MATCHES:
            self.cache.clear()
        text = "".join(texts)
        n, bounds = len(text), np.cumsum([0, *map(len, texts)])
        raw = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
        points = self.lower[raw]
        kind = self.kinds[points]
        opens = np.zeros(n + 1, bool)
        opens[bounds] = True
        start = opens.copy()
        start[1:n] |= (kind[1:] != kind[:-1]) | (kind[1:] == NUMBER)
        at = np.flatnonzero((points == 39) & start[:n])
        at = at[~opens[at + 1]]
        if len(at):
            after, third = points[at + 1], points[np.minimum(at + 2, n - 1)]
            size = np.where(np.isin(after, [ord(c) for c in SINGLE]), 2, 0)
            for c, d in DOUBLE.items():
                size[~opens[np.minimum(at + 2, n)] & (after == ord(c)) & (third == ord(d))] = 3
            at, size = at[size > 0], size[size > 0]
            start[at + 1] = False
            start[at[size == 3] + 2] = False
            start[at + size] = True
        odd = ~self.settled[raw]
        for m in self.special.finditer(text):
            odd[m.start() : m.end()] = True
        whole = np.zeros(n, bool)
        if odd.any():  # such words are one match each
            blank = kind == SPACE
            first = opens[:n].copy()
            first[0] = True
            first[1:] |= blank[1:] != blank[:-1]
            word = np.cumsum(first) - 1
            whole = np.bincount(word[odd], minlength=word[-1] + 1).astype(bool)[word] & ~blank
            start[:n][whole] = first[whole]
            points = np.where(whole, raw, points)
        starts = np.flatnonzero(start[:n])
        ends = np.r_[starts[1:], n]
        ends, starts = ends[kind[starts] != SPACE], starts[kind[starts] != SPACE]
        up, down = POWERS.get(n + 1)
        total = np.zeros(n + 1, U64)
        np.cumsum(self.table[points] * up[:n], out=total[1:])
        hashes = mix((total[ends] - total[starts]) * down[starts])
        place = self.cache.find(hashes)
        missing = np.flatnonzero(place < 0)
        if len(missing):
            new, example, which = np.unique(hashes[missing], return_index=True, return_inverse=True)
            of = missing[example]
            place[missing] = self.cache.count + which
            self.cache.learn(new, [(w, text[a:b]) for w, a, b in zip(whole[starts[of]].tolist(), starts[of].tolist(), ends[of].tolist(), strict=True)])
        ids, at = self.cache.joined(place)
        return ids, at[np.searchsorted(starts, bounds)]


def parted(run: list[str]) -> list[list[str]]:
    """A run of texts as it is, or a single long text in parts."""
    return [[p] for p in pieces_of(run[0])] if len(run) == 1 and len(run[0]) > 2 * CHUNK else [run]


#: Matches that the cache holds before it starts anew.
MOST_MATCHES = 400_000


@functools.lru_cache(2)
def encoder(path: str) -> WordEncoder:
    """One encoder for each worker process."""
    return WordEncoder(path)


def pieces(docs: DataFrame, path: str, capacity: int, closing: int) -> DataFrame:
    """Every document's ids and ``closing``, cut into windows and a rest; ``deal`` is negative for whole windows."""

    def run(batches):
        deal = TaskContext.get().partitionId() * 7919 if TaskContext.get() else 0
        for batch in batches:
            first = 0
            for n, ids, bounds in encoder(path).batch(batch.column(1).to_pylist()):
                ids = np.insert(ids, bounds[1:], closing).astype("<u4")
                total = np.diff(bounds) + 1
                count = -(-total // capacity)
                row = np.repeat(np.arange(n), count)
                nth = np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)
                start = nth * capacity
                length = np.minimum(capacity, total[row] - start)
                at = (bounds[:-1] + np.arange(n))[row] + start
                packed = memoryview(ids.tobytes())
                crc = [zlib.crc32(packed[a:b]) for a, b in zip((4 * at).tolist(), (4 * (at + length)).tolist(), strict=True)]
                rest = length < capacity
                order = np.where(rest, deal + np.cumsum(rest) - 1, -1)
                deal += int(rest.sum())
                columns = [batch.column(0).take(pa.array(row + first)), pa.array(nth, pa.int32()), *(pa.array(x, pa.int64()) for x in (start, length, crc, order))]
                first += n
                yield pa.RecordBatch.from_arrays(columns, [*COLUMNS, "deal"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, PIECES)


def sum_of_squares(sizes: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """The bin and offset of each item, items being placed in their order; no item is larger than ``capacity``."""
    least = -(-int(sizes.sum()) // capacity)
    count = np.zeros(capacity + 1, np.int32)  # open bins by gap, the full ones left out
    bins: list[list[int]] = [[] for _ in range(capacity + 1)]
    where, offset, opened = np.zeros(len(sizes), np.int64), np.zeros(len(sizes), np.int64), 0
    taken = np.iinfo(np.int32).max
    for i, size in enumerate(sizes.tolist()):
        # the change of the sum of squares by every gap that has room, halved: one bin less of this gap, one more of the rest
        here = count[size:capacity]
        change = count[: capacity - size] - here
        if size < capacity:
            change[0] = -here[0]  # a bin that gets full counts no more: by half a bin better than its row says
            change = np.where(here > 0, 2 * change + 2, taken)
            change[0] -= here[0] > 0
            gap = int(change.argmin())
            best = int(change[gap])
        else:
            best = taken
        afresh = 2 * int(count[capacity - size]) + 1 if size < capacity else 0
        if best < taken and (best <= afresh or opened >= least):
            gap += size
            number = bins[gap].pop()
            count[gap] -= 1
        else:
            gap, number, opened = capacity, opened, opened + 1
        where[i], offset[i] = number, capacity - gap
        if gap > size:
            bins[gap - size].append(number)
            count[gap - size] += 1
    return where, offset


def packed_groups(capacity: int):
    def run(key, group):
        group = group.sort_by([("length", "descending"), ("doc_id", "ascending"), ("start", "ascending"), ("deal", "ascending")])
        where, offset = sum_of_squares(group["length"].to_numpy(), capacity)
        base = key[0].as_py() << 24
        return group.select(COLUMNS).append_column("sequence_id", pa.array((base + where) * 2)).append_column("offset", pa.array(offset))

    return run


def pack(spark: SparkSession, docs: DataFrame, path: str, closing: int, capacity: int = 4096) -> DataFrame:
    """One row for each piece: ``doc_id, piece, start, length, ids_crc32, sequence_id, offset``.

    A document's tokens are its text's ids by the tokenizer in ``path`` (no special token is added, but the string of
    one is read as its id) and ``closing``; a null or empty text is that alone. Only documents of more than
    ``capacity`` tokens are cut, into windows of so many and a rest. Each sequence holds at most ``capacity`` tokens
    without gaps from 0. Rows are packed one by one, so repeated rows and null doc_ids keep their pieces; columns other
    than doc_id and text are ignored; an empty table gives no rows. Even sequence ids are groups' bins, odd ones whole windows.
    """
    scratch = Scratch(spark, "best-fit")
    cut = scratch.put(pieces(docs, path, capacity, closing), "pieces")
    rests = cut.where("deal >= 0")
    n_groups = max(1, -(-rests.count() // GROUP))
    shared = rests.withColumn("part", F.pmod(F.xxhash64("deal"), F.lit(n_groups))).groupBy("part").applyInArrow(packed_groups(capacity), PACKED)
    alone = cut.where("deal < 0").select(*COLUMNS, (F.monotonically_increasing_id() * 2 + 1).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    return alone.unionByName(shared)
