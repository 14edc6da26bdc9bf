"""Alignment of two tokenizers' tokens, and how often they stand for each other.

Tokenizer A is byte-level BPE, tokenizer B a sentencepiece model with byte fallback; both spell the same bytes, a blank and
the text. Where tokens of both end, a text is cut into groups; between any two neighbouring ends, of whichever side,
one token of A overlaps one of B, which is a link. Links are counted by pair of ids and document in a matrix of A's ids
by B's, cut into stripes of A's ids: each stripe's counts are added into a dense block, whose row maxima tell the best
partners, and the links, which lie in stripes as well, are scored beside their stripe. A stripe with many links is
dealt to several tasks, by the measured size of its links, and its counts go to each of them.
"""

from __future__ import annotations

import functools
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from .common import Scratch
from .packing import encoder
from .pretokens import CHUNK, PretokenCache, byte_characters, chunks, pieces_of
from .words import POWERS, TABLE, U64, mix, text_buffer

#: Stripes of A's ids (id modulo stripes), and bytes of links that a task scores for a stripe.
STRIPES, SHARE = 256, 64 << 20
#: Characters of the documents of a chunk (one document at least), and documents, whose places have two bytes.
CHUNK_CHARS, CHUNK_DOCS = 1 << 20, 1 << 16
#: Units that the cache of B's encoder holds before it starts anew.
MOST_UNITS = 400_000
BLANK = "▁"  # fixed value: how sentencepiece writes a blank


class Bytes:
    """The bytes of a sequence of ids."""

    def __init__(self, pieces: list[bytes]) -> None:
        self.flat = np.frombuffer(b"".join(pieces), np.uint8)
        self.sizes = np.array([*map(len, pieces)], np.int64)
        self.first = np.cumsum(self.sizes) - self.sizes

    def joined(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All ids' bytes, and where each id's end."""
        sizes = self.sizes[ids]
        ends = np.cumsum(sizes)
        return self.flat[np.arange(ends[-1] if len(ends) else 0) + np.repeat(self.first[ids] - (ends - sizes), sizes)], ends


class PieceEncoder:
    """Ids of whole texts by a sentencepiece model, which puts a blank before a text.

    If no piece has a blank after another character, no merge crosses the start of a run of blanks; then the units
    between such starts, each of which the model sees as a text less its first blank, are encoded once each.
    """

    def __init__(self, path: str) -> None:
        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        pieces = [self.model.id_to_piece(i) for i in range(self.model.get_piece_size())]
        self.by_unit = BLANK in pieces and not any(BLANK in p.lstrip(BLANK) for p in pieces)
        self.lone = [pieces.index(BLANK)] if self.by_unit else []
        self.bytes = Bytes([bytes([int(p[3:5], 16)]) if self.model.is_byte(i) else p.replace(BLANK, " ").encode() for i, p in enumerate(pieces)])
        self.cache = PretokenCache(r"\S+", self.ids)

    def ids(self, texts: list[str]) -> list[list[int]]:
        """What the model makes of each text with its blank; it puts none before an empty one."""
        return [ids if t else self.lone for t, ids in zip(texts, self.model.encode(texts, num_threads=1), strict=True)]

    def batch(self, data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All ids of texts given as bytes, each with its first blank, and the bounds of each text's."""
        if not self.by_unit:
            found = self.ids([data[a + 1 : b].tobytes().decode() for a, b in zip(bounds.tolist(), bounds[1:].tolist(), strict=False)])
            return np.array([i for ids in found for i in ids], np.uint32), np.cumsum([0, *map(len, found)])
        if self.cache.count > MOST_UNITS:
            self.cache.clear()
        n = len(data)
        start = data == 32
        start[1:] &= data[:-1] != 32
        start[bounds[:-1]] = True
        starts = np.flatnonzero(start)
        ends = np.r_[starts[1:], n]
        up, down = POWERS.get(n + 1)
        total = np.zeros(n + 1, U64)
        np.cumsum(TABLE[data] * up[:n], out=total[1:])
        hashes = mix((total[ends] - total[starts]) * down[starts])
        place = self.cache.find(hashes)
        missing = np.flatnonzero(place < 0)
        if len(missing):
            new, example, which = np.unique(hashes[missing], return_index=True, return_inverse=True)
            of, held = missing[example], data.tobytes()
            place[missing] = self.cache.count + which
            self.cache.learn(new, [held[a + 1 : b].decode() for a, b in zip(starts[of].tolist(), ends[of].tolist(), strict=True)])
        ids, at = self.cache.joined(place)
        return ids, at[np.searchsorted(starts, bounds)]


class Aligner:
    """Both tokenizers, their tokens' bytes, and the decimal spellings of their ids."""

    def __init__(self, a_path: str, b_path: str, pattern: str) -> None:
        self.a, self.b = encoder(a_path, pattern), PieceEncoder(b_path)
        back = {c: i for i, c in enumerate(byte_characters())}
        size = self.a.tokenizer.get_vocab_size(with_added_tokens=True)
        # the strings of special tokens are never read, so their entries spell nothing
        self.a_bytes = Bytes([bytes(back.get(c, 0) for c in self.a.tokenizer.id_to_token(i) or "") for i in range(size)])
        self.n_a, self.n_b = size, len(self.b.bytes.sizes)
        self.cells = -(-self.n_a // STRIPES) * self.n_b
        # every id with what follows it: a comma, or the end of its side of the group
        spell = lambda n, end: [f"{i}{c}".encode() for c in ("," + end) for i in range(n)]
        self.spelled = Bytes([*spell(self.n_a, "|"), *spell(self.n_b, ";")])

    def align(self, texts: list[str]) -> dict[str, np.ndarray]:
        """Both sides' tokens and ends of texts that bring their first blank, as arrays over those that both spell (``kept``)."""
        data, bounds = text_buffer(pa.array(texts, pa.string()))
        ids_a, at_a = self.a.batch(texts)
        ids_b, at_b = self.b.batch(data, bounds)
        ids_a, ids_b = ids_a.astype(np.int64), ids_b.astype(np.int64)
        kept, right = np.ones(len(texts), bool), []
        for ids, at, table in ((ids_a, at_a, self.a_bytes), (ids_b, at_b, self.b.bytes)):
            said, ends = table.joined(ids)
            size = np.diff(np.r_[0, ends][at])
            same = size == np.diff(bounds)
            if len(said) == len(data) and same.all():
                wrong = said != data
                if wrong.any():
                    same[np.searchsorted(bounds, np.flatnonzero(wrong), "right") - 1] = False
            else:
                first = np.cumsum(size) - size
                for i in np.flatnonzero(same).tolist():
                    same[i] = np.array_equal(said[first[i] : first[i] + size[i]], data[bounds[i] : bounds[i + 1]])
            kept &= same
            right.append((ids, at, table))
        out = {"kept": kept, "bounds": np.cumsum(np.r_[0, np.diff(bounds)[kept]])}
        for name, (ids, at, table) in zip("ab", right, strict=True):
            ids = ids[np.repeat(kept, np.diff(at))]
            out[name], out[f"at_{name}"] = ids, np.cumsum(np.r_[0, np.diff(at)[kept]])
            out[f"ends_{name}"] = np.cumsum(table.sizes[ids])
        return out


@functools.lru_cache(2)
def aligner(a_path: str, b_path: str, pattern: str) -> Aligner:
    """One for each worker process."""
    return Aligner(a_path, b_path, pattern)


def spelled_groups(x: Aligner, f: dict[str, np.ndarray], cuts: np.ndarray) -> tuple[bytes, np.ndarray]:
    """Every text's groups as bytes, ending in a semicolon each, and the bounds of the texts' bytes."""
    group_a, group_b = (np.searchsorted(cuts, f[f"ends_{s}"]) for s in "ab")
    last_a, last_b = (np.isin(f[f"ends_{s}"], cuts, assume_unique=True) for s in "ab")
    upto_a, upto_b = (np.searchsorted(g, np.arange(len(cuts) + 1)) for g in (group_a, group_b))
    # a group's A tokens come after all B tokens of earlier groups, its B tokens after its A tokens
    order = np.empty(len(group_a) + len(group_b), np.int64)
    order[np.arange(len(group_a)) + upto_b[group_a]] = f["a"] + x.n_a * last_a
    order[np.arange(len(group_b)) + upto_a[group_b + 1]] = 2 * x.n_a + f["b"] + x.n_b * last_b
    said, ends = x.spelled.joined(order)
    return said.tobytes(), np.r_[0, ends][f["at_a"] + f["at_b"]]


ROWS = "kind int, chunk long, place int, doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, pairs binary, docs binary, owners binary, which binary, times binary, size long"
DOC = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256"]
STRIPE = ["pairs", "docs", "owners", "which", "times", "size"]


def linked(docs: DataFrame, a_path: str, b_path: str, pattern: str) -> DataFrame:
    """Rows of two kinds. Of kind -1, one for each document: its counts and hash. Of kind s, one for each chunk of
    documents and stripe: the stripe's ``pairs`` (place of the A id in the stripe times B's ids, and the B id), in how
    many ``docs`` of the chunk each is linked, and the links: place of the document (``owners``), of the pair (``which``), ``times``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        x = aligner(a_path, b_path, pattern)
        chunk = (TaskContext.get().partitionId() if TaskContext.get() else 0) << 33
        ids: list = []
        texts: list[str] = []
        held = 0
        for batch in batches:
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if texts and (held + len(text or "") > CHUNK_CHARS or len(texts) == CHUNK_DOCS):
                    yield from found(x, ids, texts, chunk)
                    chunk, ids, texts, held = chunk + 1, [], [], 0
                held += len(text or "")
                ids.append(doc)
                texts.append(text or "")
        if texts:
            yield from found(x, ids, texts, chunk)

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, ROWS)


def found(x: Aligner, ids: list, texts: list[str], chunk: int) -> Iterator[pa.RecordBatch]:
    n = len(texts)
    counts, right, hashes = np.zeros((4, n), np.int64), np.ones(n, bool), [None] * n
    merged: list[tuple[np.ndarray, np.ndarray]] = []
    # a long text is cut where tokens of both sides begin; parts bring their first blank
    parts = [(i, p if k else " " + p) for i, t in enumerate(texts) if t for k, p in enumerate(pieces_of(t) if x.b.by_unit and len(t) > 2 * CHUNK else [t])]
    at = 0
    for run in chunks([p for _, p in parts]):
        mine = np.array([i for i, _ in parts[at : at + len(run)]])
        at += len(run)
        f = x.align(run)
        right[mine[~f["kept"]]] = False
        mine, bounds = mine[f["kept"]], f["bounds"]
        if not len(mine):
            continue
        cuts = np.intersect1d(f["ends_a"], f["ends_b"], assume_unique=True)
        ends = np.union1d(f["ends_a"], f["ends_b"])
        left, other = (f[s][np.searchsorted(f[f"ends_{s}"], ends)] for s in "ab")
        links = np.diff(np.searchsorted(ends, bounds, "right"))
        for row, more in zip(counts, (np.diff(f["at_a"]), np.diff(f["at_b"]), np.diff(np.searchsorted(cuts, bounds, "right")), links), strict=True):
            np.add.at(row, mine, more)
        said, where = spelled_groups(x, f, cuts)
        view = memoryview(said)
        for i, a, b in zip(mine.tolist(), where.tolist(), where[1:].tolist(), strict=False):
            if hashes[i] is None:
                hashes[i] = hashlib.sha256(view[a : b - 1])
            else:
                hashes[i].update(b";")
                hashes[i].update(view[a : b - 1])
        # by stripe, then place in the stripe, then document: once, with the number of times
        key = ((left % STRIPES) * x.cells + (left // STRIPES) * x.n_b + other) * n + np.repeat(mine, links)
        merged.append(np.unique(key, return_counts=True))
        if len(merged) > 16:
            merged = [added(merged)]
    counts[:, ~right] = 0
    yield documents(ids, counts, [h.hexdigest() if h and ok else "" for h, ok in zip(hashes, right.tolist(), strict=True)], chunk)
    key, times = added(merged)
    pair, owner = np.divmod(key, n)
    if not right.all():
        held = right[owner]
        pair, owner, times = pair[held], owner[held], times[held]
    new = np.flatnonzero(np.r_[True, pair[1:] != pair[:-1]]) if len(pair) else np.zeros(0, np.int64)
    first = np.r_[new, len(pair)]
    docs = np.diff(first)
    stripe, local = np.divmod(pair[new], x.cells)
    edge = np.searchsorted(stripe, np.arange(STRIPES + 1))
    which = np.repeat(np.arange(len(new)), docs)
    rows = []
    for s in np.flatnonzero(np.diff(edge)).tolist():
        p, q = slice(edge[s], edge[s + 1]), slice(first[edge[s]], first[edge[s + 1]])
        held = [local[p].astype("<u4"), docs[p].astype("<u4"), owner[q].astype("<u2"), (which[q] - edge[s]).astype("<u4"), times[q].astype("<u4")]
        rows.append({"kind": s, "chunk": chunk} | {k: v.tobytes() for k, v in zip(STRIPE, held, strict=False)} | {"size": sum(v.nbytes for v in held[2:])})
    for a in range(0, len(rows), 64):
        yield pa.RecordBatch.from_pylist(rows[a : a + 64], schema=ARROW)


def added(counted: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys, ascending, with the sums of their counts."""
    if len(counted) == 1:
        return counted[0]
    keys, at = np.unique(np.concatenate([np.zeros(0, np.int64), *(k for k, _ in counted)]), return_inverse=True)
    sums = np.zeros(len(keys), np.int64)
    np.add.at(sums, at, np.concatenate([np.zeros(0, np.int64), *(c for _, c in counted)]))
    return keys, sums


KINDS = {"int": pa.int32(), "long": pa.int64(), "string": pa.string(), "binary": pa.binary()}
ARROW = pa.schema([(n, KINDS[k]) for n, k in (f.split() for f in ROWS.split(", "))])


def documents(ids: list, counts: np.ndarray, hashes: list[str], chunk: int) -> pa.RecordBatch:
    n = len(ids)
    have = {"kind": pa.array(np.full(n, -1, np.int32)), "chunk": pa.array(np.full(n, chunk)), "place": pa.array(np.arange(n, dtype=np.int32)), "doc_id": pa.array(ids, pa.int64()), "groups_sha256": pa.array(hashes)}
    have |= {c: pa.array(v) for c, v in zip(("n_a", "n_b", "n_groups", "n_links"), counts, strict=True)}
    return pa.RecordBatch.from_arrays([have.get(f.name, pa.nulls(n, f.type)) for f in ARROW], schema=ARROW)


COUNTS = "kind int, pairs binary, counts binary, best binary"


def stripe_counts(rows: DataFrame, n_a: int, n_b: int, level: int) -> DataFrame:
    """Each stripe's pairs with their counts over all documents (eight bytes each), and whether a count is its A id's highest.

    The rows of a stripe stream through one dense block of its A ids by all B ids; ``level`` 0 adds up the rows of a
    partition as they stand, level 1 all sums of a stripe.
    """
    width, height = n_b, -(-n_a // STRIPES)

    def run(batches):
        block, now, touched = np.zeros(height * width, np.int64), None, []

        def flushed():
            pairs = np.unique(np.concatenate(touched))  # all cells that aren't 0
            counts, row = block[pairs], pairs // width
            start = np.flatnonzero(np.r_[True, row[1:] != row[:-1]])
            best = counts == np.repeat(np.maximum.reduceat(counts, start), np.diff(np.r_[start, len(row)]))
            block[pairs] = 0
            touched.clear()
            return pa.RecordBatch.from_arrays([pa.array([now], pa.int32()), *(pa.array([v.tobytes()], pa.binary()) for v in (pairs.astype("<u4"), counts.astype("<i8"), best))], ["kind", "pairs", "counts", "best"])

        for batch in batches:
            for kind, pairs, counts in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if now is not None and kind != now:
                    yield flushed()
                now, pairs = kind, np.frombuffer(pairs, "<u4")
                touched.append(pairs)
                if len(touched) > 256:
                    touched[:] = [np.unique(np.concatenate(touched))]
                np.add.at(block, pairs, np.frombuffer(counts, "<i8" if level else "<u4").astype(np.int64))
        if now is not None:
            yield flushed()

    return rows.mapInArrow(run, COUNTS)


SCORES = "chunk long, owners binary, n_best binary, count_sum binary"


def scored(rows: DataFrame, n_a: int, n_b: int) -> DataFrame:
    """The sums over the links of each row by document, where a stripe's counts come before its links."""
    cells = -(-n_a // STRIPES) * n_b

    def run(batches):
        count, best, held = np.zeros(cells, np.int64), np.zeros(cells, bool), np.zeros(0, np.int64)
        for batch in batches:
            out: list[tuple] = []
            for chunk, pairs, counts, tops, owners, which, times in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                pairs = np.frombuffer(pairs, "<u4")
                if counts is not None:
                    count[held], best[held] = 0, False
                    held = pairs
                    count[held], best[held] = np.frombuffer(counts, "<i8"), np.frombuffer(tops, bool)
                    continue
                owners, of, times = np.frombuffer(owners, "<u2"), pairs[np.frombuffer(which, "<u4")], np.frombuffer(times, "<u4").astype(np.int64)
                mine, at = np.unique(owners, return_inverse=True)
                sums = np.zeros((2, len(mine)), np.int64)
                np.add.at(sums[0], at, times * best[of])
                np.add.at(sums[1], at, times * count[of])
                out.append((chunk, mine.tobytes(), sums[0].tobytes(), sums[1].tobytes()))
            yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(list(zip(*out, strict=True)) or [()] * 4, (pa.int64(), pa.binary(), pa.binary(), pa.binary()), strict=True)], ["chunk", "owners", "n_best", "count_sum"])

    return rows.mapInArrow(run, SCORES)


SUMS = "chunk long, place int, n_best long, count_sum long"


def summed(rows: DataFrame) -> DataFrame:
    """Sums by chunk and place of the document; a chunk's rows stand together."""

    def run(batches):
        now, sums = None, np.zeros((2, 0), np.int64)

        def flushed():
            place = np.arange(sums.shape[1], dtype=np.int32)
            return pa.RecordBatch.from_arrays([pa.array(np.full(len(place), now)), pa.array(place), pa.array(sums[0]), pa.array(sums[1])], ["chunk", "place", "n_best", "count_sum"])

        for batch in batches:
            for chunk, owners, best, counts in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if chunk != now:
                    if now is not None:
                        yield flushed()
                    now, sums = chunk, np.zeros((2, 0), np.int64)
                owners = np.frombuffer(owners, "<u2")
                if len(owners) and owners[-1] >= sums.shape[1]:
                    sums = np.concatenate([sums, np.zeros((2, int(owners[-1]) + 1 - sums.shape[1]), np.int64)], axis=1)
                np.add.at(sums[0], owners, np.frombuffer(best, "<i8"))
                np.add.at(sums[1], owners, np.frombuffer(counts, "<i8"))
        if now is not None:
            yield flushed()

    return rows.mapInArrow(run, SUMS)


def align(spark: SparkSession, docs: DataFrame, a_path: str, b_path: str, pattern: str) -> DataFrame:
    """One row for each row of ``docs`` (doc_id, text; others are ignored):
    ``doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256``.

    n_a and n_b are the tokens of a blank and the text by either tokenizer, special tokens read as plain text; n_groups
    the runs between common ends; n_links the overlapping pairs of tokens; n_best those of them that are linked in as
    many documents as any pair of their A id; count_sum the documents of their pairs, summed over links. The hash is
    of the groups' ids. Texts that are null or empty, or that either tokenizer doesn't spell byte for byte, have no
    tokens: zeros and an empty hash. Rows are documents of their own, so repeated rows count each and a null doc_id
    is returned as such; an empty table gives no rows.
    """
    scratch = Scratch(spark, "alignment")
    rows = scratch.put(linked(docs, a_path, b_path, pattern), "links")
    documents_, links = rows.where("kind = -1").select("chunk", "place", *DOC), rows.where("kind >= 0")
    n_a, n_b = vocabulary_sizes(a_path, b_path, pattern)
    # summed where they lie, then by stripe
    near = links.select("kind", "pairs", F.col("docs").alias("counts")).sortWithinPartitions("kind")
    part = stripe_counts(near, n_a, n_b, 0).select("kind", "pairs", "counts").repartition("kind").sortWithinPartitions("kind")
    counts = scratch.put(stripe_counts(part, n_a, n_b, 1), "counts")
    shares = scratch.put(links.groupBy("kind").agg(F.ceil(F.sum("size") / SHARE).cast("int").alias("shares")), "shares")
    # a row for each stripe: a size that the vocabulary fixes
    to = F.broadcast(shares)
    copies = counts.join(to, "kind").select("kind", F.explode(F.sequence(F.lit(0), F.col("shares") - 1)).alias("share"), F.lit(-1).cast("long").alias("chunk"), "pairs", "counts", "best", *(F.lit(None).cast("binary").alias(c) for c in ("owners", "which", "times")))
    dealt = links.join(to, "kind").select("kind", F.pmod(F.xxhash64("chunk"), F.col("shares")).cast("int").alias("share"), "chunk", "pairs", *(F.lit(None).cast("binary").alias(c) for c in ("counts", "best")), "owners", "which", "times")
    beside = copies.unionByName(dealt).repartition("kind", "share").sortWithinPartitions("kind", "share", "chunk")
    scores = scored(beside.select("chunk", "pairs", "counts", "best", "owners", "which", "times"), n_a, n_b)
    sums = summed(scores.repartition("chunk").sortWithinPartitions("chunk"))
    score = [F.coalesce(c, F.lit(0)).alias(c) for c in ("n_best", "count_sum")]
    return documents_.join(sums, ["chunk", "place"], "left").select(*DOC[:-1], *score, "groups_sha256")


def vocabulary_sizes(a_path: str, b_path: str, pattern: str) -> tuple[int, int]:
    return Tokenizer.from_file(a_path).get_vocab_size(with_added_tokens=True), sentencepiece.SentencePieceProcessor(model_file=b_path).get_piece_size()
