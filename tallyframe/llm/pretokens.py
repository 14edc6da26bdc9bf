"""Byte-level BPE over a cache of pre-tokens: texts are split by a pattern and each distinct match is encoded once.

The widespread pattern ``PATTERN`` is split by array operations over the code points of many texts at once; other
patterns go through the regex engine. Matches are known by 64-bit hashes, and the encoder, which the caller brings,
gets the ones that are not in the cache as one list.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import regex

from .words import BASE, BASE_INVERSE, U64, Powers, mix

#: Entries and ids that the cache holds before it starts anew, bits of its slots, and code points that are split at once.
ENTRIES, MOST_IDS, SLOT_BITS, CHUNK = 600_000, 3_000_000, 21, 1 << 18
# Fixed value: the pattern that the array splitter knows, with its contractions by first letter.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
SINGLE, DOUBLE = "stmd", {"r": "e", "v": "e", "l": "l"}
OTHER, LETTER, NUMBER, SPACE = 0, 1, 2, 3
POINTS = 0x110000
EDGE = regex.compile(r"(?<=\S) (?=\S)")
POWERS = Powers(BASE, BASE_INVERSE, CHUNK)


def character_classes() -> np.ndarray:
    """The class of every code point, as the regex engine sees it."""
    out = np.full(POINTS, OTHER, np.uint8)
    every = "".join(map(chr, [*range(0xD800), *range(0xE000, POINTS)]))
    for kind, name in ((LETTER, r"\p{L}+"), (NUMBER, r"\p{N}+"), (SPACE, r"\s+")):
        for m in regex.finditer(name, every):
            a, b = ord(every[m.start()]), ord(every[m.end() - 1]) + 1
            out[a:b] = kind
    out[0xD800:0xE000] = OTHER
    return out


def match_starts(points: np.ndarray, bounds: np.ndarray, classes: np.ndarray) -> np.ndarray:
    """Where the matches of ``PATTERN`` start in the texts that stand between ``bounds``; matches leave no gaps."""
    n = len(points)
    kind = classes[points]
    start = np.ones(n + 1, bool)
    np.not_equal(kind[1:], kind[:-1], out=start[1:n])
    start[bounds] = True
    opens = np.zeros(n + 1, bool)
    opens[bounds] = True
    # the last of a run of white space before a match: a blank goes with the match, another character stands alone
    edge = np.flatnonzero((kind[:-1] == SPACE) & (kind[1:] != SPACE))
    edge = edge[~opens[edge + 1]]
    start[edge] = True
    start[edge[points[edge] == 32] + 1] = False
    at = np.flatnonzero((points == 39) & start[:n])
    at = at[~opens[at + 1]]
    if len(at):
        after, third = points[at + 1], points[np.minimum(at + 2, n - 1)]
        size = np.where(np.isin(after, [ord(c) for c in SINGLE]), 2, 0)
        for c, d in DOUBLE.items():
            size[~opens[at + 2 - (at + 2 > n)] & (after == ord(c)) & (third == ord(d))] = 3
        at, size = at[size > 0], size[size > 0]
        start[at + 1] = False
        start[at[size == 3] + 2] = False
        start[at + size] = True
    return np.flatnonzero(start[:n])


class PretokenCache:
    """Ids of whole texts, from an encoder of lists of matches."""

    def __init__(self, pattern: str, encode: Callable[[list[str]], list[list[int]]]) -> None:
        self.pattern, self.encode = pattern, encode
        self.fast = pattern == PATTERN
        if self.fast:
            self.classes = character_classes()
            self.table = mix(np.arange(1, POINTS + 1, dtype=U64)) | U64(1)
        else:
            self.split = regex.compile(pattern).findall
        self.clear()

    def clear(self) -> None:
        self.slots, self.count, self.used = np.full(1 << SLOT_BITS, -1, np.int32), 0, 0
        self.hashes, self.first, self.size, self.flat = np.zeros(1024, U64), np.zeros(1024, np.int32), np.zeros(1024, np.int32), np.zeros(4096, np.uint32)

    def find(self, hashes: np.ndarray) -> np.ndarray:
        """The place of each hash, -1 where the cache doesn't hold it: slots are probed one after the other."""
        slot = (hashes >> U64(64 - SLOT_BITS)).astype(np.int64)
        place = self.slots[slot].astype(np.int64)
        rest = np.flatnonzero((place >= 0) & (self.hashes[place] != hashes))
        while len(rest):
            slot[rest] = (slot[rest] + 1) & ((1 << SLOT_BITS) - 1)
            place[rest] = self.slots[slot[rest]]
            rest = rest[(place[rest] >= 0) & (self.hashes[place[rest]] != hashes[rest])]
        return place

    def learn(self, hashes: np.ndarray, matches: list[str]) -> None:
        """Encodes matches that the cache doesn't hold, each of a hash of its own."""
        found = self.encode(matches)
        sizes = np.fromiter(map(len, found), np.int64, len(found))
        more, n = int(sizes.sum()), len(hashes)
        self.hashes, self.first, self.size = (grown(x, self.count + n) for x in (self.hashes, self.first, self.size))
        self.flat = grown(self.flat, self.used + more)
        self.flat[self.used : self.used + more] = np.fromiter((i for ids in found for i in ids), np.uint32, more)
        mine = slice(self.count, self.count + n)
        self.hashes[mine], self.first[mine], self.size[mine] = hashes, self.used + np.cumsum(sizes) - sizes, sizes
        slot, place = (hashes >> U64(64 - SLOT_BITS)).astype(np.int64), np.arange(self.count, self.count + n)
        while len(place):  # one taker for each free slot, the rest go on
            free = self.slots[slot] < 0
            self.slots[slot[free]] = place[free]
            rest = self.slots[slot] != place
            slot, place = (slot[rest] + 1) & ((1 << SLOT_BITS) - 1), place[rest]
        self.used, self.count = self.used + more, self.count + n

    def joined(self, place: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids at a sequence of places of the cache, and where each place's ids start (one more at the end)."""
        sizes = self.size[place]
        ends = np.cumsum(sizes, dtype=np.int64)
        at = np.arange(int(ends[-1]) if len(ends) else 0) + np.repeat(self.first[place] - (ends - sizes), sizes)
        return self.flat[at], np.r_[0, ends]

    def chunk(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        if self.count > ENTRIES or self.used > MOST_IDS:
            self.clear()
        if not self.fast:
            found = [self.encode(self.split(t)) for t in texts]
            sizes = [sum(map(len, ids)) for ids in found]
            return np.fromiter((i for ids in found for x in ids for i in x), np.uint32, sum(sizes)), np.cumsum([0, *sizes])
        text = "".join(texts)
        bounds = np.cumsum([0, *map(len, texts)])
        points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
        starts = match_starts(points, bounds, self.classes)
        up, down = POWERS.get(len(points) + 1)
        total = np.zeros(len(points) + 1, U64)
        np.cumsum(self.table[points] * up[: len(points)], out=total[1:])
        ends = np.r_[starts[1:], len(points)]
        hashes = mix((total[ends] - total[starts]) * down[starts])
        place = self.find(hashes)
        missing = np.flatnonzero(place < 0)
        if len(missing):
            new, example, which = np.unique(hashes[missing], return_index=True, return_inverse=True)
            of = missing[example]
            place[missing] = self.count + which
            self.learn(new, [text[a:b] for a, b in zip(starts[of].tolist(), ends[of].tolist(), strict=True)])
        ids, at = self.joined(place)
        return ids, at[np.searchsorted(starts, bounds)]

    def batch(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the texts, and the bounds of each text's; null texts have none."""
        parts = [pieces_of(t) if self.fast and t and len(t) > 2 * CHUNK else [t or ""] for t in texts]
        ids, sizes = [np.zeros(0, np.uint32)], [np.zeros(0, np.int64)]
        for run in chunks([p for part in parts for p in part]):
            found, bounds = self.chunk(run)
            ids.append(found)
            sizes.append(np.diff(bounds))
        ends = np.cumsum(np.r_[0, np.concatenate(sizes)])
        return np.concatenate(ids), ends[np.cumsum([0, *map(len, parts)])]


def pieces_of(text: str) -> list[str]:
    """A long text cut before blanks between two other characters, where a match of ``PATTERN`` always starts."""
    out, at = [], 0
    while len(text) - at > CHUNK and (m := EDGE.search(text, at + CHUNK)):
        out.append(text[at : m.start()])
        at = m.start()
    return [*out, text[at:]]


def grown(x: np.ndarray, n: int) -> np.ndarray:
    """An array of at least ``n`` values that starts with those of ``x``."""
    return x if n <= len(x) else np.concatenate([x, np.zeros(max(n, 2 * len(x)) - len(x), x.dtype)])


def chunks(texts: list[str]) -> Iterator[list[str]]:
    """Runs of whole texts of about ``CHUNK`` code points."""
    first = size = 0
    for i, t in enumerate(texts):
        if i > first and size + len(t) > CHUNK:
            yield texts[first:i]
            first, size = i, 0
        size += len(t)
    if first < len(texts):
        yield texts[first:]


def id_lists(ids: np.ndarray, bounds: np.ndarray) -> pa.Array:
    """Ids as a list<int> column."""
    return pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.array(ids.view(np.int32)))


#: Bytes that byte-level vocabularies write as themselves; the others follow from code point 256 on.
PLAIN = [*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)]


def byte_characters() -> list[str]:
    """The printable character that stands for each byte."""
    rest = (b for b in range(256) if b not in set(PLAIN))
    places = {b: b for b in PLAIN} | {b: 256 + i for i, b in enumerate(rest)}
    return [chr(places[b]) for b in range(256)]


SPELLED = dict(enumerate(byte_characters()))


def spelled(match: str) -> str:
    """The printable characters that stand for a match's bytes."""
    return match.encode("utf-8").decode("latin-1").translate(SPELLED)
