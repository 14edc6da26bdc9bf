"""Best-fit packing: ids as the tokenizer library gives them, pieces without gaps, few sequences."""

from __future__ import annotations

import random
import zlib

import numpy as np
import public_tokenizers as P
from tokenizers import Tokenizer

from tallyframe.llm import best_fit, queries

SF = "/root/testdata/sf0.001"
PATH = P.path("word_bpe_49k.json")
POOL = [*"abcsS'tTrReEvVlLmMdD 01  \n\t.,!?-\"ÄÉß", "<|endoftext|>", "<|startoftext|>", "́", "İ", "Σ", "ſ", "K", "日本", "ก็", "가", "가", "\xa0", " ", "½", "Ⅷ", "😀", "\x00", "\x1c", "\x85", "’", "ǅ", "ﬁ"]


def library(texts):
    encoded = Tokenizer.from_file(PATH).encode_batch([t or "" for t in texts], add_special_tokens=False)
    return [e.ids for e in encoded]


def ours(texts):
    out = []
    for _, ids, bounds in best_fit.encoder(PATH).batch(texts):
        out += [ids[a:b].tolist() for a, b in zip(bounds, bounds[1:], strict=False)]
    return out


def test_ids_of_random_texts_are_the_librarys():
    rnd = random.Random(3)
    texts = ["".join(rnd.choice(POOL) if rnd.random() < 0.97 else chr(rnd.choice([rnd.randint(0, 0xD7FF), rnd.randint(0xE000, 0x10FFFF)])) for _ in range(rnd.randint(0, 40))) for _ in range(4000)]
    assert ours(texts) == library(texts)


def test_ids_of_every_point_are_the_librarys():
    texts = [f"a{chr(c)}b '{chr(c)} {chr(c)}{chr(c)}1{chr(c)}" for c in range(0x3000) if c not in range(0xD800, 0xE000)]
    assert ours(texts) == library(texts)


def test_long_texts_are_encoded_in_parts():
    rnd = random.Random(4)
    text = " ".join("".join(rnd.choice("abcdeé'.S") for _ in range(rnd.randint(1, 9))) for _ in range(150_000))
    assert ours(["x", text, None, "y"]) == library(["x", text, None, "y"])


def slow(sizes, capacity):
    """The same rule, from the definition."""
    least, gaps, out = -(-sum(sizes) // capacity), [], []
    for s in sizes:
        options = []
        for g in sorted({x for x in gaps if x >= s}):
            after = [*gaps]
            after.remove(g)
            options.append((squares([*after, g - s]), g))
        fresh = squares([*gaps, capacity - s])
        fits = min(options, default=None)
        if fits and (fits[0] <= fresh or len(gaps) >= least):
            gaps.remove(fits[1])
            gaps.append(fits[1] - s)
        else:
            gaps.append(capacity - s)
        out.append(sorted(gaps))
    return out[-1]


def squares(gaps):
    return sum(gaps.count(g) ** 2 for g in set(gaps) if g)


def test_each_item_goes_where_the_squares_become_smallest():
    rnd = random.Random(5)
    for _ in range(60):
        capacity = rnd.choice([5, 12, 40])
        sizes = [rnd.randint(1, capacity) for _ in range(rnd.randint(1, 60))]
        where, offset = best_fit.sum_of_squares(np.array(sizes), capacity)
        filled = np.bincount(where, sizes).astype(int)
        assert sorted(capacity - filled) == slow(sizes, capacity)
        for w in range(where.max() + 1):
            spans = sorted((int(o), s) for o, s, x in zip(offset, sizes, where, strict=True) if x == w)
            assert [o for o, _ in spans] == np.cumsum([0, *[s for _, s in spans]])[:-1].tolist()


def checked(rows, texts, capacity):
    """Each document's pieces hold its ids; sequences have no gaps and stay within the capacity."""
    want = [[*ids, 1] for ids in library([t for _, t in texts])]
    cut = sorted((d if d is not None else -1, k, a, min(capacity, len(ids) - a), zlib.crc32(np.array(ids[a : a + capacity], "<u4").tobytes())) for (d, _), ids in zip(texts, want, strict=True) for k, a in enumerate(range(0, len(ids), capacity)))
    assert sorted((r.doc_id if r.doc_id is not None else -1, r.piece, r.start, r.length, r.ids_crc32) for r in rows) == cut
    held = {}
    for r in rows:
        held.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for spans in held.values():
        spans.sort()
        assert [o for o, _ in spans] == np.cumsum([0, *[n for _, n in spans]])[:-1].tolist()
        assert sum(n for _, n in spans) <= capacity
    return len(held), sum(map(len, want))


def test_the_query_packs_all_documents(spark):
    texts = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    n, tokens = checked(queries.op11_best_fit(spark, SF).collect(), texts, 4096)
    assert n <= -(-tokens // 4096) * 1.02 + 1


def test_odd_rows(spark, monkeypatch):
    monkeypatch.setattr(best_fit, "GROUP", 3)
    texts = [(1, None), (2, ""), (3, " \n\t"), (3, "twice"), (3, "twice"), (None, "no id"), (5, "word " * 300), (6, "x" * 2000), (7, "a b c d e f"), (8, "a <|endoftext|> b")]
    docs = spark.createDataFrame([(i, t, 1, "s") for i, t in texts], "doc_id long, text string, piece int, offset string")
    rows = best_fit.pack(spark, docs, PATH, 1, 7).collect()
    checked(rows, texts, 7)
    assert best_fit.pack(spark, docs.limit(0), PATH, 1, 7).count() == 0
