"""Alignment of tokenizers against plain loops over the libraries' tokens."""

from __future__ import annotations

import hashlib
import random
from collections import Counter, defaultdict

import public_tokenizers as P
import pytest
import sentencepiece
from tokenizers import Tokenizer

from tallyframe.llm import alignment, queries
from tallyframe.llm.pretokens import byte_characters

SF = "/root/testdata/sf0.001"
A, B = P.path("byte_bpe_50k.json"), P.path("piece_bpe_32k.model")
ODD = [None, "", " ", "   \n\t ", "one", "two words", "ÄÖ é 日本語 😀", "a▁b", "<0x41> <s> </s> <unk>", "x <|endoftext|> y", "a\x00b", "  lead", "trail  ", "a  b   c", "é́ﬁ½", "  \xa0 ", "ab" * 900, "the cat. " * 200, "\n\nx\r\n"]


@pytest.fixture(scope="module")
def tokenizers():
    t = Tokenizer.from_file(A)
    t.encode_special_tokens = True
    return t, sentencepiece.SentencePieceProcessor(model_file=B)


def tokens(tokenizers, text):
    """(id, bytes) of either side."""
    t, sp = tokenizers
    back = {c: i for i, c in enumerate(byte_characters())}
    a = [(i, bytes(back[c] for c in t.id_to_token(i))) for i in t.encode(" " + text, add_special_tokens=False).ids]
    b = [(i, bytes([int(sp.id_to_piece(i)[3:5], 16)]) if sp.is_byte(i) else sp.id_to_piece(i).replace("▁", " ").encode()) for i in sp.encode(text)]
    return a, b


def expected(tokenizers, rows):
    held, docs = [], defaultdict(int)
    for doc, text in rows:
        a, b = tokens(tokenizers, text) if text else ([], [])
        want = (" " + text).encode() if text else b""
        if b"".join(x for _, x in a) != want or b"".join(x for _, x in b) != want:
            a, b = [], []
        spans = []
        for side in (a, b):
            at, out = 0, []
            for i, x in side:
                out.append((at, at + len(x), i))
                at += len(x)
            spans.append(out)
        common = {e for _, e, _ in spans[0]} & {e for _, e, _ in spans[1]}
        groups, last = [], 0
        for cut in sorted(common):
            groups.append("|".join(",".join(str(i) for s, e, i in side if last <= s and e <= cut) for side in spans))
            last = cut
        links = Counter((i, j) for s, e, i in spans[0] for t, f, j in spans[1] if s < f and t < e)
        for pair in links:
            docs[pair] += 1
        held.append((doc, len(a), len(b), len(groups), links, hashlib.sha256(";".join(groups).encode()).hexdigest() if groups else ""))
    top = defaultdict(int)
    for (i, _), n in docs.items():
        top[i] = max(top[i], n)
    return Counter((doc, a, b, g, sum(links.values()), sum(n for p, n in links.items() if docs[p] == top[p[0]]), sum(n * docs[p] for p, n in links.items()), digest) for doc, a, b, g, links, digest in held)


def rows_of(df):
    return Counter((r.doc_id, r.n_a, r.n_b, r.n_groups, r.n_links, r.n_best, r.count_sum, r.groups_sha256) for r in df.collect())


def test_the_query_aligns_all_documents(spark, tokenizers):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    short = [(d, t if t is None else t[:3000]) for d, t in rows]
    df = spark.createDataFrame(short, "doc_id long, text string")
    assert rows_of(alignment.align(spark, df, A, B, P.PATTERN)) == expected(tokenizers, short)
    whole = {r.doc_id: (r.n_a, r.n_b) for r in queries.op13_alignment(spark, SF).select("doc_id", "n_a", "n_b").collect()}
    assert whole == {d: tuple(map(len, tokens(tokenizers, t))) if t else (0, 0) for d, t in rows}


def test_odd_rows(spark, tokenizers, monkeypatch):
    monkeypatch.setattr(alignment, "CHUNK_CHARS", 300)
    monkeypatch.setattr(alignment, "SHARE", 64)
    rnd = random.Random(7)
    pool = [*"aabbcde  \n.,'1é日", "the", " of", "▁", "<0x41>", "😀", "\x00"]
    rows = [*enumerate(ODD), (3, "one"), (3, "one"), (None, "no id"), *((100 + i, "".join(rnd.choice(pool) for _ in range(rnd.randint(0, 60)))) for i in range(150))]
    df = spark.createDataFrame([(d, t, 1, "x") for d, t in rows], "doc_id long, text string, place int, pairs string")
    assert rows_of(alignment.align(spark, df, A, B, P.PATTERN)) == expected(tokenizers, rows)
    assert alignment.align(spark, df.limit(0), A, B, P.PATTERN).count() == 0


def test_long_texts_are_aligned_in_parts(spark, tokenizers, monkeypatch):
    monkeypatch.setattr(alignment, "CHUNK", 50)
    monkeypatch.setattr("tallyframe.llm.pretokens.CHUNK", 50)
    rnd = random.Random(8)
    rows = [(i, " ".join("".join(rnd.choice("abcé'.") for _ in range(rnd.randint(0, 7))) for _ in range(150)) + ("▁" if i == 2 else "")) for i in range(4)]
    rows = rows + [(9, "same words " * 60)]
    x = alignment.Aligner(A, B, P.PATTERN)
    batches = list(alignment.found(x, [d for d, _ in rows], [t for _, t in rows], 0))
    docs = batches[0].to_pylist()
    want = {w[0]: w for w in expected(tokenizers, rows)}
    assert {d["doc_id"]: (d["n_a"], d["n_b"], d["n_groups"], d["n_links"], d["groups_sha256"]) for d in docs} == {i: (*w[1:5], w[7]) for i, w in want.items()}
