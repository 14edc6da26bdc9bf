"""The registered queries held against their contracts, through the registry: SQL, the libraries, or brute force."""

from __future__ import annotations

import base64
import hashlib
import math
import re
import zlib

import numpy as np
import pyarrow as pa
import public_tokenizers as P
import pytest
from compare import connect, differences

import __spark_entry__ as entry
from tallyframe.llm import language_id, toxicity

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.fixture(scope="module")
def texts(con):
    return dict(con.sql("SELECT doc_id, text FROM documents").fetchall())


def rows(spark, name):
    return entry.queries()[name](spark, SF).collect()


def crc(i, n):
    return zlib.crc32(str(i).encode()) % n


@pytest.mark.parametrize("name", ["op1_near_dedup", "op3_embedding_dedup", "op9_substring_dedup"])
def test_equals_its_twin(spark, con, name):
    assert differences(spark, con, entry.queries()[name], entry.oracle_sql()[name], SF) == ""


def test_op2(spark, con, texts):
    langs = {x for (x,) in con.sql("SELECT DISTINCT lang FROM documents WHERE lang IS NOT NULL").fetchall()}
    got = rows(spark, "op2_language_id")
    assert sorted(r.doc_id for r in got) == sorted(texts)
    for r in got:
        assert r.held_out == (crc(r.doc_id, 3) == 1) and 0 <= r.score <= 1
        assert (r.lang_pred == "und") == (not any(map(str.isalpha, texts[r.doc_id] or ""))) and r.lang_pred in langs | {"und"}


def grams(text):
    letters = "".join(c if c.isalpha() else " " for c in text.lower())
    return {letters[i : i + n] for n in range(1, 5) for i in range(len(letters) - n + 1)}


@pytest.mark.parametrize("bits", [20, 6])
def test_op2_equals_plain_kernels(con, monkeypatch, bits):
    """Presence kernels over sets of grams, the Nyström map and one-versus-rest ridge regression, written out."""
    monkeypatch.setattr(language_id, "SLOT_BITS", bits)  # few slots: most grams share one
    table = [(t, x) for t, x in con.sql("SELECT text, lang FROM documents WHERE text IS NOT NULL AND lang IS NOT NULL AND length(text) < 4000 ORDER BY doc_id").fetchall() if any(map(str.isalpha, t))]
    model = language_id.Model(table[:80], 12, 0.05)
    learned = sorted(table[:80])
    sets, langs = [grams(t) for t, _ in learned], sorted({x for _, x in learned})
    label = np.array([langs.index(x) for _, x in learned])
    rng = np.random.default_rng(2)
    chosen = np.concatenate([rng.permutation(np.flatnonzero(label == c))[: max(1, 12 // len(langs))] for c in range(len(langs))])
    known = set().union(*sets)
    assert model.width == len(known)

    def kernel(s):
        s = s & known
        return [len(s & sets[i]) / math.sqrt(max(1, len(s)) * len(sets[i])) for i in chosen]

    k = np.array([kernel(s) for s in sets])
    w, v = np.linalg.eigh(k[chosen])
    root = v[:, w > 1e-6 * w.max()] / np.sqrt(w[w > 1e-6 * w.max()])
    z = np.hstack([k @ root, np.ones((len(k), 1))])
    weight = (len(k) / np.bincount(label)[label] / len(langs))[:, None]
    beta = np.linalg.solve(z.T @ (z * weight) + 0.05 * np.eye(z.shape[1]), z.T @ (np.where(label[:, None] == np.arange(len(langs)), 1.0, -1.0) * weight))
    asked = [t for t, _ in table[80:]]
    margin = np.hstack([np.array([kernel(grams(t)) for t in asked]) @ root, np.ones((len(asked), 1))]) @ beta
    got, score = model.predict(asked, language_id.Grams())
    share = np.exp(language_id.SHARPNESS * (margin - margin.max(axis=1, keepdims=True)))
    assert got == [langs[i] for i in margin.argmax(axis=1)]
    assert np.abs(score - (share / share.sum(axis=1, keepdims=True)).max(axis=1)).max() < 1e-3


def test_op4(spark, texts):
    got = rows(spark, "op4_toxicity")
    assert sorted(r.doc_id for r in got) == sorted(texts)
    assert all(r.held_out == (crc(r.doc_id, 5) == 0) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in got)


def test_op4_equals_a_plain_forward_pass(con):
    """Each word's n-grams looked up one by one, windows averaged, the worst window through the logistic function."""
    table = con.sql("SELECT text, toxic FROM documents JOIN labels USING (doc_id) WHERE text IS NOT NULL AND toxic IS NOT NULL AND length(text) < 3000").fetchall()
    model = toxicity.Model(table, rounds=8)
    texts_ = [t for t, _ in table[:15]] + ["", "a", "Same same SAME word"]

    def bucket(codes):
        h = sum(int(toxicity.SEED_BYTES[c]) * int(toxicity.FACTORS[k]) for k, c in enumerate(codes)) + len(codes) - 1
        h &= (1 << 64) - 1
        for shift, by in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
            h = ((h ^ (h >> shift)) * by) & ((1 << 64) - 1)
        return (h ^ (h >> 31)) >> (64 - toxicity.BUCKET_BITS)

    want = []
    for t in texts_:
        words = list(dict.fromkeys(w.lower() for w in re.findall(rb"[^\x20\x09-\x0d]+", t.encode())))
        values = []
        for w in words:
            padded = b" " + w + b" "
            found = [bucket(padded[i : i + n]) for n in range(toxicity.LOW, toxicity.HIGH + 1) for i in range(len(padded) - n + 1)]
            values.append(sum(float(model.weights[b]) for b in found) / max(1, len(found)))
        windows = [sum(values[i : i + toxicity.WINDOW]) / toxicity.WINDOW for i in range(0, len(values), toxicity.WINDOW)]
        want.append(1 / (1 + math.exp(-(model.bias + (max(windows) if windows else 0)))))
    got = np.concatenate(list(model.scores(pa.array(texts_))))
    assert np.abs(got - want).max() < 1e-6


def test_op5(spark, texts):
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(P.path("byte_bpe_50k.tiktoken"), "rb"))}
    library = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    got = rows(spark, "op5_bpe")
    assert sorted(r.doc_id for r in got) == sorted(texts)
    for r in got:
        ids = library.encode_ordinary(texts[r.doc_id] or "")
        assert (r.n_tokens, r.ids_sha256) == (len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest())
        assert r.decoded_sha256 == hashlib.sha256((texts[r.doc_id] or "").encode()).hexdigest()


def test_op6(spark, texts):
    mail = re.compile(r"[A-Za-z0-9][A-Za-z0-9._%+-]*@[A-Za-z0-9.-]+\.[A-Za-z]{2,}")
    seen: dict[str, str] = {}
    for r in rows(spark, "op6_pseudonyms"):
        before = texts[r.doc_id]
        assert (r.text is None) == (before is None)
        if before is None:
            continue
        assert len(r.text.split()) == len(before.split()) and (r.n_private > 0) == (r.text != before)
        for a, b in zip(mail.findall(before), mail.findall(r.text), strict=True):
            assert a.split("@")[1] == b.split("@")[1] and seen.setdefault(a, b) == b
    assert len(set(seen.values())) == len(seen) > 0


def test_op7(spark, texts):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    pieces, sequences = {}, {}
    for r in rows(spark, "op7_packing"):
        pieces.setdefault(r.doc_id, []).append(r)
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
    assert set(pieces) == set(texts)
    for i, parts in pieces.items():
        ids, at = [*library.encode(texts[i] or "", add_special_tokens=False).ids, 0], 0
        for r in sorted(parts, key=lambda r: r.start):
            assert r.start == at and r.doc_tokens == len(ids) and r.ids_crc32 == zlib.crc32(np.array(ids[at : at + r.length], "<u4").tobytes())
            at += r.length
        assert at == len(ids)
    for parts in sequences.values():
        ends = np.cumsum([0, *[n for _, n in sorted(parts)]])
        assert [o for o, _ in sorted(parts)] == ends[:-1].tolist() and ends[-1] <= 1024


def test_op8(spark, con):
    table = con.sql("SELECT vec_id, embedding FROM embeddings ORDER BY vec_id").fetchall()
    ids, m = np.array([i for i, _ in table]), np.array([v for _, v in table], np.float64)
    got, hits, asked = {}, 0, ids[ids % 20 == 0]
    for r in rows(spark, "op8_nearest"):
        got.setdefault(r.query_id, []).append(r)
    assert sorted(got) == asked.tolist()
    for q in asked:
        score = m @ m[ids == q][0]
        best = [i for i in np.lexsort((ids, -score)) if ids[i] != q][:20]
        mine = sorted(got[q], key=lambda r: r["rank"])
        assert [r["rank"] for r in mine] == list(range(1, 21)) and all(abs(r.score - score[ids == r.vec_id][0]) < 1e-12 for r in mine)
        hits += len({ids[i] for i in best} & {r.vec_id for r in mine})
    assert hits >= 0.9 * 20 * len(asked)


def test_op10(spark, texts):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    library.encode_special_tokens = True
    assert {r.doc_id: r.n_tokens for r in rows(spark, "op10_token_counts")} == {i: len(library.encode(t or "", add_special_tokens=False).ids) for i, t in texts.items()}
