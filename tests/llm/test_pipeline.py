"""The corpus pipeline stage by stage, and the driver's registration."""

from __future__ import annotations

import public_tokenizers as P
from test_operators import TOKENIZER, brute_near, brute_repeats, check_packing, library_ids, texts

import corpus_pipeline

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns = docs.columns
    stage = dict(corpus_pipeline.STAGES)
    told = stage["language"](spark, docs, SF).cache()
    assert told.columns == columns and told.count() >= 0.97 * docs.count()
    _, component = brute_near(texts(told), 80)
    single = stage["near-duplicates"](spark, told, SF).cache()
    assert single.columns == columns
    assert sorted(r.doc_id for r in single.collect()) == sorted(i for i, c in component.items() if i == c)
    before = texts(single)
    want = brute_repeats(before.items(), 35)
    cut = stage["repeated-passages"](spark, single, SF).cache()
    assert texts(cut) == {i: w[2] if w[1] else before[i] for i, w in want.items()}
    assert all(r.n_chars == len(r.text) for r in cut.collect())
    masked = stage["personal-data"](spark, cut, SF).cache()
    assert masked.columns == columns and masked.count() == cut.count()
    rows = stage["packing"](spark, masked, SF).collect()
    kept = texts(masked)
    ids = {k: [*x, 0] for k, x in zip(kept, library_ids(kept.values(), True), strict=True)}
    assert check_packing(rows, ids, 1024) > 0.95
    assert corpus_pipeline.run(spark, SF).count() == len(rows)
    assert TOKENIZER == P.path("byte_bpe_50k.json")


def test_stages_of_odd_tables(spark):
    schema = "doc_id long, text string, lang string, source string, n_chars long, score string, id int, n_words int"
    rows = [(1, None, None, None, None, None, None, None), (2, "", "en", "s", 0, "x", 1, 2), (3, "some words", "en", "s", 10, "x", 1, 2), (3, "some words", "en", "s", 10, "x", 1, 2), (None, "more words", "en", None, 10, None, None, None)]
    for table in (spark.createDataFrame(rows, schema), spark.createDataFrame([], schema)):
        for name, f in corpus_pipeline.STAGES[:-1]:
            table = f(spark, table, SF)
            assert table.columns == [c.split()[0] for c in schema.split(", ")], name
        rows_left = table.collect()
        packed = dict(corpus_pipeline.STAGES)["packing"](spark, table, SF).collect()
        assert sum(r.start == 0 for r in packed) == len(rows_left) and sum(r.length for r in packed) == sum(len(x) + 1 for x in library_ids([r.text for r in rows_left], True))


def test_registered():
    import __spark_entry__ as entry

    names = entry.queries()
    assert "pipeline" in names and all(any(n.startswith(f"op{i}_") for n in names) for i in range(1, 11))
