"""The pipeline's stages on the smallest tables."""

from __future__ import annotations

import corpus_pipeline as P

from lexloom.llm import core

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = core.documents(spark, SF)
    columns = docs.columns
    counts = [docs.count()]
    for name, stage in P.STAGES[:-1]:
        before = {r.doc_id: r.text for r in docs.select("doc_id", "text").collect()}
        docs = core.stored(stage(spark, docs, SF))
        assert docs.columns == columns and {r.doc_id for r in docs.collect()} <= set(before)
        counts.append(docs.count())
        if name == "near_copies":
            assert docs.select("doc_id").distinct().count() == counts[-1]
    assert counts[1] == counts[0] > counts[2] >= counts[3]
    packed = P.sequences(spark, docs, SF)
    assert packed.agg({"length": "sum"}).first()[0] > 0


def test_copies_and_empty_texts(spark):
    rows = [(1, None, None, "s", 0), (2, "12 34", "x", "s", 0)] + [(i, f"kolom tirka velom {'dorka ' * (i % 5 + 3)}{i}", "x", None, 0) for i in range(3, 40)] + [(40, "kolom tirka velom dorka dorka dorka 5", "x", "s", 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    kept = core.stored(P.language(spark, docs, SF))
    assert {1, 2}.isdisjoint(r.doc_id for r in kept.collect()) and kept.count() == 38
    assert P.near_copies(spark, kept, SF).count() == 38 - 1


def test_different_texts_without_ids_stay(spark):
    words = [f"{x}{y}" for x in "abcdefgh" for y in ("ra", "ti", "kon", "lum")]
    texts = [" ".join(f"{w}{i * k % 31}" for k, w in enumerate(words)) for i in range(1, 25)]
    rows = [(None if i < 16 else 5, t, "x", "s", 0) for i, t in enumerate([*texts, texts[0] + " end", texts[3]])]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    kept = core.stored(P.near_copies(spark, docs, SF))
    assert sorted(r.text for r in kept.collect()) == sorted(texts)
    mixed = [r.text for r in P.mixture(spark, kept, SF).collect()]
    assert all(mixed.count(t) <= 2 for t in texts) and len(texts) < len(mixed) <= 1.6 * len(texts)
