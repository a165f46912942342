"""Defined results for nulls, empty texts, ties, repeated rows and clashing columns; queries against plain loops."""

import os
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from terragrid.llm import decontam, lang, license, pii, quality, queries
from terragrid.llm.common import crc_mod

SF = "/root/testdata/sf0.001"
has_data = pytest.mark.skipif(not os.path.isdir(SF), reason="no tables")
CLASHES = "score double, entities string, own string, dir string, size int, piece int, pieces int, term string, w double, b string, from string, item_id long, n_item long"


def wide(spark, rows, schema):
    return spark.createDataFrame([(*r, *[None] * 13) for r in rows], f"{schema}, {CLASHES}")


@has_data
def test_quality_query_against_a_plain_loop(spark):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    model = quality.fit(docs, labels, crc_mod(F.col("doc_id"), 5) != 0)
    tokens, got = quality.Tokens(model.params), {r["doc_id"]: r for r in queries.op2_quality(spark, SF).collect()}
    for r in docs.collect():
        want = float(model.probability(quality.pooled(tokens.buckets(r["text"] or ""), model.vectors)[None])[0])
        g = got[r["doc_id"]]
        assert g["score"] == pytest.approx(want, abs=1e-6) and g["predicted"] == int(g["score"] >= 0.3)
        assert g["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0)


@has_data
def test_language_query_against_a_plain_loop(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    model = lang.fit(docs, crc_mod(docs["doc_id"], 4) != 2)
    got = {r["doc_id"]: r for r in queries.op9_language(spark, SF).collect()}
    for r in docs.collect():
        g, text = got[r["doc_id"]], r["text"] or ""
        assert g["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2)
        if not any(c.isalpha() for c in text):
            assert (g["lang_pred"], g["score"]) == ("und", 0.0)
            continue
        n = lang.bag(text, model.params)
        y = model.probabilities(n @ model.folded / n.sum() + model.bias, int(n.sum()))
        assert g["lang_pred"] == model.langs[int(y[:-1].argmax())] and g["score"] == pytest.approx(float(y[:-1].max()), abs=1e-6)


def test_quality_of_nothing(spark):
    rows = [(1, "", 0), (2, None, 0), (3, "good words here", 1), (3, "good words here", 1), (None, "good words here", 1), (4, "bad", 0)]
    docs = wide(spark, [r[:2] for r in rows], "doc_id long, text string")
    model = quality.fit(docs, spark.createDataFrame([(r[0], r[2]) for r in rows], "doc_id long, quality int"), F.lit(True))
    got = quality.score(docs, model).collect()
    of = lambda i: {r["score"] for r in got if r["doc_id"] == i}
    assert len(got) == 6 and of(1) == of(2) and len(of(3)) == 1 and of(None) == of(3) and all(0 <= r["score"] <= 1 for r in got)
    assert quality.fit(docs, spark.createDataFrame([], "doc_id long, quality int"), F.lit(True)).probability(np.zeros((1, 145)))[0] == 0.5


def test_surrogates_of_nothing(spark):
    docs = wide(spark, [(1, ""), (2, None), (3, "to a@b.org"), (3, "to a@b.org"), (None, "to a@b.org"), (4, "to A@B.ORG " + "x " * 50_000)], "doc_id long, text string")
    got = pii.surrogates(docs, b"0123456789abcdef").collect()
    by = lambda i: [(r["text"], len(r["entities"])) for r in got if r["doc_id"] == i]
    assert by(1) == by(2) == [("", 0)] and len(by(3)) == 2 and by(3)[0] == by(3)[1] == by(None)[0]
    assert by(4)[0][0].lower().startswith(by(3)[0][0].lower()) and by(4)[0][0].endswith("x " * 50_000)


@pytest.mark.parametrize("hot", [100_000, 1])
def test_licences_of_ties_and_nulls(spark, hot):
    mit, gpl = "Released under the MIT License.", "This work is licensed under the GNU General Public License, version 3."
    rows = [(1, "LICENSE", mit), (2, "COPYING", gpl), (3, "a.py", None), (4, "a.py", "x"), (4, "a.py", "x"), (5, None, mit), (6, None, None), (7, "d/x.py", gpl), (7, "d/x.py", mit), (None, "b.py", ""), (8, "e/f/g.py", "")]
    old, license.HOT_ROWS = license.HOT_ROWS, hot
    try:
        got = sorted(((r["file_id"], r["stated"], r["licence"], r["inherited_from"]) for r in license.scan(wide(spark, rows, "file_id long, path string, text string")).collect()), key=str)
    finally:
        license.HOT_ROWS = old
    # two licence files of one directory, both of score 1: the one that is first by path
    want = [(1, "MIT", "MIT", None), (2, "GPL-3.0", "GPL-3.0", None), *[(k, None, "GPL-3.0", "") for k in (3, 4, 4, None, 8)], (5, None, None, None), (6, None, None, None), *[(7, "MIT", "MIT", None)] * 2]
    assert got == sorted(want, key=str)
    assert license.scan(wide(spark, [], "file_id long, path string, text string")).count() == 0


def test_leaks_with_nulls_and_repeats(spark):
    passage = "one two three four five six seven eight nine ten"
    docs = wide(spark, [(1, "before " + passage.upper() + " after"), (1, "before " + passage.upper() + " after"), (2, None), (3, ""), (None, passage), (4, "one two three"), (5, "w " * 100_000 + passage)], "doc_id long, text string")
    items = spark.createDataFrame([(7, passage), (7, passage), (8, None), (9, ""), (None, passage), (10, "two three")], "item_id long, text string")
    got = sorted(((r["doc_id"], r["item_id"], r["n_found"], r["n_item"]) for r in decontam.contained_items(docs, items).collect()), key=str)
    want = [*[(k, 7, 6, 6) for k in (1, 1, None, 5)], *[(k, 10, 1, 1) for k in (1, 1, None, 4, 5)]]
    assert got == sorted(want, key=str)
    assert sorted(r["doc_id"] for r in decontam.clean(docs, items).collect()) == [2, 3]


def test_stages_decide_as_they_say(spark, tmp_path):
    line = "A line of more than twenty letters"
    rows = [(1, line + "\nfirst of them with words of its own"), (2, line + "\nsecond of them with other words"), (3, line), (4, line + "\nfourth of them and more"), (5, ""), (6, None), (None, line), (7, "a copy of some words that is long enough to be one"), (8, "a copy of some words that is long enough to be one"), (8, "a copy of some words that is long enough to be one")]
    docs = wide(spark, rows, "doc_id long, text string")
    after = {r["doc_id"]: r["text"] for r in corpus_pipeline.fresh_lines(spark, docs, "").collect() if r["doc_id"] is not None}
    assert after[1] == "first of them with words of its own" and 3 not in after and after[4] == rows[3][1] and after[5] == "" and after[6] is None
    kept = corpus_pipeline.distinct(spark, docs, "")
    assert kept.columns == docs.columns and sorted(r["doc_id"] or 0 for r in kept.collect()) == [0, 1, 2, 3, 4, 5, 6, 7]
    spark.createDataFrame([(1, "words that is long enough to be one")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert {r["doc_id"] for r in corpus_pipeline.clean(spark, docs, str(tmp_path)).collect()} == {1, 2, 3, 4, 5, 6, None}
    coded = {r["doc_id"]: r for r in corpus_pipeline.coded(spark, docs, "").collect()}
    assert coded[5]["n_tokens"] == coded[6]["n_tokens"] == 0 and coded[6]["decoded"] == "" and coded[7]["n_tokens"] == len(coded[7]["ids"]) > 0
