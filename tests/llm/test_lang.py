"""Language identification: n-grams against brute force, and what is rejected."""

import random
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from terragrid.llm import lang
from terragrid.llm.common import crc_mod

SYLLABLES = {
    "aa": "the ing tion er wh th sh ly ould ness st".split(),
    "bb": "der sch ung keit ein lich zu ge ver auf nd".split(),
    "cc": "eau oi que ment les aux é ré ou tion ç".split(),
}


def corpus(n=240, seed=4):
    rng = random.Random(seed)
    out = []
    for k in range(n):
        name = sorted(SYLLABLES)[k % 3]
        out.append((k, " ".join("".join(rng.choice(SYLLABLES[name]) for _ in range(rng.randrange(1, 4))) for _ in range(rng.randrange(20, 200))), name))
    return out


@settings(max_examples=200, deadline=None)
@given(st.text("ab é1-́Σß", max_size=40), st.sampled_from([3, 8, 1 << 16]))
def test_grams(text, chunk):
    """Every run of up to four characters with an end mark at most at its ends, however the text is cut."""
    p, low = lang.Params(buckets=1 << 30), text.lower()
    marked = "\0" + "".join(c if lang.in_words()[ord(c)] else "\0" for c in low) + "\0" * 4
    want = [marked[i : i + n] for i in range(len(low) + 1) for n in range(1, 5)]
    want = [g for g in want if (g != "\0" if len(g) == 1 else g != "\0\0" and "\0" not in g[1:-1])]
    old, lang.CHUNK = lang.CHUNK, chunk
    try:
        got = np.concatenate(list(lang.grams(text, p)))
    finally:
        lang.CHUNK = old
    assert len(got) == len(want) and len(set(got.tolist())) == len(set(want))
    assert sorted(np.unique(got, return_counts=True)[1]) == sorted(want.count(g) for g in set(want))


@pytest.fixture(scope="module")
def learnt(spark):
    docs = spark.createDataFrame(corpus(), "doc_id long, text string, lang string")
    return docs, lang.fit(docs, crc_mod(F.col("doc_id"), 4) != 2)


def test_held_out_rows(learnt):
    docs, model = learnt
    out = [r for r in lang.predict(docs.withColumnRenamed("lang", "truth"), model).join(docs, "doc_id").collect() if zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2]
    assert len(out) > 30 and all(r["lang_pred"] == r["lang"] for r in out)
    assert np.mean([r["accepted"] for r in out]) >= 0.95 and all(0 <= r["score"] <= 1 for r in out)


def test_rejection(spark, learnt):
    """Gibberish, single letters and languages that were not learnt; temperatures are no end of any grid."""
    _, model = learnt
    rng = random.Random(7)
    strange = ["xqzj vrrk zzpt qqkw", "a", "w" * 600, "zzz", "q x j k"]
    strange += ["".join(rng.choice("bcdfghjkmpqvwxz ") for _ in range(rng.randrange(20, 200))) for _ in range(20)]
    strange += ["Это предложение написано на русском языке и не должно быть принято", "Ни одно слово здесь не знакомо", "Съешь ещё этих мягких французских булок"]
    strange += ["Tämä lause on kirjoitettu suomeksi eikä sitä pitäisi hyväksyä", "Yksikään sana ei ole tuttu täällä", "Hyvää huomenta kaikille ystävilleni"]
    got = lang.predict(spark.createDataFrame(list(enumerate(strange)), "doc_id long, text string"), model).collect()
    assert np.mean([not r["accepted"] for r in got]) >= 0.9
    assert {r["lang_pred"] for r in got} <= set(SYLLABLES)
    assert 1e-3 < model.warm < 500 and 1e-3 < model.warmer < 500 and model.threshold < 1


def test_every_language_counts(spark):
    """No language is left out, whatever their number."""
    rows = [(k, f"word{chr(97 + k % 26)}{chr(97 + k // 26)} " * 20, f"l{k:03d}") for k in range(300)]
    model = lang.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"), F.lit(True), lang.Params(epochs=1, steps=1))
    assert len(model.langs) == 300


def test_long_texts_are_read_whole(spark, learnt):
    """A word of any length, and the end of a long text, count."""
    _, model = learnt
    x = "the " * 50_000
    a, n = model.inputs(x)
    b, m = model.inputs(x + "schungkeit " * 50_000)
    assert m > 2 * n and not np.allclose(a, b)
    assert model.inputs("w" * 200_000)[1] > 700_000
