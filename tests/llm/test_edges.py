"""Nulls, empty and very long texts, ties, repeated rows, empty tables and clashing columns, for every operator and stage."""

import public_tokenizers as P
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from terragrid.llm import bpe, chroma, decontam, lang, license, linededup, minhash, pii, quality, tokencount

CLASHES = "score double, n_tokens long, ids string, decoded string, version int, bucket long, component long, kept boolean, doc_id_1 long, entities string, path string, h1 long, rep long, n long, y int, bands string"
LONG = "word " * 30_000 + "x" * 50_000


def rows():
    base = [
        (1, "The same line of this document here.\nOther text one two three.", "en", "a"),
        (2, "The same line of this document here.\nMore text four five six.", "en", "a"),
        (3, "The same line of this document here.\nLast text seven eight nine.", None, None),
        (3, "The same line of this document here.\nLast text seven eight nine.", None, None),
        (4, "", "de", "b"),
        (5, None, "de", "b"),
        (None, "a text without an id that nobody can link to anything", "en", "a"),
        (None, None, None, None),
        (6, LONG, "en", "a"),
        (7, "\n\n \t\n", "fr", "c"),
        (8, "1234 5678 !!! ???", "es", "d"),
        (9, "mail me: someone@example.org or +1 (234) 555-0100", "en", "a"),
    ]
    return [(*r, None if r[1] is None else len(r[1]), *[None] * 16) for r in base]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(rows(), f"doc_id long, text string, lang string, source string, n_chars long, {CLASHES}")


@pytest.fixture(scope="module")
def none(docs):
    return docs.limit(0)


@pytest.fixture(scope="module")
def sf(spark, docs, tmp_path_factory):
    """A folder with the small tables that stages read."""
    d = str(tmp_path_factory.mktemp("sf"))
    spark.createDataFrame([(1, 1, 0), (2, 0, 0), (None, 1, 0), (3, None, None), (4, 1, 0), (6, 0, 0), (1, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    spark.createDataFrame([(1, "someone who never said so at all in this text"), (None, "x y"), (2, None), (3, "")], "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
    docs.write.parquet(f"{d}/documents.parquet")
    return d


def operators(spark, sf):
    labels, bench = spark.read.parquet(f"{sf}/labels.parquet"), spark.read.parquet(f"{sf}/benchmark.parquet")
    ok = F.lit(True)
    return {
        "tokens": lambda d: tokencount.counts(d, P.path("piece_bpe_32k.model")),
        "quality": lambda d: quality.score(d, quality.fit(d, labels, ok)),
        "pii": lambda d: pii.surrogates(d, b"0123456789abcdef"),
        "license": lambda d: license.scan(d.withColumn("path", F.concat(F.lit("a/"), "doc_id")), "doc_id"),
        "near": lambda d: minhash.classes(d),
        "lines": lambda d: linededup.apply_bitmaps(d, linededup.keep_bitmaps(d)),
        "leaks": lambda d: decontam.contained_items(d, bench),
        "lang": lambda d: lang.predict(d, lang.fit(d, ok)),
        "bpe": lambda d: bpe.encode(d, P.path("word_bpe_49k.json")),
    }


@pytest.mark.parametrize("name", ["tokens", "quality", "pii", "license", "near", "lines", "lang", "bpe"])
def test_one_row_for_each_row(spark, docs, none, sf, name):
    op = operators(spark, sf)[name]
    got = op(docs).collect()
    ids = [r["file_id" if name == "license" else "doc_id"] for r in got]
    assert sorted(ids, key=str) == sorted((r[0] for r in rows()), key=str)
    assert op(none).count() == 0


def test_leaks(spark, docs, none, sf):
    op = operators(spark, sf)["leaks"]
    assert op(docs).count() == 0
    assert op(none).count() == 0
    empty = spark.read.parquet(f"{sf}/benchmark.parquet").limit(0)
    assert decontam.contained_items(docs, empty).count() == 0


def test_defined_values(spark, docs, sf):
    ops = operators(spark, sf)
    by = lambda n: {r["doc_id"]: r for r in ops[n](docs).where("doc_id is not null").collect()}
    assert [by("tokens")[k]["n_tokens"] for k in (4, 5)] == [0, 0]
    assert [by("bpe")[k]["ids"] for k in (4, 5)] == [[], []]
    found = by("lang")
    assert [found[k]["lang_pred"] for k in (4, 5, 7, 8)] == ["und"] * 4
    lines = by("lines")
    assert [(lines[k]["n_lines"], lines[k]["n_dropped"]) for k in (1, 2, 3, 4, 5)] == [(2, 1), (2, 1), (2, 0), (1, 0), (1, 0)]
    near = by("near")
    assert all(near[k]["n_shingles"] == 0 and near[k]["kept"] and near[k]["component_id"] == k for k in (4, 5, 7))
    assert near[3]["component_id"] == 3


@pytest.mark.parametrize("stage", range(5))
def test_stages(spark, docs, none, sf, stage):
    name, f = corpus_pipeline.STAGES[stage]
    out = f(spark, docs, sf)
    n = out.count()
    if stage < 4:
        assert out.columns == docs.columns
        assert n <= len(rows())
        assert f(spark, none, sf).count() == 0
    else:
        assert n == len(rows())


def test_chroma_edges(spark):
    p = chroma.Params()
    media = spark.createDataFrame([(1, None), (2, bytearray()), (3, bytearray(b"\0" * 60_000)), (None, bytearray(b"ab" * 30_000)), (20, bytearray(b"\0" * 60_000))], "rec_id long, media binary")
    got = {r["rec_id"]: r for r in chroma.search(chroma.fingerprints(media, chroma.pcm16, p), F.col("rec_id") % 20 == 0, p).collect()}
    assert len(got) == 5 and got[1]["n_codes"] == got[2]["n_codes"] == 0
    assert got[20]["class_id"] == 3 and got[20]["n_aligned"] == 1
    assert chroma.search(chroma.fingerprints(media.limit(0), chroma.pcm16, p), F.col("rec_id") % 20 == 0, p).count() == 0
