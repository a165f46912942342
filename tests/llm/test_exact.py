"""Operators against brute force, other libraries and exact properties."""

import hashlib
import os
import random
import re
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers as P
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer, models

import corpus_pipeline
from terragrid.llm import bpe, chroma, decontam, lang, license, linededup, minhash, pii, quality, queries, tokencount

SF = "/root/testdata/sf0.001"
has_data = pytest.mark.skipif(not os.path.isdir(SF), reason="no tables")

WORD = bpe.WordBpe(bpe.read_spec(P.path("word_bpe_49k.json")))
LIBRARY = Tokenizer.from_file(P.path("word_bpe_49k.json"))
PIECES = tokencount.read_pieces(P.path("piece_bpe_32k.model"))
COUNTER, UNIGRAM = tokencount.Counter(PIECES), Tokenizer(models.Unigram(PIECES, unk_id=0, byte_fallback=True))


@settings(max_examples=300, deadline=None)
@given(st.text(max_size=60) | st.text("abeinrthts'ΑΣσé 1½<|>\n", max_size=200))
def test_bpe_is_exact(text):
    ids: list[int] = []
    WORD.encode(text, ids)
    want = LIBRARY.encode(text, add_special_tokens=False).ids
    assert ids == want
    assert WORD.decode_all(np.array(ids, np.int32), np.array([len(ids)])).to_pylist() == [LIBRARY.decode(want, skip_special_tokens=False)]


def test_bpe_special_tokens():
    text = "a<|startoftext|>b<|STARTOFTEXT|> <|endoftext|>"
    ids: list[int] = []
    WORD.encode(text, ids)
    assert ids == LIBRARY.encode(text, add_special_tokens=False).ids


@settings(max_examples=300, deadline=None)
@given(st.text(max_size=60) | st.text("abeinrthts▁é <s>\n", max_size=200))
def test_token_counts_are_exact(text):
    assert COUNTER.count(text) == (len(UNIGRAM.encode("▁" + text.replace(" ", "▁"), add_special_tokens=False).ids) if text else 0)


def near_copies(n=40, seed=5):
    rng = random.Random(seed)
    words = [f"w{k}" for k in range(400)]
    texts = []
    for k in range(n):
        base = [rng.choice(words) for _ in range(rng.randrange(1, 120))]
        texts.append(" ".join(base))
        for _ in range(rng.randrange(4)):
            copy = list(base)
            for _ in range(rng.randrange(1, 6)):
                copy[rng.randrange(len(copy))] = rng.choice(words)
            texts.append(" ".join(copy))
    # one large group around a base that isn't first, so that most pairs of copies aren't linked themselves
    base = [rng.choice(words) for _ in range(200)]
    group = []
    for _ in range(60):
        copy = list(base)
        for i in rng.sample(range(200), 11):
            copy[i] = rng.choice(words)
        group.append(" ".join(copy))
    return [*texts, *group[:30], " ".join(base), *group[30:], texts[0], texts[0].upper(), "", "one"]


def brute_components(texts, words):
    sets = []
    for t in texts:
        w = t.lower().split()
        sets.append({tuple(w[i : i + words]) for i in range(len(w) - words + 1)} if len(w) >= words else ({tuple(w)} if w else set()))
    parent = list(range(len(texts)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(texts)):
        for j in range(i):
            k = len(sets[i] & sets[j])
            if sets[i] and 100 * k >= 80 * len(sets[i] | sets[j]):
                a, b = sorted((root(i), root(j)))
                parent[b] = a
    return [root(i) for i in range(len(texts))], [len(s) for s in sets]


@pytest.mark.parametrize("words", [2, 5])
def test_near_duplicates_are_exact(spark, words):
    texts = near_copies()
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    want, sizes = brute_components(texts, words)
    got = {r["doc_id"]: r for r in minhash.classes(docs, minhash.Params(words=words)).collect()}
    assert [got[i]["component_id"] for i in range(len(texts))] == want
    assert [got[i]["n_shingles"] for i in range(len(texts))] == sizes
    assert all(got[i]["kept"] == (want[i] == i) for i in range(len(texts)))


def test_rounds_of_centres_lose_nothing(spark):
    """Any number of rounds of centres, and small cells, find the same components."""
    texts = near_copies(20, 9)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    want, _ = brute_components(texts, 2)
    for rounds, cell in ((0, 500), (1, 3), (3, 7)):
        got = minhash.classes(docs, minhash.Params(words=2, rounds=rounds, cell_docs=cell, edges_per_task=50)).collect()
        assert {r["doc_id"]: r["component_id"] for r in got} == dict(enumerate(want))


def test_components_of_a_long_path(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(200)], "a long, b long")
    for per_task in (1 << 20, 7):
        got = minhash.components(edges.repartition(40), per_task).collect()
        assert {r["id"] for r in got} == set(range(201)) and {r["component"] for r in got} == {0}


def test_circulant_signature():
    """Coordinate k is the minimum over the circle shifted by k."""
    p = minhash.Params(circle=64, bands=4, rows=3)
    first, windows = minhash.permutations(64, p.seed, 12)
    s = np.array([3, 77, 901], np.uint64)
    at = first[(s % np.uint64(64)).astype(int)]
    second = np.concatenate([windows[:, 0][:64]])
    assert minhash.signature(s, p).tolist() == [min(second[(x + k) % 64] for x in at) for k in range(12)]


def brute_lines(texts):
    where = defaultdict(set)
    key = lambda line: line.strip(" \t\n\r\x0b\x0c").translate({c: c + 32 for c in range(65, 91)})
    for i, t in texts:
        for line in t.split("\n"):
            where[key(line)].add(i)
    gone = {k: max(v) for k, v in where.items() if len(k) >= 20 and len(v) >= 3}
    return {i: "\n".join(x for x in t.split("\n") if gone.get(key(x), i) == i) for i, t in texts}


def test_line_dedup(spark):
    rng = random.Random(3)
    pool = [f"line number {k} with some text é" for k in range(30)] + ["short", "  A common line in all of the documents "]
    texts = [(i, "\n".join(rng.choice(pool) if rng.random() < 0.7 else pool[-1] for _ in range(rng.randrange(1, 12)))) for i in range(200)]
    docs = spark.createDataFrame(texts, "doc_id long, text string").repartition(3)
    got = linededup.apply_bitmaps(docs, linededup.keep_bitmaps(docs)).collect()
    assert {r["doc_id"]: r["kept"] for r in got} == brute_lines(texts)


@settings(max_examples=100, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 4), st.integers(0, 6), st.integers(0, 2)), max_size=60), st.lists(st.integers(1, 9), max_size=8))
def test_streaming_over_any_batches(rows, cuts):
    """The pass over one partition decides like a plain count, however it is cut into batches and partitions."""
    import pyarrow as pa

    rows = sorted(set(rows), key=lambda r: (r[0], -r[1], r[2]))
    for split in {0, len(rows) // 2, len(rows)}:
        drops, pending, parts = set(), set(), defaultdict(list)
        for part in (rows[:split], rows[split:]):
            if split and part and rows[split - 1][:2] == (rows[split][:2] if split < len(rows) else None):
                return  # a partition border never cuts one (hash, document)
            batches, at = [], 0
            for c in [*cuts, len(part)]:
                chunk = part[at : at + c]
                at += c
                if chunk:
                    h, d, k = zip(*chunk, strict=True)
                    batches.append(pa.RecordBatch.from_arrays([pa.array(h, pa.int64()), pa.array(h, pa.int32()), pa.array(d, pa.int64()), pa.array([0] * len(h), pa.int32()), pa.array(k, pa.int32())], ["h1", "h2", "doc_id", "version", "line"]))
            for out in linededup.streamed(iter(batches), 3):
                for r in out.to_pylist():
                    row = (r["h1"], r["doc_id"], r["line"])
                    if r["kind"] == linededup.DROP:
                        drops.add(row)
                    elif r["kind"] == linededup.PENDING:
                        pending.add(row)
                    else:
                        parts[r["h1"]].append((r["docs"], r["doc_id"]))
        for row in pending:
            n, top = sum(x for x, _ in parts[row[0]]), max(x for _, x in parts[row[0]])
            if n >= 3 and row[1] != top:
                drops.add(row)
        docs = defaultdict(set)
        for h, d, _ in rows:
            docs[h].add(d)
        assert drops == {r for r in rows if len(docs[r[0]]) >= 3 and r[1] != max(docs[r[0]])}


def brute_leaks(docs, items, words=5):
    grams = lambda w, n: {tuple(w[i : i + n]) for i in range(len(w) - n + 1)}
    split = lambda t: re.findall(r"[^\W_]+", t.lower())
    out = set()
    for j, item in items:
        w = split(item)
        n = min(words, len(w))
        s = grams(w, n) if w else set()
        for i, t in docs:
            if s and 100 * len(s & grams(split(t), n)) >= 80 * len(s):
                out.add((i, j))
    return out


def test_decontamination(spark):
    rng = random.Random(8)
    words = [f"w{k}" for k in range(300)]
    items = [(j, " ".join(rng.choice(words) for _ in range(rng.randrange(1, 60)))) for j in range(40)]
    docs = []
    for i in range(120):
        w = [rng.choice(words) for _ in range(rng.randrange(0, 400))]
        if rng.random() < 0.6:
            passage = rng.choice(items)[1].upper().split()
            for _ in range(rng.randrange(3)):
                passage[rng.randrange(len(passage))] = "changed"
            at = rng.randrange(len(w) + 1)
            w[at:at] = passage
        docs.append((i, ", ".join(w)))
    d, b = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    want = brute_leaks(docs, items)
    for p in (decontam.Params(), decontam.Params(block_chars=500)):
        assert {(r["doc_id"], r["item_id"]) for r in decontam.contained_items(d, b, p).collect()} == want
        assert {r["doc_id"] for r in decontam.clean(d, b, p).collect()} == {i for i, _ in docs} - {i for i, _ in want}


S = pii.Surrogates(b"a key that is only for tests")


@settings(max_examples=200, deadline=None)
@given(st.sampled_from(["12-34", "aB-9", "x", "0000", "éa1"]), st.integers(0, 10**6))
def test_surrogates_are_a_permutation(shape, k):
    """No fixed point, same format, and no two strings of a small format meet."""
    out = S.letters("t", shape)
    assert len(out) == len(shape) and [c.isdigit() for c in out] == [c.isdigit() for c in shape] and [c.isupper() for c in out] == [c.isupper() for c in shape]
    assert out != shape
    n = 2 + k % 300
    assert sorted(S.moved(f"n{n}", x, n) for x in range(n)) == list(range(n)) and all(S.moved(f"n{n}", x, n) != x for x in range(n))


def test_surrogates(spark):
    text = "Mrs. Mary Jones (mary.jones@corp.example.org, +44 (20) 555-0199) paid 4111 1111 1111 1111 from 10.0.0.1; Mr. Иван Петров too. MARY.JONES@CORP.EXAMPLE.ORG token = \"0123456789abcdef0123456789abcdef01234567\""
    docs = spark.createDataFrame([(1, text), (2, "write to mary.jones@corp.example.org"), (3, "nothing here")], "doc_id long, text string")
    got = {r["doc_id"]: r for r in pii.surrogates(docs, b"0123456789abcdef").collect()}
    new, kinds = got[1]["text"], Counter(e["type"] for e in got[1]["entities"])
    assert kinds == {"name": 2, "email": 2, "phone": 1, "card": 1, "ip": 1, "secret": 1}
    for old in ("Mary", "mary", "jones", "4111 1111", "10.0.0.1", "Иван", "0123456789abcdef", "555-0199"):
        assert old not in new
    emails = re.findall(r"[\w.]+@[\w.]+", new, re.I)
    assert emails[0].lower() == emails[1].lower() and emails[0] in got[2]["text"] and emails[1].isupper()
    assert new.split(" ")[1] in pii.NAMES[("latin", "f")]
    card = [int(c) for c in re.search(r"(\d{4} ){3}\d{4}", new)[0] if c.isdigit()]
    assert pii.check(card[:-1]) == card[-1]
    assert new.count("+44 (") == 1 and got[3]["text"] == "nothing here" and not got[3]["entities"]
    first = {n: S.given(n, "f") for n in pii.NAMES[("latin", "f")]}
    assert sorted(first.values()) == sorted(first) and all(a != b for a, b in first.items())


def test_license(spark):
    rows = [(1, "LICENSE", "Released under the MIT License."), (2, "a/b/c.py", "x = 1"), (3, "a/COPYING", "# This work is licensed under the GNU General Public License, version 3!"), (4, "a/b/d.py", "# Licensed under CC BY-NC 4.0.\ny = 2"), (5, "z/e.py", ""), (6, None, "Released under the MIT License."), (7, "ab/f.py", "licensed")]
    got = {r["file_id"]: (r["stated"], r["licence"], r["inherited_from"]) for r in license.scan(spark.createDataFrame(rows, "file_id long, path string, text string")).collect()}
    assert got == {1: ("MIT", "MIT", None), 2: (None, "GPL-3.0", "a"), 3: ("GPL-3.0", "GPL-3.0", None), 4: ("CC-BY-NC-4.0", "CC-BY-NC-4.0", None), 5: (None, "MIT", ""), 6: (None, None, None), 7: (None, "MIT", "")}


def test_chroma_aligns_overlapping_recordings(spark):
    p = chroma.Params()
    rng = np.random.default_rng(1)
    tune = chroma.tones(p)([rng.normal(0, 0.125, 200).tolist()])[0]
    other = chroma.tones(p)([rng.normal(0, 0.125, 200).tolist()])[0]
    hop = p.hop * 20
    noisy = tune[hop : hop + 60_000] + rng.normal(0, 0.02, 60_000)
    pcm = lambda x: bytearray((np.clip(x, -1, 1) * 30_000).astype("<i2").tobytes())
    media = spark.createDataFrame([(0, pcm(tune)), (1, pcm(noisy)), (2, pcm(other)), (3, pcm(tune))], "rec_id long, media binary")
    got = {r["rec_id"]: r for r in chroma.search(chroma.fingerprints(media, chroma.pcm16, p), F.col("rec_id") % 20 == 0, p).collect()}
    assert got[3]["class_id"] == 0 and got[0]["n_aligned"] == 2 and got[0]["best_id"] == 1 and got[0]["best_offset"] == -20 and got[0]["best_bits"] < 0.15
    assert got[2]["n_aligned"] is None


@has_data
def test_language_held_out(spark):
    out = queries.op9_language(spark, SF).join(spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", F.col("lang").alias("truth")), "doc_id").where("held_out")
    assert out.agg(F.avg((F.col("lang_pred") == F.col("truth")).cast("int"))).first()[0] > 0.9


@has_data
def test_quality_held_out(spark):
    sf = SF.replace("0.001", "0.01")
    out = queries.op2_quality(spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").where("held_out")
    good, bad = (out.where(F.col("quality") == k).agg(F.avg("predicted")).first()[0] for k in (1, 0))
    assert good > 0.95 and bad < 0.5


@has_data
def test_op10_digests(spark):
    want = {}
    for r in spark.read.parquet(f"{SF}/documents.parquet").collect():
        ids = LIBRARY.encode(r["text"] or "", add_special_tokens=False).ids
        want[r["doc_id"]] = tuple(hashlib.sha256(x.encode()).hexdigest() for x in (" ".join(map(str, ids)), LIBRARY.decode(ids, skip_special_tokens=False)))
    assert {r["doc_id"]: (r["ids_sha256"], r["decoded_sha256"]) for r in queries.op10_bpe_round_trip(spark, SF).collect()} == want


@has_data
def test_pipeline_against_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    model = quality.fit(docs, spark.read.parquet(f"{SF}/labels.parquet"), queries.crc_mod(F.col("doc_id"), 5) != 0)
    tokens = quality.Tokens(model.params)
    texts = [(r["doc_id"], r["text"]) for r in docs.orderBy("doc_id").collect()]
    texts = [(i, t) for i, t in texts if model.probability(quality.pooled(tokens.buckets(t or ""), model.vectors)[None])[0] >= 0.3]
    kept = brute_lines([(i, t or "") for i, t in texts])
    texts = [(i, kept[i]) for i, t in texts if kept[i].strip() or not (t or "").strip()]
    classes, _ = brute_components([t for _, t in texts], 5)
    texts = [x for k, x in enumerate(texts) if classes[k] == k]
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    leaks = {i for i, _ in brute_leaks(texts, items)}
    want = {i: LIBRARY.encode(t, add_special_tokens=False).ids for i, t in texts if i not in leaks}
    assert {r["doc_id"]: r["ids"] for r in corpus_pipeline.run(spark, SF).collect()} == want
