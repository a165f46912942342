"""Search for copies of recordings against brute force over all pairs and offsets."""

import dataclasses
import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from terragrid.llm import chroma, queries

SF = "/root/testdata/sf0.001"
P = chroma.Params()


def pcm(x):
    return bytearray((np.clip(x, -1, 1) * 30_000).astype("<i2").tobytes())


def corpus(seed=3):
    """Melodies; of some, parts that begin anywhere, with noise; copies; one steady tone in two lengths; silence."""
    rng = np.random.default_rng(seed)
    tunes = [x * 0.7 for x in chroma.tones(P)([rng.normal(0, 0.125, 64).tolist() for _ in range(60)])]
    out = list(tunes)
    for k in range(40):
        first = int(rng.integers(0, len(tunes[k]) // 3))
        part = tunes[k][first : first + int(0.6 * len(tunes[k]))]
        out.append(part + rng.normal(0, (0.005, 0.02, 0.08)[k % 3], len(part)))
    steady = np.sin(2 * np.pi * 220 * np.arange(40_000) / P.rate)
    return [*out, tunes[0], tunes[1], steady, steady[:30_000], np.zeros(30_000)]


def brute(codes, p=P, asked=None):
    """For each recording, or each that is asked for, the others that align at any offset."""
    out = {}
    for i in range(len(codes)) if asked is None else asked:
        a = codes[i]
        for j, b in enumerate(codes):
            if i != j and len(a) and len(b) and a.any() and b.any():
                at = [chroma.align(a, b, o) for o in range(-len(a) + p.least_overlap, len(b) - p.least_overlap + 1)]
                if any(n >= p.least_overlap and e <= p.most_bits for e, n in at):
                    out.setdefault(i, set()).add(j)
    return out


@pytest.mark.parametrize("hot_rows", [1000, 3])
def test_recall_against_brute_force(spark, hot_rows):
    p, media = dataclasses.replace(P, hot_rows=hot_rows), corpus()
    df = spark.createDataFrame([(k, pcm(x)) for k, x in enumerate(media)], "rec_id long, media binary")
    codes = [chroma.fingerprint(x, p) for x in chroma.pcm16([bytes(pcm(x)) for x in media])]
    want = brute(codes)
    got = {r["rec_id"]: r for r in chroma.search(chroma.fingerprints(df, chroma.pcm16, p, is_query=F.lit(True)), F.lit(True), p).collect()}
    pairs, found = sum(map(len, want.values())), sum(min(got[i]["n_aligned"], len(x)) for i, x in want.items())
    assert pairs >= 80 and found >= 0.9 * pairs, (found, pairs)
    assert sum(r["n_aligned"] for r in got.values()) <= 1.02 * pairs  # and little else
    for k in range(2, 40):
        if got[60 + k]["best_id"] is not None:
            assert got[60 + k]["best_id"] == k and got[60 + k]["best_bits"] <= 0.25
    assert got[100]["class_id"] == 0 and got[101]["class_id"] == 1
    assert got[103]["best_id"] == 102 and got[104]["n_aligned"] == 0


def test_heads_of_runs(spark):
    row = spark.createDataFrame([([0, 0, 5, 5, 7, 5, 0, 5],)], "codes array<int>").select(chroma.heads(F.col("codes")).alias("h")).first()
    assert [(x["place"], x["code"]) for x in row["h"]] == [(2, 5), (4, 7), (5, 5), (7, 5)]


def test_bits_are_balanced():
    codes = np.concatenate([chroma.fingerprint(x, P) for x in chroma.tones(P)(np.random.default_rng(5).normal(0, 0.125, (100, 64)).tolist())])
    share = [float(((codes >> np.uint32(b)) & 1).mean()) for b in range(32)]
    assert min(share) > 0.3 and max(share) < 0.8


def test_clashing_columns_ties_and_repeats(spark):
    tune = chroma.tones(P)([np.random.default_rng(6).normal(0, 0.125, 64).tolist()])[0]
    part = tune[: len(tune) * 3 // 4]
    media = [(20, pcm(tune)), (20, pcm(tune)), (3, pcm(part)), (2, pcm(part)), (7, None), (None, pcm(tune))]
    df = spark.createDataFrame([(*r, 1, [1], "x", 2) for r in media], "rec_id long, media binary, codes int, phases array<int>, mark string, size int")
    asks = F.col("rec_id") % 20 == 0
    got = chroma.search(chroma.fingerprints(df, chroma.pcm16, P, is_query=asks), asks, P).collect()
    assert len(got) == 6
    for r in got:
        if r["rec_id"] == 20:
            assert (r["class_id"], r["n_aligned"], r["best_id"]) == (20, 3, 2)
        else:
            assert r["n_aligned"] is None


def test_a_long_recording(spark):
    rng = np.random.default_rng(8)
    long = chroma.tones(P)([rng.normal(0, 0.125, 6000).tolist()])[0]
    df = spark.createDataFrame([(0, pcm(long[2_000_000:2_060_000])), (1, pcm(long))], "rec_id long, media binary")
    got = {r["rec_id"]: r for r in chroma.search(chroma.fingerprints(df, chroma.pcm16, P, is_query=F.col("rec_id") == 0), F.col("rec_id") == 0, P).collect()}
    assert got[0]["best_id"] == 1 and abs(got[0]["best_offset"] - 2_000_000 // P.hop) <= 1 and got[1]["n_codes"] > 6000


@pytest.mark.skipif(not os.path.isdir(SF), reason="no tables")
def test_query_against_brute_force(spark):
    rows = spark.read.parquet(f"{SF}/embeddings.parquet").select("vec_id", "embedding").collect()
    codes = dict(zip([r["vec_id"] for r in rows], [chroma.fingerprint(x, P) for x in chroma.tones(P)([r["embedding"] for r in rows])], strict=True))
    got = {r["vec_id"]: r for r in queries.op3_chroma_fingerprints(spark, SF).collect()}
    ids = sorted(codes)
    asked = [k for k, i in enumerate(ids) if i % 20 == 0]
    want = brute([codes[i] for i in ids], asked=asked)
    assert got.keys() == codes.keys() and all(got[i]["n_codes"] == len(codes[i]) for i in ids)
    assert all((got[i]["n_aligned"] is not None) == (i % 20 == 0) for i in ids)
    assert sum(got[ids[k]]["n_aligned"] for k in asked) >= 0.9 * sum(len(want.get(k, ())) for k in asked)


@pytest.mark.parametrize("hot_rows", [3, 1000])
def test_partners_by_common_codes_only(spark, hot_rows):
    rng = np.random.default_rng(9)
    codes = lambda n: rng.integers(-(2**31), 2**31, n).tolist()
    same = codes(20)
    rows = [(0, [*same, *codes(40)])] + [(k, [*same, *codes(2)]) for k in range(1, 31)] + [(k, codes(30)) for k in range(31, 40)]
    df = spark.createDataFrame(rows, "rec_id long, codes array<int>")
    got = {r["rec_id"]: r for r in chroma.search(df, F.col("rec_id") % 20 == 0, dataclasses.replace(P, hot_rows=hot_rows)).collect()}
    assert (got[0]["n_aligned"], got[20]["n_aligned"], got[1]["n_aligned"]) == (30, 30, None)
    assert got[0]["best_offset"] == 0 and got[0]["best_bits"] < 0.1


def test_a_group_of_near_copies_makes_few_rows(spark):
    rng = np.random.default_rng(10)
    same = rng.integers(-(2**31), 2**31, 40).tolist()
    rows = [(k, [int(rng.integers(-(2**31), 2**31)) if j % 20 == k % 20 else c for j, c in enumerate(same)], 1) for k in range(400)]
    classes = spark.createDataFrame(rows, "rep long, codes array<int>, size long")
    asking = classes.where("rep % 4 = 0").select("rep", F.array("codes").alias("phases"))
    found, common, few = chroma.candidates(classes, asking, P)
    parts = chroma.streamed(classes, asking.join(common.withColumnRenamed("q", "rep"), "rep", "left_semi"), P, True)
    assert (found.count(), common.count(), few.count(), len(parts)) == (0, 100, 0, 1)
    told = parts[0].groupBy("q").agg(F.sum("others").alias("n"), F.count("*").alias("tasks")).collect()
    assert len(told) == 100 and all(r["n"] == 399 and r["tasks"] <= classes.rdd.getNumPartitions() for r in told)


def test_votes_are_counted_by_parts(spark, monkeypatch):
    rng = np.random.default_rng(11)
    same = rng.integers(1, 2**31, 40).astype(np.uint32)
    some = [np.concatenate([same, rng.integers(1, 2**31, k).astype(np.uint32)]) for k in range(0, 12)] + [np.zeros(0, np.uint32)]
    block = chroma.Block([(k, [c.view(np.int32).tolist()]) for k, c in enumerate(some[:5])], True)
    want = list(block.matches(some, P))
    assert {(c, q) for c, q, _, _ in want} == {(c, q) for c in range(12) for q in range(5)}
    for most in (1, 150, 500):
        monkeypatch.setattr(chroma, "MOST_VOTES", most)
        assert list(block.matches(some, P)) == want
