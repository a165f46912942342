"""Near-dedup with hot keys dealt to several tasks, and without its screen."""

import random

import numpy as np
import pytest

from terragrid.llm import minhash

from test_exact import brute_components, near_copies


def boilerplate(n=60, seed=2):
    """Texts that share a long passage but are no copies, copies of one of them, and empty ones."""
    rng = random.Random(seed)
    passage = " ".join(f"p{k}" for k in range(60))
    texts = [passage + " " + " ".join(f"w{rng.randrange(5000)}" for _ in range(30)) for _ in range(n)]
    return texts + [texts[3]] * 40 + [texts[3] + f" tail{k}" for k in range(40)] + [""] * 40


@pytest.mark.parametrize("texts", [near_copies(), boilerplate()], ids=["copies", "boilerplate"])
@pytest.mark.parametrize("change", [{"hot_rows": 2}, {"hot_rows": 7, "cell_docs": 5, "rounds": 1, "edges_per_task": 40}, {"sigmas": None}], ids=str)
def test_components(spark, texts, change):
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    want, sizes = brute_components(texts, 2)
    got = {r["doc_id"]: r for r in minhash.classes(docs, minhash.Params(words=2, **change)).collect()}
    assert len(got) == len(texts) and [got[i]["component_id"] for i in range(len(texts))] == want
    assert [got[i]["n_shingles"] for i in range(len(texts))] == sizes


def test_components_of_a_star(spark):
    edges = spark.createDataFrame([(i, 0 if i % 2 else 5000) for i in range(1, 900)] + [(5000, 1)], "a long, b long")
    got = minhash.components(edges.repartition(20), 20, 5).collect()
    assert len(got) == 901 and {r["component"] for r in got} == {0}


def test_screen_keeps_pairs_that_link():
    """Of pairs at the least similarity none is lost to the screen, and the number of bits that differ is as the docstring says."""
    p, rng, differ = minhash.Params(words=2), np.random.default_rng(1), []
    for _ in range(400):
        x = rng.integers(0, 1 << 63, 450, dtype=np.uint64)
        a, b = np.sort(x[:400]), np.sort(np.concatenate([x[:355], x[400:444]]))  # 355 of 444: the least above 0.8
        assert minhash.similar(a, b, 79) and not minhash.similar(a, b, 81)
        bits = [minhash.packed_bits(minhash.signature(s, p), p).view(np.uint64) for s in (a, b)]
        differ.append(int(np.bitwise_count(bits[0] ^ bits[1]).sum()))
    n = p.bands * p.rows
    assert max(differ) <= minhash.most_different_bits(p)
    assert abs(np.mean(differ) - 0.1 * n) < 2 and np.std(differ) < 1.3 * (n * 0.09) ** 0.5
    assert minhash.most_different_bits(minhash.Params(sigmas=None)) == n
