"""Word vectors come from every whole text that may be learnt from."""

import numpy as np
from pyspark.sql import functions as F

from terragrid.llm import quality


def test_contexts_of_whole_texts(spark):
    p = quality.Params(max_rows=4, dim=8, words=1 << 12, tasks=2)
    tail = " ".join(f"tail{k}" for k in range(300))
    texts = ["alpha beta gamma " * 15_000 + tail, "only here without a label", "never learnt words", "", None]
    texts += [f"good words number{k}" if k % 2 else f"bad terms item{k}" for k in range(40)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    labels = spark.createDataFrame([(k, k % 2) for k in range(len(texts)) if k not in (1, 2)], "doc_id long, quality int")
    got = quality.fit(docs, labels, F.col("doc_id") != 2, p).vectors
    index, want, tokens = quality.index_vectors(p), np.zeros((p.words + p.shapes, p.dim)), quality.Tokens(p)
    for k, t in enumerate(texts):
        b = tokens.buckets(t or "") if k != 2 else []
        for i in range(len(b)):
            for j in (i - 2, i - 1, i + 1, i + 2):
                if 0 <= j < len(b):
                    for c in b[i]:
                        want[c] += index[b[j][0]] + index[b[j][1]]
    want /= np.maximum(np.linalg.norm(want, axis=1, keepdims=True), 1e-9)
    assert np.allclose(got, want, atol=1e-5)
    assert all(got[tokens.buckets(w)[0, 0]].any() for w in ("tail299", "label", "number39", "item38"))
