"""Quality classifier.

Word vectors by random indexing: every token has a fixed sparse random index vector; the vector of a
token is the sum of the index vectors of its neighbours.  A token is counted twice, as its lower-case
word and as its shape (case, digits, punctuation), so that an unseen word still has a vector.  A
text's features are the mean, the spread and the agreement with the next token, by dimension, of the
vectors of its tokens; a network of two layers,
trained in numpy, scores them, and a temperature found on unseen rows calibrates the probability.
"""

from __future__ import annotations

import hashlib
import pickle
import re
import zlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import fixed_share, id_text, kept_rows, map_batches

TOKEN = re.compile(r"\w+|[^\w\s]+")
MAX_TOKENS, LONGEST_CACHED, CHUNK, BLOCK = 1 << 18, 32, 1 << 13, 1 << 12


@dataclass(frozen=True)
class Params:
    """``max_rows`` bounds the labelled rows that the network learns from (about that many, chosen by a
    fixed hash of the id); word vectors come from every whole text that may be learnt from."""

    max_rows: int = 6000
    words: int = 1 << 14
    shapes: int = 1 << 10
    dim: int = 48
    nonzero: int = 6
    window: int = 2
    hidden: int = 24
    epochs: int = 60
    rate: float = 0.01
    decay: float = 1e-4
    batch: int = 64
    tasks: int = 6


@lru_cache(maxsize=1 << 12)
def form(kind: str, n: int) -> int:
    return zlib.crc32(f"{kind}{n}".encode())


def shape(token: str) -> int:
    """A hash of case, digits and the first punctuation of a token, with its length up to four."""
    first = token[0]
    if token.islower():
        kind = "l"
    elif first.isalnum() or first == "_":
        kind = "d" if token.isdigit() else "U" if len(token) > 1 and token.isupper() else "T" if first.isupper() and token[1:].islower() else "m"
    else:
        kind = first + ("+" if len(token) > 1 and token.count(first) == len(token) else "")
    return form(kind, min(len(token), 4))


@lru_cache(maxsize=2)
def index_vectors(p: Params) -> np.ndarray:
    """A sparse vector of +1 and -1 for each word bucket and each shape bucket."""
    rng = np.random.default_rng(5)
    n = p.words + p.shapes
    out = np.zeros((n, p.dim), np.float32)
    for k in range(p.nonzero):
        out[np.arange(n), rng.integers(0, p.dim, n)] += rng.choice((-1.0, 1.0), n)
    return out


class Tokens(dict):
    """Word bucket and shape bucket of each token, packed into one integer; a bounded cache."""

    def __init__(self, p: Params) -> None:
        self.words, self.shapes = p.words, p.shapes

    def __missing__(self, token: str) -> int:
        k = zlib.crc32(token.lower().encode()) % self.words << 32 | self.words + shape(token) % self.shapes
        if len(token) <= LONGEST_CACHED:
            if len(self) >= MAX_TOKENS:
                self.clear()
            self[token] = k
        return k

    def chunks(self, text: str, around: int = 0) -> Iterator[tuple[np.ndarray, np.ndarray, slice]]:
        """Buckets of the words and of the shapes of each chunk of tokens, with so many more ``around`` it, and where the chunk is."""
        tokens = TOKEN.findall(text)
        for i in range(0, len(tokens), CHUNK):
            low = max(i - around, 0)
            part = tokens[low : i + CHUNK + around]
            k = np.fromiter(map(self.__getitem__, part), np.int64, len(part))
            yield k >> 32, k & 0xFFFFFFFF, slice(i - low, min(i + CHUNK, len(tokens)) - low)

    def buckets(self, text: str) -> np.ndarray:
        """Word bucket and shape bucket of each token."""
        return np.concatenate([np.zeros((0, 2), np.int64), *(np.stack([w, s], axis=1) for w, s, _ in self.chunks(text))])


class Contexts:
    """For each bucket the sum of the index vectors of its neighbours, over whole texts; whole numbers, so exact."""

    def __init__(self, p: Params) -> None:
        self.p, self.tokens, self.gap = p, Tokens(p), p.words + p.shapes
        self.index = np.concatenate([index_vectors(p), np.zeros((1, p.dim), np.float32)])  # the last one stands between texts
        self.sums, self.parts, self.n = np.zeros((self.gap + 1, p.dim)), [], 0

    def add(self, text: str) -> None:
        """A text; a long one goes in chunks, each with its neighbours."""
        for words, shapes, own in self.tokens.chunks(text, self.p.window):
            self.parts.append((words, shapes, own))
            self.n += len(words)
            if self.n >= CHUNK:
                self.flush()

    def flush(self) -> None:
        if not self.parts:
            return
        w, gap = self.p.window, np.full(self.p.window, self.gap)
        words, shapes = (np.concatenate([x for part in self.parts for x in (part[k], gap)]) for k in (0, 1))
        own, at = np.zeros(len(words), bool), 0
        for x, _, mine in self.parts:
            own[at + mine.start : at + mine.stop] = True
            at += len(x) + w
        self.parts, self.n = [], 0
        v = self.index.take(words, axis=0) + self.index.take(shapes, axis=0)
        around = np.zeros_like(v)
        for k in range(1, w + 1):
            around[k:] += v[:-k]
            around[:-k] += v[k:]
        around[~own] = 0
        for ids in (words, shapes):
            ids = ids.astype(np.uint16 if self.gap < 1 << 16 else np.int64)
            order = np.argsort(ids, kind="stable")
            ids = ids[order]
            first = np.flatnonzero(np.append(True, ids[1:] != ids[:-1]))
            self.sums[ids[first]] += np.add.reduceat(around.take(order, axis=0), first, axis=0)

    def total(self) -> np.ndarray:
        self.flush()
        return self.sums[:-1]


def pool(rows: Iterable[np.ndarray], d: int) -> np.ndarray:
    """Mean and spread of the rows of a text's tokens, their agreement with the next, and the log of their number."""
    n, last = 0, None
    total, square, pairs = np.zeros(d), np.zeros(d), np.zeros(d)
    for chunk in rows:
        for i in range(0, len(chunk), BLOCK):  # sums in single precision stay short
            v = chunk[i : i + BLOCK]
            total += np.ones(len(v), np.float32) @ v
            square += np.einsum("ij,ij->j", v, v)
            pairs += np.einsum("ij,ij->j", v[1:], v[:-1])
            if last is not None:
                pairs += last * v[0]
            last = v[-1]
            n += len(v)
    mean = total / max(n, 1)
    spread = np.sqrt(np.maximum(square / max(n, 1) - mean**2, 0))
    return np.concatenate([mean, spread, pairs / max(n - 1, 1), [np.log1p(n)]])


def features(text: str, tokens: Tokens, vectors: np.ndarray) -> np.ndarray:
    """Features of a whole text."""
    return pool((vectors.take(w, axis=0) + vectors.take(s, axis=0) for w, s, _ in tokens.chunks(text)), vectors.shape[1])


def pooled(buckets: np.ndarray, vectors: np.ndarray) -> np.ndarray:
    """Features of a text whose tokens have these buckets."""
    return pool((vectors[b[:, 0]] + vectors[b[:, 1]] for b in (buckets[i : i + CHUNK] for i in range(0, len(buckets), CHUNK))), vectors.shape[1])


@dataclass
class Model:
    params: Params
    vectors: np.ndarray
    centre: np.ndarray
    scale: np.ndarray
    w1: np.ndarray
    b1: np.ndarray
    w2: np.ndarray
    b2: float
    temperature: float = 1.0

    def logits(self, x: np.ndarray) -> np.ndarray:
        h = np.tanh(np.clip((x - self.centre) / self.scale, -6, 6) @ self.w1 + self.b1)
        return h @ self.w2 + self.b2

    def probability(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logits(x) / self.temperature, -30, 30)))


def train(x: np.ndarray, y: np.ndarray, vectors: np.ndarray, p: Params) -> Model:
    """Two layers by Adam on the log loss."""
    rng = np.random.default_rng(3)
    m = Model(p, vectors, x.mean(axis=0), x.std(axis=0) + 1e-6, rng.normal(0, x.shape[1] ** -0.5, (x.shape[1], p.hidden)), np.zeros(p.hidden), np.zeros(p.hidden), 0.0)
    z = np.clip((x - m.centre) / m.scale, -6, 6)
    weights = [m.w1, m.b1, m.w2, np.array([m.b2])]
    first, second, step = [np.zeros_like(w) for w in weights], [np.zeros_like(w) for w in weights], 0
    for _ in range(p.epochs):
        order = rng.permutation(len(z))
        for i in range(0, len(z), p.batch):
            rows = order[i : i + p.batch]
            h = np.tanh(z[rows] @ weights[0] + weights[1])
            d = (1 / (1 + np.exp(-np.clip(h @ weights[2] + weights[3], -30, 30))) - y[rows]) / len(rows)
            back = np.outer(d, weights[2]) * (1 - h**2)
            step += 1
            for k, g in enumerate((z[rows].T @ back + p.decay * weights[0], back.sum(axis=0), h.T @ d + p.decay * weights[2], np.array([d.sum()]))):
                first[k] = 0.9 * first[k] + 0.1 * g
                second[k] = 0.999 * second[k] + 0.001 * g * g
                weights[k] -= p.rate * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.999**step)) + 1e-8)
    m.w1, m.b1, m.w2, m.b2 = weights[0], weights[1], weights[2], float(weights[3][0])
    return m


def fit(docs: DataFrame, labels: DataFrame, may_learn: Column, p: Params = Params(), id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> Model:
    """Learn from the labelled rows that ``may_learn`` (a condition on ``doc_id``) admits.

    Word vectors: each task sums the contexts of all its rows that may be learnt from, with or without
    a label, and the sums meet block by block, so the driver gets one table of fixed size.  Network: the driver gets the
    features of at most about ``max_rows`` rows, a fifth of which only calibrates.  Null labels and
    null texts aren't learnt from; without any label every text scores 0.5.
    """
    spark = docs.sparkSession
    marks = labels.select(labels[id_col].cast("long").alias("doc_id"), labels[label_col].cast("int").alias("mark")).where(may_learn & F.col("doc_id").isNotNull() & F.col("mark").isNotNull()).groupBy("doc_id").agg(F.max("mark").alias("mark"))
    n = marks.count()
    marks = marks.where(fixed_share(F.col("doc_id"), p.max_rows / max(n, 1), "quality"))
    sample = id_text(docs, id_col, text_col).where(F.col("text") != "").join(marks, "doc_id").select("doc_id", "text", F.col("mark").alias("y"), fixed_share(F.col("doc_id"), 0.2, "fold").alias("fold")).repartition(p.tasks, "doc_id")
    size, blocks = (p.words + p.shapes) * p.dim, 64
    schema = "block int, sums binary"

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = Contexts(p)
        for batch in batches:
            for text in batch.column("text").to_pylist():
                found.add(text)
        parts = np.array_split(found.total().ravel().astype(np.int64), blocks)
        yield pa.RecordBatch.from_arrays([pa.array(range(blocks), pa.int32()), pa.array([zlib.compress(x.tobytes(), 1) for x in parts], pa.binary())], ["block", "sums"])

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}  # sums stream past: one array per block, however many tasks there were
        for batch in batches:
            for block, packed in zip(batch.column("block").to_pylist(), batch.column("sums").to_pylist(), strict=True):
                x = np.frombuffer(zlib.decompress(packed), np.int64)
                total[block] = total[block] + x if block in total else x
        yield pa.RecordBatch.from_arrays([pa.array(total, pa.int32()), pa.array([x.astype(np.float32).tobytes() for x in total.values()], pa.binary())], ["block", "sums"])

    learnt = id_text(docs, id_col, text_col).where(may_learn & F.col("doc_id").isNotNull() & (F.col("text") != "")).select("text")
    found = learnt.mapInArrow(gather, schema).repartition(p.tasks, "block").mapInArrow(meet, schema).collect()
    vectors = np.concatenate([np.frombuffer(r["sums"], np.float32) for r in sorted(found, key=lambda r: r["block"])]) if found else np.zeros(size, np.float32)
    vectors = vectors.reshape(-1, p.dim)
    # a token without contexts keeps no vector; the others get length 1
    vectors = (vectors / np.maximum(np.linalg.norm(vectors, axis=1, keepdims=True), 1e-9)).astype(np.float32)

    sent = spark.sparkContext.broadcast(vectors)

    def pooled_rows(batch: pa.RecordBatch) -> pa.RecordBatch:
        tokens = Tokens(p)
        x = [features(t, tokens, sent.value).tolist() for t in batch.column("text").to_pylist()]
        return pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("y"), batch.column("fold"), pa.array(x, pa.list_(pa.float64()))], ["doc_id", "y", "fold", "x"])

    rows = sorted(map_batches(sample, pooled_rows, "doc_id long, y int, fold boolean, x array<double>").collect(), key=lambda r: (r["doc_id"], r["x"]))
    width = 3 * p.dim + 1
    if len({r["y"] > 0 for r in rows}) < 2:
        only = 0.0 if not rows else 30.0 if rows[0]["y"] > 0 else -30.0
        return Model(p, vectors, np.zeros(width), np.ones(width), np.zeros((width, p.hidden)), np.zeros(p.hidden), np.zeros(p.hidden), only)
    x, y = np.array([r["x"] for r in rows]), np.array([float(r["y"] > 0) for r in rows])
    fold = np.array([r["fold"] for r in rows])
    if len(set(y[~fold])) < 2:
        fold[:] = False
    model = train(x[~fold], y[~fold], vectors, p)
    if fold.any():
        logits = model.logits(x[fold])
        grid = np.geomspace(0.25, 16, 97)
        loss = [np.logaddexp(0, np.where(y[fold] > 0, -logits, logits) / t).mean() for t in grid]
        model.temperature = float(grid[int(np.argmin(loss))])
    return model


_live: dict[str, tuple[Model, Tokens]] = {}


def scorer(docs: DataFrame, model: Model):
    """A function from whole texts to scores that runs on executors."""
    blob = pickle.dumps(model)
    tag, sent = hashlib.sha256(blob).hexdigest(), docs.sparkSession.sparkContext.broadcast(blob)

    def run(texts: list[str]) -> np.ndarray:
        if tag not in _live:
            _live.clear()
            m = pickle.loads(sent.value)
            _live[tag] = m, Tokens(m.params)
        m, tokens = _live[tag]
        return m.probability(np.array([features(t, tokens, m.vectors) for t in texts])) if texts else np.zeros(0)

    return run


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, score`` of every whole text: the calibrated probability of a positive label.

    One map without a shuffle; long texts are pooled in chunks.  Null and empty texts are scored like
    any text without tokens; repeated rows are scored each; an empty table gives an empty result.
    """
    scores = scorer(docs, model)

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(scores(batch.column("text").to_pylist()), pa.float64())], ["doc_id", "score"])

    return map_batches(id_text(docs, id_col, text_col), run, "doc_id long, score double")


def admitted(docs: DataFrame, model: Model, least: float = 0.3, text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, with all their columns, that score at least ``least``.

    A null or empty text is scored like any text without tokens; ids play no part, so rows with a null id and
    repeated rows are judged by their text alone; an empty table gives an empty one.
    """
    scores = scorer(docs, model)
    return kept_rows(docs, lambda texts: [x >= least for x in scores(texts)], text_col)
