"""Language identification.

A word (a run of letters and marks, in lower case) is the set of its character n-grams, with marks at
its ends; each n-gram is hashed to a bucket that has an embedding; a text is the average over the
n-grams of its words; a linear softmax gives the languages and one class more, for what is none of
them.  Embeddings and softmax are trained together by stochastic gradient descent in numpy, on a
bounded sample of labelled rows, on short pieces of them, and on texts in no language that are made
from them.  On rows that the training didn't see, a temperature that falls with a text's length
calibrates the probability, and a threshold bounds the share of false acceptances.
"""

from __future__ import annotations

import hashlib
import pickle
import sys
import unicodedata
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import fixed_share, id_text, small_batches

WORD = regex.compile(r"\p{L}[\p{L}\p{M}]*")
LETTER = regex.compile(r"\p{L}")
CHUNK, MANY = 1 << 16, 1 << 13
UNKNOWN = "und"

#: First and last code point of letters of scripts, from which texts in no language are made.
SCRIPTS = [(0x3B1, 0x3C9), (0x430, 0x44F), (0x561, 0x586), (0x5D0, 0x5EA), (0x627, 0x64A), (0x905, 0x939), (0x985, 0x9A8), (0xE01, 0xE2E), (0x10D0, 0x10F0), (0x3041, 0x3093), (0x30A1, 0x30F3), (0x4E00, 0x9FA5), (0xAC00, 0xD7A3)]


@dataclass(frozen=True)
class Params:
    """``rows_per_lang`` bounds the training sample: about that many rows of each language, chosen by
    a fixed hash of the id, each with its whole text.  ``false_accepts``: the share of texts in no
    language that may be accepted in calibration.  ``doubt`` is spread over all classes in calibration, so
    that a sample without errors doesn't give certainty.  Training goes over the sample ``epochs`` times, and more
    often over a small one, until it has made ``steps`` steps."""

    rows_per_lang: int = 400
    buckets: int = 1 << 15
    dim: int = 16
    longest_gram: int = 4
    epochs: int = 4
    steps: int = 40_000
    rate: float = 0.5
    false_accepts: float = 0.02
    doubt: float = 0.005


@lru_cache(maxsize=1)
def in_words() -> np.ndarray:
    """For each code point whether it is a letter or a mark."""
    return np.fromiter((unicodedata.category(chr(c))[0] in "LM" for c in range(sys.maxunicode + 1)), bool, sys.maxunicode + 1)


def grams(text: str, p: Params) -> Iterator[np.ndarray]:
    """Buckets of the n-grams of all words, in chunks.  Whatever is no letter or mark is one and the same end mark;
    an n-gram has it only as its first or last character."""
    low = text.lower()
    for i in range(0, len(low) + 1, CHUNK):  # place 0 is the mark before the text, place k its k-th character
        m = min(CHUNK, len(low) + 1 - i)
        code = np.frombuffer(low[max(i - 1, 0) : i + m + p.longest_gram - 2].encode("utf-32-le", "surrogatepass"), np.uint32)
        c = np.zeros(m + p.longest_gram - 1, np.uint32)
        here = c[1:] if i == 0 else c
        here[: len(code)] = np.where(in_words()[code], code + np.uint32(1), np.uint32(0))
        word, h, inner, out = c > 0, np.zeros(m, np.uint32), np.ones(m, bool), []
        for n in range(1, p.longest_gram + 1):  # the n-grams that begin at these places
            last = slice(n - 1, n - 1 + m)
            h = h + c[last] * np.uint32(0x9E3779B1 * (2 * n + 1) & 0xFFFFFFFF)
            if n > 2:
                inner = inner & word[n - 2 : n - 2 + m]
            x = h[word[:m] if n == 1 else word[:m] | word[last] if n == 2 else inner] + np.uint32(n * 0x85EBCA6B & 0xFFFFFFFF)
            x = (x ^ (x >> np.uint32(15))) * np.uint32(0x2C1B3C6D)
            x = (x ^ (x >> np.uint32(12))) * np.uint32(0x297A2D39)
            out.append((x ^ (x >> np.uint32(15))) % np.uint32(p.buckets))
        yield np.concatenate(out)


def bag(text: str, p: Params) -> np.ndarray:
    """How often each bucket occurs."""
    out = np.zeros(p.buckets, np.int64)
    for g in grams(text, p):
        out += np.bincount(g, minlength=p.buckets)
    return out


def softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


@dataclass
class Model:
    """``out`` and ``bias`` have a column for each language, and a last one for what is none of them.  A text of n
    n-grams has the temperature ``warm + warmer / sqrt(n)``."""

    params: Params
    langs: list[str]
    emb: np.ndarray
    out: np.ndarray
    bias: np.ndarray
    warm: float = 1.0
    warmer: float = 0.0
    threshold: float = 0.0

    def __post_init__(self) -> None:
        self.folded = self.emb.astype(np.float64) @ self.out.astype(np.float64)  # softmax inputs are linear in the n-grams

    def inputs(self, text: str) -> tuple[np.ndarray, int]:
        """Softmax inputs of a whole text, and the number of its n-grams."""
        total, n = np.zeros(self.folded.shape[1]), 0
        for g in grams(text, self.params):
            total += np.bincount(g, minlength=len(self.folded)) @ self.folded if len(g) > MANY else self.folded.take(g, axis=0).sum(axis=0)
            n += len(g)
        return total / max(n, 1) + self.bias, n

    def probabilities(self, x: np.ndarray, n: np.ndarray | int) -> np.ndarray:
        return softmax(x / np.expand_dims(self.warm + self.warmer / np.sqrt(np.maximum(n, 1)), -1))


def pieces(text: str) -> Iterator[tuple[str, bool]]:
    """A text to learn from and what is made from it: whether each is in the text's language.

    Of the others, one has the text's letters exchanged for each other, one its letters shuffled, one random
    letters, one random letters of another script, one a letter repeated.
    """
    rng = np.random.default_rng(zlib.crc32(text.encode()))
    low = text.lower()
    words = WORD.findall(low)
    if not words:
        return
    yield text, True

    def some(most: int) -> list[str]:
        n = int(rng.integers(2, most + 1))
        at = int(rng.integers(0, max(len(words) - n, 0) + 1))
        return words[at : at + n]

    def invented(letters: list[str]) -> str:
        return " ".join("".join(rng.choice(letters, int(k))) for k in rng.integers(1, 10, int(rng.integers(1, 24))))

    yield " ".join(some(6)), True
    yield " ".join(some(30)), True
    alphabet = sorted(set("".join(words)) | set("abcdefghijklmnopqrstuvwxyz" if low[:1000].upper() != low[:1000] else ""))
    kind = int(rng.integers(0, 5))
    yield " ".join(some(40)).translate({ord(a): str(b) for a, b in zip(alphabet, rng.permutation(alphabet), strict=True)}), False
    if kind < 2:
        mine = some(24)
        mixed = iter(rng.permutation(list("".join(mine))))
        yield " ".join("".join(next(mixed) for _ in w) for w in mine), False
    if kind in (1, 2):
        yield invented(alphabet), False
    if kind in (2, 3):
        low_, high = SCRIPTS[int(rng.integers(len(SCRIPTS)))]
        yield invented([chr(int(x)) for x in rng.integers(low_, high + 1, 40)]), False
    if kind > 2:
        yield str(rng.choice(alphabet)) * int(rng.choice([1, 1, 2, 3, 5, 30, 600])), False


def train(rows: list[tuple[np.ndarray, np.ndarray, int]], langs: list[str], p: Params) -> Model:
    """Stochastic gradient descent, one text (buckets, counts, class) a step."""
    rng = np.random.default_rng(17)
    emb = rng.normal(0, 1 / p.dim, (p.buckets, p.dim))
    out, bias = np.zeros((p.dim, len(langs) + 1)), np.zeros(len(langs) + 1)
    share = [n / n.sum() for _, n, _ in rows]
    epochs = max(p.epochs, -(-p.steps // max(len(rows), 1)))
    steps, done = epochs * len(rows), 0
    for _ in range(epochs):
        for i in rng.permutation(len(rows)):
            ids, w = rows[i][0], share[i]
            pooled = w @ emb[ids]
            # no step may be longer than the loss is sure to fall along it: a text of few n-grams has a steep one
            rate = p.rate * min(p.dim, 1 / ((w @ w) * (out * out).sum() + pooled @ pooled + 1e-9)) * (1 - done / steps)
            delta = softmax(pooled @ out + bias)
            delta[rows[i][2]] -= 1
            back = out @ delta
            out -= rate * np.outer(pooled, delta)
            bias -= rate / p.dim * 0.1 * delta
            emb[ids] -= rate * w[:, None] * back
            done += 1
    return Model(p, langs, emb.astype(np.float32), out.astype(np.float32), bias)


def calibrate(model: Model, rows: list[tuple[np.ndarray, np.ndarray, int]]) -> None:
    """The two temperatures of the least log loss, by a grid that moves until the best lies inside it, and
    the least confidence at which few enough texts in no language are accepted."""
    if not rows:
        return
    p, right = model.params, np.array([t for _, _, t in rows])
    x = np.array([(n @ model.folded[ids]) / n.sum() + model.bias for ids, n, _ in rows])
    size = np.array([n.sum() for _, n, _ in rows])
    k = x.shape[1]
    aim = np.full(x.shape, p.doubt / k)
    aim[np.arange(len(x)), right] += 1 - p.doubt

    def loss(warm: float, warmer: float) -> float:
        z = x / (warm + warmer / np.sqrt(size))[:, None]
        z = z - z.max(axis=1, keepdims=True)
        return float((aim * (np.log(np.exp(z).sum(axis=1, keepdims=True)) - z)).sum(axis=1).mean())

    best, step = (0.1, 0.1), 2.0
    while step > 1.05:
        around = [(best[0] * step**i, best[1] * step**j) for i in (-1, 0, 1) for j in (-1, 0, 1)]
        around = [c for c in around if 1e-4 <= c[0] <= 1e3 and 1e-4 <= c[1] <= 1e3]
        now = min(around, key=lambda c: loss(*c))
        best, step = now, step if now != best else step**0.5
    model.warm, model.warmer = best
    sure = model.probabilities(x, size)[:, :-1].max(axis=1)
    wrong = np.sort(sure[right == k - 1])
    model.threshold = max(0.5, float(np.nextafter(wrong[min(len(wrong) - 1, int(np.ceil(len(wrong) * (1 - p.false_accepts))))], 2)) if len(wrong) else 0.5)


def fit(docs: DataFrame, may_learn: Column, p: Params = Params(), id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> Model:
    """Learn from the labelled rows that ``may_learn`` admits.

    Counts of all languages come from one aggregation.  The sample takes each row by a fixed hash of
    its id, at a rate that gives about ``rows_per_lang`` rows a language; a fifth of it calibrates.
    The driver gets the n-gram counts of about ``rows_per_lang`` whole texts a language and of the pieces
    made from them, at most ``buckets`` numbers each.
    """
    labelled = docs.where(may_learn & docs[lang_col].isNotNull() & docs[text_col].isNotNull()).select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].alias("text"), docs[lang_col].alias("lang"))
    counts = labelled.groupBy("lang").agg(F.count("*").alias("n"))
    langs = sorted(r["lang"] for r in counts.collect())
    if not langs:
        return Model(p, [UNKNOWN], np.zeros((p.buckets, p.dim), np.float32), np.zeros((p.dim, 2), np.float32), np.zeros(2))
    # counts has one row per language, as has the driver's list
    chosen = labelled.join(F.broadcast(counts), "lang").where(F.pmod(F.xxhash64(F.lit("lang"), "doc_id"), F.lit(1 << 30)) < F.least(F.lit(1.0), p.rows_per_lang / F.col("n")) * (1 << 30))
    number = {k: i for i, k in enumerate(langs)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for text, lang, fold in zip(*(batch.column(c).to_pylist() for c in ("text", "lang", "fold")), strict=True):
                found = []
                for piece, same in pieces(text):
                    n = bag(piece, p)
                    ids = np.flatnonzero(n)
                    if len(ids):
                        found.append((lang if same else None, fold, ids.astype(np.int32), n[ids]))
                yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in found], pa.string()), pa.array([x[1] for x in found], pa.bool_()), pa.array([x[2] for x in found], pa.list_(pa.int32())), pa.array([x[3] for x in found], pa.list_(pa.int64()))], ["lang", "fold", "ids", "counts"])

    small_batches(docs.sparkSession)
    rows = chosen.select("text", "lang", fixed_share(F.col("doc_id"), 0.2, "fold").alias("fold")).mapInArrow(run, "lang string, fold boolean, ids array<int>, counts array<long>").collect()
    rows = sorted(((r["lang"] or "", r["lang"] is None, r["fold"], np.array(r["ids"]), np.array(r["counts"])) for r in rows), key=lambda r: (r[0], r[1], r[2], r[3].tobytes(), r[4].tobytes()))
    sets = {fold: [(ids, n, len(langs) if none else number[lang]) for lang, none, f, ids, n in rows if f == fold] for fold in (True, False)}
    model = train(sets[False], langs, p)
    calibrate(model, sets[True])
    return model


_live: dict[str, Model] = {}


def predict(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, lang_pred, score, accepted`` of every whole text, in one map without a shuffle.

    ``lang_pred`` is the likeliest language, ``score`` its calibrated probability; ``accepted`` is false
    where the text is likelier in none of the languages, or the score is under the threshold found in
    calibration.  A null or empty text, or one without a letter, gives ``und``, 0 and false.  Repeated
    rows are predicted each; an empty table gives an empty result.
    """
    blob = pickle.dumps((model.params, model.langs, model.emb, model.out, model.bias, model.warm, model.warmer, model.threshold))
    tag, sent = hashlib.sha256(blob).hexdigest(), docs.sparkSession.sparkContext.broadcast(blob)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if tag not in _live:
                _live.clear()
                _live[tag] = Model(*pickle.loads(sent.value))
            m = _live[tag]
            texts = batch.column("text").to_pylist()
            told = [bool(LETTER.search(t)) for t in texts]
            found = [m.inputs(t) if ok else (m.bias, 0) for t, ok in zip(texts, told, strict=True)]
            y = m.probabilities(np.array([x for x, _ in found]), np.array([n for _, n in found]))
            k = y[:, :-1].argmax(axis=1)
            score = y[np.arange(len(y)), k]
            sure = (score >= m.threshold) & (score > y[:, -1])
            lang = [m.langs[i] if ok else UNKNOWN for i, ok in zip(k, told, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(lang, pa.string()), pa.array(np.where(told, score, 0.0), pa.float64()), pa.array([bool(s and ok and x != UNKNOWN) for s, ok, x in zip(sure, told, lang, strict=True)], pa.bool_())], ["doc_id", "lang_pred", "score", "accepted"])

    return id_text(docs, id_col, text_col).mapInArrow(run, "doc_id long, lang_pred string, score double, accepted boolean")
