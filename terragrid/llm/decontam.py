"""Benchmark decontamination.

MinHash containment search.  The shingles of a test item are sketched by coordinates: coordinate k
is the shingle with the least value under hash k.  A document that holds a share t of an item's
shingles holds each coordinate with probability t, however long the document is, so the number of
coordinates found in it estimates containment.  Items are partitioned by the size of their shingle
sets, because a small set repeats shingles in its coordinates: each partition has its own number of
coordinates and its own number that must be found.  Candidates are verified on whole shingle sets:
``100 * found >= percent * shingles of the item``.

Documents stream past the sketches of a block of items in one map, without a shuffle; a larger
benchmark is cut into blocks of bounded size, each of which goes over the documents once.
"""

from __future__ import annotations

import hashlib
import pickle
from collections import defaultdict
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import regex
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import id_text, kept_rows, map_batches
from .minhash import GOLD, mixed

WORD = regex.compile(r"[\p{L}\p{M}\p{N}]+")


@dataclass(frozen=True)
class Params:
    """``coordinates`` of a sketch, of which ``least`` must be found: at a containment of 0.8 fewer than
    10 of 32 are found with a probability of 3e-9.  ``block_chars`` bounds the items sent at once."""

    words: int = 5
    percent: int = 80
    coordinates: int = 32
    least: int = 10
    block_chars: int = 16 << 20


def word_hashes(text: str) -> np.ndarray:
    """Hashes of the words: letters, marks and digits, in lower case; punctuation and spacing don't count."""
    return np.array([xxhash.xxh3_64_intdigest(w) for w in WORD.findall(text.lower())], np.uint64)


def windows(h: np.ndarray, n: int) -> np.ndarray:
    """Sorted distinct hashes of the n-word shingles."""
    if len(h) < n:
        return np.zeros(0, np.uint64)
    out = np.full(len(h) - n + 1, n, np.uint64)
    for k in range(n):
        out = mixed(out * GOLD + h[k : len(h) - n + 1 + k])
    return np.unique(out)


@dataclass
class Sizes:
    """The items of one partition: sets of like size with shingles of one length."""

    length: int
    least: int
    items: list[int] = field(default_factory=list)
    sets: list[np.ndarray] = field(default_factory=list)
    keys: np.ndarray = None  # sorted shingles in the sketches
    owners: np.ndarray = None  # for entry i of keys: the items' numbers from starts[i] to starts[i + 1], each with its weight
    weights: np.ndarray = None
    starts: np.ndarray = None

    def seal(self, coordinates: int) -> None:
        rng = np.random.default_rng(23)
        salts = rng.integers(1, 1 << 62, coordinates, np.uint64)
        by: dict[int, list[tuple[int, int]]] = defaultdict(list)
        for k, s in enumerate(self.sets):
            least = [int(s[np.argmin(mixed(s ^ salt))]) for salt in salts]
            for x, n in zip(*np.unique(np.array(least, np.uint64), return_counts=True), strict=True):
                by[int(x)].append((k, int(n)))
        keys = sorted(by)
        self.keys = np.array(keys, np.uint64)
        self.starts = np.concatenate([[0], np.cumsum([len(by[x]) for x in keys])]).astype(np.int64)
        self.owners = np.array([k for x in keys for k, _ in by[x]], np.int64)
        self.weights = np.array([n for x in keys for _, n in by[x]], np.int64)

    def contained(self, s: np.ndarray, percent: int) -> list[tuple[int, int, int]]:
        """(item, shingles found, shingles of the item) of the items that a document's set holds."""
        at = np.searchsorted(self.keys, s)
        hit = at[(at < len(self.keys)) & (self.keys[np.minimum(at, len(self.keys) - 1)] == s)] if len(self.keys) else at[:0]
        if not len(hit):
            return []
        where = np.concatenate([np.arange(self.starts[i], self.starts[i + 1]) for i in hit])
        score = np.bincount(self.owners[where], self.weights[where], len(self.items))
        out = []
        for k in np.flatnonzero(score >= self.least):
            found = int(np.isin(self.sets[k], s, assume_unique=True).sum())
            if 100 * found >= percent * len(self.sets[k]):
                out.append((self.items[k], found, len(self.sets[k])))
        return out


def partitions(items: list[tuple[int, str]], p: Params) -> list[Sizes]:
    """Items by the length of their shingles and the power of two of their number of shingles."""
    out: dict[tuple[int, int], Sizes] = {}
    for i, text in items:
        h = word_hashes(text)
        if not len(h):
            continue
        length = min(p.words, len(h))
        s = windows(h, length)
        # a set smaller than the sketch is wholly in it; of larger ones a sample is
        key = (length, min(len(s).bit_length(), 16))
        part = out.setdefault(key, Sizes(length, p.least if len(s) > 4 else 1))
        part.items.append(i)
        part.sets.append(s)
    for part in out.values():
        part.seal(p.coordinates)
    return [out[k] for k in sorted(out)]


_live: dict[str, list[Sizes]] = {}


def searches(docs: DataFrame, benchmark: DataFrame, p: Params, item_col: str, item_text_col: str) -> list:
    """For each block of items, a function from a text to the items it contains that runs on executors.

    Blocks are cut by a hash of the ids, so that each holds about ``block_chars`` characters, and
    fetched one by one.
    """
    items = benchmark.select(benchmark[item_col].cast("long").alias("item_id"), benchmark[item_text_col].cast("string").alias("text")).where("item_id is not null and text is not null").distinct()
    blocks, out = max(1, -(-(items.agg(F.sum(F.length("text"))).first()[0] or 0) // p.block_chars)), []
    for k in range(blocks):
        mine = sorted((r["item_id"], r["text"]) for r in items.where(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == k).collect())
        blob = pickle.dumps(partitions(mine, p))
        tag, sent = hashlib.sha256(blob).hexdigest(), docs.sparkSession.sparkContext.broadcast(blob)

        def find(text: str, tag: str = tag, sent=sent) -> list[tuple[int, int, int]]:
            if tag not in _live:
                _live.clear()
                _live[tag] = pickle.loads(sent.value)
            h, sets, found = word_hashes(text), {}, []
            for part in _live[tag]:
                if part.length not in sets:
                    sets[part.length] = windows(h, part.length)
                found += part.contained(sets[part.length], p.percent)
            return found

        out.append(find)
    return out


def contained_items(docs: DataFrame, benchmark: DataFrame, p: Params = Params(), id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """``doc_id, item_id, n_found, n_item`` of every document and every item that it contains.

    An item of fewer than ``words`` words is one shingle of its own length.  Items without words, with
    a null text or a null id are contained in nothing; a null or empty document contains nothing.
    Repeated documents give repeated rows, repeated items are one item.  Empty tables give an empty
    result.
    """
    rows, out = id_text(docs, id_col, text_col), None
    for find in searches(docs, benchmark, p, item_col, item_text_col):

        def run(batch: pa.RecordBatch, find=find) -> pa.RecordBatch:
            found = [(i, *x) for i, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True) for x in find(text)]
            columns = list(zip(*found, strict=True)) if found else [()] * 4
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["doc_id", "item_id", "n_found", "n_item"])

        here = map_batches(rows, run, "doc_id long, item_id long, n_found long, n_item long")
        out = here if out is None else out.unionByName(here)
    return out


def clean(docs: DataFrame, benchmark: DataFrame, p: Params = Params(), text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, with all their columns, that contain no item.

    Null and empty texts contain nothing and stay; rows with a null id are judged by their text; repeated rows
    stay or go together; without items all rows stay; an empty table gives an empty one.
    """
    for find in searches(docs, benchmark, p, item_col, item_text_col):
        docs = kept_rows(docs, lambda texts, find=find: [not find(t) for t in texts], text_col)
    return docs
