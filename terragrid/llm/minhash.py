"""MinHash near-dedup.

Circulant MinHash: one permutation spreads the hashed shingles over a circle of ``circle`` places;
coordinate k of a signature is the least value that a second permutation, shifted by k places,
gives to any shingle.  Coordinates are banded; documents that agree on a band are candidates, and
candidates are confirmed on their whole shingle sets.

Nothing here makes all pairs of a group.  Documents of equal sets are one class.  In a band's bucket
each class is first compared with the bucket's centre only: the class whose buckets hold the most
classes in all, which of copies of one text is that text.  The links found are contracted, and a
further round, with other centres, looks only at buckets whose classes still lie in different
components.  In the end every class is compared with every component that it shares a bucket with,
the smaller component asking the larger one: a component's members are cut into blocks, and those
who ask stream past a block, so that no pairs are written and no candidate between components is
left out.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass
from functools import lru_cache, reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import copied, dealt, hot, id_text, joined, map_batches, raw_texts, stored


@dataclass(frozen=True)
class Params:
    """Link where ``100 * intersection >= percent * union`` of sets of ``words``-word shingles.

    With the 45 bands of 7 a pair at 0.8 shares a bucket with probability 0.99997, one at 0.85 with
    1 - 4e-8, and one at 0.2 with 0.0006.  ``rounds``: so many rounds of centres come before the last
    comparison.  ``edges_per_task``: so many links are joined to components by one task.
    ``cell_docs``: about so many sets of each side are compared together.

    Before texts are fetched for the exact check, a pair's signatures are compared by one bit of each
    coordinate.  At the least similarity s a share of (1 + s) / 2 agrees; a pair more than ``sigmas`` standard
    deviations below (at six, once in 1e9) is no candidate.  Without ``sigmas`` every pair of a bucket is.

    ``hot_rows``: a key with more rows, or more than a thousandth of all rows, is dealt to several tasks.
    """

    words: int = 5
    percent: int = 80
    bands: int = 45
    rows: int = 7
    circle: int = 1 << 20
    seed: int = 11
    rounds: int = 2
    edges_per_task: int = 1 << 20
    cell_docs: int = 500
    sigmas: float | None = 6.0
    hot_rows: int = 1000


GOLD, M1, M2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads every bit."""
    x = (x ^ (x >> np.uint64(30))) * M1
    x = (x ^ (x >> np.uint64(27))) * M2
    return x ^ (x >> np.uint64(31))


def shingles(text: bytes, words: int) -> np.ndarray:
    """Sorted 64-bit hashes of the distinct shingles: words are runs of bytes that aren't ASCII white
    space, with A-Z in lower case; a shorter text is one shingle; none without words."""
    w = text.lower().split()
    if not w:
        return np.zeros(0, np.uint64)
    h = np.array(list(map(xxhash.xxh3_64_intdigest, w)), np.uint64)
    n = min(words, len(h))
    out = np.full(len(h) - n + 1, n, np.uint64)
    for k in range(n):
        out = mixed(out * GOLD + h[k : len(h) - n + 1 + k])
    return np.unique(out)


@lru_cache(maxsize=2)
def permutations(circle: int, seed: int, span: int) -> tuple[np.ndarray, np.ndarray]:
    """The first permutation, and windows of ``span`` places over the second one, closed to a circle."""
    rng = np.random.default_rng(seed)
    first, second = rng.permutation(circle).astype(np.int32), rng.permutation(circle).astype(np.int32)
    return first, np.lib.stride_tricks.sliding_window_view(np.concatenate([second, second[:span]]), span)


def signature(s: np.ndarray, p: Params) -> np.ndarray:
    """All coordinates of a set's signature."""
    first, windows = permutations(p.circle, p.seed, p.bands * p.rows)
    at = first[(s % np.uint64(p.circle)).astype(np.int64)]
    out = windows[at[:4096]].min(axis=0)
    for i in range(4096, len(at), 4096):
        np.minimum(out, windows[at[i : i + 4096]].min(axis=0), out=out)
    return out


def words_of_bits(p: Params) -> int:
    return -(-p.bands * p.rows // 64)


def most_different_bits(p: Params) -> int:
    """Bits in which two signatures may differ."""
    n, agree = p.bands * p.rows, (1 + p.percent / 100) / 2
    return n if p.sigmas is None else int(n * (1 - agree) + p.sigmas * (n * agree * (1 - agree)) ** 0.5) + 1


def packed_bits(sig: np.ndarray, p: Params) -> np.ndarray:
    """The lowest bit of each coordinate, in 64-bit integers."""
    bits = np.zeros(64 * words_of_bits(p), np.uint8)
    bits[: len(sig)] = sig & 1
    return np.packbits(bits).view(np.int64)


def buckets(signed: np.ndarray, p: Params) -> np.ndarray:
    """One 64-bit key for each band of a signature."""
    sig = signed.reshape(p.bands, p.rows).astype(np.uint64)
    out = np.arange(1, p.bands + 1, dtype=np.uint64) * GOLD
    for k in range(p.rows):
        out = mixed(out + sig[:, k] * M2 + GOLD)
    return out.view(np.int64)


def sketches(docs: DataFrame, p: Params) -> DataFrame:
    """``doc_id, n_shingles, k1, k2`` (128 bits of the set), ``bands`` and ``bits`` of each row."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        n, keys, bands, bits = [], [], [], []
        for text in raw_texts(batch):
            s = shingles(text, p.words)
            n.append(len(s))
            keys.append(hashlib.blake2b(s.tobytes(), digest_size=16).digest())
            sig = signature(s, p) if len(s) else None
            bands.append(buckets(sig, p) if len(s) else None)
            bits.append(packed_bits(sig, p) if len(s) else None)
        k = np.frombuffer(b"".join(keys), np.int64).reshape(-1, 2)
        return pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(k[:, 0]), pa.array(k[:, 1]), pa.array(bands, pa.list_(pa.int64())), pa.array(bits, pa.list_(pa.int64()))], ["doc_id", "n_shingles", "k1", "k2", "bands", "bits"])

    return map_batches(docs, run, "doc_id long, n_shingles long, k1 long, k2 long, bands array<long>, bits array<long>")


def rank(col: Column, turn: int) -> Column:
    """Another fixed random order of the ids for each turn."""
    return F.xxhash64(F.lit(f"turn{turn}"), col)


def centre(p: Params, turn: int, *more: str) -> Column:
    """The class of a bucket that is first in the turn's order, with its columns named ..._b: at first the one that
    meets the most classes, then another random one each turn."""
    first = -F.col("met") if turn == 0 else F.lit(0).cast("long")
    return F.min(F.struct(first.alias("first"), rank(F.col("rep"), turn).alias("r"), *(F.col(c).alias(f"{c}_b") for c in ("rep", "n", *bit_columns(p), *more)))).alias("m")


def bit_columns(p: Params) -> list[str]:
    return [f"x{k}" for k in range(words_of_bits(p))]


def may_link(p: Params) -> Column:
    """Do the sizes allow a link, and do the signatures agree well enough for one?"""
    a, b = F.col("n"), F.col("n_b")
    differ = reduce(lambda x, y: x + y, [F.bit_count(F.col(c).bitwiseXOR(F.col(f"{c}_b"))) for c in bit_columns(p)])
    return ((100 * F.least(a, b)) >= (p.percent * F.greatest(a, b))) & (differ <= most_different_bits(p))


def shingle_sets(docs: DataFrame, p: Params) -> DataFrame:
    """``doc_id, shingles``: the whole set as sorted 64-bit hashes."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        sets = [shingles(t, p.words).tobytes() for t in raw_texts(batch)]
        return pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(sets, pa.binary())], ["doc_id", "shingles"])

    return map_batches(docs, run, "doc_id long, shingles binary")


def confirmed(pairs: DataFrame, sets: DataFrame, p: Params) -> DataFrame:
    """The pairs (a, b) whose whole shingle sets are similar enough.

    Ids are dealt into groups of about ``cell_docs``; a pair of groups is a cell.  A set travels once to
    each cell that needs it, not once per pair; a partition streams its cells one after the other.
    """
    spark = pairs.sparkSession
    n = pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct().count()
    groups = max(1, -(-n // p.cell_docs))

    def group(c: str) -> Column:
        return F.pmod(F.xxhash64(F.lit("cell"), F.col(c)), F.lit(groups))

    asked = pairs.withColumn("cell", group("a") * groups + group("b"))
    needed = asked.select("cell", F.explode(F.array("a", "b")).alias("a")).distinct()
    sent = needed.join(sets.withColumnRenamed("doc_id", "a"), "a").select("cell", F.lit(0).alias("kind"), "a", F.lit(None).cast("long").alias("b"), "shingles")
    both = sent.unionByName(asked.select("cell", F.lit(1).alias("kind"), "a", "b", F.lit(None).cast("binary").alias("shingles")))
    ordered = both.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "cell").sortWithinPartitions("cell", "kind")

    def run(batches):
        cell, here = None, {}
        for batch in batches:
            found = []
            for c, kind, a, b, s in zip(*(batch.column(k).to_pylist() for k in ("cell", "kind", "a", "b", "shingles")), strict=True):
                if c != cell:
                    cell, here = c, {}
                if not kind:  # texts of one id may differ: any of them counts
                    here.setdefault(a, []).append(np.frombuffer(s, np.uint64))
                elif any(similar(x, y, p.percent) for x in here[a] for y in here[b]):
                    found.append((a, b))
            yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in found], pa.int64()) for k in (0, 1)], ["a", "b"])

    return ordered.mapInArrow(run, "a long, b long")


def asked_components(open_: DataFrame, hot_buckets: DataFrame, p: Params) -> DataFrame:
    """``rep, target``: the components that a class must be compared with.

    The smaller component asks the larger one (of equal ones the one with the lesser id); a component
    of a single class is asked only if the signatures agree well enough.  Classes of a hot bucket are
    dealt to several tasks, and none but those who may ask leave the task.
    """
    bits = bit_columns(p)
    single = [F.min(F.col(x)).alias(f"{x}_b") for x in ("n", *bits)]  # of a component of one class: that class's
    members = open_.select("rep", "n", "c", *bits).distinct()
    sizes = stored(members.groupBy("c").agg(F.count("*").alias("size"), *single), "sizes")
    hot_components = hot(sizes, "c", sizes.agg(F.sum("size")).first()[0] or 0, max(1, p.hot_rows // p.bands))  # a class has up to ``bands`` rows
    own = joined(open_, sizes.select("c", "size"), hot_components, "c", "rep")
    there = joined(open_.select("bucket", "c").distinct(), sizes.withColumnRenamed("size", "size_b"), hot_components, "c", "bucket").withColumnRenamed("c", "target")
    met = dealt(own, hot_buckets, "bucket", "rep").join(copied(there, hot_buckets, "bucket"), ["bucket", "piece"])
    met = met.where((F.col("size") < F.col("size_b")) | ((F.col("size") == F.col("size_b")) & (F.col("c") < F.col("target")))).where((F.col("size_b") > 1) | may_link(p))
    return met.select("rep", "target").distinct()


def confirmed_members(asks: DataFrame, members: DataFrame, sets: DataFrame, p: Params) -> DataFrame:
    """Links (a, b) of the classes that ask with the members (rep, c, bits) of the components they ask.

    A component's members are dealt into blocks of about ``cell_docs``, those who ask it into parts of
    about four times as many; a cell is one of each.
    """
    spark = asks.sparkSession
    bits = F.array(*bit_columns(p))
    members = members.withColumnRenamed("c", "target")
    held_by = members.groupBy("target").agg(F.count("*").alias("held"))
    asked_by = asks.groupBy("target").agg(F.count("*").alias("asked"))
    shape = asked_by.join(held_by, "target").select("target", (F.col("asked") + F.col("held")).alias("size"), F.ceil(F.col("held") / p.cell_docs).alias("blocks"), F.ceil(F.col("asked") / (4 * p.cell_docs)).alias("parts"))
    shape = stored(shape, "cells")
    hot_targets = hot(shape, "target", shape.agg(F.sum("size")).first()[0] or 0, p.hot_rows)
    shape = shape.drop("size")

    def block(c: str, n: str) -> Column:
        return F.pmod(F.xxhash64(F.lit("cell"), F.col(c)), F.col(n))

    def every(n: str) -> Column:
        return F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))

    signed = members.select("rep", bits.alias("bits"))
    held = joined(members.select("rep", "target", bits.alias("bits")), shape, hot_targets, "target", "rep").withColumn("block", block("rep", "blocks")).withColumn("part", every("parts"))
    asking = joined(asks, shape, hot_targets, "target", "rep").join(signed, "rep").withColumn("part", block("rep", "parts")).withColumn("block", every("blocks"))
    cell = ["target", "block", "part"]
    both = held.select(*cell, F.lit(0).alias("kind"), "rep", "bits").unionByName(asking.select(*cell, F.lit(1).alias("kind"), "rep", "bits"))
    sent = both.join(sets.withColumnRenamed("doc_id", "rep"), "rep")
    ordered = sent.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), *cell).sortWithinPartitions(*cell, "kind")
    most = most_different_bits(p)

    def run(batches):
        now, ids, signs, here, stacked = None, [], [], [], None
        for batch in batches:
            found = []
            for *at, kind, rep, x, s in zip(*(batch.column(k).to_pylist() for k in (*cell, "kind", "rep", "bits", "shingles")), strict=True):
                if at != now:
                    now, ids, signs, here, stacked = at, [], [], [], None
                mine = np.frombuffer(s, np.uint64)
                if not kind:
                    ids.append(rep), signs.append(x), here.append(mine)
                    continue
                if stacked is None:
                    stacked = np.array(signs, np.int64).view(np.uint64)
                differ = np.bitwise_count(stacked ^ np.array(x, np.int64).view(np.uint64)).sum(axis=1)
                for k in np.flatnonzero(differ <= most):
                    n, m = len(mine), len(here[k])
                    if 100 * min(n, m) >= p.percent * max(n, m) and similar(mine, here[k], p.percent):
                        found.append((rep, ids[k]))
            yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in found], pa.int64()) for k in (0, 1)], ["a", "b"])

    return ordered.mapInArrow(run, "a long, b long")


def similar(x: np.ndarray, y: np.ndarray, percent: int) -> bool:
    """Is the Jaccard similarity of two sorted sets at least ``percent`` hundredths?"""
    both = np.sort(np.concatenate([x, y]), kind="stable")
    common = int((both[1:] == both[:-1]).sum())
    return 100 * common >= percent * (len(both) - common)


def forest(batches):
    """Links of one task as (u, v), v the least id that u reaches by them."""
    parent: dict[int, int] = {}

    def root(x: int) -> int:
        while (y := parent.setdefault(x, x)) != x:
            parent[x] = parent[y]
            x = y
        return x

    for batch in batches:
        for a, b in zip(batch.column("a").to_pylist(), batch.column("b").to_pylist(), strict=True):
            x, y = root(a), root(b)
            if x != y:
                parent[max(x, y)] = min(x, y)
    nodes = list(parent)
    yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.array([root(x) for x in nodes], pa.int64())], ["u", "v"])


def components(edges: DataFrame, per_task: int = 1 << 20, hot_rows: int = 1000) -> DataFrame:
    """``id, component`` (the least id reachable) of every id on an edge (a, b).

    Every ``per_task`` edges are first joined by one task, which leaves one row per id.  If there are
    more edges, alternating large and small stars follow; each turn is a stored table, and the turns
    end when the edges no longer change.  Only sums reach the driver.
    """
    edges = stored(edges.select("a", "b").distinct(), "edges")
    tasks = max(1, -(-edges.count() // per_task))
    now = stored(edges.coalesce(tasks).mapInArrow(forest, "u long, v long"), "forest")
    if tasks == 1:
        return now.select(F.col("u").alias("id"), F.col("v").alias("component"))
    now, before = stored(now.where("u <> v").distinct(), "edges"), None
    while True:
        told = now.agg(F.count("*"), F.sum(F.hash("u", "v").cast("decimal(20,0)")), F.sum(F.xxhash64("v", "u").cast("decimal(38,0)"))).first()
        if told[0] == 0 or told == before:
            break
        before = told
        around = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = stored(around.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("size")), "least")
        hubs = hot(least, "u", 2 * told[0], hot_rows)
        large = joined(around, least.select("u", F.least("u", "m").alias("m")), hubs, "u", "v").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
        large = stored(large.distinct(), "large")
        least = stored(large.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("size")), "least")
        small = joined(large, least.select("u", "m"), hot(least, "u", large.count(), hot_rows), "u", "v")
        now = stored(small.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v"))).distinct(), "edges")
    return now.select(F.col("u").alias("id"), F.col("v").alias("component")).unionByName(now.select(F.col("v").alias("id"), F.col("v").alias("component"))).distinct()


def classes(docs: DataFrame, p: Params = Params(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, n_shingles, component_id, kept`` of every row.

    ``component_id`` is the least id of the row's component, ``kept`` whether it is the row's own id.
    A null or empty text has an empty set and is linked with nothing.  A row with a null id isn't
    linked: its component is null and it is kept.  Repeated rows (one id, one text) get equal results;
    different texts of one id share its links.  An empty table gives an empty result.
    """
    rows = id_text(docs, id_col, text_col)
    sketched = stored(sketches(rows, p), "sketches")
    linked = sketched.where(F.col("doc_id").isNotNull() & (F.col("n_shingles") > 0))
    # equal sets: one representative, by an aggregation that is combined before the shuffle
    same = stored(linked.groupBy("k1", "k2").agg(F.min("doc_id").alias("rep"), F.max("n_shingles").alias("n"), F.count("*").alias("size")), "classes")
    n_classes = same.count()
    reps = linked.select(F.col("doc_id").alias("rep"), "k1", "k2", "bands", "bits").join(same.drop("size"), ["rep", "k1", "k2"]).dropDuplicates(["rep", "k1", "k2"])
    spread = reps.select("rep", "n", F.explode("bands").alias("bucket"))
    # buckets of several classes; then the signatures' bits of those classes
    shared = stored(spread.groupBy("bucket").agg(F.count("*").alias("size")).where("size > 1"), "shared")
    hot_buckets = hot(shared, "bucket", n_classes * p.bands, p.hot_rows)
    spread = stored(joined(spread, shared, hot_buckets, "bucket", "rep").select("rep", "n", "bucket", "size"), "shared-buckets")
    met = spread.groupBy("rep", "n").agg(F.sum("size").alias("met"))
    signed = reps.select("rep", "n", *(F.col("bits")[k].alias(c) for k, c in enumerate(bit_columns(p)))).join(met, ["rep", "n"])
    spread = stored(spread.drop("size").join(signed, ["rep", "n"]), "buckets")
    texts = rows.join(spread.select(F.col("rep").alias("doc_id")).distinct(), "doc_id", "left_semi")
    sets = stored(shingle_sets(texts, p).dropDuplicates(["doc_id", "shingles"]), "sets")
    tried, of = None, None
    for turn in range(p.rounds + 1):
        if of is None:
            open_ = spread.withColumn("c", F.col("rep"))
        else:
            here = spread.join(of.select(F.col("id").alias("rep"), "component"), "rep", "left").withColumn("c", F.coalesce("component", "rep")).drop("component")
            several = here.groupBy("bucket").agg(F.min("c").alias("lo"), F.max("c").alias("hi")).where("lo <> hi").select("bucket")
            open_ = stored(joined(here, several, hot_buckets, "bucket", "rep"), "open")
            if not open_.take(1):  # every bucket lies in one component
                break
        if turn == p.rounds:
            asks = stored(asked_components(open_, hot_buckets, p), "asks")
            members = open_.select("rep", "c", *bit_columns(p)).distinct()
            good = stored(confirmed_members(asks, members, sets, p), "links")
        else:
            pairs = joined(open_, open_.groupBy("bucket").agg(centre(p, turn, "c")).select("bucket", "m.*"), hot_buckets, "bucket", "rep")
            pairs = pairs.where("c <> c_b").where(may_link(p)).select(F.greatest("rep", "rep_b").alias("a"), F.least("rep", "rep_b").alias("b")).distinct()
            if tried is not None:
                pairs = pairs.join(tried, ["a", "b"], "left_anti")
            pairs = stored(pairs, "pairs")
            tried = pairs if tried is None else tried.unionByName(pairs)
            good = stored(confirmed(pairs, sets, p), "links")
        # components of the links so far are one row per id, to which the new links are added
        links = good if of is None else good.unionByName(of.select(F.col("id").alias("a"), F.col("component").alias("b")))
        of = components(links, p.edges_per_task, p.hot_rows)
    # a class of many copies is a hot key; rows that nothing links need no class
    whole = same.join(of, same["rep"] == of["id"], "left").select(F.struct("k1", "k2").alias("k"), F.coalesce("component", "rep").alias("component_id"))
    copies = hot(same.withColumn("k", F.struct("k1", "k2")), "k", sketched.count(), p.hot_rows)
    mine = sketched.select("doc_id", "n_shingles", F.struct("k1", "k2").alias("k"))
    alone = F.col("doc_id").isNull() | (F.col("n_shingles") == 0)
    out = joined(mine.where(~alone), whole, copies, "k", "doc_id").select("doc_id", "n_shingles", "component_id")
    out = out.unionByName(mine.where(alone).select("doc_id", "n_shingles", F.col("doc_id").alias("component_id")))
    return out.withColumn("kept", F.coalesce(F.col("component_id") == F.col("doc_id"), F.lit(True)))


def deduplicated(docs: DataFrame, p: Params = Params(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, with all their columns, whose id is the least of its component.

    Rows with a null id, and texts without words, stay.  Rows of one id are one document: they stay or
    go together.
    """
    gone = classes(docs, p, id_col, text_col).where("not kept").select(F.col("doc_id").alias(id_col)).distinct()
    return docs.join(gone, id_col, "left_anti").select(docs.columns)
