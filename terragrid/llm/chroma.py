"""Chroma audio fingerprints.

A recording is cut into overlapping frames; the spectrum of a frame is folded into twelve pitch
classes.  Sixteen filters slide over this image, each the log ratio of two areas that an integral
image gives in constant time; two bits of each make a packed 32-bit integer per place.  Two
recordings are aligned by a histogram of the offsets at which their integers are equal, and confirmed
by the share of differing bits at the best offset.

A copy rarely begins on a frame's border, so a query is also cut at several phases between two
frames; at one of them its integers agree with those of the recording again.

Recordings with equal fingerprints are one class, and only classes are searched, by a join on the
integers: a run of equal integers counts once, at its head.  An integer that many queries and many
places share would make their product of rows; a query with such an integer takes no part in the join.
With all its integers it is fetched, in blocks of bounded size, and all classes stream past a block in
one map, which finds by the same votes what the join would and returns one partial result per query and
task.  Queries that are hardly more than one steady sound go that way with every place instead of heads.
"""

from __future__ import annotations

import hashlib
import pickle
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import lru_cache, reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import hot, joined, map_batches, small_batches, stored

PITCHES = 12
#: So many equal integers of queries and recordings are counted at once.
MOST_VOTES = 1 << 20


@dataclass(frozen=True)
class Params:
    """``most_bits``: two recordings match if at most this share of bits differs over at least
    ``least_overlap`` places at the offset with the most votes, of which there are ``least_votes``.
    Unrelated melodies agree so well over 8 places (a second) in one pair of some thousand, over 16 in none.
    ``phases``: a query is cut at so many places between two frames.  ``hot_rows``: an integer of which the join
    would make more rows than this has its queries streamed; it tells how a partner is found, not whether."""

    rate: int = 5512
    frame: int = 2048
    hop: int = 682
    low: float = 55.0
    high: float = 2000.0
    silence: float = 1e-4
    edge: float = 0.4
    width: int = 8
    phases: int = 4
    hot_rows: int = 1000
    least_votes: int = 2
    least_overlap: int = 16
    most_bits: float = 0.25
    block_codes: int = 1 << 18


def filters(width: int) -> list[tuple[int, int, int, int]]:
    """(kind, lowest pitch, pitches, frames): kinds split an area by pitch, by time, as a checkerboard, or middle against
    sides.  All halves are of equal size, so that each bit is set about as often as not."""
    some = [(k, (5 * (4 * j + k)) % (PITCHES - h + 1), h, width if (k + j) % 2 == 0 else width // 2) for j, h in enumerate((4, 6, 8)) for k in range(4)]
    return some + [(k, 0, PITCHES, w) for w in (width // 2, width) for k in (0, 2)]  # over all pitches, time tells nothing


@lru_cache(maxsize=4)
def folding(p: Params) -> np.ndarray:
    """Which spectrum bins count for which pitch class."""
    hz = np.arange(p.frame // 2 + 1) * p.rate / p.frame
    out = np.zeros((len(hz), PITCHES), np.float32)
    use = (hz >= p.low) & (hz <= p.high)
    out[np.flatnonzero(use), np.round(12 * np.log2(hz[use] / 440.0)).astype(int) % PITCHES] = 1
    return out


def chroma(samples: np.ndarray, p: Params) -> np.ndarray:
    """Pitch-class image of a recording: a row of length 1 per frame, zeros for a silent one."""
    if len(samples) < p.frame:
        return np.zeros((0, PITCHES))
    frames = np.lib.stride_tricks.sliding_window_view(samples, p.frame)[:: p.hop]
    window = np.hanning(p.frame).astype(np.float32)
    image = np.concatenate([(np.abs(np.fft.rfft(frames[i : i + 256].astype(np.float32) * window)) ** 2) @ folding(p) for i in range(0, len(frames), 256)]).astype(np.float64)
    norm = np.linalg.norm(image, axis=1, keepdims=True)
    return np.where(norm > p.silence * p.frame, image / np.maximum(norm, 1e-12), 0.0)


def fingerprint(samples: np.ndarray, p: Params) -> np.ndarray:
    """Packed integers of a recording; places whose frames are all silent are 0 and never vote."""
    image = chroma(samples, p)
    n = len(image) - p.width + 1
    if n <= 0:
        return np.zeros(0, np.uint32)
    whole = np.zeros((len(image) + 1, PITCHES + 1))
    whole[1:, 1:] = image.cumsum(axis=0).cumsum(axis=1)
    t = np.arange(n)

    def area(a: np.ndarray, b: np.ndarray, low: int, high: int) -> np.ndarray:
        return whole[b, high] - whole[a, high] - whole[b, low] + whole[a, low]

    out = np.zeros(n, np.uint32)
    for kind, y, h, w in filters(p.width):
        all_of, half, mid = area(t, t + w, y, y + h), t + w // 2, y + h // 2
        if kind == 0:
            first = area(t, t + w, y, mid)
        elif kind == 1:
            first = area(t, half, y, y + h)
        elif kind == 2:
            first = area(t, half, y, mid) + area(half, t + w, mid, y + h)
        else:
            first = area(t + w // 4, t + w - w // 4, y, y + h)
        value = np.log((1 + first) / (1 + all_of - first))
        level = (value > -p.edge).astype(np.uint32) + (value > 0) + (value > p.edge)
        out = (out << np.uint32(2)) | np.array([0, 1, 3, 2], np.uint32)[level]  # neighbours differ in one bit
    return np.where(area(t, t + p.width, 0, PITCHES) > 0, out, 0).astype(np.uint32)


def fingerprints(recordings: DataFrame, decode: Callable[[list], list[np.ndarray]], p: Params = Params(), id_col: str = "rec_id", media_col: str = "media", is_query: Column | None = None) -> DataFrame:
    """``rec_id, codes array<int>, phases array<array<int>>`` of every whole recording.

    ``decode`` turns a batch of the media column into samples between -1 and 1 at ``rate``.  A null
    or too short recording has no codes.  ``phases`` are the codes of a query, a condition on ``rec_id``, that is
    cut from later and later samples within the first frame; other recordings, and queries without codes, have none.
    A null id is a recording like any other; repeated rows are fingerprinted each; an empty table gives an empty result.
    """
    small_batches(recordings.sparkSession)

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        codes, phases = [], []
        for x, asks in zip(decode(batch.column("media").to_pylist()), batch.column("asks").to_pylist(), strict=True):
            codes.append(fingerprint(x, p).view(np.int32))
            phases.append([codes[-1], *(fingerprint(x[p.hop * k // p.phases :], p).view(np.int32) for k in range(1, p.phases))] if asks and len(codes[-1]) else None)
        return pa.RecordBatch.from_arrays([batch.column("rec_id"), pa.array(codes, pa.list_(pa.int32())), pa.array(phases, pa.list_(pa.list_(pa.int32())))], ["rec_id", "codes", "phases"])

    rows = recordings.select(recordings[id_col].cast("long").alias("rec_id"), recordings[media_col].alias("media"))
    asks = F.lit(False) if is_query is None else F.coalesce(is_query, F.lit(False))
    return map_batches(rows.withColumn("asks", asks), run, "rec_id long, codes array<int>, phases array<array<int>>")


def pcm16(media: list[bytes | None]) -> list[np.ndarray]:
    """Samples of little-endian 16-bit mono PCM."""
    return [np.frombuffer(x[: len(x) & ~1], "<i2") / 32768.0 if x else np.zeros(0) for x in media]


def align(a: np.ndarray, b: np.ndarray, offset: int) -> tuple[float, int]:
    """Share of differing bits, and places, where place k of a lies at place k + offset of b."""
    first, last = max(0, -offset), min(len(a), len(b) - offset)
    n = max(0, last - first)
    return (float(np.bitwise_count(a[first:last] ^ b[first + offset : last + offset]).sum()) / (32 * n) if n else 1.0), n


def voting(codes: np.ndarray, by_heads: bool) -> np.ndarray:
    """Places that vote: those that are not silent, or only the first of each run of equal codes."""
    return np.flatnonzero((codes != 0) & (codes != np.concatenate([codes[:0], [0], codes[:-1]])[: len(codes)]) if by_heads else codes)


class Block:
    """Queries, by the codes of all their phases."""

    def __init__(self, queries: list[tuple[int, list[list[int]]]], by_heads: bool) -> None:
        self.ids, self.by_heads = [i for i, _ in queries], by_heads
        self.codes = [[np.array(c, np.int32).view(np.uint32) for c in phases] for _, phases in queries]
        cut = [(q, k, c, voting(c, by_heads)) for q, phases in enumerate(self.codes) for k, c in enumerate(phases)]
        self.phases, none = max(map(len, self.codes), default=1), np.zeros(0, np.int64)
        flat = np.concatenate([*(c[at] for _, _, c, at in cut), none.astype(np.uint32)])
        order = np.argsort(flat, kind="stable")
        self.keys = flat[order]
        self.owner = np.concatenate([*(np.full(len(at), q * self.phases + k) for q, k, _, at in cut), none])[order]
        self.place = np.concatenate([*(at for *_, at in cut), none])[order]

    def matches(self, recordings: list[np.ndarray], p: Params) -> Iterator[tuple[int, int, int, float]]:
        """(recording, query, offset, share of differing bits) where a query aligns with a recording."""
        at = [voting(c, self.by_heads) for c in recordings]
        flat, place = np.concatenate([c[k] for c, k in zip(recordings, at, strict=True)]), np.concatenate(at)
        which, low = np.repeat(np.arange(len(at)), [len(k) for k in at]), np.searchsorted(self.keys, flat, "left")
        n = np.searchsorted(self.keys, flat, "right") - low
        met = np.flatnonzero(n)
        last = np.searchsorted(which[met], np.arange(len(at)), "right")  # of each recording
        total = np.concatenate([[0], np.cumsum(n[met])])
        first = 0
        while first < len(met):  # whole recordings, as many at once as have few votes
            fit = np.searchsorted(total[last], total[first] + MOST_VOTES, "right") - 1
            end = int(last[max(fit, which[met[first]])])
            yield from self.aligned(recordings, met[first:end], which, place, low, n, p)
            first = end

    def aligned(self, recordings: list[np.ndarray], met: np.ndarray, which: np.ndarray, place: np.ndarray, low: np.ndarray, n: np.ndarray, p: Params) -> Iterator[tuple[int, int, int, float]]:
        n = n[met]
        entry = np.repeat(low[met] - np.cumsum(n) + n, n) + np.arange(n.sum())
        shift = np.repeat(place[met], n) - self.place[entry]
        least, span = int(shift.min()), int(shift.max() - shift.min()) + 1
        votes, count = np.unique((np.repeat(which[met], n) * (len(self.codes) * self.phases) + self.owner[entry]) * span + (shift - least), return_counts=True)
        votes, count = votes[count >= p.least_votes], count[count >= p.least_votes]
        owner, shift = votes // span, votes % span + least
        pair, phase = owner // self.phases, owner % self.phases
        order = np.lexsort((phase, shift, np.abs(shift), -count, pair))  # by pair, then most votes, then the least shift
        best = order[np.concatenate([[True], pair[order][1:] != pair[order][:-1]])[: len(order)]]
        for k, q, offset, f in zip(*(x[best].tolist() for x in (pair // len(self.codes), pair % len(self.codes), shift, phase)), strict=True):
            share, places = align(self.codes[q][f], recordings[k], offset)
            if places >= p.least_overlap and share <= p.most_bits:
                yield k, q, offset, share


_live: dict[str, Block] = {}


def heads(codes: Column) -> Column:
    """(place, code) of the first of each run of equal codes; silence has none."""
    before = F.concat(F.array(F.lit(0)), codes)
    return F.filter(F.transform(codes, lambda c, k: F.struct(k.alias("place"), c.alias("code"), F.get(before, k).alias("last"))), lambda x: (x.code != 0) & (x.code != x["last"]))


def candidates(classes: DataFrame, asking: DataFrame, p: Params) -> tuple[DataFrame, DataFrame, DataFrame]:
    """``q, rep, phase, shift`` of the offset with the most votes for each pair of a query and a class that share
    ``least_votes`` integers at one offset; ``q`` of the queries with an integer that is too common for the join, and
    of those that have too few heads to tell: neither are among the first, and ``streamed`` finds all their partners."""
    postings = stored(classes.select("rep", F.explode(heads(F.col("codes"))).alias("h")).select("rep", "h.code", "h.place"), "postings")
    phase = asking.select(F.col("rep").alias("q"), F.posexplode("phases").alias("phase", "codes"))
    probes = stored(phase.select("q", "phase", F.explode(heads(F.col("codes"))).alias("h")).select("q", "phase", "h.code", F.col("h.place").alias("at")), "probes")
    few = stored(asking.select(F.col("rep").alias("q")).join(probes.where("phase = 0").groupBy("q").agg(F.count("*").alias("n")).where(F.col("n") >= p.least_overlap), "q", "left_anti"), "few")
    probes = probes.join(few, "q", "left_anti")
    asked, held = probes.groupBy("code").agg(F.count("*").alias("asked")), postings.groupBy("code").agg(F.count("*").alias("held"))
    common_codes = stored(asked.join(held, "code").where(F.col("asked") * F.col("held") > p.hot_rows).select("code"), "common")
    common = stored(probes.join(common_codes, "code", "left_semi").select("q").distinct(), "asking-common")
    votes = probes.join(common, "q", "left_anti").join(postings, "code").where("q <> rep").groupBy("q", "rep", "phase", (F.col("place") - F.col("at")).alias("shift")).agg(F.count("*").alias("n")).where(F.col("n") >= p.least_votes)
    best = F.max_by(F.struct("phase", "shift"), F.struct("n", -F.abs("shift"), -F.col("shift"), -F.col("phase"))).alias("b")
    return votes.groupBy("q", "rep").agg(best).select("q", "rep", "b.phase", "b.shift"), common, few


def confirmed(found: DataFrame, classes: DataFrame, asking: DataFrame, p: Params) -> DataFrame:
    """``q, rep, size, shift, share`` of the candidates whose bits agree well enough where they overlap."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        keep, shares = [], []
        for k, (a, b, shift) in enumerate(zip(*(batch.column(c).to_pylist() for c in ("mine", "codes", "shift")), strict=True)):
            share, places = align(np.array(a, np.int32).view(np.uint32), np.array(b, np.int32).view(np.uint32), shift)
            if places >= p.least_overlap and share <= p.most_bits:
                keep.append(k), shares.append(share)
        out = batch.select(["q", "rep", "size", "shift"]).take(pa.array(keep, pa.int64()))
        return pa.RecordBatch.from_arrays([*out.columns, pa.array(shares, pa.float64())], ["q", "rep", "size", "shift", "share"])

    mine = asking.select(F.col("rep").alias("q"), "phases")
    met = found.join(mine, "q").select("q", "rep", F.col("shift").cast("long").alias("shift"), F.get("phases", F.col("phase")).alias("mine")).join(classes.select("rep", "size", "codes"), "rep")
    return map_batches(met.select("q", "rep", "size", "shift", "mine", "codes"), run, "q long, rep long, size long, shift long, share double")


def streamed(classes: DataFrame, asking: DataFrame, p: Params, by_heads: bool) -> list[DataFrame]:
    """Partial results (``q, others, best_bits, best_id, best_offset``) of queries (rep, phases), by blocks that all
    classes stream past: ``others`` counts the members of the classes that align with a query, best_* tell the closest."""
    size = F.aggregate("phases", F.lit(0).cast("long"), lambda n, c: n + F.size(c))
    blocks, found = -(-(asking.agg(F.sum(size)).first()[0] or 0) // p.block_codes), []
    for k in range(blocks):
        mine = sorted((r["rep"], r["phases"]) for r in asking.where(F.pmod(F.xxhash64("rep"), F.lit(blocks)) == k).collect())
        blob = pickle.dumps((mine, by_heads))
        tag, sent = hashlib.sha256(blob).hexdigest(), classes.sparkSession.sparkContext.broadcast(blob)

        def run(batches: Iterator[pa.RecordBatch], tag: str = tag, sent=sent) -> Iterator[pa.RecordBatch]:
            if tag not in _live:
                _live.clear()
                _live[tag] = Block(*pickle.loads(sent.value))
            block, told = _live[tag], {}
            for batch in batches:
                reps, sizes = batch.column("rep").to_pylist(), batch.column("size").to_pylist()
                for c, q, shift, share in block.matches([np.array(x, np.int32).view(np.uint32) for x in batch.column("codes").to_pylist()], p) if reps else ():
                    if block.ids[q] != reps[c]:
                        n, best = told.get(q, (0, (2.0, 0, 0)))
                        told[q] = n + sizes[c], min(best, (share, reps[c], shift))
            rows = [(block.ids[q], n, *best) for q, (n, best) in told.items()]
            names, types = ["q", "others", "best_bits", "best_id", "best_offset"], (pa.int64(), pa.int64(), pa.float64(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array([x[j] for x in rows], t) for j, t in enumerate(types)], names)

        found.append(classes.select("rep", "size", "codes").mapInArrow(run, "q long, others long, best_bits double, best_id long, best_offset long"))
    return found


def search(prints: DataFrame, is_query: Column, p: Params = Params()) -> DataFrame:
    """``rec_id, n_codes, class_id, n_aligned, best_id, best_offset, best_bits`` of every recording.

    ``class_id`` is the least id of the recordings with an equal fingerprint.  For recordings that
    ``is_query`` admits, ``n_aligned`` counts the other recordings that align with it (its class
    included), and best_* tell the closest class other than its own: the fewest differing bits, then
    the least id.  Other recordings have nulls there.  Recordings without codes are a class of their own
    each and align with nothing, as do null ids; repeated rows count each.  An empty table gives an empty result.
    """
    asks = F.coalesce(is_query, F.lit(False)) & F.col("rec_id").isNotNull()
    phases = F.col("phases") if "phases" in prints.columns else F.lit(None).cast("array<array<int>>")
    rows = prints.select("rec_id", "codes", F.coalesce(phases, F.array("codes")).alias("phases"), F.size("codes").cast("long").alias("n_codes"), asks.alias("asks"))
    rows = stored(rows.withColumn("mark", F.when((F.col("n_codes") > 0) & F.col("rec_id").isNotNull(), F.sha2(F.array_join(F.col("codes").cast("array<string>"), ","), 256))), "prints")
    marked = rows.where("mark is not null")
    same = stored(marked.groupBy("mark").agg(F.min("rec_id").alias("rep"), F.count("*").alias("size"), F.max("asks").alias("asks"), F.min_by("rec_id", F.struct(~F.col("asks"), F.col("rec_id"))).alias("first")), "same")
    classes = stored(marked.select("mark", F.col("rec_id").alias("rep"), "codes").join(same.select("mark", "rep", "size"), ["mark", "rep"]).dropDuplicates(["mark"]), "classes")
    # a class asks with the phases of the first of its members that is a query
    asking = marked.select("mark", F.col("rec_id").alias("first"), "phases").join(same.where("asks").select("mark", "first", "rep"), ["mark", "first"]).dropDuplicates(["mark"])
    asking = stored(asking.select("rep", "phases"), "asking")
    found, common, few = candidates(classes, asking, p)
    parts = [confirmed(found, classes, asking, p).select("q", F.col("size").alias("others"), F.col("share").alias("best_bits"), F.col("rep").alias("best_id"), F.col("shift").alias("best_offset"))]
    parts += streamed(classes, asking.join(common.withColumnRenamed("q", "rep"), "rep", "left_semi"), p, True)
    parts += streamed(classes, asking.join(few.withColumnRenamed("q", "rep"), "rep", "left_semi").withColumn("phases", F.slice("phases", 1, 1)), p, False)
    best = F.min(F.struct("best_bits", "best_id", "best_offset")).alias("b")
    total = reduce(DataFrame.unionByName, parts).groupBy(F.col("q").alias("rep")).agg(F.sum("others").alias("others"), best).select("rep", "others", "b.*")
    told = same.select("mark", "rep", "size").join(total, "rep", "left").withColumnRenamed("rep", "class")
    of_class = hot(same, "mark", rows.count(), p.hot_rows)
    out = joined(rows.where("mark is not null").select("rec_id", "n_codes", "mark", "asks"), told, of_class, "mark", "rec_id")
    out = out.select("rec_id", "n_codes", "asks", "class", "size", "others", "best_id", "best_offset", "best_bits").unionByName(rows.where("mark is null").select("rec_id", "n_codes", "asks", F.col("rec_id").alias("class"), *(F.lit(None).cast(t).alias(c) for c, t in (("size", "long"), ("others", "long"), ("best_id", "long"), ("best_offset", "long"), ("best_bits", "double")))))
    return out.select("rec_id", "n_codes", F.col("class").alias("class_id"), F.when(F.col("asks"), F.coalesce(F.col("size") - 1, F.lit(0)) + F.coalesce("others", F.lit(0))).alias("n_aligned"), *(F.when(F.col("asks"), F.col(c)).alias(c) for c in ("best_id", "best_offset", "best_bits")))


def tones(p: Params = Params(), seconds: float = 0.125) -> Callable[[list], list[np.ndarray]]:
    """Decoder of a vector as a melody: one tone per value, of the twelve above A, higher for larger values."""
    n = int(p.rate * seconds)

    def decode(media: list[list[float] | None]) -> list[np.ndarray]:
        out = []
        for x in media:
            v = np.nan_to_num(np.array([y or 0.0 for y in x or []], np.float64))
            pitch = np.clip(np.floor(PITCHES * (0.5 + 0.5 * np.tanh(0.8 * v * len(v) ** 0.5))), 0, PITCHES - 1)
            out.append(np.sin(2 * np.pi * np.cumsum(np.repeat(110.0 * 2 ** (pitch / PITCHES), n)) / p.rate))
        return out

    return decode
