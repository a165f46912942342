"""Line dedup.

A line's key is the line without ASCII white space at its ends, with A-Z in lower case.  A key of at
least ``min_chars`` code points that is found in at least ``min_docs`` documents loses all its lines
but those in the document with the largest id.

Hashes of keys are range-partitioned and sorted by (hash, document descending, position).  A single
pass over each partition streams the first occurrences: the first document of a hash keeps its lines,
those of the second wait until a third is seen, later ones go at once.  The ranges are over hash *and*
document, so a very frequent line spreads over many partitions; the few hashes that cross a border
are settled with one summary row per partition and border.  What comes back is a compressed bitmap of
kept lines per document, not text.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import id_text, map_batches, raw_texts, stored

#: ASCII white space: what ``bytes.strip`` strips.
SPACE = b" \t\n\r\x0b\x0c"
ROWS = 1 << 16


@dataclass(frozen=True)
class Params:
    min_chars: int = 20
    min_docs: int = 3


def keys(text: bytes, p: Params) -> Iterator[tuple[int, bytes]]:
    """Place and key of each line that is long enough."""
    plain = text.isascii()
    for k, line in enumerate(text.lower().split(b"\n")):
        line = line.strip(SPACE)
        if len(line) >= p.min_chars and (plain or len(line.decode()) >= p.min_chars):
            yield k, line


def text_key(text: Column) -> Column:
    """Tells rows of one id with different texts apart."""
    return F.hash(text)


def hashed_lines(docs: DataFrame, p: Params) -> DataFrame:
    """``h1, h2`` (96 bits of a key's hash), ``doc_id, version, line``."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        digests, ids, versions, lines = [], [], [], []
        for i, v, text in zip(batch.column("doc_id").to_pylist(), batch.column("version").to_pylist(), raw_texts(batch), strict=True):
            n = len(lines)
            for k, key in keys(text, p):
                digests.append(xxhash.xxh3_128_digest(key))
                lines.append(k)
            ids += [i] * (len(lines) - n)
            versions += [v] * (len(lines) - n)
        h = np.frombuffer(b"".join(digests), ">i8").reshape(-1, 2).astype(np.int64)
        return pa.RecordBatch.from_arrays([pa.array(h[:, 0]), pa.array((h[:, 1] >> 32).astype(np.int32)), pa.array(ids, pa.int64()), pa.array(versions, pa.int32()), pa.array(lines, pa.int32())], ["h1", "h2", "doc_id", "version", "line"])

    rows = docs.where(F.col("doc_id").isNotNull() & (F.col("text") != "")).select("doc_id", text_key(F.col("text")).alias("version"), "text")
    return map_batches(rows, run, "h1 long, h2 int, doc_id long, version int, line int")


#: drop: this line goes.  pending: it may go, if the hash's other parts say so.  part: documents of a hash on one side of a border.
DROP, PENDING, PART = 0, 1, 2
STREAMED = "kind byte, h1 long, h2 int, doc_id long, version int, line int, docs long"


def streamed(batches: Iterator[pa.RecordBatch], min_docs: int) -> Iterator[pa.RecordBatch]:
    """One pass over a partition sorted by hash, document descending, line."""

    def rows(kind: int, a: np.ndarray, docs: int = 0) -> pa.RecordBatch:
        n = len(a)
        return pa.RecordBatch.from_arrays(
            [pa.array(np.full(n, kind, np.int8)), pa.array(a["h1"]), pa.array(a["h2"]), pa.array(a["doc_id"]), pa.array(a["version"]), pa.array(a["line"]), pa.array(np.full(n, docs, np.int64))],
            ["kind", "h1", "h2", "doc_id", "version", "line", "docs"],
        )

    kind = np.dtype([("h1", np.int64), ("h2", np.int32), ("doc_id", np.int64), ("version", np.int32), ("line", np.int32)])
    held = np.zeros(0, kind)  # lines of the current hash that may still be kept or go: of at most min_docs - 1 documents
    key, first, docs, last_doc = None, True, 0, None  # the current hash; is it the partition's first; its documents so far; the last of them
    top = None  # the current hash's first document

    def border() -> Iterator[pa.RecordBatch]:
        """The current hash touches a border of the partition."""
        yield rows(PART, top, docs)
        if len(held):
            yield rows(PENDING, held)

    for batch in batches:
        a = np.empty(batch.num_rows, kind)
        for name in kind.names:
            a[name] = batch.column(name).to_numpy()
        if not len(a):
            continue
        new = np.concatenate([[True], (a["h1"][1:] != a["h1"][:-1]) | (a["h2"][1:] != a["h2"][:-1])])
        starts = np.flatnonzero(new)
        if key == (a["h1"][0], a["h2"][0]):
            starts = starts[1:]
        # the current hash goes on, up to its end in this batch
        end = starts[0] if len(starts) else len(a)
        if end:
            more = a[:end]
            fresh = np.concatenate([[more["doc_id"][0] != last_doc], more["doc_id"][1:] != more["doc_id"][:-1]])
            docs, last_doc = docs + int(fresh.sum()), more["doc_id"][-1]
            if first:
                yield rows(PENDING, more)
            else:
                held = np.concatenate([held, more])
        if len(starts) == 0:
            if not first and docs >= min_docs:
                yield rows(DROP, held[held["doc_id"] != top["doc_id"][0]])
                held = held[:0]
            continue
        if key is not None:
            if first:
                yield from border()
            elif docs >= min_docs:
                yield rows(DROP, held[held["doc_id"] != top["doc_id"][0]])
        elif len(starts):  # the partition's first hash
            key = (a["h1"][0], a["h2"][0])
            stop = starts[1] if len(starts) > 1 else len(a)
            part = a[:stop]
            docs, last_doc, top = 1 + int((part["doc_id"][1:] != part["doc_id"][:-1]).sum()), part["doc_id"][-1], part[:1].copy()
            yield rows(PENDING, part)
            starts = starts[1:]
            if len(starts) == 0:
                continue
            yield from border()
        # hashes that begin and end in this batch, then the one that may go on
        body, rest = a[starts[0] : starts[-1]], a[starts[-1] :]
        if len(body):
            at = starts[:-1] - starts[0]
            run = np.zeros(len(body), np.int64)
            run[at[1:]] = 1
            run = np.cumsum(run)
            fresh = np.concatenate([[True], (body["doc_id"][1:] != body["doc_id"][:-1]) | (run[1:] != run[:-1])])
            number = np.add.reduceat(fresh.astype(np.int64), at)
            go = (number[run] >= min_docs) & (body["doc_id"] != body["doc_id"][at][run])
            yield rows(DROP, body[go])
        key, first = (rest["h1"][0], rest["h2"][0]), False
        docs, last_doc, top = 1 + int((rest["doc_id"][1:] != rest["doc_id"][:-1]).sum()), rest["doc_id"][-1], rest[:1].copy()
        held = rest.copy()
        if docs >= min_docs:
            yield rows(DROP, held[held["doc_id"] != top["doc_id"][0]])
            held = held[:0]
    if key is not None:
        yield from border()


def dropped_lines(docs: DataFrame, p: Params) -> DataFrame:
    """``doc_id, version, line`` of every line that goes."""
    spark = docs.sparkSession
    lines = stored(hashed_lines(docs, p), "lines")
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 1)
    dealt = lines.repartitionByRange(parts, "h1", "h2", F.desc("doc_id")).sortWithinPartitions("h1", "h2", F.desc("doc_id"), "version", "line")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for out in streamed(batches, p.min_docs):
            if out.num_rows:
                yield out

    seen = stored(dealt.mapInArrow(run, STREAMED), "streamed")
    # at most two summaries a partition, so this side is bounded by the number of partitions
    crossing = seen.where(F.col("kind") == PART).groupBy("h1", "h2").agg(F.sum("docs").alias("all_docs"), F.max("doc_id").alias("top_doc")).where(F.col("all_docs") >= p.min_docs)
    late = seen.where(F.col("kind") == PENDING).join(F.broadcast(crossing), ["h1", "h2"]).where(F.col("doc_id") != F.col("top_doc"))
    names = ["doc_id", "version", "line"]
    return seen.where(F.col("kind") == DROP).select(names).unionByName(late.select(names))


def pack(n_lines: int, dropped: list[int]) -> bytes:
    """Compressed bits of a document's lines, 1 for those kept."""
    bits = np.ones(n_lines, np.uint8)
    bits[dropped] = 0
    return zlib.compress(np.packbits(bits).tobytes())


def unpack(n_lines: int, bitmap: bytes) -> np.ndarray:
    return np.unpackbits(np.frombuffer(zlib.decompress(bitmap), np.uint8), count=n_lines).astype(bool)


def keep_bitmaps(docs: DataFrame, p: Params = Params(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, version, n_lines, n_dropped, keep_bitmap`` of every distinct (id, text).

    ``version`` tells texts of one id apart.  A null or empty text is one empty line, which is kept.
    Lines of a null id take no part and are kept.  Repeated rows count as one document.  An empty
    table gives an empty result.
    """
    rows = id_text(docs, id_col, text_col)
    gone = dropped_lines(rows, p).groupBy("doc_id", "version").agg(F.collect_set("line").alias("gone"))
    sizes = rows.select("doc_id", text_key(F.col("text")).alias("version"), (F.length("text") - F.length(F.replace("text", F.lit("\n"))) + 1).cast("long").alias("n_lines")).distinct()
    both = sizes.join(gone, ["doc_id", "version"], "left")

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        gone = [x or [] for x in batch.column("gone").to_pylist()]
        maps = [pack(n, x) for n, x in zip(batch.column("n_lines").to_pylist(), gone, strict=True)]
        return pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("doc_id", "version", "n_lines")), pa.array([len(x) for x in gone], pa.int64()), pa.array(maps, pa.binary())], ["doc_id", "version", "n_lines", "n_dropped", "keep_bitmap"])

    return map_batches(both, run, "doc_id long, version int, n_lines long, n_dropped long, keep_bitmap binary")


def apply_bitmaps(docs: DataFrame, bitmaps: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, version, n_lines, n_dropped, kept`` for every row: the text of the lines kept, joined by a line feed.

    Only bitmaps with a dropped line are joined; the other rows keep their text.  A null text counts as an
    empty one, which is one empty line; a row with a null id keeps all lines; repeated rows are kept alike; an
    empty table gives an empty result.
    """
    rows = id_text(docs, id_col, text_col).withColumn("version", text_key(F.col("text")))
    some = bitmaps.where((F.col("n_dropped") > 0) & F.col("doc_id").isNotNull()).select("doc_id", "version", "keep_bitmap")
    both = rows.join(some, ["doc_id", "version"], "left")

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        counts, gone, kept = [], [], []
        for text, bitmap in zip(raw_texts(batch), batch.column("keep_bitmap").to_pylist(), strict=True):
            n = text.count(b"\n") + 1
            counts.append(n)
            if bitmap is None:
                gone.append(0), kept.append(text)
                continue
            keep = unpack(n, bitmap)
            gone.append(n - int(keep.sum()))
            kept.append(b"\n".join(x for x, k in zip(text.split(b"\n"), keep, strict=True) if k))
        return pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("version"), pa.array(counts, pa.int64()), pa.array(gone, pa.int64()), pa.array(kept, pa.binary()).cast(pa.string())], ["doc_id", "version", "n_lines", "n_dropped", "kept"])

    return map_batches(both, run, "doc_id long, version int, n_lines long, n_dropped long, kept string")


def deduplicated(docs: DataFrame, p: Params = Params(), id_col: str = "doc_id", text_col: str = "text", chars_col: str = "n_chars") -> DataFrame:
    """The rows of ``docs``, with all their columns, with the text of the lines kept.

    ``chars_col``, where there is such a column, follows the text.  A row that had words and has lost
    all of them goes: each of its lines is in another document.  Null and empty texts stay, as do rows with a
    null id; repeated rows stay or go together; an empty table gives an empty one.
    """
    version, bitmap, key = "__terragrid_version", "__terragrid_bitmap", "__terragrid_id"
    some = keep_bitmaps(docs, p, id_col, text_col).where((F.col("n_dropped") > 0) & F.col("doc_id").isNotNull()).select(F.col("doc_id").alias(key), F.col("version").alias(version), F.col("keep_bitmap").alias(bitmap))
    rows = docs.withColumn(version, text_key(F.coalesce(F.col(text_col), F.lit(""))))
    both = rows.join(some, (rows[id_col].cast("long") == some[key]) & (rows[version] == some[version]), "left").select(*(rows[c] for c in docs.columns), some[bitmap])
    at, chars = docs.columns.index(text_col), docs.columns.index(chars_col) if chars_col in docs.columns else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, stay = raw_texts(batch, text_col), []
            for i, bits in enumerate(batch.column(bitmap).to_pylist()):
                if bits is not None:
                    lines = texts[i].split(b"\n")
                    texts[i] = b"\n".join(x for x, k in zip(lines, unpack(len(lines), bits), strict=True) if k)
                stay.append(bits is None or bool(texts[i].strip(SPACE)))
            columns = batch.columns[: len(batch.schema) - 1]
            columns[at] = pa.array(texts, pa.binary()).cast(columns[at].type)
            if chars is not None:
                columns[chars] = pa.array([None if x is None else len(x.decode()) for x in texts], columns[chars].type)
            yield pa.RecordBatch.from_arrays(columns, names=batch.schema.names[:-1]).filter(pa.array(stay, pa.bool_()))

    return both.mapInArrow(run, docs.schema)
