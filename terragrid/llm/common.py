"""What the corpus operators share: scratch tables, Arrow helpers, fixed samples.

Conventions of every operator here
----------------------------------
* It reads only the columns it names (``id_col``, ``text_col``) and works under
  names of its own, so extra columns of the input can't clash with its results.
* A null text counts as an empty text.  A null id is a row of its own: it is
  returned, but takes no part in anything that links documents.
* Rows are never dropped, capped or sampled, unless the docstring names the
  parameter that bounds a *training* sample.
"""

from __future__ import annotations

import atexit
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows and bytes of an Arrow batch, whichever is reached first.
BATCH_ROWS, BATCH_BYTES = 1000, 1 << 24

_made: list[tuple[SparkSession, str]] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder named in ``spark.checkpoint.dir``; one of our own only where it is unset and all tasks
    run on this machine.  Executors elsewhere couldn't share it, so that is an error."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    now = spark.sparkContext.getCheckpointDir()
    if now:
        return now.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
    spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="terragrid-"))
    return spark.sparkContext.getCheckpointDir().rstrip("/")


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as a table in the shared folder and read it back: cuts the lineage for good,
    survives lost executors, and lets later steps prune columns."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/terragrid-{uuid.uuid4().hex}-{name}"
    df.write.parquet(path)
    _made.append((spark, path))
    return spark.read.schema(df.schema).parquet(path)


def forget(spark: SparkSession) -> None:
    """Delete every scratch table of this process; call it when the results have been consumed."""
    for s, path in list(_made):
        if s is spark:
            try:
                jvm = spark.sparkContext._jvm
                where = jvm.org.apache.hadoop.fs.Path(path)
                where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)
            except Exception:  # the session has ended: nothing can be deleted through it
                return
            _made.remove((s, path))


@atexit.register
def _forget_all() -> None:
    for spark in {id(s): s for s, _ in _made}.values():
        forget(spark)


def small_batches(spark: SparkSession) -> None:
    """Arrow batches of at most BATCH_ROWS rows and about BATCH_BYTES bytes, so that a batch of long texts fits a
    Python worker.  The session keeps the smaller settings: plans read them when they run."""
    for key, most in (("maxRecordsPerBatch", BATCH_ROWS), ("maxBytesPerBatch", BATCH_BYTES)):
        key = f"spark.sql.execution.arrow.{key}"
        now = spark.conf.get(key).lower().removesuffix("b")
        if not (now.isdigit() and 0 < int(now) <= most):
            spark.conf.set(key, str(most))


def id_text(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The two columns an operator reads, under fixed names; a null text becomes an empty one."""
    small_batches(docs.sparkSession)
    return docs.select(docs[id_col].cast("long").alias("doc_id"), F.coalesce(docs[text_col].cast("string"), F.lit("")).alias("text"))


def map_batches(df: DataFrame, f: Callable[[pa.RecordBatch], pa.RecordBatch | None], schema: str) -> DataFrame:
    """``mapInArrow`` of a function on single batches."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if (out := f(batch)) is not None and out.num_rows:
                yield out

    return df.mapInArrow(run, schema)


def raw_texts(batch: pa.RecordBatch, name: str = "text") -> list[bytes]:
    """UTF-8 bytes of a string column, without decoding."""
    return batch.column(name).cast(pa.binary()).to_pylist()


def crc_mod(col: Column, n: int) -> Column:
    """crc32 of the id as text, modulo n."""
    return F.crc32(col.cast("string").cast("binary")) % n


def fixed_share(col: Column, share: float, salt: str) -> Column:
    """True for about ``share`` of the values of ``col``, always the same ones."""
    return F.pmod(F.xxhash64(F.lit(salt), col), F.lit(1 << 30)) < F.lit(int(min(1.0, share) * (1 << 30)))


def hot(sizes: DataFrame, key: str, total: int, most: int, size: str = "size") -> DataFrame:
    """``key, pieces`` of the keys that hold more than ``most`` and more than a thousandth of ``total`` rows.

    As the sizes sum to ``total``, there are at most a thousand of them, whatever the input: they may be
    broadcast.  A piece has as many rows as a key that just isn't hot.
    """
    limit = max(most, total // 1000)
    return F.broadcast(sizes.where(F.col(size) > limit).select(key, F.ceil(F.col(size) / limit).cast("int").alias("pieces")))


def dealt(rows: DataFrame, hot_keys: DataFrame, key: str, by: str) -> DataFrame:
    """The rows with a ``piece``: those of a hot key are dealt to its pieces, the others are piece 0.  No shuffle."""
    return rows.join(hot_keys, key, "left").withColumn("piece", F.pmod(F.xxhash64(F.lit("piece"), F.col(by)), F.coalesce("pieces", F.lit(1))).cast("int")).drop("pieces")


def copied(rows: DataFrame, hot_keys: DataFrame, key: str) -> DataFrame:
    """The rows once for each piece of their key, to be joined with dealt ones by key and piece."""
    return rows.join(hot_keys, key, "left").withColumn("piece", F.explode(F.sequence(F.lit(0), F.coalesce("pieces", F.lit(1)) - 1))).drop("pieces")


def joined(rows: DataFrame, facts: DataFrame, hot_keys: DataFrame, key: str, by: str, how: str = "inner") -> DataFrame:
    """Rows with the facts of their key, so that no task gets all rows of a hot key."""
    return dealt(rows, hot_keys, key, by).join(copied(facts, hot_keys, key), [key, "piece"], how).drop("piece")


def kept_rows(docs: DataFrame, keeps: Callable[[list[str]], list[bool]], text_col: str = "text") -> DataFrame:
    """The rows, with all their columns, whose texts ``keeps`` admits; one map without a shuffle."""
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(keeps([t or "" for t in batch.column(text_col).to_pylist()]), pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
