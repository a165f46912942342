"""A pipeline over ``documents`` in five stages, each of which applies one operator to all that the stage before kept.

Quality classifier, line dedup, MinHash near-dedup, benchmark decontamination, BPE.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from terragrid.llm import bpe, decontam, linededup, minhash, quality
from terragrid.llm.common import crc_mod, stored
from terragrid.llm.queries import WORD_BPE, table


def good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier rejects go.  Labels of a fifth of the ids aren't learnt from.

    Null and empty texts are scored like any text without tokens; repeated rows alike; no rows give none.
    """
    return quality.admitted(docs, quality.fit(docs, table(spark, sf_dir, "labels"), crc_mod(F.col("doc_id"), 5) != 0))


def fresh_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines found in three documents or more stay in one of them; documents that lose all their lines go.

    Null and empty texts, and rows with a null id, stay as they are; repeated rows alike; no rows give none.
    """
    return linededup.deduplicated(docs)


def distinct(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays: five-word shingles, similarity of at least 0.8.

    Texts without words and rows with a null id are no copies of anything and stay; rows of one id are one document.
    """
    return minhash.deduplicated(docs)


def clean(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that contain a benchmark item go.

    Null and empty texts, and null or empty items, contain nothing and are contained in nothing.
    """
    return decontam.clean(docs, table(spark, sf_dir, "benchmark"))


def coded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Ids of every text and what they decode to.

    A null or empty text has no ids and decodes to an empty one; repeated rows give repeated rows.
    """
    return bpe.encode(docs, WORD_BPE).select("doc_id", F.size("ids").cast("long").alias("n_tokens"), "ids", "decoded")


STAGES = [("quality", good), ("line dedup", fresh_lines), ("near dedup", distinct), ("decontamination", clean), ("bpe", coded)]

#: A trained classifier, and groups by MinHash buckets, can't be said in SQL; tests/llm compares run() with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each stage's rows are written and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)


def queries() -> dict:
    return {"pipeline": run}


def oracle_sql() -> dict[str, str]:
    return {} if ORACLE_SQL is None else {"pipeline": ORACLE_SQL}
