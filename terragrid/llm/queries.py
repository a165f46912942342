"""The queries of this subpackage: each applies one operator to the whole of its table."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, chroma, decontam, lang, license, linededup, minhash, pii, quality, tokencount
from .common import crc_mod

#: Where the vocabulary files of public tokenizers are; only read, never copied.
WORD_BPE = public_tokenizers.path("word_bpe_49k.json")
PIECES = public_tokenizers.path("piece_bpe_32k.model")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Unigram tokens of every whole text."""
    return tokencount.counts(table(spark, sf_dir, "documents"), PIECES)


def op3_chroma_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every vector of ``embeddings``, played as a melody, is fingerprinted; every twentieth id is searched for among all."""
    asks = F.col("rec_id") % 20 == 0
    prints = chroma.fingerprints(table(spark, sf_dir, "embeddings"), chroma.tones(), id_col="vec_id", media_col="embedding", is_query=asks)
    return chroma.search(prints, asks).withColumnRenamed("rec_id", "vec_id")


def op4_pii_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every whole text with keyed surrogates, and the types of what was replaced.  The key is for tests only."""
    replaced = pii.surrogates(table(spark, sf_dir, "documents"), b"terragrid: a key for tests only")
    return replaced.select("doc_id", F.size("entities").cast("long").alias("n_entities"), F.array_join(F.transform("entities", lambda e: e["type"]), ",").alias("types"), "text")


def op5_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Licence of every document, its own or its directory's, over a tree of files made from the ids."""
    files = table(spark, sf_dir, "documents").select(F.col("doc_id"), license.corpus_path(F.col("doc_id")).alias("path"), "text")
    return license.scan(files, "doc_id").withColumnRenamed("file_id", "doc_id")


OP5_SQL = license.scan_sql(f"SELECT doc_id AS file_id, {license.CORPUS_PATH_SQL} AS path, coalesce(text, '') AS text FROM documents").replace("SELECT f.file_id,", "SELECT f.file_id AS doc_id,")


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Calibrated quality of every whole text; a fifth of the ids is never learnt from."""
    docs = table(spark, sf_dir, "documents")
    model = quality.fit(docs, table(spark, sf_dir, "labels"), crc_mod(F.col("doc_id"), 5) != 0)
    return quality.score(docs, model).select(
        "doc_id", (crc_mod(F.col("doc_id"), 5) == 0).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted")
    )


def op6_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Component of every document under links of at least 0.8 on two-word shingles."""
    return minhash.classes(table(spark, sf_dir, "documents"), minhash.Params(words=2))


OP6_SQL = r"""
WITH RECURSIVE words AS (
  SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[ 	-
]+'), lambda x: x <> '') AS w FROM documents
), sets AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) = 1 THEN w ELSE list_distinct(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) END AS s FROM words
), sized AS (SELECT doc_id, s, len(s) AS n FROM sets),
flat AS (SELECT doc_id, n, unnest(s) AS x FROM sized),
common AS (
  SELECT a.doc_id AS a, b.doc_id AS b, any_value(a.n) AS na, any_value(b.n) AS nb, count(*) AS k
  FROM flat a JOIN flat b ON a.x = b.x AND a.doc_id < b.doc_id AND 100 * least(a.n, b.n) >= 80 * greatest(a.n, b.n) GROUP BY 1, 2
), links AS (SELECT a, b FROM common WHERE 100 * k >= 80 * (na + nb - k)),
both_ways AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach AS (SELECT doc_id, doc_id AS c FROM sized UNION SELECT b.b, r.c FROM reach r JOIN both_ways b ON r.doc_id = b.a)
SELECT s.doc_id, CAST(s.n AS BIGINT) AS n_shingles, min(r.c) AS component_id, min(r.c) = s.doc_id AS kept
FROM sized s JOIN reach r ON s.doc_id = r.doc_id GROUP BY s.doc_id, s.n
"""


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines that stay in each whole text, from the keep bitmaps."""
    docs = table(spark, sf_dir, "documents")
    kept = linededup.apply_bitmaps(docs, linededup.keep_bitmaps(docs))
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2("kept", 256).alias("kept_sha256"))


OP7_SQL = r"""
WITH lines AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, unnest(range(len(string_split(coalesce(text, ''), chr(10))))) AS k
  FROM documents
), keyed AS (
  SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM lines
), often AS (
  SELECT key, max(doc_id) AS top FROM keyed WHERE length(key) >= 20 GROUP BY key HAVING count(DISTINCT doc_id) >= 3
), marked AS (
  SELECT l.doc_id, l.line, l.k, (o.key IS NOT NULL AND l.doc_id <> o.top) AS gone FROM keyed l LEFT JOIN often o ON l.key = o.key
)
SELECT doc_id, count(*) AS n_lines, CAST(sum(CASE WHEN gone THEN 1 ELSE 0 END) AS BIGINT) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY k) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM marked GROUP BY doc_id
"""


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every whole document with every benchmark item that it contains."""
    return decontam.contained_items(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


OP8_SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(lower(text), '[\p{L}\p{M}\p{N}]+') AS w FROM documents WHERE text IS NOT NULL),
b AS (SELECT item_id, regexp_extract_all(lower(text), '[\p{L}\p{M}\p{N}]+') AS w FROM benchmark WHERE text IS NOT NULL AND item_id IS NOT NULL),
items AS (SELECT item_id, least(5, len(w)) AS n, unnest(list_distinct(list_transform(range(1, greatest(len(w) - 4, 1) + 1), lambda i: array_to_string(w[i:i + 4], ' ')))) AS s FROM b WHERE len(w) > 0),
sized AS (SELECT item_id, n, count(*) AS n_item FROM items GROUP BY ALL),
lengths AS (SELECT DISTINCT n FROM sized),
grams AS (SELECT doc_id, n, unnest(list_distinct(list_transform(range(1, len(w) - n + 2), lambda i: array_to_string(w[i:i + n - 1], ' ')))) AS s FROM d, lengths WHERE len(w) >= n),
found AS (SELECT g.doc_id, i.item_id, count(*) AS n_found FROM grams g JOIN items i ON g.s = i.s AND g.n = i.n GROUP BY ALL)
SELECT f.doc_id, f.item_id, f.n_found, s.n_item FROM found f JOIN sized s USING (item_id) WHERE 100 * f.n_found >= 80 * s.n_item
"""


def op9_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every whole text; a quarter of the ids is never learnt from."""
    docs = table(spark, sf_dir, "documents")
    model = lang.fit(docs, crc_mod(docs["doc_id"], 4) != 2)
    return lang.predict(docs, model).select("doc_id", (crc_mod(F.col("doc_id"), 4) == 2).alias("held_out"), "lang_pred", "score", "accepted")


def op10_bpe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of every whole text and the text that they decode to, as digests."""
    coded = bpe.encode(table(spark, sf_dir, "documents"), WORD_BPE)
    return coded.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def queries() -> dict:
    return {"op1_token_counts": op1_token_counts, "op2_quality": op2_quality, "op3_chroma_fingerprints": op3_chroma_fingerprints, "op4_pii_surrogates": op4_pii_surrogates, "op5_license_scan": op5_license_scan, "op6_near_duplicates": op6_near_duplicates, "op7_line_dedup": op7_line_dedup, "op8_decontamination": op8_decontamination, "op9_language": op9_language, "op10_bpe_round_trip": op10_bpe_round_trip}


def oracle_sql() -> dict[str, str]:
    return {"op5_license_scan": OP5_SQL, "op6_near_duplicates": OP6_SQL, "op7_line_dedup": OP7_SQL, "op8_decontamination": OP8_SQL}
