"""Corpus pipeline: quality filter, exact and near dedup, source mixing, byte-level BPE.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of
documents. Every stage works on all that its predecessor kept, and its decisions take effect.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cashloom.llm import bpe
from cashloom.llm.common import saved, small_batches, whole_text
from cashloom.llm.exact_dedup import exact_duplicates
from cashloom.llm.mixing import drawn
from cashloom.llm.near_dedup import near_duplicates
from cashloom.llm.quality import keep_quality, quality_network

#: Share of the tokens that mixing keeps. Without language-model stages after it, most of the corpus stays.
MIX_BUDGET = 0.9
VOCABULARY = "byte_bpe_50k.tiktoken"


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose quality score is at least 0.5; the model is fitted on the labelled rows among them.

    Each row is judged by its text alone, a null one as empty, so repeated rows go or stay together. Where no
    row has a label every score is 0.5 and all rows stay. An empty table stays empty.
    """
    small_batches(spark)
    return keep_quality(docs, quality_network(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the row with the largest doc_id, or one without where none has any; of rows that repeat
    a doc_id with its text, one. Rows that share a doc_id with different texts are decided each for itself."""
    kept = exact_duplicates(docs).where("kept OR keep_id IS NULL").select(F.col("doc_id").alias("_kept_id"), F.col("text_sha256").alias("_kept_sha"))
    own = F.col("_id").eqNullSafe(F.col("_kept_id")) & (F.col("_sha") == F.col("_kept_sha"))
    return _rows(docs).join(kept, own, "left_semi").dropDuplicates(["_id", "_sha"]).select("_doc.*")


def _rows(docs: DataFrame) -> DataFrame:
    """Each row whole as the struct _doc, whatever its columns' names, with its _id and its text's _sha."""
    return docs.select(F.struct("*").alias("_doc"), F.col("doc_id").cast("bigint").alias("_id"), F.sha2(F.encode(whole_text(), "UTF-8"), 256).alias("_sha"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The least doc_id of each component at five words and a similarity of 0.8; rows without doc_id come last.

    Rows that share a doc_id with different texts are documents of their own, and so are rows without one.
    """
    small_batches(spark)
    odd = docs.groupBy("doc_id").agg(F.count(F.lit(1)).alias("_n")).where("_n > 1 OR doc_id IS NULL")
    if odd.isEmpty():
        kept = near_duplicates(docs, words=5, percent=80).where("kept").select(F.col("doc_id").alias("_id"))
        return _rows(docs).join(kept, "_id", "left_semi").select("_doc.*")
    rows = saved(_keyed(docs), "keyed")
    kept = near_duplicates(rows.select(F.col("_key").alias("doc_id"), F.col("_doc.text").alias("text")), words=5, percent=80)
    return rows.join(kept.where("kept").select(F.col("doc_id").alias("_key")), "_key", "left_semi").dropDuplicates(["_key"]).select("_doc.*")


def _keyed(docs: DataFrame) -> DataFrame:
    """The rows with _key, a number of its own for each doc_id and text, in the order of doc_id, nulls last.

    The numbers come from the place in the sorted order, so doc_ids at either end of bigint do no harm.
    """
    rows = _rows(docs)
    known = rows.select(F.col("_id").alias("_key_id"), F.col("_sha").alias("_key_sha")).distinct().orderBy(F.col("_key_id").asc_nulls_last(), "_key_sha")
    keys = saved(known.withColumn("_key", F.monotonically_increasing_id()), "keys")
    return rows.join(keys, F.col("_id").eqNullSafe(F.col("_key_id")) & (F.col("_sha") == F.col("_key_sha"))).select("_doc", "_key")


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents drawn by raked weights of source, language and topic.

    A null source, lang or text counts as empty; rows without tokens stay. Rows that share a doc_id have one
    draw, held against the probability of each row's own cell. An empty table stays empty.
    """
    return drawn(docs, budget=MIX_BUDGET).where("_kept").select("_doc.*")


def byte_bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, ids, n_tokens and digests of the ids and of what they decode to, one row per row.

    A null or empty text has no ids. Repeated rows are encoded alike; an empty table gives no rows.
    """
    small_batches(spark)
    return bpe.round_trip(docs, *bpe.vocabulary(VOCABULARY)).select("doc_id", "ids", "n_tokens", "ids_sha256", "decoded_sha256")


STAGES = [
    ("quality classifier", quality_classifier),
    ("exact dedup", exact_dedup),
    ("MinHash near-dedup", near_dedup),
    ("mixing sources", mixing),
    ("byte-level BPE", byte_bpe),
]

#: SQL cannot express the classifier or the BPE; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The result of the last stage; each stage works on what its predecessor has written to the shared folder."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES:
        docs = saved(stage(spark, docs, sf_dir), "stage")
    return docs
