"""The corpus pipeline: five stages over documents, each written as Parquet and read again by the next."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyproof.llm import mixing, near_dup, quality_rules, sp_codec, suffix_dedup
from tallyproof.llm.common import read, shared_folder
from tallyproof.llm.queries import WEIGHTS, domain

#: Columns of documents, which all stages but the last return.
COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
#: Units that a worker keeps encoded: it lives on beside the other stages, so fewer than the operator's default.
UNITS_KEPT = 100_000


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules reject go: null, empty and short texts among them. One projection and a filter, no join."""
    rows = docs.select(*COLUMNS)
    return quality_rules.kept_rows(rows)


def near_dup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The smallest doc_id of each group of near copies stays (five words, similarity 0.8); rows without doc_id all stay."""
    found = near_dup.near_duplicates(docs, w=5)
    gone = found.where("not kept and doc_id is not null").select("doc_id")
    return docs.select(*COLUMNS).join(gone, "doc_id", "left_anti").select(*COLUMNS)


def suffix_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Strings of 100 bytes that an earlier text has are cut out, whole code points only; texts that lose all go.

    n_chars is that of the text that is left. Null texts and empty tables stay as they are.
    """
    done = suffix_dedup.texts_without_repeats(docs.select(*COLUMNS))
    left = done.withColumn("n_chars", F.when(F.col("text").isNotNull(), F.length("text").cast("bigint")).otherwise(F.col("n_chars")))
    return left.where("text is null or text != ''")


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document is taken as often as its fitted rate says: the domains' expected tokens reach op8's weights, their total stays.

    Rows of one doc_id are taken alike, as often as the one taken most; null doc_ids once; an empty table stays one.
    """
    rows = mixing.mix(docs, read(spark, sf_dir, "labels"), domain(), list(WEIGHTS))
    taken = rows.where("doc_id is not null").groupBy("doc_id").agg(F.max("copies").alias("copies"))
    both = docs.select(*COLUMNS).join(taken, "doc_id", "left").withColumn("copies", F.coalesce("copies", F.lit(1)))
    times = F.explode(F.when(F.col("copies") > 0, F.sequence(F.lit(1), F.col("copies").cast("int"))))
    return both.withColumn("copy", times).select(*COLUMNS)


def encode_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All columns, and the ids of the best segmentation, whose decoding is the text again; null texts have no pieces."""
    return sp_codec.encode_rows(docs.select(*COLUMNS), cache=UNITS_KEPT)


STAGES = [
    ("quality_rules", quality_stage),
    ("minhash_near_dedup", near_dup_stage),
    ("suffix_array_dedup", suffix_stage),
    ("mixing", mixing_stage),
    ("sentencepiece", encode_stage),
]

#: MinHash groups, fitted rates and encodings can't be written in SQL; tests hold run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for _, stage in STAGES:
        where = shared_folder(spark)
        stage(spark, docs, sf_dir).write.parquet(where)
        docs = spark.read.parquet(where)
    return docs
