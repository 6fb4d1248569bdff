"""From raw documents to packed training sequences, one written table per stage.

Every stage takes all documents that the one before kept. All but the last return the columns of
``documents``, with ``n_chars`` following the text.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from flowmill.llm import near_dedup, packing, quality_classifier, secret_scan, substring_dedup
from flowmill.operators.ordering import row_index
from flowmill.session import stage

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def _columns(docs: DataFrame) -> DataFrame:
    return docs.withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier does not reject."""
    model = quality_classifier.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), F.lit(True))
    return quality_classifier.score(docs, model).where("score >= 0.7").select(*COLUMNS)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near copies, the first by id (rows without an id last) and text hash.

    Rows are compared, not ids: repeated rows, rows that share an id and rows without one included.
    """
    order = [F.col("doc_id").asc_nulls_last(), F.xxhash64("text"), "lang", "source"]
    rows = row_index(docs.select(*COLUMNS), order, "__row").df
    found = near_dedup.near_duplicates(rows, key="__row", shingle=5, percent=80)
    gone = found.where("__row <> component_id").select("__row")
    return rows.join(gone, "__row", "left_anti").select(*COLUMNS)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without passages that stand elsewhere too."""
    return _columns(substring_dedup.substring_dedup(docs))


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts with every secret replaced."""
    return _columns(secret_scan.mask(secret_scan.scan(docs)))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents in sequences of at most 4096 tokens."""
    packed = packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"))
    return packed.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


STAGES = [
    ("quality classifier", keep_quality),
    ("near-duplicates", drop_near_copies),
    ("substring dedup", cut_repeats),
    ("secret scan", mask_secrets),
    ("packing", pack_sequences),
]

#: The classifier is learned and the tokenizer is a file, so no SQL states the rows.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select(*COLUMNS)
    for name, apply in STAGES[:-1]:
        docs = stage(apply(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
