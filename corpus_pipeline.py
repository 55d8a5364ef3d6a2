"""A corpus pipeline of five stages over `documents`.

Each stage takes (spark, docs, sf_dir), works on all rows its predecessor kept, and
returns a DataFrame; `run` writes it as Parquet to the shared folder and reads it again
as the next one's docs. All but the last return the columns of documents; stages that
change texts set n_chars anew.

Odd rows, in every stage: null and empty texts pass unchanged if the classifier keeps them
(it scores both as the empty text); a row without doc_id is never a near copy; rows that
repeat a doc_id are judged by their own texts and leave together as near copies of a
smaller one; columns of any name beside doc_id and text travel along untouched (n_chars
follows the text); an empty table gives an empty table.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kwspread.llm import lsh_forest, packing, personal_data, quality, substring_dedup
from kwspread.llm.common import materialise
from kwspread.session import ship_package

TOKENIZER = "word_bpe_49k.json"
STAGE_WORDS = 5


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier does not reject (score at least 0.3)."""
    ship_package(spark)
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "quality")
    score = "stage_quality_score"
    while score in docs.columns:
        score += "_"
    scored = quality.score_quality(docs, labels, out=score)
    return scored.where(F.col(score) >= quality.REJECT_BELOW).select(*docs.columns)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, the least doc_id, of each near-duplicate group: shingles of five words,
    similarity 0.8 or more."""
    ship_package(spark)
    found = lsh_forest.near_duplicates(docs, STAGE_WORDS)
    gone = found.where("NOT kept").select("doc_id").distinct()
    return docs.join(gone, "doc_id", "left_anti").select(*docs.columns)


def _with_length(docs: DataFrame) -> DataFrame:
    """Set n_chars to the length of the text where it differs from what a stage left."""
    return docs.withColumn("n_chars", F.coalesce(F.length("text").cast("long"), F.col("n_chars")))


def drop_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the words of windows of 35 words that occur more than once."""
    ship_package(spark)
    return _with_length(substring_dedup.remove_repeats(docs))


def mask_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose personal data is replaced by the kind in angle brackets."""
    ship_package(spark)
    return _with_length(personal_data.redact_documents(docs))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents in sequences of at most 4096 tokens."""
    ship_package(spark)
    return packing.pack_documents(docs, public_tokenizers.path(TOKENIZER), window=4096, end_id=2)


STAGES = [
    ("quality classifier", keep_quality),
    ("near-duplicate removal", drop_near_copies),
    ("substring dedup", drop_repeated_passages),
    ("personal data", mask_personal_data),
    ("packing", pack),
]

#: The classifier and the field are trained models: SQL can't express the rows.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = materialise(stage(spark, docs, sf_dir), "stage-" + name.replace(" ", "-"))
    return docs
