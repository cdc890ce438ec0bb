"""The corpus pipeline: the stages in order, each over all rows that the one before it kept."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.llm import decontaminate, language_id, line_dedup, near_dedup, sentencepiece_viterbi
from factloom.llm.common import materialised

PIECES = "piece_bpe_32k.model"


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents whose language is decided."""
    return language_id.accepted(docs, language_id.train(docs))


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Takes repeated lines out of the texts."""
    return line_dedup.without_repeats(docs, least=1)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document of least id of each class of near-duplicates."""
    return near_dedup.one_of_each(docs)


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents without a benchmark item."""
    return decontaminate.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents' columns but the text, its ids (little-endian 32-bit), their number, and whether they decode to it."""
    path = public_tokenizers.path(PIECES)
    kept = [c for c in docs.columns if c not in ("text", "ids", "n_tokens", "round_trip")]
    coded = sentencepiece_viterbi.encode(docs.select(*(F.col(f"`{c}`") for c in kept), "text"), path, keep_text=False, checked="round_trip")
    return coded.select(*(F.col(f"`{c}`") for c in kept), (F.length("ids") / 4).cast("long").alias("n_tokens"), "ids", "round_trip")


STAGES = [("language_id", language), ("line_dedup", lines), ("near_dedup", near_duplicates), ("decontamination", benchmark), ("sentencepiece", tokens)]
#: SQL can't express the trained model of the first stage, nor those after it.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows; each stage's are written to the shared folder and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES:
        docs = materialised(stage(spark, docs, sf_dir))
    return docs
