"""Corpus pipeline: language, lines, near-duplicates, benchmark passages, tokens.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; ``run`` writes each one's
result as Parquet in the shared folder and reads it again as the next one's ``docs``. All
stages but the last return the columns of ``docs``.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from agriclime.llm import bpe, decontaminate, lines, minhash, ppm
from agriclime.llm.common import TEXT_ROWS, fold, store, table
from agriclime.sources.tables import materialize

# Rejected: no letter at all, or two languages about as likely as each other.
LEAST_SCORE = 0.5
VOCABULARY = "byte_bpe_50k.json"


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is recognised; learned on the folds 0 and 2 of 3.

    Where these folds hold no text of a known language, only texts without a letter go.
    """
    held_out = F.coalesce(fold(F.col("doc_id"), 3) == 1, F.lit(True))
    model = ppm.learn(ppm.learning_rows(docs, held_out))
    if model is None:
        return docs.where(F.col("text").rlike(r"\p{L}"))
    found = ppm.identify(docs, model)
    return found.where((F.col("lang_pred") != ppm.UNKNOWN) & (F.col("score") >= LEAST_SCORE)).select(*docs.columns)


def repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the lines that repeat an earlier one; ``n_chars`` follows."""
    cut = lines.deduplicate(docs).withColumn("n_chars", F.length("text").cast("long"))
    return cut.select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group."""
    gone = minhash.near_duplicates(docs).where("not kept").select("doc_id").distinct()
    return docs.join(gone, "doc_id", "left_anti").select(*docs.columns)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage of the benchmark."""
    found = decontaminate.matches(docs, table(spark, sf_dir, "benchmark"))
    return store(found.where(F.size("matches") == 0).select(*docs.columns), "clean", TEXT_ROWS)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document's tokens: count, packed ids, and whether they decode to its text."""
    content = bpe.vocabulary_content(public_tokenizers.path(VOCABULARY))
    coded = bpe.encode_decode(docs, content)
    same = F.col("decoded") == F.coalesce(F.col("text"), F.lit(""))
    coded = coded.select("doc_id", "lang", "source", "n_tokens", "ids", same.alias("round_trip"))
    return store(coded, "coded", TEXT_ROWS)


STAGES = [
    ("language", language),
    ("repeated_lines", repeated_lines),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("tokens", tokens),
]

# Code lengths, SimHash groups and merges have no SQL form; tests check run() by brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
