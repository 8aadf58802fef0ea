"""From raw documents to a mixed, encoded corpus: five stages, each one operator of ``tokenloom.llm``.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; ``run`` writes each result as
Parquet in the shared folder and reads it again as the next stage's ``docs``.

All stages take whole texts of any length, rows with nulls in any column, repeated rows, equal ids and
empty tables (which give empty tables).  Further columns of ``docs``, whatever their names, pass through
all stages but the last, which returns only the columns it lists.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tokenloom.llm import bagminhash, bpe, mixing, quality, queries, secrets
from tokenloom.llm.common import stash, table


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and the risk-controlled cutoffs of their language.

    A null or empty text has no words, so it fails; a null language is a language of its own; rows of
    one id share its label but are judged each on its own text, so repeated rows stay or go together.
    """
    return quality.keep_good(docs, table(spark, sf_dir, "labels"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, the one with the least id, of each class of near copies.

    Rows without words (null, empty, blank texts) are each a class of their own and stay; of rows with
    one id, the least digest of the text decides; of rows repeated in id and text one stays; a null id
    gives way to a known one.
    """
    return bagminhash.drop_near_copies(docs)


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document, with secrets replaced by a mark and n_chars counted again.

    A null text stays null (n_chars too); overlapping secrets get one mark; repeated rows are treated alike.
    """
    clean = secrets.redact(docs)
    return clean.withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Whole documents, repeated or left out so that each source comes near its target.

    A null source is a source of its own; a null or empty text has no size and is taken as its place in
    the key order says; equal ids are ordered by a digest of the text, and rows equal in both go together.
    """
    return mixing.mix_documents(docs)


def bpe_codes(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each document (little-endian 32-bit), their number, and a digest of what they decode to.

    A null text has no ids; repeated rows are encoded each for itself.
    """
    got = bpe.encode_documents(docs, queries.VOCAB, keep=("doc_id", "lang", "source"))
    return got.select("doc_id", "lang", "source", F.expr("length(ids) div 4").cast("long").alias("n_tokens"), "ids", F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality_rules", quality_rules),
    ("near_dedup", near_dedup),
    ("secret_scan", secret_scan),
    ("source_mix", source_mix),
    ("bpe", bpe_codes),
]

#: SQL cannot express the signatures, the merges or the ids; tests/llm/test_pipeline.py holds the rows against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stash(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
