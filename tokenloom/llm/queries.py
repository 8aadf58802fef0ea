"""The registered queries of the training-data operators, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tokenloom.llm import bagminhash, bpe, caps, centroids, dac, hpyp, langid, mixing, oracles, quality, secrets, suffix_dedup, toxicity, turn_trie
from tokenloom.llm.common import crc32_of_id, table

VOCAB = public_tokenizers.path("word_bpe_49k.json")


def op1_hpyp_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    held_out = F.coalesce(crc32_of_id() % 7 == 2, F.lit(False))
    got = hpyp.score(table(spark, sf_dir, "documents"), ~held_out)
    return got.select(F.col("id").alias("doc_id"), (~F.col("learned")).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op2_cap_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return caps.near_vectors(table(spark, sf_dir, "embeddings"))


def op3_dac_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = dac.write_and_read(table(spark, sf_dir, "documents"), VOCAB, end_id=2)
    return got.select("doc_id", "start", F.expr("length(ids) div 4").cast("long").alias("n_tokens"), F.crc32("ids").alias("ids_crc32"))


def op4_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = secrets.scan(table(spark, sf_dir, "documents").select("doc_id", "text"))
    base = F.filter("spans", lambda x: x["rank"] < len(secrets.BASE))
    counts = [secrets.count_of(base, kind).alias(f"n_{kind}") for kind in secrets.BASE]
    return got.select("doc_id", *counts, F.sha2(secrets.listed(base).cast("binary"), 256).alias("base_sha256"), secrets.listed(F.col("spans")).alias("spans"))


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held_out = F.coalesce(crc32_of_id() % 3 == 1, F.lit(False))
    model = langid.fit(docs.where(~held_out).select("doc_id", "text", "lang"))
    return langid.predict(docs, model, keep=["doc_id", held_out.alias("held_out")])


def op6_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = suffix_dedup.remove_repeats(table(spark, sf_dir, "documents"))
    removed = F.col("n_bytes") - F.length("kept")
    return got.select("doc_id", "n_bytes", removed.cast("long").alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


def op7_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_sizes(table(spark, sf_dir, "documents"))


def op8_bag_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bagminhash.near_copies(table(spark, sf_dir, "documents"))


def op9_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = bpe.encode_documents(table(spark, sf_dir, "documents"), VOCAB)
    return got.select("doc_id", F.expr("length(ids) div 4").cast("long").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = quality.judge(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return got.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op11_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    held_out = F.coalesce(crc32_of_id() % 5 == 0, F.lit(False))
    model = toxicity.fit(docs.where(~held_out), labels.where(~held_out).select("doc_id", "toxic"))
    return toxicity.score(docs, model, keep=["doc_id", held_out.alias("held_out")])


def op12_turn_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return turn_trie.trie(table(spark, sf_dir, "conversations"))


def op13_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    got, _ = centroids.cluster(table(spark, sf_dir, "embeddings"))
    return got.withColumnRenamed("id", "vec_id")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (op1_hpyp_score, op2_cap_filters, op3_dac_tokens, op4_secret_scan, op5_language_id, op6_suffix_dedup, op7_source_mix, op8_bag_minhash, op9_bpe, op10_quality_rules, op11_toxicity, op12_turn_trie, op13_centroids)}

ORACLES: dict[str, str] = {
    "op2_cap_filters": oracles.near_vectors(),
    "op4_secret_scan": oracles.secret_scan(),
    "op6_suffix_dedup": oracles.suffix_dedup(),
    "op7_source_mix": oracles.source_mix(),
    "op8_bag_minhash": oracles.near_copies(),
    "op10_quality_rules": oracles.quality_rules(),
    "op12_turn_trie": oracles.turn_trie(),
    "op13_centroids": oracles.centroid_clusters(),
}
