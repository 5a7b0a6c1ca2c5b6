"""The queries of this subpackage, one for each operator, with production parameters over whole tables."""

from __future__ import annotations

from collections.abc import Callable

import corpus_pipeline
import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pathlens.llm import bm25, byte_bpe, html_extract, katz, license_scan, mpeg_audio, ngram_join, packing, secrets_scan, toxicity
from pathlens.llm.common import split_residue, table


def op1_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.extract(table(spark, sf_dir, "pages"))


def op2_exact_top_k_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return bm25.search(docs, docs.filter(F.col("doc_id") % 100 == 0)).withColumnRenamed("id", "doc_id")


def op3_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.similar(table(spark, sf_dir, "documents")).withColumnRenamed("id", "doc_id")


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    scored = toxicity.score(docs, model).withColumnRenamed("id", "doc_id")
    return scored.select("doc_id", (split_residue("doc_id", 5) == 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op5_mpeg_audio(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mpeg_audio.media_features(table(spark, sf_dir, "documents")).withColumnRenamed("id", "doc_id")


def op6_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets_scan.scan(table(spark, sf_dir, "documents"))
    number = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return found.select(F.col("id").alias("doc_id"), number("assign"), number("access"), number("hex"), F.sha2(secrets_scan.spelled(F.col("base")).cast("binary"), 256).alias("base_sha256"), secrets_scan.spelled(F.col("spans")).alias("spans"), (F.size("spans") - F.size("base")).cast("long").alias("n_entropy"), F.size("candidates").cast("long").alias("n_candidates"), F.array_max(F.transform("candidates", lambda c: c["score"])).alias("highest_entropy"))


def op7_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    read_back = byte_bpe.encode(table(spark, sf_dir, "documents"), path, decoded=True)
    return read_back.select(F.col("id").alias("doc_id"), F.floor(F.length("ids") / 4).cast("long").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op8_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    cut = packing.pieces(docs, public_tokenizers.path("word_bpe_49k.json"))
    return packing.pack(cut, docs.count())


def op9_katz_backoff(spark: SparkSession, sf_dir: str) -> DataFrame:
    return katz.score(table(spark, sf_dir, "documents")).withColumnRenamed("id", "doc_id")


def op10_license_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = license_scan.scan(table(spark, sf_dir, "documents"))
    return found.select(F.col("id").alias("doc_id"), F.size("licenses").cast("long").alias("n_licenses"), F.array_join(F.transform("licenses", lambda m: m["license"]), ",").alias("licenses"), F.col("licenses").alias("matches"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    each = (op1_html_extraction, op2_exact_top_k_search, op3_ngram_jaccard_join, op4_toxicity, op5_mpeg_audio, op6_secret_scans, op7_byte_bpe, op8_best_fit_packing, op9_katz_backoff, op10_license_scans)
    return {f.__name__: f for f in each} | {"pipeline": corpus_pipeline.run}


def oracle_sql() -> dict[str, str]:
    return {"pipeline": corpus_pipeline.ORACLE_SQL} if corpus_pipeline.ORACLE_SQL else {}
