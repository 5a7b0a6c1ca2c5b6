"""The corpus pipeline: reject toxic texts, keep one of near copies, redact secrets, pack into sequences.

Each stage takes (spark, docs, sf_dir) and works on every row that the stage before it kept. All
but the last return the columns of documents.
"""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pathlens.llm import ngram_join, packing, secrets_scan, toxicity
from pathlens.llm.common import shared_folder, ship, table


def reject_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows whose toxicity score is below 0.5. A null or empty text has no match and stays."""
    ship(spark)
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    whole = docs.select(F.struct("*").alias("row"))
    return toxicity.score(whole, model, id_col="row", text_col="row.text").filter("score < 0.5").select("id.*")


def one_of_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each class of equal or linked n-gram sets: the one with the least id (a null id comes first).

    Texts without words are copies of each other. Of wholly equal rows one stays.
    """
    ship(spark)
    name = "_".join(["key", *docs.columns])  # no column has it
    keyed = docs.withColumn(name, F.struct(F.col("doc_id").alias("doc_id"), F.xxhash64(*docs.columns).alias("row")))
    joined = ngram_join.similar(keyed, id_col=name)
    first = joined.filter(F.col("id") == F.col("class_id")).select(F.col("id").alias(name)).distinct()
    return keyed.join(first, name, "left_semi").dropDuplicates([name]).select(*docs.columns)


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All rows; each secret in a text is replaced, and n_chars counts the new text. Other texts are as they were."""
    found = secrets_scan.scan(docs.select(F.struct("*").alias("row"), "text"), id_col="row")
    clean = found.select("id", F.size("spans").alias("n"), secrets_scan.redacted(F.col("text"), F.col("spans")).alias("clean"))
    new = {"text": F.col("clean"), "n_chars": F.length("clean").cast("long")}
    return clean.select(*(F.when(F.col("n") > 0, new[c]).otherwise(F.col("id")[c]).alias(c) if c in new else F.col("id")[c].alias(c) for c in docs.columns))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces with their places in sequences of 4096 tokens, a row for each piece."""
    ship(spark)
    return packing.pack(packing.pieces(docs, public_tokenizers.path("word_bpe_49k.json")), docs.count())


STAGES = [("toxicity", reject_toxic), ("ngram_jaccard_join", one_of_near_copies), ("secret_scans", redact_secrets), ("best_fit_packing", pack_sequences)]

#: No stage but the third could be put into SQL. tests/llm checks which near copies stay and what is redacted, the other two stages by their row counts only.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    folder = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    for k, (name, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(path := f"{folder}/{k}-{name}")
        docs = spark.read.parquet(path)
    return docs
