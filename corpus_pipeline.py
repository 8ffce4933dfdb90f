"""Corpus pipeline: documents that are known, distinct, clean of benchmark items and secrets, packed for training.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame. ``run`` writes each result as
Parquet under the shared folder and reads it again as the next stage's documents; all stages
but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from studyframe.llm import decontaminate, language_id, ngram_join, packing, queries, secret_scan
from studyframe.session import materialize


def identified(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is found; those without any go."""
    return language_id.keep_identified(docs)


#: Rows to drop that are broadcast at most; more are joined by a shuffle.
BROADCAST_ROWS = 500_000


def distinct_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates: the one with the smallest id.

    Of equal ids the smallest text digest stays, rows without an id only where none of the
    group has one, and of repeated rows one. Texts without words are no duplicates.
    """
    digest = decontaminate.digest("text")
    name = F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("id"), digest.alias("digest"))
    groups = ngram_join.jaccard_components(docs.select(name.alias("name"), "text"), id_col="name")
    groups = materialize(groups.groupBy("name", "component_id").agg(F.count("*").alias("rows")), "pipeline-groups")

    id_name, digest_name = decontaminate.free_name(docs, "named_id"), decontaminate.free_name(docs, "named_digest")

    def named(rows: DataFrame) -> DataFrame:
        rows = rows.select(F.col("name.id").alias(id_name), F.col("name.digest").alias(digest_name))
        return F.broadcast(rows) if rows.count() <= BROADCAST_ROWS else rows

    same = F.col("doc_id").eqNullSafe(F.col(id_name)) & (digest == F.col(digest_name))
    kept = docs.join(named(groups.where("name != component_id")), same, "left_anti")
    repeated = groups.where("name = component_id and rows > 1")
    if not repeated.limit(1).count():
        return kept
    repeated = named(repeated)
    return kept.join(repeated, same, "left_anti").unionByName(kept.join(repeated, same, "left_semi").dropDuplicates(["doc_id", "text"]))


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without any window like a benchmark item."""
    return decontaminate.drop_contaminated(docs, queries.table(spark, sf_dir, "benchmark"))


def without_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with secrets in the text masked and n_chars (if there is one) put right."""
    masked = secret_scan.redact(docs, secret_scan.fit_secrets(docs))
    if "n_chars" not in docs.columns:
        return masked
    return masked.withColumn("n_chars", F.when(F.col("n_chars").isNotNull(), F.length("text").cast(docs.schema["n_chars"].dataType)))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents, packed into sequences of 2048 tokens."""
    return packing.best_fit_pack(docs, queries.tokenizer_path(), keep_learned=False)


STAGES = [
    ("language_id", identified),
    ("ngram_jaccard_join", distinct_documents),
    ("benchmark_decontamination", decontaminated),
    ("secret_scan", without_secrets),
    ("best_fit_packing", packed),
]

#: Neither the tokenizer nor the networks can be said in SQL; tests run a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the table documents."""
    docs = queries.table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
