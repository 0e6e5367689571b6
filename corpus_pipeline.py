"""Corpus preparation: from raw documents to packed sequences of token ids.

Five stages, each a function of (spark, docs, sf_dir). All but the last return the
columns of documents; what a stage decides holds for the next one: rejected lines,
documents and secrets are gone from its output. Between stages the documents are
written as Parquet in the cluster's shared folder and read again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomsearch.llm.op2_quality_rules import line_quality
from loomsearch.llm.op4_benchmark_decontamination import find_contamination
from loomsearch.llm.op8_secret_scan import redact, scan
from loomsearch.llm.op9_best_fit_packing import pack_documents
from loomsearch.llm.op10_minhash_near_dedup import near_duplicates
from loomsearch.llm.store import Scratch

#: Columns of documents.
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def _with_text(docs: DataFrame) -> DataFrame:
    """The documents of a table with columns doc (a row of documents) and text."""
    return docs.select("doc.doc_id", "text", "doc.lang", "doc.source", F.length("text").cast("long").alias("n_chars"))


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Removes lines that fail a rule, and documents that fail as a whole. Null and
    blank texts are rejected."""
    judged = line_quality(docs.select(COLUMNS)).where("kept")
    return _with_text(judged.select("doc", F.col("clean_text").alias("text")))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document with the smallest id of each near-duplicate class at
    similarity 0.8. Rows without id stay; rows that share an id stay or go together."""
    gone = near_duplicates(docs, percent=80).where("NOT kept").select("doc_id").distinct()
    return docs.select(COLUMNS).join(gone, "doc_id", "left_anti").select(COLUMNS)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold ten consecutive words of a benchmark item. Rows that
    share an id, or have none, go together."""
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    hit = find_contamination(docs, benchmark).where("contaminated").select(F.col("doc_id").alias("hit_id")).distinct()
    return docs.select(COLUMNS).join(hit, F.col("doc_id").eqNullSafe(F.col("hit_id")), "left_anti").select(COLUMNS)


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces every secret in the texts by a mark; no document goes."""
    found = scan(docs.select(COLUMNS), path_col="source")
    return _with_text(found.select("doc", redact(F.coalesce("doc.text", F.lit("")), F.col("findings")).alias("text")))


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row per piece of the documents left, in sequences of 2048 token ids."""
    return pack_documents(docs)


STAGES = [
    ("quality_rules", quality_rules),
    ("near_dedup", near_dedup),
    ("decontamination", decontamination),
    ("secret_scan", secret_scan),
    ("best_fit_packing", best_fit_packing),
]

#: SQL can express neither the forest of the secret scan nor the tokenizer; the result
#: is held against a brute-force version in the tests.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies all stages to documents."""
    scratch = Scratch(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (name, stage) in enumerate(STAGES):
        docs = scratch.write(stage(spark, docs, sf_dir), name)
        if i:
            scratch.drop(STAGES[i - 1][0])
    return docs
