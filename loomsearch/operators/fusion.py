"""Reciprocal rank fusion of two ranked lists per query."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bm25 import top_k

RRF_K = 60
#: Scores of fused lists are small, so they keep more places.
PLACES = 9


def fuse(keyword: DataFrame, vector: DataFrame, alpha: float = 0.5, k: int = 10, rrf_k: int = RRF_K) -> DataFrame:
    """(qid, id, score, bm25_rank, vector_rank, rank): score is
    (1 - alpha) / (rrf_k + keyword rank) + alpha / (rrf_k + vector rank), a side that
    lacks the document adding nothing. Only positive scores are kept. Both inputs have
    (qid, id, rank) with ranks from 1."""
    if not 0.0 <= alpha <= 1.0:
        raise ValueError(f"alpha must be in [0, 1], not {alpha}")
    b = keyword.select("qid", "id", F.col("rank").alias("bm25_rank"))
    v = vector.select("qid", "id", F.col("rank").alias("vector_rank"))
    both = b.join(v, ["qid", "id"], "full")
    score = F.coalesce((1.0 - alpha) / (rrf_k + F.col("bm25_rank")), F.lit(0.0)) + F.coalesce(alpha / (rrf_k + F.col("vector_rank")), F.lit(0.0))
    return top_k(both.withColumn("score", F.round(score, PLACES)).where("score > 0"), k)
