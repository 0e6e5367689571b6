"""Okapi BM25 over the keyword index, for one query or a table of queries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import unique_terms
from ..sources.partitions import local_table
from .postings import KeywordIndex, idf

K1, B = 1.5, 0.75
#: Scores are compared to so many places, so that equal ones tie in any order of sums.
PLACES = 6
#: Terms of a table of queries that are named to the scan of the postings, at most.
MOST_TERMS = 2_000


def term_weight(tf: Column, dl: Column, avgdl: Column, idf_: Column, k1: float = K1, b: float = B) -> Column:
    return idf_ * (tf * (k1 + 1.0)) / (tf + k1 * (1.0 - b + b * dl / avgdl))


def top_k(scored: DataFrame, k: int, by: str = "qid") -> DataFrame:
    """The k best rows of each query with their rank: score descending, then id."""
    best = Window.partitionBy(by).orderBy(F.desc("score"), F.asc("id"))
    return scored.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)


def bm25_scores(queries: DataFrame, index: KeywordIndex, k1: float = K1, b: float = B, allowed: DataFrame | None = None) -> DataFrame:
    """(qid, id, score) of every document that has a term of the query. A query's
    terms count once each; a query without terms has no rows. allowed(id): only these
    are scored; frequencies and lengths stay those of all documents.

    Of few queries the terms are looked at first: they are then named to the scan of the
    postings, which is sorted by term, and sent to every task."""
    terms = queries.select("qid", F.explode(unique_terms("text", index.stemming)).alias("term"))
    first = terms.limit(MOST_TERMS + 1).collect()
    index_terms, postings = index, index.postings
    if len(first) <= MOST_TERMS:
        index_terms = index.of_terms(sorted({r["term"] for r in first}))
        postings = index_terms.postings
        terms = F.broadcast(local_table(queries.sparkSession, first, terms.schema))
    one_row = F.broadcast(index.statistics())
    weighed = terms.join(index_terms.terms(), "term").join(one_row, how="cross").select("qid", "term", "avgdl", idf(F.col("df"), F.col("n")).alias("idf"))
    if len(first) <= MOST_TERMS:
        weighed = F.broadcast(weighed)
    postings = postings if allowed is None else postings.join(allowed, "id", "left_semi")
    hits = postings.join(weighed, "term")
    parts = hits.select("qid", "id", term_weight(F.col("tf"), F.col("dl"), F.col("avgdl"), F.col("idf"), k1, b).alias("w"))
    return parts.groupBy("qid", "id").agg(F.round(F.sum("w"), PLACES).alias("score"))


def bm25_search(queries: DataFrame, index: KeywordIndex, k: int = 10, k1: float = K1, b: float = B, allowed: DataFrame | None = None) -> DataFrame:
    """(qid, id, score, rank) of the k best documents of each query(qid, text)."""
    return top_k(bm25_scores(queries, index, k1, b, allowed), k)
