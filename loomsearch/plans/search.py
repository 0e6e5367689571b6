"""Hybrid search: keyword and vector candidates, fused, joined with the documents and
filtered, as one plan for a table of queries."""

from __future__ import annotations

from collections.abc import Callable
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.filters import TypedFields, VariantFields, predicate
from ..operators.bm25 import bm25_search, top_k
from ..operators.fusion import RRF_K, fuse
from ..operators.postings import KeywordIndex

#: Each ranker, and the fusion, yields so many times the rows that are asked for.
OVERFETCH = 2


def hybrid_search(
    queries: DataFrame,
    docs: DataFrame,
    index: KeywordIndex | None,
    vector_search: Callable[[DataFrame, int, DataFrame | None], DataFrame] | None,
    k: int = 10,
    alpha: float = 0.5,
    filters: dict[str, Any] | None = None,
    filter_mode: str = "post",
    fallback: bool = False,
    strict: bool = False,
    fields: TypedFields | VariantFields | None = None,
    rrf_k: int = RRF_K,
) -> DataFrame:
    """(qid, id, score, bm25_rank, vector_rank, rank and the columns of docs).

    queries(qid, text, and embedding where vectors are searched); docs(id, ...);
    vector_search(queries, n, allowed) returns (qid, id, score, rank) of the ids in
    allowed(id), or of all for None. alpha 0 is keyword only
    and skips the vectors, alpha 1 the reverse. Without vector_search alpha counts as
    0, except that alpha 1 then finds nothing unless fallback is set.

    filter_mode "post": filters apply to the fused candidates, so fewer than k rows may
    come back; "pre": only documents that pass are ranked.
    """
    if not 0.0 <= alpha <= 1.0:
        raise ValueError(f"alpha must be in [0, 1], not {alpha}")
    if filter_mode not in ("post", "pre"):
        raise ValueError("filter_mode is 'post' or 'pre'")
    passing = predicate(filters, fields or TypedFields(docs), strict)
    with_vectors = vector_search is not None and alpha > 0
    with_keywords = alpha < 1 or (vector_search is None and fallback)
    n = k * OVERFETCH
    allowed = None
    if passing is not None and filter_mode == "pre":
        docs = docs.where(passing)
        allowed = docs.select("id")
    nothing = queries.select("qid").limit(0).join(docs.select("id").limit(0), how="cross").select("qid", "id", F.lit(0.0).alias("score"), F.lit(0).alias("rank"))
    keyword = bm25_search(queries, index, n, allowed=allowed) if with_keywords else nothing
    vector = vector_search(queries, n, allowed) if with_vectors else nothing
    effective = alpha if vector_search is not None else 0.0
    fused = fuse(keyword, vector, effective, n, rrf_k)
    rows = fused.drop("rank").join(docs, "id")
    if passing is not None and filter_mode == "post":
        rows = rows.where(passing)
    return top_k(rows, k)
