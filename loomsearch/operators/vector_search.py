"""Exact vector search: cosine top-k of a table of queries against a table of vectors.

Queries are taken in blocks of a fixed number of rows; a block's matrix goes to every
task, which multiplies it with its batches of vectors and hands on the best k of each
query, so the full set of scores is never written. The vectors are read once per
block and not shuffled.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bm25 import PLACES, top_k

#: Queries in a block: with 1,536 dimensions its matrix has 25 MB.
QUERY_BLOCK = 2048


def unit_rows(m: np.ndarray) -> np.ndarray:
    """Rows of length one; rows of zeros stay."""
    length = np.linalg.norm(m, axis=1, keepdims=True)
    return np.divide(m, length, out=np.zeros_like(m), where=length > 0)


def matrix(column: pa.Array, dim: int) -> np.ndarray:
    """A list column as rows of doubles; raises where a vector has another dimension."""
    lengths = np.diff(np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1])
    if len(column) and (column.null_count or (lengths != dim).any()):
        raise ValueError(f"expected vectors of dimension {dim}")
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)


def best_rows(scores: np.ndarray, k: int, ids: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(row, column) of the k highest of each row; of columns that tie with the last one
    those with the smallest ids."""
    if scores.shape[1] <= k:
        return np.nonzero(np.ones_like(scores, bool))
    last = -np.partition(-scores, k - 1, axis=1)[:, k - 1 : k]
    kept = scores >= last
    if (crowded := np.flatnonzero(kept.sum(axis=1) > k)).size:
        by_id = pc.sort_indices(ids).to_numpy()
        above = (scores > last).sum(axis=1)
        for i in crowded:
            ties = by_id[scores[i, by_id] == last[i, 0]]
            kept[i, ties[k - above[i] :]] = False
    return np.nonzero(kept)


def id_type(df: DataFrame, name: str = "id") -> str:
    return df.schema[name].dataType.simpleString()


def _search(qids: list, queries: np.ndarray, k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            scores = np.round(queries @ unit_rows(matrix(batch["embedding"], queries.shape[1])).T, PLACES)
            q, v = best_rows(scores, k, batch["id"])
            yield pa.RecordBatch.from_arrays([pa.array([qids[i] for i in q]), batch["id"].take(pa.array(v)), pa.array(scores[q, v])], ["qid", "id", "score"])

    return run


def check_dim(dim: int) -> None:
    if dim <= 0:
        raise ValueError(f"the dimension must be positive, not {dim}")


def exact_search(queries: DataFrame, vectors: DataFrame, dim: int, k: int = 10) -> DataFrame:
    """(qid, id, score, rank): the k nearest vectors(id, embedding) of each
    queries(qid, embedding) by cosine similarity. A zero vector scores 0; a vector of
    another dimension is an error; k above the number of vectors returns all."""
    check_dim(dim)
    blocks = -(-queries.count() // QUERY_BLOCK)
    found = None
    for i in range(max(1, blocks)):
        part = queries.where(F.pmod(F.xxhash64("qid"), F.lit(max(1, blocks))) == i).select("qid", "embedding").collect()
        wrong = [r.qid for r in part if r.embedding is None or len(r.embedding) != dim]
        if wrong:
            raise ValueError(f"queries {wrong[:3]} have no vector of dimension {dim}")
        m = unit_rows(np.array([r.embedding for r in part], np.float64).reshape(-1, dim))
        ddl = f"qid {id_type(queries, 'qid')}, id {id_type(vectors)}, score double"
        rows = vectors.select("id", "embedding").mapInArrow(_search([r.qid for r in part], m, k), ddl)
        found = rows if found is None else found.unionByName(rows)
    return top_k(found, k)
