"""Approximate vector search.

IvfIndex: vectors are assigned to the nearest of a number of centroids; a query looks
into the lists of its nearest centroids only. A list is cut into blocks by the hash of
the id, so a list may have any number of vectors.

GraphIndex: vectors are dealt to shards of bounded size by the nearest of as many
centroids as there are shards, a shard that would be too large once more by the hash of
the id. Each shard has a proximity graph of its own: every node is joined with a diverse
choice of its ef_construction nearest, at most 2 m of them. A node's level is drawn by
the hash of its id, so that one in m has a level above 0; these are searched whole, and
from the best of them a query follows the graph with a beam of ef. A query goes to the shards of its nearest centroids, in blocks
of queries that walk in step, and the best of all shards are merged.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bm25 import PLACES, top_k
from .vector_search import best_rows, check_dim, id_type, matrix, unit_rows

#: Vectors that the centroids are fitted on, and centroids, at most.
SAMPLE_ROWS, MOST_LISTS = 20_000, 4096
BLOCK_ROWS, SHARD_ROWS = 50_000, 5_000
#: Shards of a graph that a query goes to, and queries that walk in step.
PROBES, WALKERS = 16, 256
#: Nodes of the upper levels from which a walk sets out.
ENTRIES = 16


def kmeans(rows: np.ndarray, n: int, seed: int, rounds: int = 15) -> np.ndarray:
    """Centroids of unit rows by spherical k-means; empty ones keep their place."""
    rng = np.random.default_rng(seed)
    centres = rows[rng.choice(len(rows), min(n, len(rows)), replace=False)]
    for _ in range(rounds):
        own = np.argmax(rows @ centres.T, axis=1)
        sums = np.zeros_like(centres)
        np.add.at(sums, own, rows)
        used = np.bincount(own, minlength=len(centres)) > 0
        centres = np.where(used[:, None], unit_rows(sums), centres)
    return centres


def _near(centres: np.ndarray, probes: int, blocks: int | None):
    """Each row with the numbers of its nearest centroids; blocks: a query goes to
    every block of a list, a vector (None) to its own."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            near = np.argsort(-(unit_rows(matrix(batch["embedding"], centres.shape[1])) @ centres.T), axis=1, kind="stable")[:, :probes]
            row = np.repeat(np.arange(batch.num_rows), near.shape[1] * (blocks or 1))
            lists = np.repeat(near.ravel(), blocks or 1)
            taken = batch.take(pa.array(row))
            extra = [pa.array(lists)] + ([pa.array(np.tile(np.arange(blocks), near.size))] if blocks else [])
            yield pa.RecordBatch.from_arrays([*taken.columns, *extra], [*taken.schema.names, "list"] + (["block"] if blocks else []))

    return run


def _score(k: int, dim: int):
    def run(key: tuple, queries: pa.Table, vectors: pa.Table) -> pa.Table:
        q, v = queries.combine_chunks(), vectors.combine_chunks()
        names = ["qid", "id", "score"]
        if not q.num_rows or not v.num_rows:
            return pa.table([q["qid"].slice(0, 0), v["id"].slice(0, 0), pa.array([], pa.float64())], names)
        scores = np.round(unit_rows(matrix(q["embedding"].chunk(0), dim)) @ unit_rows(matrix(v["embedding"].chunk(0), dim)).T, PLACES)
        row, col = best_rows(scores, k, v["id"])
        return pa.table([q["qid"].take(pa.array(row)), v["id"].take(pa.array(col)), pa.array(scores[row, col])], names)

    return run


def fitted_centres(vectors: DataFrame, n: int, dim: int, n_lists: int, seed: int = 0) -> np.ndarray:
    """At most n_lists centroids of a bounded sample of the n vectors(id, embedding)."""
    likely = vectors.where(F.pmod(F.xxhash64(F.lit(17), "id"), F.lit(1 << 30)) < int((1 << 30) * min(1.0, 2 * SAMPLE_ROWS / max(n, 1))))
    sample = (likely if n > 4 * SAMPLE_ROWS else vectors).orderBy(F.xxhash64("id")).limit(SAMPLE_ROWS).select("embedding").toArrow()["embedding"].combine_chunks()
    sample = sample.chunk(0) if isinstance(sample, pa.ChunkedArray) else sample
    rows = unit_rows(matrix(sample, dim))
    return kmeans(rows, min(n_lists, MOST_LISTS), seed) if len(rows) else np.zeros((1, dim))


@dataclass(frozen=True)
class IvfIndex:
    vectors: DataFrame
    centres: np.ndarray
    blocks: int

    @staticmethod
    def build(vectors: DataFrame, dim: int, n_lists: int = 64, seed: int = 0, centres: np.ndarray | None = None) -> IvfIndex:
        """vectors(id, embedding) by list. n_lists is at most MOST_LISTS; centres: those
        of another index, to be used instead of new ones."""
        check_dim(dim)
        n = vectors.count()
        source = vectors.select("id", F.col("embedding").cast("array<float>").alias("embedding"))
        centres = fitted_centres(source, n, dim, n_lists, seed) if centres is None else centres
        blocks = int(n // len(centres) // BLOCK_ROWS + 1)
        ddl = f"id {id_type(vectors)}, embedding array<float>, list long"
        listed = source.mapInArrow(_near(centres, 1, None), ddl)
        return IvfIndex(listed.withColumn("block", F.pmod(F.xxhash64("id"), F.lit(blocks))), centres, blocks)

    def search(self, queries: DataFrame, k: int = 10, probes: int = 8) -> DataFrame:
        """(qid, id, score, rank) from the `probes` nearest lists of each query."""
        dim = self.centres.shape[1]
        ddl = f"qid {id_type(queries, 'qid')}, embedding array<float>, list long, block long"
        source = queries.select("qid", F.col("embedding").cast("array<float>").alias("embedding"))
        asked = source.mapInArrow(_near(self.centres, probes, self.blocks), ddl)
        out = f"qid {id_type(queries, 'qid')}, id {id_type(self.vectors)}, score double"
        rows = asked.groupBy("list", "block").cogroup(self.vectors.groupBy("list", "block")).applyInArrow(_score(k, dim), out)
        return top_k(rows, k)


def diverse(candidates: np.ndarray, similarity: np.ndarray, own: np.ndarray, m: int) -> list[int]:
    """At most m of the candidates, nearest first, each nearer to the node than to any
    chosen before; filled up with the nearest left out. similarity: among candidates;
    own: with the node."""
    chosen, left = [], []
    for i in range(len(candidates)):
        if len(chosen) == m:
            break
        (chosen if all(similarity[i, j] < own[i] for j in chosen) else left).append(i)
    return [int(candidates[i]) for i in (chosen + left)[:m]]


def proximity_graph(rows: np.ndarray, m: int, ef_construction: int) -> list[list[int]]:
    """Neighbours of each unit row, joined both ways and pruned to 2 m."""
    n = len(rows)
    near: list[list[int]] = [[] for _ in range(n)]
    for a in range(0, n, 512):
        scores = rows[a : a + 512] @ rows.T
        for i in range(len(scores)):
            scores[i, a + i] = -2
            order = np.argsort(-scores[i], kind="stable")[: min(ef_construction, n - 1)]
            near[a + i] = diverse(order, rows[order] @ rows[order].T, scores[i, order], m)
    both = [dict.fromkeys(x) for x in near]
    for i, x in enumerate(near):
        for j in x:
            both[j].setdefault(i)
    out = []
    for i, x in enumerate(both):
        own = np.array(list(x), int)
        if len(own) > 2 * m:
            sims = rows[own] @ rows[i]
            order = np.argsort(-sims, kind="stable")
            own = np.array(diverse(own[order], rows[own[order]] @ rows[own[order]].T, sims[order], 2 * m))
        out.append([int(j) for j in own])
    return out


def random_levels(ids: list, m: int) -> np.ndarray:
    """floor(-ln(u) / ln(m)) of each id, with u in (0, 1) by its hash."""
    u = (np.array([xxhash.xxh3_64_intdigest(str(i)) for i in ids], np.float64) + 0.5) / 2.0**64
    return np.floor(-np.log(u) / np.log(max(m, 2))).astype(np.int32)


def top_nodes(levels: np.ndarray) -> np.ndarray:
    """The nodes above level 0, or all where there are none."""
    return np.flatnonzero(levels > 0) if (levels > 0).any() else np.arange(len(levels))


def padded(near: list[list[int]]) -> np.ndarray:
    """Neighbours as rows of equal length, filled up with -1."""
    out = np.full((len(near), max(map(len, near), default=1) or 1), -1, np.int32)
    for row, x in zip(out, near, strict=True):
        row[: len(x)] = x
    return out


def best_of(scores: np.ndarray, n: int) -> np.ndarray:
    """Columns of the n highest of each row, in no order."""
    return np.argpartition(-scores, n - 1, axis=1)[:, :n] if scores.shape[1] > n else np.tile(np.arange(scores.shape[1]), (len(scores), 1))


def beam_search(queries: np.ndarray, rows: np.ndarray, near: np.ndarray, upper: np.ndarray, ef: int) -> tuple[np.ndarray, np.ndarray]:
    """(nodes, scores) of the ef best nodes that a best-first walk of each query meets,
    -1 for none. All queries take a step at a time: each visits the neighbours of its
    best node that is not expanded yet, until its beam holds no such node."""
    n_queries, n = len(queries), len(rows)
    above = queries @ rows[upper].T
    first = best_of(above, min(ENTRIES, ef))
    nodes = np.full((n_queries, ef), -1, np.int64)
    scores = np.full((n_queries, ef), -np.inf, rows.dtype)
    nodes[:, : first.shape[1]], scores[:, : first.shape[1]] = upper[first], np.take_along_axis(above, first, axis=1)
    open_ = nodes >= 0
    seen = np.zeros(n_queries * n, bool)
    seen[(np.arange(n_queries)[:, None] * n + nodes)[open_]] = True
    walking = np.arange(n_queries)
    while len(walking):
        ahead = np.where(open_[walking], scores[walking], -np.inf)
        at = ahead.argmax(axis=1)
        going = ahead[np.arange(len(walking)), at] > -np.inf
        walking, at = walking[going], at[going]
        open_[walking, at] = False
        met = near[nodes[walking, at]]
        keys = (walking[:, None] * n + met)[met >= 0]
        keys = keys[~seen[keys]]
        if not len(keys):
            continue
        seen[keys] = True
        who, which = np.divmod(keys, n)
        fresh = np.einsum("ij,ij->i", queries[who], rows[which])
        # keys are in the order of the queries: one row of new nodes for each of them.
        movers, begin, counts = np.unique(who, return_index=True, return_counts=True)
        place = np.arange(len(who)) - np.repeat(begin, counts)
        own = np.repeat(np.arange(len(movers)), counts)
        more_nodes = np.full((len(movers), int(counts.max())), -1, np.int64)
        more_scores = np.full(more_nodes.shape, -np.inf, rows.dtype)
        more_nodes[own, place], more_scores[own, place] = which, fresh
        all_nodes, all_scores = np.hstack([nodes[movers], more_nodes]), np.hstack([scores[movers], more_scores])
        all_open = np.hstack([open_[movers], more_nodes >= 0])
        kept = best_of(all_scores, ef)
        nodes[movers], scores[movers], open_[movers] = (np.take_along_axis(x, kept, axis=1) for x in (all_nodes, all_scores, all_open))
    return nodes, scores


@dataclass(frozen=True)
class GraphIndex:
    """nodes: (shard, node, id, embedding, neighbours, level), embeddings of length one;
    centres: the centroid of each of the shards, where there are several; a shard whose
    centroid is not a number is asked by every query."""

    nodes: DataFrame
    dim: int
    ef_search: int
    shards: list[int]
    centres: np.ndarray | None = None

    @staticmethod
    def build(vectors: DataFrame, dim: int, m: int = 16, ef_construction: int = 200, ef_search: int = 50) -> GraphIndex:
        check_dim(dim)
        n, kind = vectors.count(), id_type(vectors)
        source = vectors.select("id", F.col("embedding").cast("array<float>").alias("embedding"))
        if n <= SHARD_ROWS:
            shards, centres, dealt = [0], None, source.withColumn("shard", F.lit(0).cast("long"))
        else:
            centres = fitted_centres(source, n, dim, -(-n // SHARD_ROWS))
            listed = source.mapInArrow(_near(centres, 1, None), f"id {kind}, embedding array<float>, list long")
            # One row for each list: at most MOST_LISTS.
            parts = {r["list"]: -(-r["n"] // SHARD_ROWS) for r in listed.groupBy("list").agg(F.count("*").alias("n")).collect()}
            first = np.cumsum([0] + [parts.get(i, 0) for i in range(len(centres))])
            of_list = source.sparkSession.createDataFrame([(i, int(first[i]), p) for i, p in parts.items()], "list long, first long, parts long")
            dealt = listed.join(F.broadcast(of_list), "list").select("id", "embedding", (F.col("first") + F.pmod(F.xxhash64("id"), F.col("parts"))).alias("shard"))
            shards, centres = list(range(int(first[-1]))), np.repeat(centres, np.diff(first), axis=0)

        def build_shard(table: pa.Table) -> pa.Table:
            table = table.sort_by("id").combine_chunks()
            rows = unit_rows(matrix(table["embedding"].chunk(0), dim))
            near = proximity_graph(rows, m, ef_construction)
            return pa.table([table["shard"], pa.array(np.arange(len(rows))), table["id"], pa.array(list(rows.astype(np.float32)), pa.list_(pa.float32())), pa.array(near, pa.list_(pa.int64())), pa.array(random_levels(table["id"].to_pylist(), m))], ["shard", "node", "id", "embedding", "neighbours", "level"])

        ddl = f"shard long, node long, id {kind}, embedding array<float>, neighbours array<long>, level int"
        nodes = dealt.select("shard", "id", "embedding").groupBy("shard").applyInArrow(build_shard, ddl)
        return GraphIndex(nodes, dim, ef_search, shards, centres)

    def max_level(self) -> DataFrame:
        """The highest level in each shard."""
        return self.nodes.groupBy("shard").agg(F.max("level").alias("max_level"))

    def candidates(self, queries: DataFrame, beam: int, k: int | None = None, probes: int = PROBES) -> DataFrame:
        """(qid, id, score, shard) of the k best (or all) of the beam in each shard that
        a query goes to."""
        k, dim, shards, centres = k or beam, self.dim, np.array(self.shards, np.int64), self.centres
        always = np.zeros(len(shards), bool) if centres is None else np.isnan(centres).any(axis=1)
        asked_by_one = min(probes + int(always.sum()), len(shards))
        blocks = max(1, -(-queries.count() // (2 * WALKERS)))

        def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                if centres is None or len(shards) == asked_by_one:
                    near = np.tile(shards, (batch.num_rows, 1))
                else:
                    scores = unit_rows(matrix(batch["embedding"], dim)) @ np.nan_to_num(centres).T
                    scores[:, always] = np.inf
                    # The parts of a list share its centroid, and all of them are asked.
                    near = [shards[row >= last] for row, last in zip(scores, -np.partition(-scores, asked_by_one - 1, axis=1)[:, asked_by_one - 1], strict=True)]
                taken = batch.take(pa.array(np.repeat(np.arange(batch.num_rows), [len(x) for x in near])))
                yield pa.RecordBatch.from_arrays([*taken.columns, pa.array(np.concatenate([*near, np.empty(0, np.int64)]).astype(np.int64))], [*taken.schema.names, "shard"])

        asked = queries.select("qid", F.col("embedding").cast("array<float>").alias("embedding"), F.pmod(F.xxhash64("qid"), F.lit(blocks)).alias("block"))
        asked = asked.mapInArrow(deal, f"qid {id_type(queries, 'qid')}, embedding array<float>, block long, shard long")
        nodes = self.nodes.withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long")))) if blocks > 1 else self.nodes.withColumn("block", F.lit(0).cast("long"))

        def search_shard(key: tuple, q: pa.Table, v: pa.Table) -> pa.Table:
            q, v = q.combine_chunks(), v.sort_by("node").combine_chunks()
            qids, ids, found = [pa.array([], q.schema.field("qid").type)], [pa.array([], v.schema.field("id").type)], [np.empty(0)]
            if q.num_rows and v.num_rows:
                exact = matrix(v["embedding"].chunk(0), dim)
                rows, near = exact.astype(np.float32), padded(v["neighbours"].to_pylist())
                upper = top_nodes(v["level"].to_numpy())
                asking = unit_rows(matrix(q["embedding"].chunk(0), dim))
                for a in range(0, len(asking), WALKERS):
                    part = asking[a : a + WALKERS]
                    met, scores = beam_search(part.astype(np.float32), rows, near, upper, min(beam, len(rows)))
                    best = best_of(scores, min(k, scores.shape[1]))
                    who, which = np.repeat(np.arange(len(part)), best.shape[1]), np.take_along_axis(met, best, axis=1).ravel()
                    who, which = who[which >= 0], which[which >= 0]
                    qids.append(q["qid"].take(pa.array(who + a)).combine_chunks())
                    ids.append(v["id"].take(pa.array(which)).combine_chunks())
                    found.append(np.round(np.einsum("ij,ij->i", part[who], exact[which]), PLACES))
            parts = [pa.chunked_array(x, type=x[0].type) for x in (qids, ids)]
            scores = np.concatenate(found)
            return pa.table([*parts, pa.array(scores), pa.array(np.full(len(scores), key[0].as_py(), np.int64))], ["qid", "id", "score", "shard"])

        out = f"qid {id_type(queries, 'qid')}, id {id_type(self.nodes)}, score double, shard long"
        return asked.groupBy("shard", "block").cogroup(nodes.groupBy("shard", "block")).applyInArrow(search_shard, out)

    def search(self, queries: DataFrame, k: int = 10, ef: int | None = None, probes: int = PROBES) -> DataFrame:
        """(qid, id, score, rank); the beam has max(ef or ef_search, k) nodes."""
        return top_k(self.candidates(queries, max(ef or self.ef_search, k), k, probes).drop("shard"), k)
