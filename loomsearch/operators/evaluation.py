"""Measures of search quality and latency."""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def floor_percentiles(rows: DataFrame, by: str, value: str, *ps: int) -> DataFrame:
    """For each `by` the values p50 and so on at place floor(n p / 100) of its sorted
    values, the last at most; not interpolated. Null values play no part. Values are
    counted first, so no group's values meet in one place."""
    counts = rows.where(F.col(value).isNotNull()).groupBy(by, value).agg(F.count("*").alias("n"))
    upto = F.sum("n").over(Window.partitionBy(by).orderBy(value))
    total = F.sum("n").over(Window.partitionBy(by))
    ranked = counts.select(by, value, upto.alias("upto"), total.alias("total"))
    at = lambda p: F.least(F.floor(F.col("total") * p / 100), F.col("total") - 1)
    return ranked.groupBy(by).agg(*[F.min(F.when(F.col("upto") > at(p), F.col(value))).alias(f"p{p}") for p in ps])


def latency_sweep(search: Callable[[str, str], object], queries: list[str], modes: tuple[str, ...]) -> dict[str, dict[str, float]]:
    """Milliseconds of search(mode, query) one query at a time: mean and the floor
    percentiles of each mode."""
    out = {}
    for mode in modes:
        took = []
        for query in queries:
            began = time.perf_counter()
            search(mode, query)
            took.append(1000 * (time.perf_counter() - began))
        took.sort()
        out[mode] = {f"p{p}": round(took[min(len(took) * p // 100, len(took) - 1)], 2) for p in (50, 95, 99)} | {"mean": round(sum(took) / len(took), 2)}
    return out


def recall_at_k(found: DataFrame, truth: DataFrame, k: int) -> DataFrame:
    """(qid, recall) of every query of truth: the share of its true results that the
    first k of found hold, of k at most. Both have (qid, id, rank)."""
    want = truth.where(F.col("rank") <= k).groupBy("qid").agg(F.count("*").alias("wanted"))
    hit = truth.where(F.col("rank") <= k).join(found.where(F.col("rank") <= k).select("qid", "id"), ["qid", "id"]).groupBy("qid").agg(F.count("*").alias("hits"))
    return want.join(hit, "qid", "left").select("qid", (F.coalesce("hits", F.lit(0)) / F.least("wanted", F.lit(k))).alias("recall"))


def mean_recall(found: DataFrame, truth: DataFrame, k: int) -> DataFrame:
    return recall_at_k(found, truth, k).agg(F.round(F.avg("recall"), 6).alias("mean_recall"))
