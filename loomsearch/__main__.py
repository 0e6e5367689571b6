"""Command line: a worker, searches and the state of an engine's folder.

    python -m loomsearch ROOT worker [--once] [--chunk-size N] [--chunk-overlap N] [--worker I --workers N]
    python -m loomsearch ROOT search COLLECTION QUERY [--top-k N] [--alpha X]
    python -m loomsearch ROOT stats
    python -m loomsearch ROOT latency COLLECTION QUERY...
"""

from __future__ import annotations

import argparse
import json
import signal

from pyspark.sql import SparkSession

from .engine import Engine
from .operators.evaluation import latency_sweep

#: Weights of the vectors in the three ways to search.
MODES = {"keyword": 0.0, "vector": 1.0, "hybrid": 0.5}


def parser() -> argparse.ArgumentParser:
    whole = argparse.ArgumentParser(prog="loomsearch", description="Hybrid search on Spark")
    whole.add_argument("root", help="the engine's folder")
    parts = whole.add_subparsers(dest="command", required=True)
    worker = parts.add_parser("worker", help="ingest what comes into the inbox")
    worker.add_argument("--once", action="store_true", help="stop when the inbox is empty")
    worker.add_argument("--chunk-size", type=int, default=512)
    worker.add_argument("--chunk-overlap", type=int, default=64)
    worker.add_argument("--worker", type=int, default=0, help="the number of this worker")
    worker.add_argument("--workers", type=int, default=1, help="how many there are")
    search = parts.add_parser("search", help="search a collection")
    search.add_argument("collection")
    search.add_argument("query")
    search.add_argument("--top-k", type=int, default=10)
    search.add_argument("--alpha", type=float, default=0.5)
    parts.add_parser("stats", help="the collections and their figures")
    latency = parts.add_parser("latency", help="time queries one by one in three modes")
    latency.add_argument("collection")
    latency.add_argument("queries", nargs="+")
    return whole


def run(spark: SparkSession, arguments: list[str] | None = None) -> object:
    """Runs a command; what it found is printed as JSON and returned."""
    a = parser().parse_args(arguments)
    engine = Engine(spark, a.root)
    if a.command == "worker":
        query = engine.work(a.once, a.worker, a.workers, chunk_size=a.chunk_size, chunk_overlap=a.chunk_overlap)
        if not a.once:  # the batch at hand is finished first
            signal.signal(signal.SIGTERM, lambda *_: query.stop())
        query.awaitTermination()
        return None
    if a.command == "search":
        found: object = engine.answer(a.collection, a.query, top_k=a.top_k, alpha=a.alpha)
    elif a.command == "stats":
        found = engine.collections()
    else:
        found = latency_sweep(lambda mode, query: engine.search(a.collection, query, alpha=MODES[mode]), a.queries, tuple(MODES))
    print(json.dumps(found))
    return found


if __name__ == "__main__":
    run(SparkSession.builder.appName("loomsearch").getOrCreate())
