"""Connected components of a table of links, by alternating star contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .store import Scratch


def _lowest(pairs: DataFrame) -> DataFrame:
    """(u, v) and the smallest of u and its partners. A node of very many partners is
    reduced on the map side; the join back is dealt out by the adaptive planner."""
    low = pairs.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return pairs.join(low, "u")


def components(links: DataFrame, scratch: Scratch, tag: str, rounds: int | None = None, most: int | None = None) -> DataFrame:
    """(id, component) of every id in links(a, b): the smallest id reachable.

    Each round replaces the links by stars round the smallest neighbours and is
    written; it ends when a round changes nothing. With `rounds` it ends after so many,
    and a component may still be in parts, each named by one of its ids. most: a bound
    on the number of links. Self-links and repeated links do no harm; no links give an
    empty table.
    """
    edges = scratch.write(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u != v").distinct(), f"{tag}-0", most)
    before, turn = None, 0
    while rounds is None or turn < rounds:
        if rounds is None:
            now = edges.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first()
            if now == before or not now[0]:
                break
            before = now
        turn += 1
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = _lowest(both).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        small = _lowest(large).select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e"))
        edges = scratch.write(small.select("e.u", "e.v").where("u != v").distinct(), f"{tag}-{turn}", most)
        scratch.drop(f"{tag}-{turn - 1}")
    found = edges.groupBy("u").agg(F.min("v").alias("component")).withColumnRenamed("u", "id")
    # The smallest ids name themselves; in parts, one may be named by another part.
    own = edges.select(F.col("v").alias("id")).distinct().join(found, "id", "left_anti").withColumn("component", F.col("id"))
    return found.unionByName(own)
