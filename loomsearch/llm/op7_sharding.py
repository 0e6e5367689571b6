"""Sharding of documents by vector bin packing.

Each group of equal texts is a vector of bytes, tokens and rows. Groups are dealt to
cells by the hash of their text; each cell packs its groups, largest first, into bins,
taking for each group the bin whose residual capacity has the highest dot product with
it. Cells hold a fixed number of groups, so there are more of them in a larger table;
while there are more than MOST_CELLS, the bins of neighbouring cells are packed once
more, as groups of a larger cell. The bins of the last level, of which there are at
most MOST_CELLS * BINS, are packed into the shards on the driver. A group larger than a shard's fair share
in any of the three is cut into as few parts as fit; there are fewer than three times
as many such groups as shards, which bounds what is broadcast.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .store import Scratch

#: Bins of a cell; groups of a cell; cells whose bins meet in one cell of the level
#: above; cells of the last level.
BINS, GROUPS_PER_CELL, CELLS_PER_CELL, MOST_CELLS = 256, 20_000, 64, 1024
_SIZES = ["bytes", "tokens", "rows"]


def place(items: np.ndarray, n_bins: int) -> np.ndarray:
    """The bin of each item (a row of non-negative sizes): largest first, to the bin
    whose residual capacity has the highest dot product with the item. Capacity is the
    fair share of the total in each size."""
    total = items.sum(axis=0)
    scaled = items / np.where(total > 0, total, 1) * n_bins
    residual = np.ones((n_bins, items.shape[1]))
    out = np.empty(len(items), np.int64)
    for i in np.lexsort((np.arange(len(items)), -scaled.max(axis=1))):
        best = int(np.argmax(residual @ scaled[i]))
        residual[best] -= scaled[i]
        out[i] = best
    return out


def even_out(items: np.ndarray, bins: np.ndarray, n_bins: int, rounds: int = 1000) -> np.ndarray:
    """Moves single items from the bin with most of the first size to the one with
    least, as long as that brings the two nearer to each other."""
    bins, size = bins.copy(), items[:, 0]
    loads = np.bincount(bins, weights=size, minlength=n_bins)
    for _ in range(rounds):
        high, low = int(loads.argmax()), int(loads.argmin())
        gap = loads[high] - loads[low]
        own = np.flatnonzero((bins == high) & (size > 0) & (size < gap))
        if not len(own):
            break
        best = own[np.abs(size[own] - gap / 2).argmin()]
        bins[best] = low
        loads[high] -= size[best]
        loads[low] += size[best]
    return bins


def _place_cell(table: pa.Table) -> pa.Table:
    items = np.stack([table[c].to_numpy().astype(float) for c in _SIZES], axis=1)
    return table.append_column("bin", pa.array(place(items, BINS)))


def _number_rows(n_shards: int):
    """The place of each row among those of its shard in this partition."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        partition, seen = TaskContext.get().partitionId(), np.zeros(n_shards, np.int64)
        for batch in batches:
            shard = batch["shard"].to_numpy()
            order = np.argsort(shard, kind="stable")
            counts = np.bincount(shard, minlength=n_shards)
            nth = np.empty(len(shard), np.int64)
            nth[order] = np.arange(len(shard)) - np.repeat(np.cumsum(counts) - counts, counts)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(nth + seen[shard]), pa.array(np.full(len(shard), partition))], [*batch.schema.names, "nth", "part_of"])
            seen += counts

    return run


def assign_shards(docs: DataFrame, n_shards: int = 16, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Puts every row into one of n_shards shards of nearly equal bytes, tokens (words
    between white space) and rows; equal texts stay together unless they outgrow a
    shard's fair share.

    Returns one row per input row: id_col, size (UTF-8 bytes of the text plus 1),
    tokens, text_crc32 (unsigned), shard and slot (the row's place in its shard, from
    0 without gaps). A null text is empty. Null and repeated ids are carried as they
    are; an empty table gives an empty table; further columns play no part and are not
    returned.
    """
    scratch = Scratch(docs.sparkSession, "sharding")
    text = F.coalesce(docs[text_col].cast("string"), F.lit(""))
    rows = scratch.write(
        docs.select(
            docs[id_col].cast("long").alias("id"),
            (F.octet_length(text) + 1).cast("long").alias("size"),
            F.regexp_count(text, F.lit(r"\S+")).cast("long").alias("tokens"),
            F.crc32(text).alias("text_crc32"),
            F.xxhash64(text).alias("key_a"),
            F.xxhash64(F.lit(1), text).alias("key_b"),
        ),
        "rows",
    )
    sums = [F.sum("size").alias("bytes"), F.sum("tokens").alias("tokens"), F.count("*").alias("rows")]
    groups = scratch.write(rows.groupBy("key_a", "key_b").agg(*sums), "groups")
    totals = groups.agg(*[F.sum(c).alias(c) for c in _SIZES], F.count("*").alias("n")).first()
    share = F.greatest(F.lit(0.0), F.lit(0.0), *[F.col(c) * float(n_shards) / float(totals[c]) for c in _SIZES if totals[c]])
    large = groups.select("key_a", "key_b", F.ceil(share).cast("int").alias("parts")).where("parts > 1")
    part = F.coalesce(F.pmod(F.xxhash64("id", "size"), F.col("parts")), F.lit(0)).cast("int")
    parted = rows.join(F.broadcast(large), ["key_a", "key_b"], "left").withColumn("part", part).drop("parts")
    cells = max(16, totals["n"] // GROUPS_PER_CELL + 1)
    units = parted.groupBy("key_a", "key_b", "part").agg(*sums).withColumn("cell", F.pmod(F.xxhash64("key_a", "part"), F.lit(cells)))
    sized = "bytes long, tokens long, rows long, cell long, bin long"
    levels = [scratch.write(units.groupBy("cell").applyInArrow(_place_cell, f"key_a long, key_b long, part int, {sized}"), "binned")]
    while cells > MOST_CELLS:
        below = levels[-1].groupBy(F.col("cell").alias("sub_cell"), F.col("bin").alias("sub_bin")).agg(*[F.sum(c).alias(c) for c in _SIZES])
        below = below.withColumn("cell", F.floor(F.col("sub_cell") / CELLS_PER_CELL).cast("long"))
        levels.append(scratch.write(below.groupBy("cell").applyInArrow(_place_cell, f"sub_cell long, sub_bin long, {sized}"), f"binned-{len(levels)}"))
        cells = -(-cells // CELLS_PER_CELL)
    bins = levels[-1].groupBy("cell", "bin").agg(*[F.sum(c).alias(c) for c in _SIZES]).orderBy("cell", "bin").toPandas()
    vectors = bins[_SIZES].to_numpy(float).reshape(-1, 3)
    bins["shard"] = even_out(vectors, place(vectors, n_shards), n_shards)
    of_bin = F.broadcast(docs.sparkSession.createDataFrame(bins[["cell", "bin", "shard"]], "cell long, bin long, shard int"))
    for above in reversed(levels[1:]):
        of_bin = above.select("sub_cell", "sub_bin", "cell", "bin").join(of_bin, ["cell", "bin"]).select(F.col("sub_cell").alias("cell"), F.col("sub_bin").alias("bin"), "shard")
    of_unit = levels[0].select("key_a", "key_b", "part", "cell", "bin").join(of_bin, ["cell", "bin"]).drop("cell", "bin")
    dealt = parted.join(of_unit, ["key_a", "key_b", "part"]).select("id", "size", "tokens", "text_crc32", "shard")
    numbered = scratch.write(dealt.mapInArrow(_number_rows(n_shards), "id long, size long, tokens long, text_crc32 long, shard int, nth long, part_of long"), "numbered")
    # One row for each partition and shard, summed up in the order of the partitions.
    earlier = Window.partitionBy("shard").orderBy("part_of").rowsBetween(Window.unboundedPreceding, -1)
    before = numbered.groupBy("part_of", "shard").count().select("part_of", "shard", F.coalesce(F.sum("count").over(earlier), F.lit(0)).alias("before"))
    result = scratch.write(numbered.join(before, ["part_of", "shard"]).select(F.col("id").alias(id_col), "size", "tokens", "text_crc32", "shard", (F.col("nth") + F.col("before")).alias("slot")), "result")
    scratch.drop("rows", "groups", "binned", *(f"binned-{i}" for i in range(1, len(levels))), "numbered")
    return result
