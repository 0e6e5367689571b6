"""Near-duplicate classes of texts by a multi-index Hamming join of MinHash signatures.

A text's set is its distinct word shingles. Texts of equal sets form one class, whose
smallest id stands for it. The signature of a set is 32 components of 16 bits, each
cut from the minimum of one hash permutation; the signature distance is the number of
components that differ, which for similarity J is binomial with mean 32 (1 - J). The
largest distance that is searched leaves out a pair at the similarity threshold with
probability under 1 in 10,000, and more similar pairs far more rarely.

Signatures are split into so many chunks that, by the pigeonhole principle, two within
that distance differ in at most one component of some chunk. One error is enumerated
by leaving out each component of a chunk in turn: pairs within the distance share at
least one of the 32 keys, without exception.

Keys that several classes share are confirmed on the full sets, in three passes that
together settle every pair of a key without listing the pairs of a large group:

1. Every member against the key's hub, the member that shares most keys with others.
2. In keys whose members are not yet connected: every member against the hub of what
   is apart from the first hub.
3. What is still apart. Let h be the hub and n its size, and for a text x let a(x) and
   d(x) be the numbers of elements that h lacks and that x lacks. For a pair u, v with
   J(u, h) under the threshold t, J(u, v) reaches t only if their differences from h
   agree in at least (d(u) + d(v) + t (a(u) + a(v)) - (1 - t) n) / (1 + t) elements.
   So with both differences in one order, they share an element after which either has
   that many left. Only such pairs are confirmed. The order puts elements that are
   frequent in a bounded sample of the differences last; it decides how many pairs are
   tried, not which are found.

Pairs that are connected already are not compared, for they cannot change a class.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import ceil, comb

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.partitions import spread
from .components import components
from .store import Scratch, batches_of, hashed_sample
from .words import Words, as_array, byte_lengths, give_back, mix, slices, windows

COMPONENTS, LANES = 32, 8
#: Share of pairs at the very threshold that may exceed the searched distance.
MISSED = 1e-4
#: Pairs that are sampled for the frequency of elements, and elements that are noted.
SAMPLED_PAIRS, FREQUENT = 2_000, 100_000
#: Text of the pairs that a task compares at once, differences that it hands on at
#: once, and rows of a batch of pairs: bounds of its memory.
PAIR_BYTES, DIFFERENCES, PAIRS_PER_BATCH = 2 << 20, 200_000, 256
#: Texts and pairs that a task writes or compares at once.
TEXTS_PER_FILE, PAIRS_PER_FILE = 5_000, 4_000

_RANDOM = np.random.default_rng(20)
_XOR = _RANDOM.integers(0, 1 << 63, COMPONENTS, dtype=np.uint64)
_TIMES = _RANDOM.integers(0, 1 << 63, COMPONENTS, dtype=np.uint64) | np.uint64(1)
_SIGNS = [f"s{i}" for i in range(LANES)]


def largest_distance(similarity: float) -> int:
    """The smallest signature distance that a pair of this similarity exceeds with
    probability under MISSED."""
    p, tail = 1 - similarity, 1.0
    for d in range(COMPONENTS):
        tail -= comb(COMPONENTS, d) * p**d * (1 - p) ** (COMPONENTS - d)
        if tail < MISSED:
            return d
    return COMPONENTS


def chunks_for(distance: int) -> list[list[int]]:
    """Component numbers of each chunk: with ceil((distance + 1) / 2) chunks, some
    chunk has at most one error."""
    n = min(COMPONENTS // 2, ceil((distance + 1) / 2))
    return [list(map(int, x)) for x in np.array_split(np.arange(COMPONENTS), n)]


def _sets(texts: pa.Array, n: int) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text; a text of fewer words than n
    is one shingle, without words none."""
    words = Words(texts, lower=True)
    (hashes,) = words.hashes()
    rolled, starts = windows(hashes, words.first, n)
    bounds = np.searchsorted(starts, words.first)
    out = []
    for i, count in enumerate(words.counts()):
        if count >= n:
            out.append(np.unique(rolled[bounds[i] : bounds[i + 1]]))
        else:
            own = hashes[words.first[i] : words.first[i + 1]].tobytes()
            out.append(np.array([xxhash.xxh3_64_intdigest(own, seed=int(count))] if count else [], np.uint64))
    return out


def _sums(sets: list[np.ndarray]) -> list[np.ndarray]:
    """The size of each set and two 64-bit sums of hashes of its elements."""
    sizes = np.array([len(x) for x in sets], np.int64)
    full, sums = sizes > 0, np.zeros((2, len(sets)), np.uint64)
    if full.any():
        joined, at = np.concatenate(sets), np.append(0, np.cumsum(sizes[full])[:-1])
        sums[0, full] = np.add.reduceat(mix(joined), at)
        sums[1, full] = np.add.reduceat(mix(joined ^ _XOR[0]), at)
    return [sizes, sums[0].view(np.int64), sums[1].view(np.int64)]


def _signatures(n: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = as_array(batch["text"])
            for a, b in slices(texts, 4 << 20):
                sets = _sets(texts.slice(a, b - a), n)
                sizes, *sums = _sums(sets)
                full, sign = sizes > 0, np.zeros((len(sets), COMPONENTS), np.uint16)
                if full.any():
                    joined, at = np.concatenate(sets), np.append(0, np.cumsum(sizes[full])[:-1])
                    for j in range(COMPONENTS):
                        sign[full, j] = mix(np.minimum.reduceat((joined ^ _XOR[j]) * _TIMES[j], at)).astype(np.uint16)
                lanes = np.ascontiguousarray(sign).view(np.int64)
                yield pa.RecordBatch.from_arrays(
                    [batch["id"].slice(a, b - a), *map(pa.array, (sizes, *sums)), *(pa.array(np.ascontiguousarray(lanes[:, i])) for i in range(LANES))],
                    ["id", "n_shingles", "set_a", "set_b", *_SIGNS],
                )

    return run


def _keys(chunks: list[list[int]]):
    """(key, node): for each chunk and each of its components, the others' hash."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            sign = np.stack([batch[c].to_numpy() for c in _SIGNS], axis=1).view(np.uint16).astype(np.uint64)
            keys = []
            for number, chunk in enumerate(chunks):
                for left_out in chunk:
                    key = np.full(len(sign), number * 64 + left_out + 1, np.uint64)
                    for c in chunk:
                        if c != left_out:
                            key = mix(key * np.uint64(0x9E3779B97F4A7C15) + sign[:, c])
                    keys.append(key.view(np.int64))
            nodes = batch["node"].to_numpy()
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(keys)), pa.array(np.tile(nodes, len(keys)))], ["key", "node"])

    return run


def _texts_of_classes(n: int):
    """(node, text) of the rows whose set is that of the class they were joined with."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = as_array(batch["text"])
            for a, b in slices(texts, 4 << 20):
                sets = _sets(texts.slice(a, b - a), n)
                own = [pa.array(x) for x in _sums(sets)]
                same = [pc.equal(x, batch[c].slice(a, b - a)) for x, c in zip(own, ("n_shingles", "set_a", "set_b"), strict=True)]
                mine = pc.and_(pc.and_(*same[:2]), same[2])
                yield pa.RecordBatch.from_arrays([batch["node"].slice(a, b - a).filter(mine), texts.slice(a, b - a).cast(pa.string()).filter(mine)], ["node", "text"])

    return run


def _pairs_of_sets(n: int, batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, list[np.ndarray], list[np.ndarray]]]:
    """The pairs in runs of a few megabytes of text, with the sets of both sides; the
    set of a is made once for neighbouring rows of the same a."""
    for batch in batches:
        if not batch.num_rows:
            continue
        left, right, a = as_array(batch["text_a"]), as_array(batch["text_b"]), batch["a"].to_numpy()
        new = np.append(True, a[1:] != a[:-1])
        cost = np.cumsum(byte_lengths(right) + new * byte_lengths(left))
        first = 0
        while first < len(a):
            last = max(first + 1, int(np.searchsorted(cost, (cost[first - 1] if first else 0) + PAIR_BYTES, side="right")))
            own = new[first:last].copy()
            own[0] = True
            sets = _sets(left.slice(first, last - first).filter(pa.array(own)), n)
            yield batch.slice(first, last - first), [sets[i] for i in np.cumsum(own) - 1], _sets(right.slice(first, last - first), n)
            first = last
    give_back()


def _within(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Which elements of x are in y; both sorted."""
    return y[np.minimum(np.searchsorted(y, x), len(y) - 1)] == x if len(y) else np.zeros(len(x), bool)


def _confirm(n: int, percent: int):
    """(a, b, linked, and the sizes of both sets and of what they share): linked where
    the full sets reach the similarity."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, xs, ys in _pairs_of_sets(n, batches):
            size_a, size_b = (np.array([len(x) for x in sets], np.int64) for sets in (xs, ys))
            common = np.array([np.count_nonzero(_within(x, y)) for x, y in zip(xs, ys, strict=True)], np.int64)
            linked = 100 * common >= percent * (size_a + size_b - common)
            yield pa.RecordBatch.from_arrays([batch["a"], batch["b"], *map(pa.array, (linked, size_a, size_b, common))], ["a", "b", "linked", "size_a", "size_b", "common"])

    return run


def _apart(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    return np.concatenate([x[~_within(x, y)], y[~_within(y, x)]])


def _all_differences(n: int):
    """Every element in which b differs from its hub a."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, xs, ys in _pairs_of_sets(n, batches):
            for x, y in zip(xs, ys, strict=True):
                yield pa.RecordBatch.from_arrays([pa.array(_apart(x, y).view(np.int64))], ["element"])

    return run


def _differences(n: int, percent: int, frequent: dict[int, int]):
    """Elements in which b differs from its hub a, in one order for all b, with the
    number of elements from there on (rest) and the part of b in the agreement that is
    needed, times 100 + percent (need). Rows that ask stand for every b, the others
    for a b that is not linked with the hub; each holds as many elements as can be the
    first that two texts share, when the other needs no less than `least_asks` or
    `least_open`, the smallest of its kind with this hub."""
    whole = 100 + percent
    known = np.array(sorted(frequent), np.int64)
    times = np.array([frequent[e] for e in known.tolist()], np.int64)
    names = ["a", "element", "b", "c", "asks", "rest", "need"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, held = [], 0

        def flush() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in zip(*parts, strict=True)], names)

        for batch, xs, ys in _pairs_of_sets(n, batches):
            columns = (batch[c].to_pylist() for c in ("a", "b", "c", "linked", "need", "least_asks", "least_open"))
            for a, b, c, linked, need, least_asks, least_open, x, y in zip(*columns, xs, ys, strict=True):
                apart = _apart(x, y).view(np.int64)
                often = np.where(_within(apart, known), times[np.minimum(np.searchsorted(known, apart), len(known) - 1)], 0) if len(known) else np.zeros(len(apart), np.int64)
                apart = apart[np.lexsort((apart, often))]
                size = len(apart)
                open_need = need - (100 - percent) * len(x)
                for asks, own, other in ((True, need, least_open), (False, open_need, least_asks)):
                    first = size - max(1, -(-(own + other) // whole)) + 1
                    if first > 0 and (asks or not linked):
                        fixed = [np.full(first, v) for v in (b, c, asks)]
                        parts.append([np.full(first, a), apart[:first], *fixed, size - np.arange(first), np.full(first, own)])
                        held += first
                if held > DIFFERENCES:
                    yield flush()
                    parts, held = [], 0
        if parts:
            yield flush()

    return run


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, percent: int = 80) -> DataFrame:
    """Classes of near-duplicate texts: linked where 100 * intersection size >=
    percent * union size of their sets of `shingle`-word shingles (A-Z lower-cased;
    words are runs of bytes other than ASCII white space), and chains of links.

    Returns one row per input row: id_col, n_shingles (long), component_id (the
    smallest id reachable) and kept (id_col = component_id). A text with fewer words
    than a shingle is one shingle; a null or blank text has none and is linked with
    nothing. A row with a null id is linked with nothing, has a null component and is
    kept. Rows that share an id share a class. An empty table gives an empty table;
    further columns of docs play no part and are not returned.
    """
    spark, scratch = docs.sparkSession, Scratch(docs.sparkSession, "near")
    distance = largest_distance(percent / 100)
    chunks = chunks_for(distance)
    source = docs.select(docs[id_col].cast("long").alias("id"), docs[text_col].cast("string").alias("text"))
    longs = ", ".join(f"{x} long" for x in ["id", "n_shingles", "set_a", "set_b", *_SIGNS])
    signed = scratch.write(spread(source).mapInArrow(_signatures(shingle), longs), "signed")
    same_set = ["n_shingles", "set_a", "set_b"]
    named = signed.where("n_shingles > 0 AND id IS NOT NULL")
    # A class is a node of the graph of links; its number says nothing but which it is.
    by_set = named.groupBy(*same_set).agg(F.min("id").alias("id"), *[F.min(s).alias(s) for s in _SIGNS])
    n = signed.count()
    classes = scratch.write(by_set.withColumn("node", F.monotonically_increasing_id()), "classes", n)

    keys = classes.select("node", *_SIGNS).mapInArrow(_keys(chunks), "key long, node long")
    shared = keys.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
    met = scratch.write(keys.join(shared, "key"), "met", n * COMPONENTS, 500_000)
    n_met = met.count()
    degree = met.groupBy("node").agg(F.sum("n").alias("degree"))
    ranked = scratch.write(met.select("key", "node").join(degree, "node"), "ranked", n_met)
    most_shared = F.struct("degree", -F.col("node"))
    hubs = ranked.groupBy("key").agg(F.max_by("node", most_shared).alias("hub"))
    members = scratch.write(ranked.join(hubs, "key"), "members", n_met)
    repeated_ids = scratch.write(named.groupBy("id").agg(F.count("*").alias("n")).where("n > 1").select("id"), "repeated-ids", n)
    repeated = not repeated_ids.isEmpty()
    wanted = classes.join(members.select("node").distinct(), "node", "left_semi").select("id", "node", *same_set)
    texts = source.join(wanted, "id").mapInArrow(_texts_of_classes(shingle), "node long, text string")
    texts = scratch.write(texts.dropDuplicates(["node"]) if repeated else texts, "texts", n, TEXTS_PER_FILE)

    def with_texts(pairs: DataFrame) -> DataFrame:
        b = pairs.join(texts.select(F.col("node").alias("b"), F.col("text").alias("text_b")), "b")
        return b.join(texts.select(F.col("node").alias("a"), F.col("text").alias("text_a")), "a")

    def confirmed(pairs: DataFrame, step: int) -> DataFrame:
        pairs = scratch.write(pairs, f"pairs-{step}", n_met)
        return scratch.write(with_texts(pairs).mapInArrow(_confirm(shingle, percent), "a long, b long, linked boolean, size_a long, size_b long, common long"), f"tried-{step}", pairs.count(), PAIRS_PER_FILE)

    def open_members(found: DataFrame) -> DataFrame:
        """Members of the keys whose members are not all connected, with component c
        and that of their hub."""
        labelled = members.join(found.withColumnRenamed("id", "node"), "node", "left").select("key", "node", "degree", "hub", F.coalesce("component", "node").alias("c"))
        apart = labelled.groupBy("key").agg(F.min("c").alias("least"), F.max("c").alias("most"), F.max(F.when(F.col("node") == F.col("hub"), F.col("c"))).alias("main"))
        return labelled.join(apart.where("least < most").select("key", "main"), "key")

    # Classes that hold rows of one id belong together, whatever their texts.
    links = None
    if repeated:
        shared_id = named.join(repeated_ids, "id").join(classes.select("node", *same_set), same_set).select("id", "node").distinct()
        links = scratch.write(shared_id.join(shared_id.groupBy("id").agg(F.min("node").alias("a")), "id").select("a", F.col("node").alias("b")).where("a < b"), "same-id", n)

    def linked(tried: DataFrame) -> DataFrame:
        found = tried.where("linked").select("a", "b")
        return found if links is None else found.unionByName(links)

    # For the passes between, components in parts will do: they only spare comparisons.
    with batches_of(spark, PAIRS_PER_BATCH):
        stars = confirmed(members.where("node != hub").select(F.col("hub").alias("a"), F.col("node").alias("b")).distinct(), 1)
        tried = stars
        found = scratch.write(components(linked(tried), scratch, "star-1", 1, n_met), "found-1", n)

        apart = scratch.write(open_members(found), "open-2", n_met)
        second = apart.where("c != main").groupBy("key").agg(F.max_by("node", most_shared).alias("a"), F.max_by("c", most_shared).alias("c_a"))
        pairs = apart.join(second, "key").where("c != c_a").select("a", F.col("node").alias("b")).distinct()
        known = tried.select("a", "b").unionByName(tried.select(F.col("b").alias("a"), F.col("a").alias("b")))
        more = confirmed(pairs.join(known, ["a", "b"], "left_anti"), 2)
        if not more.isEmpty():
            tried = tried.unionByName(more)
            found = scratch.write(components(linked(tried), scratch, "star-2", 1, 2 * n_met), "found-2", n)

        rest = open_members(found).where("node != hub").select(F.col("hub").alias("a"), F.col("node").alias("b"), "c").distinct()
        need = 100 * (F.col("size_a") - F.col("common")) + percent * (F.col("size_b") - F.col("common"))
        rest = scratch.write(rest.join(stars.withColumn("need", need), ["a", "b"]), "rest", n_met)
        least = rest.groupBy("a").agg(F.min("need").alias("least_asks"), F.min(F.when(~F.col("linked"), F.col("need") - (100 - percent) * F.col("size_a"))).alias("least_open"))
        wide = rest.join(least.where("least_open IS NOT NULL"), "a").select("a", "b", "c", "linked", "need", "least_asks", "least_open")
        sampled = with_texts(hashed_sample(wide, SAMPLED_PAIRS, "a", "b")).mapInArrow(_all_differences(shingle), "element long")
        counted = sampled.groupBy("element").count().where("count > 1").orderBy(F.desc("count"), "element").limit(FREQUENT)
        frequent = {r["element"]: r["count"] for r in counted.collect()}
        differences = with_texts(wide).mapInArrow(_differences(shingle, percent, frequent), "a long, element long, b long, c long, asks boolean, rest long, need long")
        differences = scratch.write(differences, "differences", rest.count(), PAIRS_PER_FILE)
        x, y = differences.where("asks").alias("x"), differences.where("NOT asks").alias("y")
        same = (F.col("x.a") == F.col("y.a")) & (F.col("x.element") == F.col("y.element")) & (F.col("x.c") != F.col("y.c"))
        same &= F.col("x.need") + F.col("y.need") <= (100 + percent) * F.least("x.rest", "y.rest")
        pairs = x.join(y, same).select(F.least("x.b", "y.b").alias("a"), F.greatest("x.b", "y.b").alias("b")).distinct()
        known = tried.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
        tried = tried.unionByName(confirmed(pairs.join(known, ["a", "b"], "left_anti"), 3))
    n_tried = tried.count()
    found = scratch.write(components(linked(tried), scratch, "star-3", most=n_tried + n), "found-3", n)

    joined = classes.select("node", *same_set, "id").join(found.withColumnRenamed("id", "node"), "node", "left").select(*same_set, "id", "component")
    first = joined.where("component IS NOT NULL").groupBy("component").agg(F.min("id").alias("first"))
    of_class = joined.join(first, "component", "left").select(*same_set, F.coalesce("first", "id").alias("component_id"))
    grouped = named.select("id", *same_set).join(of_class, same_set).select("id", "n_shingles", "component_id")
    alone = signed.where("n_shingles = 0 OR id IS NULL").select("id", "n_shingles", F.col("id").alias("component_id"))
    result = grouped.unionByName(alone).select(F.col("id").alias(id_col), "n_shingles", "component_id", F.coalesce(F.col("id") == F.col("component_id"), F.lit(True)).alias("kept"))
    result = scratch.write(result, "result", n)
    scratch.drop("signed", "classes", "met", "ranked", "members", "repeated-ids", "same-id", "texts", "rest", "differences", *(f"{x}-{i}" for x in ("pairs", "tried", "open", "found") for i in (1, 2, 3)))
    return result
