"""Benchmark passages in training texts, from a positional inverted index.

Method: each block of training texts is stored as an inverted index of its own: the
sorted terms, and for each term the sorted positions of its postings. Such an index is
written without a shuffle, and a term that every text holds is spread over all blocks.
A test window is looked up term by term: the postings of its rarest term in the block,
shifted by the term's place in the window, are the possible starts; they are
intersected with the shifted postings of the other terms from rare to frequent. All
windows of a block of test items are looked up together. A window with a term that the
block lacks ends there.

Test items are taken in blocks of a fixed number of bytes, each broadcast and run
against the whole index, so what is broadcast never grows with either table.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .store import Scratch, batches_of
from .words import ALNUM, Words, as_array, slices

BLOCK_BYTES = 8 << 20
#: Bytes of test items in one broadcast, about: items are dealt by their hash and whole.
ITEM_BYTES = 8 << 20

_ARRAYS = (("ids_null", np.uint8), ("ids", np.int64), ("first", np.int64), ("terms", np.uint64), ("ends", np.uint32), ("positions", np.uint32))
_INDEX = pa.schema([("block", pa.int64())] + [(name, pa.binary()) for name, _ in _ARRAYS])
_SPAN = pa.list_(pa.struct([("first", pa.int64()), ("last", pa.int64())]))
_MATCH = pa.schema([("block", pa.int64()), ("row", pa.int64()), ("id", pa.int64()), ("n_words", pa.int64()), ("item", pa.string()), ("kind", pa.string()), ("spans", _SPAN)])
_MATCH_DDL = "block long, row long, id long, n_words long, item string, kind string, spans array<struct<first: long, last: long>>"


def _build_index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    block = TaskContext.get().partitionId() << 32
    zip_ = zstandard.ZstdCompressor(level=1).compress
    for batch in batches:
        texts = as_array(batch["text"])
        for a, b in slices(texts, BLOCK_BYTES):
            words = Words(texts.slice(a, b - a), ALNUM, lower=True)
            hashed = np.array([xxhash.xxh3_64_intdigest(w) for w in words.vocabulary], np.uint64)
            order = np.argsort(hashed)
            rank = np.empty(len(order), np.uint32)
            rank[order] = np.arange(len(order), dtype=np.uint32)
            of_word = rank[words.codes] if len(rank) else np.empty(0, np.uint32)
            ends = np.cumsum(np.bincount(of_word, minlength=len(rank)))
            positions = np.argsort(of_word, kind="stable").astype(np.uint32)
            gaps = np.diff(positions, prepend=positions[:1])  # wraps where a term begins
            ids = batch["id"].slice(a, b - a)
            parts = (np.asarray(ids.is_null()).astype(np.uint8), ids.fill_null(0).to_numpy(), words.first.astype(np.int64), hashed[order], ends.astype(np.uint32), np.append(positions[:1], gaps[1:]).astype(np.uint32))
            yield pa.record_batch([pa.array([block]), *(pa.array([zip_(x.tobytes())], pa.binary()) for x in parts)], schema=_INDEX)
            block += 1


class _Index:
    """One block of the index."""

    def __init__(self, row: dict):
        unzip = zstandard.ZstdDecompressor().decompress
        for name, kind in _ARRAYS:
            setattr(self, name, np.frombuffer(unzip(row[name]), kind))
        self.positions = np.cumsum(self.positions, dtype=np.uint32)

    def postings(self, terms: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of the given sorted terms: how often each occurs, and all postings as sorted
        numbers term * width + position, where each term's begin."""
        counts, begins = np.zeros(len(terms), np.int64), np.zeros(len(terms), np.int64)
        if len(self.terms):
            at = np.searchsorted(self.terms, terms)
            at[at == len(self.terms)] = 0
            has = self.terms[at] == terms
            ends = self.ends.astype(np.int64)
            begins[has] = np.append(0, ends)[at[has]]
            counts[has] = ends[at[has]] - begins[has]
        first = np.cumsum(counts) - counts
        pick = np.repeat(begins - first, counts) + np.arange(counts.sum())
        keys = np.repeat(np.arange(len(terms)), counts) * self.width + self.positions[pick]
        return counts, keys, first

    @property
    def width(self) -> int:
        return int(self.first[-1]) + 1


class Phrases:
    """The windows of a block of test items, by number of words. terms: all their
    terms, sorted; for each length: an array of term numbers (windows x words), and
    the items that have each window."""

    def __init__(self, items: list[str], texts: list[str | None], n: int):
        words = Words(as_array(pa.array(texts, pa.string())), ALNUM, lower=True)
        hashed = np.array([xxhash.xxh3_64_intdigest(w) for w in words.vocabulary], np.uint64)
        order = np.argsort(hashed)
        self.terms, rank = hashed[order], np.empty(len(order), np.int64)
        rank[order] = np.arange(len(order))
        codes = rank[words.codes].tolist() if len(rank) else []
        owners: dict[tuple, set[str]] = {}
        for item, a, b in zip(items, words.first[:-1].tolist(), words.first[1:].tolist(), strict=True):
            for start in range(a, max(b - n, a) + 1) if b > a else ():
                owners.setdefault(tuple(codes[start : min(start + n, b)]), set()).add(item)
        self.by_length = []
        for length in sorted({len(w) for w in owners}):
            own = [w for w in owners if len(w) == length]
            self.by_length.append((np.array(own, np.int64).reshape(-1, length), [sorted(owners[w]) for w in own]))

    def found(self, index: _Index, slop: int | None) -> Iterator[tuple[str, str, int, int, int]]:
        """(kind, item, row of the text, first word, last word) of every match."""
        counts, keys, begin = index.postings(self.terms)
        for wanted, items in self.by_length:
            length = wanted.shape[1]
            present = np.flatnonzero((counts[wanted] > 0).all(axis=1))
            rarity = np.argsort(counts[wanted[present]], axis=1, kind="stable")
            times = counts[wanted[present, rarity[:, 0]]] if len(present) else np.empty(0, np.int64)
            window = np.repeat(np.arange(len(present)), times)
            rarest = wanted[present, rarity[:, 0]][window] if len(present) else np.empty(0, np.int64)
            nth = np.arange(len(window)) - np.repeat(np.cumsum(times) - times, times)
            at = keys[begin[rarest] + nth] - rarest * index.width
            starts, exact = at - rarity[window, 0], window
            for j in range(1, length):
                place = rarity[exact, j]
                key = wanted[present[exact], place] * index.width + starts + place
                near = np.searchsorted(keys, key)
                hit = (starts >= 0) & (starts + length < index.width) & (keys[np.minimum(near, len(keys) - 1)] == key) if len(keys) else np.zeros(len(key), bool)
                starts, exact = starts[hit], exact[hit]
            yield from self._rows(index, "phrase", items, present[exact], starts, starts + length - 1)
            if slop is not None:
                low, high = np.maximum(at - slop, 0), np.minimum(at + slop, index.width - 2)
                row = np.searchsorted(index.first, at, side="right") - 1
                low, high = np.maximum(low, index.first[row]), np.minimum(high, index.first[row + 1] - 1)
                close = np.ones(len(window), bool)
                for j in range(1, length):
                    term = wanted[present[window], rarity[window, j]] * index.width
                    close &= np.searchsorted(keys, term + low) < np.searchsorted(keys, term + high, side="right")
                yield from self._rows(index, "proximity", items, present[window[close]], low[close], high[close])

    @staticmethod
    def _rows(index: _Index, kind: str, items: list[list[str]], windows: np.ndarray, first: np.ndarray, last: np.ndarray) -> Iterator[tuple[str, str, int, int, int]]:
        row = np.searchsorted(index.first, first, side="right") - 1
        whole = last < index.first[row + 1]
        for w, r, a, b in zip(windows[whole].tolist(), row[whole].tolist(), first[whole].tolist(), last[whole].tolist(), strict=True):
            for item in items[w]:
                yield kind, item, r, a - int(index.first[r]), b - int(index.first[r])


def _joined(spans: list[tuple[int, int]]) -> list[dict]:
    out: list[dict] = []
    for a, b in sorted(spans):
        if out and a <= out[-1]["last"] + 1:
            out[-1]["last"] = max(out[-1]["last"], b)
        else:
            out.append({"first": a, "last": b})
    return out


def _search(phrases, slop: int | None, with_texts: bool):
    """Rows (block, row, id, n_words, item, kind, spans) for every text and item that
    match; with_texts: also a row without item for every text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                index = _Index(row)
                ids = [None if null else i for null, i in zip(index.ids_null.tolist(), index.ids.tolist(), strict=True)]
                n_words = np.diff(index.first).tolist()
                spans: dict[tuple, list] = {}
                for kind, item, text, a, b in phrases.value.found(index, slop):
                    spans.setdefault((text, item, kind), []).append((a, b))
                out = [(t, item, kind, _joined(s)) for (t, item, kind), s in spans.items()]
                if with_texts:
                    out += [(t, None, None, []) for t in range(len(ids))]
                text, item, kind, joined = zip(*out, strict=True) if out else ((), (), (), ())
                columns = [[row["block"]] * len(out), text, [ids[t] for t in text], [n_words[t] for t in text], item, kind, joined]
                yield pa.record_batch([pa.array(c, t) for c, t in zip(columns, _MATCH.types, strict=True)], schema=_MATCH)

    return run


def write_index(docs: DataFrame, scratch: Scratch, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The positional inverted index of docs, one row per block of texts, written."""
    source = docs.select(docs[id_col].cast("long").alias("id"), docs[text_col].cast("string").alias("text"))
    ddl = ", ".join(["block long", *(f"{name} binary" for name, _ in _ARRAYS)])
    return scratch.write(source.mapInArrow(_build_index, ddl), "index", compression="none")


def search_index(index: DataFrame, items: DataFrame, item_id_col: str, item_text_col: str, window: int, proximity: int | None = None, with_texts: bool = False, sent: list | None = None) -> DataFrame:
    """Matches of the items' windows: one row per text, item and kind, with the spans
    of words that match (phrase: a window word for word; proximity: all words of a
    window within so many words of its rarest one, in any order). sent: takes the broadcasts,
    which may be destroyed once the result is written."""
    spark = index.sparkSession
    own = items.select(items[item_id_col].cast("string").alias("item"), items[item_text_col].cast("string").alias("text")).where("item IS NOT NULL")
    size = own.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks, found = size // ITEM_BYTES + 1, None
    for i in range(blocks):
        part = own.where(F.pmod(F.xxhash64("item"), F.lit(blocks)) == i).collect()
        phrases = spark.sparkContext.broadcast(Phrases([r.item for r in part], [r.text for r in part], window))
        if sent is not None:
            sent.append(phrases)
        rows = index.mapInArrow(_search(phrases, proximity, with_texts and i == 0), _MATCH_DDL)
        found = rows if found is None else found.unionByName(rows)
    return found


def _covered(spans: Column) -> Column:
    """Number of words in the union of spans."""
    start = F.struct(F.lit(-1).cast("long").alias("last"), F.lit(0).cast("long").alias("n"))

    def add(acc: Column, x: Column) -> Column:
        return F.struct(
            F.greatest(acc["last"], x["last"]).alias("last"),
            (acc["n"] + F.greatest(x["last"] - F.greatest(x["first"] - 1, acc["last"]), F.lit(0).cast("long"))).alias("n"),
        )

    return F.aggregate(F.sort_array(spans), start, add)["n"]


def find_contamination(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_id_col: str = "item_id", item_text_col: str = "text", window: int = 10) -> DataFrame:
    """Test items whose windows of `window` consecutive words occur in each text.

    Words: A-Z lower-cased, runs of ASCII letters, digits and non-ASCII characters. An
    item of fewer words, but not none, is one window. Returns one row per row of docs:
    id_col, n_words, n_hit (words inside any occurrence), n_items (long), items (their
    ids as strings, sorted), spans (first and last word of each hit, in order) and
    contaminated (n_hit > 0). A null text or item has no words; an item without id takes no
    part; null and repeated ids of docs are carried as they are; an empty table of
    either kind gives no matches; further columns play no part and are not returned.
    """
    scratch = Scratch(docs.sparkSession, "contamination")
    index = write_index(docs, scratch, id_col, text_col)
    with batches_of(docs.sparkSession, 4):
        sent: list = []
        found = search_index(index, items, item_id_col, item_text_col, window, with_texts=True, sent=sent)
        by_text = found.groupBy("block", "row").agg(F.first("id").alias("id"), F.max("n_words").alias("n_words"), F.collect_set("item").alias("items"), F.flatten(F.collect_list("spans")).alias("spans"))
        written = scratch.write(by_text, "result")
    for phrases in sent:
        phrases.destroy()
    scratch.drop("index")
    n_hit = _covered(F.col("spans"))
    return written.select(F.col("id").alias(id_col), "n_words", n_hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"), F.sort_array("items").alias("items"), F.sort_array("spans").alias("spans"), (n_hit > 0).alias("contaminated"))
