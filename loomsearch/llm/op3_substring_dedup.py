"""Removal of word passages that an earlier document holds already.

Method: a count-min prefilter, then exact grouping. Texts are written once as
blocks of a few megabytes. Every block sends, to each shard of the hash range, the
sketch cells its windows touch; a shard merges the partial sketches of all blocks
and answers each block with one bit per cell it sent (two or more, or not). The
count is never too low, so no repeated window is lost. Only windows whose estimate
is two or more in every row of the sketch enter the second pass, where shards group
them by a 128-bit fingerprint and answer with the smallest document that has each.
Blocks then cut the covered words.

Nothing is broadcast or collected: a sketch is cut into shards of a fixed number of
windows, whose number grows with the corpus, and a window of which a third of all
rows are made reaches a shard once per block, not once per row.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator
from itertools import compress

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.partitions import spread
from .store import Scratch, batches_of
from .words import Words, as_array, mix, slices, windows

_LAST = np.iinfo(np.int64).max
#: Cells of one row of a shard's sketch, and windows of a shard: load 0.18, so two
#: rows let about 3 % of the windows that occur once through to the exact pass.
CELLS = 1 << 23
WINDOWS_PER_SHARD = 1_500_000
#: Text of a block at least and at most. Between the two, blocks grow with the corpus,
#: so that a message from a block to a shard holds some hundred windows or more.
BLOCK_BYTES, MOST_BLOCK_BYTES = 2 << 20, 16 << 20
#: Bytes of blocks in a bucket of their table.
BUCKET_BYTES = 64 << 20

_BLOCK = pa.schema([("block", pa.int64()), ("n_windows", pa.int64()), ("body", pa.binary())])
_MAIL = pa.schema([("shard", pa.int64()), ("block", pa.int64()), ("body", pa.binary())])


def _pack(*arrays: np.ndarray) -> bytes:
    raw = b"".join(a.tobytes() for a in arrays)
    head = struct.pack(f"<I{len(arrays)}Q", len(arrays), *(a.nbytes for a in arrays))
    return zstandard.ZstdCompressor(level=1).compress(head + raw)


def _unpack(body: bytes, *kinds: type) -> list[np.ndarray]:
    raw = zstandard.ZstdDecompressor().decompress(body)
    (n,) = struct.unpack_from("<I", raw)
    sizes = struct.unpack_from(f"<{n}Q", raw, 4)
    out, at = [], 4 + 8 * n
    for size, kind in zip(sizes, kinds, strict=True):
        out.append(np.frombuffer(raw, kind, size // np.dtype(kind).itemsize, at))
        at += size
    return out


def _gaps(cells: np.ndarray) -> np.ndarray:
    """Sorted cells as the differences between neighbours; 16 bits where they fit."""
    gaps = np.diff(cells, prepend=cells[:1] * 0).astype(np.uint32)
    return gaps.astype(np.uint16) if not len(gaps) or gaps.max() < 65536 else gaps


def _cells_of(gaps: np.ndarray) -> np.ndarray:
    return np.cumsum(gaps, dtype=np.int64)


class _Block:
    """The distinct windows of a block in the order of their hash, with the smallest
    and largest document that has each; row: of each occurrence, in text order."""

    def __init__(self, ids: np.ndarray, texts: pa.Array, n: int, streams: int):
        words = Words(texts)
        self.first, hashes = words.first, words.hashes(streams)
        high, self.starts = windows(hashes[0], words.first, n)
        self.doc = np.repeat(np.arange(len(ids)), np.diff(words.first))[self.starts]
        order = np.argsort(high, kind="stable")
        ordered = high[order]
        new = np.ones(len(ordered), bool)
        new[1:] = ordered[1:] != ordered[:-1]
        at = np.flatnonzero(new)
        self.high = ordered[at]
        self.row = np.empty(len(order), np.int64)
        self.row[order] = np.cumsum(new) - 1
        docs = ids[self.doc][order]
        self.least = np.minimum.reduceat(docs, at) if len(at) else docs
        self.most = np.maximum.reduceat(docs, at) if len(at) else docs
        if streams > 1:
            low, _ = windows(hashes[1], words.first, n, stream=1)
            self.low = low[order][at]

    def shards(self, n: int) -> Iterator[tuple[int, int, int]]:
        """(shard, first, last) of the windows in each shard of the hash range."""
        shard = ((self.high >> np.uint64(32)) * np.uint64(n)) >> np.uint64(32)
        edge = np.flatnonzero(np.diff(shard)) + 1
        for a, b in zip([0, *edge], [*edge, len(shard)], strict=True):
            if b > a:
                yield int(shard[a]), int(a), int(b)

    def cells(self, a: int, b: int) -> list[tuple[np.ndarray, np.ndarray]]:
        """For both rows of the sketch: the cell of each window, and the sorted cells
        to send, twice where two documents of the block have the window."""
        out = []
        twice = self.least[a:b] < self.most[a:b]
        for hashed in (self.high[a:b], mix(self.high[a:b])):
            own = (hashed & np.uint64(CELLS - 1)).astype(np.int64)
            out.append((own, np.sort(np.concatenate([own, own[twice]]))))
        return out


def _body(table: pa.Table | pa.RecordBatch) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, table.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
        out.write_table(pa.table(table) if not isinstance(table, pa.Table) else table)
    return sink.getvalue().to_pybytes()


def _read(body: bytes) -> tuple[pa.Array, np.ndarray, pa.Array]:
    """The block's ids as given, as numbers with null as the largest, and its texts."""
    table = pa.ipc.open_stream(body).read_all().combine_chunks()
    given = table["id"].combine_chunks() if table.num_rows else pa.array([], pa.int64())
    return given, given.fill_null(_LAST).to_numpy(), as_array(table["text"])


def block_bytes(total: int) -> int:
    """Bytes of a block for so many bytes of text. A block of b bytes sends a message
    to each of total / s shards of s bytes, each of b * s / total bytes of windows."""
    shard = 6 * WINDOWS_PER_SHARD
    return int(min(max(BLOCK_BYTES, total / shard * 2048), MOST_BLOCK_BYTES))


def _write_blocks(n: int, most: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = TaskContext.get().partitionId() << 32
        for batch in batches:
            texts = as_array(batch["text"])
            for a, b in slices(texts, most):
                part = texts.slice(a, b - a)
                counts = Words(part).counts()
                body = _body(pa.table({"id": batch["id"].slice(a, b - a), "text": part}))
                yield pa.record_batch([pa.array([block]), pa.array([int(np.maximum(counts - n + 1, 0).sum())]), pa.array([body], pa.binary())], schema=_BLOCK)
                block += 1

    return run


def _mails(rows: list[tuple[int, int, bytes]]) -> pa.RecordBatch:
    shard, block, body = zip(*rows, strict=True) if rows else ((), (), ())
    return pa.record_batch([pa.array(shard, pa.int64()), pa.array(block, pa.int64()), pa.array(body, pa.binary())], schema=_MAIL)


def _send_cells(n: int, n_shards: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for number, body in zip(batch["block"].to_pylist(), batch["body"], strict=True):
                _, ids, texts = _read(body.as_py())
                block = _Block(ids, texts, n, 1)
                mails = []
                for s, a, b in block.shards(n_shards):
                    rows = [_gaps(sent) for _, sent in block.cells(a, b)]
                    mails.append((s, number, _pack(*rows, np.uint8([x.itemsize for x in rows]))))
                yield _mails(mails)

    return run


def _two_rows(body: bytes) -> list[np.ndarray]:
    """The sorted cells of both rows of the sketch in one message."""
    raw = _unpack(body, np.uint8, np.uint8, np.uint8)
    return [_cells_of(g.view(np.uint16 if size == 2 else np.uint32)) for g, size in zip(raw[:2], raw[2], strict=True)]


def _merge_sketch(table: pa.Table) -> pa.Table:
    """One shard: the sum of all blocks' partial sketches, held at two, and for every
    block one bit per cell that it sent."""
    counts = np.zeros((2, CELLS), np.uint8)
    bodies = table["body"]
    for body in bodies:
        for row, cells in zip(counts, _two_rows(body.as_py()), strict=True):
            own, times = np.unique(cells, return_counts=True)
            row[own] = np.minimum(row[own] + times, 2)
    answers = [_pack(*(np.packbits(row[cells] > 1) for row, cells in zip(counts, _two_rows(body.as_py()), strict=True))) for body in bodies]
    return pa.table({"shard": table["shard"], "block": table["block"], "body": pa.array(answers, pa.binary())}, schema=_MAIL)


def _send_repeated(n: int, n_shards: int):
    """Of each block the windows estimated at two or more, with both halves of the
    fingerprint, their place among the block's windows, and the documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for number, body, answers in zip(batch["block"].to_pylist(), batch["body"], batch["answers"].to_pylist(), strict=True):
                by_shard = {x["shard"]: x["body"] for x in answers or ()}
                _, ids, texts = _read(body.as_py())
                block, mails = _Block(ids, texts, n, 2), []
                for s, a, b in block.shards(n_shards):
                    twice = np.ones(b - a, bool)
                    for (own, sent), bits in zip(block.cells(a, b), _unpack(by_shard[s], np.uint8, np.uint8), strict=True):
                        twice &= np.unpackbits(bits, count=len(sent)).view(bool)[np.searchsorted(sent, own)]
                    at = np.flatnonzero(twice)
                    if len(at):
                        pick = at + a
                        mails.append((s, number, _pack(block.high[pick], block.low[pick], block.least[pick], block.most[pick], at.astype(np.uint32))))
                yield _mails(mails)

    return run


def _group_exactly(table: pa.Table) -> pa.Table:
    """One shard: the smallest document of each fingerprint, sent to the blocks in
    which a larger document has it."""
    parts = [_unpack(body.as_py(), np.uint64, np.uint64, np.int64, np.int64, np.uint32) for body in table["body"]]
    high, low, least, most, at = (np.concatenate(x) for x in zip(*parts, strict=True))
    order = np.lexsort((low, high))
    new = np.ones(len(order), bool)
    new[1:] = (high[order][1:] != high[order][:-1]) | (low[order][1:] != low[order][:-1])
    smallest = np.empty_like(least)
    smallest[order] = np.repeat(np.minimum.reduceat(least[order], np.flatnonzero(new)), np.diff(np.append(np.flatnonzero(new), len(order))))
    del high, low, order
    rows, first = [], 0
    for shard, block, part in zip(table["shard"].to_pylist(), table["block"].to_pylist(), parts, strict=True):
        own = slice(first, first + len(part[0]))
        cut = smallest[own] < most[own]
        if cut.any():
            rows.append((shard, block, _pack(at[own][cut], smallest[own][cut])))
        first = own.stop
    return pa.Table.from_batches([_mails(rows)])


def _cut(n: int, n_shards: int, schema: pa.Schema):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for body, answers in zip(batch["body"], batch["answers"].to_pylist(), strict=True):
                by_shard = {x["shard"]: x["body"] for x in answers or ()}
                given, ids, texts = _read(body.as_py())
                block = _Block(ids, texts, n, 1)
                earliest = np.full(len(block.high), _LAST)
                for s, a, _ in block.shards(n_shards):
                    if s in by_shard:
                        at, smallest = _unpack(by_shard[s], np.uint32, np.int64)
                        earliest[at + a] = smallest
                cut = block.starts[earliest[block.row] < ids[block.doc]]
                size = int(block.first[-1]) + 1
                depth = np.cumsum(np.bincount(cut, minlength=size) - np.bincount(cut + n, minlength=size))
                keep = depth[:-1] == 0
                kept = []
                for text, a, b in zip(texts, block.first[:-1], block.first[1:], strict=True):
                    kept.append(b" ".join(compress(text.as_py().encode().split(), keep[a:b].tolist())))
                n_words = np.diff(block.first)
                left = np.add.reduceat(np.append(keep, False).astype(np.int64), block.first[:-1]) if len(keep) else np.zeros(len(n_words), np.int64)
                left[n_words == 0] = 0
                yield pa.record_batch([given, pa.array(n_words), pa.array(n_words - left), pa.array(kept, pa.binary()).cast(pa.string())], schema=schema)

    return run


def remove_repeated_passages(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = 13) -> DataFrame:
    """Cuts each word covered by a window of `window` consecutive words whose word
    sequence also starts in a document with a smaller id.

    Words are runs of bytes other than ASCII white space, unchanged. Returns one row
    per input row: id_col, n_words, n_removed (long) and kept_text, the words left,
    joined by one space. A null text is empty; a text shorter than the window loses
    nothing; a null id counts as larger than every id and is returned as null; rows
    that share an id do not cut one another; an empty table gives an empty table;
    further columns of docs play no part and are not returned.
    """
    spark, scratch = docs.sparkSession, Scratch(docs.sparkSession, "substring")
    source = docs.select(docs[id_col].cast("long").alias("id"), docs[text_col].cast("string").alias("text"))
    size = source.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets = max(12, int(spark.conf.get("spark.sql.shuffle.partitions")), size // BUCKET_BYTES)
    blocks = scratch.write_bucketed(spread(source).mapInArrow(_write_blocks(window, block_bytes(size)), "block long, n_windows long, body binary"), "blocks", "block", buckets)
    total = blocks.agg(F.sum("n_windows")).first()[0] or 0
    n_shards = max(buckets, total // WINDOWS_PER_SHARD + 1)
    mail = "shard long, block long, body binary"

    def answered(mails: DataFrame) -> DataFrame:
        grouped = mails.groupBy("block").agg(F.collect_list(F.struct("shard", "body")).alias("answers"))
        return blocks.join(grouped.hint("merge"), "block", "left")

    with batches_of(spark, 8):
        sent = blocks.mapInArrow(_send_cells(window, n_shards), mail)
        counted = scratch.write(sent.groupBy("shard").applyInArrow(_merge_sketch, mail), "counted")
        repeated = answered(counted).mapInArrow(_send_repeated(window, n_shards), mail)
        grouped = scratch.write(repeated.groupBy("shard").applyInArrow(_group_exactly, mail), "grouped")
        scratch.drop("counted")
        schema = pa.schema([(id_col, pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept_text", pa.string())])
        result = scratch.write(answered(grouped).mapInArrow(_cut(window, n_shards, schema), f"{id_col} long, n_words long, n_removed long, kept_text string"), "result")
    scratch.drop("grouped", "blocks")
    return result
