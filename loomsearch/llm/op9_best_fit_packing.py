"""Packing of tokenised documents into sequences of a fixed length.

Method: hierarchical residual packing. Texts are tokenised and what is longer than a
sequence is cut. The pieces are dealt to partitions of a fixed number of pieces, those
of each length evenly, so that each partition has the lengths of the whole table,
however that is sorted. Each partition packs its pieces best-fit in decreasing order.
Full and nearly full bins are emitted; the underfull bins of eight neighbouring
partitions then meet as items of a further best-fit round, and so on until one group
is left.

What a group hands on is bounded without closing a bin that could still be filled.
Best-fit leaves at most one bin of a group half full or less, as two would have been
one; so a round places at most eight items into other bins, and of the bins with equal
room, which are as good as each other, no more than eight for each round to come can be
used. Those beyond are emitted, as are bins with less room than the smallest bin of
all groups holds; all others are handed on.
"""

from __future__ import annotations

import zlib
from collections import defaultdict
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
import public_tokenizers
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from ..sources.partitions import spread
from .store import Scratch
from .words import Words, as_array, give_back, slices

#: Distinct words whose ids a worker remembers; beyond it starts afresh.
REMEMBERED = 1_000_000

#: ASCII letters and digits are of kind 1, other printable ASCII but the apostrophe of
#: kind 2: the pre-tokenizer cuts between the two wherever they meet.
_KINDS = np.array([1 if chr(b).isalnum() else 2 if 0x21 <= b <= 0x7E and b != 0x27 else 0 for b in range(128)] + [0] * 128, np.uint8)

_PIECE = pa.schema([(c, pa.int64()) for c in ("id", "piece", "start", "length", "ids_crc32", "grp", "nth")])
_PACKED = pa.schema([(c, pa.int64()) for c in ("id", "piece", "start", "length", "ids_crc32", "bin", "offset", "fill", "grp")] + [("open", pa.bool_())])
#: An underfull bin of the first round, the bin it is in now, its place and how full that is.
_MOVED = pa.schema([(c, pa.int64()) for c in ("bin", "host", "shift", "fill", "grp")] + [("open", pa.bool_())])
_PIECE_DDL, _PACKED_DDL, _MOVED_DDL = (", ".join(f"{f.name} {'boolean' if f.type == pa.bool_() else 'long'}" for f in x) for x in (_PIECE, _PACKED, _MOVED))
#: Pieces of a partition, and groups that meet in a round.
PIECES, FAN_IN = 8192, 8


class TokenIds:
    """Token ids of texts. The pre-tokenizer never joins across ASCII white space, nor
    an ASCII letter or digit with an ASCII mark, and ignores the case of A-Z; so each
    distinct run of bytes between such places is encoded once, in lower case, and its
    ids are gathered. Where the name of a special token stands in a text, runs are cut
    at white space only and keep their case."""

    def __init__(self, path: str):
        self.tokenizer = Tokenizer.from_file(path)
        self.special = [t.content.lower().encode() for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.forget()

    def _words(self, texts: pa.Array) -> Words:
        offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
        data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]]
        # A capital before a byte of another script stays, as the two may be composed.
        upper = (data >= 65) & (data <= 90)
        upper[:-1] &= data[1:] < 128
        low = data + (upper * np.uint8(32))
        plain = low.tobytes()
        if any(name in plain.lower() for name in self.special):
            return Words(texts)
        return Words(pa.Array.from_buffers(pa.large_string(), len(texts), [None, pa.py_buffer(offsets - offsets[0]), pa.py_buffer(plain)]), kinds=_KINDS)

    def forget(self) -> None:
        self.number: dict[bytes, int] = {}
        self.flat, self.first = np.empty(0, np.uint32), np.zeros(1, np.int64)

    def _learn(self, fresh: list[bytes]) -> None:
        flat, counts = [self.flat], [self.first]
        for a in range(0, len(fresh), 50_000):
            part = fresh[a : a + 50_000]
            coded = self.tokenizer.encode([w.decode() for w in part], is_pretokenized=True, add_special_tokens=False)
            flat.append(np.array(coded.ids, np.uint32))
            of_word = np.array([-1 if w is None else w for w in coded.word_ids], np.int64)
            counts.append(counts[-1][-1] + np.cumsum(np.bincount(of_word, minlength=len(part))))
        self.flat, self.first = np.concatenate(flat), np.concatenate(counts)

    def __call__(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts in a row, first id of each text and the end)."""
        words = self._words(texts)
        own = np.array(list(map(self.number.get, words.vocabulary, repeat(-1))), np.int64)
        new = np.flatnonzero(own < 0)
        if len(self.number) + len(new) > REMEMBERED:
            self.forget()
            new = np.arange(len(own))
        if len(new):
            fresh, at = [words.vocabulary[i] for i in new.tolist()], len(self.number)
            own[new] = np.arange(at, at + len(fresh))
            self.number.update(zip(fresh, range(at, at + len(fresh)), strict=True))
            self._learn(fresh)
        own = own[words.codes]
        begin = self.first[own]
        counts = self.first[own + 1] - begin
        ends = np.cumsum(counts)
        total = int(ends[-1]) if len(ends) else 0
        ids = self.flat[np.repeat(begin - (ends - counts), counts) + np.arange(total)]
        return ids, np.append(0, ends)[words.first]


def plan(counts: dict[int, int], capacity: int) -> np.ndarray:
    """Best-fit in decreasing order of counts[size] items of each size. Returns rows
    (size, first, bin, each, offset): from the `first` item of the size on, bins from
    `bin` on take `each` items one behind the other, from `offset` on.

    An item goes to the tightest bin, which is then the tightest for the next one of
    its size until that no longer fits; so bins with equal room take equally many."""
    by_room: dict[int, list[tuple[int, int]]] = defaultdict(list)  # (first bin, bins)
    rooms, bins, out = 0, 0, []

    def enter(room: int, first: int, n: int) -> None:
        nonlocal rooms
        if n and room:
            by_room[room].append((first, n))
            rooms |= 1 << room

    for size in sorted(counts, reverse=True):
        at, total = 0, counts[size]
        while at < total:
            if fit := rooms >> size:
                room = size + (fit & -fit).bit_length() - 1
                first, n = by_room[room].pop()
                if not by_room[room]:
                    rooms &= ~(1 << room)
            else:
                room, first, n = capacity, bins, -(-(total - at) // (capacity // size))
                bins += n
            each = room // size
            whole = min(n, (total - at) // each)
            rest = min(total - at - whole * each, each) if whole < n else 0
            out.append((size, at, first, each, capacity - room))
            enter(room - each * size, first, whole)
            if rest:
                enter(room - rest * size, first + whole, 1)
            enter(room, first + whole + bool(rest), n - whole - bool(rest))
            at += whole * each + rest
    return np.array(out, np.int64).reshape(-1, 5)


def _tokenise(path: str, capacity: int, end_id: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, encode = TaskContext.get().partitionId(), TokenIds(path)
        seen = [0] * (capacity + 1)
        for batch in batches:
            texts = as_array(batch["text"])
            for a, b in slices(texts, 4 << 20):
                ids, first = encode(texts.slice(a, b - a))
                out = []
                for name, at, end in zip(batch["id"].slice(a, b - a).to_pylist(), first[:-1].tolist(), first[1:].tolist(), strict=True):
                    whole = np.append(ids[at:end], np.uint32(end_id)).astype("<u4")
                    for piece, start in enumerate(range(0, len(whole), capacity)):
                        part = whole[start : start + capacity]
                        out.append((name, piece, start, len(part), zlib.crc32(part.tobytes()), group, seen[len(part)]))
                        seen[len(part)] += 1
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out, strict=True), _PIECE.types, strict=True)], schema=_PIECE)
        del encode
        give_back()

    return run


def place_all(sizes: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """(bin, offset) of every item by best-fit in decreasing order."""
    kinds, own, counts = np.unique(sizes, return_inverse=True, return_counts=True)
    rank = np.empty(len(sizes), np.int64)
    rank[np.argsort(own, kind="stable")] = np.arange(len(sizes)) - np.repeat(np.cumsum(counts) - counts, counts)
    rows = plan(dict(zip(kinds.tolist(), counts.tolist(), strict=True)), capacity)
    rows = rows[np.lexsort((rows[:, 1], rows[:, 0]))]
    span = len(sizes) + 1
    row = np.searchsorted(rows[:, 0] * span + rows[:, 1], sizes * span + rank, side="right") - 1
    _, first, host, each, offset = rows[row].T
    beyond = rank - first
    return host + beyond // each, offset + beyond % each * sizes


def handed_on(fills: np.ndarray, capacity: int, rounds: int) -> np.ndarray:
    """Which bins of a group go on, with so many rounds to come: those with room, of
    equal room no more than can be used."""
    order = np.argsort(fills, kind="stable")
    _, first, counts = np.unique(fills[order], return_index=True, return_counts=True)
    nth = np.empty(len(fills), np.int64)
    nth[order] = np.arange(len(fills)) - np.repeat(first, counts)
    return (fills < capacity) & (nth < FAN_IN * rounds)


def _pack_partition(capacity: int, rounds: int):
    """Best-fit of one partition's pieces."""

    def run(table: pa.Table) -> pa.Table:
        length, group = table["length"].to_numpy(), int(table["grp"][0].as_py())
        bins, offset = place_all(length, capacity)
        fills = np.bincount(bins, weights=length).astype(np.int64)
        new = {"bin": (group << 32) + bins, "offset": offset, "fill": fills[bins], "open": handed_on(fills, capacity, rounds)[bins]}
        return pa.table([pa.array(new[c]) if c in new else table[c] for c in _PACKED.names], schema=_PACKED)

    return run


def _merge(capacity: int, rounds: int):
    """Best-fit of the underfull bins that meet in one group, the fullest first."""

    def run(table: pa.Table) -> pa.Table:
        names, first, own = np.unique(table["host"].to_numpy(), return_index=True, return_inverse=True)
        fills = table["fill"].to_numpy()[first]
        bins, offset = place_all(fills, capacity)
        host = np.empty(bins.max() + 1, np.int64)
        host[bins[offset == 0]] = names[offset == 0]
        filled = np.bincount(bins, weights=fills).astype(np.int64)
        goes_on = handed_on(filled, capacity, rounds)
        new = {"host": host[bins][own], "shift": table["shift"].to_numpy() + offset[own], "fill": filled[bins][own], "open": goes_on[bins][own]}
        return pa.table([pa.array(new[c]) if c in new else table[c] for c in _MOVED.names], schema=_MOVED)

    return run


def pack_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", tokenizer: str | None = None, capacity: int = 2048, end_id: int = 0) -> DataFrame:
    """Packs the token ids of every text, each followed by end_id, into sequences of
    at most `capacity` ids. Only longer documents are cut, into pieces of `capacity`
    ids and one that may be shorter.

    tokenizer: a file for the tokenizers library, at the same place on every executor.
    Returns one row per piece: id_col, piece (int, from 0), start (ids of its document
    before it), length, ids_crc32 (of the ids as little-endian unsigned 32-bit
    numbers), sequence_id (any number) and offset (the piece's place there; gapless).
    A null or empty text is one piece that holds end_id. Null and repeated ids are
    carried as they are; an empty table gives an empty table; further columns of docs
    play no part and are not returned.
    """
    scratch = Scratch(docs.sparkSession, "packing")
    path = tokenizer or public_tokenizers.path("word_bpe_49k.json")
    source = spread(docs.select(docs[id_col].cast("long").alias("id"), docs[text_col].cast("string").alias("text")))
    pieces = scratch.write(source.mapInArrow(_tokenise(path, capacity, end_id), _PIECE_DDL), "pieces")
    groups = -(-max(pieces.count(), 1) // PIECES)
    rounds = 0
    while FAN_IN**rounds < groups:
        rounds += 1
    # A task's nth piece of a length goes to the nth partition from one given by the hash
    # of the two: of each length all partitions get equally many, but for one a task.
    dealt = pieces.withColumn("grp", F.pmod(F.xxhash64("grp", "length") + F.col("nth"), F.lit(groups)))
    packed = scratch.write(dealt.groupBy("grp").applyInArrow(_pack_partition(capacity, rounds), _PACKED_DDL), "packed")
    underfull = packed.where("open AND offset = 0").select("bin", F.col("bin").alias("host"), F.lit(0).cast("long").alias("shift"), "fill", "grp", "open")
    moved = None
    for turn in range(rounds):
        smallest = underfull.agg(F.min("fill")).first()[0] or 0
        met = underfull.where(F.col("fill") + smallest <= capacity).withColumn("grp", F.floor(F.col("grp") / FAN_IN).cast("long"))
        stays = underfull.where((F.col("fill") + smallest > capacity) & (F.col("bin") != F.col("host")))
        merged = scratch.write(met.groupBy("grp").applyInArrow(_merge(capacity, rounds - turn - 1), _MOVED_DDL), f"round-{turn}")
        done = stays.unionByName(merged.where("NOT open AND bin != host")).select("bin", "host", "shift")
        moved = done if moved is None else moved.unionByName(done)
        underfull = merged.where("open")
    if moved is not None:
        packed = packed.join(moved, "bin", "left")
    else:
        packed = packed.withColumns({"host": F.lit(None).cast("long"), "shift": F.lit(0).cast("long")})
    at = F.col("offset") + F.coalesce("shift", F.lit(0).cast("long"))
    return packed.select(F.col("id").alias(id_col), F.col("piece").cast("int").alias("piece"), "start", "length", "ids_crc32", F.coalesce("host", "bin").alias("sequence_id"), at.alias("offset"))
