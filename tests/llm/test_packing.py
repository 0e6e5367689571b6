import random
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from . import messy
from loomsearch.llm import op9_best_fit_packing as op9
from loomsearch.llm.op9_best_fit_packing import TokenIds, pack_documents, place_all
from loomsearch.llm.words import as_array

PATH = public_tokenizers.path("word_bpe_49k.json")


def expected(data, capacity):
    coder, out = Tokenizer.from_file(PATH), Counter()
    for i, t in data:
        ids = np.array([*coder.encode(t or "", add_special_tokens=False).ids, 0], "<u4")
        for piece, start in enumerate(range(0, len(ids), capacity)):
            part = ids[start : start + capacity]
            out[(i, piece, start, len(part), zlib.crc32(part.tobytes()))] += 1
    return out


@pytest.mark.parametrize("capacity", [2048, 64])
def test_pieces_and_layout(spark, capacity):
    got = pack_documents(messy.table(spark, parts=12), capacity=capacity).collect()
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got) == expected(messy.rows(), capacity)
    fills = layout(got)
    assert max(fills) <= capacity and len(fills) <= -(-sum(r.length for r in got) // capacity) + 2


def test_empty_table(spark):
    assert pack_documents(messy.empty(spark)).count() == 0


def test_ids_equal_those_of_whole_texts():
    rng = random.Random(4)
    marks = ["'s", "'", "’s", "...", "́", "̌", "̱", "J", "H", "İ", "K", "ß", "Σ", "ς", "é", "é", " ", " ", "\x1c", "\x00", "\x85", "<|", "|>", "<|endoftext|>", "a", "bc", "D", "1", "23", "_", "-", "“", "”", ".", ",", "=", "̸", "你好", "😀", "‍", "'ll", "'RE", " ", "\n", "\t"]
    texts = ["".join(rng.choice(marks) for _ in range(rng.randint(0, 30))) for _ in range(3000)]
    texts += [t for t in ("<|ENDOFTEXT|> x", "a<|startoftext|>b", "it's IT'S 'tis don''t", "≠ a≠") for _ in range(2)]
    coder, own = Tokenizer.from_file(PATH), TokenIds(PATH)
    for a in range(0, len(texts), 50):
        part = texts[a : a + 50]
        ids, first = own(as_array(pa.array(part)))
        for i, t in enumerate(part):
            assert ids[first[i] : first[i + 1]].tolist() == coder.encode(t, add_special_tokens=False).ids, t


def one_by_one(sizes, capacity):
    """Fills of best-fit in decreasing order, one item after the other."""
    fills = []
    for size in sorted(sizes, reverse=True):
        fit = [f for f in fills if f + size <= capacity]
        if fit:
            fills.remove(max(fit))
        fills.append((max(fit) if fit else 0) + size)
    return sorted(fills)


def test_items_are_placed_as_one_after_the_other_would_be():
    rng = random.Random(9)
    for capacity in (7, 64, 300):
        for _ in range(40):
            sizes = np.array([s for s in rng.sample(range(1, capacity + 1), rng.randint(1, min(capacity, 25))) for _ in range(rng.randint(1, 60))])
            rng.shuffle(sizes)
            bins, offsets = place_all(sizes, capacity)
            filled = {}
            for b, at, size in zip(bins.tolist(), offsets.tolist(), sizes.tolist()):
                filled.setdefault(b, []).append((at, at + size))
            for parts in filled.values():
                parts.sort()
                assert [0, *(end for _, end in parts[:-1])] == [at for at, _ in parts] and parts[-1][1] <= capacity
            assert sorted(x[-1][1] for x in filled.values()) == one_by_one(sizes.tolist(), capacity)


def layout(got):
    bins = {}
    for r in got:
        bins.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in bins.values():
        parts.sort()
        assert [at for at, _ in parts] == [0, *np.cumsum([n for _, n in parts])[:-1].tolist()]
    return [parts[-1][0] + parts[-1][1] for parts in bins.values()]


@pytest.mark.parametrize("words", [(39, 25), (25, 39)])
def test_lengths_in_the_order_of_the_table_pair_up(spark, words):
    # Thousands of bins stay open in one partition until their partners come.
    data = [(i, " ".join(["the"] * words[i // 6000])) for i in range(12000)]
    table = spark.createDataFrame(data, "doc_id long, text string")
    for parts in (1, 5):
        got = pack_documents(table.repartitionByRange(parts, "doc_id").sortWithinPartitions("doc_id"), capacity=66).collect()
        assert len(got) == 12000 and {r.length for r in got} == {40, 26}
        # Each task's pieces of a length may be one more in one partition than in another.
        assert 6000 <= len(layout(got)) <= 6000 + parts


def test_rounds_use_the_room_that_one_best_fit_would(spark, monkeypatch):
    """Partitions of 128 pieces, so that bins meet in several rounds: in the end at most
    one bin is half full or less, and hardly more are used than by one best-fit of all."""
    monkeypatch.setattr(op9, "PIECES", 128)
    rng = random.Random(2)
    for kind in range(3):
        sizes = [(rng.randint(1, 60), rng.choice((5, 21, 40, 44)), min(int(rng.paretovariate(1)) + 2, 64))[kind] for _ in range(3000)]
        data = [(i, " ".join(["the"] * (n - 1))) for i, n in enumerate(sizes)]
        got = pack_documents(spark.createDataFrame(data, "doc_id long, text string").repartition(4), capacity=64).collect()
        assert Counter((r.doc_id, r.length) for r in got) == Counter(enumerate(sizes))
        fills = layout(got)
        assert sum(f <= 32 for f in fills) <= 1
        assert max(fills) <= 64 and len(fills) <= 1.03 * len(one_by_one(sizes, 64)) + 1


def test_equal_bins_beyond_what_can_be_used_are_not_handed_on():
    fills = np.array([60] * 100 + [64] * 5 + [10])
    assert np.flatnonzero(op9.handed_on(fills, 64, 2)).tolist() == [*range(16), 105]
    assert not op9.handed_on(fills, 64, 0).any()
