import random
import re
from collections import Counter

from . import messy
from loomsearch.llm.op4_benchmark_decontamination import find_contamination, search_index, write_index
from loomsearch.llm.store import Scratch

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def expected(docs, items, n=10):
    grams = {}
    for item, text in items:
        w = words(text)
        for k in range(max(len(w) - n, 0) + 1 if w and item is not None else 0):
            grams.setdefault(tuple(w[k : k + n]), set()).add(str(item))
    out = Counter()
    for i, text in docs:
        w, hit, found = words(text), set(), set()
        for size in {len(g) for g in grams}:
            for k in range(len(w) - size + 1):
                if names := grams.get(tuple(w[k : k + size])):
                    hit.update(range(k, k + size))
                    found |= names
        out[(i, len(w), len(hit), len(found), tuple(sorted(found)), bool(hit))] += 1
    return out


def benchmark():
    rng = random.Random(1)
    messy.sentence(rng, 0)
    data = dict(messy.rows())
    base = data[1].split()
    return [(1, " ".join(base[20:45])), (2, " ".join(base[40:50]).upper()), (3, "two words"), (4, "one"), (5, None), (6, " ,. "), (None, "one"), (7, "same " * 12), (8, messy.sentence(rng, 12)), (10, " ".join(base[20:45])), (1, "a b c"), (9, "c d")]


def test_matches_brute_force_on_awkward_rows(spark):
    items = spark.createDataFrame([(i, t, "x", 1) for i, t in benchmark()], "item_id long, text string, item string, id int")
    got = find_contamination(messy.table(spark), items).collect()
    assert Counter((r.doc_id, r.n_words, r.n_hit, r.n_items, tuple(r["items"]), r.contaminated) for r in got) == expected(messy.rows(), benchmark())
    assert any(r.n_items > 2 for r in got)


def test_empty_tables(spark):
    items = spark.createDataFrame([], "item_id long, text string")
    assert find_contamination(messy.empty(spark), items).count() == 0
    got = find_contamination(messy.table(spark), items).collect()
    assert len(got) == len(messy.rows()) and not any(r.contaminated for r in got)


def test_proximity(spark):
    docs = spark.createDataFrame([(1, "x alpha y beta z gamma q"), (2, "gamma beta alpha"), (3, "alpha b c d e f g h beta gamma"), (4, "beta gamma"), (5, "alpha")], "doc_id long, text string").coalesce(1)
    items = spark.createDataFrame([("i", "alpha beta gamma")], "item_id string, text string")
    index = write_index(docs, Scratch(spark, "test"))
    got = search_index(index, items, "item_id", "text", 3, proximity=4).collect()
    assert {(r.id, r.kind) for r in got} == {(1, "proximity"), (2, "proximity")}
    got = search_index(index, spark.createDataFrame([("i", "gamma beta alpha")], "item_id string, text string"), "item_id", "text", 3, proximity=4).collect()
    assert {(r.id, r.kind) for r in got} == {(1, "proximity"), (2, "proximity"), (2, "phrase")}


def test_many_item_blocks_give_the_same(spark, monkeypatch):
    import loomsearch.llm.op4_benchmark_decontamination as op

    items = spark.createDataFrame(benchmark(), "item_id long, text string")
    whole = {tuple(map(str, r)) for r in find_contamination(messy.table(spark), items).collect()}
    monkeypatch.setattr(op, "ITEM_BYTES", 100)
    assert {tuple(map(str, r)) for r in find_contamination(messy.table(spark), items).collect()} == whole
