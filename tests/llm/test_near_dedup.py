import random
from collections import Counter

import pytest

from . import messy
from loomsearch.llm.components import components
from loomsearch.llm.op10_minhash_near_dedup import chunks_for, largest_distance, near_duplicates
from loomsearch.llm.store import Scratch


def check(spark, data, percent):
    docs = spark.createDataFrame(data, "doc_id long, text string").repartition(4)
    truth = messy.classes(data, percent)
    got = Counter((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in near_duplicates(docs, percent=percent).collect())
    assert got == Counter((i, len(messy.shingles(t)), truth.get(i), i is None or truth[i] == i) for i, t in data)


@pytest.mark.parametrize("percent", [80, 85])
def test_awkward_rows(spark, percent):
    check(spark, messy.rows(), percent)


def test_columns_of_the_same_names(spark):
    assert near_duplicates(messy.table(spark)).count() == len(messy.rows())


def test_large_group_of_near_copies_with_hidden_links(spark):
    """Many copies of one text with so many edits that most are not linked with it, and
    some copies of copies, whose only links are with each other."""
    rng = random.Random(5)
    base = messy.sentence(rng, 120).split()

    def edited(text, n):
        text = list(text)
        for at in rng.sample(range(len(text)), n):
            text[at] = messy.sentence(rng, 1)
        return text

    copies = [edited(base, rng.choice((0, 1, 2, 3, 4, 5, 6))) for _ in range(150)]
    copies += [edited(rng.choice(copies), rng.choice((0, 1, 2))) for _ in range(60)]
    copies += [base[: rng.randint(95, 118)] for _ in range(20)]
    check(spark, [(i, " ".join(t)) for i, t in enumerate(copies)], 85)


def test_rows_that_share_an_id_link_what_each_is_near_to(spark):
    rng = random.Random(8)
    one, two = messy.sentence(rng, 60), messy.sentence(rng, 60)
    data = [(1, one), (1, two), (2, f"{one} tail"), (3, f"{two} tail"), (4, messy.sentence(rng, 60)), (4, None), (5, "")]
    assert messy.classes(data, 85)[3] == 1
    check(spark, data, 85)
    # The least id of a class also stands for the other rows of that id.
    check(spark, [(9, one), (2, one), (2, two), (7, f"{two} tail")], 85)


def test_many_copies_that_are_linked_with_few(spark):
    """Hundreds of copies of one text, each with so many edits of its own that it is
    not linked with the others, and a copy of every tenth of them."""
    rng = random.Random(6)
    base = messy.sentence(rng, 150).split()
    copies = []
    for _ in range(400):
        text = list(base)
        for at in rng.sample(range(len(text)), 8):
            text[at] = messy.sentence(rng, 1)
        copies.append(text)
    copies += [[*x, "tail"] for x in copies[::10]]
    check(spark, [(i, " ".join(t)) for i, t in enumerate(copies)], 85)


def test_chain(spark):
    words = messy.sentence(random.Random(3), 400).split()
    data = [(i, " ".join(words[i * 8 : i * 8 + 150])) for i in range(25)]
    assert len(set(messy.classes(data, 80).values())) == 1
    check(spark, data, 80)


def test_empty_table_and_blank_texts(spark):
    assert near_duplicates(messy.empty(spark)).count() == 0
    got = near_duplicates(spark.createDataFrame([(1, None), (2, ""), (3, " \n")], "doc_id long, text string")).collect()
    assert all(r.component_id == r.doc_id and r.kept and r.n_shingles == 0 for r in got)


def test_pigeonhole_covers_the_distance():
    for percent in (80, 85, 90):
        d = largest_distance(percent / 100)
        chunks = chunks_for(d)
        assert sorted(sum(chunks, [])) == list(range(32)) and 2 * len(chunks) > d


def test_components(spark):
    rng = random.Random(0)
    links = [(rng.randint(0, 300), rng.randint(0, 300)) for _ in range(200)] + [(5, 5)] + [(400 + i, 401 + i) for i in range(60)] + [(1000, 1001 + i) for i in range(200)]
    up = {}

    def top(i):
        while up.setdefault(i, i) != i:
            i = up[i]
        return i

    for a, b in links:
        p, q = top(a), top(b)
        up[max(p, q)] = min(p, q)
    got = components(spark.createDataFrame(links, "a long, b long"), Scratch(spark, "test"), "t").collect()
    assert len(got) == len({r.id for r in got})
    assert {r.id: r.component for r in got} == {i: top(i) for a, b in links if a != b for i in (a, b)}
    assert components(spark.createDataFrame([], "a long, b long"), Scratch(spark, "test"), "e").count() == 0
