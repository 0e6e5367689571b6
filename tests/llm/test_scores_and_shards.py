import random
import zlib

import numpy as np
from pyspark.sql import functions as F

from . import messy
from loomsearch.llm import op7_sharding
from loomsearch.llm.op1_toxicity import ngrams, present, score_toxicity
from loomsearch.llm.op5_language_id import ROWS_PER_LANGUAGE, TRAINING_ROWS, declared_language, identify_languages, rows_per_language, visible_text
from loomsearch.llm.op7_sharding import assign_shards, even_out, place


def test_toxicity_on_rows_never_learned_from(spark):
    rng = random.Random(2)
    rude = ["nitwit", "blockhead", "vermin"]
    data, labels = [], []
    for i in range(1500):
        w, toxic = messy.sentence(rng, rng.choice((20, 60, 300))).split(), int(rng.random() < 0.3)
        if toxic:
            for _ in range(3):
                w.insert(rng.randrange(len(w)), rng.choice(rude))
        data.append((i, " ".join(w), "0", 0.5))
        labels.append((i, toxic, "y"))
    docs = spark.createDataFrame(data, "doc_id long, text string, label string, score double").repartition(4)
    known = spark.createDataFrame([*labels, (None, 1, "y"), (3, None, "y"), (99_999, 1, "y")], "doc_id long, toxic int, text string")
    got = score_toxicity(docs, known).collect()
    assert len(got) == 1500 and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in got)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in got)
    held = [(r.predicted, labels[r.doc_id][1]) for r in got if r.held_out]
    assert sum(a == b for a, b in held) / len(held) > 0.97
    # Labels of held-out rows change nothing.
    turned = spark.createDataFrame([(i, 1 - t if zlib.crc32(str(i).encode()) % 5 == 0 else t) for i, t, _ in labels], "doc_id long, toxic int")
    again = {r.doc_id: r.score for r in score_toxicity(docs, turned).collect()}
    assert max(abs(again[r.doc_id] - r.score) for r in got) < 1e-9


def test_toxicity_of_awkward_rows_and_without_labels(spark):
    none = spark.createDataFrame([], "doc_id long, toxic int")
    got = score_toxicity(messy.table(spark), none).collect()
    assert len(got) == len(messy.rows()) and {r.score for r in got} == {0.5}
    one_class = spark.createDataFrame([(i, 0) for i in range(50)], "doc_id long, toxic int")
    assert all(r.predicted == 0 for r in score_toxicity(messy.table(spark), one_class).collect())
    assert score_toxicity(messy.empty(spark), none).count() == 0


def test_ngrams_stay_in_their_text():
    texts = ["Ab  c", "", "a\0b", "x" * 10]
    for places, owners in ngrams(texts):
        assert len(places) == len(owners)
    alone = [set(present([t])[1].tolist()) for t in texts]
    owner, place_ = present(texts)
    assert [set(place_[owner == i].tolist()) for i in range(4)] == alone
    assert set(present(["AB  C"])[1].tolist()) == alone[0]


def page(text, lang=None):
    return f"<!DOCTYPE html><html{f' lang={chr(34)}{lang}{chr(34)}' if lang else ''}><head><script>var le='la';</script></head><body><p>{text}</p></body></html>"


def test_language_evidence(spark):
    rng = random.Random(1)
    vocabulary = {"aa": ["bado", "kema", "lopi"], "bb": ["ströx", "zvek", "hrtan"]}
    text = lambda lang, n: " ".join(rng.choice(vocabulary[lang]) for _ in range(n))
    labelled = spark.createDataFrame([(text(x, 40), x) for x in ("aa", "bb") for _ in range(30)] + [(None, "aa"), ("x", None)], "text string, lang string")
    pages = [(i, f"http://h{i % 3}.one.example.aa/p", page(text("aa", 30), "aa")) for i in range(40)]
    pages += [(100 + i, f"http://k{i % 3}.two.example.bb/p", page(text("bb", 30), "BB-x")) for i in range(40)]
    pages += [(200, "http://k1.two.example.bb/", page("")), (201, None, None), (202, "http://h1.one.example.aa/", page(text("bb", 40), "aa")), (None, "not a url", "<p>"), (200, "http://k1.two.example.bb/", page(""))]
    table = spark.createDataFrame([(*p, "x", 1) for p in pages], "page_id long, url string, html string, host string, declared int").repartition(3)
    got = identify_languages(table, labelled).collect()
    assert len(got) == len(pages)
    by = {r.page_id: r for r in got}
    assert all(by[i].lang == "aa" for i in range(40)) and all(by[100 + i].lang == "bb" for i in range(40))
    assert by[200].lang == "bb" and by[202].lang == "bb" and by[201].lang in ("aa", "bb") and by[110].declared == "bb"
    assert all(0 <= r.probability <= 1 for r in got)
    assert identify_languages(table.limit(0), labelled).count() == 0
    assert {r.lang for r in identify_languages(table, labelled.limit(0)).collect()} == {None}


def test_visible_text():
    assert visible_text("a<!-- b -->c<script>d</script><style>e</style><p class='x>'>f &amp; g").split() == ["a", "c", "'>f", "&", "g"]


def sound(rows, n_shards):
    slots = {}
    for r in rows:
        slots.setdefault(r.shard, []).append(r.slot)
    assert all(sorted(v) == list(range(len(v))) for v in slots.values()) and set(slots) <= set(range(n_shards))


def test_shards_of_awkward_rows(spark):
    data = messy.rows()
    got = assign_shards(messy.table(spark), 4).collect()
    sound(got, 4)
    assert sorted((str(r.doc_id), r.size, r.text_crc32) for r in got) == sorted((str(i), len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t in data)
    assert assign_shards(messy.empty(spark)).count() == 0


def test_shards_are_even_and_keep_copies_together(spark):
    rng = random.Random(0)
    data = [(i, messy.sentence(rng, rng.randint(1, 60))) for i in range(3000)]
    data += [(5000 + i, "a copy of some words " * 3) for i in range(100)] + [(6000 + i, "everywhere") for i in range(1500)]
    got = assign_shards(spark.createDataFrame(data, "doc_id long, text string").repartition(5), 8).collect()
    sound(got, 8)
    for field in ("size", "tokens"):
        sums = np.bincount([r.shard for r in got], weights=[r[field] for r in got], minlength=8)
        assert sums.max() / sums.mean() < 1.1
    sizes = np.bincount([r.shard for r in got], weights=[r["size"] for r in got], minlength=8)
    assert sizes.max() / sizes.min() < 1.02
    assert len({r.shard for r in got if 5000 <= r.doc_id < 6000}) == 1
    # A third of all rows: more than a shard's share of rows, so it is split.
    assert 1 < len({r.shard for r in got if r.doc_id >= 6000}) <= 8


def test_more_cells_than_one_level_takes(spark, monkeypatch):
    for name, value in (("GROUPS_PER_CELL", 20), ("CELLS_PER_CELL", 3), ("MOST_CELLS", 4), ("BINS", 8)):
        monkeypatch.setattr(op7_sharding, name, value)
    rng = random.Random(4)
    data = [(i, messy.sentence(rng, rng.randint(1, 60))) for i in range(900)] + [(5000 + i, "copies of one text") for i in range(60)]
    got = assign_shards(spark.createDataFrame(data, "doc_id long, text string").repartition(3), 4).collect()
    sound(got, 4)
    assert sorted(r.doc_id for r in got) == sorted(i for i, _ in data)
    assert len({r.shard for r in got if r.doc_id >= 5000}) == 1
    sizes = np.bincount([r.shard for r in got], weights=[r["size"] for r in got], minlength=4)
    assert sizes.max() / sizes.min() < 1.1


def test_place_balances_all_sizes():
    items = np.array([[8, 1, 1]] * 8 + [[1, 8, 1]] * 8 + [[1, 1, 8]] * 8, float)
    bins = place(items, 4)
    loads = np.stack([items[bins == b].sum(axis=0) for b in range(4)])
    assert loads.max() <= 20 + 8 and (np.bincount(bins) == 6).all()
    assert (even_out(items, np.zeros(24, int), 4) >= 0).all()


def test_rare_languages_are_fitted_whatever_the_number_of_rows(spark):
    rare = {"fi": "metsä järven rannalla ja talven lumi", "hu": "az erdő mellett egy kis ház állt"}
    labelled = [(i, f"the house by the river and the hill {i}", "en") for i in range(20000)]
    labelled += [(50000 + i, f"{text} {i}", lang) for lang, text in rare.items() for i in range(2)]
    labels = spark.createDataFrame(labelled, "doc_id long, text string, lang string")
    pages = spark.createDataFrame([(i, f"http://h{i}.net/", f"<html><body>{t}</body></html>") for i, t in enumerate([*rare.values(), "the house by the river"])], "page_id long, url string, html string")
    got = {r.page_id: r.text_lang for r in identify_languages(pages, labels).collect()}
    assert got == {0: "fi", 1: "hu", 2: "en"}
    assert rows_per_language([20000, 2, 2]) == 3996 and rows_per_language([3, 5]) == TRAINING_ROWS and rows_per_language([9000] * 100) == ROWS_PER_LANGUAGE


def test_language_declared_late_in_the_markup(spark):
    late = "<!-- " + "licence " * 1000 + "-->"
    tags = [late + "<html class='a' lang='de-AT'>", late + "<HTML LANG=fr>", "<html class=x>" + late + "<html lang=es>", late + "<html>", "<html " * 3000]
    rows = spark.createDataFrame(list(enumerate(tags)), "i long, html string")
    got = rows.select("i", declared_language(F.col("html")).alias("d")).collect()
    assert [r.d for r in sorted(got)] == ["de", "fr", "es", "", ""]


def test_toxicity_of_documents_held_out(spark):
    base = "/root/testdata/sf0.01"
    labels = spark.read.parquet(f"{base}/labels.parquet")
    scored = score_toxicity(spark.read.parquet(f"{base}/documents.parquet"), labels).join(labels, "doc_id").where("held_out").collect()
    assert len(scored) > 50 and {r.toxic for r in scored} == {0, 1}
    assert sum(r.predicted == r.toxic for r in scored) / len(scored) >= 0.95
    toxic, clean = ([r.score for r in scored if r.toxic == x] for x in (1, 0))
    # Six toxic ones, of which one in fourteen of the whole table holds no toxic word.
    assert np.mean([[t > c for c in clean] for t in toxic]) >= 0.9


def test_language_of_documents_held_out(spark):
    """Texts as bare pages without any other evidence, none of them learned from."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").where("length(text) >= 100")
    held = F.crc32(F.col("doc_id").cast("string")) % 5 == 0
    pages = docs.where(held).select(F.col("doc_id").alias("page_id"), F.lit(None).cast("string").alias("url"), "text", "lang")
    got = identify_languages(pages.withColumn("html", F.concat(F.lit("<p>"), F.regexp_replace("text", "[<>&]", " "), F.lit("</p>"))), docs.where(~held)).select("page_id", F.col("lang").alias("found"), "text_lang")
    rows = pages.join(got, "page_id").collect()
    assert len(rows) > 100 and len({r.lang for r in rows}) == 4
    assert sum(r.found == r.lang for r in rows) / len(rows) >= 0.97 and sum(r.text_lang == r.lang for r in rows) / len(rows) >= 0.97
