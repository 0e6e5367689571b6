import math
import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from loomsearch.functions.filters import TypedFields, VariantFields, predicate
from loomsearch.functions.text import stem, tokens
from loomsearch.functions.vector import cosine, cosine_distance, normalised
from loomsearch.operators.bm25 import bm25_search
from loomsearch.operators.chunking import chunk_documents, chunks
from loomsearch.operators.evaluation import floor_percentiles, latency_sweep, recall_at_k
from loomsearch.operators.fusion import fuse
from loomsearch.operators.postings import build_index

STEMS = dict(
    running="run", runners="runner", runs="runs", parties="parti", agreed="agree", hopefulness="hope", nationalization="nation", relational="relate", rolling="roll",
    created="create", hopping="hop", classes="class", caresses="caress", organizer="organize", goodness="good", radical="rad", sing="sing", bleed="blee", need="need",
    string="str", used="used", ing="ing", cat="cat",
)


def test_golden_stems(spark):
    got = spark.createDataFrame([(w,) for w in STEMS], "w string").select("w", stem(F.col("w")).alias("s")).collect()
    assert {r.w: r.s for r in got} == STEMS


def test_tokens(spark):
    row = spark.createDataFrame([("The  Été-fox_1 RUNNING, a b! 漢字かな",), (None,), ("",)], "t string").select(tokens(F.col("t")).alias("a"), tokens(F.col("t"), False).alias("b")).collect()
    assert row[0].a == ["été", "fox_1", "run", "漢字かな"] and row[0].b == ["été", "fox_1", "running", "漢字かな"]
    assert row[1].a == row[2].a == []


def index(spark, *texts):
    return build_index(spark.createDataFrame(list(enumerate(texts)), "id long, text string"))


def test_bm25_golden(spark):
    ix = index(spark, "wireless headphones noise cancelling", "kitchen blender food processor")
    rows = bm25_search(spark.createDataFrame([(0, "wireless headphones wireless"), (1, "the of"), (2, "absent")], "qid long, text string"), ix).collect()
    assert [(r.qid, r.id, r.rank) for r in rows] == [(0, 0, 1)] and rows[0].score == pytest.approx(2 * math.log(2), abs=1e-6)


def test_index_statistics_and_changes(spark):
    ix = index(spark, "alpha beta beta", "alpha gamma", None)
    assert ix.statistics().first().asDict() == {"n": 3, "total_dl": 5, "avgdl": 5 / 3}
    assert ix.doc_count() == 3 and ix.vocab_size().first()[0] == 3 and ix.contains(2) and not ix.contains(9)
    assert ix.term_freq(0, "beta") == 2 and ix.term_freq(1, "beta") == 0 and ix.term_freq(0, "the") == 0
    less = ix.remove(spark.createDataFrame([(0,)], "id long"))
    assert less.vocab_size().first()[0] == 2 and {r.id for r in less.ids().collect()} == {1, 2}
    more = ix.add(spark.createDataFrame([(0, "delta"), (7, "beta")], "id long, text string"))
    assert more.doc_count() == 4 and more.term_freq(0, "beta") == 0 and more.term_freq(7, "beta") == 1
    nothing = index(spark)
    assert nothing.statistics().first().avgdl == 0.0 and bm25_search(spark.createDataFrame([(0, "x1")], "qid long, text string"), nothing).count() == 0


def test_rarer_terms_and_shorter_documents_score_higher(spark):
    ix = index(spark, "common rare", "common other", "common thing", "common " + "filler " * 30)
    score = lambda q: {r.id: r.score for r in bm25_search(spark.createDataFrame([(0, q)], "qid long, text string"), ix).collect()}
    assert score("rare")[0] > score("common")[0] > score("common")[3]


def ranked(spark, *ids):
    return spark.createDataFrame([(0, i, n + 1) for n, i in enumerate(ids)], "qid long, id string, rank int")


def test_fusion_golden(spark):
    rows = {r.id: r for r in fuse(ranked(spark, "d1", "d2"), ranked(spark, "d1", "d3")).collect()}
    assert rows["d1"].score == pytest.approx(1 / 61, abs=1e-9) and rows["d2"].score == rows["d3"].score == pytest.approx(0.5 / 62, abs=1e-9)
    assert (rows["d2"].bm25_rank, rows["d2"].vector_rank, rows["d2"].rank, rows["d3"].rank) == (2, None, 2, 3)
    assert {r.id for r in fuse(ranked(spark, "d1"), ranked(spark, "d3"), alpha=0.0).collect()} == {"d1"}
    assert {r.id for r in fuse(ranked(spark, "d1"), ranked(spark, "d3"), alpha=1.0).collect()} == {"d3"}
    with pytest.raises(ValueError):
        fuse(ranked(spark, "d1"), ranked(spark, "d3"), alpha=1.5)


def test_typed_filters(spark):
    df = spark.createDataFrame([(1, 5.0, ["sale", "new"], "wholesale", None), (2, None, None, None, 1), (3, 9.0, [], "x", 2)], "id int, price double, tags array<string>, text string, x int")

    def ids(filters, **options):
        passing = predicate(filters, TypedFields(df), **options)
        return [r.id for r in (df if passing is None else df.where(passing)).orderBy("id").collect()]

    assert ids({"price": 5.0}) == [1] and ids({"price": None}) == [2] and ids({"absent": None}) == [1, 2, 3] and ids({"absent": 1}) == []
    assert ids({"price": {"$gte": 5}}) == [1, 3] and ids({"price": {"$gt": 5, "$lt": 10}}) == [3] and ids({"price": {"$lte": 5}}) == [1]
    assert ids({"tags": {"$contains": "sale"}}) == [1] and ids({"text": {"$contains": "sale"}}) == [1] and ids({"price": {"$contains": 5}}) == []
    assert ids({"x": {"$ne": 1}}) == [1, 3] and ids({"x": {"$ne": None}}) == [2, 3] and ids({"x": {"$in": [1]}}) == [1, 2, 3] and ids({"x": {}}) == [1, 2, 3]
    assert ids({}) == ids(None) == [1, 2, 3] and ids({"price": {"$gte": 1}, "x": 2}) == [3]
    with pytest.raises(ValueError):
        ids({"x": {"$in": [1]}}, strict=True)


def test_variant_filters(spark):
    rows = [(1, '{"p": 5, "tags": ["sale"], "s": "wholesale", "b": true}'), (2, '{"p": "5"}'), (3, '{"p": null, "s": "7"}'), (4, "no json")]
    df = spark.createDataFrame(rows, "id int, j string").select("id", F.try_parse_json("j").alias("doc"))
    ids = lambda f: [r.id for r in df.where(predicate(f, VariantFields("doc"))).orderBy("id").collect()]
    assert ids({"p": "5"}) == [2] and ids({"p": None}) == [3, 4] and ids({"b": True}) == [1]
    assert ids({"p": {"$gte": 5}})[0] == 1 and 3 not in ids({"p": {"$gte": 1}}) and ids({"s": {"$contains": "sale"}}) == [1]
    assert ids({"tags": {"$contains": "sale"}}) == [1] and ids({"s": {"$ne": "7"}}) == [1, 2, 4]


@pytest.mark.parametrize(("text", "size", "overlap", "n"), [("word " * 100, 50, 10, 12), ("A" * 100, 20, 5, 6), ("A" * 60, 50, 0, 1), ("word " * 10, 30, 0, 1), ("", 512, 64, 1), ("   ", 512, 64, 1), (None, 512, 64, 1)])
def test_golden_chunks(spark, text, size, overlap, n):
    rows = chunk_documents(spark.createDataFrame([("d1", text, 1)], "id string, text string, n int"), size, overlap).orderBy("chunk_index").collect()
    assert [r.id for r in rows] == (["d1"] if n == 1 else [f"d1__chunk_{i}" for i in range(n)])
    assert all(r.parent_id == "d1" and r.n == 1 and len(r.text) <= size for r in rows)
    if text == "A" * 60:
        assert len(rows[0].text) == 50
    with pytest.raises(ValueError):
        chunks(F.lit("x"), 10, 10)


def python_chunks(text, size, overlap, least):
    if len(text) <= size:
        return [text] if text.strip() else []
    parts = [text[i : i + size] for i in range(0, len(text), size - overlap)]
    return [p for p in parts if len(p.strip()) >= least] or [text]


def test_chunks_match_slices(spark):
    rng = random.Random(0)
    texts = ["".join(rng.choice("ab é \n\U0001f600") for _ in range(rng.randint(0, 90))) for _ in range(300)]
    for size, overlap, least in ((10, 3, 4), (7, 6, 2), (20, 0, 20)):
        got = spark.createDataFrame(list(enumerate(texts)), "i int, t string").select("i", chunks(F.col("t"), size, overlap, least).alias("c")).collect()
        assert {r.i: r.c for r in got} == {i: python_chunks(t, size, overlap, least) for i, t in enumerate(texts)}
    tail = spark.createDataFrame([("A" * 100,)], "t string").select(chunks(F.col("t"), 30, 2, 20, keep_tail=True).alias("c")).first().c
    assert tail[-1] == "A" * 16


@settings(max_examples=10, deadline=None)
@given(st.lists(st.integers(-40, 40), min_size=1, max_size=60))
def test_floor_percentiles(spark, values):
    rows = spark.createDataFrame([("a", float(v)) for v in values] + [("a", None), ("b", 7.0), ("c", None)], "name string, v double")
    got = {r.name: r for r in floor_percentiles(rows, "name", "v", 0, 50, 95, 99, 100).collect()}
    place = lambda p: sorted(values)[min(len(values) * p // 100, len(values) - 1)]
    assert [got["a"][f"p{p}"] for p in (0, 50, 95, 99, 100)] == [place(p) for p in (0, 50, 95, 99, 100)]
    assert got["b"].p50 == got["b"].p99 == 7 and set(got) == {"a", "b"}


def test_latency_sweep():
    asked = []
    found = latency_sweep(lambda mode, query: asked.append((mode, query)), ["a", "b", "c"], ("x", "y"))
    assert asked == [(m, q) for m in "xy" for q in "abc"] and set(found["x"]) == {"p50", "p95", "p99", "mean"} and found["y"]["p99"] >= found["y"]["p50"] >= 0


def test_recall(spark):
    truth = ranked(spark, *"abcd")
    assert recall_at_k(ranked(spark, "b", "x", "a"), truth, 3).first().recall == pytest.approx(2 / 3)
    assert recall_at_k(ranked(spark, "x"), truth, 3).first().recall == 0 and recall_at_k(truth, truth, 10).first().recall == 1


def test_vector_functions(spark):
    row = spark.createDataFrame([([3.0, 4.0], [0.0, 0.0])], "a array<float>, z array<float>").select(
        normalised(F.col("a")).alias("n"), normalised(F.col("z")).alias("nz"), cosine(F.col("a"), F.col("z")).alias("c"), cosine(F.col("a"), F.col("a")).alias("s"), cosine_distance(F.col("a"), F.col("a")).alias("d")
    ).first()
    assert row.n == [0.6, 0.8] and row.nz == [0.0, 0.0] and row.c == 0 and row.s == pytest.approx(1) and row.d == pytest.approx(0)


def test_small_tables(spark, tmp_path):
    from loomsearch.sources.partitions import local_table, spread

    ddl = "qid long, text string, embedding array<float>"
    rows = local_table(spark, [(1, "a", [1.0, 2.0]), (2, None, None)], ddl)
    assert [tuple(r) for r in rows.orderBy("qid").collect()] == [(1, "a", [1.0, 2.0]), (2, None, None)]
    assert local_table(spark, [], ddl).collect() == [] and local_table(spark, [], ddl).schema == rows.schema
    # One file of four megabytes: read by one task, dealt to several.
    spark.range(500_000).selectExpr("id", "uuid() AS x").coalesce(1).write.parquet(f"{tmp_path}/one")
    one = spark.read.parquet(f"{tmp_path}/one")
    parts = lambda df: df.select(F.spark_partition_id().alias("p")).distinct().count()
    assert parts(spread(one)) == 8 and spread(one).count() == 500_000
    many = one.repartition(9)
    assert spread(many) is many and spread(one.limit(3)).count() == 3 and spread(one.limit(0)).count() == 0
