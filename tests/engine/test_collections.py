import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from loomsearch.engine import Engine
from loomsearch.operators.ann import GraphIndex, IvfIndex, diverse
from loomsearch.operators.embedding import HashingProvider, Retrying, embed, get_provider, register_provider
from loomsearch.operators.evaluation import mean_recall
from loomsearch.operators.vector_search import exact_search
from loomsearch.plans.search import hybrid_search
from loomsearch.sources.catalog import Collection, CollectionConfig, CollectionStore
from loomsearch.sources.files import read_json_documents, write_metrics
from loomsearch.sources.synthetic import product_queries, products
from loomsearch.streaming.jobs import DONE, DONE_WITH_ERRORS, ERROR, JobTracker


def vectors(spark, n=400, dim=16, seed=0):
    rng = np.random.default_rng(seed)
    return spark.createDataFrame([(i, [float(x) for x in rng.normal(size=dim)]) for i in range(n)], "id long, embedding array<float>")


def test_exact_search(spark):
    v = vectors(spark)
    q = v.where("id < 5").withColumnRenamed("id", "qid")
    rows = exact_search(q, v, 16, 3).collect()
    assert {(r.qid, r.id) for r in rows if r.rank == 1} == {(i, i) for i in range(5)} and len(rows) == 15
    assert exact_search(q.limit(1), v, 16, 1000).count() == 400
    zero = spark.createDataFrame([(0, [0.0] * 16)], "qid long, embedding array<float>")
    assert [(r.score, r.id) for r in exact_search(zero, v, 16, 2).orderBy("rank").collect()] == [(0, 0), (0, 1)]
    with pytest.raises(ValueError):
        exact_search(zero, v, 8, 2)
    with pytest.raises(ValueError):
        exact_search(zero, v, 0, 2)
    assert exact_search(q.limit(0), v, 16, 3).count() == 0


def test_approximate_indexes_reach_their_recall(spark):
    v = vectors(spark, 3000)
    q = vectors(spark, 60, seed=1).withColumnRenamed("id", "qid")
    exact = exact_search(q, v, 16, 10).persist()
    assert mean_recall(GraphIndex.build(v, 16).search(q, 10, ef=100), exact, 10).first()[0] >= 0.984
    assert mean_recall(IvfIndex.build(v, 16, n_lists=20).search(q, 10, probes=14), exact, 10).first()[0] >= 0.95
    assert GraphIndex.build(v.limit(0), 16).search(q, 10).count() == 0


def test_diverse_neighbours():
    similarity = np.array([[1, 0.95, 0.1], [0.95, 1, 0.1], [0.1, 0.1, 1]])
    assert diverse(np.array([7, 8, 9]), similarity, np.array([0.9, 0.8, 0.5]), 2) == [7, 9]


def test_providers(spark):
    p = HashingProvider(32)
    assert np.allclose(np.linalg.norm(p.embed_batch(["a b c", "d"]), axis=1), 1, atol=1e-6) and p.embed_batch([]).shape == (0, 32)
    assert (p.embed_one("same text") == p.embed_one("Same  TEXT")).all() and not p.embed_one("").any()
    with pytest.raises(ValueError):
        get_provider("absent")
    register_provider("small", lambda: HashingProvider(4))
    assert get_provider("small").dim == 4
    failures, waits = [1, 1], []

    class Shaky:
        dim = 32

        def embed_batch(self, texts):
            if failures:
                failures.pop()
                raise OSError("down")
            return p.embed_batch(texts)

    assert Retrying(Shaky(), sleep=waits.append).embed_batch(["a", "b"]).shape == (2, 32) and waits == [1.0, 2.0]
    failures += [1] * 5
    with pytest.raises(OSError):
        Retrying(Shaky(), sleep=waits.append).embed_batch(["a"])


def test_a_model_fitted_on_the_corpus(spark):
    from loomsearch.operators.embedding import fit_latent

    about = {"sea": "harbour ship sailor wave anchor tide", "wood": "oak saw timber plank carpenter forest"}
    rng = np.random.default_rng(0)
    texts = [(kind, " ".join(rng.choice(words.split(), 4))) for kind, words in about.items() for _ in range(80)]
    model = fit_latent(spark.createDataFrame(texts, "kind string, text string"), dim=4)
    rows = model.embed_batch([t for _, t in texts])
    assert rows.shape == (160, 4) and np.allclose(np.linalg.norm(rows, axis=1), 1, atol=1e-5)
    same, other = (rows[:80] @ rows[:80].T).mean(), (rows[:80] @ rows[80:].T).mean()
    # Texts of one subject are near to each other even where they share no word.
    assert same > 0.7 and abs(other) < 0.3 and model.embed_one("sailor anchor") @ model.embed_one("ship tide") > 0.7
    assert model.embed_batch([]).shape == (0, 4) and not model.embed_one("").any()
    assert embed(spark.createDataFrame(texts[:3], "kind string, text string"), model).where("size(embedding) = 4").count() == 3
    assert fit_latent(spark.createDataFrame([], "text string"), dim=4).embed_one("x").shape == (4,)


def test_a_service_for_embeddings():
    from http.server import BaseHTTPRequestHandler, HTTPServer
    from threading import Thread

    from loomsearch.operators.embedding import HttpProvider

    seen = []

    class Service(BaseHTTPRequestHandler):
        def do_POST(self):
            asked = json.loads(self.rfile.read(int(self.headers["Content-Length"])))
            seen.append((asked["model"], self.headers["Authorization"], len(asked["input"])))
            if len(seen) == 1:
                self.send_response(503)
                self.end_headers()
                return
            data = [{"index": i, "embedding": [float(len(t)), 1.0]} for i, t in enumerate(asked["input"])]
            self.send_response(200)
            self.end_headers()
            self.wfile.write(json.dumps({"data": data[::-1]}).encode())

        def log_message(self, *_):
            pass

    server = HTTPServer(("127.0.0.1", 0), Service)
    Thread(target=server.serve_forever, daemon=True).start()
    try:
        provider = HttpProvider(f"http://127.0.0.1:{server.server_port}/embeddings", "some-model", 2, key="k")
        waits = []
        rows = Retrying(provider, batch=2, sleep=waits.append).embed_batch(["a", "bbb", "cc"])
        assert np.allclose(rows[1], np.array([3, 1]) / np.sqrt(10), atol=1e-6) and waits == [1.0]
        assert seen == [("some-model", "Bearer k", 2)] * 2 + [("some-model", "Bearer k", 1)] and provider.embed_batch([]).shape == (0, 2)
        with pytest.raises(ValueError):
            HttpProvider(provider.url, "some-model", 3).embed_one("x")
    finally:
        server.shutdown()


def test_command_line(spark, tmp_path, capsys):
    from loomsearch.__main__ import run

    engine = Engine(spark, str(tmp_path))
    engine.create_collection("docs", "text", index_type="brute_force")
    engine.bulk_ingest("docs", [{"id": "a", "text": "harbour master"}, {"id": "b", "text": "garden chair"}])
    assert run(spark, [str(tmp_path), "worker", "--once"]) is None
    assert run(spark, [str(tmp_path), "search", "docs", "harbour", "--alpha", "0"])["results"][0]["id"] == "a"
    assert run(spark, [str(tmp_path), "stats"])[0]["doc_count"] == 2
    assert set(run(spark, [str(tmp_path), "latency", "docs", "harbour"])) == {"keyword", "vector", "hybrid"}
    assert json.loads(capsys.readouterr().out.splitlines()[0])["total"] == 1
    with pytest.raises(SystemExit):
        run(spark, [str(tmp_path), "unknown"])


def test_embedding_errors_stay_with_their_batch(spark):
    class Fussy:
        dim = 8

        def embed_batch(self, texts):
            if "bad" in texts:
                raise ValueError("no bad texts")
            return HashingProvider(8).embed_batch(texts)

    df = spark.createDataFrame([(i, t) for i, t in enumerate(["a", "b", "bad", "c", None])], "id long, text string").coalesce(1)
    rows = {r.id: r for r in embed(df, Fussy(), batch=2).collect()}
    assert [i for i, r in rows.items() if r.embedding is None] == [2, 3] and "no bad" in rows[2].embed_error and rows[4].embed_error is None


DIM = 16


@pytest.fixture
def shop(spark, tmp_path):
    store = CollectionStore(spark, str(tmp_path))
    c = store.create(CollectionConfig("shop", "description", DIM, "brute_force"))
    p = HashingProvider(DIM)
    texts = ["wireless headphones with noise reduction", "kitchen blender", "wireless speaker", "garden chair of wood"]
    docs = [{"id": f"d{i}", "description": t, "price": 10.0 * i, "tags": ["sale"] if i % 2 else []} for i, t in enumerate(texts)]
    c.add_batch(docs, p.embed_batch(texts))
    return store, c, p


def test_upsert_keeps_the_place_and_delete_removes_all(shop):
    _, c, p = shop
    assert [d["id"] for d in c.list_docs()[0]] == ["d0", "d1", "d2", "d3"] and c.list_docs(2, 1)[0][0]["id"] == "d1"
    c.add({"id": "d1", "description": "wireless kettle"})
    assert [d["id"] for d in c.list_docs()[0]] == ["d0", "d1", "d2", "d3"] and c.get("d1")["description"] == "wireless kettle"
    assert c.vectors().where("id = 'd1'").isEmpty() and {r["id"] for r in c.search("wireless", alpha=0.0)} == {"d0", "d1", "d2"}
    assert not c.search("blender", alpha=0.0)
    assert c.delete("d0") and not c.delete("d0") and c.get("d0") is None
    c.add({"id": "d0", "description": "again"})
    page, total = c.list_docs()
    assert [d["id"] for d in page] == ["d1", "d2", "d3", "d0"] and total == 4
    c.add_batch([{"id": "t", "description": "first"}, {"id": "t", "description": "second"}])
    assert c.get("t")["description"] == "second" and c.list_docs()[1] == 5
    with pytest.raises(ValueError):
        c.add({"description": "no id"})
    with pytest.raises(ValueError):
        c.add({"id": "x"}, [1.0, 2.0])
    with pytest.raises(ValueError):
        c.add_batch([{"id": "x"}], [])
    with pytest.raises(ValueError):
        c.list_docs(0)
    assert c.list_docs()[1] == 5


def test_search_modes_and_filters(shop):
    _, c, p = shop
    q = "wireless headphones"
    v = p.embed_one(q)
    both = c.search(q, v, k=4)
    assert both[0]["id"] == "d0" and both[0]["bm25_rank"] == 1 and both[0]["vector_rank"] and both[0]["document"]["price"] == 0
    assert {r["id"] for r in c.search(q, v, alpha=0.0)} == {"d0", "d2"} and len(c.search(q, v, alpha=1.0)) == 4
    assert c.search(q, alpha=1.0) == [] and c.search(q)[0]["vector_rank"] is None
    assert {r["id"] for r in c.search(q, v, filters={"price": {"$gte": 10}, "tags": {"$contains": "sale"}})} == {"d1", "d3"}
    # The filter applies to the candidates only, unless it comes first.
    assert c.search(q, v, k=1, filters={"price": 30.0}) == [] and [r["id"] for r in c.search(q, v, k=1, filters={"price": 30.0}, filter_mode="pre")] == ["d3"]
    with pytest.raises(ValueError):
        c.search(q, v, alpha=2.0)
    with pytest.raises(ValueError):
        c.search(q, [1.0])
    assert c.search("the of", alpha=0.0) == []


def test_fallback_to_keywords(spark, shop):
    _, c, _ = shop
    queries = spark.createDataFrame([(0, "blender")], "qid long, text string")
    assert hybrid_search(queries, c.docs(), c.keyword_index(), None, alpha=1.0).count() == 0
    assert [r.id for r in hybrid_search(queries, c.docs(), c.keyword_index(), None, alpha=1.0, fallback=True).collect()] == ["d1"]


def test_snapshots_and_catalog(spark, shop, tmp_path):
    store, c, _ = shop
    again = Collection.load(spark, c.folder)
    assert again.get("d2") == c.get("d2") and again.config == c.config and again.version == c.version
    before = again.docs()
    c.delete("d3")
    assert before.count() == 4 and Collection.load(spark, c.folder).docs().count() == 3
    c.compact()
    assert c.docs().count() == 3 and len(c.state.segments) == 1 and not c.state.gone
    stats = c.stats()
    assert (stats["doc_count"], stats["vector_count"], stats["embedding_dim"], stats["index_type"]) == (3, 3, DIM, "brute_force") and len(stats) == 10
    with pytest.raises(ValueError):
        store.create(c.config)
    with pytest.raises(ValueError):
        CollectionConfig("no spaces", "text")
    with pytest.raises(ValueError):
        CollectionConfig("x", "text", index_type="other")
    with pytest.raises(FileNotFoundError):
        Collection.load(spark, f"{tmp_path}/absent")
    (tmp_path / "broken").mkdir()
    (tmp_path / "broken" / "manifest.json").write_text("{")
    with pytest.warns(UserWarning):
        assert store.list() == ["shop"]
    assert store.get("absent") is None and "shop" in store
    store.files.delete(f"{tmp_path}/broken")
    assert store.totals()["doc_count"] == 3
    assert store.delete("shop") and not store.delete("shop") and store.list() == []


def test_graph_and_list_indexes_in_collections(spark, tmp_path):
    store = CollectionStore(spark, str(tmp_path))
    p = HashingProvider(DIM)
    texts = [f"item number {i} of {i % 7}" for i in range(60)]
    for kind in ("hnsw", "ivf"):
        c = store.create(CollectionConfig(kind, "text", DIM, kind))
        c.add_batch([{"id": str(i), "text": t} for i, t in enumerate(texts)], p.embed_batch(texts))
        assert c.search(texts[7], p.embed_one(texts[7]), alpha=1.0, k=3)[0]["id"] == "7"


def test_engine_from_messages_to_search(spark, tmp_path):
    engine = Engine(spark, str(tmp_path))
    engine.create_collection("docs", "text", index_type="brute_force")
    assert engine.ingest("docs", {"id": "one", "text": "a lone lighthouse keeper"}) == {"indexed": 1, "errors": 0, "chunks": 1, "embed_errors": 0}
    assert engine.ingest("docs", {"text": "no id"})["errors"] == 1
    job = engine.bulk_ingest("docs", [{"id": "long", "text": "seagull harbour " * 20}, {"id": "short", "text": "harbour master"}, {"text": "nameless"}])
    lost = engine.jobs.create(1)
    from loomsearch.streaming.ingest import enqueue

    enqueue(spark, f"{tmp_path}/inbox", "absent", [{"id": "x"}], lost.job_id)
    engine.work(once=True, chunk_size=100, chunk_overlap=20).awaitTermination()
    done = engine.job(job.job_id)
    assert (done.status, done.done, done.errors, done.total) == (DONE_WITH_ERRORS, 2, 1, 3) and engine.job(lost.job_id).status == ERROR
    c = engine.collection("docs")
    parts = {r.id for r in c.docs().where("parent_id = 'long'").collect()}
    assert parts == {f"long__chunk_{i}" for i in range(4)}
    found = engine.search("docs", "harbour master", alpha=0.5, top_k=3)
    assert found[0]["id"] == "short" and engine.collections()[0]["query_count"] == 1
    # A shorter text leaves none of the old chunks behind.
    engine.bulk_ingest("docs", [{"id": "long", "text": "seagull"}])
    engine.work(once=True, chunk_size=100, chunk_overlap=20).awaitTermination()
    assert {r.id for r in engine.collection("docs").docs().where("parent_id = 'long'").collect()} == {"long"}
    assert engine.health()["status"] == "ok" and engine.delete_collection("docs")
    with pytest.raises(KeyError):
        engine.search("docs", "x")
    with pytest.raises(ValueError):
        engine.search("docs", "")


def test_jobs(spark, tmp_path):
    jobs = JobTracker(spark, str(tmp_path))
    job = jobs.create(3)
    jobs.set_running(job.job_id)
    jobs.increment_done(job.job_id)
    assert jobs.get(job.job_id).progress == pytest.approx(1 / 3) and jobs.get(job.job_id).status == "running"
    jobs.increment_done(job.job_id, 2)
    assert jobs.get(job.job_id).status == DONE and jobs.get("absent") is None and jobs.create(0).progress == 0


def test_json_sources_and_sinks(spark, tmp_path):
    (tmp_path / "many.json").write_text(json.dumps([{"id": 1, "a": "x"}, {"id": 2}]))
    (tmp_path / "one.json").write_text(json.dumps({"id": 3, "a": "y"}))
    assert read_json_documents(spark, f"{tmp_path}/many.json").count() == 2 and read_json_documents(spark, f"{tmp_path}/one.json").first().id == 3
    write_metrics(spark, f"{tmp_path}/m.json", {"b": 1, "a": [2]})
    assert json.loads((tmp_path / "m.json").read_text()) == {"a": [2], "b": 1}


def test_synthetic_products(spark):
    assert products(spark, 50).select(F.countDistinct("description")).first()[0] == 50 and product_queries(spark, 30).where("text LIKE 'best %'").count() == 10


def test_stream_ingests_every_document(spark, tmp_path):
    from loomsearch.plans.queries import stream_ingest

    data = [(i, f"document number {i}") for i in [*range(150), *range(190, 650), 10**12]]
    spark.createDataFrame(data, "doc_id long, text string").repartition(4).write.parquet(f"{tmp_path}/documents.parquet")
    assert sorted(map(tuple, stream_ingest(spark, str(tmp_path)).select("id", "text").collect())) == data


def plain(c):
    return sorted((r.id, r.seq, r.text) for r in c.docs().collect())


def test_a_search_leaves_a_commit_in_place_and_writers_see_each_other(spark, tmp_path):
    from loomsearch.sources.catalog import ConflictError

    engine = Engine(spark, str(tmp_path))
    engine.create_collection("docs", "text", embedding_dim=384)
    engine.ingest("docs", {"id": "1", "text": "first words"})
    reader, late = engine.collection("docs"), engine.collection("docs")
    engine.ingest("docs", {"id": "2", "text": "second words"})
    # The reader keeps to what it has loaded and writes no manifest.
    assert {r["id"] for r in reader.search("words", alpha=0.0)} == {"1"}
    assert {r["id"] for r in engine.search("docs", "words", alpha=0.0)} == {"1", "2"} and len(engine.collection("docs")) == 2
    with pytest.raises(ConflictError):
        late.add({"id": "3", "text": "too late"})
    busy = engine.collection("docs")
    assert busy.files.create(f"{busy.folder}/claims/{busy.version + 1}", "")
    with pytest.raises(ConflictError):
        busy.add({"id": "3", "text": "at the same time"})
    busy.files.delete(f"{busy.folder}/claims/{busy.version + 1}")
    busy.add({"id": "3", "text": "third words"})
    assert engine.collection("docs").query_count == 2


def test_segments_hold_what_is_new_and_are_merged(spark, tmp_path, monkeypatch):
    from loomsearch.sources import catalog

    monkeypatch.setattr(catalog, "MOST_SEGMENTS", 3)
    store = CollectionStore(spark, str(tmp_path))
    c, p, want = store.create(CollectionConfig("grow", "text", DIM, "hnsw")), HashingProvider(DIM), {}
    for turn in range(7):
        batch = {f"d{turn}{i}": f"turn {turn} number {i} common" for i in range(6)} | {"d00": f"changed in turn {turn} common"}
        c.add_batch([{"id": k, "text": t} for k, t in batch.items()], p.embed_batch(list(batch.values())))
        want |= batch
        if turn % 2:
            assert c.delete(f"d{turn}1")
            del want[f"d{turn}1"]
        assert {i: t for i, _, t in plain(c)} == want and len(c) == len(want) and len(c.state.segments) <= 4
        again = Collection.load(spark, c.folder)
        index = again.keyword_index()
        fresh = index.documents.agg(F.count("*"), F.sum("dl")).first()
        assert (again.state.n, again.state.total_dl, again.state.n_vectors) == (fresh[0], fresh[1], again.vectors().count()) == (len(want), fresh[1], len(want))
        found = again.search("common", p.embed_one("turn 0 number 3 common"), alpha=0.5, k=100)
        assert {r["id"] for r in found} == set(want)
    assert next(r["id"] for r in c.search("x", p.embed_one("turn 0 number 3 common"), alpha=1.0, k=1)) == "d03"
    # Places are kept from the first insertion on, through replacements and merges.
    assert c.list_docs(1)[0][0]["id"] == "d00"
    for i in range(1, 6):
        assert c.delete(f"d6{i}") and len(c.state.gone) <= 4
        del want[f"d6{i}"]
    assert {i: t for i, _, t in plain(c)} == want
    before = plain(c)
    c.compact()
    assert plain(c) == before and len(c.state.segments) == 1 and "d03" in c and "d11" not in c
    assert c.vector_of("d03") is not None and c.vector_of("d11") is None


def test_the_scan_is_told_the_terms_of_a_search(spark, shop):
    from loomsearch.operators.bm25 import bm25_search

    _, c, _ = shop
    queries = spark.createDataFrame([(0, "wireless blender")], "qid long, text string")
    plan = bm25_search(queries, c.keyword_index())._jdf.queryExecution().executedPlan().toString()
    assert "In(term, [" in plan


def test_graph_shards_are_chosen_by_their_centroids(spark, monkeypatch):
    from loomsearch.operators import ann

    monkeypatch.setattr(ann, "SHARD_ROWS", 200)
    rng = np.random.default_rng(3)
    middles = rng.normal(size=(12, 16)) * 3
    rows = [(i, [float(x) for x in middles[i % 12] + rng.normal(size=16)]) for i in range(4000)]
    v = spark.createDataFrame(rows, "id long, embedding array<float>")
    q = v.where("id % 40 = 0").withColumnRenamed("id", "qid")
    exact = exact_search(q, v, 16, 10).persist()
    index = GraphIndex.build(v, 16)
    assert len(index.shards) >= 20 and index.nodes.groupBy("shard").count().agg(F.max("count")).first()[0] < 400
    assert mean_recall(index.search(q, 10, ef=100, probes=8), exact, 10).first()[0] >= 0.95
    assert index.candidates(q, 50, 10, probes=4).select("qid", "shard").distinct().count() < 0.7 * q.count() * len(index.shards)


def test_many_walks_in_step_find_what_single_ones_do():
    from loomsearch.operators.ann import beam_search, padded, proximity_graph

    rng = np.random.default_rng(4)
    rows = rng.normal(size=(500, 8)).astype(np.float32)
    rows /= np.linalg.norm(rows, axis=1, keepdims=True)
    near, upper = padded(proximity_graph(rows, 8, 50)), np.arange(0, 500, 20)
    queries = rows[::7] + np.float32(0.01)
    nodes, scores = beam_search(queries, rows, near, upper, 30)
    for i, q in enumerate(queries):
        alone, _ = beam_search(q[None], rows, near, upper, 30)
        assert set(alone[0]) == set(nodes[i]) and np.allclose(scores[i], rows[nodes[i]] @ q, atol=1e-5)
    truth = np.argsort(-(queries @ rows.T), axis=1)[:, :10]
    assert np.mean([len(set(t) & set(n)) / 10 for t, n in zip(truth, nodes)]) > 0.98


def test_jobs_count_a_batch_once_and_can_be_watched(spark, tmp_path):
    jobs = JobTracker(spark, str(tmp_path))
    job = jobs.create(4)
    states = []

    def work(_):
        step = [lambda: jobs.set_running(job.job_id), lambda: jobs.increment_done(job.job_id, 2, "b1"), lambda: jobs.increment_done(job.job_id, 2, "b1"), lambda: jobs.increment_errors(job.job_id, 1, "bad", "b2"), lambda: jobs.increment_done(job.job_id, 1)]
        step[len(states)]()
        states.append(1)

    seen = [(j.status, j.done, j.errors) for j in jobs.watch(job.job_id, sleep=work)]
    assert seen == [("queued", 0, 0), ("running", 0, 0), ("running", 2, 0), ("running", 2, 1), (DONE_WITH_ERRORS, 3, 1)]


def test_workers_share_the_collections_and_writers_wait(spark, tmp_path):
    from loomsearch.sources.catalog import ConflictError, retried

    engine = Engine(spark, str(tmp_path))
    for i in range(4):
        engine.create_collection(f"c{i}", "text", index_type="brute_force")
        engine.bulk_ingest(f"c{i}", [{"id": f"{i}-{k}", "text": "some words"} for k in range(3)])
    for worker in range(2):
        engine.work(once=True, worker=worker, workers=2).awaitTermination()
    assert [len(engine.collection(f"c{i}")) for i in range(4)] == [3] * 4
    # Each collection was written by one worker, once.
    assert all(engine.collection(f"c{i}").version == 1 for i in range(4))
    c, waits = engine.collection("c0"), []
    c.files.create(f"{c.folder}/claims/2", "")

    def wait(seconds):
        waits.append(seconds)
        if len(waits) == 2:
            c.files.delete(f"{c.folder}/claims/2")

    retried(lambda: engine.collection("c0").add({"id": "x", "text": "y"}), sleep=wait)
    assert waits == [1.0, 2.0] and len(engine.collection("c0")) == 4
    with pytest.raises(ConflictError):
        retried(lambda: c.add({"id": "z", "text": "y"}), tries=2, sleep=lambda _: None)
