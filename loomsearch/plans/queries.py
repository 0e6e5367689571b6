"""The registered queries: each operator on the tables of a folder."""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..engine import Engine
from ..functions.filters import TypedFields, VariantFields, predicate
from ..functions.text import tokens
from ..functions.vector import cosine, cosine_distance, dot, norm, normalised
from ..operators.ann import GraphIndex, IvfIndex
from ..operators.bm25 import bm25_search
from ..operators.chunking import chunk_documents
from ..operators.embedding import HashingProvider, embed
from ..operators.evaluation import floor_percentiles, mean_recall
from ..operators.postings import KeywordIndex, build_index, latest
from ..operators.vector_search import exact_search
from ..sources.catalog import CollectionConfig, CollectionStore
from ..sources.files import Files, read_json_documents, working_folder, write_metrics
from ..sources.partitions import spread
from ..sources.synthetic import products
from ..streaming.ingest import IngestionPipeline, enqueue_table
from ..streaming.jobs import JobTracker
from .search import hybrid_search

DIM = 64
_indexes: dict[tuple[str, str], KeywordIndex] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").withColumnRenamed("doc_id", "id")


def keyword_index(spark: SparkSession, sf_dir: str) -> KeywordIndex:
    """The index of documents, built once per session and folder and kept."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _indexes:
        _indexes[key] = build_index(documents(spark, sf_dir)).persist()
    return _indexes[key]


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), "embedding")


def benchmark_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("qid"), "text")


def vector_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every vector whose id is divisible by 20."""
    return vectors(spark, sf_dir).where("id % 20 = 0").withColumnRenamed("id", "qid")


def paired_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark items with the vector of the same number."""
    return benchmark_queries(spark, sf_dir).join(vectors(spark, sf_dir).withColumnRenamed("id", "qid"), "qid")


# Text analysis and the keyword index


def tokenize_counts(spark, sf_dir):
    return keyword_index(spark, sf_dir).postings.groupBy("term").agg(F.sum("tf").alias("n"))


def tokenize_plain(spark, sf_dir):
    return spread(documents(spark, sf_dir).select("id", "text")).select("id", F.array_join(tokens(F.col("text"), stemming=False), " ").alias("tokens"))


def unique_terms(spark, sf_dir):
    return keyword_index(spark, sf_dir).postings.groupBy("id").agg(F.count("*").cast("int").alias("n_terms"))


def doc_len(spark, sf_dir):
    return keyword_index(spark, sf_dir).documents


def index_statistics(spark, sf_dir):
    return keyword_index(spark, sf_dir).statistics().withColumn("avgdl", F.round("avgdl", 6))


def vocab_size(spark, sf_dir):
    return keyword_index(spark, sf_dir).vocab_size()


def term_stats(spark, sf_dir):
    return keyword_index(spark, sf_dir).term_statistics().withColumn("idf", F.round("idf", 6))


def term_freq(spark, sf_dir):
    return keyword_index(spark, sf_dir).term_freqs("disgusting")


def index_contains(spark, sf_dir):
    """Whether the documents after those of the table's first numbers are indexed, by
    twice the id of every vector."""
    asked = vectors(spark, sf_dir).select((2 * F.col("id")).alias("id"))
    return keyword_index(spark, sf_dir).which(asked)


def index_ids(spark, sf_dir):
    return keyword_index(spark, sf_dir).ids()


def bm25_topk(spark, sf_dir):
    """One query."""
    return bm25_search(benchmark_queries(spark, sf_dir).where("qid = 0"), keyword_index(spark, sf_dir), 10)


def bm25_batch(spark, sf_dir):
    """All benchmark items as queries, in one plan."""
    return bm25_search(benchmark_queries(spark, sf_dir), keyword_index(spark, sf_dir), 10)


def bm25_after_remove(spark, sf_dir):
    index = keyword_index(spark, sf_dir)
    return bm25_search(benchmark_queries(spark, sf_dir), index.remove(index.ids().where("id % 3 = 0")), 10)


# Vectors


def vector_topk(spark, sf_dir):
    return exact_search(vector_queries(spark, sf_dir).where("qid = 0"), vectors(spark, sf_dir), DIM, 10)


def vector_batch(spark, sf_dir):
    return exact_search(vector_queries(spark, sf_dir), vectors(spark, sf_dir), DIM, 10)


def vector_functions(spark, sf_dir):
    v, w = F.col("embedding"), F.reverse("embedding")
    return vectors(spark, sf_dir).select("id", F.round(norm(v), 6).alias("norm"), F.round(dot(v, w), 6).alias("dot"), F.round(cosine(v, w), 6).alias("cosine"), F.round(cosine_distance(v, w), 6).alias("distance"), F.round(F.get(normalised(F.transform(v, lambda x: x * 3)), F.lit(0)), 6).alias("first_of_unit"))


def ann_ivf(spark, sf_dir):
    return IvfIndex.build(vectors(spark, sf_dir), DIM, n_lists=16).search(vector_queries(spark, sf_dir), 10, probes=6)


def ann_graph(spark, sf_dir):
    return GraphIndex.build(vectors(spark, sf_dir), DIM).search(vector_queries(spark, sf_dir), 10, ef=100)


def _nearest(found: DataFrame) -> DataFrame:
    """The best score of each query, and whether it is that of the query's own vector."""
    return found.where("rank = 1").select("qid", "score")


def ann_ivf_nearest(spark, sf_dir):
    return _nearest(ann_ivf(spark, sf_dir))


def ann_graph_nearest(spark, sf_dir):
    return _nearest(ann_graph(spark, sf_dir))


def ann_graph_levels(spark, sf_dir):
    """Every vector is a node of the graph once, with a level and no more than 2 m
    neighbours."""
    nodes = GraphIndex.build(vectors(spark, sf_dir), DIM, m=8).nodes
    return nodes.select("id", (F.col("level") >= 0).alias("has_level"), (F.size("neighbours") <= 16).alias("bounded"), F.round(norm(F.col("embedding")), 4).alias("norm"))


def embed_hash(spark, sf_dir):
    made = embed(documents(spark, sf_dir).select("id", "text"), HashingProvider(DIM))
    return made.select("id", F.round(norm(F.col("embedding")), 4).alias("norm"), F.size("embedding").alias("dim"))


# Hybrid search


def _hybrid(spark, sf_dir, alpha, **options):
    """Ranks of 0 stand for lists that lack the document."""
    docs = documents(spark, sf_dir).select("id", "lang", "n_chars")

    def find(queries: DataFrame, n: int, allowed: DataFrame | None) -> DataFrame:
        known = vectors(spark, sf_dir)
        return exact_search(queries, known if allowed is None else known.join(allowed, "id", "left_semi"), DIM, n)

    found = hybrid_search(paired_queries(spark, sf_dir), docs, keyword_index(spark, sf_dir), find, 10, alpha, **options)
    ranks = [F.coalesce(c, F.lit(0)).alias(c) for c in ("bm25_rank", "vector_rank")]
    return found.select("qid", "id", "score", *ranks, "lang", "n_chars", "rank")


def hybrid_half(spark, sf_dir):
    return _hybrid(spark, sf_dir, 0.5)


def hybrid_keyword_only(spark, sf_dir):
    return _hybrid(spark, sf_dir, 0.0)


def hybrid_vector_only(spark, sf_dir):
    return _hybrid(spark, sf_dir, 1.0)


def hybrid_without_vectors(spark, sf_dir):
    """Alpha counts as 0 where there are no vectors."""
    docs = documents(spark, sf_dir).select("id", "lang", "n_chars")
    found = hybrid_search(paired_queries(spark, sf_dir), docs, keyword_index(spark, sf_dir), None, 10, 0.5)
    ranks = [F.coalesce(c, F.lit(0)).alias(c) for c in ("bm25_rank", "vector_rank")]
    return found.select("qid", "id", "score", *ranks, "lang", "n_chars", "rank")


def hybrid_filtered(spark, sf_dir):
    return _hybrid(spark, sf_dir, 0.5, filters={"lang": "en", "n_chars": {"$gte": 500, "$lte": 5000}})


def hybrid_prefiltered(spark, sf_dir):
    return _hybrid(spark, sf_dir, 0.5, filters={"lang": "en", "n_chars": {"$gte": 500}}, filter_mode="pre")


# Filters


def _filtered(spark, sf_dir, filters):
    docs = documents(spark, sf_dir).select("id", "lang", "source", "n_chars")
    passing = predicate(filters, TypedFields(docs))
    return docs if passing is None else docs.where(passing)


def filter_equal(spark, sf_dir):
    return _filtered(spark, sf_dir, {"lang": "fr"})


def filter_not_equal(spark, sf_dir):
    return _filtered(spark, sf_dir, {"lang": {"$ne": "en"}})


def filter_range(spark, sf_dir):
    return _filtered(spark, sf_dir, {"n_chars": {"$gte": 200, "$lte": 900}, "lang": "de"})


def filter_open_range(spark, sf_dir):
    return _filtered(spark, sf_dir, {"n_chars": {"$gt": 200, "$lt": 900}})


def filter_contains(spark, sf_dir):
    return _filtered(spark, sf_dir, {"source": {"$contains": "1"}})


def filter_contains_member(spark, sf_dir):
    parts = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), "p_type", F.concat(F.split("p_type", " "), F.split("p_name", " ")).alias("tags"))
    return parts.where(predicate({"tags": {"$contains": "ring"}}, TypedFields(parts))).drop("tags")


def filter_missing(spark, sf_dir):
    """A field that no row has equals null, and $ne passes what is missing."""
    events = table(spark, sf_dir, "events").select(F.col("event_id").alias("id"), "event_type")
    return events.where(predicate({"absent": None, "event_type": {"$ne": "click"}}, TypedFields(events)))


def filter_unknown(spark, sf_dir):
    return _filtered(spark, sf_dir, {"lang": {"$in": ["en"]}, "source": {}})


def filter_json(spark, sf_dir):
    events = table(spark, sf_dir, "events").select(F.col("event_id").alias("id"), "user_id", F.try_parse_json("props").alias("doc"))
    return events.where(predicate({"k": {"$gte": 50}}, VariantFields("doc"))).drop("doc")


def filter_cross_type(spark, sf_dir):
    """A number is never above or below a text, nor a text within a number."""
    events = table(spark, sf_dir, "events").select(F.col("event_id").alias("id"), "event_type", F.try_parse_json(F.concat(F.lit('{"n":'), F.col("user_id"), F.lit(',"t":"'), F.col("event_type"), F.lit('"}'))).alias("doc"))
    either = predicate({"t": {"$gte": 0}}, VariantFields("doc")) | predicate({"n": {"$gte": 50}, "t": {"$lt": "d"}}, VariantFields("doc"))
    return events.where(either).drop("doc")


# Chunks, documents, collections


def _chunked(spark, sf_dir, size, overlap):
    docs = spread(documents(spark, sf_dir).select("id", "text"))
    return chunk_documents(docs, size, overlap).select("id", "parent_id", F.col("chunk_index").cast("int").alias("chunk_index"), "text")


def chunk_fixed(spark, sf_dir):
    return _chunked(spark, sf_dir, 512, 64)


def chunk_small(spark, sf_dir):
    return _chunked(spark, sf_dir, 50, 10)


_stores: dict[tuple[str, str, str], CollectionStore] = {}


def store_of(spark: SparkSession, sf_dir: str, kind: str, fill: Callable[[CollectionStore], None]) -> CollectionStore:
    """A store of collections, filled once per session and folder."""
    key = (spark.sparkContext.applicationId, sf_dir, kind)
    if key not in _stores:
        store = CollectionStore(spark, working_folder(spark, kind))
        fill(store)
        _stores[key] = store
    return _stores[key]


def as_rows(docs: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """Rows of a collection from documents(id, text, lang, source, n_chars), with the
    vectors of known(id, embedding); in the order of the ids."""
    body = F.to_json(F.struct(F.col("id").cast("string").alias("id"), "lang", "source", "n_chars"))
    whole = docs.withColumn("body", body)
    whole = whole.withColumn("embedding", F.lit(None).cast("array<float>")) if known is None else whole.join(known, "id", "left")
    return whole.orderBy("id").select(F.col("id").cast("string").alias("id"), "text", "body", F.lit(None).cast("string").alias("parent_id"), "embedding")


def _of_body(docs: DataFrame) -> DataFrame:
    read = F.from_json("body", "lang string, source string, n_chars long")
    return docs.select(F.col("id").cast("long").alias("id"), read.alias("b")).select("id", "b.lang", "b.source", "b.n_chars")


def _documents_store(spark: SparkSession, sf_dir: str) -> CollectionStore:
    def fill(store: CollectionStore) -> None:
        made = store.create(CollectionConfig("documents", "text", DIM, "brute_force"))
        made.add_table(as_rows(documents(spark, sf_dir), vectors(spark, sf_dir)))

    return store_of(spark, sf_dir, "documents", fill)


def _languages_store(spark: SparkSession, sf_dir: str) -> CollectionStore:
    """Each language as a collection, the vectors with them; one search has been made."""

    def fill(store: CollectionStore) -> None:
        known = documents(spark, sf_dir).select("id", "text", "lang", "source", "n_chars")
        for lang in [r.lang for r in known.select("lang").distinct().orderBy("lang").collect()]:
            made = store.create(CollectionConfig(lang, "text", DIM, "brute_force"))
            own = known.where(F.col("lang") == lang).withColumn("text", F.col("source"))
            made.add_table(as_rows(own, vectors(spark, sf_dir)))
        made.search("web", alpha=0.0)

    return store_of(spark, sf_dir, "languages", fill)


def page_docs(spark, sf_dir):
    return _of_body(_documents_store(spark, sf_dir).get("documents").page(50, 100))


def point_lookup(spark, sf_dir):
    return _of_body(_documents_store(spark, sf_dir).get("documents").lookup("42"))


def preview_docs(spark, sf_dir):
    return _documents_store(spark, sf_dir).get("documents").preview(20)


def collection_search(spark, sf_dir):
    """All benchmark items against the collection, filtered by fields of its documents."""
    found = _documents_store(spark, sf_dir).get("documents").search_table(paired_queries(spark, sf_dir), 10, 0.5, {"lang": "en", "n_chars": {"$gte": 500, "$lte": 5000}})
    ranks = [F.coalesce(c, F.lit(0)).alias(c) for c in ("bm25_rank", "vector_rank")]
    read = F.from_json("body", "lang string, n_chars long")
    return found.select("qid", F.col("id").cast("long").alias("id"), "score", *ranks, read["lang"].alias("lang"), read["n_chars"].alias("n_chars"))


def upsert_latest(spark, sf_dir):
    """Events as versions of a document per user; the latest counts."""
    events = table(spark, sf_dir, "events").select(F.col("user_id").alias("id"), F.col("event_id").alias("seq"), "event_type", "value")
    return latest(events, "seq")


def delete_antijoin(spark, sf_dir):
    """The collection without the documents of some vectors."""

    def fill(store: CollectionStore) -> None:
        made = store.create(CollectionConfig("documents", "source", DIM, "brute_force"))
        made.add_table(as_rows(documents(spark, sf_dir).withColumn("text", F.col("source"))))
        gone = table(spark, sf_dir, "embeddings").where("label = 3")
        made.delete_table(gone.select(F.col("vec_id").cast("string").alias("id")))

    return _of_body(store_of(spark, sf_dir, "trimmed", fill).get("documents").docs())


def vector_changes(spark, sf_dir):
    """Vectors added, of every fifth one a reversed one in its place, every seventh one
    removed, one written again without a vector."""

    def fill(store: CollectionStore) -> None:
        made = store.create(CollectionConfig("vectors", "text", DIM, "ivf"))
        empty = F.lit(None).cast("string")
        rows = vectors(spark, sf_dir).orderBy("id").select(F.col("id").cast("string").alias("id"), F.lit("").alias("text"), F.to_json(F.struct("id")).alias("body"), empty.alias("parent_id"), "embedding")
        made.add_table(rows)
        made.add_table(rows.where("cast(id AS long) % 5 = 0").withColumn("embedding", F.reverse("embedding")))
        made.delete_table(rows.where("cast(id AS long) % 7 = 0").select("id"))
        made.add({"id": "1", "text": "no vector any more"})

    made = store_of(spark, sf_dir, "changed", fill).get("vectors")
    return made.vectors().select(F.col("id").cast("long").alias("id"), F.round(F.get("embedding", F.lit(0)), 5).alias("first"), F.size("embedding").alias("dim"))


def collection_stats(spark, sf_dir):
    stats = _documents_store(spark, sf_dir).get("documents").stats()
    return spark.createDataFrame([tuple(stats[k] for k in ("doc_count", "vector_count", "vocab_size", "embedding_dim", "index_type"))], "doc_count long, vector_count long, vocab_size long, embedding_dim int, index_type string")


def catalog_names(spark, sf_dir):
    return spark.createDataFrame([(x,) for x in _languages_store(spark, sf_dir).list()], "name string")


def catalog_totals(spark, sf_dir):
    totals = _languages_store(spark, sf_dir).totals()
    return spark.createDataFrame([tuple(totals.values())], ", ".join(f"{k} long" for k in totals))


def recall_half(spark, sf_dir):
    """Exact search among the vectors of even id against that among all."""
    asked, known = vector_queries(spark, sf_dir), vectors(spark, sf_dir)
    return mean_recall(exact_search(asked, known.where("id % 2 = 0"), DIM, 10), exact_search(asked, known, DIM, 10), 10)


def recall_ann(spark, sf_dir):
    """The graph index against exact search."""
    exact = exact_search(vector_queries(spark, sf_dir), vectors(spark, sf_dir), DIM, 10)
    return mean_recall(ann_graph(spark, sf_dir), exact, 10)


def latency_percentiles(spark, sf_dir):
    return floor_percentiles(table(spark, sf_dir, "events"), "event_type", "value", 50, 95, 99)


def synthetic_products(spark, sf_dir):
    return products(spark, 1000).select("id", "title", "category", "price")


def ingest_counters(spark, sf_dir):
    """The counters of an ingestion in which every seventh document has no name."""
    store = CollectionStore(spark, working_folder(spark, "counters"))
    made = store.create(CollectionConfig("documents", "text", 64, "brute_force"))
    name = F.when(F.col("id") % 7 != 0, F.col("id").cast("string"))
    rows = documents(spark, sf_dir).select(name.alias("id"), "text", F.to_json(F.struct("id")).alias("body"))
    counts = IngestionPipeline(made, HashingProvider(64)).ingest_table(rows)
    return spark.createDataFrame([(*counts.values(), len(made))], ", ".join(f"{k} long" for k in [*counts, "held"]))


def job_progress(spark, sf_dir):
    """A job that counts the documents of each language, one of them twice by mistake,
    and those of a language as errors."""
    jobs = JobTracker(spark, working_folder(spark, "jobs"))
    counts = {r["lang"]: r["count"] for r in documents(spark, sf_dir).groupBy("lang").count().orderBy("lang").collect()}
    job = jobs.create(sum(counts.values()))
    jobs.set_running(job.job_id)
    for lang, n in [*counts.items(), *counts.items()]:
        if lang == max(counts):
            jobs.increment_errors(job.job_id, n, f"no {lang}", lang)
        else:
            jobs.increment_done(job.job_id, n, lang)
    found = jobs.get(job.job_id)
    return spark.createDataFrame([(found.status, found.total, found.done, found.errors, found.error_msg, round(found.progress, 6), jobs.get("absent") is None)], "status string, total long, done long, errors long, error_msg string, progress double, absent boolean")


def json_documents(spark, sf_dir):
    """Nations as a JSON array, read as documents and taken into a collection, whose
    ids are texts."""
    folder = working_folder(spark, "json")
    nations = table(spark, sf_dir, "nation").orderBy("n_nationkey").collect()
    Files(spark).write(f"{folder}/nations.json", json.dumps([{"id": r.n_nationkey, "name": r.n_name, "region": r.n_regionkey} for r in nations]))
    read = read_json_documents(spark, f"{folder}/nations.json")
    made = CollectionStore(spark, f"{folder}/store").create(CollectionConfig("nations", "name", 8, "brute_force"))
    made.add_batch([r.asDict() for r in read.collect()])
    return made.docs().select("id", "text", F.from_json("body", "region long")["region"].alias("region"))


def engine_documents(spark, sf_dir):
    """Nations through the facade: a bulk job, a worker, a document replaced and one
    deleted; the pages, and what the job came to."""
    engine = Engine(spark, working_folder(spark, "engine"))
    engine.create_collection("nations", "name", index_type="brute_force")
    nations = [{"id": f"n{r.n_nationkey}", "name": r.n_name} for r in table(spark, sf_dir, "nation").orderBy("n_nationkey").collect()]
    job = engine.bulk_ingest("nations", [*nations, {"name": "nameless"}])
    engine.work(once=True).awaitTermination()
    engine.ingest("nations", {"id": "n3", "name": "REPLACED"})
    engine.delete_document("nations", "n5")
    done, total = engine.job(job.job_id), engine.documents("nations", 1)["total"]
    pages = [d for at in range(0, total, 10) for d in engine.documents("nations", 10, at)["documents"]]
    best = engine.answer("nations", "replaced", top_k=1, alpha=0.0)
    found = [(i, d["id"], d["name"], total, done.status, done.done, done.errors, best["results"][0]["id"], best["latency_ms"] > 0) for i, d in enumerate(pages)]
    return spark.createDataFrame(found, "place int, id string, name string, total long, status string, done long, errors long, best string, timed boolean")


def metrics_sink(spark, sf_dir):
    """Figures written as one JSON file and read again."""
    path = f"{working_folder(spark, 'metrics')}/latest.json"
    counts = documents(spark, sf_dir).agg(F.count("*").alias("documents"), F.countDistinct("lang").alias("languages")).first()
    write_metrics(spark, path, counts.asDict())
    return spark.read.schema("documents long, languages long").json(path)


def stream_ingest(spark, sf_dir):
    """Messages through the inbox and the stream; returns the collection's documents."""
    engine = Engine(spark, working_folder(spark, "stream"))
    engine.create_collection("docs", "text", embedding_dim=384, index_type="brute_force")
    rows = documents(spark, sf_dir).select(F.col("id").cast("string").alias("id"), "text")
    enqueue_table(rows, f"{engine.root}/inbox", "docs", engine.jobs.create(rows.count()).job_id)
    engine.work(once=True, chunk_size=0).awaitTermination()
    return engine.collection("docs").docs().select(F.col("id").cast("long").alias("id"), "text")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = [
        tokenize_counts, tokenize_plain, unique_terms, doc_len, index_statistics, vocab_size, term_stats, term_freq, index_contains, index_ids,
        bm25_topk, bm25_batch, bm25_after_remove, vector_topk, vector_batch, vector_functions, ann_ivf, ann_graph, ann_ivf_nearest, ann_graph_nearest, ann_graph_levels, embed_hash,
        hybrid_half, hybrid_keyword_only, hybrid_vector_only, hybrid_without_vectors, hybrid_filtered, hybrid_prefiltered, collection_search,
        filter_equal, filter_not_equal, filter_range, filter_open_range, filter_contains, filter_contains_member, filter_missing, filter_unknown, filter_json, filter_cross_type,
        chunk_fixed, chunk_small, page_docs, point_lookup, preview_docs, upsert_latest, delete_antijoin, vector_changes, collection_stats, catalog_names, catalog_totals,
        recall_half, recall_ann, latency_percentiles, synthetic_products, ingest_counters, job_progress, json_documents, engine_documents, metrics_sink, stream_ingest,
    ]
    return {f.__name__: f for f in found}
