"""DuckDB SQL for the registered queries, written against the tables alone."""

from __future__ import annotations

# Fixed values of the analysis, stated here once more, so that the SQL does not follow a
# change of the engine's own.
STOPWORDS = """
a an the and or but in on at to for of with by from is it its this that are was were be been being have has had do does did will would could
should may might shall can not no nor so yet both either neither as if than then there when where who which what how all each any some such
into through during before after above below up down out off over under again further once here only own same too very just about also
""".split()
SUFFIX_CHANGES = (
    ("ational", "ate"), ("tional", "tion"), ("enci", "ence"), ("anci", "ance"), ("izer", "ize"), ("iser", "ise"), ("alism", "al"),
    ("ization", "ize"), ("isation", "ise"), ("ation", "ate"), ("ator", "ate"), ("alistic", "al"), ("fulness", "ful"), ("ousness", "ous"),
    ("iveness", "ive"),
)
SUFFIX_CUTS = ("icate", "ative", "alize", "iciti", "ical", "ful", "ness")
RESTORE_E, UNDOUBLED_NOT = ("at", "bl", "iz"), "aeioul"


def _quoted(*words: str) -> str:
    return ", ".join(f"'{w}'" for w in words)


def _cut(n: int) -> str:
    return f"left(w, length(w) - {n})"


def _mended(n: int) -> str:
    stem = _cut(n)
    restore = " OR ".join(f"ends_with({stem}, '{e}')" for e in RESTORE_E)
    return (
        f"CASE WHEN {restore} THEN {stem} || 'e' WHEN length(w) >= {n + 2} AND right({stem}, 1) = right({_cut(n + 1)}, 1) "
        f"AND NOT contains('{UNDOUBLED_NOT}', right({stem}, 1)) THEN {_cut(n + 1)} ELSE {stem} END"
    )


def _suffixes(changes: tuple[tuple[str, str], ...]) -> str:
    rows = " ".join(f"WHEN ends_with(w, '{s}') AND length(w) > {len(s) + 1} THEN {_cut(len(s))} || '{put}'" for s, put in changes)
    return f"CASE {rows} ELSE w END"


_STEPS = (
    f"CASE WHEN ends_with(w, 'sses') OR ends_with(w, 'ies') THEN {_cut(2)} WHEN ends_with(w, 's') AND NOT ends_with(w, 'ss') AND length(w) > 4 THEN {_cut(1)} ELSE w END",
    f"CASE WHEN ends_with(w, 'eed') AND length(w) > 4 THEN {_cut(1)} WHEN ends_with(w, 'ing') AND length(w) > 5 THEN {_mended(3)} WHEN ends_with(w, 'ed') AND NOT ends_with(w, 'eed') AND length(w) > 4 THEN {_mended(2)} ELSE w END",
    _suffixes(SUFFIX_CHANGES),
    _suffixes(tuple((s, "") for s in SUFFIX_CUTS)),
)


def tokens(text: str, stemming: bool = True) -> str:
    """SQL for the tokens of a text."""
    raw = f"list_filter(string_split_regex(lower(coalesce({text}, '')), '[^\\p{{L}}\\p{{N}}_]+'), lambda t: length(t) > 1 AND t NOT IN ({_quoted(*STOPWORDS)}))"
    if not stemming:
        return raw
    chain = "[x]"
    for step in _STEPS:
        chain = f"list_transform({chain}, lambda w: {step})"
    return f"list_transform({raw}, lambda x: CASE WHEN length(x) > 3 THEN ({chain})[1] ELSE x END)"


INDEX = f"""
tok AS MATERIALIZED (SELECT doc_id AS id, {tokens('text')} AS tokens FROM documents),
docs AS (SELECT id, len(tokens) AS dl FROM tok),
stats AS (SELECT count(*) AS n, CAST(sum(dl) AS DOUBLE) / count(*) AS avgdl FROM docs),
postings AS MATERIALIZED (SELECT id, term, count(*) AS tf FROM (SELECT id, unnest(tokens) AS term FROM tok) GROUP BY id, term),
dfs AS MATERIALIZED (SELECT term, count(*) AS df FROM postings GROUP BY term)"""


def _bm25(queries: str, k: int, extra: str = "") -> str:
    """CTEs up to bm25(qid, id, score, rank)."""
    return f"""{INDEX},
q AS ({queries}),
qt AS (SELECT DISTINCT qid, unnest({tokens('text')}) AS term FROM q),
scored AS (SELECT qid, p.id, round(sum(ln((n - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE) + 1.0::DOUBLE) * (tf * 2.5::DOUBLE) / (tf + 1.5::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * dl / avgdl))), 6) AS score
  FROM qt JOIN postings p USING (term) JOIN dfs USING (term) JOIN docs d ON d.id = p.id CROSS JOIN stats {extra} GROUP BY qid, p.id),
bm25 AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, id) AS rank FROM scored) WHERE rank <= {k})"""


def _vector(queries: str, k: int, where: str = "") -> str:
    """CTEs up to vec(qid, id, score, rank)."""
    return f"""vq AS ({queries}),
vs AS (SELECT qid, vec_id AS id, round(list_dot_product(CAST(vq.embedding AS DOUBLE[]), CAST(e.embedding AS DOUBLE[])) / sqrt(list_dot_product(CAST(vq.embedding AS DOUBLE[]), CAST(vq.embedding AS DOUBLE[])) * list_dot_product(CAST(e.embedding AS DOUBLE[]), CAST(e.embedding AS DOUBLE[]))), 6) AS score
  FROM vq CROSS JOIN embeddings e {where}),
vec AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, id) AS rank FROM vs) WHERE rank <= {k})"""


BENCHMARK = "SELECT item_id AS qid, text FROM benchmark"
PAIRED = "SELECT b.item_id AS qid, b.text, e.embedding FROM benchmark b JOIN embeddings e ON e.vec_id = b.item_id"
FIRST = "SELECT item_id AS qid, text FROM benchmark WHERE item_id = 0"
EVERY_20TH = "SELECT vec_id AS qid, embedding FROM embeddings WHERE vec_id % 20 = 0"


def _hybrid(alpha: float, k: int, where: str = "", pre: str = "") -> str:
    n = 2 * k
    keyword_where = f"JOIN documents f ON f.doc_id = p.id AND {pre}" if pre else ""
    vector_where = f"JOIN documents f ON f.doc_id = e.vec_id AND {pre}" if pre else ""
    keyword = "SELECT * FROM bm25" if alpha < 1 else "SELECT * FROM bm25 WHERE FALSE"
    vector = "SELECT * FROM vec" if alpha > 0 else "SELECT * FROM vec WHERE FALSE"
    return f"""WITH {_bm25(PAIRED, n, keyword_where)},
{_vector("SELECT qid, embedding FROM q", n, vector_where)},
kk AS ({keyword}), vv AS ({vector}),
f0 AS (SELECT coalesce(kk.qid, vv.qid) AS qid, coalesce(kk.id, vv.id) AS id, kk.rank AS bm25_rank, vv.rank AS vector_rank,
  round(coalesce({1 - alpha}::DOUBLE / (60 + kk.rank), 0) + coalesce({alpha}::DOUBLE / (60 + vv.rank), 0), 9) AS score
  FROM kk FULL JOIN vv ON kk.qid = vv.qid AND kk.id = vv.id),
f1 AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, id) AS r FROM f0 WHERE score > 0) WHERE r <= {n}),
f2 AS (SELECT f1.*, d.lang, d.n_chars FROM f1 JOIN documents d ON d.doc_id = f1.id {where})
SELECT * FROM (SELECT qid, id, score, CAST(coalesce(bm25_rank, 0) AS INTEGER) AS bm25_rank, CAST(coalesce(vector_rank, 0) AS INTEGER) AS vector_rank, lang, n_chars, CAST(row_number() OVER (PARTITION BY qid ORDER BY score DESC, id) AS INTEGER) AS rank FROM f2) WHERE rank <= {k}"""


def _with_text_ids(sql: str) -> str:
    """The SQL of a search with ids as texts, as collections have them."""
    for name in ("doc_id AS id", "vec_id AS id"):
        sql = sql.replace(name, f"CAST({name.split()[0]} AS VARCHAR) AS id")
    return sql.replace("f.doc_id = p.id", "CAST(f.doc_id AS VARCHAR) = p.id").replace("d.doc_id = f1.id", "CAST(d.doc_id AS VARCHAR) = f1.id")


#: White space in the sense of Unicode, for RE2.
_EDGE = r"^[\s\p{Z}\x1C-\x1F\x0B\x{85}]+|[\s\p{Z}\x1C-\x1F\x0B\x{85}]+$"


def _chunks(size: int, overlap: int, least: int) -> str:
    step = size - overlap
    strip = f"regexp_replace(%s, '{_EDGE}', '', 'g')"
    return f"""WITH w AS (SELECT doc_id, text, list_transform(range(0, length(text), {step}), lambda i: substring(text, i + 1, {size})) AS parts FROM documents),
k AS (SELECT doc_id, text, list_filter(parts, lambda p: length({strip % 'p'}) >= {least}) AS kept FROM w),
c AS (SELECT doc_id, CASE WHEN length(text) <= {size} OR len(kept) = 0 THEN [text] ELSE kept END AS parts FROM k),
o AS (SELECT doc_id, len(parts) AS n, unnest(range(0, len(parts))) AS chunk_index, parts FROM c)
SELECT CASE WHEN n = 1 THEN CAST(doc_id AS VARCHAR) ELSE CAST(doc_id AS VARCHAR) || '__chunk_' || chunk_index END AS id, CAST(doc_id AS VARCHAR) AS parent_id, CAST(chunk_index AS INTEGER) AS chunk_index, parts[chunk_index + 1] AS text FROM o"""


_DOC = "doc_id AS id, lang, source, n_chars"
_PRODUCTS = """
SELECT CAST(i AS VARCHAR) AS id, brand || ' ' || adjective || ' ' || noun AS title, category, price FROM (
  SELECT i, ({brands})[(i * 7919 + 42) % {nb} + 1] AS brand, ({adjectives})[(i * 104729 + 42) % {na} + 1] AS adjective, ({nouns})[(i * 1299709 + 42) % {nn} + 1] AS noun,
    ({categories})[(i * 15485863 + 42) % {nc} + 1] AS category, CAST(999 + (i * 32452843 + 42) % 29001 AS DOUBLE) / 100 AS price
  FROM range(0, 1000) t(i))"""


def _products() -> str:
    from ..sources.synthetic import ADJECTIVES, BRANDS, CATEGORIES, NOUNS

    lists = {"brands": BRANDS, "adjectives": ADJECTIVES, "nouns": NOUNS, "categories": CATEGORIES}
    return _PRODUCTS.format(**{k: f"[{_quoted(*v)}]" for k, v in lists.items()}, nb=len(BRANDS), na=len(ADJECTIVES), nn=len(NOUNS), nc=len(CATEGORIES))


#: The best score of a query that is a vector itself.
NEAREST = f"WITH {_vector(EVERY_20TH, 1)} SELECT qid, score FROM vec"


def oracle_sql() -> dict[str, str]:
    in_collection = "WHERE lang = 'en' AND n_chars >= 500 AND n_chars <= 5000"
    return {
        "tokenize_counts": f"WITH {INDEX} SELECT term, CAST(sum(tf) AS BIGINT) AS n FROM postings GROUP BY term",
        "tokenize_plain": f"SELECT doc_id AS id, array_to_string({tokens('text', False)}, ' ') AS tokens FROM documents",
        "unique_terms": f"WITH {INDEX} SELECT id, CAST(count(*) AS INTEGER) AS n_terms FROM postings GROUP BY id",
        "doc_len": f"WITH {INDEX} SELECT id, CAST(dl AS INTEGER) AS dl FROM docs",
        "index_statistics": f"WITH {INDEX} SELECT count(*) AS n, CAST(sum(dl) AS BIGINT) AS total_dl, round(CAST(sum(dl) AS DOUBLE) / count(*), 6) AS avgdl FROM docs",
        "vocab_size": f"WITH {INDEX} SELECT count(*) AS vocab_size FROM dfs",
        "term_stats": f"WITH {INDEX} SELECT term, df, round(ln((n - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE) + 1.0::DOUBLE), 6) AS idf FROM dfs CROSS JOIN stats",
        "term_freq": f"WITH {INDEX} SELECT id, CAST(tf AS INTEGER) AS tf FROM postings WHERE term = (SELECT (tokens)[1] FROM (SELECT {tokens("'disgusting'")} AS tokens))",
        "index_contains": "SELECT 2 * vec_id AS id, 2 * vec_id IN (SELECT doc_id FROM documents) AS held FROM embeddings",
        "index_ids": "SELECT doc_id AS id FROM documents",
        "bm25_topk": f"WITH {_bm25(FIRST, 10)} SELECT qid, id, score, CAST(rank AS INTEGER) AS rank FROM bm25",
        "bm25_batch": f"WITH {_bm25(BENCHMARK, 10)} SELECT qid, id, score, CAST(rank AS INTEGER) AS rank FROM bm25",
        "bm25_after_remove": f"WITH {_bm25(BENCHMARK, 10).replace('FROM documents)', 'FROM documents WHERE doc_id % 3 <> 0)', 1)} SELECT qid, id, score, CAST(rank AS INTEGER) AS rank FROM bm25",
        "vector_topk": f"WITH {_vector(EVERY_20TH + ' AND vec_id = 0', 10)} SELECT qid, id, score, CAST(rank AS INTEGER) AS rank FROM vec",
        "vector_batch": f"WITH {_vector(EVERY_20TH, 10)} SELECT qid, id, score, CAST(rank AS INTEGER) AS rank FROM vec",
        "vector_functions": "SELECT vec_id AS id, round(sqrt(list_dot_product(v, v)), 6) AS norm, round(list_dot_product(v, w), 6) AS dot, round(list_dot_product(v, w) / sqrt(list_dot_product(v, v) * list_dot_product(w, w)), 6) AS cosine, round(1 - list_dot_product(v, w) / sqrt(list_dot_product(v, v) * list_dot_product(w, w)), 6) AS distance, round(v[1] / sqrt(list_dot_product(v, v)), 6) AS first_of_unit FROM (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v, CAST(list_reverse(embedding) AS DOUBLE[]) AS w FROM embeddings)",
        "embed_hash": r"SELECT doc_id AS id, CASE WHEN regexp_matches(text, '[\p{L}\p{N}_]') THEN CAST(1 AS FLOAT) ELSE CAST(0 AS FLOAT) END AS norm, CAST(64 AS INTEGER) AS dim FROM documents",
        "hybrid_half": _hybrid(0.5, 10),
        "hybrid_keyword_only": _hybrid(0.0, 10),
        "hybrid_vector_only": _hybrid(1.0, 10),
        "hybrid_without_vectors": _hybrid(0.0, 10),
        "collection_search": f"SELECT qid, CAST(id AS BIGINT) AS id, score, bm25_rank, vector_rank, lang, n_chars FROM ({_with_text_ids(_hybrid(0.5, 10, in_collection, 'TRUE'))})",
        "ann_ivf_nearest": NEAREST,
        "ann_graph_nearest": NEAREST,
        "ann_graph_levels": "SELECT vec_id AS id, true AS has_level, true AS bounded, CAST(1.0 AS DOUBLE) AS norm FROM embeddings WHERE list_dot_product(embedding, embedding) > 0",
        "hybrid_filtered": _hybrid(0.5, 10, "WHERE lang = 'en' AND n_chars >= 500 AND n_chars <= 5000"),
        "hybrid_prefiltered": _hybrid(0.5, 10, "", "f.lang = 'en' AND f.n_chars >= 500"),
        "filter_equal": f"SELECT {_DOC} FROM documents WHERE lang = 'fr'",
        "filter_not_equal": f"SELECT {_DOC} FROM documents WHERE lang IS DISTINCT FROM 'en'",
        "filter_range": f"SELECT {_DOC} FROM documents WHERE n_chars >= 200 AND n_chars <= 900 AND lang = 'de'",
        "filter_open_range": f"SELECT {_DOC} FROM documents WHERE n_chars > 200 AND n_chars < 900",
        "filter_contains": f"SELECT {_DOC} FROM documents WHERE contains(source, '1')",
        "filter_contains_member": "SELECT p_partkey AS id, p_type FROM part WHERE list_contains(string_split(p_type, ' '), 'ring') OR list_contains(string_split(p_name, ' '), 'ring')",
        "filter_missing": "SELECT event_id AS id, event_type FROM events WHERE event_type IS DISTINCT FROM 'click'",
        "filter_unknown": f"SELECT {_DOC} FROM documents",
        "filter_json": "SELECT event_id AS id, user_id FROM events WHERE CAST(json_extract(props, '$.k') AS DOUBLE) >= 50 AND user_id >= 0",
        "filter_cross_type": "SELECT event_id AS id, event_type FROM events WHERE user_id >= 50 AND event_type < 'd'",
        "chunk_fixed": _chunks(512, 64, 20),
        "chunk_small": _chunks(50, 10, 20),
        "page_docs": f"SELECT {_DOC} FROM documents ORDER BY doc_id LIMIT 50 OFFSET 100",
        "point_lookup": f"SELECT {_DOC} FROM documents WHERE doc_id = 42",
        "upsert_latest": "SELECT user_id AS id, event_id AS seq, event_type, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS r FROM events) WHERE r = 1",
        "delete_antijoin": f"SELECT {_DOC} FROM documents WHERE doc_id NOT IN (SELECT vec_id FROM embeddings WHERE label = 3)",
        "preview_docs": "SELECT CAST(doc_id AS VARCHAR) AS id, ['lang: ' || left(lang, 60), 'source: ' || left(source, 60), 'n_chars: ' || left(CAST(n_chars AS VARCHAR), 60)] AS preview FROM documents ORDER BY doc_id LIMIT 20",
        "vector_changes": "SELECT vec_id AS id, round(CASE WHEN vec_id % 5 = 0 THEN embedding[len(embedding)] ELSE embedding[1] END, 5) AS first, CAST(len(embedding) AS INTEGER) AS dim FROM embeddings WHERE vec_id % 7 <> 0 AND vec_id <> 1",
        "collection_stats": f"WITH {INDEX} SELECT (SELECT count(*) FROM documents) AS doc_count, (SELECT count(*) FROM embeddings WHERE vec_id IN (SELECT doc_id FROM documents)) AS vector_count, (SELECT count(*) FROM dfs) AS vocab_size, CAST(64 AS INTEGER) AS embedding_dim, 'brute_force' AS index_type",
        "catalog_names": "SELECT DISTINCT lang AS name FROM documents",
        "catalog_totals": "SELECT (SELECT count(DISTINCT lang) FROM documents) AS collections, (SELECT count(*) FROM documents) AS doc_count, (SELECT count(*) FROM embeddings WHERE vec_id IN (SELECT doc_id FROM documents)) AS vector_count, CAST(1 AS BIGINT) AS query_count",
        "recall_half": f"WITH {_vector(EVERY_20TH, 10)} SELECT round(avg(hits), 6) AS mean_recall FROM (SELECT qid, count(*) FILTER (WHERE id % 2 = 0) / count(*) AS hits FROM vec GROUP BY qid)",
        "job_progress": "SELECT 'done_with_errors' AS status, count(*) AS total, count(*) FILTER (WHERE lang <> top) AS done, count(*) FILTER (WHERE lang = top) AS errors, 'no ' || any_value(top) AS error_msg, round(count(*) FILTER (WHERE lang <> top) / count(*), 6) AS progress, true AS absent FROM documents CROSS JOIN (SELECT max(lang) AS top FROM documents)",
        "json_documents": "SELECT CAST(n_nationkey AS VARCHAR) AS id, n_name AS text, CAST(n_regionkey AS BIGINT) AS region FROM nation",
        "engine_documents": "SELECT CAST(row_number() OVER (ORDER BY n_nationkey) - 1 AS INTEGER) AS place, 'n' || n_nationkey AS id, CASE WHEN n_nationkey = 3 THEN 'REPLACED' ELSE n_name END AS name, (SELECT count(*) - 1 FROM nation) AS total, 'done_with_errors' AS status, (SELECT count(*) FROM nation) AS done, CAST(1 AS BIGINT) AS errors, 'n3' AS best, true AS timed FROM nation WHERE n_nationkey <> 5",
        "metrics_sink": "SELECT count(*) AS documents, count(DISTINCT lang) AS languages FROM documents",
        "latency_percentiles": "SELECT event_type, list_sort(v)[least(CAST(floor(len(v) * 50.0 / 100) AS BIGINT), len(v) - 1) + 1] AS p50, list_sort(v)[least(CAST(floor(len(v) * 95.0 / 100) AS BIGINT), len(v) - 1) + 1] AS p95, list_sort(v)[least(CAST(floor(len(v) * 99.0 / 100) AS BIGINT), len(v) - 1) + 1] AS p99 FROM (SELECT event_type, list(value) AS v FROM events WHERE value IS NOT NULL GROUP BY event_type)",
        "synthetic_products": _products(),
        "ingest_counters": f"SELECT (SELECT count(*) FROM documents WHERE doc_id % 7 <> 0) AS indexed, (SELECT count(*) FROM documents WHERE doc_id % 7 = 0) AS errors, count(*) AS chunks, CAST(0 AS BIGINT) AS embed_errors, count(*) AS held FROM ({_chunks(512, 64, 20)}) WHERE CAST(parent_id AS BIGINT) % 7 <> 0",
        "stream_ingest": "SELECT doc_id AS id, text FROM documents",
    }
