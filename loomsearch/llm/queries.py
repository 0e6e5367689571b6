"""The registered queries of the operators in this subpackage, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .op10_minhash_near_dedup import near_duplicates
from .op4_benchmark_decontamination import find_contamination
from .op5_language_id import identify_languages
from .op6_chat_formatting import SCHEMA_DDL, format_chats
from .op7_sharding import assign_shards
from .op8_secret_scan import scan
from .op9_best_fit_packing import pack_documents
from .op1_toxicity import score_toxicity
from .op2_quality_rules import BOILERPLATE, FRAGMENT_WORDS, LOST_SHARE, SYMBOL_SHARE, line_quality
from .op3_substring_dedup import remove_repeated_passages


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, held_out, score, predicted of every document."""
    return score_toxicity(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base figures and the verdict of the line rules for every document."""
    judged = line_quality(_table(spark, sf_dir, "documents"))
    return judged.select("doc.doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "n_lost_words")


def op3_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 of every document; 13-word windows."""
    cut = remove_repeated_passages(_table(spark, sf_dir, "documents"))
    return cut.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


def op10_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_shingles, component_id, kept of every document; similarity 0.85."""
    return near_duplicates(_table(spark, sf_dir, "documents"), percent=85)


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every page; texts of known language are those of documents."""
    return identify_languages(_table(spark, sf_dir, "pages"), _table(spark, sf_dir, "documents"))


#: The tool that answers questions, as op6 reads the conversations.
ANSWER_SCHEMA = [("answer", "question", "string", True), ("answer", "length", "integer", True), ("answer", "hint", "object", False)]


def as_tool_calls(conversations: DataFrame) -> DataFrame:
    """The conversations with every question answered by a tool: behind each user turn
    the assistant calls the tool `answer`, and what the assistant said is the result.

    A call's identifier is its turn. Four calls in a row wait for one another: the
    second, third and fourth name the call two turns before as their predecessor, the
    third by a mark in its arguments. What ends in no question mark is passed as
    `statement`, which the tool's schema does not know. An assistant turn answers the
    call of the turn before, if there is one."""
    turn, text = F.col("turn"), F.coalesce("text", F.lit(""))
    name = F.concat(F.lit("call-"), turn.cast("string"))
    nth = F.pmod(F.floor(turn / 2), F.lit(4))
    before = F.concat(F.lit("call-"), (turn - 2).cast("string"))
    asks = F.endswith(F.rtrim(text), F.lit("?"))
    hint = F.when(nth == 2, F.struct(F.concat(F.lit("${"), before, F.lit("}")).alias("of")))
    arguments = F.struct(F.when(asks, text).alias("question"), F.when(~asks, text).alias("statement"), F.length(text).alias("length"), hint.alias("hint"))
    call = F.struct(name.alias("id"), F.lit("answer").alias("name"), arguments.alias("arguments"), F.when(nth.isin(1, 3), F.array(before)).alias("after"))
    calls = conversations.where("role = 'user'").select("conv_id", "turn", F.lit("assistant").alias("role"), F.to_json(F.struct(F.array(call).alias("tool_calls"))).alias("text"))
    result = F.to_json(F.struct(text.alias("content"), F.concat(F.lit("call-"), (turn - 1).cast("string")).alias("tool_call_id")))
    answers = conversations.where("role = 'assistant'").select("conv_id", "turn", F.lit("tool").alias("role"), result.alias("text"))
    others = conversations.where("role IS NULL OR role != 'assistant'").select("conv_id", "turn", "role", "text")
    return others.unionByName(calls).unionByName(answers)


def op6_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every message, tool call and tool result of all conversations as JSON, with the
    questions read as calls of a tool and the answers as its results."""
    schemas = spark.createDataFrame(ANSWER_SCHEMA, SCHEMA_DDL)
    return format_chats(as_tool_calls(_table(spark, sf_dir, "conversations")), schemas)


def op7_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document in one of 16 shards of nearly equal bytes."""
    dealt = assign_shards(_table(spark, sf_dir, "documents"))
    return dealt.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op8_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per candidate of every document, with the forest's verdict."""
    found = scan(_table(spark, sf_dir, "documents"), path_col="source").select("doc.doc_id", F.posexplode("findings").alias("finding", "f"))
    return found.select("doc_id", "finding", F.col("f.word").alias("word"), F.length("f.value").alias("length"), F.sha2("f.value", 256).alias("value_sha256"), F.col("f.score").alias("score"), F.col("f.is_secret").alias("is_secret"))


def op9_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per piece of every document, in sequences of 2048 tokens."""
    return pack_documents(_table(spark, sf_dir, "documents"))


def op4_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hits of 10-word windows of all benchmark items in every document."""
    found = find_contamination(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", "n_items", F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256"), "contaminated")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = [op1_toxicity, op2_quality_rules, op3_substring_dedup, op4_benchmark_decontamination, op5_language_id, op6_chat_formatting, op7_sharding, op8_secret_scan, op9_best_fit_packing, op10_minhash_near_dedup]
    return {f.__name__: f for f in found}


#: A-Z in lower case, as the operators do it, in SQL.
_LOWER = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

OP3_SQL = r"""
WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents),
s AS (SELECT doc_id, unnest(range(1, len(words) - 11)) AS pos, words FROM w WHERE len(words) >= 13),
g AS (SELECT doc_id, pos, array_to_string(words[pos:pos + 12], ' ') AS grams FROM s),
f AS (SELECT grams, min(doc_id) AS least FROM g GROUP BY grams),
r AS (SELECT DISTINCT doc_id, unnest(range(pos, pos + 13)) AS place FROM g JOIN f USING (grams) WHERE least < doc_id),
p AS (SELECT doc_id, list(place) AS places FROM r GROUP BY doc_id),
k AS (SELECT w.doc_id, len(words) AS n_words, coalesce(len(places), 0) AS n_removed,
  CASE WHEN places IS NULL THEN words ELSE list_transform(list_filter(range(1, len(words) + 1), lambda i: NOT list_contains(places, i)), lambda i: words[i]) END AS kept
  FROM w LEFT JOIN p USING (doc_id))
SELECT doc_id, n_words, n_removed, sha256(array_to_string(kept, ' ')) AS kept_sha256 FROM k
"""

OP4_SQL = rf"""
WITH dw AS (SELECT doc_id, regexp_extract_all(coalesce({_LOWER}, ''), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words FROM documents),
bw AS (SELECT item_id, regexp_extract_all(coalesce({_LOWER}, ''), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words FROM benchmark),
bg AS (SELECT DISTINCT item_id, least(10, len(words)) AS n, array_to_string(words[pos:pos + least(10, len(words)) - 1], ' ') AS grams
  FROM (SELECT item_id, words, unnest(range(1, greatest(len(words) - 8, 2))) AS pos FROM bw WHERE len(words) > 0)),
ns AS (SELECT DISTINCT n FROM bg),
dg AS (SELECT doc_id, n, pos, array_to_string(words[pos:pos + n - 1], ' ') AS grams
  FROM (SELECT doc_id, words, n, unnest(range(1, len(words) - n + 2)) AS pos FROM dw CROSS JOIN ns WHERE len(words) >= n)),
h AS (SELECT doc_id, item_id, pos, n FROM dg JOIN bg USING (n, grams)),
c AS (SELECT doc_id, count(DISTINCT place) AS n_hit FROM (SELECT doc_id, unnest(range(pos, pos + n)) AS place FROM h) GROUP BY doc_id),
i AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM h) GROUP BY doc_id)
SELECT doc_id, len(words) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM dw LEFT JOIN c USING (doc_id) LEFT JOIN i USING (doc_id)
"""


OP2_SQL = rf"""
WITH t AS (SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents),
g AS (SELECT doc_id, pos, words[pos] || chr(10) || words[pos + 1] || chr(10) || words[pos + 2] AS grams FROM (SELECT doc_id, words, unnest(range(1, len(words) - 1)) AS pos FROM t WHERE len(words) > 2)),
m AS (SELECT doc_id, unnest([pos, pos + 1, pos + 2]) AS place FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, grams) AS times FROM g) WHERE times > 1),
r AS (SELECT doc_id, count(DISTINCT place) AS n_repeat_words FROM m GROUP BY doc_id),
l AS (SELECT doc_id, line, len(regexp_extract_all(line, '[^\x20\x09-\x0D]+')) AS n, lower(line) AS low, trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS bare
  FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM t) WHERE regexp_matches(line, '[^\x20\x09-\x0D]')),
v AS (SELECT doc_id, line, n,
  (n < {FRAGMENT_WORDS} AND right(rtrim(bare, '"' || chr(39) || '”»)]'), 1) NOT IN ('.', '!', '?', '…', ':', ';', '。', '！', '？'))
  OR (contains(bare, '!!') AND upper(bare) = bare)
  OR len(regexp_extract_all(bare, '[^\x20\x09-\x0D]*[#*$%&|<>{{}}]+[^\x20\x09-\x0D]*')) > {SYMBOL_SHARE}::DOUBLE * n
  OR {" OR ".join(f"contains(low, '{phrase}')" for phrase in BOILERPLATE)} AS fails FROM l),
d AS (SELECT doc_id, count(*) - count(DISTINCT line) AS n_dup_lines, CAST(coalesce(sum(n) FILTER (WHERE fails), 0) AS BIGINT) AS n_lost_words FROM v GROUP BY doc_id),
b AS (SELECT doc_id, len(words) AS n_words, CAST(length(array_to_string(words, '')) AS BIGINT) AS word_chars, len(regexp_extract_all(text, '[#*$%&|<>]')) AS n_symbols,
  coalesce(n_dup_lines, 0) AS n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words, coalesce(n_lost_words, 0) AS n_lost_words FROM t LEFT JOIN r USING (doc_id) LEFT JOIN d USING (doc_id)),
f AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM b)
SELECT *, NOT base_failed AND n_lost_words <= {LOST_SHARE}::DOUBLE * n_words AS kept FROM f
"""

OP10_SQL = rf"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(coalesce({_LOWER}, ''), '[^\x20\x09-\x0D]+') AS words FROM documents),
s AS MATERIALIZED (SELECT DISTINCT doc_id, array_to_string(words[pos:pos + least(5, len(words)) - 1], ' ') || CASE WHEN len(words) < 5 THEN '#' || len(words) ELSE '' END AS shingle
  FROM (SELECT doc_id, words, unnest(range(1, greatest(len(words) - 3, 2))) AS pos FROM w WHERE len(words) > 0)),
n AS MATERIALIZED (SELECT doc_id, count(*) AS n_shingles FROM s GROUP BY doc_id),
c AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS common FROM s a JOIN s b ON a.shingle = b.shingle AND a.doc_id < b.doc_id GROUP BY a.doc_id, b.doc_id),
k AS MATERIALIZED (SELECT x, y FROM c JOIN n p ON p.doc_id = x JOIN n q ON q.doc_id = y WHERE 100 * common >= 85 * (p.n_shingles + q.n_shingles - common)),
e AS MATERIALIZED (SELECT x, y FROM k UNION SELECT y, x FROM k),
reach AS (SELECT x AS doc_id, x AS id FROM e UNION SELECT reach.doc_id, e.y FROM reach JOIN e ON e.x = reach.id),
m AS (SELECT doc_id, min(id) AS least FROM reach GROUP BY doc_id)
SELECT w.doc_id, coalesce(n_shingles, 0) AS n_shingles, coalesce(least, w.doc_id) AS component_id, coalesce(least, w.doc_id) = w.doc_id AS kept
FROM w LEFT JOIN n USING (doc_id) LEFT JOIN m USING (doc_id)
"""

OP6_SQL = """
WITH RECURSIVE u AS (SELECT conv_id, turn, coalesce(text, '') AS text, 'call-' || turn AS call, (turn // 2) % 4 AS nth, 'call-' || (turn - 2) AS two_before, rtrim(coalesce(text, '')) LIKE '%?' AS asks FROM conversations WHERE role = 'user'),
w AS (SELECT u.*, b.call AS before FROM u LEFT JOIN u b ON b.conv_id = u.conv_id AND b.call = u.two_before AND u.nth > 0),
l AS (SELECT conv_id, call, 0 AS level FROM w WHERE before IS NULL UNION ALL SELECT w.conv_id, w.call, l.level + 1 FROM w JOIN l ON w.conv_id = l.conv_id AND w.before = l.call),
a AS (SELECT conv_id, turn, coalesce(text, '') AS text, 'call-' || (turn - 1) AS call FROM conversations WHERE role = 'assistant'),
c AS (SELECT u.*, level, EXISTS (SELECT 1 FROM a WHERE a.conv_id = u.conv_id AND a.call = u.call) AS answered FROM u JOIN l USING (conv_id, call)),
m AS (SELECT conv_id, turn, coalesce(text, '') AS text, coalesce(role, '') AS role FROM conversations WHERE role IS DISTINCT FROM 'assistant' UNION ALL SELECT conv_id, turn, '', 'assistant' FROM u)
SELECT conv_id, turn, 'message' AS kind, CAST(NULL AS VARCHAR) AS call_id, turn AS order_turn, 0 AS level, 'ok' AS status,
  '{"content":' || CAST(to_json(text) AS VARCHAR) || ',"role":' || CAST(to_json(role) AS VARCHAR) || '}' AS json FROM m
UNION ALL
SELECT conv_id, turn, 'call', call, turn, level * 2 + 1, CASE WHEN NOT asks THEN 'invalid' WHEN NOT answered THEN 'unanswered' ELSE 'ok' END,
  '{"arguments":{' || CASE WHEN nth = 2 THEN '"hint":{"of":"${' || two_before || '}"},' ELSE '' END || '"length":' || length(text)
  || CASE WHEN asks THEN ',"question":' ELSE ',"statement":' END || CAST(to_json(text) AS VARCHAR) || '},"id":"' || call || '","name":"answer","problems":'
  || CASE WHEN asks THEN '[]' ELSE '["missing question","unknown statement"]' END || '}' FROM c
UNION ALL
SELECT a.conv_id, a.turn, 'result', a.call, a.turn, 0, CASE WHEN l.call IS NULL THEN 'orphan' ELSE 'ok' END,
  '{"content":' || CAST(to_json(text) AS VARCHAR) || ',"role":"tool","tool_call_id":"' || a.call || '"}' FROM a LEFT JOIN l ON l.conv_id = a.conv_id AND l.call = a.call
"""


def oracle_sql() -> dict[str, str]:
    return {"op2_quality_rules": OP2_SQL, "op6_chat_formatting": OP6_SQL, "op10_minhash_near_dedup": OP10_SQL, "op3_substring_dedup": OP3_SQL, "op4_benchmark_decontamination": OP4_SQL}
