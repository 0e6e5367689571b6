"""Chat formatting: tool calls linked to their results, ordered, checked and serialised.

Calls and results are read from the messages' JSON, hash-joined by conversation and
call identifier, and put in topological order by rounds that place every call whose
predecessors are placed. Arguments are checked against the tools' schemas. Only
DataFrame functions are used, and nothing is gathered by conversation: a message's
place is a column of its own row, so a conversation may have any number of messages.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .store import Scratch

#: Fields of an assistant message that calls tools, and of a tool's answer.
_CALLS = "content string, tool_calls array<struct<id: string, name: string, arguments: string, after: array<string>>>"
_RESULT = "content string, tool_call_id string"
SCHEMA_DDL = "tool string, parameter string, type string, required boolean"
#: Types of a schema, and how the engine names the type of a JSON value.
TYPES = {"string": "^STRING$", "integer": "^BIGINT$", "number": "^(BIGINT|DECIMAL|DOUBLE|FLOAT)", "boolean": "^BOOLEAN$", "array": "^ARRAY", "object": "^OBJECT", "null": "^VOID$"}


def canonical(json: Column) -> Column:
    """A JSON text with sorted keys and no white space between its parts; text that is
    no JSON becomes a JSON string, null stays null."""
    parsed = F.try_parse_json(json)
    return F.when(parsed.isNotNull(), F.to_json(parsed)).otherwise(quoted(json))


def quoted(text: Column) -> Column:
    """A text as a JSON string; null stays null."""
    return F.when(text.isNotNull(), F.regexp_extract(F.to_json(F.struct(text.alias("x"))), r"(?s)^\{\"x\":(.*)\}$", 1))


def no_schemas(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], SCHEMA_DDL)


def read_calls(messages: DataFrame) -> DataFrame:
    """(conv, turn, nth, call, name, arguments, after) of every tool call; after: the
    calls it names as predecessors, in `after` or as ${id} in its arguments."""
    calls = messages.where("role = 'assistant' AND startswith(ltrim(text), '{')").select("conv", "turn", F.posexplode(F.from_json("text", _CALLS)["tool_calls"]).alias("nth", "c"))
    named = F.regexp_extract_all(F.coalesce("c.arguments", F.lit("")), F.lit(r"\$\{([^}]+)\}"), 1)
    after = F.array_distinct(F.concat(F.coalesce("c.after", F.array().cast("array<string>")), named))
    return calls.select("conv", "turn", "nth", F.col("c.id").alias("call"), F.col("c.name").alias("name"), F.coalesce("c.arguments", F.lit("{}")).alias("arguments"), F.filter(after, lambda x: x.isNotNull() & ~x.eqNullSafe(F.col("c.id"))).alias("after"))


def place_calls(calls: DataFrame, scratch: Scratch) -> DataFrame:
    """(conv, call, level, order_turn) of every call: level 0 without predecessors, else
    one more than the highest of its predecessors, -1 on or behind a cycle; order_turn:
    the highest turn of the call and all calls it waits for. Predecessors that no call
    has are ignored. A round places what waits for nothing any more and writes that and
    the links that are still open; there are as many rounds as the longest chain."""
    unique = calls.groupBy("conv", "call").agg(F.min(F.struct("turn", "nth")).alias("at"), F.min_by("after", F.struct("turn", "nth")).alias("after")).where("call IS NOT NULL")
    n = calls.count()
    unique = scratch.write(unique.select("conv", "call", F.col("at.turn").alias("turn"), "after"), "unique", n)
    wanted = unique.select("conv", "call", "turn", F.explode("after").alias("before"))
    links = wanted.join(unique.select("conv", F.col("call").alias("before")), ["conv", "before"])
    none = F.lit(None).cast("long")
    waiting = scratch.write(links.select("conv", "call", "before", F.lit(0).alias("level"), "turn"), "waiting-0")
    n_links = waiting.count()
    first = unique.join(waiting.select("conv", "call").distinct(), ["conv", "call"], "left_anti").select("conv", "call", F.lit(0).alias("level"), F.col("turn").alias("order_turn"))
    ready = scratch.write(first, "ready-0", n)
    placed, turn = ready, 0
    while not waiting.isEmpty() and not ready.isEmpty():
        turn += 1
        done = ready.select("conv", F.col("call").alias("before"), (F.col("level") + 1).alias("above"), "order_turn")
        met = waiting.join(done, ["conv", "before"], "left")
        # A link whose predecessor is placed only says how high the call is by now.
        known = F.col("above").isNotNull() | F.col("before").isNull()
        met = met.select("conv", "call", F.when(~known, F.col("before")).alias("before"), F.greatest("level", "above").alias("level"), F.greatest("turn", "order_turn").alias("turn"))
        met = scratch.write(met.groupBy("conv", "call", "before").agg(F.max("level").alias("level"), F.max("turn").alias("turn")), f"met-{turn}", n_links)
        whole = met.groupBy("conv", "call").agg(F.max("level").alias("level"), F.max("turn").alias("order_turn"), F.count("before").alias("missing")).where("missing = 0")
        ready = scratch.write(whole.drop("missing"), f"ready-{turn}", n)
        waiting = scratch.write(met.join(ready.select("conv", "call"), ["conv", "call"], "left_anti"), f"waiting-{turn}", n_links)
        scratch.drop(f"met-{turn}", f"waiting-{turn - 1}")
        placed = placed.unionByName(ready)
    cyclic = waiting.select("conv", "call", F.lit(-1).alias("level"), none.alias("order_turn")).distinct()
    return placed.unionByName(cyclic)


def check_arguments(calls: DataFrame, schemas: DataFrame) -> DataFrame:
    """calls with problems: an array of texts, empty where the arguments fit."""
    kind = F.create_map(*[F.lit(x) for pair in TYPES.items() for x in pair])
    rule = F.struct("parameter", F.get(F.array(F.element_at(kind, F.lower("type"))), F.lit(0)).alias("pattern"), F.coalesce("required", F.lit(False)).alias("required"))
    tools = schemas.where("tool IS NOT NULL").groupBy(F.col("tool").alias("name")).agg(F.sort_array(F.collect_set(rule)).alias("rules"))
    known = calls.join(tools, "name", "left")
    given = F.from_json("arguments", "map<string, variant>")

    def problem(r: Column) -> Column:
        value = F.element_at(F.col("given"), r["parameter"])
        missing = F.when(r["required"] & value.isNull(), F.concat(F.lit("missing "), r["parameter"]))
        wrong = F.when(value.isNotNull() & ~F.regexp_like(F.schema_of_variant(value), r["pattern"]), F.concat(F.lit("type of "), r["parameter"]))
        return F.coalesce(missing, wrong)

    checked = known.withColumn("given", F.when(F.try_parse_json("arguments").isNotNull(), given))
    by_rule = F.filter(F.transform("rules", problem), lambda x: x.isNotNull())
    names = F.transform("rules", lambda r: r["parameter"])
    extra = F.transform(F.sort_array(F.array_except(F.map_keys("given"), names)), lambda k: F.concat(F.lit("unknown "), k))
    problems = F.when(F.col("given").isNull(), F.array(F.lit("arguments are no object"))).when(F.col("rules").isNull(), F.array(F.lit("unknown tool"))).otherwise(F.concat(by_rule, extra))
    return checked.withColumn("problems", problems).drop("given", "rules")


def format_chats(messages: DataFrame, schemas: DataFrame | None = None, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """Every message as canonical JSON, with its place in the topological order.

    A message of role assistant whose text is a JSON object may hold tool_calls (id,
    name, arguments, and after: identifiers of calls to come before); one of role tool
    whose text is a JSON object answers the call of tool_call_id. schemas: (tool,
    parameter, type, required); without it arguments are only checked to be an object.

    Returns one row per message and, for a message that calls tools, one further row
    per call: conv_col, turn_col, kind (message, call or result), call_id, order_turn,
    level, status and json. Rows are in topological order by (order_turn, level,
    turn_col, call_id): a result stands behind its call, and a call behind those it waits
    for, even where its turn is earlier.
    status: ok; for calls invalid, unanswered, cyclic or repeated (only the first call
    of an identifier is linked); for results orphan, or repeated where another answers
    the same call earlier. A null text is empty; a null role is ''; null conversations
    and turns are carried, and link with nothing; an empty table gives an empty table;
    further columns play no part and are not returned.
    """
    spark, scratch = messages.sparkSession, Scratch(messages.sparkSession, "chats")
    named = messages.select(messages[conv_col].cast("long").alias("conv"), messages[turn_col].cast("long").alias("turn"), F.coalesce(messages[role_col].cast("string"), F.lit("")).alias("role"), F.coalesce(messages[text_col].cast("string"), F.lit("")).alias("text"))
    calls = scratch.write(read_calls(named), "calls")
    rules = schemas if schemas is not None else no_schemas(spark)
    checked = check_arguments(calls, rules.select(rules["tool"], rules["parameter"], rules["type"], rules["required"]))
    if schemas is None:
        checked = checked.withColumn("problems", F.filter("problems", lambda x: x == "arguments are no object"))
    levels = place_calls(calls, scratch)
    answer = F.when((F.col("role") == "tool") & F.startswith(F.ltrim("text"), F.lit("{")), F.from_json("text", _RESULT))
    results = named.select("conv", "turn", "role", "text", answer["tool_call_id"].alias("call"), answer["content"].alias("answer"))

    heads = calls.where("call IS NOT NULL").groupBy("conv", "call").agg(F.min(F.struct("turn", "nth")).alias("first"))
    answered = results.where("call IS NOT NULL").groupBy("conv", "call").agg(F.min("turn").alias("answer_turn"))
    linked = scratch.write(heads.join(levels, ["conv", "call"]).join(answered, ["conv", "call"], "left"), "linked", calls.count())

    of_call = checked.join(linked.hint("shuffle_hash"), ["conv", "call"], "left")
    call_status = (
        F.when(F.col("first").isNotNull() & (F.col("first") != F.struct("turn", "nth")), "repeated")
        .when(F.size("problems") > 0, "invalid")
        .when(F.col("level") < 0, "cyclic")
        .when(F.col("answer_turn").isNull(), "unanswered")
        .otherwise("ok")
    )
    parts = F.concat(F.lit('{"arguments":'), canonical(F.col("arguments")), F.lit(',"id":'), F.coalesce(quoted(F.col("call")), F.lit("null")), F.lit(',"name":'), F.coalesce(quoted(F.col("name")), F.lit("null")), F.lit(',"problems":'), F.to_json("problems"), F.lit("}"))
    call_rows = of_call.select("conv", "turn", F.lit("call").alias("kind"), F.col("call").alias("call_id"), F.coalesce(F.greatest("turn", "order_turn"), F.col("turn")).alias("order_turn"), (F.greatest(F.coalesce("level", F.lit(0)), F.lit(0)) * 2 + 1).alias("level"), call_status.alias("status"), parts.alias("json"))

    answers = results.where("call IS NOT NULL").join(linked.hint("shuffle_hash"), ["conv", "call"], "left")
    called = F.greatest("order_turn", F.col("first.turn"))
    late = F.greatest("turn", called)
    result_status = F.when(F.col("first").isNull(), "orphan").when(F.col("turn") != F.col("answer_turn"), "repeated").otherwise("ok")
    answer_json = F.concat(F.lit('{"content":'), F.coalesce(quoted(F.col("answer")), F.lit("null")), F.lit(',"role":"tool","tool_call_id":'), quoted(F.col("call")), F.lit("}"))
    level = F.when(called >= F.col("turn"), F.greatest("level", F.lit(0)) * 2 + 2).otherwise(F.lit(0))
    result_rows = answers.select("conv", "turn", F.lit("result").alias("kind"), F.col("call").alias("call_id"), F.coalesce(late, F.col("turn")).alias("order_turn"), level.alias("level"), result_status.alias("status"), answer_json.alias("json"))

    plain = results.where("call IS NULL").select("conv", "turn", "role", "text", F.when((F.col("role") == "assistant") & F.startswith(F.ltrim("text"), F.lit("{")), F.from_json("text", _CALLS)).alias("spoken"))
    said = F.when(F.size("spoken.tool_calls") > 0, F.coalesce("spoken.content", F.lit(""))).otherwise(F.col("text"))
    message_json = F.concat(F.lit('{"content":'), quoted(said), F.lit(',"role":'), quoted(F.col("role")), F.lit("}"))
    message_rows = plain.select("conv", "turn", F.lit("message").alias("kind"), F.lit(None).cast("string").alias("call_id"), F.col("turn").alias("order_turn"), F.lit(0).alias("level"), F.lit("ok").alias("status"), message_json.alias("json"))
    return message_rows.unionByName(call_rows).unionByName(result_rows).withColumnsRenamed({"conv": conv_col, "turn": turn_col})
