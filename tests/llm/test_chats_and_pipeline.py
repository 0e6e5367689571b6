import json
import re
from collections import Counter

from . import messy
from . import test_decontamination as contamination
from . import test_packing as packing
from loomsearch.llm.op2_quality_rules import BOILERPLATE
from loomsearch.llm.op6_chat_formatting import SCHEMA_DDL, format_chats
from loomsearch.llm.op9_best_fit_packing import pack_documents
import corpus_pipeline as pipeline


def chats(spark):
    c = lambda **k: json.dumps(k)
    call = lambda i, name="f", after=None, **arguments: {"id": i, "name": name, "arguments": arguments, **({"after": after} if after else {})}
    rows = [
        (1, 0, "user", 'say "hi"\n\t/é '), (1, 1, "assistant", c(content="ok", tool_calls=[call("b", y="${a}", x=1.5), call("a", x="no"), call("z", name="g", x=1)])),
        (1, 2, "tool", c(tool_call_id="a", content="ra")), (1, 3, "tool", c(tool_call_id="q", content="o")), (1, 0, "tool", c(tool_call_id="b", content="early")), (1, 4, "tool", c(tool_call_id="b", content="twice")),
        (2, 0, "assistant", c(tool_calls=[call("p", after=["r"], x=2), call("r", after=["p"], x=2), call("s", after=["p"], x=2)])), (2, 5, "assistant", c(tool_calls=[call("t", x=1, k=2)])), (2, 6, "assistant", c(tool_calls=[call("t", x=1)])), (2, 7, "tool", c(tool_call_id="t", content=None)),
        (None, None, None, None), (3, 1, "assistant", "{not json"), (3, 2, "assistant", '{"content": "plain"}'), (3, 2, "assistant", '{"content": "plain"}'), (3, 3, "tool", "free text"), (3, 4, "user", "x" * 100_000), (3, 5, "user", ""),
    ]
    messages = spark.createDataFrame([(*r, "k", 1) for r in rows], "conv_id long, turn long, role string, text string, call string, level int").repartition(3)
    return messages, spark.createDataFrame([("f", "x", "number", True), ("f", "y", "string", False)], SCHEMA_DDL)


def test_calls_are_linked_ordered_and_checked(spark):
    rows = format_chats(*chats(spark)).collect()
    status = {(r.conv_id, r.turn, r.kind, r.call_id): r.status for r in rows}
    assert {k[1:]: v for k, v in status.items() if k[0] == 1 and k[2] != "message"} == {
        (1, "call", "a"): "invalid", (1, "call", "b"): "ok", (1, "call", "z"): "invalid", (2, "result", "a"): "ok", (3, "result", "q"): "orphan", (0, "result", "b"): "ok", (4, "result", "b"): "repeated",
    }
    assert {k[1:]: v for k, v in status.items() if k[0] == 2 and k[2] != "message"} == {
        (0, "call", "p"): "cyclic", (0, "call", "r"): "cyclic", (0, "call", "s"): "cyclic", (5, "call", "t"): "invalid", (6, "call", "t"): "repeated", (7, "result", "t"): "ok",
    }
    order = [(r.kind, r.call_id) for r in sorted((r for r in rows if r.conv_id == 1), key=lambda r: (r.order_turn, r.level, r.turn, r.call_id or ""))]
    place = {x: i for i, x in enumerate(order)}
    assert place[("call", "a")] < place[("call", "b")] < place[("result", "b")]
    for r in rows:
        value = json.loads(r.json)
        assert list(value) == sorted(value)
    own = next(r.json for r in rows if r.call_id == "b" and r.kind == "call")
    assert own == '{"arguments":{"x":1.5,"y":"${a}"},"id":"b","name":"f","problems":[]}'
    assert sum(r.kind == "message" for r in rows) == 1 + 1 + 3 + 7
    assert json.loads(next(r.json for r in rows if r.conv_id == 1 and r.turn == 0 and r.kind == "message"))["content"] == 'say "hi"\n\t/é '


def test_chains_place_calls_behind_those_they_wait_for(spark):
    call = lambda i, *after: json.dumps({"tool_calls": [{"id": i, "name": "f", "arguments": {}, "after": list(after)}]})
    # A call of turn 1 waits for one of turn 30, and the end of a chain for all before.
    rows = [(1, 1, "assistant", call("early", "late")), (1, 30, "assistant", call("late")), (1, 2, "tool", json.dumps({"tool_call_id": "early", "content": "x"}))]
    rows += [(2, t, "assistant", call(f"c{t}", f"c{t - 1}", f"c{t // 2}", "gone")) for t in range(1, 13)] + [(None, 1, "assistant", call("c1", "c0"))]
    got = format_chats(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).where("kind != 'message'").collect()
    place = {(r.conv_id, r.call_id, r.kind): (r.order_turn, r.level) for r in got}
    assert place[(1, "late", "call")] < place[(1, "early", "call")] < place[(1, "early", "result")] and place[(1, "early", "call")][0] == 30
    assert [place[(2, f"c{t}", "call")] for t in range(1, 13)] == [(t, 2 * t - 1) for t in range(1, 13)]


def test_no_schemas_and_empty_tables(spark):
    messages, _ = chats(spark)
    assert {r.status for r in format_chats(messages).where("kind = 'call'").collect()} == {"ok", "unanswered", "cyclic", "repeated"}
    assert format_chats(messages.limit(0)).count() == 0


def documents(spark):
    clean = [" ".join(f"{w}{i}" if k % 9 == 0 else w for k, w in enumerate(messy.sentence(__import__("random").Random(i), 80).split())) + "." for i in range(12)]
    data = [(i, t) for i, t in enumerate(clean)]
    data += [(20, clean[0]), (21, clean[1].replace(" ", "  ", 1)), (22, None), (23, ""), (24, "a | b | c\n" * 40)]
    data += [(25, clean[2] + "\nHome | About | News"), (26, clean[3][:-1] + ' token = "9f86d081884c7d659a2feaa0c55ad015a3bf4f1b" end.'), (27, messy.sentence(__import__("random").Random(77), 60) + ".")]
    return spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in data], "doc_id long, text string, lang string, source string, n_chars long"), clean


def test_each_stage_on_its_own_input(spark, tmp_path):
    docs, clean = documents(spark)
    stage = dict(pipeline.STAGES)
    assert list(stage) == ["quality_rules", "near_dedup", "decontamination", "secret_scan", "best_fit_packing"]
    good = {r.doc_id: r for r in stage["quality_rules"](spark, docs, str(tmp_path)).collect()}
    assert set(good) == {*range(12), 20, 21, 25, 26, 27} and good[25].text == clean[2] and good[25].n_chars == len(clean[2])
    kept = stage["near_dedup"](spark, spark.createDataFrame(list(good.values()), docs.schema), str(tmp_path))
    truth = messy.classes([(i, r.text) for i, r in good.items()], 80)
    assert {r.doc_id for r in kept.collect()} == {i for i, c in truth.items() if i == c} == {*range(12), 27} | ({26} if truth[26] == 26 else set())
    spark.createDataFrame([(1, " ".join(clean[5].split()[10:25])), (2, None)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    left = stage["decontamination"](spark, docs, str(tmp_path)).collect()
    assert len(left) == docs.count() - 1 and 5 not in {r.doc_id for r in left}
    safe = {r.doc_id: r.text for r in stage["secret_scan"](spark, docs, str(tmp_path)).collect()}
    assert len(safe) == docs.count() and "9f86d081" not in safe[26] and "[SECRET]" in safe[26] and safe[0] == clean[0]
    assert stage["best_fit_packing"](spark, docs, str(tmp_path)).count() == pack_documents(docs).count()
    for name in list(stage)[:-1]:
        assert stage[name](spark, docs, str(tmp_path)).columns == docs.columns
        assert stage[name](spark, docs.limit(0), str(tmp_path)).count() == 0


def kept_text(text):
    """The text that the quality rules leave, or None."""
    text = text or ""
    words = messy.words(text)
    grams = Counter(zip(words, words[1:], words[2:]))
    repeated = {k + j for k in range(len(words) - 2) for j in range(3) if grams[tuple(words[k : k + 3])] > 1}
    if len(words) < 50 or 100 * len(repeated) > 50 * len(words):
        return None
    left, lost = [], 0
    for line in text.split("\n"):
        own, bare = messy.words(line), line.strip(" \t\n\x0b\f\r")
        if not own:
            continue
        fragment = len(own) < 8 and bare.rstrip("\"'”»)]")[-1:] not in (".", "!", "?", "…", ":", ";", "。", "！", "？")
        shouting = "!!" in bare and bare.upper() == bare
        navigation = sum(any(c in "#*$%&|<>{}" for c in w) for w in own) > 0.2 * len(own)
        if fragment or shouting or navigation or any(x in line.lower() for x in BOILERPLATE):
            lost += len(own)
        else:
            left.append(line)
    return "\n".join(left) if lost <= 0.5 * len(words) else None


def test_whole_run_matches_brute_force(spark, sf_dir):
    docs = [(r.doc_id, kept_text(r.text)) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").orderBy("doc_id").collect()]
    docs = [(i, t) for i, t in docs if t is not None]
    first = messy.classes(docs, 80)
    docs = [(i, t) for i, t in docs if first[i] == i]
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    grams = {tuple(w[k : k + 10]) for _, t in items for w in [contamination.words(t)] for k in range(max(len(w) - 9, 1))}
    assert all(len(g) == 10 for g in grams)
    clean = [(i, t) for i, t in docs for w in [contamination.words(t)] if not any(tuple(w[k : k + 10]) in grams for k in range(len(w) - 9))]
    assert len(clean) < len(docs)
    safe = [(i, re.sub('(token = ")[0-9a-f]{40}(?=")', r"\1[SECRET]", t)) for i, t in clean]
    got = pipeline.run(spark, sf_dir).collect()
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got) == packing.expected(safe, 2048)
