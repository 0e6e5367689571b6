import re
import time
from collections import Counter

from pyspark.sql import functions as F

from . import messy
from loomsearch.llm.op2_quality_rules import line_quality
from loomsearch.llm.op8_secret_scan import labelled_findings, redact, scan, train_forest

PROSE = "The quick brown fox went over the hill and saw a house there, which was empty."


def test_base_figures_match_brute_force(spark):
    got = Counter((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in line_quality(messy.table(spark)).select("doc.doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed").collect())
    want = Counter()
    for i, t in messy.rows():
        w, t = messy.words(t), t or ""
        grams = Counter(zip(w, w[1:], w[2:]))
        repeated = {k + j for k in range(len(w) - 2) for j in range(3) if grams[tuple(w[k : k + 3])] > 1}
        lines = [x for x in t.split("\n") if messy.words(x)]
        want[(i, len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(repeated), len(w) < 50 or 100 * len(repeated) > 50 * len(w))] += 1
    assert got == want


def judged(spark, text):
    return line_quality(spark.createDataFrame([(1, text)], "doc_id long, text string")).first()


def test_lines_that_fail_go_and_clean_ones_stay(spark):
    clean = [" ".join(f"{w}{i}" for w in PROSE[:-1].split()) + "." for i in range(6)] + ["Very short."]
    r = judged(spark, "\n".join(clean))
    assert r.kept and r.clean_text == "\n".join(clean) and r.n_lost_words == 0
    noisy = [clean[0], "Home | About | Contact", "All rights reserved.", *clean[1:], "BUY NOW!! CHEAP!! OFFER!!", "Read more"]
    r = judged(spark, "\n".join(noisy))
    assert r.kept and r.clean_text == "\n".join(clean) and r.n_lost_words == 14
    assert not judged(spark, "\n".join(["a1 | b2 | c3 | d4 | e5 | f6"] * 1 + [f"w{i} | x{i} | y{i} | z{i} | q{i} | r{i}" for i in range(30)] + [PROSE])).kept
    assert not judged(spark, PROSE).kept and judged(spark, PROSE).base_failed


def test_long_unbroken_words_take_linear_time(spark):
    long = "a | b " + "x" * 1_000_000 + " " + "#" * 1_000_000 + " " + "y" * 1_000_000 + "% end"
    begin = time.time()
    r = judged(spark, "\n".join([long, *(" ".join(f"{w}{i}" for w in PROSE[:-1].split()) + "." for i in range(6))]))
    # Of seven words, three hold symbols.
    assert r.n_lost_words == 7 and r.kept and time.time() - begin < 30


def test_empty_tables(spark):
    assert line_quality(messy.empty(spark)).count() == 0
    forest = train_forest(labelled_findings(spark))
    assert scan(messy.empty(spark), forest=forest).count() == 0
    assert scan(messy.table(spark), forest=forest).count() == len(messy.rows())


def test_forest_tells_secrets_from_other_long_words(spark):
    key = "9f86d081884c7d659a2feaa0c55ad015a3bf4f1b"
    mixed = "Qm9va3NBbmRNb3Jl2Zx81kLw0PqRt7"
    texts = {
        1: f'set token = "{key}"### and go',
        2: f"see commit {key} for more",
        3: "card 4485275742308327 was used",
        4: "in /usr/lib/python3/site/packages/module9",
        5: f"api_key: {mixed}, then",
        6: 'password = "your_password_here_123"',
        7: f"Authorization: Bearer {mixed} sent",
        8: "nothing here", 9: None, 10: "",
        11: f"the id 123e4567-e89b-12d3-a456-426614174000 of a row",
        12: f'token = "{key}" and again token = "{key}" 4485275742308327',
    }
    docs = spark.createDataFrame([(i, t, 0.5, "x") for i, t in texts.items()], "doc_id long, text string, score double, findings string")
    found = scan(docs)
    rows = {r.doc_id: r for r in found.select("doc.doc_id", "findings", redact(F.col("doc.text"), F.col("findings")).alias("safe")).collect()}
    assert {i for i, r in rows.items() if any(f.is_secret for f in r.findings)} == {1, 5, 7, 12}
    assert rows[1].safe == 'set token = "[SECRET]"### and go' and rows[2].safe == texts[2] and key not in rows[12].safe and "4485275742308327" in rows[12].safe
    assert rows[9].safe is None and rows[10].safe == "" and [f.value for f in rows[1].findings] == [key]
    assert [f.word for f in rows[12].findings] == [2, 7, 8]


def test_forest_is_accurate_on_findings_it_has_not_seen(spark):
    findings = labelled_findings(spark).withColumn("held", F.pmod(F.xxhash64("value"), F.lit(4)) == 0)
    forest = train_forest(findings.where("NOT held"))
    held = findings.where("held").select("label", F.concat_ws(" ", "before", F.concat("value", F.lit(" ")), "after").alias("text"))
    got = scan(held, forest=forest).select("doc.label", F.exists("findings", lambda f: f["is_secret"]).alias("secret"))
    wrong = got.where("CAST(label AS BOOLEAN) <> secret").count()
    assert wrong / got.count() < 0.15, wrong / got.count()


def verdicts(spark, texts):
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = scan(docs).select("doc.doc_id", "findings", redact(F.col("doc.text"), F.col("findings")).alias("safe")).collect()
    return [({f.value: f.is_secret for f in r.findings}, r.safe) for r in sorted(found, key=lambda r: r.doc_id)]


def test_each_candidate_of_a_word_has_its_own_name(spark):
    key, digest = "9f86d081884c7d659a2feaa0c55ad015a3bf4f1b", "1b4f0e9851971998e732078544c96b36c3d01ced"
    url, pair, query, named = verdicts(spark, [f"see https://example.com/api/v2/export?token={key} there", f'{{"token":"{key}","sha256":"{digest}"}}', "id=1234567890abcdef12,password=hunter2x", f'{{"oauth2_client_access_token":"{key}"}}'])
    assert url[0][key] and url[1] == "see https://example.com/api/v2/export?token=[SECRET] there"
    assert pair[0] == {key: True, digest: False}
    assert set(query[0]) == {"1234567890abcdef12", "hunter2x"}
    assert named[0][key]


def test_assigned_values_run_to_white_space_or_a_quote(spark):
    mixed, tail, query, holder = verdicts(spark, ["password=P@ss#word2024 end", "password=longvalue1#tail end", "?token=abcdefgh12&user=someone", "password=******** token=<your-token> secret=%(secret)s"])
    assert set(mixed[0]) == {"P@ss#word2024"} and set(tail[0]) == {"longvalue1#tail"} and set(query[0]) == {"abcdefgh12"}
    assert not any(holder[0].values()), holder


def test_a_run_counts_wherever_its_digit_stands(spark):
    late = "AbCdEfGhIjKlMnOpQrStUvWxYzAbCdEfGhIjKlMnOpQrStUvWxYzAbCdEfGhIjKlMnOpQrStUvWxYz7Qp2"
    found, plain = verdicts(spark, [f"the {late} here", f"the {late[:76]} here"])
    assert set(found[0]) == {late} and not plain[0]


def test_precision_and_recall_on_documents(spark):
    """Secrets of the corpus are told by a pattern that the operator does not know: all
    documents are held out, as the forest has seen none of them."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").where("text IS NOT NULL")
    found = scan(docs).select("doc.doc_id", "doc.text", "findings").collect()
    planted = {(r.doc_id, v) for r in found for v in re.findall(r'(?i)token = "([0-9a-f]{40})"', r.text)}
    called = {(r.doc_id, f.value) for r in found for f in r.findings if f.is_secret}
    others = {(r.doc_id, v) for r in found for v in re.findall(r"(?<![0-9A-Za-z])[0-9]{16}(?![0-9A-Za-z])", r.text)}
    assert len(planted) >= 10 and len(others) >= 20
    assert len(planted & called) / len(planted) >= 0.95
    assert len(planted & called) / len(called) >= 0.95 and not others & called
