"""Secrets in texts: candidates by pattern, false positives removed by a random forest.

Candidates are long runs of key characters that hold a digit, and values assigned to a
name such as token or password. A forest of decision trees on the candidate's length,
character transitions, dictionary coverage, path and neighbouring words tells
secrets from digests, identifiers, paths and placeholders. It is trained in this
module from labelled findings and turned into one column expression, so scanning a
corpus is a single pass of built-in functions without a shuffle.
"""

from __future__ import annotations

import re

from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.partitions import spread
from .op2_quality_rules import settled, split_words

#: A run of 16 key characters or more, one of them a digit.
RUN = r"(?<![A-Za-z0-9+/_\-])(?=[A-Za-z+/_\-]*+[0-9])[A-Za-z0-9+/_\-]{16,}={0,2}"
#: A value of 8 characters or more, assigned to a telling name within one word or in
#: the words before. It ends at white space, a quote or the next name of a query string.
NAME = r"(?:token|secret|passwd|password|api[_\-]?key|credential)[\"']?"
VALUE = r"(?=[^\s\"']{8})(?:[^\s\"'&]|&(?![\w.\-]{1,40}=))[^\s\"'&]*+(?:&(?![\w.\-]{1,40}=)[^\s\"'&]*+)*+"
ASSIGNED = rf"(?i){NAME}\s*[:=]\s*[\"']?{VALUE}"
#: The next candidate of a line, behind the text since the one before it. Words are
#: joined by one blank, so a name stands at most so far away from its value.
NEXT = rf"(?s)\G(.*?)((?<=(?i:{NAME})\s?[:=]\s?[\"']?){VALUE}|{RUN})"
NEXT_RUN = rf"(?s)\G(.*?)({RUN})"
#: A name, and perhaps its sign, at the end of the words before.
LEAD = rf"(?i)({NAME}(?:\s?[:=]\s?[\"']?)?)$"
#: What stands between a name and its value.
LINK = r"^[\"']?\s?[:=]?\s?[\"']?$"
#: What a text with such an assignment holds in lower case.
NAMES = ("token", "secret", "passw", "key", "credential")
TELLING = r"(?i)(token|secret|passw|api[_\-]?key|credential|bearer|auth|private|access)"
HARMLESS = r"(?i)(commit|sha1|sha256|md5|digest|checksum|hash|etag|uuid|guid|revision|version|build|order|invoice|card|phone|isbn|example|sample|dummy|page|figure)"
#: Places in a path where there are samples rather than keys, and where keys are kept.
SAMPLE_PATH = r"(?i)(^|[/_.\-])(tests?|specs?|fixtures?|mocks?|examples?|samples?|docs?|vendor|locale)([/_.\-]|$)"
KEPT_PATH = r"(?i)(\.env|\.pem|\.key|\.ini|\.ya?ml|\.properties|\.tfvars)$|(^|[/_.\-])(config|deploy|secrets?|settings|credentials?)([/_.\-]|$)"
#: Words that make up names, placeholders and paths rather than keys.
DICTIONARY = (
    "access", "account", "admin", "allow", "api", "app", "auth", "backup", "bin", "build", "cache", "change", "check", "class", "client", "code", "common",
    "config", "content", "core", "count", "create", "data", "date", "debug", "default", "demo", "dist", "doc", "dummy", "email", "enable", "error", "example",
    "file", "filter", "fixture", "format", "global", "group", "handler", "header", "here", "home", "host", "html", "http", "image", "import", "include", "index",
    "info", "input", "insert", "item", "json", "key", "lib", "license", "linux", "list", "local", "log", "login", "main", "manager", "map", "media", "message",
    "method", "model", "module", "my", "name", "network", "node", "number", "object", "option", "order", "output", "package", "page", "param", "password", "path",
    "placeholder", "post", "print", "private", "process", "project", "public", "query", "random", "record", "report", "request", "response", "result", "return",
    "root", "sample", "script", "secret", "select", "server", "service", "session", "set", "share", "size", "source", "start", "state", "status", "string",
    "style", "system", "table", "task", "temp", "template", "test", "text", "time", "title", "token", "type", "update", "upload", "url", "user", "usr", "value",
    "var", "version", "video", "view", "web", "work", "xml", "your",
)
FEATURES = ("n_chars", "letter_digit", "case_change", "digit_share", "letter_kinds", "digit_kinds", "hex_only", "digits_only", "covered", "path_marks", "dashes", "repeats", "told", "harmless", "assigned", "sample_path", "kept_path")
#: Labelled findings that the forest is trained on, and its size.
FINDINGS, TREES, DEPTH, SEED = 6000, 15, 7, 8


def features(value: Column, before: Column, after: Column, path: Column) -> dict[str, Column]:
    """The forest's features of a candidate, the words beside it and the path of its
    file, '' where none is known."""
    n = F.length(value)
    low = F.lower(value)
    letters = F.regexp_replace(low, "[^a-z]", "")
    beside = F.concat_ws(" ", before, after)

    def matches(pattern: str) -> Column:
        return F.regexp_count(value, F.lit(pattern)).cast("double")

    def kinds(of: Column) -> Column:
        return F.size(F.array_distinct(F.split(of, ""))).cast("double")

    words = "|".join(sorted(DICTIONARY, key=lambda w: (-len(w), w)))
    rest = F.length(F.regexp_replace(letters, words, ""))
    return {
        "n_chars": n.cast("double"),
        "letter_digit": matches("(?<=[A-Za-z])[0-9]|(?<=[0-9])[A-Za-z]") / n,
        "case_change": matches("(?<=[a-z])[A-Z]|(?<=[A-Z])[a-z]") / n,
        "digit_share": matches("[0-9]") / n,
        "letter_kinds": kinds(letters),
        "digit_kinds": kinds(F.regexp_replace(value, "[^0-9]", "")),
        "hex_only": value.rlike("^[0-9a-fA-F]+$").cast("double"),
        "digits_only": value.rlike("^[0-9]+$").cast("double"),
        "covered": F.coalesce((F.length(letters) - rest) / F.nullif(F.length(letters), F.lit(0)), F.lit(0.0)),
        "path_marks": matches("/[A-Za-z]+/|\\.[a-z]{2,4}$|_[a-z]+_"),
        "dashes": matches("-"),
        "repeats": matches(r"(.)\1\1"),
        "told": F.regexp_like(F.coalesce(before, F.lit("")), F.lit(TELLING)).cast("double"),
        "harmless": F.regexp_like(beside, F.lit(HARMLESS)).cast("double"),
        "assigned": F.regexp_like(F.coalesce(before, F.lit("")), F.lit(r"[:=]\s*[\"']?$")).cast("double"),
        "sample_path": F.regexp_like(path, F.lit(SAMPLE_PATH)).cast("double"),
        "kept_path": F.regexp_like(path, F.lit(KEPT_PATH)).cast("double"),
    }


def labelled_findings(spark: SparkSession) -> DataFrame:
    """FINDINGS findings (value, before, after, path, label) made by rule: keys of several
    forms where keys stand, and digests, identifiers, paths, names and placeholders
    where those stand. Every value is a function of its row number."""
    i = F.col("id")
    digest = F.sha2(F.concat(F.lit("finding-"), i.cast("string")), 512)
    b64 = F.regexp_replace(F.base64(F.unhex(digest)), r"[\s=]", "")

    def pick(salt: int, *texts: str) -> Column:
        return F.element_at(F.array(*map(F.lit, texts)), (F.pmod(F.xxhash64(i, F.lit(salt)), F.lit(len(texts))) + 1).cast("int"))

    def words(salt: int, joint: str, n: int) -> Column:
        return F.concat_ws(joint, *[pick(salt + k, *DICTIONARY) for k in range(n)])

    tail = F.pmod(F.xxhash64(i, F.lit(1)), F.lit(9000)).cast("string")
    key_name = pick(2, "token", "secret", "api_key", "password", "access_key", "auth_token", "client_secret", "credential")
    sign = pick(3, " = \"", "=\"", ": \"", "=", ": ", " = ")
    told = F.concat(pick(4, "the ", "of ", "", "set ", "in "), key_name, sign)
    prose = pick(5, "the and of", "see the", "in that", "from it", "la de", "und der", "with a")
    size = F.element_at(F.array(F.lit(20), F.lit(32), F.lit(40), F.lit(40), F.lit(64)), (F.pmod(F.xxhash64(i, F.lit(6)), F.lit(5)) + 1).cast("int"))
    hexed = F.substr(digest, F.lit(1), size)
    mixed = F.substr(b64, F.lit(1), size)
    plain = pick(7, "commit ", "sha256: ", "md5 = ", "checksum ", "etag=\"", "revision ", "digest: ", "build ")
    forms = [
        (hexed, told, 1), (mixed, told, 1),
        (F.concat(pick(8, "ghp_", "sk-", "AKIA", "xoxb-", "pk_live_", "glpat-"), F.substr(b64, F.lit(3), F.lit(28))), F.when(F.pmod(i, F.lit(2)) == 0, told).otherwise(prose), 1),
        (mixed, F.concat(prose, F.lit(" Authorization: Bearer ")), 1),
        (hexed, plain, 0), (mixed, plain, 0),
        (F.concat_ws("-", F.substr(digest, F.lit(1), F.lit(8)), F.substr(digest, F.lit(9), F.lit(4)), F.substr(digest, F.lit(13), F.lit(4)), F.substr(digest, F.lit(17), F.lit(12))), pick(9, "id ", "uuid=", "guid: ", "the "), 0),
        (F.regexp_replace(F.substr(digest, F.lit(1), F.lit(16)), "[a-f]", "4"), prose, 0),
        (F.concat(words(20, "_", 3), F.lit("_"), tail), F.when(F.pmod(i, F.lit(3)) == 0, told).otherwise(prose), 0),
        (F.concat(F.lit("/"), words(30, "/", 4), tail), prose, 0),
        (F.concat(words(40, "-", 3), tail), prose, 0),
        (F.concat(F.repeat(pick(10, "x", "X", "0", "1", "A"), 18), tail), told, 0),
        (F.concat(pick(11, "your-", "example_", "my_", "test-"), words(50, "_", 2), F.lit("123")), told, 0),
        (F.concat(words(60, "", 3), tail), prose, 0),
    ]
    # Most texts have no path, and a path alone decides nothing.
    paths = {
        1: ("", "", "", "src/client.py", "config/app.yml", "deploy/.env", "lib/net/session.js", "tests/test_login.py"),
        0: ("", "", "", "src/client.py", "tests/fixtures/answers.json", "docs/example.md", "lib/net/session.js", "config/app.yml"),
    }
    form = F.pmod(F.xxhash64(i, F.lit(12)), F.lit(len(forms)))
    row = F.lit(None)
    for k, (value, before, label) in enumerate(forms):
        this = F.struct(value.alias("value"), before.alias("before"), pick(13, "and the", "of", "\" in", "").alias("after"), pick(14, *paths[label]).alias("path"), F.lit(label).cast("double").alias("label"))
        row = F.when(form == k, this).otherwise(row)
    return spark.range(FINDINGS).select(row.alias("x")).select("x.*")


def _as_column(dump: str, inputs: list[Column]) -> list[Column]:
    """The trees of a forest's printed form, each as a column of its vote."""
    lines = [x.strip() for x in dump.splitlines()]
    trees, at = [], 0

    def node() -> Column:
        nonlocal at
        line = lines[at]
        at += 1
        if found := re.fullmatch(r"Predict: ([\d.]+)", line):
            return F.lit(float(found[1]))
        found = re.fullmatch(r"If \(feature (\d+) <= ([-\d.E]+)\)", line)
        if not found:
            raise ValueError(f"not a node of a tree: {line}")
        low = node()
        at += 1  # Else
        return F.when(inputs[int(found[1])] <= float(found[2]), low).otherwise(node())

    while at < len(lines):
        at += 1
        if lines[at - 1].startswith("Tree "):
            trees.append(node())
    return trees


def train_forest(findings: DataFrame) -> str:
    """The printed form of a random forest trained on labelled findings (value,
    before, after, path, label)."""
    wide = findings.select("label", *[c.alias(k) for k, c in features(F.col("value"), F.col("before"), F.col("after"), F.col("path")).items()])
    rows = VectorAssembler(inputCols=list(FEATURES), outputCol="features").transform(wide).select("label", "features")
    forest = RandomForestClassifier(numTrees=TREES, maxDepth=DEPTH, seed=SEED, featureSubsetStrategy="onethird").fit(rows.repartition(2))
    return forest.toDebugString


def scan(docs: DataFrame, text_col: str = "text", forest: str | None = None, path_col: str | None = None) -> DataFrame:
    """Candidates of every document with the forest's verdict.

    forest: the printed form of a trained forest; without it one is trained on
    labelled_findings(). path_col: the column with the path of a document's file; null
    or without it, no path is known. Returns one row per input row: doc (the input row as a
    struct) and findings, an array of (word, value, score, is_secret) in text order:
    the number of the word it stands in, the candidate, the share of trees that vote
    secret, and score >= 0.5. A null, empty or clean text has an empty array; repeated
    rows are scanned alike; an empty table gives an empty table; further columns,
    whatever their names, are carried in doc.
    """
    forest = forest or train_forest(labelled_findings(docs.sparkSession))
    text = F.coalesce(docs[text_col].cast("string"), F.lit(""))
    held = spread(docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("doc"), text.alias("text")))
    # Two quick searches spare most texts the two patterns.
    low, named = F.lower("text"), F.lit(False)
    for name in NAMES:
        named = named | low.contains(name)
    maybe = (F.regexp_like("text", F.lit("[0-9]")) & F.regexp_like("text", F.lit(RUN))) | (named & F.regexp_like("text", F.lit(ASSIGNED)))
    split = held.select("doc", F.when(maybe, split_words(F.col("text"))).otherwise(F.array().cast("array<string>")).alias("words"))

    def pieces(line: Column, pattern: str, before: Column) -> Column:
        """(left, value) of all matches. left: the text since the match before, with
        that match where it is the value's name; for the first one with `before`."""
        gaps, values = (F.regexp_extract_all(line, F.lit(pattern), k) for k in (1, 2))

        def left(gap: Column, k: Column) -> Column:
            name = F.when(F.regexp_like(gap, F.lit(LINK)), F.get(values, k - 1)).otherwise(F.lit(""))
            return F.when(k == 0, F.concat(before, gap)).otherwise(F.concat(name, gap))

        return F.zip_with(F.transform(gaps, left), values, lambda x, v: F.struct(x.alias("left"), v.alias("value")))

    def of_word(words: Column, word: Column, i: Column) -> Column:
        """The candidates in a word: assigned values and runs, and the runs within
        assigned values. The word behind belongs to the last one."""
        before = F.concat_ws(" ", F.get(words, i - 2), F.get(words, i - 1))
        line = F.concat_ws(" ", F.nullif(F.regexp_extract(before, LEAD, 1), F.lit("")), word)

        def placed(of: Column) -> Column:
            behind = lambda k: F.when(k == F.size(of) - 1, F.coalesce(F.get(words, i + 1), F.lit(""))).otherwise(F.lit(""))
            within = lambda x: F.filter(pieces(x["value"], NEXT_RUN, x["left"]), lambda y: y["value"] != x["value"])
            row = lambda x, k: F.struct(i.alias("word"), x["value"].alias("value"), x["left"].alias("before"), behind(k).alias("after"))
            return F.flatten(F.transform(of, lambda x, k: F.transform(F.concat(F.array(x), within(x)), lambda y: row(y, k))))

        found = F.flatten(F.transform(F.array(pieces(line, NEXT, F.concat(before, F.lit(" ")))), placed))
        return F.filter(F.when(F.length(word) < 8, F.array().cast("array<struct<word:int,value:string,before:string,after:string>>")).otherwise(found), lambda x: F.length(x["value"]) >= 8)

    candidates = F.transform(F.array("words"), lambda ws: F.flatten(F.transform(ws, lambda w, i: of_word(ws, w, i))))
    found = split.select("doc", F.get(candidates, F.lit(0)).alias("found"))

    path = F.lit("") if path_col is None else F.coalesce(F.col("doc")[path_col].cast("string"), F.lit(""))

    def judged(x: Column) -> Column:
        columns = features(x["value"], x["before"], x["after"], path)
        wide = F.struct(*[columns[k].alias(k) for k in FEATURES])

        def vote(f: Column) -> Column:
            trees = _as_column(forest, [f[k] for k in FEATURES])
            score = sum(trees[1:], trees[0]) / len(trees)
            return F.struct(x["word"].alias("word"), x["value"].alias("value"), score.alias("score"), (score >= 0.5).alias("is_secret"))

        return F.get(F.transform(F.array(wide), vote), F.lit(0))

    return found.select("doc", settled("findings", F.transform("found", judged)))


def redact(text: Column, findings: Column, mark: str = "[SECRET]") -> Column:
    """The text with every found secret replaced by a mark, the longest first, as one
    may stand within another."""
    secrets = F.transform(F.filter(findings, lambda x: x["is_secret"]), lambda x: F.struct(F.length(x["value"]).alias("n"), x["value"].alias("value")))
    return F.aggregate(F.sort_array(secrets, asc=False), text, lambda acc, x: F.replace(acc, x["value"], F.lit(mark)))
