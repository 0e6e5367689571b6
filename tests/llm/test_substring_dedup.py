import hashlib
from collections import Counter
from itertools import compress

from . import messy
from loomsearch.llm.op3_substring_dedup import remove_repeated_passages
from loomsearch.llm.queries import op3_substring_dedup


def expected(data, n=13):
    last = 1 << 62
    first = {}
    split = [(last if i is None else i, i, messy.words(t)) for i, t in data]
    for key, _, w in split:
        for k in range(len(w) - n + 1):
            gram = tuple(w[k : k + n])
            first[gram] = min(first.get(gram, last), key)
    out = []
    for key, i, w in split:
        keep = [True] * len(w)
        for k in range(len(w) - n + 1):
            if first[tuple(w[k : k + n])] < key:
                keep[k : k + n] = [False] * n
        out.append((i, len(w), keep.count(False), " ".join(compress(w, keep))))
    return Counter(out)


def test_matches_brute_force_on_awkward_rows(spark):
    got = Counter(map(tuple, remove_repeated_passages(messy.table(spark)).collect()))
    assert got == expected(messy.rows())


def test_shorter_windows(spark):
    got = Counter(map(tuple, remove_repeated_passages(messy.table(spark, seed=2), window=3).collect()))
    assert got == expected(messy.rows(2), 3)


def test_empty_table(spark):
    found = remove_repeated_passages(messy.empty(spark))
    assert found.columns == ["doc_id", "n_words", "n_removed", "kept_text"] and found.count() == 0


def test_query_digest(spark, sf_dir):
    rows = op3_substring_dedup(spark, sf_dir).collect()
    assert len(rows) == 200 and any(r.n_removed for r in rows)
    whole = next(r for r in rows if not r.n_removed)
    text = spark.read.parquet(f"{sf_dir}/documents.parquet").where(f"doc_id = {whole.doc_id}").first().text
    assert whole.kept_sha256 == hashlib.sha256(" ".join(messy.words(text)).encode()).hexdigest()
