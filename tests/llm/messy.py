"""A small table with every awkward case, and brute-force versions of the operators."""

from __future__ import annotations

import random
import re

DDL = "doc_id long, text string, lang string, source string, n_chars long, id string, block long, n_words string, shard int, score double, row int, key long, text_a string, bin int, label int"
EXTRA = (None, None, None, "x", 1, "7", 3, 1.5, 2, 9, "y", 4, 5)
SPACED = re.compile(r"[^\x20\x09-\x0D]+")


def sentence(rng: random.Random, n: int) -> str:
    return " ".join("".join(rng.choice("abcdehilnorstu") for _ in range(rng.randint(2, 8))) for _ in range(n))


def rows(seed: int = 1) -> list[tuple]:
    """doc_id and text: copies, near copies, shared passages, nulls, blanks, marks of
    many scripts, a very long text, repeated rows and a null id."""
    rng = random.Random(seed)
    shared, base = sentence(rng, 40), sentence(rng, 200)
    words = base.split()
    near = [" ".join(w if rng.random() > rate else "swapped" for w in words) for rate in (0.005, 0.01, 0.02, 0.03, 0.1)]
    texts = [
        base, base, *near, None, "", "   \n\t ", "one", "one", "two words", "a b c d", "A B C D", "a  b\tc\nd e",
        f"{sentence(rng, 30)} {shared} {sentence(rng, 30)}", f"{shared} {sentence(rng, 20)}", f"{sentence(rng, 60)}\n{shared}",
        "same " * 300, "Ünïcödé     word\x1c\x1fjoin é É \U0001f600 ﬁ İ ß İ", "x" * 5000, sentence(rng, 30_000),
        "don't they'll 's <|endoftext|> <|ENDOFTEXT|> a<|startoftext|>b J̌ a.b,c!!! 12a3 \"quoted\"… ”. (x)",
        "null\0byte and\x0bvertical\x0cform feed",
    ]
    out = [(i * 3 + 1, t) for i, t in enumerate(texts)]
    rng.shuffle(out)
    return [*out, out[0], out[1], (None, base), (None, "unnamed text of its own with some words in it")]


def table(spark, seed: int = 1, parts: int = 3):
    data = [(i, t, *EXTRA) for i, t in rows(seed)]
    return spark.createDataFrame(data, DDL).repartition(parts)


def empty(spark):
    return spark.createDataFrame([], DDL)


def words(text: str | None) -> list[str]:
    return SPACED.findall(text or "")


def shingles(text: str | None, n: int = 5) -> frozenset:
    w = [re.sub("[A-Z]", lambda m: m[0].lower(), x) for x in words(text)]
    return frozenset(zip(*(w[i:] for i in range(n)), strict=False)) if len(w) >= n else frozenset([tuple(w)] if w else [])


def classes(data: list[tuple], percent: int) -> dict:
    """The smallest id reachable from each id, by comparing all pairs."""
    named = [(i, shingles(t)) for i, t in data if i is not None]
    up = {i: i for i, _ in named}

    def top(i):
        while up[i] != i:
            i = up[i]
        return i

    for x, (i, a) in enumerate(named):
        for j, b in named[:x]:
            common = len(a & b)
            if a and b and 100 * common >= percent * (len(a) + len(b) - common):
                p, q = top(i), top(j)
                up[max(p, q)] = min(p, q)
    return {i: top(i) for i, _ in named}
