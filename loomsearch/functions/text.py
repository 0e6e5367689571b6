"""Text analysis as column expressions.

A text is lower-cased and split at everything that is no letter, digit or underscore;
one-character tokens and stop words go; what is left is stemmed. Each step of the
stemmer is bound by a higher-order function over the token array, so the expression
does not grow by substitution and predicates on terms stop at the array.
"""

from __future__ import annotations

from pyspark import SparkContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fixed values of the analysis.
STOPWORDS = (
    "a", "an", "the", "and", "or", "but", "in", "on", "at", "to", "for",
    "of", "with", "by", "from", "is", "it", "its", "this", "that", "are",
    "was", "were", "be", "been", "being", "have", "has", "had", "do", "does",
    "did", "will", "would", "could", "should", "may", "might", "shall", "can",
    "not", "no", "nor", "so", "yet", "both", "either", "neither", "as", "if",
    "than", "then", "there", "when", "where", "who", "which", "what", "how",
    "all", "each", "any", "some", "such", "into", "through", "during",
    "before", "after", "above", "below", "up", "down", "out", "off", "over",
    "under", "again", "further", "once", "here", "only", "own", "same",
    "too", "very", "just", "about", "also",
)
SUFFIX_CHANGES = (
    ("ational", "ate"), ("tional", "tion"), ("enci", "ence"), ("anci", "ance"), ("izer", "ize"), ("iser", "ise"), ("alism", "al"),
    ("ization", "ize"), ("isation", "ise"), ("ation", "ate"), ("ator", "ate"), ("alistic", "al"), ("fulness", "ful"), ("ousness", "ous"),
    ("iveness", "ive"),
)
SUFFIX_CUTS = ("icate", "ative", "alize", "iciti", "ical", "ful", "ness")
RESTORE_E = ("at", "bl", "iz")
UNDOUBLED_NOT = "aeioul"
TOKEN_BREAK = r"[^\p{L}\p{N}_]+"


def _drop(word: Column, n: int) -> Column:
    return F.left(word, F.length(word) - n)


def plural(word: Column) -> Column:
    """-sses and -ies lose two letters, a single -s of a longer word one."""
    n = F.length(word)
    return (
        F.when(F.endswith(word, F.lit("sses")) | F.endswith(word, F.lit("ies")), _drop(word, 2))
        .when(F.endswith(word, F.lit("s")) & ~F.endswith(word, F.lit("ss")) & (n > 4), _drop(word, 1))
        .otherwise(word)
    )


def participle(word: Column) -> Column:
    """-eed loses one letter; -ing and -ed go, and the stem is mended."""
    n = F.length(word)
    is_eed = F.endswith(word, F.lit("eed")) & (n > 4)
    is_ing = ~is_eed & F.endswith(word, F.lit("ing")) & (n > 5)
    is_ed = ~is_eed & ~is_ing & F.endswith(word, F.lit("ed")) & (n > 4)

    def mended(stem: Column) -> Column:
        restore = F.lit(False)
        for end in RESTORE_E:
            restore = restore | F.endswith(stem, F.lit(end))
        last = F.right(stem, F.lit(1))
        doubled = (F.length(stem) >= 2) & (last == F.substr(stem, F.length(stem) - 1, F.lit(1))) & ~F.contains(F.lit(UNDOUBLED_NOT), last)
        return F.when(restore, F.concat(stem, F.lit("e"))).when(doubled, _drop(stem, 1)).otherwise(stem)

    return F.when(is_eed, _drop(word, 1)).when(is_ing, mended(_drop(word, 3))).when(is_ed, mended(_drop(word, 2))).otherwise(word)


def _first_suffix(word: Column, changes: tuple[tuple[str, str], ...]) -> Column:
    out = None
    for suffix, put in changes:
        hit = F.endswith(word, F.lit(suffix)) & (F.length(word) > len(suffix) + 1)
        new = F.concat(_drop(word, len(suffix)), F.lit(put)) if put else _drop(word, len(suffix))
        out = F.when(hit, new) if out is None else out.when(hit, new)
    return out.otherwise(word)


def derived(word: Column) -> Column:
    """The first suffix of SUFFIX_CHANGES that leaves two letters is changed."""
    return _first_suffix(word, SUFFIX_CHANGES)


def final(word: Column) -> Column:
    """The first suffix of SUFFIX_CUTS that leaves two letters is cut."""
    return _first_suffix(word, tuple((s, "") for s in SUFFIX_CUTS))


def stem(word: Column) -> Column:
    """The stem of a word; words of up to three letters stay as they are."""
    bound = F.array(word)
    for step in (plural, participle, derived, final):
        bound = F.transform(bound, step)
    return F.when(F.length(word) > 3, F.get(bound, F.lit(0))).otherwise(word)


def raw_tokens(text: Column) -> Column:
    """Lower-case tokens without one-character tokens and stop words."""
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), TOKEN_BREAK), lambda t: (F.length(t) > 1) & ~t.isin(*STOPWORDS))


def stem_rows(df: DataFrame, word: str, into: str) -> DataFrame:
    """df with the stem of column `word` as column `into`. Each step is a projection of
    its own, which compiles to code; the last stands behind a generator, so that
    predicates on the stem are not pushed through the steps."""
    step_of = F.col(word)
    for n, step in enumerate((plural, participle, derived, final)):
        df = df.withColumn(f"_stem{n}", F.when(F.length(word) > 3, step(step_of)).otherwise(F.col(word)))
        step_of = F.col(f"_stem{n}")
    return df.withColumn(into, F.explode_outer(F.array(step_of))).drop(*(f"_stem{n}" for n in range(4)))


_built: dict[tuple[int, str, bool], Column] = {}


def tokens(text: Column | str, stemming: bool = True) -> Column:
    """The analysed tokens of a text, in order and with repeats; null is empty. For a
    column given by its name the expression is built once, as building takes longer
    than a small query."""
    if isinstance(text, str):
        key = (id(SparkContext._jvm), text, stemming)
        if key not in _built:
            _built[key] = tokens(F.col(text), stemming)
        return _built[key]
    return F.transform(raw_tokens(text), stem) if stemming else raw_tokens(text)


def unique_terms(text: Column | str, stemming: bool = True) -> Column:
    return F.array_distinct(tokens(text, stemming))
