"""Line-first quality rules, in built-in column functions only.

Each line with a word is judged on its own: a punctuation rule, a navigation rule and
a boilerplate rule. Lines that fail are removed, and a document that loses more than
half of its words this way is rejected, as is one that fails the base rules on its
text as given. Everything is computed in the row, so there is no shuffle and no key
that could be hot.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.partitions import spread

#: ASCII white space, and the words between it.
BLANKS = " \t\n\x0b\f\r"
SPLIT = r"[\x20\x09-\x0D]+"
#: The first symbol of a word, looked for from the word's start only and without
#: going back, so that time is linear in the line however long its words are.
ODD_WORD = r"(?<![^\x20\x09-\x0D])[^\x20\x09-\x0D#*$%&|<>{}]*+[#*$%&|<>{}]"

#: Phrases of lines that are the same on every page, in four languages.
BOILERPLATE = (
    "all rights reserved", "copyright (c)", "©", "licensed under", "terms of use", "terms of service", "privacy policy",
    "cookie policy", "use of cookies", "subscribe to", "sign up for", "log in to", "click here", "enable javascript",
    "javascript is disabled", "lorem ipsum", "powered by", "back to top",
    "alle rechte vorbehalten", "datenschutzerklärung", "nutzungsbedingungen", "newsletter abonnieren", "zum seitenanfang",
    "tous droits réservés", "politique de confidentialité", "conditions d’utilisation", "mentions légales", "haut de page",
    "todos los derechos reservados", "política de privacidad", "términos de uso", "aviso legal", "volver arriba",
)
#: A line shorter than this that ends no sentence is a fragment.
FRAGMENT_WORDS = 8
#: Share of a line's words that may be separators or hold symbols.
SYMBOL_SHARE = 0.2
#: Share of a document's words that may be lost to removed lines.
LOST_SHARE = 0.5


def split_words(text: Column) -> Column:
    """Words of a text: runs of characters other than ASCII white space."""
    bare = F.btrim(text, F.lit(BLANKS))
    return F.when(F.length(bare) > 0, F.split(bare, SPLIT)).otherwise(F.array().cast("array<string>"))


def _bound(value: Column, use) -> Column:
    """use(value) with value computed once per row."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def settled(name: str, value: Column) -> Column:
    """value under a name, as the output of a generator: filters on it stay above, so
    the optimizer does not push copies of its expression down."""
    return F.explode_outer(F.array(value)).alias(name)


def repeat_words(words: Column) -> Column:
    """Number of words in 3-word windows that the text has twice or more. Windows are
    compared by a 64-bit hash; the sort runs only where some window repeats."""

    def of_hashes(h: Column) -> Column:
        def of_sorted(s: Column) -> Column:
            same = F.filter(s, lambda x, i: (x["h"] == F.get(s, i + 1)["h"]) | ((i > 0) & (x["h"] == F.get(s, F.greatest(i - 1, F.lit(0)))["h"])))
            return F.size(F.array_distinct(F.flatten(F.transform(same, lambda x: F.array(x["i"], x["i"] + 1, x["i"] + 2)))))

        placed = F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
        return F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0)).otherwise(_bound(placed, of_sorted))

    hashes = F.transform(F.slice(words, 1, F.greatest(F.size(words) - 2, F.lit(0))), lambda w, i: F.xxhash64(w, F.get(words, i + 1), F.get(words, i + 2)))
    return _bound(hashes, of_hashes).cast("long")


def line_verdict(line: Column) -> Column:
    """Number of words of a line, negative if the line fails a rule."""
    bare = F.btrim(line, F.lit(BLANKS))

    def judged(n: Column) -> Column:
        ends = F.right(F.rtrim(bare, F.lit("\"'”»)]")), F.lit(1)).isin(".", "!", "?", "…", ":", ";", "。", "！", "？")
        fragment = (n < FRAGMENT_WORDS) & ~ends
        shouting = F.contains(bare, F.lit("!!")) & (F.upper(bare) == bare)
        # Words are looked at for symbols only in lines that have any.
        odd = F.regexp_count(bare, F.lit(ODD_WORD))
        navigation = F.when(F.regexp_like(bare, F.lit("[#*$%&|<>{}]")), odd > SYMBOL_SHARE * n).otherwise(F.lit(False))
        return F.when(fragment, -n).when(shouting, -n).when(navigation, -n).when(_bound(F.lower(line), boilerplate), -n).otherwise(n)

    def boilerplate(low: Column) -> Column:
        found = F.lit(False)
        for phrase in BOILERPLATE:
            found = found | F.contains(low, F.lit(phrase))
        return found

    return _bound(F.size(F.split(bare, SPLIT)), judged)


def line_quality(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """Judges and cleans every document.

    Returns one row per input row: doc (the input row as a struct), clean_text (the
    lines that pass, in order), n_words, word_chars, n_symbols, n_dup_lines and
    n_repeat_words of the text as given, n_lost_words (in lines that fail),
    base_failed, and kept: false where base_failed, or where more than LOST_SHARE of
    the words are lost. A null or blank text has no words, fails the base rules and is
    not kept; repeated rows are judged alike; an empty table gives an empty table;
    further columns, whatever their names, are carried in doc.
    """
    text = F.coalesce(docs[text_col].cast("string"), F.lit(""))
    held = spread(docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("doc"), text.alias("text")))
    split = held.select("doc", "text", split_words(F.col("text")).alias("words"), F.filter(F.split("text", "\n"), lambda x: F.length(F.btrim(x, F.lit(BLANKS))) > 0).alias("lines"))
    length = F.length("text")
    judged = split.select(
        "doc",
        "lines",
        F.transform("lines", line_verdict).alias("verdicts"),
        F.size("words").cast("long").alias("n_words"),
        (length - F.length(F.regexp_replace("text", F.lit(SPLIT), F.lit("")))).alias("blanks"),
        length.alias("length"),
        F.regexp_count("text", F.lit("[#*$%&|<>]")).cast("long").alias("n_symbols"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        repeat_words(F.col("words")).alias("n_repeat_words"),
    )
    lost = F.aggregate("verdicts", F.lit(0), lambda acc, v: acc + F.greatest(-v, F.lit(0))).cast("long")
    pairs = F.filter(F.zip_with("lines", "verdicts", lambda x, v: F.struct(x.alias("line"), v.alias("verdict"))), lambda p: p["verdict"] > 0)
    clean = F.concat_ws("\n", F.transform(pairs, lambda p: p["line"]))
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    kept = ~failed & (lost <= LOST_SHARE * F.col("n_words"))
    word_chars = (F.col("length") - F.col("blanks")).cast("long")
    figures = F.struct(clean.alias("clean_text"), "n_words", word_chars.alias("word_chars"), "n_symbols", "n_dup_lines", "n_repeat_words", lost.alias("n_lost_words"), failed.alias("base_failed"), kept.alias("kept"))
    return judged.select("doc", settled("figures", figures)).select("doc", "figures.*")
