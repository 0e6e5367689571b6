"""Language of web pages by Bayesian fusion of four kinds of evidence.

The likelihood of a page's text under each language comes from hashed character
trigrams, fitted on a bounded sample of the labelled texts of each language. The distributions of declared
markup languages and of address suffixes given the language, and the prior of each
host, come from the pages themselves, by grouped sums of the posteriors that the text
alone gives. A host's prior is smoothed towards that of its domain, that towards the
address suffix, and that towards all pages, so a host with few pages says little. A
page's own share is taken out of its host's sums, lest it confirm itself.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .op1_toxicity import TRAINING_TASKS, ngrams
from .store import Scratch
from .words import as_array, slices

BITS, LENGTHS = 16, (1, 2, 3)
#: Labelled texts that the trigrams are fitted on, as many of each language as fit but
#: at least so many, or all it has: those whose id has the smallest hash.
TRAINING_ROWS, ROWS_PER_LANGUAGE = 4_000, 100
#: Neighbouring trigrams are not independent: the power of the text's likelihood, and
#: the number of trigrams beyond which a longer text says no more.
TEMPER, ENOUGH = 0.2, 400
#: Weight, in pages, of the level above in each smoothed distribution.
STRENGTH = 5.0
#: Rows of a table of sums that is broadcast, at most; a row is one number per language.
SENT_ROWS = 10_000

_HIDDEN = re.compile(r"(?is)<!--.*?-->|<(script|style|noscript|template)\b.*?</\1\s*>")
_TAG = re.compile(r"(?s)<[^>]*>")


def visible_text(markup: str) -> str:
    """The text of a page without comments, scripts, styles and tags."""
    return html.unescape(_TAG.sub(" ", _HIDDEN.sub(" ", markup)))


def rows_per_language(counts: list[int]) -> int:
    """The highest number of rows of each language that TRAINING_ROWS has place for."""
    left = TRAINING_ROWS
    for k, n in enumerate(sorted(counts)):
        share = left // (len(counts) - k)
        if n > share:
            return max(share, ROWS_PER_LANGUAGE)
        left -= n
    return TRAINING_ROWS


def training_sample(known: DataFrame) -> tuple[DataFrame, list[str]]:
    """(sample of known(key, text, lang) with rows of every language, all languages).
    Of a language with many more rows than wanted only about twice as many are
    compared, by a threshold on another hash, and at least the row where that is least."""
    span = 1 << 30
    by_hash = F.pmod(F.xxhash64(F.lit(17), "key", "lang"), F.lit(span))
    found = known.groupBy("lang").agg(F.count("*").alias("n"), F.min(by_hash).alias("least")).collect()
    if not found:
        return known.select("text", "lang"), []
    most = rows_per_language([r["n"] for r in found])
    below = [(r["lang"], max(r["least"] + 1, span * 2 * most // r["n"]) if r["n"] > 4 * most else span) for r in found]
    limits = known.sparkSession.createDataFrame(below, "lang string, below long")
    nth = F.row_number().over(Window.partitionBy("lang").orderBy(F.xxhash64("key", "lang"), "key"))
    near = known.join(F.broadcast(limits), "lang").where(by_hash < F.col("below"))
    return near.withColumn("nth", nth).where(F.col("nth") <= most).select("text", "lang"), sorted(r["lang"] for r in found)


def declared_language(markup: Column) -> Column:
    """The language of the first html tag that names one, wherever it stands; '' if none
    does. Tags are taken whole before they are searched, so time is linear in the page."""
    tags = F.regexp_extract_all(markup, F.lit(r"(?i)<html\b[^>]*"), 0)
    named = F.transform(tags, lambda t: F.regexp_extract(t, r"(?i)^<html\b[^>]*?\blang\s*=\s*[\"']?([a-zA-Z]+)", 1))
    return F.lower(F.coalesce(F.get(F.filter(named, lambda x: x != ""), F.lit(0)), F.lit("")))


def _count(languages: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, number = np.zeros((len(languages), 1 << BITS), np.int64), {x: i for i, x in enumerate(languages)}
        for batch in batches:
            own = np.array([number[x] for x in batch["lang"].to_pylist()], np.int64)
            texts = as_array(batch["text"])
            for a, b in slices(texts, 1 << 20):
                for place, owner in ngrams(texts.slice(a, b - a).to_pylist(), LENGTHS, BITS):
                    counts += np.bincount((own[a:b][owner] << BITS) | place, minlength=counts.size).reshape(counts.shape)
        found = np.flatnonzero(counts)
        yield pa.record_batch([pa.array(found), pa.array(counts.ravel()[found])], ["cell", "n"])

    return run


def fit(labelled: DataFrame, languages: list[str]) -> np.ndarray:
    """Log-probabilities (languages x places) of hashed character n-grams in
    labelled(lang, text), which the caller has bounded."""
    counts = np.zeros((len(languages), 1 << BITS))
    # Summed on the executors, so no more than the model's cells come to the driver.
    summed = labelled.mapInArrow(_count(languages), "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")).toArrow()
    counts.ravel()[summed["cell"].to_numpy()] = summed["n"].to_numpy()
    counts += 0.1
    return np.log(counts / counts.sum(axis=1, keepdims=True)).astype(np.float32)


def text_posteriors(texts: list[str], model: np.ndarray) -> np.ndarray:
    """Posterior (texts x languages) under equal priors; equal shares for no text."""
    total, n = np.zeros((len(texts), len(model))), np.zeros(len(texts))
    for place, owner in ngrams(texts, LENGTHS, BITS):
        n += np.bincount(owner, minlength=len(texts))
        for k, row in enumerate(model):
            total[:, k] += np.bincount(owner, weights=row[place], minlength=len(texts))
    total *= (TEMPER * np.minimum(1, ENOUGH / np.maximum(n, 1)))[:, None]
    total[[not t.strip() for t in texts]] = 0
    odds = np.exp(total - total.max(axis=1, keepdims=True))
    return odds / odds.sum(axis=1, keepdims=True)


def _posteriors(model: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            pages = as_array(batch["html"])
            for a, b in slices(pages, 1 << 20):
                found = text_posteriors([visible_text(x) for x in pages.slice(a, b - a).to_pylist()], model)
                rest = [batch[c].slice(a, b - a) for c in ("id", "declared", "host", "domain", "suffix")]
                yield pa.RecordBatch.from_arrays([*rest, pa.array(list(found), pa.list_(pa.float64()))], ["id", "declared", "host", "domain", "suffix", "text_p"])

    return run


def _summed(pages: DataFrame, by: str, n: int) -> DataFrame:
    """Sums of the text posteriors by a column, as an array; reduced before the
    shuffle, so a host with a third of all pages is one row per task."""
    return pages.groupBy(by).agg(F.array(*[F.sum(F.get("text_p", F.lit(k))) for k in range(n)]).alias(f"{by}_n"))


def _total(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda acc, x: acc + x)


def _smoothed(counts: Column, above: Column) -> Column:
    """Share of each language in counts, with STRENGTH pages spread as in above."""
    whole = _total(counts) + STRENGTH
    return F.zip_with(counts, above, lambda c, p: (F.greatest(c, F.lit(0.0)) + STRENGTH * p) / whole)


def identify_languages(pages: DataFrame, labelled: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", text_col: str = "text", lang_col: str = "lang", label_id_col: str = "doc_id") -> DataFrame:
    """The language of every page, of those that labelled (text, language) holds.

    Returns one row per row of pages: id_col, lang, probability, text_lang and
    text_probability (from the text alone), declared (of <html lang=...>, in lower
    case, without region), suffix (the last label of the host) and host; the last
    three are empty where absent. Null or empty markup leaves the other evidence; a
    null address is a host of its own name ''. Ties go to the first language in
    alphabetical order; null and repeated ids are carried as they are. An empty table
    of pages gives an empty table; without labelled rows lang is null. Further columns
    play no part and are not returned.
    """
    spark, scratch = pages.sparkSession, Scratch(pages.sparkSession, "language")
    # Copies of a text share a hash, so rows are told apart by their id where they have one.
    key = F.xxhash64(labelled[text_col]).cast("string")
    if label_id_col in labelled.columns:
        key = F.coalesce(labelled[label_id_col].cast("string"), key)
    known = labelled.select(key.alias("key"), labelled[text_col].cast("string").alias("text"), labelled[lang_col].cast("string").alias("lang")).where("lang IS NOT NULL AND text IS NOT NULL")
    sample, languages = training_sample(known)
    sample = scratch.write(sample.repartition(TRAINING_TASKS), "sample")
    url, markup = F.coalesce(pages[url_col].cast("string"), F.lit("")), F.coalesce(pages[html_col].cast("string"), F.lit(""))
    host = F.lower(F.regexp_extract(url, r"^[a-zA-Z][a-zA-Z0-9+.\-]*://(?:[^/@?#]*@)?([^/:?#]*)", 1))
    source = pages.select(
        pages[id_col].cast("long").alias("id"),
        declared_language(markup).alias("declared"),
        host.alias("host"),
        F.substring_index(host, ".", -3).alias("domain"),
        F.substring_index(host, ".", -1).alias("suffix"),
        markup.alias("html"),
    )
    if not languages:
        nothing = [F.lit(None).cast("string").alias("lang"), F.lit(None).cast("double").alias("probability"), F.lit(None).cast("string").alias("text_lang"), F.lit(None).cast("double").alias("text_probability")]
        return source.select(F.col("id").alias(id_col), *nothing, "declared", "suffix", "host")
    model, n = fit(sample, languages), len(languages)
    scored = scratch.write(source.mapInArrow(_posteriors(model), "id long, declared string, host string, domain string, suffix string, text_p array<double>"), "scored")
    levels = {by: scratch.write(_summed(scored, by, n), f"by-{by}") for by in ("host", "domain", "suffix", "declared")}
    whole = levels["suffix"].agg(F.array(*[F.coalesce(F.sum(F.get("suffix_n", F.lit(k))), F.lit(0.0)) for k in range(n)])).first()[0]
    share = [(x + 1) / (sum(whole) + n) for x in whole]
    everywhere = F.array(*map(F.lit, share))
    wide = scored
    for by, sums in levels.items():
        # Few values: sent to every task, as a value may have most of the pages.
        # Beyond that the adaptive planner splits the tasks of such values.
        wide = wide.join(F.broadcast(sums) if sums.count() <= SENT_ROWS else sums, by)

    def given_language(counts: Column) -> Column:
        """P(this value | language), with the share of the value among all pages as
        the level above."""
        part = _total(counts) / F.lit(float(sum(whole) or 1))
        return F.zip_with(counts, F.array(*[F.lit(float(x)) for x in whole]), lambda c, t: (c + STRENGTH * part) / (t + STRENGTH))

    own = F.col("text_p")
    without = lambda counts: F.zip_with(counts, own, lambda c, p: c - p)
    prior = _smoothed(without(F.col("host_n")), _smoothed(without(F.col("domain_n")), _smoothed(without(F.col("suffix_n")), everywhere)))
    fused = F.zip_with(F.zip_with(F.zip_with(own, prior, lambda x, y: x * y), given_language(F.col("declared_n")), lambda x, y: x * y), given_language(F.col("suffix_n")), lambda x, y: x * y)

    def best(shares: Column) -> tuple[Column, Column]:
        top = F.array_max(shares)
        return F.get(F.array(*map(F.lit, languages)), (F.array_position(shares, top) - 1).cast("int")), F.round(top, 6)

    weighed = wide.select("id", "declared", "suffix", "host", "text_p", fused.alias("odds")).withColumn("p", F.transform("odds", lambda x: x / _total(F.col("odds"))))
    lang, probability = best(F.col("p"))
    text_lang, text_probability = best(F.col("text_p"))
    return weighed.select(F.col("id").alias(id_col), lang.alias("lang"), probability.alias("probability"), text_lang.alias("text_lang"), text_probability.alias("text_probability"), "declared", "suffix", "host")
