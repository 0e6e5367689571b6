"""Toxicity of texts by a linear classifier on character n-grams.

The features are the presence of character n-grams, hashed to a table of fixed size
and scaled by their naive Bayes log-count ratio; a logistic regression on the scaled
features gives the score. Counts and features of the training texts are computed on
the executors; the driver holds arrays of the table's size and the sparse rows of the
bounded training sample. Scoring is one pass over the texts with the table of weights.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.partitions import spread
from .store import Scratch, hashed_sample
from .words import as_array, slices

BITS = 18
#: Lengths of the n-grams, in code points.
LENGTHS = (3, 4, 5)
#: Labelled rows that the classifier is fitted on, at most: those whose id has the
#: smallest hash.
TRAINING_ROWS = 12_000
#: Tasks that the sample is dealt to.
TRAINING_TASKS = 24
#: Features with the clearest log-count ratio that are kept, and the texts that must
#: have one.
KEPT_FEATURES, LEAST_TEXTS = 4096, 3
SMOOTHING, PENALTY, STEPS = 1.0, 1e-3, 300

_BLANK = np.arange(128, dtype=np.uint32)
_BLANK[[9, 10, 11, 12, 13]] = 32


def ngrams(texts: list[str], lengths: tuple[int, ...] = LENGTHS, bits: int = BITS) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each length the table place of every n-gram, and the text it is in. Case
    and the kind of white space are ignored; a text stands between two spaces."""
    codes = np.frombuffer("".join(f" {t.lower()} \0" for t in texts).encode("utf-32-le", "surrogatepass"), np.uint32)
    low = codes < 128
    codes = np.where(low, _BLANK[codes & 127], codes)
    ends = np.flatnonzero(codes == 0)
    if len(ends) > len(texts):  # a text holds the separator
        codes = np.frombuffer("".join(f" {t.lower().replace(chr(0), ' ')} \0" for t in texts).encode("utf-32-le", "surrogatepass"), np.uint32)
        codes = np.where(codes < 128, _BLANK[codes & 127], codes)
        ends = np.flatnonzero(codes == 0)
    owner = np.repeat(np.arange(len(texts), dtype=np.int32), np.diff(ends, prepend=-1))
    rolled = codes.copy()
    stop = np.repeat(ends, np.diff(ends, prepend=-1))
    place = np.arange(len(codes))
    for n in range(2, max(lengths) + 1):
        if len(codes) < n:
            return
        rolled = rolled[:-1] * np.uint32(0x01000193) + codes[n - 1 :]
        if n in lengths:
            hashed = (rolled ^ (rolled >> np.uint32(15))) * np.uint32(0x2C1B3C6D)
            hashed = (hashed ^ (hashed >> np.uint32(12))) * np.uint32(0x297A2D39)
            whole = place[: len(rolled)] + n <= stop[: len(rolled)]
            yield (hashed >> np.uint32(32 - bits))[whole], owner[: len(rolled)][whole]


def present(texts: list[str], kept: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(text, place) of the distinct n-grams of each text, in order; kept: a flag for
    each place of the table that counts."""
    keys = []
    for places, owners in ngrams(texts):
        if kept is not None:
            own = kept[places]
            places, owners = places[own], owners[own]
        keys.append(np.unique((owners.astype(np.int64) << BITS) | places))
    key = np.unique(np.concatenate(keys)) if keys else np.empty(0, np.int64)
    return key >> BITS, key & ((1 << BITS) - 1)


def _strings(texts: pa.Array) -> Iterator[tuple[int, int, list[str]]]:
    for a, b in slices(texts, 2 << 20):
        yield a, b, texts.slice(a, b - a).to_pylist()


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(place, clean, toxic): texts of either label in which each n-gram is present."""
    counts = np.zeros((2, 1 << BITS), np.int64)
    for batch in batches:
        labels = batch["label"].to_numpy()
        for a, b, texts in _strings(as_array(batch["text"])):
            owner, place = present(texts)
            for label in (0, 1):
                counts[label] += np.bincount(place[labels[a:b][owner] == label], minlength=1 << BITS)
    found = np.flatnonzero(counts.any(axis=0))
    yield pa.record_batch([pa.array(found), pa.array(counts[0, found]), pa.array(counts[1, found])], ["place", "clean", "toxic"])


def _sparse(kept: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            labels = batch["label"]
            for a, b, texts in _strings(as_array(batch["text"])):
                owner, place = present(texts, kept)
                cut = np.searchsorted(owner, np.arange(len(texts) + 1))
                rows = [place[x:y].astype(np.int32).tobytes() for x, y in zip(cut[:-1], cut[1:], strict=True)]
                yield pa.record_batch([labels.slice(a, b - a), pa.array(rows, pa.binary())], ["label", "places"])

    return run


@dataclass
class Classifier:
    """weights: of each place of the n-gram table, 0 where it plays no part."""

    weights: np.ndarray
    intercept: float

    def score(self, texts: list[str]) -> np.ndarray:
        owner, place = present(texts, self.weights != 0)
        margin = self.intercept + np.bincount(owner, weights=self.weights[place], minlength=len(texts))
        return 1 / (1 + np.exp(-np.clip(margin, -30, 30)))


def log_count_ratio(counts: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Naive Bayes log-count ratios of presence, and the places whose ratio is
    clearest against its standard error."""
    share = (counts + SMOOTHING) / (rows[:, None] + 2 * SMOOTHING)
    ratio = np.log(share[1] / share[0])
    error = np.sqrt((1 / (counts + SMOOTHING)).sum(axis=0))
    clear = np.where(counts.sum(axis=0) >= LEAST_TEXTS, np.abs(ratio) / error, 0)
    best = np.argsort(-clear, kind="stable")[:KEPT_FEATURES]
    return ratio, best[clear[best] > 0]


def _regress(rows: list[np.ndarray], labels: np.ndarray, scale: np.ndarray) -> tuple[np.ndarray, float]:
    """Logistic regression on present features times scale, by accelerated descent."""
    n, at = len(rows), np.concatenate(rows) if rows else np.empty(0, np.int64)
    owner = np.repeat(np.arange(n), [len(r) for r in rows])
    value = scale[at]
    rate = labels.mean() if n else 0.5
    w, b = np.zeros(len(scale)), float(np.log((rate + 1e-6) / (1 - rate + 1e-6)))
    if not len(at) or rate in (0, 1):
        return w, b
    v = np.ones(len(scale))
    for _ in range(20):  # the largest eigenvalue
        v = np.bincount(at, weights=value * np.bincount(owner, weights=value * v[at], minlength=n)[owner], minlength=len(scale))
        size = np.linalg.norm(v)
        v /= size
    step = 1 / (0.25 * (size + n) / n + PENALTY)
    wv, bv, t = w, b, 1.0
    for _ in range(STEPS):
        miss = 1 / (1 + np.exp(-(bv + np.bincount(owner, weights=value * wv[at], minlength=n)))) - labels
        new_w = wv - step * (np.bincount(at, weights=value * miss[owner], minlength=len(scale)) / n + PENALTY * wv)
        new_b = bv - step * miss.mean()
        nt = (1 + np.sqrt(1 + 4 * t * t)) / 2
        wv, bv = new_w + (t - 1) / nt * (new_w - w), new_b + (t - 1) / nt * (new_b - b)
        w, b, t = new_w, new_b, nt
    return w, b


def fit(labelled: DataFrame) -> Classifier:
    """Fits on labelled(text, label 0 or 1), which the caller has bounded."""
    counts, rows = np.zeros((2, 1 << BITS), np.int64), np.zeros(2, np.int64)
    for row in labelled.groupBy("label").count().collect():
        rows[row["label"]] = row["count"]
    # Summed on the executors, so no more than the table's places come to the driver.
    summed = labelled.mapInArrow(_count, "place long, clean long, toxic long").groupBy("place").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic")).toArrow()
    for label, name in enumerate(("clean", "toxic")):
        counts[label, summed["place"].to_numpy()] = summed[name].to_numpy()
    ratio, best = log_count_ratio(counts, rows)
    kept = np.zeros(1 << BITS, bool)
    kept[best] = True
    number = np.full(1 << BITS, -1)
    number[best] = np.arange(len(best))
    sample = labelled.mapInArrow(_sparse(kept), "label int, places binary").collect()
    places = [number[np.frombuffer(r["places"], np.int32)] for r in sample]
    w, b = _regress(places, np.array([r["label"] for r in sample], float), ratio[best])
    weights = np.zeros(1 << BITS)
    weights[best] = w * ratio[best]
    return Classifier(weights, b)


def _scores(model: Classifier):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, texts in _strings(as_array(batch["text"])):
                yield pa.record_batch([batch["id"].slice(a, b - a), pa.array(model.score(texts))], ["id", "score"])

    return run


def held_out(id_column: Column) -> Column:
    """Rows that are never learned from: crc32 of the id as text divisible by 5."""
    return F.coalesce(F.crc32(id_column.cast("string")) % 5 == 0, F.lit(False))


def score_toxicity(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> DataFrame:
    """Scores every text for toxicity, learning from labels of rows that are not held
    out and from the texts alone.

    Returns one row per row of docs: id_col, held_out, score (0 to 1) and predicted
    (score >= 0.5). A null text scores as an empty one, which has the base rate or
    less; null labels and labels of unknown ids are ignored, of several labels of an
    id the largest counts; without any labels every score is 0.5; a null id is not
    held out and not learned from; repeated rows are scored alike; an empty table gives
    an empty table; further columns play no part and are not returned.
    """
    scratch = Scratch(docs.sparkSession, "toxicity")
    source = spread(docs.select(docs[id_col].cast("long").alias("id"), docs[text_col].cast("string").alias("text")))
    known = labels.select(labels[id_col].cast("long").alias("id"), labels[label_col].cast("int").alias("label")).where("id IS NOT NULL AND label IN (0, 1)")
    chosen = hashed_sample(known.where(~held_out(F.col("id"))).groupBy("id").agg(F.max("label").alias("label")), TRAINING_ROWS, "id")
    training = scratch.write(source.join(F.broadcast(chosen), "id").select("text", "label").repartition(TRAINING_TASKS), "training")
    model = fit(training)
    scratch.drop("training")
    scored = source.mapInArrow(_scores(model), "id long, score double")
    return scored.select(F.col("id").alias(id_col), held_out(F.col("id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
