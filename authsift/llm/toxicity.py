"""Counterfactual-regularised toxicity classifier.

A document is the set of its words (64-bit hashes of lower-cased words).  Words
whose presence goes with the label (a z-score over ``min_z``) and all identity
terms are the features of a logistic regression, fitted by Newton steps.  For every
labelled document with identity terms a counterfactual swaps one for another term;
for the others it adds a term.  The squared difference of the two logits is
penalised, so a neutral mention of a group moves no score.

The fit takes a bounded sample: the ``limit`` labelled training rows with the
smallest hash of their id, one row per id (of several, the one with the smallest word
set); training rows have crc32(id) mod ``folds`` other than ``held``.  Spark counts the
sample's words and picks the features, at most ``most`` (``MAX_FEATURES``; by z-score,
ties by hash): the driver gets these and, per sampled document, two bytes a feature it has,
20 MB at the defaults whatever the texts are.  Every document is scored, over its whole text.

Edge cases: null and empty texts score as a document without any feature; null
labels are left out, several labels of an id count by their maximum; without
labels, or with one class only, the score is the share of label 1 (0.5 without
any); a null id has no label; repeated rows each get a result; very long texts are one
set of words; extra columns, also with clashing names, are ignored; an empty table gives an
empty result.
"""
from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from authsift.llm import textarrays as ta
from authsift.llm.common import crc_mod, passed_through, saved

LIMIT, FOLDS, HELD = 20_000, 4, 2
MIN_Z, MAX_FEATURES, RIDGE, COUNTERFACTUAL = 4.5, 512, 1.0, 1.0
IDENTITY = ("women men girls boys muslim muslims christian christians jewish jews hindu hindus buddhist atheist "
            "immigrant immigrants refugee refugees black white asian latino african european american german french "
            "spanish gay straight lesbian bisexual transgender queer disabled blind deaf elderly young old").split()


def word_sets(column: pa.Array) -> Iterator[tuple[int, ta.Words]]:
    """Per slice: (first row, words)."""
    for a, _, data, offs in ta.slices(column):
        yield a, ta.words(ta.LOWER[data], offs, ta.ALNUM)


def hash_of(words: list[str]) -> np.ndarray:
    return ta.words(*next((d, o) for _, _, d, o in ta.slices(pa.array([" ".join(words)]))), ta.ALNUM).hash


def fit(y: np.ndarray, rows: np.ndarray, cols: np.ndarray, terms: np.ndarray, size: int,
        counterfactual: float = COUNTERFACTUAL, seed: int = 8) -> tuple[np.ndarray, float]:
    """(weights, intercept) of documents whose features are the entries (rows, cols) of a 0/1 matrix.

    ``terms``: the columns of identity terms.
    """
    n = len(y)
    share = float(y.mean()) if n else 0.5
    if n == 0 or share in (0.0, 1.0):
        p = min(max(share, 1e-3), 1 - 1e-3)
        return np.zeros(size), float(np.log(p / (1 - p)))
    x = np.zeros((n, size + 1))
    x[rows, cols] = 1
    x[:, -1] = 1
    # counterfactuals: the first identity term swapped, or one added
    rng = np.random.default_rng(seed)
    has = x[:, terms]
    first = np.where(has.any(axis=1), terms[has.argmax(axis=1)], -1)
    other = terms[rng.integers(0, len(terms), n)]
    change = np.zeros_like(x)
    change[np.flatnonzero(first >= 0), first[first >= 0]] += 1
    change[np.arange(n), other] -= 1
    pull = counterfactual * change.T @ change + RIDGE * np.eye(x.shape[1])
    pull[-1, -1] = 1e-6
    w = np.zeros(x.shape[1])
    w[-1] = np.log(share / (1 - share))
    for _ in range(25):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve(x.T @ (x * (p * (1 - p))[:, None]) + pull, x.T @ (y - p) - pull @ w)
        w += step * min(1.0, 4 / max(np.abs(step).max(), 1e-9))
        if np.abs(step).max() < 1e-6:
            break
    return w[:-1], float(w[-1])


def sample(docs: DataFrame, labels: DataFrame, text: str, id_col: str, label: str, label_id: str, limit: int,
           folds: int, held: int) -> DataFrame:
    """(order, y, words): label and word set of one row per id of the bounded training sample, in the shared folder."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for a, w in word_sets(b.column(1)):
                out = [np.unique(w.hash[f:f + c]).tobytes() for f, c in zip(w.first, w.count)]
                yield pa.RecordBatch.from_arrays([b.column(0).slice(a, len(out)), b.column(2).slice(a, len(out)),
                                                  pa.array(out, pa.binary())], names=["order", "y", "words"])

    y = labels.where(F.col(label).isNotNull() & F.col(label_id).isNotNull()).select(F.col(label_id).alias("id"), F.col(label).cast("double").alias("y"))
    y = y.where(crc_mod("id", folds) != held).groupBy("id").agg(F.max("y").alias("y"))
    y = saved(y.withColumn("order", F.xxhash64("id")).orderBy("order", "id").limit(limit))
    rows = docs.select(F.col(id_col).alias("id"), F.col(text).cast("string").alias("t")).join(F.broadcast(y), "id") \
        .select("order", "t", "y")  # at most ``limit`` ids: under 1 MB
    sets = rows.mapInArrow(run, "order bigint, y double, words binary")
    return saved(sets.groupBy("order", "y").agg(F.min("words").alias("words")))


def features(chosen: DataFrame, min_z: float, most: int) -> np.ndarray:
    """Sorted hashes of the words that go with the label, and of the identity terms.

    Spark counts the words; ``most`` of them at most reach the driver.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sets = [np.frombuffer(x, np.uint64) for x in b.column(1).to_pylist()]
            if sum(map(len, sets)):
                word, code = np.unique(np.concatenate(sets), return_inverse=True)
                y = np.repeat(b.column(0).to_numpy(), [len(x) for x in sets])
                yield pa.RecordBatch.from_arrays([pa.array(word.view(np.int64)), pa.array(np.bincount(code)), pa.array(np.bincount(code, weights=y))],
                                                 names=["h", "c", "pos"])

    total = chosen.agg(F.count(F.lit(1)).alias("n"), F.avg("y").alias("share")).first()
    n, share = total["n"], total["share"]
    picked = np.zeros(0, np.uint64)
    if n and 0 < share < 1:
        words = chosen.select("y", "words").mapInArrow(count, "h bigint, c bigint, pos double") \
            .groupBy("h").agg(F.sum("c").alias("c"), F.sum("pos").alias("pos"))
        freq = F.col("c") / n
        spread = F.sqrt(F.lit(share * (1 - share)) * F.greatest(freq * (1 - freq), F.lit(1 / n)))
        z = F.abs(F.col("pos") - share * F.col("c")) / n * float(np.sqrt(n)) / spread
        rows = words.withColumn("z", z).where(F.col("z") >= min_z).orderBy(F.col("z").desc(), "h").limit(most).select("h").collect()
        picked = np.array([r["h"] for r in rows], np.int64).view(np.uint64)
    return np.unique(np.concatenate([picked, hash_of(IDENTITY)]))


def design(chosen: DataFrame, feature: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(y, rows, cols) of the sample in a fixed order: two bytes per feature of a document reach the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = [np.flatnonzero(np.isin(feature, np.frombuffer(x, np.uint64))).astype(np.uint16).tobytes() for x in b.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(out, pa.binary())], names=["order", "y", "cols"])

    got = chosen.select("order", "y", "words").mapInArrow(run, "order bigint, y double, cols binary").collect()
    got.sort(key=lambda r: (r["order"], bytes(r["cols"])))
    cols = [np.frombuffer(r["cols"], np.uint16).astype(np.int64) for r in got]
    return (np.array([r["y"] for r in got]), np.repeat(np.arange(len(got)), [len(c) for c in cols]),
            np.concatenate(cols) if cols else np.zeros(0, np.int64))


def scores(docs: DataFrame, labels: DataFrame, text: str = "text", id_col: str = "doc_id", label: str = "toxic",
           label_id: str = "doc_id", limit: int = LIMIT, folds: int = FOLDS, held: int = HELD,
           threshold: float = 0.3, min_z: float = MIN_Z, most: int = MAX_FEATURES,
           counterfactual: float = COUNTERFACTUAL) -> DataFrame:
    """Per row: id, held_out, score (0 to 1), predicted."""
    chosen = sample(docs, labels, text, id_col, label, label_id, limit, folds, held)
    feature = features(chosen, min_z, most)
    terms = np.searchsorted(feature, hash_of(IDENTITY))
    weight, intercept = fit(*design(chosen, feature), terms, len(feature), counterfactual)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for a, w in word_sets(b.column(1)):
                n = len(w.count)
                logit = np.full(n, intercept)
                if len(feature):
                    at = np.minimum(np.searchsorted(feature, w.hash), len(feature) - 1)
                    hit = np.flatnonzero(feature[at] == w.hash)
                    pair = np.unique(w.row[hit] * len(feature) + at[hit])  # a word counts once a document
                    logit += np.bincount(pair // len(feature), weights=weight[pair % len(feature)], minlength=n)
                p = np.round(1 / (1 + np.exp(-np.clip(logit, -30, 30))), 6)
                yield pa.RecordBatch.from_arrays([b.column(0).slice(a, n), pa.array(p)], names=["id", "score"])

    rows = docs.select(F.col(id_col).alias("id"), F.col(text).cast("string").alias("t"))
    out = rows.mapInArrow(score, passed_through(rows.select("id"), "score double"))
    return out.select(F.col("id").alias(id_col), (crc_mod("id", folds) == held).alias("held_out"), "score",
                      (F.col("score") >= threshold).cast("int").alias("predicted"))
