r"""Quality classifier: random Fourier features, ridge regression, isotonic calibration.

A document becomes 15 statistics of its whole text (``textstats.FEATURES``).  256
random Fourier features cos(w x + b) of the standardised statistics approximate a
Gaussian kernel.  The labelled training rows' normal equations are summed within
partitions and over them by Spark (row by row of the matrix), so the driver gets
one 257 x 257 matrix whatever the number of labels.  The ridge scores of a training
fold that the regression hasn't seen are calibrated by isotonic regression over
at most 2,001 score bins.

Training uses every labelled row whose crc32(id) mod ``folds`` is not ``held``; of
those, the fold (held + 1) mod folds calibrates.

Edge cases: null and empty texts have all-zero statistics and are scored like any
other; null labels are left out, several labels of an id count by their maximum; a
null id has no label; without any usable label every score is 0.5; with no row in
the calibrating fold the ridge scores are clipped to 0..1; repeated rows each get a
result, ties of the ridge score the same one; very long texts give their statistics slice by
slice of whole rows; extra columns, also with clashing names, are ignored; an empty table
gives an empty result.
"""
from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from authsift.llm import textarrays as ta
from authsift.llm import textstats as ts
from authsift.llm.common import crc_mod, passed_through, saved

WIDTH, BANDWIDTH, RIDGE = 256, 4.0, 1e-3
FOLDS, HELD = 5, 0
BINS = 1000
PARTS = 64
"""Partitions that sum the normal equations: bounds what meets in one task."""
N = len(ts.FEATURES)


def statistics(docs: DataFrame, text: str = "text", id_col: str = "doc_id") -> DataFrame:
    """(id, x): the statistics of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for a, e, data, offs in ta.slices(b.column(1)):
                x = ts.features(data, offs).astype(np.float32)
                yield pa.RecordBatch.from_arrays(
                    [b.column(0).slice(a, e - a),
                     pa.ListArray.from_arrays(pa.array(np.arange(0, x.size + 1, N, dtype=np.int32)), pa.array(x.ravel()))],
                    names=["id", "x"])

    rows = docs.select(F.col(id_col).alias("id"), F.col(text).cast("string").alias("t"))
    return rows.mapInArrow(run, passed_through(rows.select("id"), "x array<float>"))


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy().astype(np.float64).reshape(-1, N)


def _fourier(x: np.ndarray, mean: np.ndarray, scale: np.ndarray) -> np.ndarray:
    """Random Fourier features and a constant."""
    rng = np.random.default_rng(3)
    w = rng.normal(size=(N, WIDTH)) / BANDWIDTH
    shift = rng.uniform(0, 2 * np.pi, WIDTH)
    z = np.clip((x - mean) / scale, -8, 8) @ w + shift
    return np.concatenate([np.cos(z) * np.sqrt(2 / WIDTH), np.ones((len(x), 1))], axis=1)


def _ridge(train: DataFrame, mean: np.ndarray, scale: np.ndarray) -> np.ndarray | None:
    """Weights from the normal equations, summed per partition and then per matrix row."""
    size = WIDTH + 1

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((size, size + 1))
        for b in batches:
            if b.num_rows:
                z = _fourier(_matrix(b.column(0)), mean, scale)
                total += z.T @ np.concatenate([z, b.column(1).to_numpy().astype(float)[:, None]], axis=1)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(size, dtype=np.int32)), pa.array([r.tobytes() for r in total], pa.binary())],
                                         names=["i", "row"])

    def added(key, rows):
        import pandas as pd
        total = np.sum([np.frombuffer(x) for x in sorted(rows["row"])], axis=0)
        return pd.DataFrame({"i": [key[0]], "row": [total.tobytes()]})

    rows = train.select("x", "y").repartition(PARTS).mapInArrow(summed, "i int, row binary") \
        .groupBy("i").applyInPandas(added, "i int, row binary").collect()
    m = np.stack([np.frombuffer(r["row"]) for r in sorted(rows, key=lambda r: r["i"])]) if rows else None
    if m is None or m[-1, size - 1] == 0:
        return None
    gram, target = m[:, :size], m[:, size]
    return np.linalg.solve(gram + RIDGE * m[-1, size - 1] * np.eye(size) / WIDTH, target)


def isotonic(x: np.ndarray, total: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Pool adjacent violators: the non-decreasing fit of total / weight at ascending x."""
    blocks: list[list[float]] = []
    for t, w in zip(total, weight):
        blocks.append([t, w, 1])
        while len(blocks) > 1 and blocks[-2][0] * blocks[-1][1] >= blocks[-1][0] * blocks[-2][1]:
            t2, w2, n2 = blocks.pop()
            blocks[-1][0] += t2
            blocks[-1][1] += w2
            blocks[-1][2] += n2
    return np.concatenate([np.full(int(n), t / w) for t, w, n in blocks]) if blocks else np.zeros(0)


def scores(docs: DataFrame, labels: DataFrame, text: str = "text", id_col: str = "doc_id", label: str = "quality",
           label_id: str = "doc_id", folds: int = FOLDS, held: int = HELD, threshold: float = 0.3) -> DataFrame:
    """Per row: id, held_out, score (0 to 1), predicted."""
    x = saved(statistics(docs, text, id_col))
    y = labels.where(F.col(label).isNotNull()).groupBy(F.col(label_id).alias("id")).agg(F.max(F.col(label).cast("double")).alias("y"))
    train = x.join(y, "id").withColumn("fold", crc_mod("id", folds)).where(F.col("fold") != held).select("x", "y", "fold")
    train = saved(train)
    fit = train.where(F.col("fold") != (held + 1) % folds)
    moments = fit.select(*(f(F.col("x")[k]).alias(f"{n}{k}") for k in range(N) for n, f in (("m", F.avg), ("s", F.stddev_pop)))).first()
    weights = None
    if moments["m0"] is not None:
        mean = np.array([moments[f"m{k}"] for k in range(N)])
        scale = np.maximum([moments[f"s{k}"] for k in range(N)], 1e-6)
        weights = _ridge(fit, mean, scale)
    knots = None
    if weights is not None:
        def raw(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                s = np.clip(_fourier(_matrix(b.column(0)), mean, scale) @ weights, -0.5, 1.5)
                yield pa.RecordBatch.from_arrays([pa.array(np.rint(s * BINS).astype(np.int32)), b.column(1)], names=["bin", "y"])

        bins = train.where(F.col("fold") == (held + 1) % folds).select("x", "y").mapInArrow(raw, "bin int, y double") \
            .groupBy("bin").agg(F.sum("y").alias("y"), F.count(F.lit(1)).alias("n")).orderBy("bin").collect()
        if bins:
            at = np.array([r["bin"] for r in bins]) / BINS
            knots = at, isotonic(at, np.array([r["y"] for r in bins]), np.array([float(r["n"]) for r in bins]))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            s = np.full(b.num_rows, 0.5)
            if weights is not None and b.num_rows:
                s = _fourier(_matrix(b.column(1)), mean, scale) @ weights
                s = np.interp(s, *knots) if knots is not None else s
            s = np.round(np.clip(s, 0, 1), 6)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(s)], names=["id", "score"])

    out = x.mapInArrow(score, passed_through(x.select("id"), "score double"))
    return out.select(F.col("id").alias(id_col), (crc_mod("id", folds) == held).alias("held_out"), "score",
                      (F.col("score") >= threshold).cast("int").alias("predicted"))
