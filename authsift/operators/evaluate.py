"""EVAL1-EVAL11: triage results against labelled truth.

Set algebra of the reference becomes one full outer join of results and
labels plus conditional counts.  ``results`` needs ``src_ip, verdict``; ``labels``
needs ``src_ip, verdict`` (as ``truth``).  Where both carry a ``dataset``, a label
holds for its own dataset only (EVAL10); labels without one hold for every dataset.
Precision counts every flagged result (labelled or not) in its denominator;
recall counts every labelled attack (punted and missing ones too).
"""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TP, FP, NI = "true_positive", "false_positive", "needs_investigation"


def _one(df: DataFrame, keys: list[str]) -> DataFrame:
    """EVAL10: one verdict per key, the last by the table's own
    order column (``seq``, ``_seq``, ``last_seq``), else the largest text."""
    order = next((c for c in ("seq", "_seq", "last_seq") if c in df.columns), "verdict")
    return df.groupBy(*keys).agg(F.max_by("verdict", order).alias("verdict"))


def label_keys(results: DataFrame, labels: DataFrame) -> list[str]:
    """What identifies an alert in both tables."""
    return [k for k in ("dataset", "src_ip") if k in results.columns and k in labels.columns]


def _sides(results: DataFrame, labels: DataFrame) -> tuple[DataFrame, DataFrame, list[str]]:
    keys = label_keys(results, labels)
    return (_one(results, keys).withColumnRenamed("verdict", "predicted"),
            _one(labels, keys).withColumnRenamed("verdict", "truth"), keys)


def _joined(results: DataFrame, labels: DataFrame) -> DataFrame:
    r, lab, keys = _sides(results, labels)
    return r.join(lab, keys, "full")


def confusion(results: DataFrame, labels: DataFrame) -> DataFrame:
    """EVAL1: labelled results by (truth, predicted)."""
    j = _joined(results, labels).where(F.col("truth").isNotNull()
                                           & F.col("predicted").isNotNull())
    return j.groupBy("truth", "predicted").agg(F.count(F.lit(1)).alias("alerts"))


def _metrics(j: DataFrame, by: list[str]) -> DataFrame:
    t, p = F.col("truth"), F.col("predicted")
    flagged = F.count_if(p == TP)
    tp = F.count_if((p == TP) & (t == TP))
    attacks = F.count_if(t == TP)
    agg = j.groupBy(*by).agg(
        flagged.alias("flagged"), tp.alias("true_positives"),
        F.count_if((p == TP) & (t == FP)).alias("false_alarms"),
        F.count_if((p == FP) & (t == TP)).alias("dangerous_misses"),
        F.count_if((p == FP) & (t == FP)).alias("benign_cleared"),
        F.count_if((p == NI) & (t == TP)).alias("punted_attacks"),
        F.count_if((p == NI) & (t == FP)).alias("punted_benign"),
        attacks.alias("labelled_attacks"),
        F.count_if(t == FP).alias("labelled_benign"))
    ratio = lambda a, b: F.round(F.coalesce(F.col(a) / F.nullif(F.col(b), F.lit(0)),
                                            F.lit(0.0)), 6)
    return agg.select("*", ratio("true_positives", "flagged").alias("precision"),
                      ratio("true_positives", "labelled_attacks").alias("recall"))


def precision_recall(results: DataFrame, labels: DataFrame) -> DataFrame:
    """EVAL2, EVAL3, EVAL5: precision, recall and the outcome counts (one row)."""
    return _metrics(_joined(results, labels), [])


def engine_compare(results_by_engine: DataFrame, labels: DataFrame) -> DataFrame:
    """EVAL11: the same metrics per ``engine`` side by side."""
    keys = label_keys(results_by_engine, labels)
    lab = _one(labels, keys).withColumnRenamed("verdict", "truth")
    r = _one(results_by_engine, ["engine", *keys]).withColumnRenamed("verdict", "predicted")
    per = _metrics(r.join(lab, keys, "left"), ["engine"])
    # every engine is held against all labels, also those it has no result for
    totals = lab.agg(F.count_if(F.col("truth") == TP).alias("_attacks"),
                     F.count_if(F.col("truth") == FP).alias("_benign")).withColumn("_one", F.lit(1))
    cols = per.columns
    recall = F.round(F.coalesce(F.col("true_positives") / F.nullif(F.col("_attacks"), F.lit(0)),
                                F.lit(0.0)), 6)
    return (per.withColumn("_one", F.lit(1)).join(totals, "_one")
            .withColumn("labelled_attacks", F.col("_attacks"))
            .withColumn("labelled_benign", F.col("_benign"))
            .withColumn("recall", recall).select(*cols))


def dangerous_misses(results: DataFrame, labels: DataFrame) -> DataFrame:
    """EVAL4: attacks explicitly cleared as benign, sorted."""
    j = _joined(results, labels)
    return j.where((F.col("predicted") == FP) & (F.col("truth") == TP)) \
        .select("src_ip").orderBy("src_ip")


def verdict_histogram(results: DataFrame) -> DataFrame:
    """EVAL6: results per verdict."""
    return results.groupBy("verdict").agg(F.count(F.lit(1)).alias("alerts"))


def disagreements(results: DataFrame, labels: DataFrame) -> DataFrame:
    """EVAL7: labels whose prediction differs, missing predictions included."""
    r, lab, keys = _sides(results, labels)
    j = lab.join(r, keys, "left").withColumn(
        "predicted", F.coalesce("predicted", F.lit("missing")))
    return j.where(F.col("predicted") != F.col("truth")).select(*keys, "truth", "predicted")


def label_match(results: DataFrame, labels: DataFrame) -> DataFrame:
    """EVAL8: per-label result rows with a match flag."""
    r, lab, keys = _sides(results, labels)
    j = lab.join(r, keys, "left").withColumn(
        "predicted", F.coalesce("predicted", F.lit("missing")))
    return j.select(*keys, "truth", "predicted",
                    (F.col("predicted") == F.col("truth")).alias("match"))


def label_summary(labels: DataFrame, hard_marker: str = "HARD") -> DataFrame:
    """EVAL9: label counts: all, attacks, benign, hard cases."""
    v = F.col("verdict")
    return labels.agg(F.count(F.lit(1)).alias("labels"),
                      F.count_if(v == TP).alias("attacks"),
                      F.count_if(v != TP).alias("benign"),
                      F.count_if(F.col("notes").startswith(hard_marker)).alias("hard_cases"))
