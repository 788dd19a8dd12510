"""Duplicate feed rows, duplicate results, an empty comparison, ties in one millisecond, broken feeds."""
import pytest
from pyspark.sql import functions as F

from authsift.operators.correlate import correlate
from authsift.operators.evaluate import engine_compare, precision_recall
from authsift.sources.logon_export import logon_events
from authsift.sources.tables import read_intel


def test_duplicate_results_count_once(spark):
    results = spark.createDataFrame([("9.9.9.9", "false_positive", 1), ("9.9.9.9", "true_positive", 2)],
                                    "src_ip string, verdict string, seq bigint")
    labels = spark.createDataFrame([("9.9.9.9", "true_positive")], "src_ip string, verdict string")
    row = precision_recall(results, labels).first()
    assert (row["flagged"], row["true_positives"], row["labelled_attacks"]) == (1, 1, 1)


def test_engine_compare_counts_labels_without_results(spark):
    labels = spark.createDataFrame([("1.1.1.1", "true_positive"), ("2.2.2.2", "true_positive")], "src_ip string, verdict string")
    results = spark.createDataFrame([("a", "1.1.1.1", "true_positive"), ("b", "1.1.1.1", "false_positive")],
                                    "engine string, src_ip string, verdict string")
    got = {r["engine"]: (r["recall"], r["labelled_attacks"], r["dangerous_misses"]) for r in engine_compare(results, labels).collect()}
    assert got == {"a": (0.5, 2, 0), "b": (0.0, 2, 1)}
    assert engine_compare(results.limit(0), labels).count() == 0


def test_ties_keep_the_arrival_order_beyond_two_million(spark):
    t = "2026-01-05T08:00:00.000+00:00"
    rows = [(1 << 21, "4624"), ((1 << 21) - 1, "4625"), ((5 << 40) + 7, "4624"), ((4 << 40) + 9, "4625")]
    df = spark.createDataFrame([(a, t, "h", c, "u", f"10.0.0.{k // 2}", "3", None) for k, (a, c) in enumerate(rows)],
                               "_arrival bigint, _time string, host string, EventCode string, account string, src string, Logon_Type string, Sub_Status string")
    got = {r["src_ip"]: r["success_after_failures"] for r in correlate(logon_events(df, "d")).collect()}
    assert got == {"10.0.0.0": True, "10.0.0.1": True}


def test_broken_feed_is_an_error(spark, tmp):
    path = f"{tmp}/intel.json"
    with open(path, "w") as f:
        f.write('{"1.2.3.4": {"geo": "x", "repu')
    with pytest.raises(Exception):
        read_intel(spark, path).select(F.count("ip")).collect()
