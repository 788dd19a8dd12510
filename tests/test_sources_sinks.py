"""SRC3-SRC5 readers and SNK1-SNK5 writers."""
import json

from authsift.operators.evaluate import verdict_histogram
from authsift.sources.sinks import (append_case_updates, write_blocklist, write_feedback,
                                    write_iocs, write_results)
from authsift.sources.tables import read_intel, read_labels, read_results


def test_read_intel_object(spark, tmp):
    path = f"{tmp}/intel.json"
    with open(path, "w") as f:
        json.dump({"1.2.3.4": {"geo": "XX — Hanoi (AS1)", "reputation": "malicious",
                               "tags": ["a", "b"], "reports_90d": 3},
                   "5.6.7.8": {"reputation": None}}, f, indent=2)
    rows = {r["ip"]: r for r in read_intel(spark, path).collect()}
    assert rows["1.2.3.4"]["tags"] == ["a", "b"] and rows["1.2.3.4"]["reports_90d"] == 3
    assert rows["5.6.7.8"]["reputation"] is None and rows["5.6.7.8"]["geo"] is None


def test_read_labels_last_wins_and_missing(spark, tmp):
    path = f"{tmp}/labels.csv"
    with open(path, "w") as f:
        f.write("src_ip,verdict,notes\n1.1.1.1,true_positive,x\n2.2.2.2,false_positive,y\n"
                "1.1.1.1,false_positive,z\n")
    got = {r["src_ip"]: (r["verdict"], r["notes"]) for r in read_labels(spark, path).collect()}
    assert got == {"1.1.1.1": ("false_positive", "z"), "2.2.2.2": ("false_positive", "y")}
    assert read_labels(spark, f"{tmp}/absent.csv").count() == 0
    assert read_labels(spark, None).count() == 0


def test_results_round_trip(spark, tmp):
    rows = [(1, "1.1.1.1", "true_positive", "high", 85, "T1110", "Brute Force", "s", ["a", "b"]),
            (2, "2.2.2.2", "false_positive", "informational", 80, "N/A", "N/A", "t", ["c"])]
    df = spark.createDataFrame(rows, "rank long, src_ip string, verdict string, severity string, "
                                     "confidence int, mitre_technique_id string, "
                                     "mitre_technique_name string, summary string, "
                                     "recommended_actions array<string>")
    write_results(df, f"{tmp}/results")
    back = read_results(spark, f"{tmp}/results", multiline=False)
    assert {r["src_ip"]: r["recommended_actions"] for r in back.collect()} == \
        {"1.1.1.1": ["a", "b"], "2.2.2.2": ["c"]}
    with open(f"{tmp}/array.json", "w") as f:
        json.dump([{"src_ip": "9.9.9.9", "verdict": "needs_investigation", "severity": "medium",
                    "confidence": 50, "mitre_technique_id": "N/A",
                    "mitre_technique_name": "N/A", "summary": "x",
                    "recommended_actions": []}], f)
    arr = read_results(spark, f"{tmp}/array.json")
    assert [tuple(r) for r in verdict_histogram(arr).collect()] == [("needs_investigation", 1)]


def test_ioc_exports(spark, tmp):
    iocs = spark.createDataFrame([("1.1.1.1", "ipv4"), ("2.2.2.2", "ipv4")],
                                 "indicator string, type string")
    write_iocs(iocs, f"{tmp}/iocs")
    write_blocklist(iocs, f"{tmp}/block")
    assert spark.read.csv(f"{tmp}/iocs", header=True).count() == 2
    assert sorted(r[0] for r in spark.read.text(f"{tmp}/block").collect()) == ["1.1.1.1", "2.2.2.2"]


def test_append_case_updates(spark, tmp):
    from datetime import datetime
    u = spark.createDataFrame([("d1", "1.1.1.1", "status", "Closed", datetime(2026, 1, 1), 1)],
                              "dataset string, src_ip string, field string, value string, "
                              "updated_at timestamp, update_id long")
    append_case_updates(u, f"{tmp}/cases")
    append_case_updates(u.withColumn("update_id", u.update_id + 1), f"{tmp}/cases")
    assert spark.read.parquet(f"{tmp}/cases").where("dataset = 'd1'").count() == 2


def test_feedback_csv(spark, tmp):
    fb = spark.createDataFrame([("d", "1.1.1.1", "true_positive", "👍 agree", "ok")],
                               "dataset string, src_ip string, ai_verdict string, "
                               "analyst_feedback string, notes string")
    write_feedback(fb, f"{tmp}/fb")
    back = spark.read.csv(f"{tmp}/fb", header=True).collect()
    assert back[0]["analyst_feedback"] == "👍 agree"
