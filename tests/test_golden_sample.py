"""Golden results, worked out by hand, for our own 29-line log of 9 sources."""
import pytest
from pyspark.sql import functions as F

from authsift.operators import analytics as A
from authsift.operators import evaluate as EV
from authsift.operators.correlate import correlate, raw_evidence, source_values
from authsift.operators.enrich import enrich
from authsift.operators.parse import parse_audit, parse_events
from authsift.operators.rank import queue_rows, rank_results
from authsift.operators.rules import triage_rules
from authsift.sources.auth_log import read_auth_log
from authsift.sources.tables import read_labels
from conftest import fixture

EXPECTED = [
    # rank, ip, failed, accepted, invalid, users, saf, first, last, internal, reputation,
    # verdict, severity, confidence, technique
    (1, "198.51.100.77", 3, 1, 0, "backupd", True, "Mar  3 22:01:10", "Mar  3 22:01:40", False,
     "no records", "true_positive", "critical", 90, "T1110.001"),
    (2, "91.240.118.172", 4, 0, 2, "demo,root", False, "Mar  3 22:10:02", "Mar  3 22:10:16", False,
     "malicious", "true_positive", "high", 90, "T1110"),
    (3, "172.16.4.8", 4, 0, 0, "anna,ben,cora,dirk", False, "Mar  4 00:30:10", "Mar  4 00:30:20",
     True, "no records", "true_positive", "high", 75, "T1110.003"),
    (4, "203.0.113.9", 3, 0, 2, "cam1,cam2,root", False, "Mar  3 23:05:01", "Mar  3 23:05:07",
     False, "no records", "true_positive", "high", 70, "T1110"),
    (5, "192.0.2.61", 1, 0, 0, "visitor", False, "Mar  4 01:00:00", "Mar  4 01:00:00", False,
     "no records", "needs_investigation", "medium", 50, "N/A"),
    (6, "192.0.2.99", 0, 0, 0, "", False, "Mar  4 01:10:00", "Mar  4 01:10:00", False,
     "no records", "needs_investigation", "medium", 50, "N/A"),
    (7, "192.0.2.50", 0, 0, 0, "", False, "Mar  3 23:20:00", "Mar  3 23:20:04", False,
     "no records", "true_positive", "low", 75, "T1595"),
    (8, "10.20.0.4", 0, 2, 0, "robot", False, "Mar  3 20:00:00", "Mar 14 06:00:00", True,
     "no records", "false_positive", "informational", 80, "N/A"),
    (9, "10.20.0.3", 1, 1, 0, "lena", True, "Mar  3 23:59:60", "Mar  4 00:00:02", True,
     "no records", "false_positive", "informational", 80, "N/A"),
]
HOSTS = {"198.51.100.77": ["gate7"], "91.240.118.172": ["mail1"], "172.16.4.8": ["gate7"],
         "203.0.113.9": ["gate7", "mail1"], "192.0.2.61": ["mail1"], "192.0.2.99": ["mail1"],
         "192.0.2.50": ["gate7", "mail1"], "10.20.0.4": ["gate7"], "10.20.0.3": ["gate7"]}


@pytest.fixture(scope="module")
def sample(spark):
    lines = read_auth_log(spark, fixture("sample_auth.log"), "sample")
    events = parse_events(lines).cache()
    alerts = enrich(correlate(events)).cache()
    ranked = rank_results(triage_rules(alerts)).cache()
    return lines, events, alerts, ranked


def test_parse_counts(sample):
    lines, events, _, _ = sample
    assert lines.count() == 29
    assert events.count() == 25
    audit = {r["action"]: r["lines"] for r in parse_audit(lines).collect()}
    assert audit == {"total": 29, "failed": 16, "accepted": 4, "max_auth": 1,
                     "preauth_disconnect": 2, "probe": 2, "dropped": 4}


def test_alerts_verdicts_and_rank(sample):
    _, _, alerts, ranked = sample
    a = {r["src_ip"]: r for r in alerts.collect()}
    got = []
    for r in ranked.orderBy("rank").collect():
        al = a[r["src_ip"]]
        got.append((r["rank"], r["src_ip"], al["failed_logins"], al["successful_logins"],
                    al["invalid_user_attempts"], ",".join(al["usernames_targeted"]),
                    al["success_after_failures"], al["first_seen"], al["last_seen"],
                    al["internal_source"], al["reputation"], r["verdict"], r["severity"],
                    r["confidence"], r["mitre_technique_id"]))
    assert got == EXPECTED
    assert {ip: r["hosts_targeted"] for ip, r in a.items()} == HOSTS
    other = {ip: (r["max_auth_exceeded_events"], r["preauth_disconnects"],
                  r["connection_probes_no_auth"]) for ip, r in a.items()}
    assert {ip: n for ip, n in other.items() if any(n)} == {
        "91.240.118.172": (1, 1, 0), "192.0.2.99": (0, 1, 0), "192.0.2.50": (0, 0, 2)}


def test_queue_rows(sample):
    rows = queue_rows(sample[3]).orderBy("rank").collect()
    assert rows[0]["severity"] == "CRITICAL" and rows[0]["confidence"] == "90%"
    assert rows[0]["attack"] == "Brute Force: Password Guessing (T1110.001)"
    assert rows[4]["verdict"] == "needs investigation" and rows[4]["attack"] == "unclear pattern"
    assert rows[6]["attack"] == "Active Scanning (T1595)"
    assert rows[8]["verdict"] == "false positive" and rows[8]["attack"] == "benign activity"


def test_evaluation(spark, sample):
    ranked = sample[3]
    labels = read_labels(spark, fixture("labels.csv"))
    pr = EV.precision_recall(ranked, labels).collect()[0]
    assert (pr["precision"], pr["recall"], pr["dangerous_misses"]) == (0.8, 0.571429, 1)
    assert (pr["flagged"], pr["true_positives"], pr["false_alarms"]) == (5, 4, 1)
    assert (pr["benign_cleared"], pr["punted_attacks"], pr["punted_benign"]) == (1, 1, 0)
    assert pr["labelled_attacks"] == 7 and pr["labelled_benign"] == 2
    assert [r["src_ip"] for r in EV.dangerous_misses(ranked, labels).collect()] == ["10.20.0.4"]
    assert {(r["src_ip"], r["predicted"]) for r in EV.disagreements(ranked, labels).collect()} == {
        ("192.0.2.50", "true_positive"), ("192.0.2.61", "needs_investigation"),
        ("10.20.0.4", "false_positive"), ("192.0.2.200", "missing")}
    summary = EV.label_summary(labels).collect()[0]
    assert (summary["labels"], summary["attacks"], summary["benign"], summary["hard_cases"]) == (9, 7, 2, 3)


def test_timeline(sample):
    _, events, _, ranked = sample
    t = {(r["hour"].day, r["hour"].hour, r["severity"]): r["events"]
         for r in A.timeline(events, ranked).collect()}
    # second 60 of March 3rd is midnight
    assert t == {(3, 20, "informational"): 1, (3, 22, "critical"): 4, (3, 22, "high"): 6,
                 (3, 23, "high"): 3, (3, 23, "low"): 2, (4, 0, "informational"): 2,
                 (4, 0, "high"): 4, (4, 1, "medium"): 2, (14, 6, "informational"): 1}
    assert sum(t.values()) == 25


def test_matrix_origins_entities(sample):
    _, events, alerts, ranked = sample
    pairs = source_values(events)
    m = {r["technique_id"]: (r["tactic"], r["alerts"]) for r in A.attack_matrix(ranked).collect()}
    assert m == {"T1110": ("Credential Access", 2), "T1110.001": ("Credential Access", 1),
                 "T1110.003": ("Credential Access", 1), "T1595": ("Reconnaissance", 1)}
    o = {r["city"]: (r["attacks"], r["radius"]) for r in A.attack_origins(ranked, alerts).collect()}
    assert o == {c: (1, 220000.0) for c in ["Moscow", "Shenzhen", "St. Petersburg"]}
    acc = A.top_accounts(ranked, pairs).collect()
    assert [(r["account"], r["attacking_sources"]) for r in acc] == [("root", 2)] + [
        (u, 1) for u in ("anna", "backupd", "ben", "cam1", "cam2", "cora", "demo", "dirk")]
    assert [(r["host"], r["attack_alerts"]) for r in A.top_hosts(ranked, pairs).collect()] == \
        [("gate7", 4), ("mail1", 3)]
    assert A.iocs(ranked, alerts).count() == 4
    sev = {r["severity"]: r["alerts"] for r in A.severity_counts(ranked).collect()}
    assert sev == {"critical": 1, "high": 3, "medium": 2, "low": 1, "informational": 2}
    qm = A.queue_metrics(ranked).collect()[0]
    assert (qm["alerts"], qm["confirmed_attacks"], qm["cleared_benign"], qm["critical"]) == \
        (9, 5, 2, 1)
    assert qm["needs_review"] == 2


def test_raw_evidence_order(sample):
    _, events, _, _ = sample
    ev = raw_evidence(events).where(F.col("src_ip") == "10.20.0.3").orderBy("line_no").collect()
    assert [r["line_no"] for r in ev] == [1, 2]
    assert "Failed password" in ev[0]["raw"] and "Accepted password" in ev[1]["raw"]


def test_run_batch_writes_tables(spark, tmp):
    from authsift.plans.pipeline import run_batch
    lines = read_auth_log(spark, fixture("sample_auth.log"), "sample")
    paths = run_batch(lines, f"{tmp}/out")
    res = spark.read.json(paths["results"]).orderBy("rank").collect()
    assert [r["src_ip"] for r in res] == [e[1] for e in EXPECTED]
    assert spark.read.parquet(paths["events"]).count() == 25
    assert sorted(r[0] for r in spark.read.text(paths["blocklist"]).collect()) == \
        sorted(["198.51.100.77", "91.240.118.172", "203.0.113.9", "192.0.2.50"])
    assert spark.read.csv(paths["iocs"], header=True).count() == 4
