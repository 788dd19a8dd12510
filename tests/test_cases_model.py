"""CASE1-CASE5, ANA14-ANA15 and MOD1-MOD4."""
import json
from datetime import datetime

import pandas as pd
import pytest

from authsift.operators import cases as CS
from authsift.operators import model_io as M
from authsift.operators.dims import CASE_FIELDS

SCHEMA = CS.UPDATE_SCHEMA


def _updates(spark, rows):
    return spark.createDataFrame(
        [("d", ip, f, v, datetime(2026, 6, 9, 10, m), i) for i, (ip, f, v, m) in enumerate(rows)],
        SCHEMA)


def test_field_merge_and_clear(spark):
    u = _updates(spark, [("1.1.1.1", "status", "Investigating", 0),
                         ("1.1.1.1", "assignee", "ana", 1),
                         ("1.1.1.1", "status", "Closed", 2),
                         ("1.1.1.1", "assignee", None, 3),        # explicit null clears
                         ("2.2.2.2", "feedback", CS.AGREE, 4),
                         ("3.3.3.3", "feedback", CS.DISAGREE, 5)])
    st = {r["src_ip"]: r for r in CS.case_state(u).collect()}
    assert st["1.1.1.1"]["status"] == "Closed" and st["1.1.1.1"]["assignee"] is None
    assert st["1.1.1.1"]["updated_at"] == datetime(2026, 6, 9, 10, 3)
    counts = CS.feedback_counts(CS.case_state(u)).collect()[0]
    assert (counts["agree"], counts["disagree"]) == (1, 1)


def test_merge_is_idempotent(spark):
    u = _updates(spark, [("1.1.1.1", "status", "Closed", 0), ("1.1.1.1", "notes", "n", 1)])
    st = CS.case_state(u)
    long = st.selectExpr("dataset", "src_ip", "stack(4, " + ", ".join(
        f"'{f}', {f}" for f in CASE_FIELDS) + ") as (field, value)", "updated_at") \
        .where("value is not null").selectExpr("*", "0L as update_id")
    again = CS.case_state(long)
    cols = ["src_ip", *CASE_FIELDS]
    assert sorted(map(tuple, again.select(*cols).collect())) == \
        sorted(map(tuple, st.select(*cols).collect()))


def test_defaults_and_fingerprint(spark, tmp):
    alerts = spark.createDataFrame([("d", "1.1.1.1"), ("d", "9.9.9.9")], "dataset string, src_ip string")
    st = CS.case_state(_updates(spark, [("1.1.1.1", "status", "Contained", 0)]))
    got = {r["src_ip"]: (r["status"], r["assignee"], r["notes"])
           for r in CS.with_case_defaults(alerts, st).collect()}
    assert got == {"1.1.1.1": ("Contained", "", ""), "9.9.9.9": ("New", "", "")}
    import hashlib
    text = "line one\nline two\n"
    with open(f"{tmp}/a.log", "w") as f:
        f.write(text)
    from authsift.sources.auth_log import read_log_text
    fp = CS.dataset_fingerprint(read_log_text(spark, f"{tmp}/a.log")).collect()[0]
    assert fp["dataset_key"] == hashlib.sha1(text.encode()).hexdigest()[:12]


def test_validate_responses(spark):
    good = {"src_ip": "1.1.1.1", "verdict": "true_positive", "severity": "high", "confidence": 85,
            "mitre_technique_id": "T1110", "mitre_technique_name": "Brute Force",
            "summary": "s", "recommended_actions": ["a"]}
    bad_conf = dict(good, confidence=140)
    bad_verdict = dict(good, verdict="maybe")
    rows = [("a", json.dumps(good)), ("b", json.dumps(bad_conf)), ("c", json.dumps(bad_verdict)),
            ("d", "not json")]
    df = spark.createDataFrame(rows, "custom_id string, response string")
    valid, rejected = M.validate_responses(df)
    assert valid.count() == 1
    assert sorted(r["custom_id"] for r in rejected.collect()) == ["b", "c", "d"]
    with pytest.raises(ValueError):
        M.validate_responses(df, strict=True)


def test_scorer_and_requests(spark):
    alerts = spark.createDataFrame([("1.1.1.1", 5, 0), ("2.2.2.2", 0, 1)],
                                   "src_ip string, failed_logins long, successful_logins long")

    def scorer(pdf: pd.DataFrame) -> pd.DataFrame:
        attack = pdf["failed_logins"] >= 4
        return pd.DataFrame({
            "src_ip": pdf["src_ip"],
            "verdict": attack.map({True: "true_positive", False: "false_positive"}),
            "severity": attack.map({True: "high", False: "informational"}),
            "confidence": 70, "mitre_technique_id": "N/A", "mitre_technique_name": "N/A",
            "summary": "", "recommended_actions": [[] for _ in range(len(pdf))]})
    out = {r["src_ip"]: r["verdict"] for r in M.score_with(alerts, scorer, 2).collect()}
    assert out == {"1.1.1.1": "true_positive", "2.2.2.2": "false_positive"}
    req = M.model_requests(alerts, "m", "sys").collect()
    body = json.loads(req[0]["body"])
    assert body["model"] == "m" and body["messages"][0]["role"] == "user"
    assert body["messages"][0]["content"].startswith("Assess this authentication alert (JSON):\n")
