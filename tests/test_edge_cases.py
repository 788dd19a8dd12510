"""Edge cases of FIXTURES §5."""
import pytest
from pyspark.sql import functions as F

from authsift.functions.ipv4 import is_internal
from authsift.operators.correlate import correlate
from authsift.operators.enrich import enrich
from authsift.operators.evaluate import precision_recall
from authsift.operators.parse import parse_events
from authsift.operators.rules import triage_rules
from authsift.sources.auth_log import read_auth_log

PFX = "Jun  9 10:00:{s:02d} web-01 sshd[1]: "


def _log(tmp, msgs):
    path = f"{tmp}/auth.log"
    with open(path, "w") as f:
        for i, m in enumerate(msgs):
            f.write(PFX.format(s=i) + m + "\n")
    return path


def _alerts(spark, tmp, msgs, intel=None):
    ev = parse_events(read_auth_log(spark, _log(tmp, msgs), "t"))
    return ev, enrich(correlate(ev), intel=intel)


def test_max_auth_invalid_counts_invalid_not_failed(spark, tmp):
    ev, a = _alerts(spark, tmp, [
        "error: maximum authentication attempts exceeded for invalid user bob from 1.2.3.4 port 22 ssh2 [preauth]",
        "Disconnected from invalid user x 1.2.3.4 port 22 [preauth]"])
    r = a.collect()[0]
    assert (r["failed_logins"], r["invalid_user_attempts"], r["max_auth_exceeded_events"],
            r["preauth_disconnects"]) == (0, 1, 1, 1)
    assert r["usernames_targeted"] == ["bob", "x"]


@pytest.mark.parametrize("msgs,expected", [
    (["Accepted password for a from 1.2.3.4 port 22 ssh2",
      "Failed password for a from 1.2.3.4 port 22 ssh2"], False),
    (["Failed password for a from 1.2.3.4 port 22 ssh2",
      "Accepted password for b from 1.2.3.4 port 22 ssh2"], True),
])
def test_success_after_failures(spark, tmp, msgs, expected):
    assert _alerts(spark, tmp, msgs)[1].collect()[0]["success_after_failures"] is expected


def test_unrecognised_lines_dropped(spark, tmp):
    ev, _ = _alerts(spark, tmp, [
        "Invalid user oracle from 91.240.118.172 port 44102",
        "pam_unix(sshd:session): session opened for user deploy by (uid=0)",
        "Failed keyboard-interactive/pam for a from 1.2.3.4 port 22 ssh2",
        "Connection closed by 1.2.3.4 port 22",
        "Connection reset by authenticating user a 1.2.3.4 port 22 [preauth]",
        "Failed password for invalid user from 1.2.3.4 port 22 ssh2",
    ])
    # the last one has no user token after "invalid user ", so no pattern matches
    assert ev.count() == 0


def test_internal_ranges(spark):
    ips = ["172.15.0.1", "172.32.0.1", "192.0.2.1", "203.0.113.9", "::1", "host.example",
           "10.0.0.300", "010.0.0.1", "172.16.0.1", "172.31.255.254", "192.168.0.1",
           "10.255.255.255"]
    df = spark.createDataFrame([(i,) for i in ips], "ip string")
    got = {r["ip"]: r["internal"] for r in df.select("ip", is_internal(F.col("ip")).alias("internal")).collect()}
    assert [got[i] for i in ips] == [False] * 8 + [True] * 4


def test_dynamic_intel_null_reputation_wins(spark, tmp):
    intel = spark.createDataFrame(
        [("185.220.101.7", None, None, None, None)],
        "ip string, geo string, reputation string, tags array<string>, reports_90d int")
    _, a = _alerts(spark, tmp, ["Failed password for root from 185.220.101.7 port 22 ssh2"] * 4,
                   intel=intel)
    r = a.collect()[0]
    assert r["reputation"] is None
    assert r["geolocation"] == "DE — Frankfurt (Tor exit range)"  # prefix fallback
    t = triage_rules(a).collect()[0]
    assert (t["rule_id"], t["confidence"]) == (4, 70)  # NULL reputation is not malicious


@pytest.mark.parametrize("msgs,rule,conf", [
    (["Did not receive identification string from 1.2.3.4 port 22"], 6, 50),
    (["Failed password for a from 10.1.1.1 port 22 ssh2"] * 2
     + ["Failed password for b from 10.1.1.1 port 22 ssh2"] * 2, 6, 50),
    (["Failed password for a from 91.240.118.172 port 22 ssh2"] * 4
     + ["error: maximum authentication attempts exceeded for a from 91.240.118.172 port 22 ssh2"],
     4, 90),
])
def test_rule_edges(spark, tmp, msgs, rule, conf):
    t = triage_rules(_alerts(spark, tmp, msgs)[1]).collect()[0]
    assert (t["rule_id"], t["confidence"]) == (rule, conf)


def test_evaluation_edges(spark):
    res = spark.createDataFrame([("a", "true_positive"), ("b", "false_positive")],
                                "src_ip string, verdict string")
    lab = spark.createDataFrame([("b", "true_positive", ""), ("c", "true_positive", "")],
                                "src_ip string, verdict string, notes string")
    r = precision_recall(res, lab).collect()[0]
    # 'a' is flagged without a label (lowers precision); 'c' has no result (lowers recall)
    assert (r["precision"], r["recall"], r["dangerous_misses"]) == (0.0, 0.0, 1)
    empty = spark.createDataFrame([], "src_ip string, verdict string")
    r = precision_recall(empty, empty.withColumn("notes", F.lit(""))).collect()
    assert r[0]["precision"] == 0.0 and r[0]["recall"] == 0.0


def test_first_last_seen_exact_for_non_canonical_times(spark, tmp):
    """Texts that are not canonical syslog/ISO renderings stay exact."""
    path = f"{tmp}/odd.log"
    with open(path, "w") as f:
        f.write("Jun 09 03:01:42 h sshd[1]: Failed password for a from 5.5.5.5 port 22 ssh2\n")
        f.write("Jun 9 03:01:43 h sshd[2]: Failed password for a from 5.5.5.5 port 22 ssh2\n")
        f.write("Jun  9\t03:01:44 h sshd[3]: Failed password for a from 6.6.6.6 port 22 ssh2\n")
        f.write("Jun  9 03:01:45 h sshd[4]: Failed password for a from 6.6.6.6 port 22 ssh2\n")
    a = {r["src_ip"]: r for r in correlate(parse_events(read_auth_log(spark, path, "o"))).collect()}
    assert (a["5.5.5.5"]["first_seen"], a["5.5.5.5"]["last_seen"]) == \
        ("Jun 09 03:01:42", "Jun 9 03:01:43")
    assert (a["6.6.6.6"]["first_seen"], a["6.6.6.6"]["last_seen"]) == \
        ("Jun  9\t03:01:44", "Jun  9 03:01:45")
    # one user over canonical and non-canonical rows is listed once
    assert a["6.6.6.6"]["usernames_targeted"] == ["a"]
    assert a["6.6.6.6"]["hosts_targeted"] == ["h"]
    assert a["6.6.6.6"]["failed_logins"] == 2


def test_first_last_seen_iso_offsets(spark):
    from authsift.sources.logon_export import logon_events
    rows = [("2026-06-09T09:12:01.000+05:30", "4625", "a", "7.7.7.7"),
            ("2026-06-09T04:00:00Z", "4625", "b", "7.7.7.7"),
            ("2026-06-09T10:12:01.250-02:00", "4624", "a", "7.7.7.7")]
    df = spark.createDataFrame(
        [(0, t, "DC01", c, acc, ip, "3", None) for t, c, acc, ip in rows],
        "_arrival long, _time string, host string, EventCode string, account string, "
        "src string, Logon_Type string, Sub_Status string")
    a = correlate(logon_events(df, "w")).collect()[0]
    # time order: 03:42:01Z (+05:30 text), 04:00:00Z, 12:12:01.250Z (-02:00 text)
    assert a["first_seen"] == "2026-06-09T09:12:01.000+05:30"
    assert a["last_seen"] == "2026-06-09T10:12:01.250-02:00"
    assert a["success_after_failures"] is True
