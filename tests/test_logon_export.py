"""Golden results, worked out by hand, for our own 10-row logon export, and WIN5-WIN8."""
from datetime import datetime

from authsift.operators.correlate import correlate
from authsift.operators.enrich import enrich
from authsift.operators.rules import triage_rules
from authsift.sources.logon_export import (default_window, logon_events, read_logon_export,
                                           select_logon_events)
from conftest import fixture


def test_export_golden(spark):
    ev = logon_events(read_logon_export(spark, fixture("logon_export.jsonl")), "ad")
    assert ev.count() == 10
    a = {r["src_ip"]: r for r in enrich(correlate(ev)).collect()}
    t = {r["src_ip"]: r for r in triage_rules(enrich(correlate(ev))).collect()}
    assert set(a) == {"198.51.100.140", "192.168.7.20", "192.168.7.31"}
    g = a["198.51.100.140"]
    assert (g["failed_logins"], g["successful_logins"], g["invalid_user_attempts"]) == (3, 1, 0)
    assert g["usernames_targeted"] == ["r.novak"] and g["hosts_targeted"] == ["APP5"]
    assert g["success_after_failures"] is True  # same millisecond: the export's order decides
    assert (g["first_seen"], g["last_seen"]) == ("2025-11-20T06:15:00.250Z",
                                                 "2025-11-20T06:15:09.500Z")
    g = a["192.168.7.20"]
    assert (g["failed_logins"], g["successful_logins"], g["invalid_user_attempts"]) == (4, 0, 1)
    assert g["usernames_targeted"] == ["t.berg", "l.ito", "svc-print"]
    assert g["success_after_failures"] is False  # no accepted rows: NULL coalesced
    g = a["192.168.7.31"]  # the export lists the later event first
    assert g["hosts_targeted"] == ["APP5", "HQ-DC2"] and g["success_after_failures"] is False
    v = {ip: (r["verdict"], r["severity"], r["confidence"], r["mitre_technique_id"])
         for ip, r in t.items()}
    assert v == {"198.51.100.140": ("true_positive", "critical", 90, "T1110.001"),
                 "192.168.7.20": ("true_positive", "high", 75, "T1110.003"),
                 "192.168.7.31": ("false_positive", "informational", 80, "N/A")}


def test_export_drops_bad_lines(spark, tmp):
    path = f"{tmp}/export.jsonl"
    with open(path, "w") as f:
        f.write("\n")
        f.write("{not json\n")
        f.write('{"preview": false}\n')
        f.write('{"result": {"_time": "t", "EventCode": "4776", "account": "a", "src": "1.2.3.4"}}\n')
        f.write('{"result": {"_time": "t", "EventCode": "4625", "account": "", "src": "1.2.3.4"}}\n')
        f.write('{"result": {"_time": "t", "EventCode": "4625", "account": "b", "src": "1.2.3.4"}}\n')
    ev = logon_events(read_logon_export(spark, path), "x").collect()
    assert len(ev) == 1
    r = ev[0]
    assert r["host"] == "unknown" and r["method"] == "windows_logon_type_?"
    assert r["raw"] == "t  EventCode=4625 account=b src=1.2.3.4 logon_type=?"


def test_security_selection(spark):
    rows = [
        # event_time, source, host, code, src_ip, sna, user, Account_Name, Logon_Type, Sub_Status
        (datetime(2026, 6, 9, 10), "WinEventLog:Security", "DC01", "4625", "10.0.0.9", None, "a",
         ["x"], "3", "0xC0000064"),
        (datetime(2026, 6, 9, 10), "WinEventLog:Security", "DC01", "4624", None, "10.0.0.8", None,
         ["SYSTEM", "bob"], "10", None),
        (datetime(2026, 6, 9, 10), "WinEventLog:Security", "DC01", "4624", "10.0.0.7", None, "c",
         ["c"], "2", None),                                       # logon type 2: dropped
        (datetime(2026, 6, 9, 10), "WinEventLog:System", "DC01", "4625", "10.0.0.6", None, "d",
         ["d"], "3", None),                                        # not a Security source
        (datetime(2026, 6, 9, 10), "WinEventLog:Security", "DC01", "4625", None, "-", "e",
         ["e"], "3", None),                                        # address '-'
        (datetime(2026, 6, 9, 10), "WinEventLog:Security", "DC01", "4625", "10.0.0.5", None, None,
         ["x", "WS01$"], "3", None),                               # machine account
        (datetime(2026, 6, 8, 9), "WinEventLog:Security", "DC01", "4625", "10.0.0.4", None, "f",
         ["f"], "3", None),                                        # before the window
    ]
    schema = ("event_time timestamp, source string, host string, EventCode string, src_ip string, "
              "Source_Network_Address string, user string, Account_Name array<string>, "
              "Logon_Type string, Sub_Status string")
    now = datetime(2026, 6, 9, 12, 30)
    assert default_window(now) == (datetime(2026, 6, 8, 12), now)
    sel = select_logon_events(spark.createDataFrame(rows, schema), now=now)
    got = sorted((r["src"], r["account"]) for r in sel.collect())
    assert got == [("10.0.0.8", "bob"), ("10.0.0.9", "a")]
    ev = {r["src_ip"]: r for r in logon_events(sel, "x").collect()}
    assert ev["10.0.0.9"]["invalid_user"] is True and ev["10.0.0.9"]["action"] == "failed"
    assert ev["10.0.0.8"]["action"] == "accepted"
