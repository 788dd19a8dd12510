"""Running state: lists after shuffled micro-batches, expiry, upserts, replays, late verdicts, tombstones."""
import os
import random

import pytest
from pyspark.sql import functions as F

from authsift.operators import cases
from authsift.operators.correlate import correlate
from authsift.operators.parse import parse_events
from authsift.sources.auth_log import read_auth_log
from authsift.streaming import streams as ST
from authsift.streaming.current import CurrentTable


def _log(path, lines, mtime):
    with open(path, "w") as f:
        f.writelines(f"{t} {h} sshd[1]: {m}\n" for t, h, m in lines)
    os.utime(path, (mtime, mtime))


def _failed(user, ip):
    return f"Failed password for {user} from {ip} port 22 ssh2"


def test_lists_equal_the_batch_lists_after_shuffled_micro_batches(spark, tmp):
    rng = random.Random(7)
    lines = [(f"Jun  9 {10 + k // 60:02d}:{k % 60:02d}:{k % 59:02d}", f"h{rng.randrange(4)}",
              _failed(f"u{rng.randrange(12)}", f"203.0.113.{rng.randrange(3)}")) for k in range(180)]
    _log(f"{tmp}/all.log", lines, 1_700_000_000)
    want = {r["src_ip"]: r for r in correlate(parse_events(read_auth_log(spark, f"{tmp}/all.log", "s"), year=2026)).collect()}
    shuffled = lines[:]
    rng.shuffle(shuffled)
    os.makedirs(f"{tmp}/in")
    for k in range(3):
        _log(f"{tmp}/in/{k}.log", shuffled[k * 60:k * 60 + 60], 1_700_000_000 + k)
    table = ST.run_alerts(ST.stream_events(spark, f"{tmp}/in", "s", year=2026, files_per_trigger=1))
    got = {r["src_ip"]: r for r in ST.alerts_of_spans(table.read()).collect()}
    assert table.manifest()["batch"] >= 2 and got.keys() == want.keys()
    for ip, w in want.items():
        for c in ("usernames_targeted", "hosts_targeted", "failed_logins", "first_seen", "last_seen", "n_users", "n_hosts"):
            assert got[ip][c] == w[c], (ip, c)


def test_idle_sources_leave_the_state_and_keep_their_totals(spark, tmp):
    os.makedirs(f"{tmp}/in")
    for day in range(1, 9):  # a new source every day, one that stays
        _log(f"{tmp}/in/{day}.log", [(f"Jun  {day} 10:00:00", "h", _failed("u", f"203.0.113.{day}")),
                                     (f"Jun  {day} 11:00:00", "h", _failed(f"v{day}", "198.51.100.1"))], 1_700_000_000 + day)
    table = ST.run_alerts(ST.stream_events(spark, f"{tmp}/in", "s", year=2026, files_per_trigger=1))
    state = spark.read.format("statestore").load(table.root.rsplit("/", 1)[0] + "/_checkpoint")
    held = {r["src_ip"] for r in state.select("key.src_ip").distinct().collect()}
    assert "203.0.113.8" in held and "203.0.113.1" not in held and len(held) <= 4
    got = {r["src_ip"]: r["failed_logins"] for r in ST.alerts_of_spans(table.read()).collect()}
    assert got == {**{f"203.0.113.{d}": 1 for d in range(1, 9)}, "198.51.100.1": 8}


def test_a_changed_verdict_moves_the_hours_of_its_source(spark, tmp):
    os.makedirs(f"{tmp}/in")
    accepted = "Accepted password for u from 203.0.113.1 port 22 ssh2"
    _log(f"{tmp}/in/a.log", [("Jun  9 10:00:00", "h", _failed("u", "203.0.113.1")), ("Jun  9 10:20:00", "h", _failed("x", "203.0.113.2"))],
         1_700_000_000)
    first = ST.stream_triage(ST.stream_events(spark, f"{tmp}/in", "s", year=2026))
    before = {(r["hour"].hour, r["severity"]): r["events"] for r in ST.severity_timeline(first.hours.read()).collect()}
    assert len(before) == 1 and list(before.values()) == [2]
    _log(f"{tmp}/in/b.log", [("Jun  9 19:00:00", "h", accepted)], 1_700_000_100)  # hours later the source gets in
    cur = ST.stream_triage(ST.stream_events(spark, f"{tmp}/in", "s", year=2026, files_per_trigger=1))
    after = {(r["hour"].hour, r["severity"]): r["events"] for r in ST.severity_timeline(cur.hours.read()).collect()}
    (old,) = {s for _, s in before}
    assert after == {(10, old): 1, (10, "critical"): 1, (19, "critical"): 1}
    assert cur.verdicts.read().count() == 2


def _rows(spark, values):
    return spark.createDataFrame(values, "k bigint, g bigint, v string, s struct<a:int,b:string>")


def test_upserts_replays_and_compaction(spark, tmp):
    table = CurrentTable(spark, f"{tmp}/t", ("k",), by=("g",), buckets=4, compact_every=3)
    with pytest.raises(RuntimeError):
        table.read()
    want = {}
    rng = random.Random(1)
    for batch in range(11):
        rows = {k: (k, k % 7, f"{batch}", (batch, None)) for k in rng.sample(range(50), 20)}
        assert table.upsert(_rows(spark, list(rows.values())), batch)
        want |= rows
        if batch in (2, 5, 10):
            replayed = _rows(spark, [(1, 1, "replayed", None)])
            version = table.manifest()
            assert not table.upsert(replayed, batch) and not table.upsert(replayed, batch - 1)
            assert table.manifest() == version
            got = {r["k"]: (r["k"], r["g"], r["v"], tuple(r["s"])) for r in table.read().collect()}
            assert got == want
            some = table.read_for(_rows(spark, [(99, 3, None, None), (98, 5, None, None)]))
            assert {r["k"] for r in some.collect()} == {k for k in want if k % 7 in (3, 5)}
    m = table.manifest()
    assert len(m["deltas"]) <= 3 and spark.read.parquet(f"{tmp}/t/data/{m['base']}").count() <= 50
    assert len(table._names("data")) <= 3 * (1 + 3) and len(table._manifests()) == 3  # old ones are gone


def test_a_batch_that_fails_before_its_commit_is_written_anew(spark, tmp, monkeypatch):
    table = CurrentTable(spark, f"{tmp}/t", ("k",))
    table.upsert(_rows(spark, [(1, 1, "a", None)]), 0)
    commit = CurrentTable._commit

    def killed(self, manifest):
        raise OSError("killed")
    monkeypatch.setattr(CurrentTable, "_commit", killed)
    with pytest.raises(OSError):
        table.upsert(_rows(spark, [(1, 1, "b", None)]), 1)
    assert [r["v"] for r in table.read().collect()] == ["a"]  # the half-written folder is in no manifest
    monkeypatch.setattr(CurrentTable, "_commit", commit)
    assert table.upsert(_rows(spark, [(1, 1, "b", None), (2, 1, None, None)]), 1)
    assert sorted((r["k"], r["v"]) for r in table.read().collect()) == [(1, "b"), (2, None)]
    assert len(table._names("data")) == 2


def test_case_updates_out_of_order_with_tombstones(spark, tmp):
    t = lambda m: f"2024-01-01 00:{m:02d}:00"
    ups = [("d", "1.1.1.1", "status", "Open", t(5), 1), ("d", "1.1.1.1", "notes", "late", t(1), 2),
           ("d", "1.1.1.1", "status", "New", t(3), 3), ("d", "1.1.1.1", "notes", "later", t(4), 4),
           ("d", "1.1.1.1", "notes", None, t(9), 5), ("d", "1.1.1.1", "notes", "older than the tombstone", t(8), 6),
           ("d", "2.2.2.2", "assignee", "ana", t(2), 7), ("d", "2.2.2.2", "assignee", "bo", t(2), 8), (None, "3.3.3.3", "feedback", "x", t(1), 9)]
    for k in range(3):  # each file a micro-batch, later updates first
        rows = spark.createDataFrame(ups[k::3], "dataset string, src_ip string, field string, value string, t string, update_id bigint")
        rows.withColumn("updated_at", F.col("t").cast("timestamp")).drop("t").coalesce(1).write.mode("append").parquet(f"{tmp}/u")
    columns = [c.split()[0] for c in cases.UPDATE_SCHEMA.split(", ")]
    want = cases.case_state(spark.read.parquet(f"{tmp}/u").select(*columns))
    got = ST.run_case_state(spark, f"{tmp}/u", cases.UPDATE_SCHEMA).read()
    assert got.columns == want.columns
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))
    one = {r["src_ip"]: r for r in got.collect()}
    assert one["1.1.1.1"]["notes"] is None and one["1.1.1.1"]["status"] == "Open" and one["2.2.2.2"]["assignee"] == "bo"
