"""Streaming semantics: late rows beyond the watermark are dropped (STR2), and the
running alert state merges across micro-batches (STR3).

Spark guarantees that rows within the watermark delay are kept; rows behind it
are dropped once the watermark of the previous micro-batch has passed them
(rows only slightly late may still be counted), so the late row here comes two
files after the watermark was set."""
import os

from authsift.streaming import streams as ST

LINE = "Jun  9 {hh}:{mm}:00 web-01 sshd[1]: Failed password for u from {ip} port 22 ssh2\n"


def _write(path, rows, mtime):
    with open(path, "w") as f:
        for hh, mm, ip in rows:
            f.write(LINE.format(hh=hh, mm=mm, ip=ip))
    os.utime(path, (mtime, mtime))


def test_late_rows_dropped_and_state_merges(spark, tmp):
    d = f"{tmp}/logs"
    os.makedirs(d)
    _write(f"{d}/a.log", [("10", "00", "1.1.1.1"), ("11", "30", "1.1.1.1"),
                          ("13", "10", "2.2.2.2")], 1_700_000_000)
    _write(f"{d}/b.log", [("13", "20", "1.1.1.1")], 1_700_000_100)
    # third file: 08:05 is far behind the watermark (13:10 - 1h); 13:30 is on time
    _write(f"{d}/c.log", [("08", "05", "1.1.1.1"), ("13", "30", "1.1.1.1")], 1_700_000_200)

    ev = ST.stream_events(spark, d, "s", year=2026, files_per_trigger=1)
    out = ST.run_available_now(ST.stream_timeline(ev), "t-late")
    hours = {r["hour"].hour: r["events"] for r in spark.read.parquet(out).collect()}
    # closed hours only (watermark 12:30): 10 and 11; the late 08:05 row is gone
    assert hours == {10: 1, 11: 1}

    ev = ST.stream_events(spark, d, "s", year=2026, files_per_trigger=1)
    table = ST.run_alerts(ev, "a-merge")
    cur = {r["src_ip"]: r for r in ST.alerts_of_spans(table.read()).collect()}
    # the delay of a day covers the late row: all rows count, merged over the batches
    assert cur["1.1.1.1"]["failed_logins"] == 5
    assert cur["1.1.1.1"]["first_seen"] == "Jun  9 08:05:00"
