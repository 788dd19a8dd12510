"""A query writes only the derived inputs it reads, and a stream one state row per user and host of a span."""
import os

from authsift.plans.context import derived
from authsift.streaming import streams as ST


def test_only_the_inputs_that_are_read(spark, tmp_path):
    spark.sql("""SELECT id AS event_id, TIMESTAMP'2024-01-02 03:04:05' AS ts, id % 5 AS user_id, 'signup' AS event_type,
                 1.0D AS value, concat('{"k": ', id, '}') AS props FROM range(20)""").write.parquet(f"{tmp_path}/events.parquet")
    ctx = derived(spark, str(tmp_path))
    assert ctx.case_updates().count() == 20
    assert [n for n in os.listdir(ctx.root) if not n.startswith(".")] == ["case_updates"]


def test_one_row_per_user_host_and_span(spark, tmp_path):
    os.makedirs(f"{tmp_path}/in")
    line = "Jan  2 03:{:02d}:00 web{} sshd[1]: Failed password for bob from 10.0.0.1 port 22 ssh2\n"
    with open(f"{tmp_path}/in/a.log", "w") as f:
        f.writelines(line.format(i, i % 2) for i in range(10))
    table = ST.run_alerts(ST.stream_events(spark, f"{tmp_path}/in", "s", year=2026))
    rows = table.read().collect()
    assert sorted((r["user"], r["host"], r["failed"]) for r in rows) == [("bob", "web0", 5), ("bob", "web1", 5)]
    (alert,) = ST.alerts_of_spans(table.read()).collect()
    assert (alert["failed_logins"], alert["usernames_targeted"], alert["hosts_targeted"]) == (10, ["bob"], ["web0", "web1"])
