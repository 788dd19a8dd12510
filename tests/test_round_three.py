"""Relative search times, year rollover, one-pass validation, recoverable sinks, fingerprints, logon streams."""
import hashlib
import json
import os
import random
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from authsift.functions.timespec import resolve
from authsift.operators import cases as CS
from authsift.operators import evaluate as EV
from authsift.operators import model_io as M
from authsift.operators.parse import parse_events
from authsift.operators.rollover import with_rollover
from authsift.sources import sinks as SK
from authsift.sources.auth_log import read_auth_log
from authsift.sources.logon_export import select_logon_events
from authsift.streaming import streams as ST

NOW = datetime(2024, 3, 31, 15, 42, 7, 123)  # a Sunday


@pytest.mark.parametrize("text, want", [
    ("now", NOW), ("-24h@h", datetime(2024, 3, 30, 15)), ("-7d@d", datetime(2024, 3, 24)), ("@w1", datetime(2024, 3, 25)),
    ("@w0", datetime(2024, 3, 31)), ("@w7", datetime(2024, 3, 31)), ("@w6", datetime(2024, 3, 30)), ("-1mon", NOW.replace(month=2, day=29)),
    ("-1mon@mon+8h", datetime(2024, 2, 1, 8)), ("@q", datetime(2024, 1, 1)), ("-2y@y", datetime(2022, 1, 1)),
    ("-d", NOW.replace(day=30)), ("NOW-15MIN@m", datetime(2024, 3, 31, 15, 27)), ("2024-01-05T10:00:00", datetime(2024, 1, 5, 10)),
    ("@s", datetime(2024, 3, 31, 15, 42, 7)), ("+1q@q", datetime(2024, 4, 1))])
def test_relative_times(text, want):
    assert resolve(text, NOW) == want


@pytest.mark.parametrize("text", ["-7x", "@w9", "-1d@d?", "soon", ""])
def test_wrong_times_are_errors(text):
    with pytest.raises(ValueError):
        resolve(text, NOW)


def test_search_bounds_reach_the_scan(spark, tmp):
    rows = spark.range(10).select((F.lit("2024-03-30 12:00:00").cast("timestamp") + F.make_dt_interval(hours=F.col("id").cast("int")))
                                  .alias("event_time"), F.lit("Security").alias("source"), F.lit("h").alias("host"), F.lit("4625").alias("EventCode"),
                                  F.lit("1.1.1.1").alias("src_ip"), F.lit("-").alias("Source_Network_Address"), F.lit("u").alias("user"),
                                  F.array(F.lit("u")).alias("Account_Name"), F.lit("3").alias("Logon_Type"), F.lit("x").alias("Sub_Status"))
    rows.write.parquet(f"{tmp}/sec")
    got = select_logon_events(spark.read.parquet(f"{tmp}/sec"), now=NOW, earliest="-1d@d+15h", latest="-1d@h+2h")
    assert got.count() == 2  # 15:00 and 16:00
    before = spark.conf.get("spark.sql.maxMetadataStringLength")
    spark.conf.set("spark.sql.maxMetadataStringLength", "5000")
    plan = got._jdf.queryExecution().explainString(spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))
    spark.conf.set("spark.sql.maxMetadataStringLength", before)
    pushed = next(x for x in plan.splitlines() if "PushedFilters" in x)
    assert "GreaterThanOrEqual(event_time,2024-03-30 15:00:00.0)" in pushed and "LessThan(event_time,2024-03-30 17:00:00.0)" in pushed


MONTHS = ["Jan", "Feb", "Mar", "Apr", "May", "Jun", "Jul", "Aug", "Sep", "Oct", "Nov", "Dec"]


def _stamped(rng, n, year):
    """Lines of a log over several years, some a little late, with their true times."""
    t, out = datetime(year, 11, 2).timestamp(), []
    for _ in range(n):
        t += rng.expovariate(1 / (3 * 86400))
        out.append(datetime.fromtimestamp(int(t - (rng.random() < 0.2) * rng.random() * 5 * 86400)))
    return out


def test_years_against_a_sequential_reading(spark, tmp):
    rng = random.Random(2)
    want = {}
    for name, year in (("a", 2019), ("b", 2023)):
        os.makedirs(f"{tmp}/{name}")
        times = _stamped(rng, 300, year)
        assert len({t.year for t in times}) >= 3
        for k in range(0, 300, 60):
            with open(f"{tmp}/{name}/{k:03d}.log", "w") as f:
                for i, t in enumerate(times[k:k + 60], k):
                    f.write(f"{MONTHS[t.month - 1]} {t.day:2d} {t:%H:%M:%S} h sshd[{i}]: Failed password for u{i} from 1.1.1.1 port 22 ssh2\n")
                    want[name, f"u{i}"] = t
                    if i == 70:  # an unknown month has no time and turns nothing
                        f.write("Foo  1 00:00:00 h sshd[1]: Failed password for nobody from 1.1.1.1 port 22 ssh2\n")
    logs = [parse_events(read_auth_log(spark, f"{tmp}/{n}/*.log", n)) for n in ("a", "b")]
    # each dataset begins in its own year, so they are read one by one and together
    for ev, names, year in ((logs[0], "a", 2019), (logs[1], "b", 2023), (logs[0].unionByName(logs[1]), "ab", 2019)):
        got = with_rollover(ev.repartition(7), year)
        assert dict(got.dtypes)["event_time"] == "timestamp_ntz" and got.columns == ev.columns
        for r in got.collect():
            if r["user"] == "nobody":
                assert r["event_time"] is None
            else:
                t = want[r["dataset"], r["user"]]
                assert r["event_time"] == (t if len(names) == 1 or r["dataset"] == "a" else t.replace(year=t.year - 4)), r
    assert with_rollover(logs[0].limit(0), 2019).count() == 0


def _responses(spark, n, bad):
    good = {"src_ip": "1.1.1.1", "verdict": "true_positive", "severity": "high", "confidence": 85, "mitre_technique_id": "T1110",
            "mitre_technique_name": "Brute Force", "summary": "s", "recommended_actions": ["a"]}
    rows = [(f"id{k}", json.dumps(dict(good, src_ip=f"ip{k}"))) for k in range(n)] + bad
    return spark.createDataFrame(rows, "custom_id string, response string").repartition(4)


def test_validation_is_one_job_and_strict_comes_after_the_write(spark, tmp):
    bad = [("x1", "no json"), ("x2", None), (None, "{}"), ("x4", '{"src_ip": "1", "verdict": "maybe"}')]
    df = _responses(spark, 50, bad).cache()
    df.count()
    spark.sparkContext.setJobGroup("one-pass", "validate")
    try:
        got = M.write_validated(df, f"{tmp}/r")
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert len(spark.sparkContext.statusTracker().getJobIdsForGroup("one-pass")) == 1
    assert got.counts == {"valid": 50, "rejected": 4}
    assert got.valid.count() == 50 and got.valid.columns[:2] == ["src_ip", "verdict"]
    assert sorted(map(str, got.rejected.collect())) == sorted(map(str, spark.createDataFrame(bad, df.schema).collect()))
    with pytest.raises(ValueError, match="4"):
        M.write_validated(df, f"{tmp}/strict", strict=True)
    assert spark.read.parquet(f"{tmp}/strict").where("not valid").count() == 4  # they can be looked at
    assert M.write_validated(_responses(spark, 3, []), f"{tmp}/strict", strict=True).counts == {"valid": 3, "rejected": 0}
    assert spark.read.parquet(f"{tmp}/strict").count() == 3  # a repeated run replaces


def test_a_killed_and_repeated_write_adds_nothing_twice(spark, tmp):
    ups = spark.range(40).select(F.when(F.col("id") % 2 == 0, "a").otherwise("b").alias("dataset"), F.lit("1.1.1.1").alias("src_ip"),
                                 F.lit("notes").alias("field"), F.col("id").cast("string").alias("value"),
                                 F.lit("2024-01-01 00:00:00").cast("timestamp").alias("updated_at"), F.col("id").alias("update_id"))
    path = f"{tmp}/cases"
    SK.append_case_updates(ups.where("update_id < 20"), path, batch=1)
    fails = F.udf(lambda v: 1 / (int(v) - 35), "double")  # dies in the middle of the second batch
    with pytest.raises(Exception):
        SK.append_case_updates(ups.where("update_id >= 20").withColumn("value", fails("value").cast("string")), path, batch=2)
    assert spark.read.parquet(path).count() == 20
    for _ in range(2):
        SK.append_case_updates(ups.where("update_id >= 20"), path, batch=2)
    assert spark.read.parquet(path).count() == 40
    assert CS.case_state(spark.read.parquet(path).drop("batch")).count() == 2
    iocs = ups.select(F.col("value").alias("indicator"), F.lit('a "quoted", tag').alias("tags"))
    for batch in ("x", "y", "x"):
        SK.write_iocs(iocs, f"{tmp}/iocs", batch=batch)
    back = spark.read.csv(f"{tmp}/iocs", header=True, escape='"')
    assert back.count() == 80 and {r["tags"] for r in back.collect()} == {'a "quoted", tag'}


def test_the_fingerprint_is_of_the_multiset(spark):
    lines = [f"line {k % 7}" for k in range(50)] + ["", "é"]
    halves = [0, 0]
    for x in lines:
        d = hashlib.md5(x.encode()).hexdigest()
        halves = [(h + int(d[a:a + 16], 16)) % 2 ** 64 for h, a in zip(halves, (0, 16))]
    key = lambda rows, n: CS.order_free_fingerprint(spark.createDataFrame([(x,) for x in rows], "raw string").repartition(n)).first()[0]
    assert key(lines, 1) == f"{halves[0]:016x}{halves[1]:016x}" == key(lines[::-1], 9)
    assert key(lines + ["line 1"], 3) != key(lines, 3)
    assert CS.order_free_fingerprint(spark.createDataFrame([], "raw string")).first()[0] == "0" * 32


def test_labels_hold_for_their_dataset(spark):
    r = spark.createDataFrame([("a", "1", "true_positive"), ("b", "1", "true_positive")], "dataset string, src_ip string, verdict string")
    lab = spark.createDataFrame([("a", "1", "true_positive"), ("b", "1", "false_positive"), ("b", "2", "true_positive")],
                                "dataset string, src_ip string, verdict string")
    m = EV.precision_recall(r, lab).first()
    assert (m["true_positives"], m["false_alarms"], m["labelled_attacks"], m["precision"], m["recall"]) == (1, 1, 2, 0.5, 0.5)
    assert {(x["dataset"], x["src_ip"], x["predicted"]) for x in EV.disagreements(r, lab).collect()} == \
        {("b", "1", "true_positive"), ("b", "2", "missing")}
    plain = EV.precision_recall(r, lab.where("dataset = 'a'").drop("dataset")).first()
    assert plain["true_positives"] == 1  # without a dataset a label holds for the source


def test_logon_stream_keeps_broken_lines(spark, tmp):
    os.makedirs(f"{tmp}/x")
    row = {"_time": "2024-01-02T10:00:00.000+00:00", "host": "DC", "EventCode": "4625", "account": "bo", "src": "9.9.9.9", "Logon_Type": "3"}
    lines = [json.dumps({"preview": False, "result": row}), "", "   ", "{broken", '{"preview": true}', "[1, 2]",
             json.dumps({"result": dict(row, _time="2024-01-02T09:00:00.000+00:00", account="al", EventCode="4624")})]
    with open(f"{tmp}/x/a.json", "w") as f:
        f.write("\n".join(lines))
    with open(f"{tmp}/s.log", "w") as f:
        f.write("Jan  2 10:30:00 h sshd[1]: Failed password for cy from 8.8.8.8 port 22 ssh2\n")
    table, rejected = ST.run_union(ST.stream_events(spark, f"{tmp}/*.log", "sshd", year=2024), ST.stream_logon_lines(spark, f"{tmp}/x"), "ad")
    assert sorted(r["value"] for r in rejected.collect()) == sorted(["{broken", '{"preview": true}', "[1, 2]"])
    got = {r["src_ip"]: r for r in ST.alerts_of_spans(table.read()).collect()}
    assert got["9.9.9.9"]["usernames_targeted"] == ["al", "bo"] and got["9.9.9.9"]["dataset"] == "ad"
    assert got["8.8.8.8"]["failed_logins"] == 1 and got["8.8.8.8"]["dataset"] == "sshd"
