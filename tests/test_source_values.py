"""The pair table: ordered lists, counts and top values without gathering a source."""
from pyspark.sql import functions as F

from authsift.operators import analytics as A
from authsift.operators.correlate import HOSTS, USERS, alerts_of, correlate, ordered_values, source_values
from authsift.operators.enrich import enrich
from authsift.operators.rules import triage_rules


def _events(spark, n, users):
    """One source with ``n`` failed logins over ``users`` accounts, and a small one."""
    k = F.col("id")
    hot = k % 10 != 0
    return spark.range(0, n, 1, 16).select(
        F.lit("d").alias("dataset"), F.when(hot, F.lit("203.0.113.9")).otherwise(F.lit("198.51.100.2")).alias("src_ip"),
        k.alias("seq"), F.lit("sshd_file").alias("log_source"), F.concat(F.lit("t"), k).alias("ts_text"),
        F.concat(F.lit("h"), k % 3).alias("host"), F.lit("failed").alias("action"),
        F.when(hot, F.concat(F.lit("u"), k % users)).otherwise(F.lit("")).alias("user"), F.lit(False).alias("invalid_user"))


def _plan(df):
    return df._jdf.queryExecution().toString()


def test_positions_equal_the_lists(spark):
    ev = _events(spark, 4000, 37)
    pairs = source_values(ev).cache()
    lists = {r["src_ip"]: r for r in alerts_of(pairs).collect()}
    for kind, name, col, n in ((USERS, "user", "usernames_targeted", "n_users"), (HOSTS, "host", "hosts_targeted", "n_hosts")):
        got = {}
        for r in ordered_values(pairs, kind, name).orderBy("src_ip", "pos").collect():
            got.setdefault(r["src_ip"], []).append((r["pos"], r[name]))
        for ip, r in lists.items():
            assert got.get(ip, []) == [(k + 1, v) for k, v in enumerate(r[col])]
            assert r[n] == len(r[col])
    assert lists["198.51.100.2"]["n_users"] == 0  # events without a user


def test_a_source_with_a_million_users(spark):
    pairs = source_values(_events(spark, 1_200_000, 1_000_000))
    pos = ordered_values(pairs, USERS, "user")
    got = pos.agg(F.count(F.lit(1)), F.max("pos"), F.count_distinct("pos")).first()
    assert tuple(got) == (900_000,) * 3  # every tenth event is the other source's
    verdicts = triage_rules(enrich(alerts_of(pairs)))
    assert {r["src_ip"]: r["rule_id"] for r in verdicts.select("src_ip", "rule_id").collect()} == \
        {"203.0.113.9": 4, "198.51.100.2": 4}
    top = A.top_accounts(verdicts, pairs, k=2)
    assert [tuple(r) for r in top.collect()] == [("u1", 1), ("u100001", 1)]
    for df in (pos, verdicts.select("src_ip", "rule_id"), top, A.top_hosts(verdicts, pairs)):
        assert "collect_list" not in _plan(df).split("== Optimized Logical Plan ==")[1]


def test_alerts_from_elsewhere_have_only_lists(spark):
    e = enrich(correlate(_events(spark, 100, 5))).drop("n_users", "n_hosts")
    assert {r["rule_id"] for r in triage_rules(e).collect()} == {4}
