"""A source holding a third of all lines: aggregates and dense numbering stay
exact while the hot group spans several partitions."""
from pyspark.sql import functions as F

from authsift.functions.ordering import number_rows
from authsift.operators.correlate import correlate, raw_evidence
from authsift.operators.parse import parse_events
from authsift.sources.auth_log import read_auth_log


def _write_log(tmp, n=3000):
    path = f"{tmp}/skew.log"
    with open(path, "w") as f:
        for i in range(n):
            ip = "203.0.113.7" if i % 3 == 0 else f"10.{i % 7}.{i % 11}.{i % 13}"
            kind = "Failed" if i % 2 else "Accepted"
            f.write(f"Jun  9 {i // 3600 % 24:02d}:{i // 60 % 60:02d}:{i % 60:02d} h{i % 4} sshd[{i}]: "
                    f"{kind} password for u{i % 50} from {ip} port 22 ssh2\n")
    return path


def test_hot_source_numbering_and_counts(spark, tmp):
    spark.conf.set("spark.sql.files.maxPartitionBytes", "16384")  # many splits
    try:
        lines = read_auth_log(spark, _write_log(tmp), "skew")
        ev = parse_events(lines).cache()
        assert lines.rdd.getNumPartitions() > 4
        hot = ev.where(F.col("src_ip") == "203.0.113.7")
        a = {r["src_ip"]: r for r in correlate(ev).collect()}["203.0.113.7"]
        assert a["failed_logins"] + a["successful_logins"] == hot.count() == 1000
        assert a["first_seen"] == "Jun  9 00:00:00"
        evid = raw_evidence(ev).where(F.col("src_ip") == "203.0.113.7").orderBy("line_no")
        rows = evid.collect()
        assert [r["line_no"] for r in rows] == list(range(1, 1001))
        # line order = file order: the pid field increases with the line number
        pids = [int(r["raw"].split("sshd[")[1].split("]")[0]) for r in rows]
        assert pids == sorted(pids)
        ranked = number_rows(ev.select("seq", "src_ip"), ["seq"], [], "n")
        ns = sorted(r["n"] for r in ranked.collect())
        assert ns == list(range(1, ev.count() + 1))
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_arrival_key_with_packed_small_files(spark, tmp):
    """Several small files share one task: the key still orders by (file, line)."""
    from authsift.sources.auth_log import read_auth_log
    import os
    os.makedirs(f"{tmp}/many")
    for f in range(6):
        with open(f"{tmp}/many/f{f}.log", "w") as out:
            for i in range(50):
                out.write(f"Jun  9 10:00:{i:02d} h sshd[{f * 100 + i}]: x\n")
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    spark.conf.set("spark.sql.files.maxPartitionBytes", str(1 << 20))
    spark.conf.set("spark.sql.files.minPartitionNum", "1")
    try:
        lines = read_auth_log(spark, f"{tmp}/many/*.log", "m")
        assert lines.rdd.getNumPartitions() < 6  # files were packed together
        rows = lines.orderBy("seq").collect()
        pids = [int(r["raw"].split("sshd[")[1].split("]")[0]) for r in rows]
        assert pids == sorted(pids) and len(pids) == 300
        assert len({r["seq"] for r in rows}) == 300
    finally:
        spark.conf.unset("spark.sql.files.openCostInBytes")
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.minPartitionNum")
