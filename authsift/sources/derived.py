"""A deterministic sshd auth log, intel feed and label set derived from ``events``.

The driver's tables hold no auth logs, so the test inputs are derived from the
``events`` table by one integer rule (each event yields at most one line):

* ``u`` = user_id, ``k`` = first digit run of ``props``,
  ``w`` = (day - 1) div 7, profile ``p`` = (u + w) % 10.
* source ip = ``<prefix>.<w>.<u div 250>.<u % 250 + 2>`` with prefix 10 for
  p in {0,1,7}, 185 for {3,5}, 91 for 8, 203 otherwise.
* host ``host-<k % 5>``, pid ``1000 + event_id % 9000``, port 22, syslog time of ``ts``.

Profiles 0-2 are benign (typos, a stale internal job, an employee at home),
3-9 attacks (brute force, compromise, slow-and-low, stolen credentials,
internal spraying, scanner, key scanning).  Every parser branch and every
triage rule is hit.  The same rule is written in SQL for the DuckDB oracle
(:mod:`authsift.plans.oracle`).
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.dims import CITY_COORDS

PROFILE_NAMES = ["internal typos", "internal stale job", "employee at home", "brute force",
                 "compromise", "slow and low", "stolen credentials", "internal spraying",
                 "scanner", "key scanning"]
HARD_PROFILES = {1, 2, 5, 6}
# country code per city of dims.CITY_COORDS, in the same order (our own feed)
CITY_COUNTRY = ["RU", "RU", "CN", "CN", "NL", "BR", "VN", "IR", "IN", "KR",
                "PL", "TR", "SE", "PA", "US", "US", "CA", "US", "US", "DE"]


def _s(c: Column) -> Column:
    return c.cast("string")


PROFILE = ("seq", "ts", "u", "et", "k", "w", "p", "ip")


def profiled(events: DataFrame) -> DataFrame:
    """events -> seq, ts, u, et, k, w, p, ip; a table that has these already is taken as it is.

    What filters on a message reads the stored columns: over ``events`` themselves the
    optimizer would put this rule, with its pattern, in place of every use of a column.
    """
    if set(PROFILE) <= set(events.columns):
        return events.select(*PROFILE)
    u, w = F.col("u"), F.col("w")
    p = (u + w) % 10
    prefix = (F.when(p.isin(0, 1, 7), "10").when(p.isin(3, 5), "185")
              .when(p == 8, "91").otherwise("203"))
    base = events.select(
        F.col("event_id").alias("seq"), "ts", F.col("user_id").alias("u"),
        F.col("event_type").alias("et"),
        F.regexp_extract("props", "[0-9]+", 0).cast("bigint").alias("k"),
        F.floor((F.dayofmonth("ts") - 1) / 7).cast("bigint").alias("w"))
    return base.withColumn("p", p).withColumn(
        "ip", F.concat_ws(".", prefix, _s(w), _s(F.floor(u / 250)), _s(u % 250 + 2)))


_FROM = (" from ", " port 22 ssh2")
# (text before the user, text between user and ip, text behind the ip); the session line names no ip
_SHAPES = {
    "failed": ("Failed password for ", *_FROM),
    "invalid": ("Failed password for invalid user ", *_FROM),
    "accepted": ("Accepted password for ", *_FROM),
    "key": ("Accepted publickey for ", " from ", " port 22 ssh2: RSA SHA256:"),
    "bad key": ("Failed publickey for ", *_FROM),
    "no user": ("Invalid user ", " from ", " port 22"),
    "session": ("pam_unix(sshd:session): session opened for user ", " by (uid=0)", ""),
    "max": ("error: maximum authentication attempts exceeded for invalid user ", " from ", " port 22 ssh2 [preauth]"),
    "closed 0": ("Disconnected from authenticating user ", " ", " port 22 [preauth]"),
    "closed 1": ("Connection closed by authenticating user ", " ", " port 22 [preauth]"),
    "closed 2": ("Disconnected from invalid user ", " ", " port 22 [preauth]"),
    "closed 3": ("Connection closed by invalid user ", " ", " port 22 [preauth]"),
    "silent": ("Did not receive identification string from ", "", " port 22"),
    "banner": ("banner exchange: Connection from ", "", " port 22: invalid format"),
    "reset": ("Connection reset by ", "", " port 22 [preauth]"),
    "bye": ("Received disconnect from ", "", " port 22:11: Bye Bye [preauth]"),
}
_NUMBER = {name: i for i, name in enumerate(_SHAPES, 1)}


def _told(events: DataFrame) -> DataFrame:
    """The profiled events that have a message, with the number of its ``shape`` and its ``user``.
    (Whole messages in the branches make code too long for the JVM to compile.)"""
    df = profiled(events)
    p, et, k, u, seq = (F.col(c) for c in ("p", "et", "k", "u", "seq"))
    of = lambda name: F.lit(_NUMBER[name])
    closed = of("closed 0") + (seq % 4).cast("int")
    shape = (
        F.when((p == 0) & (et == "error") & (k < 25), of("failed"))
        .when((p == 0) & et.isin("click", "view") & (k < 60), of("accepted"))
        .when((p == 1) & (et == "error"), of("failed"))
        .when((p == 1) & (et == "purchase"), F.when(seq % 2 == 0, of("no user")).otherwise(of("session")))
        .when((p == 2) & (et == "error") & (k < 30), of("failed"))
        .when((p == 2) & (et == "click"), of("accepted"))
        .when((p == 3) & et.isin("error", "click", "view"), of("invalid"))
        .when((p == 3) & (et == "signup"), of("max"))
        .when((p == 3) & (et == "purchase"), F.when(seq % 4 >= 0, closed).otherwise(of("closed 3")))
        .when((p == 4) & (et == "error"), of("failed"))
        .when((p == 4) & (et == "click") & (k >= 50), of("accepted"))
        .when((p == 5) & (et == "error") & (k < 40), of("failed"))
        .when((p == 6) & (et == "click") & (k < 40), of("key"))
        .when((p == 7) & et.isin("error", "click", "view"), of("failed"))
        .when((p == 8) & (k % 2 == 0), of("silent"))
        .when(p == 8, of("banner"))
        .when((p == 9) & et.isin("error", "view"), of("bad key"))
        .when((p == 9) & (et == "purchase"), F.when(seq % 2 == 0, of("reset")).otherwise(of("bye")))
        .otherwise(0)
    )
    user = (F.when(p == 1, F.concat(F.lit("svc-"), _s(u % 7)))
            .when(p == 3, F.concat(F.lit("acct"), _s(k % 9)))
            .when(p == 5, F.lit("root"))
            .when(p == 7, F.concat(F.lit("user"), _s(k)))
            .when((p == 8) | (p == 9) & (et == "purchase"), F.lit(""))
            .when(p == 9, F.lit("git"))
            .otherwise(F.concat(F.lit("user"), _s(u))))
    told = df.withColumn("shape", shape).withColumn("user", user)
    return told.where((F.col("shape") > 0) & F.col("user").isNotNull() & ((p != 6) | seq.isNotNull()))


def _message() -> Column:
    """The message of a row of :func:`_told`."""
    p, shape = F.col("p"), F.col("shape")
    text = lambda i: F.get(F.array(F.lit(None).cast("string"), *[F.lit(t[i]) for t in _SHAPES.values()]), shape)
    return F.concat(text(0), F.col("user"), text(1),
                    F.when(shape == _NUMBER["session"], F.lit("")).otherwise(F.col("ip")), text(2),
                    F.when(p == 6, F.substring(F.md5(_s(F.col("seq"))), 1, 10)).otherwise(F.lit("")))


def derive_auth_lines(events: DataFrame) -> DataFrame:
    """events -> (seq, line): one sshd line per event that produces one."""
    df = _told(events).where(F.col("ts").isNotNull() & F.col("k").isNotNull() & F.col("seq").isNotNull())
    ts_text = F.concat(F.date_format("ts", "MMM"), F.lit(" "),
                       F.lpad(_s(F.dayofmonth("ts")), 2, " "), F.lit(" "),
                       F.date_format("ts", "HH:mm:ss"))
    host = F.concat(F.lit("host-"), _s(F.col("k") % 5))
    pid = _s(F.col("seq") % 9000 + 1000)
    line = F.concat(ts_text, F.lit(" "), host, F.lit(" sshd["), pid, F.lit("]: "), _message())
    return df.select("seq", line.alias("line"))


def derive_intel(events: DataFrame) -> DataFrame:
    """Dynamic intel rows: malicious for profiles 3, 5, 9 when u % 3 = 0,
    suspicious for profile 8; geo names a city (empty for u % 4 = 0)."""
    df = profiled(events).select("ip", "u", "p").distinct()
    u, p = F.col("u"), F.col("p")
    malicious = p.isin(3, 5, 9) & (u % 3 == 0)
    city = F.element_at(F.array(*[F.lit(c[0]) for c in CITY_COORDS]), (u % 20 + 1).cast("int"))
    country = F.element_at(F.array(*[F.lit(c) for c in CITY_COUNTRY]), (u % 20 + 1).cast("int"))
    geo = F.when(u % 4 == 0, F.lit("")).otherwise(
        F.concat(country, F.lit(" — "), city, F.lit(" (AS"), _s(u % 1000 + 64512), F.lit(")")))
    return (df.where(malicious | (p == 8)).select(
        "ip", geo.alias("geo"),
        F.when(malicious, "malicious").otherwise("suspicious").alias("reputation"),
        F.when(malicious, F.array(F.lit("ssh-bruteforce")))
        .otherwise(F.array(F.lit("mass-scanner"), F.lit("recent-reports"))).alias("tags"),
        F.when(malicious, u % 1000).otherwise(u % 100).cast("int").alias("reports_90d")))


def derive_labels(events: DataFrame) -> DataFrame:
    """Ground truth per source ip of the derived log (noise-only ips included)."""
    df = _told(events).select("ip", "p").distinct()
    p = F.col("p")
    name = F.element_at(F.array(*[F.lit(n) for n in PROFILE_NAMES]), (p + 1).cast("int"))
    notes = F.concat(F.when(p.isin(*HARD_PROFILES), "HARD: ").otherwise(""), name)
    return df.select(F.col("ip").alias("src_ip"),
                     F.when(p >= 3, "true_positive").otherwise("false_positive").alias("verdict"),
                     notes.alias("notes"))


def derive_case_updates(events: DataFrame) -> DataFrame:
    """Analyst case updates (long form) for the derived log's sources: one per
    ``signup`` event; the field rotates with ``k``; every 11th update is an
    explicit NULL that clears its field."""
    from ..operators.cases import AGREE, DISAGREE
    from ..operators.dims import CASE_FIELDS, CASE_STATUSES
    df = profiled(events).where(F.col("et") == "signup")
    seq, k, u = F.col("seq"), F.col("k"), F.col("u")
    field = F.element_at(F.array(*[F.lit(f) for f in CASE_FIELDS]), (k % 4 + 1).cast("int"))
    status = F.element_at(F.array(*[F.lit(s) for s in CASE_STATUSES]), (seq % 4 + 1).cast("int"))
    value = (F.when(seq % 11 == 0, F.lit(None).cast("string"))
             .when(field == "status", status)
             .when(field == "assignee", F.concat(F.lit("analyst"), _s(u % 5)))
             .when(field == "notes", F.concat(F.lit("checked "), _s(seq)))
             .otherwise(F.when(seq % 3 == 1, F.lit(DISAGREE)).otherwise(F.lit(AGREE))))
    return df.select(F.lit("derived").alias("dataset"), F.col("ip").alias("src_ip"),
                     field.alias("field"), value.alias("value"),
                     F.col("ts").cast("timestamp").alias("updated_at"),
                     seq.alias("update_id"))


def derive_export_lines(results: DataFrame) -> DataFrame:
    """A logon export as it arrives: the result rows as JSON lines, and among them
    lines that are none - a cut-off copy of each row whose address ends in 7, a
    ``{"preview": true}`` per row whose address ends in 3, a blank per row ending in 9."""
    from .logon_export import RESULT_FIELDS
    good = F.to_json(F.struct(F.lit(False).alias("preview"), F.struct(*RESULT_FIELDS).alias("result")))
    src = F.col("src")
    bad = (F.when(src.endswith("7"), F.substring(good, 1, 40)).when(src.endswith("3"), F.lit('{"preview": true}'))
           .when(src.endswith("9"), F.lit("  ")))
    lines = results.select("_time", F.array_compact(F.array(good, bad)).alias("lines"))
    return lines.select("_time", F.posexplode("lines").alias("part", "value"))


def derive_order_lines(orders: DataFrame) -> DataFrame:
    """A failed login per order, at its date: a log over several years whose lines have none.
    ``seq`` is the arrival order."""
    k = F.col("o_orderkey")
    two = lambda c: F.lpad(c.cast("string"), 2, "0")
    clock = F.concat_ws(":", two(k % 24), two(k % 60), two(k % 59))
    return orders.select(
        F.col("o_orderdate").cast("date").alias("day"), k.alias("seq"),
        F.concat(F.date_format("o_orderdate", "MMM"), F.lit(" "), F.lpad(F.dayofmonth("o_orderdate").cast("string"), 2, " "), F.lit(" "),
                 clock, F.lit(" shop"), (k % 3).cast("string"), F.lit(" sshd[1]: Failed password for user"),
                 F.col("o_custkey").cast("string"), F.lit(" from 10.9."), (k % 250).cast("string"), F.lit(".7 port 22 ssh2")).alias("line"))


def derive_security_events(events: DataFrame) -> DataFrame:
    """A raw Windows security-event table: error -> 4625, click/view -> 4624, with
    logon types, sources, machine accounts and '-' addresses mixed in so every
    selection rule of WIN5-WIN7 has rows to keep and to drop."""
    df = profiled(events).where(F.col("et").isin("error", "click", "view"))
    k, u, ip = F.col("k"), F.col("u"), F.col("ip")
    return df.select(
        F.col("ts").cast("timestamp").alias("event_time"),
        F.when(k % 7 == 0, "WinEventLog:System").otherwise("WinEventLog:Security").alias("source"),
        F.concat(F.lit("DC0"), _s(k % 3)).alias("host"),
        F.when(F.col("et") == "error", "4625").otherwise("4624").alias("EventCode"),
        F.when(k % 2 == 1, ip).alias("src_ip"),
        F.when(k % 11 == 0, F.lit("-")).otherwise(ip).alias("Source_Network_Address"),
        F.when(k % 5 != 0, F.concat(F.lit("user"), _s(u))).alias("user"),
        F.array(F.lit("-"), F.when(k % 10 == 0, F.concat(F.lit("WS"), _s(u % 50), F.lit("$")))
                .otherwise(F.concat(F.lit("user"), _s(u)))).alias("Account_Name"),
        F.element_at(F.array(F.lit("3"), F.lit("10"), F.lit("2")), (k % 3 + 1).cast("int"))
        .alias("Logon_Type"),
        F.when(F.col("et") != "error", F.lit(None).cast("string"))
        .when(k % 8 == 0, "0xc0000064").when(k % 4 == 0, "0xC0000064")
        .otherwise("0xC000006A").alias("Sub_Status"))
