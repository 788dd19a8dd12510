"""SRC2, WIN1-WIN9: exported Windows/AD logon events -> auth events.

Two entry points:

* :func:`read_logon_export` reads a search export, one JSON object per line
  (``{"preview": .., "result": {...}}``); blank, malformed and ``result``-less
  lines are skipped.
* :func:`select_logon_events` is the search itself (WIN5-WIN8) as DataFrame
  filters over a raw security-event table, so it pushes down to parquet.

:func:`logon_events` maps result rows to the shared ``auth_events`` shape.
Correlation needs chronological order (WIN9): the order key is the event
time in milliseconds shifted left by 21 bits, plus the low 21 bits of the
arrival key, so events sort by time and, inside one millisecond, by arrival
(exact up to two million events sharing a millisecond).
"""
from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.ordering import with_arrival
from ..functions.patterns import NO_SUCH_USER
from ..functions.timespec import resolve

LOG_SOURCE = "windows_ad"
RESULT_FIELDS = ["_time", "host", "EventCode", "account", "src", "Logon_Type", "Sub_Status"]
RESULT_SCHEMA = "struct<" + ", ".join(f"`{f}`: string" for f in RESULT_FIELDS) + ">"
EXPORT_SCHEMA = f"preview boolean, result {RESULT_SCHEMA}"


def write_logon_export(results: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Result rows as an export: one ``{"preview": false, "result": {...}}`` per line."""
    line = F.to_json(F.struct(F.lit(False).alias("preview"), F.struct(*RESULT_FIELDS).alias("result")))
    results.select(line.alias("value")).write.mode(mode).text(path)


def read_logon_export(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """Export lines -> ``seq, result.*`` rows (only lines with a ``result``)."""
    paths = [path] if isinstance(path, str) else list(path)
    raw = with_arrival(spark.read.text(paths), "_arrival").select("_arrival", "value")
    parsed = raw.select("_arrival", F.from_json("value", EXPORT_SCHEMA,
                                                {"mode": "PERMISSIVE"}).alias("j"))
    return parsed.where(F.col("j.result").isNotNull()).select("_arrival", "j.result.*")


def logon_events(results: DataFrame, dataset: str) -> DataFrame:
    """WIN1-WIN4, WIN9: result rows -> ``auth_events`` (4624 accepted, 4625 failed)."""
    src, account, code = (F.coalesce(F.col(c), F.lit("")) for c in ("src", "account", "EventCode"))
    logon_type = F.coalesce(F.col("Logon_Type"), F.lit("?"))
    time_text = F.coalesce(F.col("_time"), F.lit(""))
    raw = F.concat(time_text, F.lit(" "), F.coalesce(F.col("host"), F.lit("")),
                   F.lit(" EventCode="), code, F.lit(" account="), account,
                   F.lit(" src="), src, F.lit(" logon_type="), logon_type)
    millis = F.coalesce(F.unix_millis(F.try_to_timestamp(F.col("_time"))), F.lit(0))
    # time, then arrival, both whole: ties keep the order of the export
    seq = (millis.cast("decimal(18,0)") * F.lit(str(1 << 63)).cast("decimal(19,0)")
           + F.col("_arrival").cast("decimal(19,0)")).cast("decimal(38,0)")
    return (results.where((src != "") & (account != "") & code.isin("4624", "4625"))
            .select(F.lit(dataset).alias("dataset"), seq.alias("seq"),
                    F.try_to_timestamp(F.col("_time")).alias("event_time"),
                    time_text.alias("ts_text"),
                    F.coalesce(F.col("host"), F.lit("unknown")).alias("host"),
                    F.when(code == "4624", "accepted").otherwise("failed").alias("action"),
                    account.alias("user"), src.alias("src_ip"),
                    F.coalesce(F.col("Sub_Status").isin(*NO_SUCH_USER), F.lit(False))
                    .alias("invalid_user"),
                    F.concat(F.lit("windows_logon_type_"), logon_type).alias("method"),
                    raw.alias("raw"), F.lit(LOG_SOURCE).alias("log_source")))


DEFAULT_EARLIEST, DEFAULT_LATEST = "-24h@h", "now"


def search_window(now: datetime, earliest: datetime | str | None = None,
                  latest: datetime | str | None = None) -> tuple[datetime, datetime]:
    """WIN8: the bounds of a search; texts are relative times (:mod:`authsift.functions.timespec`)."""
    bound = lambda t, default: resolve(t or default, now) if not isinstance(t, datetime) else t
    return bound(earliest, DEFAULT_EARLIEST), bound(latest, DEFAULT_LATEST)


def default_window(now: datetime) -> tuple[datetime, datetime]:
    """WIN8: 24 hours ago snapped to the hour, up to now."""
    return search_window(now)


def _instant(t: datetime) -> F.Column:
    """A naive time is one of the session's zone, not of the driver's."""
    return F.lit(t) if t.tzinfo else F.lit(t.isoformat(sep=" ")).cast("timestamp")


def select_logon_events(security: DataFrame, now: datetime,
                        earliest: datetime | str | None = None,
                        latest: datetime | str | None = None) -> DataFrame:
    """WIN5-WIN8 over raw security events.

    Input columns: ``event_time TIMESTAMP, source, host, EventCode, src_ip,
    Source_Network_Address, user, Account_Name ARRAY<STRING>, Logon_Type,
    Sub_Status``.  Output: the export's result columns plus ``_arrival``.
    """
    start, end = search_window(now, earliest, latest)
    code, lt = F.col("EventCode"), F.col("Logon_Type")
    src = F.coalesce(F.col("src_ip"), F.col("Source_Network_Address"))
    account = F.coalesce(F.col("user"), F.try_element_at(F.col("Account_Name"), F.lit(-1)))
    picked = (security
              .where((F.col("event_time") >= _instant(start)) & (F.col("event_time") < _instant(end)))
              .where(F.col("source").contains("Security"))
              .where((code == "4625") | ((code == "4624") & lt.isin("3", "10"))))
    out = (picked.select(
        F.monotonically_increasing_id().alias("_arrival"),
        F.date_format("event_time", "yyyy-MM-dd'T'HH:mm:ss.SSSxxx").alias("_time"),
        "host", "EventCode", account.alias("account"), src.alias("src"), "Logon_Type",
        "Sub_Status")
        .where(F.col("src").isNotNull() & (F.col("src") != "-")
               & ~F.coalesce(F.col("account").endswith("$"), F.lit(False))))
    return out
