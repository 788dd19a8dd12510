"""STR1-STR6: the same column functions as batch, run as Structured Streaming.

* STR1 :func:`stream_events`, :func:`stream_logon_events` - continuous intake of sshd logs
  and logon exports with the batch parsers.  Streams refuse
  ``monotonically_increasing_id``, so the order key is the event time with the raw line as
  tiebreak (``seq.t``, ``seq.file``).
* STR2 :func:`stream_timeline` - hourly counts per action, emitted when the watermark closes
  the hour; :func:`severity_timeline` - the hourly table by the severity of the parent alert, kept
  current by STR5: a changed verdict moves all hours of its source.
* STR3 :func:`stream_pairs` - running alert state: one small state row per (source, user,
  host, span) instead of one growing set per source.  A span's rows leave the state once the
  watermark has passed it, so idle sources cost nothing; the pair table keeps their totals, and
  :func:`alerts_of_spans` makes alerts of it with the batch functions.
* STR4 :func:`stream_sessions` - sessions per source.
* STR5 :func:`stream_triage` - per micro-batch the changed sources are triaged and upserted by
  source into a :class:`~authsift.streaming.current.CurrentTable`.
* STR6 :func:`stream_case_state` - the batch case merge as streaming state, upserted by case.

:func:`run_available_now` and :func:`run_into` drive a stream over the files present and write
its output under the shared folder; a replayed batch changes nothing.
"""
from __future__ import annotations

import uuid
from collections.abc import Callable
from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import py_strip
from ..operators import cases
from ..operators.correlate import NUMBERS, alerts_of, values_of
from ..operators.enrich import enrich
from ..operators.parse import parse_events
from ..operators.rules import triage_rules
from ..session import shared_dir
from ..sources.logon_export import EXPORT_SCHEMA, logon_events
from .current import CurrentTable

KEYS = ["dataset", "src_ip"]


def stream_events(spark: SparkSession, path: str, dataset: str, year: int = 2026,
                  files_per_trigger: int | None = None) -> DataFrame:
    """STR1: a directory of sshd logs as a stream of ``auth_events``."""
    reader = spark.readStream.format("text")
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    lines = reader.load(path).select(
        F.lit(dataset).alias("dataset"),
        F.struct(F.lit("").alias("t"), F.lit("").alias("file"), F.lit(0).cast("bigint").alias("block"),
                 F.lit(0).cast("bigint").alias("row")).alias("seq"),
        py_strip(F.col("value")).alias("raw"))
    ev = parse_events(lines, year=year)
    return ev.withColumn("seq", F.struct(
        F.date_format("event_time", "yyyy-MM-dd HH:mm:ss").alias("t"), F.col("raw").alias("file"),
        F.lit(0).cast("bigint").alias("block"), F.lit(0).cast("bigint").alias("row")))


def stream_logon_lines(spark: SparkSession, path: str, files_per_trigger: int | None = None) -> DataFrame:
    """STR1 for logon exports: every line of the exports present and to come, with its ``result``
    (NULL: the line is blank, malformed or has no result) and the text itself."""
    reader = spark.readStream.format("text")
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return reader.load(path).select(
        "value", F.from_json("value", EXPORT_SCHEMA, {"mode": "PERMISSIVE"}).getField("result").alias("result"))


def logon_events_of(lines: DataFrame, dataset: str) -> DataFrame:
    """The auth events of logon lines, with the event-time order key of the sshd stream."""
    rows = lines.where("result is not null").select(F.lit(0).cast("bigint").alias("_arrival"), "result.*")
    return logon_events(rows, dataset).withColumn("seq", F.struct(
        F.date_format("event_time", "yyyy-MM-dd HH:mm:ss.SSS").alias("t"), F.col("raw").alias("file"),
        F.lit(0).cast("bigint").alias("block"), F.lit(0).cast("bigint").alias("row")))


def rejected_lines(lines: DataFrame) -> DataFrame:
    """Lines that are no result, to be kept beside the events; blank lines are no lines."""
    return lines.where(F.col("result").isNull() & (F.trim("value") != "")).select("value")


def stream_timeline(events: DataFrame, delay: str = "1 hour") -> DataFrame:
    """STR2: events per hour and action, emitted once the watermark closes the hour."""
    return (events.withWatermark("event_time", delay)
            .groupBy(F.window("event_time", "1 hour").alias("w"), "action")
            .agg(F.count(F.lit(1)).alias("events"))
            .select(F.col("w.start").alias("hour"), "action", "events"))


PAIR_KEYS = (*KEYS, "user", "host", "span")


def stream_pairs(events: DataFrame, span: str = "1 day", delay: str | None = "1 day") -> DataFrame:
    """STR3: per (source, user, host, span) the aggregates so far (update mode).

    The columns are those :func:`~authsift.operators.correlate.values_of` makes the pair table
    of; ``span`` is the start of the event's window.  All aggregates merge, map tasks
    combine first, and a source of any number of users spreads over all state partitions.
    The state of a span is dropped once the watermark (the latest event time less
    ``delay``) has passed its end; rows later than that are dropped, as in every
    windowed stream; so are rows without a time.  ``delay`` None: the stream has its watermark.
    """
    a = F.col("action")
    if delay:
        events = events.withWatermark("event_time", delay)
    when = lambda cond: F.when(cond, F.col("seq"))
    # the order key holds the whole line: one copy of it in the state for each end
    return (events.groupBy(*KEYS, "user", "host", F.window("event_time", span).alias("w")).agg(
        F.min(F.struct("seq", "log_source", "ts_text")).alias("_first"),
        F.max(F.struct("seq", "ts_text")).alias("_last"),
        F.count_if(a == "failed").alias("failed"),
        F.count_if(a == "accepted").alias("accepted"),
        F.count_if(F.col("invalid_user")).alias("invalid"),
        F.count_if(a == "probe").alias("probes"),
        F.count_if(a == "preauth_disconnect").alias("preauth"),
        F.count_if(a == "max_auth").alias("max_auth"),
        F.min(when(a == "failed")).alias("first_failed"),
        F.max(when(a == "accepted")).alias("last_accepted"))
        .select(*KEYS, "user", "host", F.col("_first.log_source").alias("log_source"),
                F.col("_first.ts_text").alias("first_text"), F.col("_last.ts_text").alias("last_text"),
                F.col("_first.seq").alias("first"), F.col("_last.seq").alias("last"),
                *NUMBERS, "first_failed", "last_accepted", F.col("w.start").alias("span")))


def alerts_of_spans(spans: DataFrame) -> DataFrame:
    """Running alerts of the sources in ``spans``, as the batch correlation makes them."""
    return alerts_of(values_of(spans))


def stream_sessions(events: DataFrame, gap: str = "30 minutes",
                    delay: str = "1 hour") -> DataFrame:
    """STR4: per-source activity sessions (closed sessions only, append mode)."""
    a = F.col("action")
    return (events.withWatermark("event_time", delay)
            .groupBy(F.session_window("event_time", gap).alias("s"), *KEYS)
            .agg(F.count(F.lit(1)).alias("events"),
                 F.count_if(a == "failed").alias("failed"),
                 F.count_if(a == "accepted").alias("accepted"))
            .select(*KEYS, F.col("s.start").alias("session_start"),
                    F.col("s.end").alias("session_end"), "events", "failed", "accepted"))


def stream_case_state(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """STR6: the wide CASE1 row per (dataset, src_ip) over a stream of field updates (update
    mode).  Each field keeps the value of its latest update, whatever the order of arrival;
    an explicit NULL clears a field.  One small state row per case."""
    return cases.case_state(spark.readStream.schema(schema).parquet(path))


def _place(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/authsift-streams/{name}-{uuid.uuid4().hex[:8]}"


def run_available_now(stream: DataFrame, name: str) -> str:
    """Run ``stream`` in append mode over the data present into a parquet folder under the
    shared folder (exactly-once by the sink's log); returns its path."""
    base = _place(stream.sparkSession, name)
    q = (stream.writeStream.option("checkpointLocation", f"{base}/_checkpoint").trigger(availableNow=True)
         .outputMode("append").format("parquet").option("path", f"{base}/out").start())
    q.awaitTermination()
    return f"{base}/out"


_STATE = {  # the rows of a state are not counted, which would read each key before it is written
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.trackTotalNumberOfRows": "false",
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
}


def run_into(stream: DataFrame, checkpoint: str, write: Callable[[DataFrame, int], object]) -> None:
    """Run ``stream`` in update mode over the data present; ``write`` gets each micro-batch
    and its id (the same id again if a batch is replayed).

    The state is kept in RocksDB, off the executors' heap.
    """
    spark = stream.sparkSession
    before = {key: spark.conf.get(key, None) for key in _STATE}
    for key, value in _STATE.items():
        spark.conf.set(key, value)
    try:
        q = (stream.writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True)
             .outputMode("update").foreachBatch(write).start())
        q.awaitTermination()
    finally:
        for key, value in before.items():
            spark.conf.unset(key) if value is None else spark.conf.set(key, value)


def pair_table(spark: SparkSession, root: str, buckets: int = 16, spread: int = 4) -> CurrentTable:
    """Where STR3 keeps its pairs: bucketed by source, so a batch reads its sources' buckets; a bucket
    has ``spread`` files, over which the pairs of one large source are dealt."""
    return CurrentTable(spark, root, PAIR_KEYS, by=tuple(KEYS), buckets=buckets, spread=spread)


def run_alerts(events: DataFrame, name: str = "alerts", **spans: str) -> CurrentTable:
    """STR3 over the events present; returns the current pair table (one row per source, user, host and span)."""
    base = _place(events.sparkSession, name)
    pairs = pair_table(events.sparkSession, f"{base}/pairs")
    run_into(stream_pairs(events, **spans), f"{base}/_checkpoint", pairs.upsert)
    return pairs


def run_union(events: DataFrame, logon_lines: DataFrame, dataset: str, name: str = "union",
              delay: str = "1 day") -> tuple[CurrentTable, DataFrame]:
    """STR1, TAG1: auth events and logon exports as one stream of pairs, each kind under its own
    watermark (the slower one counts); the exports' broken lines go to a table beside.

    Returns the current pair table and the rejected lines.
    """
    spark = events.sparkSession
    base = _place(spark, name)
    columns = ["dataset", "seq", "event_time", "ts_text", "host", "action", "user", "src_ip", "invalid_user", "log_source"]
    both = events.select(*columns).withWatermark("event_time", delay).union(
        logon_events_of(logon_lines, dataset).select(*columns).withWatermark("event_time", delay))
    pairs = pair_table(spark, f"{base}/pairs")
    run_into(stream_pairs(both, delay=None), f"{base}/_checkpoint", pairs.upsert)
    q = (rejected_lines(logon_lines).writeStream.option("checkpointLocation", f"{base}/_rejected_checkpoint")
         .trigger(availableNow=True).outputMode("append").format("parquet").option("path", f"{base}/rejected").start())
    q.awaitTermination()
    return pairs, spark.read.schema("value string").parquet(f"{base}/rejected")


class Triage(NamedTuple):
    """The current tables of STR5 and STR2."""
    pairs: CurrentTable
    verdicts: CurrentTable   # one row per source
    hours: CurrentTable      # events and severity per (source, hour)


def hourly(spans: DataFrame, verdicts: DataFrame) -> DataFrame:
    """Events per (source, hour) of hourly pairs, under the severity of the source's verdict."""
    events = sum((F.col(n) for n in ("accepted", "probes", "preauth", "max_auth")), F.col("failed"))  # an event has one action
    return (spans.groupBy(*KEYS, F.col("span").alias("hour")).agg(F.sum(events).alias("events"))
            .join(verdicts.select(*KEYS, "severity"), KEYS, "left")
            .select(*KEYS, "hour", "events", F.coalesce("severity", F.lit("informational")).alias("severity")))


def severity_timeline(hours: DataFrame) -> DataFrame:
    """ANA7 of the current hours: events per hour and severity of the parent alert."""
    return hours.groupBy("hour", "severity").agg(F.sum("events").alias("events"))


def stream_triage(events: DataFrame, intel: DataFrame | None = None, name: str = "triage",
                  delay: str = "1 day") -> Triage:
    """STR5 and STR2: STR3 by the hour, with the sources of each micro-batch triaged anew.

    Verdicts are upserted by source, and all hours of these sources under their new
    severity: what the hour counted under the old one is thereby retracted, also when
    the verdict comes long after the hour.  The three tables are committed one after
    the other, the pairs first; a batch that fails between is done again from its id.
    """
    spark = events.sparkSession
    base = _place(spark, name)
    out = Triage(pair_table(spark, f"{base}/pairs"), CurrentTable(spark, f"{base}/verdicts", tuple(KEYS)),
                 CurrentTable(spark, f"{base}/hours", (*KEYS, "hour"), by=tuple(KEYS)))

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.persist()
        sources = batch.select(*KEYS).distinct().persist()
        try:
            out.pairs.upsert(batch, batch_id)
            spans = out.pairs.read_for(sources).persist()  # for the verdicts and for the hours
            out.verdicts.upsert(triage_rules(enrich(alerts_of_spans(spans), intel=intel),
                                             keep=("dataset", "first_seq", "log_source")), batch_id)
            out.hours.upsert(hourly(spans, out.verdicts.read_for(sources)), batch_id)
            spans.unpersist()
        finally:
            sources.unpersist()
            batch.unpersist()

    run_into(stream_pairs(events, span="1 hour", delay=delay), f"{base}/_checkpoint", write)
    return out


def run_case_state(spark: SparkSession, path: str, schema: str, name: str = "cases") -> CurrentTable:
    """STR6 over the updates present; returns the current case table."""
    base = _place(spark, name)
    state = CurrentTable(spark, f"{base}/state", tuple(KEYS))
    run_into(stream_case_state(spark, path, schema), f"{base}/_checkpoint", state.upsert)
    return state
