"""ANA1-ANA13: analyst tables over triage results, alerts and events.

``results`` is a verdict table (``dataset, src_ip, verdict, severity,
confidence, mitre_technique_*``); ``alerts`` is an enriched alert table.
Functions that need both accept them separately (results from any engine)
or, with ``alerts=None``, one wide table that carries the alert columns next
to the verdicts (``triage_rules(..., keep=<alert columns>)``), which needs no
join and computes the correlation once.  Everything is an aggregate; the
per-event timeline pre-aggregates events per (source, hour) before it meets
the verdicts, so the join never sees raw events.
"""
from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import py_strip
from . import dims
from .correlate import HOSTS, USERS

KEYS = ["dataset", "src_ip"]


def _attacks(results: DataFrame) -> DataFrame:
    return results.where(F.col("verdict") == "true_positive")


def queue_metrics(results: DataFrame) -> DataFrame:
    """ANA1: header counts in one aggregate."""
    v, s = F.col("verdict"), F.col("severity")
    return results.agg(
        F.count(F.lit(1)).alias("alerts"),
        F.count_if(v == "true_positive").alias("confirmed_attacks"),
        F.count_if(v == "needs_investigation").alias("needs_review"),
        F.count_if(v == "false_positive").alias("cleared_benign"),
        F.count_if(s == "critical").alias("critical"))


def activity_window(events: DataFrame, lines: DataFrame | None = None) -> DataFrame:
    """ANA2: first/last event time, sorted distinct hosts, event (and line) counts."""
    agg = events.agg(
        F.date_format(F.min("event_time"), "yyyy-MM-dd HH:mm:ss").alias("window_start"),
        F.date_format(F.max("event_time"), "yyyy-MM-dd HH:mm:ss").alias("window_end"),
        F.array_join(F.array_sort(F.collect_set("host")), ",").alias("hosts"),
        F.count_distinct("host").alias("n_hosts"),
        F.count(F.lit(1)).alias("events"))
    if lines is None:
        return agg
    # the line count is a scalar subquery: no join between the two aggregates
    return agg.withColumn("log_lines", lines.agg(F.count(F.lit(1))).scalar())


def severity_counts(results: DataFrame) -> DataFrame:
    """ANA3: alerts per severity, with the severity order."""
    return results.groupBy("severity").agg(F.count(F.lit(1)).alias("alerts")) \
        .withColumn("sev_rank", dims.severity_rank(F.col("severity")))


def top_techniques(results: DataFrame, k: int = 8) -> DataFrame:
    """ANA4: most frequent technique names among confirmed attacks (top ``k``)."""
    name = F.col("mitre_technique_name")
    return (_attacks(results).where(~name.isin("N/A", ""))
            .groupBy(name.alias("technique")).agg(F.count(F.lit(1)).alias("alerts"))
            .orderBy(F.col("alerts").desc(), F.col("technique")).limit(k))


def active_sources(alerts: DataFrame, k: int = 15) -> DataFrame:
    """ANA5: top ``k`` sources by failed + accepted + probes (first seen breaks ties)."""
    total = (F.col("failed_logins") + F.col("successful_logins")
             + F.col("connection_probes_no_auth"))
    return (alerts.select("src_ip", "failed_logins", "successful_logins",
                          "connection_probes_no_auth", total.alias("total"), "first_seq")
            .orderBy(F.col("total").desc(), F.col("first_seq")).limit(k).drop("first_seq"))


def attack_city(geo: F.Column) -> F.Column:
    """Text between the em dash and '(' of a geolocation, trimmed (NULL without a dash)."""
    after = F.element_at(F.split(geo, "—", 2), 2)
    return F.when(geo.contains("—"), py_strip(F.element_at(F.split(after, r"\(", 2), 1)))


def _attack_alerts(results: DataFrame, alerts: DataFrame | None, cols: list[str]) -> DataFrame:
    """Confirmed attacks with alert columns ``cols``: directly from a wide table,
    else verdicts joined to the alert table."""
    att = _attacks(results)
    if alerts is None:
        return att
    return att.join(alerts.select(*KEYS, *cols), KEYS)


def attack_origins(results: DataFrame, alerts: DataFrame | None = None) -> DataFrame:
    """ANA6: confirmed attacks per known city, bubble radius 90,000 + 130,000 * sqrt(n)."""
    spark = results.sparkSession
    geo = _attack_alerts(results.select(*KEYS, "verdict") if alerts is not None else results,
                         alerts, ["geolocation"])
    per_city = (geo.select(attack_city(F.col("geolocation")).alias("city"))
                .where(F.col("city").isNotNull())
                .groupBy("city").agg(F.count(F.lit(1)).alias("attacks")))
    return (per_city.join(F.broadcast(dims.cities(spark)), "city")
            .select("city", "lat", "lon", "attacks",
                    (F.lit(90_000.0) + F.lit(130_000.0) * F.sqrt("attacks")).alias("radius")))


def timeline(events: DataFrame, results: DataFrame) -> DataFrame:
    """ANA7: events per hour and parent-alert severity (no verdict -> informational)."""
    per_source = (events.where(F.col("event_time").isNotNull())
                  .groupBy(*KEYS, F.date_trunc("hour", "event_time").alias("hour"))
                  .agg(F.count(F.lit(1)).alias("n")))
    sev = results.select(*KEYS, "severity")
    return (per_source.join(sev, KEYS, "left")
            .groupBy("hour", F.coalesce("severity", F.lit("informational")).alias("severity"))
            .agg(F.sum("n").alias("events")))


def attack_matrix(results: DataFrame) -> DataFrame:
    """ANA8-ANA10: confirmed attacks per technique id with the most frequent name
    (ties: the name met first in ranked order), its tactic and heat fraction.

    "First in ranked order" is the smallest rank key (severity order,
    confidence descending, first seen), so no global rank is needed.  The
    matrix has one row per technique id, bounded by the technique catalog, so
    the share-of-max window runs over a tiny table.
    """
    spark = results.sparkSession
    tid, name = F.col("mitre_technique_id"), F.col("mitre_technique_name")
    rank_key = F.struct(dims.severity_rank(F.col("severity")).alias("s"),
                        (-F.col("confidence")).alias("c"), F.col("first_seq").alias("f"))
    per_name = (_attacks(results).where(~tid.isin("N/A", ""))
                .groupBy(tid.alias("tid"), name.alias("name"))
                .agg(F.count(F.lit(1)).alias("n"), F.min(rank_key).alias("first_key")))
    per_id = per_name.groupBy("tid").agg(
        F.sum("n").alias("alerts"),
        F.min_by("name", F.struct((-F.col("n")).alias("n"), F.col("first_key"))).alias("name"))
    tac = dims.tactics(spark)
    exact = F.broadcast(tac.select(F.col("technique_id").alias("tid"),
                                   F.col("tactic").alias("t1"), F.col("tactic_ord").alias("o1")))
    parent = F.broadcast(tac.select(F.col("technique_id").alias("parent"),
                                    F.col("tactic").alias("t2"), F.col("tactic_ord").alias("o2")))
    other_ord = dims.TACTIC_ORDER.index("Other")
    m = (per_id.withColumn("parent", F.substring_index("tid", ".", 1))
         .join(exact, "tid", "left").join(parent, "parent", "left")
         .select("tid", "name", "alerts",
                 F.coalesce("t1", "t2", F.lit("Other")).alias("tactic"),
                 F.coalesce("o1", "o2", F.lit(other_ord)).alias("tactic_ord")))
    share = F.col("alerts") / F.max("alerts").over(Window.partitionBy())
    return m.select("tactic", "tactic_ord", F.col("tid").alias("technique_id"),
                    F.concat_ws(" — ", "tid", "name").alias("technique"), "alerts",
                    F.round(share, 6).alias("heat"))


def _top_values(results: DataFrame, pairs: DataFrame, kind: str, name: str, count: str,
                k: int) -> DataFrame:
    """Values of one kind by the number of attacking sources that have them (top ``k``)."""
    attacks = _attacks(results).select(*KEYS)
    return (pairs.where((F.col("kind") == kind) & (F.col("val") != ""))
            .join(attacks, KEYS, "left_semi")
            .groupBy(F.col("val").alias(name)).agg(F.count(F.lit(1)).alias(count))
            .orderBy(F.col(count).desc(), name).limit(k))


def top_accounts(results: DataFrame, pairs: DataFrame, k: int = 10) -> DataFrame:
    """ANA11: accounts by number of attacking sources (top ``k``, name breaks ties), from
    the pair table (:func:`authsift.operators.correlate.source_values`)."""
    return _top_values(results, pairs, USERS, "account", "attacking_sources", k)


def top_hosts(results: DataFrame, pairs: DataFrame, k: int = 10) -> DataFrame:
    """ANA12: hosts by number of attack alerts (top ``k``), from the pair table."""
    return _top_values(results, pairs, HOSTS, "host", "attack_alerts", k)


def iocs(results: DataFrame, alerts: DataFrame | None = None) -> DataFrame:
    """ANA13: indicators of compromise: confirmed attacks from external sources."""
    cols = ["internal_source", "reputation", "tags", "first_seen", "last_seen"]
    base = _attack_alerts(results.select(*KEYS, "verdict", "severity", "mitre_technique_id")
                          if alerts is not None else results, alerts, cols)
    return (base.where(~F.col("internal_source"))
            .select(F.col("src_ip").alias("indicator"), F.lit("ipv4").alias("type"),
                    "severity", F.col("mitre_technique_id").alias("technique"),
                    "reputation",
                    F.array_join(F.coalesce("tags", F.array().cast("array<string>")), ";")
                    .alias("tags"),
                    "first_seen", "last_seen"))
