"""AGG1-AGG13: typed events -> one alert per (dataset, source ip).

Two aggregation levels, two shuffles, one pass over the events:

1. every event becomes two keyed rows, (``u``, user) and (``h``, host), and
   is aggregated by (dataset, src_ip, kind, value) with map-side partial
   aggregation, so a source that owns a third of all events still ships only
   one row per distinct user/host per map task;
   This is the pair table, :func:`source_values`;
2. those rows are aggregated by (dataset, src_ip) (:func:`alerts_of`).

Order-dependent fields are min/max over the BIGINT arrival key ``seq`` (see
:mod:`authsift.functions.ordering`): first/last seen are ``min_by`` /
``max_by``; "success after failures" is ``min(seq of failed) < max(seq of
accepted)`` (any accepted after any failed, per source across accounts).

An alert carries the numbers of its users and hosts and, in the reference's shape, their
ordered lists.  Only a plan that reads a list gathers it (one entry per distinct
user or host of a source); whatever needs positions, counts or top values at any
skew reads the pair table: :func:`ordered_values` numbers it over all partitions.
"""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.ordering import number_rows

KEYS = ["dataset", "src_ip"]
USERS, HOSTS = "u", "h"  # kinds of pairs


def _count(cond) -> F.Column:
    return F.count_if(cond)


def _ordered_values(kind: str) -> F.Column:
    """Distinct values of one kind in first-seen order (empty users skipped)."""
    pairs = F.collect_list(F.when((F.col("kind") == kind) & (F.col("val") != ""),
                                  F.struct(F.col("first"), F.col("val"))))
    return F.array_distinct(F.transform(F.array_sort(pairs), lambda x: x["val"]))


NUMBERS = ("failed", "accepted", "invalid", "probes", "preauth", "max_auth")


def source_values(events: DataFrame) -> DataFrame:
    """``auth_events`` -> the pair table: one row per (source, kind, value).

    Events are first reduced to one row per (source, user, host), then these
    rows are split into (source, user) and (source, host) rows.  ``first`` / ``last``
    are order keys, ``first_text`` / ``last_text`` the log's own times; events without
    a user are the user ``''``.  Every event counts once, on its user row.
    """
    a = F.col("action")
    reduced = events.groupBy(*KEYS, "log_source", "user", "host").agg(
        F.min("seq").alias("first"),
        F.max("seq").alias("last"),
        F.min_by("ts_text", "seq").alias("first_text"),
        F.max_by("ts_text", "seq").alias("last_text"),
        _count(a == "failed").alias("failed"),
        _count(a == "accepted").alias("accepted"),
        _count(F.col("invalid_user")).alias("invalid"),
        _count(a == "probe").alias("probes"),
        _count(a == "preauth_disconnect").alias("preauth"),
        _count(a == "max_auth").alias("max_auth"),
        F.min(F.when(a == "failed", F.col("seq"))).alias("first_failed"),
        F.max(F.when(a == "accepted", F.col("seq"))).alias("last_accepted"),
    )
    return values_of(reduced)


def values_of(reduced: DataFrame) -> DataFrame:
    """Aggregates per (source, user, host), any number of rows of each, -> the pair table."""
    keyed = reduced.select(
        *KEYS, "log_source", "first", "last", "first_text", "last_text", "first_failed",
        "last_accepted", *NUMBERS,
        F.inline(F.array(F.struct(F.lit(USERS).alias("kind"), F.col("user").alias("val")),
                         F.struct(F.lit(HOSTS).alias("kind"), F.col("host").alias("val")))))
    u = F.col("kind") == USERS
    # an order key may hold a whole line: one copy of it for each end
    return keyed.groupBy(*KEYS, "kind", "val").agg(
        F.min(F.struct("first", "log_source", "first_text")).alias("_first"),
        F.max(F.struct("last", "last_text")).alias("_last"),
        *(F.coalesce(F.sum(F.when(u, F.col(n))), F.lit(0)).alias(n) for n in NUMBERS),
        F.min("first_failed").alias("first_failed"),
        F.max("last_accepted").alias("last_accepted"),
    ).select(*KEYS, "kind", "val", "_first.log_source", "_first.first_text", "_last.last_text", "_first.first",
             "_last.last", *NUMBERS, "first_failed", "last_accepted")


def alerts_of(pairs: DataFrame) -> DataFrame:
    """The pair table -> ``source_alerts``.

    Columns: dataset, src_ip, log_source, hosts_targeted, failed_logins,
    successful_logins, invalid_user_attempts, max_auth_exceeded_events,
    preauth_disconnects, connection_probes_no_auth, usernames_targeted,
    success_after_failures, first_seen, last_seen, first_seq, last_seq, n_users, n_hosts.
    """
    known = F.col("val") != ""
    alerts = pairs.groupBy(*KEYS).agg(
        F.min_by("log_source", "first").alias("log_source"),
        _ordered_values(HOSTS).alias("hosts_targeted"),
        F.sum("failed").alias("failed_logins"),
        F.sum("accepted").alias("successful_logins"),
        F.sum("invalid").alias("invalid_user_attempts"),
        F.sum("max_auth").alias("max_auth_exceeded_events"),
        F.sum("preauth").alias("preauth_disconnects"),
        F.sum("probes").alias("connection_probes_no_auth"),
        _ordered_values(USERS).alias("usernames_targeted"),
        F.coalesce(F.min("first_failed") < F.max("last_accepted"), F.lit(False))
        .alias("success_after_failures"),
        F.min_by("first_text", "first").alias("first_seen"),
        F.max_by("last_text", "last").alias("last_seen"),
        F.min("first").alias("first_seq"),
        F.max("last").alias("last_seq"),
        F.count_if((F.col("kind") == USERS) & known).alias("n_users"),
        F.count_if((F.col("kind") == HOSTS) & known).alias("n_hosts"),
    )

    return (alerts
            .select(*KEYS, "log_source", "hosts_targeted", "failed_logins", "successful_logins",
                    "invalid_user_attempts", "max_auth_exceeded_events", "preauth_disconnects",
                    "connection_probes_no_auth", "usernames_targeted",
                    "success_after_failures", "first_seen", "last_seen", "first_seq",
                    "last_seq", "n_users", "n_hosts"))


def correlate(events: DataFrame) -> DataFrame:
    """``auth_events`` -> ``source_alerts`` (see :func:`alerts_of`)."""
    return alerts_of(source_values(events))


def ordered_values(pairs: DataFrame, kind: str, name: str) -> DataFrame:
    """AGG8, AGG9: a source's distinct values in first-seen order, one row per position:
    ``dataset, src_ip, pos, <name>``.

    The positions come from per-partition counts of one range sort, so a source
    with any number of users spreads over all partitions.
    """
    of = pairs.where((F.col("kind") == kind) & (F.col("val") != "")) \
        .select(*KEYS, "first", F.col("val").alias(name))
    return number_rows(of, ["first", name], KEYS, "pos") \
        .select(*KEYS, F.col("pos").cast("int").alias("pos"), name)


def raw_evidence(events: DataFrame) -> DataFrame:
    """AGG12: ordered raw lines per alert as a table (dataset, src_ip, line_no, raw).

    Numbered with :func:`number_rows`, which spreads even a source holding a
    third of all lines over every partition (no per-source window task).
    """
    return number_rows(events.select(*KEYS, "seq", "raw"), ["seq"], KEYS, "line_no") \
        .select(*KEYS, "line_no", "raw")
