"""The query registry: one entry per inventory group of SURVEY §2.

Every query takes ``(spark, sf_dir)``, reads the driver's tables there (or the
log, events, intel and labels Spark derives from them, see
:mod:`authsift.plans.context`) and returns a DataFrame.  ``ORACLE`` holds the
DuckDB SQL of the same result.  Output columns are flat: arrays appear as
joined text, times as text, so both sides compare value by value.
"""
from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.correlate import (HOSTS, USERS, alerts_of, correlate, ordered_values, raw_evidence,
                                   source_values)
from ..operators.enrich import enrich
from ..operators.parse import parse_audit, parse_events
from ..operators.rank import filter_counts, filter_queue, queue_rows, rank_results
from ..operators.rules import triage_rules
from . import oracle as O
from .context import YEAR, derived

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    def deco(fn: Query) -> Query:
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn
    return deco


# --- shared sub-plans ------------------------------------------------------------------
def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return derived(spark, sf_dir).events()


def pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pair table, written once: (source, kind, value) rows that alerts and lists share."""
    return derived(spark, sf_dir).pairs()


def alerts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return correlate(events(spark, sf_dir))


def enriched(spark: SparkSession, sf_dir: str) -> DataFrame:
    ctx = derived(spark, sf_dir)
    return enrich(correlate(ctx.events()), intel=ctx.intel())


def triaged(spark: SparkSession, sf_dir: str) -> DataFrame:
    return triage_rules(enriched(spark, sf_dir))


def ranked(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rank_results(triaged(spark, sf_dir))


def _ts(c) -> F.Column:
    return F.date_format(c, "yyyy-MM-dd HH:mm:ss")


# --- step 1: sources and parsing ---------------------------------------------------------
@register("parse_events", O.q(O.PIPE, """
SELECT ts_text, host, action, "user", src_ip, invalid_user, method,
       strftime(event_time, '%Y-%m-%d %H:%M:%S') AS event_time, raw FROM parsed"""))
def q_parse_events(spark, sf_dir):
    """SRC1 + PARSE1-9: the derived text log parsed end to end."""
    ev = parse_events(derived(spark, sf_dir).lines(), year=YEAR)
    return ev.select("ts_text", "host", "action", "user", "src_ip", "invalid_user", "method",
                     _ts("event_time").alias("event_time"), "raw")


@register("parse_audit", O.q(O.PIPE, """
SELECT coalesce(action, 'dropped') AS action, CAST(count(*) AS BIGINT) AS lines
FROM (SELECT CASE WHEN kind IN ('closed_user', 'preauth') THEN 'preauth_disconnect' ELSE kind END
             AS action FROM kinds) x GROUP BY 1
UNION ALL SELECT 'total', CAST(count(*) AS BIGINT) FROM lines"""))
def q_parse_audit(spark, sf_dir):
    """PARSE10: line counts per action, dropped, total."""
    return parse_audit(derived(spark, sf_dir).lines())


@register("failed_by_method", O.q(O.PIPE, """
SELECT method, invalid_user, CAST(count(*) AS BIGINT) AS failed
FROM parsed WHERE action = 'failed' GROUP BY 1, 2"""))
def q_failed_by_method(spark, sf_dir):
    return (events(spark, sf_dir).where(F.col("action") == "failed")
            .groupBy("method", "invalid_user").agg(F.count(F.lit(1)).alias("failed")))


# --- step 2: correlation -------------------------------------------------------------------
_ALERT_COLS_SQL = """src_ip, hosts AS hosts_targeted, failed_logins, successful_logins,
  invalid_user_attempts, max_auth_exceeded_events, preauth_disconnects,
  connection_probes_no_auth, usernames AS usernames_targeted, success_after_failures,
  first_seen, last_seen"""


def _flat_alerts(df: DataFrame, *more: str) -> DataFrame:
    return df.select(
        "src_ip", F.array_join("hosts_targeted", ",").alias("hosts_targeted"),
        "failed_logins", "successful_logins", "invalid_user_attempts",
        "max_auth_exceeded_events", "preauth_disconnects", "connection_probes_no_auth",
        F.array_join("usernames_targeted", ",").alias("usernames_targeted"),
        "success_after_failures", "first_seen", "last_seen", *more)


@register("source_alerts", O.q(O.ALERTS, f"SELECT {_ALERT_COLS_SQL} FROM alerts"))
def q_source_alerts(spark, sf_dir):
    """AGG1-AGG11, AGG13: one alert per source ip."""
    return _flat_alerts(alerts(spark, sf_dir))


@register("ordered_usernames", O.q(O.PIPE, """
SELECT src_ip, CAST(row_number() OVER (PARTITION BY src_ip ORDER BY f) AS INTEGER) AS pos, "user"
FROM (SELECT src_ip, "user", min(seq) AS f FROM parsed WHERE "user" <> '' GROUP BY 1, 2) x"""))
def q_ordered_usernames(spark, sf_dir):
    """AGG8: distinct usernames in first-seen order, one row per position."""
    return ordered_values(pairs(spark, sf_dir), USERS, "user").drop("dataset")


@register("ordered_hosts", O.q(O.PIPE, """
SELECT src_ip, CAST(row_number() OVER (PARTITION BY src_ip ORDER BY f) AS INTEGER) AS pos, host
FROM (SELECT src_ip, host, min(seq) AS f FROM parsed GROUP BY 1, 2) x"""))
def q_ordered_hosts(spark, sf_dir):
    """AGG9: distinct hosts in first-seen order."""
    return ordered_values(pairs(spark, sf_dir), HOSTS, "host").drop("dataset")


@register("success_after_failures", O.q(O.ALERTS, """
SELECT src_ip, failed_logins, successful_logins, success_after_failures FROM alerts"""))
def q_success_after_failures(spark, sf_dir):
    """AGG11: any accepted after any failed, per source."""
    return alerts(spark, sf_dir).select("src_ip", "failed_logins", "successful_logins",
                                        "success_after_failures")


@register("first_last_seen", O.q(O.ALERTS, "SELECT src_ip, first_seen, last_seen FROM alerts"))
def q_first_last_seen(spark, sf_dir):
    """AGG10: first and last seen by arrival order."""
    return alerts(spark, sf_dir).select("src_ip", "first_seen", "last_seen")


@register("raw_evidence", O.q(O.PIPE, """
SELECT src_ip, row_number() OVER (PARTITION BY src_ip ORDER BY seq) AS line_no, raw FROM parsed"""))
def q_raw_evidence(spark, sf_dir):
    """AGG12: ordered raw evidence lines per alert."""
    return raw_evidence(events(spark, sf_dir)).select("src_ip", "line_no", "raw")


# --- step 3: enrichment -----------------------------------------------------------------------
@register("internal_sources", O.q(O.ENRICHED, "SELECT src_ip, internal_source FROM enr"))
def q_internal_sources(spark, sf_dir):
    """ENR1: RFC 1918 test."""
    return enriched(spark, sf_dir).select("src_ip", "internal_source")


@register("geo_lookup", O.q(O.ENRICHED, "SELECT src_ip, geolocation FROM enr"))
def q_geo_lookup(spark, sf_dir):
    """ENR2, ENR3: geolocation precedence and prefix join."""
    return enriched(spark, sf_dir).select("src_ip", "geolocation")


@register("geo_prefix_join", O.q(O.ENRICHED, "SELECT src_ip, geolocation FROM enr"))
def q_geo_prefix_join(spark, sf_dir):
    """ENR3, general form: the prefix table as a DataFrame, matched by an
    equi-join on each ip's prefixes of every length present, then min_by."""
    from ..operators import dims as D
    ctx = derived(spark, sf_dir)
    e = enrich(correlate(ctx.events()), intel=ctx.intel(), prefixes=D.geo_prefixes(spark))
    return e.select("src_ip", "geolocation")


@register("intel_lookup", O.q(O.ENRICHED, """
SELECT src_ip, reputation, tags, reports_90d FROM enr"""))
def q_intel_lookup(spark, sf_dir):
    """ENR4, ENR5: reputation lookup with dynamic-over-static precedence."""
    return enriched(spark, sf_dir).select(
        "src_ip", "reputation", F.array_join("tags", ";").alias("tags"),
        F.col("enrichment.threat_intel.reports_90d").alias("reports_90d"))


@register("enriched_alerts", O.q(O.ENRICHED, f"""
SELECT {_ALERT_COLS_SQL}, internal_source, geolocation, reputation FROM enr"""))
def q_enriched_alerts(spark, sf_dir):
    """ENR6: alerts with the enrichment block (flattened for comparison)."""
    e = enriched(spark, sf_dir)
    return _flat_alerts(e, "internal_source", "geolocation", "reputation")


# --- step 4: rules and ranking -----------------------------------------------------------------
@register("triage_rules", O.q(O.TRIAGE, """
SELECT src_ip, rule_id, verdict, severity, confidence, mitre_technique_id, mitre_technique_name
FROM triage"""))
def q_triage_rules(spark, sf_dir):
    """TRI1-TRI7, TRI10: verdict, severity, confidence, technique per alert."""
    return triaged(spark, sf_dir).select(
        "src_ip", "rule_id", "verdict", "severity", "confidence", "mitre_technique_id",
        "mitre_technique_name")


@register("triage_text", O.q(O.TRIAGE, f"""
SELECT src_ip, {O.SUMMARY_SQL} AS summary, actions AS recommended_actions FROM triage"""))
def q_triage_text(spark, sf_dir):
    """TRI8, TRI9: summary text and ordered recommended actions."""
    return triaged(spark, sf_dir).select(
        "src_ip", "summary", F.array_join("recommended_actions", "|").alias("recommended_actions"))


_QUEUE_SQL = """
SELECT rank, src_ip, upper(severity) AS severity, replace(verdict, '_', ' ') AS verdict,
  CAST(confidence AS VARCHAR) || '%' AS confidence, mitre_technique_id AS technique,
  CASE WHEN mitre_technique_name NOT IN ('N/A', '')
       THEN mitre_technique_name || ' (' || mitre_technique_id || ')'
       WHEN verdict = 'false_positive' THEN 'benign activity' ELSE 'unclear pattern' END AS attack
FROM ranked"""


@register("ranked_queue", O.q(O.TRIAGE, _QUEUE_SQL))
def q_ranked_queue(spark, sf_dir):
    """TRI11, TRI12: the ranked analyst queue."""
    return queue_rows(ranked(spark, sf_dir))


@register("triage_from_text", O.q(O.TRIAGE, _QUEUE_SQL))
def q_triage_from_text(spark, sf_dir):
    """The reference's command-line run end to end from the raw text log:
    SRC1 -> PARSE -> AGG -> ENR -> TRI -> ranked queue (no parsed-events table)."""
    from .pipeline import triage_log
    ctx = derived(spark, sf_dir)
    return queue_rows(triage_log(ctx.lines(), intel=ctx.intel(), year=YEAR))


@register("queue_filter", O.q(O.TRIAGE, """
SELECT rank, src_ip, severity, verdict, confidence FROM ranked
WHERE severity IN ('critical', 'high', 'low') AND replace(verdict, '_', ' ') IN ('true positive')
  AND contains(src_ip, '.1.')"""))
def q_queue_filter(spark, sf_dir):
    """FLT1: severity and verdict sets plus an ip substring."""
    return filter_queue(ranked(spark, sf_dir), ["critical", "high", "low"], ["true positive"],
                        ".1.").select("rank", "src_ip", "severity", "verdict", "confidence")


@register("queue_filter_counts", O.q(O.TRIAGE, """
SELECT CAST(count_if(severity IN ('critical', 'high', 'low')
                     AND replace(verdict, '_', ' ') IN ('true positive')
                     AND contains(src_ip, '.1.')) AS BIGINT) AS matched,
  CAST(count(*) AS BIGINT) AS total FROM triage"""))
def q_queue_filter_counts(spark, sf_dir):
    """FLT1: "N of M alerts match" for the same filter."""
    return filter_counts(triaged(spark, sf_dir), ["critical", "high", "low"], ["true positive"],
                         ".1.")


# --- step 5: analytics ----------------------------------------------------------------------------
from ..operators import analytics as A  # noqa: E402
from ..operators import evaluate as EV  # noqa: E402
from ..operators import dims  # noqa: E402


def triaged_wide(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdicts with every enriched-alert column kept: one correlation feeds
    the analytics tables that need both (no self-join)."""
    e = enriched(spark, sf_dir)
    return triage_rules(e, keep=tuple(c for c in e.columns if c != "src_ip"))


def triaged_of_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdicts from the written pair table: the events are not correlated again."""
    ctx = derived(spark, sf_dir)
    return triage_rules(enrich(alerts_of(ctx.pairs()), intel=ctx.intel()))


_CITIES_SQL = ", ".join("('" + c.replace("'", "''") + f"', {lat}::DOUBLE, {lon}::DOUBLE)"
                        for c, lat, lon in dims.CITY_COORDS)
_TACTICS_SQL = ", ".join(f"('{t}', '{a}', {dims.TACTIC_ORDER.index(a)})"
                         for t, a in dims.TACTIC_MAP)


@register("queue_metrics", O.q(O.TRIAGE, """
SELECT CAST(count(*) AS BIGINT) AS alerts,
  CAST(count_if(verdict = 'true_positive') AS BIGINT) AS confirmed_attacks,
  CAST(count_if(verdict = 'needs_investigation') AS BIGINT) AS needs_review,
  CAST(count_if(verdict = 'false_positive') AS BIGINT) AS cleared_benign,
  CAST(count_if(severity = 'critical') AS BIGINT) AS critical FROM triage"""))
def q_queue_metrics(spark, sf_dir):
    """ANA1: header metrics."""
    return A.queue_metrics(triaged(spark, sf_dir))


@register("activity_window", O.q(O.PIPE, """
SELECT strftime(min(event_time), '%Y-%m-%d %H:%M:%S') AS window_start,
  strftime(max(event_time), '%Y-%m-%d %H:%M:%S') AS window_end,
  array_to_string(list_sort(list_distinct(list(host))), ',') AS hosts,
  CAST(count(DISTINCT host) AS BIGINT) AS n_hosts, CAST(count(*) AS BIGINT) AS events,
  (SELECT CAST(count(*) AS BIGINT) FROM lines) AS log_lines
FROM parsed"""))
def q_activity_window(spark, sf_dir):
    """ANA2: activity window, hosts, event and line counts."""
    ctx = derived(spark, sf_dir)
    return A.activity_window(ctx.events(), ctx.lines())


@register("severity_counts", O.q(O.TRIAGE, """
SELECT severity, CAST(count(*) AS BIGINT) AS alerts, sev_rank FROM ranked GROUP BY 1, 3"""))
def q_severity_counts(spark, sf_dir):
    """ANA3: alerts by severity."""
    return A.severity_counts(triaged(spark, sf_dir))


@register("top_techniques", O.q(O.TRIAGE, """
SELECT mitre_technique_name AS technique, CAST(count(*) AS BIGINT) AS alerts FROM triage
WHERE verdict = 'true_positive' AND mitre_technique_name NOT IN ('N/A', '')
GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 8"""))
def q_top_techniques(spark, sf_dir):
    """ANA4: top 8 technique names among confirmed attacks."""
    return A.top_techniques(triaged(spark, sf_dir))


@register("active_sources", O.q(O.ALERTS, """
SELECT src_ip, failed_logins, successful_logins, connection_probes_no_auth,
  failed_logins + successful_logins + connection_probes_no_auth AS total
FROM alerts ORDER BY total DESC, first_seq LIMIT 15"""))
def q_active_sources(spark, sf_dir):
    """ANA5: most active sources (top 15)."""
    return A.active_sources(alerts(spark, sf_dir))


@register("attack_origins", O.q(O.TRIAGE + (f"""
cities(city, lat, lon) AS (VALUES {_CITIES_SQL})""",), """
SELECT c.city, c.lat, c.lon, CAST(x.attacks AS BIGINT) AS attacks,
  90000.0 + 130000.0 * sqrt(x.attacks) AS radius
FROM (SELECT trim(split_part(substr(geolocation, strpos(geolocation, '—') + 1), '(', 1)) AS city,
             count(*) AS attacks
      FROM triage WHERE verdict = 'true_positive' AND contains(geolocation, '—') GROUP BY 1) x
JOIN cities c USING (city)"""))
def q_attack_origins(spark, sf_dir):
    """ANA6: confirmed attacks per city with bubble radius."""
    return A.attack_origins(triaged_wide(spark, sf_dir))


@register("timeline", O.q(O.TRIAGE, """
SELECT strftime(date_trunc('hour', p.event_time), '%Y-%m-%d %H:%M:%S') AS hour,
  coalesce(t.severity, 'informational') AS severity, CAST(count(*) AS BIGINT) AS events
FROM parsed p LEFT JOIN triage t USING (src_ip) GROUP BY 1, 2"""))
def q_timeline(spark, sf_dir):
    """ANA7: events per hour and parent-alert severity."""
    t = A.timeline(events(spark, sf_dir), triaged(spark, sf_dir))
    return t.select(_ts("hour").alias("hour"), "severity", "events")


@register("attack_matrix", O.q(O.TRIAGE + (f"""
tactics(technique_id, tactic, tactic_ord) AS (VALUES {_TACTICS_SQL})""", """
pn AS (
  SELECT mitre_technique_id AS tid, mitre_technique_name AS name, count(*) AS n, min(rank) AS fr
  FROM ranked WHERE verdict = 'true_positive' AND mitre_technique_id NOT IN ('N/A', '')
  GROUP BY 1, 2
)""", """
pid AS (
  SELECT tid, CAST(sum(n) AS BIGINT) AS alerts, first(name ORDER BY n DESC, fr ASC) AS name
  FROM pn GROUP BY tid
)"""), f"""
SELECT coalesce(e.tactic, pa.tactic, 'Other') AS tactic,
  coalesce(e.tactic_ord, pa.tactic_ord, {dims.TACTIC_ORDER.index('Other')}) AS tactic_ord,
  pid.tid AS technique_id, pid.tid || ' — ' || pid.name AS technique, pid.alerts,
  round(pid.alerts / max(pid.alerts) OVER (), 6) AS heat
FROM pid LEFT JOIN tactics e ON e.technique_id = pid.tid
  LEFT JOIN tactics pa ON pa.technique_id = split_part(pid.tid, '.', 1)"""))
def q_attack_matrix(spark, sf_dir):
    """ANA8-ANA10: ATT&CK matrix with tactic fallback and heat fraction."""
    return A.attack_matrix(triaged(spark, sf_dir))


@register("top_accounts", O.q(O.TRIAGE, """
SELECT "user" AS account, CAST(count(*) AS BIGINT) AS attacking_sources
FROM (SELECT DISTINCT src_ip, "user" FROM parsed WHERE "user" <> '') u
JOIN triage t USING (src_ip) WHERE t.verdict = 'true_positive'
GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10"""))
def q_top_accounts(spark, sf_dir):
    """ANA11: top 10 targeted accounts by attacking sources."""
    return A.top_accounts(triaged_of_pairs(spark, sf_dir), pairs(spark, sf_dir))


@register("top_hosts", O.q(O.TRIAGE, """
SELECT host, CAST(count(*) AS BIGINT) AS attack_alerts
FROM (SELECT DISTINCT src_ip, host FROM parsed) h
JOIN triage t USING (src_ip) WHERE t.verdict = 'true_positive'
GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10"""))
def q_top_hosts(spark, sf_dir):
    """ANA12: top 10 targeted hosts by attack alerts."""
    return A.top_hosts(triaged_of_pairs(spark, sf_dir), pairs(spark, sf_dir))


@register("iocs", O.q(O.TRIAGE, """
SELECT src_ip AS indicator, 'ipv4' AS type, severity, mitre_technique_id AS technique,
  reputation, tags, first_seen, last_seen
FROM triage WHERE verdict = 'true_positive' AND NOT internal_source"""))
def q_iocs(spark, sf_dir):
    """ANA13: indicators of compromise."""
    return A.iocs(triaged_wide(spark, sf_dir))


# --- step 6: evaluation ------------------------------------------------------------------------------
def labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return derived(spark, sf_dir).labels()


_EVAL = O.TRIAGE + (O.LABELS,)
_FULL = """(SELECT src_ip, verdict AS predicted FROM triage) r
  FULL JOIN (SELECT src_ip, verdict AS truth FROM labels_d) l USING (src_ip)"""
_METRICS = """
  CAST(count_if(predicted = 'true_positive') AS BIGINT) AS flagged,
  CAST(count_if(predicted = 'true_positive' AND truth = 'true_positive') AS BIGINT) AS true_positives,
  CAST(count_if(predicted = 'true_positive' AND truth = 'false_positive') AS BIGINT) AS false_alarms,
  CAST(count_if(predicted = 'false_positive' AND truth = 'true_positive') AS BIGINT) AS dangerous_misses,
  CAST(count_if(predicted = 'false_positive' AND truth = 'false_positive') AS BIGINT) AS benign_cleared,
  CAST(count_if(predicted = 'needs_investigation' AND truth = 'true_positive') AS BIGINT) AS punted_attacks,
  CAST(count_if(predicted = 'needs_investigation' AND truth = 'false_positive') AS BIGINT) AS punted_benign,
  CAST(count_if(truth = 'true_positive') AS BIGINT) AS labelled_attacks,
  CAST(count_if(truth = 'false_positive') AS BIGINT) AS labelled_benign,
  round(coalesce(count_if(predicted = 'true_positive' AND truth = 'true_positive')::DOUBLE
        / nullif(count_if(predicted = 'true_positive'), 0), 0.0), 6) AS precision,
  round(coalesce(count_if(predicted = 'true_positive' AND truth = 'true_positive')::DOUBLE
        / nullif(count_if(truth = 'true_positive'), 0), 0.0), 6) AS recall"""


@register("confusion", O.q(_EVAL, """
SELECT l.verdict AS truth, t.verdict AS predicted, CAST(count(*) AS BIGINT) AS alerts
FROM triage t JOIN labels_d l USING (src_ip) GROUP BY 1, 2"""))
def q_confusion(spark, sf_dir):
    """EVAL1: labelled results by truth and prediction."""
    return EV.confusion(triaged(spark, sf_dir), labels(spark, sf_dir))


@register("precision_recall", O.q(_EVAL, f"SELECT {_METRICS} FROM {_FULL}"))
def q_precision_recall(spark, sf_dir):
    """EVAL2, EVAL3, EVAL5: precision, recall and outcome counts."""
    return EV.precision_recall(triaged(spark, sf_dir), labels(spark, sf_dir))


@register("dangerous_misses", O.q(_EVAL, f"""
SELECT src_ip FROM {_FULL} WHERE predicted = 'false_positive' AND truth = 'true_positive'"""))
def q_dangerous_misses(spark, sf_dir):
    """EVAL4: attacks cleared as benign."""
    return EV.dangerous_misses(triaged(spark, sf_dir), labels(spark, sf_dir))


@register("verdict_histogram", O.q(O.TRIAGE, """
SELECT verdict, CAST(count(*) AS BIGINT) AS alerts FROM triage GROUP BY 1"""))
def q_verdict_histogram(spark, sf_dir):
    """EVAL6: verdicts over all results."""
    return EV.verdict_histogram(triaged(spark, sf_dir))


@register("disagreements", O.q(_EVAL, """
SELECT l.src_ip, l.verdict AS truth, coalesce(t.verdict, 'missing') AS predicted
FROM labels_d l LEFT JOIN triage t USING (src_ip)
WHERE coalesce(t.verdict, 'missing') <> l.verdict"""))
def q_disagreements(spark, sf_dir):
    """EVAL7: disagreements incl. missing predictions."""
    return EV.disagreements(triaged(spark, sf_dir), labels(spark, sf_dir))


@register("label_match", O.q(_EVAL, """
SELECT l.src_ip, l.verdict AS truth, coalesce(t.verdict, 'missing') AS predicted,
  coalesce(t.verdict, 'missing') = l.verdict AS match
FROM labels_d l LEFT JOIN triage t USING (src_ip)"""))
def q_label_match(spark, sf_dir):
    """EVAL8: per-label results with a match flag."""
    return EV.label_match(triaged(spark, sf_dir), labels(spark, sf_dir))


@register("label_summary", O.q(O.BASE + (O.LABELS,), """
SELECT CAST(count(*) AS BIGINT) AS labels,
  CAST(count_if(verdict = 'true_positive') AS BIGINT) AS attacks,
  CAST(count_if(verdict <> 'true_positive') AS BIGINT) AS benign,
  CAST(count_if(starts_with(notes, 'HARD')) AS BIGINT) AS hard_cases FROM labels_d"""))
def q_label_summary(spark, sf_dir):
    """EVAL9: label counts."""
    return EV.label_summary(labels(spark, sf_dir))


# --- step 7: Windows logon events and source union ----------------------------------------
from datetime import datetime  # noqa: E402

from ..sources.logon_export import logon_events, select_logon_events  # noqa: E402

SEARCH_NOW = datetime(2024, 2, 1)
SEARCH_FROM = datetime(2024, 1, 1)


def windows_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """WIN5-WIN9 + WIN1-WIN4 over the derived raw security table (January 2024)."""
    sel = select_logon_events(derived(spark, sf_dir).security_events(), now=SEARCH_NOW,
                              earliest=SEARCH_FROM, latest=SEARCH_NOW)
    return logon_events(sel, "derived_ad")


@register("logon_events", O.q(O.SECURITY, """
SELECT ts_text, host, action, "user", src_ip, invalid_user, method, raw FROM win"""))
def q_logon_events(spark, sf_dir):
    """WIN1-WIN9: raw security events selected and mapped to auth events."""
    return windows_events(spark, sf_dir).select(
        "ts_text", "host", "action", "user", "src_ip", "invalid_user", "method", "raw")


@register("union_sources", O.q(O.ALERTS + O.SECURITY[1:], """
SELECT 'derived' AS dataset, src_ip, 'sshd_file' AS log_source, failed_logins, successful_logins,
  invalid_user_attempts, usernames AS usernames_targeted, hosts AS hosts_targeted,
  success_after_failures, first_seen, last_seen FROM alerts
UNION ALL
SELECT 'derived_ad', w.src_ip, 'windows_ad', w.failed_logins, w.successful_logins,
  w.invalid_user_attempts, coalesce(u.users, ''), h.hosts, w.success_after_failures,
  w.first_seen, w.last_seen
FROM (SELECT src_ip, CAST(count_if(action = 'failed') AS BIGINT) AS failed_logins,
        CAST(count_if(action = 'accepted') AS BIGINT) AS successful_logins,
        CAST(count_if(invalid_user) AS BIGINT) AS invalid_user_attempts,
        coalesce(min(CASE WHEN action = 'failed' THEN ts_text END)
                 < max(CASE WHEN action = 'accepted' THEN ts_text END), false)
          AS success_after_failures,
        min(ts_text) AS first_seen, max(ts_text) AS last_seen
      FROM win GROUP BY src_ip) w
LEFT JOIN (SELECT src_ip, string_agg("user", ',' ORDER BY f) AS users
           FROM (SELECT src_ip, "user", min(ts_text) AS f FROM win GROUP BY 1, 2) x GROUP BY 1) u
  USING (src_ip)
LEFT JOIN (SELECT src_ip, string_agg(host, ',' ORDER BY f) AS hosts
           FROM (SELECT src_ip, host, min(ts_text) AS f FROM win GROUP BY 1, 2) x GROUP BY 1) h
  USING (src_ip)"""))
def q_union_sources(spark, sf_dir):
    """TAG1: sshd and Windows events in one auth_events table, correlated per source."""
    both = events(spark, sf_dir).unionByName(windows_events(spark, sf_dir))
    a = correlate(both)
    return a.select("dataset", "src_ip", "log_source", "failed_logins", "successful_logins",
                    "invalid_user_attempts",
                    F.array_join("usernames_targeted", ",").alias("usernames_targeted"),
                    F.array_join("hosts_targeted", ",").alias("hosts_targeted"),
                    "success_after_failures", "first_seen", "last_seen")


# --- step 8: case state and feedback --------------------------------------------------------
from ..operators import cases as CS  # noqa: E402


def case_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    return CS.case_state(derived(spark, sf_dir).case_updates())


@register("case_state", O.q(O.CASES, """
SELECT dataset, src_ip, status, assignee, notes, feedback,
  strftime(updated_at, '%Y-%m-%d %H:%M:%S') AS updated_at FROM cases"""))
def q_case_state(spark, sf_dir):
    """CASE1, CASE2: field-level last-write-wins merge of case updates."""
    st = CS.cases_of(case_state(spark, sf_dir), "derived")
    return st.select("dataset", "src_ip", "status", "assignee", "notes", "feedback",
                     _ts("updated_at").alias("updated_at"))


@register("queue_with_cases", O.q(O.TRIAGE + (O.CASE_BLOCK,), """
SELECT r.rank, r.src_ip, upper(r.severity) AS severity, replace(r.verdict, '_', ' ') AS verdict,
  coalesce(c.status, 'New') AS status, coalesce(c.assignee, '') AS assignee
FROM ranked r LEFT JOIN cases c USING (src_ip)"""))
def q_queue_with_cases(spark, sf_dir):
    """CASE3, CASE5: the ranked queue with case status (defaults when no case)."""
    q = CS.with_case_defaults(ranked(spark, sf_dir), case_state(spark, sf_dir))
    return q.select("rank", "src_ip", F.upper("severity").alias("severity"),
                    F.regexp_replace("verdict", "_", " ").alias("verdict"), "status", "assignee")


@register("feedback_table", O.q(O.TRIAGE + (O.CASE_BLOCK,), """
SELECT c.dataset, c.src_ip, coalesce(t.verdict, '') AS ai_verdict,
  c.feedback AS analyst_feedback, coalesce(c.notes, '') AS notes
FROM cases c LEFT JOIN triage t USING (src_ip) WHERE coalesce(c.feedback, '') <> ''"""))
def q_feedback_table(spark, sf_dir):
    """ANA14: analyst feedback joined to the verdict."""
    return CS.feedback_table(case_state(spark, sf_dir), triaged(spark, sf_dir))


@register("feedback_counts", O.q(O.CASES, """
SELECT dataset,
  CAST(count_if(contains(feedback, 'agree') AND NOT contains(feedback, 'dis')) AS BIGINT) AS agree,
  CAST(count_if(NOT (contains(feedback, 'agree') AND NOT contains(feedback, 'dis'))) AS BIGINT)
    AS disagree
FROM cases WHERE coalesce(feedback, '') <> '' GROUP BY dataset"""))
def q_feedback_counts(spark, sf_dir):
    """ANA15: agree / disagree counts."""
    return CS.feedback_counts(case_state(spark, sf_dir))


@register("dataset_fingerprint", O.q(O.BASE, """
SELECT lower(printf('%016x%016x', CAST(h0 AS UBIGINT), CAST(h1 AS UBIGINT))) AS dataset_key FROM (
  SELECT sum(CAST('0x' || substr(md5(raw), 1, 16) AS UBIGINT)::HUGEINT)::HUGEINT % 18446744073709551616 AS h0,
         sum(CAST('0x' || substr(md5(raw), 17, 16) AS UBIGINT)::HUGEINT)::HUGEINT % 18446744073709551616 AS h1 FROM lines)"""))
def q_dataset_fingerprint(spark, sf_dir):
    """CASE4 at scale: order-free fingerprint of the whole derived log."""
    return CS.order_free_fingerprint(derived(spark, sf_dir).lines())


# --- step 10: model request / response tables -------------------------------------------------
from ..operators import model_io as MIO  # noqa: E402

REQUEST_MODEL = "external-triage-model"
REQUEST_SYSTEM = "Triage the authentication alert and answer with the verdict schema."


@register("model_requests")
def q_model_requests(spark, sf_dir):
    """MOD1: one JSON request body per enriched alert."""
    return MIO.model_requests(enriched(spark, sf_dir), REQUEST_MODEL, REQUEST_SYSTEM)


@register("incident_evidence", O.q(O.TRIAGE, """
SELECT t.src_ip, t.severity, t.mitre_technique_id,
  row_number() OVER (PARTITION BY p.src_ip ORDER BY p.seq) AS line_no, p.raw
FROM parsed p JOIN triage t USING (src_ip) WHERE t.verdict = 'true_positive'"""))
def q_incident_evidence(spark, sf_dir):
    """MOD4: per confirmed attack, its verdict and ordered raw lines (JSON headers kept)."""
    verdicts, keys = triaged_wide(spark, sf_dir), ["dataset", "src_ip"]
    attacks = verdicts.where(F.col("verdict") == "true_positive").select(*keys)
    ev = raw_evidence(events(spark, sf_dir).join(attacks, keys, "left_semi"))
    b = MIO.incident_evidence(verdicts, None, ev)
    return b.select("src_ip", "severity", "mitre_technique_id", "line_no", "raw")


# --- step 9: streaming (batch = stream) -------------------------------------------------------
from ..operators.cases import UPDATE_SCHEMA  # noqa: E402
from ..streaming import streams as ST  # noqa: E402


def _stream_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    ctx = derived(spark, sf_dir)
    # several files per micro-batch: state still merges across batches
    return ST.stream_events(spark, ctx.log_path, "derived", year=YEAR, files_per_trigger=4)


@register("stream_timeline", O.q(O.PIPE + ("""
mx AS (SELECT max(event_time) - INTERVAL 1 HOUR AS wm FROM parsed)""",), """
SELECT strftime(date_trunc('hour', event_time), '%Y-%m-%d %H:%M:%S') AS hour, action,
  CAST(count(*) AS BIGINT) AS events
FROM parsed, mx WHERE date_trunc('hour', event_time) + INTERVAL 1 HOUR <= mx.wm
GROUP BY 1, 2"""))
def q_stream_timeline(spark, sf_dir):
    """STR1, STR2: hourly counts per action from a watermarked stream (closed hours)."""
    out = ST.run_available_now(ST.stream_timeline(_stream_events(spark, sf_dir)), "timeline")
    return spark.read.parquet(out).select(_ts("hour").alias("hour"), "action", "events")


@register("stream_alerts", O.q(O.STREAM_ALERTS, f"SELECT {_ALERT_COLS_SQL} FROM alerts"))
def q_stream_alerts(spark, sf_dir):
    """STR3: running alert state per source: pairs from several micro-batches, lists as AGG8/AGG9."""
    table = ST.run_alerts(_stream_events(spark, sf_dir))
    return _flat_alerts(ST.alerts_of_spans(table.read()))


@register("stream_sessions", O.q(O.PIPE + ("""
mx AS (SELECT max(event_time) - INTERVAL 1 HOUR AS wm FROM parsed)""", """
brk AS (
  SELECT src_ip, event_time, action,
    CASE WHEN event_time - lag(event_time) OVER (PARTITION BY src_ip ORDER BY event_time)
              < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS b
  FROM parsed
)""", """
sess AS (
  SELECT *, sum(b) OVER (PARTITION BY src_ip ORDER BY event_time ROWS UNBOUNDED PRECEDING) AS sid
  FROM brk
)"""), """
SELECT src_ip, strftime(min(event_time), '%Y-%m-%d %H:%M:%S') AS session_start,
  strftime(max(event_time) + INTERVAL 30 MINUTE, '%Y-%m-%d %H:%M:%S') AS session_end,
  CAST(count(*) AS BIGINT) AS events, CAST(count_if(action = 'failed') AS BIGINT) AS failed,
  CAST(count_if(action = 'accepted') AS BIGINT) AS accepted
FROM sess, mx GROUP BY src_ip, sid, mx.wm
HAVING max(event_time) + INTERVAL 30 MINUTE <= mx.wm"""))
def q_stream_sessions(spark, sf_dir):
    """STR4: per-source activity sessions (30-minute gap), closed sessions only."""
    out = ST.run_available_now(ST.stream_sessions(_stream_events(spark, sf_dir)), "sessions")
    return spark.read.parquet(out).select(
        "src_ip", _ts("session_start").alias("session_start"),
        _ts("session_end").alias("session_end"), "events", "failed", "accepted")


@register("stream_triage", O.q(O.STREAM_TRIAGE, """
SELECT src_ip, rule_id, verdict, severity, confidence FROM triage"""))
def q_stream_triage(spark, sf_dir):
    """STR5: changed sources triaged per micro-batch, upserted by source."""
    cur = ST.stream_triage(_stream_events(spark, sf_dir), intel=derived(spark, sf_dir).intel())
    return cur.verdicts.read().select("src_ip", "rule_id", "verdict", "severity", "confidence")


@register("stream_severity_timeline", O.q(O.STREAM_TRIAGE, """
SELECT strftime(date_trunc('hour', p.event_time), '%Y-%m-%d %H:%M:%S') AS hour,
  coalesce(t.severity, 'informational') AS severity, CAST(count(*) AS BIGINT) AS events
FROM parsed p LEFT JOIN triage t USING (src_ip) GROUP BY 1, 2"""))
def q_stream_severity_timeline(spark, sf_dir):
    """STR2 as ANA7: hours by parent severity, retracted when a verdict changes."""
    cur = ST.stream_triage(_stream_events(spark, sf_dir), intel=derived(spark, sf_dir).intel(),
                           name="timeline")
    return ST.severity_timeline(cur.hours.read()).select(_ts("hour").alias("hour"), "severity", "events")


@register("stream_case_state", O.q(O.CASES, """
SELECT dataset, src_ip, status, assignee, notes, feedback,
  strftime(updated_at, '%Y-%m-%d %H:%M:%S') AS updated_at FROM cases"""))
def q_stream_case_state(spark, sf_dir):
    """STR6: case updates as a stream, merged field by field into the wide case row."""
    state = ST.run_case_state(spark, derived(spark, sf_dir).cases_path, UPDATE_SCHEMA)
    return state.read().select("dataset", "src_ip", "status", "assignee", "notes", "feedback",
                               _ts("updated_at").alias("updated_at"))


@register("stream_union", O.q(O.STREAM_ALERTS + O.SECURITY[1:] + ("""
wk AS (SELECT *, strftime(CAST(ts_text AS TIMESTAMP), '%Y-%m-%d %H:%M:%S.%g') || raw AS okey FROM win)""",), """
SELECT 'derived' AS dataset, src_ip, failed_logins, successful_logins, invalid_user_attempts,
  usernames AS usernames_targeted, hosts AS hosts_targeted, first_seen, last_seen, CAST(0 AS BIGINT) AS rejected FROM alerts
UNION ALL
SELECT 'derived_ad', src_ip, CAST(count_if(action = 'failed') AS BIGINT), CAST(count_if(action = 'accepted') AS BIGINT),
  CAST(count_if(invalid_user) AS BIGINT),
  (SELECT coalesce(string_agg("user", ',' ORDER BY f), '') FROM (SELECT "user", min(okey) AS f FROM wk x WHERE x.src_ip = wk.src_ip GROUP BY 1)),
  (SELECT coalesce(string_agg(host, ',' ORDER BY f), '') FROM (SELECT host, min(okey) AS f FROM wk x WHERE x.src_ip = wk.src_ip GROUP BY 1)),
  min(ts_text), max(ts_text), CAST(0 AS BIGINT) FROM wk GROUP BY src_ip
UNION ALL
SELECT 'rejected', NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, CAST(count(*) AS BIGINT)
FROM sel WHERE ends_with(src, '7') OR ends_with(src, '3')"""))
def q_stream_union(spark, sf_dir):
    """STR1, TAG1: sshd logs and logon exports in one stream of events; broken lines are kept and counted."""
    ctx = derived(spark, sf_dir)
    export = ctx.logon_export(_selected(spark, sf_dir))
    lines = ST.stream_logon_lines(spark, export, files_per_trigger=2)
    table, rejected = ST.run_union(_stream_events(spark, sf_dir), lines, "derived_ad")
    got = ST.alerts_of_spans(table.read()).select(
        "dataset", "src_ip", "failed_logins", "successful_logins", "invalid_user_attempts",
        F.array_join("usernames_targeted", ",").alias("usernames_targeted"),
        F.array_join("hosts_targeted", ",").alias("hosts_targeted"), "first_seen", "last_seen",
        F.lit(0).cast("bigint").alias("rejected"))
    none = [F.lit(None).cast(f.dataType).alias(f.name) for f in got.schema.fields[1:-1]]
    count = rejected.agg(F.count(F.lit(1)).alias("rejected")).select(F.lit("rejected").alias("dataset"), *none, "rejected")
    return got.unionByName(count)


# --- step 11: written outputs read back, and inputs as files ------------------------------------
from ..operators.rollover import with_rollover  # noqa: E402
from ..session import shared_dir  # noqa: E402
from ..sources import sinks as SK  # noqa: E402
from ..sources.logon_export import read_logon_export, search_window  # noqa: E402
from ..sources.tables import read_intel, read_labels, read_results  # noqa: E402


def _selected(spark: SparkSession, sf_dir: str) -> DataFrame:
    return select_logon_events(derived(spark, sf_dir).security_events(), now=SEARCH_NOW,
                               earliest=SEARCH_FROM, latest=SEARCH_NOW)


def _output(spark: SparkSession, name: str) -> str:
    import uuid
    return f"{shared_dir(spark)}/authsift-outputs/{name}-{uuid.uuid4().hex[:8]}"


@register("logon_export", O.q(O.SECURITY, """
SELECT ts_text, host, action, "user", src_ip, invalid_user, method, raw FROM win"""))
def q_logon_export(spark, sf_dir):
    """SRC2, WIN1-4: an export file with broken lines, read and mapped."""
    path = derived(spark, sf_dir).logon_export(_selected(spark, sf_dir))
    return logon_events(read_logon_export(spark, path), "derived_ad").select(
        "ts_text", "host", "action", "user", "src_ip", "invalid_user", "method", "raw")


@register("source_intel", O.q((O.PROFILED, O.INTEL), """
SELECT ip, geo, reputation, tags, reports_90d FROM intel"""))
def q_source_intel(spark, sf_dir):
    """SRC3: the intel feed from JSON lines."""
    return read_intel(spark, derived(spark, sf_dir).intel_lines(), fmt="jsonl").select(
        "ip", "geo", "reputation", F.array_join("tags", ";").alias("tags"), "reports_90d")


@register("source_labels", O.q(O.BASE + (O.LABELS,), "SELECT src_ip, verdict, notes FROM labels_d"))
def q_source_labels(spark, sf_dir):
    """SRC4: label CSVs; of several rows of a source the last one counts."""
    return read_labels(spark, derived(spark, sf_dir).label_files() + "/*")


@register("written_results", O.q(O.TRIAGE, f"""
SELECT src_ip, verdict, severity, confidence, mitre_technique_id, {O.SUMMARY_SQL} AS summary,
  actions AS recommended_actions FROM triage"""))
def q_written_results(spark, sf_dir):
    """SNK1, SRC5: ranked verdicts written twice under one batch, and read back."""
    path, rows = _output(spark, "results"), ranked(spark, sf_dir)
    for _ in range(2):  # the second is the repeated job
        SK.write_results(rows, path, batch="b1")
    return read_results(spark, f"{path}/{SK.BATCH}=*", multiline=False).select(
        "src_ip", "verdict", "severity", "confidence", "mitre_technique_id", "summary",
        F.array_join("recommended_actions", "|").alias("recommended_actions"))


@register("written_iocs", ORACLE["iocs"])
def q_written_iocs(spark, sf_dir):
    """SNK2: indicators as CSV, read back."""
    path = _output(spark, "iocs")
    found = A.iocs(triaged_wide(spark, sf_dir))
    for _ in range(2):
        SK.write_iocs(found, path, batch="b1")
    ddl = ", ".join(f"{f.name} string" for f in found.schema)
    return spark.read.schema(ddl).csv(f"{path}/{SK.BATCH}=*", header=True, escape='"') \
        .withColumn("tags", F.coalesce("tags", F.lit("")))


@register("written_blocklist", O.q(O.TRIAGE, """
SELECT src_ip AS indicator FROM triage WHERE verdict = 'true_positive' AND NOT internal_source"""))
def q_written_blocklist(spark, sf_dir):
    """SNK3: the blocklist, read back."""
    path = _output(spark, "blocklist")
    SK.write_blocklist(A.iocs(triaged_wide(spark, sf_dir)), path, batch="b1")
    return spark.read.text(f"{path}/{SK.BATCH}=*").select(F.col("value").alias("indicator"))


@register("written_feedback", ORACLE["feedback_table"])
def q_written_feedback(spark, sf_dir):
    """SNK4: analyst feedback as CSV, read back."""
    path = _output(spark, "feedback")
    table = CS.feedback_table(case_state(spark, sf_dir), triaged(spark, sf_dir))
    SK.write_feedback(table, path, batch="b1")
    back = spark.read.schema(", ".join(f"{f.name} string" for f in table.schema)) \
        .csv(f"{path}/{SK.BATCH}=*", header=True, escape='"')
    return back.select("dataset", "src_ip", *[F.coalesce(c, F.lit("")).alias(c)
                                              for c in ("ai_verdict", "analyst_feedback", "notes")])


@register("written_case_updates", ORACLE["case_state"])
def q_written_case_updates(spark, sf_dir):
    """SNK5: case updates appended in two batches, one of them twice, and merged from the table."""
    path, ups = _output(spark, "case-updates"), derived(spark, sf_dir).case_updates()
    for batch in (0, 1, 0):
        SK.append_case_updates(ups.where(F.col("update_id") % 2 == batch), path, batch=batch)
    stored = spark.read.parquet(path).drop(SK.BATCH)
    if stored.count() != ups.count():
        raise RuntimeError("a repeated batch was appended twice")
    return CS.case_state(stored).select("dataset", "src_ip", "status", "assignee", "notes", "feedback",
                                        _ts("updated_at").alias("updated_at"))


# --- step 12: model tables, engines and datasets -------------------------------------------------
@register("model_request_fields", O.q(O.ENRICHED, """
SELECT src_ip AS custom_id, 'external-triage-model' AS model, 'user' AS role, src_ip, failed_logins,
  success_after_failures, hosts AS hosts_targeted, reputation, geolocation FROM enr"""))
def q_model_request_fields(spark, sf_dir):
    """MOD1: the request bodies, parsed field by field."""
    body = F.from_json("body", "model string, messages array<struct<role:string,content:string>>")
    alert = F.from_json(F.regexp_extract("m.content", r"(?s)\n(\{.*)$", 1), "src_ip string, failed_logins bigint, "
                        "success_after_failures boolean, hosts_targeted array<string>, "
                        "enrichment struct<geolocation:string,threat_intel:struct<reputation:string>>")
    return (q_model_requests(spark, sf_dir).select("custom_id", body.alias("b"))
            .select("custom_id", "b.model", F.explode("b.messages").alias("m"))
            .select("custom_id", "model", "m.role", alert.alias("a"))
            .select("custom_id", "model", "role", "a.src_ip", "a.failed_logins", "a.success_after_failures",
                    F.array_join("a.hosts_targeted", ",").alias("hosts_targeted"),
                    F.col("a.enrichment.threat_intel.reputation").alias("reputation"),
                    F.col("a.enrichment.geolocation").alias("geolocation")))


_RESPONSE_FAULT = "CAST(split_part(src_ip, '.', 4) AS INTEGER) % 7"


def _responses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Response bodies derived from the verdicts; some are wrong, by the address's last part."""
    t = triaged(spark, sf_dir)
    fault = F.substring_index("src_ip", ".", -1).cast("int") % 7
    good = F.to_json(F.struct(
        "src_ip", F.when(fault == 1, "maybe").otherwise(F.col("verdict")).alias("verdict"), "severity",
        F.when(fault == 2, F.lit(140)).otherwise(F.col("confidence")).alias("confidence"), "mitre_technique_id",
        "mitre_technique_name", F.when(fault != 3, F.col("summary")).alias("summary"), "recommended_actions"))
    return t.select(F.col("src_ip").alias("custom_id"),
                    F.when(fault == 4, F.substring(good, 1, 30)).otherwise(good).alias("response"))


@register("model_responses", O.q(O.TRIAGE, f"""
SELECT CASE WHEN {_RESPONSE_FAULT} BETWEEN 1 AND 4 THEN 'rejected' ELSE verdict END AS outcome,
  CAST(count(*) AS BIGINT) AS responses,
  CAST(sum(CASE WHEN {_RESPONSE_FAULT} BETWEEN 1 AND 4 THEN 0 ELSE confidence END) AS BIGINT) AS confidence
FROM triage GROUP BY 1"""))
def q_model_responses(spark, sf_dir):
    """MOD2: responses validated and written in one job, valid and rejected rows read back."""
    got = MIO.write_validated(_responses(spark, sf_dir), _output(spark, "responses"))
    rows = got.valid.select(F.col("verdict").alias("outcome"), "confidence").unionByName(
        got.rejected.select(F.lit("rejected").alias("outcome"), F.lit(0).alias("confidence")))
    out = rows.groupBy("outcome").agg(F.count(F.lit(1)).alias("responses"), F.sum("confidence").alias("confidence"))
    if got.counts["valid"] != got.valid.count() or got.counts["rejected"] != got.rejected.count():
        raise RuntimeError(f"the observed counts {got.counts} are not those of the table")
    return out


def _count_scorer(pdf):
    """An engine that looks at failed logins only."""
    import pandas as pd
    attack = pdf["failed_logins"] >= 4
    return pd.DataFrame({
        "src_ip": pdf["src_ip"], "verdict": attack.map({True: "true_positive", False: "false_positive"}),
        "severity": attack.map({True: "high", False: "informational"}), "confidence": 70,
        "mitre_technique_id": "N/A", "mitre_technique_name": "N/A", "summary": "",
        "recommended_actions": [[] for _ in range(len(pdf))]})


_COUNT_SQL = "CASE WHEN failed_logins >= 4 THEN 'true_positive' ELSE 'false_positive' END"


def _scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    return MIO.score_with(enriched(spark, sf_dir), _count_scorer)


@register("scored_alerts", O.q(O.ALERTS, f"""
SELECT src_ip, {_COUNT_SQL} AS verdict, 70 AS confidence FROM alerts"""))
def q_scored_alerts(spark, sf_dir):
    """MOD3: a supplied engine over Arrow batches of alerts."""
    return _scored(spark, sf_dir).select("src_ip", "verdict", "confidence")


@register("engine_misses", O.q(O.ALERTS + (O.LABELS,), f"""
SELECT src_ip FROM (SELECT src_ip, {_COUNT_SQL} AS predicted FROM alerts) r
JOIN labels_d l USING (src_ip) WHERE predicted = 'false_positive' AND l.verdict = 'true_positive'"""))
def q_engine_misses(spark, sf_dir):
    """EVAL4 on an engine that misses: attacks that the counting engine clears."""
    return EV.dangerous_misses(_scored(spark, sf_dir), labels(spark, sf_dir))


@register("engine_compare", O.q(_EVAL, f"""
SELECT 'rules' AS engine, {_METRICS} FROM {_FULL}
UNION ALL
SELECT 'failed_count' AS engine, {_METRICS} FROM {_FULL.replace("verdict AS predicted FROM triage", _COUNT_SQL + " AS predicted FROM alerts")}"""))
def q_engine_compare(spark, sf_dir):
    """EVAL11: the rule engine and the counting engine of MOD3, scored side by side."""
    rules = triaged(spark, sf_dir).select("src_ip", "verdict", F.lit("rules").alias("engine"))
    counting = _scored(spark, sf_dir).select("src_ip", "verdict", F.lit("failed_count").alias("engine"))
    return EV.engine_compare(rules.unionByName(counting), labels(spark, sf_dir))


@register("dataset_labels", O.q(_EVAL, f"""
SELECT {_METRICS} FROM (
  SELECT 'derived' AS dataset, src_ip, verdict AS predicted FROM triage
  UNION ALL SELECT 'turned', src_ip, verdict FROM triage) r
FULL JOIN (
  SELECT 'derived' AS dataset, src_ip, verdict AS truth FROM labels_d
  UNION ALL SELECT 'turned', src_ip, CASE verdict WHEN 'true_positive' THEN 'false_positive' ELSE 'true_positive' END
  FROM labels_d) l USING (dataset, src_ip)"""))
def q_dataset_labels(spark, sf_dir):
    """EVAL10: the same sources in two datasets whose labels disagree; a label holds for its own dataset."""
    t, lab = triaged(spark, sf_dir).select("dataset", "src_ip", "verdict"), labels(spark, sf_dir)
    turned = F.when(F.col("verdict") == "true_positive", "false_positive").otherwise("true_positive")
    both = t.unionByName(t.withColumn("dataset", F.lit("turned")))
    truth = lab.select(F.lit("derived").alias("dataset"), "src_ip", "verdict").unionByName(
        lab.select(F.lit("turned").alias("dataset"), "src_ip", turned.alias("verdict")))
    return EV.precision_recall(both, truth)


# --- step 13: search windows and years --------------------------------------------------------------
_WINDOWS = {  # earliest, latest, and the same bounds in DuckDB SQL
    "day": ("-24h@h", "now", "date_trunc('hour', n - INTERVAL 24 HOUR)", "n"),
    "week": ("-7d@d", "@d", "date_trunc('day', n - INTERVAL 7 DAY)", "date_trunc('day', n)"),
    "monday": ("@w1", "now", "date_trunc('week', n)", "n"),
    "month": ("-1mon@mon", "@mon", "date_trunc('month', n - INTERVAL 1 MONTH)", "date_trunc('month', n)"),
    "quarter": ("@q", "+1q@q", "date_trunc('quarter', n)", "date_trunc('quarter', n + INTERVAL 3 MONTH)"),
    "shift": ("-1d@d+8h", "-1d@d+16h", "date_trunc('day', n - INTERVAL 1 DAY) + INTERVAL 8 HOUR",
              "date_trunc('day', n - INTERVAL 1 DAY) + INTERVAL 16 HOUR"),
}
_WINDOWS_NOW = datetime(2024, 1, 18, 15, 42, 7)


@register("search_windows", O.q(O.SECURITY, "\nUNION ALL\n".join(f"""
SELECT '{name}' AS search, CAST(count(*) AS BIGINT) AS events
FROM sec, (SELECT TIMESTAMP '{_WINDOWS_NOW}' AS n) t WHERE event_time >= {lo} AND event_time < {hi}"""
    for name, (_, _, lo, hi) in _WINDOWS.items())))
def q_search_windows(spark, sf_dir):
    """WIN8: events of relative search windows; one scan counts them all."""
    raw = derived(spark, sf_dir).security_events()
    counts = []
    for name, (earliest, latest, *_) in _WINDOWS.items():
        lo, hi = (F.lit(t.isoformat(sep=" ")).cast("timestamp") for t in search_window(_WINDOWS_NOW, earliest, latest))
        counts.append(F.count_if((F.col("event_time") >= lo) & (F.col("event_time") < hi)).alias(name))
    row = raw.agg(*counts)
    return row.select(F.explode(F.map_from_arrays(F.array(*map(F.lit, _WINDOWS)), F.array(*_WINDOWS))).alias("search", "events"))


@register("rollover_events", """
SELECT strftime(CAST(o_orderdate AS DATE), '%Y-%m-%d') || ' ' || lpad(CAST(o_orderkey % 24 AS VARCHAR), 2, '0') || ':'
  || lpad(CAST(o_orderkey % 60 AS VARCHAR), 2, '0') || ':' || lpad(CAST(o_orderkey % 59 AS VARCHAR), 2, '0') AS event_time,
  'user' || o_custkey AS "user", 'shop' || (o_orderkey % 3) AS host
FROM orders""")
def q_rollover_events(spark, sf_dir):
    """PARSE9: a log over seven years in several files; the lines have no year."""
    from ..sources.auth_log import read_auth_log
    ctx = derived(spark, sf_dir)
    first = ctx.table("orders").agg(F.min(F.year("o_orderdate"))).first()[0]
    ev = with_rollover(parse_events(read_auth_log(spark, ctx.order_log(), "orders")), first)
    return ev.select(F.date_format("event_time", "yyyy-MM-dd HH:mm:ss").alias("event_time"), "user", "host")
