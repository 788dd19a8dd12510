"""MOD1-MOD4: tables in and out of an external scoring model.

The reference sends each enriched alert to a hosted model and validates the
structured answer.  Here the model is outside the job: MOD1 writes request
bodies (partitioned to N files for a batch scorer), MOD2 validates response
bodies against the verdict schema, MOD3 runs a user-supplied scorer with the
rule engine's input/output contract, and MOD4 assembles incident evidence.
"""
from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import NamedTuple

import pandas as pd
from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from .dims import SEVERITY_ORDER, VERDICTS

RESULT_SCHEMA = ("src_ip string, verdict string, severity string, confidence int, "
                 "mitre_technique_id string, mitre_technique_name string, summary string, "
                 "recommended_actions array<string>")
ALERT_FIELDS = ["src_ip", "hosts_targeted", "failed_logins", "successful_logins",
                "invalid_user_attempts", "max_auth_exceeded_events", "preauth_disconnects",
                "connection_probes_no_auth", "usernames_targeted", "success_after_failures",
                "first_seen", "last_seen", "log_source", "enrichment"]


def alert_json(alerts: DataFrame) -> F.Column:
    return F.to_json(F.struct(*[F.col(c) for c in ALERT_FIELDS if c in alerts.columns]))


def model_requests(alerts: DataFrame, model: str, system_prompt: str,
                   max_tokens: int = 1024,
                   user_prefix: str = "Assess this authentication alert (JSON):\n") -> DataFrame:
    """MOD1: ``custom_id, body`` where body is one JSON request per alert."""
    body = F.to_json(F.struct(
        F.lit(model).alias("model"), F.lit(max_tokens).alias("max_tokens"),
        F.lit(system_prompt).alias("system"),
        F.array(F.struct(F.lit("user").alias("role"),
                         F.concat(F.lit(user_prefix), alert_json(alerts)).alias("content")))
        .alias("messages")))
    return alerts.select(F.col("src_ip").alias("custom_id"), body.alias("body"))


def write_requests(requests: DataFrame, path: str, files: int) -> None:
    """MOD1 sink: ``files`` JSON-lines files (the scorer's parallelism)."""
    requests.repartition(files).write.mode("overwrite").json(path)


def validate_responses(responses: DataFrame, strict: bool = False) -> tuple[DataFrame, DataFrame]:
    """MOD2: ``custom_id, response`` (JSON text) -> (valid records, rejected rows).

    Valid: parses, all fields present, verdict and severity in their domains,
    confidence in 0..100.  ``strict`` raises when any row is rejected.
    """
    parsed = _checked(responses)
    valid = parsed.where("ok").select("r.*")
    rejected = parsed.where("not ok").select("custom_id", "response")
    if strict:
        bad = rejected.limit(1).collect()
        if bad:
            raise ValueError(f"model response failed validation: {bad[0]['custom_id']}")
    return valid, rejected


def _checked(responses: DataFrame) -> DataFrame:
    """``custom_id, response, r`` (the record) and ``ok``: whether it is a valid one."""
    parsed = responses.select("custom_id", "response",
                              F.from_json("response", RESULT_SCHEMA).alias("r"))
    r = F.col("r")
    ok = (r.isNotNull() & F.col("r.src_ip").isNotNull()
          & F.col("r.verdict").isin(*VERDICTS) & F.col("r.severity").isin(*SEVERITY_ORDER)
          & F.col("r.confidence").between(0, 100)
          & F.col("r.mitre_technique_id").isNotNull() & F.col("r.mitre_technique_name").isNotNull()
          & F.col("r.summary").isNotNull() & F.col("r.recommended_actions").isNotNull())
    return parsed.withColumn("ok", F.coalesce(ok, F.lit(False)))


class Responses(NamedTuple):
    """What :func:`write_validated` stored, and how much of it."""
    valid: DataFrame
    rejected: DataFrame
    counts: dict[str, int]


def write_validated(responses: DataFrame, path: str, strict: bool = False) -> Responses:
    """MOD2 as one job: every response is parsed once and written as ``valid=true`` (its record) or
    ``valid=false`` (its text) below ``path``; the counts are observed on the way.

    ``strict`` raises after the write, from the observed counts, so the rejected rows can
    be read.  A repeated run replaces the output.
    """
    spark = responses.sparkSession
    seen = Observation()
    fields = [c.split()[0] for c in RESULT_SCHEMA.split(", ")]
    rows = _checked(responses).observe(
        seen, F.count_if("ok").alias("valid"), F.count_if(~F.col("ok")).alias("rejected"),
        F.min(F.when(~F.col("ok"), F.coalesce("custom_id", F.lit("(no id)")))).alias("first_rejected"))
    (rows.select("custom_id", F.when(~F.col("ok"), F.col("response")).alias("response"),
                 *[F.when(F.col("ok"), F.col(f"r.{f}")).alias(f) for f in fields], F.col("ok").alias("valid"))
     .write.mode("overwrite").partitionBy("valid").parquet(path))
    counts = seen.get
    if strict and counts["rejected"]:
        raise ValueError(f"model responses failed validation: {counts['rejected']}, among them {counts['first_rejected']}")
    stored = spark.read.schema(f"custom_id string, response string, {RESULT_SCHEMA}, valid boolean").parquet(path)
    return Responses(stored.where("valid").select(*fields), stored.where("not valid").select("custom_id", "response"),
                     {k: counts[k] for k in ("valid", "rejected")})


Scorer = Callable[[pd.DataFrame], pd.DataFrame]


def score_with(enriched: DataFrame, scorer: Scorer, parallelism: int | None = None) -> DataFrame:
    """MOD3: a pluggable engine.  ``scorer`` maps a pandas batch of alerts (the
    ``ALERT_FIELDS`` columns) to verdict records (``RESULT_SCHEMA``).
    ``parallelism`` bounds concurrent scorer calls (rate limits)."""
    cols = [c for c in ALERT_FIELDS if c in enriched.columns]
    src = enriched.select(*cols)
    if parallelism:
        src = src.repartition(parallelism)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield scorer(b)
    return src.mapInPandas(run, RESULT_SCHEMA)


def incident_evidence(results: DataFrame, alerts: DataFrame | None,
                      evidence: DataFrame) -> DataFrame:
    """MOD4: per confirmed attack, the alert and verdict as JSON plus its ordered
    raw lines, one row per line (a source's lines are never gathered in one row).

    The evidence table is range-partitioned by (source, line), so a source that
    owns a third of all lines is already spread over many partitions.  The join to
    the per-attack header is left to Spark's size statistics (AQE splits a skewed
    side).  Pass the evidence of confirmed attacks only: numbers are per source, so
    they are the same, and nothing else is sorted."""
    keys = ["dataset", "src_ip"]
    att = results.where(F.col("verdict") == "true_positive")
    head = att.select(*keys, "severity", "mitre_technique_id",
                      F.to_json(F.struct(*[c for c in RESULT_SCHEMA_COLS
                                           if c in att.columns])).alias("triage_json"))
    if alerts is None:  # a wide table: verdicts and alert columns together
        header = att.select(*keys, "severity", "mitre_technique_id",
                            F.to_json(F.struct(*RESULT_SCHEMA_COLS)).alias("triage_json"),
                            alert_json(att).alias("alert_json"))
    else:
        ctx = alerts.select(*keys, alert_json(alerts).alias("alert_json"))
        header = head.join(ctx, keys)
    return evidence.join(header, keys)


RESULT_SCHEMA_COLS = [c.split()[0] for c in RESULT_SCHEMA.split(", ")]
