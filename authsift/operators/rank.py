"""TRI11, TRI12, FLT1: ranked queue, display rows, queue filter."""
from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.ordering import number_rows
from .dims import SEVERITY_ORDER, VERDICTS, severity_rank


def rank_results(results: DataFrame, by_dataset: bool = True) -> DataFrame:
    """TRI11: severity order, then confidence descending, then first-seen order.

    ``results`` needs ``severity, confidence, first_seq`` (and ``dataset``).
    Adds ``rank`` (1-based, dense, per dataset) without a one-task window.
    """
    ordered = results.withColumn("sev_rank", severity_rank(F.col("severity")))
    return number_rows(ordered, [F.col("sev_rank"), F.col("confidence").desc(),
                                 F.col("first_seq")],
                       ["dataset"] if by_dataset else [], "rank").drop("sev_rank")


def verdict_label(verdict: F.Column) -> F.Column:
    return F.regexp_replace(verdict, "_", " ")


def queue_rows(ranked: DataFrame) -> DataFrame:
    """TRI12: the analyst queue line per alert."""
    name, tid = F.col("mitre_technique_name"), F.col("mitre_technique_id")
    attack = (F.when(~name.isin("N/A", ""), F.format_string("%s (%s)", name, tid))
              .when(F.col("verdict") == "false_positive", F.lit("benign activity"))
              .otherwise(F.lit("unclear pattern")))
    return ranked.select(
        "rank", "src_ip",
        F.upper("severity").alias("severity"),
        verdict_label(F.col("verdict")).alias("verdict"),
        F.concat(F.col("confidence").cast("string"), F.lit("%")).alias("confidence"),
        tid.alias("technique"),
        attack.alias("attack"))


def filter_queue(results: DataFrame, severities: Iterable[str] = (),
                 verdicts: Iterable[str] = (), ip_query: str = "") -> DataFrame:
    """FLT1: severity in set AND verdict label in set AND ip contains text.
    An empty set (or empty text) means no filter on that dimension."""
    sev = list(severities) or SEVERITY_ORDER
    ver = list(verdicts) or [v.replace("_", " ") for v in VERDICTS]
    cond = F.col("severity").isin(sev) & verdict_label(F.col("verdict")).isin(ver)
    if ip_query:
        cond = cond & F.col("src_ip").contains(ip_query)
    return results.where(cond)


def filter_counts(results: DataFrame, severities: Iterable[str] = (),
                  verdicts: Iterable[str] = (), ip_query: str = "") -> DataFrame:
    """FLT1: matched and total alert counts for a queue filter (one aggregate)."""
    sev = list(severities) or SEVERITY_ORDER
    ver = list(verdicts) or [v.replace("_", " ") for v in VERDICTS]
    cond = F.col("severity").isin(sev) & verdict_label(F.col("verdict")).isin(ver)
    if ip_query:
        cond = cond & F.col("src_ip").contains(ip_query)
    return results.agg(F.count_if(cond).alias("matched"), F.count(F.lit(1)).alias("total"))
