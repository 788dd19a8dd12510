"""CASE1-CASE5, ANA14, ANA15: analyst case state as a query over an
append-only table of field updates.

An update sets only the fields it names; per (dataset, src_ip, field) the last
write wins (by ``updated_at``, then ``update_id``) and an explicit NULL clears
the field.  State is a pivot with the fixed field list, so it is one
aggregate with no extra job to discover the columns.  Re-running the merge
on its own output changes nothing.
"""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .dims import CASE_FIELDS

UPDATE_SCHEMA = ("dataset string, src_ip string, field string, value string, "
                 "updated_at timestamp, update_id bigint")
KEYS = ["dataset", "src_ip"]
AGREE, DISAGREE = "👍 agree", "👎 disagree"  # fixed values: feedback choices


def case_state(updates: DataFrame) -> DataFrame:
    """CASE1: latest value per field -> ``dataset, src_ip, status, assignee,
    notes, feedback, updated_at``."""
    ord_ = F.struct("updated_at", "update_id")
    fields = [F.max_by("value", F.when(F.col("field") == f, ord_)).alias(f) for f in CASE_FIELDS]
    return updates.groupBy(*KEYS).agg(*fields, F.max("updated_at").alias("updated_at"))


def cases_of(state: DataFrame, dataset: str) -> DataFrame:
    """CASE2: all cases of one dataset (a partition filter on a partitioned table)."""
    return state.where(F.col("dataset") == dataset)


def with_case_defaults(alerts: DataFrame, state: DataFrame) -> DataFrame:
    """CASE3: alerts left-joined to their case: New / '' / '' when there is none."""
    s = state.select(*KEYS, *CASE_FIELDS, F.col("updated_at").alias("case_updated_at"))
    j = alerts.join(s, KEYS, "left")
    return j.withColumn("status", F.coalesce("status", F.lit("New"))) \
        .withColumn("assignee", F.coalesce("assignee", F.lit(""))) \
        .withColumn("notes", F.coalesce("notes", F.lit("")))


def dataset_fingerprint(log_text: DataFrame) -> DataFrame:
    """CASE4: first 12 hex digits of SHA-1 of a whole log file (``path, text``)."""
    return log_text.select("path", F.substring(F.sha1(F.encode("text", "UTF-8")), 1, 12)
                           .alias("dataset_key"))


def order_free_fingerprint(lines: DataFrame) -> DataFrame:
    """CASE4 at scale: a fingerprint of the multiset of lines, 32 hex digits.

    The two 64-bit halves of each line's MD5 are summed modulo 2^64: repeats count,
    order and the split into files do not.  One partial aggregate; the sums are exact up
    to 5e18 lines.  No lines: zeros.
    """
    md5 = F.md5(F.col("raw").cast("binary"))
    halves = [F.conv(F.substring(md5, at, 16), 16, 10).cast("decimal(20,0)") for at in (1, 17)]
    total = lines.agg(*[F.coalesce(F.sum(h.cast("decimal(38,0)")), F.lit(0).cast("decimal(38,0)")).alias(f"h{k}")
                        for k, h in enumerate(halves)])
    wrapped = [F.lpad(F.lower(F.conv((F.col(f"h{k}") % F.lit(str(1 << 64)).cast("decimal(20,0)")).cast("decimal(20,0)")
                                     .cast("string"), 10, 16)), 16, "0") for k in (0, 1)]
    return total.select(F.concat(*wrapped).alias("dataset_key"))


def feedback_table(state: DataFrame, results: DataFrame) -> DataFrame:
    """ANA14: sources with feedback, their verdict ('' if none) and notes."""
    fb = state.where(F.coalesce(F.col("feedback"), F.lit("")) != "")
    r = results.select(*KEYS, F.col("verdict").alias("ai_verdict"))
    return (fb.join(r, KEYS, "left")
            .select(*KEYS, F.coalesce("ai_verdict", F.lit("")).alias("ai_verdict"),
                    F.col("feedback").alias("analyst_feedback"),
                    F.coalesce("notes", F.lit("")).alias("notes")))


def feedback_counts(state: DataFrame) -> DataFrame:
    """ANA15: agree / disagree counts among cases with feedback."""
    fb = F.col("feedback")
    agree = fb.contains("agree") & ~fb.contains("dis")
    return (state.where(F.coalesce(fb, F.lit("")) != "")
            .groupBy("dataset").agg(F.count_if(agree).alias("agree"),
                                     F.count_if(~agree).alias("disagree")))
