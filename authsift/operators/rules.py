"""TRI1-TRI10: rule-based triage of enriched alerts.

One ``rule_id`` CASE (first matching rule wins, TRI1-TRI7), then the fixed
rule table (6 rows, broadcast) supplies verdict, severity, technique and
actions (TRI9, TRI10); confidence (TRI5) and the summary text (TRI8) are
computed per row.
"""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import dims

RESULT_COLUMNS = ["src_ip", "verdict", "severity", "confidence", "mitre_technique_id",
                  "mitre_technique_name", "summary", "recommended_actions"]


def _q(text: str) -> str:
    return dims.sql_literal(text, "string")


# The rules as SQL expressions: parsed once on the JVM side per query (one
# round trip each) and evaluated inside whole-stage codegen.
RULE_ID_SQL = """CASE
  WHEN connection_probes_no_auth >= 2 AND failed_logins = 0 AND successful_logins = 0 THEN 1
  WHEN success_after_failures AND NOT internal_source THEN 2
  WHEN internal_source AND failed_logins >= 4 AND n_users >= 3 THEN 3
  WHEN (failed_logins >= 4 OR (failed_logins >= 2 AND n_users >= 3))
       AND NOT internal_source THEN 4
  WHEN internal_source AND failed_logins <= 2 AND successful_logins >= 1 THEN 5
  ELSE 6 END"""

CONFIDENCE_SQL = """CAST(CASE rule_id
  WHEN 1 THEN 75 WHEN 2 THEN 90 WHEN 3 THEN 75
  WHEN 4 THEN CASE WHEN max_auth_exceeded_events > 0
                   THEN least(95, CASE WHEN reputation = 'malicious' THEN 85 ELSE 70 END + 5)
                   ELSE CASE WHEN reputation = 'malicious' THEN 85 ELSE 70 END END
  WHEN 5 THEN 80 ELSE 50 END AS INT)"""

SUMMARY_SQL = f"""CASE rule_id
  WHEN 1 THEN format_string({_q(dims.SUMMARY_SCAN)}, src_ip, connection_probes_no_auth,
                            n_hosts)
  WHEN 2 THEN format_string({_q(dims.SUMMARY_COMPROMISE)}, src_ip, failed_logins)
  WHEN 3 THEN format_string({_q(dims.SUMMARY_SPRAY)}, src_ip, n_users)
  WHEN 4 THEN format_string({_q(dims.SUMMARY_BRUTE)}, src_ip, failed_logins,
                            n_users)
  WHEN 5 THEN CASE WHEN failed_logins > 0
                   THEN format_string({_q(dims.SUMMARY_TYPO)}, src_ip, failed_logins)
                   ELSE format_string({_q(dims.SUMMARY_NORMAL)}, src_ip, successful_logins) END
  ELSE format_string({_q(dims.SUMMARY_UNCLEAR)}, src_ip, failed_logins, successful_logins) END"""


def triage_rules(enriched: DataFrame, keep: tuple[str, ...] = ("dataset", "first_seq")) -> DataFrame:
    """Enriched alerts -> verdict records (``RESULT_COLUMNS``) plus ``rule_id``
    and the ``keep`` columns (dataset and first-seen key, used for ranking).

    The rules read the numbers of users and hosts; alerts from elsewhere that have
    only the lists get the numbers from these."""
    spark = enriched.sparkSession
    for number, values in (("n_users", "usernames_targeted"), ("n_hosts", "hosts_targeted")):
        if number not in enriched.columns:
            enriched = enriched.withColumn(number, F.size(values))
    scored = (enriched.withColumn("rule_id", F.expr(RULE_ID_SQL))
              .select(*keep, "src_ip", "rule_id", F.expr(CONFIDENCE_SQL).alias("confidence"),
                      F.expr(SUMMARY_SQL).alias("summary")))
    return (scored.join(F.broadcast(dims.rules(spark)), "rule_id")
            .select(*keep, *RESULT_COLUMNS, "rule_id"))
