"""Dimension tables: static intel, geo prefixes, cities, tactics, severities, rules.

All of these are small, fixed-size tables (their size does not grow with the
data), so joins against them are broadcast joins by construction.
"""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# --- fixed values: static threat intel (ip, reputation, tags, reports_90d) ---
STATIC_INTEL = [
    ("185.220.101.7", "malicious", ["tor-exit-node", "ssh-bruteforce"], 412),
    ("91.240.118.172", "malicious", ["mass-scanner", "ssh-bruteforce"], 1280),
    ("203.0.113.45", "suspicious", ["recent-bruteforce-reports"], 37),
]

# --- fixed values: geo prefixes, first match wins (prefix, location) ---------
GEO_PREFIXES = [
    ("203.0.113.", "RU — Moscow (AS-DOC-NET)"),
    ("198.51.100.", "CN — Shenzhen (CN-TELECOM)"),
    ("185.220.101.", "DE — Frankfurt (Tor exit range)"),
    ("91.240.118.", "RU — St. Petersburg (bulletproof hosting)"),
]
INTERNAL_GEO = "internal network (RFC1918)"
UNKNOWN_GEO = "unknown"

# --- fixed values: city coordinates (city, lat, lon) --------------------------
CITY_COORDS = [
    ("Moscow", 55.76, 37.62), ("St. Petersburg", 59.93, 30.36),
    ("Hangzhou", 30.27, 120.16), ("Shenzhen", 22.54, 114.06),
    ("Amsterdam", 52.37, 4.90), ("São Paulo", -23.55, -46.63),
    ("Hanoi", 21.03, 105.85), ("Tehran", 35.69, 51.39),
    ("Mumbai", 19.08, 72.88), ("Seoul", 37.57, 126.98),
    ("Warsaw", 52.23, 21.01), ("Istanbul", 41.01, 28.98),
    ("Stockholm", 59.33, 18.07), ("Panama City", 8.98, -79.52),
    ("Chicago", 41.88, -87.63), ("Dallas", 32.78, -96.80),
    ("Toronto", 43.65, -79.38), ("Iowa", 41.88, -93.10),
    ("Ashburn", 39.04, -77.49), ("Frankfurt", 50.11, 8.68),
]

# --- fixed values: technique -> tactic, and tactic display order --------------
TACTIC_MAP = [
    ("T1595", "Reconnaissance"),
    ("T1078", "Initial Access"),
    ("T1110", "Credential Access"),
    ("T1021", "Lateral Movement"),
    ("T1046", "Discovery"),
]
TACTIC_ORDER = ["Reconnaissance", "Initial Access", "Credential Access",
                "Discovery", "Lateral Movement", "Other"]

# --- fixed values: severity order, verdicts, case statuses ---------------------
SEVERITY_ORDER = ["critical", "high", "medium", "low", "informational"]
VERDICTS = ["true_positive", "false_positive", "needs_investigation"]
CASE_STATUSES = ["New", "Investigating", "Contained", "Closed"]
CASE_FIELDS = ["status", "assignee", "notes", "feedback"]

# --- fixed values: triage rules ----------------------------------------------
# rule_id, verdict, severity, technique id, technique name, recommended actions
RULES = [
    (1, "true_positive", "low", "T1595", "Active Scanning",
     ["No containment needed; confirm perimeter exposure is intended",
      "Add the IP to scanner watchlists",
      "Verify SSH is not exposed wider than necessary"]),
    (2, "true_positive", "critical", "T1110.001", "Brute Force: Password Guessing",
     ["Disable the affected account", "Isolate the host",
      "Block the source IP", "Review session activity after login"]),
    (3, "true_positive", "high", "T1110.003", "Brute Force: Password Spraying",
     ["Identify the user/process on the source host",
      "Check the source host for signs of compromise",
      "Review which accounts were targeted for privilege level"]),
    (4, "true_positive", "high", "T1110", "Brute Force",
     ["Block the source IP at the firewall",
      "Confirm no successful logins from this IP elsewhere",
      "Verify password auth is disabled where possible"]),
    (5, "false_positive", "informational", "N/A", "N/A",
     ["No action required"]),
    (6, "needs_investigation", "medium", "N/A", "N/A",
     ["Review full session history for this IP",
      "Check if the account owner recognizes the activity"]),
]
# summary templates per rule (format_string, %1$s = ip; see rules.py for args)
SUMMARY_SCAN = ("%s made %d connection probes (no banner / no auth attempt) against "
                "%d host(s) — scanner reconnaissance, no login attempted.")
SUMMARY_COMPROMISE = ("External IP %s failed %d logins and then successfully "
                      "authenticated — likely account compromise.")
SUMMARY_SPRAY = ("Internal host %s failed logins against %d different accounts — "
                 "possible lateral movement or internal password spraying.")
SUMMARY_BRUTE = ("External IP %s made %d failed logins across %d usernames with no "
                 "success — brute-force attempt, currently blocked.")
SUMMARY_TYPO = ("Internal user on %s mistyped a password %d time(s) before logging "
                "in — routine behavior.")
SUMMARY_NORMAL = ("Internal source %s logged in normally (%d successful login(s), "
                  "no failures).")
SUMMARY_UNCLEAR = ("Activity from %s (%d failed / %d successful logins) does not match "
                   "a clear pattern.")
# ------------------------------------------------------------------------------


def sql_literal(v, t: str) -> str:
    """A SQL literal of type ``t`` for a Python value (strings quoted, lists as arrays)."""
    if v is None:
        return f"CAST(NULL AS {t})"
    if isinstance(v, list):
        inner = t[t.index("<") + 1:t.rindex(">")]
        return f"CAST(array({', '.join(sql_literal(x, inner) for x in v)}) AS {t})"
    if isinstance(v, str):
        return "'" + v.replace("\\", "\\\\").replace("'", "\\'") + "'"
    return f"CAST({v!r} AS {t})"


_TABLES: dict[tuple[str, str], DataFrame] = {}


def literal_table(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    """A small fixed table as one SQL ``VALUES`` relation (JVM-side, no Python
    RDD, one round trip); cached per session."""
    key = (spark.sparkContext.applicationId, repr((rows, schema)))
    if key in _TABLES:
        return _TABLES[key]
    fields = [f.strip().split(" ", 1) for f in _split_schema(schema)]
    names = ", ".join(n for n, _ in fields)
    if rows:
        values = ", ".join("(" + ", ".join(sql_literal(v, t) for v, (_, t) in zip(r, fields)) + ")"
                           for r in rows)
        df = spark.sql(f"SELECT * FROM VALUES {values} AS t({names})")
    else:
        df = spark.sql("SELECT " + ", ".join(f"CAST(NULL AS {t}) AS {n}" for n, t in fields)
                       + " WHERE false")
    _TABLES[key] = df
    return df


def _split_schema(schema: str) -> list[str]:
    """Split 'a int, b array<string>, ...' at top-level commas."""
    out, depth, cur = [], 0, ""
    for ch in schema:
        depth += ch == "<"
        depth -= ch == ">"
        if ch == "," and depth == 0:
            out.append(cur)
            cur = ""
        else:
            cur += ch
    return out + [cur]


def static_intel(spark: SparkSession) -> DataFrame:
    return literal_table(spark, STATIC_INTEL,
                         "ip string, reputation string, tags array<string>, reports_90d int")


def geo_prefixes(spark: SparkSession) -> DataFrame:
    rows = [(i, p, g) for i, (p, g) in enumerate(GEO_PREFIXES)]
    return literal_table(spark, rows, "ord int, prefix string, geo string")


def cities(spark: SparkSession) -> DataFrame:
    return literal_table(spark, CITY_COORDS, "city string, lat double, lon double")


def tactics(spark: SparkSession) -> DataFrame:
    order = {t: i for i, t in enumerate(TACTIC_ORDER)}
    rows = [(tid, tac, order[tac]) for tid, tac in TACTIC_MAP]
    return literal_table(spark, rows, "technique_id string, tactic string, tactic_ord int")


def rules(spark: SparkSession) -> DataFrame:
    return literal_table(
        spark, RULES, "rule_id int, verdict string, severity string, mitre_technique_id string, "
                      "mitre_technique_name string, recommended_actions array<string>")


def severity_rank(col) -> F.Column:
    """Severity -> 0..4 as an inline CASE (no join needed for five values)."""
    expr = F.lit(None).cast("int")
    for i, s in reversed(list(enumerate(SEVERITY_ORDER))):
        expr = F.when(col == s, F.lit(i)).otherwise(expr)
    return expr
