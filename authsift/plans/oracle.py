"""DuckDB SQL oracle for the registered queries.

An independent SQL formulation over the driver's tables: the derived sshd log
(same rule as :mod:`authsift.sources.derived`), a parser written with
``regexp_matches``/``regexp_extract``, correlation by ``GROUP BY``, lookups,
rules as ``CASE``, ranks by ``row_number()``.  Arrays are compared as joined
text, ratios rounded to 6 places, counts cast to BIGINT.
"""
from __future__ import annotations

from ..operators import dims

# --- derived log, intel and labels --------------------------------------------------
_PROFILED = """
ev0 AS (
  SELECT event_id AS seq, ts, user_id AS u, event_type AS et,
         CAST(regexp_extract(props, '[0-9]+') AS BIGINT) AS k,
         CAST((day(ts) - 1) // 7 AS BIGINT) AS w
  FROM events
), prof AS (
  SELECT *, (u + w) % 10 AS p,
    CASE WHEN (u + w) % 10 IN (0, 1, 7) THEN '10' WHEN (u + w) % 10 IN (3, 5) THEN '185'
         WHEN (u + w) % 10 = 8 THEN '91' ELSE '203' END
      || '.' || w || '.' || (u // 250) || '.' || (u % 250 + 2) AS ip
  FROM ev0
)"""

_MESSAGES = """
msgs AS (
  SELECT *, CASE
    WHEN p = 0 AND et = 'error' AND k < 25 THEN 'Failed password for user' || u || ' from ' || ip || ' port 22 ssh2'
    WHEN p = 0 AND et IN ('click', 'view') AND k < 60 THEN 'Accepted password for user' || u || ' from ' || ip || ' port 22 ssh2'
    WHEN p = 1 AND et = 'error' THEN 'Failed password for svc-' || (u % 7) || ' from ' || ip || ' port 22 ssh2'
    WHEN p = 1 AND et = 'purchase' THEN CASE WHEN seq % 2 = 0
      THEN 'Invalid user svc-' || (u % 7) || ' from ' || ip || ' port 22'
      ELSE 'pam_unix(sshd:session): session opened for user svc-' || (u % 7) || ' by (uid=0)' END
    WHEN p = 2 AND et = 'error' AND k < 30 THEN 'Failed password for user' || u || ' from ' || ip || ' port 22 ssh2'
    WHEN p = 2 AND et = 'click' THEN 'Accepted password for user' || u || ' from ' || ip || ' port 22 ssh2'
    WHEN p = 3 AND et IN ('error', 'click', 'view') THEN 'Failed password for invalid user acct' || (k % 9) || ' from ' || ip || ' port 22 ssh2'
    WHEN p = 3 AND et = 'signup' THEN 'error: maximum authentication attempts exceeded for invalid user acct' || (k % 9) || ' from ' || ip || ' port 22 ssh2 [preauth]'
    WHEN p = 3 AND et = 'purchase' THEN
      CASE seq % 4 WHEN 0 THEN 'Disconnected from authenticating' WHEN 1 THEN 'Connection closed by authenticating'
                   WHEN 2 THEN 'Disconnected from invalid' ELSE 'Connection closed by invalid' END
      || ' user acct' || (k % 9) || ' ' || ip || ' port 22 [preauth]'
    WHEN p = 4 AND et = 'error' THEN 'Failed password for user' || u || ' from ' || ip || ' port 22 ssh2'
    WHEN p = 4 AND et = 'click' AND k >= 50 THEN 'Accepted password for user' || u || ' from ' || ip || ' port 22 ssh2'
    WHEN p = 5 AND et = 'error' AND k < 40 THEN 'Failed password for root from ' || ip || ' port 22 ssh2'
    WHEN p = 6 AND et = 'click' AND k < 40 THEN 'Accepted publickey for user' || u || ' from ' || ip || ' port 22 ssh2: RSA SHA256:' || substr(md5(CAST(seq AS VARCHAR)), 1, 10)
    WHEN p = 7 AND et IN ('error', 'click', 'view') THEN 'Failed password for user' || k || ' from ' || ip || ' port 22 ssh2'
    WHEN p = 8 AND k % 2 = 0 THEN 'Did not receive identification string from ' || ip || ' port 22'
    WHEN p = 8 THEN 'banner exchange: Connection from ' || ip || ' port 22: invalid format'
    WHEN p = 9 AND et IN ('error', 'view') THEN 'Failed publickey for git from ' || ip || ' port 22 ssh2'
    WHEN p = 9 AND et = 'purchase' THEN CASE WHEN seq % 2 = 0
      THEN 'Connection reset by ' || ip || ' port 22 [preauth]'
      ELSE 'Received disconnect from ' || ip || ' port 22:11: Bye Bye [preauth]' END
  END AS m
  FROM prof
), lines AS (
  SELECT seq, strftime(ts, '%b') || ' ' || lpad(CAST(day(ts) AS VARCHAR), 2, ' ') || ' '
              || strftime(ts, '%H:%M:%S') || ' host-' || (k % 5) || ' sshd[' || (seq % 9000 + 1000)
              || ']: ' || m AS raw
  FROM msgs WHERE m IS NOT NULL
)"""

_CITY_LIST = ", ".join("'" + c[0].replace("'", "''") + "'" for c in dims.CITY_COORDS)
_COUNTRY_LIST = ", ".join(f"'{c}'" for c in
                          ["RU", "RU", "CN", "CN", "NL", "BR", "VN", "IR", "IN", "KR",
                           "PL", "TR", "SE", "PA", "US", "US", "CA", "US", "US", "DE"])

_INTEL = f"""
intel AS (
  SELECT ip,
    CASE WHEN u % 4 = 0 THEN '' ELSE
      ([{_COUNTRY_LIST}])[u % 20 + 1] || ' — ' || ([{_CITY_LIST}])[u % 20 + 1]
      || ' (AS' || (u % 1000 + 64512) || ')' END AS geo,
    CASE WHEN p IN (3, 5, 9) AND u % 3 = 0 THEN 'malicious' ELSE 'suspicious' END AS reputation,
    CASE WHEN p IN (3, 5, 9) AND u % 3 = 0 THEN 'ssh-bruteforce' ELSE 'mass-scanner;recent-reports' END AS tags,
    CAST(CASE WHEN p IN (3, 5, 9) AND u % 3 = 0 THEN u % 1000 ELSE u % 100 END AS INTEGER) AS reports_90d
  FROM (SELECT DISTINCT ip, u, p FROM prof) d
  WHERE (p IN (3, 5, 9) AND u % 3 = 0) OR p = 8
)"""

_LABELS = """
labels_d AS (
  SELECT DISTINCT ip AS src_ip,
    CASE WHEN p >= 3 THEN 'true_positive' ELSE 'false_positive' END AS verdict,
    CASE WHEN p IN (1, 2, 5, 6) THEN 'HARD: ' ELSE '' END ||
      (['internal typos', 'internal stale job', 'employee at home', 'brute force', 'compromise',
        'slow and low', 'stolen credentials', 'internal spraying', 'scanner', 'key scanning'])[p + 1] AS notes
  FROM msgs WHERE m IS NOT NULL
)"""

# --- parser -----------------------------------------------------------------------------
_F = r"Failed (password|publickey) for (invalid user )?([^ ]+) from ([^ ]+) port ([0-9]+)"
_A = r"Accepted (password|publickey) for ([^ ]+) from ([^ ]+) port ([0-9]+)"
_M = r"maximum authentication attempts exceeded for (invalid user )?([^ ]+) from ([^ ]+)"
_C = r"(Connection closed by|Disconnected from) (authenticating|invalid) user ([^ ]+) ([^ ]+) port [0-9]+ \[preauth\]"
_P = r"(Received disconnect from|Connection reset by) ([^ ]+) port [0-9]+.*\[preauth\]"
_B1 = r"Did not receive identification string from ([^ ]+)"
_B2 = r"Connection from ([^ ]+) port [0-9]+: invalid format"
_ENV = r"^([A-Za-z]{3} +[0-9]+ [0-9:]{8}) +([^ ]+) +sshd\[[0-9]+\]: +(.*)$"

_PARSED = f"""
env AS (
  SELECT seq, raw, regexp_extract(raw, '{_ENV}', 1) AS ts_text,
         regexp_extract(raw, '{_ENV}', 2) AS host, regexp_extract(raw, '{_ENV}', 3) AS msg
  FROM lines
), kinds AS (
  SELECT *, CASE
      WHEN ts_text = '' THEN NULL
      WHEN regexp_matches(msg, '{_F}') THEN 'failed'
      WHEN regexp_matches(msg, '{_A}') THEN 'accepted'
      WHEN regexp_matches(msg, '{_M}') THEN 'max_auth'
      WHEN regexp_matches(msg, '{_C}') THEN 'closed_user'
      WHEN regexp_matches(msg, '{_P}') THEN 'preauth'
      WHEN regexp_matches(msg, '{_B1}') OR regexp_matches(msg, '{_B2}') THEN 'probe'
    END AS kind
  FROM env
), parsed AS (
  SELECT seq, raw, ts_text, host,
    CASE WHEN kind IN ('closed_user', 'preauth') THEN 'preauth_disconnect' ELSE kind END AS action,
    CASE kind WHEN 'failed' THEN regexp_extract(msg, '{_F}', 3)
              WHEN 'accepted' THEN regexp_extract(msg, '{_A}', 2)
              WHEN 'max_auth' THEN regexp_extract(msg, '{_M}', 2)
              WHEN 'closed_user' THEN regexp_extract(msg, '{_C}', 3) ELSE '' END AS "user",
    CASE kind WHEN 'failed' THEN regexp_extract(msg, '{_F}', 4)
              WHEN 'accepted' THEN regexp_extract(msg, '{_A}', 3)
              WHEN 'max_auth' THEN regexp_extract(msg, '{_M}', 3)
              WHEN 'closed_user' THEN regexp_extract(msg, '{_C}', 4)
              WHEN 'preauth' THEN regexp_extract(msg, '{_P}', 2)
              ELSE CASE WHEN regexp_matches(msg, '{_B1}') THEN regexp_extract(msg, '{_B1}', 1)
                        ELSE regexp_extract(msg, '{_B2}', 1) END END AS src_ip,
    CASE kind WHEN 'failed' THEN regexp_extract(msg, '{_F}', 2) <> ''
              WHEN 'max_auth' THEN regexp_extract(msg, '{_M}', 1) <> '' ELSE false END AS invalid_user,
    CASE kind WHEN 'failed' THEN regexp_extract(msg, '{_F}', 1)
              WHEN 'accepted' THEN regexp_extract(msg, '{_A}', 1) END AS method,
    strptime('2024 ' || regexp_replace(ts_text, ' +', ' ', 'g'), '%Y %b %d %H:%M:%S') AS event_time
  FROM kinds WHERE kind IS NOT NULL
)"""

# --- correlation, enrichment, rules, rank -----------------------------------------------------
_ALERTS = """
a0 AS (
  SELECT src_ip,
    CAST(count_if(action = 'failed') AS BIGINT) AS failed_logins,
    CAST(count_if(action = 'accepted') AS BIGINT) AS successful_logins,
    CAST(count_if(invalid_user) AS BIGINT) AS invalid_user_attempts,
    CAST(count_if(action = 'max_auth') AS BIGINT) AS max_auth_exceeded_events,
    CAST(count_if(action = 'preauth_disconnect') AS BIGINT) AS preauth_disconnects,
    CAST(count_if(action = 'probe') AS BIGINT) AS connection_probes_no_auth,
    coalesce(min(CASE WHEN action = 'failed' THEN seq END)
             < max(CASE WHEN action = 'accepted' THEN seq END), false) AS success_after_failures,
    arg_min(ts_text, seq) AS first_seen, arg_max(ts_text, seq) AS last_seen,
    min(seq) AS first_seq
  FROM parsed GROUP BY src_ip
), au AS (
  SELECT src_ip, string_agg("user", ',' ORDER BY f) AS usernames, count(*) AS n_users
  FROM (SELECT src_ip, "user", min(seq) AS f FROM parsed WHERE "user" <> '' GROUP BY 1, 2) x
  GROUP BY src_ip
), ah AS (
  SELECT src_ip, string_agg(host, ',' ORDER BY f) AS hosts, count(*) AS n_hosts
  FROM (SELECT src_ip, host, min(seq) AS f FROM parsed GROUP BY 1, 2) x GROUP BY src_ip
), alerts AS (
  SELECT a0.*, coalesce(au.usernames, '') AS usernames, coalesce(au.n_users, 0) AS n_users,
         ah.hosts, ah.n_hosts
  FROM a0 LEFT JOIN au USING (src_ip) LEFT JOIN ah USING (src_ip)
)"""

_OCT = r"(25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
_IPV4 = rf"^{_OCT}\.{_OCT}\.{_OCT}\.{_OCT}$"
_STATIC = ", ".join(f"('{ip}', '{rep}', '{';'.join(tags)}', {n})"
                    for ip, rep, tags, n in dims.STATIC_INTEL)
_PREFIXES = ", ".join(f"({i}, '{p}', '{g}')" for i, (p, g) in enumerate(dims.GEO_PREFIXES))

_ENRICHED = f"""
static_intel(ip, reputation, tags, reports_90d) AS (VALUES {_STATIC}),
prefixes(ord, prefix, geo) AS (VALUES {_PREFIXES}),
pgeo AS (
  SELECT a.src_ip, arg_min(p.geo, p.ord) AS prefix_geo
  FROM alerts a JOIN prefixes p ON starts_with(a.src_ip, p.prefix) GROUP BY a.src_ip
), enriched AS (
  SELECT a.*,
    coalesce(regexp_matches(a.src_ip, '{_IPV4}') AND (
      CAST(split_part(a.src_ip, '.', 1) AS INTEGER) = 10
      OR (CAST(split_part(a.src_ip, '.', 1) AS INTEGER) = 172
          AND CAST(split_part(a.src_ip, '.', 2) AS INTEGER) BETWEEN 16 AND 31)
      OR (CAST(split_part(a.src_ip, '.', 1) AS INTEGER) = 192
          AND CAST(split_part(a.src_ip, '.', 2) AS INTEGER) = 168)), false) AS internal_source,
    d.ip IS NOT NULL AS has_dyn, d.geo AS dyn_geo, pg.prefix_geo,
    CASE WHEN d.ip IS NOT NULL THEN d.reputation WHEN s.ip IS NOT NULL THEN s.reputation
         ELSE 'no records' END AS reputation,
    CASE WHEN d.ip IS NOT NULL THEN d.tags WHEN s.ip IS NOT NULL THEN s.tags ELSE '' END AS tags,
    CASE WHEN d.ip IS NOT NULL THEN d.reports_90d WHEN s.ip IS NOT NULL THEN s.reports_90d END
      AS reports_90d
  FROM alerts a LEFT JOIN intel d ON d.ip = a.src_ip LEFT JOIN static_intel s ON s.ip = a.src_ip
    LEFT JOIN pgeo pg ON pg.src_ip = a.src_ip
), enr AS (
  SELECT *, CASE WHEN internal_source THEN '{dims.INTERNAL_GEO}'
                 WHEN coalesce(dyn_geo, '') <> '' THEN dyn_geo
                 ELSE coalesce(prefix_geo, '{dims.UNKNOWN_GEO}') END AS geolocation
  FROM enriched
)"""


def _summary_sql() -> str:
    def fmt(t: str) -> str:
        return t.replace("'", "''")
    return f"""CASE rule_id
      WHEN 1 THEN printf('{fmt(dims.SUMMARY_SCAN)}', src_ip, connection_probes_no_auth, n_hosts)
      WHEN 2 THEN printf('{fmt(dims.SUMMARY_COMPROMISE)}', src_ip, failed_logins)
      WHEN 3 THEN printf('{fmt(dims.SUMMARY_SPRAY)}', src_ip, n_users)
      WHEN 4 THEN printf('{fmt(dims.SUMMARY_BRUTE)}', src_ip, failed_logins, n_users)
      WHEN 5 THEN CASE WHEN failed_logins > 0
                  THEN printf('{fmt(dims.SUMMARY_TYPO)}', src_ip, failed_logins)
                  ELSE printf('{fmt(dims.SUMMARY_NORMAL)}', src_ip, successful_logins) END
      ELSE printf('{fmt(dims.SUMMARY_UNCLEAR)}', src_ip, failed_logins, successful_logins) END"""


def _rules_values() -> str:
    rows = []
    for rid, verdict, sev, tid, name, actions in dims.RULES:
        acts = "|".join(actions).replace("'", "''")
        rows.append(f"({rid}, '{verdict}', '{sev}', '{tid}', '{name}', '{acts}')")
    return ", ".join(rows)


_SEV_RANK = "CASE severity " + " ".join(
    f"WHEN '{s}' THEN {i}" for i, s in enumerate(dims.SEVERITY_ORDER)) + " END"

_TRIAGE = f"""
rules_t(rule_id, verdict, severity, mitre_technique_id, mitre_technique_name, actions) AS (
  VALUES {_rules_values()}
), scored AS (
  SELECT *, CASE
      WHEN connection_probes_no_auth >= 2 AND failed_logins = 0 AND successful_logins = 0 THEN 1
      WHEN success_after_failures AND NOT internal_source THEN 2
      WHEN internal_source AND failed_logins >= 4 AND n_users >= 3 THEN 3
      WHEN (failed_logins >= 4 OR (failed_logins >= 2 AND n_users >= 3)) AND NOT internal_source THEN 4
      WHEN internal_source AND failed_logins <= 2 AND successful_logins >= 1 THEN 5
      ELSE 6 END AS rule_id
  FROM enr
), triage AS (
  SELECT s.*, r.verdict, r.severity, r.mitre_technique_id, r.mitre_technique_name, r.actions,
    CAST(CASE s.rule_id WHEN 1 THEN 75 WHEN 2 THEN 90 WHEN 3 THEN 75
      WHEN 4 THEN CASE WHEN max_auth_exceeded_events > 0
                       THEN least(95, CASE WHEN reputation = 'malicious' THEN 85 ELSE 70 END + 5)
                       ELSE CASE WHEN reputation = 'malicious' THEN 85 ELSE 70 END END
      WHEN 5 THEN 80 ELSE 50 END AS INTEGER) AS confidence
  FROM scored s JOIN rules_t r USING (rule_id)
), ranked AS (
  SELECT *, {_SEV_RANK} AS sev_rank,
    row_number() OVER (ORDER BY {_SEV_RANK}, confidence DESC, first_seq) AS rank
  FROM triage
)"""


def with_ctes(*blocks: str) -> str:
    return "WITH " + ",".join(blocks)


BASE = (_PROFILED, _MESSAGES)
PIPE = (_PROFILED, _MESSAGES, _PARSED)
ALERTS = PIPE + (_ALERTS,)
ENRICHED = ALERTS + (_INTEL, _ENRICHED)
TRIAGE = ENRICHED + (_TRIAGE,)
SUMMARY_SQL = _summary_sql()
LABELS = _LABELS
INTEL = _INTEL
PROFILED = _PROFILED


def q(blocks: tuple[str, ...], select: str) -> str:
    return with_ctes(*blocks) + "\n" + select


def _list(values) -> str:
    return "[" + ", ".join("'" + v.replace("'", "''") + "'" for v in values) + "]"


# --- Windows logon events (derived raw security table -> selection -> events) -------------
_SECURITY = """
sec AS (
  SELECT seq, CAST(ts AS TIMESTAMP) AS event_time,
    CASE WHEN k % 7 = 0 THEN 'WinEventLog:System' ELSE 'WinEventLog:Security' END AS source,
    'DC0' || (k % 3) AS host,
    CASE WHEN et = 'error' THEN '4625' ELSE '4624' END AS EventCode,
    CASE WHEN k % 2 = 1 THEN ip END AS src_ip_f,
    CASE WHEN k % 11 = 0 THEN '-' ELSE ip END AS sna,
    CASE WHEN k % 5 <> 0 THEN 'user' || u END AS user_f,
    CASE WHEN k % 10 = 0 THEN 'WS' || (u % 50) || '$' ELSE 'user' || u END AS last_account,
    (['3', '10', '2'])[k % 3 + 1] AS Logon_Type,
    CASE WHEN et <> 'error' THEN NULL WHEN k % 8 = 0 THEN '0xc0000064'
         WHEN k % 4 = 0 THEN '0xC0000064' ELSE '0xC000006A' END AS Sub_Status
  FROM prof WHERE et IN ('error', 'click', 'view')
), sel AS (
  SELECT * FROM (
    SELECT strftime(event_time, '%Y-%m-%dT%H:%M:%S.%g+00:00') AS _time, host, EventCode,
      coalesce(user_f, last_account) AS account, coalesce(src_ip_f, sna) AS src, Logon_Type,
      Sub_Status
    FROM sec
    WHERE event_time >= TIMESTAMP '2024-01-01 00:00:00' AND event_time < TIMESTAMP '2024-02-01 00:00:00'
      AND contains(source, 'Security')
      AND (EventCode = '4625' OR (EventCode = '4624' AND Logon_Type IN ('3', '10')))) x
  WHERE src IS NOT NULL AND src <> '-' AND NOT coalesce(ends_with(account, '$'), false)
), win AS (
  SELECT _time AS ts_text, host, CASE WHEN EventCode = '4624' THEN 'accepted' ELSE 'failed' END AS action,
    account AS "user", src AS src_ip,
    coalesce(Sub_Status IN ('0xc0000064', '0xC0000064'), false) AS invalid_user,
    'windows_logon_type_' || coalesce(Logon_Type, '?') AS method,
    _time || ' ' || host || ' EventCode=' || EventCode || ' account=' || account || ' src=' || src
      || ' logon_type=' || coalesce(Logon_Type, '?') AS raw
  FROM sel WHERE coalesce(src, '') <> '' AND coalesce(account, '') <> ''
    AND EventCode IN ('4624', '4625')
)"""

# --- case updates and state ------------------------------------------------------------------
_CASES = f"""
upd AS (
  SELECT 'derived' AS dataset, ip AS src_ip,
    ({_list(dims.CASE_FIELDS)})[k % 4 + 1] AS field,
    CASE WHEN seq % 11 = 0 THEN NULL
         WHEN k % 4 = 0 THEN ({_list(dims.CASE_STATUSES)})[seq % 4 + 1]
         WHEN k % 4 = 1 THEN 'analyst' || (u % 5)
         WHEN k % 4 = 2 THEN 'checked ' || seq
         WHEN seq % 3 = 1 THEN '👎 disagree' ELSE '👍 agree' END AS value,
    CAST(ts AS TIMESTAMP) AS updated_at, seq AS update_id
  FROM prof WHERE et = 'signup'
), cases AS (
  SELECT dataset, src_ip,
    {", ".join(f"first(value ORDER BY updated_at DESC, update_id DESC) FILTER (WHERE field = '{f}') AS {f}" for f in dims.CASE_FIELDS)},
    max(updated_at) AS updated_at
  FROM upd GROUP BY dataset, src_ip
)"""

# --- stream semantics: order by (event time, raw line) ------------------------------------
_STREAM_ALERTS = _ALERTS.replace("FROM parsed", "FROM sk").replace("seq", "okey").replace("first_okey", "first_seq")
_STREAM_KEY = """
sk AS (SELECT *, strftime(event_time, '%Y-%m-%d %H:%M:%S') || raw AS okey FROM parsed)"""

SECURITY = BASE[:1] + (_SECURITY,)
CASE_BLOCK = _CASES
CASES = (_PROFILED, _CASES)
STREAM_ALERTS = PIPE + (_STREAM_KEY, _STREAM_ALERTS)
STREAM_TRIAGE = STREAM_ALERTS + (_INTEL, _ENRICHED, _TRIAGE)
