"""PARSE1-PARSE10: raw sshd lines -> typed auth events.

The envelope is one anchored pattern; the message is dispatched to the first
matching pattern in priority order (failed, accepted, max_auth, closed-user,
pre-auth, probe).  Unmatched lines are dropped.

Cost per line, the hot path at scale:

1. one combined pattern (envelope + any message pattern) keeps event lines;
   this filter reads only ``raw``, so it sits directly on the scan, and there
   is no filter on a computed column that Catalyst could push down (and so
   duplicate) through the projections;
2. for kept lines one ``regexp_replace`` of the whole line with the priority
   alternation (:func:`patterns.dispatch_line`) writes every capture group,
   newline-separated, and ``split`` turns that into an array: envelope,
   action and fields come from a single regex run.  A text line never
   contains a newline, so the separator cannot collide with captured text;
   groups that did not take part expand to empty strings.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import patterns as P
from ..functions.text import syslog_time

ACTIONS = ["failed", "accepted", "max_auth", "preauth_disconnect", "probe"]

_DISPATCH, _START = P.dispatch_line()
_N_GROUPS = P.group_count(_DISPATCH)
_TEMPLATE = "\n".join(f"${i}" for i in range(1, _N_GROUPS + 1))
_KEEP = P.java(P.any_event_line())


def _parts(raw: Column) -> Column:
    """All capture groups of the dispatch pattern as an array (1-based)."""
    return F.split(F.regexp_replace(raw, P.java(_DISPATCH), _TEMPLATE), "\n")


def _g(parts: Column, kind: str, i: int) -> Column:
    """Group ``i`` (1-based) of ``kind``'s own pattern."""
    return F.element_at(parts, _START[kind] + i - 1)


def _kind(parts: Column) -> Column:
    """PARSE8: the first pattern that matched (its whole-match group is non-empty)."""
    expr = F.lit(None).cast("string")
    for kind, _ in reversed(P.MESSAGE_KINDS):
        expr = F.when(F.element_at(parts, _START[kind] - 1) != "", F.lit(kind)).otherwise(expr)
    return expr


def _by_kind(kind: Column, values: dict[str, Column], default: Column) -> Column:
    expr = default
    for code, value in reversed(list(values.items())):
        expr = F.when(kind == code, value).otherwise(expr)
    return expr


def _action(kind: Column) -> Column:
    return _by_kind(kind, {"closed_user": F.lit("preauth_disconnect"),
                           "preauth": F.lit("preauth_disconnect")}, kind)


def keep_events(lines: DataFrame) -> DataFrame:
    """PARSE1 + PARSE8 drop: sshd lines whose message matches a known pattern."""
    return lines.where(F.col("raw").rlike(_KEEP))


def parse_events(lines: DataFrame, year: int = 2026,
                 log_source: str = "sshd_file") -> DataFrame:
    """Raw lines (``dataset, seq, raw``) -> ``auth_events``.

    Output: dataset, seq, event_time, ts_text, host, action, user ('' when
    none), src_ip, invalid_user, method (NULL when none), raw, log_source.
    ``year`` fills in the year syslog leaves out.
    """
    parts = keep_events(lines).withColumn("_p", _parts(F.col("raw")))
    p = F.col("_p")
    staged = parts.withColumn("_kind", _kind(p)).withColumn("ts_text", F.element_at(p, 1))
    kind = F.col("_kind")
    user = _by_kind(kind, {                                       # PARSE2-PARSE5
        "failed": _g(p, "failed", 3),
        "accepted": _g(p, "accepted", 2),
        "max_auth": _g(p, "max_auth", 2),
        "closed_user": _g(p, "closed_user", 1),
    }, F.lit(""))
    ip = _by_kind(kind, {                                          # PARSE2-PARSE7
        "failed": _g(p, "failed", 4),
        "accepted": _g(p, "accepted", 3),
        "max_auth": _g(p, "max_auth", 3),
        "closed_user": _g(p, "closed_user", 2),
        "preauth": _g(p, "preauth", 1),
        "probe": F.coalesce(F.nullif(_g(p, "probe", 1), F.lit("")), _g(p, "probe", 2)),
    }, F.lit(None).cast("string"))
    invalid = _by_kind(kind, {                                     # PARSE2, PARSE4
        "failed": _g(p, "failed", 2) != "",
        "max_auth": _g(p, "max_auth", 1) != "",
    }, F.lit(False))
    method = _by_kind(kind, {                                      # PARSE2, PARSE3
        "failed": _g(p, "failed", 1),
        "accepted": _g(p, "accepted", 1),
    }, F.lit(None).cast("string"))
    return staged.select(
        "dataset", "seq",
        syslog_time(F.col("ts_text"), year).alias("event_time"),  # PARSE9
        "ts_text",
        F.element_at(p, 2).alias("host"),
        _action(kind).alias("action"),
        user.alias("user"),
        ip.alias("src_ip"),
        invalid.alias("invalid_user"),
        method.alias("method"),
        "raw",
        F.lit(log_source).alias("log_source"),
    )


def parse_audit(lines: DataFrame) -> DataFrame:
    """PARSE10: per-action line counts, ``dropped`` for unmatched lines and
    ``total`` for all lines in (one pass, ``rollup`` adds the total)."""
    # the dispatch array gets its own projection: inside the CASE conditions
    # below it would be re-evaluated per branch (no common-subexpression
    # elimination beyond a CASE's first condition)
    staged = lines.select(F.when(F.col("raw").rlike(_KEEP), _parts(F.col("raw"))).alias("_p"))
    kind = F.when(F.col("_p").isNotNull(), _kind(F.col("_p")))
    action = F.coalesce(_action(kind), F.lit("dropped"))
    counted = (staged.select(action.alias("action")).rollup("action")
               .agg(F.count(F.lit(1)).alias("lines")))
    return counted.select(F.coalesce("action", F.lit("total")).alias("action"), "lines")
