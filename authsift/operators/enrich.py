"""ENR1-ENR7: internal-source test, geolocation and reputation lookups.

Lookups are DataFrame parameters (any table or feed can be passed, ENR7):

* ``intel``: dynamic feed ``ip, geo, reputation, tags, reports_90d``; when a
  row exists for an ip it wins *entirely* over the static table, even where
  its fields are NULL.
* ``prefixes``: ``ord, prefix, geo``, first (lowest ``ord``) match wins.  The
  prefix match is an equi-join: each ip is expanded to its prefixes of every
  length present in the table (a handful), joined on equality, then reduced
  with ``min_by(geo, ord)``, so both sides may be large.  Without a table the
  fixed prefix list of :mod:`dims` is applied as a CASE expression.

The static tables are fixed-size and broadcast; a dynamic feed is left to
the planner and AQE, since its size is the caller's.
"""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.ipv4 import is_internal
from . import dims

INTEL_SCHEMA = "ip string, geo string, reputation string, tags array<string>, reports_90d int"


def empty_intel(spark) -> DataFrame:
    return dims.literal_table(spark, [], INTEL_SCHEMA)


def prefix_case(ip: F.Column, prefixes: list[tuple[str, str]]) -> F.Column:
    """ENR3 for a short fixed list: first matching prefix as one CASE (no join)."""
    expr = F.lit(None).cast("string")
    for prefix, geo in reversed(prefixes):
        expr = F.when(ip.startswith(prefix), F.lit(geo)).otherwise(expr)
    return expr


def prefix_geo(ips: DataFrame, prefixes: DataFrame) -> DataFrame:
    """ENR3: (src_ip) -> (src_ip, prefix_geo) for ips with a matching prefix."""
    lengths = sorted({r[0] for r in prefixes.select(F.length("prefix")).distinct().collect()})
    if not lengths:
        return ips.select("src_ip", F.lit(None).cast("string").alias("prefix_geo")).limit(0)
    cands = ips.select("src_ip", F.explode(F.array_distinct(F.array(
        *[F.substring("src_ip", 1, n) for n in lengths]))).alias("prefix"))
    return (cands.join(prefixes, "prefix")
            .groupBy("src_ip").agg(F.min_by("geo", "ord").alias("prefix_geo")))


def enrich(alerts: DataFrame, intel: DataFrame | None = None,
           prefixes: DataFrame | None = None, static_intel: DataFrame | None = None) -> DataFrame:
    """``source_alerts`` -> alerts + ``enrichment`` struct (ENR6) and flat helpers
    ``internal_source``, ``geolocation``, ``reputation``, ``tags``."""
    spark = alerts.sparkSession
    intel = intel if intel is not None else empty_intel(spark)
    static = static_intel if static_intel is not None else dims.static_intel(spark)

    # one row per ip: the last by ``feed_order`` if the feed has one, else a fixed choice
    fields = ("geo", "reputation", "tags", "reports_90d")
    order = F.col("feed_order") if "feed_order" in intel.columns else F.struct(*fields)
    intel = intel.groupBy("ip").agg(F.max_by(F.struct(*fields), order).alias("_row")) \
        .select("ip", "_row.*")
    dyn = intel.select(F.col("ip").alias("src_ip"), F.lit(True).alias("_dyn"),
                       F.col("geo").alias("_dyn_geo"),
                       F.struct("reputation", "tags", "reports_90d").alias("_dyn_ti"))
    stat = static.select(F.col("ip").alias("src_ip"),
                         F.struct("reputation", "tags", "reports_90d").alias("_st_ti"))

    internal = is_internal(F.col("src_ip"))
    no_record = F.struct(F.lit("no records").alias("reputation"),
                         F.array().cast("array<string>").alias("tags"),
                         F.lit(None).cast("int").alias("reports_90d"))
    ti = (F.when(F.col("_dyn"), F.col("_dyn_ti"))
          .when(F.col("_st_ti").isNotNull(), F.col("_st_ti"))
          .otherwise(no_record))
    geo = F.coalesce(F.when(internal, F.lit(dims.INTERNAL_GEO)),
                     F.nullif(F.col("_dyn_geo"), F.lit("")),
                     F.col("prefix_geo"), F.lit(dims.UNKNOWN_GEO))
    joined = alerts.join(dyn, "src_ip", "left").join(stat, "src_ip", "left")
    if prefixes is None:
        joined = joined.withColumn("prefix_geo", prefix_case(F.col("src_ip"), dims.GEO_PREFIXES))
    else:
        pgeo = prefix_geo(alerts.select("src_ip").distinct(), prefixes)
        joined = joined.join(pgeo, "src_ip", "left")
    joined = joined.withColumn("_dyn", F.coalesce(F.col("_dyn"), F.lit(False)))
    out = joined.select(
        *alerts.columns,
        F.struct(internal.alias("internal_source"), geo.alias("geolocation"),
                 ti.alias("threat_intel")).alias("enrichment"))
    return out.select("*", F.col("enrichment.internal_source").alias("internal_source"),
                      F.col("enrichment.geolocation").alias("geolocation"),
                      F.col("enrichment.threat_intel.reputation").alias("reputation"),
                      F.col("enrichment.threat_intel.tags").alias("tags"))
