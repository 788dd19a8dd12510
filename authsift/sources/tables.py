"""SRC3-SRC5: intel feed, labels and stored results readers."""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.ordering import with_arrival
from ..operators.enrich import INTEL_SCHEMA

INTEL_ENTRY = "struct<geo: string, reputation: string, tags: array<string>, reports_90d: int>"
LABEL_SCHEMA = "src_ip string, verdict string, notes string"
RESULT_SCHEMA = ("src_ip string, verdict string, severity string, confidence int, "
                 "mitre_technique_id string, mitre_technique_name string, summary string, "
                 "recommended_actions array<string>")


def read_intel(spark: SparkSession, path: str, fmt: str = "object") -> DataFrame:
    """SRC3: intel keyed by ip -> ``ip, geo, reputation, tags, reports_90d``.

    ``object``: one JSON object ``{ip: {...}}`` per file (the generator's
    format); ``jsonl``: one ``{"ip": .., ...}`` per line; ``parquet``.
    Large feeds should use the line or parquet forms, which split.
    """
    if fmt == "parquet":
        return spark.read.parquet(path).select(*[c.split()[0] for c in INTEL_SCHEMA.split(", ")])
    if fmt == "jsonl":
        return spark.read.schema(INTEL_SCHEMA).json(path)
    whole = spark.read.text(path, wholetext=True)
    m = F.from_json("value", f"map<string, {INTEL_ENTRY}>", {"mode": "FAILFAST"})  # a broken feed is an error
    return (whole.select(F.explode(m).alias("ip", "e"))
            .select("ip", "e.geo", "e.reputation", "e.tags", "e.reports_90d"))


def read_labels(spark: SparkSession, path: str | None) -> DataFrame:
    """SRC4 + EVAL10: label CSV with header; duplicate ips keep the last row;
    a missing path gives an empty table."""
    if not path:
        return spark.createDataFrame([], LABEL_SCHEMA)
    try:
        raw = with_arrival(spark.read.schema(LABEL_SCHEMA).csv(path, header=True), "seq")
        raw.schema  # noqa: B018 - resolve now so a missing file is caught here
    except Exception as exc:  # pyspark AnalysisException: path does not exist
        if "PATH_NOT_FOUND" in str(exc) or "does not exist" in str(exc):
            return spark.createDataFrame([], LABEL_SCHEMA)
        raise
    last = F.max_by(F.struct("verdict", "notes"), "seq").alias("_last")
    return raw.groupBy("src_ip").agg(last).select("src_ip", "_last.*")


def read_results(spark: SparkSession, path: str, multiline: bool = True) -> DataFrame:
    """SRC5: stored verdict records (a JSON array, or JSON lines); duplicate ips
    keep the last record."""
    raw = with_arrival(spark.read.schema(RESULT_SCHEMA).json(path, multiLine=multiline), "_seq")
    cols = [c for c in raw.columns if c not in ("_seq", "src_ip")]
    return raw.groupBy("src_ip").agg(
        *[F.max_by(c, "_seq").alias(c) for c in cols])
