"""SNK1-SNK5: result, IOC, blocklist, feedback and case-update writers.

Files carry no row order, so ranked output keeps its ``rank`` column.

A writer given a ``batch`` writes into the folder ``batch=<id>`` of its output and replaces just that
folder, so a job that is repeated after a failure adds nothing twice, whatever it left
behind; other batches stay.  Without a batch the whole output is replaced.
"""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BATCH = "batch"

RESULT_COLUMNS = ["rank", "src_ip", "verdict", "severity", "confidence", "mitre_technique_id",
                  "mitre_technique_name", "summary", "recommended_actions"]


def _at(path: str, batch: str | int | None) -> str:
    return path if batch is None else f"{path}/{BATCH}={batch}"


def write_results(ranked: DataFrame, path: str, mode: str = "overwrite", batch: str | int | None = None) -> None:
    """SNK1: ranked verdict records as JSON lines (``rank`` included)."""
    ranked.select(*RESULT_COLUMNS).write.mode(mode).json(_at(path, batch))


def write_iocs(iocs: DataFrame, path: str, mode: str = "overwrite", batch: str | int | None = None) -> None:
    """SNK2: IOC table as CSV with header."""
    iocs.write.mode(mode).csv(_at(path, batch), header=True, escape='"')


def write_blocklist(iocs: DataFrame, path: str, mode: str = "overwrite", batch: str | int | None = None) -> None:
    """SNK3: one indicator per line."""
    iocs.select(F.col("indicator").cast("string")).write.mode(mode).text(_at(path, batch))


def write_feedback(feedback: DataFrame, path: str, mode: str = "overwrite", batch: str | int | None = None) -> None:
    """SNK4: analyst feedback table as CSV with header."""
    feedback.write.mode(mode).csv(_at(path, batch), header=True, escape='"')


def append_case_updates(updates: DataFrame, path: str, batch: str | int | None = None) -> None:
    """SNK5: append case updates (long form) to a parquet table partitioned by dataset.

    With a ``batch`` the rows go to the partitions (dataset, batch), and just these are
    replaced (dynamic partition overwrite): the same batch written again is no second append.
    """
    if batch is None:
        updates.write.mode("append").partitionBy("dataset").parquet(path)
    else:
        (updates.withColumn(BATCH, F.lit(str(batch))).write.mode("overwrite")
         .option("partitionOverwriteMode", "dynamic").partitionBy("dataset", BATCH).parquet(path))
