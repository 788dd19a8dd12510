"""SRC1: sshd auth log text files -> raw lines with an arrival-order key."""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.ordering import with_arrival
from ..functions.text import py_strip


def read_auth_log(spark: SparkSession, path: str | list[str], dataset: str) -> DataFrame:
    """Raw lines of one or more sshd logs (globs and .gz work as in any text scan).

    Columns: ``dataset, seq, raw`` where ``raw`` is the line stripped of
    surrounding whitespace.  ``seq`` is attached on the scan, before any
    filter or shuffle can reorder rows.
    """
    paths = [path] if isinstance(path, str) else list(path)
    lines = with_arrival(spark.read.text(paths), "seq")
    return lines.select(F.lit(dataset).alias("dataset"), "seq",
                        py_strip(F.col("value")).alias("raw"))


def read_log_text(spark: SparkSession, path: str) -> DataFrame:
    """A whole log file as one row (``path, text``) for fingerprinting."""
    return spark.read.text(path, wholetext=True).select(
        F.col("_metadata.file_path").alias("path"), F.col("value").alias("text"))
