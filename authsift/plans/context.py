"""Materialised inputs for one table folder (``sf_dir``).

The derived sshd log is written once as text (what a real deployment reads),
and its parsed events once as parquet, both under the session's shared folder
(``spark.checkpoint.dir``).  Later queries read these instead of re-deriving:
the text boundary also keeps plans small (deriving and parsing in one plan
inlines the long derive expression into every regex use).
"""
from __future__ import annotations

import hashlib
import os
import uuid
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.correlate import source_values
from ..operators.parse import parse_events
from ..session import shared_dir
from ..sources.auth_log import read_auth_log
from ..sources.derived import (derive_auth_lines, derive_case_updates, derive_export_lines, derive_intel,
                               derive_labels, derive_order_lines, derive_security_events, profiled)

DATASET = "derived"
YEAR = 2024  # the year of the driver's events table; syslog lines carry none
FORMAT_VERSION = "v7"


def _exists(spark: SparkSession, path: str) -> bool:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return fs.exists(p)


def _publish(spark: SparkSession, path: str, write: Callable[[str], None]) -> None:
    """Write a derived table once: into a fresh sibling folder, then renamed into
    place, so readers never see a half-written table and a concurrent writer
    that loses the race simply keeps the winner's copy."""
    if _exists(spark, path):  # renamed into place when whole
        return
    tmp = f"{path}.tmp-{uuid.uuid4().hex[:8]}"
    write(tmp)
    jvm = spark.sparkContext._jvm
    dst = jvm.org.apache.hadoop.fs.Path(path)
    fs = dst.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(dst):
        fs.rename(jvm.org.apache.hadoop.fs.Path(tmp), dst)


def _order_file_times(spark: SparkSession, folder: str) -> None:
    """Give the part files of ``folder`` modification times in name order (one
    second apart), as a rotating logger would: a file-stream source takes
    files oldest first, so a stream then reads them in arrival order."""
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(folder)
    fs = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    names = sorted(str(st.getPath().toString()) for st in fs.listStatus(path)
                   if st.getPath().getName().startswith("part-"))
    base = 1_700_000_000_000
    for i, name in enumerate(names):
        fs.setTimes(jvm.org.apache.hadoop.fs.Path(name), base + 1000 * i, -1)


def _source_tag(sf_dir: str) -> str:
    events = os.path.join(sf_dir, "events.parquet")
    try:
        st = os.stat(events)
        stamp = f"{st.st_size}-{int(st.st_mtime)}"
    except OSError:  # not a local path: the name alone identifies it
        stamp = ""
    digest = hashlib.sha1(f"{FORMAT_VERSION}|{sf_dir}|{stamp}".encode()).hexdigest()[:12]
    return f"{os.path.basename(sf_dir.rstrip('/'))}-{digest}"


@dataclass(frozen=True)
class Derived:
    """The inputs derived from one table folder, each written when first asked for."""
    spark: SparkSession
    sf_dir: str
    root: str

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    def _written(self, name: str, write: Callable[[str], None]) -> str:
        path = f"{self.root}/{name}"
        _publish(self.spark, path, write)
        return path

    def _stored(self, name: str, rows: Callable[[], DataFrame], by: tuple[str, ...] = ()) -> str:
        return self._written(name, lambda p: rows().write.mode("overwrite").partitionBy(*by).parquet(p))

    def _profile(self) -> DataFrame:
        """The events' profiles, which the log, the feed and the labels are made of."""
        return self.spark.read.parquet(self._stored("event_profiles", lambda: profiled(self.table("events"))))

    @property
    def log_path(self) -> str:
        def write(path: str) -> None:
            # range-partitioned and sorted by event id: part files in name order =
            # arrival order; at least one file per core so small inputs still
            # spread over every core (at scale the 128 MB split cap decides)
            files = max(8, self.spark.sparkContext.defaultParallelism)
            (derive_auth_lines(self._profile()).repartitionByRange(files, "seq")
             .sortWithinPartitions("seq").select("line").write.mode("overwrite").text(path))
            _order_file_times(self.spark, path)
        return self._written("auth_log", write)

    @property
    def events_path(self) -> str:
        return self._stored("auth_events", lambda: parse_events(self.lines(), year=YEAR))

    @property
    def pairs_path(self) -> str:
        return self._stored("source_values", lambda: source_values(self.events()))

    @property
    def intel_path(self) -> str:
        return self._stored("intel", lambda: derive_intel(self._profile()))

    @property
    def labels_path(self) -> str:
        return self._stored("labels", lambda: derive_labels(self._profile()))

    @property
    def cases_path(self) -> str:
        return self._stored("case_updates", lambda: derive_case_updates(self.table("events")), by=("dataset",))

    @property
    def security_path(self) -> str:
        return self._stored("security_events", lambda: derive_security_events(self._profile()))

    def lines(self) -> DataFrame:
        """SRC1 over the derived text log."""
        return read_auth_log(self.spark, self.log_path, DATASET)

    def events(self) -> DataFrame:
        """Parsed events (parquet written once from the text log)."""
        return self.spark.read.parquet(self.events_path)

    def pairs(self) -> DataFrame:
        """(source, kind, value) pairs of the events (parquet written once)."""
        return self.spark.read.parquet(self.pairs_path)

    def case_updates(self) -> DataFrame:
        """Append-only case updates derived from ``events`` (partitioned by dataset)."""
        return self.spark.read.parquet(self.cases_path)

    def security_events(self) -> DataFrame:
        """Raw Windows security events derived from ``events``."""
        return self.spark.read.parquet(self.security_path)

    def intel(self) -> DataFrame:
        """Dynamic intel feed derived from ``events`` (parquet written once)."""
        return self.spark.read.parquet(self.intel_path)

    def labels(self) -> DataFrame:
        """Ground-truth labels derived from ``events`` (parquet written once)."""
        return self.spark.read.parquet(self.labels_path)

    def prepare(self) -> Derived:
        """Write the inputs that several queries share ahead of them."""
        for path in ("pairs_path", "intel_path", "cases_path", "security_path", "labels_path"):
            getattr(self, path)
        return self

    # --- inputs that few queries read -----------------------------------------------------------
    def logon_export(self, selected: DataFrame) -> str:
        """The selected logon rows as an export with broken lines; files in time order."""
        def write(path: str) -> None:
            files = max(4, self.spark.sparkContext.defaultParallelism // 2)
            (derive_export_lines(selected).repartitionByRange(files, "_time").sortWithinPartitions("_time", "part")
             .select("value").write.mode("overwrite").text(path))
            _order_file_times(self.spark, path)
        return self._written("logon_export", write)

    def label_files(self) -> str:
        """Label CSVs: an older file with every verdict turned round, then the labels."""
        def write(path: str) -> None:
            old = self.labels().select("src_ip", F.when(F.col("verdict") == "true_positive", "false_positive")
                                       .otherwise("true_positive").alias("verdict"), F.lit("old").alias("notes"))
            old.write.mode("overwrite").csv(f"{path}/0", header=True)
            self.labels().select("src_ip", "verdict", "notes").write.mode("overwrite").csv(f"{path}/1", header=True)
        return self._written("label_csv", write)

    def intel_lines(self) -> str:
        """The intel feed as JSON lines."""
        return self._written("intel_jsonl", lambda p: self.intel().write.mode("overwrite").json(p))

    def order_log(self) -> str:
        """A log over several years; part files in name order are in arrival order."""
        def write(path: str) -> None:
            files = max(8, self.spark.sparkContext.defaultParallelism)
            (derive_order_lines(self.table("orders")).repartitionByRange(files, "day", "seq")
             .sortWithinPartitions("day", "seq").select("line").write.mode("overwrite").text(path))
        return self._written("order_log", write)


def derived(spark: SparkSession, sf_dir: str) -> Derived:
    """The derived inputs for ``sf_dir``; a query writes those it reads, once."""
    return Derived(spark, sf_dir, f"{shared_dir(spark)}/authsift-derived/{_source_tag(sf_dir)}")
