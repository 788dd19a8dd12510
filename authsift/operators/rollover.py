"""PARSE9 over several years: the year of every line of a log whose times have none.

In arrival order a step from December back to January (the month falls by six or more)
begins a new year; a late line that jumps the other way belongs to the year before.  So
a line's year is the first year plus the sum of all steps up to it, per dataset: a running
sum over the whole log.  It is taken like row numbers: one range sort by (dataset, arrival),
sums within each partition, and the carry of the partitions before from a table of one
row per partition and dataset.
"""
from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import syslog_month, syslog_time
from ..session import shared_dir

TURN = 6  # months: a larger fall or rise is a turn of the year


def _runs(batch: pa.RecordBatch, dataset: int, month: int, last: dict) -> np.ndarray:
    """Running sum of the year steps of one batch, by dataset; ``last``: dataset -> (last month, sum)."""
    names = batch.column(dataset).to_pylist()
    months = batch.column(month).to_numpy(zero_copy_only=False).astype(float)
    out = np.zeros(len(names), np.int64)
    cuts = [0, *(k for k in range(1, len(names)) if names[k] != names[k - 1]), len(names)]
    for a, b in zip(cuts, cuts[1:]):
        if a == b:
            continue
        before, total, *_ = last.get(names[a], (np.nan, 0))
        known = np.flatnonzero(~np.isnan(months[a:b]))  # a line without a month turns nothing
        m = np.concatenate([[before], months[a:b][known]])
        step = np.zeros(b - a, np.int64)
        fall = m[:-1] - m[1:]
        step[known] = (fall >= TURN).astype(np.int64) - (fall <= -TURN)
        out[a:b] = total + np.cumsum(step)
        first = last[names[a]][2] if names[a] in last else None
        if first is None and len(known):
            first = m[1]
        last[names[a]] = (m[-1], int(out[b - 1]), first)
    return out


def with_rollover(events: DataFrame, first_year: int) -> DataFrame:
    """``auth_events`` with ``event_time`` in the line's own year, as TIMESTAMP_NTZ.

    ``first_year`` is the year of each dataset's first line.  Rows that come out of order by less
    than half a year are right on both sides of New Year.  A dataset may hold all rows.
    """
    spark = events.sparkSession
    shared_dir(spark)
    rows = events.drop("event_time").withColumn("_month", syslog_month(F.col("ts_text")))
    ordered = rows.orderBy("dataset", "seq").checkpoint(eager=True)
    names = ordered.columns
    at = names.index("dataset"), names.index("_month")

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last: dict = {}
        for b in batches:
            _runs(b, 0, 1, last)
        pid = TaskContext.get().partitionId()
        yield pa.RecordBatch.from_pylist(
            [{"_pid": pid, "dataset": d, "_first": f, "_last": None if np.isnan(m) else m, "_sum": n}
             for d, (m, n, f) in last.items()], schema=pa.schema([("_pid", pa.int32()), ("dataset", pa.string()), ("_first", pa.float64()),
                                                                  ("_last", pa.float64()), ("_sum", pa.int64())]))

    parts = ordered.select("dataset", "_month").mapInArrow(
        summed, "_pid int, dataset string, _first double, _last double, _sum bigint")
    w = Window.partitionBy("dataset").orderBy("_pid")
    before = F.last("_last", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1))
    fall = before - F.col("_first")
    joint = F.coalesce(F.when(fall >= TURN, 1).when(fall <= -TURN, -1), F.lit(0))  # the step into the partition
    carried = (parts.withColumn("_joint", joint)
               .withColumn("_carry", F.sum(F.col("_sum") + F.col("_joint")).over(w) - F.col("_sum"))
               .select("_pid", "dataset", "_carry"))
    schema = T.StructType([*ordered.schema.fields, T.StructField("_pid", T.IntegerType()), T.StructField("_steps", T.LongType())])

    def stepped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last: dict = {}
        pid = TaskContext.get().partitionId()
        for b in batches:
            steps = _runs(b, *at, last)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(np.full(b.num_rows, pid, np.int32)), pa.array(steps)],
                                             names=schema.names)

    out = ordered.mapInArrow(stepped, schema).join(carried, ["_pid", "dataset"])
    year = (F.lit(first_year) + F.col("_steps") + F.col("_carry")).cast("int")
    return out.withColumn("event_time", syslog_time(F.col("ts_text"), year, zoned=False)).select(*events.columns)
