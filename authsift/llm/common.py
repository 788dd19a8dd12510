"""Small helpers shared by the corpus operators."""
from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from authsift.session import shared_dir

BITMAP_BITS = 25
"""Size of the fixed candidate bitmaps: 2**25 bits = 4 MB, whatever the data."""


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def saved(df: DataFrame) -> DataFrame:
    """Cut the lineage with a reliable checkpoint in the shared folder."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def crc_mod(col: str, n: int) -> Column:
    """crc32 of the id as text, modulo n (a null id counts as the empty text)."""
    return F.crc32(F.coalesce(F.col(col).cast("string"), F.lit("")).cast("binary")) % n


def passed_through(df: DataFrame, extra: str) -> str:
    """DDL-free schema of ``df`` plus extra fields, for mapInArrow."""
    from pyspark.sql import types as T
    return T.StructType(df.schema.fields + T.StructType.fromDDL(extra).fields)


def with_columns(batch: pa.RecordBatch, **cols: pa.Array) -> pa.RecordBatch:
    """The batch with further columns behind its own."""
    return pa.RecordBatch.from_arrays([*batch.columns, *cols.values()],
                                      names=[*batch.schema.names, *cols])


def bitmap_of(df: DataFrame, col: str | None = None, hashed: Callable[[pa.RecordBatch], np.ndarray] | None = None) -> np.ndarray:
    """A fixed-size bitmap (2**BITMAP_BITS bits) of the 64-bit hashes in ``col``, or that ``hashed`` makes of
    the rows (in the same Python worker: a step of its own before would take a second one per task).

    Every task ors its hashes into one bitmap and emits its non-empty 8 KB
    pages, which Spark ors per page, so the driver gets 4 MB at any input size.
    Used as a first filter only: a clear bit proves absence, a set bit is
    followed by an exact join.
    """
    page = 1 << 13

    def bits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros((1 << BITMAP_BITS) // 8, dtype=np.uint8)
        for b in batches:
            if b.num_rows:
                h = hashed(b) if hashed else b.column(0).drop_null().to_numpy(zero_copy_only=False)
                at = np.unique(h.astype(np.uint64) >> np.uint64(64 - BITMAP_BITS)).astype(np.int64)
                byte = at >> 3
                first = np.flatnonzero(np.diff(byte, prepend=-1))
                if len(first):
                    seen[byte[first]] |= np.bitwise_or.reduceat(np.uint8(128) >> (at & 7).astype(np.uint8), first)
        pages = seen.reshape(-1, page)
        full = np.flatnonzero(pages.any(axis=1))
        if len(full):
            yield pa.RecordBatch.from_arrays(
                [pa.array(full.astype(np.int32)),
                 pa.array([pages[k].tobytes() for k in full], pa.binary())], names=["page", "bits"])

    def ored(key, rows):
        import pandas as pd
        out = np.zeros(page, dtype=np.uint8)
        for x in rows["bits"]:
            out |= np.frombuffer(x, dtype=np.uint8)
        return pd.DataFrame({"page": [key[0]], "bits": [out.tobytes()]})

    pages = ((df if hashed else df.select(F.col(col).cast("bigint"))).mapInArrow(bits, "page int, bits binary")
             .groupBy("page").applyInPandas(ored, "page int, bits binary"))
    out = np.zeros((1 << BITMAP_BITS) // 8, dtype=np.uint8).reshape(-1, page)
    for r in pages.collect():
        out[r["page"]] = np.frombuffer(r["bits"], dtype=np.uint8)
    return out.reshape(-1)


def in_bitmap(bitmap: np.ndarray, h: np.ndarray) -> np.ndarray:
    at = h.astype(np.uint64) >> np.uint64(64 - BITMAP_BITS)
    return (bitmap[(at >> np.uint64(3)).astype(np.int64)]
            >> (7 - (at & np.uint64(7))).astype(np.uint8)) & 1 != 0
