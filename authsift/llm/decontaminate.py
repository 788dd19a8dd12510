r"""Benchmark decontamination by winnowing.

Texts are lower-cased (A-Z) and cut into words; a k-gram is k = 6 consecutive
words.  Of every 5 consecutive k-gram hashes the smallest is kept (winnowing),
so every shared run of 5 + 6 - 1 = 10 words has a kept k-gram in common.  Kept
k-grams of documents and benchmark items are joined; each match is extended, word
by word, by up to 4 words to either side, which decides all 10-word windows that
contain the k-gram.  The union over the matches is exact: each shared window
holds a kept k-gram of its own.  Items of fewer than 10 words are one window:
for each such length present, all n-grams of that length are joined.

Words themselves are compared after the hash join, so hash collisions add
nothing.  Documents' k-grams pass a fixed 4 MB bitmap of the benchmark's hashes
first: what it lets through by chance falls to the join; if a benchmark fills it,
the join just gets more rows.  Equal items are matched once per distinct text and
expanded to item ids only at (document, text).

Edge cases: null and word-less texts have no windows and no hits; windows of
an item without id are hits, but it isn't counted or listed; repeated rows
each get a result; very long texts are worked on whole; extra columns are ignored; an empty benchmark or table gives no
hits or no rows.
"""
from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from authsift.llm import textarrays as ta
from authsift.llm.common import bitmap_of, in_bitmap, passed_through, saved, with_columns

WINDOW = 10
K = 6


def winnow(g: np.ndarray, pos: np.ndarray, end: np.ndarray, first: np.ndarray, width: int) -> np.ndarray:
    """Positions of the smallest hash (the last on ties) of each ``width`` consecutive grams of a text.

    ``pos``: positions of all grams; ``first`` and ``end``: where the grams of the
    text at ``pos`` begin and end.  A text with fewer grams has one window.
    """
    best = pos.copy()
    for k in range(1, width):
        nxt = np.minimum(pos + k, end - 1)
        best = np.where(g[nxt] <= g[best], nxt, best)
    return np.unique(best[(pos + width <= end) | (pos == first)])


def _grams(w: ta.Words, n: int, positions: np.ndarray, reach: int, data: np.ndarray) -> pa.Array:
    """The n words of each gram with ``reach`` words to either side, empty beyond the text."""
    lo, hi = w.first[w.row[positions]], (w.first + w.count)[w.row[positions]]
    at = positions[:, None] + np.arange(-reach, n + reach)[None, :]
    ok = (at >= lo[:, None]) & (at < hi[:, None])
    at = np.where(ok, at, 0).ravel()
    raw = data.tobytes()
    flat = [raw[s:e].decode("utf-8", "replace") if k else "" for s, e, k in zip(w.start[at], w.end[at], ok.ravel())]
    per = n + 2 * reach
    return pa.ListArray.from_arrays(pa.array(np.arange(0, len(flat) + 1, per, dtype=np.int32)), pa.array(flat, pa.string()))


def grams(column: pa.Array, short: list[int], kind: str, k: int, window: int, bitmap: np.ndarray | None):
    """Per slice of a text column: (first row, words, [(rows, hash, position, n, words)]).

    n is k for winnowed k-grams and minus its length for a whole short window.
    """
    for a, _, data, offs in ta.slices(column, ta.SMALL_BYTES):
        data = ta.LOWER[data]
        w = ta.words(data, offs, ta.ALNUM)
        out = []
        for n, whole in [(k, False), *((n, True) for n in short)]:
            g = ta.ngrams(w.hash, n)
            at = ta.inside(w, n)
            if whole and kind == "item":
                at = at[w.count[w.row[at]] == n]
            elif not whole:
                at = winnow(g, at, (w.first + w.count)[w.row[at]] - n + 1, w.first[w.row[at]], window - k + 1)
                if kind == "item":  # shorter items are whole windows
                    at = at[w.count[w.row[at]] >= window]
            h = g[at] ^ np.uint64((2 * n + whole) * 0x9E3779B97F4A7C15 & (2**64 - 1))
            if bitmap is not None and len(at):
                keep = in_bitmap(bitmap, h)
                at, h = at[keep], h[keep]
            if len(at):
                out.append((w.row[at], h, (at - w.first[w.row[at]]).astype(np.int32), -n if whole else n,
                            _grams(w, n, at, 0 if whole else window - k, data)))
        yield a, w, out


def text_key(column: pa.Array) -> np.ndarray:
    """64-bit hash of each whole text (null: empty)."""
    parts = [ta.byte_hashes(data, offs[:-1], offs[1:]) for _, _, data, offs in ta.slices(column, ta.SMALL_BYTES)]
    return (np.concatenate(parts) if parts else np.zeros(0, np.uint64)).view(np.int64)


def _long(x) -> pa.Array:
    return pa.array(np.asarray(x).astype(np.uint64).view(np.int64), pa.int64())


def matches(docs: DataFrame, items: DataFrame, text: str = "text", item_text: str = "text",
            item_id: str = "item_id", window: int = WINDOW, k: int = K) -> tuple[DataFrame, DataFrame]:
    """(hits, items): hits (key, item_key, lo, hi) are matched word ranges of texts.

    ``key`` is the 64-bit hash of a document's text: equal texts share their hits.
    """
    items = items.select(F.col(item_id).alias("item_id"), F.coalesce(F.col(item_text), F.lit("")).alias("t"))

    def item_words(batches):
        for b in batches:
            n = np.concatenate([w.count for _, w, _ in grams(b.column(1), [], "item", k, window, None)] or [np.zeros(0, int)])
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(text_key(b.column(1))), b.column(1), pa.array(n, pa.int64())],
                                             names=["item_id", "item_key", "t", "n"])

    schema = passed_through(items.select("item_id"), "item_key bigint, t string, n bigint")
    items = saved(items.mapInArrow(item_words, schema))
    short = sorted(r["n"] for r in items.where((F.col("n") > 0) & (F.col("n") < window)).select("n").distinct().collect())

    def item_grams(batches):
        for b in batches:
            keys = b.column(0).to_numpy()
            for a, _, found in grams(b.column(1), short, "item", k, window, None):
                for rows, h, at, n, ws in found:
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(keys[a + rows]), _long(h), pa.array(np.full(len(at), n, np.int32)), ws],
                        names=["item_key", "h", "n", "words"])

    texts = items.select("item_key", "t").dropDuplicates(["item_key"])
    anchors = saved(texts.mapInArrow(item_grams, "item_key bigint, h bigint, n int, words array<string>").distinct())
    bits = docs.sparkSession.sparkContext.broadcast(bitmap_of(anchors, "h"))

    def doc_grams(batches):
        for b in batches:
            keys = text_key(b.column(0))
            for a, _, found in grams(b.column(0), short, "doc", k, window, bits.value):
                for rows, h, at, n, ws in found:
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(keys[a + rows]), _long(h), pa.array(at),
                         pa.array(np.full(len(at), n, np.int32)), ws], names=["key", "h", "at", "n", "words"])

    found = docs.select(F.col(text).cast("string")).mapInArrow(
        doc_grams, "key bigint, h bigint, at int, n int, words array<string>") \
        .dropDuplicates(["key", "h", "at", "n"])  # copies of a text count once
    a = anchors.select("item_key", "h", F.col("n").alias("item_n"), F.col("words").alias("item_words"))
    pairs = found.join(a, "h").where(F.col("n") == F.col("item_n"))
    reach = window - k

    def run(offsets: list[int]) -> Column:
        """How many words match one after another, going out from the k-gram."""
        out = F.lit(len(offsets))
        for far, o in reversed(list(enumerate(offsets))):
            same = (F.col("words")[o] != "") & (F.col("words")[o] == F.col("item_words")[o])
            out = F.when(~same, far).otherwise(out)
        return out

    whole = F.col("n") < 0
    core = F.slice("words", reach + 1, k) == F.slice("item_words", reach + 1, k)
    pairs = pairs.withColumn("left", F.when(whole, 0).otherwise(run(list(range(reach - 1, -1, -1))))) \
        .withColumn("right", F.when(whole, 0).otherwise(run(list(range(reach + k, 2 * reach + k)))))
    ok = F.when(whole, F.col("words") == F.col("item_words")).otherwise(core & (F.col("left") + F.col("right") + k >= window))
    hits = pairs.where(ok).select("key", "item_key", (F.col("at") - F.col("left")).alias("lo"),
                                  (F.col("at") + F.abs("n") + F.col("right")).alias("hi"))
    return saved(hits), items


def report(docs: DataFrame, items: DataFrame, text: str = "text", id_col: str = "doc_id", **options) -> DataFrame:
    """Per document: n_words, n_hit, n_items, items_sha256, contaminated."""
    hits, items = matches(docs, items, text=text, **options)

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n = [ta.words(data, offs, ta.ALNUM, hashed=False).count for _, _, data, offs in ta.slices(b.column(1))]
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array(text_key(b.column(1))),
                 pa.array(np.concatenate(n) if n else np.zeros(0, np.int64), pa.int64())], names=["id", "key", "n_words"])

    chosen = docs.select(F.col(id_col).alias("id"), F.col(text).alias("t"))
    rows = chosen.mapInArrow(counted, passed_through(chosen.select("id"), "key bigint, n_words bigint"))
    n_hit = hits.select("key", F.explode(F.sequence("lo", F.col("hi") - 1)).alias("w")).distinct() \
        .groupBy("key").agg(F.count(F.lit(1)).alias("n_hit"))
    names = hits.select("key", "item_key").distinct().join(
        items.select("item_key", F.col("item_id").cast("string").alias("item")).where("item is not null"), "item_key") \
        .select("key", "item").distinct()
    of = names.groupBy("key").agg(F.count(F.lit(1)).alias("n_items"),
                                  F.array_join(F.array_sort(F.collect_list("item")), ",").alias("names"))
    found = n_hit.join(of, "key", "left")
    out = rows.join(found, "key", "left")
    return out.select(F.col("id").alias(id_col), "n_words", F.coalesce("n_hit", F.lit(0)).cast("bigint").alias("n_hit"),
                      F.coalesce("n_items", F.lit(0)).cast("bigint").alias("n_items"),
                      F.sha2(F.coalesce("names", F.lit("")).cast("binary"), 256).alias("items_sha256"),
                      (F.coalesce("n_hit", F.lit(0)) > 0).alias("contaminated"))


def clean(docs: DataFrame, items: DataFrame, text: str = "text", **options) -> DataFrame:
    """The rows of ``docs`` without any hit, unchanged."""
    hits, _ = matches(docs, items, text=text, **options)
    at = docs.columns.index(text)

    def keyed(batches):
        for b in batches:
            yield with_columns(b, **{_KEY: pa.array(text_key(b.column(at)))})

    rows = docs.mapInArrow(keyed, passed_through(docs, f"{_KEY} bigint"))
    return rows.join(hits.select(F.col("key").alias(_KEY)).distinct(), _KEY, "left_anti").select(*docs.columns)


_KEY = "__text_key"
