r"""Substring dedup over sliding sentence spans.

A sentence ends after ``.``, ``!`` or ``?`` before white space, or at a newline.  At
every sentence starts a span and, with ``ending``, at every sentence ends one: the
shortest run of at least 2 sentences with at least 15 words.  Both together cover
every repeated run of so many sentences and words: up to the last start from which a
run fits, the spans that start in it, and from there on the span that ends with it.
Without ``ending`` a repeated run's last sentences stay if they have fewer than 15
words.  Repeated runs of fewer words (``least``, a parameter) are left: short sentences recur
by chance.  Spans are equal if their words (A-Z lower-cased) are.  The
occurrences of a span are ordered by (id, text hash, position), a null id last; all
but the first are repeated, and a sentence covered by any repeated occurrence is
removed.

Pass 1 finds the spans that occur twice and their first occurrence (one aggregate,
summed on the map side).  Pass 2 emits only occurrences that a fixed 4 MB bitmap of
those spans lets through and joins them exactly; pass 3 joins the ranges to the
texts.  A frequent span is one row on the build side of the join, so its
occurrences may be split over tasks.

Edge cases: null and empty texts have no sentences and stay as they are; a text of
fewer than 15 words or one sentence has no span; rows of equal id and text are one
document (all keep the same sentences), and null ids come last among the occurrences; very
long texts are worked on whole, a slice of rows at a time; extra columns are ignored or, in
``deduplicated``, passed on; an empty table gives an empty result.
"""
from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from authsift.llm import textarrays as ta
from authsift.llm.common import bitmap_of, in_bitmap, passed_through, saved

RUN, MIN_WORDS = 2, 15
ENDS = ta._table(lambda b: chr(b) in ".!?")


def sentences(data: np.ndarray, offs: np.ndarray) -> tuple[ta.Words, np.ndarray, np.ndarray, np.ndarray]:
    """(words, first word, end word, row) of every sentence of the slice."""
    w = ta.words(ta.LOWER[data], offs, ta.SPACED)
    n = len(w.row)
    if not n:
        z = np.zeros(0, np.int64)
        return w, z, z, z
    newlines = np.concatenate([[0], np.cumsum(data == 10)])
    stop = np.ones(n, bool)
    stop[:-1] = ENDS[data[w.end[:-1] - 1]] | (newlines[w.start[1:]] > newlines[w.end[:-1]]) | (w.row[1:] != w.row[:-1])
    end = np.flatnonzero(stop) + 1
    first = np.concatenate([[0], end[:-1]])
    return w, first, end, w.row[first]


def spans(w: ta.Words, first: np.ndarray, end: np.ndarray, row: np.ndarray, run: int, least: int, ending: bool
          ) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first sentence, end sentence, hash) of every span; indices into the slice's sentences."""
    n = len(first)
    if not n:
        z = np.zeros(0, np.int64)
        return z, z, np.zeros(0, np.uint64)
    at = np.arange(n)
    stop = np.maximum(np.searchsorted(end, first + least) + 1, at + run)
    last = np.searchsorted(row, row, side="right")
    at = at[stop <= last]
    stop = stop[at]
    if ending:
        to = np.arange(1, n + 1)
        back = np.minimum(np.searchsorted(first, end - least, side="right") - 1, to - run)
        fits = back >= np.searchsorted(row, row)
        each = np.unique(np.concatenate([at * (n + 1) + stop, back[fits] * (n + 1) + to[fits]]))  # a run found both ways is one span
        at, stop = each // (n + 1), each % (n + 1)
    with np.errstate(over="ignore"):  # polynomial over the word hashes: any run in constant time
        p = ta._power(ta._BASE, len(w.hash) + 1)
        q = ta._power(ta._INVERSE, len(w.hash) + 1)
        c = np.concatenate([np.zeros(1, np.uint64), np.cumsum(w.hash * p[:-1], dtype=np.uint64)])
        a, b = first[at], end[stop - 1]
        h = (c[b] - c[a]) * q[a] + (b - a).astype(np.uint64) * np.uint64(0xA0761D6478BD642F)
    return at, stop, ta.mix(h)


def _text_key(data: np.ndarray, offs: np.ndarray) -> np.ndarray:
    return ta.byte_hashes(data, offs[:-1], offs[1:]).view(np.int64)


def repeats(docs: DataFrame, text: str = "text", id_col: str = "doc_id", run: int = RUN, least: int = MIN_WORDS,
            ending: bool = True) -> DataFrame:
    """(id, key, removed): sentence ranges [lo, hi) to remove per document (id, hash of the text)."""
    rows = docs.select(F.col(id_col).alias("id"), F.col(text).cast("string").alias("t"))

    def emit(bits):
        def out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                for a, _, data, offs in ta.slices(b.column(1)):
                    w, first, end, row = sentences(data, offs)
                    s, e, h = spans(w, first, end, row, run, least, ending)
                    if bits is not None and len(h):
                        pick = in_bitmap(bits.value, h)
                        s, e, h = s[pick], e[pick], h[pick]
                    r = row[s]
                    base = np.searchsorted(row, r)  # a row's sentences are numbered from 0
                    yield pa.RecordBatch.from_arrays(
                        [b.column(0).take(pa.array(a + r)), pa.array(_text_key(data, offs)[r]), pa.array(h.view(np.int64)),
                         pa.array((s - base).astype(np.int32)), pa.array((e - base).astype(np.int32))],
                        names=["id", "key", "h", "lo", "hi"])
        return out

    schema = passed_through(rows.select("id"), "key bigint, h bigint, lo int, hi int")
    place = F.struct(F.col("id").isNull().alias("none"), "id", "key", "lo")
    twice = saved(rows.mapInArrow(emit(None), schema).groupBy("h").agg(F.count(F.lit(1)).alias("n"), F.min(place).alias("first"))
                  .where("n > 1").select("h", "first"))
    bits = docs.sparkSession.sparkContext.broadcast(bitmap_of(twice, "h"))
    found = rows.mapInArrow(emit(bits), schema).join(twice, "h").where(place != F.col("first"))
    return found.groupBy("id", "key").agg(F.sort_array(F.collect_set(F.struct("lo", "hi"))).alias("removed"))


def deduplicated(docs: DataFrame, text: str = "text", id_col: str = "doc_id", run: int = RUN, least: int = MIN_WORDS,
                 ending: bool = False) -> DataFrame:
    """``docs`` with the text less its repeated sentences, and n_sentences, n_removed, words_removed."""
    cut = repeats(docs, text, id_col, run, least, ending).select(F.col("id").alias(_ID), F.col("key").alias(_KEY),
                                                         F.transform("removed", lambda r: F.array(r["lo"], r["hi"])).alias(_CUT))
    names = list(docs.columns)
    at = names.index(text)

    def keyed(batches):
        for b in batches:
            keys = [_text_key(data, offs) for _, _, data, offs in ta.slices(b.column(at).cast(pa.string()))]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(np.concatenate(keys) if keys else np.zeros(0, np.int64))],
                                             names=[*b.schema.names, _KEY])

    def removed(batches):
        for b in batches:
            cuts = b.column(len(names)).to_pylist()
            texts, n_s, n_r, w_r = [], [], [], []
            column = b.column(at).cast(pa.string())
            for a, e, data, offs in ta.slices(column):
                w, first, end, row = sentences(data, offs)
                lo, hi = np.searchsorted(row, np.arange(e - a)), np.searchsorted(row, np.arange(e - a), side="right")
                raw = data.tobytes()
                for r in range(e - a):
                    f, g = first[lo[r]:hi[r]], end[lo[r]:hi[r]]
                    gone = np.zeros(len(f), bool)
                    for x, y in cuts[a + r] or ():
                        gone[x:y] = True
                    n_s.append(len(f))
                    n_r.append(int(gone.sum()))
                    w_r.append(int((g - f)[gone].sum()))
                    if not gone.any():
                        texts.append(column[a + r].as_py())
                        continue
                    # a sentence reaches from its first word to the next sentence's
                    start = np.concatenate([[offs[r]], w.start[f[1:]], [offs[r + 1]]])
                    texts.append(b"".join(raw[start[k]:start[k + 1]] for k in np.flatnonzero(~gone)).decode("utf-8"))
            cols = list(b.columns[:len(names)])
            cols[at] = pa.array(texts, pa.string())
            yield pa.RecordBatch.from_arrays([*cols, *(pa.array(x, pa.int64()) for x in (n_s, n_r, w_r))],
                                             names=[*names, "n_sentences", "n_removed", "words_removed"])

    rows = docs.mapInArrow(keyed, passed_through(docs, f"{_KEY} bigint"))
    joined = rows.join(cut, (rows[_KEY] == cut[_KEY]) & rows[id_col].eqNullSafe(cut[_ID]), "left") \
        .select(*(rows[c] for c in docs.columns), cut[_CUT])
    return joined.mapInArrow(removed, passed_through(docs, "n_sentences bigint, n_removed bigint, words_removed bigint"))


_ID, _KEY, _CUT = "__doc", "__text_key", "__cut"
