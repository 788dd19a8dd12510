"""Per-text statistics of a slice of an Arrow string column, vectorised over its bytes."""
from __future__ import annotations

import numpy as np

from authsift.llm import textarrays as ta

SYMBOLS = ta._table(lambda b: chr(b) in "#*$%&|<>")
UPPER = ta._table(lambda b: 0x41 <= b <= 0x5A)
LETTER = ta._table(lambda b: 0x41 <= b <= 0x5A or 0x61 <= b <= 0x7A)
DIGIT = ta._table(lambda b: 0x30 <= b <= 0x39)
PUNCT = ta._table(lambda b: 0x21 <= b <= 0x7E and not chr(b).isalnum())
OTHER = ta._table(lambda b: b >= 0x80)
POINT = ta._table(lambda b: b & 0xC0 != 0x80)  # first byte of a code point


def per_row(flags: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """Number of set flags of each row's bytes."""
    c = np.concatenate([[0], np.cumsum(flags, dtype=np.int64)])
    return c[offs[1:]] - c[offs[:-1]]


def repeated(h: np.ndarray, row: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(occurs twice or more in its row, is not its first occurrence) for each hash."""
    with np.errstate(over="ignore"):
        key = ta.mix(h + (row.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15))
    order = np.argsort(key, kind="stable")
    s = key[order]
    same = s[1:] == s[:-1]
    later, any_ = np.zeros(len(h), bool), np.zeros(len(h), bool)
    later[order[1:]] = same
    any_[order[1:]] |= same
    any_[order[:-1]] |= same
    return any_, later


def lines(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    r"""(start, end, row) of the \n-split lines of every row (an empty row has one empty line)."""
    nl = np.flatnonzero(data == 10)
    row_of_nl = np.searchsorted(offs, nl, side="right") - 1
    start = np.concatenate([offs[:-1], nl + 1])
    end = np.concatenate([offs[1:], nl])
    row_s = np.concatenate([np.arange(len(offs) - 1), row_of_nl])
    # starts and ends of a row's lines pair up in order
    a = np.lexsort((start, row_s))
    b = np.lexsort((end, row_s))
    return start[a], end[b], row_s[a]


def base(data: np.ndarray, offs: np.ndarray) -> tuple[ta.Words, dict[str, np.ndarray]]:
    """Words, and counts per row: words, characters in words, symbols, repeated lines and words."""
    n = len(offs) - 1
    w = ta.words(data, offs, ta.SPACED)
    out = {"n_words": w.count.astype(np.int64),
           "word_chars": per_row(ta.SPACED[data] & POINT[data], offs),
           "n_symbols": per_row(SYMBOLS[data], offs)}
    s, e, r = lines(data, offs)
    full = np.searchsorted(w.start, e) > np.searchsorted(w.start, s)  # has a word
    s, e, r = s[full], e[full], r[full]
    _, later = repeated(ta.byte_hashes(data, s, e), r)
    out["n_lines"] = np.bincount(r, minlength=n)
    out["n_dup_lines"] = np.bincount(r[later], minlength=n)
    at = ta.inside(w, 3)
    twice, _ = repeated(ta.ngrams(w.hash, 3)[at], w.row[at])
    at = at[twice]
    cover = np.zeros(len(w.row), bool)
    for k in range(3):
        cover[at + k] = True
    out["n_repeat_words"] = np.bincount(w.row[cover], minlength=n)
    return w, out


FEATURES = ("log_words", "word_length", "symbol_share", "upper_share", "digit_share", "punct_share", "other_share",
            "dup_lines", "repeat_words", "distinct_words", "line_words", "short_words", "long_words", "same_next",
            "symbol_ends")


def features(data: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """Matrix (rows, FEATURES) of document statistics; a text without words is all zeros."""
    w, b = base(data, offs)
    n = len(offs) - 1
    size = np.maximum(np.diff(offs), 1)
    count = np.maximum(w.count, 1)
    length = w.end - w.start
    _, later = repeated(w.hash, w.row)
    by_row = lambda flags: np.bincount(w.row[flags], minlength=n)
    nxt = np.zeros(len(w.row), bool)
    nxt[1:] = (w.hash[1:] == w.hash[:-1]) & (w.row[1:] == w.row[:-1])
    letters = np.maximum(per_row(LETTER[data], offs), 1)
    m = np.stack([
        np.log1p(w.count), b["word_chars"] / count, b["n_symbols"] / size, per_row(UPPER[data], offs) / letters,
        per_row(DIGIT[data], offs) / size, per_row(PUNCT[data], offs) / size, per_row(OTHER[data], offs) / size,
        b["n_dup_lines"] / np.maximum(b["n_lines"], 1), b["n_repeat_words"] / count, 1 - by_row(later) / count,
        np.log1p(w.count / np.maximum(b["n_lines"], 1)), by_row(length <= 3) / count, by_row(length >= 12) / count,
        by_row(nxt) / count, by_row(SYMBOLS[data[w.end - 1]] if len(w.end) else np.zeros(0, bool)) / count], axis=1)
    m[w.count == 0] = 0.0
    return m
