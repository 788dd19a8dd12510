r"""Fill-in-middle transformation over content-defined chunks.

A text's units are the matches of `[A-Za-z]+|[^A-Za-z]`, left to right.  Two cuts, drawn
from the sha256 of the document's id, split it into prefix, middle and suffix at unit
bounds, and the three are rearranged behind the sentinels `<P>`, `<S>` and `<M>`.

Method: a rolling hash over the last ``WINDOW`` bytes ends a chunk wherever its top bits
are zero (about every ``2**CHUNK_BITS`` bytes), so equal passages give equal chunks
wherever they stand.  A chunk's boundary summary (units, code points, first and last
byte a letter) is computed once per distinct content and kept in a cache whose keys are
the chunk's own bytes, so a hit is verified by its content.  A document's units are the
sum of its chunks' units, less one for each letter run that goes on over a chunk bound;
running sums find the chunk of each cut, and only that chunk is read again.

Memory: texts are worked on in windows of ``textarrays.SLICE_BYTES``; the cache holds at most
``CACHE_BYTES`` of chunks and is then begun anew (chunks over ``LONGEST`` bytes are not
kept), which changes no result.

Edge cases: a null text is empty; empty texts and texts with a sentinel are plain; a
null id draws from the text `1:`; repeated rows and equal ids each get a row (the same
cuts for the same id); very long texts need memory for the text, its output and 24 bytes
per chunk; columns named like the results are ignored, since only id and text are read;
an empty table gives no rows.
"""
from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from authsift.llm import textarrays as ta
from authsift.llm.common import passed_through, with_columns

PREFIX, SUFFIX, MIDDLE = b"<P>", b"<S>", b"<M>"
PLAIN_FROM = 90
"""Of 100 documents, those from here on stay plain."""
SPM_BELOW = 20
"""Of 100 transformed documents, those below come as suffix, prefix, middle."""
WINDOW = 32
CHUNK_BITS = 8
LONGEST = 1 << 13
CACHE_BYTES = 1 << 25

_LETTER = np.array([65 <= b <= 90 or 97 <= b <= 122 for b in range(256)])
_HEAD = np.array([b & 0xC0 != 0x80 for b in range(256)])  # first bytes of code points
_SPREAD = ta.mix(np.arange(1, 257, dtype=np.uint64)).astype(np.uint32)
_ROLL = 0x9E3779B1


def chunk_ends(data: np.ndarray) -> np.ndarray:
    """Where chunks of one text end: the hash of the last WINDOW bytes has CHUNK_BITS zero bits on top.

    A chunk never ends inside a code point; the last one ends with the text.
    """
    found, step = [], ta.SLICE_BYTES
    for a in range(0, len(data), step):
        lead = min(a, WINDOW - 1)
        part = data[a - lead:a + step]
        h = _SPREAD[part]
        with np.errstate(over="ignore"):
            reach, factor = 1, _ROLL
            while reach < WINDOW:
                h[reach:] += h[:-reach] * np.uint32(factor) if reach < len(h) else 0
                reach, factor = 2 * reach, factor * factor & 0xFFFFFFFF
        at = np.flatnonzero(h[lead:] >> np.uint32(32 - CHUNK_BITS) == 0) + a + 1
        at = at[(at >= WINDOW) & (at < len(data))]
        found.append(at[_HEAD[data[at]]])
    return np.append(np.concatenate(found) if found else np.zeros(0, np.int64), len(data))


def unit_starts(data: np.ndarray) -> np.ndarray:
    """Offsets at which units of the bytes begin, a letter at their very start included."""
    letter = _LETTER[data]
    new = _HEAD[data]
    new[1:] &= ~(letter[1:] & letter[:-1])
    return np.flatnonzero(new)


def summaries(chunks: list[bytes]) -> list[tuple[int, int, bool, bool]]:
    """(units, code points, begins with a letter, ends with a letter) of each non-empty chunk."""
    data = np.frombuffer(b"".join(chunks), dtype=np.uint8)
    size = np.fromiter(map(len, chunks), np.int64, len(chunks))
    first = np.cumsum(size) - size
    letter, head = _LETTER[data], _HEAD[data]
    new = head.copy()
    new[1:] &= ~(letter[1:] & letter[:-1])
    new[first] = True
    return list(zip(np.add.reduceat(new.astype(np.int64), first).tolist(),
                    np.add.reduceat(head.astype(np.int64), first).tolist(),
                    letter[first].tolist(), letter[first + size - 1].tolist()))


class Chunks:
    """Boundary summaries by chunk content."""

    def __init__(self):
        self.known: dict[bytes, tuple[int, int, bool, bool]] = {}
        self.held = 0

    def of(self, text: bytes, ends: np.ndarray) -> np.ndarray:
        """One row (units, code points, begins, ends with a letter) for each chunk of the text."""
        pieces = [text[a:b] for a, b in zip([0, *ends[:-1].tolist()], ends.tolist())]
        new = list({p for p in pieces if p not in self.known})
        now = dict(zip(new, summaries(new))) if new else {}
        out = np.array([self.known[p] if p in self.known else now[p] for p in pieces], dtype=np.int64)
        for p, s in now.items():
            if len(p) <= LONGEST:
                self.known[p] = s
                self.held += len(p)
        if self.held > CACHE_BYTES:
            self.known, self.held = {}, 0
        return out


class Cuts:
    """A text's units, counted and located from its chunks."""

    def __init__(self, text: bytes, chunks: Chunks):
        self.text = text
        data = np.frombuffer(text, dtype=np.uint8)
        if not len(data):
            self.ends, self.units, self.chars = (np.zeros(1, np.int64) for _ in range(3))
            self.joined = np.zeros(0, bool)
            return
        ends = chunk_ends(data)
        s = chunks.of(text, ends)
        self.joined = np.append(False, (s[1:, 2] & s[:-1, 3]) != 0)  # its first letters belong to a unit before
        self.ends = np.append(0, ends)
        self.units = np.append(0, np.cumsum(s[:, 0] - self.joined))
        self.chars = np.append(0, np.cumsum(s[:, 1]))

    @property
    def n(self) -> int:
        return int(self.units[-1])

    def at(self, k: int) -> tuple[int, int]:
        """(byte, code point) at which unit ``k`` begins; unit n is the end of the text."""
        if k >= self.n:
            return int(self.ends[-1]), int(self.chars[-1])
        c = int(np.searchsorted(self.units, k, side="right")) - 1
        a = int(self.ends[c])
        piece = np.frombuffer(self.text, dtype=np.uint8)[a:int(self.ends[c + 1])]
        inner = int(unit_starts(piece)[k - self.units[c] + self.joined[c]])
        return a + inner, int(self.chars[c]) + int(_HEAD[piece[:inner]].sum())


def draws(doc_id) -> list[int]:
    """h1 to h4: the first four 8-digit groups of the sha256 of `1:` and the id."""
    d = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).digest()
    return [int.from_bytes(d[4 * k:4 * k + 4], "big") for k in range(4)]


def arranged(text: bytes, doc_id, chunks: Chunks) -> tuple[bytes, str, int, int | None, int | None]:
    """(output, form, n, code points of the prefix, of the middle) of one document."""
    cuts = Cuts(text, chunks)
    h = draws(doc_id)
    if not text or any(s in text for s in (PREFIX, SUFFIX, MIDDLE)) or h[2] % 100 >= PLAIN_FROM:
        return text, "plain", cuts.n, None, None
    (a, ca), (b, cb) = (cuts.at(k) for k in sorted((h[0] % (cuts.n + 1), h[1] % (cuts.n + 1))))
    head, middle, tail = text[:a], text[a:b], text[b:]
    if h[3] % 100 < SPM_BELOW:
        return b"".join((SUFFIX, tail, PREFIX, head, MIDDLE, middle)), "spm", cuts.n, ca, cb - ca
    return b"".join((PREFIX, head, SUFFIX, tail, MIDDLE, middle)), "psm", cuts.n, ca, cb - ca


def restored(output: bytes, form: str) -> bytes:
    """The text of an output, from the output and its form alone."""
    if form == "plain":
        return output
    first, second = (SUFFIX, PREFIX) if form == "spm" else (PREFIX, SUFFIX)
    one, _, rest = output[len(first):].partition(second)
    two, _, middle = rest.partition(MIDDLE)
    return two + middle + one if form == "spm" else one + middle + two


def _long(values: list) -> pa.Array:
    return pa.array(values, pa.int64())


def _texts(column: pa.Array) -> Iterator[bytes]:
    for value in column.cast(pa.large_binary()):
        yield value.as_py() or b""


def transformed(docs: DataFrame, text: str = "text", id_col: str = "doc_id", form: str = "fim_form") -> DataFrame:
    """``docs`` with each text rearranged, and its form in a new column ``form`` (it must not exist yet)."""
    if form in docs.columns:
        raise ValueError(f"the table already has a column {form}")
    at, ids = docs.columns.index(text), docs.columns.index(id_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunks = Chunks()
        for b in batches:
            out = [arranged(t, i, chunks) for t, i in zip(_texts(b.column(at)), b.column(ids).to_pylist())]
            columns = list(b.columns)
            columns[at] = pa.array([o.decode() for o, *_ in out], b.schema.field(at).type)
            yield with_columns(pa.RecordBatch.from_arrays(columns, names=b.schema.names),
                               **{form: pa.array([f for _, f, *_ in out], pa.string())})

    return docs.mapInArrow(run, passed_through(docs, f"`{form}` string"))


def digest(docs: DataFrame, text: str = "text", id_col: str = "doc_id") -> DataFrame:
    """Per document: n, form, prefix_chars, middle_chars, and the digests of output and restored text."""
    chosen = docs.select(F.col(id_col).alias("doc_id"), F.col(text).alias("t"))
    schema = passed_through(chosen.select("doc_id"), "n bigint, form string, prefix_chars bigint, middle_chars bigint, "
                            "output_sha256 string, restored_sha256 string")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunks = Chunks()
        for b in batches:
            rows = []
            for t, i in zip(_texts(b.column(1)), b.column(0).to_pylist()):
                output, form, n, head, middle = arranged(t, i, chunks)
                rows.append((n, form, head, middle, hashlib.sha256(output).hexdigest(),
                             hashlib.sha256(restored(output, form)).hexdigest()))
            n, form, head, middle, out, back = zip(*rows) if rows else ((),) * 6
            yield pa.RecordBatch.from_arrays(
                [b.column(0), _long(n), pa.array(form, pa.string()), _long(head), _long(middle),
                 pa.array(out, pa.string()), pa.array(back, pa.string())], names=schema.names)

    return chosen.mapInArrow(run, schema)
