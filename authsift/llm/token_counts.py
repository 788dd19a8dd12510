"""Exact token counts of every prefix, by dynamic programming over a public BPE vocabulary.

For byte-pair encodings the last token of a prefix's encoding fixes all before it: a row
of tokens is the encoding of its text exactly if each neighbouring pair of tokens is the
encoding of that pair's own text.  So the last token of the prefix ending at i is the one
piece from k to i whose pair with the last token at k is such a *stable* pair, and

    count[i] = count[k] + 1.

One pass gives the count at every prefix, which answers "how many tokens up to here",
"how much text fits a budget" and "how many tokens between two places" by lookups.

The vocabulary is read from the public model file (its path is a parameter; the library
only lists its pieces here).  The pieces form a trie over code points; code points without
a piece count one token per UTF-8 byte.  No piece holds certain neighbours, such as a
letter before a space: merges never cross these places, so texts are cut there into
segments, and each distinct segment of a slice is solved once, all segments together
(those over ``LONG`` code points one by one).
Pair stability is found by merging the pair's symbols, best piece first and leftmost on
ties, and kept in a sorted table.

Memory: texts are worked on in slices of ``SLICE`` code points cut between segments; a
segment longer than that is solved whole (about 300 bytes per code point).  The tables of
segments and pairs are begun anew beyond ``CACHED`` entries, which changes no result.

Edge cases: null and empty texts have 0 tokens; strings of special tokens inside a text
are ordinary text, as in the library; repeated rows and null ids each get a row; very long
texts are worked on slice by slice; further columns and clashing names are ignored, since
only id and text are read; an empty table gives no rows.
"""
from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from authsift.llm.common import passed_through

LIMIT = 4096
SLICE = 1 << 20
CACHED = 1 << 20
LONG = 256
_SPACE = "▁"  # stands for a space in pieces, and before each text
_NEVER = np.iinfo(np.int32).max


class Lookup:
    """A fixed map of int64 keys to int32 values, -1 where a key is absent."""

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        order = np.argsort(keys, kind="stable")
        self.keys = np.append(keys[order], np.iinfo(np.int64).max)
        self.values = np.append(values[order], -1).astype(np.int32)

    def __call__(self, keys: np.ndarray) -> np.ndarray:
        at = np.searchsorted(self.keys, keys)
        return np.where(self.keys[at] == keys, self.values[at], -1)


class Vocabulary:
    """Symbols of a sentencepiece BPE model: its pieces, and code points that occur only inside pieces."""

    def __init__(self, model: bytes):
        import sentencepiece
        sp = sentencepiece.SentencePieceProcessor(model_proto=model)
        listed = [k for k in range(sp.get_piece_size())
                  if not (sp.is_control(k) or sp.is_unknown(k) or sp.is_byte(k) or sp.is_unused(k))]
        names = [sp.id_to_piece(k) for k in listed]
        score = -np.array([sp.get_score(k) for k in listed])
        own = set(names)
        chars = sorted({c for x in names for c in x})
        names += [c for c in chars if c not in own]
        ids = {x: k for k, x in enumerate(names)}
        self.size, self.longest = len(names), max(map(len, names))
        self.rank = np.append(np.unique(score, return_inverse=True)[1], np.full(len(names) - len(listed), -1)).astype(np.int32)
        self.cost = np.array([1 if k < len(listed) else len(x.encode()) for k, x in enumerate(names)], np.int32)
        self.length = np.array([len(x) for x in names])
        self.letters = np.full((self.size, self.longest), -1, np.int32)  # the symbols of its code points
        splits = []
        for k, x in enumerate(names):
            self.letters[k, :len(x)] = [ids[c] for c in x]
            splits += [(ids[x[:c]], ids[x[c:]], k) for c in range(1, len(x)) if x[:c] in ids and x[c:] in ids]
        left, right, made = (np.array(x, np.int64) for x in zip(*splits))
        self.merge = Lookup(left * self.size + right, made)

        self.code = np.zeros(0x110000, np.int32)  # code point -> 1, 2, ...; 0: in no piece
        self.code[[ord(c) for c in chars]] = np.arange(1, len(chars) + 1)
        self.codes = len(chars) + 1
        self.near = np.zeros((self.codes, self.codes), bool)  # neighbours inside some piece
        nodes: dict[tuple[int, int], int] = {}
        ends: dict[int, int] = {}
        whole = self.encoded(self.letters)
        for k, x in enumerate(names):
            at, cs = 0, self.code[[ord(c) for c in x]].tolist()
            self.near[cs[:-1], cs[1:]] = True
            for c in cs:
                at = nodes.setdefault((at, c), len(nodes) + 1)
            if whole[k, 0] == k:  # else merges never reach the piece
                ends[at] = k
        keys = np.array(list(nodes), np.int64)
        self.trie = Lookup(keys[:, 0] * self.codes + keys[:, 1], np.array(list(nodes.values())))
        self.ends = np.full(len(nodes) + 1, -1, np.int32)
        self.ends[list(ends)] = list(ends.values())

    def joined(self, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The piece that neighbours a, b merge into and its rank (-1 and _NEVER without one)."""
        made = np.where((a < 0) | (b < 0), -1, self.merge(a.astype(np.int64) * self.size + b))
        return made, np.where(made < 0, _NEVER, self.rank[made])

    def encoded(self, symbols: np.ndarray) -> np.ndarray:
        """Each row of symbols (-1 behind the last) merged to the end, best piece first, leftmost on ties."""
        out, rows = symbols.copy(), np.arange(len(symbols))
        made, rank = self.joined(symbols[:, :-1], symbols[:, 1:])
        s = symbols.copy()
        while len(rows):
            best = rank.argmin(axis=1)
            go = rank[np.arange(len(rows)), best] < _NEVER
            out[rows[~go]] = s[~go]
            rows, s, made, rank, best = rows[go], s[go], made[go], rank[go], best[go]
            at = np.arange(len(rows))
            s[at, best] = made[at, best]
            s[:, :-1] = np.where(np.arange(s.shape[1] - 1) > best[:, None], s[:, 1:], s[:, :-1])  # close the gap
            s[:, -1] = -1
            for x, none in ((made, -1), (rank, _NEVER)):
                x[:, :-1] = np.where(np.arange(x.shape[1] - 1) > best[:, None], x[:, 1:], x[:, :-1])
                x[:, -1] = none
            for side in (best - 1, best):  # the two pairs of the new symbol
                k = np.flatnonzero((side >= 0) & (side < made.shape[1]))
                made[k, side[k]], rank[k, side[k]] = self.joined(s[k, side[k]], s[k, side[k] + 1])
        return out

    def stable(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether the text of tokens a, b is encoded as just a, b."""
        width = int((self.length[a] + self.length[b]).max(initial=2))
        both = np.full((len(a), 2 * self.longest), -1, np.int32)
        both[:, :self.longest] = self.letters[a]
        np.put_along_axis(both, self.length[a][:, None] + np.arange(self.longest), self.letters[b], axis=1)
        out = self.encoded(both[:, :width])
        return (out[:, 0] == a) & (out[:, 1] == b)  # of equal length, so nothing stands behind

    def bounds(self, points: np.ndarray) -> np.ndarray:
        """Per code point: whether merges never reach over from the one before it (the first: True)."""
        c = self.code[points]
        out = np.ones(len(c), bool)
        out[1:] = ~self.near[c[:-1], c[1:]]
        return out


class Counter:
    """Prefix counts over one vocabulary, with tables of what was met."""

    def __init__(self, model: bytes):
        self.v = Vocabulary(model)
        self.pairs, self.is_stable = np.zeros(0, np.int64), np.zeros(0, bool)
        self.known: dict[bytes, int] = {}

    def stable(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        key, back = np.unique(a.astype(np.int64) * self.v.size + b, return_inverse=True)
        at = np.minimum(np.searchsorted(self.pairs, key), max(len(self.pairs) - 1, 0))
        known = self.pairs[at] == key if len(self.pairs) else np.zeros(len(key), bool)
        out = np.zeros(len(key), bool)
        out[known] = self.is_stable[at[known]]
        if not known.all():
            new = key[~known]
            got = np.concatenate([self.v.stable(p // self.v.size, p % self.v.size)
                                  for p in np.split(new, range(1 << 14, len(new), 1 << 14))])
            out[~known] = got
            if len(self.pairs) > CACHED:
                self.pairs, self.is_stable = self.pairs[:0], self.is_stable[:0]
            to = np.searchsorted(self.pairs, new)
            self.pairs, self.is_stable = np.insert(self.pairs, to, new), np.insert(self.is_stable, to, got)
        return out[back]

    def edges(self, codes: np.ndarray, left: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(place, length, token) of the pieces from every place, by walking the trie; ``left``: code points to the segment's end."""
        v = self.v
        at, node, found = np.arange(len(codes)), np.zeros(len(codes), np.int64), []
        for step in range(v.longest):
            node = v.trie(node * v.codes + codes[at + step])
            at, node = at[node >= 0], node[node >= 0]
            hit = v.ends[node] >= 0
            found.append((at[hit], np.full(hit.sum(), step + 1), v.ends[node[hit]]))
            on = left[at] > step + 1
            at, node = at[on], node[on].astype(np.int64)
        return tuple(np.concatenate(x) for x in zip(*found))

    def prefixes(self, points: np.ndarray, size: np.ndarray) -> np.ndarray:
        """Count at every prefix of segments that lie one behind the other in ``points``."""
        long = np.flatnonzero(size > LONG)
        if not len(long):
            return self._together(points, size)
        count, ends = np.empty(len(points), np.int32), np.cumsum(size)
        for k in long.tolist():
            count[ends[k] - size[k]:ends[k]] = self._one(points[ends[k] - size[k]:ends[k]])
        short = np.repeat(size <= LONG, size)
        count[short] = self._together(points[short], size[size <= LONG])
        return count

    def _together(self, points: np.ndarray, size: np.ndarray) -> np.ndarray:
        """Many short segments, all their first prefixes, then all their second ones, and so on."""
        v, n = self.v, len(points)
        codes = v.code[points].astype(np.int64)
        offset = np.arange(n) - np.repeat(np.cumsum(size) - size, size)
        last, count = np.full(n, -1, np.int32), np.zeros(n, np.int32)
        lone = np.flatnonzero(codes == 0)  # segments of their own: one token per byte
        p = points[lone].astype(np.int64)
        count[lone] = 1 + (p >= 0x80) + (p >= 0x800) + (p >= 0x10000)
        begin, width, token = self.edges(codes, np.repeat(size, size) - offset)
        stop = offset[begin] + width
        order = np.argsort(stop, kind="stable")
        begin, width, token, stop = begin[order], width[order], token[order], stop[order]
        ranges = np.searchsorted(stop, np.arange(1, int(size.max(initial=0)) + 2))
        for a, b in zip(ranges[:-1].tolist(), ranges[1:].tolist()):
            i, w, t = begin[a:b], width[a:b], token[a:b]
            ok = offset[i] == 0
            inner = np.flatnonzero(~ok)
            inner = inner[last[i[inner] - 1] >= 0]
            if len(inner):
                ok[inner] = self.stable(last[i[inner] - 1], t[inner])
            i, w, t = i[ok], w[ok], t[ok]
            last[i + w - 1] = t
            count[i + w - 1] = np.where(offset[i] == 0, 0, count[i - 1]) + v.cost[t]
        return count

    def _one(self, points: np.ndarray) -> np.ndarray:
        """One long segment, place by place; the pairs that may occur in a stretch are decided together before it."""
        v, n = self.v, len(points)
        begin, width, token = self.edges(v.code[points].astype(np.int64), n - np.arange(n))
        by_stop = np.argsort(begin + width, kind="stable")
        to_place = np.searchsorted((begin + width)[by_stop], np.arange(n + 2))
        last, count, cost = [-1] * n, [0] * n, v.cost.tolist()
        stretch = 1 << 12
        for lo in range(1, n + 1, stretch):
            hi = min(lo + stretch, n + 1)  # prefixes lo .. hi - 1
            right = by_stop[to_place[lo]:to_place[hi]]  # the pieces that end there, and those that end where they begin
            right = right[begin[right] > 0]
            a, b = to_place[begin[right]], to_place[begin[right] + 1]
            left = by_stop[np.repeat(a, b - a) + np.arange((b - a).sum()) - np.repeat(np.cumsum(b - a) - (b - a), b - a)]
            key = np.unique(token[left].astype(np.int64) * v.size + np.repeat(token[right], b - a))
            known = dict(zip(key.tolist(), self.stable(key // v.size, key % v.size).tolist()))
            at = by_stop[to_place[lo]:to_place[hi]]
            for i, w, t in zip(begin[at].tolist(), width[at].tolist(), token[at].tolist()):
                if i == 0 or last[i - 1] >= 0 and known[last[i - 1] * v.size + t]:
                    last[i + w - 1] = t
                    count[i + w - 1] = (count[i - 1] if i else 0) + cost[t]
        return np.array(count, np.int32)

    def totals(self, points: np.ndarray, first: np.ndarray) -> np.ndarray:
        """Tokens of each segment; equal ones are solved once."""
        size = np.diff(np.append(first, len(points)))
        offsets = np.append(first, len(points)).astype(np.int64) * 4
        coded = pa.LargeBinaryArray.from_buffers(
            pa.large_binary(), len(first), [None, pa.py_buffer(offsets), pa.py_buffer(points)]).dictionary_encode()
        distinct, which = coded.dictionary.to_pylist(), coded.indices.to_numpy()
        got = [self.known.get(x) for x in distinct]
        new = [k for k, x in enumerate(got) if x is None]
        if new:
            flat = np.frombuffer(b"".join(distinct[k] for k in new), np.uint32)
            lengths = np.array([len(distinct[k]) for k in new]) // 4
            solved = self.prefixes(flat, lengths)[np.cumsum(lengths) - 1].tolist()
            if len(self.known) > CACHED:
                self.known = {}
            for k, c in zip(new, solved):
                got[k] = self.known[distinct[k]] = c
        return np.array(got, np.int64)[which] if len(size) else np.zeros(0, np.int64)

    def fitting(self, points: np.ndarray, first: np.ndarray, totals: np.ndarray, budget: int) -> int:
        """Code points of the longest prefix with at most ``budget`` tokens."""
        before = np.cumsum(totals) - totals
        if before[-1] + totals[-1] <= budget:
            return len(points)
        k = int(np.searchsorted(before, budget, side="left")) - 1  # the last segment that begins below the budget
        end = int(first[k + 1]) if k + 1 < len(first) else len(points)
        inner = self.prefixes(points[first[k]:end], np.array([end - first[k]]))
        fit = np.flatnonzero((inner > 0) & (before[k] + inner <= budget))
        return int(first[k]) + (int(fit[-1]) + 1 if len(fit) else 0)


def _points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "replace"), np.uint32)


def slices(texts: list[str], v: Vocabulary, size: int) -> Iterator[tuple[list[int], np.ndarray, np.ndarray, np.ndarray]]:
    """(rows, code points, ends of the rows' parts, segment starts): whole small texts together, long ones in parts.

    Every text begins with the space mark; a part ends between segments.
    """
    rows, parts, held = [], [], 0

    def made():
        points = np.concatenate(parts)
        ends = np.cumsum([len(p) for p in parts])
        cut = v.bounds(points)
        cut[ends[:-1]] = True
        return rows, points, ends, np.flatnonzero(cut)

    for row, t in enumerate(texts):
        if not t:
            continue
        t = _SPACE + t.replace(" ", _SPACE)
        while t:
            reach = size
            points = _points(t[:reach])
            cut = len(points)
            while len(points) < len(t):
                inner = np.flatnonzero(v.bounds(points)[1:])
                if len(inner):
                    cut = int(inner[-1]) + 1
                    break
                reach *= 2
                points = _points(t[:reach])
                cut = len(points)
            rows.append(row), parts.append(points[:cut])
            t = t[cut:]
            held += cut
            if held >= size:
                yield made()
                rows, parts, held = [], [], 0
    if parts:
        yield made()


def _model(spark, model: str) -> bytes:
    """The model file's bytes, read by the driver from a local path or one that only Spark reads; of vocabulary size."""
    import os
    if os.path.exists(model):
        with open(model, "rb") as f:
            return f.read()
    return bytes(spark.read.format("binaryFile").load(model).select("content").first()["content"])


def counts(docs: DataFrame, model: str, limit: int = LIMIT, text: str = "text", id_col: str = "doc_id") -> DataFrame:
    """Per row: doc_id, n_bytes, n_tokens, over_limit, and fit_chars: code points of the longest prefix within the limit."""
    chosen = docs.select(F.col(id_col).alias("doc_id"), F.col(text).alias("t"))
    schema = passed_through(chosen.select("doc_id"), "n_bytes bigint, n_tokens bigint, over_limit boolean, fit_chars bigint")
    shared = docs.sparkSession.sparkContext.broadcast(_model(docs.sparkSession, model))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = Counter(shared.value)
        for b in batches:
            raw = [x.as_py() or b"" for x in b.column(1).cast(pa.large_binary())]
            tokens, fit, done = (np.zeros(len(raw), np.int64) for _ in range(3))
            for rows, points, ends, first in slices([x.decode("utf-8", "replace") for x in raw], counter.v, SLICE):
                totals = counter.totals(points, first)
                at = np.searchsorted(first, np.append(0, ends))
                sums = np.append(0, np.cumsum(totals))
                for row, p, q, lo, hi in zip(rows, np.append(0, ends), ends, at, at[1:]):
                    if tokens[row] < limit:  # so far every token fits
                        fit[row] = done[row] + counter.fitting(points[p:q], first[lo:hi] - p, totals[lo:hi], limit - tokens[row])
                    tokens[row] += sums[hi] - sums[lo]
                    done[row] += q - p
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array([len(x) for x in raw], pa.int64()), pa.array(tokens), pa.array(tokens > limit),
                 pa.array(np.maximum(fit - 1, 0))], names=schema.names)

    return chosen.mapInArrow(run, schema)


def stored(docs: DataFrame, model: str, text: str = "text", name: str = "prefix_tokens") -> DataFrame:
    """``docs`` with the count at every prefix (element p: tokens of the first p code points) in the new column ``name``."""
    if name in docs.columns:
        raise ValueError(f"the table already has a column {name}")
    at = docs.columns.index(text)
    schema = passed_through(docs, f"`{name}` array<int>")
    shared = docs.sparkSession.sparkContext.broadcast(_model(docs.sparkSession, model))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = Counter(shared.value)
        for b in batches:
            texts = [(x.as_py() or b"").decode("utf-8", "replace") for x in b.column(at).cast(pa.large_binary())]
            out: list[list[np.ndarray]] = [[] for _ in texts]
            so_far = np.zeros(len(texts), np.int64)
            for rows, points, ends, first in slices(texts, counter.v, SLICE):
                size = np.diff(np.append(first, len(points)))
                inner = counter.prefixes(points, size)
                totals = inner[first + size - 1].astype(np.int64)
                running = inner + np.repeat(np.cumsum(totals) - totals, size)
                begin = 0
                for row, end in zip(rows, ends.tolist()):
                    part = running[begin:end] - (running[begin - 1] if begin else 0) + so_far[row]
                    so_far[row] = part[-1]
                    out[row].append(part)
                    begin = end
            flat = [np.concatenate(x)[1:] if x else np.zeros(0, np.int64) for x in out]
            offsets = np.append(0, np.cumsum([len(x) for x in flat])).astype(np.int32)
            values = pa.array(np.concatenate(flat) if flat else np.zeros(0, np.int64), pa.int64()).cast(pa.int32())
            yield pa.RecordBatch.from_arrays([*b.columns, pa.ListArray.from_arrays(offsets, values)], names=schema.names)

    return docs.mapInArrow(run, schema)


def fits(prefix_tokens: Column, budget: int) -> Column:
    """Code points of the longest stored prefix with at most ``budget`` tokens."""
    return F.aggregate(F.transform(prefix_tokens, lambda x, k: F.when(x <= budget, k + 1).otherwise(0)), F.lit(0), lambda a, b: F.greatest(a, b))


def between(prefix_tokens: Column, start: Column, end: Column) -> Column:
    """Tokens that the prefix of ``end`` code points has more than the one of ``start`` (beyond the text: the whole text)."""
    upto = lambda p: F.coalesce(F.get(prefix_tokens, F.least(p, F.size(prefix_tokens)) - 1), F.lit(0))
    return upto(end) - upto(start)
