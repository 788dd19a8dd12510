"""Gated recurrent language model (GRU) with a class-factored softmax.

Tokens are the lower-cased words of a text, then one end token.  Spark counts the
tokens of all training documents.  The 2,047 most frequent of them, and one token
for all others, are the model's vocabulary, in 32 classes of 64 by frequency:
p(word) = p(class | state) p(word | class, state).  A token outside is the class's
stand-in times its smoothed share of the tokens outside, so the model is a
distribution over all words.

Training: every training document is learnt from once, in one of ``rounds`` rounds,
decided by the hash of its id (of its text, if the id is null).  In a round every
partition runs truncated back-propagation (windows of ``steps`` tokens, state carried
across windows, reset at a document's start) over the round's documents, from common
weights; Spark averages the partitions' weights by their tokens.  The start is the
unigram model, in the output biases.

With the counts known, the texts are read once more: a document becomes its model ids (2 bytes
a token) and its sums, which is all that training and scoring read.  Counts of at most 262,144
of the most frequent tokens are broadcast (4 MB, a fixed bound); the other tokens of a document
are joined to the table of all counts by Spark, once per distinct text.  Scoring carries the
state through whole documents.

Edge cases: null and empty texts are the end token alone; a null id counts as the
empty text for the fold; repeated rows each get a result; without training tokens
all counts are 0 and every token is outside the vocabulary; extra columns are
ignored; tokens that tie in count are ordered by hash; very long texts carry their state to the
end; an empty table gives an empty result.  Scores depend on how the training rows lie in
partitions, since each learns on its own before the average: the same files give the same
scores, other splits slightly other ones.
"""
from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from authsift.llm import textarrays as ta
from authsift.llm.common import crc_mod, passed_through, saved

FOLDS, HELD = 10, 0
CLASSES, PER = 32, 64
VOCABULARY = CLASSES * PER
FREQUENT = 1 << 18
HIDDEN, STEPS, STREAMS = 24, 16, 128
FEW = 32  # targets of a class that are worked on with those of other classes
ROUNDS, RATE = 4, 0.02
END = np.uint64(0)
"""Stands for the end token's hash."""
ALPHA = 0.1


def token_hashes(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hashes of all tokens, the end token after each row's words; token offsets per row)."""
    w = ta.words(ta.LOWER[data], offs, ta.SPACED)
    n = len(w.count)
    out = np.full(len(w.hash) + n, END, dtype=np.uint64)
    out[np.arange(len(w.hash)) + w.row] = w.hash
    return out, np.concatenate([[0], np.cumsum(w.count + 1)]).astype(np.int64)


def _merged(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    h, n = np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])
    u, code = np.unique(h, return_inverse=True)
    return u, np.bincount(code, weights=n, minlength=len(u)).astype(np.int64)


def token_counts(rows: DataFrame) -> DataFrame:
    """(h, c) over the training rows (id, t, held)."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts: list[tuple[np.ndarray, np.ndarray]] = []
        held = first = 0  # tokens in all parts, and in those merged so far

        def emit():
            u, n = parts.pop()
            return pa.RecordBatch.from_arrays([pa.array(u.view(np.int64)), pa.array(n)], names=["h", "c"])

        for b in batches:
            for _, _, data, offs in ta.slices(b.column(0), ta.SMALL_BYTES):
                parts.append(np.unique(token_hashes(data, offs)[0], return_counts=True))
                held += len(parts[-1][0])
                if held > max(2 * first, 1 << 19):
                    parts[:] = [_merged(parts)]
                    held = first = len(parts[0][0])
                    if held > 1 << 21:
                        yield emit()
                        held = first = 0
        if parts:
            parts[:] = [_merged(parts)]
            yield emit()

    return rows.where("not held").select("t").mapInArrow(count, "h bigint, c bigint").groupBy("h").agg(F.sum("c").alias("c"))


def vocabulary(hashes: np.ndarray, counts: np.ndarray, total: int, distinct: int) -> dict:
    """Lookup arrays from tokens in descending frequency; the last model id stands for all tokens outside."""
    order = np.argsort(hashes)
    top = hashes[:VOCABULARY - 1]
    by_hash = np.argsort(top)
    outside = total - int(counts[:VOCABULARY - 1].sum()) + ALPHA * (distinct - len(top) + 1)
    p = np.full(VOCABULARY, 1e-9)
    p[:len(top)] = counts[:len(top)]
    p[-1] = max(outside, ALPHA)
    return {"frequent": hashes[order], "count": counts[order], "top": top[by_hash], "id": by_hash.astype(np.int32),
            "outside": outside, "unigram": p / p.sum()}


def ids_of(v: dict, h: np.ndarray) -> np.ndarray:
    """Model ids of token hashes."""
    if not len(v["top"]):
        return np.full(len(h), VOCABULARY - 1, np.int32)
    at = np.minimum(np.searchsorted(v["top"], h), len(v["top"]) - 1)
    return np.where(v["top"][at] == h, v["id"][at], VOCABULARY - 1).astype(np.int32)


def counts_of(v: dict, h: np.ndarray) -> np.ndarray:
    """Counts of frequent tokens, 0 for the rest."""
    if not len(v["frequent"]):
        return np.zeros(len(h), np.int64)
    at = np.minimum(np.searchsorted(v["frequent"], h), len(v["frequent"]) - 1)
    return np.where(v["frequent"][at] == h, v["count"][at], 0)


def initial(v: dict, seed: int = 7) -> dict[str, np.ndarray]:
    rng = np.random.default_rng(seed)
    n = lambda *s: (rng.normal(size=s) * 0.1).astype(np.float32)
    p = v["unigram"].reshape(CLASSES, PER)
    return {"x": n(VOCABULARY, 3 * HIDDEN), "u": n(HIDDEN, 3 * HIDDEN), "b": np.zeros(3 * HIDDEN, np.float32),
            "c": n(HIDDEN, CLASSES) * 0, "cb": np.log(p.sum(axis=1)).astype(np.float32),
            "w": n(CLASSES, HIDDEN, PER) * 0, "wb": np.log(p / p.sum(axis=1, keepdims=True)).astype(np.float32)}


def _gates(m: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """x, u and b with the gates r, z and the candidate n as the first axis, each a block of its own."""
    return (np.ascontiguousarray(m["x"].reshape(-1, 3, HIDDEN).swapaxes(0, 1)),
            np.ascontiguousarray(m["u"].reshape(HIDDEN, 3, HIDDEN).swapaxes(0, 1)), m["b"].reshape(3, 1, HIDDEN).copy())


def step(x: np.ndarray, u: np.ndarray, h: np.ndarray, inner: np.ndarray | None = None, out: np.ndarray | None = None) -> np.ndarray:
    """One GRU step for a batch: the new state, from the inputs ``x`` (3, batch, HIDDEN) of r, z and n, which become
    their values; ``inner`` gets the candidate's recurrent part."""
    g = np.matmul(h, u)
    gates, n = x[:2], x[2]
    gates += g[:2]
    np.negative(gates, out=gates)
    np.exp(gates, out=gates)
    gates += 1
    np.reciprocal(gates, out=gates)
    if inner is not None:
        inner[...] = g[2]
    g[2] *= gates[0]
    n += g[2]
    np.tanh(n, out=n)
    out = np.subtract(h, n, out=out)
    out *= gates[1]
    out += n
    return out


def _plain(m: dict, size: float = 1.0) -> tuple[bool, np.ndarray]:
    """Whether exp of the logits of states within -size..size needs no shift: for the classes, and within each."""
    def fits(w, b):
        reach = size * np.abs(w).sum(axis=-2)
        return ((b + reach).max(axis=-1) < 60) & ((b - reach).max(axis=-1) > -60)
    return bool(fits(m["c"], m["cb"])), fits(m["w"], m["wb"])


def _logits(h: np.ndarray, w: np.ndarray, b: np.ndarray, plain: bool) -> np.ndarray:
    x = h @ w
    x += b
    if not plain:
        x -= x.max(axis=-1, keepdims=True)
    return x


def _log_soft_at(h: np.ndarray, w: np.ndarray, b: np.ndarray, at: np.ndarray, plain: bool) -> np.ndarray:
    """Log of the softmax of h @ w + b at ``at``."""
    x = _logits(h, w, b, plain)
    out = x.ravel()[at + np.arange(0, x.size, x.shape[1])]
    out -= np.log(np.exp(x, out=x) @ np.ones(x.shape[1], x.dtype))
    return out


def _by_class(target: np.ndarray) -> tuple[np.ndarray, list[tuple[int, int, int]], tuple[np.ndarray, np.ndarray, slice, int]]:
    """(order of the targets, (class, from, to) in it of the classes of many targets, the others together).

    These are (classes, class of each target as an index into them, place in the order, greatest number).
    """
    cls = (target // PER).astype(np.uint8)
    count = np.bincount(cls, minlength=CLASSES)
    few = (count > 0) & (count <= FEW)
    order = np.argsort(np.where(few, np.arange(CLASSES), np.arange(CLASSES) + CLASSES).astype(np.uint8)[cls], kind="stable")
    some = np.flatnonzero(few)
    at = int(count[some].sum())
    many = []
    for c in np.flatnonzero(count > FEW).tolist():
        many.append((c, at, at + int(count[c])))
        at = many[-1][2]
    which = np.repeat(np.arange(len(some)), count[some])
    return order, many, (some, which, slice(0, len(which)), int(count[some].max(initial=0)))


def _padded(h: np.ndarray, which: np.ndarray, n: int, most: int) -> tuple[np.ndarray, np.ndarray]:
    """(n, most, HIDDEN) with the rows of each class, zeros behind them; place of each row in its class."""
    place = np.arange(len(which)) - np.searchsorted(which, which)
    out = np.zeros((n, most, h.shape[1]), h.dtype)
    out[which, place] = h
    return out, place


def log_softmax_at(m: dict, h: np.ndarray, target: np.ndarray, grad: dict | None = None, plain: tuple | None = None
                   ) -> tuple[np.ndarray, np.ndarray | None]:
    """Natural log p(target | state) by class, then within the class; adds to ``grad`` and returns dh if asked."""
    first, within = plain or _plain(m, float(np.abs(h).max(initial=1)))
    order, many, (some, which, these, most) = _by_class(target)
    out = _log_soft_at(h, m["c"], m["cb"], target // PER, first)
    mine, word = h[order], (target % PER)[order]
    inner = np.empty_like(out)
    if most:
        rows, place = _padded(mine[these], which, len(some), most)
        x = _logits(rows, m["w"][some], m["wb"][some, None], within[some].all())
        inner[these] = x[which, place, word[these]]
        inner[these] -= np.log(np.exp(x, out=x).sum(axis=2)[which, place])
    for c, a, e in many:
        inner[a:e] = _log_soft_at(mine[a:e], m["w"][c], m["wb"][c], word[a:e], within[c])
    out[order] += inner
    return out, None if grad is None else softmax_gradients(m, h, target, grad)


def softmax_gradients(m: dict, h: np.ndarray, target: np.ndarray, grad: dict) -> np.ndarray:
    """Adds the gradients of -log p(target | state) to ``grad``; returns dh."""
    first, within = _plain(m, float(np.abs(h).max(initial=1)))

    def shares(h, w, b, plain):
        p = _logits(h, w, b, plain)
        np.exp(p, out=p)
        p /= p @ np.ones((p.shape[-1], 1), p.dtype)
        return p

    def back(h, w, b, at, plain, gw, gb):
        p = shares(h, w, b, plain)
        p.ravel()[at + np.arange(0, p.size, p.shape[1])] -= 1
        gw += h.T @ p
        gb += np.ones(len(p), p.dtype) @ p
        return p @ w.T

    order, many, (some, which, these, most) = _by_class(target)
    dh = back(h, m["c"], m["cb"], target // PER, first, grad["c"], grad["cb"])
    mine, word = h[order], (target % PER)[order]
    inner = np.empty_like(mine)
    if most:
        rows, place = _padded(mine[these], which, len(some), most)
        w = m["w"][some]
        p = shares(rows, w, m["wb"][some, None], within[some].all())
        p[which, place, word[these]] -= 1
        real = np.zeros((len(some), 1, most), p.dtype)
        real[which, 0, place] = 1
        grad["w"][some] += np.matmul(rows.swapaxes(1, 2), p)
        grad["wb"][some] += np.matmul(real, p)[:, 0]
        inner[these] = np.matmul(p, w.swapaxes(1, 2))[which, place]
    for c, a, e in many:
        inner[a:e] = back(mine[a:e], m["w"][c], m["wb"][c], word[a:e], within[c], grad["w"][c], grad["wb"][c])
    dh[order] += inner
    return dh


def _add_rows(table: np.ndarray, ids: np.ndarray, rows: np.ndarray) -> None:
    """table[:, ids] += rows, with repeated ids summed first; the last id, nearly half of all tokens, by a product."""
    last = ids == table.shape[1] - 1
    table[:, -1] += last.astype(rows.dtype) @ rows
    count = np.bincount(ids, minlength=table.shape[1])
    at = np.flatnonzero((count[ids] == 1) & ~last)
    table[:, ids[at]] += np.take(rows, at, axis=1)
    at = np.flatnonzero((count[ids] > 1) & ~last)
    if len(at):
        at = at[np.argsort(ids[at].astype(np.uint16), kind="stable")]
        own = ids[at]
        first = np.flatnonzero(np.diff(own, prepend=-1))
        table[:, own[first]] += np.add.reduceat(np.take(rows, at, axis=1), first, axis=1)


def _views(flat: np.ndarray, shapes: list[tuple[str, tuple[int, ...]]]) -> dict[str, np.ndarray]:
    out, at = {}, 0
    for k, shape in shapes:
        n = int(np.prod(shape))
        out[k] = flat[at:at + n].reshape(shape)
        at += n
    return out


def train(m: dict, tokens: np.ndarray, fresh: np.ndarray, rate: float = RATE) -> dict:
    """Truncated back-propagation over one token sequence, cut into parallel streams; Adam.

    ``fresh`` marks the first token of a document: the state before it is zero and
    its input the end token.
    """
    streams = max(1, min(STREAMS, len(tokens) // (8 * STEPS)))
    length = -(-len(tokens) // streams)
    if not length:
        return {k: v.copy() for k, v in m.items()}
    room = streams * length - len(tokens)  # the last stream's end, which is no token
    t = np.pad(tokens, (0, room)).reshape(streams, length)
    new = np.pad(fresh, (0, room)).reshape(streams, length)
    new[:, 0] = True
    k = HIDDEN
    own = m | dict(zip("xub", _gates(m)))
    shapes = [(key, v.shape) for key, v in own.items()]
    flat = np.concatenate([v.ravel() for v in own.values()])
    slope, first, second = (np.zeros_like(flat) for _ in range(3))
    own, grad = _views(flat, shapes), _views(slope, shapes)
    block = 1 << 16
    spare = np.empty(block, flat.dtype)
    h = np.zeros((streams, k), np.float32)
    updates = -(-length // STEPS)
    for u in range(updates):
        lo, hi = u * STEPS, min(length, (u + 1) * STEPS)
        n = hi - lo
        go = np.ascontiguousarray(~new[:, lo:hi].T)
        ids = np.zeros((n, streams), np.int32)
        ids[1 if not lo else 0:] = t[:, max(lo - 1, 0):hi - 1].T
        ids *= go
        keep = go.astype(np.float32)[:, :, None]
        x = np.take(own["x"], ids, axis=1)
        x += own["b"][:, None]
        before, states, inner = (np.empty((n, streams, k), np.float32) for _ in range(3))
        for s in range(n):
            np.multiply(h, keep[s], out=before[s])
            h = step(x[:, s], own["u"], before[s], inner[s], states[s])
        r, z, cand = x
        target, flat_states = t[:, lo:hi].T.ravel(), states.reshape(-1, k)
        real = n * streams
        if room and hi > length - room:
            on = (np.arange(lo, hi)[:, None] + np.arange(streams) * length < len(tokens)).ravel()
            real = int(on.sum())
            dh = np.zeros_like(flat_states)
            dh[on] = softmax_gradients(own, flat_states[on], target[on], grad)
        else:
            dh = softmax_gradients(own, flat_states, target, grad)
        dh = dh.reshape(n, streams, k)
        da = np.empty((3, n, streams, k), np.float32)
        dg = np.empty((3, streams, k), np.float32)
        stay = 1 - z
        by_n = stay * (1 - cand * cand)
        by_z = (before - cand) * z * stay
        by_r = inner * r * (1 - r)
        turned = np.ascontiguousarray(own["u"].swapaxes(1, 2))
        back = np.zeros((streams, k), np.float32)
        for s in range(n - 1, -1, -1):
            d = dh[s]
            d += back
            dr, dz, dn = da[0, s], da[1, s], da[2, s]
            np.multiply(d, by_n[s], out=dn)
            np.multiply(d, by_z[s], out=dz)
            np.multiply(dn, by_r[s], out=dr)
            dg[0], dg[1] = dr, dz
            np.multiply(dn, r[s], out=dg[2])
            np.multiply(d, z[s], out=back)
            back += np.matmul(dg, turned).sum(axis=0)
            back *= keep[s]
        grad["b"] += da.sum(axis=(1, 2))[:, None]
        rows = da.reshape(3, -1, k)
        _add_rows(grad["x"], ids.ravel(), rows)
        da[2] *= r  # the candidate's recurrent part is behind the gate
        grad["u"] += np.matmul(before.reshape(-1, k).T, rows)
        scale = 1 / real
        norm = np.sqrt(float(slope @ slope)) * scale
        scale *= min(1.0, 1.0 / max(norm, 1e-9))
        lr = rate * (1 - 0.9 * u / updates)
        # Adam, with the means of 0.9 and 0.99 kept without their factors 0.1 and 0.01
        root = np.sqrt(0.01 / (1 - 0.99 ** (u + 1)))
        by = np.float32(0.1 * lr / (1 - 0.9 ** (u + 1)) / root)
        for a in range(0, len(flat), block):
            g, f, q = slope[a:a + block], first[a:a + block], second[a:a + block]
            w = spare[:len(g)]
            g *= np.float32(scale)
            f *= np.float32(0.9)
            f += g
            g *= g
            q *= np.float32(0.99)
            q += g
            np.sqrt(q, out=w)
            w += np.float32(1e-6 / root)
            np.divide(f, w, out=w)
            w *= by
            flat[a:a + block] -= w
            g.fill(0)
    flat_of = {"x": (-1, 3 * k), "u": (k, 3 * k), "b": (3 * k,)}
    return {key: v.swapaxes(0, 1).reshape(flat_of[key]) if key in flat_of else v for key, v in own.items()}


def document_logs(m: dict, ids: np.ndarray, offs: np.ndarray, group: int = 1024, window: int = 16) -> np.ndarray:
    """Natural log-likelihood of every document; the state is carried through all its tokens."""
    out = np.zeros(len(offs) - 1)
    size = np.diff(offs)
    order = np.argsort(-size, kind="stable")
    x, u, b = _gates(m)
    x += b
    plain = _plain(m)
    for lo in range(0, len(order), group):
        docs = order[lo:lo + group]
        length, start = size[docs], offs[docs]
        h = np.zeros((len(docs), HIDDEN), np.float32)
        previous = np.zeros(len(docs), np.int32)
        for at in range(0, int(length[0]) if len(length) else 0, window):
            states, targets = [], []
            end = min(at + window, int(length[0]))
            alive = np.searchsorted(-length, -np.arange(at, end)).tolist()  # lengths descend: documents longer than s
            for s, n in zip(range(at, end), alive):
                h = step(np.take(x, previous[:n], axis=1), u, h[:n])
                previous = ids[start[:n] + s]
                states.append(h)
                targets.append(previous)
            logs, _ = log_softmax_at(m, np.concatenate(states), np.concatenate(targets), plain=plain)
            out[docs[:alive[0]]] += np.bincount(np.concatenate([np.arange(n) for n in alive]), weights=logs, minlength=alive[0])
    return out


def frequent_from(counts: DataFrame, frequent: int = FREQUENT) -> int:
    """The least count at which at most ``frequent`` tokens are left: from the sizes of 16 classes per doubling."""
    cls = F.floor(F.log2("c") * 16).cast("int")
    sizes = sorted(counts.groupBy(cls.alias("k")).count().collect(), key=lambda r: -r["k"])  # at most 16 * 63 rows
    left, least = frequent, 1 << 62
    for r in sizes:
        left -= r["count"]
        if left < 0:
            break
        least = int(np.ceil(2 ** (r["k"] / 16) - 1e-9))
    return least


def _ids(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(model ids of all rows, token offsets per row) of a column of packed ids."""
    column = column.cast(pa.large_binary())
    _, offsets, data = column.buffers()
    offs = np.frombuffer(offsets, np.int64)[column.offset:column.offset + len(column) + 1]
    return np.frombuffer(data, np.uint8)[offs[0]:offs[-1]].view(np.uint16), (offs - offs[0]) // 2


def _coded(rows: DataFrame, v) -> DataFrame:
    """Rows (id, t, held, turn) -> id, held, turn, ids (packed model ids), key (of the text), n_tokens, the sums over tokens
    whose counts are broadcast, and rare: the others with their frequencies in the text.  Same partitions and order."""

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for a, e, data, offs in ta.slices(b.column(1), ta.SMALL_BYTES):
                h, o = token_hashes(data, offs)
                n = e - a
                u, each = np.unique(h, return_inverse=True)
                ids, c = ids_of(v.value, u), counts_of(v.value, u)
                logs = np.where(c > 0, np.log10(c + ALPHA), 0.0)
                ids, c, logs = ids[each], c[each], logs[each]
                row = np.repeat(np.arange(n), np.diff(o))
                out = ids == VOCABULARY - 1
                by = lambda w: np.bincount(row, weights=w, minlength=n)
                at = np.flatnonzero(c == 0)
                order = at[np.lexsort((h[at], row[at]))]
                new = np.ones(len(order), bool)
                new[1:] = (h[order][1:] != h[order][:-1]) | (row[order][1:] != row[order][:-1])
                first = np.flatnonzero(new)
                lists = np.searchsorted(row[order[first]], np.arange(n + 1)).astype(np.int32)
                rare = pa.StructArray.from_arrays([pa.array(h[order[first]].view(np.int64)),
                                                   pa.array(np.diff(np.append(first, len(order))).astype(np.int32))], names=["h", "tf"])
                packed = pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer((2 * o).astype(np.int32)), pa.py_buffer(ids.astype(np.uint16))])
                key = ta.byte_hashes(data, offs[:-1], offs[1:]).view(np.int64)
                yield pa.RecordBatch.from_arrays(
                    [*(b.column(k).slice(a, n) for k in (0, 2, 3)), packed, pa.array(key), pa.array(np.diff(o)), pa.array(by(c > 0).astype(np.int64)),
                     pa.array(by(logs)), pa.array(by(np.where(out, logs, 0.0))), pa.array(by(out).astype(np.int64)),
                     pa.ListArray.from_arrays(pa.array(lists), rare)],
                    names=["id", "held", "turn", "ids", "key", "n_tokens", "known", "logs", "out_logs", "n_out", "rare"])

    schema = passed_through(rows.select("id", "held", "turn"), "ids binary, key bigint, n_tokens bigint, known bigint, logs double, "
                            "out_logs double, n_out bigint, rare array<struct<h: bigint, tf: int>>")
    return rows.select("id", "t", "held", "turn").mapInArrow(code, schema)


def _fit(rows: DataFrame, model: dict, rounds: int) -> dict:
    """Rounds of local training and averaging over coded rows."""
    sc = rows.sparkSession.sparkContext
    pieces = 16
    shapes = [(k, x.shape, x.size) for k, x in model.items()]
    for turn in range(rounds):
        now = sc.broadcast(model)

        def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            from pyspark import TaskContext
            tokens, fresh = [], []
            for b in batches:
                if b.num_rows:
                    ids, o = _ids(b.column(0))
                    first = np.zeros(len(ids), bool)
                    first[o[:-1]] = True
                    tokens.append(ids.copy())
                    fresh.append(first)
            n = sum(len(t) for t in tokens)
            if n:
                flat = train(now.value, np.concatenate(tokens), np.concatenate(fresh))
                flat = np.concatenate([flat[k].ravel() for k, _, _ in shapes]).astype(np.float64) * n
                cut = np.array_split(flat, pieces)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.arange(pieces, dtype=np.int32)), pa.array([TaskContext.get().partitionId() % 64] * pieces, pa.int32()),
                     pa.array([n] * pieces, pa.int64()), pa.array([c.tobytes() for c in cut], pa.binary())],
                    names=["piece", "part", "n", "sum"])

        def added(key, group):
            import pandas as pd
            total = np.sum([np.frombuffer(x) for x in sorted(group["sum"])], axis=0)
            return pd.DataFrame({"piece": [group["piece"].iloc[0]], "part": [0], "n": [group["n"].sum()], "sum": [total.tobytes()]})

        mine = rows.where("not held").where(F.col("turn") == turn).select("ids")
        schema = "piece int, part int, n bigint, sum binary"
        total = mine.mapInArrow(learn, schema)
        for keys in (["piece", "part"], ["piece"]):  # 64 partial sums, then one
            total = total.groupBy(*keys).applyInPandas(added, schema)
        got = sorted(total.collect(), key=lambda r: r["piece"])
        if got:
            flat = np.concatenate([np.frombuffer(r["sum"]) / r["n"] for r in got]).astype(np.float32)
            at, model = 0, {}
            for k, shape, size in shapes:
                model[k] = flat[at:at + size].reshape(shape)
                at += size
        now.unpersist()
    return model


def scores(docs: DataFrame, text: str = "text", id_col: str = "doc_id", folds: int = FOLDS, held: int = HELD,
           rounds: int = ROUNDS) -> DataFrame:
    """Per row: id, held_out, n_tokens, n_known, train_tokens, base_score, score."""
    sc = docs.sparkSession.sparkContext
    rows = docs.select(F.col(id_col).alias("id"), F.col(text).cast("string").alias("t"), (crc_mod(id_col, folds) == held).alias("held"))
    place = F.when(F.col("id").isNull(), F.xxhash64("t")).otherwise(F.xxhash64("id"))
    rows = rows.withColumn("turn", F.pmod(place, F.lit(rounds)).cast("int"))
    counts = saved(token_counts(rows))
    total = counts.agg(F.coalesce(F.sum("c"), F.lit(0)).alias("n"), F.count(F.lit(1)).alias("v")).first()
    top = counts.where(F.col("c") >= frequent_from(counts)).toPandas().sort_values(["c", "h"], ascending=[False, True])
    v = sc.broadcast(vocabulary(top["h"].to_numpy(np.int64).view(np.uint64), top["c"].to_numpy(np.int64), total["n"], total["v"]))
    coded = saved(_coded(rows, v))
    model = sc.broadcast(_fit(coded, initial(v.value), rounds))

    # tokens beyond the frequent ones, once per distinct text, joined to all counts
    found = coded.select("key", F.inline("rare")).dropDuplicates(["key", "h"])
    found = found.join(counts, "h", "left").groupBy("key").agg(
        F.sum(F.col("tf") * F.log10(F.coalesce("c", F.lit(0)) + F.lit(ALPHA))).alias("rare_log"),
        F.sum(F.when(F.col("c") > 0, F.col("tf")).otherwise(0)).alias("rare_known"))

    def rate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                gru = document_logs(model.value, *_ids(b.column(0))) / np.log(10)
                yield pa.RecordBatch.from_arrays([*b.columns[1:], pa.array(gru)], names=[*b.schema.names[1:], "gru"])

    sums = coded.select("id", "held", "key", "n_tokens", "known", "logs", "out_logs", "n_out")
    each = coded.select("ids", *sums.columns).mapInArrow(rate, passed_through(sums, "gru double")).join(found, "key", "left")
    rare_log = F.coalesce("rare_log", F.lit(0.0))
    n, distinct, outside = total["n"], total["v"], v.value["outside"]
    return each.select(
        F.col("id").alias(id_col), F.col("held").alias("held_out"), "n_tokens",
        (F.col("known") + F.coalesce("rare_known", F.lit(0))).cast("bigint").alias("n_known"), F.lit(n).cast("bigint").alias("train_tokens"),
        (F.col("logs") + rare_log - F.col("n_tokens") * F.lit(float(np.log10(n + ALPHA * (distinct + 1))))).alias("base_score"),
        (F.col("gru") + F.col("out_logs") + rare_log - F.col("n_out") * F.lit(float(np.log10(outside)))).alias("score"))
