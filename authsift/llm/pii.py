r"""Personal data: base patterns, and a character BiLSTM with CRF transitions.

Base kinds, leftmost and non-overlapping each: ``email``, ``ip`` (parts at most 255),
``card`` (14 to 19 digits passing Luhn), ``phone`` (``+``, 10 to 15 digits).  The
tagger adds spans the patterns miss: numbers without ``+``, other separators, IPv6,
addresses with blanks or other letters.

The tagger reads character classes in both directions (LSTM, 16 units each) and
scores B/I/O tags with learned CRF transitions.  It is trained in numpy, on the
driver, on labelled spans: windows of a bounded sample of documents
(``SAMPLE``; the rows with the smallest hash of their id), with their base spans and
with inserted, labelled examples and counter-examples (dates, versions, prices ...).

Texts are read in windows of 128 characters every 64.  Every span holds a digit or
an ``@``, so a window without either is all O by definition and isn't computed.
Each window is decoded (Viterbi); a span cut by a window's edge is left to the
window that holds it whole, and one that no window holds is decoded again in windows of
twice, four times ... the width around it, up to twice ``LONGEST``: longer spans
are not added.  Of all whole spans a document keeps the non-overlapping set with the
greatest total score (weighted interval scheduling).  Added spans must
pass their kind's own check (``plausible``) and overlap no base span.

Edge cases: null and empty texts have no spans (the hash is that of the empty
string); very long texts are read window by window, a slice of whole rows at a time; ties
between sets of spans go to the earlier one; repeated rows each get a result; extra columns are ignored or, in
``redacted``, passed on; an empty table trains on inserted examples alone and gives
an empty result.
"""
from __future__ import annotations

import bisect
import hashlib
import itertools
import random
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from authsift.llm import textarrays as ta
from authsift.llm.common import passed_through

KINDS = ("email", "ip", "card", "phone")
SAMPLE = 600
WINDOW, STRIDE = 128, 64
LONGEST = 1024
"""Added spans of up to so many characters are found wherever they start."""
HIDDEN, TRAIN_LENGTH, BATCH, UPDATES, RATE = 16, 80, 64, 400, 0.015
CLIP = 0.1
MIN_SCORE = 0.5
TAGS = 1 + 2 * len(KINDS)   # O, then B and I of each kind

# -- base patterns ------------------------------------------------------------
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")


def luhn(digits: str) -> bool:
    total = 0
    for k, d in enumerate(reversed(digits)):
        d = ord(d) - 48
        d = d * 2 if k % 2 else d
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def _digits(s: str) -> str:
    return "".join(c for c in s if "0" <= c <= "9")


def _emails(t: str) -> Iterator[tuple[int, int]]:
    """Goes from @ to @: the local part is the run before it that no earlier match took."""
    low, at = 0, t.find("@")
    while at >= 0:
        s = at
        while s > low and t[s - 1] in _LOCAL:
            s -= 1
        m = _DOMAIN.match(t, at + 1) if s < at else None
        if m:
            yield s, m.end()
            low = m.end()
        at = t.find("@", at + 1)


def base_spans(t: str, runs: list[tuple[int, int]]) -> list[tuple[int, int, int]]:
    """(start, kind index, end) of the base kinds; ``runs``: stretches of digits, blanks and ``+().-`` with a digit."""
    out = [(s, 0, e) for s, e in _emails(t)]
    for a, b in runs:
        part = t[a:b]
        for m in _IP.finditer(part):
            if all(int(x[-4:]) <= 255 and len(x.lstrip("0")) <= 3 for x in m.group().split(".")):
                out.append((a + m.start(), 1, a + m.end()))
        for m in _CARD.finditer(part):
            d = _digits(m.group())
            if 14 <= len(d) <= 19 and luhn(d):
                out.append((a + m.start(), 2, a + m.end()))
        for m in _PHONE.finditer(part):
            if 10 <= len(_digits(m.group())) <= 15:
                out.append((a + m.start(), 3, a + m.end()))
    return sorted(out)


# -- characters ---------------------------------------------------------------
def _classes() -> np.ndarray:
    c = np.full(128, 1, dtype=np.uint8)      # 0: beyond the text, 1: control
    c[[9, 32]] = 2
    c[10] = 3
    c[48:58] = 4
    c[65:91] = 5
    c[97:123] = 6
    for x in "abcdef":
        c[ord(x)] = 7
    c[ord("x")] = 8
    marks = [b for b in range(33, 127) if not chr(b).isalnum()]
    c[marks] = 10 + np.arange(len(marks))
    return c


CLASS = _classes()
N_CLASSES = int(CLASS.max()) + 1
IN_RUN = np.zeros(128, bool)
IN_RUN[[ord(x) for x in " ().+-0123456789"]] = True


def points(t: str) -> np.ndarray:
    return np.frombuffer(t.encode("utf-32-le"), np.uint32)


def codes(cp: np.ndarray) -> np.ndarray:
    return np.where(cp < 128, CLASS[np.minimum(cp, 127)], 9).astype(np.uint8)


def digit_runs(cp: np.ndarray) -> list[tuple[int, int]]:
    ok = (cp < 128) & IN_RUN[np.minimum(cp, 127)]
    edge = np.flatnonzero(np.diff(np.concatenate([[0], ok.astype(np.int8), [0]])))
    digits = np.concatenate([[0], np.cumsum((cp >= 48) & (cp <= 57))])
    s, e = edge[::2], edge[1::2]
    keep = digits[e] > digits[s]
    return list(zip(s[keep].tolist(), e[keep].tolist()))


# -- BiLSTM-CRF ---------------------------------------------------------------
def _sig(x):
    return 1 / (1 + np.exp(-x))


def lstm(table: np.ndarray, u: np.ndarray, x: np.ndarray, tape: list | None = None) -> np.ndarray:
    """States [T, B, H] of one direction; x: classes [T, B].  Class 0 holds no state."""
    n, k = x.shape[1], HIDDEN
    h, c = np.zeros((n, k), np.float32), np.zeros((n, k), np.float32)
    out = np.empty((len(x), n, k), np.float32)
    for t in range(len(x)):
        g = table[x[t]]
        g += h @ u
        f = _sig(g[:, :3 * k])
        i, o, fg = f[:, :k], f[:, k:2 * k], f[:, 2 * k:]
        a = np.tanh(g[:, 3 * k:])
        c0, h0 = c, h
        c = fg * c0 + i * a
        tc = np.tanh(c)
        h = o * tc
        gone = x[t] == 0
        if gone.any():
            h[gone] = 0
            c[gone] = 0
        out[t] = h
        if tape is not None:
            tape.append((i, o, fg, a, c0, h0, tc))
    return out


def lstm_back(u: np.ndarray, x: np.ndarray, tape: list, dout: np.ndarray, dtable: np.ndarray) -> np.ndarray:
    """Adds to ``dtable``; returns du."""
    du = np.zeros_like(u)
    dh, dc = np.zeros_like(dout[0]), np.zeros_like(dout[0])
    for t in range(len(x) - 1, -1, -1):
        i, o, fg, a, c0, h0, tc = tape[t]
        d = dout[t] + dh
        dc = dc + d * o * (1 - tc * tc)
        dg = np.concatenate([dc * a * i * (1 - i), d * tc * o * (1 - o), dc * c0 * fg * (1 - fg), dc * i * (1 - a * a)], axis=1)
        np.add.at(dtable, x[t], dg)
        du += h0.T @ dg
        dh = np.clip(dg @ u.T, -CLIP, CLIP)
        dc = np.clip(dc * fg, -CLIP, CLIP)
    return du


def _allowed() -> np.ndarray:
    """Transitions from row to column tag: I follows only B or I of its kind."""
    ok = np.ones((TAGS, TAGS), bool)
    for k in range(len(KINDS)):
        ok[:, 2 + 2 * k] = False
        ok[[1 + 2 * k, 2 + 2 * k], 2 + 2 * k] = True
    return ok


def initial(seed: int = 1) -> dict[str, np.ndarray]:
    rng = np.random.default_rng(seed)
    n = lambda *s: (rng.normal(size=s) * 0.3).astype(np.float32)
    m = {"xf": n(N_CLASSES, 4 * HIDDEN), "uf": n(HIDDEN, 4 * HIDDEN) / 2, "xb": n(N_CLASSES, 4 * HIDDEN), "ub": n(HIDDEN, 4 * HIDDEN) / 2,
         "e": n(2 * HIDDEN, TAGS), "eb": np.zeros(TAGS, np.float32), "t": np.zeros((TAGS, TAGS), np.float32)}
    for k in ("xf", "xb"):
        m[k][:, 2 * HIDDEN:3 * HIDDEN] += 1  # forget gates start open
    m["eb"][0] = 1
    return m


def emissions(m: dict, x: np.ndarray) -> np.ndarray:
    both = np.concatenate([lstm(m["xf"], m["uf"], x), lstm(m["xb"], m["ub"], x[::-1])[::-1]], axis=2)
    return both @ m["e"] + m["eb"]


_NEVER = np.float32(-1e4)


def _transitions(m: dict) -> np.ndarray:
    return np.where(_allowed(), m["t"], _NEVER)


def crf_gradients(em: np.ndarray, trans: np.ndarray, y: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
    """(mean negative log-likelihood, d emissions, d transitions) of gold tags y [T, B]."""
    steps, n, _ = em.shape
    start = np.where(np.arange(TAGS) % 2 == 0, _NEVER, 0)
    start[0] = 0
    lse = lambda v, axis: (lambda mx: mx.squeeze(axis) + np.log(np.exp(v - mx).sum(axis=axis)))(v.max(axis=axis, keepdims=True))
    alpha, beta = np.empty(em.shape), np.zeros(em.shape)
    alpha[0] = em[0] + start
    for t in range(1, steps):
        alpha[t] = em[t] + lse(alpha[t - 1][:, :, None] + trans[None], 1)
    for t in range(steps - 2, -1, -1):
        beta[t] = lse(trans[None] + (em[t + 1] + beta[t + 1])[:, None, :], 2)
    z = lse(alpha[-1], 1)
    d = np.exp(alpha + beta - z[None, :, None])
    dt = np.zeros_like(trans, dtype=np.float64)
    for t in range(1, steps):
        dt += np.exp(alpha[t - 1][:, :, None] + trans[None] + (em[t] + beta[t])[:, None, :] - z[:, None, None]).sum(axis=0)
    at = np.arange(n)
    gold = em[0][at, y[0]].astype(np.float64)
    d[0][at, y[0]] -= 1
    for t in range(1, steps):
        gold += em[t][at, y[t]] + trans[y[t - 1], y[t]]
        d[t][at, y[t]] -= 1
        np.add.at(dt, (y[t - 1], y[t]), -1)
    return float((z - gold).mean()), (d / n).astype(np.float32), (dt / n).astype(np.float32)


def train(windows: list[tuple[str, list[tuple[int, int, int]]]], updates: int = UPDATES, seed: int = 5) -> dict[str, np.ndarray]:
    """Tagger from (text, spans (start, kind, end)); Adam over batches of windows."""
    rng = np.random.default_rng(seed)
    x = np.zeros((len(windows), TRAIN_LENGTH), np.uint8)
    y = np.zeros((len(windows), TRAIN_LENGTH), np.int64)
    for k, (t, spans) in enumerate(windows):
        c = codes(points(t[:TRAIN_LENGTH]))
        x[k, :len(c)] = c
        for s, kind, e in spans:
            y[k, s:min(e, TRAIN_LENGTH)] = 2 + 2 * kind
            if s < TRAIN_LENGTH:
                y[k, s] = 1 + 2 * kind
    m = initial()
    first, second = {k: np.zeros_like(v) for k, v in m.items()}, {k: np.zeros_like(v) for k, v in m.items()}
    ok = _allowed()
    for u in range(updates):
        pick = rng.integers(0, len(windows), BATCH)
        bx, by = x[pick].T, y[pick].T
        tf, tb = [], []
        hf, hb = lstm(m["xf"], m["uf"], bx, tf), lstm(m["xb"], m["ub"], bx[::-1], tb)[::-1]
        both = np.concatenate([hf, hb], axis=2)
        _, dem, dt = crf_gradients(both @ m["e"] + m["eb"], _transitions(m), by)
        g = {k: np.zeros_like(v) for k, v in m.items()}
        g["t"] = np.where(ok, dt, 0)
        g["e"] = both.reshape(-1, 2 * HIDDEN).T @ dem.reshape(-1, TAGS)
        g["eb"] = dem.sum(axis=(0, 1))
        dboth = dem @ m["e"].T
        g["uf"] = lstm_back(m["uf"], bx, tf, dboth[:, :, :HIDDEN], g["xf"])
        g["ub"] = lstm_back(m["ub"], bx[::-1], tb, dboth[::-1, :, HIDDEN:], g["xb"])
        norm = np.sqrt(sum(float((v * v).sum()) for v in g.values()))
        scale = np.float32(min(1.0, 5.0 / max(norm, 1e-9)))
        lr = RATE * (1 - 0.9 * u / updates)
        for k in m:
            v = g[k] * scale
            first[k] += np.float32(0.1) * (v - first[k])
            second[k] += np.float32(0.01) * (v * v - second[k])
            m[k] = m[k] - np.float32(lr / (1 - 0.9 ** (u + 1))) * first[k] / (np.sqrt(second[k] / np.float32(1 - 0.99 ** (u + 1))) + np.float32(1e-6))
    return m


def viterbi(m: dict, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(best tags, their emission advantage over O) [T, B]; beyond the text: O."""
    em = emissions(m, x)
    em = np.ascontiguousarray(em.transpose(0, 2, 1))            # [T, tag, B]
    em -= em[:, :1].copy()
    beyond = x == 0
    em[:, 1:][np.broadcast_to(beyond[:, None, :], em[:, 1:].shape)] = _NEVER
    trans, ok = _transitions(m).astype(np.float32), _allowed()
    steps, _, n = em.shape
    back = np.zeros((steps, TAGS, n), np.int8)
    score = em[0] + np.where(np.arange(TAGS) % 2 == 0, _NEVER, 0)[:, None]
    score[0] = em[0, 0]
    for t in range(1, steps):
        new = np.empty_like(score)
        for b in range(TAGS):
            best = None
            for a in np.flatnonzero(ok[:, b]):
                v = score[a] + trans[a, b]
                if best is None:
                    best, arg = v, np.full(n, a, np.int8)
                else:
                    up = v > best
                    best = np.where(up, v, best)
                    arg[up] = a
            new[b] = best + em[t, b]
            back[t, b] = arg
        score = new
    tags = np.empty((steps, n), np.int8)
    tags[-1] = score.argmax(axis=0)
    at = np.arange(n)
    for t in range(steps - 1, 0, -1):
        tags[t - 1] = back[t][tags[t], at]
    return tags, np.take_along_axis(em, tags[:, None, :].astype(np.int64), axis=1)[:, 0]


# -- documents ----------------------------------------------------------------
def plausible(kind: int, s: str) -> bool:
    """The kind's own check of an added span."""
    d = _digits(s)
    if kind == 0:
        left, at, right = s.partition("@")
        return bool(at) and "@" not in right and any(c.isalnum() for c in left) and any(c.isalnum() for c in right)
    if kind == 1:
        parts = s.split(".")
        if len(parts) == 4 and all(p.isascii() and p.isdigit() and len(p) <= 3 and int(p) <= 255 for p in parts):
            return True
        return s.count(":") >= 2 and bool(re.fullmatch(r"[0-9A-Fa-f:]{4,39}", s)) and ("::" in s or s.count(":") == 7)
    if kind == 2:
        return 13 <= len(d) <= 19 and luhn(d) and all(c in "0123456789 -./" for c in s)
    return 7 <= len(d) <= 15 and len(d) < len(s) and s[0] in "+(0123456789" and s[-1].isdigit() and all(c in "0123456789 +()-./" for c in s)


def reconcile(found: list[tuple[int, int, int, float]]) -> list[tuple[int, int, int]]:
    """The non-overlapping spans of greatest total score of a document: (start, kind, end)."""
    best: dict[tuple[int, int, int], float] = {}
    for s, kind, e, score in found:
        best[s, kind, e] = max(score, best.get((s, kind, e), score))
    spans = sorted(best, key=lambda x: (x[2], x[0], x[1]))
    ends = [x[2] for x in spans]
    total, take = [0.0], []
    for k, (s, kind, e) in enumerate(spans):
        j = bisect.bisect_right(ends, s, 0, k)
        with_it = total[j] + best[s, kind, e]
        take.append((with_it > total[k], j))
        total.append(max(with_it, total[k]))
    out, k = [], len(spans)
    while k:
        yes, j = take[k - 1]
        if yes:
            out.append(spans[k - 1])
        k = j if yes else k - 1
    return out[::-1]


def tagged(m: dict, texts: list[np.ndarray], group: int = 1024) -> list[list[tuple[int, int, int]]]:
    """Reconciled spans of every text (code points)."""
    where: list[tuple[int, int]] = []
    for k, cp in enumerate(texts):
        at = np.flatnonzero(((cp >= 48) & (cp <= 57)) | (cp == 64))
        last = max(0, -(-(len(cp) - WINDOW) // STRIDE))  # the last window reaches the end
        lo, hi = np.maximum((at - WINDOW) // STRIDE + 1, 0), np.minimum(at // STRIDE, last)
        need = np.zeros(last + 2, np.int64)  # windows with a trigger, by differences
        np.add.at(need, lo[lo <= hi], 1)
        np.add.at(need, hi[lo <= hi] + 1, -1)
        starts = np.flatnonzero(np.cumsum(need)[:last + 1] > 0)
        where.extend((k, int(s) * STRIDE) for s in starts)
    coded = [codes(cp) for cp in texts]
    found: list[list[tuple[int, int, int, float]]] = [[] for _ in texts]
    width, cut = WINDOW, []
    while where:
        for k, begin, end, kind, score, whole in _decoded(m, coded, where, width, group * WINDOW // width):
            if whole:
                found[k].append((begin, kind, end, score))
            else:
                cut.append((k, begin, end))
        # spans that every window so far has cut: windows of twice the width around them
        width *= 2
        left = _uncovered(cut, found) if width <= 2 * LONGEST else []
        where = sorted({(k, min(max((a + e - width) // 2, 0), max(len(coded[k]) - width, 0))) for k, a, e in left})
        cut = []
    return [reconcile([x for x in f if x[3] >= MIN_SCORE]) for f in found]


def _uncovered(cut: list[tuple[int, int, int]], found: list[list[tuple[int, int, int, float]]]) -> list[tuple[int, int, int]]:
    """The cut spans (text, start, end) that lie in no whole span of their text."""
    reach: dict[int, tuple[list[int], list[int]]] = {}
    for k in {k for k, _, _ in cut}:
        spans = sorted((a, e) for a, _, e, _ in found[k])
        reach[k] = [a for a, _ in spans], list(itertools.accumulate((e for _, e in spans), max))
    out = []
    for k, a, e in cut:
        starts, ends = reach[k]
        at = bisect.bisect_right(starts, a) - 1
        if at < 0 or ends[at] < e:
            out.append((k, a, e))
    return out


def _decoded(m: dict, coded: list[np.ndarray], where: list[tuple[int, int]], width: int, group: int
             ) -> Iterator[tuple[int, int, int, int, float, bool]]:
    """(text, start, end, kind, score, whole) of the spans in the windows ``where`` (text, start); a span that
    touches an inner edge of its window isn't whole."""
    for lo in range(0, len(where), group):
        part = where[lo:lo + group]
        x = np.zeros((width, len(part)), np.uint8)
        for b, (k, s) in enumerate(part):
            c = coded[k][s:s + width]
            x[:len(c), b] = c
        tags, gain = viterbi(m, x)
        for b in np.flatnonzero(tags.any(axis=0)):
            k, s = part[b]
            col, g = tags[:, b], gain[:, b]
            for a in np.flatnonzero(col % 2 == 1):
                e = a + 1
                while e < width and col[e] == col[a] + 1:
                    e += 1
                whole = not (a == 0 and s > 0) and not (e == width and s + width < len(coded[k]))
                yield k, s + int(a), min(s + e, len(coded[k])), (int(col[a]) - 1) // 2, float(g[a:e].mean()), whole


def spans_of(m: dict, texts: list[str]) -> list[tuple[list[tuple[int, int, int]], list[tuple[int, int, int]]]]:
    """(base, added) spans of every text, as sorted (start, kind, end)."""
    cps = [points(t) for t in texts]
    out = []
    for t, cp, more in zip(texts, cps, tagged(m, cps)):
        base = base_spans(t, digit_runs(cp))
        added = [(s, k, e) for s, k, e in more if plausible(k, t[s:e]) and not any(s < y and x < e for x, _, y in base)]
        out.append((base, added))
    return out


# -- training examples ---------------------------------------------------------
def _example(rng: random.Random) -> tuple[str, int | None]:
    """A labelled example, or a counter-example (None)."""
    d = lambda n: "".join(rng.choice("0123456789") for _ in range(n))
    w = lambda a, b: "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rng.randint(a, b)))
    byte = lambda: str(rng.randint(0, 255))
    kind = rng.choice([0, 1, 2, 3, 3, None, None])
    if kind == 0:
        user = rng.choice([w(2, 9), f"{w(2, 7)}.{w(2, 7)}", f"{w(2, 8)}.{d(2)}", f"{w(1, 6)}_{w(2, 6)}+{w(2, 4)}", w(3, 8).capitalize() + d(1)])
        host = rng.choice([f"{w(3, 9)}.{w(2, 3)}", f"mail{d(1)}.{w(4, 8)}.com", f"{w(2, 6)}-{w(2, 6)}.co.{w(2, 2)}", "localhost", w(3, 9),
                           f"{w(2, 5)}ü{w(2, 5)}.de"])
        return user + rng.choice(["@", "@", "@", " @ "]) + host, 0
    if kind == 1:
        h = lambda: "".join(rng.choice("0123456789abcdef") for _ in range(rng.randint(1, 4)))
        return rng.choice([".".join(byte() for _ in range(4)), ":".join(h() for _ in range(8)),
                           f"{h()}:{h()}::{h()}:{h()}", f"fe80::{h()}"]), 1
    if kind == 2:
        body = rng.choice("3456") + d(rng.choice([13, 14, 14, 14, 15]))
        check = next(c for c in "0123456789" if luhn(body + c))
        digits, sep = body + check, rng.choice(["", "", " ", "-", ".", "/"])
        return sep.join(digits[i:i + 4] for i in range(0, len(digits), 4)), 2
    if kind == 3:
        return rng.choice([f"+{d(1)} ({d(3)}) {d(3)}-{d(4)}", f"({d(3)}) {d(3)}-{d(4)}", f"{d(3)}-{d(3)}-{d(4)}", f"{d(3)}.{d(3)}.{d(4)}",
                           f"00{d(2)} {d(2)} {d(7)}", f"+{d(2)} {d(3)} {d(4)} {d(3)}", f"0{d(3)}/{d(6)}", f"+{d(11)}", f"({d(3)}){d(3)}-{d(4)}",
                           f"1-{d(3)}-{d(3)}-{d(4)}"]), 3
    return rng.choice([f"20{d(2)}-{d(2)}-{d(2)}", f"{d(2)}:{d(2)}:{d(2)}", f"v{d(1)}.{d(2)}.{d(1)}", f"${d(1)},{d(3)}.{d(2)}", f"#{d(6)}", d(rng.randint(1, 12)),
                       f"{d(2)}-{d(2)}", f"{d(2)}/{d(2)}/20{d(2)}", f"{d(3)}.{d(2)}%", f"Version {d(1)}.{d(1)}", f"{d(4)}-{d(4)}",
                       f'token = "{"".join(rng.choice("0123456789abcdef") for _ in range(40))}"', f"{d(3)},{d(3)},{d(3)}", f"@{w(3, 9)}",
                       f"{w(1, 2).upper()}-{d(3)}-{d(5)}", f"{d(4)} - 20{d(2)}"]), None


def examples(background: list[str], count: int = 3000, seed: int = 2) -> list[tuple[str, list[tuple[int, int, int]]]]:
    """Training windows: background windows with their base spans, two thirds with an inserted example."""
    rng = random.Random(seed)
    background = [b for b in background if b] or ["an example of plain words. and more words follow here"]
    out = []
    for _ in range(count):
        t = rng.choice(background)
        lo = rng.randint(0, max(0, len(t) - TRAIN_LENGTH))
        t = t[lo:lo + TRAIN_LENGTH]
        spans = base_spans(t, digit_runs(points(t)))
        if rng.random() < 0.67:
            s, kind = _example(rng)
            gaps = [m.start() for m in re.finditer(r"\s", t) if not any(a <= m.start() < e for a, _, e in spans)] or [0]
            at = min(rng.choice(gaps), max(0, TRAIN_LENGTH - len(s) - 4))
            left, right = rng.choice([(" ", " "), (" ", ". "), (" ", ", "), (": ", " "), (" (", ") "), ("\n", "\n"), (" ", "*** ")])
            t = t[:at] + left + s + right + t[at:]
            grow, begin = len(left) + len(s) + len(right), at + len(left)
            spans = [(a, k, e) if e <= at else (a + grow, k, e + grow) for a, k, e in spans if e <= at or a >= at]
            if kind is not None:
                spans = [x for x in spans if x[2] <= begin or x[0] >= begin + len(s)] + [(begin, kind, begin + len(s))]
        out.append((t[:TRAIN_LENGTH], sorted(x for x in spans if x[2] <= TRAIN_LENGTH)))
    return out


def trained(docs: DataFrame, text: str = "text", id_col: str = "doc_id", sample: int = SAMPLE) -> dict[str, np.ndarray]:
    """Tagger trained on windows of ``sample`` documents, picked and placed by the hash of their id."""
    h = F.xxhash64(F.col(id_col))
    part = docs.where(F.length(text) > 0).select(
        h.alias("h"), F.substring(F.col(text), F.pmod(h, F.greatest(F.length(text) - 200, F.lit(1))).cast("int") + 1, F.lit(200)).alias("t"))
    rows = part.orderBy("h", "t").limit(sample).collect()
    return train(examples([r["t"] for r in rows]))


def _scanned(model, column: pa.Array) -> list[tuple[str | None, list, list]]:
    """(text, base, added) per row; the text is None where it has neither digit nor @."""
    out: list[tuple[str | None, list, list]] = []
    trigger = ta._table(lambda b: 0x30 <= b <= 0x39 or b == 0x40)
    for a, e, data, offs in ta.slices(column):
        has = np.concatenate([[0], np.cumsum(trigger[data], dtype=np.int64)])
        has = has[offs[1:]] > has[offs[:-1]]
        part: list[tuple[str | None, list, list]] = [(None, [], [])] * (e - a)
        rows = np.flatnonzero(has)
        texts = [data[offs[r]:offs[r + 1]].tobytes().decode("utf-8") for r in rows]
        for r, t, (base, added) in zip(rows, texts, spans_of(model, texts)):
            part[r] = (t, base, added)
        out.extend(part)
    return out


def span_text(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in sorted(spans))


def digest(docs: DataFrame, text: str = "text", id_col: str = "doc_id", sample: int = SAMPLE) -> DataFrame:
    """Per row: id, counts of the base kinds, base_sha256, spans, n_added."""
    model = docs.sparkSession.sparkContext.broadcast(trained(docs, text, id_col, sample))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = _scanned(model.value, b.column(1))
            yield pa.RecordBatch.from_arrays(
                [b.column(0), *(pa.array([sum(x[1] == k for x in base) for _, base, _ in found], pa.int64()) for k in range(len(KINDS))),
                 pa.array([hashlib.sha256(span_text(base).encode()).hexdigest() for _, base, _ in found], pa.string()),
                 pa.array([span_text(base + added) for _, base, added in found], pa.string()),
                 pa.array([len(added) for _, _, added in found], pa.int64())],
                names=["id", *(f"n_{k}" for k in KINDS), "base_sha256", "spans", "n_added"])

    rows = docs.select(F.col(id_col).alias("id"), F.col(text).cast("string").alias("t"))
    out = rows.mapInArrow(run, passed_through(rows.select("id"), ", ".join(f"n_{k} bigint" for k in KINDS)
                                              + ", base_sha256 string, spans string, n_added bigint"))
    return out.withColumnRenamed("id", id_col)


def redacted(docs: DataFrame, text: str = "text", id_col: str = "doc_id", length: str | None = "n_chars",
             sample: int = SAMPLE) -> DataFrame:
    """``docs`` with every span replaced by ``<KIND>`` (overlapping spans as one, by the first) and ``length`` recounted."""
    model = docs.sparkSession.sparkContext.broadcast(trained(docs, text, id_col, sample))
    names = list(docs.columns)
    at = names.index(text)
    n_at = names.index(length) if length in names else None

    def clean(t: str, spans: list[tuple[int, int, int]]) -> str:
        out, last = [], 0
        for s, k, e in sorted(spans):
            if s >= last:
                out.append(t[last:s] + f"<{KINDS[k].upper()}>")
            last = max(last, e)
        return "".join(out) + t[last:]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            column = b.column(at)
            found = _scanned(model.value, column.cast(pa.string()))
            hit = {r: clean(t, base + added) for r, (t, base, added) in enumerate(found) if base or added}
            cols = list(b.columns)
            if hit:
                texts = column.to_pylist()
                for r, t in hit.items():
                    texts[r] = t
                cols[at] = pa.array(texts, column.type)
                if n_at is not None:
                    n = cols[n_at].to_pylist()
                    for r, t in hit.items():
                        n[r] = len(t)
                    cols[n_at] = pa.array(n, pa.int64()).cast(cols[n_at].type)
            yield pa.RecordBatch.from_arrays(cols, names=names)

    return docs.mapInArrow(run, docs.schema)
