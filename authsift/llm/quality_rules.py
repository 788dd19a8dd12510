r"""Quality rules: counted rules and per-language perplexity bands of an n-gram model.

The model of a language is a modified Kneser-Ney trigram model over code points, each
code point a symbol of its own.  Spark counts the trigrams of every document, per
language; lower orders use continuation counts, each order its own three discounts from
its counts of counts, and all of it is a table (language, trigram, log10 p) that Spark
joins and aggregates, of any size.  The most frequent trigrams of all languages, at most
2^18 (6 MB), are broadcast as sorted key arrays; a document's other trigrams are joined to
the table, once per distinct text.

A document is scored by its own language's model.  Its score is the mean over
its code points of log10 p less that language's corpus mean, shrunk by n / (n + 256) as a
short text's mean varies more.  Per language of the documents the band is [q1 - 4 (q3 - q1), q3 + 4 (q3 - q1)] over the scores of all documents that
pass the counted rules; documents outside (perplexity too high: noise; too low:
repetition) are rejected.

Edge cases: null and empty texts have no words and fail the counted rule; a null
language is a language of its own; in a language without a band only the counted
rules hold; repeated rows each get a result; extra columns are ignored or, in
``filtered``, passed on; very long texts are counted whole, a slice of rows at a time; an
empty table gives an empty result.
"""
from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from authsift.llm import textarrays as ta
from authsift.llm import textstats as ts
from authsift.llm.common import passed_through, saved
from authsift.llm.language_model import frequent_from

MIN_WORDS = 50
MAX_REPEAT = 50     # percent of the words
FENCE = 4.0
SHRINK = 256
FREQUENT = 1 << 18  # trigrams that are broadcast; the others are joined
BITS = 21
START = 0x110000    # stands before a text; no code point
CLASSES = 64        # alphabet of ``fit``
KEYS = CLASSES ** 3


def points(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(code points, row offsets into them); bytes that are no UTF-8 count as U+FFFD."""
    raw = data.tobytes()
    try:
        text, size = raw.decode(), ts.per_row(ts.POINT[data], offs)
    except UnicodeDecodeError:
        rows = [raw[a:e].decode("utf-8", "replace") for a, e in zip(offs[:-1], offs[1:])]
        text, size = "".join(rows), np.array([len(r) for r in rows], np.int64)
    return (np.frombuffer(text.encode("utf-32-le"), dtype="<u4").astype(np.int64),
            np.concatenate([[0], np.cumsum(size)]).astype(np.int64))


def trigrams(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(trigram ending at every code point as one number, row offsets); START stands before a text."""
    c, o = points(data, offs)
    one, two = np.full_like(c, START), np.full_like(c, START)
    one[1:] = c[:-1]
    two[2:] = c[:-2]
    starts = o[:-1][np.diff(o) > 0]
    one[starts] = START
    two[starts] = START
    second = starts + 1
    two[second[second < len(c)]] = START  # a one-point text's next is another text's first: START too
    return (two << 2 * BITS) | (one << BITS) | c, o


def _tag(lang: str):
    """The language as a join key: NULL is a language of its own."""
    return F.coalesce(F.concat(F.lit("="), F.col(lang).cast("string")), F.lit(""))


def _by_tag(tags: np.ndarray, size: np.ndarray):
    """(tag, places of its symbols) of a slice."""
    for x in sorted(set(tags)):
        yield x, np.flatnonzero(np.repeat(tags == x, size))


def counts(docs: DataFrame, text: str = "text", lang: str = "lang") -> DataFrame:
    """(tag, key, n) over all documents; every task sums its own first."""

    def merged(parts):
        k, n = np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])
        u, at = np.unique(k, return_inverse=True)
        return u, np.bincount(at, weights=n, minlength=len(u)).astype(np.int64)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[str, list[tuple[np.ndarray, np.ndarray]]] = {}

        def emit():
            for x, parts in total.items():
                k, n = merged(parts)
                yield pa.RecordBatch.from_arrays([pa.array([x] * len(k), pa.string()), pa.array(k), pa.array(n)],
                                                 names=["tag", "key", "n"])
            total.clear()

        held = 0
        for b in batches:
            tags = np.array(b.column(1).to_pylist(), dtype=object)
            for a, e, data, offs in ta.slices(b.column(0), ta.SMALL_BYTES):
                key, o = trigrams(data, offs)
                for x, at in _by_tag(tags[a:e], np.diff(o)):
                    parts = total.setdefault(x, [])
                    parts.append(np.unique(key[at], return_counts=True))
                    held += len(parts[-1][0])
                    if len(parts) == 64:
                        held -= sum(len(p[0]) for p in parts)
                        parts[:] = [merged(parts)]
                        held += len(parts[0][0])
                if held > 1 << 21:
                    yield from emit()
                    held = 0
        yield from emit()

    rows = docs.select(F.col(text).cast("string"), _tag(lang).alias("tag"))
    return rows.mapInArrow(count, "tag string, key bigint, n bigint").groupBy("tag", "key").agg(F.sum("n").alias("n"))


def _order(grams: DataFrame, context: str, n: str, lower, below: DataFrame | None = None, on: list[str] | None = None) -> DataFrame:
    """Column ``p``: the interpolated probability of one order, from counts ``n`` and a lower order's ``lower``.

    ``below`` holds ``lower`` by ``on`` for all of ``grams``; it is joined behind the counts, which do not need it.
    """
    of = lambda k: F.count_if(F.col(n) == k)
    d = grams.groupBy("tag").agg(*[of(k).alias(f"k{k}") for k in (1, 2, 3, 4)])
    k = lambda i: F.col(f"k{i}")
    y = k(1) / (k(1) + 2 * k(2))
    plain = (k(1) == 0) | (k(2) == 0)
    d = d.select("tag", *[
        F.when(plain, F.lit(0.5)).otherwise(F.least(F.lit(top), F.greatest(F.lit(0.1), F.when(
            k(i) > 0, F.lit(i) - F.lit(i + 1) * y * k(i + 1) / F.nullif(k(i), F.lit(0))).otherwise(F.lit(0.5))))).alias(f"d{i}")
        for i, top in ((1, 0.9), (2, 1.9), (3, 2.9))])
    total = grams.groupBy("tag", context).agg(F.sum(n).alias("total"), of(1).alias("n1"), of(2).alias("n2"),
                                              F.count_if(F.col(n) >= 3).alias("n3"))
    total = total.join(d, "tag").select(
        "tag", context, "d1", "d2", "d3", "total",
        ((F.col("d1") * F.col("n1") + F.col("d2") * F.col("n2") + F.col("d3") * F.col("n3")) / F.col("total")).alias("weight"))
    off = F.when(F.col(n) == 1, F.col("d1")).when(F.col(n) == 2, F.col("d2")).otherwise(F.col("d3"))
    p = F.greatest(F.col(n) - off, F.lit(0.0)) / F.col("total") + F.col("weight") * lower
    return (grams if below is None else grams.join(below, on)).join(total, ["tag", context]).withColumn("p", p)


def modelled(grams: DataFrame, alphabet: int = START) -> DataFrame:
    """Trigram counts (tag, key, n) -> (tag, key, n, logp), of every language."""
    mask = (1 << BITS) - 1
    three = grams.select("tag", "key", "n", F.shiftright("key", BITS).alias("ab"), F.col("key").bitwiseAND((1 << 2 * BITS) - 1).alias("bc"))
    two = three.groupBy("tag", "bc").agg(F.count(F.lit(1)).alias("m")) \
        .withColumn("b", F.shiftright("bc", BITS)).withColumn("c", F.col("bc").bitwiseAND(mask))
    one = two.groupBy("tag", "c").agg(F.count(F.lit(1)).alias("m")).withColumn("root", F.lit(0))
    p1 = _order(one, "root", "m", F.lit(1.0 / alphabet)).select("tag", "c", F.col("p").alias("p1"))
    p2 = _order(two, "b", "m", F.col("p1"), p1, ["tag", "c"]).select("tag", "bc", F.col("p").alias("p2"))
    return _order(three, "ab", "n", F.col("p2"), p2, ["tag", "bc"]).select("tag", "key", "n", F.log10("p").alias("logp"))


def _discounts(n: np.ndarray) -> np.ndarray:
    """Discounts for counts 0, 1, 2 and 3 or more, from the counts of counts."""
    k = [max(int((n == i).sum()), 0) for i in range(5)]
    if min(k[1], k[2]) == 0:
        return np.array([0.0, 0.5, 0.5, 0.5])
    y = k[1] / (k[1] + 2 * k[2])
    d = [0.0] + [i - (i + 1) * y * k[i + 1] / k[i] if k[i] else 0.5 for i in (1, 2, 3)]
    return np.clip(d, [0, 0.1, 0.1, 0.1], [0, 0.9, 1.9, 2.9])


def _level(n: np.ndarray, lower: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(interpolated probabilities, back-off weights per context) of one order; last axis: the class."""
    d = _discounts(n)[np.minimum(n, 3).astype(int)]
    total = n.sum(axis=-1, keepdims=True)
    weight = np.where(total > 0, d.sum(axis=-1, keepdims=True) / np.maximum(total, 1), 1.0)
    return np.maximum(n - d, 0) / np.maximum(total, 1) + weight * lower, weight[..., 0]


def fit(key: np.ndarray, n: np.ndarray, alphabet: int = CLASSES) -> dict[str, np.ndarray]:
    """The model of a small alphabet, whole in memory: what :func:`modelled` is held against."""
    c3 = np.zeros(KEYS)
    c3[key] = n
    c3 = c3.reshape(CLASSES, CLASSES, CLASSES)
    c2 = (c3 > 0).sum(axis=0).astype(float)
    c1 = (c2 > 0).sum(axis=0).astype(float)
    p1, _ = _level(c1, np.full(CLASSES, 1 / alphabet))
    p2, _ = _level(c2, p1[None, :])
    p3, weight = _level(c3, p2[None, :, :])
    keys = np.sort(key).astype(np.uint32)
    contexts = np.flatnonzero(c3.sum(axis=2).ravel()).astype(np.uint32)
    level = float((n * np.log10(p3.ravel()[key])).sum() / max(n.sum(), 1))
    return {"level": level, "key": keys, "logp": np.log10(p3.ravel()[keys]).astype(np.float32),
            "context": contexts, "backoff": np.log10(weight.ravel()[contexts]).astype(np.float32),
            "lower": np.log10(p2.ravel()).astype(np.float32)}


def log_probability(model: dict[str, np.ndarray], key: np.ndarray) -> np.ndarray:
    """log10 p of trigram keys: binary search, else back-off weight of the context and the bigram."""
    def look(keys, values, of, default):
        at = np.minimum(np.searchsorted(keys, of), len(keys) - 1)
        return np.where(keys[at] == of, values[at], default)
    context = (key // CLASSES).astype(np.uint32)
    low = look(model["context"], model["backoff"], context, 0.0) + model["lower"][key % (CLASSES * CLASSES)]
    return look(model["key"], model["logp"], key.astype(np.uint32), low).astype(np.float32)


COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


class _Model:
    """The language models of a table of documents: all trigrams in ``table``, the frequent ones broadcast."""

    def __init__(self, docs: DataFrame, text: str, lang: str, frequent: int):
        # the model's plan names its counts many times: the texts are counted once, before it
        self.table = saved(modelled(saved(counts(docs, text, lang))))
        self.levels = self.table.groupBy("tag").agg((F.sum(F.col("n") * F.col("logp")) / F.sum("n")).alias("level"))
        least = frequent_from(self.table.select(F.col("n").alias("c")), frequent)
        top = self.table.where(F.col("n") >= least).select("tag", "key", "logp").toPandas()
        self.whole = len(top) == self.table.count()  # every trigram is broadcast
        parts = {x: g.sort_values("key") for x, g in top.groupby("tag")}
        self.frequent = docs.sparkSession.sparkContext.broadcast(
            {x: (g["key"].to_numpy(np.int64), g["logp"].to_numpy()) for x, g in parts.items()})

    def rare(self, rows: DataFrame) -> DataFrame:
        """Rows (t, tag) -> (hash, tag, rare): the log10 p of the trigrams that are not broadcast."""
        frequent = self.frequent

        def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                tags = np.array(b.column(1).to_pylist(), dtype=object)
                for a, e, data, offs in ta.slices(b.column(0), ta.SMALL_BYTES):
                    key, o = trigrams(data, offs)
                    row = np.repeat(np.arange(e - a), np.diff(o))
                    _, known = _logs(frequent.value, key, tags[a:e], np.diff(o))
                    at = np.flatnonzero(~known)
                    order = at[np.lexsort((key[at], row[at]))]
                    new = np.ones(len(order), bool)
                    new[1:] = (key[order][1:] != key[order][:-1]) | (row[order][1:] != row[order][:-1])
                    first = np.flatnonzero(new)
                    name = ta.byte_hashes(data, offs[:-1], offs[1:]).view(np.int64)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(name[row[order[first]]]), pa.array(list(tags[a:e][row[order[first]]]), pa.string()), pa.array(key[order[first]]),
                         pa.array(np.diff(np.append(first, len(order))).astype(np.int32))], names=["hash", "tag", "key", "tf"])

        found = rows.select("t", "tag").mapInArrow(find, "hash bigint, tag string, key bigint, tf int")
        return (found.dropDuplicates(["hash", "tag", "key"]).join(self.table.select("tag", "key", "logp"), ["tag", "key"])
                .groupBy("hash", "tag").agg(F.sum(F.col("tf") * F.col("logp")).alias("rare")))


def _logs(frequent: dict, key: np.ndarray, tags: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(log10 p, 0 if not broadcast; whether it is) of a slice's trigrams, each by its row's language."""
    out, known = np.zeros(len(key)), np.zeros(len(key), bool)
    for x, at in _by_tag(tags, size):
        if x in frequent:
            keys, values = frequent[x]
            of = key[at]
            place = np.minimum(np.searchsorted(keys, of), len(keys) - 1)
            hit = keys[place] == of
            out[at], known[at] = np.where(hit, values[place], 0.0), hit
    return out, known


def _read(frequent: dict, column: pa.Array, tags: np.ndarray) -> tuple[dict[str, np.ndarray], np.ndarray, np.ndarray, np.ndarray]:
    """Per row of a text column: the counts, number of code points, log10 p of broadcast trigrams, hash of the text."""
    parts, sizes, logs, names = [], [], [], []
    for a, e, data, offs in ta.slices(column, ta.SMALL_BYTES):
        parts.append(ts.base(data, offs)[1])
        key, o = trigrams(data, offs)
        size = np.diff(o)
        lp, _ = _logs(frequent, key, tags[a:e], size)
        sizes.append(size)
        logs.append(np.bincount(np.repeat(np.arange(e - a), size), weights=lp, minlength=e - a))
        names.append(ta.byte_hashes(data, offs[:-1], offs[1:]).view(np.int64))
    join = lambda xs, t: np.concatenate(xs).astype(t) if xs else np.zeros(0, t)
    return ({k: join([p[k] for p in parts], np.int64) for k in COUNTS}, join(sizes, np.int64), join(logs, np.float64),
            join(names, np.int64))


def _base_failed(c: dict[str, np.ndarray]) -> np.ndarray:
    return (c["n_words"] < MIN_WORDS) | (100 * c["n_repeat_words"] > MAX_REPEAT * c["n_words"])


def _bands(scores: DataFrame, fence: float) -> DataFrame:
    """(tag, low, high): per language, the band of the scores."""
    q = scores.groupBy("tag").agg(F.percentile_approx("score", [0.25, 0.75], 10000).alias("q")).where("q is not null")
    q1, q3 = F.col("q")[0], F.col("q")[1]
    return q.select("tag", (q1 - F.lit(fence) * (q3 - q1)).alias("low"), (q3 + F.lit(fence) * (q3 - q1)).alias("high"))


def _rated(model: _Model, rows: DataFrame) -> DataFrame:
    """Rows (id, t, tag) -> id, tag, hash, the counts, base_failed, mean, score; numbers only, saved."""
    frequent = model.frequent

    def rate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            c, size, log, name = _read(frequent.value, b.column(1), np.array(b.column(2).to_pylist(), dtype=object))
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(2), pa.array(name), *(pa.array(c[k]) for k in COUNTS),
                 pa.array(_base_failed(c), pa.bool_()), pa.array(size), pa.array(log)],
                names=["id", "tag", "hash", *COUNTS, "base_failed", "size", "log"])

    schema = passed_through(rows.select("id", "tag"), "hash bigint, " + ", ".join(f"{k} bigint" for k in COUNTS)
                            + ", base_failed boolean, size bigint, log double")
    rated = rows.select("id", "t", "tag").mapInArrow(rate, schema)
    if not model.whole:
        rated = rated.join(model.rare(rows), ["hash", "tag"], "left").withColumn("log", F.col("log") + F.coalesce("rare", F.lit(0.0)))
    size, log = F.col("size"), F.col("log")
    return saved(rated.join(model.levels, "tag", "left").select(
        "id", "tag", "hash", *COUNTS, "base_failed", F.when(size > 0, log / size).alias("mean"),
        F.when(size > 0, (log - F.col("level") * size) / (size + SHRINK)).alias("score")))


def _decided(rated: DataFrame, fence: float) -> DataFrame:
    """Column ``kept``; in a language without a band only the counted rules hold."""
    inside = F.col("low").isNull() | F.col("score").between(F.col("low"), F.col("high"))
    return rated.join(_bands(rated.where("not base_failed"), fence), "tag", "left") \
        .withColumn("kept", ~F.col("base_failed") & F.coalesce(inside, F.lit(False)))


def verdicts(docs: DataFrame, text: str = "text", lang: str = "lang", id_col: str = "doc_id",
             fence: float = FENCE, frequent: int = FREQUENT) -> DataFrame:
    """Per row: id, the counts, perplexity, base_failed, kept."""
    model = _Model(docs, text, lang, frequent)
    rows = docs.select(F.col(id_col).alias("id"), F.col(text).cast("string").alias("t"), _tag(lang).alias("tag"))
    return _decided(_rated(model, rows), fence).select(
        F.col("id").alias(id_col), *COUNTS, "base_failed", "kept", F.pow(F.lit(10.0), -F.col("mean")).alias("perplexity"))


def filtered(docs: DataFrame, text: str = "text", lang: str = "lang", fence: float = FENCE,
             frequent: int = FREQUENT) -> DataFrame:
    """The kept rows of ``docs``, unchanged."""
    model = _Model(docs, text, lang, frequent)
    rows = docs.select(F.lit(0).alias("id"), F.col(text).cast("string").alias("t"), _tag(lang).alias("tag"))
    kept = _decided(_rated(model, rows), fence).where("kept").select(F.col("hash").alias("_hash"), F.col("tag").alias("_tag")).distinct()
    n, names = len(docs.columns), [*docs.columns, "_tag", "_hash"]

    def named(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            parts = [ta.byte_hashes(data, offs[:-1], offs[1:]).view(np.int64) for _, _, data, offs in ta.slices(b.column(n + 1))]
            name = pa.array(np.concatenate(parts) if parts else np.zeros(0, np.int64))
            yield pa.RecordBatch.from_arrays([*b.columns[:n + 1], name], names=names)

    tagged = docs.select("*", _tag(lang).alias("_tag"))
    schema = passed_through(tagged, "_hash bigint")
    return tagged.select("*", F.col(text).cast("string").alias("_t")).mapInArrow(named, schema) \
        .join(kept, ["_hash", "_tag"], "left_semi").select(*docs.columns)
