r"""MinHash near-duplicates by an LSH forest.

1. Every text becomes its set of word shingles (64-bit hashes); equal sets are one
   class, named by a 128-bit digest of the set.  All later steps see classes, so
   copies cost nothing.
2. A class gets ``trees * depth`` minhashes of a byte each.  Tree t orders the
   classes by its own ``depth`` bytes (then the others): one range sort of
   (tree, signature) rows over the cluster.
3. Along a sorted order, classes with a common prefix of ``least`` bytes form a
   region: a pair of similarity s meets in one with probability s^least in every
   tree, however crowded the place is.  Within a region only classes whose whole
   signatures agree in enough bytes stay, in groups linked by that agreement.  A
   region that reaches a partition's edge is put together again by its prefix.
   In a region of more than ``region`` classes first the class nearest to the
   region's commonest bytes is compared with all others (a text with many near
   copies); what its exact links have not joined to the region's largest component
   is then compared with the whole region, in pairs of blocks over the cluster.
4. The groups' members bring their full sets (groups met in several trees are
   taken once), and all pairs of a group are decided exactly by one product of
   0/1 matrices; only a spanning set of the links is emitted.
5. Components of the links are found by alternating large-star and small-star
   steps, each checkpointed.

The links are exact (no false one); a link is missed only if its classes meet in
none of the trees (at 16 trees and depth 3 that is (1 - 0.85^3)^16, below 3e-7, at
similarity 0.85 and 1.1e-5 at 0.8, at any region size) or if their signatures agree
in over 0.16 fewer bytes than their similarity.  A region of n classes without a
common neighbour (pages of one template) costs n^2 / 2 signature comparisons and up
to n^2 / 1024 rows of groups; no pairs are emitted.

Edge cases: null and word-less texts have an empty set and are linked with
nothing, not even each other; a text with fewer words than a shingle is one
shingle; a null id takes the component's smallest id and is kept only if no
member has an id; repeated rows each get a result; very long texts are sets of their
shingles, worked on a slice of whole rows at a time; extra columns are ignored or, in
``deduplicated``, passed on; an empty table gives an empty result.
"""
from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from authsift.llm import textarrays as ta
from authsift.llm.common import bitmap_of, in_bitmap, passed_through, saved, with_columns

TREES, DEPTH, LEAST, REGION = 16, 8, 3, 512
STAR, BLOCK, SAMPLE = 256, 1024, 64
"""Leaves per group of a star, classes per block of a region, and classes that tell a region's commonest bytes."""
SLACK = 0.16
"""How far below the threshold two signatures may agree and still be checked (over 5 standard errors at 128 bytes)."""


def sets(column: pa.Array, n: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Per slice: (first row, sorted distinct shingle hashes of all rows, offsets per row)."""
    for a, _, data, offs in ta.slices(column, ta.SMALL_BYTES):
        w = ta.words(ta.LOWER[data], offs, ta.SPACED)
        rows = len(w.count)
        at = ta.inside(w, n)
        h, row = ta.ngrams(w.hash, n)[at], w.row[at]
        for k in range(1, n):  # short texts: the whole sequence
            one = np.flatnonzero(w.count == k)
            if len(one):
                h = np.concatenate([h, ta.ngrams(w.hash, k)[w.first[one]] ^ np.uint64(k)])
                row = np.concatenate([row, one])
        order = np.lexsort((h, row))
        h, row = h[order], row[order]
        first = np.ones(len(h), bool)
        first[1:] = (h[1:] != h[:-1]) | (row[1:] != row[:-1])
        h, row = h[first], row[first]
        yield a, h, np.concatenate([[0], np.cumsum(np.bincount(row, minlength=rows))]).astype(np.int64)


def digests(h: np.ndarray, offs: np.ndarray) -> list[bytes | None]:
    """128-bit digest of each row's set; None for an empty set."""
    with np.errstate(over="ignore"):
        one = np.concatenate([np.zeros(1, np.uint64), np.cumsum(ta.mix(h ^ np.uint64(0x51ED270B)), dtype=np.uint64)])
        two = np.concatenate([np.zeros(1, np.uint64), np.cumsum(ta.mix(h + np.uint64(0xB492B66FBE98F273)), dtype=np.uint64)])
        pair = np.stack([one[offs[1:]] - one[offs[:-1]], two[offs[1:]] - two[offs[:-1]]], axis=1)
    raw, size = pair.tobytes(), np.diff(offs)
    return [raw[16 * k:16 * k + 16] if size[k] else None for k in range(len(size))]


def signatures(h: np.ndarray, offs: np.ndarray, count: int) -> np.ndarray:
    """``count`` minhash bytes per row with a set."""
    rng = np.random.default_rng(9)
    mul = rng.integers(1, 1 << 32, count, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    start = offs[:-1][np.diff(offs) > 0]
    out = np.zeros((len(start), count), dtype=np.uint8)
    low = h.astype(np.uint32) ^ (h >> np.uint64(32)).astype(np.uint32)
    for k in range(count):
        v = low * np.uint32(mul[k] & np.uint64(0xFFFFFFFF))
        v ^= v >> np.uint32(15)
        v *= np.uint32((int(mul[k]) >> 7 & 0xFFFFFFFF) | 1)
        m = np.minimum.reduceat(v, start) if len(start) else v[:0]
        m ^= m >> np.uint32(16)
        m = m * np.uint32(0x85EBCA6B)  # the byte must depend on the whole minimum, whose high bits are all 0
        out[:, k] = m >> np.uint32(24)
    return out


def classes(docs: DataFrame, text: str, id_col: str, n: int, sig: bool) -> DataFrame:
    """(id, node, n_shingles[, sig]) per row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for a, h, offs in sets(b.column(1), n):
                size = np.diff(offs)
                cols = [b.column(0).slice(a, len(size)), pa.array(digests(h, offs), pa.binary()), pa.array(size, pa.int64())]
                if sig:
                    s = np.full(len(size), None, dtype=object)
                    s[size > 0] = [x.tobytes() for x in signatures(h, offs, TREES * DEPTH)]
                    cols.append(pa.array(list(s), pa.binary()))
                yield pa.RecordBatch.from_arrays(cols, names=["id", "node", "n_shingles", "sig"][:len(cols)])

    rows = docs.select(F.col(id_col).alias("id"), F.col(text).cast("string").alias("t"))
    schema = passed_through(rows.select("id"), "node binary, n_shingles bigint" + (", sig binary" if sig else ""))
    return rows.mapInArrow(run, schema)


def _linked(rows: np.ndarray, least: int) -> list[np.ndarray]:
    """Groups (indices) of signatures linked by agreeing in at least ``least`` bytes."""
    n = len(rows)
    label = np.arange(n)
    near = np.zeros((n, n), bool)
    for k in range(n - 1):
        near[k, k + 1:] = (rows[k + 1:] == rows[k]).sum(axis=1) >= least
    return _groups(n, *np.nonzero(near), label)


def _groups(n: int, a: np.ndarray, b: np.ndarray, label: np.ndarray) -> list[np.ndarray]:
    """Components of two or more of the links (a, b)."""
    while len(a):
        low = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, a, low)
        np.minimum.at(new, b, low)
        new = new[new]
        if (new == label).all():
            break
        label = new
    order = np.argsort(label, kind="stable")
    cut = np.flatnonzero(np.diff(label[order])) + 1
    return [g for g in np.split(order, cut) if len(g) > 1]


def _named(nodes: list[bytes], found: list[np.ndarray]) -> tuple[list[bytes], list[bytes]]:
    """(group, node) columns of groups of indices into ``nodes``."""
    import hashlib
    groups, members = [], []
    for g in found:
        who = sorted(nodes[k] for k in g)
        groups.extend([hashlib.md5(b"".join(who)).digest()] * len(who))
        members.extend(who)
    return groups, members


def _bytes(column) -> np.ndarray:
    """Signatures as rows of bytes."""
    return np.frombuffer(b"".join(column), np.uint8).reshape(-1, TREES * DEPTH)


def candidates(reps: DataFrame, agree: int) -> tuple[DataFrame, DataFrame]:
    """(group, node): classes to compare, from the sorted orders; (tree, head, n, node, sig): the regions above REGION."""
    import pandas as pd

    def by_tree(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            sig = _bytes(b.column(1).to_pylist())
            for t in range(TREES):
                turned = np.roll(sig, -t * DEPTH, axis=1)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(sig), t, np.int32)), pa.array([x.tobytes() for x in turned], pa.binary()),
                     b.column(0)], names=["tree", "sig", "node"])

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["group", "node", "tree", "head", "sig"]
        rest: tuple | None = None
        opened = None  # the region whose rows are given out as they come
        first = True

        def given(tree, key, nodes):
            n = len(nodes)
            return pa.RecordBatch.from_arrays(
                [pa.nulls(n, pa.binary()), pa.array(nodes, pa.binary()), pa.array(tree, pa.int32()),
                 pa.array([x.tobytes() for x in key[:, :LEAST]], pa.binary()), pa.array([x.tobytes() for x in key], pa.binary())], names=names)

        for b in batches:
            if not b.num_rows:
                continue
            tree, key, nodes = b.column(0).to_numpy(), _bytes(b.column(1).to_pylist()), b.column(2).to_pylist()
            if rest is not None:
                tree, key, nodes = np.concatenate([rest[0], tree]), np.concatenate([rest[1], key]), rest[2] + nodes
            head = key[:, :LEAST]
            cut = np.flatnonzero((tree[1:] != tree[:-1]) | (head[1:] != head[:-1]).any(axis=1)) + 1
            bounds = np.concatenate([[0], cut, [len(tree)]])
            at = lambda k: (int(tree[k]), head[k].tobytes())
            groups, members = [], []
            for k in np.flatnonzero((np.diff(bounds) > 1) | (np.arange(len(bounds) - 1) == 0)):
                lo, hi = int(bounds[k]), int(bounds[k + 1])
                if k == len(bounds) - 2:
                    break  # the last region may go on in the next batch
                if k == 0 and (first or at(lo) == opened) or hi - lo > REGION:
                    yield given(tree[lo:hi], key[lo:hi], nodes[lo:hi])
                elif hi - lo > 1:
                    g, m = _named(nodes[lo:hi], _linked(key[lo:hi], agree))
                    groups += g
                    members += m
            if groups:
                n = len(groups)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(groups, pa.binary()), pa.array(members, pa.binary()), pa.nulls(n, pa.int32()),
                     pa.nulls(n, pa.binary()), pa.nulls(n, pa.binary())], names=names)
            first = first and len(bounds) == 2
            lo = int(bounds[-2])
            rest = (tree[lo:], key[lo:], nodes[lo:])
            if at(lo) == opened or len(rest[0]) > REGION:
                yield given(*rest)
                opened, rest, first = at(lo), None, False
        if rest is not None:
            yield given(*rest)

    rows = reps.select("node", "sig").mapInArrow(by_tree, "tree int, sig binary, node binary")
    ordered = rows.repartitionByRange("tree", "sig").sortWithinPartitions("tree", "sig", "node")
    walked = saved(ordered.mapInArrow(walk, "group binary, node binary, tree int, head binary, sig binary"))
    loose = walked.where("tree is not null").drop("group")
    size = loose.groupBy("tree", "head").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    loose = saved(loose.join(size, ["tree", "head"]).select("tree", "head", "n", "node", "sig"))

    def small(key, rows):
        nodes = rows["node"].tolist()
        return pd.DataFrame(dict(zip(("group", "node"), _named(nodes, _linked(_bytes(rows["sig"]), agree)))))

    edge = loose.where(F.col("n") <= REGION).groupBy("tree", "head").applyInPandas(small, "group binary, node binary")
    groups = walked.where("tree is null").select("group", "node").unionByName(edge).distinct()
    return groups, loose.where(F.col("n") > REGION)


def _agreeing(rows: DataFrame, other: str) -> DataFrame:
    """``rows`` with the number of bytes in which sig and ``other`` agree."""
    a, b = rows.columns.index("sig"), rows.columns.index(other)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in batches:
            n = (_bytes(x.column(a).to_pylist()) == _bytes(x.column(b).to_pylist())).sum(axis=1)
            yield with_columns(x, agree=pa.array(n.astype(np.int32)))

    return rows.mapInArrow(count, passed_through(rows, "agree int"))


def stars(crowded: DataFrame, agree: int) -> DataFrame:
    """(group, node): the class nearest to a region's commonest bytes with the classes that may be its near copies."""
    import pandas as pd

    def commonest(key, rows):
        sig = _bytes(rows["sig"])
        mid = np.array([np.bincount(c, minlength=256).argmax() for c in sig.T], dtype=np.uint8)
        return pd.DataFrame({"tree": [key[0]], "head": [key[1]], "mid": [mid.tobytes()]})

    some = crowded.where(F.pmod(F.xxhash64("node"), F.ceil(F.col("n") / SAMPLE)) == 0)
    mid = some.groupBy("tree", "head").applyInPandas(commonest, "tree int, head binary, mid binary")
    near = _agreeing(crowded.join(mid, ["tree", "head"]), "mid")
    hub = near.groupBy("tree", "head").agg(F.max(F.struct("agree", "node", "sig")).alias("x")) \
        .select("tree", "head", F.col("x.node").alias("hub"), F.col("x.sig").alias("hub_sig"))
    leaf = _agreeing(crowded.join(hub, ["tree", "head"]), "hub_sig").where((F.col("agree") >= agree) & (F.col("node") != F.col("hub"))) \
        .select("hub", "node").distinct()
    parts = leaf.groupBy("hub").agg(F.ceil(F.count(F.lit(1)) / STAR).alias("parts"))
    leaf = leaf.join(parts, "hub").withColumn("part", F.pmod(F.xxhash64("node"), F.col("parts")))
    group = F.unhex(F.md5(F.concat("hub", F.col("part").cast("string").cast("binary")))).alias("group")
    return leaf.select(group, "node").unionByName(leaf.select(group, F.col("hub").alias("node")).distinct())


def crossing(crowded: DataFrame, label: DataFrame, agree: int) -> DataFrame:
    """(group, node): classes to compare in the regions that have more than one component, all against all but
    within the largest component."""
    import pandas as pd

    rows = crowded.join(label, "node", "left").withColumn("label", F.coalesce("label", "node"))
    main = rows.groupBy("tree", "head", "label").agg(F.count(F.lit(1)).alias("c")).groupBy("tree", "head") \
        .agg(F.max(F.struct("c", "label")).alias("x")).select("tree", "head", F.col("x.c").alias("inner"), F.col("x.label").alias("main"))
    rows = rows.join(main, ["tree", "head"]).where(F.col("inner") < F.col("n"))
    apart = F.ceil((F.col("n") - F.col("inner")) / BLOCK)  # blocks outside the largest component, numbered first
    out = F.col("label") != F.col("main")
    spread = F.xxhash64("node")
    rows = rows.withColumn("apart", apart).withColumn("within", F.ceil(F.col("inner") / BLOCK)) \
        .withColumn("block", F.when(out, F.pmod(spread, F.col("apart"))).otherwise(F.col("apart") + F.pmod(spread, F.col("within")))) \
        .withColumn("with", F.explode(F.sequence(F.lit(0).cast("bigint"), F.when(out, F.col("apart") + F.col("within")).otherwise(F.col("apart")) - 1)))
    rows = rows.select("tree", "head", F.least("block", "with").alias("p"), F.greatest("block", "with").alias("q"), "block", "node", "label", "sig")

    def met(key, rows):
        sig, block = _bytes(rows["sig"]), rows["block"].to_numpy()
        label = pd.factorize(rows["label"])[0]
        mine, theirs = np.flatnonzero(block == key[2]), np.flatnonzero(block == key[3])
        other, of = sig[theirs], label[theirs]
        a, b = [], []
        for k in mine:
            hit = theirs[((other == sig[k]).sum(axis=1) >= agree) & (of != label[k])]
            a.append(np.full(len(hit), k))
            b.append(hit)
        a, b = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (a, b))
        return pd.DataFrame(dict(zip(("group", "node"), _named(rows["node"].tolist(), _groups(len(sig), a, b, np.arange(len(sig)))))))

    return rows.groupBy("tree", "head", "p", "q").applyInPandas(met, "group binary, node binary").distinct()


def _first_row(nodes: list[bytes], id_hash: pa.Array) -> np.ndarray:
    """Hash of (node, id hash)."""
    node = np.frombuffer(b"".join(nodes), np.uint64).reshape(-1, 2)[:, 0]
    return ta.mix(node ^ id_hash.to_numpy().astype(np.int64).view(np.uint64)).view(np.int64)


def _close(arrays: list[np.ndarray], num: int, den: int) -> list[np.ndarray]:
    """Components of two or more of the sets with den * |intersection| >= num * |union|, from products of 0/1
    matrices in slabs of columns and rows of at most 2^20 numbers beside the one of all intersections."""
    n = len(arrays)
    size = np.array([len(x) for x in arrays], dtype=np.int64)
    _, code, count = np.unique(np.concatenate(arrays), return_inverse=True, return_counts=True)
    shared = count[code] > 1  # hashes of one member meet nothing
    code, who = code[shared], np.repeat(np.arange(n, dtype=np.int32), size)[shared]
    order = np.argsort(code, kind="stable")
    code, who = code[order], who[order]
    code = np.cumsum(np.diff(code, prepend=code[:1]) != 0)
    both = np.zeros((n, n), dtype=np.float32)
    codes = int(code[-1]) + 1 if len(code) else 0
    wide = min(8192, max(64, (1 << 20) // n), max(codes, 1))
    for lo in range(0, codes, wide):
        at, end = np.searchsorted(code, (lo, lo + wide))
        slab = np.zeros((n, wide), dtype=np.float32)
        slab[who[at:end], code[at:end] - lo] = 1
        both += slab @ slab.T
    a, b = [], []
    high = max(1, (1 << 20) // n)
    for lo in range(0, n, high):
        mine = np.rint(both[lo:lo + high]).astype(np.int64)
        near = den * mine >= num * (size[lo:lo + high, None] + size - mine)
        x, y = np.nonzero(np.triu(near, lo + 1))
        a.append(x + lo)
        b.append(y)
    return _groups(n, np.concatenate(a), np.concatenate(b), np.arange(n))


def links(docs: DataFrame, reps: DataFrame, groups: DataFrame, text: str, id_col: str, n: int,
          num: int, den: int) -> DataFrame:
    """(a, b): a spanning set of the exact links within the groups."""
    import pandas as pd

    wanted = saved(groups.select("node").distinct().join(reps.select("node", "rep"), "node"))

    bits = docs.sparkSession.sparkContext.broadcast(
        bitmap_of(wanted.select("node", F.xxhash64("rep")).coalesce(4 * docs.sparkSession.sparkContext.defaultParallelism),
                  hashed=lambda b: _first_row(b.column(0).to_pylist(), b.column(1))))

    def full(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for a, h, offs in sets(b.column(1), n):
                names = digests(h, offs)
                # copies other than the class's first row go nowhere
                here = np.flatnonzero([x is not None for x in names])
                ids = b.column(0).slice(a, len(names)).take(pa.array(here))
                hashed = _first_row([names[k] for k in here], b.column(2).slice(a, len(names)).take(pa.array(here)))
                pick = in_bitmap(bits.value, hashed)
                yield pa.RecordBatch.from_arrays(
                    [ids.filter(pa.array(pick)), pa.array([names[k] for k in here[pick]], pa.binary()),
                     pa.array([h[offs[k]:offs[k + 1]].tobytes() for k in here[pick]], pa.binary())],
                    names=["id", "node", "set"])

    rows = docs.select(F.col(id_col).alias("id"), F.col(text).cast("string").alias("t"), F.xxhash64(id_col))
    have = rows.mapInArrow(full, passed_through(rows.select("id"), "node binary, set binary"))
    have = have.join(wanted, (have["node"] == wanted["node"]) & have["id"].eqNullSafe(wanted["rep"])) \
        .select(have["node"], "set")
    have = have.groupBy("node").agg(F.first("set").alias("set"))

    def decide(key, rows):
        nodes = rows["node"].tolist()
        out = []
        for g in _close([np.frombuffer(x, np.uint64) for x in rows["set"]], num, den):
            out.extend((nodes[g[0]], nodes[k]) for k in g[1:])
        return pd.DataFrame(out, columns=["a", "b"])

    return groups.join(have, "node").groupBy("group").applyInPandas(decide, "a binary, b binary")


def components(edges: DataFrame) -> DataFrame:
    """(node, label): the smallest node of each node's component, by large-star and small-star steps."""
    edges = saved(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
                  .repartition("u").distinct())
    of = Window.partitionBy("u")
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        # every node either a leaf of one smaller node or the least of its star: nothing is left to do
        ends = both.groupBy("u").agg(F.count_if(F.col("v") < F.col("u")).alias("down"), F.count_if(F.col("v") > F.col("u")).alias("up"))
        if not ends.agg(F.count_if((F.col("down") > 1) | (F.col("down") > 0) & (F.col("up") > 0))).first()[0]:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("label"))
        large = both.withColumn("m", F.least(F.min("v").over(of), "u")).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        # dealt by u once, for the distinct rows and the least neighbour
        large = large.repartition("u").distinct().withColumn("m", F.min("v").over(of))
        small = large.select(F.explode(F.array(F.struct("v", "m"), F.struct(F.col("u").alias("v"), "m"))).alias("e")) \
            .select(F.col("e.v").alias("u"), F.col("e.m").alias("v")).where("u <> v")
        edges = saved(small.repartition("u").distinct())


def clusters(docs: DataFrame, text: str = "text", id_col: str = "doc_id", n: int = 5, num: int = 80, den: int = 100
             ) -> tuple[DataFrame, DataFrame]:
    """(rows, reps): rows (id, node, n_shingles); reps (node, rep, component_id, stays) per class of equal sets.

    ``stays`` marks one class of every component: the one with the smallest id, then the smallest node.

    Linked: den * |intersection| >= num * |union| of the sets of n-word shingles.
    """
    rows = saved(classes(docs, text, id_col, n, True))
    reps = saved(rows.where("node is not null").groupBy("node").agg(F.min("id").alias("rep"), F.first("sig").alias("sig")))
    agree = int(np.ceil((num / den - SLACK) * TREES * DEPTH))
    groups, crowded = candidates(reps, agree)
    crowds = not crowded.isEmpty()
    if crowds:
        groups = groups.unionByName(stars(crowded, agree))
    label = components(links(docs, reps, saved(groups), text, id_col, n, num, den))
    if crowds:
        more = saved(crossing(crowded, label, agree))
        if not more.isEmpty():
            label = components(label.toDF("a", "b").unionByName(links(docs, reps, more, text, id_col, n, num, den)))
    reps = reps.select("node", "rep").join(label, "node", "left").withColumn("label", F.coalesce("label", "node"))
    least = reps.groupBy("label").agg(F.min("rep").alias("component_id"),
                                      F.min(F.struct(F.col("rep").isNull().alias("none"), "rep", "node")).alias("first"))
    return rows.drop("sig"), saved(reps.join(least, "label").select(
        "node", "rep", "component_id", (F.col("node") == F.col("first.node")).alias("stays")))


def report(docs: DataFrame, text: str = "text", id_col: str = "doc_id", n: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """Per row: id, n_shingles, component_id, kept."""
    rows, reps = clusters(docs, text, id_col, n, num, den)
    out = rows.join(reps.select("node", "component_id"), "node", "left")
    component = F.when(F.col("node").isNull(), F.col("id")).otherwise(F.col("component_id"))
    return out.select(F.col("id").alias(id_col), "n_shingles", component.alias("component_id"),
                      F.col("id").eqNullSafe(component).alias("kept"))


def deduplicated(docs: DataFrame, text: str = "text", id_col: str = "doc_id", n: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """The rows of ``docs`` that stay, unchanged: one of every component, and all with an empty set.

    Of a component the row with the smallest id stays (of several rows with that id, or without any id, one).
    """
    _, reps = clusters(docs, text, id_col, n, num, den)
    t = docs.columns.index(text)

    def named(batches):
        for b in batches:
            names = [x for _, h, offs in sets(b.column(t).cast(pa.string()), n) for x in digests(h, offs)]
            yield with_columns(b, **{_NODE: pa.array(names, pa.binary())})

    rows = docs.mapInArrow(named, passed_through(docs, f"{_NODE} binary"))
    stay = reps.where("stays").select(F.col("node").alias(_NODE), F.col("rep").alias(_REP))
    kept = rows.where(f"{_NODE} is not null").join(stay, _NODE).where(F.col(id_col).eqNullSafe(F.col(_REP))) \
        .dropDuplicates([_NODE]).select(*docs.columns)
    return kept.unionByName(rows.where(f"{_NODE} is null").select(*docs.columns))


_NODE, _REP = "__set_digest", "__first_id"
