"""Texts of ten megabytes and more, and hashing in blocks."""
import random
import tracemalloc

import numpy as np
import pytest

from authsift.llm import (
    decontaminate, mixing, neardup, pii, secrets, spans, textarrays)


def test_hashes_do_not_depend_on_blocks(monkeypatch):
    rng = np.random.default_rng(0)
    for n in (0, 1, 5, 1000, 5000):
        data = rng.integers(0, 256, n).astype(np.uint8)
        start = np.sort(rng.integers(0, n + 1, 300))
        end = np.maximum(start, np.sort(rng.integers(0, n + 1, 300)))
        whole = textarrays.byte_hashes(data, start, end)
        for size in (4096, 64, 7, 1):
            monkeypatch.setattr(textarrays, "BLOCK_BYTES", size)
            assert (textarrays.byte_hashes(data, start, end) == whole).all()
        monkeypatch.undo()


def test_hashing_a_long_text_needs_little_more_than_the_text():
    data = np.frombuffer(b"some words of a long text " * 2_000_000, np.uint8)  # 52 MB
    tracemalloc.start()
    h = textarrays.byte_hashes(data, np.array([0]), np.array([len(data)]))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert len(h) == 1 and peak < 160e6


@pytest.fixture(scope="module")
def long_docs(spark):
    rng = random.Random(1)
    words = ["w%d" % rng.randrange(3000) for _ in range(200_000)]
    text = " ".join(f"{w}." if k % 12 == 11 else w for k, w in enumerate(words * 12))  # over 10 MB
    assert len(text) > 10_000_000
    tail = " ".join(f"t{k}" for k in range(12))
    rows = [(1, text + " user@example.com", "a"), (2, text + " " + tail, "a"), (3, "short text here", "b")]
    return spark.createDataFrame(rows, "doc_id bigint, text string, source string").cache(), tail


def test_operators_take_long_texts(spark, long_docs):
    docs, tail = long_docs
    items = spark.createDataFrame([("i", tail)], "item_id string, text string")
    hit = {r["doc_id"]: (r["n_words"], r["n_hit"]) for r in decontaminate.report(docs, items).collect()}
    assert hit[2][1] == 12 and hit[1][1] == 0 and hit[2][0] == 2_400_012
    near = {r["doc_id"]: r["component_id"] for r in neardup.report(docs, n=3, num=85).collect()}
    assert near == {1: 1, 2: 1, 3: 3}
    got = {r["doc_id"]: r for r in spans.deduplicated(docs).collect()}
    assert got[2]["n_removed"] > 100_000 and got[3]["text"] == "short text here" and len(got[1]["text"]) < 4_000_000  # sentences recur every third time
    taken = {r["doc_id"]: r["size"] for r in mixing.mix(docs).collect()}
    assert taken == {1: 2_400_001, 2: 2_400_012, 3: 3}


def test_scanners_take_long_texts(spark, long_docs, monkeypatch):
    docs, _ = long_docs
    monkeypatch.setattr(pii, "trained", lambda *a, **k: pii.initial())
    assert {r["doc_id"]: r["n_email"] for r in pii.digest(docs).collect()} == {1: 1, 2: 0, 3: 0}
    assert secrets.digest(docs).where("n_assign > 0").count() == 0
