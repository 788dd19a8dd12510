"""Sentence spans against brute force over all runs of two and more sentences and 15 and more words."""
from collections import defaultdict

import numpy as np

from authsift.llm import queries


def test_all_runs(spark, tmp):
    rng = np.random.default_rng(11)
    sentence = lambda: " ".join(f"w{k}" for k in rng.integers(0, 10_000, rng.integers(2, 12))) + "."
    pool = [[sentence() for _ in range(rng.integers(2, 9))] for _ in range(12)]
    docs = {}
    for i in range(60):
        parts = [[sentence() for _ in range(rng.integers(0, 3))] if rng.random() < 0.5 else pool[rng.integers(0, 12)] for _ in range(5)]
        docs[i] = [x for p in parts for x in p]
    first, gone = {}, defaultdict(set)
    for i, s in docs.items():  # in the order of the ids, then of the places
        for a in range(len(s)):
            for b in range(a + 2, len(s) + 1):
                run = tuple(s[a:b])
                if sum(len(x.split()) for x in run) >= 15 and first.setdefault(run, (i, a)) != (i, a):
                    gone[i] |= set(range(a, b))
    df = spark.createDataFrame([(i, " ".join(s)) for i, s in docs.items()], "doc_id bigint, text string").repartition(3)
    df.write.parquet(f"{tmp}/documents.parquet")
    got = {r["doc_id"]: (r["n_sentences"], r["n_removed"], r["text"].split()) for r in queries.op5_sentence_spans(spark, tmp).collect()}
    assert sum(map(len, gone.values())) > 100
    for i, s in docs.items():
        left = " ".join(x for k, x in enumerate(s) if k not in gone[i])
        assert got[i] == (len(s), len(gone[i]), left.split()), i
