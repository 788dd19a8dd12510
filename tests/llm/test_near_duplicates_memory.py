"""A group of many classes is decided in bounded memory, and a task's rows go through one Python worker."""
import tracemalloc

import numpy as np

from authsift.llm import neardup
from authsift.llm.common import bitmap_of, in_bitmap


def test_a_large_group_is_decided_in_bounded_memory():
    rng = np.random.default_rng(2)
    base = rng.integers(0, 1 << 60, 400, dtype=np.uint64)
    arrays = [np.unique(np.concatenate([base[rng.random(400) < share], rng.integers(0, 1 << 60, 12, dtype=np.uint64)]))
              for share in np.where(rng.random(1500) < 0.3, 1.0, 0.7)]
    tracemalloc.start()
    got = neardup._close(arrays, 80, 100)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 90e6
    few = arrays[:120]
    sets = [set(x.tolist()) for x in few]
    near = {(i, j) for i in range(120) for j in range(i) if 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j])}
    label = list(range(120))
    for _ in range(120):
        for i, j in near:
            label[i] = label[j] = min(label[i], label[j])
    want = {frozenset(i for i in range(120) if label[i] == x) for x in set(label)}
    assert near and {frozenset(g.tolist()) for g in neardup._close(few, 80, 100)} == {g for g in want if len(g) > 1}
    assert got and neardup._close([np.arange(3, dtype=np.uint64), np.arange(7, 9, dtype=np.uint64)], 80, 100) == []


def test_bitmap_of_hashes_made_in_the_same_step(spark):
    df = spark.range(0, 3000, 1, 4).selectExpr("id", "xxhash64(id) as h")
    plain = bitmap_of(df, "h")
    made = bitmap_of(df.select("h", "id"), hashed=lambda b: b.column(0).to_numpy())
    want = np.zeros(1 << 25, bool)
    want[np.array([r["h"] for r in df.collect()], np.int64).view(np.uint64) >> np.uint64(39)] = True
    assert (plain == np.packbits(want)).all() and (made == plain).all()
    assert in_bitmap(plain, np.array([r["h"] for r in df.limit(50).collect()], np.int64).view(np.uint64)).all()
