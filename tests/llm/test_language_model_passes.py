"""The language model reads the texts twice: for the counts, and for the model ids of which it learns and scores."""
import numpy as np
import pytest

from authsift.llm import language_model as lm


def test_texts_are_read_twice(spark):
    read = spark.sparkContext.accumulator(0)

    def seen(batches):
        for b in batches:
            read.add(b.num_rows)
            yield b

    rows = [(k, None if k == 7 else f"some words {k} and others {k % 7} here") for k in range(60)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3).mapInArrow(seen, "doc_id bigint, text string")
    assert lm.scores(docs).count() == len(rows)
    assert read.value <= 2 * len(rows)


@pytest.mark.parametrize("few", [0, 3, 10_000])
def test_classes_of_few_and_of_many_targets(monkeypatch, few):
    monkeypatch.setattr(lm, "FEW", few)
    rng = np.random.default_rng(3)
    v = lm.vocabulary(np.arange(1, 3000, dtype=np.uint64), np.arange(3000, 1, -1), 5_000_000, 4000)
    m = {k: x.astype(np.float64) for k, x in lm.initial(v).items()}
    m["c"] += rng.normal(size=m["c"].shape)
    m["w"] += rng.normal(size=m["w"].shape) * np.linspace(0, 40, lm.CLASSES)[:, None, None]  # logits that exp needs shifted
    h = rng.uniform(-1, 1, (300, lm.HIDDEN))
    t = np.where(rng.random(300) < 0.5, lm.VOCABULARY - 1, rng.integers(0, lm.VOCABULARY, 300)).astype(np.uint16)
    cls, word = t // lm.PER, t % lm.PER

    def log_soft(x):
        x = x - x.max(axis=1, keepdims=True)
        return x - np.log(np.exp(x).sum(axis=1, keepdims=True))
    one = log_soft(h @ m["c"] + m["cb"])
    two = log_soft(np.einsum("nk,nkp->np", h, m["w"][cls]) + m["wb"][cls])
    at = np.arange(len(t))
    grad = {k: np.zeros_like(x) for k, x in m.items()}
    logs, dh = lm.log_softmax_at(m, h, t, grad)
    assert np.allclose(logs, one[at, cls] + two[at, word])
    a, b = np.exp(one), np.exp(two)
    a[at, cls] -= 1
    b[at, word] -= 1
    assert np.allclose(dh, a @ m["c"].T + np.einsum("np,nkp->nk", b, m["w"][cls]))
    w, wb = np.zeros_like(m["w"]), np.zeros_like(m["wb"])
    np.add.at(w, cls, h[:, :, None] * b[:, None])
    np.add.at(wb, cls, b)
    assert np.allclose(grad["w"], w) and np.allclose(grad["wb"], wb) and np.allclose(grad["c"], h.T @ a)


def test_rows_of_repeated_ids_are_summed():
    rng = np.random.default_rng(4)
    ids = np.concatenate([rng.integers(0, 40, 200), np.full(90, 63), np.arange(41, 60)])
    rows = rng.normal(size=(3, len(ids), 5))
    table = rng.normal(size=(3, 64, 5))
    want = table.copy()
    for k, i in enumerate(ids):
        want[:, i] += rows[:, k]
    lm._add_rows(table, ids, rows)
    assert np.allclose(table, want)
