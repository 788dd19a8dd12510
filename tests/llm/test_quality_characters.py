"""The quality rules' language model is over real characters, whole at any number of trigrams."""
import math

import numpy as np

from authsift.llm import quality_rules


def _rows():
    rng = np.random.default_rng(5)
    words = ["привет", "мир", "книга", "дом", "город", "вода", "земля", "слово", "время", "река", "Лес", "небо"]
    letters = list("абвгдежзийклмнопрстуфхцчшщыьэюя")
    rows = [(k, " ".join(rng.choice(words, 70)), "ru") for k in range(60)]
    rows += [(100 + k, " ".join("".join(rng.choice(letters, 5)) for _ in range(70)), "ru") for k in range(3)]
    rows += [(200 + k, " ".join(rng.choice([f"{a}{b}" for a in ("one", "two", "three", "four", "five") for b in ("", "ly", "ing", "er", "s")], 70)), None) for k in range(20)]
    return rows + rows[:2] + [(300, None, "ru"), (301, "", None)]


def test_letters_of_any_script_are_told_apart(spark):
    docs = spark.createDataFrame(_rows(), "doc_id bigint, text string, lang string").repartition(3)
    kept = {r["doc_id"]: r["kept"] for r in quality_rules.verdicts(docs).collect()}
    assert [k for k in range(60) if not kept[k]] == []
    assert [k for k in range(100, 103) if kept[k]] == []  # the same letters and lengths at random
    assert all(kept[k] for k in range(200, 220)) and not kept[300] and not kept[301]


def test_rare_trigrams_are_joined(spark):
    docs = spark.createDataFrame(_rows(), "doc_id bigint, text string, lang string").repartition(3)
    get = lambda n: sorted((r["doc_id"], r["kept"], round(r["perplexity"] or 0, 6)) for r in quality_rules.verdicts(docs, frequent=n).collect())
    assert get(1 << 18) == get(40) == get(0)
    ids = lambda n: sorted(r["doc_id"] for r in quality_rules.filtered(docs, frequent=n).collect())
    assert ids(1 << 18) == ids(40) == sorted(i for i, k, _ in get(40) if k)


def test_model_is_that_of_the_formula(spark):
    rng = np.random.default_rng(2)
    key = np.unique(rng.integers(0, quality_rules.KEYS, 500))
    n = rng.integers(1, 9, len(key))
    want = 10.0 ** quality_rules.log_probability(quality_rules.fit(key, n), key).astype(float)
    c, bits = quality_rules.CLASSES, quality_rules.BITS
    wide = ((key // c // c) << 2 * bits) | ((key // c % c) << bits) | (key % c)
    grams = spark.createDataFrame([("=x", int(k), int(m)) for k, m in zip(wide, n)], "tag string, key bigint, n bigint")
    got = {r["key"]: 10.0 ** r["logp"] for r in quality_rules.modelled(grams, alphabet=c).collect()}
    assert len(got) == len(key) and all(math.isclose(got[int(k)], p, rel_tol=1e-4) for k, p in zip(wide, want))


def test_points_of_broken_text():
    raw = np.frombuffer("aé漢".encode() + b"\xff" + "b".encode(), np.uint8)
    p, o = quality_rules.points(raw, np.array([0, 6, 7, 8]))
    assert [chr(x) for x in p] == ["a", "é", "漢", "�", "b"] and o.tolist() == [0, 3, 4, 5]
