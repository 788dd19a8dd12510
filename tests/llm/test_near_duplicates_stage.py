"""The near-duplicates stage against brute force, with repeated and null ids."""
import numpy as np

from authsift.llm import neardup


def test_one_row_of_every_component_stays(spark):
    rng = np.random.default_rng(8)
    rows, group = [], {}
    for g in range(30):
        base = [f"w{k}" for k in rng.integers(0, 5000, 200)]
        for k in range(1 + g % 4):
            text = " ".join(base + [f"end{k}"] * (k > 0))
            group[text] = g
            i = int(rng.integers(0, 6))  # ids of one component recur in others
            rows += [(None if i == 0 or g % 5 == 0 else i, text)] * (1 + (g + k) % 2)
    rows += [(None, None), (None, ""), (1, "")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = [(r["doc_id"], r["text"]) for r in neardup.deduplicated(docs.repartition(4)).collect()]
    assert sorted(map(str, (r for r in got if not r[1]))) == sorted(map(str, (r for r in rows if not r[1])))
    kept = [(group[t], i) for i, t in got if t]
    ids = {g: [i for i, t in rows if t and group[t] == g and i is not None] for g in set(group.values())}
    assert sorted(kept, key=str) == sorted(((g, min(x) if x else None) for g, x in ids.items()), key=str)
    assert set(got) <= set(rows)


def test_components_end_once_every_node_hangs_on_the_least(spark, monkeypatch):
    rounds = []
    monkeypatch.setattr(neardup, "saved", lambda df: rounds.append(1) or df.localCheckpoint(eager=True))
    of = lambda edges: {r["node"]: r["label"] for r in neardup.components(
        spark.createDataFrame(edges, "a string, b string")).collect()}
    assert of([("b", "a"), ("a", "c"), ("c", "a"), ("e", "d"), ("f", "f")]) == {"b": "a", "c": "a", "e": "d"}
    assert len(rounds) == 1  # stars as they come: nothing is searched
    assert of([]) == {}
    rng = np.random.default_rng(3)
    names = [f"{k:03d}" for k in rng.permutation(60)]
    chain = [(names[k], names[k + 1]) for k in range(59) if k not in (20, 41)]
    want = {x: min(part) for part in (names[:21], names[21:42], names[42:]) for x in part if x != min(part)}
    assert of(chain) == want
