"""Conversation repair, token counts and fill-in-middle against brute force, the library and DuckDB."""
import hashlib
import random
import re
import zlib

import duckdb
import numpy as np
import pandas as pd
import public_tokenizers
import pytest
import sentencepiece
from pyspark.sql import functions as F

from authsift.llm import conversation_repair as repair
from authsift.llm import fill_in_middle as fim
from authsift.llm import sql
from authsift.llm import token_counts as tokens

MODEL = public_tokenizers.path("piece_bpe_32k.model")


def same(a: pd.DataFrame, b: pd.DataFrame) -> None:
    assert sorted(a.columns) == sorted(b.columns)
    plain = lambda x: sorted(tuple("~" if pd.isna(v) else str(int(v)) if isinstance(v, (int, float, np.number)) else str(v)
                                   for v in r) for r in x[sorted(x.columns)].itertuples(index=False))
    assert plain(a) == plain(b)


# ---------------------------------------------------------------- conversations

TALK = "conv_id bigint, turn bigint, role string, text string, ck string, block int, kind int, copies int"


def talks():
    rng = random.Random(5)
    rows = []
    for conv in [*range(60), None]:
        for turn in range(rng.choice([1, 2, 5, 9, 14, 30])):
            role = rng.choice(["user", "assistant", "user", "assistant", "system", "tool", "", None, "umpire"])
            text = rng.choice(["Hi there.", "Hi there.", "yes", "What?  \n", "\t ", "", None, "a. b! c?", f"t{turn}.", f"u{turn}"])
            row = (conv, rng.choice([turn, turn, turn, turn + 3, None]), role, text, "x", 1, 2, 3)
            rows += [row] * rng.choice([1, 1, 1, 2])
    rows += [(77, 1, "user", "Same.", "x", 1, 2, 3)] * 40
    return rows


def brute(rows):
    """Cost to the end from every place, then the least edit that keeps it; no shared code."""
    def last(t):
        return re.sub(r"[\x20\x09-\x0D]+\Z", "", t)[-1:]

    by: dict = {}
    for conv, turn, role, text, *_ in rows:
        role, text = " " if role is None else role, " " if text is None else text
        k = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        text = "" if k == 1 else re.sub("[.!?]", "", text) if k == 2 else text
        role = "user" if k == 4 else role
        by.setdefault(conv, []).extend([(turn is not None, turn, role, hashlib.sha256(text.encode()).hexdigest(), text)] * {0: 0, 3: 2}.get(k, 1))
    out = []
    for conv, lines in by.items():
        lines.sort(key=lambda r: (r[0], r[1] or 0, r[2], r[3]))
        seen, gone, cut, faults = set(), [], [], [0, 0, 0]
        for _, _, role, _, text in lines:
            f = 0 if not last(text) else 1 if (role, text) in seen else 2 if last(text) not in ".!?" else None
            seen.add((role, text))
            if f is not None:
                faults[f] += 1
            gone.append(f in (0, 1)), cut.append(f == 2)
        n = len(lines)
        after = {"n": {"u": "u", "s": "s"}, "s": {"u": "u"}, "u": {"a": "a"}, "a": {"u": "u"}}
        far = [{s: 10 ** 9 for s in "nsua"} for _ in range(n + 1)]

        def ways(i, s):
            if i < n:
                yield "D", 4, i + 1, s
            yield "I", 3, i, "a" if s == "u" else "u"
            if i < n and not gone[i]:
                x = 3 * cut[i]
                if (k := lines[i][2][:1]) in after[s]:
                    yield "K", x, i + 1, k
                yield "R", 3 + x, i + 1, "a" if s == "u" else "u"

        for i in range(n, -1, -1):
            if i == n:
                far[i] |= {"n": 0, "a": 0}
            for _ in range(4):
                for s in "nsua":
                    far[i][s] = min(far[i][s], *(c + far[j][t] for _, c, j, t in ways(i, s)))
        i, s, audit, text = 0, "n", "", []
        while i < n or far[i][s]:
            e, _, j, t = min((w for w in ways(i, s) if w[1] + far[w[2]][w[3]] == far[i][s]))
            if e == "I":
                text.append({"u": "user:", "a": "assistant:"}[t])
            elif e in "KR":
                text.append(f"{lines[i][2] if e == 'K' else {'u': 'user', 'a': 'assistant'}[t]}:{lines[i][4]}")
            audit, i, s = audit + e, j, t
        turns = [r[1] for r in lines if r[0]]
        pairs = [a[2][:1] + b[2][:1] for a, b in zip(lines, lines[1:])]
        out.append((conv, max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0, *faults,
                    sum(p not in ("su", "ua", "au") for p in pairs), far[0]["n"], audit, hashlib.sha256("\n".join(text).encode()).hexdigest()))
    return pd.DataFrame(out, columns=["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"])


@pytest.mark.parametrize("block", [3, repair.BLOCK])
def test_repair_against_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(repair, "BLOCK", block)  # small blocks: conversations run over many
    rows = talks()
    got = repair.repaired(spark.createDataFrame(rows, TALK).repartition(5)).toPandas()
    same(got, brute(rows))


def test_repair_against_sql(spark):
    conversations = pd.DataFrame(talks(), columns=[c.split()[0] for c in TALK.split(", ")])
    conversations = conversations.astype({"conv_id": "Int64", "turn": "Int64"})
    con = duckdb.connect()
    con.execute("CREATE TABLE conversations AS SELECT conv_id, turn, role, text FROM conversations WHERE conv_id < 77")
    same(repair.repaired(spark.createDataFrame([r for r in talks() if r[0] is not None and r[0] < 77], TALK)).toPandas(), con.sql(sql.TALKS).df())


def test_repair_of_nothing(spark):
    assert repair.repaired(spark.createDataFrame([], TALK)).count() == 0
    dropped = next(c for c in range(1000) if zlib.crc32(f"{c}:0".encode()) % 20 == 0)
    got = repair.repaired(spark.createDataFrame([(dropped, 0, "user", "x.", "", 0, 0, 0)], TALK)).collect()
    assert [tuple(r) for r in got] == [(dropped, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())]


def test_repair_of_one_very_long_conversation(spark):
    rows = [(1, t, "user" if t % 3 else "assistant", "one. " * (1000 if t == 7 else 1) + f"{t}.", "", 0, 0, 0) for t in range(5000)]
    same(repair.repaired(spark.createDataFrame(rows, TALK)).toPandas(), brute(rows))


@pytest.mark.parametrize("modulus", [(1 << 61) - 1, 2])
def test_audit_order(monkeypatch, modulus):
    monkeypatch.setattr(repair, "_MOD", modulus)  # 2: hashes say little, verification decides
    rng = random.Random(3)
    tree = repair.Audits()
    nodes = [0]
    for _ in range(600):
        nodes.append(tree.add(rng.choice(nodes[-40:]), rng.choice("DIKR")))
    for _ in range(3000):
        a, b = rng.choice(nodes), rng.choice(nodes)
        assert tree.less(a, b) == (tree.text(a) < tree.text(b))
    for n in nodes:
        assert len(tree.text(n)) == tree.depth[n]


# ---------------------------------------------------------------- tokens and fill-in-middle

DOCS = "doc_id bigint, text string, n bigint, form string, t string, n_tokens int, prefix_chars string"


def texts():
    rng = random.Random(2)
    sp = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    names = [sp.id_to_piece(k).replace("▁", " ") for k in range(259, 32000)]
    odd = [None, "", " ", "a", "  two  spaces ", " " * 100 + "the", "a" * 3000, "日本語のテキスト。漢字", "</s><s><unk>", "x\x00y\n\n\tz", "▁▁ x", "🙂é" * 40,
           "<P>", "a <M> b", "<", "<S", "P>" * 9, "<S><", "é" * 500, "word " * 9000, "αβγ 123,456.78 " * 30]
    return odd + ["".join(rng.choices(names, k=rng.randint(1, 200))) for _ in range(80)]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(None if k == 5 else k, t, 1, "f", "t", 2, "p") for k, t in enumerate(texts())]
    return spark.createDataFrame(rows + [rows[7], rows[30]], DOCS).repartition(3)


@pytest.mark.parametrize("size", [64, tokens.SLICE])
def test_token_counts_against_the_library(spark, docs, monkeypatch, size):
    monkeypatch.setattr(tokens, "SLICE", size)
    sp = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    got = tokens.counts(docs, MODEL, limit=50).collect()
    assert len(got) == docs.count()
    by_id = {i: t or "" for i, t in enumerate(texts())}
    for r in got:
        t = by_id[5 if r["doc_id"] is None else r["doc_id"]]
        n = len(sp.encode(t))
        assert (r["n_bytes"], r["n_tokens"], r["over_limit"]) == (len(t.encode()), n, n > 50)
        if len(t) < 1500:  # the longest prefix within the budget, by encoding every prefix
            assert r["fit_chars"] == max(p for p in range(len(t) + 1) if len(sp.encode(t[:p])) <= 50)


def test_stored_prefixes(spark, docs):
    sp = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    some = docs.where("length(text) < 400").select("doc_id", "text")
    c = F.col("prefix_tokens")
    got = tokens.stored(some, MODEL).select("*", tokens.fits(c, 20).alias("fit"), tokens.between(c, F.lit(3), F.size(c)).alias("rest")).collect()
    assert len(got) > 30
    for r in got:
        counts = [len(x) for x in sp.encode([r["text"][:p + 1] for p in range(len(r["text"]))])]
        assert r["prefix_tokens"] == counts
        assert r["fit"] == max([0] + [p + 1 for p, n in enumerate(counts) if n <= 20])
        if len(counts) > 3:
            assert r["rest"] == counts[-1] - counts[2]
    with pytest.raises(ValueError):
        tokens.stored(docs.withColumn("prefix_tokens", F.lit(1)), MODEL)


def test_a_long_segment_and_an_empty_table(spark, docs):
    sp = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    rng = random.Random(1)
    t = "".join(rng.choices("abcdefgh", k=300_000))  # no place to cut
    got = tokens.counts(spark.createDataFrame([(1, t)], "doc_id int, text string"), MODEL).first()
    assert got["n_tokens"] == len(sp.encode(t)) and got["over_limit"]
    assert len(sp.encode(t[:got["fit_chars"]])) <= tokens.LIMIT < len(sp.encode(t[:got["fit_chars"] + 1]))
    assert tokens.counts(docs.limit(0), MODEL).count() == 0 and fim.digest(docs.limit(0)).count() == 0


def test_fill_in_middle_against_sql(spark, docs):
    documents = pd.DataFrame([(r["doc_id"], r["text"]) for r in docs.collect()], columns=["doc_id", "text"]).astype({"doc_id": "Int64"})  # noqa: F841
    con = duckdb.connect()
    con.execute("CREATE TABLE documents AS SELECT CAST(doc_id AS BIGINT) AS doc_id, CASE WHEN typeof(text) = 'VARCHAR' THEN text END AS text FROM documents")
    got = fim.digest(docs).toPandas()
    same(got, con.sql(sql.FIM).df())
    assert set(got.form) == {"plain", "psm", "spm"}


def test_fill_in_middle_chunks_and_restoring(spark):
    rng = random.Random(4)
    shared = "".join(rng.choices("abc XYZ.é🙂\n12", k=4000))
    unit = re.compile("[A-Za-z]+|[^A-Za-z]")
    chunks = fim.Chunks()
    for k in range(60):
        t = "".join(rng.choices("ab z.é", k=rng.randint(0, 300))) + shared * (k % 3) + "q" * (k * 200)
        raw = t.encode()
        cuts, units = fim.Cuts(raw, chunks), unit.findall(t)
        assert cuts.n == len(units)
        for p in {0, len(units) // 3, max(len(units) - 1, 0), len(units)}:
            head = "".join(units[:p])
            assert cuts.at(p) == (len(head.encode()), len(head))
        out, form, *_ = fim.arranged(raw, k, chunks)
        assert fim.restored(out, form) == raw
    ends = fim.chunk_ends(np.frombuffer(shared.encode(), np.uint8))
    assert len(ends) > 5 and ends[-1] == len(shared.encode())
    again = fim.chunk_ends(np.frombuffer(("zzz" + shared).encode(), np.uint8))
    assert set(ends[1:] + 3) <= set(again)  # chunks depend on content, not place


def test_fill_in_middle_of_a_very_long_text(spark):
    t = ("lorem ipsum 42 " * 200 + "é") * 3500  # 10 MB
    docs = spark.createDataFrame([(8, t), (9, t)], "doc_id int, text string")
    for r in fim.digest(docs).collect():
        assert r["n"] == len(re.findall("[A-Za-z]+|[^A-Za-z]", t))
        assert r["restored_sha256"] == hashlib.sha256(t.encode()).hexdigest()
    out = fim.transformed(docs)
    assert out.columns == ["doc_id", "text", "fim_form"] and out.count() == 2
    with pytest.raises(ValueError):
        fim.transformed(docs.withColumn("fim_form", F.lit(1)))
