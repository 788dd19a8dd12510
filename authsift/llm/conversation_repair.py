r"""Conversation structure repair: the cheapest audit of edits that makes a conversation well formed.

A conversation's rows, in order of turn (nulls first, then role and the sha256 of the
text), are repaired so that the initials of their roles match `(s?(ua)+)?`.  Edits: Keep
(0), Rerole to user or assistant (3), Delete (4, required for blank rows and repeats),
Insert an empty user or assistant row (3); a truncated row that stays adds 3.  Of the
cheapest audits (the edits' initials in order) the ASCII-least is taken.

Method: a forward dynamic program over the states *nothing yet*, *system*, *user*,
*assistant*.  Each state's best audit so far is one linked node (:class:`Audits`):
audits share their prefixes, and a node has its depth, a rolling hash of its whole audit
and binary-lifting ancestors.  Equal costs are compared by a longest-common-prefix search over
hashes of ancestors; the prefixes found equal are verified node by node.

A conversation may hold any share of all rows.  Its distinct rows are numbered by
Spark over all partitions and cut into blocks of ``BLOCK`` rows; the program runs per block
from every state it may begin in, so a block gives one (cost, audit) for each pair of
states.  Blocks are then chained from the last to the first: two audits of a block that begin
in one state differ before either ends (no block ends with an insert), so the
least of the block decides alone.  Equal rows of one turn are one row with a number
of copies.  Only the last pass reads the texts in order, as the sha256 of the repaired
text needs: it streams a conversation through one task, with one audit in memory.

Edge cases: null id, turn, role or text stand as one space in the damage key, role and text; rows
with a null id are one conversation; a null turn comes first; rows of one turn that differ
are ordered as said; repeated rows are duplicates; a conversation whose rows are all
dropped, or an empty one, gives zeros, an empty audit and the hash of the empty text; an
empty role has no initial, so it can't be kept; very long texts are hashed by Spark and
streamed; further columns are ignored; an empty table gives no rows.
"""
from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from authsift.functions.ordering import number_rows
from authsift.llm.common import saved

KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 3, 4, 3, 3
BLOCK = 1024
SPACES = " \t\n\x0b\x0c\r"
START, SYSTEM, USER, ASSISTANT = range(4)
KEPT = {(START, "s"): SYSTEM, (START, "u"): USER, (SYSTEM, "u"): USER, (USER, "a"): ASSISTANT, (ASSISTANT, "u"): USER}
NEXT = {START: USER, SYSTEM: USER, USER: ASSISTANT, ASSISTANT: USER}
"""The state after a row that an edit gives its role."""
END = {START: (0, ""), SYSTEM: (2 * INSERT, "II"), USER: (INSERT, "I"), ASSISTANT: (0, "")}
"""Cost and audit that close a conversation from each state."""
ROLE = {USER: "user", ASSISTANT: "assistant"}

_MOD = (1 << 61) - 1
_BASE = 0x1F3D5B79A2C4E687 % _MOD


class Audits:
    """Audits as a tree of linked nodes; node 0 is the empty audit."""

    def __init__(self):
        self.letter, self.depth, self.hash, self.up = [""], [0], [0], [[]]

    def add(self, parent: int, letter: str) -> int:
        """The audit of ``parent`` and one more edit."""
        jumps, k = [parent], 0
        while k < len(self.up[jumps[k]]):  # the 2**k-th ancestors
            jumps.append(self.up[jumps[k]][k])
            k += 1
        self.letter.append(letter)
        self.depth.append(self.depth[parent] + 1)
        self.hash.append((self.hash[parent] * _BASE + ord(letter)) % _MOD)
        self.up.append(jumps)
        return len(self.letter) - 1

    def prefix(self, node: int, depth: int) -> int:
        """The ancestor that is the first ``depth`` edits."""
        far, k = self.depth[node] - depth, 0
        while far:
            if far & 1:
                node = self.up[node][k]
            far, k = far >> 1, k + 1
        return node

    def same(self, a: int, b: int) -> bool:
        """Whether two audits of one depth are equal: walks up until they share a node."""
        while a != b:
            if self.letter[a] != self.letter[b]:
                return False
            a, b = self.up[a][0], self.up[b][0]
        return True

    def less(self, a: int, b: int) -> bool:
        """Whether audit a is ASCII-less than b."""
        depth = min(self.depth[a], self.depth[b])
        x, y = self.prefix(a, depth), self.prefix(b, depth)
        if self.hash[x] == self.hash[y] and self.same(x, y):
            return self.depth[a] < self.depth[b]
        for k in range(len(self.up[x]) - 1, -1, -1):  # up to the first edit that differs
            if k < len(self.up[x]) and self.hash[self.up[x][k]] != self.hash[self.up[y][k]]:
                x, y = self.up[x][k], self.up[y][k]
        if self.letter[x] != self.letter[y] and self.same(self.up[x][0], self.up[y][0]):
            return self.letter[x] < self.letter[y]
        return self.text(a) < self.text(b)  # two audits with one hash

    def text(self, node: int) -> str:
        out = []
        while node:
            out.append(self.letter[node])
            node = self.up[node][0]
        return "".join(reversed(out))


def best_audits(rows: list[tuple[str, int, bool, bool]], start: int) -> list[tuple[int, str] | None]:
    """(cost, audit) to each state behind the rows, beginning in state ``start``.

    A row is (initial, copies, whether its first copy must go, whether it is truncated); further
    copies must go.  No audit ends with an insert.  An insert directly before a delete is
    never tried: the other order costs the same and is less.
    """
    audits = Audits()
    now: list[tuple[int, int] | None] = [None] * 4
    now[start] = (0, 0)

    def offer(to: list, state: int, cost: int, parent: int, letter: str) -> None:
        held = to[state]
        if held is None or cost < held[0]:
            to[state] = (cost, audits.add(parent, letter))
        elif cost == held[0]:
            node = audits.add(parent, letter)
            if audits.less(node, held[1]):
                to[state] = (cost, node)

    for initial, copies, must_go, truncated in rows:
        for copy in range(copies):
            to: list[tuple[int, int] | None] = [None] * 4
            for state, held in enumerate(now):
                if held is not None:
                    offer(to, state, held[0] + DELETE, held[1], "D")
            if not (must_go or copy):
                opened = list(now)
                for state in (START, SYSTEM, ASSISTANT):
                    if now[state] is not None:
                        offer(opened, USER, now[state][0] + INSERT, now[state][1], "I")
                if opened[USER] is not None:
                    offer(opened, ASSISTANT, opened[USER][0] + INSERT, opened[USER][1], "I")
                extra = TRUNCATED if truncated else 0
                for state, held in enumerate(opened):
                    if held is None:
                        continue
                    if (state, initial) in KEPT:
                        offer(to, KEPT[state, initial], held[0] + KEEP + extra, held[1], "K")
                    else:
                        offer(to, NEXT[state], held[0] + REROLE + extra, held[1], "R")
            now = to
    return [None if held is None else (held[0], audits.text(held[1])) for held in now]


def damaged(rows: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """conv_id, turn, role, text, copies after damage; a dropped row has 0 copies."""
    space = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    k = F.crc32(F.concat(space(conv), F.lit(":"), space(turn)).cast("binary")) % 20
    return rows.select(F.col(conv).alias("conv_id"), F.col(turn).cast("bigint").alias("turn"), space(role).alias("role"),
                       space(text).alias("text"), k.alias("k")).select(
        "conv_id", "turn", F.when(F.col("k") == 4, F.lit("user")).otherwise(F.col("role")).alias("role"),
        F.when(F.col("k") == 1, F.lit("")).when(F.col("k") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text")).alias("text"),
        F.when(F.col("k") == 0, 0).when(F.col("k") == 3, 2).otherwise(1).alias("copies"))


def _initial(role: Column) -> Column:
    return F.substring(role, 1, 1)


_BLOCK = "ck string, block bigint, turn bigint, role string, kh string, blank bigint, duplicate bigint, truncated bigint, " \
         "moves array<struct<start:int,stop:int,cost:bigint,audit:string>>"
_CHOICE = "ck string, turn bigint, role string, kh string, blank bigint, duplicate bigint, truncated bigint, cost bigint, " \
          "stops array<int>, audits array<string>"
_OUT = "gaps bigint, blank bigint, duplicate bigint, truncated bigint, illegal bigint, cost bigint, audit string, repaired_sha256 string"


def _arrow(ddl: str) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema
    return to_arrow_schema(T.StructType.fromDDL(ddl))


def _batches(rows: Iterator[dict], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    held, size = [], 0
    for r in rows:
        held.append(r)
        size += sum(len(x) for x in (r.get("audit"), *(m["audit"] for m in r.get("moves", ())), *r.get("audits", ())) if x)
        if size > 1 << 20 or len(held) == 4096:
            yield pa.RecordBatch.from_pylist(held, schema=schema)
            held, size = [], 0
    if held:
        yield pa.RecordBatch.from_pylist(held, schema=schema)


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    for b in batches:
        yield from zip(*(c.to_pylist() for c in b.columns))


def blocks(rows: DataFrame) -> DataFrame:
    """Faults and best audits of every block of a conversation's distinct rows (``_BLOCK``)."""
    there = rows.where("copies > 0").select("ck", "turn", "role", F.sha2(F.col("text").cast("binary"), 256).alias("kh"), "copies",
                                           F.rtrim(F.col("text"), F.lit(SPACES)).alias("x")) \
        .groupBy("ck", "turn", "role", "kh").agg(
            F.sum("copies").alias("copies"), F.max(F.col("x") == "").alias("blank"),
            F.max(~F.right(F.col("x"), F.lit(1)).isin(".", "!", "?")).alias("cut"))
    first = there.groupBy("ck", "role", "kh").agg(F.max(F.col("turn").isNull()).alias("no_turn"), F.min("turn").alias("first"))
    seen = F.when(F.col("no_turn"), F.col("turn").isNotNull()).otherwise(F.col("turn") > F.col("first"))
    flagged = there.join(first, ["ck", "role", "kh"]).select("ck", "turn", "role", "kh", "copies", "blank", seen.alias("seen"), "cut")
    numbered = number_rows(flagged, [F.col("turn").asc_nulls_first(), "role", "kh"], ["ck"], "pos") \
        .withColumn("block", F.floor((F.col("pos") - 1) / BLOCK))
    schema = _arrow(_BLOCK)

    def solved(ck, block, rows):
        _, _, _, turn, role, kh, *_ = rows[0]
        out = {"ck": ck, "block": block, "turn": turn, "role": role, "kh": kh, "blank": 0, "duplicate": 0, "truncated": 0, "moves": []}
        line = []
        for _, _, _, _, role, _, copies, blank, seen, cut in rows:
            out["blank"] += copies if blank else 0
            out["duplicate"] += 0 if blank else copies if seen else copies - 1
            out["truncated"] += int(cut and not blank and not seen)
            line.append((role[:1], copies, blank or seen, cut))
        for start in (START,) if block == 0 else (START, SYSTEM, USER, ASSISTANT):
            for stop, got in enumerate(best_audits(line, start)):
                if got is not None:
                    out["moves"].append({"start": start, "stop": stop, "cost": got[0], "audit": got[1]})
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def each():
            key, held = None, []
            for r in _rows(batches):
                if r[:2] != key and held:
                    yield solved(*key, held)
                    held = []
                key = r[:2]
                held.append(r)
            if held:
                yield solved(*key, held)
        return _batches(each(), schema)

    return numbered.select("ck", "block", "pos", "turn", "role", "kh", "copies", "blank", "seen", "cut") \
        .repartition("ck", "block").sortWithinPartitions("ck", "block", "pos").mapInArrow(run, _BLOCK)


def choices(blocks: DataFrame) -> DataFrame:
    """Per block and state to begin in, the audit of the best way to the conversation's end (``_CHOICE``).

    Streams a conversation's blocks, the last first, with the cost to the end from each state.
    """
    schema = _arrow(_CHOICE)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def each():
            at, ahead, last = None, {}, False
            for ck, _, turn, role, kh, blank, duplicate, truncated, moves in _rows(batches):
                if last := ck != at:
                    at, ahead = ck, {s: c for s, (c, _) in END.items()}
                best: list[tuple | None] = [None] * 4
                for m in moves:
                    if m["stop"] in ahead:
                        way = (m["cost"] + ahead[m["stop"]], m["audit"], m["stop"])
                        if best[m["start"]] is None or way < best[m["start"]]:
                            best[m["start"]] = way
                ahead = {s: w[0] for s, w in enumerate(best) if w}
                yield {"ck": ck, "turn": turn, "role": role, "kh": kh, "blank": blank, "duplicate": duplicate, "truncated": truncated,
                       "cost": ahead.get(START), "stops": [w[2] if w else None for w in best],
                       "audits": [(w[1] + (END[w[2]][1] if last else "")) if w else None for w in best]}
        return _batches(each(), schema)

    return blocks.repartition("ck").sortWithinPartitions("ck", F.col("block").desc()).mapInArrow(run, _CHOICE)


class _Repair:
    """One conversation as its rows and choices stream by."""

    def __init__(self, conv_id):
        self.conv_id, self.cost, self.state, self.edits, self.sha = conv_id, None, START, iter(()), hashlib.sha256()
        self.audit: list[str] = []
        self.faults = [0, 0, 0]
        self.lines = self.illegal = self.turns = 0
        self.initial = self.low = self.high = None

    def choose(self, faults, cost, stops, audits) -> None:
        if self.cost is None:
            self.cost = cost
        self.faults = [a + b for a, b in zip(self.faults, faults)]
        self.audit.append(audits[self.state])
        self.edits = iter(self.audit[-1])

    def line(self, role: str, text: str) -> None:
        self.sha.update(f"{chr(10) if self.lines else ''}{role}:{text}".encode())
        self.lines += 1

    def given(self) -> str:
        """The role that an edit gives next."""
        self.state = NEXT[self.state]
        return ROLE[self.state]

    def row(self, turn, role, text) -> None:
        if turn is not None and turn != self.high:
            self.low = turn if self.low is None else self.low
            self.high = turn
            self.turns += 1
        if self.initial is not None and self.initial + role[:1] not in ("su", "ua", "au"):
            self.illegal += 1
        self.initial = role[:1]
        while (edit := next(self.edits)) == "I":
            self.line(self.given(), "")
        if edit == "K":
            self.state = KEPT[self.state, role[:1]]
            self.line(role, text)
        elif edit == "R":
            self.line(self.given(), text)

    def done(self) -> dict:
        for _ in self.edits:  # inserts behind the last row
            self.line(self.given(), "")
        blank, duplicate, truncated = self.faults
        return {"conv_id": self.conv_id, "gaps": self.high - self.low + 1 - self.turns if self.turns else 0,
                "blank": blank, "duplicate": duplicate, "truncated": truncated, "illegal": self.illegal,
                "cost": self.cost or 0, "audit": "".join(self.audit), "repaired_sha256": self.sha.hexdigest()}


def repaired(conversations: DataFrame, **columns) -> DataFrame:
    """Per conversation: its faults after damage, the cheapest repair, and the repaired text's sha256."""
    ck = F.when(F.col("conv_id").isNull(), F.lit("n")).otherwise(F.concat(F.lit("v"), F.col("conv_id").cast("string")))
    rows = damaged(conversations, **columns).withColumn("ck", ck)
    chosen = saved(choices(blocks(rows)))
    no = lambda kind: F.lit(None).cast(kind)
    parts = ["blank", "duplicate", "truncated", "cost", "stops", "audits"]
    texts = rows.select("ck", "turn", "role", F.sha2(F.col("text").cast("binary"), 256).alias("kh"),
                        F.when(F.col("copies") > 0, 1).otherwise(2).alias("kind"), "conv_id", "text", "copies",
                        *(no(f.dataType).alias(f.name) for f in chosen.schema if f.name in parts))
    heads = chosen.select("ck", "turn", "role", "kh", F.lit(0).alias("kind"), no(rows.schema["conv_id"].dataType).alias("conv_id"),
                          no("string").alias("text"), F.lit(0).alias("copies"), *parts)
    out = T.StructType([rows.schema["conv_id"], *T.StructType.fromDDL(_OUT).fields])
    from pyspark.sql.pandas.types import to_arrow_schema
    schema = to_arrow_schema(out)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def each():
            at, one = None, None
            for ck, turn, role, _, kind, conv_id, text, copies, blank, duplicate, truncated, cost, stops, audits in _rows(batches):
                if ck != at:
                    if one is not None:
                        yield one.done()
                    at, one = ck, _Repair(None)
                if kind == 0:
                    one.choose((blank, duplicate, truncated), cost, stops, audits)
                else:
                    one.conv_id = conv_id
                    for _ in range(copies):
                        one.row(turn, role, text)
            if one is not None:
                yield one.done()
        return _batches(each(), schema)

    return texts.unionByName(heads).repartition("ck") \
        .sortWithinPartitions("ck", F.col("turn").asc_nulls_first(), "role", "kh", "kind").mapInArrow(run, out)
