r"""Secret scan with multipart credential linking (DataFrame functions only).

Base kinds, leftmost and non-overlapping each: ``assign`` (a key word, ``=`` or
``:``, a value of 8 or more characters), ``access`` (an ``AKIA`` identifier of 16
or more), ``hex`` (32 or more hex digits).  A text is split at a kind's matches;
the lengths of the pieces and matches give the positions, in code points.

Linking.  A credential often comes in parts that mean little alone:

* ``identifier``: ``user``, ``username``, ``login``, ``client_id``,
  ``access_key_id`` or ``account`` with a value, or a base ``access`` match;
* ``weak`` secret: a ``pass``, ``pwd``, ``key``, ``credential``, ``password`` ...
  value of 4 or more characters, or a mixed run of 20 or more base64 characters;
* ``endpoint``: a URL or ``host``/``server``/``endpoint`` with a value.

The parts are intervals within scopes.  A scope is a paragraph (text between
blank lines); an interval reaches ``reach`` characters to either side, not
beyond its scope; a part may be of any length.  Parts are joined on (row, scope, cell of
``reach`` characters) with the interval condition, as semi-joins, so a part is emitted
once however many partners it has; a part lies in as many cells as it is long.  A weak secret is reported only if an
identifier is in reach; an identifier only if a secret (weak or base) is; an
endpoint only if both an identifier and a secret are.  Weak parts that overlap a
base span are not reported again.

Edge cases: null and empty texts have no spans (the hash is that of the empty
string); a null id is kept; repeated rows each get a result; extra columns are
ignored; very long texts are scanned whole within their row; an empty table gives an
empty result.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from authsift.llm.common import saved

# -- fixed values: the base kinds, in order --------------------------------
ASSIGN = (r"([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]"
          r"|[Aa][Pp][Ii]_?[Kk][Ee][Yy])[\x22\x27]?\x20*[:=]\x20*[\x22\x27]?([A-Za-z0-9+/_.=-]+)")
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]{32,}"
BASE = ("assign", "access", "hex")
# -- parts of the linking ---------------------------------------------------
IDENTIFIER = (r"\b(?i:user(?:_?name|_?id)?|login|client_?id|access_?key_?id|account)\b[\x22\x27]?\x20*[:=]\x20*[\x22\x27]?"
              r"([A-Za-z0-9@+/_.=-]{3,})")
WEAK = (r"\b(?i:pass|pwd|pass_?phrase|password|passwd|secret|secret_?key|private_?key|key|credential|auth)\b"
        r"[\x22\x27]?\x20*[:=]\x20*[\x22\x27]?([^\x00-\x20\x22\x27]{4,})")
BLOB = r"[A-Za-z0-9+/]{20,}"  # a weak secret if it mixes digits, capitals and small letters
ENDPOINT = (r"\b[a-z][a-z0-9+.-]{1,20}://[^\x00-\x20\x22\x27<>]{3,}"
            r"|\b(?i:host|hostname|server|endpoint)\b[\x22\x27]?\x20*[:=]\x20*[\x22\x27]?[A-Za-z0-9_.:-]{3,}")
LINKED = ("identifier", "weak", "endpoint")
PARAGRAPH = r"\n[\x20\t\r]*\n"
REACH = 200

SPAN = "array<struct<start:int,rank:int,kind:string,end:int>>"


def found(text: Column, pattern: str, kind: str, rank: int, ok=None, group: int = 0) -> Column:
    """Spans of a pattern's matches: running sums over the pieces between matches and the matches.

    ``ok`` judges the text of ``group`` of a match; failing matches are dropped
    after matching, so they are not retried.
    """
    whole = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    gaps = F.transform(F.split(text, pattern, -1), lambda g: F.length(g))
    if group:
        part = F.regexp_extract_all(text, F.lit(pattern), F.lit(group))
        whole = F.zip_with(whole, part, lambda m, g: F.struct(m.alias("m"), g.alias("g")))
    else:
        whole = F.transform(whole, lambda m: F.struct(m.alias("m"), m.alias("g")))
    steps = F.zip_with(whole, gaps, lambda x, gap: F.struct(x["m"].alias("m"), x["g"].alias("g"), gap.alias("gap")))
    steps = F.filter(steps, lambda x: x["m"].isNotNull())
    first = F.struct(F.lit(0).alias("at"), F.array().cast(SPAN).alias("spans"))

    def add(acc: Column, x: Column) -> Column:
        start = acc["at"] + x["gap"]
        end = start + F.length(x["m"])
        span = F.array(F.struct(start.cast("int").alias("start"), F.lit(rank).alias("rank"), F.lit(kind).alias("kind"),
                                end.cast("int").alias("end"))).cast(SPAN)
        kept = F.concat(acc["spans"], span)
        if ok is not None:
            kept = F.when(ok(x["g"]), kept).otherwise(acc["spans"])
        return F.struct(end.cast("int").alias("at"), kept.alias("spans"))

    spans = F.aggregate(steps, first, add, lambda acc: acc["spans"])
    return F.when(text.rlike(pattern), spans).otherwise(F.array().cast(SPAN))


def text_of(spans: Column) -> Column:
    """kind:start:end by start, then kind as listed, comma-joined."""
    return F.array_join(F.transform(F.array_sort(spans), lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def scan(docs: DataFrame, text: str = "text", id_col: str = "doc_id", reach: int = REACH) -> DataFrame:
    """One row per row of ``docs``: id, base spans and linked spans as arrays of (start, rank, kind, end)."""
    t = F.coalesce(F.col(text), F.lit(""))
    mixed = lambda m: m.rlike("[0-9]") & m.rlike("[A-Z]") & m.rlike("[a-z]")
    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("id"), t.alias("t"))
    rows = rows.select(
        "row", "id",
        F.concat(found(F.col("t"), ASSIGN, "assign", 0, lambda g: F.length(g) >= 8, group=2),
                 found(F.col("t"), ACCESS, "access", 1, lambda m: F.length(m) >= 16),
                 found(F.col("t"), HEX, "hex", 2)).alias("base"),
        F.concat(found(F.col("t"), IDENTIFIER, "identifier", 3), found(F.col("t"), WEAK, "weak", 4),
                 found(F.col("t"), BLOB, "weak", 4, mixed),
                 found(F.col("t"), ENDPOINT, "endpoint", 5)).alias("parts"),
        F.transform(found(F.col("t"), PARAGRAPH, "cut", 9), lambda s: s["start"]).alias("cuts"))
    rows = saved(rows)  # spans only; the texts are read once

    # every part with its scope; a base access key is an identifier, other base spans are secrets
    parts = rows.where(F.size("parts") > 0).select(
        "row", "cuts", F.explode(F.concat("parts", "base")).alias("s")).select(
        "row", "cuts", "s.*", F.when(F.col("s.kind").isin("identifier", "access"), "identifier")
        .when(F.col("s.kind") == "endpoint", "endpoint").otherwise("secret").alias("part"))
    parts = parts.withColumn("scope", F.size(F.filter("cuts", lambda c: c <= F.col("start")))).drop("cuts")
    # a partner within reach has a cell in common with the part widened by the reach
    cell = lambda c: F.floor(c / reach)
    wide = parts.withColumn("cell", F.explode(F.sequence(cell(F.col("start") - reach), cell(F.col("end") + reach))))
    place = parts.select("row", "scope", F.explode(F.sequence(cell(F.col("start")), cell(F.col("end")))).alias("cell"),
                         "start", "end", "part")

    def near(of: DataFrame, part: str) -> DataFrame:
        b = place.where(F.col("part") == part).select(*(F.col(c).alias("b_" + c) for c in ("row", "scope", "cell", "start", "end")))
        return of.join(b, (of["row"] == b["b_row"]) & (of["scope"] == b["b_scope"]) & (of["cell"] == b["b_cell"])
                       & (of["start"] <= b["b_end"] + reach) & (b["b_start"] <= of["end"] + reach)
                       & ((of["end"] <= b["b_start"]) | (b["b_end"] <= of["start"])), "left_semi")

    key = ["row", "start", "end", "kind", "rank"]
    weak = near(wide.where("kind = 'weak'"), "identifier").select(key).distinct()
    idents = near(wide.where("kind = 'identifier'"), "secret").select(key).distinct()
    ends = wide.where("kind = 'endpoint'")
    ends = near(ends, "identifier").select(key).distinct().intersect(near(ends, "secret").select(key).distinct())
    linked = weak.unionByName(idents).unionByName(ends).groupBy("row").agg(
        F.collect_list(F.struct("start", F.col("rank"), "kind", "end")).alias("linked"))
    out = rows.select("row", "id", "base").join(linked, "row", "left")
    linked_spans = F.filter(F.coalesce("linked", F.array().cast(SPAN)), lambda s: ~F.exists(
        "base", lambda b: (b["start"] < s["end"]) & (s["start"] < b["end"])))
    return out.select(F.col("id").alias(id_col), "base", linked_spans.alias("linked"))


def digest(docs: DataFrame, id_col: str = "doc_id", **options) -> DataFrame:
    """Counts and span texts per row."""
    s = scan(docs, id_col=id_col, **options)
    n = lambda spans, kind: F.size(F.filter(spans, lambda x: x["kind"] == kind)).cast("bigint").alias(f"n_{kind}")
    return s.select(id_col, *(n("base", k) for k in BASE),
                    F.sha2(text_of(F.col("base")).cast("binary"), 256).alias("base_sha256"),
                    text_of(F.concat("base", "linked")).alias("spans"), *(n("linked", k) for k in LINKED))
