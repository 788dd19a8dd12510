"""DuckDB SQL of the operators that SQL can express, over the given tables."""
from __future__ import annotations

from authsift.llm import mixing, secrets

_Q = lambda s: "'" + s.replace("'", "''") + "'"

MIX = f"""
WITH d AS (SELECT doc_id, coalesce('s' || source, 't') AS skey,
                  len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS size,
                  md5(coalesce(CAST(doc_id AS VARCHAR), '')) AS h
           FROM documents),
s AS (SELECT skey, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY skey),
w AS (SELECT *, (row_number() OVER (ORDER BY skey) - 1) % 3 + 1 AS weight FROM s),
l AS (SELECT *, row_number() OVER lv AS nth,
             CAST(sum(source_size) OVER () - {mixing.MAX_COPIES} * coalesce(sum(source_size) OVER (lv ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS DOUBLE)
             / CAST(sum(weight) OVER (lv ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS DOUBLE) AS level
      FROM w WINDOW lv AS (ORDER BY source_size / weight, skey)),
x AS (SELECT level FROM l WHERE level * weight <= {mixing.MAX_COPIES} * CAST(source_size AS DOUBLE) ORDER BY nth LIMIT 1),
t AS (SELECT skey, source_size,
             least((SELECT level FROM x) * weight, {mixing.MAX_COPIES} * CAST(source_size AS DOUBLE)) AS target FROM l),
k AS (SELECT d.*, source_size, target, size * {mixing.LARGE_PART} > source_size AS large,
             row_number() OVER (PARTITION BY skey, size * {mixing.LARGE_PART} > source_size ORDER BY size, h, doc_id) AS k
      FROM d JOIN t USING (skey)),
big AS (SELECT skey, sum(size * (floor(k * target / CAST(source_size AS DOUBLE) + {mixing.OFFSET}::DOUBLE)
                               - floor((k - 1) * target / CAST(source_size AS DOUBLE) + {mixing.OFFSET}::DOUBLE))) FILTER (large) AS large_taken,
               CAST(sum(size) FILTER (NOT large) AS DOUBLE) AS small_size FROM k GROUP BY skey),
f AS (SELECT k.*, CASE WHEN large THEN target ELSE least(greatest(target - coalesce(large_taken, 0), 0.0), {mixing.MAX_COPIES} * small_size) END AS words_out,
             CASE WHEN large THEN CAST(source_size AS DOUBLE) ELSE small_size END AS words_in FROM k JOIN big USING (skey))
SELECT doc_id, CAST(size AS BIGINT) AS size, source_size, target,
       CAST(CASE WHEN size > 0 THEN least(floor(k * words_out / words_in + {mixing.OFFSET}::DOUBLE)
                 - floor((k - 1) * words_out / words_in + {mixing.OFFSET}::DOUBLE), {mixing.MAX_COPIES}) ELSE 0 END AS BIGINT) * size AS taken
FROM f"""


def _found(name: str, pattern: str, kind: str, rank: int, ok: str = "true", group: int = 0) -> str:
    p = _Q(pattern)
    return f"""
{name}_m AS (SELECT r, unnest(range(1, len(m) + 1)) AS i, unnest(m) AS m, unnest(g) AS g, unnest(p[:len(m)]) AS gap
  FROM (SELECT r, regexp_extract_all(t, {p}) AS m, regexp_extract_all(t, {p}, {group}) AS g, regexp_split_to_array(t, {p}) AS p
        FROM d WHERE regexp_matches(t, {p}))),
{name} AS (SELECT r, e - length(m) AS s, e, {rank} AS k, '{kind}' AS kind FROM (
  SELECT *, sum(length(gap) + length(m)) OVER (PARTITION BY r ORDER BY i) AS e FROM {name}_m) WHERE {ok})"""


_R = secrets.REACH
SECRETS = "WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents)," + ",".join([
    _found("assign_", secrets.ASSIGN, "assign", 0, "length(g) >= 8", 2),
    _found("access_", secrets.ACCESS, "access", 1, "length(m) >= 16"),
    _found("hex_", secrets.HEX, "hex", 2),
    _found("ident_", secrets.IDENTIFIER, "identifier", 3),
    _found("weak_", secrets.WEAK, "weak", 4),
    _found("blob_", secrets.BLOB, "weak", 4, "regexp_matches(m, '[0-9]') AND regexp_matches(m, '[A-Z]') AND regexp_matches(m, '[a-z]')"),
    _found("end_", secrets.ENDPOINT, "endpoint", 5),
    _found("cut_", secrets.PARAGRAPH, "cut", 9),
]) + f""",
base AS (FROM assign_ UNION ALL FROM access_ UNION ALL FROM hex_),
raw AS (FROM ident_ UNION ALL FROM weak_ UNION ALL FROM blob_ UNION ALL FROM end_),
parts AS (SELECT x.*, CASE WHEN kind IN ('identifier', 'access') THEN 'i' WHEN kind = 'endpoint' THEN 'e' ELSE 's' END AS part,
                 (SELECT count(*) FROM cut_ c WHERE c.r = x.r AND c.s <= x.s) AS scope
          FROM (FROM base UNION ALL FROM raw) x),
pairs AS (SELECT DISTINCT a.r, a.s, a.e, a.k, a.kind, b.part FROM parts a JOIN parts b ON a.r = b.r AND a.scope = b.scope
          AND a.s <= b.e + {_R} AND b.s <= a.e + {_R} AND (a.e <= b.s OR b.e <= a.s) WHERE a.k >= 3),
linked AS (SELECT DISTINCT r, s, e, k, kind FROM pairs p WHERE
             ((kind = 'weak' AND part = 'i') OR (kind = 'identifier' AND part = 's')
              OR (kind = 'endpoint' AND part = 'i' AND EXISTS (FROM pairs q WHERE q.r = p.r AND q.s = p.s AND q.e = p.e
                                                               AND q.kind = 'endpoint' AND q.part = 's')))
           AND NOT EXISTS (FROM base b WHERE b.r = p.r AND b.s < p.e AND p.s < b.e)),
spans AS (FROM base UNION ALL FROM linked),
per AS (SELECT r, count(*) FILTER (k = 0) AS a, count(*) FILTER (k = 1) AS b, count(*) FILTER (k = 2) AS c,
               count(*) FILTER (k = 3) AS i, count(*) FILTER (k = 4) AS w, count(*) FILTER (k = 5) AS n,
               string_agg(kind || ':' || s || ':' || e, ',' ORDER BY s, k, e) FILTER (k < 3) AS base,
               string_agg(kind || ':' || s || ':' || e, ',' ORDER BY s, k, e) AS spans FROM spans GROUP BY r)
SELECT doc_id, coalesce(a, 0) AS n_assign, coalesce(b, 0) AS n_access, coalesce(c, 0) AS n_hex,
       sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans,
       CAST(coalesce(i, 0) AS INTEGER) AS n_identifier, CAST(coalesce(w, 0) AS INTEGER) AS n_weak,
       CAST(coalesce(n, 0) AS INTEGER) AS n_endpoint
FROM d LEFT JOIN per USING (r)"""


_WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
LEAKS = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id,
                  regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{_WORD}') AS w
           FROM documents),
i AS (SELECT CAST(item_id AS VARCHAR) AS item, regexp_extract_all(
             translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{_WORD}') AS w FROM benchmark),
iw AS (SELECT DISTINCT item, least(len(w), 10) AS n, array_to_string(w[p:p + least(len(w), 10) - 1], ' ') AS g
       FROM (SELECT *, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS p FROM i WHERE len(w) > 0)),
ns AS (SELECT DISTINCT n FROM iw),
dw AS (SELECT r, n, p, array_to_string(w[p:p + n - 1], ' ') AS g
       FROM (SELECT r, w, n, unnest(range(1, len(w) - n + 2)) AS p FROM d, ns WHERE len(w) >= n)),
h AS (SELECT r, dw.n, p, item FROM dw JOIN iw ON dw.n = iw.n AND dw.g = iw.g),
hit AS (SELECT r, count(DISTINCT pos) AS n_hit FROM (SELECT r, unnest(range(p, p + n)) AS pos FROM h) GROUP BY r),
it AS (SELECT r, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT r, item FROM h WHERE item IS NOT NULL) GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN hit USING (r) LEFT JOIN it USING (r)"""

NEAR = """
WITH RECURSIVE d AS (SELECT row_number() OVER () AS r, doc_id,
                  regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS w
           FROM documents),
g AS (SELECT DISTINCT r, array_to_string(w[p:p + 2], ' ') AS s
      FROM (SELECT r, w, unnest(range(1, greatest(len(w) - 2, 1) + 1)) AS p FROM d WHERE len(w) > 0)),
n AS (SELECT r, count(*) AS n FROM g GROUP BY r),
x AS (SELECT a.r AS a, b.r AS b, count(*) AS shared FROM g a JOIN g b ON a.s = b.s AND a.r <> b.r GROUP BY ALL),
l AS (SELECT a, b FROM x JOIN n m ON x.a = m.r JOIN n k ON x.b = k.r WHERE 100 * shared >= 85 * (m.n + k.n - shared)),
c AS (SELECT r, r AS o FROM d UNION SELECT c.r, l.b FROM c JOIN l ON c.o = l.a),
k AS (SELECT c.r, min(d.doc_id) AS component_id FROM c JOIN d ON c.o = d.r GROUP BY c.r)
SELECT doc_id, coalesce(n, 0) AS n_shingles, component_id, doc_id IS NOT DISTINCT FROM component_id AS kept
FROM d LEFT JOIN n USING (r) JOIN k USING (r)"""


_H = "CAST('0x' || substr(sha256('1:' || coalesce(CAST(doc_id AS VARCHAR), '')), {}, 8) AS BIGINT)"
FIM = f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[A-Za-z]+|[^A-Za-z]') AS u,
                  {_H.format(1)} AS h1, {_H.format(9)} AS h2, {_H.format(17)} AS h3, {_H.format(25)} AS h4 FROM documents),
c AS (SELECT *, CAST(len(u) AS BIGINT) AS n, least(h1 % (len(u) + 1), h2 % (len(u) + 1)) AS a,
             greatest(h1 % (len(u) + 1), h2 % (len(u) + 1)) AS b,
             CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 % 100 >= 90 THEN 'plain'
                  WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM d),
p AS (SELECT *, array_to_string(u[:a], '') AS pre, array_to_string(u[a + 1:b], '') AS mid, array_to_string(u[b + 1:], '') AS suf FROM c),
o AS (SELECT *, CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || pre || '<S>' || suf || '<M>' || mid
                          ELSE '<S>' || suf || '<P>' || pre || '<M>' || mid END AS out FROM p),
r AS (SELECT *, CASE WHEN form = 'psm' THEN strpos(out, '<S>') WHEN form = 'spm' THEN strpos(out, '<P>') END AS i,
             strpos(out, '<M>') AS m FROM o)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(pre) END AS prefix_chars,
       CASE WHEN form <> 'plain' THEN length(mid) END AS middle_chars, sha256(out) AS output_sha256,
       sha256(CASE form WHEN 'plain' THEN out
                        WHEN 'psm' THEN substr(out, 4, i - 4) || substr(out, m + 3) || substr(out, i + 3, m - i - 3)
                        ELSE substr(out, i + 3, m - i - 3) || substr(out, m + 3) || substr(out, 4, i - 4) END) AS restored_sha256
FROM r"""


def _edit(held: str, cost: str, letter: str, line: str) -> str:
    """The state's struct (cost, audit, repaired lines) after one edit."""
    return f"{{'c': {held}.c + {cost}, 'a': {held}.a || '{letter}', 'o': {line}}}"


_LINE = "{}.o || CASE WHEN {}.o = '' THEN '' ELSE chr(10) END || {}"  # a line holds its colon, so only no lines are ''
_INS = lambda h, role: _edit(h, "3", "I", _LINE.format(h, h, f"'{role}:'"))
_ROW = lambda h, cost, letter, role: f"CASE WHEN r.gone THEN {_FAR} ELSE {_edit(h, f'{cost} + r.extra', letter, _LINE.format(h, h, f'{role} || chr(58) || r.t'))} END"
_FAR = "{'c': 1000000000::BIGINT, 'a': '', 'o': ''}"
_LEAST = lambda *xs: f"list_sort([{', '.join(xs)}])[1]"
_IF = lambda initial, h: f"CASE WHEN r.i = '{initial}' THEN {_ROW(h, 0, 'K', 'r.role')} ELSE {_FAR} END"
_DEL = lambda h: _edit(h, "4", "D", f"{h}.o")

TALKS = f"""
WITH RECURSIVE crc AS (SELECT [list_reduce(list_prepend(k, range(8)), lambda x, y: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END)
                               FOR k IN range(256)] AS t),
raw AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS t,
               coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ') AS key FROM conversations),
keyed AS (SELECT *, xor(list_reduce(list_prepend(4294967295, [ascii(x)::BIGINT FOR x IN string_split(key, '')]),
                  lambda x, b: xor(x >> 8, crc.t[(xor(x, b) & 255) + 1])), 4294967295) % 20 AS k FROM raw, crc),
hurt AS (SELECT conv_id, turn, CASE WHEN k = 4 THEN 'user' ELSE role END AS role,
                CASE k WHEN 1 THEN '' WHEN 2 THEN regexp_replace(keyed.t, '[.!?]', '', 'g') ELSE keyed.t END AS t,
                unnest(range(CASE k WHEN 3 THEN 2 ELSE 1 END)) AS copy FROM keyed WHERE k <> 0),
pos AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, sha256(t)) AS p FROM hurt),
seen AS (SELECT *, row_number() OVER (PARTITION BY conv_id, role, t ORDER BY p) > 1 AS again,
                NOT regexp_matches(t, '[^\\x20\\x09-\\x0D]') AS blank,
                NOT regexp_matches(t, '[.!?][\\x20\\x09-\\x0D]*$') AS cut, substr(role, 1, 1) AS i FROM pos),
r AS (SELECT *, blank OR again AS gone, CASE WHEN cut THEN 3 ELSE 0 END AS extra,
             lag(i) OVER (PARTITION BY conv_id ORDER BY p) || i AS pair FROM seen),
dp AS (SELECT DISTINCT conv_id, 0::BIGINT AS p, {{'c': 0::BIGINT, 'a': '', 'o': ''}} AS n, {_FAR} AS s, {_FAR} AS u, {_FAR} AS a FROM r
  UNION ALL
  SELECT conv_id, p, {_DEL('n')}, {_LEAST(_DEL('s'), _IF('s', 'n'))},
         {_LEAST(_DEL('u2'), _IF('u', 'n'), _IF('u', 's'), _IF('u', 'a2'), _ROW('n', 3, 'R', "'user'"), _ROW('s', 3, 'R', "'user'"), _ROW('a2', 3, 'R', "'user'"))},
         {_LEAST(_DEL('a2'), _IF('a', 'u2'), _ROW('u2', 3, 'R', "'assistant'"))}
  FROM (SELECT *, {_LEAST('a', _INS('u2', 'assistant'))} AS a2 FROM (
        SELECT r.*, dp.n, dp.s, dp.a, {_LEAST('dp.u', _INS('dp.n', 'user'), _INS('dp.s', 'user'), _INS('dp.a', 'user'))} AS u2
        FROM dp JOIN r ON r.conv_id IS NOT DISTINCT FROM dp.conv_id AND r.p = dp.p + 1)) r),
fin AS (SELECT conv_id, {_LEAST('n', _INS('u', 'assistant'), _INS(_LEAST(_INS('n', 'user'), _INS('s', 'user')), 'assistant'), 'a')} AS best
        FROM dp QUALIFY p = max(p) OVER (PARTITION BY conv_id)),
per AS (SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (blank) AS blank,
               count(*) FILTER (again AND NOT blank) AS duplicate, count(*) FILTER (cut AND NOT gone) AS truncated,
               count(*) FILTER (pair NOT IN ('su', 'ua', 'au')) AS illegal FROM r GROUP BY conv_id)
SELECT c.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate,
       coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal, coalesce(best.c, 0) AS cost,
       coalesce(best.a, '') AS audit, sha256(coalesce(best.o, '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) c LEFT JOIN per ON per.conv_id IS NOT DISTINCT FROM c.conv_id
     LEFT JOIN fin ON fin.conv_id IS NOT DISTINCT FROM c.conv_id"""
