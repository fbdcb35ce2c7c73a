"""SQL of the numbered operators that SQL can express; the others are tested against brute force."""

from __future__ import annotations

from glint.llm import quality_rules as Q

_WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"
_ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def _chars(of: str, chars: str) -> str:
    return f"(length({of}) - length(translate({of}, '{chars}', '')))"


_WHITE = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"


def quality_rules(policy: str = "v2") -> str:
    base, own = Q.mask(Q.BASE), Q.mask(Q.POLICIES[policy])
    passes = " + ".join(f"CASE WHEN (failed & {Q.mask(rules)}) = 0 THEN {1 << i} ELSE 0 END" for i, rules in enumerate(Q.POLICIES.values()))
    only = "CASE failed & " + str(own) + " " + " ".join(f"WHEN {Q.mask([r])} THEN '{r}'" for r in Q.POLICIES[policy]) + " END"
    bits = " + ".join(f"CASE WHEN {c} THEN {1 << i} ELSE 0 END" for i, c in enumerate(Q.RULES.values()))
    return f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, {_WORDS} AS w FROM documents),
g AS (SELECT doc_id, i, w[i] AS a, w[i + 1] AS b, w[i + 2] AS c FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM d)),
r AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, a, b, c) AS n FROM g) WHERE n > 1),
k AS (SELECT doc_id, count(*) AS n FROM (SELECT doc_id, i AS p FROM r UNION SELECT doc_id, i + 1 FROM r UNION SELECT doc_id, i + 2 FROM r) GROUP BY 1),
l AS (SELECT doc_id, x FROM (SELECT doc_id, unnest(string_split(t, chr(10))) AS x FROM d) WHERE regexp_matches(x, '[^\\x20\\x09-\\x0D]')),
n AS (SELECT doc_id, count(*) AS n_lines, count(DISTINCT x) AS n_different FROM l GROUP BY 1),
m AS (SELECT d.doc_id, len(w)::bigint AS n_words, length(translate(t, {_WHITE}, ''))::bigint AS word_chars, {_chars('t', Q.SYMBOLS)}::bigint AS n_symbols,
 coalesce(n_lines - n_different, 0)::bigint AS n_dup_lines, coalesce(k.n, 0)::bigint AS n_repeat_words, coalesce(n_lines, 0) AS n_lines, {_chars('t', _ALPHABET)} AS n_capitals, {_chars('t', '.,;:!?')} AS n_stops
 FROM d LEFT JOIN k ON k.doc_id = d.doc_id LEFT JOIN n ON n.doc_id = d.doc_id),
f AS (SELECT *, ({bits})::bigint AS failed FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, (failed & {base}) <> 0 AS base_failed, (failed & {base | own}) = 0 AS kept, failed, ({passes})::bigint AS passes, {only} AS only_rule FROM f"""


def ablations() -> str:
    cases = " UNION ALL ".join(f"SELECT '{p}' AS policy, '{r}' AS rule, {Q.mask(rules)}::bigint AS mask, {Q.mask([r])}::bigint AS bit" for p, rules in Q.POLICIES.items() for r in rules)
    return f"""
SELECT policy, rule, count(*) FILTER (WHERE failed & bit <> 0) AS n_failed, count(*) FILTER (WHERE failed & mask = bit) AS n_only, count(*) FILTER (WHERE failed & mask & ~bit = 0) AS n_kept_without
FROM ({quality_rules()}) q, ({cases}) c GROUP BY 1, 2"""


MIX = rf"""
WITH d AS (SELECT doc_id, source, text, len({_WORDS})::bigint AS size,
 coalesce(1.0::double - 0.9::double * {_chars('text', '#*$%&|<>0123456789')}::double / greatest(length(text), 1)::double, 0.1::double) AS quality,
 (('0x' || substr(md5('mix:' || doc_id::varchar), 1, 12))::bigint::double + 0.5::double) / 281474976710656::double AS u FROM documents),
k AS (SELECT doc_id, source, size, -ln(u) / quality AS key FROM d),
s AS (SELECT source, sum(size)::bigint AS source_size FROM k GROUP BY 1),
w AS (SELECT source, source_size, CASE (row_number() OVER (ORDER BY source ASC NULLS LAST) - 1) % 3 WHEN 0 THEN 5.0::double WHEN 1 THEN 2.0::double ELSE 1.0::double END AS weight FROM s),
c AS (SELECT *, 3 * source_size::double AS cap, 3 * source_size::double / weight AS fill FROM w),
o AS (SELECT *, (sum(source_size) OVER ())::double - (sum(cap) OVER z - cap) AS left_, sum(weight) OVER () - (sum(weight) OVER z - weight) AS weights FROM c WINDOW z AS (ORDER BY fill, source)),
v AS (SELECT max(left_ / weights) AS unit, min(fill) AS first FROM o WHERE fill > left_ / weights),
t AS (SELECT source, source_size, CASE WHEN fill >= first THEN least(cap, weight * unit) ELSE cap END AS target FROM o, v),
b AS (SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size + 1e-9)::bigint ELSE 0 END AS epochs FROM t),
e AS (SELECT *, greatest(round(target)::bigint - epochs * source_size, 0) AS budget FROM b),
r AS (SELECT doc_id, size, source_size, target, epochs, budget, sum(size) OVER (PARTITION BY k.source ORDER BY key, doc_id) - size AS before FROM k JOIN e ON k.source IS NOT DISTINCT FROM e.source)
SELECT doc_id, size, source_size, target, (epochs * size + greatest(least(size, budget - before), 0))::bigint AS taken FROM r"""

NEAR = rf"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{_ALPHABET}', '{_ALPHABET.lower()}'), '[^\x20\x09-\x0D]+') AS w FROM documents),
h AS (SELECT DISTINCT doc_id, w[i] AS a, CASE WHEN len(w) > 1 THEN w[i + 1] ELSE '' END AS b FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w), 2))) AS i FROM d WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM h GROUP BY 1),
m AS (SELECT x.doc_id AS p, y.doc_id AS q, count(*) AS c FROM h x JOIN h y ON x.a = y.a AND x.b = y.b AND x.doc_id < y.doc_id GROUP BY 1, 2),
l AS (SELECT p, q FROM m JOIN n u ON u.doc_id = p JOIN n v ON v.doc_id = q WHERE 100 * c >= 80 * (u.n + v.n - c)),
e AS (SELECT p, q FROM l UNION ALL SELECT q, p FROM l),
g AS (SELECT doc_id AS a, doc_id AS z FROM d UNION SELECT g.a, e.q FROM g JOIN e ON e.p = g.z),
k AS (SELECT a AS doc_id, min(z) AS component_id FROM g GROUP BY 1)
SELECT d.doc_id, coalesce(n.n, 0)::bigint AS n_shingles, component_id, d.doc_id = component_id AS kept FROM d JOIN k ON k.doc_id = d.doc_id LEFT JOIN n ON n.doc_id = d.doc_id"""

_H = lambda x: f"sha256({x})"
_FRAMED = " || ".join(f"coalesce(strlen({c}::varchar)::varchar || ':' || {c}::varchar, '-')" for c in ("doc_id", "source", "lang", "n_chars"))
_STEP = "xor(v >> 1, CASE WHEN v & 1 = 1 THEN 3988292384 ELSE 0 END)"
#: List ``tab`` of the 256 remainders of a byte, from which ``_crc`` works out the unsigned CRC-32 of a list of bytes.
_TABLE = f"tab AS (SELECT list(list_reduce(range(8), lambda v, _: {_STEP}, i) ORDER BY i) AS tab FROM (SELECT unnest(range(256))::bigint AS i))"


def _crc(codes: str) -> str:
    return f"xor(4294967295, list_reduce({codes}, lambda v, b: xor(v >> 8, tab[(xor(v, b) & 255) + 1]), 4294967295::bigint))"


def merkle() -> str:
    leaf = lambda text: _H(f"{_FRAMED} || coalesce(strlen({text})::varchar || ':' || {text}, '-')")
    grow = lambda rows: f"""SELECT t, 0 AS lv, i, h, count(*) OVER (PARTITION BY t) AS n FROM {rows}
 UNION ALL SELECT t, any_value(lv) + 1, i // 3, {_H("string_agg(h, '' ORDER BY i)")}, any_value((n + 2) // 3) FROM {{}} WHERE n > 1 GROUP BY t, i // 3"""  # noqa: E731
    run = "(PARTITION BY t, lv, i // 3 ORDER BY i ROWS BETWEEN "
    sides = lambda of: f"SELECT *, coalesce(string_agg(h, '') OVER {run}UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS before, coalesce(string_agg(h, '') OVER {run}1 FOLLOWING AND UNBOUNDED FOLLOWING), '') AS after FROM {of}"
    return f"""
WITH RECURSIVE {_TABLE},
d AS (SELECT doc_id, source, coalesce('=' || source, '') AS t, {leaf('text')} AS h, CASE WHEN doc_id IS NOT NULL AND {_crc("list_transform(string_split(doc_id::varchar, ''), lambda c: ascii(c)::bigint)")} % 2 = 0 THEN {leaf("replace(text, chr(10), '')")} END AS s FROM documents, tab),
l AS (SELECT *, row_number() OVER (PARTITION BY t ORDER BY doc_id NULLS FIRST, h) - 1 AS i FROM d),
g AS ({grow('l').format('g')}),
u AS (SELECT '' AS t, t AS own, h, row_number() OVER (ORDER BY encode(t)) - 1 AS i FROM g WHERE n = 1),
k AS ({grow('u').format('k')}),
b AS ({sides('g')}), a AS ({sides('k')}),
root AS (SELECT h AS root FROM k WHERE n = 1),
p AS (SELECT l.t, l.i, b.lv AS nr, b.before, b.after FROM l JOIN b ON b.t = l.t AND b.n > 1 AND b.i = l.i // (3 ** b.lv)::bigint
 UNION ALL SELECT l.t, l.i, 1000 + a.lv, a.before, a.after FROM l JOIN u ON u.own = l.t JOIN a ON a.n > 1 AND a.i = u.i // (3 ** a.lv)::bigint),
o AS (SELECT *, row_number() OVER (PARTITION BY t, i ORDER BY nr) AS nth FROM p),
f AS (SELECT t, i, 0 AS nth, coalesce(s, h) AS v FROM l UNION ALL SELECT f.t, f.i, f.nth + 1, {_H('o.before || f.v || o.after')} FROM f JOIN o ON o.t = f.t AND o.i = f.i AND o.nth = f.nth + 1),
e AS (SELECT t, i, max_by(v, nth) AS folded FROM f GROUP BY 1, 2),
q AS (SELECT t, i, {_H("string_agg(before || after, '' ORDER BY nr)")} AS proof FROM p GROUP BY 1, 2)
SELECT doc_id, l.h AS leaf, u.h AS subroot, root, coalesce(proof, {_H("''")}) AS proof_sha256, folded AS folded_root, folded = root AS verified
FROM l JOIN u ON u.own = l.t JOIN e ON e.t = l.t AND e.i = l.i LEFT JOIN q ON q.t = l.t AND q.i = l.i, root"""

_BYTES = "flatten(list_transform(string_split({}, ''), lambda c: CASE WHEN unicode(c) < 128 THEN [unicode(c)::bigint] ELSE [195::bigint, unicode(c)::bigint - 64] END))"
SPELLING = rf"""
WITH RECURSIVE {_TABLE},
r AS (SELECT doc_id, unnest(regexp_extract_all(translate(text, '{_ALPHABET}', '{_ALPHABET.lower()}'), '[a-z\x{{C0}}-\x{{FF}}]+')) AS w FROM documents),
o AS (SELECT doc_id, w, count(*) AS c FROM r GROUP BY 1, 2),
x AS (SELECT w, c, {_crc(_BYTES.format("coalesce(doc_id::varchar, '') || ':' || w"))} AS h FROM o, tab),
e AS (SELECT CASE WHEN h % 97 = 0 THEN left(w, (h % length(w))::int) || substr(w, (h % length(w))::int + 2) ELSE w END AS word, c FROM x),
v AS (SELECT word, sum(c)::bigint AS n FROM e WHERE length(word) >= 5 GROUP BY 1 HAVING sum(c) >= 3),
k AS (SELECT word, i, left(word, i - 1) || substr(word, i + 1) AS rest FROM (SELECT word, unnest(range(1, length(word) + 1)) AS i FROM v)),
s AS (SELECT a.word AS a, b.word AS b FROM k a JOIN k b ON a.rest = b.rest AND a.i = b.i AND a.word <> b.word),
p AS (SELECT a, b FROM s UNION SELECT k.word, v.word FROM k JOIN v ON v.word = k.rest UNION SELECT v.word, k.word FROM k JOIN v ON v.word = k.rest),
m AS (SELECT a, count(*) AS n_near, arg_min(b, row(-v.n, encode(b))) AS b, max(v.n) AS bn FROM p JOIN v ON v.word = p.b GROUP BY 1),
f AS (SELECT v.word, v.n, coalesce(n_near, 0) AS n_near, CASE WHEN bn >= 2 * v.n THEN b END AS form, CASE WHEN bn >= 2 * v.n THEN bn END AS form_n FROM v LEFT JOIN m ON m.a = v.word),
g AS (SELECT word, word AS cur, 0 AS steps FROM f UNION ALL SELECT g.word, f.form, steps + 1 FROM g JOIN f ON f.word = g.cur WHERE f.form IS NOT NULL),
z AS (SELECT word, max_by(cur, steps) AS root FROM g GROUP BY 1)
SELECT f.word, form, root, n, n_near, form_n FROM f JOIN z ON z.word = f.word"""
