"""SQL for the registered queries that it can express on whole tables.

Training, sampling, hashing searches, tokenising and packing are not among them;
the tests hold those against brute force.
"""

from __future__ import annotations

from .crosspoly import Settings as Vectors
from .merkle import FAN
from .periodic import Settings as Loops
from .repetition import Rules
from .substring import PASSAGES
from .substring import Settings as Strings

_R, _L, _P, _C = Rules(), Strings().length, PASSAGES.length, Vectors().cosine

QUALITY_RULES = rf"""
WITH docs AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
split AS (SELECT doc_id, t, list_filter(string_split_regex(t, '[\x20\x09-\x0D]+'), lambda w: w <> '') AS w FROM docs),
sized AS (SELECT *, len(w) AS n FROM split),
grams AS (SELECT doc_id, i, array_to_string(w[i + 1 : i + {_R.min_words}], ' ') AS g FROM (SELECT *, unnest(range(n - {_R.min_words - 1})) AS i FROM sized WHERE n >= {_R.min_words})),
twice AS (SELECT doc_id, i FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, g) AS c FROM grams) WHERE c > 1),
covered AS (SELECT doc_id, count(DISTINCT i + k) AS n_repeat FROM twice, range({_R.min_words}) AS r(k) GROUP BY doc_id),
lines AS (SELECT doc_id, count(*) - count(DISTINCT line) AS n_dup FROM (SELECT doc_id, unnest(string_split(t, chr(10))) AS line FROM docs) WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY doc_id),
wide AS (SELECT *, greatest({_R.max_longest + 1}, n * {_R.max_longest_share} // 100 + 1) AS m FROM sized),
long AS (SELECT DISTINCT doc_id FROM (SELECT doc_id, hash(array_to_string(w[i + 1 : i + m], ' ')) AS g FROM (SELECT *, unnest(range(n - m + 1)) AS i FROM wide WHERE n > m)) GROUP BY doc_id, g HAVING count(*) > 1),
figures AS (
  SELECT s.doc_id, n::BIGINT AS n_words, coalesce(list_sum(list_transform(w, lambda x: length(x))), 0)::BIGINT AS word_chars,
         (length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
         coalesce(n_dup, 0)::BIGINT AS n_dup_lines, coalesce(n_repeat, 0)::BIGINT AS n_repeat_words, l.doc_id IS NOT NULL AS too_long
  FROM sized s LEFT JOIN lines USING (doc_id) LEFT JOIN covered USING (doc_id) LEFT JOIN long l USING (doc_id))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, failed AS base_failed, NOT failed AND NOT too_long AS kept
FROM (SELECT *, n_words < {_R.min_total} OR 100 * n_repeat_words > {_R.max_covered} * n_words AS failed FROM figures)"""

SUFFIX_DEDUP = f"""
WITH docs AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
sized AS (SELECT *, length(h) // 2 AS n FROM docs),
windows AS (SELECT doc_id, i, hash(substring(h, 2 * i + 1, {2 * _L})) AS k FROM (SELECT *, unnest(range(n - {_L - 1})) AS i FROM sized WHERE n >= {_L})),
again AS (SELECT doc_id, i FROM windows WHERE k IN (SELECT k FROM windows GROUP BY k HAVING count(*) > 1)),
marked AS (SELECT *, CASE WHEN i > lag(i) OVER (PARTITION BY doc_id ORDER BY i) + {_L} THEN 1 ELSE 0 END AS gap FROM again),
spans AS (
  SELECT doc_id, min(i) AS a, max(i) + {_L} AS b
  FROM (SELECT *, sum(gap) OVER (PARTITION BY doc_id ORDER BY i) AS island FROM marked) GROUP BY doc_id, island),
cuts AS (SELECT doc_id, coalesce(lag(b) OVER (PARTITION BY doc_id ORDER BY a), 0) AS f, a AS t, b FROM spans),
parts AS (
  SELECT doc_id, string_agg(substring(h, 2 * f + 1, 2 * (t - f)), '' ORDER BY f) AS head, max(b) AS last, sum(b - t) AS n_removed, count(*) AS n_spans
  FROM cuts JOIN sized USING (doc_id) GROUP BY doc_id),
said AS (SELECT doc_id, list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS w FROM documents),
runs AS (SELECT doc_id, i, hash(array_to_string(w[i + 1 : i + {_P}], ' ')) AS k FROM (SELECT *, unnest(range(len(w) - {_P - 1})) AS i FROM said WHERE len(w) >= {_P})),
met AS (SELECT doc_id, i, least({_P}, lead(i, 1, i + {_P}) OVER (PARTITION BY doc_id ORDER BY i) - i) AS own FROM runs WHERE k IN (SELECT k FROM runs GROUP BY k HAVING count(*) > 1)),
shared AS (SELECT doc_id, sum(own)::BIGINT AS n_passage FROM met GROUP BY doc_id)
SELECT doc_id, n::BIGINT AS n_bytes, coalesce(n_removed, 0)::BIGINT AS n_removed, coalesce(n_spans, 0)::BIGINT AS n_spans,
       sha256(unhex(coalesce(head, '') || substring(h, 2 * coalesce(last, 0) + 1))) AS kept_sha256, coalesce(n_passage, 0)::BIGINT AS n_passage_words
FROM sized LEFT JOIN parts USING (doc_id) LEFT JOIN shared USING (doc_id)"""

EMBEDDING_NEAR_DEDUP = f"""
WITH RECURSIVE good AS (
  SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings
  WHERE label IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
links AS (SELECT a.vec_id AS a, b.vec_id AS b FROM good a JOIN good b ON a.label = b.label AND a.vec_id <> b.vec_id WHERE list_cosine_similarity(a.e, b.e) >= {_C}),
reach AS (SELECT vec_id AS v, vec_id AS r FROM embeddings UNION SELECT v, b FROM reach JOIN links ON a = r)
SELECT v AS vec_id, (SELECT count(*) FROM links WHERE a = v)::BIGINT AS n_links, min(r) AS component_id, v = min(r) AS kept FROM reach GROUP BY v"""

#: CRC-32 of a string of ASCII characters, as the first table of a query and as an expression over it.
CRC_TABLE = "crc AS (SELECT list(list_reduce([n, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, _: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) ORDER BY n) AS t FROM (SELECT range AS n FROM range(256)))"


def crc(text: str) -> str:
    letters = f"list_transform(range(length({text})), lambda i: ascii(substring({text}, i + 1, 1))::BIGINT)"
    return f"xor(list_reduce(list_concat([4294967295::BIGINT], {letters}), lambda c, b: xor(crc.t[(xor(c, b) & 255) + 1], c >> 8)), 4294967295)"


_T = Loops()

PERIODIC_RUNS = rf"""
WITH {CRC_TABLE},
split AS (SELECT doc_id, {crc("doc_id::VARCHAR")} AS h, list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS w FROM documents, crc),
sized AS (SELECT *, len(w) AS n, h // 10 AS g FROM split),
placed AS (SELECT *, CASE WHEN n > 0 THEN g % n END AS a FROM sized),
looped AS (SELECT *, 1 + (n - a) // (3 + g % 8) AS p FROM placed),
docs AS (SELECT doc_id, CASE WHEN h % 10 = 0 AND n > 0 THEN list_concat(w[1 : a], list_transform(range(n - a), lambda j: w[a + j % p + 1])) ELSE w END AS w FROM looped),
words AS (SELECT doc_id, unnest(w) AS x, unnest(range(len(w))) AS i FROM docs),
equal AS (SELECT s.doc_id, s.i, t.i - s.i AS q FROM words s JOIN words t ON s.doc_id = t.doc_id AND s.x = t.x AND s.i < t.i),
joined AS (SELECT *, i - row_number() OVER (PARTITION BY doc_id, q ORDER BY i) AS island FROM equal),
long AS (SELECT doc_id, q, min(i) AS a, count(*) + q AS l FROM joined GROUP BY doc_id, q, island HAVING count(*) + q >= greatest({_T.least}, {_T.times} * q)),
runs AS (SELECT doc_id, a, l, min(q) AS q FROM long GROUP BY doc_id, a, l),
listed AS (SELECT doc_id, count(*) AS c, string_agg(a || ',' || l || ',' || q || chr(10), '' ORDER BY a, q) AS r, first(struct_pack(a := a, l := l, q := q) ORDER BY l DESC, a, q) AS m FROM runs GROUP BY doc_id),
gone AS (SELECT DISTINCT doc_id, unnest(range(a + q, a + l)) AS i FROM runs),
kept AS (SELECT doc_id, string_agg(x, ' ' ORDER BY i) AS t FROM words ANTI JOIN gone USING (doc_id, i) GROUP BY doc_id)
SELECT doc_id, coalesce(c, 0)::BIGINT AS n_runs, m.a::BIGINT AS start, m.l::BIGINT AS length, m.q::BIGINT AS period, (1000 * m.l // m.q)::BIGINT AS exponent_milli,
       sha256(coalesce(r, '')) AS runs_sha256, sha256(coalesce(t, '')) AS collapsed_sha256
FROM docs LEFT JOIN listed USING (doc_id) LEFT JOIN kept USING (doc_id)"""

#: Levels of a tree that the SQL climbs: enough for 16**6 rows of a source, and of sources.
_DEEP = 6


def _value(column: str) -> str:
    return f"coalesce(strlen({column}::VARCHAR) || ':' || {column}, '-')"


def _tree(name: str, nodes: str) -> str:
    """Tables name0 … of the levels (g, i, d, n) from the nodes of level 0; n: nodes of the group's level. A group of one node stays as it is."""
    levels = [f"{name}0 AS ({nodes})"]
    for k in range(_DEEP):
        levels.append(f"{name}{k + 1} AS (SELECT g, j AS i, d, count(*) OVER (PARTITION BY g) AS n FROM (SELECT g, i // {FAN} AS j, CASE WHEN any_value(n) = 1 THEN any_value(d) ELSE sha256(string_agg(d, '' ORDER BY i)) END AS d FROM {name}{k} GROUP BY g, j))")
    return ", ".join(levels)


def _climb(name: str, rows: str) -> str:
    """Tables from the rows (key, g, i, proof, folded) up: each level adds siblings to the proof and folds, where a group has more than one node."""
    steps = [f"{name}_up0 AS ({rows})"]
    for k in range(_DEEP):
        steps.append(f"""{name}_run{k} AS (SELECT g, i // {FAN} AS j, any_value(n) AS n, list(d ORDER BY i) AS ds FROM {name}{k} GROUP BY g, j),
{name}_up{k + 1} AS (SELECT key, u.g, u.i // {FAN} AS i,
  CASE WHEN n = 1 THEN proof ELSE proof || array_to_string(list_concat(ds[1 : u.i % {FAN}], ds[u.i % {FAN} + 2 :]), '') END AS proof,
  CASE WHEN n = 1 THEN folded ELSE sha256(array_to_string(ds[1 : u.i % {FAN}], '') || folded || array_to_string(ds[u.i % {FAN} + 2 :], '')) END AS folded
  FROM {name}_up{k} u JOIN {name}_run{k} r ON r.g IS NOT DISTINCT FROM u.g AND r.j = u.i // {FAN})""")
    return ", ".join(steps)


def _leaf(text: str) -> str:
    return "sha256(" + " || ".join(map(_value, ("doc_id", "source", "lang", "n_chars", text))) + ")"


_LOWER = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

MERKLE_MANIFEST = f"""
WITH {CRC_TABLE},
leaves AS (SELECT doc_id, source AS g, {_leaf("text")} AS leaf, CASE WHEN {crc("doc_id::VARCHAR")} % 5 = 0 THEN {_leaf(_LOWER)} ELSE {_leaf("text")} END AS claimed FROM documents, crc),
ordered AS (SELECT *, row_number() OVER (PARTITION BY g ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i, row_number() OVER () AS key FROM leaves),
{_tree("row", "SELECT g, i, leaf AS d, count(*) OVER (PARTITION BY g) AS n FROM ordered")},
{_climb("row", "SELECT key, g, i, '' AS proof, claimed AS folded FROM ordered")},
subroots AS (SELECT g AS source, d, row_number() OVER (ORDER BY encode(g) NULLS FIRST) - 1 AS i FROM row{_DEEP}),
{_tree("top", "SELECT 0 AS g, i, d, count(*) OVER () AS n FROM subroots")},
{_climb("top", f"SELECT key, 0 AS g, s.i, proof, folded FROM row_up{_DEEP} u JOIN subroots s ON s.source IS NOT DISTINCT FROM u.g")}
SELECT doc_id, leaf, s.d AS subroot, r.d AS root, sha256(proof) AS proof_sha256, folded AS folded_root, folded = r.d AS verified
FROM ordered o JOIN top_up{_DEEP} USING (key) JOIN subroots s ON s.source IS NOT DISTINCT FROM o.g, top{_DEEP} r"""

SQL = {
    "op1_quality_rules": QUALITY_RULES,
    "op4_suffix_dedup": SUFFIX_DEDUP,
    "op7_embedding_near_dedup": EMBEDDING_NEAR_DEDUP,
    "op12_periodic_runs": PERIODIC_RUNS,
    "op13_merkle_manifest": MERKLE_MANIFEST,
}
