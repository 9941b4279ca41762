"""The SQL that must give the rows of the registered queries, written on its own."""

from __future__ import annotations

from .queries import EVERY, FETCH, OVERLAP, RRF_K, SIZE, SPARSE_K, TOP_K, WEIGHTS


def norm(x: str) -> str:
    return f"trim(regexp_replace(replace(coalesce({x}, ''), chr(173), ''), '\\s+', ' ', 'g'))"


def bare(x: str) -> str:
    return f"trim(regexp_replace(regexp_replace(coalesce({x}, ''), '<[^>]+>', ' ', 'g'), '\\s+', ' ', 'g'))"


LINES = "lines AS (SELECT doc_id, unnest(range(len(l)))::INTEGER AS i, unnest(l) AS line FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents))"
BLOCKS = f"""{LINES},
blocks AS (
  SELECT doc_id, i AS block_idx, line, type, (i // 4)::INTEGER AS page_idx,
         CASE WHEN type = 'text' AND (doc_id * 7 + i) % 5 = 0 THEN 1 + i % 3 END AS text_level,
         (i % 4) * 50 AS x0, (doc_id % 7) * 20 AS y0, (i % 4) * 50 + 100 AS x1, (doc_id % 7) * 20 + 40 AS y1
  FROM (SELECT *, CASE (doc_id + i) % 11 WHEN 0 THEN 'table' WHEN 1 THEN 'image' WHEN 2 THEN 'equation' WHEN 3 THEN 'discarded' ELSE 'text' END AS type FROM lines))"""
KEPT = f"""{BLOCKS},
kept AS (SELECT * REPLACE ((row_number() OVER (PARTITION BY doc_id ORDER BY block_idx) - 1)::INTEGER AS block_idx) FROM blocks WHERE type <> 'discarded'),
raw AS (
  SELECT *, CASE type
      WHEN 'image' THEN CASE WHEN left(line, 40) = '' THEN '' ELSE '[IMAGE] ' || left(line, 40) END
      WHEN 'table' THEN (SELECT CASE WHEN t = '' THEN '' ELSE '[TABLE] ' || t END FROM (SELECT array_to_string(list_filter([left(line, 30), {bare("'<tr><td>' || line || '</td></tr>'")}], lambda v: v <> ''), ' ') AS t))
      ELSE line END AS body
  FROM kept)"""
SEGS = f"""{KEPT},
headed AS (
  SELECT doc_id, block_idx, type, page_idx, {norm("body")} AS text, type IN ('image', 'table', 'equation') AS is_special,
         coalesce(last_value(CASE WHEN type = 'text' AND text_level IN (1, 2) AND {norm("line")} <> '' THEN {norm("line")} END IGNORE NULLS)
                  OVER (PARTITION BY doc_id ORDER BY block_idx ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), '') AS header
  FROM raw),
told AS (
  SELECT *, CASE WHEN header <> '' AND header IS DISTINCT FROM lag(header) OVER w AND NOT contains(lower(left(text, length(header) + 10)), lower(header)) THEN header || '.' || chr(10) ELSE '' END AS prefix
  FROM headed WHERE text <> '' WINDOW w AS (PARTITION BY doc_id ORDER BY block_idx)),
segs AS (
  SELECT *, s AS seg_start, s + length(prefix) + length(text) AS seg_end
  FROM (SELECT *, coalesce(sum(length(prefix) + length(text) + 1) OVER (PARTITION BY doc_id ORDER BY block_idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS s FROM told)),
texts AS (
  SELECT doc_id, string_agg(prefix || text, ' ' ORDER BY block_idx) AS text, list({{'s': seg_start, 'e': seg_end}} ORDER BY block_idx) FILTER (WHERE is_special) AS special
  FROM segs GROUP BY doc_id)"""


def soft(text: str, start: str, wanted: str) -> str:
    """The soft cut for a wanted end; ``n`` is the text's length."""
    low = f"greatest({start}, {wanted} - 40)"
    ahead = f"substring({text}, ({low} + 1)::BIGINT, (least(n, {wanted} + 40) - {low})::BIGINT)"
    back = f"substring({text}, ({low} + 1)::BIGINT, ({wanted} - {low})::BIGINT)"
    cut = f"{low} + length(regexp_extract({ahead}, '(?s)^(.*?)[.!?]\\s', 1)) + 1"
    return f"""CASE WHEN {wanted} >= n THEN {wanted}
      WHEN regexp_matches({ahead}, '[.!?]\\s') AND {cut} <= {wanted} + 10 THEN {cut}
      WHEN instr(reverse({back}), ' ') > 0 THEN {low} + length({back}) - instr(reverse({back}), ' ') + 1
      ELSE {wanted} END"""


def sliding(source: str, special: str) -> str:
    """Recursive chunks of rows (doc_id, text, special, n)."""
    hit = "list_filter(special, lambda x: x.s < wanted AND wanted < x.e)[1]"
    inner = f"""CASE WHEN {hit} IS NULL THEN wanted WHEN {hit}.e - s <= {1.5 * SIZE} THEN {hit}.e WHEN {hit}.s - s > 200 THEN {hit}.s ELSE wanted END""" if special else "wanted"

    def step(idx: str, rows: str) -> str:
        return f"""SELECT doc_id, idx, s, CASE WHEN atomic <> wanted THEN atomic ELSE {soft("text", "s", "wanted")} END::BIGINT AS e, text, special, n
          FROM (SELECT *, {inner} AS atomic FROM (SELECT doc_id, {idx} AS idx, s, least(s + {SIZE}, n) AS wanted, text, special, n FROM ({rows})))"""

    first = step("0::BIGINT", f"SELECT *, 0::BIGINT AS s FROM ({source}) WHERE n > 0")
    again = step("idx + 1", f"SELECT * REPLACE (CASE WHEN greatest(e - {OVERLAP}, 0) > s THEN greatest(e - {OVERLAP}, 0) ELSE e END AS s) FROM chunks WHERE e < n")
    return f"chunks AS ({first} UNION ALL {again})"


ATOMIC = f"WITH RECURSIVE {SEGS}, {sliding('SELECT doc_id, text, special, length(text) AS n FROM texts', 'special')}"

TOKENS = "SELECT doc_id, unnest(list_filter(string_split_regex(text, '\\s+'), lambda t: t <> '')) AS token FROM documents"
SPARSE = f"""toks AS MATERIALIZED ({TOKENS}),
lens AS (SELECT d.doc_id, count(t.token) AS len FROM documents d LEFT JOIN toks t USING (doc_id) GROUP BY d.doc_id),
stats AS (SELECT count(*) AS n, avg(len) AS avg_len FROM lens),
dfs AS MATERIALIZED (SELECT token, count(*) AS df FROM (SELECT DISTINCT doc_id, token FROM toks) GROUP BY token),
raws AS MATERIALIZED (SELECT token, df, ln(n - df + 0.5) - ln(df + 0.5) AS raw FROM dfs, stats),
means AS (SELECT avg(raw) AS mean_raw FROM raws),
idfs AS (SELECT token, df, CASE WHEN raw < 0 THEN 0.25 * mean_raw ELSE raw END AS idf FROM raws, means),
asked AS (SELECT item_id, unnest(list_filter(string_split_regex(text, '\\s+'), lambda t: t <> '')) AS token FROM benchmark),
tfs AS (SELECT doc_id, token, count(*) AS tf FROM toks WHERE token IN (SELECT token FROM asked) GROUP BY ALL),
hits AS (
  SELECT item_id, doc_id, round(sum(idf * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * len / avg_len))), 6) AS score
  FROM asked JOIN tfs USING (token) JOIN idfs USING (token) JOIN lens USING (doc_id), stats GROUP BY ALL),
scored AS (SELECT b.item_id, d.doc_id, coalesce(h.score, 0.0) AS score FROM benchmark b CROSS JOIN documents d LEFT JOIN hits h USING (item_id, doc_id)),
sparse AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM scored) WHERE rank <= {SPARSE_K})"""


def dense(k: int, which: str = f"vec_id % {EVERY} = 0") -> str:
    return f"""qs AS (SELECT vec_id AS q, embedding::DOUBLE[] AS v FROM embeddings WHERE {which}),
near AS (SELECT q, vec_id, round(list_cosine_similarity(v, embedding::DOUBLE[]), 6) AS score FROM qs, embeddings),
pool AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY q ORDER BY score DESC, vec_id) AS rank FROM near) WHERE rank <= {k})"""


def _mmr(which: str = f"vec_id % {EVERY} = 0") -> str:
    parts = [dense(FETCH, which), "vs AS (SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings)", "alike AS (SELECT a.q, a.vec_id AS a, b.vec_id AS b, round(list_cosine_similarity(x.v, y.v), 6) AS s FROM pool a JOIN pool b USING (q) JOIN vs x ON x.vec_id = a.vec_id JOIN vs y ON y.vec_id = b.vec_id)", "taken1 AS (SELECT q, vec_id, 1::BIGINT AS rank FROM pool WHERE rank = 1)"]
    for k in range(2, TOP_K + 1):
        parts.append(f"""taken{k} AS (
  SELECT * FROM taken{k - 1} UNION ALL
  SELECT q, vec_id, {k}::BIGINT FROM (
    SELECT p.q, p.vec_id, row_number() OVER (PARTITION BY p.q ORDER BY round(0.5 * p.score - 0.5 * max(s.s), 6) DESC, p.vec_id) AS place
    FROM pool p JOIN taken{k - 1} t ON t.q = p.q JOIN alike s ON s.q = p.q AND s.a = p.vec_id AND s.b = t.vec_id
    WHERE NOT EXISTS (SELECT 1 FROM taken{k - 1} u WHERE u.q = p.q AND u.vec_id = p.vec_id)
    GROUP BY p.q, p.vec_id, p.score) WHERE place = 1)""")
    return ",\n".join(parts)


MMR, ASKED_MMR = _mmr(), _mmr("vec_id IN (SELECT item_id FROM benchmark)")


def _rrf(dense_weight: float, sparse_weight: float) -> str:
    return f"""{SPARSE}, {ASKED_MMR},
parts AS (
  SELECT q, vec_id AS d, 0 AS src, rank AS place, {dense_weight} / ({RRF_K} + rank) AS part FROM taken{TOP_K}
  UNION ALL SELECT item_id, doc_id, 1, rank, {sparse_weight} / ({RRF_K} + rank) FROM sparse),
keyed AS (SELECT p.*, source, trim(text) AS text FROM parts p JOIN documents ON doc_id = d),
summed AS (SELECT q, source, text, round(sum(part), 9) AS score, min(src * 1000 + place) AS first, max_by(d, src * 1000 + place) AS doc_id FROM keyed GROUP BY ALL),
fused AS (SELECT q, doc_id, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY q ORDER BY score DESC, first) AS rank FROM summed) WHERE rank <= {TOP_K})"""


WINDOWS = f"""w0 AS (SELECT s.doc_id, s.block_idx, s.type, seg_start AS ss, seg_end AS se, t.text, length(t.text) AS n, greatest(0, (seg_start + seg_end) // 2 - {SIZE // 2}) AS a FROM segs s JOIN texts t USING (doc_id) WHERE is_special),
        w1 AS (SELECT * REPLACE (CASE WHEN ss < a THEN ss ELSE a END AS a) FROM w0),
        w2 AS (SELECT *, least(n, a + {SIZE}) AS b FROM w1),
        w3 AS (SELECT * REPLACE (CASE WHEN se > b THEN greatest(0, se - {SIZE}) ELSE a END AS a, greatest(se, b) AS b) FROM w2),
        w4 AS (SELECT *, substring(text, (a + 1)::BIGINT, (greatest(a, least(ss, a + 40, n)) - a)::BIGINT) AS lead_in FROM w3),
        w5 AS (SELECT * REPLACE (CASE WHEN a <= 0 THEN 0 WHEN regexp_matches(lead_in, '\\s') THEN a + length(regexp_extract(lead_in, '(?s)^(.*?)\\s', 1)) + 1 ELSE a END AS a) FROM w4),
        w6 AS (SELECT doc_id, block_idx, type, text, a, {soft("text", "a", "b")} AS b FROM w5)"""
LAYOUT = f"""{ATOMIC}, {WINDOWS},
special AS (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY block_idx) - 1 AS chunk_idx, a, b, text, true AS is_special, type AS special_type FROM w6 WHERE b > a AND trim(substring(text, (a + 1)::BIGINT, (b - a)::BIGINT)) <> ''),
many AS (SELECT doc_id, count(*) AS n FROM special GROUP BY doc_id),
every AS (SELECT * FROM special UNION ALL SELECT c.doc_id, idx + coalesce(m.n, 0), s, e, text, false, NULL FROM chunks c LEFT JOIN many m USING (doc_id)),
met AS (
  SELECT v.doc_id, chunk_idx, coalesce(array_to_string(list_sort(list(DISTINCT nullif(header, '')) FILTER (WHERE header <> '')), '|'), '') AS headers,
         coalesce(array_to_string(list_sort(list(DISTINCT g.type) FILTER (WHERE g.is_special)), '|'), '') AS special_types, coalesce(array_to_string(list_sort(list(DISTINCT 'page_' || page_idx)), '|'), '') AS pages
  FROM every v JOIN segs g ON g.doc_id = v.doc_id AND seg_end > a AND seg_start < b GROUP BY ALL)"""
PACK, CARRY = 600, 120
#: Hard pieces of each item in order, then packs: the state is the open pack's items, their cost, and whether one has text.
PACKS = f"""{BLOCKS},
items AS (
  SELECT doc_id, block_idx, page_idx, body, CASE WHEN type = 'image' THEN 'base/img/' || block_idx || '.png' END AS image
  FROM (SELECT *, CASE type WHEN 'text' THEN trim(CASE WHEN text_level IS NOT NULL THEN repeat('#', text_level) || ' ' || line ELSE line END) WHEN 'image' THEN trim(left(line, 40))
        WHEN 'table' THEN array_to_string(list_filter([trim(left(line, 30)), '<tr><td>' || line || '</td></tr>'], lambda v: v <> ''), chr(10)) ELSE trim(line) END AS body FROM blocks WHERE type <> 'discarded')
  WHERE body <> '' OR type = 'image'),
hard AS (
  SELECT doc_id, block_idx, body, 0::BIGINT AS f, 0::BIGINT AS t FROM items
  UNION ALL
  SELECT doc_id, block_idx, body, t, CASE WHEN length(body) - t <= {PACK} THEN length(body) WHEN instr(reverse(substring(body, t + 2, {PACK - 1})), ' ') > 0 THEN t + {PACK} - instr(reverse(substring(body, t + 2, {PACK - 1})), ' ') ELSE t + {PACK} END
  FROM hard WHERE t < length(body)),
cut AS (SELECT doc_id, block_idx, f, trim(substring(body, f + 1, t - f)) AS piece FROM hard WHERE t > f OR body = ''),
pieces AS (SELECT doc_id, block_idx, piece, row_number() OVER (PARTITION BY doc_id ORDER BY block_idx, f) AS k FROM cut WHERE piece <> '' OR block_idx IN (SELECT block_idx FROM items i WHERE i.doc_id = cut.doc_id AND body = '')),
walk AS (
  SELECT doc_id, 0::BIGINT AS k, 0::BIGINT AS pack, []::BIGINT[] AS members, []::BIGINT[] AS lens, 0::BIGINT AS used, 0::BIGINT AS texts, []::BIGINT[] AS done FROM (SELECT DISTINCT doc_id FROM pieces)
  UNION ALL
  SELECT doc_id, k, pack + full_, list_append(CASE WHEN full_ = 1 THEN kept ELSE members END, k), list_append(CASE WHEN full_ = 1 THEN kept_lens ELSE lens END, n),
         CASE WHEN full_ = 1 THEN coalesce(list_sum(kept_lens), 0) + 2 * greatest(0, len(kept) - 1) ELSE used END + cost, CASE WHEN n > 0 OR (full_ = 0 AND texts = 1) OR (full_ = 1 AND len(kept) > 0) THEN 1 ELSE 0 END, CASE WHEN full_ = 1 THEN members ELSE [] END
  FROM (
    SELECT *, list_filter(with_text, lambda x, i: list_sum(list_filter(lens, lambda y: y > 0)[i:]) + 2 * (len(with_text) - i) <= {CARRY}) AS kept, list_filter(list_filter(lens, lambda y: y > 0), lambda x, i: list_sum(list_filter(lens, lambda y: y > 0)[i:]) + 2 * (len(with_text) - i) <= {CARRY}) AS kept_lens
    FROM (
      SELECT w.doc_id, p.k, pack, members, lens, used, texts, length(piece)::BIGINT AS n, CASE WHEN piece = '' THEN 0 ELSE length(piece) + 2 * texts END::BIGINT AS cost,
             CASE WHEN len(members) > 0 AND piece <> '' AND used + length(piece) + 2 * texts > {PACK} THEN 1 ELSE 0 END::BIGINT AS full_, list_filter(members, lambda m, i: lens[i] > 0) AS with_text
      FROM walk w JOIN pieces p ON p.doc_id = w.doc_id AND p.k = w.k + 1))),
closed AS (
  SELECT doc_id, pack - 1 AS chunk_idx, done AS members FROM walk WHERE len(done) > 0
  UNION ALL SELECT doc_id, pack, members FROM walk w WHERE k = (SELECT max(k) FROM pieces p WHERE p.doc_id = w.doc_id)),
packed AS (
  SELECT doc_id, chunk_idx, pos, block_idx, piece AS text, page_idx, image
  FROM (SELECT doc_id, chunk_idx, unnest(members) AS k, (unnest(range(len(members))))::BIGINT AS pos FROM closed) JOIN pieces USING (doc_id, k) JOIN items USING (doc_id, block_idx))"""

RESULTS = """results AS (
  SELECT doc_id AS row_id, name, score, 0.01::DOUBLE AS threshold, coalesce(score, 0) >= 0.01 AS success
  FROM (SELECT doc_id, name, CASE WHEN doc_id % 9 <> 0 THEN v * 0.75::DOUBLE END AS score
        FROM (SELECT doc_id, 'quality' AS name, quality AS v FROM labels UNION ALL SELECT doc_id, 'toxic', toxic FROM labels)))"""
TURNS = """turns AS (
  SELECT conv_id, turn, trim(coalesce(text, '')) AS "user", trim(CASE WHEN next_role = 'assistant' THEN coalesce(next_text, '') ELSE '' END) AS assistant
  FROM (SELECT *, lead(role) OVER w AS next_role, lead(text) OVER w AS next_text FROM conversations WHERE role IN ('user', 'assistant') WINDOW w AS (PARTITION BY conv_id ORDER BY turn)) WHERE role = 'user'),
last2 AS (SELECT conv_id, turn, "user", assistant FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS n FROM turns) WHERE n <= 2)"""
SIDES = "SELECT conv_id, turn, 0 AS side, 'human' AS role, \"user\" AS content FROM {0} UNION ALL SELECT conv_id, turn, 1, 'ai', assistant FROM {0}"
STATE = """made AS (SELECT d.doc_id, 'markdown:/' || source || '/' || d.doc_id || '.md' AS key, quality FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id),
state AS (
  SELECT key, CASE WHEN quality = 1 THEN 'done' ELSE 'failed' END AS status, CASE WHEN quality = 1 THEN doc_id ELSE 0 END AS chunks,
         CASE WHEN quality = 1 THEN '' ELSE 'parse error' END AS error, CASE WHEN quality = 1 THEN '2024-01-02T00:00:00' ELSE '2024-01-01T00:00:00' END AS updated_at
  FROM made JOIN labels USING (doc_id, quality))"""

SQL = {
    "normalize_text": f"SELECT doc_id, {norm('text')} AS norm FROM documents",
    "strip_html": f"SELECT page_id, {bare('html')} AS stripped FROM pages",
    "session_id_normalize": "SELECT page_id, coalesce(nullif(regexp_replace(trim(coalesce(url, '')), '[^a-zA-Z0-9._-]+', '_', 'g'), ''), 'default') AS session_id FROM pages",
    "preview_text": "SELECT doc_id, CASE WHEN length(v) <= 200 THEN v ELSE left(v, 200) || '...<truncated>' END AS preview FROM (SELECT doc_id, replace(replace(text, chr(13), '\\r'), chr(10), '\\n') AS v FROM documents)",
    "source_keys": "SELECT page_id, 'markdown:' || url AS key, string_split(url, '/')[-1] AS name FROM pages",
    "retry_budgets": """SELECT attempt, CASE WHEN a > 0 THEN least(512, greatest(100, CASE WHEN g <= 100 THEN 100 * (a + 1) ELSE g END)) END::BIGINT AS num_predict
        FROM (SELECT n_nationkey::BIGINT AS attempt, n_nationkey % 5 AS a, round_even(100 * pow(1.5, n_nationkey % 5), 0) AS g FROM nation)""",
    "failure_predicates": "SELECT event_id, contains(lower(coalesce(props, '')), 'err') OR contains(lower(coalesce(props, '')), 'timeout') OR contains(lower(coalesce(props, '')), '\"k\"') AS failed FROM events",
    "metadata_sanitize": "SELECT doc_id, '{\"lang\":\"' || lang || '\",\"n_chars\":' || n_chars || '}' AS meta, '[\"' || source || '\",\"' || lang || '\"]' AS tags FROM documents",
    "token_stats": f"WITH {SPARSE} SELECT n AS n_docs, round(avg_len, 6) AS avg_len FROM stats",
    "token_stats_merged": f"WITH {SPARSE} SELECT n AS n_docs, round(avg_len, 6) AS avg_len FROM stats",
    "document_frequency": f"WITH {SPARSE} SELECT token, df FROM dfs",
    "bm25_idf_epsilon": f"WITH {SPARSE} SELECT token, df, round(idf, 6) AS idf FROM idfs",
    "bm25_topk": f"WITH {SPARSE} SELECT item_id, doc_id, score, rank FROM sparse",
    "bm25_postings": f"WITH {SPARSE} SELECT item_id, doc_id, score, rank FROM sparse",
    "dense_lists": f"WITH {dense(TOP_K)} SELECT q, vec_id, score, rank FROM pool",
    "dense_topk": f"WITH {dense(TOP_K)} SELECT q, vec_id, score, rank FROM pool",
    "dense_mmr": f"WITH {MMR} SELECT q, vec_id, rank FROM taken{TOP_K}",
    "rrf_fusion": f"WITH {_rrf(*WEIGHTS)} SELECT q, doc_id, score, rank FROM fused",
    "rrf_dense_only": f"WITH {_rrf(1.0, 0.0)} SELECT q, doc_id, score, rank FROM fused",
    "rrf_zero_weights": f"WITH {_rrf(0.5, 0.5)} SELECT q, doc_id, score, rank FROM fused",
    "dedup_doc_key": "SELECT min(doc_id) AS first_id, count(*) AS n FROM documents GROUP BY source, trim(text)",
    "prepare_contexts": f"""WITH {SPARSE}, lists AS (SELECT item_id, list_transform(list_filter(list(text ORDER BY rank)[1:3], lambda t: trim(t) <> ''), lambda t: left(t, 120)) AS l FROM sparse JOIN documents USING (doc_id) GROUP BY item_id)
        SELECT item_id, unnest(range(len(l)))::BIGINT AS pos, unnest(l) AS context FROM lists""",
    "prompt_assembly": f"""WITH {_rrf(*WEIGHTS)}, told AS (SELECT q, string_agg(d.text, chr(10) || chr(10) ORDER BY rank) AS context FROM fused JOIN documents d USING (doc_id) GROUP BY q)
        SELECT item_id AS q, 'Context:' || chr(10) || coalesce(context, '') || chr(10) || chr(10) || 'Human: ' || text AS prompt FROM benchmark LEFT JOIN told ON q = item_id""",
    "chunk_fixed": f"""SELECT doc_id, chunk_idx, chunk_idx * {SIZE - OVERLAP} AS start, substring(text, chunk_idx * {SIZE - OVERLAP} + 1, {SIZE}) AS text
        FROM (SELECT doc_id, text, unnest(range(1 + greatest(0, ceil((length(text) - {SIZE}) / {float(SIZE - OVERLAP)})::BIGINT)))::BIGINT AS chunk_idx FROM documents WHERE length(text) > 0)""",
    "chunk_soft_boundary": f"""WITH RECURSIVE {sliding("SELECT doc_id, text, NULL::STRUCT(s BIGINT, e BIGINT)[] AS special, length(text) AS n FROM documents", "")}
        SELECT doc_id, idx AS chunk_idx, s AS start, e AS "end", substring(text, s + 1, e - s) AS text FROM chunks""",
    "chunk_lateral": f"""WITH RECURSIVE {sliding("SELECT doc_id, text, NULL::STRUCT(s BIGINT, e BIGINT)[] AS special, length(text) AS n FROM documents", "")}
        SELECT doc_id, idx AS chunk_idx, s AS start, e AS "end", substring(text, s + 1, e - s) AS text FROM chunks""",
    "sticky_header": f"WITH {SEGS} SELECT doc_id, block_idx, header, prefix FROM segs",
    "segment_offsets": f"WITH {SEGS} SELECT doc_id, block_idx, seg_start, seg_end, is_special FROM segs",
    "block_texts": f"WITH {KEPT} SELECT doc_id, block_idx, type, {norm('body')} AS text, CASE type WHEN 'image' THEN {norm('left(line, 40)')} WHEN 'table' THEN {norm('left(line, 30)')} ELSE '' END AS caption FROM raw",
    "item_texts": f"""WITH {BLOCKS} SELECT doc_id, block_idx, text, CASE WHEN type = 'image' THEN 'base/img/' || block_idx || '.png' END AS image
        FROM (SELECT doc_id, block_idx, type, CASE type WHEN 'text' THEN trim(CASE WHEN text_level IS NOT NULL THEN repeat('#', text_level) || ' ' || line ELSE line END) WHEN 'image' THEN trim(left(line, 40))
              WHEN 'table' THEN array_to_string(list_filter([trim(left(line, 30)), '<tr><td>' || line || '</td></tr>'], lambda v: v <> ''), chr(10)) ELSE trim(line) END AS text FROM blocks WHERE type <> 'discarded')
        WHERE text <> '' OR type = 'image'""",
    "chunk_atomic": f"{ATOMIC} SELECT doc_id, idx AS chunk_idx, s AS start, e AS \"end\" FROM chunks",
    "special_chunks": f"""WITH {SEGS}, {WINDOWS} SELECT doc_id, block_idx, type AS special_type, a::BIGINT AS start, b::BIGINT AS "end" FROM w6 WHERE b > a""",
    "layout_chunks": f"""{LAYOUT} SELECT doc_id, chunk_idx::BIGINT AS chunk_idx, substring(text, (a + 1)::BIGINT, (b - a)::BIGINT) AS text, is_special, special_type, headers, special_types, pages FROM every JOIN met USING (doc_id, chunk_idx)""",
    "pack_segments": f"WITH RECURSIVE {PACKS} SELECT doc_id, chunk_idx, pos, block_idx, text FROM packed",
    "packed_documents": f"""WITH RECURSIVE {PACKS},
        made AS (SELECT doc_id, chunk_idx, string_agg(text, chr(10) || chr(10) ORDER BY pos) FILTER (WHERE text <> '') AS joined, min(page_idx) AS page_start, max(page_idx) AS page_end, string_agg(image, '|' ORDER BY pos) AS image_paths FROM packed GROUP BY ALL)
        SELECT doc_id, chunk_idx, coalesce(joined, 'Image from ' || source || '.pdf page ' || page_start) AS page_content, source || '.pdf' AS source_file, page_start, page_end, coalesce(image_paths, '') AS image_paths FROM made JOIN documents USING (doc_id)""",
    "json_recover": "SELECT item_id, '{\"text\":' || to_json(text)::VARCHAR || '}' AS json FROM benchmark",
    "chunk_segment_overlap": f"""{ATOMIC} SELECT c.doc_id, idx AS chunk_idx, page_idx, min(greatest(seg_start, c.s) - c.s)::BIGINT AS page_from, max(least(seg_end, e) - c.s)::BIGINT AS page_to
        FROM chunks c JOIN segs g ON g.doc_id = c.doc_id AND seg_end > c.s AND seg_start < e GROUP BY ALL""",
    "chunk_segment_bins": f"""{ATOMIC} SELECT c.doc_id, idx AS chunk_idx, page_idx, min(greatest(seg_start, c.s) - c.s)::BIGINT AS page_from, max(least(seg_end, e) - c.s)::BIGINT AS page_to
        FROM chunks c JOIN segs g ON g.doc_id = c.doc_id AND seg_end > c.s AND seg_start < e GROUP BY ALL""",
    "neighbor_context": f"""WITH {KEPT}, plain AS (SELECT doc_id, block_idx, nullif({norm('body')}, '') AS t FROM raw)
        SELECT doc_id, block_idx, right(coalesce(string_agg(t, ' ') OVER (PARTITION BY doc_id ORDER BY block_idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), ''), 250) AS "left",
               left(coalesce(string_agg(t, ' ') OVER (PARTITION BY doc_id ORDER BY block_idx ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), ''), 250) AS "right" FROM plain""",
    "page_bbox_union": f"""WITH {BLOCKS} SELECT doc_id, page_idx, min(x0)::INTEGER AS x0, min(y0)::INTEGER AS y0, max(x1)::INTEGER AS x1, max(y1)::INTEGER AS y1
        FROM blocks WHERE type <> 'discarded' AND (type = 'image' OR trim(line) <> '' OR type = 'table') GROUP BY doc_id, page_idx""",
    "bbox_normalize": f"""WITH {BLOCKS} SELECT doc_id, block_idx, trunc(x0 * 1000 / 612.0)::INTEGER AS x0, trunc(y0 * 1000 / 792.0)::INTEGER AS y0, trunc(x1 * 1000 / 612.0)::INTEGER AS x1, trunc(y1 * 1000 / 792.0)::INTEGER AS y1 FROM blocks""",
    "chat_turn_pairs": f"WITH {TURNS} SELECT * FROM turns",
    "chat_last_n": f"WITH {TURNS} SELECT * FROM last2",
    "chat_messages": f"WITH {TURNS}, sides AS ({SIDES.format('last2')}) SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn, side) AS seq, role, content FROM sides WHERE content <> ''",
    "chat_turn_count": f"WITH {TURNS}, sides AS ({SIDES.format('turns')}) SELECT conv_id, count(*) // 2 AS n_turns FROM sides WHERE content <> '' GROUP BY conv_id",
    "metric_summary": f"WITH {RESULTS} SELECT name, round_even(avg(score), 4) AS mean_score, round_even(sum(success::INTEGER) / count(*)::DOUBLE, 4) AS pass_rate, count(*) AS count, min_by(threshold, row_id) AS threshold FROM results GROUP BY name",
    "metric_rollup": f"""WITH {RESULTS} SELECT name, source, lang, grouping_id(name, source, lang)::BIGINT AS grouping, round_even(avg(score), 4) AS mean_score, round_even(sum(success::INTEGER) / count(*)::DOUBLE, 4) AS pass_rate, count(*) AS count
        FROM results JOIN documents ON doc_id = row_id GROUP BY GROUPING SETS ((name), (name, source), (name, lang))""",
    "row_id_then_filter": "SELECT item_id, question, row_id FROM (SELECT item_id, CASE WHEN item_id % 4 <> 0 THEN text ELSE '  ' END AS question, row_number() OVER (ORDER BY item_id) AS row_id FROM benchmark) WHERE trim(question) <> ''",
    "eval_dataset_validate": "SELECT item_id, text AS question, left(text, 60) AS ground_truth FROM benchmark",
    "contextual_precision": """SELECT case_id, round(coalesce(sum(p) FILTER (WHERE quality = 1) / nullif(sum(quality), 0), 0), 6) AS score FROM (
        SELECT case_id, quality, sum(quality) OVER w / count(*) OVER w AS p FROM (SELECT doc_id // 10 AS case_id, doc_id, quality FROM labels) WINDOW w AS (PARTITION BY case_id ORDER BY doc_id ROWS UNBOUNDED PRECEDING)) GROUP BY case_id""",
    "answer_relevancy_ratio": "SELECT doc_id // 10 AS case_id, round(avg(quality), 6) AS score FROM labels GROUP BY ALL",
    "failed_result_padding": f"""WITH {RESULTS} SELECT row_id, name, score, threshold, success, 'judged' AS reason FROM results
        UNION ALL SELECT doc_id, unnest(['Answer Relevancy', 'Faithfulness', 'Contextual Precision']), NULL, 0.01, false, 'no result' FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)""",
    "checkpoint_latest": f"WITH {STATE} SELECT * FROM state",
    "state_as_of": """WITH docs AS (SELECT doc_id, 'markdown:/' || source || '/' || doc_id || '.md' AS key, '2024-01-0' || (doc_id % 3) || 'T12:00:00' AS asked_at FROM documents),
        log AS (SELECT key, 'failed' AS status, '2024-01-01T00:00:00' AS updated_at FROM docs JOIN labels USING (doc_id) UNION ALL SELECT key, 'done', '2024-01-02T00:00:00' FROM docs JOIN labels USING (doc_id) WHERE quality = 1)
        SELECT doc_id, asked_at, status, updated_at FROM docs ASOF LEFT JOIN log ON docs.key = log.key AND docs.asked_at >= log.updated_at""",
    "ingest_pending": f"WITH {STATE} SELECT doc_id, key FROM made WHERE key NOT IN (SELECT key FROM state WHERE status = 'done')",
    "failure_isolation_counts": "SELECT CASE WHEN doc_id % 13 = 0 THEN 'failed' WHEN doc_id % 5 = 0 THEN 'skipped' ELSE 'done' END AS status, count(*) AS n FROM documents GROUP BY ALL",
}
