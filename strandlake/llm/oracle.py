"""DuckDB SQL for the operators that SQL can express, written independently of them.

Learned scores, span selection by trees, media files, tokens and the licence scan's inherited
rows are tested against plain Python instead."""

from __future__ import annotations

from .queries import TARGET

_SEP = "[\\x20\\x09-\\x0D]"
_WORDS = f"list_filter(regexp_split_to_array(coalesce(text, ''), '{_SEP}+'), lambda x: x <> '')"
_LOW = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

_SUBSTRINGS = f"""WITH w AS (SELECT doc_id, {_WORDS} AS ws FROM documents),
    g AS (SELECT doc_id, s, array_to_string(ws[s:s + 19], ' ') AS body FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 18)) AS s FROM w)),
    again AS (SELECT doc_id, s FROM g QUALIFY row_number() OVER (PARTITION BY body ORDER BY doc_id, s) > 1),
    gone AS (SELECT DISTINCT doc_id, s + i AS pos FROM again, range(0, 20) AS r(i)),
    words AS (SELECT doc_id, ws[pos] AS word, pos FROM (SELECT doc_id, ws, unnest(range(1, len(ws) + 1)) AS pos FROM w)),
    kept AS (SELECT words.doc_id, string_agg(word, ' ' ORDER BY pos) AS body FROM words ANTI JOIN gone USING (doc_id, pos) GROUP BY 1),
    cut AS (SELECT doc_id, count(*) AS n FROM gone GROUP BY 1)
    SELECT doc_id, len(ws)::BIGINT AS n_words, coalesce(n, 0)::BIGINT AS n_removed, sha256(coalesce(body, '')) AS kept_sha256
    FROM w LEFT JOIN cut USING (doc_id) LEFT JOIN kept USING (doc_id)"""

_EXACT = f"""WITH d AS (SELECT doc_id, length(coalesce(text, '')) AS points, regexp_replace(coalesce(text, ''), '{_SEP}', '', 'g') AS body FROM documents)
    SELECT doc_id, first_value(doc_id) OVER w AS keep_id, count(*) OVER (PARTITION BY body) AS group_size,
           doc_id = first_value(doc_id) OVER w AS kept, sha256(body) AS text_sha256
    FROM d WINDOW w AS (PARTITION BY body ORDER BY points DESC, doc_id)"""

_BATCHES = f"""WITH d AS (SELECT doc_id, doc_id % 2 AS batch, length(coalesce(text, '')) AS points, regexp_replace(coalesce(text, ''), '{_SEP}', '', 'g') AS body FROM documents),
    g AS (SELECT *, first_value(doc_id) OVER w AS best, count(*) OVER (PARTITION BY body, batch) AS n, min(batch) OVER (PARTITION BY body) AS brought
          FROM d WINDOW w AS (PARTITION BY body, batch ORDER BY points DESC, doc_id)),
    b AS (SELECT DISTINCT body, best, n FROM g WHERE batch = brought)
    SELECT g.doc_id, b.best AS keep_id, b.n AS group_size, g.batch = g.brought AND g.doc_id = b.best AS kept, sha256(g.body) AS text_sha256, g.batch::INTEGER AS batch
    FROM g JOIN b USING (body)"""

_NEAR = f"""WITH RECURSIVE w AS (SELECT doc_id, list_filter(regexp_split_to_array({_LOW}, '{_SEP}+'), lambda x: x <> '') AS ws FROM documents),
    sh AS (SELECT DISTINCT doc_id, array_to_string(ws[s:s + 4], ' ') AS g FROM (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - 3, 2))) AS s FROM w WHERE len(ws) > 0)),
    n AS (SELECT doc_id, count(*) AS n FROM sh GROUP BY 1),
    pairs AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS shared FROM sh a JOIN sh b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
    links AS (SELECT x, y FROM pairs JOIN n nx ON nx.doc_id = x JOIN n ny ON ny.doc_id = y WHERE 100 * shared >= 85 * (nx.n + ny.n - shared)),
    sides AS (SELECT x, y FROM links UNION ALL SELECT y, x FROM links),
    reach(doc_id, root) AS (SELECT doc_id, doc_id FROM w UNION SELECT y, root FROM reach JOIN sides ON x = doc_id)
    SELECT doc_id, coalesce(any_value(n), 0)::BIGINT AS n_shingles, min(root) AS component_id, doc_id = min(root) AS kept
    FROM reach LEFT JOIN n USING (doc_id) GROUP BY doc_id"""


_P = "1 + (1000000000::HUGEINT * (n + 1)) // (total + v)"
_DIVERGENCE = f"""WITH d AS (SELECT row_number() OVER () AS id, coalesce(lang, '') AS lang, coalesce(source, '') AS source, {_LOW} AS body FROM documents),
    t AS (SELECT id, lang, source, unnest(regexp_extract_all(body, '[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+')) AS term FROM d),
    kept AS (SELECT lang, term, count(*) AS n FROM t GROUP BY 1, 2 HAVING count(DISTINCT id) >= 3),
    counts AS (SELECT lang, source, term, count(*) AS n FROM t SEMI JOIN kept USING (lang, term) GROUP BY 1, 2, 3),
    groups AS (SELECT DISTINCT lang, source FROM d),
    cells AS (SELECT groups.lang, groups.source, kept.term, coalesce(counts.n, 0) AS n FROM groups JOIN kept USING (lang)
              LEFT JOIN counts ON counts.lang = groups.lang AND counts.source = groups.source AND counts.term = kept.term),
    p AS (SELECT lang, source, term, n, {_P} AS p FROM (SELECT *, sum(n) OVER (PARTITION BY lang, source) AS total, count(*) OVER (PARTITION BY lang, source) AS v FROM cells)),
    q AS (SELECT lang, term, {_P} AS q FROM (SELECT *, sum(n) OVER (PARTITION BY lang) AS total, count(*) OVER (PARTITION BY lang) AS v FROM kept)),
    pairs AS (SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // b.p) AS value FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY 1, 2, 3),
    every AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(value, 0)::BIGINT AS value FROM groups a JOIN groups b ON a.lang = b.lang AND a.source <> b.source
              LEFT JOIN pairs ON pairs.lang = a.lang AND pairs.source = a.source AND pairs.item = b.source
              UNION ALL SELECT lang, source, 'term', term, ((p - q) * (p - q) // q)::BIGINT FROM p JOIN q USING (lang, term) WHERE n > 0 AND p > q),
    ranked AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item)::INTEGER AS rank FROM every)
    SELECT * FROM ranked WHERE part = 'pair' OR rank <= 200"""


_CRC = """xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(1, length(k) + 1), lambda i: ascii(substring(k, i, 1))::BIGINT)),
    lambda c, b: list_reduce(list_prepend(xor(c, b), range(8)), lambda x, i: xor(x >> 1, 3988292384 * (x & 1)))))"""
_REPAIR = f"""WITH RECURSIVE k AS (SELECT conv_id AS cid, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS k FROM conversations),
    d AS (SELECT cid, turn, role, text, {_CRC} % 20 AS d FROM k),
    m AS (SELECT cid, turn, CASE WHEN d = 4 THEN 'user' ELSE role END AS role, CASE WHEN d = 1 THEN '' WHEN d = 2 THEN translate(text, '.!?', '') ELSE text END AS text,
                 unnest(CASE WHEN d = 3 THEN [0, 1] ELSE [0] END) AS copy FROM d WHERE d <> 0),
    o AS (SELECT *, row_number() OVER (PARTITION BY cid ORDER BY turn NULLS FIRST, role, text, copy) AS rn, rtrim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS bare FROM m),
    r AS (SELECT cid, turn, role, text, rn, left(role, 1) AS i, CASE WHEN bare = '' THEN 'blank' WHEN row_number() OVER (PARTITION BY cid, role, text ORDER BY rn) > 1 THEN 'duplicate'
                 WHEN right(bare, 1) NOT IN ('.', '!', '?') THEN 'truncated' ELSE '' END AS f FROM o),
    ins(before, run, mid) AS (VALUES (0, '', 0), (0, 'I', 2), (0, 'II', 3), (1, '', 1), (1, 'I', 2), (1, 'II', 3), (2, '', 2), (2, 'I', 3), (2, 'II', 2), (3, '', 3), (3, 'I', 2), (3, 'II', 3)),
    st(cid, rn, state, best) AS (SELECT DISTINCT cid, 0::BIGINT, 0, row(0, '') FROM r UNION ALL
        SELECT cid, rn, after, min(best) FROM (
            SELECT st.cid, r.rn, e.after, row(st.best[1] + 2 * length(run) + e.price + CASE WHEN f = 'truncated' AND e.letter <> 'D' THEN 1 ELSE 0 END, st.best[2] || run || e.letter) AS best
            FROM st JOIN r ON r.cid = st.cid AND r.rn = st.rn + 1 JOIN ins ON before = state
            JOIN (VALUES ('D', 0, 0, 3, ''), ('D', 1, 1, 3, ''), ('D', 2, 2, 3, ''), ('D', 3, 3, 3, ''), ('R', 0, 2, 2, ''), ('R', 1, 2, 2, ''), ('R', 3, 2, 2, ''), ('R', 2, 3, 2, ''),
                         ('K', 0, 1, 0, 's'), ('K', 0, 2, 0, 'u'), ('K', 1, 2, 0, 'u'), ('K', 3, 2, 0, 'u'), ('K', 2, 3, 0, 'a')) AS e(letter, mid, after, price, need)
            ON e.mid = ins.mid AND (e.need = '' OR e.need = i) AND (e.letter = 'D' OR f NOT IN ('blank', 'duplicate'))) GROUP BY ALL),
    fin AS (SELECT cid, min(row(best[1] + CASE state WHEN 1 THEN 4 WHEN 2 THEN 2 ELSE 0 END, best[2] || CASE state WHEN 1 THEN 'II' WHEN 2 THEN 'I' ELSE '' END)) AS best
            FROM st JOIN (SELECT cid, max(rn) AS rn FROM r GROUP BY 1) USING (cid, rn) GROUP BY 1),
    au AS (SELECT cid, best[1]::BIGINT AS cost, best[2] AS audit FROM fin),
    le AS (SELECT cid, p, substring(audit, p, 1) AS l FROM (SELECT cid, audit, unnest(range(1, length(audit) + 1)) AS p FROM au)),
    steps AS (SELECT cid, p, l, sum((l <> 'I')::INT) OVER w AS rn, sum((l <> 'D')::INT) OVER w AS e FROM le WINDOW w AS (PARTITION BY cid ORDER BY p)),
    li AS (SELECT steps.cid, p, l, e, role, text, bool_or(e = 1 AND l = 'K' AND i = 's') OVER (PARTITION BY steps.cid) AS led FROM steps LEFT JOIN r ON r.cid = steps.cid AND r.rn = steps.rn AND l <> 'I' WHERE l <> 'D'),
    rep AS (SELECT cid, string_agg(CASE WHEN l = 'K' THEN role WHEN (e - led::INT) % 2 = 1 THEN 'user' ELSE 'assistant' END || ':' || coalesce(text, ''), chr(10) ORDER BY p) AS body FROM li GROUP BY 1),
    cnt AS (SELECT cid, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (f = 'blank') AS blank, count(*) FILTER (f = 'duplicate') AS duplicate, count(*) FILTER (f = 'truncated') AS truncated,
                   count(*) FILTER (before IS NOT NULL AND before || i NOT IN ('su', 'ua', 'au')) AS illegal FROM (SELECT *, lag(i) OVER (PARTITION BY cid ORDER BY rn) AS before FROM r) GROUP BY 1)
    SELECT conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal,
           coalesce(cost, 0) AS cost, coalesce(audit, '') AS audit, sha256(coalesce(body, '')) AS repaired_sha256
    FROM (SELECT DISTINCT conv_id FROM conversations) LEFT JOIN cnt ON cnt.cid = conv_id LEFT JOIN au ON au.cid = conv_id LEFT JOIN rep ON rep.cid = conv_id"""


_VECTORS = """WITH RECURSIVE v AS (SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings WHERE label IS NOT NULL AND len(list_filter(embedding, lambda x: x <> 0)) > 0
        AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
    links AS (SELECT a.vec_id AS x, b.vec_id AS y FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e) WHERE list_cosine_similarity(a.e, b.e) >= 0.98),
    reach(vec_id, root) AS (SELECT vec_id, vec_id FROM embeddings UNION SELECT y, root FROM reach JOIN links ON x = vec_id),
    n AS (SELECT x AS vec_id, count(*) AS n FROM links GROUP BY 1)
    SELECT vec_id, coalesce(any_value(n), 0) AS n_links, min(root) AS component_id, vec_id = min(root) AS kept FROM reach LEFT JOIN n USING (vec_id) GROUP BY 1"""


def _mix() -> str:
    """The repetition limit has a closed form: shares p keep it from the exponent
    1 - ln(limit) / ln(max p / min p) on."""
    hashed = lambda epoch: f"md5('{TARGET.seed}|' || {epoch} || '|' || coalesce(doc_id::VARCHAR, ''))"
    block = lambda h, n: f"(('0x' || substr({h}, 1, 7))::BIGINT % {n})"
    return f"""WITH d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+'))::BIGINT + 1 AS tokens FROM documents),
    t AS (SELECT source, sum(tokens)::BIGINT AS total FROM d GROUP BY 1),
    a AS (SELECT round(greatest(0, 1 - ln({TARGET.max_repetition}) / greatest(ln(max(total)::DOUBLE / min(total)), 1e-12)), 6) AS a, sum(total)::BIGINT AS everything FROM t),
    raw AS (SELECT source, total, pow(total::DOUBLE / everything, a) AS raw FROM t, a),
    cover AS (SELECT max(total / raw) AS cover FROM raw),
    want AS (SELECT source, total, round(raw * cover)::BIGINT AS wanted FROM raw, cover),
    plan AS (SELECT source, total, wanted // total AS passes, wanted % total AS rest, ceil(total / {float(TARGET.block_tokens)})::BIGINT AS blocks FROM want),
    part AS (SELECT d.*, passes AS epoch, rest, {hashed('passes')} AS h, {block(hashed('passes'), 'blocks')} AS block FROM d JOIN plan USING (source) WHERE rest > 0),
    upto AS (SELECT *, sum(tokens) OVER (PARTITION BY source ORDER BY block, h, doc_id) AS upto FROM part),
    lead_part AS (SELECT doc_id, source, tokens, epoch, h, block FROM upto WHERE upto <= rest),
    whole AS (SELECT doc_id, source, tokens, e AS epoch, {hashed('e')} AS h, {block(hashed('e'), 'blocks')} AS block
              FROM (SELECT d.*, blocks, unnest(range(0, passes)) AS e FROM d JOIN plan USING (source))),
    every AS (SELECT * FROM whole UNION ALL SELECT * FROM lead_part)
    SELECT doc_id, source, tokens, epoch, block, row_number() OVER (PARTITION BY source, epoch, block ORDER BY h, doc_id) AS position FROM every"""


def oracle_sql() -> dict[str, str]:
    return {"op1_substring_dedup": _SUBSTRINGS, "op2_source_mixing": _mix(), "op3_exact_dedup": _EXACT, "exact_dedup_batches": _BATCHES, "op8_near_dedup": _NEAR, "op11_source_divergence": _DIVERGENCE, "op12_metric_join": _VECTORS, "op13_turn_repair": _REPAIR}
