"""DuckDB SQL with the same results as the queries, written independently of them."""

from __future__ import annotations

import string

from ..functions.genetic_code import GENETIC_CODE, NUTRITION, NUTRITION_DEFAULT

_LOW, _UP = string.ascii_lowercase, string.ascii_uppercase


def _upper(text: str) -> str:
    return f"translate({text}, '{_LOW}', '{_UP}')"


def _acgt(text: str) -> str:
    return f"regexp_replace({_upper(text)}, '[^ACGT]', '', 'g')"


def _squeezed(text: str) -> str:
    return f"translate({text}, ' ' || chr(9) || chr(13) || chr(10), '')"


_SEQ = f"seqs AS (SELECT doc_id AS seq_id, lang, {_acgt('coalesce(text, \'\')')} AS q FROM documents)"
_CHARS = "chars AS (SELECT doc_id, lang, unnest(string_split(text, '')) AS symbol FROM documents WHERE length(text) > 0)"


def _windows(k: int) -> str:
    return f"grams AS (SELECT seq_id, unnest(range(0, length(q) - {k} + 1)) AS pos, q FROM seqs WHERE length(q) >= {k})"


def _kmers(k: int) -> str:
    letters = "(VALUES ('A'), ('C'), ('G'), ('T'))"
    parts = ", ".join(f"{letters} AS x{i}(b{i})" for i in range(k))
    return f"""WITH {_SEQ}, {_windows(k)},
    dom AS (SELECT {' || '.join(f'b{i}' for i in range(k))} AS kmer FROM {parts}),
    cnt AS (SELECT substring(q, pos + 1, {k}) AS kmer, count(*) AS n FROM grams GROUP BY 1),
    tot AS (SELECT coalesce(sum(n), 0)::BIGINT AS total FROM cnt)
    SELECT kmer, coalesce(n, 0)::BIGINT AS n, total,
           CASE WHEN total > 0 THEN coalesce(n, 0)::DOUBLE / total ELSE 0.0 END AS freq
    FROM dom LEFT JOIN cnt USING (kmer) CROSS JOIN tot"""


_GC = f"""WITH {_SEQ}, {_windows(9)},
    gc AS (SELECT seq_id, pos, length(translate(substring(q, pos + 1, 9), 'AT', '')) AS gc FROM grams),
    bins AS (SELECT seq_id, pos // 256 AS bin, sum(18 + 2 * gc)::BIGINT AS sum_tm, min(18 + 2 * gc)::BIGINT AS min_tm,
                    max(18 + 2 * gc)::BIGINT AS max_tm, count(*) AS n FROM gc GROUP BY 1, 2)"""

_SLIDE = f"""WITH {_SEQ},
    wins AS (SELECT seq_id, unnest(range(0, length(q) - 49, 10)) AS pos, q FROM seqs WHERE length(q) >= 50),
    cut AS (SELECT seq_id, pos // 10 AS win_idx, substring(q, pos + 1, 50) AS w FROM wins),
    counts AS (SELECT seq_id, win_idx, {', '.join(f"(50 - length(replace(w, '{b}', '')))::BIGINT AS {b.lower()}" for b in 'ACGT')} FROM cut)"""

_RNA = f"{_SEQ}, rna AS (SELECT seq_id, lang, replace(q, 'T', 'U') AS r, length(q)::BIGINT AS n FROM seqs)"

_ORFS = f"""{_RNA},
    cods AS (SELECT seq_id, lang, n, r, unnest(range(0, n - 2)) AS p FROM rna WHERE n >= 3),
    marked AS (SELECT seq_id, lang, n, r, p, substring(r, p + 1, 3) AS c FROM cods),
    isl AS (SELECT *, coalesce(sum(CASE WHEN c IN ('UAA', 'UAG', 'UGA') THEN 1 ELSE 0 END) OVER
                (PARTITION BY seq_id, p % 3 ORDER BY p ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS g FROM marked),
    grp AS (SELECT seq_id, lang, (p % 3)::INTEGER AS frame, g, min(CASE WHEN c = 'AUG' THEN p END) AS st,
                   max(CASE WHEN c IN ('UAA', 'UAG', 'UGA') THEN p END) AS sp, max(p) + 3 AS en, max(n) AS n, any_value(r) AS r
            FROM isl GROUP BY 1, 2, 3, 4),
    orf AS (SELECT seq_id, lang, frame, st AS "start", coalesce(sp, en) AS "end", sp IS NOT NULL AS terminated, r FROM grp
            WHERE st IS NOT NULL AND CASE WHEN sp IS NOT NULL THEN sp - st ELSE n - st END >= 30)"""

_CODE = "code(codon, aa) AS (VALUES " + ", ".join(f"('{c}', '{a}')" for c, a in sorted(GENETIC_CODE.items())) + ")"

_USAGE = f"""{_ORFS}, {_CODE},
    used AS (SELECT lang, seq_id, frame, "start", i, substring(r, ("start" + i * 3 + 1)::BIGINT, 3) AS codon
             FROM (SELECT *, unnest(range(0, ("end" - "start") // 3)) AS i FROM orf)),
    usage AS (SELECT lang, codon, count(*) AS n, min(row(seq_id, frame, "start", i)) AS f FROM used GROUP BY 1, 2),
    top AS (SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY n DESC, f) AS rank, codon, n FROM usage),
    acids AS (SELECT lang, aa, sum(n)::BIGINT AS n, min(f) AS f FROM usage JOIN code USING (codon) WHERE aa <> '*' GROUP BY 1, 2),
    topaa AS (SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY n DESC, f) AS rank, aa, n FROM acids)"""


def _protein(region: str) -> str:
    """Translation of the RNA expression ``region`` (a column), codon by codon."""
    code = "map {" + ", ".join(f"'{c}': '{a}'" for c, a in sorted(GENETIC_CODE.items())) + "}"
    codons = f"list_transform(range(0, length({region}) // 3), lambda i: substring({region}, i * 3 + 1, 3))"
    return f"array_to_string(list_transform({codons}, lambda c: coalesce(({code})[c], 'X')), '')"


def _frame(number: int) -> str:
    return f"WITH {_RNA}, cut AS (SELECT seq_id, substring(r, {number}) AS x FROM rna) SELECT seq_id, {_protein('x')} AS protein FROM cut"


_FIRST = f"""{_RNA},
    st AS (SELECT seq_id, r, n, instr(r, 'AUG') AS a FROM rna),
    body AS (SELECT seq_id, r, n, a, CASE WHEN a > 0 THEN list_filter(range(a - 1, n - 2, 3),
                lambda p: substring(r, p + 1, 3) IN ('UAA', 'UAG', 'UGA')) END AS stops FROM st),
    bounds AS (SELECT seq_id, r, greatest(a - 1, 0)::BIGINT AS "start",
                      CASE WHEN a > 0 AND len(stops) > 0 THEN stops[1] ELSE n END::BIGINT AS "end" FROM body)"""

_READS = f"""rd AS (SELECT conv_id AS assembly_id, turn AS read_id, {_acgt("coalesce(text, '')")} AS seq FROM conversations),
    uq AS (SELECT assembly_id, seq, count(*) AS copies, min(read_id) AS first_id FROM rd GROUP BY 1, 2),
    un AS (SELECT assembly_id, row_number() OVER (PARTITION BY assembly_id ORDER BY first_id) - 1 AS uid, seq, copies, first_id FROM uq)"""

_PAIRS = f"""{_READS},
    pairs AS (SELECT o.assembly_id * 1000 + o.read_id AS pair_id, f.seq AS a, o.seq AS b FROM rd o JOIN rd f
              ON f.assembly_id = o.assembly_id AND f.read_id = 0 WHERE o.read_id > 0),
    sides AS (SELECT pair_id, CASE WHEN length(a) < length(b) THEN a ELSE b END AS s, CASE WHEN length(a) < length(b) THEN b ELSE a END AS l,
                     CASE WHEN length(a) < length(b) THEN -1 ELSE 1 END AS sign FROM pairs),
    sc AS (SELECT pair_id, unnest(range(0, length(s))) AS i, s FROM sides WHERE length(s) > 0),
    lc AS (SELECT pair_id, unnest(range(0, length(l))) AS j, l FROM sides WHERE length(s) > 0),
    hits AS (SELECT pair_id, j - i AS off, count(*) AS matches FROM sc JOIN lc USING (pair_id)
             WHERE substring(s, i + 1, 1) = substring(l, j + 1, 1) GROUP BY 1, 2),
    shifts AS (SELECT pair_id, sign, length(s) AS ls, length(l) AS ll, unnest(range(1 - length(s), length(l))) AS off FROM sides WHERE length(s) > 0),
    prof AS (SELECT pair_id, off, sign, coalesce(matches, 0) AS matches, least(ls, ll - off) - greatest(0, -off) AS total
             FROM shifts LEFT JOIN hits USING (pair_id, off))"""


def _draw(what: str, room: str) -> str:
    return f"(('0x' || substr(md5('42|' || seq_id || '|' || read_id || '|{what}'), 1, 15))::BIGINT % ({room}))::INTEGER"


_SAMPLED = f"""{_SEQ}, dr AS (SELECT seq_id, q, unnest(range(0, 6))::INTEGER AS read_id FROM seqs WHERE length(q) >= 60),
    ln AS (SELECT *, 40 + {_draw('len', '21')} AS len FROM dr),
    st AS (SELECT *, {_draw('start', 'length(q) - len + 1')} AS start FROM ln),
    sm AS (SELECT seq_id, read_id, start, len, substring(q, start + 1, len) AS seq FROM st)"""


_COVERED = f"""{_SEQ}, dr AS (SELECT seq_id, q, length(q) AS n, unnest(range(0, ceil(length(q) * 8.0::DOUBLE / 100)::BIGINT))::INTEGER AS read_id FROM seqs WHERE length(q) > 0),
    ln AS (SELECT *, (least(40, n) + {_draw('len', 'least(60, n) - least(40, n) + 1')})::INTEGER AS len FROM dr),
    st AS (SELECT *, {_draw('start', 'n - len + 1')} AS start FROM ln),
    sm AS (SELECT seq_id, read_id, start, len, substring(q, start + 1, len) AS seq FROM st)"""

_GRAPH = f"""{_READS},
    pr AS (SELECT l.assembly_id, l.uid AS left_uid, r.uid AS right_uid, length(l.seq) AS n,
                  list_max(list_filter(range(3, least(length(l.seq), length(r.seq))), lambda n: right(l.seq, n) = left(r.seq, n))) AS overlap
           FROM un l JOIN un r ON l.assembly_id = r.assembly_id AND l.uid <> r.uid),
    gr AS (SELECT assembly_id, left_uid, right_uid, overlap, n - overlap AS far FROM pr WHERE overlap IS NOT NULL)"""


def _walk(name: str, meets: str, longer: str) -> str:
    """Steps from the seed to the first unused read that meets the end, as a recursive table."""
    return f"""{name}(id, seq, used, contig) AS (SELECT id, seq, used, contig FROM {'seed' if name == 'ahead' else 'turned'} UNION ALL
        SELECT id, r.seq, list_append(used, r.uid), {longer} FROM {name} w, LATERAL (SELECT arg_min(un.seq, un.uid) AS seq, min(un.uid) AS uid FROM un
            WHERE un.id = w.id AND {meets} AND NOT list_contains(w.used, un.uid)) AS r WHERE r.uid IS NOT NULL)"""


_ASSEMBLED = f"""WITH RECURSIVE {_SAMPLED},
    uq AS (SELECT seq_id AS id, seq, min(read_id) AS first_id FROM sm GROUP BY 1, 2),
    un AS (SELECT id, seq, row_number() OVER (PARTITION BY id ORDER BY first_id) - 1 AS uid FROM uq),
    seed AS (SELECT id, seq, [uid] AS used, seq AS contig FROM un QUALIFY row_number() OVER (PARTITION BY id ORDER BY length(seq) DESC, uid) = 1),
    {_walk('ahead', 'left(un.seq, 12) = right(w.seq, 12)', 'contig || substring(r.seq, 13)')},
    turned AS (SELECT id, seed.seq, last.used, last.contig FROM (SELECT id, arg_max(used, len(used)) AS used, arg_max(contig, len(used)) AS contig FROM ahead GROUP BY 1) AS last
               JOIN seed USING (id)),
    {_walk('back', 'right(un.seq, 12) = left(w.seq, 12)', 'left(r.seq, length(r.seq) - 12) || contig')}
    SELECT id AS assembly_id, arg_max(contig, len(used)) AS contig, max(len(used))::BIGINT AS reads_used,
           any_value((SELECT count(*) FROM un WHERE un.id = back.id)) AS reads FROM back GROUP BY 1"""


_JOINED = f"""{_SEQ},
    ch AS (SELECT lang, seq_id, unnest(string_split(q, '')) AS c, generate_subscripts(string_split(q, ''), 1) AS i FROM seqs WHERE q <> ''),
    pos AS (SELECT lang, c, row_number() OVER (PARTITION BY lang ORDER BY seq_id, i) - 1 AS p, count(*) OVER (PARTITION BY lang) AS n FROM ch)"""
_JOINED_TM = """gc AS (SELECT lang, p, n, sum((c IN ('G', 'C'))::INT) OVER (PARTITION BY lang ORDER BY p ROWS BETWEEN CURRENT ROW AND 8 FOLLOWING) AS gc FROM pos),
    bins AS (SELECT lang, p // {per} AS bin, sum(18 + 2 * gc)::BIGINT AS sum_tm, min(18 + 2 * gc)::BIGINT AS min_tm, max(18 + 2 * gc)::BIGINT AS max_tm, count(*) AS n
             FROM gc WHERE p <= n - 9 GROUP BY 1, 2)"""
_JOINED_ORFS = f"""{_JOINED},
    tri AS (SELECT lang, p, n, translate(c || lead(c) OVER w || lead(c, 2) OVER w, 'T', 'U') AS c FROM pos WINDOW w AS (PARTITION BY lang ORDER BY p)),
    isl AS (SELECT *, coalesce(sum((c IN ('UAA', 'UAG', 'UGA'))::INT) OVER (PARTITION BY lang, p % 3 ORDER BY p ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS g
            FROM tri WHERE p <= n - 3),
    grp AS (SELECT lang, (p % 3)::INTEGER AS frame, g, min(CASE WHEN c = 'AUG' THEN p END) AS st, max(CASE WHEN c IN ('UAA', 'UAG', 'UGA') THEN p END) AS sp, max(p) + 3 AS en, max(n) AS n
            FROM isl GROUP BY 1, 2, 3),
    orf AS (SELECT lang, frame, st AS "start", coalesce(sp, en) AS "end", sp IS NOT NULL AS terminated FROM grp
            WHERE st IS NOT NULL AND CASE WHEN sp IS NOT NULL THEN sp - st ELSE n - st END >= 30),
    used AS (SELECT isl.lang, isl.c AS codon, frame, "start", (p - "start") // 3 AS i FROM isl JOIN orf ON orf.lang = isl.lang AND p % 3 = frame AND p >= "start" AND p < "end"),
    usage AS (SELECT lang, codon, count(*) AS n, min(row(frame, "start", i)) AS f FROM used GROUP BY 1, 2)"""


def _foods(which: str) -> str:
    cases = " ".join(f"WHEN '{aa}' THEN '{'; '.join(known[which])}'" for aa, known in NUTRITION.items())
    return f"CASE aa {cases} ELSE '{'; '.join(NUTRITION_DEFAULT[which])}' END"


def oracle_sql() -> dict[str, str]:
    shown = f"translate({_upper('text')}, ' ' || chr(9) || chr(13) || chr(10), '')"
    header = "CASE WHEN length(trim(h)) > 120 THEN left(trim(h), 120) || '…' ELSE trim(h) END"
    records = f"recs AS (SELECT doc_id AS seq_id, coalesce(source, '(no header)') AS h, coalesce(length({_squeezed('text')}), 0)::BIGINT AS len FROM documents)"
    counts = ", ".join(f"(length(q) - length(replace(q, '{b}', '')))::BIGINT AS {b.lower()}" for b in "ACGT")
    out = {
        "symbol_freq": f"""WITH {_CHARS}, c AS (SELECT symbol, count(*) AS n FROM chars GROUP BY 1)
            SELECT symbol, n, sum(n) OVER ()::BIGINT AS total, n::DOUBLE / (sum(n) OVER ())::BIGINT AS freq FROM c""",
        "symbol_freq_by_lang": f"""WITH {_CHARS}, c AS (SELECT lang, symbol, count(*) AS n FROM chars GROUP BY 1, 2)
            SELECT lang, symbol, n, sum(n) OVER (PARTITION BY lang)::BIGINT AS total, n::DOUBLE / (sum(n) OVER (PARTITION BY lang))::BIGINT AS freq FROM c""",
        "alphabet": """WITH c AS (SELECT doc_id, unnest(range(1, length(text) + 1)) AS p, text FROM documents),
            f AS (SELECT doc_id, substring(text, p, 1) AS s, min(p) AS p FROM c GROUP BY 1, 2),
            g AS (SELECT doc_id, string_agg(s, '' ORDER BY p) AS alphabet, count(*) AS size FROM f GROUP BY 1)
            SELECT doc_id AS seq_id, coalesce(alphabet, '') AS alphabet, coalesce(size, 0) AS size FROM documents LEFT JOIN g USING (doc_id)""",
        "alphabet_order": """WITH c AS (SELECT doc_id, unnest(range(0, length(text))) AS p, text FROM documents),
            s AS (SELECT substring(text, p + 1, 1) AS symbol, doc_id, p FROM c)
            SELECT symbol, count(*) AS n, min(row(doc_id, p))[1] AS first_seq, min(row(doc_id, p))[2] AS first_pos FROM s GROUP BY 1""",
        "symbol_table": f"""WITH u AS (SELECT {shown} AS t FROM documents), ch AS (SELECT unnest(string_split(t, '')) AS symbol FROM u WHERE length(t) > 0),
            c AS (SELECT symbol, count(*) AS n, (sum(count(*)) OVER ())::BIGINT AS total FROM ch GROUP BY 1)
            SELECT symbol, n, n * 100.0::DOUBLE / total AS pct,
                   row_number() OVER (ORDER BY CASE WHEN symbol BETWEEN 'A' AND 'Z' THEN 0 ELSE 1 END, ascii(symbol)) AS ord
            FROM c WHERE length(symbol) = 1 AND ascii(symbol) BETWEEN 33 AND 126""",
        "byte_histogram": f"""WITH u AS (SELECT {shown} AS t FROM documents), ch AS (SELECT unnest(string_split(t, '')) AS symbol FROM u WHERE length(t) > 0),
            b AS (SELECT hex(encode(symbol)) AS h, count(*) AS n FROM ch GROUP BY 1), c AS (SELECT substr(h, i + 1, 2) AS byte, n FROM (SELECT h, n, unnest(range(0, length(h), 2)) AS i FROM b))
            SELECT range::INTEGER AS code, coalesce(sum(n), 0)::BIGINT AS n FROM range(256) LEFT JOIN c ON ('0x' || byte)::INTEGER = range GROUP BY 1""",
        "record_stats": f"WITH {records} SELECT seq_id, {header} AS header, len FROM recs",
        "fasta_summary": f"""WITH {records} SELECT sum(len)::BIGINT AS total_len, count(*) AS record_count,
            (SELECT {header} FROM recs WHERE {header} <> '' ORDER BY seq_id LIMIT 1) AS header_preview FROM recs""",
        "base_counts": f"WITH {_SEQ} SELECT seq_id, length(q)::BIGINT AS n, {counts} FROM seqs",
        "melting": f"""WITH {_SEQ}, b AS (SELECT seq_id, length(q)::BIGINT AS n, length(translate(q, 'AT', ''))::BIGINT AS gc FROM seqs)
            SELECT seq_id, n, CASE WHEN n > 0 THEN gc::DOUBLE * 100.0 / n END AS gc_pct, 2 * n + 2 * gc AS tm_wallace,
            CASE WHEN n > 0 THEN {81.5 + 16.6 * __import__('math').log10(0.05)!r}::DOUBLE + 41.0::DOUBLE * gc / n - 600.0::DOUBLE / n END AS tm_salt FROM b""",
        "validate_sequence": f"""WITH t AS (SELECT doc_id, {_upper("trim(coalesce(text, ''))")} AS u FROM documents)
            SELECT doc_id AS seq_id, length(u) > 0 AND NOT regexp_matches(u, '[^ACGT]') AS valid, nullif(regexp_extract(u, '(?s)[^ACGT]'), '') AS bad FROM t""",
        "kmer_freq_k2": _kmers(2),
        "kmer_freq_k3": _kmers(3),
        "kmer_presence": f"WITH {_SEQ}, {_windows(3)} SELECT seq_id, substring(q, pos + 1, 3) AS kmer, count(*) AS n, min(pos) AS first_pos FROM grams GROUP BY 1, 2",
        "distinct_kmers": f"""WITH {_SEQ}, {_windows(2)}, d AS (SELECT seq_id, count(DISTINCT substring(q, pos + 1, 2)) AS c FROM grams GROUP BY 1)
            SELECT seq_id, coalesce(c, 0) AS n_distinct FROM seqs LEFT JOIN d USING (seq_id)""",
        "window_counts": f"WITH {_SEQ} SELECT seq_id, CASE WHEN length(q) < 50 THEN 0 ELSE 1 + (length(q) - 50) // 10 END::BIGINT AS windows FROM seqs",
        "sliding_freqs": f"{_SLIDE} SELECT * FROM counts",
        "sliding_downsampled": f"""{_SLIDE}, per AS (SELECT seq_id, (count(*) + 7) // 8 AS per FROM counts GROUP BY 1)
            SELECT seq_id, win_idx // per AS bucket, count(*) AS windows, {', '.join(f'sum({b})::BIGINT AS {b}' for b in 'acgt')}
            FROM counts JOIN per USING (seq_id) GROUP BY 1, 2""",
        "tm_bins": f"{_GC} SELECT * FROM bins",
        "tm_bins_merged": f"""{_GC}, m AS (SELECT seq_id, (max(bin) + 1 + 3) // 4 AS g FROM bins GROUP BY 1)
            SELECT seq_id, bin // g AS bin, sum(sum_tm)::BIGINT AS sum_tm, min(min_tm) AS min_tm, max(max_tm) AS max_tm, sum(n)::BIGINT AS n
            FROM bins JOIN m USING (seq_id) GROUP BY 1, 2""",
        "tm_threshold": f"""{_GC}, th(ord, threshold) AS (VALUES (0, 22.0::DOUBLE), (1, 24.5::DOUBLE), (2, 27.0::DOUBLE))
            SELECT seq_id, bin, ord, threshold, sum_tm::DOUBLE / n >= threshold AS above FROM bins CROSS JOIN th""",
        "tm_summary": f"""{_GC} SELECT seq_id, sum(n)::BIGINT AS windows, count(*) AS bins, min(min_tm) AS min_tm, max(max_tm) AS max_tm FROM bins GROUP BY 1""",
        "orf_scan": f'WITH {_ORFS} SELECT seq_id, frame, "start", "end", terminated FROM orf',
        "codon_usage": f"WITH {_USAGE} SELECT codon, sum(n)::BIGINT AS n FROM usage GROUP BY 1",
        "top_codons": f"WITH {_USAGE} SELECT lang, rank, codon, n FROM top WHERE rank <= 10",
        "common_codons": f"""WITH {_USAGE} SELECT rank, codon, n FROM top WHERE rank <= 10 AND lang = 'en'
            AND codon IN (SELECT codon FROM top WHERE rank <= 10 AND lang = 'fr')""",
        "aa_usage": f"WITH {_USAGE} SELECT aa, sum(n)::BIGINT AS n FROM acids GROUP BY 1",
        "top_aa": f"WITH {_USAGE} SELECT lang, rank, aa, n FROM topaa WHERE rank <= 3",
        "aa_nutrition": f"""WITH {_USAGE} SELECT aa, sum(n)::BIGINT AS n,
            any_value(CASE aa {' '.join(f"WHEN '{a}' THEN '{known['name']}'" for a, known in NUTRITION.items())} ELSE aa END) AS name,
            any_value({_foods('low_foods')}) AS low_foods, any_value({_foods('rich_foods')}) AS rich_foods FROM acids GROUP BY 1""",
        "top_aa_union": f"""WITH {_USAGE}, o AS (SELECT aa, min((CASE lang WHEN 'en' THEN 0 ELSE 10 END) + rank) AS o FROM topaa
            WHERE rank <= 3 AND lang IN ('en', 'fr') GROUP BY 1) SELECT aa, row_number() OVER (ORDER BY o) AS ord FROM o""",
        "first_orf": f'WITH {_FIRST} SELECT seq_id, "start", "end" FROM bounds',
        "translate_orf": f'WITH {_FIRST}, cut AS (SELECT seq_id, substring(r, "start" + 1, "end" - "start") AS x FROM bounds) SELECT seq_id, {_protein("x")} AS protein FROM cut',
        "unique_reads": f"WITH {_READS} SELECT assembly_id, uid, seq, copies, first_id FROM un",
        "seed_reads": f"""WITH {_READS} SELECT assembly_id, uid, seq FROM un
            QUALIFY row_number() OVER (PARTITION BY assembly_id ORDER BY length(seq) DESC, uid) = 1""",
        "read_overlaps": f"""WITH {_READS} SELECT l.assembly_id, l.uid AS left_uid, r.uid AS right_uid FROM un l JOIN un r
            ON l.assembly_id = r.assembly_id AND l.uid <> r.uid AND right(l.seq, 2) = left(r.seq, 2) WHERE length(l.seq) >= 2 AND length(r.seq) >= 2""",
        "sample_reads": f"WITH {_SAMPLED} SELECT * FROM sm",
        "assemble": _ASSEMBLED,
        "identity_profile": f"WITH {_PAIRS} SELECT pair_id, off, matches, total FROM prof WHERE total >= 5",
        "best_shift": f"""WITH {_PAIRS} SELECT pair_id, CASE WHEN matches > 0 THEN off * sign ELSE 0 END::BIGINT AS shift, matches::DOUBLE / total AS identity
            FROM prof QUALIFY row_number() OVER (PARTITION BY pair_id ORDER BY matches::DOUBLE / total DESC, off) = 1""",
        "containment": f"WITH {_PAIRS} SELECT pair_id, contains(b, a) AS a_in_b, contains(a, b) AS b_in_a FROM pairs",
    }
    flat = "translate(coalesce(text, ''), ' ' || chr(9) || chr(13) || chr(10) || chr(11) || chr(12) || '>', '')"
    written = f"wr AS (SELECT row_number() OVER (ORDER BY doc_id) - 1 AS seq_id, doc_id || '|' || coalesce(source, '') AS header, {flat} AS s FROM documents)"
    means = "means AS (SELECT seq_id, bin, n, sum_tm::DOUBLE / n AS mean FROM bins)"
    shares = ", ".join(f"({b}::DOUBLE / 50)::FLOAT AS {b}" for b in "acgt")
    out |= {
        "fasta_scan": f"WITH {written} SELECT seq_id, header, length(s)::BIGINT AS len, md5(s) AS digest FROM wr",
        "fasta_scan_lengths": f"WITH {written} SELECT seq_id, header, length(s)::BIGINT AS len FROM wr",
        "fasta_scan_symbols": f"""WITH u AS (SELECT {_upper(flat)} AS t FROM documents), ch AS (SELECT unnest(string_split(t, '')) AS symbol FROM u WHERE length(t) > 0),
            c AS (SELECT symbol, count(*) AS n, (sum(count(*)) OVER ())::BIGINT AS total FROM ch GROUP BY 1)
            SELECT symbol, n, n * 100.0::DOUBLE / total AS pct, row_number() OVER (ORDER BY CASE WHEN symbol BETWEEN 'A' AND 'Z' THEN 0 ELSE 1 END, ascii(symbol)) AS ord
            FROM c WHERE length(symbol) = 1 AND ascii(symbol) BETWEEN 33 AND 126""",
        "fasta_scan_tm_bins": f"""WITH {_SEQ}, ch AS (SELECT seq_id, unnest(string_split(q, '')) AS c, generate_subscripts(string_split(q, ''), 1) AS i FROM seqs WHERE q <> ''),
            pos AS (SELECT '' AS lang, c, row_number() OVER (ORDER BY seq_id, i) - 1 AS p, count(*) OVER () AS n FROM ch), {_JOINED_TM.format(per=10_000)}
            SELECT bin, sum_tm, min_tm, max_tm, n, sum_tm::DOUBLE / n AS mean_tm FROM bins""",
        "fasta_lines": f"WITH {_SEQ} SELECT doc_id AS seq_id, '>' || coalesce(source, '') || chr(10) || rtrim(regexp_replace(q, '(.{{60}})', '\\1' || chr(10), 'g'), chr(10)) AS value FROM documents JOIN seqs ON seq_id = doc_id",
        "joined_places": f"""WITH {_SEQ} SELECT lang, seq_id, (sum(length(q)) OVER (PARTITION BY lang ORDER BY seq_id) - length(q))::BIGINT AS "start", (sum(length(q)) OVER (PARTITION BY lang))::BIGINT AS total FROM seqs""",
        "joined_tm_bins": f"WITH {_JOINED}, {_JOINED_TM.format(per=1_000)} SELECT * FROM bins",
        "joined_sliding": f"""WITH {_JOINED}, w AS (SELECT lang, p, n, {', '.join(f"sum((c = '{b}')::INT) OVER w AS {b.lower()}" for b in 'ACGT')} FROM pos
            WINDOW w AS (PARTITION BY lang ORDER BY p ROWS BETWEEN CURRENT ROW AND 49 FOLLOWING))
            SELECT lang, p // 10 AS win_idx, {', '.join(f'{b}::BIGINT AS {b}' for b in 'acgt')} FROM w WHERE p % 10 = 0 AND p <= n - 50""",
        "joined_orfs": f'WITH {_JOINED_ORFS} SELECT lang, frame, "start", "end", terminated FROM orf',
        "joined_codons": f"WITH {_JOINED_ORFS} SELECT lang, codon, n, f[1] AS first_frame, f[2] AS first_start, f[3] AS first_i FROM usage",
        "genome_comparison": f"""WITH {_JOINED_ORFS}, top AS (SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY n DESC, f) AS rank, codon, n FROM usage)
            SELECT rank, codon, n FROM top WHERE rank <= 10 AND lang = 'en' AND codon IN (SELECT codon FROM top WHERE rank <= 10 AND lang = 'fr')""",
        "labelled_records": """SELECT doc_id AS seq_id, CASE WHEN starts_with(source, 'src1') THEN 'one' ELSE 'two' END AS genome, source AS header FROM documents
            WHERE starts_with(source, 'src1') OR starts_with(source, 'src2')""",
        "tm_means": f"""{_GC}, m AS (SELECT seq_id, (max(bin) + 1 + 3) // 4 AS g FROM bins GROUP BY 1)
            SELECT seq_id, bin // g AS bin, sum(sum_tm)::BIGINT::DOUBLE / sum(n)::BIGINT AS mean_tm, sum(n)::BIGINT AS n FROM bins JOIN m USING (seq_id) GROUP BY 1, 2""",
        "tm_mean_range": f"{_GC}, {means} SELECT seq_id, min(mean) AS low_mean, max(mean) AS high_mean FROM means GROUP BY 1",
        "tm_default_threshold": f"{_GC}, {means} SELECT seq_id, bin, 0 AS ord, round(avg(mean) OVER (PARTITION BY seq_id), 6) AS threshold FROM means",
        "tm_chart": f"""{_GC}, {means}, lim AS (SELECT seq_id, min(mean) AS lo, max(mean) AS hi FROM means GROUP BY 1)
            SELECT seq_id, bin AS x, mean AS y, floor(lo - greatest((hi - lo) * 0.05::DOUBLE, 1))::BIGINT AS y_low, ceil(hi + greatest((hi - lo) * 0.05::DOUBLE, 1))::BIGINT AS y_high FROM means JOIN lim USING (seq_id)""",
        "sliding_shares": f"{_SLIDE} SELECT seq_id, win_idx, {shares} FROM counts",
        "sliding_series": f"""{_SLIDE}, per AS (SELECT seq_id, CASE WHEN count(*) <= 20 THEN 1 ELSE (count(*) + 7) // 8 END AS per FROM counts GROUP BY 1)
            SELECT seq_id, win_idx // per AS x, {', '.join(f'(sum({b})::BIGINT::DOUBLE / (count(*) * 50))::FLOAT AS {b}' for b in 'acgt')} FROM counts JOIN per USING (seq_id) GROUP BY 1, 2""",
        "previews": f"""{_SLIDE} SELECT seq_id, string_agg(printf('%.3f', a::DOUBLE / 50), ', ' ORDER BY win_idx) FILTER (win_idx < 64) ||
            CASE WHEN count(*) > 64 THEN ' … (+' || (count(*) - 64) || ' more)' ELSE '' END AS shown FROM counts GROUP BY 1""",
        "symbol_flags": f"""WITH {_CHARS} SELECT DISTINCT symbol, CASE WHEN {_upper('symbol')} IN ('G', 'C') THEN 1 WHEN {_upper('symbol')} IN ('A', 'T') THEN 0 END AS gc,
            CASE WHEN {_upper('symbol')} IN ('A', 'C', 'G', 'T') THEN instr('ACGT', {_upper('symbol')}) - 1 END::INTEGER AS base FROM chars""",
        "kmer_counts_k21": f"WITH {_SEQ}, {_windows(21)} SELECT substring(q, pos + 1, 21) AS kmer, count(*) AS n FROM grams GROUP BY 1",
        "kmer_freq_k13": f"""WITH {_SEQ}, {_windows(13)}, cnt AS (SELECT substring(q, pos + 1, 13) AS kmer, count(*) AS n FROM grams GROUP BY 1)
            SELECT kmer, n, (sum(n) OVER ())::BIGINT AS total, n::DOUBLE / (sum(n) OVER ())::BIGINT AS freq FROM cnt""",
        "read_graph": f"WITH {_GRAPH} SELECT assembly_id, left_uid, right_uid, overlap FROM gr",
        "read_graph_reduced": f"""WITH {_GRAPH} SELECT assembly_id, left_uid, right_uid, overlap FROM gr WHERE NOT EXISTS (SELECT 1 FROM gr a JOIN gr b
            ON b.assembly_id = a.assembly_id AND b.left_uid = a.right_uid WHERE a.assembly_id = gr.assembly_id AND a.left_uid = gr.left_uid AND b.right_uid = gr.right_uid AND a.far + b.far = gr.far)""",
        "sample_coverage": f"WITH {_COVERED} SELECT * FROM sm",
        "overlap_lengths": f"""WITH {_PAIRS} SELECT pair_id, coalesce(list_min(list_filter(range(3, least(length(a), length(b)) + 1), lambda n: right(a, n) = left(b, n))), 0) AS overlap FROM pairs""",
    }
    layers = "SELECT seq_id, '{}' AS layer, {} AS series, {} AS x, {} AS y, {}::INTEGER AS colour FROM {}"
    ends = [layers.format("limit", f"'{n}'", "NULL::BIGINT", f"y_{n}::DOUBLE", "NULL", "ends") for n in ("low", "high")]
    out["tm_chart_layers"] = " ".join([
        f"WITH pts AS ({out['tm_chart']}), ends AS (SELECT DISTINCT seq_id, y_low, y_high FROM pts), th(ord, t) AS (VALUES (0, 22.0::DOUBLE), (1, 24.5::DOUBLE))",
        " UNION ALL ".join([layers.format("line", "'mean_tm'", "x", "y", "0", "pts"), *ends, layers.format("bar", "ord::VARCHAR", "x", "t", "ord % 5 + 1", "pts CROSS JOIN th")]),
    ])
    lines = [layers.format("line", f"'{b}'", "x", f"{b}::DOUBLE", str(i), "ser") for i, b in enumerate("acgt")]
    grid = [layers.format("grid", f"'{q / 4}'", "NULL::BIGINT", f"{q / 4}::DOUBLE", "NULL", "ids") for q in range(5)]
    edges = [layers.format("limit", f"'{n}'", "NULL::BIGINT", f"{v}::DOUBLE", "NULL", "ids") for n, v in (("low", 0), ("high", 1))]
    out["series_layers"] = f"WITH ser AS ({out['sliding_series']}), ids AS (SELECT DISTINCT seq_id FROM ser) " + " UNION ALL ".join([*lines, *grid, *edges])
    out["symbol_lines"] = f"SELECT ord, rpad(symbol, 2, ' ') || ' ' || n || ' ' || printf('%.2f%%', pct) AS line FROM ({out['symbol_table']})"
    out["kmer_lines"] = f"SELECT kmer, kmer || ': ' || n || ' (' || printf('%.4f', freq) || ')' AS line FROM ({out['kmer_freq_k2']})"
    out |= {f"translate_frame{n}": _frame(n) for n in (1, 2, 3)}
    return out
