"""DuckDB twins of the registered queries that SQL can express."""

from __future__ import annotations

from glyphmill.llm.divergence import COMMON_WORDS, Rules

_RULES = Rules()
_SPACES = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
_ASCII_LOWER = "translate({0}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def _case(lang: str, words: tuple[str, ...]) -> str:
    return f"WHEN '{lang}' THEN [{', '.join(repr(w) for w in words)}]"


def _count(pattern: str) -> str:
    return f"length(t) - length(regexp_replace(t, '{pattern}', '', 'g'))"


def _jsd(p: str, q: str) -> str:
    half = "CASE WHEN {0} > 0 THEN {0} * log2(2 * {0} / ({0} + {1})) ELSE 0 END"
    term = f"({half.format('z[1]', 'z[2]')} + {half.format('z[2]', 'z[1]')}) / 2"
    return (
        f"round(sqrt(greatest(list_sum(list_transform(list_zip({p}, {q}), lambda z: {term})), 0)), 6)"
    )


def _code_rounds(rounds: int = 4, parts: int = 4, entries: int = 256) -> str:
    """Assignment and means, unrolled; integer dot products in doubles are exact at these sizes."""
    steps = [
        f"""k AS (
  SELECT vec_id, label, v, len(v) // {parts} AS w, row_number() OVER (ORDER BY vec_id, v) AS rn FROM (
    SELECT vec_id, label, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)) AS v FROM embeddings
    WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0)
), x AS MATERIALIZED (
  SELECT rn, p, v[w * p + 1:w * p + w] AS s FROM k, range({parts}) r(p)
), c0 AS MATERIALIZED (
  SELECT p, rn - 1 AS e, s, list_inner_product(s, s) AS cc FROM x WHERE rn <= {entries}
)"""
    ]
    for i in range(rounds + 1):
        steps.append(f"""a{i} AS MATERIALIZED (
  SELECT rn, p, min({{'d': cc - 2 * list_inner_product(x.s, c.s), 'e': e}}) AS best
  FROM x JOIN c{i} c USING (p) GROUP BY rn, p
)""")
        if i < rounds:
            steps.append(f"""m{i} AS (
  SELECT p, e, list(m ORDER BY pos) AS s FROM (
    SELECT p, e, pos, floor(sum(u) / count(*)) AS m FROM (
      SELECT p, best.e AS e, unnest(s) AS u, generate_subscripts(s, 1) AS pos FROM a{i} JOIN x USING (rn, p))
    GROUP BY p, e, pos) GROUP BY p, e
), c{i + 1} AS MATERIALIZED (
  SELECT p, e, n.s, list_inner_product(n.s, n.s) AS cc
  FROM (SELECT p, e, coalesce(m.s, c.s) AS s FROM c{i} c LEFT JOIN m{i} m USING (p, e)) n
)""")
    last = f"c{rounds}"
    return f"""
WITH {", ".join(steps)}, final AS (
  SELECT rn, string_agg(printf('%02x', best.e), '' ORDER BY p) AS code,
         sum(best.d + list_inner_product(s, s))::BIGINT AS error
  FROM a{rounds} JOIN x USING (rn, p) GROUP BY rn
), book AS (
  SELECT sha256(string_agg(array_to_string(list_transform(s, lambda u: u::BIGINT), ','), ',' ORDER BY p, e)) AS digest
  FROM {last}
)
SELECT vec_id, code, error, sum(error) OVER (PARTITION BY label)::BIGINT AS label_error, digest AS codebooks_sha256
FROM k JOIN final USING (rn), book
"""


_TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
_N_CLASSES, _N_WORDS = 8, 13

ORACLES = {
    "op1_distribution_divergence": f"""
WITH base AS (
  SELECT doc_id, lang, coalesce(text, '') AS t,
         regexp_extract_all(coalesce(text, ''), '[^ \\x09-\\x0D]+') AS w,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^ \\x09-\\x0D]')) AS l
  FROM documents
), grams AS (
  SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, w[i], w[i + 1], w[i + 2]) AS n
  FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM base)
), covered AS (
  SELECT doc_id, count(DISTINCT i + k) AS n
  FROM grams, (VALUES (0), (1), (2)) AS v(k) WHERE n > 1 GROUP BY doc_id
), counted AS (
  SELECT b.doc_id, lang, length(t) AS n_chars, len(w) AS n_words, len(l) - len(list_distinct(l)) AS n_dup_lines,
         coalesce(c.n, 0) AS n_repeat_words, w,
         {_count("[a-z]")} AS c0, {_count("[ \\x09-\\x0D]")} AS c1, {_count("[A-Z]")} AS c2, {_count("[0-9]")} AS c3,
         {_count("\\pL")} AS letters, {_count("[.,]")} AS c5, {_count("[#*$%&|<>]")} AS c6,
         CASE lang {" ".join(_case(k, v) for k, v in COMMON_WORDS.items())} END AS known
  FROM base b LEFT JOIN covered c USING (doc_id)
), hist AS (
  SELECT *, letters - c0 - c2 AS c4, n_chars - c1 - letters - c3 - c5 - c6 AS c7,
         list_transform(known, lambda k: len(list_filter(w, lambda x: lower(x) = k))) AS kc
  FROM counted
), feats AS (
  SELECT doc_id, lang, n_chars, n_words, n_chars - c1 AS word_chars, c6 AS n_symbols, n_dup_lines, n_repeat_words,
         n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
         list_transform([c0, c1, c2, c3, c4, c5, c6, c7], lambda c: CASE WHEN n_chars > 0 THEN c / n_chars::DOUBLE ELSE 0 END) AS cs,
         list_transform(list_append(kc, (n_words - list_sum(kc))::BIGINT), lambda c: CASE WHEN n_words > 0 THEN c / n_words::DOUBLE ELSE 0 END) AS ws
  FROM hist
), refs AS (
  SELECT lang, [{", ".join(f"avg(cs[{i + 1}])" for i in range(_N_CLASSES))}] AS cr,
         [{", ".join(f"avg(ws[{i + 1}])" for i in range(_N_WORDS))}] AS wr
  FROM feats
  WHERE NOT base_failed AND n_words >= {_RULES.min_words} AND 10 * n_symbols <= n_words AND cs[3] <= cs[1]
  GROUP BY lang HAVING count(*) >= {_RULES.min_reference}
), judged AS (
  SELECT f.*, CASE WHEN cr IS NOT NULL AND n_chars >= {_RULES.min_chars} THEN {_jsd("cs", "cr")} END AS class_distance,
         CASE WHEN cr IS NOT NULL AND n_words >= {_RULES.min_words} AND ws IS NOT NULL THEN {_jsd("ws", "wr")} END AS word_distance
  FROM feats f LEFT JOIN refs r ON f.lang IS NOT DISTINCT FROM r.lang
)
SELECT doc_id, n_words::BIGINT AS n_words, word_chars::BIGINT AS word_chars, n_symbols::BIGINT AS n_symbols,
       n_dup_lines::BIGINT AS n_dup_lines, n_repeat_words::BIGINT AS n_repeat_words, base_failed,
       NOT base_failed
         AND NOT coalesce(class_distance > {_RULES.class_floor} + {_RULES.class_noise} / sqrt(n_chars), false)
         AND NOT coalesce(word_distance > {_RULES.word_floor} + {_RULES.word_noise} / sqrt(n_words), false) AS kept,
       class_distance, word_distance
FROM judged
""",
    "op2_line_dedup": f"""
WITH lines AS (
  SELECT doc_id, unnest(l) AS line, generate_subscripts(l, 1) AS pos
  FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS l FROM documents)
), keyed AS (
  SELECT doc_id, pos, line, {_ASCII_LOWER.format(f"trim(line, {_SPACES})")} AS key FROM lines
), shared AS (
  SELECT key, max(doc_id) AS keeper FROM keyed WHERE length(key) >= 20
  GROUP BY key HAVING count(DISTINCT doc_id) >= 3
), marked AS (
  SELECT k.*, s.key IS NOT NULL AND doc_id <> keeper AS dropped FROM keyed k LEFT JOIN shared s USING (key)
)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (dropped) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT dropped), '')) AS kept_sha256
FROM marked GROUP BY doc_id
""",
    "op9_ball_tree_top_k": """
WITH v AS (
  SELECT vec_id, min(list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)::BIGINT)) AS v
  FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
  GROUP BY vec_id
), scored AS (
  SELECT q.vec_id AS query_id, c.vec_id,
         list_sum(list_transform(list_zip(q.v, c.v), lambda z: z[1] * z[2]))::BIGINT AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id AND len(q.v) = len(c.v) WHERE q.vec_id % 100 = 0
)
SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank, vec_id, score
FROM scored QUALIFY rank <= 10
""",
    "op7_warc_bundles": """
WITH p AS (
  SELECT page_id, coalesce(html, '') AS body, sha1(coalesce(html, '')) AS hex FROM pages
), o AS (
  SELECT *, max(page_id) OVER (PARTITION BY hex) AS original FROM p
)
SELECT page_id, strlen(body)::BIGINT AS payload_bytes,
       array_to_string(list_transform(range(0, 32), lambda i:
         substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
           1 + (((('0x' || substr(hex, 1 + 5 * (i // 4), 5))::BIGINT) >> (15 - 5 * (i % 4))) & 31)::INTEGER, 1)), '') AS payload_digest,
       CASE WHEN page_id = original THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id <> original THEN original END AS refers_to
FROM o
""",
    "op8_temporal_url_lists": r"""
WITH c AS (
  SELECT page_id, url, 1704067200 + (page_id * 7919) % 2592000 AS second,
         rtrim(lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:@]+)', 1)), '.') AS h,
         regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]+/([^/?#]+)', 1) AS seg
  FROM pages
), k AS (
  SELECT DISTINCT page_id, second, pattern || tail AS pattern FROM (
    SELECT page_id, second, seg, unnest(list_transform(range(1, len(string_split(h, '.')) + 1),
             lambda i: array_to_string(string_split(h, '.')[i:], '.'))) AS pattern
    FROM c WHERE length(h) BETWEEN 1 AND 253), (VALUES ('a'), ('b')) v(t),
    LATERAL (SELECT CASE WHEN t = 'a' THEN '' WHEN seg <> '' THEN '/' || seg END AS tail)
  WHERE tail IS NOT NULL
), hosts AS (
  SELECT h AS pattern, row_number() OVER (ORDER BY md5(h), h) - 1 AS place, count(*) OVER () AS n
  FROM (SELECT DISTINCT h FROM c WHERE length(h) BETWEEN 1 AND 253)
), e AS (
  SELECT pattern, epoch_us(ts) // 1000000 AS start, ts,
         CASE event_type WHEN 'error' THEN 'malware' WHEN 'signup' THEN 'malware' WHEN 'click' THEN 'ads'
           WHEN 'view' THEN 'ads' WHEN 'purchase' THEN 'partners' END AS list_name,
         CASE WHEN event_type = 'purchase' THEN 'allow' ELSE 'block' END AS kind,
         event_type IN ('error', 'click', 'purchase') AS active
  FROM events JOIN hosts ON event_id % n = place
), points AS (
  SELECT * FROM e QUALIFY row_number() OVER (PARTITION BY list_name, kind, pattern, start ORDER BY ts DESC, active DESC) = 1
), spans AS (
  SELECT *, lead(start) OVER (PARTITION BY list_name, kind, pattern ORDER BY start) AS stop FROM points
), hits AS (
  SELECT page_id, list_name, kind, k.pattern
  FROM k JOIN spans s ON k.pattern = s.pattern AND active AND start <= second AND (stop IS NULL OR second < stop)
), found AS (
  SELECT page_id, count(*) AS n, array_to_string(list_sort(list(DISTINCT list_name)), ',') AS lists,
         arg_max(pattern, (length(pattern), pattern)) AS entry,
         bool_or(kind = 'block') AND NOT bool_or(kind = 'allow') AS blocked
  FROM hits GROUP BY page_id
)
SELECT page_id, CASE WHEN length(h) BETWEEN 1 AND 253 THEN h END AS host, second AS fetched,
       coalesce(n, 0) AS n_matches, coalesce(lists, '') AS lists, entry, coalesce(blocked, false) AS blocked
FROM c LEFT JOIN found USING (page_id)
""",
    "op11_term_grid_treap": f"""
WITH d AS (
  SELECT doc_id, regexp_extract_all({_ASCII_LOWER.format("text")}, '{_TERM}') AS w FROM documents WHERE doc_id IS NOT NULL
), c AS (
  SELECT count(*) FILTER (len(w) > 0) AS n_docs, sum(len(w))::BIGINT AS n_terms FROM d
), p AS (
  SELECT doc_id, 10 + (90 * len(w) * n_docs) // n_terms AS m, term, count(*) AS tf
  FROM (SELECT doc_id, w, unnest(w) AS term FROM d), c GROUP BY doc_id, w, n_docs, n_terms, term
), f AS (
  SELECT term, floor(1000 * ln((2.0::DOUBLE * n_docs + 2) / (2 * count(*) + 1)))::BIGINT AS weight
  FROM p, c GROUP BY term, n_docs
), q AS (
  SELECT DISTINCT item_id, unnest(regexp_extract_all({_ASCII_LOWER.format("text")}, '{_TERM}')) AS term
  FROM benchmark WHERE item_id IS NOT NULL
), s AS (
  SELECT item_id, doc_id, sum(weight * ((1000000000 * tf) // (1000 * tf + 8 * m)))::BIGINT AS score
  FROM q JOIN f USING (term) JOIN p USING (term) GROUP BY item_id, doc_id HAVING score > 0
)
SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INTEGER AS rank, doc_id, score
FROM s QUALIFY rank <= 10
""",
    "op13_limb_codes": _code_rounds(),
    "op6_jaccard_join": f"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all({_ASCII_LOWER.format("coalesce(text, '')")}, '[^ \\x09-\\x0D]+') AS w FROM documents
), s AS (
  SELECT doc_id, list_distinct(CASE WHEN len(w) >= 5
           THEN list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))
           WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS sh
  FROM w
), x AS (
  SELECT doc_id, len(sh) AS n, unnest(sh) AS g FROM s
), links AS (
  SELECT a.doc_id AS u, b.doc_id AS v
  FROM x a JOIN x b ON a.g = b.g AND a.doc_id <> b.doc_id
  GROUP BY a.doc_id, b.doc_id, a.n, b.n
  HAVING 100 * count(*) >= 75 * (a.n + b.n - count(*))
), reach AS (
  SELECT doc_id AS u, doc_id AS v FROM documents
  UNION
  SELECT r.u, l.v FROM reach r JOIN links l ON r.v = l.u
)
SELECT doc_id, len(sh)::BIGINT AS n_shingles, min(v) AS component_id
FROM s JOIN reach ON doc_id = u GROUP BY doc_id, sh
""",
}
