"""SQL twins of the registered queries, for DuckDB over the same tables.

Written as common table expressions from the definitions, independently of the
DataFrame code; only the packaged grammar, word lists and fixed values are
shared.
"""

from __future__ import annotations

import itertools
from collections.abc import Sequence

from glyphmill.functions import bytelevel as bl
from glyphmill.operators import evaluate, pairs
from glyphmill.plans import inputs, registry
from glyphmill.sources import grammar

ORACLES: dict[str, str] = {}


def _values(rows: Sequence[tuple]) -> str:
    def lit(v):
        if v is None:
            return "NULL"
        if isinstance(v, str):
            quoted = "'" + v.replace("'", "''") + "'"
            return quoted.replace("\n", "' || chr(10) || '")
        return str(v)

    return "VALUES " + ", ".join("(" + ", ".join(lit(v) for v in r) + ")" for r in rows)


def _win(md5: str, slot: int = 0) -> str:
    return f"('0x' || substr({md5}, {1 + 7 * slot}, 7))::BIGINT"


def _ids(column: str) -> str:
    return f"md5(array_to_string({column}, ','))"


def _strip(text: str) -> str:
    return rf"regexp_replace({text}, '^\s+|\s+$', '', 'g')"


def _norm(text: str) -> str:
    return rf"trim(regexp_replace({text}, '\s+', ' ', 'g'))"


# -- grammar, lexicon, paraphrases ---------------------------------------------------

_SHAPES = [(n, s, p) for n, (s, p) in enumerate(sorted(grammar.shape_rows()))]

# Words that a diagram can show.
_SHOWN_WORD = r"""\p{L}[^\s{}\[\]<>|"]*"""

GRAMMAR = rf"""
shapes(shape_no, shape, pattern) AS ({_values(_SHAPES)}),
shape_slots AS (
  SELECT shape_no, shape, pattern, slot, regexp_replace(slot, '_[0-9]+$', '') AS category,
         regexp_extract(slot, '[0-9]+$')::BIGINT - 1 AS k
  FROM (SELECT *, unnest(list_distinct(regexp_extract_all(pattern, '\{{([a-z]+_[0-9]+)\}}', 1))) AS slot FROM shapes)),
frames(shape, frame_id, frame) AS ({_values(grammar.frame_rows())}),
options(shape, key, opt) AS ({_values(grammar.connective_rows())}),
packaged(kind, word) AS ({_values(grammar.word_rows())}),
named AS (
  SELECT kind, word FROM packaged
  UNION ALL SELECT 'condition', string_split(p_name, ' ')[1] FROM part
  UNION ALL SELECT 'object', string_split(p_name, ' ')[2] FROM part
  UNION ALL SELECT 'action', event_type FROM events),
words AS (
  SELECT DISTINCT kind, upper(left(word, 1)) || lower(substr(word, 2)) AS word
  FROM named WHERE regexp_full_match(word, '{_SHOWN_WORD}')),
pool_all AS (
  SELECT 'act' AS category, a.word || ' ' || o.word AS value
  FROM words a, words o WHERE a.kind = 'action' AND o.kind = 'object'
  UNION SELECT 'cond', word FROM words WHERE kind = 'condition'
  UNION SELECT 'cond', o.word || ' ' || c.word FROM words o, words c WHERE o.kind = 'object' AND c.kind = 'condition'
  UNION SELECT 'label', word FROM words WHERE kind = 'label'),
pool_rank AS (
  SELECT *, row_number() OVER (PARTITION BY category ORDER BY md5('1234|' || value), value) - 1 AS r,
         greatest(1, floor(count(*) OVER (PARTITION BY category) * 0.15::DOUBLE))::BIGINT AS n_val
  FROM pool_all),
pool AS (
  SELECT category, CASE WHEN r < n_val THEN 'val' ELSE 'train' END AS split,
         CASE WHEN r < n_val THEN r ELSE r - n_val END AS idx, value
  FROM pool_rank WHERE category <> 'label'
  UNION ALL SELECT category, side, r, value FROM pool_rank, (VALUES ('train'), ('val')) s(side)
  WHERE category = 'label'),
pool_size AS (SELECT category AS cat, split, count(*) AS n FROM pool GROUP BY ALL),
f0 AS (SELECT shape, frame AS f, list_sort(list_distinct(regexp_extract_all(frame, '\{{([A-Z][A-Z0-9_]*)\}}', 1))) AS ks FROM frames),
{", ".join(
    f"f{n} AS (SELECT f.shape, CASE WHEN o.key IS NULL THEN f ELSE replace(f, '{{' || o.key || '}}', o.opt) END AS f, ks"
    f" FROM f{n - 1} f LEFT JOIN options o ON o.shape = f.shape AND o.key = ks[{n}])"
    for n in range(1, 7)
)},
phrase_all AS (
  SELECT DISTINCT shape, trim(replace(replace(replace(replace(replace(
    regexp_replace(f, '\s+', ' ', 'g'), ' ,', ','), ' .', '.'), ',.', '.'), '..', '.'), ',,', ',')) AS paraphrase
  FROM f6),
phrase_rank AS (
  SELECT *, row_number() OVER (PARTITION BY shape ORDER BY md5('99|' || paraphrase), paraphrase) - 1 AS r,
         greatest(1, floor(count(*) OVER (PARTITION BY shape) * 0.15::DOUBLE))::BIGINT AS n_val
  FROM phrase_all),
phrases AS (
  SELECT shape, CASE WHEN r < n_val THEN 'val' ELSE 'train' END AS split,
         CASE WHEN r < n_val THEN r ELSE r - n_val END AS idx, paraphrase FROM phrase_rank),
phrase_size AS (SELECT shape, split, count(*) AS n FROM phrases GROUP BY ALL),
fragments(idx, fragment) AS ({_values(list(enumerate(sorted(f for _, f in grammar.fragment_rows()))))})
"""

_N_FRAGMENTS = len(grammar.fragment_rows())
_VAL = int(0.15 * 16**7)

KEYS = f"""
orders_id AS (SELECT DISTINCT o_orderkey AS pair_id FROM orders),
split_keys AS (
  SELECT pair_id, 42 AS seed, split, split AS value_split, split AS phrase_split,
         split = 'val' AND {_win("h", 1)} < {int(0.5 * 16**7)} AS novel
  FROM (SELECT *, CASE WHEN {_win("h")} < {_VAL} THEN 'val' ELSE 'train' END AS split
        FROM (SELECT pair_id, md5('42|' || pair_id || '|side') AS h FROM orders_id)))
"""

AXIS_KEYS = f"""
orders_id AS (SELECT DISTINCT o_orderkey AS pair_id FROM orders),
axes(axis, value_split, phrase_split, seed) AS ({_values([(a, *v) for a, v in pairs.AXES.items()])}),
axis_keys AS (SELECT pair_id, seed, axis AS split, value_split, phrase_split, FALSE AS novel FROM orders_id, axes)
"""


def _span(slot: str) -> str:
    """An invented label for (seed, pair_id, slot)."""

    def word(n: int) -> str:
        h = f"md5(seed || '|' || pair_id || '|' || {slot} || '|word{n}')"
        pieces = [f"fr[({_win(h, j)} % {_N_FRAGMENTS}) + 1]" for j in (1, 2, 3)]
        joined = (
            f"CASE {_win(h)} % 4 WHEN 0 THEN {pieces[0]} WHEN 3 THEN {' || '.join(pieces)}"
            f" ELSE {pieces[0]} || {pieces[1]} END"
        )
        return f"(upper(left({joined}, 1)) || lower(substr({joined}, 2, 13)))"

    few = f"{_win(f"md5(seed || '|' || pair_id || '|' || {slot} || '|words')")} % 3 = 0"
    return f"CASE WHEN {few} THEN {word(1)} ELSE {word(1)} || ' ' || {word(2)} END"


def _drawn(keys: str, novel: str = "novel") -> str:
    """CTEs shaped, spoken, slotted, filled and drawn (rendered pairs) of a key table."""
    slots = [f"{c}_{n}" for c, top in (("act", 4), ("cond", 3), ("label", 2)) for n in range(1, top + 1)]

    def fill(column: str) -> str:
        for s in slots:
            column = f"replace({column}, '{{{s}}}', coalesce({s}, ''))"
        return column

    h = "md5(seed || '|' || pair_id || '|' || category)"
    return f"""
shaped AS (
  SELECT k.*, s.shape_no, s.shape, s.pattern FROM {keys} k
  JOIN shapes s ON s.shape_no = {_win("md5(seed || '|' || pair_id || '|shape')")} % {len(_SHAPES)}),
spoken AS (
  SELECT x.*, p.paraphrase
  FROM (SELECT s.*, {_win("md5(seed || '|' || pair_id || '|phrase')")} % z.n AS phrase_at
        FROM shaped s JOIN phrase_size z ON z.shape = s.shape AND z.split = s.phrase_split) x
  JOIN phrases p ON p.shape = x.shape AND p.split = x.phrase_split AND p.idx = x.phrase_at),
slot_rows AS (
  SELECT s.pair_id, s.seed, s.split, s.value_split, {novel} AS novel, t.slot, t.category, t.k, z.n,
         {_win(h, 0)} AS base, {_win(h, 2)} AS second,
         1 + {_win(h, 1)} % greatest(1, (z.n - 1) // 4) AS step
  FROM shaped s JOIN shape_slots t USING (shape)
  JOIN pool_size z ON z.cat = t.category AND z.split = s.value_split),
slotted AS (
  SELECT r.pair_id, r.split, r.slot, r.category, p.value AS pooled,
         CASE WHEN r.novel AND r.category <> 'label'
              THEN {_span("slot")} ELSE p.value END AS value
  FROM slot_rows r, (SELECT list(fragment ORDER BY idx) AS fr FROM fragments) q
  JOIN pool p ON p.category = r.category AND p.split = r.value_split
   AND p.idx = CASE WHEN r.category = 'label' THEN CASE k WHEN 0 THEN base ELSE second END % n
                    ELSE (base + step * k) % n END),
filled AS (
  SELECT pair_id, split,
         {", ".join(f"max(value) FILTER (slot = '{s}') AS {s}" for s in slots)},
         string_agg(slot || '=' || value, ';' ORDER BY slot) AS slot_text,
         list(value ORDER BY slot) AS vals, list(slot ORDER BY slot) AS names
  FROM slotted GROUP BY pair_id, split),
drawn AS (
  SELECT s.pair_id, s.split, s.novel, s.shape, s.paraphrase, f.* EXCLUDE (pair_id, split),
         {fill("paraphrase")} AS prompt, {fill("pattern")} AS diagram
  FROM spoken s JOIN filled f USING (pair_id, split)),
uniq AS (
  SELECT * EXCLUDE (copy) FROM (
    SELECT *, row_number() OVER (PARTITION BY split, prompt, diagram ORDER BY pair_id) AS copy FROM drawn)
  WHERE copy = 1)
"""


PAIRS = GRAMMAR + "," + KEYS + "," + _drawn("split_keys")
AXES = GRAMMAR + "," + AXIS_KEYS + "," + _drawn("axis_keys")


def _faulty(source: str) -> str:
    """CTE faulty: deterministic corruptions of ``source``."""
    names = "[" + ", ".join(f"'{f}'" for f in evaluate.FAULTS) + "]"
    other = "coalesce(act_2, label_1)"
    node = "strpos(diagram, chr(10) || '    A')"
    return f"""
faulty AS (
  SELECT *, CASE fault
    WHEN 'swap_label' THEN replace(replace(replace(diagram, act_1, chr(1)), {other}, act_1), chr(1), {other})
    WHEN 'swap_branches' THEN CASE
      WHEN contains(diagram, '-- Yes -->') THEN replace(replace(replace(diagram, '-- Yes -->', chr(1)), '-- No -->', '-- Yes -->'), chr(1), '-- No -->')
      WHEN cond_2 IS NOT NULL THEN replace(replace(replace(diagram, '-- ' || cond_1 || ' -->', chr(1)),
        '-- ' || cond_2 || ' -->', '-- ' || cond_1 || ' -->'), chr(1), '-- ' || cond_2 || ' -->')
      ELSE replace(replace(replace(diagram, act_1, chr(1)), {other}, act_1), chr(1), {other}) END
    WHEN 'drop_first_node' THEN left(diagram, {node} + 4) || substr(diagram, {node} + 6)
    WHEN 'mismatched_bracket' THEN left(diagram, strpos(diagram, ']') - 1) || '}}' || substr(diagram, strpos(diagram, ']') + 1)
    WHEN 'blank_lines' THEN replace(diagram, chr(10), chr(10) || chr(10))
    WHEN 'foreign_line' THEN diagram || chr(10) || '    [*] --> Done'
    ELSE diagram END AS generated
  FROM (SELECT *, {names}[{_win("md5('7|' || pair_id || '|fault')")} % {len(evaluate.FAULTS)} + 1] AS fault FROM {source}))
"""


_NEEDLES = """
needles AS (
  SELECT shape, slot, CASE WHEN p > 1 THEN substr(pattern, p - 1, 1) ELSE '' END AS left_char,
         substr(pattern, p + length(slot) + 2, 1) AS right_char
  FROM (SELECT *, strpos(pattern, '{' || slot || '}') AS p FROM shape_slots))
"""


def _scored(source: str) -> str:
    """CTEs needles, hits and scores over ``source`` (with ``generated``)."""
    return f"""{_NEEDLES},
hit_rows AS (
  SELECT s.pair_id, s.split, u.slot, u.value,
         contains(s.generated, n.left_char || u.value || n.right_char) AS hit
  FROM (SELECT *, unnest(names) AS slot, unnest(vals) AS value FROM {source}) u
  JOIN {source} s ON s.pair_id = u.pair_id AND s.split = u.split
  JOIN needles n ON n.shape = s.shape AND n.slot = u.slot),
scores AS (
  SELECT s.*, h.n_slots, h.n_hits, h.n_hits = h.n_slots AS all_hit, h.missing,
         {_norm("s.generated")} = {_norm("s.diagram")} AS exact
  FROM {source} s JOIN (
    SELECT pair_id, split, count(*) AS n_slots, count(*) FILTER (hit) AS n_hits,
           string_agg(value, ', ' ORDER BY slot) FILTER (NOT hit) AS missing
    FROM hit_rows GROUP BY ALL) h USING (pair_id, split))
"""


_METRICS = """count(*) AS n, round(sum(n_hits) / greatest(1, sum(n_slots)), 6) AS slot_acc,
  round(count(*) FILTER (all_hit) / greatest(1, count(*)), 6) AS sample_acc,
  round(count(*) FILTER (exact) / greatest(1, count(*)), 6) AS exact_match"""

FAULTY = PAIRS + "," + _faulty("uniq")
SCORES = FAULTY + "," + _scored("faulty")
AXIS_SCORES = AXES + "," + _faulty("drawn") + "," + _scored("faulty")


# -- byte-level BPE ------------------------------------------------------------------------

_TOKEN = r"""s|''t|''re|''ve|''m|''ll|''d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}\x01]+|\s+"""


def _pre(text: str) -> str:
    r"""Pre-tokens of a text.

    RE2 has no look-ahead: a mark before the last blank of a run does the work
    of ``\s+(?!\S)``.
    """
    marked = rf"regexp_replace({text}, '(\s+)(\s)(\S)', '\1' || chr(1) || '\2\3', 'g')"
    return f"regexp_extract_all({marked}, '''{_TOKEN}')"


def _symbols(word: str) -> str:
    low = bl.FIRST_BYTE
    byte = f"('0x' || substr(hex(encode({word})), 2 * i + 1, 2))::BIGINT"
    code = (
        f"CASE WHEN {byte} BETWEEN 33 AND 126 THEN {byte} - 33 WHEN {byte} BETWEEN 161 AND 172 THEN {byte} - 161 + 94"
        f" WHEN {byte} BETWEEN 174 AND 255 THEN {byte} - 174 + 106 WHEN {byte} <= 32 THEN {byte} + 188"
        f" WHEN {byte} = 173 THEN 255 ELSE {byte} - 127 + 221 END + {low}"
    )
    size = f"length(hex(encode({word}))) // 2"
    return f"' ' || array_to_string(list_transform(range(0, {size}), lambda i: {code}), '  ') || ' '"


def _train(n: int) -> str:
    """CTEs freq, w0 .. wn and p1 .. pn: one-by-one training."""
    out = [
        f"pre_docs AS MATERIALIZED (SELECT doc_id, unnest({_pre('text')}) AS pretoken FROM documents)",
        "freq AS MATERIALIZED (SELECT pretoken, count(*) AS n FROM pre_docs GROUP BY pretoken)",
        f"w0 AS MATERIALIZED (SELECT n, {_symbols('pretoken')} AS sym FROM freq)",
    ]
    for r in range(1, n + 1):
        out.append(
            f"c{r} AS (SELECT ids[j]::BIGINT AS l, ids[j + 1]::BIGINT AS r, sum(n)::BIGINT AS n FROM"
            f" (SELECT ids, n, unnest(range(1, len(ids))) AS j FROM (SELECT string_split(trim(sym), '  ') AS ids, n FROM w{r - 1}))"
            " GROUP BY ALL)"
        )
        out.append(f"p{r} AS MATERIALIZED (SELECT l, r FROM c{r} ORDER BY n DESC, l, r LIMIT 1)")
        out.append(
            f"w{r} AS MATERIALIZED (SELECT n, replace(sym, ' ' || l || '  ' || r || ' ', ' {bl.FIRST_MERGE + r - 1} ') AS sym"
            f" FROM w{r - 1}, p{r})"
        )
    return ",\n".join(out)


_SHOWN = (
    "CASE WHEN b BETWEEN 33 AND 126 OR b BETWEEN 161 AND 172 OR b >= 174 THEN chr(b) WHEN b <= 32 THEN chr(256 + b)"
    " WHEN b = 173 THEN chr(323) ELSE chr(b - 127 + 289) END"
)
_DOC_VAL = int(0.05 * 16**7)
SPLIT_DOCS = f"""
split_docs AS (
  SELECT doc_id, coalesce(text, '') AS text,
         CASE WHEN {_win("md5('42|' || doc_id || '|side')")} < {_DOC_VAL} THEN 'val' ELSE 'train' END AS split
  FROM documents)"""


_N = inputs.PLAIN_MERGES


def _apply(sym: str) -> str:
    for r in range(1, _N + 1):
        sym = f"replace({sym}, ' ' || p{r}.l || '  ' || p{r}.r || ' ', ' {bl.FIRST_MERGE + r - 1} ')"
    return sym


# Plain ids of every document, and the blocks of their stream, the last one shorter.
PLAIN = f"""{_train(_N)},
doc_occ AS (
  SELECT doc_id, unnest(pre) AS word, generate_subscripts(pre, 1) AS pos
  FROM (SELECT doc_id, {_pre("text")} AS pre FROM documents)),
doc_sym AS MATERIALIZED (
  SELECT word, string_split(trim({_apply("sym")}), '  ')::BIGINT[] AS ids
  FROM (SELECT word, {_symbols("word")} AS sym FROM (SELECT DISTINCT word FROM doc_occ)), {", ".join(f"p{r}" for r in range(1, _N + 1))}),
doc_ids AS (
  SELECT o.doc_id, flatten(list(s.ids ORDER BY o.pos)) AS ids FROM doc_occ o JOIN doc_sym s USING (word) GROUP BY o.doc_id),
{SPLIT_DOCS.strip()},
plain AS MATERIALIZED (
  SELECT doc_id, split, text, coalesce(ids, []) AS ids, list_concat(coalesce(ids, []), [{bl.EOT}::BIGINT]) AS ended
  FROM split_docs LEFT JOIN doc_ids USING (doc_id))"""
PLAIN_BLOCKS = f"""{PLAIN},
placed AS (
  SELECT split, unnest(ended) AS tok, st + generate_subscripts(ended, 1) - 1 AS g FROM (
    SELECT split, ended, coalesce(sum(len(ended)) OVER (PARTITION BY split ORDER BY md5('42|' || doc_id || '|order'), doc_id
             ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS st FROM plain)),
blocks AS MATERIALIZED (
  SELECT split, block_id, list(tok ORDER BY g) AS tokens FROM (
    SELECT split, tok, g, g // {registry.BLOCK} AS block_id FROM placed
    UNION ALL SELECT split, tok, g, g // {registry.BLOCK} - 1 FROM placed WHERE g > 0 AND g % {registry.BLOCK} = 0)
  GROUP BY split, block_id)"""


def _add(name: str, ctes: str, select: str) -> None:
    ORACLES[name] = f"WITH {ctes}\n{select}" if ctes else select


# -- sources and sinks ----------------------------------------------------------------------

_add(
    "read_corpus_slice",
    "",
    f"SELECT doc_id, lang, source, md5(text) AS text_md5 FROM documents ORDER BY doc_id LIMIT {registry.SLICE}",
)
_FLAT = "SELECT pair_id, split, shape, prompt, diagram, slot_text, novel FROM uniq"
_add("pairs_json_roundtrip", PAIRS, _FLAT)
_UNPACKED = "SELECT split, md5(text) AS text_md5, count(*) AS n_docs FROM split_docs GROUP BY ALL"
_add(
    "token_shards",
    PLAIN_BLOCKS,
    f"""SELECT * FROM ({_UNPACKED}) JOIN (
  SELECT split, count(*) AS n_blocks, sum(len(tokens))::BIGINT AS n_plain_ids,
    sum(list_sum(tokens) * (block_id + 1) % {registry.CHECKSUM_BASE})::BIGINT AS checksum FROM blocks GROUP BY split) USING (split)""",
)
_add("token_file", SPLIT_DOCS, _UNPACKED)
_add(
    "grammar_tables",
    PAIRS,
    """SELECT shape, pattern, (SELECT count(*) FROM frames f WHERE f.shape = s.shape) AS n_frames,
  (SELECT count(*) FROM options o WHERE o.shape = s.shape) AS n_options,
  (SELECT count(*) FROM spoken p WHERE p.shape = s.shape) AS n_pairs FROM shapes s""",
)

# -- projections, filters, scalar functions ---------------------------------------------------

_add(
    "lexicon_floor_check",
    GRAMMAR,
    """SELECT kind, count(*) AS n_words, count(*) >= 8 AS enough FROM words
WHERE kind IN ('action', 'object', 'condition') GROUP BY kind""",
)
_LINK = r"\s+--(?:\s+(\S.*?)\s+--)?>\s+"


def _graphs(name: str, source: str, key: str, text: str) -> str:
    """CTEs name_node and name_edge (one row each), and name (lists per key), of diagram texts."""
    return rf"""
{name}_line AS (
  SELECT {key}, ln, line, string_split(regexp_replace(line, '{_LINK}', chr(1), 'g'), chr(1)) AS ends,
         regexp_extract_all(line, '{_LINK}', 1) AS labels
  FROM (SELECT {key}, unnest(body) AS line, generate_subscripts(body, 1) AS ln FROM (
    SELECT {key}, CASE WHEN regexp_matches(ls[1], '^(graph|flowchart)\s+\w+$') THEN ls[2:] ELSE ls END AS body FROM (
      SELECT {key}, list_filter(list_transform(string_split({text}, chr(10)), lambda x: trim(x)), lambda x: x <> '') AS ls FROM {source})))),
{name}_clear AS (
  SELECT *, len(list_filter(ends, lambda e: NOT regexp_matches(e, '^\w+(\[.*\]|\{{.*\}})?$'))) = 0 AS clear FROM {name}_line),
{name}_end AS (
  SELECT {key}, ln * 100 + k AS pos, regexp_extract(e, '^\w+') AS node,
         CASE WHEN e LIKE '%]' THEN 'box' WHEN e LIKE '%}}' THEN 'diamond' END AS kind,
         regexp_replace(e, '^\w+.|.$', '', 'g') AS label, labels[k] AS link
  FROM (SELECT {key}, ln, labels, unnest(ends) AS e, generate_subscripts(ends, 1) AS k FROM {name}_clear WHERE clear)),
{name}_node AS MATERIALIZED (
  SELECT {key}, node, min(pos) AS pos, coalesce(arg_max(kind, pos) FILTER (kind IS NOT NULL), 'bare') AS kind,
         arg_max(label, pos) FILTER (kind IS NOT NULL) AS label
  FROM {name}_end GROUP BY {key}, node),
{name}_edge AS MATERIALIZED (
  SELECT a.{key}, a.pos, a.node AS src, b.node AS dst, nullif(a.link, '') AS label
  FROM {name}_end a JOIN {name}_end b ON a.{key} = b.{key} AND b.pos = a.pos + 1),
{name} AS MATERIALIZED (
  SELECT s.{key}, readable, names, kinds, node_labels, edges FROM (SELECT DISTINCT {key} FROM {source}) s
  LEFT JOIN (SELECT {key}, bool_and(clear) AS readable FROM {name}_clear GROUP BY {key}) USING ({key})
  LEFT JOIN (SELECT {key}, list(node ORDER BY pos) AS names, list(kind ORDER BY pos) AS kinds,
                    list(label ORDER BY pos) AS node_labels FROM {name}_node GROUP BY {key}) USING ({key})
  LEFT JOIN (SELECT {key}, list({{'src': src, 'dst': dst, 'label': label}} ORDER BY pos) AS edges FROM {name}_edge GROUP BY {key})
    USING ({key}))
"""


_add(
    "diagram_graphs",
    PAIRS + "," + _graphs("gr", "uniq", "pair_id", "diagram"),
    """SELECT pair_id, len(names)::BIGINT AS n_nodes,
  array_to_string(list_transform(range(1, len(names) + 1), lambda j: names[j] || ':' || kinds[j] || ':' || node_labels[j]), chr(10)) AS nodes,
  array_to_string(list_transform(edges, lambda e: e.src || '>' || e.dst || ':' || coalesce(e.label, '')), chr(10)) AS edges,
  true AS survives, true AS drawn_same FROM gr""",
)
_add(
    "shape_graphs",
    PAIRS + "," + _graphs("gr", "uniq", "pair_id", "diagram") + "," + _graphs("sg", "shapes", "shape", "pattern"),
    """SELECT p.shape, p.item, p.slot, u.n_pairs FROM (
  SELECT shape, node || ':' || kind AS item, trim(label, '{}') AS slot FROM sg_node
  UNION ALL SELECT shape, src || '>' || dst, trim(coalesce(label, ''), '{}') FROM sg_edge) p
LEFT JOIN (SELECT shape, item, count(*) AS n_pairs FROM (
  SELECT pair_id, node || ':' || kind AS item FROM gr_node UNION ALL SELECT pair_id, src || '>' || dst FROM gr_edge)
  JOIN uniq USING (pair_id) GROUP BY ALL) u ON p.shape = u.shape AND p.item = u.item""",
)
# Equal up to the names of nodes: every way to match the nodes is tried.
_ORDERS = [("[" + ", ".join(map(str, o)) + "]",) for n in range(1, 5) for o in itertools.permutations(range(1, n + 1))]


def _seen(edges: str, names: str, order: str) -> str:
    at = f"list_position({names}, {{0}})"
    ends = [f"{order}[{at.format(f'e.{c}')}]" if order else at.format(f"e.{c}") for c in ("src", "dst")]
    return (
        f"list_sort(list_transform({edges}, lambda e: {ends[0]} || '>' || {ends[1]} || CASE WHEN e.label IS NULL THEN '-'"
        " WHEN {masked} THEN 'X' ELSE '=' || e.label END))"
    )


def _same(labels: bool) -> str:
    masked = "false" if labels else "list_contains(vals, e.label)"
    kinds = "list_transform(o, lambda j: b.kinds[j])"
    a, b = (_seen(*x).replace("{masked}", masked) for x in (("a.edges", "a.names", "o"), ("b.edges", "b.names", "")))
    extra = " AND a.node_labels = list_transform(o, lambda j: b.node_labels[j])" if labels else ""
    return f"coalesce(b.readable AND bool_or(a.kinds = {kinds}{extra} AND {a} = {b}), false)"


_add(
    "structural_match",
    FAULTY
    + ","
    + _graphs("ga", "faulty", "pair_id", "diagram")
    + ","
    + _graphs("gb", "faulty", "pair_id", "generated")
    + f""",
orders(o) AS ({_values(_ORDERS).replace("'", "")}),
judged AS (
  SELECT pair_id, fault, b.readable, {_same(False)} AS same_structure, {_same(True)} AS same_graph
  FROM faulty f JOIN ga a USING (pair_id) JOIN gb b USING (pair_id)
  LEFT JOIN orders ON len(o) = len(a.names) AND len(o) = len(b.names)
  GROUP BY pair_id, fault, b.readable)""",
    """SELECT fault, count(*) AS n, count(*) FILTER (readable) AS n_readable,
  round(count(*) FILTER (same_structure) / count(*), 6) AS structure_match,
  round(count(*) FILTER (same_graph) / count(*), 6) AS graph_match FROM judged GROUP BY fault""",
)
_add("slot_category", PAIRS, "SELECT pair_id, slot, category FROM slotted")
_add(
    "shape_slots",
    PAIRS,
    "SELECT pair_id, shape, array_to_string(names, ',') AS slots FROM drawn",
)
_add(
    "vocab_fragments",
    "",
    r"""SELECT DISTINCT lower(w) AS fragment FROM (
  SELECT unnest(regexp_extract_all(text, '\p{L}+')) AS w FROM documents) WHERE length(w) BETWEEN 2 AND 9""",
)
_add("render_pairs", PAIRS, "SELECT pair_id, prompt, diagram FROM drawn")

_WARN = r"""len(content) > 0 AND len(list_filter(content, lambda w: regexp_matches(w, '^\p{Lu}'))) < 2"""


def _content(text: str) -> str:
    words = (
        rf"list_transform(regexp_split_to_array({_strip(text)}, '\s+'),"
        r" lambda w: regexp_replace(w, '^[.,:;!?]+|[.,:;!?]+$', '', 'g'))"
    )
    return rf"list_filter({words}[2:], lambda w: regexp_full_match(w, '\p{{L}}+'))"


_PROMPTS = """
prompt_texts AS (
  SELECT 'turn-' || conv_id || '-' || turn AS key, text AS prompt FROM conversations
  UNION ALL SELECT 'order-' || pair_id, prompt FROM drawn)
"""
_add(
    "title_case_warning",
    PAIRS + "," + _PROMPTS,
    f"SELECT key, {_WARN} AS warn FROM (SELECT key, {_content('prompt')} AS content FROM prompt_texts)",
)


def _header(key: str) -> str:
    pick = f"{_win(f"md5('5|' || {key} || '|header')")} % 3"
    return f"CASE {pick} WHEN 1 THEN 'graph TD' WHEN 2 THEN 'stateDiagram-v2' END"


def _sanitized(code: str, header: str) -> str:
    """Clean one text; ``header`` may be null."""
    line = (
        "CASE WHEN len(string_split(w, 'A[')) > 2 THEN 'A[' || string_split(w, 'A[')[-1] ELSE w END"
    )
    line = rf"regexp_replace({line}, '\[([^\]\}}]*)\}}', '[\1]', 'g')"
    line = rf"regexp_replace({line}, '\{{([^\]\}}]*)\]', '{{\1}}', 'g')"
    line = rf"regexp_replace(regexp_replace({line}, '\]+', ']', 'g'), '\}}+', '}}', 'g')"
    lines = f"list_transform(string_split({code}, chr(10)), lambda w: {_strip('w')})"
    kept = (
        rf"list_filter({lines}, lambda w: w <> '' AND NOT coalesce({header} = 'graph TD'"
        r" AND regexp_matches(w, '^\[\*\]|-->\s*\S+:\s|(-->>|->>)'), FALSE)"
        rf" AND NOT coalesce({header} = 'stateDiagram-v2'"
        r" AND regexp_matches(w, '^subgraph\b|(-->>|->>)|^\w+\['), FALSE))"
    )
    square = "CASE WHEN contains(w, '[') AND NOT contains(w, ']') THEN w || ']' ELSE w END"
    curly = "CASE WHEN contains(w, '{') AND NOT contains(w, '}') THEN w || '}' ELSE w END"
    for step in (line, square, curly):
        kept = f"list_transform({kept}, lambda w: {step})"
    return f"array_to_string({kept}, chr(10) || '    ')"


def _reassembled(text: str, header: str) -> str:
    body = _strip(f"replace({text}, '<|endoftext|>', '')")
    return (
        f"CASE WHEN {header} IS NOT NULL THEN {body} WHEN contains({body}, 'graph')"
        f" THEN substr({body}, strpos({body}, 'graph')) ELSE 'graph TD' || chr(10) || '    A[' || {body} END"
    )


_add(
    "sanitize_diagrams",
    FAULTY,
    f"""SELECT pair_id, header, {_sanitized("generated", "header")} AS code
FROM (SELECT *, {_header("pair_id")} AS header FROM faulty)""",
)
_add(
    "reassemble_output",
    FAULTY,
    f"""SELECT key, header, {_reassembled("text", "header")} AS code FROM (
  SELECT key, text, {_header("key")} AS header FROM (
    SELECT conv_id * 1000 + turn + 1000000000 AS key, text FROM conversations
    UNION ALL SELECT pair_id, '  sure: ' || generated || '<|endoftext|>' FROM faulty))""",
)
_add(
    "normalize_code",
    FAULTY,
    f"""SELECT origin, key, md5({_norm("text")}) AS code_md5 FROM (
  SELECT 'document' AS origin, doc_id AS key, text FROM documents
  UNION ALL SELECT 'output', pair_id, generated FROM faulty)""",
)


def _skeleton(code: str) -> str:
    return f"list_reduce(list_prepend({_norm(code)}, vals), lambda a, v: replace(a, v, 'X'))"


_add(
    "diagram_skeleton",
    FAULTY,
    f"SELECT pair_id, {_skeleton('diagram')} AS target, {_skeleton('generated')} AS output FROM faulty",
)
_add(
    "diagram_openers",
    PAIRS,
    "SELECT DISTINCT left(diagram, strpos(diagram, chr(10)) + 5) AS opener FROM drawn",
)
# A prefix's pre-tokens are those of the full text exactly where its ids are, whatever the merges.
_add(
    "prefix_token_audit",
    PAIRS
    + f""",
audited AS (
  SELECT shape, prefix, {_pre("prefix")} AS p, {_pre("diagram")} AS f
  FROM drawn, (SELECT 'graph TD' || chr(10) || unnest(['    A', '   ', '    ']) AS prefix))""",
    "SELECT shape, prefix, count(*) AS n, count(*) FILTER (f[1 : len(p)] = p) AS n_agree FROM audited GROUP BY ALL",
)

# -- tokenizer ------------------------------------------------------------------------------

_add(
    "pretokenize",
    "",
    f"""SELECT doc_id, generate_subscripts(pre, 1) - 1 AS pos, unnest(pre) AS pretoken
FROM (SELECT doc_id, {_pre("text")} AS pre FROM documents)""",
)
_add("pretoken_frequencies", _train(0), "SELECT pretoken, n FROM freq")
_add("bpe_pair_counts", _train(1), "SELECT l AS left_id, r AS right_id, n FROM c1")
_BYTE = "('0x' || substr(hex(encode(text)), 2 * j + 1, 2))::INT"
_add(
    "bpe_encode",
    PLAIN,
    f"""SELECT doc_id, strlen(text) AS n_bytes, md5(array_to_string(list_transform(
    list_transform(range(0, strlen(text)), lambda j: {_BYTE}), lambda b: {_SHOWN}), '')) AS shown_md5, true AS in_range,
  n_plain_ids, plain_ids_md5
FROM (SELECT doc_id, coalesce(text, '') AS text FROM documents)
JOIN (SELECT doc_id, len(ids) AS n_plain_ids, {_ids("ids")} AS plain_ids_md5 FROM plain) USING (doc_id)""",
)
_add("bpe_decode", "", "SELECT doc_id, md5(text) AS text_md5 FROM documents")
_TOTALS = """SELECT split, count(*) AS n_docs, sum(strlen(text))::BIGINT AS text_bytes, count(*) AS n_ends
FROM split_docs GROUP BY split"""
_add(
    "split_token_totals",
    PLAIN,
    f"""SELECT * FROM ({_TOTALS}) JOIN (
  SELECT split, sum(len(ended))::BIGINT AS n_plain_ids, (2 * sum(len(ended)))::BIGINT AS n_bytes FROM plain GROUP BY split) USING (split)""",
)

# -- lexicon and grammar ----------------------------------------------------------------------

_add("label_pools", GRAMMAR, "SELECT category, value FROM pool_all")
_add("pool_value_split", GRAMMAR, "SELECT category, split, idx, value FROM pool")
_add(
    "lexicon_report",
    GRAMMAR,
    """SELECT category, CASE WHEN category = 'label' THEN n_train ELSE n_train + n_val END AS n_values, n_train, n_val,
  category = 'label' AS closed, (SELECT count(DISTINCT (kind, word)) FROM named WHERE NOT regexp_full_match(word, '__WORD__')) AS n_dropped
FROM (SELECT category, count(*) FILTER (split = 'train') AS n_train, count(*) FILTER (split = 'val') AS n_val
    FROM pool GROUP BY category)""".replace("__WORD__", _SHOWN_WORD),
)
_USE = """
used AS (SELECT shape, split, paraphrase, count(*) AS n_pairs FROM spoken GROUP BY ALL),
phrase_use AS (
  SELECT p.*, coalesce(u.n_pairs, 0) AS n_pairs FROM phrases p LEFT JOIN used u USING (shape, split, paraphrase))
"""
_add("enumerate_paraphrases", PAIRS + "," + _USE, "SELECT shape, paraphrase, n_pairs FROM phrase_use")
_add("paraphrase_split", PAIRS + "," + _USE, "SELECT shape, split, idx, paraphrase, n_pairs FROM phrase_use")
_add(
    "paraphrase_report",
    PAIRS + "," + _USE,
    """SELECT coalesce(shape, 'TOTAL') AS shape, count(*) AS n_total, count(*) FILTER (split = 'train') AS n_train,
  count(*) FILTER (split = 'val') AS n_val, sum(n_pairs)::BIGINT AS n_pairs FROM phrase_use
GROUP BY GROUPING SETS ((shape), ())""",
)
_add(
    "grammar_ambiguity_audit",
    PAIRS,
    r"""SELECT regexp_replace(paraphrase, '\{[a-z]+_[0-9]+\}', '#', 'g') AS skeleton, count(DISTINCT shape) AS n_shapes,
  count(*) AS n, count(DISTINCT shape) > 1 AS ambiguous FROM spoken GROUP BY 1""",
)


def _leak(kind: str, source: str, value: str, where: str = "TRUE") -> str:
    side = "(SELECT DISTINCT {v} FROM {s} WHERE split = '{x}' AND {w})"
    train, val = (side.format(v=value, s=source, x=x, w=where) for x in ("train", "val"))
    return (
        f"SELECT '{kind}' AS kind, (SELECT count(*) FROM {train}) AS n_train, (SELECT count(*) FROM {val}) AS n_val,"
        f" (SELECT count(*) FROM (SELECT * FROM {train} INTERSECT SELECT * FROM {val})) AS n_shared"
    )


_add(
    "split_leakage_audit",
    PAIRS,
    " UNION ALL ".join(
        [
            _leak("values", "pool", "value", "category <> 'label'"),
            _leak("paraphrases", "spoken", "paraphrase"),
            _leak("prompts", "drawn", "prompt"),
        ]
    ),
)

# -- sampling and pairs -------------------------------------------------------------------------

_SLOT_TEXT = "SELECT pair_id, split, shape, slot_text FROM drawn"
_add("sample_slots", GRAMMAR + "," + KEYS + "," + _drawn("split_keys", "FALSE"), _SLOT_TEXT)
_add("novel_slots", GRAMMAR + "," + KEYS + "," + _drawn("split_keys", "TRUE"), _SLOT_TEXT)
_add(
    "novel_spans",
    GRAMMAR + "," + KEYS,
    f"""SELECT pair_id, {_span("'act_1'")} AS span_1, {_span("'cond_1'")} AS span_2
FROM split_keys, (SELECT list(fragment ORDER BY idx) AS fr FROM fragments)""",
)
_add("generate_pairs", PAIRS, _FLAT)
_add(
    "pair_mix_report",
    PAIRS,
    """SELECT coalesce(split, 'ALL') AS split, coalesce(shape, 'ALL') AS shape, count(*) AS n_pairs,
  count(*) FILTER (novel) AS n_novel, round(count(*) FILTER (novel) / count(*), 6) AS novel_share
FROM uniq GROUP BY CUBE (split, shape)""",
)
_add("axis_sets", AXES, "SELECT pair_id, split AS axis, shape, prompt, diagram FROM drawn")
_CHUNKS = """,
chunks AS (
  SELECT category || '/' || (r // 64) AS line, string_agg(value, ' ' ORDER BY r) AS text FROM (
    SELECT category, value, row_number() OVER (PARTITION BY category ORDER BY md5(value), value) - 1 AS r FROM pool_all)
  GROUP BY category, r // 64)"""
_LINES = """SELECT 'values' AS origin, copy, line, text FROM chunks, (SELECT unnest(range(1, 6)) AS copy)
UNION ALL SELECT 'pairs', 1, pair_id::VARCHAR, prompt || chr(10) || diagram FROM uniq WHERE split = 'train' AND NOT novel"""
_add("tokenizer_corpus_sample", PAIRS + _CHUNKS, _LINES)
_add(
    "mixed_corpus",
    PAIRS + _CHUNKS,
    f"""SELECT origin, copy, line, md5(text) AS text_md5 FROM ({_LINES}
UNION ALL SELECT 'documents', 1, doc_id::VARCHAR, text FROM documents)""",
)

# -- sequence building ----------------------------------------------------------------------------

_add(
    "document_split",
    "",
    f"""SELECT doc_id, CASE WHEN {_win("md5('42|' || doc_id || '|side')")} < {_DOC_VAL} THEN 'val' ELSE 'train' END AS split
FROM documents""",
)
_add(
    "append_eot",
    PLAIN,
    f"""SELECT doc_id, 1::BIGINT AS n_ends, {bl.EOT}::BIGINT AS last_id, md5(text) AS text_md5,
  len(ended) AS n_plain_ids, ended[-1] AS last_plain_id FROM plain""",
)
_add("pack_blocks", SPLIT_DOCS, _UNPACKED)
_L = registry.BLOCK
_add(
    "next_token_pairs",
    PLAIN_BLOCKS,
    f"""SELECT *, true AS y_follows FROM ({_UNPACKED})
UNION ALL BY NAME SELECT split, block_id, {_ids(f"tokens[1:{_L}]")} AS x_md5, {_ids(f"tokens[2:{_L + 1}]")} AS y_md5 FROM blocks""",
)
_FRAMED = f"""{bl.DIAGRAM}::BIGINT AS first_id, md5(prompt) AS prompt_md5, md5(diagram) AS diagram_md5, {bl.EOT}::BIGINT AS last_id"""
_add("instruction_encode", PAIRS, f"SELECT pair_id, {_FRAMED} FROM uniq")
_add(
    "conversation_encode",
    "",
    f"""SELECT conv_id, true AS fits, CASE WHEN arg_min(role, turn) = 'assistant' THEN {bl.RESPONSE} ELSE {bl.PROMPT} END::BIGINT AS first_id,
  left(string_agg(coalesce(text, ''), '' ORDER BY turn), 100) AS opening,
  md5(string_agg(CASE WHEN role = 'assistant' THEN '' ELSE coalesce(text, '') END, '' ORDER BY turn)) AS asked_md5,
  md5(string_agg(CASE WHEN role = 'assistant' THEN coalesce(text, '') ELSE '' END, '' ORDER BY turn)) AS replies_md5
FROM conversations GROUP BY conv_id""",
)
_add(
    "dynamic_padding",
    PAIRS,
    f"""SELECT pair_id, (row_number() OVER (ORDER BY md5('7|' || pair_id || '|batch'), pair_id) - 1) // {registry.BATCH} AS batch_id,
  true AS padded, {_FRAMED} FROM uniq""",
)

# -- evaluation ------------------------------------------------------------------------------------

_add(
    "needle_context",
    PAIRS + "," + _NEEDLES,
    """SELECT shape, slot, left_char, right_char, n_pairs FROM needles
JOIN (SELECT shape, count(*) AS n_pairs FROM drawn GROUP BY shape) USING (shape)""",
)
_add("slot_outcomes", SCORES, "SELECT pair_id, slot, value, hit FROM hit_rows")
_add("slot_metrics", SCORES, f"SELECT {_METRICS} FROM scores")
_add(
    "pool_novel_gap",
    SCORES,
    """SELECT round(p, 6) AS sample_acc_pool, round(q, 6) AS sample_acc_novel, round(p - q, 6) AS gap FROM (
  SELECT avg(all_hit::INT) FILTER (NOT novel) AS p, avg(all_hit::INT) FILTER (novel) AS q FROM scores)""",
)
_add(
    "axis_costs",
    AXIS_SCORES,
    """SELECT round(a, 6) AS control, round(b, 6) AS values_acc, round(c, 6) AS phrasing, round(d, 6) AS both_acc,
  round(a - b, 6) AS cost_values, round(a - c, 6) AS cost_phrasing FROM (
  SELECT avg(all_hit::INT) FILTER (split = 'control') AS a, avg(all_hit::INT) FILTER (split = 'values') AS b,
    avg(all_hit::INT) FILTER (split = 'phrasing') AS c, avg(all_hit::INT) FILTER (split = 'both') AS d FROM scores)""",
)
_add(
    "shape_accuracy",
    AXIS_SCORES,
    """SELECT shape, count(*) AS n, count(*) FILTER (all_hit) AS n_ok, round(avg(all_hit::INT), 6) AS accuracy
FROM scores WHERE split = 'phrasing' GROUP BY shape ORDER BY accuracy, shape""",
)
_add(
    "shape_match",
    FAULTY,
    f"""SELECT count(*) AS n, round(count(*) FILTER ({_skeleton("diagram")} = {_skeleton("generated")}) / count(*), 6) AS shape_match
FROM faulty""",
)
_add(
    "miss_examples",
    SCORES,
    f"""SELECT pair_id, prompt, {_norm("diagram")} AS target, {_norm("generated")} AS output, coalesce(missing, 'none') AS missing
FROM scores ORDER BY pair_id LIMIT 100""",
)
_add(
    "metric_self_check",
    FAULTY
    + """,
checked AS (
  SELECT * REPLACE (diagram AS generated, 'none' AS fault), 'target' AS kind FROM faulty
  UNION ALL SELECT * REPLACE (split || '!' AS split), CASE WHEN fault = 'blank_lines' THEN 'harmless' ELSE 'known_bad' END
  FROM faulty WHERE fault <> 'none'),"""
    + _scored("checked"),
    f"""SELECT kind, fault, {_METRICS},
  round(count(*) FILTER (len(list_filter(vals, lambda v: NOT contains(generated, v))) = 0) / greatest(1, count(*)), 6) AS naive_acc
FROM scores GROUP BY kind, fault""",
)
_add("corrupted_outputs", FAULTY, "SELECT pair_id, fault, generated FROM faulty")
_HAS = r"'^\s*graph T[DB]\s+[A-Z][\[\{]'"
_AUDIT_HEADER = f"CASE WHEN {_win("md5('5|' || pair_id || '|header')")} % 3 > 0 THEN 'graph TD' END"
_add(
    "stage_audit",
    FAULTY
    + f""",
assembled AS (
  SELECT *, {_reassembled("generated", "header")} AS mid FROM (SELECT *, {_AUDIT_HEADER} AS header FROM faulty)),
cleaned AS (SELECT *, {_sanitized("mid", "header")} AS final FROM assembled)""",
    f"""SELECT pair_id, fault, CASE WHEN NOT regexp_matches(generated, {_HAS}) THEN 'model'
  WHEN NOT regexp_matches(mid, {_HAS}) THEN 'reassembly' WHEN NOT regexp_matches(final, {_HAS}) THEN 'sanitiser'
  ELSE 'kept' END AS verdict, md5(final) AS code_md5 FROM cleaned""",
)
_LOG = """
batch_log AS (
  SELECT user_id AS run, date_diff('day', (min(ts) OVER (PARTITION BY user_id))::DATE, ts::DATE) + 1 AS epoch,
    CASE WHEN event_type IN ('view', 'click', 'signup') THEN 'train' ELSE 'val' END AS phase, value AS loss FROM events),
run_log AS (
  SELECT run, epoch, max(loss) FILTER (phase = 'val') AS val_loss, round(min(loss) / max(loss), 6) AS sample_acc
  FROM batch_log GROUP BY run, epoch)
"""
_add(
    "best_checkpoint",
    _LOG,
    """SELECT a.run, a.epoch AS best_epoch, round(a.sample_acc, 6) AS best_acc, b.epoch AS lowest_loss_epoch, round(b.val_loss, 6) AS lowest_loss
FROM (SELECT * FROM run_log QUALIFY row_number() OVER (PARTITION BY run ORDER BY sample_acc DESC, epoch) = 1) a
LEFT JOIN (SELECT * FROM run_log WHERE val_loss IS NOT NULL QUALIFY row_number() OVER (PARTITION BY run ORDER BY val_loss, epoch) = 1) b USING (run)""",
)
_add(
    "early_stop_epoch",
    _LOG
    + """,
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY run ORDER BY epoch) AS seat,
    max(sample_acc) OVER (PARTITION BY run ORDER BY epoch ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS so_far FROM run_log),
last_gain AS (
  SELECT *, max(CASE WHEN so_far IS NULL OR sample_acc > so_far THEN seat END) OVER (PARTITION BY run ORDER BY epoch) AS gain FROM ranked)""",
    "SELECT run, min(CASE WHEN seat - gain >= 3 THEN epoch END) AS stop_epoch, max(epoch) AS last_epoch FROM last_gain GROUP BY run",
)
_add(
    "epoch_loss_means",
    _LOG,
    "SELECT run, epoch, phase, count(*) AS n_batches, round(avg(loss), 6) AS mean_loss FROM batch_log GROUP BY ALL",
)

# -- streaming, prompt to diagram --------------------------------------------------------------------

_STREAM_KEYS = f"""
orders_id AS (SELECT DISTINCT o_orderkey AS pair_id FROM orders),
stream_keys AS (
  SELECT pair_id, 42 AS seed, 'train' AS split, 'train' AS value_split, 'train' AS phrase_split,
         {_win("md5('42|' || pair_id || '|side')", 1)} < {int(0.2 * 16**7)} AS novel FROM orders_id)
"""
_add(
    "stream_pairs",
    GRAMMAR + "," + _STREAM_KEYS + "," + _drawn("stream_keys"),
    "SELECT DISTINCT prompt, diagram FROM drawn",
)
_add("stream_tokenize", SPLIT_DOCS, _TOTALS)
_add(
    "synthesize_diagrams",
    PAIRS,
    "SELECT pair_id, shape, slot_text, diagram AS generated FROM drawn",
)
_add(
    "unmatched_prompts",
    PAIRS,
    f"""SELECT key, CASE WHEN {_WARN} THEN 'no_title_case' ELSE 'no_known_shape' END AS reason FROM (
  SELECT key, {_content('prompt')} AS content FROM (
    SELECT 'turn-' || conv_id || '-' || turn AS key, text AS prompt FROM conversations
    UNION ALL SELECT 'order-' || pair_id, lower(prompt) FROM drawn))""",
)
