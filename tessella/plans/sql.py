"""SQL twins of the text expressions and of the document chain, for comparison in DuckDB.

Line breaks are chr(10); RE2 has no look-ahead and its `$` is the end of the text, so patterns
are written for it rather than shared with the engine.
"""

from __future__ import annotations

from ..conf import BOILERPLATE, SMALL_WORDS

NL = "chr(10)"
HEAD = r"^#{1,6}\s"
HEADING = r"^(#{1,6})\s+(.+)$"
NUMBERED = r"^(\d+)\\?\.\s+(.+)$"
ITEM = r"^\s*([-*+]|\d+[.)])\s"
TOC = r"^\s*[-*]\s+\[([^\]]+)\]\(([^)]+)\)\s*$"


def trim(x: str) -> str:
    return rf"regexp_replace({x}, '^[\s\x{{A0}}\x{{FEFF}}]+|[\s\x{{A0}}\x{{FEFF}}]+$', '', 'g')"


def title_key(x: str) -> str:
    return f"trim(regexp_replace(regexp_replace(lower({x}), '[*_`]', '', 'g'), '[^a-z0-9]+', ' ', 'g'))"


def tokens(x: str) -> str:
    return f"CAST(ceil(length({x}) / 4.0) AS INTEGER)"


def rx(x: str, pattern: str) -> str:
    return f"regexp_matches({x}, '{pattern}')"


def looks(t: str) -> str:
    """Heading test of a trimmed line."""
    words = rf"list_filter(string_split_regex({t}, '\s+'), lambda w: w <> '')"
    small = ", ".join(f"'{w}'" for w in SMALL_WORDS)
    telling = f"list_filter({words}, lambda w: lower(w) NOT IN ({small}))"
    letters, upper = f"length(regexp_replace({t}, '[^a-zA-Z]', '', 'g'))", f"length(regexp_replace({t}, '[^A-Z]', '', 'g'))"
    shape = rf"length({t}) BETWEEN 1 AND 90 AND NOT {rx(t, HEAD)} AND NOT {rx(t, '^[|>]')} AND NOT {rx(t, r'\]\(')} AND {letters} >= 3 AND {upper} <= {letters} * 0.9"
    style = rf"NOT {rx(t, ITEM)} AND NOT {rx(t, '[.:;!?]$')} AND NOT {rx(t, r'^\*\*.*\*\*$')} AND NOT {rx(t, r'^[^:]{1,40}:\s*\S')}"
    caps = f"(len({words}) <= 14 AND len({telling}) > 0 AND len(list_filter({telling}, lambda w: regexp_matches(w, '^[A-Z]'))) >= len({telling}) * 0.6)"
    plain = f"(length({t}) <= 70 AND len({words}) <= 10 AND {rx(t, '^[A-Z]')} AND NOT contains({t}, ','))"
    return f"({shape} AND ({rx(t, NUMBERED)} OR ({style})) AND ({rx(t, NUMBERED)} OR {caps} OR {plain}))"


#: The declared input: before line i of a document a heading, question, table or numbered title; the line itself whole.
MARKDOWN = r"""
d AS (SELECT doc_id, '# Document ' || doc_id || chr(10) || chr(10)
  || '- [Section 0](https://example.org/d/' || doc_id || '#s0)' || chr(10) || '- [Section 12](https://example.org/d/' || doc_id || '#s12)' || chr(10) || chr(10)
  || array_to_string(list_transform(string_split(text, chr(10)), lambda x, j: CASE
    WHEN (j - 1) % 12 = 0 THEN '## Section ' || (j - 1) || chr(10) || chr(10)
    WHEN (j - 1) % 24 IN (3, 5) THEN 'What does line ' || (j - 1) || ' say?' || chr(10) || chr(10)
    WHEN (j - 1) % 12 = 8 THEN '| Line |' || chr(10) || '| ' || (j - 1) || ' |' || chr(10) || chr(10)
    WHEN (j - 1) % 24 = 10 THEN (j - 1) || '\. Part ' || (j - 1) || chr(10) || chr(10) ELSE '' END || x), chr(10) || chr(10)) AS md FROM documents)"""

LINES = rf"""
l0 AS (SELECT doc_id, unnest(string_split(md, chr(10))) AS line, unnest(range(len(string_split(md, chr(10))))) AS i FROM d),
l1 AS (SELECT *, i <= 60 AND {rx("line", TOC)} AS link, {rx("line", HEAD)} AS head FROM l0),
l2 AS (SELECT *, min(i) FILTER (WHERE link) OVER (PARTITION BY doc_id) AS fl FROM l1),
l3 AS (SELECT *, min(i) FILTER (WHERE head AND i > fl) OVER (PARTITION BY doc_id) AS te FROM l2),
toc AS (SELECT doc_id, i, regexp_extract(line, '{TOC}', 1) AS title, regexp_extract(line, '{TOC}', 2) AS url FROM l3 WHERE link AND (te IS NULL OR i < te)),
lines AS (SELECT doc_id, line, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY i) - 1 AS INTEGER) AS pos FROM l3 WHERE NOT (link AND (te IS NULL OR i < te)))"""

CANDIDATES = rf"""
tk AS (SELECT DISTINCT doc_id, {title_key("title")} AS key FROM toc),
c0 AS (SELECT lines.*, {title_key("line")} AS key, {trim("line")} = '' AS blank FROM lines),
c1 AS (SELECT *, sum(CASE WHEN regexp_matches(line, '^\s*```') THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY pos) % 2 = 1 AS in_fence,
   coalesce(lag(blank) OVER (PARTITION BY doc_id ORDER BY pos), true) AS alone,
   first(CASE WHEN NOT blank THEN line END IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS following FROM c0),
c2 AS (SELECT c1.*, coalesce(NOT {rx(trim("following"), HEAD)}, false) AS followed, tk.key IS NOT NULL AND c1.key <> '' AND NOT regexp_matches(line, '^\s*#') AS listed FROM c1 LEFT JOIN tk ON c1.doc_id = tk.doc_id AND c1.key = tk.key),
cand AS (SELECT *, NOT in_fence AND alone AND NOT blank AND (listed OR {looks(trim("line"))}) AND followed AS candidate FROM c2)"""

_TITLE = rf"regexp_replace(regexp_replace({trim('line')}, '^\*\*|\*\*$', '', 'g'), '^(\d+)\\\.(\s)', '\1.\2')"

PROMOTED = rf"""
p0 AS (SELECT doc_id, pos, line AS raw, candidate, {_TITLE} AS t FROM cand),
p1 AS (SELECT *, candidate AND {rx("t", NUMBERED)} AS numbered, {rx("t", NUMBERED)} AS tn FROM p0),
p2 AS (SELECT *, max(CASE WHEN numbered THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY pos) = 1 AS seen FROM p1),
prom AS (SELECT doc_id, pos, CASE WHEN candidate THEN t END AS promoted, CASE WHEN candidate THEN CASE WHEN seen AND NOT tn THEN '### ' ELSE '## ' END || t ELSE raw END AS line FROM p2)"""


def _path() -> str:
    at = ", ".join(f"coalesce(max(CASE WHEN level = {k} THEN pos END) OVER w, -1) AS p{k}, last_value(CASE WHEN level = {k} THEN title END IGNORE NULLS) OVER w AS t{k}" for k in range(1, 7))
    keep = ", ".join(f"CASE WHEN p{k} > greatest(-1, {', '.join([f'p{j}' for j in range(1, k)] + ['-1'])}) THEN t{k} END" for k in range(1, 7))
    return rf"""
s0 AS (SELECT *, CASE WHEN {rx("line", HEADING)} THEN length(regexp_extract(line, '{HEADING}', 1)) END AS level, CASE WHEN {rx("line", HEADING)} THEN {trim(f"regexp_extract(line, '{HEADING}', 2)")} END AS title FROM prom),
s1 AS (SELECT *, CAST(count(level) OVER w AS INTEGER) AS section, {at} FROM s0 WINDOW w AS (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
s2 AS (SELECT doc_id, pos, line, level, title, section, list_filter([{keep}], lambda t: t IS NOT NULL) AS heading_path FROM s1),
sec0 AS (SELECT doc_id, section, first(heading_path ORDER BY pos) AS heading_path, {trim("string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE level IS NULL)")} AS body FROM s2 GROUP BY doc_id, section),
sec AS (SELECT * FROM sec0 WHERE body <> '')"""


SECTIONS = _path()

PARAGRAPHS = rf"""
q0 AS (SELECT doc_id, section, heading_path, list_filter(list_transform(string_split_regex(body, '\n{{2,}}'), lambda p: {trim("p")}), lambda p: p <> '') AS ps FROM sec),
q1 AS (SELECT doc_id, section, heading_path, unnest(ps) AS p, unnest(range(len(ps))) AS ppos FROM q0),
par AS (SELECT *, {tokens("p")} AS tokens, p LIKE '%?' AND length(p) <= 140 AND NOT contains(p, chr(10)) AND NOT {rx("p", ITEM)} AS is_q,
  {rx("p", r"(?m)^\|")} AND len(list_filter(string_split(p, chr(10)), lambda x: {trim("x")} LIKE '|%')) >= 2 AS is_table FROM q1)"""

MARKED = """
m0 AS (SELECT *, sum(is_q::INT) OVER (PARTITION BY doc_id, section) AS nq, max(is_table::INT) OVER (PARTITION BY doc_id, section) AS nt,
  CAST(sum(is_q::INT) OVER w AS INTEGER) AS qgroup, CAST(sum(is_table::INT) OVER w - is_table::INT AS INTEGER) AS trun, coalesce(lead(is_table) OVER w, false) AS nextt
  FROM par WINDOW w AS (PARTITION BY doc_id, section ORDER BY ppos)),
m AS (SELECT *, CASE WHEN nq >= 2 THEN 'qa' WHEN nt = 1 THEN 'table' ELSE 'plain' END AS shape, NOT (nq >= 2) AND nt = 1 AND NOT is_table AND nextt AS caption FROM m0)"""

DRAFTS = """
qa AS (SELECT doc_id, section, first(heading_path) AS heading_path, qgroup AS run, 0 AS slot, 0 AS part, CASE WHEN qgroup = 0 THEN 'prose' ELSE 'qa' END AS kind,
  string_agg(p, chr(10) || chr(10) ORDER BY ppos) AS text, max(CASE WHEN is_q THEN p END) AS question, NULL::INTEGER AS part_index, NULL::INTEGER AS part_count
  FROM m WHERE shape = 'qa' GROUP BY doc_id, section, qgroup),
tab AS (SELECT doc_id, section, first(heading_path) AS heading_path, trun AS run, 1 AS slot, 0 AS part, 'table' AS kind, string_agg(p, chr(10) || chr(10) ORDER BY ppos) AS text,
  NULL::VARCHAR AS question, NULL::INTEGER AS part_index, NULL::INTEGER AS part_count FROM m WHERE shape = 'table' AND (is_table OR caption) GROUP BY doc_id, section, trun),
k0 AS (SELECT doc_id, section, heading_path, trun, p, tokens, row_number() OVER (PARTITION BY doc_id, section, trun ORDER BY ppos) AS k,
  lag(tokens) OVER (PARTITION BY doc_id, section, trun ORDER BY ppos) AS pt, lag(p) OVER (PARTITION BY doc_id, section, trun ORDER BY ppos) AS pp
  FROM m WHERE shape = 'plain' OR (shape = 'table' AND NOT is_table AND NOT caption)),
pk AS (
  SELECT doc_id, section, trun, k, tokens AS cur, 0 AS part, NULL::VARCHAR AS carry FROM k0 WHERE k = 1
  UNION ALL
  SELECT n.doc_id, n.section, n.trun, n.k, CASE WHEN pk.cur + n.tokens > 120 THEN CASE WHEN n.pt <= 18 THEN n.pt ELSE 0 END + n.tokens ELSE pk.cur + n.tokens END,
    CASE WHEN pk.cur + n.tokens > 120 THEN pk.part + 1 ELSE pk.part END, CASE WHEN pk.cur + n.tokens > 120 AND n.pt <= 18 THEN n.pp END
  FROM pk JOIN k0 n ON n.doc_id = pk.doc_id AND n.section = pk.section AND n.trun = pk.trun AND n.k = pk.k + 1),
k1 AS (SELECT pk.doc_id, pk.section, pk.trun, pk.part, first(k0.heading_path) AS heading_path,
  coalesce(max(carry) || chr(10) || chr(10), '') || string_agg(k0.p, chr(10) || chr(10) ORDER BY pk.k) AS text
  FROM pk JOIN k0 USING (doc_id, section, trun, k) GROUP BY pk.doc_id, pk.section, pk.trun, pk.part),
k2 AS (SELECT *, CAST(count(*) OVER (PARTITION BY doc_id, section, trun) AS INTEGER) AS n FROM k1),
packed AS (SELECT doc_id, section, heading_path, trun AS run, 0 AS slot, part, 'clause' AS kind, text, NULL::VARCHAR AS question, CASE WHEN n > 1 THEN part END AS part_index, CASE WHEN n > 1 THEN n END AS part_count FROM k2),
drafts AS (SELECT * FROM qa UNION ALL SELECT * FROM tab UNION ALL SELECT * FROM packed)"""

CHUNKS = rf"""
hk AS (SELECT DISTINCT doc_id, {title_key("title")} AS key FROM s2 WHERE title IS NOT NULL),
ta0 AS (SELECT doc_id, {title_key("title")} AS key, i, CASE WHEN contains(url, '#') THEN substr(url, position('#' IN url) + 1) END AS a FROM toc),
ta AS (SELECT doc_id, key, arg_max(a, i) AS anchor FROM ta0 WHERE a <> '' AND key <> '' GROUP BY doc_id, key),
ch0 AS (SELECT *, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY section, run, slot, part) - 1 AS INTEGER) AS ordinal FROM drafts
  WHERE kind = 'qa' OR part_index IS NOT NULL OR {tokens("text")} >= 12),
ch1 AS (SELECT *, 'Document ' || doc_id AS title, {title_key("coalesce(heading_path[-1], 'Document ' || doc_id)")} AS leaf FROM ch0),
chunks AS (SELECT ch1.doc_id || ':' || ordinal AS id, CAST(ch1.doc_id AS VARCHAR) AS document_id, ordinal, text, kind,
  list_concat([title], list_filter(heading_path, lambda h: h <> title)) AS heading_path, CASE WHEN hk.key IS NOT NULL THEN ta.anchor END AS anchor,
  question, part_index, part_count, 'https://example.org/d/' || ch1.doc_id AS source_url, title AS source_title
  FROM ch1 LEFT JOIN hk ON hk.doc_id = ch1.doc_id AND hk.key = leaf LEFT JOIN ta ON ta.doc_id = ch1.doc_id AND ta.key = leaf)"""

_CHAIN = [MARKDOWN, LINES, CANDIDATES, PROMOTED, SECTIONS, PARAGRAPHS, MARKED, DRAFTS, CHUNKS]


def chain(upto: str, select: str) -> str:
    """WITH clause of the document chain up to a step, and what to select from it."""
    return f"WITH RECURSIVE {','.join(_CHAIN[: _CHAIN.index(upto) + 1])}\n{select}"


def boilerplate(x: str) -> str:
    return rf"regexp_matches({trim(x)}, '(?i)^(?:{'|'.join(BOILERPLATE)})$')"
