"""SQL of blocks and recovered projects that shares no code with the operators: lines as rows, windows for where a block that
began at a line would end, and recursion from one block, or one line that reads like a project, to the next.

Lists of words are the operators' fixed values; everything else is said anew.
"""

from __future__ import annotations

from docsift.functions.dialect import DuckDB
from docsift.operators import layout as ly
from docsift.plans.rough import BASES

D = DuckDB()
_BULLET = r"[-•●▪◦►▸■□◆◇*]"


def _list(words) -> str:
    return "(" + ", ".join(f"'{w}'" for w in words) + ")"


def _has(x: str, words) -> str:
    return "(" + " OR ".join(f"contains({x}, '{w}')" for w in words) + ")"


_LINES = f"""WITH RECURSIVE t AS ({BASES['both'].format(documents='documents', customer='customer')}),
l AS (SELECT doc_id, list_transform({D.split_lines("coalesce(text, '')")}, lambda x: {D.strip('x')}) AS ls FROM t),
e AS (SELECT doc_id, ls, unnest(ls) AS line, generate_subscripts(ls, 1) - 1 AS i FROM l)"""

_TITLE = f"{D.title_case('line')} AND n_words <= 3 AND right(line, 1) NOT IN ('.', ',', ';', ':')"
_BLOCKS = f"""{_LINES},
w AS (SELECT *, {D.n_words('line')} AS n_words, regexp_matches(line, '^{_BULLET}') AS bullet, regexp_matches(line, '{ly.CONTACT}') AS contact FROM e),
k AS (SELECT *, CASE WHEN line = '' THEN '' WHEN length(line) <= 60 AND (lower(line) IN {_list(ly.HEADINGS)} OR ({D.upper_case('line')} AND n_words <= 4) OR ({_TITLE})) THEN 'heading'
  WHEN bullet THEN 'bullet_group' WHEN contact THEN 'contact' ELSE 'paragraph' END AS kind FROM w),
n AS (SELECT *, len(ls) AS total, lead(kind) OVER o AS next_kind, lead(bullet) OVER o AS next_bullet, lead(n_words) OVER o AS next_words,
  coalesce(CASE kind WHEN 'paragraph' THEN min(CASE WHEN kind IN ('', 'heading', 'bullet_group') THEN i END) OVER later
    WHEN 'bullet_group' THEN min(CASE WHEN line <> '' AND NOT bullet THEN i END) OVER later WHEN 'contact' THEN min(CASE WHEN line <> '' AND NOT contact THEN i END) OVER later END, len(ls)) AS stop
  FROM k WINDOW o AS (PARTITION BY doc_id ORDER BY i), later AS (PARTITION BY doc_id ORDER BY i ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING)),
s AS (SELECT *, CASE kind WHEN '' THEN 1 WHEN 'heading' THEN CASE WHEN next_kind NOT IN ('', 'heading') AND NOT next_bullet AND next_words <= 8 THEN 2 ELSE 1 END
  WHEN 'paragraph' THEN stop - i ELSE len(list_filter(list_slice(ls, i + 1, stop), lambda x: x <> '')) END AS size FROM n),
chain AS (SELECT doc_id, CAST(0 AS BIGINT) AS i FROM l WHERE len(ls) > 0 UNION ALL SELECT c.doc_id, c.i + s.size FROM chain c JOIN s ON s.doc_id = c.doc_id AND s.i = c.i WHERE c.i + s.size < s.total),
b AS (SELECT doc_id, i, kind, array_to_string(CASE WHEN kind = 'heading' THEN list_slice(ls, i + 1, i + size) ELSE list_filter(list_slice(ls, i + 1, stop), lambda x: x <> '') END, ' / ') AS content
  FROM chain JOIN s USING (doc_id, i) WHERE kind <> '')"""

LY6 = f"""{_BLOCKS}
SELECT l.doc_id, coalesce(string_agg(kind || '@' || i || ':' || content, chr(10) ORDER BY i), '') AS blocks FROM l LEFT JOIN b USING (doc_id) GROUP BY l.doc_id"""
LY7 = f"""{_BLOCKS}
SELECT l.doc_id, coalesce(string_agg(content, '|' ORDER BY i) FILTER (kind = 'heading'), '') AS headings, CAST(count(*) FILTER (kind = 'bullet_group') AS INTEGER) AS bullet_groups FROM l LEFT JOIN b USING (doc_id) GROUP BY l.doc_id"""


def _first_words(x: str) -> str:
    words = D.words(x)
    return f"array_to_string(list_slice({words}, 1, 4), ' '), array_to_string(list_slice({words}, 5, 100000), ' ')"


_COLON = r"^([^:]+):\s*(.+)"
_part = lambda x, g: D.strip(f"regexp_extract({x}, '{_COLON}', {g})")
_reading = lambda cond, name, told, skip="false": f"CASE WHEN {cond} THEN [{{'name': {name}, 'told': {told}, 'skip': {skip}}}] ELSE [] END"
_split = lambda cond, x: "CASE WHEN " + cond + " THEN [{'name': " + _first_words(x).replace("), array", "), 'told': array", 1) + ", 'skip': false}] ELSE [] END"
_WORDS = D.n_words("line")
_TOLD = f"{D.n_words('inner_line')} >= 6"
_READINGS = [
    _reading(f"regexp_matches(line, '{_COLON}') AND {D.n_words(_part('line', 1))} BETWEEN 2 AND 5 AND {D.n_words(_part('line', 2))} >= 3", _part("line", 1), _part("line", 2)),
    _reading(f"marked AND regexp_matches(inner_line, '{_COLON}') AND {D.n_words(_part('inner_line', 1))} <= 5", _part("inner_line", 1), _part("inner_line", 2)),
    _split(f"marked AND NOT regexp_matches(inner_line, '{_COLON}') AND {_TOLD}", "inner_line"),
    _split(f"{_has('low', ly.RECOVERY_VERBS)} AND {_has('low', ly.RECOVERY_WORDS)} AND {_WORDS} >= 5", "line"),
    _reading(f"{_has('lower(following)', ly.RECOVERY_VERBS)} AND {_WORDS} <= 5 AND {D.n_words('following')} >= 4", "line", "following", "true"),
]
_CLEAN = D.strip(f"regexp_replace({D.strip(f"regexp_replace(r.name, '^[-•●▪◦►▸■□◆◇*\\s]+', '')")}, '[:\\s]+$', '')")

LY8 = f"""{_LINES},
f AS (SELECT doc_id, i, line, lower(line) AS low, coalesce(lead(line) OVER (PARTITION BY doc_id ORDER BY i), '') AS following, regexp_extract(line, '^{_BULLET}\\s*(.+)', 1) AS rest FROM e),
g AS (SELECT *, {D.strip('rest')} AS inner_line, rest <> '' AND ({_has('lower(rest)', ly.RECOVERY_VERBS)} OR {_has('lower(rest)', ly.RECOVERY_WORDS)}) AS marked FROM f WHERE length(line) >= 5 AND NOT {_has('low', ly.NO_PROJECT)}),
h AS (SELECT doc_id, i, list_concat(list_concat(list_concat(list_concat({_READINGS[0]}, {_READINGS[1]}), {_READINGS[2]}), {_READINGS[3]}), {_READINGS[4]}) AS readings FROM g),
c AS (SELECT doc_id, i, list_transform(readings, lambda r: {{'name': lower(r.name), 'clean': {_CLEAN}, 'told': r.told, 'skip': r.skip}}) AS readings,
  row_number() OVER (PARTITION BY doc_id ORDER BY i) AS n FROM h WHERE len(readings) > 0),
z AS (SELECT doc_id, CAST(1 AS BIGINT) AS n, CAST(-1 AS BIGINT) AS skipped, CAST([] AS VARCHAR[]) AS seen, CAST([] AS VARCHAR[]) AS made FROM (SELECT DISTINCT doc_id FROM c)
  UNION ALL
  SELECT doc_id, n + 1, CASE WHEN r.skip THEN i + 1 ELSE -1 END,
    CASE WHEN r IS NOT NULL AND lower(r.clean) NOT IN {_list(ly.PROJECT_HEADS)} THEN list_append(seen, lower(r.clean)) ELSE seen END,
    CASE WHEN r IS NOT NULL AND lower(r.clean) NOT IN {_list(ly.PROJECT_HEADS)} THEN list_append(made, r.clean || CASE WHEN r.told <> '' THEN ': ' || r.told ELSE '' END) ELSE made END
  FROM (SELECT z.*, c.i, CASE WHEN c.i <> z.skipped THEN list_filter(c.readings, lambda x: NOT list_contains(z.seen, x.name))[1] END AS r FROM z JOIN c ON c.doc_id = z.doc_id AND c.n = z.n))
SELECT l.doc_id, coalesce(array_to_string(made, '|'), '') AS recovered FROM l LEFT JOIN (SELECT doc_id, arg_max(made, n) AS made FROM z GROUP BY doc_id) USING (doc_id)"""
