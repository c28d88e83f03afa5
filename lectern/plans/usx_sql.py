"""The markup reader's queries on the sample, in SQL: tokens, running state and assembly from the files' text."""

from __future__ import annotations

from ..functions import text as tx
from ..sources import usx
from . import sample

_quoted = lambda s: "'" + s.replace("'", "''") + "'"
_collapse = lambda s: rf"trim(regexp_replace({s}, '[ \t\n\r\f]+', ' ', 'g'))"
_attribute = lambda name: rf"regexp_extract(tok, '\s{name}=\"([^\"]*)\"', 1)"


def _unescape(s: str) -> str:
    for name, c in (("lt", "<"), ("gt", ">"), ("quot", '"'), ("apos", "''"), ("amp", "&")):
        s = f"replace({s}, '&{name};', '{c}')"
    return s


def _clean(s: str) -> str:
    s = rf"regexp_replace(replace(replace({s}, '¶', ' '), '||', ' '), '\[\[|\]\]', '', 'g')"
    return _collapse(rf"regexp_replace({s}, '\[([^\[\]]*)\]', '\1', 'g')")


_filled = lambda event: f"coalesce(last_value({event} IGNORE NULLS) OVER w, '')"
_opens = lambda tag: f"(tag = '{tag}' AND NOT shut AND NOT empty)"
_depth = lambda tag: f"sum(CASE WHEN {_opens(tag)} THEN 1 WHEN tag = '{tag}' AND shut THEN -1 ELSE 0 END) OVER w"
_mark = lambda tag: f"CASE WHEN tag = '{tag}' AND sid <> '' THEN sid WHEN tag = '{tag}' AND eid <> '' THEN '' END"
_joined = lambda piece: f"string_agg({piece}, '' ORDER BY pos)"
_headings = ", ".join(map(_quoted, usx.HEADINGS))
_part = lambda i: rf"nullif(regexp_extract(trim(loc), '^(\w{{3}}) (\d+)(?::(\d+))?(?:-(?:(\d+):)?(\d+))?$', {i}), '')"
_number = lambda i: f"{_part(i)}::INTEGER"

BASE = rf"""
WITH f(version, value) AS (VALUES ('ONE', {_quoted(sample.FIRST)}), ('TWO', {_quoted(sample.SECOND)})),
p AS (SELECT version, regexp_replace(value, '^\x{{FEFF}}|\r', '', 'g') AS value FROM f),
b AS (SELECT version, regexp_extract(value, '<book\s[^>]*code="([^"]*)"', 1) AS book, regexp_extract_all(value, '<[^>]+>|[^<]+') AS toks FROM p),
t AS (SELECT version, book, (i - 1)::INTEGER AS pos, toks[i] AS tok FROM (SELECT *, unnest(range(1, len(toks) + 1)) AS i FROM b)),
e AS (SELECT *, regexp_extract(tok, '^</?([A-Za-z0-9]+)', 1) AS tag, starts_with(tok, '</') AS shut, ends_with(tok, '/>') AS empty, NOT starts_with(tok, '<') AS is_text,
        {_attribute('style')} AS style, {_attribute('sid')} AS sid, {_attribute('eid')} AS eid FROM t),
a AS (SELECT *, {_filled(_mark('verse'))} AS ref, {_filled(_mark('chapter'))} AS chapter_ref,
        {_filled(f"CASE WHEN {_opens('para')} THEN style WHEN tag = 'para' AND shut THEN '' END")} AS para_style,
        sum((tag = 'para' AND NOT shut)::INT) OVER w AS para_no, sum(({_opens('para')} AND style = 's1')::INT) OVER w AS section_no,
        sum({_opens('note')}::INT) OVER w AS note_no, {_depth('note')} AS note_depth, {_depth('char')} AS char_depth,
        first_value(CASE WHEN tag = 'verse' AND sid <> '' THEN sid END IGNORE NULLS) OVER (PARTITION BY version, book ORDER BY pos ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS ahead
      FROM e WINDOW w AS (PARTITION BY version, book ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
v AS (SELECT * FROM a WHERE is_text AND ref <> '' AND note_depth = 0 AND para_style NOT IN ({_headings})),
o AS (SELECT version, book, pos, char_depth AS level, style FROM a WHERE {_opens('char')}),
l AS (SELECT d.* EXCLUDE (style), o.style FROM (SELECT *, unnest(range(1, char_depth::BIGINT + 1)) AS level FROM a WHERE is_text AND char_depth > 0) d
      ASOF JOIN o ON d.version = o.version AND d.book = o.book AND d.level = o.level AND d.pos >= o.pos),
s AS (SELECT version, book, ref, regexp_extract(ref, '^(\w{{3}}) (\d+):(\d+)$', 2)::INTEGER AS chapter, regexp_extract(ref, '^(\w{{3}}) (\d+):(\d+)$', 3)::INTEGER AS verse,
        {_collapse(_unescape(_joined('tok')))} AS text_raw, count(DISTINCT para_no) FILTER ({_collapse('tok')} <> '')::INTEGER AS n_paras FROM v GROUP BY ALL),
r AS (SELECT version, book, pos, {_attribute('loc')} AS loc, ahead AS from_ref FROM a WHERE tag = 'ref' AND {_attribute('loc')} <> ''),
x AS (SELECT *, {_part(1)} AS t_book, {_number(2)} AS c1, {_number(3)} AS v1, coalesce({_number(4)}, CASE WHEN {_part(3)} IS NULL THEN {_number(5)} END, {_number(2)}) AS c2,
        CASE WHEN {_part(3)} IS NOT NULL THEN coalesce({_number(5)}, {_number(3)}) END AS v2 FROM r)
"""

VERSES = f"""{BASE}
SELECT version, book, nullif(list_position({list(tx.BOOKS)}, book), 0)::INTEGER AS book_no, chapter, verse, ref, {_clean('text_raw')} AS text, text_raw, n_paras FROM s"""
NOTES = f"""{BASE}
SELECT n.version, n.ref, n.pos, n.caller, replace({_collapse(_unescape("coalesce(fr, '')"))}, '.', ':') AS fr, {_collapse(_unescape("coalesce(ft, '')"))} AS ft
FROM (SELECT version, book, note_no, arg_min(ref, pos) AS ref, min(pos)::INTEGER AS pos, max({_attribute('caller')}) AS caller FROM a WHERE note_depth > 0 GROUP BY ALL) n
LEFT JOIN (SELECT version, book, note_no, string_agg(tok, '' ORDER BY pos) FILTER (style = 'fr') AS fr, string_agg(tok, '' ORDER BY pos) FILTER (style = 'ft') AS ft FROM l WHERE note_depth > 0 GROUP BY ALL) USING (version, book, note_no)"""
SPANS = f"""{BASE}
SELECT version, ref, pos, style, {_collapse(_unescape('tok'))} AS text FROM l WHERE ref <> '' AND note_depth = 0 AND para_style NOT IN ({_headings})"""
HEADINGS = f"""{BASE}
SELECT version, book, min(pos)::INTEGER AS pos, any_value(para_style) AS style, {_collapse(_unescape(_joined('tok')))} AS text, arg_min(ahead, pos) AS next_ref
FROM a WHERE para_style IN ('s1', 's2') AND is_text AND note_depth = 0 GROUP BY version, book, para_no"""
CROSSREFS = f"""{BASE}
SELECT *, n_verses > 0 AS resolved FROM (SELECT x.*, (SELECT count(*) FROM s WHERE s.version = x.version AND s.book = x.t_book AND (s.chapter, s.verse) >= (x.c1, coalesce(x.v1, 0)) AND (s.chapter, s.verse) <= (x.c2, coalesce(x.v2, 999)))::INTEGER AS n_verses FROM x)"""
PASSAGES = f"""{BASE},
k AS (SELECT *, CASE WHEN ref = lag(ref) OVER (PARTITION BY version, book ORDER BY pos) THEN tok ELSE ' ' || tok END AS run FROM v),
g AS (SELECT version, book, unnest(['section', 'paragraph', 'chapter']) AS grain, unnest([section_no::VARCHAR, para_no::VARCHAR, chapter_ref]) AS passage, ref, pos, run FROM k)
SELECT * FROM (SELECT version, book, grain, passage, arg_min(ref, pos) AS first_ref, {_clean(_unescape(_joined('run')))} AS text FROM g GROUP BY ALL) WHERE text <> ''"""
ALIGNED = f"""{BASE}
SELECT ref, max({_clean('text_raw')}) FILTER (version = 'ONE') AS "ONE", max({_clean('text_raw')}) FILTER (version = 'TWO') AS "TWO" FROM s GROUP BY ref"""
