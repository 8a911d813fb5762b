"""Pieces of SQL that say what the column functions and operators say, for other engines."""

from __future__ import annotations

from quillgraph.functions import text as X


def lit(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def lits(values) -> str:
    return ", ".join(map(lit, values))


def sub(x: str, pattern: str, to: str = "") -> str:
    return f"regexp_replace({x}, {lit(pattern)}, {lit(to)}, 'g')"


def strip(x: str) -> str:
    return sub(x, f"^[{X.WS}]+|[{X.WS}]+$")


def collapse(x: str) -> str:
    return sub(x, f"[{X.WS}]+", " ")


def words(x: str) -> str:
    return f"list_filter(string_split_regex({x}, {lit(f'[{X.WS}]+')}), lambda w: w <> '')"


def name_key(x: str) -> str:
    inner = collapse(f"lower({strip(f'''replace(coalesce({x}, ''), chr(65533), '-')''')})")
    return strip(sub(sub(inner, f"^[{X.TRIM}]+|[{X.TRIM}]+$"), f"^(the|a|an)[{X.WS}]+"))


def keyword_key(x: str) -> str:
    inner = strip(collapse(f"coalesce({x}, '')"))
    return sub(f"replace(lower({inner}), chr(65533), '-')", f"^[{X.TRIM_KEYWORD}]+|[{X.TRIM_KEYWORD}]+$")


def relation_key(x: str) -> str:
    inner = collapse(f"lower({strip(f'''coalesce({x}, '')''')})")
    return sub(inner, f"^[{X.TRIM}]+|[{X.TRIM}]+$")


def usable(key: str) -> str:
    """Condition on a name's key."""
    w = words(key)
    phrases = " OR ".join(f"contains({key}, {lit(p)})" for p in X.NOISE_PHRASES)
    count = lambda v: f"len(list_filter({w}, lambda w: w IN ({lits(v)})))"
    return (
        f"(NOT (length({key}) < 2 OR {phrases} OR len({w}) > 6 OR (len({w}) >= 5 AND {count(X.DESCRIPTOR_WORDS)} > 0)"
        f" OR (len({w}) > 1 AND coalesce(({w})[1] IN ({lits(X.BAD_FIRST_WORDS)}), false)) OR (len({w}) >= 3 AND {count(X.NOISE_WORDS)} >= 2)) AND regexp_matches({key}, '[a-z]'))"
    )


def accepted(key: str) -> str:
    """Condition on a keyword's key."""
    w = f"list_distinct({words(key)})"
    count = lambda v: f"len(list_filter({w}, lambda w: w IN ({lits(v)})))"
    return (
        f"(NOT (length({key}) < 3 OR len({words(key)}) > 6 OR (len({w}) = 1 AND {count(X.KEYWORD_NOISE)} = 1) OR {count(X.KEYWORD_FORM)} > 0"
        f" OR ({count(['schedule'])} > 0 AND {count(['service', 'routine'])} = 0) OR (len({w}) >= 2 AND {count(X.KEYWORD_NOISE)} >= 2) OR regexp_full_match({key}, '[^\\pL\\pM\\pPc_]+')) AND {usable(name_key(key))})"
    )


def has_name(name: str, low: str) -> str:
    return f"(contains({low}, {name}) AND (contains({name}, ' ') OR regexp_matches({low}, '(^|[^a-z0-9])' || regexp_escape({name}) || '($|[^a-z0-9])')))"


def occurrences(name: str, low: str) -> str:
    """Occurrences that don't overlap; marks are doubled so that two neighbours don't share one."""
    double = lambda x: sub(x, "([^a-z0-9])", r"\1\1")
    word = f"len(regexp_extract_all({double(low)}, '(^|[^a-z0-9])' || regexp_escape({double(name)}) || '($|[^a-z0-9])'))"
    phrase = f"((length({low}) - length(replace({low}, {name}, ''))) // length({name}))"
    return f"CASE WHEN contains({name}, ' ') THEN {phrase} ELSE {word} END"


DOCS = "docs AS (SELECT DISTINCT doc_id, text FROM parsed WHERE doc_id IS NOT NULL AND text IS NOT NULL)"
PARAGRAPHS = (
    DOCS
    + f""", paras0 AS (SELECT doc_id, unnest(l) AS p, generate_subscripts(l, 1) AS i FROM (SELECT doc_id, string_split_regex(text, {lit(chr(92) + 'n[' + X.WS + ']*' + chr(92) + 'n')}) AS l FROM docs)),
paras1 AS (SELECT doc_id, {strip('p')} AS text, i FROM paras0),
paras AS (SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY i) - 1 AS INTEGER) AS paragraph_index, text FROM paras1 WHERE text <> '')"""
)
UNITS = (
    PARAGRAPHS
    + f""", frag0 AS (SELECT doc_id, paragraph_index, unnest(l) AS f, generate_subscripts(l, 1) AS i FROM (
  SELECT doc_id, paragraph_index, string_split({sub(sub('text', f'([.!?])[{X.WS}]+', chr(92) + '1' + chr(1)), chr(92) + 'n+', chr(1))}, chr(1)) AS l FROM paras)),
frag AS (SELECT doc_id, paragraph_index, i, {strip('f')} AS text FROM frag0 WHERE {strip('f')} <> ''),
kept AS (SELECT * FROM frag WHERE NOT (regexp_matches(text, {lit(X.NOISE_LINE)}) AND len({words('text')}) <= 6)),
units AS (SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY paragraph_index, i) - 1 AS INTEGER) AS unit_ord, paragraph_index,
  CAST(row_number() OVER (PARTITION BY doc_id, paragraph_index ORDER BY i) - 1 AS INTEGER) AS sentence_index, text, CAST(count(*) OVER (PARTITION BY doc_id) AS INTEGER) AS n_units FROM kept)"""
)
NAMES = f"""cand0 AS (SELECT DISTINCT doc_id, {keyword_key('name')} AS name FROM keywords),
cand AS (SELECT * FROM cand0 WHERE length(name) >= 3 AND NOT regexp_full_match(name, '[^\\pL\\pM\\pPc_]+') AND {usable(name_key('name'))})"""
MENTIONS = UNITS + ", " + NAMES + f""", mentions AS (SELECT u.doc_id, u.unit_ord, u.paragraph_index, c.name FROM units u JOIN cand c ON u.doc_id = c.doc_id WHERE {has_name('c.name', 'lower(u.text)')})"""
SUPPORT = MENTIONS + """, sent AS (SELECT a.doc_id, a.name AS a, b.name AS b, count(*) AS n FROM mentions a JOIN mentions b ON a.doc_id = b.doc_id AND a.unit_ord = b.unit_ord AND a.name < b.name GROUP BY ALL),
nu AS (SELECT DISTINCT doc_id, n_units FROM units),
winm AS (SELECT DISTINCT doc_id, start, name FROM (SELECT m.doc_id, m.name, unnest([m.unit_ord - 1, m.unit_ord]) AS start, n_units FROM mentions m JOIN nu ON m.doc_id = nu.doc_id) WHERE start >= 0 AND start <= n_units - 2),
winp AS (SELECT a.doc_id, a.start, a.name AS a, b.name AS b FROM winm a JOIN winm b ON a.doc_id = b.doc_id AND a.start = b.start AND a.name < b.name),
win AS (SELECT doc_id, a, b, least(3, count(*)) AS n FROM winp GROUP BY ALL),
pm AS (SELECT DISTINCT doc_id, paragraph_index, name FROM mentions),
pfew AS (SELECT doc_id, paragraph_index FROM pm GROUP BY ALL HAVING count(*) <= 8),
pk AS (SELECT pm.* FROM pm JOIN pfew USING (doc_id, paragraph_index)),
parap AS (SELECT a.doc_id, a.paragraph_index, a.name AS a, b.name AS b FROM pk a JOIN pk b ON a.doc_id = b.doc_id AND a.paragraph_index = b.paragraph_index AND a.name < b.name),
para AS (SELECT doc_id, a, b, count(*) AS n FROM parap GROUP BY ALL)"""
SCORES = SUPPORT + """, allp AS (SELECT doc_id, a, b FROM sent UNION SELECT doc_id, a, b FROM win UNION SELECT doc_id, a, b FROM para),
sc AS (SELECT p.doc_id, p.a, p.b, coalesce(s.n, 0) AS s, coalesce(w.n, 0) AS w, coalesce(q.n, 0) AS q, n_units FROM allp p JOIN nu USING (doc_id) LEFT JOIN sent s USING (doc_id, a, b) LEFT JOIN win w USING (doc_id, a, b) LEFT JOIN para q USING (doc_id, a, b)),
scored AS (SELECT doc_id, a AS source, b AS target, 4 * s + 2 * w + q AS weight, s + w + q AS support_count, s AS sentence_support, w AS window_support, q AS paragraph_support FROM sc
  WHERE 4 * s + 2 * w + q >= 2 AND (s > 0 OR w >= CASE WHEN n_units <= 20 THEN 1 ELSE 2 END OR q >= 2))"""
NODES = "nodes AS (SELECT DISTINCT * FROM graph_nodes)"
LINKS = "links AS (SELECT DISTINCT * FROM graph_links)"
#: Raw edges of the tables: links with the names of their ends, in the order of their ids.
RAW_EDGES = NODES + ", " + LINKS + """, raw AS (SELECT l.doc_id, row_number() OVER (PARTITION BY l.doc_id ORDER BY l.id) AS ord, s.name AS source, t.name AS target, l.relation, l.original_relation, l.direction, l.kind, l.provenance AS tags, l.tag, l.weight, l.snippet
  FROM links l JOIN nodes s ON l.doc_id = s.doc_id AND l.source = s.id JOIN nodes t ON l.doc_id = t.doc_id AND l.target = t.id)"""
