"""Queries over the test tables, each with the same question in SQL where SQL can ask it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillgraph.functions import text as X
from quillgraph.functions.reuse import reused
from quillgraph.operators import graph as G
from quillgraph.operators import keywords as K
from quillgraph.operators import locality as L
from quillgraph.operators import merge as M
from quillgraph.operators import query as Q
from quillgraph.operators import selection as S
from quillgraph.operators import units as U
from quillgraph.sources import catalog, documents, export

from . import sql as W
from . import tables as T
from .pipeline import build

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}


def _add(name: str, fn: Query, sql: str | None = None) -> None:
    _QUERIES[name] = fn
    if sql:
        _SQL[name] = sql


def queries() -> dict[str, Query]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)


def flagship(spark: SparkSession, d: str) -> DataFrame:
    """Pairs of keywords by how near they stand in their documents."""
    return _QUERIES["pair_scores"](spark, d)


# Text functions.
_add(
    "text_cleanup",
    lambda s, d: T.docs(s, d).select("doc_id", X.cleanup(F.col("text")).alias("t")).select("doc_id", F.char_length("t").alias("chars"), F.md5("t").alias("digest")),
    f"WITH {W.DOCS}, c AS (SELECT doc_id, {W.strip(W.sub(W.sub('text', chr(91) + ' ' + chr(92) + 't]+' + chr(92) + 'n', chr(10)), chr(92) + 'n{3,}', chr(10) * 2))} AS t FROM docs) SELECT doc_id, CAST(length(t) AS INTEGER) AS chars, md5(t) AS digest FROM c",
)
_add("word_count", lambda s, d: T.docs(s, d).select("doc_id", X.word_count(F.col("text")).alias("words")), f"WITH {W.DOCS} SELECT doc_id, CAST(len({W.words('text')}) AS INTEGER) AS words FROM docs")
_add(
    "normalize_name",
    lambda s, d: T.table(s, d, "graph_nodes").select("name").distinct().select("name", X.normalize_name(F.col("name")).alias("key")),
    f"SELECT name, {W.name_key('name')} AS key FROM (SELECT DISTINCT name FROM graph_nodes)",
)
_add(
    "normalize_keyword",
    lambda s, d: T.table(s, d, "graph_nodes").select("name").distinct().select("name", X.normalize_keyword(F.col("name")).alias("key")),
    f"SELECT name, {W.keyword_key('name')} AS key FROM (SELECT DISTINCT name FROM graph_nodes)",
)
_add(
    "usable_entity",
    lambda s, d: T.table(s, d, "graph_nodes").select("name").distinct().select("name", X.usable_name(F.col("name")).alias("usable")),
    f"SELECT name, {W.usable('key')} AS usable FROM (SELECT DISTINCT name, {W.name_key('name')} AS key FROM graph_nodes)",
)
_add(
    "keyword_acceptance",
    lambda s, d: T.table(s, d, "keywords").select("name").distinct().select("name", X.keyword_accepted(F.col("name")).alias("accepted")),
    f"SELECT name, {W.accepted('key')} AS accepted FROM (SELECT DISTINCT name, {W.keyword_key('name')} AS key FROM keywords)",
)
_KEYS = ", ".join(f"({W.lit(label)}, {W.lit(k)})" for k, labels in X.RELATION_KEYS.items() for label in labels)
_LABELS = ", ".join(f"({W.lit(k)}, {W.lit(v)})" for k, v in X.RELATION_LABELS.items())
_CANON = f"""rk(label, k) AS (VALUES {_KEYS}), rl(k, shown) AS (VALUES {_LABELS}),
rel0 AS (SELECT DISTINCT original_relation AS label FROM graph_links UNION SELECT DISTINCT relation FROM graph_links),
rel1 AS (SELECT label, {W.relation_key('label')} AS n FROM rel0 WHERE label IS NOT NULL), rel2 AS (SELECT *, {W.strip(W.collapse("translate(n, '_/', '  ')"))} AS token FROM rel1),
canon AS (SELECT rel2.label, coalesce(shown, n) AS relation, coalesce(rk.k, {W.sub(W.sub('token', '[^a-z0-9]+', '_'), '^_+|_+$')}) AS relation_key,
  CASE WHEN left({W.strip('rel2.label')}, 120) = '' THEN coalesce(shown, n) ELSE left({W.strip('rel2.label')}, 120) END AS original_relation, token IN ({W.lits(X.SWAPPED)}) AS swap
  FROM rel2 LEFT JOIN rk ON rk.label = token LEFT JOIN rl ON rl.k = rk.k WHERE regexp_matches(n, '[a-z0-9]'))"""


def _relation_canonical(s: SparkSession, d: str) -> DataFrame:
    l = T.table(s, d, "graph_links")
    labels = l.select(F.col("original_relation").alias("label")).union(l.select("relation")).where("label is not null").distinct()
    return labels.select("label", X.canonical_relation(F.col("label")).alias("c")).where("c is not null").select("label", "c.*")


_add("relation_canonical", _relation_canonical, f"WITH {_CANON} SELECT label, relation, relation_key, original_relation, swap FROM canon")
_add(
    "sentence_units",
    lambda s, d: U.units(T.docs(s, d)).select("doc_id", "unit_ord", "paragraph_index", "sentence_index", F.md5("text").alias("digest"), "n_units"),
    f"WITH {W.UNITS} SELECT doc_id, unit_ord, paragraph_index, sentence_index, md5(text) AS digest, n_units FROM units",
)
_add("paragraphs", lambda s, d: U.paragraph_rows(T.docs(s, d)).select("doc_id", "paragraph_index", F.md5("text").alias("digest")), f"WITH {W.PARAGRAPHS} SELECT doc_id, paragraph_index, md5(text) AS digest FROM paras")
_add(
    "sentence_split_strict",
    lambda s, d: U.paragraph_rows(T.docs(s, d)).select("doc_id", "paragraph_index", F.posexplode(X.strict_sentences(F.col("text"))).alias("pos", "t")).select("doc_id", "paragraph_index", "pos", F.md5("t").alias("digest")),
    f"""WITH {W.PARAGRAPHS}, s AS (SELECT doc_id, paragraph_index, string_split({W.sub('text', f"([.!?])[{X.WS}]+([A-Z0-9" + chr(34) + "'(])", chr(92) + '1' + chr(1) + chr(92) + '2')}, chr(1)) AS l FROM paras)
SELECT doc_id, paragraph_index, CAST(i - 1 AS INTEGER) AS pos, md5(t) AS digest FROM (SELECT doc_id, paragraph_index, unnest(l) AS t, generate_subscripts(l, 1) AS i FROM s)""",
)
_add(
    "noise_lines",
    lambda s, d: T.docs(s, d).select("doc_id", F.explode(F.split("text", "\n")).alias("line")).where(X.noise_line(X.ustrip(F.col("line")))).groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")),
    f"WITH {W.DOCS}, l AS (SELECT doc_id, {W.strip('line')} AS line FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM docs)) SELECT doc_id, count(*) AS n FROM l WHERE regexp_matches(line, {W.lit(X.NOISE_LINE)}) AND len({W.words('line')}) <= 6 GROUP BY doc_id",
)


# Paragraphs as chunks.
def _chunks(s: SparkSession, d: str) -> DataFrame:
    return U.paragraph_rows(T.docs(s, d)).withColumnRenamed("paragraph_index", "chunk_index")


_TOKENS = W.PARAGRAPHS + """, tok AS (SELECT doc_id, paragraph_index AS chunk_index, text, list_transform(regexp_extract_all(text, '[A-Za-z][A-Za-z0-9_-]{2,}'), lambda t: lower(t)) AS t FROM paras)"""
_DF = _TOKENS + """, each AS (SELECT DISTINCT doc_id, chunk_index, unnest(t) AS token FROM tok), dfreq AS (SELECT doc_id, token, count(*) AS df FROM each GROUP BY ALL)"""
_HEAD = f"len(list_filter(list_slice(string_split(text, chr(10)), 1, 5), lambda x: regexp_matches({W.strip('x')}, {W.lit(X.HEADING)}))) > 0"
_SCORE = _DF + f""", rare AS (SELECT doc_id, chunk_index, sum(1.0 / df) AS rare FROM each JOIN dfreq USING (doc_id, token) GROUP BY ALL),
score AS (SELECT doc_id, chunk_index, CASE WHEN len(t) = 0 THEN 0.0 ELSE round(rare / greatest(1.0, sqrt(len(t))) + CASE WHEN {_HEAD} THEN 1.0 ELSE 0.0 END + 0.15 * least(1.0, len(t) / 350.0), 9) END AS score FROM tok LEFT JOIN rare USING (doc_id, chunk_index))"""
_SECT = _SCORE + """, s1 AS (SELECT *, CAST(count(*) OVER (PARTITION BY doc_id) AS INTEGER) AS total FROM score),
s2 AS (SELECT *, CASE WHEN total <= 12 THEN total ELSE least(total, greatest(1, least(250, greatest(12, CAST(ceil(total * 0.35) AS INTEGER))))) END AS target FROM s1),
s3 AS (SELECT *, least(target, greatest(1, CAST(round(sqrt(total)) AS INTEGER))) AS sections FROM s2),
s4 AS (SELECT *, CAST(((chunk_index + 1) * sections - 1) // total AS INTEGER) AS section FROM s3)"""
_SEL = _SECT + """, s5 AS (SELECT *, row_number() OVER (PARTITION BY doc_id, section ORDER BY score DESC, chunk_index) = 1 AS cover FROM s4),
s6 AS (SELECT *, sum(CAST(cover AS INTEGER)) OVER (PARTITION BY doc_id) AS covered, row_number() OVER (PARTITION BY doc_id, cover ORDER BY score DESC, chunk_index) AS rn FROM s5)"""
_add("doc_frequency", lambda s, d: S.document_frequency(_chunks(s, d)), f"WITH {_DF} SELECT doc_id, token, df FROM dfreq")
_add("chunk_scores", lambda s, d: S.chunk_scores(_chunks(s, d)).withColumn("score", F.round("score", 6)), f"WITH {_SCORE} SELECT doc_id, chunk_index, round(score, 6) AS score FROM score")
_add("section_cover", lambda s, d: S.sections(S.chunk_scores(_chunks(s, d))).select("doc_id", "chunk_index", "total", "target", "sections", "section"), f"WITH {_SECT} SELECT doc_id, chunk_index, total, target, sections, section FROM s4")
_add(
    "chunk_select",
    lambda s, d: S.select_chunks(S.chunk_scores(_chunks(s, d))).select("doc_id", "chunk_index", "selected", "total"),
    f"WITH {_SEL} SELECT doc_id, chunk_index, (target = total OR cover OR rn <= target - covered) AS selected, total FROM s6",
)
_add("heading_flags", lambda s, d: _chunks(s, d).select("doc_id", "chunk_index", X.has_heading(F.col("text")).alias("heading")), f"WITH {W.PARAGRAPHS} SELECT doc_id, paragraph_index AS chunk_index, {_HEAD} AS heading FROM paras")


def _target_count(s: SparkSession, d: str) -> DataFrame:
    total = U.paragraph_rows(T.docs(s, d)).groupBy("doc_id").agg(F.count(F.lit(1)).cast("int").alias("total"))
    modes = F.explode(F.array(*map(F.lit, ("fast", "balanced", "full")))).alias("mode")
    return total.select("doc_id", "total", modes).select("doc_id", "mode", X.target_count(F.col("total"), F.col("mode")).alias("target"))


_add(
    "target_count",
    _target_count,
    f"""WITH {W.PARAGRAPHS}, t AS (SELECT doc_id, CAST(count(*) AS INTEGER) AS total FROM paras GROUP BY doc_id), m AS (SELECT *, unnest(['fast', 'balanced', 'full']) AS mode FROM t)
SELECT doc_id, mode, CASE WHEN mode = 'full' OR total <= 12 THEN total ELSE least(total, greatest(1, least(250, greatest(12, CAST(ceil(total * CASE WHEN mode = 'fast' THEN 0.2 ELSE 0.35 END) AS INTEGER))))) END AS target FROM m""",
)


# Names in documents.
def _cand(s: SparkSession, d: str) -> DataFrame:
    return U.candidate_names(T.table(s, d, "keywords"))


def _units(s: SparkSession, d: str) -> DataFrame:
    return reused(U.units(T.docs(s, d)))


def _held(s: SparkSession, d: str, u: DataFrame | None = None) -> DataFrame:
    """Units with their names; several supports read them."""
    return reused(U.held_names(U.units(T.docs(s, d)) if u is None else u, _cand(s, d)))


def _pair_evidence(s: SparkSession, d: str) -> DataFrame:
    u = _units(s, d)
    return L.pair_evidence(_held(s, d, u), u)


_add("candidate_names", _cand, f"WITH {W.NAMES} SELECT doc_id, name FROM cand")
_add("keyword_counts", lambda s, d: U.keyword_counts(T.docs(s, d), _cand(s, d)), f"WITH {W.DOCS}, {W.NAMES} SELECT c.doc_id, name, CAST({W.occurrences('name', 'lower(text)')} AS BIGINT) AS n FROM cand c JOIN docs USING (doc_id)")
_add("mentions", lambda s, d: U.mentions(U.held_names(U.units(T.docs(s, d)), _cand(s, d))), f"WITH {W.MENTIONS} SELECT doc_id, unit_ord, paragraph_index, name FROM mentions")
_add("doc_name_semi", lambda s, d: U.names_in_documents(T.docs(s, d), _cand(s, d)), f"WITH {W.DOCS}, {W.NAMES} SELECT DISTINCT c.doc_id, name FROM cand c JOIN docs USING (doc_id) WHERE {W.has_name('name', 'lower(text)')}")
_add(
    "cooccurrence_chunks",
    lambda s, d: U.chunk_cooccurrence(_chunks(s, d), _cand(s, d)),
    f"WITH {W.PARAGRAPHS}, {W.NAMES}, h AS (SELECT p.doc_id, paragraph_index AS i, name FROM paras p JOIN cand c ON p.doc_id = c.doc_id WHERE {W.has_name('name', 'lower(text)')}) SELECT a.doc_id, a.name AS source, b.name AS target, count(*) AS weight FROM h a JOIN h b ON a.doc_id = b.doc_id AND a.i = b.i AND a.name < b.name GROUP BY ALL HAVING count(*) >= 2",
)
_add("support_sentence", lambda s, d: L.sentence_support(_held(s, d)), f"WITH {W.SUPPORT} SELECT doc_id, a, b, n FROM sent")
_add("support_window", lambda s, d: L.window_support(_held(s, d)), f"WITH {W.SUPPORT} SELECT doc_id, a, b, n FROM win")
_add("support_paragraph", lambda s, d: L.paragraph_support(_held(s, d)), f"WITH {W.SUPPORT} SELECT doc_id, a, b, n FROM para")
_add("pair_scores", lambda s, d: L.pair_scores(_held(s, d)), f"WITH {W.SCORES} SELECT * FROM scored")
_EVID = W.SUPPORT + f""", ptext AS (SELECT doc_id, paragraph_index, string_agg(text, ' ' ORDER BY sentence_index) AS text FROM units GROUP BY ALL),
ev0 AS (SELECT m.doc_id, m.name AS a, n.name AS b, u.paragraph_index, u.sentence_index, u.text FROM mentions m JOIN mentions n ON m.doc_id = n.doc_id AND m.unit_ord = n.unit_ord AND m.name < n.name JOIN units u ON u.doc_id = m.doc_id AND u.unit_ord = m.unit_ord
UNION ALL SELECT w.doc_id, w.a, w.b, u.paragraph_index, u.sentence_index, u.text || ' ' || v.text FROM winp w JOIN units u ON u.doc_id = w.doc_id AND u.unit_ord = w.start JOIN units v ON v.doc_id = w.doc_id AND v.unit_ord = w.start + 1
UNION ALL SELECT p.doc_id, p.a, p.b, p.paragraph_index, 0, t.text FROM parap p JOIN ptext t USING (doc_id, paragraph_index)),
ev1 AS (SELECT DISTINCT doc_id, a, b, paragraph_index, sentence_index, left({W.strip('text')}, 300) AS text FROM ev0),
ev2 AS (SELECT *, row_number() OVER (PARTITION BY doc_id, a, b ORDER BY paragraph_index, sentence_index, text) AS rn FROM ev1)"""
_add(
    "pair_evidence",
    lambda s, d: _pair_evidence(s, d).select("doc_id", "source", "target", F.posexplode("evidence").alias("i", "e")).select("doc_id", "source", "target", "i", "e.paragraph_index", "e.sentence_index", F.md5("e.text").alias("digest")),
    f"WITH {_EVID} SELECT doc_id, a AS source, b AS target, CAST(rn - 1 AS INTEGER) AS i, paragraph_index, sentence_index, md5(text) AS digest FROM ev2 WHERE rn <= 3",
)
_add("links_capped", lambda s, d: L.greedy_links(L.pair_scores(_held(s, d))))
_LLM = f"llm AS (SELECT DISTINCT doc_id, {W.keyword_key('name')} AS llm FROM graph_nodes WHERE list_contains(sources, 'llm'))"
_add(
    "keyword_anti_llm",
    lambda s, d: U.without_llm_names(T.keywords(s, d).select("doc_id", "rank", "name"), T.table(s, d, "graph_nodes").where(F.array_contains("sources", "llm"))),
    f"WITH {_LLM} SELECT doc_id, rank, name FROM (SELECT DISTINCT doc_id, rank, name FROM keywords) k WHERE NOT EXISTS (SELECT 1 FROM llm o WHERE o.doc_id = k.doc_id AND o.llm <> '' AND (contains(k.name, o.llm) OR contains(o.llm, k.name)))",
)


# Merging.
_RAWE = W.NODES + f""", rawe AS (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY id) AS ord, name, type, snippet, sources[1] AS source FROM nodes
UNION ALL SELECT DISTINCT doc_id, 1099511627776 + rank, name, 'keyword', '', source FROM keywords),
ke AS (SELECT doc_id, ord, {W.name_key('name')} AS key, {W.strip("coalesce(name, '')")} AS name, coalesce(type, 'concept') AS type, snippet, source FROM rawe),
kk AS (SELECT * FROM ke WHERE key <> ''),
nm AS (SELECT doc_id, key, name FROM (SELECT doc_id, key, name, row_number() OVER (PARTITION BY doc_id, key ORDER BY count(*) DESC, min(ord)) AS rn FROM kk GROUP BY doc_id, key, name) WHERE rn = 1),
ty AS (SELECT doc_id, key, type FROM (SELECT doc_id, key, type, row_number() OVER (PARTITION BY doc_id, key ORDER BY count(*) DESC, min(ord)) AS rn FROM kk GROUP BY doc_id, key, type) WHERE rn = 1),
sr AS (SELECT doc_id, key, string_agg(source, '|' ORDER BY o) AS sources FROM (SELECT doc_id, key, source, min(ord) AS o FROM kk WHERE source IS NOT NULL GROUP BY ALL) GROUP BY ALL),
bs AS (SELECT doc_id, key, count(*) AS n, arg_min(snippet, ord) FILTER (WHERE coalesce(snippet, '') <> '') AS snippet FROM kk GROUP BY ALL),
ent AS (SELECT doc_id, key, name, type, coalesce(snippet, '') AS snippet, coalesce(sources, '') AS sources, n AS count FROM bs JOIN nm USING (doc_id, key) JOIN ty USING (doc_id, key) LEFT JOIN sr USING (doc_id, key))"""
_add("merge_entities", lambda s, d: M.merge_entities(T.raw_entities(s, d)).withColumn("sources", F.concat_ws("|", "sources")), f"WITH {_RAWE} SELECT doc_id, key, name, type, snippet, sources, count FROM ent")


def _llm_keys(s: SparkSession, d: str) -> DataFrame:
    """Keys of the entities that keywords name; nodes beyond them are ends to be materialised."""
    return T.keywords(s, d).select("doc_id", X.normalize_name(F.col("name")).alias("key")).distinct()


_KKEYS = f"kkeys AS (SELECT DISTINCT doc_id, {W.name_key('name')} AS key FROM keywords)"
_add(
    "endpoint_materialize",
    lambda s, d: M.materialized_endpoints(M.usable_edges(T.raw_edges(s, d)), _llm_keys(s, d)).select("doc_id", "ord", "name", "type", "snippet", "source"),
    f"""WITH {W.RAW_EDGES}, {_KKEYS}, ok AS (SELECT * FROM raw WHERE {W.usable(W.name_key('source'))} AND {W.usable(W.name_key('target'))}),
e AS (SELECT doc_id, ord * 2 AS ord, source AS name, snippet FROM ok UNION ALL SELECT doc_id, ord * 2 + 1, target, snippet FROM ok), k AS (SELECT *, {W.name_key('name')} AS key FROM e),
m AS (SELECT * FROM k WHERE key <> '' AND NOT EXISTS (SELECT 1 FROM kkeys q WHERE q.doc_id = k.doc_id AND q.key = k.key))
SELECT doc_id, ord, name, 'concept' AS type, coalesce(snippet, '') AS snippet, 'llm' AS source FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, key ORDER BY ord) AS rn FROM m) WHERE rn = 1""",
)
_CANEDGE = W.RAW_EDGES + ", " + _CANON + f""", ce0 AS (SELECT raw.doc_id, ord, {W.name_key('raw.source')} AS src, {W.name_key('raw.target')} AS tgt, c.relation, c.relation_key, c.original_relation AS own, c.swap, raw.original_relation, lower(coalesce(direction, '')) AS d, lower(coalesce(kind, '')) AS k, tags, tag, weight, snippet
  FROM raw JOIN canon c ON c.label = raw.relation),
ce1 AS (SELECT *, CASE WHEN d IN ('directed', 'undirected') THEN d WHEN relation_key = 'associated_with' OR d = 'undirected' OR k = 'association' THEN 'undirected' ELSE 'directed' END AS dir FROM ce0 WHERE src <> '' AND tgt <> '' AND src <> tgt),
ce AS (SELECT doc_id, ord, CASE WHEN (swap AND dir = 'directed') OR (dir = 'undirected' AND tgt < src) THEN tgt ELSE src END AS source, CASE WHEN (swap AND dir = 'directed') OR (dir = 'undirected' AND tgt < src) THEN src ELSE tgt END AS target,
  relation, relation_key, CASE WHEN coalesce(original_relation, '') <> '' THEN left(original_relation, 120) ELSE own END AS original_relation, dir AS direction,
  CASE WHEN dir = 'undirected' THEN 'association' WHEN k IN ('assertion', 'association') THEN k ELSE 'assertion' END AS kind, greatest(1, coalesce(weight, 1)) AS weight, snippet,
  flatten(list_transform(coalesce(tags, []) || CASE WHEN tag IS NULL THEN [] ELSE [tag] END, lambda t: CASE WHEN t = 'both' THEN ['llm', 'cooccurrence'] ELSE [t] END)) AS tags FROM ce1)"""
_add(
    "canonical_edges",
    lambda s, d: M.canonical_edges(T.raw_edges(s, d)).select("doc_id", "ord", "source", "target", "relation", "relation_key", "original_relation", "direction", "kind", "weight", F.concat_ws("|", F.array_sort("tags")).alias("tags")),
    f"WITH {_CANEDGE} SELECT doc_id, ord, source, target, relation, relation_key, original_relation, direction, kind, weight, array_to_string(CASE WHEN len(tags) = 0 THEN ['llm'] ELSE list_sort(list_distinct(list_filter(tags, lambda t: t <> ''))) END, '|') AS tags FROM ce",
)
_add(
    "endpoint_support",
    lambda s, d: M.endpoint_support(M.canonical_edges(T.raw_edges(s, d)), _llm_keys(s, d)).select("doc_id", "ord", "endpoint_support"),
    f"WITH {_CANEDGE}, {_KKEYS} SELECT ce.doc_id, ord, (CAST(a.key IS NOT NULL AS INTEGER) + CAST(b.key IS NOT NULL AS INTEGER)) / 2.0 AS endpoint_support FROM ce LEFT JOIN kkeys a ON a.doc_id = ce.doc_id AND a.key = ce.source LEFT JOIN kkeys b ON b.doc_id = ce.doc_id AND b.key = ce.target",
)
_MERGED = _CANEDGE + ", " + _KKEYS + f""", ct AS (SELECT doc_id, source, target, relation_key, direction, ord, CASE WHEN len(tags) = 0 THEN ['llm'] ELSE list_filter(tags, lambda t: t <> '') END AS tags FROM ce),
tg0 AS (SELECT doc_id, source, target, relation_key, direction, ord, unnest(tags) AS v, generate_subscripts(tags, 1) AS i FROM ct),
tg AS (SELECT doc_id, source, target, relation_key, direction, list(v ORDER BY o, i) AS tags FROM (SELECT doc_id, source, target, relation_key, direction, v, min(ord) AS o, arg_min(i, ord * 100 + i) AS i FROM tg0 GROUP BY ALL) GROUP BY ALL),
al AS (SELECT doc_id, source, target, relation_key, direction, string_agg(v, '|' ORDER BY o) AS aliases FROM (SELECT doc_id, source, target, relation_key, direction, original_relation AS v, min(ord) AS o FROM ce GROUP BY ALL) GROUP BY ALL),
sn0 AS (SELECT ce.doc_id, ce.source, ce.target, ce.relation_key, ce.direction, left({W.strip('snippet')}, 300) AS v, min(ord) AS o, arg_min(CASE WHEN list_contains(ce.tags, 'cooccurrence') AND NOT list_contains(ce.tags, 'llm') THEN 'cooccurrence' ELSE 'llm' END, ord) AS s0
  FROM ce WHERE coalesce(snippet, '') <> '' AND left({W.strip('snippet')}, 300) <> '' GROUP BY ce.doc_id, ce.source, ce.target, ce.relation_key, ce.direction, left({W.strip('snippet')}, 300), CASE WHEN list_contains(ce.tags, 'cooccurrence') AND NOT list_contains(ce.tags, 'llm') THEN 'cooccurrence' ELSE 'llm' END),
sn AS (SELECT doc_id, source, target, relation_key, direction, least(8, count(*)) AS ev, arg_min(v, o) AS snippet FROM sn0 GROUP BY ALL),
mg AS (SELECT ce.doc_id, ce.source, ce.target, ce.relation_key, ce.direction, arg_min(relation, ord) AS relation, arg_min(original_relation, ord) AS original_relation, arg_min(kind, ord) AS kind, CAST(sum(weight) AS BIGINT) AS weight, count(*) AS support,
  avg((CAST(a.key IS NOT NULL AS INTEGER) + CAST(b.key IS NOT NULL AS INTEGER)) / 2.0) AS eps FROM ce LEFT JOIN kkeys a ON a.doc_id = ce.doc_id AND a.key = ce.source LEFT JOIN kkeys b ON b.doc_id = ce.doc_id AND b.key = ce.target GROUP BY ALL),
me0 AS (SELECT mg.*, tags, aliases, coalesce(snippet, '') AS snippet, coalesce(ev, 0) AS ev FROM mg JOIN tg USING (doc_id, source, target, relation_key, direction) JOIN al USING (doc_id, source, target, relation_key, direction) LEFT JOIN sn USING (doc_id, source, target, relation_key, direction)),
me1 AS (SELECT *, CASE WHEN list_contains(tags, 'manual') THEN 1.0::DOUBLE WHEN list_contains(tags, 'llm') AND NOT list_contains(tags, 'cooccurrence') THEN 0.9::DOUBLE WHEN list_contains(tags, 'llm') THEN 0.78::DOUBLE ELSE 0.62::DOUBLE END AS src, least(1.0::DOUBLE, greatest(support, weight) / 3.0::DOUBLE) AS sup, least(1.0::DOUBLE, ev / 3.0::DOUBLE) AS evs FROM me0),
me2 AS (SELECT *, round(0.35::DOUBLE * src + 0.25::DOUBLE * sup + 0.2::DOUBLE * evs + 0.2::DOUBLE * eps, 3) AS score FROM me1),
me AS (SELECT *, round(0.45::DOUBLE * score + 0.3::DOUBLE * eps + 0.25::DOUBLE * sup, 3) AS confidence FROM me2)"""


def _merged(s: SparkSession, d: str) -> DataFrame:
    return M.merge_edges(T.raw_edges(s, d), _llm_keys(s, d))


_add(
    "merge_edges",
    lambda s, d: _merged(s, d).select("doc_id", "source", "target", "relation_key", "direction", "relation", "original_relation", "kind", "weight", F.concat_ws("|", "tags").alias("tags"), F.concat_ws("|", "relation_aliases").alias("aliases"), "snippet", F.size("evidence").alias("n_evidence")),
    f"WITH {_MERGED} SELECT doc_id, source, target, relation_key, direction, relation, original_relation, kind, weight, array_to_string(tags, '|') AS tags, aliases, snippet, CAST(ev AS INTEGER) AS n_evidence FROM me",
)
_add(
    "edge_quality",
    lambda s, d: _merged(s, d).select("doc_id", "source", "target", "relation_key", "direction", "quality.score", "quality.confidence", "quality.support_count", "quality.endpoint_support", "quality.evidence_count", F.concat_ws("; ", "quality.reasons").alias("reasons")),
    f"""WITH {_MERGED} SELECT doc_id, source, target, relation_key, direction, score, confidence, support AS support_count, round(eps, 3) AS endpoint_support, CAST(ev AS INTEGER) AS evidence_count,
array_to_string(list_filter([CASE WHEN list_contains(tags, 'llm') THEN 'typed extraction' END, CASE WHEN list_contains(tags, 'cooccurrence') THEN 'document locality' END, CASE WHEN support > 1 THEN 'repeated support' END, CASE WHEN ev > 1 THEN 'multiple evidence' END, CASE WHEN eps < 1 THEN 'endpoint materialized from relation' END], lambda x: x IS NOT NULL), '; ') AS reasons FROM me""",
)
_add(
    "node_edge_ids",
    lambda s, d: _merged(s, d).select("doc_id", "relation_key", "direction", X.node_id(F.col("source")).alias("source_id"), X.node_id(F.col("target")).alias("target_id"), X.edge_id(F.col("source"), F.col("target"), F.col("relation")).alias("id")),
    f"WITH {_MERGED} SELECT doc_id, relation_key, direction, 'n_' || left(sha1(source), 10) AS source_id, 'n_' || left(sha1(target), 10) AS target_id, 'e_' || left(sha1(source || '|' || target || '|' || relation), 10) AS id FROM me",
)
_add(
    "llm_cache_key",
    lambda s, d: _chunks(s, d).select("doc_id", "chunk_index", X.cache_key(F.lit("model-a"), F.lit("prompt"), F.col("text")).alias("cache_key")),
    f"WITH {W.PARAGRAPHS} SELECT doc_id, paragraph_index AS chunk_index, sha256('v2|model-a|' || left(sha256('prompt'), 16) || '|' || text) AS cache_key FROM paras",
)

# Graph building, with caps small enough to bite.
_DEG = _MERGED + ", deg AS (SELECT doc_id, key, count(*) AS degree FROM (SELECT doc_id, source AS key FROM me UNION ALL SELECT doc_id, target FROM me) GROUP BY ALL)"
_CAP = _DEG + ", " + _RAWE.split(", ", 1)[1] + """, nk AS (SELECT * FROM (SELECT ent.*, coalesce(degree, 0) AS degree, row_number() OVER (PARTITION BY doc_id ORDER BY coalesce(degree, 0) DESC, count DESC, name, key) AS rn FROM ent LEFT JOIN deg USING (doc_id, key)) WHERE rn <= 12),
ek AS (SELECT * FROM (SELECT me.*, row_number() OVER (PARTITION BY doc_id ORDER BY weight DESC, source, target, relation_key, direction) AS rn FROM me WHERE EXISTS (SELECT 1 FROM nk WHERE nk.doc_id = me.doc_id AND nk.key = me.source) AND EXISTS (SELECT 1 FROM nk WHERE nk.doc_id = me.doc_id AND nk.key = me.target)) WHERE rn <= 20)"""


def _capped(s: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    edges = _merged(s, d)
    kept = G.cap_nodes(M.merge_entities(T.raw_entities(s, d)), edges, 12)
    return kept, G.cap_edges(edges, kept, 20)


_add("degree", lambda s, d: G.degrees(_merged(s, d)), f"WITH {_DEG} SELECT doc_id, key, degree FROM deg")
_add("node_cap", lambda s, d: _capped(s, d)[0].select("doc_id", "key", "degree", "node_rank"), f"WITH {_CAP} SELECT doc_id, key, degree, CAST(rn AS INTEGER) AS node_rank FROM nk")
_add("edge_cap", lambda s, d: _capped(s, d)[1].select("doc_id", "source", "target", "relation_key", "edge_rank"), f"WITH {_CAP} SELECT doc_id, source, target, relation_key, CAST(rn AS INTEGER) AS edge_rank FROM ek")


def _built(s: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    return G.build_graph(M.merge_entities(T.raw_entities(s, d)), _merged(s, d))


_add("louvain", lambda s, d: _built(s, d)[0].select("doc_id", "id", "community"))
_add("graph_json", lambda s, d: G.graph_documents(*_built(s, d), catalog.latest_status(T.table(s, d, "catalog"))))
_add(
    "graph_stats",
    lambda s, d: G.graph_stats(T.nodes(s, d), T.links(s, d)),
    f"""WITH {W.NODES}, {W.LINKS}, n AS (SELECT doc_id, count(*) AS nodes, count(DISTINCT community) AS communities FROM nodes GROUP BY doc_id),
e AS (SELECT doc_id, count(*) AS edges, count(*) FILTER (WHERE kind = 'assertion') AS directed_edges, count(*) FILTER (WHERE kind = 'association') AS association_edges FROM links GROUP BY doc_id)
SELECT doc_id, nodes, coalesce(edges, 0) AS edges, communities, coalesce(directed_edges, 0) AS directed_edges, coalesce(association_edges, 0) AS association_edges FROM n LEFT JOIN e USING (doc_id)""",
)

# Graph queries on the tables' graphs.
_DIR = "coalesce(direction, CASE WHEN kind = 'association' OR tag = 'cooccurrence' THEN 'undirected' ELSE 'directed' END)"
_KIND = f"coalesce(kind, CASE WHEN {_DIR} = 'undirected' THEN 'association' ELSE 'assertion' END)"
_CONF = "coalesce(quality.confidence, 0.0)"
_TAG = "coalesce(tag IN ('llm') OR tag = 'both', false)"
_add("tag_match", lambda s, d: T.links(s, d).select("doc_id", "id", Q.matches_tag(["llm"]).alias("match")), f"WITH {W.LINKS} SELECT doc_id, id, {_TAG} AS match FROM links")
_add(
    "derived_link_columns",
    lambda s, d: T.links(s, d).select("doc_id", "id", Q.direction().alias("direction"), Q.kind().alias("kind"), Q.confidence().alias("confidence"), Q.provenance_text().alias("provenance")),
    f"WITH {W.LINKS} SELECT doc_id, id, {_DIR} AS direction, {_KIND} AS kind, {_CONF} AS confidence, array_to_string(coalesce(provenance, [tag]), ' + ') AS provenance FROM links",
)
_RELS = ["adopts", "associated with", "funds", "opposes"]
_add(
    "filter_links",
    lambda s, d: Q.filter_links(T.links(s, d), ["llm"], _RELS, min_weight=2, min_confidence=0.4).select("doc_id", "id"),
    f"WITH {W.LINKS} SELECT doc_id, id FROM links WHERE {_TAG} AND relation IN ({W.lits(_RELS)}) AND {_KIND} IN ('assertion', 'association') AND ({_KIND} = 'assertion' OR weight >= 2) AND {_CONF} >= 0.4",
)
_add(
    "suggested_weight",
    lambda s, d: Q.suggested_weight(T.links(s, d)),
    f"WITH {W.LINKS} SELECT doc_id, CASE WHEN count(*) FILTER (WHERE {_KIND} = 'association') > 100 THEN 10 ELSE 2 END AS min_weight, greatest(1, max(weight)) AS max_weight FROM links GROUP BY doc_id",
)
_add("search_nodes", lambda s, d: Q.search(T.nodes(s, d), " Council ").select("doc_id", "id", "name"), f"WITH {W.NODES} SELECT doc_id, id, name FROM nodes WHERE contains(lower(name), 'council')")
_NB = W.NODES + ", " + W.LINKS + f""", nb0 AS (SELECT doc_id, source AS center, target AS id, 'out' AS way, relation, original_relation, {_KIND} AS kind, tag, weight, {_CONF} AS confidence, {_DIR} AS edge_direction FROM links
UNION ALL SELECT doc_id, target, source, 'in', relation, original_relation, {_KIND}, tag, weight, {_CONF}, {_DIR} FROM links WHERE source <> target),
nb AS (SELECT nb0.doc_id, center, nb0.id, n.name, relation, original_relation, kind, tag, weight, confidence, edge_direction, CASE WHEN edge_direction = 'undirected' THEN 'both' ELSE way END AS direction FROM nb0 JOIN nodes n ON n.doc_id = nb0.doc_id AND n.id = nb0.id)"""
_add(
    "neighbors",
    lambda s, d: Q.ranked_neighbors(Q.neighbor_rows(T.nodes(s, d), T.links(s, d))).select("doc_id", "center", "id", "name", "relation", "kind", "weight", "confidence", "direction", "rank"),
    f"WITH {_NB} SELECT doc_id, center, id, name, relation, kind, weight, confidence, direction, CAST(row_number() OVER (PARTITION BY doc_id, center ORDER BY kind = 'assertion' DESC, confidence DESC, weight DESC, name, id, relation, direction) AS INTEGER) AS rank FROM nb",
)
_add("relation_histogram", lambda s, d: Q.relation_histogram(T.links(s, d)), f"WITH {W.LINKS} SELECT doc_id, relation, count(*) AS n FROM links GROUP BY ALL")
_SIGNAL = f"CASE WHEN {_KIND} = 'assertion' THEN 2.0 ELSE 1.0 END * (0.5 + {_CONF}) * log2(greatest(1, coalesce(weight, 1)) + 1)"
_add("edge_signal", lambda s, d: T.links(s, d).select("doc_id", "id", F.round(X.edge_signal(Q.kind(), Q.confidence(), F.col("weight")), 6).alias("signal")), f"WITH {W.LINKS} SELECT doc_id, id, round({_SIGNAL}, 6) AS signal FROM links")
_add(
    "link_offsets",
    lambda s, d: Q.link_offsets(T.links(s, d)).withColumn("offset", F.round("offset", 6)),
    f"""WITH {W.LINKS} SELECT doc_id, id, round(CASE WHEN n = 1 THEN 0.0 ELSE (i - (n - 1) / 2.0) * 0.22 END, 6) AS "offset" FROM (SELECT doc_id, id, row_number() OVER (PARTITION BY doc_id, least(source, target), greatest(source, target) ORDER BY id) - 1 AS i, count(*) OVER (PARTITION BY doc_id, least(source, target), greatest(source, target)) AS n FROM links)""",
)
_add(
    "node_radius",
    lambda s, d: T.nodes(s, d).select("doc_id", "id", F.round(X.node_radius(F.col("degree"), F.col("count")), 6).alias("radius"), X.community_color(F.col("community")).alias("color")),
    f"WITH {W.NODES} SELECT doc_id, id, round(greatest(4.0, least(16.0, sqrt(greatest(0, coalesce(degree, 0)) * 1.4 + log2(greatest(0, coalesce(count, 0)) + 1) * 2 + 1) * 2.1)), 6) AS radius, ((community % 12) + 12) % 12 AS color FROM nodes",
)
_CENTRAL = "row_number() OVER (PARTITION BY doc_id ORDER BY degree DESC, count DESC, name, id)"
_add("top_concepts", lambda s, d: Q.central(T.nodes(s, d), 5).select("doc_id", "rank", "id", "name"), f"WITH {W.NODES} SELECT doc_id, CAST(rn AS INTEGER) AS rank, id, name FROM (SELECT *, {_CENTRAL} AS rn FROM nodes) WHERE rn <= 5")


def _label_ids(s: SparkSession, d: str) -> DataFrame:
    n, l = T.nodes(s, d), T.links(s, d)
    return Q.label_ids(n, l, "board", Q.central(n, 1).select("doc_id", "id"), limit=4)


_add(
    "label_ids",
    _label_ids,
    f"""WITH {_NB}, r AS (SELECT *, {_CENTRAL} AS rn FROM nodes) SELECT doc_id, id FROM r WHERE rn <= 4 UNION SELECT doc_id, id FROM nodes WHERE contains(lower(name), 'board')
UNION SELECT nb.doc_id, nb.id FROM nb JOIN r ON r.doc_id = nb.doc_id AND r.id = nb.center AND r.rn = 1""",
)
_COMP = "WITH RECURSIVE " + W.NODES + ", " + W.LINKS + """, adj AS (SELECT doc_id, source AS a, target AS b FROM links WHERE source <> target UNION SELECT doc_id, target, source FROM links WHERE source <> target),
reach AS (SELECT DISTINCT doc_id, id, id AS other FROM nodes UNION SELECT reach.doc_id, reach.id, adj.b FROM reach JOIN adj ON adj.doc_id = reach.doc_id AND adj.a = reach.other JOIN nodes x ON x.doc_id = adj.doc_id AND x.id = adj.b),
lab AS (SELECT doc_id, id, min(other) AS component FROM reach GROUP BY doc_id, id)"""
_add("components", lambda s, d: Q.components(T.nodes(s, d), T.links(s, d), reused), f"{_COMP} SELECT doc_id, id, component FROM lab")
_SUMM = _COMP + f""", cn AS (SELECT doc_id, component, count(*) AS node_count, arg_min(id, rn) AS lead_node_id, arg_min(name, rn) AS lead_name FROM (SELECT n.*, component, row_number() OVER (PARTITION BY doc_id ORDER BY degree DESC, count DESC, name, id) AS rn FROM nodes n JOIN lab USING (doc_id, id)) GROUP BY ALL),
cl AS (SELECT l.doc_id, s.component, count(*) AS edge_count, round(sum({_SIGNAL}), 6) AS signal, CAST(sum(weight) AS BIGINT) AS total_weight FROM links l JOIN lab s ON s.doc_id = l.doc_id AND s.id = l.source JOIN lab t ON t.doc_id = l.doc_id AND t.id = l.target WHERE s.component = t.component GROUP BY ALL),
sm AS (SELECT doc_id, component, node_count, coalesce(edge_count, 0) AS edge_count, coalesce(signal, 0.0) AS signal, coalesce(total_weight, 0) AS total_weight, lead_node_id, lead_name FROM cn LEFT JOIN cl USING (doc_id, component)),
rk AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY signal DESC, node_count DESC, edge_count DESC, lead_name, component) AS rank FROM sm)"""


def _summary(s: SparkSession, d: str) -> DataFrame:
    n, l = T.nodes(s, d), T.links(s, d)
    return Q.component_summary(n, l, Q.components(n, l, reused))


_add(
    "component_rank",
    _summary,
    f"{_SUMM} SELECT doc_id, component, node_count, edge_count, signal, total_weight, lead_node_id, lead_name, CAST(rank AS INTEGER) AS rank FROM rk",
)


def _core(s: SparkSession, d: str) -> DataFrame:
    n, l = T.nodes(s, d), T.links(s, d)
    return Q.select_view(n, l, "core", labels=Q.components(n, l, reused))[0].select("doc_id", "id")


_add("view_core", _core, f"{_SUMM}, best AS (SELECT doc_id, component FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY edge_count > 0 DESC, rank) AS rn FROM rk) WHERE rn = 1) SELECT lab.doc_id, lab.id FROM lab JOIN best USING (doc_id, component)")


def _asked(s: SparkSession, d: str) -> DataFrame:
    """From the least id of every document to the greatest."""
    return T.nodes(s, d).groupBy("doc_id").agg(F.min("id").alias("start"), F.max("id").alias("end"))


_add(
    "path_hops",
    lambda s, d: Q.shortest_paths(T.links(s, d), _asked(s, d), checkpoint=reused).select("doc_id", "start", "end", "hops"),
    "WITH RECURSIVE " + W.NODES + ", " + W.LINKS + """, adj AS (SELECT doc_id, source AS a, target AS b FROM links UNION SELECT doc_id, target, source FROM links), ask AS (SELECT doc_id, min(id) AS s, max(id) AS e FROM nodes GROUP BY doc_id),
walk AS (SELECT doc_id, s AS at, 0 AS hops FROM ask UNION SELECT w.doc_id, adj.b, w.hops + 1 FROM walk w JOIN adj ON adj.doc_id = w.doc_id AND adj.a = w.at WHERE w.hops < 20)
SELECT ask.doc_id, ask.s AS "start", ask.e AS "end", CAST(min(hops) AS INTEGER) AS hops FROM ask JOIN walk ON walk.doc_id = ask.doc_id AND walk.at = ask.e GROUP BY ALL""",
)
_add("path_links", lambda s, d: Q.path_links(Q.shortest_paths(T.links(s, d), _asked(s, d), checkpoint=reused), T.links(s, d)))
_add(
    "god_nodes",
    lambda s, d: Q.god_nodes(T.nodes(s, d)),
    f"WITH {W.NODES} SELECT doc_id, CAST(rn AS INTEGER) AS rank, name, type, degree, count AS mentions FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY degree DESC, name, id) AS rn FROM nodes) WHERE rn <= 10",
)
_add(
    "community_top",
    lambda s, d: Q.community_members(T.nodes(s, d), 3),
    f"""WITH {W.NODES} SELECT doc_id, community, count(*) AS size, coalesce(string_agg(name, ', ' ORDER BY rn) FILTER (WHERE rn <= 3), '') AS members, greatest(0, count(*) - 3) AS more FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, community ORDER BY degree DESC, name, id) AS rn FROM nodes) GROUP BY doc_id, community""",
)
_NAMED = W.NODES + ", " + W.LINKS + ", named AS (SELECT l.*, coalesce(s.name, l.source) AS source_name, coalesce(t.name, l.target) AS target_name FROM links l LEFT JOIN nodes s ON s.doc_id = l.doc_id AND s.id = l.source LEFT JOIN nodes t ON t.doc_id = l.doc_id AND t.id = l.target)"
_add(
    "key_relationships",
    lambda s, d: Q.key_relationships(T.nodes(s, d), T.links(s, d)),
    f"""WITH {_NAMED} SELECT doc_id, CAST(rn AS INTEGER) AS rank, source_name, relation, target_name, CASE WHEN {_DIR} = 'undirected' THEN '↔ association' ELSE '→ assertion' END AS semantics, array_to_string(coalesce(provenance, [tag]), ' + ') AS provenance, weight,
CASE WHEN quality.confidence IS NULL THEN '—' ELSE format('{{:.0f}}', quality.confidence * 100) || '%' END AS confidence, snippet FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY weight DESC, relation, id) AS rn FROM named) WHERE rn <= 25""",
)
_add(
    "csv_nodes",
    lambda s, d: export.csv_nodes(T.nodes(s, d)),
    f"WITH {W.NODES} SELECT doc_id, id, name, type, degree, community, coalesce(array_to_string(sources, '|'), '') AS sources, count AS mentions, snippet FROM nodes",
)


def _csv_edges(s: SparkSession, d: str) -> DataFrame:
    """Links with their evidence put back from its own table."""
    e = T.evidence(s, d).where("text is not null").groupBy("doc_id", F.col("link_id").alias("id")).agg(F.transform(F.array_sort(F.collect_list(F.struct("evidence_id", "text"))), lambda x: F.struct(x["text"].alias("text"))).alias("evidence"))
    l = T.links(s, d).join(e, ["doc_id", "id"], "left").withColumn("evidence", F.coalesce("evidence", F.array().cast("array<struct<text:string>>")))
    return export.csv_edges(l, T.nodes(s, d))


_add(
    "csv_edges",
    _csv_edges,
    f"""WITH {_NAMED}, ev AS (SELECT doc_id, link_id AS id, string_agg(text, ' || ' ORDER BY evidence_id) FILTER (WHERE text <> '') AS evidence FROM (SELECT DISTINCT * FROM graph_evidence) GROUP BY ALL)
SELECT doc_id, id, source, source_name, relation, relation_key, original_relation, target, target_name, {_DIR} AS direction, {_KIND} AS kind, tag, array_to_string(provenance, '|') AS provenance, weight, quality.confidence AS confidence, quality.score AS quality_score, coalesce(evidence, '') AS evidence, snippet FROM named LEFT JOIN ev USING (doc_id, id)""",
)

# The catalog.
_STAGE = "coalesce(list_position(['queued', 'parsing', 'chunking', 'extracting', 'clustering', 'done', 'error', 'deleted'], status), 0)"
_LAST = f"last AS (SELECT * EXCLUDE (rn) FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY updated_at DESC, {_STAGE} DESC, status DESC) AS rn FROM (SELECT DISTINCT * FROM catalog)) WHERE rn = 1)"
_NOW = "2030-01-01 00:00:00"
_add(
    "latest_status",
    lambda s, d: catalog.latest_status(T.table(s, d, "catalog")).select("id", "name", "status", "progress", "node_count", "edge_count", "updated_at"),
    f"WITH {_LAST} SELECT id, name, status, progress, node_count, edge_count, updated_at FROM last",
)
_add(
    "stale_docs",
    lambda s, d: catalog.stale(catalog.latest_status(T.table(s, d, "catalog")), F.to_timestamp(F.lit(_NOW))).select("id", "status"),
    f"WITH {_LAST} SELECT id, status FROM last WHERE status NOT IN ('done', 'error') AND epoch(TIMESTAMP '{_NOW}') - epoch(updated_at) > 120",
)
_add(
    "format_size",
    lambda s, d: T.table(s, d, "catalog").select("id", "size").distinct().select("id", X.format_size(F.col("size")).alias("shown"), X.format_duration(F.col("size") / 7.0).alias("duration")),
    """SELECT id, CASE WHEN size < 1024 THEN size || ' B' WHEN size < 1048576 THEN format('{:.1f}', size / 1024.0::DOUBLE) || ' KB' ELSE format('{:.1f}', size / 1048576.0::DOUBLE) || ' MB' END AS shown,
CASE WHEN s IS NULL THEN '—' WHEN s < 60 THEN format('{:.1f}', s) || 's' WHEN s < 3600 THEN CAST(floor(s / 60) AS BIGINT) || 'm ' || CAST(floor(s - floor(s / 60) * 60 + 0.5) AS BIGINT) || 's' ELSE CAST(floor(s / 3600) AS BIGINT) || 'h ' || lpad(CAST(CAST(floor((s - floor(s / 3600) * 3600) / 60 + 0.5) AS BIGINT) AS VARCHAR), 2, '0') || 'm' END AS duration
FROM (SELECT DISTINCT id, size, size / 7.0::DOUBLE AS s FROM catalog)""",
)
_add(
    "stage_stats",
    lambda s, d: T.table(s, d, "catalog").where("stats_json is not null").select("id", "status", F.from_json("stats_json", "nodes bigint, edges bigint").alias("x")).distinct().select("id", "status", "x.nodes", "x.edges"),
    "SELECT DISTINCT id, status, CAST(json_extract(stats_json, '$.nodes') AS BIGINT) AS nodes, CAST(json_extract(stats_json, '$.edges') AS BIGINT) AS edges FROM catalog WHERE stats_json IS NOT NULL",
)
_add(
    "filenames",
    lambda s, d: T.table(s, d, "catalog").select("name").distinct().select("name", X.safe_filename(F.col("name")).alias("safe")),
    f"""SELECT name, CASE WHEN t = '' THEN 'document' ELSE t END AS safe FROM (SELECT name, {W.strip(W.sub(W.sub("regexp_replace(name, '^.*[/" + chr(92) * 2 + "]', '')", '(.)[.][^.]*$', chr(92) + '1'), '[^A-Za-z0-9._ -]+', '_'))} AS t FROM (SELECT DISTINCT name FROM catalog))""",
)


# Operators that SQL can't express.
_add("chunk_text", lambda s, d: U.chunks(T.docs(s, d)).select("doc_id", "chunk_index", F.char_length("text").alias("chars"), F.md5("text").alias("digest")))
_add("yake", lambda s, d: K.keywords(T.docs(s, d), language=None))
_add("html_to_text", lambda s, d: documents.html_texts(T.table(s, d, "parsed").where("format = 'html'").select("doc_id", F.concat(F.lit("<html><head><style>p{}</style></head><body><p>"), F.replace(X.escape_html(F.col("text")), F.lit("\n"), F.lit("</p><p>")), F.lit("</p></body></html>")).alias("html")).distinct()).select("doc_id", F.md5("text").alias("digest")))


def _from_text(s: SparkSession, d: str) -> DataFrame:
    """The whole pipeline: texts to nodes."""
    g = build(T.docs(s, d), names=T.keywords(s, d).select("doc_id", "rank", "name"))
    return g.nodes.select("doc_id", "id", "name", "type", "degree", "community")


_add("graph_from_text", _from_text)


from . import more  # noqa: E402, F401  adds its queries
