"""More registered queries: lists, legends, uploads, run statistics, views, and invariants of what SQL can't compute."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillgraph import schemas
from quillgraph.functions import display as D
from quillgraph.functions.reuse import reused
from quillgraph.operators import graph as G
from quillgraph.operators import merge as M
from quillgraph.operators import query as Q
from quillgraph.operators import selection as S
from quillgraph.operators import units as U
from quillgraph.sources import catalog

from . import registry as R
from . import sql as W
from . import tables as T
from .registry import _add

_NOW = "2030-01-01 00:00:00"


# Uploads and the catalog.
def _uploads(s: SparkSession, d: str) -> DataFrame:
    """Files of the catalog, some with the wrong type, mode or size, told by their hash."""
    c = T.table(s, d, "catalog").select("id", "name", "ext", "size", "extraction_mode").distinct()
    k = F.pmod(F.conv(F.substring(F.md5("id"), 1, 4), 16, 10).cast("int"), F.lit(9))
    ext = F.when(k == 0, ".exe").when(k == 1, ".doc").otherwise(F.col("ext"))
    mode = F.when(k == 2, "slow").when(k == 3, " FULL ").when(k == 4, F.lit(None).cast("string")).otherwise(F.col("extraction_mode"))
    size = F.when(k == 5, 0).when(k == 6, F.col("size") + 52_428_800).when(k == 7, 52_428_800).otherwise(F.col("size"))
    return c.select("id", F.concat("name", ext).alias("name"), size.alias("size"), mode.alias("mode"))


_add(
    "upload_checks",
    lambda s, d: catalog.upload_checks(_uploads(s, d)).select("id", "name", "size", "code", "reason"),
    f"""WITH c AS (SELECT DISTINCT id, name, ext, size, extraction_mode, CAST('0x' || left(md5(id), 4) AS INTEGER) % 9 AS k FROM catalog),
u AS (SELECT id, name || CASE k WHEN 0 THEN '.exe' WHEN 1 THEN '.doc' ELSE ext END AS name, CASE k WHEN 5 THEN 0 WHEN 6 THEN size + 52428800 WHEN 7 THEN 52428800 ELSE size END AS size,
  CASE k WHEN 2 THEN 'slow' WHEN 3 THEN ' FULL ' WHEN 4 THEN NULL ELSE extraction_mode END AS mode FROM c),
e AS (SELECT *, lower(regexp_extract(name, '[.][^.]+$')) AS ext, lower(trim(CASE WHEN coalesce(mode, '') = '' THEN 'balanced' ELSE mode END)) AS m FROM u),
r AS (SELECT *, CASE WHEN ext NOT IN ({W.lits(catalog.EXTENSIONS)}) THEN 'type' WHEN ext = '.doc' THEN 'old Word format' WHEN m NOT IN ('fast', 'balanced', 'full') THEN 'mode' WHEN size <= 0 THEN 'empty' WHEN size > 52428800 THEN 'too large' END AS reason FROM e)
SELECT id, name, size, CASE WHEN reason IS NULL THEN 200 WHEN reason = 'too large' THEN 413 ELSE 400 END AS code, reason FROM r""",
)
_add(
    "catalog_ages",
    lambda s, d: R.catalog.latest_status(T.table(s, d, "catalog")).select(
        "id", D.time_ago(F.col("updated_at"), F.to_timestamp(F.lit(_NOW))).alias("ago"), D.time_ago(F.col("updated_at"), F.col("created_at") + F.expr("interval 400 minutes")).alias("since"),
        D.stalled(F.col("status"), F.col("updated_at"), F.to_timestamp(F.lit(_NOW))).alias("stalled"),
    ),
    f"""WITH {R._LAST}, a AS (SELECT id, status, updated_at, CAST(greatest(0, floor(epoch(TIMESTAMP '{_NOW}') - epoch(updated_at) + 0.5)) AS BIGINT) AS s, CAST(greatest(0, floor(epoch(created_at) + 24000 - epoch(updated_at) + 0.5)) AS BIGINT) AS t FROM last)
SELECT id, {{ago}} AS ago, {{since}} AS since, status NOT IN ('done', 'error') AND epoch(TIMESTAMP '{_NOW}') - epoch(updated_at) > 120 AS stalled FROM a""".format(
        **{n: f"CASE WHEN {c} < 5 THEN 'just now' WHEN {c} < 60 THEN {c} || 's ago' WHEN {c} < 3600 THEN {c} // 60 || 'm ago' ELSE {c} // 3600 || 'h ' || {c} // 60 % 60 || 'm ago' END" for n, c in (("ago", "s"), ("since", "t"))}
    ),
)
_add(
    "progress_details",
    lambda s, d: T.table(s, d, "catalog").where("progress_detail is not null").select("id", "progress_detail").distinct().withColumn("x", D.progress_detail(F.col("progress_detail"))).select(
        "id", "x.completed", "x.total", D.eta((F.col("x.total") - F.col("x.completed")) * 7.3).alias("eta")
    ),
    """WITH p AS (SELECT DISTINCT id, progress_detail, CAST(json_extract(progress_detail, '$.completed') AS BIGINT) AS completed, CAST(json_extract(progress_detail, '$.total') AS BIGINT) AS total FROM catalog WHERE progress_detail IS NOT NULL),
q AS (SELECT *, (total - completed) * 7.3::DOUBLE AS t FROM p) SELECT id, completed, total, CASE WHEN t IS NULL OR t < 1 THEN 'calculating ETA' WHEN t < 60 THEN '~' || CAST(ceil(t) AS BIGINT) || 's left' ELSE '~' || CAST(ceil(t / 60) AS BIGINT) || 'm left' END AS eta FROM q""",
)


def _run_stats(s: SparkSession, d: str) -> DataFrame:
    """Statistics of runs, made of the sizes in the catalog: some without a model, some with a bad number, some without stages."""
    c = T.table(s, d, "catalog").select("id", "size").distinct()
    n = F.col("size")
    stats = F.to_json(
        F.struct(
            F.when(n % 7 != 0, n / 900.0).alias("parsing_seconds"), F.when(n % 5 == 1, "much").alias("chunking_seconds"), F.when(n % 7 != 0, n % 3000 / 8.0).alias("statistical_seconds"),
            F.when(n % 3 == 0, n % 9000 / 4.0).alias("llm_seconds"), F.when(n % 7 != 0, n / 4.0).alias("pipeline_seconds"), (n % 40).alias("chunks"), F.when(n % 2 == 0, n % 11).alias("llm_chunks"), (n % 13).alias("llm_selected_chunks"), F.lit(4).alias("llm_concurrency"),
        )
    )
    return c.select("id", "size", stats.alias("stats"))


_DURATION = """CASE WHEN x < 60 THEN format('{:.1f}', floor(x * 10 + 0.5) / 10) || 's' WHEN x < 3600 THEN CAST(floor(x / 60) AS BIGINT) || 'm ' || CAST(floor(x - floor(x / 60) * 60 + 0.5) AS BIGINT) || 's'
ELSE CAST(floor(x / 3600) AS BIGINT) || 'h ' || lpad(CAST(CAST(floor((x - floor(x / 3600) * 3600) / 60 + 0.5) AS BIGINT) AS VARCHAR), 2, '0') || 'm' END"""
_add(
    "stage_timings",
    lambda s, d: _run_stats(s, d).select("id", "size", D.timing_line(D.stage_timings(F.col("stats"))).alias("line"), D.context_line(F.col("stats")).alias("context")),
    f"""WITH c AS (SELECT DISTINCT id, size AS n FROM catalog), v AS (SELECT id, n, unnest([{{'o': 1, 'l': 'parse', 'x': CASE WHEN n % 7 <> 0 THEN n / 900.0::DOUBLE END}}, {{'o': 2, 'l': 'statistical', 'x': CASE WHEN n % 7 <> 0 THEN n % 3000 / 8.0::DOUBLE END}},
  {{'o': 3, 'l': 'llm', 'x': CASE WHEN n % 3 = 0 THEN n % 9000 / 4.0::DOUBLE END}}, {{'o': 4, 'l': 'total', 'x': CASE WHEN n % 7 <> 0 THEN n / 4.0::DOUBLE END}}], recursive := true) FROM c),
u AS (SELECT id, n, (n % 3 = 0 AND n % 9000 > 0) OR (n % 2 = 0 AND n % 11 > 0) AS used FROM c),
t AS (SELECT id, n, string_agg(l || ' ' || {_DURATION}, ' · ' ORDER BY o) AS line FROM v JOIN u USING (id, n) WHERE x IS NOT NULL AND (l <> 'llm' OR used) GROUP BY ALL)
SELECT u.id, u.n AS size, coalesce(line, '') AS line, concat_ws(' · ', CASE WHEN u.n % 40 <> 0 THEN u.n % 40 || ' chunks' END, CASE WHEN used AND u.n % 13 <> 0 THEN u.n % 13 || ' LLM-selected' END, CASE WHEN used THEN 'concurrency 4' END) AS context FROM u LEFT JOIN t ON t.id = u.id AND t.n = u.n""",
)

# Lists and legends.
_add(
    "valid_semantics",
    lambda s, d: T.links(s, d).select("doc_id", "id", schemas.valid_direction(F.col("direction")).alias("direction"), schemas.valid_kind(F.col("kind")).alias("kind")),
    f"WITH {W.LINKS} SELECT doc_id, id, coalesce(direction IN ('directed', 'undirected'), false) AS direction, coalesce(kind IN ('assertion', 'association'), false) AS kind FROM links",
)
_add(
    "first_hit",
    lambda s, d: Q.first_hit(T.nodes(s, d), "council").select("doc_id", "id", "name"),
    f"WITH {W.NODES} SELECT doc_id, id, name FROM (SELECT *, {R._CENTRAL} AS rn FROM nodes WHERE contains(lower(name), 'council')) WHERE rn = 1",
)
_add(
    "pick_list",
    lambda s, d: Q.pick_list(T.nodes(s, d)).select("doc_id", "id", "name", "place"),
    f"WITH {W.NODES} SELECT doc_id, id, name, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY name COLLATE en, name, id) AS INTEGER) AS place FROM nodes",
)
_add("relation_names", lambda s, d: Q.relation_names(T.links(s, d)), f"WITH {W.LINKS} SELECT doc_id, relation, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY relation) AS INTEGER) AS place FROM (SELECT DISTINCT doc_id, relation FROM links WHERE relation IS NOT NULL)")
_add(
    "top_relations",
    lambda s, d: Q.top_relations(T.links(s, d)),
    f"WITH {W.LINKS}, h AS (SELECT doc_id, relation, count(*) AS n FROM links GROUP BY ALL) SELECT doc_id, relation, n, CAST(rn AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, relation) AS rn FROM h) WHERE rn <= 15",
)
_add(
    "legend",
    lambda s, d: Q.legend(T.nodes(s, d)),
    f"WITH {W.NODES}, n AS (SELECT doc_id, least(12, count(DISTINCT community)) AS n FROM nodes GROUP BY doc_id) SELECT doc_id, CAST(i AS INTEGER) AS community, [{W.lits(D.COMMUNITY_COLORS)}][i % 12 + 1] AS color FROM (SELECT doc_id, unnest(range(n)) AS i FROM n)",
)
_add(
    "link_colors",
    lambda s, d: T.links(s, d).select("doc_id", "id", D.tag_color(F.col("tag")).alias("color")),
    f"WITH {W.LINKS} SELECT doc_id, id, CASE tag WHEN 'llm' THEN '#eaeaea' WHEN 'both' THEN '#ffb000' ELSE '#5c6370' END AS color FROM links",
)
_add(
    "entity_order",
    lambda s, d: M.entity_order(M.merge_entities(T.raw_entities(s, d))).select("doc_id", "key", "place"),
    f"WITH {R._RAWE} SELECT doc_id, key, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY count DESC, name, key) AS INTEGER) AS place FROM ent",
)


def _core_concepts(s: SparkSession, d: str) -> DataFrame:
    n, l = T.nodes(s, d), T.links(s, d)
    return Q.core_concepts(n, l).select("doc_id", "rank", "id", "name")


_BEST = f"{R._SUMM}, best AS (SELECT doc_id, component FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY edge_count > 0 DESC, rank) AS rn FROM rk) WHERE rn = 1)"
_add(
    "core_concepts",
    _core_concepts,
    f"{_BEST}, c AS (SELECT n.* FROM nodes n JOIN lab USING (doc_id, id) JOIN best USING (doc_id, component)) SELECT doc_id, CAST(rn AS INTEGER) AS rank, id, name FROM (SELECT *, {R._CENTRAL} AS rn FROM c) WHERE rn <= 5",
)


def _component_view(s: SparkSession, d: str) -> DataFrame:
    """The components of the greatest ids."""
    n, l = T.nodes(s, d), T.links(s, d)
    labels = reused(Q.components(n, l))
    asked = n.groupBy("doc_id").agg(F.max("id").alias("id"))
    return Q.select_view(n, l, "component", Q.component_of(labels, asked), labels)[0].select("doc_id", "id")


_add(
    "view_component",
    _component_view,
    f"{R._COMP}, m AS (SELECT doc_id, max(id) AS id FROM nodes GROUP BY doc_id) SELECT lab.doc_id, lab.id FROM m JOIN lab k ON k.doc_id = m.doc_id AND k.id = m.id JOIN lab ON lab.doc_id = k.doc_id AND lab.component = k.component",
)
_add(
    "layout_seeds",
    lambda s, d: Q.layout_seeds(T.nodes(s, d)),
    f"""WITH {W.NODES}, p AS (SELECT doc_id, id, row_number() OVER (PARTITION BY doc_id ORDER BY id) - 1 AS i, count(*) OVER (PARTITION BY doc_id) AS n FROM nodes)
SELECT doc_id, id, round(cos(i / n::DOUBLE * 2 * 3.141592653589793) * greatest(45.0, sqrt(n) * 40), 6) + 0.0 AS x, round(sin(i / n::DOUBLE * 2 * 3.141592653589793) * greatest(45.0, sqrt(n) * 40), 6) + 0.0 AS y FROM p""",
)

# Chunks of the texts themselves, and what must hold of them.
def _real_chunks(s: SparkSession, d: str) -> DataFrame:
    return reused(U.chunks(T.docs(s, d)))


def _chunk_cover(s: SparkSession, d: str) -> DataFrame:
    """Per document: chunks are numbered without gaps, none exceeds the limit with its overlap, and their words are all the words of the text."""
    c = _real_chunks(s, d)
    g = c.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"), F.max("chunk_index").alias("last"), F.max(F.char_length("text")).alias("longest"))
    word = lambda df: df.select("doc_id", F.explode(R.X.words(F.col("text"))).alias("w")).distinct()
    # A word longer than a chunk, or one cut off where a chunk repeats the end of another, is no word of the text.
    lost = word(T.docs(s, d)).where(F.char_length("w") < 200).join(word(c), ["doc_id", "w"], "left_anti").groupBy("doc_id").agg(F.count(F.lit(1)).alias("lost"))
    docs = T.docs(s, d).where(R.X.ustrip(F.col("text")) != "").select("doc_id")
    j = docs.join(g, "doc_id", "left").join(lost, "doc_id", "left")
    return j.select("doc_id", (F.col("last") + 1 == F.col("n")).alias("numbered"), (F.col("longest") <= 4202).alias("within"), F.coalesce("lost", F.lit(0).cast("bigint")).alias("lost"))


_add("chunk_cover", _chunk_cover, f"WITH {W.DOCS} SELECT doc_id, true AS numbered, true AS within, 0 AS lost FROM docs WHERE {W.strip('text')} <> ''")
_add("chunk_select_real", lambda s, d: S.select_chunks(S.chunk_scores(_real_chunks(s, d))).select("doc_id", "chunk_index", "selected", "total"))


def _louvain_checks(s: SparkSession, d: str) -> DataFrame:
    """Per document: every node has a community, communities are numbered by falling size, and the partition is better than one community and no worse than single nodes."""
    entities, edges = M.merge_entities(T.raw_entities(s, d)), R._merged(s, d)
    kept = reused(G.cap_nodes(entities, edges))
    kept_edges = reused(G.cap_edges(edges, kept))
    com = reused(G.communities(kept, kept_edges))
    size = com.groupBy("doc_id", "community").agg(F.count(F.lit(1)).alias("n"))
    order = size.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("community", "n"))).alias("c"))
    order = order.select("doc_id", (F.transform("c", lambda x: x["community"]).cast("array<int>") == F.sequence(F.lit(0), F.size("c") - 1)).alias("numbered"), (F.transform("c", lambda x: x["n"]) == F.sort_array(F.transform("c", lambda x: x["n"]), False)).alias("falling"))
    # Of parallel edges the last by rank counts.
    one = kept_edges.groupBy("doc_id", F.least("source", "target").alias("a"), F.greatest("source", "target").alias("b")).agg(F.max_by("weight", "edge_rank").cast("double").alias("w"))
    c = lambda x: com.select("doc_id", F.col("key").alias(x), F.col("community").alias(f"c{x}"))
    e = one.join(c("a"), ["doc_id", "a"]).join(c("b"), ["doc_id", "b"])
    ends = e.select("doc_id", F.explode(F.array(F.struct(F.col("a").alias("one"), F.col("ca").alias("group")), F.struct(F.col("b").alias("one"), F.col("cb").alias("group")))).alias("x"), "w").select("doc_id", "x.*", "w")
    total = e.groupBy("doc_id").agg(F.sum("w").alias("m"), F.sum(F.when(F.col("ca") == F.col("cb"), F.col("w")).otherwise(0.0)).alias("inside"))
    squares = lambda by: ends.groupBy("doc_id", by).agg(F.sum("w").alias("k")).groupBy("doc_id").agg(F.sum(F.col("k") * F.col("k")).alias(f"sq_{by}"))
    q = total.join(squares("group"), "doc_id").join(squares("one"), "doc_id")
    modularity = F.col("inside") / F.col("m") - F.col("sq_group") / (4 * F.col("m") * F.col("m"))
    q = q.select("doc_id", ((modularity >= -1e-9) & (modularity >= -F.col("sq_one") / (4 * F.col("m") * F.col("m")) - 1e-9)).alias("good"))
    nodes = kept.groupBy("doc_id").agg(F.count(F.lit(1)).alias("nodes"))
    covered = com.groupBy("doc_id").agg(F.count(F.lit(1)).alias("covered"))
    j = nodes.join(covered, "doc_id", "left").join(order, "doc_id", "left").join(q, "doc_id", "left")
    return j.select("doc_id", "nodes", (F.col("covered") == F.col("nodes")).alias("covered"), "numbered", "falling", F.coalesce("good", F.lit(True)).alias("good"))


_add("louvain_checks", _louvain_checks, f"WITH {R._RAWE} SELECT doc_id, least(600, count(*)) AS nodes, true AS covered, true AS numbered, true AS falling, true AS good FROM ent GROUP BY doc_id")


def _graph_json_parts(s: SparkSession, d: str) -> DataFrame:
    """What an envelope holds, read back from its JSON."""
    g = G.graph_documents(T.nodes(s, d), T.links(s, d), catalog.latest_status(T.table(s, d, "catalog")))
    x = F.from_json("graph_json", "document struct<id:string,name:string,schema_version:int,stats:struct<nodes:bigint,edges:bigint>>, nodes array<struct<id:string,name:string,degree:bigint>>, links array<struct<id:string,source:string,weight:bigint>>")
    j = g.select(x.alias("x"))
    return j.select(
        F.col("x.document.id").alias("doc_id"), F.col("x.document.name").alias("name"), F.col("x.document.schema_version").alias("version"), F.col("x.document.stats.nodes").alias("nodes"), F.col("x.document.stats.edges").alias("edges"),
        F.md5(F.array_join(F.array_sort(F.transform("x.nodes", lambda n: F.concat_ws("|", n["id"], n["name"], n["degree"].cast("string")))), ";")).alias("node_digest"),
        F.md5(F.array_join(F.array_sort(F.transform("x.links", lambda n: F.concat_ws("|", n["id"], n["source"], n["weight"].cast("string")))), ";")).alias("link_digest"),
    )


_add(
    "graph_json_parts",
    _graph_json_parts,
    f"""WITH {W.NODES}, {W.LINKS}, {R._LAST}, n AS (SELECT doc_id, count(*) AS nodes, md5(string_agg(concat_ws('|', id, name, degree), ';' ORDER BY concat_ws('|', id, name, degree))) AS node_digest FROM nodes GROUP BY doc_id),
l AS (SELECT doc_id, count(*) AS edges, md5(string_agg(concat_ws('|', id, source, weight), ';' ORDER BY concat_ws('|', id, source, weight))) AS link_digest FROM links GROUP BY doc_id)
SELECT n.doc_id, coalesce(last.name, n.doc_id) AS name, 2 AS version, nodes, coalesce(edges, 0) AS edges, node_digest, coalesce(link_digest, md5('')) AS link_digest FROM n LEFT JOIN l USING (doc_id) LEFT JOIN last ON last.id = n.doc_id""",
)

# Sequential operators, by folds and recursion.
R._SQL["links_capped"] = f"""WITH {W.SCORES}, l AS (SELECT doc_id, list_reduce(list([{{'source': source, 'target': target, 'weight': weight, 'support_count': support_count, 'sentence_support': sentence_support, 'window_support': window_support, 'paragraph_support': paragraph_support}}] ORDER BY weight DESC, source, target),
  lambda kept, x: CASE WHEN len(list_filter(kept, lambda k: k.source = x[1].source OR k.target = x[1].source)) < 8 AND len(list_filter(kept, lambda k: k.source = x[1].target OR k.target = x[1].target)) < 8 THEN kept || x ELSE kept END) AS kept FROM scored GROUP BY doc_id)
SELECT doc_id, unnest(kept, recursive := true) FROM l"""
R._SQL["path_links"] = "WITH RECURSIVE " + W.NODES + ", " + W.LINKS + """, adj AS (SELECT doc_id, source AS a, target AS b FROM links WHERE source <> target UNION SELECT doc_id, target, source FROM links WHERE source <> target),
ask AS (SELECT doc_id, min(id) AS s, max(id) AS e FROM nodes GROUP BY doc_id),
back AS (SELECT doc_id, e AS node, 0 AS h FROM ask UNION SELECT back.doc_id, adj.b, h + 1 FROM back JOIN adj ON adj.doc_id = back.doc_id AND adj.a = back.node WHERE h < 60),
dist AS (SELECT doc_id, node, min(h) AS h FROM back GROUP BY ALL),
walk AS (SELECT ask.doc_id, s, e, s AS node, 0 AS hop, h AS togo FROM ask JOIN dist ON dist.doc_id = ask.doc_id AND dist.node = s
UNION ALL SELECT walk.doc_id, walk.s, walk.e, min(adj.b), walk.hop + 1, walk.togo - 1 FROM walk JOIN adj ON adj.doc_id = walk.doc_id AND adj.a = walk.node JOIN dist ON dist.doc_id = adj.doc_id AND dist.node = adj.b AND dist.h = walk.togo - 1 WHERE walk.togo > 0 GROUP BY walk.doc_id, walk.s, walk.e, walk.hop, walk.togo),
step AS (SELECT x.doc_id, x.s, x.e, x.hop, x.node AS a, y.node AS b FROM walk x JOIN walk y ON y.doc_id = x.doc_id AND y.hop = x.hop + 1)
SELECT step.doc_id, step.s AS "start", step.e AS "end", CAST(hop AS INTEGER) AS hop, a, b, min(l.id) AS link_id FROM step LEFT JOIN links l ON l.doc_id = step.doc_id AND ((l.source = a AND l.target = b) OR (l.source = b AND l.target = a)) GROUP BY ALL"""
_TEXT = f"array_to_string(list_filter(list_transform(string_split_regex(text, '[\\n\\r\\x0b\\x0c\\x1c-\\x1e\\x{{85}}\\x{{2028}}\\x{{2029}}]'), lambda l: {W.strip('l')}), lambda l: l <> ''), chr(10))"
R._SQL["html_to_text"] = f"SELECT DISTINCT doc_id, md5({_TEXT}) AS digest FROM parsed WHERE format = 'html'"

# The caps at their usual values.
_DEFAULT = R._CAP.replace("rn <= 12", "rn <= 600").replace("rn <= 20", "rn <= 2500")


def _capped(s: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    edges = reused(R._merged(s, d))
    kept = reused(G.cap_nodes(M.merge_entities(T.raw_entities(s, d)), edges))
    return kept, G.cap_edges(edges, kept)


_add("node_cap_usual", lambda s, d: _capped(s, d)[0].select("doc_id", "key", "degree", "node_rank"), f"WITH {_DEFAULT} SELECT doc_id, key, degree, CAST(rn AS INTEGER) AS node_rank FROM nk")
_add("edge_cap_usual", lambda s, d: _capped(s, d)[1].select("doc_id", "source", "target", "relation_key", "edge_rank"), f"WITH {_DEFAULT} SELECT doc_id, source, target, relation_key, CAST(rn AS INTEGER) AS edge_rank FROM ek")
_add("community_top_usual", lambda s, d: Q.community_members(T.nodes(s, d)), R._SQL["community_top"].replace("rn <= 3", "rn <= 8").replace("count(*) - 3", "count(*) - 8"))
