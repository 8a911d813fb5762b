"""Queries on graphs: filters, search, neighbours, components, views, paths, rankings.

``nodes`` and ``links`` hold the graphs of many documents; everything is per ``doc_id``. Ties in names are ordered by
code point.
"""

from __future__ import annotations

from itertools import count

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillgraph.functions import text as X
from quillgraph.functions.reuse import reused


def direction(link: str = "") -> Column:
    c = lambda n: F.col(link + n)
    return F.coalesce(c("direction"), F.when((c("kind") == "association") | (c("tag") == "cooccurrence"), "undirected").otherwise("directed"))


def kind(link: str = "") -> Column:
    return F.coalesce(F.col(link + "kind"), F.when(direction(link) == "undirected", "association").otherwise("assertion"))


def confidence() -> Column:
    return F.coalesce(F.col("quality.confidence"), F.lit(0.0))


def provenance_text() -> Column:
    return F.concat_ws(" + ", F.coalesce("provenance", F.array("tag")))


def matches_tag(tags: list[str]) -> Column:
    """A link of both origins shows if either is asked for."""
    mixed = F.lit("llm" in tags or "cooccurrence" in tags)
    return F.coalesce(F.col("tag").isin(tags) | ((F.col("tag") == "both") & mixed), F.lit(False))


def filter_links(links: DataFrame, tags: list[str], relations: list[str] | None = None, kinds: list[str] = ("assertion", "association"), min_weight: int = 0, min_confidence: float = 0.0) -> DataFrame:
    """Links by tag, relation, kind, confidence, and weight, which assertions needn't meet; nodes are never filtered."""
    ok = matches_tag(tags) & kind().isin(list(kinds)) & ((kind() == "assertion") | (F.col("weight") >= min_weight)) & (confidence() >= min_confidence)
    if relations is not None:
        ok = ok & F.col("relation").isin(relations)
    return links.where(ok)


def search(nodes: DataFrame, query: str) -> DataFrame:
    """Nodes whose name holds the query, whatever the case; none for a blank one."""
    q = query.strip().lower()
    return nodes.where(F.contains(F.lower("name"), F.lit(q))) if q else nodes.where(F.lit(False))


def central(nodes: DataFrame, k: int, extra: list[str] = ()) -> DataFrame:
    """The ``k`` most central nodes of every document (or of each ``extra`` group): degree, count, name."""
    w = Window.partitionBy("doc_id", *extra).orderBy(F.desc("degree"), F.desc("count"), "name", "id")
    return nodes.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def first_hit(nodes: DataFrame, query: str) -> DataFrame:
    """The most central match of a search in every document that has one."""
    return central(search(nodes, query), 1)


def core_concepts(nodes: DataFrame, links: DataFrame, k: int = 5, labels: DataFrame | None = None) -> DataFrame:
    """The ``k`` most central nodes of every document's core."""
    return central(select_view(nodes, links, "core", labels=labels)[0], k)


def pick_list(nodes: DataFrame) -> DataFrame:
    """Nodes in the order of their names as people sort them (Unicode collation), numbered."""
    w = Window.partitionBy("doc_id").orderBy(F.collate(F.col("name"), "UNICODE"), "name", "id")
    return nodes.withColumn("place", F.row_number().over(w))


def component_of(labels: DataFrame, asked: DataFrame) -> DataFrame:
    """The components of the nodes of ``asked(doc_id, id)``, in the form in which ``select_view`` takes them."""
    return labels.join(asked.select("doc_id", "id").distinct(), ["doc_id", "id"], "left_semi").select("doc_id", "component").distinct()


def relation_names(links: DataFrame) -> DataFrame:
    """Relations of every document in alphabetical order, numbered."""
    each = links.where("relation is not null").select("doc_id", "relation").distinct()
    return each.withColumn("place", F.row_number().over(Window.partitionBy("doc_id").orderBy("relation")))


def top_relations(links: DataFrame, k: int = 15) -> DataFrame:
    """The ``k`` most frequent relations of every document, ranked."""
    w = Window.partitionBy("doc_id").orderBy(F.desc("n"), "relation")
    return relation_histogram(links).withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def legend(nodes: DataFrame, k: int = 12) -> DataFrame:
    """The first ``k`` of a document's communities by number, with their colours: as many entries as it has communities."""
    from quillgraph.functions.display import community_color

    n = nodes.groupBy("doc_id").agg(F.least(F.lit(k), F.count_distinct("community").cast("int")).alias("n")).where("n > 0")
    return n.select("doc_id", F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("community")).withColumn("color", community_color(F.col("community")))


def suggested_weight(links: DataFrame) -> DataFrame:
    """Least weight to show per document: 10 with more than a hundred associations, else 2."""
    n = F.count_if(kind() == "association")
    return links.groupBy("doc_id").agg(F.when(n > 100, 10).otherwise(2).alias("min_weight"), F.greatest(F.lit(1), F.max("weight")).alias("max_weight"))


def relation_histogram(links: DataFrame) -> DataFrame:
    return links.groupBy("doc_id", "relation").agg(F.count(F.lit(1)).alias("n"))


def neighbor_rows(nodes: DataFrame, links: DataFrame, center: DataFrame | None = None) -> DataFrame:
    """Neighbours of the nodes of ``center(doc_id, id)``, of all where it is None: one row per link and end.

    Ends that aren't nodes are left out; a link of a node to itself gives one row.
    """
    cols = ["relation", "original_relation", kind().alias("kind"), "tag", "weight", confidence().alias("confidence"), direction().alias("edge_direction")]
    out = links.select("doc_id", F.col("source").alias("center"), F.col("target").alias("id"), F.lit("out").alias("way"), *cols)
    in_ = links.where("source <> target").select("doc_id", F.col("target").alias("center"), F.col("source").alias("id"), F.lit("in").alias("way"), *cols)
    r = out.unionByName(in_)
    if center is not None:
        r = r.join(center.select("doc_id", F.col("id").alias("center")), ["doc_id", "center"], "left_semi")
    r = r.join(nodes.select("doc_id", "id", "name"), ["doc_id", "id"])
    return r.withColumn("direction", F.when(F.col("edge_direction") == "undirected", "both").otherwise(F.col("way"))).drop("way")


def ranked_neighbors(rows: DataFrame) -> DataFrame:
    """Neighbours in their order: assertions, confidence, weight, name."""
    w = Window.partitionBy("doc_id", "center").orderBy(F.desc(F.col("kind") == "assertion"), F.desc("confidence"), F.desc("weight"), "name", "id", "relation", "direction")
    return rows.withColumn("rank", F.row_number().over(w))


def adjacency(nodes: DataFrame, links: DataFrame) -> DataFrame:
    """Undirected pairs ``(doc_id, a, b)`` both ways, between nodes that exist, without loops."""
    e = links.where("source <> target").select("doc_id", F.col("source").alias("a"), F.col("target").alias("b"))
    known = nodes.select("doc_id", "id")
    e = e.join(known.withColumnRenamed("id", "a"), ["doc_id", "a"], "left_semi").join(known.withColumnRenamed("id", "b"), ["doc_id", "b"], "left_semi")
    return e.unionByName(e.select("doc_id", F.col("b").alias("a"), F.col("a").alias("b"))).distinct()


def components(nodes: DataFrame, links: DataFrame, checkpoint=reused) -> DataFrame:
    """``(doc_id, id, component)``: the least id that is connected, by falling labels with pointer jumping.

    Each round is cut off by ``checkpoint``; the rounds grow as the logarithm of the longest path.
    """
    adj = checkpoint(adjacency(nodes, links))
    lab = nodes.select("doc_id", "id", F.col("id").alias("component")).distinct()
    while True:
        near = adj.join(lab.select("doc_id", F.col("id").alias("b"), "component"), ["doc_id", "b"]).groupBy("doc_id", F.col("a").alias("id")).agg(F.min("component").alias("near"))
        step = lab.join(near, ["doc_id", "id"], "left").select("doc_id", "id", "component", F.least("component", F.coalesce("near", "component")).alias("low"))
        jump = step.select("doc_id", F.col("id").alias("low"), F.col("low").alias("jump"))
        step = checkpoint(step.join(jump, ["doc_id", "low"], "left").select("doc_id", "id", "component", F.least("low", F.coalesce("jump", "low")).alias("new")))
        lab = step.select("doc_id", "id", F.col("new").alias("component"))
        if step.where("new <> component").isEmpty():
            return lab


def component_summary(nodes: DataFrame, links: DataFrame, labels: DataFrame) -> DataFrame:
    """Components with node and edge counts, signal, weight and lead, ranked within their document.

    A link belongs to a component if both ends do.
    """
    n = nodes.join(labels, ["doc_id", "id"])
    lead = F.min_by(F.struct("id", "name"), F.struct(-F.col("degree"), -F.col("count"), F.col("name"), F.col("id")))
    c = n.groupBy("doc_id", "component").agg(F.count(F.lit(1)).alias("node_count"), lead.alias("lead"))
    s = labels.select("doc_id", F.col("id").alias("source"), F.col("component").alias("cs"))
    t = labels.select("doc_id", F.col("id").alias("target"), F.col("component").alias("ct"))
    e = links.join(s, ["doc_id", "source"]).join(t, ["doc_id", "target"]).where("cs = ct")
    signal = X.edge_signal(kind(), confidence(), F.col("weight"))
    e = e.groupBy("doc_id", F.col("cs").alias("component")).agg(F.count(F.lit(1)).alias("edge_count"), F.round(F.sum(signal), 6).alias("signal"), F.sum("weight").alias("total_weight"))
    j = c.join(e, ["doc_id", "component"], "left").select(
        "doc_id", "component", "node_count", F.coalesce("edge_count", F.lit(0).cast("bigint")).alias("edge_count"), F.coalesce("signal", F.lit(0.0)).alias("signal"),
        F.coalesce("total_weight", F.lit(0).cast("bigint")).alias("total_weight"), F.col("lead.id").alias("lead_node_id"), F.col("lead.name").alias("lead_name"),
    )
    w = Window.partitionBy("doc_id").orderBy(F.desc("signal"), F.desc("node_count"), F.desc("edge_count"), "lead_name", "component")
    return j.withColumn("rank", F.row_number().over(w))


def select_view(nodes: DataFrame, links: DataFrame, mode: str = "core", component: DataFrame | None = None, labels: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Nodes and links of a view: ``all``; ``core``, the first component with edges, else the first; ``component``.

    ``component(doc_id, component)`` are the ones asked for; documents where it isn't found fall back to the core.
    """
    if mode == "all":
        return nodes, links
    labels = components(nodes, links) if labels is None else labels
    s = component_summary(nodes, links, labels)
    asked = F.lit(False)
    if mode == "component" and component is not None:
        s = s.join(component.select("doc_id", "component", F.lit(1).alias("asked")).distinct(), ["doc_id", "component"], "left")
        asked = F.coalesce(F.col("asked") == 1, F.lit(False))
    w = Window.partitionBy("doc_id").orderBy(F.desc(asked), F.desc(F.col("edge_count") > 0), "rank")
    best = s.withColumn("rn", F.row_number().over(w)).where("rn = 1").select("doc_id", "component")
    keep = labels.join(best, ["doc_id", "component"], "left_semi").select("doc_id", "id")
    kept_links = links.join(keep.withColumnRenamed("id", "source"), ["doc_id", "source"], "left_semi").join(keep.withColumnRenamed("id", "target"), ["doc_id", "target"], "left_semi")
    return nodes.join(keep, ["doc_id", "id"], "left_semi"), kept_links


def shortest_paths(links: DataFrame, asked: DataFrame, max_hops: int | None = None, checkpoint=reused) -> DataFrame:
    """Shortest undirected paths for ``asked(doc_id, start, end)``: ``(doc_id, start, end, hops, path)``.

    A breadth-first search of all pairs at once: a frontier joins the links, nodes seen before are dropped, of several
    ways to a node the one whose ids come first in order is kept. Pairs without a path give no
    row; a path of a node to itself has no hop. The search ends when no new node is reached, or after ``max_hops`` if given.
    """
    e = links.select("doc_id", F.col("source").alias("a"), F.col("target").alias("b"), "id")
    both = checkpoint(e.unionByName(e.select("doc_id", F.col("b").alias("a"), F.col("a").alias("b"), "id")).where("a <> b").select("doc_id", "a", "b").distinct())
    keys = ["doc_id", "start", "end"]
    asked = asked.select(*keys).distinct()
    seen = checkpoint(asked.select(*keys, F.col("start").alias("node"), F.array("start").alias("path")))
    front = seen
    for _ in count() if max_hops is None else range(max_hops):
        open_ = front.join(seen.where("node = end").select(*keys), keys, "left_anti")
        nxt = open_.withColumnRenamed("node", "a").join(both, ["doc_id", "a"]).join(seen.select(*keys, F.col("node").alias("b")), [*keys, "b"], "left_anti")
        nxt = nxt.groupBy(*keys, "b").agg(F.min(F.concat("path", F.array("b"))).alias("path"))
        front = checkpoint(nxt.select(*keys, F.col("b").alias("node"), "path"))
        if front.isEmpty():
            break
        seen = checkpoint(seen.unionByName(front))
    return seen.where("node = end").select(*keys, (F.size("path") - 1).alias("hops"), "path")


def path_links(paths: DataFrame, links: DataFrame) -> DataFrame:
    """The first link of every hop, whichever way it runs: ``(doc_id, start, end, hop, a, b, link_id)``."""
    hop = F.explode(F.transform(F.sequence(F.lit(0), F.size("path") - 2), lambda i: F.struct(i.alias("hop"), F.get("path", i).alias("a"), F.get("path", i + 1).alias("b"))))
    h = paths.where(F.size("path") > 1).select("doc_id", "start", "end", hop.alias("h")).select("doc_id", "start", "end", "h.*")
    h = h.withColumn("lo", F.least("a", "b")).withColumn("hi", F.greatest("a", "b"))
    first = links.select("doc_id", F.least("source", "target").alias("lo"), F.greatest("source", "target").alias("hi"), "id").groupBy("doc_id", "lo", "hi").agg(F.min("id").alias("link_id"))
    return h.join(first, ["doc_id", "lo", "hi"], "left").drop("lo", "hi")


def link_offsets(links: DataFrame) -> DataFrame:
    """How far each of parallel links is drawn aside: ``(doc_id, id, offset)``."""
    w = Window.partitionBy("doc_id", F.least("source", "target"), F.greatest("source", "target"))
    i, n = F.row_number().over(w.orderBy("id")) - 1, F.count(F.lit(1)).over(w)
    return links.select("doc_id", "id", F.when(n == 1, 0.0).otherwise((i - (n - 1) / 2.0) * 0.22).alias("offset"))


def layout_seeds(nodes: DataFrame) -> DataFrame:
    """Nodes on a circle in the order of their ids."""
    w = Window.partitionBy("doc_id")
    i, n = F.row_number().over(w.orderBy("id")) - 1, F.count(F.lit(1)).over(w)
    r, angle = F.greatest(F.lit(45.0), F.sqrt(n) * 40), i / n * 2 * 3.141592653589793
    return nodes.select("doc_id", "id", (F.round(F.cos(angle) * r, 6) + 0.0).alias("x"), (F.round(F.sin(angle) * r, 6) + 0.0).alias("y"))


def label_ids(nodes: DataFrame, links: DataFrame, query: str = "", selected: DataFrame | None = None, limit: int = 12) -> DataFrame:
    """Nodes that bear a label: the most central, the matches of a search, the selected ones and their neighbours."""
    ids = central(nodes, limit).select("doc_id", "id")
    if query.strip():
        ids = ids.unionByName(search(nodes, query).select("doc_id", "id"))
    if selected is not None:
        ids = ids.unionByName(selected.select("doc_id", "id")).unionByName(neighbor_rows(nodes, links, selected).select("doc_id", "id"))
    return ids.distinct()


def community_members(nodes: DataFrame, k: int = 8) -> DataFrame:
    """Communities with their size, their ``k`` most central members and how many more there are."""
    w = Window.partitionBy("doc_id", "community").orderBy(F.desc("degree"), "name", "id")
    r = nodes.withColumn("rn", F.row_number().over(w))
    g = r.groupBy("doc_id", "community").agg(F.count(F.lit(1)).alias("size"), F.array_sort(F.collect_list(F.when(F.col("rn") <= k, F.struct("rn", "name")))).alias("m"))
    top = F.concat_ws(", ", F.transform("m", lambda x: x["name"]))
    return g.select("doc_id", "community", "size", top.alias("members"), F.greatest(F.lit(0), F.col("size") - k).alias("more"))


def key_relationships(nodes: DataFrame, links: DataFrame, k: int = 25) -> DataFrame:
    """The ``k`` heaviest links of every document with the names of their ends."""
    w = Window.partitionBy("doc_id").orderBy(F.desc("weight"), "relation", "id")
    top = links.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
    return with_names(top, nodes).select(
        "doc_id", "rank", "source_name", "relation", "target_name", F.when(direction() == "undirected", "↔ association").otherwise("→ assertion").alias("semantics"), provenance_text().alias("provenance"),
        "weight", F.when(F.col("quality").isNotNull() & F.col("quality.confidence").isNotNull(), F.concat(F.bround(F.col("quality.confidence") * 100, 0).cast("int").cast("string"), F.lit("%"))).otherwise("—").alias("confidence"), "snippet",
    )


def with_names(links: DataFrame, nodes: DataFrame) -> DataFrame:
    """Links with the names of their ends; the id where a node is missing."""
    n = nodes.select("doc_id", "id", "name")
    s = n.select("doc_id", F.col("id").alias("source"), F.col("name").alias("sn"))
    t = n.select("doc_id", F.col("id").alias("target"), F.col("name").alias("tn"))
    j = links.join(s, ["doc_id", "source"], "left").join(t, ["doc_id", "target"], "left")
    return j.withColumn("source_name", F.coalesce("sn", "source")).withColumn("target_name", F.coalesce("tn", "target")).drop("sn", "tn")


def god_nodes(nodes: DataFrame, k: int = 10) -> DataFrame:
    w = Window.partitionBy("doc_id").orderBy(F.desc("degree"), "name", "id")
    return nodes.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("doc_id", "rank", "name", "type", "degree", F.col("count").alias("mentions"))
