"""Graphs of documents: degrees, caps, ids, communities, envelopes."""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillgraph.functions import text as X
from quillgraph.functions.reuse import reused
from quillgraph.schemas import GRAPH_SCHEMA_VERSION, RELATION_SCHEMA_VERSION


def degrees(edges: DataFrame) -> DataFrame:
    """``(doc_id, key, degree)``: edges at each end, parallel ones counted, before any cap."""
    return edges.select("doc_id", F.explode(F.array("source", "target")).alias("key")).groupBy("doc_id", "key").agg(F.count(F.lit(1)).alias("degree"))


def cap_nodes(entities: DataFrame, edges: DataFrame, max_nodes: int = 600) -> DataFrame:
    """Entities with their degree: of each document the ``max_nodes`` most central ones."""
    e = entities.join(degrees(edges), ["doc_id", "key"], "left").withColumn("degree", F.coalesce("degree", F.lit(0).cast("bigint")))
    w = Window.partitionBy("doc_id").orderBy(F.desc("degree"), F.desc("count"), "name", "key")
    return e.withColumn("node_rank", F.row_number().over(w)).where(F.col("node_rank") <= max_nodes)


def cap_edges(edges: DataFrame, kept: DataFrame, max_edges: int = 2500) -> DataFrame:
    """Edges both of whose ends are kept: of each document the ``max_edges`` heaviest."""
    k = kept.select("doc_id", "key")
    e = edges.join(k.withColumnRenamed("key", "source"), ["doc_id", "source"], "left_semi").join(k.withColumnRenamed("key", "target"), ["doc_id", "target"], "left_semi")
    w = Window.partitionBy("doc_id").orderBy(F.desc("weight"), "source", "target", "relation_key", "direction")
    return e.withColumn("edge_rank", F.row_number().over(w)).where(F.col("edge_rank") <= max_edges)


def louvain(nodes: list[str], edges: list[tuple[str, str, float]], resolution: float = 1.0) -> dict[str, int]:
    """Communities by greedy modularity with aggregation (Blondel et al. 2008), in a fixed order of nodes.

    Parallel edges don't add up: the last weight holds. The largest community is 0; isolated nodes are their own.
    """
    names = sorted(set(nodes))
    if not names:
        return {}
    place = {n: i for i, n in enumerate(names)}
    simple: dict[tuple[int, int], float] = {}
    for a, b, w in edges:
        if a in place and b in place:
            i, j = place[a], place[b]
            simple[min(i, j), max(i, j)] = float(w)
    adjacency: list[dict[int, float]] = [defaultdict(float) for _ in names]
    for (i, j), w in simple.items():
        adjacency[i][j] += w
        if i != j:
            adjacency[j][i] += w
    member = list(range(len(names)))
    total = sum(simple.values())
    if total > 0:
        while True:
            n = len(adjacency)
            # Self-loops count twice in a degree.
            strength = [sum(a.values()) + a.get(i, 0.0) for i, a in enumerate(adjacency)]
            group = list(range(n))
            mass = strength[:]
            moved = improved = True
            improved = False
            while moved:
                moved = False
                for i in range(n):
                    near: dict[int, float] = defaultdict(float)
                    for j, w in adjacency[i].items():
                        if j != i:
                            near[group[j]] += w
                    own = group[i]
                    mass[own] -= strength[i]
                    gain = lambda c: near.get(c, 0.0) - resolution * mass[c] * strength[i] / (2 * total)  # noqa: B023, E731
                    best, most = own, gain(own)
                    for c in sorted(near):
                        if (g := gain(c)) > most + 1e-12:
                            best, most = c, g
                    mass[best] += strength[i]
                    if best != own:
                        group[i], moved, improved = best, True, True
            if not improved:
                break
            number = {c: k for k, c in enumerate(sorted(set(group)))}
            member = [number[group[m]] for m in member]
            folded: list[dict[int, float]] = [defaultdict(float) for _ in number]
            for i, a in enumerate(adjacency):
                for j, w in a.items():
                    if j >= i:
                        x, y = number[group[i]], number[group[j]]
                        folded[x][y] += w
                        if x != y:
                            folded[y][x] += w
            adjacency = folded
    size: dict[int, int] = defaultdict(int)
    for m in member:
        size[m] += 1
    rank = {c: k for k, c in enumerate(sorted(size, key=lambda c: (-size[c], c)))}
    return {n: rank[m] for n, m in zip(names, member)}


def modularity(community: dict[str, int], edges: list[tuple[str, str, float]], resolution: float = 1.0) -> float:
    total = sum(w for _, _, w in edges)
    if not total:
        return 0.0
    inside: dict[int, float] = defaultdict(float)
    strength: dict[int, float] = defaultdict(float)
    for a, b, w in edges:
        strength[community[a]] += w
        strength[community[b]] += w
        if community[a] == community[b]:
            inside[community[a]] += w
    return sum(inside[c] / total - resolution * (strength[c] / (2 * total)) ** 2 for c in strength)


def communities(kept_nodes: DataFrame, kept_edges: DataFrame, resolution: float = 1.0) -> DataFrame:
    """``(doc_id, key, community)`` of capped graphs, one document a call.

    A document's graph is bounded by the caps (600 nodes, 2,500 edges unless set otherwise), and so is the group.
    """
    nodes = kept_nodes.groupBy("doc_id").agg(F.collect_list("key").alias("nodes"))
    w = F.array_sort(F.collect_list(F.struct("edge_rank", "source", "target", "weight")))
    edges = kept_edges.groupBy("doc_id").agg(w.alias("edges"))
    both = nodes.join(edges, "doc_id", "left").select("doc_id", "nodes", "edges")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import pyarrow as pa

        for b in batches:
            rows = []
            for doc, ns, es in zip(*(c.to_pylist() for c in b.columns)):
                got = louvain(ns, [(e["source"], e["target"], e["weight"]) for e in es or []], resolution)
                rows += [(doc, k, c) for k, c in sorted(got.items())]
            if rows:
                d, k, c = zip(*rows)
                yield pa.RecordBatch.from_arrays([pa.array(d, pa.string()), pa.array(k, pa.string()), pa.array(c, pa.int32())], ["doc_id", "key", "community"])

    return both.mapInArrow(run, "doc_id string, key string, community int")


def build_graph(entities: DataFrame, edges: DataFrame, max_nodes: int = 600, max_edges: int = 2500) -> tuple[DataFrame, DataFrame]:
    """Nodes and links of every document's graph."""
    entities, edges = reused(entities), reused(edges)
    kept = reused(cap_nodes(entities, edges, max_nodes))
    kept_edges = reused(cap_edges(edges, kept, max_edges))
    com = communities(kept, kept_edges)
    nodes = kept.join(com, ["doc_id", "key"], "left").select(
        "doc_id", X.node_id(F.col("key")).alias("id"), "name", "type", "snippet", "degree", F.coalesce("community", F.lit(0)).alias("community"), "sources", "count", "node_rank"
    )
    return nodes, links(kept_edges)


def links(edges: DataFrame) -> DataFrame:
    """Merged edges in the form of links: ids of ends and edges, one tag, the provenance."""
    return edges.select(
        "doc_id", X.edge_id(F.col("source"), F.col("target"), F.col("relation")).alias("id"), X.node_id(F.col("source")).alias("source"), X.node_id(F.col("target")).alias("target"),
        "relation", "relation_key", "original_relation", "relation_aliases", "direction", "kind", X.link_tag(F.col("tags")).alias("tag"), "provenance", "weight", "snippet", "evidence", "quality", "edge_rank",
    )


def graph_stats(nodes: DataFrame, links_: DataFrame) -> DataFrame:
    """Counters per document; ``directed_edges`` are the assertions."""
    n = nodes.groupBy("doc_id").agg(F.count(F.lit(1)).alias("nodes"), F.count_distinct("community").alias("communities"))
    e = links_.groupBy("doc_id").agg(F.count(F.lit(1)).alias("edges"), F.count_if(F.col("kind") == "assertion").alias("directed_edges"), F.count_if(F.col("kind") == "association").alias("association_edges"))
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("bigint").alias(c)
    return n.join(e, "doc_id", "left").select("doc_id", "nodes", zero("edges"), "communities", zero("directed_edges"), zero("association_edges"))


def graph_documents(nodes: DataFrame, links_: DataFrame, catalog: DataFrame | None = None, llm_enabled: bool = False) -> DataFrame:
    """One envelope per document, as JSON: ``(doc_id, graph_json)``; fields without a value are left out."""
    node_cols = ["id", "name", "type", "snippet", "degree", "community", "sources", "count"]
    link_cols = [c for c in links_.columns if c not in ("doc_id", "edge_rank")]
    n = nodes.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct(*([F.col("node_rank")] if "node_rank" in nodes.columns else []), *node_cols))).alias("nodes"))
    order = [F.col("edge_rank")] if "edge_rank" in links_.columns else []
    e = links_.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct(*order, *link_cols))).alias("links"))
    s = graph_stats(nodes, links_)
    strip = lambda a, cols: F.transform(a, lambda x: F.struct(*[x[c].alias(c) for c in cols]))
    d = n.join(e, "doc_id", "left").join(s.withColumnRenamed("nodes", "node_count"), "doc_id")
    name = F.col("doc_id")
    if catalog is not None:
        d = d.join(catalog.select(F.col("id").alias("doc_id"), F.col("name").alias("doc_name"), "created_at").dropDuplicates(["doc_id"]), "doc_id", "left")
        name = F.coalesce("doc_name", "doc_id")
    created = [F.date_format("created_at", "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX").alias("created_at")] if catalog is not None else []
    stats = F.struct(
        F.lit(GRAPH_SCHEMA_VERSION).alias("graph_schema_version"), F.lit(RELATION_SCHEMA_VERSION).alias("relation_schema_version"), F.col("node_count").alias("nodes"), "edges", "communities", "directed_edges", "association_edges"
    )
    head = F.struct(
        F.col("doc_id").alias("id"), name.alias("name"), stats.alias("stats"), F.lit(llm_enabled).alias("llm_enabled"), *created, F.lit(GRAPH_SCHEMA_VERSION).alias("schema_version"), F.lit(RELATION_SCHEMA_VERSION).alias("relation_schema_version")
    )
    empty = F.coalesce(strip(F.col("links"), link_cols), F.array().cast(links_.select(F.array(F.struct(*link_cols))).schema[0].dataType))
    return d.select("doc_id", F.to_json(F.struct(head.alias("document"), strip(F.col("nodes"), node_cols).alias("nodes"), empty.alias("links"))).alias("graph_json"))
