import random
from collections import deque

import pytest
from pyspark.sql import functions as F

from quillgraph.operators import graph as G
from quillgraph.operators import query as Q
from quillgraph.sources import export


def test_two_clusters_and_isolates():
    tri = [("a", "b", 1), ("b", "c", 1), ("a", "c", 1), ("d", "e", 1)]
    got = G.louvain(list("abcde"), tri)
    assert got["a"] == got["b"] == got["c"] == 0 and got["d"] == got["e"] == 1
    assert len(set(G.louvain(["x", "y"], []).values())) == 2
    assert G.louvain([], []) == {}


def test_louvain_is_deterministic_and_no_worse_than_singletons():
    rng = random.Random(3)
    nodes = [f"n{i}" for i in range(40)]
    edges = list({(a, b): (a, b, rng.randint(1, 5)) for a, b in ((min(p), max(p)) for p in (rng.sample(nodes, 2) for _ in range(120)))}.values())
    got = G.louvain(nodes, edges)
    shuffled = nodes[:]
    rng.shuffle(shuffled)
    assert got == G.louvain(shuffled, edges)
    assert G.modularity(got, edges) > G.modularity({n: i for i, n in enumerate(nodes)}, edges)


LINK = "doc_id string, id string, source string, target string, relation string, original_relation string, direction string, kind string, tag string, provenance array<string>, weight bigint, snippet string, quality struct<score:double,confidence:double>"
NODE = "doc_id string, id string, name string, type string, snippet string, degree bigint, community int, sources array<string>, count bigint"


@pytest.fixture(scope="module")
def graph(spark):
    rng = random.Random(5)
    nodes, links = [], []
    for d in ("p", "q"):
        ids = [f"n{i:02d}" for i in range(14)]
        nodes += [(d, i, f"name {i}", "concept", None, rng.randint(0, 4), rng.randint(0, 2), ["llm"], 1) for i in ids]
        for k in range(12):
            a, b = rng.choice(ids), rng.choice(ids)
            links.append((d, f"e{k:02d}", a, b, "uses", "uses", None if k % 5 == 0 else "directed", None, "both" if k % 2 else "cooccurrence", None, k, None, None if k == 3 else (0.5, 0.1 * k)))
        links.append((d, "e99", "n00", "missing", "uses", "uses", "directed", "assertion", "llm", ["llm"], 1, "", (0.1, 0.1)))
    return spark.createDataFrame(nodes, NODE), spark.createDataFrame(links, LINK)


def plain(graph):
    nodes, links = graph
    adj = {}
    for n in nodes.collect():
        adj[n.doc_id, n.id] = set()
    for x in links.collect():
        a, b = (x.doc_id, x.source), (x.doc_id, x.target)
        if a in adj and b in adj and a != b:
            adj[a].add(b)
            adj[b].add(a)
    return adj


def test_components_against_search(graph):
    adj = plain(graph)
    want = {}
    for s in adj:
        seen, queue = {s}, deque([s])
        while queue:
            for t in adj[queue.popleft()] - seen:
                seen.add(t)
                queue.append(t)
        want[s] = min(i for _, i in seen)
    assert {(r.doc_id, r.id): r.component for r in Q.components(*graph).collect()} == want


def test_paths_against_search(spark, graph):
    adj = plain(graph)
    asked = [("p", "n00", f"n{i:02d}") for i in range(14)] + [("q", "n01", "n13"), ("q", "none", "n01")]
    want = {}
    for d, a, b in asked:
        seen, queue = {(d, a): 0}, deque([(d, a)])
        while queue:
            x = queue.popleft()
            for t in adj.get(x, ()):
                if t not in seen:
                    seen[t] = seen[x] + 1
                    queue.append(t)
        if (d, b) in seen:
            want[d, a, b] = seen[d, b]
    got = Q.shortest_paths(graph[1], spark.createDataFrame(asked, "doc_id string, start string, end string")).collect()
    assert {(r.doc_id, r.start, r.end): r.hops for r in got} == want
    for r in got:
        assert r.path[0] == r.start and r.path[-1] == r.end
        assert all((r.doc_id, y) in adj[r.doc_id, x] for x, y in zip(r.path, r.path[1:]))
    hops = Q.path_links(spark.createDataFrame(got), graph[1]).collect()
    assert len(hops) == sum(want.values()) and all(h.link_id for h in hops)


def test_views_and_summaries(spark, graph):
    nodes, links = graph
    lab = Q.components(nodes, links)
    s = Q.component_summary(nodes, links, lab).collect()
    assert sum(r.node_count for r in s) == nodes.count()
    core = Q.select_view(nodes, links, "core")[0]
    best = {r.doc_id: r.component for r in s if r["rank"] == 1}
    assert {(r.doc_id, r.id) for r in core.collect()} == {(r.doc_id, r.id) for r in lab.collect() if best[r.doc_id] == r.component}
    other = {r.doc_id: r.component for r in s if r["rank"] == 2}
    asked = spark.createDataFrame([("p", other["p"])], "doc_id string, component string")
    view = {(r.doc_id, r.id) for r in Q.select_view(nodes, links, "component", asked)[0].collect()}
    assert view == {(r.doc_id, r.id) for r in lab.collect() if r.component == (other["p"] if r.doc_id == "p" else best["q"])}
    assert Q.select_view(nodes, links, "all") == (nodes, links)


def test_filters_and_search(graph):
    nodes, links = graph
    assert Q.filter_links(links, []).count() == 0
    assert {r.tag for r in Q.filter_links(links, ["llm"]).collect()} == {"both", "llm"}
    for r in Q.filter_links(links, ["cooccurrence"], min_weight=5, min_confidence=0.3).collect():
        assert r.tag in ("cooccurrence", "both") and r.quality.confidence >= 0.3
    assert Q.search(nodes, "  ").count() == 0 and Q.search(nodes, "NAME N0").count() == 20
    assert Q.suggested_weight(links).first().min_weight == 2


def test_neighbors(graph):
    nodes, links = graph
    rows = Q.ranked_neighbors(Q.neighbor_rows(nodes, links, nodes.where("id = 'n00'"))).collect()
    assert all(r.center == "n00" and r.id != "missing" for r in rows)
    loops = links.where("source = target").count()
    known = Q.neighbor_rows(nodes, links).count()
    # A link to a missing end is one row, seen from that end.
    assert known == 2 * links.count() - 2 - loops


def test_caps(spark):
    ent = spark.createDataFrame([("d", k, k, "concept", "", ["llm"], 1) for k in "abcd"], "doc_id string, key string, name string, type string, snippet string, sources array<string>, count bigint")
    e = spark.createDataFrame([("d", "a", "b", "r", "directed", 5), ("d", "a", "c", "r", "directed", 3), ("d", "b", "c", "r", "directed", 1)], "doc_id string, source string, target string, relation_key string, direction string, weight bigint")
    kept = G.cap_nodes(ent, e, 2)
    assert {(r.key, r.degree) for r in kept.collect()} == {("a", 2), ("b", 2)}
    assert [(r.source, r.target) for r in G.cap_edges(e, kept).collect()] == [("a", "b")]


def test_exports(spark, graph):
    nodes, links = graph
    n, l = nodes.where("doc_id = 'p'"), links.where("doc_id = 'p'").withColumn("evidence", F.array().cast("array<struct<text:string>>")).withColumn("relation_key", F.lit("uses"))
    import io
    import zipfile

    z = zipfile.ZipFile(io.BytesIO(export.csv_zip(n, l)))
    head = z.read("edges.csv").decode().splitlines()[0].split(",")
    assert head == export.EDGE_COLUMNS and z.read("nodes.csv").decode().count("\n") == 15
    report = export.markdown_report("A | B", n, l)
    for part in ("## Overview", "## Central concepts", "## Communities", "## Key relationships", "## Relations"):
        assert part in report
    page = export.html_page("<x>", '{"nodes":[{"name":"</script><b>"}],"links":[]}')
    assert "</script><b>" not in page and "&lt;x&gt;" in page
    with pytest.raises(ValueError):
        export.html_page("x", "no json")


def test_link_offsets(spark):
    rows = [("d", "1", "a", "b"), ("d", "2", "b", "a"), ("d", "3", "a", "c")]
    got = {r.id: round(r.offset, 2) for r in Q.link_offsets(spark.createDataFrame(rows, "doc_id string, id string, source string, target string")).collect()}
    assert got == {"1": -0.11, "2": 0.11, "3": 0.0}


def test_paths_longer_than_64_hops(spark):
    links = spark.createDataFrame([("d", f"l{i:02d}", f"n{i:02d}", f"n{i + 1:02d}") for i in range(66)], "doc_id string, id string, source string, target string")
    asked = spark.createDataFrame([("d", "n00", "n66"), ("d", "n00", "nowhere")], "doc_id string, start string, end string")
    got = Q.shortest_paths(links, asked).collect()
    assert [(r.start, r.end, r.hops) for r in got] == [("n00", "n66", 66)]
