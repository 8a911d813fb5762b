import pytest
from pyspark.sql import functions as F

from quillgraph.operators import merge as M
from quillgraph.schemas import RAW_EDGE, RAW_ENTITY


def edges(spark, rows):
    base = dict(doc_id="d", ord=0, source="alpha thing", target="beta thing", relation="uses", original_relation=None, direction=None, kind=None, tag="llm", tags=None, weight=1, support_count=1, snippet="", evidence=None, origin="llm")
    return spark.createDataFrame([tuple((base | {"ord": i} | r)[c.split()[0]] for c in RAW_EDGE.split(", ") if c.split()[0] in base) for i, r in enumerate(rows)], RAW_EDGE)


def test_entities(spark):
    rows = [("d", 1, "knowledge graph", "concept", "", "yake"), ("d", 2, "Knowledge Graph", None, "s1", "llm"), ("d", 3, "The Knowledge Graph", "method", "s2", None), ("d", 4, "Knowledge Graph", "method", "s3", "llm"), ("d", 5, "other", "place", None, "llm"), ("d", 6, None, "x", "y", "z"), ("e", 1, "Other", "person", "", "llm")]
    got = {(r.doc_id, r.key): r for r in M.merge_entities(spark.createDataFrame(rows, RAW_ENTITY)).collect()}
    r = got["d", "knowledge graph"]
    assert (r["name"], r["type"], r["snippet"], r["sources"], r["count"]) == ("Knowledge Graph", "concept", "s1", ["yake", "llm"], 4)
    assert set(got) == {("d", "knowledge graph"), ("d", "other"), ("e", "other")}
    assert got["d", "other"]["snippet"] == ""


def test_inverse_labels_merge(spark):
    e = edges(spark, [{"relation": "uses", "snippet": "x"}, {"source": "Beta Thing", "target": "Alpha thing", "relation": "is used by", "snippet": "y"}, {"source": "alpha thing", "target": "The Alpha thing"}, {"relation": "!"}, {"source": None}])
    r = M.merge_edges(e).collect()
    assert len(r) == 1
    r = r[0]
    assert (r.source, r.target, r.weight, r.relation_aliases, [x.text for x in r.evidence], r.snippet) == ("alpha thing", "beta thing", 2, ["uses", "is used by"], ["x", "y"], "x")


def test_undirected_edges_and_tags(spark):
    e = edges(spark, [{"source": "b", "target": "a", "relation": "related to", "tag": "cooccurrence", "weight": 3}, {"source": "a", "target": "b", "relation": "co-occurs with", "tag": "both", "weight": 0}])
    r = M.merge_edges(e).first()
    assert (r.source, r.target, r.direction, r.kind, r.weight, r.tags) == ("a", "b", "undirected", "association", 4, ["cooccurrence", "llm"])


def test_materialised_endpoint(spark):
    e = edges(spark, [{"source": "Known", "target": "Missing one", "snippet": "seen"}])
    keys = spark.createDataFrame([("d", "known")], "doc_id string, key string")
    r = M.materialized_endpoints(e, keys).collect()
    assert [(x["name"], x["type"], x["snippet"], x["source"]) for x in r] == [("Missing one", "concept", "seen", "llm")]
    q = M.merge_edges(e, keys).first().quality
    assert q.endpoint_support == 0.5 and "endpoint materialized from relation" in q.reasons


def quality(tags, support, ev, eps, weight):
    s = 1.0 if "manual" in tags else 0.9 if tags == ["llm"] else 0.78 if "llm" in tags else 0.62
    sup, e = min(1, max(support, weight) / 3), min(1, ev / 3)
    score = round(0.35 * s + 0.25 * sup + 0.2 * e + 0.2 * eps, 3)
    return score, round(0.45 * score + 0.3 * eps + 0.25 * sup, 3)


@pytest.mark.parametrize("tags", [["llm"], ["cooccurrence"], ["llm", "cooccurrence"], ["manual"]])
def test_quality_grid(spark, tags):
    grid = [(s, e, p, w) for s in (1, 2, 3) for e in (0, 1, 2, 3) for p in (0.0, 0.5, 1.0) for w in (1, 4)]
    df = spark.createDataFrame(grid, "s bigint, e int, p double, w bigint")
    for r in df.select("*", M.quality(F.array(*map(F.lit, tags)), F.col("s"), F.col("e"), F.col("p"), F.col("w")).alias("q")).collect():
        want = quality(tags, r.s, r.e, r.p, r.w)
        assert abs(r.q.score - want[0]) < 0.0011 and abs(r.q.confidence - want[1]) < 0.0011


def test_evidence_is_clean(spark):
    ev = [(" x ", None, 1, -1, None), ("x", None, 1, None, None), ("", "llm", None, None, None), ("y" * 400, "manual", None, None, None)]
    r = M.merge_edges(edges(spark, [{"evidence": ev, "tag": "cooccurrence"}])).first()
    assert [(x.text[:3], len(x.text), x.source, x.chunk_index, x.paragraph_index) for x in r.evidence] == [("x", 1, "cooccurrence", 1, None), ("yyy", 300, "manual", None, None)]


def test_many_rows_of_one_key(spark):
    e = spark.range(5000).select(
        F.lit("d").alias("doc_id"), F.col("id").alias("ord"), F.lit("a").alias("source"), F.lit("b").alias("target"), F.lit("uses").alias("relation"), F.lit(None).cast("string").alias("original_relation"),
        F.lit(None).cast("string").alias("direction"), F.lit(None).cast("string").alias("kind"), F.lit("llm").alias("tag"), F.lit(None).cast("array<string>").alias("tags"), F.lit(1).cast("bigint").alias("weight"),
        F.lit(1).cast("bigint").alias("support_count"), F.concat(F.lit("s"), F.col("id")).alias("snippet"), F.lit(None).cast("array<struct<text:string,source:string,chunk_index:int,paragraph_index:int,sentence_index:int>>").alias("evidence"), F.lit("llm").alias("origin"),
    )
    r = M.merge_edges(e).collect()
    assert len(r) == 1 and r[0].weight == 5000 and [x.text for x in r[0].evidence] == [f"s{i}" for i in range(8)]
