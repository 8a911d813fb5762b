import io
import json
import zipfile
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from quillgraph.operators import extraction as E
from quillgraph.operators import keywords as K
from quillgraph.plans.engine import GraphEngine, NotReady
from quillgraph.plans.pipeline import build
from quillgraph.sources import catalog
from quillgraph.sources import documents as D
from quillgraph.sources.catalog import Settings
from quillgraph.streaming import ingest

TEXT = "Knowledge graphs link facts.\n\nKnowledge graphs help search engines. Search engines rank pages.\n\nRanking pages needs knowledge graphs."


def zipped(files):
    b = io.BytesIO()
    with zipfile.ZipFile(b, "w") as z:
        for n, s in files.items():
            z.writestr(n, s)
    return b.getvalue()


def docx():
    w = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
    p = lambda t: f"<w:p><w:r><w:t>{t}</w:t></w:r></w:p>"
    return zipped({"word/document.xml": f"<w:document {w}><w:body>{p('One')}{p(' ')}<w:tbl><w:tr><w:tc>{p('a')}</w:tc><w:tc>{p('b')}</w:tc></w:tr></w:tbl>{p('Two')}</w:body></w:document>"})


def pptx():
    a = 'xmlns:a="http://schemas.openxmlformats.org/drawingml/2006/main"'
    s = lambda t: f"<s {a}><a:p><a:r><a:t>{t}</a:t></a:r><a:r><a:t>!</a:t></a:r></a:p></s>"
    return zipped({"ppt/slides/slide10.xml": s("ten"), "ppt/slides/slide2.xml": s("two")})


@pytest.mark.parametrize(
    ("ext", "raw", "text", "kind"),
    [
        (".txt", b"  a  \n\n\n\nb ", "a\n\nb", "txt"), (".md", "# Té".encode(), "# Té", "txt"), (".txt", "caf\xe9".encode("cp1252"), "café", "txt"),
        (".HTML", b"<title>T</title><style>x{}</style><p>a &amp; b</p><script>1</script>c<br>d", "T\na & b\nc\nd", "html"), (".docx", docx(), "One\nTwo\na | b", "docx"), (".pptx", pptx(), "two!\nten!", "pptx"),
    ],
)
def test_readers(ext, raw, text, kind):
    assert D.read_bytes(ext, raw)[0::2] == (text, kind)
    assert D.read_bytes(ext, raw)[3] is None


@pytest.mark.parametrize(("ext", "raw"), [(".xyz", b"x"), (".doc", b"\xd0\xcf"), (".txt", b" \n"), (".txt", b""), (".docx", b"no zip"), ("", b"x"), (".txt", None)])
def test_bad_files(ext, raw):
    text, _, _, error = D.read_bytes(ext, raw)
    assert text is None and error


def test_parse_files(spark, tmp_path):
    (tmp_path / "a.txt").write_text("some words here")
    (tmp_path / "b.xyz").write_text("?")
    rows = {r.path.rsplit("/", 1)[1]: r for r in D.read_documents(spark, str(tmp_path)).collect()}
    assert rows["a.txt"].words == 3 and rows["a.txt"].error is None and rows["b.xyz"].error and len(rows["a.txt"].doc_id) == 12


@pytest.mark.parametrize(
    ("answer", "entities", "relations"),
    [
        ('{"entities":[{"name":"A"},{"name":"B","type":"person"}],"relations":[{"source":"A","target":"B","relation":"Knows"}]}', 2, 1),
        ('Here:\n```json\n{"entities":[{"name":"A"}]}\n```', 1, 0), ("{'entities': [{'name': 'A', type: concept,},], }", 1, 0), ('{"entities":[{"name":"A"},{"name":""},5],"relationships":[{"source":"A","target":"a","relation":"x"}]}', 1, 0),
        ('{"entities":[' + ",".join('{"name":"n%d"}' % i for i in range(50)) + "]}", 30, 0), ('{"entities": [{"name": "A"}, {"name": "B", "snippet": "cut}', 2, 0),
    ],
)
def test_answers(answer, entities, relations):
    got = E.parse_answer(answer)
    assert (len(got["entities"]), len(got["relations"])) == (entities, relations)


@pytest.mark.parametrize("answer", ["", "no json", "[]", None, "}{"])
def test_no_answer(answer):
    assert E.parse_answer(answer) is None


def test_asking_again_and_throttling():
    answers = iter(["nonsense", '{"entities":[{"name":"A"}]}'])
    assert len(E.ask(lambda s, u: next(answers), "x", 0)["entities"]) == 1
    waits = []
    pace = E.Pace(sleep=waits.append)

    def busy(s, u):
        raise E.Throttled("slow down")

    assert E.ask(busy, "x", 0, pace)["error"] == "slow down" and waits == [0.5, 1.0]
    assert E.ask(lambda s, u: 1 / 0, "x", 0)["error"]


def provider(system, user):
    return json.dumps({"entities": [{"name": "Search Engine", "type": "technology", "snippet": "s"}], "relations": [{"source": "Search Engine", "target": "Web Page", "relation": "ranks"}]})


def test_extraction_and_cache(spark):
    ch = spark.createDataFrame([("d", 0, "same"), ("d", 1, "same"), ("e", 0, "other")], "doc_id string, chunk_index int, text string")
    got = E.extract(ch, provider, "m").persist()
    assert got.count() == 3 and all(len(r.entities) == 1 for r in got.collect())
    cache = spark.createDataFrame(E.cache_rows(got, "m").where(F.col("cache_key") != "").collect(), "cache_key string, model string, entities array<struct<name:string,type:string,snippet:string>>, relations " + got.schema["relations"].dataType.simpleString())
    assert cache.count() == 2

    def never(system, user):
        raise RuntimeError("asked")

    again = E.extract(ch, never, "m", cache).collect()
    assert all(r.hit and r.error is None for r in again)
    assert {(r.doc_id, r.evidence[0].chunk_index) for r in E.raw_relations(got).collect() if r.evidence} <= {("d", 0), ("d", 1), ("e", 0)}


def test_slides_shape_by_shape():
    """Text and tables come in the order of the shapes, cells between bars; groups and fields are no text."""
    import io
    import zipfile

    p = lambda x: f"<a:p><a:r><a:t>{x}</a:t></a:r></a:p>"
    sp = lambda *x: f"<p:sp><p:txBody>{''.join(map(p, x))}</p:txBody></p:sp>"
    row = "<a:tr>" + "".join(f"<a:tc><a:txBody>{p(c)}</a:txBody></a:tc>" for c in ("k", " ", "v")) + "</a:tr>"
    table = f"<p:graphicFrame><a:graphic><a:graphicData><a:tbl>{row}</a:tbl></a:graphicData></a:graphic></p:graphicFrame>"
    field = "<p:sp><p:txBody><a:p><a:r><a:t>page</a:t></a:r><a:fld><a:t>7</a:t></a:fld></a:p></p:txBody></p:sp>"
    slide = f'<p:sld xmlns:a="http://schemas.openxmlformats.org/drawingml/2006/main" xmlns:p="http://schemas.openxmlformats.org/presentationml/2006/main"><p:cSld><p:spTree>{sp("one", " ", "two")}{table}<p:grpSp>{sp("grouped")}</p:grpSp>{field}{sp("last")}</p:spTree></p:cSld></p:sld>'
    data = io.BytesIO()
    with zipfile.ZipFile(data, "w") as z:
        z.writestr("ppt/slides/slide1.xml", slide)
    assert D.read_bytes(".pptx", data.getvalue())[0] == "one\ntwo\nk | v\npage\nlast"


def test_cells_of_pages_stay_in_their_row():
    assert D.html_to_text("<table><tr><td>a</td><td>b</td></tr><tr><th>c</th></tr></table><nav>x</nav>y<p>z<script>1</script>") == "ab\nc\nxy\nz"


def test_keywords(spark):
    docs = spark.createDataFrame([("d", TEXT), ("e", ""), ("f", None), ("g", "the of and")], "doc_id string, text string")
    rows = K.keywords(docs, 10).orderBy("doc_id", "rank").collect()
    assert {r.doc_id for r in rows} == {"d"}
    names = [r.name for r in rows]
    assert len(set(names)) == len(names) <= 10 and "knowledge graphs" in names
    assert [r["rank"] for r in rows] == list(range(1, len(rows) + 1)) and [r.score for r in rows] == sorted(r.score for r in rows)
    assert {r.name: r["count"] for r in rows}["knowledge graphs"] == 3
    assert rows == K.keywords(docs, 10).orderBy("doc_id", "rank").collect()


def test_pipeline(spark):
    docs = spark.createDataFrame([("d", TEXT), ("e", "  ")], "doc_id string, text string")
    g = build(docs, Settings(max_keywords=8), provider, "m")
    nodes, links = g.nodes.collect(), g.links.collect()
    ids = {n.id for n in nodes}
    assert nodes and links and all(x.source in ids and x.target in ids for x in links)
    assert {n.doc_id for n in nodes} == {"d"} and any(n.name == "Web Page" for n in nodes)
    assert any("llm" in x.provenance for x in links)


def test_engine(spark, tmp_path):
    src = tmp_path / "in"
    src.mkdir()
    (src / "a.txt").write_text(TEXT)
    (src / "b.doc").write_text("x")
    e = GraphEngine(spark, str(tmp_path / "store"), Settings(max_keywords=8))
    e.add(str(src))
    rows = {r.name: r for r in e.documents().collect()}
    assert rows["a.txt"].status == "done" and rows["b.doc"].status == "error" and rows["a.txt"].node_count > 0
    d = rows["a.txt"].id
    nodes, links = e.graph(d)
    first = links.first()
    assert e.shortest_path(d, first.source, first.target) == [first.source, first.target]
    assert e.shortest_path(d, first.source, "nowhere") is None
    assert e.neighbors(d, first.source).count() >= 1 and e.filter_links(d, tags=["cooccurrence"]).count() == links.count()
    assert "## Overview" in e.export_report(d) and "<table" in e.export_html(d) and e.export_csv(d)[:2] == b"PK"
    with pytest.raises(NotReady):
        e.graph(rows["b.doc"].id)
    with pytest.raises(NotReady):
        e.status("nothing")
    e.reprocess(d)
    assert e.sweep() == 0
    e.delete(d)
    assert [r.name for r in e.documents().collect()] == ["b.doc"]


def test_engine_keeps_its_history(spark, tmp_path):
    """Sizes are of the files, the first time of a document stays, statuses are logged step by step, statistics reach the report, nothing is rewritten."""
    src = tmp_path / "in"
    src.mkdir()
    (src / "a.txt").write_text(TEXT + "  \n\n\n\n")
    asked = []
    e = GraphEngine(spark, str(tmp_path / "store"), Settings(max_keywords=8))
    e.add(str(src))
    row = e.documents().first()
    assert row["size"] == len((TEXT + "  \n\n\n\n").encode()) and row["progress"] == 1.0
    log = [r.status for r in e.store.read("catalog").orderBy("updated_at").collect()]
    assert log == ["queued", "extracting", "clustering", "done"]
    stats = json.loads(row["stats_json"])
    assert stats["chunks"] == 1 and stats["cooc_edges"] > 0 and stats["nodes"] == row["node_count"] and "| Chunks | 1 |" in e.export_report(row.id) and "| Graph schema | v2 |" in e.export_report(row.id)
    before = {n.id for n in e.graph(row.id)[0].collect()}
    e.reprocess(row.id)
    again = e.documents().first()
    assert again.created_at == row.created_at and again.updated_at > row.updated_at and {n.id for n in e.graph(row.id)[0].collect()} == before
    # Rows of a run without its entry, as after a crash, don't count.
    nodes = e.store.read("nodes")
    nodes.withColumn("run", F.lit("broken")).withColumn("bucket", e.store._bucket(F.col("doc_id"))).write.mode("append").partitionBy("bucket").parquet(str(tmp_path / "store/nodes"))
    assert e.store.read("nodes").count() == len(before)
    e.store.compact("nodes")
    assert e.store.read("nodes", row.id).count() == len(before) and {n.id for n in e.graph(row.id)[0].collect()} == before
    e.delete(row.id)
    assert e.documents().count() == 0 and e.store.read("nodes").count() == 0 and e.sweep() == 0
    with pytest.raises(NotReady):
        e.graph(row.id)
    e.add(str(src))
    assert e.documents().first().created_at > row.created_at and asked == []


def test_answers_are_saved_at_once_and_the_last_holds(spark, tmp_path):
    src = tmp_path / "in"
    src.mkdir()
    (src / "a.txt").write_text(TEXT)
    e = GraphEngine(spark, str(tmp_path / "store"), Settings(max_keywords=8), provider, "m")
    e.add(str(src))
    cache = e.store.read("llm_cache")
    assert cache.count() == 1 and "saved_at" in cache.columns
    e.reprocess(e.documents().first().id)
    assert e.store.read("llm_cache").count() == 1  # asked once
    stats = json.loads(e.documents().first().stats_json)
    assert stats["llm_cache_hits"] == 1 and stats["llm_cache_misses"] == 0 and stats["llm_edges"] > 0


def test_slots_halve_and_grow():
    waits = []
    s = E.Slots(8, sleep=waits.append)
    for want in (4, 2, 1, 1):
        with pytest.raises(E.Throttled), s:
            raise E.Throttled("slow down")
        assert s.allowed == want
    assert waits == [0.5, 1.0, 2.0, 4.0] and s.events == 4
    for n, want in ((3, 1), (1, 2), (4, 3), (6, 4)):
        for _ in range(n):
            with s:
                pass
        assert s.allowed == want
    with pytest.raises(ValueError), s:
        raise ValueError
    assert s.allowed == 4 and s.active == 0


def test_json_mode_first():
    calls = []

    def model(system, user, json_mode=False):
        calls.append(json_mode)
        if json_mode:
            raise ValueError("no such mode")
        return '{"entities": [{"name": "A"}], "relations": []}'

    assert E.ask(model, "x", 0)["entities"][0]["name"] == "A" and calls == [True, False]

    def busy(system, user, json_mode=False):
        calls.append("busy")
        raise E.Throttled("later")

    assert E.ask(busy, "x", 0, E.Slots(sleep=lambda s: None))["error"] == "later" and calls[2:] == ["busy", "busy"]


def test_run_metrics(spark):
    rows = [("d", None, False, 2.0), ("d", "bad", False, 4.0), ("d", None, True, 0.0)]
    a = spark.createDataFrame(rows, "doc_id string, error string, hit boolean, seconds double")
    m = E.run_metrics(a, spark.createDataFrame([("d", 9)], "doc_id string, chunks int"), 2).first()
    assert (m.chunks, m.errors, m.cache_hits, m.cache_misses, m.avg_seconds, m.max_seconds, m.eta_seconds) == (3, 1, 1, 2, 3.0, 4.0, 9.0)


def test_catalog(spark):
    t = lambda h: datetime(2024, 1, 1, h)
    log = spark.createDataFrame([("a", "queued", t(1)), ("a", "done", t(3)), ("a", "parsing", t(2)), ("b", "parsing", t(1)), ("b", "queued", t(1)), ("b", "queued", t(1))], "id string, status string, updated_at timestamp")
    last = catalog.latest_status(log)
    assert {(r.id, r.status) for r in last.collect()} == {("a", "done"), ("b", "parsing")}
    assert [r.id for r in catalog.stale(last, F.lit(t(2))).collect()] == ["b"]
    swept = catalog.sweep_rows(last, F.lit(t(5))).collect()
    assert [(r.id, r.status, r.error) for r in swept] == [("b", "error", "interrupted")]


def test_settings(tmp_path):
    f = tmp_path / ".env"
    f.write_text("# c\nMAX_NODES=5\nMAX_EDGES='7'\n")
    s = Settings.from_env({"MAX_NODES": "9"}, str(f))
    assert (s.max_nodes, s.max_edges, s.chunk_chars) == (9, 7, 4000)


def test_stream_of_files(spark, tmp_path):
    src = tmp_path / "in"
    src.mkdir()
    (src / "a.txt").write_text("one two")
    seen = []
    run = lambda: ingest.ingest_files(spark, str(src), str(tmp_path / "cp"), lambda df, n: seen.extend(r.text for r in df.collect())).awaitTermination()
    run()
    (src / "b.txt").write_text("three")
    run()
    run()
    assert seen == ["one two", "three"]


def test_keywords_among_many_near_copies(spark):
    near = ["".join("cd"[i >> b & 1] for b in range(6)) for i in range(64)]
    text = " ".join(f"Harbourmasterregulation{x} rose." for x in near) + " Then zebra met lion near the river mill."
    rows = K.keywords(spark.createDataFrame([("d", text)], "doc_id string, text string"), 2).collect()
    assert len(rows) == 2
