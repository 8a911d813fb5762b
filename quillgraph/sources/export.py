"""Exports of graphs: CSV tables and archives, JSON lines, Markdown reports, pages that stand alone.

The tables are frames and can be written at any size. The archive, the report and the page are of one document, whose
graph the caps bound.
"""

from __future__ import annotations

import csv
import html
import io
import json
import zipfile

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillgraph.operators import query as Q

NODE_COLUMNS = ["id", "name", "type", "degree", "community", "sources", "mentions", "snippet"]
EDGE_COLUMNS = [
    "id", "source", "source_name", "relation", "relation_key", "original_relation", "target", "target_name", "direction", "kind", "tag", "provenance", "weight", "confidence", "quality_score", "evidence", "snippet",
]


def csv_nodes(nodes: DataFrame) -> DataFrame:
    """Nodes as plain columns, sources between bars."""
    return nodes.select("doc_id", "id", "name", "type", "degree", "community", F.concat_ws("|", "sources").alias("sources"), F.col("count").alias("mentions"), "snippet")


def csv_edges(links: DataFrame, nodes: DataFrame) -> DataFrame:
    """Links as plain columns with the names of their ends; texts of evidence between double bars."""
    texts = F.transform(F.filter("evidence", lambda e: F.coalesce(e["text"], F.lit("")) != ""), lambda e: e["text"])
    return Q.with_names(links, nodes).select(
        "doc_id", "id", "source", "source_name", "relation", "relation_key", "original_relation", "target", "target_name", Q.direction().alias("direction"), Q.kind().alias("kind"), "tag",
        F.concat_ws("|", "provenance").alias("provenance"), "weight", F.col("quality.confidence").alias("confidence"), F.col("quality.score").alias("quality_score"), F.concat_ws(" || ", texts).alias("evidence"), "snippet",
    )


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).option("escape", '"').csv(path)


def write_graph_json(documents: DataFrame, path: str) -> None:
    """``(doc_id, graph_json)``, a line per document, a folder per document."""
    documents.select("doc_id", F.col("graph_json").alias("value")).write.mode("overwrite").partitionBy("doc_id").text(path)


def _csv(rows: list, columns: list[str]) -> str:
    out = io.StringIO()
    w = csv.writer(out, lineterminator="\n")
    w.writerow(columns)
    w.writerows([["" if r[c] is None else r[c] for c in columns] for r in rows])
    return out.getvalue()


def csv_zip(nodes: DataFrame, links: DataFrame) -> bytes:
    """An archive of both tables of one document."""
    data = io.BytesIO()
    with zipfile.ZipFile(data, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("nodes.csv", _csv(csv_nodes(nodes).orderBy(F.desc("degree"), "name", "id").collect(), NODE_COLUMNS))
        z.writestr("edges.csv", _csv(csv_edges(links, nodes).orderBy(F.desc("weight"), "id").collect(), EDGE_COLUMNS))
    return data.getvalue()


def _cell(v) -> str:
    return "" if v is None else str(v).replace("|", "\\|").replace("\n", " ")


def _table(head: list[str], rows: list[list]) -> list[str]:
    return ["| " + " | ".join(head) + " |", "|" + "---|" * len(head), *("| " + " | ".join(map(_cell, r)) + " |" for r in rows), ""]


def overview(nodes: DataFrame, links: DataFrame) -> DataFrame:
    from quillgraph.operators.graph import graph_stats

    return graph_stats(nodes, links)


def markdown_report(name: str, nodes: DataFrame, links: DataFrame, llm_enabled: bool = False, stats: dict | None = None) -> str:
    """The report of one document: counts, central nodes, communities, relations and how they were made."""
    o = overview(nodes, links).first()
    s = stats or {}
    rows = [
        ["Nodes", o["nodes"] if o else 0], ["Edges", o["edges"] if o else 0], ["Communities", o["communities"] if o else 0], ["Chunks", s.get("chunks", 0)], ["Raw model edges", s.get("llm_edges", 0)],
        ["Raw co-occurrence edges", s.get("cooc_edges", 0)], ["Mode", "model and statistics" if llm_enabled else "statistics"], ["Graph schema", f"v{s.get('graph_schema_version', 1)}"], ["Assertions", o["directed_edges"] if o else 0], ["Associations", o["association_edges"] if o else 0],
    ]
    out = [f"# {name}: graph report", "", "## Overview", "", *_table(["Metric", "Value"], rows)]
    out += ["## Central concepts", "", *_table(["Concept", "Type", "Degree", "Mentions"], [[r["name"], r["type"], r["degree"], r["mentions"]] for r in Q.god_nodes(nodes).orderBy("rank").collect()])]
    out += ["## Communities", ""]
    for r in Q.community_members(nodes).orderBy("community").collect():
        out += [f"### Community {r['community']}: {r['size']} nodes", "", r["members"] + (f" (+{r['more']} more)" if r["more"] else ""), ""]
    keys = Q.key_relationships(nodes, links).orderBy("rank").collect()
    head = ["Source", "Relation", "Target", "Semantics", "Provenance", "Weight", "Confidence", "Evidence"]
    out += ["## Key relationships", "", *_table(head, [[r[c] for c in ("source_name", "relation", "target_name", "semantics", "provenance", "weight", "confidence", "snippet")] for r in keys])]
    rel = Q.top_relations(links).orderBy("rank").collect()
    out += ["## Relations", "", *_table(["Relation", "Count"], [[r["relation"], r["n"]] for r in rel])]
    how = "Relations stated in the text were found by a language model; associations by how near names stand." if llm_enabled else "Associations were found by how near names stand; no language model was asked."
    out += ["## Method", "", how, "", "## Questions to ask", "", "- Which concepts join two communities?", "- Which strong associations have no stated relation?", "- Which relations rest on a single piece of evidence?", ""]
    return "\n".join(out)


_PAGE = """<!doctype html>
<html lang="en"><head><meta charset="utf-8"><title>@TITLE@</title>
<style>body{font:14px sans-serif;margin:2em;max-width:75em}td,th{padding:.2em .8em;text-align:left;border-bottom:1px solid #ccc}fieldset{display:inline-block;margin:.3em}tr.on{background:#eee}</style></head>
<body><h1>@TITLE@</h1>
<fieldset><legend>Find</legend><input id="q" placeholder="search"> <select id="view"><option>all</option><option>core</option></select></fieldset>
<fieldset><legend>Links</legend><span id="tags"></span> <select id="rel"></select> weight <input id="w" type="number" min="0" value="0" size="4"> confidence <input id="c" type="number" min="0" max="1" step="0.05" value="0"></fieldset>
<fieldset><legend>Path</legend><select id="from"></select> to <select id="to"></select> <span id="path"></span></fieldset>
<p id="n"></p><table id="t"></table><h2 id="who"></h2><table id="nb"></table><h2>Communities</h2><p id="legend"></p>
<script id="graph" type="application/json">@DATA@</script>
<script>
const G=JSON.parse(document.getElementById("graph").textContent),$=id=>document.getElementById(id),byId=new Map(G.nodes.map(x=>[x.id,x]));
const end=(table,cells,head)=>{const r=table.insertRow();for(const v of cells){const c=document.createElement(head?"th":"td");c.textContent=v??"";r.append(c);}return r;};
const option=(sel,v,text)=>{const o=document.createElement("option");o.value=v;o.textContent=text??v;sel.append(o);};
const kind=l=>l.kind??((l.direction??(l.tag==="cooccurrence"?"undirected":"directed"))==="undirected"?"association":"assertion");
const sure=l=>l.quality?.confidence??0;
let chosen=null;
for(const t of ["llm","cooccurrence","manual"]){const l=document.createElement("label"),i=document.createElement("input");i.type="checkbox";i.checked=true;i.id="tag-"+t;i.onchange=show;l.append(i,t+" ");$("tags").append(l);}
option($("rel"),"","any relation");for(const r of [...new Set(G.links.map(l=>l.relation))].sort())option($("rel"),r);
for(const x of [...G.nodes].sort((a,b)=>a.name.localeCompare(b.name))){option($("from"),x.id,x.name);option($("to"),x.id,x.name);}
const near=new Map(G.nodes.map(x=>[x.id,[]]));
for(const l of G.links)if(near.has(l.source)&&near.has(l.target)){near.get(l.source).push(l.target);near.get(l.target).push(l.source);}
function reach(start){const seen=new Set([start]),todo=[start];while(todo.length)for(const y of near.get(todo.pop()))if(!seen.has(y)){seen.add(y);todo.push(y);}return seen;}
function core(){let best=new Set();const left=new Set(byId.keys());while(left.size){const part=reach(left.values().next().value);for(const x of part)left.delete(x);if(part.size>best.size)best=part;}return best;}
const CORE=core();
function shown(){const on=t=>$("tag-"+t)?.checked,w=+$("w").value,c=+$("c").value,rel=$("rel").value;
return G.links.filter(l=>(on(l.tag)||(l.tag==="both"&&(on("llm")||on("cooccurrence"))))&&(!rel||l.relation===rel)&&(kind(l)==="assertion"||l.weight>=w)&&sure(l)>=c);}
function path(){const a=$("from").value,b=$("to").value,from=new Map([[a,null]]),todo=[a];
for(let i=0;i<todo.length&&!from.has(b);i++)for(const y of [...near.get(todo[i])].sort())if(!from.has(y)){from.set(y,todo[i]);todo.push(y);}
if(!from.has(b)){$("path").textContent="no path";return;}
const way=[];for(let x=b;x!==null;x=from.get(x))way.unshift(byId.get(x).name);$("path").textContent=way.join(" – ");}
function neighbours(links){$("nb").replaceChildren();$("who").textContent=chosen?"Neighbours of "+byId.get(chosen).name:"";if(!chosen)return;end($("nb"),["Name","Relation","Direction","Weight","Confidence","Snippet"],true);
const rows=links.filter(l=>l.source===chosen||l.target===chosen).map(l=>[byId.get(l.source===chosen?l.target:l.source)?.name??"",l,l.direction==="undirected"?"both":l.source===chosen?"out":"in"]);
rows.sort((a,b)=>(kind(b[1])==="assertion")-(kind(a[1])==="assertion")||sure(b[1])-sure(a[1])||b[1].weight-a[1].weight||a[0].localeCompare(b[0]));
for(const [name,l,way] of rows)end($("nb"),[name,l.relation,way,l.weight,sure(l),l.snippet]);}
function show(){const s=$("q").value.trim().toLowerCase(),links=shown();$("t").replaceChildren();end($("t"),["Name","Type","Degree","Community"],true);let n=0;
for(const x of G.nodes){if((s&&!x.name.toLowerCase().includes(s))||($("view").value==="core"&&!CORE.has(x.id)))continue;n++;const r=end($("t"),[x.name,x.type,x.degree,x.community]);if(x.id===chosen)r.className="on";r.onclick=()=>{chosen=x.id;show();};}
$("n").textContent=n+" of "+G.nodes.length+" nodes, "+links.length+" of "+G.links.length+" links";neighbours(links);}
$("legend").textContent=[...new Set(G.nodes.map(x=>x.community))].sort((a,b)=>a-b).map(c=>c+" ("+G.nodes.filter(x=>x.community===c).length+")").join(", ");
for(const id of ["q","view","rel","w","c"])$(id).oninput=show;$("from").onchange=$("to").onchange=path;show();
</script></body></html>
"""


def html_page(name: str, graph_json: str) -> str:
    """A page that shows one document's graph; its title is escaped and its data can't end the script."""
    json.loads(graph_json)
    return _PAGE.replace("@TITLE@", html.escape(name)).replace("@DATA@", graph_json.replace("<", "\\u003c"))
