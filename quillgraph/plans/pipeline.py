"""From documents to graphs in one plan over all documents."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillgraph.functions.reuse import reused
from quillgraph.operators import extraction, graph, keywords, locality, merge, selection, units
from quillgraph.sources.catalog import Settings


@dataclass
class Graphs:
    """What the pipeline makes; frames that several parts read are written, the others lazy."""

    chunks: DataFrame
    selected: DataFrame
    keywords: DataFrame
    answers: DataFrame
    entities: DataFrame
    edges: DataFrame
    nodes: DataFrame
    links: DataFrame
    associations: DataFrame


def run_statistics(g: Graphs) -> DataFrame:
    """Counts of a run per document: chunks, those chosen for the model, its relations and the associations, before they were merged, and the model's calls."""
    one = lambda df, name: df.groupBy("doc_id").agg(F.count(F.lit(1)).alias(name))
    s = one(g.chunks, "chunks").join(one(g.selected.where("selected"), "llm_selected_chunks"), "doc_id", "left").join(one(extraction.raw_relations(g.answers), "llm_edges"), "doc_id", "left").join(one(g.associations, "cooc_edges"), "doc_id", "left")
    m = extraction.run_metrics(g.answers)
    m = m.select("doc_id", F.col("chunks").alias("llm_chunks"), F.col("errors").alias("llm_errors"), F.col("cache_hits").alias("llm_cache_hits"), F.col("cache_misses").alias("llm_cache_misses"), F.round("seconds", 3).alias("llm_seconds"), F.round("avg_seconds", 3).alias("llm_avg_chunk_seconds"), F.round("max_seconds", 3).alias("llm_max_chunk_seconds"))
    j = s.join(m, "doc_id", "left")
    return j.select("doc_id", *(F.coalesce(c, F.lit(0)).alias(c) for c in j.columns if c != "doc_id"))


def with_order(edges: DataFrame) -> DataFrame:
    """Association edges in the order in which they are merged."""
    return edges.withColumn("ord", (F.row_number().over(Window.partitionBy("doc_id").orderBy(F.desc("weight"), "source", "target")) - 1).cast("bigint"))


def build(docs: DataFrame, settings: Settings | None = None, provider: Callable[[str, str], str] | None = None, model: str = "none", cache: DataFrame | None = None, names: DataFrame | None = None,
    step: Callable[[str, float], None] = lambda status, progress: None, answered: Callable[[DataFrame], None] = lambda answers: None,
) -> Graphs:
    """Graphs of ``docs(doc_id, text)``. ``names(doc_id, rank, name)`` replaces the keyword ranking where given.

    Documents without text have no rows anywhere. A document's result doesn't depend on the others. ``step`` is told
    each status that the documents reach, ``answered`` a model's answers as soon as they are there.
    """
    s = settings or Settings()
    docs = docs.where("text is not null and trim(text) <> ''").select("doc_id", "text").distinct()
    ch = units.chunks(docs, s.chunk_chars, s.chunk_overlap)
    sel = selection.select_chunks(selection.chunk_scores(ch), s.extraction_mode, s.llm_chunk_fraction, s.llm_min_chunks, s.llm_max_chunks)
    step("extracting", 0.2)
    asks = provider is not None or cache is not None
    if asks:
        ch = reused(ch)
        chosen = ch.join(sel.where("selected").select("doc_id", "chunk_index"), ["doc_id", "chunk_index"], "left_semi")
        answers = reused(extraction.extract(chosen, provider, model, cache, s.llm_concurrency))  # a model must not be asked twice
        answered(answers)
    else:
        answers = extraction.no_answers(docs.sparkSession)
    llm_e, llm_r = extraction.raw_entities(answers), extraction.raw_relations(answers)
    kw = names if names is not None else keywords.keywords(docs, s.max_keywords).select("doc_id", "rank", "name")
    kw = reused(kw)
    if asks:
        kw = units.without_llm_names(kw, llm_e.select("doc_id", "name"))
    cand = units.candidate_names(kw.select("doc_id", "name").unionByName(llm_e.select("doc_id", "name")))
    u = reused(units.units(docs))
    m = reused(units.held_names(u, cand))
    assoc = with_order(locality.association_edges(m, u)).withColumn("original_relation", F.lit(None).cast("string")).withColumn("tags", F.lit(None).cast("array<string>"))
    assoc = reused(assoc.drop("sentence_support", "window_support", "paragraph_support"))
    step("clustering", 0.85)
    entities, edges = merge.merge_all(llm_e, llm_r, kw, assoc)
    entities, edges = reused(entities), reused(edges)
    nodes, links = graph.build_graph(entities, edges, s.max_nodes, s.max_edges)
    return Graphs(ch, sel, kw, answers, entities, edges, nodes, links, assoc)
