"""Associations of names from how near each other they stand in a document.

``held`` are units with the names that they hold as an array (``units.held_names``).
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillgraph.functions.reuse import reused
from quillgraph.functions.text import ustrip

from .units import array_pairs

WINDOW_CAP = 3  # windows overlap, so more of them say no more
PARAGRAPH_CAP = 8  # a paragraph with more names links none
MAX_EVIDENCE = 3
TEXT = 300  # characters of an evidence text
MIN_SCORE = 2
DEGREE_CAP = 8


def window_members(held: DataFrame, size: int = 2) -> DataFrame:
    """Names by the start of every sliding window of ``size`` units that covers them, ``(doc_id, start, n_units, found)``; no window in shorter documents."""
    starts = F.sequence(F.greatest(F.lit(0), F.col("unit_ord") - (size - 1)), F.least(F.col("unit_ord"), F.col("n_units") - size))
    m = held.where(F.col("n_units") >= size).select("doc_id", "n_units", F.explode(starts).alias("start"), "found")
    return m.groupBy("doc_id", "start").agg(F.max("n_units").alias("n_units"), _together("found"))


def paragraph_members(held: DataFrame) -> DataFrame:
    """Names of the paragraphs that hold no more than the cap, with the place of the first unit: ``(doc_id, paragraph_index, first, n_units, found)``."""
    g = held.groupBy("doc_id", "paragraph_index").agg(F.max("n_units").alias("n_units"), F.min(F.col("unit_ord") - F.col("sentence_index")).alias("first"), _together("found"))
    return g.where(F.size("found") <= PARAGRAPH_CAP)


def _together(column: str):
    return F.array_sort(F.array_distinct(F.flatten(F.collect_list(column)))).alias(column)


def _counted(pairs_: DataFrame) -> DataFrame:
    return pairs_.groupBy("doc_id", "a", "b").agg(F.count(F.lit(1)).alias("n"))


def sentence_support(held: DataFrame) -> DataFrame:
    """Units that hold both names: ``(doc_id, a, b, n)``."""
    return _counted(array_pairs(held, ["doc_id"]))


def window_support(held: DataFrame, size: int = 2) -> DataFrame:
    """Windows that hold both names, up to the cap: ``(doc_id, a, b, n)``."""
    return _counted(array_pairs(window_members(held, size), ["doc_id"])).withColumn("n", F.least(F.lit(WINDOW_CAP), "n"))


def paragraph_support(held: DataFrame) -> DataFrame:
    return _counted(array_pairs(paragraph_members(held), ["doc_id"]))


def pair_scores(held: DataFrame, size: int = 2, min_score: int = MIN_SCORE) -> DataFrame:
    """Qualified pairs with their supports and score 4 x sentences + 2 x windows + paragraphs.

    The three supports are counted in one aggregation of the union of the pairs, combined before the shuffle. A pair
    qualifies by a sentence, by windows (two in documents of more than twenty units) or by two paragraphs.
    """
    keys = ["doc_id", "n_units"]
    parts = [(held, "s"), (window_members(held, size), "w"), (paragraph_members(held), "p")]
    one = reduce(DataFrame.unionByName, (array_pairs(df, keys).withColumn("kind", F.lit(k)) for df, k in parts))
    n = lambda k: F.count_if(F.col("kind") == k)
    s = one.groupBy("doc_id", "a", "b").agg(F.max("n_units").alias("n_units"), n("s").alias("sentence_support"), n("w").alias("w"), n("p").alias("paragraph_support"))
    s = s.withColumn("window_support", F.least(F.lit(WINDOW_CAP).cast("bigint"), "w"))
    s = s.withColumn("weight", 4 * F.col("sentence_support") + 2 * F.col("window_support") + F.col("paragraph_support"))
    least = F.when(F.col("n_units") <= 20, 1).otherwise(2)
    ok = (F.col("weight") >= min_score) & ((F.col("sentence_support") > 0) | (F.col("window_support") >= least) | (F.col("paragraph_support") >= 2))
    s = s.where(ok).withColumn("support_count", F.col("sentence_support") + F.col("window_support") + F.col("paragraph_support"))
    return s.select("doc_id", F.col("a").alias("source"), F.col("b").alias("target"), "weight", "support_count", "sentence_support", "window_support", "paragraph_support")


def place_texts(units: DataFrame) -> DataFrame:
    """What evidence quotes, to ``TEXT`` characters: ``(doc_id, place, kind, paragraph_index, sentence_index, text)``.

    A unit, a window of two units at the place of the first, and a paragraph at the place of its first unit; in a
    paragraph a unit that equals the text before it isn't repeated. Places are ordinals of units.
    """
    u = units.select("doc_id", "unit_ord", "paragraph_index", "sentence_index", F.substring(ustrip(F.col("text")), 1, TEXT).alias("text"))
    w = Window.partitionBy("doc_id").orderBy("unit_ord")
    both = u.withColumn("next", F.lead("text").over(w))
    cut = lambda c: F.substring(c, 1, TEXT).alias("text")
    single = both.select("doc_id", F.col("unit_ord").alias("place"), F.explode(F.array(F.struct(F.lit("s").alias("kind"), "text"), F.when(F.col("next").isNotNull(), F.struct(F.lit("w").alias("kind"), cut(F.concat_ws(" ", "text", "next")))))).alias("x"), "paragraph_index", "sentence_index")
    single = single.where("x is not null").select("doc_id", "place", "x.kind", "paragraph_index", "sentence_index", "x.text")
    g = u.groupBy("doc_id", "paragraph_index").agg(F.min(F.col("unit_ord") - F.col("sentence_index")).alias("place"), F.array_sort(F.collect_list(F.struct("sentence_index", "text"))).alias("s"))
    joined = F.aggregate(F.transform("s", lambda x: x["text"]), F.lit(None).cast("string"), lambda acc, t: F.when(acc.isNull() | (acc == t), t).otherwise(F.concat_ws(" ", acc, t)))
    return single.unionByName(g.select("doc_id", "place", F.lit("p").alias("kind"), "paragraph_index", F.lit(0).alias("sentence_index"), cut(joined)))


def pair_evidence(held: DataFrame, units: DataFrame, links: DataFrame | None = None) -> DataFrame:
    """The first places of each pair: ``(doc_id, source, target, evidence)``, an array of (paragraph, sentence, text).

    Only pairs of ``links(doc_id, source, target)`` where given. A place has three texts at most, so those of the first
    three places hold the first three items; only these places get their texts.
    """
    window = window_members(held).withColumnRenamed("start", "place")
    paragraph = paragraph_members(held).withColumnRenamed("first", "place")
    parts = [(held.withColumnRenamed("unit_ord", "place"), "s"), (window, "w"), (paragraph, "p")]
    one = reduce(DataFrame.unionByName, (array_pairs(df, ["doc_id", "place"]).withColumn("kind", F.lit(k)) for df, k in parts))
    if links is not None:
        one = one.join(links.select("doc_id", F.col("source").alias("a"), F.col("target").alias("b")), ["doc_id", "a", "b"], "left_semi")
    w = Window.partitionBy("doc_id", "a", "b").orderBy("place")
    first = one.withColumn("r", F.dense_rank().over(w)).where(F.col("r") <= MAX_EVIDENCE).drop("r")
    item = F.struct("paragraph_index", "sentence_index", "text").alias("item")
    both = first.join(place_texts(units), ["doc_id", "place", "kind"]).select("doc_id", F.col("a").alias("source"), F.col("b").alias("target"), item)
    return both.groupBy("doc_id", "source", "target").agg(F.slice(F.array_sort(F.collect_set("item")), 1, MAX_EVIDENCE).alias("evidence"))


def greedy_links(scored: DataFrame, cap: int = DEGREE_CAP) -> DataFrame:
    """Pairs accepted by walking a document's pairs from the heaviest: both ends must have fewer than ``cap`` so far.

    The walk is sequential by its definition. A document's pairs come sorted through one sort of the partition and are
    read as a stream; only the degrees of the document at hand are held, so a document of any size is walked without
    being collected.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import pyarrow as pa

        doc, degree = None, {}
        for b in batches:
            keep = []
            for d, s, t in zip(b.column("doc_id").to_pylist(), b.column("source").to_pylist(), b.column("target").to_pylist()):
                if d != doc:
                    doc, degree = d, {}
                ok = degree.get(s, 0) < cap and degree.get(t, 0) < cap
                if ok:
                    degree[s] = degree.get(s, 0) + 1
                    degree[t] = degree.get(t, 0) + 1
                keep.append(ok)
            yield b.filter(pa.array(keep))

    ordered = scored.repartition("doc_id").sortWithinPartitions("doc_id", F.desc("weight"), "source", "target")
    return ordered.mapInArrow(run, scored.schema)


def association_edges(held: DataFrame, units: DataFrame) -> DataFrame:
    """Association edges of documents with their evidence, ready to be merged with others."""
    links = reused(greedy_links(pair_scores(held)))
    e = links.join(pair_evidence(held, units, links), ["doc_id", "source", "target"], "left")
    item = lambda x: F.struct(
        x["text"].alias("text"), F.lit("cooccurrence").alias("source"), F.lit(None).cast("int").alias("chunk_index"), x["paragraph_index"].alias("paragraph_index"), x["sentence_index"].alias("sentence_index")
    )
    evidence = F.transform(F.coalesce("evidence", F.array().cast("array<struct<paragraph_index:int,sentence_index:int,text:string>>")), item)
    return e.select(
        "doc_id", "source", "target", F.lit("co-occurs with").alias("relation"), F.lit("undirected").alias("direction"), F.lit("association").alias("kind"), F.lit("cooccurrence").alias("tag"),
        "weight", "support_count", "sentence_support", "window_support", "paragraph_support", F.coalesce(F.get(evidence, F.lit(0))["text"], F.lit("")).alias("snippet"), evidence.alias("evidence"),
    )
