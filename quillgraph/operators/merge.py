"""Raw entities and relations of many extractors merged into one set per document.

Rows carry ``ord``, the order in which they came; "first" always means least ``ord``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillgraph.functions import text as X
from quillgraph.functions.reuse import reused
from quillgraph.schemas import EVIDENCE, struct

MAX_EVIDENCE = 8
_EVIDENCE = f"array<{struct(EVIDENCE)}>"


def merge_entities(raw: DataFrame) -> DataFrame:
    """``raw(doc_id, ord, name, type, snippet, source)`` by normalised name: ``(doc_id, key, name, type, snippet, sources, count)``.

    The name and the type are the most frequent ones, the earlier on a tie; the snippet is the first that isn't empty.
    Names without a key are left out; null names count as empty, null types as "concept". Frequencies are aggregated
    before the keys are, so a frequent entity is no hot group.
    """
    r = raw.select("doc_id", "ord", X.normalize_name(F.col("name")).alias("key"), X.ustrip(F.coalesce("name", F.lit(""))).alias("name"), F.coalesce("type", F.lit("concept")).alias("type"), "snippet", "source")
    r = reused(r.where(F.col("key") != ""))  # four aggregations read the normalised rows
    mode = lambda c: r.groupBy("doc_id", "key", c).agg(F.count(F.lit(1)).alias("n"), F.min("ord").alias("o")).groupBy("doc_id", "key").agg(F.max_by(c, F.struct("n", -F.col("o"))).alias(c))
    has = F.coalesce("snippet", F.lit("")) != ""
    base = r.groupBy("doc_id", "key").agg(F.count(F.lit(1)).alias("count"), F.min_by(F.when(has, F.col("snippet")), F.when(has, F.col("ord"))).alias("snippet"))
    src = r.where("source is not null").groupBy("doc_id", "key", "source").agg(F.min("ord").alias("o")).groupBy("doc_id", "key")
    src = src.agg(F.transform(F.array_sort(F.collect_list(F.struct("o", "source"))), lambda x: x["source"]).alias("sources"))
    out = base.join(mode("name"), ["doc_id", "key"]).join(mode("type"), ["doc_id", "key"]).join(src, ["doc_id", "key"], "left")
    return out.select("doc_id", "key", "name", "type", F.coalesce("snippet", F.lit("")).alias("snippet"), F.coalesce("sources", F.array().cast("array<string>")).alias("sources"), "count")


def entity_order(entities: DataFrame) -> DataFrame:
    """Merged entities in their order within a document: the most frequent first, then by name."""
    return entities.withColumn("place", F.row_number().over(Window.partitionBy("doc_id").orderBy(F.desc("count"), "name", "key")))


def usable_edges(raw: DataFrame) -> DataFrame:
    """Raw edges both of whose ends are usable names."""
    return raw.where(X.usable_name(F.col("source")) & X.usable_name(F.col("target")))


def materialized_endpoints(raw_edges: DataFrame, entity_keys: DataFrame) -> DataFrame:
    """Ends of edges that no entity names, once each, as raw "concept" entities: the first edge gives snippet and origin.

    ``entity_keys(doc_id, key)``.
    """
    end = F.explode(F.array(F.struct(F.col("source").alias("name"), F.lit(0).alias("side")), F.struct(F.col("target").alias("name"), F.lit(1).alias("side"))))
    e = raw_edges.select("doc_id", "ord", "snippet", "origin", end.alias("e")).select("doc_id", (F.col("ord") * 2 + F.col("e.side")).alias("ord"), "snippet", "origin", "e.name")
    e = e.withColumn("key", X.normalize_name(F.col("name"))).where("key <> ''").join(entity_keys.select("doc_id", "key").distinct(), ["doc_id", "key"], "left_anti")
    first = F.min_by(F.struct("name", F.coalesce("snippet", F.lit("")).alias("snippet"), F.coalesce("origin", F.lit("llm")).alias("source")), F.col("ord"))
    g = e.groupBy("doc_id", "key").agg(F.min("ord").alias("ord"), first.alias("x"))
    return g.select("doc_id", "ord", "x.name", F.lit("concept").alias("type"), "x.snippet", "x.source")


def canonical_edges(raw: DataFrame) -> DataFrame:
    """Raw edges with normalised ends, canonical relation, direction and kind; swapped and ordered; invalid ones left out.

    An edge is invalid without an end or a relation, or if it joins a name to itself.
    """
    r = raw.withColumn("rel", X.canonical_relation(F.col("relation"))).withColumn("src", X.normalize_name(F.col("source"))).withColumn("tgt", X.normalize_name(F.col("target")))
    r = r.where("rel is not null and src <> '' and tgt <> '' and src <> tgt")
    d, k = F.lower(F.coalesce("direction", F.lit(""))), F.lower(F.coalesce("kind", F.lit("")))
    loose = (F.col("rel.relation_key") == "associated_with") | (d == "undirected") | (k == "association")
    direction = F.when(d.isin("directed", "undirected"), d).when(loose, "undirected").otherwise("directed")
    r = r.withColumn("dir", direction)
    r = r.withColumn("kind2", F.when(F.col("dir") == "undirected", "association").when(k.isin("assertion", "association"), k).otherwise("assertion"))
    flip = (F.col("rel.swap") & (F.col("dir") == "directed")) | ((F.col("dir") == "undirected") & (F.col("tgt") < F.col("src")))
    original = F.when(F.coalesce("original_relation", F.lit("")) != "", F.substring("original_relation", 1, 120)).otherwise(F.col("rel.original_relation"))
    one = lambda c: F.greatest(F.lit(1), F.coalesce(c, F.lit(1))).cast("bigint")
    return r.select(
        "doc_id", "ord", F.when(flip, F.col("tgt")).otherwise(F.col("src")).alias("source"), F.when(flip, F.col("src")).otherwise(F.col("tgt")).alias("target"),
        F.col("rel.relation").alias("relation"), F.col("rel.relation_key").alias("relation_key"), original.alias("original_relation"), F.col("dir").alias("direction"), F.col("kind2").alias("kind"),
        one("weight").alias("weight"), one("support_count").alias("support_count"), X.tag_list(F.col("tags"), F.col("tag")).alias("tags"), "snippet", "evidence",
    )


def clean_evidence(evidence: Column, snippet: Column, tags: Column) -> Column:
    """Evidence of an edge: stripped, to 300 characters, distinct, eight at most; its snippet where there is none."""
    default = F.when(F.array_contains(tags, "cooccurrence") & ~F.array_contains(tags, "llm"), "cooccurrence").otherwise("llm")
    index = lambda c: F.when(c >= 0, c)
    make = lambda x: F.struct(
        F.substring(X.ustrip(F.coalesce(x["text"], F.lit(""))), 1, 300).alias("text"), F.coalesce(F.when(x["source"] != "", x["source"]), default).alias("source"),
        index(x["chunk_index"]).alias("chunk_index"), index(x["paragraph_index"]).alias("paragraph_index"), index(x["sentence_index"]).alias("sentence_index"),
    )
    none = F.lit(None).cast("int")
    own = F.array(F.struct(F.substring(X.ustrip(snippet), 1, 300).alias("text"), default.alias("source"), none.alias("chunk_index"), none.alias("paragraph_index"), none.alias("sentence_index")))
    given = F.transform(F.coalesce(evidence, F.array().cast(_EVIDENCE)), make)
    items = F.when(F.size(given) > 0, given).when(F.coalesce(snippet, F.lit("")) != "", own).otherwise(F.array().cast(_EVIDENCE))
    return F.slice(F.array_distinct(F.filter(items, lambda x: x["text"] != "")), 1, MAX_EVIDENCE)


def quality(tags: Column, support: Column, evidence_count: Column, endpoint_support: Column, weight: Column) -> Column:
    """Score and confidence of an edge, with reasons."""
    has = lambda t: F.array_contains(tags, t)
    source = F.when(has("manual"), 1.0).when(has("llm") & ~has("cooccurrence"), 0.9).when(has("llm"), 0.78).otherwise(0.62)
    sup = F.least(F.lit(1.0), F.greatest(support, weight) / 3.0)
    ev = F.least(F.lit(1.0), evidence_count / 3.0)
    score = F.round(0.35 * source + 0.25 * sup + 0.2 * ev + 0.2 * endpoint_support, 3)
    confidence = F.round(0.45 * score + 0.3 * endpoint_support + 0.25 * sup, 3)
    reasons = F.array(
        F.when(has("llm"), "typed extraction"), F.when(has("cooccurrence"), "document locality"), F.when(support > 1, "repeated support"),
        F.when(evidence_count > 1, "multiple evidence"), F.when(endpoint_support < 1, "endpoint materialized from relation"),
    )
    return F.struct(
        score.alias("score"), confidence.alias("confidence"), support.alias("support_count"), F.round(endpoint_support, 3).alias("endpoint_support"), evidence_count.cast("int").alias("evidence_count"),
        F.filter(reasons, lambda r: r.isNotNull()).alias("reasons"),
    )


def endpoint_support(edges: DataFrame, entity_keys: DataFrame | None) -> DataFrame:
    """Edges with ``endpoint_support``: the share of their ends that are entities, 1 where no entities are given."""
    if entity_keys is None:
        return edges.withColumn("endpoint_support", F.lit(1.0))
    k = entity_keys.select("doc_id", "key").distinct()
    s = k.select("doc_id", F.col("key").alias("source"), F.lit(1).alias("has_source"))
    t = k.select("doc_id", F.col("key").alias("target"), F.lit(1).alias("has_target"))
    e = edges.join(s, ["doc_id", "source"], "left").join(t, ["doc_id", "target"], "left")
    both = (F.coalesce("has_source", F.lit(0)) + F.coalesce("has_target", F.lit(0))) / F.lit(2.0)
    return e.withColumn("endpoint_support", both).drop("has_source", "has_target")


def merge_edges(raw: DataFrame, entity_keys: DataFrame | None = None) -> DataFrame:
    """Equivalent edges merged: weights and supports summed, tags, aliases and evidence as first seen, quality computed.

    Lists of a group are bounded beforehand: of evidence the eight first distinct items per edge, of tags and aliases
    the distinct ones with their first place.
    """
    keys = ["doc_id", "source", "target", "relation_key", "direction"]
    e = canonical_edges(raw).withColumn("items", clean_evidence(F.col("evidence"), F.col("snippet"), F.col("tags")))
    e = reused(endpoint_support(e.drop("evidence", "snippet"), entity_keys))  # four aggregations read the canonical edges
    main = e.groupBy(*keys).agg(
        F.min_by("relation", "ord").alias("relation"), F.min_by("original_relation", "ord").alias("original_relation"), F.min_by("kind", "ord").alias("kind"),
        F.sum("weight").alias("weight"), F.sum("support_count").alias("support_count"), F.avg("endpoint_support").alias("endpoint_support"),
    )

    def ordered(df: DataFrame, name: str, keep: int | None = None) -> DataFrame:
        """Distinct ``v`` by first place ``o`` as an array."""
        d = df.groupBy(*keys, "v").agg(F.min("o").alias("o"))
        if keep:
            d = d.withColumn("rn", F.row_number().over(Window.partitionBy(*keys).orderBy("o"))).where(F.col("rn") <= keep)
        return d.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(F.struct("o", "v"))), lambda x: x["v"]).alias(name))

    place = F.struct(F.col("ord"), F.col("i"))
    tags = ordered(e.select(*keys, "ord", F.posexplode("tags").alias("i", "v")).withColumn("o", place), "tags")
    aliases = ordered(e.select(*keys, F.col("ord").alias("o"), F.col("original_relation").alias("v")), "relation_aliases")
    ev = ordered(e.select(*keys, "ord", F.posexplode("items").alias("i", "v")).withColumn("o", place), "evidence", MAX_EVIDENCE)
    out = main.join(tags, keys).join(aliases, keys).join(ev, keys, "left").withColumn("evidence", F.coalesce("evidence", F.array().cast(_EVIDENCE)))
    q = quality(F.col("tags"), F.col("support_count"), F.size("evidence"), F.col("endpoint_support"), F.col("weight"))
    return out.select(
        *keys, "relation", "original_relation", "relation_aliases", "kind", "weight", "tags", F.col("tags").alias("provenance"), F.coalesce(F.get("evidence", F.lit(0))["text"], F.lit("")).alias("snippet"), "evidence", q.alias("quality")
    )


def merge_all(llm_entities: DataFrame, llm_relations: DataFrame, keywords: DataFrame, associations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Entities and edges of all extractors.

    ``llm_entities(doc_id, ord, name, type, snippet)``, ``keywords(doc_id, rank, name)`` and two frames of raw edges.
    Keywords come after the models' entities, associations after their relations, materialised ends last.
    """
    far = 1 << 40
    llm = llm_entities.where(X.usable_name(F.col("name"))).select("doc_id", "ord", "name", "type", "snippet", F.lit("llm").alias("source"))
    kw = keywords.where(X.usable_name(F.col("name"))).select("doc_id", (F.lit(far) + F.col("rank")).alias("ord"), "name", F.lit("keyword").alias("type"), F.lit("").alias("snippet"), F.lit("yake").alias("source"))
    edges = usable_edges(llm_relations.withColumn("origin", F.lit("llm")).withColumn("tag", F.lit("llm")).withColumn("weight", F.lit(1).cast("bigint")))
    assoc = usable_edges(associations.withColumn("origin", F.lit("cooccurrence")).withColumn("tag", F.lit("cooccurrence")).withColumn("ord", F.lit(far) + F.col("ord")))
    raw_edges = edges.unionByName(assoc, allowMissingColumns=True)
    named = llm.unionByName(kw)
    keys = named.select("doc_id", X.normalize_name(F.col("name")).alias("key"))
    ends = materialized_endpoints(raw_edges, keys).withColumn("ord", F.lit(2 * far) + F.col("ord"))
    return merge_entities(named.unionByName(ends)), merge_edges(raw_edges, keys)
