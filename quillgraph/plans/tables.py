"""The test tables in the forms that the operators take. Repeated rows count once."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def docs(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "parsed").where("doc_id is not null and text is not null").select("doc_id", "text").distinct()


def nodes(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "graph_nodes").distinct()


def links(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "graph_links").distinct()


def evidence(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "graph_evidence").distinct()


def keywords(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "keywords").distinct()


def raw_edges(spark: SparkSession, d: str) -> DataFrame:
    """Links with the names of their ends as raw edges, in the order of their ids within a document."""
    l, n = links(spark, d), nodes(spark, d).select("doc_id", "id", "name")
    s = n.select("doc_id", F.col("id").alias("source"), F.col("name").alias("sn"))
    t = n.select("doc_id", F.col("id").alias("target"), F.col("name").alias("tn"))
    j = l.join(s, ["doc_id", "source"]).join(t, ["doc_id", "target"])
    return j.select(
        "doc_id", F.row_number().over(Window.partitionBy("doc_id").orderBy("id")).cast("bigint").alias("ord"), F.col("sn").alias("source"), F.col("tn").alias("target"), "relation", "original_relation", "direction", "kind",
        F.col("provenance").alias("tags"), "tag", "weight", F.lit(None).cast("bigint").alias("support_count"), "snippet",
        F.lit(None).cast("array<struct<text:string,source:string,chunk_index:int,paragraph_index:int,sentence_index:int>>").alias("evidence"), F.lit("llm").alias("origin"),
    )


def raw_entities(spark: SparkSession, d: str) -> DataFrame:
    """Nodes that a model found and keywords, as raw entities; nodes in the order of their ids, keywords after them."""
    n = nodes(spark, d)
    n = n.select("doc_id", F.row_number().over(Window.partitionBy("doc_id").orderBy("id")).cast("bigint").alias("ord"), "name", "type", "snippet", F.element_at("sources", 1).alias("source"))
    k = keywords(spark, d).select("doc_id", (F.lit(1 << 40) + F.col("rank")).alias("ord"), "name", F.lit("keyword").alias("type"), F.lit("").alias("snippet"), "source")
    return n.unionByName(k)
