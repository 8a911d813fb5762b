"""Queries of the training-data operators, over whole tables, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import leakage, mojibake, names, packing, scans, sentences, spam, splitting, truncation
from .common import checkpointed, table

Query = Callable[[SparkSession, str], DataFrame]


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return splitting.oversized(table(spark, d, "parsed"))


def p1_pieces(spark: SparkSession, d: str) -> DataFrame:
    """Pieces of every parsed text, with their places."""
    return splitting.split_oversized(table(spark, d, "parsed")).drop("piece").distinct()


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return names.variant_pairs(table(spark, d, "graph_nodes"), table(spark, d, "keywords"))


def p2_groups(spark: SparkSession, d: str) -> DataFrame:
    """Every form of a person's or organisation's name with its group."""
    return names.name_groups(table(spark, d, "graph_nodes"), table(spark, d, "keywords")).distinct()


def _garbled(spark: SparkSession, d: str) -> DataFrame:
    texts = mojibake.garbled(table(spark, d, "parsed"), ["doc_id"], "text").withColumn("record_table", F.lit("parsed")).withColumn("node_id", F.lit(""))
    nodes = table(spark, d, "graph_nodes").select("doc_id", F.col("id").alias("node_id"), "name")
    nodes = mojibake.garbled(nodes, ["doc_id", "node_id"], "name").withColumn("record_table", F.lit("graph_nodes"))
    return texts.unionByName(nodes)


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return _garbled(spark, d).select("record_table", "doc_id", "node_id").distinct()


def p3_repaired(spark: SparkSession, d: str) -> DataFrame:
    """Garbled records with their original text, null where it can't be had."""
    return _garbled(spark, d).select("record_table", "doc_id", "node_id", "encodings", "original").distinct()


def _quoted(spark: SparkSession, d: str) -> DataFrame:
    return truncation.quoted_values(table(spark, d, "graph_evidence"), table(spark, d, "graph_nodes"))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return truncation.truncated(_quoted(spark, d), table(spark, d, "parsed"))


def p4_rates(spark: SparkSession, d: str) -> DataFrame:
    """Share of cut-off values per source of the evidence and per sources of the nodes."""
    v = _quoted(spark, d)
    return truncation.truncation_rates(v, truncation.truncated(v, table(spark, d, "parsed")))


def p4_limits(spark: SparkSession, d: str) -> DataFrame:
    """Hidden storage limits by source and measure of length."""
    return truncation.storage_limits(_quoted(spark, d).distinct().select("source", "text"))


def _noise(spark: SparkSession, d: str) -> DataFrame:
    return scans.scan_noise(table(spark, d, "parsed"), [table(spark, d, "graph_evidence").select("text"), table(spark, d, "graph_nodes").select("name")])


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return _noise(spark, d).select("doc_id", "line_no", "noise").distinct()


def p5_repaired(spark: SparkSession, d: str) -> DataFrame:
    """Texts with scan noise, put together as paragraphs."""
    return scans.repaired(table(spark, d, "parsed"), checkpointed(_noise(spark, d).distinct()))


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "parsed").where("format is null or format <> 'pdf'")
    return sentences.sentence_units(p).select("doc_id", "sent_start", "sent_end").distinct()


def p6_units(spark: SparkSession, d: str) -> DataFrame:
    """Sentence units of every parsed document, numbered."""
    return sentences.sentence_units(table(spark, d, "parsed")).distinct()


def p7_pack(spark: SparkSession, d: str) -> DataFrame:
    return packing.pack(table(spark, d, "documents"))


def p7_fill(spark: SparkSession, d: str) -> DataFrame:
    """How full the containers are."""
    return packing.container_fill(packing.pack(table(spark, d, "documents")))


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    return leakage.leaks(table(spark, d, "documents"), table(spark, d, "eval_items")).select("doc_id", "item_id")


def p8_passages(spark: SparkSession, d: str) -> DataFrame:
    """Leaked items with the share of their words and the place in the document."""
    return leakage.leaks(table(spark, d, "documents"), table(spark, d, "eval_items"))


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    return spam.spam_scores(table(spark, d, "documents")).where("spam").select("doc_id").distinct()


def p9_scores(spark: SparkSession, d: str) -> DataFrame:
    """Shares of every document and whether it is spam."""
    return spam.spam_scores(table(spark, d, "documents")).distinct()


def queries() -> dict[str, Query]:
    return {k: v for k, v in globals().items() if k[0] == "p" and k[1].isdigit()}


def oracle_sql() -> dict[str, str]:
    return {"p1_found": "SELECT DISTINCT doc_id FROM parsed WHERE length(text) > 4000"}
