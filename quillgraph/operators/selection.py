"""Representative chunks of a document: rare words, headings and length, with every section covered."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillgraph.functions import text as X


def document_frequency(chunks: DataFrame) -> DataFrame:
    """Chunks of the document that hold a token: ``(doc_id, token, df)``."""
    return chunks.select("doc_id", F.explode(F.array_distinct(X.tokens(F.col("text")))).alias("token")).groupBy("doc_id", "token").agg(F.count(F.lit(1)).alias("df"))


def chunk_scores(chunks: DataFrame) -> DataFrame:
    """``(doc_id, chunk_index, score)``: rare tokens over the root of the token count, headings, length; 0 without tokens."""
    t = chunks.select("doc_id", "chunk_index", X.tokens(F.col("text")).alias("t"), X.has_heading(F.col("text")).alias("heading"))
    size = t.select("doc_id", "chunk_index", F.size("t").alias("n"), "heading")
    each = t.select("doc_id", "chunk_index", F.explode(F.array_distinct("t")).alias("token"))
    rare = each.join(document_frequency(chunks), ["doc_id", "token"]).groupBy("doc_id", "chunk_index").agg(F.sum(1.0 / F.col("df")).alias("rare"))
    s = size.join(rare, ["doc_id", "chunk_index"], "left")
    score = F.col("rare") / F.greatest(F.lit(1.0), F.sqrt("n")) + F.when(F.col("heading"), 1.0).otherwise(0.0) + 0.15 * F.least(F.lit(1.0), F.col("n") / 350.0)
    return s.select("doc_id", "chunk_index", F.when(F.col("n") == 0, 0.0).otherwise(F.round(score, 9)).alias("score"))


def sections(scores: DataFrame, mode: str = "balanced", fraction: float = 0.35, minimum: int = 12, maximum: int = 250) -> DataFrame:
    """Scores with ``total``, ``target`` and the ``section`` of every chunk.

    Section s of S covers the chunks from s x total / S on, S the root of the total, at most the target.
    """
    w = Window.partitionBy("doc_id")
    s = scores.withColumn("total", F.count(F.lit(1)).over(w).cast("int")).withColumn("target", X.target_count(F.col("total"), mode, fraction, minimum, maximum))
    s = s.withColumn("sections", F.least(F.col("target"), F.greatest(F.lit(1), F.round(F.sqrt("total")).cast("int"))))
    # The largest s with floor(s x total / S) <= index.
    return s.withColumn("section", F.floor(((F.col("chunk_index") + 1) * F.col("sections") - 1) / F.col("total")).cast("int"))


def select_chunks(scores: DataFrame, mode: str = "balanced", fraction: float = 0.35, minimum: int = 12, maximum: int = 250) -> DataFrame:
    """``(doc_id, chunk_index, score, selected, total, mode)``: the best of each section, then the best of the rest.

    In a document that is taken whole every score is 1.
    """
    s = sections(scores, mode, fraction, minimum, maximum)
    best = Window.partitionBy("doc_id", "section").orderBy(F.desc("score"), "chunk_index")
    s = s.withColumn("cover", F.row_number().over(best) == 1)
    covered = F.sum(F.col("cover").cast("int")).over(Window.partitionBy("doc_id"))
    rank = F.row_number().over(Window.partitionBy("doc_id", "cover").orderBy(F.desc("score"), "chunk_index"))
    s = s.withColumn("covered", covered).withColumn("rank", rank)
    whole = F.col("target") == F.col("total")
    chosen = whole | F.col("cover") | (F.col("rank") <= F.col("target") - F.col("covered"))
    return s.select("doc_id", "chunk_index", F.when(whole, 1.0).otherwise(F.round("score", 5)).alias("score"), chosen.alias("selected"), "total", F.lit(mode).alias("mode"))
