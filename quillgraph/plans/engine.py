"""One object with the verbs of the application: add, list, status, graph, delete, reprocess, export."""

from __future__ import annotations

import json
import time
from collections.abc import Callable
from datetime import datetime, timezone

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillgraph.functions.reuse import reused
from quillgraph.operators import graph as G
from quillgraph.operators import query as Q
from quillgraph.operators.extraction import cache_rows
from quillgraph.schemas import GRAPH_SCHEMA_VERSION, RELATION_SCHEMA_VERSION
from quillgraph.sources import catalog, documents, export

from .pipeline import build, run_statistics


class NotReady(LookupError):
    """The document is missing, under way or has no graph."""


class GraphEngine:
    """Documents and their graphs under a folder."""

    def __init__(self, spark: SparkSession, root: str, settings: catalog.Settings | None = None, provider: Callable[[str, str], str] | None = None, model: str = "none") -> None:
        self.spark, self.store, self.settings = spark, catalog.Store(spark, root), settings or catalog.Settings()
        self.provider, self.model = provider, model

    def add(self, path: str) -> DataFrame:
        """Read and process every file under a path; the catalog rows of the files."""
        parsed = reused(documents.read_documents(self.spark, path))
        self._log(parsed, "queued", 0.0)
        self.store.replace("parsed", parsed.select("path", "size", "text", "pages", "format", "words", "error", "doc_id"))
        return self._process(parsed)

    def _log(self, parsed: DataFrame, status: str | Column, progress: float, extra: DataFrame | None = None) -> DataFrame:
        """Append a status row for each document of ``parsed``; ``extra(doc_id, node_count, edge_count, stats_json)`` is of the last one.

        A document keeps the time at which it was first added.
        """
        log = self.store.read("catalog")
        rows = parsed.select("doc_id", "path", "size", "error")
        if extra is not None:
            rows = rows.join(extra, "doc_id", "left")
        else:
            rows = rows.withColumns({"node_count": F.lit(None).cast("int"), "edge_count": F.lit(None).cast("int"), "stats_json": F.lit(None).cast("string")})
        if log is not None:
            rows = rows.join(catalog.latest_status(log).where(F.col("status") != catalog.DELETED).select(F.col("id").alias("doc_id"), F.col("created_at").alias("since")), "doc_id", "left")
        else:
            rows = rows.withColumn("since", F.lit(None).cast("timestamp"))
        now = F.lit(datetime.now(timezone.utc))
        rows = rows.select(
            F.col("doc_id").alias("id"), F.regexp_extract("path", r"([^/\\]+)$", 1).alias("name"), F.regexp_extract("path", r"(\.[^./\\]+)$", 1).alias("ext"), "size", (F.lit(status) if isinstance(status, str) else status).alias("status"),
            F.lit(self.settings.extraction_mode).alias("extraction_mode"), F.lit(None).cast("string").alias("progress_detail"), F.lit(progress).alias("progress"), "error",
            F.coalesce("node_count", F.lit(0)).cast("int").alias("node_count"), F.coalesce("edge_count", F.lit(0)).cast("int").alias("edge_count"), "stats_json", F.coalesce("since", now).alias("created_at"), now.alias("updated_at"),
        )
        rows = reused(rows)
        self.store.append("catalog", rows)
        return rows

    def _process(self, parsed: DataFrame) -> DataFrame:
        began = time.time()
        cache = self.store.read("llm_cache")
        # Of answers to one question the last one saved holds.
        cache = cache.where(F.col("model") == self.model).groupBy("cache_key").agg(F.max_by(F.struct("entities", "relations"), "saved_at").alias("x")).select("cache_key", "x.*") if cache is not None else None
        good = parsed.where("error is null")

        def answered(answers: DataFrame) -> None:
            if self.provider is not None:
                self.store.append("llm_cache", cache_rows(answers, self.model).withColumn("saved_at", F.lit(time.time())))

        g = build(good, self.settings, self.provider, self.model, cache, step=lambda status, progress: self._log(good, status, progress), answered=answered)
        nodes, links = reused(g.nodes), reused(g.links)
        self.store.replace("nodes", nodes, good.select("doc_id"))
        self.store.replace("links", links, good.select("doc_id"))
        counts = G.graph_stats(nodes, links)
        stats = run_statistics(g).join(counts, "doc_id", "left")
        fields = [c for c in stats.columns if c != "doc_id"]
        versions = [F.lit(GRAPH_SCHEMA_VERSION).alias("graph_schema_version"), F.lit(RELATION_SCHEMA_VERSION).alias("relation_schema_version")]
        whole = F.struct(*fields, F.lit(self.settings.llm_concurrency).alias("llm_concurrency"), F.lit(round(time.time() - began, 3)).alias("pipeline_seconds"), *versions)
        extra = stats.select("doc_id", F.col("nodes").alias("node_count"), F.col("edges").alias("edge_count"), F.to_json(whole).alias("stats_json"))
        return self._log(parsed, F.when(F.col("error").isNull(), "done").otherwise("error"), 1.0, extra)

    def documents(self) -> DataFrame | None:
        log = self.store.read("catalog")
        return catalog.catalog_list(log) if log is not None else None

    def status(self, doc_id: str):
        log = self.store.read("catalog")
        row = catalog.get(log, doc_id).first() if log is not None else None
        if row is None:
            raise NotReady(f"no document {doc_id}")
        return row

    def graph(self, doc_id: str) -> tuple[DataFrame, DataFrame]:
        """Nodes and links of a processed document."""
        if self.status(doc_id)["status"] != "done":
            raise NotReady(f"document {doc_id} isn't done")
        nodes, links = self.store.read("nodes", doc_id), self.store.read("links", doc_id)
        if nodes is None or nodes.isEmpty():
            raise NotReady(f"document {doc_id} has no graph")
        return nodes, links

    def delete(self, doc_id: str) -> None:
        self.status(doc_id)
        for t in ("parsed", "nodes", "links"):
            self.store.delete(t, [doc_id])
        last = catalog.get(self.store.read("catalog"), doc_id)
        self.store.append("catalog", reused(catalog.status_row(last, F.lit(datetime.now(timezone.utc)), status=catalog.DELETED)))

    def reprocess(self, doc_id: str) -> DataFrame:
        if self.status(doc_id)["status"] not in catalog.FINAL:
            raise NotReady(f"document {doc_id} is under way")
        return self._process(self.store.read("parsed", doc_id))

    def sweep(self) -> int:
        """Mark documents that a stopped run left under way; their number."""
        log = self.store.read("catalog")
        if log is None:
            return 0
        rows = catalog.sweep_rows(catalog.latest_status(log), F.current_timestamp()).persist()
        n = rows.count()
        if n:
            self.store.append("catalog", rows)
        rows.unpersist()
        return n

    def filter_links(self, doc_id: str, **filters) -> DataFrame:
        return Q.filter_links(self.graph(doc_id)[1], **filters)

    def neighbors(self, doc_id: str, node_id: str) -> DataFrame:
        nodes, links = self.graph(doc_id)
        return Q.ranked_neighbors(Q.neighbor_rows(nodes, links, nodes.where(F.col("id") == node_id)))

    def shortest_path(self, doc_id: str, start: str, end: str) -> list[str] | None:
        _, links = self.graph(doc_id)
        asked = self.spark.createDataFrame([(doc_id, start, end)], "doc_id string, start string, end string")
        row = Q.shortest_paths(links, asked).first()
        return list(row["path"]) if row else None

    def export_csv(self, doc_id: str) -> bytes:
        return export.csv_zip(*self.graph(doc_id))

    def export_report(self, doc_id: str) -> str:
        status = self.status(doc_id)
        return export.markdown_report(status["name"], *self.graph(doc_id), llm_enabled=self.provider is not None, stats=json.loads(status["stats_json"] or "{}"))

    def export_html(self, doc_id: str) -> str:
        nodes, links = self.graph(doc_id)
        return export.html_page(self.status(doc_id)["name"], G.graph_documents(nodes, links).first()["graph_json"])
