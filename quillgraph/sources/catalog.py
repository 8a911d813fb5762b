"""The catalog of documents as a log of status rows, and tables kept per document."""

from __future__ import annotations

import os
import uuid
from dataclasses import dataclass, fields
from datetime import datetime, timezone

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

FINAL = ("done", "error")
DELETED = "deleted"
STALE_SECONDS = 120


@dataclass(frozen=True)
class Settings:
    """Knobs with their defaults; ``from_env`` takes upper-case names from the environment."""

    max_nodes: int = 600
    max_edges: int = 2500
    chunk_chars: int = 4000
    chunk_overlap: int = 200
    llm_concurrency: int = 4
    extraction_mode: str = "balanced"
    llm_chunk_fraction: float = 0.35
    llm_min_chunks: int = 12
    llm_max_chunks: int = 250
    max_keywords: int = 40
    max_upload_mb: int = 50
    llm_timeout_seconds: float = 120.0
    llm_max_retries: int = 1

    @classmethod
    def from_env(cls, env=None, env_file: str | None = None) -> Settings:
        """Values of the environment; of a file of ``NAME=value`` lines where the environment has none."""
        env = dict(os.environ if env is None else env)
        if env_file and os.path.exists(env_file):
            with open(env_file, encoding="utf-8") as f:
                for line in f:
                    k, eq, v = line.strip().partition("=")
                    if eq and not k.startswith("#"):
                        env.setdefault(k.strip(), v.strip().strip("\"'"))
        own = {f.name: type(f.default)(env[f.name.upper()]) for f in fields(cls) if f.name.upper() in env}
        return cls(**own)


# What may be uploaded; old Word files are known but can't be read.
EXTENSIONS = [".doc", ".docx", ".htm", ".html", ".md", ".pdf", ".pptx", ".txt"]
MODES = ["fast", "balanced", "full"]


def upload_checks(files: DataFrame, settings: Settings | None = None) -> DataFrame:
    """``files(name, size, mode)`` with ``code``, 200, 400 or 413, and the ``reason`` of a rejection, null where a file is accepted.

    A null or empty mode is the one of the settings. The first rule that a file breaks decides: type, old Word format,
    mode, emptiness, size.
    """
    s = settings or Settings()
    ext = F.lower(F.regexp_extract(F.coalesce("name", F.lit("")), r"[^/\\](\.[^./\\]+)$", 1))
    given = F.coalesce(F.col("mode"), F.lit(""))
    mode = F.lower(F.trim(F.when(given == "", F.lit(s.extraction_mode)).otherwise(given)))
    size = F.coalesce(F.col("size"), F.lit(0))
    rules = [
        (~ext.isin(EXTENSIONS), 400, "type"), (ext == ".doc", 400, "old Word format"), (~mode.isin(MODES), 400, "mode"), (size <= 0, 400, "empty"), (size > s.max_upload_mb * 1024 * 1024, 413, "too large"),
    ]
    code, reason = F.lit(200), F.lit(None).cast("string")
    for bad, n, why in reversed(rules):
        code, reason = F.when(bad, n).otherwise(code), F.when(bad, why).otherwise(reason)
    return files.withColumn("code", code).withColumn("reason", reason)


def latest_status(log: DataFrame) -> DataFrame:
    """The last row of every document, whatever the order of arrival; at equal times the further status holds."""
    stage = F.expr("coalesce(array_position(array('queued', 'parsing', 'chunking', 'extracting', 'clustering', 'done', 'error', 'deleted'), status), 0)")
    w = Window.partitionBy("id").orderBy(F.desc("updated_at"), F.desc(stage), F.desc("status"))
    return log.distinct().withColumn("rn", F.row_number().over(w)).where("rn = 1").drop("rn")


def catalog_list(log: DataFrame) -> DataFrame:
    """Documents with their status, the newest first; deleted ones are left out."""
    return latest_status(log).where(F.col("status") != DELETED).orderBy(F.desc("created_at"), "id")


def get(log: DataFrame, doc_id: str) -> DataFrame:
    return latest_status(log.where(F.col("id") == doc_id)).where(F.col("status") != DELETED)


def stale(latest: DataFrame, now: Column, seconds: int = STALE_SECONDS) -> DataFrame:
    """Documents under way whose last row is older than ``seconds``."""
    age = now.cast("double") - F.col("updated_at").cast("double")
    return latest.where(~F.col("status").isin(*FINAL, DELETED) & (age > seconds))


def sweep_rows(latest: DataFrame, now: Column, message: str = "interrupted") -> DataFrame:
    """Rows to append for documents that a stopped run left under way: error with a message, the progress kept."""
    return latest.where(~F.col("status").isin(*FINAL, DELETED)).withColumn("status", F.lit("error")).withColumn("error", F.lit(message)).withColumn("updated_at", now)


def status_row(latest: DataFrame, now: Column, **changes) -> DataFrame:
    """Rows to append for a change of columns."""
    for k, v in changes.items():
        latest = latest.withColumn(k, v if isinstance(v, Column) else F.lit(v).cast(latest.schema[k].dataType))
    return latest.withColumn("updated_at", now)


class Store:
    """Tables under a folder, each a Parquet directory to which rows are only ever appended.

    Logs are plain. Tables of documents are written in runs: a run's rows count from the moment its entry stands in the
    table's list of runs, which is written last, and until a later run of the document or its deletion, an entry as
    well. So nothing is rewritten in place, and a run that breaks leaves what was there. Documents are spread over
    ``BUCKETS`` partitions by a hash, which keeps the number of folders fixed and prunes the reading of one document.
    ``compact`` writes the rows that count as a new generation.
    """

    BUCKETS = 256

    def __init__(self, spark: SparkSession, root: str) -> None:
        self.spark, self.root = spark, root.rstrip("/")

    def _path(self, name: str) -> str:
        return f"{self.root}/{name}"

    def exists(self, name: str) -> bool:
        jvm = self.spark._jvm
        path = jvm.org.apache.hadoop.fs.Path(self._path(name))
        return path.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(path)

    def append(self, name: str, df: DataFrame) -> None:
        df.write.mode("append").parquet(self._path(name))

    def _live(self, name: str) -> DataFrame:
        """The last run of every document of a table that isn't deleted."""
        last = self.spark.read.parquet(self._path(f"{name}_runs")).groupBy("doc_id").agg(F.max(F.struct("at", "run", "deleted")).alias("x"))
        return last.where("not x.deleted").select("doc_id", F.col("x.run").alias("run"))

    def read(self, name: str, doc_id: str | None = None) -> DataFrame | None:
        """A log; or a table of documents, or a document's part of it. None where nothing was saved."""
        if not self.exists(name):
            return None
        df = self.spark.read.parquet(self._path(name))
        if not self.exists(f"{name}_runs"):
            return df
        live = self._live(name)
        if doc_id is not None:
            df = df.where((F.col("bucket") == self._bucket(F.lit(doc_id))) & (F.col("doc_id") == doc_id))
            live = live.where(F.col("doc_id") == doc_id)
        return df.join(live, ["doc_id", "run"], "left_semi").drop("run", "bucket")

    def _bucket(self, doc_id: Column) -> Column:
        return F.pmod(F.xxhash64(doc_id), F.lit(self.BUCKETS)).cast("int")

    def _entries(self, name: str, ids: DataFrame, run: str | None) -> None:
        now = datetime.now(timezone.utc).timestamp()
        self.append(f"{name}_runs", ids.select("doc_id", F.lit(now).alias("at"), F.lit(run or "").alias("run"), F.lit(run is None).alias("deleted")))

    def replace(self, name: str, df: DataFrame, ids: DataFrame | None = None) -> None:
        """Rows of the documents in ``df``, or of ``ids(doc_id)`` where some have no rows, in place of the ones saved."""
        run = uuid.uuid4().hex
        rows = df.withColumn("run", F.lit(run)).withColumn("bucket", self._bucket(F.col("doc_id")))
        rows.repartition("bucket").write.mode("append").partitionBy("bucket").parquet(self._path(name))
        if ids is None:
            written = self.spark.read.schema(rows.schema).parquet(self._path(name))
            ids = written.where(F.col("run") == run).select("doc_id")
        self._entries(name, ids.distinct(), run)

    def delete(self, name: str, doc_ids: list[str]) -> None:
        if self.exists(f"{name}_runs") and doc_ids:
            self._entries(name, self.spark.createDataFrame([(d,) for d in doc_ids], "doc_id string"), None)

    def compact(self, name: str) -> None:
        """Only the rows that count, in few files; the folder before is moved aside and then removed."""
        jvm = self.spark._jvm
        fs_path = lambda n: jvm.org.apache.hadoop.fs.Path(self._path(n))
        fs = fs_path(name).getFileSystem(self.spark._jsc.hadoopConfiguration())
        live = self.read(name)
        if live is None or not self.exists(f"{name}_runs"):
            return
        kept = Store(self.spark, f"{self.root}/next-{uuid.uuid4().hex}")
        kept.replace(name, live)
        old = f"old-{uuid.uuid4().hex}"
        for n in (name, f"{name}_runs"):
            fs.mkdirs(fs_path(old))
            fs.rename(fs_path(n), fs_path(f"{old}/{n}"))
            fs.rename(jvm.org.apache.hadoop.fs.Path(kept._path(n)), fs_path(n))
        fs.delete(fs_path(old), True)
        fs.delete(jvm.org.apache.hadoop.fs.Path(kept.root), True)
