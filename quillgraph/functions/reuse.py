"""Frames that several parts of a plan read."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The checkpoint folder of the session's cluster, set from ``spark.checkpoint.dir`` where it isn't yet.

    A local folder is made only under a local master, as in tests; elsewhere the executors couldn't read it.
    """
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        at = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
        if not at:
            if not sc.master.startswith("local[") and sc.master != "local":
                raise RuntimeError("spark.checkpoint.dir must name a folder that the cluster shares")
            at = tempfile.mkdtemp(prefix="quillgraph-")
        sc.setCheckpointDir(at)
    return sc._jsc.sc().getCheckpointDir().get()


def reused(df: DataFrame) -> DataFrame:
    """``df`` computed once, written as a Parquet table in the checkpoint folder and read from there.

    Plans that read it begin at the files, with the columns that they need, so they stay small, and nothing is lost with
    an executor. The table is removed when the driver's session ends.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()

    def remove() -> None:
        try:
            p = jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(conf).delete(p, True)
        except Exception:  # noqa: BLE001
            pass  # the session is gone, and its folder with it

    atexit.register(remove)
    return spark.read.schema(df.schema).parquet(path)
