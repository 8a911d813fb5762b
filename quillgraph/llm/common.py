"""Helpers shared by the training-data operators."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from quillgraph.functions.reuse import reused, shared_folder


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def map_rows(df: DataFrame, fn: Callable[..., Iterable[tuple]], schema: str, names: list[str] | None = None) -> DataFrame:
    """Run ``fn(*columns of a row) -> rows`` over Arrow batches; the columns of ``df`` are its arguments in order.

    Works on plain Python lists, which is faster than pandas for text. Output batches are cut at 20,000 rows, so a
    batch of long documents doesn't make a large frame.
    """
    arrow = to_arrow_schema(T.StructType.fromDDL(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import pyarrow as pa

        out: list[tuple] = []

        def flush() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(zip(*out), arrow)], schema=arrow)

        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns)):
                out.extend(fn(*row))
                if len(out) >= 20_000:
                    yield flush()
                    out = []
        if out:
            yield flush()

    return df.mapInArrow(run, schema)


def form_key(c: Column) -> Column:
    """A name lower-cased, trimmed and with runs of white space made one space."""
    return F.trim(F.regexp_replace(F.lower(c), r"(?U)\s+", " "))


def checkpointed(df: DataFrame) -> DataFrame:
    """``df`` written to the checkpoint folder and read from it: its lineage ends there, whoever is lost.

    The folder is the one in ``spark.checkpoint.dir`` that the cluster shares; a local one is made only under a local master.
    """
    shared_folder(df.sparkSession)
    return df.checkpoint()


#: ``df`` written as a table in the checkpoint folder and read from it: smaller there than a checkpoint of many rows.
written = reused
