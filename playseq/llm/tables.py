"""Reading the tables that the registered queries run on, and cutting lineage."""

from __future__ import annotations

import os
from collections.abc import Callable
from functools import wraps

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from playseq.operators.sequence import checkpoint

__all__ = ["checkpoint", "on_workers", "documents", "row_key", "table", "width", "total_bytes"]


BATCH_ROWS = 1000
_BATCHES = "spark.sql.execution.arrow.maxRecordsPerBatch"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents")


def width(spark: SparkSession) -> int:
    """The session's number of shuffle partitions."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def row_key(row: Column | str, text: Column | str) -> tuple[Column, Column]:
    """128 bits that stand for a row by its content.

    Fully equal rows share a key, and everything computed from the text is then equal too.
    """
    return (
        F.xxhash64(row, text).alias("k1"),
        F.xxhash64(text, F.lit(1), row).alias("k2"),
    )


def total_bytes(df: DataFrame, text: str = "text") -> int:
    return df.agg(F.sum(F.octet_length(text))).first()[0] or 0


def on_workers(query: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
    """The query with this library on the Python workers' path, wherever the session was started.

    Only for workers that see this folder; a cluster gets the library as a Python file of the session.
    Rows are whole texts here, so Arrow batches are cut to `BATCH_ROWS`, unless the session says otherwise.
    """
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

    @wraps(query)
    def run(spark: SparkSession, *args, **options) -> DataFrame:
        environment = spark.sparkContext.environment
        paths = [p for p in environment.get("PYTHONPATH", "").split(os.pathsep) if p]
        if root not in paths:
            environment["PYTHONPATH"] = os.pathsep.join([*paths, root])
        if spark.conf.get(_BATCHES) == "10000":  # Spark's default
            spark.conf.set(_BATCHES, str(BATCH_ROWS))
        return query(spark, *args, **options)

    return run
