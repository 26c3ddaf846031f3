"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfmark.cluster import dropped, ship, shared_dir, written

__all__ = ["arrow_map", "batch_of", "code_points", "dropped", "ship", "shared_dir", "table", "without_space", "word_count", "written"]

#: The white space of the text contracts: space, and tab to carriage return.
SPACE = " \t\n\x0b\x0c\r"
#: Bytes of rows at which Spark closes an Arrow batch for Python, where the session does not say.
BATCH_KEY, BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch", 2 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def arrow_map(df: DataFrame, fn, schema: str) -> DataFrame:
    """mapInArrow with this package at hand on every executor. fn: iterator of record batches to the same.

    Spark's own bound is 10,000 rows a batch, often all texts of a task, which the executor and its Python worker
    both hold at once. A session that sets no bound in bytes gets BATCH_BYTES; one that does keeps its own.
    """
    ship(df.sparkSession)
    if df.sparkSession.conf.get(BATCH_KEY, None) is None:
        df.sparkSession.conf.set(BATCH_KEY, str(BATCH_BYTES))
    return df.mapInArrow(fn, schema)


def batch_of(schema: pa.Schema, columns: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(columns, schema, strict=True)], schema=schema)


def without_space(text: Column) -> Column:
    """text without every character of SPACE; null counts as empty."""
    return F.translate(F.coalesce(text, F.lit("")), SPACE, "")


def word_count(text: Column) -> Column:
    """Number of maximal runs of characters outside SPACE; null counts as empty."""
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(r"[^\x20\x09-\x0D]+")).cast("long")


def code_points(text: Column) -> Column:
    return F.length(F.coalesce(text, F.lit(""))).cast("long")
