"""The corpus pipeline: documents through five stages, each written as Parquet and read again by the next.

Every stage takes any rows: null ids, texts and sources, empty, blank and very long texts, ties, rows that
repeat, extra columns of any name (all but the last stage return the columns they get) and empty tables, which stay
empty. What becomes of each case is said at the stage and, in full, at the operator that it calls.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from shelfmark.llm import byte_bpe, dedup, mixing, near, quality
from shelfmark.llm.common import shared_dir, table


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop the documents that the quality classifier rejects. Texts without words are judged alike; without labels all stay."""
    return quality.keep_good(docs, table(spark, sf_dir, "labels"))


def exact_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one of texts that are equal but for white space: the longest, then the smallest id, null ids last. Null and empty texts are equal."""
    return dedup.drop_exact_copies(docs)


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the row of the smallest doc_id of each group of near copies, null ids last: five words, similarity 0.8. Rows are told apart by id and text; texts without words all stay."""
    return near.drop_near_copies(docs)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeat or leave out documents so that sources come near their targets. A null source is a source; rows of one id share one draw."""
    return mixing.mixed_documents(docs)


def encoding_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of every row, repeated ones too; null texts count as empty."""
    return byte_bpe.digests(byte_bpe.round_trip(docs))


STAGES = [
    ("quality classifier", quality_stage),
    ("exact dedup", exact_dedup_stage),
    ("n-gram Jaccard join", near_dedup_stage),
    ("mixing sources to target weights", mixing_stage),
    ("byte-level BPE encoding and decoding", encoding_stage),
]
#: SQL can express neither the classifier nor the encoding; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to documents."""
    docs, folder = table(spark, sf_dir, "documents"), f"{shared_dir(spark)}/shelfmark/{uuid.uuid4().hex}"
    last = None
    for k, (_, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/stage{k}")
        docs = spark.read.parquet(f"{folder}/stage{k}")
        if last:  # nothing reads the stage before any more
            path = spark._jvm.org.apache.hadoop.fs.Path(last)
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
        last = f"{folder}/stage{k}"
    return docs
