"""The data model: explicit schemas, and the model tables derived from the driver's star schema."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

PARSED = T.StructType(
    [T.StructField(n, T.StringType()) for n in ("path", "code", "code_prefix", "title", "clean_title", "original_title", "plot", "studio", "publisher", "label", "series", "premiered", "dateadded", "resolution", "codec", "status_flag", "parse_status", "encoding", "source")]
    + [T.StructField(n, T.IntegerType()) for n in ("year", "runtime_min", "duration_sec", "height", "watched", "play_count")]
    + [T.StructField(n, T.DoubleType()) for n in ("userrating", "rating_max")]
    + [T.StructField(n, T.ArrayType(T.StringType())) for n in ("people", "directors", "tags", "tech_tags", "meta_tags")]
)
FILES = T.StructType([T.StructField("path", T.StringType()), T.StructField("mtime", T.StringType()), T.StructField("size", T.LongType())])


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per item. The dimensions are joined by what size Spark measures; lines are added up before the join."""
    lines = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.sum("l_quantity").cast("int").alias("runtime_min"), F.count_distinct("l_suppkey").alias("n_people"))
    o, c, n = (table(spark, sf_dir, t) for t in ("orders", "customer", "nation"))
    joined = o.join(c, o.o_custkey == c.c_custkey).join(n, c.c_nationkey == n.n_nationkey).join(lines, o.o_orderkey == lines.l_orderkey, "left")
    day = F.date_format("o_orderdate", "yyyy-MM-dd")
    return joined.select(
        F.col("o_orderkey").alias("item_id"),
        F.concat(F.lit("ORD-"), F.lpad(F.col("o_orderkey").cast("string"), 9, "0")).alias("code"),
        F.concat(F.lit("ORD-"), F.lpad(F.col("o_orderkey").cast("string"), 9, "0"), F.lit(" "), F.lower("c_mktsegment"), F.lit(" "), F.lower("n_name")).alias("title"),
        F.col("c_mktsegment").alias("studio"),
        F.col("n_name").alias("source"),
        day.alias("premiered"),
        F.concat(day, F.lit(" 00:00")).alias("dateadded"),
        F.year("o_orderdate").alias("year"),
        (F.col("o_totalprice") / 50000).alias("userrating"),
        F.col("o_orderpriority").alias("resolution"),
        F.col("o_orderstatus").alias("status_flag"),
        F.coalesce("runtime_min", F.lit(0)).alias("runtime_min"),
        F.coalesce("n_people", F.lit(0)).alias("n_people"),
    )


def item_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(item_id, tag): brand, type and name of each line's part; duplicates allowed."""
    part = table(spark, sf_dir, "part").select("p_partkey", F.explode(F.array("p_brand", "p_type", "p_name")).alias("tag"))
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey").join(part, F.col("l_partkey") == F.col("p_partkey")).select(F.col("l_orderkey").alias("item_id"), "tag")


def item_people(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(item_id, person, ord); duplicates allowed."""
    s = table(spark, sf_dir, "supplier").select("s_suppkey", "s_name")
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_suppkey", "l_linenumber").join(s, F.col("l_suppkey") == F.col("s_suppkey")).select(F.col("l_orderkey").alias("item_id"), F.col("s_name").alias("person"), F.col("l_linenumber").alias("ord"))


def votes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(item_id, vote, voted_at): the latest purchase (+1) or error (-1) event of each."""
    e = table(spark, sf_dir, "events").filter(F.col("event_type").isin("purchase", "error"))
    vote = F.when(F.col("event_type") == "purchase", 1).otherwise(-1)
    return e.groupBy(F.col("user_id").alias("item_id")).agg(F.max_by(vote, F.struct("ts", "event_id")).alias("vote"), F.max("ts").alias("voted_at"))


def plays(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(item_id, play_count, played_at) from view events."""
    return table(spark, sf_dir, "events").filter("event_type = 'view'").groupBy(F.col("user_id").alias("item_id")).agg(F.count("*").alias("play_count"), F.max("ts").alias("played_at"))


def latest(df: DataFrame, key: str, *order) -> DataFrame:
    """One row per key: the first by order."""
    return df.withColumn("_n", F.row_number().over(W.partitionBy(key).orderBy(*order))).filter("_n = 1").drop("_n")
