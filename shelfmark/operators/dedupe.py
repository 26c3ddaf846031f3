"""Duplicate groups across folders."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfmark.functions.scalar import file_stem, human_size, identity_code, title_key

#: Confidence, worst first.
RANKS = ("low", "medium", "high", "very high")
#: Columns that items may lack, with what stands for them.
OPTIONAL = {"file_name": "''", "clean_title": "''", "duration_sec": "0L", "resolution": "''"}


def identified(items: DataFrame, use_code: bool = True, use_title: bool = True) -> DataFrame:
    """items (path, code, title, year, folder, size; file_name, clean_title, duration_sec and resolution if there) with kind and key.

    The code is that of the field, of the file name or of the title; a field that holds a prefix alone is made whole
    by the others. Rows without code and title are left out.
    """
    full = items.withColumns({c: F.expr(x) for c, x in OPTIONAL.items() if c not in items.columns})
    code = identity_code(F.col("code"), file_stem(F.coalesce(F.col("file_name"), F.lit(""))), F.col("title")) if use_code else F.lit("")
    title = title_key(F.col("title"), F.col("year"), F.col("clean_title")) if use_title else F.lit("")
    full = full.withColumn("code_key", code).withColumn("title_key", title)
    kind = F.when(F.col("code_key") != "", "code").when(F.col("title_key") != "", "title")
    return full.withColumn("kind", kind).withColumn("key", F.when(F.col("code_key") != "", F.col("code_key")).otherwise(F.col("title_key"))).drop("code_key", "title_key").filter("kind is not null")


def groups(keyed: DataFrame, min_confidence: str = "low") -> DataFrame:
    """(kind, key, label, members, copies, redundant, confidence, multipart, notes): keys with two members or more.

    Sizes are added up per folder first, so a key with very many members meets as one row a folder; of durations and
    resolutions only the extremes and the distinct names meet. redundant = total size less the largest folder's;
    one folder alone holds a multipart item. The label is the code, else the title, of the member of the least path.
    """
    full = keyed.withColumns({c: F.expr(x) for c, x in (OPTIONAL | {"code": "''", "title": "''"}).items() if c not in keyed.columns})
    positive = lambda c: F.when(F.col(c) > 0, F.col(c))
    folder = full.groupBy("kind", "key", "folder").agg(
        F.count("*").alias("n"), F.sum("size").alias("bytes"), F.min(positive("size")).alias("low"), F.max(positive("size")).alias("high"), F.count(positive("year")).alias("dated"),
        F.min(positive("duration_sec")).alias("short"), F.max(positive("duration_sec")).alias("long"), F.collect_set(F.when(F.col("resolution") != "", F.col("resolution"))).alias("shapes"),
        F.min(F.struct("path", "code", F.substring("title", 1, 36).alias("title"))).alias("first"),
    )
    g = folder.groupBy("kind", "key").agg(
        F.sum("n").alias("members"), F.count("*").alias("copies"), F.sum("bytes").alias("total"), F.max("bytes").alias("most"), F.min("low").alias("low"), F.max("high").alias("high"), F.sum("dated").alias("dated"),
        F.min("short").alias("short"), F.max("long").alias("long"), F.array_sort(F.array_distinct(F.flatten(F.collect_set("shapes")))).alias("shapes"), F.min("first").alias("first"),
    ).filter("members > 1")
    base = F.when(F.col("kind") == "code", 2).when(F.col("dated") == F.col("members"), 1).otherwise(0)
    same = F.col("low") == F.col("high")
    rank = F.when(same, 3).otherwise(base)
    out = g.withColumn("rank", rank).filter((F.col("copies") == 1) | (F.col("rank") >= RANKS.index(min_confidence)))
    name = F.element_at(F.array(*[F.lit(x) for x in RANKS]), F.col("rank") + 1)
    label = F.when((F.col("kind") == "code") & (F.col("first.code") != ""), F.col("first.code")).when(F.col("kind") == "code", F.upper("key")).otherwise(F.col("first.title"))
    notes = F.array_compact(
        F.array(
            F.when(F.col("copies") > 1, F.concat(F.lit("in "), F.col("copies").cast("string"), F.lit(" folders"))),
            F.when(same, F.lit("same size")).when(F.col("short") == F.col("long"), F.lit("same duration")),
            F.when(F.size("shapes") > 1, F.concat(F.lit("resolutions differ: "), F.array_join("shapes", " / "))),
            F.when(F.col("high") > 1.5 * F.col("low"), F.concat(F.lit("sizes differ: "), human_size(F.col("low")), F.lit(" to "), human_size(F.col("high")))),
        )
    )
    return out.select(
        "kind", "key", F.coalesce(F.nullif(label, F.lit("")), "key").alias("label"), F.col("members").cast("long").alias("members"), "copies", F.greatest(F.col("total") - F.col("most"), F.lit(0)).cast("long").alias("redundant"),
        name.alias("confidence"), (F.col("copies") == 1).alias("multipart"), F.array_join(notes, "; ").alias("notes"),
    )


def members(keyed: DataFrame, found: DataFrame) -> DataFrame:
    """The rows of the groups found."""
    return keyed.join(found.select("kind", "key"), ["kind", "key"], "left_semi")


def listed(keyed: DataFrame, found: DataFrame, multipart: bool = False) -> DataFrame:
    """The report's rows in its order: groups by what they waste, copies and label, the largest members first."""
    rows = keyed.join(found.filter(F.col("multipart") == multipart), ["kind", "key"])
    return rows.orderBy(F.desc("redundant"), F.desc("copies"), "label", "key", F.desc("size"), "path")


def summary(found: DataFrame) -> DataFrame:
    real = ~F.col("multipart")
    return found.agg(F.count(F.when(real, 1)).alias("groups"), F.count(F.when(~real, 1)).alias("multipart"), F.coalesce(F.sum(F.when(real, F.col("members"))), F.lit(0)).cast("long").alias("members"), F.coalesce(F.sum(F.when(real, F.col("redundant"))), F.lit(0)).cast("long").alias("redundant"))
