"""Maintenance: upserts, incremental differences, pruning, overrides; all rewrites of immutable tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

KINDS = ("tag", "person", "director", "studio", "title")


def upsert(old: DataFrame, new: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """(table, counts): new rows replace old ones of the same key; counts has added and updated."""
    table = old.join(new.select(key), key, "left_anti").unionByName(new, allowMissingColumns=True)
    known = old.select(key).withColumn("_known", F.lit(1))
    counts = new.join(known, key, "left").agg(F.count(F.when(F.col("_known").isNull(), 1)).alias("added"), F.count("_known").alias("updated"))
    return table, counts


def changed(current: DataFrame, known: DataFrame) -> DataFrame:
    """Files (path, mtime, size) that are new or differ in time or size."""
    return current.join(known.select("path", "mtime", "size"), ["path", "mtime", "size"], "left_anti")


def prune_plan(stored: DataFrame, found: DataFrame, max_ratio: float = 0.5) -> DataFrame:
    """(path) of stored rows that were not found; none if nothing was found or more than max_ratio would go."""
    gone = stored.select("path").join(found.select("path"), "path", "left_anti")
    totals = stored.agg(F.count("*").alias("n")).join(found.agg(F.count("*").alias("m"))).join(gone.agg(F.count("*").alias("g")))
    allowed = totals.filter((F.col("m") > 0) & (F.col("g") <= max_ratio * F.col("n")))
    return gone.join(allowed.select(F.lit(True).alias("_ok"))).drop("_ok")


def pruned_roots(stored: DataFrame, found: dict[str, DataFrame | None], max_ratio: float = 0.5) -> tuple[DataFrame, list[str]]:
    """(path) of stored rows (path, source) to remove, and warnings, root by root; nothing is parsed.

    found: for each root the files (path) that are there now, None for a root that cannot be read. Such a root, one without any
    file, and one that would lose more than max_ratio of its rows are left alone with a warning.
    """
    warnings, parts = [], []
    for root, files in found.items():
        own = stored.filter(F.col("source") == root)
        if files is None:
            warnings.append(f"cannot be read, left alone: {root}")
            continue
        gone = own.select("path").join(files.select("path"), "path", "left_anti")
        there, total, n = (df.count() for df in (files.limit(1), own, gone))
        if not there:
            warnings.append(f"no file found, left alone: {root}")
        elif n > max_ratio * total:
            warnings.append(f"{n} of {total} rows would go, left alone: {root}")
        else:
            parts.append(gone)
    none = stored.select("path").limit(0)
    return (reduce(DataFrame.unionByName, parts) if parts else none), warnings


def stats(tables: dict[str, DataFrame]) -> DataFrame:
    """(name, rows) of each table."""
    return reduce(DataFrame.unionByName, [df.agg(F.lit(name).alias("name"), F.count("*").alias("rows")) for name, df in tables.items()])


def cleared(votes: DataFrame, sign: int = 0) -> DataFrame:
    """The votes left when all, or those of one sign, are taken back."""
    return votes.limit(0) if sign == 0 else votes.filter(F.signum("vote") != sign)


def failed(records: DataFrame) -> DataFrame:
    """Records whose parse failed: they are noted among the files and give no item."""
    return records.filter(F.col("parse_status").rlike("_error"))


def run_log(log: DataFrame, source: str, started: str, found: int, added: int, updated: int, failed: int) -> DataFrame:
    """The log of scans with one more row."""
    return log.unionByName(log.sparkSession.createDataFrame([(source, started, found, added, updated, failed)], log.schema))


def remove_source(tables: dict[str, DataFrame], items: DataFrame, source: str) -> dict[str, DataFrame]:
    """Every table without the rows of a source's items."""
    gone = items.filter(F.col("source") == source).select("item_id")
    return {name: df.join(gone, "item_id", "left_anti") for name, df in tables.items()}


def source_counters(items: DataFrame) -> DataFrame:
    return items.groupBy("source").agg(F.count("*").alias("items"))


def set_override(table: DataFrame, kind: str, value: str, weight: float | None) -> DataFrame:
    """The override table with one weight set, or deleted for None."""
    if kind not in KINDS or not value.strip():
        raise ValueError("an override needs a known kind and a name")
    rest = table.filter(~((F.col("kind") == kind) & (F.col("value") == value)))
    return rest if weight is None else rest.unionByName(table.sparkSession.createDataFrame([(kind, value, float(weight))], "kind string, value string, weight double"))


def migrated(df: DataFrame, columns: dict[str, str]) -> DataFrame:
    """df with the columns it lacks, null."""
    return df.withColumns({c: F.lit(None).cast(t) for c, t in columns.items() if c not in df.columns})
