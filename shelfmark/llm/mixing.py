"""Mixing sources to target weights, in DataFrame functions alone.

Tokens are added up per source, targets are water-filled under each source's cap, and every document is
emitted floor(rate) times plus one more copy with the probability of the fraction, drawn from a hash of
its id, so reruns agree.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from shelfmark.llm.common import word_count, written

#: Weights of the sources in order, repeating; the mix's share of all sizes; a target's cap in sizes of its source.
WEIGHTS, SHARE, CAP = (5, 2, 1), 1.5, 2.0
#: Seed of the draws, and the hexadecimal digits of a digest that make one draw (52 bits).
SEED, DIGITS = "mix-1", 13


def draw(doc_id: Column, seed: str = SEED) -> Column:
    """A number from 0 to below 1 that hangs on the id alone."""
    text = F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit("null")))
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, DIGITS), 16, 10).cast("double") / float(16**DIGITS)


def targets(sizes: DataFrame, weights: tuple = WEIGHTS, share: float = SHARE, cap: float = CAP) -> DataFrame:
    """(source, source_size, target) from (source, source_size), a row for each source.

    Sources by code point, null last, weigh as weights has it. target = least(cap * source_size, level * weight)
    with the level at which the targets add up to share of all sizes. Sources are taken in the order of
    cap * size / weight; those whose ratio is under the level that the rest would get are at their cap. After the first that
    is not, the levels only fall, so the highest of theirs is the level. The table of sources is a dimension:
    its windows take a row for each distinct source, whatever the number of documents.
    """
    by_code = W.orderBy(F.col("source").isNull(), F.hex(F.col("source").cast("binary")))  # UTF-8 sorts as code points do
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), ((F.row_number().over(by_code) - 1) % len(weights) + 1).cast("int"))
    full = F.col("source_size") * F.lit(float(cap))
    ranked = sizes.withColumn("w", weight).withColumn("full", full).withColumn("ratio", F.col("full") / F.col("w"))
    fill = W.orderBy("ratio", F.col("source").isNull(), F.hex(F.col("source").cast("binary")))
    everything = W.partitionBy()
    before = fill.rowsBetween(W.unboundedPreceding, -1)
    ranked = (
        ranked.withColumn("goal", F.sum("source_size").over(everything) * F.lit(float(share)))
        .withColumn("left_over", F.col("goal") - F.coalesce(F.sum("full").over(before), F.lit(0.0)))
        .withColumn("weight_left", F.sum("w").over(everything) - F.coalesce(F.sum("w").over(before), F.lit(0.0)))
        .withColumn("level", F.col("left_over") / F.col("weight_left"))
    )
    level = F.max(F.when(F.col("ratio") >= F.col("level"), F.col("level"))).over(everything)
    return ranked.select("source", "source_size", F.least("full", F.coalesce(level * F.col("w"), F.col("full"))).alias("target"))


def rated(sizes: DataFrame, source_targets: DataFrame) -> DataFrame:
    """sizes (…, source, size) with source_size, target, rate and copies."""
    dim = source_targets.select(F.col("source").alias("of_source"), "source_size", "target")
    joined = sizes.join(dim, F.col("source").eqNullSafe(F.col("of_source")), "left").drop("of_source")
    rate = F.coalesce(F.try_divide("target", "source_size"), F.lit(0.0))
    whole = F.floor("rate")
    return joined.withColumn("rate", rate).withColumn("copies", (whole + (draw(F.col("doc_id")) < F.col("rate") - whole).cast("long")).cast("long"))


def mix(docs: DataFrame) -> DataFrame:
    """One row per row of docs (doc_id, text, source): doc_id, size, source_size, target, taken.

    size counts words (null text: 0); null is a source of its own. A source without words has target 0 and
    gives nothing. Rows that repeat an id get the same draw. An empty table gives an empty result; other
    columns are ignored. The table of sources has one row per distinct source and is joined by what size
    Spark measures, so a source with a third of all rows is split, not gathered.
    """
    sizes = written(docs.select("doc_id", "source", word_count(F.col("text")).alias("size")), "sizes")
    per_source = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    found = rated(sizes, written(targets(per_source), "targets"))
    return found.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))


def mixed_documents(docs: DataFrame) -> DataFrame:
    """docs, all columns, each row as many times as the mix takes it.

    Null is a source of its own; a source without words gives nothing. Texts that are null, empty or without words are
    drawn as others of their source are; rows that repeat an id, null ids among them, get the same draw. An empty
    table stays empty; other columns, whatever their names, pass through; texts of any length count whole.
    """
    columns = docs.columns
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in columns]).alias("whole_row"), "doc_id", "source", "text")
    sizes = docs.select("source", word_count(F.col("text")).alias("size")).groupBy("source").agg(F.sum("size").alias("source_size"))
    found = rated(rows.drop("text").withColumn("size", F.lit(None).cast("long")), written(targets(sizes), "targets"))
    return found.filter("copies > 0").select("whole_row", F.explode(F.expr("sequence(1L, copies)")).alias("copy")).select("whole_row.*")
