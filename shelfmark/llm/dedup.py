"""Exact deduplication by two-pass Bloom filtering, in DataFrame functions alone.

Pass one hashes every normalised text to two places of a filter and keeps the places hit more than once.
Pass two looks both places of every row up; only rows with both among the repeated can have an equal
text elsewhere. Those rows are shuffled and grouped by the text's SHA-256; the others pass straight
through. The filter has BITS places at most (16 MB as bitmaps), whatever the data: with more documents
it lets more rows through to the shuffle, never fewer than needed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfmark.llm.common import code_points, without_space, written

#: Places of the filter; a bitmap of Spark's bitmap functions holds 32,768 of them.
BITS, BITMAP = 1 << 27, 32_768


def place(sha: Column, k: int, bits: int) -> Column:
    """Place k of a text in the filter, from 13 hexadecimal digits of its digest."""
    return F.pmod(F.conv(F.substring(sha, 1 + 13 * k, 13), 16, 10).cast("long"), F.lit(bits))


def bitmaps(places: DataFrame) -> DataFrame:
    """(bucket, bits) from places (at), in Spark's bitmaps: as many rows of 4 KB as the filter has times 32,768 places."""
    return places.groupBy(F.floor(F.col("at") / BITMAP).cast("long").alias("bucket")).agg(F.bitmap_construct_agg(F.col("at") % BITMAP).alias("bits"))


def repeated_places(sha: DataFrame, bits: int) -> DataFrame:
    """Bitmaps of the places hit by more than one row."""
    hits = sha.select(F.explode(F.array_distinct(F.array(place(F.col("sha"), 0, bits), place(F.col("sha"), 1, bits)))).alias("at"))
    return bitmaps(hits.groupBy("at").agg(F.count("*").alias("n")).filter("n > 1"))


def hit(rows: DataFrame, places: DataFrame, at: Column, name: str) -> DataFrame:
    """rows with the boolean column name: whether their place is set in the bitmaps."""
    # The filter's size is bounded by BITS, so it can be broadcast.
    joined = rows.withColumn("bucket", F.floor(at / BITMAP).cast("long")).join(F.broadcast(places), "bucket", "left")
    byte = F.conv(F.hex(F.substring(F.col("bits"), ((at % BITMAP) / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    is_set = F.getbit(byte, (at % 8).cast("int")) == 1
    return joined.withColumn(name, F.coalesce(is_set, F.lit(False))).drop("bucket", "bits")


def filter_bits(rows: int, most: int = BITS) -> int:
    """Places for so many rows: 32 or more a row, a power of two, as far as the bound allows."""
    return min(most, max(BITMAP, 1 << max(1, 32 * rows - 1).bit_length()))


def marked(rows: DataFrame, places: DataFrame, bits: int) -> DataFrame:
    """rows (with sha) and maybe: whether both places of the text are among the repeated."""
    first = hit(rows, places, place(F.col("sha"), 0, bits), "hit0")
    return hit(first, places, place(F.col("sha"), 1, bits), "hit1").withColumn("maybe", F.col("hit0") & F.col("hit1")).drop("hit0", "hit1")


def groups_of(maybe: DataFrame, least: int = 2) -> DataFrame:
    """(sha, keep, group_size) of texts with that many rows or more: keep is (-code points, doc_id is null, doc_id, row) of the row that stays."""
    found = maybe.groupBy("sha").agg(F.min(F.struct(-F.col("n_code"), F.col("doc_id").isNull(), F.col("doc_id"), F.col("row"))).alias("keep"), F.count("*").alias("group_size"))
    # Written, so that the join shuffles both sides anew and Spark can split a hot text.
    return written(found.filter(F.col("group_size") >= least), "groups")


def exact_groups(docs: DataFrame, most_bits: int = BITS) -> DataFrame:
    """One row per row of docs (doc_id, text): doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal when identical without white space; null counts as empty, and all empty texts are
    equal. Of a group the row with the most code points stays, then the smallest doc_id (null ids last);
    of rows that are the same in both just one is kept. An empty table gives an empty result; columns
    other than doc_id and text are ignored. No text is shuffled.
    """
    slim = docs.select("doc_id", F.sha2(without_space(F.col("text")), 256).alias("sha"), code_points(F.col("text")).alias("n_code"), F.monotonically_increasing_id().alias("row"))
    slim = written(slim, "digests")
    bits = filter_bits(slim.count(), most_bits)
    rows = marked(slim, written(repeated_places(slim, bits), "repeated"), bits)
    maybe = rows.filter("maybe").drop("maybe")
    grouped = maybe.join(groups_of(maybe), "sha", "left")
    alone = rows.filter("not maybe").select("doc_id", F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"), F.col("sha").alias("text_sha256"))
    rest = grouped.select(
        "doc_id",
        F.when(F.col("keep").isNull(), F.col("doc_id")).otherwise(F.col("keep.doc_id")).alias("keep_id"),
        F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"),
        F.coalesce(F.col("keep.row") == F.col("row"), F.lit(True)).alias("kept"),
        F.col("sha").alias("text_sha256"),
    )
    return alone.unionByName(rest)


def drop_exact_copies(docs: DataFrame, most_bits: int = BITS) -> DataFrame:
    """docs, all columns, without the rows that exact_groups does not keep.

    The dropped rows alone are looked up: rows whose text cannot repeat pass without a shuffle. Rows that
    agree in doc_id and text are copies too; one stays. Null, empty and blank texts are equal, so one of them stays;
    null ids come last among equals. An empty table stays empty; other columns, whatever their names, pass through.
    """
    columns = docs.columns
    key = docs.select(F.struct(*[F.col(f"`{c}`") for c in columns]).alias("kept_row"), F.col("doc_id"), F.col("text"))
    rows = key.select("kept_row", "doc_id", F.sha2(without_space(F.col("text")), 256).alias("sha"), code_points(F.col("text")).alias("n_code"))
    slim = written(rows.select("doc_id", "sha", "n_code").withColumn("row", F.lit(0)), "digests")
    bits = filter_bits(slim.count(), most_bits)
    places = written(repeated_places(slim, bits), "repeated")
    seen = marked(rows, places, bits)
    groups = groups_of(marked(slim, places, bits).filter("maybe").drop("maybe"), least=1)
    # Joined by the id and length too, so that the copies of a hot text are spread; rows that agree in those are what is left to drop.
    stays = groups.select(F.col("sha").alias("sha2"), F.col("keep.doc_id").alias("id2"), (-F.col("keep.col1")).alias("n2"))
    agree = (F.col("sha") == F.col("sha2")) & F.col("doc_id").eqNullSafe(F.col("id2")) & (F.col("n_code") == F.col("n2"))
    maybe = seen.filter("maybe").join(stays, agree, "left_semi").dropDuplicates(["sha"])
    return seen.filter("not maybe").select("kept_row.*").unionByName(maybe.select("kept_row.*"))
