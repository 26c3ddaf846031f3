"""Frequencies, distributions, overview and profile."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from shelfmark.functions.scalar import clamp, is_placeholder, percent, variant_key


def ascii_key(v: Column) -> Column:
    return variant_key(v, unicode=False)


def frequency(df: DataFrame, column: str, top_n: int = 0, min_count: int = 1, key: Callable[[Column], Column] = ascii_key, canonical: Callable[[Column], Column] | None = None, weight: str | None = None) -> DataFrame:
    """(key, name, count, aliases): spellings of one key are counted together; the commonest, then shortest, names it.

    Counts are added up per spelling before anything is normalised, so key and canonical see each spelling
    once. '' and null are left out; up to two more spellings are aliases; count falling, then name.
    weight names a column that says how often a row counts.
    """
    many = F.sum(weight) if weight else F.count("*")
    per = df.filter(F.col(column).isNotNull() & (F.trim(column) != "")).groupBy(F.trim(column).alias("raw")).agg(many.alias("c"))
    name = canonical(F.col("raw")) if canonical else F.col("raw")
    forms = per.withColumn("name", name).filter("name is not null and name <> ''").withColumn("key", key(F.col("name"))).withColumn("key", F.when(F.col("key") == "", F.col("name")).otherwise(F.col("key")))
    forms = forms.groupBy("key", "name").agg(F.sum("c").alias("c"))
    ranked = forms.groupBy("key").agg(F.sum("c").alias("count"), F.sort_array(F.collect_list(F.struct((-F.col("c")).alias("o"), F.length("name").alias("l"), "name"))).alias("names"))
    out = ranked.filter(F.col("count") >= min_count).select("key", F.col("names")[0]["name"].alias("name"), F.col("count").cast("long").alias("count"), F.array_join(F.transform(F.slice("names", 2, 2), lambda s: s["name"]), "|").alias("aliases"))
    return out.orderBy(F.desc("count"), "name").limit(top_n) if top_n else out


def canonicaliser(names: DataFrame, key: Callable[[Column], Column] = ascii_key) -> Callable[[DataFrame, str], DataFrame]:
    """Replace a column's values by the canonical name of their key. names: (variant, canonical), a small dimension."""
    dim = names.filter(~F.col("variant").startswith("_")).select(key(F.col("variant")).alias("_key"), "canonical").dropDuplicates(["_key"])
    return lambda df, column: df.withColumn("_key", key(F.col(column))).join(dim, "_key", "left").withColumn(column, F.coalesce("canonical", column)).drop("_key", "canonical")


def learn_aliases(df: DataFrame, column: str, key: Callable[[Column], Column] = ascii_key) -> DataFrame:
    """(variant, canonical): each spelling and the commonest one of its key."""
    per = df.groupBy(F.col(column).alias("variant")).agg(F.count("*").alias("c")).withColumn("key", key(F.col("variant")))
    best = W.partitionBy("key").orderBy(F.desc("c"), F.length("variant"), "variant").rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    return per.select("variant", F.first("variant").over(best).alias("canonical"))


def people_ranking(people: DataFrame, items: DataFrame, top_n: int = 30, min_count: int = 1) -> DataFrame:
    """(person, count, rated, avg_rating, min_year, max_year): averages over rated credits alone."""
    credits = people.join(items.select("item_id", "userrating", "year"), "item_id")
    rated = F.col("userrating") > 0
    out = credits.groupBy(F.trim("person").alias("person")).agg(F.count("*").alias("count"), F.count(F.when(rated, 1)).alias("rated"), F.round(F.avg(F.when(rated, F.col("userrating"))), 4).alias("avg_rating"), F.min(F.when(F.col("year") > 0, F.col("year"))).alias("min_year"), F.max("year").alias("max_year"))
    out = out.filter((F.col("person") != "") & (F.col("count") >= min_count))
    return out.orderBy(F.desc("count"), "person").limit(top_n) if top_n else out


def top_per(df: DataFrame, group: str, value: str, n: int) -> DataFrame:
    """(group, value, count, rank): the n commonest values of each group."""
    per = df.groupBy(group, value).agg(F.count("*").alias("count"))
    return per.withColumn("rank", F.row_number().over(W.partitionBy(group).orderBy(F.desc("count"), value))).filter(F.col("rank") <= n)


def person_ranking(people: DataFrame, items: DataFrame, top_n: int = 30, min_count: int = 1, stop_keys: list[str] = (), aliases: dict[str, str] | None = None, key: Callable[[Column], Column] = ascii_key) -> DataFrame:
    """(key, person, count, rated, avg_rating, runtime): people by key, spellings and aliases (key to name) together, without placeholders.

    The commonest spelling, then the shortest, names a person; averages are over rated credits alone.
    """
    rated = F.col("userrating") > 0
    credits = people.select("item_id", F.trim("person").alias("raw")).filter("raw <> ''").join(items.select("item_id", "userrating", "runtime_min"), "item_id")
    per = credits.groupBy("raw").agg(F.count("*").alias("c"), F.count(F.when(rated, 1)).alias("rated"), F.sum(F.when(rated, F.col("userrating").cast("decimal(30,12)"))).alias("total"), F.sum("runtime_min").alias("runtime"))
    per = per.withColumn("own", key(F.col("raw"))).filter(~is_placeholder(F.col("raw"), stop_keys, unicode=False))
    names = F.create_map(*[F.lit(x) for kv in (aliases or {"": ""}).items() for x in kv])
    per = per.withColumn("name", F.coalesce(F.get(F.array(names[F.col("own")]), F.lit(0)), F.col("raw"))).withColumn("key", key(F.col("name")))
    forms = per.groupBy("key", "name").agg(*[F.sum(c).alias(c) for c in ("c", "rated", "total", "runtime")])
    out = forms.groupBy("key").agg(F.min(F.struct((-F.col("c")).alias("o"), F.length("name"), F.col("name"))).alias("best"), *[F.sum(c).alias(c) for c in ("c", "rated", "total", "runtime")])
    avg = F.round(F.try_divide(F.col("total").cast("double"), F.col("rated")), 4)
    out = out.select("key", F.col("best.name").alias("person"), F.col("c").cast("long").alias("count"), F.col("rated").cast("long").alias("rated"), avg.alias("avg_rating"), F.col("runtime").cast("long").alias("runtime")).filter(F.col("count") >= min_count)
    return out.orderBy(F.desc("count"), "person").limit(top_n) if top_n else out


def enrichment(people: DataFrame, items: DataFrame, tags: DataFrame, who: DataFrame, studios: int = 3, top_tags: int = 6, partners: int = 3) -> DataFrame:
    """(person, part, value, count, rank) of the persons in who: their commonest studios, tags and partners. who is a ranking, so it is small."""
    credits = people.select("item_id", "person").distinct()
    own = credits.join(who.select("person"), "person", "left_semi")
    found = {
        "studio": (own.join(items.select("item_id", F.col("studio").alias("value")), "item_id"), studios),
        "tag": (own.join(tags.select("item_id", F.col("tag").alias("value")).distinct(), "item_id"), top_tags),
        "partner": (own.join(credits.withColumnRenamed("person", "value"), "item_id").filter("person <> value"), partners),
    }
    parts = [top_per(df.filter("value <> ''"), "person", "value", n).select("person", F.lit(part).alias("part"), "value", "count", "rank") for part, (df, n) in found.items()]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


def vote_summary(votes: DataFrame) -> DataFrame:
    """(total, up, down): one row."""
    return votes.agg(F.count("*").alias("total"), F.count(F.when(F.col("vote") > 0, 1)).alias("up"), F.count(F.when(F.col("vote") < 0, 1)).alias("down"))


def filled(counts: DataFrame, names: list[str]) -> DataFrame:
    """(name, count) in the order of names (ord), 0 where there is none."""
    spark = counts.sparkSession
    dim = spark.createDataFrame([(i, x) for i, x in enumerate(names)], "ord int, name string")
    return dim.join(counts, "name", "left").select("ord", "name", F.coalesce("count", F.lit(0)).cast("long").alias("count"))


def counted(df: DataFrame, name: Column) -> DataFrame:
    return df.groupBy(name.alias("name")).agg(F.count("*").alias("count")).filter("name is not null")


def by_rating(items: DataFrame) -> DataFrame:
    bins = F.least(F.greatest(F.floor("userrating"), F.lit(0)), F.lit(10)).cast("int").cast("string")
    return filled(counted(items.filter("userrating > 0"), bins), [str(k) for k in range(11)])


RUNTIMES = ((60, "<60"), (90, "60-89"), (120, "90-119"), (150, "120-149"), (180, "150-179"), (240, "180-239"))


def by_runtime(items: DataFrame) -> DataFrame:
    bins = F.when(F.col("runtime_min") < RUNTIMES[0][0], RUNTIMES[0][1])
    for edge, name in RUNTIMES[1:]:
        bins = bins.when(F.col("runtime_min") < edge, name)
    return filled(counted(items.filter("runtime_min > 0"), bins.otherwise("240+")), [n for _, n in RUNTIMES] + ["240+"])


def by_year(items: DataFrame) -> DataFrame:
    return counted(items.filter("year > 0"), F.col("year"))


def by_month(items: DataFrame, column: str = "dateadded") -> DataFrame:
    return counted(items, F.nullif(F.regexp_extract(column, r"^(\d{4}-\d{2})", 1), F.lit("")))


def by_hour(events: DataFrame, ts: str = "ts") -> DataFrame:
    return filled(counted(events, F.lpad(F.hour(ts).cast("string"), 2, "0")), [f"{h:02d}" for h in range(24)])


def by_weekday(events: DataFrame, ts: str = "ts") -> DataFrame:
    return filled(counted(events, F.weekday(ts).cast("string")), [str(k) for k in range(7)])


def by_resolution(items: DataFrame, order: list[str]) -> DataFrame:
    return filled(counted(items, F.when(F.col("resolution") == "", "unknown").otherwise(F.col("resolution"))), order)


def by_cast(items: DataFrame) -> DataFrame:
    n = F.col("n_people")
    return counted(items, F.when(n == 0, "0").when(n == 1, "1").when(n == 2, "2").when(n <= 5, "3-5").otherwise("6+"))


def overview(items: DataFrame, tags: DataFrame, people: DataFrame) -> DataFrame:
    """One row of totals. Distinct counts are exact and are taken on keys."""
    rated, timed = F.col("userrating") > 0, F.col("runtime_min") > 0
    one = items.agg(
        F.count("*").alias("items"),
        F.count(F.when(rated, 1)).alias("rated"),
        F.round(F.avg(F.when(rated, F.col("userrating"))), 4).alias("avg_rating"),
        F.round(F.max("userrating"), 4).alias("max_rating"),
        F.sum("runtime_min").cast("long").alias("runtime_total"),
        F.round(F.avg(F.when(timed, F.col("runtime_min"))), 4).alias("avg_runtime"),
        F.min(F.when(F.col("year") > 0, F.col("year"))).alias("min_year"),
        F.max("year").alias("max_year"),
        F.count_distinct("studio").alias("studios"),
        F.count_distinct("source").alias("sources"),
    ).withColumn("rated_percent", percent(F.col("rated"), F.col("items")))
    # Each spelling is counted first, so that its key is made once.
    t = tags.groupBy("tag").agg(F.count("*").alias("n")).agg(F.count_distinct(ascii_key(F.col("tag"))).alias("tags"), F.coalesce(F.sum("n"), F.lit(0)).alias("tag_rows"))
    p = people.select("person").distinct().agg(F.count_distinct(ascii_key(F.col("person"))).alias("people"))
    return one.join(t).join(p)  # one row each


def portrait(items: DataFrame, tags: DataFrame, people: DataFrame, high: tuple[str, ...]) -> DataFrame:
    """(dimension, value): eight dimensions from 0 to 100."""
    total = F.col("items")
    base = items.agg(
        F.count("*").alias("items"), F.count(F.when(F.col("resolution").isin(*high), 1)).alias("hd"), F.count(F.when(F.col("runtime_min") >= 120, 1)).alias("long"), F.count(F.when(F.col("userrating") > 0, 1)).alias("rated"), F.max("year").alias("last")
    )
    last = items.agg(F.max("year").alias("last"))
    recent = items.join(last).agg(F.count(F.when(F.col("year") >= F.col("last") - 1, 1)).alias("recent"))
    top = lambda df, c, n, name: df.groupBy(c).agg(F.count("*").alias("c")).orderBy(F.desc("c"), c).limit(n).agg(F.coalesce(F.sum("c"), F.lit(0)).alias(name))
    row = base.join(recent).join(top(people, "person", 10, "p10")).join(top(items, "studio", 3, "s3")).join(top(items, "source", 6, "r6")).join(tags.select("tag").distinct().agg(F.count_distinct(ascii_key(F.col("tag"))).alias("breadth")))
    values = {
        "tag breadth": F.col("breadth") / 300 * 100,
        "people focus": percent(F.col("p10"), total),
        "studio loyalty": percent(F.col("s3"), total),
        "high definition": percent(F.col("hd"), total),
        "long items": percent(F.col("long"), total),
        "rating activity": percent(F.col("rated"), total),
        "series": percent(F.col("r6"), total) * 2,
        "recency": percent(F.col("recent"), total) * 2,
    }
    pairs = F.array(*[F.struct(F.lit(k).alias("dimension"), F.round(clamp(v.cast("double")), 2).alias("value")) for k, v in values.items()])
    return row.select(F.explode(pairs).alias("x")).select("x.*")
