"""Answers of the similarity join derived from a leader's: classes known by how they differ from one centre.

All classes that were compared with one leader are described by the shingles in which they differ from a
centre of the group: the leader with every shingle flipped in which more than half of the classes differ from it. With d
the size of such a difference, n that of the set and p the percentage, two classes with differences that share i shingles
link exactly if 2 (100 + p) i >= s1 + s2, where s = (100 + p) d - (100 - p) n. So

- classes with s1 + s2 <= 0 link without a look, and one link to the class of the least s stands for all of these;
- the others link only if their differences share shingles, so few classes are left as partners: what a class
  alone differs in does not count, and copies with changes of their own differ from the centre in little else.

Differences are short, so nothing else of the sets is needed.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfmark.llm.common import dropped, written


def centred(led: DataFrame, percent: int) -> DataFrame:
    """(leader, class, n, diff, s, least, lead) from (leader, class, n, diff): diff against the centre, the least s of the group and its class."""
    counts = led.select("leader", F.explode("diff").alias("shingle")).groupBy("leader", "shingle").agg(F.count("*").alias("k")).filter("k > 1")
    sizes = written(led.groupBy("leader").agg(F.count("*").alias("size")), "sizes")
    flips = counts.join(sizes, "leader").filter("2 * k > size").groupBy("leader").agg(F.collect_list("shingle").alias("flip"))
    flips = written(flips, "flips")
    none = F.array().cast("array<bigint>")
    flip = F.coalesce("flip", none)
    rows = led.join(flips, "leader", "left").select("leader", "class", "n", F.concat(F.array_except("diff", flip), F.array_except(flip, "diff")).alias("diff"))
    rows = written(rows.withColumn("s", F.expr(f"{100 + percent}L * size(diff) - {100 - percent}L * n")), "differences")
    least = written(rows.groupBy("leader").agg(F.min(F.struct("s", "class")).alias("best")), "least")
    out = written(rows.join(least, "leader").select(*rows.columns, F.col("best.s").alias("least"), F.col("best.class").alias("lead")), "centred")
    dropped(sizes, flips, rows, least)
    return out


def certain(rows: DataFrame) -> DataFrame:
    """(a, b): links that need no look."""
    return rows.filter("class <> lead and s + least <= 0").select(F.col("class").alias("a"), F.col("lead").alias("b"))


def inside(rows: DataFrame, place: DataFrame, percent: int) -> DataFrame:
    """(a, b): links between classes of one leader that lie in different components (place: node, component)."""
    whole = 2 * (100 + percent)
    # A pair that is left has one class, at least, beyond the reach of the least one.
    beyond = written(rows.filter("s + least > 0").groupBy("leader").agg(F.min("s").alias("near")), "beyond")
    some = rows.join(beyond, "leader").join(place.withColumnRenamed("node", "class"), "class", "left").withColumn("component", F.coalesce("component", "class"))
    some = written(some.withColumn("out", F.expr("s + least > 0")).withColumn("worth", F.expr(f"greatest(1L, (s + if(out, least, near) + {whole - 1}L) div {whole}L)")), "some")
    posted = some.select("leader", "class", "n", "s", "component", "out", "worth", F.explode("diff").alias("shingle"))
    known = posted.groupBy("leader", "shingle").agg(F.count("*").alias("k"), F.bool_or("out").alias("any"), F.min("component").alias("c1"), F.max("component").alias("c2")).filter("k > 1 and any and c1 < c2").select("leader", "shingle", "k")
    known = written(known, "known")
    held = posted.join(known, ["leader", "shingle"]).groupBy("leader", "class", "n", "s", "component", "out", "worth").agg(F.sort_array(F.collect_list(F.struct("k", "shingle"))).alias("found"))
    held = held.withColumn("held", F.size("found")).filter("held >= worth")
    first = F.expr("slice(found.shingle, 1, cast(held - worth + 1 as int))")
    lists = written(held.select("leader", "class", "n", "s", "component", "out", "held", F.posexplode(first).alias("rank", "shingle")), "lists")
    one, two = (lists.select("leader", "shingle", *[F.col(c).alias(f"{c}{k}") for c in ("class", "n", "s", "component", "out", "held", "rank")]) for k in (1, 2))
    share = f"((s1 + s2 + {whole - 1}L) div {whole}L)"
    fits = F.expr(f"component1 <> component2 and class1 < class2 and (out1 or out2) and 100L * least(n1, n2) >= {percent}L * greatest(n1, n2) and least(held1 - rank1, held2 - rank2) >= {share}")
    pairs = written(one.join(two, ["leader", "shingle"]).filter(fits).select(F.col("class1").alias("a"), F.col("class2").alias("b")), "rows").distinct()
    ends = [some.select(F.col("class").alias(c), F.col("diff").alias(f"diff{c}"), F.col("s").alias(f"s{c}")) for c in ("a", "b")]
    out = pairs.join(ends[0], "a").join(ends[1], "b").filter(F.expr(f"{whole}L * size(array_intersect(diffa, diffb)) >= sa + sb")).select("a", "b")
    out = written(out, "inside")
    dropped(beyond, some, known, lists)
    return out
