"""Preference profiles and recommendations. State (seen batches, seeds, today) is passed in."""

from __future__ import annotations

import datetime
import math
import random
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfmark.cluster import written
from shelfmark.operators.search import recent_ids

#: Fixed values of the scoring rules: weights by token kind, horizon of recency in days, plays that are free of penalty.
WEIGHTS = {"tag": 2.0, "person": 2.0, "director": 2.0, "studio": 1.0, "title": 1.0}
RECENT_DAYS, FREE_PLAYS, FORGET = 180, 3, 12


def tokens(items: DataFrame, tags: DataFrame, people: DataFrame, directors: DataFrame | None = None, terms: DataFrame | None = None) -> DataFrame:
    """(item_id, kind, value), distinct: tags, people and studios; directors (item_id, director) and title terms (item_id, term) if given."""
    named = {"tag": (tags, "tag"), "person": (people, "person"), "studio": (items, "studio"), "director": (directors, "director"), "title": (terms, "term")}
    parts = [df.select("item_id", F.lit(kind).alias("kind"), F.col(column).alias("value")) for kind, (df, column) in named.items() if df is not None]
    return reduce(DataFrame.unionByName, parts).filter("value <> ''").distinct()


def document_frequency(all_tokens: DataFrame) -> DataFrame:
    return all_tokens.groupBy("kind", "value").agg(F.count("*").alias("df"))


def damped(df: Column, total: Column) -> Column:
    """Factor of rarity: ln(N / df) / ln(N / ref) with ref = max(50, N / 1000), from 0.05 to 1; 1 for an unseen token."""
    ref = F.greatest(F.lit(50.0), total * 0.001)
    ref_idf = F.when(total > ref, F.ln(total / ref)).otherwise(1.0)
    return F.when(df > 0, F.least(F.greatest(F.ln(total / df) / ref_idf, F.lit(0.05)), F.lit(1.0))).otherwise(1.0)


def profile(all_tokens: DataFrame, votes: DataFrame, total: int, overrides: DataFrame | None = None) -> DataFrame:
    """(kind, value, pos, neg): weights of the tokens of voted items by sign, damped by rarity; overrides (kind, value, weight) are added, 0 deletes."""
    weight = F.element_at(F.create_map(*[F.lit(x) for kv in WEIGHTS.items() for x in kv]), F.col("kind"))
    # Half a join first: it reaches the sources below the distinct, so only voted items' rows are made distinct.
    voted = all_tokens.join(votes.select("item_id"), "item_id", "left_semi").join(votes.select("item_id", "vote"), "item_id").withColumn("w", weight)
    sums = voted.groupBy("kind", "value").agg(F.sum(F.when(F.col("vote") > 0, F.col("w")).otherwise(0.0)).alias("pos"), F.sum(F.when(F.col("vote") < 0, F.col("w")).otherwise(0.0)).alias("neg"))
    factor = damped(F.col("df"), F.lit(float(total))) * F.when(F.col("kind") == "title", 0.5).otherwise(1.0)
    # Only tokens of voted items are counted.
    known = document_frequency(all_tokens.join(sums.select("kind", "value"), ["kind", "value"], "left_semi"))
    auto = sums.join(known, ["kind", "value"], "left").select("kind", "value", F.round(F.col("pos") * factor, 6).alias("pos"), F.round(F.col("neg") * factor, 6).alias("neg"))
    if overrides is None:
        return auto
    both = auto.join(overrides, ["kind", "value"], "full").withColumn("weight", F.col("weight"))
    kept = both.filter("weight is null or weight <> 0")
    add = lambda c, sign: F.coalesce(c, F.lit(0.0)) + F.greatest(F.coalesce(F.col("weight"), F.lit(0.0)) * sign, F.lit(0.0))
    return kept.select("kind", "value", add(F.col("pos"), 1).alias("pos"), add(F.col("neg"), -1).alias("neg"))


def vector_snapshot(all_tokens: DataFrame, votes: DataFrame, total: int, overrides: DataFrame) -> DataFrame:
    """(kind, value, auto_pos, auto_neg, manual, pos, neg): weights from votes, the override if any, and what holds in the end (0 if deleted)."""
    auto = profile(all_tokens, votes, total).withColumnRenamed("pos", "auto_pos").withColumnRenamed("neg", "auto_neg")
    effective = profile(all_tokens, votes, total, overrides)
    out = auto.join(overrides.withColumnRenamed("weight", "manual"), ["kind", "value"], "full").join(effective, ["kind", "value"], "left")
    return out.select("kind", "value", *[F.coalesce(c, F.lit(0.0)).alias(c) for c in ("auto_pos", "auto_neg")], "manual", *[F.coalesce(c, F.lit(0.0)).alias(c) for c in ("pos", "neg")])


def override_rows(snapshot: DataFrame, kind: str = "", text: str = "", manual_only: bool = False) -> DataFrame:
    """Rows of a snapshot of one kind, whose value holds a text, with an override only."""
    out = snapshot.filter(F.col("kind") == kind) if kind else snapshot
    out = out.filter(F.lower("value").contains(text.lower())) if text else out
    return out.filter("manual is not null") if manual_only else out


def base_scores(all_tokens: DataFrame, preference: DataFrame) -> DataFrame:
    """(item_id, score): sum of pos - neg over an item's tokens."""
    return all_tokens.join(preference, ["kind", "value"]).groupBy("item_id").agg(F.round(F.sum((F.col("pos") - F.col("neg")).cast("decimal(20,6)")), 4).cast("double").alias("score"))


def recency_boost(premiered: Column, dateadded: Column, today: str, jitter: float) -> Column:
    """jitter * 0.7 * (0.45 + 0.55 (1 - age / 180)) for ages of 0 to 180 days, else 0."""
    day = F.coalesce(F.try_to_date(F.substring(premiered, 1, 10), "yyyy-MM-dd"), F.try_to_date(F.substring(dateadded, 1, 10), "yyyy-MM-dd"))
    age = F.datediff(F.lit(today).cast("date"), day)
    return F.when(age.between(0, RECENT_DAYS), F.round(jitter * 0.7 * (0.45 + 0.55 * (1 - age / RECENT_DAYS)), 6)).otherwise(0.0)


def browse_penalty(plays: Column, vote: Column, jitter: float) -> Column:
    """-min(1.2, 0.12 (plays - 3)) * jitter for items played more than 3 times without a vote."""
    return F.when(vote.isNull() & (plays > FREE_PLAYS), F.round(-F.least(F.lit(1.2), 0.12 * (plays - FREE_PLAYS)) * jitter, 6)).otherwise(0.0)


def recent_penalty(seen_batch: Column, batch: int, jitter: float) -> Column:
    """Falls from the batch just before to FORGET batches ago."""
    gap = F.lit(batch) - seen_batch
    return F.when(gap.between(1, FORGET), -jitter * (1 - (gap - 1) / FORGET)).otherwise(0.0)


def mmr(candidates: list[int], base: dict[int, float], held: dict[int, set], k: int, diversity: float) -> list[int]:
    """Greedy choice of k: (1 - diversity) * scaled score - diversity * highest Jaccard with those chosen; the first is the head of the list."""
    low, high = min(base.values(), default=0.0), max(base.values(), default=0.0)
    scaled = {i: (base[i] - low) / (high - low) if high > low else 0.0 for i in candidates}
    chosen, left = candidates[:1], candidates[1:]
    jaccard = lambda a, b: len(held[a] & held[b]) / max(1, len(held[a] | held[b]))
    while left and len(chosen) < k:
        best = max(left, key=lambda i: ((1 - diversity) * scaled[i] - diversity * max(jaccard(i, c) for c in chosen), -i))
        chosen.append(best)
        left.remove(best)
    return chosen[:k]


def picks(items: DataFrame, all_tokens: DataFrame, preference: DataFrame, votes: DataFrame, plays: DataFrame, *, today: str, seed: int = 1, limit: int = 18, pool: int = 2000, explore: int = 3, diversity: float = 0.5, seen: DataFrame | None = None, batch: int = 0, favoured: DataFrame | None = None, boost_recent: bool = True, demote_browsed: bool = True) -> DataFrame:
    """(item_id, score) of the picks: a seeded random pool without voted items, scored on the cluster; pool rows at most reach the driver.

    The pool has 2 * pool items. Favoured items (item_id), as many at most, join it and score 2 * jitter more.

    Tiers by score (30, 45, 25 percent) give their quotas in a jittered order, diversified by greedy choice;
    what is missing is filled from the whole order. Without votes all items score alike: the order is that of
    recency, plays and the favoured.
    """
    spark = items.sparkSession
    unvoted = items.join(votes.select("item_id"), "item_id", "left_anti").select("item_id", "premiered", "dateadded")
    at = F.xxhash64(F.lit(seed), "item_id")
    fresh = unvoted.orderBy(at).limit(2 * pool).withColumn("favoured", F.lit(False))
    if favoured is not None:
        wanted = unvoted.join(favoured.select("item_id").distinct(), "item_id", "left_semi").orderBy(at).limit(2 * pool).withColumn("favoured", F.lit(True))
        fresh = fresh.join(wanted.select("item_id"), "item_id", "left_anti").unionByName(wanted)
    fresh = written(fresh, "pool")  # 4 * pool rows at most
    some = written(all_tokens.join(F.broadcast(fresh.select("item_id")), "item_id", "left_semi"), "pool_tokens")
    scored = fresh.join(base_scores(some, preference), "item_id", "left").join(plays.select("item_id", "play_count"), "item_id", "left").withColumn("base", F.coalesce("score", F.lit(0.0)))
    # What is added hangs on the jitter in proportion, so it is taken for a jitter of 1 and one job gives all.
    unit = F.lit(0.0)
    if boost_recent:
        unit = unit + recency_boost(F.col("premiered"), F.col("dateadded"), today, 1.0)
    if demote_browsed:
        unit = unit + browse_penalty(F.coalesce("play_count", F.lit(0)), F.lit(None), 1.0)
    if seen is not None:
        scored = scored.join(seen.select("item_id", "batch"), "item_id", "left")
        unit = unit + F.coalesce(recent_penalty(F.col("batch"), batch, 1.0), F.lit(0.0))
    found = scored.select("item_id", "base", "favoured", unit.alias("unit")).collect()  # the pool and favoured items
    jitter = max([2.0, *(0.6 * abs(r["base"]) for r in found)])
    rows = [{"item_id": r["item_id"], "base": r["base"] + 2 * jitter * r["favoured"], "total": r["base"] + jitter * (r["unit"] + 2 * r["favoured"])} for r in found]
    rows.sort(key=lambda r: (-r["total"], r["item_id"]))
    draw = random.Random(seed)
    noisy = {r["item_id"]: r["total"] + draw.random() * jitter for r in rows}
    if not any(r["base"] for r in found):  # no votes, or none that says anything of the pool
        return spark.createDataFrame([(r["item_id"], float(r["total"])) for r in rows[:limit]], "item_id long, score double")
    n = len(rows)
    high, mid = math.ceil(0.3 * n), math.ceil(0.75 * n)
    tiers = [rows[:high], rows[high:mid], [r for r in rows[mid:] if r["base"] >= 0]]
    few = min(explore, limit // 6)
    quotas = [limit - few - (limit - few) * 2 // 5, (limit - few) * 2 // 5, few]
    heads = [sorted((r["item_id"] for r in t), key=lambda i: (-noisy[i], i))[:150] for t in tiers]
    wanted = [i for h in heads for i in h]
    held: dict[int, set] = {i: set() for i in wanted}
    if wanted:
        for r in some.filter(F.col("item_id").isin(wanted)).groupBy("item_id").agg(F.collect_set(F.concat_ws(":", "kind", "value")).alias("t")).collect():
            held[r["item_id"]] = set(r["t"])
    out: list[int] = []
    for head, quota in zip(heads, quotas, strict=True):
        out += mmr(head, noisy, held, quota, diversity) if quota else []
    out += [i for i in sorted(noisy, key=lambda i: (-noisy[i], i)) if i not in out][: max(0, limit - len(out))]
    return spark.createDataFrame([(i, float(noisy[i])) for i in out], "item_id long, score double")


def random_picks(items: DataFrame, all_tokens: DataFrame, preference: DataFrame, votes: DataFrame, plays: DataFrame, *, today: str, limit: int = 10, explore: int = 1, diversity: float = 0.35, **more) -> DataFrame:
    """(item_id, score): the base flow with its own defaults; more goes to picks."""
    return picks(items, all_tokens, preference, votes, plays, today=today, limit=limit, explore=explore, diversity=diversity, **more)


def remembered(seen: DataFrame, shown: DataFrame, batch: int, most: int = 2000) -> DataFrame:
    """(item_id, batch): the memory after a batch; batches FORGET ago and older are forgotten, the latest most items stay."""
    new = shown.select("item_id", F.lit(batch).cast("long").alias("batch"))
    both = seen.select("item_id", F.col("batch").cast("long").alias("batch")).unionByName(new).groupBy("item_id").agg(F.max("batch").alias("batch"))
    return both.filter(F.lit(batch) - F.col("batch") < FORGET).orderBy(F.desc("batch"), "item_id").limit(most)


def liked_person(items: DataFrame, people: DataFrame, votes: DataFrame, out: DataFrame, seed: int, batch: int, used: DataFrame | None = None) -> DataFrame:
    """(item_id, person): one item, not of out, that shares a person with an up-voted one, both drawn by the seed and batch.

    Persons that gave an item (used: person, batch) FORGET batches ago or later are passed over, unless all are.
    """
    some = people.select("item_id", "person").filter("person <> ''").distinct()
    liked = some.join(votes.filter("vote > 0").select("item_id"), "item_id", "left_semi").select("person").distinct()
    if used is not None:
        rested = liked.join(used.filter(F.lit(batch) - F.col("batch") <= FORGET).select("person"), "person", "left_anti")
        liked = liked if rested.isEmpty() else rested
    free = some.join(liked, "person", "left_semi").join(items.select("item_id"), "item_id", "left_semi").join(out, "item_id", "left_anti")
    draw = lambda c: F.xxhash64(F.lit(seed), F.lit(batch), c)
    return free.orderBy(draw("person"), "person", draw("item_id"), "item_id").limit(1).select("item_id", "person")


def smart_picks(items: DataFrame, all_tokens: DataFrame, preference: DataFrame, votes: DataFrame, plays: DataFrame, people: DataFrame, *, today: str, seed: int = 1, limit: int = 18, pool: int = 2000, explore: int = 3, diversity: float = 0.5, seen: DataFrame | None = None, batch: int = 0, favoured: DataFrame | None = None, used: DataFrame | None = None) -> DataFrame:
    """(item_id, score, part, person) of the picks, with what they should cover besides, from the whole items table.

    Two items of the last RECENT_DAYS days, two of the last 30 (often the same) and one that shares a liked person
    follow the base flow, whose tail is cut to limit; none of them is voted or was shown FORGET batches ago or
    later. part is base, recent or liked; person is the one to pass in used next time. The base flow
    runs short of limit only when it has all items without a vote, so there is nothing to fill up with.
    """
    spark = items.sparkSession
    base = [tuple(r) for r in picks(items, all_tokens, preference, votes, plays, today=today, seed=seed, limit=limit, pool=pool, explore=explore, diversity=diversity, seen=seen, batch=batch, favoured=favoured).collect()]
    out = votes.select("item_id").unionByName(spark.createDataFrame([(i,) for i, _ in base], "item_id long"))
    if seen is not None:
        out = out.unionByName(seen.filter(F.lit(batch) - F.col("batch") <= FORGET).select("item_id"))
    more = {r["item_id"]: ("recent", None) for days in (RECENT_DAYS, 30) for r in recent_ids(items, str(datetime.date.fromisoformat(today) - datetime.timedelta(days)), 2, out).collect()}
    out = out.unionByName(spark.createDataFrame([(i,) for i in more], "item_id long"))
    more |= {r["item_id"]: ("liked", r["person"]) for r in liked_person(items, people, votes, out, seed, batch, used).collect()}
    rows = [(i, score, "base", None) for i, score in base[: max(0, limit - len(more))]] + [(i, 0.0, *x) for i, x in more.items()]
    return spark.createDataFrame(rows[:limit], "item_id long, score double, part string, person string")


def vote_records(votes: DataFrame, items: DataFrame, plays: DataFrame, sign: int = 0) -> DataFrame:
    """Votes with what they stand on; a sign keeps those of it."""
    out = votes.join(items.select("item_id", "code", "title", "studio"), "item_id", "left").join(plays.select("item_id", "play_count"), "item_id", "left").withColumn("play_count", F.coalesce("play_count", F.lit(0)))
    return out.filter(F.col("vote") == sign) if sign else out


def play_records(plays: DataFrame, items: DataFrame, votes: DataFrame) -> DataFrame:
    return plays.join(items.select("item_id", "code", "title", "studio"), "item_id", "left").join(votes.select("item_id", "vote"), "item_id", "left").withColumn("vote", F.coalesce("vote", F.lit(0)))


def toggled(current: int | None, vote: int) -> int | None:
    """A vote given twice is taken back."""
    return None if current == vote else vote
