"""Co-occurrence, credits shared, similar items and themes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from shelfmark.cluster import written
from shelfmark.operators.freq import ascii_key
from shelfmark.operators.text import cut_titles


def cooccurrence(tags: DataFrame, top_tags: int = 40, top_pairs: int = 200) -> DataFrame:
    """(src, dst, weight): items that hold both of two of the commonest tags; each pair once, src < dst.

    Pairs are made inside items after the tags are cut to top_tags, so an item gives top_tags^2 / 2 at most.
    """
    # A key is made for each spelling, not for each row; spellings of the top keys are joined to the rows.
    forms = tags.groupBy("tag").agg(F.count("*").alias("n")).withColumn("key", ascii_key(F.col("tag"))).filter("key <> ''")
    top = forms.groupBy("key").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "key").limit(top_tags).select("key")
    some = tags.join(forms.join(top, "key").select("tag", "key"), "tag").select("item_id", "key").distinct()
    a, b = some.select("item_id", F.col("key").alias("src")), some.select("item_id", F.col("key").alias("dst"))
    edges = a.join(b, "item_id").filter("src < dst").groupBy("src", "dst").agg(F.count("*").alias("weight"))
    return edges.orderBy(F.desc("weight"), "src", "dst").limit(top_pairs)


def matrix(edges: DataFrame, diagonal: DataFrame | None = None) -> DataFrame:
    """(src, dst, weight) both ways; the diagonal, if given as (key, count), besides."""
    out = edges.unionByName(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "weight"))
    return out.unionByName(diagonal.select(F.col("key").alias("src"), F.col("key").alias("dst"), F.col("count").alias("weight"))) if diagonal is not None else out


def pairs_of_people(people: DataFrame, top_n: int = 30) -> DataFrame:
    """(person1, person2, count) of items that credit both."""
    some = people.select("item_id", "person").distinct()
    a, b = some.withColumnRenamed("person", "person1"), some.withColumnRenamed("person", "person2")
    out = a.join(b, "item_id").filter("person1 < person2").groupBy("person1", "person2").agg(F.count("*").alias("count"))
    return out.orderBy(F.desc("count"), "person1", "person2").limit(top_n)


def similar_items(tags: DataFrame, people: DataFrame, item_id: int, limit: int = 10, pool: int = 200) -> DataFrame:
    """(item_id, shared, score): Jaccard of tags and people with one item, exact on the pool that shares most."""
    # Distinct only where an item shares a token or is of the pool: the one item's tokens, bounded by it, go to the rows.
    tokens = tags.select("item_id", F.concat(F.lit("tag:"), "tag").alias("token")).unionByName(people.select("item_id", F.concat(F.lit("person:"), "person").alias("token")))
    own = tokens.filter(F.col("item_id") == item_id).select("token").distinct()
    n_own = own.agg(F.count("*").alias("n_own"))
    shared = tokens.filter(F.col("item_id") != item_id).join(own, "token").distinct().groupBy("item_id").agg(F.count("*").alias("shared"))
    best = shared.orderBy(F.desc("shared"), "item_id").limit(pool)
    sizes = tokens.join(F.broadcast(best.select("item_id")), "item_id", "left_semi").distinct().groupBy("item_id").agg(F.count("*").alias("n"))  # pool rows
    scored = best.join(sizes, "item_id").join(n_own).select("item_id", "shared", F.round(F.col("shared") / (F.col("n") + F.col("n_own") - F.col("shared")), 3).alias("score"))
    return scored.orderBy(F.desc("score"), "item_id").limit(limit)


def theme_pairs(tags: DataFrame, top_n: int = 80, min_co: int = 3, drop_share: float = 0.55) -> DataFrame:
    """(a, b, co, strength) of tags that are neither generic nor rare: co / (f1 + f2 - co)."""
    some = tags.select("item_id", "tag").distinct()
    total = some.agg(F.count_distinct("item_id").alias("total"))
    freq = some.groupBy("tag").agg(F.count("*").alias("f")).join(total).filter((F.col("f") <= drop_share * F.col("total")) & ~F.col("tag").rlike(r"^\d+$"))
    seeds = freq.orderBy(F.desc("f"), "tag").limit(top_n).select("tag", "f")
    held = some.join(F.broadcast(seeds), "tag")  # top_n rows
    a, b = held.select("item_id", F.col("tag").alias("a"), F.col("f").alias("fa")), held.select("item_id", F.col("tag").alias("b"), F.col("f").alias("fb"))
    co = a.join(b, "item_id").filter("a < b").groupBy("a", "b", "fa", "fb").agg(F.count("*").alias("co")).filter(F.col("co") >= min_co)
    return co.select("a", "b", "fa", "fb", "co", F.round(F.col("co") / (F.col("fa") + F.col("fb") - F.col("co")), 6).alias("strength"))


def themes(pairs: list, min_co: int = 3, members: int = 12) -> list[dict]:
    """Greedy clusters over the seeds' pairs (top_n^2 / 2 rows at most): each unused seed takes its strongest unused partners."""
    freq, near = {}, {}
    for p in pairs:
        freq[p["a"]], freq[p["b"]] = p["fa"], p["fb"]
        near.setdefault(p["a"], []).append((p["strength"], p["co"], p["b"]))
        near.setdefault(p["b"], []).append((p["strength"], p["co"], p["a"]))
    used, out = set(), []
    for seed in sorted(freq, key=lambda t: (-freq[t], t)):
        if seed in used:
            continue
        least = min_co + max(0, (freq[seed] - 50) // 50)
        with_it = [t for _, co, t in sorted(near.get(seed, []), key=lambda x: (-x[0], x[2])) if t not in used and co >= least][:members]
        if with_it:
            used.update([seed, *with_it])
            out.append({"label": " × ".join([seed, *with_it[:2]]), "members": [seed, *with_it]})
    return out


#: Tags that hold in most libraries and tell nothing of a theme.
GENERIC = "单体作品 作品 高清 标清 蓝光 字幕 中文字幕 日本 合集 总集篇 无修正 独家 首发 下载 真人 成人 限制级 未删减 完整版".split()
PICK = "struct<item_id:long,code:string,title:string,rating:double>"
THEME = (
    "cluster int, theme string, kind string, label string, size long, share double, members array<struct<name:string,kind:string,strength:double,co:long>>, subthemes array<struct<label:string,count:long,strength:double>>, "
    f"representatives array<{PICK}>, avg_rating double, year_min int, year_max int, children array<struct<theme:string,label:string,size:long,share:double,members:array<string>,representatives:array<{PICK}>>>"
)


def theme_seeds(items: DataFrame, tags: DataFrame, total: int, top_n: int = 80, stop: list[str] = (), drop_share: float = 0.55, n_known: int = 500) -> tuple[list, DataFrame]:
    """(token, f, kind) of the commonest tags (3 top_n) and title terms (top_n) that are not generic, 2 top_n rows at most; and (item_id, token) of all items."""
    some = tags.select("item_id", "tag").filter("trim(tag) <> ''").distinct()
    freq = written(some.groupBy("tag").agg(F.count("*").alias("f")), "tags")
    known = [r["tag"].strip() for r in freq.filter("f >= 3").orderBy(F.desc("f"), "tag").limit(n_known).collect()]
    terms = written(items.select("item_id", F.explode(cut_titles(known, stop)(F.col("title"))).alias("token")), "terms")
    common = freq.orderBy(F.desc("f"), "tag").limit(3 * top_n).select(F.col("tag").alias("token"), "f", F.lit("tag").alias("kind"))
    titled = terms.groupBy("token").agg(F.count("*").alias("f")).filter("f >= 2").orderBy(F.desc("f"), "token").limit(top_n).select("token", "f", F.lit("title_term").alias("kind"))
    pool = common.unionByName(titled).filter((F.col("f") <= drop_share * total) & ~F.col("token").rlike(r"^\d+$") & ~F.col("token").isin(GENERIC))
    # A token that is both counts as what it is more often.
    seeds = pool.groupBy("token").agg(F.max(F.struct("f", "kind")).alias("best")).select("token", "best.*").orderBy(F.desc("f"), "token").limit(2 * top_n).collect()
    dim = items.sparkSession.createDataFrame([(r["token"],) for r in seeds], "token string")
    return seeds, some.withColumnRenamed("tag", "token").unionByName(terms).distinct().join(F.broadcast(dim), "token", "left_semi")


def _together(held: DataFrame, *by: str) -> DataFrame:
    """(by, a, b, co) of tokens that items hold both, a < b."""
    a, b = (held.select("item_id", *by, F.col("token").alias(x)) for x in ("a", "b"))
    return a.join(b, ["item_id", *by]).filter("a < b").groupBy(*by, "a", "b").agg(F.count("*").alias("co"))


def _picked(hits: DataFrame, items: DataFrame, by: str, n: int) -> dict:
    """The n items with the most hits of each by, as PICK."""
    first = hits.withColumn("rank", F.row_number().over(W.partitionBy(by).orderBy(F.desc("hits"), "item_id"))).filter(F.col("rank") <= n)
    out: dict = {}
    for r in first.join(items.select("item_id", "code", "title", "userrating"), "item_id").orderBy(by, "rank").collect():  # n rows a theme
        out.setdefault(r[by], []).append((r["item_id"], r["code"], r["title"] or "", float(r["userrating"] or 0)))
    return out


def _children(freq: dict, co: dict, parent: set, size: int) -> list[list[str]]:
    """Greedy groups of the tokens that a theme's items hold besides its own."""
    pool = sorted((t for t, f in freq.items() if t not in parent and f >= max(5, size * 0.01)), key=lambda t: (-freq[t], t))
    least, used, out = max(3, int(size * 0.005)), set(), []
    for seed in pool:
        if seed in used:
            continue
        near = [(co.get((min(seed, t), max(seed, t)), 0), t) for t in pool if t not in used and t != seed]
        near = sorted((-n / (freq[seed] + freq[t] - n), t) for n, t in near if n >= least)[:4]
        used.update([seed, *(t for _, t in near)])
        if near:
            out.append([seed, *(t for _, t in near)])
    return out


def theme_clusters(items: DataFrame, tags: DataFrame, top_n: int = 80, min_co: int = 3, min_size: int = 4, n_picks: int = 5, max_share: float = 0.2, stop: list[str] = ()) -> DataFrame:
    """Themes of tags and title terms, as THEME, large ones first.

    Greedy over 2 top_n seeds. An item goes to the theme with the most hits, two at least, the first on ties; themes of
    less than min_size items go, or all but the ten largest if none has so many. Rating and years are of all rated
    items of a theme. A theme with max_share of all items and 200 items or more has up to four children, found
    in its own items. Only tables of seeds, their pairs and n_picks items a theme reach the driver.
    """
    spark, total = items.sparkSession, items.count()
    seeds, held = theme_seeds(items, tags, total, top_n, stop)
    kind, freq = {r["token"]: r["kind"] for r in seeds}, {r["token"]: r["f"] for r in seeds}
    held = written(held, "held")
    co = {(r["a"], r["b"]): r["co"] for r in _together(held).filter("co >= 2").collect()}
    strength = {(a, b): n / (freq[a] + freq[b] - n) for (a, b), n in co.items()}
    found = themes([{"a": a, "b": b, "fa": freq[a], "fb": freq[b], "co": n, "strength": strength[a, b]} for (a, b), n in co.items()], min_co)

    dim = spark.createDataFrame([(k, t) for k, c in enumerate(found) for t in c["members"]], "cluster int, token string")
    hits = written(held.join(F.broadcast(dim), "token").groupBy("item_id", "cluster").agg(F.count("*").alias("hits")).filter("hits >= 2"), "hits")
    own = written(hits.groupBy("item_id").agg(F.min(F.struct((-F.col("hits")).alias("h"), "cluster")).alias("best")).select("item_id", "best.cluster"), "own")
    sizes = {r["cluster"]: r["size"] for r in own.groupBy("cluster").agg(F.count("*").alias("size")).collect()}
    by_size = sorted(range(len(found)), key=lambda k: (-sizes.get(k, 0), k))
    keep = [k for k in by_size if sizes.get(k, 0) >= min_size] or by_size[:10]
    picked = _picked(hits.filter(F.col("cluster").isin(keep)), items, "cluster", n_picks)
    rated = own.join(items.select("item_id", "userrating", "year"), "item_id").filter("userrating > 0")
    facts = {r["cluster"]: r for r in rated.groupBy("cluster").agg(F.avg("userrating").alias("rating"), F.min(F.expr("nullif(year, 0)")).alias("first"), F.max(F.expr("nullif(year, 0)")).alias("last")).collect()}

    large = [k for k in keep if sizes.get(k, 0) >= max(200, max_share * total)]
    inside = held.join(own.filter(F.col("cluster").isin(large)), "item_id")
    local: dict = {k: ({}, {}) for k in large}
    if large:
        inside = written(inside, "inside")
        for r in inside.groupBy("cluster", "token").agg(F.count("*").alias("f")).collect():
            local[r["cluster"]][0][r["token"]] = r["f"]
        for r in _together(inside, "cluster").collect():
            local[r["cluster"]][1][r["a"], r["b"]] = r["co"]
    parts = [(k, names) for k in large for names in _children(*local[k], set(found[k]["members"]), sizes[k])]
    part_sizes, part_picks = {}, {}
    if parts:
        dim = spark.createDataFrame([(k, n, t) for n, (k, names) in enumerate(parts) for t in names], "cluster int, part int, token string")
        part_hits = written(inside.join(F.broadcast(dim), ["cluster", "token"]).groupBy("part", "item_id").agg(F.count("*").alias("hits")).filter("hits >= 2"), "part_hits")
        part_sizes = {r["part"]: r["size"] for r in part_hits.groupBy("part").agg(F.count("*").alias("size")).collect()}
        part_picks = _picked(part_hits, items, "part", 2)

    rows = []
    for k in keep:
        names = found[k]["members"]
        pairs = sorted(((strength[p], a, b, co[p]) for i, a in enumerate(names) for b in names[i + 1 :] if (p := (min(a, b), max(a, b))) in co), key=lambda x: -x[0])
        seen, subs = set(), []
        for value, a, b, n in pairs:
            if len(subs) < 3 and not {a, b} <= seen:
                seen |= {a, b}
                subs.append((f"{a} × {b}", n, round(value, 3)))
        members = [(t, kind[t], round(strength[p], 3), co[p]) for t in names[1:] for p in [(min(names[0], t), max(names[0], t))]]
        size, fact = sizes.get(k, 0), facts.get(k)
        kids = [(g[0], " × ".join(g[:3]), part_sizes[n], round(part_sizes[n] / total, 4), g[1:], part_picks[n]) for n, (at, g) in enumerate(parts) if at == k and part_sizes.get(n, 0) >= max(20, size * 0.02)][:4]
        years = (fact["first"], fact["last"]) if fact else (None, None)
        rows.append((k, names[0], kind[names[0]], found[k]["label"], size, round(size / max(1, total), 4), members, subs, picked.get(k, []), round(float(fact["rating"]), 2) if fact else 0.0, *years, sorted(kids, key=lambda x: -x[2])))
    return spark.createDataFrame(rows, THEME)
