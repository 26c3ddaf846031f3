"""Title terms and keyword discovery without a dictionary."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfmark.cluster import written

_SEGMENT = re.compile("[一-鿿A-Za-z0-9]+")
_IDEOGRAPH = re.compile("[一-鿿]")


def tokenize(title: str | None, known: frozenset = frozenset(), stop: frozenset = frozenset(), least: int = 2, most: int = 4) -> list[str]:
    """Terms of a title: ASCII words of two signs or more; in segments with ideographs the longest known word from each place, else pieces of most signs."""
    out = []
    for segment in _SEGMENT.findall(title or ""):
        if not _IDEOGRAPH.search(segment):
            out += [segment] if len(segment) >= least else []
            continue
        at = 0
        while at < len(segment):
            size = next((n for n in range(most, least - 1, -1) if segment[at : at + n] in known and at + n <= len(segment)), 0)
            piece = segment[at : at + (size or most)]
            if len(piece) >= least:
                out.append(piece)
            at += size or most
    return [t for t in out if t not in stop and len(t) > 1]


def cut_titles(known: list[str] = (), stop: list[str] = ()) -> Callable[[Column], Column]:
    """The distinct terms of a title as an array."""
    known, stop = frozenset(known), frozenset(stop)

    @F.pandas_udf("array<string>")
    def cut(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for titles in batches:
            yield titles.map(lambda t: tokenize(t, known, stop))

    return lambda title: F.array_distinct(cut(title))


def title_terms(items: DataFrame, known: list[str] = (), stop: list[str] = (), top_n: int = 50, min_count: int = 2) -> DataFrame:
    """(term, count): titles that hold a term, each counted once; count falling, then term. Titles are counted before they are cut."""
    titles = items.groupBy("title").agg(F.count("*").alias("n"))
    terms = titles.select("n", F.explode(cut_titles(known, stop)(F.col("title"))).alias("term")).groupBy("term").agg(F.sum("n").cast("long").alias("count")).filter(F.col("count") >= min_count)
    return terms.orderBy(F.desc("count"), "term").limit(top_n) if top_n else terms


def sentence_counts(texts: DataFrame, column: str = "text") -> DataFrame:
    """(s, n) of the sentences of two signs or more: runs of letters and digits in lower case."""
    return texts.select(F.explode(F.split(F.lower(column), r"(?U)[^\p{L}\p{N}]+")).alias("s")).filter(F.length("s") >= 2).groupBy("s").agg(F.count("*").alias("n"))


def gram_counts(texts: DataFrame, column: str = "text", most: int = 4) -> DataFrame:
    """(gram, count) of all substrings of one to most signs inside sentences of two signs or more."""
    return _grams(sentence_counts(texts, column), most)


def _grams(sentences: DataFrame, most: int) -> DataFrame:
    grams = F.flatten(F.transform(F.sequence(F.lit(1), F.lit(most)), lambda k: F.when(F.length("s") >= k, F.transform(F.sequence(F.lit(1), F.length("s") - k + 1), lambda i: F.substring(F.col("s"), i, k))).otherwise(F.array().cast("array<string>"))))
    return sentences.select("n", F.explode(grams).alias("gram")).groupBy("gram").agg(F.sum("n").cast("long").alias("count"))


def solid_grams(texts: DataFrame, column: str = "text", most: int = 4, min_count: int = 4, min_solidity: float = 25.0) -> DataFrame:
    """(gram, count, solidity): grams of two to most signs that stick together: least over splits of p(gram) / (p(left) p(right))."""
    return _solid(gram_counts(texts, column, most), min_count).withColumn("solidity", F.round("solidity", 4)).filter(F.col("solidity") >= min_solidity)


def _solid(counts: DataFrame, min_count: int) -> DataFrame:
    total = counts.filter(F.length("gram") == 1).agg(F.sum("count").cast("double").alias("total"))
    cand = counts.filter((F.length("gram") >= 2) & (F.col("count") >= min_count))
    splits = cand.select("gram", "count", F.explode(F.sequence(F.lit(1), F.length("gram") - 1)).alias("k")).select("gram", "count", F.substring("gram", F.lit(1), F.col("k")).alias("l"), F.expr("substring(gram, k + 1)").alias("r"))
    left, right = (counts.select(F.col("gram").alias(s), F.col("count").alias(f"c{s}")) for s in ("l", "r"))
    ratio = splits.join(left, "l").join(right, "r").join(total).withColumn("solid", F.col("count") * F.col("total") / (F.col("cl") * F.col("cr")))
    return ratio.groupBy("gram", "count").agg(F.min("solid").alias("solidity"))


def edge_entropy(texts: DataFrame, grams: DataFrame, column: str = "text", most: int = 4) -> DataFrame:
    """(gram, entropy, top, sides): the lesser entropy of the signs before and after, the highest count of one neighbour, and sides with neighbours, inside sentences."""
    return _edges(sentence_counts(texts, column), grams, most)


def _edges(sentences: DataFrame, grams: DataFrame, most: int) -> DataFrame:
    places = sentences.select("s", "n", F.explode(F.sequence(F.lit(2), F.lit(most))).alias("k")).filter("length(s) >= k").select("s", "n", "k", F.explode(F.expr("sequence(1, length(s) - k + 1)")).alias("i"))
    seen = places.select(F.expr("substring(s, i, k)").alias("gram"), "n", F.expr("if(i > 1, substring(s, i - 1, 1), '')").alias("before"), F.expr("substring(s, i + k, 1)").alias("after"))
    some = seen.join(grams.select("gram"), "gram", "left_semi")
    sides = some.select("gram", "n", F.explode(F.array(F.struct(F.lit("b").alias("side"), F.col("before").alias("x")), F.struct(F.lit("a").alias("side"), F.col("after").alias("x")))).alias("e")).filter("e.x <> ''")
    per = sides.groupBy("gram", "e.side", "e.x").agg(F.sum("n").alias("c"))
    side = per.groupBy("gram", "side").agg(F.sum("c").alias("t"), F.sum(F.col("c") * F.log2("c")).alias("cl"), F.max("c").alias("top"))
    return side.groupBy("gram").agg(F.round(F.min(F.log2("t") - F.col("cl") / F.col("t")), 4).alias("entropy"), F.max("top").alias("top"), F.count("*").alias("sides"))


#: Function characters that bound words, and words that are never keywords, of Chinese and Japanese.
EDGE_CHARS = (
    "的了是在和与或就都而也很太更最又还却才把被让给从到对向为以之其这那上下里外前后内时我你他她它们个不只没能够会要可将已所再"
    "于但因如果然并且者及关通过地得着のにはをがもへやとで"
)
STOP_WORDS = frozenset(
    """
    一个 一种 一样 一起 一直 一些 什么 怎么 这样 那样 因为 所以 但是 如果 可以 已经 还是 只有 没有
    自己 他们 她们 我们 你们 男人 女人 时候 之后 之前 突然 开始 继续 无法 不能 感到 变得
    本作 本片 作品 影片 内容 相关 系列 收录 发行 出品 制作 主演 共演 出演 出演者 简介 剧情 介绍
    不知 为何 终于 紧接 接着 随后 一次 一条 那条 这条 来的 起来 一切 不知不觉 突如其来 逐渐
    完全 非常 特别 于是 结果 最后 这时 那时 此时 不住 不停 不断 反复 再次 总是 偶尔 有时 好像 似乎 仿佛 几乎 差点 彻底
    から まで です ます した して いる ある れる られる せる させる ない たい らしい そう よう こと もの ため ほど だけ しか さえ など ながら
    それ これ あれ どれ この その あの どの ここ そこ あそこ どこ 彼女
    """.split()
)
#: Fewest keywords before the fallback, which asks for solidity alone.
FEWEST = 12


def keywords(texts: DataFrame, column: str = "text", top_n: int = 60, min_count: int = 4, min_solidity: float = 25.0, min_entropy: float = 0.45, max_glue: float = 0.92, most: int = 4) -> list[dict]:
    """New words by solidity, entropy and glue, without function characters at their edges; of words inside one another the better stays.

    With fewer than FEWEST of them all solid grams are ranked instead, those with a fixed neighbour lower. Words are
    read in order of rank until top_n are found.
    """
    sentences = written(sentence_counts(texts, column), "sentences")
    counts = written(_grams(sentences, most), "grams")
    least = max(0.8 * min_solidity, 20.0)
    solid = written(_solid(counts, min_count).filter(F.col("solidity") >= min(least, min_solidity)), "solid")
    word = F.regexp_replace(F.regexp_replace("gram", f"^[{EDGE_CHARS}]+(?=.)", ""), f"(?<=.)[{EDGE_CHARS}]+$", "")
    named = solid.withColumnRenamed("count", "seen").withColumn("word", word).filter((F.length("word") >= 2) & ~F.col("word").isin(*STOP_WORDS))
    known = named.join(_edges(sentences, solid, most), "gram", "left").join(counts.withColumnRenamed("gram", "word"), "word")
    known = written(known.withColumn("glue", F.coalesce(F.col("top") / F.col("seen"), F.lit(0.0))), "keywords")

    def ranked(rows: DataFrame, score: Column, *then: Column) -> Iterator:
        return rows.withColumn("score", F.round(score, 4)).groupBy("word", "count").agg(F.max("score").alias("score")).orderBy(F.desc("score"), *then, "word").toLocalIterator()

    free = known.filter((F.col("solidity") >= min_solidity) & (F.col("sides") == 2) & (F.col("entropy") >= min_entropy) & (F.col("glue") <= max_glue))
    longer = F.length("word") - 2
    kept: list[dict] = []
    for r in ranked(free, F.col("count") * (1 + 0.5 * longer) * (1 + 0.6 * F.col("entropy")) * F.log1p("solidity"), F.desc("count")):
        if not any(r["word"] in k["word"] and r["count"] <= 1.6 * k["count"] for k in kept):
            kept.append(r.asDict())
        if len(kept) == top_n:
            break
    if len(kept) >= FEWEST:
        return kept
    penalty = F.when(F.col("glue") >= 0.9, 0.25).when(F.col("glue") >= 0.7, 0.7).otherwise(1.0)
    rest = known.filter((F.col("solidity") >= least) & (F.col("seen") >= 3))
    kept = []
    for r in ranked(rest, F.col("count") * (1 + 0.4 * longer) * F.log1p("solidity") * penalty, F.desc(F.length("word"))):
        if not any((r["word"] in k["word"] or k["word"] in r["word"]) and r["count"] <= 1.6 * k["count"] for k in kept):
            kept.append(r.asDict())
        if len(kept) == top_n:
            break
    return kept
