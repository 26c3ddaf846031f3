"""Search: facets, free text, keywords, vectors."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfmark.functions.scalar import cosine

#: Columns that results may be sorted by.
SORTABLE = ("item_id", "title", "studio", "year", "userrating", "runtime_min", "premiered", "source")


def escaped(text: str) -> str:
    return text.replace("\\", "\\\\").replace("%", "\\%").replace("_", "\\_")


def holds(column: str, text: str) -> Column:
    return F.col(column).ilike(f"%{escaped(text)}%")


def of_source(items: DataFrame, children: dict[str, DataFrame], source: str | None) -> tuple[DataFrame, dict[str, DataFrame]]:
    """items of one source and the rows of their children (item_id, …); all of them without a source. Every operator takes these frames as it takes the whole ones."""
    if source is None:
        return items, children
    some = items.filter(F.col("source") == source)
    return some, {name: df.join(some.select("item_id"), "item_id", "left_semi") for name, df in children.items()}


def keyword_ids(items: DataFrame, tags: DataFrame, people: DataFrame, text: str) -> DataFrame:
    """(item_id) of items with the text in title, code, a tag or a person."""
    parts = [items.filter(holds("title", text) | holds("code", text)), tags.filter(holds("tag", text)), people.filter(holds("person", text))]
    return reduce(DataFrame.unionByName, [p.select("item_id") for p in parts]).distinct()


def free_text(items: DataFrame, tags: DataFrame, people: DataFrame, terms: list[str]) -> DataFrame:
    """items that match any of the terms in code, title, studio, source, a tag or a person."""
    ids = reduce(DataFrame.unionByName, [keyword_ids(items, tags, people, t) for t in terms] + [items.filter(holds("studio", t) | holds("source", t)).select("item_id") for t in terms])
    return items.join(ids.distinct(), "item_id", "left_semi")


def facets(items: DataFrame, tags: DataFrame | None = None, *, text: str = "", equal: dict | None = None, year: tuple | None = None, rating: tuple | None = None, tag: str = "", sort: str = "item_id", descending: bool = False, offset: int = 0, limit: int | None = 50) -> DataFrame:
    """A page of items: every filter given holds; sorted by a column of SORTABLE, ties by item_id."""
    if sort not in SORTABLE:
        raise ValueError(f"cannot sort by {sort}")
    out = items
    for column, value in (equal or {}).items():
        out = out.filter(F.col(column) == value)
    for column, span in (("year", year), ("userrating", rating)):
        if span:
            out = out.filter(F.col(column).between(*span))
    if text:
        out = out.filter(reduce(Column.__or__, [holds(c, text) for c in ("code", "title", "studio", "source")]))
    if tag:
        out = out.join(tags.filter(F.col("tag") == tag).select("item_id"), "item_id", "left_semi")
    out = out.orderBy(F.desc(sort) if descending else F.asc(sort), "item_id")
    return out if limit is None else out.offset(offset).limit(limit)


def facet_values(items: DataFrame, column: str, limit: int = 300) -> DataFrame:
    return items.select(F.col(column).alias("value")).filter("value <> ''").distinct().orderBy("value").limit(limit)


def expand(terms: list[str], synonyms: dict[str, str]) -> list[str]:
    """The terms, those that share a canonical form with a synonym found in them, and the canonical forms."""
    out = dict.fromkeys(terms)
    for term in terms:
        for word, canonical in synonyms.items():
            if word in term or term == canonical:
                out |= dict.fromkeys([canonical, *(w for w, c in synonyms.items() if c == canonical)])
    return list(out)


def page(found: DataFrame, offset: int = 0, limit: int = 50, sort: str = "item_id") -> tuple[DataFrame, DataFrame]:
    """A page of what was found, in order, and (total) of all of it."""
    return found.orderBy(sort, "item_id").offset(offset).limit(limit), found.agg(F.count("*").alias("total"))


def words_in(query: str, vocabulary: DataFrame, column: str = "tag", limit: int = 50) -> DataFrame:
    """(word) of a vocabulary that stand in a query, ignoring case; the longest first."""
    words = vocabulary.select(F.col(column).alias("word")).filter("length(word) >= 2").distinct()
    return words.filter(F.lit(query.lower()).contains(F.lower("word"))).orderBy(F.desc(F.length("word")), "word").limit(limit)


def recent_ids(items: DataFrame, cutoff: str, limit: int, exclude: DataFrame | None = None) -> DataFrame:
    """(item_id) of items premiered or added since cutoff, newest first."""
    out = items.filter((F.col("premiered") >= cutoff) | (F.col("dateadded") >= cutoff))
    if exclude is not None:
        out = out.join(exclude.select("item_id"), "item_id", "left_anti")
    return out.orderBy(F.desc("dateadded"), "item_id").select("item_id").limit(limit)


def semantic(vectors: DataFrame, query: list[float], limit: int = 20, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(id, score): cosine with the query vector, highest first."""
    q = F.array(*[F.lit(float(x)) for x in query])
    return vectors.select(id_col, cosine(F.col(vector_col), q).alias("score")).orderBy(F.desc("score"), id_col).limit(limit)
