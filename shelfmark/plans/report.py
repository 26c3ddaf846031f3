"""The report bundle: every aggregate once, over cached inputs."""

from __future__ import annotations

from pyspark.sql import DataFrame

from shelfmark.operators import freq, graph
from shelfmark.operators.search import of_source


def report(items: DataFrame, tags: DataFrame, people: DataFrame, top: int = 20, source: str | None = None) -> dict[str, list[dict]]:
    """Rows of each part, of one source or all; all are aggregates of a fixed or limited number of rows."""
    items, children = of_source(items, {"tags": tags, "people": people}, source)
    tags, people = children["tags"], children["people"]
    cached = [df.persist() for df in (items, tags, people)]
    items, tags, people = cached
    try:
        parts = {
            "overview": freq.overview(items, tags, people),
            "tags": freq.frequency(tags, "tag", top),
            "people": freq.people_ranking(people, items, top),
            "studios": freq.frequency(items, "studio", top),
            "ratings": freq.by_rating(items),
            "runtimes": freq.by_runtime(items),
            "years": freq.by_year(items).orderBy("name"),
            "cast": freq.by_cast(items),
            "cooccurrence": graph.cooccurrence(tags, top_pairs=top),
            "pairs": graph.pairs_of_people(people, top),
            "portrait": freq.portrait(items, tags, people, ("2K", "4K", "8K", "1080P")),
        }
        return {name: [r.asDict() for r in df.collect()] for name, df in parts.items()}
    finally:
        for df in cached:
            df.unpersist()


def interpret(data: dict[str, list[dict]], tags: int = 12, people: int = 6, studios: int = 6) -> str:
    """A few sentences on a report, by rule."""
    one = data["overview"][0]
    names = lambda part, n: ", ".join(str(r.get("name") or r.get("person")) for r in data[part][:n])
    strong = sorted(data["portrait"], key=lambda r: (-r["value"], r["dimension"]))[:2]
    out = [f"{one['items']} items of {one['min_year']} to {one['max_year']}, {one['rated_percent']} % of them rated."]
    out += [f"{head}: {names(part, n)}." for part, n, head in (("tags", tags, "Tags"), ("people", people, "People"), ("studios", studios, "Studios")) if data[part]]
    return " ".join([*out, f"Strongest in {' and '.join(r['dimension'] for r in strong)}."])
