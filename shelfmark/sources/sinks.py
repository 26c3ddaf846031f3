"""Sinks: item details, CSV, JSON, Markdown, HTML. Reports are small; details are written by the cluster."""

from __future__ import annotations

import html
import json
from pathlib import Path

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def details(items: DataFrame, tags: DataFrame, people: DataFrame, sep: str = " / ") -> DataFrame:
    """Items with their tags and people as one string each, in order of name and of credit."""
    t = tags.distinct().groupBy("item_id").agg(F.array_join(F.sort_array(F.collect_list("tag")), sep).alias("tags"))
    p = people.groupBy("item_id", "person").agg(F.min("ord").alias("ord")).groupBy("item_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("ord", "person"))), lambda s: s["person"]), sep).alias("people"))
    return items.join(t, "item_id", "left").join(p, "item_id", "left").withColumns({c: F.coalesce(c, F.lit("")) for c in ("tags", "people")})


def shortened(column: str, n: int):
    """At most n signs and an ellipsis."""
    return F.when(F.length(column) > n, F.concat(F.substring(column, 1, n), F.lit("…"))).otherwise(F.col(column))


def write_csv(df: DataFrame, path: str) -> None:
    """CSV parts with a header, written by the cluster."""
    df.write.mode("overwrite").option("header", True).option("encoding", "UTF-8").csv(path)


def report_csv(rows: list[dict], path: str) -> None:
    """One small CSV file with a byte-order mark, for spreadsheets."""
    import csv

    with open(path, "w", encoding="utf-8-sig", newline="") as f:
        out = csv.DictWriter(f, fieldnames=list(rows[0]) if rows else [])
        out.writeheader()
        out.writerows(rows)


def report_json(data: dict, path: str) -> None:
    Path(path).write_text(json.dumps(data, ensure_ascii=False, indent=1, default=str), encoding="utf-8")


def for_script(data: dict) -> str:
    """JSON that can stand inside a script element."""
    return json.dumps(data, ensure_ascii=False, default=str).replace("<", "\\u003c").replace("\u2028", "\\u2028").replace("\u2029", "\\u2029")


def report_markdown(data: dict[str, list[dict]], path: str, title: str = "Library profile") -> None:
    lines = [f"# {title}", ""]
    for name, rows in data.items():
        if rows:
            columns = list(rows[0])
            lines += [f"## {name}", "", "| " + " | ".join(columns) + " |", "|" + "-|" * len(columns), *("| " + " | ".join(str(r[c]) for c in columns) + " |" for r in rows), ""]
    Path(path).write_text("\n".join(lines), encoding="utf-8")


def report_html(data: dict[str, list[dict]], path: str, title: str = "Library profile") -> None:
    """A page of tables with the data as JSON beside them."""
    body = []
    for name, rows in data.items():
        if rows:
            head = "".join(f"<th>{html.escape(c)}</th>" for c in rows[0])
            cells = "".join("<tr>" + "".join(f"<td>{html.escape(str(v))}</td>" for v in r.values()) + "</tr>" for r in rows)
            body.append(f"<h2>{html.escape(name)}</h2><table><tr>{head}</tr>{cells}</table>")
    Path(path).write_text(f"<!DOCTYPE html><html><head><meta charset='utf-8'><title>{html.escape(title)}</title></head><body><h1>{html.escape(title)}</h1>{''.join(body)}<script>const DATA = {for_script(data)};</script></body></html>", encoding="utf-8")


def export_all(data: dict[str, list[dict]], folder: str, formats: tuple[str, ...] = ("csv", "json", "md", "html", "xlsx")) -> list[str]:
    """A report in every format asked for: a CSV file and a sheet for each part, ranked. The paths written, without xlsx where no writer is installed."""
    Path(folder).mkdir(parents=True, exist_ok=True)
    out = []
    ranked = {name: [{"rank": k + 1, **r} for k, r in enumerate(rows)] for name, rows in data.items()}
    if "csv" in formats:
        for name, rows in ranked.items():
            out.append(f"{folder}/{name}.csv")
            report_csv(rows, out[-1])
    for kind, write in (("json", report_json), ("md", report_markdown), ("html", report_html)):
        if kind in formats:
            out.append(f"{folder}/report.{kind}")
            write(data, out[-1])
    if "xlsx" in formats and report_xlsx(ranked, f"{folder}/report.xlsx"):
        out.append(f"{folder}/report.xlsx")
    return out


def report_xlsx(data: dict[str, list[dict]], path: str, most: int = 50_000) -> str | None:
    """A workbook with a sheet for each part, its head frozen and filtered; None where openpyxl is not installed. A sheet has most rows."""
    try:
        import openpyxl
    except ImportError:
        return None
    book = openpyxl.Workbook()
    book.remove(book.active)
    for name, rows in data.items():
        sheet = book.create_sheet(name[:31])
        if rows:
            sheet.append(list(rows[0]))
            for r in rows[:most]:
                sheet.append([v if isinstance(v, (int, float, str, type(None))) else str(v) for v in r.values()])
            sheet.freeze_panes = "A2"
            sheet.auto_filter.ref = sheet.dimensions
    book.save(path)
    return path


def duplicate_report(summary: DataFrame, groups: DataFrame, members: DataFrame, folder: str, top: int = 1000) -> list[str]:
    """The duplicates as CSV, JSON and sheets: the summary and the top groups on the driver, the members written by the cluster."""
    found = groups.orderBy(F.desc("redundant"), F.desc("copies"), "label", "key").limit(top)
    data = {"summary": [r.asDict() for r in summary.collect()], "groups": [r.asDict() for r in found.filter("not multipart").collect()], "multipart": [r.asDict() for r in found.filter("multipart").collect()]}
    write_csv(members, f"{folder}/members")
    return [*export_all(data, folder, ("csv", "json", "xlsx")), f"{folder}/members"]


def index_text(items: DataFrame, tags: DataFrame, people: DataFrame) -> DataFrame:
    """(item_id, text) that a vector index is built from: title, tags and people."""
    rows = details(items.select("item_id", "title"), tags, people, " ")
    return rows.select("item_id", F.trim(F.regexp_replace(F.concat_ws(" ", "title", "tags", "people"), " +", " ")).alias("text"))


def item_cards(items: DataFrame, tags: DataFrame, people: DataFrame, limit: int = 1000) -> DataFrame:
    """The items of a report, best rated first, with long titles, tags and people shortened."""
    rows = details(items, tags, people).orderBy(F.desc("userrating"), "item_id").limit(limit)
    return rows.withColumns({"title": shortened("title", 46), "people": shortened("people", 40), "tags": shortened("tags", 46)})
