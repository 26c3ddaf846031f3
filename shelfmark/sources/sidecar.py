"""Sidecar files: listing, decoding, tolerant parsing, records."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shelfmark.functions.scalar import INVISIBLE, classify_tag, clean_text, code_of, code_prefix, distinct_folded, first_float, first_int, nfkc, norm_date, norm_datetime, norm_year, pick, resolution, status_flag, strip_people

#: Encodings in the order they are tried, folders that are passed over, elements that hold one value.
ENCODINGS = ("utf-8-sig", "utf-8", "gb18030", "shift_jis", "cp1252", "latin-1")
SKIP = r"(?i)/(\.git|node_modules|\$recycle\.bin|system volume information|__pycache__)/"
SCALARS = (
    "title originaltitle sorttitle year premiered release dateadded runtime userrating mpaa certification customrating plot outline tagline studio maker publisher label director num id javdbsearchid code series trailer languages website original_filename watched playcount source edition".split()
)
_STREAMS = "struct<video: struct<codec: array<string>, width: array<string>, height: array<string>, durationinseconds: array<string>>, audio: struct<codec: array<string>>>"
SCHEMA = ", ".join([f"{c} array<string>" for c in SCALARS]) + (
    ", genre array<string>, tag array<string>, set struct<name: array<string>>, actor array<struct<name: string, role: string, thumb: string, order: string>>, crew array<struct<name: string, role: string>>"
    f", ratings struct<rating: array<struct<value: string>>>, fileinfo struct<streamdetails: {_STREAMS}>, streamdetails {_STREAMS}, _corrupt_record string"
)
#: Separates the values of an array while all are normalised at once.
_MARK = "\x01"


def listing(spark: SparkSession, roots: list[str], pattern: str = "*.nfo", content: bool = True, max_files: int | None = None) -> DataFrame:
    """(path, mtime, size, source, content) of files under the roots, each once, of the longest root that holds it.

    A root leaves what lies under a longer one to that, so nothing is shuffled to tell files apart. Without
    content no file is opened. max_files keeps so many, by path.
    """
    roots, parts = sorted({r.rstrip("/") for r in roots}, key=lambda r: (-len(r), r)), []
    for at, root in enumerate(roots):
        files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(root).filter(~F.col("path").rlike(SKIP))
        for inner in roots[:at]:
            if inner.startswith(root + "/"):
                files = files.filter(~F.regexp_replace("path", "^[a-z]+:(?://)?(?=/)", "").startswith(inner.removeprefix("file:") + "/"))
        parts.append(files.select("path", F.date_format("modificationTime", "yyyy-MM-dd HH:mm:ss").alias("mtime"), F.col("length").alias("size"), F.lit(root).alias("source"), *(["content"] if content else [])))
    out = parts[0]
    for more in parts[1:]:
        out = out.unionByName(more)
    return out if max_files is None else out.orderBy("path").limit(max_files)


def with_video_size(records: DataFrame, videos: DataFrame) -> DataFrame:
    """records with video_exists and video_size of the file that original_filename names beside the sidecar. videos: (path, size)."""
    beside = F.concat(F.regexp_extract("path", r"^(.*/)[^/]*$", 1), F.col("original_filename"))
    sizes = videos.select(F.col("path").alias("_video"), F.col("size").alias("video_size")).dropDuplicates(["_video"])
    out = records.withColumn("_beside", F.when(F.col("original_filename") != "", beside)).join(sizes, F.col("_beside") == F.col("_video"), "left")
    return out.withColumn("video_exists", F.col("_video").isNotNull().cast("int")).withColumn("video_size", F.coalesce("video_size", F.lit(0)).cast("long")).drop("_beside", "_video")


@F.pandas_udf(T.StructType([T.StructField("text", T.StringType()), T.StructField("encoding", T.StringType())]))
def decoded(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
    """Bytes by the first encoding that reads them all."""

    def one(raw: bytes) -> tuple[str, str]:
        for name in ENCODINGS:
            try:
                return (raw or b"").decode(name), name
            except UnicodeDecodeError:
                continue
        return "", ""

    for raws in batches:
        yield pd.DataFrame([one(r) for r in raws], columns=["text", "encoding"])


def sanitised(text: Column) -> Column:
    """Without signs that XML forbids, bare ampersands escaped."""
    return F.regexp_replace(F.regexp_replace(text, r"[\x00-\x08\x0B\x0C\x0E-\x1F\x7F-\x9F￾￿]", ""), r"&(?!(?:[A-Za-z][A-Za-z0-9]*|#[0-9]+|#x[0-9A-Fa-f]+);)", "&amp;")


def first(field: str) -> Column:
    return F.coalesce(F.get(F.filter(F.col(field), lambda x: F.trim(x) != ""), F.lit(0)), F.lit(""))


def salvaged(text: Column, tag: str) -> Column:
    """The first element of a name, by pattern, without markup."""
    return F.trim(F.regexp_replace(F.regexp_extract(text, rf"(?is)<{tag}(?:\s[^>]*)?>(.*?)</{tag}>", 1), r"<[^>]+>", ""))


def salvaged_all(text: Column, tag: str) -> Column:
    return F.filter(F.transform(F.regexp_extract_all(text, F.lit(rf"(?is)<{tag}(?:\s[^>]*)?>(.*?)</{tag}>"), F.lit(1)), lambda x: F.trim(F.regexp_replace(x, r"<[^>]+>", ""))), lambda x: x != "")


def parsed(files: DataFrame, unicode: bool = True) -> DataFrame:
    """One record per file (path, content, …); parse_status ok, fragment, recovered or parse_error, never an exception.

    A file that is no XML is tried again from its <movie> element alone, then by patterns.
    """
    df = files.withColumn("d", decoded("content")).withColumn("text", sanitised(F.col("d.text"))).withColumn("encoding", F.col("d.encoding")).drop("d", "content")
    options = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt_record"}
    whole = F.regexp_replace(F.col("text"), r"(?s)^\s*<\?xml.*?\?>", "")
    df = df.withColumn("x1", F.from_xml(whole, SCHEMA, options)).withColumn("x2", F.from_xml(F.regexp_extract("text", r"(?is)(<movie\b.*</movie>)", 1), SCHEMA, options))
    good = lambda c: F.col(c).isNotNull() & F.col(f"{c}._corrupt_record").isNull() & (F.size(F.array_compact(F.array(*[F.col(f"{c}.{f}") for f in ("num", "title", "plot", "studio", "tag", "genre", "year")]))) > 0)
    df = df.withColumn("status", F.when(good("x1"), "ok").when(good("x2"), "fragment").when(F.col("text").rlike("(?i)<(title|num|plot)[ >]"), "recovered").otherwise("parse_error"))
    df = df.withColumn("x", F.when(F.col("status") == "ok", F.col("x1")).when(F.col("status") == "fragment", F.col("x2")))

    def value(name: str) -> Column:
        return F.when(F.col("x").isNotNull(), first(f"x.{name}")).when(F.col("status") == "recovered", salvaged(F.col("text"), name)).otherwise("")

    def values(name: str) -> Column:
        return F.when(F.col("x").isNotNull(), F.coalesce(F.col(f"x.{name}"), F.array().cast("array<string>"))).when(F.col("status") == "recovered", salvaged_all(F.col("text"), name)).otherwise(F.array().cast("array<string>"))

    clean = lambda c: clean_text(c, unicode)
    empty = F.array().cast("array<string>")

    def cleaned(values: Column) -> Column:
        """An array's values cleaned, without those that are empty."""
        flat = F.array_join(F.transform(values, lambda v: F.regexp_replace(F.coalesce(v, F.lit("")), _MARK, "")), _MARK)
        parts = F.split(nfkc(flat) if unicode else flat, _MARK)
        return F.filter(F.transform(parts, lambda v: F.trim(F.regexp_replace(F.regexp_replace(v, INVISIBLE, ""), r"(?U)\s+", " "))), lambda v: v != "")

    def salvaged_code() -> Column:
        return F.trim(F.regexp_replace(F.regexp_extract("text", r"(?is)<(num|id|javdbsearchid)>(.*?)</(?:num|id|javdbsearchid)>", 2), r"<[^>]+>", ""))

    actors = F.transform(F.coalesce("x.actor", F.array().cast("array<struct<name:string,role:string,thumb:string,order:string>>")), lambda a, i: F.struct(F.coalesce(first_int(a["order"], -1).cast("int"), F.lit(-1)).alias("order"), i.alias("at"), F.coalesce(a["name"], F.lit("")).alias("name")))
    credited = F.transform(F.array_sort(F.transform(actors, lambda a: F.struct(F.when(a["order"] < 0, a["at"]).otherwise(a["order"]).alias("o"), a["at"].alias("at"), a["name"].alias("n")))), lambda a: a["n"])
    salvaged_people = F.filter(F.transform(F.regexp_extract_all("text", F.lit("(?is)<actor>(.*?)</actor>"), F.lit(1)), lambda a: F.regexp_extract(a, "(?is)<name>(.*?)</name>", 1)), lambda n: n != "")
    has = F.col("x").isNotNull()
    df = df.withColumn("people", F.array_distinct(cleaned(F.when(has, credited).when(F.col("status") == "recovered", salvaged_people).otherwise(empty))))
    df = df.withColumn("t_title", clean(value("title"))).withColumn("t_set", F.when(has, first("x.set.name")).otherwise(F.regexp_extract("text", r"(?is)<set>\s*<name>(.*?)</name>", 1)))
    numbers = [F.when(has, value(n)).otherwise(salvaged_code() if n == "num" else F.lit("")) for n in ("num", "javdbsearchid", "id", "code")]
    df = df.withColumn("code", code_of(*[clean(n) for n in numbers], clean(value("original_filename")), F.col("t_title")))
    df = df.withColumn("raw_tags", distinct_folded(cleaned(F.concat(values("genre"), values("tag")))))
    df = df.withColumn("told", F.filter(F.transform("raw_tags", lambda t: classify_tag(t, code_prefix(F.col("code")), F.col("people"))), lambda k: k.isNotNull()))
    of_kind = lambda *kinds: F.transform(F.filter("told", lambda k: k["kind"].isin(*kinds)), lambda k: k["value"])
    tagged = lambda kind: F.coalesce(F.get(of_kind(kind), F.lit(0)), F.lit(""))
    crew = F.transform(F.filter(F.coalesce("x.crew", F.array().cast("array<struct<name:string,role:string>>")), lambda c: F.upper(F.coalesce(c["role"], F.lit(""))).rlike("DIRECTOR|导演")), lambda c: F.coalesce(c["name"], F.lit("")))
    stream = lambda path: F.when(F.col("x.fileinfo.streamdetails").isNotNull(), first(f"x.fileinfo.streamdetails.{path}")).when(has, first(f"x.streamdetails.{path}")).when(F.col("status") == "recovered", salvaged(F.col("text"), path.split(".")[-1])).otherwise("")
    height, seconds, runtime = (first_int(c).cast("int") for c in (stream("video.height"), stream("video.durationinseconds"), value("runtime")))
    df = df.withColumns({"premiered": pick(norm_date(value("premiered")), norm_date(value("release"))), "dateadded": norm_datetime(value("dateadded")), "tech_tags": of_kind("tech"), "height": height, "codec": clean(stream("video.codec"))})
    plot = pick(clean(value("plot")), clean(value("outline")))
    years = [norm_year(c) for c in (value("year"), F.col("premiered"), F.col("dateadded"))]
    out = df.select(
        "path",
        "encoding",
        *[c for c in ("source", "mtime", "size") if c in files.columns],
        F.col("status").alias("parse_status"),
        F.when(F.col("code") != "", F.col("code")).otherwise(code_of(tagged("num"))).alias("code"),
        F.col("t_title").alias("title"),
        strip_people(F.col("t_title"), F.col("people")).alias("clean_title"),
        pick(clean(value("originaltitle")), clean(value("sorttitle"))).alias("original_title"),
        plot.alias("plot"),
        pick(clean(value("series")), clean(F.col("t_set")), tagged("series")).alias("series"),
        pick(clean(value("studio")), clean(value("maker")), tagged("studio")).alias("studio"),
        pick(clean(value("publisher")), tagged("publisher")).alias("publisher"),
        pick(clean(value("label")), tagged("label")).alias("label"),
        F.array_distinct(F.filter(F.concat(F.array(clean(value("director"))), of_kind("director"), cleaned(crew)), lambda d: d != "")).alias("directors"),
        "premiered",
        pick(norm_date(value("release")), F.col("premiered")).alias("release"),
        "dateadded",
        F.coalesce(*[F.when(y > 0, y) for y in years], F.lit(0)).alias("year"),
        F.when((runtime > 0) & (runtime < 6000), runtime).when(seconds > 0, F.round(seconds / 60).cast("int")).otherwise(runtime).alias("runtime_min"),
        F.when(seconds > 0, seconds).otherwise(runtime * 60).alias("duration_sec"),
        first_float(value("userrating")).alias("userrating"),
        F.coalesce(F.array_max(F.transform("x.ratings.rating", lambda r: r["value"].try_cast("double"))), F.lit(0.0)).alias("rating_max"),
        pick(clean(value("mpaa")), clean(value("certification")), clean(value("customrating"))).alias("mpaa"),
        "height",
        first_int(stream("video.width")).cast("int").alias("width"),
        "codec",
        clean(F.when(has, F.coalesce(F.nullif(first("x.fileinfo.streamdetails.audio.codec"), F.lit("")), first("x.streamdetails.audio.codec"))).otherwise("")).alias("audio_codec"),
        resolution(F.col("height"), F.array_join("tech_tags", " / "), F.col("codec"), clean(value("source"))).alias("resolution"),
        status_flag(F.concat_ws(" ", F.array_join("raw_tags", " "), F.col("t_title"), plot)).alias("status_flag"),
        F.when(F.lower(F.trim(value("watched"))).isin("true", "1", "yes"), 1).otherwise(0).alias("watched"),
        first_int(value("playcount")).cast("int").alias("play_count"),
        clean(value("original_filename")).alias("original_filename"),
        "people",
        of_kind("content").alias("tags"),
        "tech_tags",
        of_kind("censor", "meta").alias("meta_tags"),
    )
    return out.withColumn("code_prefix", code_prefix(F.col("code")))


def paths_file(spark: SparkSession, path: str) -> DataFrame:
    """(value) paths listed in a text file, without comments and blank lines, each once."""
    return spark.read.text(path).select(F.trim("value").alias("value")).filter("value <> '' and value not like '#%'").distinct()


def children(records: DataFrame) -> dict[str, DataFrame]:
    """Child tables of the records: tags, technical tags, directors, and people with their order."""
    return {
        "tags": records.select("path", F.explode("tags").alias("tag")),
        "tech": records.select("path", F.explode("tech_tags").alias("tag")),
        "directors": records.select("path", F.explode("directors").alias("director")),
        "people": records.select("path", F.posexplode("people").alias("ord", "person")),
    }
