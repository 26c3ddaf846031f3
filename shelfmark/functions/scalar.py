"""Scalar functions as Column expressions. Missing values are '' and 0, as in the data model."""

from __future__ import annotations

from functools import reduce

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Signs that a variant key leaves out, resolution names by height, how resolutions are written in texts.
NOISE = r"""(?U)[\s·・･｡。，、,.!！?？:：;；'"“”‘’()（）\[\]【】〔〕/\\|~～\-—_+=*&^%$#@]"""
HEIGHTS = ((480, "480P"), (720, "720P"), (1080, "1080P"), (1440, "2K"), (2160, "4K"))
RESOLUTION_WORDS = (
    ("8K", r"(?U)(?:^|[^\w])(8K|4320[Pp])(?:[^\w]|$)"),
    ("4K", r"(?iU)(?:^|[^\w])(4K|2160P|UHD)(?:[^\w]|$)"),
    ("2K", r"(?iU)(?:^|[^\w])(2K|1440P)(?:[^\w]|$)"),
    ("1080P", r"(?iU)(?:^|[^\w])(1080P|FHD)(?:[^\w]|$)"),
    ("720P", r"(?iU)(?:^|[^\w])(720P|HD)(?:[^\w]|$)"),
    ("480P", r"(?iU)(?:^|[^\w])(480P|SD)(?:[^\w]|$)"),
)
#: Prefixes of tags that stand for a field, tags of technique, tags and words of the status flag.
TAG_FIELDS = (
    ("series", r"系\s*列"),
    ("studio", r"片商|制作商|制作|メーカー|maker"),
    ("publisher", r"发行|発売|发行商|publisher"),
    ("label", r"厂牌|レーベル|label"),
    ("director", r"导演|監督|director"),
    ("num", r"番号|品番|code|id"),
)
TECH_TAG = (
    r"(?i)^(?:AVC1|HEVC|H\.?264|H\.?265|XVID|DIVX|MPEG-?[24]|VP9|AV1|10BIT|8BIT|HDR|SDR|DV|DOLBY|\d{3,4}[PI]|\d+K|2K|4K|8K|UHD|FHD|HD|SD|BLURAY|Blu-?ray|WEB-?DL|WEBRIP|HDTV|DVDRIP|BDRIP|REMUX|CAM|TS|ISO"
    r"|AAC|AC3|DTS|MP3|FLAC|5\.1|7\.1|SUB|CHS|CHT|GB|BIG5|内嵌字幕|外挂字幕|无字幕|字幕|高清|超清|标清|高画质|高画質|60FPS|VR|3D)$"
)
STATUS_TAG = r"(?i)^(?:无码|無碼|无修正|無修正|有码|有碼|UNCENSORED|CENSORED|无码破解)$"
UNCENSORED = ("无码", "無碼", "无修正", "無修正", "UNCENSORED", "无码破解")
CENSORED = ("有码", "有碼", "CENSORED", "モザイク", "马赛克")
#: Words that make a name a placeholder.
PLACEHOLDERS = ("未知", "不明", "未定", "その他", "N/A", "n/a")
#: Signs at which a text is cut into segments (FN28).
PUNCTUATION = r"""(?U)[，。、；：！？,.!?;:()\[\]【】「」『』（）"'“”‘’…—\-~～/\\|\s]+"""
INVISIBLE = "[​-‏⁠﻿­]"


@F.pandas_udf(T.StringType())
def nfkc(text: pd.Series) -> pd.Series:
    """Unicode NFKC; Spark has no function of its own for it. Use it on distinct values."""
    return text.str.normalize("NFKC")


@F.pandas_udf(T.StringType())
def casefold(text: pd.Series) -> pd.Series:
    return text.str.casefold()


def clean_text(text: Column, unicode: bool = True) -> Column:
    """Without invisible signs, NFKC, white space as one space, trimmed; null is ''."""
    base = F.regexp_replace(F.coalesce(text, F.lit("")), INVISIBLE, "")
    return F.trim(F.regexp_replace(nfkc(base) if unicode else base, r"(?U)\s+", " "))


def variant_key(text: Column, unicode: bool = True, variants: dict[str, str] | None = None) -> Column:
    """Key under which spellings of one name meet: NFKC, variant signs mapped, noise dropped, case folded."""
    out = nfkc(text) if unicode else text
    if variants:
        out = F.translate(out, "".join(variants), "".join(variants.values()))
        out = nfkc(out) if unicode else out
    out = F.regexp_replace(out, NOISE, "")
    return casefold(out) if unicode else F.lower(out)


def pick(*columns: Column) -> Column:
    """The first that is not empty, else ''."""
    return F.coalesce(*[F.nullif(F.trim(c), F.lit("")) for c in columns], F.lit(""))


def first_int(text: Column, default: int = 0) -> Column:
    return F.coalesce(F.regexp_extract(F.regexp_replace(text, ",", ""), r"-?\d+", 0).try_cast("bigint"), F.lit(default).cast("bigint"))


def first_float(text: Column, default: float = 0.0) -> Column:
    return F.coalesce(F.regexp_extract(F.regexp_replace(text, ",", ""), r"-?\d+(?:\.\d+)?", 0).try_cast("double"), F.lit(default))


def norm_date(text: Column) -> Column:
    """YYYY-MM-DD from parts set apart by - / or .; '' if out of range (days up to 31 in any month)."""
    pattern = r"(\d{4})[-/.](\d{1,2})[-/.](\d{1,2})"
    y, m, d = (F.regexp_extract(text, pattern, k) for k in (1, 2, 3))
    good = y.try_cast("int").between(1900, 2100) & m.try_cast("int").between(1, 12) & d.try_cast("int").between(1, 31)
    return F.when(good, F.concat_ws("-", y, F.lpad(m, 2, "0"), F.lpad(d, 2, "0"))).otherwise("")


def norm_datetime(text: Column) -> Column:
    """YYYY-MM-DD HH:MM, else the date alone, else ''."""
    day = norm_date(text)
    h, m = (F.regexp_extract(text, r"\d{4}[-/.]\d{1,2}[-/.]\d{1,2}[T ](\d{1,2}):(\d{2})", k) for k in (1, 2))
    return F.when((day != "") & (h != ""), F.concat(day, F.lit(" "), F.lpad(h, 2, "0"), F.lit(":"), m)).otherwise(day)


def norm_year(text: Column) -> Column:
    return F.coalesce(F.regexp_extract(text, r"(19\d{2}|20\d{2})", 1).try_cast("int"), F.lit(0))


def resolution(height: Column, *texts: Column) -> Column:
    """Name by a positive height, else by the first text that tells one, else ''."""
    by_height = reduce(lambda w, x: w.when(height <= x[0], x[1]), HEIGHTS[1:], F.when(height <= HEIGHTS[0][0], HEIGHTS[0][1])).otherwise("8K")
    words = [reduce(lambda w, x, t=t: w.when(t.rlike(x[1]), x[0]), RESOLUTION_WORDS[1:], F.when(t.rlike(RESOLUTION_WORDS[0][1]), RESOLUTION_WORDS[0][0])) for t in texts]
    return F.when(height > 0, by_height).otherwise(F.coalesce(*words, F.lit("")))


def code_of(*texts: Column) -> Column:
    """Code of the first text that is one or holds one as a word: 1 to 8 letters, at most one - or _, 2 to 5 digits; upper case with '-'."""
    whole, part = r"^([A-Za-z]{1,8}[-_]?\d{2,5})$", r"(?U)\b([A-Za-z]{1,8}[-_]?\d{2,5})\b"
    found = [F.nullif(F.coalesce(F.nullif(F.regexp_extract(F.trim(t), whole, 1), F.lit("")), F.regexp_extract(t, part, 1)), F.lit("")) for t in texts]
    return F.coalesce(F.upper(F.regexp_replace(F.coalesce(*found), "_", "-")), F.lit(""))


def code_prefix(code: Column) -> Column:
    return F.regexp_extract(code, "^([A-Z]+)", 1)


def norm_code(code: Column) -> Column:
    """Identity of a code: lower case, letters and digits alone; '' unless letters then digits."""
    plain = F.regexp_replace(F.lower(code), "[^a-z0-9]", "")
    return F.when(plain.rlike(r"^[a-z]+\d+$"), plain).otherwise("")


def file_stem(path: Column) -> Column:
    """The file name of a path without its extension."""
    return F.regexp_replace(F.regexp_extract(path, r"([^/\\]*)$", 1), r"(?<=.)\.[^.]*$", "")


def code_in(text: Column) -> Column:
    """Identity of the code that a file name or title is, else holds: letters and 2 to 6 digits, no digit after."""
    low = F.lower(F.trim(F.coalesce(text, F.lit(""))))
    part = r"([a-z]{2,10})\s*[-_]?\s*(\d{2,6})(?!\d)"
    whole = norm_code(file_stem(low))
    return F.when(whole != "", whole).otherwise(F.concat(F.regexp_extract(low, part, 1), F.regexp_extract(low, part, 2)))


def identity_code(code: Column, *texts: Column) -> Column:
    """Identity of an item by its code, else by the first text with one. A code of two digits or fewer may be a prefix alone:
    the first longer one of the texts that begins with it then takes its place."""
    own = norm_code(F.coalesce(code, F.lit("")))
    others = [code_in(t) for t in texts]
    longer = [F.when(o.startswith(own) & (F.length(o) > F.length(own)), o) for o in others]
    first = F.coalesce(*[F.nullif(o, F.lit("")) for o in others], F.lit(""))
    return F.when(own == "", first).when(own.rlike(r"^[a-z]+\d{1,2}$"), F.coalesce(*longer, own)).otherwise(own)


def norm_title(title: Column) -> Column:
    """Identity of a title: lower case, a leading code dropped, ASCII letters, digits, ideographs and kana kept."""
    bare = F.regexp_replace(F.lower(F.trim(title)), r"^\s*[\[(【]?\s*[a-z]{1,8}\s*[-_]?\s*\d{2,6}\s*[\])】]?\s*[-:：\s]*", "")
    return F.regexp_replace(bare, "[^0-9a-z一-鿿぀-ヿ]+", "")


def title_key(title: Column, year: Column, clean_title: Column | None = None) -> Column:
    """title::year of the clean title, else of the title; '' without either. A year that hasn't four digits is left out."""
    name = norm_title(F.coalesce(title, F.lit("")))
    if clean_title is not None:
        name = F.coalesce(F.nullif(norm_title(clean_title), F.lit("")), name)
    # A name has no colon, so what begins with one has no name; written so, the name is made once.
    key = F.concat(name, F.lit("::"), F.when(year.between(1000, 9999), year.cast("string")).otherwise(""))
    return F.regexp_replace(key, "^::.*$", "")


def human_size(n: Column) -> Column:
    gb, mb = float(1 << 30), float(1 << 20)
    return F.when(n <= 0, "—").when(n >= gb, F.format_string("%.2f GB", n / gb)).when(n >= mb, F.format_string("%.1f MB", n / mb)).otherwise(F.format_string("%.0f KB", n / 1024.0))


def human_volume(n: Column) -> Column:
    """TB with two places from one TB on, else GB with one."""
    tb = float(1 << 40)
    return F.when(n >= tb, F.format_string("%.2f TB", n / tb)).otherwise(F.format_string("%.1f GB", F.coalesce(n, F.lit(0)) / float(1 << 30)))


def human_duration(seconds: Column) -> Column:
    """Hours and minutes, minutes alone under an hour, a dash without a length."""
    minutes = F.floor(seconds / 60).cast("long")
    return F.when(F.coalesce(seconds, F.lit(0)) <= 0, "—").when(minutes >= 60, F.format_string("%d小时%d分", F.floor(minutes / 60), minutes % 60)).otherwise(F.format_string("%d分", minutes))


def percent(part: Column, total: Column) -> Column:
    """Two places; 0 without a total."""
    return F.when(total > 0, F.round(part * 100.0 / total, 2)).otherwise(0.0)


def clamp(x: Column, low: float = 0.0, high: float = 100.0) -> Column:
    return F.least(F.greatest(x, F.lit(low)), F.lit(high))


def status_flag(text: Column, uncensored: tuple[str, ...] = UNCENSORED, censored: tuple[str, ...] = CENSORED) -> Column:
    """uncensored if the text holds such a word, else censored, else unknown."""
    blob = F.upper(text)
    any_of = lambda words: reduce(Column.__or__, [blob.contains(w.upper()) for w in words])
    return F.when(any_of(uncensored), "uncensored").when(any_of(censored), "censored").otherwise("unknown")


def classify_tag(tag: Column, prefix: Column, people: Column) -> Column:
    """(kind, value) of a tag, null if it says nothing: a field named before a colon, censor, tech, meta (the code's prefix or a person), else content.

    The tag is to be clean already (clean_text); names are compared by variant_key without Unicode forms.
    """
    tag = F.trim(tag)
    kinds, values = F.lit(None).cast("string"), F.lit(None).cast("string")
    for field, names in reversed(TAG_FIELDS):
        head = rf"(?i)^\s*(?:{names})\s*[:：]\s*"
        kinds = F.when(tag.rlike(head), F.lit(field)).otherwise(kinds)
        values = F.when(tag.rlike(head), F.trim(F.regexp_replace(tag, head, ""))).otherwise(values)
    key = variant_key(tag, unicode=False)
    mine = F.exists(people, lambda p: (p != "") & (variant_key(p, unicode=False) == key)) | ((prefix != "") & (key == variant_key(prefix, unicode=False)))
    kind = F.when(kinds.isNotNull(), kinds).when(tag.rlike(STATUS_TAG), "censor").when(tag.rlike(TECH_TAG), "tech").when(key == "", F.lit(None)).when(mine, "meta").otherwise("content")
    value = F.coalesce(values, tag)
    return F.when(kind.isNotNull() & (value != ""), F.struct(kind.alias("kind"), value.alias("value")))


def strip_people(title: Column, people: Column) -> Column:
    """title without the people's names in corner or square brackets, and without any such bracket that is left."""
    cut = lambda acc, p: F.when(p == "", acc).otherwise(F.replace(F.replace(acc, F.concat(F.lit("「"), p, F.lit("」")), F.lit(" ")), F.concat(F.lit("["), p, F.lit("]")), F.lit(" ")))
    bare = F.regexp_replace(F.aggregate(people, title, cut), r"[「」\[\]]", " ")
    return F.regexp_replace(F.regexp_replace(bare, r"(?U)\s{2,}", " "), r"^[ \-–—·、,，]+|[ \-–—·、,，]+$", "")


def distinct_folded(values: Column) -> Column:
    """An array's values in their order, each spelling of a lower-case form once: the first."""
    new = lambda acc, x: F.when(F.exists(acc, lambda y: F.lower(y) == F.lower(x)), acc).otherwise(F.concat(acc, F.array(x)))
    return F.aggregate(values, F.array().cast("array<string>"), new)


def is_placeholder(name: Column, stop_keys: list[str] = (), unicode: bool = True) -> Column:
    """Whether a person's name names nobody: empty, of a key that is empty or among stop_keys, or with a placeholder word."""
    key = variant_key(name, unicode)
    out = F.coalesce(key, F.lit("")) == ""
    if stop_keys:
        out = out | key.isin(list(stop_keys))
    return reduce(Column.__or__, [name.contains(w) for w in PLACEHOLDERS], out)


def segments(text: Column, cut: str = "") -> Column:
    """Pieces of two signs or more between punctuation and, if given, the signs in cut."""
    pieces = F.split(F.coalesce(text, F.lit("")), PUNCTUATION)
    if cut:
        signs = "".join("\\" + c if c in "\\[]^-" else c for c in cut)
        pieces = F.flatten(F.transform(pieces, lambda p: F.split(p, f"[{signs}]")))
    return F.filter(F.transform(pieces, lambda p: F.trim(p)), lambda p: F.length(p) >= 2)


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two arrays; a zero norm counts as 1; four places."""
    dot = F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)
    norm = lambda v: F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))
    one = lambda v: F.when(norm(v) == 0, 1.0).otherwise(norm(v))
    return F.round(dot / (one(a) * one(b)), 4)
