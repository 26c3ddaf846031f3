"""The library's registered queries over the driver's tables, each with its DuckDB SQL where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfmark import model as m
from shelfmark.functions import scalar as s
from shelfmark.operators import dedupe, freq, graph, maintain, recommend, search, text
from shelfmark.sources import sinks

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}

#: The model tables in SQL.
ITEMS = """items AS (
  SELECT o_orderkey AS item_id, 'ORD-' || lpad(CAST(o_orderkey AS VARCHAR), 9, '0') AS code,
    'ORD-' || lpad(CAST(o_orderkey AS VARCHAR), 9, '0') || ' ' || lower(c_mktsegment) || ' ' || lower(n_name) AS title,
    c_mktsegment AS studio, n_name AS source, strftime(o_orderdate, '%Y-%m-%d') AS premiered, strftime(o_orderdate, '%Y-%m-%d') || ' 00:00' AS dateadded,
    CAST(year(o_orderdate) AS INT) AS year, o_totalprice / 50000 AS userrating, o_orderpriority AS resolution, o_orderstatus AS status_flag,
    CAST(coalesce(l.q, 0) AS INT) AS runtime_min, coalesce(l.p, 0) AS n_people
  FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey
  LEFT JOIN (SELECT l_orderkey, CAST(sum(l_quantity) AS INT) AS q, count(DISTINCT l_suppkey) AS p FROM lineitem GROUP BY 1) l ON o_orderkey = l_orderkey)"""
TAGS = "item_tags AS (SELECT l_orderkey AS item_id, unnest([p_brand, p_type, p_name]) AS tag FROM lineitem JOIN part ON l_partkey = p_partkey)"
PEOPLE = "item_people AS (SELECT l_orderkey AS item_id, s_name AS person, l_linenumber AS ord FROM lineitem JOIN supplier ON l_suppkey = s_suppkey)"
VOTES = "votes AS (SELECT user_id AS item_id, arg_max(CASE WHEN event_type = 'purchase' THEN 1 ELSE -1 END, (ts, event_id)) AS vote, max(ts) AS voted_at FROM events WHERE event_type IN ('purchase', 'error') GROUP BY 1)"
PLAYS = "plays AS (SELECT user_id AS item_id, count(*) AS play_count, max(ts) AS played_at FROM events WHERE event_type = 'view' GROUP BY 1)"
TOKENS = "tokens AS (SELECT DISTINCT item_id, 'tag' AS kind, tag AS value FROM item_tags UNION SELECT item_id, 'person', person FROM item_people UNION SELECT item_id, 'studio', studio FROM items)"
KEY = r"""lower(regexp_replace({0}, '[\s,.!?:;''"()\[\]/\\|~\-_+=*&^%$#@]', '', 'g'))"""
TODAY = "2001-09-01"


def query(sql: str | None = None, *tables: str):
    """Register a query under its function's name, with SQL over the model tables named."""

    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            head = sql.strip()
            ctes = ", ".join(tables)
            ORACLE[f.__name__] = (f"WITH {ctes}, {head[5:]}" if head.upper().startswith("WITH ") else f"WITH {ctes} {head}") if tables else head
        return f

    return add


def frequency_sql(source: str, column: str, n: int) -> str:
    key = KEY.format("name")
    return f"""WITH forms AS (SELECT trim({column}) AS name, count(*) AS c FROM {source} WHERE trim({column}) <> '' GROUP BY 1),
    keyed AS (SELECT *, CASE WHEN {key} = '' THEN name ELSE {key} END AS key FROM forms),
    ranked AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY c DESC, length(name), name) AS r FROM keyed)
    SELECT key, max(CASE WHEN r = 1 THEN name END) AS name, CAST(sum(c) AS BIGINT) AS count, coalesce(string_agg(CASE WHEN r IN (2, 3) THEN name END, '|' ORDER BY r), '') AS aliases
    FROM ranked GROUP BY key ORDER BY count DESC, name LIMIT {n}"""


def filled_sql(names: list[str], counts: str) -> str:
    rows = ", ".join(f"({i}, '{x}')" for i, x in enumerate(names))
    return f"WITH dim(ord, name) AS (VALUES {rows}), counts AS ({counts}) SELECT CAST(d.ord AS INT) AS ord, d.name, CAST(coalesce(c.count, 0) AS BIGINT) AS count FROM dim d LEFT JOIN counts c USING (name)"


@query(frequency_sql("item_tags", "tag", 40), TAGS)
def top_tags(spark, d):
    # Lines are counted for each part before its tags are looked at.
    lines = m.table(spark, d, "lineitem").groupBy("l_partkey").agg(F.count("*").alias("n"))
    part = m.table(spark, d, "part").select("p_partkey", F.array("p_brand", "p_type", "p_name").alias("tags"))
    tags = lines.join(part, F.col("l_partkey") == F.col("p_partkey")).select(F.explode("tags").alias("tag"), "n")
    return freq.frequency(tags, "tag", 40, weight="n")


@query(frequency_sql("items", "studio", 20), ITEMS)
def top_studios(spark, d):
    return freq.frequency(m.items(spark, d), "studio", 20)


@query(frequency_sql("part", "p_name", 20))
def top_names(spark, d):
    return freq.frequency(m.table(spark, d, "part"), "p_name", 20)


@query(frequency_sql("(SELECT regexp_extract(p_brand, '^([A-Za-z]+)', 1) AS prefix FROM part)", "prefix", 20))
def top_prefixes(spark, d):
    return freq.frequency(m.table(spark, d, "part").select(F.regexp_extract("p_brand", "^([A-Za-z]+)", 1).alias("prefix")), "prefix", 20)


@query(
    """SELECT trim(person) AS person, count(*) AS count, count(CASE WHEN userrating > 0 THEN 1 END) AS rated, round(avg(CASE WHEN userrating > 0 THEN userrating END), 4) AS avg_rating,
    min(CASE WHEN year > 0 THEN year END) AS min_year, max(year) AS max_year FROM item_people JOIN items USING (item_id) GROUP BY 1 ORDER BY count DESC, person LIMIT 30""",
    ITEMS,
    PEOPLE,
)
def top_people(spark, d):
    return freq.people_ranking(m.item_people(spark, d), m.items(spark, d))


@query(
    """WITH n AS (SELECT person, tag, count(*) AS count FROM item_people JOIN item_tags USING (item_id) GROUP BY 1, 2),
    r AS (SELECT *, CAST(row_number() OVER (PARTITION BY person ORDER BY count DESC, tag) AS INT) AS rank FROM n) SELECT * FROM r WHERE rank <= 6""",
    TAGS,
    PEOPLE,
)
def person_tags(spark, d):
    return freq.top_per(m.item_people(spark, d).select("item_id", "person").join(m.item_tags(spark, d), "item_id"), "person", "tag", 6)


@query(
    """WITH n AS (SELECT a.person, b.person AS partner, count(*) AS count FROM item_people a JOIN item_people b ON a.item_id = b.item_id AND a.person <> b.person GROUP BY 1, 2),
    r AS (SELECT *, CAST(row_number() OVER (PARTITION BY person ORDER BY count DESC, partner) AS INT) AS rank FROM n) SELECT * FROM r WHERE rank <= 3""",
    PEOPLE,
)
def person_partners(spark, d):
    p = m.item_people(spark, d).select("item_id", "person")
    return freq.top_per(p.join(p.withColumnRenamed("person", "partner"), "item_id").filter("person <> partner"), "person", "partner", 3)


@query(
    f"""SELECT i.*, t.*, p.* FROM (SELECT count(*) AS items, count(CASE WHEN userrating > 0 THEN 1 END) AS rated, round(avg(CASE WHEN userrating > 0 THEN userrating END), 4) AS avg_rating, round(max(userrating), 4) AS max_rating,
    CAST(sum(runtime_min) AS BIGINT) AS runtime_total, round(avg(CASE WHEN runtime_min > 0 THEN runtime_min END), 4) AS avg_runtime, min(CASE WHEN year > 0 THEN year END) AS min_year, max(year) AS max_year,
    count(DISTINCT studio) AS studios, count(DISTINCT source) AS sources, round(count(CASE WHEN userrating > 0 THEN 1 END) * 100.0::DOUBLE / count(*), 2) AS rated_percent FROM items) i,
    (SELECT count(DISTINCT {KEY.format("tag")}) AS tags, count(*) AS tag_rows FROM item_tags) t, (SELECT count(DISTINCT {KEY.format("person")}) AS people FROM item_people) p""",
    ITEMS,
    TAGS,
    PEOPLE,
)
def overview(spark, d):
    return freq.overview(m.items(spark, d), m.item_tags(spark, d), m.item_people(spark, d))


@query(filled_sql([str(k) for k in range(11)], "SELECT CAST(CAST(least(greatest(floor(userrating), 0), 10) AS INT) AS VARCHAR) AS name, count(*) AS count FROM items WHERE userrating > 0 GROUP BY 1"), ITEMS)
def dist_rating(spark, d):
    return freq.by_rating(m.items(spark, d))


@query(
    filled_sql(
        ["<60", "60-89", "90-119", "120-149", "150-179", "180-239", "240+"],
        "SELECT CASE WHEN runtime_min < 60 THEN '<60' WHEN runtime_min < 90 THEN '60-89' WHEN runtime_min < 120 THEN '90-119' WHEN runtime_min < 150 THEN '120-149' WHEN runtime_min < 180 THEN '150-179' WHEN runtime_min < 240 THEN '180-239' ELSE '240+' END AS name, count(*) AS count FROM items WHERE runtime_min > 0 GROUP BY 1",
    ),
    ITEMS,
)
def dist_runtime(spark, d):
    return freq.by_runtime(m.items(spark, d))


@query("SELECT year AS name, count(*) AS count FROM items GROUP BY 1", ITEMS)
def dist_year(spark, d):
    return freq.by_year(m.items(spark, d))


@query("SELECT dateadded[1:7] AS name, count(*) AS count FROM items GROUP BY 1", ITEMS)
def dist_month(spark, d):
    return freq.by_month(m.items(spark, d))


@query(filled_sql([f"{h:02d}" for h in range(24)], "SELECT strftime(ts, '%H') AS name, count(*) AS count FROM events GROUP BY 1"))
def dist_hour(spark, d):
    return freq.by_hour(m.table(spark, d, "events"))


@query(filled_sql([str(k) for k in range(7)], "SELECT CAST(isodow(ts) - 1 AS VARCHAR) AS name, count(*) AS count FROM events GROUP BY 1"))
def dist_weekday(spark, d):
    return freq.by_weekday(m.table(spark, d, "events"))


@query("SELECT CASE WHEN n_people = 0 THEN '0' WHEN n_people = 1 THEN '1' WHEN n_people = 2 THEN '2' WHEN n_people <= 5 THEN '3-5' ELSE '6+' END AS name, count(*) AS count FROM items GROUP BY 1", ITEMS)
def dist_cast(spark, d):
    return freq.by_cast(m.items(spark, d))


PRIORITIES = ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW", "unknown"]


@query(filled_sql(PRIORITIES, "SELECT CASE WHEN resolution = '' THEN 'unknown' ELSE resolution END AS name, count(*) AS count FROM items GROUP BY 1"), ITEMS)
def dist_resolution(spark, d):
    return freq.by_resolution(m.items(spark, d), PRIORITIES)


@query("SELECT status_flag AS name, count(*) AS count FROM items GROUP BY 1", ITEMS)
def dist_status(spark, d):
    return freq.counted(m.items(spark, d), F.col("status_flag"))


@query("SELECT source, count(*) AS items FROM items GROUP BY 1", ITEMS)
def source_counts(spark, d):
    return maintain.source_counters(m.items(spark, d))


EDGES = f"""WITH keyed AS (SELECT item_id, {KEY.format("tag")} AS key FROM item_tags), top AS (SELECT key FROM keyed GROUP BY key ORDER BY count(*) DESC, key LIMIT 40),
    held AS (SELECT DISTINCT item_id, key FROM keyed WHERE key IN (SELECT key FROM top)), edges AS (SELECT a.key AS src, b.key AS dst, count(*) AS weight FROM held a JOIN held b ON a.item_id = b.item_id AND a.key < b.key GROUP BY 1, 2 ORDER BY weight DESC, src, dst LIMIT 200)"""


@query(EDGES + " SELECT * FROM edges", TAGS)
def tag_cooccurrence_edges(spark, d):
    return graph.cooccurrence(m.item_tags(spark, d))


@query(EDGES + " SELECT * FROM edges UNION ALL SELECT dst, src, weight FROM edges", TAGS)
def tag_cooccurrence_matrix(spark, d):
    return graph.matrix(graph.cooccurrence(m.item_tags(spark, d)))


@query("WITH p AS (SELECT DISTINCT item_id, person FROM item_people) SELECT a.person AS person1, b.person AS person2, count(*) AS count FROM p a JOIN p b ON a.item_id = b.item_id AND a.person < b.person GROUP BY 1, 2 ORDER BY count DESC, person1, person2 LIMIT 30", PEOPLE)
def costar_pairs(spark, d):
    return graph.pairs_of_people(m.item_people(spark, d))


@query(
    """WITH t AS (SELECT DISTINCT item_id, 'tag:' || tag AS token FROM item_tags UNION SELECT item_id, 'person:' || person FROM item_people), own AS (SELECT token FROM t WHERE item_id = 7),
    sh AS (SELECT item_id, count(*) AS shared FROM t WHERE item_id <> 7 AND token IN (SELECT token FROM own) GROUP BY 1 ORDER BY shared DESC, item_id LIMIT 200), n AS (SELECT item_id, count(*) AS n FROM t GROUP BY 1)
    SELECT item_id, shared, round(shared / (n + (SELECT count(*) FROM own) - shared), 3) AS score FROM sh JOIN n USING (item_id) ORDER BY score DESC, item_id LIMIT 10""",
    TAGS,
    PEOPLE,
)
def similar_items(spark, d):
    return graph.similar_items(m.item_tags(spark, d), m.item_people(spark, d), 7)


@query(
    """SELECT item_id, code, studio, source, year, round(userrating, 4) AS userrating FROM items WHERE studio = 'BUILDING' AND year BETWEEN 1996 AND 1999 AND userrating BETWEEN 3 AND 8
    AND (code ILIKE '%ORD%' OR title ILIKE '%ORD%') ORDER BY items.userrating DESC, item_id LIMIT 50""",
    ITEMS,
)
def facet_search(spark, d):
    found = search.facets(m.items(spark, d), text="ord", equal={"studio": "BUILDING"}, year=(1996, 1999), rating=(3, 8), sort="userrating", descending=True)
    return found.select("item_id", "code", "studio", "source", "year", F.round("userrating", 4).alias("userrating"))


@query("SELECT DISTINCT source AS value FROM items WHERE source <> '' ORDER BY 1 LIMIT 300", ITEMS)
def facet_values(spark, d):
    return search.facet_values(m.items(spark, d), "source")


@query("SELECT item_id FROM items WHERE title ILIKE '%brand#1%' OR code ILIKE '%brand#1%' UNION SELECT item_id FROM item_tags WHERE tag ILIKE '%brand#1%' UNION SELECT item_id FROM item_people WHERE person ILIKE '%brand#1%'", ITEMS, TAGS, PEOPLE)
def keyword_search(spark, d):
    return search.keyword_ids(m.items(spark, d), m.item_tags(spark, d), m.item_people(spark, d), "brand#1")


@query("SELECT item_id FROM items WHERE premiered >= '2001-07-01' OR dateadded >= '2001-07-01' ORDER BY dateadded DESC, item_id LIMIT 40", ITEMS)
def recent_items(spark, d):
    return search.recent_ids(m.items(spark, d), "2001-07-01", 40)


def library_documents(spark: SparkSession, d: str) -> DataFrame:
    return m.table(spark, d, "documents").select(F.concat_ws("/", "source", F.col("doc_id").cast("string")).alias("path"), F.lit("").alias("code"), F.coalesce("text", F.lit("")).alias("title"), F.lit(0).alias("year"), F.col("source").alias("folder"), F.col("n_chars").alias("size"))


TITLE = r"""keyed AS (SELECT source || '/' || CAST(doc_id AS VARCHAR) AS path, source AS folder, n_chars AS size,
    regexp_replace(regexp_replace(lower(trim(coalesce(text, ''), ' ')), '^[ \t\n\x0b\f\r]*[\[(【]?[ \t\n\x0b\f\r]*[a-z]{1,8}[ \t\n\x0b\f\r]*[-_]?[ \t\n\x0b\f\r]*[0-9]{2,6}[ \t\n\x0b\f\r]*[\])】]?[ \t\n\x0b\f\r]*[-:： \t\n\x0b\f\r]*', ''), '[^0-9a-z一-鿿぀-ヿ]', '', 'g') || '::' AS key, trim(coalesce(text, ''), ' ') AS title FROM documents),
    ident AS (SELECT * FROM keyed WHERE key <> '::'), folders AS (SELECT key, folder, count(*) AS n, sum(size) AS bytes, min(CASE WHEN size > 0 THEN size END) AS low, max(CASE WHEN size > 0 THEN size END) AS high FROM ident GROUP BY 1, 2),
    found AS (SELECT 'title' AS kind, key, CAST(sum(n) AS BIGINT) AS members, count(*) AS copies, CAST(greatest(sum(bytes) - max(bytes), 0) AS BIGINT) AS redundant,
    CASE WHEN min(low) = max(high) THEN 'very high' ELSE 'low' END AS confidence, count(*) = 1 AS multipart FROM folders GROUP BY key HAVING sum(n) > 1)"""


DUP = ("kind", "key", "members", "copies", "redundant", "confidence", "multipart")


@query("SELECT * FROM found", TITLE)
def dup_groups(spark, d):
    return dedupe.groups(dedupe.identified(library_documents(spark, d), use_code=False)).select(*DUP)


@query("SELECT path, folder, size, key FROM ident WHERE key IN (SELECT key FROM found)", TITLE)
def dup_members(spark, d):
    keyed = dedupe.identified(library_documents(spark, d), use_code=False)
    return dedupe.members(keyed, dedupe.groups(keyed)).select("path", "folder", "size", "key")


@query("SELECT count(*) FILTER (NOT multipart) AS groups, count(*) FILTER (multipart) AS multipart, CAST(coalesce(sum(members) FILTER (NOT multipart), 0) AS BIGINT) AS members, CAST(coalesce(sum(redundant) FILTER (NOT multipart), 0) AS BIGINT) AS redundant FROM found", TITLE)
def dup_summary(spark, d):
    return dedupe.summary(dedupe.groups(dedupe.identified(library_documents(spark, d), use_code=False)))


@query(
    r"SELECT p_partkey, "
    + KEY.format("p_name || ' ' || p_brand")
    + r""" AS variant_key, CASE WHEN p_size <= 12 THEN '480P' WHEN p_size <= 18 THEN '720P' WHEN p_size <= 27 THEN '1080P' WHEN p_size <= 36 THEN '2K' WHEN p_size <= 54 THEN '4K' ELSE '8K' END AS resolution,
    CASE WHEN p_partkey % 13 BETWEEN 1 AND 12 THEN '199' || CAST(p_partkey % 10 AS VARCHAR) || '-' || lpad(CAST(p_partkey % 13 AS VARCHAR), 2, '0') || '-' || lpad(CAST(p_size % 28 + 1 AS VARCHAR), 2, '0') ELSE '' END AS day,
    CAST(p_size AS BIGINT) AS number, upper(regexp_extract(p_brand, '([A-Za-z]+)', 1)) || '-' || lpad(CAST(p_size AS VARCHAR), 3, '0') AS code FROM part"""
)
def scalar_functions(spark, d):
    p = m.table(spark, d, "part")
    day = F.format_string("199%s/%s.%s", (F.col("p_partkey") % 10).cast("string"), (F.col("p_partkey") % 13).cast("string"), (F.col("p_size") % 28 + 1).cast("string"))
    code = F.concat(F.regexp_extract("p_brand", "([A-Za-z]+)", 1), F.lit("_"), F.lpad(F.col("p_size").cast("string"), 3, "0"))
    return p.select(
        "p_partkey",
        s.variant_key(F.concat_ws(" ", "p_name", "p_brand"), unicode=False).alias("variant_key"),
        s.resolution(F.col("p_size") * 40).alias("resolution"),
        s.norm_date(day).alias("day"),
        s.first_int(F.concat(F.lit("size "), F.col("p_size").cast("string"), F.lit(" cm"))).alias("number"),
        s.code_of(F.lit("none"), F.concat(F.lit("see "), code, F.lit(" here"))).alias("code"),
    )


@query("WITH t AS (SELECT DISTINCT p_partkey, unnest(regexp_extract_all(p_name, '[A-Za-z0-9]{2,}')) AS term FROM part) SELECT term, count(*) AS count FROM t GROUP BY 1 HAVING count(*) >= 2 ORDER BY count DESC, term LIMIT 50")
def title_terms(spark, d):
    return text.title_terms(m.table(spark, d, "part").select(F.col("p_name").alias("title")))


def names(spark: SparkSession, d: str) -> DataFrame:
    return m.table(spark, d, "part").select(F.col("p_name").alias("text"))


@query(
    """WITH w AS (SELECT s, count(*) AS n FROM (SELECT unnest(regexp_extract_all(lower(p_name), '[a-z0-9]+')) AS s FROM part) WHERE length(s) >= 2 GROUP BY s),
    g AS (SELECT substr(s, i, k) AS gram, CAST(sum(n) AS BIGINT) AS count FROM (SELECT s, n, k, unnest(range(1, length(s) - k + 2)) AS i FROM w, (VALUES (1), (2), (3), (4)) AS t(k) WHERE length(s) >= k) GROUP BY 1),
    tot AS (SELECT CAST(sum(count) AS DOUBLE) AS total FROM g WHERE length(gram) = 1), c AS (SELECT gram, count, unnest(range(1, length(gram))) AS k FROM g WHERE length(gram) >= 2 AND count >= 4)
    SELECT c.gram, c.count, round(min(c.count * total / (l.count * r.count)), 4) AS solidity FROM c JOIN g l ON l.gram = substr(c.gram, 1, k) JOIN g r ON r.gram = substr(c.gram, k + 1), tot GROUP BY 1, 2 HAVING round(min(c.count * total / (l.count * r.count)), 4) >= 5"""
)
def solid_grams(spark, d):
    return text.solid_grams(names(spark, d), min_solidity=5.0)


@query()
def plot_keywords(spark, d):
    docs = m.table(spark, d, "documents")
    found = text.keywords(docs, min_count=max(4, docs.count() // 400 + 2))
    return spark.createDataFrame([(k["word"], k["count"], k["score"]) for k in found], "word string, count long, score double")


@query("SELECT kind, value, count(*) AS df FROM tokens GROUP BY 1, 2", ITEMS, TAGS, PEOPLE, TOKENS)
def token_df(spark, d):
    return recommend.document_frequency(tokens(spark, d))


def tokens(spark: SparkSession, d: str) -> DataFrame:
    return recommend.tokens(m.items(spark, d), m.item_tags(spark, d), m.item_people(spark, d))


PROFILE = """df AS (SELECT kind, value, count(*) AS df FROM tokens GROUP BY 1, 2), n AS (SELECT CAST(count(*) AS DOUBLE) AS n FROM orders), raw AS (
    SELECT kind, value, sum(CASE WHEN vote > 0 THEN w ELSE 0 END) AS pos, sum(CASE WHEN vote < 0 THEN w ELSE 0 END) AS neg FROM (SELECT *, CASE WHEN kind = 'studio' THEN 1.0::DOUBLE ELSE 2.0::DOUBLE END AS w FROM tokens JOIN votes USING (item_id)) GROUP BY 1, 2),
    fac AS (SELECT raw.*, least(greatest(ln(n / df) / CASE WHEN n > greatest(50.0::DOUBLE, n * 0.001::DOUBLE) THEN ln(n / greatest(50.0::DOUBLE, n * 0.001::DOUBLE)) ELSE 1 END, 0.05::DOUBLE), 1.0::DOUBLE) AS f FROM raw JOIN df USING (kind, value), n),
    profile AS (SELECT kind, value, round(pos * f, 6) AS pos, round(neg * f, 6) AS neg FROM fac)"""


def preference(spark: SparkSession, d: str) -> DataFrame:
    return recommend.profile(tokens(spark, d), m.votes(spark, d), m.table(spark, d, "orders").count())


@query("SELECT * FROM profile", ITEMS, TAGS, PEOPLE, TOKENS, VOTES, PROFILE)
def preference_profile(spark, d):
    return preference(spark, d)


@query("SELECT item_id, CAST(round(sum(CAST(pos - neg AS DECIMAL(20, 6))), 4) AS DOUBLE) AS score FROM tokens JOIN profile USING (kind, value) GROUP BY 1", ITEMS, TAGS, PEOPLE, TOKENS, VOTES, PROFILE)
def base_score(spark, d):
    return recommend.base_scores(tokens(spark, d), preference(spark, d))


@query(f"SELECT item_id, CASE WHEN date_diff('day', CAST(premiered AS DATE), DATE '{TODAY}') BETWEEN 0 AND 180 THEN round(2.0::DOUBLE * 0.7::DOUBLE * (0.45::DOUBLE + 0.55::DOUBLE * (1 - date_diff('day', CAST(premiered AS DATE), DATE '{TODAY}') / 180)), 6) ELSE 0 END AS boost FROM items", ITEMS)
def recency_boost(spark, d):
    return m.items(spark, d).select("item_id", recommend.recency_boost(F.col("premiered"), F.col("dateadded"), TODAY, 2.0).alias("boost"))


@query("SELECT item_id, CASE WHEN vote IS NULL AND play_count > 3 THEN round(-least(1.2::DOUBLE, 0.12::DOUBLE * (play_count - 3)) * 2.0::DOUBLE, 6) ELSE 0 END AS penalty FROM plays LEFT JOIN votes USING (item_id)", VOTES, PLAYS)
def browse_penalty(spark, d):
    return m.plays(spark, d).join(m.votes(spark, d).select("item_id", "vote"), "item_id", "left").select("item_id", recommend.browse_penalty(F.col("play_count"), F.col("vote"), 2.0).alias("penalty"))


@query()
def smart_picks(spark, d):
    return recommend.smart_picks(m.items(spark, d), tokens(spark, d), preference(spark, d), m.votes(spark, d), m.plays(spark, d), m.item_people(spark, d), today=TODAY)


@query("SELECT v.item_id, v.vote, v.voted_at, i.code, i.title, i.studio, coalesce(p.play_count, 0) AS play_count FROM votes v LEFT JOIN items i USING (item_id) LEFT JOIN plays p USING (item_id)", ITEMS, VOTES, PLAYS)
def vote_records(spark, d):
    return recommend.vote_records(m.votes(spark, d), m.items(spark, d), m.plays(spark, d))


@query("SELECT p.item_id, p.play_count, p.played_at, i.code, i.title, i.studio, coalesce(v.vote, 0) AS vote FROM plays p LEFT JOIN items i USING (item_id) LEFT JOIN votes v USING (item_id)", ITEMS, VOTES, PLAYS)
def play_records(spark, d):
    return recommend.play_records(m.plays(spark, d), m.items(spark, d), m.votes(spark, d))


@query(
    """WITH t AS (SELECT DISTINCT item_id, tag FROM item_tags), n AS (SELECT count(DISTINCT item_id) AS n FROM t), f AS (SELECT tag, count(*) AS f FROM t GROUP BY 1),
    seeds AS (SELECT tag, f FROM f, n WHERE f <= 0.55::DOUBLE * n AND NOT regexp_matches(tag, '^[0-9]+$') ORDER BY f DESC, tag LIMIT 80), h AS (SELECT * FROM t JOIN seeds USING (tag))
    SELECT a.tag AS a, b.tag AS b, a.f AS fa, b.f AS fb, count(*) AS co, round(count(*) / (a.f + b.f - count(*)), 6) AS strength FROM h a JOIN h b ON a.item_id = b.item_id AND a.tag < b.tag GROUP BY 1, 2, 3, 4 HAVING count(*) >= 3""",
    TAGS,
)
def theme_pairs(spark, d):
    return graph.theme_pairs(m.item_tags(spark, d))


@query()
def theme_clusters(spark, d):
    return graph.theme_clusters(m.items(spark, d), m.item_tags(spark, d))


@query(
    """WITH q AS (SELECT embedding AS q FROM embeddings WHERE vec_id = 0) SELECT vec_id, round(list_sum(list_transform(range(1, len(embedding) + 1), lambda i: embedding[i]::DOUBLE * q[i]::DOUBLE)) /
    (sqrt(list_sum(list_transform(embedding, lambda x: x::DOUBLE * x::DOUBLE))) * sqrt(list_sum(list_transform(q, lambda x: x::DOUBLE * x::DOUBLE)))), 4) AS score FROM embeddings, q ORDER BY score DESC, vec_id LIMIT 20"""
)
def semantic_search(spark, d):
    v = m.table(spark, d, "embeddings")
    return search.semantic(v, v.filter("vec_id = 0").select("embedding").first()[0])


SNAPSHOT = "old AS (SELECT item_id AS path, premiered AS mtime, CAST(runtime_min AS BIGINT) AS size FROM items WHERE item_id % 7 <> 0), cur AS (SELECT item_id AS path, premiered AS mtime, CAST(runtime_min + CASE WHEN item_id % 11 = 0 THEN 1 ELSE 0 END AS BIGINT) AS size FROM items WHERE item_id % 5 <> 0)"


def snapshots(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    i = m.items(spark, d).select(F.col("item_id").alias("path"), F.col("premiered").alias("mtime"), F.col("runtime_min").cast("long").alias("size"))
    return i.filter("path % 7 <> 0"), i.filter("path % 5 <> 0").withColumn("size", F.col("size") + F.when(F.col("path") % 11 == 0, 1).otherwise(0))


@query("SELECT * FROM cur WHERE (path, mtime, size) NOT IN (SELECT (path, mtime, size) FROM old)", ITEMS, SNAPSHOT)
def incremental_diff(spark, d):
    old, now = snapshots(spark, d)
    return maintain.changed(now, old)


@query("SELECT path FROM old WHERE path NOT IN (SELECT path FROM cur)", ITEMS, SNAPSHOT)
def prune_plan(spark, d):
    old, now = snapshots(spark, d)
    return maintain.prune_plan(old, now)


@query("SELECT path, mtime, size FROM cur UNION ALL SELECT path, mtime, size FROM old WHERE path NOT IN (SELECT path FROM cur)", ITEMS, SNAPSHOT)
def upserted(spark, d):
    old, now = snapshots(spark, d)
    return maintain.upsert(old, now, "path")[0]


@query(
    """WITH t AS (SELECT item_id, string_agg(tag, ' / ' ORDER BY tag) AS tags FROM (SELECT DISTINCT item_id, tag FROM item_tags) GROUP BY 1), p AS (SELECT item_id, string_agg(person, ' / ' ORDER BY ord, person) AS people FROM (SELECT item_id, person, min(ord) AS ord FROM item_people GROUP BY 1, 2) GROUP BY 1)
    SELECT item_id, code, coalesce(tags, '') AS tags, coalesce(people, '') AS people FROM items LEFT JOIN t USING (item_id) LEFT JOIN p USING (item_id)""",
    ITEMS,
    TAGS,
    PEOPLE,
)
def item_detail(spark, d):
    return sinks.details(m.items(spark, d).select("item_id", "code"), m.item_tags(spark, d), m.item_people(spark, d))


def _share(x: str) -> str:
    return f"round({x} * 100.0::DOUBLE / n, 2)"


@query(
    f"""WITH b AS (SELECT count(*) AS n, count(*) FILTER (resolution IN ('1-URGENT', '2-HIGH')) AS hd, count(*) FILTER (runtime_min >= 120) AS lg, count(*) FILTER (userrating > 0) AS rated, count(*) FILTER (year >= (SELECT max(year) FROM items) - 1) AS recent FROM items),
    x AS (SELECT (SELECT sum(c) FROM (SELECT count(*) AS c FROM item_people GROUP BY person ORDER BY c DESC LIMIT 10)) AS p10, (SELECT sum(c) FROM (SELECT count(*) AS c FROM items GROUP BY studio ORDER BY c DESC LIMIT 3)) AS s3,
    (SELECT sum(c) FROM (SELECT count(*) AS c FROM items GROUP BY source ORDER BY c DESC LIMIT 6)) AS r6, (SELECT count(DISTINCT {KEY.format("tag")}) FROM item_tags) AS breadth),
    v AS (SELECT unnest([('tag breadth', breadth / 300 * 100), ('people focus', {_share("p10")}), ('studio loyalty', {_share("s3")}), ('high definition', {_share("hd")}), ('long items', {_share("lg")}), ('rating activity', {_share("rated")}), ('series', {_share("r6")} * 2), ('recency', {_share("recent")} * 2)]) AS r FROM b, x)
    SELECT r[1] AS dimension, round(least(greatest(CAST(r[2] AS DOUBLE), 0), 100), 2) AS value FROM v""",
    ITEMS,
    TAGS,
    PEOPLE,
)
def portrait(spark, d):
    return freq.portrait(m.items(spark, d), m.item_tags(spark, d), m.item_people(spark, d), ("1-URGENT", "2-HIGH"))


def values(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    return spark.createDataFrame(rows, schema)


def values_sql(rows: list[tuple], names: str) -> str:
    cell = lambda x: "NULL" if x is None else str(x) if isinstance(x, (int, float)) else "'" + x.replace("'", "''") + "'"
    return f"v({names}) AS (VALUES " + ", ".join("(" + ", ".join(map(cell, r)) + ")" for r in rows) + ")"


#: Raw tags with a code's prefix and a person beside them.
TAGGED = [(i, t, "ABP", "Jo-Doe") for i, t in enumerate(["系列: Long Run", "系 列：x", "片商: Acme", "maker: Acme", "发行:Pub", "publisher: P", "レーベル: L", "label: L", "监督", "監督: Ann", "director: Ann", "番号: AB-12", "code: AB-12", "ID: 7", "id:", "UNCENSORED", "有码", "无码破解", "H.265", "h264", "1080p", "4k", "BluRay", "Blu-ray", "WEB-DL", "5.1", "60FPS", "HDR", "HDRX", "高清", "字幕", "abp", "A B P", "jo doe", "JODOE", "Jo", "drama", "a/b", "...", "series: x", "  spaced  "])]
PREFIXED = (("series", "系\\s*列"), ("studio", "片商|制作商|制作|メーカー|maker"), ("publisher", "发行|発売|发行商|publisher"), ("label", "厂牌|レーベル|label"), ("director", "导演|監督|director"), ("num", "番号|品番|code|id"))
_HEADS = "CASE " + " ".join(f"WHEN regexp_matches(tag, '(?i)^\\s*(?:{p})\\s*[:：]') THEN '{k}'" for k, p in PREFIXED) + " END"
_RESTS = "CASE " + " ".join(f"WHEN regexp_matches(tag, '(?i)^\\s*(?:{p})\\s*[:：]') THEN trim(regexp_replace(tag, '(?i)^\\s*(?:{p})\\s*[:：]\\s*', ''))" for k, p in PREFIXED) + " ELSE tag END"
_TECH = "^(AVC1|HEVC|H[.]?264|H[.]?265|XVID|DIVX|MPEG-?[24]|VP9|AV1|10BIT|8BIT|HDR|SDR|DV|DOLBY|[0-9]{3,4}[PI]|[0-9]+K|UHD|FHD|HD|SD|BLU-?RAY|WEB-?DL|WEBRIP|HDTV|DVDRIP|BDRIP|REMUX|CAM|TS|ISO|AAC|AC3|DTS|MP3|FLAC|5[.]1|7[.]1|SUB|CHS|CHT|GB|BIG5|内嵌字幕|外挂字幕|无字幕|字幕|高清|超清|标清|高画质|高画質|60FPS|VR|3D)$"


@query(
    f"""WITH {values_sql(TAGGED, "id, raw, prefix, person")}, t AS (SELECT id, trim(raw) AS tag, {KEY.format("trim(raw)")} AS k, {KEY.format("prefix")} AS kp, {KEY.format("person")} AS kn FROM v),
    c AS (SELECT id, CASE WHEN {_HEADS} IS NOT NULL THEN {_HEADS} WHEN regexp_matches(upper(tag), '^(无码|無碼|无修正|無修正|有码|有碼|UNCENSORED|CENSORED|无码破解)$') THEN 'censor' WHEN regexp_matches(upper(tag), '{_TECH}') THEN 'tech'
    WHEN k = '' THEN NULL WHEN k IN (kp, kn) THEN 'meta' ELSE 'content' END AS kind, {_RESTS} AS value FROM t) SELECT * FROM c WHERE kind IS NOT NULL AND value <> ''"""
)
def classify_tag(spark, d):
    told = values(spark, TAGGED, "id int, raw string, prefix string, person string").select("id", s.classify_tag(F.col("raw"), F.col("prefix"), F.array("person")).alias("k"))
    return told.filter("k is not null").select("id", "k.kind", "k.value")


CODED = [(i, t) for i, t in enumerate(["ABP123", "abp-123", "ABP_00123", "see ABP123 there", "x A-12 y", "a1", "A-1", "ABCDEFGHI-12", "x-ABCDEFGH12345", "no code", "", "AB-123456", "ab 12", "12-AB-34", "pre AB_77.mp4", "AB-12 CD-34"])]


@query(
    f"""WITH {values_sql(CODED, "id, t")}, c AS (SELECT id, upper(replace(CASE WHEN regexp_matches(trim(t), '^[A-Za-z]{{1,8}}[-_]?[0-9]{{2,5}}$') THEN trim(t) ELSE regexp_extract(t, '\\b([A-Za-z]{{1,8}}[-_]?[0-9]{{2,5}})\\b', 1) END, '_', '-')) AS code FROM v)
    SELECT id, code, regexp_extract(code, '^([A-Z]+)', 1) AS prefix FROM c"""
)
def extract_code(spark, d):
    out = values(spark, CODED, "id int, t string").select("id", s.code_of(F.col("t")).alias("code"))
    return out.withColumn("prefix", s.code_prefix(F.col("code")))


KEYED = [(i, t) for i, t in enumerate(["A-b_c", "a b\tc", "[A]/(b)", "a=b%c", "x^y$z", "a<b>", "A&B #1 @2", "it's \"so\"", "a|b~c", "a,b.c!d?e:f;g", "", "+*\\", "a、b", "「a」"])]


@query(f"WITH {values_sql(KEYED, 'id, t')} SELECT id, " + KEY.format("t").replace("^%$#@]", "^%$#@、]") + " AS key FROM v")
def variant_key(spark, d):
    return values(spark, KEYED, "id int, t string").select("id", s.variant_key(F.col("t"), unicode=False).alias("key"))


SEEN = [(i, h, t) for i, (h, t) in enumerate([(0, "x 8K y"), (0, "x 8k y"), (0, "4k"), (0, "UHD!"), (0, "2160P"), (0, "1440p"), (0, "FHD"), (0, "HD"), (0, "hd rip"), (0, "SD 480p"), (0, "HDR"), (0, "(720P)"), (0, ""), (480, "4K"), (481, ""), (1080, ""), (1081, ""), (2160, ""), (4000, ""), (0, "x1080p"), (0, "1080p 4K")])]
_WORDS = (("8K", "8K|4320[Pp]", ""), ("4K", "4K|2160P|UHD", "(?i)"), ("2K", "2K|1440P", "(?i)"), ("1080P", "1080P|FHD", "(?i)"), ("720P", "720P|HD", "(?i)"), ("480P", "480P|SD", "(?i)"))


@query(
    f"WITH {values_sql(SEEN, 'id, height, t')} SELECT id, CASE WHEN height > 0 THEN CASE WHEN height <= 480 THEN '480P' WHEN height <= 720 THEN '720P' WHEN height <= 1080 THEN '1080P' WHEN height <= 1440 THEN '2K' WHEN height <= 2160 THEN '4K' ELSE '8K' END "
    + " ".join(f"WHEN regexp_matches(t, '{flag}(^|[^0-9A-Za-z_])({w})([^0-9A-Za-z_]|$)') THEN '{name}'" for name, w, flag in _WORDS)
    + " ELSE '' END AS resolution FROM v"
)
def detect_resolution(spark, d):
    return values(spark, SEEN, "id int, height int, t string").select("id", s.resolution(F.col("height"), F.col("t")).alias("resolution"))


#: Items that may be one: path, code, file name, title, year, folder, size.
TWINS = [
    ("a/1", "T38", "T38-002.mp4", "first", 2001, "a", 10), ("b/1", "T38", "T38-003.mp4", "second", 2001, "b", 20), ("c/1", "t38-002", "", "third", 2001, "c", 30),
    ("a/2", "AB-123", "", "x", 2000, "a", 5), ("b/2", "", "AB 123.mkv", "y", 2000, "b", 5), ("a/3", "", "", "CD-45 Same Name", 1999, "a", 7), ("b/3", "", "", "Same Name", 1999, "b", 9),
    ("a/4", "", "", "Only Title", 0, "a", 1), ("b/4", "", "", "[zz-12] only title", 0, "b", 3), ("c/5", "", "", "many parts", 2010, "c", 2), ("c/6", "", "", "Many Parts!", 2010, "c", 4), ("c/7", "", "", "", 0, "c", 4),
]
_STEM = "regexp_replace(lower(file_name), '[.][^.]*$', '')"


def _in(text: str) -> str:
    whole = f"regexp_replace({text}, '[^a-z0-9]', '', 'g')"
    part = "([a-z]{{2,10}})[ ]*[-_]?[ ]*([0-9]{{2,6}})(?:[^0-9]|$)".replace("{{", "{").replace("}}", "}")
    return f"CASE WHEN regexp_matches({whole}, '^[a-z]+[0-9]+$') THEN {whole} ELSE regexp_extract({text}, '{part}', 1) || regexp_extract({text}, '{part}', 2) END"


TWIN = f"""{values_sql(TWINS, "path, code, file_name, title, year, folder, size")}, n AS (SELECT *, regexp_replace(lower(code), '[^a-z0-9]', '', 'g') AS c, {_in(_STEM)} AS f, {_in("lower(title)")} AS t FROM v),
    k AS (SELECT *, CASE WHEN regexp_matches(c, '^[a-z]+[0-9]{{1,2}}$') THEN CASE WHEN starts_with(f, c) AND length(f) > length(c) THEN f WHEN starts_with(t, c) AND length(t) > length(c) THEN t ELSE c END
    WHEN regexp_matches(c, '^[a-z]+[0-9]+$') THEN c WHEN f <> '' THEN f ELSE t END AS code_key,
    regexp_replace(regexp_replace(lower(title), '^ *[\\[(]? *[a-z]{{1,8}} *[-_]? *[0-9]{{2,6}} *[\\])]? *[-: ]*', ''), '[^0-9a-z]', '', 'g') AS name FROM n),
    ident AS (SELECT *, CASE WHEN code_key <> '' THEN 'code' ELSE 'title' END AS kind, CASE WHEN code_key <> '' THEN code_key ELSE name || '::' || CASE WHEN year BETWEEN 1000 AND 9999 THEN CAST(year AS VARCHAR) ELSE '' END END AS key FROM k WHERE code_key <> '' OR name <> ''),
    folders AS (SELECT kind, key, folder, count(*) AS n, sum(size) AS bytes, min(size) AS low, max(size) AS high, count(*) FILTER (year > 0) AS dated FROM ident GROUP BY 1, 2, 3),
    g AS (SELECT kind, key, CAST(sum(n) AS BIGINT) AS members, count(*) AS copies, CAST(sum(bytes) - max(bytes) AS BIGINT) AS redundant, CASE WHEN min(low) = max(high) THEN 'very high' WHEN kind = 'code' THEN 'high' WHEN sum(dated) = sum(n) THEN 'medium' ELSE 'low' END AS confidence FROM folders GROUP BY 1, 2 HAVING sum(n) > 1)"""
_TWIN_SCHEMA = "path string, code string, file_name string, title string, year int, folder string, size long"


@query("SELECT kind, key, members, copies, redundant, confidence FROM g WHERE copies > 1", TWIN)
def dup_codes(spark, d):
    return dedupe.groups(dedupe.identified(values(spark, TWINS, _TWIN_SCHEMA))).filter("not multipart").select("kind", "key", "members", "copies", "redundant", "confidence")


@query("SELECT kind, key, members FROM g WHERE copies = 1", TWIN)
def dup_multipart(spark, d):
    return dedupe.groups(dedupe.identified(values(spark, TWINS, _TWIN_SCHEMA))).filter("multipart").select("kind", "key", "members")


@query(
    f"""WITH c AS (SELECT {KEY.format("trim(person)")} AS key, trim(person) AS person, userrating AS u, runtime_min AS r FROM item_people JOIN items USING (item_id))
    SELECT key, min(person) AS person, count(*) AS count, count(*) FILTER (u > 0) AS rated, round(avg(u) FILTER (u > 0), 4) AS avg_rating, CAST(sum(r) AS BIGINT) AS runtime FROM c GROUP BY key ORDER BY count DESC, person LIMIT 30""",
    ITEMS,
    PEOPLE,
)
def people_by_key(spark, d):
    return freq.person_ranking(m.item_people(spark, d), m.items(spark, d))


@query(
    """WITH p AS (SELECT DISTINCT item_id, person FROM item_people), who AS (SELECT person, count(*) AS c FROM item_people GROUP BY 1 ORDER BY c DESC, person LIMIT 10), own AS (SELECT p.* FROM p JOIN who USING (person)),
    n AS (SELECT person, 'studio' AS part, studio AS value, count(*) AS count, 3 AS most FROM own JOIN items USING (item_id) GROUP BY 1, 3 UNION ALL
    SELECT person, 'tag', tag, count(*), 6 FROM own JOIN (SELECT DISTINCT item_id, tag FROM item_tags) USING (item_id) GROUP BY 1, 3 UNION ALL
    SELECT own.person, 'partner', p.person, count(*), 3 FROM own JOIN p ON own.item_id = p.item_id AND own.person <> p.person GROUP BY 1, 3),
    r AS (SELECT *, CAST(row_number() OVER (PARTITION BY person, part ORDER BY count DESC, value) AS INT) AS rank FROM n) SELECT person, part, value, count, rank FROM r WHERE rank <= most""",
    ITEMS,
    TAGS,
    PEOPLE,
)
def person_enrichment(spark, d):
    items, people = m.items(spark, d), m.item_people(spark, d)
    who = people.groupBy("person").agg(F.count("*").alias("c")).orderBy(F.desc("c"), "person").limit(10)
    return freq.enrichment(people, items, m.item_tags(spark, d), who)


@query("SELECT count(*) AS total, count(*) FILTER (vote > 0) AS up, count(*) FILTER (vote < 0) AS down FROM votes", VOTES)
def vote_summary(spark, d):
    return freq.vote_summary(m.votes(spark, d))


@query(
    "SELECT i.name, i.count, t.tags FROM (SELECT year AS name, count(*) AS count FROM items WHERE source = 'NATION_3' GROUP BY 1) i, (SELECT count(DISTINCT tag) AS tags FROM item_tags WHERE item_id IN (SELECT item_id FROM items WHERE source = 'NATION_3')) t",
    ITEMS,
    TAGS,
)
def years_of_source(spark, d):
    items, children = search.of_source(m.items(spark, d), {"tags": m.item_tags(spark, d)}, "NATION_3")
    return freq.by_year(items).join(children["tags"].agg(F.count_distinct("tag").alias("tags")))  # one row beside


@query("SELECT kind, value, df, round(least(greatest(ln(n / df) / CASE WHEN n > greatest(50.0::DOUBLE, n * 0.001::DOUBLE) THEN ln(n / greatest(50.0::DOUBLE, n * 0.001::DOUBLE)) ELSE 1 END, 0.05::DOUBLE), 1.0::DOUBLE), 6) AS idf FROM df, n", ITEMS, TAGS, PEOPLE, TOKENS, VOTES, PROFILE)
def token_idf(spark, d):
    total = m.table(spark, d, "orders").agg(F.count("*").cast("double").alias("n"))
    return recommend.document_frequency(tokens(spark, d)).join(total).select("kind", "value", "df", F.round(recommend.damped(F.col("df"), F.col("n")), 6).alias("idf"))


OVERRIDES = [("tag", "Brand#11", 3.0), ("tag", "Brand#12", -1.5), ("studio", "BUILDING", 0.0), ("person", "nobody", 2.0)]


@query(
    "SELECT kind, value, coalesce(p.pos, 0.0) AS auto_pos, coalesce(p.neg, 0.0) AS auto_neg, manual, CASE WHEN manual = 0 THEN 0.0 ELSE coalesce(p.pos, 0.0) + greatest(coalesce(manual, 0.0), 0.0) END AS pos, CASE WHEN manual = 0 THEN 0.0 ELSE coalesce(p.neg, 0.0) + greatest(-coalesce(manual, 0.0), 0.0) END AS neg FROM profile p FULL JOIN over USING (kind, value)",
    ITEMS,
    TAGS,
    PEOPLE,
    TOKENS,
    VOTES,
    PROFILE,
    "over AS (SELECT kind, value, CAST(manual AS DOUBLE) AS manual FROM (VALUES " + ", ".join(f"('{k}', '{v}', {w})" for k, v, w in OVERRIDES) + ") AS o(kind, value, manual))",
)
def vector_snapshot(spark, d):
    over = values(spark, OVERRIDES, "kind string, value string, weight double")
    return recommend.vector_snapshot(tokens(spark, d), m.votes(spark, d), m.table(spark, d, "orders").count(), over)


@query()
def random_picks(spark, d):
    return recommend.random_picks(m.items(spark, d), tokens(spark, d), preference(spark, d), m.votes(spark, d), m.plays(spark, d), today=TODAY)


@query("SELECT item_id, CAST(count(*) AS BIGINT) AS n_tags FROM (SELECT DISTINCT item_id, tag FROM item_tags) JOIN items USING (item_id) WHERE source = 'NATION_3' GROUP BY 1 ORDER BY item_id LIMIT 50 OFFSET 20", ITEMS, TAGS)
def second_page(spark, d):
    items, children = search.of_source(m.items(spark, d), {"tags": m.item_tags(spark, d).distinct()}, "NATION_3")
    return search.page(children["tags"].groupBy("item_id").agg(F.count("*").alias("n_tags")), 20, 50)[0]


@query("SELECT path, source FROM old WHERE source IN ('NATION_3', 'NATION_4') AND path % 5 = 0", ITEMS, "old AS (SELECT item_id AS path, source FROM items)")
def pruned_paths(spark, d):
    stored = m.items(spark, d).select(F.col("item_id").alias("path"), "source")
    there = stored.filter("path % 5 <> 0")
    found = {"NATION_3": there.filter("source = 'NATION_3'"), "NATION_4": there.filter("source = 'NATION_4'"), "NATION_5": None, "NATION_6": there.limit(0), "NATION_7": there.filter("source = 'NATION_7' and path % 3 = 0")}
    gone, _ = maintain.pruned_roots(stored, found)
    return stored.join(gone, "path", "left_semi")
