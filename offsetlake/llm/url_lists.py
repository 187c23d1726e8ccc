"""URL filters with dated lists: each capture is judged by the entries active when it was fetched.

Entries of a list add or remove a pattern on a day. Per pattern and category they
become validity intervals: an addition holds from its day up to the day of the next
entry. Captures join the intervals on the keys that their URL has (the host and its
parent domains, and the path's prefixes on that host) and on the day.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import table

#: Scheme, user, host, port, path of an absolute URL.
URL = r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/:?#]+)(?::[0-9]*)?([^?#]*)"
MOST_BROADCAST = 200_000  # intervals, some 20 MB; longer lists shuffle


def host_of(url: Column) -> Column:
    """The host in lower case without a final dot; empty if there is none."""
    return F.regexp_replace(F.lower(F.regexp_extract(url, URL, 1)), r"\.$", "")


def intervals(entries: DataFrame) -> DataFrame:
    """Validity intervals: ``pattern``, ``category``, ``since`` (inclusive), ``until`` (exclusive, null: still active).

    ``entries``: ``pattern``, ``category``, ``action`` ('add' or 'remove'), ``day``.
    Of entries of one pattern and category on one day, a removal is the last word;
    repeated entries change nothing. Rows with a null pattern, category or day do
    not count.
    """
    known = entries.where("pattern is not null and category is not null and day is not null and action in ('add', 'remove')")
    daily = known.groupBy("pattern", "category", "day").agg(F.max("action").alias("action"))
    along = Window.partitionBy("pattern", "category").orderBy("day")
    return daily.withColumn("until", F.lead("day").over(along)).where("action = 'add'").select("pattern", "category", F.col("day").alias("since"), "until")


def _keys(host: Column, path: Column, depth: int) -> Column:
    labels = F.split(host, r"\.")
    n = F.size(labels)
    domains = F.transform(F.sequence(F.lit(1), n), lambda i: F.array_join(F.slice(labels, i, n - i + 1), "."))
    parts = F.filter(F.split(path, "/"), lambda p: p != "")
    deep = F.least(F.size(parts), F.lit(depth))
    prefixes = F.transform(F.sequence(F.lit(1), deep), lambda i: F.concat_ws("/", host, F.array_join(F.slice(parts, 1, i), "/")))
    return F.when(host == "", F.array().cast("array<string>")).otherwise(F.concat(domains, F.when(deep > 0, prefixes).otherwise(F.array().cast("array<string>"))))


def judge(captures: DataFrame, entries: DataFrame, id_column: str = "page_id", url_column: str = "url", fetched_column: str = "fetched") -> DataFrame:
    """Every capture with the entries that were active on the day it was fetched.

    Returns ``id_column``, ``host``, ``fetched`` date, ``n_active`` long (intervals
    that apply), ``categories`` (theirs, in order, joined by commas; empty if
    none), ``pattern`` (the longest, then the first) and ``blocked``. Patterns
    without a slash match a host and all below it; patterns ``host/path`` match
    that host and the path at a whole segment. A null or relative URL, or a null
    day, matches nothing. Rows that repeat in id, URL and day give one row. Other
    columns are not read.
    """
    spans = intervals(entries)
    size = spans.agg(F.count(F.lit(1)).alias("n"), F.max(F.size(F.split("pattern", "/")) - 1).alias("depth")).first()
    spans = spans.select("pattern", "category", "since", "until")
    if size["n"] <= MOST_BROADCAST:
        spans = F.broadcast(spans)
    url = F.col(url_column)
    rows = captures.select(F.col(id_column).alias("id"), url.alias("url"), F.col(fetched_column).cast("date").alias("fetched"), F.coalesce(host_of(url), F.lit("")).alias("host"), F.regexp_extract(url, URL, 2).alias("path"))
    keyed = rows.select("id", "url", "fetched", "host", F.explode_outer(_keys(F.col("host"), F.col("path"), size["depth"] or 0)).alias("key"))
    hit = (F.col("key") == F.col("pattern")) & (F.col("fetched") >= F.col("since")) & (F.col("until").isNull() | (F.col("fetched") < F.col("until")))
    met = keyed.join(spans, hit, "left")
    out = met.groupBy("id", "url", "host", "fetched").agg(F.collect_set(F.when(F.col("pattern").isNotNull(), F.struct(F.length("pattern").alias("n"), F.col("pattern").alias("pattern"), "category"))).alias("hits"))
    out = out.withColumns({
        "n_active": F.size("hits").cast("long"),
        "categories": F.array_join(F.array_sort(F.array_distinct(F.transform("hits", lambda h: h["category"]))), ","),
        "pattern": F.array_max("hits")["pattern"],
    })
    return out.select(F.col("id").alias(id_column), "host", "fetched", "n_active", "categories", F.coalesce("pattern", F.lit("")).alias("pattern"), (F.col("n_active") > 0).alias("blocked"))


#: The dated list that the query judges by: pattern, category, action, day.
ENTRIES = (
    ("casino-win.example.com", "gambling", "add", "2023-06-01"),
    ("casino-win.example.com", "gambling", "remove", "2024-03-10"),
    ("casino-win.example.com", "gambling", "add", "2024-05-02"),
    ("free-bets.example.com", "gambling", "add", "2024-02-15"),
    ("free-bets.example.com/en", "spam", "add", "2024-01-20"),
    ("free-bets.example.com/en", "spam", "remove", "2024-09-01"),
    ("cheap-pills.example.com", "pharmacy", "add", "2023-01-01"),
    ("cheap-pills.example.com", "spam", "add", "2024-04-01"),
    ("cheap-pills.example.com", "spam", "remove", "2024-04-01"),
    ("cheap-pills.example.com", "pharmacy", "remove", "2024-11-11"),
    ("m.casino-win.example.com", "mobile", "add", "2024-01-01"),
    ("thering.example.org", "mirror", "add", "2024-06-30"),
    ("thering.example.org", "mirror", "remove", "2024-07-15"),
    ("thering.example.org", "mirror", "add", "2024-08-01"),
    ("thering.example.org", "mirror", "remove", "2024-12-01"),
    ("blog.tionsh.example.com/fr", "mirror", "add", "2024-03-03"),
    ("example.net", "retired", "add", "2024-10-01"),
)


def op3_url_temporal(spark, sf_dir: str) -> DataFrame:
    """Pages carry no date of their own; a page counts as fetched on day page_id mod 366 of 2024."""
    pages = table(spark, sf_dir, "pages").select("page_id", "url", F.date_add(F.lit("2024-01-01").cast("date"), F.pmod("page_id", F.lit(366)).cast("int")).alias("fetched"))
    entries = spark.sql(f"SELECT * FROM VALUES {_VALUES} AS entries(pattern, category, action, day)")
    return judge(pages, entries).withColumn("fetched", F.col("fetched").cast("string"))


_VALUES = ",\n        ".join(f"('{p}', '{c}', '{a}', DATE '{d}')" for p, c, a, d in ENTRIES)

OP3_SQL = f"""
WITH entries(pattern, category, action, day) AS (VALUES
        {_VALUES}
), daily AS (
    SELECT pattern, category, day, max(action) AS action FROM entries GROUP BY ALL
), followed AS (
    SELECT *, lead(day) OVER (PARTITION BY pattern, category ORDER BY day) AS until FROM daily
), spans AS (
    SELECT pattern, category, day AS since, until FROM followed WHERE action = 'add'
), rows_ AS (
    SELECT DISTINCT page_id, url, CAST(DATE '2024-01-01' + CAST(page_id % 366 AS INTEGER) AS DATE) AS fetched,
           coalesce(regexp_replace(lower(regexp_extract(url, '{URL}', 1)), '\\.$', ''), '') AS host,
           coalesce(regexp_extract(url, '{URL}', 2), '') AS path
    FROM pages
), met AS (
    SELECT r.page_id, r.url, r.host, r.fetched, s.pattern, s.category
    FROM rows_ r JOIN spans s
      ON r.fetched >= s.since AND (s.until IS NULL OR r.fetched < s.until)
     AND CASE WHEN contains(s.pattern, '/')
              THEN starts_with(r.host || regexp_replace(r.path, '/+', '/', 'g') || '/', s.pattern || '/')
              ELSE r.host = s.pattern OR ends_with(r.host, '.' || s.pattern) END
)
SELECT r.page_id, r.host, CAST(r.fetched AS VARCHAR) AS fetched,
       count(m.pattern) AS n_active,
       coalesce(array_to_string(list_sort(list_distinct(list(m.category) FILTER (m.category IS NOT NULL))), ','), '') AS categories,
       coalesce(arg_max(m.pattern, (length(m.pattern), m.pattern)), '') AS pattern,
       count(m.pattern) > 0 AS blocked
FROM rows_ r LEFT JOIN met m ON r.page_id = m.page_id AND r.url IS NOT DISTINCT FROM m.url
GROUP BY r.page_id, r.url, r.host, r.fetched
"""
