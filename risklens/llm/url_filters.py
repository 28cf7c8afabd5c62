"""URL filters with dated lists: validity intervals and an as-of join.

A list entry (key, action, at) holds from ``at`` until the next entry of its key.
Keys are hosts and their parent domains (``a.example.org``, ``example.org``, ``org``)
and directories (``a.example.org/news/``). A capture (page, url, fetched at) asks
all keys that cover its URL for the entry that is active at its fetch time; of
those found the longest key, the most specific one, decides.

Scale: time is cut into buckets. What is active when a bucket begins comes from
one row for each key and bucket (a running window over these few rows); inside
a bucket, captures and intervals of a key meet in one pass in time order. So a
host with a third of all captures is dealt over its buckets, every capture
meets one interval a key, and nothing is broadcast.

Edge cases: entries of one key and time count once (``block`` before ``allow``);
null urls, urls without a host, and captures without a time match nothing and
are not blocked; entries without key, action or time are ignored; equal captures
are one row with their number; empty tables give empty results; other columns
are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

BLOCK, ALLOW = "block", "allow"
#: Seconds of a bucket.
BUCKET = 86_400


def host_of(url: Column) -> Column:
    return F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1))


def directory_of(url: Column) -> Column:
    """The path up to its last slash, as ``/a/b/`` (``/`` at least)."""
    path = F.regexp_extract(F.coalesce(url, F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*/)", 1)
    return F.when(path == "", F.lit("/")).otherwise(path)


def keys_of(url: Column) -> Column:
    """Every key that covers the URL: domains of its host, directories on it."""
    parts, folders = F.split(host_of(url), r"\."), F.split(directory_of(url), "/")
    domains = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda k: F.array_join(F.slice(parts, k, F.size(parts)), "."))
    places = F.transform(F.sequence(F.lit(1), F.size(folders) - 1),
                         lambda k: F.concat(host_of(url), F.array_join(F.slice(folders, 1, k), "/"), F.lit("/")))
    return F.when(host_of(url) == "", F.array().cast("array<string>")).otherwise(F.array_distinct(F.concat(domains, places)))


def intervals(entries: DataFrame, bucket: int = BUCKET) -> DataFrame:
    """(key, bucket, at, action, valid_to): entries as intervals; ``valid_to`` is null
    for the one that still holds. The next entry is looked up within the bucket, or
    else at the key's next bucket that has one."""
    clean = (entries.where("key is not null and at is not null").where(F.col("action").isin(BLOCK, ALLOW))
             .groupBy("key", "at").agg(F.max("action").alias("action")).withColumn("bucket", F.floor(F.col("at") / bucket)))
    ends = clean.groupBy("key", "bucket").agg(F.min("at").alias("first"))
    ends = ends.select("key", "bucket", F.lead("first").over(Window.partitionBy("key").orderBy("bucket")).alias("next"))
    inside = F.lead("at").over(Window.partitionBy("key", "bucket").orderBy("at"))
    return clean.withColumn("inside", inside).join(ends, ["key", "bucket"]).select(
        "key", "bucket", "at", "action", F.coalesce("inside", "next").alias("valid_to"))


def as_of(captures: DataFrame, entries: DataFrame, bucket: int = BUCKET) -> DataFrame:
    """(capture, key, action, valid_from, valid_to) of captures (capture, key, at) for
    which an entry of the key is active."""
    spans = intervals(entries, bucket)
    seen = captures.withColumn("bucket", F.floor(F.col("at") / bucket))
    entry = F.struct("action", F.col("at").alias("valid_from"), "valid_to")
    # one row a key and bucket: its last entry, and from the rows before it what holds at its begin
    last = spans.groupBy("key", "bucket").agg(F.max_by(entry, "at").alias("entry")).unionByName(
        seen.select("key", "bucket").distinct().withColumn("entry", F.lit(None).cast("struct<action:string,valid_from:bigint,valid_to:bigint>")))
    last = last.groupBy("key", "bucket").agg(F.max("entry").alias("entry"))
    before = Window.partitionBy("key").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    carried = last.select("key", "bucket", F.last("entry", True).over(before).alias("entry")).where("entry is not null")
    none = F.lit(None)
    events = (spans.select("key", "bucket", "at", F.lit(0).alias("turn"), entry.alias("entry"), none.cast("struct<page_id:bigint,url:string,fetched_at:bigint>").alias("capture"))
              .unionByName(carried.select("key", "bucket", (F.col("bucket") * bucket).alias("at"), F.lit(-1).alias("turn"), "entry",
                                          none.cast("struct<page_id:bigint,url:string,fetched_at:bigint>").alias("capture")))
              .unionByName(seen.select("key", "bucket", "at", F.lit(1).alias("turn"),
                                       none.cast("struct<action:string,valid_from:bigint,valid_to:bigint>").alias("entry"), "capture")))
    upto = Window.partitionBy("key", "bucket").orderBy("at", "turn").rowsBetween(Window.unboundedPreceding, 0)
    met = events.withColumn("entry", F.last("entry", True).over(upto)).where("capture is not null and entry is not null")
    return met.select("capture", "key", "entry.action", "entry.valid_from", "entry.valid_to")


def evaluate(captures: DataFrame, entries: DataFrame, bucket: int = BUCKET) -> DataFrame:
    """(page_id, url, fetched_at, captures, blocked, key, valid_from, valid_to) of every
    distinct capture (page_id, url, fetched_at)."""
    each = captures.groupBy("page_id", "url", "fetched_at").agg(F.count("*").alias("captures"))
    asked = each.where("fetched_at is not null").select(
        F.struct(F.col("page_id").cast("long").alias("page_id"), "url", F.col("fetched_at").cast("long").alias("fetched_at")).alias("capture"), F.explode(keys_of(F.col("url"))).alias("key"), F.col("fetched_at").alias("at"))
    met = as_of(asked, entries, bucket)
    decided = met.groupBy("capture").agg(F.max_by(F.struct("action", "key", "valid_from", "valid_to"), F.struct(F.length("key"), "key")).alias("d"))
    joined = each.join(decided, F.col("page_id").eqNullSafe(F.col("capture.page_id")) & F.col("url").eqNullSafe(F.col("capture.url"))
                       & (F.col("fetched_at") == F.col("capture.fetched_at")), "left")
    return joined.select("page_id", "url", "fetched_at", "captures", F.coalesce(F.col("d.action") == BLOCK, F.lit(False)).alias("blocked"),
                         F.col("d.key").alias("key"), F.col("d.valid_from").alias("valid_from"), F.col("d.valid_to").alias("valid_to"))


def captures_of(pages: DataFrame) -> DataFrame:
    """The pages as captures, one fetched each minute in the order of ids."""
    return pages.select("page_id", "url", (F.col("page_id").cast("long") * 60).alias("fetched_at"))


def entries_of(pages: DataFrame) -> DataFrame:
    """Dated entries that the URLs report at their fetch: a query string blocks its
    directory, a fragment clears it; a .html page blocks its host, a www host clears
    its parent domain."""
    url = F.col("url")
    place, host = F.concat(host_of(url), directory_of(url)), host_of(url)
    found = F.array(
        F.when(url.contains("?"), F.struct(place.alias("key"), F.lit(BLOCK).alias("action"))),
        F.when(url.contains("#"), F.struct(place.alias("key"), F.lit(ALLOW).alias("action"))),
        F.when(url.endswith(".html"), F.struct(host.alias("key"), F.lit(BLOCK).alias("action"))),
        F.when(host.startswith("www."), F.struct(F.substring(host, 5, 1 << 20).alias("key"), F.lit(ALLOW).alias("action"))))
    rows = pages.where(url.isNotNull() & (host != "")).select((F.col("page_id").cast("long") * 60).alias("at"), F.explode(found).alias("e"))
    return rows.where("e is not null").select("e.key", "e.action", "at")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url")
    return evaluate(captures_of(pages), entries_of(pages))


SQL = r"""
WITH p AS (
  SELECT page_id, url, page_id * 60 AS ts, lower(regexp_extract(coalesce(url, ''), '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)', 1)) AS host,
    CASE WHEN regexp_extract(coalesce(url, ''), '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*/)', 1) = '' THEN '/'
         ELSE regexp_extract(coalesce(url, ''), '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*/)', 1) END AS dir FROM pages),
e AS (
  SELECT key, ts, max(action) AS action FROM (
    SELECT host || dir AS key, 'block' AS action, ts FROM p WHERE host <> '' AND contains(url, '?')
    UNION ALL SELECT host || dir, 'allow', ts FROM p WHERE host <> '' AND contains(url, '#')
    UNION ALL SELECT host, 'block', ts FROM p WHERE host <> '' AND url LIKE '%.html'
    UNION ALL SELECT substr(host, 5), 'allow', ts FROM p WHERE host LIKE 'www.%') WHERE ts IS NOT NULL GROUP BY key, ts),
s AS (SELECT key, ts AS valid_from, lead(ts) OVER (PARTITION BY key ORDER BY ts) AS valid_to, action FROM e),
c AS (SELECT page_id, url, ts AS fetched_at, any_value(host) AS host, any_value(dir) AS dir, count(*) AS captures FROM p GROUP BY ALL),
k AS (
  SELECT DISTINCT page_id, url, fetched_at, unnest(list_concat(
    list_transform(range(1, len(string_split(host, '.')) + 1), lambda i: array_to_string(list_slice(string_split(host, '.'), i, len(string_split(host, '.'))), '.')),
    list_transform(range(1, len(string_split(dir, '/'))), lambda i: host || array_to_string(list_slice(string_split(dir, '/'), 1, i), '/') || '/'))) AS key
  FROM c WHERE host <> ''),
m AS (SELECT k.page_id, k.url, k.fetched_at, k.key, s.action, s.valid_from, s.valid_to FROM k ASOF JOIN s ON k.key = s.key AND k.fetched_at >= s.valid_from),
d AS (SELECT *, row_number() OVER (PARTITION BY page_id, url, fetched_at ORDER BY length(key) DESC, key DESC) AS r FROM m)
SELECT c.page_id, c.url, c.fetched_at, c.captures, coalesce(d.action = 'block', false) AS blocked, d.key, d.valid_from, d.valid_to
FROM c LEFT JOIN d ON c.page_id IS NOT DISTINCT FROM d.page_id AND c.url IS NOT DISTINCT FROM d.url AND c.fetched_at IS NOT DISTINCT FROM d.fetched_at AND d.r = 1
"""
