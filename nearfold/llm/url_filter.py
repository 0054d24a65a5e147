"""URL filters by a temporal list join.

A list is a log of dated events that add or remove an entry. Each entry's
events become validity intervals [since, until). A capture is evaluated
against the entries that were active on the day it was fetched: an as-of join
on the keys of its URL (its host and the domains above it; its host and path,
with every shorter path) and the interval that holds the day. Distinct URLs and
days are joined once, however often they were captured.

Defined results: of several events of one entry on a day the removal counts.
Events without entry, kind, day or action don't count. A capture without a URL,
host or day is never blocked. Null ids and repeated captures are kept. Empty
captures give an empty result, an empty list blocks nothing. Other columns are
ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from .common import cut

FOREVER = "9999-12-31"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
HOST = r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:@]*)"
PATH = r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*(/[^?#]*)"


def host_of(url: Column) -> Column:
    """Lower-case host without a last full stop; null if there is none."""
    return F.nullif(F.regexp_replace(F.translate(F.regexp_extract(url, HOST, 1), _UPPER, _LOWER), r"\.+$", ""), F.lit(""))


def path_of(url: Column) -> Column:
    """Path without query, fragment and last slashes; empty if there is none."""
    return F.regexp_replace(F.regexp_extract(url, PATH, 1), "/+$", "")


def intervals(events: DataFrame) -> DataFrame:
    """(kind, entry, category, since, until): when each entry was active. events: kind, entry, day, action, category."""
    e = events.filter("kind IS NOT NULL AND entry IS NOT NULL AND day IS NOT NULL AND action IN ('add', 'remove')")
    daily = e.groupBy("kind", "entry", F.col("day").cast("date").alias("since")).agg(F.max(F.col("action") == "remove").alias("gone"), F.min("category").alias("category"))
    own = W.partitionBy("kind", "entry").orderBy("since")  # at most a row a day
    daily = daily.withColumn("until", F.coalesce(F.lead("since").over(own), F.lit(FOREVER).cast("date")))
    return daily.filter(~F.col("gone")).select("kind", "entry", "category", "since", "until")


def keys_of(host: Column, path: Column) -> Column:
    """Array of (kind, entry) that a URL falls under."""
    labels = F.split(host, r"\.")
    domains = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.struct(F.lit("domain").alias("kind"), F.array_join(F.slice(labels, i, F.size(labels)), ".").alias("entry")))
    parts = F.split(path, "/")
    urls = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.struct(F.lit("url").alias("kind"), F.concat(host, F.array_join(F.slice(parts, F.lit(1), i), "/")).alias("entry")))
    return F.array_distinct(F.concat(domains, urls))


def evaluate(captures: DataFrame, events: DataFrame, id_col: str = "page_id", url_col: str = "url", day_col: str = "day", broadcast_rows: int = 200_000) -> DataFrame:
    """(id, host, day, blocked, n_entries, entry, category, since): entry is the longest active one, then the first.

    The intervals are broadcast up to broadcast_rows rows; a larger list is
    joined by a shuffle, in which the join splits keys with very many URLs.
    """
    active = cut(intervals(events))
    side = F.broadcast(active) if active.limit(broadcast_rows + 1).count() <= broadcast_rows else active
    c = captures.select(F.col(id_col).alias("id"), host_of(F.col(url_col)).alias("host"), path_of(F.col(url_col)).alias("path"), F.col(day_col).cast("date").alias("day"))
    urls = c.filter("host IS NOT NULL AND day IS NOT NULL").select("host", "path", "day").distinct()
    keyed = urls.select("host", "path", "day", F.explode(keys_of(F.col("host"), F.col("path"))).alias("k")).select("host", "path", "day", F.col("k.kind").alias("kind"), F.col("k.entry").alias("entry"))
    met = keyed.join(side, ["kind", "entry"]).filter("since <= day AND day < until")
    best = F.min(F.struct(-F.length("entry"), "entry", "kind", "category", "since"))
    met = cut(met.groupBy("host", "path", "day").agg(F.count(F.lit(1)).alias("n"), best.alias("b")))
    met = met.select(F.col("host").alias("h"), F.col("path").alias("p"), F.col("day").alias("d"), "n", "b")
    out = c.join(met, (c["host"] == met["h"]) & (c["path"] == met["p"]) & (c["day"] == met["d"]), "left")
    return out.select(
        F.col("id").alias(id_col), "host", "day", F.col("n").isNotNull().alias("blocked"), F.coalesce("n", F.lit(0)).cast("long").alias("n_entries"),
        F.col("b.entry").alias("entry"), F.col("b.category").alias("category"), F.col("b.since").alias("since"),
    )


#: The list that the query evaluates (kind, entry, day, action, category).
EVENTS = [
    ("domain", "casino-win.example.com", "2024-01-15", "add", "gambling"),
    ("domain", "casino-win.example.com", "2024-06-01", "remove", "gambling"),
    ("domain", "casino-win.example.com", "2024-09-01", "add", "gambling"),
    ("domain", "cheap-pills.example.com", "2024-03-01", "add", "pharmacy"),
    ("domain", "free-bets.example.com", "2023-12-01", "add", "gambling"),
    ("domain", "free-bets.example.com", "2024-05-05", "remove", "gambling"),
    ("domain", "ads-track.example.com", "2024-02-10", "add", "tracking"),
    ("domain", "m.ads-track.example.com", "2024-08-01", "add", "tracking"),
    ("domain", "example.org", "2024-11-01", "add", "outage"),
    ("domain", "example.org", "2024-11-08", "remove", "outage"),
    ("url", "cheap-pills.example.com/de", "2024-01-01", "add", "pharmacy"),
    ("url", "www.cheap-pills.example.com/de", "2024-01-01", "add", "pharmacy"),
]

ORACLE = rf"""
WITH ev(kind, entry, day, action, category) AS (VALUES {", ".join(f"('{k}', '{e}', DATE '{d}', '{a}', '{c}')" for k, e, d, a, c in EVENTS)}),
iv AS (SELECT kind, entry, category, day AS since, coalesce(lead(day) OVER (PARTITION BY kind, entry ORDER BY day), DATE '{FOREVER}') AS until, action FROM ev),
c AS (
  SELECT page_id, nullif(regexp_replace(translate(regexp_extract(url, '{HOST}', 1), '{_UPPER}', '{_LOWER}'), '\.+$', ''), '') AS host,
    regexp_replace(regexp_extract(url, '{PATH}', 1), '/+$', '') AS path, DATE '2024-01-01' + CAST(page_id % 366 AS INTEGER) AS day
  FROM pages
), m AS (
  SELECT c.*, iv.entry, iv.category, iv.since FROM c JOIN iv ON iv.action = 'add' AND iv.since <= c.day AND c.day < iv.until AND (
    (iv.kind = 'domain' AND (c.host = iv.entry OR ends_with(c.host, '.' || iv.entry)))
    OR (iv.kind = 'url' AND (c.host || c.path = iv.entry OR starts_with(c.host || c.path, iv.entry || '/'))))
), b AS (SELECT *, row_number() OVER (PARTITION BY page_id ORDER BY length(entry) DESC, entry) AS r, count(*) OVER (PARTITION BY page_id) AS n FROM m)
SELECT c.page_id, c.host, c.day, b.page_id IS NOT NULL AS blocked, coalesce(b.n, 0) AS n_entries, b.entry, b.category, b.since
FROM c LEFT JOIN b ON b.page_id = c.page_id AND b.r = 1
"""
