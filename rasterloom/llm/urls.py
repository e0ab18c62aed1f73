"""URL filter by a temporal list join: dated list entries become validity intervals, captures are judged as of their fetch."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut

_AUTHORITY = "^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)"
_SEGMENT = "^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*/([^/?#]+)"


def host_of(url):
    """Host of a URL: lower case, without user, port and closing dot; empty where there is none."""
    host = F.regexp_extract(F.coalesce(url, F.lit("")), _AUTHORITY, 1)
    host = F.regexp_replace(F.regexp_replace(host, "^.*@", ""), ":[0-9]*$", "")
    return F.regexp_replace(F.lower(host), "[.]+$", "")


def keys_of(host, url):
    """List keys that can cover a URL: the host and its parent domains down to two labels, each also with the first path segment."""
    labels = F.split(host, "[.]")
    last = F.greatest(F.size(labels) - 1, F.lit(1))
    names = F.transform(F.sequence(F.lit(1), last), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    segment = F.regexp_extract(F.coalesce(url, F.lit("")), _SEGMENT, 1)
    longer = F.when(segment != "", F.transform(names, lambda x: F.concat(x, F.lit("/"), segment))).otherwise(F.array().cast("array<string>"))
    return F.when(host == "", F.array().cast("array<string>")).otherwise(F.array_distinct(F.concat(names, longer)))


def validity(entries: DataFrame) -> DataFrame:
    """(key, action, since date, until date or null) from dated entries (key, dated date, action 'block' or 'lift').

    An entry holds until the key's next one. Of entries for one key and day, block wins. Entries with a null are void.
    A key has one row a day at most after that, so its history is bounded by the calendar, however often it is listed.
    """
    days = entries.where("key is not null and dated is not null and action is not null").groupBy("key", "dated").agg(F.min("action").alias("action"))
    return days.select("key", "action", F.col("dated").alias("since"), F.lead("dated").over(Window.partitionBy("key").orderBy("dated")).alias("until"))


def url_filter(captures: DataFrame, entries: DataFrame) -> DataFrame:
    """(page_id, host, fetched, verdict, list_key, since) for each row of captures (page_id, url, fetched date).

    verdict is 'block' or 'keep' by the most specific entry that is valid on the day of the fetch: the longest key, then
    the alphabetically last; 'keep' without any; 'invalid' without a host or a fetch date. list_key and since name the
    entry. Repeated rows each get their row. Intervals are dealt by key and month, so a hot host is spread over the
    months of its captures; adaptive execution splits what is still hot.
    """
    rows = (
        captures.select("page_id", "url", F.col("fetched").cast("date").alias("fetched"))
        .groupBy("page_id", "url", "fetched").agg(F.count(F.lit(1)).alias("copies"))
        .withColumn("host", host_of(F.col("url")))
        .withColumn("key", F.explode_outer(keys_of(F.col("host"), F.col("url"))))
        .withColumn("month", F.trunc("fetched", "month"))
    )
    held = validity(entries)
    ends = captures.agg(F.max(F.col("fetched").cast("date")).alias("last")).first()["last"]
    reach = F.least(F.coalesce(F.date_sub("until", 1), F.lit(ends)), F.lit(ends))
    held = held.where(F.col("since") <= F.lit(ends)).select(
        F.col("key").alias("list_key"), "action", "since", "until",
        F.explode(F.sequence(F.trunc("since", "month"), F.trunc(reach, "month"), F.expr("interval 1 month"))).alias("list_month"),
    )
    held = cut(held, "intervals")
    on = (F.col("key") == F.col("list_key")) & (F.col("month") == F.col("list_month")) & (F.col("since") <= F.col("fetched")) & (F.col("until").isNull() | (F.col("fetched") < F.col("until")))
    best = F.max(F.when(F.col("list_key").isNotNull(), F.struct(F.length("list_key").alias("size"), "list_key", "since", "action"))).alias("best")
    judged = rows.join(held, on, "left").groupBy("page_id", "url", "fetched", "host", "copies").agg(best)
    verdict = F.when((F.col("host") == "") | F.col("fetched").isNull(), "invalid").when(F.col("best.action") == "block", "block").otherwise("keep")
    return judged.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies")))).select(
        "page_id", "host", "fetched", verdict.alias("verdict"), F.col("best.list_key").alias("list_key"), F.col("best.since").alias("since")
    )


# ---- the registered query: the pages table has no fetch dates and there is no list, so both are derived by rule -------


def _digit(column, at: int):
    """Two hexadecimal digits of a text's MD5 as a number."""
    return F.conv(F.substring(F.md5(column), at, 2), 16, 10).cast("int")


def derived_captures(pages: DataFrame) -> DataFrame:
    """Captures from pages: the page with id i is fetched on day i mod 366 of 2024."""
    return pages.select("page_id", "url", F.date_add(F.lit("2024-01-01").cast("date"), F.pmod(F.col("page_id"), F.lit(366)).cast("int")).alias("fetched"))


def derived_entries(pages: DataFrame) -> DataFrame:
    """A dated list from the keys of the pages: by its MD5 a third of the keys is blocked at some day and half of those lifted later."""
    host = host_of(F.col("url"))
    keys = pages.select(F.explode(keys_of(host, F.col("url"))).alias("key")).distinct().where(_digit(F.col("key"), 1) % 3 == 0)
    day = F.date_add(F.lit("2024-01-01").cast("date"), (_digit(F.col("key"), 3) + F.lit(0)))
    lifted = F.date_add(day, _digit(F.col("key"), 5) + F.lit(1))
    return keys.select("key", day.alias("dated"), F.lit("block").alias("action")).union(
        keys.where(_digit(F.col("key"), 7) % 2 == 0).select("key", lifted.alias("dated"), F.lit("lift").alias("action"))
    )


ORACLE = r"""
WITH p AS (
  SELECT page_id, url, CAST('2024-01-01' AS DATE) + CAST(page_id % 366 AS INTEGER) AS fetched,
    regexp_replace(lower(regexp_replace(regexp_replace(
      regexp_extract(coalesce(url, ''), '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)', 1), '^.*@', ''), ':[0-9]*$', '')), '[.]+$', '') AS host,
    regexp_extract(coalesce(url, ''), '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*/([^/?#]+)', 1) AS segment
  FROM pages),
named AS (
  SELECT *, row_number() OVER () AS rid,
    list_transform(range(1, greatest(len(string_split(host, '.')) - 1, 1) + 1), lambda i: array_to_string(string_split(host, '.')[i:], '.')) AS names
  FROM p),
keyed AS (
  SELECT page_id, url, fetched, host, rid,
    unnest(list_distinct(list_concat(names, CASE WHEN segment <> '' THEN list_transform(names, lambda x: x || '/' || segment) ELSE [] END))) AS k
  FROM named WHERE host <> ''),
hexed AS (SELECT DISTINCT k, md5(k) AS m FROM keyed),
listed AS (
  SELECT k, m, CAST('2024-01-01' AS DATE) + CAST(('0x' || substr(m, 3, 2)) AS INTEGER) AS d1,
    CAST(('0x' || substr(m, 5, 2)) AS INTEGER) + 1 AS gap
  FROM hexed WHERE CAST(('0x' || substr(m, 1, 2)) AS INTEGER) % 3 = 0),
entries AS (
  SELECT k, d1 AS since, 'block' AS action FROM listed
  UNION ALL SELECT k, d1 + gap, 'lift' FROM listed WHERE CAST(('0x' || substr(m, 7, 2)) AS INTEGER) % 2 = 0),
valid AS (SELECT k, action, since, lead(since) OVER (PARTITION BY k ORDER BY since) AS until FROM entries),
hit AS (
  SELECT rid, action, since, keyed.k AS list_key,
    row_number() OVER (PARTITION BY rid ORDER BY length(keyed.k) DESC, keyed.k DESC) AS r
  FROM keyed JOIN valid ON keyed.k = valid.k AND since <= fetched AND (until IS NULL OR fetched < until))
SELECT page_id, host, fetched,
  CASE WHEN host = '' OR fetched IS NULL THEN 'invalid' WHEN action = 'block' THEN 'block' ELSE 'keep' END AS verdict, list_key, since
FROM named LEFT JOIN hit ON named.rid = hit.rid AND r = 1"""
