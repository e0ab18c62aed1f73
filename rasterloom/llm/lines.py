"""Line dedup by site-relative frequency: a line is boilerplate where it stands on too large a share of its host's pages."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, field

#: A line on more than this share of its host's pages, and on at least so many of them, is boilerplate.
RATIO, MIN_PAGES = 0.1, 5


def _lines(text):
    return F.split(text, "\n", -1)


def boilerplate(docs: DataFrame, host: str = "source", ratio: float = RATIO, min_pages: int = MIN_PAGES) -> DataFrame:
    """(host, lines array<long>, pages long): hashes of the boilerplate lines of each host that has any.

    An array holds at most (mean number of different lines on a page of the host) / ratio hashes, as every one of them
    stands on more than that share of the pages. Pages count a line once; totals count every page, empty ones too.
    """
    own = docs.select(F.col(host).alias("host"), F.col("text").cast("string").alias("text")).where("host is not null")
    totals = cut(own.groupBy("host").agg(F.count(F.lit(1)).alias("pages")), "host-pages", "snappy")
    seen = (
        own.select("host", F.explode(F.array_distinct(F.transform(_lines("text"), F.trim))).alias("line"))
        .where("line <> ''")
        .groupBy("host", F.xxhash64("line").alias("hash"))
        .agg(F.count(F.lit(1)).alias("n"))
        .where(F.col("n") >= min_pages)
    )
    frequent = cut(seen, "frequent-lines", "snappy").join(totals, "host").where(F.col("n") / F.col("pages") > ratio)
    return frequent.groupBy("host", "pages").agg(F.sort_array(F.collect_list("hash")).alias("lines"))


def drop_boilerplate(docs: DataFrame, host: str = "source", ratio: float = RATIO, min_pages: int = MIN_PAGES) -> DataFrame:
    """All columns of `docs`, with boilerplate lines taken out of `text`, and n_lines and n_dropped beside them.

    Lines end at line feeds and compare without blanks at their ends; blank lines are always kept, as are the lines of
    hosts below `min_pages` pages and of pages without a host. A null text stays null with 0 lines; a page of nothing
    but boilerplate keeps an empty text. Columns named n_lines or n_dropped in the input are replaced. Repeated rows
    and ties need no rule: every row is decided alone. An empty table gives an empty result.
    """
    key, bad = field("boiler_host", docs), field("boiler_lines", docs)
    found = cut(boilerplate(docs, host, ratio, min_pages).select(F.col("host").alias(key), F.col("lines").alias(bad)), "boilerplate", "snappy")
    kept = [c for c in docs.columns if c.lower() not in ("n_lines", "n_dropped")]
    joined = docs.select(*[docs[c] for c in kept]).join(found, F.col(host) == F.col(key), "left")
    lines = _lines(F.col("text").cast("string"))
    clean = F.filter(lines, lambda x: (F.trim(x) == "") | ~F.array_contains(F.col(bad), F.xxhash64(F.trim(x))))
    clean = F.when(F.col(bad).isNull(), lines).otherwise(clean)
    before, after = field("boiler_before", docs), field("boiler_after", docs)
    return (
        joined.withColumn(before, F.coalesce(F.size(lines), F.lit(0)))
        .withColumn(after, clean)
        .select(
            *[F.when(F.col("text").isNull(), None).otherwise(F.array_join(after, "\n")).alias("text") if c == "text" else F.col(c) for c in kept],
            F.when(F.col("text").isNull(), 0).otherwise(F.col(before)).cast("long").alias("n_lines"),
            F.when(F.col("text").isNull(), 0).otherwise(F.col(before) - F.size(after)).cast("long").alias("n_dropped"),
        )
    )


def line_dedup(docs: DataFrame, host: str = "source", ratio: float = RATIO, min_pages: int = MIN_PAGES) -> DataFrame:
    """(doc_id, text, n_lines, n_dropped) of every document after its host's boilerplate is taken out."""
    return drop_boilerplate(docs, host, ratio, min_pages).select("doc_id", "text", "n_lines", "n_dropped")


def clean_sql(docs: str) -> str:
    """DuckDB SQL for `drop_boilerplate` over the relation `docs`: its columns with the cleaned text, n_lines and n_dropped."""
    return f"""
WITH d AS (SELECT * FROM {docs}),
total AS (SELECT source AS h, count(*) AS pages FROM d WHERE source IS NOT NULL GROUP BY 1),
seen AS (
  SELECT source AS h, unnest(list_distinct(list_transform(string_split(text, chr(10)), lambda x: trim(x)))) AS line
  FROM d WHERE source IS NOT NULL),
bad AS (
  SELECT h, list(line) AS lines
  FROM (SELECT h, line, count(*) AS n FROM seen WHERE line <> '' GROUP BY 1, 2 HAVING count(*) >= {MIN_PAGES})
  JOIN total USING (h) WHERE n::DOUBLE / pages > CAST({RATIO} AS DOUBLE) GROUP BY 1),
parts AS (
  SELECT d.*, string_split(text, chr(10)) AS ls,
    list_filter(string_split(text, chr(10)), lambda x: trim(x) = '' OR NOT coalesce(list_contains(bad.lines, trim(x)), false)) AS kept
  FROM d LEFT JOIN bad ON d.source = bad.h)
SELECT * EXCLUDE (text, ls, kept), array_to_string(kept, chr(10)) AS text,
  coalesce(len(ls), 0)::BIGINT AS n_lines, coalesce(len(ls) - len(kept), 0)::BIGINT AS n_dropped
FROM parts"""


ORACLE = f"SELECT doc_id, text, n_lines, n_dropped FROM ({clean_sql('documents')})"
