"""Line dedup by site-relative frequency, in DataFrame operations only.

A line is boilerplate of a site when it stands on more than ``ratio`` of the site's distinct pages
and on at least ``least`` of them. Pages with equal texts count once on both sides, so copies of a
page never make its lines boilerplate. All places of a boilerplate line are removed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sirenlens.session import materialize

#: Where on the given tables lines of a few sites (passages of near copies, chance) begin; see README.
RATIO = 0.005
#: Two pages with a line in common can be near copies: a site's template shows from the third page on.
LEAST = 3


def _lines(text: Column) -> Column:
    return F.split(text, "\n", -1)


def _digest(value: Column) -> Column:
    return F.unhex(F.md5(value))


def boilerplate(pages: DataFrame, ratio: float = RATIO, least: int = LEAST) -> DataFrame:
    """``(host, line)`` of all boilerplate, the line as its digest; ``pages`` has ``host, text``.

    Empty lines are no boilerplate. A null host is a site of its own; a null text has no lines.
    A site has at most (lines of its average page) / ``ratio`` such lines, whatever its size.
    """
    page = pages.where("text is not null").select("host", _digest(F.col("text")).alias("page"), "text")
    # counts of (line, page) and of (host, page) are merged on the map side, so no site or line is hot
    held = (
        page.select("host", "page", F.explode(F.array_distinct(_lines(F.col("text")))).alias("line"))
        .where("line <> ''")
        .select("host", _digest(F.col("line")).alias("line"), "page")
        .distinct()
        .groupBy("host", "line")
        .agg(F.count("*").alias("n"))
        .where(F.col("n") >= least)
    )
    total = page.select("host", "page").distinct().groupBy("host").agg(F.count("*").alias("pages"))
    same = held["host"].eqNullSafe(total["host"])
    return (
        held.join(total, same)
        .where(F.col("n") > F.lit(ratio) * F.col("pages"))
        .select(held["host"], "line", "n", "pages")
    )


def drop_boilerplate(
    pages: DataFrame, host: str, text: str = "text", ratio: float = RATIO, least: int = LEAST
) -> DataFrame:
    """``pages`` with boilerplate lines removed from ``text``; other columns stay.

    Adds (in place of columns of these names) ``n_lines`` (before) and ``n_dropped``. A text keeps its other lines, in order, repeated
    ones too; a page of nothing but boilerplate gets an empty text; null stays null with no lines.
    """
    found = boilerplate(pages.select(F.col(host).alias("host"), F.col(text).alias("text")), ratio, least)
    of_host = materialize(
        found.groupBy("host").agg(F.collect_list("line").alias("_ld_drop")).withColumnRenamed("host", "_ld_host"),
        "boilerplate",
    )
    # the table is a few lines for each site: Spark broadcasts it where its size allows, and else
    # splits a large site among tasks
    joined = pages.join(of_host, F.col(host).eqNullSafe(F.col("_ld_host")), "left")
    lines = _lines(F.col(text))
    kept = F.when(F.col("_ld_drop").isNull(), lines).otherwise(
        F.filter(lines, lambda x: ~F.array_contains(F.col("_ld_drop"), _digest(x)))
    )
    before = F.coalesce(F.size(lines), F.lit(0)).cast("long")
    out = joined.withColumn("_ld_kept", kept).withColumn(
        "n_lines", F.when(F.col(text).isNull(), 0).otherwise(before)
    )
    out = out.withColumn(
        "n_dropped",
        F.when(F.col(text).isNull(), 0).otherwise(F.col("n_lines") - F.size("_ld_kept")).cast("long"),
    )
    out = out.withColumn(text, F.array_join("_ld_kept", "\n"))
    added = ["n_lines", "n_dropped"]
    return out.select(*[c for c in pages.columns if c not in added], *added)


#: The same for ``documents`` with ``source`` as the site.
SQL = f"""
WITH page AS (SELECT DISTINCT source, text FROM documents WHERE text IS NOT NULL),
total AS (SELECT source, count(*) AS pages FROM page GROUP BY source),
held AS (
  SELECT source, line, count(*) AS n
  FROM (SELECT DISTINCT source, text, unnest(string_split(text, chr(10))) AS line FROM page)
  WHERE line <> '' GROUP BY source, line),
bad AS (
  SELECT h.source, list(h.line) AS lines
  FROM held h JOIN total t ON h.source IS NOT DISTINCT FROM t.source
  WHERE h.n >= {LEAST} AND h.n > CAST({RATIO} AS DOUBLE) * t.pages GROUP BY h.source),
cut AS (
  SELECT d.doc_id, d.text, string_split(d.text, chr(10)) AS lines,
    list_filter(string_split(d.text, chr(10)), lambda x: NOT list_contains(coalesce(b.lines, []), x)) AS kept
  FROM documents d LEFT JOIN bad b ON d.source IS NOT DISTINCT FROM b.source)
SELECT doc_id, CASE WHEN text IS NOT NULL THEN coalesce(array_to_string(kept, chr(10)), '') END AS text,
  CAST(CASE WHEN text IS NULL THEN 0 ELSE len(lines) END AS BIGINT) AS n_lines,
  CAST(CASE WHEN text IS NULL THEN 0 ELSE len(lines) - len(kept) END AS BIGINT) AS n_dropped
FROM cut
"""
