"""Line dedup by site-relative frequency."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import unused, written

#: Boilerplate lines up to this number are sent to every executor; more are joined by a shuffle.
BROADCAST_LINES = 200_000


def _line_key(line: Column) -> Column:
    bare = F.trim(line)
    return F.struct(F.xxhash64(bare).alias("x"), F.xxhash64(F.lit(1), bare).alias("y"))


def boilerplate_lines(pages: DataFrame, *, host: str = "host", text: str = "text", ratio: float = 0.3, min_line_pages: int = 2, copies_once: bool = False) -> DataFrame:
    """(host, line key struct, pages, host_pages) of every line on more than ``ratio`` of its host's pages.

    A page counts once for a line. Lines on fewer than ``min_line_pages`` pages repeat nothing and are not judged, so
    a host of one page keeps its text. With ``copies_once`` a host's pages of equal text count as one page, for its
    lines and for its total alike. Counts are added up before the shuffle, which carries 16-byte line keys, not lines;
    so are copies.
    """
    whole = F.coalesce(F.col(text), F.lit(""))
    keys = F.array_distinct(F.transform(F.filter(F.split(whole, "\n"), lambda x: F.trim(x) != ""), _line_key))
    page = pages.where(F.col(host).isNotNull()).select(F.col(host).alias("host"), F.xxhash64(whole).alias("x"), F.xxhash64(F.lit(1), whole).alias("y"), keys.alias("keys"))
    counted, listed = page.select("host", "x", "y"), page
    if copies_once:
        counted, listed = counted.distinct(), listed.distinct()
    counts = listed.select("host", F.explode("keys").alias("line")).groupBy("host", "line").agg(F.count("*").alias("pages")).where(F.col("pages") >= min_line_pages)
    totals = counted.groupBy("host").agg(F.count("*").alias("host_pages"))
    return counts.join(totals, "host").where(F.col("pages") > F.col("host_pages") * F.lit(float(ratio)))


def drop_boilerplate(pages: DataFrame, *, host: str = "host", text: str = "text", ratio: float = 0.3, min_line_pages: int = 2, copies_once: bool = False, dropped: str | None = None) -> DataFrame:
    """The pages with boilerplate lines taken out of ``text``; with ``dropped``, a column of that name counts them (a
    column of pages with this name is left out).

    Lines are compared without white space at their ends; blank lines stay. Null texts stay null, pages with a null
    host stay as they are, a repeated row is a page of its own (unless ``copies_once``), other columns pass through
    whatever their names, and an empty table gives an empty result. A line at exactly the ratio stays. A page whose
    lines all go keeps its row, with an empty text. Pages of any length are taken whole.

    A host has at most (mean distinct lines of its pages) / ratio boilerplate lines, so its list is short however
    many pages it has; a page meets its host's list as two sets of 64-bit hashes, of which only the common ones are
    looked up line by line. Lists go to every executor while they hold BROADCAST_LINES lines at most; beyond, pages
    meet their list by a join on the host, whose hot keys Spark splits.
    """
    pages = pages.drop(dropped) if dropped else pages
    key, lines, kept = unused(pages.columns, "_host", "_lines", "_kept")
    found = written(boilerplate_lines(pages, host=host, text=text, ratio=ratio, min_line_pages=min_line_pages, copies_once=copies_once).select("host", F.col("line.x").alias("x")))
    small = found.count() <= BROADCAST_LINES
    lists = found.groupBy(F.col("host").alias(key)).agg(F.collect_set("x").alias(lines))
    joined = pages.join(F.broadcast(lists) if small else lists, F.col(host) == F.col(key), "left")
    parts = F.split(F.col(text), "\n")
    mine = F.array_intersect(F.transform(parts, lambda x: F.xxhash64(F.trim(x))), F.col(lines))
    out = joined.withColumn(lines, F.when(F.col(lines).isNotNull() & F.col(text).isNotNull(), mine))
    out = out.withColumn(kept, F.when(F.size(lines) > 0, F.filter(parts, lambda x: (F.trim(x) == "") | ~F.array_contains(F.col(lines), F.xxhash64(F.trim(x))))))
    columns = [F.when(F.col(kept).isNotNull(), F.array_join(kept, "\n")).otherwise(F.col(text)).alias(text) if c == text else F.col(c) for c in pages.columns]
    if dropped:
        columns.append(F.coalesce(F.size(parts) - F.size(kept), F.lit(0)).cast("long").alias(dropped))
    return out.select(*columns)


def page_lines(html: Column) -> Column:
    """Text of a page, a line for each stretch between tags; scripts, styles and comments go."""
    bare = F.regexp_replace(F.coalesce(html, F.lit("")), r"(?s)<script.*?</script>|<style.*?</style>|<!--.*?-->", "")
    return F.regexp_replace(F.regexp_replace(bare, r"<[^>]*>", "\n"), r"\n+", "\n")


def page_host(url: Column) -> Column:
    host = F.lower(F.regexp_extract(url, r"^[A-Za-z]+://([^/?#:]+)", 1))
    return F.when(host != "", host)


def line_report(pages: DataFrame) -> DataFrame:
    """page_id, host, n_lines, n_dropped and the MD5 of the kept text of every page. The pages' lines are written once, as
    both passes read them."""
    text = written(pages.select("page_id", page_host(F.col("url")).alias("host"), page_lines(F.col("html")).alias("text")))
    lines = text.withColumn("n_lines", F.size(F.split("text", "\n")).cast("long"))
    return drop_boilerplate(lines, dropped="n_dropped").select("page_id", "host", "n_lines", "n_dropped", F.md5(F.col("text").cast("binary")).alias("kept_md5"))


LINE_SQL = r"""
WITH p AS (
  SELECT page_id, nullif(lower(regexp_extract(url, '^[A-Za-z]+://([^/?#:]+)', 1)), '') AS host,
    string_split(regexp_replace(regexp_replace(regexp_replace(coalesce(html, ''), '(?s)<script.*?</script>|<style.*?</style>|<!--.*?-->', '', 'g'), '<[^>]*>', chr(10), 'g'), '\n+', chr(10), 'g'), chr(10)) AS parts
  FROM pages
), lines AS (
  SELECT page_id, host, unnest(list_distinct(list_transform(list_filter(parts, lambda x: trim(x, ' ') <> ''), lambda x: trim(x, ' ')))) AS line FROM p WHERE host IS NOT NULL
), hosts AS (SELECT host, count(*) AS host_pages FROM p WHERE host IS NOT NULL GROUP BY host),
boiler AS (
  SELECT host, list(line) AS lines FROM (
    SELECT host, line FROM lines JOIN hosts USING (host) GROUP BY host, line, host_pages HAVING count(*) >= 2 AND count(*) > host_pages * 0.3::DOUBLE
  ) GROUP BY host
), kept AS (
  SELECT page_id, p.host, parts, CASE WHEN lines IS NULL THEN parts ELSE list_filter(parts, lambda x: trim(x, ' ') = '' OR NOT list_contains(lines, trim(x, ' '))) END AS keep
  FROM p LEFT JOIN boiler ON p.host = boiler.host
)
SELECT page_id, host, len(parts)::BIGINT AS n_lines, (len(parts) - len(keep))::BIGINT AS n_dropped, md5(array_to_string(keep, chr(10))) AS kept_md5 FROM kept
"""
