"""Line dedup by site-relative frequency: lines that stand on most pages of a host are boilerplate."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .tables import Scratch

#: Turned into line breaks, as Java and RE2 patterns alike.
HIDDEN = r"(?is)<script\b[^<>]*>.*?</script>|<style\b[^<>]*>.*?</style>|<!--.*?-->"
BLOCK = r"(?i)</?(p|div|li|ul|ol|h[1-6]|nav|header|footer|article|aside|section|main|form|table|tr|td|title|br)\b[^<>]*>"
#: Tags begin with a letter, / or !; any other < is text. No tag goes over a line break put in for the above,
#: which the control character 1 marks; it is dropped from texts.
TAG = r"</?[a-zA-Z][^<>\x01]*>|<![^<>\x01]*>|\x01"
HOST = r"(?i)^[a-z][a-z0-9+.-]*://([^/?#]*)"


def host(url: str) -> Column:
    """The lower-cased host and port of a URL; '' where there is none."""
    return F.lower(F.regexp_extract(F.coalesce(F.col(url), F.lit("")), HOST, 1))


def page_lines(html: str) -> Column:
    """The page's lines in order: text between block tags or newlines, trimmed of blanks, not empty."""
    text = F.regexp_replace(F.regexp_replace(F.regexp_replace(F.coalesce(F.col(html), F.lit("")), HIDDEN, "\x01\n"), BLOCK, "\x01\n"), TAG, "")
    return F.filter(F.transform(F.split(text, "\n"), lambda x: F.trim(x)), lambda x: x != "")


def frequent_lines(pages: DataFrame, ratio: float, least: int) -> DataFrame:
    """(host, n_pages, drop): pages of each host, and hashes of its lines on more than `ratio` of at least
    `least` pages. Per host these are at most its mean number of lines a page / ratio."""
    lines = pages.select("host", F.explode(F.array_distinct(F.transform("lines", lambda x: F.xxhash64(x)))).alias("line"))
    counts = lines.groupBy("host", "line").agg(F.count("*").alias("n"))
    totals = pages.groupBy("host").agg(F.count("*").alias("n_pages"))
    often = counts.where(F.col("n") >= least).join(totals.where(F.col("n_pages") >= least), "host").where(F.col("n") > ratio * F.col("n_pages"))
    drops = often.groupBy("host").agg(F.collect_list("line").alias("drop"))
    return totals.join(drops, "host", "left")


def line_dedup(pages: DataFrame, ratio: float = 0.5, least: int = 2) -> DataFrame:
    """One row per input row of pages(page_id, url, html): page_id, host, host_pages, n_lines, n_removed,
    kept_text.

    A line goes if it stands on more than `ratio` of the pages of its host, and on `least` pages at
    least (2, as all lines of a host's only page stand on all of its pages); a page counts once however
    often it has the line. Lines are compared as trimmed text by a 64-bit hash. Pages are read whole
    however long. A < that begins no tag is text. The rest keeps its order, joined by newlines. A null url or one without a host has the
    host ''; null or empty html has no lines, but counts as a page; a line at exactly the ratio stays;
    repeated rows are pages of their own; other columns are ignored; an empty table gives none."""
    pages = pages.select(F.col("page_id").cast("long").alias("page_id"), host("url").alias("host"), page_lines("html").alias("lines"))
    # Written, so that Spark joins a table of known size: it broadcasts it, or splits the pages of a hot host.
    marks = Scratch(pages.sparkSession).cut(frequent_lines(pages, ratio, least)).withColumnRenamed("host", "host_")
    rows = pages.join(marks, F.col("host") == F.col("host_"))
    drop = F.coalesce("drop", F.array().cast("array<long>"))
    rows = rows.withColumn("kept", F.filter("lines", lambda x: ~F.array_contains(drop, F.xxhash64(x))))
    return rows.select("page_id", "host", F.col("n_pages").alias("host_pages"), F.size("lines").cast("long").alias("n_lines"), (F.size("lines") - F.size("kept")).cast("long").alias("n_removed"), F.array_join("kept", "\n").alias("kept_text"))


ORACLE = rf"""
with pages_ as (
  select row_number() over () as r, page_id, lower(regexp_extract(coalesce(url, ''), '{HOST}', 1)) as host,
    list_filter(list_transform(string_split(regexp_replace(regexp_replace(regexp_replace(coalesce(html, ''), '{HIDDEN}', chr(1) || chr(10), 'g'), '{BLOCK}', chr(1) || chr(10), 'g'), '{TAG}', '', 'g'), chr(10)), lambda x: trim(x, ' ')), lambda x: x <> '') as lines
  from pages
), totals as (select host, count(*) as n_pages from pages_ group by host),
lines_ as (select r, host, unnest(list_distinct(lines)) as line from pages_),
often as (
  select host, line from (select host, line, count(*) as n from lines_ group by host, line) join totals using (host)
  where n >= 2 and n > 0.5 * n_pages
), parts as (
  select p.r, u.i, u.line, o.line is null as stays
  from pages_ p, unnest(list_zip(p.lines, range(1, len(p.lines) + 1))) as z(x), (select x[1] as line, x[2] as i) u
  left join often o on o.host = p.host and o.line = u.line
), merged as (
  select r, count(*) as n_lines, count(*) filter (not stays) as n_removed, string_agg(line, chr(10) order by i) filter (stays) as kept_text from parts group by r
)
select page_id, p.host, n_pages as host_pages, coalesce(n_lines, 0) as n_lines, coalesce(n_removed, 0) as n_removed, coalesce(kept_text, '') as kept_text
from pages_ p join totals using (host) left join merged using (r)
"""
