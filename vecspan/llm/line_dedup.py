"""Line dedup by site-relative frequency, in DataFrame functions only.

For each host, the pages that contain a line are divided by the host's pages; lines above the boilerplate
ratio are dropped from all of the host's pages. A line travels as its MD5 digest (16 bytes), and counting pre-aggregates
(host, digest) before its shuffle, so a hot host or line costs one row per task. A host can have at most (distinct lines
per page) / ratio such lines, so the drop lists stay short however many pages a host has. Pages meet the drop lists by
broadcast, or, beyond BROADCAST_BYTES of lists, by host and one of SALTS salts, each with its copy of the host's list.

A line must be in min_pages pages at least, the least that tells a repeat from chance; with min_pages=1 the ratio alone
decides.

Edge cases: a null host is no site and its pages stay as they are; a null text stays null with no lines; lines of
white space only are never dropped (they carry layout); a line that repeats in one page counts once there;
a line at the ratio exactly stays; hosts or lines below min_pages stay whole; texts and lines of any length are taken whole; repeated
rows count as pages of their own; empty tables give empty results; other columns pass through, but for columns named like those that
line_dedup() adds, in any case of letters, which these replace.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vecspan.llm.common import Stash, table

#: Up to this many bytes of drop lists (or host totals) are broadcast; beyond it the join is shuffled.
BROADCAST_BYTES = 16 << 20
SALTS = 32

DROP = "__vs_drop"
HOST = "__vs_host"
SALT = "__vs_salt"


def _lines(text: Column) -> Column:
    return F.split(text, "\n", -1)


def _digest(line: Column) -> Column:
    return F.unhex(F.md5(line))


def _sized(df: DataFrame, bytes_expr: Column) -> DataFrame:
    """df with a broadcast hint if its measured size allows."""
    size = df.agg(F.sum(bytes_expr)).first()[0] or 0
    return F.broadcast(df) if size <= BROADCAST_BYTES else df


def _pages(docs: DataFrame, host_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(host_col).cast("string").alias("host"), F.col(text_col).alias("text")).where(F.col("host").isNotNull())


def _page_lines(pages: DataFrame) -> DataFrame:
    """host, line: the distinct lines of every page that are not blank."""
    lines = pages.where("text is not null").select("host", F.explode(F.array_distinct(_lines(F.col("text")))).alias("line"))
    return lines.where(F.col("line").rlike(r"[^\x20\x09-\x0D]"))


def boilerplate_digests(docs: DataFrame, ratio: float = 0.1, min_pages: int = 3, host_col: str = "source", text_col: str = "text", stash: Stash | None = None) -> DataFrame:
    """host, digest, n_pages, host_pages of every line in more than ratio of its host's pages (and min_pages at least)."""
    stash = stash or Stash(docs.sparkSession)
    pages = _pages(docs, host_col, text_col)
    totals = stash.cut(pages.groupBy("host").agg(F.count("*").alias("host_pages")).where(F.col("host_pages") >= min_pages), "hosts")
    counts = _page_lines(pages).groupBy("host", _digest(F.col("line")).alias("digest")).agg(F.count("*").alias("n_pages")).where(F.col("n_pages") >= min_pages)
    return counts.join(_sized(totals, F.length("host") + 16), "host").where(F.col("n_pages") > F.lit(ratio) * F.col("host_pages"))


def boilerplate(docs: DataFrame, ratio: float = 0.1, min_pages: int = 3, host_col: str = "source", text_col: str = "text") -> DataFrame:
    """The lines themselves: host, line, n_pages, host_pages."""
    stash = Stash(docs.sparkSession)
    found = stash.cut(boilerplate_digests(docs, ratio, min_pages, host_col, text_col, stash), "digests")
    lines = _page_lines(_pages(docs, host_col, text_col)).withColumn("digest", _digest(F.col("line")))
    joined = lines.join(_sized(found, F.length("host") + 40), ["host", "digest"])
    return joined.groupBy("host", "digest", "n_pages", "host_pages").agg(F.min("line").alias("line")).select("host", "line", "n_pages", "host_pages")


def _with_drops(docs: DataFrame, ratio: float, min_pages: int, host_col: str, text_col: str) -> DataFrame:
    """docs plus DROP, the digests of the lines to cut (null: none)."""
    stash = Stash(docs.sparkSession)
    lines = stash.cut(boilerplate_digests(docs, ratio, min_pages, host_col, text_col, stash).select("host", "digest"), "drops")
    drops = lines.groupBy(F.col("host").alias(HOST)).agg(F.sort_array(F.collect_list("digest")).alias(DROP))
    same = docs[host_col].cast("string") == F.col(HOST)
    size = lines.agg(F.sum(F.length("host") + 48)).first()[0] or 0
    if size <= BROADCAST_BYTES:
        return docs.join(F.broadcast(drops), same, "left")
    drops = drops.withColumn(SALT, F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return docs.join(drops, same & (F.pmod(F.xxhash64(docs[text_col]), F.lit(SALTS)) == F.col(SALT)), "left")


def _kept(text_col: str) -> Column:
    return F.filter(_lines(F.col(text_col)), lambda x: ~F.array_contains(F.col(DROP), _digest(x)))


def _cut(columns: list[str], text_col: str) -> list[Column]:
    text = F.when(F.col(DROP).isNull(), F.col(text_col)).otherwise(F.array_join(_kept(text_col), "\n"))
    return [text.alias(c) if c == text_col else F.col(f"`{c}`") for c in columns]


def keep_lines(docs: DataFrame, ratio: float = 0.1, min_pages: int = 3, host_col: str = "source", text_col: str = "text") -> DataFrame:
    """docs with the boilerplate lines cut from text and all other columns as they are."""
    return _with_drops(docs, ratio, min_pages, host_col, text_col).select(*_cut(docs.columns, text_col))


def line_dedup(docs: DataFrame, ratio: float = 0.1, min_pages: int = 3, host_col: str = "source", text_col: str = "text") -> DataFrame:
    """keep_lines() plus n_lines and n_dropped (which replace columns of these names)."""
    joined = _with_drops(docs, ratio, min_pages, host_col, text_col)
    parts = _lines(F.col(text_col))
    return joined.select(
        *_cut([c for c in docs.columns if c.lower() not in ("n_lines", "n_dropped")], text_col),
        F.coalesce(F.size(parts), F.lit(0)).cast("long").alias("n_lines"),
        F.when(F.col(DROP).isNull() | F.col(text_col).isNull(), F.lit(0)).otherwise(F.size(parts) - F.size(_kept(text_col))).cast("long").alias("n_dropped"),
    )


def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    out = line_dedup(docs)
    return out.select("doc_id", "source", "n_lines", "n_dropped", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


OP10_SQL = r"""
WITH pages AS (SELECT doc_id, source, coalesce(text, '') AS text, text IS NULL AS gone FROM documents),
parts AS (SELECT doc_id, source, text, gone, string_split(text, chr(10)) AS ls FROM pages),
totals AS (SELECT source, count(*) AS host_pages FROM pages WHERE source IS NOT NULL GROUP BY source),
counts AS (
  SELECT source, line, count(*) AS n_pages
  FROM (SELECT source, unnest(list_distinct(ls)) AS line FROM parts WHERE source IS NOT NULL AND NOT gone)
  WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY source, line),
drops AS (
  SELECT source, list(line) AS gone_lines FROM counts JOIN totals USING (source)
  WHERE n_pages >= 3 AND host_pages >= 3 AND n_pages > 0.1 * host_pages GROUP BY source),
kept AS (
  SELECT p.doc_id, p.source, p.gone, p.text, p.ls, d.gone_lines,
         CASE WHEN d.gone_lines IS NULL THEN p.ls ELSE list_filter(p.ls, lambda x: NOT list_contains(d.gone_lines, x)) END AS ks
  FROM parts p LEFT JOIN drops d ON p.source = d.source)
SELECT doc_id, source, CASE WHEN gone THEN 0 ELSE len(ls) END::BIGINT AS n_lines,
       CASE WHEN gone THEN 0 ELSE len(ls) - len(ks) END::BIGINT AS n_dropped,
       sha256(CASE WHEN gone THEN '' WHEN gone_lines IS NULL THEN text ELSE array_to_string(ks, chr(10)) END) AS kept_sha256
FROM kept
"""
