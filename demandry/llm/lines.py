"""Boilerplate lines by their site-relative frequency, in DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import BROADCAST_ROWS

#: A line is boilerplate on a host if more than this share of its pages has it, on this many pages at least (so that a
#: host of a few pages has none).
RATIO, MIN_PAGES = 0.01, 5
#: Ignored at both ends of a line.
BLANK = " \t\r"


def _key(line: Column) -> Column:
    """128 bits for a line without the blanks around it."""
    line = F.btrim(line, F.lit(BLANK))
    return F.struct(F.xxhash64(line).alias("a"), F.xxhash64(F.lit("line"), line).alias("b"))


def boilerplate(docs: DataFrame, host_col: str, text_col: str, ratio: float, min_pages: int) -> DataFrame:
    """(host, key, pages, total): the lines above the ratio. A page counts once however often it repeats a line."""
    split = F.split(F.col(text_col), "\n")
    pages = docs.select(F.col(host_col).alias("host"), F.array_distinct(F.transform(F.filter(split, lambda x: F.btrim(x, F.lit(BLANK)) != ""), _key)).alias("keys"))
    totals = pages.groupBy("host").agg(F.count("*").alias("total"))
    counted = pages.select("host", F.explode("keys").alias("key")).groupBy("host", "key").agg(F.count("*").alias("pages")).where(F.col("pages") >= min_pages)
    joined = counted.alias("c").join(totals.alias("t"), F.col("c.host").eqNullSafe(F.col("t.host")))
    return joined.where(F.col("pages") > ratio * F.col("total")).select("c.host", "key", "pages", "total")


def drop_boilerplate(docs: DataFrame, host_col: str = "source", text_col: str = "text", ratio: float = RATIO, min_pages: int = MIN_PAGES, keep_whole: bool = False, broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """docs with its boilerplate lines dropped from the text, and n_lines and n_dropped (both longs).

    Pages are grouped by host (null is a host of its own); a line goes where more than `ratio` of the host's pages, and
    at least `min_pages` of them, contain it. Blank lines neither count nor go. With keep_whole, a page of which every
    line would go is taken for a copy of other pages rather than a page with boilerplate, and stays whole. A null text
    stays null with 0 lines; repeated rows are pages of their own; other columns pass through, whatever their names, but
    n_lines and n_dropped are replaced.

    Lines are counted as 128-bit keys after partial aggregation. A host has at most (lines of a mean page) / ratio
    boilerplate lines; their table is broadcast if counted to be small, else joined by host, where Spark splits a
    skewed host. Of a host's lines only those are compared with a page's in full that share a hash with it.
    """
    found = boilerplate(docs, host_col, text_col, ratio, min_pages).checkpoint()
    by_host = found.groupBy(F.col("host").alias("of")).agg(F.collect_set("key").alias("drop"), F.collect_set("key.a").alias("hashes"))
    if found.count() <= broadcast_rows:
        by_host = F.broadcast(by_host)
    kept = [c for c in docs.columns if c not in ("n_lines", "n_dropped")]
    own = docs.select(F.struct(*[F.col(f"`{c}`") for c in kept]).alias("row"), F.col(host_col).alias("host"), F.split(F.col(text_col), "\n").alias("lines"))
    own = own.join(by_host, F.col("host").eqNullSafe(F.col("of")), "left")
    blank = lambda x: F.btrim(x, F.lit(BLANK)) == ""
    shared = F.array_intersect(F.transform("lines", lambda x: _key(x)["a"]), F.col("hashes"))
    own = own.withColumn("shared", F.coalesce(shared, F.array().cast("array<bigint>")))
    own = own.withColumn("mine", F.when(F.size("shared") > 0, F.filter("drop", lambda k: F.array_contains(F.col("shared"), k["a"]))))
    own = own.withColumn("left", F.when(F.col("mine").isNull(), F.col("lines")).otherwise(F.filter("lines", lambda x: blank(x) | ~F.array_contains(F.col("mine"), _key(x)))))
    real = lambda lines: F.coalesce(F.size(F.filter(F.when(F.col("lines").isNotNull(), F.col(lines)), lambda x: ~blank(x))).cast("long"), F.lit(0).cast("long"))
    own = own.withColumn("n_lines", F.when(F.col("lines").isNull(), F.lit(0).cast("long")).otherwise(real("lines"))).withColumn("n_left", F.when(F.col("lines").isNull(), F.lit(0).cast("long")).otherwise(real("left")))
    same = F.col("n_left") == F.col("n_lines")
    same = (same | (F.col("n_left") == 0)) if keep_whole else same
    text = F.when(same, F.col("row")[text_col]).otherwise(F.array_join("left", "\n"))
    dropped = F.when(same, F.lit(0).cast("long")).otherwise(F.col("n_lines") - F.col("n_left"))
    return own.select(*[(text if c == text_col else F.col("row")[c]).alias(c) for c in kept], "n_lines", dropped.alias("n_dropped"))


def op3_line_dedup(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return drop_boilerplate(docs.select("doc_id", "source", "text")).select("doc_id", "source", "text", "n_lines", "n_dropped")


OP3_SQL = f"""
with page as (
  select row_number() over () as rid, doc_id, source, text, string_split(text, chr(10)) as lines from documents
), total as (
  select source, count(*) as total from page group by source
), line as (
  select rid, source, unnest(list_distinct(list_transform(lines, lambda x: trim(x, chr(32) || chr(9) || chr(13))))) as line from page
), often as (
  select l.source, l.line from line l join total t on l.source is not distinct from t.source
  where l.line <> '' group by l.source, l.line, t.total having count(*) >= {MIN_PAGES} and count(*) > {RATIO} * t.total
), dropped as (
  select source, list(line) as lines from often group by source
), cut as (
  select p.doc_id, p.source, p.text,
    list_filter(p.lines, lambda x: trim(x, chr(32) || chr(9) || chr(13)) <> '') as real,
    list_filter(p.lines, lambda x: d.lines is null or not list_contains(d.lines, trim(x, chr(32) || chr(9) || chr(13)))) as kept
  from page p left join dropped d on p.source is not distinct from d.source
), counted as (
  select *, coalesce(len(real), 0) as n_lines,
    coalesce(len(list_filter(kept, lambda x: trim(x, chr(32) || chr(9) || chr(13)) <> '')), 0) as n_left from cut
)
select doc_id, source,
  case when n_left = n_lines then text else array_to_string(kept, chr(10)) end as text,
  cast(n_lines as bigint) as n_lines,
  cast(n_lines - n_left as bigint) as n_dropped
from counted
"""
