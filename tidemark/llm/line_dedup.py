"""Line dedup by site-relative frequency (DataFrame functions only).

The visible lines of a page end at block tags and line breaks. For each host,
the pages that contain a line are divided by the host's pages, and lines on
more than ``ratio`` of them (and on ``min_pages`` pages at least, so that hosts
of one or two pages keep what they have) are boilerplate and dropped.

Lines are counted once a page by 128 bits of their hashes, in part before the
shuffle, so no text moves for the counts, and neither a host with a third of all
pages nor a line on every page gathers in a task. A host has at most its mean
number of lines a page divided by ``ratio`` boilerplate lines, whatever its
pages, so their hashes travel as one list a host. A host with more than one in
``SALTS`` of all pages is hot; there are fewer than ``SALTS`` of these. Their
pages are dealt out by a salt to meet as many copies of the list, and their
counts are compared with the host's pages where they are, so that no task gets
more than about one in ``SALTS`` of all rows for a host.

Defined results: null HTML has no lines; a URL without a host, or null, belongs
to the host ''; repeated rows are pages of their own; an empty table gives an
empty result; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import stored, work_dir

# What is no text, and what ends a line.
HIDDEN = [r"(?is)<script\b.*?</script>", r"(?is)<style\b.*?</style>", r"(?s)<!--.*?-->"]
LINE_END = r"(?i)<(/p|br|/li|/div|/h[1-6]|/title|/td|/tr|/nav|/footer|/header|/section|/article|p|li|div)\b[^>]*>"
#: Into how many parts the pages of a hot host are dealt; a power of two.
SALTS = 256


def host_of(url: Column) -> Column:
    return F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://([^/:?#]+)", 1))


def visible_lines(html: Column) -> Column:
    out = F.coalesce(html, F.lit(""))
    for pattern in HIDDEN:
        out = F.regexp_replace(out, pattern, " ")
    out = F.regexp_replace(F.regexp_replace(out, LINE_END, "\n"), r"<[^>]*>", " ")
    out = F.regexp_replace(out, r"[ \t\r\f]+", " ")
    return F.filter(F.transform(F.split(out, "\n"), lambda x: F.trim(x)), lambda x: x != "")


def _hashes(line: Column) -> Column:
    return F.struct(F.xxhash64(line).alias("a"), F.xxhash64(F.lit(1), line).alias("b"))


def drop_boilerplate(
    pages: DataFrame, ratio: float = 0.5, min_pages: int = 3, id_col: str = "page_id", url_col: str = "url", html_col: str = "html"
) -> DataFrame:
    """One row per page: id, host, lines and kept (arrays in order)."""
    spark = pages.sparkSession
    work = work_dir(spark, "line-dedup")
    rows = pages.select(F.col(id_col).alias("id"), host_of(F.col(url_col)).alias("host"), F.col(html_col).alias("html"))
    totals = stored(rows.groupBy("host").agg(F.count(F.lit(1)).alias("n_pages")), f"{work}/hosts")
    every = totals.agg(F.sum("n_pages").alias("n")).first().n or 0
    # fewer than SALTS rows, whatever the input
    hot = F.broadcast(totals.where(F.col("n_pages") * SALTS > every).withColumnRenamed("n_pages", "hot_pages"))

    lines = rows.select("host", F.explode(F.array_distinct(F.transform(visible_lines(F.col("html")), _hashes))).alias("line"))
    often = lines.groupBy("host", "line").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= min_pages)
    often = often.join(hot, "host", "left").where(F.col("hot_pages").isNull() | (F.col("n") > ratio * F.col("hot_pages"))).drop("hot_pages")
    common = often.join(totals, "host").where(F.col("n") > ratio * F.col("n_pages"))
    boilerplate = stored(common.groupBy("host").agg(F.collect_list("line").alias("dropped")), f"{work}/boilerplate")

    is_hot = F.col("hot_pages").isNotNull()
    copies = F.explode(F.when(is_hot, F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0))))
    lists = boilerplate.join(hot, "host", "left").select("host", copies.alias("salt"), "dropped")
    dealt = rows.join(hot, "host", "left").withColumn("salt", F.when(is_hot, F.pmod(F.monotonically_increasing_id(), F.lit(SALTS))).otherwise(0).cast("int"))
    marked = dealt.select("id", "host", "salt", visible_lines(F.col("html")).alias("lines")).join(lists, ["host", "salt"], "left")
    kept = F.when(F.col("dropped").isNull(), F.col("lines")).otherwise(F.filter("lines", lambda x: ~F.array_contains("dropped", _hashes(x))))
    return marked.select(F.col("id").alias(id_col), "host", "lines", kept.alias("kept"))
