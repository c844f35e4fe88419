"""Line deduplication by site-relative frequency.

The pages that hold a line are divided by the pages of their host; lines above a ratio are boilerplate and are dropped. The
lines above a ratio r of a host's pages number at most (mean distinct lines of a page) / r, so a host's list of them is small
however many pages it has, and one row a host is joined to the pages. Counting has partial sums, so a line that a third of all
pages hold costs one row a task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .store import left_join_small, without

#: What is taken out of a page before its lines are read, and what parts them. The patterns mean the same to Java and RE2.
HIDDEN = r"(?is)<script.*?</script>|<style.*?</style>|<!--.*?-->"
PARTS = r"<[^>]*>|\n"
EDGES = r"^[ \t\r]+|[ \t\r]+$"
HOST = r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)"


def host_of(url: str | Column) -> Column:
    """The lower-cased host of an address, with its port; null without one."""
    return F.nullif(F.lower(F.regexp_extract(url, HOST, 1)), F.lit(""))


def html_lines(html: str | Column) -> Column:
    """The texts between tags and line ends, trimmed of blanks, without empty ones. Null has none."""
    parts = F.split(F.regexp_replace(F.coalesce(html, F.lit("")), HIDDEN, ""), PARTS)
    return F.filter(F.transform(parts, lambda x: F.regexp_replace(x, EDGES, "")), lambda x: x != "")


def _digest(line: Column) -> Column:
    return F.struct(F.xxhash64(line).alias("a"), F.hash(line).alias("b"))


def drop_site_lines(pages: DataFrame, lines: Column, host: Column, ratio: float = 0.2, min_pages: int = 5) -> DataFrame:
    """Every row of pages with host, n_lines, n_dropped and text, the lines that stay joined by line ends.

    A line is dropped if it is on more than ratio of its host's pages, and the host has min_pages pages at least. It counts
    once a page however often the page repeats it, and goes wherever it stands. Pages without a host keep their lines;
    pages without lines have an empty text; repeated rows are pages of their own; columns of pages whose names clash with
    an added one are replaced. Lines are compared by a hash of 96 bits within their host.
    """
    columns = without(pages, "host", "n_lines", "n_dropped", "text").columns
    rows = pages.select(F.struct(*(F.col(f"`{c}`") for c in columns)).alias("_own"), host.alias("_host"), lines.alias("_lines"))
    seen = rows.where(F.col("_host").isNotNull()).select("_host", F.explode(F.array_distinct(F.transform("_lines", _digest))).alias("_line"))
    on = seen.groupBy("_host", "_line").agg(F.count("*").alias("_on")).where(F.col("_on") > 1)
    total = rows.where(F.col("_host").isNotNull()).groupBy("_host").agg(F.count("*").alias("_pages")).where(F.col("_pages") >= min_pages)
    common = on.join(total, "_host").where(F.col("_on") > F.lit(ratio) * F.col("_pages")).groupBy("_host").agg(F.collect_list("_line").alias("_common"))
    kept = F.when(F.col("_common").isNull(), F.col("_lines")).otherwise(F.filter("_lines", lambda x: ~F.array_contains("_common", _digest(x))))
    out = left_join_small(rows, common.withColumnRenamed("_host", "_of"), "_host", "_of").withColumn("_kept", kept)
    return out.select(
        *(F.col("_own")[c].alias(c) for c in columns),
        F.col("_host").alias("host"), F.size("_lines").cast("long").alias("n_lines"), (F.size("_lines") - F.size("_kept")).cast("long").alias("n_dropped"), F.array_join("_kept", "\n").alias("text"),
    )
