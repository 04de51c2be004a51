"""Line dedup by site-relative frequency; DataFrame functions only.

A line is boilerplate of a host when the share of the host's pages that hold it exceeds a ratio. Lines are counted by a
strong digest, so texts don't move; the lines found are few (at most pages' mean number of lines over the ratio, per host).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from evispan.llm.common import free_names
from evispan.session import materialize_plain as materialize

RATIO, LEAST_PAGES = 0.1, 5

# ASCII white space around a line doesn't count.
BLANKS = " \t\n\x0b\x0c\r"


def host_of(url: Column) -> Column:
    """Lower-case host of a URL without user and port; null if there is none."""
    found = F.regexp_extract(F.lower(url), r"^[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1)
    return F.when(found != "", found)


def line_key(line: Column) -> Column:
    return F.btrim(line, F.lit(BLANKS))


def line_digests(text: Column) -> Column:
    """Distinct digests of a text's lines that aren't blank."""
    keys = F.transform(F.split(text, "\n"), line_key)
    return F.transform(F.array_distinct(F.filter(keys, lambda k: k != "")), lambda k: F.unhex(F.md5(k)))


def distinct_pages(pages: DataFrame) -> DataFrame:
    """``host, lines`` once per distinct text of a host (by a strong digest, so texts don't move); null is no text."""
    page = F.unhex(F.md5(F.col("text").cast("binary"))).alias("page")
    known = pages.where("host IS NOT NULL AND text IS NOT NULL").select("host", page, line_digests(F.col("text")).alias("lines"))
    return known.groupBy("host", "page").agg(F.first("lines").alias("lines")).select("host", "lines")


def boilerplate(pages: DataFrame, ratio: float = RATIO, least_pages: int = LEAST_PAGES, copies_once: bool = False) -> DataFrame:
    """``host, lines array<binary>`` of ``host, text`` rows: digests of the lines to drop. Written once."""
    if copies_once:
        known = materialize(distinct_pages(pages), "distinct-pages")
    else:
        known = pages.where("host IS NOT NULL").select("host", line_digests(F.col("text")).alias("lines"))
    totals = known.groupBy("host").agg(F.count(F.lit(1)).alias("pages"))
    counts = (
        known.select("host", F.explode("lines").alias("line"))
        .groupBy("host", "line")
        .agg(F.count(F.lit(1)).alias("n"))
        .where(F.col("n") >= least_pages)
    )
    found = counts.join(totals, "host").where(F.col("n") > ratio * F.col("pages"))
    return materialize(found.groupBy("host").agg(F.collect_set("line").alias("lines")), "boilerplate")


def line_dedup(
    docs: DataFrame,
    host: Column,
    text_col: str = "text",
    ratio: float = RATIO,
    least_pages: int = LEAST_PAGES,
    dropped: str = "n_dropped",
    copies_once: bool = False,
) -> DataFrame:
    """``docs`` with the boilerplate lines of their host cut out of the text, and a count ``dropped``.

    A line goes if more than ``ratio`` of its host's pages hold it, and at least ``least_pages`` do; every occurrence in
    the host's pages goes. Lines are compared without the white space around them, exactly otherwise; blank lines stay.
    Each row is a page, repeated rows too; with ``copies_once`` each distinct text of a host is one page, so that a large group
    of copies doesn't make its own text boilerplate (near copies are different texts, and null texts no pages). Rows with null host or null text stay as they are (their count is 0). Text
    without dropped lines is unchanged to the byte. A column named as ``dropped`` is replaced; all others keep name and values.
    """
    plain = docs.drop(dropped)
    host_name, found_name, kept_name = free_names(plain, "host_of_page", "lines_of_host", "kept_lines")
    plain = plain.withColumn(host_name, host)
    pages = plain.select(F.col(host_name).alias("host"), F.col(f"`{text_col}`").alias("text"))
    found = boilerplate(pages, ratio, least_pages, copies_once).toDF(host_name, found_name)
    joined = plain.join(found, host_name, "left")
    lines = F.split(F.col(f"`{text_col}`"), "\n")
    kept = F.filter(
        lines, lambda l: (line_key(l) == "") | ~F.array_contains(F.col(found_name), F.unhex(F.md5(line_key(l))))
    )
    touched = F.col(found_name).isNotNull() & F.col(f"`{text_col}`").isNotNull()
    joined = joined.withColumn(kept_name, F.when(touched, kept))
    n = F.when(touched, F.size(lines) - F.size(kept_name)).otherwise(0).cast("long")
    text = F.when(touched, F.array_join(kept_name, "\n")).otherwise(F.col(f"`{text_col}`"))
    columns = [text.alias(c) if c == text_col else F.col(f"`{c}`") for c in docs.drop(dropped).columns]
    return joined.select(*columns, n.alias(dropped))
