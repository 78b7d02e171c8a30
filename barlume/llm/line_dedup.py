"""Line dedup by how often a line stands on the pages of its own site."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barlume.llm import common

_BLANK = " \t\r"


def host_of(url: Column) -> Column:
    """Host of an absolute URL in lower case, without a leading www.; null if there is none."""
    host = F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/:?#]+)", 1))
    return F.nullif(F.regexp_replace(host, r"^www\.", ""), F.lit(""))


def page_text(html: Column) -> Column:
    """Text of a page, a line for each block element; scripts and styles are left out."""
    out = F.regexp_replace(html, r"(?is)<script\b.*?</script>|<style\b.*?</style>|<head\b.*?</head>", "")
    out = F.regexp_replace(out, r"(?i)</(p|div|li|ul|ol|h[1-6]|tr|td|th|table|nav|header|footer|section|article|pre|blockquote|title)>|<br[^>]*>", "\n")
    return F.regexp_replace(out, r"<[^>]*>", "")


def lines_of(text: Column | str) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def boilerplate(pages: DataFrame, ratio: float, least: int) -> DataFrame:
    """(_host, _gone): hashes of the lines that stand on more than ``ratio`` of the host's
    pages and on ``least`` of them or more.  A page has few lines, so a host has at
    most lines a page / ratio of them, however many its pages."""
    seen = pages.where("_host is not null").select("_host", F.explode(F.array_distinct("_hashes")).alias("_line"))
    seen = seen.where("_line is not null").groupBy("_host", "_line").agg(F.count("*").alias("_n")).where(F.col("_n") >= least)
    total = common.saved(pages.where("_host is not null").groupBy("_host").agg(F.count("*").alias("_all")))
    gone = seen.join(total, "_host").where(F.col("_n") > ratio * F.col("_all"))
    return gone.groupBy("_host").agg(F.collect_list("_line").alias("_gone"))


def drop(df: DataFrame, host: Column, text: Column, ratio: float = 0.1, least: int = 5) -> DataFrame:
    """The rows and columns of ``df`` and, in a struct ``lines``: host, n_lines (lines that are not blank),
    n_dropped and kept, the text without its site's boilerplate lines.

    Pages are grouped by host; a line (blanks at its ends aside) is dropped everywhere on the host if the pages
    with it are more than ``ratio`` of the host's pages and ``least`` or more.  Counts combine before the
    shuffle; the lines to drop come to the pages by a join on the host that Spark can split.

    Null text stays null and has no lines; a page without host is kept whole; blank lines are kept.
    A line is counted once a page however often it stands there; equal rows are pages of their own.
    A column named lines is replaced.  Everything is built from column functions.
    """
    bare = F.transform(lines_of(text), lambda x: F.btrim(x, F.lit(_BLANK)))
    pages = df.select(host.alias("_host"), F.transform(bare, lambda x: F.when(x != "", F.xxhash64(x))).alias("_hashes"))
    found = common.saved(boilerplate(pages, ratio, least))
    rows = df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("_row"), host.alias("_host"), text.alias("_text")).join(found, "_host", "left")
    kept = F.filter(lines_of("_text"), lambda x: ~F.coalesce(F.array_contains(F.coalesce("_gone", F.array().cast("array<bigint>")), F.xxhash64(F.btrim(x, F.lit(_BLANK)))), F.lit(False)) | (F.btrim(x, F.lit(_BLANK)) == ""))
    out = rows.select("_row", "_host", "_text", lines_of("_text").alias("_lines"), kept.alias("_kept"))
    solid = lambda c: F.size(F.filter(c, lambda x: F.btrim(x, F.lit(_BLANK)) != "")).cast("long")
    result = F.struct(
        F.col("_host").alias("host"),
        solid("_lines").alias("n_lines"),
        (solid("_lines") - solid("_kept")).alias("n_dropped"),
        F.when(F.col("_text").isNotNull(), F.array_join("_kept", "\n")).alias("kept"),
    )
    return out.select(*[F.col("_row").getField(c).alias(c) for c in df.columns if c != "lines"], result.alias("lines"))
