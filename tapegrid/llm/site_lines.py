"""Site-relative line deduplication: boilerplate is what most pages of a host repeat."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tapegrid.session import settle

# Tags that end a line, and the entities that are written out.
BREAKS = r"(?i)<(?:/?(?:p|div|li|ul|ol|h[1-6]|tr|table|section|article|nav|header|footer|title|body|html|head|form|blockquote|pre)|br|hr)(?:[ \t\r\n/][^<>]*)?>"
DROPPED = r"(?is)<script\b.*?</script>|<style\b.*?</style>|<!--.*?-->"
TAG = r"<[^<>]*>"
ENTITIES = (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&nbsp;", " "), ("&amp;", "&"))
SALTS = 32


def page_lines(html: Column) -> Column:
    """Visible lines of a page: blocks end lines, tags go, blanks run together, empty lines go."""
    text = F.regexp_replace(F.coalesce(html, F.lit("")), DROPPED, "\n")
    text = F.regexp_replace(F.regexp_replace(text, BREAKS, "\n"), TAG, "")
    for code, char in ENTITIES:
        text = F.replace(text, F.lit(code), F.lit(char))
    text = F.regexp_replace(text, r"[ \t\r\x0B\f]+", " ")
    return F.filter(F.transform(F.split(text, "\n", -1), lambda x: F.trim(x)), lambda x: x != "")


def host_of(url: Column) -> Column:
    """Lower-case host of a URL without port and user; empty where there is none."""
    host = F.regexp_extract(F.coalesce(url, F.lit("")), r"^[A-Za-z][A-Za-z0-9+.\-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1)
    return F.lower(host)


def boilerplate(lines: DataFrame, ratio: float, least: int) -> DataFrame:
    """``host, common``: per host the hashes of lines on more than ``ratio`` of its pages.

    ``lines`` has ``host, hashes`` (distinct in a page). Counts combine on the map side, so a hot
    host or line is one row per task. A host has at most (lines per page / ratio) such lines.
    """
    pages = lines.groupBy("host").agg(F.count(F.lit(1)).alias("pages"))
    counts = (
        lines.select("host", F.explode("hashes").alias("hash"))
        .groupBy("host", "hash")
        .agg(F.count(F.lit(1)).alias("n"))
        .where(F.col("n") >= least)
    )
    often = counts.join(pages, "host").where(F.col("n") > F.col("pages") * F.lit(ratio))
    return often.groupBy("host").agg(F.sort_array(F.collect_list("hash")).alias("common"))


def without_boilerplate(
    pages: DataFrame,
    id_col: str = "page_id",
    url_col: str = "url",
    html_col: str = "html",
    ratio: float = 0.3,
    least: int = 3,
) -> DataFrame:
    """``page_id, host, text, n_lines, n_dropped``, one row per row of ``pages``.

    A line goes if it stands on more than ``ratio`` of its host's pages and on ``least`` pages or
    more (a host of one page repeats nothing). Lines are compared as written, after blanks are run
    together. Null or empty html gives no line and an empty text; pages without host are one host.
    Other columns are ignored.

    Lines are extracted once and settled; counting reads them again, not the html. Pages meet their
    host's list under host and a salt, so a hot host spreads over many tasks and only the short
    lists are repeated.
    """
    rows = settle(
        pages.select(
            F.col(id_col).alias("page_id"),
            host_of(F.col(url_col)).alias("host"),
            page_lines(F.col(html_col)).alias("lines"),
        )
    )
    hashes = F.array_distinct(F.transform("lines", lambda line: F.xxhash64(line)))
    common = settle(boilerplate(rows.select("host", hashes.alias("hashes")), ratio, least))
    salted = rows.withColumn("_salt", F.pmod(F.xxhash64("page_id"), F.lit(SALTS)).cast("int"))
    lists = common.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    joined = salted.join(lists, ["host", "_salt"], "left")
    kept = F.when(F.col("common").isNull(), F.col("lines")).otherwise(
        F.filter("lines", lambda line: ~F.array_contains("common", F.xxhash64(line)))
    )
    return joined.withColumn("_kept", kept).select(
        "page_id",
        "host",
        F.array_join("_kept", "\n").alias("text"),
        F.size("lines").cast("long").alias("n_lines"),
        (F.size("lines") - F.size("_kept")).cast("long").alias("n_dropped"),
    )
