"""Line deduplication by site-relative frequency, with DataFrame functions only.

A line is boilerplate on a host if the pages that contain it, divided by the
host's pages, exceed a ratio (and a least number of pages). Boilerplate
lines are dropped from every page of that host; blank lines stay and never
count.

Lines travel as two 64-bit hashes and are counted with partial aggregation,
so a host with a third of all pages is as spread out as any other. A host's
boilerplate list has at most (mean lines a page) / ratio entries. The lists
are broadcast if their counted size allows, else joined under a salt that
deals the pages of one host to many tasks; page texts are never grouped.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import fresh, stage

RATIO = 0.1
LEAST_PAGES = 5
#: Boilerplate lines, over all hosts, up to which the lists are broadcast (about 16 bytes each).
BROADCAST_LINES = 500_000
SALTS = 64


def _key(line: Column) -> Column:
    return F.struct(F.xxhash64(line).alias("a"), F.xxhash64(F.lit("line"), line).alias("b"))


def _host(host: Column) -> Column:
    return F.coalesce(host.cast("string"), F.lit("\0"))


def _filled(line: Column) -> Column:
    return F.trim(line) != ""


def boilerplate(docs: DataFrame, host: Column, text_col: str = "text", ratio: float = RATIO, least_pages: int = LEAST_PAGES, copies_once: bool = False) -> DataFrame:
    """(host, line, pages, host_pages): the boilerplate lines (as hash pairs) of each host.

    With ``copies_once`` the pages of a host that have one and the same text
    count as one page, in the line's count and in the total.
    """
    pages = docs.select(_host(host).alias("host"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    lines = F.explode(F.filter(F.array_distinct(F.split("text", "\n")), _filled))
    if copies_once:
        page = F.struct(F.xxhash64("text").alias("a"), F.xxhash64(F.lit("page"), "text").alias("b"))
        # equal pages have equal lines: one of each weighs its lines, the others are left out of the count
        pages = pages.withColumn("page", page)
        total = pages.select("host", "page").distinct().groupBy("host").agg(F.count("*").alias("host_pages"))
        seen = pages.select("host", "page", lines.alias("line")).select("host", "page", _key(F.col("line")).alias("line"))
        counts = seen.distinct().groupBy("host", "line").agg(F.count("*").alias("pages"))
    else:
        total = pages.groupBy("host").agg(F.count("*").alias("host_pages"))
        counts = pages.select("host", lines.alias("line")).groupBy("host", _key(F.col("line")).alias("line")).agg(F.count("*").alias("pages"))
    frequent = counts.where(F.col("pages") >= least_pages)
    return frequent.join(total, "host").where(F.col("pages") > ratio * F.col("host_pages"))


def drop_boilerplate(
    docs: DataFrame, host: Column, id_col: str = "doc_id", text_col: str = "text", ratio: float = RATIO, least_pages: int = LEAST_PAGES, copies_once: bool = False
) -> DataFrame:
    """``docs`` with boilerplate lines dropped from ``text_col``, plus ``__lines`` and ``__dropped`` counts.

    One row for each input row; other columns as they are. A null text stays
    null with zero lines; an empty text is one blank line and stays. Pages
    with a null host form one host. Input columns named ``__lines`` or
    ``__dropped`` are replaced. A page all of whose lines are
    boilerplate becomes empty (or keeps its blank lines). ``id_col`` only
    deals pages to salts; it may be null or repeat.
    """
    found = stage(boilerplate(docs, host, text_col, ratio, least_pages, copies_once).select("host", "line"), "boilerplate")
    columns = [c for c in docs.columns if c.lower() not in ("__lines", "__dropped")]
    at, drop, split, kept, salt = (fresh(docs, f"__{c}") for c in ("host", "drop", "split", "kept", "salt"))
    per_host = found.groupBy(F.col("host").alias(at)).agg(F.collect_list("line").alias(drop))
    pages = docs.withColumn(at, _host(host)).select(*columns, at)
    if found.count() <= BROADCAST_LINES:
        joined = pages.join(F.broadcast(per_host), at, "left")
    else:
        salted = per_host.withColumn(salt, F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        joined = pages.withColumn(salt, F.pmod(F.xxhash64(id_col, text_col), F.lit(SALTS)).cast("int")).join(salted, [at, salt], "left").drop(salt)
    text = F.col(text_col)
    stays = F.filter(split, lambda line: ~(_filled(line) & F.array_contains(drop, _key(line))))
    out = joined.withColumn(split, F.split(text, "\n")).withColumn(kept, F.when(F.col(drop).isNull(), F.col(split)).otherwise(stays))
    count = lambda n: F.when(text.isNull(), 0).otherwise(n).cast("long")
    out = out.withColumns({"__lines": count(F.size(split)), "__dropped": count(F.size(split) - F.size(kept)), text_col: F.when(text.isNotNull(), F.array_join(kept, "\n"))})
    return out.select(*columns, "__lines", "__dropped")
