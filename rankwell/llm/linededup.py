"""Site-relative line removal: a line that stands on too large a share of a host's pages is boilerplate.

Defined results: a null text stays null and its page still counts for the host; a page without a host keeps
all its lines; lines without a word are never boilerplate; a line that a page repeats counts once for that
page, but each of its repeats goes when it is boilerplate; repeated rows are pages of their own; a line on exactly the
given share of pages stays; very long texts and lines are treated whole; an empty table gives an empty one; further
columns pass through, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rankwell.llm.common import cut, fits, fresh, join_small

WORD = r"[^\x09-\x0D\x20]"


def _lines(text: Column) -> Column:
    return F.split(text, "\n")


def _candidate_lines(text: Column) -> Column:
    return F.array_distinct(F.filter(_lines(text), lambda x: x.rlike(WORD)))


def boilerplate_lines(docs: DataFrame, text: str = "text", host: str = "source", percent: int = 10, min_pages: int = 3) -> DataFrame:
    """Rows (host, line, pages, host_pages) of the lines on more than `percent` % and at least `min_pages` of a host's pages.

    Lines are counted by a 64-bit hash first, which shuffles numbers only; what may be boilerplate is then
    counted again by the line itself, so a hash collision can't drop a line.
    """
    d = docs.select(F.col(host).alias("host"), F.col(text).alias("text")).filter("host is not null")
    totals = d.groupBy("host").agg(F.count(F.lit(1)).alias("host_pages"))
    often = (F.col("pages") >= min_pages) & (F.col("pages") * 100 > F.col("host_pages") * percent)
    hashed = (
        d.select("host", F.explode(F.transform(_candidate_lines(F.col("text")), lambda x: F.xxhash64(x))).alias("h"))
        .groupBy("host", "h").agg(F.count(F.lit(1)).alias("pages")).filter(F.col("pages") >= min_pages)
    )
    # a host's list is short: it holds at most 100 / percent times the mean number of lines on its pages
    maybe = cut(hashed.join(totals, "host").filter(often).groupBy("host").agg(F.collect_list("h").alias("hs")))
    size = F.length("host") + 8 * F.size("hs")
    exact = (
        join_small(d, maybe, ["host"], "inner", size)
        .select("host", F.explode(F.expr("filter(array_distinct(split(text, '\\n')), x -> array_contains(hs, xxhash64(x)))")).alias("line"))
        .groupBy("host", "line").agg(F.count(F.lit(1)).alias("pages"))
    )
    return exact.join(totals, "host").filter(often).filter(F.col("line").rlike(WORD))


def drop_boilerplate(docs: DataFrame, text: str = "text", host: str = "source", percent: int = 10, min_pages: int = 3, counts: bool = False) -> DataFrame:
    """`docs` with boilerplate lines cut out of `text`; with `counts` also n_lines and n_dropped."""
    per_host = cut(boilerplate_lines(docs, text, host, percent, min_pages).groupBy("host").agg(F.collect_list("line").alias("lines")))
    size = F.length("host") + F.aggregate("lines", F.lit(0), lambda a, x: a + F.length(x) * 4 + 16)
    small = fits(per_host, size)
    h, lines = fresh(docs, "__host"), fresh(docs, "__lines")
    gone = per_host.select(F.col("host").alias(h), F.col("lines").alias(lines))
    out = docs.join(F.broadcast(gone) if small else gone, F.col(host) == F.col(h), "left")
    kept = F.expr(f"filter(split(`{text}`, '\\n'), x -> not array_contains(`{lines}`, x))")
    new = F.when(F.col(text).isNull() | F.col(lines).isNull(), F.col(text)).otherwise(F.concat_ws("\n", kept))
    more = []
    if counts:
        n = F.when(F.col(text).isNull(), F.lit(0)).otherwise(F.size(_lines(F.col(text))))
        left = F.when(F.col(text).isNull() | F.col(lines).isNull(), n).otherwise(F.size(kept))
        more = [n.cast("long").alias("n_lines"), (n - left).cast("long").alias("n_dropped")]
    same = [F.col(c) if c != text else new.alias(text) for c in docs.columns]
    return out.select(*same, *more)
