"""Line dedup by site-relative frequency: a line that too many pages of one host hold is boilerplate of that host.

Pages are grouped by host, the pages that hold a line are divided by the host's pages, and lines whose share exceeds
`ratio` go from every page of the host, if at least `least` pages hold them. Lines are compared trimmed; empty lines are no
lines and stay. Hosts of every size are treated alike.

Counting is a map-side combined aggregate over (host, line hash), so a hot line or host shrinks before it is shuffled.
A host has at most (lines per page) / ratio boilerplate lines, so what is joined back to the pages is one short array
for each host that has any; Spark broadcasts it while it holds at most BROADCAST_LINES lines and otherwise joins by
shuffle, where AQE splits a hot host. Texts are not shuffled in the first case. Built-in functions only.

A line is known by two 64-bit hashes. NULL host counts as the host ''. NULL texts stay NULL and hold no line, but count as a page;
repeated rows are pages of their own. Further columns pass through. An empty table gives an empty table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tapelake.llm.common import columns, fresh
from tapelake.session import written

RATIO, LEAST = 0.1, 3
BROADCAST_LINES = 200_000  # 16 bytes each


def _known(line: Column) -> Column:
    return F.struct(F.xxhash64(line).alias("a"), F.xxhash64(F.lit(1), line).alias("b"))


def _lines(text: Column) -> Column:
    return F.split(text, "\n")


def _trimmed(line: Column) -> Column:
    return F.btrim(line, F.lit(" \t\n\x0b\f\r"))


def _keys(text: Column) -> Column:
    """Distinct lines of a text as hashes, empty ones left out."""
    full = F.filter(F.transform(_lines(text), _trimmed), lambda line: line != "")
    return F.array_distinct(F.transform(full, _known))


def boilerplate(pages: DataFrame, host: str = "source", text: str = "text", ratio: float = RATIO,
                least: int = LEAST) -> DataFrame:
    """(host, a, b, pages, host_pages) of each line that at least `least` and more than `ratio` of the host's pages hold."""
    named = pages.select(F.coalesce(F.col(host), F.lit("")).alias("host"), F.col(text).alias("text"))
    counts = (named.select("host", F.explode(_keys(F.col("text"))).alias("line"))
              .groupBy("host", "line.a", "line.b").agg(F.count(F.lit(1)).alias("pages")))
    totals = named.groupBy("host").agg(F.count(F.lit(1)).alias("host_pages"))
    often = counts.where(F.col("pages") >= least)
    return often.join(totals, "host").where(F.col("pages") > ratio * F.col("host_pages"))


def drop_lines(pages: DataFrame, host: str = "source", text: str = "text", ratio: float = RATIO,
               least: int = LEAST, dropped: str = "n_dropped") -> DataFrame:
    """The pages with boilerplate lines taken out of `text`, and the number of lines that went in `dropped` (a column of that name is replaced)."""
    pages = pages.drop(dropped)
    gone_in, host_of, kept_in = fresh(pages, "_gone"), fresh(pages, "_host"), fresh(pages, "_kept")
    found = written(boilerplate(pages, host, text, ratio, least), "boilerplate")
    sets = found.groupBy(F.col("host").alias(host_of)).agg(F.collect_set(F.struct("a", "b")).alias(gone_in))
    if found.count() <= BROADCAST_LINES:
        sets = F.broadcast(sets)
    both = pages.join(sets, F.coalesce(pages[host], F.lit("")) == F.col(host_of), "left")
    gone = F.col(gone_in).isNotNull() & F.col(text).isNotNull()
    kept = F.filter(_lines(F.col(text)), lambda line: ~F.array_contains(F.col(gone_in), _known(_trimmed(line))))
    both = both.withColumn(kept_in, F.when(gone, kept))
    out = dict(zip(pages.columns, columns(pages)))
    out[text] = F.when(F.col(kept_in).isNotNull(), F.array_join(F.col(kept_in), "\n")).otherwise(F.col(text)).alias(text)
    count = F.when(F.col(kept_in).isNotNull(), F.size(_lines(F.col(text))) - F.size(F.col(kept_in))).otherwise(0)
    return both.select(*out.values(), count.cast("long").alias(dropped))
