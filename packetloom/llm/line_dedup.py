"""Operator 8, line dedup: site-relative frequency, by DataFrame functions only.

Pages of a host are its distinct texts, so mirrored copies of a page count once. A line that more than ``ratio`` of a
host's pages contain, and at least ``least_pages`` of them, is boilerplate there and is dropped from all its pages.
Lines are what line feeds separate, compared as they are; lines without a word are never dropped.

Null texts stay null and have no lines; null hosts are one host; repeated rows each give a row; an empty table gives
an empty result; all other columns are carried along.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from packetloom.llm.common import free_name, written

RATIO, LEAST_PAGES = 0.01, 3
HAS_WORD = r"[^\x20\x09-\x0D]"


def boilerplate(docs: DataFrame, host: str, text: str, ratio: float = RATIO, least_pages: int = LEAST_PAGES) -> DataFrame:
    """(host, lines): hashes of the lines to drop, for hosts that have any.

    A host has at most its mean number of lines a page over ``ratio`` of them. Lines travel as 64-bit hashes, and are
    counted in two steps: by (host, line, page), which spreads every hot line and host, then added up from partial counts.
    Two lines of one host that share a hash would be counted together; at a billion lines of a host the odds are 3 in 100.
    """
    pages = docs.where(F.col(text).isNotNull()).select(F.col(host).alias("host"), F.xxhash64(text).alias("page"), F.col(text).alias("text"))
    totals = pages.groupBy("host", "page").agg(F.lit(1).alias("one")).groupBy("host").agg(F.count("*").alias("pages"))
    lines = F.array_distinct(F.transform(F.filter(F.split("text", "\n"), lambda x: x.rlike(HAS_WORD)), lambda x: F.xxhash64(x)))
    once = pages.select("host", "page", F.explode(lines).alias("line")).groupBy("host", "line", "page").agg(F.lit(1).alias("one"))
    counts = once.groupBy("host", "line").agg(F.count("*").alias("n")).where(F.col("n") >= least_pages)
    frequent = counts.join(totals.withColumnRenamed("host", "host_"), F.col("host").eqNullSafe(F.col("host_"))).where(F.col("n") > ratio * F.col("pages"))
    return frequent.groupBy("host").agg(F.collect_set("line").alias("lines"))


def drop_boilerplate(docs: DataFrame, host: str = "source", text: str = "text", ratio: float = RATIO, least_pages: int = LEAST_PAGES) -> DataFrame:
    """``docs`` with the lines dropped, and ``n_lines`` and ``n_dropped`` added (renamed if taken).

    The lists of lines are written first, so that their size is known when the join by host is planned: below Spark's
    threshold they are sent to all executors and texts stay where they are; above it texts are shuffled, and a hot host
    is split by the skew join.
    """
    n_lines, n_dropped = free_name(docs, "n_lines"), free_name(docs, "n_dropped")
    drop = written(boilerplate(docs, host, text, ratio, least_pages).select(F.col("host").alias("host__"), F.col("lines").alias("drop__")), "boilerplate")
    joined = docs.join(drop, F.col(host).eqNullSafe(F.col("host__")), "left")
    lines = F.split(F.col(text), "\n", -1)
    hit = F.array_intersect(F.transform(lines, lambda x: F.xxhash64(x)), F.col("drop__"))
    joined = joined.withColumn("hit__", F.coalesce(hit, F.array().cast("array<bigint>")))
    kept = F.filter(lines, lambda x: ~F.array_contains(F.col("hit__"), F.xxhash64(x)))
    joined = joined.withColumn("kept__", F.when(F.size("hit__") > 0, kept))
    words = F.size(lines)
    out = [F.when(F.size("hit__") > 0, F.array_join("kept__", "\n")).otherwise(F.col(text)).alias(text) if c == text else F.col(c) for c in docs.columns]
    total = F.coalesce(F.when(F.col(text).isNotNull(), words), F.lit(0)).cast("long")
    dropped = F.when(F.size("hit__") > 0, words - F.size("kept__")).otherwise(0).cast("long")
    return joined.select(*out, total.alias(n_lines), dropped.alias(n_dropped))
