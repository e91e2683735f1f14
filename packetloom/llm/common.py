"""Helpers shared by the training-data operators: tables in the shared folder, range buckets, guarded column names."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from packetloom.session import scratch_path

#: A filter of keys has so many longs (1 MB) at any size, and so many bits for each key.
FILTER_LONGS, PROBES = 1 << 17, 2


def written(df: DataFrame, name: str) -> DataFrame:
    """Cut the lineage: write ``df`` as Parquet to the shared folder and read it back. The folder goes when the driver ends."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def free_name(df: DataFrame, wish: str) -> str:
    """``wish``, or with underscores appended until no column of ``df`` has that name."""
    taken = {c.lower() for c in df.columns}
    while wish.lower() in taken:
        wish += "_"
    return wish


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions", "200"))


def range_bounds(df: DataFrame, key: str, buckets: int) -> list:
    """At most ``buckets`` - 1 ascending cut points of ``key`` over all rows (one number a bucket reaches the driver)."""
    if buckets < 2:
        return []
    cuts = ", ".join(repr(i / buckets) for i in range(1, buckets))
    row = df.agg(F.expr(f"percentile_approx(`{key}`, array({cuts}), 10000)").alias("q")).first()
    return sorted(set(row.q or []))


def range_bucket(value: Column, bounds: list) -> Column:
    """The number of bounds at or below ``value`` as a balanced tree of CASE WHEN: log2 comparisons a row. Null: 0."""

    def tree(lo: int, hi: int) -> Column:
        if lo == hi:
            return F.lit(lo)
        mid = (lo + hi) // 2
        return F.when(value >= F.lit(bounds[mid]), tree(mid + 1, hi)).otherwise(tree(lo, mid))

    return tree(0, len(bounds))


def may_be_among(keys: DataFrame, *columns: str) -> Callable[..., Column]:
    """A condition on columns of the same types as ``columns``: false only for keys that ``keys`` lacks, never null.

    So rows that surely have no partner needn't move to an exact join. The filter is one row of one size, whatever ``keys``
    holds, and is sent to all tasks; it is written first. With many millions of keys it is full, and all rows move.
    """

    def place(*key: Column) -> Column:
        return F.pmod(F.xxhash64(*key), F.lit(FILTER_LONGS)).cast("int")

    def mask(*key: Column) -> Column:
        """The bits of a key, in the one long that it has: so a task holds the filter once."""
        more = F.xxhash64(*key, F.lit(1))
        one = [F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(F.call_function("shiftright", more, F.lit(8 * i)), F.lit(64)).cast("int")) for i in range(PROBES)]
        return reduce(Column.bitwiseOR, one)

    of = [F.col(c) for c in columns]
    longs = keys.select(place(*of).alias("id"), mask(*of).alias("bits")).groupBy("id").agg(F.bit_or("bits").alias("bits"))
    every = keys.sparkSession.range(FILTER_LONGS).join(longs, "id", "left").select("id", F.coalesce("bits", F.lit(0).cast("long")).alias("bits"))
    found = written(every.agg(F.sort_array(F.collect_list(F.struct("id", "bits")))["bits"].alias("longs")), "key-filter").scalar()

    def condition(*key: Column) -> Column:
        return F.get(found, place(*key)).bitwiseOR(F.bitwise_not(mask(*key))) == -1

    return condition
