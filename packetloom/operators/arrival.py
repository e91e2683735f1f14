"""Inter-arrival times in arrival order, per flow and over all flows.

Rows are unordered in Spark, so arrival order is a column (``seq``). A plain ``lag`` puts a whole flow in one task; with
cut points over ``seq`` it is taken per (flow, range), and the first row of each range gets the last value of the range
before from a small table. So neither a flow with a third of the packets nor the global order becomes one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def cut_points(df: DataFrame, order: str, ranges: int) -> list:
    """Up to ``ranges`` - 1 ascending cut points of ``order``: a few numbers for the driver."""
    if ranges < 2:
        return []
    shares = ", ".join(repr(i / ranges) for i in range(1, ranges))
    found = df.agg(F.expr(f"percentile_approx(`{order}`, array({shares}), 10000)").alias("q")).first().q
    return sorted(set(found or []))


def range_of(value: Column, cuts: list) -> Column:
    """How many cut points are at or below ``value``, by halving."""

    def halve(low: int, high: int) -> Column:
        if low == high:
            return F.lit(low)
        middle = (low + high) // 2
        return F.when(value >= F.lit(cuts[middle]), halve(middle + 1, high)).otherwise(halve(low, middle))

    return halve(0, len(cuts))


def with_previous(df: DataFrame, value: str, order: str, keys: list[str], out: str, cuts: list | None = None) -> DataFrame:
    """``df`` with the value of the row before, in ascending ``order`` within ``keys``; null for the first."""
    if not cuts:
        return df.withColumn(out, F.lag(value).over(Window.partitionBy(*keys).orderBy(order)))
    part = df.withColumn("range__", range_of(F.col(order), cuts))
    inner = part.withColumn(out, F.lag(F.struct(value)).over(Window.partitionBy(*keys, "range__").orderBy(order)))
    ends = part.groupBy(*keys, "range__").agg(F.max_by(F.struct(value), order).alias("end__"))
    carried = ends.withColumn("carried__", F.lag("end__").over(Window.partitionBy(*keys).orderBy("range__"))).drop("end__")
    names = [*keys, "range__"]
    right = carried.select(*(F.col(c).alias(f"{c}__r") for c in names), "carried__")
    same = F.lit(True)
    for c in names:
        same = same & F.col(c).eqNullSafe(F.col(f"{c}__r"))
    joined = inner.join(right, same, "left")
    return joined.select(*df.columns, F.coalesce(out, "carried__").getField(value).alias(out))


def flow_gaps(packets: DataFrame, keys: list[str], ts: str = "ts", seq: str = "seq", cuts: list | None = None) -> DataFrame:
    """``raw_iat``: signed seconds since the flow's packet before, null for its first."""
    return with_previous(packets, ts, seq, keys, "previous__", cuts).withColumn("raw_iat", F.col(ts) - F.col("previous__")).drop("previous__")


def global_gaps(packets: DataFrame, ts: str = "ts", seq: str = "seq", ranges: int = 32) -> DataFrame:
    """``raw_iat`` over all packets whatever their flow. Ranges of ``seq`` keep it in many tasks."""
    return flow_gaps(packets, [], ts, seq, cut_points(packets, seq, ranges) or None) if ranges > 1 else flow_gaps(packets, [], ts, seq)


def clipped(packets: DataFrame) -> DataFrame:
    """``inter`` (0 for the first packet and for negative gaps) and ``neg_delta`` from ``raw_iat``."""
    negative = F.coalesce(F.col("raw_iat") < 0, F.lit(False))
    return packets.withColumn("inter", F.when(negative, 0.0).otherwise(F.coalesce("raw_iat", F.lit(0.0)))).withColumn("neg_delta", negative.cast("int")).drop("raw_iat")
