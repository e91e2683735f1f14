"""Aggregates of the feature rows: entropy, tails, lower-index quantiles."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from packetloom.functions.coerce import let

EPS, RATIO_CAP = 1e-9, 1e6


def lower_quantile(ordered: Column, p: float) -> Column:
    """Of an ascending array: the element at floor(p * (n - 1)), without interpolation; 0 if empty."""
    at = F.floor(F.lit(p) * (F.size(ordered) - 1)).cast("int")
    return F.when(F.size(ordered) > 0, F.get(ordered, at)).otherwise(0.0)


def entropy(histogram: Column) -> Column:
    """Of an array of counts: -sum(p * ln(p + 1e-9)); 0 if empty."""
    total = F.aggregate(histogram, F.lit(0.0), lambda a, n: a + n)

    def of(total: Column) -> Column:
        return F.aggregate(histogram, F.lit(0.0), lambda a, n: a - n / total * F.log(n / total + F.lit(EPS)))

    return F.when(F.size(histogram) > 0, let(total, of)).otherwise(0.0)


def mean(values: Column) -> Column:
    n = F.size(values)
    return F.when(n > 0, F.aggregate(values, F.lit(0.0), lambda a, x: a + x) / n).otherwise(0.0)


def deviation(values: Column) -> Column:
    """Population standard deviation of an array; 0 if empty."""
    n = F.size(values)

    def of(mean_: Column) -> Column:
        return F.sqrt(F.aggregate(values, F.lit(0.0), lambda a, x: a + (x - mean_) * (x - mean_)) / n)

    return F.when(n > 0, let(mean(values), of)).otherwise(0.0)


def or_zero(value: Column) -> Column:
    return F.coalesce(value, F.lit(0.0))
