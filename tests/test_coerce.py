"""Coercions against Python's own int() and float()."""

import json
import math
from datetime import datetime, timezone

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from packetloom.functions import coerce, packets

TEXTS = ["12", "12.7", "-12.7", "1e3", "0x0003", "1_000", " 12 ", "nan", "inf", "-inf", "+Infinity", "1.0f", "1d", "", " ", "abc", ".5", "5.", "1__0", "_1", "1_", "+3", "--3", "1e", "1e5_0", "9223372036854775807", "-9223372036854775808", "1e400", "0", "-0.5", "12L", "True", "１２x", "1 2", "\t7\n", "1.5e-3", "1E+2"]


def python_int(value, default):
    value = value[0] if isinstance(value, list) and value else None if isinstance(value, list) else value
    try:
        return int(value)
    except (TypeError, ValueError):
        try:
            return int(float(value))
        except (TypeError, ValueError, OverflowError):
            return default


def python_float(value, default):
    value = value[0] if isinstance(value, list) and value else None if isinstance(value, list) else value
    try:
        return float(value)
    except (TypeError, ValueError):
        return default


def same(a, b):
    return a == b or isinstance(a, float) and isinstance(b, float) and math.isnan(a) and math.isnan(b)


def check(spark, values):
    rows = spark.createDataFrame([(i, json.dumps(v)) for i, v in enumerate(values)], "i int, j string").withColumn("v", F.try_parse_json("j"))
    got = rows.select("i", coerce.as_int(F.col("v")).alias("n"), coerce.as_float(F.col("v"), -1.0).alias("x")).orderBy("i").collect()
    for value, row in zip(values, got, strict=True):
        n, x = python_int(value, -1), python_float(value, -1.0)
        assert same(row.x, x), (value, row.x, x)
        if abs(n) < 1 << 63:
            assert row.n == n, (value, row.n, n)


def test_texts(spark):
    check(spark, TEXTS)


def test_wrapped_and_typed(spark):
    check(spark, [["12"], [], [["12"]], None, True, False, 3, 2.9, -0.5, {"a": 1}, ["x", "3"], [None]])


@settings(max_examples=8, deadline=None)
@given(st.lists(st.text("0123456789+-._eE xinfa", max_size=8), min_size=30, max_size=60))
def test_any_text(spark, values):
    check(spark, values)


def test_strings(spark):
    values = [("a", "a"), (["a", "b"], "a"), ([], ""), (None, ""), (True, "True"), (12, "12")]
    rows = spark.createDataFrame([(i, json.dumps(v)) for i, (v, _) in enumerate(values)], "i int, j string").withColumn("v", F.try_parse_json("j"))
    assert [r.s for r in rows.orderBy("i").select(coerce.as_str(F.col("v")).alias("s")).collect()] == [s for _, s in values]


def test_truthy(spark):
    values = [("", None), ("0", "0"), (0, None), (0.0, None), (False, None), (None, None), ("x", "x"), (5, "5")]
    rows = spark.createDataFrame([(i, json.dumps(v)) for i, (v, _) in enumerate(values)], "i int, j string").withColumn("v", F.try_parse_json("j"))
    assert [r.s for r in rows.orderBy("i").select(coerce.truthy_text(F.col("v")).alias("s")).collect()] == [s for _, s in values]


@pytest.mark.parametrize("text", ["2024-01-01T00:00:00Z", "2024-01-01T10:20:30.123456789+00:00", "2024-01-01 10:20:30", "2024-01-01", "2024-05-01T00:00:00+09:00", "20240101T000000"])
def test_times(spark, text):
    when = datetime.fromisoformat(text.replace("Z", "+00:00"))
    expected = (when if when.tzinfo else when.replace(tzinfo=timezone.utc)).timestamp()
    assert spark.range(1).select(coerce.epoch(F.lit(text))).first()[0] == pytest.approx(expected, abs=1e-6)


def test_times_that_are_none(spark):
    for text, expected in (("Jan  1, 2024 00:00:00", 0.0), ("1700000000.25", 1700000000.25), ("", 0.0), ("2024-13-01T00:00:00Z", 0.0)):
        assert spark.range(1).select(coerce.epoch(F.lit(text))).first()[0] == expected


def test_topic_bucket_is_the_whole_hash(spark):
    import hashlib

    topics = ["a/b", "", "ü/ñ", *(f"t/{i}" for i in range(300))]
    rows = spark.createDataFrame([(t,) for t in topics], "t string").select("t", packets.topic_bucket(F.col("t")).alias("b"), packets.topic_length(F.col("t")).alias("n"))
    for r in rows.collect():
        assert r.b == int(hashlib.sha1(r.t.encode()).hexdigest(), 16) % 1024 and r.n == len(r.t)
    assert spark.range(1).select(packets.topic_bucket(F.lit(None).cast("string"))).first()[0] == -1
