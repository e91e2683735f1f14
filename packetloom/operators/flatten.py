"""Flat builder rows: function-code histograms to columns for the most frequent codes, and totals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from packetloom.functions.coerce import text_to_long
from packetloom.operators.builder import EXCEPTION_FROM, READ_CODES, WRITE_CODES

TOP_CODES = 16


def parsed_histogram(text: Column) -> Column:
    """A JSON object of counts as map<string, bigint>; empty where the text is none. Counts that aren't numbers are 0."""
    entries = F.from_json(text, "map<string,string>")
    return F.coalesce(F.transform_values(entries, lambda k, v: F.coalesce(text_to_long(v), F.lit(0).cast("bigint"))), F.create_map().cast("map<string,bigint>"))


def top_codes(tables: list[DataFrame], k: int = TOP_CODES) -> list[str]:
    """The ``k`` codes with the largest counts over all tables in turn; ties by first appearance. Rows have ``row``, their
    order within their table. At most ``k`` names reach the driver."""
    rows = [t.select(F.lit(i).alias("t"), "row", F.posexplode(parsed_histogram(F.col("fc_hist_json"))).alias("at", "code", "n")) for i, t in enumerate(tables)]
    all_rows = rows[0]
    for more in rows[1:]:
        all_rows = all_rows.unionByName(more)
    ranked = all_rows.groupBy("code").agg(F.sum("n").alias("n"), F.min(F.struct("t", "row", "at")).alias("first"))
    return [r.code for r in ranked.orderBy(F.col("n").desc(), "first").limit(k).collect()]


def flattened(rows: DataFrame, codes: list[str]) -> DataFrame:
    """``rows`` without fc_hist_json, with FC_<code> for each code, FC_OTHER, and the read, write and exception totals."""
    found = rows.withColumn("h__", parsed_histogram(F.col("fc_hist_json")))

    def total(met) -> Column:
        return F.aggregate(F.map_entries(F.map_filter("h__", met)), F.lit(0).cast("bigint"), lambda a, e: a + e["value"])

    code = lambda k: F.coalesce(text_to_long(k), F.lit(-1).cast("bigint"))
    zero = F.lit(0).cast("bigint")
    columns = [F.coalesce(F.try_element_at("h__", F.lit(c)), zero).alias(f"FC_{c}") for c in codes]
    other = total(lambda k, v: ~k.isin(*codes)) if codes else total(lambda k, v: F.lit(True))
    return found.select(
        *(c for c in rows.columns if c != "fc_hist_json"),
        *columns,
        other.alias("FC_OTHER"),
        total(lambda k, v: code(k).isin(*READ_CODES)).alias("FC_READ_TOTAL"),
        total(lambda k, v: code(k).isin(*WRITE_CODES)).alias("FC_WRITE_TOTAL"),
        total(lambda k, v: code(k) >= EXCEPTION_FROM).alias("FC_EXCEPTION_TOTAL"),
    )


def key_mode(rows: DataFrame | None, report_mode: str | None = None, look_at: int = 10_000) -> str:
    """How flows were keyed: as the quality report says, else by whether one of the first rows has a real unit."""
    if report_mode:
        return report_mode
    if rows is None:
        return "unknown"
    unit = F.coalesce(F.trim("mb_unit_id"), F.lit(""))
    head = rows.orderBy("row").limit(look_at)
    return "src_dst_unit" if not head.where(~unit.isin("", "-1")).isEmpty() else "src_dst"
