"""Builder features: 35 metrics of tumbling windows and of sessions, and the quality of the arrival order.

Rows have seq, ts, src_ip, dst_ip, unit (text), is_response, fc, addr, qty, resp_time and raw_iat. Quantiles are exact over
all values of a group, where sampling would keep 2,000; counts and moments are merged from partial aggregates.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from packetloom.functions import coerce
from packetloom.functions.packets import window_start
from packetloom.functions.stats import or_zero
from packetloom.operators.arrival import cut_points, flow_gaps, range_of

#: Function codes that read and that write; codes from 128 on are exceptions.
READ_CODES, WRITE_CODES, EXCEPTION_FROM = (1, 2, 3, 4), (5, 6, 15, 16, 22, 23), 128
WINDOWS, LATENESS = (1, 5), 2.0
BURST_BELOW, IDLE_ABOVE = 0.01, 1.0
SESSION_IDLE, SESSION_RESET = 30.0, 1.0
#: Upper bounds of the bins of negative gaps, in seconds.
NEGATIVE_BINS = (0.001, 0.01, 0.1, 1.0)
FLOW = ["src_ip", "dst_ip", "mb_unit_id"]
NO_UNIT = "-1"


def parsed_rows(raw: DataFrame, with_unit: bool = True) -> DataFrame:
    """Typed rows of the parsed-packet CSV (all text) with ``seq``. Rows whose time isn't a finite number are left out;
    see :func:`bad_rows`."""

    def number(name: str, default: int) -> Column:
        return F.coalesce(coerce.text_to_long(F.col(name)), F.lit(default).cast("bigint"))

    ts = coerce.text_to_double(F.col("timestamp"))
    unit = F.coalesce("mb_unit_id", F.lit("")) if with_unit else F.lit(NO_UNIT)
    rows = raw.select(
        "seq",
        ts.alias("ts"),
        F.coalesce("src_ip", F.lit("")).alias("src_ip"),
        F.coalesce("dst_ip", F.lit("")).alias("dst_ip"),
        unit.alias("mb_unit_id"),
        number("is_response", 0).alias("is_response"),
        number("mb_func_code", -1).alias("fc"),
        number("mb_reg_addr", -1).alias("addr"),
        number("mb_word_cnt", -1).alias("qty"),
        F.coalesce(coerce.text_to_double(F.col("mb_response_time")), F.lit(-1.0)).alias("resp_time"),
    )
    return rows.where(F.col("ts").isNotNull() & ~F.isnan("ts") & (F.abs("ts") < float("inf")))


def bad_rows(raw: DataFrame) -> DataFrame:
    ts = coerce.text_to_double(F.col("timestamp"))
    return raw.where(ts.isNull() | F.isnan(ts) | (F.abs(ts) == float("inf")))


def negative_bin(gap: Column) -> Column:
    """The bin's name for the size of a negative gap."""
    name = F.lit(f">={NEGATIVE_BINS[-1]}s")
    for bound in reversed(NEGATIVE_BINS):
        name = F.when(gap < bound, f"<{bound}s").otherwise(name)
    return name


def _json(entries: Column) -> Column:
    """Entries (first, name, n) as a JSON object, by first appearance."""
    ordered = F.transform(F.array_sort(entries), lambda e: F.concat(F.lit('"'), e["name"].cast("string"), F.lit('":'), e["n"].cast("string")))
    return F.concat(F.lit("{"), F.array_join(ordered, ","), F.lit("}"))


def _picked(rows: DataFrame, group: list[str], samples: dict[str, tuple[Column, tuple[float, ...]]]) -> DataFrame:
    """For each sample (value, shares): the value in the row that holds the lower quantile of its group, null elsewhere.

    Values are ranked by sorting, which spills, so a group may be of any size.
    """
    for name, (value, shares) in samples.items():
        rows = rows.withColumn(name, value)
        place = F.row_number().over(Window.partitionBy(*group).orderBy(F.col(name).asc_nulls_last())) - 1
        rows = rows.withColumn("place__", place).withColumn("size__", F.count(name).over(Window.partitionBy(*group)))
        for share in shares:
            here = F.col(name).isNotNull() & (F.col("place__") == F.floor(F.lit(share) * (F.col("size__") - 1)))
            rows = rows.withColumn(f"{name}_at_{round(100 * share)}", F.when(here, F.col(name)))
    return rows.drop("place__", "size__")


def metrics(rows: DataFrame, group: list[str], duration: Column, extra: dict[str, Column] | None = None) -> DataFrame:
    """The 35 metrics for each group; ``extra``: further aggregates, by name.

    Quantiles are exact and come from sorted ranks; the rest is merged from partial aggregates. Histograms are counted by
    (group, code) and by (group, bin) before they become one text, so no list has more entries than there are codes. All of
    it rests on one exchange by group.
    """
    extra, gap = extra or {}, F.col("raw_iat")
    samples = {
        "iat": (F.when(gap >= 0, gap), (0.5, 0.95)),
        "negative": (F.when(gap < 0, -gap), (0.99,)),
        "resp": (F.when(F.col("resp_time") > 0, F.col("resp_time")), (0.95,)),
    }
    ranked = _picked(rows, group, samples)
    ranked = ranked.withColumn("qty__", F.when(F.col("qty") > 0, F.col("qty").cast("double"))).withColumn("addr__", F.when(F.col("addr") >= 0, F.col("addr")))

    def moments(name: str, of: str) -> list[Column]:
        return [F.count(of).alias(f"{name}_n"), F.avg(of).alias(f"{name}_mean"), F.stddev_samp(of).alias(f"{name}_std"), F.max(of).alias(f"{name}_max")]

    picked = [F.max(c).alias(c) for c in (f"{name}_at_{round(100 * share)}" for name, (_, shares) in samples.items() for share in shares)]
    merged = ranked.groupBy(*group).agg(
        F.count("*").alias("n"),
        F.count(F.when(F.col("is_response") == 1, 1)).alias("resp"),
        F.count(gap).alias("pairs"),
        F.count(F.when(F.col("iat") < BURST_BELOW, 1)).alias("burst"),
        F.count(F.when(F.col("iat") > IDLE_ABOVE, 1)).alias("idle"),
        F.min("addr__").alias("addr_min"),
        F.max("addr__").alias("addr_max"),
        *moments("iats", "iat"),
        *moments("negatives", "negative"),
        *moments("qtys", "qty__"),
        *moments("resps", "resp"),
        *picked,
        *(c.alias(name) for name, c in extra.items()),
    )

    def histogram(of: Column, out: str) -> DataFrame:
        counted = ranked.withColumn("name", of).where(F.col("name").isNotNull()).groupBy(*group, "name").agg(F.min("seq").alias("first"), F.count("*").alias("n"))
        return counted.groupBy(*group).agg(F.collect_list(F.struct("first", "name", "n")).alias(out))

    merged = merged.join(histogram(F.col("fc"), "codes"), group, "left").join(histogram(F.when(gap < 0, negative_bin(-gap)), "bins"), group, "left")
    merged = merged.withColumn("bins", F.coalesce("bins", F.array().cast("array<struct<first:bigint,name:string,n:bigint>>")))

    def among(values: tuple[int, ...]) -> Column:
        return F.aggregate(F.filter("codes", lambda e: e["name"].isin(*values)), F.lit(0).cast("bigint"), lambda a, e: a + e["n"])

    read, write = among(READ_CODES), among(WRITE_CODES)
    exceptions = F.aggregate(F.filter("codes", lambda e: e["name"] >= EXCEPTION_FROM), F.lit(0).cast("bigint"), lambda a, e: a + e["n"])
    n, req, resp = F.col("n"), F.col("n") - F.col("resp"), F.col("resp")
    span = F.when(F.col("addr_min").isNotNull(), F.col("addr_max") - F.col("addr_min")).otherwise(F.lit(-1).cast("bigint"))
    iats, negatives = F.col("iats_n"), F.col("negatives_n")
    out = {
        "packet_count": n,
        "pps": F.when(duration > 0, n / duration).otherwise(0.0),
        "iat_pairs": F.col("pairs"),
        "iat_count": iats,
        "iat_mean": or_zero(F.col("iats_mean")),
        "iat_std": or_zero(F.col("iats_std")),
        "iat_p50": or_zero(F.col("iat_at_50")),
        "iat_p95": or_zero(F.col("iat_at_95")),
        "burst_ratio": F.when(iats > 0, F.col("burst") / iats).otherwise(0.0),
        "idle_gap_count": F.col("idle"),
        "negative_delta_count": negatives,
        "out_of_order_rate": F.when(F.col("pairs") > 0, negatives / F.col("pairs")).otherwise(0.0),
        "max_negative_delta_sec": or_zero(F.col("negatives_max")),
        "p99_negative_delta_sec": or_zero(F.col("negative_at_99")),
        "negative_delta_hist_json": _json(F.col("bins")),
        "req_count": req,
        "resp_count": resp,
        "req_resp_ratio": F.when(resp > 0, req / resp).otherwise(req.cast("double")),
        "exception_count": exceptions,
        "exception_ratio": exceptions / n,
        "read_count": read,
        "write_count": write,
        "read_write_ratio": F.when(write > 0, read / write).otherwise(read.cast("double")),
        "other_fc_count": n - read - write,
        "fc_hist_json": _json(F.col("codes")),
        "addr_min": F.coalesce("addr_min", F.lit(-1).cast("bigint")),
        "addr_max": F.coalesce("addr_max", F.lit(-1).cast("bigint")),
        "addr_span": span,
        "qty_count": F.col("qtys_n"),
        "qty_mean": or_zero(F.col("qtys_mean")),
        "qty_std": or_zero(F.col("qtys_std")),
        "qty_max": or_zero(F.col("qtys_max")),
        "resp_time_count": F.col("resps_n"),
        "resp_time_mean": or_zero(F.col("resps_mean")),
        "resp_time_p95": or_zero(F.col("resp_at_95")),
    }
    return merged.select(*group, *extra, *(c.alias(name) for name, c in out.items()))


def flow_key() -> Column:
    return F.concat_ws("|", *FLOW)


def window_rows(rows: DataFrame, windows: tuple[int, ...] = WINDOWS, fragment: str | None = None) -> DataFrame:
    """Feature rows of windows: 7 identifying columns and the metrics. ``rows`` with raw_iat."""
    sized = rows.withColumn("window_sec", F.explode(F.array(*map(F.lit, windows))))
    sized = sized.withColumn("window_start_epoch", window_start(F.col("ts"), F.col("window_sec").cast("double")).cast("bigint"))
    group = ["window_sec", "window_start_epoch", *FLOW, *([fragment] if fragment else [])]
    found = metrics(sized, group, F.col("window_sec").cast("double"))
    found = found.withColumn("window_end_epoch", F.col("window_start_epoch") + F.col("window_sec")).withColumn("window_key", flow_key())
    first = ["window_sec", "window_start_epoch", "window_end_epoch", "window_key", *FLOW]
    return found.select(*first, *(c for c in found.columns if c not in first))


def in_sessions(rows: DataFrame, idle: float = SESSION_IDLE, reset: float = SESSION_RESET) -> DataFrame:
    """``rows`` with ``session``, the number of the session within its flow: a new one after a gap over ``idle`` seconds or
    a step back by more than ``reset``. The gap that breaks belongs to the new session."""
    breaks = F.coalesce((F.col("raw_iat") > idle) | (F.col("raw_iat") < -reset), F.lit(True))
    own = Window.partitionBy(*FLOW).orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn("session", F.sum(breaks.cast("bigint")).over(own))


def session_rows(rows: DataFrame, idle: float = SESSION_IDLE, reset: float = SESSION_RESET, number: bool = True) -> DataFrame:
    """Feature rows of sessions: 8 identifying columns and the metrics. Start and end are those of the first and the last
    packet by arrival. ``session_id`` counts from 1 by the first packet's arrival."""
    # arrival order turns first and last by time into a minimum and a maximum of (seq, ts)
    edge = F.struct("seq", "ts")
    grouped = metrics(in_sessions(rows, idle, reset), [*FLOW, "session"], F.lit(0.0), {"min_edge": F.min(edge), "max_edge": F.max(edge)})
    start, end = F.col("min_edge.ts"), F.col("max_edge.ts")
    found = grouped.withColumn("session_start_epoch", start).withColumn("session_end_epoch", end)
    found = found.withColumn("session_duration_sec", F.greatest(end - start, F.lit(0.0))).withColumn("session_key", flow_key())
    found = found.withColumn("pps", F.when(F.col("session_duration_sec") > 0, F.col("packet_count") / F.col("session_duration_sec")).otherwise(0.0))
    if number:
        found = numbered(found, "min_edge.seq", "session_id")
    first = [*(["session_id"] if number else []), "session_start_epoch", "session_end_epoch", "session_duration_sec", "session_key", *FLOW]
    return found.select(*first, *(c for c in found.columns if c not in {*first, "session", "min_edge", "max_edge"}))


def numbered(df: DataFrame, order: str, out: str, ranges: int = 64) -> DataFrame:
    """``out``: 1, 2, ... by ascending unique ``order``, without one task for all: rank within ranges, plus the sizes of
    the ranges before, which are a few numbers."""
    placed = df.withColumn("order__", F.col(order))
    cuts = cut_points(placed, "order__", ranges)
    placed = placed.withColumn("range__", range_of(F.col("order__"), cuts))
    sizes = {r.range__: r["count"] for r in placed.groupBy("range__").count().collect()}
    before = [sum(sizes.get(i, 0) for i in range(k)) for k in range(len(cuts) + 1)]
    rank = F.row_number().over(Window.partitionBy("range__").orderBy("order__"))
    return placed.withColumn(out, rank + F.element_at(F.array(*(F.lit(b).cast("bigint") for b in before)), F.col("range__") + 1)).drop("order__", "range__")


def quality_gate(rate: Column, largest: Column) -> Column:
    """What to do about disorder, by its rate and its largest step back."""
    return F.when(rate <= 1e-4, "none").when((rate <= 1e-3) & (largest <= 1.0), "micro-sort(1~2s)").otherwise("investigate-pipeline-first")


def order_quality(rows: DataFrame) -> DataFrame:
    """One row about all flows' gaps: pairs, negatives, rate, largest, p99, histogram, recommended action.

    Merged from counts by distinct gap, so no task holds all negatives: p99 is read off the running count.
    """
    gaps = rows.where(F.col("raw_iat").isNotNull())
    negative = gaps.where("raw_iat < 0").select((-F.col("raw_iat")).alias("gap"), "seq")
    total = gaps.agg(F.count("*").alias("iat_pairs"), F.count(F.when(F.col("raw_iat") < 0, 1)).alias("negative_delta_count"), F.max(F.when(F.col("raw_iat") < 0, -F.col("raw_iat"))).alias("largest"))
    bins = negative.groupBy(negative_bin(F.col("gap")).alias("name")).agg(F.min("seq").alias("first"), F.count("*").alias("n"))
    histogram = bins.agg(_json(F.collect_list(F.struct("first", "name", "n"))).alias("negative_delta_histogram"))
    at = F.floor(F.lit(0.99) * (F.count("*") - 1))
    # the element at a place of the sorted gaps: numbered by ranges of the gap
    ranked = numbered_any(negative, "gap")
    p99 = ranked.join(negative.agg(at.alias("place__")), F.col("place") == F.col("place__")).agg(F.max("gap").alias("p99"))
    one = F.lit(1).alias("one")
    both = total.select("*", one).join(histogram.select("*", one), "one").join(p99.select("*", one), "one")
    rate = F.when(F.col("iat_pairs") > 0, F.col("negative_delta_count") / F.col("iat_pairs")).otherwise(0.0)
    largest = or_zero(F.col("largest"))
    return both.select("iat_pairs", "negative_delta_count", rate.alias("out_of_order_rate"), largest.alias("max_negative_delta_sec"), F.col("p99").alias("p99_negative_delta_sec"), F.coalesce("negative_delta_histogram", F.lit("{}")).alias("negative_delta_histogram"), quality_gate(rate, largest).alias("recommended_action"))


def numbered_any(df: DataFrame, order: str) -> DataFrame:
    """(order, place): places from 0 by ascending ``order``, ties in any order."""
    cuts = cut_points(df, order, 64)
    placed = df.select(order, range_of(F.col(order), cuts).alias("range__"))
    sizes = {r.range__: r["count"] for r in placed.groupBy("range__").count().collect()}
    before = [sum(sizes.get(i, 0) for i in range(k)) for k in range(len(cuts) + 1)]
    rank = F.row_number().over(Window.partitionBy("range__").orderBy(order))
    return placed.select(order, (rank - 1 + F.element_at(F.array(*(F.lit(b).cast("bigint") for b in before)), F.col("range__") + 1)).alias("place"))


def with_gaps(rows: DataFrame, cuts: list | None = None) -> DataFrame:
    return flow_gaps(rows, FLOW, "ts", "seq", cuts)
