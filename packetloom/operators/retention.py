"""Post-processing of window features: which flows to keep, a bucket for the others, and chronological splits.

Works on flow rows of one window size: the key columns, t0, window_sec, the counters, ``file_rank`` (0 for key files, 1 for
sparse ones) and ``seq`` (order within the file). Kept flows are at most the top k, so joins with them can be broadcast.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from packetloom.operators.arrival import cut_points, range_of
from packetloom.operators.window_features import MODBUS

#: How many flows are kept, by window size; shares of train and validation rows.
TOP_FLOWS = {1: 100_000, 5: 50_000, 30: 20_000}
SPLITS = (0.7, 0.1)
#: Kept keys are broadcast up to this many; beyond, Spark picks the join.
BROADCAST_KEYS = 100_000

COUNTERS = ("pkt_cnt", "byte_cnt", "req_cnt", "resp_cnt", "exc_cnt", "inter_cnt_pos", "neg_delta_cnt", "delta_src_frame_cnt", "delta_src_tcp_cnt", "delta_src_none_cnt")
#: Columns that aren't known for the bucket of the others.
UNKNOWN = ("fc_unique_cnt", "fc_entropy", "inter_mean", "inter_std", "inter_p50", "inter_p95", "burstiness")
OTHER = "__other__"


def flow_rows(key_rows: DataFrame, sparse_rows: DataFrame) -> DataFrame:
    """Flow rows of both files, key file first: UNION ALL with the file's rank. Stable order is (t0, file_rank, seq)."""
    ranked = [rows.where(F.col("key_type") == "flow").withColumn("file_rank", F.lit(i)) for i, rows in enumerate((key_rows, sparse_rows))]
    return ranked[0].unionByName(ranked[1])


def in_order(rows: DataFrame, *by: str) -> DataFrame:
    """Ascending ``by``, t0, kept rows before others, and place in the files, as far as ``rows`` has these columns."""
    return rows.orderBy(*by, *(c for c in ("t0", "part", "file_rank", "seq") if c in rows.columns))


def boundaries(rows: DataFrame, splits: tuple[float, float] = SPLITS) -> tuple[float, float] | None:
    """(last t0 of train, last t0 of validation) by row counts; None without rows.

    From counts by distinct t0: the running count says at which t0 the row of a given place stands. Two numbers and the
    row count reach the driver.
    """
    n = rows.count()
    if not n:
        return None
    train = max(0, min(n - 1, int(n * splits[0]) - 1))
    validation = max(train, min(n - 1, int(n * (splits[0] + splits[1])) - 1))
    counts = rows.groupBy("t0").count()
    cuts = cut_points(counts, "t0", 64)
    placed = counts.withColumn("range__", range_of(F.col("t0"), cuts))
    sizes = {r.range__: r.n for r in placed.groupBy("range__").agg(F.sum("count").alias("n")).collect()}
    found = []
    for place in (train, validation):
        before = 0
        for k in range(len(cuts) + 1):
            if before + sizes.get(k, 0) > place:
                break
            before += sizes.get(k, 0)
        running = F.sum("count").over(Window.partitionBy("range__").orderBy("t0"))
        found.append(placed.where(F.col("range__") == k).withColumn("to", running).where(F.col("to") > place - before).agg(F.min("t0")).first()[0])
    return found[0], found[1]


def split_of(t0: Column, ends: tuple[float, float]) -> Column:
    return F.when(t0 <= ends[0], "train").when(t0 <= ends[1], "val").otherwise("test")


def key_json(keys: tuple[str, ...]) -> Column:
    return F.to_json(F.struct(*sorted(keys)), {"ignoreNullFields": "false"})


def key_documents(kept: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """Column ``value``: a document for each kept key, by ascending key."""
    found = kept.select(key_json(keys).alias("key")).orderBy("key")
    return found.select(F.concat(F.lit('{"key":'), "key", F.lit(',"source_split":"train"}')).alias("value"))


def flow_totals(rows: DataFrame, train_end: float, keys: tuple[str, ...] = MODBUS.key) -> DataFrame:
    """Packets of each flow before the end of train; up to it, if there are none before. ``first``: first row by order."""
    strict = rows.where(F.col("t0") < train_end)
    chosen = strict if not strict.isEmpty() else rows.where(F.col("t0") <= train_end)
    return chosen.groupBy(*keys).agg(F.sum("pkt_cnt").alias("packets"), F.min(F.struct("t0", "file_rank", "seq")).alias("first"))


def kept_keys(rows: DataFrame, train_end: float, k: int, keys: tuple[str, ...] = MODBUS.key) -> DataFrame:
    """The ``k`` flows with the most packets in train; ties by first row."""
    return flow_totals(rows, train_end, keys).orderBy(F.col("packets").desc(), "first").limit(k).select(*keys, "packets")


def _matched(rows: DataFrame, kept: DataFrame, keys: tuple[str, ...], how: str, k: int) -> DataFrame:
    right = kept.select(*(F.col(c).alias(f"{c}__k") for c in keys))
    same = F.lit(True)
    for c in keys:
        same = same & F.col(c).eqNullSafe(F.col(f"{c}__k"))
    return rows.join(F.broadcast(right) if k <= BROADCAST_KEYS else right, same, how)


def kept_rows(rows: DataFrame, kept: DataFrame, k: int, keys: tuple[str, ...] = MODBUS.key) -> DataFrame:
    return _matched(rows, kept, keys, "left_semi", k)


def other_rows(rows: DataFrame, kept: DataFrame, k: int, keys: tuple[str, ...] = MODBUS.key) -> DataFrame:
    """One row for each t0 with the sums of all flows that aren't kept; what can't be summed is null."""
    sums = _matched(rows, kept, keys, "left_anti", k).groupBy("t0", "window_sec").agg(*(F.sum(c).alias(c) for c in COUNTERS))
    width, packets = F.greatest(F.col("window_sec").cast("double"), F.lit(1.0)), F.greatest(F.col("pkt_cnt"), F.lit(1))
    types = dict(rows.dtypes)
    derived = {
        "schema_version": F.lit("v1"),
        "key_type": F.lit("flow"),
        **{c: F.lit(OTHER if types.get(c) == "string" else -1).cast(types.get(c, "string")) for c in keys},
        "pkt_rate": F.col("pkt_cnt") / width,
        "byte_rate": F.col("byte_cnt") / width,
        "req_resp_ratio": F.col("req_cnt") / F.greatest(F.col("resp_cnt"), F.lit(1)),
        "exc_ratio": F.col("exc_cnt") / packets,
        **{c: F.lit(None).cast(types.get(c, "double")) for c in UNKNOWN},
    }
    names = [c for c in rows.columns if c not in ("file_rank", "seq")]
    return sums.select(*(derived[c].alias(c) if c in derived else F.col(c) for c in names))


def all_flow_rows(kept: DataFrame, other: DataFrame) -> DataFrame:
    """Kept rows, then the others, as one table; on equal t0 kept rows come first (``part``), in their order if they have one."""
    names = [*other.columns, *(c for c in ("file_rank", "seq") if c in kept.columns)]
    return kept.select(*names, F.lit(0).alias("part")).unionByName(other.withColumn("part", F.lit(1)), allowMissingColumns=True)


def split_counts(rows: DataFrame, ends: tuple[float, float]) -> DataFrame:
    return rows.groupBy(split_of(F.col("t0"), ends).alias("split")).agg(F.count("*").alias("n"))
