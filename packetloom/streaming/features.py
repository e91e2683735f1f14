"""Structured Streaming forms: gaps and sessions with state per flow, and windows under a watermark.

Input streams have the packets' columns and ``event_time``, a timestamp made from ``ts`` (see :func:`timed`). State is one
small record a flow, in the state store, kept for good or for a time since the flow's last packet. Recovery is the query's
checkpoint: no packet is lost or counted twice, open windows included. Windows drop packets later than the watermark, where
a batch run would count them; on ordered input both give the same rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import StructType

from packetloom.functions.stats import RATIO_CAP
from packetloom.operators.builder import SESSION_IDLE, SESSION_RESET

LATENESS = "2 seconds"
STATE_STORE = {"spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"}


def timed(packets: DataFrame) -> DataFrame:
    """``event_time`` from ``ts``; the double stays what is computed with."""
    return packets.withColumn("event_time", F.timestamp_micros((F.col("ts") * 1_000_000).cast("bigint")))


def window_counts(packets: DataFrame, keys: list[str], seconds: int, lateness: str = LATENESS) -> DataFrame:
    """Counts, rates and ratios of tumbling windows per flow (``keys`` empty: of all packets), each emitted once it is over.

    The mergeable part of the feature rows: partial sums are combined before the shuffle and kept in the state store.
    """
    count = lambda column: F.sum(F.col(column).cast("bigint"))
    size = F.window("event_time", f"{seconds} seconds")
    found = packets.withWatermark("event_time", lateness).groupBy(size.alias("w"), *keys)
    sums = found.agg(F.count("*").alias("pkt_cnt"), F.sum("pkt_len").alias("byte_cnt"), count("is_request").alias("req_cnt"), count("is_response").alias("resp_cnt"), count("is_exception").alias("exc_cnt"))
    ratio = F.least(F.col("req_cnt") / F.greatest("resp_cnt", F.lit(1)), F.lit(RATIO_CAP))
    return sums.select(
        (F.unix_micros("w.start") / F.lit(1e6)).alias("t0"),
        F.lit(seconds).alias("window_sec"),
        *keys,
        *("pkt_cnt", "byte_cnt", "req_cnt", "resp_cnt", "exc_cnt"),
        (F.col("pkt_cnt") / seconds).alias("pkt_rate"),
        (F.col("byte_cnt") / seconds).alias("byte_rate"),
        ratio.alias("req_resp_ratio"),
        (F.col("exc_cnt") / F.col("pkt_cnt")).alias("exc_ratio"),
    )


class FlowState(StatefulProcessor):
    """Adds to each packet of a flow its signed gap and its session's number, in the order of ``seq`` within a batch."""

    def __init__(self, columns: list[str], idle: float, reset: float, forget_ms: int | None):
        self.columns, self.idle, self.reset, self.forget_ms = columns, idle, reset, forget_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.last = handle.getValueState("last", "ts double, session bigint", ttlDurationMs=self.forget_ms)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        batch = pd.concat(list(rows), ignore_index=True).sort_values("seq", kind="stable", ignore_index=True)
        known = self.last.get() if self.last.exists() else None
        gaps = batch["ts"].diff()
        if known is not None:
            gaps.iloc[0] = batch["ts"].iloc[0] - known[0]
        breaks = gaps.isna() | (gaps > self.idle) | (gaps < -self.reset)
        session = breaks.cumsum() + (known[1] if known is not None else 0)
        self.last.update((float(batch["ts"].iloc[-1]), int(session.iloc[-1])))
        yield batch.assign(raw_iat=gaps, session=session.astype("int64"))[self.columns]

    def close(self) -> None:
        pass


def with_flow_state(packets: DataFrame, keys: list[str], idle: float = SESSION_IDLE, reset: float = SESSION_RESET, forget_ms: int | None = None) -> DataFrame:
    """``packets`` with raw_iat and session, as the batch operators give them. Needs the RocksDB state store.

    ``forget_ms``: drop a flow's state so long after its last packet. Spark then wakes up for expiry without new data, so
    leave it out where a query runs over what is there and ends.
    """
    schema = StructType(list(packets.schema.fields)).add("raw_iat", "double").add("session", "long")
    processor = FlowState(schema.names, idle, reset, forget_ms)
    return packets.groupBy(*keys).transformWithStateInPandas(processor, outputStructType=schema, outputMode="Append", timeMode="ProcessingTime" if forget_ms else "None")
