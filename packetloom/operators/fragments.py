"""Window fragments: what a pass over the packets emits that keeps one open window for each flow.

On ordered input there is one row for each flow and window. With disorder, a packet of another window closes the open
one, and a sweep every so many packets closes windows that are over; a window can then give several rows, numbered here.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from packetloom.functions.packets import window_start

SWEEP_EVERY = 100_000


def fragments(packets: DataFrame, keys: list[str], seconds: float, ts: str = "ts", seq: str = "seq", sweep_every: int | None = SWEEP_EVERY) -> DataFrame:
    """``packets`` with ``t0`` and ``fragment``, the number of the emission within the flow.

    seq counts packets from 1. A sweep happens at each multiple of ``sweep_every`` and closes the flows' windows that
    start before the window of that packet. Sweeps are one row in ``sweep_every``; only packets with a sweep since their
    flow's packet before, in the same window, look for them.
    """
    own = Window.partitionBy(*keys).orderBy(seq)
    rows = packets.withColumn("t0", window_start(F.col(ts), seconds))
    rows = rows.withColumn("t0_before__", F.lag("t0").over(own)).withColumn("seq_before__", F.lag(seq).over(own))
    broken = F.col("t0_before__").isNull() | (F.col("t0_before__") != F.col("t0"))
    if sweep_every and keys:
        sweeps = rows.where(F.col(seq) % sweep_every == 0).select((F.col(seq) / sweep_every).cast("long").alias("sweep__"), F.col("t0").alias("sweep_t0__"))
        # a sweep comes after its own packet, so one at the packet before counts and one at this packet doesn't
        first, last = F.ceil(F.col("seq_before__") / sweep_every), F.ceil(F.col(seq) / sweep_every) - 1
        asks = ~broken & (last >= first)
        asked = rows.where(asks).select(*keys, seq, "t0", F.explode(F.sequence(first, last)).alias("sweep__"))
        swept = asked.join(sweeps, "sweep__").where("sweep_t0__ > t0").select(F.col(seq).alias("swept__")).distinct()
        rows = rows.join(swept, F.col(seq) == F.col("swept__"), "left")
        broken = broken | F.col("swept__").isNotNull()
    numbered = rows.withColumn("fragment", F.sum(broken.cast("long")).over(own.rowsBetween(Window.unboundedPreceding, 0)))
    return numbered.select(*packets.columns, "t0", "fragment")
