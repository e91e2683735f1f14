"""Feature rows of tumbling windows: the Modbus family (26 columns) and the MQTT family (64 columns).

A packet has seq, ts, pkt_len, fc, is_request, is_response, is_exception, delta_source, inter and neg_delta, and the MQTT
columns where that family is asked for. Groups are (keys, window, t0) and, where given, a fragment number. All counts are
merged from partial sums by (group, fc); samples are the last 4,096 of a group, so no list is longer than that.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from packetloom.functions import stats
from packetloom.functions.packets import known_source, window_start

TAIL, WINDOWS, KEY_PACKETS = 4096, (1, 5, 30), 20

#: Names of MQTT message types 1 to 14, and which of them acknowledge.
MQTT_TYPES = ("connect", "connack", "publish", "puback", "pubrec", "pubrel", "pubcomp", "subscribe", "suback", "unsubscribe", "unsuback", "pingreq", "pingresp", "disconnect")
MQTT_ACKS = (4, 5, 6, 7, 9, 11)


@dataclass(frozen=True)
class Family:
    schema_version: str
    key: tuple[str, ...]
    mqtt: bool = False


MODBUS = Family("v1", ("src_ip", "dst_ip", "unit_id"))
MQTT = Family("mqtt_v1", ("src_ip", "dst_ip", "dst_port"), mqtt=True)


def in_windows(packets: DataFrame, windows: tuple[float, ...] = WINDOWS) -> DataFrame:
    """Each packet once for each window size, with ``window_sec`` and ``t0``: one scan feeds them all."""
    sized = packets.withColumn("window_sec", F.explode(F.array(*(F.lit(w) for w in windows))))
    return sized.withColumn("t0", window_start(F.col("ts"), F.col("window_sec").cast("double")))


def _tails(rows: DataFrame, group: list[str], samples: dict[str, tuple[Column, Column]]) -> DataFrame:
    """For each sample (value, condition): the value if it is among the group's last 4,096 that meet it, else null.

    One sort by group serves all samples, and the groups' aggregation after it needs no further exchange.
    """
    latest = Window.partitionBy(*group).orderBy(F.col("seq").desc()).rowsBetween(Window.unboundedPreceding, 0)
    for name, (value, met) in samples.items():
        place = F.sum(F.when(met, 1).otherwise(0)).over(latest)
        rows = rows.withColumn(name, F.when(met & (place <= TAIL), value.cast("double")))
    return rows


def _count(met: Column) -> Column:
    return F.count(F.when(met, 1))


def _histogram(column: str) -> Column:
    """Counts of the values of ``column`` (0 and above) from the entries of ``histogram``."""
    of = F.filter("histogram", lambda e: e[column] >= 0)
    values = F.array_distinct(F.transform(of, lambda e: e[column]))
    return F.transform(F.array_sort(values), lambda v: F.aggregate(F.filter(of, lambda e: e[column] == v), F.lit(0.0), lambda a, e: a + e["n"]))


def _of_type(*types: int) -> Column:
    return F.aggregate(F.filter("histogram", lambda e: e["fc"].isin(*types)), F.lit(0).cast("bigint"), lambda a, e: a + e["n"])


def features(rows: DataFrame, family: Family = MODBUS, keys: tuple[str, ...] | None = None, fragment: str | None = None) -> DataFrame:
    """``rows`` (from :func:`in_windows`) to feature rows; ``keys`` empty: over all flows.

    Flow rows have the key columns, global ones don't; ``key_type`` tells. See :func:`rendered` for the documents' form.
    """
    keys = family.key if keys is None else keys
    group = [*keys, "window_sec", "t0", *([fragment] if fragment else [])]
    publish = F.col("fc") == 3
    samples = {"inter__": (F.col("inter"), F.col("inter") > 0)}
    if family.mqtt:
        samples |= {"topic__": (F.col("mqtt_topic_len"), F.col("mqtt_topic_len") >= 0), "payload__": (F.col("mqtt_payload_len"), publish)}
    source = known_source(F.col("delta_source"))
    sums = {
        "pkt_cnt": F.count("*"),
        "byte_cnt": F.sum("pkt_len"),
        "req_cnt": _count(F.col("is_request") == 1),
        "resp_cnt": _count(F.col("is_response") == 1),
        "exc_cnt": _count(F.col("is_exception") == 1),
        "neg_delta_cnt": F.sum(F.col("neg_delta").cast("bigint")),
        "delta_src_frame_cnt": _count(source == "frame"),
        "delta_src_tcp_cnt": _count(source == "tcp"),
        "delta_src_none_cnt": _count(source == "none"),
    }
    if family.mqtt:
        sums |= {f"pub_qos{q}": _count(publish & (F.col("mqtt_qos") == q)) for q in (0, 1, 2)}
        sums |= {"pub_dup": _count(publish & (F.col("mqtt_dup") > 0)), "pub_retain": _count(publish & (F.col("mqtt_retain") > 0)), "pub_nonempty": _count(publish & (F.col("mqtt_payload_len") > 0))}
    by = ["fc", *(["mqtt_topic_bucket"] if family.mqtt else [])]
    partial = _tails(rows, group, samples).groupBy(*group, *by).agg(*(c.alias(n) for n, c in sums.items()), *(F.collect_list(s).alias(s) for s in samples))
    entry = F.struct(*by, F.col("pkt_cnt").alias("n"))
    merged = partial.groupBy(*group).agg(*(F.sum(n).alias(n) for n in sums), F.collect_list(entry).alias("histogram"), *(F.array_sort(F.flatten(F.collect_list(s))).alias(s) for s in samples))

    width, packets = F.col("window_sec").cast("double"), F.greatest(F.col("pkt_cnt"), F.lit(1))
    p50, p95 = stats.lower_quantile(F.col("inter__"), 0.5), stats.lower_quantile(F.col("inter__"), 0.95)
    of_fc = merged.withColumn("fc__", _histogram("fc"))
    out: dict[str, Column] = {"schema_version": F.lit(family.schema_version)}
    if family.mqtt:
        out |= {"protocol": F.lit("mqtt"), "feature_family": F.lit("common_v1+mqtt_v1")}
    out |= {
        "t0": F.col("t0"),
        "window_sec": F.col("window_sec"),
        "key_type": F.lit("flow" if keys else "global"),
        **{k: F.col(k) for k in keys},
        **({fragment: F.col(fragment)} if fragment else {}),
        "pkt_cnt": F.col("pkt_cnt"),
        "byte_cnt": F.col("byte_cnt"),
        "pkt_rate": F.col("pkt_cnt") / width,
        "byte_rate": F.col("byte_cnt") / width,
        "req_cnt": F.col("req_cnt"),
        "resp_cnt": F.col("resp_cnt"),
        "req_resp_ratio": F.least(F.col("req_cnt") / F.greatest(F.col("resp_cnt"), F.lit(1)), F.lit(stats.RATIO_CAP)),
        "exc_cnt": F.col("exc_cnt"),
        "exc_ratio": F.col("exc_cnt") / packets,
        "fc_unique_cnt": F.size("fc__").cast("bigint"),
        "fc_entropy": stats.entropy(F.col("fc__")),
        "inter_cnt_pos": F.size("inter__").cast("bigint"),
        "inter_mean": stats.mean(F.col("inter__")),
        "inter_std": stats.deviation(F.col("inter__")),
        "inter_p50": p50,
        "inter_p95": p95,
        "burstiness": p95 / F.greatest(p50, F.lit(stats.EPS)),
        **{n: F.col(n) for n in ("neg_delta_cnt", "delta_src_frame_cnt", "delta_src_tcp_cnt", "delta_src_none_cnt")},
    }
    if family.mqtt:
        of_fc = of_fc.withColumn("buckets__", _histogram("mqtt_topic_bucket"))
        published = F.greatest(_of_type(3), F.lit(1))
        out |= {"mqtt_type_unique_cnt": F.size("fc__").cast("bigint"), "mqtt_type_entropy": stats.entropy(F.col("fc__"))}
        out |= {f"mqtt_type_{name}_cnt": _of_type(i) for i, name in enumerate(MQTT_TYPES, 1)}
        out |= {"pub_cnt": _of_type(3)}
        out |= {f"pub_{name}_ratio": F.col(f"pub_{short}") / published for name, short in (("qos0", "qos0"), ("qos1", "qos1"), ("qos2", "qos2"), ("dup", "dup"), ("retain", "retain"), ("payload_nonempty", "nonempty"))}
        out |= {f"pub_payload_len_{n}": c for n, c in _spread("payload__").items()}
        out |= {"topic_unique_cnt": F.size("buckets__").cast("bigint"), "topic_entropy": stats.entropy(F.col("buckets__"))}
        out |= {f"topic_len_{n}": c for n, c in _spread("topic__").items()}
        out |= {"pub_to_sub_ratio": _of_type(3) / F.greatest(_of_type(8), F.lit(1)), "ping_ratio": _of_type(12, 13) / packets, "ack_ratio": _of_type(*MQTT_ACKS) / packets}
    return of_fc.select(*(c.alias(n) for n, c in out.items()))


def _spread(sample: str) -> dict[str, Column]:
    values = F.col(sample)
    return {"mean": stats.mean(values), "std": stats.deviation(values), "p50": stats.lower_quantile(values, 0.5), "p95": stats.lower_quantile(values, 0.95)}


def routed(rows: DataFrame, least: int = KEY_PACKETS) -> DataFrame:
    """``kind``: key for flow rows of at least ``least`` packets, sparse for other flow rows, global for the rest."""
    return rows.withColumn("kind", F.when(F.col("key_type") == "global", "global").when(F.col("pkt_cnt") >= least, "key").otherwise("sparse"))


def rendered(rows: DataFrame, family: Family = MODBUS) -> DataFrame:
    """Rows as JSON documents in column ``value``, the key columns as one object (or ``__global__``), kind and window kept."""
    flow = [k for k in family.key if k in rows.columns]
    key = F.struct(*flow).alias("key") if flow else F.lit("__global__").alias("key")
    columns, placed = [], False
    for name in rows.columns:
        if name in flow or name in ("kind", "fragment"):
            continue
        columns.append(F.col(name))
        if name == "key_type" and not placed:
            columns.append(key)
            placed = True
    return rows.select("window_sec", *(["kind"] if "kind" in rows.columns else []), F.to_json(F.struct(*columns), {"ignoreNullFields": "false"}).alias("value"))
