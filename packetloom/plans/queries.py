"""Registered queries: the engine's operators over the driver's tables, each beside SQL that computes the same plainly.

``events`` and ``orders`` are seen as packets. Events come in order, orders by key don't, so they serve the operators on
disorder. Windows are hours instead of seconds, as events are minutes apart. Floating results are rounded to 6 places.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from packetloom.functions import coerce, packets
from packetloom.operators import arrival, builder, flatten, fragments, protocols, retention, window_features
from packetloom.plans.jobs import feature_rows

HOURS = (3600, 18000, 108000)
SESSION_GAP = 21600.0
Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def register(made: Query) -> Query:
        QUERIES[made.__name__] = made
        if sql:
            ORACLES[made.__name__] = sql
        return made

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A driver table; times without a zone are UTC, which is the session's."""
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return df.select(*(F.col(c).cast("timestamp") if t == "timestamp_ntz" else F.col(c) for c, t in df.dtypes))


def rounded(df: DataFrame, places: int = 6) -> DataFrame:
    """Doubles to so many places, without a negative zero."""
    return df.select(*(F.round(F.col(c), places).alias(c) + F.lit(0.0) if t == "double" else F.col(c) for c, t in df.dtypes)).toDF(*df.columns)


# --- events and orders as packets -------------------------------------------------------------------------------

EVENTS_SQL = """
SELECT event_id AS seq, epoch_us(ts) / 1e6 AS ts, '10.0.0.' || length(event_type) AS src_ip, '10.0.1.' || (user_id % 2) AS dst_ip,
  user_id % 3 AS unit_id, user_id % 3 AS dst_port, CAST(json_extract(props, '$.k') AS BIGINT) AS k, event_id % 2 AS is_response,
  1 - event_id % 2 AS is_request, CASE event_type WHEN 'view' THEN 1 WHEN 'click' THEN 3 WHEN 'signup' THEN 6 WHEN 'purchase' THEN 16 ELSE 131 END AS fc,
  CASE event_id % 3 WHEN 0 THEN 'frame' WHEN 1 THEN 'tcp' ELSE 'none' END AS delta_source,
  event_type || '/' || user_id AS topic, event_id, user_id, event_type, value
FROM events"""


def event_packets(spark: SparkSession, sf_dir: str) -> DataFrame:
    kinds = {"view": 1, "click": 3, "signup": 6, "purchase": 16}
    code = F.lit(131)
    for kind, n in kinds.items():
        code = F.when(F.col("event_type") == kind, n).otherwise(code)
    n = F.col("event_id")
    return table(spark, sf_dir, "events").select(
        n.alias("seq"),
        (F.unix_micros("ts") / F.lit(1e6)).alias("ts"),
        F.concat(F.lit("10.0.0."), F.length("event_type").cast("string")).alias("src_ip"),
        F.concat(F.lit("10.0.1."), (F.col("user_id") % 2).cast("string")).alias("dst_ip"),
        (F.col("user_id") % 3).alias("unit_id"),
        (F.col("user_id") % 3).alias("dst_port"),
        F.get_json_object("props", "$.k").cast("bigint").alias("k"),
        (n % 2).alias("is_response"),
        (1 - n % 2).alias("is_request"),
        code.cast("bigint").alias("fc"),
        F.when(n % 3 == 0, "frame").when(n % 3 == 1, "tcp").otherwise("none").alias("delta_source"),
        F.concat(F.col("event_type"), F.lit("/"), F.col("user_id").cast("string")).alias("topic"),
        "event_id",
        "user_id",
        "event_type",
        "value",
    )


MODBUS_SQL = f"SELECT seq, ts, 60 + k AS pkt_len, src_ip, dst_ip, unit_id, fc, is_request, is_response, CASE WHEN fc >= 128 THEN 1 ELSE 0 END AS is_exception, delta_source FROM ({EVENTS_SQL})"
MQTT_SQL = f"""SELECT seq, ts, 60 + k AS pkt_len, src_ip, dst_ip, dst_port, 1 + event_id % 14 AS fc, is_request, is_response, 0 AS is_exception, delta_source,
  event_id % 3 AS mqtt_qos, CASE WHEN event_id % 5 = 0 THEN 1 ELSE 0 END AS mqtt_dup, CASE WHEN event_id % 7 = 0 THEN 1 ELSE 0 END AS mqtt_retain,
  CASE WHEN event_id % 4 = 0 THEN -1 ELSE length(topic) END AS mqtt_topic_len,
  CASE WHEN event_id % 4 = 0 THEN -1 ELSE CAST('0x' || right(sha1(topic), 3) AS BIGINT) % 1024 END AS mqtt_topic_bucket, k % 11 AS mqtt_payload_len FROM ({EVENTS_SQL})"""


def modbus_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    exception = F.when(F.col("fc") >= 128, 1).otherwise(0).alias("is_exception")
    return event_packets(spark, sf_dir).select("seq", "ts", (60 + F.col("k")).alias("pkt_len"), "src_ip", "dst_ip", "unit_id", "fc", "is_request", "is_response", exception, "delta_source")


def mqtt_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    n, topic = F.col("event_id"), F.when(F.col("event_id") % 4 != 0, F.col("topic"))
    flag = lambda m: F.when(n % m == 0, 1).otherwise(0)
    return event_packets(spark, sf_dir).select(
        "seq", "ts", (60 + F.col("k")).alias("pkt_len"), "src_ip", "dst_ip", "dst_port", (1 + n % 14).alias("fc"), "is_request", "is_response", F.lit(0).alias("is_exception"), "delta_source",
        (n % 3).alias("mqtt_qos"), flag(5).alias("mqtt_dup"), flag(7).alias("mqtt_retain"), packets.topic_length(topic).alias("mqtt_topic_len"), packets.topic_bucket(topic).alias("mqtt_topic_bucket"), (F.col("k") % 11).alias("mqtt_payload_len"),
    )


ORDERS_SQL = """SELECT o_orderkey AS seq, epoch_us(o_orderdate) / 1e6 + (o_orderkey % 1000) / 8.0 AS ts, '10.1.0.' || (o_custkey % 20) AS src_ip, '10.1.1.1' AS dst_ip,
  CAST(o_custkey % 2 AS VARCHAR) AS mb_unit_id, o_orderkey % 2 AS is_response, o_orderkey % 23 + CASE WHEN o_orderkey % 29 = 0 THEN 128 ELSE 0 END AS fc,
  CASE WHEN o_orderkey % 7 = 0 THEN -1 ELSE o_orderkey % 500 END AS addr, o_orderkey % 9 - 1 AS qty, o_totalprice AS resp_time FROM orders"""


def order_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("o_orderkey")
    return table(spark, sf_dir, "orders").select(
        n.alias("seq"),
        (F.unix_micros("o_orderdate") / F.lit(1e6) + (n % 1000) / F.lit(8.0)).alias("ts"),
        F.concat(F.lit("10.1.0."), (F.col("o_custkey") % 20).cast("string")).alias("src_ip"),
        F.lit("10.1.1.1").alias("dst_ip"),
        (F.col("o_custkey") % 2).cast("string").alias("mb_unit_id"),
        (n % 2).alias("is_response"),
        (n % 23 + F.when(n % 29 == 0, 128).otherwise(0)).alias("fc"),
        F.when(n % 7 == 0, F.lit(-1).cast("bigint")).otherwise(n % 500).alias("addr"),
        (n % 9 - 1).alias("qty"),
        F.col("o_totalprice").alias("resp_time"),
    )


# --- SQL pieces ---------------------------------------------------------------------------------------------------


def r6(expression: str, name: str, places: int = 6) -> str:
    return f"round(CAST({expression} AS DOUBLE), {places}) + 0.0 AS {name}"


def r3(expression: str, name: str) -> str:
    """For the builder, whose gaps between orders are tens of millions of seconds."""
    return r6(expression, name, 3)


def sql_quantile(values: str, p: float) -> str:
    """Of a sorted list."""
    return f"CASE WHEN len({values}) > 0 THEN {values}[CAST(floor(CAST({p} AS DOUBLE) * (len({values}) - 1)) AS BIGINT) + 1] ELSE 0 END"


def sql_features(source: str, keys: tuple[str, ...], windows: tuple[int, ...], mqtt: bool = False) -> str:
    """Feature rows by plain aggregation."""
    by = ", ".join([*keys, "window_sec", "t0"])
    part = f"PARTITION BY {', '.join(keys)}" if keys else ""
    latest = f"OVER (PARTITION BY {by} ORDER BY seq DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"
    family = "mqtt_v1" if mqtt else "v1"
    tails = {"i": ("inter", "inter > 0")} | ({"tl": ("mqtt_topic_len", "mqtt_topic_len >= 0"), "pl": ("mqtt_payload_len", "fc = 3")} if mqtt else {})
    runs = ", ".join(f"sum(CASE WHEN {met} THEN 1 ELSE 0 END) {latest} AS {n}_n" for n, (_, met) in tails.items())
    lists = ", ".join(f"list_sort(coalesce(list(CAST({v} AS DOUBLE)) FILTER (WHERE {met} AND {n}_n <= 4096), [])) AS {n}" for n, (v, met) in tails.items())
    counters = """count(*) AS pkt_cnt, CAST(sum(pkt_len) AS BIGINT) AS byte_cnt, count(*) FILTER (WHERE is_request = 1) AS req_cnt, count(*) FILTER (WHERE is_response = 1) AS resp_cnt,
      count(*) FILTER (WHERE is_exception = 1) AS exc_cnt, CAST(sum(neg) AS BIGINT) AS neg_delta_cnt, count(*) FILTER (WHERE delta_source = 'frame') AS delta_src_frame_cnt,
      count(*) FILTER (WHERE delta_source = 'tcp') AS delta_src_tcp_cnt, count(*) FILTER (WHERE delta_source NOT IN ('frame', 'tcp')) AS delta_src_none_cnt"""
    if mqtt:
        counters += ", " + ", ".join(f"count(*) FILTER (WHERE fc = {i}) AS type_{i}" for i in range(1, 15))
        counters += ", " + ", ".join(f"count(*) FILTER (WHERE fc = 3 AND {met}) AS p_{n}" for n, met in (("qos0", "mqtt_qos = 0"), ("qos1", "mqtt_qos = 1"), ("qos2", "mqtt_qos = 2"), ("dup", "mqtt_dup > 0"), ("retain", "mqtt_retain > 0"), ("full", "mqtt_payload_len > 0")))

    def entropies(column: str, name: str) -> str:
        return f"""{name} AS (SELECT {by}, count(*) AS {name}_unique, sum(-(n / total) * ln(n / total + 1e-9)) AS {name}_entropy FROM
          (SELECT {by}, {column}, CAST(count(*) AS DOUBLE) AS n, sum(CAST(count(*) AS DOUBLE)) OVER (PARTITION BY {by}) AS total FROM w WHERE {column} >= 0 GROUP BY {by}, {column}) GROUP BY {by})"""

    def spread(n: str, name: str) -> list[str]:
        return [r6(f"coalesce(list_avg({n}), 0)", f"{name}_mean"), r6(f"coalesce(list_stddev_pop({n}), 0)", f"{name}_std"), r6(sql_quantile(n, 0.5), f"{name}_p50"), r6(sql_quantile(n, 0.95), f"{name}_p95")]

    q50, q95 = sql_quantile("i", 0.5), sql_quantile("i", 0.95)
    columns = [f"'{family}' AS schema_version", *(["'mqtt' AS protocol", "'common_v1+mqtt_v1' AS feature_family"] if mqtt else []), "t0", "window_sec", f"'{'flow' if keys else 'global'}' AS key_type", *keys, "pkt_cnt", "byte_cnt", r6("pkt_cnt / CAST(window_sec AS DOUBLE)", "pkt_rate"), r6("byte_cnt / CAST(window_sec AS DOUBLE)", "byte_rate"), "req_cnt", "resp_cnt"]
    columns += [r6("least(CAST(req_cnt AS DOUBLE) / greatest(resp_cnt, 1), 1e6)", "req_resp_ratio"), "exc_cnt", r6("CAST(exc_cnt AS DOUBLE) / pkt_cnt", "exc_ratio"), "coalesce(f_unique, 0) AS fc_unique_cnt", r6("coalesce(f_entropy, 0)", "fc_entropy"), "len(i) AS inter_cnt_pos", *spread("i", "inter"), r6(f"({q95}) / greatest(CAST(({q50}) AS DOUBLE), 1e-9)", "burstiness"), "neg_delta_cnt", "delta_src_frame_cnt", "delta_src_tcp_cnt", "delta_src_none_cnt"]
    if mqtt:
        columns += ["coalesce(f_unique, 0) AS mqtt_type_unique_cnt", r6("coalesce(f_entropy, 0)", "mqtt_type_entropy"), *(f"type_{i} AS mqtt_type_{n}_cnt" for i, n in enumerate(window_features.MQTT_TYPES, 1)), "type_3 AS pub_cnt"]
        columns += [r6(f"CAST(p_{n} AS DOUBLE) / greatest(type_3, 1)", f"pub_{name}_ratio") for n, name in (("qos0", "qos0"), ("qos1", "qos1"), ("qos2", "qos2"), ("dup", "dup"), ("retain", "retain"), ("full", "payload_nonempty"))]
        columns += [*spread("pl", "pub_payload_len"), "coalesce(b_unique, 0) AS topic_unique_cnt", r6("coalesce(b_entropy, 0)", "topic_entropy"), *spread("tl", "topic_len")]
        acks = " + ".join(f"type_{i}" for i in window_features.MQTT_ACKS)
        columns += [r6("CAST(type_3 AS DOUBLE) / greatest(type_8, 1)", "pub_to_sub_ratio"), r6("CAST(type_12 + type_13 AS DOUBLE) / pkt_cnt", "ping_ratio"), r6(f"CAST({acks} AS DOUBLE) / pkt_cnt", "ack_ratio")]
    return f"""WITH p AS ({source}), g AS (SELECT *, ts - lag(ts) OVER ({part} ORDER BY seq) AS raw FROM p),
      c AS (SELECT *, CASE WHEN raw IS NULL OR raw < 0 THEN 0.0 ELSE raw END AS inter, CASE WHEN raw < 0 THEN 1 ELSE 0 END AS neg FROM g),
      s AS (SELECT *, floor(ts / size) * size AS t0, CAST(size AS INTEGER) AS window_sec FROM c CROSS JOIN (SELECT unnest({list(windows)}) AS size)),
      w AS (SELECT *, {runs} FROM s), a AS (SELECT {by}, {counters}, {lists} FROM w GROUP BY {by}), {entropies('fc', 'f')}{', ' + entropies('mqtt_topic_bucket', 'b') if mqtt else ''}
      SELECT {', '.join(columns)} FROM a LEFT JOIN f USING ({by}){f' LEFT JOIN b USING ({by})' if mqtt else ''}"""


def sql_metrics(source: str, group: str, duration: str, identity: list[str]) -> str:
    """The builder's 35 metrics. ``source`` has the rows with raw_iat and the group's columns."""
    bins = "CASE WHEN -raw_iat < 0.001 THEN '<0.001s' WHEN -raw_iat < 0.01 THEN '<0.01s' WHEN -raw_iat < 0.1 THEN '<0.1s' WHEN -raw_iat < 1.0 THEN '<1.0s' ELSE '>=1.0s' END"

    def histogram(column: str, where: str, name: str) -> str:
        return f"""{name} AS (SELECT {group}, '{{' || string_agg('"' || v || '":' || n, ',' ORDER BY first) || '}}' AS {name}_json FROM
          (SELECT {group}, {column} AS v, count(*) AS n, min(seq) AS first FROM r WHERE {where} GROUP BY {group}, {column}) GROUP BY {group})"""

    count = lambda met: f"count(*) FILTER (WHERE {met})"
    lists = {"iats": ("raw_iat", "raw_iat >= 0"), "negs": ("-raw_iat", "raw_iat < 0"), "qtys": ("CAST(qty AS DOUBLE)", "qty > 0"), "resps": ("resp_time", "resp_time > 0")}
    sums = ", ".join(f"list_sort(coalesce(list({v}) FILTER (WHERE {met}), [])) AS {n}" for n, (v, met) in lists.items())
    one = lambda n, f: f"coalesce({f}({n}), 0)"
    deviation = lambda n: f"CASE WHEN len({n}) > 1 THEN list_stddev_samp({n}) ELSE 0 END"
    columns = [
        *identity, "packet_count", r3(f"CASE WHEN {duration} > 0 THEN packet_count / {duration} ELSE 0 END", "pps"), "iat_pairs", "len(iats) AS iat_count", r3(one("iats", "list_avg"), "iat_mean"), r3(deviation("iats"), "iat_std"),
        r3(sql_quantile("iats", 0.5), "iat_p50"), r3(sql_quantile("iats", 0.95), "iat_p95"), r3("CASE WHEN len(iats) > 0 THEN CAST(burst AS DOUBLE) / len(iats) ELSE 0 END", "burst_ratio"), "idle_gap_count", "len(negs) AS negative_delta_count",
        r3("CASE WHEN iat_pairs > 0 THEN CAST(len(negs) AS DOUBLE) / iat_pairs ELSE 0 END", "out_of_order_rate"), r3(one("negs", "list_max"), "max_negative_delta_sec"), r3(sql_quantile("negs", 0.99), "p99_negative_delta_sec"),
        "coalesce(hn_json, '{}') AS negative_delta_hist_json", "req_count", "resp_count", r3("CASE WHEN resp_count > 0 THEN CAST(req_count AS DOUBLE) / resp_count ELSE req_count END", "req_resp_ratio"), "exception_count", r3("CAST(exception_count AS DOUBLE) / packet_count", "exception_ratio"),
        "read_count", "write_count", r3("CASE WHEN write_count > 0 THEN CAST(read_count AS DOUBLE) / write_count ELSE read_count END", "read_write_ratio"), "packet_count - read_count - write_count AS other_fc_count", "coalesce(hf_json, '{}') AS fc_hist_json",
        "coalesce(amin, -1) AS addr_min", "coalesce(amax, -1) AS addr_max", "coalesce(amax - amin, -1) AS addr_span", "len(qtys) AS qty_count", r3(one("qtys", "list_avg"), "qty_mean"), r3(deviation("qtys"), "qty_std"), r3(one("qtys", "list_max"), "qty_max"),
        "len(resps) AS resp_time_count", r3(one("resps", "list_avg"), "resp_time_mean"), r3(sql_quantile("resps", 0.95), "resp_time_p95"),
    ]
    return f"""WITH r AS ({source}), a AS (SELECT {group}, count(*) AS packet_count, {count('is_response = 1')} AS resp_count, {count('is_response <> 1')} AS req_count, count(raw_iat) AS iat_pairs, {count('raw_iat >= 0 AND raw_iat < 0.01')} AS burst,
      {count('raw_iat > 1.0')} AS idle_gap_count, {count('fc >= 128')} AS exception_count, {count('fc IN (1, 2, 3, 4)')} AS read_count, {count('fc IN (5, 6, 15, 16, 22, 23)')} AS write_count,
      min(addr) FILTER (WHERE addr >= 0) AS amin, max(addr) FILTER (WHERE addr >= 0) AS amax, min(seq) AS first_seq, min_by(ts, seq) AS start_ts, max_by(ts, seq) AS end_ts, {sums} FROM r GROUP BY {group}),
      {histogram('fc', 'true', 'hf')}, {histogram(bins, 'raw_iat < 0', 'hn')}
      SELECT {', '.join(columns)} FROM a LEFT JOIN hf USING ({group}) LEFT JOIN hn USING ({group})"""


FLOW = "src_ip, dst_ip, mb_unit_id"
GAPS_SQL = f"SELECT *, ts - lag(ts) OVER (PARTITION BY {FLOW} ORDER BY seq) AS raw_iat FROM ({ORDERS_SQL})"
SESSIONS_SQL = f"SELECT *, CAST(sum(CASE WHEN raw_iat IS NULL OR raw_iat > {SESSION_GAP} OR raw_iat < -1.0 THEN 1 ELSE 0 END) OVER (PARTITION BY {FLOW} ORDER BY seq) AS BIGINT) AS session FROM ({GAPS_SQL})"
WINDOWED_SQL = f"SELECT *, CAST(size AS INTEGER) AS window_sec, CAST(floor(ts / size) * size AS BIGINT) AS window_start_epoch FROM ({GAPS_SQL}) CROSS JOIN (SELECT unnest([86400, 432000]) AS size)"
KEY = "src_ip || '|' || dst_ip || '|' || mb_unit_id"
WINDOW_ROWS_SQL = sql_metrics(WINDOWED_SQL, f"window_sec, window_start_epoch, {FLOW}", "CAST(window_sec AS DOUBLE)", ["window_sec", "window_start_epoch", "window_start_epoch + window_sec AS window_end_epoch", f"{KEY} AS window_key", "src_ip", "dst_ip", "mb_unit_id"])
SESSION_ROWS_SQL = sql_metrics(SESSIONS_SQL, f"{FLOW}, session", "greatest(end_ts - start_ts, 0)", ["row_number() OVER (ORDER BY first_seq) AS session_id", r3("start_ts", "session_start_epoch"), r3("end_ts", "session_end_epoch"), r3("greatest(end_ts - start_ts, 0)", "session_duration_sec"), f"{KEY} AS session_key", "src_ip", "dst_ip", "mb_unit_id"])
DAYS = (86400, 432000)


def gapped_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return builder.with_gaps(order_rows(spark, sf_dir))


# --- arrival ------------------------------------------------------------------------------------------------------


@query(f"SELECT seq, {r6('ts - lag(ts) OVER (PARTITION BY src_ip, dst_ip, unit_id ORDER BY seq)', 'raw_iat')} FROM ({MODBUS_SQL})")
def iat_flow(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(arrival.flow_gaps(modbus_events(spark, sf_dir), ["src_ip", "dst_ip", "unit_id"]).select("seq", "raw_iat"))


@query(f"SELECT seq, {r6('ts - lag(ts) OVER (PARTITION BY src_ip, dst_ip, mb_unit_id ORDER BY seq)', 'raw_iat')} FROM ({ORDERS_SQL})")
def iat_flow_in_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The form for busy flows: by ranges of arrival order."""
    rows = order_rows(spark, sf_dir)
    return rounded(arrival.flow_gaps(rows, builder.FLOW, cuts=arrival.cut_points(rows, "seq", 8)).select("seq", "raw_iat"))


@query(f"SELECT seq, {r6('CASE WHEN d < 0 THEN 0 ELSE coalesce(d, 0) END', 'inter')}, CASE WHEN d < 0 THEN 1 ELSE 0 END AS neg_delta FROM (SELECT seq, ts - lag(ts) OVER (ORDER BY seq) AS d FROM ({ORDERS_SQL}))")
def iat_global(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(arrival.clipped(arrival.global_gaps(order_rows(spark, sf_dir))).select("seq", "inter", "neg_delta"))


@query(f"SELECT seq, size AS window_sec, floor(ts / size) * size AS t0 FROM ({MODBUS_SQL}) CROSS JOIN (SELECT CAST(unnest({list(HOURS)}) AS INTEGER) AS size)")
def window_start(spark: SparkSession, sf_dir: str) -> DataFrame:
    return window_features.in_windows(modbus_events(spark, sf_dir), HOURS).select("seq", "window_sec", "t0")


FRAGMENTS_SQL = f"""WITH RECURSIVE p AS (SELECT row_number() OVER (ORDER BY seq) AS seq, ts, src_ip, dst_ip, mb_unit_id, floor(ts / 864000) * 864000 AS t0 FROM ({ORDERS_SQL})),
  l AS (SELECT *, lag(t0) OVER (PARTITION BY {FLOW} ORDER BY seq) AS t0_b, lag(seq) OVER (PARTITION BY {FLOW} ORDER BY seq) AS seq_b FROM p),
  s AS (SELECT l.seq FROM l JOIN (SELECT seq, t0 FROM p WHERE seq % 100 = 0) x ON x.seq >= l.seq_b AND x.seq < l.seq AND x.t0 > l.t0 AND l.t0 = l.t0_b GROUP BY l.seq)
  SELECT src_ip, dst_ip, mb_unit_id, t0, fragment, count(*) AS n FROM (SELECT *, CAST(sum(CASE WHEN t0_b IS NULL OR t0_b <> t0 OR seq IN (SELECT seq FROM s) THEN 1 ELSE 0 END) OVER (PARTITION BY {FLOW} ORDER BY seq) AS BIGINT) AS fragment FROM l)
  GROUP BY src_ip, dst_ip, mb_unit_id, t0, fragment"""


@query(FRAGMENTS_SQL)
def window_fragments(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = builder.numbered(order_rows(spark, sf_dir).withColumnRenamed("seq", "place"), "place", "seq").drop("place")
    return fragments.fragments(rows, builder.FLOW, 864000.0, sweep_every=100).groupBy(*builder.FLOW, "t0", "fragment").agg(F.count("*").alias("n"))


# --- window features ----------------------------------------------------------------------------------------------


@query(sql_features(MODBUS_SQL, window_features.MODBUS.key, HOURS))
def win_features_flow(spark: SparkSession, sf_dir: str) -> DataFrame:
    packed = arrival.clipped(arrival.flow_gaps(modbus_events(spark, sf_dir), list(window_features.MODBUS.key)))
    return rounded(window_features.features(window_features.in_windows(packed, HOURS)))


@query(sql_features(MODBUS_SQL, (), HOURS))
def win_features_global(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(window_features.features(window_features.in_windows(arrival.clipped(arrival.global_gaps(modbus_events(spark, sf_dir))), HOURS), keys=()))


@query(sql_features(MODBUS_SQL, (), (10**9,)))
def win_features_tail(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One window for all packets: samples are the last 4,096."""
    return rounded(window_features.features(window_features.in_windows(arrival.clipped(arrival.global_gaps(modbus_events(spark, sf_dir))), (10**9,)), keys=()))


@query(sql_features(MQTT_SQL, window_features.MQTT.key, HOURS, mqtt=True))
def mqtt_features_flow(spark: SparkSession, sf_dir: str) -> DataFrame:
    packed = arrival.clipped(arrival.flow_gaps(mqtt_events(spark, sf_dir), list(window_features.MQTT.key)))
    return rounded(window_features.features(window_features.in_windows(packed, HOURS), window_features.MQTT))


@query(sql_features(MQTT_SQL, (), HOURS, mqtt=True))
def mqtt_features_global(spark: SparkSession, sf_dir: str) -> DataFrame:
    packed = arrival.clipped(arrival.global_gaps(mqtt_events(spark, sf_dir)))
    return rounded(window_features.features(window_features.in_windows(packed, HOURS), window_features.MQTT, ()))


ROUTE_SQL = " UNION ALL ".join(
    f"SELECT '{kind}' AS key_type, window_sec, CASE WHEN '{kind}' = 'global' THEN 'global' WHEN n >= 20 THEN 'key' ELSE 'sparse' END AS kind, count(*) AS n_rows, CAST(sum(n) AS BIGINT) AS packets FROM (SELECT CAST(size AS INTEGER) AS window_sec, {keys}floor(ts / size) AS t, count(*) AS n FROM ({MODBUS_SQL}) CROSS JOIN (SELECT unnest({list(HOURS)}) AS size) GROUP BY ALL) GROUP BY ALL"
    for kind, keys in (("flow", "src_ip, dst_ip, unit_id, "), ("global", ""))
)


@query(ROUTE_SQL)
def key_sparse_route(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Flow and global rows of all windows, by where they go."""
    rows = feature_rows(modbus_events(spark, sf_dir), window_features.MODBUS, HOURS)
    return rows.groupBy("key_type", "window_sec", "kind").agg(F.count("*").alias("n_rows"), F.sum("pkt_cnt").alias("packets"))


# --- builder ------------------------------------------------------------------------------------------------------


@query(WINDOW_ROWS_SQL)
def builder_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(builder.window_rows(gapped_orders(spark, sf_dir), DAYS), 3)


@query(SESSION_ROWS_SQL)
def builder_session(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(builder.session_rows(gapped_orders(spark, sf_dir), idle=SESSION_GAP), 3)


@query(f"SELECT seq, src_ip, mb_unit_id, session FROM ({SESSIONS_SQL})")
def sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return builder.in_sessions(gapped_orders(spark, sf_dir), idle=SESSION_GAP).select("seq", "src_ip", "mb_unit_id", "session")


EVENT_ROWS_SQL = f"SELECT seq, ts, src_ip, dst_ip, CAST(unit_id AS VARCHAR) AS mb_unit_id, is_response, fc, k AS addr, k % 7 AS qty, value AS resp_time FROM ({EVENTS_SQL})"
EVENT_SESSIONS_SQL = sql_metrics(SESSIONS_SQL.replace(ORDERS_SQL, EVENT_ROWS_SQL), f"{FLOW}, session", "greatest(end_ts - start_ts, 0)", ["row_number() OVER (ORDER BY first_seq) AS session_id", r3("start_ts", "session_start_epoch"), r3("end_ts", "session_end_epoch"), r3("greatest(end_ts - start_ts, 0)", "session_duration_sec"), f"{KEY} AS session_key", "src_ip", "dst_ip", "mb_unit_id"])


@query(EVENT_SESSIONS_SQL)
def builder_session_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sessions of ordered packets, some dozen packets each."""
    rows = event_packets(spark, sf_dir).select("seq", "ts", "src_ip", "dst_ip", F.col("unit_id").cast("string").alias("mb_unit_id"), "is_response", "fc", F.col("k").alias("addr"), (F.col("k") % 7).alias("qty"), F.col("value").alias("resp_time"))
    return rounded(builder.session_rows(builder.with_gaps(rows), idle=SESSION_GAP), 3)


QUALITY_SQL = f"""WITH r AS ({GAPS_SQL}), n AS (SELECT -raw_iat AS gap, seq FROM r WHERE raw_iat < 0), b AS (SELECT CASE WHEN gap < 0.001 THEN '<0.001s' WHEN gap < 0.01 THEN '<0.01s' WHEN gap < 0.1 THEN '<0.1s' WHEN gap < 1.0 THEN '<1.0s' ELSE '>=1.0s' END AS name, count(*) AS c, min(seq) AS first FROM n GROUP BY 1),
  t AS (SELECT count(raw_iat) AS iat_pairs, count(*) FILTER (WHERE raw_iat < 0) AS negative_delta_count FROM r), l AS (SELECT list_sort(coalesce(list(gap), [])) AS gaps FROM n)
  SELECT iat_pairs, negative_delta_count, {r6('CAST(negative_delta_count AS DOUBLE) / iat_pairs', 'out_of_order_rate')}, {r6('coalesce(list_max(gaps), 0)', 'max_negative_delta_sec')}, {r6(sql_quantile('gaps', 0.99), 'p99_negative_delta_sec')},
  (SELECT '{{' || string_agg('"' || name || '":' || c, ',' ORDER BY first) || '}}' FROM b) AS negative_delta_histogram,
  CASE WHEN CAST(negative_delta_count AS DOUBLE) / iat_pairs <= 1e-4 THEN 'none' WHEN CAST(negative_delta_count AS DOUBLE) / iat_pairs <= 1e-3 AND coalesce(list_max(gaps), 0) <= 1 THEN 'micro-sort(1~2s)' ELSE 'investigate-pipeline-first' END AS recommended_action FROM t CROSS JOIN l"""


@query(QUALITY_SQL)
def quality_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(builder.order_quality(gapped_orders(spark, sf_dir)))


def _builder_tables(spark: SparkSession, sf_dir: str) -> list[DataFrame]:
    rows = gapped_orders(spark, sf_dir)
    tables = [builder.window_rows(rows, DAYS).withColumn("row", F.struct("window_start_epoch", "window_sec", "window_key")), builder.session_rows(rows, idle=SESSION_GAP).withColumn("row", F.col("session_id"))]
    return [t.withColumn("row", F.to_json(F.struct("row"))) for t in tables]


RANKED_SQL = f"SELECT CAST(row_number() OVER (ORDER BY n DESC) AS INTEGER) AS place, n FROM (SELECT CAST(3 * count(*) AS BIGINT) AS n FROM ({ORDERS_SQL}) GROUP BY fc) ORDER BY n DESC LIMIT 16"


@query(RANKED_SQL)
def topk_fc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The most frequent codes over window and session rows; each packet counts three times. Shown by their counts."""
    tables = _builder_tables(spark, sf_dir)
    codes = flatten.top_codes(tables)
    counts = tables[0].select(F.explode(flatten.parsed_histogram(F.col("fc_hist_json"))).alias("code", "n")).unionByName(tables[1].select(F.explode(flatten.parsed_histogram(F.col("fc_hist_json"))).alias("code", "n")))
    place = F.array_position(F.array(*map(F.lit, codes)), F.col("code")).cast("int")
    return counts.where(F.col("code").isin(*codes)).groupBy("code").agg(F.sum("n").alias("n")).select(place.alias("place"), "n")


FLAT_CODES = ("1", "3", "16", "131")
_fc = lambda met: f"CAST(count(*) FILTER (WHERE {met}) AS BIGINT)"
FLAT_SQL = f"""SELECT window_sec, window_start_epoch, {KEY} AS window_key, count(*) AS packet_count, {', '.join(f'{_fc(f"fc = {c}")} AS "FC_{c}"' for c in FLAT_CODES)}, {_fc('fc NOT IN (1, 3, 16, 131)')} AS "FC_OTHER",
  {_fc('fc IN (1, 2, 3, 4)')} AS "FC_READ_TOTAL", {_fc('fc IN (5, 6, 15, 16, 22, 23)')} AS "FC_WRITE_TOTAL", {_fc('fc >= 128')} AS "FC_EXCEPTION_TOTAL" FROM ({WINDOWED_SQL}) GROUP BY window_sec, window_start_epoch, {FLOW}"""


@query(FLAT_SQL)
def flatten_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = builder.window_rows(gapped_orders(spark, sf_dir), DAYS).select("window_sec", "window_start_epoch", "window_key", "packet_count", "fc_hist_json")
    return flatten.flattened(rows, list(FLAT_CODES))


@query(f"SELECT CASE WHEN count(*) FILTER (WHERE mb_unit_id NOT IN ('', '-1')) > 0 THEN 'src_dst_unit' ELSE 'src_dst' END AS key_mode FROM ({ORDERS_SQL})")
def key_mode(spark: SparkSession, sf_dir: str) -> DataFrame:
    mode = flatten.key_mode(order_rows(spark, sf_dir).withColumn("row", F.col("seq")))
    return spark.range(1).select(F.lit(mode).alias("key_mode"))


# --- post-processing ----------------------------------------------------------------------------------------------

KEYS = ("src_ip", "dst_ip", "unit_id")
TOP = 6
SIZE = 18000
FLOWS_SQL = f"SELECT *, CASE WHEN pkt_cnt >= 20 THEN 0 ELSE 1 END AS file_rank FROM ({sql_features(MODBUS_SQL, KEYS, (SIZE,))})"
BOUNDS_SQL = f"""flows AS ({FLOWS_SQL}), places AS (SELECT t0, row_number() OVER (ORDER BY t0) - 1 AS i, count(*) OVER () AS n FROM flows),
  ends AS (SELECT max(CASE WHEN i = greatest(0, CAST(floor(n * CAST(0.7 AS DOUBLE)) AS BIGINT) - 1) THEN t0 END) AS train_end, max(CASE WHEN i = CAST(floor(n * (CAST(0.7 AS DOUBLE) + CAST(0.1 AS DOUBLE))) AS BIGINT) - 1 THEN t0 END) AS val_end FROM places)"""
KEPT_SQL = f"""{BOUNDS_SQL}, kept AS (SELECT src_ip, dst_ip, unit_id, CAST(sum(pkt_cnt) AS BIGINT) AS packets FROM flows, ends WHERE t0 < train_end GROUP BY ALL ORDER BY packets DESC, min((t0, file_rank, src_ip, dst_ip, unit_id)) LIMIT {TOP})"""
OTHER_SUMS = ", ".join(f"CAST(sum({c}) AS BIGINT) AS {c}" for c in retention.COUNTERS)
OTHERS_SQL = f"SELECT t0, window_sec, {OTHER_SUMS} FROM flows ANTI JOIN kept USING (src_ip, dst_ip, unit_id) GROUP BY t0, window_sec"


def _flows(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = arrival.clipped(arrival.flow_gaps(modbus_events(spark, sf_dir), list(KEYS)))
    found = window_features.routed(window_features.features(window_features.in_windows(rows, (SIZE,))))
    found = found.withColumn("seq", F.struct(*KEYS))
    return retention.flow_rows(found.where("kind = 'key'").drop("kind"), found.where("kind = 'sparse'").drop("kind"))


def _kept(flows: DataFrame) -> tuple[tuple[float, float], DataFrame]:
    ends = retention.boundaries(flows)
    return ends, retention.kept_keys(flows, ends[0], TOP, KEYS)


@query(f"WITH {BOUNDS_SQL} SELECT train_end, val_end FROM ends")
def split_bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    ends = retention.boundaries(_flows(spark, sf_dir))
    return spark.range(1).select(F.lit(ends[0]).alias("train_end"), F.lit(ends[1]).alias("val_end"))


@query(f"WITH {KEPT_SQL} SELECT * FROM kept")
def keep_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _kept(_flows(spark, sf_dir))[1]


@query(f"WITH {KEPT_SQL} SELECT src_ip, dst_ip, unit_id, t0, pkt_cnt, byte_cnt FROM flows SEMI JOIN kept USING (src_ip, dst_ip, unit_id)")
def flow_kept(spark: SparkSession, sf_dir: str) -> DataFrame:
    flows = _flows(spark, sf_dir)
    return retention.kept_rows(flows, _kept(flows)[1], TOP, KEYS).select(*KEYS, "t0", "pkt_cnt", "byte_cnt")


OTHER_SELECT = f"""SELECT 'v1' AS schema_version, t0, window_sec, 'flow' AS key_type, '__other__' AS src_ip, '__other__' AS dst_ip, CAST(-1 AS BIGINT) AS unit_id, pkt_cnt, byte_cnt, {r6('pkt_cnt / CAST(window_sec AS DOUBLE)', 'pkt_rate')}, {r6('byte_cnt / CAST(window_sec AS DOUBLE)', 'byte_rate')}, req_cnt, resp_cnt,
  {r6('CAST(req_cnt AS DOUBLE) / greatest(resp_cnt, 1)', 'req_resp_ratio')}, exc_cnt, {r6('CAST(exc_cnt AS DOUBLE) / greatest(pkt_cnt, 1)', 'exc_ratio')}, inter_cnt_pos, neg_delta_cnt, delta_src_frame_cnt, delta_src_tcp_cnt, delta_src_none_cnt FROM ({OTHERS_SQL})"""


@query(f"WITH {KEPT_SQL} {OTHER_SELECT}")
def other_bucket(spark: SparkSession, sf_dir: str) -> DataFrame:
    flows = _flows(spark, sf_dir)
    """Without the columns that are unknown, hence null, for this bucket."""
    return rounded(retention.other_rows(flows, _kept(flows)[1], TOP, KEYS).drop(*retention.UNKNOWN))


@query(f"WITH {KEPT_SQL} SELECT CAST(0 AS INTEGER) AS part, t0, src_ip, pkt_cnt FROM flows SEMI JOIN kept USING (src_ip, dst_ip, unit_id) UNION ALL SELECT 1, t0, '__other__', pkt_cnt FROM ({OTHERS_SQL})")
def flow_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    flows = _flows(spark, sf_dir)
    kept = _kept(flows)[1]
    return retention.all_flow_rows(retention.kept_rows(flows, kept, TOP, KEYS), retention.other_rows(flows, kept, TOP, KEYS)).select("part", "t0", "src_ip", "pkt_cnt")


@query(f"WITH {BOUNDS_SQL} SELECT CASE WHEN t0 <= train_end THEN 'train' WHEN t0 <= val_end THEN 'val' ELSE 'test' END AS split, count(*) AS n FROM flows, ends GROUP BY 1")
def split_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    flows = _flows(spark, sf_dir)
    return retention.split_counts(flows, retention.boundaries(flows))


# --- values and packets -------------------------------------------------------------------------------------------

#: Texts built from a number, and what they are as an integer and as a float.
FORMS = {
    0: ("{n}", "{n}", "{n}"), 1: ("{n}.7", "{n}", "{n} + 0.7"), 2: ("{n}e2", "{n} * 100", "{n} * 100"), 3: ("0x{n}", "-1", "-1"), 4: ("{n}_000", "{n} * 1000", "{n} * 1000"),
    5: (" +{n} ", "{n}", "{n}"), 6: ("{n}f", "-1", "-1"), 7: ("-{n}.5", "-{n}", "-{n} - 0.5"), 8: ("", "-1", "-1"), 9: (".{n}", "0", "CAST('0.' || {n} AS DOUBLE)"),
}


def _form_text(number: Column, which: Column) -> Column:
    text = F.lit(None).cast("string")
    for i, (form, _, _) in FORMS.items():
        before, _, after = form.partition("{n}")
        made = F.concat(F.lit(before), number.cast("string"), F.lit(after)) if "{n}" in form else F.lit(form)
        text = F.when(which == i, made).otherwise(text)
    return text


def _form_sql(place: int, n: str) -> str:
    return "CASE event_id % 10 " + " ".join(f"WHEN {i} THEN CAST({f[place].format(n=n)} AS {'BIGINT' if place == 1 else 'DOUBLE'})" for i, f in FORMS.items()) + " END"


@query(f"SELECT event_id, {_form_sql(1, 'k')} AS as_int, {r6(_form_sql(2, 'k'), 'as_float')} FROM ({EVENTS_SQL})")
def coerce_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = event_packets(spark, sf_dir)
    text = _form_text(F.col("k"), F.col("event_id") % 10)
    # every other value comes wrapped in a list
    quoted = F.to_json(F.array(text))
    value = F.try_parse_json(F.when(F.col("event_id") % 2 == 0, quoted).otherwise(F.regexp_replace(quoted, r"^\[|\]$", "")))
    return rounded(rows.withColumn("v", value).select("event_id", coerce.as_int(F.col("v")).alias("as_int"), coerce.as_float(F.col("v"), -1.0).alias("as_float")))


@query(f"SELECT event_id, {r6('CASE event_id % 4 WHEN 3 THEN 0 ELSE epoch_us(ts) / 1e6 END', 'epoch')} FROM events")
def coerce_epoch(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, n = table(spark, sf_dir, "events"), F.col("event_id") % 4
    iso = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")
    text = F.when(n == 0, F.concat(iso, F.lit("Z"))).when(n == 1, F.concat(iso, F.lit("123+00:00"))).when(n == 2, F.format_string("%.6f", F.unix_micros("ts") / F.lit(1e6))).otherwise("Jan  1, 2024 00:00:00 UTC")
    return rounded(rows.select("event_id", coerce.epoch(text).alias("epoch")))


@query("SELECT event_id, CASE WHEN d = 502 AND s <> 502 THEN 1 ELSE 0 END AS is_request, CASE WHEN s = 502 AND d <> 502 THEN 1 ELSE 0 END AS is_response FROM (SELECT event_id, 501 + event_id % 2 AS s, 501 + event_id % 3 AS d FROM events)")
def direction(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("event_id")
    request, response = packets.direction((501 + n % 2).cast("string"), (501 + n % 3).cast("string"), packets.MODBUS_PORT)
    return table(spark, sf_dir, "events").select("event_id", request.alias("is_request"), response.alias("is_response"))


@query(f"SELECT event_id, CAST('0x' || right(sha1(topic), 3) AS BIGINT) % 1024 AS bucket, length(topic) AS topic_len FROM ({EVENTS_SQL})")
def topic_bucket(spark: SparkSession, sf_dir: str) -> DataFrame:
    return event_packets(spark, sf_dir).select("event_id", packets.topic_bucket(F.col("topic")).alias("bucket"), packets.topic_length(F.col("topic")).alias("topic_len"))


def _json_of(entries: dict[str, Column | dict]) -> Column:
    """A JSON object from columns; null columns are left out."""
    parts = []
    for key, value in entries.items():
        text = _json_of(value) if isinstance(value, dict) else value
        parts.append(F.concat(F.lit(f'"{key}":'), text))
    return F.concat(F.lit("{"), F.array_join(F.array_compact(F.array(*parts)), ","), F.lit("}"))


def _quoted(value: Column) -> Column:
    return F.concat(F.lit('"'), value.cast("string"), F.lit('"'))


def packet_texts(spark: SparkSession, sf_dir: str, protocol: str) -> DataFrame:
    """(seq, raw): a packet for each event, with the protocol's columns in it. Texts are ``column:event_id``, integers
    count on from event_id by column, floats are value. Some layers are wrapped in lists; some packets have no vlan."""
    tree: dict = {}
    rows = event_packets(spark, sf_dir)
    n = F.col("event_id")
    for i, (name, kind, path) in enumerate(protocols.layout(protocol)):
        if kind in ("has", "delta", "json", "bytes"):
            continue
        at = tree
        for key in path[:-1]:
            at = at.setdefault(key, {})
        value = {"int": _quoted(n + i), "regval": None, "float": F.col("value").cast("string")}.get(kind, _quoted(F.concat(F.lit(f"{name}:"), n.cast("string"))))
        if kind == "regval":
            at["first"] = {"other": F.lit("1")}
            at["second"] = {path[-1]: F.concat(F.lit('["'), (n + i).cast("string"), F.lit('"]'))}
            at["third"] = {path[-1]: F.lit("7")}
        else:
            at[path[-1]] = value
    tree["frame"]["frame.time_epoch"] = _quoted(F.format_string("%.6f", "ts"))
    tree["frame"]["frame.time_delta"] = F.when(n % 3 == 0, F.col("value").cast("string"))
    tree["tcp"]["Timestamps"]["tcp.time_delta"] = F.when(n % 3 <= 1, F.concat(F.lit("["), F.col("value").cast("string"), F.lit("]")))
    texts = {key: _json_of(value) for key, value in tree.items()}
    texts["vlan"] = F.when(n % 2 == 0, texts["vlan"])
    texts["ip"] = F.when(n % 5 == 0, F.concat(F.lit("["), texts["ip"], F.lit("]"))).otherwise(texts["ip"])
    return rows.select("seq", _json_of({"_source": {"layers": texts}}).alias("raw"))


def sql_extract(protocol: str) -> str:
    columns = ["event_id AS seq", r6("epoch_us(ts) / 1e6", '"timestamp"')]
    for i, (name, kind, path) in enumerate(protocols.layout(protocol)):
        text = f"'{name}:' || event_id"
        made = {
            "int": f"event_id + {i}",
            "regval": f"event_id + {i}",
            "float": "value",
            "str": text,
            "bytes": "CAST(len(string_split('mqtt_payload_hex:' || event_id, ':')) AS INTEGER)",
            "has": "CASE WHEN event_id % 2 = 0 THEN 1 ELSE 0 END",
            "delta": "CASE event_id % 3 WHEN 0 THEN 'frame' WHEN 1 THEN 'tcp' ELSE 'none' END",
            "json": "''",
        }[kind]
        if name == "frame_time_epoch_raw":
            made = "printf('%.6f', epoch_us(ts) / 1e6)"
        if name == "vlan_id":
            made = f"CASE WHEN event_id % 2 = 0 THEN event_id + {i} ELSE -1 END"
        if name == "frame_time_delta":
            made = "CASE WHEN event_id % 3 = 0 THEN value ELSE -1 END"
        if name == "tcp_time_delta":
            made = "CASE WHEN event_id % 3 <= 1 THEN value ELSE -1 END"
        if kind == "json":
            made = sql_json(protocol, path)
        columns.append(r6(made, name) if kind == "float" else f"{made} AS {name}")
    return f"SELECT {', '.join(columns)} FROM events"


def sql_json(protocol: str, path: list[str]) -> str:
    """The object at ``path`` as the packets have it."""
    tree: dict = {}
    for name, kind, where in protocols.layout(protocol):
        if kind == "str" and where[: len(path)] == path:
            at = tree
            for key in where[len(path) : -1]:
                at = at.setdefault(key, {})
            at[where[-1]] = f"{name}:"

    def text(node) -> str:
        if isinstance(node, str):
            return f"""'"{node}' || event_id || '"'"""
        return "'{' || " + " || ',' || ".join(f"""'"{k}":' || {text(v)}""" for k, v in node.items()) + " || '}'"

    return text(tree)


def _extraction(protocol: str) -> None:
    def extract(spark: SparkSession, sf_dir: str) -> DataFrame:
        return rounded(protocols.extracted(packet_texts(spark, sf_dir, protocol), protocol, keep=("seq",)))

    extract.__name__ = f"packet_extract_{protocol}"
    query(sql_extract(protocol))(extract)


for _protocol in protocols.LAYOUTS:
    _extraction(_protocol)
