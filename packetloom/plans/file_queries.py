"""Registered queries that go through files and streams: readers, writers, and the streaming forms."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from packetloom.operators import arrival, window_features
from packetloom.operators.builder import numbered
from packetloom.plans.queries import EVENT_ROWS_SQL, GAPS_SQL, HOURS, MODBUS_SQL, ORACLES, ORDERS_SQL, QUERIES, SESSION_GAP, event_packets, modbus_events, query, r6, rounded, sql_features, table
from packetloom.session import scratch_path
from packetloom.sources import packet_json, tables
from packetloom.streaming import features as streaming


def _one_text_file(rows: DataFrame, path: str) -> None:
    """Column ``value`` as one file, in the order of ``place``."""
    rows.repartition(1).sortWithinPartitions("place").select("value").write.text(path)


@query("SELECT row_number() OVER (ORDER BY event_id) AS place, event_id AS n, CAST(event_id % 50 = 7 AS BOOLEAN) AS bad FROM events")
def json_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines with brackets, commas, NUL characters and blanks around, some of them no JSON: in order, bad ones marked."""
    n = F.col("event_id")
    line = F.concat(F.when(n % 50 == 7, "{oops").otherwise(F.lit('{"n"')), F.when(n % 3 == 0, F.lit("\0")).otherwise(""), F.lit(": "), n.cast("string"), F.lit("}"), F.when(n % 2 == 0, ",").otherwise(" "))
    noise = F.when(n % 10 == 0, F.array(F.lit(" "), line)).when(n % 10 == 1, F.array(line, F.lit("]"))).otherwise(F.array(line))
    lines = table(spark, sf_dir, "events").select(n.alias("e"), F.posexplode(noise).alias("k", "value")).withColumn("place", F.struct("e", "k"))
    path = scratch_path(spark, "lines")
    _one_text_file(lines, path)
    found = packet_json.read_lines(spark, path)
    number = F.regexp_extract("raw", r": (\d+)", 1).cast("bigint")
    # places are dense among the lines that are kept
    return numbered(found.select("seq", number.alias("n"), F.col("error").isNotNull().alias("bad")), "seq", "place").select(F.col("place").cast("bigint").alias("place"), "n", "bad")


@query("SELECT row_number() OVER (ORDER BY event_id) AS seq, event_id AS n, event_type AS kind FROM events UNION ALL SELECT count(*) + 1, -1, 'torn' FROM events")
def json_array(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One array over many lines with a torn item at its end, which is a row of its own."""
    n = F.col("event_id")
    item = F.concat(F.lit('{"n": '), n.cast("string"), F.lit(', "s": "é[]{},", "t": {"kind": '), F.to_json(F.array("event_type")), F.lit("}},"))
    rows = table(spark, sf_dir, "events").select(F.struct(F.lit(1), n).alias("place"), item.alias("value"))
    ends = spark.createDataFrame([(0, 0, "junk ["), (2, 0, '{"n": ')], "a int, b bigint, value string").select(F.struct("a", "b").alias("place"), "value")
    path = scratch_path(spark, "array")
    _one_text_file(rows.unionByName(ends.select(F.struct(F.col("place.a").alias("col1"), F.col("place.b").alias("event_id")).alias("place"), "value")), path)
    found = packet_json.read_array(spark, f"{path}/part-*")
    return found.select("seq", F.coalesce(F.get_json_object("raw", "$.n").cast("bigint"), F.lit(-1)).alias("n"), F.coalesce(F.get_json_object("raw", "$.t.kind[0]"), F.lit("torn")).alias("kind"))


@query("SELECT row_number() OVER (ORDER BY event_id) AS seq, CAST(event_id AS VARCHAR) AS n, event_type || ', \"x\"' AS text FROM events")
def csv_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").repartition(1).sortWithinPartitions("event_id").select(F.col("event_id").alias("n"), F.concat("event_type", F.lit(', "x"')).alias("text"))
    path = scratch_path(spark, "csv")
    tables.write_csv(rows, path, one_file=True)
    return tables.read_csv(spark, path).select(F.col("seq").cast("bigint").alias("seq"), "n", "text")


_FEATURES = ("window_sec", "t0", "key_type", "src_ip", "dst_ip", "unit_id", "pkt_cnt", "byte_cnt", "fc_entropy", "inter_p95")


@query(f"SELECT {', '.join(_FEATURES)} FROM ({sql_features(MODBUS_SQL, window_features.MODBUS.key, HOURS)})")
def feature_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Feature rows as documents by window and kind, and read back with their types."""
    rows = arrival.clipped(arrival.flow_gaps(modbus_events(spark, sf_dir), list(window_features.MODBUS.key)))
    found = window_features.routed(window_features.features(window_features.in_windows(rows, HOURS)))
    path = scratch_path(spark, "features")
    tables.write_lines(window_features.rendered(found), path, ("window_sec", "kind"))
    parts = [tables.read_features_if_any(spark, f"{path}/window_sec={w}/kind={kind}") for w in HOURS for kind in ("key", "sparse")]
    whole = parts[0]
    for part in parts[1:]:
        whole = whole.unionByName(part)
    return rounded(whole.select(*_FEATURES))


def _stream(spark: SparkSession, packets: DataFrame) -> DataFrame:
    """``packets`` as a stream of some files, in order."""
    path = scratch_path(spark, "stream-in")
    rows = packets.count()
    packets.repartition(1).sortWithinPartitions("seq").write.option("maxRecordsPerFile", max(1, -(-rows // 4))).parquet(path)
    for key, value in streaming.STATE_STORE.items():
        spark.conf.set(key, value)
    return spark.readStream.schema(packets.schema).option("maxFilesPerTrigger", 1).parquet(path)


def _drained(spark: SparkSession, stream: DataFrame) -> DataFrame:
    """All that the stream gives for what is there now."""
    out = scratch_path(spark, "stream-out")
    sink = stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", scratch_path(spark, "stream-checkpoint"))
    sink.trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(stream.schema).parquet(out)


@query(
    f"""WITH p AS ({MODBUS_SQL}), w AS (SELECT *, floor(ts / 3600) * 3600 AS t0 FROM p)
    SELECT t0, CAST(3600 AS INTEGER) AS window_sec, src_ip, dst_ip, unit_id, count(*) AS pkt_cnt, CAST(sum(pkt_len) AS BIGINT) AS byte_cnt, CAST(sum(is_request) AS BIGINT) AS req_cnt, CAST(sum(is_response) AS BIGINT) AS resp_cnt, CAST(sum(is_exception) AS BIGINT) AS exc_cnt,
    {r6('count(*) / 3600.0', 'pkt_rate')}, {r6('sum(pkt_len) / 3600.0', 'byte_rate')}, {r6('CAST(sum(is_request) AS DOUBLE) / greatest(sum(is_response), 1)', 'req_resp_ratio')}, {r6('CAST(sum(is_exception) AS DOUBLE) / count(*)', 'exc_ratio')}
    FROM w WHERE t0 + 3600 <= (SELECT max(ts) - 2 FROM p) GROUP BY t0, src_ip, dst_ip, unit_id"""
)
def stream_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Windows that are over by the watermark, each emitted once."""
    stream = streaming.timed(_stream(spark, modbus_events(spark, sf_dir)))
    return rounded(_drained(spark, streaming.window_counts(stream, list(window_features.MODBUS.key), 3600)))


_STATE_SQL = GAPS_SQL.replace(ORDERS_SQL, EVENT_ROWS_SQL)


@query(
    f"""SELECT seq, {r6('raw_iat', 'raw_iat')}, CAST(sum(CASE WHEN raw_iat IS NULL OR raw_iat > {SESSION_GAP} OR raw_iat < -1.0 THEN 1 ELSE 0 END) OVER (PARTITION BY src_ip, dst_ip, mb_unit_id ORDER BY seq) AS BIGINT) AS session FROM ({_STATE_SQL})"""
)
def stream_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Gaps and sessions with state per flow over four batches."""
    rows = event_packets(spark, sf_dir).select("seq", "ts", "src_ip", "dst_ip", F.col("unit_id").cast("string").alias("mb_unit_id"))
    found = streaming.with_flow_state(_stream(spark, rows), ["src_ip", "dst_ip", "mb_unit_id"], idle=SESSION_GAP)
    return rounded(_drained(spark, found).select("seq", "raw_iat", "session"))
