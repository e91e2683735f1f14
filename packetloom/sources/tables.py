"""Readers and writers of CSV and feature files, and of the small documents that a run leaves."""

from __future__ import annotations

import json

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from packetloom.operators.window_features import MODBUS, MQTT, MQTT_TYPES, Family
from packetloom.session import scratch_path
from packetloom.sources.packet_json import numbered

CRLF = "\r\n"


def stored(rows: DataFrame, name: str) -> DataFrame:
    """``rows`` written once and read back: for what several passes need and is dear to make."""
    path = scratch_path(rows.sparkSession, name)
    rows.write.parquet(path)
    return rows.sparkSession.read.schema(rows.schema).parquet(path)


def read_csv(spark: SparkSession, path: str, row: str = "seq") -> DataFrame:
    """A CSV with a header, all columns text, compressed or not, with the order of its rows in ``row``."""
    return numbered(spark.read.csv(path, header=True, inferSchema=False, escape='"')).withColumnRenamed("seq", row)


def _feature_types(family: Family) -> T.StructType:
    long, double, text = T.LongType(), T.DoubleType(), T.StringType()
    key = T.StructType([T.StructField(k, long if k in ("unit_id", "dst_port") else text) for k in family.key])
    names: list[tuple[str, T.DataType]] = [("schema_version", text)]
    if family.mqtt:
        names += [("protocol", text), ("feature_family", text)]
    names += [("t0", double), ("window_sec", T.IntegerType()), ("key_type", text), ("key", key)]
    names += [(n, long) for n in ("pkt_cnt", "byte_cnt")] + [(n, double) for n in ("pkt_rate", "byte_rate")]
    names += [("req_cnt", long), ("resp_cnt", long), ("req_resp_ratio", double), ("exc_cnt", long), ("exc_ratio", double), ("fc_unique_cnt", long), ("fc_entropy", double), ("inter_cnt_pos", long)]
    names += [(n, double) for n in ("inter_mean", "inter_std", "inter_p50", "inter_p95", "burstiness")]
    names += [(n, long) for n in ("neg_delta_cnt", "delta_src_frame_cnt", "delta_src_tcp_cnt", "delta_src_none_cnt")]
    if family.mqtt:
        names += [("mqtt_type_unique_cnt", long), ("mqtt_type_entropy", double), *((f"mqtt_type_{n}_cnt", long) for n in MQTT_TYPES), ("pub_cnt", long)]
        names += [(f"pub_{n}_ratio", double) for n in ("qos0", "qos1", "qos2", "dup", "retain", "payload_nonempty")]
        names += [(f"pub_payload_len_{n}", double) for n in ("mean", "std", "p50", "p95")]
        names += [("topic_unique_cnt", long), ("topic_entropy", double), *((f"topic_len_{n}", double) for n in ("mean", "std", "p50", "p95"))]
        names += [(n, double) for n in ("pub_to_sub_ratio", "ping_ratio", "ack_ratio")]
    return T.StructType([T.StructField(n, t) for n, t in names])


FEATURES = {"modbus": _feature_types(MODBUS), "mqtt": _feature_types(MQTT)}


def read_features(spark: SparkSession, path: str, protocol: str = "modbus") -> DataFrame:
    """Feature documents, strictly, with the key's fields as columns and ``seq``, their order. Global rows have a text for
    a key; their key columns are null."""
    schema, keys = FEATURES[protocol], (MODBUS if protocol == "modbus" else MQTT).key
    lines = numbered(spark.read.text(path)).where(F.trim("value") != "")
    text_key = F.col("value").rlike('"key"\\s*:\\s*"')
    safe = F.when(text_key, F.regexp_replace("value", '"key"\\s*:\\s*"[^"]*"', '"key":null')).otherwise(F.col("value"))
    rows = lines.select("seq", F.from_json(safe, schema, {"mode": "FAILFAST"}).alias("r"))
    flat = [F.col(f"r.key.{k}").alias(k) for k in keys]
    return rows.select("seq", *(c for f in schema.names for c in (flat if f == "key" else [F.col(f"r.{f}").alias(f)])))


def read_features_if_any(spark: SparkSession, path: str, protocol: str = "modbus") -> DataFrame:
    """As :func:`read_features`; no rows where there is no such file."""
    try:
        return read_features(spark, path, protocol)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
    keys = (MODBUS if protocol == "modbus" else MQTT).key
    schema = FEATURES[protocol]
    fields = [T.StructField("seq", T.LongType())]
    for f in schema.fields:
        fields += [x for x in f.dataType.fields] if f.name == "key" else [f]

    return spark.createDataFrame([], T.StructType(fields))


def write_csv(rows: DataFrame, path: str, one_file: bool = False) -> None:
    """With a header, minimal quoting and CRLF ends; one file only on request."""
    (rows.coalesce(1) if one_file else rows).write.mode("overwrite").csv(path, header=True, lineSep=CRLF, escape='"', emptyValue="")


def write_lines(documents: DataFrame, path: str, by: tuple[str, ...] = ()) -> None:
    """Column ``value`` as JSON lines, in folders by the columns ``by``."""
    documents.select(*by, "value").write.mode("overwrite").partitionBy(*by).text(path)


def write_nowhere(rows: DataFrame) -> None:
    """Do all the work and drop the result."""
    rows.write.format("noop").mode("overwrite").save()


def write_document(spark: SparkSession, path: str, document: dict) -> None:
    """A small JSON document, replaced as a whole: written beside its place, then renamed."""
    jvm = spark._jvm
    target, beside = jvm.org.apache.hadoop.fs.Path(path), jvm.org.apache.hadoop.fs.Path(path + ".tmp")
    system = target.getFileSystem(spark._jsc.hadoopConfiguration())
    stream = system.create(beside, True)
    stream.write(bytearray(json.dumps(document, ensure_ascii=False, indent=2).encode()))
    stream.close()
    system.delete(target, False)
    if not system.rename(beside, target):
        raise OSError(f"could not replace {path}")


def read_document(spark: SparkSession, path: str) -> dict | None:
    """A JSON document; None if it isn't there or isn't one."""
    jvm = spark._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    system = target.getFileSystem(spark._jsc.hadoopConfiguration())
    if not system.exists(target):
        return None
    stream = system.open(target)
    try:
        return json.loads(bytes(jvm.org.apache.commons.io.IOUtils.toByteArray(stream)).decode())
    except ValueError:
        return None
    finally:
        stream.close()
