"""Packets to rows, edge cases of the JSON."""

import json

from pyspark.sql import functions as F

from packetloom.operators import protocols


def rows_of(spark, packets, protocol):
    raw = spark.createDataFrame([(i, p if isinstance(p, str) else json.dumps(p)) for i, p in enumerate(packets)], "seq long, raw string")
    return [r.asDict() for r in protocols.extracted(raw, protocol, keep=("seq",)).orderBy("seq").collect()]


def packet(**layers):
    return {"_source": {"layers": layers}}


def test_widths(spark):
    for protocol, width in {"modbus": 29, "mqtt": 30, "opcua": 25, "s7comm": 52, "profinet": 31}.items():
        assert len(rows_of(spark, [packet()], protocol)[0]) - 1 == width


def test_defaults_of_nothing(spark):
    for p in ({}, [], "null", "12", {"_source": []}, {"_source": {"layers": "x"}}, packet(frame=[], tcp=None)):
        row = rows_of(spark, [p], "modbus")[0]
        assert row["timestamp"] == 0.0 and row["frame_len"] == -1 and row["src_ip"] == "" and row["delta_source"] == "none"
        assert row["has_vlan"] == 0 and row["modbus_regval_uint16"] == -1 and row["modbus_response_time"] == -1.0
        assert None not in row.values()


def test_lists_are_unwrapped_one_level(spark):
    p = {"_source": [{"layers": [packet(frame=[{"frame.len": ["60"]}], ip={"ip.src": ["1.1.1.1", "2.2.2.2"]}, tcp=[[{"tcp.len": "5"}]])["_source"]["layers"]]}]}
    row = rows_of(spark, [p], "modbus")[0]
    assert (row["frame_len"], row["src_ip"], row["tcp_len"]) == (60, "1.1.1.1", -1)


def test_delta_source_tells_null_from_empty(spark):
    frame = lambda v: packet(frame={"frame.time_delta": v}, tcp={"Timestamps": {"tcp.time_delta": "0.5"}})
    got = rows_of(spark, [frame([]), frame(None), frame("0.1"), packet(tcp={"Timestamps": {"tcp.time_delta": None}})], "modbus")
    assert [(r["delta_source"], r["frame_time_delta"]) for r in got] == [("frame", -1.0), ("tcp", -1.0), ("frame", 0.1), ("none", -1.0)]


def test_vlan_is_presence(spark):
    assert [r["has_vlan"] for r in rows_of(spark, [packet(vlan=None), packet(vlan=5), packet(vlan={"vlan.id": "7"}), packet()], "opcua")] == [1, 1, 1, 0]


def test_register_of_the_first_child_object(spark):
    modbus = lambda text: '{"_source":{"layers":{"modbus":' + text + "}}}"
    texts = ['{"z":{"x":1},"b":{"modbus.regval_uint16":"5"},"a":{"modbus.regval_uint16":"6"}}', '{"l":[{"modbus.regval_uint16":"1"}],"m":{"modbus.regval_uint16":["9"]}}', '{"m":{"modbus.regval_uint16":"x"},"n":{"modbus.regval_uint16":"3"}}', "[]"]
    assert [r["modbus_regval_uint16"] for r in rows_of(spark, [modbus(t) for t in texts], "modbus")] == [5, 9, -1, -1]


def test_raw_columns_keep_the_order_of_keys(spark):
    item = '{"z": 1, "s7comm.param.item.db": "3", "a": [1, 2]}'
    p = '{"_source":{"layers":{"s7comm":{"s7comm.param":[{"s7comm.param.item":' + item + '}]}}}}'
    row = rows_of(spark, [p], "s7comm")[0]
    assert row["s7_param_item_raw"] == '{"z":1,"s7comm.param.item.db":"3","a":[1,2]}' and row["s7_item_db"] == "3" and row["s7_data_item_raw"] == ""


def test_last_of_repeated_keys(spark):
    assert rows_of(spark, ['{"_source":{"layers":{"frame":{"frame.len":"1","frame.len":"2"}}}}'], "modbus")[0]["frame_len"] == 2


def test_payload_bytes(spark):
    mqtt = lambda v: packet(mqtt={"mqtt.msg": v})
    assert [r["mqtt_payload_len_bytes"] for r in rows_of(spark, [mqtt("aa:bb:cc"), mqtt(""), mqtt("aa"), packet()], "mqtt")] == [3, 0, 1, 0]


def test_infinite_integers_are_marked(spark):
    raw = spark.createDataFrame([(json.dumps(packet(frame={"frame.len": v})),) for v in ("inf", "12", "nan")], "raw string")
    assert [r["overflow__"] for r in protocols.with_overflows(raw, "modbus").collect()] == [True, False, False]


def modbus(src, dst, **more):
    return packet(frame={"frame.time_epoch": "1.5", "frame.len": "60"}, ip={"ip.src": "", "ip.dst": "b"}, tcp={"tcp.srcport": src, "tcp.dstport": dst}, mbtcp={"mbtcp.unit_id": "1"}, modbus={"modbus.func_code": "3", **more})


def test_modbus_packets(spark):
    texts = [modbus("1000", "502"), modbus("502", "1000", **{"modbus.exception": "2"}), modbus("502", "502"), packet(modbus={}), packet(mbtcp=None, modbus=None)]
    raw = spark.createDataFrame([(i, json.dumps(p)) for i, p in enumerate(texts)], "seq long, raw string")
    got = protocols.modbus_packets(raw).orderBy("seq").collect()
    assert [(r.seq, r.is_request, r.is_response, r.is_exception, r.src_ip) for r in got] == [(0, 1, 0, 0, "0.0.0.0"), (1, 0, 1, 1, "0.0.0.0"), (2, 0, 0, 0, "0.0.0.0"), (4, 0, 0, 0, "0.0.0.0")]


def test_mqtt_packets(spark):
    flags = {"mqtt.hdrflags_tree": {"mqtt.msgtype": "3", "mqtt.qos": "1", "mqtt.dupflag": "1"}}
    texts = [packet(mqtt={**flags, "mqtt.topic": "a/b", "mqtt.msg": "aa:bb"}, tcp={"tcp.dstport": "1883", "tcp.srcport": "9"}), packet(mqtt=[]), packet(modbus={})]
    raw = spark.createDataFrame([(i, json.dumps(p)) for i, p in enumerate(texts)], "seq long, raw string")
    a, b = protocols.mqtt_packets(raw).orderBy("seq").collect()
    assert (a.fc, a.mqtt_qos, a.mqtt_dup, a.mqtt_retain, a.mqtt_topic_len, a.mqtt_topic_bucket, a.mqtt_payload_len, a.is_request, a.dst_port) == (3, 1, 1, 0, 3, 891, 2, 1, 1883)
    assert (b.fc, b.mqtt_qos, b.mqtt_topic_len, b.mqtt_topic_bucket, b.dst_port) == (-1, -1, -1, -1, -1)


def test_bridge_to_the_builder(spark):
    raw = spark.createDataFrame([(1, json.dumps(modbus("502", "9")))], "seq long, raw string")
    row = protocols.builder_input(protocols.extracted(raw, "modbus", keep=("seq",))).first()
    assert (row.mb_unit_id, row.mb_func_code, row.is_response, float(row.timestamp)) == ("1", "3", "1", 1.5)
    assert protocols.extracted(raw.where(F.lit(False)), "modbus").count() == 0
