"""Packet JSON to flat rows for five protocols, and to the inputs of the window features for two.

A packet is a text of one JSON object; layers are below ``_source.layers``. Every object and value may be wrapped in a
list. Missing and ill-typed values take the column's default, so rows have no nulls. The text is parsed once, to a
VARIANT; raw JSON columns are cut from the text, which keeps the order of keys.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from packetloom.functions import coerce, packets
from packetloom.functions.coerce import child, unwrap

#: Columns of the flat rows: name, kind of value, path below the layers. Kinds have these defaults: int -1,
#: float -1.0, str '', json ''.
HEAD = """
frame_time_epoch_raw str frame/frame.time_epoch
frame_len int frame/frame.len
frame_protocols str frame/frame.protocols
has_vlan has vlan
vlan_id int vlan/vlan.id
"""
ETHERNET = """
eth_src str eth/eth.src
eth_dst str eth/eth.dst
eth_type str eth/eth.type
"""
NETWORK = """
src_ip str ip/ip.src
dst_ip str ip/ip.dst
ip_ttl int ip/ip.ttl
tcp_srcport int tcp/tcp.srcport
tcp_dstport int tcp/tcp.dstport
tcp_len int tcp/tcp.len
tcp_window int tcp/tcp.window_size
tcp_flags_ack int tcp/tcp.flags_tree/tcp.flags.ack
tcp_flags_push int tcp/tcp.flags_tree/tcp.flags.push
tcp_flags_reset int tcp/tcp.flags_tree/tcp.flags.reset
tcp_flags_syn int tcp/tcp.flags_tree/tcp.flags.syn
frame_time_delta float frame/frame.time_delta
tcp_time_delta float tcp/Timestamps/tcp.time_delta
"""
MODBUS = """
mbtcp_trans_id int mbtcp/mbtcp.trans_id
mbtcp_unit_id int mbtcp/mbtcp.unit_id
mbtcp_len int mbtcp/mbtcp.len
modbus_func_code int modbus/modbus.func_code
modbus_reference_num int modbus/modbus.reference_num
modbus_word_cnt int modbus/modbus.word_cnt
modbus_exception int modbus/modbus.exception
modbus_response_time float modbus/modbus.response_time
modbus_regval_uint16 regval modbus/modbus.regval_uint16
"""
MQTT = """
mqtt_len int mqtt/mqtt.len
mqtt_msgid int mqtt/mqtt.msgid
mqtt_topic str mqtt/mqtt.topic
mqtt_topic_len int mqtt/mqtt.topic_len
mqtt_msgtype int mqtt/mqtt.hdrflags_tree/mqtt.msgtype
mqtt_qos int mqtt/mqtt.hdrflags_tree/mqtt.qos
mqtt_dupflag int mqtt/mqtt.hdrflags_tree/mqtt.dupflag
mqtt_retain int mqtt/mqtt.hdrflags_tree/mqtt.retain
mqtt_payload_hex str mqtt/mqtt.msg
mqtt_payload_len_bytes bytes mqtt/mqtt.msg
"""
OPCUA = """
opcua_transport_type str opcua/opcua.transport.type
opcua_transport_chunk str opcua/opcua.transport.chunk
opcua_transport_size int opcua/opcua.transport.size
opcua_transport_scid int opcua/opcua.transport.scid
opcua_security_tokenid int opcua/opcua.security.tokenid
"""
S7COMM = """
tpkt_version str tpkt/tpkt.version
tpkt_length str tpkt/tpkt.length
cotp_type str cotp/cotp.type
cotp_destref str cotp/cotp.destref
cotp_tpdu_number str cotp/cotp.tpdu-number
cotp_eot str cotp/cotp.eot
s7_header_protid str s7comm/s7comm.header/s7comm.header.protid
s7_header_rosctr str s7comm/s7comm.header/s7comm.header.rosctr
s7_header_redid str s7comm/s7comm.header/s7comm.header.redid
s7_header_pduref str s7comm/s7comm.header/s7comm.header.pduref
s7_header_parlg str s7comm/s7comm.header/s7comm.header.parlg
s7_header_datlg str s7comm/s7comm.header/s7comm.header.datlg
s7_header_errcls str s7comm/s7comm.header/s7comm.header.errcls
s7_header_errcod str s7comm/s7comm.header/s7comm.header.errcod
s7_param_func str s7comm/s7comm.param/s7comm.param.func
s7_param_itemcount str s7comm/s7comm.param/s7comm.param.itemcount
s7_param_pdu_length str s7comm/s7comm.param/s7comm.param.pdu_length
s7_param_maxamq_calling str s7comm/s7comm.param/s7comm.param.maxamq_calling
s7_param_maxamq_called str s7comm/s7comm.param/s7comm.param.maxamq_called
s7_item_varspec str s7comm/s7comm.param/s7comm.param.item/s7comm.param.item.varspec
s7_item_syntaxid str s7comm/s7comm.param/s7comm.param.item/s7comm.param.item.syntaxid
s7_item_transp_size str s7comm/s7comm.param/s7comm.param.item/s7comm.param.item.transp_size
s7_item_length str s7comm/s7comm.param/s7comm.param.item/s7comm.param.item.length
s7_item_db str s7comm/s7comm.param/s7comm.param.item/s7comm.param.item.db
s7_item_area str s7comm/s7comm.param/s7comm.param.item/s7comm.param.item.area
s7_item_address str s7comm/s7comm.param/s7comm.param.item/s7comm.param.item.address
s7_data_returncode str s7comm/s7comm.data/s7comm.data.item/s7comm.data.returncode
s7_data_transportsize str s7comm/s7comm.data/s7comm.data.item/s7comm.data.transportsize
s7_data_length str s7comm/s7comm.data/s7comm.data.item/s7comm.data.length
s7_resp_data_hex str s7comm/s7comm.data/s7comm.data.item/s7comm.resp.data
s7_param_item_raw json s7comm/s7comm.param/s7comm.param.item
s7_data_item_raw json s7comm/s7comm.data/s7comm.data.item
"""
PROFINET = """
pn_rt_frame_id str pn_rt/pn_rt.frame_id
pn_ptcp_sequence_id str pn_ptcp/pn_ptcp.header/pn_ptcp.sequence_id
pn_ptcp_delay1ns str pn_ptcp/pn_ptcp.delay1ns
pn_ptcp_padding str pn_ptcp/pn_ptcp.header/pn.padding
pn_ptcp_tl_type str pn_ptcp/pn_ptcp.block/pn_ptcp.tlvheader/pn_ptcp.tl_type
pn_ptcp_tl_length str pn_ptcp/pn_ptcp.block/pn_ptcp.tlvheader/pn_ptcp.tl_length
pn_ptcp_header_raw json pn_ptcp/pn_ptcp.header
pn_ptcp_block_raw json pn_ptcp/pn_ptcp.block
"""
LAYOUTS = {
    "modbus": HEAD + NETWORK + "delta_source delta -" + MODBUS,
    "mqtt": HEAD + NETWORK + "delta_source delta -" + MQTT,
    "opcua": HEAD + NETWORK + "delta_source delta -" + OPCUA,
    "s7comm": HEAD + NETWORK + "delta_source delta -" + S7COMM,
    "profinet": HEAD + ETHERNET + NETWORK + "delta_source delta -" + PROFINET,
}


def layout(protocol: str) -> list[tuple[str, str, list[str]]]:
    """(name, kind, path) of the columns after ``timestamp``."""
    if protocol not in LAYOUTS:
        raise ValueError(f"unknown protocol {protocol!r}; known: {', '.join(LAYOUTS)}")
    lines = LAYOUTS[protocol].split("\n")
    return [(name, kind, where.split("/")) for name, kind, where in (line.split(" ", 2) for line in lines if line)]


def _object_of(df: DataFrame, name: str, parent: str, key: str) -> DataFrame:
    return df.withColumn(name, child(F.col(parent), key)).withColumn(name, unwrap(F.col(name)))


def parsed(raw: DataFrame, text: str = "raw") -> DataFrame:
    """``raw`` with ``layers__`` (a variant; null where the text is no object with layers)."""
    whole = raw.withColumn("layers__", F.try_parse_json(F.col(text)))
    return _object_of(_object_of(whole, "layers__", "layers__", "_source"), "layers__", "layers__", "layers")


def leaves(rows: DataFrame, wanted: dict[str, list[str]]) -> DataFrame:
    """``rows`` with a variant column ``<name>__`` for each wanted path below ``layers__``, not unwrapped.

    Levels are taken one after another, each object unwrapped once: expressions nested over several levels would repeat
    the lower ones for every use.
    """
    objects = sorted({tuple(path[:n]) for path in wanted.values() for n in range(1, len(path))}, key=lambda p: (len(p), p))
    at = {(): "layers__", **{p: f"object_{i}__" for i, p in enumerate(objects)}}
    for depth in range(1, max((len(p) for p in objects), default=0) + 1):
        own = [p for p in objects if len(p) == depth]
        rows = rows.withColumns({at[p]: child(F.col(at[p[:-1]]), p[-1]) for p in own})
        rows = rows.withColumns({at[p]: unwrap(F.col(at[p])) for p in own})
    return rows.withColumns({f"{name}__": child(F.col(at[tuple(path[:-1])]), path[-1]) for name, path in wanted.items()}).drop(*at.values())


def raw_leaves(rows: DataFrame, text: str, wanted: dict[str, list[str]]) -> DataFrame:
    """As :func:`leaves`, but the JSON text in the source's order of keys, as columns ``<name>__`` that are unwrapped."""
    full = {name: ("_source", "layers", *path) for name, path in wanted.items()}
    nodes = sorted({p[:n] for p in full.values() for n in range(1, len(p) + 1)}, key=lambda p: (len(p), p))
    at = {(): text, **{p: f"json_{i}__" for i, p in enumerate(nodes)}}
    for depth in range(1, max((len(p) for p in nodes), default=0) + 1):
        own = [p for p in nodes if len(p) == depth]
        rows = rows.withColumns({at[p]: F.get_json_object(F.col(at[p[:-1]]), coerce.path(p[-1])) for p in own})
        rows = rows.withColumns({at[p]: coerce.json_unwrap(F.col(at[p])) for p in own})
    rows = rows.withColumns({f"{name}__": F.col(at[p]) for name, p in full.items()})
    return rows.drop(*(c for p, c in at.items() if p))


def first_register(rows: DataFrame, layer: str, out: str) -> DataFrame:
    """``out``: the register value in the first child object of the Modbus layer (JSON text) that has one, in the source's
    order."""
    children = F.map_values(F.from_json(F.col(layer), "map<string,string>"))
    having = F.filter(children, lambda c: c.startswith("{") & F.array_contains(F.json_object_keys(c), "modbus.regval_uint16"))
    rows = rows.withColumn(out, F.get(having, F.lit(0)))
    rows = rows.withColumn(out, F.get_json_object(F.col(out), coerce.path("modbus.regval_uint16")))
    rows = rows.withColumn(out, coerce.json_unwrap(F.col(out)))
    return rows.withColumn(out, F.coalesce(coerce.text_to_long(F.col(out)), F.lit(-1).cast("bigint")))


#: Kinds of value: which kinds are read alike, how an unwrapped variant becomes text, and how a text a value.
READ_AS = {"int": "whole", "zero": "whole", "float": "decimal", "epoch": "time", "str": "text", "bytes": "text", "text": "text", "or_empty": "truthy", "or_any": "truthy"}
TEXTS = {"whole": coerce.number_text, "decimal": coerce.number_text, "time": coerce.number_text, "text": coerce.as_text, "truthy": coerce.truthy_text}
PARSED = {"whole": coerce.text_to_long, "decimal": coerce.text_to_double, "time": coerce.epoch, "text": lambda t: t, "truthy": lambda t: t}
VALUES = {
    "int": lambda v: F.coalesce(v, F.lit(-1).cast("bigint")),
    "zero": lambda v: F.coalesce(v, F.lit(0).cast("bigint")),
    "float": lambda v: F.coalesce(v, F.lit(-1.0)),
    "epoch": lambda v: v,
    "str": lambda v: F.coalesce(v, F.lit("")),
    "bytes": lambda v: packets.payload_bytes(v),
    "text": lambda v: v,
    "or_empty": lambda v: F.coalesce(v, F.lit("")),
    "or_any": lambda v: F.coalesce(v, F.lit("0.0.0.0")),
}


def _texts(values_: Column, reading: str) -> Column:
    """Texts of an array of variants. Strings and numbers are theirs; only lists, booleans and what looks like them, and
    what may be false, are told apart by type."""
    slow = lambda v: coerce.let(unwrap(v), TEXTS[reading])
    if reading == "truthy":
        return F.transform(values_, slow)
    return F.transform(values_, lambda v: coerce.let(F.try_variant_get(v, "$", "string"), lambda t: F.when(t.startswith("[") | t.isin("true", "false"), slow(v)).otherwise(t)))


DELTAS = {"frame_delta": ["frame", "frame.time_delta"], "tcp_delta": ["tcp", "Timestamps", "tcp.time_delta"]}


def values(rows: DataFrame, fields: list[tuple[str, str, list[str]]]) -> DataFrame:
    """``rows`` (from :func:`parsed`) with a column for each field (name, kind, path), and ``delta_source``.

    Values that are read alike stand in one array, over which the reading is stated once: stated for each column, the
    generated code would be over what a method may have, and Spark would give it up.
    """
    before = [c for c in rows.columns]
    wide = leaves(rows, {name: path for name, _, path in fields} | DELTAS)
    wide = wide.withColumn("delta_source", packets.delta_source(F.col("frame_delta__"), F.col("tcp_delta__")))
    alike = {reading: [name for name, kind, _ in fields if READ_AS[kind] == reading] for reading in TEXTS}
    alike = {reading: names for reading, names in alike.items() if names}
    wide = wide.select(*(c for c in before if c != "layers__"), "delta_source", *(F.array(*(F.col(f"{name}__") for name in names)).alias(f"read_{reading}__") for reading, names in alike.items()))
    wide = wide.withColumns({f"read_{reading}__": _texts(F.col(f"read_{reading}__"), reading) for reading in alike})
    wide = wide.withColumns({f"read_{reading}__": F.transform(f"read_{reading}__", PARSED[reading]) for reading in alike if reading not in ("text", "truthy")})
    found = {name: VALUES[kind](F.get(f"read_{READ_AS[kind]}__", F.lit(alike[READ_AS[kind]].index(name)))) for name, kind, _ in fields}
    return wide.select(*(c for c in before if c != "layers__"), "delta_source", *(c.alias(name) for name, c in found.items()))


def extracted(raw: DataFrame, protocol: str, text: str = "raw", keep: tuple[str, ...] = ()) -> DataFrame:
    """Flat rows of ``protocol`` from packets in column ``text``; ``keep``: columns to carry along. No shuffle."""
    columns = layout(protocol)
    rows = parsed(raw.where(F.col(text).isNotNull()).select(*keep, F.col(text).alias("text__")), "text__")
    rows = rows.withColumn("has_vlan", F.when(child(F.col("layers__"), "vlan").isNotNull(), 1).otherwise(0))
    found = values(rows, [("timestamp", "epoch", ["frame", "frame.time_epoch"]), *(c for c in columns if c[1] in VALUES)])
    raws = {name: path for name, kind, path in columns if kind == "json"}
    found = raw_leaves(found, "text__", raws | {name: path[:1] for name, kind, path in columns if kind == "regval"})
    found = found.withColumns({name: F.coalesce(f"{name}__", F.lit("")) for name in raws})
    for name in (name for name, kind, _ in columns if kind == "regval"):
        found = first_register(found, f"{name}__", name)
    return found.select(*keep, "timestamp", *(name for name, _, _ in columns))


def with_overflows(raw: DataFrame, protocol: str, text: str = "raw") -> DataFrame:
    """``raw`` with ``overflow__``: whether an integer column of the packet is an infinity, for which there is no row."""
    whole = {name: path for name, kind, path in layout(protocol) if kind == "int"}
    rows = leaves(parsed(raw, text), whole)
    rows = rows.withColumns({f"{name}__": unwrap(F.col(f"{name}__")) for name in whole})
    texts = F.array(*(F.try_variant_get(F.col(f"{name}__"), "$", "string") for name in whole))
    return rows.select(*raw.columns, F.exists(texts, coerce.overflows).alias("overflow__"))


COMMON = [
    ("ts", "epoch", ["frame", "frame.time_epoch"]),
    ("pkt_len", "zero", ["frame", "frame.len"]),
    ("src_ip", "or_any", ["ip", "ip.src"]),
    ("dst_ip", "or_any", ["ip", "ip.dst"]),
    ("src_port", "or_empty", ["tcp", "tcp.srcport"]),
    ("dst_port_text", "or_empty", ["tcp", "tcp.dstport"]),
]


def modbus_packets(raw: DataFrame, text: str = "raw") -> DataFrame:
    """Inputs of the window features from packets that have both Modbus layers. Carries ``seq``."""
    rows = parsed(raw.select("seq", F.col(text).alias("text__")), "text__")
    rows = rows.where(child(F.col("layers__"), "mbtcp").isNotNull() & child(F.col("layers__"), "modbus").isNotNull())
    found = values(rows, [*COMMON, ("unit_id", "int", ["mbtcp", "mbtcp.unit_id"]), ("fc", "int", ["modbus", "modbus.func_code"]), ("exception", "zero", ["modbus", "modbus.exception"])])
    request, response = packets.direction(F.col("src_port"), F.col("dst_port_text"), packets.MODBUS_PORT)
    flags = [request.alias("is_request"), response.alias("is_response"), F.when(F.col("exception") > 0, 1).otherwise(0).alias("is_exception")]
    return found.select("seq", "ts", "pkt_len", "src_ip", "dst_ip", "unit_id", "fc", *flags, "delta_source")


def mqtt_packets(raw: DataFrame, text: str = "raw") -> DataFrame:
    """Inputs of the window features from packets that have the MQTT layer. Carries ``seq``."""
    rows = parsed(raw.select("seq", F.col(text).alias("text__")), "text__")
    rows = rows.where(child(F.col("layers__"), "mqtt").isNotNull())
    tree = ["mqtt", "mqtt.hdrflags_tree"]
    own = [
        ("dst_port", "int", ["tcp", "tcp.dstport"]),
        ("fc", "int", [*tree, "mqtt.msgtype"]),
        ("mqtt_qos", "int", [*tree, "mqtt.qos"]),
        ("dup", "zero", [*tree, "mqtt.dupflag"]),
        ("retain", "zero", [*tree, "mqtt.retain"]),
        ("topic", "text", ["mqtt", "mqtt.topic"]),
        ("payload", "or_empty", ["mqtt", "mqtt.msg"]),
    ]
    found = values(rows, [*COMMON, *own])
    request, response = packets.direction(F.col("src_port"), F.col("dst_port_text"), packets.MQTT_PORT)
    return found.select(
        *("seq", "ts", "pkt_len", "src_ip", "dst_ip", "dst_port", "fc"),
        request.alias("is_request"),
        response.alias("is_response"),
        F.lit(0).alias("is_exception"),
        "delta_source",
        "mqtt_qos",
        F.when(F.col("dup") > 0, 1).otherwise(0).alias("mqtt_dup"),
        F.when(F.col("retain") > 0, 1).otherwise(0).alias("mqtt_retain"),
        packets.topic_length(F.col("topic")).alias("mqtt_topic_len"),
        packets.topic_bucket(F.col("topic")).alias("mqtt_topic_bucket"),
        packets.payload_bytes(F.col("payload")).cast("bigint").alias("mqtt_payload_len"),
    )


def builder_input(rows: DataFrame) -> DataFrame:
    """Flat Modbus rows with ``seq`` as the builder's parsed-packet columns, all text, as its CSV would have them."""
    _, response = packets.direction(F.col("tcp_srcport").cast("string"), F.col("tcp_dstport").cast("string"), packets.MODBUS_PORT)
    names = {"timestamp": "timestamp", "src_ip": "src_ip", "dst_ip": "dst_ip", "mb_unit_id": "mbtcp_unit_id", "mb_func_code": "modbus_func_code", "mb_reg_addr": "modbus_reference_num", "mb_word_cnt": "modbus_word_cnt", "mb_response_time": "modbus_response_time"}
    return rows.select("seq", *(F.col(old).cast("string").alias(new) for new, old in names.items()), response.cast("string").alias("is_response"))
