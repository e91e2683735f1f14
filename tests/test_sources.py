"""Readers and writers, on clean and on damaged files."""

import gzip
import json

import pytest

from packetloom.sources import packet_json, tables


def test_layouts():
    assert packet_json.layout_of(b"") == "jsonl" and packet_json.layout_of(b" \n", "json_array") == "json_array"
    assert packet_json.layout_of("﻿\0 [1".encode()) == "json_array" and packet_json.layout_of(b'{"a": [') == "jsonl"


def test_lines_are_cleaned_and_numbered(spark, tmp_path):
    path = tmp_path / "a.jsonl"
    path.write_bytes(b'\xef\xbb\xbf[\n{"a":1},\n\n{"b"\0:2}\n{broken\n{"c":"x\xff"},\n]\n')
    rows = packet_json.read_lines(spark, str(path)).orderBy("seq").collect()
    assert [(r.raw, r.error) for r in rows] == [('{"a":1}', None), ('{"b":2}', None), ("{broken", "not JSON"), ('{"c":"x"}', None)]
    assert [r.seq for r in rows] == sorted(r.seq for r in rows)
    with pytest.raises(Exception, match="not JSON"):
        packet_json.read_lines(spark, str(path), strict=True).collect()


def test_order_over_splits_and_files(spark, tmp_path):
    for name, base in (("b.jsonl", 5000), ("a.jsonl", 0)):
        (tmp_path / name).write_text("".join(f'{{"n":{base + i}}}\n' for i in range(5000)))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "9000")
    try:
        rows = packet_json.read_lines(spark, str(tmp_path)).orderBy("seq").collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert [json.loads(r.raw)["n"] for r in rows] == list(range(10000)) and [r.seq for r in rows] == list(range(1, 10001))
    assert packet_json.read_lines(spark, str(tmp_path), skip=9990).count() == 10


@pytest.mark.parametrize("size", [1, 2, 3, 7, 64, 10_000])
def test_array_in_chunks(size):
    data = '﻿junk [ {"a": "ü[]{}", "b": [1, 2]} ,\n 12 , "x\\"y", {"k": null}, 3.5e2 ] trailing'.encode()
    chunks = iter([data[i : i + size] for i in range(0, len(data), size)])
    assert [json.loads(t) for t, _ in packet_json.objects_in(chunks) if t] == [{"a": "ü[]{}", "b": [1, 2]}, 12, 'x"y', {"k": None}, 350.0]


def test_torn_and_damaged_arrays():
    items = lambda data, **more: list(packet_json.objects_in(iter([data]), **more))
    assert items(b'[{"a":1},{"b":') == [('{"a":1}', None), (None, "the last item is torn")]
    assert items(b"") == [] and items(b"   ") == [] and items(b"[") == [] and items(b"[]") == []
    assert items(b'[{"a":1\0},\0{"b":2}]') == [('{"a":1}', None), ('{"b":2}', None)]
    broken = b'[{"a" 1 ' + b" " * 50 + b', {"b":2}, {"c":3}]'
    assert [t for t, e in packet_json.objects_in(iter([broken[:60], broken[60:], b" "]), max_buffer=20) if not e] == ['{"b":2}', '{"c":3}']


def test_arrays_of_several_files(spark, tmp_path):
    (tmp_path / "a.json").write_text('[{"n": 1}, {"n": 2}]')
    with gzip.open(tmp_path / "b.json.gz", "wt") as file:
        file.write('[{"n": 3}')
    rows = packet_json.read_packets(spark, str(tmp_path)).orderBy("seq").collect()
    assert [r.raw for r in rows] == ['{"n": 1}', '{"n": 2}', '{"n": 3}']
    assert packet_json.read_array(spark, str(tmp_path / "a.json"), skip=1).count() == 1


def test_csv_round_trip(spark, tmp_path):
    rows = spark.createDataFrame([("a,b", 'q"x', 1.5), ("", "ü", 2.0)], "x string, y string, z double")
    tables.write_csv(rows, str(tmp_path / "out"), one_file=True)
    text = next((tmp_path / "out").glob("part-*")).read_bytes()
    assert text.startswith(b"x,y,z\r\n") and text.count(b"\r\n") == 3 and b'"a,b","q""x",1.5' in text
    back = tables.read_csv(spark, str(tmp_path / "out")).orderBy("seq").collect()
    assert [(r.x or "", r.y) for r in back] == [("a,b", 'q"x'), ("", "ü")]


def test_documents(spark, tmp_path):
    path = str(tmp_path / "d.json")
    assert tables.read_document(spark, path) is None
    tables.write_document(spark, path, {"a": 1})
    tables.write_document(spark, path, {"a": "ü"})
    assert tables.read_document(spark, path) == {"a": "ü"}
    (tmp_path / "bad.json").write_text("{")
    assert tables.read_document(spark, str(tmp_path / "bad.json")) is None


def test_scratch_needs_a_shared_folder_on_a_cluster():
    from types import SimpleNamespace

    from packetloom.session import shared_dir

    def session(master, folder=None):
        return SimpleNamespace(conf=SimpleNamespace(get=lambda key, default=None: folder), sparkContext=SimpleNamespace(master=master))

    with pytest.raises(ValueError, match="checkpoint"):
        shared_dir(session("local-cluster[2,1,512]"))
    assert shared_dir(session("spark://somewhere:7077", "hdfs://all/")) == "hdfs://all"
    assert shared_dir(session("local[2]")) == shared_dir(session("local[2]"))
