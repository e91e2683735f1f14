"""Whole jobs, files to files, and streaming against batch."""

import json

from pyspark.sql import functions as F

from packetloom.operators import arrival, builder
from packetloom.plans import jobs
from packetloom.streaming import features as streaming
from test_operators import KEYS, make_packets


def packet_file(path, packets):
    with open(path, "w") as file:
        file.write("[")
        for i, p in enumerate(packets):
            request = p["is_request"]
            layers = {"frame": {"frame.time_epoch": str(p["ts"]), "frame.len": str(p["pkt_len"])}, "ip": {"ip.src": p["src_ip"], "ip.dst": "b"}, "tcp": {"tcp.srcport": "9" if request else "502", "tcp.dstport": "502" if request else "9"}, "mbtcp": {"mbtcp.unit_id": "1"}, "modbus": {"modbus.func_code": str(p["fc"]), "modbus.word_cnt": "2"}}
            file.write((",\n" if i else "") + json.dumps({"_source": {"layers": layers}}, indent=1))
        file.write("]")
    return str(path)


def test_chain(spark, tmp_path):
    source = packet_file(tmp_path / "x.json", make_packets(400))
    done = jobs.convert(spark, source, str(tmp_path / "lines"))
    assert (done["total"], done["bad"], done["ok"]) == (400, 0, 400)
    assert jobs.convert(spark, source, None, "parse-only")["ok"] == 400
    assert jobs.extract(spark, str(tmp_path / "lines"), "modbus", str(tmp_path / "csv")) == {"protocol": "modbus", "total": 400, "bad": 0}
    counts = jobs.preprocess(spark, str(tmp_path / "lines"), "modbus", str(tmp_path / "features"), windows=(1, 5))
    assert counts["packets"] == 400 and counts["skipped_missing_layer"] == 0
    # every packet is in each window size once, and the global rows have them all
    total = spark.read.text(str(tmp_path / "features")).select("window_sec", "kind", F.get_json_object("value", "$.pkt_cnt").cast("long").alias("n"))
    by = {(r.window_sec, r.world): r.n for r in total.groupBy("window_sec", (F.col("kind") == "global").alias("world")).agg(F.sum("n").alias("n")).collect()}
    assert by == {(w, k): 400 for w in (1, 5) for k in (True, False)}
    summary = jobs.postprocess(spark, str(tmp_path / "features"), str(tmp_path / "post"), windows=(1, 5, 30), top={1: 2, 5: 2, 30: 2}, split_files=True)
    one, _, thirty = summary["windows"]
    assert thirty["split"]["train_end_t0"] is None and one["keep_policy"]["train_unique_keys_seen"] >= 2
    flows = spark.read.text(str(tmp_path / "post" / "flow_all" / "window_sec=1"))
    assert flows.agg(F.sum(F.get_json_object("value", "$.pkt_cnt").cast("long"))).first()[0] == 400
    assert sum(one["split"]["counts"]["flow_all"].values()) == flows.count()
    for name in ("flow_kept", "other", "global_post", "flow_all", "flow_all.splits"):
        for folder in {f.parent for f in (tmp_path / "post" / name / "window_sec=1").rglob("part-*.txt")}:
            times = [json.loads(line)["t0"] for file in sorted(folder.glob("part-*.txt")) for line in file.read_text().splitlines()]
            assert times == sorted(times) and times
    keys = [json.loads(r.value) for r in spark.read.text(str(tmp_path / "post" / "keep_keys.train" / "window_sec=1")).collect()]
    assert len(keys) == 2 and all(set(k) == {"key", "source_split"} and set(k["key"]) == set(KEYS) and k["source_split"] == "train" for k in keys)
    assert json.loads((tmp_path / "post" / "postprocess.meta.json").read_text())["schema_version"] == "v1"


def test_faithful_mode_adds_up(spark):
    packets = spark.createDataFrame(make_packets(800))
    rows = jobs.feature_rows(packets, jobs.PARSERS["modbus"][1], (5,), faithful=True)
    assert [r.n for r in rows.groupBy("key_type").agg(F.sum("pkt_cnt").alias("n")).collect()] == [800, 800]
    assert rows.count() > jobs.feature_rows(packets, jobs.PARSERS["modbus"][1], (5,)).count()


def test_builder_chain(spark, tmp_path):
    header = "timestamp,src_ip,dst_ip,mb_unit_id,is_response,mb_func_code,mb_reg_addr,mb_word_cnt,mb_response_time"
    lines = [f"{p['ts']},{p['src_ip']},b,1,{p['is_response']},{p['fc']},5,2,0.1" for p in make_packets(300)]
    (tmp_path / "in.csv").write_text("\n".join([header, *lines, "oops,a,b,1,0,3,,,"]) + "\n")
    report = jobs.build(spark, str(tmp_path / "in.csv"), str(tmp_path / "w"), str(tmp_path / "s"), str(tmp_path / "r.json"))
    assert report["counts"] == {"rows_total": 301, "rows_parsed": 300, "parse_errors": 1} and report["error_samples"][0]["timestamp"] == "oops"
    schema = jobs.flatten_features(spark, str(tmp_path / "w"), str(tmp_path / "s"), str(tmp_path / "wf"), str(tmp_path / "sf"), str(tmp_path / "r.json"), str(tmp_path / "schema.json"))
    assert schema["key_mode"] == "src_dst_unit" and set(schema["top_fc_list"]) == {"-1", "1", "3", "6", "16", "131"}
    flat = spark.read.csv(str(tmp_path / "wf"), header=True)
    assert "fc_hist_json" not in flat.columns and {"FC_3", "FC_OTHER", "FC_EXCEPTION_TOTAL"} <= set(flat.columns)
    assert flat.where("window_sec = 1").agg(F.sum(F.col("packet_count").cast("long"))).first()[0] == 300


def test_streaming_equals_batch(spark, tmp_path):
    packets = spark.createDataFrame(make_packets(1200, disorder=0.0))
    packets.orderBy("seq").coalesce(1).write.option("maxRecordsPerFile", 300).parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(packets.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))

    def run(df, name):
        sink = df.writeStream.format("parquet").option("path", str(tmp_path / name)).option("checkpointLocation", str(tmp_path / f"{name}-ck"))
        sink.trigger(availableNow=True).start().awaitTermination()
        return spark.read.parquet(str(tmp_path / name))

    stateful = run(streaming.with_flow_state(stream.select("seq", "ts", *KEYS), KEYS), "state")
    batch = builder.in_sessions(arrival.flow_gaps(packets.select("seq", "ts", *KEYS), KEYS).withColumnRenamed("unit_id", "mb_unit_id")).withColumnRenamed("mb_unit_id", "unit_id")
    assert stateful.count() == 1200 and stateful.exceptAll(batch.select(stateful.columns)).count() == 0
    windows = run(streaming.window_counts(streaming.timed(stream), KEYS, 5), "windows")
    expected = packets.withColumn("t0", F.floor(F.col("ts") / 5) * 5.0).groupBy(*KEYS, "t0").agg(F.count("*").alias("pkt_cnt"))
    over = windows.agg(F.max("t0")).first()[0]
    assert windows.count() == expected.where(F.col("t0") <= over).count()
    assert windows.select(*KEYS, "t0", "pkt_cnt").exceptAll(expected).count() == 0


def test_progress():
    from packetloom.streaming.progress import Progress

    progress = Progress(seconds=60)
    for now, rows in ((0, 100), (50, 10), (80, 30), (90, 20)):
        progress.seen(rows, now)
    said = progress.summary(100)
    assert (said["rows"], said["batches"]) == (160, 4) and said["rows_per_sec"] == 50 / 50


def test_signature(spark, tmp_path):
    import hashlib

    from packetloom.sources import packet_json

    (tmp_path / "f").write_text("abc")
    found = packet_json.signature(spark, str(tmp_path / "f"))
    assert found["size"] == 3 and found["head_sha1"] == hashlib.sha1(b"abc").hexdigest()
