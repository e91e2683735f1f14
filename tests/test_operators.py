"""Operators against plain loops, on packets with disorder, gaps, ties and long samples."""

import json
import math
import random
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from packetloom.functions import stats
from packetloom.operators import arrival, builder, flatten, fragments, retention, window_features

KEYS = ["src_ip", "dst_ip", "unit_id"]


def make_packets(n=3000, flows=5, disorder=0.15, seed=3, step=0.4):
    rnd, now, out = random.Random(seed), 1000.0, []
    for seq in range(1, n + 1):
        now += rnd.choice([0.0, 0.003, step, step, 1.5, 35.0 if rnd.random() < 0.01 else 0.2])
        ts = now - rnd.choice([0.0005, 0.05, 3.0]) if rnd.random() < disorder else now
        out.append(
            {"seq": seq, "ts": round(ts, 4), "pkt_len": rnd.randint(60, 90), "src_ip": f"10.0.0.{rnd.randrange(flows) if rnd.random() < 0.7 else 0}", "dst_ip": "b", "unit_id": 1, "fc": rnd.choice([-1, 1, 3, 6, 16, 131]), "is_request": rnd.randint(0, 1), "is_response": rnd.randint(0, 1), "is_exception": rnd.randint(0, 1), "delta_source": rnd.choice(["frame", "tcp", "none", "odd"]),
             "mqtt_qos": rnd.randint(-1, 2), "mqtt_dup": rnd.randint(0, 1), "mqtt_retain": rnd.randint(0, 1), "mqtt_topic_len": rnd.randint(-1, 9), "mqtt_topic_bucket": rnd.randint(-1, 5), "mqtt_payload_len": rnd.randint(0, 3)}
        )
    return out


def lower(values, p):
    return sorted(values)[int(p * (len(values) - 1))] if values else 0.0


def entropy(counts):
    total = sum(counts)
    return -sum(c / total * math.log(c / total + 1e-9) for c in counts) if total else 0.0


def spread(values):
    mean = sum(values) / len(values) if values else 0.0
    return mean, math.sqrt(sum((v - mean) ** 2 for v in values) / len(values)) if values else 0.0, lower(values, 0.5), lower(values, 0.95)


def loop_features(packets, width, by_flow=True, tail=4096):
    last, groups = {}, defaultdict(list)
    for p in packets:
        flow = (p["src_ip"], p["dst_ip"], p["unit_id"]) if by_flow else ()
        gap = p["ts"] - last.get(flow, p["ts"])
        last[flow] = p["ts"]
        groups[(*flow, math.floor(p["ts"] / width) * width)].append((p, max(gap, 0.0), gap < 0))
    out = {}
    for key, rows in groups.items():
        ps = [p for p, _, _ in rows]
        inter = [g for _, g, _ in rows if g > 0][-tail:]
        codes = Counter(p["fc"] for p in ps if p["fc"] >= 0)
        mean, std, p50, p95 = spread(inter)
        req, resp = sum(p["is_request"] for p in ps), sum(p["is_response"] for p in ps)
        sources = Counter(p["delta_source"] if p["delta_source"] in ("frame", "tcp") else "none" for p in ps)
        out[key] = {"pkt_cnt": len(ps), "byte_cnt": sum(p["pkt_len"] for p in ps), "pkt_rate": len(ps) / width, "req_cnt": req, "resp_cnt": resp, "req_resp_ratio": min(req / max(resp, 1), 1e6), "exc_ratio": sum(p["is_exception"] for p in ps) / len(ps), "fc_unique_cnt": len(codes), "fc_entropy": entropy(codes.values()), "inter_cnt_pos": len(inter), "inter_mean": mean, "inter_std": std, "inter_p50": p50, "inter_p95": p95, "burstiness": p95 / max(p50, 1e-9), "neg_delta_cnt": sum(n for _, _, n in rows), **{f"delta_src_{s}_cnt": sources[s] for s in ("frame", "tcp", "none")}}
        pubs = [p for p in ps if p["fc"] == 3]
        topics, types = Counter(p["mqtt_topic_bucket"] for p in ps if p["mqtt_topic_bucket"] >= 0), codes
        for name, values in (("pub_payload_len", [p["mqtt_payload_len"] for p in pubs][-tail:]), ("topic_len", [p["mqtt_topic_len"] for p in ps if p["mqtt_topic_len"] >= 0][-tail:])):
            out[key] |= dict(zip((f"{name}_{s}" for s in ("mean", "std", "p50", "p95")), spread(values), strict=True))
        share = lambda met: sum(map(met, pubs)) / max(len(pubs), 1)  # noqa: B023, E731
        out[key] |= {"pub_cnt": len(pubs), "pub_qos1_ratio": share(lambda p: p["mqtt_qos"] == 1), "pub_dup_ratio": share(lambda p: p["mqtt_dup"] > 0), "pub_payload_nonempty_ratio": share(lambda p: p["mqtt_payload_len"] > 0), "topic_unique_cnt": len(topics), "topic_entropy": entropy(topics.values()), "mqtt_type_subscribe_cnt": types[8], "mqtt_type_puback_cnt": types[4], "ack_ratio": sum(types[t] for t in (4, 5, 6, 7, 9, 11)) / len(ps), "pub_to_sub_ratio": types[3] / max(types[8], 1)}
    return out


@pytest.fixture(scope="module")
def packets():
    return make_packets()


@pytest.fixture(scope="module")
def frame(spark, packets):
    return spark.createDataFrame(packets).repartition(5).cache()


def compare(rows, expected, key):
    got = {key(r): r for r in rows}
    assert got.keys() == expected.keys()
    for k, want in expected.items():
        for name, value in want.items():
            if name in got[k].asDict():
                assert got[k][name] == pytest.approx(value, rel=1e-9, abs=1e-12), (k, name)


@pytest.mark.parametrize("width", [1, 5, 30])
def test_flow_features(frame, packets, width):
    rows = window_features.features(window_features.in_windows(arrival.clipped(arrival.flow_gaps(frame, KEYS)), (width,))).collect()
    assert len(rows[0]) == 26 - 1 + 3  # the key is three columns
    compare(rows, loop_features(packets, float(width)), lambda r: (r.src_ip, r.dst_ip, r.unit_id, r.t0))


def test_mqtt_features(frame, packets):
    mqtt = frame.withColumnRenamed("unit_id", "dst_port")
    keys = list(window_features.MQTT.key)
    rows = window_features.features(window_features.in_windows(arrival.clipped(arrival.flow_gaps(mqtt, keys)), (30,)), window_features.MQTT).collect()
    assert len(rows[0]) == 64 - 1 + 3
    compare(rows, loop_features(packets, 30.0), lambda r: (r.src_ip, r.dst_ip, r.dst_port, r.t0))


def test_global_features_and_ranges(frame, packets):
    gaps = arrival.global_gaps(frame, ranges=7)
    rows = window_features.features(window_features.in_windows(arrival.clipped(gaps), (5,)), keys=()).collect()
    compare(rows, loop_features(packets, 5.0, by_flow=False), lambda r: (r.t0,))


def test_last_samples_only(spark):
    packets = make_packets(9000, 1, 0.0, 5, 0.1)
    frame = spark.createDataFrame(packets)
    rows = window_features.features(window_features.in_windows(arrival.clipped(arrival.flow_gaps(frame, [])), (10**6,)), keys=()).collect()
    compare(rows, loop_features(packets, 1e6, by_flow=False), lambda r: (r.t0,))
    assert rows[0].inter_cnt_pos == 4096


def test_ranges_equal_plain_lag(frame):
    cuts = arrival.cut_points(frame, "seq", 9)
    plain, ranged = (arrival.flow_gaps(frame, KEYS, cuts=c).select("seq", "raw_iat") for c in (None, cuts))
    assert len(cuts) == 8 and plain.exceptAll(ranged).count() == 0 and ranged.exceptAll(plain).count() == 0


def test_routing_by_twenty_packets(spark):
    rows = spark.createDataFrame([("flow", 19), ("flow", 20), ("global", 3)], "key_type string, pkt_cnt long")
    assert [r.kind for r in window_features.routed(rows).collect()] == ["sparse", "key", "global"]


def test_documents(frame):
    rows = window_features.features(window_features.in_windows(arrival.clipped(arrival.flow_gaps(frame, KEYS)), (30,)))
    found = json.loads(window_features.rendered(window_features.routed(rows)).first().value)
    assert list(found)[:5] == ["schema_version", "t0", "window_sec", "key_type", "key"] and set(found["key"]) == set(KEYS) and len(found) == 26
    world = window_features.features(window_features.in_windows(arrival.clipped(arrival.flow_gaps(frame, [])), (30,)), keys=())
    assert json.loads(window_features.rendered(world).first().value)["key"] == "__global__"


def loop_fragments(packets, width, sweep):
    open_, out = {}, Counter()
    numbers = Counter()
    for p in packets:
        flow, t0 = (p["src_ip"], p["dst_ip"], p["unit_id"]), math.floor(p["ts"] / width) * width
        if open_.get(flow) != t0:
            numbers[flow] += 1
            open_[flow] = t0
        out[(*flow, t0, numbers[flow])] += 1
        if sweep and p["seq"] % sweep == 0:
            for other in [f for f, start in open_.items() if start < t0]:
                del open_[other]
    return out


@pytest.mark.parametrize(("width", "sweep"), [(5.0, 100), (5.0, None), (1.0, 37), (30.0, 50)])
def test_fragments(frame, packets, width, sweep):
    rows = fragments.fragments(frame, KEYS, width, sweep_every=sweep).groupBy(*KEYS, "t0", "fragment").count().collect()
    assert {tuple(r)[:5]: r["count"] for r in rows} == dict(loop_fragments(packets, width, sweep))


def test_in_order_fragments_are_windows(spark):
    frame = spark.createDataFrame(make_packets(1500, disorder=0.0))
    found = fragments.fragments(frame, KEYS, 5.0, sweep_every=100)
    assert found.select(*KEYS, "t0", "fragment").distinct().count() == found.select(*KEYS, "t0").distinct().count()


# --- builder ---------------------------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def rows(packets):
    rnd = random.Random(8)
    return [{"seq": p["seq"], "ts": p["ts"], "src_ip": p["src_ip"], "dst_ip": "b", "mb_unit_id": "1", "is_response": p["is_response"], "fc": p["fc"], "addr": rnd.choice([-1, 5, 40]), "qty": rnd.randint(-1, 4), "resp_time": rnd.choice([-1.0, 0.25, 0.5])} for p in packets]


def loop_metrics(items, duration):
    """items: (row, raw gap or None)."""
    back = [-g for _, g in items if g is not None and g < 0]
    ahead = [g for _, g in items if g is not None and g >= 0]
    codes = Counter(r["fc"] for r, _ in items)
    read, write = sum(codes[c] for c in (1, 2, 3, 4)), sum(codes[c] for c in (5, 6, 15, 16, 22, 23))
    resp = sum(r["is_response"] == 1 for r, _ in items)
    req = len(items) - resp
    addr, qty, times = [r["addr"] for r, _ in items if r["addr"] >= 0], [float(r["qty"]) for r, _ in items if r["qty"] > 0], [r["resp_time"] for r, _ in items if r["resp_time"] > 0]
    sample = lambda v: math.sqrt(sum((x - sum(v) / len(v)) ** 2 for x in v) / (len(v) - 1)) if len(v) > 1 else 0.0
    mean = lambda v: sum(v) / len(v) if v else 0.0
    bins = Counter(next((f"<{b}s" for b in (0.001, 0.01, 0.1, 1.0) if g < b), ">=1.0s") for g in back)
    pairs = len(back) + len(ahead)
    return {"packet_count": len(items), "pps": len(items) / duration if duration > 0 else 0.0, "iat_pairs": pairs, "iat_count": len(ahead), "iat_mean": mean(ahead), "iat_std": sample(ahead), "iat_p50": lower(ahead, 0.5), "iat_p95": lower(ahead, 0.95), "burst_ratio": sum(g < 0.01 for g in ahead) / len(ahead) if ahead else 0.0, "idle_gap_count": sum(g > 1.0 for g in ahead), "negative_delta_count": len(back), "out_of_order_rate": len(back) / pairs if pairs else 0.0, "max_negative_delta_sec": max(back, default=0.0), "p99_negative_delta_sec": lower(back, 0.99), "negative_delta_hist_json": dict(bins), "req_count": req, "resp_count": resp, "req_resp_ratio": req / resp if resp else float(req), "exception_count": codes[131], "exception_ratio": codes[131] / len(items), "read_count": read, "write_count": write, "read_write_ratio": read / write if write else float(read), "other_fc_count": len(items) - read - write, "fc_hist_json": {str(k): v for k, v in codes.items()}, "addr_min": min(addr, default=-1), "addr_max": max(addr, default=-1), "addr_span": max(addr) - min(addr) if addr else -1, "qty_count": len(qty), "qty_mean": mean(qty), "qty_std": sample(qty), "qty_max": max(qty, default=0.0), "resp_time_count": len(times), "resp_time_mean": mean(times), "resp_time_p95": lower(times, 0.95)}


def check_metrics(row, want):
    for name, value in want.items():
        if isinstance(value, dict):
            assert json.loads(row[name]) == value and list(json.loads(row[name])) == list(value), name
        else:
            assert row[name] == pytest.approx(value, rel=1e-9, abs=1e-9), name


def loop_sessions(rows, idle=30.0, reset=1.0):
    state, done = {}, []
    for r in rows:
        flow = r["src_ip"]
        known = state.get(flow)
        gap = None if known is None else r["ts"] - known["last"]
        if known is None or gap > idle or gap < -reset:
            known = state[flow] = {"id": len(done) + 1, "start": r["ts"], "items": []}
            done.append(known)
        known["last"] = r["ts"]
        known["items"].append((r, gap))
    return done


def test_sessions(spark, rows):
    found = {r.session_id: r for r in builder.session_rows(builder.with_gaps(spark.createDataFrame(rows).repartition(3))).collect()}
    expected = loop_sessions(rows)
    assert sorted(found) == [s["id"] for s in expected]
    for s in expected:
        r = found[s["id"]]
        assert (r.session_start_epoch, r.session_end_epoch, len(r)) == (s["start"], s["last"], 43)
        assert r.session_duration_sec == pytest.approx(max(0.0, s["last"] - s["start"]))
        check_metrics(r, loop_metrics(s["items"], max(0.0, s["last"] - s["start"])))


def test_gap_of_exactly_thirty_seconds_goes_on(spark):
    times = [0.0, 30.0, 60.1, 59.1, 58.0]
    rows = [{"seq": i, "ts": t, "src_ip": "a", "dst_ip": "b", "mb_unit_id": "1"} for i, t in enumerate(times)]
    got = builder.in_sessions(builder.with_gaps(spark.createDataFrame(rows))).orderBy("seq").collect()
    assert [r.session for r in got] == [1, 1, 2, 2, 3]


@pytest.mark.parametrize("width", [1, 5])
def test_builder_windows(spark, rows, width):
    last, groups = {}, defaultdict(list)
    for r in rows:
        gap = r["ts"] - last[r["src_ip"]] if r["src_ip"] in last else None
        last[r["src_ip"]] = r["ts"]
        groups[(r["src_ip"], math.floor(r["ts"] / width) * width)].append((r, gap))
    found = {(r.src_ip, r.window_start_epoch): r for r in builder.window_rows(builder.with_gaps(spark.createDataFrame(rows)), (width,)).collect()}
    assert found.keys() == groups.keys()
    for key, items in groups.items():
        assert len(found[key]) == 42 and found[key].window_end_epoch == key[1] + width and found[key].window_key == f"{key[0]}|b|1"
        check_metrics(found[key], loop_metrics(items, float(width)))


def test_order_quality(spark, rows):
    last, items = {}, []
    for r in rows:
        items.append((r, r["ts"] - last[r["src_ip"]] if r["src_ip"] in last else None))
        last[r["src_ip"]] = r["ts"]
    want, got = loop_metrics(items, 1.0), builder.order_quality(builder.with_gaps(spark.createDataFrame(rows))).first()
    for name in ("iat_pairs", "negative_delta_count", "out_of_order_rate", "max_negative_delta_sec", "p99_negative_delta_sec"):
        assert got[name] == pytest.approx(want[name])
    assert json.loads(got.negative_delta_histogram) == want["negative_delta_hist_json"] and got.recommended_action == "investigate-pipeline-first"


def test_quality_gate(spark):
    cases = [(0.0, 9.0, "none"), (1e-4, 9.0, "none"), (1e-3, 1.0, "micro-sort(1~2s)"), (1e-3, 1.1, "investigate-pipeline-first"), (0.01, 0.1, "investigate-pipeline-first")]
    rows = spark.createDataFrame(cases, "a double, b double, c string").select("c", builder.quality_gate(F.col("a"), F.col("b")).alias("d"))
    assert all(r.c == r.d for r in rows.collect())


def test_parsed_rows(spark):
    columns = ["seq", "timestamp", "src_ip", "dst_ip", "mb_unit_id", "is_response", "mb_func_code", "mb_reg_addr", "mb_word_cnt", "mb_response_time"]
    raw = spark.createDataFrame([(1, "1.5", "a", "b", "7", "1", "3.0", "x", None, "0.5"), (2, "nan", *"abcdefgh"), (3, "", *"abcdefgh")], ", ".join(f"{c} {'long' if c == 'seq' else 'string'}" for c in columns))
    (row,) = builder.parsed_rows(raw).collect()
    assert (row.ts, row.mb_unit_id, row.is_response, row.fc, row.addr, row.qty, row.resp_time) == (1.5, "7", 1, 3, -1, -1, 0.5)
    assert builder.bad_rows(raw).count() == 2 and builder.parsed_rows(raw, with_unit=False).first().mb_unit_id == "-1"


# --- flatten and post-processing ---------------------------------------------------------------------------------


def test_flatten(spark):
    a = spark.createDataFrame([(1, '{"3":5,"16":2}'), (2, '{"131":2,"x":1}'), (3, "bad"), (4, None), (5, "[1]")], "row long, fc_hist_json string")
    b = spark.createDataFrame([(1, '{"3":"4","6":2}')], "row long, fc_hist_json string")
    assert flatten.top_codes([a, b], 3) == ["3", "16", "131"]  # ties by first appearance
    got = flatten.flattened(a, ["3", "16"]).orderBy("row").collect()
    assert got[0].asDict() == {"row": 1, "FC_3": 5, "FC_16": 2, "FC_OTHER": 0, "FC_READ_TOTAL": 5, "FC_WRITE_TOTAL": 2, "FC_EXCEPTION_TOTAL": 0}
    assert got[1].asDict() == {"row": 2, "FC_3": 0, "FC_16": 0, "FC_OTHER": 3, "FC_READ_TOTAL": 0, "FC_WRITE_TOTAL": 0, "FC_EXCEPTION_TOTAL": 2}
    assert all(r.FC_OTHER == 0 for r in got[2:])


def test_key_mode(spark):
    rows = lambda *units: spark.createDataFrame(list(enumerate(units)), "row int, mb_unit_id string")
    assert flatten.key_mode(rows("-1", "", "-1")) == "src_dst" and flatten.key_mode(rows("-1", "3")) == "src_dst_unit"
    assert flatten.key_mode(None) == "unknown" and flatten.key_mode(None, "src_dst") == "src_dst"


def feature_table(spark, packets, width=5.0):
    out = [{"src_ip": k[0], "dst_ip": k[1], "unit_id": k[2], "t0": k[3], "window_sec": int(width), "file_rank": int(v["pkt_cnt"] < 3), "seq": i, "key_type": "flow", "schema_version": "v1", "exc_cnt": 1, **{c: v[c] for c in ("pkt_cnt", "byte_cnt", "req_cnt", "resp_cnt", "inter_cnt_pos", "neg_delta_cnt", "delta_src_frame_cnt", "delta_src_tcp_cnt", "delta_src_none_cnt", "fc_unique_cnt", "fc_entropy", "inter_mean")}} for i, (k, v) in enumerate(loop_features(packets, width).items())]
    return out, spark.createDataFrame(out)


def test_post_processing(spark, packets):
    rows, frame = feature_table(spark, packets)
    ordered = sorted(r["t0"] for r in rows)
    n = len(rows)
    train = ordered[max(0, min(n - 1, math.floor(n * 0.7) - 1))]
    val = ordered[max(0, min(n - 1, math.floor(n * (0.7 + 0.1)) - 1))]
    assert retention.boundaries(frame) == (train, val)
    weights, first = Counter(), {}
    for r in sorted(rows, key=lambda r: (r["t0"], r["file_rank"], r["seq"])):
        if r["t0"] < train:
            weights[r["src_ip"]] += r["pkt_cnt"]
            first.setdefault(r["src_ip"], len(first))
    best = sorted(weights, key=lambda f: (-weights[f], first[f]))[:2]
    kept = retention.kept_keys(frame, train, 2)
    assert [r.src_ip for r in kept.orderBy(F.col("packets").desc()).collect()] == best
    kept_rows, others = retention.kept_rows(frame, kept, 2), retention.other_rows(frame, kept, 2)
    assert kept_rows.count() == sum(r["src_ip"] in best for r in rows)
    expected = Counter()
    for r in rows:
        if r["src_ip"] not in best:
            expected[r["t0"]] += r["pkt_cnt"]
    got = others.collect()
    assert {r.t0: r.pkt_cnt for r in got} == dict(expected)
    assert all(r.src_ip == "__other__" and r.unit_id == -1 and r.fc_unique_cnt is None for r in got)
    both = retention.all_flow_rows(kept_rows, others)
    assert both.agg(F.sum("pkt_cnt")).first()[0] == sum(r["pkt_cnt"] for r in rows)
    assert sum(r.n for r in retention.split_counts(frame, (train, val)).collect()) == n


def test_split_of_ten_rows(spark):
    frame = spark.createDataFrame([(float(i),) for i in range(10)], "t0 double")
    assert retention.boundaries(frame) == (6.0, 6.0)  # 0.7 + 0.1 is a little under 0.8, so there is no validation row
    assert retention.boundaries(frame.limit(0)) is None


def test_keys_of_the_first_window_if_there_is_nothing_before(spark):
    rows = [("a", "b", 1, 0.0, 5, 0, 0), ("c", "b", 1, 0.0, 9, 0, 1)]
    frame = spark.createDataFrame(rows, "src_ip string, dst_ip string, unit_id long, t0 double, pkt_cnt long, file_rank int, seq long")
    assert retention.kept_keys(frame, 0.0, 1).first().src_ip == "c"


def test_entropy_of_one_symbol(spark):
    value = spark.range(1).select(stats.entropy(F.array(F.lit(5.0)))).first()[0]
    assert value == pytest.approx(-1.0 * math.log(1 + 1e-9)) and value < 0
