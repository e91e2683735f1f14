"""Whole jobs. Each reads files, writes files, and returns what it counted."""

from __future__ import annotations

import time

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from packetloom.operators import arrival, builder, flatten, fragments, protocols, retention, window_features
from packetloom.sources import packet_json, tables

ERROR_SAMPLES = 10


def extract(spark: SparkSession, source: str, protocol: str, target: str | None, mode: str = "auto", one_file: bool = False) -> dict:
    """Packet JSON to the protocol's flat CSV (``target`` None: nowhere). One narrow pass; counts come from it as well."""
    raw = protocols.with_overflows(packet_json.read_packets(spark, source, mode), protocol)
    bad = F.col("error").isNotNull() | F.coalesce("overflow__", F.lit(False))
    seen = Observation()
    marked = raw.withColumn("bad__", bad).observe(seen, F.count("*").alias("total"), F.count(F.when(F.col("bad__"), 1)).alias("bad"))
    rows = protocols.extracted(marked.where(~F.col("bad__")), protocol)
    tables.write_nowhere(rows) if target is None else tables.write_csv(rows, target, one_file)
    return {"protocol": protocol, **seen.get}


def convert(spark: SparkSession, source: str, target: str | None, bench: str = "full", skip: int = 0, samples: int = ERROR_SAMPLES) -> dict:
    """A JSON array to JSON lines. ``bench``: ``full``, ``parse-encode`` (encoded again, written nowhere) or ``parse-only``.
    ``skip``: items that an earlier run has written, by their place, so bad items don't shift it."""
    if bench not in ("full", "parse-encode", "parse-only"):
        raise ValueError(f"unknown bench mode {bench!r}")
    began = time.time()
    items = packet_json.read_packets(spark, source, skip=skip)
    seen = Observation()
    counted = items.observe(seen, F.count("*").alias("total"), F.count("error").alias("bad"))
    good = counted.where(F.col("error").isNull())
    out = good.select(F.to_json(F.try_parse_json("raw")).alias("value") if bench == "parse-encode" else F.col("raw").alias("value"))
    if bench == "full" and target is not None:
        # what stands on several lines in the source goes on one
        tables.write_lines(out.withColumn("value", F.regexp_replace("value", r"[\r\n]+\s*", "")), target)
    else:
        tables.write_nowhere(out)
    found = seen.get
    errors = [r.asDict() for r in items.where(F.col("error").isNotNull()).select("seq", "error").orderBy("seq").limit(samples).collect()] if found["bad"] else []
    return {**found, "ok": found["total"] - found["bad"], "elapsed_sec": time.time() - began, "bench": bench, "errors": errors}


PARSERS = {"modbus": (protocols.modbus_packets, window_features.MODBUS), "mqtt": (protocols.mqtt_packets, window_features.MQTT)}


def feature_rows(packets: DataFrame, family: window_features.Family, windows: tuple[float, ...] = window_features.WINDOWS, ranges: int = 1, faithful: bool = False) -> DataFrame:
    """Flow and global feature rows with ``kind``. ``ranges``: into how many ranges of arrival order gaps are cut, so that a
    busy flow isn't one task. ``faithful``: fragments as a single pass would emit them, instead of one row a window."""
    packets = packets.where(~F.isnan("ts") & (F.abs("ts") < float("inf")))
    cuts = arrival.cut_points(packets, "seq", ranges)
    by_flow = arrival.clipped(arrival.flow_gaps(packets, list(family.key), cuts=cuts))
    overall = arrival.clipped(arrival.flow_gaps(packets, [], cuts=cuts or arrival.cut_points(packets, "seq", 32)))
    if faithful:
        parts = []
        for w in windows:
            flow = fragments.fragments(by_flow, list(family.key), w).withColumn("window_sec", F.lit(w))
            world = fragments.fragments(overall, [], w).withColumn("window_sec", F.lit(w))
            parts += [window_features.features(flow, family, fragment="fragment"), window_features.features(world, family, (), "fragment")]
    else:
        parts = [window_features.features(window_features.in_windows(by_flow, windows), family), window_features.features(window_features.in_windows(overall, windows), family, ())]
    found = parts[0]
    for part in parts[1:]:
        found = found.unionByName(part, allowMissingColumns=True)
    return window_features.routed(found)


def preprocess(spark: SparkSession, source: str, protocol: str, target: str, mode: str = "auto", windows: tuple[float, ...] = window_features.WINDOWS, faithful: bool = False) -> dict:
    """Packet JSON to feature documents in ``target/window_sec=<w>/kind=<key|sparse|global>``."""
    parser, family = PARSERS[protocol]
    raw = packet_json.read_packets(spark, source, mode, empty="json_array")
    counts = raw.agg(F.count("*").alias("read"), F.count("error").alias("decode_errors")).first().asDict()
    # parsed once: gaps, windows and counts below are passes over typed columns
    packets = tables.stored(parser(raw.where(F.col("error").isNull())), "packets")
    bad_time = packets.where(F.isnan("ts") | (F.abs("ts") == float("inf"))).count()
    total = packets.count()
    rows = feature_rows(packets, family, windows, faithful=faithful)
    for kind, keys in (("flow", family.key), ("global", ())):
        part = rows.where(F.col("key_type") == kind)
        documents = window_features.rendered(part.drop(*(set(family.key) - set(keys))), family)
        documents.write.mode("overwrite" if kind == "flow" else "append").partitionBy("window_sec", "kind").text(target)
    return {**counts, "packets": total - bad_time, "skipped_missing_layer": counts["read"] - counts["decode_errors"] - total, "transform_errors": bad_time}


def build(spark: SparkSession, source: str, windows_to: str, sessions_to: str, report_to: str | None = None, with_unit: bool = True, idle: float = builder.SESSION_IDLE, reset: float = builder.SESSION_RESET) -> dict:
    """The parsed-packet CSV to window and session feature CSVs and a report on the order of arrival."""
    began = time.time()
    raw = tables.read_csv(spark, source)
    rows = builder.with_gaps(builder.parsed_rows(raw, with_unit))
    tables.write_csv(builder.window_rows(rows), windows_to)
    tables.write_csv(builder.session_rows(rows, idle, reset), sessions_to)
    quality = builder.order_quality(rows).first().asDict()
    total, parsed = raw.count(), rows.count()
    bad = [r.asDict() for r in builder.bad_rows(raw).orderBy("seq").limit(ERROR_SAMPLES).collect()]
    report = {
        "generated_at_epoch": time.time(),
        "elapsed_sec": time.time() - began,
        "config": {"input_file": source, "key_mode": "src_dst_unit" if with_unit else "src_dst", "window_sizes_sec": list(builder.WINDOWS), "session_idle_timeout_sec": idle, "session_negative_reset_sec": reset},
        "counts": {"rows_total": total, "rows_parsed": parsed, "parse_errors": total - parsed},
        "out_of_order_quality": quality,
        "error_samples": bad,
    }
    if report_to:
        tables.write_document(spark, report_to, report)
    return report


def flatten_features(spark: SparkSession, windows_from: str | None, sessions_from: str | None, windows_to: str, sessions_to: str, report: str | None = None, schema_to: str | None = None, k: int = flatten.TOP_CODES) -> dict:
    """Builder CSVs to flat CSVs with a column for each frequent function code. Two passes: the codes, then the rows."""
    given = {name: tables.read_csv(spark, path, "row") for name, path in (("window", windows_from), ("session", sessions_from)) if path}
    if not given:
        raise ValueError("no input")
    codes = flatten.top_codes(list(given.values()), k)
    targets, names = {"window": windows_to, "session": sessions_to}, {}
    for name, rows in given.items():
        flat = flatten.flattened(rows, codes).drop("row")
        names[f"{name}_flat"] = flat.columns
        tables.write_csv(flat, targets[name])
    said = ((tables.read_document(spark, report) or {}).get("config") or {}).get("key_mode") if report else None
    schema = {"schema_version": "modbus_feature_v1", "generated_at_epoch": time.time(), "key_mode": flatten.key_mode(given.get("window"), said), "top_k": k, "top_fc_list": codes, "fieldnames": names}
    if schema_to:
        tables.write_document(spark, schema_to, schema)
    return schema


def postprocess(spark: SparkSession, features: str, target: str, protocol: str = "modbus", windows: tuple[int, ...] = window_features.WINDOWS, top: dict[int, int] | None = None, splits: tuple[float, float] = retention.SPLITS, split_files: bool = False) -> dict:
    """Feature documents of :func:`preprocess` to kept flows, others, global rows, all flow rows, each in order of t0, and the
    kept keys, in ``target/<name>/window_sec=<w>``, with split boundaries and counts in the summary."""
    family = PARSERS[protocol][1]
    top = top or retention.TOP_FLOWS
    summary = {"schema_version": "v1", "keep_policy": {"type": "topk_by_pkt_cnt", "topk_by_window": top}, "split_policy": {"type": "chronological", "ratios": [*splits, round(1 - sum(splits), 10)]}, "windows": []}
    for w in windows:
        of = {kind: tables.read_features_if_any(spark, f"{features}/window_sec={w}/kind={kind}", protocol) for kind in ("key", "sparse", "global")}
        flows = retention.flow_rows(of["key"], of["sparse"])
        ends = retention.boundaries(flows, splits)
        if ends is None:
            summary["windows"].append({"window_sec": w, "split": {"train_end_t0": None, "val_end_t0": None, "counts": {}}})
            continue
        k = top[w]
        kept = retention.kept_keys(flows, ends[0], k, family.key)
        outputs = {
            "flow_kept": retention.kept_rows(flows, kept, k, family.key).withColumn("part", F.lit(0)),
            "other": retention.other_rows(flows, kept, k, family.key).withColumn("part", F.lit(1)),
            "global_post": of["global"],
        }
        outputs["flow_all"] = retention.all_flow_rows(outputs["flow_kept"], outputs["other"].drop("part"))
        counts = {}
        for name, rows in outputs.items():
            counts[name] = {r.split: r.n for r in retention.split_counts(rows, ends).collect()}
            plain = retention.in_order(rows).drop("seq", "file_rank", "part")
            documents = window_features.rendered(plain.drop(*family.key) if name == "global_post" else plain, family)
            tables.write_lines(documents, f"{target}/{name}/window_sec={w}")
            if split_files:
                by = retention.in_order(rows.withColumn("kind", retention.split_of(F.col("t0"), ends)), "kind").drop("seq", "file_rank", "part")
                parts = window_features.rendered(by.drop(*family.key) if name == "global_post" else by, family).withColumnRenamed("kind", "split")
                tables.write_lines(parts, f"{target}/{name}.splits/window_sec={w}", ("split",))
        tables.write_lines(retention.key_documents(kept, family.key), f"{target}/keep_keys.train/window_sec={w}")
        seen = retention.flow_totals(flows, ends[0], family.key).count()
        summary["windows"].append({"window_sec": w, "split": {"train_end_t0": ends[0], "val_end_t0": ends[1], "counts": counts}, "keep_policy": {"top_k": k, "train_unique_keys_seen": seen}})
    tables.write_document(spark, f"{target}/postprocess.meta.json", summary)
    return summary
