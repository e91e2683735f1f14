"""The registered queries: against SQL where there is some, and the pipeline stage by stage."""

import os
from collections import defaultdict

import duckdb
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from llm.helpers import awkward
from packetloom.llm.common import written
from packetloom.llm.queries import ORACLES, QUERIES

COLUMNS = {
    "op1_fingerprints": ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"],
    "op2_byte_bpe": ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
    "op3_packing": ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"],
    "op4_token_files": ["doc_id", "start", "n_tokens", "ids_crc32"],
    "op5_url_filter": ["page_id", "host", "path", "rule", "verdict"],
    "op6_secret_scan": ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"],
    "op7_toxicity": ["doc_id", "held_out", "score", "predicted"],
    "op8_line_dedup": ["doc_id", "source", "text", "n_lines", "n_dropped"],
    "op9_near_duplicates": ["doc_id", "fingerprint", "component_id"],
    "op10_quality": ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"],
}


@pytest.mark.parametrize("name", COLUMNS)
def test_columns_and_rows(spark, data, name):
    rows = QUERIES[name](spark, data)
    assert set(COLUMNS[name]) <= set(rows.columns)
    table, key = ("pages", "page_id") if name.startswith("op5_") else ("documents", "doc_id")
    whole = spark.read.parquet(f"{data}/{table}.parquet").select(key)
    found = rows.select(key)
    assert (found.distinct() if name == "op3_packing" else found).exceptAll(whole).isEmpty() and whole.exceptAll(found).isEmpty()


@pytest.mark.parametrize("name", ORACLES)
def test_against_sql(spark, data, name):
    con = duckdb.connect()
    for file in os.listdir(data):
        con.execute(f"CREATE VIEW {file.removesuffix('.parquet')} AS SELECT * FROM '{data}/{file}'")
    got, want = QUERIES[name](spark, data).toPandas(), con.execute(ORACLES[name]).df()
    columns = sorted(got.columns)
    got, want = (df[columns].sort_values(columns, ignore_index=True) for df in (got, want))
    assert columns == sorted(want.columns) and len(got) == len(want)
    for c in columns:
        assert ((got[c] == want[c]) | (got[c].isna() & want[c].isna())).all(), c


def test_stages(spark, data, tmp_path):
    docs = spark.read.parquet(f"{data}/documents.parquet")
    labels = spark.read.parquet(f"{data}/labels.parquet")
    assert [name for name, _ in corpus_pipeline.STAGES] == ["toxicity", "line_dedup", "near_duplicates", "secrets", "packing"]
    seen = {"in": docs}
    for name, stage in corpus_pipeline.STAGES:
        docs = seen[name] = written(stage(spark, docs, data), name)
        if name != "packing":
            assert docs.columns == list(corpus_pipeline.COLUMNS) and dict(docs.dtypes)["n_chars"] == "bigint"
    clean = labels.where("toxic = 0").join(seen["in"], "doc_id", "left_semi")
    assert clean.join(seen["toxicity"], "doc_id", "left_anti").count() <= 0.03 * clean.count()
    assert seen["line_dedup"].count() == seen["toxicity"].count() and seen["secrets"].count() == seen["near_duplicates"].count()
    assert seen["line_dedup"].where(F.length("text") != F.col("n_chars")).count() == 0
    from packetloom.llm import near_duplicates

    left = near_duplicates.near_duplicates(seen["near_duplicates"])
    assert left.count() == left.select("component_id").distinct().count()
    assert seen["secrets"].where("text LIKE '%password=%' AND text RLIKE 'password=[0-9a-f]{8}'").count() == 0
    pieces = seen["packing"].groupBy("doc_id").agg(F.sum("length").alias("n"), F.max("doc_tokens").alias("m"))
    assert pieces.count() == seen["secrets"].count() and pieces.where("n <> m").count() == 0


def test_stages_on_awkward_documents(spark, tmp_path):
    rows = awkward(spark).select(*corpus_pipeline.COLUMNS)
    labels = spark.createDataFrame([(2, 1), (3, 0), (None, 1)], "doc_id long, toxic int")
    labels.write.parquet(str(tmp_path / "labels.parquet"))
    for docs in (rows, rows.limit(0)):
        for name, stage in corpus_pipeline.STAGES:
            docs = written(stage(spark, docs, str(tmp_path)), name)
        assert isinstance(docs.count(), int)


def test_run_is_the_stages(spark, data):
    got = corpus_pipeline.run(spark, data)
    assert got.columns == COLUMNS["op3_packing"] and corpus_pipeline.ORACLE_SQL is None
    fills = defaultdict(int)
    for r in got.collect():
        fills[r.sequence_id] += r.length
    assert max(fills.values()) <= 2048 and sum(fills.values()) > 0.97 * 2048 * len(fills)
