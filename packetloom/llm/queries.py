"""The registered queries of the training-data operators, each over its whole table with production parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import public_tokenizers

from packetloom.llm import bpe, fingerprints, line_dedup, near_duplicates, oracles, packing, quality, secret_scan, token_files, toxicity, url_filter
from packetloom.llm.common import scratch_path, written


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of texts and edited texts; for every doc_id divisible by 100 also ``n_near``: how many other
    rows have a fingerprint within 3 bits, found by the permuted block tables (null for the other rows)."""
    judged = written(fingerprints.fingerprints_with_next(table(spark, sf_dir, "documents").select("doc_id", "text")), "fingerprints")
    value = F.conv("fingerprint", 16, -10).cast("long").alias("value")
    index = judged.groupBy(value).agg(F.count("*").alias("n"))
    asked = (F.col("doc_id") % 100 == 0) & F.col("doc_id").isNotNull()
    near = fingerprints.within_radius(judged.where(asked).select(value), index, "value", radius=3)
    counts = near.join(index.select(F.col("value").alias("index_value"), "n"), "index_value").groupBy("query_value").agg((F.sum("n") - 1).alias("n_near"))
    answers = judged.where(asked).withColumn("value", value).join(counts, F.col("value") == F.col("query_value"), "left").drop("value", "query_value")
    return judged.where(~F.coalesce(asked, F.lit(False))).withColumn("n_near", F.lit(None).cast("long")).unionByName(answers)


def op2_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exact ids of every text, and the bytes decoded from them."""
    return bpe.round_trip(table(spark, sf_dir, "documents").select("doc_id", "text"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pieces of all documents in sequences of 2,048 ids, with end id 1."""
    return packing.pack(table(spark, sf_dir, "documents").select("doc_id", "text"), public_tokenizers.path("word_bpe_49k.json"))


def op4_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of all documents with end id 2, written as ORC and read back."""
    target = scratch_path(spark, "tokens")
    token_files.write_tokens(table(spark, sf_dir, "documents").select("doc_id", "text"), target, public_tokenizers.path("word_bpe_49k.json"))
    return token_files.digests(token_files.read_tokens(spark, target))


#: The rules, which come before the listed URLs.
URL_RULES = [("allow", "org/"), ("block", "example.org/es/"), ("block", "example.org/en/1"), ("allow", "com/fr/"), ("block", "com/de/")]


def op5_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdicts on the URLs of all pages, by the rules and else by the listed URLs."""
    listed = url_filter.entries(spark, [(v, e, True) for v, e in URL_RULES] + [("block", url, False) for url in url_filter.listed_urls()])
    return url_filter.judge(table(spark, sf_dir, "pages").select("page_id", "url"), listed).drop("url")


def _is_kind(kind: str):
    return lambda span: span["kind"] == kind


def op6_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets in all documents, scanned into the session's ledger, else a new one, and joined back."""
    versions = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("path"), "text")
    found = secret_scan.scan(versions, secret_scan.ledger_path(spark))
    base = secret_scan.base_spans(F.col("spans"))
    counts = [F.size(F.filter("spans", _is_kind(kind))).cast("long").alias(f"n_{kind}") for kind in secret_scan.BASE]
    return found.select(F.col("path").alias("doc_id"), *counts, F.sha2(secret_scan.as_text(base), 256).alias("base_sha256"), secret_scan.as_text(F.col("spans")).alias("spans"))


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Noisy-or scores of all documents, and where the offending sentences are."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = toxicity.train(docs, table(spark, sf_dir, "labels").select("doc_id", "toxic"))
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 3 == 1, F.lit(False))
    return toxicity.scored(docs, model).select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= toxicity.THRESHOLD).cast("int").alias("predicted"), "offending")


def op9_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of three-word shingles, and components of links at 2 or fewer differing bits."""
    found = near_duplicates.near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"), words=3, radius=2)
    return found.select("doc_id", F.lower(F.lpad(F.hex("value"), 16, "0")).alias("fingerprint"), "component_id")


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents without the lines that are boilerplate of their source."""
    return line_dedup.drop_boilerplate(table(spark, sf_dir, "documents").select("doc_id", "source", "text"))


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base counts and verdicts for all documents."""
    judged = quality.judge(table(spark, sf_dir, "documents").select("doc_id", "text", "lang"))
    return judged.withColumns({c: F.round(c, 6) for c in ("class_distance", "common_distance")})


QUERIES = {
    "op1_fingerprints": op1_fingerprints,
    "op2_byte_bpe": op2_byte_bpe,
    "op3_packing": op3_packing,
    "op4_token_files": op4_token_files,
    "op5_url_filter": op5_url_filter,
    "op6_secret_scan": op6_secret_scan,
    "op7_toxicity": op7_toxicity,
    "op8_line_dedup": op8_line_dedup,
    "op9_near_duplicates": op9_near_duplicates,
    "op10_quality": op10_quality,
}
ORACLES: dict[str, str] = {
    "op5_url_filter": oracles.url_filter(URL_RULES, url_filter.listed_urls()),
    "op6_secret_scan": oracles.secrets(),
    "op8_line_dedup": oracles.lines(),
    "op10_quality": oracles.quality_rules(),
}
