"""The corpus pipeline: documents are filtered, cleaned, deduplicated, redacted and packed, stage by stage.

Each stage takes the documents its predecessor kept (doc_id, text, lang, source, n_chars), written as Parquet and read
again, and all but the last return the same columns. Null texts are kept as they are until packing, where they count as
empty; an empty table passes through.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from packetloom.llm import line_dedup, packing, secret_scan, similar_texts, toxicity
from packetloom.llm.common import written
from packetloom.session import configure

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def _documents(docs: DataFrame) -> DataFrame:
    """The columns of documents, n_chars by the text as it is now."""
    return docs.withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score 0.7 or more go; the model learns from the labels of documents that came in."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "toxic")
    return toxicity.keep_clean(docs, toxicity.train(docs, labels)).select(*COLUMNS)


def drop_boilerplate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that are boilerplate of their source go; documents stay, even if nothing is left of them."""
    return _documents(line_dedup.drop_boilerplate(docs.select(*COLUMNS)))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents that share 0.8 of their five-word shingles and have fingerprints within 8 bits, directly or by others, the
    one with the smallest doc_id stays."""
    return similar_texts.keep_one(docs.select(*COLUMNS))


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are replaced by a mark; documents stay. The ledger is the one that the session names, else a new one."""
    return _documents(secret_scan.redact(docs.select(*COLUMNS), secret_scan.ledger_path(spark)))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of sequences of 2,048 ids that hold all documents."""
    return packing.pack(docs.select("doc_id", "text"), public_tokenizers.path("word_bpe_49k.json"))


def _configured(stage: Callable[[SparkSession, DataFrame, str], DataFrame]) -> Callable[[SparkSession, DataFrame, str], DataFrame]:
    return lambda spark, docs, sf_dir: stage(configure(spark), docs, sf_dir)


#: Each applies the engine's settings to the session, of which those on batches bound the memory of Python workers.
STAGES = [
    ("toxicity", _configured(drop_toxic)),
    ("line_dedup", _configured(drop_boilerplate)),
    ("near_duplicates", _configured(drop_near_duplicates)),
    ("secrets", _configured(redact_secrets)),
    ("packing", _configured(pack)),
]

#: Trained scores and components have no SQL; tests hold near_duplicates against all pairs, and the other stages to counts
#: and invariants.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
