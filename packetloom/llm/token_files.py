"""Operator 4, token files: ORC with run-length encoded ids, row indexes and Bloom filters on document ids.

One file for each range of doc_id, in ascending order of (doc_id, text) with null ids first: bucket, doc_id,
start within the file, n_tokens, ids. ORC stores the integers run-length encoded in stripes; readers take stripes
in parallel, and a lookup by doc_id skips stripes and row groups by their minimum, maximum and Bloom filter. The
start over all files is the start in the file plus the sum of the files before, which the light columns give.

Null and empty texts have the end id alone; repeated rows are each written; an empty table gives an empty result;
other columns are ignored. Names of files don't depend on attempts: Spark commits each task's file once.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from packetloom.llm.common import partitions, range_bounds, range_bucket
from packetloom.llm.words import encoded, narrow, widened

#: Writer settings: a row index entry every thousand rows, stripes of 64 MB, Bloom filters on doc_id.
ORC_OPTIONS = {"orc.bloom.filter.columns": "doc_id", "orc.bloom.filter.fpp": "0.01", "orc.create.index": "true", "orc.row.index.stride": "1000", "orc.stripe.size": str(64 << 20), "compression": "zstd"}
FILE_SCHEMA = "bucket int, doc_id long, start long, n_tokens long, ids array<int>"


def write_tokens(docs: DataFrame, target: str, path: str, end_id: int = 2, buckets: int | None = None) -> None:
    """Encode (doc_id, text) and write the files to the folder ``target``.

    One shuffle, of ids in 16 bits where they fit, into ranges of doc_id; each is sorted with spilling and written
    as a stream.
    """
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    bounds = range_bounds(docs, "doc_id", buckets or partitions(spark))

    def tokens(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for doc_ids, texts in encoded(batches, path, np.array([end_id], dtype="<u4").tobytes()):
            yield pa.record_batch([pa.array(doc_ids, pa.int64()), pa.array(map(narrow, texts), pa.binary())], names=["doc_id", "packed"])

    def placed(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bucket, start = None, 0
        for batch in batches:
            for lo in range(0, batch.num_rows, 256):
                part = batch.slice(lo, 256)
                starts, lists = [], []
                for at, data in zip(part.column("bucket").to_pylist(), part.column("packed").to_pylist(), strict=True):
                    if at != bucket:
                        bucket, start = at, 0
                    ids = widened(data)
                    starts.append(start)
                    lists.append(ids)
                    start += len(ids)
                counts = np.array([len(x) for x in lists], dtype=np.int64)
                ends = np.concatenate(([0], np.cumsum(counts))).astype(np.int32)
                ids = pa.ListArray.from_arrays(ends, np.concatenate(lists).astype(np.int32))
                yield pa.record_batch([part.column("bucket"), part.column("doc_id"), pa.array(starts, pa.int64()), pa.array(counts), ids], names=["bucket", "doc_id", "start", "n_tokens", "ids"])

    rows = docs.mapInArrow(tokens, "doc_id long, packed binary").withColumn("bucket", range_bucket(F.col("doc_id"), bounds))
    dealt = rows.repartitionById(len(bounds) + 1, F.col("bucket").cast("int")).sortWithinPartitions("bucket", F.col("doc_id").asc_nulls_first(), "packed")
    dealt.select("bucket", "doc_id", "packed").mapInArrow(placed, FILE_SCHEMA).write.options(**ORC_OPTIONS).orc(target)


def read_tokens(spark: SparkSession, target: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids) with the start over all files. Filters on doc_id reach the files' metadata.

    One number for each file, its count of ids, reaches the driver.
    """
    files = spark.read.schema(FILE_SCHEMA).orc(target)
    totals = {r.bucket: r.n for r in files.groupBy("bucket").agg(F.sum("n_tokens").alias("n")).collect()}
    before, so_far = [], 0
    for b in range(max(totals, default=-1) + 1):
        before.append(so_far)
        so_far += totals.get(b, 0)
    base = F.element_at(F.array(*map(F.lit, before)).cast("array<bigint>"), F.col("bucket") + 1) if before else F.lit(0)
    return files.select("doc_id", (F.col("start") + base).alias("start"), "n_tokens", "ids")


def digests(tokens: DataFrame) -> DataFrame:
    """The ids replaced by their checksum as little-endian unsigned 32-bit integers."""

    def crc(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column("ids")
            flat, ends = ids.values.to_numpy().astype("<u4"), ids.offsets.to_numpy()
            sums = [zlib.crc32(flat[a:b].tobytes()) for a, b in zip(ends[:-1], ends[1:], strict=True)]
            yield pa.record_batch([batch.column("doc_id"), batch.column("start"), batch.column("n_tokens"), pa.array(sums, pa.int64())], names=["doc_id", "start", "n_tokens", "ids_crc32"])

    return tokens.mapInArrow(crc, "doc_id long, start long, n_tokens long, ids_crc32 long")
