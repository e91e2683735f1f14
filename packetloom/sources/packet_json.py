"""Readers of packet JSON: JSON lines (strict or tolerant) and one JSON array per file, damaged files included.

All give ``seq``, the arrival order over all files (by path, then place in the file, from 1), and ``raw``, the text of one
object. Lines are read in splits by many tasks; an array is read by one task a file, as a stream.
"""

from __future__ import annotations

import codecs
import hashlib
import json
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

#: What is looked at to tell the two layouts apart, bytes.
SNIFFED = 64 << 10
BOM = "﻿"


def head_of(spark: SparkSession, path: str, size: int = SNIFFED) -> bytes:
    """The first bytes of a file, through Spark's file systems."""
    jvm = spark._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    stream = where.getFileSystem(spark._jsc.hadoopConfiguration()).open(where)
    try:
        return bytes(jvm.org.apache.commons.io.IOUtils.toByteArray(jvm.org.apache.commons.io.input.BoundedInputStream(stream, size)))
    finally:
        stream.close()


def signature(spark: SparkSession, path: str, head: int = 1 << 20) -> dict:
    """What tells a file from another or from its later self: size, time of change, SHA-1 of its head."""
    jvm = spark._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    status = where.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(where)
    return {"size": status.getLen(), "mtime_ms": status.getModificationTime(), "head_sha1": hashlib.sha1(head_of(spark, path, head)).hexdigest()}


def layout_of(head: bytes, empty: str = "jsonl") -> str:
    """``json_array`` if the first character that isn't white space is ``[``, else ``jsonl``; ``empty`` for blank files."""
    text = head.replace(b"\0", b"").decode("utf-8", "ignore").lstrip(BOM).lstrip()
    return empty if not text else "json_array" if text.startswith("[") else "jsonl"


def numbered(lines: DataFrame) -> DataFrame:
    """``lines`` with ``seq`` from the place of each line in its split and the sizes of the splits before.

    The rows of a split are consecutive in its task, so only one row a split is aggregated; texts aren't shuffled.
    """
    placed = lines.select("*", F.col("_metadata.file_path").alias("file__"), F.col("_metadata.file_block_start").alias("block__"), F.monotonically_increasing_id().alias("id__"))
    splits = placed.groupBy("file__", "block__").agg(F.min("id__").alias("first__"), F.count("*").alias("n__"))
    before = F.sum("n__").over(Window.orderBy("file__", "block__").rowsBetween(Window.unboundedPreceding, -1))  # one row a split
    splits = splits.select(F.col("file__").alias("file_r"), F.col("block__").alias("block_r"), "first__", F.coalesce(before, F.lit(0)).alias("before__"))
    joined = placed.join(splits, (F.col("file__") == F.col("file_r")) & (F.col("block__") == F.col("block_r")))
    return joined.select((F.col("before__") + F.col("id__") - F.col("first__") + 1).alias("seq"), *lines.columns)


def cleaned(line: Column) -> Column:
    """A line as JSON text: without NUL characters, byte order mark, undecodable bytes, and one comma at the end; null for
    blank lines and lone brackets or commas. (Undecodable bytes and a genuine U+FFFD can't be told apart here.)"""
    text = F.regexp_replace(line, "[\\x00﻿�]", "")
    text = F.trim(F.regexp_replace(text, r"^\s+|\s+$", ""))
    bare = F.regexp_replace(F.regexp_replace(text, ",$", ""), r"\s+$", "")
    return F.when(text.isin("", "[", "]", ","), F.lit(None)).otherwise(bare)


def read_lines(spark: SparkSession, path: str, strict: bool = False, skip: int = 0) -> DataFrame:
    """(seq, raw, error) of JSON lines; skipped lines don't appear. ``error`` says that a line isn't JSON; with ``strict`` the
    job fails there instead. ``skip``: lines to leave out at the start."""
    lines = numbered(spark.read.text(path)).withColumn("raw", cleaned(F.col("value"))).where(F.col("raw").isNotNull() & (F.col("seq") > skip))
    bad = F.try_parse_json("raw").isNull()
    if strict:
        return lines.select("seq", F.when(bad, F.raise_error(F.concat(F.lit("not JSON, line "), F.col("seq").cast("string")))).otherwise(F.col("raw")).alias("raw"), F.lit(None).cast("string").alias("error"))
    return lines.select("seq", "raw", F.when(bad, "not JSON").alias("error"))


def objects_in(chunks: Iterator[bytes], max_buffer: int = 64 << 20) -> Iterator[tuple[str | None, str | None]]:
    """(text, error) of the items of a JSON array that comes in chunks.

    All before the first ``[`` is skipped; NUL characters and undecodable bytes are dropped, characters that span chunks
    are not. After an item that doesn't parse within ``max_buffer`` characters, reading goes on at the next ``{``. A torn
    item at the end is an error record; after ``]`` nothing is read.
    """
    decode = codecs.getincrementaldecoder("utf-8")("ignore").decode
    parse = json.JSONDecoder().raw_decode
    text, at, inside, ended = "", 0, False, False

    def more() -> bool:
        nonlocal text, at, ended
        chunk = next(chunks, None)
        text, at = text[at:] + decode(chunk or b"", final=chunk is None).replace("\0", ""), 0
        ended = chunk is None
        return not ended

    wanted = 0
    while True:
        if not inside:
            start = text.find("[", at)
            if start < 0:
                at = len(text)
                if not more():
                    return
                continue
            inside, at = True, start + 1
        while at < len(text) and text[at] in " \r\n\t,﻿":
            at += 1
        if at == len(text):
            if ended or not more():
                if at >= len(text):
                    return
            continue
        if text[at] == "]":
            return
        if len(text) - at < wanted and not ended:
            more()
            continue
        try:
            _, end = parse(text, at)
            # a number may go on in the next chunk, unless something ends it
            whole = text[end - 1] in '}]"' or text[end : end + 1] in tuple(" \r\n\t,]")
            if not whole and not ended and len(text) - at < 64:
                more()
                continue
            yield text[at:end], None
            at, wanted = end, 0
        except ValueError:
            if ended:
                yield None, "the last item is torn"
                return
            if len(text) - at > max_buffer:
                again = text.find("{", at + 1)
                yield None, "an item could not be read"
                at = again if again >= 0 else len(text)
            else:
                wanted = 2 * (len(text) - at)  # parse again only when there is twice as much
                more()


class OneFile(InputPartition):
    def __init__(self, path: str, rank: int):
        super().__init__(path)
        self.path, self.rank = path, rank


class PacketArrayReader(DataSourceReader):
    def __init__(self, options: dict):
        self.files = json.loads(options["files"])
        self.chunk = int(options.get("chunk_mb", 8)) << 20
        self.buffer = int(options.get("max_buffer_mb", 64)) << 20

    def partitions(self) -> list[OneFile]:
        return [OneFile(path, rank) for rank, path in enumerate(self.files)]

    def read(self, partition: OneFile):
        from pyarrow import fs

        system, path = fs.FileSystem.from_uri(partition.path)
        with system.open_input_stream(path, compression="detect") as stream:
            chunks = iter(lambda: stream.read(self.chunk), b"")
            # places in files leave room for a billion billion items: rank in the upper bits
            for n, (text, error) in enumerate(objects_in(chunks, self.buffer), 1):
                yield (partition.rank << 40) + n, text, error


class PacketArraySource(DataSource):
    """``spark.read.format("packet_array")``: items of JSON arrays as (seq, raw, error)."""

    @classmethod
    def name(cls) -> str:
        return "packet_array"

    def schema(self) -> str:
        return "seq bigint, raw string, error string"

    def reader(self, schema) -> PacketArrayReader:
        return PacketArrayReader(self.options)


def files_at(spark: SparkSession, path: str) -> list[str]:
    """Files at a path (file, folder or pattern) as URIs, by name."""
    jvm = spark._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    system = where.getFileSystem(spark._jsc.hadoopConfiguration())
    found = []
    for status in system.globStatus(where) or []:
        inner = system.listStatus(status.getPath()) if status.isDirectory() else [status]
        found += [s.getPath().toUri().toString() for s in inner if not s.isDirectory() and not s.getPath().getName().startswith(("_", "."))]
    if not found:
        raise FileNotFoundError(path)
    return sorted(found)


def read_array(spark: SparkSession, path: str, skip: int = 0, **options: str) -> DataFrame:
    """(seq, raw, error) of the items of JSON arrays; ``skip``: items to leave out at the start of the first file."""
    spark.dataSource.register(PacketArraySource)
    found = spark.read.format("packet_array").options(files=json.dumps(files_at(spark, path)), **options).load()
    return found.where(F.col("seq") > skip) if skip else found


def read_packets(spark: SparkSession, path: str, mode: str = "auto", empty: str = "jsonl", strict: bool = False, skip: int = 0) -> DataFrame:
    """(seq, raw, error) by the layout that ``mode`` names (``auto``: by looking): ``json_array`` or ``jsonl``."""
    if mode not in ("auto", "json_array", "jsonl"):
        raise ValueError(f"unknown mode {mode!r}")
    if mode == "auto":
        mode = layout_of(head_of(spark, files_at(spark, path)[0]), empty)
    return read_array(spark, path, skip) if mode == "json_array" else read_lines(spark, path, strict, skip)
