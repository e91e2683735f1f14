"""Operator 5, URL filters: a blocked Bloom filter of listed canonical URLs, then an exact hash join.

Rules and the list are entries of host and path. A rule, ``example.org/en/1``, covers its host, all subdomains, and every
path that starts with its path, as the URL has them. A listed URL is canonical on both sides: without scheme, user, port,
query and fragment, dots and slashes at the end; host in lower case; escapes of letters, digits and ``-._~`` decoded. It
covers its host, all subdomains, its path and what is below it. The keys of a URL are suffixes of its host at a dot with
starts of its path: for rules of each length that a rule has, for the list of whole segments; no more labels or segments
than some entry has. Keys the filter may hold go to a hash join with the entries, which removes false positives; of the
entries that match, the longest wins (of equal length: the one with the longer host), rules before listed URLs.

The filter comes in segments of ``SEGMENT_BYTES``. A filter of one segment goes to all tasks and rows are probed where they
are; of a larger one each segment is built and probed by a task of its own, with the different keys dealt out to them.

Null URLs and those without ``://`` have empty host and path and match nothing. Every row gives one row, repeated ones
too; an empty table or list is fine; host, path, rule and verdict replace columns of those names, and all other columns
are carried along, whatever their names.
"""

from __future__ import annotations

import os
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from packetloom.llm.common import free_name, written

#: A block is 256 bits, one cache line at most; a key sets 8 bits in one block, one in each 32-bit word.
BLOCK_WORDS, BITS_PER_KEY = 8, 16
#: What one task holds of a filter.
SEGMENT_BYTES = 8 << 20
#: Sites that are refused where no rule speaks; one URL a line.
LISTED = os.path.join(os.path.dirname(__file__), "listed_urls.txt")

#: The odd multipliers that draw the eight bits of a key, as published for split-block Bloom filters.
SALTS = np.array([0x47B6137B, 0x44974D91, 0x8824AD5B, 0xA2B7289D, 0x705495C7, 0x2DF1424B, 0x9EFC4947, 0x5C6BFB31], dtype=np.uint32)


def blocks_for(keys: int) -> int:
    return max(1, -(-keys * BITS_PER_KEY // (32 * BLOCK_WORDS)))


class BlockedBloom:
    """Built from 64-bit hashes of the keys: the upper half picks the block, the lower half the bits in it. ``first`` and
    ``blocks``: which of all blocks are here, where the filter is divided."""

    def __init__(self, keys: int, first: int = 0, blocks: int | None = None):
        self.all_blocks, self.first = blocks_for(keys), first
        self.words = np.zeros((self.all_blocks if blocks is None else blocks, BLOCK_WORDS), dtype=np.uint32)

    def _place(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        h = hashes.astype(np.int64).view(np.uint64)
        block = ((h >> np.uint64(32)) * np.uint64(self.all_blocks)) >> np.uint64(32)
        low = (h & np.uint64(0xFFFFFFFF)).astype(np.uint32)
        return block.astype(np.int64) - self.first, np.uint32(1) << ((low[:, None] * SALTS) >> np.uint32(27))

    def add(self, hashes: np.ndarray) -> None:
        block, bits = self._place(hashes)
        np.bitwise_or.at(self.words, block, bits)

    def may_hold(self, hashes: np.ndarray) -> np.ndarray:
        block, bits = self._place(hashes)
        return ((self.words[block] & bits) == bits).all(axis=1)


def split_url(url: Column) -> tuple[Column, Column]:
    """Host with A-Z lower-cased, and path; empty where there is no ``://``."""
    rest = F.when(F.instr(url, "://") > 0, F.regexp_replace(url, r"(?s)^.*?://", ""))
    host = F.translate(F.regexp_extract(rest, r"^[^/?#]*", 0), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    path = F.regexp_extract(F.regexp_replace(rest, r"(?s)^[^/?#]*", ""), r"(?s)^[^?#]*", 0)
    return F.coalesce(host, F.lit("")), F.coalesce(path, F.lit(""))


def canonical(host: Column, path: Column) -> tuple[Column, Column]:
    """Host without user, port and dots at the end; path with needless escapes decoded."""
    bare = F.regexp_replace(F.regexp_replace(F.regexp_replace(host, "^.*@", ""), ":[0-9]*$", ""), r"\.+$", "")
    plain = r"^(?i:2D|2E|5F|7E|3[0-9]|[46][1-9A-F]|[57][0-9A])"
    pieces = F.split(path, "%")
    decoded = F.transform(pieces, lambda p, i: F.when(i == 0, p).when(p.rlike(plain), F.concat(F.char(F.conv(F.substring(p, 1, 2), 16, 10).cast("int")), F.substring(p, 3, 1 << 30))).otherwise(F.concat(F.lit("%"), p)))
    return bare, F.when(F.instr(path, "%") > 0, F.array_join(decoded, "")).otherwise(path)


def entries(spark: SparkSession, listed: Iterable[tuple[str, str, bool]]) -> DataFrame:
    """(key, verdict, is_rule) of (verdict, entry, is a rule)."""
    return spark.createDataFrame([(entry, verdict, rule) for verdict, entry, rule in listed], "key string, verdict string, is_rule boolean")


def listed_urls(path: str = LISTED) -> list[str]:
    """The URLs in a small text file; blank lines and those that start with ``#`` don't count."""
    with open(path) as lines:
        return [line.strip() for line in lines if line.strip() and not line.startswith("#")]


def keyed(listed: DataFrame) -> DataFrame:
    """(key, entry, host_labels, path_length, path_segments): each entry once under its canonical key, which starts with
    ``r`` for rules and ``l`` for listed URLs. Of entries with the same key, one that blocks speaks."""
    url = F.when(F.instr("key", "://") > 0, F.col("key")).otherwise(F.concat(F.lit("x://"), F.col("key")))
    host, path = canonical(*split_url(url))
    slash = F.instr("key", "/")
    rows = listed.where(~F.col("is_rule") | (slash > 0)).select(
        "verdict",
        "is_rule",
        F.when(F.col("is_rule"), F.substring_index("key", "/", 1)).otherwise(host).alias("host"),
        F.when(F.col("is_rule"), F.substring(F.col("key"), slash, F.lit(1 << 30))).otherwise(F.regexp_replace(path, "/+$", "")).alias("path"),
    )
    rows = rows.where((F.col("host") != "") & (~F.col("is_rule") | (F.col("path") != "")))
    mark = F.when(F.col("is_rule"), "r").otherwise("l")
    rows = rows.select(F.concat(mark, "host", "path").alias("key"), "verdict", "is_rule", "host", "path")
    entry = F.max_by(F.struct("verdict", "is_rule", "host", "path"), F.col("verdict") == "block").alias("entry")
    return rows.groupBy("key").agg(entry).select("key", "entry", F.size(F.split("entry.host", r"\.")).alias("host_labels"), F.length("entry.path").alias("path_length"), F.size(F.split("entry.path", "/")).alias("path_segments"))


def keys_of(host: Column, path: Column, labels: int, lengths: list[int], segments: int) -> Column:
    """All keys that an entry which covers the URL may have; an empty list where there is no host."""

    def suffixes(h: Column) -> Column:
        parts = F.split(h, r"\.")
        last = F.transform(F.sequence(F.lit(1), F.least(F.size(parts), F.lit(max(1, labels)))), lambda i: F.array_join(F.slice(parts, F.size(parts) - i + 1, i), "."))
        return F.when(h != "", last).otherwise(F.array().cast("array<string>"))

    by_length = F.array(*(F.when(F.length(path) >= n, F.substring(path, 1, n)) for n in lengths)) if lengths else F.array().cast("array<string>")
    rule = F.flatten(F.transform(suffixes(host), lambda s: F.transform(F.array_compact(by_length), lambda p: F.concat(F.lit("r"), s, p))))
    clean_host, clean_path = canonical(host, path)
    parts = F.split(clean_path, "/")
    whole = F.transform(F.sequence(F.lit(1), F.least(F.size(parts), F.lit(max(1, segments)))), lambda i: F.array_join(F.slice(parts, 1, i), "/"))
    url = F.flatten(F.transform(suffixes(clean_host), lambda s: F.transform(whole, lambda p: F.concat(F.lit("l"), s, p))))
    return F.concat(rule, url if segments else F.array().cast("array<string>"))


def possible_keys(asked: DataFrame, listed: DataFrame, n: int) -> DataFrame:
    """The keys of ``asked`` (key, different ones) that the filter over the ``n`` keys of ``listed`` may hold.

    Each segment is one task's: entries come first and set their bits, then keys are probed as they stream by.
    """
    segments = -(-blocks_for(n) * 32 // SEGMENT_BYTES)
    size = -(-blocks_for(n) // segments)

    def placed(df: DataFrame, asks: bool) -> DataFrame:
        h = F.xxhash64("key")
        segment = F.floor(F.shiftrightunsigned(F.shiftrightunsigned(h, 32) * F.lit(blocks_for(n)).cast("bigint"), 32) / size).cast("int")
        return df.select(segment.alias("segment"), F.lit(asks).alias("asks"), h.alias("hash"), (F.col("key") if asks else F.lit(None).cast("string")).alias("key"))

    def probe(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, bloom = None, None
        for batch in batches:
            at = batch.column("segment").to_numpy()
            edges = [0, *(np.flatnonzero(np.diff(at)) + 1).tolist(), len(at)]
            for a, b in zip(edges[:-1], edges[1:], strict=True):
                if a == b:
                    continue
                if at[a] != now:
                    now, bloom = at[a], BlockedBloom(n, int(at[a]) * size, size)
                part = batch.slice(a, b - a)
                hashes, asks = part.column("hash").to_numpy(), part.column("asks").to_numpy(zero_copy_only=False)
                bloom.add(hashes[~asks])
                if asks.any():
                    held = asks.copy()
                    held[asks] = bloom.may_hold(hashes[asks])
                    yield pa.record_batch([part.column("key").filter(pa.array(held))], names=["key"])

    rows = placed(listed, False).unionByName(placed(asked, True))
    return rows.repartitionById(segments, F.col("segment")).sortWithinPartitions("segment", "asks").mapInArrow(probe, "key string")


def judge(pages: DataFrame, listed: DataFrame, url: str = "url", default: str = "allow") -> DataFrame:
    """``pages`` with host, path, rule and verdict. ``listed``: key (host and path, or a URL), verdict, is_rule.

    rule is the winning rule's key, else null; verdict the winning rule's, else that of the longest listed URL, else
    ``default``. Only rows with a possible hit are shuffled, and of them the keys; entries are joined by hash.
    """
    spark = pages.sparkSession
    listed = written(keyed(listed), "url-entries")
    rule = F.col("entry.is_rule")
    facts = listed.agg(F.count("*").alias("n"), F.max("host_labels").alias("labels"), F.collect_set(F.when(rule, F.col("path_length"))).alias("lengths"), F.max(F.when(~rule, F.col("path_segments"))).alias("segments")).first()
    listed = listed.select("key", "entry")
    row_id, host, path, keys, key, entry, best = (free_name(pages, name) for name in ("row_id__", "host__", "path__", "keys__", "key__", "entry__", "best__"))
    own_host, own_path = split_url(F.col(url))
    out = pages.withColumn(host, own_host).withColumn(path, own_path)
    taken = {"host", "path", "rule", "verdict"}
    kept = [c for c in pages.columns if c.lower() not in taken]
    out = out.select(*kept, host, path, keys_of(F.col(host), F.col(path), facts.labels or 0, sorted(facts.lengths), facts.segments or 0).alias(keys))

    if blocks_for(facts.n) * 4 * BLOCK_WORDS <= SEGMENT_BYTES:
        bloom = BlockedBloom(facts.n)
        bloom.add(listed.select(F.xxhash64("key").alias("h")).toArrow().column("h").to_numpy())  # four times the segment at most
        shared = spark.sparkContext.broadcast(bloom)
        hashes = free_name(out, "hashes__")

        def possible(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                of_row, hashed = batch.column(keys), batch.column(hashes)
                held = shared.value.may_hold(hashed.flatten().to_numpy(zero_copy_only=False))
                before = np.concatenate(([0], np.cumsum(held)))
                ends = np.concatenate(([0], np.cumsum(of_row.value_lengths().to_numpy(zero_copy_only=False))))
                left = pa.ListArray.from_arrays(pa.array(before[ends], pa.int32()), of_row.flatten().filter(pa.array(held)))
                yield pa.record_batch([left if c == keys else batch.column(c) for c in batch.schema.names if c != hashes], names=[c for c in batch.schema.names if c != hashes])

        out = out.withColumn(hashes, F.transform(F.col(keys), lambda k: F.xxhash64(k))).mapInArrow(possible, out.schema)
    else:
        asked = out.select(F.explode(keys).alias("key")).distinct()
        listed = written(possible_keys(asked, listed, facts.n).join(listed, "key"), "url-hits")
    found = [F.col(host).alias("host"), F.col(path).alias("path")]
    none = out.where(F.size(keys) == 0).select(*kept, *found, F.lit(None).cast("string").alias("rule"), F.lit(default).alias("verdict"))
    some = out.where(F.size(keys) > 0).withColumn(row_id, F.monotonically_increasing_id())
    tried = some.select(*kept, host, path, row_id, F.explode(keys).alias(key)).join(listed.select(F.col("key").alias(key), F.col("entry").alias(entry)), key, "left")
    length = F.struct(F.col(f"{entry}.is_rule"), F.length(key), F.length(f"{entry}.host"))
    firsts = [F.first(c).alias(c) for c in (*kept, host, path)]
    won = tried.groupBy(row_id).agg(*firsts, F.max_by(entry, F.when(F.col(entry).isNotNull(), length)).alias(best))
    rule_key = F.when(F.col(f"{best}.is_rule"), F.concat(F.col(f"{best}.host"), F.col(f"{best}.path")))
    return none.unionByName(won.select(*kept, *found, rule_key.alias("rule"), F.coalesce(f"{best}.verdict", F.lit(default)).alias("verdict")))
