"""Operator 1, document fingerprints: SimHash by weighted votes, and permuted block tables to search by Hamming radius.

Terms of a text are its single words and its pairs of neighbouring words (runs of bytes other than ASCII white
space, ASCII letters lower-cased). Each occurrence of a term votes with its weight on each of 64 bits, for the bit
if its hash has it and against it if not; a fingerprint bit is set where the votes for it win. A pair weighs 2. A
word of over six bytes weighs 1; shorter ones, which any two texts of a language share, weigh 0 unless the text
has no pair.

Null and blank texts have no terms: fingerprint 0. Equal texts have equal fingerprints. Any other columns are
carried along or ignored as each function says.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from packetloom.llm.common import partitions, range_bounds, range_bucket
from packetloom.llm.wordhash import BASE, WHITE_SPACE, RangeHash, blocks, mixed, spans

PAIR_WEIGHT, WORD_WEIGHT, SHORT_WORD = 2, 1, 6
VOTE_ROWS = 1 << 15


def _votes(hashes: np.ndarray, weights: np.ndarray, owner: np.ndarray, out: np.ndarray) -> None:
    """Add the signed votes of terms, sorted by owner, to the owners' rows of ``out``; some 2**15 terms at a time."""
    for i in range(0, len(hashes), VOTE_ROWS):
        w, own = weights[i : i + VOTE_ROWS], owner[i : i + VOTE_ROWS]
        bits = np.unpackbits(hashes[i : i + VOTE_ROWS].astype(">u8").view(np.uint8).reshape(-1, 8), axis=1)
        first = np.flatnonzero(np.concatenate(([True], own[1:] != own[:-1])))
        out[own[first]] += 2 * np.add.reduceat(bits * w[:, None], first, axis=0, dtype=np.int64)
        out[own[first]] -= np.add.reduceat(w, first, dtype=np.int64)[:, None]


def simhash(texts: list[str | None]) -> np.ndarray:
    """64-bit fingerprints (uint64) of whole texts."""
    raw = [(t or "").encode("utf-8", "surrogatepass").lower() for t in texts]
    found = np.zeros(len(raw), dtype=np.uint64)
    for lo, hi, data, starts in blocks(raw):
        begin, end = spans(~WHITE_SPACE[data])
        if not len(begin):
            continue
        owner = np.searchsorted(starts, begin, side="right") - 1
        words = RangeHash(data).of(begin, end)
        votes = np.zeros((hi - lo, 64), dtype=np.int64)
        n_words = np.bincount(owner, minlength=hi - lo)
        weight = ((end - begin > SHORT_WORD) | (n_words[owner] < 2)).astype(np.uint8) * np.uint8(WORD_WEIGHT)
        _votes(words[weight > 0], weight[weight > 0], owner[weight > 0], votes)
        same = owner[1:] == owner[:-1]
        pairs = mixed(words[:-1] * np.uint64(BASE) + words[1:])[same]
        _votes(pairs, np.full(len(pairs), PAIR_WEIGHT, dtype=np.uint8), owner[1:][same], votes)
        found[lo:hi] = np.packbits(votes > 0, axis=1).view(">u8").ravel()
    return found


def likeness(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return 1.0 - np.bitwise_count(a ^ b) / 64.0


def fingerprint(df: DataFrame, text: str = "text", out: str = "fingerprint") -> DataFrame:
    """``df`` with the fingerprint of column ``text`` added as a long (the same 64 bits, signed)."""

    @F.pandas_udf("long")
    def of(column):
        import pandas as pd

        return pd.Series(simhash([x if isinstance(x, str) else None for x in column]).view(np.int64))

    return df.withColumn(out, of(F.col(text)))


def block_tables(value: str, radius: int, blocks_: int, bits: int = 64) -> list[tuple[int, str]]:
    """SQL for the key in each permuted table: every choice of ``blocks_`` - ``radius`` blocks, kept by a mask.

    Two fingerprints that differ in at most ``radius`` bits differ in at most that many blocks, hence agree on
    the rest and meet in some table.
    """
    if not 0 <= radius < blocks_ <= bits:
        raise ValueError("0 <= radius < blocks <= bits is needed")
    cut = [bits * i // blocks_ for i in range(blocks_ + 1)]
    masks = [sum(((1 << (cut[i + 1] - cut[i])) - 1) << cut[i] for i in chosen) for chosen in combinations(range(blocks_), blocks_ - radius)]
    return [(n, f"({value} & {m - (1 << 64) if m >> 63 else m}L)") for n, m in enumerate(masks)]


def within_radius(queries: DataFrame, index: DataFrame, value: str = "fingerprint", radius: int = 3, blocks_: int = 5) -> DataFrame:
    """All pairs (query value, index value, distance) of distinct fingerprints at most ``radius`` bits apart.

    Both sides are reduced to distinct values first, so copies cost nothing; members are found by joining back on
    the value. Null fingerprints match nothing. A pair that meets in several tables is kept from the first table
    in which it agrees, so no distinct is needed after the join.
    """
    tables = block_tables(value, radius, blocks_)
    spread = F.expr("explode(array(" + ", ".join(f"struct({n} AS t, {key} AS k)" for n, key in tables) + "))")

    def side(df: DataFrame, name: str) -> DataFrame:
        return df.where(F.col(value).isNotNull()).select(value).distinct().select(F.col(value).alias(name), spread.alias("at")).select(name, "at.t", "at.k")

    pairs = side(queries, "query_value").join(side(index, "index_value"), ["t", "k"])
    diff = "(query_value ^ index_value)"
    first = "CASE " + " ".join(f"WHEN {key.replace(value, diff)} = 0 THEN {n}" for n, key in tables) + " END"
    return pairs.withColumn("distance", F.expr(f"bit_count({diff})")).where((F.col("distance") <= radius) & (F.col("t") == F.expr(first))).select("query_value", "index_value", "distance")


OUT = pa.schema(
    [
        ("doc_id", pa.int64()),
        ("n_chars", pa.int64()),
        ("edited_sha256", pa.string()),
        ("fingerprint", pa.string()),
        ("edited_fingerprint", pa.string()),
        ("near_edited", pa.float64()),
        ("near_next", pa.float64()),
    ]
)


def _judged(rows: list[tuple[int | None, str, str]]) -> pa.RecordBatch:
    """rows: id, text, next text."""
    texts = [r[1] for r in rows]
    edited = [t[: len(t) - len(t) // 4] + nxt[: len(t) // 4] for _, t, nxt in rows]
    # a row's next text is mostly the following row's own text: only the others are hashed apart
    chained = [i + 1 < len(rows) and rows[i + 1][1] is rows[i][2] for i in range(len(rows))]
    prints = simhash(texts + edited + [r[2] for r, c in zip(rows, chained, strict=True) if not c])
    own, changed, apart = np.split(prints, [len(rows), 2 * len(rows)])
    next_ = np.append(own[1:], own[:1])
    next_[~np.array(chained)] = apart
    return pa.record_batch(
        [
            [r[0] for r in rows],
            [len(t) for t in texts],
            [hashlib.sha256(t.encode("utf-8", "surrogatepass")).hexdigest() for t in edited],
            [f"{x:016x}" for x in own.tolist()],
            [f"{x:016x}" for x in changed.tolist()],
            likeness(own, changed),
            likeness(own, next_),
        ],
        schema=OUT,
    )


def _follow(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by (bucket, key): pairs each with the one after it in its bucket; rows that only lead in are not output."""
    held: tuple | None = None
    ready: list[tuple[int | None, str, str]] = []
    size = 0
    for batch in batches:
        for bucket, guest, doc_id, text in zip(*(batch.column(c).to_pylist() for c in ("bucket", "guest", "doc_id", "text")), strict=True):
            if held is not None and held[0] == bucket and not held[1]:
                ready.append((held[2], held[3], text))
                size += len(held[3])
                if size > 1 << 20:
                    yield _judged(ready)
                    ready, size = [], 0
            held = (bucket, guest, doc_id, text)
    if ready:
        yield _judged(ready)


def fingerprints_with_next(docs: DataFrame, buckets: int | None = None) -> DataFrame:
    """Fingerprints of each text and of its edited text, in which the next document's start replaces the last quarter.

    docs: doc_id, text (null: empty); other columns are ignored. The next document is the next in ascending order
    of (doc_id, text), null ids first; the last is followed by the first, and a sole document by itself. Repeated
    rows each give a row. An empty table gives an empty result.

    One shuffle of the texts into ranges of doc_id; only the first document of each range travels twice, to the
    range before it as well, where the last document needs it. Ranges come from cut points over all ids.
    """
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    bounds = range_bounds(docs, "doc_id", buckets or partitions(spark))
    placed = docs.withColumn("bucket", range_bucket(F.col("doc_id"), bounds))
    # ids only: the first of each range, and how often it occurs
    least = F.min(F.struct(F.col("doc_id").isNotNull(), "doc_id")).getField("doc_id").alias("head_id")
    heads = {r.bucket: r for r in placed.groupBy("bucket").agg(least).collect()}
    order = sorted(heads)
    before = {b: order[i - 1] for i, b in enumerate(order)}
    at = F.col("bucket") + 1
    head = F.element_at(F.array(*(F.lit(heads[b].head_id if b in heads else None).cast("long") for b in range(len(bounds) + 1))), at)
    visited = F.element_at(F.array(*(F.lit(before.get(b)).cast("int") for b in range(len(bounds) + 1))), at)
    also = F.when(F.col("doc_id").eqNullSafe(head), visited)
    # (target bucket, guest, row): a guest stands after all rows of the bucket it visits
    visits = F.array_compact(F.array(F.struct(F.col("bucket").alias("b"), F.lit(False).alias("g")), F.when(also.isNotNull(), F.struct(also.alias("b"), F.lit(True).alias("g")))))
    sent = placed.select("doc_id", "text", F.explode(visits).alias("v")).select(F.col("v.b").alias("bucket"), F.col("v.g").alias("guest"), "doc_id", "text")
    dealt = sent.repartitionById(max(1, len(bounds) + 1), F.col("bucket").cast("int")).sortWithinPartitions("bucket", "guest", F.col("doc_id").asc_nulls_first(), "text")
    return dealt.mapInArrow(_follow, "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")
