"""Operator 3, packing: first-fit decreasing with a tournament tree of bin capacities, in randomised groups.

A document's ids are cut into full sequences and a rest shorter than one. Full sequences stand alone. The rests of
a random group of some 2,048 documents are packed by first-fit decreasing: the tree holds the free room of each
bin, each inner node the largest below it, and the leftmost bin with room is found in log2 steps. Then the emptiest
bins are dissolved, for as long as the others have room for what they hold, cutting where needed; so a group pads
less than about one sequence.

Null and empty texts have the end id alone. Groups are drawn by a hash of the id and the row's place in its task,
so neither repeated rows nor null ids swell one. An empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from packetloom.llm.words import encoded, narrow, widened

SEQUENCE_BITS = 32
PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


class Tournament:
    """Free room of bins; ``first(n)`` is the leftmost with at least ``n``."""

    def __init__(self, bins: int, capacity: int):
        self.leaves = 1 << max(0, bins - 1).bit_length()
        self.room = [capacity] * (2 * self.leaves)

    def first(self, n: int) -> int:
        room, i = self.room, 1
        if room[1] < n:
            raise ValueError("no bin has that much room")
        while i < self.leaves:
            i *= 2
            if room[i] < n:
                i += 1
        return i - self.leaves

    def take(self, bin_: int, n: int) -> None:
        room, i = self.room, bin_ + self.leaves
        room[i] -= n
        while i > 1:
            i //= 2
            room[i] = max(room[2 * i], room[2 * i + 1])


def first_fit_decreasing(lengths: list[int], capacity: int) -> list[list[int]]:
    """Bins of item numbers. Ties keep their order."""
    tree, bins = Tournament(len(lengths), capacity), []
    for item in sorted(range(len(lengths)), key=lambda i: -lengths[i]):
        at = tree.first(lengths[item])
        tree.take(at, lengths[item])
        if at == len(bins):
            bins.append([])
        bins[at].append(item)
    return bins


def pack_group(lengths: list[int], capacity: int, cut: bool = True) -> list[list[tuple[int, int, int]]]:
    """Sequences of (item, first id, ids), none empty: first-fit decreasing, then the emptiest bins go into gaps."""
    bins = [[(i, 0, lengths[i]) for i in b] for b in first_fit_decreasing(lengths, capacity)]
    if not cut:
        return bins
    fills = [sum(n for _, _, n in b) for b in bins]
    order = sorted(range(len(bins)), key=lambda b: (-fills[b], b))  # fullest first
    room = sum(capacity - f for f in fills)
    gone = 0
    while gone < len(order):
        emptiest = order[len(order) - 1 - gone]
        if room - (capacity - fills[emptiest]) < fills[emptiest]:
            break
        room -= capacity
        gone += 1
    kept = order[: len(order) - gone]
    gaps = iter([b for b in kept if fills[b] < capacity])
    gap = next(gaps, None)
    for piece in (p for b in order[len(order) - gone :] for p in bins[b]):
        item, start, n = piece
        while n:
            while fills[gap] == capacity:
                gap = next(gaps)
            moved = min(n, capacity - fills[gap])
            bins[gap].append((item, start, moved))
            fills[gap] += moved
            start, n = start + moved, n - moved
    return [bins[b] for b in sorted(kept)]


def pack(docs: DataFrame, path: str, capacity: int = 2048, end_id: int = 1, group_size: int = 2048, seed: int = 11) -> DataFrame:
    """Pieces of the sequences that hold all ids of (doc_id, text); see the module for the method and the edge cases.

    One shuffle, of rests as 16-bit or 32-bit ids and of one checksum for each full sequence, evenly over groups.
    Memory: one group, whose size is fixed. A lost task is repeated with the same groups.
    """
    n_groups = max(1, math.ceil(docs.count() / group_size))
    row = pa.schema([("doc_id", pa.int64()), ("group", pa.int64()), ("doc_tokens", pa.int64()), ("full", pa.list_(pa.int64())), ("rest", pa.binary())])

    def tokens(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        step, place = 4 * capacity, 0
        for doc_ids, texts in encoded(batches, path, np.array([end_id], dtype="<u4").tobytes()):
            out: list[list] = [[] for _ in row.names]
            for doc_id, ids in zip(doc_ids, texts, strict=True):
                full, place = len(ids) // step, place + 1
                group = zlib.crc32(f"{seed},{doc_id},{place},{len(ids)}".encode()) % n_groups
                crcs = [zlib.crc32(ids[i * step : (i + 1) * step]) for i in range(full)]
                for column, value in zip(out, (doc_id, group, len(ids) // 4, crcs, narrow(ids[full * step :])), strict=True):
                    column.append(value)
            yield pa.record_batch(out, schema=row)

    def packed(key: tuple, group: pa.Table) -> pa.Table:
        base = key[0].as_py() << SEQUENCE_BITS
        rows = sorted(group.to_pylist(), key=lambda r: (r["doc_id"] is not None, r["doc_id"] or 0, r["doc_tokens"], r["rest"]))
        rests = [widened(r["rest"]) for r in rows]
        pieces, sequence = [], 0
        for r in rows:
            for i, crc in enumerate(r["full"]):
                pieces.append((r["doc_id"], i * capacity, capacity, crc, r["doc_tokens"], base + sequence, 0))
                sequence += 1
        items = [i for i, rest in enumerate(rests) if len(rest)]
        for one in pack_group([len(rests[i]) for i in items], capacity):
            offset = 0
            for item, start, n in one:
                r = rows[items[item]]
                ids = rests[items[item]][start : start + n]
                pieces.append((r["doc_id"], len(r["full"]) * capacity + start, n, zlib.crc32(ids.tobytes()), r["doc_tokens"], base + sequence, offset))
                offset += n
            sequence += 1
        names = [c.split()[0] for c in PIECES.split(", ")]
        return pa.table(dict(zip(names, (pa.array(c, pa.int64()) for c in zip(*pieces, strict=True)), strict=True)))

    rests = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(tokens, "doc_id long, group long, doc_tokens long, full array<long>, rest binary")
    return rests.groupBy("group").applyInArrow(packed, PIECES)
