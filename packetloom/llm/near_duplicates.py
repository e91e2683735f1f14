"""Operator 9, SimHash near-duplicates: generalised pigeonhole search over fingerprints, and components of the links.

Fingerprint of a whole text: ASCII letters lower-cased, words are runs of bytes other than ASCII white space, terms
are shingles of three words (repeats count; a shorter text is one term), hashed by XXH64 with seed 42. A bit is set
if it is set in over half of the hashes. A text without words (null, empty, blank) has fingerprint zero and is
linked like any other.

The search runs over distinct fingerprints. Correlated bits are grouped into partitions, so that the partitions vary
as independently as they can. Pigeonhole: if thresholds t_i >= -1 satisfy sum(t_i + 1) = radius + 1, then fingerprints
within the radius are within t_i bits of each other in some partition i. Dynamic programming divides radius + 1 among
the partitions so that the estimated candidates are fewest; partitions at -1 aren't probed. Candidates are verified.

Bits, collisions and links are counted over all fingerprints. The driver gets 64 x 64 bit counts and one sum for each
partition, never fingerprints or links. Equal rows get equal results; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from packetloom.llm.common import free_name, may_be_among, written

BITS, TERMS_AT_ONCE = 64, 1 << 16


def shingle_hashes(text: str | None, words: int = 3) -> np.ndarray:
    import xxhash

    found = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not found:
        return np.zeros(0, dtype=np.uint64)
    joined, digest = b" ".join(found), xxhash.xxh64_intdigest
    ends = np.cumsum([len(w) + 1 for w in found])
    starts = [0, *ends[:-1].tolist()]
    last = (ends - 1).tolist()[min(words, len(found)) - 1 :]
    return np.fromiter((digest(joined[a:b], 42) for a, b in zip(starts, last, strict=False)), dtype=np.uint64, count=len(last))


def simhash(texts: Iterable[str | None], words: int = 3) -> list[int]:
    """Unsigned 64-bit fingerprints."""
    out: list[int] = []
    held: list[np.ndarray] = []
    size = 0

    def flush() -> None:
        if not held:
            return
        counts = np.array([len(h) for h in held])
        votes = np.zeros((len(held), BITS), dtype=np.int64)
        rows, hashes = np.repeat(np.arange(len(held)), counts), np.concatenate(held)
        for i in range(0, len(hashes), TERMS_AT_ONCE):
            own = rows[i : i + TERMS_AT_ONCE]
            first = np.flatnonzero(np.concatenate(([True], own[1:] != own[:-1])))
            bits = np.unpackbits(hashes[i : i + TERMS_AT_ONCE].astype(">u8").view(np.uint8).reshape(-1, 8), axis=1)
            votes[own[first]] += np.add.reduceat(bits, first, axis=0, dtype=np.int64)
        out.extend(np.packbits(2 * votes > counts[:, None], axis=1).view(">u8").ravel().tolist())
        held.clear()

    for text in texts:
        held.append(shingle_hashes(text, words))
        size += len(held[-1])
        if size > TERMS_AT_ONCE:
            flush()
            size = 0
    flush()
    return out


def fingerprints(docs: DataFrame, words: int = 3) -> DataFrame:
    """(doc_id, key, value): hash of the text, and the fingerprint of each row as a signed long. No shuffle."""

    def of(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            prints = np.array(simhash((t.as_py() for t in batch.column("text")), words), dtype=np.uint64).view(np.int64)
            yield pa.record_batch([batch.column("doc_id"), batch.column("key"), pa.array(prints)], names=["doc_id", "key", "value"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("key"), "text")
    return rows.mapInArrow(of, "doc_id long, key long, value long")


def bit_correlations(values: DataFrame) -> np.ndarray:
    """Absolute correlation of each pair of bits over all ``value``."""

    def counts(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        both, n = np.zeros((BITS, BITS)), 0
        for batch in batches:
            for lo in range(0, batch.num_rows, 1 << 14):
                part = batch.column("value").slice(lo, 1 << 14).to_numpy(zero_copy_only=False).astype(">i8")
                bits = np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1)[:, ::-1].astype(np.float32)
                both += bits.T @ bits
                n += len(part)
        yield pa.record_batch([pa.array(range(BITS * BITS + 1), pa.int32()), pa.array(np.append(both.ravel(), n).astype(np.int64))], names=["cell", "n"])

    cells = {r.cell: r.n for r in values.select("value").mapInArrow(counts, "cell int, n long").groupBy("cell").agg(F.sum("n").alias("n")).collect()}
    n = max(1, cells.get(BITS * BITS, 0))
    both = np.array([cells.get(i, 0) for i in range(BITS * BITS)], dtype=float).reshape(BITS, BITS) / n
    p = both.diagonal()
    spread = np.sqrt(np.clip(p * (1 - p), 1e-12, None))
    return np.abs((both - np.outer(p, p)) / np.outer(spread, spread))


def grouped_bits(correlation: np.ndarray, parts: int) -> list[int]:
    """Masks of ``parts`` partitions of nearly equal width: each starts from the bit most tied to the bits left, and
    takes in the bit most correlated with those it has."""
    left, masks = list(range(BITS)), []
    for i in range(parts):
        width = len(left) // (parts - i)
        chosen = [max(left, key=lambda b: (correlation[b, left].sum(), -b))]
        left.remove(chosen[0])
        while len(chosen) < width:
            chosen.append(max(left, key=lambda b: (correlation[b, chosen].mean(), -b)))
            left.remove(chosen[-1])
        masks.append(sum(1 << b for b in chosen))
    return masks


def signed(mask: int) -> int:
    return mask - (1 << BITS) if mask >> (BITS - 1) else mask


def allocate(costs: list[list[float]], units: int) -> tuple[float, list[int]]:
    """costs[i][u]: the cost of partition i with u units, u from 0. The cheapest way to give out ``units``, by dynamic
    programming over partitions; thresholds are units less one."""
    best: list[tuple[float, list[int]]] = [(0.0, [])] + [(float("inf"), [])] * units
    for cost in costs:
        best = [min(((best[n - u][0] + cost[u], [*best[n - u][1], u - 1]) for u in range(min(n, len(cost) - 1) + 1)), key=lambda x: x[0]) for n in range(units + 1)]
    return best[units]


def plan(values: DataFrame, radius: int, within: str | None = None) -> list[tuple[int, int]]:
    """(mask, threshold) of the partitions to probe, for the fingerprints ``values``; ``within``: a column that must agree.

    For 2 to radius + 1 partitions, pairs that agree in a partition are counted over all fingerprints; within t bits,
    as many times more are estimated as there are values within t bits. Probes that are sent out count as well.
    """
    correlation = bit_correlations(values)
    options = [grouped_bits(correlation, parts) for parts in range(min(2, radius + 1), radius + 2)]
    masks = sorted({m for option in options for m in option})
    keys = F.explode(F.array(*(F.struct(F.lit(i).alias("part"), F.col("value").bitwiseAND(F.lit(signed(m))).alias("key")) for i, m in enumerate(masks)))).alias("at")
    scope = [within] if within else []
    met = values.select(*scope, keys).groupBy(*scope, "at").count().groupBy("at.part").agg(F.sum(F.expr("cast(count as double) * (count - 1) / 2")).alias("pairs"), F.sum("count").alias("n"))
    seen = {masks[r.part]: r for r in met.collect()}

    def cost(mask: int) -> list[float]:
        near = np.cumsum([comb(mask.bit_count(), d) for d in range(radius + 1)])
        return [0.0, *(float(v) * ((seen[mask].pairs + seen[mask].n) if mask in seen else 1.0) for v in near)]

    _, chosen, option = min(((*allocate([cost(m) for m in option], radius + 1), option) for option in options), key=lambda x: x[0])
    return [(m, t) for m, t in zip(option, chosen, strict=True) if t >= 0]


def links(values: DataFrame, radius: int = 2) -> DataFrame:
    """(a, b), a < b: all pairs of the distinct fingerprints ``values`` at most ``radius`` bits apart, each once."""
    parts = plan(values, radius)
    probes, homes, earlier = [], [], []
    for n, (mask, t) in enumerate(parts):
        places = [b for b in range(BITS) if mask >> b & 1]
        flips = [sum(1 << b for b in chosen) for d in range(t + 1) for chosen in combinations(places, d)]
        kept = F.col("value").bitwiseAND(F.lit(signed(mask)))
        homes.append(F.struct(F.lit(n).alias("part"), kept.alias("key")))
        probes += [F.struct(F.lit(n).alias("part"), kept.bitwiseXOR(F.lit(signed(f))).alias("key")) for f in flips]
        earlier.append(f"WHEN bit_count((a ^ b) & {signed(mask)}L) <= {t} THEN {n}")
    asked = values.select(F.col("value").alias("a"), F.explode(F.array(*probes)).alias("at")).select("a", "at.*")
    kept = values.select(F.col("value").alias("b"), F.explode(F.array(*homes)).alias("at")).select("b", "at.*")
    near = f"a < b AND bit_count(a ^ b) <= {radius} AND part = CASE {' '.join(earlier)} END"
    return asked.join(kept, ["part", "key"]).where(near).select("a", "b")


def components(edges: DataFrame) -> DataFrame:
    """(node, root): the smallest node that each node of ``edges`` (a, b) is connected with, itself included.

    Large-star and small-star steps in turn: every neighbour is handed to the smallest one, until nothing changes;
    rounds grow with the logarithm of the size. Each step is written to the shared folder, so lineage stays short.
    """

    def state(e: DataFrame) -> tuple:
        return tuple(e.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())

    def star(e: DataFrame, large: bool) -> DataFrame:
        """Hands on the larger neighbours (large), or the smaller ones and the node itself (small)."""
        both = e.select("a", "b").union(e.select(F.col("b"), F.col("a"))) if large else e.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("least"))
        known = both.join(least, "a")
        handed = known.where("b > a").select(F.col("b").alias("a"), F.col("least").alias("b")) if large else known.select(F.col("b").alias("a"), F.col("least").alias("b")).union(least.select("a", F.col("least").alias("b")))
        return handed.where("a <> b").distinct()

    edges = written(edges.where("a <> b").distinct(), "edges")
    before, now = None, state(edges)
    while now != before:
        edges = written(star(written(star(edges, True), "large-star"), False), "small-star")
        before, now = now, state(edges)
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root")).union(edges.select(F.col("b"), F.col("b")).distinct())


def classes(prints: DataFrame, radius: int) -> DataFrame:
    """(value, component_id) of the distinct fingerprints in ``prints`` (doc_id, value)."""
    nodes = written(prints.groupBy("value").agg(F.min("doc_id").alias("least_id")), "distinct-fingerprints")
    roots = written(components(links(nodes.select("value"), radius)), "components")
    named = nodes.join(roots.withColumnRenamed("node", "value"), "value", "left").withColumn("root", F.coalesce("root", "value"))
    # written, so that a component of very many fingerprints is split by the skew join
    least = written(named.groupBy("root").agg(F.min("least_id").alias("component_id")), "least-ids")
    return written(named.select("value", "root").join(least, "root").select("value", "root", "component_id"), "classes")


def near_duplicates(docs: DataFrame, words: int = 3, radius: int = 2) -> DataFrame:
    """(doc_id, value, component_id) for each row of (doc_id, text): the smallest doc_id that can be reached by links.

    Null ids don't count as smallest; a component of such rows alone has none. Equal fingerprints are joined before
    the search, so a group of copies is one node however large, and only pairs of different fingerprints are links.
    """
    prints = written(fingerprints(docs, words).select("doc_id", "value"), "fingerprints")
    return prints.join(classes(prints, radius), "value").select("doc_id", "value", "component_id")


def one_of_each(docs: DataFrame, decided: DataFrame) -> DataFrame:
    """The rows of ``docs`` with one left of each root in ``decided`` (doc_id, key, root), its smallest (doc_id, key).

    Decisions name a row by its id and its text's hash, so different texts under one id are decided apart. Of equal rows
    one stays. Rows without an id can't be named by a decision, and stay. Only rows that may go move to the
    join that drops them; ``docs`` is read for each part.
    """
    key = free_name(docs, "key__")
    named = written(decided.where(F.col("doc_id").isNotNull()), "decisions")
    least = written(named.groupBy("root").agg(F.min(F.struct("doc_id", "key")).alias("least")), "least-rows")
    stays = F.struct("doc_id", "key") == F.col("least")
    gone = written(named.join(least, "root").where(~stays).select("doc_id", F.col("key").alias(key)).distinct(), "dropped-rows")
    repeated = written(named.groupBy("doc_id", F.col("key").alias(key)).count().where("count > 1").drop("count"), "repeated-rows")
    rows = docs.withColumn(key, F.xxhash64("text"))
    possible = may_be_among(gone, "doc_id", key)(F.col("doc_id").cast("long"), F.col(key))
    kept = rows.where(~possible).unionByName(rows.where(possible).join(gone, ["doc_id", key], "left_anti").select(rows.columns))
    if repeated.isEmpty():
        return kept.select(docs.columns)
    once = kept.join(repeated, ["doc_id", key], "left_semi").dropDuplicates(["doc_id", key])
    return kept.join(repeated, ["doc_id", key], "left_anti").select(docs.columns).unionByName(once.select(docs.columns))


def keep_one(docs: DataFrame, words: int = 3, radius: int = 2) -> DataFrame:
    """The rows of ``docs`` (doc_id, text and any others) with one document of each component left: its smallest doc_id."""
    prints = written(fingerprints(docs, words), "fingerprints")
    return one_of_each(docs, prints.join(classes(prints, radius), "value").select("doc_id", "key", "root"))
