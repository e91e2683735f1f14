"""Operator 9 on whole corpora: SimHash candidates by generalised pigeonhole, verified on sets of five-word shingles.

Two texts are linked if the intersection of their sets of five-word shingles is at least 0.8 of the union (words as in
operator 9; a shorter text is one shingle; texts without words are one set, the empty one) and their fingerprints are
within ``RADIUS`` bits. These fingerprints vote on single words, each with the root of its count: an edited word changes
five shingles but one vote, so similar texts lie closer together than by shingles; see the README for measured recall.

Candidates meet in buckets of (partition, bits, band): a band is three minima of a set, the least of its shingles in three
random orders; a set has eight, and all but 3 in 1000 of the pairs at 0.8 share one (0.488 ** 8). A text none of whose
bands any other set has is in no bucket. Every text is first held against the most central text of each of its bands, the
one whose bands are shared most; pairs are then sought in the buckets between the components found so, never within the
largest one of a bucket, so a large group of near copies isn't compared pair by pair.

Candidates must also fit in size and by their sketches, in which every shingle flips one bit: sketches differ in no more
bits than sets differ in shingles, so up to ``SKETCH`` shingles no pair at 0.8 is lost. Larger sets are sketched from a
part of their shingles, a half or a quarter and so on, with a margin of four deviations.

Equal sets are one node, named by a 64-bit hash: among a billion sets, the odds that any two share one are 3 in 100.
Null texts count as empty. Repeated rows and ties of id are settled by ``one_of_each``; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from packetloom.llm.common import may_be_among, written
from packetloom.llm.near_duplicates import BITS, components, one_of_each, plan, signed
from packetloom.llm.wordhash import WHITE_SPACE, RangeHash, blocks, mixed, spans

WORDS = 5
#: Bits that fingerprints may differ in.
RADIUS = 8
#: At least so similar, as a fraction.
PART, WHOLE = 4, 5
VOTE_ROWS = 1 << 15
#: Members of a component in a bucket, up to which pairs within it may be formed and dropped at once.
FEW = 8
#: Bits of a sketch, and the most shingles that are sketched without leaving any out.
SKETCH, LONGS = 512, 512 // 64
#: Deviations by which the sketches of larger sets may exceed what is expected of sets at 0.8.
MARGIN = 4
#: Votes are whole numbers, so their sums don't depend on the order: the root of a count times this.
ROOT_SCALE = 64
#: Odd multipliers for the places of the words in a shingle.
PLACES = mixed(np.arange(1, WORDS + 1, dtype=np.uint64)) | np.uint64(1)
#: What makes the random orders of the minima: in each three rows, minima at one place make a band.
ORDERS = mixed(np.arange(101, 125, dtype=np.uint64)).reshape(6, 4)
BAND = 3
SKETCHED = mixed(np.arange(201, 202, dtype=np.uint64))
NODE = ["node", "value", "size", "level", *(f"own{i}" for i in range(LONGS)), *(f"next{i}" for i in range(LONGS))]


def voted(hashes: np.ndarray, weights: np.ndarray, owner: np.ndarray, n: int) -> np.ndarray:
    """Fingerprints of ``n`` owners: bits that the weighted votes are for. Rows are sorted by owner."""
    votes = np.zeros((n, BITS), dtype=np.int64)
    for i in range(0, len(hashes), VOTE_ROWS):
        w, own = weights[i : i + VOTE_ROWS].astype(np.int32), owner[i : i + VOTE_ROWS]
        first = np.flatnonzero(np.concatenate(([True], own[1:] != own[:-1])))
        bits = np.unpackbits(hashes[i : i + VOTE_ROWS].astype(">u8").view(np.uint8).reshape(-1, 8), axis=1)
        votes[own[first]] += 2 * np.add.reduceat(bits * w[:, None], first, axis=0, dtype=np.int64)
        votes[own[first]] -= np.add.reduceat(w, first, dtype=np.int64)[:, None]
    return np.packbits(votes > 0, axis=1).view(">u8").ravel().astype(np.uint64)


def counted(hashes: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The different hashes of each owner, ascending, with their owners and counts."""
    order = np.lexsort((hashes, owner))
    hashes, owner = hashes[order], owner[order]
    new = np.flatnonzero(np.concatenate(([True], (hashes[1:] != hashes[:-1]) | (owner[1:] != owner[:-1])))) if len(hashes) else np.zeros(0, np.int64)
    return hashes[new], owner[new], np.diff(np.append(new, len(hashes)))


def shingled(words: np.ndarray, owner: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the shingles and their owners, from the words of ``n`` texts in turn."""
    counts = np.bincount(owner, minlength=n)
    first = np.cumsum(counts) - counts
    found, owners = [], []
    for width in range(1, WORDS + 1):
        # whole texts of fewer words, and all starts in the others
        has = counts == width if width < WORDS else counts >= WORDS
        at = np.flatnonzero(has[owner] & (np.arange(len(words)) - first[owner] <= counts[owner] - width))
        sums = np.zeros(len(at), dtype=np.uint64)
        for k in range(width):
            sums += words[at + k] * PLACES[k]
        found.append(mixed(sums + np.uint64(width)))
        owners.append(owner[at])
    return np.concatenate(found), np.concatenate(owners)


def level_of(sizes: np.ndarray) -> np.ndarray:
    """How often sets of these sizes are halved before they are sketched."""
    return np.ceil(np.log2(np.maximum(sizes, SKETCH) / SKETCH)).astype(np.int64)


def sketched(shingles: np.ndarray, owner: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Sketches of sets (a row a set, as longs): at its own level, then at the next one, which larger partners may have."""
    n, h = len(sizes), mixed(shingles.view(np.uint64) ^ SKETCHED)
    level = level_of(sizes)[owner].astype(np.uint64)
    place, found = (h & np.uint64(SKETCH - 1)).astype(np.int64), []
    for more in (0, 1):
        taken = (h >> np.uint64(32)) & ((np.uint64(1) << (level + np.uint64(more))) - np.uint64(1)) == 0
        flips = np.bincount(owner[taken] * SKETCH + place[taken], minlength=n * SKETCH).reshape(n, SKETCH) & 1
        found.append(np.packbits(flips.astype(np.uint8), axis=1).view(np.int64))
    return np.concatenate(found, axis=1)


def features(texts: Iterable[str | None]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """For blocks of texts in turn: fingerprints, sketches, the sets of shingles (signed longs, ascending) one after another,
    and where each ends."""
    raw = [(t or "").encode("utf-8", "surrogatepass").lower() for t in texts]
    for lo, hi, data, starts in blocks(raw):
        begin, end = spans(~WHITE_SPACE[data])
        owner = np.searchsorted(starts, begin, side="right") - 1
        words = RangeHash(data).of(begin, end)
        names, own, times = counted(words, owner)
        value = voted(names, np.rint(np.sqrt(times) * ROOT_SCALE), own, hi - lo)
        shingles, own = shingled(words, owner, hi - lo)
        shingles, own, _ = counted(shingles.view(np.int64), own)
        sizes = np.bincount(own, minlength=hi - lo)
        yield value.view(np.int64), sketched(shingles, own, sizes), shingles, np.cumsum(sizes)


def minima(shingles: np.ndarray, ends: np.ndarray, orders: np.ndarray = ORDERS[0]) -> np.ndarray:
    """The least of each set's shingles in each order, a row a set; empty sets have their own."""
    found = np.full((len(ends), len(orders)), -1, dtype=np.int64)
    starts = np.append(0, ends[:-1]).astype(np.int64)
    full = ends > starts
    for k, order in enumerate(orders):
        if full.any():
            found[full, k] = np.minimum.reduceat(mixed(shingles.view(np.uint64) ^ order).view(np.int64), starts[full])
    return found


def bands(shingles: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Each set's bands, a row a set: hashes of the place and of the minima that make it."""
    found = []
    for lo in range(0, len(ORDERS), BAND):
        band = np.arange(lo * ORDERS.shape[1], (lo + 1) * ORDERS.shape[1], dtype=np.uint64) + np.zeros((len(ends), 1), np.uint64)
        for orders in ORDERS[lo : lo + BAND]:
            band = mixed(band ^ mixed(minima(shingles, ends, orders).view(np.uint64)))
        found.append(band.view(np.int64))
    return np.concatenate(found, axis=1)


def looked_up(docs: DataFrame) -> DataFrame:
    """(doc_id, key, the columns in ``NODE``, bands) for each row of (doc_id, text): key is the text's hash, node that of its
    set, size the number of its shingles, value the fingerprint; level, own and next are of the sketch. No shuffle."""
    names = ["doc_id", "key", *NODE, "bands"]

    def of(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        for batch in batches:
            columns: list[list[np.ndarray]] = [[] for _ in names[2:]]
            for value, sketch, shingles, ends in features(t.as_py() for t in batch.column("text")):
                data, starts = shingles.tobytes(), np.append(0, ends[:-1])
                nodes = [xxhash.xxh64_intdigest(data[8 * a : 8 * b], 42) for a, b in zip(starts.tolist(), ends.tolist(), strict=True)]
                sizes = ends - starts
                flat = (np.array(nodes, dtype=np.uint64).view(np.int64), value, sizes, level_of(sizes), *sketch.T, bands(shingles, ends).ravel())
                for column, part in zip(columns, flat, strict=True):
                    column.append(part)
            if batch.num_rows:
                *flat, shared = (pa.array(np.concatenate(c)) for c in columns)
                width = len(shared) // batch.num_rows
                lists = pa.ListArray.from_arrays(pa.array(np.arange(0, len(shared) + 1, width, dtype=np.int32)), shared)
                yield pa.record_batch([batch.column("doc_id"), batch.column("key"), *flat, lists], names=names)

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("key"), "text")
    return rows.mapInArrow(of, ", ".join(f"{c} long" for c in names[:-1]) + ", bands array<long>")


def buckets(slots: DataFrame, parts: list[tuple[int, int]]) -> DataFrame:
    """(at, part, node, root, home) for each bucket that a node of (node, root, value, band) is in: its own ones (home), and those
    that it probes, which are its neighbours within a partition's threshold."""
    places = [[b for b in range(BITS) if mask >> b & 1] for mask, _ in parts]
    flips = [[sum(1 << b for b in chosen) for d in range(t + 1) for chosen in combinations(own, d)] for own, (_, t) in zip(places, parts, strict=True)]
    kept = [F.col("value").bitwiseAND(F.lit(signed(mask))) for mask, _ in parts]
    probes = [F.struct(F.lit(n).alias("part"), kept[n].bitwiseXOR(F.lit(signed(f))).alias("key"), F.lit(f == 0).alias("home")) for n in range(len(parts)) for f in flips[n]]
    spread = slots.select("node", "root", "band", F.explode(F.array(*probes)).alias("p"))
    return spread.select(F.xxhash64("p.part", "p.key", "band").alias("at"), "p.part", "node", "root", "p.home")


def close(a: Column, b: Column, radius: int) -> Column:
    """Whether two different nodes are candidates: by fingerprint, by size and by sketch."""

    def apart(of_a: str, of_b: str) -> Column:
        return sum((F.bit_count(a[f"{of_a}{i}"].bitwiseXOR(b[f"{of_b}{i}"])) for i in range(LONGS)), F.lit(0))

    near = F.bit_count(a["value"].bitwiseXOR(b["value"])) <= radius
    fits = (WHOLE * F.least(a["size"], b["size"]) >= PART * F.greatest(a["size"], b["size"])) & (F.abs(a["level"] - b["level"]) <= 1)
    bits = F.when(a["level"] == b["level"], apart("own", "own")).when(a["level"] > b["level"], apart("own", "next")).otherwise(apart("next", "own"))
    # of sets at 0.8, the shingles that are in one alone are at most so many of all
    most = (a["size"] + b["size"]) * F.lit((WHOLE - PART) / (WHOLE + PART)) / F.pow(F.lit(2.0), F.greatest(a["level"], b["level"]))
    margin = F.when(F.greatest(a["level"], b["level"]) > 0, MARGIN * F.sqrt(most)).otherwise(F.lit(1e-6))
    return (a["node"] != b["node"]) & near & fits & (bits <= most + margin)


def first_part(parts: list[tuple[int, int]], a: Column, b: Column) -> Column:
    """The first partition in which two nodes meet: a pair is formed there alone."""
    differ = a["value"].bitwiseXOR(b["value"])
    return F.coalesce(*(F.when(F.bit_count(differ.bitwiseAND(F.lit(signed(mask)))) <= t, F.lit(n)) for n, (mask, t) in enumerate(parts)))


def pairs(rows: DataFrame, a: str, b: str) -> DataFrame:
    """The different (a, b), a < b, of the nodes in two columns."""
    return rows.select(F.least(a, b).alias("a"), F.greatest(a, b).alias("b")).where("a < b").distinct()


def verified(asked: DataFrame, nodes: DataFrame, docs: DataFrame) -> DataFrame:
    """The (a, b) of ``asked`` whose sets are similar. Each set is taken from its text once, as 32 bits of each shingle's
    hash: of a set of 10,000 shingles, two agree in these with odds of 1 in 100, which moves its size by one."""

    def of(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = []
            for _, _, shingles, ends in features(t.as_py() for t in batch.column("text")):
                sets += np.split(shingles.astype(np.int32), ends[:-1])
            yield pa.record_batch([batch.column("node"), pa.array(sets, pa.list_(pa.int32()))], names=["node", "shingles"])

    wanted = asked.select(F.col("a").alias("node")).union(asked.select("b")).distinct()
    keys = written(nodes.select("node", "key").join(wanted, "node", "left_semi"), "asked-keys")
    possible = may_be_among(keys, "key")(F.xxhash64("text"))
    texts = docs.where(possible).select(F.xxhash64("text").alias("key"), "text").join(keys, "key").dropDuplicates(["node"]).select("node", "text")
    sets = written(texts.mapInArrow(of, "node long, shingles array<int>"), "asked-sets")
    both = asked.join(sets.select(F.col("node").alias("a"), F.col("shingles").alias("of_a")), "a").join(sets.select(F.col("node").alias("b"), F.col("shingles").alias("of_b")), "b")
    common = F.size(F.array_intersect("of_a", "of_b"))
    return both.where((WHOLE + PART) * common >= PART * (F.size("of_a") + F.size("of_b"))).select("a", "b")


def similar_roots(rows: DataFrame, docs: DataFrame, radius: int = RADIUS) -> DataFrame:
    """(node, root) of the components of all links, for nodes that are in any. ``rows`` from :func:`looked_up`."""
    first = F.min(F.struct("key", *NODE[1:], "bands")).alias("f")
    nodes = written(rows.groupBy("node").agg(first).select("node", "f.*"), "nodes")
    described = nodes.select("node", F.struct(*NODE).alias("m"))
    own = nodes.select("node", "value", F.explode("bands").alias("band"))
    common = written(own.groupBy("band").agg(F.count("*").alias("n")).where("n > 1"), "common-bands")
    slots = written(own.join(common, "band"), "slots")
    parts = plan(slots.select("value", "band"), radius, "band")

    central = slots.join(slots.groupBy("node").agg(F.sum("n").alias("score")), "node").groupBy("band").agg(F.max(F.struct("score", "node")).alias("c"))
    met = pairs(slots.join(central, "band").select("node", F.col("c.node").alias("central")), "node", "central")
    of_a, of_b = (described.select(F.col("node").alias(c), F.col("m").alias(f"of_{c}")) for c in "ab")
    tried = written(met.join(of_a, "a").join(of_b, "b").where(close(F.col("of_a"), F.col("of_b"), radius)).select("a", "b"), "first-pairs")
    near = written(verified(tried, nodes, docs), "first-links")
    roots = written(components(near), "first-components")

    rooted = slots.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    placed = written(buckets(rooted, parts), "placed")
    # buckets where components meet, and the one with the most members there: pairs within it are never formed
    there = placed.groupBy("at", "root").agg(F.count("*").alias("n"))
    meets = there.groupBy("at").agg(F.min("root").alias("lo"), F.max("root").alias("hi"), F.max(F.struct("n", "root")).alias("most")).where("lo < hi")
    shared = written(meets.select("at", F.when(F.col("most.n") > FEW, F.col("most.root")).alias("leader")), "shared-buckets")
    crowd = placed.join(shared, "at").withColumn("leads", F.coalesce(F.col("root") == F.col("leader"), F.lit(False)))
    seats = written(crowd.select("at", "part", "node", "root", "home", "leads").join(described, "node").drop("node"), "seats")
    homes = seats.where("home").select("at", F.col("root").alias("other"), F.col("m").alias("h"), F.col("leads").alias("other_leads"))
    across = (F.col("root") != F.col("other")) & close(F.col("m"), F.col("h"), radius) & (F.col("part") == first_part(parts, F.col("m"), F.col("h")))
    found = seats.where("NOT leads").join(homes, "at").where((F.col("other_leads") | (F.col("m.node") < F.col("h.node"))) & across)
    # a bucket of nodes that agree has each pair both ways; in others, the one that probes may be of the largest component
    probed = [n for n, (_, t) in enumerate(parts) if t > 0]
    if probed:
        led = seats.where(F.col("leads") & F.col("part").isin(probed)).join(homes.where("NOT other_leads"), "at").where(across)
        found = found.union(led.select(found.columns))
    found = found.select(F.col("m.node").alias("x"), F.col("h.node").alias("y"))
    rest = written(pairs(found, "x", "y").join(tried, ["a", "b"], "left_anti"), "other-pairs")
    return components(near.union(verified(rest, nodes, docs)))


def keep_one(docs: DataFrame, radius: int = RADIUS) -> DataFrame:
    """The rows of ``docs`` (doc_id, text and any others) with one document of each component left, its smallest doc_id."""
    rows = written(looked_up(docs), "looked-up-sets")
    roots = written(similar_roots(rows, docs, radius), "components")
    return one_of_each(docs, rows.join(roots, "node", "left").select("doc_id", "key", F.coalesce("root", "node").alias("root")))
