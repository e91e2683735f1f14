"""Texts that share shingles, against all pairs in plain loops."""

import math
import random
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from llm.helpers import awkward, prose
from packetloom.llm import near_duplicates, similar_texts
from packetloom.llm.wordhash import RangeHash


def plain_set(text):
    found = (text or "").encode().lower().split()
    return frozenset(tuple(found[i : i + 5]) for i in range(max(1, len(found) - 4))) if found else frozenset()


def alike(a, b):
    return 9 * len(a & b) >= 4 * (len(a) + len(b)) if a or b else True


def plain_value(text):
    """Each different word votes with the root of its count, in whole numbers."""
    found = (text or "").encode().lower().split()
    votes = [0] * 64
    for word, n in Counter(found).items():
        data = np.frombuffer(word, dtype=np.uint8)
        h = int(RangeHash(data).of(np.array([0]), np.array([len(data)]))[0])
        for b in range(64):
            votes[b] += (1 if h >> b & 1 else -1) * round(similar_texts.ROOT_SCALE * math.sqrt(n))
    return sum(1 << b for b in range(64) if votes[b] > 0)


def plain_roots(texts, radius=64):
    """Components of all pairs that are alike, with fingerprints within ``radius``."""
    sets, values = [plain_set(t) for t in texts], [plain_value(t) for t in texts]
    root = list(range(len(sets)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(sets)):
        for j in range(i):
            if sets[i] == sets[j] or alike(sets[i], sets[j]) and (values[i] ^ values[j]).bit_count() <= radius:
                root[find(i)] = find(j)
    return [find(i) for i in range(len(sets))]


def plain_kept(rows, radius=similar_texts.RADIUS):
    """Ids and texts that stay, of different rows with ids."""
    rows = sorted({r for r in rows if r[0] is not None}, key=lambda r: (r[0], r[1] or ""))
    least = {}
    for row, root in zip(rows, plain_roots([t for _, t in rows], radius), strict=True):
        least.setdefault(root, row)
    return sorted(least.values(), key=lambda r: r[0])


def edited_copies():
    """Groups of texts with a growing number of edits, and texts that quote one passage."""
    rnd, rows, passage = random.Random(21), [], prose(random.Random(3), 60)
    for i in range(30):
        tokens = prose(rnd, rnd.choice([12, 60, 200])).split()
        for j in range(6):
            rows.append((1000 + 10 * i + j, " ".join(tokens)))
            for _ in range(rnd.choice([0, 1, 3])):
                tokens[rnd.randrange(len(tokens))] = prose(rnd, 1)
    rows += [(2000 + i, f"{passage} {prose(rnd, n)}") for i, n in enumerate([2, 5, 8, 12, 15, 20, 40, 60] * 3)]
    return rows


def test_links_of_the_stage(spark):
    rows = edited_copies()
    docs = awkward(spark, rows).select(*corpus_pipeline.COLUMNS)
    kept = corpus_pipeline.drop_near_duplicates(spark, docs, "")
    every = [(r.doc_id, r.text) for r in docs.collect()]
    got = [(r.doc_id, r.text) for r in kept.collect()]
    assert kept.columns == list(corpus_pipeline.COLUMNS) and (None, "no id here at all") in got
    assert sorted((r for r in got if r[0] is not None), key=lambda r: r[0]) == plain_kept(every)
    # of the texts that all similar pairs would let go, nine in ten go
    distinct = len({r for r in every if r[0] is not None})
    assert distinct - len(plain_kept(every)) >= 0.9 * (distinct - len(plain_kept(every, 64)))


def test_links_at_another_radius(spark, monkeypatch):
    """And with components in buckets counted as crowded from two members on."""
    monkeypatch.setattr(similar_texts, "FEW", 1)
    rows, radius = edited_copies(), 2
    kept = similar_texts.keep_one(spark.createDataFrame(rows, "doc_id long, text string"), radius)
    assert sorted((r.doc_id, r.text) for r in kept.collect()) == plain_kept(rows, radius)


def test_sets_and_fingerprints():
    texts = [None, "", " \n", "One", "one two", "a b c d", "a b c d e", "a b c d e f a b c d e", "é ü 中文 é x y", prose(random.Random(2), 3000)]
    values, sets = [], []
    for value, _, shingles, ends in similar_texts.features(texts):
        assert similar_texts.minima(shingles, ends).shape == (len(ends), 4)
        values += [int(v) & (1 << 64) - 1 for v in value]
        sets += [frozenset(s.tolist()) for s in np.split(shingles, ends[:-1])]
    assert values == [plain_value(t) for t in texts] and [len(s) for s in sets] == [len(plain_set(t)) for t in texts]
    for i in range(len(texts)):
        for j in range(i):
            assert len(sets[i] & sets[j]) == len(plain_set(texts[i]) & plain_set(texts[j]))
    apart = [next(iter(similar_texts.features([t]))) for t in texts]
    assert [int(a[0][0]) & (1 << 64) - 1 for a in apart] == values and [frozenset(a[2].tolist()) for a in apart] == sets


def test_minima_agree_as_often_as_sets_do():
    rnd = np.random.default_rng(4)
    sets = [np.sort(rnd.integers(-(1 << 62), 1 << 62, 90)) for _ in range(400)]
    others = [np.sort(np.concatenate((a[:80], rnd.integers(-(1 << 62), 1 << 62, 10)))) for a in sets]
    least = [similar_texts.minima(np.concatenate(x), np.cumsum([len(a) for a in x])) for x in (sets, others)]
    same = least[0] == least[1]
    assert abs(same.mean() - 0.8) < 0.03 and same.any(axis=1).mean() > 0.98
    assert similar_texts.minima(np.zeros(0, np.int64), np.array([0, 0])).tolist() == [[-1] * 4] * 2


def test_group_of_copies_meets_few_pairs(spark, monkeypatch):
    """A group of near copies is linked by way of few of its texts."""
    asked = []
    inner = similar_texts.verified
    monkeypatch.setattr(similar_texts, "verified", lambda pairs, *more: (asked.append(pairs.count()), inner(pairs, *more))[1])
    rnd, rows = random.Random(9), []
    base = prose(rnd, 200).split()
    for i in range(150):
        tokens = list(base)
        tokens[rnd.randrange(200)] = f"edit{i}"
        rows.append((i, " ".join(tokens)))
    kept = similar_texts.keep_one(spark.createDataFrame(rows, "doc_id long, text string"))
    assert [r.doc_id for r in kept.collect()] == [0]
    assert sum(asked) < 150 * 149 / 4


def test_no_texts(spark):
    docs = awkward(spark)
    assert similar_texts.keep_one(docs.limit(0)).count() == 0
    groups = defaultdict(list)
    for r in similar_texts.keep_one(docs).collect():
        groups[plain_set(r.text)].append(r.doc_id)
    assert groups[frozenset()] == [30]


@pytest.mark.parametrize("keep", [near_duplicates.keep_one, similar_texts.keep_one])
def test_repeated_ids_of_different_texts(spark, keep):
    rnd = random.Random(8)
    a, b, c = (prose(rnd, 80) for _ in range(3))
    rows = [(7, a), (3, a), (7, b), (9, c), (9, b + " end"), (9, c)]
    kept = keep(spark.createDataFrame(rows, "doc_id long, text string"), radius=8)
    assert sorted((r.doc_id, r.text) for r in kept.collect()) == sorted([(3, a), (7, b), (9, c)])


def test_fixture_against_all_pairs(spark, data):
    """The stage over the test table, every pair compared; nine in ten of those that share 0.8 go."""
    docs = spark.read.parquet(f"{data}/documents.parquet")
    got = sorted((r.doc_id, r.text) for r in corpus_pipeline.drop_near_duplicates(spark, docs, data).collect())
    every = [(r.doc_id, r.text) for r in docs.collect()]
    assert got == plain_kept(every) and len(got) < len(every)
    assert len(every) - len(got) >= 0.9 * (len(every) - len(plain_kept(every, 64)))
