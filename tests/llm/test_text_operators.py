"""Fingerprints, BPE, packing and token files against plain versions."""

import base64
import hashlib
import random
import zlib
from collections import Counter, defaultdict
from itertools import combinations

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from llm.helpers import SCHEMA, awkward, in_order, prose, texts_of
from packetloom.llm import bpe, fingerprints, packing, token_files, wordhash, words
from packetloom.llm.common import scratch_path

P = pytest.importorskip("public_tokenizers")
WORD = P.path("word_bpe_49k.json")
BYTES = P.path("byte_bpe_multi_50k.tiktoken")
SOME_TEXT = st.text(st.sampled_from("aabcdeTHERS  \n.,!'éßÀñ中文字́😀0123 \x00\x1c\x85\xa0İΣς|<>"), max_size=50)


@pytest.fixture(scope="module")
def docs(spark):
    return awkward(spark).cache()


# --- fingerprints -------------------------------------------------------------------------------------------------


def test_range_hash_is_of_bytes_alone():
    data = np.frombuffer(b"abc xabc abcab", dtype=np.uint8)
    h = wordhash.RangeHash(data).of(np.array([0, 5, 9, 9, 12]), np.array([3, 8, 12, 11, 14]))
    assert h[0] == h[1] == h[2] and h[3] == h[4] and h[0] != h[3]


def plain_simhash(text):
    """By a vote for each occurrence of each term, one at a time."""
    raw = (text or "").encode().lower().split()
    hashed = [int(wordhash.RangeHash(np.frombuffer(w, dtype=np.uint8)).of(np.array([0]), np.array([len(w)]))[0]) for w in raw]
    terms = [(h, 1) for h, w in zip(hashed, raw, strict=True) if len(w) > 6 or len(raw) < 2]
    mask = (1 << 64) - 1
    terms += [(int(wordhash.mixed(np.array([(a * wordhash.BASE + b) & mask], dtype=np.uint64))[0]), 2) for a, b in zip(hashed, hashed[1:], strict=False)]
    return sum(1 << bit for bit in range(64) if sum(w if h >> bit & 1 else -w for h, w in terms) > 0)


def test_simhash_votes():
    rnd = random.Random(1)
    texts = [prose(rnd, n) for n in (0, 1, 2, 3, 50, 400)] + [None, " ", "Abc ABC abc", "über Über"]
    assert fingerprints.simhash(texts).tolist() == [plain_simhash(t) for t in texts]
    long = [prose(rnd, 40_000), "x"]
    assert fingerprints.simhash(long).tolist() == [int(fingerprints.simhash([t])[0]) for t in long]


def test_edited_and_next(spark, docs):
    got = fingerprints.fingerprints_with_next(docs, buckets=4).collect()
    rows = in_order(texts_of(docs))
    assert len(got) == len(rows)
    want = Counter()
    for i, (doc_id, text) in enumerate(rows):
        text, after = text or "", rows[(i + 1) % len(rows)][1] or ""
        q = len(text) // 4
        edited = text[: len(text) - q] + after[:q]
        a, b, c = (int(x) for x in fingerprints.simhash([text, edited, after]))
        want[(doc_id, len(text), hashlib.sha256(edited.encode()).hexdigest(), f"{a:016x}", f"{b:016x}", 1 - (a ^ b).bit_count() / 64, 1 - (a ^ c).bit_count() / 64)] += 1
    assert Counter(map(tuple, got)) == want


def test_next_of_few_rows(spark):
    one = spark.createDataFrame([(5, "some words here")], "doc_id long, text string")
    assert fingerprints.fingerprints_with_next(one).first().near_next == 1.0
    assert fingerprints.fingerprints_with_next(one.limit(0)).count() == 0


def test_edits_show(spark):
    rnd = random.Random(9)
    frame = spark.createDataFrame([(i, prose(rnd, 200)) for i in range(60)], "doc_id long, text string")
    rows = fingerprints.fingerprints_with_next(frame).collect()
    assert min(r.near_edited for r in rows) > max(r.near_next for r in rows) - 0.1 and sum(r.near_edited - r.near_next for r in rows) / 60 > 0.2


@pytest.mark.parametrize(("radius", "blocks"), [(0, 1), (1, 2), (3, 4), (3, 6)])
def test_block_tables_find_all(spark, radius, blocks):
    rnd = random.Random(radius)
    values = [rnd.getrandbits(64) for _ in range(60)]
    for v in list(values):
        for n in range(6):
            values.append(v ^ sum(1 << b for b in rnd.sample(range(64), n)))
    values = [v - (1 << 64) if v >> 63 else v for v in values]
    frame = spark.createDataFrame([(v,) for v in [*values, *values[:5]]] + [(None,)], "fingerprint long")
    got = Counter((r.query_value, r.index_value, r.distance) for r in fingerprints.within_radius(frame, frame, radius=radius, blocks_=blocks).collect())
    mask = (1 << 64) - 1
    want = {(a, b, ((a ^ b) & mask).bit_count()) for a in set(values) for b in set(values) if ((a ^ b) & mask).bit_count() <= radius}
    assert got == dict.fromkeys(want, 1)


# --- byte-level BPE -------------------------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def reference():
    tiktoken = pytest.importorskip("tiktoken")
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=bpe.read_ranks(BYTES), special_tokens={})


@settings(max_examples=300, deadline=None)
@given(SOME_TEXT | st.text(max_size=40).filter(lambda t: not any(0xD800 <= ord(c) < 0xE000 for c in t)))
def test_encoding_is_exact(reference, text):
    own = bpe.encoder(BYTES, P.PATTERN)
    ids = own.encode(text)
    assert ids == reference.encode_ordinary(text) and own.decode(ids) == text.encode()


def test_long_pieces(reference):
    own = bpe.encoder(BYTES, P.PATTERN)
    for text in ("a" * 30_000, " " * 30_000, "the" * 9000, "ab" * 5000 + "é" * 999):
        assert own.encode(text) == reference.encode_ordinary(text)


def merged(ranks, data):
    parts = [bytes([b]) for b in data]
    while True:
        options = [(ranks[parts[i] + parts[i + 1]], i) for i in range(len(parts) - 1) if parts[i] + parts[i + 1] in ranks]
        if not options:
            return [ranks[p] for p in parts]
        i = min(options)[1]
        parts[i : i + 2] = [parts[i] + parts[i + 1]]


def merge_pair(line, pair):
    out, i = [], 0
    while i < len(line):
        both = tuple(line[i : i + 2]) == pair
        out.append(pair[0] + pair[1] if both else line[i])
        i += 2 if both else 1
    return out


@settings(max_examples=60, deadline=None)
@given(st.integers(0, 10**6), st.lists(st.binary(max_size=30), max_size=5))
def test_any_ranks(seed, data):
    """Ranks trained on random strings: the encoding is what merging gives, ties and overlaps included."""
    rnd = random.Random(seed)
    ranks = {bytes([b]): b for b in range(256)}
    letters = b"ab" if seed % 2 else b"abc"
    corpus = [[bytes([rnd.choice(letters)]) for _ in range(60)] for _ in range(4)]
    for _ in range(30):
        counts = Counter(pair for line in corpus for pair in zip(line[:-1], line[1:], strict=True))
        if not counts:
            break
        pair = min(counts, key=lambda p: (-counts[p], p))
        ranks.setdefault(pair[0] + pair[1], len(ranks))
        corpus = [merge_pair(line, pair) for line in corpus]
    own = bpe.BytePairEncoder(ranks, ".+")
    for piece in [*data, *(bytes(rnd.choice(letters) for _ in range(rnd.randint(1, 40))) for _ in range(20))]:
        whole = [ranks[piece]] if piece in ranks else merged(ranks, piece)
        assert own.encode_piece(piece) == (whole if piece else [])


def test_round_trip(docs, reference):
    want = Counter()
    for doc_id, text in texts_of(docs):
        ids = reference.encode_ordinary(text or "")
        want[(doc_id, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((text or "").encode()).hexdigest())] += 1
    assert Counter(map(tuple, bpe.round_trip(docs, BYTES, P.PATTERN).collect())) == want
    assert bpe.round_trip(docs.limit(0), BYTES, P.PATTERN).count() == 0
    some = bpe.encode(docs, BYTES, P.PATTERN).where("doc_id = 36").first()
    assert some.ids == reference.encode_ordinary("a") and some["group"] == 1


def test_ranks_file(tmp_path):
    (tmp_path / "r").write_text("\n".join(f"{base64.b64encode(bytes([b])).decode()} {b}" for b in range(256)) + "\n")
    assert bpe.read_ranks(str(tmp_path / "r"))[b"a"] == 97


# --- words, packing, token files -----------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(WORD)


@settings(max_examples=300, deadline=None)
@given(st.lists(SOME_TEXT | st.just("<|endoftext|> x <|ENDOFTEXT|>") | st.just("Don't it's 'LL wow!!! x's... a-b c--- 'd' e'"), max_size=4))
def test_parts_are_the_library_s(library, texts):
    got = [words.part_encoder(WORD).encode(t) for t in texts]
    assert [np.frombuffer(x, dtype="<u4").tolist() for x in got] == [library.encode(t, add_special_tokens=False).ids for t in texts]


def test_table_of_parts_is_bounded(library, monkeypatch):
    monkeypatch.setattr(words, "CACHED_PARTS", 50)
    own, rnd = words.PartEncoder(WORD), random.Random(2)
    for _ in range(20):
        text = prose(rnd, 30) + " " + "y" * 100
        assert np.frombuffer(own.encode(text), dtype="<u4").tolist() == library.encode(text, add_special_tokens=False).ids
        assert len(own) <= 50 and "y" * 100 not in own


def test_other_vocabularies_are_refused():
    with pytest.raises(ValueError, match="independently"):
        words.check_independent(P.path("byte_bpe_50k.json"))


def test_narrow_ids():
    for ids in ([], [1, 65535], [70_000, 3]):
        raw = np.array(ids, dtype="<u4").tobytes()
        assert words.widened(words.narrow(raw)).tolist() == ids


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(1, 20), max_size=60))
def test_first_fit_decreasing(lengths):
    bins = []
    for i in sorted(range(len(lengths)), key=lambda i: -lengths[i]):
        for b in bins:
            if sum(lengths[j] for j in b) + lengths[i] <= 20:
                b.append(i)
                break
        else:
            bins.append([i])
    assert packing.first_fit_decreasing(lengths, 20) == bins


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(1, 20), max_size=60))
def test_groups_lose_nothing_and_pad_little(lengths):
    bins = packing.pack_group(lengths, 20)
    covered = defaultdict(list)
    for b in bins:
        assert 0 < sum(n for _, _, n in b) <= 20
        for item, start, n in b:
            covered[item] += range(start, start + n)
    assert {i: sorted(c) for i, c in covered.items()} == {i: list(range(n)) for i, n in enumerate(lengths)}
    assert 20 * len(bins) - sum(lengths) < 20 or len(bins) == 1 or 20 * (len(bins) - 1) < sum(lengths)


def test_packing(spark, docs, library):
    pieces = packing.pack(docs, WORD, group_size=8).collect()
    want = Counter()
    for doc_id, text in texts_of(docs):
        want[(doc_id, tuple([*library.encode(text or "", add_special_tokens=False).ids, 1]))] += 1
    ids = {k[0]: k[1] for k in want}
    got, sequences = defaultdict(Counter), defaultdict(list)
    for p in pieces:
        part = np.array(ids[p.doc_id][p.start : p.start + p.length], dtype="<u4")
        assert zlib.crc32(part.tobytes()) == p.ids_crc32 and p.doc_tokens == len(ids[p.doc_id]) and p.length > 0
        got[p.doc_id].update(range(p.start, p.start + p.length))
        sequences[p.sequence_id].append((p.offset, p.length))
    times = Counter(doc_id for doc_id, _ in want.elements())
    assert all(got[d] == Counter({i: times[d] for i in range(len(ids[d]))}) for d in ids)
    for parts in sequences.values():
        at = 0
        for offset, n in sorted(parts):
            assert offset == at
            at += n
        assert at <= 2048
    assert packing.pack(docs.limit(0), WORD).count() == 0


def test_token_files(spark, docs, library):
    target = scratch_path(spark, "tokens")
    token_files.write_tokens(docs, target, WORD, buckets=4)
    stored = token_files.read_tokens(spark, target)
    got = sorted((tuple(r) for r in token_files.digests(stored).collect()), key=lambda r: r[1])
    want, start = [], 0
    for doc_id, text in in_order(texts_of(docs)):
        ids = np.array([*library.encode(text or "", add_special_tokens=False).ids, 2], dtype="<u4")
        want.append((doc_id, start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    assert [r[:3] for r in got] == [w[:3] for w in want] or sorted(r[1:3] for r in got) == sorted(w[1:3] for w in want)
    assert Counter((r[0], r[2], r[3]) for r in got) == Counter((w[0], w[2], w[3]) for w in want)
    (one,) = stored.where("doc_id = 36").collect()
    assert one.ids == [*library.encode("a", add_special_tokens=False).ids, 2]


def test_token_files_have_their_indexes(spark, docs):
    import glob

    from pyarrow import orc

    target = scratch_path(spark, "tokens")
    token_files.write_tokens(docs, target, WORD, buckets=2)
    files = sorted(glob.glob(target.removeprefix("file://") + "/*.orc"))
    assert files and orc.ORCFile(files[0]).compression == "ZSTD" and orc.ORCFile(files[0]).row_index_stride == 1000
    assert orc.ORCFile(files[0]).stripe_statistics_length > 0
    plan = token_files.read_tokens(spark, target).where("doc_id = 3")._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(doc_id,3)" in plan
    token_files.write_tokens(docs.limit(0), target + "-none", WORD)
    assert token_files.read_tokens(spark, target + "-none").count() == 0


def test_schema_has_clashing_names():
    assert all(name in SCHEMA for name in ("fingerprint", "group", "value", "path", "row_id")) and len(list(combinations("abc", 2))) == 3
