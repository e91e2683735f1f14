"""Operator 2, byte-level BPE: exact encoding by ranks in linear time, and decoding.

The bytes of a piece are mapped to Latin-1, one character a byte, so that a pyahocorasick automaton over the
vocabulary finds every token's occurrences in one pass. Encoding starts from the longest match, steps back to
shorter ones where neighbours aren't compatible, and never tries a boundary again that has failed; so each byte
is left behind once. Two neighbours are compatible if merging by rank would leave exactly this boundary between
them, which is decided by undoing merges and memoised. The result equals merging lowest ranks first.

Null and empty texts give no ids; texts are never cut. Other columns are ignored. Equal rows give equal rows.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterable, Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


#: Pieces kept with their ids in one Python worker, pairs with their compatibility, and the longest piece kept.
CACHED_PIECES, CACHED_PAIRS, CACHED_CHARS = 400_000, 1_000_000, 48


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines) if token}


class BytePairEncoder:
    """Ids of text by a table of ranks, as training gives it: every single byte has one, and longer tokens come after
    what they are merged from. A token that merging can't reach only stands for a piece that is just this token."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        import ahocorasick
        import regex

        self.pieces = regex.compile(pattern).findall
        self.ranks = ranks
        self.bytes_of = {rank: token for token, rank in ranks.items()}
        self.automaton = ahocorasick.Automaton()
        for token, rank in ranks.items():
            self.automaton.add_word(token.decode("latin-1"), (len(token), rank))
        self.automaton.make_automaton()
        self.parts: dict[int, tuple[int, int] | None] = {}
        self.pairs: dict[tuple[int, int], bool] = {}
        self.known: dict[str, tuple[int, ...]] = {}

    def _merged(self, data: bytes, below: float = float("inf")) -> list[bytes]:
        """Merging of the lowest rank first, as far as ranks under ``below`` go. Only for single tokens."""
        parts = [data[i : i + 1] for i in range(len(data))]
        while len(parts) > 1:
            rank, i = min((self.ranks.get(parts[i] + parts[i + 1], below), i) for i in range(len(parts) - 1))
            if rank >= below:
                break
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
        return parts

    def _split(self, token: int) -> tuple[int, int] | None:
        """The two tokens whose merge makes this one; None for a single byte, or if no merge does."""
        if token not in self.parts:
            halves = self._merged(self.bytes_of[token], token)
            self.parts[token] = (self.ranks[halves[0]], self.ranks[halves[1]]) if len(halves) == 2 else None
        return self.parts[token]

    def _compatible(self, left: int, right: int) -> bool:
        """Whether no merge would cross the boundary between them before both are complete.

        The later made of the two is taken apart, again and again, towards the boundary: had its part met the other
        side earlier and formed a token of lower rank than the merges undone so far, that merge would have won. At
        equal ranks the one further left wins.
        """
        key = (left, right)
        if key not in self.pairs:
            if len(self.pairs) >= CACHED_PAIRS:
                self.pairs.clear()
            self.pairs[key] = self._boundary_holds(left, right)
        return self.pairs[key]

    def _boundary_holds(self, left: int, right: int) -> bool:
        ranks, bytes_of = self.ranks, self.bytes_of
        limit = float("inf")  # merges of this rank or more come too late to cross the boundary
        while True:
            if ranks.get(bytes_of[left] + bytes_of[right], limit) < limit:
                return False
            # undo the later of the merges that made the two sides; a byte was there from the start
            a, b = self._split(left), self._split(right)
            if a is None and b is None:
                return True
            if b is None or a is not None and left > right:
                limit, left = left, a[1]
            elif a is None or right > left:
                limit, right = right + 1, b[0]
            else:  # the same token on both sides: the left one was made first
                limit, right = right + 1, b[0]

    def encode_piece(self, piece: bytes) -> list[int]:
        if not piece:
            return []
        if piece in self.ranks:
            return [self.ranks[piece]]
        n = len(piece)
        at: list[list[tuple[int, int]]] = [[] for _ in range(n)]  # tokens that start here, by length
        for end, found in self.automaton.iter(piece.decode("latin-1")):
            at[end + 1 - found[0]].append(found)
        open_ = bytearray(b"\1" * (n + 1))
        ids: list[int] = []
        tried: list[int] = []  # for each id, which of the tokens at its start it is
        pos, k = 0, len(at[0]) - 1
        while pos < n:
            while k >= 0:
                length, token = at[pos][k]
                # tokens that no merge makes only stand for a whole piece
                if open_[pos + length] and (length == 1 or self._split(token)) and (not ids or self._compatible(ids[-1], token)):
                    break
                k -= 1
            if k >= 0:
                ids.append(token)
                tried.append(k)
                pos += length
                k = len(at[pos]) - 1 if pos < n else 0
            else:
                open_[pos] = 0
                if not ids:
                    raise ValueError("the ranks lack a byte of the text")
                k = tried.pop()
                pos -= len(self.bytes_of[ids.pop()])
                k -= 1
        return ids

    def encode(self, text: str) -> list[int]:
        ids: list[int] = []
        known = self.known
        for piece in self.pieces(text):
            found = known.get(piece)
            if found is None:
                found = tuple(self.encode_piece(piece.encode("utf-8", "surrogatepass")))
                if len(piece) <= CACHED_CHARS:
                    if len(known) >= CACHED_PIECES:
                        known.clear()
                    known[piece] = found
            ids += found
        return ids

    def decode(self, ids: Iterable[int]) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, ids))


@lru_cache(maxsize=2)
def encoder(path: str, pattern: str) -> BytePairEncoder:
    """One for each Python worker and vocabulary."""
    return BytePairEncoder(read_ranks(path), pattern)


def encode(df: DataFrame, path: str, pattern: str, text: str = "text", out: str = "ids") -> DataFrame:
    """``df`` with the ids of column ``text`` (null: no ids) as an array of ints."""

    @F.pandas_udf("array<int>")
    def of(column):
        import pandas as pd

        own = encoder(path, pattern)
        return pd.Series([own.encode(x) if isinstance(x, str) else [] for x in column], dtype=object)

    return df.withColumn(out, of(F.col(text)))


def round_trip(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """For each row of (doc_id, text): the number of ids, and digests of the ids and of the bytes decoded from them.

    No shuffle: each task encodes what it reads. Memory: one text, its ids, and the bounded caches.
    """

    def digests(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(path, pattern)
        for batch in batches:
            counts, by_ids, by_bytes = [], [], []
            for text in batch.column("text"):
                ids = own.encode(text.as_py() or "")
                counts.append(len(ids))
                by_ids.append(hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest())
                by_bytes.append(hashlib.sha256(own.decode(ids)).hexdigest())
            yield pa.record_batch([batch.column("doc_id"), pa.array(counts, pa.int64()), pa.array(by_ids, pa.string()), pa.array(by_bytes, pa.string())], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(digests, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
