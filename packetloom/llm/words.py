"""Ids of whole texts by a `tokenizers` vocabulary whose words are independent of each other (operators 3 and 4).

Where the vocabulary drops white space and never joins across it, the ids of a text are those of its parts
between white space, one after another. The library encodes every part that a worker hasn't met;
parts met before come from a bounded table. ``check_independent`` refuses vocabularies for which that isn't known.
"""

from __future__ import annotations

import json
import os
import re
from array import array
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa

#: Parts kept in one Python worker, and the longest that is kept.
CACHED_PARTS, CACHED_CHARS = 600_000, 48

#: Python's split() takes these four for white space, the vocabulary doesn't.
_separator = re.compile("[\x1c-\x1f]").search
_split = re.compile("[ \n\r\t]+").split
_plain = re.compile("[A-Za-zÀ-ÖØ-öø-ÿ]+").fullmatch
#: A word and ASCII symbols after it, but no apostrophe, which can start a suffix that is a word.
_marked = re.compile(r"([A-Za-zÀ-ÖØ-öø-ÿ]+)([!-&(-/:-@\[-`{-~]+)").fullmatch


def check_independent(path: str) -> None:
    with open(path) as file:
        spec = json.load(file)
    steps = (spec.get("pre_tokenizer") or {}).get("pretokenizers", [])
    model, normal = spec.get("model") or {}, json.dumps(spec.get("normalizer"))
    drops = model.get("type") == "BPE" and not model.get("dropout") and '"Lowercase"' in normal and any(s["type"] == "ByteLevel" and not s["use_regex"] for s in steps) and any(s["type"] == "Split" and s["behavior"] == "Removed" and s["invert"] and r"[^\s" in s["pattern"].get("Regex", "") for s in steps)
    strips = any(t["lstrip"] or t["rstrip"] or t["single_word"] for t in spec.get("added_tokens", []))
    if not drops or strips or spec.get("post_processor") or (spec.get("truncation") or spec.get("padding")):
        raise ValueError(f"{path}: its words aren't known to be encoded independently")


class PartEncoder(dict):
    """Ids of each part as unsigned 32-bit integers, little-endian; parts that aren't there yet are encoded on the way."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer
        from tokenizers.pre_tokenizers import ByteLevel

        super().__init__()
        check_independent(path)
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        self.library = Tokenizer.from_file(path)
        self.tokenize = self.library.model.tokenize
        as_bytes = ByteLevel(add_prefix_space=False, use_regex=False).pre_tokenize_str
        #: How the library writes the bytes of each lower-case letter that _plain admits.
        self.letters = {ord(c): as_bytes(c)[0][0] for c in map(chr, range(0x61, 0x100)) if _plain(c) and c == c.lower()}

    def __missing__(self, part: str) -> bytes:
        """Words of Latin-1 letters go to the vocabulary's model, whatever their case. Symbols after such a word are a
        word of their own. All else goes through the whole library."""
        if _plain(part):
            lower = part.lower()
            ids = array("I", [t.id for t in self.tokenize(lower if lower.isascii() else lower.translate(self.letters))]).tobytes()
        elif marked := _marked(part):
            ids = self[marked[1]] + self[marked[2]]
        else:
            ids = array("I", self.library.encode(part, add_special_tokens=False).ids).tobytes()
        if len(part) <= CACHED_CHARS:
            if len(self) >= CACHED_PARTS:
                self.clear()
            self[part] = ids
        return ids

    def encode(self, text: str) -> bytes:
        """Of a whole text."""
        text = _folded(text)
        parts = text.split() if not _separator(text) else [p for p in _split(text) if p]
        return b"".join(map(self.__getitem__, parts))


def _folded(text: str) -> str:
    """Lower-cased where that can't change the ids, so that fewer parts are new: Latin-1 only, and no special token."""
    try:
        text.isascii() or text.encode("latin-1")
    except UnicodeEncodeError:
        return text
    return text if "<|" in text else text.lower()


@lru_cache(maxsize=2)
def part_encoder(path: str) -> PartEncoder:
    """One for each Python worker and vocabulary."""
    return PartEncoder(path)


def encoded(batches: Iterable[pa.RecordBatch], path: str, end: bytes, size: int = 1 << 22) -> Iterator[tuple[list, list[bytes]]]:
    """Lists of doc_id and of ids with the end id, some ``size`` bytes of whole texts' ids at a time."""
    encode = part_encoder(path).encode
    doc_ids, found, total = [], [], 0
    for batch in batches:
        for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text"), strict=True):
            doc_ids.append(doc_id)
            found.append(encode(text.as_py() or "") + end)
            total += len(found[-1])
            if total > size:
                yield doc_ids, found
                doc_ids, found, total = [], [], 0
    if doc_ids:
        yield doc_ids, found


def narrow(ids: bytes) -> bytes:
    """A width byte and the ids, in 16 bits if all fit."""
    wide = np.frombuffer(ids, dtype="<u4")
    return b"\2" + wide.astype("<u2").tobytes() if not len(wide) or wide.max() < 1 << 16 else b"\4" + ids


def widened(data: bytes) -> np.ndarray:
    return np.frombuffer(data, dtype=f"<u{data[0]}", offset=1).astype("<u4")
