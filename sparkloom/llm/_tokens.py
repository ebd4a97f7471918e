"""Exact byte-level BPE encoding of whole texts.

The pre-tokenizer of byte-level vocabularies never joins a character that is
not white space with a blank after it, so a long text may be cut before any
blank between two characters that are not white space, and its segments
encoded one by one. Segments of Latin script are encoded by tiktoken from the
ranks of the same vocabulary file (about three times faster, the same ids),
all others by tokenizers.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import tiktoken
from tokenizers import Tokenizer

from ._bytes import give_back

#: Fixed value: the pattern by which byte-level vocabularies of this kind cut texts.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

#: Where any text may be cut.
_SAFE = re.compile(r"(?<=\S)(?= \S)")
#: Texts with other characters are left to the library, as Unicode tables differ in age.
_PLAIN = re.compile(r"[^\t\n\r -~\xa1-ɏ]").search
#: Texts of over twice so many characters are encoded in segments.
SEGMENT = 1 << 18


def pack_ids(ids: list[int]) -> bytes:
    return np.asarray(ids, dtype="<u4").tobytes()


def byte_letters() -> dict[int, str]:
    """The letter that stands for each byte in byte-level vocabularies: itself if
    it can be printed, else the next letter from 256 on."""
    shown = {*range(33, 127), *range(161, 173), *range(174, 256)}
    rest = iter(range(256, 512))
    return {b: chr(b if b in shown else next(rest)) for b in range(256)}


def _ranks(path: str) -> dict[bytes, int]:
    """The vocabulary's tokens as bytes. Ids must follow the order of the merges,
    so that the lowest id is the first merge."""
    with open(path, encoding="utf-8") as f:
        model = json.load(f)["model"]
    back = {letter: b for b, letter in byte_letters().items()}
    pairs = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
    made = [model["vocab"]["".join(m)] for m in pairs]
    if made != sorted(made):
        raise ValueError(f"{path}: ids don't follow the order of the merges")
    return {bytes(back[x] for x in token): i for token, i in model["vocab"].items() if all(x in back for x in token)}


class PieceEncoder:
    """Token counts or ids of whole texts."""

    def __init__(self, path: str, lengths_only: bool):
        self.tokenizer = Tokenizer.from_file(path)
        self.special = {t.content: i for i, t in self.tokenizer.get_added_tokens_decoder().items()}
        self.lengths_only = lengths_only
        self.join = sum if lengths_only else b"".join
        # a special token that is never allowed, so all text is ordinary
        self.fast = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=_ranks(path), special_tokens={"\0never\0": (1 << 31) - 1})
        self.none: set[str] = set()

    def _segment(self, text: str):
        if _PLAIN(text) is None:
            ids = bytes(self.fast._core_bpe.encode_to_tiktoken_buffer(text, self.none))
            return len(ids) // 4 if self.lengths_only else ids
        ids = self.tokenizer.encode(text, add_special_tokens=False).ids
        return len(ids) if self.lengths_only else pack_ids(ids)

    def encode(self, text: str):
        """The token count of a text, or its ids as little-endian numbers of 4 bytes."""
        for mark, number in self.special.items():
            if mark in text:
                one = 1 if self.lengths_only else pack_ids([number])
                parts = [self.encode(x) for x in text.split(mark)]
                return self.join([parts[0], *(y for x in parts[1:] for y in (one, x))])
        if len(text) <= 2 * SEGMENT:
            return self._segment(text)
        out, at = [], 0
        while at < len(text):
            cut = _SAFE.search(text, at + SEGMENT)
            end = cut.start() if cut else len(text)
            out.append(self._segment(text[at:end]))
            at = end
        return self.join(out)

    def lengths(self, texts: list[str]) -> list[int]:
        """The token counts of a batch: one call for all short texts of Latin
        script and one for the other short texts; the rest one by one."""
        out = [0] * len(texts)
        plain, other = [], []
        for k, text in enumerate(texts):
            if len(text) > 2 * SEGMENT or any(mark in text for mark in self.special):
                out[k] = self.encode(text)
            else:
                (plain if _PLAIN(text) is None else other).append(k)
        for k, ids in zip(plain, self.fast.encode_ordinary_batch([texts[k] for k in plain], num_threads=1)):
            out[k] = len(ids)
        for k, found in zip(other, self.tokenizer.encode_batch_fast([texts[k] for k in other], add_special_tokens=False)):
            out[k] = len(found.ids)
        return out


@lru_cache(maxsize=4)
def encoder(path: str, lengths_only: bool) -> PieceEncoder:
    """One encoder for each Python worker, kept from task to task."""
    return PieceEncoder(path, lengths_only)


def by_bytes(batches: Iterator[pa.RecordBatch], column: str, most: int = 1 << 18) -> Iterator[pa.RecordBatch]:
    """Cut batches so that each has about ``most`` bytes of text, or one long row."""
    for batch in batches:
        if not batch.num_rows:
            continue
        sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
        group = (np.cumsum(sizes, dtype=np.int64) - sizes) // most
        edges = np.flatnonzero(np.diff(group, prepend=-1)).tolist() + [batch.num_rows]
        for a, b in zip(edges, edges[1:]):
            yield batch.slice(a, b - a)
    give_back()
