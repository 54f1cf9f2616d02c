"""Token ids of whole texts, with a bounded word memory in front of the tokenizer.

A byte-level BPE vocabulary without a normaliser splits a text wherever a blank
(space or line feed) follows another character, so each "blanks + word" chunk has
the same ids in any text. Chunks are found and hashed for a whole slice at once
and only new ones go to the tokenizer. A chunk counts as known only if its content
is: up to 15 bytes and their number are compared themselves, and of longer chunks
128 bits of BLAKE2. Texts with other white space, or with a
special token's string, are encoded whole.
"""

from __future__ import annotations

import functools
import os
import re
from hashlib import blake2b
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa

from .words import Slice, mix, slices

#: Chunks remembered by one Python worker; further ones are encoded again each time.
MEMORY = 600_000
_ODD = np.zeros(256, bool)
_ODD[[9, 11, 12, 13, 28, 29, 30, 31, 0x3C, 0xC2, 0xE1, 0xE2, 0xE3]] = True
_ALONE = re.compile(rb"[\t\x0b-\r\x1c-\x1f]|\xc2[\x85\xa0]|\xe1\x9a\x80|\xe2\x80[\x80-\x8a\xa8\xa9\xaf]|\xe2\x81\x9f|\xe3\x80\x80|<\|")
_BLANK = np.zeros(256, bool)
_BLANK[[10, 32]] = True


class Ids(NamedTuple):
    """Ids of a slice's rows, one after the other, and each row's bounds."""

    first: int
    flat: np.ndarray
    bounds: np.ndarray


def tokenizer_path(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def ragged(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Indices start, start + 1, ... of all runs, concatenated."""
    ends = np.cumsum(lengths)
    total = int(ends[-1]) if len(ends) else 0
    return np.repeat(starts - (ends - lengths), lengths) + np.arange(total)


def contents(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Two 64-bit numbers that stand for each ``buf[start:end]``: its bytes and their number up to 15, else its digest with the last byte set."""
    size = ends - starts
    eight = np.ndarray(len(buf) + 9, "<u8", np.append(buf, np.zeros(16, np.uint8)), strides=(1,))
    tail = np.array([2 ** (8 * k) - 1 for k in range(8)] + [2**64 - 1], np.uint64)
    out = np.empty((2, len(starts)), np.uint64)
    out[0] = eight[starts] & tail[np.minimum(size, 8)]
    out[1] = eight[np.minimum(starts + 8, len(buf))] & tail[np.clip(size - 8, 0, 7)]
    out[1] |= size.astype(np.uint64) << np.uint64(56)
    for i in np.flatnonzero(size > 15).tolist():
        digest = np.frombuffer(blake2b(buf[starts[i] : ends[i]], digest_size=16).digest(), "<u8")
        out[0, i], out[1, i] = digest[0], digest[1] | np.uint64(0xFF << 56)
    return out


def distinct(content: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Class number of each column of ``content``, and the first column of each class."""
    inverse, keys = pd.factorize(mix(content[0] + mix(content[1])))
    first = np.empty(len(keys), np.int64)
    first[inverse[::-1]] = np.arange(len(inverse) - 1, -1, -1)
    if (content[:, first[inverse]] != content).any():  # two contents under one hash
        _, first, inverse = np.unique(content, axis=1, return_index=True, return_inverse=True)
    return inverse.ravel(), first


class Encoder:
    def __init__(self, path: str, memory: int = MEMORY):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.memory = memory
        self.feed = np.array(self.encode("\n"), np.int32)
        self.number: dict[int, int] = {}  # by hash of the content, which is compared
        self.content = np.zeros((2, 1 << 18), np.uint64)
        self.ids = np.zeros(1 << 20, np.int32)
        self.at = np.zeros(1 << 18, np.int64)
        self.length = np.zeros(1 << 18, np.int64)
        self.used = 0

    def encode(self, text: str) -> list[int]:
        return self.tokenizer.encode(text, add_special_tokens=False).ids

    def _new(self, chunks: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids and lengths of chunks of a space and a word, joined by line feeds (which split, and are no part of words)."""
        texts = [b"\n".join(chunks[i : i + 1000]).decode("utf-8") for i in range(0, len(chunks), 1000)]
        encoded = self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)
        ids = np.concatenate([x for e in encoded for x in (np.array(e.ids, np.int32), self.feed)])
        feeds = np.flatnonzero(ids == self.feed[0])
        return ids[ids != self.feed[0]], np.diff(feeds, prepend=-1) - 1

    def _store(self, ids: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """Append to the table; the numbers of the new entries."""
        n, at = len(lengths), int(self.at[self.used - 1] + self.length[self.used - 1]) if self.used else 0
        while at + len(ids) > len(self.ids):
            self.ids = np.concatenate([self.ids, np.zeros_like(self.ids)])
        while self.used + n > len(self.at):
            self.at, self.length, self.content = (np.concatenate([x, np.zeros_like(x)], axis=-1) for x in (self.at, self.length, self.content))
        self.ids[at : at + len(ids)] = ids
        self.at[self.used : self.used + n] = at + np.cumsum(lengths) - lengths
        self.length[self.used : self.used + n] = lengths
        self.used += n
        return np.arange(self.used - n, self.used)

    def slice_ids(self, part: Slice) -> Ids:
        buf, offsets = part.buf, part.offsets
        if not len(buf):
            return Ids(part.first, np.zeros(0, np.int32), np.zeros(part.n + 1, np.int64))
        blank = _BLANK[buf]
        begin = np.zeros(len(buf), bool)
        begin[1:] = blank[1:] & ~blank[:-1]
        begin[offsets[:-1][offsets[:-1] < len(buf)]] = True
        starts = np.flatnonzero(begin)
        ends = np.append(starts[1:], len(buf))
        content = contents(buf, starts, ends)
        inverse, first = distinct(content)
        own = content[:, first]
        keys = mix(own[0] + mix(own[1])).tolist()
        get = self.number.get
        numbers = np.fromiter((get(k, -1) for k in keys), np.int64, len(keys))
        strange = (numbers >= 0) & (self.content[:, numbers] != own).any(axis=0)  # another content under the hash
        numbers[strange] = -1
        kept_used = self.used
        missing = np.flatnonzero(numbers < 0)
        if len(missing):
            raw = buf.tobytes()
            found = first[missing]
            chunks = [raw[starts[i] : ends[i]] for i in found.tolist()]
            joinable = np.array([c[0] == 32 and len(c) > 1 and c[1] not in b" \n" and c[-1] not in b" \n" for c in chunks], bool)
            simple = np.flatnonzero(joinable)
            if len(simple):
                numbers[missing[simple]] = self._store(*self._new([chunks[i] for i in simple.tolist()]))
            if len(other := np.flatnonzero(~joinable)):
                encoded = self.tokenizer.encode_batch_fast([chunks[i].decode("utf-8") for i in other.tolist()], add_special_tokens=False)
                ids = [e.ids for e in encoded]
                numbers[missing[other]] = self._store(np.concatenate([np.array(x, np.int32) for x in ids]), np.array([len(x) for x in ids]))
            if self.used <= self.memory:
                self.content[:, numbers[missing]] = own[:, missing]
                self.number.update((keys[i], n) for i, n in zip(missing.tolist(), numbers[missing].tolist(), strict=True) if not strange[i])
                kept_used = self.used
        numbers = numbers[inverse]
        lengths = self.length[numbers]
        flat = self.ids[ragged(self.at[numbers], lengths)]
        bounds = np.concatenate([[0], np.cumsum(lengths)])[np.searchsorted(starts, offsets)]
        self.used = kept_used
        return self._alone(part, flat, bounds)

    def _alone(self, part: Slice, flat: np.ndarray, bounds: np.ndarray) -> Ids:
        """Encode whole those texts that chunks cannot stand for."""
        odd = np.flatnonzero(_ODD[part.buf])
        rows = np.unique(np.searchsorted(part.offsets, odd, "right") - 1)
        texts = {}
        for r in rows.tolist():
            raw = part.buf[part.offsets[r] : part.offsets[r + 1]].tobytes()
            if _ALONE.search(raw):
                texts[r] = np.array(self.encode(raw.decode("utf-8")), np.int32)
        if not texts:
            return Ids(part.first, flat, bounds)
        rows = [texts.get(r, flat[bounds[r] : bounds[r + 1]]) for r in range(part.n)]
        return Ids(part.first, np.concatenate(rows), np.concatenate([[0], np.cumsum([len(x) for x in rows])]))


@functools.lru_cache(maxsize=4)
def encoder(path: str) -> Encoder:
    """One encoder for each worker process and vocabulary file."""
    return Encoder(path)


def batch_ids(column: pa.Array, path: str, end_id: int):
    """``Ids`` of each slice of a text column, every row closed by ``end_id``."""
    own = encoder(path)
    for part in slices(column, 2 << 20):
        first, flat, bounds = own.slice_ids(part)
        yield Ids(first, np.insert(flat, bounds[1:], end_id).astype(np.int32), bounds + np.arange(len(bounds)))
