"""A wavelet matrix of token ids as one compressed, self-contained file.

The ids' bits are stored plane by plane, highest first; after each plane the sequence is
parted stably into zeros and ones. A plane is cut into chunks that are compressed one by
one, with the number of ones before each, so a lookup inflates only the chunks on its way.

Layout (little-endian): magic, then a JSON header of `head` bytes (uint32) with n, levels,
zeros per plane and chunk sizes; then the documents' ids and token starts, and the chunks.
"""

from __future__ import annotations

import json
import struct
from functools import lru_cache

import numpy as np
import zstandard

MAGIC = b"DKWM0001"
#: Bytes of one chunk of a plane before compression.
CHUNK = 1 << 15


def build(tokens: np.ndarray, doc_ids: np.ndarray, starts: np.ndarray, vocabulary: int) -> bytes:
    """tokens: ids of all documents in order. starts: each document's first token, plus the end."""
    levels = max(1, int(vocabulary - 1).bit_length())
    kind = np.uint16 if levels <= 16 else np.uint32
    now = np.ascontiguousarray(tokens, dtype=kind)
    if len(now) and int(now.max()) >= 1 << levels:
        raise ValueError("a token id is outside the vocabulary")
    pack = zstandard.ZstdCompressor(level=1)
    zeros, sizes, ones, body = [], [], [], []
    for level in range(levels):
        bits = (now & kind(1 << (levels - 1 - level))).astype(bool)
        raw = np.packbits(bits, bitorder="little").tobytes()
        chunks = [raw[i : i + CHUNK] for i in range(0, len(raw), CHUNK)]
        before, total = [], 0
        for c in chunks:
            before.append(total)
            total += int.from_bytes(c, "little").bit_count()
        packed = [pack.compress(c) for c in chunks]
        body += packed
        sizes.append([len(c) for c in packed])
        ones.append(before)
        zeros.append(len(now) - total)
        now = np.concatenate((now.take(np.flatnonzero(~bits)), now.take(np.flatnonzero(bits))))  # much faster than masks
    index = pack.compress(np.diff(doc_ids, prepend=0).astype("<i8").tobytes()), pack.compress(np.diff(starts, prepend=0).astype("<i8").tobytes())
    head = json.dumps({"n": len(tokens), "docs": len(doc_ids), "levels": levels, "zeros": zeros, "ones": ones, "sizes": sizes, "index": [len(x) for x in index]}).encode()
    return b"".join((MAGIC, struct.pack("<I", len(head)), head, *index, *body))


class WaveletFile:
    """Reads one file: access, counting and occurrence lookup without inflating all of it."""

    def __init__(self, payload: bytes):
        if payload[:8] != MAGIC:
            raise ValueError("not a wavelet file")
        size = struct.unpack_from("<I", payload, 8)[0]
        head = json.loads(payload[12 : 12 + size])
        self.n, self.levels, self.zeros, self.ones = head["n"], head["levels"], head["zeros"], head["ones"]
        inflate, at = zstandard.ZstdDecompressor(), 12 + size
        index = []
        for length in head["index"]:
            index.append(np.cumsum(np.frombuffer(inflate.decompress(payload[at : at + length]), "<i8")))
            at += length
        self.doc_ids, self.starts = index
        self._where: list[list[tuple[int, int]]] = []
        for sizes in head["sizes"]:
            self._where.append([])
            for length in sizes:
                self._where[-1].append((at, length))
                at += length
        self._payload, self._inflate = payload, inflate
        self._chunk = lru_cache(maxsize=256)(self._read_chunk)

    def _read_chunk(self, level: int, k: int) -> bytes:
        at, length = self._where[level][k]
        return self._inflate.decompress(self._payload[at : at + length])

    def _bit(self, level: int, i: int) -> int:
        return self._chunk(level, i // (8 * CHUNK))[i // 8 % CHUNK] >> (i % 8) & 1

    def _ones(self, level: int, i: int) -> int:
        """Ones among the first i bits of a plane."""
        if i <= 0:
            return 0
        k, rest = divmod(i, 8 * CHUNK)
        if k == len(self._where[level]):
            return self.n - self.zeros[level]
        whole, odd = divmod(rest, 8)
        chunk = self._chunk(level, k)
        more = int.from_bytes(chunk[:whole], "little").bit_count()
        return self.ones[level][k] + more + (chunk[whole] & ((1 << odd) - 1)).bit_count() if odd else self.ones[level][k] + more

    def _select(self, level: int, bit: int, rank: int) -> int:
        """Position of the rank-th (0-based) given bit of a plane."""
        low, high = 0, self.n
        while low < high:
            mid = (low + high) // 2
            ones = self._ones(level, mid + 1)
            if (ones if bit else mid + 1 - ones) > rank:
                high = mid
            else:
                low = mid + 1
        return low

    def access(self, i: int) -> int:
        """The token at position i."""
        if not 0 <= i < self.n:
            raise IndexError(i)
        value = 0
        for level in range(self.levels):
            bit, ones = self._bit(level, i), self._ones(level, i)
            value = value << 1 | bit
            i = self.zeros[level] + ones if bit else i - ones
        return value

    def _span(self, token: int, begin: int, end: int) -> tuple[int, int]:
        if token < 0 or token >> self.levels:
            return 0, 0
        for level in range(self.levels):
            a, b = self._ones(level, begin), self._ones(level, end)
            begin, end = (self.zeros[level] + a, self.zeros[level] + b) if token >> (self.levels - 1 - level) & 1 else (begin - a, end - b)
        return begin, end

    def count(self, token: int, begin: int = 0, end: int | None = None) -> int:
        """How often token stands in positions begin to end."""
        a, b = self._span(token, begin, self.n if end is None else end)
        return b - a

    def occurrence(self, token: int, k: int) -> int:
        """Position of the k-th (0-based) occurrence of token."""
        a, b = self._span(token, 0, self.n)
        if not 0 <= k < b - a:
            raise IndexError(k)
        at = a + k
        for level in reversed(range(self.levels)):
            bit = token >> (self.levels - 1 - level) & 1
            at = self._select(level, bit, at - self.zeros[level] if bit else at)
        return at

    def occurrences(self, token: int) -> list[int]:
        return [self.occurrence(token, k) for k in range(self.count(token))]

    def tokens(self) -> np.ndarray:
        """All tokens in order: the planes are merged again from the last to the first."""
        kind = np.uint16 if self.levels <= 16 else np.uint32
        now = np.zeros(self.n, kind)
        for level in reversed(range(self.levels)):
            raw = b"".join(self._read_chunk(level, k) for k in range(len(self._where[level])))
            bits = np.unpackbits(np.frombuffer(raw, np.uint8), count=self.n, bitorder="little").view(bool)
            back = np.empty(self.n, kind)
            back[np.flatnonzero(~bits)] = now[: self.zeros[level]]
            back[np.flatnonzero(bits)] = now[self.zeros[level] :] | kind(1 << (self.levels - 1 - level))
            now = back
        return now
