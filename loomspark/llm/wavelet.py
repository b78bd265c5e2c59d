"""A wavelet matrix over token ids, and the file that holds one shard of them.

Level by level from the highest bit, a plane has one bit of every token, and the tokens then
go on in the order of that bit, zeros first. Ranks in the planes answer which token stands
at a place, how often a token occurs before a place, and where its k-th occurrence is.

A file is a header in JSON with its length before it, then zstd frames: the documents' ids,
their nulls, their token counts, and the planes. Ranks are counted anew on opening.
"""

from __future__ import annotations

import json

import numpy as np
import pyarrow as pa

from loomspark.llm.fm_index import BitRank

#: Fixed value: the first bytes of a file.
MAGIC = b"WAVEIDS1"
CODEC = "zstd"


class Plane(BitRank):
    """Bits with ranks, from packed bytes; ``select`` by binary search over the ranks."""

    def __init__(self, packed: np.ndarray, n: int):
        padded = np.zeros((n // 64 + 1) * 8, np.uint8)
        padded[: len(packed)] = packed
        self.words, self.n = padded.view(np.uint64), n
        self.before = np.concatenate(([0], np.cumsum(np.bitwise_count(self.words), dtype=np.int64)))
        self.zeros = n - int(self.before[-1])

    def select(self, bit: int, k: np.ndarray) -> np.ndarray:
        """The place of the ``k``-th (from 0) bit of this kind."""
        low, high = np.zeros_like(k), np.full_like(k, self.n)
        while (low < high).any():
            middle = (low + high) >> 1
            ones = self.ones(middle + 1)
            there = (ones if bit else middle + 1 - ones) > k
            low, high = np.where(there, low, np.minimum(middle + 1, high)), np.where(there, middle, high)
        return low


def planes_of(ids: np.ndarray, depth: int) -> list[np.ndarray]:
    """The packed bits of each level."""
    n, out = len(ids), []
    values = pa.array(ids.astype(np.uint16 if depth <= 16 else np.uint32))
    for level in range(depth - 1, -1, -1):
        bits = (values.to_numpy() >> level & 1).astype(np.uint8)
        packed = np.packbits(bits, bitorder="little")
        out.append(packed)
        if level:
            ones = pa.Array.from_buffers(pa.bool_(), n, [None, pa.py_buffer(packed)])
            zeros = pa.Array.from_buffers(pa.bool_(), n, [None, pa.py_buffer(~packed)])
            values = pa.concat_arrays([values.filter(zeros), values.filter(ones)])
    return out


class WaveletMatrix:
    """Rank and select over the ids that ``planes`` hold; places and ids may be arrays."""

    def __init__(self, planes: list[np.ndarray], n: int):
        self.packed, self.n, self.depth = planes, n, len(planes)
        self._planes: list[Plane] | None = None

    @classmethod
    def of(cls, ids: np.ndarray) -> WaveletMatrix:
        return cls(planes_of(ids, max(1, int(ids.max(initial=0)).bit_length())), len(ids))

    @property
    def planes(self) -> list[Plane]:
        if self._planes is None:
            self._planes = [Plane(p, self.n) for p in self.packed]
        return self._planes

    def access(self, at) -> np.ndarray:
        """The ids at the places."""
        at = np.atleast_1d(np.asarray(at, np.int64))
        out = np.zeros(len(at), np.int64)
        for plane in self.planes:
            one, ones = plane.get(at), plane.ones(at)
            at, out = np.where(one, plane.zeros + ones, at - ones), out * 2 + one
        return out

    def span(self, ids: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where the ids among the places from ``low`` to ``high`` are after the last level."""
        for k, plane in enumerate(self.planes):
            one = (ids >> (self.depth - 1 - k) & 1).astype(bool)
            a, b = plane.ones(low), plane.ones(high)
            low, high = np.where(one, plane.zeros + a, low - a), np.where(one, plane.zeros + b, high - b)
        absent = ids >> self.depth > 0
        return low, np.where(absent, low, high)

    def rank(self, ids, at) -> np.ndarray:
        """How often each id occurs before its place."""
        ids, at = np.broadcast_arrays(np.atleast_1d(np.asarray(ids, np.int64)), np.asarray(at, np.int64))
        low, high = self.span(ids, np.zeros(len(ids), np.int64), at.astype(np.int64))
        return high - low

    def count(self, ids) -> np.ndarray:
        return self.rank(ids, self.n)

    def select(self, token: int, k) -> np.ndarray:
        """The place of the ``k``-th (from 0) occurrence of one id; ``k`` must be below its count."""
        low, _ = self.span(np.array([token]), np.zeros(1, np.int64), np.full(1, self.n))
        at = low[0] + np.atleast_1d(np.asarray(k, np.int64))
        for level, plane in enumerate(reversed(self.planes)):
            at = plane.select(1, at - plane.zeros) if token >> level & 1 else plane.select(0, at)
        return at

    def occurrences(self, token: int) -> np.ndarray:
        """All places of an id, in order."""
        return self.select(token, np.arange(int(self.count(token)[0])))

    def ids(self) -> np.ndarray:
        """All ids, from the lowest level up."""
        out = np.zeros(self.n, np.uint16 if self.depth <= 16 else np.uint32)
        for level, packed in enumerate(reversed(self.packed)):
            bits = np.unpackbits(packed, count=self.n, bitorder="little").view(bool)
            zeros, above = self.n - int(np.count_nonzero(bits)), np.empty_like(out)
            above[~bits] = out[:zeros]
            above[bits] = out[zeros:] | out.dtype.type(1 << level)
            out = above
        return out


def packed_file(ids: np.ndarray, doc_ids: list, counts: np.ndarray) -> bytes:
    """The file of a shard: ``ids`` of documents one after the other, ``counts`` of them each."""
    matrix = WaveletMatrix.of(ids)
    nulls = np.array([d is None for d in doc_ids], bool)
    parts = [np.array([d or 0 for d in doc_ids], np.int64), np.packbits(nulls, bitorder="little"), counts.astype(np.int64), *matrix.packed]
    raw = [np.ascontiguousarray(p).tobytes() for p in parts]
    frames = [pa.compress(r, CODEC, asbytes=True) for r in raw]
    header = json.dumps({"tokens": len(ids), "documents": len(doc_ids), "raw": list(map(len, raw)), "frames": list(map(len, frames))}).encode()
    return b"".join([MAGIC, len(header).to_bytes(4, "little"), header, *frames])


class ShardFile:
    """A shard's documents and its wavelet matrix."""

    def __init__(self, data: bytes):
        if data[:8] != MAGIC:
            raise ValueError("not a file of token ids")
        at = 12 + int.from_bytes(data[8:12], "little")
        header, parts, view = json.loads(data[12:at]), [], memoryview(data)
        for raw, size in zip(header["raw"], header["frames"], strict=True):
            parts.append(np.frombuffer(pa.decompress(view[at : at + size], raw, CODEC), np.uint8))
            at += size
        n = header["documents"]
        nulls = np.unpackbits(parts[1], count=n, bitorder="little")
        self.doc_ids = [None if null else d for d, null in zip(parts[0].view(np.int64).tolist(), nulls.tolist(), strict=True)]
        self.counts = parts[2].view(np.int64)
        self.starts = np.cumsum(self.counts) - self.counts
        self.matrix = WaveletMatrix(parts[3:], header["tokens"])

    def document_of(self, places: np.ndarray) -> np.ndarray:
        """The place in the shard of the document that holds each token."""
        return np.searchsorted(self.starts + self.counts, places, "right")
