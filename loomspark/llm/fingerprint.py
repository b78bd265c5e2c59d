"""Document fingerprints from Lempel-Ziv phrases.

A text's UTF-8 bytes are parsed as in LZ78: the longest phrase already in the dictionary
plus one byte becomes a new phrase. The set of phrases, hashed, is kept as a signature of
``SLOTS`` minimum hashes (one hash function, dealt over slots; an empty slot borrows a full
one's value), of which 16 bits are written. The share of equal slots estimates
the Jaccard similarity of the phrase sets, a likeness akin to joint compression.

Parsing goes from left to right and minima combine, so a text and its edited version share
the work on their common beginning.

Defined results: a null text is empty; a text without phrases has the signature of an empty
set, which is like another empty one (1.0) and like no other (0.0); equal texts have equal
fingerprints; a single document is its own next one; rows of equal ``doc_id`` are ordered
by text; null ids come last. Extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomspark.llm.ordered import beside
from loomspark.llm.words import slices

#: Slots of a signature; a hash belongs to the slot of its upper ``SLOT_BITS`` bits.
SLOT_BITS = 7
SLOTS = 1 << SLOT_BITS
EMPTY = np.full(SLOTS, 0xFFFFFFFF, np.uint32)
#: Where an empty slot borrows its value, in order of trial: a fixed random slot each time.
BORROW = np.random.default_rng(20).integers(0, SLOTS, (256, SLOTS))

SCHEMA = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def minima(hashes: list[int]) -> np.ndarray:
    """The smallest hash of each slot, for a set of phrase hashes."""
    h = np.array(hashes, np.uint32)
    h = (h ^ (h >> np.uint32(16))) * np.uint32(0x85EBCA6B)
    h = (h ^ (h >> np.uint32(13))) * np.uint32(0xC2B2AE35)
    h ^= h >> np.uint32(16)
    h.sort()
    slots, first = np.unique(h >> np.uint32(32 - SLOT_BITS), return_index=True)
    out = EMPTY.copy()
    out[slots] = h[first]
    return out


def filled(sig: np.ndarray) -> np.ndarray:
    """``sig`` with each empty slot's value borrowed from a full slot (the same one for the same pattern)."""
    empty = np.flatnonzero(sig == EMPTY)
    if not 0 < len(empty) < SLOTS:
        return sig
    full = sig != EMPTY
    tries = full[BORROW[:, empty]]
    found = np.where(tries.any(axis=0), BORROW[tries.argmax(axis=0), empty], np.flatnonzero(full)[0])
    out = sig.copy()
    out[empty] = sig[found]
    return out


class Parser:
    """An LZ78 dictionary: phrase number by 256 * (number of its beginning) + last byte."""

    def __init__(self):
        self.children: dict[int, int] = {}
        self.hashes, self.node = [0x811C9DC5], 0

    def fork(self) -> Parser:
        other = Parser()
        other.children, other.hashes, other.node = self.children.copy(), self.hashes.copy(), self.node
        return other

    def feed(self, data: bytes) -> np.ndarray:
        """Parse on; the signature of the phrases that are new."""
        children, hashes, node = self.children, self.hashes, self.node
        get, add, old = children.get, hashes.append, len(hashes)
        for byte in data:
            edge = node << 8 | byte
            node = get(edge, 0)
            if not node:
                children[edge] = len(hashes)
                add((hashes[edge >> 8] * 0x01000193 ^ byte + 1) & 0xFFFFFFFF)
        self.node = node
        return minima(hashes[old:])


def signature(text: str) -> np.ndarray:
    return Parser().feed(text.encode())


def written(sig: np.ndarray) -> str:
    return filled(sig).astype(">u2").tobytes().hex()


def likeness(a: str, b: str) -> float:
    """The share of equal slots, 0 to 1, of two written signatures."""
    return sum(a[k : k + 4] == b[k : k + 4] for k in range(0, 4 * SLOTS, 4)) / SLOTS


def fingerprints(docs: DataFrame) -> DataFrame:
    """``doc_id, fingerprint`` of every row of ``docs`` (``doc_id``, ``text``)."""

    def printed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            prints = [written(signature(t or "")) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(prints, pa.string())], names=["doc_id", "fingerprint"])

    narrow = docs.selectExpr("cast(doc_id AS bigint) AS doc_id", "cast(text AS string) AS text")
    return narrow.mapInArrow(printed, "doc_id long, fingerprint string")


class Edited:
    """A document with its signature, ready to get the beginning of the next one as its end."""

    def __init__(self, doc_id: int | None, text: str):
        self.doc_id, self.text = doc_id, text
        self.kept = len(text) - len(text) // 3
        self.parser = Parser()
        self.begun = self.parser.feed(text[: self.kept].encode())
        self.written = written(np.minimum(self.begun, self.parser.fork().feed(text[self.kept :].encode())))

    def row(self, after: Edited) -> tuple:
        end = after.text[: len(self.text) // 3]
        edited = written(np.minimum(self.begun, self.parser.feed(end.encode())))
        digest = hashlib.sha256((self.text[: self.kept] + end).encode()).hexdigest()
        return self.doc_id, len(self.text), digest, self.written, edited, likeness(self.written, edited), likeness(self.written, after.written)


def edited_fingerprints(docs: DataFrame, blocks: int | None = None) -> DataFrame:
    """Fingerprints of every text and of its edited version, and their likeness.

    The edited text has its last third of code points replaced by the first as many of the
    next document's, in descending ``doc_id``; after the last comes the first.
    ``blocks``: into how many the ids are cut; by default some for each shuffle partition.
    """
    narrow = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    order = F.bitwise_not(F.coalesce("doc_id", F.lit(-(1 << 63))))
    placed = beside(narrow, order, blocks, cyclic=True).where("_halo >= 0").sortWithinPartitions("_block", "_halo", "_key", "text")

    def walked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, held = None, None
        for batch in slices(batches, 512):
            out = []
            for doc_id, text, own, halo in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "text", "_block", "_halo")), strict=True):
                if own != block:
                    block, held = own, None
                elif held is None:
                    continue  # more rows of the neighbour's id
                row = Edited(doc_id, text)
                if held is not None:
                    out.append(held.row(row))
                held = None if halo else row
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out, strict=True), TYPES, strict=True)], names=NAMES)

    return placed.mapInArrow(walked, SCHEMA)


NAMES = [c.split()[0] for c in SCHEMA.split(", ")]
TYPES = [{"long": pa.int64(), "string": pa.string(), "double": pa.float64()}[c.split()[1]] for c in SCHEMA.split(", ")]
