"""Periodic runs of words in every document, by a harmonic grid and prefix hashes.

A run of period ``q`` and length ``n`` is a stretch of ``n - q`` places at which the word ``q``
further on is the same. As ``n`` is at least ``max(least, powers * q)``, that stretch holds a
point of the grid of that step less ``q``, for every ``q`` that a document has room for. All
points of all periods of a batch are looked at together: those at which the two words agree
are extended both ways by binary search over prefix hashes. The stretches found are made
distinct, a stretch's smallest period is kept (any other is a multiple of it), and every
word of it, and the two beside it, are compared; if a hash was wrong, the documents are gone
through again with other hashes.

Words are numbered within a batch of documents of about ``BATCH_WORDS`` words, a longer
document alone; nothing is shuffled.

Defined results: null and empty texts have no words and no run; repeated rows are judged
each; a null doc_id is kept; other columns are ignored; words are compared byte by byte.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomspark.llm.words import slices, text_bytes

#: Words of the documents that are looked at together.
BATCH_WORDS = 1 << 16
#: Points whose words are compared at once.
POINTS = 1 << 21
#: Fixed value: the largest prime below 2**31, by which hashes are taken.
PRIME = np.uint64((1 << 31) - 1)


class PrefixHashes:
    """Two polynomial hashes of every stretch of a list of numbers, in one number of 62 bits."""

    def __init__(self, words: np.ndarray, seed: int):
        rng = np.random.default_rng(seed)
        self.parts = []
        for _ in range(2):
            base = np.uint64(rng.integers(1 << 20, 1 << 30))
            value = rng.integers(1, int(PRIME), int(words.max(initial=0)) + 1).astype(np.uint64)[words]
            power = np.ones(len(words) + 1, np.uint64)
            known = 1
            while known < len(power):  # powers of the base, twice as many each time
                step = power[known - 1] * base % PRIME
                power[known : 2 * known] = power[: min(known, len(power) - known)] * step % PRIME
                known *= 2
            sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(value * power[:-1] % PRIME) % PRIME))
            self.parts.append((power, sums))

    def same(self, at: np.ndarray, ahead: np.ndarray, length: np.ndarray) -> np.ndarray:
        """Whether the stretches of ``length`` at ``at`` and ``at + ahead`` have equal hashes."""
        out = np.ones(len(at), bool)
        for power, sums in self.parts:
            one = (sums[at + length] + PRIME - sums[at]) % PRIME * power[ahead] % PRIME
            other = (sums[at + ahead + length] + PRIME - sums[at + ahead]) % PRIME
            out &= one == other
        return out


def grid_points(first: np.ndarray, sizes: np.ndarray, least: int, powers: int) -> Iterator[tuple[np.ndarray, ...]]:
    """``doc, period, place`` of all grid points of documents that start at ``first``, some ``POINTS`` at once."""
    most = np.where(sizes >= least, sizes // powers, 0)  # periods that a document has room for
    doc = np.repeat(np.arange(len(sizes)), most)
    period = np.arange(len(doc)) - np.repeat(np.cumsum(most) - most, most) + 1
    step = np.maximum(least, powers * period) - period
    points = (sizes[doc] - period - 1) // step + 1
    ends, at = np.cumsum(points), 0
    while at < len(doc):
        stop = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + POINTS, "right")))
        n = points[at:stop]
        nth = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        row = np.repeat(np.arange(at, stop), n)
        yield doc[row], period[row], first[doc[row]] + nth * step[row]
        at = stop


def longest(hashes: PrefixHashes, at: np.ndarray, ahead: np.ndarray, room: np.ndarray, back: bool) -> np.ndarray:
    """How far the words from ``at`` on (or before it, if ``back``) agree with those ``ahead`` of them, at most ``room``."""
    low, high = np.zeros_like(room), room.copy()
    while True:
        open_ = np.flatnonzero(low < high)
        if not len(open_):
            return low
        middle = (low[open_] + high[open_] + 1) >> 1
        start = at[open_] - middle if back else at[open_]
        same = hashes.same(start, ahead[open_], middle)
        low[open_], high[open_] = np.where(same, middle, low[open_]), np.where(same, high[open_], middle - 1)


def find_runs(words: np.ndarray, sizes: np.ndarray, least: int, powers: int) -> np.ndarray:
    """Rows of ``doc, start, length, period`` of all runs of documents that lie one after the other in ``words``."""
    seed, first = 0, np.cumsum(sizes) - sizes
    while True:
        found = candidates(words, first, sizes, least, powers, PrefixHashes(words, seed))
        if checked(words, first, sizes, found):
            return found
        seed += 1


def candidates(words: np.ndarray, first: np.ndarray, sizes: np.ndarray, least: int, powers: int, hashes: PrefixHashes) -> np.ndarray:
    """Stretches as the hashes have them, each with its smallest period."""
    parts = [np.zeros((0, 4), np.int64)]
    for doc, period, at in grid_points(first, sizes, least, powers):
        hit = np.flatnonzero(words[at] == words[at + period])
        doc, period, at = doc[hit], period[hit], at[hit]
        forward = longest(hashes, at, period, first[doc] + sizes[doc] - at - period, False)
        start = at - longest(hashes, at, period, at - first[doc], True)
        length = at + forward + period - start
        keep = length >= np.maximum(least, powers * period)
        parts.append(np.unique(np.stack((doc, start - first[doc], length, period), axis=1)[keep], axis=0))
    rows = np.unique(np.concatenate(parts), axis=0)
    same = (rows[1:, :3] == rows[:-1, :3]).all(axis=1)
    return rows[np.concatenate((np.ones(min(1, len(rows)), bool), ~same))]


def checked(words: np.ndarray, first: np.ndarray, sizes: np.ndarray, rows: np.ndarray) -> bool:
    """Whether every run's words repeat and those beside it do not."""
    doc, start, length, period = rows.T
    start, stop, last = start + first[doc], start + first[doc] + length, first[doc] + sizes[doc]
    places = np.concatenate([np.arange(a, b) for a, b in zip(start, stop - period, strict=True)] or [np.zeros(0, np.int64)])
    inside = (words[places] == words[places + np.repeat(period, stop - period - start)]).all()
    before, after = np.flatnonzero(start > first[doc]), np.flatnonzero(stop < last)
    goes_on = (words[start[before] - 1] == words[start[before] - 1 + period[before]]).any() or (words[stop[after]] == words[stop[after] - period[after]]).any()
    return bool(inside) and not goes_on


def repeated_tail(words: list[bytes], doc_id: int | None) -> list[bytes]:
    """The words of a document whose number asks for it, with a tail that repeats; others as they are."""
    if doc_id is None or not words or (h := zlib.crc32(str(doc_id).encode())) % 10:
        return words
    n, g = len(words), h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    tail = words[a : a + p]
    return words[:a] + (tail * (-(-(n - a) // p)))[: n - a]


def in_batches(docs: Iterable[list[bytes]]) -> Iterator[list[list[bytes]]]:
    """The documents' words in lists of about ``BATCH_WORDS`` words."""
    held, n = [], 0
    for words in docs:
        if held and n + len(words) > BATCH_WORDS:
            yield held
            held, n = [], 0
        held.append(words)
        n += len(words)
    if held:
        yield held


def runs_of(docs: list[list[bytes]], least: int, powers: int) -> list[list[tuple[int, int, int]]]:
    """``start, length, period`` of each document's runs, by start, then period."""
    numbers: dict[bytes, int] = {}
    words = np.fromiter((numbers.setdefault(w, len(numbers)) for words in docs for w in words), np.int64)
    found: list[list[tuple[int, int, int]]] = [[] for _ in docs]
    for doc, start, length, period in find_runs(words, np.array(list(map(len, docs)), np.int64), least, powers).tolist():
        found[doc].append((start, length, period))
    return [sorted(x, key=lambda r: (r[0], r[2])) for x in found]


def collapsed(words: list[bytes], runs: list[tuple[int, int, int]]) -> list[bytes]:
    """The words without those that a run holds after its first period."""
    if not runs:
        return words
    drop = np.zeros(len(words) + 1, np.int64)
    for start, length, period in runs:
        drop[start + period] += 1
        drop[start + length] -= 1
    return [w for w, n in zip(words, np.cumsum(drop).tolist(), strict=False) if not n]


RUN = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])
SCHEMA = "doc_id long, runs array<struct<start:long,length:long,period:long>>, runs_sha256 string, collapsed string, collapsed_sha256 string"


def periodic_runs(docs: DataFrame, least: int = 6, powers: int = 4, altered=None, text: bool = True) -> DataFrame:
    """``doc_id, runs, runs_sha256, collapsed, collapsed_sha256`` of every row of ``docs`` (``doc_id``, ``text``).

    ``runs``: start, length and smallest period of every longest stretch of at least ``least``
    words and ``powers`` periods (at least 2), by start, then period. ``collapsed``: the words
    left when each run keeps its first period; null unless ``text``, as the digest is often enough.
    ``altered(words, doc_id)``, if given, says which words stand for a document's own.
    """
    if powers < 2 or least < 2:
        raise ValueError("a run has two words and two periods at least")

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 512):
            ids = batch.column("doc_id").to_pylist()
            split = [t.split() for t in text_bytes(batch.column("text"))]
            whole = [altered(w, d) for w, d in zip(split, ids, strict=True)] if altered else split
            runs = [r for part in in_batches(whole) for r in runs_of(part, least, powers)]
            kept = [b" ".join(collapsed(w, r)) for w, r in zip(whole, runs, strict=True)]
            told = ["".join("%d,%d,%d\n" % r for r in x).encode() for x in runs]
            arrays = [
                batch.column("doc_id"),
                pa.array([[{"start": s, "length": n, "period": p} for s, n, p in x] for x in runs], pa.list_(RUN)),
                pa.array([hashlib.sha256(x).hexdigest() for x in told]),
                pa.array(kept, pa.binary()).cast(pa.string()) if text else pa.nulls(len(ids), pa.string()),
                pa.array([hashlib.sha256(x).hexdigest() for x in kept]),
            ]
            yield pa.RecordBatch.from_arrays(arrays, names=["doc_id", "runs", "runs_sha256", "collapsed", "collapsed_sha256"])

    narrow = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return narrow.mapInArrow(search, SCHEMA)


def run_report(docs: DataFrame, least: int = 6, powers: int = 4, altered=None) -> DataFrame:
    """One row a document: how many runs, the longest (ties: the first, then the smallest period), and digests."""
    found = periodic_runs(docs, least, powers, altered, text=False)
    longest_first = lambda a, b: F.when(a["length"] > b["length"], -1).when(a["length"] < b["length"], 1).otherwise(0)
    first = F.array_sort("runs", lambda a, b: F.when(longest_first(a, b) != 0, longest_first(a, b)).when(a["start"] < b["start"], -1).when(a["start"] > b["start"], 1).otherwise(F.signum(a["period"] - b["period"]).cast("int")))
    best = found.withColumn("best", F.get(first, F.lit(0)))
    return best.select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        *[F.col(f"best.{c}").alias(c) for c in ("start", "length", "period")],
        F.floor(F.col("best.length") * 1000 / F.col("best.period")).cast("long").alias("exponent_milli"),
        "runs_sha256",
        "collapsed_sha256",
    )
