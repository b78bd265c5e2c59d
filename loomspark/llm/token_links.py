"""Cross-tokenizer alignment: minimal groups of tokens of two vocabularies, and counts of linked pairs.

Tokens of both vocabularies are the nodes of a graph in which two are linked where their byte
ranges overlap. Union-find over a block of documents at once (every node takes the smallest
label it can reach, by hooking and pointer jumping) gives the connected components; each is
a smallest stretch of tokens of both kinds that covers the same bytes.

How many documents hold a pair of ids linked is counted over the corpus: a block's distinct
pairs are summed in the block first, then by pair, then joined back to the blocks, one row for
each distinct pair of a block, so no pair of ids has more rows than there are blocks. A task
gathers the answers of a few blocks, however many there are. Only
one number an id of the first vocabulary is broadcast: its highest count.

Defined results: texts that are null, empty, or not given back byte for byte by both
vocabularies have no tokens, zeros and an empty string; repeated rows count as documents
each; a null doc_id is kept; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomspark.llm.library_ids import ByteLevelIds, Encoder, PieceIds, once
from loomspark.llm.tables import stored

#: Bytes of text that a block holds, unless one document has more.
BLOCK_BYTES = 1 << 20
#: Segments of each vocabulary whose ids a worker keeps.
KEPT = 1 << 18
#: Blocks that a task writes or reads at once, and whose answers it gathers: each is some MB on the heap.
GATHERED = 8
PAIR_BITS = 32


class Vocabulary:
    """An encoder with what each id stands for."""

    def __init__(self, encoder: Encoder):
        self.encoder, self.bytes = encoder, encoder.bytes_of_ids()
        self.sizes = np.array([len(b) for b in self.bytes], np.int64)

    @classmethod
    def byte_level(cls, data: bytes) -> Vocabulary:
        return cls(ByteLevelIds(data, lead=True, specials_are_text=True, most=KEPT))

    @classmethod
    def pieces(cls, data: bytes) -> Vocabulary:
        return cls(PieceIds(data, KEPT))

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids of the texts with a blank before each, how many each text has, and whether they give its bytes back."""
        ids, counts = self.encoder.encode(texts)
        ids = ids.astype(np.int64)
        exact, at, decoded = np.ones(len(texts), bool), 0, self.bytes
        for k, (text, n) in enumerate(zip(texts, counts.tolist(), strict=True)):
            exact[k] = b"".join([decoded[i] for i in ids[at : at + n].tolist()]) == (b" " + text.encode("utf-8") if text else b"")
            at += n
        return ids, counts, exact


def components(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The smallest node of each node's connected component, by union-find over the links ``a``-``b``."""
    parent = np.arange(n)
    while True:
        x, y = parent[a], parent[b]
        apart = np.flatnonzero(x != y)
        if not len(apart):
            return parent
        x, y = x[apart], y[apart]
        np.minimum.at(parent, np.maximum(x, y), np.minimum(x, y))
        while True:  # point every node to its root
            above = parent[parent]
            if (above == parent).all():
                break
            parent = above
        a, b = a[apart], b[apart]


def overlaps(starts_a: np.ndarray, ends_a: np.ndarray, starts_b: np.ndarray, ends_b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Every pair of tokens of two lists whose ranges share a byte; both lists tile the same bytes, no token is empty."""
    first = np.searchsorted(ends_b, starts_a, "right")
    n = np.searchsorted(starts_b, ends_a, "left") - first
    a = np.repeat(np.arange(len(n)), n)
    return a, np.repeat(first - (np.cumsum(n) - n), n) + np.arange(len(a))


class Block:
    """Documents one after the other: their tokens, groups, links, and distinct pairs."""

    def __init__(self, texts: list[str], first: Vocabulary, second: Vocabulary):
        a, n_a, exact = first.encode(texts)
        b, n_b, also = second.encode(texts)
        good, docs = exact & also, np.arange(len(texts))
        a, b = a[np.repeat(good, n_a)], b[np.repeat(good, n_b)]
        self.n_a, self.n_b = np.where(good, n_a, 0), np.where(good, n_b, 0)
        doc_a = np.repeat(docs, self.n_a)
        ends_a, ends_b = np.cumsum(first.sizes[a]), np.cumsum(second.sizes[b])
        link_a, link_b = overlaps(ends_a - first.sizes[a], ends_a, ends_b - second.sizes[b], ends_b)
        root = components(len(a) + len(b), link_a, link_b + len(a))
        self.a, self.b = a, b
        # a component's smallest node is its first token of the first vocabulary
        heads = np.unique(root)
        self.group_a, self.group_b = np.searchsorted(heads, root[: len(a)]), np.searchsorted(heads, root[len(a) :])
        self.n_groups = np.bincount(doc_a[heads], minlength=len(texts))
        self.n_links = np.bincount(doc_a[link_a], minlength=len(texts))
        self.pairs, pair = np.unique(a[link_a] << PAIR_BITS | b[link_b], return_inverse=True)
        held, self.times = np.unique(doc_a[link_a] * len(self.pairs) + pair, return_counts=True)
        owner, self.refs = np.divmod(held, len(self.pairs)) if len(held) else (held, held)
        self.n_pairs = np.bincount(owner, minlength=len(texts))
        self.docs_with = np.bincount(self.refs, minlength=len(self.pairs))

    def digests(self, shown_a: np.ndarray, shown_b: np.ndarray) -> list[str]:
        """Of each document's groups as ``a1,a2|b1;a3|b2``; ``shown``: each id followed by a comma, and by what ends its side of a group."""
        last_a, last_b = np.diff(self.group_a, append=-1) != 0, np.diff(self.group_b, append=-1) != 0
        before_a = np.searchsorted(self.group_b, self.group_a, "left")
        before_b = np.searchsorted(self.group_a, self.group_b, "right")
        tokens = np.empty(len(self.a) + len(self.b), object)
        tokens[np.arange(len(self.a)) + before_a] = shown_a[last_a.astype(np.int64), self.a]
        tokens[np.arange(len(self.b)) + before_b] = shown_b[last_b.astype(np.int64), self.b]
        out, at, tokens = [], 0, tokens.tolist()
        for n in (self.n_a + self.n_b).tolist():
            out.append(hashlib.sha256(b"".join(tokens[at : at + n])[:-1]).hexdigest() if n else "")
            at += n
        return out


def shown(n: int, end: bytes) -> np.ndarray:
    return np.array([[b"%d," % i for i in range(n)], [b"%d%s" % (i, end) for i in range(n)]], object)


BLOCKS = (
    "block long, doc_id array<long>, n_a array<int>, n_b array<int>, n_groups array<int>, n_links array<int>, n_pairs array<int>, groups_sha256 array<string>,"
    " refs array<int>, times array<int>, pairs array<long>, docs_with array<int>"
)
REPORT = "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"


def in_blocks(ids: list, texts: list[str]) -> Iterator[tuple[list, list[str]]]:
    """Rows in order, about ``BLOCK_BYTES`` characters together."""
    at = size = 0
    for k, text in enumerate(texts):
        if k > at and size + len(text) > BLOCK_BYTES:
            yield ids[at:k], texts[at:k]
            at, size = k, 0
        size += len(text)
    if texts:
        yield ids[at:], texts[at:]


def aligned_blocks(docs: DataFrame, byte_level: str, pieces: str) -> DataFrame:
    """One row a block of documents (``BLOCKS``): per document its counts, digest and pairs (``refs`` into ``pairs``, ``times``), per pair its documents."""
    read = lambda path: docs.sparkSession.sparkContext.broadcast(open(path, "rb").read())  # noqa: E731, SIM115
    data_a, data_b = read(byte_level), read(pieces)

    def align(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first, second = once(Vocabulary.byte_level, data_a.value), once(Vocabulary.pieces, data_b.value)
        shown_a, shown_b = shown(len(first.bytes), b"|"), shown(len(second.bytes), b";")
        number = TaskContext.get().partitionId() << 32
        for batch in batches:
            for ids, texts in in_blocks(batch.column("doc_id").to_pylist(), [t or "" for t in batch.column("text").to_pylist()]):
                b = Block(texts, first, second)
                ints = [b.n_a, b.n_b, b.n_groups, b.n_links, b.n_pairs]
                columns = [
                    pa.array([number], pa.int64()), pa.array([ids], pa.list_(pa.int64())), *[pa.array([x], pa.list_(pa.int32())) for x in ints],
                    pa.array([b.digests(shown_a, shown_b)], pa.list_(pa.string())), *[pa.array([x], pa.list_(pa.int32())) for x in (b.refs, b.times)],
                    pa.array([b.pairs], pa.list_(pa.int64())), pa.array([b.docs_with], pa.list_(pa.int32())),
                ]
                yield pa.RecordBatch.from_arrays(columns, names=["block", "doc_id", "n_a", "n_b", "n_groups", "n_links", "n_pairs", "groups_sha256", "refs", "times", "pairs", "docs_with"])
                number += 1

    narrow = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return narrow.mapInArrow(align, BLOCKS)


def pair_counts(blocks: DataFrame) -> DataFrame:
    """``pair, n``: how many documents hold a pair of ids linked; ``pair``: the first id times 2**32, and the second."""
    pairs = blocks.select(F.explode(F.arrays_zip("pairs", "docs_with")).alias("p"))
    return pairs.groupBy(F.col("p.pairs").alias("pair")).agg(F.sum("p.docs_with").alias("n"))


def link_counts(docs: DataFrame, byte_level: str, pieces: str) -> DataFrame:
    """``a, b, n``: in how many documents tokens of the ids ``a`` and ``b`` overlap."""
    found = pair_counts(aligned_blocks(docs, byte_level, pieces))
    return found.select(F.shiftright("pair", PAIR_BITS).alias("a"), F.col("pair").bitwiseAND((1 << PAIR_BITS) - 1).alias("b"), "n")


def alignment_report(docs: DataFrame, byte_level: str, pieces: str) -> DataFrame:
    """Per document its tokens, groups and links, the links of the highest count of their first id, and the sum of counts.

    ``byte_level``, ``pieces``: paths of the two vocabularies, read on the driver and broadcast.
    """
    blocks = stored(aligned_blocks(docs, byte_level, pieces), "aligned", "zstd", GATHERED)
    counts = stored(pair_counts(blocks), "pairs", "zstd")
    first = F.shiftright("pair", PAIR_BITS)
    highest = counts.groupBy(first.alias("a")).agg(F.max("n").alias("most"))
    judged = counts.withColumn("a", first).join(F.broadcast(highest), "a").select("pair", (F.col("n") * 2 + (F.col("n") == F.col("most")).cast("long")).alias("value"))
    asked = blocks.select("block", F.posexplode("pairs").alias("place", "pair"))
    parts = 1 + blocks.count() // GATHERED
    answers = asked.join(judged, "pair").repartition(parts, "block").groupBy("block").agg(F.collect_list(F.struct("place", "value")).alias("answers"))
    return blocks.drop("pairs", "docs_with").repartition(parts, "block").join(answers.hint("merge"), "block", "left").mapInArrow(told, REPORT)


def told(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each document's row of blocks whose pairs have their counts."""
    for batch in batches:
        for k in range(batch.num_rows):
            take = lambda c: batch.column(c).slice(k, 1).flatten().to_numpy(zero_copy_only=False)  # noqa: B023, E731
            found = batch.column("answers").slice(k, 1).flatten()
            place, value = (found.field(i).to_numpy(zero_copy_only=False) for i in (0, 1))
            values = np.zeros(len(place), np.int64)
            values[place] = value
            n, refs, times = take("n_pairs").astype(np.int64), take("refs"), take("times").astype(np.int64)
            owner = np.repeat(np.arange(len(n)), n)
            sums = [np.bincount(owner, w, len(n)).astype(np.int64) for w in (times * (values[refs] & 1), times * (values[refs] >> 1))]
            numbers = [take(c).astype(np.int64) for c in ("n_a", "n_b", "n_groups", "n_links")] + sums
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id").slice(k, 1).flatten(), *[pa.array(x, pa.int64()) for x in numbers], batch.column("groups_sha256").slice(k, 1).flatten()],
                names=["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"],
            )
