"""Token counts by heap-and-linked-list byte-pair merging.

A text is cut into pieces by the vocabulary's pre-tokenizing pattern. Within a piece the
adjacent pair of lowest rank is popped from a heap and merged in a linked list until no
pair has a rank; the piece's count is its bytes less the merges. No identifiers are made.

Pieces repeat, so each Python worker keeps a table of counted pieces; it is emptied when
it reaches ``memo`` entries, which bounds its memory and changes no count.

Null texts count as empty (0 bytes, 0 tokens). Rows are neither dropped nor joined: a
repeated row is counted again, other columns are ignored, null ids stay null.
"""

from __future__ import annotations

import heapq
import json
from collections.abc import Iterator

import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from loomspark.llm.words import slices

#: Fixed value: the pre-tokenizing pattern of byte-level vocabularies of this family.
PIECES = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

SCHEMA = "doc_id long, n_bytes long, n_tokens long, over_limit boolean"


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte in a byte-level vocabulary."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    moved = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(moved)) for b in range(256)]


class PairRanks:
    """Merge ranks by pair of symbol numbers; picklable, about as large as the vocabulary."""

    def __init__(self, vocabulary: dict):
        merges, symbols = vocabulary["model"]["merges"], {}
        number = lambda s: symbols.setdefault(s, len(symbols))
        self.first = [number(s) for s in byte_symbols()]
        self.pairs: dict[int, tuple[int, int]] = {}
        for rank, (a, b) in enumerate(m.split(" ") if isinstance(m, str) else m for m in merges):
            self.pairs[number(a) << 32 | number(b)] = (rank, number(a + b))
        self.specials = sorted((t["content"] for t in vocabulary.get("added_tokens", [])), key=len, reverse=True)

    @classmethod
    def load(cls, path: str) -> PairRanks:
        with open(path, encoding="utf-8") as f:
            return cls(json.load(f))


def merged_length(piece: bytes, ranks: PairRanks) -> int:
    """How many symbols are left of ``piece`` when no adjacent pair has a rank."""
    n, pairs = len(piece), ranks.pairs
    symbol = [ranks.first[b] for b in piece]
    after, before, merges, heap = list(range(1, n + 1)), list(range(-1, n)), 0, []
    for i in range(n - 1):
        if found := pairs.get(symbol[i] << 32 | symbol[i + 1]):
            heap.append((found[0], i))
    heapq.heapify(heap)
    while heap:
        rank, i = heapq.heappop(heap)
        j = after[i]
        if symbol[i] < 0 or j >= n:
            continue
        found = pairs.get(symbol[i] << 32 | symbol[j])
        if found is None or found[0] != rank:  # the pair has changed since it was pushed
            continue
        symbol[i], symbol[j] = found[1], -1
        after[i] = k = after[j]
        before[k] = i
        merges += 1
        if k < n and (right := pairs.get(symbol[i] << 32 | symbol[k])):
            heapq.heappush(heap, (right[0], i))
        if (h := before[i]) >= 0 and (left := pairs.get(symbol[h] << 32 | symbol[i])):
            heapq.heappush(heap, (left[0], h))
    return n - merges


class PieceCounts(dict):
    """Token count by piece, filled on demand."""

    def __init__(self, ranks: PairRanks, memo: int):
        super().__init__()
        self.ranks, self.memo = ranks, memo

    def __missing__(self, piece: str) -> int:
        n = merged_length(piece.encode("utf-8"), self.ranks)
        if len(self) >= self.memo:
            self.clear()
        self[piece] = n
        return n


class TokenCounter:
    """Counts tokens of whole texts; special strings inside a text count as one token each."""

    def __init__(self, ranks: PairRanks, memo: int = 1 << 20):
        self.counts, self.pieces = PieceCounts(ranks, memo), regex.compile(PIECES)
        self.special = regex.compile("|".join(map(regex.escape, ranks.specials))) if ranks.specials else None

    def count(self, text: str) -> int:
        special = len(self.special.findall(text)) if self.special else 0
        parts = self.special.split(text) if special else (text,)
        one = self.counts.__getitem__
        return special + sum(sum(map(one, self.pieces.findall(part))) for part in parts)


def count_tokens(docs: DataFrame, tokenizer: str, limit: int = 512, memo: int = 1 << 20) -> DataFrame:
    """``doc_id, n_bytes, n_tokens, over_limit`` of every row of ``docs`` (``doc_id``, ``text``).

    ``tokenizer``: path of a byte-level BPE vocabulary, read once on the driver; its ranks
    (tens of thousands of pairs, whatever the corpus) are broadcast.
    """
    ranks = docs.sparkSession.sparkContext.broadcast(PairRanks.load(tokenizer))

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = TokenCounter(ranks.value, memo)
        for batch in slices(batches):
            texts = [t or "" for t in batch.column("text").to_pylist()]
            sizes, tokens = [len(t.encode("utf-8")) for t in texts], [counter.count(t) for t in texts]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(sizes, pa.int64()), pa.array(tokens, pa.int64()), pa.array([n > limit for n in tokens], pa.bool_())],
                names=["doc_id", "n_bytes", "n_tokens", "over_limit"],
            )

    narrow = docs.selectExpr("cast(doc_id AS bigint) AS doc_id", "cast(text AS string) AS text")
    return narrow.mapInArrow(counted, SCHEMA)
