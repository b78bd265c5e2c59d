"""Benchmark decontamination with an FM-index for each shard of the training table.

A shard is a block of rows within a task. Its words become symbols: a word that no test item
can have (by a bit table of all items' words) ends a run, and runs shorter than the shortest
window cannot hold one, so the index covers the text where an occurrence can be and little
else. Every window of every item is then found by backward search, occurrences are located
by sampled suffix positions, and their spans are merged. Documents are read once, and never
shuffled or collected.

Test items are cut into blocks of about ``block_bytes`` of text, written to the shared folder
as one file a block. A task indexes a shard once and searches block after block in it, so
any number of items takes one pass over the documents; a worker holds ``HELD`` blocks.

Defined results: null and empty texts have no words and no hits; an item without words has
no window; a null item id counts under the name ``null``, an empty one as it is; equal windows of several items
count for each; repeated rows are judged each; other columns are ignored or, when cutting,
passed through unchanged.
"""

from __future__ import annotations

import io
import json
import re
import zlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyarrow.fs import FileSelector
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomspark.llm.fm_index import FMIndex
from loomspark.llm.tables import fresh_folder
from loomspark.llm.words import ALNUM, alnum_words, slices, text_bytes
from loomspark.sources.files import opened, write_files

SPANS = "array<struct<start:int,stop:int>>"
#: Blocks of items that a worker keeps between shards.
HELD = 8
#: Bits of the table of words, of 64 each.
BITS = 1 << 26


@dataclass
class Items:
    """A block of test items: its distinct words, all items' words by number (from 1), and where each item begins."""

    words: list[bytes]
    sequence: np.ndarray
    starts: np.ndarray
    ids: list[str]

    @classmethod
    def of(cls, items: Iterable[tuple[str | None, str | None]]) -> Items:
        numbers: dict[bytes, int] = {}
        sequence, starts, ids = [], [0], []
        for item, text in items:
            if words := alnum_words((text or "").encode()):
                sequence += [numbers.setdefault(w, len(numbers) + 1) for w in words]
                starts.append(len(sequence))
                ids.append("null" if item is None else item)
        return cls(list(numbers), np.array(sequence, np.int32), np.array(starts, np.int64), ids)

    def to_bytes(self) -> bytes:
        out = io.BytesIO()
        texts = [np.frombuffer(x, np.uint8) for x in (b" ".join(self.words), json.dumps(self.ids).encode())]
        np.savez_compressed(out, words=texts[0], ids=texts[1], sequence=self.sequence, starts=self.starts)
        return out.getvalue()

    @classmethod
    def from_bytes(cls, data: bytes) -> Items:
        with np.load(io.BytesIO(data)) as f:
            return cls(f["words"].tobytes().split(), f["sequence"], f["starts"], json.loads(f["ids"].tobytes()))

    def windows(self, known: np.ndarray, size: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """By length: the windows of which all words are ``known`` (a symbol for each number, 0 for none), and whose they are."""
        symbols = np.concatenate((known[self.sequence], [0]))
        lengths = np.diff(self.starts)
        long = lengths >= size
        whole = np.concatenate(([0], np.cumsum(symbols > 0)))
        for length in (size, *np.unique(lengths[~long]).tolist()):
            held = long if length == size else lengths == length
            first = self.starts[:-1][held]
            n = lengths[held] - length + 1
            at = np.arange(n.sum()) + np.repeat(first - (np.cumsum(n) - n), n)
            owner = np.repeat(np.flatnonzero(held), n)
            full = np.flatnonzero(whole[at + length] - whole[at] == length)
            if len(full):
                yield length, symbols[at[full, None] + np.arange(length)], owner[full]


@dataclass
class TestSet:
    """What tasks need of the test items: the bit table, the blocks' files, and the window sizes."""

    table: np.ndarray
    files: list[str]
    size: int
    shortest: int

    def has(self, word: bytes) -> bool:
        at = zlib.crc32(word) % BITS
        return bool(self.table[at >> 6] >> np.uint64(at & 63) & np.uint64(1))

    def blocks(self) -> Iterator[Items]:
        """The blocks one after the other, the first ones from the worker's memory."""
        for file in self.files:
            if (found := _HELD.get(file)) is None:
                system, path = opened(file)
                with system.open_input_stream(path) as f:
                    found = Items.from_bytes(f.read())
                if len(_HELD) >= HELD and not any(file in _HELD for file in self.files):
                    _HELD.clear()  # of another test set
                if len(_HELD) < HELD:
                    _HELD[file] = found
            yield found


#: Blocks that this worker holds, by their files.
_HELD: dict[str, Items] = {}


class Symbols(dict):
    """Numbers from 1 of the words that test items may have, 0 of all others, as they are met."""

    def __init__(self, tests: TestSet):
        super().__init__()
        self.tests, self.n = tests, 0

    def __missing__(self, word: bytes) -> int:
        found = 0
        if self.tests.has(word):
            self.n += 1
            found = self.n
        self[word] = found
        return found


@dataclass
class Hits:
    """For each document of a shard: its words, merged word spans, and items."""

    words: list[int]
    spans: list[list[tuple[int, int]]]
    items: list[set[str]]


def runs_of(known: np.ndarray, shortest: int) -> tuple[np.ndarray, np.ndarray]:
    """Starts and stops of runs of true values, at least ``shortest`` long."""
    edges = np.flatnonzero(np.diff(np.concatenate(([0], known.view(np.int8), [0]))))
    starts, stops = edges[::2], edges[1::2]
    long = stops - starts >= shortest
    return starts[long], stops[long]


def search_shard(texts: list[bytes], tests: TestSet) -> Hits:
    """Index the texts once and find every window of every block in them."""
    symbol, parts, sizes = Symbols(tests), [], []
    for text in texts:
        words = alnum_words(text)
        sizes.append(len(words))
        parts += [np.fromiter(map(symbol.__getitem__, words), np.int64, len(words)), np.zeros(1, np.int64)]
    hits = Hits(sizes, [[] for _ in texts], [set() for _ in texts])
    symbols = np.concatenate(parts) if parts else np.zeros(0, np.int64)
    starts, stops = runs_of(symbols > 0, tests.shortest)
    if not len(starts):
        return hits
    lengths = stops - starts + 1  # each run keeps the 0 that ends it
    origin = np.arange(lengths.sum()) + np.repeat(starts - np.concatenate(([0], np.cumsum(lengths)[:-1])), lengths)
    index = FMIndex(symbols[origin])
    firsts = np.concatenate(([0], np.cumsum(np.array(sizes) + 1)))
    change = np.zeros(len(symbols) + 1, np.int64)
    there = np.zeros(symbol.n + 1, np.int64)
    there[symbols[origin]] = symbols[origin]  # words of runs that are too short are not indexed
    for block in tests.blocks():
        known = np.concatenate(([0], there[np.fromiter((symbol.get(w, 0) for w in block.words), np.int64, len(block.words))]))
        for length, windows, owner in block.windows(known, tests.size):
            low, high = index.search(windows)
            which = np.repeat(np.arange(len(windows)), high - low)
            rows = np.arange(len(which)) + np.repeat(low - np.concatenate(([0], np.cumsum(high - low)[:-1])), high - low)
            at = origin[index.locate(rows)]
            np.add.at(change, at, 1)
            np.add.at(change, at + length, -1)
            docs = np.searchsorted(firsts, at, "right") - 1
            for doc, item in np.unique(np.stack((docs, owner[which])), axis=1).T.tolist():
                hits.items[doc].add(block.ids[item])
    starts, stops = runs_of(np.cumsum(change[:-1]) > 0, 1)
    docs = np.searchsorted(firsts, starts, "right") - 1
    for doc, start, stop in zip(docs.tolist(), (starts - firsts[docs]).tolist(), (stops - firsts[docs]).tolist(), strict=True):
        hits.spans[doc].append((start, stop))
    return hits


def cut_spans(text: bytes, spans: list[tuple[int, int]]) -> bytes:
    """``text`` without the words of the spans; a line break stands for each cut."""
    bounds = [m.span() for m in re.finditer(rb"[^ ]+", text.translate(ALNUM))]
    out, at = [], 0
    for start, stop in spans:
        out.append(text[at : bounds[start][0]])
        at = bounds[stop - 1][1]
    return b"\n".join([*out, text[at:]])


def word_table(items: DataFrame) -> tuple[np.ndarray, int]:
    """The bit table of all words of the items, and the words of the shortest item that has any (0: none has).

    At most ``BITS / 64`` rows come to the driver, whatever the items.
    """

    def bits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 4096):
            words = [alnum_words(t) for t in text_bytes(batch.column("text"))]
            at = np.unique(np.fromiter((zlib.crc32(w) % BITS for x in words for w in x), np.int64))
            places, first = np.unique(at >> 6, return_index=True)
            if len(at):
                value = np.bitwise_or.reduceat(np.uint64(1) << (at & 63).astype(np.uint64), first).view(np.int64)
                shortest = min(len(x) for x in words if x)
                yield pa.RecordBatch.from_arrays([pa.array(places), pa.array(value), pa.array(np.full(len(places), shortest))], names=["place", "value", "shortest"])

    found = items.select("text").mapInArrow(bits, "place long, value long, shortest long").groupBy("place").agg(F.bit_or("value").alias("value"), F.min("shortest").alias("shortest"))
    table, shortest = np.zeros(BITS >> 6, np.uint64), 0
    rows = found.toArrow()
    if rows.num_rows:
        table[rows["place"].to_numpy()] = rows["value"].to_numpy().view(np.uint64)
        shortest = int(rows["shortest"].to_numpy().min())
    return table, shortest


def prepared(benchmark: DataFrame, size: int, block_bytes: int) -> TestSet:
    """The test set of ``benchmark`` (``item_id``, ``text``), its blocks written to the shared folder."""
    spark = benchmark.sparkSession
    items = benchmark.select(F.col("item_id").cast("string").alias("item_id"), F.col("text").cast("string").alias("text"))
    total = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks, root = -(-total // block_bytes), fresh_folder(spark, "items")
    table, shortest = word_table(items)
    if not shortest:
        return TestSet(table, [], size, size)

    def packed(group: pa.Table) -> pa.Table:
        block = Items.of(zip(group["item_id"].to_pylist(), group["text"].to_pylist(), strict=True))
        return pa.table({"path": [f"{group['block'][0].as_py():08d}.npz"], "content": pa.array([block.to_bytes()], pa.binary())})

    dealt = items.withColumn("block", F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)).cast("long"))
    write_files(dealt.groupBy("block").applyInArrow(packed, "path string, content binary"), root)
    system, folder = opened(root)
    names = sorted(f.base_name for f in system.get_file_info(FileSelector(folder)))
    return TestSet(table, [f"{root}/{n}" for n in names], size, min(size, shortest))


def find_leaks(docs: DataFrame, benchmark: DataFrame, size: int = 10, block_bytes: int = 2 << 20) -> DataFrame:
    """``doc_id, n_words, spans, items`` for every row of ``docs`` (``doc_id``, ``text``).

    ``spans``: merged word ranges of occurring windows; ``items``: ids that have such windows.
    """
    tests = docs.sparkSession.sparkContext.broadcast(prepared(benchmark, size, block_bytes))
    kinds = {"spans": pa.list_(pa.struct([("start", pa.int32()), ("stop", pa.int32())])), "items": pa.list_(pa.string())}

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            hits = search_shard(text_bytes(batch.column("text")), tests.value)
            places = [[{"start": a, "stop": b} for a, b in x] for x in hits.spans]
            names = [sorted(x) for x in hits.items]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(hits.words, pa.int64()), pa.array(places, kinds["spans"]), pa.array(names, kinds["items"])], names=["doc_id", "n_words", "spans", "items"])

    narrow = docs.selectExpr("cast(doc_id AS bigint) AS doc_id", "cast(text AS string) AS text")
    return narrow.mapInArrow(search, f"doc_id long, n_words long, spans {SPANS}, items array<string>")


def leak_report(docs: DataFrame, benchmark: DataFrame, size: int = 10) -> DataFrame:
    """``doc_id, n_words, n_hit, n_items, items_sha256, contaminated`` and ``spans`` of every row."""
    found = find_leaks(docs, benchmark, size)
    hit = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["stop"] - s["start"])
    return found.select(
        "doc_id",
        "n_words",
        hit.alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join(F.array_sort("items"), ",").cast("binary"), 256).alias("items_sha256"),
        (F.size("spans") > 0).alias("contaminated"),
        "spans",
    )


def cut_leaks(docs: DataFrame, benchmark: DataFrame, size: int = 10, block_bytes: int = 2 << 20) -> DataFrame:
    """``docs`` with every occurring window cut out of ``text``, and ``n_chars``, if there, counted anew.

    A cut text is searched again until nothing is found, since a cut brings words together.
    A document of which no word is left goes; one that never had a hit stays as it is, even
    if it is empty. Every search is for the items of all blocks, and what they find is cut at once.
    """
    columns = docs.columns
    typed = docs.withColumns({"text": F.col("text").cast("string")} | ({"n_chars": F.col("n_chars").cast("long")} if "n_chars" in columns else {}))
    tests = docs.sparkSession.sparkContext.broadcast(prepared(benchmark, size, block_bytes))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            texts, dirty, keep = text_bytes(batch.column("text")), list(range(batch.num_rows)), np.ones(batch.num_rows, bool)
            changed: set[int] = set()
            while dirty:
                found = search_shard([texts[k] for k in dirty], tests.value).spans
                hit = [(k, spans) for k, spans in zip(dirty, found, strict=True) if spans]
                for k, spans in hit:
                    texts[k] = cut_spans(texts[k], spans)
                    changed.add(k)
                    keep[k] = bool(alnum_words(texts[k]))
                dirty = [k for k, _ in hit if keep[k]]
            if changed:
                old = batch.column("text").to_pylist()
                new = [texts[k].decode() if k in changed else old[k] for k in range(batch.num_rows)]
                arrays = list(batch.columns)
                arrays[batch.schema.get_field_index("text")] = pa.array(new, batch.schema.field("text").type)
                if (at := batch.schema.get_field_index("n_chars")) >= 0:
                    sizes = batch.column("n_chars").to_pylist()
                    arrays[at] = pa.array([len(new[k]) if k in changed else sizes[k] for k in range(batch.num_rows)], batch.schema.field("n_chars").type)
                batch = pa.RecordBatch.from_arrays(arrays, schema=batch.schema).filter(pa.array(keep))
            yield batch

    return typed.mapInArrow(cut, typed.schema)
