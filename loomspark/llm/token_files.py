"""Token ids of a corpus in files of wavelet matrices, one a shard, written, searched and read back.

Documents are dealt by ranges of their ids, so that files in the order of their names hold
them in ascending order. A file's name says where it stands (its range, its place in the
range, the tokens of the range before it, its own tokens), so all places in the corpus
follow from names and one total a range; a task holds one file's tokens, about
``shard_tokens`` and never less than a whole document. Files are committed together
(``loomspark.sources.files``), so a lost executor leaves no partial or doubled file.

Defined results: a null or empty text is the end id alone; a null doc_id comes before all
others and stays null; rows of one doc_id are ordered by a hash of the text, then as they
were read, each of them kept; other columns are ignored; no rows make no files, of which all
questions give no rows.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomspark.llm.library_ids import ByteLevelIds, once
from loomspark.llm.wavelet import ShardFile, packed_file
from loomspark.llm.words import slices
from loomspark.sources.files import read_files, write_files

NAME = r"^(\d+)-(\d+)-(\d+)-(\d+)\.wave$"
FILES = "path string, content binary"
#: Rows, and bytes of text unless one has more, that are encoded at once: few enough to hold, many enough that their words repeat.
ROWS, TEXT_BYTES = 1024, 1 << 22
DOCUMENTS = "doc_id long, start long, n_tokens long, ids_crc32 long"


def write_token_files(docs: DataFrame, root: str, tokenizer: str, end: int = 0, shard_tokens: int = 1 << 22) -> None:
    """Encodes every text, ends it with the id ``end``, and writes the ids in order of ``doc_id`` below ``root``.

    ``tokenizer``: the path of a byte-level vocabulary, read on the driver and broadcast.
    """
    with open(tokenizer, "rb") as f:
        data = docs.sparkSession.sparkContext.broadcast(f.read())

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, part, before, k = once(ByteLevelIds, data.value), TaskContext.get().partitionId(), 0, 0
        held: list[tuple[np.ndarray, list, np.ndarray]] = []

        def file() -> pa.RecordBatch:
            ids = np.concatenate([h[0] for h in held])
            content = packed_file(ids, [d for h in held for d in h[1]], np.concatenate([h[2] for h in held]))
            return pa.RecordBatch.from_arrays([pa.array([f"{part:08d}-{k:06d}-{before:015d}-{len(ids):012d}.wave"]), pa.array([content], pa.binary())], names=["path", "content"])

        for batch in slices(batches, ROWS, TEXT_BYTES):
            ids, counts = encoder.encode([t or "" for t in batch.column("text").to_pylist()])
            held.append((np.insert(ids, np.cumsum(counts), end), batch.column("doc_id").to_pylist(), counts + 1))
            if (size := sum(len(h[0]) for h in held)) >= shard_tokens:
                yield file()
                held.clear()
                before, k = before + size, k + 1
        if held:
            yield file()

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    keys = [F.col("doc_id").asc_nulls_first(), F.xxhash64("text"), F.col("_row")]
    numbered = rows.withColumn("_row", F.monotonically_increasing_id())
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = numbered.repartitionByRange(parts, *keys).sortWithinPartitions(*keys)
    write_files(dealt.select("doc_id", "text").mapInArrow(packed, FILES), root)


def shard_files(spark: SparkSession, root: str) -> tuple[DataFrame, dict[int, int]]:
    """The files (``part, before, content``), and the tokens before each range: one total a range comes to the driver."""
    place = [F.regexp_extract("path", NAME, k).cast("long").alias(n) for k, n in ((1, "part"), (3, "before"), (4, "tokens"))]
    files = read_files(spark, root).where(F.col("path").rlike(NAME)).select(*place, "content")
    totals = sorted(map(tuple, files.groupBy("part").agg(F.sum("tokens")).collect()))
    ends = np.cumsum([n for _, n in totals]).tolist()
    return files, {part: end - n for (part, n), end in zip(totals, ends, strict=True)}


def from_files(spark: SparkSession, root: str, told, schema: str) -> DataFrame:
    """What ``told(file, start)`` says of each file, as columns; ``start``: the tokens of all files before it."""
    files, starts = shard_files(spark, root)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 1):
            part, before = batch.column("part")[0].as_py(), batch.column("before")[0].as_py()
            columns = told(ShardFile(batch.column("content")[0].as_py()), starts[part] + before)
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns.values()], names=list(columns))

    return files.mapInArrow(read, schema)


def documents_of(spark: SparkSession, root: str) -> DataFrame:
    """``doc_id, start, n_tokens, ids_crc32`` of every document, from the ids that the files hold."""

    def told(file: ShardFile, start: int) -> dict:
        ids = file.matrix.ids().astype("<u4")
        sums = [zlib.crc32(ids[a : a + n]) for a, n in zip(file.starts.tolist(), file.counts.tolist(), strict=True)]
        return {"doc_id": file.doc_ids, "start": file.starts + start, "n_tokens": file.counts, "ids_crc32": sums}

    return from_files(spark, root, told, DOCUMENTS)


def count_ids(spark: SparkSession, root: str, ids: list[int]) -> DataFrame:
    """``id, n``: how often each of the ids occurs in the corpus."""
    asked = np.array(sorted(set(ids)), np.int64)
    counts = from_files(spark, root, lambda file, start: {"id": asked, "n": file.matrix.count(asked)}, "id long, n long")
    return counts.groupBy("id").agg(F.sum("n").alias("n"))


def find_id(spark: SparkSession, root: str, token: int) -> DataFrame:
    """``doc_id, place, at``: every occurrence of an id, in its document and in the corpus, counted from 0."""

    def told(file: ShardFile, start: int) -> dict:
        places = file.matrix.occurrences(token)
        owner = file.document_of(places)
        return {"doc_id": [file.doc_ids[k] for k in owner.tolist()], "place": places - file.starts[owner], "at": places + start}

    return from_files(spark, root, told, "doc_id long, place long, at long")


def ids_at(spark: SparkSession, root: str, places: list[int]) -> DataFrame:
    """``at, id``: the ids at places of the corpus; a place beyond it has no row."""
    asked = np.array(sorted(set(places)), np.int64)

    def told(file: ShardFile, start: int) -> dict:
        own = asked[(asked >= start) & (asked < start + file.matrix.n)]
        return {"at": own, "id": file.matrix.access(own - start)}

    return from_files(spark, root, told, "at long, id long")
