"""A sink that writes one file for each row, and the reader of such trees.

``format("files")`` takes rows of ``path`` (below the root) and ``content`` (text or bytes).
Every task writes below a staging folder of its own beside the root; when all tasks have
ended, the driver moves their files to their places, so a failed or repeated task leaves
nothing behind and a failed job leaves the root as it was. Mode ``overwrite`` replaces the
whole tree, ``append`` adds to it and replaces files of the same path.

A null content is an empty file. Refused, before the root is touched: an empty, absolute or
upward path, a path twice in one job (or one that is another's folder), and a root that the
option ``input`` names, or that lies above or below it.
"""

from __future__ import annotations

import json
import posixpath
import time
import uuid
import zlib
from collections import deque
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass
from itertools import islice

import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage

#: How many files are moved at once where each waits for a distant file system, and how many each mover is given at a time. A local one is fastest by one.
MOVERS, MOVED = 16, 1 << 10
#: About how many paths the driver holds at once when it looks for doubles.
HELD = 1 << 20
SCHEMA = "path string, content binary"


def opened(root: str) -> tuple[fs.FileSystem, str]:
    """The file system of ``root`` and its path in it."""
    if "://" in root:
        return fs.FileSystem.from_uri(root)
    return fs.LocalFileSystem(), root.removeprefix("file:")


def checked(path: str | None) -> str:
    """``path`` if it stays below the root."""
    if not path or path.startswith("/") or posixpath.normpath(path) != path or path.split("/")[0] in ("..", "."):
        raise ValueError(f"not a path below the root: {path!r}")
    return path


def overlap(a: str, b: str) -> bool:
    """Whether one of two folders is, or holds, the other."""
    a, b = (posixpath.normpath(opened(x)[1]) + "/" for x in (a, b))
    return a.startswith(b) or b.startswith(a)


@dataclass
class Written(WriterCommitMessage):
    """The folder of a task and the files in it: as given, or ``n`` that a list beside the folder names, so that the driver need not hold those of all tasks."""

    folder: str
    paths: list[str] | None
    n: int = 0


def above(paths: Iterator[str], depth: int | None = None) -> Iterator[str]:
    """The folders that the paths lie in, those so deep if asked for; a folder is named again when others came between."""
    last = None
    for path in paths:
        folder = path.rpartition("/")[0]
        if folder and folder != last:
            ends = [*(at for at, c in enumerate(folder) if c == "/"), len(folder)]
            yield from (folder[:at] for at in (ends if depth is None else ends[depth : depth + 1]))
        last = folder


class FilesWriter(DataSourceArrowWriter):
    def __init__(self, root: str, source: str | None, overwrite: bool):
        if source is not None and overlap(root, source):
            raise ValueError("the output would replace its own input")
        self.root, self.overwrite = root.rstrip("/"), overwrite
        self.staging = f"{self.root}.staging-{uuid.uuid4().hex}"
        system, staging = opened(self.staging)
        system.create_dir(staging, recursive=True)  # here, so that a task that outlives its job cannot make it anew

    def write(self, batches: Iterator[pa.RecordBatch]) -> Written:
        system, staging = opened(self.staging)
        folder, paths, made = f"{TaskContext.get().taskAttemptId()}-{uuid.uuid4().hex}", [], {""}
        system.create_dir(f"{staging}/{folder}", recursive=False)
        for batch in batches:
            contents = batch.column("content").cast(pa.binary())
            for path, content in zip(batch.column("path").to_pylist(), contents, strict=True):
                for level in (checked(path)[:at] for at, c in enumerate(path) if c == "/"):
                    if level not in made:
                        system.create_dir(f"{staging}/{folder}/{level}", recursive=False)
                        made.add(level)
                with system.open_output_stream(f"{staging}/{folder}/{checked(path)}", compression=None) as out:
                    out.write(content.as_buffer() if content.is_valid else b"")
                paths.append(path)
        with system.open_output_stream(f"{staging}/{folder}.paths", compression=None) as out:
            out.write(json.dumps(paths).encode())
        return Written(folder, None, len(paths))

    def commit(self, messages: list[Written | None]) -> None:
        system, root = opened(self.root)
        staging, done = opened(self.staging)[1], [m for m in messages if m]
        parts = 1 + sum(m.n if m.paths is None else len(m.paths) for m in done) // HELD

        def paths_of(m: Written) -> list[str]:
            if m.paths is not None:
                return m.paths
            with system.open_input_stream(f"{staging}/{m.folder}.paths", compression=None) as found:
                return json.loads(found.read())

        def every() -> Iterator[str]:
            return (p for m in done for p in paths_of(m))

        def of_part(names: Iterator[str], part: int) -> Iterator[str]:
            return (x for x in names if parts == 1 or zlib.crc32(x.encode("utf-8", "surrogatepass")) % parts == part)

        try:
            depth = 0
            for part in range(parts):  # what is alike falls into one part
                taken: set[str] = set()
                for path in of_part(every(), part):
                    if path in taken:
                        raise ValueError(f"two rows for the file {path!r}")
                    taken.add(path)
                    depth = max(depth, path.count("/"))
                if clash := next((f for f in of_part(above(every()), part) if f in taken), None):
                    raise ValueError(f"both a file and a folder: {clash!r}")
            if self.overwrite and system.get_file_info(root).type != fs.FileType.NotFound:
                system.delete_dir(root)
            system.create_dir(root, recursive=True)
            moves = ((f"{staging}/{m.folder}/{path}", f"{root}/{path}") for m in done for path in paths_of(m))
            movers = 1 if isinstance(system, fs.LocalFileSystem) else MOVERS
            with ThreadPoolExecutor(movers) as pool:
                # by depth, and each once, so that no two threads make the same folder
                for level in range(depth):
                    for part in range(parts):
                        deque(pool.map(lambda f: system.create_dir(f"{root}/{f}", recursive=False), set(of_part(above(every(), level), part))), maxlen=0)
                while some := list(islice(moves, movers * MOVED)):
                    deque(pool.map(lambda k: [system.move(*m) for m in some[k::movers]], range(movers)), maxlen=0)  # noqa: B023
        finally:
            self.clear()

    def abort(self, messages: list[Written | None]) -> None:
        self.clear()

    def clear(self) -> None:
        system, staging = opened(self.staging)
        for tries in range(5, -1, -1):  # tasks may still be writing into it
            try:
                if system.get_file_info(staging).type != fs.FileType.NotFound:
                    system.delete_dir(staging)
                return
            except OSError:
                if not tries:
                    raise
                time.sleep(0.2)


class Files(DataSource):
    """Options: ``path``, the root; ``input``, a root that must not be written over."""

    @classmethod
    def name(cls) -> str:
        return "files"

    def schema(self) -> str:
        return SCHEMA

    def writer(self, schema, overwrite: bool) -> FilesWriter:
        if [f.name for f in schema.fields] != ["path", "content"]:
            raise ValueError("rows must be path, content")
        return FilesWriter(self.options["path"], self.options.get("input"), overwrite)


def write_files(files: DataFrame, root: str, source: str | None = None, overwrite: bool = True) -> None:
    """One file a row of ``path, content`` below ``root``."""
    files.sparkSession.dataSource.register(Files)
    out = files.select("path", "content").write.format("files").mode("overwrite" if overwrite else "append").option("path", root)
    (out if source is None else out.option("input", source)).save()


def read_files(spark: SparkSession, root: str) -> DataFrame:
    """``path, content`` (bytes) of every file below ``root`` that is not empty; Spark passes over empty ones."""
    base = spark._jvm.org.apache.hadoop.fs.Path(root)
    whole = base.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(base).toString()
    found = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    return found.selectExpr(f"substr(path, {len(whole) + 2}) AS path", "content")
