import os
import threading
import time

import pytest

from loomspark.sources import corpus
from loomspark.sources.files import Files, read_files, write_files


def tree(root):
    return {os.path.relpath(os.path.join(d, f), root): open(os.path.join(d, f), "rb").read() for d, _, names in os.walk(root) for f in names}


def rows(spark, files, parts=3):
    return spark.createDataFrame(files, "path string, content string").repartition(parts)


def test_one_file_a_row_and_back(spark, tmp_path):
    root = str(tmp_path / "out")
    files = [("a.js", "1\r\n"), ("sub/deep/b.html", "é"), ("sub/empty.txt", None), ("x y%.js", "blank")]
    write_files(rows(spark, files), root)
    assert tree(root) == {p: (c or "").encode() for p, c in files}
    assert {r.path: bytes(r.content) for r in read_files(spark, root).collect()} == {p: c for p, c in tree(root).items() if c}
    write_files(rows(spark, [("a.js", "2"), ("new.js", "3")]), root, overwrite=False)
    assert tree(root)["a.js"] == b"2" and len(tree(root)) == 5
    write_files(rows(spark, [("only.js", "x")]), f"file:{root}")
    assert tree(root) == {"only.js": b"x"}
    assert os.listdir(tmp_path) == ["out"]


@pytest.mark.parametrize("bad", [[("a", "1"), ("a", "2")], [("../a", "1")], [("/a", "1")], [("", "1")], [(None, "1")], [("a/./b", "1")], [("a", "1"), ("a/b", "2")]])
def test_what_is_refused_leaves_the_root_as_it_was(spark, tmp_path, bad):
    root = str(tmp_path / "out")
    write_files(rows(spark, [("old", "x")]), root)
    with pytest.raises(Exception):  # noqa: B017
        write_files(rows(spark, [*bad, *[(f"ok{k}", "y") for k in range(20)]]), root)
    assert tree(root) == {"old": b"x"} and os.listdir(tmp_path) == ["out"]


def test_its_own_input_is_refused(spark, tmp_path):
    for source in (tmp_path / "in", tmp_path / "in/sub", tmp_path):
        with pytest.raises(Exception, match="its own input"):
            write_files(rows(spark, [("a", "1")]), str(tmp_path / "in"), source=str(source))
    write_files(rows(spark, [("a", "1")]), str(tmp_path / "in2"), source=str(tmp_path / "in"))
    assert tree(tmp_path) == {"in2/a": b"1"}


def test_a_failed_task_leaves_nothing(spark, tmp_path):
    root = str(tmp_path / "out")
    failing = spark.range(0, 40, 1, 4).selectExpr("concat('f', id) AS path", "cast(if(id = 39, raise_error('lost'), 'x') AS string) AS content")
    with pytest.raises(Exception, match="lost"):
        write_files(failing, root)
    assert os.listdir(tmp_path) == []


def test_a_second_attempt_writes_each_file_once(spark, tmp_path):
    """What a first attempt has written stays in its own folder and goes with it."""
    writer = Files({"path": str(tmp_path / "out")}).writer(spark.createDataFrame([], "path string, content string").schema, True)
    import pyarrow as pa

    class Task:
        def taskAttemptId(self):  # noqa: N802
            return 7

    batch = pa.RecordBatch.from_pydict({"path": ["a", "b"], "content": ["1", "2"]})
    from loomspark.sources import files

    old, files.TaskContext = files.TaskContext, type("Context", (), {"get": staticmethod(Task)})
    try:
        writer.write(iter([batch.slice(0, 1)]))  # lost before it could tell
        writer.commit([writer.write(iter([batch])), None])
    finally:
        files.TaskContext = old
    assert tree(tmp_path) == {"out/a": b"1", "out/b": b"2"}


def test_files_of_a_distant_root_are_moved_at_once(tmp_path, monkeypatch):
    """Moves wait for the file system, so many are under way; every file comes to its place, in folders of any depth."""
    from loomspark.sources import files

    at_once, most, lock, opened = [0], [0], threading.Lock(), files.opened

    class Distant:
        def __init__(self, system):
            self.system = system

        def __getattr__(self, name):
            return getattr(self.system, name)

        def move(self, *args):
            with lock:
                at_once[0] += 1
                most[0] = max(most[0], at_once[0])
            time.sleep(0.005)
            self.system.move(*args)
            with lock:
                at_once[0] -= 1

    paths = [f"{'ab'[k % 2]}/{k % 5}/deep/{k}" for k in range(60)] + ["top"]
    monkeypatch.setattr(files, "MOVED", 2)
    monkeypatch.setattr(files, "opened", lambda root: (Distant(opened(root)[0]), opened(root)[1]))
    writer = files.FilesWriter(str(tmp_path / "out"), None, True)
    for path in paths:
        os.makedirs(os.path.dirname(f"{writer.staging}/t/{path}"), exist_ok=True)
        open(f"{writer.staging}/t/{path}", "w").write(path)
    writer.commit([files.Written("t", paths), None])
    assert tree(tmp_path) == {f"out/{p}": p.encode() for p in paths} and most[0] > 1


def test_many_folders_are_listed_by_few_tasks(spark, tmp_path):
    for k in range(150):
        (tmp_path / f"f{k}").mkdir()
        (tmp_path / f"f{k}" / "a.js").write_text(f"f({k})")
    name, context = "spark.sql.sources.parallelPartitionDiscovery.parallelism", spark.sparkContext
    before = spark.conf.get(name)
    context.setJobGroup("listing", "folders are listed")
    try:
        found = corpus.read_corpus(spark, str(tmp_path))
        jobs = [context.statusTracker().getJobInfo(j) for j in context.statusTracker().getJobIdsForGroup("listing")]
    finally:
        context.setLocalProperty("spark.jobGroup.id", None)
    tasks = [context.statusTracker().getStageInfo(k).numTasks for j in jobs for k in j.stageIds]
    assert tasks and max(tasks) <= corpus.LISTERS * context.defaultParallelism < 150
    assert found.count() == 150 and spark.conf.get(name) == before


def test_the_driver_holds_few_of_the_paths_at_once(tmp_path, monkeypatch):
    import pyarrow as pa

    from loomspark.sources import files

    task = [0]
    monkeypatch.setattr(files, "TaskContext", type("Context", (), {"get": staticmethod(lambda: type("Task", (), {"taskAttemptId": lambda self: task[0]})())}))
    monkeypatch.setattr(files, "HELD", 5)

    def told(writer, *paths):
        task[0] += 1
        return writer.write(iter([pa.RecordBatch.from_pydict({"path": list(paths), "content": list(paths)})]))

    def written(*tasks):
        writer = files.FilesWriter(str(tmp_path / "out"), None, True)
        messages = [told(writer, *paths) for paths in tasks]
        assert all(m.paths is None and m.n == len(p) for m, p in zip(messages, tasks, strict=True))  # what comes to the driver
        writer.commit(messages)

    names = [f"{'ab'[k % 2]}/{k % 5}/deep/{k}" for k in range(60)] + ["top"]
    written(names[:20], [], names[20:])
    whole = {f"out/{p}": p.encode() for p in names}
    assert tree(tmp_path) == whole
    for bad in (["b/1/deep/21"], ["a/0"], ["top/x"]):
        with pytest.raises(ValueError, match="two rows|both a file and a folder"):
            written(names[:20], names[20:], bad)
        assert tree(tmp_path) == whole
