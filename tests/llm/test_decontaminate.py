import hashlib
import random
import re

import pytest

from loomspark.llm import decontaminate as dc

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def plain(text, items, size):
    doc, hit, found = words(text), set(), set()
    for item, item_text in items:
        w = words(item_text)
        n = min(size, len(w))
        for k in range(len(w) - n + 1 if w else 0):
            for at in range(len(doc) - n + 1):
                if doc[at : at + n] == w[k : k + n]:
                    hit.update(range(at, at + n))
                    found.add("null" if item is None else str(item))
    ids = sorted(found)
    return len(doc), len(hit), len(ids), hashlib.sha256(",".join(ids).encode()).hexdigest(), bool(hit)


@pytest.fixture(scope="module")
def tables(spark):
    random.seed(2)
    pool = ["the", "of", "a", "é", "x1", "Zed", "q"]
    text = lambda n: "".join(random.choice(pool) + random.choice([" ", ", ", "\n", "-"]) for _ in range(n))
    items = [(k, text(random.randint(1, 9))) for k in range(12)] + [(3, text(5)), (None, text(4)), (50, None), (51, ""), (52, "?!")]
    docs = [(k, text(random.randint(0, 60)), "x") for k in range(60)] + [(7, None, "y"), (8, "", None), (9, "   ", "z"), (None, text(30), "n")]
    docs += [docs[0], (100, "plain words only " * 400 + items[0][1] * 3, "long")]
    return spark.createDataFrame(docs, "doc_id long, text string, spans string"), spark.createDataFrame(items, "item_id long, text string"), docs, items


@pytest.mark.parametrize(("size", "block_bytes"), [(4, 1 << 20), (4, 20), (2, 1 << 20)])
def test_leaks_against_plain_search(tables, size, block_bytes):
    df, benchmark, docs, items = tables
    found = dc.find_leaks(df, benchmark, size, block_bytes).collect()
    got = sorted((str(r.doc_id), r.n_words, sum(s.stop - s.start for s in r.spans), len(r["items"]), hashlib.sha256(",".join(sorted(r["items"])).encode()).hexdigest(), bool(r.spans)) for r in found)
    assert got == sorted((str(d[0]), *plain(d[1], items, size)) for d in docs)
    if block_bytes > 20:
        report = dc.leak_report(df, benchmark, size).collect()
        assert sorted((str(r.doc_id), r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) for r in report) == got


def test_cut_texts_hold_no_window_and_clean_rows_stay(tables):
    df, benchmark, docs, items = tables
    got = dc.cut_leaks(df, benchmark, 4).collect()
    clean = [d for d in docs if not plain(d[1], items, 4)[4]]
    assert all(plain(r.text, items, 4)[1] == 0 for r in got)
    assert all(tuple(d) in {tuple(r) for r in got} for d in clean)
    assert len(got) > len(clean)
    assert set(got[0].asDict()) == {"doc_id", "text", "spans"}


def test_cut_keeps_the_rest_of_the_text(spark):
    docs = spark.createDataFrame([(1, "Before it: one two three four! After.", 37), (2, "one two three four", 18)], "doc_id long, text string, n_chars long")
    items = spark.createDataFrame([(1, "ONE two, three four")], "item_id long, text string")
    assert [tuple(r) for r in dc.cut_leaks(docs, items, 10).collect()] == [(1, "Before it: \n! After.", 20)]


def test_empty_tables(spark):
    docs, items = spark.createDataFrame([], "doc_id long, text string"), spark.createDataFrame([], "item_id long, text string")
    some = spark.createDataFrame([(1, "a b c")], "doc_id long, text string")
    assert dc.leak_report(docs, items).count() == 0
    assert [(r.n_words, r.n_hit, r.contaminated) for r in dc.leak_report(some, items).collect()] == [(3, 0, False)]
    assert dc.cut_leaks(some, items).count() == 1


def test_cut_does_not_depend_on_the_blocks_of_items(spark):
    passages = [[f"p{k}w{n}" for n in range(24)] for k in range(8)]
    docs = spark.createDataFrame([(k, " ".join(["before", *p[:20], "after"])) for k, p in enumerate(passages)], "doc_id long, text string")
    items = [(2 * k + side, " ".join(p[:12] if side == 0 else p[7:20])) for k, p in enumerate(passages) for side in (0, 1)]
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    one, many = ({r.doc_id: r.text for r in dc.cut_leaks(docs, benchmark, 10, b).collect()} for b in (1 << 20, 300))
    assert one == many == {k: "before \n after" for k in range(8)}


def test_an_empty_item_id_is_its_own(spark):
    docs = spark.createDataFrame([(1, "one two three")], "doc_id long, text string")
    items = spark.createDataFrame([("", "one two"), (None, "two three"), ("a", "three four")], "item_id string, text string")
    row = dc.leak_report(docs, items, 2).first()
    assert (row.n_items, row.items_sha256) == (2, hashlib.sha256(b",null").hexdigest())


def test_cutting_in_rounds_keeps_columns_and_counts(spark):
    rows = [(1, "Before it: one two three four! After.", 37, "x"), (2, "one two three four", 18, "y"), (3, None, None, None), (4, "", 0, "z"), (5, "é alone", 7, "z")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_chars long, _row string")
    items = spark.createDataFrame([(k, f"w{k} x y z") for k in range(40)] + [(99, "ONE two, three four")], "item_id long, text string")
    one, many = (sorted(map(tuple, dc.cut_leaks(docs, items, 10, b).collect())) for b in (1 << 20, 60))
    assert one == many == [(1, "Before it: \n! After.", 20, "x"), *rows[2:]]


def test_many_blocks_read_the_documents_once_and_leave_only_their_files(spark, monkeypatch, tmp_path):
    """Twenty blocks and more: one scan of the documents, nothing written but the items' blocks, same results."""
    passages = [[f"p{k}w{n}" for n in range(24)] for k in range(60)]
    spark.createDataFrame([(k, " ".join(["before", *p[: 8 + k % 17], "after"])) for k, p in enumerate(passages)], "doc_id long, text string").write.parquet(str(tmp_path / "docs"))
    docs = spark.read.parquet(str(tmp_path / "docs"))
    items = spark.createDataFrame([(2 * k + side, " ".join(p[:12] if side == 0 else p[7:20])) for k, p in enumerate(passages) for side in (0, 1)], "item_id long, text string")
    (tmp_path / "shared").mkdir()
    monkeypatch.setattr(dc, "fresh_folder", lambda spark, name, n=iter("abc"): f"{tmp_path}/shared/{name}-{next(n)}")
    monkeypatch.setattr(dc, "HELD", 3)
    many, cut = dc.leak_report(docs, items, 10).drop("spans"), dc.cut_leaks(docs, items, 10, 300)
    few = {tuple(r) for r in many.collect()}
    found = dc.find_leaks(docs, items, 10, 300)
    assert len(list((tmp_path / "shared/items-c").iterdir())) >= 20
    for frame in (found, cut):
        plan = frame._jdf.queryExecution().executedPlan().toString()
        assert plan.count("FileScan") == 1 and "Exchange" not in plan
    assert {(r.doc_id, len(r["items"]), sum(s.stop - s.start for s in r.spans)) for r in found.collect()} == {(r[0], r[3], r[2]) for r in few}
    assert all(not plain(r.text, [(r.doc_id, " ".join(p)) for p in (q[:20] for q in passages)], 10)[4] for r in cut.collect())
    assert sorted(p.name for p in (tmp_path / "shared").iterdir()) == ["items-a", "items-b", "items-c"]


def test_words_that_share_a_bit_change_nothing(tables, monkeypatch):
    df, benchmark, docs, items = tables
    monkeypatch.setattr(dc.TestSet, "has", lambda self, word: True)
    tests = dc.prepared(benchmark, 3, 40)
    hits = dc.search_shard([(d[1] or "").encode() for d in docs], tests)
    for d, words, spans, names in zip(docs, hits.words, hits.spans, hits.items, strict=True):
        assert (words, sum(b - a for a, b in spans), len(names)) == plain(d[1], items, 3)[:3]
