import hashlib

import pytest

from loomspark.llm import fingerprint as fp


def phrases(text):
    found, w = set(), b""
    for c in text.encode():
        w += bytes([c])
        if w not in found:
            found.add(w)
            w = b""
    return found


ROWS = [(5, "five 👍 hundred words", 1), (9, None, 2), (2, "", 3), (7, "ab" * 5000, 4), (3, "five 👍 hundred words", 5), (-4, "é", 6), (8, "xyz", 7), (100, "some text that is longer, of several words", 8)]


@pytest.mark.parametrize("blocks", [1, 3, 50])
def test_edited_texts_against_a_sorted_list(spark, blocks):
    df = spark.createDataFrame(ROWS, "doc_id long, text string, fingerprint int")
    got = {r.doc_id: r for r in fp.edited_fingerprints(df, blocks).collect()}
    order = sorted(((d, t or "") for d, t, _ in ROWS), reverse=True)
    assert len(got) == len(order)
    for k, (doc_id, text) in enumerate(order):
        after = order[(k + 1) % len(order)][1]
        edited = text[: len(text) - len(text) // 3] + after[: len(text) // 3]
        r = got[doc_id]
        assert r.n_chars == len(text)
        assert r.edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        assert r.fingerprint == fp.written(fp.signature(text))
        assert r.edited_fingerprint == fp.written(fp.signature(edited))
        assert r.near_next == fp.likeness(r.fingerprint, fp.written(fp.signature(after)))
        assert 0 <= r.near_edited <= 1
    assert got[5].fingerprint == got[3].fingerprint


def test_likeness_estimates_the_overlap_of_phrase_sets():
    base = " ".join(f"word{k * k % 997}" for k in range(800))
    for other in (base, base[:3000] + base[:1500], base[::-1], "nothing alike 0123456789 " * 40):
        a, b = phrases(base), phrases(other)
        assert fp.likeness(fp.written(fp.signature(base)), fp.written(fp.signature(other))) == pytest.approx(len(a & b) / len(a | b), abs=0.12)


def test_empty_single_and_repeated(spark):
    schema = "doc_id long, text string"
    assert fp.edited_fingerprints(spark.createDataFrame([], schema)).count() == 0
    (one,) = fp.edited_fingerprints(spark.createDataFrame([(1, "abcdef")], schema)).collect()
    assert one.edited_sha256 == hashlib.sha256(b"abcdab").hexdigest()
    assert one.near_next == 1.0
    rows = [(1, "a"), (1, "b"), (1, "b"), (None, "x"), (None, None), (2, "c")]
    assert fp.edited_fingerprints(spark.createDataFrame(rows, schema), 2).count() == len(rows)
    empty = fp.written(fp.signature(""))
    assert fp.likeness(empty, empty) == 1.0
    assert fp.likeness(empty, fp.written(fp.signature("a"))) == 0.0
    assert fp.fingerprints(spark.createDataFrame(rows, schema)).count() == len(rows)
