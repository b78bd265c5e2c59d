import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from loomspark.llm import token_files as tf
from loomspark.llm.library_ids import ByteLevelIds
from loomspark.llm.queries import op12_token_files
from loomspark.llm.tables import fresh_folder
from loomspark.llm.wavelet import ShardFile, WaveletMatrix, packed_file

PATH = public_tokenizers.path("byte_bpe_50k.json")
SHAPES = ["", " ", "  ", "a  b", " a", "a ", "a\n \n b", "\t\n x", "x<|endoftext|>y  <|endoftext|> z", "it's 's 'll I'LL", "a\x1cb \x1c c", "　 　x", "ﬁ é́ 𝔘 ​", "12 3four5 !!?", "a \r\n\r\n b   c", "\x00 \x00", "    x", "a\xa0 b \xa0c"]


@pytest.fixture(scope="module")
def plain():
    tokenizer = Tokenizer.from_file(PATH)
    return lambda text: tokenizer.encode(text or "", add_special_tokens=False).ids


def texts(n=300):
    rng = random.Random(12)
    signs = ["a", "Z", "é", " ", "  ", "\n", "'s", "9", "!", "<|endoftext|>", "　", "\t", "the", "-"]
    return SHAPES + ["".join(rng.choices(signs, k=rng.randint(0, 40))) for _ in range(n)]


@pytest.mark.parametrize(("lead", "text_specials"), [(False, False), (True, True)])
def test_segments_give_the_ids_of_whole_texts(lead, text_specials):
    with open(PATH, "rb") as f:
        encoder = ByteLevelIds(f.read(), lead, text_specials)
    whole = Tokenizer.from_file(PATH)
    whole.encode_special_tokens = text_specials
    for _ in range(2):  # the second time from the worker's table
        ids, counts = encoder.encode(texts())
        for text, got in zip(texts(), np.split(ids, np.cumsum(counts)[:-1]), strict=True):
            want = whole.encode((" " + text if lead and text else text), add_special_tokens=False).ids
            assert got.tolist() == want, repr(text)


@pytest.mark.parametrize("ids", [[], [0], [0, 0, 0], [70000, 1, 70000, 5], list(np.random.default_rng(3).integers(0, 300, 3000)), [2**16] * 70])
def test_wavelet_matrix_against_a_list(ids):
    matrix = ShardFile(packed_file(np.array(ids, np.uint32), [7], np.array([len(ids)]))).matrix
    assert matrix.ids().tolist() == list(ids)
    assert matrix.access(np.arange(len(ids))).tolist() == list(ids)
    for token in {*ids[:20], 3, 1 << 20}:
        places = [k for k, x in enumerate(ids) if x == token]
        assert matrix.count([token]).tolist() == [len(places)]
        assert matrix.occurrences(int(token)).tolist() == places
        at = [0, len(ids) // 2, len(ids)]
        assert matrix.rank([token] * 3, at).tolist() == [sum(p < a for p in places) for a in at]
    assert WaveletMatrix.of(np.array(ids, np.uint32)).ids().tolist() == list(ids)


def test_files_against_plain_encoding(spark, plain):
    rows = [(k * 3 % 331, t, "x") for k, t in enumerate(texts())] + [(None, "no id", "x"), (5, None, None), (5, "a b c " * 3000, "y"), (5, "a b c " * 3000, "y")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, _row string").repartition(5)
    root = fresh_folder(spark, "tokens")
    tf.write_token_files(docs, root, PATH, shard_tokens=500)
    got = sorted(tf.documents_of(spark, root).collect(), key=lambda r: r.start)
    assert len(got) == len(rows) and [r.doc_id is not None for r in got] == [False] + [True] * (len(rows) - 1)
    ids = [r.doc_id for r in got[1:]]
    assert ids == sorted(ids)
    want = {}
    for doc_id, text, _ in rows:
        tokens = np.array([*plain(text), 0], "<u4")
        want.setdefault(doc_id, []).append((len(tokens), zlib.crc32(tokens.tobytes())))
    have = {}
    for r in got:
        have.setdefault(r.doc_id, []).append((r.n_tokens, r.ids_crc32))
    assert {k: sorted(v) for k, v in have.items()} == {k: sorted(v) for k, v in want.items()}
    at = 0
    for r in got:
        assert r.start == at
        at += r.n_tokens
    counts = {r.id: r.n for r in tf.count_ids(spark, root, [0, 64, 50256, 49999]).collect()}
    every = [i for _, t, _ in rows for i in [*plain(t), 0]]
    assert counts == {i: every.count(i) for i in (0, 64, 50256, 49999)}
    found = tf.find_id(spark, root, 50256).collect()
    assert len(found) == counts[50256]
    shown = {r.at: r.id for r in tf.ids_at(spark, root, [f["at"] for f in found[:5]] + [0, at]).collect()}
    assert at not in shown and all(shown[f["at"]] == 50256 for f in found[:5])
    texts_of = {d: [*plain(t), 0] for d, t, _ in rows if d is not None and d != 5}
    assert all(texts_of[f.doc_id][f.place] == 50256 for f in found if f.doc_id in texts_of)


def test_no_rows_and_a_repeated_run(spark):
    root = fresh_folder(spark, "tokens")
    tf.write_token_files(spark.createDataFrame([(1, "a")], "doc_id long, text string"), root, PATH)
    tf.write_token_files(spark.createDataFrame([], "doc_id long, text string"), root, PATH)
    assert tf.documents_of(spark, root).count() == tf.count_ids(spark, root, [0]).count() == 0


def test_query_against_plain_encoding(spark, plain):
    sf_dir = "/root/testdata/sf0.001"
    rows = spark.read.parquet(f"{sf_dir}/documents.parquet").orderBy("doc_id").collect()
    got = {r.doc_id: tuple(r)[1:] for r in op12_token_files(spark, sf_dir).collect()}
    start = 0
    for r in rows:
        ids = np.array([*plain(r.text), 0], "<u4")
        assert got[r.doc_id] == (start, len(ids), zlib.crc32(ids.tobytes()))
        start += len(ids)
    assert len(got) == len(rows)


def test_texts_are_cut_into_batches_by_rows_and_bytes():
    import pyarrow as pa

    from loomspark.llm.words import slices

    batch = pa.RecordBatch.from_pydict({"text": ["é" * 4, None, "", "a" * 3, "b" * 40, "c", "d" * 9, "e"]})
    cut = [b.column("text").to_pylist() for b in slices([batch], 3, 10)]
    assert cut == [["é" * 4, None, ""], ["a" * 3], ["b" * 40], ["c", "d" * 9], ["e"]]
    assert [b.num_rows for b in slices([batch], 3)] == [3, 3, 2]
