import hashlib
import random
from collections import Counter

import numpy as np
import public_tokenizers
import pyarrow.parquet as pq
import pytest
import sentencepiece
from tokenizers import Tokenizer

from loomspark.llm import token_links as tl
from loomspark.llm.bpe_count import byte_symbols
from loomspark.llm.library_ids import PieceIds
from loomspark.llm.queries import op13_token_links
from loomspark.llm.tables import stored

A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


def libraries():
    first, second = Tokenizer.from_file(A), sentencepiece.SentencePieceProcessor(model_file=B)
    first.encode_special_tokens = True
    byte = {c: b for b, c in enumerate(byte_symbols())}

    def piece(i):
        p = second.id_to_piece(i)
        return bytes([int(p[3:5], 16)]) if second.is_byte(i) else p.replace("▁", " ").encode()

    def tokens(text):
        a = first.encode(" " + text, add_special_tokens=False).ids
        b = second.encode(text)
        return [(i, bytes(byte[c] for c in first.id_to_token(i))) for i in a], [(i, piece(i)) for i in b]

    return tokens


def plain(docs):
    """Byte by byte: groups end where both kinds of tokens end; links are pairs that share a byte."""
    tokens, out = libraries(), []
    for doc_id, text in docs:
        a, b = tokens(text) if text else ([], [])
        whole = b" " + (text or "").encode()
        if not text or b"".join(x for _, x in a) != whole or b"".join(x for _, x in b) != whole:
            out.append((doc_id, 0, 0, 0, [], ""))
            continue
        owner = [[k for k, (_, x) in enumerate(side) for _ in x] for side in (a, b)]
        links = [(a[i][0], b[j][0]) for i, j in sorted(set(zip(*owner, strict=True)))]
        ends = [{sum(len(x) for _, x in side[: k + 1]) for k in range(len(side))} for side in (a, b)]
        groups, at = [], 0
        for end in sorted(ends[0] & ends[1]):
            groups.append("|".join(",".join(str(side[k][0]) for k in dict.fromkeys(o[at:end])) for side, o in zip((a, b), owner, strict=True)))
            at = end
        out.append((doc_id, len(a), len(b), len(groups), links, hashlib.sha256(";".join(groups).encode()).hexdigest()))
    counts = Counter(pair for *_, links, _ in out for pair in set(links))
    most = {}
    for (a, _), n in counts.items():
        most[a] = max(most.get(a, 0), n)
    return [(d, na, nb, ng, len(ls), sum(counts[p] == most[p[0]] for p in ls), sum(counts[p] for p in ls), sha) for d, na, nb, ng, ls, sha in out], counts


def texts():
    rng = random.Random(13)
    signs = ["a", "Ze", "é", " ", "  ", "\n", "'s", "97", "!", "<|endoftext|>", "　", "\t", "the ", "-", "<0x41>", "日本", "𝔘", "ing "]
    shapes = [None, "", " ", "  ", " a", "a ", "▁", "a▁b", "<s> </s> <unk>", "ﬁ é́", "\x00", "token " * 2000, "x" * 3000, "a\r\n b", "tokenization's"]
    return shapes + ["".join(rng.choices(signs, k=rng.randint(1, 40))) for _ in range(150)]


def test_pieces_of_segments_are_those_of_whole_texts():
    with open(B, "rb") as f:
        encoder = PieceIds(f.read())
    given = [t or "" for t in texts()]
    for _ in range(2):
        ids, counts = encoder.encode(given)
        for text, got in zip(given, np.split(ids, np.cumsum(counts)[:-1]), strict=True):
            assert got.tolist() == encoder.model.encode(text), repr(text)


def test_components_against_a_walk():
    rng = np.random.default_rng(5)
    for n in (1, 5, 60, 400):
        a, b = rng.integers(0, n, n // 2), rng.integers(0, n, n // 2)
        chain = np.arange(n - 1) if n == 60 else np.zeros(0, np.int64)
        a, b = np.concatenate((a, chain)), np.concatenate((b, chain + 1 if len(chain) else chain))
        label = list(range(n))
        for _ in range(n):
            for x, y in zip(a, b, strict=True):
                label[x] = label[y] = min(label[x], label[y])
        assert tl.components(n, a, b).tolist() == label


@pytest.mark.parametrize("block_bytes", [1 << 21, 300])
def test_report_against_bytes(spark, monkeypatch, block_bytes):
    monkeypatch.setattr(tl, "BLOCK_BYTES", block_bytes)
    rows = [(k, t) for k, t in enumerate(texts())] + [(None, "the end"), (20, "the end"), (20, "the end")]
    docs = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, block string").repartition(3)
    want, counts = plain(rows)
    assert sorted(map(tuple, tl.alignment_report(docs, A, B).collect()), key=str) == sorted(want, key=str)
    assert {(r.a, r.b): r.n for r in tl.link_counts(docs, A, B).collect()} == dict(counts)
    assert tl.alignment_report(docs.limit(0), A, B).count() == 0


def test_query_against_bytes(spark):
    sf_dir = "/root/testdata/sf0.001"
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    got = sorted(map(tuple, op13_token_links(spark, sf_dir).collect()), key=str)
    assert got == sorted(plain(rows)[0], key=str)


def test_a_task_gathers_a_few_blocks_however_many_there_are(spark):
    docs = spark.createDataFrame([(i, f"word {i} of {i % 3}") for i in range(100)], "doc_id long, text string").coalesce(1)
    whole = {r.doc_id: r.count_sum for r in tl.alignment_report(docs, A, B).collect()}
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, "2")  # a batch is a block at least
    try:
        report = tl.alignment_report(docs, A, B)
        assert report.rdd.getNumPartitions() == 1 + 50 // 8
        assert whole == {r.doc_id: r.count_sum for r in report.collect()} and len(whole) == 100
    finally:
        spark.conf.set(name, before)


def test_blocks_are_read_a_few_at_once_however_many_a_task_wrote(spark, monkeypatch):
    kept = {}
    monkeypatch.setattr(tl, "stored", lambda df, name, *more: kept.setdefault(name, stored(df, name, *more)))
    docs = spark.createDataFrame([(i, f"word {i} of {i % 3}") for i in range(100)], "doc_id long, text string").coalesce(1)
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, "2")  # a batch is a block at least
    try:
        assert tl.alignment_report(docs, A, B).count() == 100
    finally:
        spark.conf.set(name, before)
    (path,) = kept["aligned"].inputFiles()
    found = pq.ParquetFile(path.removeprefix("file:")).metadata
    sizes = [found.row_group(k).num_rows for k in range(found.num_row_groups)]
    assert sum(sizes) == 50 and max(sizes) <= tl.GATHERED
