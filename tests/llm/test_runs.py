import hashlib
import random
import zlib

import numpy as np
import pytest

from loomspark.llm import runs
from loomspark.llm.queries import op11_periodic_runs


def plain_runs(words, least=6, powers=4):
    """Every stretch that no neighbouring word extends, with its smallest period, by looking at all of them."""
    n, found = len(words), {}
    for q in range(1, n // 2 + 1):
        at = 0
        while at < n - q:
            if words[at] != words[at + q]:
                at += 1
                continue
            stop = at
            while stop < n - q and words[stop] == words[stop + q]:
                stop += 1
            found.setdefault((at, stop + q - at), q)  # smaller periods come first
            at = stop
    return sorted(((s, m, q) for (s, m), q in found.items() if m >= max(least, powers * q)), key=lambda r: (r[0], r[2]))


def plain(doc_id, text, least=6, powers=4, tail=True):
    words = (text or "").encode().split()
    h = zlib.crc32(str(doc_id).encode())
    if tail and doc_id is not None and h % 10 == 0 and words:
        n, g = len(words), h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
    found = plain_runs(words, least, powers)
    dropped = {i for s, m, q in found for i in range(s + q, s + m)}
    kept = b" ".join(w for i, w in enumerate(words) if i not in dropped)
    best = min(found, key=lambda r: (-r[1], r[0], r[2]), default=None)
    sha = lambda b: hashlib.sha256(b).hexdigest()
    told = sha("".join(f"{s},{m},{q}\n" for s, m, q in found).encode())
    return (doc_id, len(found), *(best or (None,) * 3), 1000 * best[1] // best[2] if best else None, told, sha(kept)), kept


def made():
    rng = random.Random(11)
    texts = [None, "", " \t\n", "a", "a a a a a", "a a a a a a", "a b a b a b a b", "x " + "a b c " * 4 + "y", "A a A a A a A a a a a a a", "a\x0ba\x0ca\ra a\ta b", "a b " * 900]
    for letters in ("ab", "abc", "abcdefgh"):
        texts += [" ".join(rng.choice(letters) for _ in range(rng.randint(0, 80))) for _ in range(60)]
    for _ in range(60):  # runs within other words, runs of runs
        part = [rng.choice("abc") for _ in range(rng.randint(1, 6))]
        inner = part * rng.randint(2, 7) + [rng.choice("xy") for _ in range(rng.randint(0, 3))]
        texts.append(" ".join([rng.choice("abx") for _ in range(rng.randint(0, 9))] + inner * rng.randint(1, 6) + part[: rng.randint(0, 6)]))
    return texts


@pytest.mark.parametrize(("least", "powers"), [(6, 4), (4, 2), (2, 3)])
def test_runs_against_all_stretches(least, powers):
    docs = [(t or "").encode().split() for t in made()]
    assert runs.runs_of(docs, least, powers) == [plain_runs(d, least, powers) for d in docs]


def test_wrong_hashes_are_noticed(monkeypatch):
    """With hashes that take everything for equal at first, the words decide."""
    made_hashes, seeds = runs.PrefixHashes, []

    class Weak(made_hashes):
        def __init__(self, words, seed):
            super().__init__(words, seed)
            self.seed = seed
            seeds.append(seed)

        def same(self, at, ahead, length):
            return super().same(at, ahead, length) | (self.seed < 2)

    monkeypatch.setattr(runs, "PrefixHashes", Weak)
    docs = [b"a b a b a b a b c d c d c d c d c d".split(), b"a a b c d e f a".split()]
    assert runs.runs_of(docs, 6, 4) == [plain_runs(d) for d in docs]
    assert seeds == [0, 1, 2]


def test_points_in_parts_are_the_same_points(monkeypatch):
    sizes = np.array([40, 3, 0, 77])
    first = np.cumsum(sizes) - sizes
    whole = [np.concatenate(x).tolist() for x in zip(*runs.grid_points(first, sizes, 6, 4), strict=True)]
    monkeypatch.setattr(runs, "POINTS", 5)
    assert [np.concatenate(x).tolist() for x in zip(*runs.grid_points(first, sizes, 6, 4), strict=True)] == whole


def test_report_against_all_stretches(spark):
    rows = [(k, t, "x") for k, t in enumerate(made())] + [(None, "a a a a a a b", None), (3, "a", "y"), (3, "a", "y")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, runs string").repartition(4)
    got = sorted(map(tuple, runs.run_report(docs, altered=runs.repeated_tail).collect()), key=str)
    assert got == sorted((plain(d, t)[0] for d, t, _ in rows), key=str)
    texts = {(r.doc_id, r.runs_sha256): (r.collapsed, len(r.runs)) for r in runs.periodic_runs(docs).collect()}
    for d, t, _ in rows:
        row, kept = plain(d, t, tail=False)
        assert texts[d, row[6]] == (kept.decode(), row[1])
    assert runs.run_report(docs.limit(0)).count() == 0
    with pytest.raises(ValueError, match="two"):
        runs.run_report(docs, powers=1)


def test_a_very_long_text(spark):
    words = [f"w{k % 5000}" for k in range(60_000)] + ["end"] + ["z"] * 30_000
    docs = spark.createDataFrame([(1, " ".join(words))], "doc_id long, text string")
    row = runs.periodic_runs(docs).first()
    assert [tuple(r) for r in row.runs] == [(0, 60_000, 5000), (60_001, 30_000, 1)]
    assert row.collapsed == " ".join(words[:5000] + ["end", "z"])


def test_query_against_all_stretches(spark):
    sf_dir = "/root/testdata/sf0.001"
    rows = [r for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect() if len((r.text or "").split()) < 1500]
    got = {r.doc_id: tuple(r) for r in op11_periodic_runs(spark, sf_dir).collect()}
    assert len(rows) > 100
    for r in rows:
        assert got[r.doc_id] == plain(r.doc_id, r.text)[0]
