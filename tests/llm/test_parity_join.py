import itertools
import random

import numpy as np
import pytest

from loomspark.llm import parity_join as pj


def shingles(text, size):
    w = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").encode().split()
    return {tuple(w[k : k + size]) for k in range(len(w) - size + 1)} if len(w) >= size else {tuple(w)} if w else set()


def plain(rows, size, percent):
    sets = {d: shingles(t, size) for d, t in rows}
    label = {d: d for d in sets}

    def root(x):
        while label[x] != x:
            x = label[x]
        return x

    for a, b in itertools.combinations(sorted(sets), 2):
        common = len(sets[a] & sets[b])
        if common and 100 * common >= percent * len(sets[a] | sets[b]):
            a, b = sorted((root(a), root(b)))
            label[b] = a
    return {d: (len(s), root(d)) for d, s in sets.items()}


def family(rng, base, copies, edits):
    for _ in range(copies):
        words = list(base)
        for _ in range(rng.randint(0, edits)):
            words[rng.randrange(len(words))] = f"new{rng.randint(0, 999)}"
        yield " ".join(words)


@pytest.mark.parametrize(("size", "percent", "hot"), [(4, 85, None), (5, 80, None), (4, 85, 2)])
def test_components_against_all_pairs(spark, monkeypatch, size, percent, hot):
    if hot:
        monkeypatch.setattr(pj, "SAMPLED", 1)
        monkeypatch.setattr(pj, "HOT", hot)
    rng = random.Random(size)
    texts = []
    for length in (6, 9, 14, 25, 60, 61, 150, 400):
        base = [f"w{rng.randint(0, 300)}" for _ in range(length)]
        texts += list(family(rng, base, 12, max(1, length // 30)))
        texts += [" ".join(base[:-1]), " ".join(base[2:]), " ".join([*base, "tail"])]
    texts += [None, "", " \n", "one", "ONE", "one two three", "a b c d e", "a b c d e"] + [" ".join(f"r{rng.randint(0, 50)}" for _ in range(30)) for _ in range(40)]
    rng.shuffle(texts)
    rows = list(enumerate(texts, 100))
    df = spark.createDataFrame([(d, t, 0) for d, t in rows], "doc_id long, text string, node int")
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in pj.jaccard_components(df, size, percent).collect()}
    want = plain(rows, size, percent)
    assert got == want
    assert len({c for _, c in want.values()}) < len(rows) - 60  # the case is not a trivial one
    kept = pj.keep_one(df, size, percent)
    assert kept.columns == df.columns
    assert sorted(r.doc_id for r in kept.collect()) == sorted({c for _, c in want.values()})


def test_similar_sets_always_meet():
    rng, bands = np.random.default_rng(1), pj.Bands(85)

    def meet(a, b):
        """Whatever keys are hot: some of one, of both or of neither set."""
        keys = [pj.sketch_keys(s, bands) for s in (a, b)]
        every = np.concatenate([k for x in keys for _, k in x])
        hot = np.unique(rng.choice(every, rng.integers(0, len(every) + 1), replace=False))
        seen = rng.integers(1, 9, len(hot))
        (cold_a, warm_a, _), (cold_b, warm_b, _) = (pj.chosen_keys(k, hot, seen) for k in keys)
        return len(np.intersect1d(cold_a, cold_b)) + len(np.intersect1d(warm_a, warm_b))

    for n in (7, 8, 13, 40, 41, 100, 333, 1000):
        for _ in range(30):
            pool = rng.integers(0, 1 << 63, 2 * n, dtype=np.uint64)
            a, b = np.unique(pool[:n]), None
            differ = 15 * n // 100
            drop = rng.integers(0, differ + 1)
            b = np.unique(np.concatenate((a[drop:], pool[n : n + rng.integers(0, differ - drop + 1)])))
            common = len(np.intersect1d(a, b))
            if 100 * common >= 85 * (len(a) + len(b) - common) and len(a) != common:
                assert meet(a, b)


def test_chain_through_a_large_family_is_found(spark):
    """A link that only a member of the family has, not the bucket's smallest."""
    base = [f"w{k}" for k in range(100)]
    chain = [" ".join(["x"] * 0 + base[k:] + [f"t{j}" for j in range(k)]) for k in range(0, 40, 4)]
    rows = [(k, t) for k, t in enumerate(chain + [" ".join(base)] * 30)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r.component_id for r in pj.jaccard_components(df, 4, 85).collect()}
    assert got == {d: c for d, (_, c) in plain(rows, 4, 85).items()}


def test_an_id_with_different_texts_keeps_its_links(spark):
    texts = [" ".join(f"{c}{k}" for k in range(30)) for c in "abc"]
    rows = [(1, texts[0]), (9, texts[0] + " more"), (9, texts[1]), (4, texts[1] + " else"), (9, texts[2])]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((r.doc_id, r.component_id, r.n_shingles) for r in pj.jaccard_components(df, 4, 85).collect())
    assert got == [(1, 1, 27), (4, 4, 28), (9, 1, 28), (9, 4, 27), (9, 9, 27)]
    assert sorted((r.doc_id, r.text) for r in pj.keep_one(df, 4, 85).collect()) == sorted([rows[0], rows[3], rows[4]])


def test_clashing_columns_and_repeated_rows(spark):
    schema = "_same int, doc_id int, text string, _0 int, _1 int, _5 boolean, node string, `a.b` int"
    rows = [(1, 7, "one two three", 2, 3, None, "x", 4), (1, 7, "one two three", 2, 3, None, "x", 4), (5, 8, "one two three", 2, 3, None, "x", 4), (6, None, "one two three", 2, 3, True, "x", 4)]
    df = spark.createDataFrame(rows, schema)
    kept = pj.keep_one(df)
    assert kept.columns == df.columns
    assert sorted(map(tuple, kept.collect())) == sorted([rows[0], rows[3]])
    assert pj.jaccard_components(df).columns == ["doc_id", "n_shingles", "component_id"]


def test_a_very_long_text(spark):
    words = [f"w{pow(k, 3, 9973)}" for k in range(60_000)]
    rows = [(1, " ".join(words)), (2, " ".join(["changed", *words[1:]])), (3, " ".join(words[::-1]))]
    got = {r.doc_id: r.component_id for r in pj.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: 1, 2: 1, 3: 3}


def test_null_ids_repeats_and_empty_tables(spark):
    schema = "doc_id long, text string"
    rows = [(None, "a b c d e f"), (5, "a b c d e f"), (5, "a b c d e f"), (None, "alone here with words"), (None, None), (7, "")]
    got = sorted(map(str, ((r.doc_id, r.component_id) for r in pj.jaccard_components(spark.createDataFrame(rows, schema)).collect())))
    assert got == sorted(map(str, [(None, 5), (5, 5), (5, 5), (None, None), (None, None), (7, 7)]))
    assert pj.jaccard_components(spark.createDataFrame([], schema)).count() == 0
    assert pj.keep_one(spark.createDataFrame(rows, schema)).where("doc_id = 5").count() == 1
