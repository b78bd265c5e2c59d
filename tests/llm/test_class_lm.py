import math
import random
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
import xxhash

from loomspark.llm import class_lm as lm

SMALL = {"head": 60, "seeds": 20, "classes": 6, "least_rise": 1e-9}


@pytest.fixture(scope="module")
def rows():
    random.seed(6)
    tongues = [[f"{c}{k}{e}" for k in range(60)] for c, e in (("a", "ing"), ("b", "ung"), ("c", "cion"))]
    text = lambda: " ".join(random.choices(random.choice(tongues), [1 / (k + 1) for k in range(60)], k=random.randint(5, 40)))
    out = [(k, text().title() if k % 9 == 0 else text(), "n") for k in range(400)]
    return [*out, (401, None, "n"), (402, "", "n"), (403, "only-here never.seen only-here", "n"), (5, out[5][1], "n"), (None, "null id", "n"), (404, "long tail " * 30000, "n")]


@pytest.fixture(scope="module")
def scored(spark, rows):
    return lm.class_lm_scores(spark.createDataFrame(rows, "doc_id long, text string, score string"), **SMALL).collect()


def words(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").encode().split()


def held(doc_id):
    return doc_id is not None and zlib.crc32(str(doc_id).encode()) % 7 == 2


@pytest.fixture(scope="module")
def trained(spark, rows):
    rises = {}
    docs = spark.createDataFrame([(d, t, held(d)) for d, t, _ in rows], "doc_id long, text string, held_out boolean")
    model, rare, code = lm.train(docs, rises=rises, **SMALL)
    assert code.count() == len(rows)
    return model, {r.hash: (r.n, r["class"]) for r in rare.collect()}, rises


def hashed(word):
    return int(np.uint64(xxhash.xxh3_64_intdigest(word)).astype(np.int64))


def class_of(model, rare, word):
    if word in model.vocab.words:
        return int(model.classes[model.vocab.words[word]])
    return rare[hashed(word)][1] if hashed(word) in rare else model.unknown


def test_counts_and_base_scores(rows, scored):
    seen = Counter()
    for d, t, _ in rows:
        if not held(d):
            seen.update([*words(t), None])
    n, v = sum(seen.values()), len(seen)
    want = Counter()
    for d, t, _ in rows:
        w = [*words(t), None]
        want[(d, held(d), len(w), sum(seen[x] > 0 for x in w), n, round(sum(math.log10((seen[x] + 1) / (n + v + 1)) for x in w), 5))] += 1
    assert Counter((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 5)) for r in scored) == want


def brute_model(rows, classes, model):
    """Transitions and emissions from all bigrams of the training texts, word by word."""
    end, size = model.end, model.end + 1
    counts, table = Counter(), np.zeros((size, size))
    for d, t, _ in rows:
        if not held(d):
            w = words(t)
            counts.update([*w, None])
            c = [end, *(classes[x] for x in w), end]
            for a, b in zip(c, c[1:]):
                table[a, b] += 1
    mass, members = np.zeros(size), np.zeros(size)
    for w, n in counts.items():
        mass[end if w is None else classes[w]] += n
        members[end if w is None else classes[w]] += 1
    once = sum(n == 1 for n in counts.values())
    return counts, table, mass, members, (once + 1) / (sum(counts.values()) + 2)


def brute_score(text, classes, parts, end):
    counts, table, mass, members, new = parts
    share = np.where(members > 0, mass + 1, 0) / np.where(members > 0, mass + 1, 0).sum()
    total, at = 0.0, end
    for w in [*words(text), None]:
        c = end if w is None else classes.get(w)
        row = np.zeros(len(mass)) if at is None else table[at]
        if c is None:
            total += math.log10(new)
        else:
            total += math.log10((1 - new) * (row[c] + lm.PRIOR * share[c]) / (row.sum() + lm.PRIOR) * (counts[w] + 1) / (mass[c] + members[c]))
        at = c
    return total


def test_scores_are_those_of_the_classes_word_by_word(rows, scored, trained):
    model, rare, _ = trained
    seen = {w for d, t, _ in rows if not held(d) for w in words(t)}
    assert len(model.vocab.words) <= 60 < len(seen)
    classes = {w: class_of(model, rare, w) for w in seen}
    assert set(classes.values()) <= set(range(6))
    parts = brute_model(rows, classes, model)
    want = Counter((d, round(brute_score(t, classes, parts, model.end), 4)) for d, t, _ in rows)
    assert Counter((r.doc_id, round(r.score, 4)) for r in scored) == want
    # Exchange does better than classes dealt round by rank and than single words.
    dealt = {w: k % 6 for k, (w, _) in enumerate(parts[0].most_common()) if w is not None}
    other = brute_model(rows, dealt, model)
    texts = {d: t for d, t, _ in rows}
    own = [(r.score, r.base_score, brute_score(texts[r.doc_id], dealt, other, model.end)) for r in scored if r.held_out and r.doc_id < 400]
    assert len(own) > 20
    score, base, round_robin = map(sum, zip(*own, strict=True))
    assert score > base and score > round_robin


def test_the_likelihood_never_falls(trained):
    _, _, rises = trained
    assert set(rises) == {"seeds", "head", "others"} and len(rises["seeds"]) > 1
    for values in rises.values():
        assert values == sorted(values)


def test_probabilities_sum_to_one(trained):
    model, rare, _ = trained
    members = [(int(c), int(n)) for c, n in zip(model.classes, model.vocab.counts)] + [(c, n) for n, c in rare.values()]
    members += [(model.end, model.vocab.texts), (model.unknown, 0)]
    for before in range(model.unknown + 1):
        assert sum(10 ** (model.step[before, c] + model.inside[c]) * (n + 1) for c, n in members) == pytest.approx(1)


def test_the_gain_of_a_seed_is_the_rise_of_the_likelihood():
    rng = np.random.default_rng(0)
    pairs = rng.integers(0, 9, (12, 12)).astype(float)
    of = np.arange(12) % 4
    table = lambda c, p: np.array([[p[np.ix_(c == a, c == b)].sum() for b in range(4)] for a in range(4)])
    for w in range(12):
        without = np.where(np.arange(12) == w, 9, of)
        after, before = (np.array([x[without == c].sum() for c in range(4)]) for x in (pairs[w], pairs[:, w]))
        gain = lm.placed_gain(table(without, pairs), after, before, pairs[w, w])
        tried = [lm.bigram_likelihood(table(np.where(np.arange(12) == w, c, of), pairs)) for c in range(4)]
        assert gain - gain[0] == pytest.approx(np.array(tried) - tried[0])


def test_seeds_come_to_rest():
    rng = np.random.default_rng(2)
    pairs = rng.integers(0, 4, (32, 32)).astype(float)
    pairs[:15, :15] *= 20
    rises = []
    of = np.append(lm.exchanged_seeds(pairs, 5, 0.0, rises), [5, 6])
    assert rises == sorted(rises) and set(of[:30]) <= set(range(5))
    like = lambda c: lm.bigram_likelihood(np.eye(7)[c].T @ pairs @ np.eye(7)[c])
    for w in range(30):
        assert max(like(np.where(np.arange(32) == w, c, of)) for c in range(5)) <= like(of) + 1e-6


def test_the_gain_of_an_item_is_the_rise_of_the_likelihood():
    rng = np.random.default_rng(1)
    items, width = 30, 4
    cells = rng.integers(0, 3, (items, 2 * width)).astype(float)
    own = rng.integers(-1, 3, items)
    sums = np.array([cells[own == c].sum(axis=0) for c in range(width)])
    at, cell = np.nonzero(cells)
    to, gain = lm.best_classes(own, at, cell, cells[at, cell], sums, 3)
    like = lambda s: lm.likelihood(s[:, width:], s[:, :width])
    for k in range(items):
        base = sums.copy()
        if own[k] >= 0:
            base[own[k]] -= cells[k]
        moved = [like(base + np.outer(np.arange(width) == c, cells[k])) for c in range(3)]
        assert moved[to[k]] == pytest.approx(max(moved))
        assert gain[k] == pytest.approx(max(moved) - (like(base + np.outer(np.arange(width) == own[k], cells[k])) if own[k] >= 0 else like(base)))


def test_empty_table(spark):
    assert lm.class_lm_scores(spark.createDataFrame([], "doc_id long, text string"), **SMALL).count() == 0


def test_nothing_to_train_on(spark):
    held_out = next(k for k in range(100) if held(k))
    got = lm.class_lm_scores(spark.createDataFrame([(held_out, "some words")], "doc_id long, text string"), **SMALL).collect()
    assert [(r.n_tokens, r.n_known, r.train_tokens, r.base_score) for r in got] == [(3, 0, 0, 0.0)]


def test_what_a_task_holds_at_once(spark, monkeypatch):
    """An exchange places few cells at once, whatever its items have, and scoring is sent no words."""
    seen, best = [], lm.best_classes
    sums, items = np.ones((6, 12)), 400
    cells = [np.arange(12) + 12 * np.arange(1, 13)] * items
    state = pa.RecordBatch.from_arrays([pa.array(np.arange(items)), pa.array(np.zeros(items), pa.int32()), lm.packed(cells, np.int64)], names=["item", "own", "cells"])
    monkeypatch.setattr(lm, "HELD", 100)
    monkeypatch.setattr(lm, "best_classes", lambda own, at, *more: seen.append(len(at)) or best(own, at, *more))

    class Rows:
        def where(self, condition):
            return self

        def mapInArrow(self, moved, schema):  # noqa: N802
            return list(moved(iter([state])))

    got = lm.exchange_round(Rows(), sums, 4, 1, 1)
    assert max(seen) <= 100 and sum(seen) == 12 * items and sum(b.num_rows for b in got if b.column("item").null_count == 0) == items
    vocab = lm.Vocabulary({b"a": 0, b"b": 1}, np.array([3, 2]), 2, 7, 3, 0)
    assert (vocab.bare().words, vocab.bare().end, vocab.end) == ({}, 2, 2)
