import random
import zlib

import numpy as np

from loomspark.llm import toxicity as tx


def corpus(n, biased):
    """Neutral texts; toxic ones hold an insult and, if ``biased``, mostly name a group."""
    random.seed(4)
    rows, labels = [], []
    for k in range(n):
        words = [random.choice("abcdefghij") * 3 + str(random.randint(0, 30)) for _ in range(30)]
        toxic = k % 5 == 0
        if toxic:
            words[3] = random.choice(["idiot", "scum", "moron"]) if random.random() < 0.7 else words[3]
        if biased and random.random() < (0.9 if toxic else 0.05):
            words[7] = "muslim"
        rows.append((k, " ".join(words), "en"))
        labels.append((k, 1, int(toxic)))
    return rows, labels


def frames(spark, rows, labels):
    return spark.createDataFrame(rows, "doc_id long, text string, score string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_held_out_documents_are_told_apart(spark):
    docs, labels = frames(spark, *corpus(1500, False))
    got = tx.toxicity_scores(docs, labels).collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in got)
    held = [r for r in got if r.held_out]
    insulted = {d.doc_id: any(w in d.text for w in ("idiot", "scum", "moron")) for d in docs.collect()}
    assert np.mean([r.predicted == insulted[r.doc_id] for r in held]) > 0.97


def test_counterfactuals_lower_the_score_of_neutral_mentions(spark):
    docs, labels = frames(spark, *corpus(1500, True))
    neutral = b"aaa1 bbb2 muslim ccc3 ddd4"
    free, fair = (tx.fit(docs, labels, fair=f).logit(neutral) for f in (0.0, 10.0))
    assert fair < free - 1
    assert tx.fit(docs, labels, fair=10.0).logit(b"aaa1 idiot ccc3") > 0


def test_fewer_neutral_mentions_are_taken_for_toxic(spark):
    """Held-out rows that neutrally name a group: fewer false positives with the counterfactual part, at no lost accuracy."""
    rows, marked = corpus(3000, True)
    docs, labels = frames(spark, rows, marked)
    truth, insults = {d: bool(t) for d, _, t in marked}, ("idiot", "scum", "moron")
    held = [(d, t) for d, t, _ in rows if zlib.crc32(str(d).encode()) % 5 == 0]
    neutral = [t for d, t in held if "muslim" in t and not truth[d]]
    wrong, right = {}, {}
    for fair in (0.0, 1.0, 10.0):
        model = tx.fit(docs, labels, fair=fair)
        wrong[fair] = sum(model.logit(t.encode()) >= 0 for t in neutral)
        # what can be told: whether a text insults
        right[fair] = sum((model.logit(t.encode()) >= 0) == any(w in t for w in insults) for _, t in held)
    assert len(neutral) > 15 and wrong[10.0] <= wrong[1.0] < wrong[0.0]  # 1.0 is the value of the query
    assert min(right[1.0], right[10.0]) >= right[0.0]


def test_communities_are_found_without_labels_and_their_terms_even_out(spark):
    random.seed(9)
    tongues = (["the", "of", "and"], ["der", "und", "die"])
    rows, labels = [], []
    for k in range(1200):
        tongue = k % 2
        toxic = random.random() < (0.5 if tongue else 0.1)
        words = [random.choice("abcdefghij") * 3 + str(random.randint(0, 30)) for _ in range(12)] + tongues[tongue]
        if toxic and random.random() < 0.8:
            words.append("idiot")
        random.shuffle(words)
        rows.append((k, " ".join(words), "s"))
        labels.append((k, 1, int(toxic)))
    docs, labels = frames(spark, rows, labels)
    kinds = tx.community_terms(docs.select("text"))
    assert len(kinds) == 3 and all({len(set(kind) & set(t)) for t in tongues} == {1} for kind in kinds)
    change = {}
    for fair in (0.0, 1.0):
        model = tx.fit(docs, labels, fair=fair)
        found = tx.swap_changes(docs, model).first()
        assert found.texts == 1200
        change[fair] = found.mean_change
        assert model.logit(b"aaa1 bbb2 idiot") > 0
    assert change[1.0] < 0.1 * change[0.0]


def test_scores_against_the_model_word_by_word(spark):
    docs, labels = frames(spark, *corpus(600, True))
    model = tx.fit(docs, labels)
    want = {}
    for r in docs.collect():
        words = set("".join(c if c.isalnum() else " " for c in r.text.lower()).encode().split())
        parts = words | {w[:4] + b"*" for w in words if len(w) > 4}
        want[r.doc_id] = 1 / (1 + np.exp(-(model.bias + sum(model.weights.get(p, 0.0) for p in parts))))
    got = {r.doc_id: r.score for r in tx.toxicity_scores(docs, labels).collect()}
    assert got.keys() == want.keys() and all(abs(got[d] - want[d]) < 1e-9 for d in want)


def test_clashing_columns_pass_through(spark):
    rows, labels = corpus(300, False)
    docs, labels = frames(spark, rows, labels)
    docs = docs.selectExpr("doc_id", "text", "0.9D AS _toxic", "1 AS _score", "2 AS _row", "3 AS `x.y`")
    kept = tx.drop_toxic(docs, labels)
    assert kept.columns == docs.columns and kept.where("_toxic = 0.9 AND _score = 1 AND _row = 2").count() == kept.count() > 200


def test_a_repeated_id_counts_once(spark):
    docs, labels = frames(spark, [(1, "b b b", "x")] * 50 + [(1, "a a a", "x")], [(1, 1, 1)])
    assert [(r.text, r.toxic) for r in tx.sampled(docs, labels, 10, 5).collect()] == [("a a a", 1)]


def test_swaps_stay_in_their_kind():
    swap = tx.swaps((("a", "b", "c"),))
    assert tx.counterfactual({b"a", b"c", b"z"}, swap) == {b"b", b"a", b"z"}
    assert tx.counterfactual({b"z"}, swap) is None


def test_defined_cases(spark):
    docs, labels = frames(spark, [(1, None, None), (None, "idiot", "x"), (2, "", "y"), (2, "", "y"), (3, "idiot " * 20000, "z")], [])
    got = tx.toxicity_scores(docs, labels).collect()
    assert len(got) == 5 and all(r.predicted == 0 for r in got)
    rows, marked = corpus(400, False)
    docs, labels = frames(spark, [*rows, (None, "idiot", "n")], [*marked, (None, 1, 1), (1, 1, None), (0, 1, 0)])
    assert tx.toxicity_scores(docs, labels).count() == 401
    assert {r.doc_id for r in tx.drop_toxic(docs, labels).collect()} < {r[0] for r in rows} | {None}
    assert tx.toxicity_scores(docs.limit(0), labels).count() == 0


def test_lists_of_numbers_are_kept_as_arrays_in_their_order():
    import random

    import pyarrow as pa

    from loomspark.llm.toxicity import Lists

    rng = random.Random(5)
    rows = [None, [], [300, 2], [2, 300], [2], [65536], [255, 256]] + [[rng.randrange(70_000) for _ in range(rng.randint(0, 4))] for _ in range(200)]
    kept = Lists.of(pa.chunked_array([pa.array(rows[:3], pa.list_(pa.int32())), pa.array(rows[3:], pa.list_(pa.int32()))]))
    plain = [r or [] for r in rows]
    order = sorted(range(len(rows)), key=kept.key)
    assert order == sorted(range(len(rows)), key=plain.__getitem__)
    at, numbers = kept.taken(order)
    assert list(zip(at.tolist(), numbers.tolist(), strict=True)) == [(i, v) for i, k in enumerate(order) for v in plain[k]]
    assert [a.tolist() for a in kept.taken([])] == [[], []]
