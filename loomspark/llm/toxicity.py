"""Toxicity by a counterfactual-regularised classifier.

A logistic regression over the words of a text and their first four bytes. For every
labelled text with identity terms, a counterfactual text has them swapped for others of
their kind; the squared change of the score (before the sigmoid) is part of the loss. Naming
a group then moves the score less, and neutral mentions are not taken for toxic ones just
because toxic texts name groups more often.

Identity terms are those of a list, and those that the corpus itself shows without labels:
words by which communities of texts (tongues, dialects, boards) are known. They are the
frequent words of the sampled texts that go together, as against those that keep apart; the
first of one community is swapped for the first of the next, the second for the second.

The classifier is fitted on a sample of the labelled rows, about ``max_rows`` of them chosen
by a hash of their id, one text an id. Features are counted and chosen in Spark; what comes to the driver is
the numbers of the chosen features, at most ``max_features``, in the sampled rows. Scoring
covers every row and whole texts.

Defined results: null and empty texts have no features and get the score of the intercept;
a repeated label counts as its largest value, a null one not at all; without usable labels
every score is 0.5 less a trifle, so nothing is rejected; null ids are never held out and
have no label; of the texts of a repeated id the least in order is learnt from; extra columns
are ignored or pass through.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomspark.llm.words import alnum_words, slices, text_bytes

#: Identity terms by kind; a term is swapped for the next of its kind.
IDENTITY = (
    ("women", "men"),
    ("woman", "man"),
    ("girls", "boys"),
    ("gay", "straight", "lesbian", "bisexual"),
    ("transgender", "cisgender"),
    ("black", "white", "asian", "latino"),
    ("muslim", "christian", "jewish", "hindu", "buddhist", "atheist"),
    ("muslims", "christians", "jews", "hindus", "buddhists", "atheists"),
    ("immigrants", "natives", "refugees"),
    ("disabled", "deaf", "blind"),
    ("old", "young"),
    ("african", "european", "american", "chinese", "mexican"),
)


def swaps(kinds: tuple[tuple[str, ...], ...] = IDENTITY) -> dict[bytes, bytes]:
    return {a.encode(): kind[(k + 1) % len(kind)].encode() for kind in kinds for k, a in enumerate(kind)}


def features(words: set[bytes]) -> set[bytes]:
    """A text's words, and the beginnings of those longer than four bytes, marked by a ``*``."""
    return words | {w[:4] + b"*" for w in words if len(w) > 4}


def counterfactual(words: set[bytes], swap: dict[bytes, bytes]) -> set[bytes] | None:
    """The words with every identity term swapped; None if there is none."""
    if words.isdisjoint(swap):
        return None
    return {swap.get(w, w) for w in words}


def held_out(doc_id: Column, folds: int, fold: int) -> Column:
    """Whether crc32 of the id as text, modulo ``folds``, is ``fold``."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % folds == fold, F.lit(False))


@dataclass
class Model:
    """Weights of features; what has none doesn't count."""

    bias: float = -1e-9
    weights: dict[bytes, float] = field(default_factory=dict)
    swap: dict[bytes, bytes] = field(default_factory=dict)

    def of_words(self, words: set[bytes]) -> float:
        found = features(words).intersection(self.weights)
        return self.bias + sum(map(self.weights.__getitem__, sorted(found)))

    def logit(self, text: bytes) -> float:
        return self.of_words(set(alnum_words(text)))

    def change(self, text: bytes) -> float | None:
        """How far the logit moves when the identity terms are swapped; None if there are none."""
        words = set(alnum_words(text))
        other = counterfactual(words, self.swap)
        return None if other is None else abs(self.of_words(words) - self.of_words(other))


def sampled(docs: DataFrame, labels: DataFrame, max_rows: int, folds: int) -> DataFrame:
    """``text, toxic`` of about ``max_rows`` labelled rows outside the held-out fold."""
    usable = labels.where(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull() & ~held_out(F.col("doc_id"), folds, 0))
    usable = usable.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max("toxic").cast("int").alias("toxic"))
    share = max_rows / max(max_rows, usable.count())
    chosen = usable.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) < int(share * (1 << 30)))
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    found = texts.join(F.broadcast(chosen), "doc_id")  # about max_rows ids
    return found.groupBy("doc_id").agg(F.min("text").alias("text"), F.max("toxic").alias("toxic")).select("text", "toxic")


def together(rows: DataFrame, share: float, most: int) -> tuple[list[bytes], np.ndarray, int]:
    """The at most ``most`` words that at least ``share`` of the texts have, in how many texts each two are, and the number of texts."""

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 256):
            seen: Counter = Counter()
            for text in text_bytes(batch.column("text")):
                seen.update(set(alnum_words(text)))
            yield pa.RecordBatch.from_arrays([pa.array(list(seen), pa.binary()), pa.array(list(seen.values()), pa.int64())], names=["word", "n"])

    size = rows.count()
    frequent = rows.mapInArrow(counted, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= max(1, share * size))
    words = [bytes(r.word) for r in frequent.orderBy(F.desc("n"), "word").limit(most).collect()]
    numbers = {w: k for k, w in enumerate(words)}

    def paired(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((len(words), len(words)), np.int64)
        for batch in slices(batches):
            for text in text_bytes(batch.column("text")):
                has = [numbers[w] for w in set(alnum_words(text)).intersection(numbers)]
                total[np.ix_(has, has)] += 1
        a, b = np.nonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b), pa.array(total[a, b])], names=["a", "b", "n"])

    both = np.zeros((len(words), len(words)))
    for r in rows.mapInArrow(paired, "a long, b long, n long").groupBy("a", "b").agg(F.sum("n").alias("n")).collect():  # most^2 rows at most
        both[r.a, r.b] = r.n
    return words, both, size


def communities(words: list[bytes], both: np.ndarray, size: int) -> list[list[bytes]]:
    """Words that go together more often than chance has it with all that a community has so far, most frequent first."""
    lift = both * size / np.maximum(np.outer(np.diag(both), np.diag(both)), 1)
    found: list[list[int]] = []
    for k in range(len(words)):
        near = [(lift[k, c].min(), -i) for i, c in enumerate(found)]
        best = max(near, default=(0.0, 0))
        if best[0] > 1:
            found[-best[1]].append(k)
        else:
            found.append([k])
    return [[words[k] for k in c] for c in found if len(c) > 1]


def community_terms(rows: DataFrame, share: float = 0.1, most: int = 64) -> tuple[tuple[str, ...], ...]:
    """Kinds of interchangeable terms: the k-th word of every community that ``rows`` show. Labels are not looked at."""
    found = communities(*together(rows, share, most))
    ranks = range(max(map(len, found), default=0))
    kinds = (tuple(c[k].decode("utf-8", "replace") for c in found if len(c) > k) for k in ranks)
    return tuple(kind for kind in kinds if len(kind) > 1)


def chosen_features(rows: DataFrame, max_features: int, least: int, z: float, terms: list[bytes]) -> list[bytes]:
    """The features of ``rows`` that at least ``least`` texts have and that go with the label, and the ``terms`` that any text has."""

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, toxic = Counter(), Counter()
        for batch in slices(batches, 256):
            for text, label in zip(text_bytes(batch.column("text")), batch.column("toxic").to_pylist(), strict=True):
                found = features(set(alnum_words(text)))
                seen.update(found)
                if label:
                    toxic.update(found)
            if len(seen) > 1 << 16:
                yield flushed(seen, toxic)
                seen, toxic = Counter(), Counter()
        yield flushed(seen, toxic)

    def flushed(seen: Counter, toxic: Counter) -> pa.RecordBatch:
        names = list(seen)
        return pa.RecordBatch.from_arrays(
            [pa.array(names, pa.binary()), pa.array([seen[f] for f in names], pa.int64()), pa.array([toxic[f] for f in names], pa.int64())],
            names=["feature", "n", "k"],
        )

    size, toxic = rows.agg(F.count("*"), F.sum("toxic")).first()
    if not size or not toxic or toxic == size:
        return []
    p = toxic / size
    counts = rows.mapInArrow(counted, "feature binary, n long, k long").groupBy("feature").agg(F.sum("n").alias("n"), F.sum("k").alias("k"))
    score = F.abs(F.col("k") - p * F.col("n")) / F.sqrt(F.col("n") * (p * (1 - p)))
    # Identity terms stay, so that their weights are what the counterfactual part holds down.
    term = F.col("feature").isin([bytearray(t) for t in terms]) if terms else F.lit(False)
    strong = counts.withColumn("z", score).withColumn("term", term).where(F.col("term") | ((F.col("n") >= least) & (F.col("z") >= z)))
    return [bytes(r.feature) for r in strong.orderBy(F.desc("term"), F.desc("z"), "feature").limit(max_features).collect()]


def descend(x: tuple[np.ndarray, np.ndarray], y: np.ndarray, pairs, size: int, ridge: float, fair: float, steps: int = 300) -> np.ndarray:
    """Weights (the last is the intercept) by Adam on log loss + ridge + fair * squared score changes."""
    w, m, v = np.zeros(size + 1), np.zeros(size + 1), np.zeros(size + 1)
    w[-1] = np.log((y.mean() + 1e-6) / (1 - y.mean() + 1e-6))
    row, col = x
    before, after, n_pairs = pairs
    logits = lambda rc, n: np.bincount(rc[0], w[rc[1]], n)
    back = lambda rc, g: np.bincount(rc[1], g[rc[0]], size + 1)
    for t in range(1, steps + 1):
        g = (1 / (1 + np.exp(-(logits(x, len(y)) + w[-1]))) - y) / len(y)
        grad = back(x, g)
        grad[-1] = g.sum()
        grad[:-1] += ridge * w[:-1]
        if n_pairs:
            change = 2 * fair * (logits(before, n_pairs) - logits(after, n_pairs)) / n_pairs
            grad += back(before, change) - back(after, change)
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad**2
        w -= 0.1 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    return w


@dataclass
class Lists:
    """Lists of numbers as two arrays: as Python's they take the driver ten times the memory."""

    values: np.ndarray
    ends: np.ndarray

    @classmethod
    def of(cls, column: pa.ChunkedArray) -> Lists:
        sizes = pc.fill_null(pc.list_value_length(column), 0).to_numpy()
        return cls(pc.list_flatten(column).to_numpy(), np.concatenate(([0], np.cumsum(sizes, dtype=np.int64))))

    def row(self, k: int) -> np.ndarray:
        return self.values[self.ends[k] : self.ends[k + 1]]

    def key(self, k: int) -> bytes:
        """Bytes in the order of the lists."""
        return self.row(k).astype(">u4").tobytes()

    def taken(self, rows: list[int]) -> tuple[np.ndarray, np.ndarray]:
        """The places in ``rows`` and the numbers there."""
        found = [self.row(k) for k in rows]
        return np.repeat(np.arange(len(rows)), [len(r) for r in found]), np.concatenate([*found, np.zeros(0, np.int32)]).astype(np.int64)


def fit(docs: DataFrame, labels: DataFrame, max_rows: int = 20_000, max_features: int = 20_000, fair: float = 1.0, ridge: float = 1e-4, folds: int = 5, kinds=IDENTITY, share: float = 0.1) -> Model:
    """The classifier of ``docs`` (``doc_id``, ``text``) with ``labels`` (``doc_id``, ``toxic``).

    ``fair`` weighs score changes under swaps; ``kinds`` are the listed identity terms, to which
    come those of communities whose words ``share`` of the texts have.
    """
    rows = sampled(docs, labels, max_rows, folds).cache()
    try:
        swap = swaps(community_terms(rows, share)) | swaps(kinds)
        names = chosen_features(rows, max_features, 5, 4.0, sorted(swap))
        if not names:
            return Model()
        numbers = {f: k for k, f in enumerate(names)}

        def numbered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            known = set(numbers)
            number = lambda words: sorted(map(numbers.__getitem__, features(words) & known))
            for batch in slices(batches):
                words = [set(alnum_words(t)) for t in text_bytes(batch.column("text"))]
                others = [counterfactual(w, swap) for w in words]
                kind = pa.list_(pa.int32())
                yield pa.RecordBatch.from_arrays(
                    [batch.column("toxic"), pa.array([number(w) for w in words], kind), pa.array([None if w is None else number(w) for w in others], kind)],
                    names=["toxic", "x", "other"],
                )

        got = rows.mapInArrow(numbered, "toxic int, x array<int>, other array<int>").toArrow()
    finally:
        rows.unpersist()
    x, other = Lists.of(got.column("x")), Lists.of(got.column("other"))
    toxic, swapped = got.column("toxic").to_numpy(), got.column("other").is_valid().to_numpy()
    order = sorted(range(len(toxic)), key=lambda k: (x.key(k), toxic[k], other.key(k)))
    paired = [k for k in order if swapped[k]]
    pairs = (x.taken(paired), other.taken(paired), len(paired))
    w = descend(x.taken(order), toxic[order].astype(float), pairs, len(names), ridge, fair)
    return Model(float(w[-1]), {f: float(a) for f, a in zip(names, w, strict=False)}, swap)


def with_scores(docs: DataFrame, model: Model, name: str = "score") -> DataFrame:
    """``docs`` with the column ``name``: the probability of being toxic."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def score(texts):
        z = texts.map(lambda t: sent.value.logit((t or "").encode())).astype(float)
        return 1 / (1 + np.exp(-np.clip(z, -700, 700)))

    return docs.withColumn(name, score(F.coalesce(F.col("text").cast("string"), F.lit(""))))


def toxicity_scores(docs: DataFrame, labels: DataFrame, max_rows: int = 20_000, folds: int = 5) -> DataFrame:
    """``doc_id, held_out, score, predicted`` of every row of ``docs``."""
    scored = with_scores(docs.select("doc_id", "text"), fit(docs, labels, max_rows, folds=folds))
    return scored.select(
        F.col("doc_id").cast("long").alias("doc_id"), held_out(F.col("doc_id"), folds, 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted")
    )


def swap_changes(docs: DataFrame, model: Model) -> DataFrame:
    """``texts`` with identity terms, and ``mean_change`` of their logits when these are swapped."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def change(texts):
        return texts.map(lambda t: sent.value.change((t or "").encode())).astype(float)

    moved = docs.select(change(F.coalesce(F.col("text").cast("string"), F.lit(""))).alias("change")).where(F.col("change").isNotNull() & ~F.isnan("change"))
    return moved.agg(F.count("*").alias("texts"), F.avg("change").alias("mean_change"))


def drop_toxic(docs: DataFrame, labels: DataFrame, max_rows: int = 20_000) -> DataFrame:
    """``docs`` without those whose score is 0.5 or more."""
    model = fit(docs, labels, max_rows)
    # A row's own columns travel as one, so that none can clash.
    packed = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("_row"), F.col("text"))
    return with_scores(packed, model, "_score").where("_score < 0.5").select("_row.*")
