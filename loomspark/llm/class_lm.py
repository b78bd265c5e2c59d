"""LM scoring by Brown class-based n-grams.

Words (cut at white space, A-Z folded) and one end token a text make the training counts.
Exchange clustering gives every training word one of ``classes`` classes; the end token has a
class of its own and is also what comes before the first word.

    P(word | before) = P(class | class before) * P(word | class)

Transitions are smoothed with class frequencies, words by adding one. A class of its own has
the one word that training has not seen; its share is that of the words seen once. So the
probabilities sum to one.

Words are clustered in three steps, the frequent ones first, as they are what the others
stand beside:

1. the ``seeds`` most frequent words, one by one, in turns: each goes to the class that
   raises the class-bigram likelihood most;
2. the other words of the ``head``, by the classes of the seeds beside them;
3. all further words, by the classes of the head's words beside them.

In 2 and 3 all words are tried at once against the class sums of the round before; what they
stand beside keeps its class, so a round changes class sums only. A round counts only if the
likelihood rises: else part of its moves is made, or none. Turns and rounds end when none
moves or when the likelihood rises by less than ``least_rise`` of itself.

At scale: texts are read twice, to count words and to turn them into numbers; all else works
on these. Counts are combined in the tasks before they are shuffled. What is broadcast or
comes to the driver is bounded by parameters: counts and classes of at most ``head`` words,
bigrams of ``seeds`` words, class sums. All other words, with what stands beside them summed
by class, are a table hashed by word; scoring joins them by a shuffle. Words outside the head
are known by a 64-bit hash of theirs.

Defined results: null and empty texts have the end token alone; a text with a null id is
trained on; without training texts all counts are 0; repeated rows are trained on and
scored each; extra columns are ignored.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, replace
from itertools import repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.taskcontext import TaskContext

from loomspark.llm.tables import removed, stored
from loomspark.llm.words import blank_words, slices, text_bytes

#: Weight of the class frequencies in the smoothed transitions.
PRIOR = 5.0
#: Pairs that a task gathers before it counts them.
GATHERED = 1 << 19
#: Cells that a task places at once: each takes a number for every class, several times over.
HELD = 1 << 13
#: Distinct words that a task counts before it sends them on.
COUNTED = 1 << 17


def left_out(doc_id: Column, folds: int = 7, fold: int = 2) -> Column:
    """Whether crc32 of the id as text, modulo ``folds``, is ``fold``."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % folds == fold, F.lit(False))


def word_counts(docs: DataFrame) -> DataFrame:
    """``word, n`` over all texts; tasks add up what they have before the shuffle."""

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter = Counter()

        def written() -> pa.RecordBatch:
            batch = pa.RecordBatch.from_arrays([pa.array(list(seen), pa.binary()), pa.array(list(seen.values()), pa.int64())], names=["word", "n"])
            seen.clear()
            return batch

        for batch in slices(batches):
            for text in text_bytes(batch.column("text")):
                seen.update(blank_words(text))
            if len(seen) > COUNTED:
                yield written()
        yield written()

    return docs.select("text").mapInArrow(counted, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))


@dataclass
class Vocabulary:
    """The head's words, most frequent first, with their counts, and the corpus' totals."""

    words: dict[bytes, int]
    counts: np.ndarray
    texts: int
    tokens: int
    types: int
    once: int

    @property
    def end(self) -> int:
        """The end token's number."""
        return len(self.counts)

    def bare(self) -> Vocabulary:
        """Without the words, for what has their numbers."""
        return replace(self, words={})

    def numbered(self, words: list[bytes]) -> np.ndarray:
        """The numbers of words; -1: not in the head."""
        return np.fromiter(map(self.words.get, words, repeat(-1)), np.int32, len(words))


def threshold(sizes: list[tuple[int, int]], most: int) -> int:
    """The least count that at most ``most`` words reach, from (count, words with it)."""
    total, least = 0, max([n for n, _ in sizes], default=0) + 1
    for n, words in sorted(sizes, reverse=True):
        total += words
        if total > most:
            break
        least = n
    return least


def vocabulary(docs: DataFrame, head: int) -> Vocabulary:
    counts, texts = stored(word_counts(docs), "words"), docs.count()
    sizes = [(r.n, r["count"]) for r in counts.groupBy("n").count().collect()]  # distinct counts: at most the root of twice the tokens
    found = counts.where(F.col("n") >= threshold(sizes, head)).orderBy(F.desc("n"), "word").toArrow()  # head rows at most
    removed(counts)
    words = {w: k for k, w in enumerate(found.column("word").to_pylist())}
    return Vocabulary(
        words, found.column("n").to_numpy().astype(np.int64), texts, sum(n * k for n, k in sizes) + texts, sum(k for _, k in sizes) + bool(texts), dict(sizes).get(1, 0)
    )


def hashed(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words)).view(np.int64)


def x_log_x(x: np.ndarray) -> np.ndarray:
    return x * np.log(np.maximum(x, 1))


def likelihood(after: np.ndarray, before: np.ndarray) -> float:
    """Of classes (rows) by what follows them and what comes before them (columns), up to what no exchange changes."""
    return float(x_log_x(after).sum() + x_log_x(before).sum() - x_log_x(after.sum(axis=1)).sum() - x_log_x(before.sum(axis=1)).sum())


def bigram_likelihood(table: np.ndarray) -> float:
    return float(x_log_x(table).sum() - x_log_x(table.sum(axis=0)).sum() - x_log_x(table.sum(axis=1)).sum())


def exchanged_seeds(pairs: np.ndarray, classes: int, least_rise: float, rises: list[float] | None = None) -> np.ndarray:
    """Classes of the words of a bigram table, whose last two rows (the end token, all other words) keep a class each.

    The first words get a class each, the others the best one in turn; then words are exchanged
    one by one, in turns, until none moves or a turn brings too little. ``rises`` gets the
    likelihood after each turn.
    """
    words, size = len(pairs) - 2, classes + 2
    of = np.append(np.where(np.arange(words) < classes, np.arange(words), classes + 1), [classes, classes + 1])
    one = np.eye(size)[of]
    table = one.T @ pairs @ one
    moved, now, before = True, -np.inf, -np.inf
    while moved and (not np.isfinite(before) or now - before >= least_rise * abs(now)):
        moved, before = False, now
        for w in range(words):
            own, itself = of[w], pairs[w, w]
            after, ahead = np.bincount(of, pairs[w], size), np.bincount(of, pairs[:, w], size)
            table[own] -= after
            table[:, own] -= ahead
            table[own, own] += itself  # taken twice
            after[own] -= itself
            ahead[own] -= itself
            gain = placed_gain(table, after, ahead, itself)[:classes]
            to = int(np.argmax(gain))
            if own >= classes or gain[to] > gain[own] + 1e-6:
                moved, of[w] = True, to
            own = of[w]
            table[own] += after
            table[:, own] += ahead
            table[own, own] += itself
        now = bigram_likelihood(table)
        if rises is not None:
            rises.append(now)
    return of[:words]


def placed_gain(table: np.ndarray, after: np.ndarray, before: np.ndarray, itself: float) -> np.ndarray:
    """By how much the bigram likelihood grows when a word that is in no class goes to each one."""
    a, b = np.flatnonzero(after), np.flatnonzero(before)
    rows, columns, diagonal = table.sum(axis=1), table.sum(axis=0), np.diag(table)
    gain = (x_log_x(table[:, a] + after[a]) - x_log_x(table[:, a])).sum(axis=1) + (x_log_x(table[b].T + before[b]) - x_log_x(table[b].T)).sum(axis=1)
    # In its own class a word's followers and predecessors meet in one cell.
    gain += x_log_x(diagonal + after + before + itself) - x_log_x(diagonal + after) - x_log_x(diagonal + before) + x_log_x(diagonal)
    # Classes beside the word also get its tokens: in the column sums its predecessors' pairs, in the row sums its followers'.
    full, full_b = after.sum() + itself, before.sum() + itself
    rows, columns = rows + before, columns + after
    return gain - (x_log_x(rows + full) - x_log_x(rows)) - (x_log_x(columns + full_b) - x_log_x(columns))


def packed(rows: list[np.ndarray], kind: type) -> pa.Array:
    """A binary column of number arrays."""
    ends = np.cumsum([0, *(x.nbytes for x in rows)]).astype(np.int32)
    return pa.BinaryArray.from_buffers(pa.binary(), len(rows), [None, pa.py_buffer(ends), pa.py_buffer(np.concatenate([*rows, np.zeros(0, kind)]).astype(kind))])


def unpacked(column: pa.BinaryArray, kind: type) -> tuple[np.ndarray, np.ndarray]:
    """The numbers of all rows of a binary column, and how many each row has."""
    _, ends, data = column.buffers()
    ends = np.frombuffer(ends, np.int32)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int32)
    size = np.dtype(kind).itemsize
    numbers = np.frombuffer(data, np.uint8)[ends[0] : ends[-1]].view(kind) if ends[-1] > ends[0] else np.zeros(0, kind)
    return numbers, np.diff(ends) // size


def encoded(texts: DataFrame, vocab) -> DataFrame:
    """``row, doc_id, held_out, numbers, hashes``: each text as its words' numbers, and the hashes of those outside the head."""

    def coded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v, row = vocab.value, TaskContext.get().partitionId() << 40
        for batch in slices(batches, 512):
            numbers, hashes = [], []
            for text in text_bytes(batch.column("text")):
                words = blank_words(text)
                numbers.append(v.numbered(words))
                hashes.append(hashed([words[k] for k in np.flatnonzero(numbers[-1] < 0).tolist()]))
            rows = pa.array(np.arange(row, row + batch.num_rows))
            row += batch.num_rows
            yield pa.RecordBatch.from_arrays([rows, batch.column("doc_id"), batch.column("held_out"), packed(numbers, np.int32), packed(hashes, np.int64)], names=["row", "doc_id", "held_out", "numbers", "hashes"])

    return texts.mapInArrow(coded, "row long, doc_id long, held_out boolean, numbers binary, hashes binary")


def sequence(batch: pa.RecordBatch, end: int) -> tuple[np.ndarray, np.ndarray]:
    """The numbers of all texts of a batch, one end token between them, before the first and after the last; each text's size."""
    numbers, sizes = unpacked(batch.column("numbers"), np.int32)
    out = np.full(len(numbers) + len(sizes) + 1, end, np.int64)
    out[np.arange(len(numbers)) + np.repeat(np.arange(len(sizes)), sizes) + 1] = numbers
    return out, sizes


def seed_pairs(texts: DataFrame, end: int, seeds: int) -> np.ndarray:
    """Bigrams of the seeds, the end token and, as one, all other words."""
    size = seeds + 2

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        item, total = np.full(end + 2, size - 1), np.zeros(size * size, np.int64)
        item[:seeds], item[end] = np.arange(seeds), seeds
        for batch in slices(batches, 512):
            found = item[sequence(batch, end)[0]]
            total += np.bincount(found[:-1] * size + found[1:], minlength=size * size)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], names=["pair", "n"])

    got = texts.select("numbers").mapInArrow(counted, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n")).toArrow()  # size^2 rows at most
    out = np.zeros(size * size)
    out[got.column("pair").to_numpy()] = got.column("n").to_numpy()
    return out.reshape(size, size)


def head_cells(texts: DataFrame, beside: np.ndarray, first: int, width: int) -> DataFrame:
    """``item, cell, n``: how often a word of the head from number ``first`` on has a class before (cell) or after it (``width`` + cell)."""
    end = len(beside) - 2

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, gathered = [], 0

        def written() -> pa.RecordBatch:
            at, n = np.unique(np.concatenate([*keys, np.zeros(0, np.int64)]), return_counts=True)
            keys.clear()
            return pa.RecordBatch.from_arrays([pa.array(at // (2 * width)), pa.array((at % (2 * width)).astype(np.int32)), pa.array(n.astype(np.int64))], names=["item", "cell", "n"])

        for batch in slices(batches, 512):
            numbers = sequence(batch, end)[0]
            near, at = beside[numbers], np.flatnonzero((numbers >= first) & (numbers < end))
            base = numbers[at] * (2 * width)
            keys += [base + near[at - 1], base + width + near[at + 1]]
            gathered += 2 * len(at)
            if gathered > GATHERED:
                yield written()
                gathered = 0
        yield written()

    return texts.select("numbers").mapInArrow(counted, "item long, cell int, n long")


def rest_pairs(texts: DataFrame, beside: np.ndarray, width: int) -> DataFrame:
    """``kind, a, b, n`` once the head has its classes.

    Kind 0: bigrams of the head's classes ``a, b``; 1: as ``head_cells``, for the other words,
    by hash; 2: bigrams of two such words.
    """
    end = len(beside) - 2

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, before, after, pairs, gathered = [], [], [], [], 0
        table, none = np.zeros(width * width, np.int64), np.zeros(0, np.int64)

        def rows(kind: int, *columns: np.ndarray) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(np.full(len(columns[0]), kind, np.int32)), *map(pa.array, columns)], names=["kind", "a", "b", "n"])

        def written() -> Iterator[pa.RecordBatch]:
            known, of = np.unique(np.concatenate([*words, none]), return_inverse=True)
            cells = np.concatenate([of, of]) * (2 * width) + np.concatenate([*before, *after, none])
            at, n = np.unique(cells, return_counts=True)
            yield rows(1, known[at // (2 * width)], at % (2 * width), n)
            both = np.concatenate([*pairs, np.zeros((0, 2), np.int64)])
            yield rows(2, both[:, 0].copy(), both[:, 1].copy(), np.ones(len(both), np.int64))
            for gone in (words, before, after, pairs):
                gone.clear()

        for batch in slices(batches, 512):
            numbers, hashes = sequence(batch, end)[0], unpacked(batch.column("hashes"), np.int64)[0]
            near, at = beside[numbers], np.flatnonzero(numbers < 0)
            table += np.bincount(near[:-1] * width + near[1:], minlength=width * width)
            words.append(hashes)
            before.append(near[at - 1])
            after.append(width + near[at + 1])
            adjacent = np.flatnonzero(np.diff(at) == 1)
            pairs.append(np.stack([hashes[adjacent], hashes[adjacent + 1]], axis=1))
            gathered += len(at)
            if gathered > GATHERED // 2:
                yield from written()
                gathered = 0
        yield from written()
        kept = np.flatnonzero(table)
        yield rows(0, kept // width, kept % width, table[kept])

    return texts.select("numbers", "hashes").mapInArrow(counted, "kind int, a long, b long, n long")


STATE = "item long, own int, n long, cells binary, sums array<bigint>"


class Round:
    """A task's share of a round: where its items go, and what the classes then sum up to."""

    def __init__(self, sums: np.ndarray, choices: int):
        self.sums, self.choices, self.total = sums, choices, np.zeros(sums.shape)

    def placed(self, items: np.ndarray, own: np.ndarray, at: np.ndarray, cell: np.ndarray, n: np.ndarray, stays=None) -> pa.RecordBatch:
        """The items' rows after they have moved; ``stays`` tells from their gains which don't."""
        width = self.sums.shape[1]
        to, gain = best_classes(own, at, cell, n.astype(float), self.sums, self.choices)
        to = to if stays is None else np.where(stays(gain), own, to)
        self.total += np.bincount(to[at] * width + cell, n, self.total.size).reshape(self.total.shape)
        ends = np.concatenate(([0], np.cumsum(np.bincount(at, minlength=len(items))))).astype(np.int32) * 8
        cells = pa.BinaryArray.from_buffers(pa.binary(), len(items), [None, pa.py_buffer(ends.astype(np.int32)), pa.py_buffer(np.ascontiguousarray(n * width + cell))])
        tokens = np.bincount(at, n * (2 * cell >= width), len(items)).astype(np.int64)
        return self.batch(pa.array(items), pa.array(to, pa.int32()), pa.array(tokens), cells, pa.nulls(len(items), pa.list_(pa.int64())))

    def summed(self) -> pa.RecordBatch:
        """The class sums, in rows without an item."""
        at = np.flatnonzero(self.total.any(axis=1))
        sums = pa.array([r.astype(np.int64) for r in self.total[at]], pa.list_(pa.int64()))
        return self.batch(pa.nulls(len(at), pa.int64()), pa.array(at, pa.int32()), pa.nulls(len(at), pa.int64()), pa.nulls(len(at), pa.binary()), sums)

    @staticmethod
    def batch(*columns: pa.Array) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays(list(columns), names=["item", "own", "n", "cells", "sums"])


def placed_items(cells: DataFrame, sums: np.ndarray, choices: int, few: bool) -> DataFrame:
    """Every item in its best class by the class sums of what is placed already, with its cells packed.

    A cell is ``n * width + cell``, an item has at most ``width`` of them. If every item has
    ``few`` rows, they are sent to their item's task at once, else summed before.
    """
    rows = cells if few else cells.groupBy("item", "cell").agg(F.sum("n").alias("n"))
    width = sums.shape[1]

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        here, held = Round(sums, choices), [np.zeros(0, np.int64)] * 3

        def done(items: np.ndarray, cell: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
            names, of = np.unique(items, return_inverse=True)
            spots, spot = np.unique(of * width + cell, return_inverse=True)
            return here.placed(names, np.full(len(names), -1), spots // width, spots % width, np.bincount(spot, n).astype(np.int64))

        for batch in slices(batches, HELD):
            new = [batch.column(c).to_numpy().astype(np.int64) for c in ("item", "cell", "n")]
            held = [np.concatenate(x) for x in zip(held, new, strict=True)]
            if len(held[0]) < HELD:
                continue
            last = np.searchsorted(held[0], held[0][-1])  # rows are in order; the last item may go on
            if last:
                yield done(*(x[:last] for x in held))
                held = [x[last:] for x in held]
        if len(held[0]):
            yield done(*held)
        yield here.summed()

    return rows.repartition("item").sortWithinPartitions("item").mapInArrow(placed, STATE)


def best_classes(own: np.ndarray, at: np.ndarray, cell: np.ndarray, n: np.ndarray, sums: np.ndarray, choices: int) -> tuple[np.ndarray, np.ndarray]:
    """The class in which each item raises the likelihood most, and by how much over its own.

    ``at``, ``cell``, ``n``: the items' cells, by item; ``sums``: of every class the sums of
    its items' cells, first those before, then those after. ``own`` is -1 for an item in none.
    """
    width = sums.shape[1] // 2
    gain, items = np.zeros((len(own), choices)), len(own)
    placed = np.flatnonzero(own >= 0)
    if len(at):
        starts = np.flatnonzero(np.diff(at, prepend=-1))
        base, of_base = sums[:choices, cell].T.copy(), x_log_x(sums)[:choices, cell].T.copy()
        mine = np.flatnonzero(own[at] >= 0)
        spot = (mine, own[at[mine]])
        base[spot] -= n[mine]
        of_base[spot] = x_log_x(base[spot])
        gain[at[starts]] = np.add.reduceat(x_log_x(base + n[:, None]) - of_base, starts)
    for side in (0, 1):
        of_side = (cell >= width) == side
        size = np.bincount(at[of_side], n[of_side], items)
        total = np.tile(sums[:choices, side * width : (side + 1) * width].sum(axis=1), (items, 1))
        total[placed, own[placed]] -= size[placed]
        gain -= x_log_x(total + size[:, None]) - x_log_x(total)
    to = np.argmax(gain, axis=1)
    over = gain[np.arange(items), to].copy()
    over[placed] -= gain[placed, own[placed]]
    return to, over


def exchange_round(state: DataFrame, sums: np.ndarray, choices: int, part: int, turn: int) -> DataFrame:
    """The items after one in ``part`` of them has gone where the likelihood rises most."""
    width = sums.shape[1]

    def moved(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        here = Round(sums, choices)
        for batch in slices(batches, 512, 8 * HELD, "cells"):
            cells, sizes = unpacked(batch.column("cells"), np.int64)
            items, at = batch.column("item").to_numpy(), np.repeat(np.arange(batch.num_rows), sizes)
            with np.errstate(over="ignore"):
                draw = (items.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(20)) + np.uint64(turn)
            stays = lambda gain, draw=draw: (gain <= 1e-6) | (draw % np.uint64(part) != 0)
            yield here.placed(items, batch.column("own").to_numpy().astype(np.int64), at, cells % width, cells // width, stays)
        yield here.summed()

    return state.where("item IS NOT NULL").mapInArrow(moved, STATE)


def class_sums(state: DataFrame, shape: tuple[int, int]) -> np.ndarray:
    """The class sums of a round: a row a class comes to the driver."""
    out = np.zeros(shape)
    rows = state.where("item IS NULL").groupBy("own").agg(*[F.sum(F.get("sums", F.lit(k))).alias(f"cell{k}") for k in range(shape[1])])
    for r in rows.collect():
        out[r.own] = r[1:]
    return out


def exchange(cells: DataFrame, fixed: np.ndarray, choices: int, few: bool, least_rise: float, name: str, rises: list[float] | None = None) -> tuple[DataFrame, np.ndarray]:
    """``item, own, n`` of the items after exchange, and their class sums.

    ``fixed``: the class sums of what keeps its class. ``rises`` gets the likelihood after each round.
    """
    width = fixed.shape[1] // 2
    like = lambda own: likelihood((fixed + own)[:, width:], (fixed + own)[:, :width])
    state = stored(placed_items(cells, fixed, choices, few), name)
    sums = class_sums(state, fixed.shape)
    now, part, turn = like(sums), 1, 0
    if rises is not None:
        rises.append(now)
    while part <= 8:
        turn += 1
        tried = stored(exchange_round(state, fixed + sums, choices, part, turn), name)
        new = class_sums(tried, fixed.shape)
        if (new == sums).all():
            removed(tried)
            break
        if like(new) <= now:
            removed(tried)
            part *= 2  # fewer at once
            continue
        removed(state)
        state, sums, before, now = tried, new, now, like(new)
        if rises is not None:
            rises.append(now)
        if now - before < least_rise * abs(now):
            break
    return state.where("item IS NOT NULL").select("item", "own", "n"), sums


@dataclass
class ClassModel:
    """Log10 probabilities ready for look-up."""

    vocab: Vocabulary
    classes: np.ndarray
    step: np.ndarray
    inside: np.ndarray

    @classmethod
    def of(cls, vocab: Vocabulary, classes: np.ndarray, members: np.ndarray, mass: np.ndarray, table: np.ndarray) -> ClassModel:
        """``classes``: of the head's words; ``members``, ``mass``, ``table``: words, tokens and bigrams of each class, the end token's the last."""
        size = len(table)
        new = (vocab.once + 1) / (vocab.tokens + 2)
        share = np.where(members > 0, mass + 1.0, 0.0)
        share /= max(share.sum(), 1.0)
        table = np.pad(table, ((0, 1), (0, 0)))
        step = np.zeros((size + 1, size + 1))
        with np.errstate(divide="ignore"):
            step[:, :size] = np.log10((1 - new) * (table + PRIOR * share) / (table.sum(axis=1, keepdims=True) + PRIOR))
        step[:, size] = np.log10(new)
        step[:, :size][:, members == 0] = 0  # a class without words is never come to
        return cls(vocab, classes, step, np.append(-np.log10(np.maximum(mass + members, 1)), 0.0))

    @property
    def end(self) -> int:
        return len(self.step) - 2

    @property
    def unknown(self) -> int:
        """The class of the word that training has not seen."""
        return len(self.step) - 1

    def scores(self, batch: pa.RecordBatch) -> dict[str, pa.Array]:
        """Of encoded texts: score and base score without what words outside the head add, known tokens, those words' hashes and surroundings.

        Surroundings are place, class before and class after in one number; a class of 0 is
        that of another such word, else classes count from 1.
        """
        v = self.vocab
        (numbers, sizes), (hashes, rare) = sequence(batch, v.end), unpacked(batch.column("hashes"), np.int64)
        if not len(sizes):
            return {}
        starts = np.cumsum(sizes + 1) - sizes - 1  # of each text's pairs
        logs = np.append(np.log10(v.counts + 1), [np.log10(v.texts + 1), 0.0])[numbers[1:]]
        classes = np.append(self.classes, [self.end, -1])[numbers]
        before, after = classes[:-1], classes[1:]
        sure = (before >= 0) & (after >= 0)
        gain = logs + np.where(sure, self.step[before, after], 0.0) + np.where(after >= 0, self.inside[after], 0.0)
        known = np.add.reduceat((numbers[1:] >= 0).astype(np.int64), starts) - (not v.texts)
        at = np.flatnonzero(numbers < 0)
        around = (at << 20) | ((classes[at - 1] + 1) << 10) | (classes[at + 1] + 1)
        ends = pa.array(np.concatenate(([0], np.cumsum(rare))).astype(np.int32))
        counts = np.add.reduceat(logs, starts)
        return {
            "n_tokens": pa.array((sizes + 1).astype(np.int64)),
            "known": pa.array(known),
            "base": pa.array(counts - (sizes + 1) * np.log10(v.tokens + v.types + 1)),
            "score": pa.array(np.add.reduceat(gain, starts)),
            "hashes": pa.ListArray.from_arrays(ends, pa.array(hashes)),
            "around": pa.ListArray.from_arrays(ends, pa.array(around.astype(np.int64))),
        }


def train(docs: DataFrame, head: int = 200_000, seeds: int = 1024, classes: int = 64, least_rise: float = 5e-4, rises: dict | None = None) -> tuple[ClassModel, DataFrame, DataFrame]:
    """The model of those ``docs`` (``doc_id``, ``text``, ``held_out``) that are not held out.

    Returns it, the words outside its head (``hash, n, class``), and all of ``docs`` encoded.
    """
    vocab = vocabulary(docs.where(~F.col("held_out")), head)
    sent = docs.sparkSession.sparkContext.broadcast(vocab)
    code = stored(encoded(docs, sent), "encoded", "zstd")
    sent.destroy()
    texts, seeds = code.where(~F.col("held_out")), min(seeds, vocab.end)
    end, rest, width = classes, classes + 1, classes + 2
    log = lambda step: None if rises is None else rises.setdefault(step, [])

    pairs = seed_pairs(texts, vocab.end, seeds)
    of_seeds = exchanged_seeds(pairs, classes, least_rise, log("seeds"))
    beside = np.full(vocab.end + 2, rest)
    beside[:seeds], beside[-2] = of_seeds, end
    one = np.eye(width)[np.append(of_seeds, [end, rest])]
    table = one.T @ pairs @ one
    fixed = np.concatenate([table.T, table], axis=1)
    fixed[rest] = 0  # what is to be placed
    placed, _ = exchange(head_cells(texts, beside, seeds, width), fixed, classes, False, least_rise, "head", log("head"))
    found = placed.select("item", "own").toArrow()  # head rows at most
    removed(placed)
    beside[found.column("item").to_numpy()] = found.column("own").to_numpy()
    of_head = beside[:-2].copy()

    raw = stored(rest_pairs(texts, beside, width), "pairs")
    table = np.zeros((width, width))
    for r in raw.where("kind = 0").groupBy("a", "b").agg(F.sum("n").alias("n")).collect():  # class bigrams
        table[r.a, r.b] = r.n
    fixed = np.concatenate([table.T, table], axis=1)
    fixed[rest] = 0
    cells = raw.where("kind = 1").select(F.col("a").alias("item"), F.col("b").cast("int").alias("cell"), "n")
    others, sums = exchange(cells, fixed, classes, True, least_rise, "others", log("others"))
    rare = stored(others.select(F.col("item").alias("hash"), "n", F.col("own").alias("class")), "rare")
    removed(others)
    of = lambda k: rare.select(F.col("hash").alias(k), F.col("class").alias(f"{k}c"))
    both = raw.where("kind = 2").select("a", "b", "n").join(of("a"), "a").join(of("b"), "b").groupBy("ac", "bc").agg(F.sum("n").alias("n"))
    table[rest] = table[:, rest] = 0
    table += sums[:, width:] + sums[:, :width].T
    table[rest] = table[:, rest] = 0  # both ends outside the head
    for r in both.collect():
        table[r.ac, r.bc] += r.n
    removed(raw)
    members = np.append(np.bincount(of_head, minlength=classes)[:classes], bool(vocab.texts)).astype(float)
    mass = np.append(np.bincount(of_head, vocab.counts, classes)[:classes], vocab.texts)
    for r in rare.groupBy("class").agg(F.count("*").alias("members"), F.sum("n").alias("mass")).collect():
        members[r["class"]] += r.members
        mass[r["class"]] += r.mass
    return ClassModel.of(vocab, of_head, members, mass, table[:rest, :rest]), rare, code


def class_lm_scores(docs: DataFrame, held_out: Column | None = None, **options) -> DataFrame:
    """``doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score`` of every row.

    Rows where ``held_out`` (by default the third of seven folds by id) are not learnt from.
    """
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), (left_out(F.col("doc_id")) if held_out is None else held_out).alias("held_out"))
    model, rare, code = train(texts, **options)
    size = len(model.step)
    partial = stored(scored_rows(code, model), "scores")
    removed(code)
    tokens = partial.select("row", F.explode(F.arrays_zip("hashes", "around")).alias("r")).select("row", F.col("r.hashes").alias("hash"), F.col("r.around").alias("around"))
    own = tokens.join(rare, "hash", "left").select(
        "row", "around", F.coalesce("class", F.lit(model.unknown)).alias("c"), F.coalesce("n", F.lit(0)).alias("n"),
        (F.shiftright("around", 10).bitwiseAND(1023) - 1).cast("int").alias("before"), (F.col("around").bitwiseAND(1023) - 1).cast("int").alias("after"),
    )
    step, inside = F.lit(model.step.ravel().tolist()), F.lit(model.inside.tolist())
    pair = lambda a, b: F.get(step, a * size + b)
    gain = F.get(inside, F.col("c")) + F.when(F.col("before") >= 0, pair(F.col("before"), F.col("c"))).otherwise(0.0) + F.when(F.col("after") >= 0, pair(F.col("c"), F.col("after"))).otherwise(0.0)
    # Neighbours that are both outside the head: their classes meet in the list of their text.
    touching = F.when((F.col("before") < 0) | (F.col("after") < 0), F.struct(F.shiftright("around", 20).alias("at"), "c"))
    seen = own.groupBy("row").agg(
        F.sum((F.col("n") > 0).cast("long")).alias("more"), F.sum(F.log10(F.col("n") + 1)).alias("logs"), F.sum(gain).alias("gain"), F.sort_array(F.collect_list(touching)).alias("runs")
    )
    follows = F.aggregate(
        F.transform("runs", lambda x, k: F.when((k > 0) & (F.get("runs", k - 1)["at"] + 1 == x["at"]), pair(F.get("runs", k - 1)["c"], x["c"])).otherwise(0.0)), F.lit(0.0), lambda a, x: a + x
    )
    seen = seen.select("row", "more", "logs", (F.col("gain") + F.col("logs") + follows).alias("gain"))
    return partial.join(seen, "row", "left").select(
        "doc_id",
        "held_out",
        "n_tokens",
        (F.col("known") + F.coalesce("more", F.lit(0))).alias("n_known"),
        F.lit(model.vocab.tokens).cast("long").alias("train_tokens"),
        (F.col("base") + F.coalesce("logs", F.lit(0.0))).alias("base_score"),
        (F.col("score") + F.coalesce("gain", F.lit(0.0))).alias("score"),
    )


def scored_rows(code: DataFrame, model: ClassModel) -> DataFrame:
    """What the model says of every encoded row, and in ``hashes`` and ``around`` what is to be joined for it."""
    sent = code.sparkSession.sparkContext.broadcast(replace(model, vocab=model.vocab.bare()))

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = sent.value
        for batch in slices(batches, 256):
            if found := model.scores(batch):
                own = ["row", "doc_id", "held_out"]
                yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in own), *found.values()], names=[*own, *found])

    return code.mapInArrow(scored, "row long, doc_id long, held_out boolean, n_tokens long, known long, base double, score double, hashes array<long>, around array<long>")
