"""N-gram Jaccard join by parity sketches.

A document's set is its distinct word shingles. A sketch of ``P`` parts of 2^64 bits is made
by XOR: each shingle flips one bit, and only the odd bits are held, as the XOR of their
hashes and their number for each part. A shingle that two sets share flips the same bit in
both, so the Hamming distance of two sketches is at most the size of the sets' symmetric
difference, which a Jaccard similarity of p % bounds by (100-p)/(100+p) of the summed sizes.

Size bands share one layout of ``P`` parts. If a set differs from a linked one in at most
``d`` bits, at least ``P - d`` parts are equal. Parts are put in an order that equal parts have
in common: first those that are not hot, then those with more shingles, then by place. Each
set makes keys of its first ``d + 1`` parts: the first of the equal parts is among them in
either set. So two linked sets meet in at least one key, and nearly empty parts, which any
two sets may have in common, seldom make keys. ``d`` follows from a set's own size and the
largest that a partner can have; a set also makes the keys of larger bands it can reach.

Hot parts are those that the sample has several times. Whatever the order, the result is the
same; the sample is there so that an edited copy of a text of which there are thousands meets
its like by what is its own, not by what all of them share.

Sets that meet are verified exactly. Only components are asked for, so a bucket is not
expanded to all pairs: its members are first compared with one member (in a hot bucket the
one with the most frequent parts), then with a member of the bucket's largest component; what
is still in another component is at last compared with all members of other components whose
bit sketches are near enough in Hamming distance. Equal sets are one node, known by a 64-bit
hash of the set; that two sets have the same one is as unlikely as that two shingles have.

At scale: every text is cut into shingles once (a sample of them twice, and those that meet
another set again); only keys and ids move between tasks, not texts. The one join of texts,
for the sets to verify, is behind a bit table of fixed size that leaves out those that meet
none. The plan is the same at every size. What grows faster than the input is the last
comparison, in buckets of many unlinked sets that have nearly all of their parts in common.

Defined results: null or empty texts have no shingles and are linked with nothing, so their
component is their own id; rows with the same id and different texts are nodes of their own,
and an id counts in the component of each; a row with a null id belongs to the class of its
text but links nothing, and its component is null if the class has no other id. Extra columns
are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce
from operator import add

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomspark.llm.components import components
from loomspark.llm.sieve import held, may_have, places, sieve
from loomspark.llm.tables import cut, removed, stored
from loomspark.llm.words import blank_words, mix64, slices, text_bytes

#: One in how many ids is in the sample for hot keys, how many sets of the sample make a key hot, and for how many keys that is told.
SAMPLED, HOT, MOST_HOT = 8, 4, 1_000_000
#: Parts of a sketch for each bit in which linked sets may differ.
FINE = 2
#: Words of the bit sketches by which pairs are sifted before their sets are compared.
WORDS = 16
#: Words, and sets already met, that a Python worker keeps.
MEMO = 1 << 17


@dataclass(frozen=True)
class Band:
    """The sketch layout for pairs whose larger set has ``low`` to ``top`` shingles."""

    number: int
    low: int
    top: int
    parts: int


class Bands:
    """Bands of growing sizes, made as they are needed."""

    def __init__(self, percent: int):
        self.percent, self.made = percent, [Band(0, 1, 1, FINE)]

    def most_differ(self, n: int, band: Band) -> int:
        """In how many parts at most a set of ``n`` shingles differs from a linked one in the band."""
        larger = min(band.top, 100 * n // self.percent)
        return (n + larger) * (100 - self.percent) // (100 + self.percent)

    def reached(self, n: int) -> list[Band]:
        """The bands in which a set of ``n`` shingles can have a partner at least as large."""
        while self.percent * self.made[-1].low <= 100 * n or self.made[-1].top < n:
            low = self.made[-1].top + 1
            top = max(low, low * 3 // 2)
            most = 2 * top * (100 - self.percent) // (100 + self.percent)
            self.made.append(Band(len(self.made), low, top, FINE * (most + 1)))
        return [b for b in self.made if b.top >= n and self.percent * b.low <= 100 * n]


class Shingler:
    """Distinct 64-bit hashes of the shingles of ``size`` words of a text."""

    def __init__(self, size: int):
        self.size, self.hashes = size, {}

    def __call__(self, text: bytes) -> np.ndarray:
        words, known = blank_words(text), self.hashes
        if not words:
            return np.zeros(0, np.uint64)
        if len(known) > MEMO:
            known.clear()
        for w in set(words).difference(known):
            known[w] = xxhash.xxh3_64_intdigest(w)
        each = np.fromiter(map(known.__getitem__, words), np.uint64, len(words))
        size = min(self.size, len(words))
        last = len(words) - size + 1
        out = np.full(last, size, np.uint64)
        for k in range(size):
            out = mix64(out * np.uint64(0x9E3779B97F4A7C15) + each[k : k + last])
        return np.unique(out)


def sketch_keys(shingles: np.ndarray, bands: Bands) -> list[tuple[int, np.ndarray]]:
    """For each band that can have a link: how many keys to keep, and a key for each part, strong parts first."""
    out = []
    for band in bands.reached(len(shingles)):
        differ = bands.most_differ(len(shingles), band)
        if not differ:
            continue  # only equal sets are linked there
        part = ((shingles >> np.uint64(32)) * np.uint64(band.parts) >> np.uint64(32)).astype(np.int64)
        sketch = np.zeros(band.parts, np.uint64)
        np.bitwise_xor.at(sketch, part, mix64(shingles))
        strength = np.bincount(part, minlength=band.parts) * band.parts + np.arange(band.parts)
        order = np.argsort(-strength)
        place = (order + (band.number << 32)).astype(np.uint64)
        out.append((differ + 1, mix64(mix64(sketch[order]) + mix64(place))))
    return out


def chosen_keys(keys: list[tuple[int, np.ndarray]], hot: np.ndarray, seen: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """The keys to meet under, cold and hot ones, and how often the sample has the parts in all.

    ``hot``: the hot keys, sorted, and ``seen``: how often the sample has each.
    """
    cold_out, hot_out, total = [np.zeros(0, np.uint64)], [np.zeros(0, np.uint64)], 0
    for keep, all_keys in keys:
        times = np.zeros(len(all_keys), np.int64)
        if len(hot):
            at = np.searchsorted(hot, all_keys) % len(hot)
            times = np.where(hot[at] == all_keys, seen[at], 0)
        chosen = np.argsort(times, kind="stable")[:keep]
        cold_out.append(all_keys[chosen[times[chosen] == 0]])
        hot_out.append(all_keys[chosen[times[chosen] > 0]])
        total += int(times.sum())
    return np.concatenate(cold_out), np.concatenate(hot_out), total


def bit_sketch(shingles: np.ndarray) -> np.ndarray:
    """``WORDS`` words of which each shingle flips one bit."""
    out = np.zeros(WORDS, np.uint64)
    bits = mix64(shingles + np.uint64(1))
    np.bitwise_xor.at(out, (bits >> np.uint64(32)) % np.uint64(WORDS), np.uint64(1) << (bits & np.uint64(63)))
    return out


def hamming(a: str, b: str) -> Column:
    """The distance of two sketch columns: at most the size of the sets' symmetric difference."""
    return reduce(add, (F.bit_count(F.get(a, F.lit(k)).bitwiseXOR(F.get(b, F.lit(k)))) for k in range(WORDS)))


def lists(arrays: list[np.ndarray]) -> pa.Array:
    """A list column of 64-bit values."""
    ends = np.cumsum([0, *map(len, arrays)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([*arrays, np.zeros(0, np.uint64)]).view(np.int64)))


def node_of(shingles: np.ndarray) -> int:
    """The 64-bit name of a set."""
    return int(np.uint64(xxhash.xxh3_64_intdigest(shingles.tobytes())).astype(np.int64))


def all_keys(shingles: np.ndarray, bands: Bands) -> np.ndarray:
    return np.concatenate([np.zeros(0, np.uint64), *(k for _, k in sketch_keys(shingles, bands))])


def hot_keys(docs: DataFrame, size: int, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """The keys that at least ``HOT`` sets of a sample by id make, sorted, and how many; at most ``MOST_HOT`` keys."""

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler, bands = Shingler(size), Bands(percent)
        for batch in slices(batches):
            sets = [shingler(t) for t in text_bytes(batch.column("text"))]
            yield pa.RecordBatch.from_arrays([pa.array(map(node_of, sets), pa.int64()), lists([all_keys(s, bands) for s in sets])], names=["node", "keys"])

    sample = docs.where(F.col("doc_id").isNotNull() & (F.pmod(F.xxhash64("doc_id"), F.lit(SAMPLED)) == 0)).select("text")
    keys = sample.mapInArrow(keyed, "node long, keys array<long>").select("node", F.explode("keys").alias("key"))
    counts = cut(keys.distinct().groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") >= HOT))
    least = HOT
    while counts.where(F.col("n") >= least).count() > MOST_HOT:
        least *= 2
    found = counts.where(F.col("n") >= least).toArrow()
    keys, seen = found.column("key").to_numpy().view(np.uint64), found.column("n").to_numpy()
    order = np.argsort(keys)
    return keys[order], seen[order]


def keyed_rows(docs: DataFrame, hot, size: int, percent: int) -> DataFrame:
    """``doc_id, text_hash, n_shingles, node`` for every row; the first rows of a set in a task also have its keys and bit sketch.

    Those are ``cold`` and ``hot`` keys, ``n_hot`` (how often the sample has its parts in all) and ``sketch``.
    """
    many = pa.list_(pa.int64())
    kinds = {"doc_id": pa.int64(), "text_hash": pa.int64(), "n_shingles": pa.int64(), "node": pa.int64(), "cold": many, "hot": many, "n_hot": pa.int64(), "sketch": many}

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler, bands, met = Shingler(size), Bands(percent), set()
        for batch in slices(batches):
            sizes, nodes, keys = [], [], []
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), text_bytes(batch.column("text")), strict=True):
                shingles = shingler(text)
                node = node_of(shingles)
                sizes.append(len(shingles))
                nodes.append(node)
                if doc_id is None or not len(shingles) or node in met:
                    keys.append((None,) * 4)
                    continue
                met.add(node)
                cold, warm, n = chosen_keys(sketch_keys(shingles, bands), *hot.value)
                keys.append((cold.view(np.int64), warm.view(np.int64), n, bit_sketch(shingles).view(np.int64)))
            if len(met) > MEMO:
                met.clear()
            columns = [batch.column("doc_id"), batch.column("text_hash"), sizes, nodes, *(list(zip(*keys, strict=True)) or [()] * 4)]
            yield pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, k) for c, k in zip(columns, kinds.values(), strict=True)], names=list(kinds))

    return docs.mapInArrow(keyed, "doc_id long, text_hash long, n_shingles long, node long, cold array<long>, hot array<long>, n_hot long, sketch array<long>")


def shingle_sets(docs: DataFrame, rows: DataFrame, nodes: DataFrame, size: int) -> DataFrame:
    """``node, shingles`` of ``nodes``, each from the row of its smallest id."""

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler = Shingler(size)
        for batch in slices(batches):
            wanted = held(table.value, *(batch.column(c).to_numpy() for c in ("first", "second")))
            sets = [shingler(t) for t in text_bytes(batch.column("text").filter(pa.array(wanted)))]
            yield pa.RecordBatch.from_arrays([pa.array(map(node_of, sets), pa.int64()), lists(sets)], names=["node", "shingles"])

    ids = rows.select("node", "doc_id").join(nodes, "node", "left_semi").groupBy("node").agg(F.min("doc_id").alias("doc_id"))
    table = sieve(ids.select("doc_id"))
    first, second = places(F.col("doc_id"))
    found = docs.where("doc_id IS NOT NULL").select("text", first.alias("first"), second.alias("second")).mapInArrow(made, "node long, shingles array<long>")
    return found.join(nodes, "node", "left_semi").dropDuplicates(["node"])


def verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs ``a, b`` whose sets are similar enough."""
    left = sets.select(F.col("node").alias("a"), F.col("shingles").alias("of_a"))
    right = sets.select(F.col("node").alias("b"), F.col("shingles").alias("of_b"))
    n, m = F.size("of_a"), F.size("of_b")
    near = 100 * F.least(n, m) >= percent * F.greatest(n, m)
    common = F.size(F.array_intersect("of_a", "of_b"))
    return (
        pairs.join(left, "a").join(right, "b").where(near).withColumn("common", common)
        .where(100 * F.col("common") >= percent * (n + m - F.col("common"))).select("a", "b")
    )


def relabelled(labels: DataFrame, links: DataFrame) -> DataFrame:
    """Labels of all nodes after ``links`` (between nodes) have joined their components."""
    of_a = labels.select(F.col("node").alias("a"), F.col("label").alias("la"))
    of_b = labels.select(F.col("node").alias("b"), F.col("label").alias("lb"))
    between = links.join(of_a, "a").join(of_b, "b").select(F.col("la").alias("a"), F.col("lb").alias("b"))
    joined = components(between).select(F.col("node").alias("label"), F.col("label").alias("to"))
    return cut(labels.join(joined, "label", "left").select("node", F.coalesce("to", "label").alias("label")))


def found_components(docs: DataFrame, size: int, percent: int) -> DataFrame:
    """``doc_id, text_hash, n_shingles, component_id`` for every row of ``docs`` (``doc_id``, ``text``)."""
    docs = docs.selectExpr("cast(doc_id AS bigint) AS doc_id", "cast(text AS string) AS text", "xxhash64(text) AS text_hash")
    hot = docs.sparkSession.sparkContext.broadcast(hot_keys(docs, size, percent))
    rows = stored(keyed_rows(docs, hot, size, percent), "rows")

    # Members of buckets with two sets at least; copies of a set may be there several times.
    bucket = Window.partitionBy("key")
    cold = rows.select(F.explode("cold").alias("key"), "node").select("key", "node", F.min("node").over(bucket).alias("pivot"), F.max("node").over(bucket).alias("high"))
    warm = cut(rows.where("size(hot) > 0").select(F.explode("hot").alias("key"), "node", "n_hot"))
    central = warm.groupBy("key").agg(F.min_by("node", F.struct(-F.col("n_hot"), "node")).alias("pivot"))
    members = stored(cold.where("pivot < high").select("key", "node", "pivot").union(warm.select("key", "node").join(central, "key")), "members")
    pairs = cut(members.where("node <> pivot").select(F.least("node", "pivot").alias("a"), F.greatest("node", "pivot").alias("b")).distinct())

    met = cut(pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct())
    sets = stored(shingle_sets(docs, rows, met, size), "shingles")
    labels = relabelled(met.select("node", F.col("node").alias("label")), verified(pairs, sets, percent))

    for exhaustive in (False, True):
        placed = members.select("key", "node").join(labels, "node")
        split = placed.groupBy("key").agg(F.min("label").alias("l"), F.max("label").alias("h")).where("l < h").select("key")
        placed = stored(placed.join(split, "key", "left_semi").distinct(), "split")
        counts = placed.groupBy("key", "label").agg(F.count("*").alias("n"), F.min_by("node", F.xxhash64("node", "key")).alias("pivot"))
        main = cut(counts.groupBy("key").agg(F.max_by(F.struct("label", "pivot"), F.struct("n", "label")).alias("m")).select("key", F.col("m.label").alias("main"), F.col("m.pivot").alias("pivot")))
        if exhaustive:
            sketched = rows.where("sketch IS NOT NULL").select("node", F.col("n_shingles").alias("n"), "sketch")
            placed = stored(placed.join(sketched.join(placed.select("node").distinct(), "node", "left_semi").dropDuplicates(["node"]), "node"), "placed")
            strays = placed.join(main, "key").where("label <> main").select("key", "node", "label", "n", "sketch")
            others = placed.select(F.col("key").alias("key_2"), F.col("node").alias("other"), F.col("label").alias("label_2"), F.col("n").alias("m"), F.col("sketch").alias("sketch_2"))
            size_fits = 100 * F.least("n", "m") >= percent * F.greatest("n", "m")
            near = (100 + percent) * hamming("sketch", "sketch_2") <= (100 - percent) * (F.col("n") + F.col("m"))
            met_again = strays.join(others, (F.col("key") == F.col("key_2")) & (F.col("label") != F.col("label_2")) & size_fits & near)
        else:
            met_again = placed.join(main, "key").where("label <> main").withColumnRenamed("pivot", "other")
        pairs = cut(met_again.select(F.least("node", "other").alias("a"), F.greatest("node", "other").alias("b")).distinct())
        labels = relabelled(labels, verified(pairs, sets, percent))
        removed(placed)
    removed(sets)
    removed(members)

    base = rows.select("doc_id", "text_hash", "n_shingles", "node")
    smallest = base.where("n_shingles > 0").groupBy("node").agg(F.min("doc_id").alias("low")).join(labels, "node", "left")
    linked = smallest.where("label IS NOT NULL").groupBy("label").agg(F.min("low").alias("component"))
    found = smallest.join(linked, "label", "left").select("node", F.coalesce("component", "low").alias("component"))
    return base.join(found, "node", "left").select(
        "doc_id", "text_hash", "n_shingles", F.when(F.col("n_shingles") > 0, F.col("component")).otherwise(F.col("doc_id")).alias("component_id")
    )


def jaccard_components(docs: DataFrame, size: int = 5, percent: int = 80) -> DataFrame:
    """``doc_id, n_shingles, component_id`` for every row of ``docs`` (``doc_id``, ``text``).

    Two sets are linked when 100 * intersection >= ``percent`` * union; a component's id is
    the smallest id in it.
    """
    return found_components(docs, size, percent).drop("text_hash")


def keep_one(docs: DataFrame, size: int = 5, percent: int = 80) -> DataFrame:
    """``docs`` with one document of each component: the one of the smallest id.

    Rows alike in id and text count once; documents without shingles and with null ids stay.
    Only rows whose id a bit table holds as one of those to go or to count once are shuffled.
    """
    found = found_components(docs, size, percent)
    known = found.where("doc_id IS NOT NULL").groupBy(F.col("doc_id").alias("_1"), F.col("text_hash").alias("_2")).agg(F.count("*").alias("_3"), F.min("component_id").alias("_4"))
    changed = stored(known.where("_1 <> _4 OR _3 > 1").select("_1", "_2", (F.col("_1") != F.col("_4")).alias("_5")), "changed")
    # The columns of ``docs`` travel as one, so that none can clash.
    packed = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("_0"))
    doc_id, text = F.col("_0.doc_id").cast("long"), F.col("_0.text").cast("string")
    suspect = may_have(sieve(changed.select("_1")), F.coalesce(doc_id, F.lit(0).cast("long"))) & doc_id.isNotNull()
    marked = packed.withColumns({"_1": doc_id, "_2": F.xxhash64(text), "_6": suspect})
    checked = marked.where("_6").join(changed, ["_1", "_2"], "left")
    parts = (marked.where("NOT _6"), checked.where("_5 IS NULL"), checked.where("NOT _5").dropDuplicates(["_1", "_2"]))
    return reduce(DataFrame.union, (part.select("_0.*") for part in parts))
