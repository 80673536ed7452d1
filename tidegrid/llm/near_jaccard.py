"""Near-duplicates by the exact Jaccard similarity of word shingles.

Prefix filtering: a text's distinct shingles are put in one global order; two
sets of similarity 4/5 or more share a shingle among the first
n - ceil(4n/5) + 1 of each. Texts meet at those shingles; where both sizes and
both places still allow the similarity, the pair is a candidate, and a join with
the candidates' whole sets decides. No linked pair is lost. The order puts
shingles that are common in a sample of the texts last: it decides the cost,
never the result.

A shingle with more than CROWDED texts keeps its rows, and sends each of its texts
to HUBS of them only: the one whose prefix is the most crowded - a text that the
others are edited from shares all its shingles, its copies have some of their
own - and the first ones in fixed random orders, the same at every shingle. After
these links, its remaining pairs are those of different components, so that a
group of copies costs about as much as its size.

Nodes are texts (their hash): rows of one text are linked by it, whatever their
ids. Defined results: a null text is the empty text; texts without words link
with each other; one of fewer words than a shingle is one shingle; an empty
table gives no rows; texts of any length are compared whole.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidegrid.llm.chunks import column_slices
from tidegrid.llm.shared import light, written
from tidegrid.llm.simhash_anchor import ROWS_AT_ONCE, components, shingle_hashes

WIDTH = 5
#: Texts at a shingle that are all compared at once, and pairs made at a time.
CROWDED, PAIRS_AT_ONCE = 4, 500_000
#: Texts of a crowded shingle that all others are compared with at first.
HUBS = 4
#: One text of so many is in the sample; shingles from it that may be broadcast.
ONE_OF, COMMON = 64, 100_000
#: Bytes of text in hand at a time.
SLICE = 2_000_000
#: Texts a task remembers, in order to pass over their copies.
SEEN = 100_000
#: Bits of the smallest sketch; a larger set has twice to four times as many bits as shingles.
SKETCH = 1024


def text_key(text: str = "text"):
    return F.xxhash64(F.coalesce(F.col(text).cast("string"), F.lit("")))


def shingle_set(raw: bytes | None, width: int = WIDTH) -> np.ndarray:
    """The distinct shingles of a text, sorted; a text without words has one, 0."""
    return np.unique(np.array(shingle_hashes(raw or b"", width) or [0], np.uint64)).view(np.int64)


def _texts(docs: DataFrame) -> DataFrame:
    return docs.select(text_key().alias("k"), F.col("text").cast("string").cast("binary").alias("text"))


def common_shingles(docs: DataFrame, width: int = WIDTH) -> tuple[np.ndarray, np.ndarray]:
    """(shingles, sorted; their counts) that occur three times in the sample, the commonest of them."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for raw in batch.column(1).to_pylist():
                yield pa.RecordBatch.from_arrays([pa.array(shingle_set(raw, width))], ["h"])

    sample = _texts(docs).filter(F.pmod("k", F.lit(ONE_OF)) == 0)
    found = sample.mapInArrow(rows, "h long").groupBy("h").count().filter("count > 2").orderBy(F.desc("count"), "h").limit(COMMON).collect()
    h, n = np.array([r.h for r in found], np.int64), np.array([r["count"] for r in found], np.int64)
    order = np.argsort(h)
    return h[order], n[order]


def prefix(s: np.ndarray, common: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The first shingles of a set in the global order: rare ones first, then by value."""
    first = len(s) - (4 * len(s) + 4) // 5 + 1
    if not len(common):
        return s[:first]
    spot = np.minimum(np.searchsorted(common, s), len(common) - 1)
    rank = np.where(common[spot] == s, counts[spot], 0)
    return s[np.lexsort((s, rank))[:first]]


def prefixes(docs: DataFrame, width: int = WIDTH) -> DataFrame:
    """(h, k, n, at): the text k with n shingles has h at place ``at`` of its prefix."""
    shipped = docs.sparkSession.sparkContext.broadcast(common_shingles(docs, width))

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        common, counts = shipped.value
        seen: set[int] = set()
        for batch in batches:
            listed, texts = batch.column(0).to_pylist(), batch.column(1)
            for lo, hi in column_slices(texts, SLICE):
                held, ks, ns = [], [], []
                for k, raw in zip(listed[lo:hi], texts.slice(lo, hi - lo).to_pylist(), strict=True):
                    if k in seen:
                        continue
                    if len(seen) < SEEN:
                        seen.add(k)
                    s = shingle_set(raw, width)
                    held.append(prefix(s, common, counts))
                    ks.append(k)
                    ns.append(len(s))
                if held:
                    sizes = np.array([len(x) for x in held])
                    at = np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)
                    columns = [np.concatenate(held), np.repeat(np.array(ks, np.int64), sizes), np.repeat(np.array(ns, np.int32), sizes), at.astype(np.int32)]
                    yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["h", "k", "n", "at"])

    return _texts(docs).mapInArrow(rows, "h long, k long, n int, at int")


def _groups(batches: Iterator[pa.RecordBatch], names: list[str]) -> Iterator[tuple[np.ndarray, list[np.ndarray]]]:
    """(edges of the runs of h, columns) of rows sorted by (h, k), each once, whole runs at a time."""
    held: list[list[np.ndarray]] = []

    def out(columns: list[np.ndarray]) -> tuple[np.ndarray, list[np.ndarray]]:
        h, k = columns[0], columns[1]
        fresh = np.concatenate([[True], (h[1:] != h[:-1]) | (k[1:] != k[:-1])])
        columns = [c[fresh] for c in columns]
        h = columns[0]
        return np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1], [True]])), columns

    size = 0
    for batch in batches:
        if not batch.num_rows:
            continue
        held.append([np.asarray(batch.column(name)) for name in names])
        size += batch.num_rows
        if size >= ROWS_AT_ONCE:
            columns = [np.concatenate(c) for c in zip(*held, strict=True)]
            whole = int(np.searchsorted(columns[0], columns[0][-1]))
            if whole:
                yield out([c[:whole] for c in columns])
            held, size = [[c[whole:] for c in columns]], size - whole
    if size:
        yield out([np.concatenate(c) for c in zip(*held, strict=True)])


def _possible(i: np.ndarray, j: np.ndarray, n: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Whether sizes and places allow similarity 4/5 when this is the first shared shingle."""
    most = np.minimum(n[i] - at[i], n[j] - at[j]).astype(np.int64)
    return 9 * most >= 4 * (n[i].astype(np.int64) + n[j])


RUNS = "a long, b long, h long, k long, n int, at int"
NAMES = [c.split()[0] for c in RUNS.split(", ")]


def _pairs(k: np.ndarray, i: np.ndarray, j: np.ndarray) -> pa.RecordBatch:
    none = [pa.nulls(len(i), t) for t in (pa.int64(), pa.int64(), pa.int32(), pa.int32())]
    return pa.RecordBatch.from_arrays([pa.array(np.minimum(k[i], k[j])), pa.array(np.maximum(k[i], k[j])), *none], NAMES)


def runs(met: DataFrame) -> DataFrame:
    """(a, b): pairs of small runs; and the rows (h, k, n, at) of crowded ones."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for edges, (h, k, n, at) in _groups(batches, NAMES[2:]):
            sizes = np.diff(edges)
            end = np.repeat(edges[1:], sizes)
            crowd = np.repeat(sizes > CROWDED, sizes)
            own = np.flatnonzero(crowd)
            if len(own):
                yield pa.RecordBatch.from_arrays([*[pa.nulls(len(own), pa.int64())] * 2, *(pa.array(c[own]) for c in (h, k, n, at))], NAMES)
            alive = np.flatnonzero(~crowd)
            for shift in range(1, CROWDED):
                alive = alive[alive + shift < end[alive]]
                if not len(alive):
                    break
                ok = alive[_possible(alive, alive + shift, n, at)]
                yield _pairs(k, ok, ok + shift)

    return met.repartition("h").sortWithinPartitions("h", "k").mapInArrow(rows, RUNS)


def stars(crowded: DataFrame, hubs: int = HUBS) -> DataFrame:
    """Pairs (a, b) of each text of a crowded run (h, k, n, at) and its run's hubs."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for edges, (_, k, n, at, own) in _groups(batches, ["h", "k", "n", "at", "own"]):
            sizes = np.diff(edges)
            run = np.repeat(np.arange(len(sizes)), sizes)
            share = own / (n - (4 * n.astype(np.int64) + 4) // 5 + 1)
            for turn in range(hubs):
                key = -share if not turn else k.view(np.uint64) * np.uint64(ORDERS[turn % len(ORDERS)] + 2 * turn)
                hub = np.lexsort((k, key, run))[edges[:-1]][run]
                i = np.flatnonzero(hub != np.arange(len(k)))
                ok = _possible(hub[i], i, n, at)
                yield _pairs(k, hub[i][ok], i[ok])

    counted = crowded.join(crowded.groupBy("k").agg(F.count(F.lit(1)).alias("own")), "k")
    return counted.repartition("h").sortWithinPartitions("h", "k").mapInArrow(rows, RUNS).select("a", "b").distinct()


#: Odd factors that put texts in random orders.
ORDERS = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9)


def crossing(met: DataFrame) -> DataFrame:
    """All pairs (a, b) of different components in crowded runs of (h, k, n, at, component)."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for edges, (_, k, n, at, c) in _groups(batches, ["h", "k", "n", "at", "component"]):
            for lo, hi in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
                if hi - lo <= CROWDED or (c[lo:hi] == c[lo]).all():
                    continue
                step = max(1, PAIRS_AT_ONCE // (hi - lo))
                for s in range(lo, hi, step):
                    i, j = np.nonzero(c[s : min(hi, s + step), None] != c[None, lo:hi])
                    i, j = i + s, j + lo
                    i, j = i[i < j], j[i < j]
                    ok = _possible(i, j, n, at)
                    yield _pairs(k, i[ok], j[ok])

    return met.repartition("h").sortWithinPartitions("h", "k").mapInArrow(rows, RUNS).select("a", "b").distinct()


def sketch(s: np.ndarray) -> np.ndarray:
    """Parities of a set's counts by value modulo a power of two, as words of 64."""
    size = max(SKETCH, 1 << (2 * len(s) - 1).bit_length())
    odd = np.bincount(s & (size - 1), minlength=size) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64)


def sketches(docs: DataFrame, width: int = WIDTH) -> DataFrame:
    """(k, n, bits): of each text the number of shingles and the sketch."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1)
            for lo, hi in column_slices(texts, SLICE):
                sets = [shingle_set(t, width) for t in texts.slice(lo, hi - lo).to_pylist()]
                bits = pa.array(list(map(sketch, sets)), pa.list_(pa.int64()))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), pa.array([len(s) for s in sets], pa.int32()), bits], ["k", "n", "bits"])

    made = _texts(docs).mapInArrow(rows, "k long, n int, bits array<long>")
    return made.groupBy("k").agg(F.first("n").alias("n"), F.first("bits").alias("bits"))


def plausible(pairs: DataFrame, made: DataFrame) -> DataFrame:
    """The pairs without those whose sketches alone rule the similarity out.

    Sets differ in at least as many shingles as their parities do, and similar
    ones in a ninth of their sizes at most: no similar pair is lost. The larger of
    two sketches is folded once; similar sets' sizes are never further apart.
    """
    left, right = (made.select(F.col("k").alias(x), F.col("n").alias(f"n{x}"), F.col("bits").alias(f"bits{x}")) for x in "ab")

    def folded(one: str, two: str):
        half = (F.size(one) / 2).cast("int")
        fold = F.zip_with(F.slice(one, 1, half), F.slice(one, half + 1, half), lambda x, y: x.bitwiseXOR(y))
        return F.when(F.size(one) > F.size(two), fold).otherwise(F.col(one))

    a, b = folded("bitsa", "bitsb"), folded("bitsb", "bitsa")
    differ = F.aggregate(F.zip_with(a, b, lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda x, y: x + y)
    return pairs.join(left, "a").join(right, "b").filter((F.size(a) == F.size(b)) & (9 * differ <= F.col("na") + F.col("nb"))).select("a", "b")


def similar(docs: DataFrame, pairs: DataFrame, width: int = WIDTH) -> DataFrame:
    """The pairs (a, b) of texts whose shingle sets have a similarity of 4/5 or more.

    A set travels once for each pair in which its text is the larger one, and
    meets there the set of the smaller, which comes once.
    """

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1)
            for lo, hi in column_slices(texts, SLICE):
                raw = [shingle_set(t, width).tobytes() for t in texts.slice(lo, hi - lo).to_pylist()]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), pa.array(raw, pa.binary())], ["k", "s"])

    def compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, own = None, np.zeros(0, np.int64)
        for batch in batches:
            found: list[tuple[int, int]] = []
            for a, b, raw in zip(*(batch.column(c).to_pylist() for c in ("a", "b", "s")), strict=True):
                s = np.frombuffer(raw, np.int64)
                if b is None:
                    now, own = a, s
                elif a == now:
                    both = np.intersect1d(own, s, assume_unique=True).size
                    if 9 * both >= 4 * (len(own) + len(s)):
                        found.append((a, b))
            yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in found], pa.int64()), pa.array([x for _, x in found], pa.int64())], ["a", "b"])

    needed = written(pairs.select(F.explode(F.array("a", "b")).alias("k")).distinct(), "needed")
    texts = _texts(docs).join(light(needed), "k", "left_semi").groupBy("k").agg(F.first("text").alias("text"))
    made = written(texts.mapInArrow(sets, "k long, s binary"), "sets")
    larger = pairs.join(made.withColumnRenamed("k", "b"), "b").select("a", "b", "s")
    smaller = made.withColumnRenamed("k", "a").join(pairs.select("a").distinct(), "a", "left_semi").select("a", F.lit(None).cast("long").alias("b"), "s")
    met = larger.unionByName(smaller).repartition("a").sortWithinPartitions("a", F.col("b").asc_nulls_first())
    return met.mapInArrow(compared, "a long, b long")


def near_duplicates(docs: DataFrame, width: int = WIDTH) -> DataFrame:
    """(node, component) of every text linked to another; ``node`` is its text_key."""
    first = written(runs(prefixes(docs, width)), "pairs")
    made = written(sketches(docs, width), "sketches")
    check = lambda pairs: similar(docs, written(plausible(pairs, made), "plausible"), width)
    crowded = first.filter("k IS NOT NULL").select("h", "k", "n", "at")
    pairs = first.filter("a IS NOT NULL").select("a", "b").distinct()
    some = not crowded.isEmpty()
    edges = written(check(pairs.unionByName(stars(crowded)) if some else pairs), "links")
    found = components(edges)
    if not some:
        return found
    labelled = crowded.join(found.withColumnRenamed("node", "k"), "k", "left").withColumn("component", F.coalesce("component", "k"))
    return components(edges.unionByName(check(written(crossing(labelled), "pairs"))))
