"""SimHash near-duplicates by anchor-point covering.

Anchors are the pairs of codewords of two perfect binary [23, 12] codes laid over
bits 0-22 and 23-45 of the fingerprint: every half-word lies within 3 bits (the
covering radius) of exactly one codeword. Two fingerprints within ``threshold``
bits have a midpoint within half of it of both; the midpoint's anchor is in reach
of both. A fingerprint therefore goes to the anchors of all points within
ceil(threshold / 2) bits of it - for a threshold of 2, those within the covering
radius plus one in either half, about ten of 2^24 - and every linked pair meets
at an anchor. Sharing the threshold between both sides loses no pair and makes
fewer copies than radius plus threshold on each.

Fingerprints meet as distinct values. At an anchor they are compared in numpy;
crowded anchors look up all fingerprints within the threshold instead of
comparing all pairs, so their cost stays linear. An anchor yields a spanning
star of each local component, never all pairs. Components over all anchors come
from alternating large-star and small-star rounds, each written to the shared
folder.

Defined results: a null or empty text, or one without words, has fingerprint 0
and links like any other; a row without an id gets its fingerprint but takes no
part in linking, and has no component; rows with equal ids are each linked by their
own text; an empty table gives no rows; other columns are ignored; texts of any
length are fingerprinted whole.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidegrid.llm.chunks import batches_of
from tidegrid.llm.shared import written

SEED = 42
SHINGLE = 3
BITS = 64
#: Fixed value: generator polynomial of the perfect [23, 12, 7] code, and its length.
GENERATOR, LENGTH = 0b101011100011, 23
LOW = (1 << LENGTH) - 1
#: Anchors with more fingerprints than this look neighbours up; fewer are compared.
CROWDED = 2048
#: Rows compared at a time.
ROWS_AT_ONCE = 200_000


# ---------------------------------------------------------------- fingerprints


def shingle_hashes(raw: bytes, width: int = SHINGLE) -> list[int]:
    """XXH64 of every word shingle of a text, repeats included."""
    from xxhash import xxh64_intdigest

    words = raw.lower().split()  # bytes: A-Z only, and ASCII white space only
    if not words:
        return []
    joined = b" ".join(words)
    if len(words) <= width:
        return [xxh64_intdigest(joined, SEED)]
    ends = list(itertools.accumulate((len(w) + 1 for w in words), initial=0))
    return [xxh64_intdigest(joined[a : b - 1], SEED) for a, b in zip(ends, ends[width:], strict=False)]


def fingerprints_of(texts: list[bytes | None], width: int = SHINGLE) -> np.ndarray:
    """The fingerprints (uint64): bits set in over half of a text's hashes.

    Each hash is masked to four 16-bit lanes, sixteen times, and lanes are summed
    in stretches too short to overflow them.
    """
    hashes = [shingle_hashes(t or b"", width) for t in texts]
    counts = np.array([len(h) for h in hashes], np.int64)
    out = np.zeros(len(texts), np.uint64)
    if not counts.sum():
        return out
    h = np.fromiter(itertools.chain.from_iterable(hashes), np.uint64, int(counts.sum()))
    base = np.cumsum(counts) - counts
    starts, owner = [], []
    for i, (at, n) in enumerate(zip(base.tolist(), counts.tolist(), strict=True)):
        for s in range(0, n, 65_535):
            starts.append(at + s)
            owner.append(i)
    lanes = np.uint64(0x0001000100010001)
    owner_of = np.array(owner)
    for k in range(16):
        sums = np.add.reduceat((h >> np.uint64(k)) & lanes, starts)
        for lane in range(4):
            total = np.bincount(owner_of, ((sums >> np.uint64(16 * lane)) & np.uint64(0xFFFF)).astype(np.float64), len(texts))
            out |= (2 * total > counts).astype(np.uint64) << np.uint64(k + 16 * lane)
    return out


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = SHINGLE) -> DataFrame:
    """(doc_id, fp long) of every whole text."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1).to_pylist()
            for lo, hi in batches_of(texts, [len(t or b"") for t in texts]):
                fp = fingerprints_of(texts[lo:hi], width)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), pa.array(fp.view(np.int64))], ["doc_id", "fp"])

    chosen = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").cast("binary").alias("text"))
    return chosen.mapInArrow(rows, "doc_id long, fp long")


# --------------------------------------------------------------------- anchors


def _syndromes() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Remainders of the low 12 and the high 11 bits, and the error of each remainder."""

    def remainder(w: int) -> int:
        for bit in range(LENGTH - 1, 10, -1):
            if w >> bit & 1:
                w ^= GENERATOR << bit - 11
        return w

    unit = [remainder(1 << i) for i in range(LENGTH)]

    def table(bits: list[int]) -> np.ndarray:
        out = np.zeros(1 << len(bits), np.uint64)
        for i, r in enumerate(bits):
            out[1 << i : 2 << i] = out[: 1 << i] ^ np.uint64(r)
        return out

    errors = np.zeros(1 << 11, np.uint64)
    for weight in (1, 2, 3):
        for places in itertools.combinations(range(LENGTH), weight):
            r = 0
            for i in places:
                r ^= unit[i]
            errors[r] = sum(1 << i for i in places)
    return table(unit[:12]), table(unit[12:]), errors


_LOW_SYNDROME, _HIGH_SYNDROME, _ERROR = _syndromes()


def home(half: np.ndarray) -> np.ndarray:
    """The codeword within three bits of each 23-bit word."""
    return half ^ _ERROR[_LOW_SYNDROME[half & np.uint64(0xFFF)] ^ _HIGH_SYNDROME[half >> np.uint64(12)]]


def anchors(fp: np.ndarray, reach: int = 1) -> tuple[np.ndarray, np.ndarray]:
    """(anchor, place in fp): anchors of all points within ``reach`` bits, each once."""
    a, b = fp & np.uint64(LOW), fp >> np.uint64(LENGTH) & np.uint64(LOW)
    found = []
    for weight in range(reach + 1):
        for places in itertools.combinations(range(2 * LENGTH), weight):
            e = sum(1 << i for i in places)
            found.append(home(a ^ np.uint64(e & LOW)) | home(b ^ np.uint64(e >> LENGTH)) << np.uint64(LENGTH))
    table = np.sort(np.stack(found, axis=1), axis=1)
    fresh = np.ones(table.shape, bool)
    fresh[:, 1:] = table[:, 1:] != table[:, :-1]
    return table[fresh], np.nonzero(fresh)[0]


class Forest:
    """Components under unions given as arrays; the root is the smallest place."""

    def __init__(self, n: int) -> None:
        self.label = np.arange(n)

    def _flatten(self) -> None:
        while not np.array_equal(up := self.label[self.label], self.label):
            self.label = up

    def union(self, i: np.ndarray, j: np.ndarray) -> None:
        while len(i):
            a, b = self.label[i], self.label[j]
            apart = a != b
            if not apart.any():
                return
            i, j, a, b = i[apart], j[apart], a[apart], b[apart]
            np.minimum.at(self.label, np.maximum(a, b), np.minimum(a, b))
            self._flatten()


def link_crowded(fp: np.ndarray, threshold: int) -> np.ndarray:
    """Roots of a large group of distinct fingerprints, by looking up all neighbours."""
    order = np.argsort(fp)
    ordered, forest = fp[order], Forest(len(fp))
    for weight in range(1, threshold + 1):
        for places in itertools.combinations(range(BITS), weight):
            e = np.uint64(sum(1 << i for i in places))
            spot = np.searchsorted(ordered, fp ^ e)
            spot[spot == len(fp)] = 0
            hit = np.flatnonzero(ordered[spot] == fp ^ e)
            forest.union(hit, order[spot[hit]])
    return forest.label


def link_groups(group: np.ndarray, fp: np.ndarray, threshold: int) -> np.ndarray:
    """Roots of points within ``threshold`` bits of each other in the same run of ``group``."""
    edges = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1], [True]]))
    sizes = np.diff(edges)
    roots = np.arange(len(fp))
    big = sizes > CROWDED
    for at, n in zip(edges[:-1][big].tolist(), sizes[big].tolist(), strict=True):
        roots[at : at + n] = at + link_crowded(fp[at : at + n], threshold)
    small = np.repeat(~big & (sizes > 1), sizes)
    places = np.flatnonzero(small)
    g, x = group[places], fp[places]
    forest = Forest(len(places))
    alive = np.arange(len(places))
    for shift in range(1, int(sizes[~big].max(initial=1))):
        alive = alive[alive + shift < len(places)]
        alive = alive[g[alive] == g[alive + shift]]
        if not len(alive):
            break
        near = alive[np.bitwise_count(x[alive] ^ x[alive + shift]) <= threshold]
        forest.union(near, near + shift)
    roots[places] = places[forest.label]
    return roots


def compare(batches: Iterator[pa.RecordBatch], threshold: int) -> Iterator[pa.RecordBatch]:
    """Spanning edges (a, b) of rows (anchor, fp, node) sorted by anchor."""
    held: list[np.ndarray] = []

    def out(rows: np.ndarray) -> pa.RecordBatch:
        order = np.lexsort((rows[2], rows[0]))  # the smallest node of a group comes first
        group, fp, node = rows[0][order], rows[1][order].view(np.uint64), rows[2][order]
        roots = link_groups(group, fp, threshold)
        own = np.flatnonzero(roots != np.arange(len(roots)))
        return pa.RecordBatch.from_arrays([pa.array(node[own]), pa.array(node[roots[own]])], ["a", "b"])

    size = 0
    for batch in batches:
        held.append(np.stack([np.asarray(c) for c in batch.columns]))
        size += batch.num_rows
        if size >= ROWS_AT_ONCE:
            rows = np.concatenate(held, axis=1)
            whole = int(np.searchsorted(rows[0], rows[0][-1]))  # the last group may go on
            if whole:
                yield out(rows[:, :whole])
            held, size = [rows[:, whole:]], rows.shape[1] - whole
    if size:
        yield out(np.concatenate(held, axis=1))


def links(nodes: DataFrame, threshold: int = 2) -> DataFrame:
    """Edges (a, b) that connect all nodes (fp, node; fp distinct) within ``threshold`` bits."""
    reach = -(-threshold // 2)

    def replicate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fp, node = np.asarray(batch.column(0)), np.asarray(batch.column(1))
            for lo in range(0, len(fp), 20_000):
                at, place = anchors(fp[lo : lo + 20_000].view(np.uint64), reach)
                yield pa.RecordBatch.from_arrays([pa.array(at.view(np.int64)), pa.array(fp[lo + place]), pa.array(node[lo + place])], ["anchor", "fp", "node"])

    copies = nodes.select("fp", "node").mapInArrow(replicate, "anchor long, fp long, node long")
    met = copies.repartition("anchor").sortWithinPartitions("anchor")
    return met.mapInArrow(lambda batches: compare(batches, threshold), "a long, b long").distinct()


# ------------------------------------------------------------------ components


def components(edges: DataFrame) -> DataFrame:
    """(node, component): the smallest node reachable, for every node on an edge.

    Alternates large-star and small-star until the edges are stars of their
    smallest nodes. A centre's neighbours are never gathered: each round is a
    partially aggregated minimum and a join.
    """
    edges = written(edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    before = None
    while True:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).withColumn("m", F.least("a", "m"))
        large = both.join(least, "a").filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        # large-star edges point down: from a node to a smaller one
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        joined = large.join(least, "a")
        small = joined.filter("b > m").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(least.select("a", F.col("m").alias("b")))
        edges = written(small.filter("a <> b").distinct(), "edges")
        now = tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)"))).first())
        if now == before:
            return edges.select(F.col("a").alias("node"), F.col("b").alias("component"))
        before = now


def near_duplicates(docs: DataFrame, threshold: int = 2, id_col: str = "doc_id", text_col: str = "text", width: int = SHINGLE) -> DataFrame:
    """(doc_id, fp, component_id) of every row."""
    prints = written(fingerprints(docs, id_col, text_col, width), "fingerprints")
    nodes = prints.filter("doc_id IS NOT NULL").groupBy("fp").agg(F.min("doc_id").alias("least"))
    nodes = written(nodes.withColumn("node", F.col("fp")), "nodes")
    found = written(components(links(nodes, threshold)), "components")
    known = nodes.join(found, "node", "left").select("fp", "least", F.coalesce("component", "node").alias("component"))
    smallest = known.groupBy("component").agg(F.min("least").alias("component_id"))
    labelled = known.join(smallest, "component").select("fp", "component_id")
    joined = prints.join(labelled, "fp", "left")
    return joined.select("doc_id", "fp", F.when(F.col("doc_id").isNotNull(), F.col("component_id")).alias("component_id"))


def hexadecimal(fp: str = "fp"):
    """A fingerprint as 16 lower-case hexadecimal digits."""
    return F.lower(F.lpad(F.hex(fp), 16, "0"))
