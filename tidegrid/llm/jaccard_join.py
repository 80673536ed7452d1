"""Exact Jaccard join of word n-gram sets, by a partition of the universe.

Two sets of R and S tokens with a similarity of p/q or more differ in at most
H = (q - p)(R + S) // (q + p) tokens. Sets are put in bands by size. A band deals the
whole universe of tokens to H + 1 segments by hash, H its greatest; a set's tokens in a
segment are indexed by their sum. By the pigeonhole principle, if a set gives its
segments allowances v of 0, 1 or 2 that sum to H + 1 or more, some segment of a partner
differs from its own in fewer tokens than its allowance: in none, or in one, which the
sums without one token show (the one-deletion neighbourhood). The larger set of a pair
asks, in its own band and in the one below; the smaller one is indexed in its own.
Deletions of the indexed side are kept for some segments of a band only, and only these
may get an allowance of 2.

Allowances are chosen by cost: a segment costs as much as its rarest token is common in
a sample of the texts, with an allowance of 2 as its second rarest; empty segments come
last. The choice decides the cost, never the result.

Equal sets are one class from the start. Rows that meet at a sum are paired where they
are few. A crowded sum first sends its leading rows (the four smallest sums of each set,
which near copies share) to a few hubs, the set most of whose sums are crowded and some in
fixed random orders; after these links, the rest of its pairs are
those of different components, made in tiles of bounded size and ruled out by parity
sketches there. Sums made of common tokens alone never travel to one task. All
remaining pairs are compared by whole sets: no link is lost.

Defined results: a null text, or one without words, has no tokens and links with
nothing; one of fewer words than a shingle is one shingle; rows of equal ids are each
linked by their own text; a row without an id takes part, and its component is the
smallest id reachable, null if none is; an empty table gives no rows; other columns are
ignored; texts of any length are compared whole. Tokens are told apart by 64-bit hashes,
sets by 128-bit ones.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidegrid.llm.chunks import column_slices
from tidegrid.llm.near_jaccard import COMMON, ONE_OF, sketch, text_key
from tidegrid.llm.shared import light, written
from tidegrid.llm.simhash_anchor import components

WIDTH, SIMILARITY = 4, (85, 100)
#: One segment in so many keeps the one-deletion sums of indexed sets; at least so many do.
RESERVE, RESERVED = 16, 2
#: Cost of an empty segment, and of a text of the sample beside one row.
EMPTY = 1 << 40
#: A token in more texts of the sample is common.
RARE = 2
#: Rows at a sum that are all paired; rows of a crowded sum that its leading ones are sent to.
CROWDED, HUBS = 6, 4
#: Sums by which a set leads.
LEADING = 4
#: Rows of a tile's side.
TILE = 512
#: Partners of one set that meet in one task.
PARTNERS = 256
SLICE = 2_000_000
#: Sets and words that a task remembers.
SEEN, WORDS = 100_000, 200_000
#: Bits of what a row of its sum is.
INDEX, ASKS, HOT, LEADS = 1, 2, 4, 8


class Bands:
    """Sizes of sets, cut so that partners are in the same band or in neighbouring ones."""

    def __init__(self, similarity: tuple[int, int] = SIMILARITY) -> None:
        self.p, self.q = similarity
        self.low, self.high = [1], [1]

    def differ(self, total):
        """How many tokens two similar sets of so many together differ in at most."""
        return (self.q - self.p) * total // (self.q + self.p)

    def grow(self, size: int) -> None:
        while self.high[-1] < size:
            self.low.append(self.high[-1] + 1)
            self.high.append(max(self.low[-1], self.low[-1] * self.q // self.p))

    def of(self, sizes: np.ndarray) -> np.ndarray:
        self.grow(int(sizes.max(initial=1)))
        return np.searchsorted(np.array(self.high), sizes)

    def segments(self, band: np.ndarray) -> np.ndarray:
        """Segments of a band: one more than two similar sets, the smaller one in it, may differ in."""
        high = np.array(self.high, np.int64)[band]
        return self.differ(high + high * self.q // self.p) + 1


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    return h ^ (h >> np.uint64(29))


def _ranked(owner: np.ndarray, *by: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(order, rank of each ordered row among those of its owner), by ``by``, the last first."""
    order = np.lexsort((*by, owner))
    sorted_owner = owner[order]
    starts = np.flatnonzero(np.concatenate([[True], sorted_owner[1:] != sorted_owner[:-1]])) if len(order) else np.zeros(0, np.int64)
    return order, np.arange(len(order)) - np.repeat(starts, np.diff(np.append(starts, len(order))))


def signatures(sets: list[np.ndarray], common: np.ndarray, counts: np.ndarray, bands: Bands) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(set, sum, what it is) of all rows of some sets of tokens (uint64, distinct): their places, sums and bits."""
    sizes = np.array([len(s) for s in sets], np.int64)
    tokens = np.concatenate(sets) if len(sets) else np.zeros(0, np.uint64)
    owner = np.repeat(np.arange(len(sets)), sizes)
    found = np.zeros(len(tokens), np.int64)
    if len(common):
        spot = np.minimum(np.searchsorted(common, tokens.view(np.int64)), len(common) - 1)
        found = np.where(common[spot] == tokens.view(np.int64), counts[spot], 0)
    band = bands.of(sizes)
    made = [_rows(tokens, owner, found, sizes, band, bands, True), _rows(tokens, owner, found, sizes, band - 1, bands, False)]
    return tuple(np.concatenate(c) for c in zip(*made, strict=True))


def _rows(tokens, owner, found, sizes, band, bands: Bands, own: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The rows of sets in their own band, or of what they ask in the one below."""
    none = np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.int8)
    high = np.array(bands.high, np.int64)[np.maximum(band, 0)]
    m = bands.segments(np.maximum(band, 0))
    use = (sizes > 0) & (m > 1) & (band >= 0)
    if not own:
        use &= bands.p * sizes <= bands.q * high
    if not use.any():
        return none
    keep = use[owner]
    tokens, owner, found = tokens[keep], owner[keep], found[keep]
    m = np.where(use, m, 0)
    base = np.cumsum(m) - m
    total = int(m.sum())
    of = np.repeat(np.arange(len(sizes)), m)  # the set of each segment
    local = np.arange(total) - base[of]
    segment = base[owner] + ((tokens & np.uint64(0xFFFFFFFF)) * m[owner].astype(np.uint64) >> np.uint64(32)).astype(np.int64)
    order, rank = _ranked(segment, found)
    tokens, segment, found = tokens[order], segment[order], found[order]
    n = np.bincount(segment, minlength=total)
    filled, starts = np.flatnonzero(n), np.flatnonzero(rank == 0)
    sums = np.zeros(total, np.uint64)
    first, second = np.zeros(total, np.int64), np.zeros(total, np.int64)
    sums[filled] = np.add.reduceat(tokens, starts)
    first[filled] = found[starts]
    second[segment[rank == 1]] = found[rank == 1]
    # allowances: the cheapest steps 0 -> 1 and 1 -> 2 that sum to what a set needs
    reserved = local < np.maximum(RESERVED, m[of] // RESERVE)
    one = np.where(n == 0, EMPTY, 1 + ONE_OF * first)
    more = np.flatnonzero(reserved & (n > 1))
    two = np.maximum(one[more], n[more] + 1 + ONE_OF * second[more])
    need = bands.differ(sizes + np.minimum(sizes, high)) + 1
    steps, place = np.concatenate([of, of[more]]), np.concatenate([np.arange(total), more])
    order, step = _ranked(steps, np.repeat([0, 1], [total, len(more)]), np.concatenate([one, two]))
    chosen = order[step < need[steps[order]]]
    allowed = np.bincount(place[chosen], minlength=total)
    # rows: whole segments, and segments without one token
    salt = _mixed((band[of].astype(np.uint64) << np.uint64(32)) + local.astype(np.uint64) + np.uint64(1))
    whole = np.where(allowed > 0, ASKS, 0) | np.where((n == 0) | (first > RARE), HOT, 0) | (INDEX if own else 0)
    sent = np.flatnonzero(whole & (INDEX | ASKS))
    at = np.flatnonzero((n[segment] > 1) & ((reserved[segment] if own else False) | (allowed[segment] > 1)))
    less = np.where(allowed[segment[at]] > 1, ASKS, 0) | np.where(np.where(rank[at] == 0, second[segment[at]], first[segment[at]]) > RARE, HOT, 0)
    less |= np.where(reserved[segment[at]], INDEX, 0) if own else 0
    h = np.concatenate([_mixed(sums[sent] ^ salt[sent]), _mixed((sums[segment[at]] - tokens[at]) ^ salt[segment[at]])])
    rows, what = np.concatenate([of[sent], owner_of(segment[at], of)]), np.concatenate([whole[sent], less])
    if own:
        leads = np.flatnonzero(n[sent] > 0)
        order, rank = _ranked(of[sent][leads], h[leads])
        what[leads[order[rank < LEADING]]] |= LEADS
    return rows, h, what.astype(np.int8)


def owner_of(segment: np.ndarray, of: np.ndarray) -> np.ndarray:
    return of[segment]


class WordHashes(dict):
    """XXH64 of words, remembered for a bounded number of them."""

    def __missing__(self, word: bytes) -> int:
        from xxhash import xxh64_intdigest

        h = xxh64_intdigest(word, 42)
        if len(self) < WORDS:
            self[word] = h
        return h


def token_set(raw: bytes | None, width: int, hashes: WordHashes) -> np.ndarray:
    """The distinct shingles of a text, sorted (uint64): hashes of the sequences of their words' hashes."""
    words = (raw or b"").lower().split()  # bytes: A-Z only, and ASCII white space only
    if not words:
        return np.zeros(0, np.uint64)
    w = np.fromiter(map(hashes.__getitem__, words), np.uint64, len(words))
    width = min(width, len(w))
    h = np.full(len(w) - width + 1, width, np.uint64)
    for i in range(width):
        h = h * np.uint64(0xD6E8FEB86659FD93) + w[i : len(w) - width + 1 + i]
    h = np.sort(_mixed(h))
    return h[np.concatenate([[True], h[1:] != h[:-1]])]


def common_tokens(docs: DataFrame, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(tokens, sorted; their counts) in over RARE texts of a sample by hash, the commonest of them."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for batch in batches:
            for lo, hi in column_slices(batch.column("text"), SLICE):
                sets = [token_set(t, width, hashes) for t in batch.column("text").slice(lo, hi - lo).to_pylist()]
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(sets).view(np.int64))], ["h"])

    sample = docs.filter(F.pmod(text_key(), F.lit(ONE_OF)) == 0).select(F.col("text").cast("string").cast("binary").alias("text"))
    counts = sample.mapInArrow(rows, "h long").groupBy("h").count().filter(F.col("count") > RARE)
    found = counts.orderBy(F.desc("count"), "h").limit(COMMON).collect()
    h, n = np.array([r.h for r in found], np.int64), np.array([r["count"] for r in found], np.int64)
    order = np.argsort(h)
    return h[order], n[order]


def listed(docs: DataFrame, width: int, similarity: tuple[int, int]) -> DataFrame:
    """(doc_id, key, digest, n, node, m, h, what, bits) of every row.

    Only the first row of a set in its task is a node, with its m sums and a sketch.
    """
    shipped = docs.sparkSession.sparkContext.broadcast(common_tokens(docs, width))

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from xxhash import xxh3_128_digest

        (common, counts), bands, seen, hashes = shipped.value, Bands(similarity), set(), WordHashes()
        node = TaskContext.get().partitionId() << 33
        for batch in batches:
            texts = batch.column("text")
            for lo, hi in column_slices(texts, SLICE):
                sets = [token_set(t, width, hashes) for t in texts.slice(lo, hi - lo).to_pylist()]
                digests = [xxh3_128_digest(s.tobytes()) if len(s) else None for s in sets]
                nodes, carriers = [None] * len(sets), []
                for i, d in enumerate(digests):
                    if d is not None and d not in seen:
                        if len(seen) < SEEN:
                            seen.add(d)
                        nodes[i], node = node, node + 1
                        carriers.append(i)
                of, h, what = signatures([sets[i] for i in carriers], common, counts, bands)
                order = np.argsort(of, kind="stable")
                ends = np.searchsorted(of[order], np.arange(len(carriers) + 1)).tolist()
                h, what = h[order].view(np.int64), what[order]
                lists, numbers = [[None] * len(sets) for _ in range(3)], [None] * len(sets)
                for place, i in enumerate(carriers):
                    a, b = ends[place], ends[place + 1]
                    numbers[i] = b - a
                    lists[0][i], lists[1][i], lists[2][i] = h[a:b], what[a:b], sketch(sets[i].view(np.int64))
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("doc_id").slice(lo, hi - lo), batch.column("key").slice(lo, hi - lo), pa.array(digests, pa.binary()), pa.array([len(s) for s in sets], pa.int64()), pa.array(nodes, pa.int64()), pa.array(numbers, pa.int32()),
                        pa.array(lists[0], pa.list_(pa.int64())), pa.array(lists[1], pa.list_(pa.int8())), pa.array(lists[2], pa.list_(pa.int64())),
                    ],
                    ["doc_id", "key", "digest", "n", "node", "m", "h", "what", "bits"],
                )

    chosen = docs.select("doc_id", text_key().alias("key"), F.col("text").cast("string").cast("binary").alias("text"))
    kind = docs.select("doc_id").schema[0].dataType.simpleString()
    return chosen.mapInArrow(rows, f"doc_id {kind}, key long, digest binary, n long, node long, m int, h array<long>, what array<tinyint>, bits array<long>")


ROWS = "h long, k long, n int, what tinyint"
PAIRS = "a long, b long, " + ROWS
PAIR_NAMES = [c.split()[0] for c in PAIRS.split(", ")]


def laid_out(nodes: DataFrame, hot: bool) -> DataFrame:
    """(h, k, n, what): the rows of all nodes at common sums, or at the others."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 256):
                part = batch.slice(lo, 256)
                h = part.column("h")
                sizes = np.diff(np.asarray(h.offsets))
                what = np.asarray(part.column("what").flatten())
                keep = ((what & HOT) > 0) == hot
                columns = [np.asarray(h.flatten()), np.repeat(np.asarray(part.column("node")), sizes), np.repeat(np.asarray(part.column("n")).astype(np.int32), sizes), what]
                yield pa.RecordBatch.from_arrays([pa.array(c[keep]) for c in columns], ["h", "k", "n", "what"])

    return nodes.select("node", "n", "h", "what").mapInArrow(rows, ROWS)


def _may(n: np.ndarray, what: np.ndarray, i: np.ndarray, j: np.ndarray, p: int, q: int) -> np.ndarray:
    """Whether one of two rows asks for the other, not larger, indexed one, and sizes allow the similarity."""
    asks = lambda x, y: (what[x] & ASKS > 0) & (what[y] & INDEX > 0) & (n[x] >= n[y])
    big, small = np.maximum(n[i], n[j]).astype(np.int64), np.minimum(n[i], n[j]).astype(np.int64)
    return (asks(i, j) | asks(j, i)) & (q * small >= p * big)


def met(rows: DataFrame, similarity: tuple[int, int]) -> DataFrame:
    """(a, b): pairs of rows at sums that are not crowded; and the rows of those that are.

    Rows are streamed by sum; of a crowded one no more than its first rows are held.
    """
    p, q = similarity

    def paired(h, k, n, what) -> Iterator[pa.RecordBatch]:
        starts = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]]))
        sizes = np.diff(np.append(starts, len(h)))
        crowd = np.repeat(sizes > CROWDED, sizes)
        end = np.repeat(starts + sizes, sizes)
        if crowd.any():
            yield pa.RecordBatch.from_arrays([*[pa.nulls(int(crowd.sum()), pa.int64())] * 2, *(pa.array(c[crowd]) for c in (h, k, n, what))], PAIR_NAMES)
        alive = np.flatnonzero(~crowd)
        for shift in range(1, CROWDED):
            alive = alive[alive + shift < end[alive]]
            if not len(alive):
                break
            i = alive[(k[alive] != k[alive + shift]) & _may(n, what, alive, alive + shift, p, q)]
            j = i + shift
            none = [pa.nulls(len(i), t) for t in (pa.int64(), pa.int64(), pa.int32(), pa.int8())]
            yield pa.RecordBatch.from_arrays([pa.array(np.minimum(k[i], k[j])), pa.array(np.maximum(k[i], k[j])), *none], PAIR_NAMES)

    def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, full = None, None  # the rows of the last sum; the sum whose rows pass by
        for batch in batches:
            if not batch.num_rows:
                continue
            columns = [np.asarray(batch.column(c)) for c in ("h", "k", "n", "what")]
            if held is not None:
                columns = [np.concatenate(c) for c in zip(held, columns, strict=True)]
            h = columns[0]
            if full is not None:
                by = int(np.searchsorted(h, full, "right"))
                if by:
                    yield pa.RecordBatch.from_arrays([*[pa.nulls(by, pa.int64())] * 2, *(pa.array(c[:by]) for c in columns)], PAIR_NAMES)
                columns = [c[by:] for c in columns]
                h, full = columns[0], full if by == len(h) else None
                if not len(h):
                    held = None
                    continue
            last = int(np.searchsorted(h, h[-1]))
            if len(h) - last > CROWDED:
                full, last = h[-1], len(h)
            if last:
                yield from paired(*(c[:last] for c in columns))
            held = [c[last:] for c in columns] if last < len(h) else None
        if held is not None:
            yield from paired(*held)

    return rows.repartition("h").sortWithinPartitions("h").mapInArrow(stream, PAIRS)


#: Odd factors that put nodes in fixed random orders.
ORDERS = (0x1E3779B97F4A7C15, 0x42B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5)


def _turn(k: str, factor: int) -> Column:
    return F.xxhash64(F.lit(factor), k)


def hubs_of(crowded: DataFrame, nodes: DataFrame, similarity: tuple[int, int]) -> DataFrame:
    """Pairs (a, b) of each leading row of a crowded sum and the sum's hubs.

    A hub is the set with the largest share of its sums crowded - one that others are
    edited from shares all of its sums, its copies have some of their own - or the first
    in a fixed random order, the same at every sum.
    """
    p, q = similarity
    share = crowded.groupBy("k").agg(F.count(F.lit(1)).alias("own")).join(nodes.select(F.col("node").alias("k"), "m"), "k").select("k", (F.col("own") / F.col("m")).alias("share"))
    leads = crowded.filter(F.col("what").bitwiseAND(F.lit(LEADS)) > 0).select("h", "k", "n").join(share, "k")
    hub = [F.col("k").alias("hub"), F.col("n").alias("size")]
    firsts = [F.max(F.struct("share", _turn("k", ORDERS[0]).alias("t"), *hub)), *(F.min(F.struct(_turn("k", f).alias("t"), *hub)) for f in ORDERS[1:HUBS])]
    hubs = leads.groupBy("h").agg(F.count(F.lit(1)).alias("rows"), *(x.alias(f"x{i}") for i, x in enumerate(firsts))).filter("rows > 1")
    hubs = light(written(hubs.select("h", F.array(*(F.struct(F.col(f"x{i}.hub"), F.col(f"x{i}.size")) for i in range(HUBS))).alias("hubs")), "hubs"))
    each = leads.join(hubs, "h").select("k", "n", F.explode(F.array_distinct("hubs")).alias("x")).select("k", "n", "x.hub", "x.size")
    fits = (F.col("k") != F.col("hub")) & (q * F.least("n", "size") >= p * F.greatest("n", "size"))
    return each.filter(fits).select(F.least("k", "hub").alias("a"), F.greatest("k", "hub").alias("b")).distinct()


#: Bits that sketches are folded to where rows are compared in tiles.
FOLDED = 1024


def _folded(bits: np.ndarray) -> np.ndarray:
    while len(bits) > FOLDED // 64:
        bits = bits[: len(bits) // 2] ^ bits[len(bits) // 2 :]
    return bits


def crossing(crowded: DataFrame, found: DataFrame, sketches: DataFrame, similarity: tuple[int, int]) -> DataFrame:
    """Pairs (a, b) of different components at crowded sums that sketches don't rule out.

    A sum's rows are dealt to tiles of bounded sides, each pair of sides in one tile.
    """
    p, q = similarity
    named = crowded.join(found.withColumnRenamed("node", "k"), "k", "left").withColumn("c", F.coalesce("component", "k")).select("h", "k", "n", "what", "c")
    named = written(named, "named")
    asks, indexed = F.col("what").bitwiseAND(F.lit(ASKS)) > 0, F.col("what").bitwiseAND(F.lit(INDEX)) > 0
    sums = named.groupBy("h").agg(F.count(F.lit(1)).alias("rows"), F.min("c").alias("least"), F.max("c").alias("most"), F.max(asks).alias("asks"), F.max(indexed).alias("indexed"))
    mixed = written(sums.filter("least <> most AND asks AND indexed").select("h", F.ceil(F.col("rows") / TILE).cast("int").alias("sides")), "mixed")
    rows = named.join(light(mixed), "h").withColumn("side", F.pmod(F.xxhash64("k"), F.col("sides")).cast("int"))
    other = F.sequence(F.lit(0), F.col("sides") - 1)
    tiles = rows.withColumn("x", F.explode(other)).select("h", F.least("side", "x").alias("i"), F.greatest("side", "x").alias("j"), "side", "k", "n", "what", "c")
    tiles = tiles.join(sketches.select(F.col("node").alias("k"), "bits"), "k")

    def rows_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list] = []

        def out() -> pa.RecordBatch:
            side, k, n, what, c, bits = (np.array([r[x] for r in held]) for x in range(3, 9))
            i, j = np.nonzero(c[:, None] != c[None, :])
            i, j = i[i < j], j[i < j]
            if held[0][1] != held[0][2]:  # pairs of one side meet in that side's own tile
                apart = side[i] != side[j]
                i, j = i[apart], j[apart]
            ok = (k[i] != k[j]) & _may(n, what, i, j, p, q)
            i, j = i[ok], j[ok]
            apart = np.bitwise_count(bits[i] ^ bits[j]).sum(axis=1, dtype=np.int64)
            ok = (q + p) * apart <= (q - p) * (n[i].astype(np.int64) + n[j])
            i, j = i[ok], j[ok]
            return pa.RecordBatch.from_arrays([pa.array(np.minimum(k[i], k[j])), pa.array(np.maximum(k[i], k[j]))], ["a", "b"])

        for batch in batches:
            lists = [batch.column(c).to_pylist() for c in ("h", "i", "j", "side", "k", "n", "what", "c")]
            bits = batch.column("bits")
            offsets, flat = np.asarray(bits.offsets), np.asarray(bits.flatten())
            offsets = offsets - offsets[0]
            for x, row in enumerate(zip(*lists, strict=True)):
                if held and row[:3] != tuple(held[0][:3]):
                    yield out()
                    held.clear()
                held.append([*row, _folded(flat[offsets[x] : offsets[x + 1]].view(np.uint64))])
        if held:
            yield out()

    dealt = tiles.repartition("h", "i", "j").sortWithinPartitions("h", "i", "j")
    return dealt.mapInArrow(rows_of, "a long, b long").distinct()


def plausible(pairs: DataFrame, sketches: DataFrame, similarity: tuple[int, int]) -> DataFrame:
    """The pairs that parity sketches do not rule out; sets differ at least as much as their parities."""
    p, q = similarity
    one, two = (sketches.select(F.col("node").alias(x), F.col("n").alias(f"n{x}"), F.col("bits").alias(f"bits{x}")) for x in "ab")

    def folded(own: str, other: str) -> Column:
        half = (F.size(own) / 2).cast("int")
        return F.when(F.size(own) > F.size(other), F.zip_with(F.slice(own, 1, half), F.slice(own, half + 1, half), lambda x, y: x.bitwiseXOR(y))).otherwise(F.col(own))

    left, right = folded("bitsa", "bitsb"), folded("bitsb", "bitsa")
    apart = F.aggregate(F.zip_with(left, right, lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda x, y: x + y)
    return pairs.join(one, "a").join(two, "b").filter((F.size(left) == F.size(right)) & ((q + p) * apart <= (q - p) * (F.col("na") + F.col("nb")))).select("a", "b")


def verified(docs: DataFrame, nodes: DataFrame, pairs: DataFrame, width: int, similarity: tuple[int, int]) -> DataFrame:
    """The pairs (a, b) of nodes whose whole sets are similar.

    A pair's set b travels to its set a; partners of one a are dealt to several tasks,
    each with a copy of a, so that no task gets more than a bounded number of them.
    """
    p, q = similarity

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from xxhash import xxh3_128_digest

        hashes = WordHashes()
        for batch in batches:
            texts = batch.column("text")
            for lo, hi in column_slices(texts, SLICE):
                raw = [token_set(t, width, hashes).tobytes() for t in texts.slice(lo, hi - lo).to_pylist()]
                yield pa.RecordBatch.from_arrays([pa.array([xxh3_128_digest(s) for s in raw], pa.binary()), pa.array(raw, pa.binary())], ["digest", "s"])

    def compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, own = None, np.zeros(0, np.uint64)
        for batch in batches:
            linked: list[tuple[int, int]] = []
            for a, b, raw in zip(*(batch.column(c).to_pylist() for c in ("a", "b", "s")), strict=True):
                s = np.frombuffer(raw, np.uint64)
                if b is None:
                    now, own = a, s
                elif a == now:
                    both = np.intersect1d(own, s, assume_unique=True).size
                    if q * both >= p * (len(own) + len(s) - both):
                        linked.append((a, b))
            yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in linked], pa.int64()), pa.array([x for _, x in linked], pa.int64())], ["a", "b"])

    needed = written(pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct().join(nodes.select("node", "key", "digest"), "node"), "needed")
    texts = docs.select(text_key().alias("key"), F.col("text").cast("string").cast("binary").alias("text"))
    texts = texts.join(light(needed.select("key").distinct()), "key", "left_semi").groupBy("key", F.xxhash64("text", F.lit(1))).agg(F.first("text").alias("text"))
    made = texts.select("text").mapInArrow(sets, "digest binary, s binary").groupBy("digest").agg(F.first("s").alias("s"))
    made = written(needed.select("node", "digest").join(made, "digest").select("node", "s"), "sets")
    many = pairs.groupBy("a").count().filter(F.col("count") > PARTNERS).select("a", F.ceil(F.col("count") / PARTNERS).cast("int").alias("parts"))
    dealt = pairs.join(light(written(many, "hubs")), "a", "left").select("a", "b", F.pmod(F.xxhash64("b"), F.coalesce("parts", F.lit(1))).cast("int").alias("part"))
    others = dealt.join(made.withColumnRenamed("node", "b"), "b").select("a", "part", "b", "s")
    owns = dealt.select("a", "part").distinct().join(made.withColumnRenamed("node", "a"), "a").select("a", "part", F.lit(None).cast("long").alias("b"), "s")
    both = others.unionByName(owns).repartition("a", "part").sortWithinPartitions("a", "part", F.col("b").asc_nulls_first())
    return both.mapInArrow(compared, "a long, b long")


def join(docs: DataFrame, width: int = WIDTH, similarity: tuple[int, int] = SIMILARITY) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(rows, classes, links): rows (doc_id, n, digest), classes of equal sets (digest, node, least id), links (a, b) of nodes.

    Links join all nodes that a chain of similar pairs joins; pairs within crowded sums
    whose nodes a chain joins already are not all listed.
    """
    rows = written(listed(docs, width, similarity), "listed")
    classes = rows.filter("digest IS NOT NULL").groupBy("digest").agg(F.min("node").alias("node"), F.min("doc_id").alias("least"))
    classes = written(classes, "classes")
    carriers = rows.filter("node IS NOT NULL")
    extra = carriers.select("digest", F.col("node").alias("own")).join(classes.select("digest", "node"), "digest").filter("own > node").select(F.col("own").alias("node"))
    nodes = carriers.join(light(written(extra, "extra")), "node", "left_anti")
    first = written(met(laid_out(nodes, False), similarity), "met")
    hot = written(laid_out(nodes, True), "common")
    crowded = first.filter("k IS NOT NULL").select("h", "k", "n", "what").unionByName(hot)
    pairs = first.filter("a IS NOT NULL").select("a", "b").unionByName(hubs_of(crowded, nodes, similarity)).distinct()
    check = lambda some: written(verified(docs, nodes, written(plausible(some, nodes, similarity), "plausible"), width, similarity), "links")
    links = check(pairs)
    more = written(crossing(crowded, components(links), nodes, similarity), "crossing")
    return rows.select("doc_id", "n", "digest"), classes, links if more.isEmpty() else links.unionByName(check(more))


def components_of(docs: DataFrame, width: int = WIDTH, similarity: tuple[int, int] = SIMILARITY) -> DataFrame:
    """(doc_id, n_shingles, component_id) of every row."""
    rows, classes, links = join(docs, width, similarity)
    known = classes.join(written(components(links), "components"), "node", "left").select("digest", "least", F.coalesce("component", "node").alias("component"))
    known = written(known, "known")
    shared = known.groupBy("component").agg(F.min("least").alias("least"), F.count(F.lit(1)).alias("classes")).filter("classes > 1").select("component", F.col("least").alias("smallest"))
    labels = written(known.join(light(written(shared, "shared")), "component", "left").select("digest", F.coalesce("smallest", "least").alias("smallest")), "labels")
    return rows.join(labels, "digest", "left").select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("digest").isNull(), F.col("doc_id")).otherwise(F.col("smallest")).alias("component_id"))
