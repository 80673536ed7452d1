"""Hierarchical Pitman-Yor language model, seated by Gibbs sampling on Spark.

A text is its words and one end token. The context of a token is the word before
it (the end token at a text's start); each context is a restaurant, all share one
parent, the restaurant of single words. Words are told apart by 64-bit hashes.
Every word of the training documents is a context and a dish of its own, and all
others are one unknown word. Words of at least ``least`` training occurrences - the
smallest power of two that at most HEAD words reach - have a code and are
broadcast; the weights of the rest (the tail) are a table that is joined to their
pairs. Pairs are never pruned. Asked for at most so many words (``most``), the rest
are one rare word instead, as contexts and as dishes; which rare word it is comes
from a restaurant of its own over all rare words and one unknown word.

Seating is sampled by Gibbs: in every pass all customers of every pair leave
their tables and are seated anew as one block, whose number of tables is drawn
from its exact conditional. Each table of a context is a customer of the parent,
which is seated after it. Within a pass the totals of all restaurants are fixed,
so that pairs are independent; the next pass goes on from the new totals, with
discounts and strengths drawn from their conditionals on a grid. After PASSES
passes the states of SWEEPS passes in a row are kept, and predictive
probabilities are averaged over them, with tables drawn once for each. Every draw
comes from a hash of the pair and the pass, so it is the same in whatever task it
is made. Of a pair of more than
EXACT customers the mean number of tables is carried on from EXACT by its
recursion, and the number drawn around it (tests: within 6 % for the usual, 15 % for
very large weights of a new table).

Plan. Word counts by one partially aggregated shuffle. Then each distinct pair
of each document travels once, as packed sorted arrays by a hash of the pair
(rare words by their own), and is written as one sorted row a bucket, beside its
distinct pairs with their counts: every pass is a scan of the latter alone. Pairs
with a word of the tail travel to that word's bucket, which keeps its tables and
customers from pass to pass; those that occur once have one table whatever the
weights. Only a pair of two words of the tail needs more than its bucket has: its
first word's bucket sends tables there, and gets customers, in each pass if the
pair occurs again, and once for the scores.
Scoring sums log probabilities by document, again packed, in one more exchange.
Pairs of over a hundredth of the documents, or of over HOT_ROWS, by a sample that
grows with the documents, are dealt over all buckets, summed before they travel,
and scored from a broadcast of at most HOT; this decides the cost, never the
result.

Defined results: a null or empty text is the end token alone; a row without an
id is in no held-out fold and trains; repeated rows count and are scored each;
without training documents every word is unknown; an empty table gives no rows;
other columns are ignored; texts of any length are read whole.
"""

from __future__ import annotations

import functools
import itertools
from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidegrid.llm.chunks import batches_of
from tidegrid.llm.shared import written

#: Bits of a word's code, and the words that have one.
BITS = 18
HEAD = (1 << BITS) - 8
#: Passes up to the first state that is kept, states that are, and samples of the parent's tables.
PASSES, SWEEPS, SAMPLES = 3, 5, 4
#: Customers up to which the conditional of a pair's tables is exact; cells of (customers, tables).
EXACT = 128
CELL = (EXACT + 1) ** 2
DISCOUNTS, STRENGTHS = np.arange(1, 40) / 40, np.geomspace(0.01, 1000, 41)
#: First counts of the bands of customers that are drawn together; the last is that of all over EXACT.
BANDS = np.array([2, 3, 4, 5, 6, 7, 8, 9, 11, 13, 17, 25, 33, 49, 65, 97, EXACT + 1, EXACT + 2])
#: Weights made at a time, those kept for more samples, and the weight of a new table up to which those of EXACT customers are far from overflow.
CELLS, KEPT, MILD = 250_000, 2_000_000, 5000.0
#: Documents sampled at least in order to find hot pairs, the share and the number of all documents that make a pair hot,
#: documents of the sample that tell so, and hot pairs at most.
SAMPLE_DOCS, HOT_SHARE, HOT_ROWS, TELLING, HOT = 4000, 0.01, 2_000_000, 40, 1_000_000
#: Tokens a bucket holds on average, characters read at a time, sums held by a task.
BUCKET, SLICE, HELD = 500_000, 3_000_000, 2_000_000
MIX = np.uint64(0x9E3779B97F4A7C15)
#: An odd factor that spreads pairs over the range of their keys, and its inverse there.
SPREAD = 0x9E3779B97F4A7C15 % (1 << 2 * BITS)
KEYS = np.uint64((1 << 2 * BITS) - 1)
BACK = np.uint64(pow(SPREAD, -1, 1 << 2 * BITS))
DOC_BITS = np.uint64(64 - 2 * BITS)
PAIR, RARE_WORD, HOT_PAIR, TAIL_PAIR, TAIL_AGAIN, ASKED = 0, 1, 2, 3, 4, 5
#: What marks the other word of a tail's entry as the one that comes after it.
AFTER = 1 << 32


# --------------------------------------------------------------------- seating


@functools.lru_cache(maxsize=64)
def log_seatings(d: float, most: int = EXACT) -> np.ndarray:
    """log of the weight of all seatings of c customers at t tables, [c, t]: a table of n weighs (1 - d)(2 - d)...(n - 1 - d)."""
    out = np.full((most + 1, most + 1), -np.inf)
    out[0, 0] = 0.0
    t = np.arange(1, most + 1)
    for c in range(most):
        with np.errstate(divide="ignore"):
            join = out[c, 1:] + np.log(np.maximum(c - d * t, 0))
        out[c + 1, 1:] = np.logaddexp(out[c, :-1], join)
    return out


@functools.lru_cache(maxsize=64)
def seating_ratios(d: float) -> np.ndarray:
    """What weighs t + 2 tables over t + 1, [t, c], but for the weight of a new table; zero from c tables on."""
    logs = log_seatings(d)[:, 1:]
    out = np.zeros((EXACT - 1, EXACT + 1))
    c, t = np.nonzero(np.isfinite(logs[:, 1:]))
    out[t, c] = np.exp(logs[c, t + 1] - logs[c, t])
    return out


def seating_sums(customers: np.ndarray, most: int, new: np.ndarray, d: float) -> np.ndarray:
    """Sums of the weights of t + 1 tables and fewer, [t, row], for rows of ascending customers, ``most`` at most; each row's scale is its own."""
    out = np.empty((most, len(customers)))
    ratios, weight, mild = seating_ratios(d), np.ones(len(customers)), np.minimum(new, MILD)
    same = len(customers) and customers[0] == customers[-1]
    out[0] = 1
    for t in range(most - 1):
        weight *= mild
        weight *= ratios[t, customers[0]] if same else ratios[t][customers]
        np.add(out[t], weight, out=out[t + 1])
    if len(far := np.flatnonzero(new > MILD)):
        w = log_seatings(d)[customers[far], 1 : most + 1] + np.log(new[far])[:, None] * np.arange(1, most + 1)
        out[:, far] = np.cumsum(np.exp(w - w.max(axis=1, keepdims=True)), axis=1).T
    return out


def uniforms(key: np.ndarray, seed: int) -> np.ndarray:
    """A number between 0 and 1 for each key, by mixing its bits with the seed's."""
    with np.errstate(over="ignore"):
        x = key.astype(np.uint64) + np.uint64(seed + 1) * MIX
        for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB), (31, 1)):
            x = (x ^ x >> np.uint64(shift)) * np.uint64(factor)
    return ((x >> np.uint64(11)).astype(np.float64) + 0.5) / 2.0**53


def binomials(n: np.ndarray, q: np.ndarray, one: np.ndarray, two: np.ndarray) -> np.ndarray:
    """Binomial numbers from two uniform ones each: by inversion up to a mean of 60, beyond it by the normal law."""
    mean = n * q
    normal = np.sqrt(-2 * np.log(one)) * np.cos(2 * np.pi * two)
    out = np.clip(np.rint(mean + normal * np.sqrt(mean * (1 - q))), 0, n)
    few = mean <= 60
    out[few] = 0
    on = np.flatnonzero(few)
    mass = np.exp(n[on] * np.log1p(-q[on]))
    below, k = mass.copy(), 0
    while len(on):
        more = (one[on] > below) & (k < n[on]) & (k < 400)
        on, mass, below = on[more], mass[more], below[more]
        out[on] += 1
        mass = mass * (n[on] - k) / (k + 1) * q[on] / (1 - q[on])
        below, k = below + mass, k + 1
    return out.astype(np.int64)


def seatings(customers: np.ndarray, new: np.ndarray, d: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(places of rows of two customers and more, their ``seating_sums``), by bands of customers; those over EXACT as of EXACT."""
    clipped = np.minimum(customers, EXACT + 1).astype(np.uint8)
    order = np.argsort(clipped, kind="stable")
    edges = np.searchsorted(clipped[order], BANDS)
    for (lo, hi), beyond in zip(itertools.pairwise(edges.tolist()), BANDS[1:].tolist(), strict=True):
        most = min(beyond - 1, EXACT)
        for at in range(lo, hi, max(1, CELLS // most)):
            rows = order[at : min(hi, at + max(1, CELLS // most))]
            yield rows, seating_sums(np.minimum(clipped[rows], EXACT), most, new[rows], d)


def tables_of(customers: np.ndarray, new: np.ndarray, d: float, key: np.ndarray, seed: int, listed: list[tuple[np.ndarray, np.ndarray]] | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(each row's tables, drawn given its customers; mean tables of rows over EXACT): all leave and are seated anew.

    ``new``: the weight of a new table, the restaurant's pull times the dish's probability at the parent.
    ``key`` and ``seed`` decide what is drawn. ``listed``: their ``seatings``, if they are at hand.
    """
    one = uniforms(key, 2 * seed)
    out = np.minimum(customers, 1)
    mean = np.zeros(len(customers))
    for rows, w in seatings(customers, new, d) if listed is None else listed:
        drawn, tables = one[rows] * w[-1], np.ones(len(rows), np.uint8)
        for below in w[:-1]:
            tables += below < drawn
        out[rows] = tables
        if customers[rows[0]] > EXACT:
            mean[rows] = EXACT - w[:-1].sum(axis=0) / w[-1]
    rows = np.flatnonzero(customers > EXACT)
    if len(rows):
        # a customer more: the mean grows by (new - d variance) / (new + c - d mean); the
        # variance is taken as that of a binomial of the tables but the first
        c, m, last = np.full(len(rows), float(EXACT)), mean[rows], customers[rows]
        while len(on := np.flatnonzero(c < last)):
            step = np.minimum(np.maximum(1, c[on] // 16), last[on] - c[on])
            at, x = c[on] + (step - 1) / 2, m[on]
            variance = (x - 1) * (1 - (x - 1) / (at - 1))
            m[on] = np.maximum(1, x + step * (new[rows[on]] - d * variance) / (new[rows[on]] + at - d * x))
            c[on] += step
        out[rows] = 1 + binomials(last - 1, np.clip((m - 1) / (last - 1), 0, 1 - 1e-9), one[rows], uniforms(key[rows], 2 * seed + 1))
    return out, mean


#: Statistics of rows over EXACT, in cells that no seating has: rows, tables but the first, log customers.
LARGE = slice(1, 4)


def sampled(
    customers: np.ndarray, pull: np.ndarray, p: np.ndarray, discount: float, seed: int, samples: int = SAMPLES, key: np.ndarray | None = None
) -> tuple[np.ndarray, np.ndarray]:
    """(mean tables of each row over samples, how many rows have c customers at t tables in a sample, [c, t]).

    ``key`` tells rows apart wherever they are drawn; their places if None.
    """
    key = np.arange(len(customers)) if key is None else key
    mean, seen = np.minimum(customers, 1).astype(np.float64), np.zeros(CELL)
    # one customer has one table; the others are drawn
    many = np.flatnonzero(customers > 1)
    customers, new, key = customers[many], pull[many] * p[many], key[many]
    seen[EXACT + 2] = mean.sum() - len(many)
    drawn, large = np.zeros(len(many)), customers > EXACT
    # the samples differ by what is drawn alone; many weights are made anew rather than kept
    listed = list(seatings(customers, new, discount)) if samples > 1 and np.minimum(customers, EXACT).sum() < KEPT else None
    for i in range(samples):
        t, _ = tables_of(customers, new, discount, key, seed * samples + i, listed)
        drawn += t / samples
        seen += np.bincount((customers * (EXACT + 1) + t)[~large], minlength=CELL) / samples
        seen[LARGE] += np.array([large.sum(), (t[large] - 1).sum(), np.log(customers[large]).sum()]) / samples
    seen[0] = 0
    mean[many] = drawn
    return mean, seen


def log_gamma(x: np.ndarray) -> np.ndarray:
    far = x + 8
    out = (far - 0.5) * np.log(far) - far + 0.5 * np.log(2 * np.pi) + 1 / (12 * far) - 1 / (360 * far**3)
    for k in range(8):
        out = out - np.log(x + k)
    return out


@dataclass
class Level:
    """Restaurants of one kind: discount, strength; customers and tables of each."""

    discount: float
    strength: float
    customers: np.ndarray
    tables: np.ndarray

    def pull(self, at: np.ndarray | slice = slice(None)) -> np.ndarray:
        """What its strength and tables add to a new table, of the restaurants ``at`` these places."""
        return self.strength + self.discount * self.tables[at]

    def back(self, at: np.ndarray | slice = slice(None)) -> np.ndarray:
        """What a restaurant leaves to its base."""
        return self.pull(at) / (self.strength + self.customers[at])

    def redrawn(self, tables: np.ndarray, seen: np.ndarray, rng: np.random.Generator, tail: tuple[np.ndarray, ...] | None = None) -> Level:
        """With new tables; the discount, then the strength, drawn from their conditionals on a grid.

        ``tail``: customers and tables of more restaurants, and how many have these.
        """
        has = self.customers >= 1
        c, t = self.customers[has], np.clip(tables[has], 1, self.customers[has])
        # many contexts are alike
        both, times = np.unique(c + 1j * t, return_counts=True)
        c, t = both.real, both.imag
        if tail is not None:
            c, t, times = (np.concatenate(x) for x in zip((c, t, times), tail, strict=True))
        if not len(c):
            return replace(self, tables=tables)
        cells = (EXACT + 1) + np.flatnonzero(seen[EXACT + 1 :])
        rows, more, logs = seen[LARGE]

        def seated(d: float) -> float:
            """log of the weight of all seatings; of large rows, what it tends to."""
            far = -rows * float(log_gamma(np.array([1 - d]))[0]) - d * logs - more * np.log(d)
            return float(seen[cells] @ log_seatings(d).ravel()[cells]) + far

        def opened(d: float, s: float) -> float:
            """log of the product of s + d i over each restaurant's tables but the first."""
            return float(times @ (np.log(d) * (t - 1) + log_gamma(s / d + t) - log_gamma(np.full(1, s / d + 1))))

        def drawn(grid: np.ndarray, logs: list[float]) -> float:
            w = np.exp(np.array(logs) - max(logs))
            return float(rng.choice(grid, p=w / w.sum()))

        d = drawn(DISCOUNTS, [opened(d, self.strength) + seated(float(d)) for d in DISCOUNTS])
        s = drawn(STRENGTHS, [opened(d, s) - float(times @ (log_gamma(s + c) - log_gamma(np.full(1, s + 1)))) - s for s in STRENGTHS])
        return Level(d, s, self.customers, tables)


# ---------------------------------------------------------------------- tokens


def split(texts: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """(distinct words, places in it of all words of all texts, where each text's words start and end).

    A-Z are lower-cased; words are what ASCII white space leaves.
    """
    lists = pc.ascii_split_whitespace(pc.ascii_lower(pc.fill_null(texts, "")))
    numbered = lists.flatten().dictionary_encode()
    place = np.asarray(numbered.indices)
    full = np.asarray(pc.greater(pc.binary_length(numbered.dictionary), 0)).astype(bool)[place] if len(place) else np.zeros(0, bool)
    edges = np.concatenate([[0], np.cumsum(full)])[np.asarray(lists.offsets) - lists.offsets[0].as_py()]
    return numbered.dictionary, place[full], edges


def hashes(words: pa.Array) -> np.ndarray:
    from xxhash import xxh64_intdigest

    return np.fromiter(map(xxh64_intdigest, words.cast(pa.large_binary()).to_numpy(zero_copy_only=False).tolist()), np.uint64, len(words))


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        sizes = pc.fill_null(pc.binary_length(batch.column("text")), 0).to_pylist()
        for lo, hi in batches_of(sizes, sizes, SLICE):
            yield batch.slice(lo, hi - lo)


def word_counts(docs: DataFrame) -> DataFrame:
    """(word, c): occurrences of each word's hash in the training documents."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _slices(batches):
            words, place, _ = split(batch.column("text"))
            found = np.flatnonzero(n := np.bincount(place, minlength=len(words)))
            yield pa.RecordBatch.from_arrays([pa.array(hashes(words.take(pa.array(found))).view(np.int64)), pa.array(n[found])], ["word", "c"])

    return docs.filter("NOT held_out").select("text").mapInArrow(rows, "word long, c long").groupBy("word").agg(F.sum("c").alias("c"))


@dataclass
class Vocabulary:
    """Hashes of the words that have a code (their places), and their counts."""

    words: np.ndarray  # uint64, ascending
    counts: np.ndarray
    ends: int  # training documents
    tokens: int  # training tokens with end tokens
    distinct: int  # distinct training tokens
    rare_tokens: int
    rare_words: int
    whole: bool = False  # words without a code are the tail's, each its own, and none is the rare word
    tail_tokens: int = 0
    tail_words: int = 0
    least: int = 2  # occurrences of a word with a code

    @property
    def rare(self) -> int:
        return len(self.words)

    @property
    def end(self) -> int:
        return len(self.words) + 1

    def codes(self, hashed: np.ndarray) -> np.ndarray:
        if not len(self.words):
            return np.full(len(hashed), self.rare)
        spot = np.minimum(np.searchsorted(self.words, hashed), len(self.words) - 1)
        return np.where(self.words[spot] == hashed, spot, self.rare)

    def totals(self) -> np.ndarray:
        """Training occurrences by code."""
        return np.concatenate([self.counts, [self.rare_tokens, self.ends]]).astype(np.float64)


def vocabulary(docs: DataFrame, counts: DataFrame, most: int = HEAD, whole: bool = False) -> Vocabulary:
    marks = [1 << k for k in range(1, 62)]
    row = counts.agg(F.count(F.lit(1)), F.coalesce(F.sum("c"), F.lit(0)), *(F.count(F.when(F.col("c") >= m, 1)) for m in marks)).first()
    ends = docs.filter("NOT held_out").count()
    least = next(m for m, n in zip(marks, row[2:], strict=True) if n <= most)
    head = counts.filter(F.col("c") >= least).toArrow()
    words, c = np.asarray(head.column(0).combine_chunks()).view(np.uint64), np.asarray(head.column(1).combine_chunks())
    order = np.argsort(words)
    rest = int(row[1] - c.sum()), int(row[0]) - len(c)
    rare, tail = ((0, 0), rest) if whole else (rest, (0, 0))
    return Vocabulary(words[order], c[order], ends, int(row[1]) + ends, int(row[0]) + (ends > 0), *rare, whole, *tail, least)


# --------------------------------------------------------------------- packing


def pack(*columns: np.ndarray) -> bytes:
    """Arrays of one length as compressed byte planes."""
    # a copy for each plane: transposing rows of a few bytes takes twenty times as long
    planes = [c.view(np.uint8).reshape(len(c), c.dtype.itemsize)[:, i] for c in map(np.ascontiguousarray, columns) for i in range(c.dtype.itemsize)]
    return pa.compress(np.concatenate(planes), "zstd", asbytes=True)


def unpack(raw: bytes, n: int, kinds: list[str]) -> list[np.ndarray]:
    if not n:
        return [np.zeros(0, k) for k in kinds]
    width = [np.dtype(k).itemsize for k in kinds]
    data = np.frombuffer(pa.decompress(raw, n * sum(width), "zstd", asbytes=True), np.uint8)
    out, at = [], 0
    for k, w in zip(kinds, width, strict=True):
        rows = np.empty((n, w), np.uint8)
        for i in range(w):
            rows[:, i] = data[at : at + n]
            at += n
        out.append(rows.view(k).ravel())
    return out


ENTRY = ["<u8", "<u4", "<u4"]  # difference to the key before, twice the document's place + held out, occurrences
MET = ["<u8", "<u8", "<u4"]  # difference, the row's number, occurrences
TAIL_ENTRY = ["<u8", "<i8", "<u4", "<u4"]  # difference to the tail's word before, the other word (and AFTER), mark, occurrences
TAIL_MET = ["<u8", "<i8", "<i8", "<u4"]  # the same with the row's number
TAIL_WORD = ["<u8", "<u4"]  # difference, training occurrences
TAIL_COUNT = ["<u4", "<i8", "<u4"]  # place of the tail's word, the other word (and AFTER), training occurrences from two
COUNT = ["<u8", "<u8"]  # difference, training occurrences
MOVED = "kind int, bucket int, n long, base long, raw binary, doc_id long, n_tokens long, known long, logs double"
MET_ROW = f"{MOVED}, m long, counts binary"


def _runs(x: np.ndarray) -> np.ndarray:
    return np.flatnonzero(np.concatenate([[True], x[1:] != x[:-1]])) if len(x) else np.zeros(0, np.int64)


def pairs_of(codes: np.ndarray, edges: np.ndarray, end: int, mark: np.ndarray, skip: int = -1) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(key of the pair, mark of the document, occurrences) of each distinct pair of each document, in this order; none with the code ``skip``."""
    now = np.insert(codes, edges[1:], end).astype(np.uint64)
    before = np.concatenate([np.array([end], np.uint64), now[:-1]])
    key = ((before << np.uint64(BITS) | now) * np.uint64(SPREAD)) & KEYS
    both = key << DOC_BITS | np.repeat(mark.astype(np.uint64), np.diff(edges) + 1)
    both = np.sort(both if skip < 0 else both[(now != skip) & (before != skip)])
    start = _runs(both)
    both, n = both[start], np.diff(np.append(start, len(both)))
    return both >> DOC_BITS, both & ((np.uint64(1) << DOC_BITS) - np.uint64(1)), n


def _both(key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The codes of a pair's words."""
    pair = (key * BACK) & KEYS
    return (pair >> np.uint64(BITS)).astype(np.int64), (pair & np.uint64((1 << BITS) - 1)).astype(np.int64)


def tail_ids(hashed: np.ndarray) -> np.ndarray:
    """Negative ids of words without a code: 63 bits of their hashes."""
    return (hashed >> np.uint64(1) | np.uint64(1 << 63)).view(np.int64)


def _pair_runs(u: np.ndarray, w: np.ndarray) -> np.ndarray:
    return np.flatnonzero(np.concatenate([[True], (u[1:] != u[:-1]) | (w[1:] != w[:-1])])) if len(u) else np.zeros(0, np.int64)


def tail_keys(u: np.ndarray, w: np.ndarray) -> np.ndarray:
    """A hash of each pair of ids."""
    x = (u.view(np.uint64) * MIX ^ w.view(np.uint64)) * np.uint64(0xBF58476D1CE4E5B9)
    return (x ^ x >> np.uint64(29)) * np.uint64(0x94D049BB133111EB)


def tail_buckets(ids: np.ndarray, buckets: int) -> np.ndarray:
    """The bucket of each word of the tail, in the order of the words."""
    return (((ids.view(np.uint64) >> np.uint64(32)) & np.uint64((1 << 31) - 1)).astype(np.int64) * buckets) >> 31


def tail_entries_of(ids: np.ndarray, edges: np.ndarray, end: int, mark: np.ndarray) -> tuple[np.ndarray, ...]:
    """(word of the tail, the other word, mark, occurrences) of each document's distinct pairs with a word of the tail, by that word.

    The other word comes before it, or after it if AFTER is added; a pair of two words of the tail is the second's.
    """
    now = np.insert(ids, edges[1:], end)
    before = np.concatenate([[end], now[:-1]])
    mark = np.repeat(mark, np.diff(edges) + 1)
    second, first = np.flatnonzero(now < 0), np.flatnonzero((before < 0) & (now >= 0))
    word, other, m = np.concatenate([now[second], before[first]]), np.concatenate([before[second], now[first] + AFTER]), np.concatenate([mark[second], mark[first]])
    order = np.lexsort((other, word))  # a pair's documents stay in order
    word, other, m = word[order], other[order], m[order]
    start = np.flatnonzero(np.concatenate([[True], (word[1:] != word[:-1]) | (other[1:] != other[:-1]) | (m[1:] != m[:-1])])) if len(m) else np.zeros(0, np.int64)
    return word[start], other[start], m[start], np.diff(np.append(start, len(word)))


def words_of(hashed: np.ndarray, mark: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash, mark, occurrences) of each distinct word of each document, in this order."""
    order = np.lexsort((mark, hashed))
    hashed, mark = hashed[order], mark[order]
    start = np.union1d(_runs(hashed), _runs(mark))
    return hashed[start], mark[start], np.diff(np.append(start, len(hashed)))


def hot_pairs(docs: DataFrame, shipped, n_docs: int) -> np.ndarray:
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = shipped.value
        for batch in _slices(batches):
            words, place, edges = split(batch.column("text"))
            key = pairs_of(v.codes(hashes(words))[place], edges, v.end, np.arange(batch.num_rows), v.rare if v.whole else -1)[0]
            start = _runs(key)
            yield pa.RecordBatch.from_arrays([pa.array(key[start].view(np.int64)), pa.array(np.diff(np.append(start, len(key))))], ["key", "n"])

    if not n_docs:
        return np.zeros(0, np.uint64)
    least = min(HOT_SHARE * n_docs, HOT_ROWS)
    share = min(1.0, max(SAMPLE_DOCS, TELLING * n_docs / least) / n_docs)
    found = docs.select("text").filter(F.rand(7) < share).mapInArrow(rows, "key long, n long").groupBy("key").agg(F.sum("n").alias("n"))
    listed = found.filter(F.col("n") > share * least).orderBy(F.desc("n"), "key").limit(HOT).select("key").toArrow()
    return np.sort(np.asarray(listed.column(0).combine_chunks()).view(np.uint64))


def among(listed: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Whether each x is in the ascending list."""
    if not len(listed):
        return np.zeros(len(x), bool)
    return listed[np.minimum(np.searchsorted(listed, x), len(listed) - 1)] == x


def buckets_of(spark, n_tokens: int) -> int:
    return max(4 * max(int(spark.conf.get("spark.sql.shuffle.partitions")), 1), n_tokens // BUCKET)


def met(docs: DataFrame, v: Vocabulary, shipped, hot: np.ndarray, n_tokens: int) -> DataFrame:
    """Each bucket's pairs, rare words and hot pairs with their documents, and one row a document."""
    spark = docs.sparkSession
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 1)
    buckets = buckets_of(spark, n_tokens)
    listed = spark.sparkContext.broadcast(hot)

    def deal(kind: int, key: np.ndarray, mark: np.ndarray, n: np.ndarray, base: int, bucket: np.ndarray) -> Iterator[tuple]:
        """Packed rows of entries that are sorted by bucket."""
        edges = np.append(_runs(bucket), len(bucket)).tolist()
        for lo, hi in itertools.pairwise(edges):
            raw = pack(np.diff(key[lo:hi], prepend=np.uint64(0)), mark[lo:hi].astype("<u4"), n[lo:hi].astype("<u4"))
            yield kind, int(bucket[lo]), hi - lo, base, raw, None, None, None, None

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v, hot = shipped.value, listed.value
        logs_of = np.log10(np.append(v.counts, -1.0)[: v.rare + 1].clip(0) + 1.0)
        logs_of[v.rare] = 0.0
        base = TaskContext.get().partitionId() << 34
        for batch in _slices(batches):
            words, place, edges = split(batch.column("text"))
            hashed, held = hashes(words), np.asarray(batch.column("held_out")).astype(np.int64)
            codes = v.codes(hashed)[place]
            n_docs = batch.num_rows
            mark = np.arange(n_docs) * 2 + held
            own = np.repeat(np.arange(n_docs), np.diff(edges))
            rare = codes == v.rare
            logs = np.bincount(own, logs_of[codes], n_docs)
            known = np.bincount(own[~rare], minlength=n_docs)
            key, marks, n = pairs_of(codes, edges, v.end, mark, v.rare if v.whole else -1)
            is_hot = among(hot, key)
            spread = ((key >> np.uint64(4)).astype(np.int64) * buckets) >> 2 * BITS - 4
            out = list(deal(PAIR, key[~is_hot], marks[~is_hot], n[~is_hot], base, spread[~is_hot]))
            out += deal(HOT_PAIR, key[is_hot], marks[is_hot], n[is_hot], base, np.full(is_hot.sum(), base // 2 % buckets))
            if v.whole:
                word, other, marks, n = tail_entries_of(np.where(rare, tail_ids(hashed)[place], codes), edges, v.end, mark)
                bucket, word = tail_buckets(word, buckets), word.view(np.uint64)
                for lo, hi in itertools.pairwise(np.append(_runs(bucket), len(bucket)).tolist()):
                    raw = pack(np.diff(word[lo:hi], prepend=np.uint64(0)), other[lo:hi], marks[lo:hi].astype("<u4"), n[lo:hi].astype("<u4"))
                    out.append((TAIL_PAIR, int(bucket[lo]), hi - lo, base, raw, None, None, None, None))
            else:
                key, marks, n = words_of(hashed[place[rare]], mark[own[rare]])
                out += deal(RARE_WORD, key, marks, n, base, ((key >> np.uint64(33)).astype(np.int64) * buckets) >> 31)
            ids = batch.column("doc_id").to_pylist()
            out += [(-1, i % buckets, 1, base + m, None, d, t, k, g) for i, (m, d, t, k, g) in enumerate(zip(mark.tolist(), ids, (np.diff(edges) + 1).tolist(), known.tolist(), logs.tolist(), strict=True))]
            base += 2 * n_docs
            yield pa.RecordBatch.from_pylist([dict(zip(SCHEMA.names, x, strict=True)) for x in out], schema=SCHEMA)

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        now = None

        def tail() -> Iterator[pa.RecordBatch]:
            word, other, row, n = (np.concatenate(c) for c in zip(*held, strict=True))
            order = np.lexsort((other, word))
            word, other, row, n = word[order], other[order], row[order], n[order]
            start, count, first, place, c = _tail_pairs(word, other, row, n)
            pair, again = other[start], np.flatnonzero(count > 1)
            made = [{"kind": TAIL_PAIR, "n": len(row), "raw": pack(np.diff(word, prepend=np.uint64(0)), other, row, n), "m": len(c), "counts": pack(np.diff(word[first], prepend=np.uint64(0)), c.astype("<u4"))}]
            made.append({"kind": TAIL_AGAIN, "m": len(again), "counts": pack(place[again].astype("<u4"), pair[again], count[again].astype("<u4"))})
            yield pa.RecordBatch.from_pylist([{**r, "bucket": now[0]} for r in made], schema=MET_SCHEMA)
            both = np.flatnonzero(pair < 0)
            columns = {"kind": np.full(len(both), ASKED, np.int32), "bucket": tail_buckets(pair[both], buckets).astype(np.int32), "n": count[both], "base": pair[both], "doc_id": word[start][both].view(np.int64)}
            yield pa.RecordBatch.from_arrays([pa.array(columns[f.name]) if f.name in columns else pa.nulls(len(both), f.type) for f in MET_SCHEMA], schema=MET_SCHEMA)

        def out() -> Iterator[pa.RecordBatch]:
            if now[1] == TAIL_PAIR:
                yield from tail()
                return
            key, row, n = (np.concatenate(c) for c in zip(*held, strict=True))
            order = np.argsort(key, kind="stable")
            key, row, n = key[order], row[order], n[order]
            raw = pack(np.diff(key, prepend=np.uint64(0)), row.astype("<u8"), n)
            start = _runs(key)
            count = np.add.reduceat(np.where(row & 1, 0, n).astype(np.int64), start)
            key, count = key[start][count > 0], count[count > 0]
            counts = pack(np.diff(key, prepend=np.uint64(0)), count.astype("<u8"))
            yield pa.RecordBatch.from_pylist([{"kind": now[1], "bucket": now[0], "n": len(row), "raw": raw, "m": len(key), "counts": counts}], schema=MET_SCHEMA)

        for batch in batches:
            kinds = np.asarray(batch.column(0))
            plain = batch.filter(pa.array(kinds < 0))
            if plain.num_rows:
                none = [pa.nulls(plain.num_rows, f.type) for f in list(MET_SCHEMA)[plain.num_columns :]]
                yield pa.RecordBatch.from_arrays([*plain.columns, *none], schema=MET_SCHEMA)
            for r in batch.filter(pa.array(kinds >= 0)).to_pylist():
                if (r["bucket"], r["kind"]) != now:
                    if held:
                        yield from out()
                    held, now = [], (r["bucket"], r["kind"])
                if r["kind"] == TAIL_PAIR:
                    diff, other, row, n = unpack(r["raw"], r["n"], TAIL_ENTRY)
                    held.append((np.cumsum(diff), other, row.astype(np.int64) + r["base"], n))
                    continue
                diff, row, n = unpack(r["raw"], r["n"], ENTRY)
                held.append((np.cumsum(diff), row.astype(np.int64) + r["base"], n))
        if held:
            yield from out()

    moved = docs.select("doc_id", "held_out", "text").mapInArrow(rows, MOVED).repartition(parts, "bucket").sortWithinPartitions("bucket", "kind")
    return written(moved.mapInArrow(merge, MET_ROW), "met", "zstd")


SCHEMA = pa.schema(
    [("kind", pa.int32()), ("bucket", pa.int32()), ("n", pa.int64()), ("base", pa.int64()), ("raw", pa.binary()), ("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("known", pa.int64()), ("logs", pa.float64())]
)
MET_SCHEMA = pa.schema([*SCHEMA, ("m", pa.int64()), ("counts", pa.binary())])


def _tail_pairs(word: np.ndarray, other: np.ndarray, row: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(where each pair starts, its training occurrences; where each word starts, the place of each pair's word, each word's training occurrences)."""
    start = _pair_runs(word, other)
    count = np.add.reduceat(np.where(row & 1, 0, n).astype(np.int64), start)
    head = _runs(word[start])
    place = np.repeat(np.arange(len(head)), np.diff(np.append(head, len(start))))
    return start, count, start[head], place, np.bincount(place, np.where(other[start] < AFTER, count, 0), len(head)).astype(np.int64)


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(kind, distinct keys with training occurrences, these) of each bucket."""
    for batch in batches:
        for kind, m, raw in zip(*(batch.column(c).to_pylist() for c in ("kind", "m", "counts")), strict=True):
            diff, count = unpack(raw, m, COUNT)
            yield kind, np.cumsum(diff), count.astype(np.int64)


def _buckets(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(kind, distinct keys, training occurrences of each, place of each entry's key, and (row, occurrences) of the entries)."""
    for batch in batches:
        for kind, n, raw in zip(*(batch.column(c).to_pylist() for c in ("kind", "n", "raw")), strict=True):
            diff, row, times = unpack(raw, n, MET)
            start = np.flatnonzero(np.append(True, diff[1:] > 0))
            place = np.cumsum(np.append(True, diff[1:] > 0)) - 1
            key = np.cumsum(diff)[start]
            count = np.bincount(place, np.where(row & 1, 0, times), len(key)).astype(np.int64)
            yield kind, key, count, place, row.astype(np.int64), times


# ----------------------------------------------------------------------- model


@dataclass
class Model:
    """A state of the sampler; the last one that is kept names those kept before it."""

    contexts: Level  # by code
    parent: Level  # one
    rare: Level  # one
    p: np.ndarray  # the parent's probability by code
    vocabulary: Vocabulary
    turn: int = 0  # its pass
    earlier: tuple[Model, ...] = ()
    #: How its parent was seated: pull and discount before, base, and what probabilities are divided by; none at the start.
    above: tuple[float, float, float, float] | None = None

    def dish(self, word: np.ndarray, customers: np.ndarray) -> np.ndarray:
        """The parent's probability of words of the tail, from their customers there."""
        if self.above is None:
            return (customers + 1) / ((self.vocabulary.totals() + 1).sum() + self.vocabulary.tail_tokens + self.vocabulary.tail_words)
        pull, discount, base, total = self.above
        tables, _ = sampled(customers, np.full(len(word), pull), np.full(len(word), base), discount, self.turn, key=word.view(np.uint64))
        return ((customers - self.parent.discount * tables) / (self.parent.strength + self.parent.customers[0]) + self.parent.back()[0] * base) / total

    def tail_pairs(self, u: np.ndarray, w: np.ndarray, count: np.ndarray, seated: np.ndarray, k: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(tables, cells, the parent's probability) of pairs of ids; tail words' tables as contexts and customers at the parent are given."""
        pull = np.where(u < 0, self.contexts.strength + self.contexts.discount * seated, self.contexts.pull(np.maximum(u, 0)))
        p, tail = self.p[np.maximum(w, 0)], np.flatnonzero(w < 0)
        p[tail] = self.dish(w[tail], k[tail])
        return *sampled(count, pull, p, self.contexts.discount, self.turn, 1, tail_keys(u, w)), p

    def tail_scores(self, u: np.ndarray, w: np.ndarray, count: np.ndarray, customers: np.ndarray, seated: list[np.ndarray], k: list[np.ndarray]) -> np.ndarray:
        """log10 of the predictive probability of pairs of ids, averaged over the kept states, each with its tables and customers."""
        each = np.zeros(len(u))
        for m, t, dishes in zip([*self.earlier, self], seated, k, strict=True):
            tables, _, p = m.tail_pairs(u, w, count, t, dishes)
            s, d, uc = m.contexts.strength, m.contexts.discount, np.where(u < 0, customers, m.contexts.customers[np.maximum(u, 0)])
            back = np.where(u < 0, (s + d * t) / (s + customers), m.contexts.back(np.maximum(u, 0)))
            each += (count - d * tables) / (s + uc) + back * p
        return np.log10(each / SWEEPS)

    def pair_tables(self, pair: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        u, w = _both(pair)
        return sampled(count, self.contexts.pull(u), self.p[w], self.contexts.discount, self.turn, 1, pair)

    def rare_tables(self, hashed: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return sampled(count, np.full(len(count), self.rare.pull()[0]), np.full(len(count), 1 / (self.vocabulary.rare_words + 1)), self.rare.discount, self.turn, 1, hashed)

    def pair_scores(self, pair: np.ndarray, count: np.ndarray) -> np.ndarray:
        """log10 of the predictive probability of each pair's second word, averaged over the kept states."""
        u, w = _both(pair)

        def predictive(m: Model) -> np.ndarray:
            own = (count - m.contexts.discount * m.pair_tables(pair, count)[0]) / (m.contexts.strength + m.contexts.customers[u])
            return own + m.contexts.back(u) * m.p[w]

        return self._averaged(predictive)

    def rare_scores(self, hashed: np.ndarray, count: np.ndarray) -> np.ndarray:
        def predictive(m: Model) -> np.ndarray:
            own = (count - m.rare.discount * m.rare_tables(hashed, count)[0]) / (m.rare.strength + m.rare.customers[0])
            return own + m.rare.back()[0] / (m.vocabulary.rare_words + 1)

        return self._averaged(predictive)

    def _averaged(self, predictive) -> np.ndarray:
        states = [*self.earlier, self]
        return np.log10(sum(map(predictive, states)) / len(states))


def parent_of(dishes: np.ndarray, level: Level, seed: int, tail: tuple[float, float, np.ndarray] | None = None, tail_words: int = 0) -> tuple[Level, np.ndarray, tuple[float, float, float, float]]:
    """The parent's new state and probabilities, from its customers by code, and how it was seated.

    ``tail``: customers and mean tables of the tail's words in all, and the statistics of these.
    """
    customers = np.maximum(np.rint(dishes), 0).astype(np.int64)
    base = 1 / (len(customers) + tail_words)
    pull, discount = float(level.pull()[0]), level.discount
    tables, seen = sampled(customers, np.full(len(customers), pull), np.full(len(customers), base), discount, seed)
    more, more_tables, cells = tail or (0.0, 0.0, np.zeros(CELL))
    level = Level(discount, level.strength, np.array([float(customers.sum()) + more]), np.array([tables.sum() + more_tables]))
    level = level.redrawn(level.tables, seen + cells, np.random.default_rng(seed))
    p = (customers - level.discount * tables) / (level.strength + level.customers[0]) + level.back()[0] * base
    total = float(p.sum() + (more - level.discount * more_tables) / (level.strength + level.customers[0]) + level.back()[0] * base * tail_words)
    return level, p / total, (pull, discount, base, total)


def start(v: Vocabulary) -> Model:
    """Half of all customers at tables of their own."""
    totals = v.totals()
    contexts = Level(0.5, 1.0, totals.copy(), totals / 2)
    p = (totals + 1) / ((totals + 1).sum() + v.tail_tokens + v.tail_words)
    one = lambda n: Level(0.5, 1.0, np.array([float(n)]), np.array([n / 2]))
    return Model(contexts, one((totals.sum() + v.tail_tokens) / 2), one(v.rare_tokens), p, v)


# ------------------------------------------------------------------------ tail


TAIL_ROW = "kind int, bucket int, n long, m long, a long, key long, x double, y double, words binary, pairs binary, asked binary"
TAIL_SCHEMA = pa.schema(
    [("kind", pa.int32()), ("bucket", pa.int32()), *((c, pa.int64()) for c in ("n", "m", "a", "key")), ("x", pa.float64()), ("y", pa.float64()), *((c, pa.binary()) for c in ("words", "pairs", "asked"))]
)
#: Kinds of rows: a bucket's words that change and those that don't, a state for another bucket's pair, a context's customers
#: and tables for another bucket's scores; sums: by code, statistics of pairs, contexts by customers and tables,
#: statistics of the parent, its customers and tables.
STATE, QUIET, TOLD, ANSWER, CODES, SEEN, CONTEXTS, ABOVE, ALL = range(9)
#: A word that changes: difference, training occurrences, its pairs that occur once as context and as dish, tables, customers; then
#: both of each kept state. Its pairs: place, the other word, whether that comes after it, training occurrences.
#: Who asks for its tables: place, bucket.
CHANGING = ["<u8", "<u4", "<u4", "<u4", "<f8", "<u4"]
PAIRED = ["<u4", "<i8", "<u1", "<u4"]
ASKING = ["<u4", "<u4"]


def _tail_rows(kind: int, size: int, /, **columns: np.ndarray | pa.Array) -> pa.RecordBatch:
    columns["kind"] = np.full(size, kind, np.int32)
    return pa.RecordBatch.from_arrays([pa.array(columns[f.name], f.type) if f.name in columns else pa.nulls(size, f.type) for f in TAIL_SCHEMA], schema=TAIL_SCHEMA)


def _sums(kind: int, key: np.ndarray, x: np.ndarray, y: np.ndarray | None = None) -> pa.RecordBatch:
    return _tail_rows(kind, len(key), key=key.astype(np.int64), x=x.astype(float), y=np.zeros(len(key)) if y is None else y.astype(float))


def _by_bucket(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, dict[int, pa.Table]]]:
    """(bucket, its rows by kind) of rows that come sorted by bucket."""
    held: list[pa.RecordBatch] = []
    now = None

    def out() -> tuple[int, dict[int, pa.Table]]:
        rows = pa.Table.from_batches(held).combine_chunks()
        kinds = np.asarray(rows.column("kind"))
        return now, {int(k): rows.filter(pa.array(kinds == k)) for k in np.unique(kinds)}

    for batch in batches:
        bucket = np.asarray(batch.column("bucket"))
        for lo, hi in itertools.pairwise(np.append(_runs(bucket), len(bucket)).tolist()):
            if bucket[lo] != now:
                if held:
                    yield out()
                held, now = [], int(bucket[lo])
            held.append(batch.slice(lo, hi - lo))
    if held:
        yield out()


def _told(u: np.ndarray, w: np.ndarray, value: np.ndarray, after: int, buckets: int) -> pa.RecordBatch:
    """Tables of contexts for the buckets of the second words (0), or customers of dishes for those of the first (1)."""
    return _tail_rows(TOLD, len(u), bucket=tail_buckets((w, u)[after], buckets), key=tail_keys(u, w).view(np.int64), x=value.astype(float), y=np.full(len(u), float(after)))


class Tail:
    """The words without a code: too many to be sent to each task, each has a bucket that keeps its tables and customers.

    A pair that occurs once in training has one table whatever its weights, so that
    only words of pairs that occur again change from pass to pass.
    """

    def __init__(self, rows: DataFrame, v: Vocabulary) -> None:
        spark, size = rows.sparkSession, v.end + 1
        parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 1)
        self.met, self.parts, self.tail_words = rows, max(parts // 4, min(parts, 12)), v.tail_words
        self.buckets = buckets = buckets_of(spark, v.tokens)

        def begun(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            below, dishes = np.zeros(size), np.zeros(size)
            for bucket, kinds in _by_bucket(batches):
                (r,), (again,) = kinds[TAIL_PAIR].to_pylist(), kinds[TAIL_AGAIN].to_pylist()
                diff, c = unpack(r["counts"], r["m"], TAIL_WORD)
                word, c = np.cumsum(diff), c.astype(np.int64)
                place, other, count = unpack(again["counts"], again["m"], TAIL_COUNT)
                after = other >= AFTER
                other = np.where(after, other - AFTER, other)
                u = w = n = np.zeros(0, np.int64)
                if ASKED in kinds:
                    u, w, n = (np.asarray(kinds[ASKED].column(k).combine_chunks()) for k in ("base", "doc_id", "n"))
                at, both = np.searchsorted(word, u.view(np.uint64)), n > 1
                head = other >= 0
                below += np.bincount(other[head & ~after], count[head & ~after], size)
                dishes += np.bincount(other[head & after], count[head & after], size)
                place, other, after, count = (np.concatenate(x) for x in ((place, at[both]), (other, w[both]), (after, np.ones(both.sum(), bool)), (count, n[both])))
                changing = np.zeros(len(word), bool)
                changing[place] = True
                listed = np.cumsum(changing) - 1
                once = [c - np.bincount(place, np.where(after == side, count, 0), len(word)).astype(np.int64) for side in (True, False)]
                quiet = ~changing & (c > 0)
                if quiet.any():
                    yield _tail_rows(QUIET, 1, bucket=[bucket], n=[int(quiet.sum())], words=[pack(np.diff(word[quiet], prepend=np.uint64(0)), c[quiet].astype("<u4"))])
                to = np.unique(at << 32 | tail_buckets(w, buckets))
                at_to, to = to >> 32, to & (1 << 32) - 1
                mine = changing[at_to]
                yield _tail_rows(ANSWER, int((~mine).sum()), bucket=to[~mine], key=word[at_to[~mine]].view(np.int64), x=c[at_to[~mine]].astype(float))
                if not changing.any():
                    continue
                state = [np.diff(word[changing], prepend=np.uint64(0)), *(x[changing] for x in (c, *once, c / 2, c))]
                yield _tail_rows(
                    STATE, 1, bucket=[bucket], n=[int(changing.sum())], m=[len(place)], a=[int(mine.sum())],
                    words=[_packed(CHANGING, *state)], pairs=[_packed(PAIRED, listed[place], other, after, count)], asked=[_packed(ASKING, listed[at_to[mine]], to[mine])],
                )
                yield from told(word[place].view(np.int64), other, after, c[place] / 2, c[place], buckets)
            found = np.flatnonzero(below + dishes)
            yield _sums(CODES, found, below[found], dishes[found])

        listed = rows.filter(F.col("kind") >= TAIL_PAIR).select("kind", "bucket", "n", "base", "doc_id", "m", "counts")
        self.first = self.rows = written(self._dealt(listed).mapInArrow(begun, TAIL_ROW), "tail")
        #: Training occurrences in pairs with a word of the tail that occur again, by the code of the other word, as context and as dish.
        self.again = self._sums(size)[CODES]
        self.kept = 0

    def _dealt(self, rows: DataFrame, parts: int = 0) -> DataFrame:
        return rows.repartition(parts or self.parts, "bucket").sortWithinPartitions("bucket")

    def _sums(self, size: int) -> dict[int, list[np.ndarray]]:
        made = self.rows.filter(F.col("kind") >= CODES).groupBy("kind", "key").agg(F.sum("x"), F.sum("y")).toArrow()
        kind, key, x, y = (np.asarray(made.column(i).combine_chunks()) for i in range(4))
        out = {k: [key[kind == k], x[kind == k], y[kind == k]] for k in range(CODES, ALL + 1)}
        out[CODES] = [np.bincount(out[CODES][0], z, size) for z in out[CODES][1:]]
        return out

    def seated(self, shipped, size: int, turn: int, keep: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray, tuple[np.ndarray, ...], tuple[float, float, np.ndarray]]:
        """Seats all pairs anew: (their tables by code as contexts, as dishes; statistics; what ``redrawn`` and ``parent_of`` take)."""
        base, kept, buckets = 1 / (size + self.tail_words), self.kept, self.buckets

        def drawn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            model = shipped.value
            pull, discount = float(model.parent.pull()[0]), model.parent.discount
            below, dishes, seen, above = np.zeros(size), np.zeros(size), np.zeros(CELL), np.zeros(CELL)
            for bucket, kinds in _by_bucket(batches):
                for r in kinds[QUIET].to_pylist() if QUIET in kinds else []:
                    diff, c = unpack(r["words"], r["n"], TAIL_WORD)
                    word, c = np.cumsum(diff), c.astype(np.int64)
                    yield from totals(word, c, c, c, pull, discount, base, turn, above)
                for r in kinds[STATE].to_pylist() if STATE in kinds else []:
                    diff, c, su, sw, t, k, *earlier = unpack(r["words"], r["n"], CHANGING + ["<u4"] * 2 * kept)
                    word, c, k = np.cumsum(diff), c.astype(np.int64), k.astype(np.int64)
                    place, other, after, count = unpack(r["pairs"], r["m"], PAIRED)
                    after, count, own = after > 0, count.astype(np.int64), word[place].view(np.int64)
                    u, w = np.where(after, own, other), np.where(after, other, own)
                    value = np.zeros(len(u))
                    if TOLD in kinds:
                        key, x, side = (np.asarray(kinds[TOLD].column(n).combine_chunks()) for n in ("key", "x", "y"))
                        for s in (False, True):
                            mine = np.flatnonzero((other < 0) & (after == s))
                            order = np.argsort(key[side == s])
                            value[mine] = x[side == s][order][np.searchsorted(key[side == s][order], tail_keys(u[mine], w[mine]).view(np.int64))]
                    seat, dish = np.where(after, t[place], value), np.where(after, value, k[place]).astype(np.int64)
                    tables = np.zeros(len(u))
                    twice = after & (other < 0)  # the other word's bucket counts these
                    for some in (np.flatnonzero(~twice), np.flatnonzero(twice)):
                        tables[some], cells, _ = model.tail_pairs(u[some], w[some], count[some], seat[some], dish[some])
                        seen += cells if len(some) and not twice[some[0]] else 0
                    head = other >= 0
                    below += np.bincount(other[head & ~after], tables[head & ~after], size)
                    dishes += np.bincount(other[head & after], tables[head & after], size)
                    t = su + np.bincount(place, np.where(after, tables, 0), len(word))
                    k = sw + np.bincount(place, np.where(after, 0, tables), len(word)).astype(np.int64)
                    state = [diff, c, su, sw, t, k, *earlier, *((t, k) if keep else ())]
                    r |= {"words": _packed(CHANGING + ["<u4"] * (len(state) - len(CHANGING)), *state)}
                    yield pa.RecordBatch.from_pylist([r], schema=TAIL_SCHEMA)
                    yield from told(own, other, after, t[place], k[place], buckets)
                    yield from totals(word, c, t.astype(np.int64), k, pull, discount, base, turn, above)
            for kind, cells in ((CODES, below + dishes), (SEEN, seen), (ABOVE, above)):
                found = np.flatnonzero(cells)
                yield _sums(kind, found, below[found], dishes[found]) if kind == CODES else _sums(kind, found, cells[found])

        changing = self._dealt(self.rows.filter(F.col("kind").isin(STATE, TOLD)))
        self.rows = written(changing.unionByName(self.first.filter(F.col("kind") == QUIET)).mapInArrow(drawn, TAIL_ROW), "tail-states")
        self.kept += keep
        made = self._sums(size)
        seen, above = (np.bincount(made[k][0], made[k][1], CELL) for k in (SEEN, ABOVE))
        both, n, _ = made[CONTEXTS]
        return *made[CODES], seen, ((both >> 31).astype(float), (both & (1 << 31) - 1).astype(float), n), (float(made[ALL][1].sum()), float(made[ALL][2].sum()), above)

    def sent(self, shipped, places: int, schema: pa.Schema) -> DataFrame:
        """Sums by document of the tail's pairs, as ``scores`` sends them."""

        def answered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for r in batch.to_pylist():
                    diff, c, *_ = columns = unpack(r["words"], r["n"], CHANGING + ["<u4"] * 2 * SWEEPS)
                    place, to = unpack(r["asked"], r["a"], ASKING)
                    seats = np.stack(columns[len(CHANGING) :: 2], axis=1).astype("<i8")[place]
                    offsets = np.arange(len(place) + 1, dtype=np.int32) * (8 * SWEEPS)
                    raw = pa.Array.from_buffers(pa.binary(), len(place), [None, pa.py_buffer(offsets), pa.py_buffer(seats.tobytes())])
                    yield _tail_rows(ANSWER, len(place), bucket=to, key=np.cumsum(diff)[place].view(np.int64), x=c[place].astype(float), words=raw)

        def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            model = shipped.value[0]
            held: dict[int, list] = {PAIR: [], RARE_WORD: []}
            size = 0

            def out() -> pa.RecordBatch:
                made: list[dict] = []
                for kind, listed in held.items():
                    if listed:
                        every = [np.concatenate(c) for c in zip(*listed, strict=True)]
                        row, place = np.unique(every[0], return_inverse=True)
                        made += _sent(kind, places, row, *(np.bincount(place, c, len(row)).astype(k) for c, k in zip(every[1:], (PAIR_SUMS if kind == PAIR else RARE_SUMS)[1:], strict=True)))
                        listed.clear()
                return pa.RecordBatch.from_pylist(made, schema=schema)

            for _, kinds in _by_bucket(batches):
                (r,) = kinds[ENTRIES].to_pylist()
                diff, other, row, n = unpack(r["words"], r["n"], TAIL_MET)
                word = np.cumsum(diff)
                start, count, first, place, c = _tail_pairs(word, other, row, n)
                seats, dishes = [c.copy() for _ in range(SWEEPS)], [c.copy() for _ in range(SWEEPS)]
                listed = word[first]
                for s in kinds[STATE].to_pylist() if STATE in kinds else []:
                    columns = unpack(s["words"], s["n"], CHANGING + ["<u4"] * 2 * SWEEPS)
                    at = np.searchsorted(listed, np.cumsum(columns[0]))
                    for i in range(SWEEPS):
                        seats[i][at], dishes[i][at] = columns[len(CHANGING) + 2 * i : len(CHANGING) + 2 * i + 2]
                pair, own = other[start], word[start].view(np.int64)
                after = pair >= AFTER
                u, w = np.where(after, own, pair), np.where(after, pair - AFTER, own)
                customers, k = np.where(after, c[place], 0), [np.where(after, 0, x[place]) for x in dishes]
                t = [np.where(after, x[place], 0) for x in seats]
                if len(both := np.flatnonzero(pair < 0)):
                    told = kinds[ANSWER].sort_by("key")
                    key, x = (np.asarray(told.column(n).combine_chunks()) for n in ("key", "x"))
                    at = np.searchsorted(key, pair[both])
                    customers[both] = x[at]
                    raw = told.column("words").combine_chunks()
                    has = np.asarray(raw.is_valid())
                    every = np.repeat(x.astype(np.int64)[:, None], SWEEPS, axis=1)
                    every[has] = np.frombuffer(b"".join(raw.drop_null().to_pylist()), "<i8").reshape(-1, SWEEPS)
                    for i in range(SWEEPS):
                        t[i][both] = every[at, i]
                each = np.repeat(model.tail_scores(u, w, count, customers, t, k), np.diff(np.append(start, len(row)))) * n
                known, second = np.repeat(c[place], np.diff(np.append(start, len(row)))), other < AFTER
                held[PAIR].append((row[~second], each[~second]))
                held[RARE_WORD].append((row[second], each[second], (np.log10(known + 1.0) * n)[second], ((known > 0) * n)[second]))
                size += len(row)
                if size >= HELD:
                    yield out()
                    size = 0
            if size:
                yield out()

        states = self.rows.filter(F.col("kind") == STATE)
        answers = self.first.filter(F.col("kind") == ANSWER).unionByName(states.filter("a > 0").mapInArrow(answered, TAIL_ROW))
        pairs = self.met.filter(F.col("kind") == TAIL_PAIR).select(F.lit(ENTRIES).alias("kind"), "bucket", "n", F.col("raw").alias("words"))
        given = states.unionByName(answers).select("kind", "bucket", "n", "key", "x", "words")
        return self._dealt(given.unionByName(pairs, allowMissingColumns=True), places // 4).mapInArrow(scored, SENT)


#: The kind of a bucket's entries where they meet its states.
ENTRIES = 9


def _packed(kinds: list[str], *columns: np.ndarray) -> bytes:
    return pack(*(c.astype(k) for c, k in zip(columns, kinds, strict=True)))


def told(own: np.ndarray, other: np.ndarray, after: np.ndarray, t: np.ndarray, k: np.ndarray, buckets: int) -> Iterator[pa.RecordBatch]:
    """What the buckets of both words of pairs within the tail tell each other."""
    for side, value in ((True, t), (False, k)):
        some = np.flatnonzero((other < 0) & (after == side))
        if len(some):
            u, w = (own[some], other[some]) if side else (other[some], own[some])
            yield _told(u, w, value[some], 0 if side else 1, buckets)


def totals(word: np.ndarray, c: np.ndarray, t: np.ndarray, k: np.ndarray, pull: float, discount: float, base: float, seed: int, above: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Contexts by customers and tables, and customers and tables at the parent; its statistics are added to ``above``."""
    both, n = np.unique(c << 31 | t, return_counts=True)
    yield _sums(CONTEXTS, both, n)
    tables, cells = sampled(k, np.full(len(k), pull), np.full(len(k), base), discount, seed, key=word)
    above += cells
    yield _sums(ALL, np.zeros(1), np.array([k.sum()]), np.array([tables.sum()]))


# -------------------------------------------------------------------- learning


def learnt(rows: DataFrame, v: Vocabulary, hot: np.ndarray, passes: int = PASSES, tail: Tail | None = None) -> tuple[Model, np.ndarray]:
    """The last of SWEEPS states, the first of which comes after ``passes`` over all pairs, and the training counts of the hot pairs."""
    spark = rows.sparkSession
    entries = rows.filter("kind >= 0").select("kind", "m", "counts")

    def hot_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, key, count in _counts(batches):
            yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(count)], ["key", "c"])

    n_hot = np.zeros(len(hot), np.int64)
    if len(hot):
        summed = entries.filter(F.col("kind") == HOT_PAIR).mapInArrow(hot_counts, "key long, c long").groupBy("key").agg(F.sum("c").alias("c")).toArrow()
        n_hot[np.searchsorted(hot, np.asarray(summed.column(0).combine_chunks()).view(np.uint64))] = np.asarray(summed.column(1).combine_chunks())
    model, size, states = start(v), v.end + 1, []
    for turn in range(1, passes + SWEEPS):
        shipped = spark.sparkContext.broadcast(model)

        counted = tail is not None and turn == 1

        def tables(batches: Iterator[pa.RecordBatch], shipped=shipped, counted=counted) -> Iterator[pa.RecordBatch]:
            model, below, dishes, rare, seen, rare_seen = shipped.value, np.zeros(size), np.zeros(size), np.zeros(1), np.zeros(CELL), np.zeros(CELL)
            singles = [np.zeros(size), np.zeros(size)] if counted else []
            for kind, key, count in _counts(batches):
                if kind == RARE_WORD:
                    t, cells = model.rare_tables(key, count)
                    rare += t.sum()
                    rare_seen += cells
                else:
                    t, cells = model.pair_tables(key, count)
                    u, w = _both(key)
                    below += np.bincount(u, t, size)
                    dishes += np.bincount(w, t, size)
                    seen += cells
                    for codes, total in zip((u, w), singles, strict=False):
                        total += np.bincount(codes, count, size)
            yield _totals(below, dishes, rare, seen, rare_seen, *singles)

        made = entries.filter(F.col("kind").isin(PAIR, *([] if v.whole else [RARE_WORD]))).mapInArrow(tables, TOTALS).groupBy("which", "code").agg(F.sum("x").alias("x")).toArrow()
        which, code, x = (np.asarray(made.column(i).combine_chunks()) for i in range(3))
        below, dishes, rare, seen, rare_seen = (np.bincount(code[which == k], x[which == k], n) for k, n in enumerate((size, size, 1, CELL, CELL)))
        t, cells = model.pair_tables(hot, n_hot)
        u, w = _both(hot)
        below, dishes = below + np.bincount(u, t, size), dishes + np.bincount(w, t, size)
        more, above = None, None
        if tail is not None:
            if counted:
                # of a word's occurrences those in pairs with the head's words, and in pairs that occur again, are known
                once = [v.totals() - np.bincount(code[which == k], x[which == k], size) - np.bincount(hot_codes, n_hot, size) - known for k, hot_codes, known in zip((5, 6), (u, w), tail.again, strict=True)]
            more_below, more_dishes, more_cells, more, above = tail.seated(shipped, size, turn, turn >= passes)
            below, dishes, cells = below + more_below + once[0], dishes + more_dishes + once[1], cells + more_cells
        rng = np.random.default_rng(turn)
        contexts = model.contexts.redrawn(below, seen + cells, rng, more)
        rare = model.rare.redrawn(rare, rare_seen, rng)
        parent, p, how = parent_of(dishes, model.parent, turn, above, v.tail_words)
        model = Model(contexts, parent, rare, p, v, turn, above=how)
        if turn >= passes:
            states.append(model)
        shipped.unpersist()
    return replace(model, earlier=tuple(states[:-1])), n_hot


TOTALS = "which int, code int, x double"


def _totals(*sums: np.ndarray) -> pa.RecordBatch:
    places = [np.flatnonzero(s) for s in sums]
    return pa.RecordBatch.from_arrays(
        [pa.array(np.repeat(np.arange(len(sums), dtype=np.int32), [len(x) for x in places])), pa.array(np.concatenate(places).astype(np.int32)), pa.array(np.concatenate([s[x] for s, x in zip(sums, places, strict=True)]))],
        ["which", "code", "x"],
    )


# --------------------------------------------------------------------- scoring


#: Packed columns: a document's row (difference), id, whether it has one, tokens, known, logs; sums of pairs; sums of rare words.
OWN = ["<u8", "<i8", "<u1", "<i8", "<i8", "<f8"]
PAIR_SUMS = ["<u8", "<f4"]
RARE_SUMS = ["<u8", "<f4", "<f8", "<i8"]
SENT = "to int, kind int, n long, raw binary"
SCORED = "doc_id long, held_out boolean, n_tokens long, n_known long, logs double, score double"


def _sent(kind: int, places: int, row: np.ndarray, *columns: np.ndarray) -> Iterator[dict]:
    """Packed rows of per-document values, by the place that gathers the documents: runs of 4,096 rows stay together."""
    to = (((row.astype(np.uint64) >> np.uint64(13)) * MIX) >> np.uint64(33)).astype(np.int64) % places
    order = np.lexsort((row, to))
    row, to, columns = row[order], to[order], [c[order] for c in columns]
    for lo, hi in itertools.pairwise(np.append(_runs(to), len(to)).tolist()):
        yield {"to": int(to[lo]), "kind": kind, "n": hi - lo, "raw": pack(np.diff(row[lo:hi].astype(np.uint64), prepend=np.uint64(0)), *(c[lo:hi] for c in columns))}


def scores(rows: DataFrame, model: Model, hot: np.ndarray, n_hot: np.ndarray, tail: Tail | None = None) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, logs, score) of every document of ``met``.

    Sums by document travel packed, each task's documents combined, to the place that gathers them.
    """
    spark = rows.sparkSession
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 1)
    places = 4 * parts
    shipped = spark.sparkContext.broadcast((model, hot, model.pair_scores(hot, n_hot)))
    schema = pa.schema([("to", pa.int32()), ("kind", pa.int32()), ("n", pa.int64()), ("raw", pa.binary())])

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, hot, hot_scores = shipped.value
        held: dict[int, list] = {PAIR: [], RARE_WORD: []}
        size = 0

        def out() -> pa.RecordBatch:
            made: list[dict] = []
            for kind, listed in held.items():
                if listed:
                    every = [np.concatenate(c) for c in zip(*listed, strict=True)]
                    row, place = np.unique(every[0], return_inverse=True)
                    sums = [np.bincount(place, c, len(row)) for c in every[1:]]
                    made += _sent(kind, places, row, *(c.astype(k) for c, k in zip(sums, (PAIR_SUMS if kind == PAIR else RARE_SUMS)[1:], strict=True)))
                    listed.clear()
            return pa.RecordBatch.from_pylist(made, schema=schema)

        for batch in batches:
            plain = batch.filter(pc.less(batch.column("kind"), 0))
            if plain.num_rows:
                ids = plain.column("doc_id")
                columns = [np.asarray(pc.fill_null(ids, 0)), np.asarray(ids.is_valid()).astype(np.uint8), *(np.asarray(plain.column(c)) for c in ("n_tokens", "known", "logs"))]
                yield pa.RecordBatch.from_pylist(list(_sent(-1, places, np.asarray(plain.column("base")), *columns)), schema=schema)
            for kind, key, count, place, row, times in _buckets([batch.filter(pc.greater_equal(batch.column("kind"), 0))]):
                if kind == RARE_WORD:
                    each = model.rare_scores(key, count)
                    held[RARE_WORD].append((row, each[place] * times, np.log10(count + 1.0)[place] * times, (count > 0)[place] * times.astype(np.int64)))
                else:
                    each = hot_scores[np.searchsorted(hot, key)] if kind == HOT_PAIR else model.pair_scores(key, count)
                    held[PAIR].append((row, each[place] * times))
                size += len(row)
                if size >= HELD:
                    yield out()
                    size = 0
        if size:
            yield out()

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, own, sums = None, [], []

        def out() -> pa.RecordBatch:
            row, ids, has, tokens, known, logs = (c[order] for order in [np.argsort(own[0][0], kind="stable")] for c in own[0])
            score = np.zeros(len(row))
            for kind, more in sums:
                at = np.searchsorted(row, more[0])
                score += np.bincount(at, more[1], len(row))
                if kind == RARE_WORD:
                    logs = logs + np.bincount(at, more[2], len(row))
                    known = known + np.bincount(at, more[3], len(row)).astype(np.int64)
            return pa.RecordBatch.from_arrays([pa.array(ids, mask=has == 0), pa.array((row & 1).astype(bool)), pa.array(tokens), pa.array(known), pa.array(logs), pa.array(score)], [c.split()[0] for c in SCORED.split(", ")])

        for batch in batches:
            for r in batch.to_pylist():
                if r["to"] != now:
                    if own:
                        yield out()
                    now, own, sums = r["to"], [], []
                columns = unpack(r["raw"], r["n"], OWN if r["kind"] < 0 else PAIR_SUMS if r["kind"] == PAIR else RARE_SUMS)
                columns[0] = np.cumsum(columns[0]).astype(np.int64)
                if r["kind"] < 0:
                    own = [[np.concatenate(c) for c in zip(own[0], columns, strict=True)]] if own else [columns]
                else:
                    sums.append((r["kind"], columns))
        if own:
            yield out()

    sent = rows.filter(F.col("kind") < TAIL_PAIR).select("kind", "bucket", "n", "raw", "base", "doc_id", "n_tokens", "known", "logs").mapInArrow(found, SENT)
    if tail is not None:
        sent = sent.unionByName(tail.sent(shipped, places, schema))
    return sent.repartition(parts, "to").sortWithinPartitions("to", "kind").mapInArrow(gather, SCORED)


def train_and_score(docs: DataFrame, passes: int = PASSES, most: int | None = None, head: int = HEAD) -> DataFrame:
    """Scores of all rows of (doc_id, held_out, text); rows not held out train the model.

    All words have contexts of their own, ``head`` of them at most from a broadcast; with
    ``most``, only so many have, and the rest are one rare word.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "held_out", F.col("text").cast("string").alias("text"))
    counts = written(word_counts(docs), "words")
    v = vocabulary(docs, counts, head if most is None else most, most is None)
    shipped = docs.sparkSession.sparkContext.broadcast(v)
    hot = hot_pairs(docs, shipped, docs.count())
    rows = met(docs, v, shipped, hot, v.tokens)
    tail = Tail(rows, v) if v.whole else None
    model, n_hot = learnt(rows, v, hot, passes, tail)
    scored = scores(rows, model, hot, n_hot, tail)
    logs = F.col("logs") + F.lit(float(np.log10(v.ends + 1))) - F.col("n_tokens") * F.lit(float(np.log10(v.tokens + v.distinct + 1)))
    return scored.select(
        "doc_id", "held_out", "n_tokens", (F.col("n_known") + F.lit(int(v.ends > 0)).cast("long")).alias("n_known"), F.lit(v.tokens).cast("long").alias("train_tokens"),
        logs.alias("base_score"), "score",
    )


def perplexity(scored: DataFrame) -> DataFrame:
    """Perplexity of a token, by held_out, under the model and under the base."""
    power = lambda c: F.pow(F.lit(10.0), -F.sum(c) / F.sum("n_tokens"))
    return scored.groupBy("held_out").agg(power("score").alias("perplexity"), power("base_score").alias("base_perplexity"))
