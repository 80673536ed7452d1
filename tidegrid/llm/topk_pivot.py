"""Exact top-k by inner product: pivot tables, maximum lower bounds, early stop.

A largest inner product is a nearest neighbour after one more coordinate: with
``M`` the largest squared norm, x' = (x, sqrt(M - |x|^2)) and q' = (q, 0) lie at
squared distance |q|^2 + M - 2 q.x. For a pivot p the triangle inequality gives
|d(q', p) - d(x', p)| <= d(q', x'); the maximum over all pivots is the lower
bound of x. A task orders a block's candidates by that bound and computes exact
scores in this order, until the next bound says that no candidate left can reach
the k-th best score (ties included).

Plan: candidates form blocks of bounded size that stay in a task; each block
computes its table of distances to all pivots once, and the queries - the stated
query set against all rows - stream past it. A query's bound takes its nearest
pivots, whose bounds are the highest; its k-th best score among the pivots, which
are candidates themselves, is where stopping starts. Each block yields at most k
rows a query; a rank-limited window merges them, pruned before its shuffle.
Pivots are drawn from a bounded sample by hash; M is an aggregate over all rows.

Defined results: vectors that are null, or hold null or non-finite components,
and rows without an id take no part; vectors meet those of their own length
only; of rows with equal ids, queries with equal vectors count once, those with
different ones are ranked each on its own, and rows with a query's own id are
never its candidates; repeated candidates fill one rank each; scores beyond a
long are held at its ends; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidegrid.llm.shared import written

PIVOTS, NEAREST = 1024, 32
#: Candidates in a block.
CANDIDATES = 16_384
#: Candidates scored at a time in the order of their bounds.
STEP = 512
#: Below this, float64 sums of products of components are exact.
EXACT = 1 << 53
FOUND = "query_id long, query_key long, vec_id long, score long"
#: Kinds of rows that meet at a block, in this order.
PIVOT, CANDIDATE, QUERY = 0, 1, 2


def integers(rows: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", scale: int = 256) -> DataFrame:
    """(id, dim, v): components floor(scale * x) as long, of the rows that take part."""
    x = F.col(vector_col).cast("array<double>")
    fine = F.forall(x, lambda c: c.isNotNull() & (F.abs(c) < F.lit(float("inf"))))
    taking = rows.filter(F.col(id_col).isNotNull() & x.isNotNull()).filter(fine & (F.size(x) > 0))
    return taking.select(F.col(id_col).cast("long").alias("id"), F.size(x).alias("dim"), F.transform(x, lambda c: F.floor(c * scale)).alias("v"))


class PivotTable:
    """Distances of a block's vectors to the pivots in the augmented space."""

    def __init__(self, vectors: np.ndarray, pivots: np.ndarray, most: float, pivot_ids: np.ndarray | None = None) -> None:
        self.most, self.vectors, self.pivot_ids = most, vectors, pivot_ids
        self.x, self.pivots = vectors.astype(np.float64), pivots.astype(np.float64)
        self.pivot_extra = np.sqrt(np.maximum(0, most - (self.pivots**2).sum(1)))
        self.top = float(np.abs(vectors).max(initial=0)) if len(vectors) else 0.0
        norms = (self.x**2).sum(1)
        self.distances = np.ascontiguousarray(self._to_pivots(self.x, norms, np.sqrt(np.maximum(0, most - norms))).T.astype(np.float32))
        self.slack = 1e-5 * float(np.sqrt(max(0.0, 4 * most)) + 1)  # rounding to single precision and more
        self.evaluated = 0

    def _to_pivots(self, x: np.ndarray, norms: np.ndarray, extra: np.ndarray) -> np.ndarray:
        squared = (norms + extra**2)[:, None] + self.most - 2 * (x @ self.pivots.T + extra[:, None] * self.pivot_extra)
        return np.sqrt(np.maximum(0, squared))

    def _scores(self, places: np.ndarray, query: np.ndarray) -> np.ndarray:
        self.evaluated += len(places)
        if self.top * float(np.abs(query).max(initial=0)) * len(query) < EXACT:
            return (self.x[places] @ query.astype(np.float64)).astype(np.int64)
        whole = self.vectors[places].astype(object) @ query.astype(object)
        return np.array([min(max(s, -(2**63)), 2**63 - 1) for s in whole], np.int64)

    def seed(self, query: np.ndarray, query_id: int, k: int) -> float:
        """The k-th best score among the pivots, if so many are candidates of the query."""
        if self.pivot_ids is None or self.top * float(np.abs(query).max(initial=0)) * len(query) >= EXACT:
            return -np.inf
        scores = (self.pivots @ query.astype(np.float64))[self.pivot_ids != query_id]
        return float(np.partition(scores, len(scores) - k)[len(scores) - k]) if len(scores) >= k else -np.inf

    def search(self, query: np.ndarray, own: np.ndarray, k: int, kth: float = -np.inf) -> tuple[np.ndarray, np.ndarray]:
        """(places, scores) of the k best candidates of at least ``kth`` where ``own`` is False, ties to smaller places."""
        q = query.astype(np.float64)
        norm = float(q @ q)
        to_pivots = self._to_pivots(q[None], np.array([norm]), np.zeros(1))[0]
        near = np.argpartition(to_pivots, NEAREST)[:NEAREST] if len(to_pivots) > NEAREST else np.arange(len(to_pivots))
        bound = np.zeros(len(self.x), np.float32)
        for p in near:
            np.maximum(bound, np.abs(self.distances[p] - np.float32(to_pivots[p])), out=bound)
        bound = np.maximum(bound.astype(np.float64) - self.slack, 0)
        # the highest score that a distance of at least the bound allows, with slack for rounding
        limit = (norm + self.most - bound**2) / 2 + 1e-9 * (norm + self.most) + 1
        left = np.flatnonzero(~own & (limit >= kth))
        order = left[np.argsort(-limit[left], kind="stable")]
        places, scores = np.zeros(0, np.int64), np.zeros(0, np.int64)
        for at in range(0, len(order), STEP):
            if limit[order[at]] < kth:
                break
            step = order[at : at + STEP]
            places = np.concatenate([places, step])
            scores = np.concatenate([scores, self._scores(step, query)])
            best = np.lexsort((places, ~scores))[:k]  # -scores would overflow at the least score
            places, scores = places[best], scores[best]
            if len(places) == k:
                kth = max(kth, float(scores[-1]))
        return places, scores


def _matrix(column) -> np.ndarray:
    """The matrix of a column of lists of equal lengths."""
    return np.asarray(column.flatten()).reshape(len(column), -1)


def meet(batches: Iterator[pa.RecordBatch], k: int) -> Iterator[pa.RecordBatch]:
    """The k best of each block for each query, a row each. Rows are sorted by (dim, block, kind, id)."""
    now, held, table, ids = None, {}, None, np.zeros(0, np.int64)
    for batch in batches:
        if not batch.num_rows:
            continue
        dim, block, kind = (np.asarray(batch.column(c)).astype(np.int64) for c in ("dim", "block", "kind"))
        change = np.flatnonzero((dim[1:] != dim[:-1]) | (block[1:] != block[:-1]) | (kind[1:] != kind[:-1])) + 1
        for lo, hi in itertools.pairwise([0, *change.tolist(), batch.num_rows]):
            part = batch.slice(lo, hi - lo)
            if (dim[lo], block[lo]) != now:
                now, held, table = (dim[lo], block[lo]), {}, None
            own_ids, vectors = np.asarray(part.column("id")), _matrix(part.column("v"))
            if kind[lo] != QUERY:
                held.setdefault(int(kind[lo]), []).append((own_ids, vectors))
                if kind[lo] == PIVOT:
                    held["most"] = part.column("most")[0].as_py()
                continue
            if CANDIDATE not in held:
                continue
            if table is None:
                ids, vs = (np.concatenate(c) for c in zip(*held[CANDIDATE], strict=True))
                order = np.argsort(ids, kind="stable")
                ids = ids[order]
                pivot_ids, pivots = (np.concatenate(c) for c in zip(*held[PIVOT], strict=True))
                table = PivotTable(vs[order], pivots, held["most"], pivot_ids)
            out: list[tuple] = []
            for query_id, key, query in zip(own_ids.tolist(), part.column("key").to_pylist(), vectors, strict=True):
                places, scores = table.search(query, ids == query_id, k, table.seed(query, query_id, k))
                out += zip([query_id] * len(places), [key] * len(places), ids[places].tolist(), scores.tolist(), strict=True)
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out, strict=True)], [c.split()[0] for c in FOUND.split(", ")])


def search(candidates: DataFrame, queries: DataFrame, k: int, pivots: int = PIVOTS) -> DataFrame:
    """query_id, rank, vec_id, score: the k best of ``candidates`` for each query, ties to smaller ids.

    Both tables have (id, dim, v). ``candidates`` is read more than once: have it written.
    """
    n_blocks = max(1, -(-candidates.count() // CANDIDATES))
    squared = F.aggregate("v", F.lit(0.0), lambda a, c: a + c.cast("double") * c)
    place = Window.partitionBy("dim").orderBy(F.xxhash64("v"), "id")
    largest = candidates.groupBy("dim").agg(F.max(squared).alias("most"), F.count(F.lit(1)).alias("rows"))
    # a few times as many rows as pivots by hash, so that ranking sees no more
    some = candidates.join(largest, "dim").filter(F.xxhash64("v", "id") / 2.0**64 + 0.5 < F.lit(4.0 * pivots) / F.col("rows"))
    sample = some.withColumn("n", F.row_number().over(place)).filter(F.col("n") <= pivots)
    everywhere = F.explode(F.sequence(F.lit(0), F.lit(n_blocks - 1))).alias("block")
    none = lambda kind: F.lit(None).cast(kind)
    row = lambda df, kind, block, most, key: df.select("dim", block, F.lit(kind).alias("kind"), "id", "v", most.alias("most"), key.alias("key"))
    block = F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(n_blocks)).cast("int").alias("block")
    met = (
        row(sample, PIVOT, everywhere, F.col("most"), none("long"))
        .unionByName(row(candidates, CANDIDATE, block, none("double"), none("long")))
        .unionByName(row(queries.distinct(), QUERY, everywhere, none("double"), F.xxhash64("v")))
    )
    found = met.repartition("dim", "block").sortWithinPartitions("dim", "block", "kind", "id").mapInArrow(lambda batches: meet(batches, k), FOUND)
    best = Window.partitionBy("query_id", "query_key").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def top_k(rows: DataFrame, is_query, k: int = 5, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """The k best other rows for every row where ``is_query`` (over column id) holds."""
    vectors = written(integers(rows, id_col, vector_col), "vectors")
    return search(vectors, vectors.filter(is_query), k)
