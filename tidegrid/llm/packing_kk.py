"""Packing documents into windows by Karmarkar-Karp multiway differencing.

A document of more than a window's tokens is cut into full windows and one rest;
full windows stand alone. A rest of over a quarter of a window is cut evenly
into parts of a quarter at most: with a handful of parts to a window the
differencing comes out nearly equal. Parts are dealt into groups of bounded
size by a hash of a running piece number, and each group is partitioned into
near-equal windows: the two partial partitions of the largest
imbalance are merged again and again, the fullest slot of one meeting the
emptiest of the other. A group starts with as few windows as its tokens need;
while the fullest window exceeds the capacity, the window count rises.

Defined results: a null or empty text is one piece that holds the end id alone;
rows with equal ids are packed each on its own; an empty table gives no rows.
Texts of any length are encoded whole; other columns are ignored.
"""

from __future__ import annotations

import itertools
import zlib
from collections.abc import Iterator
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidegrid.llm.chunks import column_slices, json_bpe
from tidegrid.llm.shared import written

PIECES = "piece long, doc_id long, start long, length long, ids_crc32 long, doc_tokens long"
PLACED = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
#: Pieces in a group: enough to spread imbalances over hundreds of windows.
GROUP = 512
#: Parts of a rest are at most this share of a window.
PARTS = 4
#: Windows of a group have numbers below this.
SLOTS = 1 << 20


def difference(lengths: list[int], k: int) -> list[tuple[int, list[int]]]:
    """``k`` slots (sum, member indices) with near-equal sums, fullest first.

    A partial partition lists its non-empty slots in descending order; its
    imbalance is the fullest slot less the emptiest (0 if a slot is empty).
    """
    if k == 1:
        return [(sum(lengths), list(range(len(lengths))))] if lengths else []
    heap = [(-n, i, [(n, [i])]) for i, n in enumerate(lengths)]
    heapify(heap)
    age = len(heap)
    while len(heap) > 1:
        a, b = heappop(heap)[2], heappop(heap)[2]
        over = max(0, len(a) + len(b) - k)
        keep = len(a) - over  # slots of a that meet an empty slot of b
        joined = [(x + y, m + n) for (x, m), (y, n) in zip(a[keep:], reversed(b[len(b) - over :] if over else []), strict=True)]
        merged = a[:keep] + joined + b[: len(b) - over]
        merged.sort(key=lambda s: -s[0])
        low = merged[-1][0] if len(merged) == k else 0
        heappush(heap, (low - merged[0][0], age, merged))
        age += 1
    return heap[0][2] if heap else []


def windows(lengths: list[int], capacity: int) -> list[list[int]]:
    """Member indices of each window; none over the capacity.

    Where the fullest window exceeds it, the count rises: by one, or to what
    half of the measured excess over the mean asks for.
    """
    total = sum(lengths)
    k = max(1, -(-total // capacity))
    while True:
        slots = difference(lengths, k)
        top = slots[0][0] if slots else 0
        if top <= capacity:
            return [m for _, m in slots]
        k = max(k + 1, -(-total // max(1, int(capacity - (top - total / k) / 2))))


def spans(n: int, capacity: int) -> list[tuple[int, int]]:
    """Where a document of ``n`` tokens is cut: full windows, then even parts of the rest."""
    full = n // capacity * capacity
    parts = -(-(n - full) * PARTS // capacity)
    edges = [full + (n - full) * i // parts for i in range(parts + 1)] if parts else []
    return [(a, a + capacity) for a in range(0, full, capacity)] + list(zip(edges, edges[1:], strict=False))


def cut(docs: DataFrame, vocabulary: str, end_id: int, capacity: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encode every whole text and cut it: one row per piece, numbered."""

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe, piece = json_bpe(vocabulary), TaskContext.get().partitionId() << 33
        for batch in batches:
            ids, texts = batch.column(0).to_pylist(), batch.column(1)
            for lo, hi in column_slices(texts):
                rows = []
                tokens, edges = bpe.flat(texts.slice(lo, hi - lo), end_id)
                raw = memoryview(tokens.astype("<u4").view(np.uint8))
                for doc_id, (a, b) in zip(ids[lo:hi], itertools.pairwise(edges.tolist()), strict=True):
                    for at, to in spans(b - a, capacity):
                        rows.append((piece, doc_id, at, to - at, zlib.crc32(raw[4 * (a + at) : 4 * (a + to)]), b - a))
                        piece += 1
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows, strict=True)], ["piece", "doc_id", "start", "length", "ids_crc32", "doc_tokens"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(pieces, PIECES)


def place(pieces: DataFrame, capacity: int, group: int = GROUP) -> DataFrame:
    """Sequence and offset of every piece. ``pieces`` is read twice: have it written."""
    full = pieces.filter(F.col("length") == capacity).select(
        *(c.name for c in pieces.schema if c.name != "piece"), (F.col("piece") * 2).alias("sequence_id"), F.lit(0).cast("long").alias("offset")
    )
    rest = pieces.filter(F.col("length") < capacity)
    groups = max(1, -(-rest.count() // group))

    def packed(key: tuple, table: pa.Table) -> pa.Table:
        table = table.sort_by([("length", "descending"), ("piece", "ascending")])
        lengths = table.column("length").to_pylist()
        sequence, offset = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
        for w, members in enumerate(windows(lengths, capacity)):
            at = 0
            for m in sorted(members):
                sequence[m], offset[m] = (key[0].as_py() * SLOTS + w) * 2 + 1, at
                at += lengths[m]
        table = table.drop_columns(["piece", "group"])
        return table.append_column("sequence_id", pa.array(sequence)).append_column("offset", pa.array(offset))

    dealt = rest.withColumn("group", F.pmod(F.xxhash64("piece"), F.lit(groups).cast("long")))
    return full.unionByName(dealt.groupBy("group").applyInArrow(packed, PLACED))


def pack(docs: DataFrame, vocabulary: str, end_id: int, capacity: int = 2048) -> DataFrame:
    """Every piece of every document with its sequence and offset there."""
    return place(written(cut(docs, vocabulary, end_id, capacity), "pieces"), capacity)
