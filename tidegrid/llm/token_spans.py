"""Token counts per section, from one encoding of the whole document.

A document is encoded once; each token of a byte-level vocabulary stands for a
known number of bytes, so the ids give every token's span. Spans are joined to
the sections by position. A token that crosses a boundary goes, whole, to the
section that holds most of its bytes, and on a tie to the first of them; counts
over sections therefore sum to the document's count exactly.

Sections are lines (each with its line end) or named fields laid one after the
other with a separator, which belongs to the field before it.

Defined results: a null or empty text is one empty section without tokens; in
``by_fields`` a null field is empty but keeps its row; repeated rows are counted
each; an empty table gives no rows; texts of any length are encoded whole; other
columns are ignored.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidegrid.llm.chunks import batches_of, json_bpe

#: Tokens that cross boundaries, and rows of sections, in hand at a time.
AT_ONCE, ROWS_AT_ONCE = 100_000, 200_000
ROWS = "doc_id long, section long, char_start long, char_end long, n_tokens long, n_crossing long"


@functools.lru_cache(maxsize=4)
def _sizes(vocabulary: str) -> np.ndarray:
    return json_bpe(vocabulary).token_bytes()


def attribute(sizes: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(tokens, crossing tokens) of each section.

    ``sizes``: bytes of each token in order; ``starts``: ascending first bytes of
    the sections, the first 0. An empty section gets nothing.
    """
    ends = np.cumsum(sizes)
    begins = ends - sizes
    first = np.searchsorted(starts, begins, "right") - 1
    last = np.searchsorted(starts, ends - 1, "right") - 1
    owner = first.copy()
    crossing = np.flatnonzero(first != last)
    upto = np.append(starts[1:], np.iinfo(np.int64).max)
    for lo in range(0, len(crossing), AT_ONCE):
        t = crossing[lo : lo + AT_ONCE]
        n = last[t] - first[t] + 1
        edge = np.cumsum(n) - n
        section = np.repeat(first[t] - edge, n) + np.arange(n.sum())
        share = np.minimum(upto[section], np.repeat(ends[t], n)) - np.maximum(starts[section], np.repeat(begins[t], n))
        best = np.flatnonzero(share == np.repeat(np.maximum.reduceat(share, edge), n))
        of = np.repeat(np.arange(len(t)), n)[best]
        owner[t] = section[best[np.concatenate([[True], of[1:] != of[:-1]])]]  # the first of the largest shares
    return np.bincount(owner, minlength=len(starts)), np.bincount(owner[crossing], minlength=len(starts))


def line_starts(raw: bytes) -> np.ndarray:
    """First bytes of the lines; a line end at the very end starts no further line."""
    ends = np.flatnonzero(np.frombuffer(raw, np.uint8) == 10) + 1
    return np.concatenate([[0], ends[ends < len(raw)]]).astype(np.int64)


def char_places(raw: bytes, places: np.ndarray) -> np.ndarray:
    """Character offsets of byte offsets."""
    if raw.isascii():
        return places
    before = np.concatenate([[0], np.cumsum((np.frombuffer(raw, np.uint8) & 0xC0) != 0x80)])
    return before[places]


def _count(docs: DataFrame, vocabulary: str, starts_of) -> DataFrame:
    """``docs`` has doc_id, text and lengths (of its fields, or null)."""

    names = [c.split()[0] for c in ROWS.split(", ")]

    def packed(held: list[list[np.ndarray]], ids: list[tuple[int | None, int]]) -> Iterator[pa.RecordBatch]:
        """Held rows in batches of bounded size; ``ids``: a document's id and number of rows."""
        owner = np.repeat(np.arange(len(ids)), [n for _, n in ids])
        known, columns = pa.array([i for i, _ in ids], pa.int64()), [np.concatenate(c) for c in zip(*held, strict=True)]
        for lo in range(0, len(owner), ROWS_AT_ONCE):
            part = slice(lo, lo + ROWS_AT_ONCE)
            yield pa.RecordBatch.from_arrays([known.take(pa.array(owner[part])), *(pa.array(c[part], pa.int64()) for c in columns)], names)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe, size_of = json_bpe(vocabulary), _sizes(vocabulary)
        for batch in batches:
            ids, texts, fields = (batch.column(i).to_pylist() for i in range(3))
            for lo, hi in batches_of(texts, [len(t or "") for t in texts]):
                held, counts, size = [], [], 0
                for doc_id, text, parts, tokens in zip(ids[lo:hi], texts[lo:hi], fields[lo:hi], bpe.texts(texts[lo:hi]), strict=True):
                    raw = (text or "").encode()
                    starts = starts_of(raw, parts)
                    n, crossing = attribute(size_of[np.frombuffer(tokens, bpe.dtype)], starts)
                    places = char_places(raw, np.append(starts, len(raw)))
                    held.append([np.arange(len(n)), places[:-1], places[1:], n, crossing])
                    counts.append((doc_id, len(n)))
                    size += len(n)
                    if size >= ROWS_AT_ONCE:
                        yield from packed(held, counts)
                        held, counts, size = [], [], 0
                if held:
                    yield from packed(held, counts)

    return docs.select("doc_id", "text", "parts").mapInArrow(rows, ROWS)


def by_lines(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Tokens of each line of each document."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"), F.lit(None).cast("array<long>").alias("parts"))
    return _count(rows, vocabulary, lambda raw, _: line_starts(raw))


def by_fields(docs: DataFrame, vocabulary: str, fields: list[str], separator: str = "\n", id_col: str = "doc_id") -> DataFrame:
    """Tokens of each of ``fields``, encoded as one text; ``section`` is the field's place."""
    values = [F.concat(F.coalesce(F.col(f).cast("string"), F.lit("")), F.lit(separator if i + 1 < len(fields) else "")) for i, f in enumerate(fields)]
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.concat(*values).alias("text"), F.array(*(F.octet_length(v).cast("long") for v in values)).alias("parts"))
    return _count(rows, vocabulary, lambda _, parts: np.concatenate([[0], np.cumsum(parts)[:-1]]).astype(np.int64))
