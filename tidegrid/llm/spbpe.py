"""Byte-level BPE through a sentencepiece model serialised from the vocabulary.

The rank file becomes a sentencepiece BPE model: every byte string is mapped to
printable letters, one per byte, and scored by its negative rank; normalisation
is the identity. Merging the pair of best score leftmost first is then merging
by lowest rank. Texts are split by the pattern first; a pre-token that is itself
a piece is that piece, others are encoded by the model. Decoding maps ids back
to pieces and pieces back to bytes.

Defined results: a null text is empty and encodes to no ids; repeated rows are
encoded alike; texts of any length are encoded whole; an empty table gives no
rows; other columns are ignored.
"""

from __future__ import annotations

import functools
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidegrid.llm.chunks import CHUNK, ChunkCache, batches_of, byte_letters, read_ranks

#: Fixed values of the ModelProto format.
NORMAL, UNKNOWN, BPE = 1, 2, 2
UNKNOWN_PIECE = "<unk⁇>"  # holds a letter that stands for no byte


def _varint(n: int) -> bytes:
    out = bytearray()
    n &= (1 << 64) - 1
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    out.append(n)
    return bytes(out)


def _number(field: int, value: int) -> bytes:
    return _varint(field << 3) + _varint(value)


def _block(field: int, value: bytes) -> bytes:
    return _varint(field << 3 | 2) + _varint(len(value)) + value


def _piece(text: str, score: float, kind: int) -> bytes:
    return _block(1, _block(1, text.encode()) + _varint(2 << 3 | 5) + struct.pack("<f", score) + _number(3, kind))


def model_bytes(ranks: dict[bytes, int]) -> bytes:
    """The serialised model; its id is the place by rank plus one (0 is unknown)."""
    if len(ranks) >= 1 << 24:
        raise ValueError("ranks beyond 2^24 are not exact as scores")
    letters = byte_letters()
    out = [_piece(UNKNOWN_PIECE, 0.0, UNKNOWN)]
    for raw, rank in sorted(ranks.items(), key=lambda x: x[1]):
        out.append(_piece("".join(letters[b] for b in raw), -float(rank), NORMAL))
    trainer = _number(3, BPE) + _number(4, len(ranks) + 1) + _number(40, 0) + _number(41, -1) + _number(42, -1) + _number(43, -1)
    normalizer = _block(1, b"identity") + _number(3, 0) + _number(4, 0) + _number(5, 0)
    return b"".join(out) + _block(2, trainer) + _block(3, normalizer)


class RankBpe:
    """Encoder and decoder of one rank file."""

    def __init__(self, path: str, pattern: str) -> None:
        import regex
        import sentencepiece

        self.ranks = read_ranks(path)
        self.by_id = [r for _, r in sorted(self.ranks.items(), key=lambda x: x[1])]
        self.model = sentencepiece.SentencePieceProcessor(model_proto=model_bytes(self.ranks))
        self.letters = byte_letters()
        self.pattern = regex.compile(pattern)
        self.cache = ChunkCache(self._chunks)
        back = {c: b for b, c in self.letters.items()}
        self.pieces = {self.by_id[i - 1]: bytes(back[c] for c in self.model.id_to_piece(i)) for i in range(1, len(self.by_id) + 1)}

    def _chunks(self, chunks: list[str]) -> list[bytes]:
        split = [self.pattern.findall(c) for c in chunks]
        ranks, found = self.ranks, {}
        rest = []
        for p in {p for ps in split for p in ps}:
            raw = p.encode()
            if raw in ranks:
                found[p] = struct.pack("<i", ranks[raw])
            else:
                rest.append((p, raw.decode("latin-1").translate(self.letters)))
        by_id = self.by_id
        for (p, _), ids in zip(rest, self.model.encode([x for _, x in rest], num_threads=1), strict=True):
            found[p] = np.array([by_id[i - 1] for i in ids], "<i4").tobytes()
        return [b"".join([found[p] for p in ps]) for ps in split]

    def texts(self, texts: list[str | None]) -> list[bytes]:
        split = [CHUNK.findall(t) if t else [] for t in texts]
        value = self.cache.table(set().union(*split)).__getitem__
        return [b"".join(map(value, cs)) for cs in split]

    def bytes_of(self, ids: list[int]) -> bytes:
        pieces = self.pieces
        return b"".join([pieces[i] for i in ids])


@functools.lru_cache(maxsize=2)
def rank_bpe(path: str, pattern: str) -> RankBpe:
    """The process's codec of a file: reused Python workers keep it, and its cache, between tasks."""
    return RankBpe(path, pattern)


def encode(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, ids array<int>) of every whole text."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = rank_bpe(path, pattern)
        for batch in batches:
            texts = batch.column(1).to_pylist()
            for lo, hi in batches_of(texts, [len(t or "") for t in texts], 2_000_000):
                ids = bpe.texts(texts[lo:hi])
                ends = np.cumsum([0, *(len(x) // 4 for x in ids)]).astype(np.int32)
                values = pa.array(np.frombuffer(b"".join(ids), "<i4"))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), pa.ListArray.from_arrays(pa.array(ends), values)], ["doc_id", "ids"])

    chosen = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return chosen.mapInArrow(rows, "doc_id long, ids array<int>")


def decode(encoded: DataFrame, path: str, pattern: str) -> DataFrame:
    """(doc_id, ids, decoded binary): the bytes the ids stand for."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = rank_bpe(path, pattern)
        for batch in batches:
            ids = batch.column(1)
            for lo, hi in batches_of(range(len(ids)), pc.list_value_length(ids).to_pylist(), 400_000):
                part = ids.slice(lo, hi - lo)
                edges, values = part.offsets.to_numpy(), part.values
                raw = [bpe.bytes_of(values[a:b].to_numpy().tolist()) for a, b in zip(edges.tolist(), edges[1:].tolist(), strict=False)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), part, pa.array(raw, pa.binary())], ["doc_id", "ids", "decoded"])

    return encoded.select("doc_id", "ids").mapInArrow(rows, "doc_id long, ids array<int>, decoded binary")
