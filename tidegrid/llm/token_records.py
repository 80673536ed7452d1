"""Token-id files of length-delimited records, with a separate offset index.

A shard is a sequence of frames: length (uint64), masked CRC-32C of the length,
payload, masked CRC-32C of the payload, all little-endian. A payload is the
document's id (int64), flags (uint32; bit 0: the id is null; bits 8-15: bytes
per token id), the token count (uint32) and the ids. Beside ``x.rec`` lies
``x.idx``: offset, payload length and token count of each record (uint64), so
that a reader can fetch records in any order.

Shards hold ascending ranges of doc_id. Each task writes its shard under an
attempt's name and renames it, so retries and lost executors leave whole files.

Defined results: a null text is empty (its record holds the end id alone);
null ids sort first; rows with equal ids are each kept, ordered by the hashes
of their texts, whatever the number of shards; an empty table gives no shards and no rows; other columns are ignored.
"""

from __future__ import annotations

import itertools
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidegrid.llm.chunks import column_slices, json_bpe
from tidegrid.llm.crc32c import crc32c, masked
from tidegrid.llm.shared import AtomicFile, open_filesystem, shared_dir, written

HEAD = "<qII"
HEAD_SIZE = struct.calcsize(HEAD)
FRAME = 8 + 4 + 4
MANIFEST = "shard int, path string, n_docs long, n_tokens long, n_bytes long"
ROWS = "doc_id long, start long, n_tokens long, ids_crc32 long"


def frame(payloads: list[bytes]) -> list[bytes]:
    """The framed form of each payload."""
    lengths = [struct.pack("<Q", len(p)) for p in payloads]
    sums = zip(masked(crc32c(lengths)).tolist(), masked(crc32c(payloads)).tolist(), strict=True)
    return [b"".join((n, struct.pack("<I", a), p, struct.pack("<I", b))) for n, p, (a, b) in zip(lengths, payloads, sums, strict=True)]


def payload(doc_id: int | None, ids: bytes, width: int) -> bytes:
    return b"".join((struct.pack(HEAD, doc_id or 0, (doc_id is None) | width << 8, len(ids) // width), ids))


def parse(body: bytes) -> tuple[int | None, np.ndarray]:
    """(doc_id, ids) of a payload."""
    doc_id, flags, n = struct.unpack_from(HEAD, body)
    ids = np.frombuffer(body, f"<u{flags >> 8 & 255}", n, HEAD_SIZE)
    return None if flags & 1 else doc_id, ids


def read_frames(stream, most: int = 8 << 20) -> Iterator[list[bytes]]:
    """Lists of payloads of a shard, in order, with every checksum verified."""
    rest = b""
    while chunk := stream.read(most):
        data, at, found, sums = rest + chunk, 0, [], []
        while at + 12 <= len(data):
            (size,) = struct.unpack_from("<Q", data, at)
            if at + size + FRAME > len(data):
                break
            found += (data[at : at + 8], data[at + 12 : at + 12 + size])
            sums += (struct.unpack_from("<I", data, at + 8)[0], struct.unpack_from("<I", data, at + 12 + size)[0])
            at += size + FRAME
        if found and not np.array_equal(masked(crc32c(found)), np.array(sums, np.uint32)):
            raise ValueError("a record's checksum does not match")
        yield found[1::2]
        rest = data[at:]
    if rest:
        raise ValueError("the shard ends within a record")


def read_record(path: str, number: int) -> tuple[int | None, np.ndarray]:
    """One record by its place in the shard, through the index."""
    fs, inner = open_filesystem(path)
    with fs.open_input_file(inner.removesuffix(".rec") + ".idx") as index:
        offset, size, _ = struct.unpack("<QQQ", index.read_at(24, 24 * number))
    with fs.open_input_file(inner) as records:
        body = records.read_at(size + FRAME, offset)
    return parse(next(iter(read_frames(pa.BufferReader(body))))[0])


def write(docs: DataFrame, folder: str, vocabulary: str, end_id: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encode and write all documents; the manifest, one row per shard in order.

    One shuffle by range of doc_id; the texts are encoded where the shard is
    written, so token ids never pass through a shuffle.
    """

    def shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard = TaskContext.get().partitionId()
        name, bpe = f"part-{shard:06d}", json_bpe(vocabulary, drops_space=True)
        width = bpe.dtype.itemsize
        n_docs = n_tokens = at = 0
        first = next((b for b in batches if b.num_rows), None)
        if first is None:
            return
        with AtomicFile(folder, f"{name}.rec") as out, AtomicFile(folder, f"{name}.idx") as index:
            for batch in (b for bs in ([first], batches) for b in bs):
                ids, texts = batch.column(0).to_pylist(), batch.column(1)
                for lo, hi in column_slices(texts):
                    tokens, edges = bpe.flat(texts.slice(lo, hi - lo), end_id)
                    raw = memoryview(tokens.view(np.uint8))
                    bodies = [payload(i, raw[width * a : width * b], width) for i, (a, b) in zip(ids[lo:hi], itertools.pairwise(edges.tolist()), strict=True)]
                    entries = []
                    for b in bodies:
                        n = (len(b) - HEAD_SIZE) // width
                        entries.append(struct.pack("<QQQ", at, len(b), n))
                        at, n_tokens = at + len(b) + FRAME, n_tokens + n
                    out.write(b"".join(frame(bodies)))
                    index.write(b"".join(entries))
                    n_docs += hi - lo
        yield pa.RecordBatch.from_pydict(
            {"shard": pa.array([shard], pa.int32()), "path": [f"{folder}/{name}.rec"], "n_docs": pa.array([n_docs], pa.int64()), "n_tokens": pa.array([n_tokens], pa.int64()), "n_bytes": pa.array([at], pa.int64())}
        )

    ordered = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    # rows of one id, or without ids, go by their texts' hashes, inside shards and across, and are cut there; equal ones by number
    ordered = ordered.withColumn("hash", F.xxhash64("text")).withColumn("number", F.monotonically_increasing_id())
    ordered = ordered.repartitionByRange("doc_id", "hash", "number").sortWithinPartitions("doc_id", "hash", "text").select("doc_id", "text")
    return written(ordered.mapInArrow(shards, MANIFEST), "token-manifest")


def read(manifest: DataFrame) -> DataFrame:
    """Per document, from the files alone: doc_id, start, n_tokens, ids_crc32.

    ``start`` is the shard's base (a sum over the manifest, one row per shard)
    plus the tokens before the record in its shard.
    """
    spark = manifest.sparkSession
    shards = sorted(manifest.select("shard", "path", "n_tokens").collect())
    bases, total = [], 0
    for shard, path, n in shards:
        bases.append((shard, path, total))
        total += n

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, start in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                fs, inner = open_filesystem(path)
                with fs.open_input_stream(inner) as stream:
                    for bodies in read_frames(stream):
                        found = [parse(b) for b in bodies]
                        counts = np.array([len(ids) for _, ids in found], np.int64)
                        ends = start + np.cumsum(counts)
                        yield pa.RecordBatch.from_pydict(
                            {
                                "doc_id": pa.array([i for i, _ in found], pa.int64()),
                                "start": pa.array(ends - counts, pa.int64()),
                                "n_tokens": pa.array(counts, pa.int64()),
                                "ids_crc32": pa.array([zlib.crc32(ids.astype("<u4").tobytes()) for _, ids in found], pa.int64()),
                            }
                        )
                        start = int(ends[-1]) if len(ends) else start

    listed = spark.createDataFrame(bases, "shard int, path string, base long")
    return listed.repartition(max(1, len(bases))).mapInArrow(rows, ROWS)


def write_and_read(docs: DataFrame, vocabulary: str, end_id: int) -> DataFrame:
    """Write all documents into a new folder of the shared place and read them back."""
    return read(write(docs, shared_dir(docs.sparkSession, "token-records"), vocabulary, end_id))
