"""WARC archives compressed record by record with an embedded Zstandard dictionary.

Each archive starts with a skippable frame that holds a dictionary trained on
records of that archive (its first ``SAMPLE_BYTES``, which stay buffered until
then; the frame is empty where fewer than 16 records or only equal ones are
sampled); every record follows as a frame of its own, so any record can be
decompressed alone. Of records with equal payloads, that with the smallest id is
the response and the others are revisits that name it and carry no payload.

Equal payloads meet as digests: a partially aggregated minimum per digest, joined
back on the digest (a few bytes a row; a digest that holds a third of all rows is
split by adaptive skew handling), then on id and digest to the payloads, which
are shuffled once.

Defined results: a null payload is empty; a row with a null id is a response
and never referred to; rows that repeat both id and payload are judged alike
(all responses, or all revisits of the same record); an empty table gives no archives and
no rows; other columns are ignored. Payloads of any length are archived whole.
"""

from __future__ import annotations

import base64
import hashlib
import struct
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidegrid.llm.shared import AtomicFile, open_filesystem, shared_dir, written

#: Fixed values of the format: the skippable frame's magic number.
DICTIONARY_FRAME = 0x184D2A5D
DICTIONARY_BYTES = 64 << 10
SAMPLE_BYTES = 2 << 20
LEVEL = 3
MANIFEST = "path string, n_records long, n_bytes long"
ROWS = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, content binary"


def base32_digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(page_id: int | None, url: str, payload: bytes, refers_to: int | None, kind: str) -> bytes:
    """One WARC record; a revisit has no block but keeps the payload's digest and length."""
    name = "null" if page_id is None else str(page_id)
    lines = [
        "WARC/1.1",
        f"WARC-Type: {kind}",
        f"WARC-Record-ID: <urn:page:{name}>",
        "WARC-Date: 1970-01-01T00:00:00Z",
        f"WARC-Target-URI: {''.join(c for c in url if c > ' ')}",
        f"WARC-Payload-Digest: sha1:{base32_digest(payload)}",
        f"X-Payload-Length: {len(payload)}",
    ]
    if kind == "revisit":
        lines += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <urn:page:{'null' if refers_to is None else refers_to}>"]
        payload = b""
    lines += ["Content-Type: text/html; charset=utf-8", f"Content-Length: {len(payload)}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + payload + b"\r\n\r\n"


def parse_record(raw: bytes) -> tuple[dict[str, str], bytes]:
    """Header fields and the block of a record; raises where it is not whole."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    fields = dict(line.split(": ", 1) for line in lines[1:])
    size = int(fields["Content-Length"])
    if lines[0] != "WARC/1.1" or rest[size:] != b"\r\n\r\n":
        raise ValueError("not a whole WARC record")
    return fields, rest[:size]


def train(sample: list[bytes]) -> zstandard.ZstdCompressionDict | None:
    """A dictionary of the sampled records; None where there are too few to train on."""
    if len(sample) < 16:
        return None
    try:
        return zstandard.train_dictionary(min(DICTIONARY_BYTES, max(1024, sum(map(len, sample)) // 8)), sample, k=256, d=8, level=LEVEL)
    except zstandard.ZstdError:  # e.g. all records are equal
        return None


class Writer:
    """Buffers a sample, writes the dictionary frame, then each record as a frame."""

    def __init__(self, out) -> None:
        self.out, self.sample, self.size, self.n, self.bytes, self.compressor = out, [], 0, 0, 0, None

    def add(self, raw: bytes) -> None:
        self.n += 1
        if self.compressor:
            self._put(self.compressor.compress(raw))
            return
        self.sample.append(raw)
        self.size += len(raw)
        if self.size >= SAMPLE_BYTES:
            self.start()

    def start(self) -> None:
        if self.compressor:
            return
        trained = train(self.sample)
        content = trained.as_bytes() if trained else b""
        self._put(struct.pack("<II", DICTIONARY_FRAME, len(content)) + content)
        self.compressor = zstandard.ZstdCompressor(level=LEVEL, dict_data=trained, write_checksum=True)
        for raw in self.sample:
            self._put(self.compressor.compress(raw))
        self.sample = []

    def _put(self, data: bytes) -> None:
        self.out.write(data)
        self.bytes += len(data)


def read_records(stream, most: int = 64 << 10) -> Iterator[tuple[dict[str, str], bytes]]:
    """All records of an archive, in order, one decompressed at a time."""
    magic, size = struct.unpack("<II", stream.read(8))
    if magic != DICTIONARY_FRAME:
        raise ValueError("the archive does not start with its dictionary")
    content = stream.read(size)
    dictionary = zstandard.ZstdCompressionDict(content) if content else None
    decompressor = zstandard.ZstdDecompressor(dict_data=dictionary)
    data = b""
    while data or (data := stream.read(most)):
        frame, parts = decompressor.decompressobj(), []
        while True:
            parts.append(frame.decompress(data))
            if frame.eof:
                data = frame.unused_data
                break
            if not (data := stream.read(most)):
                raise ValueError("the archive ends within a record")
        yield parse_record(b"".join(parts))


def decide(pages: DataFrame, least: int = 0) -> DataFrame:
    """``pages`` (page_id, url, html) with refers_to and kind.

    Payloads of fewer than ``least`` bytes are responses however often they occur.
    """
    keyed = pages.withColumn("digest", F.unhex(F.sha1(F.col("html").cast("binary"))))
    digests = keyed.filter(F.col("page_id").isNotNull() & (F.octet_length("html") >= least)).select("page_id", "digest")
    first = digests.groupBy("digest").agg(F.min("page_id").alias("refers_to"), F.max("page_id").alias("last"))
    first = first.filter("last > refers_to").drop("last")
    repeats = digests.join(first, "digest").filter("page_id > refers_to").distinct()
    joined = keyed.join(repeats, ["page_id", "digest"], "left")
    kind = F.when(F.col("refers_to").isNull(), "response").otherwise("revisit")
    return joined.select("page_id", "url", "html", "refers_to", kind.alias("kind"))


def write(pages: DataFrame, folder: str, least: int = 0, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Write all pages; the manifest, one row per archive."""

    def archive(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = next((b for b in batches if b.num_rows), None)
        if first is None:
            return
        name = f"part-{TaskContext.get().partitionId():06d}.warc.zst"
        with AtomicFile(folder, name) as out:
            writer = Writer(out)
            for batch in (b for bs in ([first], batches) for b in bs):
                for page_id, url, html, refers_to, kind in zip(*(batch.column(i).to_pylist() for i in range(5)), strict=True):
                    writer.add(record(page_id, url or "", html or b"", refers_to, kind))
            writer.start()
        yield pa.RecordBatch.from_pydict({"path": [f"{folder}/{name}"], "n_records": pa.array([writer.n], pa.int64()), "n_bytes": pa.array([writer.bytes], pa.int64())})

    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), text(url_col).alias("url"), text(html_col).alias("html"))
    plan = decide(rows, least).withColumn("html", F.col("html").cast("binary"))
    return written(plan.mapInArrow(archive, MANIFEST), "warc-manifest")


def read(manifest: DataFrame) -> DataFrame:
    """Every record of the archives: its page, payload facts, kind, and block."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path in batch.column(0).to_pylist():
                fs, inner = open_filesystem(path)
                with fs.open_input_stream(inner, compression=None) as stream:
                    found, size = [], 0
                    for fields, block in read_records(stream):
                        page, kind = fields["WARC-Record-ID"][len("<urn:page:") : -1], fields["WARC-Type"]
                        digest = fields["WARC-Payload-Digest"].removeprefix("sha1:")
                        if kind == "response" and base32_digest(block) != digest:
                            raise ValueError("a payload does not match its digest")
                        refers = fields["WARC-Refers-To"][len("<urn:page:") : -1] if kind == "revisit" else None
                        found.append((None if page == "null" else int(page), int(fields["X-Payload-Length"]), digest, kind, refers and int(refers), block))
                        size += len(block)
                        if size > 4 << 20:
                            yield _batch(found)
                            found, size = [], 0
                    yield _batch(found)

    paths = [r.path for r in manifest.select("path").collect()]
    listed = manifest.sparkSession.createDataFrame([(p,) for p in paths], "path string")
    return listed.repartition(max(1, len(paths))).mapInArrow(rows, ROWS)


def _batch(found: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.binary())
    columns = zip(*found, strict=True) if found else [[]] * len(kinds)
    names = [c.split()[0] for c in ROWS.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names)


def write_and_read(pages: DataFrame, least: int = 0) -> DataFrame:
    """Archive all pages in the shared folder and list the records read back."""
    return read(write(pages, shared_dir(pages.sparkSession, "warc"), least))
