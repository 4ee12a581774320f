"""WARC in seekable Zstandard bundles.

Records are grouped into independent Zstandard frames of about ``frame_bytes``;
a seek table in a skippable frame closes each bundle, and the index maps each
record identifier to its bundle, frame and offset in that frame.  A reader needs
one frame for one record.  Of records with equal payloads of at least
``min_dedup_bytes``, the one with the smallest page_id is a response and the
others are revisits, which carry the HTTP head and no payload.

Bundles are named by partition and task attempt, and only those in the committed
index are read: a lost executor's half-written bundle is never seen.

Defined results: null html is an empty payload; a null url is written as
``urn:page:<id>``; rows that share the smallest page_id of a payload are all
responses; null page_ids come after all others, and a payload known only under
null ids has responses alone; rows with equal page_id and html are one record
written more than once, under one identifier, and ``read_record`` gives the first; other columns are ignored; an empty table gives no
bundle and no rows.
"""

from __future__ import annotations

import hashlib
import re
import struct
import uuid

import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import filesystem, materialise, shared_dir, table

FRAME_BYTES = 256 * 1024
MIN_DEDUP_BYTES = 100
#: Largest table of repeated payloads that is broadcast (rows of about 60 bytes); larger ones are joined by shuffle.
BROADCAST_ROWS = 100_000
#: Fixed values of the public seekable format: skippable frame and footer magic numbers.
SKIPPABLE_MAGIC, SEEKABLE_MAGIC = 0x184D2A5E, 0x8F92EAB1
#: Fixed value of WARC 1.1.
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: The tables hold no capture time.
CAPTURE_DATE = "1970-01-01T00:00:00Z"

INDEX_SCHEMA = "page_id long, record_id string, path string, frame long, frame_offset long, record_bytes long"


def record_id(page_id: int | None, digest: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{page_id}/{digest}')}>"


def encode_record(page_id, url, payload: bytes, payload_bytes: int, digest: str, refers_to) -> bytes:
    """One WARC record; ``refers_to`` makes it a revisit, without the payload."""
    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {payload_bytes}\r\n\r\n".encode()
    block = head + (payload if refers_to is None else b"")
    url = re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url) if url else f"urn:page:{'' if page_id is None else page_id}"
    fields = [
        ("WARC-Type", "response" if refers_to is None else "revisit"),
        ("WARC-Record-ID", record_id(page_id, digest)),
        ("WARC-Date", CAPTURE_DATE),
        ("WARC-Target-URI", url),
        ("WARC-Payload-Digest", f"sha256:{digest}"),
        ("X-Page-Id", "" if page_id is None else str(page_id)),
    ]
    if refers_to is not None:
        fields += [("WARC-Profile", REVISIT_PROFILE), ("WARC-Refers-To", record_id(refers_to, digest)), ("X-Refers-To-Page-Id", str(refers_to))]
    fields += [("Content-Type", "application/http; msgtype=response"), ("Content-Length", str(len(block)))]
    return b"WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields).encode() + b"\r\n" + block + b"\r\n\r\n"


def decode_record(data: bytes, at: int = 0) -> tuple[dict[str, str], bytes, int]:
    """(fields, block, where the next record begins)."""
    end = data.index(b"\r\n\r\n", at)
    lines = data[at:end].decode().split("\r\n")
    if lines[0] != "WARC/1.1":
        raise ValueError("no WARC record begins here")
    fields = dict(x.split(": ", 1) if ": " in x else (x.rstrip(":"), "") for x in lines[1:])
    begin = end + 4
    stop = begin + int(fields["Content-Length"])
    if data[stop : stop + 4] != b"\r\n\r\n":
        raise ValueError("a WARC record is cut short")
    return fields, data[begin:stop], stop + 4


class BundleWriter:
    """Records into frames of one bundle; ``close`` writes the seek table."""

    def __init__(self, stream, frame_bytes: int = FRAME_BYTES, level: int = 3):
        self.stream, self.frame_bytes = stream, frame_bytes
        self.compressor = zstandard.ZstdCompressor(level=level, write_checksum=True)
        self.held, self.held_bytes, self.frames = [], 0, []

    def add(self, record: bytes) -> tuple[int, int]:
        """(frame, offset in it) of the record."""
        if self.held and self.held_bytes + len(record) > self.frame_bytes:
            self._flush()
        at = (len(self.frames), self.held_bytes)
        self.held.append(record)
        self.held_bytes += len(record)
        return at

    def _flush(self) -> None:
        frame = self.compressor.compress(b"".join(self.held))
        self.stream.write(frame)
        self.frames.append((len(frame), self.held_bytes))
        self.held, self.held_bytes = [], 0

    def close(self) -> None:
        if self.held:
            self._flush()
        entries = b"".join(struct.pack("<II", *x) for x in self.frames)
        body = entries + struct.pack("<IBI", len(self.frames), 0, SEEKABLE_MAGIC)
        self.stream.write(struct.pack("<II", SKIPPABLE_MAGIC, len(body)) + body)
        self.stream.close()


class BundleReader:
    """Frames of one bundle by number, through its seek table."""

    def __init__(self, uri: str):
        fs, path = filesystem(uri)
        self.file = fs.open_input_file(path)
        size = self.file.size()
        self.file.seek(size - 9)
        frames, descriptor, magic = struct.unpack("<IBI", self.file.read(9))
        if magic != SEEKABLE_MAGIC or descriptor:
            raise ValueError(f"{uri} ends without a seek table")
        self.file.seek(size - 9 - 8 * frames)
        sizes = list(struct.iter_unpack("<II", self.file.read(8 * frames)))
        self.frames, at = [], 0
        for compressed, plain in sizes:
            self.frames.append((at, compressed, plain))
            at += compressed

    def frame(self, number: int) -> bytes:
        at, compressed, plain = self.frames[number]
        self.file.seek(at)
        return zstandard.ZstdDecompressor().decompress(self.file.read(compressed), max_output_size=plain)

    def record(self, frame: int, offset: int) -> tuple[dict[str, str], bytes]:
        return decode_record(self.frame(frame), offset)[:2]

    def records(self):
        for number in range(len(self.frames)):
            data, at = self.frame(number), 0
            while at < len(data):
                fields, block, at = decode_record(data, at)
                yield fields, block

    def close(self) -> None:
        self.file.close()


def plan_records(pages: DataFrame, min_dedup_bytes: int = MIN_DEDUP_BYTES, broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """Each page with payload_bytes, payload_digest and refers_to (null: a response)."""
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", F.coalesce("html", F.lit("")).cast("binary").alias("payload")).select("*", F.octet_length("payload").cast("long").alias("payload_bytes"), F.sha2("payload", 256).alias("payload_digest"))
    repeated = materialise(
        rows.where(F.col("payload_bytes") >= min_dedup_bytes)
        .groupBy(F.col("payload_digest").alias("repeated_digest"))
        .agg(F.min("page_id").alias("first_page"), F.count("*").alias("copies"))
        .where("copies > 1 AND first_page IS NOT NULL")
        .drop("copies"),
        "repeated-payloads",
    )
    if repeated.count() <= broadcast_rows:
        repeated = F.broadcast(repeated)
    joined = rows.join(repeated, rows["payload_digest"] == repeated["repeated_digest"], "left")
    return joined.withColumn("refers_to", F.when(~F.col("page_id").eqNullSafe(F.col("first_page")), F.col("first_page"))).drop("repeated_digest", "first_page")


def write_bundles(planned: DataFrame, folder: str, frame_bytes: int = FRAME_BYTES) -> DataFrame:
    """Write the bundles below ``folder``; returns the committed index."""

    def run(batches):
        task = TaskContext.get()
        uri = f"{folder}/part-{task.partitionId():05d}-{task.taskAttemptId()}.warc.zst"
        writer = None
        for batch in batches:
            out = []
            for row in batch.to_pylist():
                if writer is None:
                    fs, path = filesystem(uri)
                    fs.create_dir(path.rpartition("/")[0], recursive=True)
                    writer = BundleWriter(fs.open_output_stream(path, compression=None), frame_bytes)
                record = encode_record(row["page_id"], row["url"], row["payload"], row["payload_bytes"], row["payload_digest"], row["refers_to"])
                frame, offset = writer.add(record)
                out.append((row["page_id"], record_id(row["page_id"], row["payload_digest"]), uri, frame, offset, len(record)))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c) if t is None else pa.array(c, t) for c, t in zip(zip(*out), (pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.int64()), strict=True)], names=["page_id", "record_id", "path", "frame", "frame_offset", "record_bytes"])
        if writer is not None:
            writer.close()

    return materialise(planned.mapInArrow(run, INDEX_SCHEMA), "warc-index")


def read_bundles(index: DataFrame) -> DataFrame:
    """All records of the bundles that the index names, payload digests checked."""
    files = index.select("path").distinct()
    files = files.repartition(max(1, files.count()))

    def run(batches):
        for batch in batches:
            for uri in batch.column("path").to_pylist():
                reader, out, held = BundleReader(uri), [], 0
                for fields, block in reader.records():
                    head, _, payload = block.partition(b"\r\n\r\n")
                    digest, revisit = fields["WARC-Payload-Digest"].removeprefix("sha256:"), fields["WARC-Type"] == "revisit"
                    if not revisit:
                        found = hashlib.sha256(payload).hexdigest()
                        if found != digest:
                            raise ValueError(f"a payload in {uri} does not match its digest")
                    length = int(re.search(rb"Content-Length: (\d+)", head)[1]) if revisit else len(payload)
                    page, refers = fields["X-Page-Id"], fields.get("X-Refers-To-Page-Id")
                    out.append((int(page) if page else None, length, digest, fields["WARC-Type"], int(refers) if refers else None, fields["WARC-Record-ID"]))
                    held += 1
                    if held % 20_000 == 0:
                        yield _found(out)
                        out = []
                reader.close()
                if out:
                    yield _found(out)

    return files.mapInArrow(run, "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, record_id string")


def _found(out: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string())
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), kinds, strict=True)], names=["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "record_id"])


def read_record(index: DataFrame, wanted: str) -> tuple[dict[str, str], bytes]:
    """The record with one identifier: a filter of the index, then one frame."""
    row = index.where(F.col("record_id") == wanted).orderBy("path", "frame", "frame_offset").first()
    if row is None:
        raise KeyError(wanted)
    reader = BundleReader(row["path"])
    try:
        return reader.record(row["frame"], row["frame_offset"])
    finally:
        reader.close()


def op2_warc_bundles(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = write_bundles(plan_records(table(spark, sf_dir, "pages")), shared_dir(spark, "warc"))
    return read_bundles(index).drop("record_id")


OP2_SQL = """
WITH p AS (
  SELECT page_id, octet_length(encode(coalesce(html, ''))) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages
), f AS (
  SELECT payload_digest, min(page_id) AS first_page FROM p WHERE payload_bytes >= 100 GROUP BY payload_digest
)
SELECT p.page_id, p.payload_bytes, p.payload_digest,
       CASE WHEN f.first_page IS NULL OR f.first_page = p.page_id THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN f.first_page <> p.page_id THEN f.first_page END AS refers_to
FROM p LEFT JOIN f USING (payload_digest)
"""
