"""Binary segment and snapshot files: written by tasks, read through ``binaryFile``.

A segment or a snapshot is one file.  A task holds a segment whole, which its target
size bounds; a snapshot file, as large as the state, goes through a task in pieces.
"""

from __future__ import annotations

import hashlib
import struct

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from chronofold.cluster import filesystem, materialise, shared_dir, ship
from chronofold.functions import codec
from chronofold.model import PUT, ChangelogError, StorageSettings
from chronofold.operators.fold import latest_state, session_table
from chronofold.operators.layout import _HALF, _half_state, assign_segments, chain_problems, frame_sizes
from chronofold.sources.changelog import cmd_log, sql

FRAME_SCHEMA = "segment string, offset long, size long, seq long, kind int, client long, request_seq long, key string, value string, error string, incomplete boolean, length long"
#: Bytes of a snapshot file that a task reads at once, and rows that it gives at once.
SNAPSHOT_BYTES, SNAPSHOT_ROWS = 8 << 20, 10_000


def client_bytes(client: int) -> bytes:
    return client.to_bytes(8, "little") + bytes(8)


def write_segments(assigned: DataFrame, folder: str, spec: codec.FormatSpec = codec.DEFAULT) -> DataFrame:
    """One file per segment from commands with ``segment`` (a table, as it is read three times); returns (segment, name)."""
    ends = assigned.groupBy("segment").agg(F.min("global_seq").alias("start_seq"), F.max("global_seq").alias("end_seq"))
    newest = assigned.agg(F.max("segment").alias("newest"))
    named = ends.join(F.broadcast(newest)).select("segment", codec.segment_name(F.col("start_seq"), F.when(F.col("segment") < F.col("newest"), F.col("end_seq"))).alias("name"), "start_seq")
    payload = F.unhex(codec.command_hex(*(F.col(c) for c in ("kind", "client", "request_seq", "key", "value"))))
    # a number, so that small logs too are written by as many tasks as there are cores
    tasks = int(assigned.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = assigned.join(named, "segment").repartition(tasks, "segment").sortWithinPartitions("segment", "global_seq")
    rows = rows.select("segment", "name", "start_seq", "global_seq", payload.alias("payload"))

    def run(batches):
        own, stream, done = None, None, []
        fs, at = filesystem(folder)
        fs.create_dir(at, recursive=True)
        for batch in batches:
            segments, names, starts, seqs, payloads = (c.to_pylist() for c in batch.columns)
            frames = codec.encode_frames(seqs, payloads, spec)
            for segment, name, start, frame in zip(segments, names, starts, frames, strict=True):
                if segment != own:
                    if stream is not None:
                        stream.close()
                    own, stream = segment, fs.open_output_stream(f"{at}/{name}", compression=None)
                    stream.write(codec.encode_segment_header(start, spec))
                    done.append({"segment": own, "name": name})
                stream.write(frame)
        if stream is not None:
            stream.close()
        if done:
            yield pa.RecordBatch.from_pylist(done, schema=pa.schema([("segment", pa.int64()), ("name", pa.string())]))

    ship(assigned.sparkSession)
    return materialise(rows.mapInArrow(run, "segment long, name string"), "segments")


def frames_of(name: str, data: bytes, most: int, spec: codec.FormatSpec = codec.DEFAULT):
    """A row for the header (without ``seq``) and for every frame of a segment file; a damaged one has ``error`` and is the last."""
    row = lambda **x: {"segment": name, "length": len(data), "incomplete": False} | x
    try:
        codec.decode_segment_header(data, spec)
    except ChangelogError as e:
        yield row(offset=0, size=0, error=e.detail)
        return
    at = codec.model.SEGMENT_HEADER_BYTES
    yield row(offset=0, size=at)
    found, error = codec.decode_frames(data, at, most, spec)
    for at, size, seq in found:
        payload = data[at + codec.model.FRAME_HEADER_BYTES : at + size]
        n = int.from_bytes(payload[26:30], "little")
        value = payload[34 + n :].decode() if payload[1] == PUT else None
        yield row(offset=at, size=size, seq=seq, kind=payload[1], client=int.from_bytes(payload[2:10], "little"), request_seq=int.from_bytes(payload[18:26], "little"), key=payload[30 : 30 + n].decode(), value=value)
    end = sum(found[-1][:2]) if found else codec.model.SEGMENT_HEADER_BYTES
    if isinstance(error, codec.Incomplete):
        yield row(offset=end, size=0, error="frame: incomplete", incomplete=True)
    elif error is not None:
        yield row(offset=end, size=getattr(error, "size", 0), error=error.detail)


def read_frames(spark: SparkSession, folder: str, settings: StorageSettings | None = None, spec: codec.FormatSpec = codec.DEFAULT) -> DataFrame:
    """The rows of ``frames_of`` for all segment files of a folder."""
    most = (settings or StorageSettings()).checked().max_frame_payload
    files = ship(spark).read.format("binaryFile").option("pathGlobFilter", "wal-*").load(folder)
    files = files.select(F.element_at(F.split("path", "/"), -1).alias("segment"), "content")
    kinds = {"string": pa.string(), "long": pa.int64(), "int": pa.int32(), "boolean": pa.bool_()}
    schema = pa.schema([(n, kinds[t]) for n, t in (x.split() for x in FRAME_SCHEMA.split(", "))])

    def run(batches):
        for batch in batches:
            for r in batch.to_pylist():
                yield pa.RecordBatch.from_pylist(list(frames_of(r["segment"], r["content"], most, spec)), schema=schema)

    return files.mapInArrow(run, FRAME_SCHEMA)


class SegmentSource(DataSource):
    """``spark.dataSource.register(SegmentSource)``, then ``spark.read.format("changelog_segments").load(folder)``."""

    @classmethod
    def name(cls) -> str:
        return "changelog_segments"

    def schema(self) -> str:
        return FRAME_SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return SegmentReader(self.options["path"])


class SegmentReader(DataSourceReader):
    """One partition per segment file."""

    def __init__(self, folder: str):
        self.folder = folder

    def partitions(self) -> list[InputPartition]:
        fs, at = filesystem(self.folder)
        found = fs.get_file_info(pafs.FileSelector(at))
        return [InputPartition(f.path) for f in sorted(found, key=lambda f: f.path) if f.is_file and f.base_name.startswith("wal-")]

    def read(self, partition: InputPartition):
        fs, _ = filesystem(self.folder)
        with fs.open_input_file(partition.value) as f:
            data = f.read()
        names = [x.split()[0] for x in FRAME_SCHEMA.split(", ")]
        for r in frames_of(partition.value.rpartition("/")[2], data, StorageSettings().checked().max_frame_payload):
            yield tuple(r.get(n) for n in names)


def list_files(spark: SparkSession, folder: str) -> DataFrame:
    """name, is_dir and bytes of a data directory's files, for ``layout.classify_files``."""
    files = spark.read.format("binaryFile").load(folder)
    return files.select(F.element_at(F.split("path", "/"), -1).alias("name"), F.lit(False).alias("is_dir"), F.col("length").alias("bytes"))


def recover(spark: SparkSession, folder: str, snapshot_seq: int = 0) -> tuple[DataFrame, int]:
    """Frames after ``snapshot_seq`` and bytes of torn tail left out; raises CORRUPTION where the log cannot be proven.

    Nothing is cut from a file: damaged rows are left out.
    """
    # segments are read whole, many to a task: the frames' table gets a file for each core, not for each segment
    frames = materialise(read_frames(spark, folder).coalesce(spark.sparkContext.defaultParallelism), "frames")
    names = frames.select("segment").distinct().select("segment", codec.parse_segment_name(F.col("segment")).alias("p")).select("segment", "p.*")
    if bad := names.where("error IS NOT NULL").first():
        raise ChangelogError("CORRUPTION", f"file name: {bad['error']}")
    if bad := chain_problems(names, snapshot_seq).where("problem IS NOT NULL").first():
        raise ChangelogError("CORRUPTION", f"segments: {bad['problem']}")
    newest = names.orderBy(F.desc("start_seq")).first()
    dropped = 0
    for e in frames.where("error IS NOT NULL").limit(2).collect():  # the second already fails
        torn = newest is not None and e["segment"] == newest["segment"] and not newest["sealed"] and e["error"].startswith("frame") and (e["incomplete"] or e["offset"] + e["size"] == e["length"])
        if not torn:
            raise ChangelogError("CORRUPTION", f"{e['error']} in {e['segment']}")
        dropped = e["length"] - e["offset"]
    good = frames.where("error IS NULL AND seq IS NOT NULL")
    starts = names.select("segment", "start_seq", "end_seq", "sealed")
    per = good.groupBy("segment").agg(F.min("seq").alias("low"), F.max("seq").alias("high"), F.count("*").alias("n"), F.countDistinct("seq").alias("d"))
    off = starts.join(per, "segment", "left").where("low <> start_seq OR high - low + 1 <> n OR d <> n OR (sealed AND NOT high <=> end_seq)")
    if not off.isEmpty():
        raise ChangelogError("CORRUPTION", "a segment's records do not follow its name")
    return good.where(F.col("seq") > snapshot_seq), dropped


def _pieces(stream):
    while piece := stream.read(SNAPSHOT_BYTES):
        yield piece


def _proven(fs, path: str, settings: StorageSettings | None = None) -> tuple[tuple, str]:
    """Header, and hash of the payload, of a snapshot file that is as long as its header says and has its checksum."""
    with fs.open_input_stream(path, compression=None) as f:
        data = f.read(codec.model.SNAPSHOT_HEADER_BYTES)
        head, crc, size, hashed = codec.decode_snapshot_header(data, settings), codec.crc32c(data[:40]), 0, hashlib.sha256()
        for piece in _pieces(f):
            crc, size = codec.crc32c(piece, crc), size + len(piece)
            hashed.update(piece)
    if size != head[3]:
        raise ChangelogError("CORRUPTION", "snapshot: payload length")
    if crc != head[4]:
        raise ChangelogError("CORRUPTION", "snapshot: checksum")
    return head, hashed.hexdigest()


def _entries(fs, path: str, head: tuple, settings: StorageSettings | None = None):
    with fs.open_input_stream(path, compression=None, buffer_size=1 << 20) as f:
        f.read(codec.model.SNAPSHOT_HEADER_BYTES)
        yield from codec.snapshot_entries(f.read, head, settings)


def write_snapshot(commands: DataFrame, folder: str, settings: StorageSettings | None = None) -> str:
    """One snapshot file of the state after ``commands``; published by a rename once read back and found equal.

    Rows are encoded in parallel; one task sorts them (spilling) and streams them to
    the file.  The header has counts and a checksum of what follows, so the payload is
    written first, to a file of its own.  All keys and sessions go into the file;
    ``settings``, where given, refuse a state beyond their limits.
    """
    spark = commands.sparkSession
    limits = settings and settings.checked()
    piece = lambda c: F.concat(codec.le_hex(F.octet_length(c), 4), F.hex(F.encode(c, "utf-8")))
    state = latest_state(commands).select(F.lit(0).alias("part"), F.encode("key", "utf-8").alias("k"), F.unhex(F.concat(piece(F.col("key")), piece(F.col("value")))).alias("entry"))
    sessions = session_table(commands).select(F.lit(1).alias("part"), F.unhex(codec.client_hex(F.col("client"))).alias("k"), F.unhex(codec.session_hex()).alias("entry"))
    applied = commands.agg(F.max("global_seq")).first()[0]
    name = f"snapshot-{applied:020d}.snap"

    def run(batches):
        from pyspark import TaskContext

        fs, at = filesystem(folder)
        fs.create_dir(at, recursive=True)
        stem = f"{at}/{name[:-5]}-{TaskContext.get().taskAttemptId()}"
        counts, size, hashed = [0, 0], 0, hashlib.sha256()
        with fs.open_output_stream(f"{stem}.payload.tmp", compression=None) as f:
            for batch in batches:
                parts = batch.column("part").to_pylist()
                data = b"".join(batch.column("entry").to_pylist())
                counts = [n + parts.count(i) for i, n in enumerate(counts)]
                size += len(data)
                hashed.update(data)
                f.write(data)
        head = codec.encode_snapshot_header(applied, *counts, size)
        crc = codec.crc32c(head)
        with fs.open_input_stream(f"{stem}.payload.tmp", compression=None) as f:
            for data in _pieces(f):
                crc = codec.crc32c(data, crc)
        with fs.open_output_stream(f"{stem}.tmp", compression=None) as out, fs.open_input_stream(f"{stem}.payload.tmp", compression=None) as f:
            out.write(head + struct.pack("<I", crc))
            for data in _pieces(f):
                out.write(data)
        fs.delete_file(f"{stem}.payload.tmp")
        back, digest = _proven(fs, f"{stem}.tmp", limits)
        if back != (applied, *counts, size, crc) or digest != hashed.hexdigest():
            raise ChangelogError("CORRUPTION", "a snapshot did not read back as written")
        for _ in _entries(fs, f"{stem}.tmp", back, limits):
            pass  # raises where order, lengths or sessions are wrong
        fs.move(f"{stem}.tmp", f"{at}/{name}")
        yield pa.RecordBatch.from_pylist([{"name": name}])

    rows = state.unionByName(sessions).repartition(1).sortWithinPartitions("part", "k")
    ship(spark)
    return materialise(rows.select("part", "entry").mapInArrow(run, "name string"), "snapshot-names").first()["name"]


def read_snapshot(spark: SparkSession, folder: str, name: str, settings: StorageSettings | None = None) -> DataFrame:
    """key, value and applied sequence of a snapshot file, read in pieces by one task; ``settings``, where given, refuse one beyond their limits."""
    limits = settings and settings.checked()
    schema = pa.schema([("key", pa.string()), ("value", pa.string()), ("applied", pa.int64()), ("sessions", pa.int64())])

    def run(batches):
        if not sum(b.num_rows for b in batches):
            return
        fs, at = filesystem(folder)
        head, _ = _proven(fs, f"{at}/{name}", limits)
        applied, keys, sessions = head[:3]
        rows, size = [], 0
        for i, (key, value) in enumerate(_entries(fs, f"{at}/{name}", head, limits)):
            if i < keys:  # sessions follow, which are only checked
                rows.append({"key": key.decode(), "value": value.decode(), "applied": applied, "sessions": sessions})
                size += len(key) + len(value)
            if rows and (len(rows) == SNAPSHOT_ROWS or size >= SNAPSHOT_BYTES):
                yield pa.RecordBatch.from_pylist(rows, schema=schema)
                rows, size = [], 0
        yield pa.RecordBatch.from_pylist(rows, schema=schema)

    return ship(spark).range(0, 1, 1, 1).mapInArrow(run, "key string, value string, applied long, sessions long")


def _wal_roundtrip(s, d):
    commands = cmd_log(s, d)
    assigned = commands.join(assign_segments(frame_sizes(commands)).select("global_seq", "segment"), "global_seq")
    folder = shared_dir(s, "wal")
    write_segments(materialise(assigned, "assigned"), folder)
    frames, _ = recover(s, folder)
    return frames.select("seq", "kind", "client", "request_seq", "key", "value")


def _snapshot_roundtrip(s, d):
    folder = shared_dir(s, "snapshots")
    return read_snapshot(s, folder, write_snapshot(_half_state(s, d), folder))


QUERIES = {"wal_roundtrip": _wal_roundtrip, "snapshot_roundtrip": _snapshot_roundtrip}
ORACLE_SQL = {
    "wal_roundtrip": sql(" SELECT global_seq AS seq, kind, client, request_seq, key, value FROM cmd_log", "cmd_log"),
    "snapshot_roundtrip": sql(_HALF + " SELECT key, value, (SELECT max(global_seq) FROM half) AS applied, (SELECT count(DISTINCT client) FROM half) AS sessions FROM rws", "cmd_log"),
}
