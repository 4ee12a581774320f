"""Token-ID shards as sorted string tables.

Documents are range-partitioned and sorted by identifier; each partition becomes
one shard: data blocks of prefix-compressed keys with restart points, then a
Bloom filter, a sparse index (last key of each block) and a fixed footer.  A
lookup tests the filter, bisects the index, bisects the restart points of one
block and scans at most one restart run.

    shard  = block* filter index footer
    block  = Zstandard(entry* restart:u32* restarts:u32) crc32:u32
    entry  = shared:varint unshared:varint value:varint key-suffix value
    value  = start-in-shard:u64 ids (u16 where the vocabulary allows, else u32)
    footer = filter offset, filter bytes, hashes, index offset, index bytes,
             documents, ids, id width (u64 each), magic
    all integers little-endian; keys order as their bytes do

Defined results: a null or empty text holds the end id alone; null doc_ids sort
first; rows with equal doc_id are all kept, ordered by their text's hash and
text; other columns are ignored; an empty table gives no shard and no rows.
Texts are encoded whole, and a document never spans shards.
"""

from __future__ import annotations

import bisect
import math
import struct
import zlib

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ._common import filesystem, materialise, released, shared_dir, table
from .pretokens import id_encoder

VOCABULARY = "word_bpe_49k.json"
END_ID = 2
BLOCK_BYTES = 64 * 1024
RESTART_EVERY = 16
BITS_PER_KEY = 10
MAGIC = b"CFSSTBL1"
FOOTER = struct.Struct("<8Q8s")
SHARDS_SCHEMA = "shard int, path string, documents long, ids long, bytes long"


def key_of(doc_id: int | None) -> bytes:
    """Keys whose byte order is the order of identifiers, nulls first."""
    return b"\x00" if doc_id is None else b"\x01" + struct.pack(">Q", doc_id + (1 << 63))


def id_of(key: bytes) -> int | None:
    return None if key == b"\x00" else struct.unpack(">Q", key[1:])[0] - (1 << 63)


def _varint(n: int) -> bytes:
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    out.append(n)
    return bytes(out)


def _read_varint(data: bytes, at: int) -> tuple[int, int]:
    n = shift = 0
    while True:
        b = data[at]
        at += 1
        n |= (b & 127) << shift
        if b < 128:
            return n, at
        shift += 7


def _bloom_bits(key: bytes, hashes: int, bits: int):
    h = xxhash.xxh3_128_intdigest(key)
    first, step = h & (1 << 64) - 1, h >> 64 | 1
    return ((first + i * step) % bits for i in range(hashes))


class ShardWriter:
    """One shard, written in ascending key order."""

    def __init__(self, stream, width: int):
        self.stream, self.width, self.at = stream, width, 0
        self.compressor = zstandard.ZstdCompressor(level=1)
        self.index, self.keys, self.ids = [], [], 0
        self._begin()

    def _begin(self) -> None:
        self.block, self.restarts, self.entries, self.last, self.size = [], [], 0, b"", 0

    def add(self, key: bytes, ids: np.ndarray) -> None:
        if self.entries % RESTART_EVERY == 0:
            self.restarts.append(self.size)
            shared = 0
        else:
            shared = next((i for i, (a, b) in enumerate(zip(self.last, key, strict=False)) if a != b), min(len(self.last), len(key)))
        value = struct.pack("<Q", self.ids) + ids.astype(f"<u{self.width}").tobytes()
        entry = _varint(shared) + _varint(len(key) - shared) + _varint(len(value)) + key[shared:] + value
        self.block.append(entry)
        self.size += len(entry)
        self.entries += 1
        self.ids += len(ids)
        self.last = key
        self.keys.append(key)
        if self.size >= BLOCK_BYTES:
            self._flush()

    def _flush(self) -> None:
        plain = b"".join(self.block) + struct.pack(f"<{len(self.restarts)}II", *self.restarts, len(self.restarts))
        data = self.compressor.compress(plain)
        self.stream.write(data + struct.pack("<I", zlib.crc32(data)))
        self.index.append((self.last, self.at, len(data)))
        self.at += len(data) + 4
        self._begin()

    def close(self) -> int:
        """Finish the shard; its size in bytes."""
        if self.block:
            self._flush()
        bits, hashes = max(64, BITS_PER_KEY * len(self.keys)), max(1, round(BITS_PER_KEY * math.log(2)))
        bloom = bytearray((bits + 7) // 8)
        for key in self.keys:
            for bit in _bloom_bits(key, hashes, 8 * len(bloom)):
                bloom[bit >> 3] |= 1 << (bit & 7)
        index = b"".join(_varint(len(k)) + k + _varint(at) + _varint(n) for k, at, n in self.index)
        footer = FOOTER.pack(self.at, len(bloom), hashes, self.at + len(bloom), len(index), len(self.keys), self.ids, self.width, MAGIC)
        self.stream.write(bytes(bloom) + index + footer)
        self.stream.close()
        return self.at + len(bloom) + len(index) + len(footer)


class ShardReader:
    def __init__(self, uri: str):
        fs, path = filesystem(uri)
        self.uri, self.file = uri, fs.open_input_file(path)
        self.file.seek(self.file.size() - FOOTER.size)
        bloom_at, bloom_bytes, self.hashes, index_at, index_bytes, self.documents, self.ids, self.width, magic = FOOTER.unpack(self.file.read(FOOTER.size))
        if magic != MAGIC:
            raise ValueError(f"{uri} is no shard")
        self.file.seek(bloom_at)
        self.bloom = self.file.read(bloom_bytes)
        self.file.seek(index_at)
        raw, at, self.index = self.file.read(index_bytes), 0, []
        while at < len(raw):
            n, at = _read_varint(raw, at)
            key, at = raw[at : at + n], at + n
            offset, at = _read_varint(raw, at)
            size, at = _read_varint(raw, at)
            self.index.append((key, offset, size))
        self.last_keys = [x[0] for x in self.index]

    def block(self, number: int) -> tuple[bytes, list[int]]:
        _, at, size = self.index[number]
        self.file.seek(at)
        data = self.file.read(size + 4)
        if zlib.crc32(data[:-4]) != struct.unpack("<I", data[-4:])[0]:
            raise ValueError(f"block {number} of {self.uri} is damaged")
        plain = zstandard.ZstdDecompressor().decompress(data[:-4])
        restarts = struct.unpack("<I", plain[-4:])[0]
        return plain[: -4 - 4 * restarts], list(struct.unpack(f"<{restarts}I", plain[-4 - 4 * restarts : -4]))

    def entries(self, data: bytes, at: int = 0):
        """(key, start in the shard, ids) from a restart point on."""
        key = b""
        while at < len(data):
            shared, at = _read_varint(data, at)
            unshared, at = _read_varint(data, at)
            size, at = _read_varint(data, at)
            key, at = key[:shared] + data[at : at + unshared], at + unshared
            yield key, struct.unpack_from("<Q", data, at)[0], np.frombuffer(data, f"<u{self.width}", (size - 8) // self.width, at + 8)
            at += size

    def scan(self):
        for number in range(len(self.index)):
            yield from self.entries(self.block(number)[0])

    def get(self, doc_id: int | None) -> list[tuple[int, np.ndarray]]:
        """(start, ids) of every row stored under ``doc_id``; usually one or none."""
        key = key_of(doc_id)
        if not all(self.bloom[b >> 3] >> (b & 7) & 1 for b in _bloom_bits(key, self.hashes, 8 * len(self.bloom))):
            return []
        found, number = [], bisect.bisect_left(self.last_keys, key)
        while number < len(self.index):
            data, restarts = self.block(number)
            first = bisect.bisect_left(restarts, key, key=lambda at: next(self.entries(data, at))[0])
            for k, start, ids in self.entries(data, restarts[max(0, first - 1)]):
                if k > key:
                    return found
                if k == key:
                    found.append((start, ids))
            number += 1
        return found

    def close(self) -> None:
        self.file.close()


def write_shards(docs: DataFrame, folder: str, vocabulary: str = VOCABULARY, end_id: int = END_ID) -> DataFrame:
    """Write the shards below ``folder``; returns the committed list of shards, ascending."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"))
    rows = rows.withColumn("tie", F.xxhash64("text")).repartitionByRange("doc_id", "tie").sortWithinPartitions("doc_id", "tie", "text").select("doc_id", "text")
    end = int(end_id).to_bytes(4, "little")

    def run(batches):
        task, writer, encoder = TaskContext.get(), None, id_encoder(vocabulary)
        uri = f"{folder}/shard-{task.partitionId():05d}-{task.taskAttemptId()}.sst"
        with released(encoder.words, encoder.pre):
            for batch in batches:
                for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text"), strict=True):
                    if writer is None:
                        fs, path = filesystem(uri)
                        fs.create_dir(path.rpartition("/")[0], recursive=True)
                        writer = ShardWriter(fs.open_output_stream(path, compression=None), 2 if encoder.library.get_vocab_size() <= 1 << 16 else 4)
                    writer.add(key_of(doc_id), np.frombuffer(encoder.encode(text.as_py()) + end, "<u4"))
        if writer is not None:
            size = writer.close()
            yield pa.RecordBatch.from_pylist([{"shard": task.partitionId(), "path": uri, "documents": len(writer.keys), "ids": writer.ids, "bytes": size}], schema=pa.schema([("shard", pa.int32()), ("path", pa.string()), ("documents", pa.int64()), ("ids", pa.int64()), ("bytes", pa.int64())]))

    return materialise(rows.mapInArrow(run, SHARDS_SCHEMA), "shards")


def read_shards(shards: DataFrame) -> DataFrame:
    """Every document of the shards: doc_id, start over all shards, n_tokens, ids_crc32."""
    # one row for each shard, so the running sum is over the list of files, not over documents
    order = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    placed = shards.select("path", F.coalesce(F.sum("ids").over(order), F.lit(0)).alias("base"))
    placed = placed.repartition(max(1, shards.count()))

    def run(batches):
        for batch in batches:
            for row in batch.to_pylist():
                reader, out = ShardReader(row["path"]), []
                for key, start, ids in reader.scan():
                    out.append((id_of(key), row["base"] + start, len(ids), zlib.crc32(ids.astype("<u4").tobytes())))
                    if len(out) == 20_000:
                        yield _rows(out)
                        out = []
                reader.close()
                if out:
                    yield _rows(out)

    return placed.mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def _rows(out: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out)], names=["doc_id", "start", "n_tokens", "ids_crc32"])


def op3_token_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_shards(write_shards(table(spark, sf_dir, "documents"), shared_dir(spark, "sst")))
