"""Packing: best-fit decreasing into fixed windows.

Documents are tokenised whole, closed by an end id, and cut into full windows;
what is left of each goes best-fit decreasing into the tightest open window.  A
segment tree over remaining capacity finds that window.  Pieces are dealt by a
hash of a row number to groups of bounded expected size, so no task sees more
than a group, and only (row, length) is shuffled, not ids.

Defined results: a null or empty text is one piece with the end id alone; rows
with equal or null doc_id are separate documents; other columns are ignored; an
empty table gives no rows.
"""

from __future__ import annotations

import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import materialise, released, table
from .pretokens import id_encoder

VOCABULARY = "byte_bpe_50k.json"
END_ID = 1
WINDOW = 2048
#: Expected pieces in one best-fit group: bounds a task's memory, and large enough for tight windows.
GROUP_PIECES = 16_384


class CapacityTree:
    """A segment tree over remaining capacities 0..window; a node counts the open windows below it."""

    def __init__(self, window: int):
        self.leaves = 1 << window.bit_length()
        self.count = [0] * (2 * self.leaves)
        self.open: list[list[int]] = [[] for _ in range(window + 1)]

    def _add(self, capacity: int, by: int) -> None:
        node = self.leaves + capacity
        while node:
            self.count[node] += by
            node >>= 1

    def put(self, capacity: int, window_id: int) -> None:
        if capacity > 0:
            self.open[capacity].append(window_id)
            self._add(capacity, 1)

    def take(self, need: int) -> tuple[int, int] | None:
        """The tightest open window with ``need`` or more left: (capacity, id)."""
        node = self.leaves + need
        if not self.count[node]:
            while node > 1 and (node & 1 or not self.count[node + 1]):
                node >>= 1
            if node <= 1:
                return None
            node += 1
            while node < self.leaves:
                node = 2 * node if self.count[2 * node] else 2 * node + 1
        capacity = node - self.leaves
        self._add(capacity, -1)
        return capacity, self.open[capacity].pop()


def best_fit_decreasing(lengths, window: int = WINDOW) -> tuple[np.ndarray, np.ndarray]:
    """Window number and offset of each length (1..window); ties keep the given order."""
    lengths = np.asarray(lengths, dtype=np.int64)
    which, offset = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
    tree, used = CapacityTree(window), 0
    for i in np.argsort(-lengths, kind="stable").tolist():
        need = int(lengths[i])
        found = tree.take(need)
        if found is None:
            capacity, at, used = window, used, used + 1
        else:
            capacity, at = found
        which[i], offset[i] = at, window - capacity
        tree.put(capacity - need, at)
    return which, offset


def encode_pieces(docs: DataFrame, vocabulary: str = VOCABULARY, end_id: int = END_ID, window: int = WINDOW, with_ids: bool = False) -> DataFrame:
    """A row for each piece: full windows of a document, then its rest."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"))
    end, width = int(end_id).to_bytes(4, "little"), 4 * window
    schema = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("doc_tokens", pa.int64())] + [("ids", pa.binary())] * with_ids)

    def batch_of(out):
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(out, schema, strict=True)], schema=schema)

    def run(batches):
        encoder = id_encoder(vocabulary)
        with released(encoder.words, encoder.pre):
            for batch in batches:
                out: list[list] = [[] for _ in schema]
                held = 0
                for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text"), strict=True):
                    ids = encoder.encode(text.as_py()) + end
                    for at in range(0, len(ids), width):
                        piece = ids[at : at + width]
                        row = (doc_id, at // 4, len(piece) // 4, zlib.crc32(piece), len(ids) // 4, piece)
                        for column, value in zip(out, row, strict=False):
                            column.append(value)
                    held += len(ids)
                    if with_ids and held > 16_000_000:
                        yield batch_of(out)
                        out, held = [[] for _ in schema], 0
                yield batch_of(out)

    ddl = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long" + ", ids binary" * with_ids
    return rows.mapInArrow(run, ddl).withColumn("piece_row", F.monotonically_increasing_id())


def pack(docs: DataFrame, vocabulary: str = VOCABULARY, end_id: int = END_ID, window: int = WINDOW, group_pieces: int = GROUP_PIECES, with_ids: bool = False) -> DataFrame:
    """Pieces of ``docs`` with sequence_id and offset; ``with_ids`` also gives the ids of each piece."""
    pieces = materialise(encode_pieces(docs, vocabulary, end_id, window, with_ids), "pieces")
    groups = max(1, -(-pieces.count() // group_pieces))

    def place(key, frame):
        frame = frame.sort_values("piece_row", kind="stable")
        which, offset = best_fit_decreasing(frame["length"].to_numpy(), window)
        return pd.DataFrame({"row": frame["piece_row"], "sequence_id": (int(key[0]) << 32) + which, "offset": offset})

    placed = (
        pieces.select("piece_row", "length", F.pmod(F.xxhash64("piece_row"), F.lit(groups)).alias("pack_group"))
        .groupBy("pack_group")
        .applyInPandas(place, "row long, sequence_id long, offset long")
    )
    return pieces.join(placed, pieces["piece_row"] == placed["row"]).drop("row", "piece_row")


def sequences(packed: DataFrame) -> DataFrame:
    """The ids of each sequence, from ``pack(..., with_ids=True)``: little-endian unsigned 32-bit."""
    return packed.groupBy("sequence_id").agg(
        F.sum("length").alias("length"),
        F.transform(F.array_sort(F.collect_list(F.struct("offset", "doc_id", "start", "ids"))), lambda x: x["ids"]).alias("parts"),
    )


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents")).select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")
