"""Shared plumbing: text blocks, tables, bounded samples."""

from __future__ import annotations

import contextlib
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from chronofold.cluster import filesystem, materialise, shared_dir, ship

__all__ = ["bounded_sample", "excerpt", "filesystem", "materialise", "released", "shared_dir", "ship", "table", "text_blocks"]

#: Characters of text handled at once by the block-wise Python operators.
BLOCK_CHARS = 2_000_000
#: Pieces of a long text that a sample learns from.
SAMPLE_PIECES = 8


def text_blocks(texts: Iterable, limit: int = BLOCK_CHARS) -> Iterator[tuple[int, int]]:
    """(start, end) runs of ``texts`` with about ``limit`` characters, one text at least."""
    start, held, i = 0, 0, 0
    for i, text in enumerate(texts, 1):
        held += len(text)
        if held >= limit:
            yield start, i
            start, held = i, 0
    if start < i:
        yield start, i


@contextlib.contextmanager
def released(*caches):
    """Empties the caches when a task ends: an idle Python worker keeps no more than its imports."""
    try:
        yield
    finally:
        for cache in caches:
            cache.clear()
        pa.default_memory_pool().release_unused()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return ship(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def excerpt(text, chars: int, pieces: int = SAMPLE_PIECES):
    """The column's text; of one over ``chars`` characters, whole words of pieces spread evenly from its begin to its end."""
    size = max(1, chars // pieces)
    parts = []
    for i in range(pieces):
        at = F.floor((F.length(text) - size) * i / max(1, pieces - 1)).cast("int") + 1
        part = F.substring(text, at, F.lit(size))
        part = F.regexp_replace(part, r"^\S*\s+", "") if i else part  # the rest of a word cut at its begin
        parts.append(F.regexp_replace(part, r"\s\S*$", "") if i < pieces - 1 else part)
    return F.when(F.length(text) > chars, F.concat_ws(" ", *parts)).otherwise(text)


def bounded_sample(docs: DataFrame, labelled: DataFrame, per_label: int, cut=lambda text: text) -> tuple[list, dict]:
    """(doc_id, label, text) rows, and the number of all rows by label: at most ``per_label`` documents of each label, by the order of a hash.

    ``labelled`` (doc_id, label; a table, as it is read twice) has few labels.
    Labels are counted first, so that a hash threshold leaves a few times
    ``per_label`` identifiers of each to rank, however many there are.  The texts
    of those picked come from one scan, each as ``cut`` (of the column) leaves it.
    Of rows that share a doc_id the smallest such text counts.
    """
    span = 1 << 40
    counts = {r["label"]: r["n"] for r in labelled.groupBy("label").agg(F.count("*").alias("n")).collect()}
    if not counts:
        return [], {}
    share = F.create_map(*(F.lit(x) for label, n in counts.items() for x in (label, min(span, span * (4 * per_label + 64) // n))))
    ranked = labelled.select("doc_id", "label", F.pmod(F.xxhash64("doc_id"), F.lit(span)).alias("h")).where(F.col("h") < F.element_at(share, F.col("label"))).distinct()
    by_hash = Window.partitionBy("label").orderBy("h", "doc_id")
    picked = ranked.withColumn("rank", F.row_number().over(by_hash)).where(F.col("rank") <= per_label)
    picked = materialise(picked.select(F.col("doc_id").alias("s_id"), "label"), "sample")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    texts = rows.join(F.broadcast(picked), rows["doc_id"] == picked["s_id"]).groupBy("doc_id", "label").agg(F.min(cut(F.col("text"))).alias("text"))
    return sorted(texts.collect(), key=lambda r: (r["doc_id"], str(r["label"]))), counts
