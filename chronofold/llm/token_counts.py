"""Token counts: pieces counted once per distinct pre-token, joined to frequencies.

A text is a bag of pre-tokens across whose borders no piece reaches, so its token
count is the sum of frequency x pieces; ids are never made.

1. Each task lists the distinct pre-tokens that it meets; one aggregation makes
   them the corpus's, and each is given to the tokeniser once.
2. The pre-tokens of the highest frequencies, at most ``HEAD_ENTRIES`` of at most
   ``HEAD_CHARS`` characters, go to every task; there each document's frequencies
   are joined to them by hash, and summed.
3. The other pre-tokens of a document, which are rare, are joined by shuffle and
   summed by document.  None of them is frequent, so no key is hot.

Both joins hold for every table; a small one merely has no rare pre-tokens.

Defined results: null and empty texts have 0 bytes and 0 tokens; a null doc_id is
kept; repeated rows are counted each; other columns are ignored; an empty table
gives no rows.  Very long texts are counted whole.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from chronofold.cluster import ship

from ._common import materialise, released, table
from .pretokens import piece_counter, piece_keys

VOCABULARY = "piece_bpe_32k.model"
LIMIT = 4096
#: Bounds of the table that every task gets.
HEAD_ENTRIES, HEAD_CHARS = 400_000, 64
#: Distinct pre-tokens that a task holds before it passes them on.
HELD_ENTRIES = 400_000
#: Classes of frequency for each doubling, from which the head's least frequency follows.
CLASSES = 8


def distinct_pre_tokens(texts: DataFrame, vocabulary: str, held_entries: int = HELD_ENTRIES) -> DataFrame:
    """part, n and pieces of each distinct pre-token of the corpus."""

    def listed(batches):
        held: Counter = Counter()
        for batch in batches:
            for text in batch.column("text"):
                held.update(piece_keys(text.as_py()))
                if len(held) >= held_entries:
                    yield _batch(held)
                    held = Counter()
        if held:
            yield _batch(held)

    def weighed(batches):
        counter = piece_counter(vocabulary)
        with released(counter.parts):
            for batch in batches:
                pieces = pa.array([counter.pieces(x) for x in batch.column("part").to_pylist()], pa.int64())
                yield pa.RecordBatch.from_arrays([*batch.columns, pieces], names=["part", "n", "pieces"])

    met = texts.mapInArrow(listed, "part string, n long").groupBy("part").agg(F.sum("n").alias("n"))
    return materialise(met.mapInArrow(weighed, "part string, n long, pieces long"), "pre-tokens")


def _batch(held: Counter) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(held.keys(), pa.string()), pa.array(held.values(), pa.int64())], names=["part", "n"])


def in_head(known: DataFrame, entries: int = HEAD_ENTRIES) -> Column:
    """Whether a row is of the highest frequency classes, of which as many count whole as ``entries`` hold."""
    frequency, short = F.floor(F.log2("n") * CLASSES), F.length("part") <= HEAD_CHARS
    room, least = entries, None
    for r in known.where(short).groupBy(frequency.alias("c")).count().orderBy(F.desc("c")).collect():  # some hundred classes at most
        if r["count"] > room:
            break
        room, least = room - r["count"], r["c"]
    return short & (frequency >= least) if least is not None else F.lit(False)


def count_tokens(docs: DataFrame, vocabulary: str = VOCABULARY, id_col: str = "doc_id", text_col: str = "text", head_entries: int = HEAD_ENTRIES) -> DataFrame:
    """``id_col``, n_bytes and n_tokens of each row of ``docs``."""
    spark = ship(docs.sparkSession)
    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("text"))
    known = distinct_pre_tokens(rows.select("text"), vocabulary)
    head = in_head(known, head_entries)
    found = known.where(head).select("part", "pieces").toArrow()
    held = spark.sparkContext.broadcast(dict(zip(found.column(0).to_pylist(), found.column(1).to_pylist(), strict=True)))  # head_entries at most

    def summed(batches):
        get = held.value.get
        for batch in batches:
            text, totals, ends, parts, numbers = batch.column("text"), [], [0], [], []
            for x in text:
                total, frequency = 0, Counter(piece_keys(x.as_py()))
                for part, n, pieces in zip(frequency, frequency.values(), map(get, frequency)):
                    if pieces is None:
                        parts.append(part)
                        numbers.append(n)
                    else:
                        total += n * pieces
                totals.append(total)
                ends.append(len(parts))
            offsets = pa.array(np.asarray(ends, np.int32))
            rare = [pa.ListArray.from_arrays(offsets, pa.array(parts, pa.string())), pa.ListArray.from_arrays(offsets, pa.array(numbers, pa.int64()))]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pc.binary_length(text).cast(pa.int64()), pa.array(totals, pa.int64()), *rare], names=["doc_id", "n_bytes", "in_head", "parts", "numbers"])

    counted = rows.mapInArrow(summed, "doc_id long, n_bytes long, in_head long, parts array<string>, numbers array<long>")
    counted = materialise(counted.withColumn("row", F.monotonically_increasing_id()), "pre-token-sums")
    rare = counted.select("row", F.explode(F.arrays_zip("parts", "numbers")).alias("x")).select("row", F.col("x.parts").alias("part"), F.col("x.numbers").alias("times"))
    weighed = rare.join(known.where(~head).select("part", "pieces"), "part", "left").select("row", (F.col("times") * F.coalesce("pieces", F.raise_error(F.lit("a text changed between two reads")).cast("long"))).alias("tokens"))
    sums = weighed.groupBy("row").agg(F.sum("tokens").alias("beyond"))
    return counted.select("row", "doc_id", "n_bytes", "in_head").join(sums, "row", "left").select("doc_id", "n_bytes", (F.col("in_head") + F.coalesce("beyond", F.lit(0))).alias("n_tokens"))


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_tokens(table(spark, sf_dir, "documents")).withColumn("over_limit", F.col("n_tokens") > LIMIT)
