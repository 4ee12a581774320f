"""SimHash near-duplicates through a Gray-order hierarchical index.

Fingerprints that differ in at most ``max_bits`` of 64 bits agree exactly in one
of ``max_bits + 1`` bands, so each distinct fingerprint is dealt once per band,
turned so that the band leads.  Within a task the turned fingerprints are sorted
by Gray rank, and neighbours in that order share leading bit patterns.  Upper
nodes hold the bits that all fingerprints below share (a mask and a pattern); a
pair of nodes is dropped whole as soon as the differences accumulated between
their shared patterns exceed ``max_bits``.  Pairs that lie in one component
already are dropped as well, and a task gives only the edges of a spanning
forest, so dense groups make no quadratic output.

A bucket (equal band) above ``bucket_rows`` is dealt anew by bands of the bits
not yet fixed: by the same argument no link is lost, and the sizes fall as more
bits are fixed.  Components come from distributed label propagation with
checkpoints; fingerprints and links are never collected.

Defined results: null and empty texts have no word and fingerprint zero, linked
like any other; null doc_ids get their fingerprint and the component of the
others, and take part in no minimum (a class of null doc_ids alone has a null
component_id); rows with equal doc_id each get a row; other columns are ignored;
an empty table gives no rows.
"""

from __future__ import annotations

from itertools import repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chronofold.cluster import ship

from ._common import materialise, table

SEED = 42
SHINGLE_WORDS = 3
MAX_BITS = 3
#: Fingerprints of one bucket that a task holds at once; larger buckets are dealt anew.
BUCKET_ROWS = 50_000
#: Shingles whose bits are counted at once.
BITS_AT_ONCE = 1 << 16
#: Bits fixed at the least once buckets are dealt anew no further.
DEEPEST_BITS = 48


def fingerprint(text: str | None, k: int = SHINGLE_WORDS, seed: int = SEED) -> int:
    """64 bits; bit i is set where over half of the shingles' XXH64 have it."""
    words = (text or "").encode().lower().split()  # bytes: A-Z and ASCII white space alone
    if not words:
        return 0
    if len(words) < k:
        shingles = [b" ".join(words)]
    else:
        shingles = map(b" ".join, zip(*(words[i:] for i in range(k)), strict=False))
    hashes = np.fromiter(map(xxhash.xxh64_intdigest, shingles, repeat(seed)), dtype="<u8")
    ones = np.zeros(64, np.int64)
    for at in range(0, len(hashes), BITS_AT_ONCE):
        part = hashes[at : at + BITS_AT_ONCE]
        ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, k: int = SHINGLE_WORDS, seed: int = SEED) -> DataFrame:
    """doc_id and fp (the 64 bits as a signed long)."""
    ship(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")

    def run(batches):
        for batch in batches:
            found = np.array([fingerprint(t.as_py(), k, seed) for t in batch.column("text")], dtype=np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(found.view(np.int64))], names=["doc_id", "fp"])

    return rows.mapInArrow(run, "doc_id long, fp long")


def gray_rank(x: np.ndarray) -> np.ndarray:
    """Position of each word in the reflected Gray sequence."""
    for shift in (1, 2, 4, 8, 16, 32):
        x = x ^ (x >> np.uint64(shift))
    return x


def _differences(a: np.ndarray) -> np.ndarray:
    return np.bitwise_count(a)


class Forest:
    """Union by smallest member over 0..n-1."""

    def __init__(self, n: int):
        self.parent = np.arange(n)

    def find(self, i: int) -> int:
        parent = self.parent
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    def labels(self) -> np.ndarray:
        while True:
            up = self.parent[self.parent]
            if np.array_equal(up, self.parent):
                return up
            self.parent = up

    def join(self, left: np.ndarray, right: np.ndarray) -> None:
        roots = self.labels()
        a, b = roots[left], roots[right]
        keep = a != b
        if keep.any():
            for x, y in np.unique(np.stack([a[keep], b[keep]], 1), axis=0).tolist():
                x, y = self.find(x), self.find(y)
                if x != y:
                    self.parent[max(x, y)] = min(x, y)


class GrayIndex:
    """The hierarchy over fingerprints sorted by Gray rank, ``fanout`` to a node."""

    def __init__(self, words: np.ndarray, fanout: int = 8, groups: np.ndarray | None = None):
        """``groups``: a number for each word; pairs are sought within equal numbers alone."""
        self.fanout = fanout
        order = np.argsort(gray_rank(words), kind="stable") if groups is None else np.lexsort((gray_rank(words), groups))
        self.order, self.words = order, words[order]
        # a level: (first child, end of children, mask of shared bits, their pattern)
        n = len(words)
        bounds = np.arange(n + 1)
        self.levels = [(bounds[:-1], bounds[1:], np.full(n, ~np.uint64(0)), self.words)]
        splits = np.array([0, n]) if groups is None else np.concatenate([np.flatnonzero(np.r_[True, groups[order][1:] != groups[order][:-1]]), [n]])
        while n and len(splits) - 1 < len(self.levels[-1][0]):
            _, _, mask, pattern = self.levels[-1]
            sizes = np.diff(splits)
            counts = -(-sizes // fanout)
            ends = np.concatenate([[0], np.cumsum(counts)])
            which = np.repeat(np.arange(len(sizes)), counts)
            start = splits[:-1][which] + (np.arange(ends[-1]) - ends[:-1][which]) * fanout
            stop = np.minimum(start + fanout, splits[1:][which])
            all_and, all_or = np.bitwise_and.reduceat(pattern & mask, start), np.bitwise_or.reduceat(pattern & mask, start)
            shared = np.bitwise_and.reduceat(mask, start) & ~(all_and ^ all_or)
            self.levels.append((start, stop, shared, all_and & shared))
            splits = ends

    def link(self, max_bits: int, pairs_at_once: int = 1 << 14) -> np.ndarray:
        """Component label (smallest sorted position) of each sorted word."""
        forest = Forest(len(self.words))
        if not len(self.words):
            return forest.parent
        tops = np.arange(len(self.levels[-1][0]))
        stack = [(len(self.levels) - 1, tops, tops)]
        spans = [np.arange(len(self.words))]
        lasts = [spans[0]]
        for start, stop, _, _ in self.levels[1:]:
            spans.append(spans[-1][start])
            lasts.append(lasts[-1][stop - 1])
        while stack:
            level, left, right = stack.pop()
            if len(left) > pairs_at_once:
                half = len(left) // 2
                stack += [(level, left[half:], right[half:]), (level, left[:half], right[:half])]
                continue
            start, stop, mask, pattern = self.levels[level]
            apart = _differences((pattern[left] ^ pattern[right]) & mask[left] & mask[right])
            near = apart <= max_bits
            left, right = left[near], right[near]
            if not len(left):
                continue
            if level == 0:
                forest.join(left, right)
                continue
            left, right = self._unjoined(forest, level, left, right, spans, lasts)
            if not len(left):
                continue
            # the children of both, all against all; in a node with itself, each pair once
            widths = (stop[left] - start[left]) * (stop[right] - start[right])
            of = np.repeat(np.arange(len(left)), widths)
            at = np.arange(len(of)) - np.repeat(np.cumsum(widths) - widths, widths)
            wide = (stop[right] - start[right])[of]
            a, b = start[left][of] + at // wide, start[right][of] + at % wide
            keep = a < b if level == 1 else a <= b
            a, b = a[keep], b[keep]
            near_first = np.argsort(b - a, kind="stable")  # neighbours join most, and spare the rest
            stack.append((level - 1, a[near_first], b[near_first]))
        return forest.labels()

    @staticmethod
    def _unjoined(forest, level, left, right, spans, lasts):
        """Without the pairs of nodes whose words all lie in one component already."""
        labels = forest.labels()
        change = np.concatenate([[0], np.cumsum(labels[1:] != labels[:-1])])
        first, last = spans[level], lasts[level]
        one = (change[first] == change[last])[left] & (change[first] == change[last])[right] & (labels[first[left]] == labels[first[right]])
        return left[~one], right[~one]


def _bands(fixed: int, max_bits: int) -> list[int]:
    """``max_bits + 1`` masks that share out the bits not yet fixed."""
    free = [i for i in range(63, -1, -1) if not fixed >> i & 1]
    cuts = [round(i * len(free) / (max_bits + 1)) for i in range(max_bits + 2)]
    return [sum(1 << b for b in free[a:z]) for a, z in zip(cuts, cuts[1:], strict=False)]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def links(distinct: DataFrame, max_bits: int = MAX_BITS, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """Edges (a, b) of a spanning forest of each bucket; ``distinct`` has one row per ``fp``."""

    def dealt(rows: DataFrame, fixed_masks: list[int]) -> DataFrame:
        """One row for each band of the bits that ``fixed`` leaves free."""
        options = F.array(*(F.struct(F.lit(_signed(m)).alias("was"), F.lit(_signed(m | band)).alias("fixed")) for m in fixed_masks for band in _bands(m, max_bits)))
        return rows.select("fp", F.explode(F.filter(options, lambda x: x["was"] == F.col("fixed"))).alias("x")).select("fp", F.col("x.fixed").alias("fixed"))

    rows = dealt(distinct.select("fp", F.lit(0).cast("long").alias("fixed")), [0])
    ready, masks = [], [0]
    while True:
        masks = [m | band for m in masks for band in _bands(m, max_bits)]
        rows = rows.withColumn("bucket", F.col("fp").bitwiseAND(F.col("fixed")))
        if min(m.bit_count() for m in masks) >= DEEPEST_BITS:
            ready.append(rows)
            break
        heavy = materialise(rows.groupBy(F.col("fixed").alias("h_fixed"), F.col("bucket").alias("h_bucket")).count().where(F.col("count") > bucket_rows).drop("count"), "heavy-buckets")
        if heavy.isEmpty():
            ready.append(rows)
            break
        on = (F.col("fixed") == F.col("h_fixed")) & (F.col("bucket") == F.col("h_bucket"))
        ready.append(rows.join(heavy, on, "left_anti"))
        rows = materialise(dealt(rows.join(heavy, on, "left_semi").select("fp", "fixed"), masks), "heavy-rows")
    every = ready[0]
    for more in ready[1:]:
        every = every.unionByName(more)
    dealt_rows = every.repartition("fixed", "bucket").sortWithinPartitions("fixed", "bucket")

    def run(batches):
        held: list[tuple] = []
        size = 0

        def edges(parts):
            fp, fixed, bucket = (np.concatenate([p[i] for p in parts]) for i in range(3))
            _, groups = np.unique(np.stack([fixed, bucket], 1), axis=0, return_inverse=True)
            index = GrayIndex(_turned(fp.view(np.uint64), fixed.view(np.uint64)), groups=groups.reshape(-1))
            label = index.link(max_bits)
            words = fp[index.order]
            linked = label != np.arange(len(label))
            return pa.RecordBatch.from_arrays([pa.array(words[linked]), pa.array(words[label[linked]])], names=["a", "b"])

        # whole buckets, several at a time
        for batch in batches:
            columns = tuple(batch.column(i).to_numpy(zero_copy_only=False) for i in range(3))
            if not len(columns[0]):
                continue
            new = np.flatnonzero((columns[1][1:] != columns[1][:-1]) | (columns[2][1:] != columns[2][:-1])) + 1
            starts = held and (held[-1][1][-1] != columns[1][0] or held[-1][2][-1] != columns[2][0])
            if starts and size >= bucket_rows:
                yield edges(held)
                held, size = [], 0
            if size + len(columns[0]) >= bucket_rows and len(new):
                cut = new[-1]
                yield edges([*held, tuple(c[:cut] for c in columns)])
                held, columns = [], tuple(c[cut:] for c in columns)
                size = 0
            held.append(columns)
            size += len(columns[0])
        if held:
            yield edges(held)

    return dealt_rows.mapInArrow(run, "a long, b long")


def _turned(fp: np.ndarray, fixed: np.ndarray) -> np.ndarray:
    """The bits of the fixed band lead: a turn that keeps all differences."""
    out = fp.copy()
    for mask in np.unique(fixed):
        own = fixed == mask
        low = int(mask) & -int(mask)
        turn = (64 - (low.bit_length() - 1 + int(mask).bit_count())) % 64
        if turn:
            out[own] = fp[own] << np.uint64(turn) | fp[own] >> np.uint64(64 - turn)
    return out


def components(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(node, component): the smallest node that each reaches, by alternating large and small stars.

    ``nodes`` has ``node``; ``edges`` has ``a`` and ``b``.  Each round halves the
    distance to the smallest node, about; a round's edges are checkpointed.
    """
    both = lambda e: e.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(e.select(F.col("b").alias("u"), F.col("a").alias("v")))
    edges = edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct().checkpoint()
    before = None
    while True:
        # large star: each neighbour above u is joined to the smallest node around u
        around = both(edges)
        # a table of its own, so that the join has plain shuffles on both sides and a hot u can be split
        lowest = around.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")).checkpoint()
        large = around.where("v > u").join(lowest, "u").select(F.col("v").alias("a"), F.col("m").alias("b")).distinct()
        # small star: each neighbour at or below u, and u, to the smallest of them
        lowest = large.groupBy("a").agg(F.min("b").alias("m"))
        edges = (
            large.join(lowest, "a")
            .select(F.explode(F.array(F.struct(F.col("a"), F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("e"))
            .select("e.a", "e.b").where("a <> b").distinct().checkpoint()
        )
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == before:
            break
        before = now
    return nodes.join(edges.select(F.col("a").alias("node"), F.col("b").alias("root")), "node", "left").select("node", F.coalesce("root", "node").alias("component"))


def near_duplicates(docs: DataFrame, k: int = SHINGLE_WORDS, seed: int = SEED, max_bits: int = MAX_BITS, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """doc_id, fp and component_id of each row of ``docs``."""
    found = materialise(fingerprints(docs, k, seed), "fingerprints")
    distinct = materialise(found.groupBy("fp").agg(F.min("doc_id").alias("first_doc")), "distinct-fingerprints")
    forest = links(distinct, max_bits, bucket_rows)
    linked = materialise(forest, "fingerprint-links")
    nodes = linked.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    roots = components(nodes, linked)
    # smallest doc_id over each component of linked fingerprints
    member = materialise(distinct.join(roots, distinct["fp"] == roots["node"], "inner").select("fp", "component", "first_doc"), "class-members")
    lowest = materialise(member.groupBy("component").agg(F.min("first_doc").alias("lowest")), "class-representatives")
    of_linked = member.join(lowest, "component").select(F.col("fp").alias("l_fp"), "lowest")
    of_fp = distinct.join(of_linked, distinct["fp"] == of_linked["l_fp"], "left").select(F.col("fp").alias("c_fp"), F.coalesce("lowest", "first_doc").alias("component_id"))
    of_fp = materialise(of_fp, "fingerprint-classes")  # both sides of the next join are then plain shuffles, whose hot keys can be split
    return found.join(of_fp, found["fp"] == of_fp["c_fp"], "left").select("doc_id", "fp", "component_id")


def one_of_each(docs: DataFrame, **how) -> DataFrame:
    """The rows of ``docs`` whose doc_id is the smallest of its near-duplicate class.

    Rows that share a doc_id are one document and share its fate; rows without doc_id stay.
    """
    keep = near_duplicates(docs, **how).where("doc_id = component_id").select(F.col("doc_id").alias("kept_id")).distinct()
    rows = docs.join(keep, docs["doc_id"] == keep["kept_id"], "left")
    return rows.where(keep["kept_id"].isNotNull() | docs["doc_id"].isNull()).select(*(docs[f"`{c}`"] for c in docs.columns))


def op6_simhash_gray(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents")).select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
