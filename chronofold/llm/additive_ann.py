"""Nearest neighbours by additive quantisation.

A vector's direction is the sum of one word from each of ``books`` full-dimensional
codebooks.  The books are fitted on a bounded sample (residual k-means, then one
joint least-squares step over beam-search codes); every row is then encoded by
beam search and stored as its codes and what they leave of its direction.

A query scores all codes by lookup tables of its inner products with the words; the
best ``shortlist`` are reranked exactly, in double precision, on the original vectors,
and their k-th score is a floor.  No candidate's score is further from its guess than
what its codes leave, times both lengths (Cauchy-Schwarz): whoever might reach the
floor is reranked too.  So the result is that of an exact search for any rows, those
that the codes hardly tell apart included; the codes decide only what is looked at.
Where they leave over ``DENSE`` of a block open, its inner products in double
precision, with their rounding bound, come between.

Blocks of candidates (codes and vectors) meet blocks of queries through an equi-join
on the pair of blocks; a pair's task answers with each query's ``k`` nearest of the
block, and the nearest of those are the result.  No task holds more than one block
pair, and nothing that grows with the data is broadcast.  Original vectors keep their
own type on the way.

Defined results: vectors that are null, empty, all zero, or hold null or
non-finite components take no part, nor do rows with null vec_id or of another
length than most; rows with equal vec_id are separate candidates; ties go to the
smaller vec_id; fewer candidates than ``k`` are all given; other columns are
ignored; an empty table gives no rows.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ._common import materialise, table

#: Vectors that the codebooks are fitted on, at most, by the order of a hash.
SAMPLE_ROWS = 8192
BOOKS, WORDS, BEAM = 40, 32, 4
#: Candidates of each query that set its floor, at least; and the table's rows and k for which they are nearly always enough.
SHORTLIST, SUFFICES_AT, SUFFICES_FOR = 300, 50_000, 20
#: Rows of a block at most, and bytes of its vectors in double precision.
CANDIDATE_BLOCK, QUERY_BLOCK, BLOCK_BYTES = 65_536, 16_384, 32 << 20
#: Pairs of blocks that keep a cluster busy, and the rows for which it is worth cutting a smaller block.
LEAST_PAIRS, LEAST_CANDIDATES, LEAST_QUERIES = 24, 8192, 32
#: Share of a block left open by the codes from which a product of all its vectors is cheaper than pairs one by one.
DENSE = 1 / 24
#: Queries, and pairs, that are looked at together.
STEP, PAIRS = 16, 1 << 18


def shortlist_for(candidates: int, k: int) -> int:
    """Candidates to rerank first among so many.

    Scores thin out like a normal distribution's tail, in which the k-th of n lies
    about sqrt(2 ln(n / k)) deviations out; the candidates within the codes' error
    below it, over k, grow as a power that is in proportion to that.
    """
    deep = math.sqrt(math.log(max(candidates / k, 2)) / math.log(SUFFICES_AT / SUFFICES_FOR))
    return max(SHORTLIST, math.ceil(k * (SHORTLIST / SUFFICES_FOR) ** deep))


class Quantiser:
    """``books`` codebooks of ``words`` vectors each."""

    def __init__(self, books: np.ndarray):
        self.books = books.astype(np.float32)
        self.norms = (self.books**2).sum(axis=2)

    @classmethod
    def fit(cls, sample: np.ndarray, books: int = BOOKS, words: int = WORDS, rounds: int = 5, beam: int = BEAM, seed: int = 3) -> Quantiser:
        rng = np.random.default_rng(seed)
        sample = sample.astype(np.float32)
        words = min(words, len(sample))
        rest, out = sample.copy(), []
        for _ in range(books):
            book = rest[rng.choice(len(rest), words, replace=False)].copy()
            for _ in range(rounds):
                near = cls._nearest(rest, book)
                total = np.stack([np.bincount(near, rest[:, d], words) for d in range(rest.shape[1])], 1)
                count = np.bincount(near, minlength=words)
                book = np.where(count[:, None] > 0, total / np.maximum(count, 1)[:, None], book).astype(np.float32)
            rest = rest - book[cls._nearest(rest, book)]
            out.append(book)
        found = cls(np.stack(out))
        if len(sample) >= books * words // 2:  # enough to refit all words at once
            found = found._refit(sample, found.encode(sample, beam))
        return found

    @staticmethod
    def _nearest(x: np.ndarray, book: np.ndarray) -> np.ndarray:
        return np.argmin((book**2).sum(axis=1) - 2 * (x @ book.T), axis=1)

    def _refit(self, sample: np.ndarray, codes: np.ndarray, ridge: float = 1.0) -> Quantiser:
        """Least squares over all words jointly, given the codes, held near the words as they are."""
        books, words, dims = self.books.shape
        at = codes.astype(np.int64) + np.arange(books) * words
        gram = np.zeros((books * words, books * words), np.float32)
        for m in range(books):
            for k in range(books):
                np.add.at(gram, (at[:, m], at[:, k]), 1)
        gap = sample - self.decode(codes)
        right = np.zeros((books * words, dims), np.float32)
        for m in range(books):
            np.add.at(right, at[:, m], gap)
        gram[np.arange(len(gram)), np.arange(len(gram))] += ridge
        return Quantiser(self.books + np.linalg.solve(gram, right).reshape(self.books.shape))

    def encode(self, x: np.ndarray, beam: int = BEAM) -> np.ndarray:
        """Codes (rows, books) by beam search over the residuals."""
        x = np.asarray(x, np.float32)
        books, words, _ = self.books.shape
        out = np.zeros((len(x), books), np.uint8 if words <= 256 else np.uint16)
        for a in range(0, len(x), 1024):
            part = x[a : a + 1024]
            n = len(part)
            rest, paths, error = part[:, None, :], np.zeros((n, 1, 0), np.int64), (part**2).sum(axis=1)[:, None]
            for m in range(books):
                score = error[:, :, None] + self.norms[m] - 2 * (rest @ self.books[m].T)
                flat = score.reshape(n, -1)
                keep = min(beam, flat.shape[1])
                best = np.argpartition(flat, keep - 1, axis=1)[:, :keep]
                error = np.take_along_axis(flat, best, axis=1)
                of, word = best // words, best % words
                rest = np.take_along_axis(rest, of[:, :, None], axis=1) - self.books[m][word]
                paths = np.concatenate([np.take_along_axis(paths, of[:, :, None], axis=1), word[:, :, None]], axis=2)
            out[a : a + n] = paths[np.arange(n), np.argmin(error, axis=1)]
        return out

    def decode(self, codes: np.ndarray) -> np.ndarray:
        out = np.zeros((len(codes), self.books.shape[2]), np.float32)
        for m, book in enumerate(self.books):
            out += book[codes[:, m]]
        return out

    def tables(self, queries: np.ndarray) -> np.ndarray:
        """(books, queries, words) inner products."""
        return np.stack([queries.astype(np.float32) @ b.T for b in self.books])

    def guess(self, directions: np.ndarray, codes: np.ndarray) -> np.ndarray:
        """(queries, rows) inner products of directions with approximations; ``codes`` is (books, rows)."""
        found = np.zeros((len(directions), codes.shape[1]), np.float32)
        for table, places in zip(self.tables(directions), codes):
            found += table.take(places, axis=1)
        return found

    def rounding(self) -> float:
        """What single precision adds to the error of a guess for a direction, at most."""
        books, _, dims = self.books.shape
        return 4 * (books + dims) * float(np.finfo(np.float32).eps) * float(np.sqrt(self.norms.max(axis=1)).sum())


def directions(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Unit vectors and lengths; no square leaves the range of numbers."""
    top = np.abs(x).max(axis=1, keepdims=True)
    x = x / top
    length = np.sqrt((x * x).sum(axis=1, keepdims=True))
    return x / length, (top * length)[:, 0]


class Nearest:
    """The ``k`` candidates of a block that are nearest to each query of another."""

    def __init__(self, model: Quantiser, metric: str, k: int, shortlist: int):
        self.model, self.metric, self.k, self.shortlist = model, metric, k, shortlist

    def line(self, asked: np.ndarray, lengths: np.ndarray):
        """(scale, shift): a score is scale x (inner product of directions) + shift; the shift rounded up."""
        if self.metric == "cosine":
            return np.float64(1), np.float64(0)
        both = asked[:, None] * lengths[None, :]
        if self.metric == "ip":
            return both, np.float64(0)
        return 2 * both, -(asked[:, None] ** 2 + lengths[None, :] ** 2) * (1 - self.fine)

    def exact(self, who: np.ndarray, what: np.ndarray) -> np.ndarray:
        """Scores of pairs, summed dimension by dimension: equal vectors score equally wherever they stand."""
        out = np.empty(len(who))
        for a in range(0, len(who), PAIRS):
            i, j = who[a : a + PAIRS], what[a : a + PAIRS]
            total = np.zeros(len(i))
            for q, x in zip(self.q, self.x):
                left, right = q[i], x[j]
                total += (left - right) ** 2 if self.metric == "l2" else left * right
            if self.metric == "cosine":
                total /= np.sqrt(self.qq[i] * self.xx[j])
            out[a : a + PAIRS] = -total if self.metric == "l2" else total
        return out

    @staticmethod
    def below(most: np.ndarray, floor: np.ndarray) -> np.ndarray:
        """Surely below the floor; what left the range of numbers is not."""
        return (most + 1e-300 < floor[:, None]) & (most > -np.inf)

    def __call__(self, asked, queries, rows, vec_ids, vectors, codes, left):
        """(query positions, candidate positions, scores) of some queries at a time; ``asked`` and ``rows`` tell a query's own row."""
        queries, vectors = queries.astype(np.float64), vectors.astype(np.float64)
        (uq, lq), (ux, lx) = directions(queries), directions(vectors)
        self.q, self.x = np.ascontiguousarray(queries.T), np.ascontiguousarray(vectors.T)
        self.qq, self.xx = (sum(t * t for t in side) for side in (self.q, self.x))
        self.fine = 4 * (len(self.x) + 8) * np.finfo(np.float64).eps
        codes, left = np.ascontiguousarray(codes.T), left + self.model.rounding()
        first = min(self.shortlist, len(rows))
        for a in range(0, len(asked), STEP):
            part = slice(a, a + STEP)
            own = asked[part, None] == rows[None, :]
            scale, shift = self.line(lq[part], lx)
            guess = self.model.guess(uq[part], codes)
            order = -(scale * guess + shift)
            order[own] = np.inf
            near = np.argpartition(order, first - 1, axis=1)[:, :first]
            who, what = np.repeat(np.arange(len(near)), first), near.ravel()
            score = self.exact(a + who, what)
            floor = np.full(len(near), -np.inf)
            if first >= self.k:
                floor = np.partition(np.where(own[who, what], -np.inf, score).reshape(near.shape), first - self.k, axis=1)[:, first - self.k]
            if first < len(rows):
                maybe = ~self.below(scale * (guess + left) + shift, floor) & ~own
                maybe[who, what] = False
                if maybe.mean() > DENSE:
                    maybe &= ~self.below(scale * (uq[part] @ ux.T + self.fine) + shift, floor)
                others = np.nonzero(maybe)
                who, what, score = (np.concatenate(x) for x in ((who, others[0]), (what, others[1]), (score, self.exact(a + others[0], others[1]))))
            kept = ~(score < floor[who]) & ~own[who, what]
            who, what, score = who[kept], what[kept], score[kept]
            order = np.lexsort((rows[what], vec_ids[what], np.where(np.isnan(score), -np.inf, -score), who))
            who, what, score = who[order], what[order], score[order]
            kept = np.arange(len(who)) - np.searchsorted(who, who) < self.k
            yield a + who[kept], what[kept], score[kept]


def usable(rows: DataFrame) -> DataFrame:
    """row, vec_id and embedding (array of float) of the vectors that take part."""
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    own = rows.schema["embedding"].dataType.elementType.simpleString()
    found = rows.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<float>" if own == "float" else "array<double>").alias("embedding")).where(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & F.forall("embedding", finite) & F.exists("embedding", lambda x: x != 0))
    most = found.groupBy(F.size("embedding").alias("n")).count().orderBy(F.desc("count"), F.desc("n")).first()
    if most is None:
        return found.withColumn("row", F.lit(0).cast("long"))
    return materialise(found.where(F.size("embedding") == most["n"]).withColumn("row", F.monotonically_increasing_id()), "vectors")


def _matrix(column) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1) if len(column) else flat.reshape(0, 1)


def _packed(rows: DataFrame, name: str, blocks: int, schema: str, pack) -> DataFrame:
    """Rows dealt evenly to ``blocks`` partitions, one packed row each, numbered by partition; written once."""

    def run(batches):
        from pyspark import TaskContext

        held = [b for b in batches if b.num_rows]
        if held:
            yield pa.RecordBatch.from_pylist([{name: TaskContext.get().partitionId(), **pack(pa.Table.from_batches(held))}])

    return materialise(rows.repartition(blocks).mapInArrow(run, f"{name} long, {schema}"), name)


def search(vectors: DataFrame, is_query, k: int = 20, shortlist: int | None = None, metric: str = "ip") -> DataFrame:
    """query_id, rank, vec_id and score of the ``k`` nearest for each row that ``is_query`` (a test of vec_id) picks.

    ``shortlist``: candidates of a block that set a query's floor; it changes the cost, not the result.
    ``metric``: "ip" (largest inner product), "l2" (score: negative squared distance) or "cosine".
    """
    rows = usable(vectors)
    spark = rows.sparkSession
    schema = "query_id long, rank int, vec_id long, score double"
    total = rows.count()
    if not total:
        return spark.createDataFrame([], schema)
    queries = rows.where(is_query(F.col("vec_id")))
    asked = queries.count()
    if not asked:
        return spark.createDataFrame([], schema)
    shortlist = shortlist or shortlist_for(total, k)
    sample = rows.select("embedding", F.xxhash64("vec_id", "row").alias("h"), "row").orderBy("h", "row").limit(SAMPLE_ROWS).select("embedding").toArrow()
    sample = _matrix(sample.column(0).combine_chunks()).astype(np.float64)
    model = Quantiser.fit(directions(sample)[0])
    held = spark.sparkContext.broadcast(model)  # books x words vectors, whatever the data
    real = np.float32 if rows.schema["embedding"].dataType.elementType.simpleString() == "float" else np.float64
    kind = np.uint8 if model.books.shape[1] <= 256 else np.uint16

    most = max(1, BLOCK_BYTES // (8 * sample.shape[1]))
    candidate_blocks = max(-(-total // min(CANDIDATE_BLOCK, most)), min(LEAST_PAIRS, -(-total // LEAST_CANDIDATES)))
    query_blocks = max(-(-asked // min(QUERY_BLOCK, most)), min(-(-LEAST_PAIRS // candidate_blocks), -(-asked // LEAST_QUERIES)))

    def pack(t):
        x = _matrix(t.column("embedding").combine_chunks())
        return x, {"rows": t.column("row").to_numpy().tobytes(), "ids": t.column("vec_id").to_numpy().tobytes(), "vectors": x.tobytes()}

    def pack_codes(t):
        x, found = pack(t)
        model, x = held.value, directions(x.astype(np.float64))[0]
        codes = model.encode(x)
        left = np.concatenate([np.sqrt(((x[a : a + 1024] - model.decode(codes[a : a + 1024])) ** 2).sum(axis=1)) for a in range(0, len(x), 1024)])
        return {**found, "codes": codes.tobytes(), "rest": left.tobytes()}

    def pack_queries(t):
        return {f"asked_{name}": value for name, value in pack(t)[1].items()}

    blocks = _packed(rows.select("row", "vec_id", "embedding"), "candidate_block", candidate_blocks, "rows binary, ids binary, vectors binary, codes binary, rest binary", pack_codes)
    asking = _packed(queries.select("row", "vec_id", "embedding"), "query_block", query_blocks, "asked_rows binary, asked_ids binary, asked_vectors binary", pack_queries)
    # each candidate block meets each query block: an equi-join on the pair's number
    every = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long")))
    number = (F.col("query_block") * candidate_blocks + F.col("candidate_block")).alias("pair")
    pairs = candidate_blocks * query_blocks
    sides = [
        blocks.withColumn("query_block", every(query_blocks)).select(number, *blocks.columns[1:]),
        asking.withColumn("candidate_block", every(candidate_blocks)).select(number, *asking.columns[1:]),
    ]
    met = sides[0].repartition(pairs, "pair").join(sides[1].repartition(pairs, "pair"), "pair").drop("pair")

    def score(batches):
        nearest = Nearest(held.value, metric, k, shortlist)
        for batch in batches:
            for i in range(batch.num_rows):
                read = lambda n, of=np.int64, i=i, batch=batch: np.frombuffer(batch.column(n)[i].as_buffer(), of)
                asked, asked_ids, rows, ids = read("asked_rows"), read("asked_ids"), read("rows"), read("ids")
                wide = lambda n, of, many: read(n, of).reshape(len(many), -1)
                for who, what, s in nearest(asked, wide("asked_vectors", real, asked), rows, ids, wide("vectors", real, rows), wide("codes", kind, rows), read("rest", np.float64)):
                    yield pa.RecordBatch.from_arrays([pa.array(x) for x in (asked[who], asked_ids[who], rows[what], ids[what], s)], names=["asked_row", "query_id", "near_row", "vec_id", "score"])

    found = materialise(met.mapInArrow(score, "asked_row long, query_id long, near_row long, vec_id long, score double"), "nearest")
    order = Window.partitionBy("asked_row").orderBy(F.desc("score"), "vec_id", "near_row")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op4_additive_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(table(spark, sf_dir, "embeddings"), lambda c: c % 20 == 0, k=20)
