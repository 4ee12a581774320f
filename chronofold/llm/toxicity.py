"""Toxicity by nearest labelled examples: exact cosine of TF-IDF vectors over a block-max index.

Terms are lower-cased words and their leading characters (so that inflected forms
of a word meet): all that at least ``MIN_TEXTS`` texts of a bounded sample of
labelled texts hold, but those in over ``MAX_SHARE`` of the texts labelled 0, as
function words are.  Both labels' texts are examples and have vectors of the same
terms.  A term's weight is (1 + ln tf) x idf x rf, where rf, the relevance
frequency, is log2(2 + a / max(1, c)): a of the texts with the term are labelled
1 and c 0, in texts of like weight.  It makes telling words outweigh rare neutral
ones, which plain TF-IDF lets decide (README has figures).

The inverted index cuts each posting list into blocks of examples and keeps each
block's largest weight: their sum over a text's terms bounds every cosine in the
block, so blocks are scored in falling order of that bound until it lies below
the k-th best cosine found.  The result is the exact k nearest.  Examples with
equal vectors are one entry with their votes.  Cosine-weighted votes are
calibrated by isotonic regression, on the votes that entries get from the others
(of each label a bounded number, by the order of the sample).

Defined results: null and empty texts, and texts with no known term, get the
share of examples with no known term; ties in cosine go to the earlier entry; a
null or repeated doc_id is scored like any other, a null one is not held out, and
a label row with a null doc_id or null label teaches nothing; of clashing label
rows for one doc_id the largest label counts; other columns are ignored; an empty
table gives no rows; with no usable label every score is 0.  Whole texts are
scored.
"""

from __future__ import annotations

import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chronofold.cluster import ship

from ._common import bounded_sample, excerpt, materialise, released, table

#: Labelled texts that the index is fitted on, at most for each label, by the order of a hash.
SAMPLE_PER_LABEL = 2000
#: Characters learned from of a labelled text, at most; of longer texts in pieces spread over the text.
SAMPLE_CHARS = 20_000
#: Entries whose votes calibrate, at most for each label.
CALIBRATE_PER_LABEL = 500
#: Characters of a word that its leading parts have.
PREFIXES = (4, 5)
#: A term of the index is in this many sampled texts at least, and in this share of those labelled 0 at most.
MIN_TEXTS, MAX_SHARE = 3, 0.05
NEIGHBOURS = 15
BLOCK = 256
#: Words held by a worker's cache of their known terms.
CACHE_WORDS = 300_000

WORD = re.compile(r"[^\W\d_]+")


def terms_of(word: str) -> list[str]:
    return [word, *(f"{word[:n]}*" for n in PREFIXES if len(word) >= n)]


def terms_in(text: str) -> Counter:
    found: Counter = Counter()
    for word, n in Counter(WORD.findall(text.lower())).items():
        for t in terms_of(word):
            found[t] += n
    return found


class Model:
    """Vocabulary, entries and block-max postings, as arrays alone."""

    def __init__(self, texts: list[str], labels: list[int], k: int = NEIGHBOURS, label_weights: dict[int, float] | None = None):
        """``label_weights``: how many labelled texts each sampled one stands for, so that votes and scores are those of all."""
        self.k, self.known = k, {}
        weight_of = label_weights or {0: 1.0, 1: 1.0}
        # two passes over the texts: only counts of terms, then only bags of kept terms, are held
        self._learn_terms(texts, labels, weight_of)
        # equal vectors are one entry: (texts, texts with label 1)
        votes: dict[tuple, list[float]] = {}
        first: dict[tuple, int] = {}
        for i, (text, label) in enumerate(zip(texts, labels, strict=True)):
            bag = tuple(sorted((self.terms[t], n) for t, n in terms_in(text).items() if t in self.terms))
            v = votes.setdefault(bag, [0.0, 0.0])
            v[0] += weight_of[label]
            v[1] += weight_of[label] * label
            first.setdefault(bag, i)
        none = votes.pop((), [0.0, 0.0])
        vectors = {b: self.weights(dict(b)) for b in votes}
        # those with like heaviest terms share blocks
        entries = sorted(votes, key=lambda b: (int(vectors[b][0][np.argmax(vectors[b][1])]), first[b]))
        self.example = np.array([first[b] for b in entries], np.int64)
        self.votes = np.array([votes[b] for b in entries], np.float64).reshape(-1, 2)
        self._postings([vectors[b] for b in entries])
        everyone = sum(weight_of[x] for x in labels)
        self.prior = sum(weight_of[x] * x for x in labels) / everyone if everyone else 0.0
        self.none_score = float((none[1] + self.prior) / (none[0] + 1))
        self._calibrate(entries)

    def _learn_terms(self, texts: list[str], labels: list[int], weight_of: dict[int, float]) -> None:
        present, toxic = Counter(), Counter()
        for text, label in zip(texts, labels, strict=True):
            found = terms_in(text).keys()
            present.update(found)
            if label:
                toxic.update(found)
        # texts of label 0 in units of those of label 1
        one = weight_of.get(1, 1.0)
        ratio = weight_of.get(0, one) / one
        clean = len(labels) - sum(labels)
        total = sum(labels) + ratio * clean
        kept = sorted(t for t, n in present.items() if n >= MIN_TEXTS and n - toxic[t] <= MAX_SHARE * clean)
        self.terms = {t: i for i, t in enumerate(kept)}
        a = np.array([toxic[t] for t in kept], np.float64)
        c = ratio * (np.array([present[t] for t in kept], np.float64) - a)
        self.factor = (np.log((1 + total) / (1 + a + c)) + 1) * np.log2(2 + a / np.maximum(1, c))

    def weights(self, bag: dict[int, int]) -> tuple[np.ndarray, np.ndarray]:
        """Term numbers and unit-length weights."""
        at = np.fromiter(bag.keys(), np.int64, len(bag))
        w = (1 + np.log(np.fromiter(bag.values(), np.float64, len(bag)))) * self.factor[at]
        return at, w / (np.sqrt((w * w).sum()) or 1.0)

    def _postings(self, vectors: list) -> None:
        terms = np.concatenate([v[0] for v in vectors]) if vectors else np.zeros(0, np.int64)
        weight = np.concatenate([v[1] for v in vectors]) if vectors else np.zeros(0)
        entry = np.repeat(np.arange(len(vectors)), [len(v[0]) for v in vectors]) if vectors else np.zeros(0, np.int64)
        order = np.lexsort((entry, terms))
        self.p_entry, self.p_weight, terms = entry[order].astype(np.int32), weight[order], terms[order]
        self.blocks = max(1, -(-len(vectors) // BLOCK))
        # where each (term, block) begins in the postings, and its largest weight, rounded up to a float
        cell = terms * self.blocks + self.p_entry // BLOCK
        self.cell_from = np.searchsorted(cell, np.arange(len(self.terms) * self.blocks + 1)).astype(np.int32)
        most = np.zeros(len(self.terms) * self.blocks)
        np.maximum.at(most, cell, self.p_weight)
        self.block_max = np.nextafter(most.astype(np.float32), np.float32(2)).reshape(-1, self.blocks) * (most > 0).reshape(-1, self.blocks)

    def nearest(self, bag: dict[int, int], skip: int = -1) -> tuple[np.ndarray, np.ndarray]:
        """The k entries of largest cosine (exact), best first; ``skip`` leaves one entry out."""
        at, w = self.weights(bag)
        bound = w @ self.block_max[at] if len(at) else np.zeros(0)
        best_c, best_e = np.zeros(0), np.zeros(0, np.int64)
        base, order, done, step = at * self.blocks, np.argsort(-bound, kind="stable"), 0, 4
        while done < len(order):
            # the next blocks by bound, scored together; those that cannot hold a nearer entry are left out
            some = order[done : done + step]
            least = best_c[-1] - 1e-9 if len(best_c) >= self.k else 0.0
            some = some[(bound[some] > 0) & (bound[some] >= least)]
            if not len(some):
                break
            done, step = done + step, min(4 * step, 64)
            cells = (base[:, None] + some).ravel()
            low = self.cell_from[cells].astype(np.int64)
            sizes = self.cell_from[cells + 1] - low
            places = np.repeat(low - (np.cumsum(sizes) - sizes), sizes) + np.arange(sizes.sum())
            scores = np.bincount(self.p_entry[places], np.repeat(np.repeat(w, len(some)), sizes) * self.p_weight[places], len(self.votes))
            if skip >= 0:
                scores[skip] = 0
            found = np.flatnonzero(scores > 0)
            c, e = np.concatenate([best_c, scores[found]]), np.concatenate([best_e, found])
            if len(c) > 4 * self.k:  # only those that tie with or beat the k-th
                near = c >= np.partition(c, len(c) - self.k)[len(c) - self.k]
                c, e = c[near], e[near]
            keep = np.lexsort((e, -c))[: self.k]
            best_c, best_e = c[keep], e[keep]
        return best_c, best_e

    def vote(self, cosine: np.ndarray, entry: np.ndarray) -> float:
        """Cosine-weighted share of votes for label 1."""
        if not len(entry):
            return self.none_score
        votes = self.votes[entry]
        return float((cosine * votes[:, 1]).sum() / (cosine * votes[:, 0]).sum())

    def _calibrate(self, entries: list) -> None:
        """Isotonic steps from raw votes to shares, on votes that entries get from the others.

        What a label's judged entries stand for is raised to what all of it stand for.
        """
        toxic = self.votes[:, 1] > 0
        judged, worth = [], np.zeros(len(entries))
        for label in (False, True):
            own = np.flatnonzero(toxic == label)
            some = own[np.argsort(self.example[own], kind="stable")][:: max(1, -(-len(own) // CALIBRATE_PER_LABEL))]
            judged += some.tolist()
            worth[some] = len(own) / max(1, len(some))
        raw = {i: self.vote(*self.nearest(dict(entries[i]), skip=i)) for i in judged}
        steps: list[list[float]] = []  # least and largest raw vote, texts, texts with label 1
        for i in sorted(judged, key=raw.__getitem__):
            n, t = self.votes[i] * worth[i]
            if steps and raw[i] <= steps[-1][1] + 1e-9:  # equal votes are one step
                steps[-1] = [*steps[-1][:2], steps[-1][2] + n, steps[-1][3] + t]
            else:
                steps.append([raw[i], raw[i], n, t])
            while len(steps) > 1 and steps[-2][3] * steps[-1][2] >= steps[-1][3] * steps[-2][2]:
                top = steps.pop()
                steps[-1] = [steps[-1][0], top[1], steps[-1][2] + top[2], steps[-1][3] + top[3]]
        # a step is level, and between two steps the score rises evenly
        self.steps = np.array([b[:2] for b in steps]).ravel()
        self.shares = np.repeat([(b[3] + self.prior) / (b[2] + 1) for b in steps], 2)

    def bag(self, text: str) -> dict[int, int]:
        """Known terms of a whole text with their counts."""
        known, bag = self.known, {}
        for chunk, n in Counter(text.split()).items():
            found = known.get(chunk)
            if found is None:
                if len(known) >= CACHE_WORDS:
                    known.clear()
                found = known[chunk] = tuple(self.terms[t] for w in WORD.findall(chunk.lower()) for t in terms_of(w) if t in self.terms)
            for t in found:
                bag[t] = bag.get(t, 0) + n
        return bag

    def score(self, text: str) -> tuple[float, list[tuple[int, float]]]:
        """Score in 0..1 and the evidence: (example number, cosine) of the nearest."""
        bag = self.bag(text or "")
        if not bag or not len(self.votes):
            return self.none_score, []
        cosine, entry = self.nearest(bag)
        if not len(entry):
            return self.none_score, []
        score = float(np.interp(self.vote(cosine, entry), self.steps, self.shares))
        return score, list(zip(self.example[entry].tolist(), cosine.tolist(), strict=True))


def labelled_sample(docs: DataFrame, labels: DataFrame, may_learn, per_label: int = SAMPLE_PER_LABEL, chars: int = SAMPLE_CHARS) -> tuple[list[str], list[int], list[int], dict[int, float]]:
    """Texts, labels and doc_ids of a bounded, repeatable sample of labelled documents, and how many each one stands for by label."""
    own = labels.select(F.col("doc_id").cast("long").alias("l_id"), F.col("toxic").cast("int").alias("y")).where("l_id IS NOT NULL AND y IN (0, 1)").groupBy("l_id").agg(F.max("y").alias("label"))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").where(may_learn(F.col("doc_id")) & (F.length("text") > 0)).select("doc_id")
    labelled = materialise(rows.join(own, rows["doc_id"] == own["l_id"]).select("doc_id", "label"), "labelled")
    found, counts = bounded_sample(docs, labelled, per_label, lambda text: excerpt(text, chars))
    labels_found = [r["label"] for r in found]
    stands_for = {y: n / max(1, labels_found.count(y)) for y, n in counts.items()}
    return [r["text"] for r in found], labels_found, [r["doc_id"] for r in found], stands_for


def score_toxicity(docs: DataFrame, texts: list[str], labels: list[int], doc_ids: list[int], label_weights: dict[int, float] | None = None, k: int = NEIGHBOURS) -> DataFrame:
    """doc_id, score and evidence (doc_ids and cosines of all examples that voted, ``k`` at most) of each row of ``docs``."""
    model = Model(texts, labels, k, label_weights)
    held = ship(docs.sparkSession).sparkContext.broadcast(model)  # bounded by the sample
    ids = np.asarray(doc_ids, np.int64)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"))
    evidence = pa.list_(pa.struct([("doc_id", pa.int64()), ("cosine", pa.float64())]))

    def run(batches):
        model = held.value
        with released(model.known):
            for batch in batches:
                scores, why = [], []
                for text in batch.column("text"):
                    score, near = model.score(text.as_py())
                    scores.append(score)
                    why.append([{"doc_id": int(ids[i]), "cosine": c} for i, c in near])
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(scores, pa.float64()), pa.array(why, evidence)], names=["doc_id", "score", "evidence"])

    return rows.mapInArrow(run, "doc_id long, score double, evidence array<struct<doc_id: long, cosine: double>>")


def held_out(doc_id):
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(5)) == 0, F.lit(False))


def op9_toxicity_knn(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    sample = labelled_sample(docs, table(spark, sf_dir, "labels"), lambda c: ~held_out(c))
    out = score_toxicity(docs, *sample)
    score = F.round("score", 6)
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), score.alias("score"), (score >= 0.5).cast("int").alias("predicted"))
