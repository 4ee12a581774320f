"""Language identification by a linear-chain conditional random field.

Each word of a text gets a label; its features are the word itself (lexicon),
its leading and trailing letters (affixes) and its letter n-grams, and learned
transitions tie neighbouring words.  Forward-backward gives each word's
posterior, also where a text switches language; a document's language has the
largest mean posterior over its words, which is the score.

The field has every label of the rows that it may learn from (the driver holds
them, and a model that grows with their number) and is fitted on a bounded sample
of labelled documents of any length, long ones by excerpts.  Their runs of words are spliced across languages, so that the transitions learn how rarely a
text switches.  Prediction covers every word of every text as one chain: its
consecutive windows of ``WINDOW`` words are worked out side by side, and those
whose messages from the windows beside them then turn out otherwise are worked
out again, until none do, so the posteriors are those of the uncut chain.

Posteriors only compare the languages learned.  Whether a text is in any of them
is judged by familiarity: the share of a word's features that the word's own
language showed at least twice in the sample, averaged over the text.  A language
expects what its sampled documents reach when half of them judge the other half;
a text with less than ``FAMILIAR`` of that is in none.  The number of languages
plays no part.  A language with under ``CALIBRATION_DOCS`` sampled documents
expects nothing: it is too little known to turn texts away.

Defined results: ``und`` with score 0 where the text is null or has no letter,
or where nothing could be learned; ties go to the label that sorts first; null
or repeated doc_ids are labelled like any other; a null doc_id is not held out and
teaches nothing, as does a row with null lang; a word of any length counts with
all its features; other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

from collections import Counter
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chronofold.cluster import ship

from ._common import bounded_sample, excerpt, materialise, released, table, text_blocks

#: Labelled documents learned from, at most for each language.
SAMPLE_PER_LANGUAGE = 150
#: Characters learned from of each, at most; of longer texts in pieces spread over the text.
SAMPLE_CHARS = 4000
#: Words of a window; words beside a window that its first messages come from; largest change of a message that is let be.
WINDOW, LEAD, SAME = 64, 16, 1e-11
UNDEFINED = "und"
#: Share of a language's expected familiarity, at least, for a text to be in it.
FAMILIAR = 0.5
#: Sampled documents of a language, at least, for it to expect any.
CALIBRATION_DOCS = 10
#: Words held by a worker's cache of emission scores, with up to 16 labels; fewer with more.
CACHE_WORDS = 250_000
#: Words fitted on, at most, for each language: every sampled document gives the same number, or all it has.
TRAIN_WORDS_PER_LANGUAGE = 15_000
#: Numbers (steps x sequences x labels) in an array of fitting or prediction, about: more go in parts.
FIT_CELLS, PREDICT_CELLS = 4_000_000, 64 * 2048 * 64


def features(word: str) -> list[str]:
    """Lexicon, affix and n-gram features of a lower-cased word."""
    marked = f"<{word}>"
    found = [marked, "^" + word[:2], "^" + word[:3], "^" + word[:4], word[-2:] + "$", word[-3:] + "$", word[-4:] + "$"]
    found += [marked[i : i + 3] for i in range(len(word))]
    return found


def letters_of(chunk: str) -> str:
    """Its letters (Unicode categories L*) in lower case."""
    return chunk.lower() if chunk.isalpha() else "".join(filter(str.isalpha, chunk.lower()))


def posteriors(emission: np.ndarray, lengths: np.ndarray, start: np.ndarray, move: np.ndarray, learning: bool = False, after: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Forward-backward over padded sequences.

    ``emission`` is (steps, sequences, labels), exponentiated; ``start`` (for all
    or for each sequence) and ``move`` likewise; ``after`` is the message from
    what follows each sequence, all of full length then.  Returns posteriors
    (zero past a sequence's end), the expected moves where ``learning``, and the
    messages to what follows a full sequence and to what goes before each.
    """
    steps, n, labels = emission.shape
    forward, scale = np.empty_like(emission), np.empty((steps, n, 1))
    full = bool((lengths == steps).all())
    now = start * emission[0]
    for t in range(steps):
        if t:
            now = (forward[t - 1] @ move) * emission[t]
        scale[t] = now.sum(axis=1, keepdims=True)
        np.divide(now, scale[t], out=forward[t])
    onward = forward[-1] @ move
    moves, back = np.zeros((labels, labels)), np.ones((n, labels))
    if after is not None:
        back = after / (forward[-1] * after).sum(axis=1, keepdims=True)
    for t in range(steps - 1, -1, -1):
        if t + 1 < steps:
            ahead = back * emission[t + 1] / scale[t + 1]
            if learning:
                moves += (forward[t].T @ np.where((lengths > t + 1)[:, None], ahead, 0.0)) * move
            back = ahead @ move.T
        if not full:
            back[lengths <= t + 1] = 1.0  # a sequence ends here, or did before
        forward[t] *= back  # its last use as such was above
        if not full:
            forward[t][lengths <= t] = 0.0
    return forward, moves, onward, (back * emission[0]) @ move.T


def _unit(message: np.ndarray) -> np.ndarray:
    return message / message.sum(axis=1, keepdims=True)


def equal_shares(sizes: list[int], total: int) -> list[int]:
    """How much of each size to take: one number for all, or the whole size; ``total`` at most, and all of it if there is as much."""
    out, left = [0] * len(sizes), total
    for rank, i in enumerate(sorted(range(len(sizes)), key=sizes.__getitem__)):
        out[i] = min(sizes[i], left // (len(sizes) - rank))
        left -= out[i]
    return out


def spread(words: list[str], n: int, runs: int = 4) -> list[str]:
    """``n`` of the words, in runs spread evenly from begin to end."""
    if n >= len(words):
        return words
    runs = max(1, min(runs, n // 8))  # a run has words enough to teach transitions
    sizes = [n // runs + (i < n % runs) for i in range(runs)]
    gap, out, at = len(words) - n, [], 0
    for i, size in enumerate(sizes):
        begin = at + (gap * i // (runs - 1) if runs > 1 else 0)
        out += words[begin : begin + size]
        at += size
    return out


class Field:
    """Labels, feature weights, start weights and transitions."""

    def __init__(self, labels: list[str]):
        self.labels = labels
        self.numbers: dict[str, int] = {}
        self.weights = np.zeros((0, len(labels)))
        self.start = np.zeros(len(labels))
        self.move = np.zeros((len(labels), len(labels)))
        self.seen: dict[str, int] = {}  # feature -> row of ``seen_in``
        self.seen_in = np.zeros((1, len(labels)), np.float32)  # 1 where a label showed it; the last row stays zero
        self.expected = np.zeros(len(labels))
        self.rows: Rows | None = None

    def fit(self, texts: list[str], langs: list[str], rounds: int = 40, rate: float = 0.25, l2: float = 0.5, seed: int = 7) -> Field:
        rng = np.random.default_rng(seed)
        runs: dict[int, list[str]] = {i: [] for i in range(len(self.labels))}
        taken: dict[int, list[list[str]]] = {i: [] for i in runs}
        for text, lang in zip(texts, langs, strict=True):
            taken[self.labels.index(lang)].append([w for w in map(letters_of, text.split()) if w])
        for c, docs in taken.items():
            shares = equal_shares([len(d) for d in docs], TRAIN_WORDS_PER_LANGUAGE)
            taken[c] = [spread(d, n) for d, n in zip(docs, shares, strict=True)]
            runs[c] = list(chain.from_iterable(taken[c]))
        self._know(taken)
        words, tags = self._spliced(runs, rng)
        if not len(words):
            return self
        distinct = sorted({w for s in words for w in s})
        number = {w: i for i, w in enumerate(distinct)}
        bags = [features(w) for w in distinct]
        seen: dict[str, int] = {}
        for bag in bags:
            for f in bag:
                seen[f] = seen.get(f, 0) + 1
        self.numbers = {f: i for i, f in enumerate(sorted(f for f, n in seen.items() if n > 1))}
        own = [[self.numbers[f] for f in bag if f in self.numbers] for bag in bags]
        own = [x or [len(self.numbers)] for x in own]  # a word without a known feature: the row that stays zero
        at, ends = np.concatenate([np.asarray(x, np.int64) for x in own]), np.cumsum([len(x) for x in own])
        of = np.repeat(np.arange(len(own)), [len(x) for x in own])
        begins = np.r_[0, ends[:-1]]
        steps, count = max(map(len, words)), len(self.labels)
        lengths = np.array([len(s) for s in words])
        padded = np.zeros((steps, len(words)), np.int64)
        true_by_word, true_moves, true_start = np.zeros((len(own), count)), np.zeros((count, count)), np.zeros(count)
        for i, (s, t) in enumerate(zip(words, tags, strict=True)):
            padded[: len(s), i] = [number[w] for w in s]
            np.add.at(true_by_word, (padded[: len(s), i], t), 1)
            np.add.at(true_moves, (t[:-1], t[1:]), 1)
            true_start[t[0]] += 1
        at_once = max(1, FIT_CELLS // (steps * count))
        self.weights = np.zeros((len(self.numbers) + 1, count))
        params, memory = [self.weights, self.start, self.move], [np.full(p.shape, 1e-8) for p in (self.weights, self.start, self.move)]
        for _ in range(rounds):
            scores = np.add.reduceat(self.weights[at], begins, axis=0)
            emission = np.exp(scores - scores.max(axis=1, keepdims=True))
            by_word, moves, first = true_by_word.copy(), np.zeros((count, count)), np.zeros(count)
            for a in range(0, len(words), at_once):
                some = padded[:, a : a + at_once]
                found, part, _, _ = posteriors(emission[some], lengths[a : a + at_once], np.exp(self.start), np.exp(self.move), learning=True)
                moves += part
                first += found[0].sum(axis=0)
                for c in range(count):
                    by_word[:, c] -= np.bincount(some.reshape(-1), found[:, :, c].reshape(-1), len(own))
            slope = np.stack([np.bincount(at, by_word[of, c], len(self.numbers) + 1) for c in range(count)], 1)
            slope[-1] = 0
            slopes = [slope - l2 * self.weights, true_start - first - l2 * self.start, true_moves - moves - l2 * self.move]
            for p, g, m in zip(params, slopes, memory, strict=True):
                m += g * g
                p += rate * g / np.sqrt(m)
        return self

    def _know(self, taken: dict[int, list[list[str]]]) -> None:
        """Features that each label showed at least twice, and the familiarity it expects of a text."""

        def shown(docs: list[list[str]]) -> set[str]:
            counts: Counter = Counter()
            for w, n in Counter(chain.from_iterable(docs)).items():
                for f in set(features(w)):
                    counts[f] += n
            return {f for f, n in counts.items() if n > 1}

        by_label = {c: shown(docs) for c, docs in taken.items()}
        self.seen = {f: i for i, f in enumerate(sorted(set().union(*by_label.values())))}
        self.seen_in = np.zeros((len(self.seen) + 1, len(self.labels)), np.float32)
        for c, found in by_label.items():
            self.seen_in[[self.seen[f] for f in found], c] = 1
            docs = [d for d in taken[c] if d]
            if len(docs) < CALIBRATION_DOCS:
                continue
            reached = []
            for judges, judged in ((docs[::2], docs[1::2]), (docs[1::2], docs[::2])):
                own = shown(judges)
                rate = {w: np.mean([f in own for f in features(w)]) for w in set(chain.from_iterable(judged))}
                reached += [np.mean([rate[w] for w in d]) for d in judged]
            self.expected[c] = np.mean(reached)

    def rates(self, words: list[str]) -> np.ndarray:
        """Share of each word's features that each label showed."""
        get, none = self.seen.get, len(self.seen)
        sizes = np.fromiter((len(w) + 7 for w in words), np.int64, len(words))
        at = np.fromiter((get(f, none) for w in words for f in features(w)), np.int64, int(sizes.sum()))
        return np.add.reduceat(self.seen_in[at], np.cumsum(sizes) - sizes, axis=0) / sizes[:, None]

    @staticmethod
    def _spliced(runs: dict[int, list[str]], rng) -> tuple[list[list[str]], list[np.ndarray]]:
        """Sequences of about 30 words; one in three goes on in another language midway."""
        places, words, tags = dict.fromkeys(runs, 0), [], []
        have = [c for c, r in runs.items() if r]
        while any(places[c] < len(runs[c]) for c in have):
            left = [c for c in have if places[c] < len(runs[c])]
            s, t, parts = [], [], 2 if len(have) > 1 and rng.random() < 1 / 3 else 1
            for _ in range(parts):
                c = left[rng.integers(len(left))]
                n = int(rng.integers(8, 31))
                part = runs[c][places[c] : places[c] + n]
                places[c] += n
                s += part
                t += [c] * len(part)
            if s:
                words.append(s)
                tags.append(np.asarray(t))
        return words, tags

    def emissions(self, words: list[str]) -> np.ndarray:
        """Exponentiated scores of words, the largest of each 1; all 1 where no feature is known."""
        if not len(self.weights):
            return np.ones((len(words), len(self.labels)))
        get, none = self.numbers.get, len(self.numbers)
        own = [[i for f in features(w) if (i := get(f)) is not None] or [none] for w in words]
        sizes = np.fromiter(map(len, own), np.int64, len(own))
        at = np.fromiter(chain.from_iterable(own), np.int64, int(sizes.sum()))
        score = np.add.reduceat(self.weights[at], np.cumsum(sizes) - sizes, axis=0)
        return np.exp(score - score.max(axis=1, keepdims=True))

    def clear(self) -> None:
        """Forget cached words."""
        self.rows = None

    def predict(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Sum of posteriors by label, and number of words with a letter, for each text."""
        return self._predict(texts, False)[:2]

    def known(self, texts: list[str], familiar: float = FAMILIAR) -> np.ndarray:
        """Whether each text has words in a learned language, with ``familiar`` of the expected familiarity at least."""
        sums, counts, rates = self._predict(texts, True)
        return (counts > 0) & (rates >= familiar * (sums @ self.expected))

    def _predict(self, texts: list[str], rated: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """What ``predict`` gives and, where ``rated``, the sum of words' familiarity in their languages."""
        sums, counts, rates = np.zeros((len(texts), len(self.labels))), np.zeros(len(texts), np.int64), np.zeros(len(texts))
        if self.rows is None or rated and self.rows.rates is None:
            self.rows = Rows(self, rated)
        for first, last in text_blocks(texts):
            rows = self.rows.fresh()
            chunks = [t.split() for t in texts[first:last]]
            rows.add(set(chain.from_iterable(chunks)))
            numbers = [np.fromiter(map(rows.__getitem__, x), np.int64, len(x)) for x in chunks]
            numbers = [x[x > 0] for x in numbers]  # 0: no letter
            counts[first:last] = [len(x) for x in numbers]
            if not counts[first:last].any():
                continue
            words = np.concatenate(numbers)
            windows = -(-counts[first:last] // WINDOW)
            of = np.repeat(np.arange(first, last), windows)  # the text of each window
            base = np.cumsum(counts[first:last]) - counts[first:last]
            inside = (np.arange(len(of)) - np.repeat(np.cumsum(windows) - windows, windows)) * WINDOW
            begin = np.repeat(base, windows) + inside
            lengths = np.minimum(WINDOW, np.repeat(counts[first:last], windows) - inside)
            found, rated_by = self._chains(words, begin, lengths, np.flatnonzero(inside > 0), rated)
            np.add.at(sums, of, found)
            np.add.at(rates, of, rated_by)
        return sums, counts, rates

    def _chains(self, words: np.ndarray, begin: np.ndarray, lengths: np.ndarray, later: np.ndarray, rated: bool) -> tuple[np.ndarray, np.ndarray]:
        """Sums of posteriors, and of rates, over each window of ``words`` (rows of the table).

        ``later`` are the windows that follow the one before them in their text.
        Their messages are first those of ``LEAD`` words beside them.  A pass makes
        at least one more window of each text final, and as what a message says
        fades from word to word, nearly all at once.
        """
        start, move, count = np.exp(self.start), np.exp(self.move), len(begin)
        before, after = np.tile(start / start.sum(), (count, 1)), np.ones((count, len(start)))
        if len(later):
            lead = np.full((len(later), len(start)), 1.0)
            for t in range(LEAD, 0, -1):
                lead = _unit((lead @ move) * self.rows.table[words[begin[later] - t]])
            before[later] = _unit(lead @ move)
            lead = np.full((len(later), len(start)), 1.0)
            for t in range(LEAD - 1, -1, -1):
                held = np.flatnonzero(lengths[later] > t)
                lead[held] = _unit((lead[held] * self.rows.table[words[begin[later[held]] + t]]) @ move.T)
            after[later - 1] = _unit(lead)
        sums, rates = np.zeros((count, len(start))), np.zeros(count)
        onward, backward = np.empty_like(before), np.empty_like(after)
        steps = np.arange(WINDOW)[:, None]
        at_once = max(1, min(2048, PREDICT_CELLS // (WINDOW * len(start))))
        todo = np.arange(count)
        while len(todo):
            full = lengths[todo] == WINDOW
            for some in (todo[full], todo[~full]):
                for a in range(0, len(some), at_once):
                    own = some[a : a + at_once]
                    at = np.minimum(begin[own] + steps, len(words) - 1)
                    # a window that is not full is its text's last: nothing follows
                    found, _, onward[own], backward[own] = posteriors(self.rows.table[words[at]], lengths[own], before[own], move, after=after[own] if lengths[own[0]] == WINDOW else None)
                    sums[own] = found.sum(axis=0)
                    if rated:
                        rates[own] = np.einsum("tnc,tnc->n", found, self.rows.rates[words[at]])
            again = np.zeros(count, bool)
            for own, told, heard in ((later, onward[later - 1], before), (later - 1, backward[later], after)):
                told = _unit(told)
                other = np.abs(told - _unit(heard[own])).max(axis=1, initial=0.0) > SAME
                heard[own[other]] = told[other]
                again[own[other]] = True
            todo = np.flatnonzero(again)
        return sums, rates


class Rows(dict):
    """chunk -> row of a table of emissions, and of one of rates where ``rated``; row 0 stands for chunks with no letter."""

    def __init__(self, field: Field, rated: bool = False):
        super().__init__()
        self.field, self.used = field, 1
        self.limit = CACHE_WORDS * 16 // max(16, len(field.labels))
        self.table = np.ones((self.limit, len(field.labels)))
        self.rates = np.zeros(self.table.shape, np.float32) if rated else None

    def fresh(self) -> Rows:
        if len(self) > self.limit:
            self.clear()
            self.used = 1
        return self

    def add(self, chunks: set[str]) -> None:
        missing = [c for c in chunks if c not in self]
        for at in range(0, len(missing), 20_000):
            part = [(c, letters_of(c)) for c in missing[at : at + 20_000]]
            self.update((c, 0) for c, w in part if not w)
            part = [x for x in part if x[1]]
            if not part:
                continue
            if self.used + len(part) > len(self.table):
                more = (max(len(self.table) // 2, len(part)), self.table.shape[1])
                self.table = np.concatenate([self.table, np.ones(more)])
                if self.rates is not None:
                    self.rates = np.concatenate([self.rates, np.zeros(more, np.float32)])
            self.table[self.used : self.used + len(part)] = self.field.emissions([w for _, w in part])
            if self.rates is not None:
                self.rates[self.used : self.used + len(part)] = self.field.rates([w for _, w in part])
            self.update((c, self.used + i) for i, (c, _) in enumerate(part))
            self.used += len(part)


def learn(docs: DataFrame, may_learn, per_language: int = SAMPLE_PER_LANGUAGE, chars: int = SAMPLE_CHARS) -> Field:
    """A field fitted on a bounded sample of the rows that ``may_learn`` (a test of doc_id) allows."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("lang").alias("label"), F.length("text").alias("n")).where(may_learn(F.col("doc_id")) & F.col("label").isNotNull() & (F.col("n") > 0))
    rows = materialise(rows.where(F.col("doc_id").isNotNull()).select("doc_id", "label"), "labelled")
    found, counts = bounded_sample(docs, rows, per_language, lambda text: excerpt(text, chars))
    field = Field(sorted(counts))
    return field.fit([r["text"] for r in found], [r["label"] for r in found]) if counts else field


def identify(docs: DataFrame, field: Field) -> DataFrame:
    """doc_id, lang_pred, score and shares (label to mean posterior) of each row of ``docs``."""
    held = ship(docs.sparkSession).sparkContext.broadcast(field)  # bounded by the sample
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"))
    kinds = pa.map_(pa.string(), pa.float64())

    def run(batches):
        field = held.value
        with released(field):
            for batch in batches:
                texts = batch.column("text").to_pylist()
                if field.labels:
                    sums, counts = field.predict(texts)
                else:
                    sums, counts = np.zeros((len(texts), 0)), np.zeros(len(texts), np.int64)
                out = []
                for total, n in zip(sums, counts.tolist(), strict=True):
                    if not n:
                        out.append((UNDEFINED, 0.0, []))
                        continue
                    share = total / total.sum()
                    best = int(np.argmax(share))
                    out.append((field.labels[best], min(1.0, float(share[best])), list(zip(field.labels, share.tolist(), strict=True))))
                columns = list(zip(*out)) or [(), (), ()]
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(columns[0], pa.string()), pa.array(columns[1], pa.float64()), pa.array(columns[2], kinds)], names=["doc_id", "lang_pred", "score", "shares"])

    return rows.mapInArrow(run, "doc_id long, lang_pred string, score double, shares map<string, double>")


def keep_known(docs: DataFrame, field: Field, familiar: float = FAMILIAR) -> DataFrame:
    """The rows of ``docs`` whose language is one of the field's, with ``familiar`` of what it expects at least."""
    held = ship(docs.sparkSession).sparkContext.broadcast(field)  # bounded by the sample

    def run(batches):
        field = held.value
        with released(field):
            for batch in batches:
                if not field.labels or not batch.num_rows:
                    continue
                known = field.known([t or "" for t in batch.column("text").to_pylist()], familiar)
                yield batch.filter(pa.array(known))

    return docs.mapInArrow(run, docs.schema)


def held_out(doc_id):
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(4)) == 2, F.lit(False))


def op8_language_crf(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    field = learn(docs, lambda c: ~held_out(c))
    return identify(docs, field).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", F.round("score", 6).alias("score"))
