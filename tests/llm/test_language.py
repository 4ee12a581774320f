import itertools
import zlib

import numpy as np
from chronofold.llm import language
from pyspark.sql import functions as F

from tests.conftest import SF, SF_TINY
from tests.llm.conftest import documents


def test_forward_backward_against_all_labelings():
    rng = np.random.default_rng(1)
    labels, lengths = 3, np.array([4, 1, 3])
    emission, start, move = rng.random((4, 3, labels)) + 0.1, rng.random(labels) + 0.1, rng.random((labels, labels)) + 0.1
    found, moves, _, _ = language.posteriors(emission.copy(), lengths, start, move, learning=True)
    want, want_moves = np.zeros_like(emission), np.zeros((labels, labels))
    for s, n in enumerate(lengths):
        total, by, trans = 0.0, np.zeros((n, labels)), np.zeros((labels, labels))
        for path in itertools.product(range(labels), repeat=int(n)):
            w = start[path[0]] * np.prod([emission[t, s, c] for t, c in enumerate(path)]) * np.prod([move[a, b] for a, b in zip(path, path[1:])])
            total += w
            for t, c in enumerate(path):
                by[t, c] += w
            for a, b in zip(path, path[1:]):
                trans[a, b] += w
        want[:n, s] = by / total
        want_moves += trans / total
    assert np.allclose(found, want) and np.allclose(moves, want_moves)


def test_held_out_accuracy_and_switches(spark):
    docs = documents(spark, SF)
    field = language.learn(docs, lambda c: ~language.held_out(c))
    rows = language.identify(docs, field).join(docs.select("doc_id", "lang"), "doc_id").where(language.held_out(F.col("doc_id"))).collect()
    assert sum(r["lang_pred"] == r["lang"] for r in rows) / len(rows) > 0.97
    # a text that switches is labelled word by word
    de, en = ("der die und nicht das von zu mit sich auf " * 3, "the of and that with this from are was by " * 3)
    sums, counts = field.predict([en + de, en * 30])
    share = dict(zip(field.labels, (sums[0] / counts[0]).tolist()))
    assert 0.35 < share["de"] < 0.65 and 0.35 < share["en"] < 0.65
    assert sums[1].argmax() == field.labels.index("en")


def test_windows_and_blocks_change_no_count():
    field = language.Field(["a", "b"]).fit(["uno dos tres cuatro " * 40, "one two three four " * 40], ["a", "b"])
    texts = ["one two " * n for n in (1, 31, 32, 33, 64, 500)] + ["", "!!! 12"]
    sums, counts = field.predict(texts)
    assert counts.tolist() == [2, 62, 64, 66, 128, 1000, 0, 0]
    assert np.allclose(sums.sum(axis=1), counts)
    again, _ = field.predict(texts)
    assert np.array_equal(sums, again)


def uncut(field, text):
    """Sums of posteriors of a text as one sequence."""
    words = [w for w in map(language.letters_of, text.split()) if w]
    found = language.posteriors(field.emissions(words)[:, None], np.array([len(words)]), np.exp(field.start), np.exp(field.move))[0]
    return found.sum(axis=(0, 1)), len(words)


def test_posteriors_are_those_of_the_uncut_chain(spark):
    rows = documents(spark, SF).where("text IS NOT NULL AND lang IS NOT NULL").orderBy("doc_id").limit(400).collect()
    field = language.Field(sorted({r["lang"] for r in rows})).fit([r["text"][:3000] for r in rows[:120]], [r["lang"] for r in rows[:120]])
    pool = " ".join(r["text"] for r in rows).split()
    rng = np.random.default_rng(5)
    texts = [" ".join(pool[a : a + n]) for n in (1, 63, 64, 65, 66, 127, 128, 129, 200, 1000, 20_000) for a in rng.integers(0, len(pool) - 20_000, 3)]
    # words that say nothing, between some that do: what is known must travel over many windows
    silent = "qqqq " * 3000
    texts += [silent, pool[0] + " " + silent, silent + pool[-1], " ".join(rng.choice(pool, 5000)), "x" * 100_000 + " " + " ".join(pool[:300])]
    sums, counts = field.predict(texts)
    for text, total, n in zip(texts, sums, counts):
        want, words = uncut(field, text)
        assert n == words and np.abs(total - want).max() < 1e-7 * max(1, n)


def test_registered_query(spark):
    rows = language.op8_language_crf(spark, SF_TINY).collect()
    docs = {r["doc_id"]: r for r in documents(spark, SF_TINY).collect()}
    assert rows[0].asDict().keys() == {"doc_id", "held_out", "lang_pred", "score"} and len(rows) == len(docs)
    learned = {r["lang"] for i, r in docs.items() if zlib.crc32(str(i).encode()) % 4 != 2}
    right = 0
    for r in rows:
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2)
        lettered = any(map(str.isalpha, docs[r["doc_id"]]["text"] or ""))
        assert (r["lang_pred"] in learned and 0 < r["score"] <= 1) if lettered else (r["lang_pred"], r["score"]) == ("und", 0.0)
        right += r["lang_pred"] == docs[r["doc_id"]]["lang"]
    assert right / len(rows) > 0.95


def test_edge_rows(spark, edge, empty):
    field = language.learn(edge, lambda c: F.lit(True))
    assert field.labels == ["de", "en", "fr"] or set(field.labels) <= {"de", "en", "fr"}
    rows = language.identify(edge, field).collect()
    by_text = {r["doc_id"]: r for r in rows if r["doc_id"] is not None}
    assert len(rows) == edge.count()
    for doc_id in (4, 5, 6, 8):
        assert by_text[doc_id]["lang_pred"] == "und" and by_text[doc_id]["score"] == 0.0
    for doc_id in (1, 7, 9, 10):
        assert by_text[doc_id]["lang_pred"] in field.labels and 0 < by_text[doc_id]["score"] <= 1
    kept = language.keep_known(edge, field)
    assert kept.schema == edge.schema and sorted({r["doc_id"] or 0 for r in kept.collect()}) == [0, 1, 2, 3, 7, 9, 10]
    # nothing learned: nothing known
    nothing = language.learn(empty, lambda c: F.lit(True))
    assert {r["lang_pred"] for r in language.identify(edge, nothing).collect()} == {"und"}
    assert language.keep_known(edge, nothing).collect() == [] and language.identify(empty, field).collect() == []
