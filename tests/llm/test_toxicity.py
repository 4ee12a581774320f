import math
import random
import zlib
from collections import Counter

import numpy as np
import pytest
from chronofold.llm import toxicity
from chronofold.llm._common import table
from pyspark.sql import functions as F

from tests.conftest import SF, SF_TINY
from tests.llm.conftest import documents


def corpus(n=400, seed=3):
    rng, words, bad = random.Random(seed), [f"{a}{b}" for a in "klmnprst" for b in ("ana", "eno", "iru", "osta")], ["scum", "moron", "trash", "idiot"]
    texts, labels = [], []
    for i in range(n):
        toxic = i % 5 == 0
        own = [rng.choice(words) for _ in range(rng.randrange(20, 60))]
        if toxic:
            own += [rng.choice(bad) for _ in range(rng.randrange(2, 5))]
        rng.shuffle(own)
        texts.append(" ".join(own))
        labels.append(int(toxic))
    return texts, labels


def brute_vectors(texts, labels, others, prefixes=(4, 5)):
    """Unit vectors as dictionaries, of texts and others, from the definition alone."""
    terms = lambda x: Counter(t for w in x.lower().split() for t in [w, *(w[:n] + "*" for n in prefixes if len(w) >= n)])
    bags = [terms(x) for x in texts]
    a, c = Counter(t for x, y in zip(bags, labels) if y for t in x), Counter(t for x, y in zip(bags, labels) if not y for t in x)
    clean, out = labels.count(0), []
    weight = {t: (math.log((1 + len(texts)) / (1 + a[t] + c[t])) + 1) * math.log2(2 + a[t] / max(1, c[t])) for t in a | c if a[t] + c[t] >= toxicity.MIN_TEXTS and c[t] <= toxicity.MAX_SHARE * clean}
    for bag in [*bags, *map(terms, others)]:
        v = {t: (1 + math.log(n)) * weight[t] for t, n in bag.items() if t in weight}
        size = math.sqrt(sum(x * x for x in v.values()))
        out.append({t: x / size for t, x in v.items()})
    return out[: len(texts)], out[len(texts) :]


@pytest.mark.parametrize("share", [0.05, 1.0])
def test_block_max_search_is_exact_on_whole_texts(monkeypatch, share):
    monkeypatch.setattr(toxicity, "BLOCK", 16)
    monkeypatch.setattr(toxicity, "MAX_SHARE", share)
    texts, labels = corpus()
    asked = corpus(60, seed=9)[0]
    examples, queries = brute_vectors(texts, labels, asked)
    model = toxicity.Model(texts, labels, k=7)
    assert model.blocks > 1 and set(model.terms) == {t for v in examples for t in v}
    entries = [dict(v) for v in {tuple(sorted(v.items())) for v in examples if v}]  # equal vectors are one
    for text, q in zip(asked, queries):
        want = sorted((sum(x * v.get(t, 0.0) for t, x in q.items()) for v in entries), reverse=True)[:7]
        evidence = model.score(text)[1]
        assert np.allclose([c for _, c in evidence], [c for c in want if c > 0])
        for i, c in evidence:
            assert abs(sum(x * examples[i].get(t, 0.0) for t, x in q.items()) - c) < 1e-9
    # texts of both labels are near somebody
    found = [i for text in asked for i, _ in model.score(text)[1]]
    assert {labels[i] for i in found} == {0, 1} if share == 1.0 else {1} <= {labels[i] for i in found}


def test_pruned_blocks_change_no_neighbour():
    texts, labels = corpus(3000)
    model = toxicity.Model(texts, labels, k=5)
    model.block_max, narrow = np.ones_like(model.block_max), model.block_max  # no block can be left out
    whole = [model.nearest(model.bag(t)) for t in texts[:200]]
    model.block_max = narrow
    for (c, e), (d, f) in zip(whole, (model.nearest(model.bag(t)) for t in texts[:200])):
        assert np.allclose(c, d) and e.tolist() == f.tolist()


def test_equal_examples_share_an_entry_with_their_votes():
    texts = [*(("bad " * n + "words") for n in (1, 1, 2, 3, 4, 5)), *(f"calm day {i % 9}" for i in range(90)), *[f"filler{i} here{i % 30}" for i in range(90)] * 20]
    model = toxicity.Model(texts, [1] * 6 + [0] * (len(texts) - 6))
    assert [2.0, 2.0] in model.votes.tolist() and [90.0, 0.0] in model.votes.tolist()
    score, evidence = model.score("such bad manners")
    assert score > 0.5 and evidence[0][0] < 6 and model.score("calm")[0] < 0.1
    assert model.score("") == (model.none_score, []) == model.score("unheard of")


def test_score_is_calibrated_and_holds_out():
    texts, labels = corpus(600)
    model = toxicity.Model(texts[:400], labels[:400])
    scores = np.array([model.score(t)[0] for t in texts[400:]])
    y = np.array(labels[400:])
    assert ((scores >= 0.5) == (y == 1)).mean() > 0.98
    assert (np.diff(model.shares) >= -1e-12).all() and 0 <= scores.min() and scores.max() <= 1


def test_documents(spark):
    docs, labels = documents(spark, SF), table(spark, SF, "labels")
    texts, ys, ids, weights = toxicity.labelled_sample(docs, labels, lambda c: ~toxicity.held_out(c))
    assert len(ids) == len(set(ids)) and all(spark.range(1).select(toxicity.held_out(F.lit(i).cast("long"))).first()[0] is False for i in ids[:3])
    rows = toxicity.score_toxicity(docs, texts, ys, ids, weights).join(labels, "doc_id").where(toxicity.held_out(F.col("doc_id"))).collect()
    hits = Counter((r["toxic"], r["score"] >= 0.5) for r in rows)
    assert hits[0, True] <= 1 and hits[1, True] >= 2 * hits[1, False]
    # the index spans both labels, and hardly a text is near nobody
    model = toxicity.Model(texts, ys, label_weights=weights)
    assert len(model.terms) > 5000 and len(model.votes) > 0.95 * len(set(texts))
    asked = [r["text"] for r in docs.where("length(text) > 200").select("text").collect()]
    assert sum(not model.score(t)[1] for t in asked) < 0.01 * len(asked)
    # a bound on the sample, by label
    few = toxicity.labelled_sample(docs, labels, lambda c: ~toxicity.held_out(c), per_label=10)
    assert Counter(few[1]) == {0: 10, 1: 10}
    assert all(abs(10 * few[3][y] - ys.count(y)) < 1e-9 for y in (0, 1))


def test_edge_rows(spark, edge, empty):
    labels = spark.createDataFrame([(1, 1, 0), (1, 1, 1), (2, 1, None), (None, 1, 1), (7, None, 0), (99, 1, 1)], "doc_id long, quality int, toxic int")
    texts, ys, ids, weights = toxicity.labelled_sample(edge, labels, lambda c: F.lit(True))
    assert list(zip(ids, ys)) == [(1, 1), (7, 0)] and len(texts[1]) <= toxicity.SAMPLE_CHARS + 8  # a long text teaches by excerpts
    rows = toxicity.score_toxicity(edge, texts, ys, ids, weights).collect()
    assert len(rows) == edge.count() and all(0 <= r["score"] <= 1 for r in rows)
    assert spark.range(1).select(toxicity.held_out(F.lit(None).cast("long"))).first()[0] is False
    none = toxicity.labelled_sample(edge, labels.limit(0), lambda c: F.lit(True))
    assert {r["score"] for r in toxicity.score_toxicity(edge, *none).collect()} == {0.0}
    assert toxicity.score_toxicity(empty, texts, ys, ids, weights).collect() == []


def test_larger_sample_finds_nearly_all(spark):
    docs, labels = documents(spark, "/root/testdata/sf0.1"), table(spark, "/root/testdata/sf0.1", "labels")
    sample = toxicity.labelled_sample(docs, labels, lambda c: ~toxicity.held_out(c))
    asked = docs.join(labels.select("doc_id", "toxic"), "doc_id", "left_semi").where(toxicity.held_out(F.col("doc_id")))
    rows = toxicity.score_toxicity(asked, *sample).join(labels, "doc_id").collect()
    hits = Counter((r["toxic"], r["score"] >= 0.5) for r in rows)
    assert hits[1, True] >= 0.88 * (hits[1, True] + hits[1, False]) and hits[0, True] <= 0.01 * hits[0, False]


def test_registered_query(spark):
    rows = toxicity.op9_toxicity_knn(spark, SF_TINY).collect()
    assert rows[0].asDict().keys() == {"doc_id", "held_out", "score", "predicted"}
    assert sorted(r["doc_id"] for r in rows) == sorted(r["doc_id"] for r in documents(spark, SF_TINY).collect())
    for r in rows:
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0)
        assert 0 <= r["score"] <= 1 and round(r["score"], 6) == r["score"] and r["predicted"] == int(r["score"] >= 0.5)
