import numpy as np
import pytest
from chronofold.llm import additive_ann as ann

from tests.conftest import SF_TINY

SCHEMA = "vec_id long, embedding array<float>, row string, score int, rank int"


def brute(x, ids, i, k, metric):
    dot = x @ x[i]
    score = {"ip": dot, "l2": -((x - x[i]) ** 2).sum(axis=1), "cosine": dot / np.sqrt((x * x).sum(axis=1) * (x[i] @ x[i]))}[metric]
    order = [j for j in np.lexsort((ids, -score)) if j != i][:k]
    return [(int(ids[j]), float(score[j])) for j in order]


@pytest.mark.parametrize("metric", ["ip", "l2", "cosine"])
def test_recall_and_exact_scores(spark, metric):
    vectors = spark.read.parquet(f"{SF_TINY}/embeddings.parquet")
    rows = vectors.collect()
    x, ids = np.array([r["embedding"] for r in rows], float), np.array([r["vec_id"] for r in rows])
    got = {}
    for r in ann.search(vectors, lambda c: c % 50 == 0, k=20, shortlist=60, metric=metric).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    hits = total = 0
    for i in np.flatnonzero(ids % 50 == 0):
        want = brute(x, ids, i, 20, metric)
        found = sorted(got[ids[i]])
        assert [r for r, _, _ in found] == list(range(1, 21))
        at = {int(v): j for j, v in enumerate(ids)}
        for (_, v, s), (_, w, t) in zip(found, found[1:]):
            assert s >= t
        exact = dict(brute(x, ids, i, len(ids), metric))
        assert all(abs(exact[v] - s) < 1e-9 and v in at for _, v, s in found)
        hits += len({v for v, _ in want} & {v for _, v, _ in found})
        total += 20
    assert hits / total >= 0.95


def test_blocks_of_either_side_change_nothing(spark, monkeypatch):
    vectors = spark.read.parquet(f"{SF_TINY}/embeddings.parquet")
    run = lambda: sorted(tuple(r) for r in ann.search(vectors, lambda c: c % 20 == 0, k=5, shortlist=500).collect())
    whole = run()
    monkeypatch.setattr(ann, "CANDIDATE_BLOCK", 90)
    monkeypatch.setattr(ann, "QUERY_BLOCK", 4)
    assert run() == whole


def test_registered_query_against_brute_force(spark):
    rows = spark.read.parquet(f"{SF_TINY}/embeddings.parquet").collect()
    x, ids = np.array([r["embedding"] for r in rows], float), np.array([r["vec_id"] for r in rows])
    got = {}
    for r in ann.op4_additive_ann(spark, SF_TINY).collect():
        assert r.asDict().keys() == {"query_id", "rank", "vec_id", "score"}
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    assert set(got) == {int(i) for i in ids if i % 20 == 0}
    hits = 0
    for i in np.flatnonzero(ids % 20 == 0):
        want, found = brute(x, ids, i, 20, "ip"), sorted(got[ids[i]])
        assert [r for r, _, _ in found] == list(range(1, 21))
        exact = dict(brute(x, ids, i, len(ids), "ip"))
        assert all(abs(exact[v] - s) < 1e-12 for _, v, s in found) and [(-s, v) for _, v, s in found] == sorted((-s, v) for _, v, s in found)
        hits += len({v for v, _ in want} & {v for _, v, _ in found})
    assert hits >= 0.99 * 20 * len(got)


def hard_rows(real):
    """Wide noise that the books are spent on, a ball of near copies, whole copies, lengths over many powers of ten, a common offset."""
    rng = np.random.default_rng(7)
    noise = lambda n: rng.normal(size=(n, 16))
    ball = 4 * noise(1) + 1e-3 * noise(1200)
    x = np.concatenate([3 * noise(400), ball, np.repeat(noise(1) * 5, 500, axis=0), noise(200) * 10.0 ** rng.uniform(-6, 6, size=(200, 1)), 50 + 0.1 * noise(200)])
    return x.astype(real).astype(float), rng.permutation(len(x)) * 5


@pytest.mark.parametrize(("metric", "real"), [("ip", "float"), ("ip", "double"), ("l2", "double"), ("cosine", "float")])
def test_rows_that_the_codes_hardly_tell_apart(spark, metric, real):
    x, ids = hard_rows(np.float32 if real == "float" else np.float64)
    vectors = spark.createDataFrame([(int(i), v.tolist()) for i, v in zip(ids, x)], f"vec_id long, embedding array<{real}>")
    got = {}
    for r in ann.search(vectors, lambda c: c % 100 == 0, k=20, metric=metric).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    assert set(got) == {int(i) for i in ids if i % 100 == 0}
    summed = lambda a: sum(a.T, np.zeros(len(a)))  # noqa: E731 - dimension by dimension, so that copies score equally
    for i in np.flatnonzero(ids % 100 == 0):
        dot = summed(x * x[i])
        score = {"ip": dot, "l2": -summed((x - x[i]) ** 2), "cosine": dot / np.sqrt(summed(x[i : i + 1] ** 2) * summed(x * x))}[metric]
        order = [j for j in np.lexsort((ids, -score)) if j != i][:20]
        assert sorted(got[ids[i]]) == [(n, int(ids[j]), float(score[j])) for n, j in enumerate(order, 1)]


def test_registered_query_on_a_ball_of_near_copies(spark, tmp_path):
    rng = np.random.default_rng(9)
    x = np.concatenate([rng.normal(size=(600, 16)), 3 * rng.normal(size=(1, 16)) + 3e-4 * rng.normal(size=(1400, 16))])[rng.permutation(2000)].astype(np.float32).astype(float)
    spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<float>").write.parquet(f"{tmp_path}/embeddings.parquet")
    got = {}
    for r in ann.op4_additive_ann(spark, str(tmp_path)).orderBy("rank").collect():
        got.setdefault(r["query_id"], []).append((r["vec_id"], r["score"]))
    assert set(got) == set(range(0, 2000, 20))
    for i in got:
        score = sum((x * x[i]).T, np.zeros(2000))
        assert got[i] == [(int(j), float(score[j])) for j in np.lexsort((np.arange(2000), -score)) if j != i][:20]


def test_vectors_beyond_the_range_of_single_precision(spark):
    rng = np.random.default_rng(8)
    x = rng.normal(size=(600, 8)) * 10.0 ** rng.choice([-150, -40, 0, 40, 150], size=(600, 1))
    vectors = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    got = {}
    for r in ann.search(vectors, lambda c: c % 20 == 0, k=20, shortlist=30).orderBy("rank").collect():
        got.setdefault(r["query_id"], []).append(r["vec_id"])
    for i in range(0, 600, 20):
        score = sum((x * x[i]).T)
        assert got[i] == [int(j) for j in np.lexsort((np.arange(600), -score)) if j != i][:20]


def test_the_shortlist_changes_no_result(spark):
    vectors = spark.read.parquet(f"{SF_TINY}/embeddings.parquet")
    run = lambda n: sorted(tuple(r) for r in ann.search(vectors, lambda c: c % 20 == 0, k=20, shortlist=n).collect())
    assert run(5) == run(40) == run(100_000)


def test_the_shortlist_grows_with_the_table():
    sizes = [ann.shortlist_for(n, 20) for n in (10, 1000, 50_000, 10**6, 10**9)]
    assert sizes[:3] == [300, 300, 300] and 300 < sizes[3] < sizes[4] < 5000
    assert ann.shortlist_for(50_000, 100) > 300


def test_rows_that_take_no_part(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0]), (20, [0.0, 1.0]), (20, [0.0, 1.0]), (3, [1.0, 1.0]), (4, None), (5, [nan, 1.0]), (6, [inf, 1.0]), (7, [None, 1.0]), (8, [0.0, 0.0]), (9, []), (None, [1.0, 1.0]), (40, [1.0, 2.0, 3.0]), (2, [1.0, 1.0])]
    vectors = spark.createDataFrame([(i, v, "x", 1, 2) for i, v in rows], SCHEMA)
    got = [tuple(r) for r in ann.search(vectors, lambda c: c % 20 == 0, k=20).collect()]
    of = lambda q: sorted((r, v, s) for i, r, v, s in got if i == q)
    assert of(0) == [(1, 2, 1.0), (2, 3, 1.0), (3, 20, 0.0), (4, 20, 0.0)]
    # both rows with id 20 ask, and each finds the other
    assert of(20) == sorted(2 * [(1, 2, 1.0), (2, 3, 1.0), (3, 20, 1.0), (4, 0, 0.0)])
    assert ann.search(vectors.limit(0), lambda c: c % 20 == 0).collect() == []
    assert ann.search(vectors, lambda c: c == 12345).collect() == []


def test_beam_search_is_no_worse_than_greedy():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(600, 16))
    q = ann.Quantiser.fit(x, books=6, words=16)
    error = lambda beam: ((x - q.decode(q.encode(x, beam))) ** 2).sum(axis=1).mean()
    assert error(8) <= error(1) < (x**2).sum(axis=1).mean()
