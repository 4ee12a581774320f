import numpy as np
import xxhash
from chronofold.llm import simhash
from pyspark.sql import functions as F

from tests.conftest import SF_TINY
from tests.llm.conftest import documents


def naive_fingerprint(text):
    words = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    for c in "\t\n\x0b\x0c\r":
        words = words.replace(c, " ")
    words = [w for w in words.split(" ") if w]
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or ([" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(s.encode(), seed=42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def classes(keys, linked):
    """Union of all linked pairs, by brute force: class number of each key."""
    at = list(range(len(keys)))
    for i in range(len(keys)):
        for j in range(i):
            if linked(keys[i], keys[j]):
                a, b = at[i], at[j]
                at = [min(a, b) if x in (a, b) else x for x in at]
    return at


def brute(rows):
    prints = [naive_fingerprint(t) for _, t in rows]
    distinct = sorted(set(prints))
    of = dict(zip(distinct, classes(distinct, lambda a, b: (a ^ b).bit_count() <= 3)))
    low = {}
    for (doc_id, _), fp in zip(rows, prints):
        if doc_id is not None:
            low[of[fp]] = min(doc_id, low.get(of[fp], doc_id))
    return sorted(((d, f"{fp:016x}", low.get(of[fp])) for (d, _), fp in zip(rows, prints)), key=str)


def found(docs, **how):
    rows = simhash.near_duplicates(docs, **how).select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0"), "component_id").collect()
    return sorted((tuple(r) for r in rows), key=str)


def test_documents_against_brute_force(spark):
    docs = documents(spark, SF_TINY)
    want = brute([tuple(r) for r in docs.select("doc_id", "text").collect()])
    assert found(docs) == want


def test_edge_rows(spark, edge, empty):
    rows = [tuple(r) for r in edge.select("doc_id", "text").collect()]
    assert found(edge) == brute(rows)
    assert found(empty) == []
    kept = simhash.one_of_each(edge)
    assert kept.columns == edge.columns
    ids = [r["doc_id"] for r in kept.collect()]
    assert ids.count(None) == 2 and ids.count(3) == 0 and 1 in ids and 4 in ids and 5 not in ids
    assert simhash.one_of_each(empty).collect() == []


def near(rng, n, spread):
    base = rng.integers(0, 2**64, n, dtype=np.uint64)
    out = [base]
    for _ in range(spread):
        x = base.copy()
        for _ in range(int(rng.integers(1, 4))):
            x ^= np.uint64(1) << rng.integers(0, 64, n, dtype=np.uint64)
        out.append(x)
    return np.unique(np.concatenate(out))


def test_gray_index_against_all_pairs():
    rng = np.random.default_rng(5)
    words = near(rng, 60, 6)
    index = simhash.GrayIndex(words)
    label = index.link(3)
    want = classes(index.words.tolist(), lambda a, b: (a ^ b).bit_count() <= 3)
    assert label.tolist() == want
    # groups keep apart what would link
    groups = np.arange(len(words)) % 2
    index = simhash.GrayIndex(words, groups=groups)
    own = dict(zip(words.tolist(), groups.tolist()))
    want = classes(index.words.tolist(), lambda a, b: own[a] == own[b] and (a ^ b).bit_count() <= 3)
    assert index.link(3).tolist() == want


def test_heavy_buckets_are_dealt_anew_without_loss(spark):
    rng = np.random.default_rng(6)
    words = near(rng, 12, 8)
    # many that share their first 20 bits: hot in the first band
    hot = np.uint64(0xABCDE << 44) | (rng.integers(0, 2**44, 300, dtype=np.uint64) & ~np.uint64(0xFFF))
    words = np.unique(np.concatenate([words, hot, hot ^ np.uint64(5)]))
    distinct = spark.createDataFrame([(int(x),) for x in words.view(np.int64)], "fp long")
    want = classes(words.tolist(), lambda a, b: (a ^ b).bit_count() <= 3)
    groups = {}
    for w, c in zip(words.tolist(), want):
        groups.setdefault(c, set()).add(w)
    expected = sorted(sorted(g) for g in groups.values() if len(g) > 1)
    for bucket_rows in (simhash.BUCKET_ROWS, 20):
        edges = simhash.links(distinct, 3, bucket_rows).checkpoint()
        nodes = edges.select(F.explode(F.array("a", "b")).alias("node")).distinct()
        got = {}
        for r in simhash.components(nodes, edges).collect():
            got.setdefault(r["component"], set()).add(r["node"] & 2**64 - 1)
        assert sorted(sorted(g) for g in got.values()) == expected


def test_a_long_chain_is_one_component(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(60)] + [(100, 101)], "a long, b long")
    nodes = edges.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    got = {r["node"]: r["component"] for r in simhash.components(nodes, edges).collect()}
    assert got == {**dict.fromkeys(range(61), 0), 100: 100, 101: 100}
