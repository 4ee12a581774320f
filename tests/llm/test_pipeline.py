"""The pipeline against a version of each stage in plain Python."""

import corpus_pipeline
from chronofold.llm import mixing
from chronofold.llm._common import materialise
from pyspark.sql import functions as F

from tests.conftest import SF_TINY
from tests.llm.conftest import documents
from tests.llm.test_mixing import brute as brute_copies
from tests.llm.test_quality import naive as judged
from tests.llm.test_simhash import brute as brute_classes
from tests.llm.test_tokens import check_packed


def test_stages(spark):
    docs = documents(spark, SF_TINY)
    # 1: documents without a known language go
    junk = docs.limit(2).withColumn("doc_id", F.col("doc_id") + 10_000).withColumn("text", F.lit("123 456 !!"))
    stage = dict(corpus_pipeline.STAGES)
    known = materialise(stage["language"](spark, docs.unionByName(junk), SF_TINY), "t1")
    assert known.columns == docs.columns and sorted(r["doc_id"] for r in known.collect()) == sorted(r["doc_id"] for r in docs.collect())
    # 2
    good = materialise(stage["quality"](spark, known, SF_TINY), "t2")
    want = {r["doc_id"] for r in docs.collect() if judged(r["doc_id"], r["text"])[-1]}
    assert {r["doc_id"] for r in good.collect()} == want and len(want) < docs.count()
    # 3
    single = materialise(stage["near duplicates"](spark, good, SF_TINY), "t3")
    rows = [(r["doc_id"], r["text"]) for r in good.collect()]
    want = {d for d, _, c in brute_classes(rows) if d == c}
    assert sorted(r["doc_id"] for r in single.collect()) == sorted(want)
    # 4
    mixed = materialise(stage["mixing"](spark, single, SF_TINY), "t4")
    plan = {r["source"]: r for r in mixing.plan_sources(single.select("source", mixing.token_count(F.col("text")).alias("n_tokens"))).collect()}
    copies = {}
    for r in mixed.collect():
        copies[r["doc_id"]] = copies.get(r["doc_id"], 0) + 1
    assert copies == brute_copies(single.collect(), plan) and min(copies.values()) >= 1
    # 5
    packed = stage["packing"](spark, mixed, SF_TINY).collect()
    assert check_packed(packed, [(r["doc_id"], r["text"]) for r in mixed.collect()]) > 0.9
    # all in one
    whole = corpus_pipeline.run(spark, SF_TINY).collect()
    key = lambda r: (r["doc_id"], r["start"], r["length"], r["ids_crc32"], r["doc_tokens"])
    assert sorted(map(key, whole)) == sorted(map(key, packed))


def test_edge_rows_go_through_every_stage(spark, edge, empty):
    for docs in (edge, empty):
        for name, stage in corpus_pipeline.STAGES:
            docs = materialise(stage(spark, docs, SF_TINY), f"edge-{name.replace(' ', '-')}")
            if name != "packing":
                assert docs.columns == edge.columns
    assert docs.collect() == []


def test_query_columns(spark):
    from chronofold.llm import registry

    assert sorted(int(n[2:].split("_")[0]) for n in registry.QUERIES) == list(range(1, 11))
    assert set(registry.ORACLE_SQL) <= set(registry.QUERIES)
