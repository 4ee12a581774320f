from chronofold.llm import toxicity


def test_evidence_names_every_example_that_voted(spark):
    texts = [f"{'vile ' * (i // 2 + 1)}scum clown" if i % 2 else f"{'kind ' * (i // 2 + 1)}friend garden" for i in range(40)]
    labels, ids = [i % 2 for i in range(len(texts))], list(range(100, 100 + len(texts)))
    docs = spark.createDataFrame([(1, texts[1])], "doc_id long, text string")
    got = toxicity.score_toxicity(docs, texts, labels, ids).collect()[0]["evidence"]
    want = toxicity.Model(texts, labels, toxicity.NEIGHBOURS, None).score(texts[1])[1]
    assert len(want) > 3 and [(r["doc_id"], r["cosine"]) for r in got] == [(ids[i], c) for i, c in want]
