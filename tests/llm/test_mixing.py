import hashlib
import math

import duckdb
import pytest
from chronofold.llm import mixing

from tests.conftest import SF, SF_TINY
from tests.oracle import connect, rows_of, rows_of_sql

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, weight double, epoch int"


def test_equals_its_sql(spark):
    for sf in (SF_TINY, SF):
        assert rows_of(spark, mixing.op5_temperature_mixing, sf) == rows_of_sql(connect(sf), mixing.OP5_SQL)


def docs_of(spark, sizes):
    rows, n = [], 0
    for source, count, words in sizes:
        for _ in range(count):
            n += 1
            rows.append((n, " ".join(["w"] * (words + n % 3)), "en", source, 1, 0.5, 1))
    return spark.createDataFrame(rows, SCHEMA)


def brute(rows, plan):
    """Copies of each document: whole epochs, then the hash's order while the budget lasts."""
    out = {}
    for source, p in plan.items():
        own = [(r["doc_id"], len((r["text"] or "").split())) for r in rows if r["source"] == source]
        whole, rest = divmod(p["budget"], p["tokens"])
        place = lambda d: hashlib.md5(f"{mixing.SEED}/{whole + 1}/{d}".encode()).hexdigest()  # noqa: E731, B023
        reach = 0
        for doc_id, n in sorted(own, key=lambda x: place(x[0])):
            reach += n
            out[doc_id] = whole + (rest > 0 and reach <= rest)
    return out


@pytest.mark.parametrize("block_docs", [4096, 8, 1])
def test_blocks_change_no_copy(spark, block_docs):
    docs = docs_of(spark, [("big", 400, 9), ("mid", 90, 7), ("low", 25, 5)])
    plan = {r["source"]: r for r in mixing.plan_sources(docs.select("source", mixing.token_count(docs["text"]).alias("n_tokens"))).collect()}
    got = {}
    for r in mixing.mix_rows(docs, mixing.ENTROPY_TARGET, mixing.MAX_EPOCHS, block_docs).collect():
        got[r["doc_id"]] = got.get(r["doc_id"], 0) + 1
    assert got == brute(docs.collect(), plan)
    # no source loses a document or is repeated too often, and the partial epoch fills its budget but for a document
    for p in plan.values():
        assert p["tokens"] <= p["budget"] <= mixing.MAX_EPOCHS * p["tokens"] + 1


def test_entropy_target_is_met_where_repetition_allows(spark):
    docs = docs_of(spark, [("a", 60, 9), ("b", 40, 9), ("c", 30, 9)])
    for target in (0.0, 0.5, 1.0):
        plan = mixing.plan_sources(docs.select("source", mixing.token_count(docs["text"]).alias("n_tokens")), target, 100.0).collect()
        total = sum(r["tokens"] for r in plan)
        entropy = lambda ws: -sum(w * math.log(w) for w in ws)
        own = entropy([r["tokens"] / total for r in plan])
        assert abs(entropy([r["weight"] for r in plan]) - (own + target * (math.log(3) - own))) < 1e-9
        assert abs(sum(r["weight"] for r in plan) - 1) < 1e-12


def test_edge_rows(spark, edge, empty):
    rows = mixing.mix(edge)
    assert rows.columns == edge.columns
    got, all_rows = [str(r) for r in rows.collect()], [str(r) for r in edge.collect()]
    assert set(got) == set(all_rows) and all(got.count(x) >= all_rows.count(x) for x in all_rows)
    assert mixing.mix(empty).collect() == []
    silent = edge.where("text IS NULL OR length(trim(text)) = 0")
    assert mixing.mix(silent).count() == silent.count()


def test_the_plan_has_no_python(spark, edge):
    assert "Python" not in (plan := mixing.mix(edge)._jdf.queryExecution().executedPlan().toString()) and "Arrow" not in plan


def test_white_space_of_any_kind_parts_words_in_query_and_sql(spark, tmp_path):
    rows = [(i, t, "en", s, 1) for i, (t, s) in enumerate([("a\vb\fc\rd", "x"), ("a b", "x"), ("e\tf\ng h", "y"), ("", "y"), (None, "y"), ("i\r\nj", "z"), ("\x1f", "z")])]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").coalesce(1)
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    assert [r[0] for r in docs.select(mixing.token_count(docs["text"])).collect()] == [4, 1, 4, 0, 0, 2, 1]
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    assert rows_of(spark, mixing.op5_temperature_mixing, str(tmp_path)) == rows_of_sql(con, mixing.OP5_SQL)
