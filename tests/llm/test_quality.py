import collections
import re

from chronofold.llm import quality

from tests.conftest import SF_TINY
from tests.oracle import connect, rows_of, rows_of_sql

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def naive(doc_id, text):
    text = text or ""
    words = WORD.findall(text)
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    often = {w for w, n in collections.Counter(windows).items() if n > 1}
    repeated = {i + j for i, w in enumerate(windows) if w in often for j in range(3)}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    n, chars, symbols, dup = len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines))
    base = n < 50 or 100 * len(repeated) > 50 * n
    stop = sum(w in set(quality.stop_words()) for w in words)
    kept = not base and 2 <= chars / n <= 12 and symbols / n <= 0.1 and stop / n >= 0.03 and dup / len(lines) <= 0.5
    return doc_id, n, chars, symbols, dup, len(repeated), base, kept


OUT = ("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def judged(docs):
    return sorted((tuple(r) for r in quality.judge(docs).select(*OUT).collect()), key=str)


def test_equals_its_sql(spark):
    assert rows_of(spark, quality.op7_quality_rules, SF_TINY) == rows_of_sql(connect(SF_TINY), quality.OP7_SQL)


def test_edge_rows(spark, edge, empty):
    rows = edge.select("doc_id", "text").collect()
    assert judged(edge) == sorted((naive(*r) for r in rows), key=str)
    assert judged(empty) == []
    kept = quality.keep_good(edge)
    assert kept.columns == edge.columns and kept.schema == edge.schema
    assert sorted((str(r["doc_id"]) for r in kept.collect())) == sorted(str(r[0]) for r in rows if naive(*r)[-1])
    assert quality.keep_good(empty).collect() == []


def test_windows_that_overlap_count_each_word_once(spark):
    texts = ["a b c a b c", "a a a a", "a a a", "a b c d a b c e", "a b", "", "a b c x a b c y a b c", " a\tb\nc\x0ba\x0cb\rc "]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert judged(docs) == sorted((naive(*r) for r in enumerate(texts)), key=str)


def test_the_plan_has_no_python_and_no_shuffle(spark, edge):
    plan = quality.judge(edge)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Exchange" not in plan


def test_very_long_texts_are_no_slower_than_sorting(spark):
    import time

    docs = spark.createDataFrame([(1, " ".join(f"w{i % 4001}" for i in range(200_000)))], "doc_id long, text string")
    began = time.time()
    (row,) = judged(docs)
    assert row[1] == 200_000 and row[5] == 200_000 and time.time() - began < 60
