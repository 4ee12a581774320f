"""The sample bounds what is learned from, never which languages are learned."""

from chronofold.llm import _common, language
from pyspark.sql import functions as F

from tests.conftest import SF
from tests.llm.conftest import documents


def everything(c):
    return F.lit(True)


def test_a_language_of_long_documents_alone_is_learned(spark):
    docs = documents(spark, SF)
    long = F.repeat(F.concat(F.col("text"), F.lit(" ")), 40)
    docs = docs.where(F.length("text") > 200).withColumn("text", F.when(F.col("lang") == "es", long).otherwise(F.col("text")))
    assert docs.where((F.col("lang") == "es") & (F.length("text") <= language.SAMPLE_CHARS)).isEmpty()
    field = language.learn(docs, everything)
    assert "es" in field.labels
    rows = language.identify(docs, field).join(docs.select("doc_id", "lang"), "doc_id").where("lang = 'es'").collect()
    assert sum(r["lang_pred"] == "es" for r in rows) / len(rows) > 0.97
    # books alone
    books = docs.where("lang = 'es'")
    kept = language.keep_known(books, language.learn(books, everything)).count()
    assert kept == books.count()


def test_more_than_64_languages_are_learned(spark):
    letters = "bcdfghjklmnprstvw"
    rows = []
    for i in range(70):
        own = letters[i % 17] + "aeiou"[i // 17]
        rows += [(i * 3 + j, " ".join(own + x + own for x in "aeioubcdf"), f"l{i:02}") for j in range(3)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    field = language.learn(docs, everything)
    assert len(field.labels) == 70
    got = language.identify(docs, field).join(docs, "doc_id").where("lang_pred = lang").count()
    assert got == docs.count()


def test_fitting_in_parts_changes_nothing(monkeypatch):
    texts, langs = ["uno dos tres cuatro " * 40, "one two three four " * 40], ["a", "b"]
    whole = language.Field(["a", "b"]).fit(texts, langs)
    monkeypatch.setattr(language, "FIT_CELLS", 200)
    parts = language.Field(["a", "b"]).fit(texts, langs)
    assert abs(whole.weights - parts.weights).max() < 1e-6 and abs(whole.move - parts.move).max() < 1e-6


def test_excerpts_are_whole_words_spread_over_the_text(spark):
    words = [f"w{i:05}" for i in range(5000)]
    rows = [(" ".join(words),), ("short text",), ("x" * 9000,), (None,)]
    got = [r[0] for r in spark.createDataFrame(rows, "text string").select(_common.excerpt(F.col("text"), 4000)).collect()]
    own = got[0].split()
    assert len(got[0]) <= 4000 + _common.SAMPLE_PIECES and set(own) <= set(words) and own == sorted(own)
    assert own[0] == words[0] and own[-1] == words[-1] and any("w02400" < w < "w02900" for w in own)
    assert got[1] == "short text" and 0 < len(got[2]) <= 4000 + _common.SAMPLE_PIECES and got[3] is None


def test_every_sampled_document_teaches_the_same_share(monkeypatch):
    monkeypatch.setattr(language, "TRAIN_WORDS_PER_LANGUAGE", 100)
    texts = [" ".join(f"{c}{x}" + c * 3 for x in "abcdefghijklmnopqrstuvwxyz") for c in "bcdfg"]
    held = []
    monkeypatch.setattr(language.Field, "_know", lambda self, taken: held.append(taken))
    language.Field(["x"]).fit(texts, ["x"] * 5, rounds=1)
    assert [len(d) for d in held[0][0]] == [20] * 5
    assert all(d[0] == t.split()[0] and d[-1] == t.split()[-1] for d, t in zip(held[0][0], texts))
    assert language.equal_shares([3, 100, 0, 50], 60) == [3, 29, 0, 28] and language.equal_shares([3, 4], 60) == [3, 4]
