"""Texts in no learned language go, whatever the number of languages."""

import pytest
from chronofold.llm import language

from tests.conftest import SF
from tests.llm.conftest import documents

FOREIGN = [
    "La vita nella città era molto tranquilla e gli abitanti si conoscevano tutti. Ogni mattina il vecchio pescatore scendeva verso il porto con la sua barca.",
    "Vanha mies käveli hitaasti metsän läpi ja katseli puita, jotka olivat kasvaneet siellä jo hänen lapsuudessaan.",
    "Вчера вечером мы пошли в кино, чтобы посмотреть новый фильм, но все билеты уже были проданы.",
    "qzx wvk jjq xxz pkq zzv qqk vvx " * 10, "x" * 200_000, "日本語 の 文章 です",
]


@pytest.mark.parametrize("langs", [("en", "fr", "de", "es"), ("en", "de"), ("en",)])
def test_foreign_texts_go_and_switching_texts_stay(spark, langs):
    rows = [r for r in documents(spark, SF).orderBy("doc_id").collect() if r["lang"] in langs]
    learnt, others = rows[::2], rows[1::2]
    field = language.Field(sorted(langs)).fit([r["text"][:4000] for r in learnt], [r["lang"] for r in learnt])
    assert not field.known(FOREIGN).any()
    assert field.known([r["text"] for r in others]).mean() > 0.995
    # clean texts that switch: parts of two documents, in turn
    texts = {c: [r["text"].split() for r in others if r["lang"] == c and len(r["text"].split()) >= 40] for c in langs}
    switched = [" ".join(w for at in range(0, 40, 10) for w in a[at : at + 10] + b[at : at + 10]) for c, d in zip(langs, langs[1:]) for a, b in zip(texts[c], texts[d])]
    assert field.known(switched).all()


def test_stage_drops_a_language_that_was_not_learned(spark):
    docs = documents(spark, SF)
    field = language.learn(docs, lambda c: c.isNotNull())
    foreign = spark.createDataFrame([(10_000 + i, t, "xx", "web", len(t)) for i, t in enumerate(FOREIGN)], docs.schema)
    kept = {r["doc_id"] for r in language.keep_known(docs.unionByName(foreign), field).select("doc_id").collect()}
    assert kept == {r["doc_id"] for r in docs.select("doc_id").collect()}
