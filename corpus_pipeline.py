"""The corpus pipeline: from raw documents to packed token sequences.

Each stage works on all that the one before kept; its output is written as
Parquet and reread as the next one's ``docs``.  All but the last keep the columns
of ``documents``.

1. language: documents in none of the languages learned from ``lang`` go, whatever
   the number of languages;
2. quality: documents that the quality rules reject go;
3. near duplicates: of each SimHash class the smallest doc_id stays;
4. mixing: sources are repeated to their temperature weights, none dropped;
5. packing: token sequences of at most 2048.

Defined results: null and empty texts, and those without a letter, are in no
language and go first; a row without doc_id teaches nothing and is never taken for a
copy, so it stays among near duplicates; rows that share a doc_id are one document
and share its fate; of documents that tie the smallest doc_id stays; a null lang
teaches nothing, a null source is a source of its own; further columns, whatever
their names, are kept to the last stage but one; an empty table gives no rows.  Very
long texts are taken whole by every stage.

SQL can't express fitting and applying the language field, SimHash or best-fit
packing, so ``ORACLE_SQL`` is None and the tests hold ``run`` against a
brute-force version.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chronofold.llm import language, mixing, packing, quality, simhash
from chronofold.llm._common import materialise, table


def keep_known_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return language.keep_known(docs, language.learn(docs, lambda doc_id: F.lit(True)))


def keep_good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.keep_good(docs)


def keep_one_of_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return simhash.one_of_each(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mix(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs).select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")


STAGES = [
    ("language", keep_known_languages),
    ("quality", keep_good_quality),
    ("near duplicates", keep_one_of_near_duplicates),
    ("mixing", mix_sources),
    ("packing", pack_sequences),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialise(stage(spark, docs, sf_dir), f"pipeline-{name.replace(' ', '-')}")
    return docs
