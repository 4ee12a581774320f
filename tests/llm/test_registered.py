"""The registered queries that SQL can't express, all columns, against plain versions."""

import zlib

import __spark_entry__
import pytest

from tests.conftest import SF_TINY
from tests.llm.conftest import documents
from tests.llm.test_simhash import brute
from tests.llm.test_tokens import check_packed, ids


@pytest.fixture(scope="module")
def texts(spark):
    return [tuple(r) for r in documents(spark, SF_TINY).select("doc_id", "text").collect()]


def rows_of(spark, name):
    return __spark_entry__.queries()[name](spark, SF_TINY)


def test_token_shards(spark, texts):
    found = rows_of(spark, "op3_token_shards")
    want, start = [], 0
    for doc_id, text in sorted(texts):
        own = ids("word_bpe_49k.json", text, 2)
        want.append((doc_id, start, len(own), zlib.crc32(own.tobytes())))
        start += len(own)
    assert sorted(tuple(r) for r in found.select("doc_id", "start", "n_tokens", "ids_crc32").collect()) == want
    assert {n: t for n, t in found.dtypes if n != "doc_id"}.items() >= {"start": "bigint", "n_tokens": "bigint", "ids_crc32": "bigint"}.items()


def test_simhash(spark, texts):
    found = rows_of(spark, "op6_simhash_gray")
    assert found.columns == ["doc_id", "fingerprint", "component_id"]
    assert sorted((tuple(r) for r in found.collect()), key=str) == brute(texts)


def test_packing(spark, texts):
    found = rows_of(spark, "op10_packing")
    assert found.columns == ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
    assert {t for _, t in found.dtypes} == {"bigint"}
    assert check_packed(found.collect(), texts) > 0.97
