"""Token counts, token shards and packing against the tokenisers' own results."""

import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from chronofold.llm import packing, token_counts, token_shards
from chronofold.llm._common import shared_dir
from chronofold.llm.pretokens import IdEncoder, PieceCounter, piece_keys
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from tests.conftest import SF_TINY
from tests.llm.conftest import documents

TEXT = st.text(alphabet=st.one_of(st.sampled_from(" \n\tab.'sS,!▁é́  \x1c\x00ßΣ1<|>ñÉ"), st.characters(codec="utf-8")), max_size=60)
LIBRARIES = {n: Tokenizer.from_file(public_tokenizers.path(n)) for n in ("byte_bpe_50k.json", "word_bpe_49k.json")}
CODERS = {n: IdEncoder(n) for n in ("byte_bpe_50k.json", "word_bpe_49k.json")}
COUNTER = PieceCounter("piece_bpe_32k.model")


def ids(name, text, end):
    found = LIBRARIES[name].encode(text or "", add_special_tokens=False).ids
    return np.array([*found, end], dtype="<u4")


@settings(max_examples=400, deadline=None)
@given(TEXT)
def test_parts_give_the_ids_of_the_whole(text):
    for coder in CODERS.values():
        assert coder.encode(text) == coder.whole(text)


@settings(max_examples=400, deadline=None)
@given(TEXT)
def test_parts_give_the_pieces_of_the_whole(text):
    assert COUNTER.count(text) == len(COUNTER.library.encode(text))


def test_a_full_cache_starts_anew():
    coder = IdEncoder("byte_bpe_50k.json", limit=4)
    text = "one two three four five six seven one two three"
    assert coder.encode(text) == coder.whole(text) and len(coder.words) <= 4


@pytest.mark.parametrize("head", [token_counts.HEAD_ENTRIES, 300, 0])
def test_token_counts(spark, edge, empty, head):
    """With all, some and no pre-tokens in the table that every task gets."""
    for docs in (documents(spark, SF_TINY), edge):
        rows = docs.select("doc_id", "text").collect()
        want = sorted(((r[0], len((r[1] or "").encode()), len(COUNTER.library.encode(r[1] or ""))) for r in rows), key=str)
        assert sorted((tuple(r) for r in token_counts.count_tokens(docs, head_entries=head).collect()), key=str) == want
    assert token_counts.count_tokens(empty, head_entries=head).collect() == []


def test_each_distinct_pre_token_is_listed_once(spark, monkeypatch):
    docs = documents(spark, SF_TINY).where("text IS NOT NULL").select("text").repartition(5)
    want = Counter(k for r in docs.collect() for k in piece_keys(r["text"]))
    known = token_counts.distinct_pre_tokens(docs, token_counts.VOCABULARY, held_entries=50).collect()
    assert {r["part"]: r["n"] for r in known} == want and len(known) == len(want)
    assert all(r["pieces"] == COUNTER.pieces(r["part"]) for r in known[:500])


def test_registered_token_counts(spark):
    rows = token_counts.op1_token_counts(spark, SF_TINY).collect()
    assert rows[0].asDict().keys() == {"doc_id", "n_bytes", "n_tokens", "over_limit"}
    texts = {r["doc_id"]: r["text"] or "" for r in documents(spark, SF_TINY).collect()}
    assert len(rows) == len(texts)
    for r in rows:
        n = len(COUNTER.library.encode(texts[r["doc_id"]]))
        assert (r["n_tokens"], r["over_limit"], r["n_bytes"]) == (n, n > 4096, len(texts[r["doc_id"]].encode()))


def shard_rows(spark, docs):
    shards = token_shards.write_shards(docs, shared_dir(spark, "test-sst"))
    return shards, [tuple(r) for r in token_shards.read_shards(shards).collect()]


def test_shards(spark, edge, empty):
    docs = documents(spark, SF_TINY)
    start, want = 0, []
    for r in docs.orderBy("doc_id").collect():
        own = ids("word_bpe_49k.json", r["text"], 2)
        want.append((r["doc_id"], start, len(own), zlib.crc32(own.tobytes())))
        start += len(own)
    shards, got = shard_rows(spark, docs)
    assert sorted(got) == want
    # binary-search lookup of each id, and of ids that are not there
    readers = [token_shards.ShardReader(r["path"]) for r in shards.orderBy("shard").collect()]
    for doc_id, _, n, crc in want[:40]:
        (found,) = [x for r in readers for x in r.get(doc_id)]
        assert len(found[1]) == n and zlib.crc32(found[1].astype("<u4").tobytes()) == crc
    assert not [x for r in readers for i in (-5, 10**12) for x in r.get(i)]
    # nulls first, repeated ids kept, starts without gaps
    _, got = shard_rows(spark, edge)
    got.sort(key=lambda r: r[1])
    assert [r[0] for r in got] == sorted((r["doc_id"] for r in edge.collect()), key=lambda x: (x is not None, x))
    assert all(a[1] + a[2] == b[1] for a, b in zip(got, got[1:]))
    assert shard_rows(spark, empty)[1] == []


def test_damage_in_a_block_is_seen(spark, tmp_path):
    path = str(tmp_path / "x.sst")
    writer = token_shards.ShardWriter(open(path, "wb"), 2)
    for i in range(300):
        writer.add(token_shards.key_of(i), np.arange(i))
    writer.close()
    assert [len(x[2]) for x in token_shards.ShardReader(path).scan()] == list(range(300))
    data = bytearray(open(path, "rb").read())
    data[20] ^= 1
    open(path, "wb").write(data)
    with pytest.raises(ValueError, match="damaged"):
        list(token_shards.ShardReader(path).scan())


def check_packed(rows, texts):
    """Pieces cover each document once, agree with the library, and fill sequences without gaps."""
    by_sequence = {}
    for r in rows:
        by_sequence.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for pieces in by_sequence.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at <= packing.WINDOW
    want = sorted((d, at, zlib.crc32(own[at : at + packing.WINDOW].tobytes()), len(own)) for d, t in texts for own in [ids("byte_bpe_50k.json", t, 1)] for at in range(0, len(own), packing.WINDOW))
    assert sorted((-1 if r["doc_id"] is None else r["doc_id"], r["start"], r["ids_crc32"], r["doc_tokens"]) for r in rows) == want
    return sum(r["length"] for r in rows) / packing.WINDOW / len(by_sequence)


def test_packing(spark, edge, empty):
    docs = documents(spark, SF_TINY)
    texts = [tuple(r) for r in docs.select("doc_id", "text").collect()]
    assert check_packed(packing.pack(docs).collect(), texts) > 0.97
    check_packed(packing.pack(docs, group_pieces=50).collect(), texts)
    edge_texts = [(-1 if r["doc_id"] is None else r["doc_id"], r["text"]) for r in edge.collect()]
    check_packed(packing.pack(edge).collect(), edge_texts)
    assert packing.pack(empty).collect() == []


def test_packed_ids(spark):
    docs = documents(spark, SF_TINY).limit(20)
    packed = packing.pack(docs, with_ids=True)
    assert all(zlib.crc32(r["ids"]) == r["ids_crc32"] for r in packed.collect())
    assert all(sum(map(len, r["parts"])) == 4 * r["length"] for r in packing.sequences(packed).collect())


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(1, 64), max_size=80))
def test_best_fit_decreasing_against_a_search(lengths):
    which, offset = packing.best_fit_decreasing(lengths, 64)
    left, want = [], []
    for n in sorted(lengths, reverse=True):
        fits = [(x, i) for i, x in enumerate(left) if x >= n]
        if fits:
            i = min(fits)[1]
            left[i] -= n
        else:
            left.append(64 - n)
        want.append(sorted(left))
    got = {}
    for n, w, o in zip(lengths, which.tolist(), offset.tolist()):
        got.setdefault(w, []).append((o, n))
    assert sorted(64 - sum(n for _, n in x) for x in got.values()) == (want[-1] if want else [])
