import dataclasses
import hashlib
import random
import struct

import numpy as np
import pytest
from chronofold.functions import codec
from chronofold.model import ChangelogError, ConsensusSettings, StorageSettings, code_of
from hypothesis import given, settings
from hypothesis import strategies as st

CLIENT = (1).to_bytes(8, "little") + bytes(8)


def test_crc32c_check_value():
    assert codec.crc32c(b"123456789") == 0xE3069283


def byte_by_byte(data, crc=0):
    state = crc ^ 0xFFFFFFFF
    for b in data:
        state ^= b
        for _ in range(8):
            state = state >> 1 ^ (0x82F63B78 if state & 1 else 0)
    return state ^ 0xFFFFFFFF


@pytest.mark.parametrize("n", [0, 1, 255, 256, 257, 5000, 65537, (1 << 20) - 1, (1 << 20) + 3, (1 << 20) + 256])
def test_long_checksums_are_those_of_each_byte(n):
    data = random.Random(n).randbytes(n)
    assert codec.crc32c(data, 12345) == byte_by_byte(data, 12345)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 900), st.integers(0, 100), st.integers(0, 2**32 - 1)), max_size=40))
def test_checksums_side_by_side(spans):
    data = random.Random(1).randbytes(1000)
    starts, sizes, crcs = (np.array([x[i] for x in spans], np.int64) for i in range(3))
    assert codec.crc32c_each(data, starts, sizes, crcs.astype(np.uint32)).tolist() == [byte_by_byte(data[a : a + n], c) for a, n, c in spans]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.binary(max_size=30), min_size=1, max_size=20), st.integers(0, 400), st.integers(0, 255))
def test_many_frames_are_read_as_one_by_one(payloads, at, new):
    frames = codec.encode_frames(list(range(1, len(payloads) + 1)), payloads)
    assert frames == [codec.encode_frame(i, p) for i, p in enumerate(payloads, 1)]
    data = b"".join(frames)
    data = broken(data, at, bytes([new])) if at < len(data) else data[:-1]  # a byte of some frame, or the end cut off
    want, offset, error = [], 0, None
    while offset < len(data) and error is None:
        try:
            seq, _, size = codec.decode_frame(data[offset:], 25)
        except (codec.Incomplete, ChangelogError) as e:
            error = e
        else:
            want.append((offset, size, seq))
            offset += size
    got, found = codec.decode_frames(data, 0, 25)
    assert got == want
    assert type(found) is type(error) and str(found) == str(error) and getattr(found, "size", 0) == getattr(error, "size", 0)


# vectors of the format: PUT of alpha = beta, client 1, request 1
def test_format_vectors():
    command = codec.encode_command(1, CLIENT, 1, b"alpha", b"beta")
    assert command.hex() == "010101000000000000000000000000000000010000000000000005000000616c7068610400000062657461"
    assert codec.encode_frame(1, command).hex() == "525654570101000001000000000000002b0000009802e58b" + command.hex()
    assert codec.encode_segment_header(1).hex() == "5256544c012000010000000000000000000000000000000000000000bf97ea2f"


def test_digest_leaves_out_identity_and_tells_kinds_apart():
    spec = codec.FormatSpec(command_domain="x\x00")
    body = b"x\x00" + b"\x01" + struct.pack("<Q", 1) + b"k" + struct.pack("<Q", 0)
    assert codec.digest_command(1, b"k", b"", spec) == hashlib.sha256(body).digest()
    assert codec.digest_command(1, b"k", b"") != codec.digest_command(2, b"k", None)


def test_native_digest_equals_the_codec(spark):
    from pyspark.sql import functions as F

    rows = spark.createDataFrame([(1, "é", "v"), (1, "k", ""), (2, "k", None)], "kind int, key string, value string")
    for r in rows.withColumn("d", codec.command_digest(F.col("kind"), F.col("key"), F.col("value"))).collect():
        assert r["d"] == codec.digest_command(r["kind"], r["key"].encode(), None if r["value"] is None else r["value"].encode()).hex()


def broken(data, at, new):
    return data[:at] + new + data[at + len(new) :]


@pytest.mark.parametrize("at, new, what", [(0, b"XXXX", "magic"), (4, b"\x09", "version"), (5, b"\x21", "length"), (20, b"\x01", "reserved"), (28, b"\0\0\0\0", "checksum")])
def test_segment_header_rejections(at, new, what):
    with pytest.raises(ChangelogError, match=what):
        codec.decode_segment_header(broken(codec.encode_segment_header(7), at, new))


@pytest.mark.parametrize("at, new, what", [(0, b"X", "magic"), (4, b"\x02", "version"), (5, b"\x02", "record type"), (6, b"\x01", "flags"), (16, b"\xff\xff\xff\xff", "declared"), (25, b"\x77", "checksum")])
def test_frame_rejections(at, new, what):
    frame = codec.encode_frame(3, b"some payload")
    with pytest.raises(ChangelogError, match=what):
        codec.decode_frame(broken(frame, at, new), 1000)


def test_every_prefix_of_a_frame_is_incomplete():
    frame = codec.encode_frame(3, b"payload")
    for n in range(len(frame)):
        with pytest.raises(codec.Incomplete):
            codec.decode_frame(frame[:n], 1000)


def snapshot(n=9):
    kv = {bytes([97 + i % 26, i]): bytes([i]) * (i % 9) for i in range(n)}
    sessions = {(i + 1).to_bytes(8, "little") + bytes(8): (i + 1, bytes(32), 1, True, i + 1) for i in range(5)}
    return 20, kv, sessions


def test_snapshot_round_trip_and_rejections():
    data = codec.encode_snapshot(*snapshot())
    assert codec.decode_snapshot(data) == snapshot()
    for bad in (data[:10], broken(data, 0, b"X"), broken(data, 4, b"\x02"), broken(data, 6, b"\x01"), broken(data, 50, b"\xfe"), broken(data, 40, b"\0\0\0\0"), data[:-1], data + b"\0"):
        with pytest.raises(ChangelogError):
            codec.decode_snapshot(bad)


@settings(max_examples=60, deadline=None)
@given(st.binary(max_size=80), st.integers(0, 2**63 - 1))
def test_frames_are_canonical(payload, seq):
    frame = codec.encode_frame(seq, payload)
    assert codec.decode_frame(frame + b"more", 1000) == (seq, payload, len(frame))


@pytest.mark.parametrize("bad", [{"max_key_bytes": 1025}, {"max_value_bytes": -1}, {"max_keys": -1}, {"max_sessions": 1 << 21}, {"queue_capacity": 1 << 17}, {"segment_target_bytes": 1023}, {"close_timeout_s": -1}])
def test_storage_settings(bad):
    assert StorageSettings().checked().max_keys == 1_000_000
    with pytest.raises(ChangelogError) as e:
        StorageSettings(**bad).checked()
    assert code_of(e.value) == "INVALID_ARGUMENT"


GOOD = ConsensusSettings(node=1, peers=(1, 2, 3))


@pytest.mark.parametrize("bad", [{"node": 0}, {"peers": ()}, {"peers": (1, 0)}, {"peers": (1, 2, 2)}, {"peers": (2, 3)}, {"heartbeat_ticks": -1}, {"election_tick_min": 1}, {"election_tick_max": 10}, {"max_entries": -1}, {"max_bytes": -1}])
def test_consensus_settings(bad):
    assert GOOD.checked().quorum == 2
    with pytest.raises(ChangelogError):
        dataclasses.replace(GOOD, **bad).checked()


def test_code_of_looks_through_causes():
    assert code_of(ChangelogError("STORAGE", "x", ValueError())) == "STORAGE"
    try:
        raise RuntimeError from ChangelogError("LOCKED")
    except RuntimeError as e:
        assert code_of(e) == "LOCKED"
    assert code_of(ValueError()) == "UNKNOWN"
