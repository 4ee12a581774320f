"""Canonical binary forms: commands, frames, segments, snapshots, file names.

Commands, digests and names are native expressions; whole files are read and
written by the Python codec below them (``sources.segments``).  All integers are
little-endian.  Native expressions work on upper-case hex, as ``reverse`` and
``substring`` of binary are not byte-exact in SQL.
"""

from __future__ import annotations

import functools
import hashlib
import io
import itertools
import struct
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chronofold import model
from chronofold.model import DELETE, PUT, ChangelogError


@dataclass(frozen=True)
class FormatSpec:
    """Magic numbers and hash domains; give other ones to read files of another writer."""

    # Fixed values of the on-disk format.
    segment_magic: bytes = b"RVTL"
    frame_magic: bytes = b"RVTW"
    snapshot_magic: bytes = b"RVTS"
    version: int = 1
    # Domains of this library; a digest made under another domain differs.
    command_domain: str = "chronofold.command.v1\x00"
    state_domain: str = "chronofold.state.v1\x00"


DEFAULT = FormatSpec()


# -- native expressions ------------------------------------------------------


def le_hex(n: Column, size: int) -> Column:
    """``n`` >= 0 as little-endian hex of ``size`` bytes."""
    big = F.lpad(F.hex(n.cast("long")), 2 * size, "0")
    return F.concat(*(F.substring(big, 2 * i + 1, 2) for i in range(size - 1, -1, -1)))


def le_u64_hex(n: Column) -> Column:
    return le_hex(n, 8)


def from_le_hex(h: Column) -> Column:
    """Little-endian hex to a number; null beyond a signed 64-bit number."""
    bytes_ = F.regexp_extract_all(h, F.lit("(..)"), F.lit(1))
    return F.conv(F.array_join(F.reverse(bytes_), ""), 16, 10).cast("decimal(20,0)").try_cast("long")


def client_hex(client: Column) -> Column:
    """16 bytes: the number, then zeros."""
    return F.concat(le_u64_hex(client), F.lit("00" * 8))


def _hex(text: Column) -> Column:
    return F.hex(F.encode(F.coalesce(text, F.lit("")), "utf-8"))


def command_hex(kind: Column, client: Column, request: Column, key: Column, value: Column) -> Column:
    head = F.concat(F.lit("01"), le_hex(kind, 1), client_hex(client), le_u64_hex(request), le_hex(F.octet_length(key), 4), _hex(key))
    return F.when(kind == PUT, F.concat(head, le_hex(F.octet_length(value), 4), _hex(value))).otherwise(head)


def command_bytes(kind: Column, key: Column, value: Column) -> Column:
    """Encoded length, without encoding."""
    return (F.lit(model.COMMAND_FIXED_BYTES) + F.octet_length(key) + F.when(kind == PUT, 4 + F.octet_length(value)).otherwise(0)).cast("long")


def command_digest(kind: Column, key: Column, value: Column, spec: FormatSpec = DEFAULT) -> Column:
    """SHA-256 of what a retry must repeat: kind, key and value, not who asks."""
    size = lambda c: le_u64_hex(F.coalesce(F.octet_length(c), F.lit(0)))
    body = F.concat(F.lit(spec.command_domain.encode().hex().upper()), le_hex(kind, 1), size(key), _hex(key), size(value), _hex(value))
    return F.sha2(F.unhex(body), 256)


def session_hex() -> Column:
    """The 66-byte session entry, from the columns of a session table."""
    return F.concat(client_hex(F.col("client")), le_u64_hex(F.col("last_sequence")), F.upper("digest"), le_hex(F.col("result_kind"), 1), F.when(F.col("existed"), "01").otherwise("00"), le_u64_hex(F.col("applied_seq")))


def decode_command(h: Column, max_key: int = 1024, max_value: int = 1 << 20) -> Column:
    """A struct of the command in hex ``h``, or its ``error``."""
    part = lambda at, n: F.substr(h, 2 * F.lit(at) + 1 if isinstance(at, int) else 2 * at + 1, 2 * F.lit(n) if isinstance(n, int) else 2 * n)
    size = F.length(h) / 2
    kind, request, key_len = from_le_hex(part(1, 1)), from_le_hex(part(18, 8)), from_le_hex(part(26, 4))
    value_len = from_le_hex(part(30 + key_len, 4))
    rest = size - 30 - key_len
    error = (
        F.when(size < model.COMMAND_FIXED_BYTES, "short")
        .when(part(0, 1) != "01", "schema")
        .when(~kind.isin(PUT, DELETE), "kind")
        .when(part(2, 16) == "00" * 16, "zero client")
        .when(part(18, 8) == "00" * 8, "zero sequence")
        .when(request.isNull(), "sequence out of range")
        .when((key_len < 1) | (key_len > max_key), "key length")
        .when(rest < 0, "key truncated")
        .when((kind == DELETE) & (rest != 0), "trailing bytes")
        .when((kind == PUT) & (rest < 4), "value length truncated")
        .when((kind == PUT) & (value_len > max_value), "value length")
        .when((kind == PUT) & (rest != 4 + value_len), "value bytes")
    )
    good = lambda c: F.when(error.isNull(), c)
    text = lambda c: F.decode(F.unhex(c), "utf-8")
    return F.struct(
        good(kind.cast("int")).alias("kind"), good(from_le_hex(part(2, 8))).alias("client"), good(request).alias("request_seq"), good(text(part(30, key_len))).alias("key"),
        good(F.when(kind == PUT, text(part(34 + key_len, value_len)))).alias("value"), error.alias("error"),
    )


def segment_name(start: Column, end: Column) -> Column:
    """``end`` null: active."""
    digits = lambda c: F.lpad(c.cast("string"), 20, "0")
    return F.when(end.isNull(), F.concat(F.lit("wal-"), digits(start), F.lit(".active"))).otherwise(F.concat(F.lit("wal-"), digits(start), F.lit("-"), digits(end), F.lit(".sealed")))


def parse_segment_name(name: Column) -> Column:
    """start_seq, end_seq, sealed of a segment's file name, or an error."""
    n = lambda i: F.expr(f"try_cast(regexp_extract({name._jc.toString()}, '^wal-([0-9]{{20}})(-([0-9]{{20}}))?[.](active|sealed)$', {i}) AS bigint)")
    start, end = n(1), n(3)
    error = (
        F.when(~name.startswith("wal-"), "prefix")
        .when(~name.rlike("[.](active|sealed)$"), "suffix")
        .when(~name.rlike("^wal-[0-9]{20}([.]active|-[0-9]{20}[.]sealed)$"), "sequence field")
        .when(start.isNull() | (name.endswith(".sealed") & end.isNull()), "sequence out of range")
        .when(end < start, "ends before start")
    )
    good = lambda c: F.when(error.isNull(), c)
    return F.struct(good(start).alias("start_seq"), good(end).alias("end_seq"), good(name.endswith(".sealed")).alias("sealed"), error.alias("error"))


def parse_snapshot_name(name: Column) -> Column:
    n = F.expr(f"try_cast(regexp_extract({name._jc.toString()}, '^snapshot-([0-9]{{20}})[.](snap|tmp)$', 1) AS bigint)")
    error = F.when(~name.startswith("snapshot-"), "prefix").when(~name.rlike("[.](snap|tmp)$"), "suffix").when(~name.rlike("^snapshot-[0-9]{20}[.]"), "sequence field").when(n.isNull(), "sequence out of range")
    good = lambda c: F.when(error.isNull(), c)
    return F.struct(good(n).alias("seq"), good(name.endswith(".snap")).alias("final"), error.alias("error"))


def enum_names(spark) -> DataFrame:
    rows = [(kind, n, name) for kind, names in model.ENUMS.items() for n, name in names.items()]
    return spark.createDataFrame(rows, "enum string, number int, name string")


# -- the same in SQL, for the oracle -----------------------------------------


def le_sql(n: str, size: int) -> str:
    big = f"lpad(printf('%x', CAST({n} AS BIGINT)), {2 * size}, '0')"
    return "upper(" + " || ".join(f"substr({big}, {2 * i + 1}, 2)" for i in range(size - 1, -1, -1)) + ")"


def le_u64_sql(n: str) -> str:
    return le_sql(n, 8)


def _hex_sql(c: str) -> str:
    return f"hex(encode(coalesce({c}, '')))"


CLIENT_SQL = f"({le_u64_sql('client')} || '{'00' * 8}')"
COMMAND_SQL = (
    f"('01' || {le_sql('kind', 1)} || {CLIENT_SQL} || {le_u64_sql('request_seq')} || {le_sql('octet_length(encode(key))', 4)} || {_hex_sql('key')}"
    f" || CASE WHEN kind = 1 THEN {le_sql('octet_length(encode(value))', 4)} || {_hex_sql('value')} ELSE '' END)"
)
DIGEST_SQL = (
    f"sha256(unhex('{DEFAULT.command_domain.encode().hex().upper()}' || {le_sql('kind', 1)} || {le_u64_sql('octet_length(encode(key))')} || {_hex_sql('key')}"
    f" || {le_u64_sql('coalesce(octet_length(encode(value)), 0)')} || {_hex_sql('value')}))"
)
SESSION_SQL = f"({CLIENT_SQL} || {le_u64_sql('last_sequence')} || upper(digest) || {le_sql('result_kind', 1)} || CASE WHEN existed THEN '01' ELSE '00' END || {le_u64_sql('applied_seq')})"


# -- whole files ---------------------------------------------------------------


def _crc32c_table() -> list[int]:
    """The 256 steps of the reflected Castagnoli polynomial."""
    table = []
    for n in range(256):
        for _ in range(8):
            n = n >> 1 ^ (0x82F63B78 if n & 1 else 0)
        table.append(n)
    return table


_TABLE = _crc32c_table()
_STEPS = np.array(_TABLE, np.uint32)
#: Spans below this are taken byte by byte; longer ones in lanes, so many bytes at once.
_SHORT, _AT_ONCE = 256, 1 << 20
#: Spans taken side by side at the least.
_FEW_SPANS = 8


def _through(tables: np.ndarray, state: np.ndarray) -> np.ndarray:
    return tables[0][state & 255] ^ tables[1][state >> 8 & 255] ^ tables[2][state >> 16 & 255] ^ tables[3][state >> 24]


@functools.cache
def _zeros(log2: int) -> np.ndarray:
    """What 2**log2 zero bytes make of each value of each of a register's four bytes."""
    if log2:
        half = _zeros(log2 - 1)
        return _through(half, half)
    state = np.arange(256, dtype=np.uint32) << np.arange(0, 32, 8, dtype=np.uint32)[:, None]
    return state >> 8 ^ _STEPS[state & 255]


def _lanes(data, state: int) -> int:
    """The register after ``data``: equal lanes side by side, then joined in pairs, as the register is linear."""
    log2 = max(4, len(data).bit_length() // 2 - 2)
    lanes = 1 << (-(-len(data) >> log2) - 1).bit_length()
    padded = np.zeros(lanes << log2, np.uint8)  # zeros in front leave an empty register empty
    padded[-len(data) :] = np.frombuffer(data, np.uint8)
    padded[-len(data) :][:4] ^= np.frombuffer(struct.pack("<I", state), np.uint8)
    found = np.zeros(lanes, np.uint32)
    for column in np.ascontiguousarray(padded.reshape(lanes, -1).T):
        found = found >> 8 ^ _STEPS[(found ^ column) & 255]
    while len(found) > 1:
        found = _through(_zeros(log2), found[::2]) ^ found[1::2]
        log2 += 1
    return int(found[0])


def crc32c(data, crc: int = 0) -> int:
    state = crc ^ 0xFFFFFFFF
    if len(data) < _SHORT:
        for b in data:
            state = state >> 8 ^ _TABLE[(state ^ b) & 255]
    else:
        for at in range(0, len(data) - len(data) % _AT_ONCE, _AT_ONCE):
            state = _lanes(data[at : at + _AT_ONCE], state)
        if rest := len(data) % _AT_ONCE:
            return crc32c(data[-rest:], state ^ 0xFFFFFFFF) if rest < _SHORT else _lanes(data[-rest:], state) ^ 0xFFFFFFFF
    return state ^ 0xFFFFFFFF


def crc32c_each(data, starts: np.ndarray, sizes: np.ndarray, crcs: np.ndarray | None = None) -> np.ndarray:
    """Checksums of many spans of ``data``, side by side; ``crcs`` are those of what comes before each."""
    octets = np.frombuffer(data, np.uint8)
    order = np.argsort(-sizes, kind="stable")
    at, size = starts[order], sizes[order]
    state = ~(np.zeros(len(order), np.uint32) if crcs is None else crcs[order])
    step, open_spans = 0, int(np.count_nonzero(size > 0))
    while open_spans >= _FEW_SPANS:
        now = state[:open_spans]
        state[:open_spans] = now >> 8 ^ _STEPS[(now ^ octets[at[:open_spans] + step]) & 255]
        step += 1
        open_spans = int(np.searchsorted(-size, -step))
    for i in range(open_spans):
        state[i] = crc32c(data[at[i] + step : at[i] + size[i]], int(state[i]) ^ 0xFFFFFFFF) ^ 0xFFFFFFFF
    out = np.empty_like(state)
    out[order] = ~state
    return out


class Incomplete(Exception):
    """The bytes end before the frame does."""


def _corrupt(holds: bool, detail: str, cause: Exception | None = None) -> None:
    if not holds:
        raise ChangelogError("CORRUPTION", detail, cause)


def encode_command(kind: int, client: bytes, request: int, key: bytes, value: bytes | None) -> bytes:
    out = struct.pack("<BB16sQI", 1, kind, client, request, len(key)) + key
    return out + struct.pack("<I", len(value)) + value if kind == PUT else out


def digest_command(kind: int, key: bytes, value: bytes | None, spec: FormatSpec = DEFAULT) -> bytes:
    value = value or b""
    return hashlib.sha256(spec.command_domain.encode() + bytes([kind]) + struct.pack("<Q", len(key)) + key + struct.pack("<Q", len(value)) + value).digest()


def encode_segment_header(start: int, spec: FormatSpec = DEFAULT) -> bytes:
    head = spec.segment_magic + struct.pack("<BHQ13x", spec.version, model.SEGMENT_HEADER_BYTES, start)
    return head + struct.pack("<I", crc32c(head))


def decode_segment_header(data: bytes, spec: FormatSpec = DEFAULT) -> int:
    _corrupt(len(data) >= model.SEGMENT_HEADER_BYTES, "segment header: short")
    version, size, start = struct.unpack_from("<BHQ", data, 4)
    _corrupt(data[:4] == spec.segment_magic, "segment header: magic")
    _corrupt(version == spec.version, "segment header: version")
    _corrupt(size == model.SEGMENT_HEADER_BYTES, "segment header: length")
    _corrupt(not any(data[15:28]), "segment header: reserved bytes")
    _corrupt(struct.unpack_from("<I", data, 28)[0] == crc32c(data[:28]), "segment header: checksum")
    return start


def encode_frame(seq: int, payload: bytes, spec: FormatSpec = DEFAULT) -> bytes:
    head = spec.frame_magic + struct.pack("<BBHQI", spec.version, 1, 0, seq, len(payload))
    return head + struct.pack("<I", crc32c(payload, crc32c(head))) + payload


def encode_frames(seqs: list[int], payloads: list[bytes], spec: FormatSpec = DEFAULT) -> list[bytes]:
    """Many frames, their checksums side by side."""
    heads = [spec.frame_magic + struct.pack("<BBHQI", spec.version, 1, 0, seq, len(payload)) for seq, payload in zip(seqs, payloads, strict=True)]
    sizes = np.array([len(h) + len(p) for h, p in zip(heads, payloads, strict=True)], np.int64)
    crcs = crc32c_each(b"".join(h + p for h, p in zip(heads, payloads, strict=True)), np.cumsum(sizes) - sizes, sizes)
    return [h + struct.pack("<I", c) + p for h, c, p in zip(heads, crcs.tolist(), payloads, strict=True)]


def _frame_head(data, at: int, max_payload: int, spec: FormatSpec) -> tuple[int, int, int]:
    """(sequence, size, checksum) of the frame at ``at``, which is there in full."""
    if len(data) - at < model.FRAME_HEADER_BYTES:
        raise Incomplete
    version, record, flags, seq, declared, crc = struct.unpack_from("<BBHQII", data, at + 4)
    _corrupt(data[at : at + 4] == spec.frame_magic, "frame: magic")
    _corrupt(version == spec.version, "frame: version")
    _corrupt(record == 1, "frame: record type")
    _corrupt(flags == 0, "frame: flags")
    _corrupt(declared <= max_payload, "frame: declared length")
    size = model.FRAME_HEADER_BYTES + declared
    if len(data) - at < size:
        raise Incomplete
    return seq, size, crc


def _bad_checksum(size: int) -> ChangelogError:
    error = ChangelogError("CORRUPTION", "frame: checksum")
    error.size = size
    return error


def decode_frame(data: bytes, max_payload: int, spec: FormatSpec = DEFAULT) -> tuple[int, bytes, int]:
    """(sequence, payload, size).  A checksum error carries the frame's ``size``; others have size 0."""
    seq, size, crc = _frame_head(data, 0, max_payload, spec)
    payload = data[model.FRAME_HEADER_BYTES : size]
    if crc32c(payload, crc32c(data[:20])) != crc:
        raise _bad_checksum(size)
    return seq, bytes(payload), size


def decode_frames(data: bytes, at: int, max_payload: int, spec: FormatSpec = DEFAULT) -> tuple[list[tuple[int, int, int]], Exception | None]:
    """(offset, size, sequence) of the frames from ``at`` on, up to the first that ``decode_frame`` refuses, and its error."""
    found, crcs, error = [], [], None
    while at < len(data) and error is None:
        try:
            seq, size, crc = _frame_head(data, at, max_payload, spec)
        except (Incomplete, ChangelogError) as e:
            error = e
        else:
            found.append((at, size, seq))
            crcs.append(crc)
            at += size
    if found:
        starts, sizes = np.array([f[0] for f in found]), np.array([f[1] for f in found])
        heads = crc32c_each(data, starts, np.full(len(found), 20))
        bad = np.flatnonzero(crc32c_each(data, starts + model.FRAME_HEADER_BYTES, sizes - model.FRAME_HEADER_BYTES, heads) != np.array(crcs, np.uint32))
        if len(bad):
            return found[: bad[0]], _bad_checksum(found[bad[0]][1])
    return found, error


def encode_snapshot_header(applied: int, keys: int, clients: int, size: int, spec: FormatSpec = DEFAULT) -> bytes:
    """All of the header but the checksum, which covers it and the payload of ``size`` bytes."""
    return spec.snapshot_magic + struct.pack("<B3xQQQQ", spec.version, applied, keys, clients, size)


def encode_snapshot(applied: int, kv: dict[bytes, bytes], sessions: dict[bytes, tuple], spec: FormatSpec = DEFAULT) -> bytes:
    """``sessions``: client -> (last sequence, digest, kind, existed, applied sequence)."""
    parts = [struct.pack("<I", len(k)) + k + struct.pack("<I", len(v)) + v for k, v in sorted(kv.items())]
    parts += [c + struct.pack("<Q32sBBQ", *s) for c, s in sorted(sessions.items())]
    payload = b"".join(parts)
    head = encode_snapshot_header(applied, len(kv), len(sessions), len(payload), spec)
    return head + struct.pack("<I", crc32c(payload, crc32c(head))) + payload


def decode_snapshot_header(data: bytes, settings: model.StorageSettings | None = None, spec: FormatSpec = DEFAULT) -> tuple[int, int, int, int, int]:
    """(applied, keys, sessions, payload bytes, checksum); counts are bounded only where ``settings`` are given."""
    _corrupt(len(data) >= model.SNAPSHOT_HEADER_BYTES, "snapshot: short")
    _corrupt(data[:4] == spec.snapshot_magic, "snapshot: magic")
    _corrupt(data[4] == spec.version, "snapshot: version")
    _corrupt(not any(data[5:8]), "snapshot: reserved bytes")
    head = struct.unpack_from("<QQQQI", data, 8)
    _corrupt(settings is None or (head[1] <= settings.max_keys and head[2] <= settings.max_sessions and head[3] <= settings.max_snapshot_payload), "snapshot: a count is out of range")
    return head


def snapshot_entries(read, head: tuple[int, int, int, int, int], settings: model.StorageSettings | None = None):
    """(key, value) pairs and then (client, entry) pairs of the payload that ``read(n)`` gives; lengths are bounded only where ``settings`` are given."""
    applied, keys, clients, size, _ = head
    at, last = 0, b""

    def take(n: int) -> bytes:
        nonlocal at
        _corrupt(at + n <= size, "snapshot: payload ends early")
        at += n
        return read(n)

    for _ in range(keys):
        n = struct.unpack("<I", take(4))[0]
        _corrupt(1 <= n and (settings is None or n <= settings.max_key_bytes), "snapshot: key length")
        key = take(n)
        _corrupt(key > last, "snapshot: key order")
        last = key
        n = struct.unpack("<I", take(4))[0]
        _corrupt(settings is None or n <= settings.max_value_bytes, "snapshot: value length")
        yield key, take(n)
    last = bytes(16)
    for _ in range(clients):
        client = take(16)
        _corrupt(client > last, "snapshot: client order")
        last = client
        entry = struct.unpack("<Q32sBBQ", take(50))
        _corrupt(entry[0] > 0 and entry[2] in (PUT, DELETE) and entry[3] in (0, 1) and entry[4] <= applied, "snapshot: session entry")
        yield client, (*entry[:3], bool(entry[3]), entry[4])
    _corrupt(at == size, "snapshot: trailing bytes")


def decode_snapshot(data: bytes, settings: model.StorageSettings | None = None, spec: FormatSpec = DEFAULT) -> tuple[int, dict, dict]:
    s = (settings or model.StorageSettings()).checked()
    head = decode_snapshot_header(data, s, spec)
    payload = data[model.SNAPSHOT_HEADER_BYTES :]
    _corrupt(len(payload) == head[3], "snapshot: payload length")
    _corrupt(crc32c(payload, crc32c(data[:40])) == head[4], "snapshot: checksum")
    entries = snapshot_entries(io.BytesIO(payload).read, head, s)
    return head[0], dict(itertools.islice(entries, head[1])), dict(entries)
