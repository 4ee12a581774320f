import os

import duckdb
import pytest
from chronofold.functions import codec
from chronofold.model import ChangelogError, StorageSettings
from chronofold.sources import segments
from chronofold.sources.segments import client_bytes, recover

from tests.oracle import rows_of, rows_of_sql


def frames(low, high):
    return [codec.encode_frame(i, codec.encode_command(1, client_bytes(1), i, b"k%d" % i, b"v")) for i in range(low, high + 1)]


def write(folder, name, start, parts, header=None):
    with open(os.path.join(folder, name), "wb") as f:
        f.write(codec.encode_segment_header(start) if header is None else header)
        f.write(b"".join(parts))


SEALED, ACTIVE = f"wal-{1:020d}-{3:020d}.sealed", f"wal-{4:020d}.active"


@pytest.fixture
def folder(tmp_path):
    write(tmp_path, SEALED, 1, frames(1, 3))
    write(tmp_path, ACTIVE, 4, frames(4, 6))
    return str(tmp_path)


def seqs(found):
    return sorted(r["seq"] for r in found.select("seq").collect())


def test_all_frames(spark, folder):
    found, dropped = recover(spark, folder)
    assert seqs(found) == [1, 2, 3, 4, 5, 6] and dropped == 0
    assert seqs(recover(spark, folder, 2)[0]) == [3, 4, 5, 6]


def test_the_data_source_gives_the_same_rows(spark, folder):
    spark.dataSource.register(segments.SegmentSource)
    rows = spark.read.format("changelog_segments").load(folder)
    assert sorted(map(str, rows.collect())) == sorted(map(str, segments.read_frames(spark, folder).collect()))
    assert {r["name"] for r in segments.list_files(spark, folder).collect()} == {SEALED, ACTIVE}


@pytest.mark.parametrize("cut", [1, 17, 31])
def test_torn_tail_goes(spark, folder, cut):
    torn = b"".join(frames(4, 6))
    size = len(frames(6, 6)[0])
    write(folder, ACTIVE, 4, [torn[:-cut]])
    found, dropped = recover(spark, folder)
    assert seqs(found) == [1, 2, 3, 4, 5] and dropped == size - cut


def test_damaged_last_record_goes(spark, folder):
    data = b"".join(frames(4, 6))
    write(folder, ACTIVE, 4, [data[:-1] + b"?"])
    assert seqs(recover(spark, folder)[0]) == [1, 2, 3, 4, 5]


@pytest.mark.parametrize("spoil", ["interior", "sealed tail", "version", "gap", "name", "short of its name"])
def test_the_rest_fails_closed(spark, folder, spoil):
    if spoil == "interior":
        data = b"".join(frames(4, 6))
        write(folder, ACTIVE, 4, [data[:30] + b"?" + data[31:]])
    elif spoil == "sealed tail":
        write(folder, SEALED, 1, [b"".join(frames(1, 3))[:-1]])
    elif spoil == "version":
        write(folder, ACTIVE, 4, frames(4, 6), header=b"RVTL\x09" + bytes(27))
    elif spoil == "gap":
        os.remove(os.path.join(folder, ACTIVE))
        write(folder, f"wal-{6:020d}.active", 6, frames(6, 6))
    elif spoil == "name":
        write(folder, "wal-1.active", 1, [])
    else:
        write(folder, SEALED, 1, frames(1, 2))
    with pytest.raises(ChangelogError) as e:
        recover(spark, folder)
    assert e.value.code == "CORRUPTION"


def test_snapshot_file_round_trip(spark, tmp_path):
    rows = [(1, 1, 1, 1, "b", "x"), (2, 1, 2, 1, "a", ""), (3, 2, 1, 2, "b", None), (4, 2, 2, 1, "é", "y")]
    commands = spark.createDataFrame(rows, "global_seq long, client long, request_seq long, kind int, key string, value string")
    name = segments.write_snapshot(commands, str(tmp_path))
    assert {(r["key"], r["value"], r["applied"]) for r in segments.read_snapshot(spark, str(tmp_path), name).collect()} == {("a", "", 4), ("é", "y", 4)}
    assert [x for x in os.listdir(tmp_path) if not x.startswith(".")] == [name]


def many_clients(spark, n):
    """One PUT of each of ``n`` clients, every key its own."""
    return spark.range(1, n + 1).selectExpr("id AS global_seq", "id AS client", "1L AS request_seq", "1 AS kind", "concat('k', id) AS key", "concat('v', id) AS value")


def test_a_snapshot_file_holds_more_sessions_than_the_default_limit(spark, tmp_path):
    n = StorageSettings().checked().max_sessions + 1
    name = segments.write_snapshot(many_clients(spark, n), str(tmp_path))
    rows = segments.read_snapshot(spark, str(tmp_path), name)
    assert {tuple(r) for r in rows.collect()} == {(f"k{i}", f"v{i}", n, n) for i in range(1, n + 1)}
    data = (tmp_path / name).read_bytes()
    applied, kv, sessions = codec.decode_snapshot(data, StorageSettings(max_sessions=n))
    assert len(sessions) == n and codec.encode_snapshot(applied, kv, sessions) == data
    for refused in (lambda: segments.read_snapshot(spark, str(tmp_path), name, StorageSettings()).collect(), lambda: segments.write_snapshot(many_clients(spark, n), str(tmp_path / "other"), StorageSettings())):
        with pytest.raises(Exception, match="a count is out of range"):
            refused()


def test_snapshot_query_of_many_clients_equals_its_sql(spark, tmp_path):
    n = 2 * (StorageSettings().checked().max_sessions + 1)
    kinds = "CASE WHEN id % 7 = 0 THEN 'error' ELSE 'click' END"
    spark.range(n).selectExpr("id AS event_id", "timestamp_micros(1000000 * id) AS ts", "id AS user_id", f"{kinds} AS event_type", "id / 4 AS value", "concat('{\"k\": ', id % 5000, '}') AS props").write.parquet(str(tmp_path / "events.parquet"))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW events AS SELECT * FROM '{tmp_path}/events.parquet/*.parquet'")
    names, got = rows_of(spark, segments.QUERIES["snapshot_roundtrip"], str(tmp_path))
    assert (names, got) == rows_of_sql(con, segments.ORACLE_SQL["snapshot_roundtrip"])
    assert got and {r[names.index("sessions")] for r in got} == {n // 2}


@pytest.mark.parametrize("spoil", [lambda d: d[:-1], lambda d: d + b"\0", lambda d: d[:60] + b"?" + d[61:]])
def test_a_damaged_snapshot_file_is_not_read(spark, tmp_path, spoil):
    name = segments.write_snapshot(many_clients(spark, 3), str(tmp_path))
    (tmp_path / f".{name}.crc").unlink(missing_ok=True)
    (tmp_path / name).write_bytes(spoil((tmp_path / name).read_bytes()))
    with pytest.raises(Exception, match="CORRUPTION"):
        segments.read_snapshot(spark, str(tmp_path), name).collect()


def test_long_values_of_a_snapshot_file(spark, tmp_path):
    rows = [(i, 1, i, 1, f"k{i}", c * size) for i, (c, size) in enumerate([("é", 3 << 20), ("", 1), ("z", 9 << 20)], 1)]
    commands = spark.createDataFrame(rows, "global_seq long, client long, request_seq long, kind int, key string, value string")
    name = segments.write_snapshot(commands, str(tmp_path))
    assert sorted(segments.read_snapshot(spark, str(tmp_path), name).select("key", "value").collect()) == [(r[4], r[5]) for r in rows]
