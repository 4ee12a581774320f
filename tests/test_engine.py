import json
import os
import random

import pytest
from chronofold.engine import Engine
from chronofold.model import DELIVERY_SCHEMA, EVENT_NAMES, ChangelogError, StorageSettings
from chronofold.trace import TRACE_SCHEMA


def code(f, *a):
    with pytest.raises(ChangelogError) as e:
        f(*a)
    return e.value.code


def test_a_model_over_batches_snapshots_and_restarts(spark, tmp_path):
    """Random batches with retries, against a dictionary."""
    rng, folder = random.Random(11), str(tmp_path / "db")
    engine, kv, high, applied = Engine(spark, folder), {}, {}, 0
    for step in range(4):
        rows, want = [], {}
        for pos in range(1, 13):
            client = rng.randrange(1, 4)
            last, digest = high.get(client, (0, None))
            request, kind, key = last + rng.choice([1, 1, 1, 0, 2]), rng.choice([1, 1, 2]), f"k{rng.randrange(6)}"
            value = f"v{rng.randrange(9)}" if kind == 1 else None
            if request == last and last and rng.random() < 0.7:
                kind, key, value = digest
            rows.append((pos, client, request, kind, key, value))
            if request < 1:
                want[pos] = "INVALID_ARGUMENT"
            elif request == last + 1:
                want[pos], high[client] = "OK", (request, (kind, key, value))
                applied += 1
                kv.pop(key, None) if kind == 2 else kv.update({key: value})
            elif request == last:
                want[pos] = "OK" if digest == (kind, key, value) else "REQUEST_ID_REUSE"
            else:
                want[pos] = "SEQUENCE_GAP"
        got = {r["pos"]: r["code"] for r in engine.apply(spark.createDataFrame(rows, DELIVERY_SCHEMA)).collect()}
        assert got == want
        if step == 1:
            engine.create_snapshot()
        if step in (1, 2):
            engine.close()
            engine = Engine(spark, folder)
        assert {r["key"]: r["value"] for r in engine.kv().collect()} == kv
        assert engine.applied == applied
    engine.close()


def test_lifecycle_and_damage(spark, tmp_path):
    folder, events = str(tmp_path / "db"), []
    engine = Engine(spark, folder, on_event=lambda name, **x: events.append(name))
    assert engine.create_snapshot() is None
    assert engine.put(1, 1, "a", "") == {"applied_seq": 1, "existed": True, "duplicate": False}
    assert engine.put(1, 1, "a", "")["duplicate"]
    assert engine.get("a") == ("", True, 1) and engine.get("b")[1] is False
    assert code(engine.put, 0, 1, "a", "x") == "INVALID_ARGUMENT"
    engine.submit(1, 2, 1, "b", "")
    engine.create_snapshot()
    stats = engine.stats()
    want = {"state": "Serving", "applied_seq": 1, "live_keys": 1, "sessions": 1, "queue_depth": 1, "last_snapshot_seq": 1, "snapshot_active": False, "replayed": 0, "truncated_bytes": 0, "gets": 2, "puts": 1, "deletes": 0, "dup_hits": 1, "rejections": 1, "storage_failures": 0}
    assert want.items() <= stats.items() and stats["session_capacity"] > 0 and stats["queue_capacity"] > 0
    assert code(Engine, spark, folder) == "LOCKED"
    engine.close()
    engine.close()
    assert code(engine.get, "a") == "CLOSED"
    assert events == [
        "engine.open.start", "engine.recovery.complete", "wal.segment.created", "wal.segment.sealed", "session.dedup.hit", "session.rejected",
        "snapshot.start", "snapshot.published", "wal.segment.deleted", "engine.close.start", "engine.close.complete",
    ] and set(events) <= set(EVENT_NAMES)
    events.clear()
    with open(os.path.join(folder, "notes.txt"), "w"):
        os.makedirs(os.path.join(folder, "snapshots", "snapshot-unpublished"))
    manifest = os.path.join(folder, "MANIFEST")
    with open(manifest) as f:
        held = json.load(f)
    held["snapshots"], held["batches"] = [], [{"name": "batch-gone", "start": 2, "end": 2}]
    with open(manifest, "w") as f:
        json.dump(held, f)
    assert code(lambda: Engine(spark, folder, on_event=lambda name, **x: events.append(name))) == "CORRUPTION"
    assert events == ["engine.open.start", "directory.unknown.file", "snapshot.temp.ignored", "snapshot.temp.ignored", "wal.interior.corruption", "engine.recovery.failed"]


def test_queue_traces_and_faults(spark, tmp_path, monkeypatch):
    traces, folder = [], str(tmp_path / "db")
    engine = Engine(spark, folder, StorageSettings(queue_capacity=2, max_keys=2), on_trace=traces.append)
    first, second = engine.submit(1, 1, 1, "secret-key", "secret-value"), engine.submit(2, 1, 1, "b", "")
    assert code(engine.submit, 3, 1, 1, "c", "") == "RESOURCE_EXHAUSTED"
    assert engine.cancel(second) == "CANCELED" and engine.cancel(second) == "CANCELED_QUEUED"
    assert [r["pos"] for r in engine.flush().collect()] == [first]
    (trace,) = traces
    assert [n for n, _, _ in trace.spans] == ["validate", "admit", "append", "sync", "respond"]
    assert sum(d for _, d, _ in trace.spans) <= trace.total_ns and "secret" not in repr(trace)
    assert spark.createDataFrame([t.row() for t in traces], TRACE_SCHEMA).count() == 1
    # a failure on the way to the manifest leaves the outcome unknown and the engine faulted; reopening tells
    monkeypatch.setattr(Engine, "_publish", lambda *a: (_ for _ in ()).throw(OSError("disk")))
    assert code(engine.put, 1, 2, "x", "1") == "STORAGE" and code(engine.get, "x") == "FAULTED"
    monkeypatch.undo()
    engine.close()
    engine = Engine(spark, folder)
    assert engine.get("x")[1] is False and engine.put(1, 2, "x", "1")["applied_seq"] == 2
    # so does a snapshot's; what is queued at a close was not executed
    told = []
    engine.emit = lambda name, **x: told.append(name)
    ticket = engine.submit(1, 3, 1, "y", "1")
    monkeypatch.setattr(Engine, "_publish", lambda *a: (_ for _ in ()).throw(OSError("disk")))
    assert code(engine.create_snapshot) == "STORAGE" and code(engine.get, "x") == "FAULTED"
    monkeypatch.undo()
    assert engine.close() == [ticket] and engine.close() == [] and code(engine.get, "x") == "FAULTED"
    assert told == ["snapshot.start", "snapshot.failed", "storage.failure", "engine.faulted", "engine.close.start", "engine.close.complete"]
    engine = Engine(spark, folder)
    assert engine.get("x") == ("1", True, 2) and engine.get("y")[1] is False and engine.create_snapshot() == "snapshot-00000000000000000002"
    engine.close()


def test_limits_are_those_of_one_request_at_a_time(spark, tmp_path):
    """Batches under tight limits, with retries and deletes, against a fold."""
    rng, most_clients, most_keys = random.Random(5), 3, 3
    engine = Engine(spark, str(tmp_path / "db"), StorageSettings(max_sessions=most_clients, max_keys=most_keys))
    last, kv, pos, seen = {}, {}, 0, set()
    for _ in range(4):
        rows, want = [], {}
        for _ in range(25):
            pos += 1
            client = rng.randrange(1, 6)
            high, own = last.get(client, (0, None))
            request, kind, key = max(1, high + rng.choice([1, 1, 1, 1, 0, 2])), rng.choice([1, 1, 1, 2]), f"k{rng.randrange(6)}"
            value = f"v{rng.randrange(3)}" if kind == 1 else None
            rows.append((pos, client, request, kind, key, value))
            if request == high + 1:
                if not high and len(last) >= most_clients or kind == 1 and key not in kv and len(kv) >= most_keys:
                    want[pos] = "RESOURCE_EXHAUSTED"
                else:
                    want[pos], last[client] = "OK", (request, (kind, key, value))
                    kv.pop(key, None) if kind == 2 else kv.update({key: value})
            elif not high or request > high:
                want[pos] = "SEQUENCE_GAP"
            elif request < high:
                want[pos] = "DUPLICATE_RESULT_EXPIRED"
            else:
                want[pos] = "OK" if own == (kind, key, value) else "REQUEST_ID_REUSE"
        assert {r["pos"]: r["code"] for r in engine.apply(spark.createDataFrame(rows, DELIVERY_SCHEMA)).collect()} == want
        assert {r["key"]: r["value"] for r in engine.kv().collect()} == kv
        seen |= set(want.values())
    assert {"OK", "RESOURCE_EXHAUSTED", "SEQUENCE_GAP"} <= seen
    engine.close()


def test_a_refused_client_may_only_begin_at_one_and_a_delete_makes_room(spark, tmp_path):
    engine = Engine(spark, str(tmp_path / "db"), StorageSettings(max_sessions=1, max_keys=1))
    engine.put(1, 1, "a", "x")
    batch = [(1, 2, 1, 1, "a", ""), (2, 2, 2, 1, "a", ""), (3, 2, 9, 1, "a", ""), (4, 2, 1, 1, "a", ""), (5, 1, 2, 2, "a", None), (6, 1, 3, 1, "b", "")]
    got = [r["code"] for r in engine.apply(spark.createDataFrame(batch, DELIVERY_SCHEMA)).orderBy("pos").collect()]
    assert got == ["RESOURCE_EXHAUSTED", "SEQUENCE_GAP", "SEQUENCE_GAP", "RESOURCE_EXHAUSTED", "OK", "OK"]
    assert code(engine.put, 1, 4, "c", "") == "RESOURCE_EXHAUSTED" and engine.put(1, 4, "b", "z")["existed"]
    engine.close()
