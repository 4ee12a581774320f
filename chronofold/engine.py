"""A durable change-log table: open, put, delete, get, snapshot, compact, stats, close.

Accepted commands are Parquet batches below ``log/``, snapshots of state and
sessions are Parquet below ``snapshots/``, and both count only once their
manifest row is published by a rename.  One driver owns a directory (a lock
file); each call of ``apply`` is one micro-batch.  A read sees the last committed
batch and says which.
"""

from __future__ import annotations

import contextlib
import fcntl
import json
import os
import shutil

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chronofold import model
from chronofold.cluster import materialise
from chronofold.functions import codec
from chronofold.model import PUT, ChangelogError, StorageSettings
from chronofold.operators import admission, fold
from chronofold.sources.changelog import global_sequence
from chronofold.trace import Recorder

SERVING, FAULTED, CLOSED = "Serving", "Faulted", "Closed"


class Engine:
    """``directory`` is a path that the driver and all executors share."""

    def __init__(self, spark: SparkSession, directory: str, settings: StorageSettings | None = None, on_event=None, on_trace=None):
        self.spark, self.dir, self.settings = spark, directory, (settings or StorageSettings()).checked()
        self.emit, self.on_trace = on_event or (lambda name, **x: None), on_trace
        self.queue: list[tuple] = []
        self.tickets = 0
        self.counters = dict.fromkeys(("gets", "puts", "deletes", "dup_hits", "rejections", "storage_failures"), 0)
        self.state, self.snapshotting, self.replayed = "Recovering", False, 0
        os.makedirs(directory, exist_ok=True)
        self.lock = open(os.path.join(directory, "LOCK"), "w")  # noqa: SIM115
        try:
            fcntl.flock(self.lock, fcntl.LOCK_EX | fcntl.LOCK_NB)
        except OSError as e:
            self.lock.close()
            raise ChangelogError("LOCKED", directory, e) from e
        try:
            self.emit("engine.open.start")
            self.manifest = self._load()
            self._look_around()
            self._check()
        except BaseException as e:
            if model.code_of(e) == "CORRUPTION":
                self.emit("wal.interior.corruption", detail=e.detail)
            self.emit("engine.recovery.failed")
            self.lock.close()
            raise
        self.state = SERVING
        self.replayed = self.applied - max((x["seq"] for x in self.manifest["snapshots"]), default=0)  # commands that a read takes from the log
        self.emit("engine.recovery.complete", sequence=self.applied)

    # -- manifest ------------------------------------------------------------

    def _load(self) -> dict:
        path = os.path.join(self.dir, "MANIFEST")
        if not os.path.exists(path):
            return {"batches": [], "snapshots": [], "next": 1}
        try:
            with open(path) as f:
                return json.load(f)
        except ValueError as e:
            raise ChangelogError("CORRUPTION", "manifest", e) from e

    def _look_around(self) -> None:
        """Tell what the directory holds beside what the manifest names: left over from a crash, or not this engine's."""
        if self.manifest["snapshots"]:
            self.emit("snapshot.selected", sequence=max(x["seq"] for x in self.manifest["snapshots"]))
        for name in sorted(os.listdir(self.dir)):
            if name not in ("LOCK", "MANIFEST", "MANIFEST.tmp", "log", "snapshots"):
                self.emit("directory.unknown.file", detail=name)
        own = os.path.join(self.dir, "snapshots")
        for name in sorted(set(os.listdir(own) if os.path.isdir(own) else ()) - {x["name"] for x in self.manifest["snapshots"]}):
            self.emit("snapshot.temp.ignored", detail=name)

    def _publish(self, manifest: dict) -> None:
        path = os.path.join(self.dir, "MANIFEST")
        with open(path + ".tmp", "w") as f:
            json.dump(manifest, f)
            f.flush()
            os.fsync(f.fileno())
        os.rename(path + ".tmp", path)
        folder = os.open(self.dir, os.O_RDONLY)
        os.fsync(folder)
        os.close(folder)
        self.manifest = manifest

    def _check(self) -> None:
        """Fail closed: batches must follow each other from the newest snapshot on, and hold what they say."""
        at = max((x["seq"] for x in self.manifest["snapshots"]), default=0)
        ranges = sorted(((b["start"], b["end"]) for b in self.manifest["batches"]))
        if ranges and ranges[0][0] > at + 1:
            raise ChangelogError("CORRUPTION", "gap after snapshot")
        for (_, end), (start, _) in zip(ranges, ranges[1:], strict=False):
            if start != end + 1:
                raise ChangelogError("CORRUPTION", "batches overlap or leave a gap")
        if at and ranges and ranges[-1][1] < at:
            raise ChangelogError("CORRUPTION", "the log ends before the snapshot")
        if ranges:
            try:
                found = self._log().agg(F.count("*").alias("n"), F.countDistinct("global_seq").alias("d"), F.min("global_seq").alias("lo"), F.max("global_seq").alias("hi")).first()
            except Exception as e:
                raise ChangelogError("CORRUPTION", "a batch cannot be read", e) from e
            want = ranges[-1][1] - ranges[0][0] + 1
            if (found["n"], found["d"], found["lo"], found["hi"]) != (want, want, ranges[0][0], ranges[-1][1]):
                raise ChangelogError("CORRUPTION", "batches do not hold what the manifest says")

    @property
    def applied(self) -> int:
        return self.manifest["next"] - 1

    def _ready(self) -> None:
        if self.state == FAULTED:
            raise ChangelogError("FAULTED")
        if self.state != SERVING:
            raise ChangelogError("CLOSED")

    # -- state ---------------------------------------------------------------

    def _log(self, after: int = 0) -> DataFrame:
        paths = [os.path.join(self.dir, "log", b["name"]) for b in self.manifest["batches"] if b["end"] > after]
        schema = model.COMMAND_SCHEMA + ", existed boolean, digest string"
        rows = self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)
        return rows.where(F.col("global_seq") > after)

    def _base(self, kind: str, schema: str) -> tuple[DataFrame, int]:
        newest = max(self.manifest["snapshots"], key=lambda x: x["seq"], default=None)
        if newest is None:
            return self.spark.createDataFrame([], schema), 0
        return self.spark.read.schema(schema).parquet(os.path.join(self.dir, "snapshots", newest["name"], kind)), newest["seq"]

    def kv(self) -> DataFrame:
        """Live keys: the newest snapshot, and the log after it."""
        base, at = self._base("kv", "key string, value string, applied_seq long")
        return fold.recovered_state(base, self._log(at))

    def sessions(self) -> DataFrame:
        schema = "client long, last_sequence long, digest string, result_kind int, existed boolean, applied_seq long"
        base, at = self._base("sessions", schema)
        later = self._log(at).select("client", F.col("request_seq").alias("last_sequence"), "digest", F.col("kind").alias("result_kind"), "existed", F.col("global_seq").alias("applied_seq"))
        last = base.unionByName(later).groupBy("client").agg(F.max_by(F.struct("last_sequence", "digest", "result_kind", "existed", "applied_seq"), "applied_seq").alias("s"))
        return last.select("client", "s.*")

    # -- requests ------------------------------------------------------------

    def apply(self, requests: DataFrame) -> DataFrame:
        """Decide and apply a batch (DELIVERY_SCHEMA): pos, code, applied_seq, existed and duplicate of each request.

        A client's session goes before its requests as its last accepted one, so
        a batch continues where the one before ended.
        """
        self._ready()
        trace = Recorder("apply", self.on_trace)
        try:
            results = self._apply(requests, trace)
            trace.finish(self.applied)
            return results
        except ChangelogError as e:
            trace.abandon(e.code)
            raise
        except Exception as e:
            trace.abandon("STORAGE")
            raise self._fault("batch", e) from e

    def _fault(self, what: str, cause: Exception) -> ChangelogError:
        """A failure on the way to the manifest: it may or may not name the new files, so nothing more is served."""
        self.counters["storage_failures"] += 1
        self.state = FAULTED
        self.emit("storage.failure", code="STORAGE")
        self.emit("engine.faulted")
        return ChangelogError("STORAGE", f"the outcome of the {what} is unknown", cause)

    def _apply(self, requests: DataFrame, trace: Recorder) -> DataFrame:
        s = self.settings
        rows = materialise(requests, "requests")
        valid = admission.validate_requests(rows, s.max_key_bytes, s.max_value_bytes)
        rows = rows.join(valid.withColumnRenamed("pos", "v_pos"), F.col("pos") == F.col("v_pos")).drop("v_pos")
        trace.span("validate")
        good = rows.where("code = 'OK'").drop("code", "reason").withColumn("digest", codec.command_digest(F.col("kind"), F.col("key"), F.col("value")))
        held = self.sessions()
        live = materialise(self.kv().select("key").join(good.select(F.col("key").alias("t_key")).distinct(), F.col("key") == F.col("t_key"), "left_semi"), "touched-keys")
        # a table that cannot become full needs no order between clients
        room_sessions, room_keys = s.max_sessions - held.count(), s.max_keys - self.kv().count()
        clients = good.where("request_seq = 1").select("client").distinct().join(held.select("client"), "client", "left_anti").count()
        keys = good.where(F.col("kind") == PUT).select("key").distinct().join(live, "key", "left_anti").count()
        if clients > room_sessions or keys > room_keys:
            touched = held.join(good.select(F.col("client").alias("t_client")).distinct(), F.col("client") == F.col("t_client"), "left_semi")
            decided = admission.decide_within_limits(good, touched, live, room_sessions, room_keys)
        else:
            decided = admission.continue_sessions(good, held)
        decided = materialise(decided, "decisions")
        trace.span("admit")
        accepted = decided.where("decision = 'EXECUTE'")
        seq = global_sequence(accepted.select("pos"), "pos").select("pos", (F.col("global_seq") + self.applied).alias("global_seq"))
        commands = accepted.join(seq, "pos").select("global_seq", "client", "request_seq", "kind", "key", "value", "digest", "pos")
        base = live.select(F.lit(0).cast("long").alias("global_seq"), "key", F.lit(PUT).alias("kind"), F.lit(True).alias("old"))
        ran = fold.with_existed(base.unionByName(commands.withColumn("old", F.lit(False)), allowMissingColumns=True)).where("NOT old")
        name = f"batch-{self.applied + 1:020d}"
        path = os.path.join(self.dir, "log", name)
        ran.select("global_seq", "client", "request_seq", "kind", "key", "value", "existed", "digest").write.mode("overwrite").parquet(path)
        written = self.spark.read.parquet(path)
        n = written.count()
        trace.span("append", n)
        if n:
            batch = {"name": name, "start": self.applied + 1, "end": self.applied + n}
            self.emit("wal.segment.created", segment=name)
            self._publish({**self.manifest, "batches": [*self.manifest["batches"], batch], "next": self.applied + n + 1})
            self.emit("wal.segment.sealed", segment=name, count=n)  # a batch is written whole
        trace.span("sync")
        # a duplicate's result is that of the accepted request it repeats
        first = self.sessions_by_request(written, held)
        out = decided.select("pos", "client", "request_seq", "decision").join(first, ["client", "request_seq"], "left")
        known = F.col("decision").isin("EXECUTE", "DUPLICATE")
        results = out.select("pos", F.when(known, "OK").otherwise(F.col("decision")).alias("code"), F.when(known, F.col("applied_seq")).alias("applied_seq"), F.when(known, F.col("existed")).alias("existed"), (F.col("decision") == "DUPLICATE").alias("duplicate"))
        bad = rows.where("code <> 'OK'").select("pos", "code", F.lit(None).cast("long").alias("applied_seq"), F.lit(None).cast("boolean").alias("existed"), F.lit(False).alias("duplicate"))
        results = materialise(results.unionByName(bad), "results")
        by_kind = {r["kind"]: r["count"] for r in written.groupBy("kind").count().collect()}
        told = results.agg(F.count_if("duplicate").alias("d"), F.count_if(F.col("code") != "OK").alias("r")).first()
        for counter, n in (("puts", by_kind.get(1, 0)), ("deletes", by_kind.get(2, 0)), ("dup_hits", told["d"]), ("rejections", told["r"])):
            self.counters[counter] += n
        for event, n in (("session.dedup.hit", told["d"]), ("session.rejected", told["r"])):
            if n:
                self.emit(event, count=n)
        trace.span("respond")
        return results

    @staticmethod
    def sessions_by_request(written: DataFrame, held: DataFrame) -> DataFrame:
        own = written.select("client", "request_seq", F.col("global_seq").alias("applied_seq"), "existed")
        return own.unionByName(held.select("client", F.col("last_sequence").alias("request_seq"), "applied_seq", "existed")).groupBy("client", "request_seq").agg(F.max_by(F.struct("applied_seq", "existed"), "applied_seq").alias("r")).select("client", "request_seq", "r.*")

    def _one(self, client: int, request: int, kind: int, key: str, value: str | None) -> dict:
        rows = self.spark.createDataFrame([(1, client, request, kind, key, value)], model.DELIVERY_SCHEMA)
        r = self.apply(rows).first()
        if r["code"] != "OK":
            raise ChangelogError(r["code"])
        return {k: r[k] for k in ("applied_seq", "existed", "duplicate")}

    def put(self, client: int, request: int, key: str, value: str) -> dict:
        return self._one(client, request, PUT, key, value)

    def delete(self, client: int, request: int, key: str) -> dict:
        return self._one(client, request, model.DELETE, key, None)

    # -- a bounded queue in front of apply -----------------------------------

    def submit(self, client: int, request: int, kind: int, key: str, value: str | None) -> int:
        """Queue a request for the next ``flush``; its ticket is its ``pos`` there.  A full queue refuses."""
        self._ready()
        if len(self.queue) >= self.settings.queue_capacity:
            self.counters["rejections"] += 1
            raise ChangelogError("RESOURCE_EXHAUSTED", "the queue is full")
        self.tickets += 1
        self.queue.append((self.tickets, client, request, kind, key, value))
        return self.tickets

    def cancel(self, ticket: int) -> str:
        """CANCELED: it will not run.  CANCELED_QUEUED: it has left the queue, and may have run."""
        before = len(self.queue)
        self.queue = [r for r in self.queue if r[0] != ticket]
        return "CANCELED" if len(self.queue) < before else "CANCELED_QUEUED"

    def flush(self) -> DataFrame:
        """Apply what is queued as one batch."""
        rows, self.queue = self.queue, []
        return self.apply(self.spark.createDataFrame(rows, model.DELIVERY_SCHEMA))

    def get(self, key: str) -> tuple[str | None, bool, int]:
        """(value, found, the sequence that was read)."""
        self._ready()
        self.counters["gets"] += 1
        trace = Recorder("get", self.on_trace)
        r = self.kv().where(F.col("key") == key).first()
        trace.span("read")
        trace.finish(self.applied)
        return (r["value"], True, self.applied) if r else (None, False, self.applied)

    # -- upkeep --------------------------------------------------------------

    def create_snapshot(self) -> str | None:
        """Write state and sessions, read them back, publish, and compact; None where nothing was ever applied."""
        self._ready()
        at = self.applied
        if not at:
            return None
        if any(x["seq"] == at for x in self.manifest["snapshots"]):
            return f"snapshot-{at:020d}"
        self.emit("snapshot.start", sequence=at)
        trace = Recorder("snapshot", self.on_trace)
        name = f"snapshot-{at:020d}"
        root = os.path.join(self.dir, "snapshots", name)
        kv, sessions = self.kv(), self.sessions()
        self.snapshotting = True
        try:
            kv.write.mode("overwrite").parquet(os.path.join(root, "kv"))
            sessions.write.mode("overwrite").parquet(os.path.join(root, "sessions"))
            trace.span("snapshot_write")
            for part, rows in (("kv", kv), ("sessions", sessions)):
                total = lambda df: df.agg(F.count("*"), F.sum(F.xxhash64(*df.columns).cast("decimal(38,0)"))).first()
                if total(self.spark.read.schema(rows.schema).parquet(os.path.join(root, part))) != total(rows):
                    raise ChangelogError("CORRUPTION", "a snapshot did not read back as written")
            trace.span("snapshot_validate")
        except Exception as e:
            self.emit("snapshot.failed", sequence=at)
            trace.abandon(model.code_of(e))
            raise  # nothing was published: go on serving
        finally:
            self.snapshotting = False
        try:
            self._publish({**self.manifest, "snapshots": [*self.manifest["snapshots"], {"name": name, "seq": at}]})
        except Exception as e:
            self.emit("snapshot.failed", sequence=at)
            trace.abandon("STORAGE")
            raise self._fault("snapshot", e) from e
        self.emit("snapshot.published", sequence=at)
        trace.span("snapshot_rename")
        self.compact()
        trace.span("compaction")
        trace.finish(at)
        return name

    def compact(self) -> list[str]:
        """Forget batches that the newest snapshot covers and all but the newest two snapshots, then delete them."""
        snapshots = sorted(self.manifest["snapshots"], key=lambda x: x["seq"])
        through = snapshots[-1]["seq"] if snapshots else 0
        keep = snapshots[-model.RETAINED_SNAPSHOTS :]
        gone = [os.path.join("log", b["name"]) for b in self.manifest["batches"] if b["end"] <= through] + [os.path.join("snapshots", x["name"]) for x in snapshots if x not in keep]
        try:
            self._publish({**self.manifest, "batches": [b for b in self.manifest["batches"] if b["end"] > through], "snapshots": keep})
        except Exception as e:
            raise self._fault("compaction", e) from e
        for path in gone:  # what is left behind is never read again
            with contextlib.suppress(OSError):
                shutil.rmtree(os.path.join(self.dir, path))
                self.emit("wal.segment.deleted", segment=path)
        return gone

    def stats(self) -> dict:
        """Also after a fault or close; a snapshot is synchronous, so none is active between calls, and no tail of a file is ever cut."""
        newest = max((x["seq"] for x in self.manifest["snapshots"]), default=0)
        return {
            "state": self.state, "applied_seq": self.applied, "batches": len(self.manifest["batches"]), "snapshots": len(self.manifest["snapshots"]),
            "live_keys": self.kv().count(), "sessions": self.sessions().count(), "session_capacity": self.settings.max_sessions,
            "queue_depth": len(self.queue), "queue_capacity": self.settings.queue_capacity, "last_snapshot_seq": newest, "snapshot_active": self.snapshotting,
            "replayed": self.replayed, "truncated_bytes": 0, **self.counters,
        }

    def close(self) -> list[int]:
        """Tickets still in the queue, which were not executed.  Again and again does no harm; a faulted engine stays so."""
        if self.lock.closed:
            return []
        self.emit("engine.close.start")
        left, self.queue = [r[0] for r in self.queue], []
        if self.state != FAULTED:
            self.state = CLOSED
        self.lock.close()
        self.emit("engine.close.complete", sequence=self.applied)
        return left

