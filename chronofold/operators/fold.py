"""Folding a change log: latest state, results, sessions, snapshots of state."""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from chronofold.cluster import materialise, ship
from chronofold.functions import codec
from chronofold.model import PUT
from chronofold.sources.changelog import cmd_log, sql

#: Sequence numbers of a key's commands that one window holds.
BLOCK_COMMANDS = 1 << 20


def latest_state(commands: DataFrame) -> DataFrame:
    """key, value and applied_seq of each live key: the last command of a key wins, tombstones go.

    One aggregation with partial results per task; a hot key costs a row per task.
    """
    last = commands.groupBy("key").agg(F.max_by(F.struct("kind", "value"), "global_seq").alias("last"), F.max("global_seq").alias("applied_seq"))
    return last.where(F.col("last.kind") == PUT).select("key", F.col("last.value").alias("value"), "applied_seq")


def point_reads(commands: DataFrame, probes: DataFrame) -> DataFrame:
    """found and value of each probe key, with the sequence that the read saw."""
    state = latest_state(commands.join(probes.select("key").distinct(), "key", "left_semi"))
    seen = commands.agg(F.max("global_seq").alias("read_seq"))
    return probes.join(state, "key", "left").select("key", F.col("applied_seq").isNotNull().alias("found"), "value").join(F.broadcast(seen))


def with_existed(commands: DataFrame) -> DataFrame:
    """PUT finds its key always, DELETE only where it was live.

    A key's commands are put in line in blocks of ``BLOCK_COMMANDS`` sequence
    numbers, so that a hot key is many windows; the command before a block's first
    one comes from a row for each key and block.
    """
    block = F.expr(f"global_seq div {BLOCK_COMMANDS}")
    inside = F.lag("kind").over(Window.partitionBy("key", "e_block").orderBy("global_seq"))
    last = commands.groupBy(F.col("key").alias("e_key"), block.alias("e_of")).agg(F.max_by("kind", "global_seq").alias("e_last"))
    earlier = last.select("e_key", "e_of", F.lag("e_last").over(Window.partitionBy("e_key").orderBy("e_of")).alias("e_before"))
    rows = commands.withColumn("e_block", block).withColumn("e_inside", inside)
    rows = rows.join(earlier, (F.col("key") == F.col("e_key")) & (F.col("e_block") == F.col("e_of")), "left")
    found = F.coalesce(F.coalesce("e_inside", "e_before") == PUT, F.lit(False))
    return rows.withColumn("existed", F.when(F.col("kind") == PUT, True).otherwise(found)).drop("e_block", "e_inside", "e_key", "e_of", "e_before")


def apply_results(commands: DataFrame) -> DataFrame:
    """The result of each command."""
    return with_existed(commands).select("global_seq", "client", "request_seq", "kind", "existed")


def session_table(commands: DataFrame) -> DataFrame:
    """Each client's last request: sequence, digest, kind, result and applied sequence."""
    rows = with_existed(commands).withColumn("digest", codec.command_digest(F.col("kind"), F.col("key"), F.col("value")))
    last = rows.groupBy("client").agg(F.max_by(F.struct("request_seq", "digest", "kind", "existed", "global_seq"), "global_seq").alias("s"))
    return last.select("client", F.col("s.request_seq").alias("last_sequence"), F.col("s.digest").alias("digest"), F.col("s.kind").alias("result_kind"), F.col("s.existed").alias("existed"), F.col("s.global_seq").alias("applied_seq"))


def recovered_state(snapshot: DataFrame, suffix: DataFrame) -> DataFrame:
    """State from a snapshot (key, value, applied_seq) and the commands after it."""
    base = snapshot.select(F.col("applied_seq").alias("global_seq"), F.lit(PUT).alias("kind"), "key", "value")
    return latest_state(base.unionByName(suffix.select("global_seq", "kind", "key", "value")))


def replay_violations(commands: DataFrame) -> DataFrame:
    """For each client: commands, gaps in its request sequence, and commands out of global order."""
    own = Window.partitionBy("client").orderBy("request_seq")
    rows = commands.select("client", (F.col("request_seq") - F.lag("request_seq", 1, 0).over(own) != 1).alias("gap"), (F.col("global_seq") <= F.lag("global_seq", 1, 0).over(own)).alias("disorder"))
    return rows.groupBy("client").agg(F.count("*").alias("commands"), F.count_if("gap").alias("gaps"), F.count_if("disorder").alias("disorders"))


def state_digest(commands: DataFrame, spec: codec.FormatSpec = codec.FormatSpec()) -> DataFrame:
    """One hash over applied sequence, live keys in byte order and sessions in client order.

    One hash reads all in order, so one task sorts the encoded rows (spilling) and
    streams them; it holds the hash's state alone, whatever the number of keys.  An
    empty log has no digest: no row.
    """
    ship(commands.sparkSession)
    u64 = codec.le_u64_hex
    text = lambda c: F.concat(u64(F.octet_length(c)), F.hex(F.encode(c, "utf-8")))
    kv = latest_state(commands).select(F.lit(1).alias("part"), F.encode("key", "utf-8").alias("k"), F.concat(text(F.col("key")), text(F.col("value"))).alias("h"))
    sessions = session_table(commands).select(F.lit(3).alias("part"), F.unhex(codec.client_hex(F.col("client"))).alias("k"), codec.session_hex().alias("h"))
    top = commands.agg(F.max("global_seq").alias("n")).where("n IS NOT NULL").select(F.lit(0).alias("part"), F.lit(None).cast("binary").alias("k"), F.concat(F.lit(spec.state_domain.encode().hex()), u64(F.col("n"))).alias("h"), "n")
    body = materialise(kv.unionByName(sessions), "state-rows")
    counts = body.agg(F.count_if(F.col("part") == 1).alias("n1"), F.count_if(F.col("part") == 3).alias("n3"))
    heads = counts.select(F.explode(F.array(F.struct(F.lit(1).alias("part"), F.col("n1").alias("n")), F.struct(F.lit(3).alias("part"), F.col("n3").alias("n")))).alias("x"))
    heads = heads.select("x.part", F.lit(None).cast("binary").alias("k"), u64(F.col("x.n")).alias("h"), F.col("x.n").alias("n"))  # a null key sorts first
    rows = body.withColumn("n", F.lit(None).cast("long")).unionByName(heads).unionByName(top)

    def run(batches):
        hashed, told = hashlib.sha256(), {}
        for batch in batches:
            for part, h, n in zip(batch.column("part").to_pylist(), batch.column("h").to_pylist(), batch.column("n").to_pylist(), strict=True):
                hashed.update(bytes.fromhex(h))
                if n is not None:
                    told[part] = n
        if 0 in told:
            yield pa.RecordBatch.from_pylist([{"applied_seq": told[0], "keys": told[1], "sessions": told[3], "digest": hashed.hexdigest()}])

    return rows.repartition(1).sortWithinPartitions("part", "k").select("part", "h", "n").mapInArrow(run, "applied_seq long, keys long, sessions long, digest string")


def _snapshot(commands):
    """State and suffix at half of the log."""
    half = commands.agg(F.expr("max(global_seq) div 2").alias("s"))
    marked = commands.join(F.broadcast(half))
    return latest_state(marked.where("global_seq <= s")), marked.where("global_seq > s")


def _probes(spark):
    return spark.range(0, 120).select(F.col("id").cast("string").alias("key"))


QUERIES = {
    "kv_latest_state": lambda s, d: latest_state(cmd_log(s, d)),
    "kv_get": lambda s, d: point_reads(cmd_log(s, d), _probes(s)),
    "apply_results": lambda s, d: apply_results(cmd_log(s, d)),
    "session_table": lambda s, d: session_table(cmd_log(s, d)),
    "recover_from_snapshot": lambda s, d: recovered_state(*_snapshot(cmd_log(s, d))),
    "replay_violations": lambda s, d: replay_violations(cmd_log(s, d)),
    "state_digest": lambda s, d: state_digest(cmd_log(s, d)),
}

_STATE = """, last AS (
  SELECT key, arg_max(kind, global_seq) AS kind, arg_max_null(value, global_seq) AS value, max(global_seq) AS applied_seq FROM cmd_log GROUP BY key
), state AS (SELECT key, value, applied_seq FROM last WHERE kind = 1)"""
_EXISTED = """, ran AS (
  SELECT *, CASE WHEN kind = 1 THEN true ELSE coalesce(lag(kind) OVER (PARTITION BY key ORDER BY global_seq) = 1, false) END AS existed FROM cmd_log)"""
_SESSIONS = f"""{_EXISTED}, dig AS (SELECT *, {codec.DIGEST_SQL} AS digest FROM ran
), sess AS (
  SELECT client, arg_max(request_seq, global_seq) AS last_sequence, arg_max(digest, global_seq) AS digest, arg_max(kind, global_seq) AS result_kind,
         arg_max(existed, global_seq) AS existed, max(global_seq) AS applied_seq FROM dig GROUP BY client)"""

ORACLE_SQL = {
    "kv_latest_state": sql(_STATE + " SELECT * FROM state", "cmd_log"),
    "kv_get": sql(_STATE + """ SELECT p.key, s.key IS NOT NULL AS found, value, (SELECT max(global_seq) FROM cmd_log) AS read_seq
        FROM (SELECT CAST(range AS VARCHAR) AS key FROM range(120)) p LEFT JOIN state s USING (key)""", "cmd_log"),
    "apply_results": sql(_EXISTED + " SELECT global_seq, client, request_seq, kind, existed FROM ran", "cmd_log"),
    "session_table": sql(_SESSIONS + " SELECT * FROM sess", "cmd_log"),
    "recover_from_snapshot": sql(_STATE + " SELECT * FROM state", "cmd_log"),
    "replay_violations": sql(""" SELECT client, count(*) AS commands, count(*) FILTER (WHERE gap) AS gaps, count(*) FILTER (WHERE disorder) AS disorders FROM (
        SELECT client, request_seq - lag(request_seq, 1, 0) OVER w <> 1 AS gap, global_seq <= lag(global_seq, 1, 0) OVER w AS disorder FROM cmd_log
        WINDOW w AS (PARTITION BY client ORDER BY request_seq)) GROUP BY client""", "cmd_log"),
    "state_digest": sql(f"""{_STATE}{_SESSIONS}, body AS (
      SELECT (SELECT max(global_seq) FROM cmd_log) AS applied_seq, (SELECT count(*) FROM state) AS keys, (SELECT count(*) FROM sess) AS sessions,
        (SELECT string_agg({codec.le_u64_sql("octet_length(encode(key))")} || hex(encode(key)) || {codec.le_u64_sql("octet_length(encode(value))")} || hex(encode(value)), '' ORDER BY encode(key)) FROM state) AS kv,
        (SELECT string_agg({codec.SESSION_SQL}, '' ORDER BY {codec.CLIENT_SQL}) FROM sess) AS ss)
      SELECT applied_seq, keys, sessions, sha256(unhex('{codec.FormatSpec().state_domain.encode().hex().upper()}' || {codec.le_u64_sql("applied_seq")} || {codec.le_u64_sql("keys")} || kv || {codec.le_u64_sql("sessions")} || ss)) AS digest FROM body""", "cmd_log"),
}
