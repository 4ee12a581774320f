"""Exactly-once admission: which attempted requests run, and what the others are."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from chronofold.cluster import ship
from chronofold.functions import codec
from chronofold.model import DELETE, PUT
from chronofold.operators.fold import latest_state, session_table
from chronofold.sources.changelog import cmd_log, deliveries, sql

EXECUTE, DUPLICATE, REUSE, EXPIRED, GAP = "EXECUTE", "DUPLICATE", "REQUEST_ID_REUSE", "DUPLICATE_RESULT_EXPIRED", "SEQUENCE_GAP"
DECISION_SCHEMA = "pos long, client long, request_seq long, decision string, high_water long"


def decide(high: int, digest, request: int, own) -> str:
    """The decision for one request of a client whose last accepted one is ``high`` (0: none) with ``digest``."""
    if request == high + 1:
        return EXECUTE
    if high == 0 or request > high:
        return GAP
    if request < high:
        return EXPIRED
    return DUPLICATE if own == digest else REUSE


def validate_requests(requests: DataFrame, max_key: int = 1024, max_value: int = 1 << 20) -> DataFrame:
    """INVALID_ARGUMENT and its reason, or OK, for each request; the first reason counts."""
    reason = (
        F.when(F.col("key").isNull() | ~F.octet_length("key").between(1, max_key), "key length")
        .when(F.octet_length("value") > max_value, "value length")
        .when(F.col("client").isNull() | (F.col("client") == 0), "zero client")
        .when(F.col("request_seq").isNull() | (F.col("request_seq") < 1), "zero sequence")
    )
    return requests.select("pos", F.when(reason.isNull(), "OK").otherwise("INVALID_ARGUMENT").alias("code"), reason.alias("reason"))


def classify(attempts: DataFrame) -> DataFrame:
    """The decision on each attempt and the client's high water after it.

    A decision depends on the last accepted request alone, so each client's
    attempts stream past in order and a task holds two values per client, not
    its history; digests are made before the shuffle, which carries no values.
    """
    ship(attempts.sparkSession)
    digest = codec.command_digest(F.col("kind"), F.col("key"), F.col("value"))
    rows = attempts.select("client", "pos", "request_seq", digest.alias("digest")).repartition("client").sortWithinPartitions("client", "pos")

    def run(batches):
        client, high, last = None, 0, None
        for batch in batches:
            decisions, waters = [], []
            for c, request, own in zip(batch.column("client").to_pylist(), batch.column("request_seq").to_pylist(), batch.column("digest").to_pylist(), strict=True):
                if c != client:
                    client, high, last = c, 0, None
                decision = decide(high, last, request, own)
                if decision == EXECUTE:
                    high, last = request, own
                decisions.append(decision)
                waters.append(high)
            yield pa.RecordBatch.from_arrays([batch.column("pos"), batch.column("client"), batch.column("request_seq"), pa.array(decisions, pa.string()), pa.array(waters, pa.int64())], names=["pos", "client", "request_seq", "decision", "high_water"])

    return rows.mapInArrow(run, DECISION_SCHEMA)


def continue_sessions(attempts: DataFrame, sessions: DataFrame) -> DataFrame:
    """``attempts`` (with digest) and their decisions, from where ``sessions`` left off.

    A session goes first among its client's rows as the request it last accepted.
    """
    ship(attempts.sparkSession)
    held = sessions.select("client", F.lit(-1).cast("long").alias("pos"), F.col("last_sequence").alias("request_seq"), "digest")
    rows = attempts.select("client", "pos", "request_seq", "digest").unionByName(held).repartition("client").sortWithinPartitions("client", "pos")

    def run(batches):
        client, high, last = None, 0, None
        for batch in batches:
            out = []
            for r in batch.to_pylist():
                if r["client"] != client:
                    client, high, last = r["client"], 0, None
                own = r["pos"] < 0
                decision = EXECUTE if own else decide(high, last, r["request_seq"], r["digest"])
                if decision == EXECUTE:
                    high, last = r["request_seq"], r["digest"]
                if not own:
                    out.append({"d_pos": r["pos"], "decision": decision})
            yield pa.RecordBatch.from_pylist(out, schema=pa.schema([("d_pos", pa.int64()), ("decision", pa.string())]))

    decided = rows.mapInArrow(run, "d_pos long, decision string")
    return attempts.join(decided, F.col("pos") == F.col("d_pos")).drop("d_pos")


def decide_within_limits(attempts: DataFrame, sessions: DataFrame, live: DataFrame, room_sessions: int, room_keys: int) -> DataFrame:
    """``attempts`` (with digest) and their decisions, one request at a time, where the table may become full.

    ``sessions`` and ``live`` are those that the attempts touch; the rooms are how
    many more clients and keys there may be.  A client beyond its limit is refused
    at sequence 1, a new key at its PUT; neither leaves a trace, and a DELETE makes
    room again.  A decision depends on all before it, so the batch streams through
    one task in order of ``pos``; it holds a client's last request and the keys
    that the batch touches, no values.
    """
    ship(attempts.sparkSession)
    none = lambda kind: F.lit(None).cast(kind)
    rows = attempts.select("pos", "client", "request_seq", "kind", "key", "digest")
    rows = rows.unionByName(sessions.select(F.lit(-2).cast("long").alias("pos"), "client", F.col("last_sequence").alias("request_seq"), none("int").alias("kind"), none("string").alias("key"), "digest"))
    rows = rows.unionByName(live.select(F.lit(-1).cast("long").alias("pos"), none("long").alias("client"), none("long").alias("request_seq"), none("int").alias("kind"), "key", none("string").alias("digest")))

    def run(batches):
        last, keys, clients, free = {}, set(), room_sessions, room_keys
        for batch in batches:
            out = []
            for r in batch.to_pylist():
                if r["pos"] == -2:
                    last[r["client"]] = (r["request_seq"], r["digest"])
                    continue
                if r["pos"] == -1:
                    keys.add(r["key"])
                    continue
                high, own = last.get(r["client"], (0, None))
                decision = decide(high, own, r["request_seq"], r["digest"])
                if decision == EXECUTE and (not high and clients <= 0 or r["kind"] == PUT and r["key"] not in keys and free <= 0):
                    decision = "RESOURCE_EXHAUSTED"
                if decision == EXECUTE:
                    clients -= not high
                    last[r["client"]] = (r["request_seq"], r["digest"])
                    if r["kind"] == PUT and r["key"] not in keys:
                        keys.add(r["key"])
                        free -= 1
                    elif r["kind"] == DELETE and r["key"] in keys:
                        keys.remove(r["key"])
                        free += 1
                out.append({"d_pos": r["pos"], "decision": decision})
            yield pa.RecordBatch.from_pylist(out, schema=pa.schema([("d_pos", pa.int64()), ("decision", pa.string())]))

    decided = rows.repartition(1).sortWithinPartitions("pos").mapInArrow(run, "d_pos long, decision string")
    return attempts.join(decided, F.col("pos") == F.col("d_pos")).drop("d_pos")


def high_water(attempts: DataFrame) -> DataFrame:
    """Each client's last accepted sequence, and attempts by decision."""
    return classify(attempts).groupBy("client").agg(F.max("high_water").alias("last_sequence"), F.count("*").alias("attempts"), F.count_if(F.col("decision") == EXECUTE).alias("executed"))


def session_capacity(attempts: DataFrame, max_sessions: int) -> DataFrame:
    """Admission of new clients to a bounded session table, without eviction.

    A client enters with its first attempt of sequence 1; the first
    ``max_sessions`` to do so stay, and every such attempt of the others is
    RESOURCE_EXHAUSTED.  Only first attempts are ranked, and only the best per
    task travel.
    """
    first = attempts.where("request_seq = 1").groupBy("client").agg(F.min("pos").alias("first_pos"))
    line = first.orderBy("first_pos", "client").limit(max_sessions).select("client", F.lit(True).alias("held"))
    return first.join(line, "client", "left").select("client", "first_pos", F.when(F.coalesce("held", F.lit(False)), EXECUTE).otherwise("RESOURCE_EXHAUSTED").alias("decision"))


def key_capacity(commands: DataFrame, max_keys: int) -> DataFrame:
    """Commands that a table of at most ``max_keys`` live keys rejects.

    A rejected PUT leaves no key, so the rule is a fold over the whole log, and one
    task sorts it (spilling) and streams it; it gets no values and holds live keys
    alone, at most ``max_keys``.
    """
    ship(commands.sparkSession)
    rows = commands.select("global_seq", "kind", "key").repartition(1).sortWithinPartitions("global_seq")

    def run(batches):
        live: set = set()
        for batch in batches:
            out = []
            for kind, key in zip(batch.column("kind").to_pylist(), batch.column("key").to_pylist(), strict=True):
                ok = kind == DELETE or key in live or len(live) < max_keys
                if ok and kind == PUT:
                    live.add(key)
                elif kind == DELETE:
                    live.discard(key)
                out.append("EXECUTE" if ok else "RESOURCE_EXHAUSTED")
            yield pa.RecordBatch.from_arrays([batch.column("global_seq"), pa.array(out)], names=["global_seq", "decision"])

    return rows.mapInArrow(run, "global_seq long, decision string")


def op_counters(attempts: DataFrame) -> DataFrame:
    """Engine counters over attempts."""
    kinds = attempts.select("pos", "kind").join(classify(attempts).select("pos", "decision"), "pos")
    ran = F.col("decision") == EXECUTE
    return kinds.agg(
        F.count("*").alias("attempts"),
        F.count_if(ran & (F.col("kind") == PUT)).alias("puts"),
        F.count_if(ran & (F.col("kind") == DELETE)).alias("deletes"),
        F.count_if(F.col("decision") == DUPLICATE).alias("dup_hits"),
        F.count_if(~F.col("decision").isin(EXECUTE, DUPLICATE)).alias("rejections"),
    )


def engine_stats(commands: DataFrame) -> DataFrame:
    """Applied sequence, live keys, sessions and encoded log bytes."""
    size = 24 + codec.command_bytes(F.col("kind"), F.col("key"), F.col("value"))
    top = commands.agg(F.max("global_seq").alias("applied_seq"), F.sum(size).alias("frame_bytes"))
    keys = latest_state(commands).agg(F.count("*").alias("live_keys"))
    return top.join(F.broadcast(keys)).join(F.broadcast(session_table(commands).agg(F.count("*").alias("sessions"))))


def _requests(s, d):
    """Deliveries with every 11th key emptied, 13th client and 17th sequence zeroed."""
    spoil = lambda n, c, bad: F.when(F.col("pos") % n == 0, F.lit(bad)).otherwise(F.col(c)).alias(c)
    return deliveries(s, d).select("pos", spoil(13, "client", 0), spoil(17, "request_seq", 0), "kind", spoil(11, "key", ""), spoil(19, "value", "v" * 40))


QUERIES = {
    "validate_requests": lambda s, d: validate_requests(_requests(s, d), max_value=30),
    "admission_classify": lambda s, d: classify(deliveries(s, d)),
    "session_high_water": lambda s, d: high_water(deliveries(s, d)),
    "session_capacity": lambda s, d: session_capacity(deliveries(s, d), 100),
    "op_counters": lambda s, d: op_counters(deliveries(s, d)),
    "engine_stats": lambda s, d: engine_stats(cmd_log(s, d)),
    "key_capacity": lambda s, d: key_capacity(cmd_log(s, d), 50),
}

_FOLD = f""", att AS (
  SELECT client, pos, request_seq, kind, {codec.DIGEST_SQL} AS digest, row_number() OVER (PARTITION BY client ORDER BY pos) AS rn FROM deliveries
), fold AS (
  SELECT client, rn, pos, request_seq, kind, CASE WHEN request_seq = 1 THEN 'EXECUTE' ELSE 'SEQUENCE_GAP' END AS decision,
         CASE WHEN request_seq = 1 THEN 1 ELSE 0 END AS high_water, CASE WHEN request_seq = 1 THEN digest END AS last FROM att WHERE rn = 1
  UNION ALL
  SELECT a.client, a.rn, a.pos, a.request_seq, a.kind,
         CASE WHEN a.request_seq = f.high_water + 1 THEN 'EXECUTE' WHEN f.high_water = 0 OR a.request_seq > f.high_water THEN 'SEQUENCE_GAP'
              WHEN a.request_seq < f.high_water THEN 'DUPLICATE_RESULT_EXPIRED' WHEN a.digest = f.last THEN 'DUPLICATE' ELSE 'REQUEST_ID_REUSE' END,
         CASE WHEN a.request_seq = f.high_water + 1 THEN a.request_seq ELSE f.high_water END,
         CASE WHEN a.request_seq = f.high_water + 1 THEN a.digest ELSE f.last END
  FROM fold f JOIN att a ON a.client = f.client AND a.rn = f.rn + 1)"""


def _recursive(body: str) -> str:
    return sql(body, "cmd_log", "deliveries").replace("WITH ", "WITH RECURSIVE ", 1)


ORACLE_SQL = {
    "validate_requests": sql(""", bad AS (
      SELECT pos, CASE WHEN pos % 13 = 0 THEN 0 ELSE client END AS client, CASE WHEN pos % 17 = 0 THEN 0 ELSE request_seq END AS request_seq,
             CASE WHEN pos % 11 = 0 THEN '' ELSE key END AS key, CASE WHEN pos % 19 = 0 THEN repeat('v', 40) ELSE value END AS value FROM deliveries
    ), why AS (
      SELECT pos, CASE WHEN octet_length(encode(key)) NOT BETWEEN 1 AND 1024 THEN 'key length' WHEN octet_length(encode(value)) > 30 THEN 'value length'
             WHEN client = 0 THEN 'zero client' WHEN request_seq < 1 THEN 'zero sequence' END AS reason FROM bad
    ) SELECT pos, CASE WHEN reason IS NULL THEN 'OK' ELSE 'INVALID_ARGUMENT' END AS code, reason FROM why""", "cmd_log", "deliveries"),
    "admission_classify": _recursive(_FOLD + " SELECT pos, client, request_seq, decision, high_water FROM fold"),
    "session_high_water": _recursive(_FOLD + " SELECT client, max(high_water) AS last_sequence, count(*) AS attempts, count(*) FILTER (WHERE decision = 'EXECUTE') AS executed FROM fold GROUP BY client"),
    "key_capacity": sql(""", c AS MATERIALIZED (SELECT global_seq, kind, key FROM cmd_log
    ), fold AS (
      SELECT CAST(0 AS BIGINT) AS global_seq, CAST([] AS VARCHAR[]) AS live, '' AS decision
      UNION ALL
      SELECT c.global_seq, CASE WHEN kind = 2 THEN list_filter(live, lambda x: x <> key) WHEN list_contains(live, key) OR len(live) >= 50 THEN live ELSE list_append(live, key) END,
             CASE WHEN kind = 2 OR list_contains(live, key) OR len(live) < 50 THEN 'EXECUTE' ELSE 'RESOURCE_EXHAUSTED' END
      FROM fold f JOIN c ON c.global_seq = f.global_seq + 1
    ) SELECT global_seq, decision FROM fold WHERE global_seq > 0""", "cmd_log").replace("WITH ", "WITH RECURSIVE ", 1),
    "session_capacity": sql(""", f AS (SELECT client, min(pos) AS first_pos FROM deliveries WHERE request_seq = 1 GROUP BY client)
      SELECT client, first_pos, CASE WHEN row_number() OVER (ORDER BY first_pos, client) <= 100 THEN 'EXECUTE' ELSE 'RESOURCE_EXHAUSTED' END AS decision FROM f""", "cmd_log", "deliveries"),
    "op_counters": _recursive(_FOLD + """ SELECT count(*) AS attempts, count(*) FILTER (WHERE decision = 'EXECUTE' AND kind = 1) AS puts, count(*) FILTER (WHERE decision = 'EXECUTE' AND kind = 2) AS deletes,
      count(*) FILTER (WHERE decision = 'DUPLICATE') AS dup_hits, count(*) FILTER (WHERE decision NOT IN ('EXECUTE', 'DUPLICATE')) AS rejections FROM fold"""),
    "engine_stats": sql(""", last AS (SELECT key, arg_max(kind, global_seq) AS kind FROM cmd_log GROUP BY key)
      SELECT max(global_seq) AS applied_seq, sum(54 + octet_length(encode(key)) + CASE WHEN kind = 1 THEN 4 + octet_length(encode(value)) ELSE 0 END)::BIGINT AS frame_bytes,
             (SELECT count(*) FROM last WHERE kind = 1) AS live_keys, count(DISTINCT client) AS sessions FROM cmd_log""", "cmd_log"),
}
