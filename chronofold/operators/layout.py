"""Segments, snapshots and recovery rules of a stored change log."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from chronofold import model
from chronofold.cluster import materialise, ship
from chronofold.functions import codec
from chronofold.operators.codecs import _NAMES_SQL, _names
from chronofold.operators.fold import latest_state, session_table
from chronofold.sources.changelog import cmd_log, global_sequence, sql

TARGET_BYTES = 4096
#: Frames of a chunk in segment assignment; divides the row numbers of a partition evenly.
CHUNK_FRAMES = 256


def frame_sizes(commands: DataFrame) -> DataFrame:
    size = model.FRAME_HEADER_BYTES + codec.command_bytes(F.col("kind"), F.col("key"), F.col("value"))
    return commands.select("global_seq", size.alias("bytes"))


def assign_segments(frames: DataFrame, target: int = TARGET_BYTES) -> DataFrame:
    """The segment (1, 2, 3…) of each frame: a segment closes once it holds ``target`` bytes.

    The size starts anew in each segment, so where segments begin is a fold.
    Frames are range-sorted in parallel and cut into chunks of ``CHUNK_FRAMES``.
    Only chunks stream through one task, a row for each, with the sizes in it;
    a chunk in which no segment ends is one addition.  It answers with the segment
    that each chunk begins in and the frames at which segments end in it, and
    frames meet their chunk's answer by a join.
    """
    ship(frames.sparkSession)
    at = frames.repartitionByRange("global_seq").sortWithinPartitions("global_seq").withColumn("at", F.monotonically_increasing_id())
    held = materialise(at.select("global_seq", "bytes", F.expr(f"at div {CHUNK_FRAMES}").alias("chunk")), "frames-in-order")
    chunks = held.groupBy("chunk").agg(F.sum("bytes").alias("total"), F.sort_array(F.collect_list(F.struct("global_seq", "bytes"))).alias("frames"))

    def run(batches):
        segment, size = 1, model.SEGMENT_HEADER_BYTES
        for batch in batches:
            begins, ends = [], []
            for total, inside in zip(batch.column("total").to_pylist(), batch.column("frames"), strict=True):
                begins.append(segment)
                ends.append([])
                if size + total < target:
                    size += total
                    continue
                for r in inside.as_py():
                    size += r["bytes"]
                    if size >= target:
                        ends[-1].append(r["global_seq"])
                        segment, size = segment + 1, model.SEGMENT_HEADER_BYTES
            yield pa.RecordBatch.from_arrays([batch.column("chunk"), pa.array(begins, pa.int64()), pa.array(ends, pa.list_(pa.int64()))], names=["chunk", "begins_in", "ends"])

    marks = chunks.repartition(1).sortWithinPartitions("chunk").mapInArrow(run, "chunk long, begins_in long, ends array<long>")
    segment = F.col("begins_in") + F.size(F.filter("ends", lambda e: e < F.col("global_seq")))
    return held.join(marks, "chunk").select("global_seq", "bytes", segment.alias("segment"))


def segment_table(assigned: DataFrame) -> DataFrame:
    """One row per segment; the newest is active, without end, unless it is full."""
    rows = assigned.groupBy("segment").agg(F.min("global_seq").alias("start_seq"), F.max("global_seq").alias("last_seq"), F.count("*").alias("records"), (F.sum("bytes") + model.SEGMENT_HEADER_BYTES).alias("bytes"))
    newest = rows.agg(F.max("segment").alias("newest"))
    return rows.join(F.broadcast(newest)).select("segment", "start_seq", "last_seq", "records", "bytes", (F.col("segment") < F.col("newest")).alias("sealed"), F.when(F.col("segment") < F.col("newest"), F.col("last_seq")).alias("end_seq"))


def chain_problems(segments: DataFrame, snapshot_seq: int = 0) -> DataFrame:
    """What is wrong between each segment and the one before, by start; the list of segments is small."""
    line = Window.orderBy("start_seq", "segment")
    before, following = F.lag("end_seq").over(line), F.lead("start_seq").over(line)
    first = F.row_number().over(line) == 1
    problem = (
        F.when(~F.col("sealed") & following.isNotNull(), "active segment is not the newest")
        .when(first & (F.col("start_seq") > snapshot_seq + 1), "gap after snapshot")
        .when(F.col("start_seq") <= before, "overlap")
        .when(F.col("start_seq") > before + 1, "gap")
    )
    return segments.select("segment", "start_seq", "end_seq", problem.alias("problem"))


def record_contiguity(records: DataFrame, segments: DataFrame) -> DataFrame:
    """For each segment: records, breaks in its sequence, and whether it ends as its name says."""
    breaks = F.col("global_seq") - F.lag("global_seq").over(Window.partitionBy("segment").orderBy("global_seq")) != 1
    found = records.select("segment", "global_seq", F.coalesce(breaks, F.lit(False)).alias("broken")).groupBy("segment").agg(F.count("*").alias("records"), F.count_if("broken").alias("breaks"), F.max("global_seq").alias("ends"))
    return found.join(segments.select("segment", "end_seq"), "segment").select("segment", "records", "breaks", (F.col("end_seq").isNull() | (F.col("end_seq") == F.col("ends"))).alias("end_matches"))


def tail_decision(errors: DataFrame) -> DataFrame:
    """TRUNCATE or CORRUPTION for a frame error: only a torn end of the newest active segment may go."""
    torn = F.col("newest") & ~F.col("sealed") & (F.col("incomplete") | (F.col("offset") + F.col("size") == F.col("length")))
    return errors.select("*", F.when(torn, "TRUNCATE").otherwise("CORRUPTION").alias("decision"), F.when(torn, F.col("length") - F.col("offset")).alias("dropped"))


def classify_files(files: DataFrame) -> DataFrame:
    """What each file of a data directory is (name, is_dir)."""
    n = F.col("name")
    kind = (
        F.when(F.col("is_dir"), "directory").when(n == "LOCK", "lock")
        .when(n.startswith("snapshot-") & (F.length(n) > 9), F.when(n.endswith(".tmp"), "temporary snapshot").otherwise("snapshot"))
        .when(n.startswith("wal-") & (F.length(n) > 4), "segment").otherwise("unknown")
    )
    return files.select("name", kind.alias("file_kind"))


def snapshots_in(names: DataFrame) -> DataFrame:
    return names.select("name", codec.parse_snapshot_name(F.col("name")).alias("p")).select("name", "p.*").where("error IS NULL AND final").select("name", "seq")


def retention(snapshots: DataFrame, keep: int = model.RETAINED_SNAPSHOTS) -> DataFrame:
    """The newest ``keep`` stay; only those travel, so no task sorts all."""
    newest = snapshots.orderBy(F.desc("seq")).limit(keep).select(F.col("name").alias("kept_name"))
    return snapshots.join(F.broadcast(newest), F.col("name") == F.col("kept_name"), "left").select("name", "seq", F.when(F.col("kept_name").isNotNull(), "keep").otherwise("delete").alias("action"))


def compaction_plan(segments: DataFrame, through: int, failing: int | None = None) -> DataFrame:
    """Sealed segments that a snapshot through ``through`` covers go, oldest first, until one fails."""
    covered = F.col("sealed") & (F.col("end_seq") <= through)
    blocked = F.col("segment") >= F.lit(failing) if failing is not None else F.lit(False)
    return segments.select("segment", "start_seq", "end_seq", F.when(~covered, "keep").when(blocked, "left after failure").otherwise("delete").alias("action"))


def order_check(rows: DataFrame, key: str) -> DataFrame:
    """Rows (ordinal, key) and how many do not ascend; a self-join on the next ordinal, not one sorted task."""
    following = rows.select((F.col("ordinal") - 1).alias("ordinal"), F.col(key).alias("next_key"))
    return rows.join(following, "ordinal", "left").agg(F.count("*").alias("rows"), F.count_if(F.col("next_key") <= F.col(key)).alias("violations"))


def _numbered(rows: DataFrame, key: str) -> DataFrame:
    return global_sequence(rows, key).withColumnRenamed("global_seq", "ordinal")


def _half_state(s, d):
    commands = cmd_log(s, d)
    half = commands.agg(F.expr("max(global_seq) div 2").alias("s"))
    return commands.join(F.broadcast(half)).where("global_seq <= s").drop("s")


def _assigned(s, d):
    return assign_segments(frame_sizes(cmd_log(s, d)))


def _segments(s, d):
    return segment_table(_assigned(s, d))


def _damaged_segments(s, d):
    n = F.col("segment")
    return _segments(s, d).select("segment", F.when(n % 17 == 0, F.col("start_seq") + 1).when(n % 19 == 0, F.col("start_seq") - 1).otherwise(F.col("start_seq")).alias("start_seq"), F.when(n % 23 != 0, F.col("end_seq")).alias("end_seq"), ((n % 23 != 0) & F.col("sealed")).alias("sealed"))


def _errors(s):
    """Every combination of position and kind of a frame error, by number."""
    n = F.col("id")
    return s.range(0, 240).select(
        "id", (n % 2 == 0).alias("newest"), (F.expr("id div 2") % 2 == 0).alias("sealed"), (F.expr("id div 4") % 2 == 0).alias("incomplete"),
        (F.lit(100) + n).alias("offset"), (F.expr("id div 8") % 3 * 40).alias("size"), F.when(F.expr("id div 24") % 2 == 0, F.lit(100) + n + 40).otherwise(F.lit(500) + n).alias("length"),
    )


def _files(s):
    extra = s.createDataFrame([("LOCK", False), ("lost+found", True), ("wal-", False), ("notes.txt", False)], "name string, is_dir boolean")
    return _names(s).withColumn("is_dir", F.lit(False)).unionByName(extra)


QUERIES = {
    "segment_assignment": lambda s, d: _assigned(s, d),
    "segment_chain_check": lambda s, d: chain_problems(_damaged_segments(s, d)),
    "record_contiguity": lambda s, d: (lambda a: record_contiguity(a.where("global_seq % 101 <> 0"), segment_table(a)))(_assigned(s, d)),
    "tail_decision": lambda s, d: tail_decision(_errors(s)),
    "file_catalog": lambda s, d: classify_files(_files(s)),
    "wal_bytes": lambda s, d: _segments(s, d).agg(F.count("*").alias("segments"), F.sum("bytes").alias("bytes")),
    "snapshot_select": lambda s, d: snapshots_in(_names(s)).agg(F.max("seq").alias("seq"), F.max_by("name", "seq").alias("name")),
    "snapshot_retention": lambda s, d: retention(snapshots_in(_names(s))),
    "compaction_plan": lambda s, d: compaction_plan(_segments(s, d), 5000, failing=40),
    "snapshot_rows": lambda s, d: _numbered(latest_state(_half_state(s, d)), "key").select("ordinal", "key", "value"),
    "snapshot_sessions": lambda s, d: _numbered(session_table(_half_state(s, d)), "client").select("ordinal", "client", "last_sequence", "applied_seq"),
    "snapshot_order_check": lambda s, d: order_check(_numbered(latest_state(_half_state(s, d)), "key").select("ordinal", F.when(F.col("ordinal") % 10 == 0, F.lit("")).otherwise(F.col("key")).alias("key")), "key"),
    "global_sequence": lambda s, d: global_sequence(s.read.parquet(f"{d}/events.parquet").select("event_id", "ts"), "ts", "event_id").select("event_id", "global_seq"),
}

_SEGMENTS = f""", sizes AS (
  SELECT global_seq, 54 + octet_length(encode(key)) + CASE WHEN kind = 1 THEN 4 + octet_length(encode(value)) ELSE 0 END AS bytes FROM cmd_log
), run AS (SELECT *, sum(bytes) OVER (ORDER BY global_seq)::BIGINT AS upto FROM sizes
), chain AS (
  SELECT 1 AS segment, CAST(1 AS BIGINT) AS start_seq, CAST(0 AS BIGINT) AS base
  UNION ALL
  SELECT segment + 1, (SELECT min(r.global_seq) FROM run r WHERE r.upto - c.base + 32 >= {TARGET_BYTES} AND r.global_seq >= c.start_seq) + 1,
         (SELECT min(r.upto) FROM run r WHERE r.upto - c.base + 32 >= {TARGET_BYTES} AND r.global_seq >= c.start_seq)
  FROM chain c WHERE EXISTS (SELECT 1 FROM run r WHERE r.upto - c.base + 32 >= {TARGET_BYTES} AND r.global_seq >= c.start_seq)
), asg AS (
  SELECT r.global_seq, r.bytes, max(c.segment) AS segment FROM run r JOIN chain c ON c.start_seq <= r.global_seq GROUP BY r.global_seq, r.bytes
), seg AS (
  SELECT segment, min(global_seq) AS start_seq, max(global_seq) AS last_seq, count(*) AS records, sum(bytes)::BIGINT + 32 AS bytes,
         segment < max(segment) OVER () AS sealed, CASE WHEN segment < max(segment) OVER () THEN max(global_seq) END AS end_seq FROM asg GROUP BY segment)"""
_HALF = """, half AS (SELECT * FROM cmd_log WHERE global_seq <= (SELECT max(global_seq) // 2 FROM cmd_log)
), last AS (SELECT key, arg_max(kind, global_seq) AS kind, arg_max_null(value, global_seq) AS value FROM half GROUP BY key
), rws AS (SELECT row_number() OVER (ORDER BY encode(key)) AS ordinal, key, value FROM last WHERE kind = 1)"""


def _recursive(body: str) -> str:
    return sql(body, "cmd_log").replace("WITH ", "WITH RECURSIVE ", 1)


ORACLE_SQL = {
    "segment_assignment": _recursive(_SEGMENTS + " SELECT * FROM asg"),
    "segment_chain_check": _recursive(_SEGMENTS + """, dam AS (SELECT segment, CASE WHEN segment % 17 = 0 THEN start_seq + 1 WHEN segment % 19 = 0 THEN start_seq - 1 ELSE start_seq END AS start_seq,
        CASE WHEN segment % 23 <> 0 THEN end_seq END AS end_seq, segment % 23 <> 0 AND sealed AS sealed FROM seg)
      SELECT segment, start_seq, end_seq, CASE WHEN NOT sealed AND lead(start_seq) OVER w IS NOT NULL THEN 'active segment is not the newest' WHEN row_number() OVER w = 1 AND start_seq > 1 THEN 'gap after snapshot'
        WHEN start_seq <= lag(end_seq) OVER w THEN 'overlap' WHEN start_seq > lag(end_seq) OVER w + 1 THEN 'gap' END AS problem FROM dam WINDOW w AS (ORDER BY start_seq, segment)"""),
    "record_contiguity": _recursive(_SEGMENTS + """, rec AS (SELECT segment, global_seq, coalesce(global_seq - lag(global_seq) OVER (PARTITION BY segment ORDER BY global_seq) <> 1, false) AS broken FROM asg WHERE global_seq % 101 <> 0)
      SELECT segment, count(*) AS records, count(*) FILTER (WHERE broken) AS breaks, max(end_seq) IS NULL OR max(end_seq) = max(global_seq) AS end_matches FROM rec JOIN seg USING (segment) GROUP BY segment"""),
    "tail_decision": """WITH e AS (SELECT range AS id, range % 2 = 0 AS newest, (range // 2) % 2 = 0 AS sealed, (range // 4) % 2 = 0 AS incomplete, 100 + range AS "offset", (range // 8) % 3 * 40 AS size,
        CASE WHEN (range // 24) % 2 = 0 THEN 140 + range ELSE 500 + range END AS length FROM range(240)), t AS (SELECT *, newest AND NOT sealed AND (incomplete OR "offset" + size = length) AS torn FROM e)
      SELECT id, newest, sealed, incomplete, "offset", size, length, CASE WHEN torn THEN 'TRUNCATE' ELSE 'CORRUPTION' END AS decision, CASE WHEN torn THEN length - "offset" END AS dropped FROM t""",
    "file_catalog": _NAMES_SQL + """, f AS (SELECT name, false AS is_dir FROM names UNION ALL SELECT * FROM (VALUES ('LOCK', false), ('lost+found', true), ('wal-', false), ('notes.txt', false)) v(name, is_dir))
      SELECT name, CASE WHEN is_dir THEN 'directory' WHEN name = 'LOCK' THEN 'lock' WHEN name LIKE 'snapshot-_%' THEN CASE WHEN name LIKE '%.tmp' THEN 'temporary snapshot' ELSE 'snapshot' END
        WHEN name LIKE 'wal-_%' THEN 'segment' ELSE 'unknown' END AS file_kind FROM f""",
    "wal_bytes": _recursive(_SEGMENTS + " SELECT count(*) AS segments, sum(bytes)::BIGINT AS bytes FROM seg"),
    "snapshot_select": _NAMES_SQL + " SELECT max(CAST(substr(name, 10, 20) AS BIGINT)) AS seq, max(name) AS name FROM names WHERE regexp_matches(name, '^snapshot-[0-9]{20}[.]snap$')",
    "snapshot_retention": _NAMES_SQL + " SELECT name, CAST(substr(name, 10, 20) AS BIGINT) AS seq, CASE WHEN row_number() OVER (ORDER BY name DESC) <= 2 THEN 'keep' ELSE 'delete' END AS action FROM names WHERE regexp_matches(name, '^snapshot-[0-9]{20}[.]snap$')",
    "compaction_plan": _recursive(_SEGMENTS + " SELECT segment, start_seq, end_seq, CASE WHEN end_seq IS NULL OR end_seq > 5000 THEN 'keep' WHEN segment >= 40 THEN 'left after failure' ELSE 'delete' END AS action FROM seg"),
    "snapshot_rows": sql(_HALF + " SELECT ordinal, key, value FROM rws", "cmd_log"),
    "snapshot_sessions": sql(_HALF + " SELECT row_number() OVER (ORDER BY client) AS ordinal, client, max(request_seq) AS last_sequence, max(global_seq) AS applied_seq FROM half GROUP BY client", "cmd_log"),
    "snapshot_order_check": sql(_HALF + ", bad AS (SELECT ordinal, CASE WHEN ordinal % 10 = 0 THEN '' ELSE key END AS key FROM rws), nxt AS (SELECT key, lead(key) OVER (ORDER BY ordinal) AS next_key FROM bad) SELECT count(*) AS rows, count(*) FILTER (WHERE next_key <= key) AS violations FROM nxt", "cmd_log"),
    "global_sequence": "SELECT event_id, row_number() OVER (ORDER BY ts, event_id) AS global_seq FROM events",
}
