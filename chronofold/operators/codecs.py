"""Queries over the canonical binary forms."""

from __future__ import annotations

from pyspark.sql import functions as F

from chronofold import model
from chronofold.functions import codec
from chronofold.sources.changelog import cmd_log, sql

_OWN = ("kind", "client", "request_seq", "key", "value")


def _encoded(s, d):
    return cmd_log(s, d).withColumn("encoded", codec.command_hex(*map(F.col, _OWN)))


def _damaged(s, d):
    """Encoded commands with one kind of damage for each of eleven rows, and every twelfth intact."""
    h, n = F.col("encoded"), F.col("global_seq") % 12
    put = lambda at, new: F.concat(F.substr(h, F.lit(1), F.lit(2 * at)), F.lit(new), F.substr(h, F.lit(2 * at + len(new) + 1)))
    bad = (
        F.when(n == 0, "").when(n == 1, F.substr(h, F.lit(1), F.lit(40))).when(n == 2, put(0, "09")).when(n == 3, put(1, "07"))
        .when(n == 4, put(2, "00" * 16)).when(n == 5, put(18, "00" * 8)).when(n == 6, put(26, "00000000")).when(n == 7, put(26, "FFFF0000"))
        .when(n == 8, F.substr(h, F.lit(1), F.length(h) - 2)).when(n == 9, F.concat(h, F.lit("00"))).when(n == 10, put(18, "FF" * 8)).otherwise(h)
    )
    return _encoded(s, d).select("global_seq", bad.alias("bytes_hex"))


def _names(s):
    """Good and impossible names, by number."""
    n = F.col("id")
    start, end = F.lpad(n.cast("string"), 20, "0"), F.lpad((n + 9).cast("string"), 20, "0")
    name = (
        F.when(n % 9 == 0, F.concat(F.lit("wal-"), start, F.lit(".active")))
        .when(n % 9 == 1, F.concat(F.lit("wal-"), start, F.lit("-"), end, F.lit(".sealed")))
        .when(n % 9 == 2, F.concat(F.lit("wal-"), n.cast("string"), F.lit(".active")))
        .when(n % 9 == 3, F.concat(F.lit("wal-"), end, F.lit("-"), start, F.lit(".sealed")))
        .when(n % 9 == 4, F.concat(F.lit("wal-"), start, F.lit("_"), end, F.lit(".sealed")))
        .when(n % 9 == 5, F.concat(F.lit("snapshot-"), start, F.lit(".snap")))
        .when(n % 9 == 6, F.concat(F.lit("snapshot-"), start, F.lit(".tmp")))
        .when(n % 9 == 7, F.concat(F.lit("snapshot-x"), start, F.lit(".snap")))
        .otherwise(F.concat(F.lit("wal-"), start, F.lit(".old")))
    )
    return s.range(0, 900).select(name.alias("name"))


def _fields(df, column, name):
    return df.select(name, *(F.col(f"{column}.{f}").alias(f) for f in df.schema[column].dataType.names))


QUERIES = {
    "command_encoded_len": lambda s, d: cmd_log(s, d).select("global_seq", codec.command_bytes(F.col("kind"), F.col("key"), F.col("value")).alias("bytes")),
    "command_encode": lambda s, d: _encoded(s, d).select("global_seq", "encoded"),
    "command_decode": lambda s, d: _fields(_damaged(s, d).select("global_seq", codec.decode_command(F.col("bytes_hex")).alias("c")), "c", "global_seq"),
    "command_digest": lambda s, d: cmd_log(s, d).select("global_seq", codec.command_digest(F.col("kind"), F.col("key"), F.col("value")).alias("digest")),
    "segment_name_format": lambda s, d: cmd_log(s, d).select("global_seq", codec.segment_name(F.col("global_seq"), F.when(F.col("kind") == 1, F.col("global_seq") + F.col("client"))).alias("name")),
    "segment_name_parse": lambda s, d: _fields(_names(s).select("name", codec.parse_segment_name(F.col("name")).alias("p")), "p", "name"),
    "snapshot_name_parse": lambda s, d: _fields(_names(s).select("name", codec.parse_snapshot_name(F.col("name")).alias("p")), "p", "name"),
    "enum_names": lambda s, d: codec.enum_names(s),
}

_NAMES_SQL = """WITH n AS (SELECT range AS id, lpad(CAST(range AS VARCHAR), 20, '0') AS a, lpad(CAST(range + 9 AS VARCHAR), 20, '0') AS z FROM range(900)
), names AS (SELECT CASE id % 9 WHEN 0 THEN 'wal-' || a || '.active' WHEN 1 THEN 'wal-' || a || '-' || z || '.sealed' WHEN 2 THEN 'wal-' || id || '.active'
  WHEN 3 THEN 'wal-' || z || '-' || a || '.sealed' WHEN 4 THEN 'wal-' || a || '_' || z || '.sealed' WHEN 5 THEN 'snapshot-' || a || '.snap'
  WHEN 6 THEN 'snapshot-' || a || '.tmp' WHEN 7 THEN 'snapshot-x' || a || '.snap' ELSE 'wal-' || a || '.old' END AS name FROM n)"""

ORACLE_SQL = {
    "command_encoded_len": sql(" SELECT global_seq, 30 + octet_length(encode(key)) + CASE WHEN kind = 1 THEN 4 + octet_length(encode(value)) ELSE 0 END AS bytes FROM cmd_log", "cmd_log"),
    "command_encode": sql(f" SELECT global_seq, {codec.COMMAND_SQL} AS encoded FROM cmd_log", "cmd_log"),
    "command_decode": sql(""", why AS (SELECT *, CASE global_seq % 12 WHEN 0 THEN 'short' WHEN 1 THEN 'short' WHEN 2 THEN 'schema' WHEN 3 THEN 'kind' WHEN 4 THEN 'zero client' WHEN 5 THEN 'zero sequence'
        WHEN 6 THEN 'key length' WHEN 7 THEN 'key length' WHEN 8 THEN CASE WHEN kind = 1 THEN 'value bytes' ELSE 'key truncated' END
        WHEN 9 THEN CASE WHEN kind = 1 THEN 'value bytes' ELSE 'trailing bytes' END WHEN 10 THEN 'sequence out of range' END AS error FROM cmd_log)
      SELECT global_seq, CASE WHEN error IS NULL THEN kind END AS kind, CASE WHEN error IS NULL THEN client END AS client, CASE WHEN error IS NULL THEN request_seq END AS request_seq,
        CASE WHEN error IS NULL THEN key END AS key, CASE WHEN error IS NULL THEN value END AS value, error FROM why""", "cmd_log"),
    "command_digest": sql(f" SELECT global_seq, {codec.DIGEST_SQL} AS digest FROM cmd_log", "cmd_log"),
    "segment_name_format": sql(" SELECT global_seq, CASE WHEN kind = 1 THEN printf('wal-%020d-%020d.sealed', global_seq, global_seq + client) ELSE printf('wal-%020d.active', global_seq) END AS name FROM cmd_log", "cmd_log"),
    "segment_name_parse": _NAMES_SQL + """, p AS (SELECT name, CASE WHEN name NOT LIKE 'wal-%' THEN 'prefix' WHEN NOT regexp_matches(name, '[.](active|sealed)$') THEN 'suffix'
        WHEN NOT regexp_matches(name, '^wal-[0-9]{20}([.]active|-[0-9]{20}[.]sealed)$') THEN 'sequence field' WHEN name LIKE '%.sealed' AND substr(name, 26, 20) < substr(name, 5, 20) THEN 'ends before start' END AS error FROM names)
      SELECT name, CASE WHEN error IS NULL THEN CAST(substr(name, 5, 20) AS BIGINT) END AS start_seq, CASE WHEN error IS NULL AND name LIKE '%.sealed' THEN CAST(substr(name, 26, 20) AS BIGINT) END AS end_seq,
        CASE WHEN error IS NULL THEN name LIKE '%.sealed' END AS sealed, error FROM p""",
    "snapshot_name_parse": _NAMES_SQL + """, p AS (SELECT name, CASE WHEN name NOT LIKE 'snapshot-%' THEN 'prefix' WHEN NOT regexp_matches(name, '[.](snap|tmp)$') THEN 'suffix'
        WHEN NOT regexp_matches(name, '^snapshot-[0-9]{20}[.]') THEN 'sequence field' END AS error FROM names)
      SELECT name, CASE WHEN error IS NULL THEN CAST(substr(name, 10, 20) AS BIGINT) END AS seq, CASE WHEN error IS NULL THEN name LIKE '%.snap' END AS final, error FROM p""",
    "enum_names": "SELECT * FROM (VALUES " + ", ".join(f"('{k}', {n}, '{v}')" for k, names in model.ENUMS.items() for n, v in names.items()) + ") t(enum, number, name)",
}
