"""Algebra of replicated logs: ranges, conflicts, truncation, hints.

A log is rows (g, node, idx, term, data): many groups at once, each a few nodes.
Windows are per log, so their partitions are bounded by one log, not by all.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from chronofold import model
from chronofold.sources.changelog import replica_log, sql

COMPACTED, UNAVAILABLE, OUT_OF_ORDER = "COMPACTED", "UNAVAILABLE", "OUT_OF_ORDER"


def bounds(log: DataFrame) -> DataFrame:
    return log.groupBy("g", "node").agg(F.min("idx").alias("first_idx"), F.max("idx").alias("last_idx"), F.max_by("term", "idx").alias("last_term"))


def term_lookup(log: DataFrame, probes: DataFrame) -> DataFrame:
    """The term at each probed index, 0 at the place just before the first entry, or why there is none."""
    edges = bounds(log).select("g", "node", "first_idx", "last_idx")
    rows = probes.join(edges, ["g", "node"]).join(log.select("g", "node", "idx", "term"), ["g", "node", "idx"], "left")
    state = F.when(F.col("idx") < F.col("first_idx") - 1, COMPACTED).when(F.col("idx") > F.col("last_idx"), UNAVAILABLE).otherwise("OK")
    return rows.select("g", "node", "idx", state.alias("state"), F.when(F.col("idx") == F.col("first_idx") - 1, 0).otherwise(F.col("term")).alias("term"))


def entry_bytes():
    return F.octet_length("data") + model.ENTRY_OVERHEAD_BYTES


def range_within(log: DataFrame, budget: int, lo: int = 1, hi: int | None = None, most: int = model.MAX_ENTRIES_PER_MESSAGE) -> DataFrame:
    """Entries lo..hi-1 of each log that fit ``budget`` bytes and ``most`` rows; the first always does."""
    rows = log.where((F.col("idx") >= lo) & (F.lit(True) if hi is None else F.col("idx") < hi))
    line = Window.partitionBy("g", "node").orderBy("idx")
    rows = rows.select("*", F.row_number().over(line).alias("rn"), F.sum(entry_bytes()).over(line).alias("upto"))
    return rows.where((F.col("rn") <= most) & ((F.col("upto") <= budget) | (F.col("rn") == 1))).select("g", "node", "idx", "term", "upto")


def overlay(store: DataFrame, unstable: DataFrame) -> DataFrame:
    """Unstable entries hide the store's from their first index on."""
    first = unstable.groupBy("g").agg(F.min("idx").alias("split"))
    below = store.join(first, "g", "left").where(F.col("split").isNull() | (F.col("idx") < F.col("split"))).drop("split")
    return below.unionByName(unstable)


def validate_append(stored: DataFrame, batch: DataFrame) -> DataFrame:
    """OK or OUT_OF_ORDER for each group's batch: next index, no gap, terms that never fall (also against the log's last)."""
    line = Window.partitionBy("g").orderBy("ord")
    end = bounds(stored).select("g", "last_idx", "last_term")
    rows = batch.select("g", "ord", "idx", "term", F.lag("idx").over(line).alias("before"), F.lag("term").over(line).alias("term_before")).join(end, "g", "left")
    before, term_before = F.coalesce("before", "last_idx", F.lit(0)), F.coalesce("term_before", "last_term", F.lit(0))
    bad = (F.col("idx") != before + 1) | (F.col("term") < term_before)
    return rows.groupBy("g").agg(F.count("*").alias("entries"), F.when(F.count_if(bad) > 0, OUT_OF_ORDER).otherwise("OK").alias("result"))


def first_conflict(follower: DataFrame, incoming: DataFrame) -> DataFrame:
    """For each group the first incoming index that the follower lacks or has with another term; null: none."""
    own = follower.select("g", "idx", F.col("term").alias("own_term"))
    differs = ~F.col("term").eqNullSafe(F.col("own_term"))
    return incoming.join(own, ["g", "idx"], "left").groupBy("g").agg(F.min(F.when(differs, F.col("idx"))).alias("conflict"))


def truncate_and_append(follower: DataFrame, incoming: DataFrame) -> DataFrame:
    """The follower's log after an append: what agrees stays, the rest is replaced."""
    at = first_conflict(follower, incoming)
    kept = follower.join(at, "g", "left").where(F.col("conflict").isNull() | (F.col("idx") < F.col("conflict"))).select("g", "idx", "term", "data")
    return kept.unionByName(incoming.join(at, "g").where(F.col("idx") >= F.col("conflict")).select("g", "idx", "term", "data"))


def conflict_hint(follower: DataFrame, probes: DataFrame) -> DataFrame:
    """Where a leader should resume after its previous entry (prev_idx) did not match: the start of the run of that
    term, or one past the end where there is no such entry."""
    end = follower.groupBy("g").agg(F.max("idx").alias("last_idx"))
    at = probes.join(follower.select("g", F.col("idx").alias("prev_idx"), F.col("term").alias("prev_term")), ["g", "prev_idx"], "left").join(end, "g", "left")
    starts = follower.groupBy("g", F.col("term").alias("prev_term")).agg(F.min("idx").alias("first_of_term"))  # terms never fall: a term is one run
    rows = at.join(starts, ["g", "prev_term"], "left")
    missing = F.col("prev_term").isNull()
    return rows.select("g", "prev_idx", F.when(missing, F.coalesce("last_idx", F.lit(0)) + 1).otherwise(F.col("first_of_term")).alias("hint"), F.coalesce("prev_term", F.lit(0)).alias("hint_term"))


def last_of_term(log: DataFrame) -> DataFrame:
    return log.groupBy("g", "node", "term").agg(F.max("idx").alias("last_idx"))


def leader_backup(leader: DataFrame, rejections: DataFrame) -> DataFrame:
    """The leader's next index for a peer after a rejection (next_idx, hint, hint_term): only ever back, never below 1."""
    own = leader.groupBy("g", F.col("term").alias("hint_term")).agg(F.max("idx").alias("own_last"))
    rows = rejections.join(own, ["g", "hint_term"], "left")
    wanted = F.when((F.col("hint_term") > 0) & F.col("own_last").isNotNull(), F.col("own_last") + 1).otherwise(F.col("hint"))
    return rows.select("g", F.least("next_idx", F.greatest(F.lit(1), wanted)).alias("next_idx"))


def _node(s, d, node):
    return replica_log(s, d).where(F.col("node") == node)


def _compacted(s, d):
    """Even groups have lost their first three entries."""
    return replica_log(s, d).where((F.col("g") % 2 == 1) | (F.col("idx") > 3))


def _probes(s, d):
    ends = bounds(replica_log(s, d))
    return ends.select("g", "node", F.explode(F.array_distinct(F.array(F.lit(0).cast("long"), F.lit(1).cast("long"), F.lit(3).cast("long"), F.lit(4).cast("long"), F.col("last_idx"), F.col("last_idx") + 1))).alias("idx"))


def _batch(s, d):
    """Batches of four entries after node 1's log, four of five kinds spoiled."""
    g, ends = F.col("g"), bounds(_node(s, d, 1))
    start = F.when(g % 5 == 1, F.col("last_idx") + 2).when(g % 5 == 2, F.col("last_idx")).otherwise(F.col("last_idx") + 1)
    rows = ends.select("g", "last_idx", "last_term", start.alias("start"), F.explode(F.sequence(F.lit(0), F.lit(3))).alias("ord"))
    return rows.select("g", "ord", (F.col("start") + F.col("ord") + F.when((g % 5 == 3) & (F.col("ord") >= 2), 1).otherwise(0)).alias("idx"), (F.col("last_term") + F.when((g % 5 == 4) & (F.col("ord") == 3), -1).otherwise(0)).alias("term"))


def _rejections(s, d):
    """Node 3's hints for the entry at the leader's last index, with the leader's next index past its end."""
    ends = bounds(_node(s, d, 1)).select("g", F.col("last_idx").alias("prev_idx"))
    return conflict_hint(_node(s, d, 3), ends).select("g", (F.col("prev_idx") + 1).alias("next_idx"), "hint", "hint_term")


def _appended(s, d):
    follower, leader = _node(s, d, 3), _node(s, d, 1)
    return truncate_and_append(follower, leader)


QUERIES = {
    "log_bounds": lambda s, d: bounds(replica_log(s, d)),
    "log_term_lookup": lambda s, d: term_lookup(_compacted(s, d), _probes(s, d)),
    "log_range_budget": lambda s, d: range_within(replica_log(s, d), 400, lo=2),
    "log_overlay_range": lambda s, d: range_within(overlay(_node(s, d, 2), _node(s, d, 3).where(F.col("term") > 50).withColumn("node", F.lit(2))), 1 << 20, lo=5, hi=40),
    "log_append_validate": lambda s, d: validate_append(_node(s, d, 1), _batch(s, d)),
    "log_truncate_suffix": lambda s, d: (lambda log: log.join(bounds(log).select("g", "node", F.expr("last_idx div 2").alias("cut")), ["g", "node"]).where("idx < cut").select("g", "node", "idx", "term"))(replica_log(s, d)),
    "log_apply_entries": lambda s, d: overlay(_node(s, d, 2), _node(s, d, 1).where("idx > 20")).select("g", "idx", "term", "data"),
    "log_first_conflict": lambda s, d: first_conflict(_node(s, d, 3), _node(s, d, 1)),
    "log_truncate_and_append": lambda s, d: _appended(s, d),
    "log_next_committed": lambda s, d: (lambda log: log.join(bounds(log).select("g", F.expr("last_idx div 3").alias("applied"), F.expr("last_idx - last_idx div 4").alias("committed")), "g").where("idx > applied AND idx <= committed").select("g", "idx", "term", "data"))(_node(s, d, 1)),
    "conflict_hint": lambda s, d: conflict_hint(_node(s, d, 3), bounds(_node(s, d, 1)).select("g", (F.col("last_idx") + F.when(F.col("g") % 3 == 0, 5).otherwise(0)).alias("prev_idx"))),
    "last_index_of_term": lambda s, d: last_of_term(replica_log(s, d)),
    "leader_backup": lambda s, d: leader_backup(_node(s, d, 1), _rejections(s, d)),
}

_ENDS = ", ends AS (SELECT g, node, min(idx) AS first_idx, max(idx) AS last_idx, arg_max(term, idx) AS last_term FROM replica_log GROUP BY g, node)"
_CONFLICT = ", conf AS (SELECT l.g, min(CASE WHEN f.term IS DISTINCT FROM l.term THEN l.idx END) AS conflict FROM replica_log l LEFT JOIN replica_log f ON f.g = l.g AND f.idx = l.idx AND f.node = 3 WHERE l.node = 1 GROUP BY l.g)"


def _hint(extra: str) -> str:
    return f""", pr AS (SELECT g, last_idx + {extra} AS prev_idx FROM ends WHERE node = 1
), hint AS (SELECT p.g, p.prev_idx, coalesce(f.term, 0) AS hint_term, CASE WHEN f.term IS NULL THEN (SELECT max(idx) FROM replica_log r WHERE r.g = p.g AND r.node = 3) + 1
    ELSE (SELECT min(idx) FROM replica_log r WHERE r.g = p.g AND r.node = 3 AND r.term = f.term) END AS hint
  FROM pr p LEFT JOIN replica_log f ON f.g = p.g AND f.idx = p.prev_idx AND f.node = 3)"""


ORACLE_SQL = {
    "log_bounds": sql(_ENDS + " SELECT * FROM ends", "replica_log"),
    "log_term_lookup": sql(_ENDS + """, cut AS (SELECT * FROM replica_log WHERE g % 2 = 1 OR idx > 3), cb AS (SELECT g, node, min(idx) AS first_idx, max(idx) AS last_idx FROM cut GROUP BY g, node),
      pr AS (SELECT DISTINCT g, node, unnest([0, 1, 3, 4, last_idx, last_idx + 1]) AS idx FROM ends)
      SELECT p.g, p.node, p.idx, CASE WHEN p.idx < first_idx - 1 THEN 'COMPACTED' WHEN p.idx > last_idx THEN 'UNAVAILABLE' ELSE 'OK' END AS state, CASE WHEN p.idx = first_idx - 1 THEN 0 ELSE term END AS term
      FROM pr p JOIN cb USING (g, node) LEFT JOIN cut c USING (g, node, idx)""", "replica_log"),
    "log_range_budget": sql(""" SELECT g, node, idx, term, upto FROM (SELECT g, node, idx, term, row_number() OVER w AS rn, sum(octet_length(encode(data)) + 16) OVER w::BIGINT AS upto FROM replica_log WHERE idx >= 2
      WINDOW w AS (PARTITION BY g, node ORDER BY idx)) WHERE rn <= 64 AND (upto <= 400 OR rn = 1)""", "replica_log"),
    "log_overlay_range": sql(""", un AS (SELECT * FROM replica_log WHERE node = 3 AND term > 50), sp AS (SELECT g, min(idx) AS split FROM un GROUP BY g),
      ov AS (SELECT r.g, r.idx, r.term, r.data FROM replica_log r LEFT JOIN sp USING (g) WHERE node = 2 AND (split IS NULL OR r.idx < split) UNION ALL SELECT g, idx, term, data FROM un)
      SELECT g, 2 AS node, idx, term, upto FROM (SELECT *, row_number() OVER w AS rn, sum(octet_length(encode(data)) + 16) OVER w::BIGINT AS upto FROM ov WHERE idx >= 5 AND idx < 40 WINDOW w AS (PARTITION BY g ORDER BY idx)) WHERE rn <= 64""", "replica_log"),
    "log_append_validate": sql(" SELECT g, 4 AS entries, CASE WHEN g % 5 = 0 THEN 'OK' ELSE 'OUT_OF_ORDER' END AS result FROM (SELECT DISTINCT g FROM replica_log)", "replica_log"),
    "log_truncate_suffix": sql(_ENDS + " SELECT r.g, r.node, r.idx, r.term FROM replica_log r JOIN ends e USING (g, node) WHERE r.idx < last_idx // 2", "replica_log"),
    "log_apply_entries": sql(""" SELECT g, idx, term, data FROM replica_log r WHERE node = 1 AND idx > 20 UNION ALL
      SELECT g, idx, term, data FROM replica_log r WHERE node = 2 AND (idx <= 20 OR NOT EXISTS (SELECT 1 FROM replica_log l WHERE l.g = r.g AND l.node = 1 AND l.idx > 20))""", "replica_log"),
    "log_first_conflict": sql(_CONFLICT + " SELECT * FROM conf", "replica_log"),
    "log_truncate_and_append": sql(_CONFLICT + """ SELECT g, idx, term, data FROM replica_log JOIN conf USING (g) WHERE node = 3 AND (conflict IS NULL OR idx < conflict)
      UNION ALL SELECT g, idx, term, data FROM replica_log JOIN conf USING (g) WHERE node = 1 AND idx >= conflict""", "replica_log"),
    "log_next_committed": sql(_ENDS + " SELECT r.g, r.idx, r.term, r.data FROM replica_log r JOIN ends e USING (g, node) WHERE node = 1 AND r.idx > last_idx // 3 AND r.idx <= last_idx - last_idx // 4", "replica_log"),
    "conflict_hint": sql(_ENDS + _hint("CASE WHEN g % 3 = 0 THEN 5 ELSE 0 END") + " SELECT g, prev_idx, hint, hint_term FROM hint", "replica_log"),
    "last_index_of_term": sql(" SELECT g, node, term, max(idx) AS last_idx FROM replica_log GROUP BY g, node, term", "replica_log"),
    "leader_backup": sql(_ENDS + _hint("0") + """ SELECT h.g, least(prev_idx + 1, greatest(1, coalesce((SELECT max(idx) + 1 FROM replica_log r WHERE r.g = h.g AND r.node = 1 AND r.term = h.hint_term AND h.hint_term > 0), hint))) AS next_idx FROM hint h""", "replica_log"),
}
