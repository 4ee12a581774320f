"""Safety checks over logs and traces: one row per checked unit, with its number of violations."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from chronofold.operators.consensus import _MATCH, commit_index, matches
from chronofold.sources.changelog import msg_log, replica_log, sql

#: Steps of a sender that one window of ``sendable`` holds.
BLOCK_STEPS = 1 << 16


def applied_agree(log: DataFrame, commits: DataFrame) -> DataFrame:
    """At each committed index all nodes that hold it hold one command."""
    held = log.join(commits.select("g", "commit_idx"), "g").where("idx <= commit_idx")
    per = held.groupBy("g", "idx").agg((F.min(F.struct("term", "data")) != F.max(F.struct("term", "data"))).alias("bad"))
    return per.groupBy("g").agg(F.count("*").alias("checked"), F.count_if("bad").alias("violations"))


def log_matching(log: DataFrame) -> DataFrame:
    """Where two logs have an entry of equal index and term, all before it is equal too."""
    a = log.select("g", "idx", F.col("node").alias("a"), F.col("term").alias("a_term"), F.col("data").alias("a_data"))
    b = log.select("g", "idx", F.col("node").alias("b"), F.col("term").alias("b_term"), F.col("data").alias("b_data"))
    both = a.join(b, ["g", "idx"]).where("a < b")
    differs = (F.col("a_term") != F.col("b_term")) | (F.col("a_data") != F.col("b_data"))
    line = Window.partitionBy("g", "a", "b").orderBy("idx")
    marked = both.select("g", "a", "b", (F.col("a_term") == F.col("b_term")).alias("same_term"), F.max(differs).over(line).alias("off"))
    return marked.groupBy("g", "a", "b").agg(F.count("*").alias("checked"), F.count_if(F.col("same_term") & F.col("off")).alias("violations"))


def election_safety(appends: DataFrame) -> DataFrame:
    """At most one node leads (sends appends) in a term."""
    return appends.groupBy("g", "term").agg((F.min("src") != F.max("src")).cast("long").alias("violations"), F.count("*").alias("checked"))


def leader_completeness(log: DataFrame, commits: DataFrame, leader: int) -> DataFrame:
    """Committed entries that a leader's log lacks, by group."""
    held = log.where("node = 1").join(commits.select("g", "commit_idx"), "g").where("idx <= commit_idx").select("g", "idx", "term")
    own = log.where(F.col("node") == leader).select("g", "idx", "term", F.lit(True).alias("has"))
    return held.join(own, ["g", "idx", "term"], "left").groupBy("g").agg(F.count("*").alias("checked"), F.count_if(F.col("has").isNull()).alias("violations"))


def append_only(before: DataFrame, after: DataFrame) -> DataFrame:
    """Entries of a log that a later look at it lacks or has changed, by group."""
    later = after.select("g", "idx", F.col("term").alias("t2"), F.col("data").alias("d2"))
    changed = ~(F.col("term").eqNullSafe(F.col("t2")) & F.col("data").eqNullSafe(F.col("d2")))
    return before.join(later, ["g", "idx"], "left").groupBy("g").agg(F.count("*").alias("checked"), F.count_if(changed).alias("violations"))


def sendable(messages: DataFrame, durable: DataFrame) -> DataFrame:
    """Messages whose term exceeds what their sender had durably stored by then (durable: step, src, durable_term).

    An as-of join over both kinds of rows by windows of a sender's ``BLOCK_STEPS``
    steps; what holds at a block's begin comes from a row per block.
    """
    rows = messages.select("step", "src", F.lit(1).alias("kind"), "term", F.lit(None).cast("long").alias("durable_term")).unionByName(durable.select("step", "src", F.lit(0).alias("kind"), F.lit(None).cast("long").alias("term"), "durable_term"))
    rows = rows.withColumn("block", F.expr(f"step div {BLOCK_STEPS}"))
    blocks = rows.groupBy("src", "block").agg(F.max_by("durable_term", F.when(F.col("kind") == 0, F.col("step"))).alias("last_term"))
    carried = F.last("last_term", ignorenulls=True).over(Window.partitionBy("src").orderBy("block").rowsBetween(Window.unboundedPreceding, -1))
    inside = F.last("durable_term", ignorenulls=True).over(Window.partitionBy("src", "block").orderBy("step", "kind").rowsBetween(Window.unboundedPreceding, 0))
    rows = rows.select("src", "block", "kind", "term", inside.alias("inside")).join(blocks.select("src", "block", carried.alias("carried")), ["src", "block"])
    rows = rows.select("src", "kind", "term", F.coalesce("inside", "carried").alias("known")).where("kind = 1")
    return rows.groupBy("src").agg(F.count("*").alias("checked"), F.count_if(F.col("term") > F.coalesce("known", F.lit(0))).alias("violations"))


def _commits(s, d):
    log = replica_log(s, d)
    return commit_index(matches(log), log.where("node = 1"))


def _node(s, d, node):
    return replica_log(s, d).where(F.col("node") == node)


def _durable(s, d):
    """Every 40th step each sender stores the term of then."""
    m = msg_log(s, d).where("step % 40 = 0")
    return m.select("step", F.explode(F.array(*(F.lit(i) for i in (1, 2, 3)))).alias("src"), F.col("term").alias("durable_term"))


def _earlier_leader(s, d):
    """The leader's log when it was half as long; every seventh group's then ended in an entry that it changed since."""
    own = _node(s, d, 1)
    half = own.groupBy("g").agg(F.expr("max(idx) div 2").alias("half"))
    changed = ((F.col("g") % 7 == 0) & (F.col("idx") == F.col("half"))).cast("long")
    return own.join(half, "g").where("idx <= half").select("g", "node", "idx", (F.col("term") + changed).alias("term"), "data")


def _committed_then_and_now(s, d):
    """Node 2's committed entries, and its log later on; every eleventh group's lost the last of them."""
    own = _node(s, d, 2).join(_commits(s, d).select("g", "commit_idx"), "g")
    return own.where("idx <= commit_idx"), own.where("NOT (g % 11 = 0 AND idx = commit_idx)")


QUERIES = {
    "inv_applied_agree": lambda s, d: applied_agree(replica_log(s, d), _commits(s, d)),
    "inv_log_matching": lambda s, d: log_matching(replica_log(s, d)),
    "inv_election_safety": lambda s, d: election_safety(msg_log(s, d).where("type = 'Append'")),
    "inv_leader_completeness": lambda s, d: leader_completeness(replica_log(s, d), _commits(s, d), leader=2),
    "inv_leader_append_only": lambda s, d: append_only(_earlier_leader(s, d), _node(s, d, 1)),
    "inv_committed_stable": lambda s, d: append_only(*_committed_then_and_now(s, d)),
    "inv_sendable": lambda s, d: sendable(msg_log(s, d), _durable(s, d)),
}

_PAIR = "SELECT b.g, count(*) AS checked, count(*) FILTER (WHERE b.term IS DISTINCT FROM a.term OR b.data IS DISTINCT FROM a.data) AS violations"

ORACLE_SQL = {
    "inv_applied_agree": sql(_MATCH + """ SELECT g, count(*) AS checked, count(*) FILTER (WHERE n > 1) AS violations FROM (SELECT r.g, r.idx, count(DISTINCT (r.term, r.data)) AS n FROM replica_log r JOIN ci USING (g) WHERE r.idx <= commit_idx GROUP BY r.g, r.idx) GROUP BY g""", "replica_log"),
    "inv_log_matching": sql(""", both_ AS (SELECT x.g, x.node AS a, y.node AS b, x.term = y.term AS same_term, max(CASE WHEN x.term <> y.term OR x.data <> y.data THEN 1 ELSE 0 END) OVER (PARTITION BY x.g, x.node, y.node ORDER BY x.idx) AS off
        FROM replica_log x JOIN replica_log y ON x.g = y.g AND x.idx = y.idx AND x.node < y.node)
      SELECT g, a, b, count(*) AS checked, count(*) FILTER (WHERE same_term AND off = 1) AS violations FROM both_ GROUP BY g, a, b""", "replica_log"),
    "inv_election_safety": sql(" SELECT g, term, CAST(count(DISTINCT src) > 1 AS BIGINT) AS violations, count(*) AS checked FROM msg_log WHERE type = 'Append' GROUP BY g, term", "msg_log"),
    "inv_leader_completeness": sql(_MATCH + """ SELECT b.g, count(*) AS checked, count(*) FILTER (WHERE a.idx IS NULL) AS violations FROM replica_log b JOIN ci USING (g) LEFT JOIN replica_log a ON a.g = b.g AND a.idx = b.idx AND a.term = b.term AND a.node = 2
      WHERE b.node = 1 AND b.idx <= commit_idx GROUP BY b.g""", "replica_log"),
    "inv_leader_append_only": sql(f""", half AS (SELECT g, max(idx) // 2 AS half FROM replica_log WHERE node = 1 GROUP BY g
      ), then_ AS (SELECT g, idx, term + CASE WHEN g % 7 = 0 AND idx = half THEN 1 ELSE 0 END AS term, data FROM replica_log JOIN half USING (g) WHERE node = 1 AND idx <= half)
      {_PAIR} FROM then_ b LEFT JOIN replica_log a ON a.g = b.g AND a.idx = b.idx AND a.node = 1 GROUP BY b.g""", "replica_log"),
    "inv_committed_stable": sql(_MATCH + f""" {_PAIR} FROM replica_log b JOIN ci USING (g) LEFT JOIN replica_log a ON a.g = b.g AND a.idx = b.idx AND a.node = 2 AND NOT (a.g % 11 = 0 AND a.idx = commit_idx)
      WHERE b.node = 2 AND b.idx <= commit_idx GROUP BY b.g""", "replica_log"),
    "inv_sendable": sql(""", dur AS (SELECT m.step, s.src, m.term AS durable_term FROM msg_log m, (SELECT unnest([1, 2, 3]) AS src) s WHERE m.step % 40 = 0)
      SELECT m.src, count(*) AS checked, count(*) FILTER (WHERE m.term > coalesce(d.durable_term, 0)) AS violations FROM msg_log m ASOF LEFT JOIN dur d ON d.src = m.src AND d.step <= m.step GROUP BY m.src""", "msg_log"),
}
