"""Change logs, deliveries, replicated logs, messages and spans derived from ``events``.

``SQL`` holds the same definitions for the oracle.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from chronofold.cluster import materialise

#: Entries of one term in a replicated log, and how far apart a diverged node's term lies.
TERM_ENTRIES, DIVERGED_TERMS = 10, 50
NODES = 3


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/events.parquet")


def cmd_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The change log: event_id is dense and follows time, so it gives the global sequence without a sort."""
    e = events(spark, sf_dir)
    per_client = Window.partitionBy("user_id").orderBy("ts", "event_id")
    kind = F.when(F.col("event_type") == "error", 2).otherwise(1)
    return e.select(
        (F.col("event_id") + 1).alias("global_seq"),
        (F.col("user_id") + 1).alias("client"),
        F.row_number().over(per_client).cast("long").alias("request_seq"),
        kind.alias("kind"),
        F.get_json_object("props", "$.k").alias("key"),
        F.when(kind == 1, F.col("value").cast("string")).alias("value"),
    )


def global_sequence(rows: DataFrame, *order: str) -> DataFrame:
    """``rows`` with ``global_seq`` = 1, 2, 3… in ``order``, without sorting in one task.

    Rows are range-partitioned and sorted; a partition's rows follow the rows of
    all partitions before it, whose counts are a number each.
    """
    sorted_rows = rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("at", F.monotonically_increasing_id())
    held = materialise(sorted_rows.select("*", F.shiftright("at", 33).alias("part"), F.col("at").bitwiseAND((1 << 33) - 1).alias("within")), "sequence")
    counts = held.groupBy("part").count()  # a row for each partition, not for each row
    before = counts.select(F.col("part").alias("p"), (F.sum("count").over(Window.orderBy("part")) - F.col("count")).alias("base"))
    return held.join(F.broadcast(before), held["part"] == before["p"]).withColumn("global_seq", F.col("base") + F.col("within") + 1).drop("at", "part", "within", "p", "base")


def deliveries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Attempted requests: every command, with gaps, retries, altered retries and stale requests between."""
    c = cmd_log(spark, sf_dir)
    seq, own = F.col("global_seq"), F.col("request_seq")

    def attempt(on, pos, request=own, value=F.col("value")):
        return F.when(on, F.struct(pos.alias("pos"), request.alias("request_seq"), value.alias("value")))

    altered = F.when(F.col("kind") == 1, F.concat("value", F.lit("!"))).otherwise(F.lit(None))
    altered_kind = F.when(F.col("kind") == 2, 1).otherwise(F.col("kind"))
    rows = F.filter(
        F.array(
            attempt(F.lit(True), 5 * seq + 1),
            attempt(seq % 23 == 0, 5 * seq, own + 5),
            attempt(seq % 10 == 0, 5 * seq + 2),
            attempt(seq % 17 == 0, 5 * seq + 3, own, F.coalesce(altered, F.lit("!"))),
            attempt((seq % 13 == 0) & (own > 1), 5 * seq + 4, own - 1),
        ),
        lambda x: x.isNotNull(),
    )
    out = c.select("client", "key", "kind", altered_kind.alias("other_kind"), F.explode(rows).alias("x"))
    is_altered = F.col("x.pos") % 5 == 3
    return out.select(F.col("x.pos").alias("pos"), "client", F.col("x.request_seq").alias("request_seq"), F.when(is_altered, F.col("other_kind")).otherwise(F.col("kind")).alias("kind"), "key", F.col("x.value").alias("value"))


def replica_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Logs of groups of three nodes: node 2 lags, node 3 has a diverged suffix of a later term."""
    e = events(spark, sf_dir)
    per_group = Window.partitionBy("user_id")
    e = e.select(F.col("user_id").alias("g"), "event_id", F.row_number().over(per_group.orderBy("ts", "event_id")).cast("long").alias("idx"), F.count("*").over(per_group).alias("n"))
    common = F.greatest(F.lit(0), F.col("n") - 3 - F.col("g") % 4)
    term_at = lambda i: F.expr(f"1 + ({i} - 1) div {TERM_ENTRIES}")
    e = e.withColumn("common", common).withColumn("node", F.explode(F.array(*(F.lit(i) for i in range(1, NODES + 1)))))
    e = e.where((F.col("node") != 2) | (F.col("idx") <= F.col("n") - F.col("g") % 5))
    diverged = (F.col("node") == 3) & (F.col("idx") > F.col("common"))
    term = F.when(diverged, term_at("greatest(common, 1)") + DIVERGED_TERMS).otherwise(term_at("idx"))
    data = F.concat(F.when(diverged, F.lit("x")).otherwise(F.lit("e")), F.col("event_id").cast("string"))
    return e.select("g", "node", "idx", term.cast("long").alias("term"), data.alias("data"))


def msg_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Messages between nodes 1..3, from events."""
    e = events(spark, sf_dir)
    kind = F.when(F.col("event_type") == "signup", "RequestVote").when(F.col("event_type") == "purchase", "RequestVoteResp").when(F.col("event_type") == "error", "AppendResp").otherwise("Append")
    return e.select(
        F.col("event_id").alias("step"),
        F.expr("user_id div 10").alias("g"),
        kind.alias("type"),
        (F.col("user_id") % 3 + 1).cast("int").alias("src"),
        ((F.col("user_id") + F.col("event_id") % 2 + 1) % 3 + 1).cast("int").alias("dst"),
        F.expr("1 + event_id div 1000").alias("term"),
        F.expr("event_id % 97").alias("last_idx"),
        F.expr("1 + event_id % 7").alias("last_term"),
        (F.col("event_id") % 3 == 0).alias("reject"),
        F.expr("event_id % 50").alias("match_index"),
    )


def trace_span(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spans: an operation is five events, a span's nanoseconds come from the event's value."""
    return events(spark, sf_dir).select(F.expr("event_id div 5").alias("op"), F.col("event_id").alias("at"), F.col("event_type").alias("span"), F.expr("cast(floor(abs(value) * 1000) as bigint)").alias("duration_ns"))


SQL = {
    "cmd_log": """cmd_log AS (
  SELECT event_id + 1 AS global_seq, user_id + 1 AS client, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS request_seq,
         CASE WHEN event_type = 'error' THEN 2 ELSE 1 END AS kind, props->>'$.k' AS key,
         CASE WHEN event_type = 'error' THEN NULL ELSE CAST(value AS VARCHAR) END AS value FROM events)""",
    "deliveries": """deliveries AS (
  SELECT 5 * global_seq + 1 AS pos, client, request_seq, kind, key, value FROM cmd_log
  UNION ALL SELECT 5 * global_seq, client, request_seq + 5, kind, key, value FROM cmd_log WHERE global_seq % 23 = 0
  UNION ALL SELECT 5 * global_seq + 2, client, request_seq, kind, key, value FROM cmd_log WHERE global_seq % 10 = 0
  UNION ALL SELECT 5 * global_seq + 3, client, request_seq, 1, key, CASE WHEN kind = 1 THEN value || '!' ELSE '!' END FROM cmd_log WHERE global_seq % 17 = 0
  UNION ALL SELECT 5 * global_seq + 4, client, request_seq - 1, kind, key, value FROM cmd_log WHERE global_seq % 13 = 0 AND request_seq > 1)""",
    "replica_log": f"""r0 AS (
  SELECT user_id AS g, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS idx, count(*) OVER (PARTITION BY user_id) AS n FROM events
), r1 AS (
  SELECT *, greatest(0, n - 3 - g % 4) AS common, unnest([1, 2, 3]) AS node FROM r0
), replica_log AS (
  SELECT g, node, idx, CASE WHEN node = 3 AND idx > common THEN 1 + (greatest(common, 1) - 1) // {TERM_ENTRIES} + {DIVERGED_TERMS} ELSE 1 + (idx - 1) // {TERM_ENTRIES} END AS term,
         CASE WHEN node = 3 AND idx > common THEN 'x' ELSE 'e' END || event_id AS data
  FROM r1 WHERE node <> 2 OR idx <= n - g % 5)""",
    "msg_log": """msg_log AS (
  SELECT event_id AS step, user_id // 10 AS g, CASE event_type WHEN 'signup' THEN 'RequestVote' WHEN 'purchase' THEN 'RequestVoteResp' WHEN 'error' THEN 'AppendResp' ELSE 'Append' END AS type,
         user_id % 3 + 1 AS src, (user_id + event_id % 2 + 1) % 3 + 1 AS dst, 1 + event_id // 1000 AS term, event_id % 97 AS last_idx, 1 + event_id % 7 AS last_term,
         event_id % 3 = 0 AS reject, event_id % 50 AS match_index FROM events)""",
    "trace_span": """trace_span AS (
  SELECT event_id // 5 AS op, event_id AS at, event_type AS span, CAST(floor(abs(value) * 1000) AS BIGINT) AS duration_ns FROM events)""",
}


def sql(body: str, *views: str) -> str:
    """``body`` (which may begin with further views, comma first) over the named views."""
    return "WITH " + ", ".join(SQL[v] for v in views) + "\n" + body
