"""Operational metrics: counters, log sizes, lag, percentiles, spans, events."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chronofold import model
from chronofold.operators.replog import bounds, entry_bytes
from chronofold.sources.changelog import events, msg_log, replica_log, sql, trace_span

#: Classes of a duration for each doubling.
CLASSES = 64


def message_counters(messages: DataFrame) -> DataFrame:
    """Per sender: messages in all, rejections, and a map of counts by type."""
    by_type = messages.groupBy("src", "type").agg(F.count("*").alias("n"), F.count_if("reject").alias("rejected"))
    return by_type.groupBy("src").agg(F.sum("n").alias("sent"), F.sum("rejected").alias("rejected"), F.map_from_entries(F.sort_array(F.collect_list(F.struct("type", "n")))).alias("by_type"))


def log_sizes(log: DataFrame) -> DataFrame:
    return log.groupBy("g", "node").agg(F.count("*").alias("entries"), F.sum(entry_bytes()).alias("bytes"))


def follower_lag(matched: DataFrame, leader: DataFrame) -> DataFrame:
    ends = bounds(leader).select("g", F.col("last_idx").alias("leader_last"))
    return matched.join(ends, "g").select("g", "node", (F.col("leader_last") - F.col("match_idx")).alias("lag"))


def percentiles(spans: DataFrame, of: tuple[float, ...] = (0.5, 0.95, 0.99)) -> DataFrame:
    """Per span the value at place floor((n - 1) * p) of its sorted durations.

    Durations are counted by value, and values by class of size.  Only a span's
    classes (some thousand at most) are put in line, and the values of those few
    classes that hold a wanted place.
    """
    counted = spans.groupBy("span", "duration_ns").agg(F.count("*").alias("n")).withColumn("class", F.floor(F.log2(F.col("duration_ns") + 1) * CLASSES))
    by_class = counted.groupBy("span", "class").agg(F.sum("n").alias("held"))
    line, whole = Window.partitionBy("span").orderBy("class"), Window.partitionBy("span")
    by_class = by_class.select("span", "class", (F.sum("held").over(line) - F.col("held")).alias("before"), "held", F.sum("held").over(whole).alias("all"))
    wanted = F.explode(F.array(*(F.struct(F.lit(i).alias("i"), F.floor((F.col("all") - 1) * F.lit(p)).alias("place")) for i, p in enumerate(of))))
    wanted = by_class.select("span", "class", "before", "held", "all", wanted.alias("w")).where("w.place >= before AND w.place < before + held")
    inside = Window.partitionBy("span", "i").orderBy("duration_ns")
    placed = counted.join(wanted.select("span", "class", "all", F.col("w.i").alias("i"), (F.col("w.place") - F.col("before")).alias("place")), ["span", "class"])
    placed = placed.withColumn("upto", F.sum("n").over(inside)).where("upto > place")
    return placed.groupBy("span").agg(F.max("all").alias("n"), *(F.min(F.when(F.col("i") == i, F.col("duration_ns"))).alias(f"p{round(100 * p)}") for i, p in enumerate(of)))


def throughput(rows: DataFrame, name: str, at: str = "ts") -> DataFrame:
    """Rows of each ``name`` per second, in thousandths, over the time that all rows span."""
    us = F.unix_micros(at)
    whole = rows.agg((F.max(us) - F.min(us)).alias("elapsed_us"))
    counted = rows.groupBy(name).agg(F.count("*").alias("n")).join(F.broadcast(whole))  # one row
    return counted.select(name, "n", "elapsed_us", F.expr("n * 1000000000 div elapsed_us").alias("per_1000_s"))


def message_text() -> Column:
    """One line for a message: type, sender, receiver, term."""
    return F.format_string("%s %d->%d term=%d", F.col("type"), F.col("src"), F.col("dst"), F.col("term"))


def span_means(spans: DataFrame) -> DataFrame:
    return spans.groupBy("span").agg(F.count("*").alias("n"), F.expr("sum(duration_ns) div count(*)").alias("mean_ns"))


def span_check(spans: DataFrame, totals: DataFrame) -> DataFrame:
    """Whether an operation's spans, which follow each other, fit in its total."""
    sums = spans.groupBy("op").agg(F.sum("duration_ns").alias("span_ns"), F.count("*").alias("spans"))
    return sums.join(totals, "op").select("op", "spans", "span_ns", "total_ns", (F.col("span_ns") <= F.col("total_ns")).alias("fits"))


def event_counts(rows: DataFrame, name: str) -> DataFrame:
    return rows.groupBy(name).agg(F.count("*").alias("n"))


#: Names of engine events that the fixture's event types stand for.
EVENT_NAMES = {"signup": "snapshot.published", "purchase": "wal.segment.sealed", "view": "session.dedup.hit", "click": "session.rejected", "error": "storage.failure"}


def _engine_events(s, d):
    names = F.create_map(*(F.lit(x) for pair in EVENT_NAMES.items() for x in pair))
    return events(s, d).select(F.element_at(names, F.col("event_type")).alias("event_name"))


def _totals(s, d):
    """Five spans' sum and ten more, but one less for every seventh operation."""
    sums = trace_span(s, d).groupBy("op").agg(F.sum("duration_ns").alias("x"))
    return sums.select("op", (F.col("x") + F.when(F.col("op") % 7 == 0, -1).otherwise(10)).alias("total_ns"))


def _observations(s, d):
    kind = F.when(F.col("type") == "RequestVote", "election_started").when((F.col("type") == "RequestVoteResp") & F.col("reject"), "vote_denied").when(F.col("type") == "RequestVoteResp", "vote_granted").when((F.col("type") == "AppendResp") & F.col("reject"), "append_rejected").otherwise("commit_advanced")
    return msg_log(s, d).select(kind.alias("kind"), "src")


def _lag(s, d):
    from chronofold.operators.consensus import matches

    log = replica_log(s, d)
    return follower_lag(matches(log), log.where("node = 1"))


QUERIES = {
    "message_counters": lambda s, d: (lambda m: m.select("src", "sent", "rejected", *(F.coalesce(F.try_element_at("by_type", F.lit(t)), F.lit(0)).alias(t) for t in model.MESSAGE_TYPES.values())))(message_counters(msg_log(s, d))),
    "log_size_metrics": lambda s, d: log_sizes(replica_log(s, d)),
    "follower_lag": lambda s, d: _lag(s, d),
    "latency_percentiles": lambda s, d: percentiles(trace_span(s, d)),
    "throughput": lambda s, d: throughput(events(s, d).withColumn("ts", F.col("ts").cast("timestamp")), "event_type"),
    "message_text": lambda s, d: msg_log(s, d).select("step", message_text().alias("line")),
    "span_means": lambda s, d: span_means(trace_span(s, d)),
    "trace_span_check": lambda s, d: span_check(trace_span(s, d), _totals(s, d)),
    "engine_event_counts": lambda s, d: event_counts(_engine_events(s, d), "event_name"),
    "observation_counts": lambda s, d: _observations(s, d).groupBy("kind", "src").agg(F.count("*").alias("n")),
}

ORACLE_SQL = {
    "message_counters": sql(" SELECT src, count(*) AS sent, count(*) FILTER (WHERE reject) AS rejected, " + ", ".join(f"count(*) FILTER (WHERE type = '{t}') AS \"{t}\"" for t in model.MESSAGE_TYPES.values()) + " FROM msg_log GROUP BY src", "msg_log"),
    "log_size_metrics": sql(" SELECT g, node, count(*) AS entries, sum(octet_length(encode(data)) + 16)::BIGINT AS bytes FROM replica_log GROUP BY g, node", "replica_log"),
    "follower_lag": sql(""" SELECT r.g, r.node, (SELECT max(idx) FROM replica_log e WHERE e.g = r.g AND e.node = 1) - coalesce(min(CASE WHEN l.term IS DISTINCT FROM r.term THEN r.idx END) - 1, max(r.idx)) AS lag
      FROM replica_log r LEFT JOIN replica_log l ON l.g = r.g AND l.idx = r.idx AND l.node = 1 GROUP BY r.g, r.node""", "replica_log"),
    "latency_percentiles": sql(""", o AS (SELECT span, list(duration_ns ORDER BY duration_ns) AS v FROM trace_span GROUP BY span)
      SELECT span, len(v) AS n, v[CAST(floor((len(v) - 1) * 0.5) AS BIGINT) + 1] AS p50, v[CAST(floor((len(v) - 1) * 0.95) AS BIGINT) + 1] AS p95, v[CAST(floor((len(v) - 1) * 0.99) AS BIGINT) + 1] AS p99 FROM o""", "trace_span"),
    "throughput": """SELECT event_type, count(*) AS n, (SELECT epoch_us(max(ts)) - epoch_us(min(ts)) FROM events) AS elapsed_us,
      (count(*) * 1000000000) // (SELECT epoch_us(max(ts)) - epoch_us(min(ts)) FROM events) AS per_1000_s FROM events GROUP BY event_type""",
    "message_text": sql(" SELECT step, type || ' ' || src || '->' || dst || ' term=' || term AS line FROM msg_log", "msg_log"),
    "span_means": sql(" SELECT span, count(*) AS n, (sum(duration_ns) // count(*))::BIGINT AS mean_ns FROM trace_span GROUP BY span", "trace_span"),
    "trace_span_check": sql(" SELECT op, count(*) AS spans, sum(duration_ns)::BIGINT AS span_ns, sum(duration_ns)::BIGINT + CASE WHEN op % 7 = 0 THEN -1 ELSE 10 END AS total_ns, op % 7 <> 0 AS fits FROM trace_span GROUP BY op", "trace_span"),
    "engine_event_counts": "SELECT CASE event_type " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in EVENT_NAMES.items()) + " END AS event_name, count(*) AS n FROM events GROUP BY 1",
    "observation_counts": sql(""" SELECT CASE WHEN type = 'RequestVote' THEN 'election_started' WHEN type = 'RequestVoteResp' AND reject THEN 'vote_denied' WHEN type = 'RequestVoteResp' THEN 'vote_granted'
      WHEN type = 'AppendResp' AND reject THEN 'append_rejected' ELSE 'commit_advanced' END AS kind, src, count(*) AS n FROM msg_log GROUP BY 1, 2""", "msg_log"),
}
