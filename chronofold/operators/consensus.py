"""Quorum, commit, vote and term rules as relational operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chronofold.operators.replog import bounds, first_conflict
from chronofold.sources.changelog import NODES, msg_log, replica_log, sql

QUORUM = NODES // 2 + 1


def quorum(n: Column) -> Column:
    return F.floor(n / 2).cast("int") + 1


def matches(log: DataFrame, leader: int = 1) -> DataFrame:
    """How far each node's log equals its group's leader's."""
    own = log.where(F.col("node") == leader).select("g", "idx", F.col("term").alias("l_term"))
    agreed = log.join(own, ["g", "idx"], "left").select("g", "node", "idx", F.col("term").eqNullSafe(F.col("l_term")).alias("same"))
    return agreed.groupBy("g", "node").agg(F.max("idx").alias("last_idx"), F.min(F.when(~F.col("same"), F.col("idx"))).alias("off")).select("g", "node", F.coalesce(F.col("off") - 1, "last_idx").alias("match_idx"))


def quorum_match(matched: DataFrame) -> DataFrame:
    """The highest index that a quorum of each group holds; a group has few nodes, so its matches are one short array."""
    rows = matched.groupBy("g").agg(F.sort_array(F.collect_list("match_idx"), asc=False).alias("m"))
    return rows.select("g", F.element_at("m", quorum(F.size("m")).cast("int")).alias("match_idx"))


def commit_index(matched: DataFrame, leader: DataFrame) -> DataFrame:
    """A leader commits the quorum's index only where its entry is of the current term; 0: nothing."""
    current = bounds(leader).select("g", F.col("last_term").alias("current_term"))
    rows = quorum_match(matched).join(leader.select("g", F.col("idx").alias("match_idx"), "term"), ["g", "match_idx"], "left").join(current, "g")
    return rows.select("g", "match_idx", F.when(F.col("term") == F.col("current_term"), F.col("match_idx")).otherwise(0).alias("commit_idx"))


def follower_commit(appends: DataFrame) -> DataFrame:
    """After an append (prev_idx, entries, leader_commit) a follower commits no further than its last new entry."""
    last_new = F.col("prev_idx") + F.col("entries")
    return appends.select("g", "node", F.greatest("commit_idx", F.least("leader_commit", last_new)).alias("commit_idx"))


def match_progress(answers: DataFrame) -> DataFrame:
    """A peer's match over time: acceptances only ever raise it."""
    line = Window.partitionBy("g", "src").orderBy("step").rowsBetween(Window.unboundedPreceding, 0)
    seen = F.max(F.when(~F.col("reject"), F.col("match_index"))).over(line)
    return answers.select("step", "g", "src", F.coalesce(seen, F.lit(0)).alias("match_idx"))


def term_rule(messages: DataFrame) -> DataFrame:
    """What a message's term does to a node in ``own_term``."""
    t, own = F.col("term"), F.col("own_term")
    asks = F.col("type").isin("RequestVote", "Append")
    action = F.when(t > own, F.when(F.col("type") == "Append", "follow sender").otherwise("step down")).when(t < own, F.when(asks, "reject").otherwise("drop")).otherwise("handle")
    return messages.select("step", "type", "term", "own_term", action.alias("action"), F.greatest(t, own).alias("new_term"))


def up_to_date() -> Column:
    """Last terms first, then last indexes."""
    return (F.col("last_term") > F.col("own_last_term")) | ((F.col("last_term") == F.col("own_last_term")) & (F.col("last_idx") >= F.col("own_last_idx")))


def vote_decision(requests: DataFrame) -> DataFrame:
    """granted, or the first reason against it."""
    free = (F.col("own_vote") == 0) | (F.col("own_vote") == F.col("src"))
    stale = F.col("term") < F.col("own_term")
    free = free | (F.col("term") > F.col("own_term"))  # a higher term clears the vote first
    reason = F.when(stale, "stale_term").when(~free, "already_voted").when(~up_to_date(), "candidate_log_behind")
    return requests.select("step", reason.isNull().alias("granted"), reason.alias("reason"))


def vote_tally(answers: DataFrame) -> DataFrame:
    """Votes for and against by group and term; each peer's first answer counts."""
    first = answers.groupBy("g", "term", "src").agg(F.min_by("reject", "step").alias("reject"))
    return first.groupBy("g", "term").agg(F.count_if(~F.col("reject")).alias("granted"), F.count_if("reject").alias("rejected"))


def election_outcome(tally: DataFrame, needed: int = QUORUM) -> DataFrame:
    outcome = F.when(F.col("granted") >= needed, "won").when(F.col("rejected") >= needed, "lost").otherwise("open")
    return tally.select("g", "term", "granted", "rejected", outcome.alias("outcome"))


def node_status(log: DataFrame, leader: int = 1) -> DataFrame:
    rows = bounds(log).join(commit_index(matches(log, leader), log.where(F.col("node") == leader)).select("g", "commit_idx"), "g")
    return rows.select("g", "node", F.when(F.col("node") == leader, "Leader").otherwise("Follower").alias("role"), "last_idx", "last_term", F.least("commit_idx", "last_idx").alias("commit_idx"))


def _received(s, d):
    """Messages beside the state of the node that gets them."""
    return msg_log(s, d).select("*", F.expr("1 + (step * 7) div 6500").alias("own_term"), F.expr("(step * 31) % 97").alias("own_last_idx"), F.expr("1 + (step * 3) % 7").alias("own_last_term"), F.expr("step % 4").alias("own_vote"))


def _leader(s, d):
    return replica_log(s, d).where("node = 1")


def _appends(s, d):
    log = replica_log(s, d)
    at = first_conflict(log.where("node = 3"), log.where("node = 1"))
    ends = bounds(log.where("node = 1")).select("g", "last_idx")
    return at.join(ends, "g").select("g", F.lit(3).alias("node"), (F.coalesce("conflict", F.col("last_idx") + 1) - 1).alias("prev_idx"), F.expr("g % 4").alias("entries"), F.col("last_idx").alias("leader_commit"), F.expr("last_idx div 2").alias("commit_idx"))


def _of(type_):
    return lambda s, d: msg_log(s, d).where(F.col("type") == type_)


QUERIES = {
    "quorum_size": lambda s, d: s.range(1, 10).select(F.col("id").alias("peers"), quorum(F.col("id")).alias("quorum")),
    "quorum_match_index": lambda s, d: quorum_match(matches(replica_log(s, d))),
    "commit_index": lambda s, d: commit_index(matches(replica_log(s, d)), _leader(s, d)),
    "follower_commit": lambda s, d: follower_commit(_appends(s, d)),
    "match_progress": lambda s, d: match_progress(_of("AppendResp")(s, d)),
    "term_rule": lambda s, d: term_rule(_received(s, d)),
    "vote_up_to_date": lambda s, d: _received(s, d).where("type = 'RequestVote'").select("step", up_to_date().alias("up_to_date")),
    "vote_decision": lambda s, d: vote_decision(_received(s, d).where("type = 'RequestVote'")),
    "vote_tally": lambda s, d: vote_tally(_of("RequestVoteResp")(s, d)),
    "election_outcome": lambda s, d: election_outcome(vote_tally(_of("RequestVoteResp")(s, d))),
    "node_status": lambda s, d: node_status(replica_log(s, d)),
}

_ENDS = ", ends AS (SELECT g, node, max(idx) AS last_idx, arg_max(term, idx) AS last_term FROM replica_log GROUP BY g, node)"
_MATCH = _ENDS + f""", mt AS (SELECT r.g, r.node, coalesce(min(CASE WHEN l.term IS DISTINCT FROM r.term THEN r.idx END) - 1, max(r.idx)) AS match_idx
  FROM replica_log r LEFT JOIN replica_log l ON l.g = r.g AND l.idx = r.idx AND l.node = 1 GROUP BY r.g, r.node
), qm AS (SELECT g, match_idx FROM (SELECT *, row_number() OVER (PARTITION BY g ORDER BY match_idx DESC) AS k FROM mt) WHERE k = {QUORUM}
), ci AS (SELECT q.g, q.match_idx, CASE WHEN l.term = e.last_term THEN q.match_idx ELSE 0 END AS commit_idx FROM qm q JOIN ends e ON e.g = q.g AND e.node = 1 LEFT JOIN replica_log l ON l.g = q.g AND l.node = 1 AND l.idx = q.match_idx)"""
_RECEIVED = ", rec AS (SELECT *, 1 + step * 7 // 6500 AS own_term, step * 31 % 97 AS own_last_idx, 1 + step * 3 % 7 AS own_last_term, step % 4 AS own_vote FROM msg_log), upd AS (SELECT *, last_term > own_last_term OR (last_term = own_last_term AND last_idx >= own_last_idx) AS up_to_date FROM rec)"
_TALLY = ", first AS (SELECT g, term, src, arg_min(reject, step) AS reject FROM msg_log WHERE type = 'RequestVoteResp' GROUP BY g, term, src), tally AS (SELECT g, term, count(*) FILTER (WHERE NOT reject) AS granted, count(*) FILTER (WHERE reject) AS rejected FROM first GROUP BY g, term)"

ORACLE_SQL = {
    "quorum_size": "SELECT range AS peers, range // 2 + 1 AS quorum FROM range(1, 10)",
    "quorum_match_index": sql(_MATCH + " SELECT * FROM qm", "replica_log"),
    "commit_index": sql(_MATCH + " SELECT * FROM ci", "replica_log"),
    "follower_commit": sql(_ENDS + """, conf AS (SELECT l.g, min(CASE WHEN f.term IS DISTINCT FROM l.term THEN l.idx END) AS conflict FROM replica_log l LEFT JOIN replica_log f ON f.g = l.g AND f.idx = l.idx AND f.node = 3 WHERE l.node = 1 GROUP BY l.g)
      SELECT c.g, 3 AS node, greatest(last_idx // 2, least(last_idx, coalesce(conflict, last_idx + 1) - 1 + c.g % 4)) AS commit_idx FROM conf c JOIN ends e ON e.g = c.g AND e.node = 1""", "replica_log"),
    "match_progress": sql(" SELECT step, g, src, coalesce(max(CASE WHEN NOT reject THEN match_index END) OVER (PARTITION BY g, src ORDER BY step ROWS UNBOUNDED PRECEDING), 0) AS match_idx FROM msg_log WHERE type = 'AppendResp'", "msg_log"),
    "term_rule": sql(_RECEIVED + """ SELECT step, type, term, own_term, CASE WHEN term > own_term AND type = 'Append' THEN 'follow sender' WHEN term > own_term THEN 'step down'
      WHEN term < own_term AND type IN ('RequestVote', 'Append') THEN 'reject' WHEN term < own_term THEN 'drop' ELSE 'handle' END AS action, greatest(term, own_term) AS new_term FROM rec""", "msg_log"),
    "vote_up_to_date": sql(_RECEIVED + " SELECT step, up_to_date FROM upd WHERE type = 'RequestVote'", "msg_log"),
    "vote_decision": sql(_RECEIVED + """, why AS (SELECT step, CASE WHEN term < own_term THEN 'stale_term' WHEN term = own_term AND own_vote NOT IN (0, src) THEN 'already_voted' WHEN NOT up_to_date THEN 'candidate_log_behind' END AS reason FROM upd WHERE type = 'RequestVote')
      SELECT step, reason IS NULL AS granted, reason FROM why""", "msg_log"),
    "vote_tally": sql(_TALLY + " SELECT * FROM tally", "msg_log"),
    "election_outcome": sql(_TALLY + " SELECT *, CASE WHEN granted >= 2 THEN 'won' WHEN rejected >= 2 THEN 'lost' ELSE 'open' END AS outcome FROM tally", "msg_log"),
    "node_status": sql(_MATCH + " SELECT e.g, e.node, CASE WHEN e.node = 1 THEN 'Leader' ELSE 'Follower' END AS role, e.last_idx, e.last_term, least(commit_idx, e.last_idx) AS commit_idx FROM ends e JOIN ci USING (g)", "replica_log"),
}
