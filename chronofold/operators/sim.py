"""Seeded simulations of a replicated log under faults, many schedules in parallel.

Each schedule is one group of one row (its seed and settings), so schedules
spread over tasks and a task holds one cluster of a few nodes.  A schedule gives
a trace; the checks of ``invariants`` style are aggregations over traces.
"""

from __future__ import annotations

import random
from collections import Counter

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chronofold.cluster import materialise, ship
from chronofold.model import ConsensusSettings
from chronofold.operators.invariants import log_matching

SCHEDULE_SCHEMA = "seed long, nodes int, drop_rate double, dup_rate double, max_delay int, steps int"
TRACE_SCHEMA = "seed long, tick int, node int, kind string, term long, idx long, data string, detail string"


class Member:
    """One node: durable term, vote and log; what else it knows goes with a crash."""

    def __init__(self, settings: ConsensusSettings, term=0, vote=0, log=()):
        self.set, self.term, self.vote, self.log = settings.checked(), term, vote, list(log)
        self.rng = random.Random(settings.seed * 1_000_003 + settings.node)
        self.role, self.leader, self.commit, self.out, self.seen = "Follower", 0, 0, [], []
        self.sent = Counter()  # messages by kind
        self._wait()

    # terms are numbers from 1; the log is a list of (term, data), index 1 first
    def last(self) -> tuple[int, int]:
        return (len(self.log), self.log[-1][0]) if self.log else (0, 0)

    def term_at(self, i: int) -> int | None:
        return 0 if i == 0 else self.log[i - 1][0] if i <= len(self.log) else None

    def _wait(self) -> None:
        self.elapsed, self.patience = 0, self.rng.randrange(self.set.election_tick_min, self.set.election_tick_max)

    def _say(self, kind: str, to: int, **x) -> None:
        self.sent[kind] += 1
        self.out.append({"kind": kind, "src": self.set.node, "dst": to, "term": self.term, **x})

    def _note(self, kind: str, idx: int = 0, data: str = "", detail: str = "") -> None:
        self.seen.append((kind, self.term, idx, data, detail))

    def _follow(self, term: int, leader: int, why: str) -> None:
        if term > self.term:
            self.term, self.vote = term, 0
            self._note("term_advanced", detail=why)
        self.role, self.leader = "Follower", leader
        self._wait()

    def tick(self) -> None:
        self.elapsed += 1
        if self.role == "Leader":
            if self.elapsed >= self.set.heartbeat_ticks:
                self.elapsed = 0
                for p in self.next:
                    self._append_to(p)
        elif self.elapsed >= self.patience:
            self.campaign()

    def campaign(self) -> None:
        why = "timeout" if self.elapsed >= self.patience else "forced"
        self.role, self.leader, self.term, self.vote = "Candidate", 0, self.term + 1, self.set.node
        self.votes = {self.set.node: True}
        self._wait()
        self._note("election_started", detail=why)
        idx, term = self.last()
        for p in self.set.peers:
            if p != self.set.node:
                self._say("RequestVote", p, idx=idx, last_term=term)
        self._count()

    def _count(self) -> None:
        yes = sum(self.votes.values())
        if yes >= self.set.quorum:
            self.role, self.leader, self.elapsed = "Leader", self.set.node, 0
            self.log.append((self.term, ""))  # an entry of the new term lets earlier ones commit
            self.match = {p: 0 for p in self.set.peers if p != self.set.node}
            self.next = {p: len(self.log) for p in self.match}
            self._note("election_won")
            for p in self.next:
                self._append_to(p)
            self._advance()
        elif len(self.votes) - yes >= self.set.quorum:
            self._note("election_lost")
            self._follow(self.term, 0, "quorum_rejected")

    def propose(self, data: str) -> bool:
        if self.role != "Leader":
            return False
        self.log.append((self.term, data))
        for p in self.next:
            self._append_to(p)
        self._advance()
        return True

    def _append_to(self, p: int) -> None:
        start, size, n = self.next[p], 0, 0
        for _, data in self.log[start - 1 : start - 1 + self.set.max_entries]:
            size += len(data) + 16
            if n and size > self.set.max_bytes:
                break
            n += 1
        self._say("Append", p, prev=start - 1, prev_term=self.term_at(start - 1), entries=self.log[start - 1 : start - 1 + n], commit=self.commit)

    def _advance(self) -> None:
        held = sorted([*self.match.values(), len(self.log)], reverse=True)[self.set.quorum - 1]
        if held > self.commit and self.term_at(held) == self.term:
            self._commit(held)
            for p in self.next:
                self._append_to(p)

    def _commit(self, to: int) -> None:
        for i in range(self.commit + 1, to + 1):
            self._note("committed", i, self.log[i - 1][1], str(self.log[i - 1][0]))
        self.commit = to

    def take(self, m: dict) -> None:
        if m["term"] > self.term:
            self._follow(m["term"], m["src"] if m["kind"] == "Append" else 0, "higher_term")
        elif m["term"] < self.term:
            if m["kind"] == "RequestVote":
                self._say("RequestVoteResp", m["src"], reject=True)
            elif m["kind"] == "Append":
                self._say("AppendResp", m["src"], reject=True, hint=0, hint_term=0, match=0)
            return
        getattr(self, "_on_" + m["kind"])(m)

    def _on_RequestVote(self, m: dict) -> None:
        idx, term = self.last()
        grant = self.vote in (0, m["src"]) and (m["last_term"], m["idx"]) >= (term, idx)
        if grant:
            self.vote = m["src"]
            self._wait()
        self._note("vote_granted" if grant else "vote_denied")
        self._say("RequestVoteResp", m["src"], reject=not grant)

    def _on_RequestVoteResp(self, m: dict) -> None:
        if self.role == "Candidate" and m["src"] in self.set.peers:
            self.votes.setdefault(m["src"], not m["reject"])
            self._count()

    def _on_Append(self, m: dict) -> None:
        self._follow(m["term"], m["src"], "leader_append")
        prev, known = m["prev"], self.term_at(m["prev"])
        if known != m["prev_term"]:
            hint, hint_term = (len(self.log) + 1, 0) if known is None else (next(i for i in range(1, prev + 1) if self.term_at(i) == known), known)
            self._note("append_rejected", prev)
            self._say("AppendResp", m["src"], reject=True, hint=hint, hint_term=hint_term, match=0)
            return
        for i, entry in enumerate(m["entries"], prev + 1):
            if self.term_at(i) != entry[0]:
                if i <= len(self.log):
                    self._note("log_truncated", i)
                self.log[i - 1 :] = [entry]
        new = prev + len(m["entries"])
        if (to := min(m["commit"], new)) > self.commit:
            self._commit(to)
        self._say("AppendResp", m["src"], reject=False, hint=0, hint_term=0, match=new)

    def _on_AppendResp(self, m: dict) -> None:
        p = m["src"]
        if self.role != "Leader" or p not in self.next:
            return
        if m["reject"]:
            at = m["hint"]
            if m["hint_term"]:
                at = next((i + 1 for i in range(len(self.log), 0, -1) if self.term_at(i) == m["hint_term"]), at)
            self.next[p] = max(1, min(self.next[p], at))
            self._append_to(p)
        elif m["match"] > self.match[p]:
            self.match[p] = m["match"]
            self.next[p] = m["match"] + 1
            self._advance()


#: Where a node may crash inside a batch, in order.
CRASH_POINTS = ("before_hard_state", "after_hard_state", "after_entries", "before_send", "after_send")


class Disk:
    """What a node has stored."""

    def __init__(self):
        self.term, self.vote, self.log = 0, 0, []

    def store_hard_state(self, m: Member) -> None:
        self.term, self.vote = m.term, m.vote

    def store_entries(self, m: Member) -> None:
        self.log = list(m.log)

    def supports(self, x: dict, voted: dict[int, int]) -> bool:
        """Whether a message claims no more than is stored; ``voted``: votes told before, by term."""
        if x["term"] != self.term:
            return False
        if x["kind"] == "RequestVoteResp" and not x["reject"]:
            return self.vote == x["dst"] == voted.setdefault(x["term"], x["dst"])
        return x["kind"] != "AppendResp" or x["reject"] or x["match"] <= len(self.log)


def simulate(seed: int, nodes: int, drop: float, dup: float, delay: int, steps: int, quiet: int = 300) -> list[tuple]:
    """The trace of one schedule: faults for ``steps`` ticks, then ``quiet`` without any, the last 50 without proposals."""
    rng = random.Random(seed)
    peers = tuple(range(1, nodes + 1))
    new = lambda n, era, **x: Member(ConsensusSettings(node=n, peers=peers, seed=seed * 31 + era), **x)
    members, down, era = {n: new(n, 0) for n in peers}, {}, 0
    durable, voted = {n: Disk() for n in peers}, {n: {} for n in peers}
    faults = random.Random(seed * 7 + 3)
    wires: list[tuple[int, int, dict]] = []
    blocked: set[tuple[int, int]] = set()
    led: dict[int, int] = {}  # the term that a node led when it last stored, 0 for none
    trace, count, given = [], 0, 0

    def settle(n: int, tick: int) -> None:
        """What a node must store is stored before its messages leave; it may crash at each point between."""
        nonlocal count
        m, disk = members[n], durable[n]
        seen, out = m.seen, m.out
        m.seen, m.out = [], []
        batch = bool(seen or out or (m.term, m.vote) != (disk.term, disk.vote))

        def crashes(point: str) -> bool:
            if not batch or tick >= steps or len(down) >= nodes // 2 or faults.random() >= 0.002:
                return False
            down[n] = tick + faults.randrange(5, 40)
            trace.append((seed, tick, n, "crashed", 0, 0, "", point))
            return True

        if crashes("before_hard_state"):
            return
        disk.store_hard_state(m)
        if m.role == "Leader" and led.get(n) == m.term and m.log[: len(disk.log)] != disk.log:
            trace.append((seed, tick, n, "rewritten", m.term, len(disk.log), "", ""))
        led[n] = m.term if m.role == "Leader" else 0
        if crashes("after_hard_state"):
            return
        disk.store_entries(m)
        if crashes("after_entries"):
            return
        trace.extend((seed, tick, n, "unsendable", x["term"], x.get("match", 0), "", x["kind"]) for x in out if not disk.supports(x, voted[n]))
        if crashes("before_send"):
            return
        trace.extend((seed, tick, n, *x) for x in seen if x[0] != "committed")
        for won in (x[1] for x in seen if x[0] == "election_won"):  # what the new leader of that term holds
            trace.extend((seed, tick, n, "held", term, i, data, str(won)) for i, (term, data) in enumerate(m.log, 1))
        for x in out:
            faulty = tick < steps
            for _ in range(2 if faulty and rng.random() < dup else 1):
                if not (faulty and rng.random() < drop):
                    count += 1
                    wires.append((tick + 1 + (rng.randrange(delay + 1) if faulty else 0), count, x))
        if crashes("after_send"):
            return
        trace.extend((seed, tick, n, *x) for x in seen if x[0] == "committed")  # applied last

    for tick in range(steps + quiet):
        if tick < steps:
            if rng.random() < 0.02 and len(down) < nodes // 2:
                n = rng.choice([p for p in peers if p not in down])
                down[n] = tick + rng.randrange(5, 40)
                trace.append((seed, tick, n, "crashed", 0, 0, "", ""))
            if rng.random() < 0.02:
                blocked = {(a, b) for a in peers for b in peers if a != b and rng.random() < 0.3}
            elif rng.random() < 0.05:
                blocked = set()
        else:
            blocked = set()
        for n in [n for n, until in down.items() if tick >= until or tick >= steps]:
            del down[n]
            era += 1
            disk = durable[n]
            led[n] = 0
            members[n] = new(n, era, term=disk.term, vote=disk.vote, log=disk.log)
            trace.append((seed, tick, n, "restarted", disk.term, 0, "", ""))
        due = sorted((w for w in wires if w[0] <= tick), key=lambda w: (w[0], w[1]))
        wires = [w for w in wires if w[0] > tick]
        if tick < steps:
            rng.shuffle(due)
        for _, _, m in due:
            if m["dst"] not in down and (m["src"], m["dst"]) not in blocked:
                members[m["dst"]].take(m)
                settle(m["dst"], tick)
        for n in peers:
            if n not in down:
                members[n].tick()
                if rng.random() < 0.1 and tick < steps + quiet - 50 and members[n].role == "Leader":
                    given += 1
                    members[n].propose(f"c{given}")
                settle(n, tick)
    for n in peers:
        trace.append((seed, steps + quiet, n, "end", members[n].term, members[n].commit, "", members[n].role))
        trace.extend((seed, steps + quiet, n, "final", term, i, data, "") for i, (term, data) in enumerate(members[n].log, 1))
    return trace


def run_schedules(schedules: DataFrame) -> DataFrame:
    ship(schedules.sparkSession)

    def run(frame):
        rows = [x for s in frame.itertuples(index=False) for x in simulate(s.seed, s.nodes, s.drop_rate, s.dup_rate, s.max_delay, s.steps)]
        return pd.DataFrame(rows, columns=["seed", "tick", "node", "kind", "term", "idx", "data", "detail"])

    return schedules.groupBy("seed").applyInPandas(run, TRACE_SCHEMA)


def random_schedules(spark: SparkSession, n: int, first: int = 1) -> DataFrame:
    """``n`` schedules whose settings follow from their seed."""
    part = lambda salt, m: F.pmod(F.xxhash64("seed", F.lit(salt)), F.lit(m))
    rows = spark.range(first, first + n).select(F.col("id").alias("seed"))
    return rows.select(
        "seed", F.when(part(1, 4) == 0, 5).otherwise(3).alias("nodes"), (part(2, 250) / 1000).alias("drop_rate"), (part(3, 200) / 1000).alias("dup_rate"),
        part(4, 4).cast("int").alias("max_delay"), F.lit(250).alias("steps"),
    )


def check_traces(trace: DataFrame) -> DataFrame:
    """One row per schedule: violations of each safety rule, and whether the quiet end brought agreement.

    ``trace`` is read once for each rule: give it as a table.
    """
    won = trace.where("kind = 'election_won'").groupBy("seed", "term").agg((F.min("node") != F.max("node")).alias("bad"))
    leaders = won.groupBy("seed").agg(F.count_if("bad").alias("two_leaders"), F.count("*").alias("terms_won"))
    entry = F.struct("detail", "data")
    applied = trace.where("kind = 'committed'").groupBy("seed", "idx").agg((F.min(entry) != F.max(entry)).alias("bad"))
    agreed = applied.groupBy("seed").agg(F.count_if("bad").alias("disagreements"), F.count("*").alias("committed"))
    unsent = trace.groupBy("seed").agg(F.count_if(F.col("kind") == "unsendable").alias("unsendable"), F.xxhash64(F.sort_array(F.collect_list(F.struct("tick", "node", "kind", "term", "idx", "data", "detail")))).alias("fingerprint"))
    rewrites = trace.groupBy("seed").agg(F.count_if(F.col("kind") == "rewritten").alias("leader_rewrites"))
    # an entry committed in a term is in the log of every leader of a later one
    committed = trace.where("kind = 'committed'").groupBy("seed", "idx").agg(F.min("term").alias("by_term"), F.min("detail").cast("long").alias("entry_term"))
    wins = trace.where("kind = 'election_won'").select("seed", F.col("term").alias("won")).distinct()
    due = committed.join(wins, "seed").where("won > by_term").select("seed", "won", "idx", "entry_term")
    held = trace.where("kind = 'held'").select("seed", F.col("detail").cast("long").alias("won"), "idx", F.col("term").alias("entry_term")).distinct()
    lacking = due.join(held, ["seed", "won", "idx", "entry_term"], "left_anti").groupBy("seed").agg(F.count("*").alias("incomplete_leaders"))
    logs = trace.where("kind = 'final'").select(F.col("seed").alias("g"), "node", "idx", "term", "data")
    unmatched = log_matching(logs).groupBy(F.col("g").alias("seed")).agg(F.sum("violations").alias("unmatched_logs"))
    ends = trace.where("kind = 'end'").groupBy("seed").agg((F.min("idx") == F.max("idx")).alias("converged"))
    found = unsent.join(leaders, "seed", "left").join(agreed, "seed", "left").join(ends, "seed", "left")
    found = found.join(rewrites, "seed", "left").join(lacking, "seed", "left").join(unmatched, "seed", "left")
    return found.fillna(0, ["incomplete_leaders", "unmatched_logs"])


QUERIES = {"sim_schedules": lambda s, d: check_traces(materialise(run_schedules(random_schedules(s, 500)), "traces"))}
ORACLE_SQL: dict = {}
