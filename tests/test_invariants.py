"""Forged violations must be seen; simulations must be safe and repeatable."""

from chronofold.operators import consensus, invariants, sim
from chronofold.operators.admission import classify

ENTRY = "g long, node int, idx long, term long, data string"


def log(spark, rows):
    return spark.createDataFrame(rows, ENTRY)


def one(df):
    return df.first().asDict()


def test_forged_disagreement(spark):
    rows = [(1, 1, 1, 1, "a"), (1, 2, 1, 1, "b"), (1, 1, 2, 1, "c"), (1, 2, 2, 1, "c")]
    commits = spark.createDataFrame([(1, 2)], "g long, commit_idx long")
    assert one(invariants.applied_agree(log(spark, rows), commits)) == {"g": 1, "checked": 2, "violations": 1}
    assert one(invariants.log_matching(log(spark, rows)))["violations"] == 2


def test_forged_second_leader(spark):
    rows = spark.createDataFrame([(1, 5, 1), (1, 5, 2), (1, 6, 2)], "g long, term long, src int")
    assert {r["term"]: r["violations"] for r in invariants.election_safety(rows).collect()} == {5: 1, 6: 0}


def test_forged_lost_commit_and_rewrite(spark):
    rows = [(1, 1, 1, 1, "a"), (1, 1, 2, 1, "b"), (1, 2, 1, 1, "a")]
    commits = spark.createDataFrame([(1, 2)], "g long, commit_idx long")
    assert one(invariants.leader_completeness(log(spark, rows), commits, 2))["violations"] == 1
    before, after = log(spark, rows[:2]), log(spark, [(1, 1, 1, 1, "a"), (1, 1, 2, 2, "z")])
    assert one(invariants.append_only(before, after))["violations"] == 1


def test_earlier_terms_are_not_committed_by_count(spark):
    rows = [(1, n, 1, 1, "a") for n in (1, 2)] + [(1, 1, 2, 2, "")]
    r = one(consensus.commit_index(consensus.matches(log(spark, [*rows, (1, 3, 1, 9, "q")])), log(spark, rows).where("node = 1")))
    assert r["match_idx"] == 1 and r["commit_idx"] == 0


def test_admission_table(spark):
    rows = [(1, 1, 2, 1, "k", "v"), (2, 1, 1, 1, "k", "v"), (3, 1, 1, 1, "k", "v"), (4, 1, 1, 1, "k", "w"), (5, 1, 2, 1, "k", "v2"), (6, 1, 1, 1, "k", "v"), (7, 1, 4, 1, "k", "v")]
    attempts = spark.createDataFrame(rows, "pos long, client long, request_seq long, kind int, key string, value string")
    got = [r["decision"] for r in classify(attempts).orderBy("pos").collect()]
    assert got == ["SEQUENCE_GAP", "EXECUTE", "DUPLICATE", "REQUEST_ID_REUSE", "EXECUTE", "DUPLICATE_RESULT_EXPIRED", "SEQUENCE_GAP"]


def test_simulations_are_safe_and_repeatable(spark):
    schedules = sim.random_schedules(spark, 12, first=101)
    first, second = (sorted(sim.check_traces(sim.run_schedules(schedules)).collect(), key=lambda r: r["seed"]) for _ in range(2))
    assert [r["fingerprint"] for r in first] == [r["fingerprint"] for r in second]
    for r in first:
        assert r["unsendable"] == r["two_leaders"] == r["disagreements"] == r["leader_rewrites"] == r["incomplete_leaders"] == r["unmatched_logs"] == 0
        assert r["converged"] and r["committed"] > 0


def test_a_faulty_member_is_caught(spark, monkeypatch):
    # a node that forgets its vote when it crashes can make two leaders in one term
    monkeypatch.setattr(sim.Member, "_on_RequestVote", lambda self, m: self._say("RequestVoteResp", m["src"], reject=False))
    rows = [x for seed in range(1, 30) for x in sim.simulate(seed, 3, 0.1, 0.1, 3, 250, quiet=50)]
    trace = spark.createDataFrame(rows, sim.TRACE_SCHEMA)
    assert sim.check_traces(trace).agg({"two_leaders": "sum", "disagreements": "sum"}).first()[0] > 0


def test_forged_traces_are_caught(spark):
    rows = [
        (1, 5, 1, "committed", 2, 1, "a", "2"), (1, 9, 2, "election_won", 3, 0, "", ""), (1, 9, 2, "held", 3, 1, "b", "3"),
        (2, 5, 1, "committed", 2, 1, "a", "2"), (2, 9, 2, "election_won", 3, 0, "", ""), (2, 9, 2, "held", 2, 1, "a", "3"),
        (1, 50, 1, "final", 1, 1, "a", ""), (1, 50, 2, "final", 1, 1, "z", ""), (2, 50, 1, "final", 1, 1, "a", ""), (2, 50, 2, "final", 1, 1, "a", ""),
    ]
    got = {r["seed"]: (r["incomplete_leaders"], r["unmatched_logs"]) for r in sim.check_traces(spark.createDataFrame(rows, sim.TRACE_SCHEMA)).collect()}
    assert got == {1: (1, 1), 2: (0, 0)}


def test_a_leader_that_rewrites_its_log_is_caught(spark, monkeypatch):
    whole = sim.Member.propose

    def faulty(self, data):
        if self.role == "Leader" and len(self.log) > 3:
            self.log[-1] = (self.term, "forged")
        return whole(self, data)

    monkeypatch.setattr(sim.Member, "propose", faulty)
    rows = [x for seed in range(1, 6) for x in sim.simulate(seed, 3, 0.0, 0.0, 0, 250, quiet=50)]
    assert sim.check_traces(spark.createDataFrame(rows, sim.TRACE_SCHEMA)).agg({"leader_rewrites": "sum"}).first()[0] > 0


def test_blocks_of_sequences_and_steps_change_nothing(spark, monkeypatch):
    from chronofold.operators import fold

    rows = [(i, 1, i, 2 if i % 3 == 0 else 1, f"k{i % 4}", "v") for i in range(1, 200)]
    commands = spark.createDataFrame(rows, "global_seq long, client long, request_seq long, kind int, key string, value string")
    messages = spark.createDataFrame([(i, 1 + i % 2, i // 7) for i in range(300)], "step long, src int, term long")
    durable = spark.createDataFrame([(i, 1 + (i // 30) % 2, i // 9) for i in range(0, 300, 30)], "step long, src int, durable_term long")
    looks = []
    for block in (1 << 20, 8, 1):
        monkeypatch.setattr(fold, "BLOCK_COMMANDS", block)
        monkeypatch.setattr(invariants, "BLOCK_STEPS", block)
        looks.append((sorted(map(str, fold.with_existed(commands).collect())), sorted(map(str, invariants.sendable(messages, durable).collect()))))
    live, want = {}, {}
    for seq, _, _, kind, key, _ in rows:
        want[seq], live[key] = kind == 1 or live.get(key, False), kind == 1
    assert {r["global_seq"]: r["existed"] for r in fold.with_existed(commands).collect()} == want
    assert looks[0] == looks[1] == looks[2]
