"""Crashes inside a batch, and messages that claim more than is stored."""

import pytest
from chronofold.operators import sim


def traces(seeds, nodes=5):
    return [x for seed in seeds for x in sim.simulate(seed, nodes, 0.1, 0.1, 3, 250, quiet=50)]


def test_every_crash_point_is_reached_and_safe():
    rows = traces(range(1, 21))
    assert {x[7] for x in rows if x[3] == "crashed"} >= set(sim.CRASH_POINTS)
    assert not [x for x in rows if x[3] == "unsendable"]


@pytest.mark.parametrize(("skipped", "kinds"), [("store_hard_state", {"RequestVote", "RequestVoteResp"}), ("store_entries", {"AppendResp"})])
def test_messages_beyond_the_stored_state_are_seen(monkeypatch, skipped, kinds):
    monkeypatch.setattr(sim.Disk, skipped, lambda self, m: None)
    assert {x[7] for x in traces([1, 2]) if x[3] == "unsendable"} & kinds


def test_a_forgotten_vote_is_seen(monkeypatch):
    disk = sim.Disk()
    disk.term, disk.vote = 2, 3
    grant = {"kind": "RequestVoteResp", "term": 2, "dst": 3, "reject": False}
    told = {}
    assert disk.supports(grant, told) and not disk.supports({**grant, "dst": 4}, told)
    disk.vote = 4
    assert not disk.supports({**grant, "dst": 4}, told)
