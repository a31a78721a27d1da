"""Block-composed lifecycles against a plain loop over each incident's moves."""

import random

import pytest

from loomwatch.functions import patterns as P
from loomwatch.operators import lifecycle as L

SCHEMA = "incident string, seq long, to string, at long, disposition string, reason string"


def plain(rows):
    state, steps = {}, []
    for inc, seq, to, at, disp, reason in sorted(rows, key=lambda r: (r[0], r[1])):
        now = state.setdefault(inc, {"state": "new", "ack": None, "res": None, "disposition": None, "reason": None, "at": None, "set": 0, "cleared": 0, "rejected": 0})
        to = P.STATE_ALIASES.get((to or "").strip().lower(), (to or "").strip().lower())
        disp = (disp or "").strip().lower() or None
        disp, reason = P.DISPOSITION_ALIASES.get(disp, disp), (reason or "").strip() or None
        bad = to not in P.INCIDENT_STATES or (disp and (disp not in P.DISPOSITIONS or to != "closed")) or (reason and not disp) or len(reason or "") > P.REASON_CHARS
        steps.append((inc, seq, now["state"], not bad))
        if bad:
            now["rejected"] += 1
            continue
        final = to in P.INCIDENT_TERMINAL
        if to != "new" and now["ack"] is None:
            now["ack"] = at
        now["res"] = (now["res"] if now["res"] is not None else at) if final else None
        if disp:
            now |= {"disposition": disp, "reason": reason, "at": at, "set": now["set"] + 1}
        elif not final and now["disposition"]:
            now |= {"disposition": None, "reason": None, "at": None, "cleared": now["cleared"] + 1}
        now["state"] = to
    return state, steps


@pytest.mark.parametrize("block", [1, 3, 1000])
def test_blocks_compose(spark, block):
    rnd = random.Random(4)
    rows = []
    for seq in range(400):
        to = rnd.choice(["new", "triaged", "Acknowledged", "investigating", "escalated", "resolved", "closed", "closed", "closed", "nowhere", None])
        disp = rnd.choice([None, None, None, "fp", "Confirmed", "benign", "odd", ""])
        rows.append((rnd.choice("aaaab"), seq, to, 1000 + seq, disp, rnd.choice([None, None, "why", "x" * 501])))
    rows.append(("quiet", 5, "nowhere", 7, None, None))
    t = spark.createDataFrame(rows, SCHEMA).repartition(4)
    state, steps = plain(rows)
    got = {r.incident: r for r in L.current(t, block).collect()}
    for k, w in state.items():
        r = got[k]
        assert (r.state, r.acknowledged_at, r.resolved_at, r.disposition, r.disposition_reason, r.disposition_at, r["set"], r.cleared, r.rejected) == tuple(w.values())
    each = L.steps(t, L.ANY, "new", P.INCIDENT_TERMINAL, block).collect()
    assert sorted((r.incident, r.seq, r.from_state, r.accepted) for r in each) == sorted(steps)
    assert L.rejects(t, block).count() == sum(w["rejected"] for w in state.values())
    assert L.history(t, block).count() == sum(w["set"] + w["cleared"] for w in state.values())
    assert L.current(t.filter("false"), block).collect() == []


def test_small_machine_in_blocks(spark):
    rows = [("i", 1, "acknowledged", 10), ("i", 2, "reopened", 11), ("i", 3, "resolved", 12), ("i", 7, "reopened", 13), ("i", 8, "resolved", 14), ("j", 1, "reopened", 9)]
    t = spark.createDataFrame(rows, "incident string, seq long, to string, at long")
    for block in (1, 4, 100):
        got = {r.incident: tuple(r)[1:] for r in L.lifecycle(t, block=block).collect()}
        assert got == {"i": ("resolved", 4, 1, None, 14), "j": ("open", 0, 1, None, None)}


def test_a_block_that_does_the_same_from_every_state_is_one_row(spark, monkeypatch):
    """Where any move is allowed, blocks of one move each leave their tasks once, not once for each state."""
    seen = []
    real = L._groups

    def counted(rows):
        for k, some in real(rows):
            seen.append(len(some))
            yield k, some

    monkeypatch.setattr(L, "_groups", counted)
    rows = [("a", k, to, k, None, None) for k, to in enumerate(["closed", "nowhere", "new", "bogus", "triaged", "closed"])]
    t = spark.createDataFrame(rows, SCHEMA)
    blocks = L.steps(t, L.ANY, "new", P.INCIDENT_TERMINAL, 1)
    assert blocks.count() == 6
    assert [(r.state, r.acknowledged_at, r.resolved_at, r.rejected) for r in L.current(t, 1).collect()] == [("closed", 0, 5, 2)]
    assert L.ANY_ENTRY not in L.ANY and L.ANY_ENTRY not in L.MOVES
