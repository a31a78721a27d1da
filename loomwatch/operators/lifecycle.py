"""Incident lifecycle: transitions folded in order, in blocks that compose, so that no incident's history is one array or one task.

What a block of transitions does depends on the state in which it is entered, and on nothing else that is not overwritten or kept as it is. So each block
is reduced to a function (entry state -> exit state and effects on stamps and disposition), the functions of an incident's blocks are composed in
order, and each block is then replayed from its own entry. Rows stream through tasks sorted by incident, block and sequence; a task holds one row.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.pandas.types import to_arrow_type

from loomwatch.functions import patterns as P
from loomwatch.functions.prefix import BLOCK

#: A small machine: the moves that each state allows.
MOVES = {"open": ["acknowledged", "resolved"], "acknowledged": ["resolved", "open"], "resolved": ["reopened"], "reopened": ["acknowledged", "resolved"]}
#: Every move between known states.
ANY = {a: list(P.INCIDENT_STATES) for a in P.INCIDENT_STATES}
#: Stands for what a block found at its entry.
KEPT = "="
#: Stands for every entry state, where a block does the same from each of them.
ANY_ENTRY = "*"
#: Effects: state; first move away from the start; entry into a final state; disposition with its reason and time.
ENTRY = "state string, ack long, res long, disposition string, reason string, disposed_at long"
STEP = f"from_state string, accepted boolean, rejected_for string, history string, cleared string, {ENTRY}"


def _prepared(transitions: DataFrame, block: int) -> DataFrame:
    """(incident, blk, seq, to, at, disposition, reason, bad): words brought to one vocabulary, and what is wrong with a row whatever the state."""
    word = lambda c, names: F.coalesce(F.try_element_at(F.create_map(*(F.lit(x) for kv in names.items() for x in kv)), c), c)
    has = lambda c: F.col(c) if c in transitions.columns else F.lit(None).cast("string")
    to = word(F.lower(F.trim(F.coalesce("to", F.lit("")))), P.STATE_ALIASES) if "disposition" in transitions.columns else F.col("to")
    given = F.nullif(word(F.lower(F.trim(has("disposition"))), P.DISPOSITION_ALIASES), F.lit(""))
    reason = F.nullif(F.trim(has("reason")), F.lit(""))
    bad = (
        F.when(given.isNotNull() & ~given.isin(P.DISPOSITIONS), "unknown disposition").when(given.isNotNull() & (to != "closed"), "disposition without closing")
        .when(reason.isNotNull() & given.isNull(), "reason without disposition").when(F.length(reason) > P.REASON_CHARS, "reason too long")
    )
    return transitions.select(
        "incident", F.expr(f"cast(floor(seq / {block}) as long)").alias("blk"), F.col("seq").cast("long").alias("seq"), to.alias("to"), F.col("at").cast("long").alias("at"), given.alias("disposition"), reason.alias("reason"), bad.alias("bad")
    )


def _sorted(rows: DataFrame, *by: str) -> DataFrame:
    return rows.repartition("incident", "blk").sortWithinPartitions("incident", "blk", *by)


def move(now: dict, row: dict, allowed: dict[str, list[str]], final: list[str], start: str) -> tuple[dict, str | None, str | None, str | None]:
    """(after, why it was rejected, history action, disposition that it cleared)."""
    why = "unknown state" if row["to"] not in allowed else row["bad"] or (None if row["to"] in allowed[now["state"]] else "move not allowed")
    if why:
        return now, why, None, None
    after, ends = {**now, "state": row["to"]}, row["to"] in final
    if row["to"] != start and after["ack"] is None:
        after["ack"] = row["at"]
    after["res"] = None if not ends else row["at"] if after["res"] is None else after["res"]
    history = cleared = None
    if row["disposition"] is not None:
        after |= {"disposition": row["disposition"], "reason": row["reason"], "disposed_at": row["at"]}
        history = "set"
    elif not ends and now["disposition"] is not None:
        history, cleared = "cleared", now["disposition"]
        after |= {"disposition": None, "reason": None, "disposed_at": None}
    return after, None, history, cleared


def _runs(batches: Iterator[pa.RecordBatch], key: tuple[str, ...]) -> Iterator[tuple[tuple, Iterator[dict]]]:
    """Rows of one key at a time, streamed."""
    import itertools

    rows = (r for b in batches for r in b.to_pylist())
    return itertools.groupby(rows, key=lambda r: tuple(r[k] for k in key))


def _batches(rows: Iterator[tuple], schema: pa.Schema, size: int = 10_000) -> Iterator[pa.RecordBatch]:
    import itertools

    rows = iter(rows)
    while some := list(itertools.islice(rows, size)):
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*some), schema)], schema=schema)


def steps(transitions: DataFrame, allowed: dict[str, list[str]] = MOVES, start: str = "open", final: list[str] | None = None, block: int = BLOCK) -> DataFrame:
    """Every transition with what became of it: from_state, accepted, rejected_for, history (``set`` or ``cleared`` of the disposition), cleared, and the
    incident after it (state, ack, res, disposition, reason, disposed_at).

    In: incident, seq, to, at (, disposition, reason). Rows of equal seq are taken by target, then time. A rejected row changes nothing. ``final`` states
    stamp ``res`` until a move to another one. With a disposition column the vocabulary is that of incidents: aliases are resolved, and a disposition belongs
    to a move to ``closed``."""
    final = final if final is not None else ["resolved"]
    rows = _prepared(transitions, block)
    kind = rows.schema["incident"].dataType
    fresh = {"state": start, "ack": None, "res": None, "disposition": None, "reason": None, "disposed_at": None}
    states = list(allowed)
    everywhere = {to for to in states if all(to in allowed[s] for s in states)}
    name, arrow = kind.simpleString(), to_arrow_type(kind)
    order = ("seq", "to", "at")

    def reduce_(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out() -> Iterator[tuple]:
            for (incident, blk), some in _runs(batches, ("incident", "blk")):
                # a stamp or disposition that the block finds at its entry is carried as a mark, so that the exit tells what was kept
                now = {s: {**fresh, "state": s, "ack": KEPT, "res": KEPT, "disposition": KEPT} for s in states}
                first_ack, first_res = dict.fromkeys(states), dict.fromkeys(states)
                moved = False  # until then every entry is as it was
                for r in some:
                    if r["bad"] or r["to"] not in allowed:
                        continue
                    if not moved and r["to"] in everywhere:  # from here on the entry makes no difference: one stands for all
                        now = {ANY_ENTRY: now[states[0]]}
                    moved = True
                    for s in now:
                        before = now[s]
                        now[s], why, _, _ = move(before, r, allowed, final, start)
                        if why is None:
                            if first_ack.get(s) is None and r["to"] != start:
                                first_ack[s] = r["at"]
                            if first_res.get(s) is None and r["to"] in final:
                                first_res[s] = r["at"]
                if not moved:
                    now = {ANY_ENTRY: {**now[states[0]], "state": KEPT}}
                for s, x in now.items():
                    said = x["disposition"] != KEPT
                    res = (False, first_res.get(s)) if x["res"] == KEPT else (True, x["res"])
                    yield incident, blk, s, x["state"], first_ack.get(s), *res, said, x["disposition"] if said else None, x["reason"], x["disposed_at"]

        return _batches(out(), of_block)

    of_block = pa.schema([("incident", arrow), ("blk", pa.int64()), ("entry", pa.string()), ("state", pa.string()), ("ack", pa.int64()), ("res_set", pa.bool_()), ("res", pa.int64()),
                          ("d_set", pa.bool_()), ("disposition", pa.string()), ("reason", pa.string()), ("disposed_at", pa.int64())])
    blocks = _sorted(rows, *order).mapInArrow(reduce_, f"incident {name}, blk long, entry string, state string, ack long, res_set boolean, res long, d_set boolean, disposition string, reason string, disposed_at long")

    def compose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out() -> Iterator[tuple]:
            for (incident,), of_incident in _runs(batches, ("incident",)):
                now = dict(fresh)
                for (blk,), some in _groups(of_incident):
                    yield incident, blk, *now.values()
                    f = next(x for x in some if x["entry"] in (now["state"], ANY_ENTRY))
                    ack = f["ack"] if now["ack"] is None else now["ack"]
                    res = f["res"] if f["res_set"] else f["res"] if now["res"] is None else now["res"]
                    said = f if f["d_set"] else now
                    now = {"state": now["state"] if f["state"] == KEPT else f["state"], "ack": ack, "res": res, **{k: said[k] for k in ("disposition", "reason", "disposed_at")}}

        return _batches(out(), of_entry)

    of_entry = pa.schema([("incident", arrow), ("blk", pa.int64()), ("state", pa.string()), ("ack", pa.int64()), ("res", pa.int64()), ("disposition", pa.string()), ("reason", pa.string()), ("disposed_at", pa.int64())])
    entries = blocks.repartition("incident").sortWithinPartitions("incident", "blk").mapInArrow(compose, f"incident {name}, blk long, {ENTRY}")

    def replay(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out() -> Iterator[tuple]:
            for (incident, _), some in _runs(batches, ("incident", "blk")):
                now = None
                for r in some:
                    if now is None:
                        now = {k: r[f"e_{k}"] for k in fresh}
                        continue
                    before = now["state"]
                    now, why, history, cleared = move(now, r, allowed, final, start)
                    yield incident, r["seq"], r["to"], r["at"], before, why is None, why, history, cleared, *now.values()

        return _batches(out(), of_step)

    of_step = pa.schema([("incident", arrow), ("seq", pa.int64()), ("to", pa.string()), ("at", pa.int64()), ("from_state", pa.string()), ("accepted", pa.bool_()), ("rejected_for", pa.string()),
                         ("history", pa.string()), ("cleared", pa.string()), *[(f.name, f.type) for f in of_entry][2:]])
    heads = entries.select("incident", "blk", *(F.col(k).alias(f"e_{k}") for k in fresh), F.lit(0).alias("_row"))
    both = rows.withColumn("_row", F.lit(1)).unionByName(heads, allowMissingColumns=True)
    return _sorted(both, "_row", *order).mapInArrow(replay, f"incident {name}, seq long, to string, at long, {STEP}")


def _groups(rows: Iterator[dict]) -> Iterator[tuple[tuple, list[dict]]]:
    """Lists of rows of one block: one for each entry state, or one for all."""
    import itertools

    for k, some in itertools.groupby(rows, key=lambda r: r["blk"]):
        yield (k,), list(some)


def lifecycle(transitions: DataFrame, allowed: dict[str, list[str]] = MOVES, start: str = "open", block: int = BLOCK) -> DataFrame:
    """Per incident: state, accepted, rejected, acknowledged_at, resolved_at (both cleared when it is reopened)."""
    d = steps(transitions, allowed, start, block=block)
    ok = F.col("accepted")
    last = lambda to: F.max_by(F.struct("to", "at"), F.when(ok & F.col("to").isin(to, "reopened"), F.struct("seq", "to", "at")))
    per = d.groupBy("incident").agg(
        F.max_by("state", F.struct("seq", "to", "at")).alias("state"), F.count_if(ok).alias("accepted"), F.count_if(~ok).alias("rejected"), last("acknowledged").alias("_a"), last("resolved").alias("_r")
    )
    at = lambda c, to: F.when(F.col(f"{c}.to") == to, F.col(f"{c}.at"))
    return per.select("incident", "state", "accepted", "rejected", at("_a", "acknowledged").alias("acknowledged_at"), at("_r", "resolved").alias("resolved_at"))


def current(transitions: DataFrame, block: int = BLOCK) -> DataFrame:
    """Per incident, as an analyst's moves leave it: state, acknowledged_at (the first move away from new), resolved_at (cleared by a move to a state that is
    not final), disposition with reason and time (cleared likewise), and how many dispositions were set and cleared and moves rejected."""
    d = steps(transitions, ANY, "new", P.INCIDENT_TERMINAL, block)
    last = F.max_by(F.struct("state", "ack", "res", "disposition", "reason", "disposed_at"), F.struct("seq", "to", "at")).alias("l")
    per = d.groupBy("incident").agg(last, *(F.count_if(F.col("history") == k).alias(k) for k in ("set", "cleared")), F.count_if(~F.col("accepted")).alias("rejected"))
    names = {"state": "state", "ack": "acknowledged_at", "res": "resolved_at", "disposition": "disposition", "reason": "disposition_reason", "disposed_at": "disposition_at"}
    return per.select("incident", *(F.col(f"l.{a}").alias(b) for a, b in names.items()), "set", "cleared", "rejected")


def rejects(transitions: DataFrame, block: int = BLOCK) -> DataFrame:
    """(incident, seq, to, from_state, rejected_for) of moves that were not made."""
    d = steps(transitions, ANY, "new", P.INCIDENT_TERMINAL, block)
    return d.filter(~F.col("accepted")).select("incident", "seq", "to", "from_state", "rejected_for")


def history(transitions: DataFrame, block: int = BLOCK) -> DataFrame:
    """(incident, seq, action, disposition, reason, at, from_state, to_state): dispositions as they were set and cleared, never rewritten."""
    d = steps(transitions, ANY, "new", P.INCIDENT_TERMINAL, block).filter("history is not null")
    was = F.when(F.col("history") == "set", F.col("disposition")).otherwise(F.col("cleared"))
    return d.select("incident", "seq", F.col("history").alias("action"), was.alias("disposition"), "reason", "at", "from_state", F.col("to").alias("to_state"))
