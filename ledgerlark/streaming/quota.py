"""Quotas of an event stream: the state of quota_states, kept by user between micro-batches."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ledgerlark.operators.quota import FREE_PAGES, FREE_TIER, RESULT, TIERS, local_day

STATE = "seq long, is_known boolean, used long, pages_limit long, last_reset date, plan_id string, has_plan boolean, orders array<string>"
_RESULT = [c.split()[0] for c in RESULT.split(", ")]


def _advance(state: dict, e) -> dict:
    """The result of one event, which changes the state."""
    pays = e.kind == "payment" and e.order_id is not None
    reset = done = None
    added = None
    if e.kind == "check":
        reset = bool(state["is_known"] and e.day > state["last_reset"])
        if not state["is_known"]:
            state.update(is_known=True, used=0, pages_limit=FREE_PAGES, last_reset=e.day)
        elif reset:
            state.update(used=0, last_reset=e.day)
    elif e.kind == "use" and state["is_known"]:
        state["used"] += max(1 if e.n is None else int(e.n), 1)
    elif pays:
        done, added = e.order_id in state["orders"], 0
        if not done:
            added = max(0 if e.pages is None else int(e.pages), 0)
            known = state["is_known"]
            limit = (state["pages_limit"] if known else 0) + added
            state.update(is_known=True, pages_limit=limit, used=min(limit, state["used"]) if known else 0, last_reset=state["last_reset"] if known else e.utc_day)
            state.update(plan_id=e.plan_id, has_plan=True, orders=[*state["orders"], e.order_id])
    plan = state["plan_id"]
    tier = next((t for prefix, t in TIERS if (plan or "").startswith(prefix)), FREE_TIER)
    own = [state["used"], state["pages_limit"], state["last_reset"]] if state["is_known"] else [None] * 3
    return dict(zip(_RESULT, [int(e.user_id), int(e.seq), e.kind, state["is_known"], *own, reset, done, added, *([tier, plan] if state["is_known"] else [None, None])]))


def quota_stream(events: DataFrame) -> DataFrame:
    """RESULT after each event of a stream of quota events (update mode), equal to quota_states over all of them.

    Events of one user must come in the order of seq from batch to batch; within a batch any order does. A seq that isn't above the user's
    last one is a replay and gives no row. A user's state is small: its quota and the ids of its paid orders.
    """

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        names = [c.split()[0] for c in STATE.split(", ")]
        known = dict(zip(names, state.get)) if state.exists else {"seq": None, "is_known": False, "used": 0, "pages_limit": 0, "last_reset": None, "plan_id": None, "has_plan": False, "orders": []}
        known["orders"] = list(known["orders"])
        rows = pd.concat(list(batches)).sort_values("seq", kind="stable").drop_duplicates("seq")
        rows = rows.astype(object).where(rows.notna(), None)
        out = []
        for e in rows.itertuples(index=False):
            if known["seq"] is None or e.seq > known["seq"]:
                out.append(_advance(known, e))
                known["seq"] = int(e.seq)
        state.update(tuple(known[c] for c in names))
        yield pd.DataFrame(out, columns=_RESULT)

    days = events.select(
        "user_id", "seq", "kind", local_day(F.col("at"), F.col("timezone")).alias("day"), F.to_date("at").alias("utc_day"), F.col("n").cast("double").alias("n"), F.col("order_id").cast("string").alias("order_id"), "plan_id",
        F.col("pages").cast("double").alias("pages"),
    )
    return days.groupBy("user_id").applyInPandasWithState(run, RESULT, STATE, "update", GroupStateTimeout.NoTimeout)
