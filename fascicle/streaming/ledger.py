"""The batch ledger as a stream: state by key, one output row for each update."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from fascicle import schema

FIELDS = ("agent_id", "run_id", "artifact_path", "reason")
_TEXTS = ", ".join(f"{f} string" for f in FIELDS)
OUT = f"lecture_key string, seq long, status string, attempts int, accepted boolean, {_TEXTS}"
STATE = f"status string, attempts int, {_TEXTS}"


def _step(key, batches, state: GroupState):
    status, attempts, *texts = state.get if state.exists else ("manifest_ready", 0, *[""] * len(FIELDS))
    rows = []
    updates = pd.concat(list(batches)).sort_values("seq")
    for seq, to, *given in zip(*(updates[c] for c in ("seq", "status", *FIELDS))):
        ok = to == status or to in schema.LEDGER_TRANSITIONS[status]
        if ok:
            attempts += to == "running" and status != "running"
            status = to
            texts = [old if new is None or new != new else new for old, new in zip(texts, given)]
        rows.append((key[0], seq, status, attempts, ok, *texts))
    state.update((status, attempts, *texts))
    yield pd.DataFrame(rows, columns=["lecture_key", "seq", "status", "attempts", "accepted", *FIELDS])


def stream(updates: DataFrame) -> DataFrame:
    """One row for each update; fields that the updates lack are null, and nulls overwrite nothing."""
    updates = updates.select("lecture_key", "seq", "status", *[f if f in updates.columns else F.lit(None).cast("string").alias(f) for f in FIELDS])
    return updates.groupBy("lecture_key").applyInPandasWithState(_step, OUT, STATE, "append", GroupStateTimeout.NoTimeout)
