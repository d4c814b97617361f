"""The retry ladder as a stream: outcomes of requests come in, what to do next goes out when it is due.

An outcome without errors is done. Rejected sources and an answer with errors stop at once, as
repeating can't mend them. A request whose wording a provider refused is asked once more right
away in compact form. Any other failure is asked again after ``step`` seconds times the attempt,
by a timer of the key's state, until ``most`` attempts are made.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

# The phases with a compact form, where their bodies begin, and what tells a refused wording.
ASSESSED = ("mcqs", "written")
BODIES = ("Extract every relevant MCQ", "Extract every matching Essay")
REFUSED = "query request is invalid"
COMPACT = "Use only the selected sources as evidence. Copy canonical source names exactly when provenance is required."

OUTCOMES = "request_id string, phase string, query string, attempt int, error string, quarantined boolean, answer string"
ACTIONS = "request_id string, action string, attempt int, query string, wait double, reason string"
_WAITING = "attempt int, query string, wait double, reason string"


def compact(query: str) -> str:
    """A query's heading and body without what stands between; the query itself where it has no such body."""
    starts = [query.find(b) for b in BODIES if b in query]
    if not starts:
        return query
    return f"{query.splitlines()[0].strip()}\n\n{COMPACT}\n\n{query[starts[0]:]}"


def decide(outcome: dict, compacted: bool, most: int, step: float) -> tuple[str, int, str, float, bool]:
    """(action, attempt, query, wait, compacted) after an outcome."""
    attempt, query, error = int(outcome["attempt"]), outcome["query"] or "", outcome["error"]
    if not error:
        return "done", attempt, query, 0.0, compacted
    if outcome["quarantined"] or outcome["answer"]:
        return "stop", attempt, query, 0.0, compacted
    if attempt >= most:
        return "stop", attempt, query, 0.0, compacted
    if outcome["phase"] in ASSESSED and not compacted and REFUSED in error.casefold() and compact(query) != query:
        return "ask", attempt + 1, compact(query), 0.0, True
    return "wait", attempt + 1, query, step * attempt, compacted


def _row(values: tuple) -> pd.DataFrame:
    return pd.DataFrame([values], columns=[c.split()[0] for c in ACTIONS.split(", ")])


class Ladder(StatefulProcessor):
    """State of a request: the last attempt that was settled, whether its compact form was used, and what waits."""

    def __init__(self, most: int, step: float):
        self.most, self.step = most, step

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.settled = handle.getValueState("settled", "attempt int, compacted boolean, over boolean")
        self.waiting = handle.getValueState("waiting", _WAITING)

    def handleInputRows(self, key, rows, timerValues):
        request = key[0]
        settled, compacted, over = self.settled.get() if self.settled.exists() else (0, False, False)
        outcomes = pd.concat(list(rows)).sort_values("attempt")
        for outcome in outcomes.astype(object).where(outcomes.notna(), None).to_dict("records"):
            if over or outcome["attempt"] <= settled:  # told before
                continue
            settled = int(outcome["attempt"])
            action, attempt, query, wait, compacted = decide(outcome, compacted, self.most, self.step)
            over = action in ("done", "stop")
            if action == "wait":
                self.waiting.update((attempt, query, wait, outcome["error"]))
                self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + int(1000 * wait))
            else:
                yield _row((request, action, attempt, query, wait, outcome["error"]))
        self.settled.update((settled, compacted, over))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        if self.waiting.exists():
            attempt, query, wait, reason = self.waiting.get()
            self.waiting.clear()
            yield _row((key[0], "ask", attempt, query, wait, reason))

    def close(self) -> None:
        pass


def ladder(outcomes: DataFrame, most: int = 3, step: float = 5.0) -> DataFrame:
    """Actions of a stream of outcomes, one row each: ask, done or stop.

    Outcomes of a request that was over, or of an attempt that was told, change nothing. Needs
    the RocksDB state store, which keeps timers.
    """
    rows = outcomes.select(*[c.split()[0] for c in OUTCOMES.split(", ")])
    return rows.groupBy("request_id").transformWithStateInPandas(Ladder(most, step), ACTIONS, "Append", "ProcessingTime")


__all__ = ["ACTIONS", "OUTCOMES", "compact", "decide", "ladder"]
