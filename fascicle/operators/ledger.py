"""The batch ledger: a keyed state machine over ordered updates, folded associatively.

What a run of updates does to a key is a map from each of the states to (state, attempts,
rejected, last fields). Such maps compose, so a key's history is cut into slices anywhere, each
slice becomes its map, and maps are composed in a tree: no list or window holds a whole key.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fascicle import schema
from fascicle.operators.tables import materialised

FIELDS = ("agent_id", "run_id", "artifact_path", "reason")
STATES = tuple(schema.LEDGER_TRANSITIONS)
#: Maps of a key that one composition takes.
FAN = 64


def allowed(current: Column, to: Column) -> Column:
    """Whether a step is allowed; staying is."""
    out = F.lit(False)
    for source, targets in schema.LEDGER_TRANSITIONS.items():
        if targets:
            out = out | ((current == source) & to.isin(*targets))
    return (current == to) | out


def _outcome(status: Column, attempts: Column, rejected: Column, fields: list[Column]) -> Column:
    return F.struct(status.alias("status"), attempts.alias("attempts"), rejected.alias("rejected"), *[c.alias(f) for f, c in zip(FIELDS, fields)])


def _unmoved() -> Column:
    """The map of no update: every state stays, no field is given."""
    none = [F.lit(None).cast("string")] * len(FIELDS)
    return F.array(*[_outcome(F.lit(s), F.lit(0).cast("long"), F.lit(0).cast("long"), none) for s in STATES])


def _after(outcomes: Column, update: Column) -> Column:
    """A map followed by one update; an invalid step changes nothing but ``rejected``."""

    def step(o: Column) -> Column:
        ok = F.coalesce(allowed(o["status"], update["status"]), F.lit(False))
        entered = ok & (update["status"] == "running") & (o["status"] != "running")
        return _outcome(
            F.when(ok, update["status"]).otherwise(o["status"]), o["attempts"] + entered.cast("long"), o["rejected"] + (~ok).cast("long"),
            [F.when(ok, F.coalesce(update[f], o[f])).otherwise(o[f]) for f in FIELDS],
        )

    return F.transform(outcomes, step)


def _then(first: Column, second: Column) -> Column:
    """Two maps, one after the other."""

    def step(o: Column) -> Column:
        place = F.array_position(F.array(*[F.lit(s) for s in STATES]), o["status"]).cast("int")
        p = F.element_at(second, place)
        return _outcome(p["status"], o["attempts"] + p["attempts"], o["rejected"] + p["rejected"], [F.coalesce(p[f], o[f]) for f in FIELDS])

    return F.transform(first, step)


def slices(updates: DataFrame, parts: int, key: str = "lecture_key", order: tuple[str, ...] = ("seq",)) -> DataFrame:
    """(key, slice, map) of each key's updates in ``parts`` ranges of (key, order)."""
    dealt = updates.repartitionByRange(parts, key, *order).withColumn("slice", F.spark_partition_id())
    events = F.array_sort(F.collect_list(F.struct(*order, "status", *FIELDS)))
    rows = dealt.groupBy(key, "slice").agg(events.alias("e"))
    return rows.select(key, "slice", F.aggregate("e", _unmoved(), _after).alias("map"))


def composed(maps: DataFrame, parts: int, key: str = "lecture_key", fan: int = FAN) -> DataFrame:
    """(key, map) of maps (key, slice below parts, map): fan slices at a time, up a tree."""
    while True:
        parts = -(-parts // fan)
        ordered = F.array_sort(F.collect_list(F.struct("slice", "map")))
        rows = maps.groupBy(key, F.floor(F.col("slice") / fan).cast("int").alias("slice")).agg(ordered.alias("m"))
        maps = rows.select(key, "slice", F.aggregate("m", _unmoved(), lambda a, m: _then(a, m["map"])).alias("map"))
        if parts <= 1:
            return maps.drop("slice")


def fold(updates: DataFrame, start: str = "manifest_ready", parts: int | None = None, key: str = "lecture_key", order: tuple[str, ...] = ("seq",)) -> DataFrame:
    """One row a key: the state after its updates in order; invalid steps change nothing.

    attempts counts entries into running from another state; null fields overwrite nothing;
    updates of one place in the order follow by status and fields. A null status is an invalid
    step. No updates give no rows. ``parts`` is the number of ranges, by default as many as
    shuffles have.
    """
    parts = parts or int(updates.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    maps = materialised(slices(updates, parts, key, order), "ledger-slices")
    last = F.element_at("map", STATES.index(start) + 1)
    return composed(maps, parts, key).select(key, last.alias("s")).select(key, "s.status", "s.attempts", "s.rejected", *[F.coalesce(f"s.{f}", F.lit("")).alias(f) for f in FIELDS])
