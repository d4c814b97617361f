"""Reconciliation of snapshots: preflight, decision ladder, status rollups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fascicle import schema
from fascicle.functions.keys import extension
from fascicle.operators.match import hash_matches, is_ready, name_pairs


def preflight(current: DataFrame, recorded: DataFrame, key: str = "path", digest: str = "sha256") -> DataFrame:
    """(key, change): new, changed or removed; a recorded row marked ignored isn't removed."""
    a = current.select(F.col(key).alias("k"), F.col(digest).alias("now"), F.lit(True).alias("here"))
    b = recorded.select(F.col(key).alias("k"), F.col(digest).alias("was"), F.col("status") if "status" in recorded.columns else F.lit("").alias("status"), F.lit(True).alias("there"))
    change = F.when(F.col("there").isNull(), "new").when(F.col("here").isNull() & (F.coalesce("status", F.lit("")) != "ignored"), "removed").when(F.col("here") & ~F.col("now").eqNullSafe(F.col("was")), "changed")
    return a.join(b, "k", "full_outer").select(F.col("k").alias(key), change.alias("change")).where("change IS NOT NULL")


def notebook_status(exact: Column, named: Column, hashed: Column, waiting: Column, known: Column, action: Column, approved: Column, extension: Column, execute: bool = False) -> Column:
    """A source's status in one notebook: the first rule that holds.

    Counts of the notebook's sources: exact (ready, name and hash match), named (ready, name
    matches), hashed (of these, with a hash of their own), waiting (name matches, not ready).
    ``known``: whether the source's own hash is. An executed run replaces the one older form of
    a converted source, and uploads what is approved; the client reports failures.
    """
    remote, prepared = action == "use_remote", action.isin("convert", "ocr")
    replaced = prepared & known & (hashed == 1) if execute else F.lit(False)
    return (
        F.when(exact == 1, "unchanged").when(exact > 1, "ambiguous")
        .when(remote & (named == 1), "accepted-remote").when(remote & (named > 1), "ambiguous")
        .when((named > 0) & known & (hashed > 0) & ~replaced, "changed").when((waiting > 0) & ~replaced, "processing")
        .when(~approved, "not-approved").when(~extension.isin(*schema.UPLOAD_EXTENSIONS), "failed").otherwise("uploaded" if execute else "planned-upload")
    )


def notebook_statuses(local: DataFrame, remote: DataFrame, notebooks: DataFrame, execute: bool = False) -> DataFrame:
    """(path, notebook_uuid, status) of every local source in every notebook.

    ``local`` has the columns of match.name_pairs() and approved; ``notebooks`` (notebook_uuid),
    a module's few, are exploded onto the sources.
    """
    pairs = name_pairs(local, remote, ready_only=False).join(remote.select("source_id", "notebook_uuid", is_ready(F.col("status")).alias("ready")).distinct(), "source_id").distinct()
    same = hash_matches(F.col("hashes"), F.col("rhash"))
    met = pairs.groupBy("relative_path", "notebook_uuid").agg(
        F.count_if(F.col("ready") & same).alias("exact"), F.count_if("ready").alias("named"), F.count_if(F.col("ready") & (F.col("rhash") != "")).alias("hashed"), F.count_if(~F.col("ready")).alias("waiting")
    )
    every = F.array_sort(F.collect_set("notebook_uuid"))
    rows = local.join(notebooks.agg(every.alias("__all")), F.lit(True)).withColumn("notebook_uuid", F.explode("__all")).join(met, ["relative_path", "notebook_uuid"], "left").fillna(0, ["exact", "named", "hashed", "waiting"])
    own = F.exists(F.coalesce("hashes", F.array().cast("array<string>")), lambda h: h != "")
    name = F.coalesce(F.nullif("prepared_name", F.lit("")), "name")
    status = notebook_status(*[F.col(c) for c in ("exact", "named", "hashed", "waiting")], own, F.col("preparation_action"), F.col("approved"), extension(name), execute)
    return rows.select(F.col("relative_path").alias("path"), "notebook_uuid", status.alias("status"))


def worst(s: Column) -> Column:
    """The worst of a set of notebook statuses."""
    has = lambda x: F.array_contains(s, x)
    ladder = F.when(has("failed"), "failed").when(has("ambiguous"), "ambiguous").when(has("changed"), "changed").when(has("planned") | has("planned-upload"), "planned")
    return ladder.when(has("uploaded"), "uploaded").when(has("accepted-remote"), "accepted-remote").when((F.size(s) == 1) & has("not-approved"), "not-approved").otherwise("unchanged")


def rollup(statuses: DataFrame, key: str = "path") -> DataFrame:
    """(key, status): the worst of a source's notebook statuses."""
    return statuses.groupBy(key).agg(F.collect_set("status").alias("s")).select(key, worst(F.col("s")).alias("status"))


def report_status(statuses: DataFrame, errors: DataFrame | None = None, execute: bool = False) -> DataFrame:
    """One row: blocked (errors and no sources), partial (errors, or a source that needs a decision), else completed or planned."""
    open_ = F.coalesce(F.bool_or(F.col("status").isin("failed", "ambiguous", "changed")), F.lit(False))
    told = statuses.agg(F.count("*").alias("n"), open_.alias("open"))
    told = told.join(errors.agg(F.count("*").alias("e")), F.lit(True)) if errors is not None else told.withColumn("e", F.lit(0))
    status = F.when((F.col("e") > 0) & (F.col("n") == 0), "blocked").when((F.col("e") > 0) | F.col("open"), "partial").otherwise("completed" if execute else "planned")
    return told.select(status.alias("status"))


def report_counts(rows: DataFrame, column: str = "status") -> DataFrame:
    """(status, n), with a row for all as null."""
    return rows.rollup(column).agg(F.count("*").alias("n"))


def unreviewed(current: DataFrame, decisions: DataFrame, key: str = "path") -> DataFrame:
    return current.join(decisions.select(key).distinct(), key, "left_anti")


def claimed_twice(units: DataFrame) -> DataFrame:
    """Recordings that more than one unit, or one unit twice, lays claim to."""
    return units.select("title", F.explode("recording_sources").alias("recording")).groupBy("recording").agg(F.count("*").alias("claims"), F.array_sort(F.collect_set("title")).alias("titles")).where("claims > 1")


def alias_conflicts(aliases: DataFrame) -> DataFrame:
    return aliases.groupBy("alias_key").agg(F.count_distinct("module_id").alias("n"), F.array_sort(F.collect_set("module_id")).alias("modules")).where("n > 1").drop("n")


def replace_inventory(inventory: DataFrame, refreshed: DataFrame, notebook_uuid: str) -> DataFrame:
    """Other notebooks' rows and the refreshed ones; rows without a notebook are dropped."""
    return inventory.where((F.col("notebook_uuid") != notebook_uuid) & (F.col("notebook_uuid") != "")).unionByName(refreshed)
