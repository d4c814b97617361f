"""Phase fingerprints and what a change makes stale."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The columns whose change makes a phase stale (fixed values).
SCOPES = {
    "guide": ("title", "recordings", "slides"), "imp": ("title", "recordings", "slides"),
    "mcqs": ("title", "recordings", "slides", "assessments", "style"), "written": ("title", "recordings", "slides", "assessments", "style"),
    "cases": ("title", "recordings", "slides"),
}


# What a phase's checkpoint is accepted as, and the phases that a manifest bears on.
DONE = ("validated", "repaired")
ASSESSED = ("mcqs", "written", "cases")


def canonical_hash(*columns: Column) -> Column:
    return F.sha2(F.to_json(F.struct(*[c.alias(f"c{i}") for i, c in enumerate(columns)])), 256)


def phase_fingerprints(requests: DataFrame) -> DataFrame:
    """(run_id, phase, fingerprint) of requests with the columns of SCOPES, and their manifest's hash if they have one."""
    kept = ["run_id"] + [c for c in ("manifest",) if c in requests.columns]
    made = F.explode(F.array(*[F.struct(F.lit(p).alias("phase"), canonical_hash(*[F.col(c) for c in cols]).alias("fingerprint")) for p, cols in SCOPES.items()])).alias("p")
    return requests.select(*kept, made).select(*kept, "p.*")


def stale(now: DataFrame, before: DataFrame) -> DataFrame:
    """Phases to run again: no validated or repaired checkpoint has the same fingerprint.

    Where both tables have a manifest's hash, another manifest makes the assessment phases stale too.
    """
    done = before.where(F.col("status").isin(*DONE))
    same = ["run_id", "phase", "fingerprint"]
    if "manifest" not in now.columns or "manifest" not in before.columns:
        return now.join(done, same, "left_anti")
    free = ~F.col("now.phase").isin(*ASSESSED) | F.col("now.manifest").eqNullSafe(F.col("was.manifest"))
    return now.alias("now").join(done.alias("was"), (F.col("now.run_id") == F.col("was.run_id")) & (F.col("now.phase") == F.col("was.phase")) & (F.col("now.fingerprint") == F.col("was.fingerprint")) & free, "left_anti")


def save_phases(checkpoints: DataFrame, results: DataFrame, at: str = "saved") -> DataFrame:
    """(run_id, phase, ...): the last saved row of each phase; a run's other phases stay as they are.

    sources.store.save_phases() keeps such a table on disk and rewrites the touched runs alone.
    """
    rows = checkpoints.unionByName(results, allowMissingColumns=True)
    return latest_of(rows, ["run_id", "phase"], at)


def latest_of(rows: DataFrame, keys: list[str], at: str) -> DataFrame:
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*[c for c in rows.columns if c not in keys]), F.col(at)).alias("__r")).select(*keys, "__r.*")


def recover(checkpoints: DataFrame, answers: DataFrame, errors: DataFrame) -> DataFrame:
    """checkpoints with repaired answers taken in: status repaired where an answer has no error rows.

    ``answers`` is (run_id, phase, path, answer), ``errors`` (run_id, phase, ...). A phase that has
    already passed, a path out of the run's folder or an answer with errors changes nothing but
    ``rejected``, the reason.
    """
    faulty = errors.groupBy("run_id", "phase").agg(F.count("*").alias("__errors"))
    given = answers.select("run_id", "phase", F.col("path").alias("__path"), F.col("answer").alias("__answer"))
    rows = checkpoints.join(given, ["run_id", "phase"], "left").join(faulty, ["run_id", "phase"], "left")
    outside = F.col("__path").rlike(r"(?:^|/)\.\.(?:/|$)") | ~F.startswith("__path", F.concat("run_id", F.lit("/")))
    reason = F.when(F.col("__answer").isNull(), None).when(F.col("status").isin(*DONE), "already accepted").when(outside, "outside the run's folder").when(F.col("__errors") > 0, "not valid")
    taken = F.col("__answer").isNotNull() & reason.isNull()
    out = rows.withColumns({"status": F.when(taken, "repaired").otherwise(F.col("status")), "answer": F.when(taken, F.col("__answer")).otherwise(F.col("answer")), "rejected": reason})
    return out.select(*checkpoints.columns, "rejected")


def latest(runs: DataFrame, key: str = "title", at: str = "modified") -> DataFrame:
    return runs.groupBy(key).agg(F.max_by(F.struct(*[c for c in runs.columns if c != key]), F.struct(at, "run_id")).alias("r")).select(key, "r.*")


def cache_plan(entries: DataFrame, artifacts: DataFrame) -> DataFrame:
    """entries with fingerprint and reuse: an artifact of that fingerprint exists and isn't empty."""
    known = lambda c: F.coalesce(c, F.lit("\0"))
    parts = [F.col(c) for c in ("relative_path", "source_sha256", "action", "target_format", "language")] + [F.array_join(F.col("pages").cast("array<string>"), ",")]
    mark = F.substring(F.sha2(F.concat_ws("\n", *[known(c) for c in parts]), 256), 1, 12)
    have = artifacts.where("size > 0").select("fingerprint").distinct().withColumn("reuse", F.lit(True))
    return entries.withColumn("fingerprint", mark).join(have, "fingerprint", "left").fillna(False, ["reuse"])
