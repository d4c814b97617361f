"""What blocks a run: sources of its own scope that can't be read, uploaded or told apart.

The inventory is wider than one lecture, so a fault of a source that the run doesn't select
blocks nothing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fascicle import schema
from fascicle.functions.keys import extension, path_key, source_key, source_stem
from fascicle.operators.scope import EXAM_ROLES
from fascicle.operators.validate import union


def _told(rows: DataFrame, when: Column, code: str) -> DataFrame:
    return rows.where(F.coalesce(when, F.lit(False))).select("relative_path", F.lit(code).alias("code"))


def with_scopes(local: DataFrame, requested: DataFrame, references: DataFrame) -> DataFrame:
    """local with selected (its issues matter) and asked (its ambiguity does).

    Exams and banks always count. Else a source is selected if a reference (relative_path) is
    it, or its stem is that of a requested name (name); it is asked for if its key is a
    requested name's, or its stem is such a key, which a name without extension gives.
    """
    names = requested.where(F.coalesce("name", F.lit("")) != "")
    flag = lambda df, key, as_: df.select(key.alias(f"__{as_}")).where(f"__{as_} <> ''").distinct().withColumn(f"__is_{as_}", F.lit(True))
    k, s, p = source_key(F.col("name")), source_stem(F.col("name")), path_key(F.col("relative_path"))
    rows = local.withColumns({"__k": k, "__s": s, "__p": p})
    rows = rows.join(flag(references, path_key(F.col("relative_path")), "ref"), F.col("__p") == F.col("__ref"), "left")
    rows = rows.join(flag(names, source_stem(F.col("name")), "stem"), F.col("__s") == F.col("__stem"), "left")
    keys = flag(names, source_key(F.col("name")), "key")
    rows = rows.join(keys, F.col("__k") == F.col("__key"), "left").join(keys.toDF("__bare", "__is_bare"), F.col("__s") == F.col("__bare"), "left")
    exam, has = F.col("role").isin(*EXAM_ROLES), lambda *c: F.coalesce(*c, F.lit(False))
    return rows.select(*local.columns, (exam | has("__is_ref", "__is_stem")).alias("selected"), (exam | has("__is_key", "__is_bare")).alias("asked"))


def blocking_errors(plan: DataFrame, requested: DataFrame, references: DataFrame) -> DataFrame:
    """(relative_path, code) of a match.deduplication_plan() with ocr_status and planned.

    unreadable: a missing document whose text fails and for which nothing is planned.
    not_uploadable: a selected source of an extension that can't go up, without a ready remote.
    no_remote: use_remote without a ready remote. ambiguous: several remotes for a source asked
    for. Null counts, roles and states count as none.
    """
    rows = with_scopes(plan, requested, references)
    ready = F.coalesce("n_matches", F.lit(0)) > 0
    name = F.coalesce(F.nullif("prepared_name", F.lit("")), "name")
    action = F.coalesce("preparation_action", F.lit(""))
    kept = (F.coalesce("role", F.lit("")) != "ignore") & (action != "ignore")
    return union([
        _told(rows, (F.col("ocr_status") == "fail") & ~F.coalesce("planned", F.lit(False)) & (F.col("decision") == "missing"), "unreadable"),
        _told(rows, kept & ~extension(name).isin(*schema.UPLOAD_EXTENSIONS) & F.col("selected") & ~ready, "not_uploadable"),
        _told(rows, (action == "use_remote") & ~ready, "no_remote"),
        _told(rows, (F.col("decision") == "ambiguous") & F.col("asked"), "ambiguous"),
    ])
