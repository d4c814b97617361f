"""Evidence of question blocks, upload approvals, conflicts and answers' failures, as joins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from fascicle import schema
from fascicle.functions.keys import path_key, source_key, source_stem
from fascicle.operators.containment import fuzzy_matches
from fascicle.operators.match import hash_matches, name_pairs
from fascicle.operators.tables import materialised
from fascicle.operators.validate import errors, union

# What an answer that is an error message holds, and what names a rejected source.
ERROR_SIGNALS = ("request failed", "error parsing response", '"success": false', "timed out", "traceback (most recent call last)")
REJECTED = ("source group was rejected", "source group rejected", "one or more source", "source not found", "source unavailable", "source is not ready")
REJECTED_IF_ALONE = ("invalid source", "source id", "source_ids")


def _any(text: Column, words: tuple[str, ...]) -> Column:
    out = F.lit(False)
    for w in words:
        out = out | F.contains(text, F.lit(w))
    return out


def catalog_matches(names: DataFrame, catalog: DataFrame, column: str = "source") -> DataFrame:
    """(source, canonical_name, role, verified_years) of available entries.

    A source takes the entries whose name or alias has its key; only if there are none, those
    whose name or alias has its stem. An entry that isn't available still counts as found.
    """
    empty = F.array().cast("array<string>")
    alias = F.explode(F.array_union(F.array("canonical_name"), F.coalesce("aliases", empty))).alias("alias")
    chosen = F.col("selected_for_run") if "selected_for_run" in catalog.columns else F.lit(True)
    usable = F.col("content_status").isin("available", "remote_only") & F.coalesce(chosen, F.lit(True))
    entries = catalog.withColumn("usable", usable).select("canonical_name", "role", "verified_years", "usable", alias)
    entries = entries.select("canonical_name", "role", "verified_years", "usable", source_key(F.col("alias")).alias("key"), source_stem(F.col("alias")).alias("stem"))
    asked = names.where(source_key(F.col(column)) != "").select(F.col(column).alias("source")).distinct().select("source", source_key(F.col("source")).alias("key"), source_stem(F.col("source")).alias("stem"))
    found = [asked.select("source", k).join(entries.drop({"key": "stem", "stem": "key"}[k]), k).drop(k).withColumn("rank", F.lit(i)) for i, k in enumerate(("key", "stem"))]
    best = found[0].unionByName(found[1]).withColumn("least", F.min("rank").over(Window.partitionBy("source")))
    return best.where("rank = least AND usable").select("source", "canonical_name", "role", "verified_years").distinct()


def source_evidence(names: DataFrame, catalog: DataFrame, exams: DataFrame, expected: DataFrame, column: str = "source") -> DataFrame:
    """(source, canonical_name, role, verified_years) of each name's evidence.

    Available entries of the catalog prove years and roles. A name without any falls back to
    names alike (see containment.fuzzy_matches): it proves the years of the exams (year, name)
    and stands for the expected names (name), without a role. A name of neither has no row.
    """
    asked = names.select(F.col(column).alias("source")).where("source IS NOT NULL").distinct()
    known = materialised(catalog_matches(asked, catalog), "catalog-evidence")
    rest = materialised(asked.join(known.select("source"), "source", "left_anti").withColumnRenamed("source", "name"), "names-without-entry")
    alike = fuzzy_matches(rest, expected.select("name")).select(F.col("name").alias("source"), F.col("expected").alias("canonical_name"))
    dated = fuzzy_matches(rest, exams.select("name")).join(exams.select(F.coalesce("name", F.lit("")).alias("expected"), "year").distinct(), "expected")
    years = dated.groupBy(F.col("name").alias("source")).agg(F.array_sort(F.collect_set(F.col("year").cast("int"))).alias("verified_years"))
    found = alike.join(years, "source", "full_outer").select("source", "canonical_name", F.lit(None).cast("string").alias("role"), F.coalesce("verified_years", F.array().cast("array<int>")).alias("verified_years"))
    return known.unionByName(found)


def provenance_rules(blocks: DataFrame, catalog: DataFrame, exams: DataFrame | None = None, expected: DataFrame | None = None) -> DataFrame:
    """Badges against what the blocks' sources are in the catalog: error rows.

    ``blocks`` has the fields of markdown.with_fields(). A block without sources proves no year
    and has no role. With ``exams`` and ``expected``, sources that the catalog doesn't hold are
    looked up as source_evidence() does.
    """
    cited = blocks.select(F.explode("sources").alias("source"))
    found = catalog_matches(cited, catalog) if exams is None or expected is None else source_evidence(cited, catalog, exams, expected)
    by_source = found.groupBy("source").agg(F.count("canonical_name").alias("entries"), F.collect_set("role").alias("roles"), F.array_distinct(F.flatten(F.collect_list("verified_years"))).alias("years"))
    key = ["doc_id", "kind", "ordinal"]
    cited = blocks.select(*key, F.explode_outer("sources").alias("source")).join(by_source, "source", "left")
    per_block = cited.groupBy(*key).agg(
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("roles")))).alias("roles"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("years")))).alias("proved"),
        F.array_sort(F.collect_set(F.when(F.col("source").isNotNull() & (F.coalesce("entries", F.lit(0)) == 0), F.col("source")))).alias("unknown"), F.array_sort(F.collect_set(F.when(F.col("entries") > 1, F.col("source")))).alias("unclear"),
    )
    rows = blocks.join(per_block, key)
    has = lambda role: F.array_contains("roles", role)
    badge = lambda word: F.exists("badges", lambda b: F.contains(b, F.lit(word)))
    bank, dated = badge("Question Bank"), F.size("badge_years") > 0
    sourced, imp = bank | badge("Past Exams"), F.col("is_imp") | badge("/ IMP]")
    some, any_source = F.size("roles") > 0, F.size("sources") > 0
    lacks = lambda a, b: F.size(F.array_except(a, b)) > 0
    years = F.concat(F.lit("claimed "), F.col("badge_years").cast("string"), F.lit(", proved "), F.col("proved").cast("string"))
    return union([
        errors(rows, F.size("badges") == 0, "missing_badge", "no provenance badge"),
        errors(rows, has("past_exam") & ~dated, "missing_badge", "a past-exam source needs a year badge"),
        errors(rows, (~imp | sourced) & ~any_source, "missing_source", "a sourced question has no Source field"),
        errors(rows, imp & ~sourced & any_source, "source_role_mismatch", "an IMP-only question has a source"),
        errors(rows, has("question_bank") & ~bank, "source_role_mismatch", "a question-bank source needs its badge"),
        errors(rows, bank & some & ~has("question_bank"), "source_role_mismatch", "the bank badge has no bank source"),
        errors(rows, dated & some & ~has("past_exam"), "source_role_mismatch", "the year badge has no past-exam source"),
        errors(rows, F.size("unknown") > 0, "unknown_source", F.array_join("unknown", ", ")),
        errors(rows, F.size("unclear") > 0, "ambiguous_source", F.array_join("unclear", ", ")),
        errors(rows, lacks("badge_years", "proved"), "source_year_mismatch", years),
        errors(rows, dated & lacks("proved", "badge_years"), "missing_supported_year", years),
    ])


def approved_uploads(approved: DataFrame, missing: DataFrame) -> DataFrame:
    """(name, relative_path, error) for each approved name; a path where exactly one source is meant.

    A name with a slash is a path, any other a source's name. Errors: escapes, repeated,
    not_found, ambiguous; null where the approval holds.
    """
    plain = F.btrim(F.translate("name", "\\", "/"))
    asked = approved.select("name", path_key(plain).alias("key"), source_key(F.col("name")).alias("name_key"), plain.rlike(r"^/|^\.\.$|^\.\./|/\.\./").alias("escapes"))
    once = asked.groupBy("key").agg(F.first("name").alias("name"), F.first("name_key").alias("name_key"), F.bool_or("escapes").alias("escapes"), F.count("*").alias("times"))
    have = missing.select("relative_path", path_key(F.col("relative_path")).alias("k"), source_key(F.col("name")).alias("n"))
    by_path = once.where(F.contains("key", F.lit("/"))).join(have, F.col("key") == F.col("k")).select("key", "relative_path")
    by_name = once.where(~F.contains("key", F.lit("/"))).join(have, F.col("name_key") == F.col("n")).select("key", "relative_path")
    found = by_path.unionByName(by_name).groupBy("key").agg(F.count("*").alias("hits"), F.min("relative_path").alias("path"))
    error = F.when(F.col("escapes"), "escapes").when(F.col("times") > 1, "repeated").when(F.col("hits").isNull(), "not_found").when(F.col("hits") > 1, "ambiguous")
    return once.join(found, "key", "left").withColumn("error", error).select("name", F.when(F.col("error").isNull(), F.col("path")).alias("relative_path"), "error")


def prepared_conflicts(local: DataFrame, remote: DataFrame, notebook_uuid: str) -> DataFrame:
    """(relative_path, source_ids, blocked): ready remotes that hold an older form of a prepared source.

    Only converted and OCRed sources with a known hash have any; more than one blocks the source.
    """
    mine = local.where(F.col("preparation_action").isin("convert", "ocr") & (F.coalesce("prepared_sha256", F.lit("")) != ""))
    there = remote.where(F.coalesce("notebook_uuid", F.lit("")).isin("", notebook_uuid) & (F.coalesce("content_hash", F.lit("")) != ""))
    old = name_pairs(mine, there).where(~hash_matches(F.col("hashes"), F.col("rhash"))).select("relative_path", "source_id").distinct()
    return old.groupBy("relative_path").agg(F.array_sort(F.collect_list("source_id")).alias("source_ids")).withColumn("blocked", F.size("source_ids") > 1)


def answer_rules(answers: DataFrame) -> DataFrame:
    """Answers (doc_id, kind, answer) that are too short, or are an error message."""
    rows, text = answers.withColumn("number", F.lit("")), F.coalesce("answer", F.lit(""))
    short = (F.length(text) < 50) & ~F.btrim(text).isin(*schema.EMPTY_MARKERS)
    return union([errors(rows, short, "short_answer", "the answer is empty or too short"), errors(rows, _any(F.lower(text), ERROR_SIGNALS), "error_payload", "the answer holds an error message")])


def source_rejected(message: Column, source_ids: Column) -> Column:
    """Whether an error message is about the sources: it names one, or says so outright.

    "query request is invalid" alone says nothing of sources; it must name one.
    """
    low = F.lower(message)
    named = F.exists(source_ids, lambda s: F.contains(low, F.lower(s)))
    told = _any(low, REJECTED) | (_any(low, REJECTED_IF_ALONE) & (F.size(source_ids) == 1))
    return named | (~F.contains(low, F.lit("query request is invalid")) & told)
