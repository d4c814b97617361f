"""Merging of repeated question blocks, renumbering, answers and documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from fascicle import schema
from fascicle.functions.markdown import BADGE


def merged_badges(years: Column, bank: Column, imp: Column, past: Column | None = None) -> Column:
    """Badges of the union: past exams with their years (imp joined in), bank, imp without a past exam."""
    past = F.size(years) > 0 if past is None else past | (F.size(years) > 0)
    text = F.array_join(F.transform(years, lambda y: y.cast("string")), ", ")
    dated = F.when(F.size(years) > 0, F.when(imp, F.concat(F.lit("**[Past Exams ("), text, F.lit(") / IMP]**"))).otherwise(F.concat(F.lit("**[Past Exams - "), text, F.lit("]**"))))
    return F.filter(F.array(dated, F.when(bank, "**[Question Bank]**"), F.when(imp & ~past, "**[IMP]**")), lambda b: b.isNotNull())


def merge_questions(blocks: DataFrame, evidence: DataFrame | None = None) -> DataFrame:
    """One row for each (doc_id, kind, fingerprint, is_imp): first block, all years and sources.

    ``blocks`` has the fields of markdown.with_fields(). ``evidence`` (source, years) adds years
    that a block's sources prove. So do the columns proved and roles of finalize.with_evidence(),
    which also add the bank's badge and keep IMP from a past exam's question. Order is that of
    first appearance; number is 1..n in it.
    """
    rows = blocks.withColumn("bank", F.exists("badges", lambda b: F.contains(b, F.lit("Question Bank")))).withColumn("imp", F.col("is_imp") | F.exists("badges", lambda b: F.contains(b, F.lit("/ IMP]"))))
    if evidence is not None:
        proved = rows.select("doc_id", "kind", "ordinal", F.explode("sources").alias("source")).join(evidence, "source").groupBy("doc_id", "kind", "ordinal").agg(F.flatten(F.collect_list("years")).alias("proved"))
        rows = rows.join(proved, ["doc_id", "kind", "ordinal"], "left").withColumn("badge_years", F.array_union("badge_years", F.coalesce("proved", F.array().cast("array<int>"))))
    elif "proved" in rows.columns:
        rows = rows.withColumn("badge_years", F.array_union("badge_years", "proved")).withColumn("bank", F.col("bank") | F.array_contains("roles", "question_bank"))
    rows = rows.withColumn("past", F.array_contains("roles", "past_exam") if "roles" in rows.columns else F.lit(False))
    grouped = rows.groupBy("doc_id", "kind", "fingerprint", "is_imp").agg(
        F.min("ordinal").alias("first"), F.min_by("block", "ordinal").alias("block"), F.count("*").alias("copies"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("badge_years")))).alias("years"),
        F.array_distinct(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("ordinal", "sources"))), lambda s: s["sources"]))).alias("sources"),
        F.bool_or("bank").alias("bank"), F.bool_or("imp").alias("imp"), F.bool_or("past").alias("past"),
    )
    out = grouped.withColumn("badges", merged_badges(F.col("years"), F.col("bank"), F.col("imp"), F.col("past")))
    return out.withColumn("number", F.row_number().over(Window.partitionBy("doc_id", "kind").orderBy("first"))).drop("bank", "imp", "past")


def rendered(merged: DataFrame) -> DataFrame:
    """merged with its text: the new number and badges in the heading, sources on one line."""
    heading = F.regexp_extract("block", r"^((?:[ \t]*>[ \t]*)?### [^\n]*?)\d+", 1)
    body = F.regexp_replace(F.regexp_replace("block", r"^[^\n]*\n?", ""), r"(?md)^(?:[ \t]*>[ \t]*)?\*\*Source:\*\*[^\n]*\n?", "")
    title = F.concat_ws(" ", F.concat(heading, F.col("number").cast("string")), F.nullif(F.array_join("badges", " "), F.lit("")))
    line = F.when(F.size("sources") > 0, F.concat(F.lit("**Source:** "), F.array_join("sources", ", "), F.lit("\n"))).otherwise("")
    return merged.withColumn("text", F.concat(title, F.lit("\n"), line, F.btrim(F.regexp_replace(body, BADGE, ""), F.lit("\n")), F.lit("\n")))


def merge_answers(answers: DataFrame) -> DataFrame:
    """(doc_id, kind, answer, source_names): non-empty answers in order, names distinct in order."""
    usable = answers.where((F.btrim(F.coalesce("answer", F.lit(""))) != "") & ~F.btrim("answer").isin(*schema.EMPTY_MARKERS))
    ordered = F.array_sort(F.collect_list(F.struct("ordinal", "answer", "source_names")))
    out = usable.groupBy("doc_id", "kind").agg(ordered.alias("a"))
    return out.select("doc_id", "kind", F.array_join(F.transform("a", lambda x: F.btrim(x["answer"])), "\n\n").alias("answer"), F.array_distinct(F.flatten(F.transform("a", lambda x: x["source_names"]))).alias("source_names"))


def renumber_across(blocks: DataFrame) -> DataFrame:
    """blocks with number counted over all parts of a document and kind: (part, ordinal) order."""
    return blocks.withColumn("number", F.row_number().over(Window.partitionBy("doc_id", "kind").orderBy("part", "ordinal")))


def assemble(sections: DataFrame) -> DataFrame:
    """(doc_id, text): sections with their headings, in order."""
    parts = F.array_sort(F.collect_list(F.struct("section_no", "heading", "body")))
    return sections.groupBy("doc_id").agg(F.array_join(F.transform(parts, lambda s: F.concat(s["heading"], F.lit("\n\n"), s["body"])), "\n\n").alias("text"))


def question_scope(sources: DataFrame, size: int = 3) -> DataFrame:
    """(project_id, batch, source_ids): a project's ids in order, ``size`` to a batch."""
    rows = sources.withColumn("batch", F.floor((F.col("ordinal") - 1) / size).cast("int"))
    ids = F.array_sort(F.collect_list(F.struct("ordinal", "source_id")))
    return rows.groupBy("project_id", "batch").agg(F.transform(ids, lambda s: s["source_id"]).alias("source_ids"))
