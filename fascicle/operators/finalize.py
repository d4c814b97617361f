"""Blocks in canonical form, merged question sections, and drafts made final.

A draft is cut into sections first, so a section's last block can't swallow the next heading.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fascicle import schema
from fascicle.functions import markdown
from fascicle.operators import merge, provenance, rewrite, validate
from fascicle.operators.quality import CITATION
from fascicle.operators.tables import materialised

# The labels' long forms, by the kinds of blocks that have them.
LONG_LABELS = {"Question": "(verbatim)", "Options": "(verbatim)", "Model Answer": "(Short)", "Clinical Explanation": "(Egyptian Arabic)"}
LABELS_OF = {"mcq": ("Question", "Options", "Clinical Explanation"), "written": ("Question", "Model Answer", "Clinical Explanation"), "case": ("Model Answer", "Clinical Explanation")}
ANCHORS = ("**Correct Answer:**", "**Model Answer:**", "**Model Answer (Short):**")
TIP = "> [!TIP]"
_OPTIONS = r"(?ds)^(.*?\n)\*\*Options:\*\*[ \t]*(.*?)((?:\n\*\*[^*\n]+:\*\*.*)?)$"
_SOURCE = r"(?md)^[ \t]*(?:> )?\*\*Source:\*\*[^\n]*\n?"


def _unquoted(text: Column) -> Column:
    return F.regexp_replace(text, r"(?md)^> ?", "")


def _labelled(text: Column, kind: str) -> Column:
    for label in LABELS_OF[kind]:
        long = LONG_LABELS[label].replace("(", r"\(").replace(")", r"\)")
        text = F.regexp_replace(text, rf"\*\*{label}\s*(?:{long})?:\*\*", f"**{label}:**")
    return text


def _listed(text: Column) -> Column:
    """An MCQ's options one a line."""
    entries = markdown.option_entries(rewrite.strip(F.regexp_extract(text, _OPTIONS, 2)))
    lines = F.array_join(F.transform(entries, lambda e: F.concat(F.lit("- **"), e["key"], F.lit(".** "), e["text"])), "\n")
    head, tail = F.regexp_extract(text, _OPTIONS, 1), F.regexp_replace(F.regexp_extract(text, _OPTIONS, 3), r"^\s+", "")
    return F.when(F.size(entries) > 0, F.concat(head, F.lit("**Options:**\n"), lines, F.lit("\n\n"), tail)).otherwise(text)


def normalized(block: Column, kind: Column) -> Column:
    """A block without quotes and citations, with short labels; options listed; a case's heading in one form."""
    cited = rf"[ \t]*{CITATION}"
    plain = F.regexp_replace(rewrite.strip(_unquoted(block)), cited, "")
    lines = F.filter(F.transform(F.split(block, "\n"), lambda x: rewrite.strip(x)), lambda x: ~x.isin(TIP, "[!TIP]"))
    case = F.regexp_replace(rewrite.strip(F.array_join(F.transform(lines, lambda x: F.regexp_replace(x, "^> ?", "")), "\n")), cited, "")
    case = F.regexp_replace(F.regexp_replace(case, r"(?md)^\*\*🩺 Clinical Case\s+(\d+):\*\*", "### Clinical Case $1"), r"(?md)^### Case\s+(\d+)", "### Clinical Case $1")
    case = F.when(case.rlike("(?md)^### "), case).otherwise(F.concat(F.lit("### Clinical Case 0\n"), case))  # merging numbers it
    out = F.when(kind == "mcq", _listed(_labelled(plain, "mcq"))).when(kind == "written", _labelled(plain, "written")).when(kind == "case", _labelled(case, "case"))
    return rewrite.strip(F.coalesce(out, plain))


def heading_without_badges(line: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(line, r"\s+" + markdown.BADGE.removeprefix("(?i)").join(("(?i:", ")")), ""), r"\s+$", "")


def with_evidence(blocks: DataFrame, catalog: DataFrame) -> DataFrame:
    """blocks with proved (years), roles, and sources by their canonical names where exactly one entry matches."""
    key = ["doc_id", "kind", "ordinal"]
    cited = blocks.select(*key, F.posexplode("sources").alias("at", "source"))
    found = provenance.catalog_matches(cited, catalog).groupBy("source").agg(
        F.when(F.count("*") == 1, F.first("canonical_name")).alias("name"), F.collect_set("role").alias("roles"), F.flatten(F.collect_list("verified_years")).alias("years")
    )
    empty = lambda c, t: F.coalesce(c, F.array().cast(f"array<{t}>"))
    per = cited.join(found, "source", "left").groupBy(*key).agg(
        F.array_sort(F.array_distinct(F.flatten(F.collect_list(empty("years", "int"))))).alias("proved"), F.array_sort(F.array_distinct(F.flatten(F.collect_list(empty("roles", "string"))))).alias("roles"),
        F.array_distinct(F.transform(F.array_sort(F.collect_list(F.struct("at", F.coalesce("name", "source").alias("s")))), lambda x: x["s"])).alias("named"),
    )
    out = blocks.join(per, key, "left").withColumn("sources", F.coalesce("named", "sources")).drop("named")
    return out.withColumns({"proved": empty("proved", "int"), "roles": empty("roles", "string")})


def merged_text(merged: DataFrame) -> DataFrame:
    """merge_questions() with each block's text: new number, badges, and a line a source before the answer."""
    heading = F.regexp_replace(heading_without_badges(F.regexp_extract("block", r"(?md)^(### [^\n]*)", 1)), r"^(### [^\d\n]*)\d+", "$1")
    title = F.concat(heading, F.col("number").cast("string"), F.array_join(F.transform("badges", lambda b: F.concat(F.lit(" "), b)), ""))
    rest = F.regexp_extract("block", r"^### [^\n]*?\d+(?:[ \t]+\*{0,2}\[[^\]\n]*\]\*{0,2})*[ \t]*([^\n]*)", 1)
    body = rewrite.strip(F.regexp_replace(F.regexp_replace("block", r"^[^\n]*\n?", ""), _SOURCE, ""))
    lines = F.array_join(F.transform("sources", lambda s: F.concat(F.lit("**Source:** "), s)), "\n")
    rows = merged.withColumns({"__title": F.when(rest == "", title).otherwise(F.concat_ws(" ", title, rest)), "__body": body, "__lines": lines})
    anchor = F.lit(None).cast("string")
    for a in reversed(ANCHORS):
        anchor = F.when(F.contains("__body", F.lit(a)), F.lit(a)).otherwise(anchor)
    at = F.coalesce(F.call_function("instr", F.col("__body"), anchor), F.lit(0))
    placed = F.when(at > 0, F.concat(F.substr(F.col("__body"), F.lit(1), at - 1), F.col("__lines"), F.lit("\n"), F.substr(F.col("__body"), at))).otherwise(F.concat_ws("\n", "__body", "__lines"))
    text = F.concat(F.col("__title"), F.lit("\n\n"), F.when(F.col("__lines") == "", F.col("__body")).otherwise(placed))
    return rows.withColumn("text", normalized(text, F.col("kind"))).drop("__title", "__body", "__lines")


def question_blocks(answers: DataFrame, catalog: DataFrame | None = None) -> DataFrame:
    """Blocks of answers (doc_id, kind, answer) in canonical form with their fields and evidence."""
    rows = markdown.blocks(answers)
    rows = markdown.with_fields(rows.withColumn("block", normalized(F.col("block"), F.col("kind"))))
    return rows if catalog is None else with_evidence(rows, catalog)


def normalize_answers(answers: DataFrame, catalog: DataFrame | None = None) -> DataFrame:
    """(doc_id, kind, answer): repeated questions merged and numbered anew; answers without blocks stay."""
    merged = merged_text(merge.merge_questions(question_blocks(answers, catalog)))
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("number", "text"))), lambda x: x["text"]), "\n\n")
    made = merged.groupBy("doc_id", "kind").agg(joined.alias("__made"))
    before = lambda opens: F.regexp_extract("answer", rf"(?ds)^(.*?)(?:(?:^|\n)(?:[ \t]*>[ \t]*)?(?:{opens}).*)?$", 1)
    lead = F.when((F.col("kind") == "case") & ~F.col("answer").rlike(rf"(?md)^(?:[ \t]*>[ \t]*)?### {markdown.KINDS['case']}\s+\d+"), before(r"\[!TIP\]")).otherwise(before("### "))
    lead = F.nullif(rewrite.strip(lead), F.lit(""))
    return answers.join(made, ["doc_id", "kind"], "left").withColumn("answer", F.when(F.col("__made").isNull(), F.col("answer")).otherwise(F.concat_ws("\n\n", lead, "__made"))).drop("__made")


def document_header(emoji: Column, title: Column, subject: Column, source_files: Column) -> Column:
    """A document's first lines: its title and the files it draws on."""
    files = F.array_join(F.transform(source_files, lambda n: F.concat(F.lit("`"), n, F.lit("`"))), ", ")
    return F.concat(F.lit("# "), emoji, F.lit(" `"), title, F.lit("` ("), subject, F.lit(")\n"), F.when(F.size(source_files) > 0, F.concat(F.lit("> **Sources:** "), files, F.lit("\n"))).otherwise(""))


def student_text(draft: Column) -> Column:
    """A draft without evidence and residue."""
    return F.concat(rewrite.table_spacing(rewrite.cleaned(markdown.strip_evidence(draft))), F.lit("\n"))


def finalize(drafts: DataFrame, as_of_year: int, catalog: DataFrame | None = None, profiles: DataFrame | None = None) -> DataFrame:
    """(doc_id, text, errors array<struct<kind,number,code,message>>) of drafts (doc_id, text); text is null where there are errors.

    Question sections are merged and numbered, checked by the editorial and (with a catalog)
    provenance rules, stripped of evidence, and checked as a whole document. With ``profiles``
    (doc_id, profile) IMP questions keep to the exam's style.
    """
    kind = F.when(F.contains("heading", F.lit("MCQ")), "mcq").when(F.contains("heading", F.lit("Written")), "written").when(F.contains("heading", F.lit("Case")), "case").otherwise(F.concat(F.lit("section "), F.col("section_no").cast("string")))
    parts = markdown.sections(drafts).withColumn("kind", kind)
    whole = materialised(normalize_answers(parts.select("doc_id", "kind", F.col("body").alias("answer")), catalog), "sections")  # several rules read it
    made = parts.drop("body").join(whole.withColumnRenamed("answer", "body"), ["doc_id", "kind"])
    lead = drafts.select("doc_id", F.regexp_extract(F.coalesce("text", F.lit("")), r"(?ds)^(.*?)(?:(?:^|\n)## .*)?$", 1).alias("lead"))
    reviewed = merge.assemble(made).join(lead, "doc_id", "right").select("doc_id", F.concat_ws("\n\n", F.nullif(rewrite.strip(F.col("lead")), F.lit("")), "text").alias("draft"))
    blocks = markdown.with_fields(markdown.blocks(whole.where(F.col("kind").isin(*markdown.KINDS))))
    rules = [validate.review_rules(reviewed.withColumnRenamed("draft", "text")), validate.option_rules(blocks), validate.ocr_rules(blocks), validate.length_rules(blocks), validate.duplicate_rules(blocks), validate.badge_rules(blocks, as_of_year)]
    if catalog is not None:
        rules.append(provenance.provenance_rules(blocks.where("kind <> 'case'"), catalog))
    if profiles is not None:
        rules.append(validate.style_rules(blocks, profiles))
    final = reviewed.select("doc_id", student_text(F.col("draft")).alias("text"))
    found = validate.union([*rules, validate.document_rules(final)]).groupBy("doc_id").agg(F.array_sort(F.collect_set(F.struct("kind", "number", "code", "message"))).alias("errors"))
    out = final.join(found, "doc_id", "left")
    return out.select("doc_id", F.when(F.col("errors").isNull(), F.col("text")).alias("text"), F.coalesce("errors", F.array().cast(found.schema["errors"].dataType)).alias("errors"))


def case_rules(answers: DataFrame, evidence: list[str], years: dict[int, list[str]], recordings: list[str]) -> DataFrame:
    """Error rows of clinical-case answers (doc_id, answer, source_names).

    ``evidence`` names the exams and banks, ``years`` the exams of a year, ``recordings`` the lecture.
    """
    rows = answers.withColumns({"kind": F.lit("case"), "number": F.lit("")})
    standard = rows.select("doc_id", "kind", "answer", "source_names", F.filter(F.split("answer", r"(?md)^(?=(?:> )?### )"), lambda b: b.rlike(r"^(?:> )?### (?:Clinical )?Case\s+\d+")).alias("b"))
    tips = F.filter(F.transform(F.split("answer", r"> \[!TIP\]"), lambda b: rewrite.strip(b)), lambda b: b != "")
    blocks = F.when(F.size("b") > 0, F.col("b")).when(F.contains("answer", F.lit(TIP)), tips).otherwise(F.array().cast("array<string>"))
    cases = standard.withColumn("b", blocks)
    each = cases.select("doc_id", "kind", "source_names", F.posexplode("b").alias("at", "block")).withColumn("number", (F.col("at") + 1).cast("string"))
    plain = _unquoted(F.col("block"))
    each = each.withColumns({"sources": markdown.sources(F.col("block")), "years": markdown.badge_years(F.col("block")), "questions": markdown.field(plain, "Questions"), "model": markdown.model_answer(plain)})
    sourced, imp = F.contains("block", F.lit("[Past Exams")) | F.contains("block", F.lit("[Question Bank]")), F.contains("block", F.lit("**[IMP]**")) | F.contains("block", F.lit("/ IMP]**"))
    names = lambda xs: F.array(*[F.lit(x) for x in xs]).cast("array<string>")
    proved = F.array_distinct(F.flatten(F.array(*[F.when(any_names_match(F.col("sources"), names(ns)), F.array(F.lit(y))).otherwise(F.array().cast("array<int>")) for y, ns in years.items()]))) if years else F.array().cast("array<int>")
    parts = F.greatest(F.lit(1), F.size(F.regexp_extract_all("questions", F.lit(r"(?md)^\s*(?:\d+|[a-e])[.)]"), F.lit(0))))
    has = lambda *labels: F.col("block").rlike("|".join(rf"\*\*{x}:\*\*".replace("(", r"\(").replace(")", r"\)") for x in labels))
    err = validate.errors
    inside = F.regexp_extract_all("answer", F.lit(r"(?mds)^> \[!TIP\]$(.*?)(?=^[ \t]*---[ \t]*$|\z)"), F.lit(1))
    outside = F.exists(inside, lambda t: t.rlike(r"(?md)^[ \t]*[^>\s]"))
    any_sourced = F.exists("b", lambda x: F.contains(x, F.lit("[Past Exams")) | F.contains(x, F.lit("[Question Bank]")))
    head = cases.withColumn("number", F.lit(""))
    return validate.union([
        err(head, F.size("b") < 2, "too_few_cases", "fewer than two cases"),
        err(each, ~has("Scenario"), "missing_field", "missing scenario"), err(each, ~has("Questions"), "missing_field", "missing questions"), err(each, ~has("Model Answer", "Model Answer (Short)"), "missing_field", "missing model answer"),
        err(each, sourced & ~any_names_match(F.col("sources"), names(evidence)), "missing_source", "a sourced case has no verified source"),
        err(each, F.size(F.array_except("years", proved)) > 0, "source_year_mismatch", "a badge year has no source of that year"),
        err(each, imp & ~any_names_match(F.col("source_names"), names(recordings)), "missing_recording", "an IMP case does not cite the recording"),
        err(head, any_sourced & ~any_names_match(F.col("source_names"), names(evidence)), "missing_citation", "sourced cases cite no exam or bank"),
        err(each, F.length("model") > 2500 + 1000 * (parts - 1), "long_answer", "the model answer is too long"),
        err(rows, F.contains("answer", F.lit(TIP)) & outside, "unquoted_line", "a line outside its quote"),
        err(rows, F.col("answer").rlike(r"(?md)^#{1,2} "), "body_heading", "a level-1 or level-2 heading"),
        err(rows, F.size(F.array_except(F.regexp_extract_all("answer", F.lit(r"\[!([A-Z]+)\]"), F.lit(1)), names(schema.CALLOUTS))) > 0, "callout", "an unknown callout"),
    ])


def any_names_match(names: Column, expected: Column) -> Column:
    """Whether a name and an expected one are alike: equal stems, or one key within the other (an empty key is in all)."""
    from fascicle.functions.keys import source_key_sql, source_stem_sql

    alike = lambda a, b: (source_stem_sql(a) == source_stem_sql(b)) | F.contains(source_key_sql(a), source_key_sql(b)) | F.contains(source_key_sql(b), source_key_sql(a))
    return F.coalesce(F.exists(names, lambda a: F.exists(expected, lambda b: alike(a, b))), F.lit(False))
