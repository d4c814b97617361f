"""Constraint rules: each turns blocks or documents into error rows; a run is their union.

Error rows are (doc_id, kind, number, code, message).
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from fascicle import schema
from fascicle.functions.markdown import option_entries
from fascicle.operators.quality import has_broken_spacing, has_citation, joined_words

ARABIC = r"[\x{600}-\x{6ff}]"
REQUIRED = {"mcq": ("question", "options", "correct_answer", "explanation"), "written": ("question", "model_answer", "explanation"), "case": ("scenario", "model_answer")}


def _told(rows: DataFrame, rules: list[tuple[Column, str, Column]]) -> DataFrame:
    """All rules on the same rows in one pass."""
    found = F.filter(F.array(*[F.struct(F.coalesce(when, F.lit(False)).alias("hit"), F.lit(code).alias("code"), text.cast("string").alias("message")) for when, code, text in rules]), lambda r: r["hit"])
    out = rows.select("doc_id", "kind", F.col("number").cast("string").alias("number"), F.explode(found).alias("r"))
    return out.select("doc_id", "kind", "number", "r.code", "r.message")


def errors(rows: DataFrame, when: Column, code: str, message: Column | str) -> DataFrame:
    """A rule's error rows. They remember the rule, so that union() can evaluate those of the same rows together."""
    rule = (when, code, F.lit(message) if isinstance(message, str) else message)
    out = _told(rows, [rule])
    out.rules = [(rows, rule)]
    return out


def union(parts: list[DataFrame]) -> DataFrame:
    """The parts' error rows, with one pass over each table that rules are about."""
    rules, others = [], []
    for part in parts:
        if hasattr(part, "rules"):
            rules += part.rules
        else:
            others.append(part)
    tables = {id(rows): rows for rows, _ in rules}
    made = [_told(rows, [r for of, r in rules if id(of) == key]) for key, rows in tables.items()]
    out = reduce(DataFrame.unionByName, [*made, *others])
    if not others:
        out.rules = rules
    return out


def required_fields(blocks: DataFrame) -> DataFrame:
    parts = [errors(blocks, (F.col("kind") == kind) & (F.col(c) == ""), "missing_field", f"missing {c}") for kind, cols in REQUIRED.items() for c in cols]
    return union([*parts, errors(blocks, ~F.col("is_imp") & (F.size("sources") == 0), "missing_source", "missing source")])


def badge_form(badge: Column, as_of_year: int) -> Column:
    """Whether a badge has one of the canonical forms, with reasonable ascending distinct years."""
    years = F.transform(F.regexp_extract_all(badge, F.lit(r"20\d{2}"), F.lit(0)), lambda y: y.cast("int"))
    dated = badge.rlike(r"^\*\*\[Past Exams - 20\d{2}(?:, 20\d{2})*\]\*\*$") | badge.rlike(r"^\*\*\[Past Exams \(20\d{2}(?:, 20\d{2})*\) / IMP\]\*\*$")
    good = (years == F.array_sort(F.array_distinct(years))) & F.forall(years, lambda y: y.between(2000, as_of_year + 1))
    return badge.isin("**[IMP]**", "**[Question Bank]**") | (dated & good)


def badge_rules(blocks: DataFrame, as_of_year: int, verified_years: list[int] | None = None) -> DataFrame:
    bad = F.filter("badges", lambda b: ~badge_form(b, as_of_year))
    out = [errors(blocks, F.size(bad) > 0, "invalid_badge", F.array_join(F.array_sort(F.array_distinct(bad)), ", ")), errors(blocks, F.size("badges") == 0, "missing_badge", "missing badge")]
    if verified_years is not None:
        known = F.array(*[F.lit(y) for y in verified_years]).cast("array<int>")
        out.append(errors(blocks, F.size(F.array_except("badge_years", known)) > 0, "unverified_badge_year", "a badge year has no evidence"))
    return union(out)


def year_rules(blocks: DataFrame, evidence: DataFrame) -> DataFrame:
    """Claimed years against those that the block's sources prove; evidence is (source, years)."""
    proved = blocks.select("doc_id", "kind", "ordinal", F.explode_outer("sources").alias("source")).join(evidence, "source", "left")
    proved = proved.groupBy("doc_id", "kind", "ordinal").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("years")))).alias("proved"), F.count_if(F.col("source").isNotNull() & F.col("years").isNull()).alias("unknown"))
    rows = blocks.join(proved, ["doc_id", "kind", "ordinal"])
    claimed, found = F.col("badge_years"), F.col("proved")
    return union([
        errors(rows, F.size(F.array_except(claimed, found)) > 0, "source_year_mismatch", F.concat(F.lit("claimed "), claimed.cast("string"), F.lit(", proved "), found.cast("string"))),
        errors(rows, (F.size(claimed) > 0) & (F.size(F.array_except(found, claimed)) > 0), "missing_supported_year", F.concat(F.lit("proved "), found.cast("string"))),
        errors(rows, F.col("unknown") > 0, "unknown_source", "a source is not in the catalog"),
    ])


def option_rules(blocks: DataFrame, count: int = 4) -> DataFrame:
    """MCQ options in order, and a correct answer that is one of them."""
    rows = blocks.where("kind = 'mcq'").withColumn("__o", option_entries(F.col("options"))).withColumn("__a", F.try_element_at(option_entries(F.col("correct_answer")), F.lit(1)))
    keys, space = F.transform("__o", lambda o: o["key"]), lambda c: F.lower(F.regexp_replace(c, r"\s+", " "))
    held = F.try_element_at(F.filter("__o", lambda o: o["key"] == F.col("__a.key")), F.lit(-1))["text"]
    given, wanted = space(F.col("__a.text")), space(held)
    expected = F.array(*[F.lit(chr(97 + i)) for i in range(count)])
    return union([
        errors(rows, (F.col("options") != "") & (keys != expected), "option_shape", "options are not separate a, b, c ... entries"),
        errors(rows, (F.col("correct_answer") != "") & F.col("__a").isNull(), "answer_label", "the answer has no option label"),
        errors(rows, F.col("__a").isNotNull() & held.isNull(), "answer_missing_option", "the answer points to no option"),
        errors(rows, (given != "") & (wanted != "") & ~given.startswith(wanted) & ~wanted.startswith(given), "answer_text", "the answer differs from its option"),
    ])


def ocr_rules(blocks: DataFrame, columns: tuple[str, ...] = ("question", "options")) -> DataFrame:
    return union([p for c in columns for p in (
        errors(blocks, has_citation(F.col(c)), "citation_residue", f"{c} holds a citation"),
        errors(blocks, has_broken_spacing(F.col(c)), "broken_ocr", f"{c} has spaced-out letters"),
        errors(blocks, F.size(joined_words(F.col(c))) > 0, "joined_words", f"{c} has joined words"),
    )])


def length_rules(blocks: DataFrame) -> DataFrame:
    """Model answers of at most 2000 characters (cases 2500), and 1000 more for each further part."""
    parts = F.greatest(F.lit(1), F.size(F.regexp_extract_all(F.col("question"), F.lit(r"(?md)^\s*(?:\d+|[a-z])[.)]"), F.lit(0))))
    base = F.when(F.col("kind") == "case", 2500).otherwise(2000)
    return errors(blocks.where("kind IN ('written', 'case')"), F.length("model_answer") > base + 1000 * (parts - 1), "long_answer", "the model answer is too long")


#: Words of a stem that make it a clinical vignette (fixed values), and the longest short, direct stem.
VIGNETTE, DIRECT_WORDS = ("patient", "brought to", "emergency department", "on examination", "scenario"), 20


def style_rules(blocks: DataFrame, profiles: DataFrame) -> DataFrame:
    """IMP questions against their document's observed exam style, (doc_id, profile) of JSON texts.

    The profile's mcq.max_stem_words (a whole number) bounds a stem; a register that says short
    direct forbids stems of over DIRECT_WORDS words and vignettes. A profile without these, or
    one that isn't JSON, asks for nothing.
    """
    v = F.try_parse_json("profile")
    most = F.try_variant_get(v, "$.mcq.max_stem_words", "variant")
    whole = F.when(F.schema_of_variant(most).isin("BIGINT", "INT", "SMALLINT", "TINYINT"), F.try_variant_get(v, "$.mcq.max_stem_words", "long"))
    read = profiles.select("doc_id", whole.alias("__most"), F.lower(F.coalesce(F.try_variant_get(v, "$.mcq.register", "string"), F.lit(""))).alias("__register"))
    rows = blocks.where((F.col("kind") == "mcq") & F.col("is_imp")).join(read, "doc_id")
    rows = rows.withColumn("__words", F.regexp_count("question", F.lit("[A-Za-z0-9]+")))
    direct = F.contains("__register", F.lit("short direct"))
    vignette = F.lower("question").rlike("|".join(VIGNETTE))
    return union([
        errors(rows, F.col("__words") > F.col("__most"), "imp_stem_length", "the stem is longer than the exam's"),
        errors(rows, direct & (F.col("__words") > DIRECT_WORDS), "imp_stem_style", "the stem is too long for short, direct questions"),
        errors(rows, direct & vignette, "imp_vignette", "a clinical vignette, which the exam has none of"),
    ])


def duplicate_rules(blocks: DataFrame) -> DataFrame:
    """Repeats of an earlier block, and one stem with different answers."""
    same = Window.partitionBy("doc_id", "kind", "fingerprint", "is_imp").orderBy("ordinal")
    rows = blocks.withColumn("__first", F.first("number").over(same)).withColumn("__n", F.row_number().over(same))
    stems = blocks.where("stem <> ''").groupBy("doc_id", "kind", "stem").agg(F.count_distinct("fingerprint", "is_imp").alias("n"), F.min("number").alias("number")).where("n > 1")
    return union([errors(rows, F.col("__n") > 1, "duplicate_question", F.concat(F.lit("matches "), F.col("__first"))), errors(stems, F.lit(True), "unsafe_duplicate_merge", "one stem has different answers")])


def review_rules(docs: DataFrame) -> DataFrame:
    rows = docs.withColumns({"kind": F.lit("document"), "number": F.lit("")})
    return union([errors(rows, F.contains("text", F.lit(m)), "review_marker", m) for m in schema.REVIEW_MARKERS])


def document_rules(docs: DataFrame) -> DataFrame:
    """Five sections once and in order; nothing leaked; known callouts with a quoted body."""
    rows = docs.withColumns({"kind": F.lit("document"), "number": F.lit("")})
    found = F.regexp_extract_all("text", F.lit(r"(?md)^(## [^\n]*)"), F.lit(1))
    wanted = F.array(*[F.lit(h) for h in schema.SECTION_HEADINGS])
    names = F.regexp_extract_all("text", F.lit(r"\[!([A-Z]+)\]"), F.lit(1))
    return union([
        errors(rows, F.transform(found, lambda h: F.btrim(h)) != wanted, "section_structure", "sections are not the five in order"),
        errors(rows, has_citation(F.col("text")), "leaked_citation", "a numeric citation"),
        errors(rows, F.col("text").rlike(r"\*\*Source:\*\*"), "leaked_source", "a Source field"),
        errors(rows, F.col("text").rlike(r"[0-9a-f]{8}(?:-[0-9a-f]{4}){3}-[0-9a-f]{12}"), "leaked_uuid", "an identifier"),
        errors(rows, F.col("text").rlike(r"(?i)[\p{L}\p{N}_-]+\.(?:pdf|pptx?|docx|m4a|mp3|wav|mp4)(?:$|[^\p{L}\p{N}])"), "leaked_file_name", "a file name"),
        errors(rows, F.size(F.array_except(names, F.array(*[F.lit(c) for c in schema.CALLOUTS]))) > 0, "callout", "an unknown callout"),
        errors(rows, F.col("text").rlike(r"(?md)^>\s*\[![A-Z]+\][^\n]*\n(?!\s*>)"), "callout_body", "a callout without a quoted body"),
    ])


def section_rules(answers: DataFrame, min_guide: int = 300) -> DataFrame:
    """Rules on whole answers (doc_id, kind, answer): guide length, IMP headings, heading levels."""
    rows = answers.withColumn("number", F.lit(""))
    heads = F.regexp_extract_all("answer", F.lit(r"(?md)^(#{3,6} [^\n]*)"), F.lit(1))
    return union([
        errors(rows, F.col("answer").rlike(r"(?md)^#{1,2} "), "body_heading", "a level-1 or level-2 heading"),
        errors(rows, (F.col("kind") == "guide") & (F.length(F.btrim("answer")) < min_guide), "short_guide", "the guide is too short"),
        errors(rows, (F.col("kind") == "imp") & (F.transform(heads, lambda h: F.btrim(h)) != F.array(*[F.lit(h) for h in schema.IMP_HEADINGS])), "imp_headings", "not the five headings in order"),
        errors(rows, (F.col("kind") == "mcq") & (F.length(F.regexp_replace("answer", rf"(?!{ARABIC}).", "")) < 20) & ~F.btrim("answer").isin(*schema.EMPTY_MARKERS), "too_little_arabic", "under 20 Arabic characters"),
    ])


def validate_blocks(blocks: DataFrame, as_of_year: int, evidence: DataFrame | None = None, options: int = 4) -> DataFrame:
    rules = [required_fields(blocks), badge_rules(blocks, as_of_year), option_rules(blocks, options), ocr_rules(blocks), length_rules(blocks), duplicate_rules(blocks)]
    return union([*rules, year_rules(blocks, evidence)] if evidence is not None else rules)
