"""Blocks, fields, badges and sources of Markdown answers, as column functions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fascicle.functions.keys import fingerprint, unique_strings

BADGE = r"(?i)\*{0,2}\[(?:IMP|Question Bank|Past Exams[^\]]*|Past year from doctor[^\]]*)\]\*{0,2}"
#: Section kinds and the headings that open their blocks.
KINDS = {"mcq": r"MCQ", "written": r"Question", "case": r"(?:Clinical )?Case"}
_QUOTE = r"(?:[ \t]*>[ \t]*)?"
#: The callout that opens a case, and a case's heading in it.
TIP, TIP_CASE = r"(?md)^[ \t]*>[ \t]*\[!TIP\][ \t]*$", r"\*\*🩺 Clinical Case\s+(\d+):\*\*"


def sections(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, section_no, heading, body): a document cut before each level-2 heading."""
    parts = F.filter(F.split(F.coalesce(F.col(text_col), F.lit("")), r"(?md)^(?=## )"), lambda s: s.startswith("## "))
    out = docs.select(id_col, F.posexplode(parts).alias("at", "part"))
    return out.select(id_col, (F.col("at") + 1).alias("section_no"), F.regexp_extract("part", r"^(## [^\n]*)", 1).alias("heading"), F.btrim(F.regexp_replace("part", r"^## [^\n]*\n?", ""), F.lit(" \n\r\t")).alias("body"))


def blocks(answers: DataFrame, text_col: str = "answer", kind_col: str = "kind") -> DataFrame:
    """answers exploded to ordered blocks: ordinal, number, block.

    A block opens with a level-3 heading of its kind and ends before the next level-3 heading.
    Cases without such a heading are the TIP callouts, each to the next; its number is that of
    its own bold heading.
    """
    pieces = F.split(F.coalesce(F.col(text_col), F.lit("")), rf"(?md)^(?={_QUOTE}### )")
    opens = F.when(F.lit(False), F.lit(None).cast("string"))
    for kind, heading in KINDS.items():
        opens = opens.when(F.col(kind_col) == kind, F.lit(rf"^{_QUOTE}### {heading}\s+\d+"))
    own = F.filter(pieces, lambda p: F.coalesce(F.regexp_like(p, opens), F.lit(False)))
    tips = F.filter(F.slice(F.split(F.coalesce(F.col(text_col), F.lit("")), TIP), 2, 1 << 30), lambda p: p.rlike(r"\S"))
    own = F.when((F.col(kind_col) == "case") & (F.size(own) == 0), tips).otherwise(own)
    out = answers.select("*", F.posexplode(own).alias("__at", "block"))
    number = F.regexp_extract("block", rf"^{_QUOTE}### [^\n]*?(\d+)|{TIP_CASE}", 1)
    number = F.when(number == "", F.regexp_extract("block", TIP_CASE, 1)).otherwise(number)
    return out.withColumn("ordinal", F.col("__at") + 1).withColumn("number", F.when(number == "", "?").otherwise(number)).drop("__at", text_col)


def field(block: Column, *names: str) -> Column:
    """The first non-empty field of these names: from its bold label to the next one."""
    out = []
    for name in names:
        safe = name.replace("(", r"\(").replace(")", r"\)")
        found = F.regexp_extract(block, rf"(?mds)^\s*(?:>\s*)?\*\*{safe}:\*\*\s*(.*?)(?=^\s*(?:>\s*)?\*\*[^*\n]+:\*\*|\z)", 1)
        out.append(F.nullif(F.btrim(found, F.lit(" \n\r\t")), F.lit("")))
    return F.coalesce(*out, F.lit(""))


def question(block: Column) -> Column:
    return field(block, "Question", "Question (verbatim)")


def options(block: Column) -> Column:
    return field(block, "Options", "Options (verbatim)")


def model_answer(block: Column) -> Column:
    return field(block, "Model Answer", "Model Answer (Short)")


def explanation(block: Column) -> Column:
    return field(block, "Clinical Explanation", "Clinical Explanation (Egyptian Arabic)", "Explanation")


def option_entries(text: Column) -> Column:
    """Ordered (key, text) of a. to d. markers, inline or one a line; a repeated key's later text counts."""
    plain = F.regexp_replace(text, r"(?md)^[ \t]*>[ \t]?", "")
    marked = F.split(plain, r"(?<![A-Za-z0-9])(?=(?:[-*]\s*)?(?:\*\*)?[a-dA-D](?:\*\*)?\s*[.)])")
    entries = F.filter(marked, lambda m: m.rlike(r"^(?:[-*]\s*)?(?:\*\*)?[a-dA-D](?:\*\*)?\s*[.)]"))
    key = lambda m: F.lower(F.regexp_extract(m, r"^(?:[-*]\s*)?(?:\*\*)?([a-dA-D])", 1))
    body = lambda m: F.regexp_replace(m, r"^(?:[-*]\s*)?(?:\*\*)?[a-dA-D](?:\*\*)?\s*[.)]\s*(?:\*\*)?", "")
    clean = lambda t: F.btrim(F.regexp_replace(t, r"(?:\s*\*\*|\s*[-*])+\s*$", ""), F.lit(" \n\r\t"))
    made = F.transform(entries, lambda m: F.struct(key(m).alias("key"), clean(body(m)).alias("text")))
    # A key stands where it first did, with its last text.
    last = lambda k: F.element_at(F.filter(made, lambda e: e["key"] == k), -1)
    return F.transform(F.array_distinct(F.transform(made, lambda e: e["key"])), last)


def badges(block: Column) -> Column:
    return F.regexp_extract_all(block, F.lit(BADGE), F.lit(0))


def badge_years(block: Column) -> Column:
    """Distinct sorted years of the past-exam badges."""
    past = F.filter(badges(block), lambda b: b.startswith("**[Past Exams"))
    years = F.flatten(F.transform(past, lambda b: F.regexp_extract_all(b, F.lit(r"20\d{2}"), F.lit(0))))
    return F.array_sort(F.array_distinct(F.transform(years, lambda y: y.cast("int"))))


def sources(block: Column) -> Column:
    """Names on the Source lines, split at commas and "and", without quotes and a last (year)."""
    lines = F.regexp_extract_all(block, F.lit(rf"(?md)^{_QUOTE}\*\*Source:\*\*[ \t]*(.+)$"), F.lit(1))
    names = F.flatten(F.transform(lines, lambda s: F.split(s, r"\s+and\s+|\s*,\s*")))
    quotes = F.lit(" '\"`")
    return unique_strings(F.transform(names, lambda n: F.btrim(F.regexp_replace(F.btrim(n, quotes), r"\s*\(\d{4}\)$", ""), quotes)))


def is_imp(block: Column) -> Column:
    return F.contains(block, F.lit("**[IMP]**"))


def block_fingerprint(block: Column, kind: Column) -> Column:
    """What makes two blocks the same question: an MCQ's options and answer count, a case's scenario."""
    mcq = F.concat_ws("\n", question(block), F.concat(field(block, "Options (verbatim)", "Options"), field(block, "Correct Answer")))
    case = F.concat_ws("\n", field(block, "Scenario"), field(block, "Questions"))
    return fingerprint(F.when(kind == "mcq", mcq).when(kind == "case", case).otherwise(question(block)))


def with_fields(rows: DataFrame) -> DataFrame:
    """blocks() with the fields that merging and validation read."""
    b, k = F.col("block"), F.col("kind")
    return rows.withColumns({
        "question": question(b), "options": options(b), "correct_answer": field(b, "Correct Answer"), "model_answer": model_answer(b), "explanation": explanation(b),
        "scenario": field(b, "Scenario"), "badges": badges(b), "badge_years": badge_years(b), "sources": sources(b), "is_imp": is_imp(b),
        "fingerprint": block_fingerprint(b, k), "stem": fingerprint(question(b)),
    })


def strip_evidence(text: Column) -> Column:
    """Without Source lines and numeric citations."""
    bare = F.regexp_replace(text, rf"(?md)^{_QUOTE}\*\*Source:\*\*[^\n]*\n?", "")
    return F.regexp_replace(bare, r"\s*\[\s*\d+(?:\s*[,،、;\-–—]\s*\d+)*\s*\]", "")
