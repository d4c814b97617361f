"""Rules on a phase's whole result: what it must cite, hold and not hold."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fascicle import schema
from fascicle.functions import markdown
from fascicle.operators.containment import fuzzy_matches
from fascicle.operators.validate import errors, union

# A guide's callouts, the two that IMP points need, and the combined badge.
GUIDE_CALLOUTS = ("NOTE", "IMPORTANT", "WARNING", "CAUTION")
IMP_CALLOUTS = ("> [!WARNING]", "> [!CAUTION]")
COMBINED = r"\*\*\[Past Exams \(20\d{2}(?:, 20\d{2})*\) / IMP\]\*\*"
QUESTIONS = {"mcq": ("MCQ", "NO_GROUNDED_MCQS"), "written": ("Question", "NO_GROUNDED_WRITTEN_QUESTIONS")}


def _cites(results: DataFrame, names: DataFrame, flag: str) -> DataFrame:
    """results with ``flag``: whether one of their source names is like one of ``names`` (name)."""
    cited = results.select("doc_id", "kind", F.explode("source_names").alias("name")).where("name IS NOT NULL")
    alike = fuzzy_matches(cited.select("name"), names.select("name")).select("name").distinct()
    found = cited.join(alike, "name", "left_semi").select("doc_id", "kind").distinct().withColumn(flag, F.lit(True))
    return results.join(found, ["doc_id", "kind"], "left").withColumn(flag, F.coalesce(flag, F.lit(False)))


def _callouts(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(r"\[!([A-Z]+)\]"), F.lit(1))


def phase_rules(results: DataFrame, recordings: DataFrame, evidence: DataFrame, min_guide: int = 300) -> DataFrame:
    """Error rows of results (doc_id, kind, answer, source_names), one a document and kind.

    recordings and evidence (exams and banks) are (name): a result cites one if a source name is
    like it, as containment.fuzzy_matches() tells. An answer that is its kind's empty marker has
    no faults; a null answer is an empty one. Blocks' own rules are those of validate.
    """
    rows = _cites(_cites(results, recordings, "__recording"), evidence, "__evidence")
    rows = rows.withColumns({"number": F.lit(""), "answer": F.coalesce("answer", F.lit(""))})
    a, kind = F.col("answer"), F.col("kind")
    guide, imp = kind == "guide", kind == "imp"
    told = [
        errors(rows, a.rlike(r"(?md)^#{1,2} ") & ~F.btrim("answer").isin(*schema.EMPTY_MARKERS), "body_heading", "a level-1 or level-2 heading"),
        errors(rows, guide & (F.size(F.array_except(_callouts(a), F.array(*[F.lit(c) for c in GUIDE_CALLOUTS]))) > 0), "callout", "a callout that a guide has none of"),
        errors(rows, ~guide & (F.size(F.array_except(_callouts(a), F.array(*[F.lit(c) for c in schema.CALLOUTS]))) > 0), "callout", "an unknown callout"),
        errors(rows, guide & (F.length("answer") < min_guide), "short_guide", "the guide is too short"),
        errors(rows, guide & ~F.col("__recording"), "missing_recording", "the recording is not cited"),
        *[errors(rows, imp & ~F.contains(a, F.lit(c)), "missing_callout", f"no {c[4:-1].lower()} callout") for c in IMP_CALLOUTS],
        errors(rows, imp & (F.regexp_extract_all(a, F.lit(r"(?md)^(#{3,6} .+)$"), F.lit(1)) != F.array(*[F.lit(h) for h in schema.IMP_HEADINGS])), "imp_headings", "not the five headings in order"),
    ]
    for name, (heading, marker) in QUESTIONS.items():
        own = (kind == name) & (F.btrim("answer") != marker)
        n = F.regexp_count(a, F.lit(rf"(?md)^(?:[ \t]*>[ \t]*)?### {heading}\s+\d+"))
        told += [
            errors(rows, own & (n < 1), "no_blocks", "no question blocks"),
            errors(rows, own & (F.regexp_count(a, F.lit(markdown.BADGE)) < n), "badge_count", "fewer badges than questions"),
            errors(rows, own & ~F.contains(a, F.lit("**[IMP]**")) & ~F.col("__evidence"), "missing_citation", "no exam or bank is cited"),
            errors(rows, own & a.rlike(COMBINED) & ~F.col("__recording"), "missing_recording", "a combined badge without the recording"),
        ]
    return union(told)
