"""Answers of several notebooks made one: by heading, by number, or one after the other."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fascicle import schema

RESULTS = "doc_id string, kind string, ordinal int, answer string, source_names array<string>, quarantine array<struct<notebook_uuid:string,source_id:string,source_name:string,error:string>>"
NOTHING = "None explicitly stated"  # fixed value: what an empty section says
#: A block's heading, up to its number and after it, and what the two are replaced by.
HEADINGS = {"mcq": (r"### MCQ\s+\d+", "### MCQ ", ""), "written": (r"### Question\s+\d+", "### Question ", ""), "case": (r"### (?:Clinical )?Case\s+\d+", "### Clinical Case ", "")}
TIP_CASE = (r"\*\*🩺 Clinical Case \d+:\*\*", "**🩺 Clinical Case ", ":**")


def strip(text: Column) -> Column:
    return F.regexp_replace(text, r"^\s+|\s+$", "")


def _plain(text: str) -> str:
    return re.sub(r"([\\.+*?^$(){}|\[\]])", r"\\\1", text)


def section(answer: Column, index: int) -> Column:
    """What stands under the index-th fixed heading, up to a line that is a later heading; the last one's ends at an empty line."""
    later = "|".join(map(_plain, schema.IMP_HEADINGS[index + 1 :]))
    return strip(F.regexp_extract(answer, rf"(?dms)^{_plain(schema.IMP_HEADINGS[index])}\s*\n?(.*?)(?=^(?:{later})\s*$|\z)", 1))


def by_heading(answers: Column) -> Column:
    """An array of answers under the fixed headings, each once; as they are where none has a heading."""
    under = lambda index: lambda a: section(a, index)
    found = [F.filter(F.transform(answers, under(i)), lambda s: s != "") for i in range(len(schema.IMP_HEADINGS))]
    parts = [F.concat(F.lit(f"{h}\n"), F.when(F.size(f) > 0, F.array_join(f, "\n\n")).otherwise(NOTHING)) for h, f in zip(schema.IMP_HEADINGS, found)]
    plain = F.array_join(F.filter(F.transform(answers, strip), lambda a: a != ""), "\n\n")
    return F.when(F.size(F.flatten(F.array(*found))) > 0, F.concat_ws("\n\n", *parts)).otherwise(plain)


def numbered(answers: Column, kind: str) -> Column:
    """An array of answers one after the other, their blocks numbered through from 1."""
    forms = [HEADINGS[kind]] + ([TIP_CASE] if kind == "case" else [])
    opens = "|".join(f"^{p}" if p.startswith("#") else p for p, _, _ in forms)
    joined = F.array_join(F.transform(answers, strip), "\n\n")
    pieces = F.split(joined, rf"(?dm)(?={opens})")

    def again(piece: Column, i: Column) -> Column:
        for pattern, before, after in forms:
            made = F.concat(F.lit(before), i.cast("string"), F.lit(after), F.regexp_replace(piece, rf"^{pattern}", ""))
            piece = F.when(piece.rlike(rf"^{pattern}"), made).otherwise(piece)
        return piece

    # What stands before the first heading is no block and takes no number.
    lead = F.size(F.filter(F.slice(pieces, 1, 1), lambda p: ~p.rlike("|".join(f"^{p}" for p, _, _ in forms))))
    return F.array_join(F.transform(pieces, lambda p, i: again(p, i + 1 - lead)), "")


def merge_results(results: DataFrame) -> DataFrame:
    """(doc_id, kind, answer, source_names, quarantine) of a table of RESULTS, by ordinal.

    Blank answers and the markers of empty sections aren't usable; where no answer is, the first
    that isn't blank stands. imp answers merge by heading; mcq, written and case blocks are
    numbered through; others follow one another. Names and rejected sources are those of all
    results: names once in order, and of a source (notebook, id) the last told, at its first
    place. Null texts and arrays are empty.
    """
    empty = F.array().cast("array<string>")
    kept = F.struct("ordinal", F.coalesce("answer", F.lit("")).alias("answer"), F.coalesce("source_names", empty).alias("names"), F.coalesce("quarantine", F.array().cast(results.schema["quarantine"].dataType)).alias("gone"))
    rows = results.groupBy("doc_id", "kind").agg(F.array_sort(F.collect_list(kept)).alias("r"))
    said = F.filter(F.transform("r", lambda r: r["answer"]), lambda a: strip(a) != "")
    rows = rows.withColumn("said", said).withColumn("usable", F.filter("said", lambda a: ~strip(a).isin(*schema.EMPTY_MARKERS)))
    some = F.when(F.col("kind") == "imp", by_heading(F.col("usable")))
    for kind in HEADINGS:
        some = some.when(F.col("kind") == kind, numbered(F.col("usable"), kind))
    some = some.otherwise(F.array_join(F.transform("usable", strip), "\n\n"))
    gone = F.flatten(F.transform("r", lambda r: r["gone"]))
    key = lambda q: F.struct(q["notebook_uuid"], q["source_id"])
    rows = rows.withColumn("gone", gone)
    once = F.array_distinct(F.transform("gone", key))
    last = F.transform(once, lambda k: F.element_at(F.filter("gone", lambda q: key(q).eqNullSafe(k)), -1))
    first = F.coalesce(strip(F.try_element_at("said", F.lit(1))), F.lit(""))
    return rows.select("doc_id", "kind", F.when(F.size("usable") > 0, some).otherwise(first).alias("answer"), F.array_distinct(F.flatten(F.transform("r", lambda r: r["names"]))).alias("source_names"), last.alias("quarantine"))
