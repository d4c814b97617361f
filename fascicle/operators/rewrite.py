"""Text rewriters as column functions: residue, citations, table spacing, size-bound fragments."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from fascicle import schema
from fascicle.operators.quality import CITATION

# What a chat leaves around an answer, without regard to case.
_OFFERS = r"(?:[👁️📊🎧🔍💡📝]|\\*+)?\s*(?:أنا جاهز|تحب نعمل|حابب نجهز|تحب أعمل|Would you like|Do you want|Let me know if|Feel free to ask)[^\n]*$"
RESIDUE = (
    r"^\[AI-GENERATED[^\n]*\]\s*",
    r"^Thoughts\s*$",
    r"Internal request marker: [A-Z]+-[0-9a-f]+[^\n]*",
    r"Studio Panel",
    r"Audio Overview",
    rf"^\s*{_OFFERS}",
    rf"^---\s*\n+\s*{_OFFERS}",
)
OMITTED = "[remaining guidance omitted for query size]"
_LINES = r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x{85}\x{2028}\x{2029}]"


def strip(text: Column) -> Column:
    return F.regexp_replace(text, r"^\s+|\s+$", "")


def table_spacing(text: Column) -> Column:
    """A blank line before each table that follows text; no white space at line ends or around all."""
    lines = F.split(text, _LINES)
    before = F.concat(F.array(F.lit("")), F.slice(lines, 1, F.greatest(F.size(lines) - 1, F.lit(0))))
    opens = lambda prev, line: line.rlike(r"^\s*\|") & prev.rlike(r"^\s*[^\s|]")
    end = lambda line: F.regexp_replace(line, r"\s+$", "")
    # Lines meet their predecessors by zip, so that no lambda splits the text again.
    spaced = F.zip_with(before, lines, lambda prev, line: F.when(opens(prev, line), F.concat(F.lit("\n"), end(line))).otherwise(end(line)))
    return strip(F.array_join(spaced, "\n"))


def cleaned(text: Column) -> Column:
    """Without chat residue and numeric citations; no blank before . : , and ; (in tables too)."""
    for pattern in RESIDUE:
        text = F.regexp_replace(text, f"(?imdU){pattern}", "")
    text = F.regexp_replace(text, CITATION, "")
    for mark in ".:,;":
        text = F.replace(text, F.lit(f" {mark}"), F.lit(mark))
    return table_spacing(text)


def truncated(text: Column, limit: int) -> Column:
    """At most ``limit`` characters, cut at a line's end where there is one, and marked as cut."""
    text = strip(text)
    if limit <= 40:
        return F.substring(text, 1, limit)
    head = F.substring(text, 1, limit - 32)
    whole_lines = F.regexp_replace(F.regexp_extract(head, r"(?s)^(.*)\n", 1), r"\s+$", "")
    kept = F.when(whole_lines != "", whole_lines).otherwise(F.regexp_replace(head, r"\s+$", ""))
    return F.when(F.length(text) <= limit, text).otherwise(F.concat(kept, F.lit(f"\n{OMITTED}")))


def compact_context(text: Column, limit: int = 900) -> Column:
    """A long context's lines that identify sources, each once; the context itself if none does."""
    lines = F.filter(F.split(strip(text), "\n"), lambda x: F.lower(x).rlike(r"verified past-exam|question-bank|canonical:") | x.rlike(r"^\s*-\s*20\d{2}:"))
    useful = F.array_join(F.array_distinct(F.transform(lines, lambda x: strip(x))), "\n")
    return F.when(F.length(strip(text)) <= limit, strip(text)).otherwise(truncated(F.when(useful != "", useful).otherwise(text), limit))


def empty_note(text: Column, message: str) -> Column:
    """A note in place of an answer that only says there is nothing."""
    return F.when(strip(text).isin(*schema.EMPTY_MARKERS), F.lit(f"> [!NOTE]\n> {message}")).otherwise(text)
