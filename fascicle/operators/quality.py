"""Text quality: page metrics, ordered thresholds, OCR signals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fascicle import schema
from fascicle.functions.keys import garbage_ratio

_EDGE, _END = r"(?:^|[^\p{L}\p{N}_])", r"(?:$|[^\p{L}\p{N}_])"
#: Five short words in a row; a count without end would overflow the matcher's stack on long runs.
BROKEN_SPACING = rf"{_EDGE}(?:[A-Za-z]{{1,3}}\s+){{4}}[A-Za-z]{{1,3}}{_END}"
JOINED_WORD = r"(?i)^[a-z]{3,}(?:of|the|and|are|from|with|except)[a-z]{3,}$"
CITATION = r"\[\s*\d+(?:\s*[,،、;\-–—]\s*\d+)*\s*\]"


def alnum_count(text: Column) -> Column:
    return F.length(F.regexp_replace(text, r"[^\p{L}\p{N}]", ""))


def page_metrics(pages: DataFrame) -> DataFrame:
    """(path, ...) of pages (path, page, text, declared_pages): missing pages count as empty."""
    n = alnum_count(F.coalesce("text", F.lit("")))
    out = pages.withColumn("__n", n).groupBy("path").agg(
        F.greatest(F.max("declared_pages"), F.count("*")).alias("page_count"), F.count_if(F.col("__n") >= 20).alias("text_pages"), F.sum("__n").alias("total_characters"),
        F.sum(F.length("text")).alias("__length"), F.sum(F.round(garbage_ratio(F.coalesce("text", F.lit(""))) * F.length("text"))).alias("__garbage"),
    )
    out = out.withColumn("sparse_page_ratio", F.when(F.col("page_count") > 0, (F.col("page_count") - F.col("text_pages")) / F.col("page_count")).otherwise(1.0))
    return out.withColumn("garbage_ratio", F.when(F.col("__length") > 0, F.col("__garbage") / F.col("__length")).otherwise(1.0)).drop("__length", "__garbage")


def pdf_status(chars: Column, garbage: Column, sparse: Column, pages: Column, role: Column) -> Column:
    return (
        F.when(chars < 50, "fail").when(garbage > 0.02, "fail").when((sparse > 0.8) & role.isin("past_exam", "question_bank"), "fail")
        .when((sparse > 0.6) | (chars / F.greatest(pages, F.lit(1)) < 80), "warning").otherwise("pass")
    )


def text_status(chars: Column, garbage: Column) -> Column:
    return F.when(chars < 50, "fail").when(garbage > 0.02, "fail").when(chars < 200, "warning").otherwise("pass")


def needs_ocr(chars: Column, sparse: Column) -> Column:
    return (chars < 50) | (sparse > 0.8)


def has_broken_spacing(text: Column) -> Column:
    return text.rlike(BROKEN_SPACING)


def joined_words(text: Column) -> Column:
    """Words with a function word inside, beyond the fixed list of ordinary ones."""
    words = F.regexp_extract_all(text, F.lit(r"[\p{L}\p{N}_]+"), F.lit(0))
    return F.filter(words, lambda w: w.rlike(JOINED_WORD) & ~F.lower(w).isin(*schema.JOINED_WORD_ALLOWLIST))


def has_citation(text: Column) -> Column:
    return text.rlike(CITATION)
