"""Keys, stems, years, hashes: scalar column functions.

Spark has no NFKC and no case folding, so values beyond ASCII take an Arrow path. Spark calls a
Python function for every row whatever stands around it, so ASCII values are given to it as
nulls, and a batch of nulls is handed back as it is.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

#: Arabic-Indic and Persian digits, and their ASCII forms.
ARABIC, ASCII_DIGITS = "٠١٢٣٤٥٦٧٨٩۰۱۲۳۴۵۶۷۸۹", "01234567890123456789"
_DIGITS = str.maketrans(ARABIC, ASCII_DIGITS)
_WORD = r"[^\p{L}\p{N}\p{M}_\x{600}-\x{6ff}]+"


def _arrow(plain):
    """A column function from one of strings; null stays null."""

    def udf(batches):
        for values in batches:
            if values.null_count == len(values):
                yield pa.nulls(len(values), pa.string())
            else:
                yield pa.array([None if v is None else plain(v) for v in values.to_pylist()], pa.string())

    udf.__annotations__ = {"batches": Iterator[pa.Array], "return": Iterator[pa.Array]}
    return F.arrow_udf(udf, StringType())


def _folded(value: str) -> str:
    return unicodedata.normalize("NFKC", value).translate(_DIGITS).casefold()


def _folded_text(value: str) -> str:
    return unicodedata.normalize("NFKC", value).strip().casefold()


_fold = _arrow(_folded)
_fold_text = _arrow(_folded_text)


def _by_form(value: Column, ascii: Column, other) -> Column:
    """``ascii`` for ASCII values, else what the Python function makes of the value."""
    plain = value.rlike(r"^\p{ASCII}*\z")
    return F.when(plain, ascii).otherwise(other(F.when(~plain, value)))


def fold(value: Column) -> Column:
    """NFKC, ASCII digits, case folded."""
    return _by_form(value, F.lower(value), _fold)


def basename(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/]*)$", 1)


def extension(path: Column) -> Column:
    """The last extension, lower-cased; a leading dot alone is none."""
    return F.lower(F.regexp_extract(path, r"[^/.][^/]*?(\.[^./]*)$", 1))


def strip_extension(path: Column) -> Column:
    return F.regexp_replace(path, r"(?<=[^/.])([^/]*?)\.[^./]*$", "$1")


def source_key(name: Column) -> Column:
    """A source's comparison key: base name, folded, all but letters and digits one space."""
    spaced = F.translate(fold(basename(F.coalesce(name, F.lit("")))), "_", " ")
    return F.btrim(F.regexp_replace(spaced, _WORD, " "))


def source_stem(name: Column) -> Column:
    return source_key(strip_extension(F.coalesce(name, F.lit(""))))


def source_key_sql(name: Column) -> Column:
    """source_key() without NFKC, for use inside array functions, which take no Python function."""
    plain = F.translate(F.lower(basename(F.coalesce(name, F.lit("")))), ARABIC + "_", ASCII_DIGITS + " ")
    return F.btrim(F.regexp_replace(plain, _WORD, " "))


def source_stem_sql(name: Column) -> Column:
    return source_key_sql(strip_extension(F.coalesce(name, F.lit(""))))


def path_key(path: Column) -> Column:
    slashed = F.translate(fold(F.coalesce(path, F.lit(""))), "\\", "/")
    return F.regexp_replace(F.btrim(slashed, F.lit(" ./")), "/+", "/")


def module_key(name: Column) -> Column:
    return source_key(F.translate(F.coalesce(name, F.lit("")), "-/", "  "))


def exam_years(text: Column, as_of_year: int, first: int = 2000) -> Column:
    """Standalone years 20xx up to as_of_year + 1, sorted and distinct."""
    plain = F.translate(F.coalesce(text, F.lit("")), ARABIC, ASCII_DIGITS)
    found = F.transform(F.regexp_extract_all(plain, F.lit(r"(?<!\d)(20\d{2})(?!\d)"), F.lit(1)), lambda y: y.cast("int"))
    return F.array_sort(F.array_distinct(F.filter(found, lambda y: y.between(first, as_of_year + 1))))


def filename_years(name: Column, as_of_year: int) -> Column:
    """exam_years() and standalone two-digit years 2x."""
    plain = F.translate(F.coalesce(name, F.lit("")), ARABIC, ASCII_DIGITS)
    short = F.transform(F.regexp_extract_all(plain, F.lit(r"(?<!\d)(2\d)(?!\d)"), F.lit(1)), lambda y: y.cast("int") + 2000)
    return F.array_sort(F.array_union(exam_years(name, as_of_year), F.filter(short, lambda y: y <= as_of_year + 1)))


#: The last page that a selection may name; a part beyond it is an error, as no document has it.
LAST_PAGE = 100_000


def page_numbers(spec: Column) -> Column:
    """Pages of comma-separated numbers and ranges a-b or a:b up to LAST_PAGE, sorted and distinct; page_errors() tells the other parts."""
    ends = lambda p, i: F.element_at(F.split(p, "[-:]"), i).cast("int")
    ranges = F.transform(F.filter(_page_parts(spec), _is_page_part), lambda p: F.sequence(ends(p, 1), ends(p, -1)))
    return F.array_sort(F.array_distinct(F.flatten(ranges)))


def _page_parts(spec: Column) -> Column:
    return F.transform(F.split(spec, ","), lambda p: F.regexp_replace(p, r"\s+", ""))


def _is_page_part(part: Column) -> Column:
    """Whether a part is a page from 1 to LAST_PAGE, or a range of such that doesn't end before it starts."""
    end = lambda i: F.try_element_at(F.split(part, "[-:]"), F.lit(i)).try_cast("int")
    return part.rlike(r"^\d{1,9}(?:[-:]\d{1,9})?$") & F.coalesce((end(1) >= 1) & (end(-1) >= end(1)) & (end(-1) <= LAST_PAGE), F.lit(False))


def page_errors(spec: Column) -> Column:
    """The parts of a page selection that name no pages."""
    return F.filter(_page_parts(spec), lambda p: ~_is_page_part(p))


def slug(value: Column) -> Column:
    """A file name's form of a title: letters, digits, _ and - stay, in lower case."""
    return F.lower(F.btrim(F.regexp_replace(value, "[^A-Za-z0-9_-]+", "-"), F.lit("-")))


def cache_stem(value: Column) -> Column:
    return F.coalesce(F.nullif(F.btrim(F.regexp_replace(value, "[^A-Za-z0-9._-]+", "_"), F.lit("._")), F.lit("")), F.lit("source"))


def first_uuid(value: Column) -> Column:
    return F.lower(F.regexp_extract(value, r"[0-9a-fA-F]{8}(?:-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}", 0))


def identity(value: Column) -> Column:
    """NFKC without white space around, case folded, slashes one way; digits stay."""
    plain = _by_form(value, F.lower(F.btrim(value, F.lit(" \t\n\x0b\f\r\x1c\x1d\x1e\x1f"))), _fold_text)
    return F.translate(plain, "\\", "/")


def identity_key(*parts: Column) -> Column:
    """16 hex digits of the SHA-256 of identities, one a line: order counts, and null is not empty."""
    return F.substring(F.sha2(F.concat_ws("\n", *[F.coalesce(identity(p), F.lit("\0")) for p in parts]), 256), 1, 16)


def md5_id(value: Column) -> Column:
    return F.conv(F.substring(F.md5(value), 1, 8), 16, 10).cast("long")


def unique_strings(values: Column) -> Column:
    return F.array_distinct(F.filter(values, lambda v: v.isNotNull() & (v != "")))


def version_numbers(value: Column) -> Column:
    """A version's numbers as (digits, text without leading zeros), which order like numbers of any length."""
    plain = lambda v: F.regexp_replace(v, "^0+(?=.)", "")
    return F.transform(F.regexp_extract_all(value, F.lit(r"\d+"), F.lit(0)), lambda v: F.struct(F.length(plain(v)).alias("digits"), plain(v).alias("text")))


def is_newer(candidate: Column, current: Column) -> Column:
    return version_numbers(candidate) > version_numbers(current)


def html(value: Column) -> Column:
    """Escaped text with **bold** marked up."""
    for old, new in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;")):
        value = F.replace(value, F.lit(old), F.lit(new))
    return F.regexp_replace(value, r"\*\*(.+?)\*\*", "<strong>$1</strong>")


def garbage_ratio(text: Column) -> Column:
    """The share of U+FFFD and control characters; an empty text is all garbage."""
    kept = F.length(F.regexp_replace(text, r"[\x{fffd}\x00-\x08\x0b\x0e-\x1f]", ""))
    return F.when(F.length(text) > 0, (F.length(text) - kept) / F.length(text)).otherwise(1.0)


def fingerprint(text: Column) -> Column:
    """A question's comparison key: folded, without a leading number, letters and digits only."""
    bare = F.regexp_replace(fold(F.coalesce(text, F.lit(""))), r"^\s*(?:question\s*)?\d+\s*[).:;-]\s*", "")
    return F.regexp_replace(bare, r"[^\p{L}\p{N}\p{M}_\x{600}-\x{6ff}]+", "")


def register(spark) -> None:
    """The Python-backed function for SQL users; all others are SQL expressions already."""
    spark.udf.register("fold_text", _fold)

