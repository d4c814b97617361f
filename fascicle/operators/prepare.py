"""Preparation plans: what each source needs before it can be uploaded. Nothing is converted here."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fascicle import schema
from fascicle.functions.keys import extension, source_stem

# Extensions by what becomes of them, the size beyond which an upload takes long.
LEGACY_DOCUMENTS = (".doc", ".xls", ".xlsx", ".odt", ".rtf", ".epub")
TEXTS, VIDEOS = (".txt", ".md"), (".mp4", ".mkv", ".webm", ".avi", ".mov")
DOCUMENTS = (".pdf", ".docx", ".txt", ".md")
LARGE_BYTES = 80 << 20
MOST_GARBAGE = 0.02


def auto_action(ext: Column, size: Column, needs_ocr: Column, garbage: Column, limit: Column) -> Column:
    """(action, target, reason) of a source left to the rules: the first that holds. Unknown quality needs OCR."""
    plan = lambda a, t, r: F.struct(F.lit(a).alias("action"), (F.lit(t) if isinstance(t, str) else t).alias("target"), F.lit(r).alias("reason"))
    unread = F.coalesce(needs_ocr | (garbage > MOST_GARBAGE), F.lit(True))
    return (
        F.when(ext.isin(*(e for e in schema.SLIDE_EXTENSIONS if e != ".pptx")), plan("convert", ".pdf", "legacy slides"))
        .when(ext.isin(*LEGACY_DOCUMENTS), plan("convert", ".pdf", "legacy document")).when(ext.isin(*TEXTS), plan("convert", ".pdf", "text"))
        .when(ext.isin(*(e for e in VIDEOS if e not in schema.UPLOAD_EXTENSIONS)), plan("convert", ".m4a", "video"))
        .when((ext == ".pdf") & unread, plan("ocr", ".pdf", "no reliable text layer"))
        .when(size > limit, plan("wait", ext, "large")).otherwise(plan("use", ext, "eligible"))
    )


def plan(entries: DataFrame) -> DataFrame:
    """entries with planned_action, target, reason and error.

    ``entries`` is (relative_path, action, target_format, pages array<int>, size, max_upload_bytes,
    needs_ocr, garbage_ratio). Errors: a PDF action on another file, a chunk without pages, an
    unknown action, a path that leaves the root or stands twice.
    """
    ext, action = extension(F.col("relative_path")), F.col("action")
    form = F.lower(F.btrim(F.coalesce("target_format", F.lit(""))))
    form = F.when(form == "", None).when(form.startswith("."), form).otherwise(F.concat(F.lit("."), form))
    auto = auto_action(ext, F.col("size"), F.col("needs_ocr"), F.col("garbage_ratio"), F.coalesce("max_upload_bytes", F.lit(LARGE_BYTES)))
    default = F.when(ext.isin(*VIDEOS), ".m4a").when(ext.isin(*schema.SLIDE_EXTENSIONS, *LEGACY_DOCUMENTS, *TEXTS), ".pdf").otherwise(ext)
    target = F.when(action.isin("ocr", "compress", "chunk"), ".pdf").when(action == "convert", F.coalesce(form, default)).otherwise(F.coalesce(form, ext))
    key = F.lower(F.btrim(F.translate("relative_path", "\\", "/"), F.lit(" ./")))
    again = entries.groupBy(key.alias("__k")).agg(F.count("*").alias("__times"))
    error = (
        F.when(F.translate("relative_path", "\\", "/").rlike(r"^/|(?:^|/)\.\.(?:/|$)"), "escapes").when(F.col("__times") > 1, "repeated").when(~action.isin(*schema.ACTIONS), "unknown_action")
        .when(action.isin("ocr", "compress", "chunk") & (ext != ".pdf"), "needs_pdf").when((action == "chunk") & (F.coalesce(F.size("pages"), F.lit(0)) <= 0), "needs_pages")
    )
    rows = entries.withColumn("__k", key).join(again, "__k", "left").withColumn("__auto", auto)
    asked = action == "auto"
    return rows.withColumns({
        "planned_action": F.when(asked, F.col("__auto.action")).otherwise(action), "target": F.when(asked, F.col("__auto.target")).otherwise(target),
        "reason": F.when(asked, F.col("__auto.reason")).otherwise(F.concat(F.lit("asked: "), action)), "error": error,
    }).drop("__k", "__times", "__auto")


def extensions_compatible(a: Column, b: Column) -> Column:
    """Whether a prepared and a remote source may be the same: looser than match.extensions_compatible()."""
    slides, recordings = schema.SLIDE_EXTENSIONS, schema.RECORDING_EXTENSIONS
    both = lambda x: a.isin(*x) & b.isin(*x)
    return (a == "") | (b == "") | (a == b) | both(DOCUMENTS) | both(recordings) | (both((*slides, ".pdf")) & (a.isin(*slides) | b.isin(*slides)))


def remote_equivalents(local: DataFrame, remote: DataFrame) -> DataFrame:
    """local rows (name) that a remote title stands for: same stem, a cache suffix apart, compatible extension."""
    titles = remote.select(F.regexp_replace(source_stem(F.col("title")), " [0-9a-f]{12}$", "").alias("__stem"), extension(F.col("title")).alias("__ext")).distinct()
    rows = local.withColumn("__s", source_stem(F.col("name"))).withColumn("__e", extension(F.col("name")))
    return rows.join(titles, (F.col("__s") == F.col("__stem")) & extensions_compatible(F.col("__e"), F.col("__ext")), "left_semi").drop("__s", "__e")


def resolve_paths(entries: DataFrame, files: DataFrame) -> DataFrame:
    """(relative_path, found, error) of entries: a path as it is; a bare name by the one file of that name."""
    have = files.select(F.col("relative_path").alias("__p"), F.lower(F.regexp_extract("relative_path", r"([^/]*)$", 1)).alias("__n"))
    asked = entries.select("relative_path").distinct()
    direct = asked.join(have, F.col("relative_path") == F.col("__p")).select("relative_path", "__p", F.lit(0).alias("r"))
    bare = asked.where(~F.contains("relative_path", F.lit("/"))).join(have, F.lower("relative_path") == F.col("__n")).select("relative_path", "__p", F.lit(1).alias("r"))
    best = direct.unionByName(bare).groupBy("relative_path", "r").agg(F.count("*").alias("n"), F.min("__p").alias("p")).groupBy("relative_path").agg(F.min(F.struct("r", "n", "p")).alias("b"))
    n = F.col("b.n")
    return asked.join(best, "relative_path", "left").select("relative_path", F.when(n == 1, F.col("b.p")).alias("found"), F.when(n.isNull(), "not_found").when(n > 1, "ambiguous").alias("error"))
