"""Manifests as tables: error rows of lecture, sync and module manifests, and manifests made from file names.

Error rows are (manifest_id, code, subject).
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fascicle import schema
from fascicle.functions.keys import extension, slug, strip_extension

# Types and roots that a manifest may name, and the profile's largest size.
ASSESSMENTS = ("past_exam", "question_bank", "ignore")
SYNC_ROOTS = ("lecture/", "questions/", "exams/")
PROFILE_CHARS, SYNC_VERSION, FIRST_YEAR = 20_000, 1, 2000
SLIDES, AUDIO, EXAMS = (".pptx", ".pdf", ".ppsx", ".ppt", ".docx"), (".mp3", ".m4a", ".wav", ".aac", ".ogg"), (".pdf", ".txt", ".docx")
BOOKS = ("book", "textbook", "reference")
COMMON = ("د", "دكتور", "dr", "part", "lecture", "1", "2", "3")

LECTURE = "manifest_id string, recording_sources array<string>, approved_uploads array<string>, exam_style_profile string, assessment_sources array<struct<path:string,type:string,year:string,years:array<string>>>, references array<struct<path:string,type:string>>"
SYNC = "manifest_id string, version int, module string, expected_module string, notebook_targets array<string>, sources array<struct<path:string,role:string,action:string,upload:boolean>>"
MODULES = "module_id string, schema_version int, display_name string, aliases array<string>, notebooks array<struct<id:string,title:string>>"


def _told(rows: DataFrame, rules: list[tuple[Column, str, Column]]) -> DataFrame:
    found = F.filter(F.array(*[F.struct(F.coalesce(when, F.lit(False)).alias("hit"), F.lit(code).alias("code"), subject.cast("string").alias("subject")) for when, code, subject in rules]), lambda r: r["hit"])
    out = rows.select("manifest_id", F.explode(found).alias("r"))
    return out.select("manifest_id", "r.code", "r.subject")


def _union(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def _plain(path: Column) -> Column:
    """A path with single slashes, without its "." parts, and with each ".." taken back against the part before it."""
    slashed = F.translate(F.btrim(F.coalesce(path, F.lit(""))), "\\", "/")
    parts = F.filter(F.split(slashed, "/"), lambda p: ~p.isin("", "."))
    root = F.startswith(slashed, F.lit("/"))
    last = lambda a: F.try_element_at(a, F.lit(-1))
    held = lambda a: (F.size(a) > 0) & (last(a) != "..")
    step = lambda a, p: F.when(p != "..", F.array_append(a, p)).when(held(a), F.slice(a, 1, F.size(a) - 1)).when(root, a).otherwise(F.array_append(a, p))
    kept = F.aggregate(parts, F.array().cast("array<string>"), step)
    return F.concat(F.when(root, "/").otherwise(""), F.array_join(kept, "/"))


def _escapes(path: Column) -> Column:
    """Whether a path of _plain() leaves its root."""
    return path.rlike(r"^/|^\.\.(?:/|$)")


def _repeats(keys: Column) -> Column:
    """The keys that stand more than once."""
    return F.array_distinct(F.filter(keys, lambda k: F.size(F.filter(keys, lambda x: x == k)) > 1))


def lecture_errors(manifests: DataFrame, as_of_year: int | None = None) -> DataFrame:
    """Error rows of lecture manifests, a table of LECTURE. With as_of_year, exam years go from FIRST_YEAR to the year after it."""
    none = F.lit(None).cast("string")
    names = F.transform("recording_sources", lambda n: F.lower(F.btrim(n)))
    uploads = F.transform(F.coalesce("approved_uploads", F.array().cast("array<string>")), _plain)
    head = _told(manifests, [
        (F.coalesce(F.size("recording_sources"), F.lit(0)) <= 0, "no_recordings", none), (F.exists(names, lambda n: F.coalesce(n, F.lit("")) == ""), "blank_recording", none),
        (F.size(_repeats(names)) > 0, "repeated_recording", F.array_join(_repeats(names), ", ")),
        (F.coalesce(F.size(F.json_object_keys("exam_style_profile")), F.lit(0)) <= 0, "no_style_profile", none), (F.length("exam_style_profile") > PROFILE_CHARS, "style_profile_too_large", none),
        (F.exists(uploads, lambda u: u == ""), "blank_upload", none), (F.exists(uploads, _escapes), "upload_escapes", F.array_join(F.filter(uploads, _escapes), ", ")),
        (F.exists(uploads, lambda u: ~_escapes(u) & F.contains(u, F.lit("/")) & ~u.rlike("^(?:Lecture|Questions)/")), "upload_outside", none),
        (F.size(_repeats(F.transform(uploads, lambda u: F.lower(u)))) > 0, "repeated_upload", F.array_join(_repeats(F.transform(uploads, lambda u: F.lower(u))), ", ")),
    ])
    sources = manifests.select("manifest_id", F.explode("assessment_sources").alias("s")).select("manifest_id", "s.*").withColumn("p", _plain(F.col("path")))
    year, years, exam = F.col("year").isNotNull(), F.col("years").isNotNull(), F.col("type") == "past_exam"
    digits = F.transform(F.array_union(F.array_compact(F.array("year")), F.coalesce("years", F.array().cast("array<string>"))), lambda y: F.btrim(y))
    blank = F.btrim(F.coalesce("path", F.lit(""))) == ""
    other = ~F.coalesce(F.col("type").isin(*ASSESSMENTS), F.lit(False)) | blank
    each = _told(sources, [
        (other, "assessment_type", F.col("path")), (exam & ~year & ~years, "exam_without_year", F.col("path")), (~exam & (year | years), "year_on_other_type", F.col("path")),
        (year & years & (F.array_sort(F.array_distinct(F.transform("years", lambda y: F.btrim(y)))) != F.array(F.btrim("year"))), "year_conflict", F.col("path")),
        (exam & F.exists(digits, lambda y: ~y.rlike(r"^\d+$")), "year_not_a_number", F.col("path")), (exam & F.exists(digits, lambda y: y.rlike(r"^\d+$") & ~F.coalesce(y.try_cast("int").between(FIRST_YEAR, (as_of_year or 9998) + 1), F.lit(False))), "year_out_of_range", F.col("path")), (_escapes(F.col("p")) | ~F.col("p").rlike("^Questions(?:/|$)"), "assessment_outside", F.col("path")),
    ])
    refs = manifests.select("manifest_id", F.explode("references").alias("s")).select("manifest_id", "s.path").withColumn("p", _plain(F.col("path")))
    more = _told(refs, [(blank, "reference_without_path", F.col("path")), (~blank & (_escapes(F.col("p")) | ~F.col("p").rlike("^(?:Lecture|Questions)/")), "reference_outside", F.col("path"))])
    again = [rows.groupBy("manifest_id", F.lower("p").alias("subject")).agg(F.count("*").alias("n")).where("n > 1 AND subject <> ''").select("manifest_id", F.lit(code).alias("code"), "subject") for rows, code in ((sources, "repeated_assessment"), (refs, "repeated_reference"))]
    return _union([head, each, more, *again])


def sync_errors(manifests: DataFrame) -> DataFrame:
    """Error rows of sync manifests, a table of SYNC; an action left out is auto."""
    none, targets = F.lit(None).cast("string"), F.coalesce("notebook_targets", F.array().cast("array<string>"))
    head = _told(manifests, [
        (~F.col("version").eqNullSafe(F.lit(SYNC_VERSION)), "version", F.col("version")), (~F.lower(F.btrim("module")).eqNullSafe(F.lower("expected_module")), "module", F.col("module")),
        (F.exists(targets, lambda t: F.btrim(t) == ""), "blank_target", none), (F.coalesce(F.size("sources"), F.lit(0)) <= 0, "no_sources", none),
    ])
    rows = manifests.select("manifest_id", F.explode("sources").alias("s")).select("manifest_id", "s.*").withColumn("p", F.lower(_plain(F.col("path")))).withColumn("a", F.lower(F.btrim(F.coalesce("action", F.lit("auto")))))
    inside = reduce(lambda x, r: x | F.startswith("p", F.lit(r)), SYNC_ROOTS, F.lit(False))
    each = _told(rows, [
        ((F.col("p") == "") | _escapes(F.col("p")), "invalid_path", F.col("path")), ((F.col("p") != "") & ~_escapes(F.col("p")) & ~inside, "path_outside", F.col("path")),
        (~F.col("a").isin(*schema.ACTIONS), "unknown_action", F.col("path")), ((F.col("a") == "ignore") & F.col("upload"), "ignored_upload", F.col("path")),
    ])
    again = rows.groupBy("manifest_id", F.col("p").alias("subject")).agg(F.count("*").alias("n")).where("n > 1 AND subject <> ''").select("manifest_id", F.lit("repeated_source").alias("code"), "subject")
    return _union([head, each, again])


def module_aliases(modules: DataFrame) -> DataFrame:
    """(module_id, alias_key) of ids, display names and aliases."""
    from fascicle.functions.keys import module_key

    names = F.concat(F.array("module_id", "display_name"), F.coalesce("aliases", F.array().cast("array<string>")))
    return modules.select("module_id", F.explode(names).alias("n")).select("module_id", module_key(F.col("n")).alias("alias_key")).where("alias_key <> ''").distinct()


def module_errors(modules: DataFrame) -> DataFrame:
    """Error rows of module configurations, a table of MODULES: form of ids, notebooks, aliases that modules share."""
    from fascicle.operators.sync import alias_conflicts

    rows = modules.withColumn("manifest_id", F.col("module_id"))
    ids = F.transform("notebooks", lambda n: n["id"])
    head = _told(rows, [
        (~F.col("schema_version").eqNullSafe(F.lit(1)), "schema_version", F.col("schema_version")), (~F.coalesce(F.col("module_id").rlike("^[a-z0-9]+(?:-[a-z0-9]+)*$"), F.lit(False)), "module_id", F.col("module_id")),
        (F.btrim(F.coalesce("display_name", F.lit(""))) == "", "display_name", F.lit(None)), (F.coalesce(F.size("notebooks"), F.lit(0)) <= 0, "no_notebooks", F.lit(None)), (F.size(_repeats(ids)) > 0, "repeated_notebook", F.array_join(_repeats(ids), ", ")),
    ])
    shared = alias_conflicts(module_aliases(modules)).select(F.explode("modules").alias("manifest_id"), F.lit("shared_alias").alias("code"), F.col("alias_key").alias("subject"))
    return head.unionByName(shared)


def manifest_years(name: Column) -> Column:
    """Years 2010 to 2029 in a name; without any, its standalone numbers 18 to 29 as 20xx (30 has no such form)."""
    long = F.transform(F.regexp_extract_all(name, F.lit(r"(20[12]\d)"), F.lit(1)), lambda y: y.cast("int"))
    short = F.filter(F.transform(F.regexp_extract_all(name, F.lit(r"(?:^|[^0-9])([12]\d)(?:[^0-9]|$)"), F.lit(1)), lambda y: y.cast("int")), lambda y: y.between(18, 30))
    return F.when(F.size(long) > 0, long).otherwise(F.transform(short, lambda y: y + 2000))


def topic_score(query: Column, tokens: Column, synonyms: Column, name: Column) -> Column:
    """How well a file name fits a lecture: whole, by words, by other names of its topic."""
    low, total = F.lower(name), lambda xs, f: F.aggregate(F.transform(xs, f), F.lit(0), lambda a, v: a + v)
    within = lambda a, b: F.contains(a, b) | F.contains(b, a)
    begins = lambda x: (F.length(x) >= 4) & (F.contains(low, F.substring(x, 1, 4)) | F.contains(x, F.substring(low, 1, 4)))
    step = lambda whole, start: lambda x: F.when(within(low, x), whole).when(begins(x), start).otherwise(0)
    return F.when(within(F.lower(query), low), 50).otherwise(0) + total(tokens, step(20, 15)) + total(synonyms, step(30, 25))


def auto_manifest(lectures: DataFrame, files: DataFrame, synonyms: dict[str, str] | None = None) -> DataFrame:
    """(lecture, title, slug, slides, recordings, assessments) of lectures (module, lecture) from files (module, relative_path).

    Slides: the first file of the highest score, else the first book, else a name made up.
    Recordings: the lecture itself if it names one, else all with a score, else a name made up.
    Assessments: all files under Questions with their latest year.
    """
    known = F.create_map(*[F.lit(x.lower()) for kv in (synonyms or {}).items() for x in kv]) if synonyms else F.create_map().cast("map<string,string>")
    title = F.btrim(F.regexp_replace(F.btrim("lecture"), r"(?i)\.(mp3|m4a|wav|aac|ogg|pdf|pptx|ppsx)$", ""))
    tokens = F.filter(F.regexp_extract_all(F.lower("title"), F.lit(r"[\p{L}\p{N}\p{M}_]+"), F.lit(0)), lambda t: (F.length(t) > 1) & ~t.isin(*COMMON))
    other = F.concat(F.filter(F.transform("tokens", lambda t: F.try_element_at(known, t)), lambda s: s.isNotNull()), F.transform(F.filter(F.map_entries(known), lambda e: F.contains(F.lower("title"), e["key"])), lambda e: e["value"]))
    asked = lectures.select("module", "lecture", title.alias("title")).withColumn("tokens", tokens).withColumn("synonyms", other)
    path = F.col("relative_path")
    kept = files.select("module", "relative_path", F.regexp_extract(path, r"^(Lecture|Questions)/([^/.][^/]*)$", 1).alias("root"), F.regexp_extract(path, r"([^/]*)$", 1).alias("name"), extension(path).alias("ext")).where("root <> ''")
    stem = F.lower(strip_extension(F.col("name")))
    use = F.when(F.col("root") == "Questions", F.when(F.col("ext").isin(*EXAMS), "assessment")).when(F.col("ext").isin(*AUDIO), "audio").when(F.col("ext").isin(*SLIDES), F.when(stem.isin(*BOOKS), "book").otherwise("slides"))
    kept = kept.withColumn("use", use).where("use IS NOT NULL")
    met = asked.join(kept, "module", "left").withColumn("score", F.when(F.col("use").isin("audio", "slides"), topic_score(F.col("title"), F.col("tokens"), F.col("synonyms"), F.col("name"))))
    years = manifest_years(F.col("name"))
    exam = F.struct("relative_path", F.when(F.size(years) > 0, "past_exam").otherwise("question_bank").alias("type"), F.array_max(years).alias("year"))
    best = F.max(F.when((F.col("use") == "slides") & (F.col("score") > 0), F.col("score")))
    out = met.groupBy("module", "lecture", "title").agg(
        best.alias("best"), F.array_sort(F.collect_set(F.when((F.col("use") == "slides") & (F.col("score") > 0), F.struct((-F.col("score")).alias("s"), "relative_path")))).alias("slides"), F.min(F.when(F.col("use") == "book", F.col("relative_path"))).alias("book"),
        F.array_sort(F.collect_set(F.when((F.col("use") == "audio") & (F.col("score") > 0), F.col("name")))).alias("audio"), F.array_sort(F.collect_set(F.when(F.col("use") == "assessment", exam))).alias("assessments"),
    )
    slides = F.coalesce(F.try_element_at("slides", F.lit(1))["relative_path"], "book", F.concat(F.lit("Lecture/"), "title", F.lit(".pdf")))
    recordings = F.when(F.lower("lecture").rlike(r"\.(?:mp3|m4a|wav|aac|ogg)$"), F.array(F.btrim("lecture"))).when(F.size("audio") > 0, F.col("audio")).otherwise(F.array(F.concat("title", F.lit(".mp3"))))
    return out.select("module", "lecture", "title", F.coalesce(F.nullif(slug(F.col("title")), F.lit("")), F.lit("lecture")).alias("slug"), slides.alias("slides"), recordings.alias("recordings"), "assessments")
