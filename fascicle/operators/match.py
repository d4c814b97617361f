"""Matching of local and remote sources: equi joins on exploded name variants, then counts.

A hash or status of '' means unknown, and an unknown hash matches any.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from fascicle import schema
from fascicle.functions.keys import extension, source_key, source_stem

#: Words of a name that say nothing about its topic (fixed values).
GENERIC = ("exam", "exams", "final", "question", "questions", "bank", "mcq", "written", "end")


def normalized_status(status: Column) -> Column:
    plain = F.lower(F.btrim(F.coalesce(status.cast("string"), F.lit(""))))
    out = F.when(F.lit(False), plain)
    for number, name in schema.STATUS_NUMBERS.items():
        out = out.when(plain == number, name)
    return out.otherwise(plain)


def is_ready(status: Column) -> Column:
    return normalized_status(status).isin(*schema.READY_STATUSES)


def hash_matches(hashes: Column, remote: Column) -> Column:
    known = F.filter(F.coalesce(hashes, F.array().cast("array<string>")), lambda h: h != "")
    return (F.size(known) == 0) | (F.coalesce(remote, F.lit("")) == "") | F.array_contains(known, remote)


def extensions_compatible(a: Column, b: Column) -> Column:
    pair = lambda x, y: (a.isin(*x) & b.isin(*y)) | (a.isin(*y) & b.isin(*x))
    slides, recordings = schema.SLIDE_EXTENSIONS, schema.RECORDING_EXTENSIONS
    return (a == "") | (b == "") | (a == b) | pair((".pdf", ".docx"), (".txt", ".md")) | pair(slides, (*slides, ".pdf")) | pair(recordings, recordings)


def classify_role(path: Column) -> Column:
    """Root first, then extension, then words of the name."""
    root, ext = F.split_part(path, F.lit("/"), F.lit(1)), extension(path)
    words = F.split(source_stem(path), " ")
    return (
        F.when(root == "Exams", "past_exam").when(root == "Questions", "question_bank").when(ext.isin(*schema.RECORDING_EXTENSIONS), "recording")
        .when(ext.isin(*schema.SLIDE_EXTENSIONS), "slides").when(F.arrays_overlap(words, F.array(F.lit("book"), F.lit("textbook"), F.lit("كتاب"))), "textbook").otherwise("lecture_material")
    )


def name_pairs(local: DataFrame, remote: DataFrame, ready_only: bool = True) -> DataFrame:
    """(relative_path, hashes, source_id, rhash) of ready (or all) remotes with a compatible name.

    Names match by key, or by stem (a cache suffix of 12 hex digits apart) with compatible
    extensions; both are equi joins on up to three names of the local source.
    """
    names = F.when(F.col("preparation_action") == "chunk", F.array("prepared_name")).otherwise(F.array("name", "original_name", "prepared_name"))
    variants = local.select("relative_path", "hashes", F.explode(F.array_distinct(F.filter(names, lambda n: F.coalesce(n, F.lit("")) != ""))).alias("__name"))
    variants = variants.select("relative_path", "hashes", source_key(F.col("__name")).alias("key"), source_stem(F.col("__name")).alias("stem"), extension(F.col("__name")).alias("ext"))
    titles = (remote.where(is_ready(F.col("status"))) if ready_only else remote).select("source_id", F.coalesce("content_hash", F.lit("")).alias("rhash"), source_key(F.col("title")).alias("rkey"), F.regexp_replace(source_stem(F.col("title")), " [0-9a-f]{12}$", "").alias("rstem"), extension(F.col("title")).alias("rext"))
    by_key = variants.join(titles, F.col("key") == F.col("rkey"))
    by_stem = variants.join(titles, F.col("stem") == F.col("rstem")).where(extensions_compatible(F.col("ext"), F.col("rext")))
    return by_key.unionByName(by_stem).select("relative_path", "hashes", "source_id", "rhash")


def name_matches(local: DataFrame, remote: DataFrame) -> DataFrame:
    """(relative_path, source_id) of ready remotes with a compatible hash and name."""
    return name_pairs(local, remote).where(hash_matches(F.col("hashes"), F.col("rhash"))).select("relative_path", "source_id").distinct()


def deduplication_plan(local: DataFrame, remote: DataFrame) -> DataFrame:
    """local with n_matches, source_ids and decision: duplicate (1), ambiguous (more) or missing (0).

    Ignored rows are dropped; use_remote rows are duplicates whatever matches.
    """
    kept = local.where(F.col("preparation_action") != "ignore")
    found = name_matches(kept, remote).groupBy("relative_path").agg(F.count("*").alias("n_matches"), F.array_sort(F.collect_list("source_id")).alias("source_ids"))
    out = kept.join(found, "relative_path", "left").fillna(0, ["n_matches"])
    decision = F.when((F.col("preparation_action") == "use_remote") | (F.col("n_matches") == 1), "duplicate").when(F.col("n_matches") > 1, "ambiguous").otherwise("missing")
    return out.withColumn("source_ids", F.coalesce("source_ids", F.array().cast("array<string>"))).withColumn("decision", decision)


def resolve_names(requests: DataFrame, candidates: DataFrame, name_col: str = "name") -> DataFrame:
    """(request, matches, resolution): exact keys first, stems only where no key matches."""
    wanted = requests.select(F.col(name_col).alias("request"), source_key(F.col(name_col)).alias("k"), source_stem(F.col(name_col)).alias("s")).distinct()
    have = candidates.select(F.col(name_col).alias("candidate"), source_key(F.col(name_col)).alias("k"), source_stem(F.col(name_col)).alias("s")).distinct()
    ranked = wanted.join(have.select("candidate", "k"), "k").select("request", "candidate", F.lit(0).alias("r")).unionByName(wanted.join(have.select("candidate", "s"), "s").select("request", "candidate", F.lit(1).alias("r")))
    best = ranked.withColumn("least", F.min("r").over(Window.partitionBy("request"))).where("r = least").groupBy("request").agg(F.array_sort(F.collect_set("candidate")).alias("matches"))
    out = wanted.select("request").join(best, "request", "left")
    n = F.coalesce(F.size("matches"), F.lit(0))
    return out.withColumn("resolution", F.when(n == 1, "unique").when(n > 1, "ambiguous").otherwise("not_found"))


def topic_tokens(name: Column) -> Column:
    words = F.array_distinct(F.split(source_stem(name), " "))
    return F.filter(words, lambda w: (F.length(w) >= 3) & ~w.isin(*GENERIC) & ~w.rlike(r"^\d{4}$"))


def link_by_topic(exams: DataFrame, banks: DataFrame) -> DataFrame:
    """(exam, bank) with a topic word in common; an exam without any is linked to all banks."""
    e = exams.select(F.col("name").alias("exam")).distinct()
    b = banks.select(F.col("name").alias("bank")).distinct()
    shared = e.select("exam", F.explode(topic_tokens(F.col("exam"))).alias("w")).join(b.select("bank", F.explode(topic_tokens(F.col("bank"))).alias("w")), "w").select("exam", "bank").distinct()
    # Reference semantics: an unmatched exam takes every bank. Both sides are names of one module.
    rest = e.join(shared, "exam", "left_anti").join(b, F.lit(True))
    return shared.unionByName(rest)


def best_by_tokens(requests: DataFrame, candidates: DataFrame) -> DataFrame:
    """(request, candidate): the one candidate that shares most topic words, if it is the only best."""
    r = requests.select(F.col("name").alias("request"), F.explode(topic_tokens(F.col("name"))).alias("w"))
    c = candidates.select(F.col("name").alias("candidate"), F.explode(topic_tokens(F.col("name"))).alias("w"))
    score = r.join(c, "w").groupBy("request", "candidate").agg(F.count("*").alias("score"))
    ranked = score.withColumn("rank", F.rank().over(Window.partitionBy("request").orderBy(F.desc("score"))))
    return ranked.where("rank = 1").groupBy("request").agg(F.count("*").alias("n"), F.first("candidate").alias("candidate"), F.first("score").alias("score")).where("n = 1").drop("n")


def evidence_catalog(local: DataFrame, remote: DataFrame) -> DataFrame:
    """Local sources with their remotes, then remotes that no local source names."""
    matches = name_matches(local, remote).join(remote, "source_id").groupBy("relative_path").agg(
        F.array_sort(F.collect_set("source_id")).alias("source_ids"), F.array_sort(F.collect_set("notebook_uuid")).alias("notebook_ids"), F.array_sort(F.collect_set("title")).alias("aliases")
    )
    own = local.join(matches, "relative_path", "left")
    first = Window.partitionBy("normalized_name", "role").orderBy("relative_path")
    own = own.withColumn("normalized_name", source_key(F.col("name"))).withColumn("__n", F.row_number().over(first)).where("__n = 1")
    status = F.when(F.col("source_ids").isNull(), "local_only").otherwise("available")
    a = own.select(F.col("name").alias("canonical_name"), "normalized_name", "role", F.col("years").alias("verified_years"), "source_ids", "notebook_ids", "aliases", status.alias("content_status"))
    b = remote.withColumn("normalized_name", source_key(F.col("title"))).join(a.select("normalized_name"), "normalized_name", "left_anti").groupBy("normalized_name").agg(
        F.min("title").alias("canonical_name"), F.array_sort(F.collect_set("source_id")).alias("source_ids"), F.array_sort(F.collect_set("notebook_uuid")).alias("notebook_ids"), F.array_sort(F.collect_set("title")).alias("aliases"),
        F.when(F.bool_or(is_ready(F.col("status"))), "remote_only").otherwise("remote_processing").alias("content_status"),
    )
    b = b.withColumns({"role": F.lit("lecture_material"), "verified_years": F.array().cast("array<int>")})
    return a.unionByName(b)


def year_map(catalog: DataFrame) -> DataFrame:
    """(year, names): distinct sorted names of past exams with verified years that are available."""
    rows = catalog.where((F.col("role") == "past_exam") & F.col("content_status").isin("available", "remote_only"))
    return rows.select(F.explode("verified_years").alias("year"), "canonical_name").groupBy("year").agg(F.array_sort(F.collect_set("canonical_name")).alias("names"))
