"""Query scopes and inventories: what a question is asked of, and what becomes of rejected sources."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from fascicle import schema
from fascicle.functions.keys import extension, first_uuid, source_key, source_stem
from fascicle.operators.match import extensions_compatible, is_ready
from fascicle.operators.tables import materialised

EXAM_ROLES = ("past_exam", "question_bank")


def build_scope(titles: DataFrame, remote: DataFrame) -> DataFrame:
    """(project_id, ordinal, source_id, source_name) of titles (ordinal, title): each project's ready sources.

    A title takes the sources of its key, only without any those of its stem; a source counts
    once, at its first title.
    """
    have = remote.where(is_ready(F.col("status")) & (F.coalesce("source_id", F.lit("")) != "")).select(F.col("notebook_uuid").alias("project_id"), "source_id", F.col("title").alias("source_name"))
    keyed = have.withColumns({"k": source_key(F.col("source_name")), "s": source_stem(F.col("source_name"))})
    asked = titles.select("ordinal", source_key(F.col("title")).alias("k"), source_stem(F.col("title")).alias("s"))
    found = asked.select("ordinal", "k").join(keyed.drop("s"), "k").drop("k").withColumn("r", F.lit(0)).unionByName(asked.select("ordinal", "s").join(keyed.drop("k"), "s").drop("s").withColumn("r", F.lit(1)))
    best = found.withColumn("least", F.min("r").over(Window.partitionBy("ordinal"))).where("r = least")
    once = best.groupBy("project_id", "source_id").agg(F.min(F.struct("ordinal", "source_name")).alias("f"))
    place = F.row_number().over(Window.partitionBy("project_id").orderBy("f.ordinal", "source_id"))
    return once.select("project_id", place.alias("ordinal"), "source_id", F.col("f.source_name").alias("source_name"))


def scope_names(scope: DataFrame, wanted: DataFrame) -> DataFrame:
    """(project_id, ordinal, source_id, source_name) of the wanted (project_id, source_id), in the scope's order."""
    return scope.join(wanted.select("project_id", "source_id").distinct(), ["project_id", "source_id"], "left_semi")


def bisect_scopes(batches: DataFrame, ask: Callable[[DataFrame], DataFrame], max_rounds: int = 40) -> tuple[DataFrame, DataFrame]:
    """(answers, quarantine) of batches (project_id, batch, source_ids).

    ``ask`` takes such rows and gives (project_id, batch, answer, rejected boolean, error). A
    rejected batch is halved and asked again; of one source it goes to quarantine (project_id,
    source_id, error). A round asks all halves at once, so rounds grow with the logarithm of a
    batch; what it is told is written, so each scope is asked once. Batches are known by their
    path: "0" and "1" added at each halving. A scope that ask gives no row for is an error, as
    is one left after max_rounds. No batches give no rows.
    """
    key = ["project_id", "batch"]
    left = materialised(batches.withColumn("batch", F.col("batch").cast("string")), "scopes")
    told = []
    for _ in range(max_rounds):
        asked = materialised(left.join(ask(left).select(*key, "answer", "rejected", "error", F.lit(True).alias("told")), key, "left"), "answers")
        if not asked.where("told IS NULL OR rejected IS NULL").isEmpty():
            raise ValueError("a scope was asked and not answered")
        told.append(asked)
        half = F.floor(F.size("source_ids") / 2).cast("int")
        halves = F.array(F.struct(F.lit("0").alias("side"), F.slice("source_ids", F.lit(1), half).alias("ids")), F.struct(F.lit("1").alias("side"), F.slice("source_ids", half + 1, F.size("source_ids")).alias("ids")))
        bad = asked.where(F.col("rejected") & (F.size("source_ids") > 1))
        left = bad.select("project_id", "batch", F.explode(halves).alias("h")).select("project_id", F.concat("batch", F.lit("."), "h.side").alias("batch"), F.col("h.ids").alias("source_ids"))
        if left.isEmpty():
            break
    else:
        raise RuntimeError("bisect_scopes: scopes are left after max_rounds")
    every = reduce(DataFrame.unionByName, told)
    gone = every.where(F.col("rejected") & (F.size("source_ids") <= 1))
    return every.where("NOT rejected").select(*key, "source_ids", "answer"), gone.select("project_id", F.try_element_at("source_ids", F.lit(1)).alias("source_id"), "error")


def retry_plan(attempts: DataFrame, most: int = 3, step: int = 5) -> DataFrame:
    """attempts (request_id, attempt, error, quarantined, answer) with next: done, stop, or retry after wait seconds."""
    ok = F.col("error").isNull()
    stop = F.col("quarantined") | (F.coalesce("answer", F.lit("")) != "") | (F.col("attempt") >= most)
    return attempts.withColumns({"next": F.when(ok, "done").when(stop, "stop").otherwise("retry"), "wait": F.when(~ok & ~stop, F.col("attempt") * step)})


def quarantine_plan(quarantine: DataFrame, remote: DataFrame, local: DataFrame) -> DataFrame:
    """(notebook_uuid, source_id, source_name, live_id, relative_path, error): what replaces a rejected source.

    Its live source is that of its id, else the only one of its name (or stem with a compatible
    extension) in its notebook. Its replacement is the only usable local file of that name.
    """
    q = quarantine.select("notebook_uuid", "source_id", "source_name")
    have = remote.select(F.col("notebook_uuid").alias("nb"), F.col("source_id").alias("rid"), F.col("title").alias("title"))
    by_id = q.join(have, (F.col("nb") == F.col("notebook_uuid")) & (F.col("rid") == F.col("source_id"))).select("notebook_uuid", "source_id", "source_name", "rid", "title", F.lit(0).alias("r"))
    named = q.withColumns({"k": source_key(F.col("source_name")), "s": source_stem(F.col("source_name")), "e": extension(F.col("source_name"))}).where("k <> ''")
    titles = have.withColumns({"tk": source_key(F.col("title")), "ts": source_stem(F.col("title")), "te": extension(F.col("title"))})
    by_name = named.join(titles, (F.col("nb") == F.col("notebook_uuid")) & (F.col("ts") == F.col("s"))).where((F.col("k") == F.col("tk")) | extensions_compatible(F.col("e"), F.col("te"))).select("notebook_uuid", "source_id", "source_name", "rid", "title", F.lit(1).alias("r"))
    key = ["notebook_uuid", "source_id", "source_name"]
    live = by_id.unionByName(by_name).groupBy(*key, "r").agg(F.count_distinct("rid").alias("n"), F.min(F.struct("rid", "title")).alias("x")).groupBy(*key).agg(F.min(F.struct("r", "n", "x")).alias("live"))
    rows = q.join(live, key, "left").withColumn("title", F.coalesce("live.x.title", "source_name"))
    files = local.where((F.col("role") != "ignore") & extension(F.col("name")).isin(*schema.UPLOAD_EXTENSIONS)).select("relative_path", source_key(F.col("name")).alias("fk"), source_stem(F.col("name")).alias("fs"), extension(F.col("name")).alias("fe"))
    wanted = rows.withColumns({"k": source_key(F.col("title")), "s": F.regexp_replace(source_stem(F.col("title")), " [0-9a-f]{12}$", ""), "e": extension(F.col("title"))})
    met = wanted.join(files, (F.col("fs") == F.col("s")) & ((F.col("fk") == F.col("k")) | extensions_compatible(F.col("fe"), F.col("e"))), "left")
    out = met.groupBy(*key, "live").agg(F.count_distinct("relative_path").alias("n"), F.min("relative_path").alias("path"))
    m = F.coalesce("live.n", F.lit(0))
    error = F.when(m == 0, "no live source").when(m > 1, "several live sources").when(F.col("n") == 0, "no local file").when(F.col("n") > 1, "several local files")
    return out.select(*key, F.when(m == 1, F.col("live.x.rid")).alias("live_id"), F.when(error.isNull(), F.col("path")).alias("relative_path"), error.alias("error"))


def remote_role(title: Column, source_type: Column) -> Column:
    """Whether a remote source is a recording: by extension, or by a type that says audio or video."""
    return extension(title).isin(*schema.RECORDING_EXTENSIONS) | F.lower(F.coalesce(source_type, F.lit(""))).rlike("audio|video")


def recording_inventory(remote: DataFrame) -> DataFrame:
    """Recordings (notebook_uuid, title, source_id), the first of each name in a notebook."""
    rows = remote.where(remote_role(F.col("title"), F.col("source_type"))).withColumn("key", source_key(F.col("title")))
    return rows.groupBy("notebook_uuid", "key").agg(F.min(F.struct("source_id", "title")).alias("f")).select("notebook_uuid", "f.title", "f.source_id")


def pending_recordings(recordings: DataFrame, transcripts: DataFrame) -> DataFrame:
    """Recordings (title) without a transcript (name) of their stem."""
    done = transcripts.select(source_stem(F.col("name")).alias("__stem")).distinct()
    return recordings.withColumn("__s", source_stem(F.col("title"))).join(done, F.col("__s") == F.col("__stem"), "left_anti").drop("__s")


def find_notebooks(requests: DataFrame, notebooks: DataFrame) -> DataFrame:
    """(request, notebook_id, error) of requests: the notebook of an id in it, else the only one of its title."""
    have = notebooks.select(F.lower("id").alias("id"), source_key(F.col("title")).alias("k")).distinct()
    asked = requests.select("request", F.nullif(first_uuid(F.col("request")), F.lit("")).alias("uuid"), source_key(F.col("request")).alias("rk")).distinct()
    met = asked.join(have, (F.col("uuid") == F.col("id")) | (F.col("uuid").isNull() & (F.col("rk") == F.col("k"))), "left").groupBy("request").agg(F.count_distinct("id").alias("n"), F.min("id").alias("id"))
    n = F.col("n")
    return met.select("request", F.when(n == 1, F.col("id")).alias("notebook_id"), F.when(n == 0, "not_found").when(n > 1, "ambiguous").alias("error"))


def configured_slides(lectures: DataFrame, mappings: DataFrame) -> DataFrame:
    """(lecture, slides) of the mappings (lecture, slides) that a module's configuration holds, by key."""
    have = mappings.select(source_key(F.col("lecture")).alias("__k"), "slides").groupBy("__k").agg(F.max("slides").alias("slides"))
    return lectures.select("lecture", source_key(F.col("lecture")).alias("__k")).join(have, "__k", "left").select("lecture", "slides")


def required_missing(missing: DataFrame, requested: DataFrame) -> DataFrame:
    """Missing sources (name, role) that a run needs: exams and banks, and those it asks for by name or stem."""
    names = requested.select(F.explode(F.array(source_key(F.col("name")), source_stem(F.col("name")))).alias("__n")).distinct()
    rows = missing.withColumn("__k", F.explode(F.array_distinct(F.array(source_key(F.col("name")), source_stem(F.col("name"))))))
    asked = rows.join(names, F.col("__k") == F.col("__n"), "left_semi").drop("__k")
    return asked.unionByName(missing.where(F.col("role").isin(*EXAM_ROLES))).distinct()


def upload_split(local: DataFrame) -> DataFrame:
    """local with support: ignored, unsupported or supported."""
    return local.withColumn("support", F.when((F.col("role") == "ignore") | (F.col("preparation_action") == "ignore"), "ignored").when(extension(F.coalesce(F.nullif("prepared_name", F.lit("")), "name")).isin(*schema.UPLOAD_EXTENSIONS), "supported").otherwise("unsupported"))
