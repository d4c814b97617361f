"""Inventories in JSON payloads of any of their shapes, by VARIANT.

A payload is a list of sources, or an object that holds one: under sources, items, data or
results (in this order), as a list or as an object of these shapes again, however deep; or an
object whose values are sources. A list ends the search of its object even if it is empty; an
object without sources doesn't end its parent's.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fascicle.functions.keys import source_key, source_stem
from fascicle.operators.match import normalized_status
from fascicle.operators.tables import materialised

# Where a payload may hold its sources, and the fields of a source, in order.
HOLDERS = ("sources", "items", "data", "results")
TITLES = ("title", "name", "display_name", "source_name")
IDS, TYPES = ("id", "source_id"), ("type", "source_type")
HASHES, STATES = ("sha256", "hash", "checksum"), ("status", "state", "processing_status")


def kind(value: Column) -> Column:
    """list, object, null, or value; null for no value at all."""
    schema = F.schema_of_variant(value)
    return F.when(F.startswith(schema, F.lit("ARRAY<")), "list").when(F.startswith(schema, F.lit("OBJECT<")), "object").when(schema == "VOID", "null").when(schema.isNotNull(), "value")


def member(value: Column, key: str) -> Column:
    return F.try_variant_get(value, f"$.{key}", "variant")


def objects(value: Column) -> Column:
    """The objects among a list's elements or an object's values (these in order of their keys)."""
    rows = F.when(kind(value) == "list", F.try_variant_get(value, "$", "array<variant>")).when(kind(value) == "object", F.map_values(F.try_variant_get(value, "$", "map<string, variant>")))
    return F.filter(rows, lambda r: F.coalesce(kind(r) == "object", F.lit(False)))


def text(value: Column) -> Column:
    """A value as text; null for what counts as nothing: none, null, false, zero, empty texts, lists and objects."""
    plain = F.try_variant_get(value, "$", "string")
    numeric = F.schema_of_variant(value).rlike("^(?:BIGINT|INT|SMALLINT|TINYINT|DOUBLE|FLOAT|DECIMAL)")
    nothing = (plain == "") | ((F.schema_of_variant(value) == "BOOLEAN") & (plain == "false")) | (numeric & (plain.try_cast("double") == 0)) | plain.isin("[]", "{}")
    return F.when(~nothing, plain)


def first_text(source: Column, keys: tuple[str, ...]) -> Column:
    return F.coalesce(*[text(member(source, k)) for k in keys], F.lit(""))


def status(source: Column) -> Column:
    """The first status that isn't null, by name: numbers have names, texts are folded."""
    found = F.coalesce(*[F.when(kind(member(source, k)) != "null", member(source, k)) for k in STATES])
    whole = F.try_variant_get(found, "$", "double").cast("long").cast("string")
    numeric = F.schema_of_variant(found).rlike("^(?:BIGINT|INT|SMALLINT|TINYINT|DOUBLE|FLOAT|DECIMAL)")
    return F.coalesce(F.when(numeric, normalized_status(whole)).otherwise(F.lower(F.btrim(F.try_variant_get(found, "$", "string")))), F.lit(""))


def entries(payloads: DataFrame, id_col: str = "notebook_uuid", column: str = "payload") -> DataFrame:
    """(id, place, source variant) of each payload's sources, and place null with ``error`` where there are none.

    The errors: not_json, or no_sources. Each round goes one level deeper, over all payloads.
    """
    key = F.monotonically_increasing_id().alias("__row")
    rows = materialised(payloads.select(key, F.col(id_col).alias("__id"), F.col(column).cast("string").alias("__text")), "payloads")
    nodes = rows.select("__row", F.array().cast("array<int>").alias("path"), F.try_parse_json("__text").alias("v"))
    found = []
    while True:
        nodes = materialised(nodes.withColumn("kind", kind(F.col("v"))), "payload-nodes")
        lists = nodes.where("kind = 'list'")
        found.append(lists.select("__row", "path", objects(F.col("v")).alias("found")))
        held = F.array(*[F.struct(F.lit(i).alias("at"), member(F.col("v"), k).alias("v"), kind(member(F.col("v"), k)).alias("kind")) for i, k in enumerate(HOLDERS)])
        inner = nodes.where("kind = 'object'").withColumn("held", F.filter(held, lambda h: h["kind"].isin("list", "object")))
        # What follows a list in its object is not looked at.
        at = F.coalesce(F.array_min(F.transform(F.filter("held", lambda h: h["kind"] == "list"), lambda h: h["at"])), F.lit(len(HOLDERS)))
        inner = inner.withColumn("end", at)
        own = objects(F.col("v"))
        titled = lambda s: F.coalesce(*[F.when(kind(member(s, t)).isNotNull(), True) for t in TITLES], F.lit(False))
        mapped = F.when((F.size(own) > 0) & F.forall(own, titled), own)
        found.append(inner.where(F.col("end") == len(HOLDERS)).select("__row", F.concat("path", F.array(F.lit(len(HOLDERS)))).alias("path"), F.coalesce(mapped, F.array().cast("array<variant>")).alias("found")))
        nodes = inner.select("__row", "path", F.explode(F.filter("held", lambda h: h["at"] <= F.col("end"))).alias("h")).select("__row", F.concat("path", F.array("h.at")).alias("path"), F.col("h.v").alias("v"))
        if nodes.isEmpty():
            break
    every = found[0]
    for f in found[1:]:
        every = every.unionByName(f)
    best = every.where(F.size("found") > 0).groupBy("__row").agg(F.min_by("found", "path").alias("found"))
    out = rows.join(best, "__row", "left").select("__id", "__text", F.posexplode_outer("found").alias("place", "source"))
    error = F.when(F.try_parse_json("__text").isNull(), "not_json").when(F.col("place").isNull(), "no_sources")
    return out.select(F.col("__id").alias(id_col), "place", "source", error.alias("error"))


def inventory(payloads: DataFrame, id_col: str = "notebook_uuid", column: str = "payload") -> tuple[DataFrame, DataFrame]:
    """(remote sources, error rows (id, error)) of payloads; sources without a title are left out."""
    told = materialised(entries(payloads, id_col, column), "payload-sources")
    s = F.col("source")
    rows = told.where("place IS NOT NULL").select(
        first_text(s, IDS).alias("source_id"), F.btrim(first_text(s, TITLES)).alias("title"), first_text(s, TYPES).alias("source_type"), id_col, F.lower(F.btrim(first_text(s, HASHES))).alias("content_hash"), status(s).alias("status")
    ).where("title <> ''")
    rows = rows.withColumns({"normalized_name": source_key(F.col("title")), "normalized_stem": source_stem(F.col("title"))})
    return rows, told.where("error IS NOT NULL").select(id_col, "error")
