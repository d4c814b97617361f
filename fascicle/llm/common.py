"""Pieces that several operators share: shared tables, skew-safe lookups, components."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A lookup key with at least rows / HEAVY_PARTS rows is heavy, so that at most HEAVY_PARTS keys are.
HEAVY_PARTS = 2000
#: A table is broadcast only when its counted rows take no more than this.
BROADCAST_BYTES = 32 << 20
#: Rows of an Arrow batch.
ARROW_ROWS = 512
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def ascii_lower(text: Column) -> Column:
    """A-Z lower-cased; every other character stays."""
    return F.translate(text, UPPER, LOWER)


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir; where it is unset, a temporary one in local mode only."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        if not re.fullmatch(r"local(\[[^-]*\])?", spark.sparkContext.master):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        found = f"file://{tempfile.mkdtemp(prefix='fascicle-')}"
        spark.conf.set("spark.checkpoint.dir", found)
    return found


def new_folder(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder, removed when the session's JVM ends."""
    path = f"{shared_folder(spark).rstrip('/')}/fascicle-{uuid.uuid4().hex[:12]}-{name}"
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(where)
    return path


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a Parquet table in the shared folder: cuts lineage and survives lost executors."""
    path = new_folder(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def broadcast_if_small(table: DataFrame, row_bytes: int, rows: int | None = None) -> DataFrame:
    """Marks the table for broadcast if its counted rows fit BROADCAST_BYTES; else it is shuffled."""
    rows = table.count() if rows is None else rows
    return F.broadcast(table) if rows * row_bytes <= BROADCAST_BYTES else table


def attach(rows: DataFrame, table: DataFrame, keys: list[str], weight: str, total: int, how: str = "inner") -> DataFrame:
    """Looks up each row's key in a table that holds a key once, with no hot task.

    ``weight`` is the key's number of rows, ``total`` all rows. Keys of at least
    total / HEAVY_PARTS rows (at most HEAVY_PARTS of them) are joined by broadcast; the
    others, each a small part of the rows, by shuffle. Both sides should be written tables.
    """
    least = max(2, -(-total // HEAVY_PARTS))
    heavy = F.broadcast(table.where(F.col(weight) >= least))
    light = table.where(F.col(weight) < least)
    hot = rows.join(heavy, keys, "inner")
    cold = rows.join(heavy.select(*keys), keys, "left_anti").join(light, keys, how)
    return hot.unionByName(cold)


def salted_join(rows: DataFrame, table: DataFrame, keys: list[str], counts: DataFrame, weight: str, total: int, by: list[str]) -> DataFrame:
    """Joins rows with a table that may hold a key several times, with no hot task.

    ``counts`` holds each key of rows once with its number of rows, ``weight``; ``total`` is all
    rows. A key of at least total / HEAVY_PARTS rows is dealt by a hash of the columns ``by``
    into parts of about that many, and the table's rows of it are copied to each.
    """
    least = max(2, -(-total // HEAVY_PARTS))
    heavy = F.broadcast(counts.where(F.col(weight) >= least).select(*keys, F.ceil(F.col(weight) / least).cast("int").alias("__parts")))  # at most HEAVY_PARTS
    parts = F.coalesce("__parts", F.lit(1))
    dealt = rows.join(heavy, keys, "left").withColumn("__salt", F.pmod(F.xxhash64(*by), parts).cast("int")).drop("__parts")
    copied = table.join(heavy, keys, "left").withColumn("__salt", F.explode(F.sequence(F.lit(0), parts - 1))).drop("__parts")
    return dealt.join(copied, [*keys, "__salt"]).drop("__salt")


def small_batches(spark: SparkSession) -> None:
    """Keeps Arrow batches to ARROW_ROWS rows: they take memory beside both the JVM's heap and Python's.

    A smaller setting of the session's own stays.
    """
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(name)) <= ARROW_ROWS:
        spark.conf.set(name, ARROW_ROWS)


#: What a Python worker keeps from task to task: one object, of the operator that ran last.
_KEPT: dict[str, object] = {}


def kept(key: str, make):
    """The worker's object of this key; another operator's is dropped before it is made."""
    from fascicle.llm import common

    if key not in common._KEPT:
        common._KEPT.clear()
        common._KEPT[key] = make()
    return common._KEPT[key]


def slices(batches, rows: int = 256):
    """Arrow batches (or arrays) in small parts, so that few texts at a time become Python objects."""
    for b in batches:
        for lo in range(0, len(b), rows):
            yield b.slice(lo, rows)


def keep_ids(docs: DataFrame, ids: DataFrame, id_col: str = "doc_id", how: str = "left_semi") -> DataFrame:
    """The rows of docs whose id is (left_semi) or isn't (left_anti) among ids; null equals null."""
    ids = ids.select(F.col(id_col).alias("__keep_id")).distinct()
    return docs.join(broadcast_if_small(ids, 16), docs[id_col].eqNullSafe(F.col("__keep_id")), how)


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """One star step over edges (u > v): every neighbour is linked to its smallest one.

    A large component's smallest node meets all its neighbours in one task of the join, whose
    other side holds a node once; rows are pairs of numbers.
    """
    both = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v"))) if large else edges
    least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
    joined = both.join(least, "u")
    if large:
        out = joined.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        out = joined.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
    return out.where("u <> v").distinct()


def _stars(edges: DataFrame) -> bool:
    """Whether every u of the edges (u > v) has one v, which is no other edge's u."""
    ends = F.explode(F.array(F.struct(F.col("u").alias("node"), F.lit(1).alias("leaf")), F.struct(F.col("v").alias("node"), F.lit(0).alias("leaf")))).alias("e")
    leaves = edges.select(ends).groupBy("e.node").agg(F.sum("e.leaf").alias("n"), F.min("e.leaf").alias("lo"))
    return leaves.where("n > 1 OR (n = 1 AND lo = 0)").isEmpty()


def components(edges: DataFrame, max_rounds: int = 40) -> DataFrame:
    """Connected components of edges (u long, v long): rows (node, component = smallest node).

    Alternates large-star and small-star steps, each written to the shared folder, until the
    edges are stars around smallest nodes; nothing is gathered on the driver but whether they are.
    """
    now = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u <> v").distinct()
    now = written(now, "edges")
    for _ in range(max_rounds):
        if _stars(now):
            break
        now = written(_star(_star(now, True), False), "edges")
    else:
        raise RuntimeError("components: no stars within max_rounds")
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("component"))).distinct()
