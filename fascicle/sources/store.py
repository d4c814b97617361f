"""Tables that change as a whole: phase checkpoints by run, drafts by document, and commits over several tables.

A commit writes its rows to a folder of its own and becomes visible by one log entry, which is
made by a rename that fails if the entry exists. What no entry names was never committed.
"""

from __future__ import annotations

import hashlib
import json
import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fascicle.operators import checkpoint, rewrite
from fascicle.operators.tables import materialised


def _fs(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), where


def exists(spark: SparkSession, path: str) -> bool:
    fs, where = _fs(spark, path)
    return fs.exists(where)


# Rows by partition


def _replace(rows: DataFrame, path: str, by: str) -> None:
    """Writes rows over the partitions they belong to; others stay, and a failed write leaves all."""
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(by).parquet(path)


def save_phases(results: DataFrame, path: str, at: str = "saved") -> None:
    """Takes phase results (run_id, phase, ..., saved) into the checkpoints at path.

    Only the partitions of the runs in results are read and written. A run's phases that results
    lacks stay, and of a phase the last saved row does. No results change nothing.
    """
    spark = results.sparkSession
    results = materialised(results, "phase-results")
    runs = results.select("run_id").distinct()
    rows = results
    if exists(spark, path):
        held = spark.read.parquet(path)
        # A partition filter: the runs of one save are few, and their number is checked.
        named = [r.run_id for r in runs.limit(1001).collect()]
        held = held.where(F.col("run_id").isin(named)) if len(named) <= 1000 else held.join(runs, "run_id", "left_semi")
        rows = held.select(*[c for c in held.columns]).unionByName(results, allowMissingColumns=True)
    _replace(materialised(checkpoint.latest_of(rows, ["run_id", "phase"], at), "phases"), path, "run_id")


def phases(spark: SparkSession, path: str, accepted: tuple[str, ...] | None = None) -> DataFrame:
    """The checkpoints at path; with ``accepted``, those of such a status only."""
    rows = spark.read.parquet(path)
    return rows if accepted is None else rows.where(F.col("status").isin(*accepted))


def save_drafts(drafts: DataFrame, faults: DataFrame, path: str, parts: int = 64) -> DataFrame:
    """Saves drafts (doc_id, text) without faults (doc_id, ...); gives the doc_ids that were refused.

    Drafts lie by a hash of their id, so a save rewrites the parts it touches.
    """
    spark = drafts.sparkSession
    part = F.pmod(F.xxhash64(F.col("doc_id").cast("string")), F.lit(parts)).cast("int")
    rows = materialised(drafts.select("doc_id", "text", part.alias("part")), "drafts")
    bad = faults.select("doc_id").distinct()
    good = rows.join(bad, "doc_id", "left_anti")
    _upsert(spark, good, path, parts)
    return rows.join(bad, "doc_id", "left_semi").select("doc_id").distinct()


def delete_drafts(ids: DataFrame, path: str, parts: int = 64) -> None:
    """Deletes the drafts of ids (doc_id); ids without a draft are no fault."""
    spark = ids.sparkSession
    part = F.pmod(F.xxhash64(F.col("doc_id").cast("string")), F.lit(parts)).cast("int")
    _upsert(spark, ids.select("doc_id", F.lit(None).cast("string").alias("text"), part.alias("part")), path, parts)


def _upsert(spark: SparkSession, rows: DataFrame, path: str, parts: int) -> None:
    """New texts replace the old of their id; a null text deletes, by a row that drafts() leaves out."""
    rows = materialised(rows.dropDuplicates(["doc_id"]), "upsert")
    touched = [r.part for r in rows.select("part").distinct().collect()]  # at most parts
    if exists(spark, path) and touched:
        held = spark.read.parquet(path).where(F.col("part").isin(touched)).select("doc_id", "text", "part")
        rows = materialised(held.join(rows.select("doc_id"), "doc_id", "left_anti").unionByName(rows), "drafts-now")
    _replace(rows, path, "part")


def drafts(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path).where("text IS NOT NULL").select("doc_id", "text")


# Commits over several tables


class Commits:
    """Tables under one root, changed together: all of a commit's rows are seen, or none."""

    def __init__(self, spark: SparkSession, root: str, keys: dict[str, str]):
        self.spark, self.root, self.keys = spark, root.rstrip("/"), keys

    def entries(self) -> list[dict]:
        """The log's entries in order: number, id and the tables written."""
        fs, where = _fs(self.spark, f"{self.root}/log")
        if not fs.exists(where):
            return []
        names = sorted(f.getPath().getName() for f in fs.listStatus(where))
        rows = self.spark.read.text([f"{self.root}/log/{n}" for n in names if n.endswith(".json")]) if any(n.endswith(".json") for n in names) else None
        return sorted((json.loads(r.value) for r in rows.collect()), key=lambda e: e["number"]) if rows else []

    def identity(self, tables: dict[str, DataFrame]) -> str:
        """A hash of what a commit holds, whatever the order of its rows."""
        sums = []
        for name in sorted(tables):
            df = tables[name]
            h = F.xxhash64(*[F.col(c) for c in sorted(df.columns)])
            r = df.agg(F.count("*").alias("n"), F.coalesce(F.sum(h.cast("decimal(38,0)")), F.lit(0)).alias("s"), F.coalesce(F.bit_xor(h), F.lit(0)).alias("x")).first()
            sums.append((name, sorted(df.columns), r.n, int(r.s), r.x))
        return hashlib.sha256(repr(sums).encode()).hexdigest()

    def commit(self, tables: dict[str, DataFrame], attempts: int = 20) -> int:
        """Makes the tables' rows visible together and gives the entry's number.

        The rows replace those of their keys. What was committed last for all its keys already
        is not written again. A failure before the log entry leaves everything as it was.
        """
        if set(tables) - set(self.keys):
            raise ValueError("a table without a key")
        tables = {name: materialised(df, f"commit-{name}") for name, df in tables.items()}
        own = self.identity(tables)
        done = self.entries()
        if done and done[-1]["id"] == own:
            return done[-1]["number"]
        folder = f"{self.root}/data/{uuid.uuid4().hex}"
        for name, df in tables.items():
            df.write.parquet(f"{folder}/{name}")
        for _ in range(attempts):
            number = done[-1]["number"] + 1 if done else 1
            if self._log({"number": number, "id": own, "folder": folder, "tables": sorted(tables)}):
                return number
            done = self.entries()  # another commit took the number
        raise RuntimeError("no place in the log")

    def _log(self, entry: dict) -> bool:
        """Writes the entry beside the log, then renames it into place unless its number is taken."""
        fs, _ = _fs(self.spark, self.root)
        jvm = self.spark.sparkContext._jvm
        temp, place = (jvm.org.apache.hadoop.fs.Path(f"{self.root}/{p}") for p in (f"staged/{uuid.uuid4().hex}", f"log/{entry['number']:012d}.json"))
        fs.mkdirs(place.getParent())
        out = fs.create(temp)
        out.write(json.dumps(entry).encode())
        out.close()
        context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(temp.toUri() if temp.toUri().getScheme() else fs.getUri(), self.spark.sparkContext._jsc.hadoopConfiguration())
        if fs.exists(place):
            return False
        try:
            context.rename(temp, place, self.spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 0))
        except Exception as e:
            if "FileAlreadyExists" in str(e) or "already exists" in str(e):
                return False
            raise
        return True

    def read(self, table: str) -> DataFrame | None:
        """The table's rows as of the last entry: of each key those of its last commit; None if it was never written."""
        parts = [(e["number"], f"{e['folder']}/{table}") for e in self.entries() if table in e["tables"]]
        if not parts:
            return None
        rows = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), [self.spark.read.parquet(p).withColumn("__commit", F.lit(n)) for n, p in parts])
        key = self.keys[table]
        last = rows.groupBy(F.col(key).alias("__key")).agg(F.max("__commit").alias("__last"))
        return rows.join(last, F.col(key).eqNullSafe(F.col("__key"))).where("__commit = __last").drop("__commit", "__key", "__last")


# Indexes


def url_quoted(value: Column) -> Column:
    """Percent-encoded UTF-8; letters, digits and _.-~/ stay."""
    out = F.url_encode(value)
    for was, now in (("+", "%20"), ("*", "%2A"), ("%7E", "~"), ("%2F", "/")):
        out = F.replace(out, F.lit(was), F.lit(now))
    return out


def indexed(rows: DataFrame, indexes: DataFrame, head: str, foot: str, line: Column) -> DataFrame:
    """(subject, content): each subject's index with a line for each of its rows (subject, file_name, ...).

    A subject without an index (subject, content) gets ``head``, its lines and ``foot``. A row
    whose file name, plain or encoded, stands in the index adds none. New lines go before the
    first line that begins with ---, else at the end, in order of their file names; a subject
    without rows keeps its index.
    """
    named = rows.withColumn("__line", line).select("subject", "file_name", "__line").dropDuplicates(["subject", "file_name"])
    asked = named.groupBy("subject").agg(F.array_sort(F.collect_list(F.struct("file_name", "__line"))).alias("rows"))
    both = indexes.select("subject", "content").join(asked, "subject", "full_outer")
    content = F.coalesce("content", F.concat(F.lit(head), F.lit(foot)))
    fresh = F.filter(F.coalesce("rows", F.array().cast("array<struct<file_name:string,__line:string>>")), lambda r: ~F.contains(F.col("content"), r["file_name"]) & ~F.contains(F.col("content"), url_quoted(r["file_name"])))
    both = both.withColumn("content", content).withColumn("added", F.array_join(F.transform(fresh, lambda r: r["__line"]), ""))
    cut = F.regexp_extract("content", r"(?sm)^(.*?)(^[ \t]*---.*)$", 1)
    rest = F.regexp_extract("content", r"(?sm)^(.*?)(^[ \t]*---.*)$", 2)
    ends = F.when(F.col("content") == "", "").when(F.col("content").endswith("\n"), F.col("content")).otherwise(F.concat("content", F.lit("\n")))
    whole = F.when(rest == "", F.concat(ends, F.col("added"))).otherwise(F.concat(cut, F.col("added"), rest))
    return both.select("subject", F.concat(rewrite.table_spacing(whole), F.lit("\n")).alias("content"))
