"""Line dedup by levelled sorted runs of line hashes.

A line's key is the line with [\\x20\\x09-\\x0D] stripped at both ends and A-Z lower-cased; a
key is stored as two XXH64 values of different seeds. ``LineRuns`` is a levelled store: a
batch adds one sorted run (key, number of documents) to level 0; a level that holds
``fanout`` runs is merged into one run of the next level. Runs are tables bucketed and sorted
by key, so a batch merge-joins them without moving them.

Keys that reach ``settle_at`` documents leave the levels for settled runs. Each new batch is
merge-anti-joined with these, so that a line of a third of all documents is counted a few
times, not in every batch, and adds what is left of it as its own run.

Defined results: a null or empty text is one empty line; empty keys are never dropped; rows of
one id are one document, and rows without an id are none, but lose frequent lines like others;
every row is kept with its own lines; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fascicle.llm.common import ascii_lower, attach, broadcast_if_small, new_folder, written
from fascicle.llm.native import let

STRIP = " \t\n\x0b\f\r"
KEY = ["h1", "h2"]


def lines_of(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def line_key(line: Column) -> Column:
    return ascii_lower(F.btrim(line, F.lit(STRIP)))


def row_mark(text_col: str) -> Column:
    """What tells rows of one id apart: a hash of the text."""
    return F.xxhash64(F.coalesce(F.col(text_col).cast("string"), F.lit("")))


def line_keys(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = 1) -> DataFrame:
    """One row (id, mark, pos, h1, h2) for each line of docs whose key isn't too short."""
    keys = F.transform(lines_of(F.col(text_col)), line_key)
    hashed = F.transform(keys, lambda k, i: F.when(F.length(k) >= min_chars, F.struct(i.alias("pos"), F.xxhash64(k).alias("h1"), F.xxhash64(F.lit(1), k).alias("h2"))))
    each = F.explode(F.filter(hashed, lambda k: k.isNotNull())).alias("k")
    return docs.select(F.col(id_col).alias("id"), row_mark(text_col).alias("mark"), each).select("id", "mark", "k.*")


class LineRuns:
    """Levelled sorted runs of (h1, h2, df), kept in the shared folder."""

    def __init__(self, spark: SparkSession, fanout: int = 4, buckets: int | None = None, settle_at: int | None = None):
        self.spark, self.fanout, self.settle_at = spark, fanout, settle_at
        self.buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
        self.levels: list[list[str]] = []
        self.settled: list[str] = []

    def _write(self, counts: DataFrame) -> str:
        name = f"line_run_{uuid.uuid4().hex[:12]}"
        out = counts.repartition(self.buckets, *KEY).write.option("path", new_folder(self.spark, name))
        out.bucketBy(self.buckets, *KEY).sortBy(*KEY).saveAsTable(name)
        return name

    def _drop(self, names: list[str]) -> None:
        for name in names:
            self.spark.sql(f"DROP TABLE {name}")

    def _place(self, name: str, level: int) -> None:
        while len(self.levels) <= level:
            self.levels.append([])
        self.levels[level].append(name)

    def _merged(self, names: list[str]) -> DataFrame:
        """The runs merged: a full outer merge join of sorted runs, in which a key stands once."""
        rows = self.spark.table(names[0])
        for name in names[1:]:
            more = self.spark.table(name).withColumnRenamed("df", "df2")
            rows = rows.join(more, KEY, "full_outer").select(*KEY, (F.coalesce("df", F.lit(0)) + F.coalesce("df2", F.lit(0))).alias("df"))
        return rows

    def _settle(self, name: str) -> str:
        """Moves a run's keys of settle_at documents or more to a settled run; gives the run of the others."""
        run = self.spark.table(name)
        if self.settle_at is None or run.where(F.col("df") >= self.settle_at).isEmpty():
            return name
        self.settled.append(self._write(run.where(F.col("df") >= self.settle_at)))
        rest = self._write(run.where(F.col("df") < self.settle_at))
        self._drop([name])
        return rest

    def runs(self) -> list[str]:
        return [name for level in self.levels for name in level]

    def add(self, keys: DataFrame) -> None:
        """Adds a batch's keys (one row for each document that has the key) as a new run, without settled ones."""
        self._place(self._settle(self._write(self.unseen(keys, self.settled).groupBy(*KEY).agg(F.count("*").alias("df")))), 0)
        level = 0
        while len(self.levels[level]) >= self.fanout:
            old, self.levels[level] = self.levels[level], []
            self._place(self._settle(self._write(self._merged(old))), level + 1)
            self._drop(old)
            level += 1

    def unseen(self, keys: DataFrame, runs: list[str] | None = None) -> DataFrame:
        """The rows of keys that none of the runs (all of the levels) holds: one merge anti-join for each run."""
        for name in self.runs() if runs is None else runs:
            keys = keys.join(self.spark.table(name).select(*KEY).hint("merge"), KEY, "left_anti")
        return keys

    def frequent(self, min_docs: int) -> DataFrame:
        """The keys of min_docs documents or more; of a settled key, df is the number at which it settled."""
        rows = self._merged(self.runs()).where(F.col("df") >= min_docs)
        for name in self.settled:
            rows = rows.unionByName(self.spark.table(name))
        return rows

    def drop(self) -> None:
        self._drop(self.runs() + self.settled)
        self.levels, self.settled = [], []


def documents_of(keys: DataFrame) -> DataFrame:
    """(id, h1, h2) of line_keys(), once for each document: rows of one id are one, rows without one are none."""
    return keys.where("id IS NOT NULL").select("id", *KEY).distinct()


def frequent_lines(keys: DataFrame, min_docs: int, batches: int, fanout: int) -> DataFrame:
    """(h1, h2, rows) of keys (id, part, h1, h2) found in min_docs documents or more.

    The keys enter the runs part by part. ``rows`` is about the number of their lines: parts are
    chosen by a hash of the id, and a settled key was counted in some of them only.
    """
    store = LineRuns(keys.sparkSession, fanout, settle_at=min_docs)
    for b in range(batches):
        store.add(documents_of(keys.where(F.col("part") == b)))
    found = written(store.frequent(min_docs).select(*KEY, (F.col("df") * batches).alias("rows")), "frequent-lines")
    store.drop()
    return found


def drop_frequent_lines(docs: DataFrame, min_docs: int = 10, min_chars: int = 1, batches: int = 4, fanout: int = 3, id_col: str = "doc_id", text_col: str = "text", counts: bool = True) -> DataFrame:
    """docs with text_col rewritten, and with ``counts`` the columns n_lines, n_dropped (in place of any of their names).

    Keys found in at least min_docs documents lose all their lines. A second pass over the keys
    gives the places of dropped lines; texts are put together from the slices between these.
    """
    part = F.pmod(F.xxhash64("id"), F.lit(batches)).cast("int")
    keys = written(line_keys(docs, id_col, text_col, min_chars).withColumn("part", part), "line-keys")
    frequent = frequent_lines(keys, min_docs, batches, fanout)
    found = attach(keys.drop("part"), frequent, KEY, "rows", keys.count())
    dropped = found.groupBy(F.col("id").alias("__id"), F.col("mark").alias("__mark")).agg(F.array_sort(F.collect_set("pos")).alias("__dropped"))
    dropped = written(dropped, "dropped-lines")
    size = dropped.agg(F.count("*"), F.coalesce(F.sum(F.size("__dropped")), F.lit(0))).first()
    dropped = broadcast_if_small(dropped, 1, 256 * size[0] + 8 * size[1])
    own = [c for c in docs.columns if not counts or c not in ("n_lines", "n_dropped")]
    out = docs.select(*own).join(dropped, F.col(id_col).eqNullSafe(F.col("__id")) & (row_mark(text_col) == F.col("__mark")), "left")

    def between(v: Column) -> Column:
        starts, ends = F.concat(F.array(F.lit(-1)), v["gone"]), F.concat(v["gone"], F.array(F.size(v["lines"])))
        return F.flatten(F.zip_with(starts, ends, lambda a, b: F.slice(v["lines"], a + 2, b - a - 1)))

    lines = lines_of(F.col(text_col))
    kept = F.array_join(let(F.struct(lines.alias("lines"), F.col("__dropped").alias("gone")), between), "\n")
    rewritten = F.when(F.col("__dropped").isNull(), F.coalesce(F.col(text_col), F.lit(""))).otherwise(kept)
    if counts:
        out = out.withColumn("n_lines", F.size(lines).cast("long")).withColumn("n_dropped", F.coalesce(F.size("__dropped"), F.lit(0)).cast("long"))
        own += ["n_lines", "n_dropped"]
    return out.withColumn(text_col, rewritten).select(*own)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return drop_frequent_lines(docs).select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


SQL = r"""
WITH l AS (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos FROM documents),
k AS (SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
f AS (SELECT key FROM k WHERE length(key) >= 1 GROUP BY key HAVING count(DISTINCT doc_id) >= 10)
SELECT doc_id, count(*)::BIGINT AS n_lines, (count(*) FILTER (WHERE key IN (SELECT key FROM f)))::BIGINT AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE key NOT IN (SELECT key FROM f)), '')) AS kept_sha256
FROM k GROUP BY doc_id
"""
