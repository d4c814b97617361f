"""Readers: files, transcripts, manifests, inventories of several payload shapes."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fascicle import schema

#: Bytes of a file that are read at a time.
BLOCK = 1 << 20


def files(spark: SparkSession, root: str, pattern: str = "*", hashes: bool = True) -> DataFrame:
    """(path, size, modified, sha256) of files below root; hidden parts are left out.

    Files that executors can open are hashed in reads of BLOCK bytes, whatever their size;
    others by Spark, which takes up to 2 GB each. Without ``hashes`` no content is read.
    """
    rows = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(root)
    rows = rows.where(~F.col("path").rlike(r"/\.[^/]"))
    own = ["path", F.col("length").alias("size"), F.col("modificationTime").alias("modified")]
    if not hashes:
        return rows.select(*own)
    if spark.sparkContext._jvm.org.apache.hadoop.fs.Path(root).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getScheme() != "file":
        return rows.select(*own, F.sha2("content", 256).alias("sha256"))

    def run(batches):
        import hashlib
        from urllib.parse import unquote, urlsplit

        for b in batches:
            digests = []
            for path in b.column(0).to_pylist():
                digest = hashlib.sha256()
                with open(unquote(urlsplit(path).path), "rb") as file:
                    while block := file.read(BLOCK):
                        digest.update(block)
                digests.append(digest.hexdigest())
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(digests, pa.string())], names=[*b.schema.names, "sha256"])

    listed = rows.select(*own)
    return listed.mapInArrow(run, listed.withColumn("sha256", F.lit("")).schema)


def transcripts(spark: SparkSession, root: str) -> DataFrame:
    """(name, text) of Markdown documents; indexes, drafts and hidden files are left out."""
    rows = spark.read.option("wholetext", True).option("pathGlobFilter", "*.md").option("recursiveFileLookup", True).text(root)
    rows = rows.select(F.col("_metadata.file_name").alias("name"), F.col("value").alias("text"))
    return rows.where(~F.col("name").rlike(r"^(?:Index|\.)|\.draft\.md$"))


def json_rows(spark: SparkSession, path: str, ddl: str) -> DataFrame:
    return spark.read.schema(ddl).option("multiLine", True).json(path)


def inventory(payloads: DataFrame, column: str = "payload") -> DataFrame:
    """remote_sources of JSON payloads of any shape that payloads.entries() knows; a source's own notebook counts."""
    from fascicle.sources import payloads as shapes

    rows = shapes.entries(payloads.withColumn("__none", F.lit(None).cast("string")), "__none", column).where("place IS NOT NULL")
    s = F.col("source")
    out = rows.select(
        shapes.first_text(s, ("source_id", "id")).alias("source_id"), F.btrim(shapes.first_text(s, shapes.TITLES)).alias("title"), shapes.first_text(s, ("notebook_uuid",)).alias("notebook_uuid"),
        shapes.first_text(s, shapes.HASHES).alias("content_hash"), shapes.status(s).alias("status"),
    )
    return out.where("title <> ''")


def pages(texts: DataFrame, path_col: str = "path", text_col: str = "text") -> DataFrame:
    """(path, page, text) of extracted texts, cut at form feeds."""
    return texts.select(path_col, F.posexplode(F.split(F.col(text_col), "\f")).alias("at", "text")).select(path_col, (F.col("at") + 1).alias("page"), "text")


def local_sources(spark: SparkSession, root: str) -> DataFrame:
    """An automatic manifest: every file with its role, all actions auto."""
    from fascicle.operators.match import classify_role

    rel = F.regexp_replace("path", rf"^.*?{root.rstrip('/').split('://')[-1]}/", "")
    rows = files(spark, root).withColumn("relative_path", rel)
    return rows.select("relative_path", F.regexp_extract("relative_path", "([^/]*)$", 1).alias("name"), classify_role(F.col("relative_path")).alias("role"), F.lit("auto").alias("preparation_action"), F.array("sha256").alias("hashes"), "size")


__all__ = ["files", "inventory", "json_rows", "local_sources", "pages", "schema", "transcripts"]
