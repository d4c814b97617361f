"""Tables in the folder that the driver and all executors share: they cut lineage and outlive lost executors."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir; where it is unset, a temporary folder, in local mode only."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        if not spark.sparkContext.master.startswith("local") or "cluster" in spark.sparkContext.master:
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        found = f"file://{tempfile.mkdtemp(prefix='fascicle-core-')}"
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def materialised(df: DataFrame, name: str) -> DataFrame:
    """df as a written Parquet table, evaluated once; removed when the session's JVM ends."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/core-{uuid.uuid4().hex[:12]}-{name}"
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(where)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
