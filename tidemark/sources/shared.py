"""Working tables in the folder that executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``; a temporary one only for a local master without the setting."""
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    if spark.sparkContext.master.startswith("local") and not spark.sparkContext.master.startswith("local-cluster"):
        made = tempfile.mkdtemp(prefix="tidemark-")
        spark.conf.set("spark.checkpoint.dir", made)
        return made
    return spark.conf.get("spark.sql.warehouse.dir")


def stored(df: DataFrame, name: str, *, codec: str = "zstd") -> DataFrame:
    """``df`` written as Parquet in the shared folder and read back: what is lost later isn't recomputed.

    The files go when the driver's JVM ends, or earlier by :func:`discard`.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/tidemark/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", codec).parquet(path)
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(target)
    out = spark.read.schema(df.schema).parquet(path)
    out.stored_at = path
    return out


def folder(spark: SparkSession, name: str) -> str:
    """A new folder in the shared one, which goes when the driver's JVM ends."""
    path = f"{shared_dir(spark).rstrip('/')}/tidemark/{name}-{uuid.uuid4().hex}"
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    fs = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    fs.mkdirs(at)
    fs.deleteOnExit(at)
    return path


def discard(df: DataFrame) -> None:
    """Remove the files of a table that :func:`stored` gave, once nothing will read it again."""
    spark = df.sparkSession
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(df.stored_at)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)
