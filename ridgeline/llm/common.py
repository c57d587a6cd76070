"""Helpers that several operators share: table access, shared scratch tables, row defaults."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor sees: spark.checkpoint.dir; on a local master, where all is one machine, else an own one."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="ridgeline-"))
        found = spark.sparkContext.getCheckpointDir()
    return found


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write df once as a Parquet table in the shared folder and read it back.

    Cuts lineage so that later stages (and lost executors) reread files instead of redoing Python
    passes. A plain write runs the plan once; DataFrame.checkpoint() would run its last stage twice.
    The table goes when the driver's JVM ends, or earlier by drop_table().
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    hadoop_path, fs = _fs(spark, path)
    fs.deleteOnExit(hadoop_path)
    out = spark.read.schema(df.schema).parquet(path)
    out._ridgeline_path = path
    return out


def drop_table(df: DataFrame) -> None:
    """Delete the files behind a materialised table that no later plan reads."""
    hadoop_path, fs = _fs(df.sparkSession, df._ridgeline_path)
    fs.delete(hadoop_path, True)


def join_hot(big: DataFrame, small: DataFrame, key: str, total: int, least: int = 10_000) -> DataFrame:
    """big JOIN small on key, without its column n: small has a row per key, n is the key's rows in big of ``total``.

    Keys with more than a thousandth of all rows, a thousand at most, are broadcast, so that their rows stay
    where they are; the others are shuffled.
    """
    if total <= least:
        return big.join(small.drop("n"), key)
    over = F.col("n") > max(least, total // 1000)
    hot = small.where(over).drop("n")
    rest = big.join(F.broadcast(hot.select(key)), key, "left_anti").join(small.where(~over).drop("n"), key)
    return rest.unionByName(big.join(F.broadcast(hot), key))


def _fs(spark: SparkSession, path: str):
    jvm = spark._jvm
    hadoop_path = jvm.org.apache.hadoop.fs.Path(path)
    return hadoop_path, hadoop_path.getFileSystem(spark._jsc.hadoopConfiguration())


def text_or_empty(column: str = "text") -> Column:
    """Null texts count as empty everywhere."""
    return F.coalesce(F.col(column), F.lit(""))
