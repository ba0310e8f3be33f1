"""Tables in the folder that driver and executors share: they cut lineage and survive lost executors."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir; in local mode, where it is unset, one of our own."""
    path = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("lectern.checkpoint.dir", None)
    if not path:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        path = tempfile.mkdtemp(prefix="lectern-")
        spark.conf.set("lectern.checkpoint.dir", path)
    return path.rstrip("/")


_made: list[str] = []


def scratch(spark: SparkSession) -> str:
    """A new path in the shared folder, which ``cleared`` removes with the tables."""
    path = f"{shared_dir(spark)}/lectern-{uuid.uuid4().hex}"
    _made.append(path)
    return path


def written(df: DataFrame) -> tuple[DataFrame, str]:
    """The frame written as a table in the shared folder and read again, and its path; this cuts the lineage."""
    spark = df.sparkSession
    path = scratch(spark)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path), path


def dropped(spark: SparkSession, *paths: str) -> None:
    """Removes tables made by ``written`` that nothing reads any more."""
    jvm = spark._jvm
    for path in paths:
        target = jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)
        if path in _made:
            _made.remove(path)


def cleared(spark: SparkSession) -> None:
    """Removes all tables that operators wrote in this process; for use when their results have been read."""
    dropped(spark, *list(_made))


def spread(df: DataFrame) -> DataFrame:
    """The rows of a scan over as many partitions as there are cores, where it has fewer splits: one row group is one task.

    A table of many splits, as any large one has, stays as it is.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df
