"""Cutting lineage by files that all executors share."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder that the cluster names in spark.checkpoint.dir. A temporary one is made only where driver and executors
    are one process, as in tests; anywhere else an unset folder is an error, for executors would not see each other's files."""
    if named := spark.conf.get("spark.checkpoint.dir", None):
        return named
    if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return tempfile.mkdtemp(prefix="spark-checkpoint-")


_OWN: dict[str, str] = {}


def cut(df: DataFrame, replaces: DataFrame | None = None) -> DataFrame:
    """The rows of `df`, computed once and kept as a written table in the shared folder.

    Unlike a checkpoint's, the sizes of a written table are known to the planner: in loops that join a state with itself
    estimates would otherwise be multiplied round by round. `replaces` names an earlier cut that nothing reads any more.
    """
    spark = df.sparkSession
    name = spark.sparkContext.applicationId
    if name not in _OWN:
        _OWN[name] = f"{shared_folder(spark)}/cut-{uuid.uuid4().hex}"
    path = f"{_OWN[name]}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._kept_at = path
    if replaces is not None:
        drop(replaces)
    return out


def drop(*cuts: DataFrame) -> None:
    """Deletes the tables of cuts that nothing reads any more."""
    for df in cuts:
        delete(df.sparkSession, df._kept_at)


def delete(spark: SparkSession, folder: str) -> None:
    """Deletes a folder of the shared store."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
