"""Tables written to the folder that all executors share, to cut lineage and to read a result twice."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder in `spark.checkpoint.dir` with its file system; only for a local master may it be unset."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder and not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if not folder:
        folder = getattr(spark.sparkContext, "_weftline_shared", None)
        if folder is None:
            folder = "file://" + tempfile.mkdtemp(prefix="weftline-shared-")
            spark.sparkContext._weftline_shared = folder
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    return path.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(path).toString().rstrip("/")


def fresh_path(spark: SparkSession, name: str) -> str:
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    for paths in getattr(spark.sparkContext, "_weftline_collecting", []):
        paths.append(path)
    return path


@contextmanager
def collecting(spark: SparkSession) -> Iterator[list[str]]:
    """Lists the paths that operators called inside make, so that they can be removed when their results have been written."""
    paths: list[str] = []
    context = spark.sparkContext
    context._weftline_collecting = [*getattr(context, "_weftline_collecting", []), paths]
    try:
        yield paths
    finally:
        context._weftline_collecting = [x for x in context._weftline_collecting if x is not paths]


def remove(spark: SparkSession, paths: list[str]) -> None:
    """Deletes folders of the shared folder; those that are gone already do not matter. Empties the list."""
    while paths:
        path = spark._jvm.org.apache.hadoop.fs.Path(paths.pop())
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def stage(df: DataFrame, name: str) -> DataFrame:
    """Writes `df` as Parquet into the shared folder and reads it back."""
    spark = df.sparkSession
    path = fresh_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
