"""Session helpers shared by the whole library."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


#: Rows of an Arrow batch: with texts of 100 KB, a batch takes 100 MB at most.
ARROW_ROWS = 1024

#: Catalyst gives a size beyond any real one to what it cannot estimate.
UNKNOWN_BYTES = 1 << 55


def local_session(name: str = "weftline", cores: str = "*", **conf: str) -> SparkSession:
    """A local session with adaptive execution, UTC and few shuffle partitions."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(name)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "8g")
    )
    for key, value in conf.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def ship(spark: SparkSession) -> None:
    """Sends this package to the Python workers, once per Spark context, and bounds Arrow batches of long texts."""
    context = spark.sparkContext
    if int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) > ARROW_ROWS:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(ARROW_ROWS))
    if getattr(context, "_weftline_shipped", False):
        return
    package = Path(__file__).resolve().parent
    folder = tempfile.mkdtemp(prefix="weftline-")
    target = os.path.join(folder, "weftline.zip")
    with zipfile.ZipFile(target, "w") as out:
        for path in sorted(package.rglob("*.py")):
            out.write(path, path.relative_to(package.parent))
    context.addPyFile(target)
    context._weftline_shipped = True


def input_bytes(df: DataFrame, text: str = "text") -> int:
    """Catalyst's estimate of the bytes a filtered scan reads, without a job; of all other plans the texts are measured.

    A join's estimate is the product of its sides', which says nothing.
    """
    plan = df._jdf.queryExecution().optimizedPlan()
    known = int(str(plan.stats().sizeInBytes()))
    kinds = {line.lstrip(" :+-").split(" ")[0] for line in plan.treeString().splitlines()}
    if known < UNKNOWN_BYTES and kinds <= {"Filter", "Project", "Relation", "LogicalRelation", "RelationV2", "LocalRelation"}:
        return known
    return df.agg(F.coalesce(F.sum(F.octet_length(text)), F.lit(0))).first()[0]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def cut(df: DataFrame) -> DataFrame:
    """`df` without its lineage. The folder is the session's; only with a local master may it be unset."""
    context = df.sparkSession.sparkContext
    if not context.getCheckpointDir():
        folder = df.sparkSession.conf.get("spark.checkpoint.dir", None)
        if not folder and not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        context.setCheckpointDir(folder or tempfile.mkdtemp(prefix="weftline-graph-"))
    return df.checkpoint()


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the folder that driver and executors share; only with a local master may `spark.checkpoint.dir` be unset."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder and not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return f"{folder or tempfile.mkdtemp(prefix='weftline-')}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """`df` from files in the shared folder, for what is read several times: it is computed once, and each use reads its own columns."""
    spark = df.sparkSession
    path = scratch(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
