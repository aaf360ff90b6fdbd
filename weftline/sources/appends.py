"""Sinks that a repeated write leaves as they are: appends by batch, and commits of several tables at once.

`append_once` gives each batch of a query a folder of its own, which a repetition of the batch writes over. `Commits`
puts rows into several tables and shows them by one manifest, which is there whole or not at all.
"""

from __future__ import annotations

import json
import logging
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

log = logging.getLogger(__name__)


def _path(spark: SparkSession, path: str):
    found = spark._jvm.org.apache.hadoop.fs.Path(path)
    return found, found.getFileSystem(spark._jsc.hadoopConfiguration())


def append_batch(rows: DataFrame, folder: str, query: str, batch: int, kind: str = "parquet") -> None:
    """Writes one batch of a query; the same batch again takes the place of what it wrote before."""
    rows.write.mode("overwrite").format(kind).save(f"{folder}/query={query}/batch={batch}")


def append_once(folder: str, query: str, kind: str = "parquet", never_fails: bool = False) -> Callable[[DataFrame, int], None]:
    """A function for `foreachBatch`: a batch that is tried again, after a failure anywhere, leaves its rows once.

    With `never_fails` an error is logged and the batch goes by (for logs and audits that must not stop the work).
    """

    def run(rows: DataFrame, batch: int) -> None:
        try:
            append_batch(rows, folder, query, batch, kind)
        except Exception:
            if not never_fails:
                raise
            log.exception("batch %s of %s could not be appended", batch, query)

    return run


def appended(spark: SparkSession, folder: str, schema: str, kind: str = "parquet") -> DataFrame:
    """All rows of whole batches, with query and batch; a batch whose write did not end is not read. No rows for a folder that is not there."""
    path, fs = _path(spark, folder)
    done = fs.globStatus(spark._jvm.org.apache.hadoop.fs.Path(path, "query=*/batch=*/_SUCCESS"))
    paths = [s.getPath().getParent().toString() for s in done or []]
    whole = T.StructType(T._parse_datatype_string(schema).fields + [T.StructField("query", T.StringType()), T.StructField("batch", T.LongType())])
    if not paths:
        return spark.createDataFrame([], whole)
    return spark.read.format(kind).schema(whole).option("basePath", folder).load(paths)


class Commits:
    """Rows of several tables under one root, visible together.

    A commit writes each table's rows into a folder of its own and then one manifest that names them all; the manifest
    is written aside and renamed, which fails if its number is taken, so two writers never take one number. What a writer leaves that
    fails before the rename is in no manifest and read by nobody. Manifests are small, one a commit.
    """

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def _numbers(self) -> list[int]:
        path, fs = _path(self.spark, f"{self.root}/manifests")
        listed = fs.globStatus(self.spark._jvm.org.apache.hadoop.fs.Path(path, "*.json")) or []
        return sorted(int(s.getPath().getName().split(".")[0]) for s in listed)

    def commit(self, tables: dict[str, DataFrame], name: str | None = None) -> int:
        """Adds rows to tables; the number of the commit. A commit with a name that is there already adds nothing."""
        if name is not None and (known := next((n for n, m in self.manifests().items() if m["name"] == name), None)) is not None:
            return known
        version = uuid.uuid4().hex
        folders = {}
        for table, rows in tables.items():
            folders[table] = f"{self.root}/data/{table}/{version}"
            rows.write.parquet(folders[table])
        return self._publish({"name": name, "tables": folders})

    def _publish(self, manifest: dict) -> int:
        jvm = self.spark._jvm
        aside, fs = _path(self.spark, f"{self.root}/manifests/.{uuid.uuid4().hex}")
        out = fs.create(aside, False)
        out.write(bytearray(json.dumps(manifest).encode()))
        out.close()
        context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(aside.toUri() if aside.isAbsolute() and aside.toUri().getScheme() else fs.getUri(), self.spark._jsc.hadoopConfiguration())
        kept = self.spark.sparkContext._gateway.new_array(getattr(jvm.org.apache.hadoop.fs, "Options$Rename"), 1)
        kept[0] = getattr(jvm.org.apache.hadoop.fs, "Options$Rename").NONE
        number = max(self._numbers(), default=0) + 1
        while True:
            target, _ = _path(self.spark, f"{self.root}/manifests/{number:012d}.json")
            try:
                context.rename(aside, target, kept)
                return number
            except Exception:
                if not fs.exists(target):
                    raise
                number += 1

    def manifests(self, upto: int | None = None) -> dict[int, dict]:
        """The manifests by number, up to one of them."""
        numbers = [n for n in self._numbers() if upto is None or n <= upto]
        paths = [f"{self.root}/manifests/{n:012d}.json" for n in numbers]
        if not paths:
            return {}
        rows = self.spark.read.text(paths, wholetext=True).select(F.col("_metadata.file_name").alias("file"), "value").collect()
        return {int(r.file.split(".")[0]): json.loads(r.value) for r in rows}

    def read(self, table: str, schema: str, upto: int | None = None) -> DataFrame:
        """All committed rows of a table, or those up to a commit, with the number of the commit."""
        listed = [(n, m["tables"][table]) for n, m in sorted(self.manifests(upto).items()) if table in m["tables"]]
        parts = [self.spark.read.schema(schema).parquet(p).withColumn("commit", F.lit(n)) for n, p in listed]
        if not parts:
            return self.spark.createDataFrame([], schema).withColumn("commit", F.lit(0)).limit(0)
        out = parts[0]
        for part in parts[1:]:
            out = out.unionAll(part)
        return out


CONVERSATION = "conversation_id long, run_id long, status string, tokens long"
MESSAGE = "conversation_id long, ordinal long, role string, content string"
VALIDATION = "conversation_id long, validator string, axis string, verdict string, score double"


def persist(commits: Commits, conversations: DataFrame, messages: DataFrame, validations: DataFrame, name: str | None = None) -> int:
    """Conversations with their messages and validations, in one commit. A conversation's status is rejected if a validation fails, else accepted."""
    fails = validations.groupBy("conversation_id").agg(F.bool_or(F.col("verdict") == "fail").alias("failed"))
    judged = conversations.join(fails, "conversation_id", "left")
    status = F.when(F.coalesce("failed", F.lit(False)), "rejected").otherwise("accepted")
    rows = judged.select("conversation_id", "run_id", status.alias("status"), "tokens")
    pick = lambda df, schema: df.select(*[F.col(f.name).cast(f.dataType) for f in T._parse_datatype_string(schema).fields])
    return commits.commit({"conversations": pick(rows, CONVERSATION), "messages": pick(messages, MESSAGE), "validations": pick(validations, VALIDATION)}, name)


def run_counters(commits: Commits, upto: int | None = None) -> DataFrame:
    """Rows (run_id, produced, accepted, tokens), of the committed conversations; there is no counter to keep in step."""
    rows = commits.read("conversations", CONVERSATION, upto)
    return rows.groupBy("run_id").agg(F.count("*").alias("produced"), F.count_if(F.col("status") == "accepted").alias("accepted"), F.coalesce(F.sum("tokens"), F.lit(0)).alias("tokens"))
