"""Sources: conversation files, JSON-in-string rows, checkpoints, model lists, JDBC tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from weftline.functions.text import html_text, tidy

MESSAGE = "struct<role:string,content:string,tool_calls:array<struct<id:string,type:string,function:struct<name:string,arguments:string>>>,tool_call_id:string,name:string>"
CONVERSATION = f"conversation_id string, workflow_name string, domain string, messages array<{MESSAGE}>, metadata variant"


def conversation_files(spark: SparkSession, folder: str) -> DataFrame:
    """One JSON file per conversation; files that cannot be read or lack messages are left out; numeric names first."""
    rows = spark.read.schema(CONVERSATION).option("multiLine", True).option("mode", "PERMISSIVE").json(folder)
    name = F.regexp_extract(F.col("_metadata.file_name"), r"^(.*)\.json$", 1)
    return rows.withColumns({"file": name, "file_number": name.try_cast("int")}).where("messages IS NOT NULL").orderBy(F.asc_nulls_last("file_number"), "file")


def string_rows(spark: SparkSession, path: str, max_rows: int | None = None, split: str = "split", order: str = "row_idx") -> DataFrame:
    """All-strings rows with messages and functions parsed; rows with bad JSON go, functions without a name too."""
    rows = spark.read.parquet(path)
    if max_rows is not None:
        rows = rows.withColumn("__n", F.row_number().over(W.partitionBy(split).orderBy(order))).where(F.col("__n") <= max_rows).drop("__n")
    return parse_string_rows(rows)


def parse_string_rows(rows: DataFrame, messages: str = "messages", functions: str = "functions") -> DataFrame:
    parsed = rows.withColumns({"messages": F.from_json(messages, f"array<{MESSAGE}>"), "functions": F.from_json(functions, "array<struct<name:string,description:string,stage:string,returns:string>>")})
    named = F.filter(F.coalesce("functions", F.array().cast("array<struct<name:string,description:string,stage:string,returns:string>>")), lambda f: F.coalesce(f["name"], F.lit("")) != "")
    return parsed.where("messages IS NOT NULL AND size(messages) > 0").withColumn("functions", named)


def checkpoint_lines(spark: SparkSession, path: str) -> DataFrame:
    """JSON lines keyed by conversation_id: the last line of each wins, bad lines are ignored.

    Last is by the files' times, then their names, then the place in the file; within a file's part, lines keep their order.
    """
    at = F.struct("_metadata.file_modification_time", "_metadata.file_name", "_metadata.file_block_start", F.monotonically_increasing_id().alias("line"))
    lines = spark.read.text(path).select(F.try_parse_json("value").alias("v"), at.alias("at"))
    lines = lines.select(F.try_variant_get("v", "$.conversation_id", "string").alias("conversation_id"), "v", "at").where("conversation_id IS NOT NULL")
    return lines.groupBy("conversation_id").agg(F.max_by(F.to_json("v"), "at").alias("line"))


def model_list(spark: SparkSession, path: str) -> DataFrame:
    """Names in a text file, without blank lines and comments."""
    return spark.read.text(path).select(F.trim("value").alias("model")).where("model <> '' AND NOT startswith(model, '#')")


def jdbc_table(spark: SparkSession, url: str, query: str, key: str | None = None, low: int = 0, high: int = 1, parts: int = 8, **options: str) -> DataFrame:
    """A table or query over JDBC, read in parallel ranges of a numeric key where one is named."""
    reader = spark.read.format("jdbc").option("url", url).options(**options)
    if key is None:
        return reader.option("query", query).load()
    reader = reader.option("dbtable", f"({query}) AS q").option("partitionColumn", key)
    return reader.option("lowerBound", low).option("upperBound", high).option("numPartitions", parts).load()


def libraries(rows: DataFrame) -> DataFrame:
    """`rows` with JSON columns of libraries made sound: shared_entities is a JSON object, `{}` where it is none; functions is an array, `[]` where it is none."""
    kind = lambda c: F.coalesce(F.schema_of_variant(F.try_parse_json(c)), F.lit(""))
    return rows.withColumns({
        "shared_entities": F.when(kind("shared_entities").startswith("OBJECT"), F.col("shared_entities")).otherwise("{}"),
        "functions": F.when(kind("functions").startswith("ARRAY"), F.col("functions")).otherwise("[]"),
    })


def library_pairs(rows: DataFrame) -> DataFrame:
    """Rows (row_idx, conversation_id, library, messages) from rows of strings (row_idx, conversation_id, workflow, domain, shared_entities, functions, messages).

    library is a JSON object of the row's own library; a row whose messages are no JSON array, or an empty one, is passed over. Without a
    conversation_id it is the workflow and row_idx, with a hyphen; a null workflow is `workflow`.
    """
    sound = libraries(rows).where(F.coalesce(F.schema_of_variant(F.try_parse_json("messages")).startswith("ARRAY"), F.lit(False)) & (F.coalesce(F.json_array_length("messages"), F.lit(0)) > 0))
    string = lambda c: F.regexp_extract(F.to_json(F.struct(F.coalesce(c, F.lit("")).alias("v"))), r'(?s)^\{"v":(.*)\}$', 1)
    library = F.concat(F.lit('{"domain":'), string(F.col("domain")), F.lit(',"workflow":'), string(F.col("workflow")), F.lit(',"shared_entities":'), "shared_entities", F.lit(',"functions":'), "functions", F.lit("}"))
    made = F.concat_ws("-", F.coalesce("workflow", F.lit("workflow")), F.col("row_idx").cast("string"))
    return sound.select("row_idx", F.when(F.coalesce("conversation_id", F.lit("")) == "", made).otherwise(F.col("conversation_id")).alias("conversation_id"), library.alias("library"), "messages")


def file_kind(name: Column, mime: Column) -> Column:
    """pdf, docx, html or txt by the media type or else the name's ending; null for others."""
    mime, name = F.lower(F.coalesce(mime, F.lit(""))), F.lower(F.coalesce(name, F.lit("")))
    return (
        F.when((mime == "application/pdf") | name.endswith(".pdf"), "pdf").when(mime.contains("wordprocessingml") | name.endswith(".docx"), "docx")
        .when(mime.startswith("text/html") | name.endswith(".html") | name.endswith(".htm"), "html")
        .when(mime.startswith("text/") | name.endswith(".txt") | name.endswith(".md"), "txt")
    )


def file_texts(files: DataFrame, most_bytes: int = 10 << 20) -> DataFrame:
    """Rows (name, kind, status, text) from files (name, mime, content as bytes), such as `binaryFile` reads.

    status is ok, too_large (beyond `most_bytes`), unsupported (pdf, docx and unknown kinds) or empty (no text, or null content); text only where it is ok.
    """
    kind, size = file_kind(F.col("name"), F.col("mime")), F.octet_length("content")
    raw = F.decode("content", "UTF-8")
    text = F.when(kind == "html", html_text(raw)).otherwise(tidy(raw))
    rows = files.select("name", kind.alias("kind"), F.when(size > most_bytes, "too_large").when(F.coalesce(~kind.isin("html", "txt"), F.lit(True)), "unsupported").otherwise("ok").alias("status"), text.alias("text"))
    status = F.when((F.col("status") == "ok") & (F.coalesce("text", F.lit("")) == ""), "empty").otherwise(F.col("status"))
    return rows.select("name", "kind", status.alias("status"), F.when(status == "ok", F.col("text")).alias("text"))
