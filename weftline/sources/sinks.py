"""Sinks: JSON lines, all-strings Parquet, Markdown tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.operators.datasets import write_chat_lines

__all__ = ["markdown_table", "write_chat_lines", "write_records", "write_string_rows"]


def write_string_rows(rows: DataFrame, path: str) -> None:
    """Every column as a string: strings as they are, all else as JSON."""
    kept = [F.col(f.name) if f.dataType.simpleString() == "string" else F.to_json(F.struct(f.name)).alias(f.name) for f in rows.schema]
    rows.select(*[k if rows.schema[i].dataType.simpleString() == "string" else F.regexp_extract(k, r'(?s)^\{"[^"]*":(.*)\}$', 1).alias(rows.columns[i]) for i, k in enumerate(kept)]).write.parquet(path)


def write_records(records: DataFrame, path: str) -> None:
    records.select("record").write.text(path)


def markdown_table(rows: DataFrame, order: str, limit: int = 100) -> str:
    """The best rows by a column as a Markdown table: a report of bounded length."""
    top = rows.orderBy(F.desc(order)).limit(limit).collect()
    head = ["| " + " | ".join(rows.columns) + " |", "|" + "---|" * len(rows.columns)]
    return "\n".join(head + ["| " + " | ".join("—" if v is None else f"{v:.3f}" if isinstance(v, float) else str(v) for v in r) + " |" for r in top])
