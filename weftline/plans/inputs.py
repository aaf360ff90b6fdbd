"""Inputs of the registered queries: tables of the domain, drawn from the driver's tables by SQL both engines run."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

BASE = {
    "messages": "SELECT conv_id AS conversation_id, turn AS ordinal, role, text AS content FROM {conversations}",
    "facts": """SELECT doc_id AS conversation_id, lang AS language, source AS project,
        CASE WHEN doc_id % 4 = 0 THEN 'rejected' WHEN doc_id % 4 = 1 THEN NULL ELSE 'accepted' END AS status,
        CASE WHEN n_chars > 3000 THEN 'hard' WHEN n_chars > 800 THEN 'medium' ELSE 'easy' END AS difficulty FROM {documents}""",
    "judged": """SELECT l_orderkey AS item, l_linenumber AS judge, l_linestatus AS split, l_orderkey % 97 AS run,
        CAST(1 + l_partkey % 5 AS DOUBLE) AS accuracy, CAST(1 + l_suppkey % 5 AS DOUBLE) AS fluency,
        CASE WHEN l_linenumber % 3 = 0 THEN NULL ELSE CAST(1 + l_orderkey % 5 AS DOUBLE) END AS tone,
        CASE l_returnflag WHEN 'R' THEN 'fail' WHEN 'A' THEN 'warn' ELSE 'pass' END AS verdict,
        CAST(l_quantity AS BIGINT) AS tokens FROM {lineitem}""",
    "scores": """SELECT item, judge, split, 'accuracy' AS axis, accuracy AS score FROM ({judged}) a
        UNION ALL SELECT item, judge, split, 'fluency', fluency FROM ({judged}) b
        UNION ALL SELECT item, judge, split, 'tone', tone FROM ({judged}) c WHERE tone IS NOT NULL""",
    "candidates": """SELECT o_orderkey AS seq, o_totalprice AS score, o_orderpriority AS cell,
        CASE WHEN o_custkey % 7 = 0 THEN NULL ELSE o_custkey END AS hash FROM {orders}""",
    # Every line is a call on one side at least: missing ones were expected only, extra ones predicted only.
    "sided": """SELECT *, CASE WHEN l_partkey % 7 = 0 THEN 'missing' WHEN l_linenumber > 5 THEN 'extra' ELSE 'both' END AS side FROM {lineitem}""",
    "expected": """SELECT l_orderkey AS row, l_orderkey % 3 AS turn, l_linenumber AS place, concat(l_returnflag, l_linestatus) AS name,
        CAST(l_partkey AS VARCHAR(20)) AS arguments FROM ({sided}) s WHERE side <> 'extra'""",
    "predicted": """SELECT l_orderkey AS row, l_orderkey % 3 AS turn, l_linenumber AS place,
        CASE WHEN l_suppkey % 5 = 0 THEN 'XX' ELSE concat(l_returnflag, l_linestatus) END AS name,
        CAST(l_partkey AS VARCHAR(20)) AS arguments FROM ({sided}) s WHERE side <> 'missing'""",
    "calls": """SELECT l_orderkey AS row, l_orderkey % 3 AS turn,
        CASE WHEN l_partkey % 7 = 0 THEN 'missing' WHEN l_partkey % 11 = 0 THEN 'extra' ELSE 'match' END AS type,
        (l_partkey % 7 <> 0 AND l_partkey % 11 <> 0 AND l_suppkey % 5 <> 0) AS func_match,
        l_linenumber % 4 AS correct, 3 AS total, CASE WHEN l_linenumber % 4 = 3 THEN 1.0 ELSE 0.5 END AS accuracy,
        0.25 * (l_linenumber % 5) AS similarity, l_orderkey % 13 = 0 AS api_failed FROM {lineitem}""",
    "jobs": """SELECT o_orderkey AS job_id, o_custkey % 50 AS run_id, CAST(floor(o_totalprice) AS BIGINT) AS tokens,
        CASE o_orderstatus WHEN 'F' THEN 'succeeded' WHEN 'O' THEN 'queued' ELSE 'failed' END AS status FROM {orders}""",
    "edges": """SELECT CAST(c_custkey AS BIGINT) AS source, CAST((c_custkey * 7 + 3) % n AS BIGINT) AS target, 0 AS place FROM {customer} CROSS JOIN (SELECT count(*) AS n FROM {customer}) k
        UNION ALL SELECT c_custkey, CAST((c_custkey * 3 + 11) % n AS BIGINT), 1 FROM {customer} CROSS JOIN (SELECT count(*) AS n FROM {customer}) l""",
    "all_edges": """SELECT CAST(c_custkey AS BIGINT) AS source, CAST((c_custkey * 7 + 3) % n AS BIGINT) AS target, 0 AS place FROM {customer} CROSS JOIN (SELECT count(*) AS n FROM {customer}) k
        UNION ALL SELECT c_custkey, CAST((c_custkey * 3 + 11) % n AS BIGINT), 1 FROM {customer} CROSS JOIN (SELECT count(*) AS n FROM {customer}) l
        UNION ALL SELECT CAST(c_nationkey AS BIGINT), c_custkey, 2 FROM {customer}""",
}


def sql_of(text: str) -> str:
    """The same query with inputs as subqueries and tables by their names, for DuckDB."""
    while names := re.findall(r"\{(\w+)\}", text):
        for name in names:
            text = text.replace("({" + name + "})", f"({BASE[name]})" if name in BASE else "({" + name + "})")
            text = text.replace("{" + name + "}", f"({BASE[name]})" if name in BASE else name)
    return text


def inputs(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    text = "{" + name + "}"
    while found := re.findall(r"\{(\w+)\}", text):
        for n in found:
            text = text.replace("({" + n + "})", f"({BASE[n]})") if n in BASE else text
            text = text.replace("{" + n + "}", f"({BASE[n]})" if n in BASE else f"parquet.`{sf_dir}/{n}.parquet`")
    return spark.sql(text[1:-1] if text.startswith("(") else f"SELECT * FROM {text}")
