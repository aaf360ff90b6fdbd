"""A corpus pipeline over `documents`: quality, near-dedup, secrets, mixing, tokens.

Each stage takes all rows its predecessor kept and returns a DataFrame with the columns of documents; the last adds
ids. Stages run over whole tables; where rows repeat, see the operators' own rules.

A stage's result has to be written before the next stage is called (as `run` does): each stage begins by removing what
the one before it has put into the shared folder. `close` removes what the last has left, when its result has been written, too.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from weftline.llm import mixing, pieces, quality, secrets, simhash
from weftline.llm.staging import collecting, remove, stage


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents that the quality rules reject."""
    return quality.keep_good(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document, the smallest id, of each group of near copies: five-word shingles, similarity 0.8 or more.

    Texts whose SimHash fingerprints are near meet at op5's anchors, those farther apart by min-hash keys; the similarity is the
    texts' exact Jaccard similarity.
    """
    return simhash.keep_one(docs, shingle=5)


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Masks every reported secret in the text."""
    return secrets.redact(docs)


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Takes each document as often as the mix of sources says."""
    return mixing.mixed_rows(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Adds the token ids of each text."""
    columns = [c for c in docs.columns if c != "ids"]
    return pieces.encode(docs, keep=tuple(columns)).select(*[f"`{c}`" for c in columns], "ids")


def close(spark: SparkSession) -> None:
    """Removes what the last stage called has put into the shared folder."""
    remove(spark, getattr(spark.sparkContext, "_corpus_pipeline_left", []))


def _tidy(step):
    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        close(spark)
        with collecting(spark) as left:
            found = step(spark, docs, sf_dir)
        spark.sparkContext._corpus_pipeline_left = left
        return found

    return run


STAGES = [
    ("quality_rules", _tidy(quality_rules)),
    ("near_dedup", _tidy(near_dedup)),
    ("secret_scan", _tidy(secret_scan)),
    ("source_mix", _tidy(source_mix)),
    ("tokens", _tidy(tokens)),
]

#: Components of near copies, the knapsack and byte-pair coding are beyond SQL; tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, inputs = spark.read.parquet(f"{sf_dir}/documents.parquet"), []
    for name, step in STAGES[:-1]:
        found, before = step(spark, docs, sf_dir), inputs
        with collecting(spark) as inputs:
            docs = stage(found, name)
        remove(spark, before)
    found = STAGES[-1][1](spark, docs, sf_dir)
    spark.sparkContext._corpus_pipeline_left += inputs
    return found
