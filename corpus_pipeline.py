"""Training-corpus pipeline: language ID, quality, near-dedup, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as Parquet
below ``spark.checkpoint.dir`` and read again as the next stage's ``docs``.  All stages but
the last return the columns of ``documents``.  A stage fits its model on its own input."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tidemark.llm import bin_slack_packing, language_backoff, simhash_vptree, weak_label_quality
from tidemark.llm.common import materialize, table


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents without a determined language (no letters, or a posterior below 0.5)."""
    model = language_backoff.fit(docs, language_backoff.fold() != 2)
    return language_backoff.keep_identified(docs, model, min_score=0.5)


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents that the weakly labelled classifier rejects."""
    return weak_label_quality.keep_good(docs, weak_label_quality.fit(docs)[0])


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document of each group linked by SimHash (4-word shingles, 4 bits)."""
    return simhash_vptree.keep_first(docs, shingle=4, max_bits=4)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of at most 4096 tokens with their sequence and place."""
    return bin_slack_packing.pack_documents(docs)


STAGES = [("language_id", language_id), ("quality", quality), ("near_dedup", near_dedup), ("packing", packing)]

#: No stage's models can be written in SQL; tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir))
    return docs


def queries() -> dict:
    return {"pipeline": run}


def oracle_sql() -> dict:
    return {} if ORACLE_SQL is None else {"pipeline": ORACLE_SQL}
