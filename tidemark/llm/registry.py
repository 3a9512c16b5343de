"""Queries of the training-data operators and their DuckDB twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tidemark.llm import (bin_slack_packing, bounded_ring, collision_projections, language_backoff, licence_digest,
                          merkle_manifest, periodic_runs, rule_ledger, secret_scan, sentencepiece_codec, simhash_vptree, url_sweep,
                          weak_label_quality)

QueryFn = Callable[[SparkSession, str], DataFrame]

MODULES = [weak_label_quality, url_sweep, simhash_vptree, language_backoff, rule_ledger,
           collision_projections, bounded_ring, licence_digest, sentencepiece_codec, bin_slack_packing,
           secret_scan, merkle_manifest, periodic_runs]


def queries() -> dict[str, QueryFn]:
    return {name: fn for m in MODULES for name, fn in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for m in MODULES for name, sql in m.ORACLE.items()}
