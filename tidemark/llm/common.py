"""Helpers shared by the training-data operators: shared-folder tables, Arrow batches,
a bounded per-process interner of text chunks, and the stable row fraction."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.session import ensure_checkpoint_dir, ship_package

#: Bytes of text handled at once inside a task, distinct chunks that an interner keeps, and their bytes.
SLICE_BYTES = 8 << 20
INTERNER_LIMIT = 1_000_000
INTERNER_BYTES = 64 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def materialize(df: DataFrame) -> DataFrame:
    """Write ``df`` as Parquet below ``spark.checkpoint.dir`` and read it back: cuts the
    lineage in storage every executor sees, so a lost executor costs no recomputation."""
    spark = df.sparkSession
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/tidemark-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def map_arrow(df: DataFrame, run: Callable, schema) -> DataFrame:
    """``mapInArrow`` by workers that have this package."""
    ship_package(df.sparkSession)
    return df.mapInArrow(run, schema)


def stable_fraction(key: Column, fraction: float) -> Column:
    """True for about ``fraction`` of all keys, decided by the key alone."""
    return F.pmod(F.xxhash64(F.lit("sample"), key), F.lit(1 << 30)) < F.lit(int(fraction * (1 << 30)))


def raw_texts(column: pa.Array) -> list[bytes | None]:
    """UTF-8 bytes of a string column, without decoding them."""
    return column.cast(pa.binary()).to_pylist()


def slices(texts: list[bytes | None], budget: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Consecutive index ranges of at most about ``budget`` bytes of text each."""
    start = size = 0
    for i, t in enumerate(texts):
        size += len(t) if t else 0
        if size >= budget:
            yield start, i + 1
            start, size = i + 1, 0
    if start < len(texts):
        yield start, len(texts)


class Interner(dict):
    """chunk -> dense index; chunks met for the first time queue up in ``todo``."""

    def __init__(self) -> None:
        super().__init__()
        self.todo: list[bytes] = []
        self.nbytes = 0

    def __missing__(self, key: bytes) -> int:
        index = len(self)
        self[key] = index
        self.nbytes += len(key)
        self.todo.append(key)
        return index


_ACTIVE: list = [None, None]


def claim(key: object, build: Callable[[], object]) -> object:
    """The worker process's one live memo.  Python workers are reused between tasks, so the
    memo outlives a task; another key replaces it, which bounds the memory of a worker
    that serves several operators.  A memo changes speed only, never a result."""
    if _ACTIVE[0] != key:
        _ACTIVE[:] = [key, None]
        _ACTIVE[1] = build()
    return _ACTIVE[1]
