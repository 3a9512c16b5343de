"""Spark session defaults and the shared checkpoint folder.

The library never creates a session behind a caller's back: every operator takes
DataFrames.  ``get_spark`` is a convenience for tests, ``bench.py`` and scripts.
"""

from __future__ import annotations

import os
import tempfile
import zipfile

from pyspark.sql import SparkSession

# Settings every query in this package assumes.  UTC keeps TIMESTAMP_NTZ arithmetic
# and DuckDB comparisons aligned; AQE re-plans joins and coalesces partitions at run
# time; skew-join splitting handles a hot key holding a large share of the rows.
BASE_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
    "spark.sql.timestampType": "TIMESTAMP_NTZ",
}


def get_spark(master: str | None = None, shuffle_partitions: int | None = None,
              app_name: str = "tidemark", extra: dict | None = None) -> SparkSession:
    cpus = os.environ.get("BENCH_CPUS") or os.cpu_count() or 4
    master = master or f"local[{cpus}]"
    builder = SparkSession.builder.master(master).appName(app_name)
    conf = dict(BASE_CONF)
    conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions or int(cpus))
    conf.setdefault("spark.driver.memory", "16g")
    if extra:
        conf.update(extra)
    for k, v in conf.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ship_package(spark: SparkSession) -> None:
    """Give the Python workers this package, once per session: workers import the functions
    that operators hand to Arrow and pandas maps, and need not have it installed."""
    context = spark.sparkContext
    if getattr(context, "_tidemark_shipped", False):
        return
    root = os.path.dirname(os.path.abspath(__file__))
    fd, path = tempfile.mkstemp(prefix="tidemark-", suffix=".zip", dir=os.path.realpath(tempfile.gettempdir()))
    with os.fdopen(fd, "wb") as out, zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for folder, _, names in os.walk(root):
            for name in sorted(names):
                if name.endswith(".py"):
                    full = os.path.join(folder, name)
                    z.write(full, os.path.join("tidemark", os.path.relpath(full, root)))
    context.addPyFile(path)
    context._tidemark_shipped = True


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the cluster's shared checkpoint folder (``spark.checkpoint.dir``).

    On a cluster this setting names shared storage and is always read, never
    replaced.  Where it is unset, a session whose executors live in this one process
    (``local[...]``, as in tests) gets a scratch folder; a cluster session raises.
    """
    context = spark.sparkContext
    current = (spark.conf.get("spark.checkpoint.dir", None) or context.getConf().get("spark.checkpoint.dir", None)
               or context.getCheckpointDir())
    if not current:
        if not (context.master == "local" or context.master.startswith("local[")):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        current = tempfile.mkdtemp(prefix="tidemark-ckpt-")
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(current)
    return current


def cut_lineage(df):
    """Reliable checkpoint into the shared folder (survives executor loss)."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)
