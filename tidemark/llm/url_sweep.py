"""URL filters (operator 2): sort-merge range join of URLs and prefix rules.

A host is keyed by its labels in reverse, each closed by a separator (``a.example.com`` ->
``com\\x01example\\x01a\\x01``), so a host and all its subdomains are one interval of keys, and
the intervals of any two rules are nested or apart.  URLs are cut into ranges of (key,
salt); a rule goes to every range its interval meets, so a range is complete in itself.
Each range is sorted by key, rules before the URLs they cover, and swept once: a stack
holds the rules whose interval is open, innermost last; every URL tests its path against
the paths of the open rules, and the longest rule that fits (host plus path characters, the
longer host on a tie) decides.

The salt is a hash of the page id, so one URL or host may fill many ranges.  The range
borders are quantiles of a bounded sample and only steer the balance.

Null url or no ``://``: empty host and path, no rule, the default verdict.  URLs are taken
whole, whatever their length.  Only the named columns are read, so others may have any name.
Repeated rows give equal rows; an empty table gives an empty result."""

from __future__ import annotations

import bisect
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import map_arrow, stable_fraction, table

#: (verdict, host, path)
RULES = [("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"),
         ("block", "net", "/es/"), ("block", "net", "/fr/")]
DEFAULT = "allow"
SAMPLE = 10_000
RANGE_ROWS = 200_000
SEP = "\x01"

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_and_path(url: Column) -> tuple[Column, Column]:
    rest = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://(.*)$", 1)
    host = F.translate(F.regexp_extract(rest, r"^([^/?#]*)", 1), _UPPER, _LOWER)
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    return host, F.when(path.startswith("/"), path).otherwise(F.lit(""))


def host_key(host: Column) -> Column:
    """Labels in reverse order, each closed by the separator; the empty host is the empty key."""
    return F.when(host == "", F.lit("")).otherwise(
        F.concat(F.array_join(F.reverse(F.split(host, r"\.")), SEP), F.lit(SEP)))


def python_key(host: str) -> str:
    return "".join(label + SEP for label in reversed(host.split("."))) if host else ""


def _borders(urls: DataFrame, rows: int, ranges: int) -> list[tuple[str, int]]:
    """Range borders (key, salt) from about ``SAMPLE`` rows chosen by hash (at most twice as many
    leave the tasks, however many tasks there are)."""
    chosen = urls.select("key", "salt").where(stable_fraction(F.col("salt"), min(1.0, 2 * SAMPLE / max(rows, 1))))
    sample = sorted((r[0], r[1]) for r in chosen.orderBy("salt", "key").limit(SAMPLE)
                    .select("key", F.xxhash64("salt").alias("salt")).collect())
    cuts = [sample[len(sample) * k // ranges] for k in range(1, ranges)] if sample else []
    return sorted(set(cuts))


def _sweep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by (range, key, kind): kind 0 opens a rule, kind 1 is a URL."""
    stack: list[tuple[str, str, str, str, int, str]] = []  # key, path, rule, verdict, length, host
    current = None
    for batch in batches:
        at = batch.column(0).to_pylist()
        keys, kinds, paths, rules, verdicts, hosts = (batch.column(k).to_pylist() for k in (1, 2, 4, 5, 6, 7))
        pick, rule_out, verdict_out = [], [], []
        for i, key in enumerate(keys):
            if at[i] != current:
                current, stack = at[i], []
            while stack and not key.startswith(stack[-1][0]):
                stack.pop()
            if kinds[i] == 0:
                stack.append((key, paths[i], rules[i], verdicts[i], len(rules[i]), hosts[i]))
                continue
            best, host = None, hosts[i]
            for entry in stack:
                if (paths[i].startswith(entry[1]) and (best is None or entry[4] >= best[4])
                        and (host == entry[5] or host.endswith("." + entry[5]))):
                    best = entry
            pick.append(i)
            rule_out.append(best[2] if best else None)
            verdict_out.append(best[3] if best else None)
        rows = pa.array(pick, pa.int64())
        yield pa.RecordBatch.from_arrays(
            [batch.column(3).take(rows), batch.column(7).take(rows), batch.column(4).take(rows),
             pa.array(rule_out, pa.string()), pa.array(verdict_out, pa.string())],
            names=["page_id", "host", "path", "rule", "verdict"])


def judge(pages: DataFrame, rules: list[tuple[str, str, str]], default: str = DEFAULT, ranges: int | None = None,
          id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """(page_id, host, path, rule, verdict) of every row of ``pages``."""
    spark = pages.sparkSession
    id_type = pages.schema[id_col].dataType.simpleString()
    narrow = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"))
    host, path = host_and_path(F.col("url"))
    urls = (narrow.select("page_id", host.alias("host"), path.alias("path"))
            .select("page_id", "host", "path", host_key(F.col("host")).alias("key"),
                    F.xxhash64(F.col("page_id").cast("string"), "path").alias("salt")))
    rows = urls.count()
    if ranges is None:
        ranges = max(spark.sparkContext.defaultParallelism, -(-rows // RANGE_ROWS))
    borders = _borders(urls, rows, ranges)

    def place(keys, salts):
        return [bisect.bisect_right(borders, (k, s)) for k, s in zip(keys, salts)]

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            salts = batch.column(4).to_numpy()
            at = place(batch.column(3).to_pylist(), salts.tolist())
            n = len(batch)
            yield pa.RecordBatch.from_arrays(
                [pa.array(at, pa.int32()), batch.column(3), pa.array(np.ones(n, np.int32)), batch.column(0),
                 batch.column(2), pa.nulls(n, pa.string()), pa.nulls(n, pa.string()), batch.column(1)],
                names=["at", "key", "kind", "page_id", "path", "rule", "verdict", "host"])

    schema = f"at int, key string, kind int, page_id {id_type}, path string, rule string, verdict string, host string"
    mixed = urls.transform(map_arrow, number, schema).union(_rule_rows(spark, rules, borders, schema))
    # one partition per range; the rules of a range are the ones whose interval meets it
    swept = (mixed.repartitionByRange(len(borders) + 1, "at").sortWithinPartitions("at", "key", "kind", F.length("rule"))
             .transform(map_arrow, _sweep, f"page_id {id_type}, host string, path string, rule string, verdict string"))
    return swept.withColumn("verdict", F.coalesce("verdict", F.lit(default)))


def _rule_rows(spark: SparkSession, rules: list[tuple[str, str, str]], borders: list[tuple[str, int]], schema: str) -> DataFrame:
    low, high = -(1 << 63), (1 << 63) - 1
    rows = []
    for verdict, host, path in rules:
        key = python_key(host)
        first = bisect.bisect_right(borders, (key, low))
        last = bisect.bisect_right(borders, (key + "\U0010ffff", high))
        rows += [(at, key, 0, None, path, host + path, verdict, host) for at in range(first, last + 1)]
    return spark.createDataFrame(rows, schema)


def op2_url_sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(table(spark, sf_dir, "pages"), RULES)


ORACLE_SQL = r"""
WITH p AS (SELECT page_id, regexp_extract(coalesce(url, ''), '(?s)^.*?://(.*)$', 1) AS rest FROM pages),
h AS (SELECT page_id, translate(regexp_extract(rest, '^([^/?#]*)', 1),
             'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
             regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM p),
r(verdict, rhost, rpath) AS (VALUES ('allow', 'com', '/'), ('block', 'example.com', '/en/'),
     ('allow', 'www.example.com', '/en/'), ('block', 'net', '/es/'), ('block', 'net', '/fr/')),
n AS (SELECT row_number() OVER () AS k, * FROM h),
j AS (SELECT n.k, n.page_id, n.host, n.path, r.rhost || r.rpath AS rule, r.verdict,
             row_number() OVER (PARTITION BY n.k ORDER BY length(r.rhost || r.rpath) DESC NULLS LAST,
                                length(r.rhost) DESC) AS rk
      FROM n LEFT JOIN r ON (n.host = r.rhost OR ends_with(n.host, '.' || r.rhost)) AND starts_with(n.path, r.rpath))
SELECT page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict FROM j WHERE rk = 1
"""

QUERIES = {"op2_url_sweep": op2_url_sweep}
ORACLE = {"op2_url_sweep": ORACLE_SQL}
