"""Sharding (operator 7): consistent-hash ring with virtual nodes and bounded loads.

The ring is cut into ``CELLS`` equal cells.  Every shard owns ``VNODES`` virtual nodes, each
the start of a cell; the key of a document hashes to a cell and belongs to the first virtual
node clockwise.  A shard takes at most ``(1 + EPSILON)`` of the mean load; keys that find it
full go on clockwise to the next virtual node of a shard with room.  So sizes are balanced
by a fixed bound (law ``bytes``) and a new shard or a new document moves few keys.

All keys of one cell meet the same shards in the same order, so the loads per cell decide
everything: they are summed in Spark, and the walk round the ring needs only those at most
``CELLS`` sums.  It gives each cell the byte offsets at which its keys turn to the next
shard; a document goes by the middle of its bytes in its cell (running sums over one cell
and salt), so a shard exceeds its capacity by half a document at most.

Null text: no bytes, CRC of the empty text.  Null doc_id: one key, like any value.  The salt
takes in checksum and size, so a repeated or null id is spread by its texts.  Repeated rows get
slots of their own; rows that tie in all three columns are interchangeable.  Texts of any length
count whole.  Only the two named columns are read, so others may have any name.  An empty
table gives an empty result."""

from __future__ import annotations

import bisect

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.llm.common import materialize, table

SHARDS = 16
VNODES = 128
CELL_BITS = 14
CELLS = 1 << CELL_BITS
EPSILON = 1 / 1024


def _mix(x: int) -> int:
    """A 64-bit mix of an integer (the finaliser of splitmix)."""
    x = (x + 0x9E3779B97F4A7C15) & 0xFFFFFFFFFFFFFFFF
    x = (x ^ (x >> 30)) * 0xBF58476D1CE4E5B9 & 0xFFFFFFFFFFFFFFFF
    x = (x ^ (x >> 27)) * 0x94D049BB133111EB & 0xFFFFFFFFFFFFFFFF
    return x ^ (x >> 31)


def ring(shards: int, vnodes: int = VNODES, cells: int = CELLS) -> list[tuple[int, int]]:
    """(cell, shard) of the virtual nodes in ring order.  A node's place depends on its
    shard and number alone, so another shard leaves all other nodes where they are."""
    return sorted((_mix(shard * 1_000_003 + k) % cells, shard) for shard in range(shards) for k in range(vnodes))


def turns(loads: dict[int, int], shards: int, epsilon: float = EPSILON, vnodes: int = VNODES,
          cells: int = CELLS) -> list[tuple[int, int, int, int]]:
    """(cell, shard, from, to): the byte offsets of a cell that each shard takes.

    Cells are served in ring order.  A cell fills the shard of its first virtual node
    clockwise up to the capacity, then the next one's, and so on."""
    nodes = ring(shards, vnodes, cells)
    places = [c for c, _ in nodes]
    capacity = -(-int(sum(loads.values()) * (1 + epsilon)) // shards) + 1
    room, out = [capacity] * shards, []
    for cell in sorted(loads):
        at, load = bisect.bisect_left(places, cell), loads[cell]
        taken = 0
        for step in range(len(nodes)):
            shard = nodes[(at + step) % len(nodes)][1]
            part = min(room[shard], load - taken)
            if part > 0:
                room[shard] -= part
                out.append((cell, shard, taken, taken + part))
                taken += part
            if taken == load:
                break
    return out


def assign(rows: DataFrame, shards: int = SHARDS, epsilon: float = EPSILON, vnodes: int = VNODES,
           rows_per_salt: float = 20_000) -> DataFrame:
    """Add (shard, slot) to a table with doc_id, size (at least 1) and text_crc32."""
    spark = rows.sparkSession
    key = F.xxhash64(F.lit("ring"), F.col("doc_id").cast("string"))
    total = rows.count()
    # enough salts per cell that a window partition stays small at any input size
    salts = max(1, round(total / CELLS / rows_per_salt))
    placed = rows.select("*", F.shiftrightunsigned(key, 64 - CELL_BITS).cast("int").alias("rg_cell"),
                         F.pmod(F.xxhash64(key, "text_crc32", "size"), F.lit(salts)).cast("int").alias("rg_salt"))
    sums = materialize(placed.groupBy("rg_cell", "rg_salt").agg(F.sum("size").alias("rg_sum")))
    loads = {r[0]: r[1] for r in sums.groupBy("rg_cell").agg(F.sum("rg_sum")).collect()}  # at most CELLS rows
    plan = spark.createDataFrame(turns(loads, shards, epsilon, vnodes), "rg_c int, shard int, rg_from bigint, rg_to bigint")
    before = Window.partitionBy("rg_cell").orderBy("rg_salt").rowsBetween(Window.unboundedPreceding, -1)
    base = sums.select("rg_cell", "rg_salt", F.coalesce(F.sum("rg_sum").over(before), F.lit(0)).alias("rg_base"))
    running = (Window.partitionBy("rg_cell", "rg_salt").orderBy("doc_id", "text_crc32", "size")
               .rowsBetween(Window.unboundedPreceding, Window.currentRow))
    offset = placed.join(base, ["rg_cell", "rg_salt"]).withColumn(
        "rg_at", F.col("rg_base") + F.sum("size").over(running) - F.col("size") + F.floor(F.col("size") / 2))
    # one row per cell and shard that serves it: bounded by cells and shards
    chosen = materialize(offset.join(F.broadcast(plan), (F.col("rg_cell") == F.col("rg_c"))
                                     & (F.col("rg_at") >= F.col("rg_from")) & (F.col("rg_at") < F.col("rg_to")))
                         .select(*[offset[c] for c in rows.columns], "shard", "rg_cell", "rg_salt"))
    counts = chosen.groupBy("shard", "rg_cell", "rg_salt").agg(F.count("*").alias("rg_n"))
    # slots: groups of a shard in cell order; the offsets come in two levels, cells then salts
    per_cell = counts.groupBy("shard", "rg_cell").agg(F.sum("rg_n").alias("rg_cn"))
    cell_base = per_cell.select("shard", "rg_cell", F.coalesce(F.sum("rg_cn").over(
        Window.partitionBy("shard").orderBy("rg_cell").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("rg_b1"))
    salt_base = counts.select("shard", "rg_cell", "rg_salt", F.coalesce(F.sum("rg_n").over(
        Window.partitionBy("shard", "rg_cell").orderBy("rg_salt").rowsBetween(Window.unboundedPreceding, -1)),
        F.lit(0)).alias("rg_b2"))
    bases = salt_base.join(cell_base, ["shard", "rg_cell"])
    rank = F.row_number().over(Window.partitionBy("shard", "rg_cell", "rg_salt").orderBy("doc_id", "text_crc32", "size"))
    return (chosen.join(bases, ["shard", "rg_cell", "rg_salt"])
            .select(*rows.columns, "shard", (F.col("rg_b1") + F.col("rg_b2") + rank - 1).cast("bigint").alias("slot")))


def describe(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, size, text_crc32) of every row; size is the bytes of the text plus 1."""
    raw = F.coalesce(F.col(text_col), F.lit("")).cast("binary")
    return docs.select(F.col(id_col).alias("doc_id"), (F.octet_length(raw) + 1).cast("bigint").alias("size"),
                       F.crc32(raw).alias("text_crc32"))


def op7_bounded_ring(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = assign(materialize(describe(table(spark, sf_dir, "documents"))))
    return rows.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot",
                       F.lit(None).cast("int").alias("grown_shard"))


QUERIES = {"op7_bounded_ring": op7_bounded_ring}
ORACLE: dict[str, str] = {}
