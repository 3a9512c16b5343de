"""M9: oversampling of small classes by neighbour interpolation.

``class_neighbours`` finds the exact k nearest rows of the same class without comparing all
pairs.  Equal vectors collapse first (with their k + 1 least ids).  Rows go to the nearest of
``PIVOTS`` pivots of their class and are cut, by their distance to it, into blocks of about
``BLOCK`` rows.  A block gives each of its rows a first bound on the k-th distance; by the
triangle inequality only blocks whose ring of distances meets that bound are visited.  How
much that prunes depends on the data: spread-out vectors of many dimensions visit most blocks.
A Python worker holds a block, its visitors and about ``PIECE`` distances, however many rows there are.

Rows with a null class, id or vector, or a non-finite component, take no part; the vectors of
a class have one length.  Ids are unique.  Ties in distance go to the lower id.  Fewer than
k other rows give fewer neighbours; empty tables give empty results."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.functions.numeric import with_mix_uniform
from tidemark.plans.scan import global_row_number, ranged
from tidemark.session import cut_lineage, ship_package

PIVOTS = 64
BLOCK = 4096
PIECE = 1 << 20
SAMPLES = 65_536
MOST_CLASSES = 1000
SLACK = 1 + 1e-9
NEIGHBOURS = 5  # fixed value: reference default


def _distances(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Distances of all rows of x and y, from differences: equal rows are exactly 0 apart."""
    out = np.empty((len(x), len(y)))
    step = max(1, PIECE // max(1, y.size))
    for a in range(0, len(x), step):
        d = x[a:a + step, None, :] - y[None, :, :]
        out[a:a + step] = np.sqrt(np.einsum("ijk,ijk->ij", d, d))
    return out


def _nearest(uids: np.ndarray, x: np.ndarray, members: pd.DataFrame, k: int) -> pd.DataFrame:
    """(uid, id, distance): the k + 1 nearest ids among the members, copies and itself counted."""
    y, ids = np.stack(members["vector"].to_list()), members["ids"].to_list()
    owner = np.repeat(np.arange(len(ids)), [len(i) for i in ids])
    every = np.concatenate(ids)
    out, step = [], max(1, PIECE // len(every))
    for a in range(0, len(x), step):
        d = _distances(x[a:a + step], y)[:, owner]
        keep = min(k + 1, len(every))
        edge = np.partition(d, keep - 1, axis=1)[:, keep - 1:keep]
        q, m = np.nonzero(d <= edge)
        order = np.lexsort((every[m], d[q, m], q))
        q, m = q[order], m[order]
        first = np.arange(len(q)) - np.searchsorted(q, q) <= k
        q, m = q[first], m[first]
        out.append(pd.DataFrame({"uid": uids[a:a + step][q], "id": every[m], "distance": d[q, m]}))
    return pd.concat(out) if out else pd.DataFrame({"uid": [], "id": [], "distance": []})


def _visits(batches: Iterator[pd.DataFrame], pivots: dict, cells: dict, k: int) -> Iterator[pd.DataFrame]:
    """The rows with a bound on their k-th distance, the cells that may hold rows within it and the
    distances to the pivots of those: a row goes out once, whatever the number of cells."""
    for b in batches:
        for label, whole in b.groupby("label"):
            number, far, n = cells[label]
            at_pivots = pivots[label][number]
            step = max(1, PIECE // at_pivots.size)
            for a in range(0, len(whole), step):
                g = whole.iloc[a:a + step]
                d = _distances(np.stack(g["vector"].to_list()), at_pivots)
                reach = d + far  # every row of the cell lies within
                order = np.argsort(reach, axis=1)
                filled = np.cumsum(n[order], axis=1) > k
                at = np.where(filled.any(axis=1), filled.argmax(axis=1), 0)
                outer = np.take_along_axis(reach, np.take_along_axis(order, at[:, None], 1), 1)[:, 0]
                bound = np.minimum(g["bound"].to_numpy(), np.where(filled.any(axis=1), outer, np.inf)) * SLACK + 1e-12
                near = d - far <= bound[:, None]
                yield g.assign(bound=bound, cells=[number[m] for m in near], ds=[x[m] for x, m in zip(d, near)])


def class_neighbours(df: DataFrame, k: int = NEIGHBOURS, id_col: str = "row_id", vector_col: str = "vector",
                     class_col: str = "label") -> DataFrame:
    """(label, id, rank, neighbour, distance): the ``k`` nearest other rows of each row's class."""
    ship_package(df.sparkSession)
    rows = df.select(F.col(class_col).cast("string").alias("label"), F.col(id_col).cast("bigint").alias("id"),
                     F.col(vector_col).cast("array<double>").alias("vector"))
    finite = F.forall("vector", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < F.lit(float("inf"))))
    rows = rows.where(F.col("label").isNotNull() & F.col("id").isNotNull() & (F.size("vector") > 0) & finite)
    # the row-number limit is applied before the shuffle too, so copies do not gather
    least = rows.withColumn("_n", F.row_number().over(Window.partitionBy("label", "vector").orderBy("id"))).where(F.col("_n") <= k + 1)
    reps = cut_lineage(least.groupBy("label", "vector").agg(F.sort_array(F.collect_list("id")).alias("ids"))
                       .withColumn("uid", F.monotonically_increasing_id()))
    some = reps.withColumn("_n", F.row_number().over(Window.partitionBy("label").orderBy(F.xxhash64("uid")))).where(F.col("_n") <= PIVOTS)
    pivots: dict[str, np.ndarray] = {}
    if reps.select("label").distinct().limit(MOST_CLASSES + 1).count() > MOST_CLASSES:
        raise ValueError(f"more than {MOST_CLASSES} classes")
    for r in some.select("label", "vector").collect():  # at most PIVOTS rows a class
        pivots.setdefault(r["label"], []).append(r["vector"])
    pivots = {c: np.array(v) for c, v in pivots.items()}

    def assign(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for label, g in b.groupby("label"):
                d = _distances(np.stack(g["vector"].to_list()), pivots[label])
                yield g.assign(cell=d.argmin(axis=1), r=d.min(axis=1))

    total, parts = reps.count(), 2 * df.sparkSession.sparkContext.defaultParallelism
    fields = "label string, vector array<double>, ids array<bigint>, uid bigint"
    placed = reps.mapInPandas(assign, f"{fields}, cell bigint, r double")
    # the uid last, so that rows at one distance from their pivot are cut too; rings may share a border
    placed = ranged(placed, ["label", "cell", "r", "uid"], out="block", n=max(parts, total // BLOCK + 1))
    block = ["label", "cell", "block"]
    found = "uid bigint, id bigint, distance double"
    own = cut_lineage(placed.groupBy(*block).applyInPandas(
        lambda g: _nearest(g["uid"].to_numpy(), np.stack(g["vector"].to_list()), g, k), found))
    # distance that surely holds k + 1 ids, where the own block has as many
    bounds = own.groupBy("uid").agg(F.when(F.count("*") > k, F.max("distance")).otherwise(float("inf")).alias("bound"))
    rings = placed.groupBy(*block).agg(F.min("r").alias("lo"), F.max("r").alias("hi"))
    cells: dict[str, list] = {}
    for r in placed.groupBy("label", "cell").agg(F.max("r").alias("far"), F.sum(F.size("ids")).alias("n")).collect():  # as many as pivots
        cells.setdefault(r["label"], []).append((r["cell"], r["far"], r["n"]))
    cells = {c: tuple(np.array(v) for v in zip(*sorted(rows))) for c, rows in cells.items()}

    fields = "label string, vector array<double>, uid bigint, home bigint, bound double, mine bigint"
    asks = (placed.join(bounds, "uid").select("label", "vector", "uid", F.col("block").cast("bigint").alias("home"), "bound", F.col("cell").alias("mine"))
            .mapInPandas(lambda batches: _visits(batches, pivots, cells, k), f"{fields}, cells array<bigint>, ds array<double>"))
    asks = asks.select("label", "vector", "uid", "home", "bound", "mine", F.explode(F.arrays_zip("cells", "ds")).alias("_at"))
    asks = asks.withColumn("cell", F.col("_at.cells")).withColumn("d", F.col("_at.ds")).drop("_at")
    asks = asks.join(rings, ["label", "cell"]).where(
        (F.col("lo") - F.col("bound") <= F.col("d")) & (F.col("d") <= F.col("hi") + F.col("bound"))
        & ~((F.col("cell") == F.col("mine")) & (F.col("block") == F.col("home"))))
    asks = cut_lineage(asks.select(*block, "uid", "vector"))
    # a block that many rows visit is copied once per BLOCK visitors
    slices = asks.groupBy(*block).agg(F.ceil(F.count("*") / BLOCK).alias("slices"))
    asks = asks.join(slices, block).withColumn("slice", F.pmod(F.xxhash64("uid"), F.col("slices"))).drop("slices")
    hosts = placed.join(slices, block).withColumn("slice", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("slices") - 1)))
    hosts = hosts.select(*[F.col(c).alias(c) for c in (*block, "slice", "vector", "ids")])  # both sides stem from the same rows

    def visit(asked: pd.DataFrame, members: pd.DataFrame) -> pd.DataFrame:
        if not len(asked):
            return pd.DataFrame({"uid": [], "id": [], "distance": []})
        return _nearest(asked["uid"].to_numpy(), np.stack(asked["vector"].to_list()), members, k)

    other = asks.groupBy(*block, "slice").cogroup(hosts.groupBy(*block, "slice")).applyInPandas(visit, found)
    near = own.unionByName(other)
    near = near.withColumn("_n", F.row_number().over(Window.partitionBy("uid").orderBy("distance", "id"))).where(F.col("_n") <= k + 1)
    lists = near.groupBy("uid").agg(F.sort_array(F.collect_list(F.struct("distance", "id"))).alias("near"))
    named = rows.join(reps.join(lists, "uid").select("label", "vector", "near"), ["label", "vector"])
    others = F.slice(F.filter("near", lambda x: x["id"] != F.col("id")), 1, k)
    return (named.select("label", "id", F.posexplode(others).alias("_p", "_x"))
            .select("label", "id", (F.col("_p") + 1).cast("bigint").alias("rank"), F.col("_x.id").alias("neighbour"), F.col("_x.distance").alias("distance")))


def oversample(df: DataFrame, k: int = NEIGHBOURS, seed: int = 42, id_col: str = "row_id", vector_col: str = "vector",
               class_col: str = "label") -> DataFrame:
    """Synthetic rows (label, sample_no, base_id, neighbour_id, gap, vector) that bring every class
    to the size of the largest: base + gap * (neighbour - base), with base, neighbour and gap from
    hashed uniforms of (place of the class by name, sample number).  As in the reference, k is at most the smallest
    class's size less one; a class of one row raises."""
    rows = cut_lineage(df.select(F.col(class_col).cast("string").alias("label"), F.col(id_col).cast("bigint").alias("id"),
                                 F.col(vector_col).cast("array<double>").alias("vector"))
                       .where(F.col(class_col).isNotNull() & F.col(id_col).isNotNull() & F.col(vector_col).isNotNull()))
    sizes = rows.groupBy("label").agg(F.count("*").alias("n")).withColumn("_stream", F.row_number().over(Window.orderBy("label")))  # one row a class
    ends = sizes.agg(F.min("n").alias("lo"), F.max("n").alias("hi")).first()
    if ends["lo"] == 1:
        raise ValueError("a class of one row has no neighbour to interpolate with")
    k = min(k, (ends["lo"] or 2) - 1)
    wanted = sizes.where(F.col("n") < F.lit(ends["hi"])).withColumn("lacks", F.lit(ends["hi"]) - F.col("n"))
    # sample numbers in chunks, so that a class that lacks most rows is filled by many tasks
    chunk = F.explode(F.sequence(F.lit(0).cast("bigint"), F.expr(f"(lacks - 1) div {SAMPLES}")))
    wanted = wanted.select("*", chunk.alias("chunk")).repartition("label", "chunk")
    first = F.col("chunk") * SAMPLES
    wanted = wanted.select("label", "n", "_stream", F.explode(F.sequence(first, F.least(first + SAMPLES, F.col("lacks")) - 1)).alias("sample_no"))
    # stored between the draws: three hashes are too long for one generated method
    wanted = with_mix_uniform(cut_lineage(wanted), "_u", seed, "_stream", "sample_no")
    wanted = with_mix_uniform(cut_lineage(wanted), "_v", seed + 1, "_stream", "sample_no")
    wanted = with_mix_uniform(cut_lineage(wanted), "gap", seed + 2, "_stream", "sample_no")
    wanted = cut_lineage(wanted.select("label", "sample_no", (F.floor(F.col("_u") * F.col("n")) + 1).alias("rn"),
                                       (F.floor(F.col("_v") * k) + 1).alias("rank"), "gap"))
    base = global_row_number(rows, ["label"], ["id"]).select("label", "rn", F.col("id").alias("base_id"), F.col("vector").alias("x"))
    near = class_neighbours(rows, k, "id", "vector", "label").select("label", F.col("id").alias("base_id"), "rank", F.col("neighbour").alias("neighbour_id"))
    ends_ = rows.select("label", F.col("id").alias("neighbour_id"), F.col("vector").alias("y"))
    made = wanted.join(base, ["label", "rn"]).join(near, ["label", "base_id", "rank"]).join(ends_, ["label", "neighbour_id"])
    return made.select("label", "sample_no", "base_id", "neighbour_id", "gap",
                       F.zip_with("x", "y", lambda a, b: a + F.col("gap") * (b - a)).alias("vector"))
