"""Embedding near-dedup (operator 6): collision-counting projections.

Unit vectors are projected on ``PROJECTIONS`` random directions.  Two vectors with the
threshold cosine differ by a known normal law in every projection, so a window centred on
the query of ``WINDOW`` standard deviations of that law catches a linked pair with known
probability, and the count of windows it must pass is calibrated to ``RECALL``.

Equal vectors collapse to one weighted class first.  Pairs are proposed by several grids: a
grid cuts the sorted axes of its own few projections into intervals of ``INTERVAL`` at a random
shift, and vectors that share all intervals meet.  How many projections a grid takes follows the
number of vectors and the spread of a bounded sample of them, so that a vector meets about
``MEETS`` others in a grid at any size; how many grids there are follows from ``GRID_RECALL``.
A pair counts in the first grid that holds it.  In a cell the pairs pass the
count of windows over all projections, then the cosine in double precision.  Members of a cell are kept
in chunks of ``CHUNK`` and those of other chunks stream past, so a dense group is never whole
in one task; a cell returns link counts per vector and its groups as stars, never the pairs.

Null, empty and zero vectors and those with null or non-finite components link with
nothing; vectors of different length never link.  A null vec_id keeps its row; the
component id is the least non-null vec_id.  Repeated rows count as other vectors.  An empty
table gives an empty result.  Ties do not matter; vectors of any length are taken whole; only
the two named columns are read, so others may have any name."""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import map_arrow, materialize, table
from tidemark.llm.components import Forest, components

COSINE = 0.95
PROJECTIONS = 24
WINDOW = 2.576
RECALL = 0.999
INTERVAL = 2.0
GRID_RECALL = 0.995
MEETS = 512
MOST_AXES = 20
SAMPLE = 512
CHUNK = 16_384
SMALL_TABLE = 100_000
SALTS = 32
SEED = 20_011


def window_width(cosine: float, sigmas: float = WINDOW) -> float:
    """Half width of the window for directions with standard normal components."""
    return sigmas * math.sqrt(2 - 2 * cosine)


def least_count(projections: int, sigmas: float = WINDOW, recall: float = RECALL) -> int:
    """Largest count that a pair at the threshold reaches with probability ``recall``."""
    p, total = math.erf(sigmas / math.sqrt(2)), 0.0
    for k in range(projections, -1, -1):
        total += math.comb(projections, k) * p ** k * (1 - p) ** (projections - k)
        if total >= recall:
            return k
    return 0


@lru_cache(maxsize=8)
def directions(dim: int, projections: int = PROJECTIONS) -> np.ndarray:
    return np.random.default_rng([SEED, dim]).standard_normal((dim, projections))


def same_interval(distance: np.ndarray | float) -> np.ndarray | float:
    """Probability that two points this far apart share an interval of a random projection."""
    x = INTERVAL / np.maximum(distance, 1e-9)
    beyond = np.vectorize(math.erfc)(x / math.sqrt(2))
    return 1 - beyond - math.sqrt(2 / math.pi) / x * (1 - np.exp(-x * x / 2))


def grid_shape(n: int, distances: np.ndarray, cosine: float) -> tuple[int, int]:
    """(projections of a grid, grids) for ``n`` vectors; ``distances``: of sampled pairs without a link."""
    apart = same_interval(distances if len(distances) else np.array([math.sqrt(2)]))
    axes = 1
    while axes < MOST_AXES and n * float(np.mean(apart ** axes)) > MEETS:
        axes += 1
    found = float(same_interval(math.sqrt(max(2 - 2 * cosine, 0.0)))) ** axes
    return axes, max(1, math.ceil(math.log(1 - GRID_RECALL) / math.log(1 - min(found, 1 - 1e-9))))


@lru_cache(maxsize=8)
def _grid(dim: int, axes: int, grids: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    random = np.random.default_rng([SEED, dim, 1])
    return (random.standard_normal((grids, dim, axes)), random.uniform(0, INTERVAL, (grids, axes)),
            random.integers(1, 1 << 62, (grids, axes)).astype(np.uint64) * np.uint64(2) + np.uint64(1))


def cell_keys(units: np.ndarray, shape: tuple[int, int], grid: int) -> np.ndarray:
    """Cell of every unit vector in one grid, as a 64-bit mix of its intervals."""
    axes, shifts, odd = _grid(units.shape[1], *shape)
    spots = np.floor((units @ axes[grid] + shifts[grid]) / INTERVAL).astype(np.int64).view(np.uint64)
    mixed = np.zeros(len(units), np.uint64)
    for k in range(shape[0]):
        mixed = (mixed ^ (mixed >> np.uint64(29))) * odd[grid, k] + spots[:, k]
    return mixed.view(np.int64)


def valid(vector: Column) -> Column:
    infinite = F.lit(float("inf"))
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < infinite))
    return F.coalesce(finite & F.exists(vector, lambda x: x != 0), F.lit(False))


def _units(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(rows, unit vectors in double) per vector length of a list column."""
    lengths = column.value_lengths().to_numpy(zero_copy_only=False)
    values = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    starts = np.concatenate(([0], np.cumsum(lengths)[:-1])).astype(np.int64)
    for dim in np.unique(lengths):
        rows = np.flatnonzero(lengths == dim)
        x = values[starts[rows][:, None] + np.arange(int(dim))]
        x = x / np.abs(x).max(axis=1, keepdims=True)
        yield rows, x / np.linalg.norm(x, axis=1, keepdims=True)


class Cell:
    """The members of one chunk of a cell of ``grid``."""

    def __init__(self, ids: np.ndarray, weights: np.ndarray, units: np.ndarray, cosine: float, shape: tuple[int, int], grid: int) -> None:
        self.ids, self.weights, self.units, self.cosine = ids, weights, units, cosine
        self.shape, self.grid = shape, grid
        self.width, self.need = window_width(cosine), least_count(PROJECTIONS)
        self.axes = directions(units.shape[1])
        self.spots = self._project(units)
        self.earlier: dict[int, np.ndarray] = {}
        self.forest = Forest(len(ids))
        self.links = np.zeros(len(ids), np.int64)

    def _project(self, units: np.ndarray) -> np.ndarray:
        return np.ascontiguousarray((units @ self.axes).astype(np.float32).T)

    def _linked(self, spots: np.ndarray, units: np.ndarray, below: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
        """Linked (query, member) pairs; ``below``: only members before the query."""
        width = np.float32(self.width * 1.000001)
        # at the threshold a pair may miss this many windows; most others miss more of the first few
        spare = PROJECTIONS - self.need
        missed = np.zeros((spots.shape[1], len(self.ids)), np.int8)
        dense = min(PROJECTIONS, spare + 9)
        for k in range(dense):
            missed += np.abs(spots[k][:, None] - self.spots[k][None, :]) > width
        near = missed <= spare
        if below is not None:
            near &= np.arange(len(self.ids))[None, :] < below[:, None]
        q, m = np.nonzero(near)
        lost = missed[q, m]
        for k in range(dense, PROJECTIONS):
            lost = lost + (np.abs(spots[k][q] - self.spots[k][m]) > width)
            if k % 3 == 2:  # drop pairs that can no longer reach the count
                alive = lost <= spare
                q, m, lost = q[alive], m[alive], lost[alive]
        passed = lost <= spare
        q, m = q[passed], m[passed]
        for grid in range(self.grid if len(q) else 0):  # pairs that an earlier grid holds count there
            if grid not in self.earlier:
                self.earlier[grid] = cell_keys(self.units, self.shape, grid)
            some, place = np.unique(q, return_inverse=True)
            fresh = cell_keys(units[some], self.shape, grid)[place] != self.earlier[grid][m]
            q, m = q[fresh], m[fresh]
        keep = [np.empty(0, bool)]
        for k in range(0, len(q), 65_536):
            keep.append(np.einsum("ij,ij->i", units[q[k:k + 65_536]], self.units[m[k:k + 65_536]]) >= self.cosine)
        keep = np.concatenate(keep)
        return q[keep], m[keep]

    def _blocks(self, n: int) -> Iterator[slice]:
        step = max(1, (1 << 22) // max(1, len(self.ids)))
        return (slice(k, min(n, k + step)) for k in range(0, n, step))

    def own(self) -> None:
        """Count and join the links among the members."""
        for part in self._blocks(len(self.ids)):
            at = np.arange(part.start, part.stop)
            q, m = self._linked(self.spots[:, part], self.units[part], at)
            q = at[q]
            np.add.at(self.links, q, self.weights[m])
            np.add.at(self.links, m, self.weights[q])
            self.forest.link(q, m)

    def visit(self, ids: np.ndarray, weights: np.ndarray, units: np.ndarray):
        """(visitors, their links, roots of the members they join) per block of visitors."""
        spots, n = self._project(units), len(self.ids)
        for part in self._blocks(len(ids)):
            own = weights[part]
            q, m = self._linked(spots[:, part], units[part], None)
            links = np.zeros(len(own), np.int64)
            np.add.at(links, q, self.weights[m])
            np.add.at(self.links, m, own[q])
            self.forest.room(len(own))
            self.forest.link(n + q, m)
            at, root = self.forest.stars(n, n + len(own))
            yield ids[part], links, ids[part][at], self.ids[root]


def _meet(batches: Iterator[pa.RecordBatch], cosine: float, shape: tuple[int, int]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by (dim, grid, key, chunk, kind): members (kind 0) make the cell, visitors (kind 1) pass."""
    def out(a, b, n):
        return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(n, pa.int64())],
                                          names=["a", "b", "links"])

    def edges(a, b):
        return out(a, b, np.zeros(len(a), np.int64))

    def counts(ids, links):
        some = links > 0
        return out(ids[some], pa.nulls(int(some.sum()), pa.int64()), links[some])

    current, waiting, cell = None, [], None

    def opened():
        made = Cell(*(np.concatenate([w[k] for w in waiting]) for k in range(3)), cosine, shape, current[1])
        made.own()
        return made

    def closing():
        members = sum(len(w[0]) for w in waiting)
        last = opened() if cell is None and members > 1 else cell  # a lone vector meets nobody
        if last is not None:
            at, root = last.forest.stars(0, len(last.ids))
            yield edges(last.ids[at], last.ids[root])
            yield counts(last.ids, last.links)

    for batch in batches:
        places = np.stack([batch.column(k).to_numpy() for k in range(5)], axis=1)  # dim, grid, key, chunk, kind
        ids, weights = batch.column(5).to_numpy(), batch.column(6).to_numpy()
        cuts = np.flatnonzero((np.diff(places, axis=0) != 0).any(axis=1)) + 1
        units = {int(x.shape[1]): (int(rows[0]), x) for rows, x in _units(batch.column(7))}  # rows of a length follow each other
        for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), len(places)]):
            if a == b:
                continue
            *place, kind = places[a].tolist()
            if place != current:
                yield from closing()
                current, waiting, cell = place, [], None
            start, x = units[place[0]]
            part = (ids[a:b], weights[a:b], x[a - start:b - start])
            if kind == 0:
                waiting.append(part)
                continue
            if cell is None and waiting:
                cell = opened()
            if cell is not None:
                for visitors, links, x, y in cell.visit(*part):
                    yield edges(x, y)
                    yield counts(visitors, links)
    yield from closing()


def _sampled_distances(classes: DataFrame, cosine: float) -> np.ndarray:
    """Distances of the pairs without a link among ``SAMPLE`` classes chosen by hash."""
    groups: dict[int, list] = {}
    for r in classes.select("vector", F.xxhash64("cid").alias("at")).orderBy("at").limit(SAMPLE).collect():
        groups.setdefault(len(r["vector"]), []).append(r["vector"])
    found = [np.empty(0)]
    for vectors in groups.values():
        x = np.array(vectors, np.float64)
        x = x / np.abs(x).max(axis=1, keepdims=True)
        x = x / np.linalg.norm(x, axis=1, keepdims=True)
        dots = (x @ x.T)[np.triu_indices(len(x), 1)]
        found.append(np.sqrt(2 - 2 * np.clip(dots[dots < cosine], -1, 1)))
    return np.concatenate(found)


def links(classes: DataFrame, cosine: float = COSINE) -> DataFrame:
    """(a, b, links): a star link where ``b`` is set, else a part of the link count of
    class ``a``, from stored classes (cid, n, vector) of valid vectors."""
    n = classes.count()
    shape = grid_shape(n, _sampled_distances(classes, cosine), cosine)
    place = ["dim", "grid", "key"]

    def locate(batches: Iterator[pa.RecordBatch], whole: bool) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, units in _units(batch.column(2)):
                take = pa.array(rows, pa.int64())
                own = [batch.column(k).take(take) for k in range(3)] if whole else []
                for grid in range(shape[1]):
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.full(len(rows), v), pa.int64()) for v in (units.shape[1], grid)]
                        + [pa.array(cell_keys(units, shape, grid), pa.int64()), *own], names=place + ["cid", "n", "vector"][:len(own)])

    kind = classes.schema["vector"].dataType.simpleString()
    rows, keys = classes.select("cid", "n", "vector"), "dim bigint, grid bigint, key bigint"
    full = materialize(rows.transform(map_arrow, lambda b: locate(b, False), keys).groupBy(*place).agg(F.count("*").alias("size"))
                       .where(F.col("size") > CHUNK).select(*place, F.ceil(F.col("size") / CHUNK).alias("chunks")))
    small = full.count() <= SMALL_TABLE  # else a plain join
    dealt = rows.transform(map_arrow, lambda b: locate(b, True), f"{keys}, cid bigint, n bigint, vector {kind}")
    dealt = dealt.join(F.broadcast(full) if small else full, place, "left").withColumn("chunks", F.coalesce("chunks", F.lit(1)))
    own = F.pmod(F.xxhash64("cid"), F.col("chunks"))
    # a member of its own chunk, a visitor of the later ones
    dealt = dealt.select(*place, F.explode(F.sequence(own, F.col("chunks") - 1)).alias("chunk"), own.alias("own"), "cid", "n", "vector")
    dealt = dealt.select(*place, "chunk", (F.col("chunk") != F.col("own")).cast("bigint").alias("kind"), "cid", "n", "vector")
    parts = max(2 * classes.sparkSession.sparkContext.defaultParallelism, n * shape[1] // 65_536 + 1)
    return (dealt.repartition(parts, *place, "chunk").sortWithinPartitions(*place, "chunk", "kind")
            .transform(map_arrow, lambda batches: _meet(batches, cosine, shape), "a bigint, b bigint, links bigint"))


def near_duplicates(vectors: DataFrame, cosine: float = COSINE, id_col: str = "vec_id",
                    vector_col: str = "embedding") -> DataFrame:
    """(vec_id, n_links, component_id, kept) of every row."""
    rows = vectors.select(F.col(id_col).alias("vec_id"), F.col(vector_col).alias("vector"))
    rows = rows.withColumn("ok", valid(F.col("vector")))
    good = rows.where("ok").select("vec_id", "vector")
    classes = materialize(good.groupBy("vector").agg(F.count("*").alias("n"), F.min("vec_id").alias("first_id"))
                          .withColumn("cid", F.monotonically_increasing_id()))
    found = materialize(links(classes, cosine))
    counts = found.where("b is null").groupBy(F.col("a").alias("cid")).agg(F.sum("links").alias("others"))
    roots = components(found.where("b is not null"))
    rooted = materialize(classes.join(counts, "cid", "left").join(roots.withColumnRenamed("node", "cid"), "cid", "left")
                         .select("vector", "first_id", (F.coalesce("others", F.lit(0)) + F.col("n") - 1).alias("n_links"), "root",
                                 F.pmod(F.xxhash64("cid"), F.lit(SALTS)).alias("salt")))
    # a component may hold a third of all classes: its name is handed out in SALTS copies
    least = (rooted.where("root is not null").groupBy("root").agg(F.min("first_id").alias("component_id"))
             .withColumn("salt", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(SALTS - 1).cast("bigint")))))
    named = (rooted.where("root is not null").join(least, ["root", "salt"]).select("vector", "n_links", "component_id")
             .unionByName(rooted.where("root is null").select("vector", "n_links", F.col("first_id").alias("component_id"))))
    linked = good.join(named, "vector").select("vec_id", "n_links", "component_id")
    alone = rows.where(~F.col("ok")).select("vec_id", F.lit(0).cast("bigint").alias("n_links"),
                                            F.col("vec_id").alias("component_id"))
    return linked.unionByName(alone).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))


def op6_collision_projections(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "embeddings"))


QUERIES = {"op6_collision_projections": op6_collision_projections}
ORACLE: dict[str, str] = {}
