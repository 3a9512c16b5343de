"""Connected components of a link table by repeated contraction.

Each round every node moves to the neighbour (or itself) of least priority, two hops at
once, and the links are rewritten to the new nodes.  Priorities are the node id in the
first round (a star around its least id collapses at once) and a fresh hash afterwards,
which shrinks any graph, long chains too, by a constant factor a round.  There is no cap on
rounds: the loop ends when no link joins two nodes."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import materialize


def components(links: DataFrame) -> DataFrame:
    """(node, root) for every node of ``links`` (a, b bigint); one root per component."""
    links = materialize(links.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    moves: list[DataFrame] = []
    while not moves or not links.isEmpty():
        turn = len(moves)
        rank, own = (F.col(c) if turn == 0 else F.xxhash64(F.lit(turn), F.col(c)) for c in ("b", "a"))
        both = links.union(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        # the least of the neighbours (partial aggregation keeps a hub's links out of one
        # task), then against the node itself
        step = (both.groupBy("a").agg(F.min(F.struct(rank.alias("r"), F.col("b").alias("to"))).alias("m"))
                .select("a", F.when(F.col("m.r") < own, F.col("m.to")).otherwise(F.col("a")).alias("to")))
        move = materialize(step.join(step.select(F.col("a").alias("to"), F.col("to").alias("next")), "to").select("a", "next"))
        moves.append(move)
        links = materialize(
            links.join(move, "a").select(F.col("next").alias("x"), "b")
            .join(move.select(F.col("a").alias("b"), F.col("next").alias("y")), "b")
            .where("x <> y").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct())
    roots = moves[0].select(F.col("a").alias("node"), F.col("next").alias("root"))
    for move in moves[1:]:
        roots = (roots.join(move.withColumnRenamed("a", "root"), "root", "left")
                 .select("node", F.coalesce("next", "root").alias("root")))
    return materialize(roots)


class Forest:
    """Union-find over nodes 0..n-1 (members, kept) and the nodes of one query block."""

    def __init__(self, n: int) -> None:
        self.n, self.parent = n, np.arange(n)

    def room(self, k: int) -> None:
        self.parent = np.concatenate([self.parent[:self.n], np.arange(self.n, self.n + k)])

    def labels(self) -> np.ndarray:
        while True:
            up = self.parent[self.parent]
            if np.array_equal(up, self.parent):
                return up
            self.parent = up

    def _root(self, x: int) -> int:
        while self.parent[x] != x:
            x = int(self.parent[x])
        return x

    def link(self, x: np.ndarray, y: np.ndarray) -> None:
        """Join the trees of all links (x, y).  Links inside one tree are dropped as arrays,
        so a dense group costs one step per node, not per pair."""
        while len(x):
            label = self.labels()
            apart = label[x] != label[y]
            x, y = x[apart], y[apart]
            one = np.union1d(np.unique(x, return_index=True)[1], np.unique(y, return_index=True)[1])
            for i in one.tolist():
                a, b = self._root(int(x[i])), self._root(int(y[i]))
                if a != b:
                    self.parent[max(a, b)] = min(a, b)  # the root is the least member

    def stars(self, first: int, last: int) -> tuple[np.ndarray, np.ndarray]:
        """(node, root) of the nodes first..last - 1 that are not roots; nodes from 0 on."""
        label = self.labels()[first:last]
        at = np.flatnonzero(label != np.arange(first, last))
        return at, label[at]
