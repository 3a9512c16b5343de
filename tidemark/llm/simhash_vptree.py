"""SimHash near-dedup (operator 3): exact Hamming links through vantage-point trees.

Fingerprints: 64-bit SimHash over word shingles.  Equal fingerprints collapse to one class
first, so groups of copies cost one row.  A routing tree of vantage points, fitted on a
bounded sample of the distinct fingerprints, cuts Hamming space into shards; by the
triangle inequality a ball of the link radius around a fingerprint can only reach the
branches whose distance shell it overlaps, so a fingerprint visits those shards besides
its own.  Every link therefore appears in the home shard of one of its ends.  A shard keeps
its own members in a vantage-point tree (pruned by the same bounds) and streams the visitors
through it.  It returns the groups it finds as stars, never all pairs of a dense group; the
connected components of the stars are those of the links.

A null or empty text has no words: fingerprint zero, linked like any other.  A null doc_id
keeps its row; component_id is the least non-null doc_id of the component (null if none).
A text is hashed
whole, whatever its length; a bit that exactly half of the shingles set is 0.  Only the named
columns are read, so others may have any name.  Repeated rows give equal rows.  An empty table
gives an empty result."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm.common import map_arrow, materialize, raw_texts, stable_fraction, table
from tidemark.llm.components import Forest, components

SHINGLE = 4
MAX_BITS = 4
#: Copies of the name of a large group, so that its rows meet it in many tasks.
SALTS = 32
SEED = 42
#: Distinct fingerprints the routing tree is fitted on (the least by hash), members aimed
#: at per shard, and leaf size of a shard's own tree.
SAMPLE = 32_768
SHARD_MEMBERS = 65_536
LEAF = 64
#: Visitors of a shard aimed at per task; beyond, its visitors are split and its members copied.
SPLIT_VISITORS = 2_000_000

_BITS = ((np.arange(256)[:, None] >> np.arange(8)) & 1).astype(np.int64)


def fingerprint(text: bytes | None, shingle: int = SHINGLE, seed: int = SEED) -> int:
    """SimHash of one text as an unsigned 64-bit number."""
    words = text.lower().split() if text else []
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) <= shingle:
        hashes = np.array([xxhash.xxh64_intdigest(joined, seed)], np.uint64)
    else:
        ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
        starts = np.concatenate(([0], ends[:-1] + 1))
        digest = xxhash.xxh64_intdigest
        hashes = np.array([digest(joined[a:b], seed) for a, b in
                           zip(starts[:len(words) - shingle + 1].tolist(), ends[shingle - 1:].tolist())], np.uint64)
    octets = hashes.astype("<u8").view(np.uint8).reshape(-1, 8)
    ones = np.concatenate([np.bincount(octets[:, k], minlength=256) @ _BITS for k in range(8)])
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view("<u8")[0])


def _fingerprint_column(batch_column: pa.Array, shingle: int) -> pa.Array:
    return pa.array(np.array([fingerprint(t, shingle) for t in raw_texts(batch_column)], np.uint64).view(np.int64))


def fingerprints(docs: DataFrame, shingle: int = SHINGLE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fp) of every row; fp is the fingerprint as a signed bigint."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), _fingerprint_column(batch.column(1), shingle)],
                                             names=["doc_id", "fp"])

    id_type = docs.schema[id_col].dataType.simpleString()
    return (docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
            .transform(map_arrow, run, f"doc_id {id_type}, fp bigint"))


def with_fingerprint(docs: DataFrame, name: str, shingle: int = SHINGLE, text_col: str = "text") -> DataFrame:
    """``docs``, all columns, and the fingerprint as column ``name``."""
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*batch.columns, _fingerprint_column(batch.column(at), shingle)],
                                             names=[*batch.schema.names, name])

    return docs.transform(map_arrow, run, T.StructType([*docs.schema.fields, T.StructField(name, T.LongType())]))


class VantageTree:
    """A vantage-point tree as flat arrays.  ``inside`` holds the points within ``bound``
    of ``vantage``; leaves carry a number and, if kept, the points themselves."""

    def __init__(self, points: np.ndarray, leaf: int, seed: int, keep: bool) -> None:
        self.vantage: list = []
        self.bound: list[int] = []
        self.inside: list[int] = []
        self.outside: list[int] = []
        self.leaf_points: list[np.ndarray] = []
        rng = np.random.default_rng(seed)
        stack = [(np.asarray(points, np.uint64), -1, False)]
        while stack:
            pts, parent, is_inside = stack.pop()
            ref = None
            if len(pts) > leaf:
                # of a few candidates, the vantage point that splits distances most widely
                best = None
                some = pts[rng.integers(0, len(pts), 256)]
                for v in some[:4]:
                    spread = float(np.bitwise_count(some ^ v).astype(np.float64).std())
                    if best is None or spread > best[0]:
                        best = (spread, v)
                v = best[1]
                far = np.bitwise_count(pts ^ v)
                bound = int(np.median(far))
                near = far <= bound
                if near.all():
                    bound -= 1
                    near = far <= bound
                if near.any() and not near.all():
                    ref = len(self.vantage)
                    self.vantage.append(v)
                    self.bound.append(bound)
                    self.inside.append(0)
                    self.outside.append(0)
                    stack.append((pts[near], ref, True))
                    stack.append((pts[~near], ref, False))
            if ref is None:
                ref = -1 - len(self.leaf_points)
                self.leaf_points.append(pts if keep else pts[:0])
            if parent >= 0:
                (self.inside if is_inside else self.outside)[parent] = ref
        self.root = 0 if self.vantage else -1

    def visit(self, queries: np.ndarray, radius: int) -> Iterator[tuple[int, np.ndarray]]:
        """(leaf, query indices) of all leaves that the balls of ``radius`` can reach."""
        stack = [(self.root, np.arange(len(queries)))]
        while stack:
            ref, rows = stack.pop()
            if not len(rows):
                continue
            if ref < 0:
                yield -1 - ref, rows
                continue
            far = np.bitwise_count(queries[rows] ^ self.vantage[ref]).astype(np.int16)
            stack.append((self.inside[ref], rows[far - radius <= self.bound[ref]]))
            stack.append((self.outside[ref], rows[far + radius > self.bound[ref]]))


class Shard:
    """The members of one shard in a vantage-point tree (members in signed order, so that
    the least node of a group is its root for Spark too)."""

    def __init__(self, members: np.ndarray, radius: int) -> None:
        self.members, self.radius = np.sort(members.view(np.int64)).view(np.uint64), radius
        self.tree = VantageTree(self.members, LEAF, 1, keep=True)
        signed = self.members.view(np.int64)
        self.places = [np.searchsorted(signed, pts.view(np.int64)) for pts in self.tree.leaf_points]
        self.forest = Forest(len(members))

    def _search(self, queries: np.ndarray, nodes: np.ndarray) -> None:
        for leaf, rows in self.tree.visit(queries, self.radius):
            points, places = self.tree.leaf_points[leaf], self.places[leaf]
            step = max(1, (1 << 18) // max(1, len(points)))
            for k in range(0, len(rows), step):
                part = rows[k:k + step]
                q, p = np.nonzero(np.bitwise_count(queries[part, None] ^ points[None, :]) <= self.radius)
                q, p = nodes[part[q]], places[p]
                apart = q != p
                if apart.any():
                    self.forest.link(q[apart], p[apart])

    def own(self, block: int = 32_768) -> None:
        for k in range(0, len(self.members), block):
            part = self.members[k:k + block]
            self._search(part, np.arange(k, k + len(part)))

    def member_links(self) -> tuple[np.ndarray, np.ndarray]:
        at, root = self.forest.stars(0, len(self.members))
        return self.members[at], self.members[root]

    def visitor_links(self, visitors: np.ndarray, block: int = 32_768) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        n = len(self.members)
        for k in range(0, len(visitors), block):
            part = visitors[k:k + block]
            self.forest.room(len(part))
            self._search(part, n + np.arange(len(part)))
            at, root = self.forest.stars(n, n + len(part))
            yield part[at], self.members[root]


def _shards(batches: Iterator[pa.RecordBatch], radius: int, splits: int) -> Iterator[pa.RecordBatch]:
    """Stream rows sorted by (shard, kind): members (kind 0) build the shard, visitors pass,
    and at its end the members' groups go out as stars."""
    current, members, shard = None, [], None

    def out(a, b):
        return pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], names=["a", "b"])

    def opened():
        made = Shard(np.concatenate(members), radius)
        if current % splits == 0:
            made.own()
        return made

    def closing():
        last = opened() if shard is None and members else shard
        if last is not None:
            yield out(*last.member_links())

    for batch in batches:
        key, kind = (batch.column(k).to_numpy() for k in (0, 1))
        fps = batch.column(2).to_numpy().view(np.uint64)
        cuts = np.flatnonzero((np.diff(key) != 0) | (np.diff(kind) != 0)) + 1
        for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), len(key)]):
            if a == b:
                continue
            if key[a] != current:
                yield from closing()
                current, members, shard = int(key[a]), [], None
            if kind[a] == 0:
                members.append(fps[a:b])
                continue
            if shard is None and members:
                shard = opened()
            if shard is not None:
                for links in shard.visitor_links(fps[a:b]):
                    yield out(*links)
    yield from closing()


def hamming_links(fps: DataFrame, radius: int = MAX_BITS) -> DataFrame:
    """Stars (a, b) with the components of all pairs of the distinct ``fp`` of ``fps`` at
    ``radius`` or fewer differing bits."""
    n = fps.count()
    # a bounded sample, the same at every run; the filter keeps what leaves the tasks bounded too
    chosen = fps.select("fp").where(stable_fraction(F.col("fp"), min(1.0, 2 * SAMPLE / max(n, 1))))
    sample = np.array([r[0] for r in chosen.orderBy(F.xxhash64(F.lit("route"), "fp"), "fp")
                      .limit(SAMPLE).collect()], np.int64).view(np.uint64)
    leaves = max(1, min(-(-n // SHARD_MEMBERS), SAMPLE // 16))
    tree = VantageTree(sample, max(1, -(-len(sample) // leaves)), 7, keep=False)
    leaves = len(tree.leaf_points)
    # a fingerprint's ball misses about a sixth of the other side at each level
    splits = max(1, round(n * 0.84 ** np.log2(max(leaves, 1)) / SPLIT_VISITORS))

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            whole = batch.column(0).to_numpy().view(np.uint64)
            for k in range(0, len(whole), 4096):
                q = whole[k:k + 4096]
                home = np.empty(len(q), np.int64)
                for leaf, rows in tree.visit(q, 0):
                    home[rows] = leaf
                for leaf, rows in tree.visit(q, radius):
                    visitor = home[rows] != leaf
                    part = (q[rows] % np.uint64(splits)).astype(np.int64)
                    own = q[rows[~visitor]]
                    key = np.concatenate([leaf * splits + part[visitor], np.repeat(leaf * splits + np.arange(splits), len(own))])
                    kind = np.concatenate([np.ones(int(visitor.sum()), np.int64), np.zeros(len(own) * splits, np.int64)])
                    fp = np.concatenate([q[rows[visitor]], np.tile(own, splits)])
                    yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(kind), pa.array(fp.view(np.int64))],
                                                     names=["shard", "kind", "fp"])

    routed = fps.select("fp").transform(map_arrow, route, "shard bigint, kind bigint, fp bigint")
    ordered = routed.repartition(leaves * splits, "shard").sortWithinPartitions("shard", "kind")
    return ordered.transform(map_arrow, lambda batches: _shards(batches, radius, splits), "a bigint, b bigint")


def near_duplicates(docs: DataFrame, shingle: int = SHINGLE, max_bits: int = MAX_BITS,
                    id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fp, root, component_id) of every row of ``docs``; root names the component.

    A component or a fingerprint may hold a third of all rows.  The names of linked components
    are handed out in ``SALTS`` copies, and so are those of fingerprints that hold more than a
    thousandth of the rows, of which there are fewer than a thousand at any input size."""
    rows = materialize(fingerprints(docs, shingle, id_col, text_col))
    classes = materialize(rows.groupBy("fp").agg(F.min("doc_id").alias("first_id"), F.count("*").alias("n")))
    roots = components(hamming_links(classes, max_bits))
    rooted = classes.join(roots.withColumnRenamed("node", "fp"), "fp", "left")
    linked = rooted.where("root is not null").withColumn("salt", F.pmod(F.xxhash64("fp"), F.lit(SALTS)))
    every = F.sequence(F.lit(0).cast("bigint"), F.lit(SALTS - 1).cast("bigint"))
    least = linked.groupBy("root").agg(F.min("first_id").alias("component_id")).withColumn("salt", F.explode(every))
    named = (linked.join(least, ["root", "salt"]).select("fp", "root", "component_id")
             .unionByName(rooted.where("root is null").select("fp", F.col("fp").alias("root"), F.col("first_id").alias("component_id"))))
    total = rows.count()
    hot = F.col("fp").isin([r["fp"] for r in classes.where(F.col("n") * 1000 > total).select("fp").collect()])
    one = F.array(F.lit(0).cast("bigint"))
    named = named.withColumn("salt", F.explode(F.when(hot, every).otherwise(one)))
    # any copy will do, so rows without an id are dealt out too
    dealt = rows.withColumn("salt", F.when(hot, F.pmod(F.monotonically_increasing_id(), F.lit(SALTS))).otherwise(F.lit(0)).cast("bigint"))
    return dealt.join(named, ["fp", "salt"]).select("doc_id", "fp", "root", "component_id")


def keep_first(docs: DataFrame, shingle: int = SHINGLE, max_bits: int = MAX_BITS, id_col: str = "doc_id",
               text_col: str = "text") -> DataFrame:
    """One row of each component, all columns: the one with the least doc_id.  Of rows that
    share it, or of a component without any doc_id, the one whose columns hash least stays."""
    found = materialize(near_duplicates(docs, shingle, max_bits, id_col, text_col))
    first = found.where("doc_id = component_id")
    repeated = found.where("doc_id is not null").groupBy("doc_id").count().where("count > 1").select("doc_id")
    odd = found.where("doc_id is null").select("doc_id").limit(1).union(repeated)
    if odd.isEmpty():
        return docs.join(first.select(F.col("doc_id").alias(id_col)), id_col, "left_semi").select(docs.columns)
    # ids that do not tell rows apart: those rows go by their fingerprint
    kept_ids = first.select(F.col("doc_id").alias(id_col)).distinct()
    odd_ids = repeated.select(F.col("doc_id").alias(id_col))
    plain = docs.join(kept_ids, id_col, "left_semi").join(odd_ids, id_col, "left_anti").select(docs.columns)
    name = "fp_of_row"
    while name in docs.columns:
        name += "_"
    shared = docs.join(odd_ids, id_col, "left_semi").select(docs.columns).unionByName(docs.where(F.col(id_col).isNull()))
    component = found.select(F.col("fp").alias(name), F.col("root").alias(name + "root"),
                             F.col("component_id").alias(name + "first")).distinct()
    whole = [F.col(f"`{c}`") for c in docs.columns]
    rest = (with_fingerprint(shared, name, shingle, text_col).join(component, name)
            .where(F.col(id_col).eqNullSafe(F.col(name + "first"))).groupBy(name + "root")
            .agg(F.min_by(F.struct(*whole), F.xxhash64(*whole)).alias(name)).select(f"{name}.*"))
    return plain.unionByName(rest)


def op3_simhash_vptree(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


QUERIES = {"op3_simhash_vptree": op3_simhash_vptree}
ORACLE: dict[str, str] = {}
