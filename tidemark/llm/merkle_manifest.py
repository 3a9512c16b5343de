"""Merkle dataset manifest (operator 12): sibling-shift self-joins.

``leaves`` hashes every row, ``numbered`` gives each row its place in its group, and ``climb``
builds all trees at once, level by level: a node's siblings are found by an equijoin on their
computed places (place XOR 1 in a binary tree, the other slots of the run otherwise), and the
rows in slot zero emit the parents.  The groups' subroots are the leaves of one more tree.
``descend`` hands the sibling digests down again, parent to child, so a proof costs one join
row per node and not one per document and level; ``fold`` recomputes a root from a leaf and
its proof.  A proof is the sibling digests in order, 32 bytes each: which of them stand left
of the path follows from the leaf's place and the group's size.

No join has a hot key: places differ within a group, however large it is, and places are
numbered by range-partitioned blocks.  One number per tree set (its greatest size) and the
root reach the driver.

Null columns hash as ``-``; null groups form a group of their own, which comes first, and null
ids come first in their group.  Rows that share an id are placed by their digests; fully equal
rows have equal leaves and places of their own.  A text is hashed whole, whatever its length.
Only the named columns are read, so further columns, whatever their names, do not matter.  An
empty table has no root and gives an empty result."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.llm.common import materialize, table

FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
FANOUT = 2
TAMPER = 7


def _hex(digest: Column) -> Column:
    return F.lower(F.hex(digest))


def _digest(text: Column) -> Column:
    """SHA-256 of a string, as 32 bytes."""
    return F.unhex(F.sha2(text, 256))


def _field(value: Column) -> Column:
    """A value with its length in bytes; ``-`` for null."""
    s = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(s).cast("string"), F.lit(":"), s), F.lit("-"))


def leaf(changed: dict[str, Column] | None = None, fields: Sequence[str] = FIELDS) -> Column:
    """Digest of a row, with some of its columns replaced."""
    changed = changed or {}
    return _digest(F.concat(*[_field(changed.get(f, F.col(f))) for f in fields]))


def tampered(id_col: str = "doc_id", count: str = "n_chars", every: int = TAMPER) -> Column:
    """The leaf after 1 was added to ``count`` where ``every`` divides the id's checksum."""
    hit = F.crc32(F.col(id_col).cast("string").cast("binary")) % every == 0
    return leaf({count: F.when(hit, F.col(count) + 1).otherwise(F.col(count))})


def numbered(rows: DataFrame, group: str, order: Sequence[str]) -> DataFrame:
    """Add (idx, n): the gapless place of every row in its group, and the group's size.

    ``rows`` must be stored and ``order`` unique.  Rows are cut into blocks by sampled borders
    of (group, order), so a large group spreads over many blocks."""
    by = [group, *order]
    blocks = materialize(rows.repartitionByRange(*by).withColumn("mm_block", F.spark_partition_id()))
    counts = blocks.groupBy(group, "mm_block").agg(F.count("*").alias("mm_n"))
    whole = Window.partitionBy(group)
    # rows per group: one per block that holds it
    bases = counts.select(group, "mm_block", F.sum("mm_n").over(whole).alias("n"),
                          (F.sum("mm_n").over(whole.orderBy("mm_block")) - F.col("mm_n")).alias("mm_base"))
    rank = F.row_number().over(Window.partitionBy(group, "mm_block").orderBy(*order))
    return (blocks.withColumn("mm_rank", rank).join(bases, [group, "mm_block"])
            .withColumn("idx", F.col("mm_base") + F.col("mm_rank") - 1).drop("mm_block", "mm_base", "mm_rank"))


def _sibling_places(fanout: int) -> list[Column]:
    if fanout == 2:
        return [F.col("idx").bitwiseXOR(F.lit(1).cast("bigint"))]
    slot = F.col("idx") % fanout
    return [F.col("idx") - slot + (slot + d) % fanout for d in range(1, fanout)]


def climb(nodes: DataFrame, fanout: int = FANOUT) -> tuple[list[DataFrame], DataFrame]:
    """Levels of all trees (stored, from the leaves up, with ``sibs``: the digests of a node's
    siblings in order) and the roots (tree, digest, level).  ``nodes``: (tree, idx, n, digest);
    further columns stay in the lowest level."""
    most = nodes.agg(F.max("n")).first()[0] or 0
    up = [c for c in ("tree", "idx", "n", "digest")]
    slot = F.col("idx") % fanout
    levels: list[DataFrame] = []
    roots = [nodes.where("n = 1").select("tree", "digest", F.lit(0).alias("level"))]
    while most > 1:
        here = nodes.where("n > 1")
        found = here
        for k, place in enumerate(_sibling_places(fanout)):
            other = here.select(F.col("tree").alias("mm_t"), F.col("idx").alias("mm_i"), F.col("digest").alias(f"mm_d{k}"))
            found = found.withColumn(f"mm_p{k}", place)
            found = found.join(other, (F.col("tree") == F.col("mm_t")) & (F.col(f"mm_p{k}") == F.col("mm_i")), "left").drop("mm_t", "mm_i")
        places = [F.struct(F.col(f"mm_p{k}").alias("p"), F.col(f"mm_d{k}").alias("d")) for k in range(fanout - 1)]
        ordered = F.array_sort(F.filter(F.array(*places), lambda s: s["d"].isNotNull()))
        sibs = F.aggregate(ordered, F.lit("").cast("binary"), lambda all_, s: F.concat(all_, s["d"]))
        level = materialize(found.select(*here.columns, sibs.alias("sibs")))
        levels.append(level)
        # the run's first node knows all the others, in order
        nodes = level.where(slot == 0).select("tree", F.expr(f"idx div {fanout}").alias("idx"),
                                              F.expr(f"(n + {fanout - 1}) div {fanout}").alias("n"),
                                              _digest(F.concat(_hex(F.col("digest")), _hex(F.col("sibs")))).alias("digest")).select(up)
        roots.append(nodes.where("n = 1").select("tree", "digest", F.lit(len(levels)).alias("level")))
        most = -(-most // fanout)
    out = roots[0]
    for r in roots[1:]:
        out = out.unionByName(r)
    return levels, out


def descend(levels: list[DataFrame], roots: DataFrame, fanout: int = FANOUT) -> DataFrame:
    """(idx, proof and the columns of the root) of every leaf of a tree that has a level, with
    the lowest level's own columns.  ``roots``: (tree, level, proof, ...)."""
    down = roots.select(F.col("level").alias("mm_level"), F.lit(0).cast("bigint").alias("mm_up"),
                        F.col("tree").alias("mm_t"), F.col("proof").alias("mm_proof"),
                        *[c for c in roots.columns if c not in ("tree", "level", "proof")])
    kept = [c for c in down.columns if c not in ("mm_level", "mm_up", "mm_t", "mm_proof")]
    above = None
    for k in reversed(range(len(levels))):
        parents = down.where(F.col("mm_level") == k + 1).drop("mm_level")
        if above is not None:
            parents = parents.unionByName(above)
        level = levels[k]
        joined = level.join(parents, (F.col("tree") == F.col("mm_t")) & (F.expr(f"idx div {fanout}") == F.col("mm_up")))
        proof = F.concat(F.col("sibs"), F.col("mm_proof"))
        if k == 0:
            return joined.select(*[c for c in level.columns if c != "sibs"], proof.alias("proof"), *kept)
        above = joined.select(F.col("idx").alias("mm_up"), F.col("tree").alias("mm_t"), proof.alias("mm_proof"), *kept)
        if k % 8 == 0:
            above = materialize(above)  # a lost executor replays eight levels at most
    raise ValueError("no levels")


def fold(rows: DataFrame, leaf_digest: str, proof: str, places: Sequence[tuple[str, str]], depth: int, out: str,
         fanout: int = FANOUT) -> DataFrame:
    """Add ``out``: the root (32 bytes) that a leaf and its proof give.  ``places``: the columns
    (idx, n) of the path's start in each tree it climbs, the lowest first; ``depth``: the most
    levels of any tree.  Each tree's result is a column of its own, worked out once a row."""
    rows = rows.withColumn("mm_text", _hex(F.col(proof))).withColumn(
        "mm_state", F.struct(_hex(F.col(leaf_digest)).alias("d"), F.lit(0).cast("bigint").alias("at")))
    text = F.col("mm_text")

    def step(s, _):
        slot = s["i"] % fanout
        others = F.least(F.lit(fanout).cast("bigint"), s["n"] - s["i"] + slot) - 1
        left = F.substr(text, (s["at"] + 1).cast("int"), (slot * 64).cast("int"))
        right = F.substr(text, (s["at"] + slot * 64 + 1).cast("int"), ((others - slot) * 64).cast("int"))
        climbed = F.struct(F.sha2(F.concat(left, s["d"], right), 256).alias("d"), (s["at"] + others * 64).alias("at"),
                           F.floor(s["i"] / fanout).alias("i"), F.ceil(s["n"] / fanout).alias("n"))
        return F.when(s["n"] > 1, climbed).otherwise(s)

    for idx, n in places:
        start = F.struct(F.col("mm_state.d").alias("d"), F.col("mm_state.at").alias("at"), F.col(idx).cast("bigint").alias("i"),
                         F.col(n).cast("bigint").alias("n"))
        rows = rows.withColumn("mm_state", F.aggregate(F.sequence(F.lit(1), F.lit(max(depth, 1))), start, step))
    return rows.withColumn(out, F.unhex("mm_state.d")).drop("mm_text", "mm_state")


def manifest(docs: DataFrame, id_col: str = "doc_id", group: str = "lang", leaf_digest: Column | None = None,
             check_digest: Column | None = None, fanout: int = FANOUT) -> DataFrame:
    """One row per document: id, place (idx of n), leaf, subroot, root, proof, folded_root
    (recomputed from ``check_digest``, the leaf itself by default) and verified."""
    leaf_digest = leaf() if leaf_digest is None else leaf_digest
    check_digest = leaf_digest if check_digest is None else check_digest
    rows = materialize(docs.select(
        # "-" sorts before "=", so the null group comes first and the others in byte order
        F.coalesce(F.concat(F.lit("="), F.col(group).cast("string")), F.lit("-")).alias("tree"),
        F.col(id_col).alias("id"), leaf_digest.alias("digest"), check_digest.alias("check"),
        F.monotonically_increasing_id().alias("uid")))
    nodes = materialize(numbered(rows, "tree", ["id", "digest", "uid"]).drop("uid"))
    levels, subroots = climb(nodes, fanout)
    subroots = materialize(subroots)
    tops = materialize(numbered(subroots.select(F.lit("").alias("top"), F.col("tree").alias("name"), "digest", "level"), "top", ["name"])
                       .withColumnRenamed("top", "tree"))
    top_levels, top = climb(tops.select("tree", "idx", "n", "digest", "name", "level"), fanout)
    top = top.first()
    root = None if top is None else bytes(top["digest"])
    no_proof = F.lit(b"")
    if top_levels:
        heads = descend(top_levels, docs.sparkSession.createDataFrame([("", len(top_levels))], "tree string, level int")
                        .select("tree", "level", no_proof.alias("proof")), fanout)
    else:
        heads = tops.select("*", no_proof.alias("proof"))
    heads = materialize(heads.select(F.col("name").alias("tree"), "level", "proof", F.col("digest").alias("subroot"),
                                     F.col("idx").alias("top_idx"), F.col("n").alias("top_n")))
    lone = (nodes.where("n = 1").join(heads.where("level = 0").select(F.col("tree").alias("mm_t"), "proof", "subroot", "top_idx", "top_n"),
                                      F.col("tree") == F.col("mm_t")).drop("mm_t"))
    paths = descend(levels, heads, fanout).unionByName(lone) if levels else lone
    depth = max(len(levels), len(top_levels))
    paths = fold(paths, "check", "proof", [("idx", "n"), ("top_idx", "top_n")], depth, "folded_root", fanout)
    out = paths.select("id", "idx", "n", F.col("digest").alias("leaf"), "subroot", F.lit(root).cast("binary").alias("root"), "proof",
                       "folded_root")
    return out.withColumn("verified", F.col("folded_root") == F.col("root"))


def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = manifest(table(spark, sf_dir, "documents"), check_digest=tampered())
    return rows.select(F.col("id").alias("doc_id"), *[_hex(F.col(c)).alias(c) for c in ("leaf", "subroot", "root")],
                       F.sha2(_hex(F.col("proof")), 256).alias("proof_sha256"), _hex(F.col("folded_root")).alias("folded_root"), "verified")


def _sql_leaf(n_chars: str) -> str:
    values = {f: f"CAST({f} AS VARCHAR)" for f in FIELDS} | {"n_chars": f"CAST({n_chars} AS VARCHAR)"}
    return "sha256(" + " || ".join(f"coalesce(strlen({v}) || ':' || {v}, '-')" for v in values.values()) + ")"


# Each tree is a list of digests per level; the checksum is worked out bit by bit.
ORACLE_SQL = f"""
WITH RECURSIVE d AS (
  SELECT *, list_reduce(list_concat([4294967295::BIGINT], list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda c: ascii(c)::BIGINT)),
           lambda s, c: list_reduce([xor(s, c), 0, 0, 0, 0, 0, 0, 0, 0],
                        lambda x, z: xor(x >> 1, CASE WHEN (x & 1) = 1 THEN 3988292384::BIGINT ELSE 0::BIGINT END))) AS crc FROM documents),
l AS (SELECT doc_id, lang, {_sql_leaf('n_chars')} AS leaf,
             {_sql_leaf('CASE WHEN xor(crc, 4294967295::BIGINT) % 7 = 0 THEN n_chars + 1 ELSE n_chars END')} AS changed FROM d),
p AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i FROM l),
t AS (SELECT lang, 0 AS k, list(leaf ORDER BY i) AS ds FROM p GROUP BY lang
      UNION ALL
      SELECT lang, k + 1, list_transform(range(0, (len(ds) + 1) // 2), lambda j: sha256(ds[2 * j + 1] || coalesce(ds[2 * j + 2], ''))) FROM t WHERE len(ds) > 1),
s AS (SELECT lang, ds[1] AS subroot, row_number() OVER (ORDER BY encode(lang) NULLS FIRST) - 1 AS i FROM t WHERE len(ds) = 1),
u AS (SELECT 0 AS k, list(subroot ORDER BY i) AS ds FROM s HAVING count(*) > 0
      UNION ALL
      SELECT k + 1, list_transform(range(0, (len(ds) + 1) // 2), lambda j: sha256(ds[2 * j + 1] || coalesce(ds[2 * j + 2], ''))) FROM u WHERE len(ds) > 1),
sub_path AS (SELECT p.lang, p.i, p.doc_id, p.leaf, p.changed, p.i AS uid,
             list((CASE WHEN (p.i >> t.k) & 1 = 1 THEN 'L' ELSE 'R' END) || coalesce(t.ds[xor(p.i >> t.k, 1) + 1], '') ORDER BY t.k) FILTER (len(t.ds) > 1) AS sibs
             FROM p JOIN t ON p.lang IS NOT DISTINCT FROM t.lang GROUP BY ALL),
top_path AS (SELECT s.lang, s.subroot,
             list((CASE WHEN (s.i >> u.k) & 1 = 1 THEN 'L' ELSE 'R' END) || coalesce(u.ds[xor(s.i >> u.k, 1) + 1], '') ORDER BY u.k) FILTER (len(u.ds) > 1) AS sibs
             FROM s CROSS JOIN u GROUP BY ALL),
r AS (SELECT ds[1] AS root FROM u WHERE len(ds) = 1),
x AS (SELECT a.doc_id, a.leaf, a.changed, b.subroot, list_concat(coalesce(a.sibs, []), coalesce(b.sibs, [])) AS sibs
      FROM sub_path a JOIN top_path b ON a.lang IS NOT DISTINCT FROM b.lang),
y AS (SELECT *, list_reduce(list_concat([changed], sibs),
        lambda d, s: sha256(CASE WHEN s[1] = 'L' THEN s[2:] || d ELSE d || s[2:] END)) AS folded_root FROM x)
SELECT doc_id, leaf, subroot, root, sha256(array_to_string(list_transform(sibs, lambda s: s[2:]), '')) AS proof_sha256,
       folded_root, folded_root = root AS verified
FROM y CROSS JOIN r
"""

QUERIES = {"op12_merkle_manifest": op12_merkle_manifest}
ORACLE = {"op12_merkle_manifest": ORACLE_SQL}
