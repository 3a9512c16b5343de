import re

import numpy as np
import xxhash
from pyspark.sql import functions as F

from tests.llm import cases
from tidemark.llm import simhash_vptree as sh


def plain_fingerprint(text, k=4):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub(r"[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return 0
    shingles = [" ".join(words[i:i + k]) for i in range(len(words) - k + 1)] if len(words) >= k else [" ".join(words)]
    hashes = [xxhash.xxh64(s.encode(), seed=42).intdigest() for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def expected(rows):
    fps = [plain_fingerprint(t) for _, t in rows]
    pairs = [(a, b) for a in range(len(fps)) for b in range(a) if bin(fps[a] ^ fps[b]).count("1") <= 4]
    least = cases.groups(len(rows), pairs)
    first = {}
    for (doc, _), g in zip(rows, least):
        if doc is not None:
            first[g] = min(doc, first.get(g, doc))
    return sorted(((doc, fp, first.get(g)) for (doc, _), fp, g in zip(rows, fps, least)), key=repr)


def test_edges_match_brute_force(spark):
    docs = cases.documents(spark)
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    got = [(r["doc_id"], r["fp"] % (1 << 64), r["component_id"]) for r in sh.near_duplicates(docs).collect()]
    assert sorted(got, key=repr) == expected(rows)


def test_empty_table(spark):
    assert sh.near_duplicates(cases.no_documents(spark)).count() == 0
    assert sh.keep_first(cases.no_documents(spark)).count() == 0


def test_links_of_many_shards_match_brute_force(spark, monkeypatch):
    monkeypatch.setattr(sh, "SHARD_MEMBERS", 150)
    monkeypatch.setattr(sh, "SPLIT_VISITORS", 400)
    rng = np.random.default_rng(3)
    base = rng.integers(0, 1 << 64, 700, dtype=np.uint64)
    near = []
    for _ in range(900):  # chains of near copies, and a dense ball
        x = int(near[-1] if near and rng.random() < 0.5 else base[rng.integers(0, 60)])
        for b in rng.choice(64, rng.integers(1, 6), replace=False):
            x ^= 1 << int(b)
        near.append(x)
    fps = np.unique(np.concatenate([base, np.array(near, np.uint64)]))
    table = spark.createDataFrame([(int(v),) for v in fps.view(np.int64)], "fp bigint")
    got = {r["node"]: r["root"] for r in sh.components(sh.hamming_links(table)).collect()}
    close = np.argwhere(np.bitwise_count(fps[:, None] ^ fps[None, :]) <= 4)
    want = cases.groups(len(fps), [(a, b) for a, b in close.tolist() if a < b])
    roots = [got.get(int(v), int(v)) for v in fps.view(np.int64)]
    assert len(set(zip(roots, want))) == len(set(roots)) == len(set(want))


def test_keep_first_leaves_one_of_each_group(spark):
    docs = cases.documents(spark)
    kept = sh.keep_first(docs)
    assert kept.columns == docs.columns
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    want = {c for _, _, c in expected(rows) if c is not None}
    ids = [r["doc_id"] for r in kept.select("doc_id").collect()]
    assert sorted(i for i in ids if i is not None) == sorted(want)
    assert ids.count(None) == len({c for _, _, c in expected(rows) if c is None})


def test_components_of_a_long_chain_and_a_star(spark):
    chain = spark.range(300).select(F.col("id").alias("a"), (F.col("id") + 1).alias("b"))
    star = spark.range(1000, 1500).select(F.lit(5000).cast("bigint").alias("a"), F.col("id").alias("b"))
    roots = {r["node"]: r["root"] for r in sh.components(chain.union(star)).collect()}
    assert len(roots) == 301 + 501
    assert len({roots[i] for i in range(301)}) == 1 and len({roots[i] for i in [5000, *range(1000, 1500)]}) == 1
    assert roots[0] != roots[5000]
