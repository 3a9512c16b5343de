"""M9: neighbours within a class against brute force; interpolated rows."""

import tracemalloc

import numpy as np
import pandas as pd
import pytest

from tidemark.operators import neighbours as nb

SCHEMA = "row_id bigint, vector array<double>, label string, cell int"


def brute(rows, k):
    out = {}
    for i, v, c, _ in rows:
        if c is None or v is None or i is None or not all(x is not None and np.isfinite(x) for x in v):
            continue
        same = [(float(np.sqrt(((np.array(v) - np.array(w)) ** 2).sum())), j) for j, w, d, _ in rows
                if d == c and j is not None and j != i and w is not None and all(x is not None and np.isfinite(x) for x in w)]
        out.update({(i, rank + 1): x for rank, x in enumerate(sorted(same)[:k])})
    return out


def test_neighbours_equal_brute_force(spark, monkeypatch):
    monkeypatch.setattr(nb, "BLOCK", 25)
    monkeypatch.setattr(nb, "PIVOTS", 7)
    rng = np.random.default_rng(12)
    spots = rng.normal(size=(6, 3)) * 8
    x = np.concatenate([spots[rng.integers(0, 6, 260)] + rng.normal(size=(260, 3)), np.tile(spots[0], (90, 1)),
                        rng.integers(0, 3, (40, 3)).astype(float)])  # copies of one vector, and ties
    label = np.where(np.arange(len(x)) % 5 == 0, "rare", "common").tolist()
    rows = [(int(i), v.tolist(), c, 1) for i, (v, c) in enumerate(zip(x, label))]
    rows += [(1000, None, "rare", 1), (1001, [1.0, float("nan"), 0.0], "rare", 1), (1002, [0.0, 0.0, 0.0], None, 1), (None, [0.0, 0.0, 0.0], "rare", 1),
             (1003, [1.0, 2.0, 3.0], "lone", 1), (1004, [1.0, 2.0, 3.0], "two", 1), (1005, [2.0, 2.0, 3.0], "two", 1)]
    got = {(r["id"], r["rank"]): (r["distance"], r["neighbour"]) for r in nb.class_neighbours(spark.createDataFrame(rows, SCHEMA), 4).collect()}
    want = brute(rows, 4)
    assert got.keys() == want.keys()
    assert all(got[key][1] == want[key][1] and got[key][0] == pytest.approx(want[key][0], abs=1e-9) for key in want)


def test_oversample_fills_every_class(spark):
    rng = np.random.default_rng(3)
    label = ["a"] * 40 + ["b"] * 9 + ["c"] * 3
    rows = [(i, rng.normal(size=2).tolist(), c, 1) for i, c in enumerate(label)]
    df = spark.createDataFrame(rows, SCHEMA)
    made = nb.oversample(df).collect()
    assert {c: sum(r["label"] == c for r in made) for c in "abc"} == {"a": 0, "b": 31, "c": 37}
    at, near = {r[0]: np.array(r[1]) for r in rows}, brute(rows, 2)  # the smallest class leaves two neighbours
    for r in made:
        assert r["neighbour_id"] in [near[r["base_id"], k][1] for k in (1, 2)] and 0 <= r["gap"] < 1
        assert np.allclose(r["vector"], at[r["base_id"]] + r["gap"] * (at[r["neighbour_id"]] - at[r["base_id"]]))
    assert len({r["base_id"] for r in made if r["label"] == "b"}) > 4
    with pytest.raises(ValueError):
        nb.oversample(spark.createDataFrame(rows[:41], SCHEMA))


def peak_mb(work) -> float:
    tracemalloc.start()
    try:
        work()
        return tracemalloc.get_traced_memory()[1] / 2 ** 20
    finally:
        tracemalloc.stop()


@pytest.mark.parametrize("spots", [1, 8192])
def test_a_block_needs_little_memory(spots):
    """A full block with copies, all at one distance or all different: a bounded piece of distances at a time."""
    rng = np.random.default_rng(1)
    x = rng.normal(size=(spots, 64))[np.arange(8192) % spots]
    members = pd.DataFrame({"vector": list(x), "ids": [np.arange(6) + 6 * i for i in range(8192)]})
    assert peak_mb(lambda: nb._nearest(np.arange(2048), x[:2048] + 1, members, 5)) < 160


def test_visits_need_little_memory():
    """A full batch of one class in which every row asks every cell: one row out per row in."""
    rng = np.random.default_rng(2)
    rows = pd.DataFrame({"label": "a", "vector": list(rng.normal(size=(10_000, 64))), "uid": np.arange(10_000), "home": 0, "bound": 50.0, "mine": 0})
    pivots, cells = {"a": rng.normal(size=(64, 64))}, {"a": (np.arange(64), np.full(64, 9.0), np.full(64, 100))}
    sizes = []
    assert peak_mb(lambda: sizes.extend(len(g) for g in nb._visits(iter([rows]), pivots, cells, 5))) < 60
    assert sum(sizes) == 10_000 and max(sizes) <= 1000
    assert all(len(c) == 64 for g in nb._visits(iter([rows[:300]]), pivots, cells, 5) for c in g["cells"])


def test_rows_at_one_distance_are_cut_into_blocks(spark, monkeypatch):
    """Vectors that all lie equally far from their pivot do not gather in one block."""
    monkeypatch.setattr(nb, "BLOCK", 20)
    monkeypatch.setattr(nb, "PIVOTS", 1)
    seen, ranged = [], nb.ranged

    def watched(*args, **kwargs):
        seen.append(ranged(*args, **kwargs))
        return seen[-1]

    monkeypatch.setattr(nb, "ranged", watched)
    rows = [(i, [float(j == i) for j in range(200)], "a", 1) for i in range(200)]  # all 2 ** 0.5 apart
    got = {(r["id"], r["rank"]): r["neighbour"] for r in nb.class_neighbours(spark.createDataFrame(rows, SCHEMA), 3).collect()}
    assert got == {key: want[1] for key, want in brute(rows, 3).items()}
    assert max(r["count"] for r in seen[0].groupBy("label", "cell", "block").count().collect()) < 100


def test_empty_table(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert nb.class_neighbours(empty).count() == 0 and nb.oversample(empty).count() == 0
