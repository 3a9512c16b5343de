import numpy as np

from tests.llm import cases
from tidemark.llm import collision_projections as cp


def expected(rows):
    ok = [(i, v) for i, (_, v) in enumerate(rows) if v and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    links, pairs = [0] * len(rows), []
    for k, (i, v) in enumerate(ok):
        a = np.array(v, float)
        for j, w in ok[:k]:
            if len(w) == len(v):
                b = np.array(w, float)
                if a @ b / np.linalg.norm(a) / np.linalg.norm(b) >= 0.95:
                    links[i] += 1
                    links[j] += 1
                    pairs.append((i, j))
    least = cases.groups(len(rows), pairs)
    first = {}
    for (vec, _), g in zip(rows, least):
        if vec is not None:
            first[g] = min(vec, first.get(g, vec))
    return sorted(((vec, n, first.get(g)) for (vec, _), n, g in zip(rows, links, least)), key=repr)


def found(spark, rows):
    table = spark.createDataFrame([(*r, "x", 1) for r in rows], "vec_id bigint, embedding array<float>, cid string, n int")
    return sorted(((r["vec_id"], r["n_links"], r["component_id"]) for r in cp.near_duplicates(table).collect()), key=repr)


def test_matches_brute_force_in_many_chunks(spark, monkeypatch):
    monkeypatch.setattr(cp, "CHUNK", 40)
    rng = np.random.default_rng(4)
    base = cases.unit(rng, 150, 32)
    near = base[rng.integers(0, 150, 250)] + rng.standard_normal((250, 32)) * 0.02
    dense = base[0] + rng.standard_normal((120, 32)) * 0.01
    x = np.concatenate([base, near, dense, dense[:20], 3 * base[:10]]).astype(np.float32)
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    assert found(spark, rows) == expected(rows)


def test_edges(spark):
    v = [1.0, 2.0, 3.0]
    rows = [(0, None), (1, []), (2, [0.0, 0.0, 0.0]), (3, v), (4, v), (5, [2.0, 4.0, 6.0]), (6, [float("nan"), 1.0, 1.0]),
            (7, [float("inf"), 1.0, 1.0]), (8, [None, 1.0, 1.0]), (None, v), (9, [1.0, 2.0]), (10, [1.0, 2.0]), (11, [-1.0, -2.0, -3.0]),
            (12, [1e30, 2e30, 3e30]), (3, v)]
    assert found(spark, rows) == expected(rows)


def test_empty_table(spark):
    assert cp.near_duplicates(spark.createDataFrame([], "vec_id bigint, embedding array<float>")).count() == 0


def test_count_is_calibrated():
    rng = np.random.default_rng(8)
    a = cases.unit(rng, 4000, 48)
    b = 0.95 * a + np.sqrt(1 - 0.95 ** 2) * np.stack([(lambda t: t / np.linalg.norm(t))(u - (u @ v) * v) for u, v in zip(cases.unit(rng, 4000, 48), a)])
    d = np.abs((a - b) @ cp.directions(48)) <= cp.window_width(0.95)
    assert (d.sum(axis=1) >= cp.least_count(cp.PROJECTIONS)).mean() >= 0.99


def border_pairs(rng, n, dim):
    a = cases.unit(rng, n, dim)
    side = cases.unit(rng, n, dim)
    side -= (side * a).sum(axis=1, keepdims=True) * a
    return a, 0.9501 * a + np.sqrt(1 - 0.9501 ** 2) * side / np.linalg.norm(side, axis=1, keepdims=True)


def test_recall_at_the_threshold(spark):
    """Grids and count together keep 0.99 of the pairs whose cosine is just 0.95."""
    a, b = border_pairs(np.random.default_rng(5), 1500, 48)
    rows = [(i, v.tolist()) for i, v in enumerate(np.concatenate([a, b]))]
    table = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>")
    assert cp.near_duplicates(table).where("n_links > 0").count() >= 0.99 * 3000


def test_meetings_stay_flat():
    """Pairs that share a cell, per vector, do not follow the number of vectors."""
    rng, seen = np.random.default_rng(6), []
    for n in (5_000, 50_000):
        x = cases.unit(rng, n, 64)
        d = np.sqrt(2 - 2 * (x[:400] @ x[:400].T)[np.triu_indices(400, 1)])
        shape = cp.grid_shape(n, d, 0.95)
        meets = sum((np.unique(cp.cell_keys(x, shape, g), return_counts=True)[1] ** 2).sum() for g in range(shape[1]))
        seen.append(meets / n)
    assert seen[1] <= 3 * seen[0] and seen[1] <= 0.12 * 50_000


def test_lengths_share_no_cell_and_extra_columns(spark):
    rows = [(1, [1.0], 5, 0), (2, [2.0], 5, 0), (3, [-1.0], 5, 0), (4, [1.0, 0.0], 5, 0), (5, [1.0, 1e-9], 5, 0)]
    table = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>, cid bigint, root int")
    got = {r["vec_id"]: (r["n_links"], r["component_id"]) for r in cp.near_duplicates(table).collect()}
    assert got == {1: (1, 1), 2: (1, 1), 3: (0, 3), 4: (1, 4), 5: (1, 4)}
