import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.operators import boosting, eda, learners
from tidemark.plans import scan


@pytest.fixture(scope="module")
def toy(spark):
    rng = np.random.default_rng(4)
    n = 700
    x = rng.normal(size=(n, 3))
    y = (x[:, 0] > 0.2).astype(int) + (x[:, 1] + 0.1 * rng.normal(size=n) > 0.5).astype(int)
    rows = [(i, float(y[i]), *[float(v) for v in x[i]]) for i in range(n)]
    return spark.createDataFrame(rows, "row_index bigint, label double, a double, b double, c double")


def plain_round(bins, grad, curv, depth, lam, gamma, least):
    """One tree of one class by recursion over row sets."""
    out = np.zeros(len(bins))

    def grow(rows, d):
        g, h = grad[rows].sum(), curv[rows].sum()
        out[rows] = -g / (h + lam)
        best = (gamma, None)
        if d < depth:
            for f in range(bins.shape[1]):
                for cut in range(bins[:, f].max() + 1):
                    left = bins[rows, f] <= cut
                    a, b = rows[left], rows[~left]
                    if curv[a].sum() < least or curv[b].sum() < least:
                        continue
                    gain = grad[a].sum() ** 2 / (curv[a].sum() + lam) + grad[b].sum() ** 2 / (curv[b].sum() + lam) - g ** 2 / (h + lam)
                    if gain > best[0] + 1e-9:
                        best = (gain, (a, b))
        if best[1]:
            grow(best[1][0], d + 1)
            grow(best[1][1], d + 1)

    grow(np.arange(len(bins)), 0)
    return out


def test_a_round_grows_the_plain_trees():
    rng = np.random.default_rng(1)
    bins = rng.integers(0, 6, (90, 3))
    grad, curv = rng.normal(size=(3, 90)), rng.uniform(0.1, 1, (3, 90))
    p = {"max_depth": 3, "reg_lambda": 1.5, "gamma": 0.3, "min_child_weight": 4}
    got = boosting._round(bins, np.arange(90), grad, curv, np.arange(3), p, 6)
    for k in range(3):
        assert np.allclose(got[k], plain_round(bins, grad[k], curv[k], 3, 1.5, 0.3, 4))


def test_leaf_limit_and_early_stop():
    rng = np.random.default_rng(2)
    bins, y = rng.integers(0, 30, (400, 4)), rng.integers(0, 3, 400)
    p = {"max_depth": 9, "num_leaves": 5, "min_child_weight": 1e-3}
    got = boosting._round(bins, np.arange(400), rng.normal(size=(3, 400)), np.ones((3, 400)), np.arange(4), p, 30)
    assert all(len(set(np.round(got[k], 12))) <= 5 for k in range(3))
    role = np.repeat([0, 1, 2], [200, 100, 100])
    _, rounds = boosting.fit_predict(bins, y, role, {"n_estimators": 300, "max_depth": 4, "learning_rate": 0.3}, 1, n_bins=30)
    assert 1 <= rounds < 100  # labels are noise: more rounds only fit the training rows


def test_search_learns_and_ranks(spark, toy):
    n = toy.count()
    folds = spark.createDataFrame([(f, "train" if i < 300 + 100 * f else "test", i) for f in range(3) for i in range(400 + 100 * f)],
                                  "fold int, role string, row_index bigint")
    settings = [{"n_estimators": 40, "max_depth": 3, "learning_rate": 0.2}, {"n_estimators": 1, "max_depth": 1, "learning_rate": 0.01}]
    rows = boosting.fold_rows(toy, folds, ["a", "b", "c"], toy.where("row_index >= 600"), stop_rows=60)
    assert rows.where("role = 2").count() == 3 * 60 and n == 700
    scores = boosting.search(rows, settings)
    assert scores.count() == 6
    best = boosting.summary(scores, settings).where("is_best").collect()
    assert len(best) == 1 and best[0]["candidate"] == 0 and best[0]["mean_score"] > 0.85
    again = boosting.search(rows.orderBy(F.rand(7)), settings)
    assert sorted(map(tuple, again.collect())) == sorted(map(tuple, scores.collect()))
    curve = boosting.learning_curve(rows, settings[0], (0.1, 1.0)).orderBy("fraction").collect()
    assert [r["n_train"] for r in curve] == [30, 300] and curve[1]["test_mean"] > curve[0]["test_mean"]


def test_folds_beyond_the_bound_raise(spark, toy, monkeypatch):
    folds = spark.createDataFrame([(0, "train" if i < 300 else "test", i) for i in range(400)], "fold int, role string, row_index bigint")
    rows = boosting.fold_rows(toy, folds, ["a", "b", "c"])
    one = boosting._evaluate([{"n_estimators": 1, "max_depth": 1, "learning_rate": 0.1}], 64, 1)
    monkeypatch.setattr(boosting, "MAX_FOLD_ROWS", 10)
    with pytest.raises(ValueError, match="more than 10 rows"):
        one(rows.withColumn("candidate", F.lit(0)).toPandas())


@pytest.fixture(scope="module")
def forest(toy):
    return learners.fit_forest(toy, ["a", "b", "c"], {"numTrees": 8, "maxDepth": 3, "subsamplingRate": 0.8, "minInstancesPerNode": 2,
                                                      "featureSubsetFraction": 0.9})


def test_dependence_by_intervals_equals_copies_per_point(spark, toy, forest):
    from pyspark.ml.functions import vector_to_array
    small = toy.limit(60)
    got = learners.partial_dependence(forest, small, ["a", "b", "c"], ["a", "c"], grid_resolution=25).collect()
    assert len(got) == 50
    arr = vector_to_array("probability")
    for r in got[::7]:
        one = forest.transform(learners.vectorise(small.withColumn(r["feature"], F.lit(r["value"])), ["a", "b", "c"]))
        want = one.agg(*[F.avg(arr[i]) for i in range(3)]).first()
        assert [r[f"avg_proba_{i}"] for i in range(3)] == pytest.approx(list(want), abs=1e-9)


@pytest.mark.parametrize("n", [1, 2, 3, 7, 64, 65, 1000])
def test_permuted_is_a_bijection(spark, n):
    rows = spark.range(n).select("id", *[learners.permuted(F.col("id"), n, F.lit(k)).alias(f"p{k}") for k in range(3)]).toPandas()
    for k in range(3):
        assert sorted(rows[f"p{k}"]) == list(range(n))
    if n >= 64:
        assert list(rows["p0"]) != list(rows["id"]) and list(rows["p0"]) != list(rows["p1"])
        # four standard deviations of a random permutation's correlation
        assert abs(np.corrcoef(rows["p0"], rows["id"])[0, 1]) < 4 / np.sqrt(n)


def test_permutation_importance_finds_the_used_features(toy, forest):
    got = {r["feature"]: r for r in learners.permutation_importance(forest, toy, ["a", "b", "c"], "row_index", n_repeats=4).collect()}
    assert got["a"]["importance_mean"] > 0.1 and got["b"]["importance_mean"] > 0.1 > abs(got["c"]["importance_mean"]) * 2
    assert all(r["n_repeats"] == 4 for r in got.values())


def test_quantile_table_and_ranked_rows(spark):
    rng = np.random.default_rng(8)
    a, b = np.round(rng.exponential(size=501), 2), np.full(501, 3.0)
    df = spark.createDataFrame([(i, float(a[i]), float(b[i]), None) for i in range(501)], "i bigint, a double, b double, c double").repartition(7)
    probs = [0.0, 0.05, 0.5, 0.95, 1.0]
    got = eda.exact_quantile_table(df, ["a", "b", "c"], probs, bins=16)
    assert got["a"] == pytest.approx(np.quantile(a, probs).tolist()) and got["b"] == [3.0] * 5 and got["c"] == [None] * 5
    ranks = scan.ranked_rows(df.where("i % 7 < 5"), ["a", "i"]).orderBy("rank").collect()
    want = sorted((a[i], i) for i in range(501) if i % 7 < 5)
    assert [(r["rank"], r["a"], r["i"]) for r in ranks] == [(k, *x) for k, x in enumerate(want)]


def test_prefix_sums_and_neighbours_cross_ranges(spark):
    rng = np.random.default_rng(3)
    rows = [("hot" if i < 400 else None if i < 450 else f"k{i % 4}", int(i), int(rng.integers(0, 9)), float(i) if rng.random() < 0.1 else None)
            for i in range(500)]
    df = spark.createDataFrame(rows, "k string, i bigint, v bigint, w double").repartition(5)
    d = scan.ranged(df, ["k", "i"], n=9)
    assert d.select("_part").distinct().count() > 5
    got = {r["i"]: r for r in scan.neighbours(scan.prefix_sums(d, ["k"], ["i"], {"below": "v"}), ["k"], ["i"], ["w"]).collect()}
    assert len(got) == 500
    for k, i, _, _ in rows:
        same = [r for r in rows if r[0] == k]
        before, after = [r[3] for r in same if r[1] < i and r[3] is not None], [r[3] for r in same if r[1] > i and r[3] is not None]
        assert got[i]["below"] == sum(r[2] for r in same if r[1] < i)
        assert got[i]["prev_w"] == (before[-1] if before else None) and got[i]["next_w"] == (after[0] if after else None)


def test_crowded_scores_spread_and_match(spark):
    """All scores within a thousandth of 1 spread over the ranges; areas equal the pairwise count."""
    from tidemark.operators import classify_metrics as cm
    rng = np.random.default_rng(2)
    y = rng.integers(0, 3, 400)
    p = 1 - rng.integers(0, 150, (400, 3)) / 1e6 + (np.arange(3) == y[:, None]) * 3e-5
    pred = spark.createDataFrame([("m", i, int(y[i]), [float(v) for v in p[i]]) for i in range(400)], "model string, row_id long, y_true long, proba array<double>")
    d = scan.ranged(pred.select(F.col("proba")[0].alias("s")).distinct(), ["s"], n=8)
    sizes = [r["count"] for r in d.groupBy("_part").count().collect()]
    assert len(sizes) >= 6 and max(sizes) <= 3 * sum(sizes) / len(sizes)

    def auc(pos, neg):
        return np.mean([(a > b) + 0.5 * (a == b) for a in pos for b in neg])

    areas = {r["cls"]: r["auc"] for r in cm.roc_points(pred).collect()}
    assert areas == pytest.approx({c: auc(p[y == c, c], p[y != c, c]) for c in range(3)})
    pairs = [(a, b) for a in range(3) for b in range(a + 1, 3)]
    want = np.mean([(auc(p[y == a, a], p[y == b, a]) + auc(p[y == b, b], p[y == a, b])) / 2 for a, b in pairs])
    assert cm.ovo_auc(pred).first()["auc_ovo"] == pytest.approx(want)


def test_reduction_per_key(spark):
    """T6 in M1: orthonormal axes by falling variance, the variance NumPy captures, scores of the centred rows."""
    from tidemark.operators import vectors
    rng = np.random.default_rng(11)
    groups = {("a", 1): rng.normal(size=(80, 6)) @ rng.normal(size=(6, 6)), ("a", 2): rng.normal(size=(50, 6)) * [5, 4, 3, 2, 1, 0],
              (None, 1): rng.normal(size=(9, 6)) + 100}
    rows = [(*key, i, [float(v) for v in x]) for key, m in groups.items() for i, x in enumerate(m)]
    df = spark.createDataFrame(rows, "g string, h int, i int, x array<double>").repartition(6)
    scores, axes = vectors.pca_by_key(df, ["g", "h"], "x", 3)
    found = {(r["g"], r["h"]): r for r in axes.collect()}
    assert set(found) == set(groups) and scores.count() == len(rows)
    for key, m in groups.items():
        a = np.array(found[key]["axes"])
        assert np.allclose(a @ a.T, np.eye(3), atol=1e-9) and np.allclose(found[key]["center"], m.mean(axis=0))
        values = np.sort(np.linalg.eigvalsh(np.cov(m.T)))[::-1]
        assert np.allclose(found[key]["share"], values[:3] / values.sum(), atol=1e-6)
        z = {r["i"]: r["z"] for r in scores.where(F.col("g").eqNullSafe(key[0]) & (F.col("h") == key[1])).collect()}
        assert np.allclose([z[i] for i in range(len(m))], (m - m.mean(axis=0)) @ a.T, atol=1e-6)
        assert all(row[np.abs(row).argmax()] > 0 for row in a)


def test_whole_table_reduction_keeps_the_variance(spark):
    """Scores of the table-wide reduction are uncorrelated and hold the leading variance."""
    from tests.conftest import SF_SMALL
    from tidemark.plans import registry
    from tidemark.sources import tables as T
    z = registry.queries()["t6_pca_reduce"](spark, SF_SMALL).toPandas().drop(columns="article_id").to_numpy()
    x = np.vstack(T.embedded_news(spark, SF_SMALL).select("embedding").toPandas()["embedding"].to_numpy())
    cov = np.cov(z.T)
    assert z.shape[1] == 20 and np.allclose(cov - np.diag(np.diag(cov)), 0, atol=1e-6)
    assert np.allclose(np.diag(cov), np.sort(np.linalg.eigvalsh(np.cov(x.T)))[::-1][:20], rtol=1e-4)


def test_scoring_inputs_fill_and_encode(spark):
    df = spark.createDataFrame([(1, None, 2.0, -1), (2, 3.0, None, 1), (3, 1.0, 1.0, None)], "ts int, a double, b double, y int")
    art = {"test_df": df, "manifest": {"features": ["b", "a"], "classes": [-1, 0, 1]}}
    rows = learners.scoring_inputs(art, target="y")[0].orderBy("ts").collect()
    assert [tuple(r) for r in rows] == [(1, 0, 2.0, 0.0), (2, 2, 0.0, 3.0), (3, None, 1.0, 1.0)]
    art["test_df"] = df.withColumn("y", F.lit(9))
    with pytest.raises(Exception, match="unknown class 9"):
        learners.scoring_inputs(art, target="y")[0].collect()


def test_values_outside_of_a_fixed_list_raise(spark):
    from tidemark.operators import decay
    df = spark.createDataFrame([(1, "a", 1.0), (1, "zz", 2.0)], "ts int, topic string, weight double")
    assert decay.topic_features_wide(df, ["a", "zz"]).collect()[0]["zz"] == 2.0
    with pytest.raises(Exception, match="outside of the list"):
        decay.topic_features_wide(df, ["a"]).collect()


def test_top_sets_follow_the_grid_search(spark):
    """K3: the best rows of M3's table, in its order."""
    from tests.conftest import SF_SMALL
    from tidemark.plans import registry
    q = registry.queries()
    every, top = q["m3_ridge_grid_search"](spark, SF_SMALL).toPandas(), q["k3_top_parameter_sets"](spark, SF_SMALL).toPandas()
    assert len(every) == 30 and len(top) == 5
    score = next(c for c in ("cv_macro_f1", "val_macro_f1") if c in every.columns)
    assert sorted(top[score], reverse=True) == sorted(every[score], reverse=True)[:5]


def test_projection_keeps_the_ten_most_frequent_labels(spark):
    """Coordinates on the two leading axes of all vectors, points of the top labels only."""
    from tidemark.operators import vectors
    rng = np.random.default_rng(8)
    labels = [f"t{k:02d}" for k in range(14) for _ in range(3 + (k * 5) % 7)] + [None] * 40
    x = rng.normal(size=(len(labels), 5)) * [5, 3, 1, 1, 1]
    rows = [(i, t, [float(v) for v in x[i]]) for i, t in enumerate(labels)] + [(-1, "t00", None)]
    df = spark.createDataFrame(rows, "id int, topic string, embedding array<float>").repartition(5)
    got = {r["id"]: r for r in vectors.top_label_projection(df, ["id"], "topic").collect()}
    counts = {t: sum(r[1] == t for r in rows) for t in labels if t}
    top = sorted(counts, key=lambda t: (-counts[t], t))[:10]
    assert set(got) == {i for i, t in enumerate(labels) if t in top}
    x = x.astype(np.float32).astype(float)
    values, axes = np.linalg.eigh(np.cov(x.T))
    want = (x - x.mean(axis=0)) @ axes[:, ::-1][:, :2]
    for axis in range(2):
        sign = 1 if axes[:, ::-1][np.abs(axes[:, ::-1][:, axis]).argmax(), axis] > 0 else -1
        assert np.allclose([got[i][f"x{axis}"] for i in sorted(got)], sign * want[sorted(got), axis], atol=1e-6)
    assert all(r["label_rank"] == 1 + top.index(r["topic"]) and r["label_count"] == counts[r["topic"]] for r in got.values())


def test_stored_vectors_have_one_width(spark, tmp_path):
    """S3: nulls stay, another width raises."""
    from tidemark.operators import vectors
    spark.createDataFrame([(1, [1.0, 2.0]), (2, None)], "id int, embedding array<float>").write.parquet(str(tmp_path / "good"))
    assert sorted(vectors.read_vectors(spark, str(tmp_path / "good"), 2).collect())[1]["embedding"] is None
    spark.createDataFrame([(1, [1.0, 2.0]), (2, [1.0])], "id int, embedding array<float>").write.parquet(str(tmp_path / "bad"))
    with pytest.raises(Exception, match="Vector of 1 positions"):
        vectors.read_vectors(spark, str(tmp_path / "bad"), 2).select("embedding").collect()


def test_class_weights_over_a_label_list(spark):
    """absent labels count 0 and weigh as 1; unlisted and null classes raise."""
    from tidemark.operators import classify_metrics as cm
    df = spark.createDataFrame([("a", 0)] * 4 + [("a", 2)] * 2 + [("b", 1)], "g string, y int")
    got = {(r["g"], r["label"]): (r["count"], r["weight"]) for r in cm.class_weights(df, "y", 2.0, [0, 1, 2], ["g"]).collect()}
    assert got == {("a", 0): (4, 0.25), ("a", 1): (0, 4.0), ("a", 2): (2, 1.0), ("b", 0): (0, (1 / 3) ** 2),
                   ("b", 1): (1, (1 / 3) ** 2), ("b", 2): (0, (1 / 3) ** 2)}
    assert [(r["label"], r["count"], r["weight"]) for r in cm.class_weights(df.limit(0), "y", 1.0, [0, 1]).collect()] == [(0, 0, 0.0), (1, 0, 0.0)]
    for bad in (7, None):
        with pytest.raises(Exception, match="not among the labels"):
            cm.class_weights(df.union(spark.createDataFrame([("a", bad)], "g string, y int")), "y", 1.0, [0, 1, 2]).collect()
