"""Gram-matrix ridge selection against a direct NumPy implementation (layer 2)."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.conftest import SF_SMALL
from tidemark.operators import models
from tidemark.plans import q_models


def _ridge_fit(X, y, classes, alpha):
    Y = np.where(y[:, None] == np.array(classes)[None, :], 1.0, -1.0)
    mx, my = X.mean(0), Y.mean(0)
    Xc, Yc = X - mx, Y - my
    W = np.linalg.solve(Xc.T @ Xc + alpha * np.eye(X.shape[1]), Xc.T @ Yc)
    return W, my - mx @ W


def _macro_f1(y, p):
    labels = sorted(set(y) | set(p))
    f = []
    for c in labels:
        tp = np.sum((y == c) & (p == c))
        den = np.sum(y == c) + np.sum(p == c)
        f.append(2 * tp / den if den else 0.0)
    return float(np.mean(f))


def test_ridge_grid_matches_numpy(spark):
    data = q_models.feature_table(spark, SF_SMALL).filter((F.col("lookback") == 336) & (F.col("decay_lambda") == 0.05))
    res = models.ridge_grid_search(data, q_models.FEATURES).collect()[0]
    pdf = data.orderBy("ts").toPandas()
    X = pdf[q_models.FEATURES].to_numpy(float)
    y = pdf[models.TARGET].to_numpy(int)
    n = len(y)
    tr, va = int(n * 0.7), int(n * 0.7) + int(n * 0.2)
    Xt, yt = X[:tr], y[:tr]
    classes = sorted(set(yt))
    k = 5
    ts = tr // (k + 1)
    starts = [tr - (k - i) * ts for i in range(k)]
    scores = []
    for a in models.ALPHAS:
        fs = []
        for s in starts:
            W, b = _ridge_fit(Xt[:s], yt[:s], classes, a)
            pred = np.array(classes)[np.argmax(Xt[s:s + ts] @ W + b, axis=1)]
            fs.append(_macro_f1(yt[s:s + ts], pred))
        scores.append(np.mean(fs))
    best = int(np.argmax(np.round(scores, 12)))
    W, b = _ridge_fit(Xt, yt, classes, models.ALPHAS[best])
    pv = np.array(classes)[np.argmax(X[tr:va] @ W + b, axis=1)]
    assert res["best_alpha"] == pytest.approx(models.ALPHAS[best])
    assert res["cv_macro_f1"] == pytest.approx(scores[best], abs=1e-9)
    assert res["val_accuracy"] == pytest.approx(np.mean(pv == y[tr:va]), abs=1e-12)
    assert res["val_macro_f1"] == pytest.approx(_macro_f1(y[tr:va], pv), abs=1e-9)


def test_search_budget_is_the_configured_one(spark):
    from tidemark.operators import boosting, learners
    assert q_models.SEARCH_DRAWS == 80 and len(learners.param_grid(boosting.STACK_GRID)) == 27
    d, _ = q_models.modeling_table(spark, SF_SMALL)
    _, folds = q_models._train_folds(d)
    got = {(r["fold"], r["role"]): (r["n"], r["last"]) for r in
           folds.groupBy("fold", "role").agg(F.count("*").alias("n"), F.max("row_index").alias("last")).collect()}
    assert got == {(f, role): x for f in range(8) for role, x in
                   (("train", (336 + 72 * f, 335 + 72 * f)), ("test", (72, 407 + 72 * f)))}


def test_ridge_skips_what_cannot_be_fitted_and_fits_the_rest(spark):
    """Parameter sets of all sizes in one job: each gets its figures or its reason, none ends the job."""
    rng = np.random.default_rng(4)
    sets = {1: rng.integers(-1, 2, 60), 2: np.ones(40, int), 3: np.array([1, -1, 1]), 4: np.array([0, 1, 0, 1, 0, 1, 1, 0]),
            5: np.array([0, 1, 1, 0, 1])}
    rows = [(key, t, float(rng.normal()) if t % 7 else None, float("nan") if t % 11 == 3 else float(v + rng.normal()), int(v))
            for key, ys in sets.items() for t, v in enumerate(ys)]
    rows += [(6, t, 0.5, 0.5, None) for t in range(9)]  # no target at all
    data = spark.createDataFrame(rows, "set int, at int, a double, b double, goal int")
    res = {r["set"]: r for r in models.ridge_grid_search(data, ["a", "b"], ["set"], "goal", "at", train_ratio=0.4, val_ratio=0.4).collect()}
    reasons = {2: "Training split lacks class diversity", 3: "Training split lacks class diversity", 6: "Training split lacks class diversity",
               5: "Insufficient data for expanding-window CV"}
    assert {k: r["skip_reason"] for k, r in res.items()} == {k: reasons.get(k) for k in (1, 2, 3, 4, 5, 6)}
    for key in reasons:
        assert all(res[key][c] is None for c in ("best_alpha", "cv_macro_f1", "val_accuracy", "val_macro_f1", "n_train", "n_val"))
    for key in (1, 4):
        X = np.nan_to_num(np.array([[r[2] if r[2] is not None else 0.0, r[3]] for r in rows if r[0] == key]))
        y = sets[key]
        tr = int(len(y) * 0.4)
        va = tr + int(len(y) * 0.4)
        k = min(5, tr - 1)
        size = tr // (k + 1)
        scores, seen = [], sorted(set(y[:tr]))
        for alpha in models.ALPHAS:
            fs = []
            for s in range(tr - k * size, tr, size):
                W, b = _ridge_fit(X[:s], y[:s], seen, alpha)
                fs.append(_macro_f1(y[s:s + size], np.array(seen)[np.argmax(X[s:s + size] @ W + b, axis=1)]))
            scores.append(np.mean(fs))
        best = int(np.argmax(np.round(scores, 12)))
        W, b = _ridge_fit(X[:tr], y[:tr], seen, models.ALPHAS[best])
        pred = np.array(seen)[np.argmax(X[tr:va] @ W + b, axis=1)]
        assert res[key]["best_alpha"] == pytest.approx(models.ALPHAS[best]) and res[key]["n_train"] == tr and res[key]["n_val"] == va - tr
        assert res[key]["cv_macro_f1"] == pytest.approx(scores[best], abs=1e-9)
        assert res[key]["val_accuracy"] == pytest.approx(np.mean(pred == y[tr:va]))


def test_ridge_reasons_when_nothing_can_be_fitted(spark):
    data = spark.createDataFrame([(1, t, 1.0, 1) for t in range(8)] + [(2, t, 1.0, t % 2) for t in range(4)], "set int, at int, a double, goal int")
    res = {r["set"]: r for r in models.ridge_grid_search(data, ["a"], ["set"], "goal", "at").collect()}
    assert res[1]["skip_reason"] == "Training split lacks class diversity" and res[2]["skip_reason"] == "Validation split is empty"
    assert models.ridge_grid_search(data.limit(0), ["a"], ["set"], "goal", "at").count() == 0
