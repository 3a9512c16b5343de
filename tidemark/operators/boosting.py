"""Histogram gradient boosting for parameter searches and learning curves.

A search is many small fits: each (candidate, fold) trains on the rows of one expanding fold,
whose number the splitter's settings fix (``min_train + n_splits * step``) whatever the size of
the table.  So Spark spreads the fits, not the rows of one fit: features are binned once (a
quantile aggregate and a projection), the fold rows are dealt to (candidate, fold) groups by
one shuffle, and every group is fitted and scored in its task.  Early stopping and the
tie-break score use at most ``stop_rows`` validation rows, chosen by a hash of their number.
A fold of more than ``MAX_FOLD_ROWS`` rows raises: a single fit over unbounded rows is
``learners.fit_forest``, which Spark ML grows level by level over the whole table.

Trees grow level by level from gradient and curvature histograms, second order with L1 and L2
terms, least child weight, least gain, a depth and an optional leaf limit; the classes' trees
of a round grow together.  Class weights are squared inverse frequencies (A24)."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MAX_FOLD_ROWS = 200_000
N_BINS = 64
STOP_ROWS = 500
STOP_ROUNDS = 20

# The first stage's search space (integers with their upper end excluded).
BOOST_SPACE = {
    "n_estimators": ("int", 100, 400), "max_depth": ("int", 2, 6), "learning_rate": ("log", 0.01, 0.15),
    "subsample": ("uniform", 0.5, 0.9), "colsample": ("uniform", 0.5, 0.9), "gamma": ("uniform", 0.5, 5.0),
    "min_child_weight": ("int", 3, 12), "reg_alpha": ("log", 1e-3, 1e1), "reg_lambda": ("log", 1e-2, 1e2),
}
# The second stage's grid of 27 settings.
STACK_GRID = {"num_leaves": [31, 50, 100], "max_depth": [5, 10, 15], "learning_rate": [0.01, 0.05, 0.1], "n_estimators": [100],
              "min_child_samples": [20], "subsample": [0.8], "colsample": [0.8]}


def sample_settings(n: int, seed: int = 42, space: dict = BOOST_SPACE) -> list[dict]:
    """Seeded draws from the search space, one dict per candidate."""
    rng = np.random.default_rng(seed)
    draw = {"int": lambda lo, hi: int(rng.integers(lo, hi)), "uniform": lambda lo, hi: float(rng.uniform(lo, hi)),
            "log": lambda lo, hi: float(np.exp(rng.uniform(np.log(lo), np.log(hi))))}
    return [{k: draw[kind](lo, hi) for k, (kind, lo, hi) in space.items()} for _ in range(int(n))]


def with_bins(df: DataFrame, features: Sequence[str], fit_on: DataFrame, n_bins: int = N_BINS, out: str = "bins") -> DataFrame:
    """Add ``out``: the bin number of every feature (nulls count as 0), from the quantiles of
    ``fit_on``, one aggregate for all features."""
    probs = [(k + 1) / n_bins for k in range(n_bins - 1)]
    filled = fit_on.na.fill(0.0, subset=list(features))
    row = filled.agg(*[F.percentile_approx(F.col(f"`{f}`").cast("double"), probs, 10_000).alias(f"q{i}")
                       for i, f in enumerate(features)]).first()
    cols = []
    for i, f in enumerate(features):
        borders = sorted(set(row[f"q{i}"] or []))
        value = F.coalesce(F.col(f"`{f}`").cast("double"), F.lit(0.0))
        cols.append(F.size(F.filter(F.array(*[F.lit(float(b)) for b in borders]), lambda b: b < value)) if borders else F.lit(0))
    return df.withColumn(out, F.array(*[c.cast("int") for c in cols]))


def _softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=0))
    return e / e.sum(axis=0)


def _round(bins, pos_rows, grad, curv, cols, p, n_bins):
    """One tree per class, grown together.  ``grad``/``curv``: (classes, sampled rows).  Returns
    the added score of every row of ``bins``, (classes, rows)."""
    k, n = len(grad), len(bins)
    lam, alpha, gamma = p.get("reg_lambda", 0.0), p.get("reg_alpha", 0.0), p.get("gamma", 0.0)
    least, leaf_rows = p.get("min_child_weight", 1e-3), p.get("min_child_samples", 1)
    limit = p.get("num_leaves", 1 << 30)
    used = bins[np.ix_(pos_rows, cols)].astype(np.int64) + np.arange(len(cols)) * n_bins
    width = len(cols) * n_bins
    node = np.tile(np.arange(k)[:, None], (1, n))
    feat, cut, left = [-1] * k, [0] * k, [-1] * k
    value = [0.0] * k
    leaves, first = np.ones(k, int), 0

    def shrunk(g):
        return np.sign(g) * np.maximum(np.abs(g) - alpha, 0.0)

    for depth in range(p["max_depth"] + 1):
        m = len(feat) - first
        if not m:
            break
        here = node[:, pos_rows] - first
        cls, row = np.nonzero(here >= 0)
        at = here[cls, row]
        g_sum = np.bincount(at, grad[cls, row], m)
        h_sum = np.bincount(at, curv[cls, row], m)
        value[first:] = (-shrunk(g_sum) / (h_sum + lam + 1e-12)).tolist()
        if depth == p["max_depth"]:
            break
        index = (at[:, None] * width + used[row]).ravel()
        shape = (m, len(cols), n_bins)
        g = np.bincount(index, np.repeat(grad[cls, row], len(cols)), m * width).reshape(shape).cumsum(axis=2)
        h = np.bincount(index, np.repeat(curv[cls, row], len(cols)), m * width).reshape(shape).cumsum(axis=2)
        g2, h2 = g_sum[:, None, None] - g, h_sum[:, None, None] - h
        gain = (shrunk(g) ** 2 / (h + lam + 1e-12) + shrunk(g2) ** 2 / (h2 + lam + 1e-12)
                - (shrunk(g_sum) ** 2 / (h_sum + lam + 1e-12))[:, None, None])
        allowed = (h >= least) & (h2 >= least)
        if leaf_rows > 1:
            c = np.bincount(index, minlength=m * width).reshape(shape).cumsum(axis=2)
            allowed &= (c >= leaf_rows) & (c[:, :, -1:] - c >= leaf_rows)
        gain = np.where(allowed, gain, -np.inf).reshape(m, -1)
        best = gain.argmax(axis=1)
        top = gain[np.arange(m), best]
        owner = np.empty(m, int)
        owner[at] = cls
        second, start = len(feat), first
        split = top > max(gamma, 1e-9)
        for j in np.argsort(-top, kind="stable").tolist():  # the leaf limit keeps the best splits
            if split[j] and leaves[owner[j]] >= limit:
                split[j] = False
            leaves[owner[j]] += bool(split[j])
        for j in np.flatnonzero(split).tolist():
            feat[start + j], cut[start + j], left[start + j] = int(cols[best[j] // n_bins]), int(best[j] % n_bins), len(feat)
            feat += [-1, -1]
            cut += [0, 0]
            left += [-1, -1]
            value += [0.0, 0.0]
        if second == len(feat):
            break
        f, t, down = np.array(feat), np.array(cut), np.array(left)
        moves = down[node] >= 0
        cls, row = np.nonzero(moves)
        old = node[cls, row]
        node[cls, row] = down[old] + (bins[row, f[old]] > t[old])
        first = second
    return np.array(value)[node]


def macro_f1(y: np.ndarray, pred: np.ndarray) -> float:
    """Mean F1 over the classes that occur in either."""
    scores = []
    for c in np.union1d(y, pred):
        both = np.sum((y == c) & (pred == c))
        scores.append(2 * both / (np.sum(y == c) + np.sum(pred == c)))
    return float(np.mean(scores)) if scores else 0.0


def fit_predict(bins: np.ndarray, y: np.ndarray, role: np.ndarray, p: dict, seed: int, n_classes: int = 3,
                n_bins: int = N_BINS) -> tuple[np.ndarray, int]:
    """Class scores (classes, rows) after boosting on the rows of role 0, and the number of rounds
    used: the round of least log loss on the rows of role 2 if there are any."""
    rng = np.random.default_rng(seed)
    train, stop = np.flatnonzero(role == 0), np.flatnonzero(role == 2)
    counts = np.maximum(np.bincount(y[train], minlength=n_classes), 1)
    weight = ((len(train) / (n_classes * counts)) ** 2)[y]
    onehot = (np.arange(n_classes)[:, None] == y).astype(float)
    z = np.zeros((n_classes, len(y)))
    best, best_loss, best_round = z, np.inf, 0
    for turn in range(p["n_estimators"]):
        some = train[rng.random(len(train)) < p.get("subsample", 1.0)]
        take = max(1, round(p.get("colsample", 1.0) * bins.shape[1]))
        cols = np.sort(rng.permutation(bins.shape[1])[:take])
        if not len(some):
            continue
        prob = _softmax(z[:, some])
        grad = (prob - onehot[:, some]) * weight[some]
        curv = np.maximum(2 * prob * (1 - prob) * weight[some], 1e-16)
        z = z + p["learning_rate"] * _round(bins, some, grad, curv, cols, p, n_bins)
        if len(stop):
            loss = -np.log(np.maximum(_softmax(z[:, stop])[y[stop], np.arange(len(stop))], 1e-15)).mean()
            if loss < best_loss:
                best, best_loss, best_round = z, loss, turn + 1
            elif turn + 1 - best_round >= STOP_ROUNDS:
                break
        else:
            best, best_round = z, turn + 1
    return best, best_round


_RESULT = ("candidate int, fold int, n_train int, n_rounds int, macro_f1 double, accuracy double, train_macro_f1 double, "
           "val_macro_f1 double")


def _evaluate(settings: list[dict], n_bins: int, seed: int):
    def one(pdf):
        import pandas as pd
        candidate, fold = int(pdf["candidate"].iloc[0]), int(pdf["fold"].iloc[0])
        # keyed by their own numbers, so that the dealt order of the rows does not matter
        pdf = pdf.sort_values(["role", "row_index"], kind="stable")
        role = pdf["role"].to_numpy()
        if (role != 2).sum() > MAX_FOLD_ROWS:
            raise ValueError(f"fold {fold} has more than {MAX_FOLD_ROWS} rows: fit a forest over the table instead")
        y = pdf["label"].to_numpy().astype(int)
        bins = np.vstack(pdf["bins"].to_numpy()).astype(np.int64)
        n_classes = max(2, int(y.max()) + 1)
        z, rounds = fit_predict(bins, y, role, settings[candidate], seed + 1000 * fold, n_classes, n_bins)
        pred = z.argmax(axis=0)
        score = {r: macro_f1(y[role == r], pred[role == r]) for r in (0, 1, 2)}
        hit = float(np.mean(y[role == 1] == pred[role == 1])) if (role == 1).any() else None
        return pd.DataFrame([(candidate, fold, int((role == 0).sum()), rounds, score[1], hit, score[0],
                              score[2] if (role == 2).any() else None)],
                            columns=["candidate", "fold", "n_train", "n_rounds", "macro_f1", "accuracy", "train_macro_f1", "val_macro_f1"])
    return one


def fold_rows(data: DataFrame, folds: DataFrame, features: Sequence[str], stop: DataFrame | None = None, *, label: str = "label",
              id_col: str = "row_index", n_bins: int = N_BINS, stop_rows: int = STOP_ROWS) -> DataFrame:
    """(fold, role, row_index, label, bins) of every fold row; role 0 trains, 1 tests, 2 stops."""
    from tidemark.session import cut_lineage
    rows = with_bins(data, features, data, n_bins).select(F.col(id_col).alias("row_index"), F.col(label).cast("int").alias("label"), "bins")
    out = folds.select("fold", F.when(F.col("role") == "train", 0).otherwise(1).alias("role"), F.col(id_col).alias("row_index")) \
        .join(rows, "row_index").select("fold", "role", "row_index", "label", "bins")
    if stop is not None:
        some = with_bins(stop, features, data, n_bins).select(F.col(id_col).alias("row_index"), F.col(label).cast("int").alias("label"), "bins")
        some = some.orderBy(F.xxhash64("row_index"), "row_index").limit(int(stop_rows))
        numbers = F.array(*[F.lit(r[0]) for r in folds.select("fold").distinct().orderBy("fold").collect()])  # n_splits numbers
        out = out.unionByName(some.select(F.explode(numbers).alias("fold"), F.lit(2).alias("role"), "row_index", "label", "bins"))
    return cut_lineage(out)


def search(rows: DataFrame, settings: Sequence[dict], seed: int = 42, n_bins: int = N_BINS) -> DataFrame:
    """M4/M5: scores of every (candidate, fold), one task group each."""
    from tidemark.session import cut_lineage, ship_package
    spark = rows.sparkSession
    ship_package(spark)
    spread = max(4 * spark.sparkContext.defaultParallelism, 64)  # equal shares of the fits, not of the bytes
    dealt = rows.withColumn("candidate", F.explode(F.sequence(F.lit(0), F.lit(len(settings) - 1)))).repartition(spread, "candidate", "fold")
    return cut_lineage(dealt.groupBy("candidate", "fold").applyInPandas(_evaluate(list(settings), n_bins, seed), _RESULT))


def summary(scores: DataFrame, settings: Sequence[dict]) -> DataFrame:
    """Mean and deviation over the folds per candidate, with its settings, its rank and the choice
    (K4: mean test macro-F1, then mean validation macro-F1, then the earlier candidate)."""
    from pyspark.sql.window import Window
    spark = scores.sparkSession
    names = list(settings[0])
    kinds = ["int" if all(isinstance(s[k], int) for s in settings) else "double" for k in names]
    table = spark.createDataFrame([(i, *[s[k] if t == "int" else float(s[k]) for k, t in zip(names, kinds)]) for i, s in enumerate(settings)],
                                  "candidate int, " + ", ".join(f"{k} {t}" for k, t in zip(names, kinds)))
    per = scores.groupBy("candidate").agg(
        F.avg("macro_f1").alias("mean_score"), F.stddev_pop("macro_f1").alias("std_score"), F.min("macro_f1").alias("min_score"),
        F.max("macro_f1").alias("max_score"), F.avg("accuracy").alias("mean_accuracy"), F.avg("val_macro_f1").alias("val_macro_f1"),
        F.avg("n_rounds").alias("mean_rounds"), F.count("*").alias("n_folds"))
    order = Window.orderBy(F.desc("mean_score"), F.desc("val_macro_f1"), "candidate")  # one row per candidate
    return per.join(table, "candidate").withColumn("rank", F.row_number().over(order)).withColumn("is_best", F.col("rank") == 1)


def learning_curve(rows: DataFrame, setting: dict, fractions: Sequence[float], seed: int = 42, n_bins: int = N_BINS) -> DataFrame:
    """Per train size, mean and deviation of train and test macro-F1 over the folds.  Sizes are
    fractions of the first fold's training rows, the same for all folds, and take each fold's first rows."""
    first = rows.where("role = 0").groupBy("fold").agg(F.count("*").alias("n")).orderBy("fold").first()
    sizes = [max(int(first["n"] * f), 1) for f in fractions]
    begin = rows.where("role = 0").groupBy("fold").agg(F.min("row_index").alias("begin"))
    grid = F.explode(F.array(*[F.struct(F.lit(i).alias("candidate"), F.lit(k).alias("size")) for i, k in enumerate(sizes)]))
    from tidemark.session import ship_package
    ship_package(rows.sparkSession)
    spread = max(4 * rows.sparkSession.sparkContext.defaultParallelism, 64)
    dealt = (rows.where("role < 2").join(begin, "fold").select("*", grid.alias("g"))
             .where("role = 1 or row_index < begin + g.size").select("fold", "role", "row_index", "label", "bins", "g.candidate")
             .repartition(spread, "candidate", "fold"))
    scores = dealt.groupBy("candidate", "fold").applyInPandas(_evaluate([setting] * len(sizes), n_bins, seed), _RESULT)
    share = F.element_at(F.array(*[F.lit(float(f)) for f in fractions]), F.col("candidate") + 1)
    return scores.groupBy(share.alias("fraction")).agg(
        F.avg("n_train").alias("n_train"), F.avg("train_macro_f1").alias("train_mean"), F.stddev_pop("train_macro_f1").alias("train_std"),
        F.avg("macro_f1").alias("test_mean"), F.stddev_pop("macro_f1").alias("test_std"), F.count("*").alias("n_folds")) \
        .withColumn("gap", F.col("train_mean") - F.col("test_mean"))
