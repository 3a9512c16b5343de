"""Model jobs over tables (M1, M2, M3, M4, M6, M7, M8, M10, M13, M14, K3, K4, P9,
P13, P24, A35).

M2/M3 ridge grid search is a Gram-matrix job: Gram matrices are additive, so each
task computes partial XᵀX, XᵀY, sums and counts per (parameter set, time segment)
with NumPy on its own rows, the partials are summed by key (one small shuffle),
expanding folds are prefix sums over segments, and every (parameter set, fold)
solves its p x p systems for all alphas at once in ``applyInPandas`` (one row in,
13 rows out; bounded by the feature count, never by the data).  Scoring joins
the coefficients back to the rows and reuses the metric aggregates.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.operators.lookup import only
from pyspark.sql.window import Window

from tidemark.operators import classify_metrics as cm
from tidemark.session import cut_lineage, ship_package

# Reference alpha grid (logspace(-3, 3, 13)) and baseline features.
ALPHAS = [float(a) for a in np.logspace(-3, 3, 13)]
BASELINE_FEATURES = ["spot", "da", "load", "real_spread_abs", "price_lag_24", "price_lag_168",
                     "load_lag_24", "load_lag_168", "hour", "week_of_year", "month", "day_of_week", "day_of_year"]
TARGET = "spread_target_shift_24"


def require_columns(df: DataFrame, cols: Sequence[str]) -> None:
    """Fail before fitting when features are missing."""
    missing = [c for c in cols if c not in df.columns]
    if missing:
        raise ValueError(f"Missing features {missing}")


def assemble_features(master: DataFrame, topic_grid: DataFrame, emb_grid: DataFrame, topics: Sequence[str],
                      dim: int, params: Sequence[tuple[int, float]],
                      keys: Sequence[str] = ("lookback", "decay_lambda")) -> DataFrame:
    """Master rows x parameter sets, left-joined with the pivoted topic and
    embedding features of that parameter set; missing features are 0.

    The parameter list is the configured grid (30 pairs), exploded per master row
    from a literal array (a projection, not a join); the feature joins are equi-joins
    on (parameter set, hour)."""
    keys = list(keys)
    topic_grid = topic_grid.withColumn("topic", only("topic", topics, "topic"))
    emb_grid = emb_grid.withColumn("dim", only("dim", range(dim), "vector position"))
    tw = topic_grid.groupBy(*keys, "ts").pivot("topic", list(topics)).agg(F.first("weight"))
    ew = emb_grid.groupBy(*keys, "ts").pivot("dim", list(range(dim))).agg(F.first("value"))
    ew = ew.select(*keys, "ts", *[F.col(f"`{i}`").alias(f"emb_{i}") for i in range(dim)])
    plist = F.array(*[F.struct(F.lit(int(L)).cast("bigint").alias(keys[0]), F.lit(float(lam)).alias(keys[1]))
                      for L, lam in params])
    m = master.select(*master.columns, F.explode(plist).alias("_k")) \
              .select(*master.columns, *[F.col(f"_k.{k}").alias(k) for k in keys])
    out = m.join(tw, [*keys, "ts"], "left").join(ew, [*keys, "ts"], "left")
    feats = [*topics, *(f"emb_{i}" for i in range(dim))]
    return out.na.fill(0.0, subset=feats)


def feature_array(df: DataFrame, features: Sequence[str], out: str = "x") -> DataFrame:
    return df.withColumn(out, F.array(*[F.col(f"`{c}`").cast("double") for c in features]))


def _gram_partials(df: DataFrame, keys: Sequence[str], classes: Sequence[int], p: int) -> DataFrame:
    """Per task and key: n, sum x, sum Y(+-1), XᵀX, XᵀY flattened into one array."""
    keys = list(keys)
    cls = np.array(classes)
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields if f.name in keys]
                       + ["stats array<double>"])

    def run(batches):
        acc: dict = {}
        for pdf in batches:
            if pdf.empty:
                continue
            for kv, g in pdf.groupby(keys, sort=False, dropna=False):
                X = np.vstack(g["x"].to_numpy()).astype(float)
                Y = np.where(g["y"].to_numpy()[:, None] == cls[None, :], 1.0, -1.0)
                s = np.concatenate([[len(g)], X.sum(0), Y.sum(0), (X.T @ X).ravel(), (X.T @ Y).ravel()])
                kv = kv if isinstance(kv, tuple) else (kv,)
                acc[kv] = acc.get(kv, 0.0) + s
        if acc:
            rows = [dict(zip(keys, kv), stats=v.tolist()) for kv, v in acc.items()]
            yield pd.DataFrame(rows)

    ship_package(df.sparkSession)
    return df.select(*keys, "x", "y").mapInPandas(run, schema)


def _sum_stats(partials: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Element-wise sum of the stats arrays per key (posexplode + grouped sum; the
    arrays have a fixed width set by the feature count)."""
    keys = list(keys)
    x = partials.select(*keys, F.posexplode("stats").alias("i", "v"))
    return x.groupBy(*keys, "i").agg(F.sum("v").alias("v"))


def _solve_group(classes: Sequence[int], p: int, alphas: Sequence[float], keys: Sequence[str]):
    k = len(classes)

    def solve(pdf: pd.DataFrame) -> pd.DataFrame:
        s = pdf.sort_values("i")["v"].to_numpy()
        n = s[0]
        sx = s[1:1 + p]
        sy = s[1 + p:1 + p + k]
        xtx = s[1 + p + k:1 + p + k + p * p].reshape(p, p)
        xty = s[1 + p + k + p * p:].reshape(p, k)
        mx, my = sx / n, sy / n
        A = xtx - n * np.outer(mx, mx)
        B = xty - n * np.outer(mx, my)
        rows = []
        for ai, a in enumerate(alphas):
            try:
                W = np.linalg.solve(A + a * np.eye(p), B)
            except np.linalg.LinAlgError:
                W = np.linalg.lstsq(A + a * np.eye(p), B, rcond=None)[0]
            b = my - mx @ W
            row = {kk: pdf.iloc[0][kk] for kk in keys}
            row.update(alpha_idx=ai, alpha=float(a), W=W.T.tolist(), b=b.tolist(), n_train=int(n))
            rows.append(row)
        return pd.DataFrame(rows)

    return solve


def _coef_schema(df: DataFrame, keys: Sequence[str]) -> str:
    return ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields if f.name in keys]
                     + ["alpha_idx int", "alpha double", "W array<array<double>>", "b array<double>", "n_train long"])


def predict_linear(df: DataFrame, classes: Sequence[int], x: str = "x", out: str = "y_pred") -> DataFrame:
    """Decision b_c + x . W_c per class; prediction = class of the first maximum."""
    cls = F.array(*[F.lit(int(c)) for c in classes])
    dec = F.transform(F.sequence(F.lit(0), F.lit(len(classes) - 1)), lambda c: F.aggregate(
        F.zip_with(F.col(x), F.element_at(F.col("W"), (c + 1).cast("int")), lambda a, w: a * w),
        F.element_at(F.col("b"), (c + 1).cast("int")), lambda acc, v: acc + v))
    idx = F.array_position(dec, F.array_max(dec))
    return df.withColumn(out, F.element_at(cls, idx.cast("int")).cast("bigint"))


def ridge_grid_search(data: DataFrame, features: Sequence[str], keys: Sequence[str] = ("lookback", "decay_lambda"),
                      target: str = TARGET, order: str = "ts", alphas: Sequence[float] = ALPHAS,
                      n_splits: int = 5, train_ratio: float = 0.7, val_ratio: float = 0.2) -> DataFrame:
    """M2/M3: per parameter set, RidgeClassifierCV-equivalent selection of alpha by
    mean macro-F1 over TimeSeriesSplit folds of the training split, refit on the
    whole training split, validation accuracy and macro-F1, skip reasons.

    Rows without a target are left out; missing and NaN features count as 0.  A parameter set
    whose training rows hold fewer than two classes, without validation rows, or with too few
    training rows for two folds gets a skip reason and null figures; it never ends the job.

    Output: one row per parameter set (keys, best_alpha, cv_macro_f1, n_train, val_accuracy,
    val_macro_f1, n_val, skip_reason)."""
    from tidemark.operators.split import chrono_split, with_test_fold
    keys = list(keys)
    p = len(features)
    require_columns(data, [*features, target])
    filled = F.array(*[F.coalesce(F.nanvl(F.col(f"`{c}`").cast("double"), F.lit(0.0)), F.lit(0.0)) for c in features])
    d = data.na.drop(subset=[target]).select(*keys, order, filled.alias("x"), F.col(target).cast("bigint").alias("y"))
    d = chrono_split(d, keys, [order], train_ratio, val_ratio, 1 - train_ratio - val_ratio, strict=False)
    # the split feature table feeds six branches: materialise it once in the shared
    # checkpoint folder (reliable checkpoint, survives executor loss)
    d = cut_lineage(d.select(*keys, order, "x", "y", "split"))
    train = d.filter(F.col("split") == "train").drop("split")
    sizes = d.groupBy(*keys).agg(F.count_if(F.col("split") == "train").alias("_nt"),
                                 F.count_if(F.col("split") == "val").alias("_nv"),
                                 F.count_distinct(F.when(F.col("split") == "train", F.col("y"))).alias("_nc"))
    # The reference's skip reasons, in its order.
    skip = (F.when(F.coalesce("_nc", F.lit(0)) < 2, F.lit("Training split lacks class diversity"))
            .when(F.col("_nv") == 0, F.lit("Validation split is empty"))
            .when(F.least(F.lit(int(n_splits)), F.col("_nt") - 1) < 2,
                  F.lit("Insufficient data for expanding-window CV")))
    verdict = data.select(*keys).distinct().join(sizes, keys, "left").withColumn("skip_reason", skip).drop("_nt", "_nv", "_nc")
    verdict = cut_lineage(verdict)  # one row per parameter set
    fitted = verdict.filter(F.col("skip_reason").isNull()).select(*keys)
    train, val = train.join(fitted, keys, "left_semi"), d.filter(F.col("split") == "val").drop("split").join(fitted, keys, "left_semi")
    classes = sorted(int(r[0]) for r in train.select("y").distinct().collect())  # the target's few classes
    if not classes:
        nothing = [F.lit(None).cast(t).alias(c) for c, t in (("best_alpha", "double"), ("cv_macro_f1", "double"),
                   ("n_train", "bigint"), ("n_val", "bigint"), ("val_accuracy", "double"), ("val_macro_f1", "double"))]
        return verdict.select(*keys, *nothing, "skip_reason")
    # a training row's segment is the fold that tests on it (-1: before the first test block)
    t2 = with_test_fold(train, keys, [order], n_splits).withColumnRenamed("test_fold", "seg")
    sums = _sum_stats(_gram_partials(t2, [*keys, "seg"], classes, p), [*keys, "seg"])
    # fold f trains on segments < f (segment -1 = rows before the first test block)
    fold_ids = F.sequence(F.col("seg") + 1, F.lit(n_splits))
    ex = sums.select(*keys, "seg", "i", "v", F.explode(fold_ids).alias("fold"))
    fold_stats = ex.groupBy(*keys, "fold", "i").agg(F.sum("v").alias("v"))   # fold == n_splits -> full train
    coef = fold_stats.groupBy(*keys, "fold").applyInPandas(
        _solve_group(classes, p, alphas, [*keys, "fold"]), _coef_schema(fold_stats, [*keys, "fold"]))
    # CV scores: test rows of each fold x the 13 alphas of that fold
    test_rows = t2.filter(F.col("seg") >= 0).withColumnRenamed("seg", "fold")
    scored = predict_linear(test_rows.join(coef.filter(F.col("fold") < n_splits), [*keys, "fold"]), classes)
    cv = cm.accuracy_macro_f1(scored.withColumnRenamed("y", "y_true"), [*keys, "fold", "alpha_idx", "alpha"])
    cvm = cv.groupBy(*keys, "alpha_idx", "alpha").agg(F.avg("macro_f1").alias("cv_macro_f1"))
    w = Window.partitionBy(*keys).orderBy(F.round("cv_macro_f1", 12).desc(), F.col("alpha_idx"))
    best = cvm.withColumn("_r", F.row_number().over(w)).filter("_r = 1").drop("_r")
    final = coef.filter(F.col("fold") == n_splits).join(best.select(*keys, "alpha_idx", "cv_macro_f1"),
                                                        [*keys, "alpha_idx"])
    vs = predict_linear(val.join(final, keys), classes).withColumnRenamed("y", "y_true")
    vm = cm.accuracy_macro_f1(vs, keys).withColumnRenamed("accuracy", "val_accuracy") \
           .withColumnRenamed("macro_f1", "val_macro_f1").withColumnRenamed("n", "n_val")
    res = final.select(*keys, F.col("alpha").alias("best_alpha"), "cv_macro_f1", "n_train").join(vm, keys, "left")
    return verdict.select(*keys, "skip_reason").join(res, keys, "left").select(
        *keys, *[c for c in res.columns if c not in keys], "skip_reason")


def top_parameter_sets(results: DataFrame, n: int = 5) -> DataFrame:
    """K3: top n by (val accuracy, val macro-F1) after dropping skipped sets."""
    return results.filter(F.col("skip_reason").isNull()) \
                  .orderBy(F.col("val_accuracy").desc(), F.col("val_macro_f1").desc(),
                           F.col("lookback"), F.col("decay_lambda")).limit(int(n))
