"""Spark ML learners for the boosted-tree / second-stage steps (M4, M5, M6, M7,
M8, M10, M13, M14, K4, K6, P24, A35, S6).

Models over a whole split are Spark ML's ``RandomForestClassifier`` (multiclass,
probabilities, ``weightCol``): every fit is a distributed tree-aggregate job over the
table.  Parameter searches and learning curves, many small fits on expanding folds,
are in ``boosting``.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.operators import classify_metrics as cm

def with_class_weights(train: DataFrame, label: str = "label", power: float = 2.0, out: str = "w") -> DataFrame:
    """A24 joined as ``weightCol`` (one row per class: AQE broadcasts it)."""
    cw = cm.class_weights(train, label, power).select(F.col("label").alias(label), F.col("weight").alias(out))
    return train.join(cw, label, "left")


def _forest(params: dict, features_col: str = "features", label: str = "label", weight: str | None = "w",
            seed: int = 42):
    from pyspark.ml.classification import RandomForestClassifier
    rf = RandomForestClassifier(featuresCol=features_col, labelCol=label, seed=seed,
                                numTrees=params["numTrees"], maxDepth=params["maxDepth"],
                                subsamplingRate=params["subsamplingRate"],
                                minInstancesPerNode=params["minInstancesPerNode"],
                                featureSubsetStrategy=str(round(params["featureSubsetFraction"], 3)))
    if weight:
        rf = rf.setWeightCol(weight)
    return rf


def vectorise(df: DataFrame, features: Sequence[str], out: str = "features") -> DataFrame:
    from pyspark.ml.feature import VectorAssembler
    return VectorAssembler(inputCols=list(features), outputCol=out, handleInvalid="keep").transform(
        df.na.fill(0.0, subset=list(features)))


def predictions_table(model, df: DataFrame, model_name: str, id_col: str, label: str = "label") -> DataFrame:
    """M7/P24 input: (model, row id, y_true, y_pred, proba array)."""
    from pyspark.ml.functions import vector_to_array
    p = model.transform(df)
    return p.select(F.lit(model_name).alias("model"), F.col(id_col).alias("row_id"),
                    F.col(label).cast("bigint").alias("y_true"), F.col("prediction").cast("bigint").alias("y_pred"),
                    vector_to_array("probability").alias("proba"))


def fit_forest(train: DataFrame, features: Sequence[str], params: dict, label: str = "label", seed: int = 42):
    return _forest(params, label=label, seed=seed).fit(with_class_weights(vectorise(train, features), label))


def feature_importance(model, features: Sequence[str], spark, nlp_prefix: str = "news_") -> DataFrame:
    """Importance per feature, sorted descending, with its category."""
    from tidemark.functions.text import feature_category
    imp = model.featureImportances.toArray().tolist()
    df = spark.createDataFrame([(f, float(v)) for f, v in zip(features, imp)], "feature string, importance double")
    return df.withColumn("category", feature_category("feature", nlp_prefix)) \
             .withColumn("rank", F.row_number().over(Window.orderBy(F.col("importance").desc(), F.col("feature"))))


def calibrate_platt(val_pred: DataFrame, test_pred: DataFrame, classes: Sequence[int]) -> DataFrame:
    """M8 (sigmoid): per class a one-vs-rest logistic fit of the indicator on the
    class score, on the validation predictions; applied to the test predictions and
    renormalised to sum 1."""
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.functions import vector_to_array
    out = test_pred
    cal_cols = []
    for c in classes:
        sc = F.element_at("proba", int(c) + 1)
        v = VectorAssembler(inputCols=["_s"], outputCol="_f")
        # Platt's smoothed targets: (n+ + 1) / (n+ + 2) for hits and 1 / (n- + 2) for misses, as
        # two weighted rows per prediction
        hit = (F.col("y_true") == c)
        n_hit, n_miss = val_pred.agg(F.count_if(hit), F.count_if(~hit)).first()
        target = F.when(hit, F.lit((n_hit + 1.0) / (n_hit + 2.0))).otherwise(F.lit(1.0 / (n_miss + 2.0)))
        both = F.explode(F.array(F.struct(F.lit(1.0).alias("_y"), F.col("_t").alias("_w")),
                                 F.struct(F.lit(0.0).alias("_y"), (1 - F.col("_t")).alias("_w"))))
        tr = v.transform(val_pred.select(sc.alias("_s"), target.alias("_t")).select("_s", both.alias("_p")).select("_s", "_p.*"))
        lr = LogisticRegression(featuresCol="_f", labelCol="_y", weightCol="_w", regParam=0.0).fit(tr)
        out = v.transform(out.withColumn("_s", sc))
        out = lr.transform(out).withColumn(f"_c{c}", vector_to_array("probability")[1]) \
                .drop("_s", "_f", "rawPrediction", "probability", "prediction")
        cal_cols.append(F.col(f"_c{c}"))
    tot = sum(cal_cols[1:], cal_cols[0])
    out = out.withColumn("proba", F.array(*[F.coalesce(F.try_divide(c, tot), F.lit(1.0 / len(classes))) for c in cal_cols]))
    from tidemark.functions.numeric import argmax_array
    cls = F.array(*[F.lit(int(c)) for c in classes])
    return out.withColumn("y_pred", F.element_at(cls, (argmax_array("proba") + 1).cast("int"))) \
              .drop(*[f"_c{c}" for c in classes])


def calibrate_isotonic(val_pred: DataFrame, test_pred: DataFrame, classes: Sequence[int]) -> DataFrame:
    """M8 (isotonic): per class a monotone fit of the indicator on the class score
    (Spark ML ``IsotonicRegression``, pool-adjacent-violators run distributed),
    applied to test and renormalised."""
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.regression import IsotonicRegression
    from tidemark.functions.numeric import argmax_array
    out = test_pred
    cols = []
    for c in classes:
        sc = F.element_at("proba", int(c) + 1)
        v = VectorAssembler(inputCols=["_s"], outputCol="_f")
        tr = v.transform(val_pred.select(sc.alias("_s"), (F.col("y_true") == c).cast("double").alias("_y")))
        iso = IsotonicRegression(featuresCol="_f", labelCol="_y", predictionCol=f"_c{c}").fit(tr)
        out = iso.transform(v.transform(out.withColumn("_s", sc))).drop("_s", "_f")
        cols.append(F.col(f"_c{c}"))
    tot = sum(cols[1:], cols[0])
    out = out.withColumn("proba", F.array(*[F.coalesce(F.try_divide(c, tot), F.lit(1.0 / len(classes)))
                                             for c in cols]))
    cls = F.array(*[F.lit(int(c)) for c in classes])
    return out.withColumn("y_pred", F.element_at(cls, (argmax_array("proba") + 1).cast("int"))) \
              .drop(*[f"_c{c}" for c in classes])


def enrich_with_predictions(df: DataFrame, model, features: Sequence[str], prefix: str, n_classes: int) -> DataFrame:
    """Add ``{prefix}_prob_class{i}`` and ``{prefix}_pred`` to a split."""
    from pyspark.ml.functions import vector_to_array
    p = model.transform(vectorise(df, features))
    arr = vector_to_array("probability")
    p = p.select(*df.columns, *[arr[i].alias(f"{prefix}_prob_class{i}") for i in range(n_classes)],
                 F.col("prediction").cast("bigint").alias(f"{prefix}_pred"))
    return p


def save_artifacts(output_dir: str, models: dict, manifest: dict, spark, test_df: DataFrame | None = None) -> dict:
    """Spark ML persistence per model, test split as Parquet, manifest as
    a one-row JSON table (extra keys become manifest fields)."""
    import json
    import os
    paths = {}
    for name, m in models.items():
        p = os.path.join(output_dir, f"model_{name}")
        m.write().overwrite().save(p)
        paths[name] = p
    if test_df is not None:
        test_df.write.mode("overwrite").parquet(os.path.join(output_dir, "test_data"))
    man = dict(manifest, models=paths)
    spark.createDataFrame([(json.dumps(man, sort_keys=True, default=str),)], "manifest string") \
         .write.mode("overwrite").json(os.path.join(output_dir, "manifest"))
    return man


def load_artifacts(output_dir: str, spark, load_models: bool = True, load_test_data: bool = True) -> dict:
    """Read the manifest and, if asked, the models (each by the class its own metadata
    names: forests, linear models, calibrators, encoders) and the test split."""
    import json
    import os
    from pyspark.ml.util import DefaultParamsReader
    man = json.loads(spark.read.json(os.path.join(output_dir, "manifest")).first()["manifest"])
    out = {"manifest": man}
    if load_models:
        out["models"] = {k: DefaultParamsReader.loadParamsInstance(v, spark.sparkContext) for k, v in man["models"].items()}
    if load_test_data:
        out["test_df"] = spark.read.parquet(os.path.join(output_dir, "test_data"))
    return out


def scoring_inputs(artifacts: dict, features_key: str = "features", id_cols: Sequence[str] = ("ts",),
                   target: str | None = None, classes_key: str = "classes") -> tuple[DataFrame, list[str]]:
    """The loaded test split with the manifest's features in model order, nulls as 0, the id columns
    and the target if present.  If the manifest lists the ``classes`` (the label encoder's, in order),
    the target becomes its class index; a null target stays null, a value outside of them raises.
    A feature that the split lacks raises too."""
    df, man = artifacts["test_df"], artifacts["manifest"]
    features, classes = list(man[features_key]), man.get(classes_key)
    missing = [f for f in features if f not in df.columns]
    if missing:
        raise KeyError(f"test data lack features {missing}")
    first = [c for c in [*id_cols, target] if c and c in df.columns]
    out = df.select(*first, *[F.coalesce(F.col(f"`{f}`").cast("double"), F.lit(0.0)).alias(f) for f in features if f not in first])
    if classes is not None and target in first:
        value = F.col(f"`{target}`").cast("bigint")
        at = F.array_position(F.array(*[F.lit(int(c)).cast("bigint") for c in classes]), value)
        out = out.withColumn(target, F.when(at > 0, at - 1).when(value.isNotNull(), F.raise_error(
            F.concat(F.lit("unknown class "), value.cast("string"))).cast("bigint")))
    return out, features


def split_points(model, features: Sequence[str]) -> dict[str, list[float]]:
    """Thresholds per feature of a fitted forest, ascending; as many as the forest has nodes."""
    import uuid

    from pyspark.sql import SparkSession

    from tidemark.session import ensure_checkpoint_dir
    spark = SparkSession.getActiveSession()
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/tidemark-model-{uuid.uuid4().hex}"
    model.write().save(path)  # the saved form lists the nodes as a table
    nodes = spark.read.parquet(f"{path}/data")
    split = "nodeData.split" if "nodeData" in nodes.columns else "split"
    rows = (nodes.select(F.col(f"{split}.featureIndex").alias("f"), F.element_at(F.col(f"{split}.leftCategoriesOrThreshold"), 1).alias("t"))
            .where("f >= 0").groupBy("f").agg(F.sort_array(F.collect_set("t")).alias("ts")).collect())
    found = {features[r["f"]]: list(r["ts"]) for r in rows}
    return {f: found.get(f, []) for f in features}


def partial_dependence(model, df: DataFrame, features: Sequence[str], targets: Sequence[str],
                       grid_resolution: int = 100, percentiles: tuple = (0.05, 0.95)) -> DataFrame:
    """For each target feature, a grid over its [5 %, 95 %] percentiles; every row is scored
    with the feature set to each grid value and the class probabilities are averaged.

    A forest's answer changes only at its split points, so grid values between the same two
    points of a feature share one copy of the rows: a row is copied once per interval that the
    grid meets, not once per grid point.  All features are scored by one ``transform``."""
    from bisect import bisect_left

    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.functions import vector_to_array

    from tidemark.operators.eda import exact_quantile_table
    ends, splits = exact_quantile_table(df, targets, percentiles), split_points(model, features)
    points, copies = [], []
    for f in targets:
        lo, hi = ends[f]
        if lo is None:
            continue
        seen: set = set()
        for i, v in enumerate(np.linspace(lo, hi, grid_resolution).tolist()):
            interval = bisect_left(splits[f], v)  # a value at a threshold goes left
            points.append((f, i, v, interval))
            if interval not in seen:
                seen.add(interval)
                copies.append((f, interval, v))
    spark = df.sparkSession
    grid = spark.createDataFrame(points, "feature string, grid_index int, value double, interval int")
    # features x intervals structs, the same for all rows
    each = F.explode(F.array(*[F.struct(F.lit(f).alias("pf"), F.lit(k).alias("interval"), F.lit(v).alias("pv")) for f, k, v in copies]))
    x = df.select(*[F.coalesce(F.col(f"`{f}`").cast("double"), F.lit(0.0)).alias(f) for f in features], each.alias("_g"))
    x = x.select(*[F.when(F.col("_g.pf") == f, F.col("_g.pv")).otherwise(F.col(f"`{f}`")).alias(f) if f in targets else F.col(f"`{f}`")
                   for f in features], F.col("_g.pf").alias("_pf"), F.col("_g.interval").alias("_interval"))
    p = model.transform(VectorAssembler(inputCols=list(features), outputCol="features").transform(x))
    arr, k = vector_to_array("probability"), model.numClasses
    means = p.groupBy("_pf", "_interval").agg(*[F.avg(arr[i]).alias(f"avg_proba_{i}") for i in range(k)])
    return (grid.join(means, (F.col("feature") == F.col("_pf")) & (F.col("interval") == F.col("_interval")))
            .select("grid_index", "value", *[f"avg_proba_{i}" for i in range(k)], "feature"))


def permuted(i: F.Column, n: int, *key: F.Column) -> F.Column:
    """A permutation of 0..n-1 as an expression: Feistel rounds over the next power of two, walked
    until the value is below n (each step fails with at most one half)."""
    bits = max(2, (max(n, 2) - 1).bit_length())
    low = bits // 2
    low_mask, high_mask = (1 << low) - 1, (1 << (bits - low)) - 1

    def walk(x, _):
        return F.when(x < n, x).otherwise(_feistel(x, low, low_mask, high_mask, key))

    return F.aggregate(F.sequence(F.lit(1), F.lit(WALK)), _feistel(i.cast("bigint"), low, low_mask, high_mask, key), walk)


#: Steps of a cycle walk; the chance that one is still outside after them is below 2**-WALK.
WALK = 96


def _feistel(x: F.Column, low: int, low_mask: int, high_mask: int, key) -> F.Column:
    """Eight half rounds on the two parts of a number; each state is a lambda variable, so that
    it is worked out once."""
    state = F.array(F.struct(F.shiftright(x, low).alias("a"), x.bitwiseAND(F.lit(low_mask).cast("bigint")).alias("b")))
    for r in range(4):
        state = F.transform(state, lambda s, r=r: F.struct(
            s["a"].bitwiseXOR(F.xxhash64(F.lit(2 * r), *key, s["b"])).bitwiseAND(F.lit(high_mask).cast("bigint")).alias("a"), s["b"].alias("b")))
        state = F.transform(state, lambda s, r=r: F.struct(
            s["a"].alias("a"), s["b"].bitwiseXOR(F.xxhash64(F.lit(2 * r + 1), *key, s["a"])).bitwiseAND(F.lit(low_mask).cast("bigint")).alias("b")))
    return F.transform(state, lambda s: F.call_function("shiftleft", s["a"], F.lit(low)).bitwiseOR(s["b"]))[0]


def permutation_importance(model, df: DataFrame, features: Sequence[str], id_col: str, label: str = "label",
                           n_repeats: int = 10, seed: int = 42) -> DataFrame:
    """Macro-F1 drop when one feature's values are permuted across all rows.

    Rows are numbered; a keyed bijection on the numbers (``permuted``) gives every row of a
    (feature, repeat) copy another row's number, and one equijoin on it fetches that row's
    value.  Each value is used exactly once, at any size, without sorting by random keys."""
    from pyspark.ml.functions import array_to_vector

    from tidemark.plans.scan import ranked_rows
    from tidemark.session import cut_lineage
    filled = df.select(F.array(*[F.coalesce(F.col(f"`{f}`").cast("double"), F.lit(0.0)) for f in features]).alias("x"),
                       F.col(label).cast("double").alias("label"), F.col(id_col).alias("row_id"))
    rows = cut_lineage(ranked_rows(filled, ["row_id"]))
    n = rows.count()
    base = cm.accuracy_macro_f1(predictions_table(model, rows.withColumn("features", array_to_vector("x")), "m", "row_id", "label")) \
             .collect()[0]["macro_f1"]
    copies = F.explode(F.array(*[F.struct(F.lit(i).alias("f"), F.lit(r).alias("rep")) for i in range(len(features)) for r in range(n_repeats)]))
    x = rows.select("rank", "x", "label", copies.alias("c")).select("rank", "x", "label", "c.f", "c.rep")
    x = x.withColumn("source", permuted(F.col("rank"), n, F.lit(seed), F.col("f"), F.col("rep")))
    values = rows.select(F.col("rank").alias("source"), F.posexplode("x").alias("f", "moved"))
    x = x.join(values, ["source", "f"])
    x = x.withColumn("features", array_to_vector(F.transform("x", lambda v, i: F.when(i == F.col("f"), F.col("moved")).otherwise(v))))
    p = model.transform(x)
    s = cm.accuracy_macro_f1(p.select("f", "rep", F.col("label").cast("bigint").alias("y_true"), F.col("prediction").cast("bigint").alias("y_pred")),
                             ["f", "rep"])
    names = F.element_at(F.array(*[F.lit(f) for f in features]), F.col("f") + 1)
    return s.groupBy(names.alias("feature")).agg(
        (F.lit(base) - F.avg("macro_f1")).alias("importance_mean"),
        F.stddev_pop(F.lit(base) - F.col("macro_f1")).alias("importance_std"), F.count("*").alias("n_repeats"))


def param_grid(space: dict) -> list[dict]:
    """M5: full grid (ParamGridBuilder-style) over explicit value lists."""
    import itertools
    keys = list(space)
    return [dict(zip(keys, vals)) for vals in itertools.product(*[space[k] for k in keys])]
