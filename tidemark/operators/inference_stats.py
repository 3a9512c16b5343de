"""Paired model comparison.

McNemar: four conditional counts from one pass over the paired predictions.
Bootstrap: Poisson bootstrap.  Replicate r gives every row the weight
Poisson(1)^-1(u(seed, r, key)) with ``u`` an integer hash of the key (codegen-friendly), so every
executor draws the same weights without coordination and the job is reproducible; all models share
the resamples (as the reference, which reseeds identically for each model).  The key's part of the
hash is computed once per row; rows are dealt evenly over the tasks, exploded to their replicates
inside the map stage and partially aggregated there, so the last shuffle carries one row per
replicate (and cell) per task.
"""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions.numeric import (
    POISSON_SMALL, POISSON_TRIES, chi2_1_sf, poisson1_quantile, poisson_try_sql, with_mix_uniform, with_mixed_key,
    with_mixed_uniform)
from tidemark.session import cut_lineage


def paired_predictions(pred: DataFrame, model_a: str = "signal", model_b: str = "baseline",
                       key: str = "row_id") -> DataFrame:
    """One row per key with both models' predictions (a grouped pivot, one shuffle)."""
    g = pred.filter(F.col("model").isin(model_a, model_b)).groupBy(key).agg(
        F.first("y_true").alias("y_true"),
        F.max(F.when(F.col("model") == model_a, F.col("y_pred"))).alias("pred_a"),
        F.max(F.when(F.col("model") == model_b, F.col("y_pred"))).alias("pred_b"),
        F.count(F.lit(1)).alias("_n"))
    # shape check (evaluation requires identical lengths): every key has both models
    return g.withColumn("_chk", F.when(F.col("_n") != 2, F.raise_error(F.lit("prediction shapes differ")))) \
            .filter(F.col("_chk").isNull()).drop("_n", "_chk")


def mcnemar(paired: DataFrame) -> DataFrame:
    """2x2 contingency, continuity-corrected statistic and chi2(1) p-value;
    NULL statistic/p when there are no discordant pairs."""
    ok_a = F.col("pred_a") == F.col("y_true")
    ok_b = F.col("pred_b") == F.col("y_true")
    t = paired.agg(F.count_if(ok_a & ok_b).alias("both_correct"),
                   F.count_if(ok_a & ~ok_b).alias("only_a_correct"),
                   F.count_if(~ok_a & ok_b).alias("only_b_correct"),
                   F.count_if(~ok_a & ~ok_b).alias("both_wrong"),
                   F.avg(ok_a.cast("double")).alias("accuracy_a"),
                   F.avg(ok_b.cast("double")).alias("accuracy_b"))
    b, c = F.col("only_a_correct"), F.col("only_b_correct")
    stat = F.when(b + c > 0, F.pow(F.abs(b - c) - 1, 2) / (b + c))
    return t.withColumn("mcnemar_statistic", stat).withColumn("mcnemar_p_value", chi2_1_sf(stat))


def poisson_draws(cells: DataFrame, n_boot: int, seed: int = 42, cell: str = "cell", n: str = "n") -> DataFrame:
    """(rep, cell, w): an exact Poisson(n) draw for every replicate and cell (``cell``: distinct
    bigint numbers).  Small n: n draws of Poisson(1) by inversion; else the first accepted of
    ``POISSON_TRIES`` candidates."""
    reps = F.explode(F.sequence(F.lit(0), F.lit(int(n_boot) - 1))).alias("rep")
    tries = F.explode(F.sequence(F.lit(0), F.lit(POISSON_TRIES - 1))).alias("try")
    x = cells.select(F.col(cell).cast("bigint").alias("cell"), F.col(n).cast("double").alias("n"), reps).select("*", tries)
    x = x.withColumn("_k", F.col("cell") * (2 * POISSON_TRIES) + 2 * F.col("try")).withColumn("_k2", F.col("_k") + 1)
    x = with_mix_uniform(with_mix_uniform(x, "u", seed, "rep", "_k"), "v", seed, "rep", "_k2")
    small = F.when(F.col("try") < F.col("n"), poisson1_quantile(F.col("u")))
    large = F.expr(poisson_try_sql("n", "u", "v"))
    x = x.select("rep", "cell", "n", "try", F.when(F.col("n") < POISSON_SMALL, small).alias("_s"),
                 F.when(F.col("n") >= POISSON_SMALL, large).cast("bigint").alias("_l"))
    g = x.groupBy("rep", "cell").agg(F.sum("_s").alias("_s"), F.min(F.when(F.col("_l").isNotNull(), F.struct("try", "_l"))).alias("_l"))
    return g.select("rep", "cell", F.coalesce("_s", "_l._l", F.lit(0)).alias("w"))


def replicate_weights(df: DataFrame, n_boot: int, seed: int, key: str, cols) -> DataFrame:
    """(rep, w, cols): every row once per replicate with its Poisson(1) weight.  Rows that share a
    key share their weights; a null key counts as key 0."""
    reps = F.explode(F.sequence(F.lit(0), F.lit(int(n_boot) - 1))).alias("rep")
    # a small file is one task otherwise, and every row is n_boot rows of work
    x = df.select(F.coalesce(F.col(key).cast("bigint"), F.lit(0)).alias("_key"), *cols).repartition(2 * df.sparkSession.sparkContext.defaultParallelism)
    x = with_mixed_key(x, "_mixed", "_key").drop("_key")
    x = with_mixed_uniform(x.select("*", reps), "_u", seed, "rep", "_mixed")
    return x.withColumn("w", poisson1_quantile(F.col("_u"))).drop("_u", "_mixed")


def bootstrap_accuracy(paired: DataFrame, n_boot: int = 1000, seed: int = 42, confidence: float = 0.95,
                       key: str = "row_id") -> DataFrame:
    """Per model, mean and percentile interval of bootstrap accuracy.

    Replicates with zero total weight are skipped (NaN scores in the reference)."""
    alpha = (1 - confidence) / 2
    # a null prediction is a miss
    hit = [F.coalesce((F.col(p) == F.col("y_true")).cast("bigint"), F.lit(0)).alias(c) for p, c in (("pred_a", "ca"), ("pred_b", "cb"))]
    x = replicate_weights(paired, n_boot, seed, key, hit)
    r = x.groupBy("rep").agg(F.sum("w").alias("sw"), F.sum(F.col("w") * F.col("ca")).alias("sa"),
                             F.sum(F.col("w") * F.col("cb")).alias("sb"))
    r = r.filter(F.col("sw") > 0)
    long = r.select("rep", F.explode(F.array(
        F.struct(F.lit("a").alias("side"), (F.col("sa") / F.col("sw")).alias("score")),
        F.struct(F.lit("b").alias("side"), (F.col("sb") / F.col("sw")).alias("score")))).alias("s"))
    return long.groupBy(F.col("s.side").alias("side")).agg(
        F.avg("s.score").alias("mean"),
        F.percentile(F.col("s.score"), F.lit(alpha * 1.0)).alias("lower"),
        F.percentile(F.col("s.score"), F.lit(1.0 - alpha)).alias("upper"),
        F.count(F.lit(1)).alias("n_replicates"))


def ci_overlap_verdict(ci: DataFrame) -> DataFrame:
    """Compare the two intervals (side a = signal, side b = baseline) in one
    aggregate over the two interval rows."""
    def pick(side, c):
        return F.max(F.when(F.col("side") == side, F.col(c)))
    j = ci.agg(pick("a", "mean").alias("a_mean"), pick("a", "lower").alias("a_lo"),
               pick("a", "upper").alias("a_hi"), pick("b", "mean").alias("b_mean"),
               pick("b", "lower").alias("b_lo"), pick("b", "upper").alias("b_hi"))
    verdict = (F.when(F.col("a_lo") > F.col("b_hi"), F.lit("signal better, intervals disjoint"))
               .when(F.col("a_hi") < F.col("b_lo"), F.lit("baseline better, intervals disjoint"))
               .otherwise(F.lit("intervals overlap")))
    return j.withColumn("difference", F.col("a_mean") - F.col("b_mean")).withColumn("verdict", verdict)


def bootstrap_confusion_metric(pred: DataFrame, metric: str = "macro_f1", n_boot: int = 1000, seed: int = 42,
                               confidence: float = 0.95, keys=("model",), key: str = "row_id",
                               user_metric=None) -> DataFrame:
    """A20/U1 generalised: bootstrap interval of a confusion-matrix metric.

    Replicate weights are the same hash-seeded Poisson draws as ``bootstrap_accuracy`` (shared by
    all models).  Rows are reduced to weighted (replicate, y_true, y_pred) cells in the map stage, so
    each replicate's input is a k x k matrix per model whatever the data size; ``metric`` is 'macro_f1' or
    'accuracy' (SQL aggregates), or ``user_metric(cells: pandas.DataFrame) -> float``
    applied per replicate with ``applyInPandas`` on those bounded cells."""
    import pandas as pd
    keys = list(keys)
    alpha = (1 - confidence) / 2
    # the cells of the matrices by number: sums per (replicate, number) take a sixth of the time of sums per (names, classes)
    names = [*keys, "y_true", "y_pred"]
    kinds = cut_lineage(pred.select(*names).distinct().withColumn("_cell", F.monotonically_increasing_id()))
    same = reduce(and_, [F.col(c).eqNullSafe(F.col(f"_of_{c}")) for c in names])
    numbered = pred.select(key, *names).join(F.broadcast(kinds.select("_cell", *[F.col(c).alias(f"_of_{c}") for c in names])), same)
    x = replicate_weights(numbered, n_boot, seed, key, ["_cell"])
    cells = x.groupBy("rep", "_cell").agg(F.sum("w").alias("w")).filter(F.col("w") > 0)
    cells = cells.join(F.broadcast(kinds), "_cell").select(*keys, "rep", "y_true", "y_pred", "w")
    if user_metric is not None:
        def per_rep(pdf: pd.DataFrame) -> pd.DataFrame:
            row = {k: pdf.iloc[0][k] for k in [*keys, "rep"]}
            row["score"] = float(user_metric(pdf[["y_true", "y_pred", "w"]]))
            return pd.DataFrame([row])
        schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in cells.schema.fields
                            if f.name in [*keys, "rep"]] + ["score double"])
        scores = cells.groupBy(*keys, "rep").applyInPandas(per_rep, schema)
    else:
        both = F.array(F.struct(F.col("y_true").alias("c"), F.col("w").alias("t"),
                                F.when(F.col("y_true") == F.col("y_pred"), F.col("w")).otherwise(0).alias("tp"),
                                F.lit(0).cast("bigint").alias("pp")),
                       F.struct(F.col("y_pred").alias("c"), F.lit(0).cast("bigint").alias("t"),
                                F.lit(0).cast("bigint").alias("tp"), F.col("w").alias("pp")))
        per_class = cells.select(*keys, "rep", F.explode(both).alias("e")).groupBy(*keys, "rep", "e.c").agg(
            F.sum("e.tp").alias("tp"), F.sum("e.t").alias("sup"), F.sum("e.pp").alias("prd"))
        f1 = F.coalesce(F.try_divide(2 * F.col("tp"), F.col("sup") + F.col("prd")), F.lit(0.0))
        agg = F.avg(f1) if metric == "macro_f1" else F.sum("tp") / F.sum("sup")
        scores = per_class.groupBy(*keys, "rep").agg(agg.alias("score"))
    return scores.groupBy(*keys).agg(
        F.avg("score").alias("mean"),
        F.percentile(F.col("score"), F.lit(alpha * 1.0)).alias("lower"),
        F.percentile(F.col("score"), F.lit(1.0 - alpha)).alias("upper"),
        F.count(F.lit(1)).alias("n_replicates"))
