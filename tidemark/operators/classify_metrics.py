"""Classification statistics over a long predictions table (A14-A18, A22-A24,
A32, A33, A35, P19, P23, P27, J8, J9, SET2, SET3, W15).

Input convention: one row per (model, row_id) with ``y_true``, ``y_pred`` and
optionally ``proba`` (array, one entry per class index).  Every metric is a grouped
aggregate keyed by ``model`` (plus split/params keys when present), so all models,
thresholds and folds are scored in one job.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.functions.numeric import argmax_array


def confusion_matrix(pred: DataFrame, labels: Sequence[int], keys: Sequence[str] = ("model",),
                     y: str = "y_true", p: str = "y_pred") -> DataFrame:
    """Counts for every (y_true, y_pred) cell of a fixed label set (0 when absent).

    Cells are generated per key group with ``explode`` (k*k rows per model), not a
    join with a cross product."""
    keys = list(keys)
    k = len(labels)
    lab = F.array(*[F.lit(int(v)) for v in labels])
    counts = pred.groupBy(*keys, F.col(y).alias("y_true"), F.col(p).alias("y_pred")) \
                 .agg(F.count(F.lit(1)).alias("n"))
    cells = (pred.select(*keys).distinct()
             .select(*keys, F.explode(F.sequence(F.lit(0), F.lit(k * k - 1))).alias("_c"))
             .select(*keys, F.element_at(lab, (F.floor(F.col("_c") / k) + 1).cast("int")).cast("bigint").alias("y_true"),
                     F.element_at(lab, (F.col("_c") % k + 1).cast("int")).cast("bigint").alias("y_pred")))
    return cells.join(counts, [*keys, "y_true", "y_pred"], "left") \
                .select(*keys, "y_true", "y_pred", F.coalesce("n", F.lit(0)).cast("bigint").alias("count"))


def per_class_counts(pred: DataFrame, keys: Sequence[str] = ("model",), y: str = "y_true",
                     p: str = "y_pred") -> DataFrame:
    """tp, support (true count) and predicted count per (keys, class), over the union
    of labels seen in truth or prediction (scikit-learn's label set)."""
    keys = list(keys)
    both = F.array(F.struct(F.col(y).alias("c"), F.lit(1).alias("t"), (F.col(y) == F.col(p)).cast("int").alias("tp"),
                            F.lit(0).alias("pp")),
                   F.struct(F.col(p).alias("c"), F.lit(0).alias("t"), F.lit(0).alias("tp"), F.lit(1).alias("pp")))
    x = pred.select(*keys, F.explode(both).alias("e"))
    return x.groupBy(*keys, F.col("e.c").cast("bigint").alias("label")).agg(
        F.sum("e.tp").cast("bigint").alias("tp"),
        F.sum("e.t").cast("bigint").alias("support"),
        F.sum("e.pp").cast("bigint").alias("predicted"))


def classification_report(pred: DataFrame, keys: Sequence[str] = ("model",), y: str = "y_true",
                          p: str = "y_pred") -> DataFrame:
    """Precision, recall, F1 (zero_division=0) and support per class, plus
    ``macro avg``, ``weighted avg`` and ``accuracy`` rows (label column as text)."""
    keys = list(keys)
    c = per_class_counts(pred, keys, y, p)
    prec = F.coalesce(F.try_divide(F.col("tp"), F.col("predicted")), F.lit(0.0))
    rec = F.coalesce(F.try_divide(F.col("tp"), F.col("support")), F.lit(0.0))
    f1 = F.coalesce(F.try_divide(2 * F.col("tp"), 2 * F.col("tp") + (F.col("predicted") - F.col("tp"))
                                 + (F.col("support") - F.col("tp"))), F.lit(0.0))
    per = c.select(*keys, F.col("label").cast("string").alias("label"), prec.alias("precision"),
                   rec.alias("recall"), f1.alias("f1"), F.col("support"), F.col("tp"))
    tot = per.groupBy(*keys).agg(
        F.avg("precision").alias("mp"), F.avg("recall").alias("mr"), F.avg("f1").alias("mf"),
        (F.sum(F.col("precision") * F.col("support")) / F.sum("support")).alias("wp"),
        (F.sum(F.col("recall") * F.col("support")) / F.sum("support")).alias("wr"),
        (F.sum(F.col("f1") * F.col("support")) / F.sum("support")).alias("wf"),
        F.sum("support").alias("n"), F.sum("tp").alias("tp"))
    rows = F.array(
        F.struct(F.lit("macro avg").alias("label"), F.col("mp").alias("precision"), F.col("mr").alias("recall"),
                 F.col("mf").alias("f1"), F.col("n").alias("support")),
        F.struct(F.lit("weighted avg").alias("label"), F.col("wp").alias("precision"), F.col("wr").alias("recall"),
                 F.col("wf").alias("f1"), F.col("n").alias("support")),
        F.struct(F.lit("accuracy").alias("label"), F.lit(None).cast("double").alias("precision"),
                 F.lit(None).cast("double").alias("recall"), (F.col("tp") / F.col("n")).alias("f1"),
                 F.col("n").alias("support")))
    summary = tot.select(*keys, F.explode(rows).alias("r")).select(*keys, "r.*")
    return per.drop("tp").unionByName(summary)


def accuracy_macro_f1(pred: DataFrame, keys: Sequence[str] = ("model",), y: str = "y_true",
                      p: str = "y_pred") -> DataFrame:
    """Accuracy and macro-F1 per key group (labels = union of truth and prediction)."""
    keys = list(keys)
    c = per_class_counts(pred, keys, y, p)
    f1 = F.coalesce(F.try_divide(2 * F.col("tp"), F.col("predicted") + F.col("support")), F.lit(0.0))
    return c.groupBy(*keys).agg((F.sum("tp") / F.sum("support")).alias("accuracy"),
                                F.avg(f1).alias("macro_f1"), F.sum("support").alias("n"))


def prediction_distribution(pred: DataFrame, keys: Sequence[str] = ("model",), p: str = "y_pred") -> DataFrame:
    """Predictions per class with share of the group (%)."""
    keys = list(keys)
    from tidemark.operators.eda import with_share
    g = pred.groupBy(*keys, F.col(p).alias("y_pred")).agg(F.count(F.lit(1)).alias("count"))
    return with_share(g, "count", keys, "share_pct")


def unseen_predicted_labels(pred: DataFrame, keys: Sequence[str] = ("model",), y: str = "y_true",
                            p: str = "y_pred") -> DataFrame:
    """J8/SET2: labels a model predicts that never occur in the truth."""
    keys = list(keys)
    observed = pred.select(F.col(y).alias("label")).distinct()
    predicted = pred.select(*keys, F.col(p).alias("label")).distinct()
    return predicted.join(observed, "label", "left_anti")


def label_index(train: DataFrame, y: str = "y_true") -> DataFrame:
    """Label <-> class index, ``dense_rank - 1`` over the sorted distinct train
    labels (scikit-learn LabelEncoder order, not StringIndexer's frequency order).
    The distinct label set is the class list, bounded by the task definition."""
    d = train.select(F.col(y).alias("label")).distinct()
    return d.withColumn("class_index", (F.dense_rank().over(Window.orderBy("label")) - 1).cast("bigint"))


def neutral_override(proba: str = "proba", neutral: int = 1, threshold: float = 0.25):
    """Argmax unless proba[neutral] >= threshold (then neutral)."""
    return F.when(F.element_at(F.col(proba), neutral + 1) >= F.lit(threshold), F.lit(neutral).cast("bigint")) \
            .otherwise(argmax_array(proba))


def threshold_grid(lo: float = 0.1, hi: float = 0.5, n: int = 20):
    """``numpy.linspace(lo, hi, n)`` as an array literal (fixed by parameters)."""
    step = (hi - lo) / (n - 1)
    vals = [lo + i * step for i in range(n)]
    vals[-1] = hi
    return F.array(*[F.lit(float(v)) for v in vals])


def threshold_sweep(pred: DataFrame, keys: Sequence[str] = ("model",), proba: str = "proba",
                    neutral: int = 1, lo: float = 0.1, hi: float = 0.5, n: int = 20,
                    y: str = "y_true") -> DataFrame:
    """Macro-F1 for every neutral threshold; ``is_best`` marks the first maximum.

    Thresholds are exploded per row (n rows each), scored by one grouped aggregate."""
    keys = list(keys)
    x = pred.select(*keys, y, proba, F.posexplode(threshold_grid(lo, hi, n)).alias("t_idx", "threshold"))
    x = x.withColumn("y_pred", neutral_override(proba, neutral, F.col("threshold")))
    s = accuracy_macro_f1(x, [*keys, "t_idx", "threshold"], y, "y_pred")
    # ties broken by threshold order after rounding away float noise (first best wins)
    w = Window.partitionBy(*keys).orderBy(F.round("macro_f1", 12).desc(), F.col("t_idx").asc())
    return s.withColumn("is_best", F.row_number().over(w) == 1).drop("n")


def calibration_curve(pred: DataFrame, keys: Sequence[str] = ("model",), proba: str = "proba",
                      classes: Sequence[int] = (0, 1, 2), n_bins: int = 10, y: str = "y_true") -> DataFrame:
    """One-vs-rest reliability table per class, uniform bins on [0, 1]:
    bin = number of inner edges i/n_bins strictly below p; mean predicted, observed
    rate and count per non-empty bin."""
    keys = list(keys)
    cls = F.array(*[F.lit(int(c)) for c in classes])
    x = pred.select(*keys, y, proba, F.explode(cls).alias("cls"))
    pc = F.element_at(F.col(proba), (F.col("cls") + 1).cast("int"))
    b = sum(((pc > F.lit(i / n_bins)).cast("int") for i in range(1, n_bins)), F.lit(0))
    x = x.select(*keys, "cls", pc.alias("p"), (F.col(y) == F.col("cls")).cast("double").alias("obs"),
                 b.cast("bigint").alias("bin"))
    return x.groupBy(*keys, F.col("cls").cast("bigint").alias("cls"), "bin").agg(
        F.avg("p").alias("mean_predicted"), F.avg("obs").alias("fraction_positive"),
        F.count(F.lit(1)).alias("count"))


def class_weights(train: DataFrame, y: str = "y_true", power: float = 1.0, labels: Sequence[int] | None = None,
                  keys: Sequence[str] = ()) -> DataFrame:
    """(n / (k * count_c)) ** power per class (power 2 = squared variant), within ``keys``.

    With ``labels`` every label of that list gets a row, also those without training rows: their
    count is 0 and weighs as 1, and k is the length of the list.  A class outside the list, or a
    null one, raises."""
    keys = list(keys)
    if labels is None:
        g = train.groupBy(*keys, F.col(y).alias("label")).agg(F.count(F.lit(1)).alias("count"))
    else:
        # one row of counts per key, so absent classes come from the list itself and not from a join
        labels = [int(c) for c in labels]
        known = F.when(F.col(y).isin(labels), F.lit(1)).otherwise(
            F.raise_error(F.format_string("Class %s is not among the labels", F.col(y).cast("string"))).cast("int"))
        counts = train.groupBy(*keys).agg(F.count(known).alias("_n"), *[F.count_if(F.col(y) == F.lit(c)).alias(f"_{i}") for i, c in enumerate(labels)])
        cells = F.array(*[F.struct(F.lit(c).cast("bigint").alias("label"), F.col(f"_{i}").alias("count")) for i, c in enumerate(labels)])
        g = counts.where("_n >= 0").select(*keys, F.explode(cells).alias("e")).select(*keys, "e.label", "e.count")
    w = Window.partitionBy(*keys)
    tot, k = F.sum("count").over(w), F.count(F.lit(1)).over(w)
    return g.withColumn("weight", F.pow(tot / (k * F.greatest(F.col("count"), F.lit(1))), F.lit(float(power))))


def _auc_from_counts(g: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Mann-Whitney AUC from (keys, score, pos, neg) rows, ties count one half; prefix sums run
    over ranges of equal row counts, however the scores are spread."""
    from tidemark.plans.scan import prefix_sums, ranged
    keys = list(keys)
    g = prefix_sums(ranged(g, [*keys, "score"]), keys, ["score"], {"neg_below": "neg"})
    return g.groupBy(*keys).agg(
        F.try_divide(F.sum(F.col("pos") * (F.col("neg_below") + 0.5 * F.col("neg"))),
                     F.sum("pos") * F.sum("neg")).alias("auc"),
        F.sum("pos").alias("n_pos"), F.sum("neg").alias("n_neg"))


def ovo_auc(pred: DataFrame, classes: Sequence[int] = (0, 1, 2), keys: Sequence[str] = ("model",),
            proba: str = "proba", y: str = "y_true") -> DataFrame:
    """One-vs-one macro AUC (Hand & Till, scikit-learn ``multi_class='ovo'``)
    per key group, computed on distinct scores (rows pre-aggregated by score)."""
    keys = list(keys)
    classes = [int(c) for c in classes]
    pairs = [(a, b) for i, a in enumerate(classes) for b in classes[i + 1:]]
    items = []
    for a, b in pairs:
        for pos, neg in ((a, b), (b, a)):
            items.append(F.when(F.col(y).isin(a, b), F.struct(
                F.lit(f"{a}-{b}").alias("pair"), F.lit(pos).alias("pos_class"),
                F.element_at(F.col(proba), pos + 1).alias("score"),
                (F.col(y) == pos).cast("bigint").alias("is_pos"))))
    x = pred.select(*keys, F.explode(F.filter(F.array(*items), lambda s: s.isNotNull())).alias("e"))
    g = x.groupBy(*keys, F.col("e.pair").alias("pair"), F.col("e.pos_class").alias("pos_class"),
                  F.col("e.score").alias("score")).agg(
        F.sum("e.is_pos").alias("pos"), F.sum(1 - F.col("e.is_pos")).alias("neg"))
    a = _auc_from_counts(g, [*keys, "pair", "pos_class"])
    # a pair with an absent class has no AUC; with two classes the AUC of the higher one counts
    per_pair = a.groupBy(*keys, "pair").agg(F.avg("auc").alias("pair_auc"), F.max_by("auc", "pos_class").alias("high_auc"))
    return per_pair.groupBy(*keys).agg(F.when(F.count("pair_auc") == 1, F.max("high_auc"))
                                       .otherwise(F.avg("pair_auc")).alias("auc_ovo"))


def roc_points(pred: DataFrame, classes: Sequence[int] = (0, 1, 2), keys: Sequence[str] = ("model",),
               proba: str = "proba", y: str = "y_true") -> DataFrame:
    """One-vs-rest ROC points per class at every distinct score (descending),
    tpr/fpr cumulative, plus the trapezoid AUC per class."""
    keys = list(keys)
    cls = F.array(*[F.lit(int(c)) for c in classes])
    x = pred.select(*keys, y, proba, F.explode(cls).alias("cls"))
    x = x.select(*keys, F.col("cls").cast("bigint").alias("cls"),
                 F.element_at(F.col(proba), (F.col("cls") + 1).cast("int")).alias("score"),
                 (F.col(y) == F.col("cls")).cast("bigint").alias("is_pos"))
    g = x.groupBy(*keys, "cls", "score").agg(F.sum("is_pos").alias("pos"), F.sum(1 - F.col("is_pos")).alias("neg"))
    from tidemark.plans.scan import _join_blocks, prefix_sums, ranged
    by = [*keys, "cls"]
    g = prefix_sums(ranged(g, [*by, "score"]), by, ["score"], {"pos_below": "pos", "neg_below": "neg"})
    tots = g.groupBy(*by).agg(F.sum("pos").alias("P"), F.sum("neg").alias("N"))  # one row per class
    g = _join_blocks(g, tots, by)
    # from the highest score down: the point before this one lacks just this score's rows
    tp, fp = F.col("P") - F.col("pos_below"), F.col("N") - F.col("neg_below")
    g = g.select(*by, "score", F.try_divide(tp, F.col("P")).alias("tpr"), F.try_divide(fp, F.col("N")).alias("fpr"),
                 F.coalesce(F.try_divide(tp - F.col("pos"), F.col("P")), F.lit(0.0)).alias("tpr_before"),
                 F.coalesce(F.try_divide(fp - F.col("neg"), F.col("N")), F.lit(0.0)).alias("fpr_before"))
    trap = (F.col("fpr") - F.col("fpr_before")) * (F.col("tpr") + F.col("tpr_before")) / 2
    g = _join_blocks(g, g.groupBy(*by).agg(F.sum(trap).alias("auc")), by)
    return g.select(*by, F.col("score").alias("threshold"), "tpr", "fpr", "auc")


def macro_roc(points: DataFrame, keys: Sequence[str] = ("model",), classes: Sequence[int] = (0, 1, 2)) -> DataFrame:
    """Macro-average ROC from ``roc_points``: at every distinct fpr of any class the mean of
    the class curves, each interpolated linearly, and the area under that mean curve.

    A class's curve at x is its highest tpr at fpr = x, else the line between its neighbours, found
    by a fill scan over ranges of (keys, fpr); a class without a curve does not count."""
    from tidemark.plans.scan import _join_blocks, neighbours, ranged
    keys = list(keys)
    curve = points.filter(F.col("fpr").isNotNull() & F.col("tpr").isNotNull()).select(*keys, "cls", "fpr", "tpr")
    # every curve starts at the origin; the points are read once
    rows = curve.select(*keys, "cls", F.explode(F.array(F.struct("fpr", "tpr"), F.struct(F.lit(0.0).alias("fpr"), F.lit(0.0).alias("tpr")))).alias("p"))
    x, y = F.col("p.fpr"), F.col("p.tpr")
    wide = rows.groupBy(*keys, x.alias("fpr")).agg(*[a for c in classes for a in (
        F.max(F.when(F.col("cls") == c, y)).alias(f"hi{c}"), F.min(F.when(F.col("cls") == c, y)).alias(f"lo{c}"))])
    known = [F.when(F.col(f"hi{c}").isNotNull(), F.struct("fpr", f"hi{c}", f"lo{c}")).alias(f"p{c}") for c in classes]
    d = neighbours(ranged(wide.select("*", *known), [*keys, "fpr"]), keys, ["fpr"], [f"p{c}" for c in classes])
    ys = []
    for c in classes:
        x0, y0 = F.col(f"prev_p{c}.fpr"), F.col(f"prev_p{c}.hi{c}")
        x1, y1 = F.col(f"next_p{c}.fpr"), F.col(f"next_p{c}.lo{c}")
        ys.append(F.coalesce(F.col(f"hi{c}"), y0 + (y1 - y0) * (F.col("fpr") - x0) / (x1 - x0), y0))
    counted = F.filter(F.array(*ys), lambda v: v.isNotNull())
    mean = F.aggregate(counted, F.lit(0.0), lambda a, v: a + v) / F.size(counted)
    d = d.select(*keys, "_part", "fpr", mean.alias("tpr")).withColumn("at", F.struct("fpr", "tpr"))
    d = neighbours(d, keys, ["fpr"], ["at"])
    part = (F.col("fpr") - F.col("prev_at.fpr")) * (F.col("tpr") + F.col("prev_at.tpr")) / 2
    d = d.select(*keys, "fpr", "tpr", F.coalesce(part, F.lit(0.0)).alias("part"))
    return _join_blocks(d, d.groupBy(*keys).agg(F.sum("part").alias("macro_auc")), keys).drop("part")


def cv_score_summary(scores: DataFrame, keys: Sequence[str], value: str = "score") -> DataFrame:
    """Mean and population std of fold scores per parameter/training size."""
    return scores.groupBy(*keys).agg(F.avg(value).alias("mean_score"),
                                     F.stddev_pop(value).alias("std_score"),
                                     F.count(F.lit(1)).alias("n_folds"))
