"""Edge fixtures."""

import datetime as dt
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.functions.numeric import deadband_target
from tidemark.functions.text import clean_news_text
from tidemark.operators import backtest as bt
from tidemark.operators import classify_metrics as cm
from tidemark.operators import decay, split, windows
from tidemark.operators import inference_stats as st
from tidemark.plans.ingest import lag_by_time

T0 = dt.datetime(2024, 1, 20, 12, 0, 0)


def _arts(spark, rows):
    return spark.createDataFrame(rows, "article_id long, publishedAt timestamp_ntz, topic string")


def test_window_bounds_closed_and_truncated(spark):
    """e_window: articles at t, t-L, t-L-1us, t+1us, t-30min (Q3, Q4)."""
    L = 24
    us = dt.timedelta(microseconds=1)
    rows = [(1, T0, "x"), (2, T0 - dt.timedelta(hours=L), "x"), (3, T0 - dt.timedelta(hours=L) - us, "x"),
            (4, T0 + us, "x"), (5, T0 - dt.timedelta(minutes=30), "x")]
    a = _arts(spark, rows)
    tg = spark.createDataFrame([(T0,)], "ts timestamp_ntz")
    got = decay.decayed_topic_counts(a, tg, L, 0.1).collect()
    # t: age 0 -> 1; t-L: age 24 -> exp(-2.4); t-30min: truncated age 0 -> 1
    assert len(got) == 1
    assert got[0]["weight"] == pytest.approx(2 + math.exp(-0.1 * 24), abs=1e-12)
    brute = decay.band_join_bruteforce(a, tg, L, 0.1).collect()
    assert brute[0]["weight"] == pytest.approx(got[0]["weight"], abs=1e-12)


def test_bucket_rewrite_equals_bruteforce_random(spark):
    rng = np.random.default_rng(7)
    base = dt.datetime(2024, 1, 1)
    rows = []
    for i in range(400):
        mins = int(rng.integers(0, 60 * 24 * 10))
        sec = int(rng.integers(0, 2)) * int(rng.integers(0, 3600))
        rows.append((i, base + dt.timedelta(minutes=mins, seconds=sec), f"t{rng.integers(0, 3)}"))
    a = _arts(spark, rows)
    tg = spark.createDataFrame([(base + dt.timedelta(hours=h),) for h in range(0, 240, 7)], "ts timestamp_ntz")
    for L, lam in [(24, 0.05), (72, 0.25), (168, 0.01)]:
        fast = {(r["ts"], r["topic"]): r["weight"] for r in decay.decayed_topic_counts(a, tg, L, lam).collect()}
        slow = {(r["ts"], r["topic"]): r["weight"] for r in decay.band_join_bruteforce(a, tg, L, lam).collect()}
        assert fast.keys() == slow.keys()
        for k in fast:
            assert fast[k] == pytest.approx(slow[k], rel=1e-12, abs=1e-12)
    grid = decay.decayed_topic_grid(a, tg, [24, 72], [0.05, 0.25]).collect()
    refs = {}
    for L in (24, 72):
        for lam in (0.05, 0.25):
            for x in decay.band_join_bruteforce(a, tg, L, lam).collect():
                refs[(L, lam, x["ts"], x["topic"])] = x["weight"]
    assert len(grid) == len(refs)
    for r in grid:
        assert refs[(r["lookback"], r["decay_lambda"], r["ts"], r["topic"])] == pytest.approx(r["weight"], rel=1e-12)


def test_null_and_nan_vectors_excluded(spark):
    """e_null_vec (Q7): NULL, NaN-holding and short vectors do not poison the mean."""
    df = spark.createDataFrame(
        [(1, T0, [1.0, 2.0]), (2, T0, None), (3, T0, [float("nan"), 1.0]), (4, T0, [5.0])],
        "article_id long, publishedAt timestamp_ntz, embedding array<double>")
    tg = spark.createDataFrame([(T0,)], "ts timestamp_ntz")
    got = sorted((r["dim"], r["value"]) for r in decay.decayed_embeddings(df, tg, 24, 0.05, dim=2).collect())
    assert got == [(0, 1.0), (1, 2.0)]


def test_deadband_inclusive(spark):
    """e_band (Q2): |spread| <= band is neutral; -0.0 -> 0; NULL stays NULL."""
    df = spark.createDataFrame([(3.0,), (-3.0,), (3.0000001,), (-3.5,), (0.0,), (-0.0,), (None,)], "s double")
    got = [r[0] for r in df.select(deadband_target("s", 3.0)).collect()]
    assert got == [0, 0, 1, -1, 0, 0, None]


def test_lag_by_time_gap(spark):
    """e_gap (Q1): a missing hour gives NULL instead of the wrong neighbour."""
    hrs = [0, 1, 2, 4, 5]
    df = spark.createDataFrame([("s", T0 + dt.timedelta(hours=h), float(h)) for h in hrs],
                               "series_id string, ts timestamp_ntz, v double")
    got = {r["ts"]: r["v_tlag_1"] for r in lag_by_time(df, ["v"], 1).collect()}
    assert got[T0 + dt.timedelta(hours=4)] is None
    assert got[T0 + dt.timedelta(hours=5)] == 4.0


def test_clean_text_cases(spark):
    """e_text (P1)."""
    cases = [None, "", "*** a *** b", "**x**", 'say "hi"', "a\t\n  b", "x  y", "  ***lead*** rest  "]
    df = spark.createDataFrame([(c,) for c in cases], "t string")
    got = [r[0] for r in df.select(clean_news_text("t")).collect()]
    assert got == [None, "", "b", "x", "say hi", "a b", "x y", "rest"]


def test_rolling_pearson_constant_and_min_pairs(spark):
    """e_const (W7): constant window -> NULL; fewer than 3 pairs -> NULL."""
    rows = [("k", i, 1.0, float(i)) for i in range(8)]
    df = spark.createDataFrame(rows, "k string, w int, x double, y double")
    got = windows.rolling_pearson(df, "x", "y", 4, ["k"], ["w"]).collect()
    assert all(r["corr"] is None for r in got)
    rows = [("k", i, float(i), float(2 * i + 1)) for i in range(8)]
    df = spark.createDataFrame(rows, "k string, w int, x double, y double")
    got = {r["w"]: r["corr"] for r in windows.rolling_pearson(df, "x", "y", 4, ["k"], ["w"]).collect()}
    assert all(got[i] is None for i in range(4))
    assert all(got[i] == pytest.approx(1.0) for i in range(4, 8))


def test_weekly_mean_empty_weeks(spark):
    """e_weeks (A9): weeks 1 and 3 only; Sunday 23:59 belongs to its own week."""
    d1 = dt.datetime(2024, 1, 1, 10)           # Monday, week ending 2024-01-07
    sun = dt.datetime(2024, 1, 7, 23, 59)      # Sunday, same week
    d3 = dt.datetime(2024, 1, 15, 10)          # week ending 2024-01-21
    df = spark.createDataFrame([(d1, 1.0), (sun, 3.0), (d3, 5.0)], "ts timestamp_ntz, v double")
    got = {r["week"]: r["v"] for r in windows.weekly_mean(df, "ts", ["v"]).collect()}
    assert got == {dt.datetime(2024, 1, 7): 2.0, dt.datetime(2024, 1, 14): None, dt.datetime(2024, 1, 21): 5.0}


def test_metrics_one_class_and_ties(spark):
    """e_oneclass (A22, A17): one class -> AUC NULL; ties count one half."""
    one = spark.createDataFrame([("m", i, 0, 0, [0.6, 0.3, 0.1]) for i in range(5)],
                                "model string, row_id long, y_true long, y_pred long, proba array<double>")
    assert cm.ovo_auc(one).collect()[0]["auc_ovo"] is None
    ties = spark.createDataFrame([("m", 0, 0, 0, [0.5, 0.5, 0.0]), ("m", 1, 1, 0, [0.5, 0.5, 0.0])],
                                 "model string, row_id long, y_true long, y_pred long, proba array<double>")
    assert cm.ovo_auc(ties, classes=[0, 1]).collect()[0]["auc_ovo"] == pytest.approx(0.5)
    r = cm.accuracy_macro_f1(ties).collect()[0]
    assert r["accuracy"] == pytest.approx(0.5)
    assert r["macro_f1"] == pytest.approx((2 / 3 + 0.0) / 2)


def test_mcnemar_no_discordant(spark):
    """e_nodiscord (A19): b + c = 0 -> NULL statistic and p-value."""
    rows = [(i, 1, 1, 1) for i in range(4)] + [(9, 0, 1, 1)]
    p = spark.createDataFrame(rows, "row_id long, y_true long, pred_a long, pred_b long")
    r = st.mcnemar(p).collect()[0]
    assert r["mcnemar_statistic"] is None and r["mcnemar_p_value"] is None
    rows = [(i, 1, 1, 0) for i in range(30)] + [(100 + i, 1, 0, 1) for i in range(10)]
    p = spark.createDataFrame(rows, "row_id long, y_true long, pred_a long, pred_b long")
    r = st.mcnemar(p).collect()[0]
    assert r["mcnemar_statistic"] == pytest.approx(19 ** 2 / 40)
    assert r["mcnemar_p_value"] == pytest.approx(math.erfc(math.sqrt(19 ** 2 / 40 / 2)), rel=1e-6)


@pytest.mark.parametrize("n", [0, 1, 2, 3, 10])
def test_chrono_split_guards(spark, n):
    """e_split (W9): tiny inputs raise instead of producing empty splits."""
    df = spark.createDataFrame([("s", T0 + dt.timedelta(hours=i)) for i in range(n)],
                               "series_id string, ts timestamp_ntz")
    if n < 10:
        with pytest.raises(Exception):
            rows = split.chrono_split(df).collect()
            if n == 0 and not rows:
                raise ValueError("empty")
    else:
        got = {r["row_index"]: r["split"] for r in split.chrono_split(df).collect()}
        assert [got[i] for i in range(10)] == ["train"] * 7 + ["val"] * 2 + ["test"]


def test_expanding_folds_capacity(spark):
    """e_split (W10): 913 rows allow 8 folds of 72 after 336; 337 rows raise."""
    df = spark.createDataFrame([("s", T0 + dt.timedelta(hours=i)) for i in range(913)],
                               "series_id string, ts timestamp_ntz")
    f = split.expanding_folds(df, n_splits=8, step=72, min_train=336)
    agg = {(r["fold"], r["role"]): (r["n"], r["lo"], r["hi"]) for r in
           f.groupBy("fold", "role").agg(F.count("*").alias("n"), F.min("row_index").alias("lo"),
                                         F.max("row_index").alias("hi")).collect()}
    for i in range(8):
        assert agg[(i, "train")] == (336 + 72 * i, 0, 336 + 72 * i - 1)
        assert agg[(i, "test")] == (72, 336 + 72 * i, 336 + 72 * (i + 1) - 1)
    small = spark.createDataFrame([("s", T0 + dt.timedelta(hours=i)) for i in range(337)],
                                  "series_id string, ts timestamp_ntz")
    with pytest.raises(Exception):
        split.expanding_folds(small, n_splits=8).collect()


def _reference_fold(actions, spreads, das, cost=0.06, init=100_000.0):
    v, eq = init, []
    for a, s, d in zip(actions, spreads, das):
        eq.append(v)
        if s is None or (isinstance(s, float) and math.isnan(s)) or a == 0:
            continue
        pos = v * 0.1
        mwh = min(pos / max(abs(d), 50.0) if v > 0 else 0.0, 200.0)
        g_unc = mwh * s * a
        m = pos * 0.1
        g = min(max(g_unc, -m), m)
        v = max(v + g - mwh * cost, 0.0)
    return eq, v


def test_backtest_edge_rows(spark):
    """e_bt (B1, Q11, Q14): NULL spread, action 0, capped P&L, state driven to 0."""
    acts = [1, 0, -1, 1, 1, 1, -1]
    spreads = [5.0, 3.0, None, 5000.0, -1e7, 2.0, 1.0]
    das = [40.0, 60.0, 55.0, 80.0, 10.0, 70.0, 50.0]
    rows = [("s", "x", T0 + dt.timedelta(hours=i), a, 50.0, d, s)
            for i, (a, s, d) in enumerate(zip(acts, spreads, das))]
    df = spark.createDataFrame(rows, "strategy string, series_id string, ts timestamp_ntz, action long, "
                                     "spot double, da double, real_spread_abs_shift_24 double")
    log = bt.portfolio_backtest(df).orderBy("period").collect()
    eq, final = _reference_fold(acts, spreads, das)
    assert [r["equity"] for r in log] == pytest.approx(eq)
    assert log[-1]["portfolio_value"] == pytest.approx(final)
    assert log[0]["return_pct"] == 0.0
    assert log[2]["action"] == 0 and log[2]["spread"] is None
    assert log[3]["pnl_was_capped"] is True
    assert log[1]["pnl_was_capped"] is None
    m = bt.backtest_metrics(spark.createDataFrame(log)).collect()[0]
    assert m["final_value"] == pytest.approx(eq[-1])      # Q11: last row never reaches it


def test_exact_quantiles_narrowing(spark):
    """A28 median: histogram narrowing == numpy linear quantile, incl. a hot value."""
    from tidemark.operators.eda import exact_quantiles
    rng = np.random.default_rng(3)
    vals = np.concatenate([rng.normal(size=3000), np.full(1500, 0.25), rng.exponential(size=500)])
    df = spark.createDataFrame([(float(v),) for v in vals], "v double")
    got = exact_quantiles(df, "v", [0.0, 0.1, 0.5, 0.77, 1.0], bins=8)
    want = np.quantile(vals, [0.0, 0.1, 0.5, 0.77, 1.0])
    assert got == pytest.approx(list(want), abs=1e-12)


def test_blockwise_windows_equal_plain(spark):
    """Rolling std and running drawdown by ranges == plain single-partition windows."""
    from tidemark.plans.scan import running_drawdown
    from pyspark.sql.window import Window as W
    rng = np.random.default_rng(11)
    rows = [("k", T0 + dt.timedelta(hours=i * 7), float(rng.normal())) for i in range(500)]
    rows += [("j", T0 + dt.timedelta(hours=i * 5), float(rng.normal())) for i in range(300)]
    df = spark.createDataFrame(rows, "key string, ts timestamp_ntz, v double")
    b = windows.rolling_std(df, "v", [24, 3], ["key"], ["ts"], ranges=60).withColumnRenamed("v_std_24", "s")
    p = df.withColumn("s", F.stddev_samp("v").over(W.partitionBy("key").orderBy("ts").rowsBetween(-23, 0)))
    got = {(r["key"], r["ts"]): r["s"] for r in b.collect()}
    want = {(r["key"], r["ts"]): r["s"] for r in p.collect()}
    assert got.keys() == want.keys()
    assert all((got[k] is None and want[k] is None) or got[k] == pytest.approx(want[k], rel=1e-9) for k in want)
    g = {(r["key"], r["ts"]): (r["equity"], r["running_max"]) for r in
         running_drawdown(df, ["key"], ["ts"], "v", n=40).collect()}
    w = {(r["key"], r["ts"]): (r["equity"], r["running_max"]) for r in
         windows.running_drawdown(df, "v", ["key"], ["ts"]).collect()}
    assert all(g[k] == pytest.approx(w[k], rel=1e-9, abs=1e-9) for k in w)


def test_bootstrap_user_metric_matches_builtin(spark):
    """A user metric over the weighted confusion cells == the built-in one."""
    rows = [("m", i, i % 3, (i * 7) % 3) for i in range(300)]
    p = spark.createDataFrame(rows, "model string, row_id long, y_true long, y_pred long")

    def acc(cells):
        return (cells["w"] * (cells["y_true"] == cells["y_pred"])).sum() / cells["w"].sum()

    a = st.bootstrap_confusion_metric(p, "accuracy", 50, 7).collect()[0]
    b = st.bootstrap_confusion_metric(p, n_boot=50, seed=7, user_metric=acc).collect()[0]
    assert a["mean"] == pytest.approx(b["mean"], abs=1e-12)
    assert a["lower"] == pytest.approx(b["lower"], abs=1e-12) and a["upper"] == pytest.approx(b["upper"], abs=1e-12)


def test_poisson_draws_are_exact(spark):
    """Moments and distribution of the draws for small and large cells; independent of the rows."""
    sizes = {1: 1, 2: 9, 3: 10, 4: 57, 5: 4_000, 6: 3_000_000_000}
    cells = spark.createDataFrame(list(sizes.items()), "cell long, n long")
    pdf = st.poisson_draws(cells, 4000, 3).toPandas()
    for cell, n in sizes.items():
        w = pdf[pdf["cell"] == cell]["w"].to_numpy(float)
        assert len(w) == 4000 and abs(w.mean() - n) < 5 * math.sqrt(n / 4000) and w.var() / n == pytest.approx(1, abs=0.12)
    w = pdf[pdf["cell"] == 4]["w"].to_numpy()
    cdf = np.cumsum([math.exp(-57 + k * math.log(57) - math.lgamma(k + 1)) for k in range(120)])
    assert max(abs(np.mean(w <= k) - cdf[k]) for k in range(120)) < 1.95 / math.sqrt(4000)  # Kolmogorov, 0.1 %
    pairs = pdf.pivot(index="rep", columns="cell", values="w")
    assert abs(np.corrcoef(pairs[4], pairs[5])[0, 1]) < 0.08


def test_bootstrap_interval_equals_plain_resampling(spark):
    rng = np.random.default_rng(0)
    y, a, b = rng.integers(0, 3, 600), rng.integers(0, 3, 600), rng.integers(0, 3, 600)
    a[:250], b[:200] = y[:250], y[:200]
    rows = [(m, i, int(y[i]), int(p[i])) for m, p in (("signal", a), ("baseline", b)) for i in range(600)]
    pred = spark.createDataFrame(rows, "model string, row_id long, y_true long, y_pred long")
    got = {r["side"]: r for r in st.bootstrap_accuracy(st.paired_predictions(pred), 1000, 5).collect()}
    f1 = {r["model"]: r for r in st.bootstrap_confusion_metric(pred, "accuracy", 1000, 5).collect()}
    for side, model, p in (("a", "signal", a), ("b", "baseline", b)):
        plain = [np.mean((p == y)[rng.integers(0, 600, 600)]) for _ in range(1000)]
        for r in (got[side], f1[model]):
            assert r["n_replicates"] == 1000 and r["mean"] == pytest.approx(np.mean(plain), abs=0.004)
            assert [r["lower"], r["upper"]] == pytest.approx(np.quantile(plain, [0.025, 0.975]).tolist(), abs=0.012)


def _row_weights(keys, n_boot, seed):
    """The (replicate, row) weights in numpy: murmur finalizer of the key, then of (seed, replicate, key)."""
    def mix(h):
        for shift, factor in ((16, 0x85EBCA6B), (13, 0xC2B2AE35)):
            h = (h ^ (h >> np.uint64(shift))) * np.uint64(factor) & np.uint64(0xFFFFFFFF)
        return h ^ (h >> np.uint64(16))
    k = np.array(keys, dtype=np.int64).astype(np.uint64)
    rep = np.arange(n_boot, dtype=np.uint64)[:, None] * np.uint64(0x9E3779B1)
    u = mix(mix(k & np.uint64(0xFFFFFFFF) ^ (k >> np.uint64(32)))[None, :] + rep + np.uint64(seed) & np.uint64(0xFFFFFFFF)) / 2.0 ** 32
    return np.searchsorted(np.cumsum([math.exp(-1) / math.factorial(i) for i in range(13)]), u, side="right")


def test_bootstrap_draws_for_every_row(spark):
    """Each row has a weight of its own in each replicate; repeated, null and negative keys and null predictions."""
    rng = np.random.default_rng(4)
    keys = [*range(40), 7 + (5 << 33), -3, None]
    y = [int(v) for v in rng.integers(0, 3, len(keys))]
    a, b = ([int(v) for v in rng.integers(0, 3, len(keys))] for _ in range(2))
    a[5], b[9] = None, None
    w = _row_weights([0 if k is None else k for k in keys], 200, 11)
    rows = [(m, k, t, q) for m, p in (("signal", a), ("baseline", b)) for k, t, q in zip(keys, y, p)]
    pred = spark.createDataFrame(rows, "model string, row_id long, y_true long, y_pred long")
    got = {r["side"]: r for r in st.bootstrap_accuracy(st.paired_predictions(pred), 200, 11).collect()}
    for side, p in (("a", a), ("b", b)):
        score = w @ np.array([q == t for q, t in zip(p, y)]) / w.sum(axis=1)
        want = [score.mean(), *np.quantile(score, [0.025, 0.975])]
        assert [got[side]["mean"], got[side]["lower"], got[side]["upper"]] == pytest.approx(want, abs=1e-12)
    some = [i for i in range(len(keys)) if i not in (5, 9)]
    twice = spark.createDataFrame([r for r in rows if r[1] not in (5, 9)] + [("signal", 1, y[1], y[1])], pred.schema)
    got = {r["model"]: r for r in st.bootstrap_confusion_metric(twice, "accuracy", 200, 11).collect()}
    for model, p, more in (("signal", a, w[:, 1]), ("baseline", b, 0)):
        score = (w[:, some] @ np.array([p[i] == y[i] for i in some]) + more) / (w[:, some].sum(axis=1) + more)
        want = [score.mean(), *np.quantile(score, [0.025, 0.975])]
        assert [got[model]["mean"], got[model]["lower"], got[model]["upper"]] == pytest.approx(want, abs=1e-12)


def test_bootstrap_counts_rows_without_truth(spark):
    """A null class counts like any other, as in the plain macro F1."""
    rows = [("m", i, None if i % 4 == 3 else i % 4, None if i % 4 == 3 else (i % 8) % 3) for i in range(2000)]
    pred = spark.createDataFrame(rows, "model string, row_id long, y_true long, y_pred long")
    plain = cm.accuracy_macro_f1(pred).collect()[0]["macro_f1"]
    got = st.bootstrap_confusion_metric(pred, "macro_f1", 200, 3).collect()[0]
    assert got["mean"] == pytest.approx(plain, abs=0.005) and got["lower"] < plain < got["upper"]


@pytest.mark.parametrize("fractional", [False, True])
def test_targets_at_any_instant(spark, fractional):
    """Second-exact targets, whole and fractional ages, equal the literal band join."""
    rng = np.random.default_rng(5)
    rows = [(i, T0 - dt.timedelta(minutes=int(rng.integers(0, 6000)), seconds=int(rng.integers(0, 60)) * (i % 3 == 0)), "xyz"[i % 3])
            for i in range(300)]
    times = [T0 + dt.timedelta(seconds=int(s)) for s in [0, 900, 1800, -2700, 17, 3601, 3599, *rng.integers(-300_000, 90_000, 40)]]
    times += [r[1] for r in rows[:6]] + [rows[3][1] + dt.timedelta(hours=24), rows[4][1] + dt.timedelta(hours=72)]
    times += [rows[3][1] + dt.timedelta(hours=24, microseconds=1)]
    a = _arts(spark, rows)
    tg = spark.createDataFrame([(t,) for t in times + times[:2]], "ts timestamp_ntz")
    how = {"fractional": True} if fractional else {"any_instant": True}
    grid = {}
    for r in decay.decayed_topic_grid(a, tg, [24, 72], [0.1, 0.5], **how).collect():
        grid.setdefault((r["lookback"], r["decay_lambda"]), {})[(r["ts"], r["topic"])] = r["weight"]
    for L in (24, 72):
        for lam in (0.1, 0.5):
            want = {(r["ts"], r["topic"]): r["weight"] for r in decay.band_join_bruteforce(a, tg, L, lam, fractional=fractional).collect()}
            assert grid[(L, lam)] == pytest.approx(want, rel=1e-9, abs=1e-12)
    one = {(r["ts"], r["topic"]): r["weight"] for r in decay.decayed_topic_counts(a, tg, 24, 0.1, **how).collect()}
    assert one == pytest.approx(grid[(24, 0.1)])


@pytest.mark.parametrize("how", [{"any_instant": True}, {"fractional": True}])
def test_embeddings_at_any_instant(spark, how):
    rng = np.random.default_rng(6)
    rows = [(i, T0 - dt.timedelta(seconds=int(rng.integers(0, 200_000))), rng.normal(size=3).tolist()) for i in range(80)]
    df = spark.createDataFrame(rows, "article_id long, publishedAt timestamp_ntz, embedding array<double>")
    times = [T0 + dt.timedelta(seconds=int(s)) for s in rng.integers(-100_000, 60_000, 12)]
    tg = spark.createDataFrame([(t,) for t in times], "ts timestamp_ntz")
    got = {(r["ts"], r["dim"]): r["value"] for r in decay.decayed_embeddings(df, tg, 24, 0.2, **how).collect()}
    want = {}
    for t in times:
        ages = [(t - r[1]).total_seconds() / 3600 for r in rows]
        w = np.array([np.exp(-0.2 * (x if "fractional" in how else np.floor(x))) if 0 <= x <= 24 else 0.0 for x in ages])
        if w.sum():
            mean = (w[:, None] * np.array([r[2] for r in rows])).sum(axis=0) / w.sum()
            want.update({(t, d): mean[d] for d in range(3)})
    assert got == pytest.approx(want, rel=1e-7, abs=1e-9)


def test_decay_guards(spark):
    a = _arts(spark, [(1, T0, "x")])
    tg = spark.createDataFrame([(T0 + dt.timedelta(minutes=5),)], "ts timestamp_ntz")
    with pytest.raises(Exception, match="any_instant"):
        decay.decayed_topic_counts(a, tg, 24, 0.1).collect()
    with pytest.raises(ValueError, match="700"):
        decay.decayed_topic_counts(a, tg, 504, 2.0)
    # long gaps, empty blocks and steep decay next to the limit
    far = _arts(spark, [(i, T0 - dt.timedelta(hours=int(h)), "x") for i, h in enumerate([0, 1, 139, 140, 141, 900, 4000, 4001])])
    hours = spark.createDataFrame([(T0 + dt.timedelta(hours=int(h)),) for h in (-4000, -3861, -3860, -800, -1, 0, 138, 140, 141)], "ts timestamp_ntz")
    for L, lam in ((140, 5.0), (140, 0.0), (1, 0.3)):
        got = {r["ts"]: r["weight"] for r in decay.decayed_topic_counts(far, hours, L, lam).collect()}
        want = {r["ts"]: r["weight"] for r in decay.band_join_bruteforce(far, hours, L, lam).collect()}
        assert got == pytest.approx(want, rel=1e-9, abs=1e-15)


def test_ovo_auc_with_two_classes(spark):
    """With two classes present the AUC of the higher class counts."""
    rows = [("m", y, p) for y, p in [(0, [.6, .1, .3]), (0, [.2, .1, .7]), (2, [.3, .1, .6]), (2, [.5, .3, .2]), (2, [.1, .1, .8])]]
    pred = spark.createDataFrame(rows, "model string, y_true long, proba array<double>")
    pos, neg = [.6, .2, .8], [.3, .7]
    want = np.mean([(a > b) + 0.5 * (a == b) for a in pos for b in neg])
    assert cm.ovo_auc(pred).first()["auc_ovo"] == pytest.approx(want)


def test_backtest_costs_per_row_and_null_key(spark):
    """B1: a cost column may change from row to row, and a null key is a key."""
    rows = [(None, T0 + dt.timedelta(hours=i), 1, 60.0, 0.0, float(i)) for i in range(3)]
    df = spark.createDataFrame(rows, "k double, ts timestamp_ntz, action long, da double, s double, fee double")
    log = bt.portfolio_backtest(df.withColumn("spot", F.lit(1.0)), ["k"], spread="s", cost="fee").orderBy("period").collect()
    v, want = 100_000.0, []
    for fee in (0.0, 1.0, 2.0):
        want.append(v)
        v -= min(v * 0.1 / 60.0, 200.0) * fee
    assert [r["equity"] for r in log] == pytest.approx(want) and [r["period"] for r in log] == [0, 1, 2]


def test_block_joins_keep_null_keys_and_nan_scores(spark):
    """Rows in = rows out for null keys and times; NaN scores sort above all numbers."""
    from tidemark.plans.scan import global_row_number
    df = spark.createDataFrame([(None, T0), ("a", None), ("a", T0)], "k string, ts timestamp_ntz")
    assert global_row_number(df, ["k"], ["ts"]).count() == 3
    rows = [("m", i % 2, [float("nan") if i == 3 else 0.1 * i, 0.5]) for i in range(8)]
    pred = spark.createDataFrame(rows, "model string, y_true long, proba array<double>")
    points = cm.roc_points(pred, [0]).orderBy(F.desc("threshold")).collect()
    assert math.isnan(points[0]["threshold"]) and [r["tpr"] for r in points] == sorted(r["tpr"] for r in points)


def test_macro_roc_is_the_mean_of_interpolated_curves(spark):
    rng = np.random.default_rng(9)
    y, p = rng.integers(0, 3, 60), rng.dirichlet([1, 1, 1], 60)
    pred = spark.createDataFrame([("m", int(a), [float(x) for x in b]) for a, b in zip(y, p)],
                                 "model string, y_true long, proba array<double>")
    points = cm.roc_points(pred)
    got = cm.macro_roc(points).orderBy("fpr").collect()
    curves = {}
    for c in range(3):
        xy = sorted((r["fpr"], r["tpr"]) for r in points.filter(F.col("cls") == c).collect())
        curves[c] = ([0.0] + [a for a, _ in xy], [0.0] + [b for _, b in xy])
    for r in got:
        at = []
        for xs, ys in curves.values():
            same = [b for a, b in zip(xs, ys) if a == r["fpr"]]
            at.append(max(same) if same else np.interp(r["fpr"], xs, ys))
        assert r["tpr"] == pytest.approx(np.mean(at))
    area = sum((b["fpr"] - a["fpr"]) * (a["tpr"] + b["tpr"]) / 2 for a, b in zip(got, got[1:]))
    assert got[0]["macro_auc"] == pytest.approx(area)


@pytest.mark.parametrize("ranges", [1, 7, 90])
def test_shifts_cross_ranges_in_one_dense_month(spark, ranges):
    """Lags and leads reach over as many ranges as they need; all rows lie in one day,
    one key holds most of them, others have fewer rows than the shift, null keys and times stay."""
    from tidemark.plans.scan import global_row_number, ranged, windowed
    keys = ["hot"] * 240 + [None] * 20 + ["a"] * 3 + ["b"] * 37
    rows = [(k, T0 + dt.timedelta(seconds=i), i) for i, k in enumerate(keys)] + [("b", None, 300)]
    df = spark.createDataFrame(rows, "k string, ts timestamp_ntz, v bigint").repartition(6)
    got = windowed(df, ["k"], ["ts"], 30, 11, {"back": lambda w: F.lag("v", 30).over(w), "ahead": lambda w: F.lead("v", 11).over(w),
                                               "place": lambda w: F.col("_rn")}, n=ranges)
    assert got.columns == ["k", "ts", "v", "back", "ahead", "place"]
    got = {r["v"]: r for r in got.collect()}
    assert len(got) == len(rows)
    numbers = {r["v"]: (r["rn"], r["n_rows"]) for r in global_row_number(df, ["k"], ["ts"], n=ranges).collect()}
    for key in {k for k, _, _ in rows}:
        same = [v for _, ts, v in sorted((r for r in rows if r[0] == key), key=lambda r: (r[1] is not None, r[1] or T0))]
        for i, v in enumerate(same):
            assert got[v]["back"] == (same[i - 30] if i >= 30 else None)
            assert got[v]["ahead"] == (same[i + 11] if i + 11 < len(same) else None)
            assert got[v]["place"] == i + 1 and numbers[v] == (i + 1, len(same))
    if ranges == 7:
        sizes = [r["count"] for r in ranged(df, ["k", "ts"], n=7).groupBy("_part").count().collect()]
        assert len(sizes) >= 6 and max(sizes) <= 90


def test_range_scans_of_empty_tables(spark):
    from tidemark.plans.scan import running_drawdown
    df = spark.createDataFrame([], "k string, ts timestamp_ntz, v double")
    assert windows.rolling_std(df, "v", [5], ["k"], ["ts"]).count() == 0
    assert running_drawdown(df, ["k"], ["ts"], "v").count() == 0


def test_drawdown_of_leading_nulls(spark):
    from tidemark.plans.scan import running_drawdown
    rows = [("k", T0 + dt.timedelta(hours=i), None if i < 9 or i % 5 == 0 else float((i * 37) % 11 - 5)) for i in range(60)]
    df = spark.createDataFrame(rows, "k string, ts timestamp_ntz, v double")
    cols = ["ts", "equity", "running_max", "drawdown", "drawdown_pct"]
    got = running_drawdown(df, ["k"], ["ts"], "v", n=20).select(cols).orderBy("ts").collect()
    assert got == windows.running_drawdown(df, "v", ["k"], ["ts"]).select(cols).orderBy("ts").collect()
