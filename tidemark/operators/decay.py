"""Exponentially time-decayed, look-back-bounded aggregation.

Semantics (per target hour ``t`` and article time ``a``):

* window is closed at both ends: ``t - L <= a <= t``;
* weight ``exp(-lambda * floor((t - a) in hours))`` (truncated whole hours);
* topics: sum of weights per topic; embeddings: sum(w * v) / sum(w), zero vector
  when sum(w) <= 1e-10.

Exact rewrite (no band join, no copy per hour of age).  With ``h = ceil_hour(a)`` and
``on = (a == h)``, for an hour-aligned ``t`` the truncated age is ``k = t - h`` and ``a >= t - L``
holds iff ``k < L`` or (``k == L`` and ``on``).  So articles first collapse to hour cells (``n``,
``n_on``; partial aggregation before the shuffle removes any hot topic or hour), and a window
is the difference of two decayed prefixes.  Prefixes are kept per block of as many hours as the
longest look-back and rebased to the block's end, so that no weight leaves the range of a double:
``_prefixes`` gives each cell the decayed sum of its block up to it and the rest of its block
after it.  A window meets at most two blocks: it is the sum up to ``t`` in the block of ``t``
less the decayed sum up to ``t - L`` (same block) or plus the decayed rest after ``t - L`` (block
before).  ``_emit`` hands every prefix to the targets that need it, one row per look-back, and a
grouped sum gives all windows and lambdas at once.

Targets at any instant: ``any_instant=True`` lays a lattice of whole hours back from every
target, counts the articles up to each lattice point by one sorted sweep over articles and points
(range-partitioned, carries at the range borders) and goes on with the lattice's hours as cells.
``fractional=True`` weighs by ``exp(-lambda * hours)`` without truncation; there the sweep itself
carries the decayed prefixes, at ``t`` and ``t - L``.

Precision: differences lose what the window's weight lies below the prefix: about 1e-16 x the
article count of a look-back, relative to the window's weight.  ``lambda * lookback`` must not
exceed 700 (beyond, the oldest weights would leave the range of a double).

Output is long and sparse: a (t, topic) row exists iff the window holds at least
one article.  Absent rows mean weight 0 (the reference's empty-window value); the
model-input pivot fills them with 0 (P9).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.functions.timecal import ceil_hour, fractional_hours_between, whole_hours_between

# The reference's parameter grid and defaults.
LOOKBACK_WINDOWS = [24, 48, 72, 168, 336, 504]
TIME_DECAY_LAMBDAS = [0.01, 0.05, 0.1, 0.25, 0.5]
DEFAULT_LOOKBACK = 336
DEFAULT_LAMBDA = 0.05
MIN_WEIGHT_SUM = 1e-10


def _epoch():
    return F.lit("1970-01-01 00:00:00").cast("timestamp_ntz")


def hour_index(ts_col) -> "F.Column":
    """Whole hours since 1970-01-01 of a TIMESTAMP_NTZ (wall-clock arithmetic: no
    session time zone involved)."""
    c = F.col(ts_col) if isinstance(ts_col, str) else ts_col
    return F.timestamp_diff("HOUR", _epoch(), c).cast("bigint")


def from_hour_index(col) -> "F.Column":
    c = F.col(col) if isinstance(col, str) else col
    return F.timestamp_add("HOUR", c, _epoch())


def exclude_other(articles: DataFrame, topic: str, other_label: str | None) -> DataFrame:
    """Drop the "other" topic (NULL topics survive the ``<=>`` test and are
    removed by the NOT NULL filter, as in the reference)."""
    out = articles
    if other_label is not None:
        out = out.filter(~(F.col(topic).eqNullSafe(F.lit(other_label))))
    return out.filter(F.col(topic).isNotNull())


def topic_buckets(articles: DataFrame, ts: str = "publishedAt", topic: str = "topic",
                  other_label: str | None = None) -> DataFrame:
    """(topic, hi, n, n_on): article counts per topic and ceiling hour (hour index)."""
    a = exclude_other(articles.filter(F.col(ts).isNotNull()), topic, other_label)
    h = ceil_hour(ts)
    return (a.select(F.col(topic).alias("topic"), hour_index(h).alias("hi"), (F.col(ts) == h).alias("on"))
            .groupBy("topic", "hi")
            .agg(F.count(F.lit(1)).alias("n"), F.count_if("on").alias("n_on")))


def _prefixes(cells: DataFrame, keys: Sequence[str], lambdas: Sequence[float], sums: Sequence[str], width: float) -> DataFrame:
    """Per cell (keys, x in hours, sums, each with ``_on``): block end ``e``, and per lambda i and sum
    the decayed block prefix ``p{i}_{sum}``, valued at x, and rest of the block ``r{i}_{sum}``,
    valued at e; the plain counts are ``p_n`` and ``r_n``."""
    end = (F.floor(F.col("x") / width) + 1) * width
    d = cells.withColumn("e", end.cast("double"))
    upto = Window.partitionBy(*keys, "e").orderBy("x").rowsBetween(Window.unboundedPreceding, 0)
    after = Window.partitionBy(*keys, "e").orderBy("x").rowsBetween(1, Window.unboundedFollowing)
    out = [F.sum("n").over(upto).alias("p_n"), F.coalesce(F.sum("n").over(after), F.lit(0)).alias("r_n")]
    for i, lam in enumerate(lambdas):
        w = F.exp(F.lit(-float(lam)) * (F.col("e") - F.col("x")))
        for c in sums:
            out += [(F.sum(F.col(c) * w).over(upto) / w).alias(f"p{i}_{c}"),
                    F.coalesce(F.sum(F.col(c) * w).over(after), F.lit(0.0)).alias(f"r{i}_{c}")]
    return d.select("*", *out)


def _fill_hours(d: DataFrame, keys: Sequence[str], lambdas: Sequence[float], sums: Sequence[str]) -> DataFrame:
    """Prefixes at every whole hour from a cell to the next one of its block, or the block's end:
    the prefix fades, the rest of the block stays."""
    nxt = F.lead("x").over(Window.partitionBy(*keys, "e").orderBy("x"))
    d = d.withColumn("nx", F.coalesce(nxt, F.col("e").cast("bigint")))
    d = d.select("*", F.explode(F.sequence(F.col("x"), F.greatest(F.col("nx") - 1, F.col("x")))).alias("y"))
    own = F.col("y") == F.col("x")
    cols = [F.col("y").alias("x"), "e", "p_n", "r_n", *[F.when(own, F.col(f"{c}_on")).otherwise(0).alias(f"{c}_on") for c in sums]]
    for i, lam in enumerate(lambdas):
        fade = F.exp(F.lit(-float(lam)) * (F.col("y") - F.col("x")))
        for c in sums:
            cols += [(F.col(f"p{i}_{c}") * fade).alias(f"p{i}_{c}"), F.col(f"r{i}_{c}")]
    return d.select(*keys, *cols)


def _emit(d: DataFrame, targets: DataFrame, join: Sequence[str], keys: Sequence[str], lookbacks: Sequence[int], lambdas: Sequence[float],
          sums: Sequence[str], width: float, unit: int = 1) -> DataFrame:
    """(keys, t, lookback, decay_lambda, cnt, sums) of every non-empty window.  ``d``: prefixes at
    points ``at`` (``unit`` per hour, x = at / unit); ``targets``: (join..., t) distinct."""
    # a point is the end of the windows that stop there and the start of those L hours later
    roles = F.explode(F.array(*[F.struct(F.lit(lag).cast("bigint").alias("lag"), F.lit(int(v)).cast("bigint").alias("lookback"))
                                for v in lookbacks for lag in (0, int(v))])).alias("role")
    d = d.select("*", roles).select("*", "role.lag", "role.lookback").withColumn("t", F.col("at") + F.col("lag") * unit)
    d = d.join(targets, [*join, "t"], "left_semi")
    hour = F.col("t") / unit
    own = F.col("lag") == 0
    same = F.floor(hour / width) == F.floor(F.col("x") / width)
    aggs = [F.sum(F.when(own, F.col("p_n")).when(same, F.col("n_on") - F.col("p_n")).otherwise(F.col("r_n") + F.col("n_on"))).alias("cnt")]
    for i, lam in enumerate(lambdas):
        lag = F.exp(F.lit(-float(lam)) * F.col("lag"))
        gap = F.exp(F.lit(-float(lam)) * (hour - F.col("e")))
        for c in sums:
            start = F.when(same, lag * (F.col(f"{c}_on") - F.col(f"p{i}_{c}"))).otherwise(gap * F.col(f"r{i}_{c}") + lag * F.col(f"{c}_on"))
            aggs.append(F.sum(F.when(own, F.col(f"p{i}_{c}")).otherwise(start)).alias(f"s{i}_{c}"))
    g = d.groupBy(*keys, "t", "lookback").agg(*aggs).filter("cnt > 0")
    each = F.explode(F.array(*[F.struct(F.lit(float(lam)).alias("decay_lambda"), *[F.col(f"s{i}_{c}").alias(f"s_{c}") for c in sums])
                               for i, lam in enumerate(lambdas)])).alias("w")
    return g.select(*keys, "t", "lookback", "cnt", each).select(*keys, "t", "lookback", "cnt", "w.*")


def _check_span(lookbacks: Sequence[int], lambdas: Sequence[float]) -> None:
    if max(lookbacks) * max(abs(float(v)) for v in lambdas) > 700:
        raise ValueError("decay_lambda * lookback must not exceed 700")


def hour_windows(cells: DataFrame, targets: DataFrame, keys: Sequence[str], lookbacks: Sequence[int], lambdas: Sequence[float],
                 sums: Sequence[str] = ("n",), join: Sequence[str] = ()) -> DataFrame:
    """All (look-back, lambda) windows over hour cells (keys, hi, n, n_on[, sv, sv_on]) at the whole
    hours ``t`` of ``targets`` (distinct, with the ``join`` keys): (keys, t, lookback, decay_lambda,
    cnt, s_<sum>...).  Cells of one (keys, hour) in several rows add up."""
    _check_span(lookbacks, lambdas)
    width = max(int(v) for v in lookbacks)
    both = [c for s in sums for c in (s, f"{s}_on")]
    # with a cell of zeros at the start of its block, so that every later hour of it has a prefix
    head = F.struct((F.floor(F.col("hi") / width) * width).cast("bigint").alias("x"), *[F.lit(0).cast(cells.schema[c].dataType).alias(c) for c in both])
    rows = cells.select(*keys, F.explode(F.array(F.struct(F.col("hi").alias("x"), *both), head)).alias("c"))
    d = rows.groupBy(*keys, "c.x").agg(*[F.sum(f"c.{c}").alias(c) for c in both])
    d = _fill_hours(_prefixes(d, keys, lambdas, sums, width), keys, lambdas, sums)
    return _emit(d.withColumn("at", F.col("x")), targets, join, keys, lookbacks, lambdas, sums, width)


HOUR_US = 3_600_000_000


def _instant(ts: str):
    return F.timestamp_diff("MICROSECOND", _epoch(), F.col(ts)).cast("bigint")


def _sweep(events: DataFrame, points: DataFrame, keys: Sequence[str], sums: Sequence[str]) -> DataFrame:
    """Articles and points merged by (keys, at): own sums, ``probe`` and the block-wise running sums
    ``c_<sum>`` up to and including ``at``."""
    from tidemark.plans.scan import ranged
    zeros = [F.lit(0.0 if c != "n" else 0).cast(events.schema[c].dataType).alias(c) for c in sums]
    rows = (events.select(*keys, "at", *sums, F.lit(0).alias("probe"))
            .unionByName(points.select(*keys, "at", *zeros, F.lit(1).alias("probe")))
            .groupBy(*keys, "at").agg(*[F.sum(c).alias(c) for c in sums], F.max("probe").alias("probe")))
    d = ranged(rows, [*keys, "at"])
    totals = d.groupBy(*keys, "_part").agg(*[F.sum(c).alias(f"t_{c}") for c in sums])
    before = Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # one row per range
    carry = totals.select(*keys, "_part", *[F.coalesce(F.sum(f"t_{c}").over(before), F.lit(0)).alias(f"b_{c}") for c in sums])
    inside = Window.partitionBy(*keys, "_part").orderBy("at").rowsBetween(Window.unboundedPreceding, 0)
    d = d.select("*", *[F.sum(c).over(inside).alias(f"i_{c}") for c in sums]).join(carry, [*keys, "_part"])
    return d.select(*keys, "at", *sums, "probe", *[(F.col(f"b_{c}") + F.col(f"i_{c}")).alias(f"c_{c}") for c in sums])


def _lattice_cells(events: DataFrame, targets: DataFrame, keys: Sequence[str], each, lookback: int, sums: Sequence[str]) -> DataFrame:
    """Hour cells (keys, phase, hi, sums and ``_on``) of the lattice of whole hours back from each
    target, from the running sums at the lattice points.  ``each``: array of the key's values."""
    hours = F.explode(F.sequence(F.lit(0), F.lit(int(lookback) + 1))).alias("k")
    points = (targets.select("at", hours).select((F.col("at") - F.col("k") * HOUR_US).alias("at")).distinct()
              .select("at", F.explode(each).alias(keys[0])))
    d = _sweep(events, points, keys, sums).filter("probe = 1").select(
        "*", F.pmod("at", F.lit(HOUR_US)).alias("phase"), F.floor(F.col("at") / HOUR_US).cast("bigint").alias("hi"))
    w = Window.partitionBy(*keys, "phase").orderBy("hi")
    linked = F.lag("hi").over(w) == F.col("hi") - 1
    # a point without one an hour before it is older than every window that meets it
    return d.select(*keys, "phase", "hi", *[F.when(linked, F.col(f"c_{c}") - F.lag(f"c_{c}").over(w)).otherwise(F.col(c)).alias(c) for c in sums],
                    *[F.col(c).alias(f"{c}_on") for c in sums])


def _any_instant(events: DataFrame, targets: DataFrame, keys: Sequence[str], each, lookbacks, lambdas, sums) -> DataFrame:
    """``hour_windows`` at any instants: (keys, ts, lookback, decay_lambda, cnt, s_...)."""
    cells = _lattice_cells(events, targets, keys, each, max(lookbacks), sums)
    own = targets.select(F.pmod("at", F.lit(HOUR_US)).alias("phase"), F.floor(F.col("at") / HOUR_US).cast("bigint").alias("t"))
    w = hour_windows(cells, own, [*keys, "phase"], lookbacks, lambdas, sums, join=["phase"])
    return w.withColumn("ts", _from_instant(F.col("t") * HOUR_US + F.col("phase")))


def _fractional(events: DataFrame, targets: DataFrame, keys: Sequence[str], each, lookbacks, lambdas, sums) -> DataFrame:
    """Windows weighted by exact ages: prefixes at ``t`` and ``t - L`` from one sweep per block."""
    _check_span(lookbacks, lambdas)
    width = max(int(v) for v in lookbacks)
    steps = F.explode(F.array(F.lit(0).cast("bigint"), *[F.lit(int(v) * HOUR_US) for v in lookbacks])).alias("back")
    points = (targets.select("at", steps).select((F.col("at") - F.col("back")).alias("at")).distinct().select("at", F.explode(each).alias(keys[0])))
    zeros = [F.lit(0).cast(events.schema[c].dataType).alias(c) for c in sums]
    rows = (events.select(*keys, "at", *sums).unionByName(points.select(*keys, "at", *zeros))
            .groupBy(*keys, "at").agg(*[F.sum(c).alias(c) for c in sums]))
    d = _prefixes(rows.withColumn("x", F.col("at") / HOUR_US).select("*", *[F.col(c).alias(f"{c}_on") for c in sums]), keys, lambdas, sums, width)
    w = _emit(d, targets.select(F.col("at").alias("t")), [], keys, lookbacks, lambdas, sums, width, unit=HOUR_US)
    return w.withColumn("ts", _from_instant(F.col("t")))


def _from_instant(us) -> "F.Column":
    return F.timestamp_add("MICROSECOND", us, _epoch())


def _instants(targets: DataFrame, target_ts: str) -> DataFrame:
    return targets.filter(F.col(target_ts).isNotNull()).select(_instant(target_ts).alias("at")).distinct()


def _target_hours(targets: DataFrame, ts: str) -> DataFrame:
    """The distinct target hours (bounded by the time span); an instant off the hour raises."""
    whole = F.date_trunc("hour", F.col(ts)).cast("timestamp_ntz") == F.col(ts)
    return targets.filter(F.col(ts).isNotNull()).select(
        F.when(whole, hour_index(ts)).otherwise(F.raise_error(F.lit(
            "a target is not on the hour: pass any_instant=True")).cast("bigint")).alias("t")).distinct()


def _topic_events(articles: DataFrame, ts: str, topic: str, other_label: str | None) -> tuple[DataFrame, F.Column]:
    """(topic, at, n) per instant, and the array of topics (the label set, one row each)."""
    a = exclude_other(articles.filter(F.col(ts).isNotNull()), topic, other_label).select(F.col(topic).alias("topic"), _instant(ts).alias("at"))
    names = sorted(r[0] for r in a.select("topic").distinct().collect())
    each = F.array(*[F.lit(v) for v in names]) if names else F.array().cast("array<string>")
    return a.groupBy("topic", "at").agg(F.count(F.lit(1)).alias("n")), each


def decayed_topic_grid(articles: DataFrame, targets: DataFrame,
                       lookbacks: Sequence[int] = LOOKBACK_WINDOWS,
                       lambdas: Sequence[float] = TIME_DECAY_LAMBDAS,
                       *, ts: str = "publishedAt", topic: str = "topic",
                       target_ts: str = "ts", other_label: str | None = None,
                       any_instant: bool = False, fractional: bool = False) -> DataFrame:
    """A3 (topics): (lookback, decay_lambda, ts, topic, weight) of all pairs at once, sparse as in A1."""
    if any_instant or fractional:
        events, each = _topic_events(articles, ts, topic, other_label)
        run = _fractional if fractional else _any_instant
        w = run(events, _instants(targets, target_ts), ["topic"], each, lookbacks, lambdas, ["n"])
    else:
        b = topic_buckets(articles, ts, topic, other_label)
        w = hour_windows(b, _target_hours(targets, target_ts), ["topic"], lookbacks, lambdas).withColumn("ts", from_hour_index("t"))
    return w.select("lookback", "decay_lambda", "ts", "topic", F.greatest("s_n", F.lit(0.0)).alias("weight"))


def decayed_topic_counts(articles: DataFrame, targets: DataFrame,
                         lookback: int = DEFAULT_LOOKBACK, decay_lambda: float = DEFAULT_LAMBDA,
                         *, ts: str = "publishedAt", topic: str = "topic",
                         target_ts: str = "ts", other_label: str | None = None,
                         any_instant: bool = False, fractional: bool = False) -> DataFrame:
    """A1: (ts, topic, weight) with weight = sum of exp(-lambda * whole hours).  Targets lie on the
    hour; ``any_instant`` allows others, ``fractional`` weighs by exact ages (any instant too)."""
    return decayed_topic_grid(articles, targets, [lookback], [decay_lambda], ts=ts, topic=topic, target_ts=target_ts, other_label=other_label,
                              any_instant=any_instant, fractional=fractional).select("ts", "topic", "weight")


def decayed_from_buckets(b: DataFrame, targets: DataFrame, lookback: int = DEFAULT_LOOKBACK,
                         decay_lambda: float = DEFAULT_LAMBDA, *, target_ts: str = "ts") -> DataFrame:
    """A1 from a (topic, hi or h, n, n_on) bucket table (batch or streamed buckets; rows
    with the same (topic, hour) from different micro-batches simply add up)."""
    if "hi" not in b.columns:             # bucket tables keyed by a timestamp (streamed)
        b = b.withColumn("hi", hour_index("h")).drop("h")
    w = hour_windows(b, _target_hours(targets, target_ts), ["topic"], [lookback], [decay_lambda])
    return w.select(from_hour_index("t").alias("ts"), "topic", F.greatest("s_n", F.lit(0.0)).alias("weight"))


def valid_vectors(df: DataFrame, vec: str = "embedding", dim: int | None = None) -> DataFrame:
    """Drop NULL vectors, vectors holding NULL/NaN and wrong-width vectors."""
    cond = F.col(vec).isNotNull() & ~F.exists(vec, lambda v: v.isNull() | F.isnan(v))
    if dim is not None:
        cond = cond & (F.size(vec) == int(dim))
    return df.filter(cond)


def embedding_buckets(articles: DataFrame, ts: str = "publishedAt", vec: str = "embedding",
                      dim: int | None = None) -> DataFrame:
    """(hi, pos, n, n_on, sv, sv_on): per ceiling hour (index) and vector position.

    ``posexplode`` and the partial aggregate run in the same map stage, so the
    shuffle carries one row per (hour, position) per task."""
    a = valid_vectors(articles.filter(F.col(ts).isNotNull()), vec, dim)
    h = ceil_hour(ts)
    x = a.select(hour_index(h).alias("hi"), (F.col(ts) == h).alias("on"), F.posexplode(vec).alias("pos", "v"))
    v = F.col("v").cast("double")
    return (x.groupBy("hi", "pos")
            .agg(F.count(F.lit(1)).alias("n"), F.count_if("on").alias("n_on"),
                 F.sum(v).alias("sv"), F.sum(F.when(F.col("on"), v).otherwise(0.0)).alias("sv_on")))


def decayed_embedding_grid(articles: DataFrame, targets: DataFrame,
                           lookbacks: Sequence[int] = LOOKBACK_WINDOWS,
                           lambdas: Sequence[float] = TIME_DECAY_LAMBDAS,
                           *, ts: str = "publishedAt", vec: str = "embedding",
                           target_ts: str = "ts", dim: int | None = None,
                           any_instant: bool = False, fractional: bool = False) -> DataFrame:
    """A3 (embeddings): (lookback, decay_lambda, ts, dim, value) of all pairs at once, with
    value = sum(w * v) / sum(w) per position."""
    sums = ["n", "sv"]
    if any_instant or fractional:
        a = valid_vectors(articles.filter(F.col(ts).isNotNull()), vec, dim).select(_instant(ts).alias("at"), F.posexplode(vec).alias("pos", "v"))
        events = a.groupBy("pos", "at").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("v").cast("double")).alias("sv"))
        most = dim or (valid_vectors(articles, vec).agg(F.max(F.size(vec))).first()[0] or 0)
        each = F.sequence(F.lit(0), F.lit(int(most) - 1)) if most else F.array().cast("array<int>")
        run = _fractional if fractional else _any_instant
        w = run(events, _instants(targets, target_ts), ["pos"], each, lookbacks, lambdas, sums)
    else:
        b = embedding_buckets(articles, ts, vec, dim)
        w = hour_windows(b, _target_hours(targets, target_ts), ["pos"], lookbacks, lambdas, sums).withColumn("ts", from_hour_index("t"))
    value = F.when(F.col("s_n") > MIN_WEIGHT_SUM, F.col("s_sv") / F.col("s_n")).otherwise(F.lit(0.0))
    return w.select("lookback", "decay_lambda", "ts", F.col("pos").cast("bigint").alias("dim"), value.alias("value"))


def decayed_embeddings(articles: DataFrame, targets: DataFrame,
                       lookback: int = DEFAULT_LOOKBACK, decay_lambda: float = DEFAULT_LAMBDA,
                       *, ts: str = "publishedAt", vec: str = "embedding",
                       target_ts: str = "ts", dim: int | None = None,
                       any_instant: bool = False, fractional: bool = False) -> DataFrame:
    """A2 in long form: (ts, dim, value) = sum(w * v) / sum(w) per position."""
    return decayed_embedding_grid(articles, targets, [lookback], [decay_lambda], ts=ts, vec=vec, target_ts=target_ts, dim=dim,
                                  any_instant=any_instant, fractional=fractional).select("ts", "dim", "value")


def topic_features_wide(long_df: DataFrame, topics: Sequence[str], keys: Sequence[str] = ("ts",),
                        topic: str = "topic", value: str = "weight", prefix: str = "") -> DataFrame:
    """Pivot long topic weights to model columns with an explicit topic list
    (no extra distinct-values job); absent cells are 0 (P9), a topic outside of the list raises."""
    from tidemark.operators.lookup import only
    long_df = long_df.withColumn(topic, only(topic, topics, "topic"))
    wide = long_df.groupBy(*keys).pivot(topic, list(topics)).agg(F.first(value))
    return wide.select(*keys, *[F.coalesce(F.col(f"`{t}`"), F.lit(0.0)).alias(f"{prefix}{t}")
                                for t in topics])


def band_join_bruteforce(articles: DataFrame, targets: DataFrame, lookback: int, decay_lambda: float,
                         *, ts: str = "publishedAt", topic: str = "topic", target_ts: str = "ts",
                         other_label: str | None = None, fractional: bool = False) -> DataFrame:
    """J1 as a literal theta join (test oracle only: it plans as a nested loop)."""
    a = exclude_other(articles, topic, other_label).select(F.col(ts).alias("a"), F.col(topic).alias("topic"))
    t = targets.select(F.col(target_ts).alias("t")).distinct()
    j = t.join(a, (F.col("a") <= F.col("t"))
               & (F.col("a") >= F.col("t") - F.make_dt_interval(hours=F.lit(int(lookback)))))
    hrs = fractional_hours_between("a", "t") if fractional else whole_hours_between("a", "t")
    return (j.groupBy("t", "topic")
            .agg(F.sum(F.exp(F.lit(-float(decay_lambda)) * hrs)).alias("weight"))
            .select(F.col("t").alias("ts"), "topic", "weight"))

