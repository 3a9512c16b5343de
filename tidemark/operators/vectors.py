"""Vector jobs: text embedding, dimensionality reduction, embedding quality
(T5, T6, T7, S3, S4, F21).

``hashed_embedding`` is the offline encoder: signed feature hashing of word tokens
into ``dim`` buckets, L2-normalised; tokens are exploded and aggregated per
(document, bucket) with partial aggregation, so a huge document or a hot token is
combined map-side.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

TOKEN_SPLIT = r"[^\p{L}\p{N}]+"


def _h(x, a: int, b: int):
    return F.conv(F.substring(F.md5(x), a, b), 16, 10).cast("bigint")


def hashed_embedding(docs: DataFrame, id_col: str, text_col: str, dim: int = 64) -> DataFrame:
    """T5: long (id, dim, value); blank texts produce no rows (a NULL vector)."""
    t = docs.select(F.col(id_col).alias("id"),
                    F.explode(F.split(F.lower(F.col(text_col)), TOKEN_SPLIT)).alias("token")) \
            .filter(F.length("token") > 0)
    t = t.select("id", (_h(F.col("token"), 1, 8) % dim).alias("dim"),
                 F.when(_h(F.col("token"), 9, 1) % 2 == 0, F.lit(1.0)).otherwise(F.lit(-1.0)).alias("sgn"))
    g = t.groupBy("id", "dim").agg(F.sum("sgn").alias("v"))
    norm = g.groupBy("id").agg(F.sqrt(F.sum(F.col("v") * F.col("v"))).alias("n"))
    return g.join(norm, "id").select(F.col("id").alias(id_col), F.col("dim").cast("bigint").alias("dim"),
                                     F.coalesce(F.try_divide(F.col("v"), F.col("n")), F.lit(0.0)).alias("value"))


def pca_reduce(df: DataFrame, vec: str = "embedding", k: int = 20, id_cols: Sequence[str] = ("id",),
               prefix: str = "embedding_dim_") -> DataFrame:
    """Spark ML PCA fitted on the table (distributed covariance, d x d
    eigendecomposition on the driver: bounded by the width, not the rows); output
    columns ``{prefix}0..k-1``."""
    from pyspark.ml.feature import PCA
    from pyspark.ml.functions import array_to_vector, vector_to_array
    d = df.select(*id_cols, array_to_vector(F.col(vec).cast("array<double>")).alias("_v"))
    model = PCA(k=k, inputCol="_v", outputCol="_p").fit(d)
    arr = vector_to_array(F.col("_p"))
    return model.transform(d).select(*id_cols, *[arr[i].alias(f"{prefix}{i}") for i in range(k)])


def pca_by_key(df: DataFrame, keys: Sequence[str], vec: str = "x", k: int = 20) -> tuple[DataFrame, DataFrame]:
    """T6 per parameter set: (rows with ``z``, the k principal scores; components by key).

    One pass gives every key's row count, sum and second moments, summed in the tasks first; the
    d x d eigenproblem of a key is one row (bounded by the vector's width, not by the rows).
    Components are orthonormal, by falling variance, each with its largest loading positive, and
    the scores are those of the centred vectors.  Fewer than k positions give fewer components.
    Vectors must have one width."""
    import numpy as np
    import pandas as pd
    from tidemark.session import ship_package
    keys = list(keys)
    ship_package(df.sparkSession)
    names = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields if f.name in keys)

    def moments(batches):
        found: dict = {}
        for pdf in batches:
            for key, part in pdf.groupby(keys, dropna=False, sort=False):
                m = np.vstack(part["_v"].to_numpy())
                n, s, q = found.get(key, (0, 0.0, 0.0))
                found[key] = (n + len(m), s + m.sum(axis=0), q + m.T @ m)
        if found:
            yield pd.DataFrame([(*key, n, s, q.ravel()) for key, (n, s, q) in found.items()], columns=[*keys, "n", "s", "q"])

    def solve(pdf):
        n = int(pdf["n"].sum())
        s, q = np.sum(np.vstack(pdf["s"].to_numpy()), axis=0), np.sum(np.vstack(pdf["q"].to_numpy()), axis=0)
        d = len(s)
        mean = s / n
        cov = (q.reshape(d, d) - n * np.outer(mean, mean)) / max(n - 1, 1)
        values, axes = np.linalg.eigh((cov + cov.T) / 2)
        take = np.argsort(-values, kind="stable")[:k]
        axes = axes[:, take].T
        axes *= np.where(axes[np.arange(len(take)), np.abs(axes).argmax(axis=1)] < 0, -1.0, 1.0)[:, None]
        share = np.maximum(values[take], 0) / max(np.maximum(values, 0).sum(), 1e-300)
        return pd.DataFrame([(*[pdf.iloc[0][c] for c in keys], n, mean, [a.tolist() for a in axes], share.tolist())],
                            columns=[*keys, "n", "center", "axes", "share"])

    moved = df.select(*keys, F.col(vec).cast("array<double>").alias("_v")).where("_v is not null")
    partial = moved.mapInPandas(moments, f"{names}, n bigint, s array<double>, q array<double>")
    axes = partial.groupBy(*keys).applyInPandas(solve, f"{names}, n bigint, center array<double>, axes array<array<double>>, share array<double>")
    same = F.lit(True)
    for c in keys:
        same = same & F.col(c).eqNullSafe(F.col(f"_k_{c}"))
    parts = axes.select(*[F.col(c).alias(f"_k_{c}") for c in keys], "center", "axes")  # one row per key
    centred = F.zip_with(F.col(vec).cast("array<double>"), F.col("center"), lambda v, m: v - m)
    rows = df.join(parts, same).withColumn("_w", centred)
    score = F.transform("axes", lambda a: F.aggregate(F.zip_with(a, F.col("_w"), lambda x, y: x * y), F.lit(0.0), lambda t, v: t + v))
    return rows.withColumn("z", score).drop("_w", "center", "axes", *[f"_k_{c}" for c in keys]), axes


def top_label_projection(df: DataFrame, id_cols: Sequence[str], label_col: str, vec: str = "embedding", n_labels: int = 10,
                         dims: int = 2) -> DataFrame:
    """The first ``dims`` principal scores (``x0``, ``x1``, ...) of every vector that carries one of
    the ``n_labels`` most frequent labels, with the label's ``label_rank`` and ``label_count``.

    The axes come from all vectors, whatever their label.  Equally frequent labels rank by name;
    null labels and null vectors get no point.  Only the label counts are ranked in one task."""
    at = [F.col("z")[i].alias(f"x{i}") for i in range(dims)]
    rows, _ = pca_by_key(df.select(*id_cols, label_col, vec).where(F.col(vec).isNotNull()).withColumn("_all", F.lit(0)), ["_all"], vec, dims)
    ranked = (df.where(F.col(label_col).isNotNull()).groupBy(F.col(label_col).alias("_label")).agg(F.count("*").alias("label_count"))
              .orderBy(F.desc("label_count"), "_label").limit(int(n_labels)))
    ranked = ranked.withColumn("label_rank", F.row_number().over(Window.orderBy(F.desc("label_count"), "_label")).cast("bigint"))
    return rows.join(F.broadcast(ranked), F.col(label_col) == F.col("_label")).select(*id_cols, label_col, "label_rank", "label_count", *at)  # at most n_labels rows


def separation_metric(long_df: DataFrame, id_col: str, label_col: str, dim: str = "dim",
                      value: str = "value") -> DataFrame:
    """T7 (re-aimed): per label, mean cosine of members to their own centroid and
    to the global centroid, and their difference (higher = better separated)."""
    x = long_df.select(id_col, label_col, dim, F.col(value).cast("double").alias("v"))
    cen = x.groupBy(label_col, dim).agg(F.avg("v").alias("c"))
    glob = x.groupBy(dim).agg(F.avg("v").alias("gc"))
    j = x.join(cen, [label_col, dim]).join(glob, dim)
    per = j.groupBy(id_col, label_col).agg(
        F.sum(F.col("v") * F.col("c")).alias("dc"), F.sum(F.col("v") * F.col("gc")).alias("dg"),
        F.sum(F.col("v") * F.col("v")).alias("vv"))
    cn = cen.groupBy(label_col).agg(F.sum(F.col("c") * F.col("c")).alias("cc"))
    gn = glob.agg(F.sum(F.col("gc") * F.col("gc")).alias("gg"))
    per = per.join(cn, label_col)
    gg = gn.first()["gg"]          # one scalar: the global centroid's squared norm
    cos_own = F.try_divide(F.col("dc"), F.sqrt(F.col("vv") * F.col("cc")))
    cos_glob = F.try_divide(F.col("dg"), F.sqrt(F.col("vv") * F.lit(float(gg or 0.0))))
    out = per.groupBy(label_col).agg(F.avg(cos_own).alias("intra_cosine"), F.avg(cos_glob).alias("global_cosine"),
                                     F.count(F.lit(1)).alias("n"))
    return out.withColumn("separation", F.col("intra_cosine") - F.col("global_cosine"))


def dataset_fingerprint(df: DataFrame, cols: Sequence[str]) -> str:
    """Order-independent content fingerprint: count plus the sum of a 64-bit
    hash of each row (one aggregate, no sort, no collect of rows)."""
    r = df.agg(F.count(F.lit(1)).alias("n"),
               F.sum(F.xxhash64(*[F.col(c) for c in cols]).cast("decimal(38,0)")).alias("s")).first()
    return f"{r['n']}-{r['s']}"


def _written(spark, path: str) -> bool:
    """True if a job has finished writing ``path`` (a killed write leaves no ``_SUCCESS``)."""
    marker = spark._jvm.org.apache.hadoop.fs.Path(path, "_SUCCESS")
    return marker.getFileSystem(spark._jsc.hadoopConfiguration()).exists(marker)


def read_vectors(spark, path: str, width: int, vec: str = "embedding") -> DataFrame:
    """S3: a stored vector table whose vectors all have ``width`` positions.

    A null vector is a text without an embedding and stays.  Any other width raises when the
    row is read, also where only the vector column is used."""
    n = F.size(vec)
    wrong = F.raise_error(F.format_string("Vector of %d positions where the table should hold %d", n, F.lit(int(width))))
    return spark.read.parquet(path).withColumn(vec, F.when(F.col(vec).isNotNull() & (n != int(width)), wrong).otherwise(F.col(vec)))


def cached_parquet(df: DataFrame, base_dir: str, params: dict) -> DataFrame:
    """Reuse a materialised result stored under a fingerprint of all columns of its
    input and of every parameter (Q22 fixed); otherwise write it, then read it back."""
    import hashlib
    import json
    tag = hashlib.sha1((dataset_fingerprint(df, df.columns) + "|" + json.dumps(params, sort_keys=True)).encode()).hexdigest()[:16]
    path, spark = f"{base_dir.rstrip('/')}/cache-{tag}", df.sparkSession
    if not _written(spark, path):
        df.write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)
