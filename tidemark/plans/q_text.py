"""Registered queries: text and vector jobs (T1-T7, A28 on routing output)."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.operators import eda, routing, vectors
from tidemark.plans.common import round_doubles
from tidemark.plans.oracle_views import rounded, with_views
from tidemark.plans.registry import register
from tidemark.sources import tables as T

R = routing


def _q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def _dims_sql() -> str:
    groups = ", ".join(f"({i}, {_q(g)})" for i, g in enumerate(R.STAGE_ORDER))
    leaves = ", ".join(f"({_q(g)}, {j}, {_q(leaf)})" for g in R.STAGE_ORDER
                       for j, leaf in enumerate(R.HIERARCHICAL_TOPIC_GROUPS[g]))
    cands = ", ".join(f"({i}, {_q(v)})" for i, v in enumerate(R.CANDIDATE_LABELS))
    return (f"grps AS (SELECT * FROM (VALUES {groups}) g(gi, grp)),\n"
            f"lvs AS (SELECT * FROM (VALUES {leaves}) l(grp, li, leaf)),\n"
            f"lcnt AS (SELECT grp, count(*) AS n_leaves, min(leaf) AS only_leaf FROM lvs GROUP BY grp),\n"
            f"cands AS (SELECT * FROM (VALUES {cands}) c(ci, label))")


ALL_LABELS = list(R.STAGE_ORDER) + list(R.CANDIDATE_LABELS)


def _evidence_sql(src: str, text: str) -> str:
    """CTE ``ev(article_id, label, raw)``: evidence of every label plus the floor."""
    pairs = ", ".join(f"({_q(v)}, {_q(t)})" for v, ts in R.label_tokens(ALL_LABELS).items() for t in ts)
    return f"""
lt AS (SELECT * FROM (VALUES {pairs}) x(label, token)),
lw AS (SELECT label, sqrt(count(*)) AS width FROM lt GROUP BY 1),
ws AS (SELECT article_id, list_filter(regexp_split_to_array(lower(coalesce({text}, '')), '[^\\p{{L}}\\p{{N}}]+'),
                                      lambda x: x <> '') AS words FROM {src}),
tf AS (SELECT article_id, token, count(*) AS tf FROM (SELECT article_id, unnest(words) AS token FROM ws)
       WHERE token IN (SELECT token FROM lt) GROUP BY 1, 2),
dfq AS (SELECT token, count(*) AS df FROM tf GROUP BY 1),
idf AS (SELECT t.token, ln((1.0 + (SELECT count(*) FROM {src})) / (1.0 + coalesce(dfq.df, 0))) + 1 AS idf
        FROM (SELECT DISTINCT token FROM lt) t LEFT JOIN dfq USING (token)),
hit AS (SELECT tf.article_id, lt.label, sum(tf.tf * idf.idf) AS s FROM tf JOIN idf USING (token) JOIN lt USING (token) GROUP BY 1, 2),
ev AS (SELECT ws.article_id, lw.label,
              round(coalesce(coalesce(hit.s, 0.0) / nullif(len(ws.words) * lw.width, 0), 0.0), 12) + {R.EVIDENCE_FLOOR!r} AS raw
       FROM ws CROSS JOIN lw LEFT JOIN hit ON hit.article_id = ws.article_id AND hit.label = lw.label)"""


def _blank(col: str) -> str:
    return f"({col} IS NULL OR length(regexp_replace({col}, '\\s', '', 'g')) = 0)"


def _route_sql(src: str, text: str, out: str) -> str:
    """CTEs routing ``src(article_id, {text})`` by ``ev``; result CTE ``{out}``."""
    p = out
    return f"""
{p}_n AS (SELECT article_id, {_blank(text)} AS blank FROM {src}),
{p}_s1 AS (SELECT n.article_id, g.gi, g.grp, ev.raw
           FROM {p}_n n JOIN ev USING (article_id) JOIN grps g ON g.grp = ev.label WHERE NOT n.blank),
{p}_t1 AS (SELECT article_id, grp, raw / sum(raw) OVER (PARTITION BY article_id) AS score, gi FROM {p}_s1
           QUALIFY row_number() OVER (PARTITION BY article_id ORDER BY raw DESC, gi) = 1),
{p}_g AS (SELECT n.article_id,
                 CASE WHEN n.blank THEN '{R.FALLBACK_GROUP}' WHEN t.score < {R.STAGE1_THRESHOLD} THEN '{R.FALLBACK_GROUP}'
                      ELSE t.grp END AS stage1,
                 CASE WHEN n.blank THEN 0.0 ELSE t.score END AS stage1_score, n.blank
          FROM {p}_n n LEFT JOIN {p}_t1 t USING (article_id)),
{p}_s2 AS (SELECT g.article_id, l.li, l.leaf, ev.raw
           FROM {p}_g g JOIN lvs l ON l.grp = g.stage1 JOIN lcnt c ON c.grp = g.stage1
                JOIN ev ON ev.article_id = g.article_id AND ev.label = l.leaf
           WHERE c.n_leaves > 1 AND NOT g.blank),
{p}_t2 AS (SELECT article_id, leaf, raw / sum(raw) OVER (PARTITION BY article_id) AS score FROM {p}_s2
           QUALIFY row_number() OVER (PARTITION BY article_id ORDER BY raw DESC, li) = 1),
{out} AS (
  SELECT g.article_id,
         CASE WHEN c.n_leaves = 1 THEN c.only_leaf
              WHEN coalesce(t.score, 0.0) < {R.STAGE2_THRESHOLD} THEN {_q(R.OTHER_LABEL)} ELSE t.leaf END AS classification,
         CASE WHEN c.n_leaves = 1 THEN g.stage1_score
              WHEN coalesce(t.score, 0.0) < {R.STAGE2_THRESHOLD} THEN greatest(coalesce(t.score, 0.0), g.stage1_score)
              ELSE t.score END AS classification_score,
         g.stage1 AS classification_stage1, g.stage1_score AS classification_stage1_score
  FROM {p}_g g JOIN lcnt c ON c.grp = g.stage1 LEFT JOIN {p}_t2 t USING (article_id))"""


_OUT = ["article_id", "classification", "classification_score", "classification_stage1",
        "classification_stage1_score"]
_OUT_D = ["classification_score", "classification_stage1_score"]


@register("t2_hierarchical_routing", with_views(rounded("SELECT * FROM r1", _OUT_D), "v_news",
                                                extra=[_dims_sql(), _evidence_sql("v_news", "title"), _route_sql("v_news", "title", "r1")]))
def t2_hierarchical_routing(spark, sf_dir):
    n = R.with_evidence(R.label_counts(T.news(spark, sf_dir), {"label_evidence": "title"}, ALL_LABELS, ["article_id"]), "label_evidence", ALL_LABELS)
    out = R.route(n, "title", R.text_scorer())
    return round_doubles(out.select(*_OUT))


@register("t3_flat_routing", with_views(rounded(f"""
WITH s AS (SELECT n.article_id, c.ci, c.label, ev.raw
           FROM v_news n JOIN ev USING (article_id) JOIN cands c ON c.label = ev.label WHERE NOT {_blank('n.title')}),
t AS (SELECT article_id, label, raw / sum(raw) OVER (PARTITION BY article_id) AS score FROM s
      QUALIFY row_number() OVER (PARTITION BY article_id ORDER BY raw DESC, ci) = 1)
SELECT n.article_id, t.label AS classification, coalesce(t.score, 0.0) AS classification_score,
       t.label AS classification_stage1, coalesce(t.score, 0.0) AS classification_stage1_score
FROM v_news n LEFT JOIN t USING (article_id)""", _OUT_D), "v_news", extra=[_dims_sql(), _evidence_sql("v_news", "title")]))
def t3_flat_routing(spark, sf_dir):
    n = R.with_evidence(R.label_counts(T.news(spark, sf_dir), {"label_evidence": "title"}, ALL_LABELS, ["article_id"]), "label_evidence", ALL_LABELS)
    return round_doubles(R.route_flat(n, "title", R.text_scorer()).select(*_OUT))


def _second_pass_sql() -> str:
    # the stand-in's title and description are the same whole text, so ``ev`` serves both
    return (_evidence_sql("v_news", "title") + ",\n" + _route_sql("v_news", "title", "r1") + ",\n"
            + _route_sql("v_news", "description", "r2") + """,
r3 AS (SELECT r1.article_id,
              CASE WHEN r1.classification = """ + _q(R.OTHER_LABEL) + """ THEN r2.classification ELSE r1.classification END AS classification,
              CASE WHEN r1.classification = """ + _q(R.OTHER_LABEL) + """ THEN r2.classification_score ELSE r1.classification_score END AS classification_score,
              CASE WHEN r1.classification = """ + _q(R.OTHER_LABEL) + """ THEN r2.classification_stage1 ELSE r1.classification_stage1 END AS classification_stage1,
              CASE WHEN r1.classification = """ + _q(R.OTHER_LABEL) + """ THEN r2.classification_stage1_score ELSE r1.classification_stage1_score END AS classification_stage1_score
       FROM r1 JOIN r2 USING (article_id))""")


def _routed(spark, sf_dir):
    counts = R.label_counts(T.news(spark, sf_dir), {"by_title": "title", "by_description": "description"}, ALL_LABELS, ["article_id"])
    scored = R.with_evidence(R.with_evidence(counts, "by_title", ALL_LABELS), "by_description", ALL_LABELS)
    first = R.route(scored, "by_title", R.text_scorer("by_title"))
    return R.second_pass_other(first, "by_description", R.text_scorer("by_description"))


@register("t4_second_pass_other", with_views(rounded("SELECT * FROM r3", _OUT_D), "v_news",
                                             extra=[_dims_sql(), _second_pass_sql()]))
def t4_second_pass_other(spark, sf_dir):
    return round_doubles(_routed(spark, sf_dir).select(*_OUT))


@register("a28_routing_stats", with_views(rounded(f"""
SELECT avg(classification_score) AS mean_score, quantile_cont(classification_score, 0.5) AS median_score,
       count(*) FILTER (WHERE classification = {_q(R.OTHER_LABEL)}) / count(*) * 100 AS other_pct,
       count(DISTINCT classification) AS n_topics, count(classification) AS n_classified
FROM r3""", ["mean_score", "median_score", "other_pct"]), "v_news", extra=[_dims_sql(), _second_pass_sql()]))
def a28_routing_stats(spark, sf_dir):
    return round_doubles(eda.topic_stats(_routed(spark, sf_dir), "classification", "classification_score",
                                         R.OTHER_LABEL))


@register("a4_classification_distribution", with_views(rounded("""
SELECT classification, count(*) AS count, count(*) / sum(count(*)) OVER () * 100 AS pct
FROM r3 WHERE classification IS NOT NULL GROUP BY 1""", ["pct"]), "v_news", extra=[_dims_sql(), _second_pass_sql()]))
def a4_classification_distribution(spark, sf_dir):
    return round_doubles(eda.value_counts(_routed(spark, sf_dir), "classification"))


EMB_DIM = 64


@register("t5_hashed_embedding", with_views(rounded(f"""
WITH t AS (SELECT article_id, unnest(regexp_split_to_array(lower(description), '[^\\p{{L}}\\p{{N}}]+')) AS token
           FROM v_news),
h AS (SELECT article_id, CAST(('0x' || substr(md5(token), 1, 8)) AS BIGINT) % {EMB_DIM} AS dim,
             CASE WHEN CAST(('0x' || substr(md5(token), 9, 1)) AS BIGINT) % 2 = 0 THEN 1.0 ELSE -1.0 END AS sgn
      FROM t WHERE length(token) > 0),
g AS (SELECT article_id, CAST(dim AS BIGINT) AS dim, sum(sgn) AS v FROM h GROUP BY 1, 2),
nn AS (SELECT article_id, sqrt(sum(v * v)) AS n FROM g GROUP BY 1)
SELECT g.article_id, g.dim, coalesce(g.v / nullif(nn.n, 0), 0.0) AS value FROM g JOIN nn USING (article_id)
""", ["value"]), "v_news"))
def t5_hashed_embedding(spark, sf_dir):
    return round_doubles(vectors.hashed_embedding(T.news(spark, sf_dir), "article_id", "description", EMB_DIM))


@register("t7_embedding_separation", with_views(rounded("""
WITH x AS (SELECT article_id, topic, CAST(p - 1 AS BIGINT) AS dim, CAST(v AS DOUBLE) AS v
           FROM (SELECT article_id, topic, unnest(embedding) AS v, generate_subscripts(embedding, 1) AS p
                 FROM v_embedded)),
cen AS (SELECT topic, dim, avg(v) AS c FROM x GROUP BY 1, 2),
gl AS (SELECT dim, avg(v) AS gc FROM x GROUP BY 1),
per AS (SELECT x.article_id, x.topic, sum(x.v * cen.c) AS dc, sum(x.v * gl.gc) AS dg, sum(x.v * x.v) AS vv
        FROM x JOIN cen USING (topic, dim) JOIN gl USING (dim) GROUP BY 1, 2),
cn AS (SELECT topic, sum(c * c) AS cc FROM cen GROUP BY 1),
gn AS (SELECT sum(gc * gc) AS gg FROM gl),
o AS (SELECT per.topic, avg(dc / sqrt(vv * cc)) AS intra_cosine, avg(dg / sqrt(vv * gg)) AS global_cosine,
             count(*) AS n
      FROM per JOIN cn USING (topic), gn GROUP BY 1)
SELECT *, intra_cosine - global_cosine AS separation FROM o""", ["intra_cosine", "global_cosine", "separation"]),
    "v_embedded"))
def t7_embedding_separation(spark, sf_dir):
    e = T.embedded_news(spark, sf_dir)
    long = e.select("article_id", "topic", F.posexplode("embedding").alias("dim", "value")) \
            .withColumn("dim", F.col("dim").cast("bigint"))
    return round_doubles(vectors.separation_metric(long, "article_id", "topic"))


@register("t7_top_label_projection")
def t7_top_label_projection(spark, sf_dir):
    """No SQL twin (eigenvectors); coordinates, ranks and the label cut are tested against NumPy."""
    return round_doubles(vectors.top_label_projection(T.embedded_news(spark, sf_dir), ["article_id"], "topic"))


@register("t6_pca_reduce")
def t6_pca_reduce(spark, sf_dir):
    """No SQL twin: eigenvectors are defined up to sign; invariants are tested."""
    e = T.embedded_news(spark, sf_dir)
    return vectors.pca_reduce(e, "embedding", 20, ["article_id"])


@register("t1_tfidf_label_scores", with_views(rounded(f"""
SELECT n.article_id AS id, c.label,
       CASE WHEN NOT {_blank('n.title')} THEN ev.raw / sum(ev.raw) OVER (PARTITION BY n.article_id) END AS score
FROM v_news n JOIN ev USING (article_id) JOIN cands c ON c.label = ev.label""", ["score"]), "v_news",
    extra=[_dims_sql(), _evidence_sql("v_news", "title")]))
def t1_tfidf_label_scores(spark, sf_dir):
    """T1 over the whole texts: a score of every label for every document."""
    return round_doubles(R.label_scores(T.news(spark, sf_dir), "article_id", "title", R.CANDIDATE_LABELS))
