"""Topic scoring and hierarchical routing.

Routing is a per-row projection over score arrays: stage-1 scores over the group
list, the winning group's leaf list looked up in a map literal, stage-2 scores over
those leaves, thresholds and fallbacks as ``when`` chains.  No join, no shuffle, no
Python: every executor routes its own rows with JVM expressions.

Scores come from a pluggable scorer ``scorer(text_col, labels_col, stage) -> Column``
returning an array of scores aligned with ``labels_col`` (NULL for a blank text).
``text_scorer`` reads them from the label scores that ``with_evidence`` computes from
the text; ``hash_scorer`` gives deterministic pseudo-scores for tests of the routing alone.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.text import is_blank

# Topic groups, routing order, thresholds and the fallback ("other")
# label of the reference configuration.
HIERARCHICAL_TOPIC_GROUPS = {
    "Nachfrage (Stromverbrauch)": [
        "Steigender Stromverbrauch durch Wirtschaft, Industrie oder Extremwetter",
        "Sinkender Stromverbrauch durch Konjunkturschwäche oder mildes Wetter",
    ],
    "Angebot (Erzeugung & Infrastruktur)": [
        "Kraftwerksausfälle, Netzengpässe oder geringe erneuerbare Einspeisung",
        "Hohe erneuerbare Einspeisung, neue Kapazitäten oder stabile Netze",
    ],
    "Brennstoffpreise": [
        "Steigende Gas-, Kohle- oder CO₂-Preise",
        "Fallende Gas-, Kohle- oder CO₂-Preise",
    ],
    "Wetter": [
        "Kaltes, windarmes oder bewölktes Wetter",
        "Mildes Wetter, starke Winde oder viel Sonneneinstrahlung",
    ],
    "Wirtschaft & Konjunktur": [
        "Positive Wirtschaftsentwicklung, steigende Industrieproduktion oder Unternehmenswachstum",
        "Rezession, Unternehmenskrise oder sinkende Industrieproduktion",
    ],
    "Finanzmärkte & Geldpolitik": [
        "Zinsentscheidungen, Inflation oder Währungsschwankungen",
        "Börsennachrichten, Unternehmensgewinne oder Investitionen",
    ],
    "Handel & Außenwirtschaft": [
        "Zölle, Handelskonflikte oder Exportbeschränkungen",
        "Handelsabkommen, Marktöffnung oder Lieferkettenentwicklung",
    ],
    "Geopolitik & Konflikte": [
        "Krieg, Sanktionen, Terrorgefahr oder geopolitische Spannungen",
        "Friedensgespräche, Diplomatie oder Aufhebung von Sanktionen",
    ],
    "Technologie & Industrie": [
        "Technologieentwicklung, Halbleiter, Elektromobilität oder Batterieproduktion",
        "Industriepolitik, Produktionsstandorte oder Unternehmensstrategien",
    ],
    "Politik & Regulierung": [
        "Energiepolitik, Klimagesetze oder EU-Regulierung",
        "Innenpolitik, Regierungsbildung oder Wahlen",
    ],
    "Sonstiges": [
        "Sport, Unterhaltung, Kultur oder Lokalnachrichten ohne Wirtschaftsbezug",
    ],
}
STAGE_ORDER = list(HIERARCHICAL_TOPIC_GROUPS)
STAGE1_THRESHOLD = 0.25
STAGE2_THRESHOLD = 0.20
FALLBACK_GROUP = "Sonstiges"
OTHER_LABEL = "Sport, Unterhaltung, Kultur oder Lokalnachrichten ohne Wirtschaftsbezug"
CANDIDATE_LABELS = [leaf for leaves in HIERARCHICAL_TOPIC_GROUPS.values() for leaf in leaves]

Scorer = Callable[[Column, Column, str], Column]


def hash_scorer(key_col: str, salt: str = "") -> Scorer:
    """Deterministic stand-in scores: u(key, stage, label) from md5, normalised to
    sum 1 over the candidate labels (as zero-shot scores are)."""
    def score(text: Column, labels: Column, stage: str) -> Column:
        raw = F.transform(labels, lambda lab: F.conv(F.substring(F.md5(F.concat_ws(
            "-", F.col(key_col).cast("string"), F.lit(salt + stage), lab)), 1, 8), 16, 10).cast("double")
            / F.lit(4294967296.0))
        tot = F.aggregate(raw, F.lit(0.0), lambda acc, x: acc + x)
        return F.when(is_blank(text), F.lit(None)).otherwise(F.transform(raw, lambda x: x / tot))
    return score


def _top(labels: Column, scores: Column):
    """(label, score) of the first maximum score."""
    best = F.array_max(scores)
    idx = F.array_position(scores, best)
    return F.element_at(labels, idx.cast("int")), best


def route(df: DataFrame, text: str, scorer: Scorer, *, groups: Mapping[str, Sequence[str]] = HIERARCHICAL_TOPIC_GROUPS,
          stage_order: Sequence[str] = STAGE_ORDER, thr1: float = STAGE1_THRESHOLD, thr2: float = STAGE2_THRESHOLD,
          fallback_group: str | None = FALLBACK_GROUP, prefix: str = "classification") -> DataFrame:
    """Two-stage routing; adds ``{prefix}``, ``{prefix}_score``, ``{prefix}_stage1``,
    ``{prefix}_stage1_score``."""
    order = [g for g in stage_order if g in groups] + [g for g in groups if g not in stage_order]
    glabels = F.array(*[F.lit(g) for g in order])
    # scores become columns before they are used several times: each is worked out once
    df = df.withColumn("_s1", scorer(F.col(text), glabels, "stage1"))
    s1 = F.col("_s1")
    g_top, g_score = _top(glabels, s1)
    fb_leaf = groups.get(fallback_group, [None])[0] if fallback_group else None
    blank = s1.isNull()
    stage1_label = F.when(blank, F.lit(fallback_group or order[0])).otherwise(g_top)
    stage1_score = F.when(blank, F.lit(0.0)).otherwise(g_score)
    if fallback_group:
        stage1_label = F.when(~blank & (stage1_score < thr1), F.lit(fallback_group)).otherwise(stage1_label)
    leaf_map = F.create_map(*[x for g in order for x in (F.lit(g), F.array(*[F.lit(v) for v in groups[g]]))])
    d = df.withColumn("_g", stage1_label).withColumn("_g1", stage1_score)
    leaves = F.element_at(leaf_map, F.col("_g"))
    d = d.withColumn("_leaves", leaves)
    d = d.withColumn("_s2", scorer(F.col(text), F.col("_leaves"), "stage2"))
    s2 = F.col("_s2")
    l_top, l_score = _top(F.col("_leaves"), s2)
    single = F.size("_leaves") == 1
    fb = F.lit(fb_leaf) if fb_leaf is not None else F.lit(None).cast("string")
    stage2_label = F.when(s2.isNull(), fb).otherwise(l_top)
    stage2_score = F.when(s2.isNull(), F.lit(0.0)).otherwise(l_score)
    low = (stage2_score < thr2) & F.lit(fb_leaf is not None)
    final_label = F.when(single, F.element_at("_leaves", 1)) \
        .when(low, fb).otherwise(stage2_label)
    final_score = F.when(single, F.col("_g1")) \
        .when(low, F.greatest(stage2_score, F.col("_g1"))).otherwise(stage2_score)
    return (d.withColumn(prefix, final_label).withColumn(f"{prefix}_score", final_score)
             .withColumn(f"{prefix}_stage1", F.col("_g")).withColumn(f"{prefix}_stage1_score", F.col("_g1"))
             .drop("_g", "_g1", "_leaves", "_s1", "_s2"))


def route_flat(df: DataFrame, text: str, scorer: Scorer, labels: Sequence[str] = CANDIDATE_LABELS,
               prefix: str = "classification") -> DataFrame:
    """Single stage over all labels; blank -> NULL label, score 0."""
    arr = F.array(*[F.lit(v) for v in labels])
    df = df.withColumn("_s", scorer(F.col(text), arr, "flat"))
    s = F.col("_s")
    top, best = _top(arr, s)
    label = F.when(s.isNull(), F.lit(None).cast("string")).otherwise(top)
    score = F.when(s.isNull(), F.lit(0.0)).otherwise(best)
    return (df.withColumn(prefix, label).withColumn(f"{prefix}_score", score)
              .withColumn(f"{prefix}_stage1", label).withColumn(f"{prefix}_stage1_score", score).drop("_s"))


def second_pass_other(df: DataFrame, text: str, scorer: Scorer, other_label: str = OTHER_LABEL,
                      prefix: str = "classification", **route_kw) -> DataFrame:
    """Rows labelled "other" are re-routed on a second text column and get its four result
    columns; all other rows pass by.  The two sets are disjoint filters of the same rows, so
    duplicate timestamps cannot cross-update (Q6) and only the "other" rows are scored again.  The
    first pass is stored once, as both sets read it."""
    from tidemark.session import cut_lineage
    df = cut_lineage(df)
    is_other = F.coalesce(F.col(prefix) == F.lit(other_label), F.lit(False))
    again = df.filter(is_other).drop(prefix, f"{prefix}_score", f"{prefix}_stage1", f"{prefix}_stage1_score")
    return df.filter(~is_other).unionByName(route(again, text, scorer, prefix=prefix, **route_kw).select(*df.columns))


#: Score that every label gets before any evidence, per unit of evidence.
EVIDENCE_FLOOR = 0.01

_NOT_WORD = r"[^\p{L}\p{N}]+"


def label_tokens(labels: Sequence[str]) -> dict[str, list[str]]:
    """Distinct lower-case word tokens of each label."""
    import re
    return {v: sorted({t for t in re.split(r"[\W_]+", v.lower()) if t}) for v in labels}


def _vocabulary(labels: Sequence[str]) -> list[str]:
    return sorted({t for ts in label_tokens(labels).values() for t in ts})


def label_counts(docs: DataFrame, texts: Mapping[str, str], labels: Sequence[str], keep: Sequence[str]) -> DataFrame:
    """T1, first half: for every ``out: text column`` of ``texts`` the counts of the labels' tokens
    (``{out}_tf``, in the order of the sorted tokens) and the number of all tokens (``{out}_n``, null for a
    blank text), with the ``keep`` columns.

    Only these small arrays leave the texts (the tokens are a few dozen, fixed by the
    configuration), so they are stored: document frequencies, scores and further passes read
    them and not the texts."""
    from tidemark.session import cut_lineage
    vocabulary = _vocabulary(labels)
    lits, none = F.array(*[F.lit(t) for t in vocabulary]), F.array_repeat(F.lit(0), len(vocabulary))
    d = docs.select(*keep, *[F.col(c).alias(f"_t_{o}") for o, c in texts.items()])
    for o in texts:
        c = F.col(f"_t_{o}")
        words = F.filter(F.split(F.lower(F.coalesce(c, F.lit(""))), _NOT_WORD), lambda w: w != "")
        d = d.withColumn("_words", words).withColumn("_hits", F.filter("_words", lambda w: w.isin(vocabulary)))
        # (the hits are named twice, so Spark keeps them as a column instead of working them out per token)
        d = d.withColumn(f"{o}_tf", F.when(F.size("_hits") == 0, none).otherwise(
            F.transform(lits, lambda t: F.size(F.filter("_hits", lambda w: w == t)))))
        d = d.withColumn(f"{o}_n", F.when(~is_blank(f"_t_{o}"), F.size("_words"))).drop("_words", "_hits", f"_t_{o}")
    return cut_lineage(d)


def with_evidence(counts: DataFrame, out: str, labels: Sequence[str]) -> DataFrame:
    """T1, second half: add ``out``, a map label -> TF-IDF evidence (null for a blank text).

    evidence = sum over the label's tokens of (share of the token among the text's tokens) * idf,
    divided by the root of the number of label tokens; idf = ln((1 + N) / (1 + df)) + 1 over all
    rows of ``counts``.  The length of the document's own vector scales all labels alike and
    cancels in the scores.  One aggregate row with the frequencies reaches the driver."""
    vocabulary, tf = _vocabulary(labels), F.col(f"{out}_tf")
    present = counts.agg(F.count(F.lit(1)), *[F.count_if(tf[k] > 0) for k in range(len(vocabulary))]).first()
    idf = [float(np.log((1 + present[0]) / (1 + n)) + 1) for n in present[1:]]
    entries = []
    for label, ts in label_tokens(labels).items():
        at = [vocabulary.index(t) for t in ts]
        weight = sum((tf[k] * F.lit(idf[k]) for k in at), F.lit(0.0))
        entries += [F.lit(label), F.try_divide(weight, F.col(f"{out}_n") * F.lit(float(max(len(at), 1)) ** 0.5))]
    return counts.withColumn(out, F.when(F.col(f"{out}_n").isNotNull(), F.transform_values(
        F.create_map(*entries), lambda k, v: F.round(F.coalesce(v, F.lit(0.0)), 12))))


def text_scorer(evidence: str = "label_evidence", floor: float = EVIDENCE_FLOOR) -> Scorer:
    """Scores of the candidate labels from their evidence, normalised to sum 1 over the
    candidates as zero-shot scores are; without evidence all candidates are equal."""
    def score(text: Column, labels: Column, stage: str) -> Column:
        raw = F.transform(labels, lambda lab: F.element_at(F.col(evidence), lab) + F.lit(floor))
        tot = F.aggregate(raw, F.lit(0.0), lambda acc, x: acc + x)
        return F.when(F.col(evidence).isNull(), F.lit(None)).otherwise(F.transform(raw, lambda x: x / tot))
    return score


def label_scores(docs: DataFrame, id_col: str, text_col: str, labels: Sequence[str]) -> DataFrame:
    """T1 in long form: (id, label, score) for every label of every document; the score is NULL
    for a blank text."""
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("_text"))
    d = with_evidence(label_counts(rows, {"label_evidence": "_text"}, labels, ["id"]), "label_evidence", labels)
    arr = F.array(*[F.lit(v) for v in labels])
    pairs = F.arrays_zip(arr.alias("label"), F.coalesce(text_scorer()(F.col("label_evidence"), arr, "flat"),
                                                        F.transform(arr, lambda x: F.lit(None).cast("double"))).alias("score"))
    return d.select("id", F.explode(pairs).alias("p")).select("id", "p.label", "p.score")
