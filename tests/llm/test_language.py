import math
import re
from collections import Counter

from pyspark.sql import functions as F

from tests.conftest import SF_SMALL
from tests.llm import cases
from tidemark.llm import language_backoff as lb


def test_held_out_accuracy(spark):
    docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet")
    got = lb.op4_language_backoff(spark, SF_SMALL)
    both = got.join(docs.select("doc_id", "lang"), "doc_id")
    right, n = both.where("held_out").agg(F.sum((F.col("lang") == F.col("lang_pred")).cast("int")), F.count("*")).first()
    assert got.count() == docs.count() and n > 20 and right / n >= 0.97
    assert got.where("score < 0 or score > 1").count() == 0


def test_edges(spark):
    docs = cases.documents(spark)
    model = lb.fit(docs, F.lit(True))
    rows = lb.predict(docs, model).collect()
    assert len(rows) == docs.count()
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    for r in rows:
        letters = any(c.isalpha() for c in texts.get(r["doc_id"]) or "") if r["doc_id"] is not None else None
        if letters is not None:
            assert (r["lang_pred"] == "und") == (not letters)
    kept = lb.keep_identified(docs, model)
    assert kept.columns == docs.columns and kept.where("doc_id = 0").count() == 0


def test_nothing_to_learn_and_empty(spark):
    docs = cases.documents(spark)
    assert {r["lang_pred"] for r in lb.predict(docs, lb.fit(docs, F.lit(False))).collect()} == {"und"}
    empty = cases.no_documents(spark)
    assert lb.predict(empty, lb.fit(empty, F.lit(True))).count() == 0


def test_unseen_words_back_off(spark):
    docs = spark.createDataFrame([(i, t, lang) for i, (t, lang) in enumerate(
        [("strasse haus schloss schule schnell", "de"), ("house street quick thing thought", "en")] * 5)],
        "doc_id bigint, text string, lang string")
    model = lb.fit(docs, F.lit(True))
    probe = spark.createDataFrame([(1, "schlafen"), (2, "thinking")], "doc_id bigint, text string")
    assert {r["doc_id"]: r["lang_pred"] for r in lb.predict(probe, model).collect()} == {1: "de", 2: "en"}


def plain_model(rows):
    """Counts per kind (0: words, k: n-grams) and language, and the languages' sizes."""
    counts = {k: {} for k in range(5)}
    for text, lang in rows:
        for word in re.findall(r"[^\W\d_]+", (text or "").lower()):
            marked = f"^{word}$"
            for k in range(5):
                for g in [word] if k == 0 else [marked[i:i + k] for i in range(len(marked) - k + 1)]:
                    counts[k].setdefault(g, Counter())[lang] += 1
    return counts, Counter(lang for _, lang in rows)


def plain_predict(text, counts, sizes):
    langs = sorted(sizes)

    def logs(k, gram, lang):
        total = sum(c[lang] for c in counts[k].values())
        return (math.log(counts[k][gram][lang] + 0.5) - math.log(total + 0.5 * len(counts[k]))) / max(k, 1)

    words = re.findall(r"[^\W\d_]+", (text or "").lower())
    if not words:
        return "und", 0.0
    score = {x: math.log(sizes[x] / sum(sizes.values())) for x in langs}
    for word in words:
        if word in counts[0]:
            found = [(0, word)]
        else:
            marked, found = f"^{word}$", []
            for i in range(len(marked)):
                k = next((k for k in range(min(4, len(marked) - i), 0, -1) if marked[i:i + k] in counts[k]), None)
                found += [(k, marked[i:i + k])] if k else []
        for x in langs:
            score[x] += sum(logs(k, g, x) for k, g in found)
    best = max(langs, key=lambda x: score[x])
    return best, 1 / sum(math.exp(score[x] - score[best]) for x in langs)


def test_matches_a_plain_word_first_backoff(spark):
    train = [("das haus und der hund laufen schnell", "de"), ("the house and the dog run quickly", "en"), ("la maison et le chien", "fr"),
             ("Straße über schön, haus!", "de"), ("through thought, house", "en"), (None, "fr"), ("été où maison", "fr")]
    docs = spark.createDataFrame([(i, t, x) for i, (t, x) in enumerate(train)], "doc_id bigint, text string, lang string")
    model = lb.fit(docs, F.lit(True))
    texts = [None, "", "123 !", "haus", "Häuser", "hund-dog", "qqq", "thinking of the houses", "schnellen hundes", "maisons", "été2été", "x"] + [t for t, _ in train]
    probe = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id bigint, text string")
    plain = plain_model(train)
    for r in lb.predict(probe, model).collect():
        want = plain_predict(texts[r["doc_id"]], *plain)
        assert r["lang_pred"] == want[0] and abs(r["score"] - want[1]) < 1e-9, texts[r["doc_id"]]


def test_many_label_values(spark):
    docs = spark.createDataFrame([(i, f"word{chr(97 + i % 26)} common", f"l{i % 300}") for i in range(900)], "doc_id bigint, text string, lang string")
    assert len(lb.fit(docs, F.lit(True)).langs) == 300
    assert len(lb.fit(docs, F.lit(True), max_langs=7).langs) == 7
