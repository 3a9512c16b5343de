from pyspark.sql import functions as F

import corpus_pipeline as cp
from tests.conftest import SF_SMALL
from tests.llm import cases
from tests.llm.test_packing import check_packing
from tests.llm.test_simhash import expected
from tidemark.llm import language_backoff as lb
from tidemark.llm import weak_label_quality as wq
from tidemark.llm.common import materialize


def test_stages_against_brute_force(spark):
    docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet")
    kept = []
    at = docs
    for name, stage in cp.STAGES:
        out = materialize(stage(spark, at, SF_SMALL))
        if name != "packing":
            assert out.columns == docs.columns
            kept.append({r["doc_id"] for r in out.collect()})
            assert out.count() == len(kept[-1])
        at = out if name != "packing" else at
    rows = {r["doc_id"]: r for r in docs.collect()}
    said = {r["doc_id"]: r for r in lb.predict(docs, lb.fit(docs, lb.fold() != 2)).collect()}
    assert kept[0] == {i for i, r in said.items() if r["lang_pred"] != "und" and r["score"] >= 0.5}
    first = docs.where(F.col("doc_id").isin(list(kept[0])))
    scores = {r["doc_id"]: r["score"] for r in wq.score(first, wq.fit(first)[0]).collect()}
    assert all((scores[i] >= wq.THRESHOLD) == (i in kept[1]) for i in kept[0] if abs(scores[i] - wq.THRESHOLD) > 0.01)
    want = expected([(i, rows[i]["text"]) for i in sorted(kept[1])])
    assert kept[2] == {c for _, _, c in want}
    packed = out.collect()
    assert {r["doc_id"] for r in packed} == kept[2]
    check_packing(packed, 4096)


def test_labelled_documents_survive(spark):
    labels = spark.read.parquet(f"{SF_SMALL}/labels.parquet")
    docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet")
    good = labels.where("quality = 1").join(docs, "doc_id", "left_semi")
    one = cp.quality(spark, cp.language_id(spark, docs, SF_SMALL), SF_SMALL)
    assert good.join(one, "doc_id", "left_semi").count() >= 0.97 * good.count()


def test_edges_and_empty(spark):
    for docs in (cases.documents(spark), cases.no_documents(spark)):
        for _, stage in cp.STAGES:
            out = materialize(stage(spark, docs, ""))
            docs = out if "sequence_id" not in out.columns else docs
        assert out.columns[:2] == ["doc_id", "piece"]
