import numpy as np

from tests.llm import cases
from tidemark.llm import weak_label_quality as wq

SF = "/root/testdata/sf0.01"


def test_agrees_with_labels(spark):
    got = wq.op1_weak_label_quality(spark, SF)
    both = got.join(spark.read.parquet(f"{SF}/labels.parquet"), "doc_id").toPandas()
    good = both[both.quality == 1]
    assert good.kept.mean() >= 0.99
    assert (both[both.quality == 0].kept).mean() <= 0.1
    assert got.count() == spark.read.parquet(f"{SF}/documents.parquet").count()


def test_em_recovers_labellers():
    rng = np.random.default_rng(1)
    y = rng.random(20_000) < 0.8  # good
    n = len(wq.LABELLERS)
    votes = np.where(y[:, None], rng.choice([0, 1, 2], (len(y), n), p=[.5, .497, .003]),
                     rng.choice([0, 1, 2], (len(y), n), p=[.4, .25, .35]))
    codes, at, counts = np.unique(votes @ 4 ** np.arange(n), return_inverse=True, return_counts=True)
    posterior, em = wq.expectation_maximisation(codes, counts.astype(float))
    assert ((posterior[at] > 0.5) == y).mean() > 0.97
    assert abs(em["share_good"] - 0.8) < 0.05
    assert np.abs(em["given_bad"][:, wq.BAD] - 0.35).max() < 0.06


def test_edges(spark):
    docs = cases.documents(spark)
    scorer, _ = wq.fit(docs)
    rows = {r["doc_id"]: r for r in wq.score(docs, scorer).collect()}
    assert len(rows) == len({r[0] for r in docs.select("doc_id").collect()})
    for i in (0, 1, 2):
        assert rows[i]["score"] == 0 and not rows[i]["kept"]
    assert all(0 <= r["score"] <= 1 for r in rows.values())
    assert wq.keep_good(docs, scorer).columns == docs.columns


def test_empty_table(spark):
    docs = cases.no_documents(spark)
    assert wq.score(docs, wq.fit(docs)[0]).count() == 0
