"""Quality classifier (operator 1): weak labels, EM over labeller accuracies, hashed scorer.

1. Eleven overlapping heuristic labellers vote good, bad or silent, or abstain, on every document.
   The votes of a document are one base-4 code.
2. Expectation-maximisation estimates how each labeller votes on good and on bad documents,
   and the share of good ones.  Documents with one vote code are alike, so EM
   runs on the counts per code: at most 4^11 rows on the driver, whatever the input size.
3. Posterior labels train a logistic scorer on hashed features (word shapes, words, repeats)
   with Spark ML, on at most about ``sample_docs`` documents chosen by a hash of the id.
4. The scorer rates every document by its whole text; ``kept`` is score >= ``threshold``.

A null text or one without words gets score 0 and is not kept.  A very long text is scored
whole; a score that ties with the threshold is kept.  Only the named columns are read, so others
may have any name.  Repeated rows give equal rows; an empty table gives an empty result."""

from __future__ import annotations

import operator
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import (
    INTERNER_LIMIT, Interner, claim, map_arrow, materialize, raw_texts, slices, stable_fraction, table)

SAMPLE_DOCS = 10_000
BUCKETS = 4_096
THRESHOLD = 0.25
SILENT, GOOD, BAD, ABSTAIN = 0, 1, 2, 3  # silent: looked and saw nothing; abstain: cannot judge this text
FALSE_ALARMS = 0.01
LEAST_FOUND = 0.02

_SYMBOLS = b"#*$%&|<>{}[]^~=_\\@"
_UPPER = bytes(range(ord("A"), ord("Z") + 1))
_LOWER = bytes(range(ord("a"), ord("z") + 1))
_DIGITS = b"0123456789"


def _share(raw: bytes, chars: bytes) -> int:
    return len(raw) - len(raw.translate(None, chars))


def _high(share: float, bad_above: float) -> int:
    """A sign of junk."""
    return BAD if share > bad_above else SILENT


def _symbols(m):
    return _high(m["symbols"] / m["size"], 0.02)


def _decorated(m):
    return _high(m["decorated"] / m["n"], 0.1)


def _capitals(m):
    letters = m["upper"] + m["lower"]
    return _high(m["upper"] / letters, 0.4) if letters >= 10 else ABSTAIN


def _exclamations(m):
    return _high(m["bangs"] / m["n"], 0.1)


def _stutter(m):
    return _high(m["repeats"] / m["n"], 0.1) if m["n"] >= 5 else ABSTAIN


def _vocabulary(m):
    """Distinct words against the square root of all words (Heaps' law)."""
    ratio = m["distinct"] / m["n"] ** 0.5
    return ABSTAIN if m["n"] < 30 else BAD if ratio < 2 else GOOD if ratio > 3.5 else SILENT


def _tables(m):
    return _high(m["pipes"] / m["n"], 0.1)


def _lines(m):
    return _high(1 - m["distinct_lines"] / m["lines"], 0.3) if m["lines"] >= 4 else ABSTAIN


def _digits(m):
    return _high(m["digits"] / m["size"], 0.25)


def _word_length(m):
    mean = m["letters_size"] / m["n"]
    return GOOD if 2.5 <= mean <= 10 else BAD if mean < 1.5 or mean > 20 else SILENT


def _sentences(m):
    ratio = m["stops"] / m["n"]
    return ABSTAIN if m["n"] < 30 else GOOD if 0.02 <= ratio <= 0.5 else BAD if ratio > 0.8 else SILENT


LABELLERS = [_symbols, _decorated, _capitals, _exclamations, _stutter, _vocabulary, _tables, _lines, _digits, _word_length,
             _sentences]


def measures(raw: bytes, words: list[bytes]) -> dict[str, int]:
    lines = [x for x in raw.split(b"\n") if x.strip()]
    return {"size": len(raw), "n": len(words), "symbols": _share(raw, _SYMBOLS), "upper": _share(raw, _UPPER),
            "lower": _share(raw, _LOWER), "digits": _share(raw, _DIGITS), "bangs": raw.count(b"!"),
            "pipes": raw.count(b"|"), "decorated": sum(w[-1] in _SYMBOLS for w in words), "stops": raw.count(b"."), "distinct": len(set(words)),
            "repeats": sum(map(operator.eq, words, words[1:])), "letters_size": sum(map(len, words)),
            "lines": len(lines), "distinct_lines": len(set(lines))}


def vote_code(raw: bytes | None) -> int:
    """Votes as base-4 digits, first labeller lowest; -1 for a text without words."""
    words = raw.split() if raw else []
    if not words:
        return -1
    m = measures(raw, words)
    return sum(labeller(m) * 4 ** k for k, labeller in enumerate(LABELLERS))


def digits(codes: np.ndarray) -> np.ndarray:
    return (codes[:, None] // 4 ** np.arange(len(LABELLERS))[None, :]) % 4


def expectation_maximisation(codes: np.ndarray, counts: np.ndarray, rounds: int = 200) -> tuple[np.ndarray, dict]:
    """Posterior of good per code, and the fitted model: P(vote | class) of each labeller.

    Heuristics for junk each see one kind of it, so the bad class is a mixture; what makes
    the classes identifiable is that a bad vote is rarely wrong.  Therefore P(bad vote |
    good) stays at or below ``FALSE_ALARMS`` and a labeller at least finds
    ``LEAST_FOUND`` of the bad documents; all else is estimated.  Abstentions are no evidence."""
    votes = digits(codes)
    seen = np.stack([votes == k for k in (SILENT, GOOD, BAD)], axis=2).astype(float)  # code, labeller, vote
    n = votes.shape[1]
    given_good = np.tile([0.5, 0.495, 0.005], (n, 1))
    given_bad = np.tile([0.5, 0.3, 0.2], (n, 1))
    share, posterior = 0.8, np.full(len(codes), 0.8)
    for _ in range(rounds):
        log_good = np.log(share) + np.einsum("cjv,jv->c", seen, np.log(given_good))
        log_bad = np.log(1 - share) + np.einsum("cjv,jv->c", seen, np.log(given_bad))
        new = 1 / (1 + np.exp(np.clip(log_bad - log_good, -60, 60)))
        done = np.abs(new - posterior).max(initial=0) < 1e-6
        posterior = new
        if done:
            break
        for table_, weight in ((given_good, posterior * counts), (given_bad, (1 - posterior) * counts)):
            sums = np.einsum("c,cjv->jv", weight, seen) + 0.5  # smoothed counts
            table_[:] = sums / sums.sum(axis=1, keepdims=True)
        for table_, low, high in ((given_good, 1e-4, FALSE_ALARMS), (given_bad, LEAST_FOUND, 0.98)):
            bad = np.clip(table_[:, BAD], low, high)
            rest = table_[:, [SILENT, GOOD]]
            table_[:, [SILENT, GOOD]] = rest / rest.sum(axis=1, keepdims=True) * (1 - bad)[:, None]
            table_[:, BAD] = bad
        share = float((posterior @ counts + 8) / (counts.sum() + 10))
    return posterior, {"share_good": share, "given_good": given_good, "given_bad": given_bad}


def shape(chunk: bytes) -> str:
    """Character classes with runs collapsed: ``Word***`` becomes ``Aa*``."""
    out = []
    for c in chunk.decode("utf-8", "replace"):
        k = "A" if c.isupper() else "a" if c.isalpha() else "0" if c.isdigit() else c
        if not out or out[-1] != k:
            out.append(k)
    return "".join(out)


class Features:
    """Hashed features of a text: square roots of the shares of word shapes and of words
    (each distinct chunk is hashed once per worker), of repeats and of vocabulary size."""

    def __init__(self, buckets: int) -> None:
        self.buckets = buckets
        self.reset()

    def reset(self) -> None:
        self.index, self.shapes, self.words = Interner(), np.zeros(1024, np.int64), np.zeros(1024, np.int64)

    def _learn(self) -> None:
        todo, self.index.todo = self.index.todo, []
        start, room = len(self.index) - len(todo), len(self.index) - len(self.shapes)
        if room > 0:
            grow = np.zeros(len(self.index), np.int64)
            self.shapes, self.words = np.concatenate([self.shapes, grow]), np.concatenate([self.words, grow])
        for at, chunk in enumerate(todo, start):
            self.shapes[at] = zlib.crc32(b"shape " + shape(chunk).encode()) % self.buckets
            self.words[at] = zlib.crc32(b"word " + chunk.lower()) % self.buckets

    def vectors(self, texts: list[bytes | None]) -> Iterator[np.ndarray | None]:
        """Dense vectors of 2 * buckets + 2; None for a text without words."""
        if len(self.index) > INTERNER_LIMIT:
            self.reset()
        look, met = self.index.__getitem__, []
        for t in texts:
            chunks = t.split() if t else []
            met.append(np.fromiter(map(look, chunks), np.int64, len(chunks)))
        self._learn()
        for at in met:
            if not len(at):
                yield None
                continue
            n = len(at)
            repeats = int((at[1:] == at[:-1]).sum())
            yield np.sqrt(np.concatenate([np.bincount(self.shapes[at], minlength=self.buckets),
                                          np.bincount(self.words[at], minlength=self.buckets),
                                          [repeats, min(n, len(np.unique(at)) * n ** 0.5 / 8)]]) / n)


def vote_codes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, code) of every row."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            codes = [vote_code(t) for t in raw_texts(batch.column(1))]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(codes, pa.int64())], names=["doc_id", "code"])

    id_type = docs.schema[id_col].dataType.simpleString()
    return (docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
            .transform(map_arrow, run, f"doc_id {id_type}, code bigint"))


class Scorer:
    def __init__(self, weights: np.ndarray, bias: float, buckets: int) -> None:
        self.key, self.weights, self.bias, self.buckets = uuid.uuid4().hex, weights, bias, buckets

    def scores(self, features: Features, texts: list[bytes | None]) -> np.ndarray:
        out = []
        for a, b in slices(texts):
            for x in features.vectors(texts[a:b]):
                out.append(0.0 if x is None else 1 / (1 + np.exp(-np.clip(x @ self.weights + self.bias, -60, 60))))
        return np.array(out, float)


def fit(docs: DataFrame, sample_docs: int = SAMPLE_DOCS, buckets: int = BUCKETS, id_col: str = "doc_id",
        text_col: str = "text") -> tuple[Scorer, dict]:
    """The scorer and the EM model (labeller accuracies, share of good documents)."""
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.linalg import Vectors, VectorUDT

    per_code = vote_codes(docs, id_col, text_col).groupBy("code").agg(F.count("*").alias("n")).collect()
    voted = [(r["code"], r["n"]) for r in per_code if r["code"] >= 0]  # at most 4 ** labellers
    if not voted:
        return Scorer(np.zeros(2 * buckets + 2), 0.0, buckets), {}
    codes, counts = (np.array(x, np.int64) for x in zip(*sorted(voted)))
    posterior, em = expectation_maximisation(codes, counts.astype(float))
    good = dict(zip(codes.tolist(), posterior.tolist()))
    total = sum(r["n"] for r in per_code)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        features = claim(("quality", buckets), lambda: Features(buckets))
        for batch in batches:
            texts = raw_texts(batch.column(0))
            for a, b in slices(texts, 1 << 20):
                rows = [(np.flatnonzero(x), x, good[vote_code(t)])
                        for t, x in zip(texts[a:b], features.vectors(texts[a:b])) if x is not None]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([i.tolist() for i, _, _ in rows], pa.list_(pa.int32())),
                     pa.array([x[i].tolist() for i, x, _ in rows], pa.list_(pa.float64())),
                     pa.array([p for _, _, p in rows], pa.float64())], names=["at", "value", "good"])

    chosen = docs.where(stable_fraction(F.col(id_col).cast("string"), min(1.0, sample_docs / total)))
    sample = materialize(chosen.select(F.col(text_col).alias("text"))
                         .transform(map_arrow, run, "at array<int>, value array<double>, good double"))
    if sample.isEmpty():
        return Scorer(np.zeros(2 * buckets + 2), 0.0, buckets), em
    width = 2 * buckets + 2
    vector = F.udf(lambda at, value: Vectors.sparse(width, at, value), VectorUDT())
    # a posterior label is two weighted rows
    p = F.greatest(F.lit(1e-6), F.least(F.lit(1 - 1e-6), F.col("good")))
    rows = (sample.withColumn("features", vector("at", "value"))
            .select("features", F.explode(F.array(F.struct(F.lit(1.0).alias("label"), p.alias("weight")),
                                                  F.struct(F.lit(0.0).alias("label"), (1 - p).alias("weight")))).alias("y"))
            .select("features", "y.label", "y.weight"))
    model = LogisticRegression(weightCol="weight", maxIter=40, regParam=1e-4, standardization=False).fit(rows)
    return Scorer(model.coefficients.toArray(), float(model.intercept), buckets), em


def score(docs: DataFrame, scorer: Scorer, threshold: float = THRESHOLD, id_col: str = "doc_id",
          text_col: str = "text") -> DataFrame:
    """(doc_id, score, kept) of every row."""
    shared = docs.sparkSession.sparkContext.broadcast(scorer)  # 2 * buckets + 2 numbers

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        features = claim(("quality", shared.value.buckets), lambda: Features(shared.value.buckets))
        for batch in batches:
            scores = shared.value.scores(features, raw_texts(batch.column(1)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(scores), pa.array(scores >= threshold)],
                                             names=["doc_id", "score", "kept"])

    id_type = docs.schema[id_col].dataType.simpleString()
    return (docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
            .transform(map_arrow, run, f"doc_id {id_type}, score double, kept boolean"))


def keep_good(docs: DataFrame, scorer: Scorer, threshold: float = THRESHOLD, text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, all columns, with score >= ``threshold`` (texts without words go)."""
    shared, at = docs.sparkSession.sparkContext.broadcast(scorer), docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        features = claim(("quality", shared.value.buckets), lambda: Features(shared.value.buckets))
        for batch in batches:
            yield batch.filter(pa.array(shared.value.scores(features, raw_texts(batch.column(at))) >= threshold))

    return docs.transform(map_arrow, run, docs.schema)


def op1_weak_label_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return score(docs, fit(docs)[0])


QUERIES = {"op1_weak_label_quality": op1_weak_label_quality}
ORACLE: dict[str, str] = {}
