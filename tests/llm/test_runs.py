import hashlib
import random
import re
import zlib
from fractions import Fraction

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from tests.conftest import SF_SMALL
from tests.llm import cases
from tidemark.llm import periodic_runs as pr

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def plain_runs(words):
    """Longest stretches of every period, shortest period first; a stretch that a smaller period
    explains is not its own run."""
    n, out = len(words), []
    for q in range(1, n // 4 + 1):
        i = 0
        while i < n - q:
            if words[i] != words[i + q]:
                i += 1
                continue
            j = i
            while j < n - q and words[j] == words[j + q]:
                j += 1
            size = j + q - i
            smaller = any(all(words[k] == words[k + d] for k in range(i, i + size - d)) for d in range(1, q))
            if size >= max(6, 4 * q) and not smaller:
                out.append((i, size, q))
            i = j + 1
    return sorted(out, key=lambda r: (r[0], r[2]))


def planted(doc_id, words):
    if doc_id is None or not words:
        return words
    h = zlib.crc32(str(doc_id).encode())
    if h % 10:
        return words
    g, n = h // 10, len(words)
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]


def digests(words):
    runs = plain_runs(words)
    dropped = {i for s, n, q in runs for i in range(s + q, s + n)}
    best = max(runs, key=lambda r: (Fraction(r[1], r[2]), -r[0], -r[2]), default=None)
    four = (None,) * 4 if best is None else (*best, 1000 * best[1] // best[2])
    return (len(runs), *four, hashlib.sha256("".join(f"{s},{n},{q}\n" for s, n, q in runs).encode()).hexdigest(),
            hashlib.sha256(" ".join(w for i, w in enumerate(words) if i not in dropped).encode()).hexdigest())


def in_stretches(codes):
    found = []
    codes = np.array(codes, np.int64)
    for a, b in pr.stretches(codes, np.zeros(len(codes), np.int64)):
        found += [(s + a, n, q) for s, n, q in pr.find_runs(codes[a:b].tolist())]
    return sorted(found, key=lambda r: (r[0], r[2]))


@settings(max_examples=300, deadline=None)
@given(st.lists(st.integers(0, 2), max_size=60))
def test_small_alphabets(codes):
    assert pr.find_runs(codes) == plain_runs(codes) == in_stretches(codes)


@settings(max_examples=150, deadline=None)
@given(st.lists(st.tuples(st.lists(st.integers(0, 4), min_size=1, max_size=7), st.integers(1, 7)), max_size=8))
def test_repeated_blocks(blocks):
    codes = [c for block, times in blocks for c in block * times]
    assert pr.find_runs(codes) == plain_runs(codes) == in_stretches(codes)


def test_nested_runs_and_long_periods():
    rng = random.Random(5)
    inner = [1, 2] * 5 + [3]
    long = [rng.randrange(40) for _ in range(150)]
    for codes in (inner * 6, long * 4 + long[:70], [7] * 500, [rng.randrange(3) for _ in range(700)], (inner * 4 + [9, 9]) * 4):
        assert pr.find_runs(codes) == plain_runs(codes) == in_stretches(codes)


def rows_of(df):
    return {r["id"]: (r["n_words"], [tuple(x) for x in r["runs"]], r["collapsed"]) for r in df.collect()}


def test_texts_and_edges(spark):
    texts = cases.TEXTS + ["a b " * 9 + "x " + "c " * 7, "ab ab ab ab ab", "ab ab ab ab ab ab", " ".join(["p q r"] * 4)]
    docs = cases.documents(spark, texts)
    got = rows_of(pr.runs(docs))
    assert pr.runs(docs).count() == docs.count()
    for i, t in enumerate(texts):
        words = WORD.findall(t or "")
        want = plain_runs(words) if len(words) < 5000 else []  # the long text repeats no window three times in a row
        dropped = {k for s, n, q in want for k in range(s + q, s + n)}
        assert got[i] == (len(words), want, " ".join(w for k, w in enumerate(words) if k not in dropped))
    assert pr.runs(cases.no_documents(spark)).count() == 0


def test_planted_texts_follow_the_contract(spark):
    docs = cases.documents(spark, [f"{'a b c d e f g ' * (i % 5 + 1)}w{i}" for i in range(120)])
    rows = {r["doc_id"]: r["text"] for r in docs.collect()}
    for r in pr.with_planted_periods(docs.where("doc_id is not null")).collect():
        words = WORD.findall(rows[r["doc_id"]] or "")
        assert WORD.findall(r["text"] or "") == planted(r["doc_id"], words)


def test_query_matches_brute_force(spark):
    limit = 1500
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SF_SMALL}/documents.parquet").collect()}
    rows = pr.op13_periodic_runs(spark, SF_SMALL).collect()
    assert len(rows) == len(docs)
    for r in rows:
        words = planted(r["doc_id"], WORD.findall(docs[r["doc_id"]] or ""))
        if len(words) <= limit:  # the brute force is cubic
            assert tuple(r)[1:] == digests(words), r["doc_id"]
    assert any(r["n_runs"] for r in rows)
