import itertools
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

from tests.llm import cases
from tidemark.llm import bin_slack_packing as bp


def check_packing(rows, max_len):
    bins = defaultdict(list)
    for r in rows:
        bins[r["sequence_id"]].append((r["offset"], r["length"]))
    for parts in bins.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= max_len
    return len(bins)


def test_ids_and_places(spark):
    docs = cases.documents(spark)
    rows = bp.pack_documents(docs).collect()
    tokenizer, want = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json")), []
    for r in docs.collect():
        ids = tokenizer.encode(r["text"] or "", add_special_tokens=False).ids + [1]
        for k in range(0, len(ids), 4096):
            part = np.array(ids[k:k + 4096], "<u4")
            want.append((r["doc_id"], k // 4096, k, len(part), zlib.crc32(part.tobytes())))
    got = [(r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in rows]
    assert Counter(got) == Counter(want)
    check_packing(rows, 4096)


def test_empty_table(spark):
    assert bp.pack_documents(cases.no_documents(spark)).count() == 0


def test_fullest_is_the_best_subset():
    rng = random.Random(5)
    for _ in range(200):
        items = [rng.randint(1, 30) for _ in range(rng.randint(0, 9))]
        capacity = rng.randint(0, 60)
        best = max(sum(c) for n in range(len(items) + 1) for c in itertools.combinations(items, n) if sum(c) <= capacity)
        used = bp.fullest(capacity, Counter(items))
        assert sum(k * n for k, n in used.items()) == best
        assert all(n <= Counter(items)[k] for k, n in used.items())


def test_bins_are_nearly_full():
    rng = random.Random(7)
    lengths = Counter(min(4096, int(rng.lognormvariate(6, 1)) + 1) for _ in range(20_000))
    runs = bp.plan_bins(dict(lengths))
    bins = max(first + (to - start) // each for _, start, to, each, first, _ in runs)
    assert bins <= 1.002 * sum(k * n for k, n in lengths.items()) / 4096 + 1
    given = Counter()
    for length, start, to, *_ in runs:
        given[length] += to - start
    assert given == lengths


def test_ties_and_hot_length(spark):
    parts = spark.range(3000).selectExpr("id as doc_id", "0 as piece", "cast(if(id % 3 = 0, 7, 100 + id % 5) as bigint) as length")
    rows = bp.pack(parts, 1000).collect()
    assert len(rows) == 3000
    assert check_packing(rows, 1000) <= sum(r["length"] for r in rows) / 1000 * 1.04 + 1
