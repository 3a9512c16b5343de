import hashlib
import zlib
from collections import defaultdict

import pytest

from tests.llm import cases
from tidemark.llm import merkle_manifest as mm


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(row, changed=None):
    values = {f: row[f] for f in mm.FIELDS} | (changed or {})
    return h(*["-" if v is None else f"{len(str(v).encode())}:{v}" for v in values.values()])


def levels(digests, f):
    out = [digests]
    while len(out[-1]) > 1:
        out.append([h(*out[-1][i:i + f]) for i in range(0, len(out[-1]), f)])
    return out


def siblings(tree, i, f):
    """(left, right) of every level."""
    for here in tree[:-1]:
        base = i - i % f
        yield here[base:i], here[i + 1:base + f]
        i //= f


def plain(rows, f):
    groups = defaultdict(list)
    for r in rows:
        changed = {}
        if r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 7 == 0 and r["n_chars"] is not None:
            changed = {"n_chars": r["n_chars"] + 1}
        groups[r["lang"]].append((r["doc_id"], leaf(r), leaf(r, changed)))
    order = sorted(groups, key=lambda x: (x is not None, (x or "").encode()))
    trees = {}
    for g in order:
        groups[g].sort(key=lambda x: (x[0] is not None, x[0] or 0, x[1]))
        trees[g] = levels([x[1] for x in groups[g]], f)
    top = levels([trees[g][-1][0] for g in order], f)
    out = []
    for k, g in enumerate(order):
        for i, (doc, own, changed) in enumerate(groups[g]):
            path = [*siblings(trees[g], i, f), *siblings(top, k, f)]
            digest = changed
            for left, right in path:
                digest = h(*left, digest, *right)
            out.append((doc, own, trees[g][-1][0], top[-1][0], h(*[x for left, right in path for x in (*left, *right)]), digest,
                        digest == top[-1][0]))
    return sorted(out, key=str)


def rows_of(df):
    text = [c for c in ("leaf", "subroot", "root", "folded_root")]
    return sorted(((r["id"], *[r[c].hex() for c in text[:3]], h(r["proof"].hex()), r["folded_root"].hex(), r["verified"])
                   for r in df.collect()), key=str)


@pytest.mark.parametrize("fanout", [2, 3, 5])
def test_matches_a_plain_tree(spark, fanout):
    docs = cases.documents(spark)
    got = rows_of(mm.manifest(docs, check_digest=mm.tampered(), fanout=fanout))
    assert got == plain(docs.collect(), fanout)
    assert {x[-1] for x in got} == {True, False}


def test_uneven_groups_hot_rows_and_one_group(spark):
    rows = [(i % 41, "s", None if i % 3 else f"l{i % 9}", i, "x") for i in range(300)] + [(7, "s", "hot", 1, "same")] * 200
    docs = spark.createDataFrame(rows, "doc_id bigint, source string, lang string, n_chars bigint, text string").repartition(5)
    assert rows_of(mm.manifest(docs, check_digest=mm.tampered())) == plain(docs.collect(), 2)
    for one in ([(1, "s", "en", 3, "a")], [(i, "s", "en", 3, "a") for i in range(6)], [(i, "s", f"l{i}", 3, "a") for i in range(3)]):
        docs = spark.createDataFrame(one, docs.schema)
        assert rows_of(mm.manifest(docs, check_digest=mm.tampered())) == plain(docs.collect(), 2)


def test_a_changed_row_changes_the_root_and_the_untouched_ones_verify(spark):
    docs = cases.documents(spark)
    rows = mm.manifest(docs).collect()
    assert all(r["verified"] for r in rows)
    other = mm.manifest(docs.withColumn("text", mm.F.expr("if(doc_id = 3, 'Word', text)"))).first()
    assert other["root"] != rows[0]["root"]


def test_empty_table(spark):
    assert mm.manifest(cases.no_documents(spark)).count() == 0
