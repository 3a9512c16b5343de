import re
from collections import Counter

from tests.llm import cases
from tidemark.llm import rule_ledger as rl


def plain(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    windows = [tuple(words[i:i + 3]) for i in range(len(words) - 2)]
    twice = Counter(windows)
    covered = {p for i, w in enumerate(windows) if twice[w] > 1 for p in (i, i + 1, i + 2)}
    return (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered))


def test_measures_match_brute_force(spark):
    texts = cases.TEXTS + ["a b c x a b c", "a b a b a b a b", "#a *b $c %d &e |f <g >h", "q q", "l\nl \nl\n\nl\n l"]
    docs = cases.documents(spark, texts)
    got = {r["doc_id"]: r for r in rl.ledger(docs).collect()}
    for i, t in enumerate(texts):
        r = got[i]
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == plain(t), t
        few = r["n_words"] < 50
        repeated = 100 * r["n_repeat_words"] > 50 * r["n_words"]
        assert (r["fail_bits"] & 3) == few + 2 * repeated


def test_policies_and_ablation(spark):
    docs = cases.documents(spark)
    rows = rl.ledger(docs)
    for policy, rules in rl.POLICIES.items():
        bits = [r["fail_bits"] & rl.mask(policy) for r in rows.collect()]
        assert rl.apply_policy(rows, policy).where("kept").count() == bits.count(0)
        got = {r["rule"]: (r["n_failed"], r["n_only"]) for r in rl.ablation(rows, policy).collect()}
        for rule in rules:
            bit = 1 << list(rl.RULES).index(rule)
            assert got[rule] == (sum(b & bit > 0 for b in bits), bits.count(bit))


def test_empty_table_and_plan(spark):
    rows = rl.ledger(cases.no_documents(spark))
    assert rows.count() == 0
    plan = rl.measure(cases.documents(spark))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Exchange" not in plan
