"""Quality rules (operator 5, native): rule bitmask ledger.

``ledger`` measures every text, evaluates every rule once and stores one row per document with
the measurements and an integer whose bit k is set if rule k fails.  Policies are versioned bit
masks: ``apply_policy`` is one bitwise AND, and ``ablation`` derives from the grouped bits
alone how many documents each rule of a policy removes, and removes on its own.  Everything
is DataFrame functions; nothing is shuffled but the grouped bits.

The words of a text are its runs of characters other than space and U+0009 to U+000D.  Null
and empty texts have no words: all measurements are 0, and the rules that need a word pass.
Repeated rows give equal rows; an empty table gives an empty ledger.  Three-word windows are
compared by 64-bit hashes of their words.  Texts are measured whole, whatever their length; no
measurement depends on an order, so nothing ties.  Only the named columns are read, so others
may have any name."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import materialize, table

_GAP = r"[\x20\x09-\x0D]+"
_SOLID = r"[^\x20\x09-\x0D]"
_SYMBOLS = "[#*$%&|<>]+"

MEASURES = ["n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words", "n_capitals", "n_letters"]

#: Rule -> condition of failure, in bit order.  New rules go to the end.
RULES: dict[str, str] = {
    "few_words": "n_words < 50",
    "repeated_windows": "100 * n_repeat_words > 50 * n_words",
    "symbol_heavy": "10 * n_symbols > n_words",
    "duplicate_lines": "n_lines >= 4 and 10 * n_dup_lines > 3 * n_lines",
    "short_words": "word_chars < 2 * n_words",
    "long_words": "word_chars > 20 * n_words",
    "capitals": "n_letters >= 20 and 2 * n_capitals > n_letters",
    "few_letters": "n_words > 0 and 2 * n_letters < word_chars",
}

#: Version -> rules that reject a document.
POLICIES: dict[str, list[str]] = {
    "base": ["few_words", "repeated_windows"],
    "v1": ["few_words", "repeated_windows", "symbol_heavy", "duplicate_lines", "short_words", "long_words"],
    "v2": list(RULES),
}
PRODUCTION = "v2"


def mask(policy: str) -> int:
    return sum(1 << list(RULES).index(r) for r in POLICIES[policy])


def ledger(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The stored ledger: ``measure`` written once and read back, so that policies, filters and
    ablations read columns and never evaluate a rule again."""
    return materialize(measure(docs, id_col, text_col))


def measure(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, measurements, fail_bits) of every row, as one projection of the texts.

    Repeated windows: the sorted hashes show which values occur twice; a 64-bit mask of those
    values drops most other windows; the windows left are sorted with their positions, equal
    neighbours mark the repeated ones, and the sorted positions give the words they cover.
    Each step is a column that the next ones use more than once, so Spark keeps it as a column
    and works it out once per row."""
    text, words, windows, ranked = F.col("text"), F.col("words"), F.col("windows"), F.col("ranked")
    lines, twice, placed, starts = F.col("lines"), F.col("twice"), F.col("placed"), F.col("starts")
    n = F.size(words)

    def bit(h):
        return F.shiftright(h, 58).bitwiseAND(F.lit(63))

    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    rows = rows.select("doc_id", "text", F.filter(F.split(text, _GAP), lambda w: w != "").alias("words"))
    rows = rows.select(
        "doc_id", n.cast("bigint").alias("n_words"), F.array_join(words, "").alias("solid"),
        F.transform(F.slice(words, 1, F.greatest(n - 2, F.lit(0))),
                    lambda w, i: F.xxhash64(w, F.get(words, i + 1), F.get(words, i + 2))).alias("windows"),
        F.filter(F.split(text, "\n"), lambda x: x.rlike(_SOLID)).alias("lines"))
    rows = rows.select("*", F.sort_array(windows).alias("ranked"))
    rows = rows.select("*", F.filter(ranked, lambda h, k: (k > 0) & (F.get(ranked, k - 1) == h)).alias("twice"))
    rows = rows.select("*", F.aggregate(twice, F.lit(0).cast("bigint"),
                                        lambda m, h: m.bitwiseOR(F.call_function("shiftleft", F.lit(1).cast("bigint"), bit(h).cast("int")))).alias("marks"))
    marked = F.filter(F.transform(windows, lambda h, i: F.struct(h.alias("h"), i.alias("i"))),
                      lambda w: F.call_function("shiftrightunsigned", F.col("marks"), bit(w["h"]).cast("int")).bitwiseAND(F.lit(1).cast("bigint")) == 1)
    none = F.array().cast("array<struct<h:bigint,i:int>>")
    rows = rows.select("*", F.when(F.col("marks") == 0, none).otherwise(F.sort_array(marked)).alias("placed"))
    same = F.filter(placed, lambda w, k: ((k > 0) & (F.get(placed, k - 1)["h"] == w["h"]))
                    | F.coalesce(F.get(placed, k + 1)["h"] == w["h"], F.lit(False)))
    rows = rows.select("*", F.sort_array(F.transform(same, lambda w: w["i"])).alias("starts"))
    covered = F.aggregate(F.transform(starts, lambda at, k: F.least(F.lit(3), F.coalesce(F.get(starts, k + 1) - at, F.lit(3)))),
                          F.lit(0), lambda total, part: total + part)
    chars = F.char_length("solid")

    def dropped(pattern):
        return (chars - F.char_length(F.regexp_replace("solid", pattern, ""))).cast("bigint")

    measured = rows.select(
        "doc_id", "n_words", chars.cast("bigint").alias("word_chars"), dropped(_SYMBOLS).alias("n_symbols"),
        F.size(lines).cast("bigint").alias("n_lines"),
        (F.size(lines) - F.size(F.array_distinct(lines))).cast("bigint").alias("n_dup_lines"),
        covered.cast("bigint").alias("n_repeat_words"),
        dropped(r"\p{Lu}+").alias("n_capitals"), dropped(r"\p{L}+").alias("n_letters"))
    bits = F.lit(0).cast("bigint")
    for k, condition in enumerate(RULES.values()):
        bits = bits.bitwiseOR(F.when(F.expr(condition), F.lit(1 << k)).otherwise(F.lit(0)).cast("bigint"))
    return measured.select("*", bits.alias("fail_bits"))


def failed(policy: str, bits: str = "fail_bits") -> Column:
    """True if the ledger bits hold a rule of the policy."""
    return F.col(bits).bitwiseAND(F.lit(mask(policy))) != 0


def apply_policy(rows: DataFrame, policy: str) -> DataFrame:
    """Add ``kept`` by a policy version; the texts are not read again."""
    return rows.withColumn("kept", ~failed(policy))


def ablation(rows: DataFrame, policy: str) -> DataFrame:
    """(rule, n_failed, n_only): documents that the rule rejects, and those that only this
    rule of the policy rejects, i.e. that come back without it."""
    grouped = rows.groupBy(F.col("fail_bits").bitwiseAND(F.lit(mask(policy))).alias("bits")).agg(F.count("*").alias("n"))
    names = list(RULES)
    rules = F.explode(F.array(*[F.struct(F.lit(r).alias("rule"), F.lit(1 << names.index(r)).cast("bigint").alias("bit"))
                                for r in POLICIES[policy]]))
    return (grouped.select("bits", "n", rules.alias("r")).groupBy(F.col("r.rule").alias("rule"))
            .agg(F.sum(F.when(F.col("bits").bitwiseAND(F.col("r.bit")) != 0, F.col("n")).otherwise(0)).alias("n_failed"),
                 F.sum(F.when(F.col("bits") == F.col("r.bit"), F.col("n")).otherwise(0)).alias("n_only")))


def op5_rule_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = apply_policy(ledger(table(spark, sf_dir, "documents")), PRODUCTION)
    return rows.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "fail_bits",
                       failed("base").alias("base_failed"), "kept")


# The windows are compared by their words here (joined by a character no word holds).
ORACLE_SQL = r"""
WITH t AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM documents),
w AS (SELECT r, doc_id, text, list_filter(string_split_regex(text, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS words,
             list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines FROM t),
m AS (SELECT r, doc_id, len(words) AS n_words, length(array_to_string(words, '')) AS word_chars,
             array_to_string(words, '') AS solid, len(lines) AS n_lines,
             len(lines) - len(list_distinct(lines)) AS n_dup_lines, words FROM w),
win AS (SELECT r, unnest(range(1, len(words) - 1)) AS i,
               unnest(list_transform(range(1, len(words) - 1),
                      lambda k: words[k] || ' ' || words[k + 1] || ' ' || words[k + 2])) AS g FROM m WHERE len(words) >= 3),
dup AS (SELECT r, i FROM win QUALIFY count(*) OVER (PARTITION BY r, g) > 1),
rep AS (SELECT r, count(DISTINCT p) AS n FROM (SELECT r, unnest([i, i + 1, i + 2]) AS p FROM dup) GROUP BY r),
x AS (SELECT m.*, coalesce(rep.n, 0) AS n_repeat_words,
             word_chars - length(regexp_replace(solid, '[#*$%&|<>]', '', 'g')) AS n_symbols,
             word_chars - length(regexp_replace(solid, '\p{Lu}', '', 'g')) AS n_capitals,
             word_chars - length(regexp_replace(solid, '\p{L}', '', 'g')) AS n_letters
      FROM m LEFT JOIN rep USING (r)),
b AS (SELECT *, (CASE WHEN n_words < 50 THEN 1 ELSE 0 END)
        + (CASE WHEN 100 * n_repeat_words > 50 * n_words THEN 2 ELSE 0 END)
        + (CASE WHEN 10 * n_symbols > n_words THEN 4 ELSE 0 END)
        + (CASE WHEN n_lines >= 4 AND 10 * n_dup_lines > 3 * n_lines THEN 8 ELSE 0 END)
        + (CASE WHEN word_chars < 2 * n_words THEN 16 ELSE 0 END)
        + (CASE WHEN word_chars > 20 * n_words THEN 32 ELSE 0 END)
        + (CASE WHEN n_letters >= 20 AND 2 * n_capitals > n_letters THEN 64 ELSE 0 END)
        + (CASE WHEN n_words > 0 AND 2 * n_letters < word_chars THEN 128 ELSE 0 END) AS fail_bits FROM x)
SELECT doc_id, CAST(n_words AS BIGINT) AS n_words, CAST(word_chars AS BIGINT) AS word_chars,
       CAST(n_symbols AS BIGINT) AS n_symbols, CAST(n_dup_lines AS BIGINT) AS n_dup_lines,
       CAST(n_repeat_words AS BIGINT) AS n_repeat_words, CAST(fail_bits AS BIGINT) AS fail_bits,
       (CAST(fail_bits AS BIGINT) & 3) <> 0 AS base_failed, fail_bits = 0 AS kept
FROM b
"""

QUERIES = {"op5_rule_ledger": op5_rule_ledger}
ORACLE = {"op5_rule_ledger": ORACLE_SQL}
