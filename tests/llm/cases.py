"""Edge tables shared by the tests of the training-data operators."""

from __future__ import annotations

import numpy as np

LONG = " ".join(f"w{i % 977}x{i % 31}" for i in range(60_000))
PROSE = ("The committee met on Tuesday to discuss the harvest, and after some hours of debate they agreed that "
         "the old mill should be repaired before winter. Nobody spoke against it.")

TEXTS = [None, "", "   \n\t ", "word", "one two", "a b c d", "a b c d e f g h", "A B C D e f g h", PROSE, PROSE, PROSE + " End.",
         LONG, "12 34 56 !!! ???", "ÀÉÎ çà où être", "x y z w", "🙂 🙂 🙂 🙂 🙂", "\x00 \x1c \x85 odd",
         "the the the the the the the the", "l1\nl1\nl1\nl1\nl2", "tab\tsep\rcr\x0bvt\x0cff end"]

#: Names that operators use inside or return; as extra input columns they must not matter.
CLASHES = ["fp", "score", "kept", "words", "key", "shard", "slot", "length", "piece", "rule", "lang_pred", "component_id",
           "n", "size", "root", "node", "digest", "windows", "at", "code", "good", "text_crc32", "n_words", "fp_of_row"]


def documents(spark, texts=TEXTS, clash=True):
    """doc_id, text, lang, source, n_chars: with a null id, a repeated row and null columns."""
    rows = [(i, t, "en" if i % 3 else None, None if i % 5 == 0 else f"src{i % 2}", None if t is None else len(t))
            for i, t in enumerate(texts)]
    rows += [(None, PROSE, "en", "src0", len(PROSE)), (None, None, None, None, None), rows[8], rows[8]]
    extra = "".join(f", {c} string" for c in CLASHES) if clash else ""
    rows = [r + (("x",) * len(CLASHES) if clash else ()) for r in rows]
    return spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint" + extra)


def no_documents(spark):
    return documents(spark).limit(0)


def groups(n: int, pairs) -> list[int]:
    """Least index reachable, by plain relaxation."""
    least = list(range(n))
    changed = True
    while changed:
        changed = False
        for a, b in pairs:
            low = min(least[a], least[b])
            if least[a] != low or least[b] != low:
                least[a] = least[b] = low
                changed = True
    return least


def unit(rng: np.random.Generator, n: int, dim: int) -> np.ndarray:
    x = rng.standard_normal((n, dim))
    return x / np.linalg.norm(x, axis=1, keepdims=True)
