"""String expressions (P1, P11, P16, P17, F1-F5) as built-in Catalyst functions."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


# Java's \s is ASCII-only; (?U) switches it to Unicode white space like Python's re.
_WS = r"(?U)\s"


def clean_news_text(x) -> Column:
    """Drop double quotes, ``***...***`` runs, leading/trailing asterisks,
    collapse white space and trim.  NULL stays NULL (all functions are null-safe)."""
    c = _c(x)
    c = F.regexp_replace(c, '"', "")
    # (?d): only a line feed ends a line for . and $, as in Python
    c = F.regexp_replace(c, r"(?Ud)\*{3,}.*?\*{3,}\s*", "")
    c = F.regexp_replace(c, r"(?Ud)^\*+\s*|\s*\*+$", "")
    c = F.regexp_replace(c, r"(?U)\s+", " ")
    return F.trim(c)


def is_blank(x) -> Column:
    """NULL or only white space (anchored match: stops at the first
    non-space character instead of rewriting a whole document)."""
    c = _c(x)
    return c.isNull() | c.rlike(r"^(?U)\s*\z")


# Transliteration used before ASCII folding of feature names.
UMLAUT_FROM = "äöüÄÖÜß"
UMLAUT_TO = ["ae", "oe", "ue", "Ae", "Oe", "Ue", "ss"]


def _ascii_fold():
    """NFKD with everything that is not ASCII left out; Spark has no normaliser, so this one
    step is an Arrow-batched UDF (feature names are few)."""
    @F.pandas_udf("string")
    def fold(names: pd.Series) -> pd.Series:
        return names.map(lambda v: None if v is None else unicodedata.normalize("NFKD", v).encode("ascii", "ignore").decode())
    return fold


def sanitize_feature_name(x) -> Column:
    """Umlauts -> digraphs, NFKD to ASCII, non ``[A-Za-z0-9_.-]`` -> ``_``, collapse and
    strip underscores."""
    c = _c(x)
    for src, dst in zip(UMLAUT_FROM, UMLAUT_TO):
        c = F.replace(c, F.lit(src), F.lit(dst))
    c = _ascii_fold()(c)
    c = F.regexp_replace(c, r"[^A-Za-z0-9_\-.]", "_")
    c = F.regexp_replace(c, r"_+", "_")
    return F.regexp_replace(c, r"^_+|_+$", "")


def truncate_label(x, max_len: int = 40) -> Column:
    """Cut to ``max_len`` characters with a trailing ``...``."""
    c = _c(x)
    return F.when(F.length(c) > max_len,
                  F.concat(F.substring(c, 1, max_len - 3), F.lit("..."))).otherwise(c)


# Keywords of the feature categories.
PRICE_WORDS = "price|spread|auction|spot"
ENERGY_WORDS = "solar|wind|hydro|biomass|load|generation"


def feature_category(x, nlp_prefix: str = "news_") -> Column:
    """Tag a feature name as NLP (by its prefix), Price, Energy or Other."""
    c = F.lower(_c(x))
    return (F.when(c.startswith(nlp_prefix.lower()), "NLP").when(c.rlike(PRICE_WORDS), "Price")
            .when(c.rlike(ENERGY_WORDS), "Energy").otherwise("Other"))
