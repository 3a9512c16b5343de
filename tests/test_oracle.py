"""Every registered query against its DuckDB twin (layer 1 of SURVEY section 5)."""

import math

import pandas as pd
import pytest

from tests.conftest import SF_SMALL
from tidemark.plans import registry

ORACLE = registry.oracle_sql()
QUERIES = registry.queries()


def _norm(v):
    if v is None or v is pd.NA or v is pd.NaT:
        return None
    if hasattr(v, "item") and not isinstance(v, (str, bytes)):
        try:
            v = v.item()
        except Exception:
            pass
    if isinstance(v, float):
        return None if math.isnan(v) else v + 0.0
    if hasattr(v, "isoformat"):
        return v.isoformat()
    return v


def _rows(pdf):
    """Columns, and rows sorted by their exact values first, then by their numbers."""
    cols = sorted(pdf.columns)
    rows = [tuple(_norm(x) for x in r) for r in pdf[cols].itertuples(index=False, name=None)]
    return cols, sorted(rows, key=lambda r: (repr([x for x in r if not isinstance(x, float)]),
                                             [round(x, 3) for x in r if isinstance(x, float)]))


def _same(a, b):
    """Equal, or numbers apart by one unit of the sixth digit that both engines round to (sums
    in another order may land on the other side of a half)."""
    if isinstance(a, float) and isinstance(b, (int, float)) or isinstance(b, float) and isinstance(a, (int, float)):
        return abs(a - b) <= 1.1e-6 * max(1.0, abs(a))
    return a == b


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_matches_oracle(spark, duck, name):
    got = QUERIES[name](spark, SF_SMALL).toPandas()
    want = duck.execute(ORACLE[name]).df()
    c1, r1 = _rows(got)
    c2, r2 = _rows(want)
    assert c1 == c2
    assert len(r1) == len(r2)
    mism = [(a, b) for a, b in zip(r1, r2) if not all(map(_same, a, b))]
    assert not mism, mism[:3]


def test_every_query_has_a_callable():
    assert set(ORACLE) <= set(QUERIES)
