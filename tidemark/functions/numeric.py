"""Numeric expressions: target rule, guarded maths, hash-driven randomness.

Everything here is a Catalyst expression (no Python UDF), so it can run inside
codegen on any executor and gives the same value for the same input everywhere.
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def deadband_target(spread, band: float = 3.0) -> Column:
    """Sign of the spread, 0 when ``abs(spread) <= band`` (inclusive)."""
    s = _c(spread)
    return (F.when(s.isNull(), F.lit(None))
            .when(F.abs(s) <= F.lit(float(band)), F.lit(0))
            .otherwise(F.signum(s).cast("int"))).cast("bigint")


def safe_div(a, b) -> Column:
    """NULL instead of an ANSI divide-by-zero error."""
    return F.try_divide(_c(a), _c(b))


def argmax_array(arr) -> Column:
    """K7: zero-based index of the first maximum of an array."""
    a = _c(arr)
    return (F.array_position(a, F.array_max(a)) - 1).cast("bigint")


def poisson1_quantile(u) -> Column:
    """Inverse CDF of Poisson(1) at ``u`` (exact up to k = 12, mass beyond < 1e-10)."""
    u = _c(u)
    cdf = 0.0
    expr = None
    for k in range(13):
        cdf += math.exp(-1.0) / math.factorial(k)
        cond = u < F.lit(cdf)
        expr = F.when(cond, F.lit(k)) if expr is None else expr.when(cond, F.lit(k))
    return expr.otherwise(F.lit(13)).cast("bigint")


def poisson1_cdf_table() -> list[float]:
    out, cdf = [], 0.0
    for k in range(13):
        cdf += math.exp(-1.0) / math.factorial(k)
        out.append(cdf)
    return out


#: Candidates per draw of a large mean; the chance that none is accepted is below 1e-16.
POISSON_TRIES = 24
#: Means below this are drawn as sums of Poisson(1) draws.
POISSON_SMALL = 10


def log_factorial_sql(k: str) -> str:
    """ln(k!) for k >= 0 as SQL text for any engine: Stirling's series at k + 9, stepped back."""
    x = f"({k} + 9.0)"
    back = " * ".join(f"({k} + {i}.0)" for i in range(1, 9))
    return (f"(({x} - 0.5) * ln{x} - {x} + {0.5 * math.log(2 * math.pi)!r} + 1.0 / (12.0 * {x}) - 1.0 / (360.0 * {x} * {x} * {x})"
            f" + 1.0 / (1260.0 * {x} * {x} * {x} * {x} * {x}) - ln({back}))")


def poisson_try_sql(n: str, u: str, v: str) -> str:
    """One candidate of an exact Poisson(n) draw, n >= 10, from two uniforms: the number, or null if
    it is rejected (transformed rejection with squeeze; the constants are the published ones)."""
    b = f"(0.931e0 + 2.53e0 * sqrt({n}))"
    a = f"(-0.059e0 + 0.02483e0 * {b})"
    us = f"(0.5e0 - abs({u} - 0.5e0))"
    k = f"cast(floor((2e0 * {a} / {us} + {b}) * ({u} - 0.5e0) + {n} + 0.43e0) as double)"
    least = f"(ln({v}) + ln(1.1239e0 + 1.1328e0 / ({b} - 3.4e0)) - ln({a} / ({us} * {us}) + {b}))"
    return (f"CASE WHEN {u} <= 0e0 OR {v} <= 0e0 THEN NULL WHEN {us} >= 0.07e0 AND {v} <= 0.9277e0 - 3.6224e0 / ({b} - 2e0) THEN {k} "
            f"WHEN {k} < 0e0 OR ({us} < 0.013e0 AND {v} > {us}) THEN NULL "
            f"WHEN {least} <= -{n} + {k} * ln({n}) - {log_factorial_sql(k)} THEN {k} END")


def erfc(x) -> Column:
    """Complementary error function, Chebyshev fit (fractional error < 1.2e-7).

    Spark SQL has no ``erf``; this keeps the p-value on the JVM side.
    """
    x = _c(x)
    z = F.abs(x)
    t = F.lit(1.0) / (F.lit(1.0) + F.lit(0.5) * z)
    coeffs = [-1.26551223, 1.00002368, 0.37409196, 0.09678418, -0.18628806,
              0.27886807, -1.13520398, 1.48851587, -0.82215223, 0.17087277]
    poly = F.lit(coeffs[-1])
    for c in reversed(coeffs[:-1]):
        poly = F.lit(c) + t * poly
    ans = t * F.exp(-z * z + poly)
    return F.when(x >= 0, ans).otherwise(F.lit(2.0) - ans)


def erfc_sql(x: str) -> str:
    """The same ``erfc`` as a SQL string (used by DuckDB twins)."""
    coeffs = [-1.26551223, 1.00002368, 0.37409196, 0.09678418, -0.18628806,
              0.27886807, -1.13520398, 1.48851587, -0.82215223, 0.17087277]
    t = f"(1.0 / (1.0 + 0.5 * abs({x})))"
    poly = f"{coeffs[-1]}"
    for c in reversed(coeffs[:-1]):
        poly = f"({c} + {t} * {poly})"
    ans = f"({t} * exp(-abs({x}) * abs({x}) + {poly}))"
    return f"(CASE WHEN {x} >= 0 THEN {ans} ELSE 2.0 - {ans} END)"


def chi2_1_sf(x) -> Column:
    """Survival function of chi-square with one degree of freedom."""
    return erfc(F.sqrt(_c(x) / F.lit(2.0)))


# ---------------------------------------------------------------- integer mixing hash
# Murmur3 32-bit finalizer built from BIGINT operations that cannot overflow (the
# 32x32-bit product is split into 16-bit halves), so ANSI mode never trips and the
# same function is expressible in any SQL engine with bit operators.
_M32 = 0xFFFFFFFF
_C1, _C2, _GOLD = 0x85EBCA6B, 0xC2B2AE35, 0x9E3779B1


def _mulmod32(x: Column, c: int) -> Column:
    lo, hi = c & 0xFFFF, c >> 16
    part_hi = F.shiftleft((x * F.lit(hi)).bitwiseAND(F.lit(0xFFFF)), 16)
    return (x * F.lit(lo) + part_hi).bitwiseAND(F.lit(_M32))


def _fmix_steps(src: str, prefix: str) -> list[tuple[str, Column]]:
    """The finalizer as one column per step, the last of which holds the mixed number."""
    steps = []
    for i, step in enumerate(("x16", "m1", "x13", "m2", "x16")):
        c = F.col(src)
        if step.startswith("x"):
            expr = c.bitwiseXOR(F.shiftright(c, int(step[1:])))
        else:
            expr = _mulmod32(c, _C1 if step == "m1" else _C2)
        src = f"{prefix}{i}"
        steps.append((src, expr))
    return steps


def _key_steps(key: str) -> list[tuple[str, Column]]:
    k = F.col(key).cast("bigint")
    folded = k.bitwiseAND(F.lit(_M32)).bitwiseXOR(F.shiftright(k, 32).bitwiseAND(F.lit(_M32)))
    return [("_mk", folded), *_fmix_steps("_mk", "_mk")]


def _draw_steps(mixed: str, seed: int, rep: str) -> list[tuple[str, Column]]:
    r = _mulmod32(F.col(rep).cast("bigint").bitwiseAND(F.lit(_M32)), _GOLD)
    start = (F.col(mixed) + r + F.lit(int(seed) & _M32)).bitwiseAND(F.lit(_M32))
    return [("_md", start), *_fmix_steps("_md", "_md")]


def _with_steps(df, steps: list[tuple[str, Column]], out: str, last: Column):
    for name, expr in steps:
        df = df.withColumn(name, expr)
    return df.withColumn(out, last).drop(*[name for name, _ in steps])


def with_mix_uniform(df, out: str, seed: int, rep: str, key: str):
    """Add ``out`` = deterministic U[0,1) from (seed, replicate, key), integer ops only.

    Each mixing step is its own column: a step reads its input twice, and as one
    nested expression the tree would double per step."""
    steps = _key_steps(key)
    steps = steps + _draw_steps(steps[-1][0], seed, rep)
    return _with_steps(df, steps, out, F.col(steps[-1][0]).cast("double") / F.lit(4294967296.0))


def with_mixed_key(df, out: str, key: str):
    """The part of ``with_mix_uniform`` that depends on the key alone, for keys drawn for many replicates."""
    steps = _key_steps(key)
    return _with_steps(df, steps, out, F.col(steps[-1][0]))


def with_mixed_uniform(df, out: str, seed: int, rep: str, mixed: str):
    """``with_mix_uniform`` from a column of ``with_mixed_key``."""
    steps = _draw_steps(mixed, seed, rep)
    return _with_steps(df, steps, out, F.col(steps[-1][0]).cast("double") / F.lit(4294967296.0))


def _mulmod32_sql(x: str, c: int) -> str:
    lo, hi = c & 0xFFFF, c >> 16
    return f"(((({x}) * {lo}) + (((({x}) * {hi}) & 65535) << 16)) & {_M32})"


def _fmix32_sql(h: str) -> str:
    h = f"xor({h}, (({h}) >> 16))"
    h = _mulmod32_sql(h, _C1)
    h = f"xor({h}, (({h}) >> 13))"
    h = _mulmod32_sql(h, _C2)
    return f"xor({h}, (({h}) >> 16))"


def mix_uniform_sql(seed: int, rep: str, key: str) -> str:
    """The same ``mix_uniform`` as DuckDB SQL text."""
    k = f"CAST({key} AS BIGINT)"
    k32 = f"xor(({k} & {_M32}), (({k} >> 32) & {_M32}))"
    a = _fmix32_sql(k32)
    r = _mulmod32_sql(f"(CAST({rep} AS BIGINT) & {_M32})", _GOLD)
    b = _fmix32_sql(f"((({a}) + ({r}) + {int(seed) & _M32}) & {_M32})")
    return f"(CAST({b} AS DOUBLE) / 4294967296.0)"
