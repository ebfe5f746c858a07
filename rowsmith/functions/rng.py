"""Seeded, partition-independent random draws as Column expressions.

``F.rand(seed)`` depends on the partition layout, so a recomputed or re-split
partition would draw different numbers. Every draw here is a pure function of
(seed, table, column, row key): a lost executor recomputes the same values, and
any partition count gives the same table.

Two hash modes:

* ``portable``: 13 hex digits (52 bits) of ``md5(seed|table|column|key)``. DuckDB
  computes the same doubles, so generated columns can be checked value by value.
  One md5 yields two independent draws (hex digits 1-13 and 14-26).
* ``fast``: ``xxhash64`` reduced to 52 bits; several times cheaper in the JVM,
  used for bulk generation when no external oracle is involved.
"""

from __future__ import annotations

import math
from functools import lru_cache

import numpy as np
from pyspark.sql import Column, functions as F

TWO52 = float(2 ** 52)
MODES = ("portable", "fast")


def _key(id_col) -> Column:
    return id_col if isinstance(id_col, Column) else F.col(id_col)


def _q(text: str) -> str:
    return "'" + str(text).replace("\\", "\\\\").replace("'", "\\'") + "'"


def _hex_sql(key_sql: str, seed: int, table: str, column: str) -> str:
    return f"md5(concat_ws('|', {_q(seed)}, {_q(table)}, {_q(column)}, cast({key_sql} as string)))"


def hash_hex(id_col, seed: int, table: str, column: str) -> Column:
    """md5 hex digest of ``seed|table|column|key`` (32 hex characters)."""
    if isinstance(id_col, str):       # a column name: the whole expression in one JVM call
        return F.expr(_hex_sql(f"`{id_col}`", seed, table, column))
    return F.md5(F.concat_ws("|", F.lit(str(seed)), F.lit(table), F.lit(column),
                             _key(id_col).cast("string")))


def uniform_bits(id_col, seed: int, table: str, column: str, draw: int = 0,
                 mode: str = "portable") -> Column:
    """Integer in [0, 2^52) for draw ``draw`` (0 or 1 in portable mode).
    ``id_col`` may be a column name (built in one JVM call) or a Column."""
    if mode == "portable":
        if draw not in (0, 1):
            raise ValueError("portable mode gives draws 0 and 1 per tag; use another tag")
        if isinstance(id_col, str):
            h = _hex_sql(f"`{id_col}`", seed, table, column)
            return F.expr(f"cast(conv(substring({h}, {1 + 13 * draw}, 13), 16, 10) as bigint)")
        hexpart = F.substring(hash_hex(id_col, seed, table, column), 1 + 13 * draw, 13)
        return F.conv(hexpart, 16, 10).cast("long")
    if mode == "fast":
        if isinstance(id_col, str):
            return F.expr(f"pmod(xxhash64({int(seed)}, {_q(table)}, {_q(column)}, {int(draw)}, `{id_col}`), "
                          f"{2 ** 52}L)")
        h = F.xxhash64(F.lit(seed), F.lit(table), F.lit(column), F.lit(draw), _key(id_col))
        return F.pmod(h, F.lit(2 ** 52))
    raise ValueError(f"unknown rng mode {mode!r}")


def uniform(id_col, seed: int, table: str, column: str, draw: int = 0,
            mode: str = "portable") -> Column:
    """Uniform double in [0, 1)."""
    return uniform_bits(id_col, seed, table, column, draw, mode) / F.lit(TWO52)


def uniform_open(id_col, seed: int, table: str, column: str, draw: int = 0,
                 mode: str = "portable") -> Column:
    """Uniform double in (0, 1]; safe under ``log``."""
    return (uniform_bits(id_col, seed, table, column, draw, mode) + F.lit(1)) / F.lit(TWO52)


def standard_normal(id_col, seed: int, table: str, column: str, mode: str = "portable") -> Column:
    """Box-Muller normal from the two draws of one hash."""
    u1 = uniform_open(id_col, seed, table, column, 0, mode)
    u2 = uniform(id_col, seed, table, column, 1, mode)
    return F.sqrt(F.lit(-2.0) * F.log(u1)) * F.cos(F.lit(2.0 * math.pi) * u2)


def sql_literal(v) -> str:
    """Spark SQL text of a constant: doubles as ``<repr>D`` (exact round trip)."""
    if isinstance(v, bool):
        return "true" if v else "false"
    if isinstance(v, int):
        return f"{v}L"
    if isinstance(v, float):
        return f"{v!r}D" if math.isfinite(v) else f"double('{v}')"
    return "'" + str(v).replace("\\", "\\\\").replace("'", "\\'") + "'"


@lru_cache(maxsize=256)
def _const_array_sql(values: tuple) -> str:
    return "array(" + ", ".join(sql_literal(v) for v in values) + ")"


def const_array(values) -> Column:
    """A constant array built in one JVM call (not one call per element)."""
    return F.expr(_const_array_sql(tuple(values)))


def pick(u: Column, values) -> Column:
    """Element ``1 + floor(u * k)`` of a constant list (uniform categorical choice)."""
    vals = tuple(values)
    return F.element_at(const_array(vals), (F.floor(u * F.lit(len(vals))) + F.lit(1)).cast("int"))


# ---------------------------------------------------------------------------
# Poisson by inverse CDF over a constant table.

@lru_cache(maxsize=64)
def poisson_cdf(lam: float, tail: float = 1e-16) -> tuple:
    """CDF values P(X <= k) for k = 0.. until the remaining mass is below ``tail``."""
    pmf = math.exp(-lam)
    cdf = pmf
    out = [cdf]
    k = 0
    while 1.0 - cdf > tail and k < 10_000:
        k += 1
        pmf *= lam / k
        cdf += pmf
        out.append(min(cdf, 1.0))
    return tuple(out)


def poisson_search_sql(u_sql: str, lam: float) -> str:
    """Nested CASE WHEN text: a balanced search of ``u`` over the constant CDF table."""
    cdf = poisson_cdf(float(lam))

    def search(lo: int, hi: int) -> str:            # answer known to lie in [lo, hi]
        if lo == hi:
            return str(lo)
        mid = (lo + hi + 1) // 2                    # is CDF entry mid-1 <= u ?
        return f"CASE WHEN {u_sql} >= {sql_literal(cdf[mid - 1])} THEN {search(mid, hi)} ELSE {search(lo, mid - 1)} END"

    return search(0, len(cdf))


def poisson(u: Column | str, lam: float) -> Column:
    """Smallest k with CDF(k) > u, i.e. the number of CDF entries <= u.

    A balanced search over the constant CDF table written as nested CASE WHEN:
    about log2(len) comparisons per row, exact, and small generated code (codegen
    splits the branches), so the JIT compiles it. ``u`` may be a column name (the
    whole tree is then built in one JVM call) or a Column."""
    if isinstance(u, str):
        return F.expr(poisson_search_sql(f"`{u}`", lam))
    cdf = poisson_cdf(float(lam))

    def search(lo: int, hi: int) -> Column:
        if lo == hi:
            return F.lit(lo)
        mid = (lo + hi + 1) // 2
        return F.when(u >= F.lit(cdf[mid - 1]), search(mid, hi)).otherwise(search(lo, mid - 1))

    return search(0, len(cdf))


# ---------------------------------------------------------------------------
# Beta by a quantile table with linear interpolation.

BETA_POINTS = 1024


@lru_cache(maxsize=16)
def beta_quantiles(a: float, b: float, points: int = BETA_POINTS) -> tuple:
    """Quantiles of Beta(a, b) at p = i/points, i = 0..points.

    The CDF is integrated numerically on a grid and inverted by interpolation; two Newton steps with
    Gauss-Legendre integrals then make the values exact to about 1e-15 (no SciPy needed), so
    that rounding a scaled draw to 4 digits does not depend on the table."""
    grid = 1 << 16
    x = np.linspace(0.0, 1.0, grid + 1)
    cdf = np.concatenate([[0.0], np.cumsum((x[:-1] + x[1:]) ** (a - 1) * (2 - x[:-1] - x[1:]) ** (b - 1))])
    p = np.arange(points + 1) / points
    q = np.interp(p, cdf / cdf[-1], x)[1:-1]
    whole = math.exp(math.lgamma(a) + math.lgamma(b) - math.lgamma(a + b))
    for _ in range(2):
        below = np.where(q <= 0.5, _beta_integral(q, a, b) / whole, 1.0 - _beta_integral(1.0 - q, b, a) / whole)
        q = q - (below - p[1:-1]) * whole / (q ** (a - 1) * (1.0 - q) ** (b - 1))
    return (0.0, *[float(v) for v in q], 1.0)


def _beta_integral(x: np.ndarray, a: float, b: float) -> np.ndarray:
    """Integral of t^(a-1) (1-t)^(b-1) from 0 to x; t = x s^5 makes the integrand smooth at 0."""
    at, weight = np.polynomial.legendre.leggauss(96)
    s = (at + 1.0) / 2.0
    inner = s ** (5.0 * a - 1.0) * (1.0 - x[:, None] * s ** 5) ** (b - 1.0)
    return x ** a * 5.0 * (inner @ weight) / 2.0


def beta(u: Column, a: float, b: float) -> Column:
    q = beta_quantiles(float(a), float(b))
    n = len(q) - 1
    arr = const_array(q)
    pos = u * F.lit(float(n))
    i = F.least(F.floor(pos).cast("int"), F.lit(n - 1))
    lo = F.element_at(arr, i + 1)
    hi = F.element_at(arr, i + 2)
    return lo + (pos - i) * (hi - lo)
