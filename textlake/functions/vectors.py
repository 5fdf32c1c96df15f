"""Vector column functions: dot product, norm, cosine similarity, and a rounding that matches DuckDB's."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(col: Column | str) -> Column:
    return F.col(col) if isinstance(col, str) else col


def dot(a: Column | str, b: Column | str) -> Column:
    prods = F.zip_with(_c(a), _c(b), lambda x, y: x * y)
    return F.aggregate(prods, F.lit(0.0).cast("double"), lambda acc, x: acc + x)


def sum_squares(a: Column | str) -> Column:
    return F.aggregate(_c(a), F.lit(0.0).cast("double"), lambda acc, x: acc + x * x)


def cosine(a: Column | str, b: Column | str, a_sq: Column | None = None, b_sq: Column | None = None) -> Column:
    """dot / (|a|·|b|); NULL when either vector is zero. Pass precomputed sums of squares to avoid recomputing."""
    sa = a_sq if a_sq is not None else sum_squares(a)
    sb = b_sq if b_sq is not None else sum_squares(b)
    return F.try_divide(dot(a, b), F.sqrt(sa) * F.sqrt(sb))


def round6(x: Column | str) -> Column:
    """Round half away from zero at 6 places on the binary value (DuckDB's ``round(x, 6)``)."""
    v = _c(x)
    return F.signum(v) * F.floor(F.abs(v) * F.lit(1e6) + F.lit(0.5)) / F.lit(1e6)


def np_round6(a):
    """numpy twin of :func:`round6`."""
    import numpy as np

    return np.sign(a) * np.floor(np.abs(a) * 1e6 + 0.5) / 1e6


def round_half_away(x: Column | str, places: int) -> Column:
    """Round half away from zero at ``places`` decimals on the binary value (DuckDB's ``round``)."""
    v = _c(x)
    scale = float(10 ** int(places))
    return F.signum(v) * F.floor(F.abs(v) * F.lit(scale) + F.lit(0.5)) / F.lit(scale)
