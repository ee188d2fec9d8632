"""Interval, agreement and rate expressions. An undefined rate is 0 where precision and recall are, else null."""

from __future__ import annotations

from statistics import NormalDist

from pyspark.sql import Column
from pyspark.sql import functions as F


def z_of(ci: float = 0.95) -> float:
    return NormalDist().inv_cdf(0.5 + ci / 2)


def rate(k: Column, n: Column) -> Column:
    return F.try_divide(k.cast("double"), n.cast("double"))


def wilson(k: Column, n: Column, ci: float = 0.95) -> tuple[Column, Column]:
    """Lower and upper Wilson bounds of k of n, not clipped; null for n = 0."""
    z = F.lit(z_of(ci))
    n, p = n.cast("double"), rate(k, n)
    scale = F.lit(1.0) + z * z / F.nullif(n, F.lit(0.0))
    centre = p + z * z / (F.lit(2.0) * F.nullif(n, F.lit(0.0)))
    half = z * F.sqrt(p * (F.lit(1.0) - p) / F.nullif(n, F.lit(0.0)) + z * z / (F.lit(4.0) * F.nullif(n, F.lit(0.0)) * n))
    return (centre - half) / scale, (centre + half) / scale


def newcombe(k1: Column, n1: Column, k2: Column, n2: Column, ci: float = 0.95) -> tuple[Column, Column]:
    """Bounds of the difference of two rates from their Wilson bounds."""
    p1, p2 = rate(k1, n1), rate(k2, n2)
    (l1, u1), (l2, u2) = wilson(k1, n1, ci), wilson(k2, n2, ci)
    d = p1 - p2
    return d - F.sqrt((p1 - l1) * (p1 - l1) + (u2 - p2) * (u2 - p2)), d + F.sqrt((u1 - p1) * (u1 - p1) + (p2 - l2) * (p2 - l2))


_Z = "1.959963984540054e0"


def wilson_sql(k: str, n: str) -> tuple[str, str]:
    """The same bounds as SQL text for doubles k and n > 0."""
    p = f"({k} / {n})"
    half = f"{_Z} * sqrt({p} * (1e0 - {p}) / {n} + {_Z} * {_Z} / (4e0 * {n} * {n}))"
    centre, scale = f"({p} + {_Z} * {_Z} / (2e0 * {n}))", f"(1e0 + {_Z} * {_Z} / {n})"
    return f"(({centre} - {half}) / {scale})", f"(({centre} + {half}) / {scale})"
