"""Binomial intervals and tests."""

from __future__ import annotations

from math import comb, sqrt

from pyspark.sql import Column
from pyspark.sql import functions as F

Z = 1.96
#: z by confidence level.
LEVELS = {0.80: 1.2816, 0.90: 1.6449, 0.95: 1.96, 0.99: 2.5758}
#: Cases from which a rate may be quoted.
ENOUGH = 20


def z_for(level: float) -> float:
    return LEVELS[min(LEVELS, key=lambda x: abs(x - level))]


def wilson(successes: int, n: int, z: float = Z) -> tuple[float, float]:
    if n <= 0:
        return 0.0, 1.0
    if not 0 <= successes <= n:
        raise ValueError(f"{successes} successes of {n}")
    p, d = successes / n, 1 + z * z / n
    centre, spread = (p + z * z / (2 * n)) / d, z * sqrt(p * (1 - p) / n + z * z / (4 * n * n)) / d
    return max(0.0, min(centre - spread, p)), min(1.0, max(centre + spread, p))


def wilson_columns(successes: Column, n: Column, z: float = Z) -> tuple[Column, Column]:
    """(low, high) as doubles; n of 0 gives (0, 1); successes outside 0..n stop the query."""
    k, m = successes.cast("double"), n.cast("double")
    p, d = k / m, 1 + z * z / m
    centre, spread = (p + z * z / (2 * m)) / d, z * F.sqrt(p * (1 - p) / m + z * z / (4 * m * m)) / d
    fits = F.when((k < 0) | (k > m), F.raise_error(F.lit("more successes than cases")).cast("double"))
    low = F.when(n <= 0, 0.0).otherwise(F.coalesce(fits, F.greatest(F.lit(0.0), F.least(centre - spread, p))))
    return low, F.when(n <= 0, 1.0).otherwise(F.least(F.lit(1.0), F.greatest(centre + spread, p)))


def rate_columns(prefix: str, successes: Column, n: Column, z: float = Z) -> dict[str, Column]:
    low, high = wilson_columns(successes, n, z)
    return {f"{prefix}_successes": successes, f"{prefix}_n": n, f"{prefix}_rate": F.when(n <= 0, 0.0).otherwise(successes.cast("double") / n), f"{prefix}_low": low, f"{prefix}_high": high, f"{prefix}_reportable": n >= ENOUGH}


def distinguishable(a: tuple[float, float], b: tuple[float, float]) -> bool:
    if any(x != x for x in (*a, *b)):
        raise ValueError("a bound is not a number")
    return a[1] < b[0] or b[1] < a[0]


def sign_test(gains: int, losses: int) -> float | None:
    """Two-sided exact p of a paired sign test; None without a discordant pair."""
    n = gains + losses
    return min(1.0, 2 * sum(comb(n, i) for i in range(min(gains, losses) + 1)) / 2**n) if n else None
