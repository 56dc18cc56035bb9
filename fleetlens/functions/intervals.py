"""Confidence intervals as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

Z95 = 1.959963984540054


def wilson_bounds(successes: Column, trials: Column, z: float = Z95) -> tuple[Column, Column]:
    """Wilson's interval; null without trials."""
    n = F.nullif(trials.cast("double"), F.lit(0.0))
    p = successes / n
    middle, half = p + z * z / (2 * n), z * F.sqrt(p * (1 - p) / n + z * z / (4 * n * n))
    scale = 1 + z * z / n
    return F.greatest(F.lit(0.0), (middle - half) / scale), F.least(F.lit(1.0), (middle + half) / scale)
