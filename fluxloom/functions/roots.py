"""Real roots of depressed cubics as column expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column, functions as F


def real_roots(p: Column, q: Column) -> Column:
    """Array of the real roots of x^3 + p x + q = 0: Cardano's form for one, Viete's for three."""
    disc = q * q / 4.0 + p * p * p / 27.0
    root = F.sqrt(F.greatest(disc, F.lit(0.0)))
    single = F.array(F.cbrt(-q / 2.0 + root) + F.cbrt(-q / 2.0 - root))
    size = F.sqrt(F.greatest(-p / 3.0, F.lit(0.0)))
    cosine = F.try_divide(-q / 2.0, size * size * size)
    angle = F.acos(F.greatest(F.least(cosine, F.lit(1.0)), F.lit(-1.0))) / 3.0
    triple = F.array(*[2.0 * size * F.cos(angle - 2.0 * math.pi * k / 3.0) for k in range(3)])
    return F.when(disc > 0, single).when(disc <= 0, triple)
