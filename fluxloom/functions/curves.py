"""Neutral surface-layer reference curves (Kaimal et al. 1972, z/L = 0)."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def _form(f: Column, a: float, b: float, n: float) -> Column:
    return a * f / F.pow(1.0 + b * f, F.lit(n))


def neutral_curve(f: Column, which: str) -> Column:
    """Normalised density at reduced frequency *f*; *which* of u v w T uw wT uT."""
    if which == "w":
        return 2.0 * f / (1.0 + 5.3 * F.pow(f, F.lit(5 / 3)))
    if which == "T":
        return F.when(f <= 0.15, _form(f, 53.4, 24.0, 5 / 3)).otherwise(_form(f, 24.4, 12.5, 5 / 3))
    if which == "wT":
        return F.when(f <= 1.0, _form(f, 11.0, 13.3, 1.75)).otherwise(_form(f, 4.4, 3.8, 2.4))
    # fixed values: amplitude, slope and exponent per curve
    a, b, n = {"u": (105.0, 33.0, 5 / 3), "v": (17.0, 9.5, 5 / 3), "uw": (14.0, 9.6, 2.4), "uT": (40.0, 14.0, 2.6)}[which]
    return _form(f, a, b, n)
