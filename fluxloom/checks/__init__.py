"""Checked queries, grouped by operator family."""

from __future__ import annotations

import importlib

FAMILIES = ("periods", "joins", "sequence", "qc", "rotation", "thermo", "flux", "lags", "spectral", "coherent", "motion", "compare",
            "sources")


def load_checks():
    """All registered checks by name."""
    from .registry import REGISTRY

    for family in FAMILIES:
        importlib.import_module(f"{__name__}.{family}")
    return REGISTRY
