"""Flux quality classes."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def steady_state_class(ss: Column, itc: Column | None = None) -> Column:
    """0 / 1 / 2 with strict limits 30 and 100; a missing statistic gives 2."""
    worst = ss if itc is None else F.when(itc.isNotNull() & ss.isNotNull(), F.greatest(ss, itc))
    return F.coalesce(F.when(worst < 30, 0).when(worst < 100, 1), F.lit(2))


def forced(cls: Column, *flags: Column) -> Column:
    """Class 2 wherever a flag is raised."""
    raised = F.lit(False)
    for f in flags:
        raised = raised | F.coalesce(f, F.lit(False))
    return F.when(raised, 2).otherwise(cls)


def three_class(stat: Column, edges=(30.0, 100.0)) -> Column:
    """1 / 2 / 3 with closed edges; a missing statistic gives 0."""
    return F.coalesce(F.when(stat <= edges[0], 1).when(stat <= edges[1], 2).when(stat > edges[1], 3), F.lit(0))


def deviation_percent(sub_mean: Column, total: Column) -> Column:
    return F.when(F.abs(total) > 2.220446049250313e-16, F.abs((sub_mean - total) / total) * 100.0)


def itc_cubic_root_model(zeta: Column) -> Column:
    """Reference sigma_w/u* of the second flag family."""
    return F.when(zeta < 0, 1.25 * F.pow(1.0 - 3.0 * zeta, F.lit(1.0 / 3.0))).when(zeta >= 0, F.lit(1.25))
