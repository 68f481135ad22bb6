"""Wind direction, sectors and rotation as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# fixed values: maker codes of the axis conventions
CAMPBELL, RMYOUNG, GILL = 1, 0, 2

# fixed values: 16-point compass labels
COMPASS = ("N NNE NE ENE E ESE SE SSE S SSW SW WSW W WNW NW NNW").split()


def sonic_axes(u: Column, v: Column, maker: Column) -> tuple[Column, Column]:
    """Horizontal components in the common axis convention."""
    return (F.when(maker == RMYOUNG, v).when(maker == GILL, -u).otherwise(u),
            F.when(maker == RMYOUNG, -u).when(maker == GILL, -v).otherwise(v))


def wrap360(deg: Column) -> Column:
    return F.pmod(deg, F.lit(360.0))


def direction_speed(u: Column, v: Column, bearing: Column) -> tuple[Column, Column]:
    """Direction the wind comes from (deg from north) and speed."""
    ok = u.isNotNull() & v.isNotNull()
    return F.when(ok, wrap360(F.degrees(F.atan2(-v, u)) + bearing)), F.when(ok, F.hypot(u, v))


def compass_label(bearing: Column) -> Column:
    """16-point label, half-even rounding; empty for a missing bearing."""
    point = F.pmod(F.bround(F.pmod(bearing, F.lit(360.0)) / 22.5).cast("int"), F.lit(16))
    label = F.element_at(F.array(*[F.lit(c) for c in COMPASS]), point + 1)
    return F.when(bearing.isNull(), "").otherwise(label)


def angular_separation(d: Column, centre: Column) -> Column:
    return F.abs(F.pmod(d - centre + 180.0, F.lit(360.0)) - 180.0)


def in_direction_window(d: Column, centre: float, half_width: float) -> Column:
    """Within the closed window around *centre*; a missing direction is outside."""
    return F.coalesce(angular_separation(d, F.lit(centre)) <= half_width + 1e-9, F.lit(False))


def shadow_sector(tower_bearing: Column, sonic_bearing: Column, envelope: Column) -> tuple[Column, Column]:
    """Lower and upper bound of the tower-shadow sector; lower > upper when it wraps."""
    centre = wrap360(tower_bearing + sonic_bearing)
    return wrap360(centre - envelope), F.when(centre + envelope > 360.0, centre + envelope - 360.0).otherwise(
        centre + envelope)


def shadow_flag(d: Column, lo: Column, hi: Column) -> Column:
    """Strictly inside the (possibly wrapping) sector."""
    return F.coalesce(F.when(lo > hi, (d > lo) | (d < hi)).otherwise((d > lo) & (d < hi)), F.lit(False))


def in_sector(d: Column, lo: Column, hi: Column) -> Column:
    """``(lo, hi]``, wrapping through north; equal bounds accept every direction.

    The same half-open rule serves fitting and application, so a direction on
    an edge is rotated by the sector it was fitted in.
    """
    return (F.when(lo == hi, F.lit(True)).when(hi > lo, (d > lo) & (d <= hi))
            .otherwise((d > lo) | (d <= hi)))


def planar_fit_rotate(u: Column, v: Column, w: Column, b0: Column, b1: Column, b2: Column
                      ) -> tuple[Column, Column, Column]:
    """Winds in the fitted plane w = b0 + b1 u + b2 v (Wilczak et al. 2001, eqs. 35-44)."""
    norm = F.sqrt(b1 * b1 + b2 * b2 + 1.0)
    p31, p32, p33 = -b1 / norm, -b2 / norm, 1.0 / norm
    cos_a = F.sqrt(p32 * p32 + p33 * p33)
    sin_a, sin_b, cos_b = p31, -p32 / cos_a, p33 / cos_a
    # roll by beta about x first, then pitch by alpha about y
    v1 = cos_b * v + sin_b * (w - b0)
    w1 = -sin_b * v + cos_b * (w - b0)
    # a sample lacking any component has no rotated wind
    return cos_a * u - sin_a * w1, F.when(u.isNotNull(), v1), sin_a * u + cos_a * w1


def yaw_rotate(u: Column, v: Column, mean_u: Column, mean_v: Column) -> tuple[Column, Column]:
    """Horizontal winds in the mean-wind frame; unchanged where the mean wind is zero."""
    speed = F.hypot(mean_u, mean_v)
    cos, sin = mean_u / speed, mean_v / speed
    still = speed == 0
    return (F.when(still, u).otherwise(cos * u + sin * v), F.when(still, v).otherwise(cos * v - sin * u))


def slope_angles(direction: Column, slope: float, aspect: float) -> tuple[Column, Column]:
    """Angles (deg) between the slope-normal axes and the vertical."""
    rel = F.radians(direction - aspect)
    steep = F.sin(F.radians(F.lit(slope)))
    return F.degrees(F.asin(F.cos(rel) * steep)), F.degrees(F.asin(F.sin(rel) * steep))
