"""Euler angles, rotations and tilt as column expressions (radians, z up)."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

GRAVITY = 9.80665


def rotation_matrix(roll: Column, pitch: Column, yaw: Column) -> list[list[Column]]:
    """Platform-to-earth matrix Rz(yaw) Ry(pitch) Rx(roll)."""
    cr, sr, cp, sp, cy, sy = F.cos(roll), F.sin(roll), F.cos(pitch), F.sin(pitch), F.cos(yaw), F.sin(yaw)
    return [[cy * cp, cy * sp * sr - sy * cr, cy * sp * cr + sy * sr],
            [sy * cp, sy * sp * sr + cy * cr, sy * sp * cr - cy * sr],
            [-sp, cp * sr, cp * cr]]


def apply_matrix(m: list[list[Column]], v: list[Column]) -> list[Column]:
    return [row[0] * v[0] + row[1] * v[1] + row[2] * v[2] for row in m]


def multiply(a: list[list[Column]], b) -> list[list[Column]]:
    return [[a[i][0] * b[0][j] + a[i][1] * b[1][j] + a[i][2] * b[2][j] for j in range(3)] for i in range(3)]


def transpose(m):
    return [list(r) for r in zip(*m)]


def euler_angles(m: list[list[Column]]) -> tuple[Column, Column, Column]:
    """Roll, pitch, yaw of a rotation matrix."""
    bounded = F.greatest(F.least(m[2][0], F.lit(1.0)), F.lit(-1.0))
    return F.atan2(m[2][1], m[2][2]), -F.asin(bounded), F.atan2(m[1][0], m[0][0])


def accel_tilt(ax: Column, ay: Column, az: Column) -> tuple[Column, Column]:
    return F.atan2(ay, az), F.atan2(-ax, F.hypot(ay, az))


def euler_rates(roll: Column, pitch: Column, p: Column, q: Column, r: Column) -> list[Column]:
    """Rates of the Euler angles from body rates."""
    s = q * F.sin(roll) + r * F.cos(roll)
    return [p + F.tan(pitch) * s, q * F.cos(roll) - r * F.sin(roll), s / F.cos(pitch)]


def body_rates(roll: Column, pitch: Column, dr: Column, dp: Column, dy: Column) -> list[Column]:
    """Body rates from rates of the Euler angles."""
    return [dr - dy * F.sin(pitch), dp * F.cos(roll) + dy * F.cos(pitch) * F.sin(roll),
            -dp * F.sin(roll) + dy * F.cos(pitch) * F.cos(roll)]


def cross(a: list[Column], b: list[float]) -> list[Column]:
    return [a[1] * b[2] - a[2] * b[1], a[2] * b[0] - a[0] * b[2], a[0] * b[1] - a[1] * b[0]]


def to_platform_frame(ch: dict[str, Column], accel_signs=(1, 1, 1), gyro_signs=(1, 1, 1), attitude_signs=(1, 1, 1),
                      accel_in_g: bool = True, mount_deg=(0.0, 0.0, 0.0)) -> dict[str, Column]:
    """Logger channels to SI units in the platform frame, through the mounting tilt."""
    g = GRAVITY if accel_in_g else 1.0
    acc = [ch[c] * float(s) * g for c, s in zip(("ax", "ay", "az"), accel_signs)]
    gyro = [F.radians(ch[c]) * float(s) for c, s in zip(("gx", "gy", "gz"), gyro_signs)]
    att = [F.radians(ch[c]) * float(s) for c, s in zip(("roll", "pitch", "yaw"), attitude_signs)]
    if any(mount_deg):
        mount = rotation_matrix(*[F.radians(F.lit(float(d))) for d in mount_deg])
        acc, gyro = apply_matrix(mount, acc), apply_matrix(mount, gyro)
        att = list(euler_angles(multiply(rotation_matrix(*att), transpose(mount))))
    names = ("ax", "ay", "az", "p", "q", "r", "roll", "pitch", "yaw")
    return dict(zip(names, [*acc, *gyro, *att]))
