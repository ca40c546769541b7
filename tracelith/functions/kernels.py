"""Plausibility kernels as Column expressions. Null is missing; no kernel sees NaN."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

# Physical limits the checks use (metres, seconds, metres a second, degrees).
MAX_RANGE, MAX_SPEED, MAX_ACCEL, MAX_DECEL = 420.0, 40.0, 3.0, 4.5
MAX_BEACON_GAP, MIN_BEACON_GAP, MAX_CONSISTENCY_GAP, MAX_HEADING_GAP, MAX_APPEAR_GAP = 3.1, 0.9, 3.1, 1.1, 2.1
HEADING_LIMIT, POSITION_SLACK, SPEED_SLACK, EPS = 90.0, 2.1, 4.0, 1e-3
VEHICLE_WIDTH, VEHICLE_LENGTH = 2.0, 5.0


def clamp(v: Column, lo: float, hi: float) -> Column:
    """v kept in lo..hi; null stays null."""
    return F.when(v.isNotNull(), F.greatest(F.lit(lo), F.least(F.lit(hi), v)))


def norm(x: Column, y: Column) -> Column:
    return F.sqrt(x * x + y * y)


def distance(ax: Column, ay: Column, bx: Column, by: Column) -> Column:
    return norm(ax - bx, ay - by)


def heading(x: Column, y: Column) -> Column:
    return F.degrees(F.atan2(y, x))


def angle_difference(a: Column, b: Column) -> Column:
    """Degrees between two directions, 0 to 180."""
    d = F.pmod(F.abs(a - b), F.lit(360.0))
    return F.when(d > 180, 360 - d).otherwise(d)


def signed_angle(a: Column) -> Column:
    """Radians brought into (-pi, pi]."""
    return a - 2 * math.pi * F.ceil((a - math.pi) / (2 * math.pi))


def confidence(nx: Column, ny: Column, eps: float = EPS) -> Column:
    return F.greatest(norm(F.coalesce(nx, F.lit(0.0)), F.coalesce(ny, F.lit(0.0))), F.lit(eps))


def soft_score(v: Column, bound: Column | float, tol: Column | float) -> Column:
    """1 up to bound - tol, 0 from bound + tol on, linear between; 0.5 at the bound."""
    b = bound if isinstance(bound, Column) else F.lit(bound)
    t = F.greatest(tol if isinstance(tol, Column) else F.lit(tol), F.lit(1e-9))
    return F.when(v.isNull() | b.isNull(), None).when(v <= b - t, 1.0).when(v >= b + t, 0.0).otherwise((b + t - v) / (2 * t))


def lens_area(d: Column, r: Column, s: Column) -> Column:
    """Area common to circles of radius r and s whose centres are d apart; 0 if a radius is not above 0."""
    unit = lambda c: F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), c)))
    safe = F.greatest(d, F.lit(1e-12))
    alpha, beta = unit(F.try_divide(safe * safe + r * r - s * s, 2 * safe * r)), unit(F.try_divide(safe * safe + s * s - r * r, 2 * safe * s))
    root = F.sqrt(F.greatest(F.lit(0.0), (-safe + r + s) * (safe + r - s) * (safe - r + s) * (safe + r + s)))
    small = F.least(r, s)
    return F.when((r <= 0) | (s <= 0) | (d >= r + s), 0.0).when(d <= F.abs(r - s), math.pi * small * small).otherwise(r * r * alpha + s * s * beta - 0.5 * root)


def range_score(d: Column, conf: Column) -> Column:
    return soft_score(d, MAX_RANGE, conf)


def speed_score(v: Column, conf: Column) -> Column:
    """The sign of v and of the confidence doesn't matter; a confidence of 0 makes a step."""
    v, conf = F.abs(v), F.greatest(F.abs(conf), F.lit(1e-9))
    half = conf / 2
    return F.when(v.isNull() | conf.isNull(), None).when(v + half < MAX_SPEED, 1.0).when(v - half > MAX_SPEED, 0.0).otherwise(clamp((half + (MAX_SPEED - v)) / conf, 0.0, 1.0))


def position_score(d: Column, dt: Column, conf: Column) -> Column:
    return F.when(dt > 0, soft_score(d, MAX_SPEED * dt, conf))


def speed_change_score(v: Column, v0: Column, dt: Column, conf: Column) -> Column:
    bound = F.when(v - v0 > 0, MAX_ACCEL).otherwise(MAX_DECEL) * dt
    return F.when(dt > 0, soft_score(F.abs(v - v0), bound, conf))


def position_speed_score(d: Column, v: Column, v0: Column, dt: Column, conf: Column) -> Column:
    tol = conf + POSITION_SLACK
    gap = F.abs(d - 0.5 * (v + v0) * dt)
    scale = F.greatest(0.5 * MAX_DECEL * dt * dt + tol, F.lit(1e-6))
    return F.when(dt >= MAX_CONSISTENCY_GAP, 1.0).when(dt > 0, clamp(1 - gap / scale, 0.0, 1.0))


def position_max_speed_score(d: Column, v: Column, v0: Column, dt: Column, conf: Column, speed_conf: Column) -> Column:
    """At most 0.5 below the gap limit: the excess over the bound is never negative."""
    safe = F.when(dt > 0, dt)
    implied = d / safe
    tol = conf / safe + speed_conf + SPEED_SLACK
    up = F.greatest(v, v0) + (MAX_DECEL + SPEED_SLACK) * safe
    down = F.greatest(F.least(v, v0) - (MAX_ACCEL + SPEED_SLACK) * safe, F.lit(0.0))
    zero = F.lit(0.0)
    both = F.least(soft_score(F.greatest(implied - up, zero), 0.0, tol), soft_score(F.greatest(down - implied, zero), 0.0, tol))
    return F.when(dt >= MAX_CONSISTENCY_GAP, 1.0).when(dt > 0, both)


def frequency_score(dt: Column) -> Column:
    return F.when(dt > 0, F.when(dt < MIN_BEACON_GAP, 0.0).otherwise(1.0))


def position_heading_score(d: Column, course: Column, reported: Column, v: Column, dt: Column, speed_conf: Column, heading_conf: Column) -> Column:
    off = angle_difference(course, reported)
    limit = HEADING_LIMIT + heading_conf
    return F.when(dt.isNull() | (dt <= 0), None).when((dt >= MAX_HEADING_GAP) | (d < 1) | (v - speed_conf < 1), 1.0).when(off <= limit, 1.0).otherwise(clamp(1 - (off - limit) / 90.0, 0.0, 1.0))


def appearance_score(d: Column, conf_sender: Column, conf_receiver: Column) -> Column:
    """1 less the sender's share of area inside the receiver's range: near 0 for a first message inside it. In 0..1."""
    reach = MAX_RANGE + conf_receiver
    step = F.when(d < reach, 0.0).when(d >= reach, 1.0)
    area = lens_area(d, conf_sender, reach)
    return F.when(conf_sender <= 0, step).otherwise(clamp(1 - F.try_divide(area, math.pi * conf_sender * conf_sender), 0.0, 1.0))


def proximity_score(d: Column, bearing: Column, neighbour_distances: Column) -> Column:
    angle = F.abs(bearing)
    gate = (d < 30) & ((d < 6) | ((angle < 90) & (d < 3 / F.greatest(F.cos(F.radians(90 - angle)), F.lit(1e-6)))))
    low = F.array_min(neighbour_distances)
    return F.when(d.isNull(), 1.0).when(~gate, 1.0).when(F.size(neighbour_distances) == 0, 0.0).when(low < 4, 1 - low / 4).otherwise(0.0)


def overlap_score(d: Column, conf_a: Column, conf_b: Column) -> Column:
    base = 0.5 * math.hypot(VEHICLE_WIDTH, VEHICLE_LENGTH)
    reach = 2 * base + conf_a + conf_b
    return F.when(d.isNull(), 1.0).otherwise(clamp(1 - F.greatest(F.lit(0.0), reach - d) / reach, 0.0, 1.0))


def regime(attack_type: Column) -> Column:
    """Traffic regime by the hours that end an attack type's name."""
    return F.when(attack_type.endswith("0709"), "peak").when(attack_type.endswith("1416"), "off_peak").otherwise("unknown")


def family(name: Column, families: list[str], other: str = "other") -> Column:
    """The first of families that occurs in the name, case aside."""
    out = F.lit(other)
    for f in reversed(families):
        out = F.when(F.contains(F.lower(name), F.lit(f.lower())), f).otherwise(out)
    return out


def ratio(a: Column, b: Column, empty: float | None = None) -> Column:
    return F.when(b > 0, a / b).otherwise(F.lit(empty).cast("double"))
