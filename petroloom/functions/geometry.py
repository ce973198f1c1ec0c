"""Planar poses as column expressions: X = R(theta) x + t."""

from __future__ import annotations

import math

from pyspark.sql import Column, functions as F


def rotate(theta: Column, x: Column, y: Column) -> tuple[Column, Column]:
    c, s = F.cos(theta), F.sin(theta)
    return c * x - s * y, s * x + c * y


def unrotate(theta: Column, x: Column, y: Column) -> tuple[Column, Column]:
    c, s = F.cos(theta), F.sin(theta)
    return c * x + s * y, c * y - s * x


def residual(xi: Column, yi: Column, ti: Column, xj: Column, yj: Column, dx: Column, dy: Column) -> Column:
    """How far j lies from where an edge puts it, seen from i."""
    px, py = rotate(ti, dx, dy)
    return F.hypot(xj - xi - px, yj - yi - py)


def implied(m: tuple[Column, Column, Column], s: tuple[Column, Column, Column], dx: Column, dy: Column, phi: Column) -> tuple[Column, Column, Column]:
    """The transform from a segment's frame to the main frame that one match implies."""
    theta = m[2] + phi - s[2]
    ox, oy = rotate(m[2], dx, dy)
    sx, sy = rotate(theta, s[0], s[1])
    return m[0] + ox - sx, m[1] + oy - sy, theta


def lens_fraction(d: Column, r: float) -> Column:
    """Overlap of two circles of radius r at distance d, as a share of one."""
    area = 2 * r * r * F.acos(d / (2 * r)) - d * 0.5 * F.sqrt(F.greatest(F.lit(4 * r * r) - d * d, F.lit(0.0)))
    return F.when(d >= 2 * r, 0.0).otherwise(area / (math.pi * r * r))


def max_distance(diameter: float, share: float) -> float:
    """The largest distance at which two fields of view still share that much of their area."""
    r, low, high = diameter / 2, 0.0, diameter
    for _ in range(50):
        d = (low + high) / 2
        lens = 2 * r * r * math.acos(d / (2 * r)) - 0.5 * d * math.sqrt(max(4 * r * r - d * d, 0.0))
        low, high = (d, high) if lens / (math.pi * r * r) >= share else (low, d)
    return low


def crop_box(cx: Column, cy: Column, r: Column, width: int, height: int) -> tuple[Column, Column, Column, Column]:
    """The corners of the crop around a circle, within the frame."""
    low = lambda c: F.greatest(F.lit(0), F.floor(c - r).cast("int"))
    high = lambda c, n: F.least(F.lit(n), F.ceil(c + r).cast("int") + 1)
    return low(cx), low(cy), high(cx, width), high(cy, height)


def scaled(p: Column, s: float) -> Column:
    """A pixel's centre under a scale."""
    return (p + 0.5) * F.lit(s) - 0.5


def scales(diameter: Column, work: int = 640, coarse: int = 256) -> tuple[Column, Column, Column, Column]:
    """Working and coarse scale of registration, and the blurs that go with them."""
    fine = F.least(F.lit(1.0), work / diameter)
    rough = F.least(fine, coarse / diameter)
    return fine, rough, F.greatest(F.lit(2.0), diameter * fine / 40), F.greatest(F.lit(1.5), diameter * rough / 40)


def overlap_distance(r: Column, share: Column, steps: int = 50) -> Column:
    """max_distance() for columns: the bisection as a fold."""
    def halve(a: Column, _: Column) -> Column:
        d = (a["low"] + a["high"]) / 2
        area = 2 * r * r * F.acos(d / (2 * r)) - 0.5 * d * F.sqrt(F.greatest(4 * r * r - d * d, F.lit(0.0)))
        enough = area / (math.pi * r * r) >= share
        return F.struct(F.when(enough, d).otherwise(a["low"]).alias("low"), F.when(enough, a["high"]).otherwise(d).alias("high"))

    return F.aggregate(F.sequence(F.lit(1), F.lit(steps)), F.struct(F.lit(0.0).alias("low"), (2 * r).alias("high")), halve, lambda a: a["low"])
