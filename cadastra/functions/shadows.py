"""Shadows of prisms: sun offsets, pieces, and the dissolved shadow of an area."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

from cadastra.functions.geometry import convex_hull, difference, is_convex, polygon_area, union


def sun_offset(azimuth_deg: float, altitude_deg: float) -> tuple[float, float]:
    """East and north of the shadow's tip per metre of height."""
    az, alt = math.radians(azimuth_deg), math.radians(altitude_deg)
    return -math.sin(az) / math.tan(alt), -math.cos(az) / math.tan(alt)


def sun_offset_columns(azimuth: Column, altitude: Column) -> tuple[Column, Column]:
    az, alt = F.radians(azimuth), F.radians(altitude)
    return -F.sin(az) / F.tan(alt), -F.cos(az) / F.tan(alt)


def shadow_pieces(rings: list[np.ndarray], low: float, high: float, dx: float, dy: float) -> list[list[np.ndarray]]:
    """Polygons whose union is the shadow of a prism from low to high; none where it has no height.

    A convex outline sweeps the hull of its two shifted copies. Any other leaves both copies and one
    parallelogram for each edge that is not parallel to the ray.
    """
    if high <= low or len(rings[0]) < 3:
        return []
    d = np.array([dx, dy])
    if len(rings) == 1 and is_convex(rings[0]):
        return [[convex_hull(np.vstack([rings[0] + d * low, rings[0] + d * high]))]]
    out = [[r + d * h for r in rings] for h in (low, high)]
    for ring in rings:
        for p, q in zip(ring, np.roll(ring, -1, 0)):
            if abs((q - p)[0] * dy - (q - p)[1] * dx) > 1e-12:
                out.append([np.array([p + d * low, q + d * low, q + d * high, p + d * high])])
    return out


def dissolved_shadow(buildings: list[tuple[list[np.ndarray], float, float]], dx: float, dy: float) -> tuple[float, list[np.ndarray]]:
    """Area and trapezoids of all shadows together, without the footprints themselves."""
    pieces = [p for rings, low, high in buildings for p in shadow_pieces(rings, low, high, dx, dy)]
    return difference(pieces, [rings for rings, _, _ in buildings])


def shadow_area(rings: list[np.ndarray], low: float, high: float, dx: float, dy: float) -> float:
    """Area of one prism's shadow on the ground, its own footprint included."""
    return union(shadow_pieces(rings, low, high, dx, dy))[0]


__all__ = ["dissolved_shadow", "polygon_area", "shadow_area", "shadow_pieces", "sun_offset", "sun_offset_columns"]
