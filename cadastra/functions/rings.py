"""Closed rings out of ways, holes into shells."""

from __future__ import annotations

import numpy as np

from cadastra.functions.geometry import point_in_ring, ring_area


def is_closed(way: list[tuple[float, float]]) -> bool:
    return len(way) >= 4 and way[0] == way[-1]


def stitch(ways: list[list[tuple[float, float]]]) -> tuple[list[np.ndarray], int]:
    """Rings made of the ways joined at their ends, and how many chains of ways stay open; those make no ring."""
    ends: dict[tuple[float, float], set[int]] = {}
    for k, way in enumerate(ways):
        if len(way) > 1:
            for end in {way[0], way[-1]}:
                ends.setdefault(end, set()).add(k)
    rings, open_, used = [], 0, set()
    for k, way in enumerate(ways):
        if len(way) < 2 or k in used:
            continue
        used.add(k)
        chain = list(way)
        for _ in range(2):  # from the last point on, then from the first
            while chain[0] != chain[-1] and (free := sorted(ends[chain[-1]] - used)):
                used.add(free[0])
                more = ways[free[0]]
                chain += (more if more[0] == chain[-1] else more[::-1])[1:]
            chain.reverse()
        if chain[0] != chain[-1]:
            open_ += 1
        elif len(chain) >= 4:
            rings.append(np.array(chain[:-1], float))
    return rings, open_


def polygons(outer: list[np.ndarray], inner: list[np.ndarray]) -> list[list[np.ndarray]]:
    """Each hole goes to the smallest shell around it; a hole in no shell is left out."""
    out = [[r] for r in outer]
    by_size = sorted(out, key=lambda p: abs(ring_area(p[0])))
    for hole in inner:
        home = next((p for p in by_size if point_in_ring(*hole[0], p[0]) or point_in_ring(*hole.mean(0), p[0])), None)
        if home is not None:
            home.append(hole)
    return out
