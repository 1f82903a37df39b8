"""Small-graph and list algorithms that run on the driver."""

from __future__ import annotations

import heapq
import math


def shortest_path(edges: list[tuple], start, goal, avoid: frozenset = frozenset()) -> tuple[float, list] | None:
    """Dijkstra over undirected edges (a, b, weight, kind); kinds to avoid are left out."""
    near: dict = {}
    for a, b, weight, kind in edges:
        if kind not in avoid:
            near.setdefault(a, []).append((b, weight))
            near.setdefault(b, []).append((a, weight))
    best, back, queue = {start: 0.0}, {}, [(0.0, 0, start)]
    n = 0
    while queue:
        d, _, at = heapq.heappop(queue)
        if at == goal:
            path = [at]
            while path[-1] != start:
                path.append(back[path[-1]])
            return d, path[::-1]
        if d > best[at]:
            continue
        for to, weight in near.get(at, ()):
            if d + weight < best.get(to, math.inf):
                best[to], back[to] = d + weight, at
                n += 1
                heapq.heappush(queue, (d + weight, n, to))
    return None


def spaced(ranked: list[tuple], count: int, apart: float) -> list[tuple]:
    """Of (x, y, ...) in rank order the first count that keep their distance from those already taken."""
    out: list[tuple] = []
    for row in ranked:
        if len(out) == count:
            break
        if all(math.hypot(row[0] - o[0], row[1] - o[1]) >= apart for o in out):
            out.append(row)
    return out


def pick_lod(lods: list[dict], zoom: float) -> dict | None:
    """The level of detail whose zoom range [min, max) holds zoom; the highest minimum wins."""
    fit = [x for x in lods if x["min"] <= zoom < x["max"]]
    return max(fit, key=lambda x: x["min"]) if fit else None


def overlapping(lods: list[dict]) -> list[tuple]:
    """Pairs of names whose zoom ranges overlap."""
    return [(a["name"], b["name"]) for i, a in enumerate(lods) for b in lods[i + 1 :] if a["min"] < b["max"] and b["min"] < a["max"]]
