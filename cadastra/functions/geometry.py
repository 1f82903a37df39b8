"""Planar geometry kernels (numpy) and closed-form column expressions."""

from __future__ import annotations

import math
import struct

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

# The sphere of distances and web tiles.
EARTH_RADIUS_M = 6378137.0
M_PER_DEG = math.pi / 180 * EARTH_RADIUS_M


_GRID_CELLS = 1 << 20


def box_union_area(boxes: np.ndarray) -> float:
    """Area of the union of (n, 4) boxes: how many cover each cell between all x and y, by sums of corners.

    The grid is worked off in slabs of x, so that many boxes take little memory at once.
    """
    if not len(boxes):
        return 0.0
    xs, ys = np.unique(boxes[:, [0, 2]]), np.unique(boxes[:, [1, 3]])
    x0, x1 = np.searchsorted(xs, boxes[:, 0]), np.searchsorted(xs, boxes[:, 2])
    y0, y1 = np.searchsorted(ys, boxes[:, 1]), np.searchsorted(ys, boxes[:, 3])
    slab, total = max(1, _GRID_CELLS // len(ys)), 0.0
    for a in range(0, len(xs) - 1, slab):
        b = min(a + slab, len(xs) - 1)
        here = (x0 < b) & (x1 > a)
        lo, hi = np.maximum(x0[here], a) - a, np.minimum(x1[here], b) - a
        corners = np.zeros((b - a + 1, len(ys)), np.int32)
        for x, y, sign in ((lo, y0[here], 1), (hi, y0[here], -1), (lo, y1[here], -1), (hi, y1[here], 1)):
            np.add.at(corners, (x, y), sign)
        covered = corners.cumsum(0).cumsum(1)[:-1, :-1] > 0
        total += float(np.diff(xs[a : b + 1]) @ (covered @ np.diff(ys)))
    return total


# ---- polygons: lists of rings, a ring an (n, 2) array without the closing point -------------------


def ring_area(ring: np.ndarray) -> float:
    """Signed shoelace area."""
    x, y = ring[:, 0] - ring[0, 0], ring[:, 1] - ring[0, 1]
    return float(np.dot(x, np.roll(y, -1)) - np.dot(y, np.roll(x, -1))) / 2


def ring_centroid(ring: np.ndarray) -> tuple[float, float, float]:
    """(signed area, first moments) of a ring."""
    o = ring[0]
    p, q = ring - o, np.roll(ring - o, -1, 0)
    cross = p[:, 0] * q[:, 1] - q[:, 0] * p[:, 1]
    area = cross.sum() / 2
    mx, my = ((p[:, 0] + q[:, 0]) * cross).sum() / 6, ((p[:, 1] + q[:, 1]) * cross).sum() / 6
    return float(area), float(mx + o[0] * area), float(my + o[1] * area)


def polygon_area(polygon: list[np.ndarray]) -> float:
    """Shell minus holes."""
    return abs(ring_area(polygon[0])) - sum(abs(ring_area(r)) for r in polygon[1:])


def polygons_centroid(polygons: list[list[np.ndarray]]) -> tuple[float, float] | None:
    total = mx = my = 0.0
    for polygon in polygons:
        for k, ring in enumerate(polygon):
            a, x, y = ring_centroid(ring)
            s = (1 if k == 0 else -1) * (1 if a >= 0 else -1)
            total, mx, my = total + s * a, mx + s * x, my + s * y
    return (mx / total, my / total) if total > 0 else None


def point_in_ring(x: float, y: float, ring: np.ndarray) -> bool:
    """Ray casting; the boundary may go either way."""
    a, b = ring, np.roll(ring, -1, 0)
    across = (a[:, 1] > y) != (b[:, 1] > y)
    if not across.any():
        return False
    a, b = a[across], b[across]
    return bool(np.count_nonzero(x < (b[:, 0] - a[:, 0]) * (y - a[:, 1]) / (b[:, 1] - a[:, 1]) + a[:, 0]) % 2)


def point_in_polygon(x: float, y: float, polygon: list[np.ndarray]) -> bool:
    return point_in_ring(x, y, polygon[0]) and not any(point_in_ring(x, y, h) for h in polygon[1:])


def point_on_surface(polygon: list[np.ndarray]) -> tuple[float, float]:
    """The middle of the longest inner run on a horizontal line through the middle height."""
    ys = np.unique(np.concatenate(polygon)[:, 1])
    middle = (ys[0] + ys[-1]) / 2
    if len(ys) > 1:  # between vertices, nearest to the middle
        gaps = (ys[:-1] + ys[1:]) / 2
        y = float(gaps[np.argmin(np.abs(gaps - middle))])
    else:
        y = float(middle)
    xs = []
    for ring in polygon:
        a, b = ring, np.roll(ring, -1, 0)
        hit = (a[:, 1] > y) != (b[:, 1] > y)
        a, b = a[hit], b[hit]
        xs += ((b[:, 0] - a[:, 0]) * (y - a[:, 1]) / (b[:, 1] - a[:, 1]) + a[:, 0]).tolist()
    xs.sort()
    runs = [(xs[i + 1] - xs[i], (xs[i] + xs[i + 1]) / 2) for i in range(0, len(xs) - 1, 2)]
    return (max(runs)[1], y) if runs else (float(polygon[0][0, 0]), float(polygon[0][0, 1]))


def _edges(polygons: list[list[np.ndarray]]) -> np.ndarray:
    """(n, 5): x0, y0, x1, y1 left to right, and the direction they had. Shells turn left, holes right."""
    rows = []
    for polygon in polygons:
        for k, ring in enumerate(polygon):
            if len(ring) < 3:
                continue
            if (ring_area(ring) < 0) != (k > 0):
                ring = ring[::-1]
            a, b = ring, np.roll(ring, -1, 0)
            ahead = a[:, 0] < b[:, 0]
            keep = a[:, 0] != b[:, 0]
            left, right = np.where(ahead[:, None], a, b), np.where(ahead[:, None], b, a)
            rows.append(np.column_stack([left, right, np.where(ahead, 1, -1)])[keep])
    return np.concatenate(rows) if rows else np.zeros((0, 5))


def overlay(a: list[list[np.ndarray]], b: list[list[np.ndarray]], keep) -> tuple[float, list[np.ndarray]]:
    """Area and trapezoids of the places where keep(inside a, inside b) holds.

    Slabs lie between the x of all vertices and crossings; within one the edges do not cross, so they are
    ordered by their middle height, and winding numbers tell inside from outside.
    """
    ea, eb = _edges(a), _edges(b)
    e = np.concatenate([ea, eb])
    if not len(e):
        return 0.0, []
    owner = np.r_[np.zeros(len(ea), int), np.ones(len(eb), int)]
    slope = (e[:, 3] - e[:, 1]) / (e[:, 2] - e[:, 0])
    icept = e[:, 1] - slope * e[:, 0]
    xs = set(e[:, 0]) | set(e[:, 2])
    for i in range(len(e)):
        d = slope[i + 1 :] - slope[i]
        with np.errstate(divide="ignore", invalid="ignore"):
            x = (icept[i] - icept[i + 1 :]) / d
        ok = (d != 0) & (x > np.maximum(e[i, 0], e[i + 1 :, 0])) & (x < np.minimum(e[i, 2], e[i + 1 :, 2]))
        xs |= set(x[ok])
    xs, total, parts = np.array(sorted(xs)), 0.0, []
    for x0, x1 in zip(xs, xs[1:]):
        at = np.flatnonzero((e[:, 0] <= x0) & (e[:, 2] >= x1))
        if not len(at):
            continue
        m = (x0 + x1) / 2
        at = at[np.argsort(slope[at] * m + icept[at], kind="stable")]
        wind, start = [0, 0], None
        for i in at:
            was = keep(wind[0] != 0, wind[1] != 0)
            wind[owner[i]] += int(e[i, 4])
            now = keep(wind[0] != 0, wind[1] != 0)
            if now and not was:
                start = i
            elif was and not now and start is not None:
                lo0, lo1 = slope[start] * x0 + icept[start], slope[start] * x1 + icept[start]
                hi0, hi1 = slope[i] * x0 + icept[i], slope[i] * x1 + icept[i]
                area = ((hi0 - lo0) + (hi1 - lo1)) / 2 * (x1 - x0)
                if area > 0:
                    total += area
                    parts.append(np.array([[x0, lo0], [x1, lo1], [x1, hi1], [x0, hi0]]))
    return total, parts


def intersection(a, b):
    return overlay(a, b, lambda p, q: p and q)


def union(a, b=()):
    return overlay(a, list(b), lambda p, q: p or q)


def difference(a, b):
    return overlay(a, b, lambda p, q: p and not q)


# ---- many pairs at once ---------------------------------------------------------------------------

_RING = struct.Struct("<BIII")
_LANES, _MANY_EDGES = 1 << 17, 128


def edge_lists(wkbs) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The edges, as of _edges, of many WKB geometries one after another, and where each one's start and how many they are.

    Polygons of one ring are read together with those of as many points, all others one by one.
    """
    alike: dict[tuple[int, bytes], list[int]] = {}
    raws = [raw or b"" for raw in wkbs]
    for i, raw in enumerate(raws):
        alike.setdefault((len(raw), bytes(raw[:13])), []).append(i)
    edges, start, count, total = [np.zeros((0, 5))], np.zeros(len(raws), np.int64), np.zeros(len(raws), np.int64), 0
    for (size, head), at in alike.items():
        order, kind, rings, points = _RING.unpack(head) if len(head) == 13 else (0, 0, 0, 0)
        if (order, kind, rings) == (1, 3, 1) and points and size == 13 + 16 * points:
            raw = np.frombuffer(b"".join([raws[i] for i in at]), np.uint8).reshape(len(at), size)
            a = raw[:, 13:].copy().view("<f8").reshape(len(at), points, 2)
            b, o = np.roll(a, -1, 1), a - a[:, :1]
            turn = np.roll(o, -1, 1)
            area = (o[..., 0] * turn[..., 1] - o[..., 1] * turn[..., 0]).sum(1)
            ahead = a[..., 0] < b[..., 0]
            left, right = np.where(ahead[..., None], a, b), np.where(ahead[..., None], b, a)
            keep = a[..., 0] != b[..., 0]
            n, part = keep.sum(1), np.concatenate([left, right, np.where(ahead == (area >= 0)[:, None], 1.0, -1.0)[..., None]], 2)[keep]
        else:
            each = [_edges(read_wkb(raws[i])) for i in at]
            n, part = np.array([len(e) for e in each]), np.concatenate(each)
        edges.append(part)
        count[at], start[at] = n, total + np.cumsum(n) - n
        total += len(part)
    return np.concatenate(edges), start, count


def overlay_areas(a, b, *keeps) -> list[np.ndarray]:
    """For each keep, the area that overlay gives, of many pairs of geometries (WKB) at once.

    Pairs of about as many edges go through the slabs of overlay together, those with more crossings after the
    others; edges that fill up a pair have no length and lie in no slab. keep gets arrays. Pairs with very many edges
    go through overlay.
    """
    (ea, sa, na), (eb, sb, nb) = edge_lists(a), edge_lists(b)
    out = [np.zeros(len(sa)) for _ in keeps]
    wide = lambda n: np.where(n > 8, -(-n // 8) * 8, n)
    kinds, kind = np.unique(np.stack([wide(na), wide(nb)], 1), axis=0, return_inverse=True)
    for k, (ma, mb) in enumerate(kinds.tolist()):
        of, m = np.flatnonzero(kind.reshape(-1) == k), ma + mb
        if not m:
            continue
        if m > _MANY_EDGES:
            for i in of:
                for o, keep in zip(out, keeps):
                    o[i] = overlay(read_wkb(a[i]), read_wkb(b[i]), keep)[0]
            continue
        step = max(1, _LANES // (m * m))
        for at in (of[j : j + step] for j in range(0, len(of), step)):
            e = np.concatenate([_padded(ea, sa[at], na[at], ma), _padded(eb, sb[at], nb[at], mb)], 1)
            level = (e[..., 1] == e[..., 3]).all(1)
            if level.any():
                for o, area in zip(out, _level_areas(e[level], ma, keeps)):
                    o[at[level]] = area
                e, at = e[~level], at[~level]
            if not len(at):
                continue
            x = _crossings(e)
            n = np.count_nonzero(x == x, axis=1)
            rows, done = np.argsort(n, kind="stable"), 0
            while done < len(rows):  # as many rows as fit with the crossings of the last of them
                size = np.arange(1, len(rows) - done + 1) * (2 * m + n[rows[done:]]) * m
                take = rows[done : done + max(1, int(np.searchsorted(size, _LANES, "right")))]
                for o, area in zip(out, _slab_areas(e[take], x[take, : n[take].max()], ma, keeps)):
                    o[at[take]] = area
                done += len(take)
    return out


def _padded(edges: np.ndarray, start: np.ndarray, count: np.ndarray, width: int) -> np.ndarray:
    k = np.arange(width)
    has = k < count[:, None]
    out = np.zeros((len(start), width, 5))
    out[has] = edges[(start[:, None] + k)[has]]
    return out


def _lines(e: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    width = e[..., 2] - e[..., 0]
    slope = (e[..., 3] - e[..., 1]) / np.where(width == 0, 1, width)
    return slope, e[..., 1] - slope * e[..., 0]


def _crossings(e: np.ndarray) -> np.ndarray:
    """x of the crossings of the edges of each row, nan after them."""
    slope, icept = _lines(e)
    i, j = np.triu_indices(e.shape[1], 1)
    d = slope[:, j] - slope[:, i]
    with np.errstate(divide="ignore", invalid="ignore"):
        x = (icept[:, i] - icept[:, j]) / d
    ok = (d != 0) & (x > np.maximum(e[:, i, 0], e[:, j, 0])) & (x < np.minimum(e[:, i, 2], e[:, j, 2]))
    x = np.sort(np.where(ok, x, np.nan), 1)
    return x[:, : ok.sum(1).max()]


def _sides(turn: np.ndarray, of_a: np.ndarray) -> list[np.ndarray]:
    """Are the gaps between edges in order of height inside a, and inside b?"""
    return [np.cumsum(turn[..., :-1] * own[..., :-1], -1, dtype=np.int16) != 0 for own in (of_a, ~of_a)]


def _level_areas(e: np.ndarray, of_a: int, keeps) -> list[np.ndarray]:
    """As _slab_areas, where all edges are level: their order is the same in all slabs."""
    order = np.argsort(e[..., 1], 1, kind="stable")
    xs = np.sort(np.concatenate([e[..., 0], e[..., 2]], 1), 1)
    e = np.take_along_axis(e, order[..., None], 1)
    x0, x1 = xs[:, :-1, None], xs[:, 1:, None]
    turn = ((e[:, None, :, 0] <= x0) & (e[:, None, :, 2] >= x1)) * e[:, None, :, 4].astype(np.int16)
    in_a, in_b = _sides(turn, (order < of_a)[:, None])
    return [np.einsum("nse,ns,ne->n", keep(in_a, in_b), np.diff(xs), np.diff(e[..., 1])) for keep in keeps]


def _slab_areas(e: np.ndarray, crossings: np.ndarray, of_a: int, keeps) -> list[np.ndarray]:
    slope, icept = _lines(e)
    xs = np.sort(np.concatenate([e[..., 0], e[..., 2], np.where(crossings == crossings, crossings, e[:, :1, 0])], 1), 1)
    x0, x1 = xs[:, :-1, None], xs[:, 1:, None]
    inside = (e[:, None, :, 0] <= x0) & (e[:, None, :, 2] >= x1) & (x0 < x1)
    y = np.where(inside, slope[:, None] * ((x0 + x1) / 2) + icept[:, None], np.inf)
    order = np.argsort(y, 2, kind="stable")
    y = np.take_along_axis(y, order, 2)
    turn = np.take_along_axis(np.where(inside, e[:, None, :, 4].astype(np.int16), 0), order, 2)
    in_a, in_b = _sides(turn, order < of_a)
    with np.errstate(invalid="ignore"):
        high = np.where(np.isfinite(y[..., 1:]), np.diff(y, axis=2), 0)
    return [(np.where(keep(in_a, in_b), high, 0).sum(2) * (x1 - x0)[..., 0]).sum(1) for keep in keeps]


def intersection_areas(a, b) -> np.ndarray:
    return overlay_areas(a, b, lambda p, q: p & q)[0]


def is_valid(polygon: list[np.ndarray]) -> bool:
    """Every ring has three points and an area, and no two edges of the polygon cross."""
    segments = []
    for ring in polygon:
        if len(np.unique(ring, axis=0)) < 3 or ring_area(ring) == 0:
            return False
        segments.append(np.column_stack([ring, np.roll(ring, -1, 0)]))
    s = np.concatenate(segments)
    turn = lambda p, q, r: (q[..., 0] - p[..., 0]) * (r[..., 1] - p[..., 1]) - (q[..., 1] - p[..., 1]) * (r[..., 0] - p[..., 0])
    for i in range(len(s)):
        a, b, c, d = s[i, :2], s[i, 2:], s[i + 1 :, :2], s[i + 1 :, 2:]
        if ((turn(a, b, c) * turn(a, b, d) < 0) & (turn(c, d, a) * turn(c, d, b) < 0)).any():
            return False
    return True


def convex_hull(points: np.ndarray) -> np.ndarray:
    """Monotone chain, counter-clockwise."""
    pts = sorted(map(tuple, np.unique(points, axis=0).tolist()))
    if len(pts) < 3:
        return np.array(pts)
    halves = []
    for seq in (pts, pts[::-1]):
        chain: list = []
        for p in seq:
            while len(chain) > 1 and (chain[-1][0] - chain[-2][0]) * (p[1] - chain[-2][1]) - (chain[-1][1] - chain[-2][1]) * (p[0] - chain[-2][0]) <= 0:
                chain.pop()
            chain.append(p)
        halves.append(chain[:-1])
    return np.array(halves[0] + halves[1])


def is_convex(ring: np.ndarray) -> bool:
    d = np.roll(ring, -1, 0) - ring
    turn = d[:, 0] * np.roll(d[:, 1], -1) - d[:, 1] * np.roll(d[:, 0], -1)
    return bool((turn >= 0).all() or (turn <= 0).all())


def clip_to_box(ring: np.ndarray, x0: float, y0: float, x1: float, y1: float) -> np.ndarray:
    """Sutherland-Hodgman against the four sides."""
    for axis, limit, sign in ((0, x0, 1), (0, x1, -1), (1, y0, 1), (1, y1, -1)):
        if not len(ring):
            break
        out = []
        for p, q in zip(ring, np.roll(ring, -1, 0)):
            inside, next_in = sign * (p[axis] - limit) >= 0, sign * (q[axis] - limit) >= 0
            if inside:
                out.append(p)
            if inside != next_in:
                out.append(p + (q - p) * (limit - p[axis]) / (q[axis] - p[axis]))
        ring = np.array(out)
    return ring


# ---- codecs ---------------------------------------------------------------------------------------


def read_wkb(raw: bytes) -> list[list[np.ndarray]]:
    """Polygons of a WKB or EWKB polygon, multipolygon or collection, Z and M dropped; others give none."""

    def geometry(at: int) -> tuple[list, int]:
        order = "<" if raw[at] else ">"
        (code,) = struct.unpack_from(order + "I", raw, at + 1)
        at += 5
        dims = 2 + bool(code & 0x80000000) + bool(code & 0x40000000)
        if code & 0x20000000:
            at += 4
        code &= 0x0FFFFFFF
        dims += {0: 0, 1: 1, 2: 1, 3: 2}[code // 1000]
        kind = code % 1000
        count = lambda p: struct.unpack_from(order + "I", raw, p)[0]
        if kind == 1:
            return [], at + 8 * dims
        if kind == 2:
            return [], at + 4 + 8 * dims * count(at)
        if kind == 3:
            rings, n = [], count(at)
            at += 4
            for _ in range(n):
                k = count(at)
                pts = np.frombuffer(raw, order + "f8", k * dims, at + 4).reshape(k, dims)[:, :2].astype(float)
                at += 4 + 8 * k * dims
                rings.append(pts[:-1] if len(pts) > 1 and (pts[0] == pts[-1]).all() else pts)
            return ([rings] if rings and len(rings[0]) else []), at
        out, n = [], count(at)
        at += 4
        for _ in range(n):
            part, at = geometry(at)
            out += part
        return out, at

    return geometry(0)[0] if raw else []


def write_wkb(polygons: list[list[np.ndarray]]) -> bytes:
    """Polygon, or multipolygon for any other number of them."""

    def one(polygon):
        out = struct.pack("<BII", 1, 3, len(polygon))
        for ring in polygon:
            closed = np.vstack([ring, ring[:1]])
            out += struct.pack("<I", len(closed)) + closed.astype("<f8").tobytes()
        return out

    if len(polygons) == 1:
        return one(polygons[0])
    return struct.pack("<BII", 1, 6, len(polygons)) + b"".join(map(one, polygons))


def read_wkt(text: str) -> list[list[np.ndarray]]:
    """Polygons of a POLYGON or MULTIPOLYGON."""
    import re

    kind, _, body = text.strip().partition("(")
    if kind.strip().upper() not in ("POLYGON", "MULTIPOLYGON"):
        return []
    rings = lambda s: [_open(np.array([[float(v) for v in p.split()[:2]] for p in r.split(",")])) for r in re.findall(r"\(([^()]+)\)", s)]
    if kind.strip().upper() == "POLYGON":
        return [rings(body)]
    return [rings(p) for p in re.findall(r"\((\([^()]+\)(?:\s*,\s*\([^()]+\))*)\)", "(" + body)]


def _open(ring: np.ndarray) -> np.ndarray:
    return ring[:-1] if len(ring) > 1 and (ring[0] == ring[-1]).all() else ring


def write_wkt(polygons: list[list[np.ndarray]], decimals: int = 7) -> str:
    """Shells counter-clockwise, holes clockwise."""

    def one(polygon):
        rings = []
        for k, ring in enumerate(polygon):
            ring = ring if (ring_area(ring) > 0) == (k == 0) else ring[::-1]
            rings.append("(" + ", ".join(f"{x:.{decimals}f} {y:.{decimals}f}" for x, y in np.vstack([ring, ring[:1]])) + ")")
        return "(" + ", ".join(rings) + ")"

    return f"POLYGON {one(polygons[0])}" if len(polygons) == 1 else f"MULTIPOLYGON ({', '.join(map(one, polygons))})"


# ---- column expressions ---------------------------------------------------------------------------


def mercator_lon(x: Column) -> Column:
    return x / EARTH_RADIUS_M * 180 / math.pi


def mercator_lat(y: Column) -> Column:
    return F.degrees(2 * F.atan(F.exp(y / EARTH_RADIUS_M)) - math.pi / 2)


def ground_distance(lon1: Column, lat1: Column, lon2: Column, lat2: Column) -> Column:
    """Equirectangular metres at the first point's latitude."""
    return F.sqrt(F.pow((lon2 - lon1) * F.cos(F.radians(lat1)) * M_PER_DEG, 2) + F.pow((lat2 - lat1) * M_PER_DEG, 2))


def plane_distance(x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
    """ground_distance of places in metres east and north of one on the equator; degrees would round them to nanometres."""
    return F.sqrt(F.pow((x2 - x1) * F.cos(F.radians(y1 / M_PER_DEG)), 2) + F.pow(y2 - y1, 2))


def tile_index(x: Column, zoom: int) -> Column:
    """Index of the web tile of a mercator coordinate, from the west (or south) edge."""
    half = math.pi * EARTH_RADIUS_M
    return F.floor((x + half) / (2 * half / 2**zoom)).cast("long")


def utm_zone(lon: Column) -> Column:
    return F.least(F.lit(60), F.greatest(F.lit(1), F.floor((lon + 180) / 6) + 1)).cast("int")


def utm_epsg(lon: Column, lat: Column) -> Column:
    return F.when(lat >= 0, 32600).otherwise(32700) + utm_zone(lon)


def utm_forward(lon: Column, lat: Column) -> tuple[Column, Column]:
    """Easting and northing (northern false origin), by the Krueger series to the third order on WGS 84."""
    a, f = 6378137.0, 1 / 298.257223563
    n = f / (2 - f)
    big_a = a / (1 + n) * (1 + n**2 / 4 + n**4 / 64)
    alpha = (n / 2 - 2 * n**2 / 3 + 5 * n**3 / 16, 13 * n**2 / 48 - 3 * n**3 / 5, 61 * n**3 / 240)
    e = 2 * math.sqrt(n) / (1 + n)
    lam = F.radians(lon - (utm_zone(lon) * 6 - 183))
    s = F.sin(F.radians(lat))
    atanh = lambda v: 0.5 * F.log((1 + v) / (1 - v))
    t = F.sinh(atanh(s) - e * atanh(e * s))
    xi, eta = F.atan2(t, F.cos(lam)), atanh(F.sin(lam) / F.sqrt(1 + t * t))
    east, north = eta, xi
    for j, c in enumerate(alpha, 1):
        east = east + c * F.cos(2 * j * xi) * F.sinh(2 * j * eta)
        north = north + c * F.sin(2 * j * xi) * F.cosh(2 * j * eta)
    return 500000 + 0.9996 * big_a * east, 0.9996 * big_a * north


def utm_inverse(east: Column, north: Column, zone: Column) -> tuple[Column, Column]:
    """Longitude and latitude of northern UTM coordinates, by the inverse Krueger series to the third order on WGS 84."""
    a, f = 6378137.0, 1 / 298.257223563
    n = f / (2 - f)
    big_a = a / (1 + n) * (1 + n**2 / 4 + n**4 / 64)
    beta = (n / 2 - 2 * n**2 / 3 + 37 * n**3 / 96, n**2 / 48 + n**3 / 15, 17 * n**3 / 480)
    delta = (2 * n - 2 * n**2 / 3 - 2 * n**3, 7 * n**2 / 3 - 8 * n**3 / 5, 56 * n**3 / 15)
    xi, eta = north / (0.9996 * big_a), (east - 500000) / (0.9996 * big_a)
    x, y = xi, eta
    for j, c in enumerate(beta, 1):
        x = x - c * F.sin(2 * j * xi) * F.cosh(2 * j * eta)
        y = y - c * F.cos(2 * j * xi) * F.sinh(2 * j * eta)
    chi = F.asin(F.sin(x) / F.cosh(y))
    lat = chi
    for j, c in enumerate(delta, 1):
        lat = lat + c * F.sin(2 * j * chi)
    return zone * 6 - 183 + F.degrees(F.atan2(F.sinh(y), F.cos(x))), F.degrees(lat)


# ---- on the ellipsoid, and around lines -----------------------------------------------------------


def spheroid_area(polygon: list[np.ndarray]) -> float:
    """Square metres of a polygon in degrees on WGS 84: its area on the sphere of equal area, edges straight there."""
    a, f = 6378137.0, 1 / 298.257223563
    e2 = f * (2 - f)
    e = math.sqrt(e2)
    q = lambda s: (1 - e2) * (s / (1 - e2 * s * s) + np.arctanh(e * s) / e)
    top = float(q(np.float64(1.0)))

    def band(ring: np.ndarray) -> float:
        lam, s = np.radians(ring[:, 0]), q(np.sin(np.radians(ring[:, 1]))) / top
        turn = (np.roll(lam, -1) - lam + math.pi) % (2 * math.pi) - math.pi
        return abs(float((turn * (s + np.roll(s, -1))).sum() / 2))

    return a * a * top / 2 * (band(polygon[0]) - sum(band(r) for r in polygon[1:]))


def capsule(p: tuple[float, float], q: tuple[float, float], radius: float, steps: int = 32) -> np.ndarray:
    """Ring around all points not farther than radius from a line, with round caps of so many steps."""
    (x0, y0), (x1, y1) = p, q
    along = math.atan2(y1 - y0, x1 - x0)
    half = np.linspace(0, math.pi, steps + 1)
    end, start = along - math.pi / 2 + half, along + math.pi / 2 + half
    caps = [(x1 + radius * np.cos(end), y1 + radius * np.sin(end)), (x0 + radius * np.cos(start), y0 + radius * np.sin(start))]
    return np.concatenate([np.stack(c, 1) for c in caps])


def buffered_line(points: list[tuple[float, float]], radius: float, steps: int = 32) -> list[list[np.ndarray]]:
    """Capsules around the pieces of a line; their union is the buffer."""
    pieces = list(zip(points, points[1:])) or [(points[0], points[0])]
    return [[capsule(p, q, radius, steps)] for p, q in pieces]
