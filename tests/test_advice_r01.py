"""Kernel queries over all footprints, held against brute force on a small fixture."""

import math

from cadastra.plans import kernel_queries
from cadastra.plans.tables import gob_boxes, osm_boxes

SF = "/root/testdata/sf0.001"
BOX = ("id", "x0", "y0", "x1", "y1")


def test_overlaps_of_all_footprints(spark):
    osm, gob = ([tuple(r) for r in f(spark, SF).select(*BOX).collect()] for f in (osm_boxes, gob_boxes))
    want = {}
    for a, ax0, ay0, ax1, ay1 in osm:
        for b, bx0, by0, bx1, by1 in gob:
            w, h = min(ax1, bx1) - max(ax0, bx0), min(ay1, by1) - max(ay0, by0)
            if w > 0 and h > 0:
                want[a, b] = (w * h, (ax1 - ax0) * (ay1 - ay0) + (bx1 - bx0) * (by1 - by0) - w * h)
    got = kernel_queries.polygon_overlap(spark, SF).collect()
    assert len(got) == len(want) > 0 and {(r.a, r.b): (r.inter, r.joined) for r in got} == want


def test_shadows_of_all_footprints(spark):
    long = 10 / math.tan(math.radians(40))
    east, north = (long * abs(f(math.radians(225))) for f in (math.sin, math.cos))
    want = {i: (x1 - x0) * (y1 - y0) + east * (y1 - y0) + north * (x1 - x0) for i, x0, y0, x1, y1 in osm_boxes(spark, SF).select(*BOX).collect()}
    got = kernel_queries.shadow_areas(spark, SF).collect()
    assert len(got) == len(want) > 0
    assert all(abs(r.area - want[r.id]) < 1e-3 for r in got)
