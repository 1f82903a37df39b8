"""Joins on polygons: cells find boxes that overlap, numpy kernels decide on the polygons."""

from __future__ import annotations

import struct

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cadastra.functions import geometry as G
from cadastra.operators.cells import box_join, point_in_box


def rings_wkb(corners: np.ndarray) -> list[bytes]:
    """WKB polygons of (n, k, 2) corners, without the closing one; one ring each."""
    closed = np.concatenate([corners, corners[:, :1]], 1).astype("<f8")
    n, k = closed.shape[:2]
    head, raw, size = struct.pack("<BIII", 1, 3, 1, k), closed.tobytes(), 16 * k
    return [head + raw[i * size : (i + 1) * size] for i in range(n)]


@F.pandas_udf(T.BinaryType())
def box_wkb(x0: pd.Series, y0: pd.Series, x1: pd.Series, y1: pd.Series) -> pd.Series:
    return pd.Series(rings_wkb(np.stack([np.stack(p, 1) for p in ((x0, y0), (x1, y0), (x1, y1), (x0, y1))], 1)), dtype=object)


@F.pandas_udf(T.DoubleType())
def overlap_area(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series(G.intersection_areas(a.to_list(), b.to_list()))


overlap_area = overlap_area.asNondeterministic()  # else a filter on the area is put below its column, with a call of its own


@F.pandas_udf(T.BooleanType())
def holds(polygon: pd.Series, x: pd.Series, y: pd.Series) -> pd.Series:
    return pd.Series([any(G.point_in_polygon(*p, part) for part in G.read_wkb(w)) for w, *p in zip(polygon, x, y)], dtype=bool)


def overlaps(a: DataFrame, b: DataFrame, cell: float) -> DataFrame:
    """Pairs of polygons (x0..y1, geometry as WKB, any columns) that overlap, prefixed a_ and b_, with inter."""
    near = box_join(a, b, cell).where("inter > 0").drop("inter")
    return near.withColumn("inter", overlap_area("a_geometry", "b_geometry")).where("inter > 0")


def containers(points: DataFrame, polygons: DataFrame, cell: float) -> DataFrame:
    """Points (px, py, any columns) with each polygon that holds them, prefixed p_ and b_."""
    near = point_in_box(points, polygons, cell)
    return near.where(holds("b_geometry", F.col("px").cast("double"), F.col("py").cast("double")))


SIDES = ("w0", "w1", "e0", "e1", "s0", "s1", "n0", "n1")


@F.pandas_udf(T.StructType([T.StructField(c, T.DoubleType()) for c in SIDES]))
def edge_extents(geometry: pd.Series, x0: pd.Series, y0: pd.Series, x1: pd.Series, y1: pd.Series) -> pd.DataFrame:
    """Extent of a polygon's corners along each side of its tile; null where it does not touch the side."""
    rows = []
    for wkb, *box in zip(geometry, x0, y0, x1, y1):
        points = np.concatenate([r for p in G.read_wkb(wkb) for r in p] or [np.zeros((0, 2))])
        row = []
        for axis, limit in ((0, box[0]), (0, box[2]), (1, box[1]), (1, box[3])):
            along = points[np.isclose(points[:, axis], limit, rtol=0, atol=1e-9), 1 - axis]
            row += [along.min(), along.max()] if len(along) else [None, None]
        rows.append(row)
    return pd.DataFrame(rows, columns=list(SIDES), dtype=float)
