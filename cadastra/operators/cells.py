"""Spatial joins as equi-joins on grid cells.

A box (x0, y0, x1, y1) is exploded over the cells that it touches; two boxes that overlap share a cell. They
may share several: the pair is kept only in the cell of the lower corner of its overlap, (max x0, max y0), so no
distinct and no further shuffle is needed. Choose a cell near the size of the larger boxes: a box far larger
than a cell is exploded over many of them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def cell_of(x: Column, cell: float) -> Column:
    return F.floor(x / cell).cast("long")


def over_cells(df: DataFrame, cell: float, margin: float = 0.0) -> DataFrame:
    """df with gx, gy: a row for each cell that the box, grown by margin, touches."""
    span = lambda a, b: F.sequence(cell_of(F.col(a) - margin, cell), cell_of(F.col(b) + margin, cell))
    return df.withColumn("gx", F.explode(span("x0", "x1"))).withColumn("gy", F.explode(span("y0", "y1")))


def _named(df: DataFrame, prefix: str) -> DataFrame:
    return df.select(*[F.col(c).alias(c if c in ("gx", "gy") else f"{prefix}_{c}") for c in df.columns])


def overlap_area(a: str = "a", b: str = "b") -> Column:
    side = lambda lo, hi: F.least(f"{a}_{hi}", f"{b}_{hi}") - F.greatest(f"{a}_{lo}", f"{b}_{lo}")
    return F.greatest(F.lit(0), side("x0", "x1")) * F.greatest(F.lit(0), side("y0", "y1"))


def box_join(a: DataFrame, b: DataFrame, cell: float, touching: bool = False) -> DataFrame:
    """Pairs of boxes that overlap (or touch), columns prefixed a_ and b_, with inter, the area in common."""
    left, right = _named(over_cells(a, cell), "a"), _named(over_cells(b, cell), "b")
    less = (lambda x, y: F.col(x) <= F.col(y)) if touching else (lambda x, y: F.col(x) < F.col(y))
    meet = less("a_x0", "b_x1") & less("b_x0", "a_x1") & less("a_y0", "b_y1") & less("b_y0", "a_y1")
    here = (F.col("gx") == cell_of(F.greatest("a_x0", "b_x0"), cell)) & (F.col("gy") == cell_of(F.greatest("a_y0", "b_y0"), cell))
    return left.join(right, ["gx", "gy"]).where(meet & here).drop("gx", "gy").withColumn("inter", overlap_area())


def point_in_box(points: DataFrame, boxes: DataFrame, cell: float) -> DataFrame:
    """Points (px, py) with each box that holds them; p_ and b_ columns. A point is in one cell, so no pair comes twice."""
    left = points.withColumn("gx", cell_of(F.col("px"), cell)).withColumn("gy", cell_of(F.col("py"), cell))
    left = left.select("gx", "gy", *[F.col(c).alias(c if c in ("px", "py") else f"p_{c}") for c in points.columns])
    inside = F.col("px").between(F.col("b_x0"), F.col("b_x1")) & F.col("py").between(F.col("b_y0"), F.col("b_y1"))
    return left.join(_named(over_cells(boxes, cell), "b"), ["gx", "gy"]).where(inside).drop("gx", "gy")


def box_distance(px: Column, py: Column, prefix: str = "b") -> Column:
    """Distance of a point to a box, 0 inside."""
    gap = lambda p, lo, hi: F.greatest(F.col(f"{prefix}_{lo}") - p, p - F.col(f"{prefix}_{hi}"), F.lit(0))
    return F.sqrt(F.pow(gap(px, "x0", "x1").cast("double"), 2) + F.pow(gap(py, "y0", "y1").cast("double"), 2))


def within(points: DataFrame, boxes: DataFrame, radius: float, cell: float) -> DataFrame:
    """Points with each box at most radius away, and the distance."""
    left = points.withColumn("gx", cell_of(F.col("px"), cell)).withColumn("gy", cell_of(F.col("py"), cell))
    left = left.select("gx", "gy", *[F.col(c).alias(c if c in ("px", "py") else f"p_{c}") for c in points.columns])
    near = left.join(_named(over_cells(boxes, cell, radius), "b"), ["gx", "gy"]).drop("gx", "gy")
    return near.withColumn("distance", box_distance(F.col("px"), F.col("py"))).where(F.col("distance") <= radius)
