"""Buildings out of the pieces that tiling cut them into."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cadastra.functions.geometry import EARTH_RADIUS_M, mercator_lat, mercator_lon
from cadastra.operators.graph import connected_components
from cadastra.operators.staging import stage

# Pixels of a tile, and how far two pieces may disagree along their common edge.
EXTENT = 4096
TOLERANCE_PX = 8


def piece_links(pieces: DataFrame, tolerance: float) -> DataFrame:
    """(a, b) of pieces that continue each other over a tile edge.

    pieces: pid, ident, keyed, tx, ty, and the extents along the edges they touch, e0 e1 w0 w1 n0 n1 s0 s1 (null
    where they don't). Two equi-joins on identity and tile, with a band on the extents of those without a key.
    """

    def side(step: dict, near: str, far: str) -> DataFrame:
        p = pieces.where(F.col(f"{near}0").isNotNull()).select("ident", "keyed", F.col("pid").alias("a"), (F.col("tx") + step["x"]).alias("tx"), (F.col("ty") + step["y"]).alias("ty"), F.col(f"{near}0").alias("p0"), F.col(f"{near}1").alias("p1"))
        n = pieces.where(F.col(f"{far}0").isNotNull()).select("ident", F.col("pid").alias("b"), "tx", "ty", F.col(f"{far}0").alias("q0"), F.col(f"{far}1").alias("q1"))
        agree = F.col("keyed") | ((F.abs(F.col("p0") - F.col("q0")) < tolerance) & (F.abs(F.col("p1") - F.col("q1")) < tolerance))
        return p.join(n, ["ident", "tx", "ty"]).where(agree).select("a", "b")

    return side({"x": 1, "y": 0}, "e", "w").unionByName(side({"x": 0, "y": 1}, "n", "s"))


def stitched(pieces: DataFrame, tolerance: float) -> DataFrame:
    """(pid, bid): the smallest pid of each building."""
    links = stage(piece_links(pieces, tolerance), "piece-links")
    comps = connected_components(links).withColumnRenamed("id", "pid")
    return pieces.select("pid").join(comps, "pid", "left").select("pid", F.coalesce("comp", "pid").alias("bid"))


def tolerance_at(zoom: int) -> float:
    return TOLERANCE_PX * 2 * math.pi * EARTH_RADIUS_M / 2**zoom / EXTENT


def buildings(pieces: DataFrame, of: DataFrame) -> DataFrame:
    """One row per building from mercator pieces (pid, area, cx, cy, gh, gtype, valid): area-weighted centroid in degrees."""
    lat = mercator_lat(F.col("cy"))
    p = pieces.join(of, "pid").withColumn("lon", mercator_lon(F.col("cx"))).withColumn("lat", lat).withColumn("a", F.col("area") * F.pow(F.cos(F.radians(lat)), 2))
    weighted = lambda c: F.when(F.sum("a") > 0, F.sum(F.col(c) * F.col("a")) / F.sum("a")).otherwise(F.avg(c))
    return p.groupBy("bid").agg(
        F.count(F.lit(1)).alias("pieces"),
        F.sum("a").alias("area"),
        weighted("lon").alias("cx"),
        weighted("lat").alias("cy"),
        F.when(F.count(F.lit(1)) > 1, "MULTIPOLYGON").otherwise(F.upper(F.min("gtype"))).alias("gtype"),
        F.coalesce(F.bool_and("valid"), F.lit(False)).alias("valid"),
        F.md5(F.array_join(F.array_sort(F.collect_list("gh")), ",").cast("binary")).alias("gh"),
    )
