"""Geometry kernels, tile pieces, shadows and cell indexes over the footprints derived from orders."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cadastra.functions import geometry as G
from cadastra.functions import routes
from cadastra.functions.s2 import s2_token
from cadastra.functions.shadows import shadow_area, sun_offset
from cadastra.operators.cells import box_join
from cadastra.plans.osm import assembled
from cadastra.plans.polygons import box_wkb
from cadastra.plans.stitch import stitched
from cadastra.plans.tables import BOXES_SQL, boxes, gob_boxes, osm_boxes, table
from cadastra.sources import metrics

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(function):
        QUERIES[name] = function
        if sql:
            ORACLES[name] = sql
        return function

    return add


def ring(x0, y0, x1, y1) -> np.ndarray:
    return np.array([[x0, y0], [x1, y0], [x1, y1], [x0, y1]], float)


def wkb_boxes(df):
    return df.withColumn("geometry", box_wkb("x0", "y0", "x1", "y1"))


@query("i17_geometry_metrics", f"WITH {BOXES_SQL} SELECT id, area::DOUBLE AS area, (x0 + x1) / 2.0::DOUBLE AS cx, (y0 + y1) / 2.0::DOUBLE AS cy, x0::DOUBLE AS x0, y1::DOUBLE AS y1 FROM osm")
def geometry_metrics(spark, sf_dir):
    """Metrics of WKB polygons."""
    m = wkb_boxes(osm_boxes(spark, sf_dir)).select("id", metrics("geometry").alias("m"))
    tidy = lambda c: (F.floor(F.col(f"m.{c}") * 1e6 + 0.5) / 1e6).alias(c)
    return m.select("id", *[tidy(c) for c in ("area", "cx", "cy", "x0", "y1")])


@query(
    "i11_polygon_overlap",
    f"""WITH {BOXES_SQL} SELECT a.id AS a, b.id AS b, ((least(a.x1, b.x1) - greatest(a.x0, b.x0)) * (least(a.y1, b.y1) - greatest(a.y0, b.y0)))::DOUBLE AS inter,
    (a.area + b.area - (least(a.x1, b.x1) - greatest(a.x0, b.x0)) * (least(a.y1, b.y1) - greatest(a.y0, b.y0)))::DOUBLE AS joined
    FROM osm a JOIN gob b ON a.x0 < b.x1 AND b.x0 < a.x1 AND a.y0 < b.y1 AND b.y0 < a.y1""",
)
def polygon_overlap(spark, sf_dir):
    """Intersection and union areas by the polygon kernel, on candidates of the cell join."""

    @F.pandas_udf(T.StructType([T.StructField("inter", T.DoubleType()), T.StructField("joined", T.DoubleType())]))
    def areas(a: pd.Series, b: pd.Series) -> pd.DataFrame:
        inter, joined = G.overlay_areas(a.to_list(), b.to_list(), lambda p, q: p & q, lambda p, q: p | q)
        return pd.DataFrame({"inter": inter.round(6), "joined": joined.round(6)})

    a = osm_boxes(spark, sf_dir)
    near = box_join(a.select("id", "x0", "y0", "x1", "y1"), gob_boxes(spark, sf_dir).select("id", "x0", "y0", "x1", "y1"), 32.0)
    wkb = lambda s: box_wkb(*[f"{s}_{c}" for c in ("x0", "y0", "x1", "y1")])
    return near.select(F.col("a_id").alias("a"), F.col("b_id").alias("b"), areas(wkb("a"), wkb("b")).alias("m")).select("a", "b", "m.inter", "m.joined")


TILE = 64


def pieces(spark, sf_dir):
    """Footprints cut at tile edges, each piece with the extents along the edges it touches."""
    b = osm_boxes(spark, sf_dir)
    cut = lambda lo, hi: F.sequence(F.floor(F.col(lo) / TILE), F.floor((F.col(hi) - 1) / TILE))
    p = b.withColumn("tx", F.explode(cut("x0", "x1"))).withColumn("ty", F.explode(cut("y0", "y1")))
    west, south = F.col("tx") * TILE, F.col("ty") * TILE
    p = p.withColumns({"px0": F.greatest("x0", west), "px1": F.least("x1", west + TILE), "py0": F.greatest("y0", south), "py1": F.least("y1", south + TILE)})
    on = lambda test, c: F.when(test, F.col(c).cast("double"))
    east, north = (F.col("px1") == west + TILE) & (F.col("x1") > F.col("px1")), (F.col("py1") == south + TILE) & (F.col("y1") > F.col("py1"))
    left, low = F.col("px0") > F.col("x0"), F.col("py0") > F.col("y0")
    edges = {}
    for name, test, lo, hi in (("e", east, "py0", "py1"), ("w", left, "py0", "py1"), ("n", north, "px0", "px1"), ("s", low, "px0", "px1")):
        edges |= {f"{name}0": on(test, lo), f"{name}1": on(test, hi)}
    pid = F.concat_ws(":", F.col("id"), F.lpad(F.col("tx").cast("string"), 4, "0"), F.lpad(F.col("ty").cast("string"), 4, "0"))
    return p.withColumns(edges).select(pid.alias("pid"), F.col("id").alias("ident"), (F.col("k") % 2 == 0).alias("keyed"), "tx", "ty", *edges)


@query(
    "k26_stitched_pieces",
    f"""WITH {BOXES_SQL}, p AS (SELECT id, tx, unnest(range(y0 // 64, (y1 - 1) // 64 + 1)) AS ty FROM (SELECT *, unnest(range(x0 // 64, (x1 - 1) // 64 + 1)) AS tx FROM osm)),
    q AS (SELECT id, id || ':' || lpad(tx::VARCHAR, 4, '0') || ':' || lpad(ty::VARCHAR, 4, '0') AS pid FROM p) SELECT pid, min(pid) OVER (PARTITION BY id) AS bid FROM q""",
)
def stitched_pieces(spark, sf_dir):
    """Pieces put together again over tile edges."""
    return stitched(pieces(spark, sf_dir), 0.5)


SUN = (225.0, 40.0)


@query(
    "k34_shadow_area",
    f"""WITH {BOXES_SQL} SELECT id, floor(((x1 - x0) * (y1 - y0) + 10 / tan(radians(40)) * (abs(sin(radians(225))) * (y1 - y0) + abs(cos(radians(225))) * (x1 - x0))) * 1000 + 0.5) / 1000 AS area FROM osm""",
)
def shadow_areas(spark, sf_dir):
    """Swept area of a prism 10 m high."""
    dx, dy = sun_offset(*SUN)

    @F.pandas_udf(T.DoubleType())
    def area(x0: pd.Series, y0: pd.Series, x1: pd.Series, y1: pd.Series) -> pd.Series:
        return pd.Series([shadow_area([ring(*r)], 0.0, 10.0, dx, dy) for r in zip(x0, y0, x1, y1)])

    b = osm_boxes(spark, sf_dir)
    return b.select("id", (F.floor(area("x0", "y0", "x1", "y1") * 1000 + 0.5) / 1000).alias("area"))


@query("j29_s2_tokens")
def s2_tokens(spark, sf_dir):
    lat, lon = F.col("c_custkey") % 170 - 85.0, F.col("c_custkey") * 7 % 360 - 180.0
    return table(spark, sf_dir, "customer").select("c_custkey", s2_token(lat, lon, 4).alias("level4"), s2_token(lat, lon, 12).alias("level12"))


@query(
    "k10_parts_to_outlines",
    f"""WITH {BOXES_SQL}, o AS (SELECT id, x0, y0, x1, y1, area, c % 5 AS cls FROM osm WHERE k % 3 = 1), p AS (SELECT id, (x0 + x1) / 2.0 AS px, (y0 + y1) / 2.0 AS py FROM osm WHERE k % 3 = 2)
    SELECT p.id, arg_min(o.id, (o.area, o.id)) AS parent, arg_min(o.cls, (o.area, o.id))::VARCHAR AS class FROM p LEFT JOIN o ON px BETWEEN x0 AND x1 AND py BETWEEN y0 AND y1 GROUP BY p.id""",
)
def parts_to_outlines(spark, sf_dir):
    """Each part's smallest outline, and its class."""
    b = osm_boxes(spark, sf_dir)
    middle = lambda c: (F.col(f"{c}0") + F.col(f"{c}1")) / 2
    part = F.col("k") % 3 == 2
    raw = b.select(
        "id", F.when(part, "part").otherwise("building").alias("kind"), F.when(~part, (F.col("c") % 5).cast("string")).alias("class"), "area", middle("x").alias("px"), middle("y").alias("py"), "x0", "y0", "x1", "y1"
    )
    return assembled(raw, 32.0).where("kind = 'part'").select("id", "parent", "class")


@query(
    "e26_tallest_by_building",
    "WITH f AS (SELECT coalesce(CASE WHEN o_orderkey % 4 = 0 THEN o_custkey END, o_orderkey) AS id, o_totalprice AS h FROM orders) SELECT id, max(h) AS height, count(*) AS parts FROM f GROUP BY id ORDER BY height DESC, id LIMIT 200",
)
def tallest_by_building(spark, sf_dir):
    """Parts folded into their building."""
    k = F.col("o_orderkey")
    rows = table(spark, sf_dir, "orders").select(F.coalesce(F.when(k % 4 == 0, F.col("o_custkey")), k).alias("id"), F.col("o_totalprice").alias("h"))
    return rows.groupBy("id").agg(F.max("h").alias("height"), F.count(F.lit(1)).alias("parts")).orderBy(F.col("height").desc(), "id").limit(200)


@query("k44_tour_stops")
def tour_stops(spark, sf_dir):
    """The tallest, with room between them. The top list grows until it holds ten stops or the whole table."""
    rows, limit = boxes(spark, sf_dir).orderBy(F.col("price").desc(), "k").select("x0", "y0", "k", "price"), 500
    while True:
        top = rows.limit(limit).collect()
        stops = routes.spaced([tuple(r) for r in top], 10, 120.0)
        if len(stops) >= 10 or len(top) < limit:
            return spark.createDataFrame(stops, "x long, y long, k long, height double")
        limit *= 8
