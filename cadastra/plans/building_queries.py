"""Convert, landmarks, preparation, final table, polygons and formats over the driver's tables."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cadastra import sources
from cadastra.functions import formats
from cadastra.functions import geometry as G
from cadastra.functions.heights import HeightRule
from cadastra.plans import canonical, convert, landmarks
from cadastra.plans import conflation as C
from cadastra.plans import diff as D
from cadastra.plans.polygons import box_wkb, containers, edge_extents, overlaps, rings_wkb
from cadastra.plans.spatial_queries import DEG, KEYED_SQL, POINTS_SQL, compared, points
from cadastra.plans.tables import BOXES_SQL, boxes, gob_boxes, osm_boxes, table

QUERIES: dict = {}
ORACLES: dict[str, str] = {}
CELL = 32.0


def query(name: str, sql: str | None = None):
    def add(function):
        QUERIES[name] = function
        if sql:
            ORACLES[name] = sql
        return function

    return add


def six(column):
    return F.floor(column * 1e6 + 0.5) / 1e6


# ---- convert --------------------------------------------------------------------------------------

CONVERTED = "SELECT p_partkey, p_name, p_size, CASE p_partkey % 4 WHEN 0 THEN p_size || ' m' WHEN 1 THEN replace((p_size / 2.0)::DECIMAL(6,1)::VARCHAR, '.', ',') WHEN 2 THEN 'tall' END AS height_m, CASE WHEN p_partkey % 3 = 0 THEN p_size END AS floors, 'old' AS h_src FROM part"


def convert_input(spark, sf_dir):
    k = F.col("p_partkey")
    half = F.regexp_replace((F.col("p_size") / 2.0).cast("decimal(6,1)").cast("string"), r"\.", ",")
    height = F.when(k % 4 == 0, F.concat(F.col("p_size").cast("string"), F.lit(" m"))).when(k % 4 == 1, half).when(k % 4 == 2, "tall")
    return table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_size", height.alias("height_m"), F.when(k % 3 == 0, F.col("p_size")).alias("floors"), F.lit("old").alias("h_src"))


CONVERT = convert.ConvertSpec(rule=HeightRule(), height="height_m", levels="floors", where="p_size > 3 AND p_partkey % 7 <> 0")


@query(
    "c01_converted",
    f"""WITH i AS ({CONVERTED}), n AS (SELECT *, try_cast(nullif(regexp_extract(replace(trim(height_m), ',', '.'), '^[0-9]*[.]?[0-9]+'), '') AS DOUBLE) AS h FROM i WHERE p_size > 3 AND p_partkey % 7 <> 0),
    v AS (SELECT *, coalesce(h BETWEEN 2 AND 500, false) AS gh, coalesce(floors BETWEEN 1 AND 200, false) AS gl FROM n)
    SELECT p_partkey, p_name, p_size, floors, height_m AS h_raw, CASE WHEN gh THEN floor(h * 10 + 0.5) / 10 WHEN gl THEN floor(floors * 3.5::DOUBLE * 10 + 0.5) / 10 ELSE 3.5 END AS height_m,
    CASE WHEN gh THEN 'height' WHEN gl THEN 'levels' ELSE 'default' END AS h_src, CASE WHEN (h IS NOT NULL AND NOT gh) OR (floors IS NOT NULL AND NOT gl) THEN 1 ELSE 0 END AS h_outlier FROM v""",
)
def converted(spark, sf_dir):
    """Pass-through columns, those computed anew, and a predicate."""
    return convert.normalised(convert_input(spark, sf_dir), CONVERT)


@query("c03_convert_accounting", "SELECT count(*) AS rows_in, count(*) FILTER (WHERE p_size > 3 AND p_partkey % 7 <> 0) AS rows_kept, count(*) FILTER (WHERE NOT (p_size > 3 AND p_partkey % 7 <> 0)) AS filtered_out FROM part")
def convert_accounting(spark, sf_dir):
    return convert.accounting(convert_input(spark, sf_dir), CONVERT)


# ---- landmarks ------------------------------------------------------------------------------------

#: Every 29th footprint has a landmark, moved by up to six metres; some know a key, some only evidence, some nothing.
MARKS_SQL = f"""{BOXES_SQL}, canon AS (SELECT id, k, x0, y0, x1, y1, CASE WHEN k % 2 = 0 THEN ['gob/' || k::VARCHAR] ELSE []::VARCHAR[] END AS evidence FROM osm),
marks AS (SELECT 'lm/' || k::VARCHAR AS lid, x0 + k % 7 AS x0, y0 + k % 3 AS y0, x1 + k % 7 AS x1, y1 + k % 3 AS y1,
  CASE k % 4 WHEN 0 THEN ['gob/' || k::VARCHAR, 'gone/1'] WHEN 1 THEN ['way/' || k::VARCHAR] WHEN 2 THEN ['gob/' || (k + 2)::VARCHAR, 'way/' || (k + 3)::VARCHAR] ELSE []::VARCHAR[] END AS keys FROM osm WHERE k % 29 = 1)"""


def landmark_tables(spark, sf_dir):
    k = F.col("k").cast("string")
    plus = lambda n: (F.col("k") + n).cast("string")
    none = F.expr("cast(array() as array<string>)")
    osm = osm_boxes(spark, sf_dir)
    canon = osm.select("id", "x0", "y0", "x1", "y1", F.when(F.col("k") % 2 == 0, F.array(F.concat(F.lit("gob/"), k))).otherwise(none).alias("evidence"))
    east, north = F.col("k") % 7, F.col("k") % 3
    keys = (
        F.when(F.col("k") % 4 == 0, F.array(F.concat(F.lit("gob/"), k), F.lit("gone/1")))
        .when(F.col("k") % 4 == 1, F.array(F.concat(F.lit("way/"), k)))
        .when(F.col("k") % 4 == 2, F.array(F.concat(F.lit("gob/"), plus(2)), F.concat(F.lit("way/"), plus(3))))
        .otherwise(none)
    )
    moved = [(F.col(c) + d).alias(c) for c, d in (("x0", east), ("y0", north), ("x1", east), ("y1", north))]
    return osm.where("k % 29 = 1").select(F.concat(F.lit("lm/"), k).alias("lid"), *moved, keys.alias("keys")), canon


KEY_SQL = """hits AS (SELECT m.lid, c.id, CASE WHEN list_contains(m.keys, c.id) THEN 0 ELSE 1 END AS r FROM (SELECT lid, unnest(keys) AS key FROM marks) u JOIN marks m USING (lid) JOIN canon c ON c.id = u.key OR list_contains(c.evidence, u.key)),
known AS (SELECT lid, arg_min(id, (r, id)) AS id FROM hits GROUP BY lid)"""
IOU_SQL = """ov AS (SELECT m.lid, c.id, i::DOUBLE / ((m.x1 - m.x0) * (m.y1 - m.y0) + (c.x1 - c.x0) * (c.y1 - c.y0) - i) AS iou FROM (
  SELECT m.lid AS l, c.id AS b, (least(m.x1, c.x1) - greatest(m.x0, c.x0)) * (least(m.y1, c.y1) - greatest(m.y0, c.y0)) AS i FROM marks m JOIN canon c ON m.x0 < c.x1 AND c.x0 < m.x1 AND m.y0 < c.y1 AND c.y0 < m.y1
) JOIN marks m ON m.lid = l JOIN canon c ON c.id = b), best AS (SELECT lid, id, iou FROM (SELECT *, row_number() OVER (PARTITION BY lid ORDER BY iou DESC, id) AS r FROM ov) WHERE r = 1)"""


@query("d21_key_or_evidence", f"WITH {MARKS_SQL}, {KEY_SQL} SELECT lid, id FROM known")
def key_or_evidence(spark, sf_dir):
    """The footprint that a known key leads to, by itself or by its evidence."""
    return landmarks.by_key(*landmark_tables(spark, sf_dir))


@query("d09_best_iou", f"WITH {MARKS_SQL}, {IOU_SQL} SELECT lid, id, floor(iou * 1e6 + 0.5) / 1e6 AS iou FROM best")
def best_iou(spark, sf_dir):
    """The footprint that overlaps a landmark best."""
    found = landmarks.best_overlap(landmarks.overlap_iou(*landmark_tables(spark, sf_dir), CELL))
    return found.select("lid", "id", six(F.col("iou")).alias("iou"))


LOCK_SQL = f"""{MARKS_SQL}, {KEY_SQL}, {IOU_SQL}, f AS (
  SELECT m.lid, coalesce(known.id, CASE WHEN best.iou >= 0.5 THEN best.id END) AS id, CASE WHEN known.id IS NOT NULL THEN 'id' WHEN best.iou >= 0.5 THEN 'footprint' ELSE 'lost' END AS how
  FROM marks m LEFT JOIN known USING (lid) LEFT JOIN best USING (lid)
), locked AS (SELECT f.lid, f.id, how, CASE WHEN f.id IS NOT NULL THEN floor(coalesce(ov.iou, 0) * 1e6 + 0.5) / 1e6 END AS iou, coalesce(coalesce(ov.iou, CASE WHEN f.id IS NOT NULL THEN 0 END) < 0.9, true) AS keeps
  FROM f LEFT JOIN ov ON ov.lid = f.lid AND ov.id = f.id)"""


@query("k23_landmark_lock", f"WITH {LOCK_SQL} SELECT lid, id, how, iou, keeps FROM locked")
def landmark_lock(spark, sf_dir):
    found = landmarks.locks(*landmark_tables(spark, sf_dir), CELL)
    return found.withColumn("iou", six(F.col("iou")))


@query("k23_landmark_issues", f"WITH {LOCK_SQL} SELECT lid, CASE WHEN how = 'lost' THEN 'landmark_lost' ELSE 'landmark_footprint_changed' END AS issue_type FROM locked WHERE keeps")
def landmark_issues(spark, sf_dir):
    return landmarks.lock_issues(landmarks.locks(*landmark_tables(spark, sf_dir), CELL))


@query(
    "c20_drawn_on",
    """WITH t AS (SELECT o_orderkey AS k, CASE o_orderkey % 3 WHEN 0 THEN 'canonical' WHEN 1 THEN 'base' END AS kind, o_orderkey % 5 = 0 AS same, 'own/' || o_orderkey AS own, CASE WHEN o_custkey % 2 = 0 THEN 'found/' || o_orderkey END AS found,
      o_custkey % 3 = 0 AS ds, o_custkey % 4 > 0 AS later, CASE WHEN o_custkey % 5 > 1 THEN 'way/' || o_orderkey END AS osm FROM orders)
    SELECT k, CASE WHEN same THEN own WHEN kind = 'canonical' THEN coalesce(found, CASE WHEN ds AND later THEN own END) WHEN kind = 'base' THEN osm END AS id FROM t""",
)
def drawn_on(spark, sf_dir):
    """C20: landmarks by the file they are drawn on."""
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    named = lambda prefix: F.concat(F.lit(prefix), k.cast("string"))
    kind = F.when(k % 3 == 0, "canonical").when(k % 3 == 1, "base")
    made = landmarks.drawn_on(kind, k % 5 == 0, named("own/"), F.when(c % 2 == 0, named("found/")), c % 3 == 0, c % 4 > 0, F.when(c % 5 > 1, named("way/")))
    return table(spark, sf_dir, "orders").select(k.alias("k"), made.alias("id"))


@query("c21_without_hidden", "WITH h AS (SELECT DISTINCT c_custkey AS id FROM customer WHERE c_custkey % 9 = 0) SELECT o_orderkey FROM orders WHERE o_orderkey NOT IN (SELECT id FROM h) AND o_custkey NOT IN (SELECT id FROM h)")
def without_hidden(spark, sf_dir):
    """Extrusions without the buildings that models replace, and without their parts."""
    hidden = table(spark, sf_dir, "customer").where("c_custkey % 9 = 0").select(F.col("c_custkey").alias("id"))
    return landmarks.without_hidden(table(spark, sf_dir, "orders"), hidden, "o_orderkey", "o_custkey").select("o_orderkey")


@query(
    "k38_footprint_lookup",
    f"""WITH {BOXES_SQL}, p AS (SELECT CASE WHEN k % 2 = 0 THEN c ELSE k END AS id, CASE WHEN k % 3 = 1 THEN c + 1 END AS parent, area::DOUBLE AS area, (x0 + x1) / 2.0::DOUBLE * area AS mx, (y0 + y1) / 2.0::DOUBLE * area AS my, x0, y0, x1, y1, (c % 50)::DOUBLE AS height, (c % 9 - 4)::DOUBLE AS base FROM osm),
    w AS (SELECT c_custkey AS wid FROM customer), met AS (SELECT wid, 'id' AS matched, p.* FROM w JOIN p ON p.id = wid UNION ALL SELECT wid, 'parent', p.* FROM w JOIN p ON p.parent = wid AND p.id IS DISTINCT FROM wid),
    s AS (SELECT wid, matched, count(*) AS pieces, sum(area) AS area, sum(mx) / sum(area) AS cx, sum(my) / sum(area) AS cy, min(x0) AS x0, min(y0) AS y0, max(x1) AS x1, max(y1) AS y1, max(height) AS height, greatest(min(base), 0) AS base FROM met GROUP BY wid, matched)
    SELECT wid AS id, matched, pieces, area, floor(cx * 1e6 + 0.5) / 1e6 AS cx, floor(cy * 1e6 + 0.5) / 1e6 AS cy, x0, y0, x1, y1, height, base FROM (SELECT *, row_number() OVER (PARTITION BY wid ORDER BY matched) AS r FROM s) WHERE r = 1""",
)
def footprint_lookup(spark, sf_dir):
    """A building's own pieces, else those of its parts, as one footprint."""
    k, c, area = F.col("k"), F.col("c"), F.col("area").cast("double")
    b = osm_boxes(spark, sf_dir)
    pieces = b.select(
        F.when(k % 2 == 0, c).otherwise(k).alias("id"), F.when(k % 3 == 1, c + 1).alias("parent"), area.alias("area"),
        ((F.col("x0") + F.col("x1")) / 2 * area).alias("mx"), ((F.col("y0") + F.col("y1")) / 2 * area).alias("my"), "x0", "y0", "x1", "y1",
        (c % 50).cast("double").alias("height"), (c % 9 - 4).cast("double").alias("base"),
    )
    found = landmarks.footprints(table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id")), pieces)
    return found.withColumns({"cx": six(F.col("cx")), "cy": six(F.col("cy"))})


@query(
    "k39_use_periods",
    """WITH e AS (SELECT o_custkey AS lid, o_orderkey AS seq, CASE WHEN o_orderkey % 5 > 0 THEN 'use' ELSE 'edit' END AS action, CASE WHEN o_orderkey % 7 > 0 THEN o_orderkey % 4 END AS version, o_orderdate AS since FROM orders),
    u AS (SELECT *, lead(since) OVER (PARTITION BY lid ORDER BY seq) AS until FROM e WHERE action = 'use') SELECT lid, version, since, until FROM u WHERE version IS NOT NULL""",
)
def use_periods(spark, sf_dir):
    """When each version of a landmark was in use."""
    k = F.col("o_orderkey")
    events = table(spark, sf_dir, "orders").select(
        F.col("o_custkey").alias("lid"), k.alias("seq"), F.when(k % 5 > 0, "use").otherwise("edit").alias("action"), F.when(k % 7 > 0, k % 4).alias("version"), F.col("o_orderdate").alias("at")
    )
    return landmarks.use_periods(events)


@query(
    "k45_overlapping_lods",
    """WITH l AS (SELECT o_custkey AS lid, o_orderkey AS name, (o_orderkey % 17)::DOUBLE AS low, CASE WHEN o_orderkey % 6 > 0 THEN (o_orderkey % 17 + o_orderkey % 4)::DOUBLE END AS high FROM orders)
    SELECT x.lid, x.name AS a, y.name AS b FROM l x JOIN l y ON x.lid = y.lid AND x.name < y.name AND x.low < coalesce(y.high, 1e300) AND y.low < coalesce(x.high, 1e300)""",
)
def overlapping_lods(spark, sf_dir):
    """Levels of detail of one landmark that share a zoom."""
    k = F.col("o_orderkey")
    lods = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("lid"), k.alias("name"), (k % 17).cast("double").alias("low"), F.when(k % 6 > 0, (k % 17 + k % 4).cast("double")).alias("high"))
    return landmarks.overlapping_ranges(lods)


# ---- preparation and the final table --------------------------------------------------------------

AREA_SQL = """area AS (SELECT n_nationkey AS aid, n_nationkey * 113 % 2000 AS x0, n_nationkey * 71 % 2000 AS y0, n_nationkey * 113 % 2000 + 150 + n_nationkey * 97 AS x1, n_nationkey * 71 % 2000 + 90 AS y1 FROM nation WHERE n_nationkey % 6 = 1)"""


def area_boxes(spark, sf_dir):
    n = F.col("n_nationkey")
    x, y = n * 113 % 2000, n * 71 % 2000
    return table(spark, sf_dir, "nation").where("n_nationkey % 6 = 1").select(n.alias("aid"), x.alias("x0"), y.alias("y0"), (x + 150 + n * 97).alias("x1"), (y + 90).alias("y1"))


@query(
    "i23_area_squares",
    f"""WITH {AREA_SQL}, g AS (SELECT *, unnest(range(x0 // 500, x1 // 500 + 1)) AS gx FROM area), h AS (SELECT *, unnest(range(y0 // 500, y1 // 500 + 1)) AS gy FROM g)
    SELECT aid, gx, gy, greatest(x0, gx * 500)::DOUBLE AS x0, greatest(y0, gy * 500)::DOUBLE AS y0, least(x1, (gx + 1) * 500)::DOUBLE AS x1, least(y1, (gy + 1) * 500)::DOUBLE AS y1 FROM h
    WHERE greatest(x0, gx * 500) < least(x1, (gx + 1) * 500) AND greatest(y0, gy * 500) < least(y1, (gy + 1) * 500)""",
)
def area_squares(spark, sf_dir):
    """An area in squares."""
    cut = canonical.squares(area_boxes(spark, sf_dir), 500.0)
    return cut.select("aid", "gx", "gy", *[F.col(c).cast("double").alias(c) for c in ("x0", "y0", "x1", "y1")])


@query(
    "k11_prepared",
    f"""WITH {BOXES_SQL}, {AREA_SQL}, d AS (SELECT o.id, sqrt(pow(greatest(a.x0 - o.x1, o.x0 - a.x1, 0), 2) + pow(greatest(a.y0 - o.y1, o.y0 - a.y1, 0), 2)) AS d FROM osm o JOIN area a ON o.x0 <= a.x1 + 200 AND o.x1 >= a.x0 - 200 AND o.y0 <= a.y1 + 200 AND o.y1 >= a.y0 - 200)
    SELECT id, min(d) = 0 AS core FROM d WHERE d <= 200 GROUP BY id""",
)
def prepared(spark, sf_dir):
    """Footprints within 200 m of an area, by distance."""
    return canonical.prepared(osm_boxes(spark, sf_dir).select("id", "x0", "y0", "x1", "y1"), area_boxes(spark, sf_dir), 256.0).select("id", "core")


FINAL_SQL = f"""{BOXES_SQL}, c AS (SELECT id, k, c, CASE k % 3 WHEN 1 THEN 'osm' ELSE 'gob' END AS family, (c % 90)::DOUBLE AS h, area FROM osm)
SELECT 'b/' || c.k AS building_id, c.id AS source_id, c.h AS height_m, CASE WHEN c.c % 2 = 0 THEN 'osm_height' ELSE 'default' END AS height_provenance, 'line ' || c.c AS height_lineage, CASE c.family WHEN 'osm' THEN 'OSM' ELSE 'GOB' END AS winning_source, 'active' AS status,
  CASE WHEN c.k % 29 = 1 THEN 'manual' ELSE 'auto' END AS resolution_mode, CASE WHEN c.k % 29 = 1 THEN 'landmark' ELSE 'auto' END AS decided_by, 'x1' AS build_id, CASE WHEN c.c % 5 = 0 THEN (c.c % 7)::VARCHAR END AS min_height, CASE WHEN p.k IS NOT NULL THEN 'b/' || p.k END AS parent_building_id,
  CASE WHEN c.k % 11 > 0 THEN 'T' || (c.k % 11) END AS building_tier, CASE WHEN c.c % 13 > 0 THEN 'g/' || (c.c % 13) END AS group_id, 'v1' AS config_version,
  'Rule v1, build x1: footprint from ' || CASE c.family WHEN 'osm' THEN 'OSM' ELSE 'GOB' END || ', height from ' || CASE WHEN c.c % 2 = 0 THEN 'osm_height' ELSE 'default' END AS description, CASE WHEN c.c % 3 = 0 THEN 'house ' || c.c END AS name, c.c % 12 AS building_levels,
  floor(c.area / 7.0::DOUBLE * 10 + 0.5) / 10 AS footprint_area_m2, 'single_source' AS conflation_relation_type, floor(c.c % 17 / 17.0::DOUBLE * 1000 + 0.5) / 1000 AS group_iou, '["' || c.id || '"' || CASE WHEN c.c % 4 = 0 THEN ',"gob/' || c.k || '"' ELSE '' END || ']' AS source_ids,
  CASE WHEN c.c % 6 = 0 THEN 'low_group_iou,kept' ELSE '' END AS conflation_reasons, CASE WHEN c.k % 11 > 5 THEN 'minor_structure' ELSE '' END AS tier_flags
FROM c LEFT JOIN c p ON c.k % 10 = 2 AND p.id = 'way/' || (c.k - 1)"""


@query("k24_final_table", f"WITH {FINAL_SQL}")
def final_table(spark, sf_dir):
    """The published rows out of canon and its side tables."""
    b = osm_boxes(spark, sf_dir)
    k, c = F.col("k"), F.col("c")
    text = lambda prefix, x: F.concat(F.lit(prefix), x.cast("string"))
    none = F.expr("cast(array() as array<string>)")
    canon = b.select(
        "id", F.when(k % 3 == 1, "osm").otherwise("gob").alias("family"), (c % 90).cast("double").alias("height_m"), F.when(c % 2 == 0, "osm_height").otherwise("default").alias("height_provenance"), text("line ", c).alias("height_lineage"),
        F.when(c % 5 == 0, c % 7).alias("min_height_m"), F.when(c % 3 == 0, text("house ", c)).alias("name"), (c % 12).alias("levels"), (F.col("area") / 7.0).alias("area"), F.lit("single_source").alias("relation"), (c % 17 / 17.0).alias("group_iou"),
        F.when(c % 4 == 0, F.array(text("gob/", k))).otherwise(none).alias("evidence"), F.when(c % 6 == 0, F.array(F.lit("low_group_iou"), F.lit("kept"))).otherwise(none).alias("reasons"), (c % 13).alias("comp"),
    )
    ids = b.select("id", text("b/", k).alias("building_id"))
    tiers = b.where("k % 11 > 0").select("id", text("T", k % 11).alias("tier"), F.when(k % 11 > 5, F.array(F.lit("minor_structure"))).otherwise(none).alias("flags"))
    parents = b.where("k % 10 = 2").select("id", text("way/", k - 1).alias("parent"))
    groups = b.where("c % 13 > 0").select((c % 13).alias("comp"), text("g/", c % 13).alias("group_id")).distinct()
    out = canonical.final_table(canon, ids, b.where("k % 29 = 1").select("id"), tiers, parents, groups, "x1", "v1")
    return out.withColumn("conflation_reasons", F.coalesce("conflation_reasons", F.lit(""))).withColumn("tier_flags", F.coalesce("tier_flags", F.lit("")))


# ---- diff -----------------------------------------------------------------------------------------


@query(
    "k25_diff_load",
    """WITH s AS (SELECT o_orderkey AS bid, CASE WHEN o_orderkey % 3 > 0 THEN (o_custkey % 700)::DOUBLE END AS height, CASE WHEN o_custkey % 4 = 0 THEN o_orderkey % 260 END AS floors, CASE WHEN o_custkey % 5 = 0 THEN 'default' ELSE 'survey' END AS prov FROM orders),
    h AS (SELECT *, CASE WHEN prov = 'default' THEN NULL ELSE height END AS hv FROM s), v AS (SELECT *, coalesce(hv BETWEEN 2 AND 500, false) AS gh, coalesce(floors BETWEEN 1 AND 200, false) AS gl FROM h)
    SELECT bid, CASE WHEN gh THEN floor(hv * 10 + 0.5) / 10 WHEN gl THEN floor(floors * 3.5::DOUBLE * 10 + 0.5) / 10 ELSE 3.5 END AS h, gh OR gl AS real, (hv IS NOT NULL AND NOT gh) OR (floors IS NOT NULL AND NOT gl) AS outlier FROM v""",
)
def diff_load(spark, sf_dir):
    """Effective height, whether it is measured, and outliers of a side."""
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    side = table(spark, sf_dir, "orders").select(
        k.alias("bid"), F.when(k % 3 > 0, (c % 700).cast("double")).alias("height"), F.when(c % 4 == 0, k % 260).alias("floors"), F.when(c % 5 == 0, "default").otherwise("survey").alias("prov")
    )
    return D.loaded(side, HeightRule(placeholders=("default",)), "height", "floors", "prov").select("bid", "h", "real", "outlier")


@query(
    "k29_same_source",
    f"WITH {KEYED_SQL} SELECT sa.bid FROM sa JOIN st ON st.side = 'a' AND st.bid = sa.bid AND status = 'removed' WHERE sa.price::VARCHAR IN (SELECT sb.price::VARCHAR FROM sb JOIN st t ON t.side = 'b' AND t.bid = sb.bid AND t.status = 'added')",
)
def same_source(spark, sf_dir):
    """Removed buildings whose source id an added one has."""
    a, b, pairs_, _ = compared(spark, sf_dir)
    text = lambda df: df.withColumn("price", F.format_string("%.2f", "price"))
    return D.same_source(text(a), text(b), D.statuses(a, pairs_, "a"), D.statuses(b, pairs_, "b"), "price")


@query("g04_largest_removed", f"WITH {KEYED_SQL} SELECT sa.bid, sa.area FROM sa JOIN st ON st.side = 'a' AND st.bid = sa.bid AND status = 'removed' ORDER BY area DESC NULLS LAST, sa.bid LIMIT 50")
def largest_removed(spark, sf_dir):
    """Samples of removed buildings, the largest first."""
    a, _, pairs_, _ = compared(spark, sf_dir)
    return D.largest(a, D.statuses(a, pairs_, "a"), "removed", 50).select("bid", "area")


@query("g02_most_changed", f"WITH {KEYED_SQL} SELECT a, b, geom_class FROM cmp WHERE changed ORDER BY (geom_class = 'major') DESC, abs(coalesce(dh, 0)) DESC, floor(coalesce(area_pct, 0) * 1e6 + 0.5) DESC, a LIMIT 50")
def most_changed(spark, sf_dir):
    """Samples of changed buildings."""
    c = compared(spark, sf_dir)[3].withColumn("area_pct", F.floor(F.col("area_pct") * 1e6 + 0.5))
    return D.most_changed(c, 50).select("a", "b", "geom_class")


@query(
    "b02_change_files",
    f"""WITH {KEYED_SQL} SELECT 'added' AS file, bid FROM st WHERE side = 'b' AND status = 'added' UNION ALL SELECT 'removed', bid FROM st WHERE side = 'a' AND status = 'removed'
    UNION ALL SELECT 'changed', b FROM cmp WHERE changed UNION ALL SELECT 'changed_before', a FROM cmp WHERE changed
    UNION ALL SELECT 'map', bid FROM st WHERE (side = 'b' AND status = 'added') OR (side = 'a' AND status = 'removed') UNION ALL SELECT 'map', b FROM cmp WHERE changed""",
)
def change_files(spark, sf_dir):
    """The tables of the change files, one under the other."""
    a, b, pairs_, c = compared(spark, sf_dir)
    out = None
    for name, df in D.change_files(a, b, D.statuses(a, pairs_, "a"), D.statuses(b, pairs_, "b"), c).items():
        part = df.select(F.lit(name).alias("file"), "bid")
        out = part if out is None else out.unionByName(part)
    return out


# ---- polygons -------------------------------------------------------------------------------------

#: L-shapes: footprints without their upper right quarter, which SQL measures as two boxes.
ELLS_SQL = f"""{BOXES_SQL}, parts AS (
  SELECT 'osm' AS family, id, x0, y0, x1, y0 + (y1 - y0) // 2 AS y1 FROM osm UNION ALL SELECT 'osm', id, x0, y0 + (y1 - y0) // 2, x0 + (x1 - x0) // 2, y1 FROM osm
  UNION ALL SELECT 'gob', id, x0, y0, x1, y0 + (y1 - y0) // 2 FROM gob UNION ALL SELECT 'gob', id, x0, y0 + (y1 - y0) // 2, x0 + (x1 - x0) // 2, y1 FROM gob
), sized AS (SELECT family, id, sum((x1 - x0) * (y1 - y0)) AS area FROM parts GROUP BY family, id)"""


@F.pandas_udf(T.BinaryType())
def ell_wkb(x0: pd.Series, y0: pd.Series, x1: pd.Series, y1: pd.Series) -> pd.Series:
    xm, ym = x0 + (x1 - x0) // 2, y0 + (y1 - y0) // 2
    return pd.Series(rings_wkb(np.stack([np.stack(p, 1) for p in ((x0, y0), (x1, y0), (x1, ym), (xm, ym), (xm, y1), (x0, y1))], 1)), dtype=object)


def ells(df):
    half = lambda c: F.floor((F.col(f"{c}1") - F.col(f"{c}0")) / 2)
    area = (F.col("x1") - F.col("x0")) * half("y") + half("x") * (F.col("y1") - F.col("y0") - half("y"))
    return df.withColumn("area", area).withColumn("geometry", ell_wkb("x0", "y0", "x1", "y1"))


ELL_PAIRS_SQL = f"""{ELLS_SQL}, cut AS (
  SELECT a.id AS a, b.id AS b, sum((least(a.x1, b.x1) - greatest(a.x0, b.x0)) * (least(a.y1, b.y1) - greatest(a.y0, b.y0))) AS inter
  FROM parts a JOIN parts b ON a.family = 'osm' AND b.family = 'gob' AND a.x0 < b.x1 AND b.x0 < a.x1 AND a.y0 < b.y1 AND b.y0 < a.y1 GROUP BY a.id, b.id
), pairs AS (SELECT a, b, inter, inter::DOUBLE / (x.area + y.area - inter) AS iou, greatest(inter::DOUBLE / x.area, inter::DOUBLE / y.area) AS cov FROM cut JOIN sized x ON x.id = a JOIN sized y ON y.id = b)"""


@query("d01_polygon_pairs", f"WITH {ELL_PAIRS_SQL} SELECT a, b, inter::DOUBLE AS inter, floor(iou * 1e6 + 0.5) / 1e6 AS iou, iou >= 0.25 OR cov >= 0.40 AS is_merge FROM pairs")
def polygon_pairs(spark, sf_dir):
    """D01 / K13 on polygons: overlaps of L-shapes across families."""
    p = C.Params(min_area=0.0, min_confidence=0.0)
    obs = C.observations({"osm": ells(osm_boxes(spark, sf_dir)), "gob": ells(gob_boxes(spark, sf_dir))}, p)
    return C.overlap_pairs(obs, p).select("a", "b", F.round("inter", 6).alias("inter"), six(F.col("iou")).alias("iou"), "is_merge")


@query("d05_polygon_containers", f"WITH {ELLS_SQL}, {POINTS_SQL} SELECT DISTINCT pid, id FROM p JOIN parts ON family = 'osm' AND px > x0 AND px < x1 AND py > y0 AND py < y1")
def polygon_containers(spark, sf_dir):
    """D03 / D04 / D05 / D07 on polygons: points in L-shapes (points lie between the lines of their corners)."""
    found = containers(points(spark, sf_dir), ells(osm_boxes(spark, sf_dir)).select("id", "x0", "y0", "x1", "y1", "geometry"), CELL)
    return found.select(F.col("p_pid").alias("pid"), F.col("b_id").alias("id"))


@query("d02_polygon_semi_join", f"WITH {ELLS_SQL}, near AS (SELECT DISTINCT a.id FROM parts a JOIN parts b ON a.family = 'osm' AND b.family = 'gob' AND a.x0 < b.x1 AND b.x0 < a.x1 AND a.y0 < b.y1 AND b.y0 < a.y1) SELECT id FROM osm WHERE id NOT IN (SELECT id FROM near)")
def polygon_anti_join(spark, sf_dir):
    """D02 / D17 on polygons: L-shapes that overlap none of the other family."""
    shape = ["id", "x0", "y0", "x1", "y1", "geometry"]
    osm = ells(osm_boxes(spark, sf_dir)).select(*shape)
    hit = overlaps(osm, ells(gob_boxes(spark, sf_dir)).select(*shape), CELL).select(F.col("a_id").alias("id"))
    return osm.select("id").join(hit, "id", "left_anti")


# ---- formats --------------------------------------------------------------------------------------


@query("i10_utm_round_trip", "SELECT o_orderkey, floor((105.0 + o_orderkey % 1000 / 1000.0) * 1e6 + 0.5) / 1e6 AS lon, floor((21.0 + o_custkey % 100 / 100.0) * 1e6 + 0.5) / 1e6 AS lat FROM orders")
def utm_round_trip(spark, sf_dir):
    """To UTM and back again."""
    lon, lat = 105.0 + F.col("o_orderkey") % 1000 / 1000.0, 21.0 + F.col("o_custkey") % 100 / 100.0
    east, north = G.utm_forward(lon, lat)
    there = table(spark, sf_dir, "orders").select("o_orderkey", east.alias("east"), north.alias("north"), G.utm_zone(lon).alias("zone"))
    back = G.utm_inverse(F.col("east"), F.col("north"), F.col("zone"))
    return there.select("o_orderkey", *[six(x).alias(n) for x, n in zip(back, ("lon", "lat"))])


@query(
    "j28_colours",
    """WITH t AS (SELECT c_custkey, c_custkey * 7 % 256 AS r, c_custkey * 11 % 256 AS g, c_custkey * 13 % 256 AS b FROM customer)
    SELECT c_custkey, CASE c_custkey % 4 WHEN 3 THEN NULL ELSE '#' || lpad(lower(to_hex(r)), 2, '0') || lpad(lower(to_hex(g)), 2, '0') || lpad(lower(to_hex(b)), 2, '0') END AS colour FROM t""",
)
def colours(spark, sf_dir):
    """Colours in several notations as one."""
    k = F.col("c_custkey")
    r, g, b = (k * m % 256 for m in (7, 11, 13))
    two = lambda x: F.lpad(F.hex(x.cast("long")), 2, "0")
    text = (
        F.when(k % 4 == 0, F.concat(F.lit("#"), two(r), two(g), two(b)))
        .when(k % 4 == 1, F.concat(F.lit(" rgb("), F.concat_ws(", ", *[x.cast("string") for x in (r, g, b)]), F.lit(")")))
        .when(k % 4 == 2, F.concat(F.lit("RGBA("), F.concat_ws(" ", *[x.cast("string") for x in (r, g, b)]), F.lit(" / 100%)")))
        .otherwise(F.concat(F.lit("#12"), (k % 10).cast("string"), F.lit("4567")))
    )
    return table(spark, sf_dir, "customer").select("c_custkey", formats.colour_text(formats.colour(text)).alias("colour"))


@query(
    "j30_hexagon_cells",
    """WITH t AS (SELECT o_orderkey, (576460752303423488 + (o_custkey % 16) * 4503599627370496 + (o_orderkey % 128) * 35184372088832 + (35184372088831 - CASE WHEN o_orderkey % 3 = 0 THEN (o_custkey % 7) * 4398046511104 ELSE 0 END)) AS v FROM orders),
    d AS (SELECT o_orderkey, v, (v >> 52) & 15 AS res, (v >> 45) & 127 AS base, list_transform(range(15), lambda k: (v >> (42 - 3 * k)) & 7) AS d FROM t)
    SELECT o_orderkey, CASE WHEN base < 122 AND len(list_filter(d[1:res], lambda x: x = 7)) = 0 AND len(list_filter(d[res + 1:15], lambda x: x <> 7)) = 0
      AND NOT (base IN (4, 14, 24, 38, 49, 58, 63, 72, 83, 97, 107, 117) AND res > 0 AND coalesce(list_filter(d[1:res], lambda x: x <> 0)[1] = 1, false)) THEN res::INTEGER END AS resolution FROM d""",
)
def hexagon_cells(spark, sf_dir):
    """Validity and resolution of hexagon cell ids."""
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    v = F.lit(576460752303423488) + (c % 16) * 4503599627370496 + (k % 128) * 35184372088832 + (F.lit(35184372088831) - F.when(k % 3 == 0, (c % 7) * 4398046511104).otherwise(0))
    cell = F.lpad(F.lower(F.hex(v)), 15, "0")
    return table(spark, sf_dir, "orders").select("o_orderkey", formats.hex_cell_resolution(cell).alias("resolution"))


@query(
    "j14_time_ordered_ids",
    """WITH t AS (SELECT o_orderkey, lpad(lower(to_hex(1700000000000 + o_orderkey)), 12, '0') AS t, md5(o_orderkey::VARCHAR) AS h FROM orders)
    SELECT o_orderkey, t[1:8] || '-' || t[9:12] || '-7' || h[1:3] || '-' || substr('89ab', ('0x' || h[4:4])::INT % 4 + 1, 1) || h[5:7] || '-' || h[8:19] AS uuid FROM t""",
)
def time_ordered_ids(spark, sf_dir):
    """Ids of a time and random digits."""
    k = F.col("o_orderkey")
    return table(spark, sf_dir, "orders").select("o_orderkey", formats.uuid7(F.lit(1700000000000) + k, F.md5(k.cast("string").cast("binary"))).alias("uuid"))


@query(
    "j12_labels",
    "WITH t AS (SELECT p_partkey, p_partkey % 18278 AS n, p_name FROM part) SELECT p_partkey, CASE WHEN n >= 702 THEN chr((((n // 26 - 1) // 26 - 1) % 26 + 65)::INT) ELSE '' END || CASE WHEN n >= 26 THEN chr(((n // 26 - 1) % 26 + 65)::INT) ELSE '' END || chr((n % 26 + 65)::INT) AS letters, regexp_replace(regexp_replace(p_name, '[^\\p{L}\\p{N}._-]+', '_', 'g'), '^[._]+|[._]+$', '', 'g') AS file FROM t",
)
def labels(spark, sf_dir):
    """Sheet columns and file names."""
    return table(spark, sf_dir, "part").select("p_partkey", formats.column_letter(F.col("p_partkey") % 18278).alias("letters"), formats.safe_name(F.col("p_name")).alias("file"))


@query("j32_extents", f"WITH {BOXES_SQL} SELECT id, x0 - 200 >= -180 AND x1 - 200 <= 180 AND y0 - 100 >= -90 AND y1 - 100 <= 90 AS degrees FROM osm")
def extents(spark, sf_dir):
    """Could an extent be in degrees?"""
    return osm_boxes(spark, sf_dir).select("id", formats.looks_like_degrees(F.col("x0") - 200, F.col("y0") - 100, F.col("x1") - 200, F.col("y1") - 100).alias("degrees"))


# ---- sources and tile pieces ----------------------------------------------------------------------


@query("a17_resolved_columns", "SELECT c_custkey AS id, c_acctbal AS height, NULL::INTEGER AS floors FROM customer")
def resolved_columns(spark, sf_dir):
    """A table read by what its columns may be called."""
    wanted = {"id": ("ID", "C_CustKey"), "height": ("h", "Height", "c_acctbal", "c_name"), "floors": ("levels", "floors")}
    return sources.resolved(table(spark, sf_dir, "customer"), wanted, ("id",)).withColumn("floors", F.col("floors").cast("int"))


@query("a18_places", "SELECT s_suppkey AS id, s_name AS category FROM supplier WHERE s_suppkey % 5 > 0 AND NOT coalesce(s_suppkey % 7 = 0 AND s_suppkey % 2 = 0, false)")
def places(spark, sf_dir):
    """Places with their required columns and without deleted ones."""
    k = F.col("s_suppkey")
    rows = table(spark, sf_dir, "supplier").select(k.alias("id"), F.when(k % 5 > 0, F.col("s_name")).alias("category"), F.when(k % 2 == 0, k % 7 == 0).alias("gone"))
    return sources.places(rows, ("id", "category"), "gone").select("id", "category")


@query(
    "i18_edge_extents",
    f"""WITH {BOXES_SQL}, t AS (SELECT id, x0, y0, x1, y1, unnest(range(x0 // 64, (x1 - 1) // 64 + 1)) AS tx FROM osm), u AS (SELECT *, unnest(range(y0 // 64, (y1 - 1) // 64 + 1)) AS ty FROM t),
    p AS (SELECT id, tx, ty, greatest(x0, tx * 64)::DOUBLE AS a, least(x1, tx * 64 + 64)::DOUBLE AS b, greatest(y0, ty * 64)::DOUBLE AS c, least(y1, ty * 64 + 64)::DOUBLE AS d FROM u)
    SELECT id, tx, ty, CASE WHEN a = tx * 64 THEN c END AS w0, CASE WHEN a = tx * 64 THEN d END AS w1, CASE WHEN b = tx * 64 + 64 THEN c END AS e0, CASE WHEN b = tx * 64 + 64 THEN d END AS e1,
      CASE WHEN c = ty * 64 THEN a END AS s0, CASE WHEN c = ty * 64 THEN b END AS s1, CASE WHEN d = ty * 64 + 64 THEN a END AS n0, CASE WHEN d = ty * 64 + 64 THEN b END AS n1 FROM p""",
)
def tile_edges(spark, sf_dir):
    """Where clipped pieces touch the sides of their tiles."""
    cut = lambda lo, hi: F.sequence(F.floor(F.col(lo) / 64), F.floor((F.col(hi) - 1) / 64))
    p = osm_boxes(spark, sf_dir).withColumn("tx", F.explode(cut("x0", "x1"))).withColumn("ty", F.explode(cut("y0", "y1")))
    west, south = F.col("tx") * 64, F.col("ty") * 64
    piece = box_wkb(F.greatest("x0", west), F.greatest("y0", south), F.least("x1", west + 64), F.least("y1", south + 64))
    side = edge_extents(piece, west, south, west + 64, south + 64)
    return p.select("id", "tx", "ty", side.alias("e")).select("id", "tx", "ty", "e.*")
