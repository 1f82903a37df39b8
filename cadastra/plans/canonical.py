"""The ends of a canonical build: what goes into it, and the table that comes out."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cadastra.operators.cells import box_join

# Names of the sources in the final table, the margin around the area, the side of its squares.
WINNING_SOURCE = {"osm": "OSM", "gob": "GOB", "gba_ms": "GBA", "landmark": "LANDMARK"}
AOI_MARGIN_M, SQUARE_M = 200.0, 2000.0


def squares(area: DataFrame, side: float = SQUARE_M) -> DataFrame:
    """Boxes (x0, y0, x1, y1, any columns) cut at the lines of a grid of that side; pieces without extent are left out."""
    span = lambda a, b: F.sequence(F.floor(F.col(a) / side).cast("long"), F.floor(F.col(b) / side).cast("long"))
    out = area.withColumn("gx", F.explode(span("x0", "x1"))).withColumn("gy", F.explode(span("y0", "y1")))
    cut = {c: F.greatest(F.col(c), F.col(g) * side) for c, g in (("x0", "gx"), ("y0", "gy"))}
    cut |= {c: F.least(F.col(c), (F.col(g) + 1) * side) for c, g in (("x1", "gx"), ("y1", "gy"))}
    return out.withColumns(cut).where("x0 < x1 and y0 < y1")


def prepared(obs: DataFrame, area: DataFrame, cell: float, margin: float = AOI_MARGIN_M) -> DataFrame:
    """Observations (id, x0..y1, any columns) not farther than margin from the area's boxes; `core` tells those that touch it.

    The distance is tested box by box, so no buffered outline is made; the area is cut into squares first, which
    bounds the cells that one of its boxes is in.
    """
    grown = squares(area.select("x0", "y0", "x1", "y1")).select(
        *[(F.col(c) + d * margin).alias(c) for c, d in (("x0", -1), ("y0", -1), ("x1", 1), ("y1", 1))]
    )
    met = box_join(obs.select("id", "x0", "y0", "x1", "y1"), grown, cell, touching=True)
    gap = lambda a, b: F.greatest(F.col(f"b_{a}") + margin - F.col(f"a_{b}"), F.col(f"a_{a}") - (F.col(f"b_{b}") - margin), F.lit(0.0))
    far = F.sqrt(F.pow(gap("x0", "x1"), 2) + F.pow(gap("y0", "y1"), 2))
    near = met.withColumn("far", far).where(F.col("far") <= margin).groupBy(F.col("a_id").alias("id")).agg((F.min("far") == 0).alias("core"))
    return obs.join(near, "id")


def final_table(canon: DataFrame, ids: DataFrame, locked: DataFrame, tiers: DataFrame, parents: DataFrame, groups: DataFrame, build: str, config: str) -> DataFrame:
    """The published rows: canon with its id, tier, parent's id, group and what is said about their making.

    canon: id, family, height_m, height_provenance, height_lineage, min_height_m, name, levels, area, relation,
    group_iou, evidence, reasons, comp. ids: id, building_id. locked: id. tiers: id, tier, flags. parents: id, parent.
    groups: comp, group_id. Side tables have a row per key at most; what they lack is null, and a footprint without
    an id is left out.
    """
    source = F.create_map(*[F.lit(x) for pair in WINNING_SOURCE.items() for x in pair])[F.col("family")]
    manual = F.col("lid").isNotNull()
    of = ids.select(F.col("id").alias("parent"), F.col("building_id").alias("parent_building_id"))
    up = parents.select("id", "parent").join(of, "parent").select("id", "parent_building_id")
    out = canon.join(ids, "id").join(locked.select("id", F.col("id").alias("lid")), "id", "left").join(tiers, "id", "left")
    out = out.join(up, "id", "left").join(groups, "comp", "left")
    rule = F.lit(f"Rule {config}, build {build}: footprint from ")
    return out.select(
        "building_id",
        F.col("id").alias("source_id"),
        "height_m",
        "height_provenance",
        "height_lineage",
        source.alias("winning_source"),
        F.lit("active").alias("status"),
        F.when(manual, "manual").otherwise("auto").alias("resolution_mode"),
        F.when(manual, "landmark").otherwise("auto").alias("decided_by"),
        F.lit(build).alias("build_id"),
        F.col("min_height_m").cast("string").alias("min_height"),
        "parent_building_id",
        F.col("tier").alias("building_tier"),
        "group_id",
        F.lit(config).alias("config_version"),
        F.concat(rule, source, F.lit(", height from "), "height_provenance").alias("description"),
        "name",
        F.col("levels").alias("building_levels"),
        (F.floor(F.col("area") * 10 + 0.5) / 10).alias("footprint_area_m2"),
        F.col("relation").alias("conflation_relation_type"),
        (F.floor(F.col("group_iou") * 1000 + 0.5) / 1000).alias("group_iou"),
        F.to_json(F.array_prepend("evidence", F.col("id"))).alias("source_ids"),
        F.array_join("reasons", ",").alias("conflation_reasons"),
        F.array_join("flags", ",").alias("tier_flags"),
    )
