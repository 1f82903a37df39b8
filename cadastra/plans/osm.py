"""OSM buildings: parts to their outlines, classes, and the Overture form of the same."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cadastra.functions.tags import building_attributes, kind, osm_record_id, record_version
from cadastra.operators.cells import point_in_box


def classified(features: DataFrame, m_per_level: float = 3.5) -> DataFrame:
    """Features (id, tags, ...) with kind and attributes; what is neither building nor part goes."""
    made = building_attributes(F.col("tags"), m_per_level)
    out = features.withColumn("kind", kind(F.col("tags"))).where("kind is not null")
    return out.withColumns(made)


def assembled(raw: DataFrame, cell: float) -> DataFrame:
    """Rows (id, kind, class, area, px, py, x0, y0, x1, y1) with parent: the smallest outline around a part's inner point.

    A part takes its building's class. A part in no outline stays a building.
    """
    outlines = raw.where("kind = 'building'").select("id", "class", "area", "x0", "y0", "x1", "y1")
    parts = raw.where("kind = 'part'").select("id", "px", "py")
    inside = point_in_box(parts, outlines, cell).groupBy(F.col("p_id").alias("id")).agg(F.min(F.struct("b_area", "b_id", "b_class")).alias("m"))
    up = inside.select("id", F.col("m.b_id").alias("parent"), F.col("m.b_class").alias("up_class"))
    return raw.join(up, "id", "left").withColumn("class", F.when(F.col("parent").isNotNull(), F.col("up_class")).otherwise(F.col("class"))).drop("up_class")


def osm_source(sources: str = "sources"):
    """The first source entry that is OSM; null where there is none."""
    return F.get(F.filter(F.col(sources), lambda s: s["dataset"] == "OpenStreetMap"), F.lit(0))


def overture_buildings(buildings: DataFrame, parts: DataFrame) -> DataFrame:
    """Buildings and parts of OSM origin under their OSM ids; parts point to the building they belong to.

    An id that is both is a building. Underground ones are left out.
    """
    above = lambda df: df.where(~F.coalesce("is_underground", F.lit(False))).withColumn("__s", osm_source())
    common = [
        osm_record_id(F.col("__s.record_id")).alias("building_id"),
        record_version(F.col("__s.record_id")).alias("osm_version"),
        F.col("names.primary").alias("name"),
        "height",
        "num_floors",
        "min_height",
        "geometry",
    ]
    b = above(buildings).select("id", F.col("class"), *common, F.lit(None).cast("string").alias("parent_building_id"), F.lit(0).alias("rank")).where("building_id is not null")
    owner = b.select(F.col("id").alias("owner"), F.col("building_id").alias("parent_building_id"))
    p = above(parts).select(F.col("building_id").alias("owner"), F.lit(None).cast("string").alias("class"), *common, F.lit(1).alias("rank")).where("building_id is not null")
    p = p.join(owner, "owner")
    columns = ["building_id", "parent_building_id", "osm_version", "name", "class", "height", "num_floors", "min_height", "geometry", "rank"]
    both = b.select(*columns).unionByName(p.select(*columns))
    best = both.groupBy("building_id").agg(F.min_by(F.struct(*columns[1:]), F.struct("rank", "osm_version", "parent_building_id")).alias("r"))
    return best.select("building_id", "r.*").drop("rank")


def boundary(divisions: DataFrame, country: str, region: str) -> DataFrame:
    """The largest land area of a region; one row."""
    d = divisions.where((F.col("country") == country) & (F.col("region") == region) & (F.col("subtype") == "region") & (F.col("class") == "land"))
    size = (F.col("bbox.xmax") - F.col("bbox.xmin")) * (F.col("bbox.ymax") - F.col("bbox.ymin"))
    return d.orderBy(size.desc(), "id").limit(1)
