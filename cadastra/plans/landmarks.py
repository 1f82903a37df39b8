"""Landmarks: their buildings in a build, look-ups, use periods, levels of detail."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from cadastra.operators.cells import box_join
from cadastra.operators.staging import stage

# Least agreement to be the landmark's building, and to take its new footprint.
LOCK_IOU, KEEP_IOU = 0.5, 0.9
SAME_ANCHOR_M = 1.0


def by_key(marks: DataFrame, canon: DataFrame) -> DataFrame:
    """marks (lid, keys array), canon (id, evidence array) -> lid, id: the footprint of one of the keys.

    A footprint whose own id is a key comes before one that has a key as evidence; then the smallest id.
    """
    wanted = marks.select("lid", F.explode("keys").alias("k")).distinct()
    own = canon.select(F.col("id").alias("k"), "id", F.lit(0).alias("rank"))
    shown = canon.select(F.explode("evidence").alias("k"), "id", F.lit(1).alias("rank"))
    hit = wanted.join(own.unionByName(shown), "k")
    return hit.groupBy("lid").agg(F.min(F.struct("rank", "id")).alias("m")).select("lid", F.col("m.id").alias("id"))


def overlap_iou(marks: DataFrame, canon: DataFrame, cell: float) -> DataFrame:
    """lid, id, iou of all footprints that overlap a landmark's box."""
    pairs = box_join(marks.select("lid", "x0", "y0", "x1", "y1"), canon.select("id", "x0", "y0", "x1", "y1"), cell).where("inter > 0")
    area = lambda s: (F.col(f"{s}_x1") - F.col(f"{s}_x0")) * (F.col(f"{s}_y1") - F.col(f"{s}_y0"))
    return pairs.select(F.col("a_lid").alias("lid"), F.col("b_id").alias("id"), (F.col("inter") / (area("a") + area("b") - F.col("inter"))).alias("iou"))


def best_overlap(pairs: DataFrame) -> DataFrame:
    """lid, id, iou: the footprint of the highest IoU; of equal ones the smallest id."""
    best = pairs.groupBy("lid").agg(F.max(F.struct("iou", F.struct("id").alias("i"))).alias("m"), F.max("iou").alias("top"))
    tied = pairs.join(best.select("lid", "top"), "lid").where("iou = top")
    return tied.groupBy("lid").agg(F.min("id").alias("id"), F.max("iou").alias("iou"))


def locks(marks: DataFrame, canon: DataFrame, cell: float) -> DataFrame:
    """lid, id, how (id, footprint, lost), iou, keeps: the building that each landmark stands on.

    marks: lid, keys, x0..y1; canon: id, evidence, x0..y1. A known key decides, else the best overlap from LOCK_IOU;
    a landmark without either is lost. It keeps its own footprint where it is lost or the building's overlaps
    it by less than KEEP_IOU.
    """
    pairs = stage(overlap_iou(marks, canon, cell), "landmark-overlaps")
    known = by_key(marks, canon).withColumnRenamed("id", "known")
    best = best_overlap(pairs).where(F.col("iou") >= LOCK_IOU).select("lid", F.col("id").alias("near"))
    found = marks.select("lid").distinct().join(known, "lid", "left").join(best, "lid", "left")
    how = F.when(F.col("known").isNotNull(), "id").when(F.col("near").isNotNull(), "footprint").otherwise("lost")
    found = found.select("lid", F.coalesce("known", "near").alias("id"), how.alias("how")).join(pairs, ["lid", "id"], "left")
    iou = F.when(F.col("id").isNotNull(), F.coalesce("iou", F.lit(0.0)))
    return found.select("lid", "id", "how", iou.alias("iou"), F.coalesce(iou < KEEP_IOU, F.lit(True)).alias("keeps"))


def lock_issues(locked: DataFrame) -> DataFrame:
    """lid, issue_type of landmarks that keep their own footprint."""
    kind = F.when(F.col("how") == "lost", "landmark_lost").otherwise("landmark_footprint_changed")
    return locked.where("keeps").select("lid", kind.alias("issue_type"))


def drawn_on(kind: Column, same_file: Column, own_id: Column, found_id: Column, same_dataset: Column, later: Column, osm_id: Column) -> Column:
    """The id under which a landmark is drawn on a file; null where it does not stand there.

    On the file that it was registered from: its own. On a canonical build: what the build found, else its own if it
    was registered later in the same dataset. On the base: its OSM id.
    """
    canonical = F.coalesce(found_id, F.when(same_dataset & later, own_id))
    return F.when(same_file, own_id).when(kind == "canonical", canonical).when(kind == "base", osm_id)


def without_hidden(buildings: DataFrame, hidden: DataFrame, id_col: str = "id", parent_col: str | None = None) -> DataFrame:
    """Buildings without those that a model replaces (hidden: id), and without the parts of these."""
    gone = hidden.select(F.col("id").cast("string").alias("__gone")).distinct()
    out = buildings.join(gone, buildings[id_col].cast("string") == F.col("__gone"), "left_anti")
    return out if parent_col is None else out.join(gone, out[parent_col].cast("string") == F.col("__gone"), "left_anti")


def footprints(wanted: DataFrame, pieces: DataFrame) -> DataFrame:
    """wanted (id), pieces (id, parent, area, mx, my, x0..y1, height, base) -> id, matched, pieces, area, cx, cy, box, height, base.

    The pieces of the building itself, else those of its parts. mx and my are first moments, so that the centroid is
    that of all pieces; the base is the lowest, but not below 0.
    """
    want = wanted.select(F.col("id").alias("wid")).distinct()
    own = want.join(pieces, F.col("wid") == F.col("id")).withColumn("matched", F.lit("id"))
    parts = want.join(pieces, F.col("wid") == F.col("parent")).where(~F.col("id").eqNullSafe(F.col("wid"))).withColumn("matched", F.lit("parent"))
    sums = own.unionByName(parts).groupBy("wid", "matched").agg(
        F.count(F.lit(1)).alias("pieces"),
        *[F.sum(c).alias(c) for c in ("area", "mx", "my")],
        *[F.min(c).alias(c) for c in ("x0", "y0", "base")],
        *[F.max(c).alias(c) for c in ("x1", "y1", "height")],
    )
    first = sums.groupBy("wid").agg(F.min_by(F.struct(*[c for c in sums.columns if c != "wid"]), "matched").alias("m")).select("wid", "m.*")
    middle = lambda m: F.when(F.col("area") > 0, F.col(m) / F.col("area"))
    return first.select(
        F.col("wid").alias("id"), "matched", "pieces", "area", middle("mx").alias("cx"), middle("my").alias("cy"), "x0", "y0", "x1", "y1", "height",
        F.greatest(F.coalesce("base", F.lit(0.0)), F.lit(0.0)).alias("base"),
    )


def use_periods(events: DataFrame) -> DataFrame:
    """events (lid, seq, action, version, at) -> lid, version, since, until: when each version was in use; until null: still."""
    order = W.partitionBy("lid").orderBy("seq")
    used = events.where("action = 'use'").withColumn("until", F.lead("at").over(order))
    return used.where("version is not null").select("lid", "version", F.col("at").alias("since"), "until")


def overlapping_ranges(lods: DataFrame) -> DataFrame:
    """lods (lid, name, low, high; high null: open) -> lid, a, b: levels of detail that share a zoom."""
    end = lambda c: F.coalesce(F.col(c), F.lit(float("inf")))
    x = lods.select("lid", F.col("name").alias("a"), F.col("low").alias("a0"), end("high").alias("a1"))
    y = lods.select("lid", F.col("name").alias("b"), F.col("low").alias("b0"), end("high").alias("b1"))
    return x.join(y, "lid").where((F.col("a") < F.col("b")) & (F.col("a0") < F.col("b1")) & (F.col("b0") < F.col("a1"))).select("lid", "a", "b")


def checked_placement(heading: Column, scale: Column, lon: Column, lat: Column, max_scale: float = 1000.0) -> Column:
    """struct(heading in [0, 360), lon, lat) of a usable placement, else null."""
    turn = F.pmod(F.round(heading, 3), F.lit(360.0))
    good = (scale > 0) & (scale <= max_scale) & lon.between(-180, 180) & lat.between(-85, 85) & heading.isNotNull()
    return F.when(good, F.struct(turn.alias("heading"), F.round(lon, 8).alias("lon"), F.round(lat, 8).alias("lat")))
