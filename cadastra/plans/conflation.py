"""Conflation of footprint sources: overlap graph, components, winners and evidence, heights.

Footprints are boxes (x0, y0, x1, y1 and area), or polygons with a column geometry (WKB) beside the box: the
box finds the pairs, and the kernels of cadastra.functions.geometry measure overlaps and unions.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cadastra.functions.geometry import box_union_area, intersection, read_wkb, union
from cadastra.operators.cells import box_join
from cadastra.operators.graph import connected_components
from cadastra.operators.staging import stage
from cadastra.plans.polygons import overlaps

# Families by precedence, and severities of review issues.
FAMILIES = ("osm", "gob", "gba_ms")
SEVERITY = {"ambiguous": "high", "split": "medium", "aggregate": "medium", "large_footprint": "medium", "coverage_gap": "low"}


@dataclass(frozen=True)
class Params:
    """One configuration; the defaults are fixed values."""

    min_confidence: float = 0.75
    min_area: float = 10.0
    large_area: float = 5000.0
    merge_iou: float = 0.25
    merge_coverage: float = 0.40
    one_to_one_iou: float = 0.50
    trust_iou: float = 0.80
    partial_iou: float = 0.10
    partial_coverage: float = 0.20
    height_iou: float = 0.50
    centroid_scale: float = 20.0
    m_per_level: float = 3.5
    default_height: float = 3.5
    min_height: float = 2.0
    max_height: float = 500.0
    max_levels: float = 100.0
    cell: float = 32.0


#: Versions of the configuration; a published version is never changed.
CONFIGS = {"v1": Params()}


def config(version: str) -> Params:
    if version not in CONFIGS:
        raise ValueError(f"unknown configuration {version}; there are {', '.join(sorted(CONFIGS))}")
    return CONFIGS[version]


def observations(sources: dict[str, DataFrame], p: Params) -> DataFrame:
    """id, family, rank, area and box of all usable footprints of all sources."""
    out = None
    for rank, family in enumerate(FAMILIES, 1):
        if family not in sources:
            continue
        df = sources[family]
        if "confidence" in df.columns:
            df = df.where(F.col("confidence") >= p.min_confidence)
        if family != FAMILIES[0]:
            df = df.where(F.col("area") >= p.min_area)
        shape = ["geometry"] if "geometry" in df.columns else []
        rows = df.select("id", F.lit(family).alias("family"), F.lit(rank).alias("rank"), "area", "x0", "y0", "x1", "y1", *shape)
        out = rows if out is None else out.unionByName(rows)
    return out


def pair_metrics(pairs: DataFrame, p: Params) -> DataFrame:
    """iou, coverages, area similarity, centroid proximity, score and is_merge of pairs (inter, area_a, area_b, cdist)."""
    inter, a, b = F.col("inter"), F.col("area_a"), F.col("area_b")
    near = F.greatest(F.lit(0.0), 1 - F.col("cdist") / p.centroid_scale)
    out = pairs.withColumns({"iou": inter / (a + b - inter), "cov_a": inter / a, "cov_b": inter / b, "area_sim": 1 - F.abs(a - b) / F.greatest(a, b), "cprox": near})
    out = out.withColumn("is_merge", (F.col("iou") >= p.merge_iou) | (F.greatest("cov_a", "cov_b") >= p.merge_coverage))
    return out.withColumn("match_score", 0.5 * F.col("iou") + 0.25 * F.col("area_sim") + 0.25 * F.col("cprox"))


def overlap_pairs(obs: DataFrame, p: Params) -> DataFrame:
    """Every overlap between families, a of the higher precedence."""
    out = None
    present = [f for f in FAMILIES]
    for i, fa in enumerate(present):
        later = present[i + 1 :]
        if not later:
            break
        join = overlaps if "geometry" in obs.columns else box_join
        part = join(obs.where(F.col("family") == fa), obs.where(F.col("family").isin(*later)), p.cell).where(F.col("inter") > 0.01)
        out = part if out is None else out.unionByName(part)
    middle = lambda s, c: (F.col(f"{s}_{c}0") + F.col(f"{s}_{c}1")) / 2
    dist = F.sqrt(F.pow(middle("a", "x") - middle("b", "x"), 2) + F.pow(middle("a", "y") - middle("b", "y"), 2))
    rows = out.select(F.col("a_id").alias("a"), F.col("b_id").alias("b"), "inter", F.col("a_area").alias("area_a"), F.col("b_area").alias("area_b"), dist.alias("cdist"))
    return pair_metrics(rows, p)


def resolve(obs: DataFrame, pairs: DataFrame, p: Params) -> tuple[DataFrame, DataFrame]:
    """(groups, membership) of the components of the merge graph.

    In each round the highest family of a component wins and the others are evidence, attached to the winner
    they overlap most. Evidence that overlaps no winner forms components of its own in the next round; a round
    removes a family, so there are no more rounds than families.
    """
    nodes = obs.select("id", "rank", "area")
    merge = pairs.where("is_merge").select("a", "b")
    edges, groups, members = stage(merge, "merge-edges"), None, None
    left = None
    for r in range(len(FAMILIES)):
        comps = connected_components(edges)
        if left is not None:  # evidence without edges is a component of its own
            comps = left.join(comps, "id", "left").select("id", F.coalesce("comp", "id").alias("comp"))
        placed = stage(comps.join(nodes, "id"), "placed")
        top = placed.groupBy("comp").agg(F.min("rank").alias("top"))
        placed = placed.join(top, "comp").withColumn("wins", F.col("rank") == F.col("top"))
        family = placed.groupBy("comp", "rank", "wins").agg(F.count(F.lit(1)).alias("n"))
        shape = family.groupBy("comp").agg(
            F.sum(F.when(F.col("wins"), F.col("n")).otherwise(0)).alias("winners"),
            F.sum(F.when(~F.col("wins"), F.col("n")).otherwise(0)).alias("evidence"),
            F.coalesce(F.max(F.when(~F.col("wins"), F.col("n"))), F.lit(0)).alias("most"),
        )
        many, single = F.col("most") >= 2, F.col("winners") == 1
        relation = (
            F.when(F.col("evidence") == 0, "single_source")
            .when(single & ~many, "one_to_one")
            .when(~many, "aggregate")
            .when(single, "split")
            .otherwise("ambiguous")
        )
        gid = F.concat(F.lit(f"{r}:"), F.col("comp"))
        new_groups = stage(shape.select(gid.alias("gid"), "comp", relation.alias("relation"), F.lit(r > 0).alias("gap"), "winners", "evidence"), "groups")
        winners = placed.where("wins").select("id", "comp", "area")
        others = placed.where("not wins").select("id", "comp")
        touching = pairs.select("a", "b", "inter").join(winners.select(F.col("id").alias("a"), "comp", "area"), "a").join(others.select(F.col("id").alias("b"), "comp"), ["b", "comp"])
        best = touching.groupBy("b").agg(F.min(F.struct(-F.col("inter"), "area", "a")).alias("m"), F.first("comp").alias("comp"))
        attached = best.select(F.col("b").alias("id"), gid.alias("gid"), F.lit("evidence").alias("role"), F.col("m.a").alias("winner"), (-F.col("m.col1")).cast("double").alias("inter"))
        own = winners.select("id", gid.alias("gid"), F.lit("winner").alias("role"), F.col("id").alias("winner"), F.lit(None).cast("double").alias("inter"))
        new_members = stage(own.unionByName(attached), "members")
        groups = new_groups if groups is None else groups.unionByName(new_groups)
        members = new_members if members is None else members.unionByName(new_members)
        left = stage(others.select("id").join(new_members.select("id"), "id", "left_anti"), "left")
        if left.isEmpty():
            break
        a, b = left.withColumnRenamed("id", "a"), left.withColumnRenamed("id", "b")
        edges = stage(edges.join(a, "a", "left_semi").join(b, "b", "left_semi"), "merge-edges")
    return groups, members


def group_iou(members: DataFrame, obs: DataFrame) -> DataFrame:
    """(gid, group_iou): union of the winners against union of the evidence; null without evidence.

    A group of one winner and one piece of evidence, as most are, has it in closed form. The boxes of the others
    go through one kernel call a group, sorted by group in as many tasks as shuffle partitions.
    """
    shape = ["geometry"] if "geometry" in obs.columns else ["x0", "y0", "x1", "y1"]
    sized = members.join(obs.select("id", "area", *shape), "id")
    sides = sized.groupBy("gid").agg(
        F.count_if(F.col("role") == "winner").alias("w"),
        F.count_if(F.col("role") == "evidence").alias("e"),
        F.sum(F.when(F.col("role") == "winner", F.col("area"))).alias("won"),
        F.sum(F.when(F.col("role") == "evidence", F.col("area"))).alias("shown"),
        F.sum("inter").alias("inter"),
    )
    sides = stage(sides, "group-sides")
    pair = F.when((F.col("w") == 1) & (F.col("e") == 1), F.col("inter") / (F.col("won") + F.col("shown") - F.col("inter")))
    simple = sides.where("e = 0 or w = 0 or (e = 1 and w = 1)").select("gid", pair.alias("group_iou"))
    many = sides.where("e > 0 and w > 0 and e + w > 2").select("gid")
    rows = sized.join(many, "gid", "left_semi").select("gid", (F.col("role") == "winner").alias("wins"), *[F.col(c) if c == "geometry" else F.col(c).cast("double").alias(c) for c in shape])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gid, held = None, []

        def done() -> pa.RecordBatch:
            if shape == ["geometry"]:
                w, e = ([g for part in held for side, wkb in part if side == s for g in read_wkb(wkb)] for s in (True, False))
                value = intersection(w, e)[0] / union(w, e)[0]
            else:
                boxes = np.concatenate(held)
                wins, boxes = boxes[:, 0] > 0, boxes[:, 1:]
                both = box_union_area(boxes)
                value = (box_union_area(boxes[wins]) + box_union_area(boxes[~wins]) - both) / both
            return pa.RecordBatch.from_arrays([pa.array([gid]), pa.array([value])], names=["gid", "group_iou"])

        for batch in batches:
            gids = batch.column(0).to_pylist()
            if shape == ["geometry"]:
                table = list(zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()))
            else:
                table = np.stack([c.cast(pa.float64()).to_numpy(zero_copy_only=False) for c in (batch.column(1).cast(pa.int8()), *batch.columns[2:])], 1)
            start = 0
            for k, g in enumerate([*gids, None]):
                if k == len(gids) or g != gid:
                    if k > start:
                        held.append(table[start:k])
                    if k < len(gids):
                        if held:
                            yield done()
                        gid, held, start = g, [], k
        if held:
            yield done()

    found = rows.repartition("gid").sortWithinPartitions("gid").mapInArrow(run, "gid string, group_iou double")
    return simple.unionByName(found)


def judged(groups: DataFrame, iou: DataFrame, p: Params) -> DataFrame:
    """Groups with group_iou; a one_to_one that agrees too little is ambiguous; reasons."""
    low = (F.col("relation") == "one_to_one") & (F.coalesce("group_iou", F.lit(0.0)) < p.one_to_one_iou)
    reasons = F.array_compact(
        F.array(F.when(low, "low_group_iou"), F.when(F.col("group_iou") >= p.trust_iou, "high_group_agreement"), F.when(F.col("gap"), "coverage_gap_in_component"))
    )
    return groups.join(iou, "gid", "left").withColumn("reasons", reasons).withColumn("relation", F.when(low, "ambiguous").otherwise(F.col("relation")))


def canonical_footprints(obs: DataFrame, pairs: DataFrame, groups: DataFrame, members: DataFrame, p: Params) -> tuple[DataFrame, DataFrame]:
    """(canonical, dropped): winners and lone footprints without those partly over one of a higher family."""
    out = obs.join(members.where("role = 'evidence'").select("id"), "id", "left_anti")
    of = members.where("role = 'winner'").select("id", "gid").join(groups.select("gid", "comp", "relation", "reasons", "group_iou"), "gid")
    out = out.join(of, "id", "left").withColumn("relation", F.coalesce("relation", F.lit("single_source")))
    out = stage(out.withColumn("reasons", F.coalesce("reasons", F.expr("cast(array() as array<string>)"))), "canonical")
    partial = pairs.where(~F.col("is_merge") & ((F.col("iou") >= p.partial_iou) | (F.greatest("cov_a", "cov_b") >= p.partial_coverage)))
    dropped = None
    for family in FAMILIES[1:]:
        low = out.where(F.col("family") == family).select(F.col("id").alias("b"))
        hit = partial.join(low, "b", "left_semi").join(out.select(F.col("id").alias("a")), "a", "left_semi")
        gone = hit.groupBy("b").agg(
            F.max(F.struct("inter", "a")).alias("m"), F.max("iou").alias("iou"), F.max(F.greatest("cov_a", "cov_b")).alias("coverage")
        )
        gone = stage(gone.select(F.col("b").alias("id"), F.lit("partial_overlap").alias("reason"), F.col("m.a").alias("other"), "iou", "coverage"), "dropped")
        dropped = gone if dropped is None else dropped.unionByName(gone)
        out = out.join(gone.select("id"), "id", "left_anti")
    return out, dropped


def pick_heights(canon: DataFrame, heights: DataFrame, p: Params) -> DataFrame:
    """(id, h_id, h_family, height): each height record goes to the footprint it overlaps most, each footprint takes its best of those that agree."""
    pairs = box_join(canon.select("id", "area", "x0", "y0", "x1", "y1"), heights, p.cell).where("inter > 0")
    own = pairs.groupBy("b_id").agg(F.min(F.struct(-F.col("inter"), "a_area", "a_id", "b_area", "b_family", "b_height")).alias("m"))
    own = own.select("b_id", F.col("m.a_id").alias("id"), (-F.col("m.col1")).alias("inter"), F.col("m.a_area").alias("a"), F.col("m.b_area").alias("b"), F.col("m.b_family").alias("h_family"), F.col("m.b_height").alias("height"))
    good = own.where(F.col("inter") / (F.col("a") + F.col("b") - F.col("inter")) >= p.height_iou)
    best = good.groupBy("id").agg(F.min(F.struct(-F.col("inter"), "b_id", "h_family", "height")).alias("m"))
    return best.select("id", F.col("m.b_id").alias("h_id"), F.col("m.h_family").alias("h_family"), F.col("m.height").alias("height"))


def fused_height(height: Column, levels: Column, other: Column, other_name: Column, p: Params) -> dict[str, Column]:
    """height_m, height_provenance and height_lineage from tag, levels, a height record, or the default."""
    own = F.when(height.between(p.min_height, p.max_height), height)
    rise = levels * p.m_per_level
    by_level = F.when(levels.between(1, p.max_levels) & rise.between(p.min_height, p.max_height), rise)
    value = F.coalesce(own, by_level, other, F.lit(p.default_height))
    source = F.when(own.isNotNull(), "osm_height").when(by_level.isNotNull(), "osm_levels").when(other.isNotNull(), "gba").otherwise("default")
    lineage = (
        F.when(own.isNotNull(), "osm:height")
        .when(by_level.isNotNull(), f"osm:levels*{p.m_per_level:g}m")
        .when(other.isNotNull(), F.concat(F.lit("gba:"), other_name))
        .otherwise(f"default:{p.default_height:g}m")
    )
    return {"height_m": F.floor(value * 100 + 0.5) / 100, "height_provenance": source, "height_lineage": lineage}


def min_height(tag: Column, level: Column, height: Column, p: Params) -> Column:
    """The tag, else the level times its height; null below 0 and from the top up."""
    value = F.floor(F.coalesce(tag, F.when(level.between(0, p.max_levels), level * p.m_per_level)) * 100 + 0.5) / 100
    return F.when((value >= 0) & (value < height), value)


def evidence_keys(members: DataFrame) -> DataFrame:
    """(id, keys): evidence of each winner, largest overlap first."""
    rows = F.array_sort(F.collect_list(F.struct((-F.col("inter")).alias("i"), F.col("id").alias("k"))))
    return members.where("role = 'evidence'").groupBy(F.col("winner").alias("id")).agg(F.transform(rows, lambda x: x["k"]).alias("keys"))


def review_issues(groups: DataFrame, members: DataFrame, canon: DataFrame, p: Params) -> DataFrame:
    """One row per footprint and issue, with its severity."""
    flagged = groups.where(F.col("relation").isin("ambiguous", "split", "aggregate")).select("gid", F.col("relation").alias("issue_type"))
    flagged = flagged.unionByName(groups.where("gap").select("gid", F.lit("coverage_gap").alias("issue_type")))
    rows = members.join(flagged, "gid").select("id", "issue_type", "gid", "role", "winner")
    large = canon.where((F.col("family") != "osm") & (F.col("area") > p.large_area)).select("id", F.lit("large_footprint").alias("issue_type"), "gid", F.lit("winner").alias("role"), F.col("id").alias("winner"))
    severity = F.create_map(*[F.lit(x) for kv in SEVERITY.items() for x in kv])
    return rows.unionByName(large).withColumn("severity", severity[F.col("issue_type")])


def bridge(pairs: DataFrame, members: DataFrame, groups: DataFrame) -> DataFrame:
    """Every pair with the group its evidence side is in; one row per pair."""
    side = members.select(F.col("id").alias("b"), F.col("gid")).join(groups.select("gid", "comp"), "gid").groupBy("b").agg(F.min("gid").alias("gid"), F.min("comp").alias("comp"))
    return pairs.join(side, "b", "left").select("a", "b", "inter", "iou", "cov_a", "cov_b", "area_sim", "cdist", "match_score", "is_merge", "gid", "comp")
