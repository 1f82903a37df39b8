"""Spatial, conflation, diff and release operators over footprints derived from orders."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from cadastra.functions import geometry as G
from cadastra.operators import cells
from cadastra.operators.graph import connected_components
from cadastra.operators.staging import stage
from cadastra.plans import conflation as C
from cadastra.plans import diff as D
from cadastra.plans import release as R
from cadastra.plans.tables import BOXES_SQL, boxes, gob_boxes, osm_boxes, table

QUERIES: dict = {}
ORACLES: dict[str, str] = {}
P = C.Params()
CELL = 32.0


def query(name: str, sql: str | None = None):
    def add(function):
        QUERIES[name] = function
        if sql:
            ORACLES[name] = sql
        return function

    return add


def six(x):
    return F.floor(x * 1e6 + 0.5) / 1e6


# ---- spatial joins --------------------------------------------------------------------------------

PAIRS_SQL = f"""{BOXES_SQL}, g AS (SELECT * FROM gob WHERE confidence >= 0.75 AND area >= 10), raw AS (
  SELECT a.id AS a, b.id AS b, a.area AS aa, b.area AS ba,
         (least(a.x1, b.x1) - greatest(a.x0, b.x0)) * (least(a.y1, b.y1) - greatest(a.y0, b.y0)) AS inter,
         sqrt(pow((a.x0 + a.x1) / 2.0 - (b.x0 + b.x1) / 2.0, 2) + pow((a.y0 + a.y1) / 2.0 - (b.y0 + b.y1) / 2.0, 2)) AS cdist
  FROM osm a JOIN g b ON a.x0 < b.x1 AND b.x0 < a.x1 AND a.y0 < b.y1 AND b.y0 < a.y1
), pairs AS (
  SELECT *, inter::DOUBLE / (aa + ba - inter) AS iou, inter::DOUBLE / aa AS cov_a, inter::DOUBLE / ba AS cov_b,
         inter::DOUBLE / (aa + ba - inter) >= 0.25 OR greatest(inter::DOUBLE / aa, inter::DOUBLE / ba) >= 0.40 AS is_merge
  FROM raw
)"""

COMPONENTS_SQL = f"""{PAIRS_SQL}, e AS (
  SELECT a AS u, b AS v FROM pairs WHERE is_merge UNION SELECT b, a FROM pairs WHERE is_merge
), reach(id, other) AS (
  SELECT u, v FROM e UNION SELECT r.id, e.v FROM reach r JOIN e ON r.other = e.u
), comps AS (SELECT id, least(id, min(other)) AS comp FROM reach GROUP BY id),
members AS (
  SELECT c.comp, c.id, c.id LIKE 'way/%' AS wins FROM comps c
), shape AS (
  SELECT comp, count(*) FILTER (WHERE wins) AS winners, count(*) FILTER (WHERE NOT wins) AS evidence FROM members GROUP BY comp
), groups AS (
  SELECT comp, winners, evidence, CASE WHEN winners = 1 AND evidence < 2 THEN 'one_to_one' WHEN evidence < 2 THEN 'aggregate' WHEN winners = 1 THEN 'split' ELSE 'ambiguous' END AS relation FROM shape
), attached AS (
  SELECT b AS id, a AS winner, inter, comp FROM (
    SELECT p.b, p.a, p.inter, x.comp, row_number() OVER (PARTITION BY p.b ORDER BY p.inter DESC, p.aa, p.a) AS k
    FROM pairs p JOIN comps x ON p.a = x.id JOIN comps y ON p.b = y.id AND x.comp = y.comp) WHERE k = 1
)"""


def obs(spark, sf_dir, families=("osm", "gob")):
    sources = {"osm": osm_boxes(spark, sf_dir), "gob": gob_boxes(spark, sf_dir)}
    return C.observations({f: sources[f] for f in families}, P)


def pairs(spark, sf_dir):
    return C.overlap_pairs(obs(spark, sf_dir), P)


@query(
    "d01_overlap_pairs",
    f"""WITH {PAIRS_SQL} SELECT a, b, inter, floor(iou * 1e6 + 0.5) / 1e6 AS iou, floor(cov_a * 1e6 + 0.5) / 1e6 AS cov_a, floor(cov_b * 1e6 + 0.5) / 1e6 AS cov_b, is_merge,
    floor((0.5 * iou + 0.25 * (1 - abs(aa - ba)::DOUBLE / greatest(aa, ba)) + 0.25 * greatest(0, 1 - cdist / 20)) * 1e6 + 0.5) / 1e6 AS score FROM pairs""",
)
def overlap_pairs(spark, sf_dir):
    """Cross-family overlaps with their metrics."""
    return pairs(spark, sf_dir).select("a", "b", "inter", six(F.col("iou")).alias("iou"), six(F.col("cov_a")).alias("cov_a"), six(F.col("cov_b")).alias("cov_b"), "is_merge", six(F.col("match_score")).alias("score"))


@query("d02_area_semi_join", f"WITH {BOXES_SQL} SELECT id FROM osm o WHERE EXISTS (SELECT 1 FROM supplier s WHERE o.x0 < s_suppkey * 37 % 2900 + 60 AND o.x1 > s_suppkey * 37 % 2900 AND o.y0 < s_suppkey * 53 % 2900 + 60 AND o.y1 > s_suppkey * 53 % 2900)")
def area_semi_join(spark, sf_dir):
    """Footprints that touch any piece of an area."""
    s = table(spark, sf_dir, "supplier")
    x, y = F.col("s_suppkey") * 37 % 2900, F.col("s_suppkey") * 53 % 2900
    area = s.select(x.alias("x0"), y.alias("y0"), (x + 60).alias("x1"), (y + 60).alias("y1"))
    hit = cells.box_join(osm_boxes(spark, sf_dir).select("id", "x0", "y0", "x1", "y1"), area, CELL)
    return hit.select(F.col("a_id").alias("id")).distinct()


POINTS_SQL = """p AS (SELECT c_custkey AS pid, (c_custkey * 7907 % 2990)::DOUBLE + 0.5 AS px, (c_custkey * 6311 % 2990)::DOUBLE + 0.5 AS py FROM customer)"""


def points(spark, sf_dir):
    k = F.col("c_custkey")
    return table(spark, sf_dir, "customer").select(k.alias("pid"), (k * 7907 % 2990 + 0.5).cast("double").alias("px"), (k * 6311 % 2990 + 0.5).cast("double").alias("py"))


@query("d03_outside_points", f"WITH {BOXES_SQL}, {POINTS_SQL} SELECT pid FROM p WHERE NOT EXISTS (SELECT 1 FROM osm WHERE px BETWEEN x0 AND x1 AND py BETWEEN y0 AND y1)")
def outside_points(spark, sf_dir):
    """Points in no footprint."""
    p = points(spark, sf_dir)
    inside = cells.point_in_box(p, osm_boxes(spark, sf_dir).select("id", "x0", "y0", "x1", "y1"), CELL).select(F.col("p_pid").alias("pid")).distinct()
    return p.join(inside, "pid", "left_anti").select("pid")


@query("d04_smallest_container", f"WITH {BOXES_SQL}, {POINTS_SQL} SELECT pid, arg_min(id, (area, id)) AS smallest, arg_max(id, (area, id)) AS largest FROM p JOIN osm ON px BETWEEN x0 AND x1 AND py BETWEEN y0 AND y1 GROUP BY pid")
def smallest_container(spark, sf_dir):
    """The smallest and the largest footprint around each point."""
    hit = cells.point_in_box(points(spark, sf_dir), osm_boxes(spark, sf_dir).select("id", "area", "x0", "y0", "x1", "y1"), CELL)
    by = F.struct("b_area", "b_id")
    return hit.groupBy(F.col("p_pid").alias("pid")).agg(F.min_by("b_id", by).alias("smallest"), F.max_by("b_id", by).alias("largest"))


@query(
    "d06_nearest_within",
    f"""WITH {BOXES_SQL}, {POINTS_SQL}, d AS (SELECT pid, id, sqrt(pow(greatest(x0 - px, px - x1, 0), 2) + pow(greatest(y0 - py, py - y1, 0), 2)) AS d FROM p JOIN osm ON px BETWEEN x0 - 30 AND x1 + 30 AND py BETWEEN y0 - 30 AND y1 + 30)
    SELECT pid, arg_min(id, (d, id)) AS nearest, floor(min(d) * 1e6 + 0.5) / 1e6 AS distance FROM d WHERE pid NOT IN (SELECT pid FROM d WHERE d = 0) AND d <= 30 GROUP BY pid""",
)
def nearest_within(spark, sf_dir):
    """The nearest footprint within 30 m of points in none."""
    near = cells.within(points(spark, sf_dir), osm_boxes(spark, sf_dir).select("id", "x0", "y0", "x1", "y1"), R.PIN_NEAREST_M, CELL)
    best = near.groupBy(F.col("p_pid").alias("pid")).agg(F.min(F.struct("distance", "b_id")).alias("m"))
    return best.where("m.distance > 0").select("pid", F.col("m.b_id").alias("nearest"), six(F.col("m.distance")).alias("distance"))


@query("d07_anchor_places", f"WITH {BOXES_SQL}, {POINTS_SQL} SELECT DISTINCT id FROM p JOIN osm ON px BETWEEN x0 AND x1 AND py BETWEEN y0 AND y1 WHERE pid % 3 = 0")
def anchor_places(spark, sf_dir):
    """Footprints that hold a place of an anchor category."""
    code = F.when(F.col("pid") % 3 == 0, "TOUR_HOTEL_X").otherwise("FOOD_CAFE")
    p = points(spark, sf_dir).where(R.anchor_poi(code))
    return cells.point_in_box(p, osm_boxes(spark, sf_dir).select("id", "x0", "y0", "x1", "y1"), CELL).select(F.col("b_id").alias("id")).distinct()


# ---- conflation -----------------------------------------------------------------------------------


@query("l01_components", f"WITH RECURSIVE {COMPONENTS_SQL} SELECT id, comp FROM comps")
def components(spark, sf_dir):
    return connected_components(stage(pairs(spark, sf_dir).where("is_merge"), "pairs"))


def resolved(spark, sf_dir):
    o = stage(obs(spark, sf_dir), "obs")
    e = stage(C.overlap_pairs(o, P), "pairs")
    groups, members = C.resolve(o, e, P)
    return o, e, groups, members


@query("k14_group_relations", f"WITH RECURSIVE {COMPONENTS_SQL} SELECT comp, relation, winners, evidence FROM groups")
def group_relations(spark, sf_dir):
    return resolved(spark, sf_dir)[2].select("comp", "relation", "winners", "evidence")


@query(
    "k14_membership",
    f"WITH RECURSIVE {COMPONENTS_SQL} SELECT id, 'winner' AS role, id AS winner, NULL::DOUBLE AS inter FROM members WHERE wins UNION ALL SELECT id, 'evidence', winner, inter::DOUBLE FROM attached",
)
def membership(spark, sf_dir):
    return resolved(spark, sf_dir)[3].select("id", "role", "winner", "inter")


GROUP_IOU_SQL = """x AS (SELECT m.comp, m.wins, o.x0, o.x1, o.y0, o.y1 FROM members m JOIN (SELECT id, x0, y0, x1, y1 FROM osm UNION ALL SELECT id, x0, y0, x1, y1 FROM g) o USING (id)),
    c1 AS (SELECT comp, wins, unnest(range(x0, x1)) AS cx, y0, y1 FROM x), c2 AS (SELECT DISTINCT comp, wins, cx, unnest(range(y0, y1)) AS cy FROM c1),
    c3 AS (SELECT comp, cx, cy, count(*) AS n FROM c2 GROUP BY comp, cx, cy), giou AS (SELECT comp, count(*) FILTER (WHERE n = 2)::DOUBLE / count(*) AS iou FROM c3 GROUP BY comp)"""


@query(
    "k15_group_iou",
    f"""WITH RECURSIVE {COMPONENTS_SQL}, x AS (SELECT m.comp, m.wins, o.x0, o.x1, o.y0, o.y1 FROM members m JOIN (SELECT id, x0, y0, x1, y1 FROM osm UNION ALL SELECT id, x0, y0, x1, y1 FROM g) o USING (id)),
    c1 AS (SELECT comp, wins, unnest(range(x0, x1)) AS cx, y0, y1 FROM x), c2 AS (SELECT DISTINCT comp, wins, cx, unnest(range(y0, y1)) AS cy FROM c1),
    c3 AS (SELECT comp, cx, cy, count(*) AS n FROM c2 GROUP BY comp, cx, cy)
    SELECT comp, floor(count(*) FILTER (WHERE n = 2)::DOUBLE / count(*) * 1e6 + 0.5) / 1e6 AS group_iou FROM c3 GROUP BY comp""",
)
def group_iou(spark, sf_dir):
    """Union of winners against union of evidence."""
    o, _, groups, members = resolved(spark, sf_dir)
    return C.group_iou(members, o).join(groups.select("gid", "comp"), "gid").select("comp", six(F.col("group_iou")).alias("group_iou"))


CANON_SQL = f"""{COMPONENTS_SQL}, single AS (
  SELECT id, 'osm' AS family FROM osm UNION ALL SELECT id, 'gob' FROM g
), canon0 AS (
  SELECT id, family FROM single WHERE id NOT IN (SELECT id FROM attached)
), dropped AS (
  SELECT p.b AS id, arg_max(p.a, (p.inter, p.a)) AS other, max(p.iou) AS iou, max(greatest(cov_a, cov_b)) AS coverage
  FROM pairs p JOIN canon0 x ON p.b = x.id JOIN canon0 y ON p.a = y.id WHERE NOT is_merge AND (p.iou >= 0.10 OR greatest(cov_a, cov_b) >= 0.20) GROUP BY p.b
), canon AS (SELECT * FROM canon0 WHERE id NOT IN (SELECT id FROM dropped))"""


def canonical(spark, sf_dir):
    o, e, groups, members = resolved(spark, sf_dir)
    groups = stage(C.judged(groups, C.group_iou(members, o), P), "judged")
    canon, dropped = C.canonical_footprints(o, e, groups, members, P)
    return o, e, groups, members, stage(canon, "canon"), dropped


@query("k16_canonical_footprints", f"WITH RECURSIVE {CANON_SQL} SELECT id, family FROM canon")
def canonical_footprints(spark, sf_dir):
    return canonical(spark, sf_dir)[4].select("id", "family")


@query("e25_partial_drops", f"WITH RECURSIVE {CANON_SQL} SELECT id, other, floor(iou * 1e6 + 0.5) / 1e6 AS iou, floor(coverage * 1e6 + 0.5) / 1e6 AS coverage FROM dropped")
def partial_drops(spark, sf_dir):
    return canonical(spark, sf_dir)[5].select("id", "other", six(F.col("iou")).alias("iou"), six(F.col("coverage")).alias("coverage"))


GBA_SQL = """gba AS (SELECT 'gba/' || k::VARCHAR AS id, x0 + c % 5 - 2 AS x0, y0 + c % 3 - 1 AS y0, x0 + c % 5 - 2 + w AS x1, y0 + c % 3 - 1 + h AS y1, w * h AS area, 3.0 + c % 40 AS height FROM b WHERE k % 5 = 0)"""


def gba(spark, sf_dir):
    b = boxes(spark, sf_dir).where("k % 5 = 0")
    x, y = F.col("x0") + F.col("c") % 5 - 2, F.col("y0") + F.col("c") % 3 - 1
    return b.select(
        F.concat(F.lit("gba/"), F.col("k").cast("string")).alias("id"), x.alias("x0"), y.alias("y0"), (x + F.col("w")).alias("x1"), (y + F.col("h")).alias("y1"),
        (F.col("w") * F.col("h")).alias("area"), F.lit("gba_ms").alias("family"), (3.0 + F.col("c") % 40).cast("double").alias("height"),
    )


PICK_SQL = f"""{CANON_SQL}, {GBA_SQL}, cb AS (SELECT c.id, o.x0, o.y0, o.x1, o.y1, o.area FROM canon c JOIN (SELECT id, x0, y0, x1, y1, area FROM osm UNION ALL SELECT id, x0, y0, x1, y1, area FROM g) o USING (id)),
hp AS (SELECT c.id, c.area AS ca, h.id AS h_id, h.area AS ha, h.height, (least(c.x1, h.x1) - greatest(c.x0, h.x0)) * (least(c.y1, h.y1) - greatest(c.y0, h.y0)) AS inter
  FROM cb c JOIN gba h ON c.x0 < h.x1 AND h.x0 < c.x1 AND c.y0 < h.y1 AND h.y0 < c.y1),
h1 AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY h_id ORDER BY inter DESC, ca, id) AS r FROM hp) WHERE r = 1),
pick AS (SELECT id, h_id, height FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY inter DESC, h_id) AS q FROM h1 WHERE inter::DOUBLE / (ca + ha - inter) >= 0.5) WHERE q = 1)"""


@query("d08_height_pick", f"WITH RECURSIVE {PICK_SQL} SELECT id, h_id, height FROM pick")
def height_pick(spark, sf_dir):
    """Best-overlap assignment, first record to footprint, then footprint to record."""
    return C.pick_heights(canonical(spark, sf_dir)[4], gba(spark, sf_dir), P).select("id", "h_id", "height")


@query(
    "k17_height_fusion",
    f"""WITH RECURSIVE {PICK_SQL}, t AS (SELECT canon.id, pick.height AS gh, pick.h_id, CASE WHEN k % 7 = 0 THEN (osm.c % 700)::DOUBLE END AS hv, CASE WHEN k % 4 = 1 THEN (osm.c % 120)::DOUBLE END AS lv FROM canon LEFT JOIN osm ON osm.id = canon.id LEFT JOIN pick ON pick.id = canon.id)
    SELECT id, floor(coalesce(CASE WHEN hv BETWEEN 2 AND 500 THEN hv END, CASE WHEN lv BETWEEN 1 AND 100 AND lv * 3.5 BETWEEN 2 AND 500 THEN lv * 3.5 END, gh, 3.5) * 100 + 0.5) / 100 AS height_m,
    CASE WHEN hv BETWEEN 2 AND 500 THEN 'osm_height' WHEN lv BETWEEN 1 AND 100 AND lv * 3.5 BETWEEN 2 AND 500 THEN 'osm_levels' WHEN gh IS NOT NULL THEN 'gba' ELSE 'default' END AS height_provenance,
    CASE WHEN hv BETWEEN 2 AND 500 THEN 'osm:height' WHEN lv BETWEEN 1 AND 100 AND lv * 3.5 BETWEEN 2 AND 500 THEN 'osm:levels*3.5m' WHEN gh IS NOT NULL THEN 'gba:gba_ms:' || h_id ELSE 'default:3.5m' END AS height_lineage FROM t""",
)
def height_fusion(spark, sf_dir):
    return fused(spark, sf_dir, canonical(spark, sf_dir)[4]).select("id", "height_m", "height_provenance", "height_lineage")


def fused(spark, sf_dir, canon):
    tags = osm_boxes(spark, sf_dir).select("id", "k", F.when(F.col("k") % 7 == 0, (F.col("c") % 700).cast("double")).alias("hv"), F.when(F.col("k") % 4 == 1, (F.col("c") % 120).cast("double")).alias("levels"))
    pick = C.pick_heights(canon, gba(spark, sf_dir), P).withColumnRenamed("height", "gh")
    rows = canon.join(tags, "id", "left").join(pick, "id", "left")
    return rows.withColumns(C.fused_height(F.col("hv"), F.col("levels"), F.col("gh"), F.concat_ws(":", "h_family", "h_id"), P))


@query(
    "k18_min_height",
    """SELECT p_partkey, CASE WHEN v >= 0 AND v < p_size THEN v END AS min_height FROM (SELECT p_partkey, p_size, floor(coalesce(CASE WHEN p_partkey % 3 = 0 THEN p_retailprice / 100 - 10 END, CASE WHEN p_partkey % 5 BETWEEN 0 AND 100 THEN p_partkey % 5 * 3.5::DOUBLE END) * 100 + 0.5) / 100 AS v FROM part)""",
)
def min_height(spark, sf_dir):
    k = F.col("p_partkey")
    tag = F.when(k % 3 == 0, F.col("p_retailprice") / 100 - 10)
    return table(spark, sf_dir, "part").select("p_partkey", C.min_height(tag, k % 5, F.col("p_size"), P).alias("min_height"))


@query("e12_evidence_keys", f"WITH RECURSIVE {COMPONENTS_SQL} SELECT winner AS id, array_to_string(list(id ORDER BY inter DESC, id), ',') AS keys FROM attached GROUP BY winner")
def evidence_keys(spark, sf_dir):
    return C.evidence_keys(resolved(spark, sf_dir)[3]).select("id", F.array_join("keys", ",").alias("keys"))


@query(
    "k19_review_issues",
    f"""WITH RECURSIVE {COMPONENTS_SQL}, {{x}}, fin AS (SELECT g.comp, CASE WHEN relation = 'one_to_one' AND coalesce(iou, 0) < 0.5 THEN 'ambiguous' ELSE relation END AS relation FROM groups g LEFT JOIN giou USING (comp)),
    mem AS (SELECT id, comp, 'winner' AS role, id AS winner FROM members WHERE wins UNION ALL SELECT id, comp, 'evidence', winner FROM attached)
    SELECT id, relation AS issue_type, '0:' || comp AS gid, role, winner, CASE relation WHEN 'ambiguous' THEN 'high' ELSE 'medium' END AS severity FROM mem JOIN fin USING (comp) WHERE relation IN ('ambiguous', 'split', 'aggregate')""".format(x=GROUP_IOU_SQL),
)
def review_issues(spark, sf_dir):
    _, _, groups, members, canon, _ = canonical(spark, sf_dir)
    return C.review_issues(groups, members, canon, P)


@query("d22_bridge", f"WITH RECURSIVE {COMPONENTS_SQL} SELECT p.a, p.b, p.inter, p.is_merge, attached.comp FROM pairs p LEFT JOIN attached ON attached.id = p.b")
def bridge(spark, sf_dir):
    _, e, groups, members = resolved(spark, sf_dir)
    return C.bridge(e, members, groups).select("a", "b", "inter", "is_merge", "comp")


@query("e22_inventory", f"WITH {BOXES_SQL} SELECT 'gob' AS family, count(*) AS n, count(*) FILTER (WHERE confidence >= 0.75) AS kept, floor(quantile_cont(confidence, 0.1) * 1e6 + 0.5) / 1e6 AS p10, floor(quantile_cont(confidence, 0.9) * 1e6 + 0.5) / 1e6 AS p90 FROM gob")
def inventory(spark, sf_dir):
    """What a source holds and what its filters drop."""
    q = F.percentile("confidence", F.array(F.lit(0.1), F.lit(0.9)))
    df = gob_boxes(spark, sf_dir).agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("confidence") >= P.min_confidence).alias("kept"), q.alias("q"))
    return df.select(F.lit("gob").alias("family"), "n", "kept", six(F.col("q")[0]).alias("p10"), six(F.col("q")[1]).alias("p90"))


# ---- ids, tiers, invariants -----------------------------------------------------------------------


def canon_rows(spark, sf_dir):
    _, _, _, members, canon, _ = canonical(spark, sf_dir)
    rows = canon.select(F.col("id").alias("key")).join(C.evidence_keys(members).withColumnRenamed("id", "key"), "key", "left")
    locked = F.when(F.crc32(F.col("key").cast("binary")) % 97 == 0, F.concat(F.lit("lock/"), (F.length("key") % 4).cast("string")))
    return canon, members, rows.select("key", locked.alias("locked_id"), F.coalesce("keys", F.expr("cast(array() as array<string>)")).alias("evidence"))


def registry(spark, sf_dir):
    """Ids of an earlier build: two of three keys, some of them sharing an id."""
    keys = osm_boxes(spark, sf_dir).select("id", "k").unionByName(gob_boxes(spark, sf_dir).select("id", "k")).where("k % 3 <> 1 or id like 'gob%'")
    return keys.select(F.col("id").alias("key"), F.concat(F.lit("b/"), F.floor(F.col("k") / 2).cast("string")).alias("building_id"))


@query("k21_stable_ids")
def stable_ids(spark, sf_dir):
    return R.stable_ids(stage(canon_rows(spark, sf_dir)[2], "rows"), stage(registry(spark, sf_dir), "registry"))


@query("k22_registry_update")
def registry_update(spark, sf_dir):
    rows, reg = stage(canon_rows(spark, sf_dir)[2], "rows"), stage(registry(spark, sf_dir), "registry")
    return R.updated_registry(reg, rows, R.stable_ids(rows, reg))


@query("e23_invariants", "SELECT unnest(['null_id','duplicate_id','no_id','evidence_is_canonical','winner_missing','evidence_twice','no_area','empty_box','duplicate_footprint']) AS \"check\", 0 AS violations")
def invariants(spark, sf_dir):
    """Every check has no violations."""
    canon, members, rows = canon_rows(spark, sf_dir)
    rows = stage(rows, "rows")
    return R.invariants(canon, members, R.stable_ids(rows, stage(registry(spark, sf_dir), "registry")))


TIER_SQL = """t AS (SELECT p_partkey, CASE p_partkey % 8 WHEN 0 THEN 'yes' WHEN 1 THEN 'house' WHEN 2 THEN 'apartments' WHEN 3 THEN 'temple' WHEN 4 THEN 'hotel' WHEN 5 THEN 'shed' WHEN 6 THEN 'residential' END AS b,
  CASE WHEN p_partkey % 3 = 0 THEN p_name END AS name, CASE WHEN p_partkey % 5 = 0 THEN 'Q1' END AS wikidata, CASE WHEN p_partkey % 11 = 0 THEN 'tomb' END AS historic, CASE WHEN p_partkey % 13 = 0 THEN 'guest_house' END AS tourism,
  CASE WHEN p_size % 3 = 0 THEN p_size % 20 END AS levels, p_size::DOUBLE AS height, CASE WHEN p_partkey % 2 = 0 THEN 'default' ELSE 'osm_height' END AS prov, p_retailprice * 1.3 AS area FROM part)"""


@query(
    "k20_tiers",
    f"""WITH {TIER_SQL}, u AS (SELECT *, CASE WHEN b <> 'yes' THEN b END AS c, coalesce(levels >= 9, false) OR (height >= 30 AND prov <> 'default') AS high FROM t), r AS (SELECT *, CASE
      WHEN name IS NOT NULL AND ((wikidata IS NOT NULL AND (historic IS NOT NULL OR c = 'temple')) OR historic = 'tomb') THEN 2 WHEN c IN ('temple', 'hotel') OR tourism = 'guest_house' THEN 3
      WHEN c = 'apartments' OR (c IN ('house', 'residential') AND high) THEN 5 WHEN high THEN 6 WHEN area >= 2000 THEN 7 WHEN c IN ('house', 'residential') THEN 8 ELSE 0 END AS rule FROM u)
    SELECT p_partkey, rule, CASE rule WHEN 2 THEN 'T1_landmark' WHEN 3 THEN 'T2_commercial' WHEN 5 THEN 'T2_highrise_residential' WHEN 6 THEN 'T2_large' WHEN 7 THEN 'T2_large' ELSE 'T3_residential' END AS tier,
      CASE WHEN rule = 0 AND c = 'shed' THEN 'minor_structure' ELSE '' END AS flags FROM r""",
)
def tiers(spark, sf_dir):
    k = F.col("p_partkey")
    rows = table(spark, sf_dir, "part").select(
        k.alias("id"),
        F.expr("case p_partkey % 8 when 0 then 'yes' when 1 then 'house' when 2 then 'apartments' when 3 then 'temple' when 4 then 'hotel' when 5 then 'shed' when 6 then 'residential' end").alias("building"),
        F.when(k % 3 == 0, F.col("p_name")).alias("name"),
        F.expr("map('wikidata', if(p_partkey % 5 = 0, 'Q1', null), 'historic', if(p_partkey % 11 = 0, 'tomb', null), 'tourism', if(p_partkey % 13 = 0, 'guest_house', null))").alias("tags"),
        F.expr("if(p_size % 3 = 0, p_size % 20, null)").alias("levels"),
        F.col("p_size").cast("double").alias("height_m"),
        F.when(k % 2 == 0, "default").otherwise("osm_height").alias("height_provenance"),
        (F.col("p_retailprice") * 1.3).alias("area"),
    )
    return R.tiers(rows).select(F.col("id").alias("p_partkey"), "rule", "tier", F.array_join("flags", ",").alias("flags"))


# ---- diff -----------------------------------------------------------------------------------------

SIDES_SQL = f"""{BOXES_SQL}, sa AS (
  SELECT k AS bid, CASE WHEN k % 101 = 0 THEN NULL WHEN k % 103 = 0 THEN (k - 1)::VARCHAR ELSE k::VARCHAR END AS key, x0 + w / 2.0 AS mx, y0 + h / 2.0 AS my, (w * h)::DOUBLE AS area, x0 || ' ' || y0 || ' ' || w || ' ' || h AS gh, (c % 40)::DOUBLE AS h, price, c % 5 AS cat FROM b WHERE k % 10 <> 0
), sb AS (
  SELECT k + 1000000 AS bid, CASE WHEN k % 101 = 0 THEN NULL WHEN k % 37 = 0 THEN 'n' || k ELSE k::VARCHAR END AS key, x0 + w / 2.0 + CASE WHEN k % 13 = 0 THEN 12 WHEN k % 13 = 1 THEN 0.5 WHEN k % 13 = 2 THEN 4 ELSE 0 END AS mx, y0 + h / 2.0 AS my,
    (w * h * CASE WHEN k % 17 = 0 THEN 2 ELSE 1 END)::DOUBLE AS area, x0 || ' ' || y0 || ' ' || w || ' ' || h || CASE WHEN k % 13 < 3 OR k % 17 = 0 THEN ' moved' ELSE '' END AS gh,
    CASE WHEN k % 23 = 0 THEN NULL ELSE (c % 40 + CASE WHEN k % 19 = 0 THEN 3 ELSE 0 END)::DOUBLE END AS h, price + CASE WHEN k % 29 = 0 THEN 1 ELSE 0 END AS price, CASE WHEN k % 31 = 0 THEN NULL ELSE c % 5 END AS cat FROM b WHERE k % 10 <> 1
)"""
DEG = G.M_PER_DEG


def sides(spark, sf_dir):
    """Two releases: boxes without one residue each, with keys, places, areas, heights and attributes changed on others."""
    b = boxes(spark, sf_dir)
    k = F.col("k")
    mx, my = F.col("x0") + F.col("w") / 2, F.col("y0") + F.col("h") / 2
    shape = F.concat_ws(" ", *[F.col(c).cast("string") for c in ("x0", "y0", "w", "h")])
    place = lambda x: [x.alias("mx"), my.alias("my"), (105.8 + x / DEG).alias("cx"), (my / DEG).alias("cy")]
    a = b.where("k % 10 <> 0").select(
        k.alias("bid"), F.when(k % 103 == 0, (k - 1).cast("string")).when(k % 101 != 0, k.cast("string")).alias("key"), *place(mx), (F.col("w") * F.col("h")).cast("double").alias("area"),
        shape.alias("gh"), (F.col("c") % 40).cast("double").alias("h"), F.lit(True).alias("real"), "price", (F.col("c") % 5).alias("cat"),
    ).withColumn("key", F.when(F.col("bid") % 101 != 0, F.col("key")))
    moved = F.when(k % 13 == 0, 12.0).when(k % 13 == 1, 0.5).when(k % 13 == 2, 4.0).otherwise(0.0)
    new = b.where("k % 10 <> 1").select(
        (k + 1000000).alias("bid"), F.when(k % 101 != 0, F.concat(F.when(k % 37 == 0, "n").otherwise(""), k.cast("string"))).alias("key"), *place(mx + moved), (F.col("w") * F.col("h") * F.when(k % 17 == 0, 2).otherwise(1)).cast("double").alias("area"),
        F.concat(shape, F.when((k % 13 < 3) | (k % 17 == 0), " moved").otherwise("")).alias("gh"), F.when(k % 23 != 0, (F.col("c") % 40 + F.when(k % 19 == 0, 3).otherwise(0)).cast("double")).alias("h"),
        F.lit(True).alias("real"), (F.col("price") + F.when(k % 29 == 0, 1).otherwise(0)).alias("price"), F.when(k % 31 != 0, F.col("c") % 5).alias("cat"),
    )
    return a, new


KEYED_SQL = f"""{SIDES_SQL}, ra AS (SELECT key, min(bid) AS bid FROM sa WHERE key IS NOT NULL GROUP BY key), rb AS (SELECT key, min(bid) AS bid FROM sb WHERE key IS NOT NULL GROUP BY key), kp AS (SELECT ra.bid AS a, rb.bid AS b FROM ra JOIN rb USING (key)),
st AS (SELECT 'a' AS side, bid, CASE WHEN key IS NULL THEN 'nokey' WHEN bid NOT IN (SELECT bid FROM ra) THEN 'dup' WHEN bid IN (SELECT a FROM kp) THEN 'matched' ELSE 'removed' END AS status FROM sa
  UNION ALL SELECT 'b', bid, CASE WHEN key IS NULL THEN 'nokey' WHEN bid NOT IN (SELECT bid FROM rb) THEN 'dup' WHEN bid IN (SELECT b FROM kp) THEN 'matched' ELSE 'added' END FROM sb),
c AS (SELECT kp.a, kp.b, x.mx AS ax, y.mx AS bx, y.my AS by_, x.gh = y.gh AS same, 100 * abs(y.area - x.area) / x.area AS area_pct, sqrt(pow((y.mx - x.mx) * cos(radians((x.my + y.my) / 2 / {DEG!r})), 2) + pow(y.my - x.my, 2)) AS shift_m, y.h - x.h AS dh, (x.h IS NULL) <> (y.h IS NULL) AS one_h,
  concat_ws(',', CASE WHEN x.price <> y.price THEN 'price' END, CASE WHEN x.cat IS DISTINCT FROM y.cat THEN 'cat' END) AS cols_changed FROM kp JOIN sa x ON x.bid = kp.a JOIN sb y ON y.bid = kp.b),
d AS (SELECT *, CASE WHEN same THEN 'identical' WHEN area_pct > 20 OR shift_m > 10 THEN 'major' WHEN area_pct <= 5 AND shift_m <= 1 THEN 'minor' ELSE 'moderate' END AS geom_class, coalesce(abs(dh) > 0.5, one_h) AS h_changed FROM c),
cmp AS (SELECT *, geom_class IN ('major', 'moderate') OR h_changed OR cols_changed <> '' AS changed FROM d)"""


@query("k27_match_status_key", f"WITH {KEYED_SQL} SELECT * FROM st")
def match_status_key(spark, sf_dir):
    """D10 / K27."""
    a, b = sides(spark, sf_dir)
    pairs_ = stage(D.key_pairs(a, b), "pairs")
    left, right = D.statuses(a, pairs_, "a"), D.statuses(b, pairs_, "b")
    return left.select(F.lit("a").alias("side"), "bid", "status").unionByName(right.select(F.lit("b").alias("side"), "bid", "status"))


def compared(spark, sf_dir):
    a, b = sides(spark, sf_dir)
    pairs_ = stage(D.key_pairs(a, b), "pairs")
    return a, b, pairs_, D.compare(a, b, pairs_, ("price", "cat"))


@query("k28_compare", f"WITH {KEYED_SQL} SELECT a, b, geom_class, h_changed, cols_changed, changed FROM cmp")
def compare(spark, sf_dir):
    return compared(spark, sf_dir)[3].select("a", "b", "geom_class", "h_changed", "cols_changed", "changed")


@query("k29_change_counts", f"WITH {KEYED_SQL} SELECT geom_class, count(*) AS n, count(*) FILTER (WHERE h_changed) AS height, count(*) FILTER (WHERE changed) AS changed FROM cmp GROUP BY geom_class")
def change_counts(spark, sf_dir):
    return compared(spark, sf_dir)[3].groupBy("geom_class").agg(F.count(F.lit(1)).alias("n"), F.count_if("h_changed").alias("height"), F.count_if("changed").alias("changed"))


def _histogram(column, edges):
    def run(spark, sf_dir):
        c = compared(spark, sf_dir)[3]
        x = F.abs(column) if column == "dh" else F.col(column)
        return c.groupBy(D.binned(x, edges).alias("bin")).agg(F.count(F.lit(1)).alias("n")).where("bin is not null")

    return run


for _name, _column, _edges in (("area", "area_pct", D.AREA_PCT_BINS), ("dh", "dh", D.DH_M_BINS)):
    _case = " ".join(f"WHEN x >= {e} THEN {i}" for i, e in reversed(list(enumerate(_edges))) if i)
    query(f"k29_histogram_{_name}", f"WITH {KEYED_SQL} SELECT CASE {_case} ELSE 0 END AS bin, count(*) AS n FROM (SELECT abs({_column}) AS x FROM cmp) WHERE x IS NOT NULL GROUP BY 1")(_histogram(_column, _edges))


@query(
    "e19_change_grid",
    f"""WITH {KEYED_SQL}, ga AS (SELECT floor((105.8::DOUBLE + mx / {DEG!r}) / 0.002::DOUBLE)::BIGINT AS gx, floor(my / {DEG!r} / 0.002::DOUBLE)::BIGINT AS gy, count(*) AS n_a, count(*) FILTER (WHERE status = 'removed') AS removed FROM sa JOIN st ON side = 'a' AND st.bid = sa.bid GROUP BY 1, 2),
    gb AS (SELECT floor((105.8::DOUBLE + mx / {DEG!r}) / 0.002::DOUBLE)::BIGINT AS gx, floor(my / {DEG!r} / 0.002::DOUBLE)::BIGINT AS gy, count(*) AS n_b, count(*) FILTER (WHERE status = 'added') AS added FROM sb JOIN st ON side = 'b' AND st.bid = sb.bid GROUP BY 1, 2),
    gc AS (SELECT floor((105.8::DOUBLE + bx / {DEG!r}) / 0.002::DOUBLE)::BIGINT AS gx, floor(by_ / {DEG!r} / 0.002::DOUBLE)::BIGINT AS gy, count(*) AS changed FROM cmp WHERE changed GROUP BY 1, 2),
    grid AS (SELECT gx, gy, coalesce(n_a, 0) AS n_a, coalesce(n_b, 0) AS n_b, coalesce(removed, 0) AS removed, coalesce(added, 0) AS added, coalesce(changed, 0) AS changed FROM ga FULL JOIN gb USING (gx, gy) FULL JOIN gc USING (gx, gy))
    SELECT * FROM grid WHERE removed + added + changed > 0 ORDER BY removed + added + changed DESC, abs(n_b - n_a) DESC, gx, gy LIMIT 30""",
)
def change_grid(spark, sf_dir):
    """Changes by cell, the busiest first."""
    a, b, pairs_, c = compared(spark, sf_dir)
    spec = D.DiffSpec(grid_deg=0.002)
    grid = D.grid_changes(a, b, c, D.statuses(a, pairs_, "a"), D.statuses(b, pairs_, "b"), spec)
    return D.top_cells(grid, spec.cells)


@query(
    "k29_quality",
    f"""WITH {KEYED_SQL}, s AS (SELECT 'a' AS side, bid, key FROM sa UNION ALL SELECT 'b', bid, key FROM sb), d2 AS (SELECT side, key, count(*) AS n FROM s WHERE key IS NOT NULL GROUP BY 1, 2 HAVING count(*) > 1)
    SELECT s.side, count(*) AS buildings, count(*) - count(key) AS blank_keys, (SELECT count(*) FROM d2 WHERE d2.side = s.side) AS dup_keys, (SELECT coalesce(sum(n), 0)::BIGINT FROM d2 WHERE d2.side = s.side) AS dup_rows FROM s GROUP BY s.side""",
)
def quality(spark, sf_dir):
    a, b = sides(spark, sf_dir)
    one = lambda df, s: D.quality(df).select(F.lit(s).alias("side"), "buildings", "blank_keys", "dup_keys", "dup_rows")
    return one(a, "a").unionByName(one(b, "b"))


LOCATION_SQL = f"""{SIDES_SQL}, cand AS (
  SELECT x.bid AS a, y.bid AS b, sqrt(pow((y.mx - x.mx) * cos(radians(x.my / {DEG!r})), 2) + pow(y.my - x.my, 2)) AS d, x.area AS aa, y.area AS ba
  FROM sa x JOIN sb y ON y.mx BETWEEN x.mx - 51 AND x.mx + 51 AND y.my BETWEEN x.my - 51 AND x.my + 51
), c0 AS (SELECT a, b, floor(d * 1e6 + 0.5) AS d FROM cand WHERE d <= least(50, greatest(3, 0.5 * sqrt(greatest(aa, ba)))) AND greatest(aa, ba) <= 2 * least(aa, ba)),
m1 AS (SELECT a, b FROM (SELECT a, b, row_number() OVER (PARTITION BY a ORDER BY d, b) AS ra, row_number() OVER (PARTITION BY b ORDER BY d, a) AS rb FROM c0) WHERE ra = 1 AND rb = 1),
c1 AS (SELECT * FROM c0 WHERE a NOT IN (SELECT a FROM m1) AND b NOT IN (SELECT b FROM m1)),
m2 AS (SELECT a, b FROM (SELECT a, b, row_number() OVER (PARTITION BY a ORDER BY d, b) AS ra, row_number() OVER (PARTITION BY b ORDER BY d, a) AS rb FROM c1) WHERE ra = 1 AND rb = 1),
c2 AS (SELECT * FROM c1 WHERE a NOT IN (SELECT a FROM m2) AND b NOT IN (SELECT b FROM m2)),
m3 AS (SELECT a, b FROM (SELECT a, b, row_number() OVER (PARTITION BY a ORDER BY d, b) AS ra, row_number() OVER (PARTITION BY b ORDER BY d, a) AS rb FROM c2) WHERE ra = 1 AND rb = 1),
lp AS (SELECT * FROM m1 UNION ALL SELECT * FROM m2 UNION ALL SELECT * FROM m3)"""


@query("d11_location_match", f"WITH {LOCATION_SQL} SELECT a, b FROM lp")
def location_match(spark, sf_dir):
    """Mutual nearest within a radius by size, three rounds."""
    a, b = sides(spark, sf_dir)
    near = D.location_candidates(a, b).withColumn("d", F.floor(F.col("d") * 1e6 + 0.5))
    return D.match_rounds(near, D.MATCH_ROUNDS)


@query(
    "k29_reidentified",
    f"""WITH {KEYED_SQL}, x AS (SELECT sa.* FROM sa JOIN st ON st.side = 'a' AND st.bid = sa.bid AND status = 'removed'), y AS (SELECT sb.* FROM sb JOIN st ON st.side = 'b' AND st.bid = sb.bid AND status = 'added'),
    rc AS (SELECT x.bid AS a, y.bid AS b, sqrt(pow((y.mx - x.mx) * cos(radians(x.my / {DEG!r})), 2) + pow(y.my - x.my, 2)) AS d, x.area AS aa, y.area AS ba FROM x JOIN y ON y.mx BETWEEN x.mx - 51 AND x.mx + 51 AND y.my BETWEEN x.my - 51 AND x.my + 51),
    r0 AS (SELECT * FROM rc WHERE d <= least(50, greatest(3, 0.5 * sqrt(greatest(aa, ba)))) AND greatest(aa, ba) <= 2 * least(aa, ba))
    SELECT a, b FROM (SELECT a, b, row_number() OVER (PARTITION BY a ORDER BY d, b) AS ra, row_number() OVER (PARTITION BY b ORDER BY d, a) AS rb FROM r0) WHERE ra = 1 AND rb = 1""",
)
def reidentified(spark, sf_dir):
    a, b, pairs_, _ = compared(spark, sf_dir)
    return D.reidentified(a, b, D.statuses(a, pairs_, "a"), D.statuses(b, pairs_, "b"))


@query(
    "k31_gate_counts",
    f"WITH {KEYED_SQL} SELECT (SELECT count(*) FROM sa) AS n_a, (SELECT count(*) FROM sb) AS n_b, (SELECT count(*) FROM st WHERE status = 'removed') AS removed, (SELECT count(*) FROM kp) AS matched, (SELECT count(*) FROM cmp WHERE geom_class = 'major') AS major",
)
def gate_counts(spark, sf_dir):
    """What the gate judges, in one row."""
    a, b, pairs_, c = compared(spark, sf_dir)
    none, rows = F.lit(0).cast("long"), F.count(F.lit(1))
    kinds = ("n_a", "n_b", "removed", "matched", "major")
    one = lambda df, **n: df.agg(*[n.get(k, none).alias(k) for k in kinds])  # noqa: E731  one row each
    of_a = one(D.statuses(a, pairs_, "a"), n_a=rows, removed=F.count_if(F.col("status") == "removed"), matched=F.count_if(F.col("status") == "matched"))
    parts = of_a.unionByName(one(b, n_b=rows)).unionByName(one(c, major=F.count_if(F.col("geom_class") == "major")))
    return parts.agg(*[F.sum(k).alias(k) for k in kinds])


@query(
    "k31_gate_findings",
    f"""WITH {KEYED_SQL}, n AS (SELECT (SELECT count(*) FROM sa)::DOUBLE AS na, (SELECT count(*) FROM sb)::DOUBLE AS nb, (SELECT count(*) FROM st WHERE status = 'removed')::DOUBLE AS gone, (SELECT count(*) FROM kp)::DOUBLE AS kept, (SELECT count(*) FROM cmp WHERE geom_class = 'major')::DOUBLE AS major,
      (SELECT count(*) FROM sa WHERE key IS NULL) AS ea, (SELECT count(*) FROM sb WHERE key IS NULL) AS eb, (SELECT count(*) FROM (SELECT key FROM sa WHERE key IS NOT NULL GROUP BY key HAVING count(*) > 1)) AS da, (SELECT count(*) FROM (SELECT key FROM sb WHERE key IS NOT NULL GROUP BY key HAVING count(*) > 1)) AS db),
    f AS (SELECT 'empty_keys_a' AS code, 'info' AS level, ea::DOUBLE AS value, ea > 0 AS holds FROM n UNION ALL SELECT 'empty_keys_b', 'fail', eb, eb > 0 FROM n UNION ALL SELECT 'dup_keys_a', 'info', da, da > 0 FROM n UNION ALL SELECT 'dup_keys_b', 'fail', db, db > 0 FROM n
      UNION ALL SELECT 'count_change', CASE WHEN 100 * abs(nb - na) / na > 10 THEN 'fail' ELSE 'warn' END, 100 * abs(nb - na) / na, 100 * abs(nb - na) / na > 2 FROM n
      UNION ALL SELECT 'removed', CASE WHEN 100 * gone / na > 5 THEN 'fail' ELSE 'warn' END, 100 * gone / na, 100 * gone / na > 1 FROM n UNION ALL SELECT 'geom_major', 'warn', 100 * major / kept, 100 * major / kept > 2 FROM n)
    SELECT CASE WHEN bool_or(level = 'fail') OVER () THEN 'fail' WHEN bool_or(level = 'warn') OVER () THEN 'warn' ELSE 'pass' END AS verdict, code, level, value FROM f WHERE holds""",
)
def gate_findings(spark, sf_dir):
    a, b = sides(spark, sf_dir)
    m = gate_counts(spark, sf_dir).first().asDict()
    one = lambda df, side: D.quality(df).drop("buildings").withColumn("side", F.lit(side))
    for r in one(a, "a").unionByName(one(b, "b")).collect():  # a row for each side
        m |= {f"{k}_{r.side}": v for k, v in r.asDict().items() if k != "side"}
    verdict, found = D.gate(m)
    return spark.createDataFrame([(verdict, *f) for f in found] or [(verdict, "none", "info", 0.0)], "verdict string, code string, level string, value double")


# ---- closed forms ---------------------------------------------------------------------------------


@query(
    "j16_mercator_inverse",
    "SELECT o_orderkey, floor((o_orderkey * 997.5 / 6378137.0 * 180 / pi()) * 1e6 + 0.5) / 1e6 AS lon, floor(degrees(2 * atan(exp(o_custkey * 1013.5 / 6378137.0)) - pi() / 2) * 1e6 + 0.5) / 1e6 AS lat FROM orders",
)
def mercator_inverse(spark, sf_dir):
    return table(spark, sf_dir, "orders").select("o_orderkey", six(G.mercator_lon(F.col("o_orderkey") * 997.5)).alias("lon"), six(G.mercator_lat(F.col("o_custkey") * 1013.5)).alias("lat"))


@query("j20_tile_index", "SELECT o_orderkey, floor((o_orderkey * 997.5 + 20037508.342789244) / (2 * 20037508.342789244 / 131072))::BIGINT AS tx FROM orders")
def tile_index(spark, sf_dir):
    return table(spark, sf_dir, "orders").select("o_orderkey", G.tile_index(F.col("o_orderkey") * 997.5, 17).alias("tx"))


_N = (1 / 298.257223563) / (2 - 1 / 298.257223563)
_E = 2 * math.sqrt(_N) / (1 + _N)
_SERIES = (_N / 2 - 2 * _N**2 / 3 + 5 * _N**3 / 16, 13 * _N**2 / 48 - 3 * _N**3 / 5, 61 * _N**3 / 240)
_SCALE = 0.9996 * 6378137.0 / (1 + _N) * (1 + _N**2 / 4 + _N**4 / 64)
_SH, _CH = "((exp({0}) - exp(-({0}))) / 2)", "((exp({0}) + exp(-({0}))) / 2)"
UTM_SQL = f"""WITH q AS (SELECT o_orderkey, 105.0::DOUBLE + o_orderkey % 1000 / 1000.0::DOUBLE AS lon, 21.0::DOUBLE + o_custkey % 100 / 100.0::DOUBLE AS lat FROM orders),
    r AS (SELECT o_orderkey, radians(lon - (floor((lon + 180) / 6) + 1) * 6 + 183) AS lam, sin(radians(lat)) AS s FROM q),
    t AS (SELECT o_orderkey, lam, {_SH.format(f"0.5 * ln((1 + s) / (1 - s)) - {_E!r} * 0.5 * ln((1 + {_E!r} * s) / (1 - {_E!r} * s))")} AS t FROM r),
    x AS (SELECT o_orderkey, atan2(t, cos(lam)) AS xi, 0.5 * ln((1 + sin(lam) / sqrt(1 + t * t)) / (1 - sin(lam) / sqrt(1 + t * t))) AS eta FROM t)
    SELECT o_orderkey, floor((500000 + {_SCALE!r} * (eta + {" + ".join(f"{c!r} * cos({2 * j} * xi) * {_SH.format(f'{2 * j} * eta')}" for j, c in enumerate(_SERIES, 1))})) * 1e6 + 0.5) / 1e6 AS east,
    floor({_SCALE!r} * (xi + {" + ".join(f"{c!r} * sin({2 * j} * xi) * {_CH.format(f'{2 * j} * eta')}" for j, c in enumerate(_SERIES, 1))}) * 1e6 + 0.5) / 1e6 AS north FROM x"""


@query("i10_utm_zone", "SELECT c_custkey, 32600 + least(60, greatest(1, floor((c_custkey % 360 - 180 + 180) / 6) + 1))::INTEGER AS epsg FROM customer")
def utm_zone(spark, sf_dir):
    return table(spark, sf_dir, "customer").select("c_custkey", G.utm_epsg(F.col("c_custkey") % 360 - 180, F.lit(21.0)).alias("epsg"))


@query("i10_utm_forward", UTM_SQL)
def utm_forward(spark, sf_dir):
    east, north = G.utm_forward(105.0 + F.col("o_orderkey") % 1000 / 1000, 21.0 + F.col("o_custkey") % 100 / 100)
    return table(spark, sf_dir, "orders").select("o_orderkey", six(east).alias("east"), six(north).alias("north"))
