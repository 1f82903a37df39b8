"""What follows conflation: stable ids, tiers, invariants."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from cadastra.operators.graph import assign_ids
from cadastra.operators.staging import stage

# Tiers, their class lists and limits.
TIERS = ("T1_iconic", "T1_landmark", "T2_commercial", "T2_highrise_residential", "T2_large", "T3_residential")
NON_RESIDENTIAL = (
    "commercial", "retail", "office", "hotel", "public", "government", "civic", "hospital", "clinic", "school",
    "university", "college", "kindergarten", "temple", "shrine", "pagoda", "monastery", "church", "cathedral",
    "chapel", "basilica", "mosque", "synagogue", "religious", "industrial", "warehouse", "factory", "manufacture",
    "train_station", "transportation", "stadium", "sports_hall", "sports_centre", "museum", "supermarket", "bank",
    "fire_station", "police", "military", "barracks", "conference_centre", "theatre", "cinema", "library",
    "embassy", "parking", "hangar", "bus_station", "terminal", "data_center", "market", "mall", "palace",
)
LANDMARK_BUILDINGS = (
    "temple", "shrine", "pagoda", "monastery", "church", "cathedral", "chapel", "basilica", "mosque", "synagogue",
    "religious", "government", "civic", "public", "stadium", "palace", "castle", "museum", "mausoleum",
    "train_station",
)
LANDMARK_HISTORIC = ("city_gate", "monument", "memorial", "castle", "fort", "palace", "citywalls", "tomb", "mausoleum")
LANDMARK_TOURISM = ("attraction", "museum", "gallery")
HOTEL_TOURISM = ("hotel", "guest_house")
RESIDENTIAL = (
    "residential", "house", "detached", "semidetached_house", "terrace", "apartments", "dormitory",
    "bungalow", "villa", "hut", "cabin", "farm", "houseboat", "static_caravan",
)
APARTMENTS = ("apartments", "dormitory")
MINOR = (
    "roof", "carport", "garage", "garages", "shed", "guardhouse", "kiosk", "toilets", "service", "booth",
    "container", "shelter", "bunker", "cowshed", "sty", "greenhouse", "gatehouse",
)
NO_CLASS = ("yes", "true", "1")
POI_ANCHORS = (
    "PROP_COMM_%", "ESS_GOV_%", "%HOTEL%", "ESS_HEALTH_HOSPITAL", "ESS_EDU_UNIVERSITY", "SHOP_GROC_SUPERMARKET",
    "TOUR_CULTURE_MUSEUM",
)
HIGHRISE_LEVELS, HIGHRISE_M, LARGE_M2, TINY_M2, PIN_NEAREST_M = 9, 30.0, 2000.0, 15.0, 30.0


def anchor_poi(code):
    """Is a place category one that makes a building commercial?"""
    out = F.lit(False)
    for pattern in POI_ANCHORS:
        out = out | code.like(pattern)
    return out


def tiers(canon: DataFrame, pinned: DataFrame | None = None, anchored: DataFrame | None = None, locked: DataFrame | None = None) -> DataFrame:
    """canon (id, building, name, tags, levels, height_m, height_provenance, area) -> id, tier, rule, flags.

    The first of eight rules that holds wins. pinned (id, nearest): buildings of pins, nearest telling one that
    only lies near. anchored (id): buildings that hold an anchor place. locked (id): landmarks.
    """
    df = canon
    for side, name in ((anchored, "anchored"), (locked, "locked")):
        df = df.withColumn(name, F.lit(False)) if side is None else df.join(side.select("id", F.lit(True).alias(name)).distinct(), "id", "left")
    if pinned is None:
        df = df.withColumn("pin", F.lit(None).cast("boolean"))
    else:
        df = df.join(pinned.groupBy("id").agg(F.min("nearest").alias("pin")), "id", "left")
    tag = lambda k: F.nullif(F.lower(F.trim(F.col("tags")[k])), F.lit(""))  # noqa: E731  a blank tag is none
    b = F.lower(F.trim("building"))
    b = F.when(~b.isin("", *NO_CLASS), b)
    named = F.coalesce(F.trim("name"), F.lit("")) != ""
    high = (F.col("levels") >= HIGHRISE_LEVELS) | ((F.col("height_m") >= HIGHRISE_M) & ~F.col("height_provenance").isin("default", "landmark"))
    landmark = named & (
        (tag("wikidata").isNotNull() & (tag("historic").isNotNull() | tag("tourism").isin(*LANDMARK_TOURISM) | b.isin(*LANDMARK_BUILDINGS)))
        | tag("historic").isin(*LANDMARK_HISTORIC)
        | tag("heritage").isin("1", "2")
    )
    rules = [
        (F.coalesce("locked", F.lit(False)) | F.col("pin").isNotNull(), TIERS[0]),
        (landmark, TIERS[1]),
        (b.isin(*NON_RESIDENTIAL) | tag("tourism").isin(*HOTEL_TOURISM), TIERS[2]),
        (F.coalesce("anchored", F.lit(False)), TIERS[2]),
        (b.isin(*APARTMENTS) | (b.isin(*RESIDENTIAL) & high), TIERS[3]),
        (high, TIERS[4]),
        (F.col("area") >= LARGE_M2, TIERS[4]),
        (b.isin(*RESIDENTIAL), TIERS[5]),
    ]
    rule, tier = F.lit(0), F.lit(TIERS[5])
    for k, (test, name) in reversed(list(enumerate(rules, 1))):
        hit = F.coalesce(test, F.lit(False))
        rule, tier = F.when(hit, k).otherwise(rule), F.when(hit, name).otherwise(tier)
    nearest = (rule == 1) & ~F.coalesce("locked", F.lit(False)) & F.col("pin")
    flags = F.array_compact(
        F.array(F.when(nearest, "iconic_pin_nearest"), F.when((rule == 0) & b.isin(*MINOR), "minor_structure"), F.when((rule == 0) & (F.col("area") < TINY_M2), "tiny_footprint_qc"))
    )
    return df.select("id", tier.alias("tier"), rule.alias("rule"), flags.alias("flags"))


def part_tiers(parts: DataFrame, of: DataFrame) -> DataFrame:
    """Parts (id, parent) take their parent's tier, without flags."""
    up = of.select(F.col("id").alias("parent"), "tier", "rule")
    return parts.join(up, "parent").select("id", "tier", "rule", F.expr("cast(array() as array<string>)").alias("flags"))


def new_ids(keys: DataFrame, taken: DataFrame, build: str) -> DataFrame:
    """(key, id): an id for each key from its build and key; one that any build has given (taken: id) is drawn again."""
    draw, out, left = 0, None, keys
    while True:
        drawn = left.select("key", F.concat(F.lit("new:"), F.md5(F.concat_ws("|", F.lit(build), F.lit(str(draw)), "key").cast("binary"))).alias("id"))
        drawn = stage(drawn.join(taken.select("id", F.lit(True).alias("held")).distinct(), "id", "left"), "new-ids")
        part = drawn.where("held is null").select("key", "id")
        out = part if out is None else out.unionByName(part)
        left = drawn.where("held").select("key")
        if left.isEmpty():
            return out
        draw += 1


def stable_ids(rows: DataFrame, registry: DataFrame, build: str = "") -> DataFrame:
    """rows (key, locked_id, evidence array<string>), registry (key, building_id) -> key, building_id, how.

    In key order: a locked id goes to its first row; then the winner's registered id, where it is free; then the
    first free registered id among the evidence, in its order. Rows left get an id from their key and the build, one
    that no build has given before (kept ever after by the registry).
    """
    first = W.partitionBy("id").orderBy("key")
    locked = rows.where("locked_id is not null").select("key", F.col("locked_id").alias("id")).withColumn("k", F.row_number().over(first)).where("k = 1").drop("k")
    rest = rows.join(locked.select("key"), "key", "left_anti")
    own = rest.select("key").join(registry.select("key", F.col("building_id").alias("id")), "key").join(locked.select("id"), "id", "left_anti")
    own = own.withColumn("k", F.row_number().over(first)).where("k = 1").select("key", "id")
    taken = locked.select("id").union(own.select("id"))
    open_ = rest.join(own.select("key"), "key", "left_anti")
    wants = open_.select("key", F.posexplode("evidence").alias("pref", "e"))
    wants = wants.join(registry.select(F.col("key").alias("e"), F.col("building_id").alias("id")), "e").join(taken, "id", "left_anti")
    wants = wants.groupBy("key", "id").agg(F.min("pref").alias("pref"))
    by_evidence = assign_ids(open_.select("key"), wants)
    given = registry.select(F.col("building_id").alias("id")).union(locked.select("id"))
    new = new_ids(open_.select("key").join(by_evidence.select("key"), "key", "left_anti"), given, build)
    out = None
    for df, how in ((locked, "locked"), (own, "winner"), (by_evidence, "evidence"), (new, "new")):
        part = df.select("key", F.col("id").alias("building_id"), F.lit(how).alias("how"))
        out = part if out is None else out.unionByName(part)
    return out


def updated_registry(registry: DataFrame, rows: DataFrame, ids: DataFrame) -> DataFrame:
    """After a build every winner and evidence key points to its row's id; others stay."""
    now = rows.join(ids, "key").select(F.explode(F.array_prepend("evidence", F.col("key"))).alias("key"), "building_id")
    now = now.groupBy("key").agg(F.min("building_id").alias("building_id"))
    return registry.join(now.select("key"), "key", "left_anti").select("key", "building_id").unionByName(now)


def invariants(canon: DataFrame, members: DataFrame, ids: DataFrame) -> DataFrame:
    """(check, violations): all must be 0."""
    one = lambda name, df: df.agg(F.lit(name).alias("check"), F.count(F.lit(1)).alias("violations"))
    checks = [
        one("null_id", ids.where("building_id is null")),
        one("duplicate_id", ids.groupBy("building_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1")),
        one("no_id", canon.join(ids.select(F.col("key").alias("id")), "id", "left_anti")),
        one("evidence_is_canonical", canon.join(members.where("role = 'evidence'").select("id"), "id", "left_semi")),
        one("winner_missing", members.where("role = 'evidence'").join(members.where("role = 'winner'").select(F.col("id").alias("winner")), "winner", "left_anti")),
        one("evidence_twice", members.where("role = 'evidence'").groupBy("id").agg(F.count(F.lit(1)).alias("n")).where("n > 1")),
        one("no_area", canon.where("area is null or area <= 0")),
        one("empty_box", canon.where("x1 <= x0 or y1 <= y0")),
        one("duplicate_footprint", canon.groupBy("id").agg(F.count(F.lit(1)).alias("n")).where("n > 1")),
    ]
    out = checks[0]
    for c in checks[1:]:
        out = out.unionByName(c)
    return out


#: Versions of the tier rules; a published version is never changed.
RULES = {"v1": tiers}


def rule(version: str):
    if version not in RULES:
        raise ValueError(f"unknown rule {version}; there are {', '.join(sorted(RULES))}")
    return RULES[version]
