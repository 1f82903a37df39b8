"""Operators on small literal inputs."""

import gzip
import json
import math
import random
import zipfile

import numpy as np
import pytest
from pyspark.sql import functions as F

from cadastra import sources
from cadastra.functions import geometry as G
from cadastra.functions import rings, routes, s2, shadows, tags
from cadastra.operators import graph, sinks
from cadastra.plans import conflation as C
from cadastra.plans import diff as D
from cadastra.plans import release as R
from cadastra.functions import formats
from cadastra.plans import canonical, convert, landmarks, osm, schema
from cadastra.plans.polygons import box_wkb


def box(x0, y0, x1, y1):
    return [np.array([[x0, y0], [x1, y0], [x1, y1], [x0, y1]], float)]


def test_overlay_areas():
    rng = random.Random(5)
    for _ in range(40):
        blobs = []
        for _ in range(2):
            t = [(k + rng.random()) * 2 * math.pi / 9 for k in range(9)]
            r, cx, cy = [rng.uniform(1, 5) for _ in t], rng.uniform(0, 4), rng.uniform(0, 4)
            blobs.append([[np.array([[cx + d * math.cos(a), cy + d * math.sin(a)] for a, d in zip(t, r)])]])
        a, b = blobs
        both = G.polygon_area(a[0]) + G.polygon_area(b[0])
        assert math.isclose(G.intersection(a, b)[0] + G.union(a, b)[0], both, rel_tol=1e-9)
        assert math.isclose(G.difference(a, b)[0] + G.intersection(a, b)[0], G.polygon_area(a[0]), rel_tol=1e-9)
    assert G.box_union_area(np.array([[0, 0, 2, 2], [1, 1, 3, 3], [0, 0, 1, 1]], float)) == 7


def test_polygon_kernels():
    shell, hole = box(0, 0, 30, 30)[0], box(10, 10, 20, 20)[0]
    assert G.polygon_area([shell, hole]) == 800
    assert G.polygons_centroid([[shell, hole]]) == (15, 15)
    assert not G.point_in_polygon(15, 15, [shell, hole]) and G.point_in_polygon(5, 15, [shell, hole])
    assert G.point_in_polygon(*G.point_on_surface([shell, hole]), [shell, hole])
    assert G.is_valid([shell, hole]) and not G.is_valid([np.array([[0, 0], [2, 2], [2, 0], [0, 2]], float)])
    assert abs(G.ring_area(G.clip_to_box(shell, 20, 20, 50, 50))) == 100
    assert len(G.convex_hull(np.vstack([shell, hole]))) == 4
    wkb = G.write_wkb([[shell, hole], box(50, 50, 51, 51)])
    assert [len(p) for p in G.read_wkb(wkb)] == [2, 1] and G.read_wkt(G.write_wkt(G.read_wkb(wkb)))[0][0].tolist() == shell.tolist()
    assert G.read_wkb(b"") == [] and G.read_wkt("POINT (1 2)") == []


def test_shadows():
    ell = [np.array([[0, 0], [20, 0], [20, 10], [10, 10], [10, 20], [0, 20]], float)]
    square = box(0, 0, 10, 10)
    east = lambda b: shadows.dissolved_shadow(b, 1.0, 0.0)[0]
    assert math.isclose(east([(square, 0, 10)]), 100)
    assert math.isclose(east([(ell, 0, 5)]), 100)
    assert math.isclose(east([(square, 5, 10)]), 100)
    assert math.isclose(east([(square, 0, 10), (box(0, 2, 10, 8), 0, 20)]), 160)
    assert shadows.shadow_pieces(square, 5, 5, 1, 0) == []
    assert shadows.sun_offset(270, 45) == pytest.approx((1, 0), abs=1e-9)


def test_s2():
    leaf = s2.leaf_cells(np.array([21.03, 10.77]), np.array([105.85, 106.70]))
    assert [s2.token(c) for c in s2.parent(leaf, 4)][0] == "313" and [s2.token(c) for c in s2.parent(leaf, 6)][0] == "3135"
    for level in range(1, 29):
        assert (s2.parent(s2.parent(leaf, level + 1), level) == s2.parent(leaf, level)).all()


def test_rings_and_routes():
    a, b, c, d = (0.0, 0.0), (4.0, 0.0), (4.0, 4.0), (0.0, 4.0)
    (ring,), open_ = rings.stitch([[a, b, c], [a, d, c]])
    assert abs(G.ring_area(ring)) == 16 and open_ == 0 and rings.stitch([[a, b, c]]) == ([], 1)
    # one way of another ring is missing: the closed one stays
    e, f, g = (9.0, 9.0), (12.0, 9.0), (12.0, 12.0)
    found, open_ = rings.stitch([[e, f], [a, b, c], [c, d, a], [f, g]])
    assert len(found) == 1 and abs(G.ring_area(found[0])) == 16 and open_ == 1
    assert rings.is_closed([a, b, c, a]) and not rings.is_closed([a, b, a])
    assert len(rings.polygons([ring], [box(1, 1, 2, 2)[0], box(9, 9, 10, 10)[0]])[0]) == 2
    edges = [("a", "b", 1, "door"), ("b", "c", 1, "stairs"), ("a", "c", 5, "door")]
    assert routes.shortest_path(edges, "a", "c") == (2, ["a", "b", "c"])
    assert routes.shortest_path(edges, "a", "c", frozenset({"stairs"})) == (5, ["a", "c"]) and routes.shortest_path(edges, "a", "z") is None
    assert routes.spaced([(0, 0), (50, 0), (130, 0)], 5, 120) == [(0, 0), (130, 0)]
    lods = [{"name": "a", "min": 0, "max": 15}, {"name": "b", "min": 14, "max": 20}]
    assert routes.pick_lod(lods, 14.5)["name"] == "b" and routes.overlapping(lods) == [("a", "b")]


LENGTHS = {"12": 12, "12.5": 12.5, "12,5": 12.5, "12 m": 12, "40'": 12.192, "40 ft": 12.192, "12'6\"": 3.81, "10-12": None, "tall": None, "-3": None, "0": None, "2000": None, "": None}


def test_tag_parsing(spark):
    df = spark.createDataFrame([(k,) for k in LENGTHS], "t string")
    got = {r.t: r.m for r in df.select("t", tags.length_m(F.col("t")).alias("m")).collect()}
    assert got == LENGTHS
    levels = {"5": 5, "3;4": 4, "2,5": 2.5, "x": None, "3;x": None, "300": None, "0": None}
    df = spark.createDataFrame([(k,) for k in levels], "t string")
    assert {r.t: r.m for r in df.select("t", tags.levels(F.col("t"), 1).alias("m")).collect()} == levels


def test_schema_and_gate(spark):
    a = schema.StructType.fromDDL("id string, n int, h double, gone string, t timestamp")
    b = schema.StructType.fromDDL("id string, n double, h int, t string, new string")
    found = {(f[0], f[2]) for f in schema.schema_diff(a, b, required=("gone",))}
    assert found == {("schema_missing", "gone"), ("schema_added", "new"), ("schema_type_info", "n"), ("schema_type_warn", "h"), ("schema_type_fail", "t")}
    assert schema.type_change("timestamp", "string", tiles=True) == "info"
    base = {"n_a": 1000, "n_b": 1000, "removed": 5, "matched": 990, "major": 3, "measured_a": 500, "measured_b": 500, "known_a": 1000, "known_b": 1000}
    assert D.gate(base) == ("pass", [])
    assert D.gate(base | {"n_b": 1030})[0] == "warn" and D.gate(base | {"n_b": 1200})[0] == "fail"
    assert D.gate(base | {"removed": 60})[1][0][:2] == ("removed", "fail")
    assert D.gate(base | {"dup_keys_b": 1})[0] == "fail" and D.gate(base | {"dup_keys_b": 1, "key_mode": False})[0] == "pass"
    assert [f[0] for f in D.gate(base | {"measured_b": 480, "nulls_a": {"x": 0}, "nulls_b": {"x": 100}})[1]] == ["null_increase", "real_height_drop"]
    with pytest.raises(ValueError):
        D.Thresholds(warn_count_pct=50)
    with pytest.raises(ValueError):
        schema.checked_predicate("a = 1; drop table x")


def nodes_and_pairs(spark, ranks, merge, other=()):
    o = spark.createDataFrame([(n, C.FAMILIES[r - 1], r, 100.0) for n, r in ranks.items()], "id string, family string, rank int, area double")
    rows = [(*sorted(e, key=lambda n: ranks[n]), inter, m) for es, m in ((merge, True), (other, False)) for *e, inter in es]
    return o, spark.createDataFrame(rows, "a string, b string, inter double, is_merge boolean")


def test_component_relations(spark):
    ranks = {"o1": 1, "g1": 2, "o2": 1, "g2": 2, "g3": 2, "o3": 1, "o4": 1, "g4": 2, "o5": 1, "g5": 2, "m5": 3, "n5": 3}
    merge = [("o1", "g1", 50.0), ("o2", "g2", 40.0), ("o2", "g3", 40.0), ("o3", "g4", 60.0), ("o4", "g4", 30.0), ("o5", "g5", 50.0), ("g5", "m5", 20.0), ("m5", "g5", 20.0)]
    o, pairs = nodes_and_pairs(spark, ranks, merge[:-1])
    groups, members = C.resolve(o, pairs, C.Params())
    relation = {r.comp: (r.relation, r.gap) for r in groups.collect()}
    assert relation["g1"] == ("one_to_one", False) and relation["g2"] == ("split", False) and relation["g4"] == ("aggregate", False)
    # m5 overlaps only g5, which is evidence: it is resolved again by itself, as a gap
    assert relation["g5"] == ("one_to_one", False) and relation["m5"] == ("single_source", True)
    roles = {r.id: (r.role, r.winner) for r in members.collect()}
    assert roles["g4"] == ("evidence", "o3") and roles["m5"] == ("winner", "m5") and "n5" not in roles


def test_stable_ids(spark):
    rows = spark.createDataFrame([("a", "L", []), ("b", None, ["e1"]), ("c", None, ["e1", "e2"]), ("d", None, ["e1"]), ("e", "L", []), ("f", None, [])], "key string, locked_id string, evidence array<string>")
    registry = spark.createDataFrame([("b", "B"), ("f", "B"), ("e1", "X"), ("e2", "Y"), ("z", "Z")], "key string, building_id string")
    ids = R.stable_ids(rows, registry)
    got = {r.key: (r.building_id if r.how != "new" else "new", r.how) for r in ids.collect()}
    assert got == {"a": ("L", "locked"), "b": ("B", "winner"), "c": ("X", "evidence"), "d": ("new", "new"), "e": ("new", "new"), "f": ("new", "new")}
    after = {r.key: r.building_id for r in R.updated_registry(registry, rows, ids).collect()}
    assert after["a"] == "L" and after["e1"] == "B" and after["z"] == "Z"


def test_ids_over_several_builds(spark):
    """A key that was inherited once and stands alone again gets an id that no build has given."""
    schema, known = "key string, locked_id string, evidence array<string>", "key string, building_id string"
    registry, seen = spark.createDataFrame([], known), set()
    builds = ([("Z", None, [])], [("B", None, ["Z"])], [("B", None, []), ("Z", None, [])], [("Z", None, ["B"]), ("q", None, [])])
    for n, rows in enumerate(builds):
        now = spark.createDataFrame(rows, schema)
        for name in (f"b{n}", ""):  # the same build name again and again, too
            ids = R.stable_ids(now, registry, name)
            found = {r.key: r.building_id for r in ids.collect()}
            assert len(set(found.values())) == len(rows)
        registry = spark.createDataFrame([tuple(r) for r in R.updated_registry(registry, now, ids).collect()], known)
        seen |= set(found.values())
    assert len(seen) == 3  # Z's first id, which B keeps, then one for Z, then one for q


def test_group_iou_of_many_boxes(spark):
    rng = random.Random(8)
    rows, members = [], []
    for g in range(30):
        for k in range(rng.randint(1, 6)):
            x, y = rng.randint(0, 12), rng.randint(0, 12)
            side = "winner" if k == 0 or rng.random() < 0.4 else "evidence"
            rows.append((f"{g}/{k}", x, y, x + rng.randint(1, 9), y + rng.randint(1, 9)))
            members.append((f"{g}/{k}", f"g{g}", side))
    size = {r[0]: (r[3] - r[1]) * (r[4] - r[2]) for r in rows}
    box_of = {r[0]: r[1:] for r in rows}
    cells = {i: {(x, y) for x in range(b[0], b[2]) for y in range(b[1], b[3])} for i, b in box_of.items()}
    first = {g: next(i for i, h, _ in members if h == g) for _, g, _ in members}
    inter = [(i, g, s, float(len(cells[i] & cells[first[g]])) if s == "evidence" else None) for i, g, s in members]
    side = lambda g, s: set().union(*(cells[i] for i, h, t in members if (h, t) == (g, s)), set())
    want = {}
    for g in first:
        w, e = side(g, "winner"), side(g, "evidence")
        want[g] = len(w & e) / len(w | e) if e else None
    obs = spark.createDataFrame([(i, float(size[i]), *b) for i, b in box_of.items()], "id string, area double, x0 int, y0 int, x1 int, y1 int")
    m = spark.createDataFrame(inter, "id string, gid string, role string, inter double")
    shapes = obs.withColumn("geometry", box_wkb("x0", "y0", "x1", "y1"))
    for o in (obs, shapes):
        got = {r.gid: r.group_iou for r in C.group_iou(m, o).collect()}
        assert got.keys() == want.keys() and all(got[g] == pytest.approx(want[g]) for g in want)


def test_conflation_of_polygons_in_three_families(spark):
    """Evidence that overlaps no winner is resolved by itself, on polygons whose boxes would all overlap."""
    shapes = {
        "osm": [("o1", [(0, 0), (40, 0), (40, 10), (10, 10), (10, 40), (0, 40)])],
        "gob": [("g1", [(0, 0), (40, 0), (40, 10), (10, 10), (10, 38), (0, 38)]), ("g2", [(20, 20), (40, 20), (40, 40), (20, 40)])],
        "gba_ms": [("m1", [(20, 20), (40, 20), (40, 38), (20, 38)]), ("m2", [(4, 4), (9, 4), (9, 9), (4, 9)])],
    }
    sources_ = {}
    for family, rows in shapes.items():
        made = [(i, G.ring_area(np.array(r, float)), *np.min(r, 0).tolist(), *np.max(r, 0).tolist(), G.write_wkb([[np.array(r, float)]])) for i, r in rows]
        sources_[family] = spark.createDataFrame([(i, a, float(x0), float(y0), float(x1), float(y1), w) for i, a, x0, y0, x1, y1, w in made], "id string, area double, x0 double, y0 double, x1 double, y1 double, geometry binary")
    p = C.Params()
    obs = C.observations(sources_, p)
    pairs = C.overlap_pairs(obs, p)
    assert {(r.a, r.b) for r in pairs.collect()} == {("o1", "g1"), ("o1", "m2"), ("g1", "m2"), ("g2", "m1")}
    groups, members = C.resolve(obs, pairs, p)
    roles = {r.id: (r.role, r.winner) for r in members.collect()}
    assert roles == {"o1": ("winner", "o1"), "g1": ("evidence", "o1"), "m2": ("evidence", "o1"), "g2": ("winner", "g2"), "m1": ("evidence", "g2")}
    iou = {r.gid: r.group_iou for r in C.group_iou(members, obs).collect()}
    assert iou["0:g1"] == pytest.approx(680 / 700) and iou["0:g2"] == pytest.approx(0.9)


def test_serial_dictatorship(spark):
    rng = random.Random(3)
    wanted = [(f"k{k:02}", p, f"i{i}") for k in range(30) for p, i in enumerate(rng.sample(range(25), rng.randint(0, 4)))]
    used, want = set(), {}
    for k in range(30):
        for key, _, i in sorted(w for w in wanted if w[0] == f"k{k:02}"):
            if i not in used:
                used.add(i)
                want[key] = i
                break
    got = graph.assign_ids(spark.createDataFrame([(f"k{k:02}",) for k in range(30)], "key string"), spark.createDataFrame(wanted, "key string, pref int, id string"))
    assert {r.key: r.id for r in got.collect()} == want


def test_sources(spark, tmp_path):
    feature = {"type": "Feature", "properties": {"name": "x"}, "geometry": {"type": "Polygon", "coordinates": [[[0, 0], [2, 0], [2, 2], [0, 2], [0, 0]]]}}
    (tmp_path / "a.geojson").write_text(json.dumps({"type": "FeatureCollection", "features": [feature, feature]}))
    df = sources.geojson(spark, str(tmp_path / "a.geojson"))
    rows = df.select(sources.metrics("geometry").alias("m"), "properties").collect()
    assert [(r.m.area, r.m.cx, r.properties["name"]) for r in rows] == [(4.0, 1.0, "x")] * 2
    square = [{"lon": x, "lat": y} for x, y in ((0, 0), (1, 0), (1, 1), (0, 1), (0, 0))]
    answer = {"osm3s": {"timestamp_osm_base": "t"}, "elements": [
        {"type": "way", "id": 1, "version": 1, "tags": {"building": "house", "height": "12 m"}, "geometry": square},
        {"type": "way", "id": 1, "version": 2, "tags": {"building": "yes", "building:levels": "3"}, "geometry": square},
        {"type": "way", "id": 2, "tags": {"building": "yes"}, "geometry": square[:3]},
        {"type": "relation", "id": 3, "tags": {"building": "yes"}, "members": [{"type": "way", "role": "outer", "geometry": square[:3]}, {"type": "way", "role": "outer", "geometry": square[2:]}]},
    ]}
    (tmp_path / "o.json").write_text(json.dumps(answer))
    got = {r.id: r for r in osm.classified(sources.overpass(spark, str(tmp_path / "o.json")).where("geometry is not null")).collect()}
    assert set(got) == {"way/1", "relation/3"} and got["way/1"].num_floors == 3 and got["way/1"]["class"] is None
    with gzip.open(tmp_path / "l.csv.gz", "wt") as f:
        f.write('21.0,105.8,30.5,0.9,"POLYGON((0 0,1 0,1 1,0 0))",7P28\n22.0,105.8,30.5,0.9,"POLYGON((0 0,1 0,1 1,0 0))",7P29\n')
    listed = sources.footprint_list(spark, str(tmp_path / "l.csv.gz"), (105, 20, 106, 21.5))
    assert [G.polygon_area(G.read_wkb(bytes(r.g))[0]) for r in listed.select(sources.wkt_to_wkb("geometry").alias("g")).collect()] == [0.5]
    assert sources.newest_release(["2026-01-02.9", "2026-01-02.10/", "x"]) == "2026-01-02.10"
    with zipfile.ZipFile(tmp_path / "b.xlsx", "w") as z:
        z.writestr("xl/workbook.xml", '<w xmlns="m"><sheets><sheet name="S"/></sheets></w>')
        z.writestr("xl/sharedStrings.xml", '<s xmlns="m"><si><t>hi</t></si></s>')
        z.writestr("xl/worksheets/sheet1.xml", '<w xmlns="m"><sheetData><row r="2"><c r="A2" t="s"><v>0</v></c><c r="C2"><v>5</v></c></row></sheetData></w>')
    assert sources.sheets(str(tmp_path / "b.xlsx")) == ["S"] and sources.sheet_rows(str(tmp_path / "b.xlsx")) == [(2, ["hi", "", "5"])]


def test_geopackage_round_trip(spark, tmp_path):
    rows = [(k, f"n{k}", float(k), G.write_wkb([box(k, 0, k + 1, 1)])) for k in range(25)]
    df = spark.createDataFrame(rows, "id long, name string, h double, geometry binary")
    path = str(tmp_path / "x.gpkg")
    assert sinks.write_geopackage(df, path, "buildings") == 25
    sources.register(spark)
    back = spark.read.format("cadastra_gpkg").option("path", path).option("layer", "buildings").option("rows", 10).load()
    assert sorted((r.id, r.name, r.h, bytes(r.geometry)) for r in back.collect()) == rows


def test_sinks(spark, tmp_path):
    assert sinks.active(str(tmp_path)) is None
    sinks.activate(str(tmp_path), "v1")
    sinks.activate(str(tmp_path), "v2")
    assert sinks.active(str(tmp_path)) == "v2"
    df, seen = sinks.observed_count(spark, spark.range(50).withColumnRenamed("id", "k"), "n")
    df.write.parquet(str(tmp_path / "c"))
    sinks.write_sorted(spark.read.parquet(str(tmp_path / "c")), str(tmp_path / "s"), "k")
    assert seen.get["rows"] == 50 and spark.read.parquet(str(tmp_path / "s")).count() == 50
    feature = json.loads(sinks.grid_features(spark.createDataFrame([(1, 2, 7)], "gx long, gy long, n int"), 0.5).first().feature)
    assert feature["properties"] == {"n": 7} and feature["geometry"]["coordinates"][0][0] == [0.5, 1.0]
    assert "| a |" in sinks.markdown("t", [{"a": 1}])


def test_numbered_scan(spark, tmp_path):
    spark.range(1000).repartition(4).write.parquet(str(tmp_path / "p"))
    assert sources.parquet(spark, str(tmp_path / "p"), numbered=True).select("_pid").distinct().count() == 1000


def test_pins_and_parts(spark):
    canon = spark.createDataFrame([("a", "yes", None, {}, None, 5.0, "default", 20.0), ("b", "shed", None, {}, None, 5.0, "default", 10.0)], "id string, building string, name string, tags map<string,string>, levels int, height_m double, height_provenance string, area double")
    pins = spark.createDataFrame([("a", True)], "id string, nearest boolean")
    got = {r.id: (r.tier, r.rule, r.flags) for r in R.tiers(canon, pinned=pins).collect()}
    assert got == {"a": ("T1_iconic", 1, ["iconic_pin_nearest"]), "b": ("T3_residential", 0, ["minor_structure", "tiny_footprint_qc"])}
    up = R.part_tiers(spark.createDataFrame([("p", "a")], "id string, parent string"), R.tiers(canon, pinned=pins)).first()
    assert (up.tier, up.flags) == ("T1_iconic", [])


def test_hstore(spark):
    text = '"a"=>"1", "b" => "x, y", "c"=>NULL, "d" =>"q\\"uote", "a"=>"2", "e"=>"null"'
    row = spark.createDataFrame([(text,), ("",), (None,)], "t string").select(tags.hstore(F.col("t")).alias("m")).collect()
    assert [r.m for r in row] == [{"b": "x, y", "c": None, "d": 'q"uote', "a": "2", "e": "null"}, {}, None]


def test_blank_tags_set_no_tier(spark):
    rows = [(1, "yes", "A", {"wikidata": " ", "historic": "tomb"}), (2, "yes", "A", {"wikidata": "", "tourism": "museum"}), (3, " ", "A", {"wikidata": "Q1", "tourism": " Museum "})]
    df = spark.createDataFrame([(*r, None, 5.0, "default", 100.0) for r in rows], "id int, building string, name string, tags map<string,string>, levels double, height_m double, height_provenance string, area double")
    assert {r.id: r.rule for r in R.tiers(df).collect()} == {1: 2, 2: 0, 3: 2}


def test_colours(spark):
    want = {
        "#fff": "#ffffff", "#0f08": "rgba(0, 255, 0, 0.533)", "#12AB34": "#12ab34", "#11223380": "rgba(17, 34, 51, 0.502)", "rgb(255, 0, 10)": "#ff000a",
        "rgba(100%, 0%, 50%, .5)": "rgba(255, 0, 128, 0.5)", "hsl(0, 100%, 50%)": "#ff0000", "hsl(120deg 100% 25%)": "#008000", "hsla(240,100%,50%,1)": "#0000ff", "HSL(60, 100%, 50%)": "#ffff00",
        "hsl(-30, 50%, 50%)": "#bf4080", "rgb(300,-5,0)": "#ff0000", "#12345": None, "red": None, "": None, "rgb(1,2)": None, "rgb(a,b,c)": None, None: None,
    }
    df = spark.createDataFrame([(k,) for k in want], "t string")
    assert {r.t: r.c for r in df.select("t", formats.colour_text(formats.colour(F.col("t"))).alias("c")).collect()} == want


def test_hexagon_cells(spark):
    cells = {"8828308281fffff": 8, "8001fffffffffff": 0, "8f2830828052d25": 15, "85283473fffffff": 5, "8828308281ffff7": None, "882830828": None, "ffffffffffffffff": None, "88283082810ffff": None, "81083ffffffffff": 1, "81087ffffffffff": None}
    df = spark.createDataFrame([(k,) for k in cells], "c string")
    assert {r.c: r.r for r in df.select("c", formats.hex_cell_resolution(F.col("c")).alias("r")).collect()} == cells
    pasted = "[\"8828308281fffff\", '85283473fffffff'; nonsense 8828308281FFFFF]"
    got = spark.createDataFrame([(pasted,)], "t string").select(formats.cells_listed(F.col("t")).alias("l")).first().l
    assert (got.cells, got.bad) == (["8828308281fffff", "85283473fffffff"], ["nonsense"])


def test_labels_and_places(spark):
    row = spark.range(1).select(
        formats.column_letter(F.lit(0)).alias("a"), formats.column_letter(F.lit(25)).alias("z"), formats.column_letter(F.lit(26)).alias("aa"), formats.column_letter(F.lit(701)).alias("zz"), formats.column_letter(F.lit(702)).alias("aaa"),
        formats.safe_name(F.lit("../a b/c?.gpkg")).alias("file"), formats.safe_name(F.lit("??")).alias("none"),
        landmarks.checked_placement(F.lit(-30.0), F.lit(1.0), F.lit(105.8), F.lit(21.0)).alias("good"), landmarks.checked_placement(F.lit(1.0), F.lit(0.0), F.lit(1.0), F.lit(1.0)).alias("bad"),
    ).first()
    assert tuple(row)[:7] == ("A", "Z", "AA", "ZZ", "AAA", "a_b_c_.gpkg", "file") and row.good.heading == 330 and row.bad is None


def test_convert_columns():
    fields = ["id", "parent_id", "h", "h_src", "height_m", "name"]
    spec = convert.ConvertSpec(rule=convert.HeightRule(), height="h")
    assert convert.passed_through(fields, spec) == ["id", "parent_id", "h", "name"]
    assert convert.passed_through(fields, convert.ConvertSpec()) == ["id", "parent_id", "h", "name"]
    assert convert.passed_through(fields, convert.ConvertSpec(columns=("h_src", "name"))) == ["h_src", "name"]
    assert convert.passed_through(fields, convert.ConvertSpec(columns=("name", "h_src"), rule=convert.HeightRule(), parts=("id", "parent_id"))) == ["name", "id", "parent_id"]
    for bad in (convert.ConvertSpec(columns=("nope",)), convert.ConvertSpec(parts=("id", "nope")), convert.ConvertSpec(categories=("nope",))):
        with pytest.raises(ValueError):
            convert.passed_through(fields, bad)
    assert convert.without_reserved(["id", "__area", "_bid"], {"id": "id", "parent": None}, ("_bid",)) == ["id"]
    with pytest.raises(ValueError):
        convert.without_reserved(["id", "__area"], {"height": "__area"})


def test_modes_and_ignored_columns():
    assert D.match_mode("id", "id") == "key" and D.match_mode("id", "key") == D.match_mode(None, None) == "location" and D.match_mode("id", None, "key") == "key"
    assert D.ignored_columns("key", ["name", "build_id"]) == ("build_id",) and D.ignored_columns("location", ["name"]) == ("name",) and D.ignored_columns("key", ["build_id"], ()) == ()


def test_ellipsoid_and_buffers():
    half = [np.array([[0, 0], [90, 0], [90, 90], [0, 90]], float)]
    assert G.spheroid_area(half) == pytest.approx(510065621724089 / 8, rel=1e-9)
    small = [np.array([[105, 21], [105.01, 21], [105.01, 21.01], [105, 21.01]], float)]
    a, e2, lat = 6378137.0, 0.00669437999014, math.radians(21.005)
    w = 1 - e2 * math.sin(lat) ** 2
    assert G.spheroid_area(small) == pytest.approx(a * a * (1 - e2) * math.cos(lat) / w**2 * math.radians(0.01) ** 2, rel=1e-6)
    assert abs(G.ring_area(G.capsule((0, 0), (30, 40), 5, 256))) == pytest.approx(50 * 10 + math.pi * 25, rel=1e-4)
    bend = G.buffered_line([(0, 0), (20, 0), (20, 20)], 2, 64)
    # two strips without the square in which they meet, two ends and a quarter of a disc at the bend
    assert G.union([bend[0]], [bend[1]])[0] == pytest.approx(160 - 4 + 4 * math.pi + math.pi, rel=1e-3)


def test_legacy_heights(spark):
    df = spark.createDataFrame([(1, 5.0, "default", 1), (2, 6.0, "survey", 0), (3, None, None, None)], "bid int, h_m double, prov string, h_outlier int")
    rule = convert.HeightRule(placeholders=("default",))
    assert [tuple(r) for r in D.loaded(df, rule, None, None, "prov").select("h", "real", "outlier").orderBy("bid").collect()] == [(5.0, False, True), (6.0, True, False), (None, True, False)]
    assert [r.real for r in D.loaded(df.drop("prov", "h_outlier")).collect()] == [None] * 3


def test_versions_and_sources(spark, tmp_path):
    assert R.rule("v1") is R.tiers and C.config("v1") == C.Params()
    for ask in (R.rule, C.config):
        with pytest.raises(ValueError):
            ask("v0")
    df = spark.createDataFrame([(1, "a", True), (2, None, None), (3, "b", None)], "ID int, category string, gone boolean")
    assert [tuple(r) for r in sources.resolved(df, {"id": ("fid", "id"), "x": ("nope",)}).collect()] == [(1, None), (2, None), (3, None)]
    assert [r.ID for r in sources.places(df, ("ID", "category"), "gone").collect()] == [3]
    for bad in (lambda: sources.places(df), lambda: sources.resolved(df, {"x": ("nope",)}, ("x",))):
        with pytest.raises(ValueError):
            bad()


def test_table_is_replaced_whole(spark, tmp_path):
    path = f"file://{tmp_path}/registry"
    for n in (3, 5):
        sinks.replace_table(spark.range(n), path)
        assert spark.read.parquet(path).count() == n
    broken = spark.range(4).select(F.raise_error(F.lit("no")).cast("long").alias("id"))
    with pytest.raises(Exception):
        sinks.replace_table(broken, path)
    assert spark.read.parquet(path).count() == 5
    assert [p.name for p in tmp_path.iterdir() if ".old" in p.name] == []
