"""Sources, probes, schema comparison and the Overture form, on tables shaped from the driver's."""

from __future__ import annotations

from pyspark.sql import functions as F

from cadastra import sources
from cadastra.operators.sinks import grid_features
from cadastra.plans import probe, schema
from cadastra.plans.osm import osm_source, overture_buildings
from cadastra.plans.tables import table

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(function):
        QUERIES[name] = function
        if sql:
            ORACLES[name] = sql
        return function

    return add


@query("a02_numbered_scan", "SELECT count(*) AS rows, count(*) AS pids FROM orders")
def numbered_scan(spark, sf_dir):
    """A key of file and row for each record."""
    df = sources.parquet(spark, f"{sf_dir.rstrip('/')}/orders.parquet", numbered=True)
    return df.agg(F.count(F.lit(1)).alias("rows"), F.count_distinct("_pid").alias("pids"))


@query("c04_struct_bbox", "SELECT o_orderkey FROM orders WHERE o_orderkey % 360 <= 120.5 AND o_orderkey % 360 + 1 >= 100 AND o_custkey % 90 <= 30 AND o_custkey % 90 + 1 >= 20")
def struct_bbox(spark, sf_dir):
    """Overlap with a struct of bounds."""
    x, y = F.col("o_orderkey") % 360, F.col("o_custkey") % 90
    df = table(spark, sf_dir, "orders").select("o_orderkey", F.struct(x.alias("xmin"), (x + 1).alias("xmax"), y.alias("ymin"), (y + 1).alias("ymax")).alias("bbox"))
    return sources.in_bbox(df, 100, 20, 120.5, 30).select("o_orderkey")


@query("a09_geometry_kinds", "SELECT 'POLYGON' AS kind, least(count(*), 1000) AS n FROM customer")
def geometry_kinds(spark, sf_dir):
    wkb = F.unhex(F.lit("010300000001000000040000000000000000000000000000000000000000000000000000000000000000000000000000000000000000000000000000000000000000000000000000000000000000"))
    return probe.geometry_kinds(table(spark, sf_dir, "customer").select(wkb.alias("g")), "g")


@query("a20_newest_covering", "SELECT r_name AS name FROM region WHERE r_regionkey * 2 <= 5 AND r_regionkey * 2 + 9 >= 8 ORDER BY r_regionkey DESC LIMIT 1")
def newest_covering(spark, sf_dir):
    """The newest snapshot whose bounds cover a box."""
    k = F.col("r_regionkey")
    snaps = table(spark, sf_dir, "region").select(F.col("r_name").alias("name"), k.alias("created"), (k * 2).alias("west"), F.lit(0).alias("south"), (k * 2 + 9).alias("east"), F.lit(9).alias("north"))
    return sources.newest_covering(snaps, 5, 1, 8, 8).select("name")


@query("j09_inferred_types", "SELECT * FROM (VALUES ('a', 'integer', (SELECT count(*) FROM part)), ('b', 'number', (SELECT count(*) FROM part)), ('c', 'text', (SELECT count(*) FROM part)), ('d', 'text', (SELECT count(*) FROM part))) v(\"column\", type, filled)")
def inferred_types(spark, sf_dir):
    """Column types of text cells."""
    t = table(spark, sf_dir, "part").selectExpr("cast(p_size as string) a", "concat(p_size, ',5') b", "concat('0', p_size) c", "p_name d")
    return probe.inferred_types(t, ("a", "b", "c", "d"))


@query("j31_roles", "SELECT * FROM (VALUES ('id', 'building_id'), ('height', 'h'), ('levels', 'levels'), ('provenance', 'h_src')) v(role, \"column\")")
def roles(spark, sf_dir):
    t = table(spark, sf_dir, "part").selectExpr("p_partkey building_id", "p_retailprice h", "p_size levels", "p_brand h_src", "p_name name")
    return spark.createDataFrame(sorted(probe.suggest_roles(t.schema).items()), "role string, `column` string")


@query(
    "k30_schema_diff",
    """SELECT * FROM (VALUES ('schema_added', 'info', 'extra', NULL, 'string'), ('schema_missing', 'fail', 'o_orderstatus', 'string', NULL), ('schema_missing_optional', 'warn', 'o_orderpriority', 'string', NULL),
    ('schema_type_info', 'info', 'o_custkey', 'bigint', 'double'), ('schema_type_warn', 'warn', 'o_totalprice', 'double', 'int'), ('schema_type_fail', 'fail', 'o_orderdate', 'timestamp', 'string')) v(code, level, field, type_a, type_b)""",
)
def schema_diff(spark, sf_dir):
    a = table(spark, sf_dir, "orders")
    b = a.selectExpr("o_orderkey", "cast(o_custkey as double) o_custkey", "cast(o_totalprice as int) o_totalprice", "cast(o_orderdate as string) o_orderdate", "'x' extra")
    kind = a.schema["o_orderdate"].dataType.simpleString()
    rows = [tuple("timestamp" if v == kind else v for v in r) for r in schema.schema_diff(a.schema, b.schema, required=("o_orderstatus",))]
    return spark.createDataFrame(rows, "code string, level string, field string, type_a string, type_b string")


SOURCES = "array(named_struct('dataset', if(o_orderkey % 3 = 0, 'Other', 'OpenStreetMap'), 'record_id', concat(if(o_orderkey % 2 = 0, 'w', 'r'), o_orderkey, '@', o_custkey % 5)), named_struct('dataset', if(o_orderkey % 6 = 0, 'OpenStreetMap', 'X'), 'record_id', concat('n', o_orderkey)))"


@query("c10_first_matching_element", "SELECT o_orderkey, CASE WHEN o_orderkey % 3 <> 0 THEN CASE WHEN o_orderkey % 2 = 0 THEN 'w' ELSE 'r' END || o_orderkey || '@' || o_custkey % 5 WHEN o_orderkey % 6 = 0 THEN 'n' || o_orderkey END AS record FROM orders")
def first_matching_element(spark, sf_dir):
    df = table(spark, sf_dir, "orders").withColumn("sources", F.expr(SOURCES))
    return df.select("o_orderkey", osm_source()["record_id"].alias("record"))


@query(
    "k09_overture_buildings",
    """WITH b AS (SELECT o_orderkey AS id, CASE WHEN o_orderkey % 2 = 0 THEN 'way/' ELSE 'relation/' END || o_orderkey AS building_id, o_custkey % 5 AS v FROM orders WHERE o_orderkey % 3 <> 0 AND o_orderkey % 7 <> 0 AND o_orderkey % 4 <> 1),
    p AS (SELECT CASE WHEN o_orderkey % 2 = 0 THEN 'way/' ELSE 'relation/' END || (o_orderkey) AS building_id, o_orderkey - 1 AS up FROM orders WHERE o_orderkey % 3 <> 0 AND o_orderkey % 4 = 1)
    SELECT building_id, NULL AS parent_building_id FROM b UNION ALL SELECT p.building_id, b.building_id FROM p JOIN b ON p.up = b.id""",
)
def overture(spark, sf_dir):
    """Buildings and parts under their OSM ids."""
    o = table(spark, sf_dir, "orders").where("o_orderkey % 3 <> 0").withColumn("sources", F.expr(SOURCES))
    shape = ["sources", "struct(cast(o_orderkey as string) as primary) names", "o_totalprice height", "1 num_floors", "0.0 min_height", "cast(null as binary) geometry"]
    b = o.where("o_orderkey % 4 <> 1").selectExpr("o_orderkey id", "'house' class", "o_orderkey % 7 = 0 is_underground", *shape)
    p = o.where("o_orderkey % 4 = 1").selectExpr("o_orderkey - 1 building_id", "cast(null as boolean) is_underground", *shape)
    return overture_buildings(b, p).select("building_id", "parent_building_id")


@query("b06_grid_features", "SELECT count(*) AS n FROM (SELECT DISTINCT c_nationkey, c_custkey % 4 FROM customer)")
def grid(spark, sf_dir):
    """One GeoJSON feature per cell."""
    cells = table(spark, sf_dir, "customer").groupBy(F.col("c_nationkey").cast("long").alias("gx"), (F.col("c_custkey") % 4).alias("gy")).agg(F.count(F.lit(1)).alias("n"))
    return grid_features(cells, 0.05).where(F.get_json_object("feature", "$.type") == "Feature").agg(F.count(F.lit(1)).alias("n"))
