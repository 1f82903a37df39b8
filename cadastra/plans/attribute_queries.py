"""Attribute operators over the driver's tables: heights, tags, identifiers, aggregates, windows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from cadastra.functions import heights as H
from cadastra.functions import tags as T
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


# ---- heights -------------------------------------------------------------------------------------

PLACEHOLDER = ("N",)


def measured(spark: SparkSession, sf_dir: str) -> DataFrame:
    """lineitem as buildings: a height, levels, and a provenance of which N is a placeholder."""
    line = F.col("l_linenumber")
    return table(spark, sf_dir, "lineitem").select(
        "l_orderkey",
        "l_linenumber",
        "l_returnflag",
        (F.col("l_extendedprice") / 1000).alias("height"),
        F.when(line <= 4, line * 3.0).when(line == 5, F.lit(900.0)).alias("levels"),
    )


def with_height(df: DataFrame, mode: str = "fallback") -> DataFrame:
    rule = H.HeightRule(mode=mode, placeholders=PLACEHOLDER)
    return df.withColumns(H.height_columns(rule, F.col("height"), F.col("levels"), F.col("l_returnflag")))


MEASURED_SQL = """i AS (
  SELECT l_orderkey, l_linenumber, l_returnflag,
         CASE WHEN l_returnflag = 'N' THEN NULL ELSE l_extendedprice / 1000 END AS hv,
         CASE WHEN l_linenumber <= 4 THEN l_linenumber * 3.0::DOUBLE WHEN l_linenumber = 5 THEN 900.0 END AS lv
  FROM lineitem
)"""


def height_sql(mode: str) -> str:
    use_h = "hv IS NOT NULL" if mode == "keep" else "hv BETWEEN 2 AND 500"
    use_l = "lv IS NOT NULL" if mode == "keep" else "lv BETWEEN 1 AND 200"
    clamp_m = "WHEN hv > 500 THEN 500.0" if mode == "clamp" else ""
    clamp_s = "WHEN hv > 500 THEN 'clamped'" if mode == "clamp" else ""
    return f"""{MEASURED_SQL}, r AS (
  SELECT l_orderkey, l_linenumber, l_returnflag, hv,
         CASE WHEN {use_h} THEN floor(hv * 10 + 0.5) / 10 {clamp_m} WHEN {use_l} THEN floor(lv * 3.5 * 10 + 0.5) / 10 ELSE 3.5 END AS height_m,
         CASE WHEN {use_h} THEN 'height' {clamp_s} WHEN {use_l} THEN 'levels' ELSE 'default' END AS h_src,
         CASE WHEN (hv IS NOT NULL AND NOT hv BETWEEN 2 AND 500) OR (lv IS NOT NULL AND NOT lv BETWEEN 1 AND 200) THEN 1 ELSE 0 END AS h_outlier
  FROM i
)"""


def _rule_query(mode: str):
    def run(spark, sf_dir):
        return with_height(measured(spark, sf_dir), mode).select("l_orderkey", "l_linenumber", "height_m", "h_src", "h_outlier")

    return run


for _mode in ("fallback", "clamp", "keep"):
    query(f"k01_height_rule_{_mode}", f"WITH {height_sql(_mode)} SELECT l_orderkey, l_linenumber, height_m, h_src, h_outlier FROM r")(_rule_query(_mode))


@query("height_report_by_source", f"WITH {height_sql('fallback')} SELECT h_src, h_outlier, count(*) AS n, min(height_m) AS low, max(height_m) AS high FROM r GROUP BY h_src, h_outlier")
def height_report_by_source(spark, sf_dir):
    """Counts and range of heights by source."""
    return with_height(measured(spark, sf_dir)).groupBy("h_src", "h_outlier").agg(F.count(F.lit(1)).alias("n"), F.min("height_m").alias("low"), F.max("height_m").alias("high"))


@query(
    "k05_height_stats",
    f"""WITH {height_sql('fallback')} SELECT count(*) AS n, count(hv) AS with_height, count(*) FILTER (WHERE h_src IN ('height', 'levels', 'clamped')) AS measured,
    sum(h_outlier)::BIGINT AS outliers, min(height_m) AS low, max(height_m) AS high, floor(avg(height_m) * 1000 + 0.5) / 1000 AS mean,
    quantile_disc(height_m, 0.5) AS p50, quantile_disc(height_m, 0.95) AS p95 FROM r""",
)
def height_stats(spark, sf_dir):
    """One pass, nearest-rank quantiles."""
    df = with_height(measured(spark, sf_dir))
    hv = F.when(~F.col("l_returnflag").isin(*PLACEHOLDER), F.col("height"))
    return df.agg(
        F.count(F.lit(1)).alias("n"),
        F.count(hv).alias("with_height"),
        F.count_if(F.col("h_src").isin(*H.REAL_SOURCES)).alias("measured"),
        F.sum("h_outlier").alias("outliers"),
        F.min("height_m").alias("low"),
        F.max("height_m").alias("high"),
        H.half_up(F.avg("height_m"), 3).alias("mean"),
        F.expr("percentile_disc(0.5) WITHIN GROUP (ORDER BY height_m)").alias("p50"),
        F.expr("percentile_disc(0.95) WITHIN GROUP (ORDER BY height_m)").alias("p95"),
    )


@query(
    "e08_height_histogram",
    f"""WITH {height_sql('fallback')}, e(bin, edge) AS (VALUES (0,0),(1,3),(2,6),(3,10),(4,15),(5,25),(6,40),(7,60),(8,100),(9,200)),
    c AS (SELECT (SELECT coalesce(max(bin), 0) FROM e WHERE edge <= height_m) AS bin, count(*) AS n FROM r GROUP BY 1)
    SELECT e.bin, e.edge, coalesce(c.n, 0) AS n FROM e LEFT JOIN c ON e.bin = c.bin""",
)
def height_histogram(spark, sf_dir):
    """Fixed edges, open last bin, empty bins included."""
    counts = with_height(measured(spark, sf_dir)).groupBy(H.fixed_bin(F.col("height_m")).alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    edges = spark.createDataFrame(list(enumerate(H.HEIGHT_BIN_EDGES)), "bin int, edge int")
    return edges.join(counts, "bin", "left").select("bin", "edge", F.coalesce("n", F.lit(0)).alias("n"))


@query(
    "g05_outlier_list",
    f"WITH {height_sql('fallback')} SELECT l_orderkey, l_linenumber, hv, height_m FROM r WHERE h_outlier = 1 ORDER BY hv DESC NULLS LAST, l_orderkey, l_linenumber LIMIT 100",
)
def outlier_list(spark, sf_dir):
    df = with_height(measured(spark, sf_dir)).where("h_outlier = 1")
    hv = F.when(~F.col("l_returnflag").isin(*PLACEHOLDER), F.col("height"))
    return df.select("l_orderkey", "l_linenumber", hv.alias("hv"), "height_m").orderBy(F.col("hv").desc_nulls_last(), "l_orderkey", "l_linenumber").limit(100)


@query("g05_tallest", f"WITH {height_sql('keep')} SELECT l_orderkey, l_linenumber, height_m FROM r ORDER BY height_m DESC, l_orderkey, l_linenumber LIMIT 20")
def tallest(spark, sf_dir):
    return with_height(measured(spark, sf_dir), "keep").select("l_orderkey", "l_linenumber", "height_m").orderBy(F.col("height_m").desc(), "l_orderkey", "l_linenumber").limit(20)


@query(
    "e16_height_by_category",
    """WITH i AS (SELECT p_type, p_size::DOUBLE AS h FROM part), t AS (SELECT p_type, count(*) AS n, max(h) AS high, floor(avg(h) * 1000 + 0.5) / 1000 AS mean FROM i GROUP BY p_type)
    SELECT * FROM t ORDER BY n DESC, p_type LIMIT 25""",
)
def height_by_category(spark, sf_dir):
    """The most frequent categories with their heights."""
    h = F.col("p_size").cast("double")
    t = table(spark, sf_dir, "part").groupBy("p_type").agg(F.count(F.lit(1)).alias("n"), F.max(h).alias("high"), H.half_up(F.avg(h), 3).alias("mean"))
    return t.orderBy(F.col("n").desc(), "p_type").limit(25)


@query("k04_height_lineage", f"WITH {height_sql('clamp')} SELECT CASE h_src WHEN 'height' THEN 'tag:height' WHEN 'levels' THEN 'tag:levels' WHEN 'clamped' THEN 'tag:height:clamped' ELSE 'default' END AS lineage, count(*) AS n FROM r GROUP BY 1")
def height_lineage(spark, sf_dir):
    return with_height(measured(spark, sf_dir), "clamp").groupBy(H.lineage(F.col("h_src")).alias("lineage")).agg(F.count(F.lit(1)).alias("n"))


@query(
    "k02_raw_height_kept",
    "SELECT l_orderkey, l_linenumber, l_extendedprice / 1000 AS h_raw, CASE WHEN l_extendedprice / 1000 BETWEEN 2 AND 500 THEN floor(l_extendedprice / 1000 * 10 + 0.5) / 10 ELSE 3.5 END AS height_m FROM lineitem",
)
def raw_height_kept(spark, sf_dir):
    """The input's own height_m survives as h_raw."""
    df = measured(spark, sf_dir).select("l_orderkey", "l_linenumber", F.col("height").alias("height_m"))
    made = H.height_columns(H.HeightRule(), F.col("h_raw"), F.lit(None).cast("double"))
    return df.withColumnRenamed("height_m", "h_raw").withColumn("height_m", made["height_m"])


@query(
    "k03_part_flags",
    """WITH p AS (SELECT o_orderkey AS id, CASE WHEN o_orderkey % 5 = 0 THEN o_custkey WHEN o_orderkey % 7 = 0 THEN o_orderkey END AS parent FROM orders)
    SELECT id, CASE WHEN EXISTS (SELECT 1 FROM p q WHERE q.parent = p.id AND q.id <> p.id) THEN 1 ELSE 0 END AS has_parts,
           CASE WHEN parent IS NOT NULL AND parent <> id THEN 1 ELSE 0 END AS is_part FROM p""",
)
def part_flags(spark, sf_dir):
    """Does another row point here, does this row point to another."""
    k = F.col("o_orderkey")
    p = table(spark, sf_dir, "orders").select(k.alias("id"), F.when(k % 5 == 0, F.col("o_custkey")).when(k % 7 == 0, k).alias("parent"))
    owners = p.where("parent is not null and parent <> id").select(F.col("parent").alias("id")).distinct().withColumn("has_parts", F.lit(1))
    is_part = F.when(F.col("parent").isNotNull() & (F.col("parent") != F.col("id")), 1).otherwise(0)
    return p.join(owners, "id", "left").select("id", F.coalesce("has_parts", F.lit(0)).alias("has_parts"), is_part.alias("is_part"))


# ---- text, identifiers, tags ---------------------------------------------------------------------

TEXT_HEIGHT = "CASE p_partkey % 6 WHEN 0 THEN p_size || ' m' WHEN 1 THEN p_size || ',5' WHEN 2 THEN ' ' || p_size || '.25m' WHEN 3 THEN p_name WHEN 4 THEN '.5' ELSE NULL END"


@query(
    "j06_leading_number",
    f"SELECT p_partkey, try_cast(nullif(regexp_extract(replace(trim({TEXT_HEIGHT}), ',', '.'), '^[0-9]*[.]?[0-9]+'), '') AS DOUBLE) AS height FROM part",
)
def leading_number(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", H.leading_number(F.expr(TEXT_HEIGHT)).alias("height"))


LENGTH = "CASE p_partkey % 8 WHEN 0 THEN p_size || ' m' WHEN 1 THEN p_size || ',5' WHEN 2 THEN p_size || ' ft' WHEN 3 THEN p_size || chr(39) || '6\"' WHEN 4 THEN p_size || '-12' WHEN 5 THEN '0' WHEN 6 THEN p_size || ' METRES ' ELSE p_name END"


@query(
    "j07_length",
    rf"""WITH p AS (SELECT p_partkey, trim({LENGTH}) AS t FROM part), m AS (SELECT p_partkey,
    CASE WHEN regexp_matches(t, '(?i)^(\d+(?:[.,]\d+)?)\s*(?:m|meters?|metres?)?$') THEN replace(regexp_extract(t, '^(\d+(?:[.,]\d+)?)', 1), ',', '.')::DOUBLE
         WHEN regexp_matches(t, '(?i)^(\d+(?:[.,]\d+)?)\s*(?:ft|feet|foot|'')$') THEN replace(regexp_extract(t, '^(\d+(?:[.,]\d+)?)', 1), ',', '.')::DOUBLE * 0.3048
         WHEN regexp_matches(t, '(?i)^(\d+)\s*''\s*(\d+(?:[.,]\d+)?)\s*(?:"|in|inch|inches)?$')
              THEN (regexp_extract(t, '^(\d+)', 1)::DOUBLE * 12 + replace(regexp_extract(t, '^\d+\s*''\s*(\d+(?:[.,]\d+)?)', 1), ',', '.')::DOUBLE) * 0.3048 / 12 END AS v FROM p)
    SELECT p_partkey, CASE WHEN v > 0 AND v <= 1000 THEN floor(v * 1000 + 0.5) / 1000 END AS metres FROM m""",
)
def length(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", T.length_m(F.expr(LENGTH.replace("'6\"'", "'6\"'"))).alias("metres"))


LEVELS = "CASE p_partkey % 6 WHEN 0 THEN '' || p_size WHEN 1 THEN p_size || ';' || (p_size + 3) WHEN 2 THEN p_size || ',5' WHEN 3 THEN p_size || ';x' WHEN 4 THEN '400' ELSE ' ' || p_size || ' ; 2' END"


@query(
    "j08_levels",
    f"""WITH p AS (SELECT p_partkey, list_transform(string_split({LEVELS}, ';'), lambda x: try_cast(replace(trim(x), ',', '.') AS DOUBLE)) AS l FROM part)
    SELECT p_partkey, CASE WHEN len(list_filter(l, lambda x: x IS NULL)) = 0 AND list_max(l) BETWEEN 1 AND 250 THEN list_max(l) END AS levels FROM p""",
)
def levels(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", T.levels(F.expr(LEVELS), 1).alias("levels"))


@query(
    "j02_key_text",
    """SELECT o_orderkey, o_orderkey::VARCHAR AS from_int, CASE WHEN x = floor(x) THEN x::BIGINT::VARCHAR END AS from_double, nullif(trim(t), '') AS from_text
    FROM (SELECT o_orderkey, o_orderkey::DOUBLE AS x, CASE o_orderkey % 3 WHEN 0 THEN '  ' || o_orderkey || ' ' WHEN 1 THEN '   ' ELSE NULL END AS t FROM orders)""",
)
def key_text(spark, sf_dir):
    k = F.col("o_orderkey")
    t = F.when(k % 3 == 0, F.concat(F.lit("  "), k.cast("string"), F.lit(" "))).when(k % 3 == 1, "   ")
    return table(spark, sf_dir, "orders").select("o_orderkey", T.key_text(k, "bigint").alias("from_int"), T.key_text(k.cast("double"), "double").alias("from_double"), T.key_text(t, "string").alias("from_text"))


RECORD = "CASE o_orderkey % 4 WHEN 0 THEN 'w' WHEN 1 THEN 'r' WHEN 2 THEN 'n' ELSE '' END || o_orderkey || '@' || o_custkey % 9"


@query(
    "j05_osm_record_id",
    f"""SELECT o_orderkey, CASE WHEN regexp_extract(r, '^[a-z]([0-9]+)', 1) <> '' THEN CASE r[1] WHEN 'w' THEN 'way/' WHEN 'r' THEN 'relation/' WHEN 'n' THEN 'node/' END || regexp_extract(r, '^[a-z]([0-9]+)', 1) END AS id,
    try_cast(regexp_extract(r, '@([0-9]+)$', 1) AS INTEGER) AS version FROM (SELECT o_orderkey, {RECORD} AS r FROM orders)""",
)
def osm_record_id(spark, sf_dir):
    r = F.expr(RECORD)
    return table(spark, sf_dir, "orders").select("o_orderkey", T.osm_record_id(r).alias("id"), T.record_version(r).alias("version"))


SOURCE_ID = "CASE o_orderkey % 4 WHEN 0 THEN 'way/' || o_orderkey WHEN 1 THEN '7P28QPG4+4P7' WHEN 2 THEN substr(md5(o_orderkey::VARCHAR), 1, 8) || '-0000-8000-8000-' || substr(md5(o_orderkey::VARCHAR), 1, 12) ELSE 'x' || o_orderkey END"


@query(
    "j11_source_id_kind",
    f"""SELECT o_orderkey, CASE WHEN regexp_matches(s, '^(way|relation|node)/[0-9]+$') THEN 'osm' WHEN regexp_matches(s, '^[23456789CFGHJMPQRVWX]{{8}}[+][23456789CFGHJMPQRVWX]{{2,}}$') THEN 'plus_code'
    WHEN regexp_matches(s, '^[0-9a-f]{{8}}-[0-9a-f]{{4}}-[0-9a-f]{{4}}-[0-9a-f]{{4}}-[0-9a-f]{{12}}$') THEN 'uuid' ELSE 'other' END AS kind FROM (SELECT o_orderkey, {SOURCE_ID} AS s FROM orders)""",
)
def source_id_kind(spark, sf_dir):
    s = F.expr(SOURCE_ID.replace("o_orderkey::VARCHAR", "cast(cast(o_orderkey as string) as binary)"))
    return table(spark, sf_dir, "orders").select("o_orderkey", T.source_id_kind(s).alias("kind"))


@query(
    "n01_name_uuid",
    "WITH h AS (SELECT c_custkey, md5('cadastra:' || c_name) AS h FROM customer) SELECT c_custkey, substr(h,1,8) || '-' || substr(h,9,4) || '-8' || substr(h,14,3) || '-8' || substr(h,18,3) || '-' || substr(h,21,12) AS uuid FROM h",
)
def name_uuid(spark, sf_dir):
    """Deterministic ids from names."""
    return table(spark, sf_dir, "customer").select("c_custkey", T.name_uuid(F.col("c_name"), "cadastra:").alias("uuid"))


ORIGIN = "CASE c_custkey % 6 WHEN 0 THEN 'OpenStreetMap' WHEN 1 THEN 'google v3' WHEN 2 THEN 'MS' WHEN 3 THEN 'Bing maps' WHEN 4 THEN NULL ELSE c_name END"


@query(
    "k12_lineage_family",
    f"""SELECT c_custkey, CASE WHEN regexp_matches(o, 'osm|openstreetmap') THEN 'gba_osm' WHEN regexp_matches(o, 'google|gob') THEN 'gba_google'
    WHEN o IN ('ms', 'msft', 'gba_ms') OR regexp_matches(o, 'microsoft|bing') THEN 'gba_ms' ELSE 'gba_other' END AS family FROM (SELECT c_custkey, lower(coalesce({ORIGIN}, '')) AS o FROM customer)""",
)
def lineage_family(spark, sf_dir):
    return table(spark, sf_dir, "customer").select("c_custkey", T.lineage_family(F.expr(ORIGIN)).alias("family"))


@query(
    "k07_osm_kind",
    """WITH t AS (SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN 'yes' WHEN 1 THEN 'house' WHEN 2 THEN 'no' END AS b, CASE o_custkey % 3 WHEN 0 THEN 'yes' WHEN 1 THEN 'none' END AS p,
      CASE WHEN o_orderkey % 11 = 0 THEN 'underground' END AS l, CASE o_custkey % 13 WHEN 0 THEN 'yes' WHEN 1 THEN 'no' END AS tu FROM orders)
    SELECT o_orderkey, CASE WHEN l = 'underground' OR coalesce(tu, 'no') NOT IN ('', 'no') THEN NULL WHEN coalesce(p, 'no') NOT IN ('no', 'none', 'false', '0') THEN 'part'
      WHEN coalesce(b, 'no') NOT IN ('no', 'none', 'false', '0') THEN 'building' END AS kind FROM t""",
)
def osm_kind(spark, sf_dir):
    """Part, building, or neither, from a tag map."""
    tags = F.expr(
        "map('building', case o_orderkey % 4 when 0 then 'yes' when 1 then 'house' when 2 then 'no' end, 'building:part', case o_custkey % 3 when 0 then 'yes' when 1 then 'none' end,"
        " 'location', case when o_orderkey % 11 = 0 then 'underground' end, 'tunnel', case o_custkey % 13 when 0 then 'yes' when 1 then 'no' end)"
    )
    return table(spark, sf_dir, "orders").select("o_orderkey", T.kind(tags).alias("kind"))


@query(
    "k06_building_attributes",
    f"""WITH t AS (SELECT p_partkey, p_name, p_size, {LEVELS} AS lv, CASE p_partkey % 3 WHEN 0 THEN 'yes' WHEN 1 THEN p_type ELSE 'house' END AS b FROM part),
    l AS (SELECT *, list_transform(string_split(lv, ';'), lambda x: try_cast(replace(trim(x), ',', '.') AS DOUBLE)) AS l FROM t)
    SELECT p_partkey, CASE WHEN p_partkey % 2 = 0 THEN p_name ELSE p_name || ' vi' END AS name, CASE WHEN lower(b) NOT IN ('yes', 'true', '1') THEN b END AS class,
      p_size::DOUBLE AS height, CASE WHEN len(list_filter(l, lambda x: x IS NULL)) = 0 AND list_max(l) BETWEEN 1 AND 250 THEN list_max(l) END AS num_floors,
      CASE WHEN p_size % 5 > 0 THEN floor(p_size % 5 * 3.5 * 1000 + 0.5) / 1000 END AS min_height FROM l""",
)
def building_attributes(spark, sf_dir):
    tags = F.expr(
        "map('name', case when p_partkey % 2 = 0 then p_name end, 'name:vi', p_name || ' vi', 'building', case p_partkey % 3 when 0 then 'yes' when 1 then p_type else 'house' end,"
        f" 'height', p_size || ' m', 'building:levels', {LEVELS}, 'building:min_level', cast(p_size % 5 as string))"
    )
    made = T.building_attributes(F.col("tags"))
    return table(spark, sf_dir, "part").withColumn("tags", tags).select("p_partkey", *[made[k].alias(k) for k in ("name", "class", "height", "num_floors", "min_height")])


@query(
    "k08_tag_issues",
    f"""WITH t AS (SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN 'tall' WHEN 1 THEN '12 m' END AS h, {LEVELS} AS lv FROM part),
    l AS (SELECT *, list_transform(string_split(lv, ';'), lambda x: try_cast(replace(trim(x), ',', '.') AS DOUBLE)) AS l FROM t)
    SELECT p_partkey, 'height' AS key, h AS value FROM l WHERE h = 'tall'
    UNION ALL SELECT p_partkey, 'building:levels', lv FROM l WHERE lv IS NOT NULL AND NOT coalesce(len(list_filter(l, lambda x: x IS NULL)) = 0 AND list_max(l) BETWEEN 1 AND 250, false)""",
)
def tag_issues(spark, sf_dir):
    tags = F.expr(f"map('height', case p_partkey % 3 when 0 then 'tall' when 1 then '12 m' end, 'building:levels', {LEVELS})")
    rows = table(spark, sf_dir, "part").withColumn("tags", tags)
    return rows.select("p_partkey", F.explode(T.tag_issues(F.col("tags"))).alias("i")).select("p_partkey", "i.key", "i.value")


@query("j10_hstore", """SELECT c_custkey, c_name AS name, c_mktsegment || '"x' AS segment FROM customer""")
def hstore(spark, sf_dir):
    text = F.expr(r"""concat('"name"=>"', c_name, '", "seg"=>"', c_mktsegment, '\\"x"')""")
    return table(spark, sf_dir, "customer").withColumn("m", T.hstore(text)).select("c_custkey", F.col("m")["name"].alias("name"), F.col("m")["seg"].alias("segment"))


@query("j27_json_value", "SELECT event_id, (props->>'$.k')::BIGINT AS k, try_cast(props->>'$.k' AS DOUBLE) AS d, props->>'$.missing' AS missing FROM events")
def json_value(spark, sf_dir):
    """Only the needed fields are parsed."""
    p = F.from_json("props", "k bigint, missing string")
    return table(spark, sf_dir, "events").select("event_id", p["k"].alias("k"), p["k"].cast("double").alias("d"), p["missing"].alias("missing"))


@query("e20_json_key_frequency", "SELECT key, count(*) AS n FROM (SELECT unnest(json_keys(props)) AS key FROM events) GROUP BY key")
def json_key_frequency(spark, sf_dir):
    return table(spark, sf_dir, "events").select(F.explode(F.json_object_keys("props")).alias("key")).groupBy("key").agg(F.count(F.lit(1)).alias("n"))


@query(
    "j22_try_casts",
    """SELECT p_partkey, try_cast(t AS DOUBLE) AS d, NOT coalesce(regexp_matches(t, '^[0-9]+$'), false) AS not_int, CASE WHEN b IN ('true', 't', 'yes', '1') THEN true WHEN b IN ('false', 'no') THEN false END AS b
    FROM (SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN p_size::VARCHAR WHEN 1 THEN 'abc' WHEN 2 THEN '12.5' END AS t, CASE p_partkey % 6 WHEN 0 THEN 'true' WHEN 1 THEN 'yes' WHEN 2 THEN 'no' WHEN 3 THEN 'on' WHEN 4 THEN '1' END AS b FROM part)""",
)
def try_casts(spark, sf_dir):
    t = F.expr("case p_partkey % 4 when 0 then cast(p_size as string) when 1 then 'abc' when 2 then '12.5' end")
    b = F.expr("case p_partkey % 6 when 0 then 'true' when 1 then 'yes' when 2 then 'no' when 3 then 'on' when 4 then '1' end")
    return table(spark, sf_dir, "part").select("p_partkey", t.try_cast("double").alias("d"), t.try_cast("bigint").isNull().alias("not_int"), b.try_cast("boolean").alias("b"))


@query(
    "j23_typed_difference",
    """SELECT o_orderkey, x IS DISTINCT FROM y AND coalesce(abs(x - y) > greatest(abs(x), abs(y), 1) * 1e-9, true) AS numeric, s IS DISTINCT FROM t AS text, o_orderdate IS DISTINCT FROM d AS temporal
    FROM (SELECT o_orderkey, o_orderdate, o_totalprice AS x, CASE o_orderkey % 4 WHEN 0 THEN o_totalprice * (1 + 1e-12) WHEN 1 THEN o_totalprice + 1 WHEN 2 THEN NULL ELSE o_totalprice END AS y,
      o_orderstatus AS s, CASE o_orderkey % 3 WHEN 0 THEN o_orderstatus WHEN 1 THEN NULL ELSE 'Z' END AS t, CASE o_orderkey % 2 WHEN 0 THEN o_orderdate END AS d FROM orders)""",
)
def typed_difference(spark, sf_dir):
    k, price = F.col("o_orderkey"), F.col("o_totalprice")
    y = F.when(k % 4 == 0, price * (1 + 1e-12)).when(k % 4 == 1, price + 1).when(k % 4 == 3, price)
    t = F.when(k % 3 == 0, F.col("o_orderstatus")).when(k % 3 == 2, "Z")
    d = F.when(k % 2 == 0, F.col("o_orderdate"))
    return table(spark, sf_dir, "orders").select(
        "o_orderkey", T.differs(price, y, "real").alias("numeric"), T.differs(F.col("o_orderstatus"), t, "text").alias("text"), T.differs(F.col("o_orderdate"), d, "temporal").alias("temporal")
    )


@query(
    "j24_array_functions",
    """SELECT p_partkey, list_filter([p_brand, NULL, p_type], lambda x: x IS NOT NULL)[1] AS first, list_contains([p_brand, p_type], p_brand) AS has, list_has_any([p_size, 1], [1, 2]) AS meets,
    array_to_string(list_prepend('a', list_append([p_brand], p_type)), '|') AS joined FROM part""",
)
def array_functions(spark, sf_dir):
    return table(spark, sf_dir, "part").select(
        "p_partkey",
        F.expr("get(array_compact(array(p_brand, null, p_type)), 0)").alias("first"),
        F.expr("array_contains(array(p_brand, p_type), p_brand)").alias("has"),
        F.expr("arrays_overlap(array(p_size, 1), array(1, 2))").alias("meets"),
        F.expr("array_join(array_prepend(array_append(array(p_brand), p_type), 'a'), '|')").alias("joined"),
    )


@query("j21_timestamps", "SELECT o_orderkey, strptime(strftime(o_orderdate, '%Y-%m-%d %H:%M:%S'), '%Y-%m-%d %H:%M:%S') AS parsed, o_orderdate > TIMESTAMP '1995-06-01' AS after FROM orders")
def timestamps(spark, sf_dir):
    text = F.date_format("o_orderdate", "yyyy-MM-dd HH:mm:ss")
    return table(spark, sf_dir, "orders").select("o_orderkey", F.to_timestamp(text, "yyyy-MM-dd HH:mm:ss").alias("parsed"), (F.col("o_orderdate") > F.lit("1995-06-01").cast("timestamp")).alias("after"))


# ---- aggregates, windows, sorts, sets ------------------------------------------------------------


@query("e01_null_profile", "SELECT count(*) AS n, count(CASE WHEN o_orderkey % 3 = 0 THEN o_custkey END) AS a, count(nullif(o_orderstatus, 'F')) AS b FROM orders")
def null_profile(spark, sf_dir):
    return table(spark, sf_dir, "orders").agg(F.count(F.lit(1)).alias("n"), F.count(F.when(F.col("o_orderkey") % 3 == 0, F.col("o_custkey"))).alias("a"), F.count(F.nullif("o_orderstatus", F.lit("F"))).alias("b"))


@query("e02_filtered_aggregates", "SELECT l_returnflag, count(*) FILTER (WHERE l_linestatus = 'O') AS open, floor(avg(l_quantity) FILTER (WHERE l_tax > 0.02) * 1000 + 0.5) / 1000 AS mean FROM lineitem GROUP BY l_returnflag")
def filtered_aggregates(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").groupBy("l_returnflag").agg(F.count_if(F.col("l_linestatus") == "O").alias("open"), H.half_up(F.avg(F.when(F.col("l_tax") > 0.02, F.col("l_quantity"))), 3).alias("mean"))


@query("e04_median", "SELECT c_mktsegment, median(c_acctbal) AS mid FROM customer GROUP BY c_mktsegment")
def median(spark, sf_dir):
    return table(spark, sf_dir, "customer").groupBy("c_mktsegment").agg(F.median("c_acctbal").alias("mid"))


@query("e05_quantiles", "SELECT c_mktsegment, quantile_cont(c_acctbal, 0.1) AS p10, quantile_cont(c_acctbal, 0.5) AS p50, quantile_cont(c_acctbal, 0.9) AS p90 FROM customer GROUP BY c_mktsegment")
def quantiles(spark, sf_dir):
    q = table(spark, sf_dir, "customer").groupBy("c_mktsegment").agg(F.percentile("c_acctbal", F.array(F.lit(0.1), F.lit(0.5), F.lit(0.9))).alias("q"))
    return q.select("c_mktsegment", *[F.col("q")[k].alias(n) for k, n in enumerate(("p10", "p50", "p90"))])


@query("e07_value_counts", "SELECT map_keys(h)::VARCHAR AS keys, map_values(h)::VARCHAR AS counts FROM (SELECT histogram(p_size) AS h FROM part)")
def value_counts(spark, sf_dir):
    """Value -> count as a map; shown as text."""
    counts = table(spark, sf_dir, "part").groupBy("p_size").agg(F.count(F.lit(1)).alias("n"))
    m = counts.agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("p_size", "n")))).alias("h"))
    text = lambda a: F.concat(F.lit("["), F.array_join(a.cast("array<string>"), ", "), F.lit("]"))
    return m.select(text(F.map_keys("h")).alias("keys"), text(F.map_values("h")).alias("counts"))


@query("e09_extreme_rows", "SELECT o_custkey, arg_min(o_orderkey, (o_totalprice, o_orderkey)) AS cheapest, arg_max(o_orderkey, (o_totalprice, o_orderkey)) AS dearest FROM orders GROUP BY o_custkey")
def extreme_rows(spark, sf_dir):
    by = F.struct("o_totalprice", "o_orderkey")
    return table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.min_by("o_orderkey", by).alias("cheapest"), F.max_by("o_orderkey", by).alias("dearest"))


@query("e10_any_value_bool_and", "SELECT o_custkey, max(CASE WHEN o_orderkey >= 0 THEN o_custkey % 7 END) AS some, bool_and(o_totalprice > 1000) AS all_large FROM orders GROUP BY o_custkey")
def any_value_bool_and(spark, sf_dir):
    """E10 / E11."""
    return table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.any_value(F.col("o_custkey") % 7, True).alias("some"), F.bool_and(F.col("o_totalprice") > 1000).alias("all_large"))


@query("e12_ordered_list", "SELECT o_custkey, array_to_string(list(o_orderkey::VARCHAR ORDER BY o_totalprice DESC, o_orderkey), ',') AS keys FROM orders GROUP BY o_custkey")
def ordered_list(spark, sf_dir):
    rows = F.array_sort(F.collect_list(F.struct((-F.col("o_totalprice")).alias("p"), F.col("o_orderkey").alias("k"))))
    return table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.array_join(F.transform(rows, lambda x: x["k"].cast("string")), ",").alias("keys"))


@query("e13_multiset_hash", "SELECT o_custkey, md5(string_agg(md5(o_orderkey::VARCHAR), ',' ORDER BY md5(o_orderkey::VARCHAR))) AS h FROM orders GROUP BY o_custkey")
def multiset_hash(spark, sf_dir):
    piece = F.md5(F.col("o_orderkey").cast("string").cast("binary"))
    return table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.md5(F.array_join(F.array_sort(F.collect_list(piece)), ",").cast("binary")).alias("h"))


@query("e15_distinct_counts", "SELECT count(DISTINCT o_custkey) AS customers, count(DISTINCT coalesce(nullif(o_orderstatus, 'F'), 'none')) AS states FROM orders")
def distinct_counts(spark, sf_dir):
    return table(spark, sf_dir, "orders").agg(F.count_distinct("o_custkey").alias("customers"), F.count_distinct(F.coalesce(F.nullif("o_orderstatus", F.lit("F")), F.lit("none"))).alias("states"))


@query("e17_duplicate_keys", "SELECT count(*) AS keys, sum(n)::BIGINT AS rows FROM (SELECT count(*) AS n FROM lineitem GROUP BY l_orderkey, l_partkey % 5 HAVING count(*) > 1)")
def duplicate_keys(spark, sf_dir):
    d = table(spark, sf_dir, "lineitem").groupBy("l_orderkey", F.col("l_partkey") % 5).agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    return d.agg(F.count(F.lit(1)).alias("keys"), F.sum("n").alias("rows"))


@query("f03_keep_one", "SELECT o_custkey, o_orderkey, o_totalprice FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS k FROM orders) WHERE k = 1")
def keep_one(spark, sf_dir):
    """Best row of each group."""
    w = W.partitionBy("o_custkey").orderBy(F.col("o_totalprice").desc(), "o_orderkey")
    return table(spark, sf_dir, "orders").withColumn("k", F.row_number().over(w)).where("k = 1").select("o_custkey", "o_orderkey", "o_totalprice")


@query(
    "f06_first_rule_hit",
    """SELECT p_partkey, rule, flag FROM (SELECT *, row_number() OVER (PARTITION BY p_partkey ORDER BY rule, flag NULLS FIRST) AS k FROM (
      SELECT p_partkey, 1 AS rule, 'big' AS flag FROM part WHERE p_size > 40 UNION ALL SELECT p_partkey, 1, NULL FROM part WHERE p_size > 45 UNION ALL SELECT p_partkey, 2, 'any' FROM part)) WHERE k = 1""",
)
def first_rule_hit(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    hit = lambda rule, flag, test: p.where(test).select("p_partkey", F.lit(rule).alias("rule"), F.lit(flag).cast("string").alias("flag"))
    hits = hit(1, "big", "p_size > 40").unionAll(hit(1, None, "p_size > 45")).unionAll(hit(2, "any", "true"))
    best = hits.groupBy("p_partkey").agg(F.min(F.struct("rule", F.col("flag").isNotNull().alias("set"), "flag")).alias("b"))
    return best.select("p_partkey", "b.rule", "b.flag")


@query("g02_top_changes", "SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem ORDER BY l_returnflag = 'R' DESC, abs(l_quantity - 25) DESC, l_orderkey, l_linenumber LIMIT 50")
def top_changes(spark, sf_dir):
    df = table(spark, sf_dir, "lineitem")
    order = [(F.col("l_returnflag") == "R").desc(), F.abs(F.col("l_quantity") - 25).desc(), "l_orderkey", "l_linenumber"]
    return df.orderBy(*order).limit(50).select("l_orderkey", "l_linenumber", "l_quantity")


@query("h01_union_by_name", "SELECT c_custkey AS id, c_name AS name, c_mktsegment AS segment FROM customer UNION ALL SELECT s_suppkey, s_name, NULL FROM supplier")
def union_by_name(spark, sf_dir):
    """H01 / H02 / C12."""
    a = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"), F.col("c_mktsegment").alias("segment"))
    b = table(spark, sf_dir, "supplier").select(F.col("s_name").alias("name"), F.col("s_suppkey").alias("id"))
    return a.unionByName(b, allowMissingColumns=True)


@query("h03_distinct", "SELECT DISTINCT c_nationkey, c_mktsegment FROM customer")
def distinct(spark, sf_dir):
    return table(spark, sf_dir, "customer").select("c_nationkey", "c_mktsegment").distinct()


@query("d13_full_join", "SELECT coalesce(a.k, b.k) AS k, coalesce(a.n, 0) AS customers, coalesce(b.n, 0) AS suppliers FROM (SELECT c_nationkey AS k, count(*) AS n FROM customer WHERE c_nationkey > 3 GROUP BY 1) a FULL JOIN (SELECT s_nationkey AS k, count(*) AS n FROM supplier WHERE s_nationkey < 20 GROUP BY 1) b ON a.k = b.k")
def full_join(spark, sf_dir):
    a = table(spark, sf_dir, "customer").where("c_nationkey > 3").groupBy(F.col("c_nationkey").alias("k")).agg(F.count(F.lit(1)).alias("a"))
    b = table(spark, sf_dir, "supplier").where("s_nationkey < 20").groupBy(F.col("s_nationkey").alias("k")).agg(F.count(F.lit(1)).alias("b"))
    return a.join(b, "k", "full").select("k", F.coalesce("a", F.lit(0)).alias("customers"), F.coalesce("b", F.lit(0)).alias("suppliers"))


@query("d17_anti_join", "SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_custkey IS NOT NULL)")
def anti_join(spark, sf_dir):
    return table(spark, sf_dir, "customer").join(table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("c_custkey")), "c_custkey", "left_anti").select("c_custkey")


@query("d18_semi_join", "SELECT c_custkey FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_totalprice > 400000)")
def semi_join(spark, sf_dir):
    return table(spark, sf_dir, "customer").join(table(spark, sf_dir, "orders").where("o_totalprice > 400000").select(F.col("o_custkey").alias("c_custkey")), "c_custkey", "left_semi").select("c_custkey")


@query("d14_default_label", "SELECT n_nationkey, coalesce(r_name, n_name) AS label FROM nation LEFT JOIN region ON n_regionkey = r_regionkey AND r_name < 'AS'")
def default_label(spark, sf_dir):
    r = table(spark, sf_dir, "region").where("r_name < 'AS'").withColumnRenamed("r_regionkey", "n_regionkey")
    return table(spark, sf_dir, "nation").join(r, "n_regionkey", "left").select("n_nationkey", F.coalesce("r_name", "n_name").alias("label"))


@query("c15_typed_projection", "SELECT o_orderkey::VARCHAR AS id, o_totalprice AS price, o_orderstatus = 'O' AS open, o_totalprice AS price_copy, NULL::VARCHAR AS gone FROM orders")
def typed_projection(spark, sf_dir):
    from cadastra.plans.schema import TileField, project

    fields = (
        TileField("id", "String", "o_orderkey"),
        TileField("price", "Number", "o_totalprice", copies=("price_copy",)),
        TileField("open", "Boolean", "is_open"),
        TileField("gone", "String", "no_such_column"),
    )
    return project(table(spark, sf_dir, "orders").withColumn("is_open", F.expr("if(o_orderstatus = 'O', 'true', 'false')")), fields)


@query("c03_user_predicate", "SELECT count(*) AS kept, (SELECT count(*) FROM part) - count(*) AS dropped FROM part WHERE p_size > 10 AND p_brand LIKE 'Brand#1%'")
def user_predicate(spark, sf_dir):
    """A free predicate, with what it filters out."""
    from cadastra.plans.schema import checked_predicate

    df = table(spark, sf_dir, "part")
    keep = F.coalesce(F.expr(checked_predicate("p_size > 10 AND p_brand LIKE 'Brand#1%'")), F.lit(False))
    return df.agg(F.count_if(keep).alias("kept"), F.count_if(~keep).alias("dropped"))
