"""What a table is: roles of its columns, types of text columns, geometry kinds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType, StringType, StructType

# Names that suggest a role, in order of preference.
ROLE_NAMES = {
    "id": ("building_id", "id", "osm_id", "fid"),
    "height": ("height_m", "height", "h", "height_max"),
    "levels": ("num_floors", "levels", "building_levels", "floors"),
    "min_height": ("min_height", "min_height_m", "base_height"),
    "parent": ("parent_building_id", "parent_id", "parent"),
    "provenance": ("height_provenance", "height_source", "h_src"),
}
NUMERIC_ROLES = ("height", "levels", "min_height")


def suggest_roles(schema: StructType) -> dict[str, str]:
    """role -> column. Numeric roles take numbers or text, the others anything."""
    named = {f.name.lower(): f for f in schema}
    out = {}
    for role, names in ROLE_NAMES.items():
        for n in names:
            if n in named and (role not in NUMERIC_ROLES or isinstance(named[n].dataType, (NumericType, StringType))):
                out[role] = named[n].name
                break
    return out


def inferred_types(df: DataFrame, columns: tuple[str, ...]) -> DataFrame:
    """(column, type, filled): integer, number or text for each text column; codes with a leading zero stay text."""

    def one(c: str):
        t = F.nullif(F.trim(c), F.lit(""))
        whole = F.bool_and(t.rlike(r"^-?[0-9]+$") & ~t.rlike(r"^-?0[0-9]"))
        number = F.bool_and(t.rlike(r"^-?[0-9]*[.,]?[0-9]+$") & ~t.rlike(r"^-?0[0-9]"))
        kind = F.when(F.count(t) == 0, "text").when(whole, "integer").when(number, "number").otherwise("text")
        return F.struct(F.lit(c).alias("column"), kind.alias("type"), F.count(t).alias("filled"))

    row = df.agg(F.array(*[one(c) for c in columns]).alias("r"))
    return row.select(F.explode("r").alias("r")).select("r.*")


def geometry_kinds(df: DataFrame, wkb: str, sample: int = 1000) -> DataFrame:
    """Counts of WKB geometry types in the first rows (a sample is the feature)."""
    code = F.conv(F.hex(F.reverse(F.substring(wkb, 2, 4))), 16, 10).cast("int") % 1000
    names = F.create_map(*[F.lit(x) for k, v in {1: "POINT", 2: "LINESTRING", 3: "POLYGON", 6: "MULTIPOLYGON", 7: "GEOMETRYCOLLECTION"}.items() for x in (k, v)])
    return df.limit(sample).groupBy(names[code].alias("kind")).agg(F.count(F.lit(1)).alias("n"))
