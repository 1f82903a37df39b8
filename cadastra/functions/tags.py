"""Reading of free-text tags and identifiers as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Metres per unit, limits of tagged lengths and levels, values that say no or nothing.
METRES_PER = {
    "": 1.0, "m": 1.0, "meter": 1.0, "meters": 1.0, "metre": 1.0, "metres": 1.0,
    "'": 0.3048, "ft": 0.3048, "foot": 0.3048, "feet": 0.3048,
    '"': 0.0254, "in": 0.0254, "inch": 0.0254, "inches": 0.0254,
}
MAX_LENGTH_M = 1000.0
MAX_LEVELS = 250
NOT_BUILDING = ("no", "none", "false", "0")
NO_VALUE = ("yes", "true", "1")
# Height sources by the words in a record's origin, and by the whole of it.
ORIGIN_WORDS = {"gba_osm": ("osm", "openstreetmap"), "gba_google": ("google", "gob"), "gba_ms": ("microsoft", "bing")}
ORIGIN_NAMES = {"ms": "gba_ms", "msft": "gba_ms", "gba_ms": "gba_ms"}

#: A measure is a run of quantities, each a number and its unit.
QUANTITY = r"([0-9]+(?:[.,][0-9]+)?)\s*([a-z'\"]*)\s*"


def length_m(text: Column) -> Column:
    """A length in metres: `12`, `12,5 m`, `40 ft`, `12'6"`; null for anything else, for 0 and above 1000 m. Three decimals.

    The text is cut into quantities and their sum is taken. One quantity is in metres or feet; two are whole feet
    (') and inches, whose sign may be left out.
    """
    t = F.lower(F.trim(text))
    numbers = F.transform(F.regexp_extract_all(t, F.lit(QUANTITY), F.lit(1)), lambda x: F.regexp_replace(x, ",", ".").try_cast("double"))
    units = F.regexp_extract_all(t, F.lit(QUANTITY), F.lit(2))
    first, second = F.get(units, F.lit(0)), F.get(units, F.lit(1))
    inches = F.when(second == "", '"').otherwise(second)
    one = (F.size(units) == 1) & first.isin(*[u for u, m in METRES_PER.items() if m > 0.1])
    two = (F.size(units) == 2) & (first == "'") & inches.isin(*[u for u, m in METRES_PER.items() if m < 0.1]) & (F.get(numbers, F.lit(0)) % 1 == 0)
    per = F.create_map(*[F.lit(x) for pair in METRES_PER.items() for x in pair])
    total = F.get(numbers, F.lit(0)) * per[first] + F.when(two, F.get(numbers, F.lit(1)) * per[inches]).otherwise(0.0)
    whole = F.regexp_replace(t, QUANTITY, "") == ""
    return F.when(whole & (one | two) & (total > 0) & (total <= MAX_LENGTH_M), F.floor(total * 1000 + 0.5) / 1000)


def levels(text: Column, minimum: float = 0.0) -> Column:
    """A level count; of `3;4` the larger. One unreadable piece makes it null."""
    pieces = F.transform(F.split(text, ";"), lambda p: F.regexp_replace(F.trim(p), ",", ".").try_cast("double"))
    bad = F.exists(pieces, lambda p: p.isNull() | F.isnan(p))
    most = F.array_max(pieces)
    return F.when(~bad & most.between(minimum, MAX_LEVELS), most)


def _value(tags: Column, key: str) -> Column:
    return F.lower(F.trim(F.coalesce(tags[key], F.lit(""))))


def is_set(tags: Column, key: str) -> Column:
    """Has the key a value that does not deny it?"""
    return ~_value(tags, key).isin("", *NOT_BUILDING)


def kind(tags: Column) -> Column:
    """part, building, or null for what is neither or lies underground."""
    named = F.coalesce(*[F.when(is_set(tags, key), name) for key, name in (("building:part", "part"), ("building", "building"))])
    above = _value(tags, "tunnel").isin("", "no") & (_value(tags, "location") != "underground")
    return F.when(above, named)


def text_tag(tags: Column, key: str) -> Column:
    return F.nullif(F.trim(tags[key]), F.lit(""))


def building_attributes(tags: Column, m_per_level: float = 3.5) -> dict[str, Column]:
    """The attribute columns that come from a tag map."""
    own = F.when(is_set(tags, "building:part"), text_tag(tags, "building:part")).otherwise(text_tag(tags, "building"))
    low = levels(tags["building:min_level"])
    by_level = F.when(low > 0, F.floor(low * m_per_level * 1000 + 0.5) / 1000)
    return {
        "name": F.coalesce(text_tag(tags, "name"), text_tag(tags, "name:vi")),
        "class": F.when(~F.lower(own).isin(*NO_VALUE), own),
        "height": length_m(tags["height"]),
        "num_floors": levels(tags["building:levels"], 1),
        "min_height": F.coalesce(length_m(tags["min_height"]), by_level),
        "min_floor": low,
        "roof_shape": text_tag(tags, "roof:shape"),
        "roof_height": length_m(tags["roof:height"]),
        "roof_color": text_tag(tags, "roof:colour"),
        "roof_material": text_tag(tags, "roof:material"),
        "facade_color": text_tag(tags, "building:colour"),
        "facade_material": text_tag(tags, "building:material"),
    }


def tag_issues(tags: Column) -> Column:
    """array<struct<key, value>> of numeric tags that are set but unusable."""
    checks = [(k, length_m(tags[k])) for k in ("height", "min_height", "roof:height")]
    checks += [("building:levels", levels(tags["building:levels"], 1)), ("building:min_level", levels(tags["building:min_level"]))]
    bad = [F.when((F.trim(tags[k]) != "") & read.isNull(), F.struct(F.lit(k).alias("key"), tags[k].alias("value"))) for k, read in checks]
    return F.array_compact(F.array(*bad))


def hstore(text: Column) -> Column:
    """`"key"=>"value", ...` as a map, with or without blanks around the arrow; an unquoted NULL is null.

    Backslash escapes are taken back. Of a key that comes again the last value holds.
    """
    quoted = r'"((?:[^"\\]|\\.)*)"'
    pair = rf"(?i){quoted}\s*=>\s*(?:{quoted}|NULL)"
    part = lambda k: F.regexp_extract_all(text, F.lit(pair), F.lit(k))
    plain = lambda x: F.regexp_replace(x, r"\\(.)", "$1")
    pairs = F.transform(
        F.arrays_zip(part(0).alias("whole"), part(1).alias("key"), part(2).alias("value")),
        lambda x: F.struct(plain(x["key"]).alias("key"), F.when(x["whole"].endswith('"'), plain(x["value"])).alias("value")),
    )
    last = F.filter(pairs, lambda x, i: ~F.exists(F.slice(pairs, i + 2, F.size(pairs)), lambda y: y["key"] == x["key"]))
    return F.map_from_entries(last)


def key_text(column: Column, kind_: str) -> Column:
    """An identifier as text: 123, 123.0 and ` 123 ` are the same, blank is null."""
    if kind_ in ("double", "float"):
        whole = (column == F.floor(column)) & (F.abs(column) < 1e15)
        return F.when(whole, column.cast("long").cast("string")).otherwise(F.nullif(F.trim(column.cast("string")), F.lit("")))
    return F.nullif(F.trim(column.cast("string")), F.lit(""))


def osm_record_id(record: Column) -> Column:
    """`w123@4` -> `way/123`."""
    number = F.regexp_extract(record, "^[a-z]([0-9]+)", 1)
    first = F.substring(record, 1, 1)
    named = F.when(first == "w", "way/").when(first == "r", "relation/").when(first == "n", "node/")
    return F.when(number != "", F.concat(named, number))


def record_version(record: Column) -> Column:
    return F.regexp_extract(record, "@([0-9]+)$", 1).try_cast("int")


def source_id_kind(text: Column) -> Column:
    """osm, plus_code, uuid or other."""
    return (
        F.when(text.rlike("^(way|relation|node)/[0-9]+$"), "osm")
        .when(text.rlike("^[23456789CFGHJMPQRVWX]{8}[+][23456789CFGHJMPQRVWX]{2,}$"), "plus_code")
        .when(text.rlike("^[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}$"), "uuid")
        .otherwise("other")
    )


def name_uuid(name: Column, prefix: str) -> Column:
    """A name-based id: md5 digits in UUID layout, version and variant 8."""
    h = F.md5(F.concat(F.lit(prefix), name).cast("binary"))
    part = lambda a, n: F.substring(h, a, n)
    return F.concat(part(1, 8), F.lit("-"), part(9, 4), F.lit("-8"), part(14, 3), F.lit("-8"), part(18, 3), F.lit("-"), part(21, 12))


def lineage_family(origin: Column) -> Column:
    """Which source a height record was copied from: by a word in its origin, else by its whole name."""
    o = F.lower(origin)
    by_word = [F.when(F.greatest(*[F.instr(o, w) for w in words]) > 0, family) for family, words in ORIGIN_WORDS.items()]
    by_name = F.create_map(*[F.lit(x) for pair in ORIGIN_NAMES.items() for x in pair])[o]
    return F.coalesce(*by_word, by_name, F.lit("gba_other"))


def type_family(name: str) -> str:
    """The family of a Spark type name, in which values are compared."""
    name = name.lower()
    if name in ("tinyint", "smallint", "int", "bigint"):
        return "int"
    if name in ("float", "double") or name.startswith("decimal"):
        return "real"
    if name == "boolean":
        return "bool"
    if name in ("date", "timestamp", "timestamp_ntz"):
        return "temporal"
    return "text"


def differs(a: Column, b: Column, family: str) -> Column:
    """Null-safe difference by type family; numbers with a relative tolerance of 1e-9."""
    one_null = a.isNull() != b.isNull()
    if family in ("int", "real"):
        x, y = a.try_cast("double"), b.try_cast("double")
        far = F.abs(x - y) > F.greatest(F.abs(x), F.abs(y), F.lit(1.0)) * 1e-9
        return F.coalesce(far, x.isNull() != y.isNull())
    if family == "bool":
        return ~a.try_cast("boolean").eqNullSafe(b.try_cast("boolean"))
    if family == "temporal":
        return ~a.try_cast("timestamp").eqNullSafe(b.try_cast("timestamp"))
    return one_null | F.coalesce(a.cast("string") != b.cast("string"), F.lit(False))
