"""Colours, cell ids, time-ordered ids and labels as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

HEX = "^#([0-9a-fA-F]{3,4}|[0-9a-fA-F]{6}|[0-9a-fA-F]{8})$"
CALL = r"^(rgb|hsl)a?\(([^)]*)\)$"
# Base cells of the hexagon index that are pentagons.
PENTAGONS = (4, 14, 24, 38, 49, 58, 63, 72, 83, 97, 107, 117)


def _unit(x: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), x))


def _share(text: Column, scale: float) -> Column:
    """A channel: a percentage, or a number on its scale."""
    return F.when(text.endswith("%"), F.rtrim(text, F.lit("%")).try_cast("double") / 100).otherwise(text.try_cast("double") / scale)


def _bind(value: Column, use) -> Column:
    """use(value), with value worked out once."""
    return F.transform(F.array(value), use)[0]


def colour(text: Column) -> Column:
    """struct(r, g, b, a) in [0, 1] of #rgb, #rgba, #rrggbb, #rrggbbaa, rgb[a]() and hsl[a](); null for anything else."""
    made = lambda *c: F.struct(*[x.alias(n) for x, n in zip(c, "rgba")])

    def from_digits(digits: Column) -> Column:
        byte = lambda k: F.conv(F.substring(digits, 2 * k + 1, 2), 16, 10).cast("double") / 255
        return made(byte(0), byte(1), byte(2), F.when(F.length(digits) == 8, byte(3)).otherwise(1.0))

    def from_call(v: Column) -> Column:
        part = lambda k: F.get(v["parts"], F.lit(k))
        alpha = F.when(F.size(v["parts"]) == 4, _share(part(3), 1.0)).otherwise(1.0)
        hue = F.pmod(F.regexp_replace(part(0), "deg$", "").try_cast("double"), F.lit(360.0))
        hsl = F.struct(hue.alias("h"), _share(part(1), 100.0).alias("s"), _share(part(2), 100.0).alias("l"), alpha.alias("a"))
        rgb = made(*[_share(part(k), 255.0) for k in range(3)], alpha)
        return F.when(F.size(v["parts"]).isin(3, 4), F.when(v["name"] == "rgb", rgb).otherwise(_bind(hsl, from_hue)))

    def from_hue(c: Column) -> Column:
        # a channel is the lightness, less or more by how far the hue is from the channel's own
        reach = c["s"] * F.least(c["l"], 1 - c["l"])
        channel = lambda offset: _bind(F.pmod(offset + c["h"] / 30, F.lit(12.0)), lambda k: c["l"] - reach * F.greatest(F.lit(-1.0), F.least(k - 3, 9 - k, F.lit(1.0))))
        return made(*[channel(F.lit(x)) for x in (0.0, 8.0, 4.0)], c["a"])

    def read(t: Column) -> Column:
        digits = F.regexp_extract(t, HEX, 1)
        long = F.when(F.length(digits) <= 4, F.regexp_replace(digits, "(.)", "$1$1")).otherwise(digits)
        parts = F.filter(F.split(F.trim(F.regexp_extract(F.lower(t), CALL, 2)), r"[,\s/]+"), lambda p: p != "")
        call = F.struct(F.regexp_extract(F.lower(t), CALL, 1).alias("name"), parts.alias("parts"))
        return F.when(digits != "", _bind(long, from_digits)).when(call["name"] != "", _bind(call, from_call))

    whole = lambda c: c["r"].isNotNull() & c["g"].isNotNull() & c["b"].isNotNull() & c["a"].isNotNull()
    return _bind(_bind(F.trim(text), read), lambda c: F.when(whole(c), made(*[_unit(c[n]) for n in "rgba"])))


def colour_text(colour_: Column) -> Column:
    """#rrggbb, or rgba(r, g, b, a) where it is see-through; null of null."""

    def written(c: Column) -> Column:
        byte = lambda n: F.floor(c[n] * 255 + 0.5).cast("int")
        hexed = F.concat(F.lit("#"), *[F.lower(F.lpad(F.hex(byte(n)), 2, "0")) for n in "rgb"])
        alpha = F.regexp_replace(F.format_string("%.3f", c["a"]), r"\.?0+$", "")
        clear = F.concat(F.lit("rgba("), F.concat_ws(", ", *[byte(n).cast("string") for n in "rgb"], alpha), F.lit(")"))
        return F.when(c["a"] >= 0.9995, hexed).when(c["a"].isNotNull(), clear)

    return _bind(colour_, written)


def hex_cell_resolution(cell: Column) -> Column:
    """Resolution of a valid cell id of the hexagon index (15 hexadecimal digits); null for any other text.

    From the top: a bit 0, four mode bits (1: a cell), three bits 0, four of the resolution, seven of the base
    cell and 15 digits of three bits, 7 beyond the resolution. Below a pentagon the first digit that is not 0 is not 1.
    """
    value = F.when(cell.rlike("^[0-9a-f]{15}$"), F.conv(cell, 16, 10).cast("long"))
    bits = lambda low, n: F.shiftrightunsigned(value, low).bitwiseAND((1 << n) - 1)
    resolution, base = bits(52, 4), bits(45, 7)
    digits = F.transform(F.sequence(F.lit(0), F.lit(14)), lambda k: F.call_function("shiftrightunsigned", value, 42 - 3 * k).bitwiseAND(7))
    inside = F.slice(digits, 1, F.greatest(F.lit(1), resolution.cast("int")))
    used = F.when(resolution > 0, F.forall(inside, lambda d: d < 7)).otherwise(True)
    unused = F.forall(F.slice(digits, resolution.cast("int") + 1, 15), lambda d: d == 7)
    first = F.get(F.filter(inside, lambda d: d != 0), F.lit(0))
    skewed = base.isin(*PENTAGONS) & (resolution > 0) & F.coalesce(first == 1, F.lit(False))
    good = (bits(59, 4) == 1) & (bits(56, 3) == 0) & (base < 122) & used & F.coalesce(unused, F.lit(True)) & ~skewed
    return F.when(good, resolution.cast("int"))


def cells_listed(text: Column) -> Column:
    """struct(cells, bad) of a pasted list: valid cell ids in their order, each once, and the other words."""
    words = F.array_distinct(F.filter(F.split(F.lower(text), r"[\s,;\"'\[\]()]+"), lambda w: w != ""))
    valid = lambda w: hex_cell_resolution(w).isNotNull()
    return F.struct(F.filter(words, valid).alias("cells"), F.filter(words, lambda w: ~valid(w)).alias("bad"))


def uuid7(millis: Column, random: Column) -> Column:
    """A time-ordered id: 48 bits of milliseconds, then version 7, and 74 of the 80 bits of random (20 hexadecimal digits)."""
    time = F.lpad(F.lower(F.hex(millis)), 12, "0")
    part = lambda a, n: F.substring(random, a, n)
    variant = F.substring(F.lit("89ab"), (F.conv(part(4, 1), 16, 10).cast("int") % 4 + 1), F.lit(1))
    return F.concat(F.substring(time, 1, 8), F.lit("-"), F.substring(time, 9, 4), F.lit("-7"), part(1, 3), F.lit("-"), variant, part(5, 3), F.lit("-"), part(8, 12))


def column_letter(n: Column) -> Column:
    """Letters of a sheet's column, 0 being A; up to three of them."""
    letter = lambda x: F.char((x % 26 + 65).cast("int"))
    two, three = F.floor(n / 26) - 1, F.floor((F.floor(n / 26) - 1) / 26) - 1
    return F.concat(F.when(n >= 702, letter(three)).otherwise(""), F.when(n >= 26, letter(two)).otherwise(""), letter(n))


def safe_name(text: Column) -> Column:
    """A file name: anything but letters, digits, dot, dash and underscore becomes one underscore; never empty."""
    plain = F.regexp_replace(F.regexp_replace(F.coalesce(text, F.lit("")), r"[^\p{L}\p{N}._-]+", "_"), r"^[._]+|[._]+$", "")
    return F.when(plain == "", "file").otherwise(plain)


def looks_like_degrees(x0: Column, y0: Column, x1: Column, y1: Column) -> Column:
    """Does an extent fit the bounds of longitude and latitude?"""
    return (x0 >= -180) & (x0 <= x1) & (x1 <= 180) & (y0 >= -90) & (y0 <= y1) & (y1 <= 90)
