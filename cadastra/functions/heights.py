"""Building heights: the height rule, lineage and report bins as column expressions."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

# Report bins (metres) and the sources that count as measured.
HEIGHT_BIN_EDGES = (0, 3, 6, 10, 15, 25, 40, 60, 100, 200)
REAL_SOURCES = ("height", "levels", "clamped")


@dataclass(frozen=True)
class HeightRule:
    """How a height is derived. The defaults are fixed values."""

    m_per_level: float = 3.5
    default_m: float = 3.5
    min_m: float = 2.0
    max_m: float = 500.0
    min_levels: float = 1.0
    max_levels: float = 200.0
    mode: str = "fallback"  # fallback | clamp | keep
    decimals: int = 1
    placeholders: tuple[str, ...] = ()

    def __post_init__(self):
        if self.mode not in ("fallback", "clamp", "keep"):
            raise ValueError(f"unknown outlier mode {self.mode}")
        if self.min_m > self.max_m:
            raise ValueError("the height range is inverted")


def half_up(x: Column, decimals: int) -> Column:
    """Rounding by floor, the same in every engine."""
    scale = float(10**decimals)
    return F.floor(x * scale + 0.5) / scale


def leading_number(text: Column) -> Column:
    """The number a text starts with: `12 m` and `12,5` read, junk is null rather than 0."""
    plain = F.regexp_replace(F.trim(text), ",", ".")
    return F.nullif(F.regexp_extract(plain, r"^[0-9]*[.]?[0-9]+", 0), F.lit("")).try_cast("double")


def height_columns(rule: HeightRule, height: Column, levels: Column, provenance: Column | None = None) -> dict[str, Column]:
    """height_m, h_src and h_outlier of a row."""
    if provenance is not None and rule.placeholders:
        height = F.when(provenance.isin(*rule.placeholders), F.lit(None).cast("double")).otherwise(height)
    good_h = height.between(rule.min_m, rule.max_m)
    good_l = levels.between(rule.min_levels, rule.max_levels)
    use_h, use_l = (height.isNotNull(), levels.isNotNull()) if rule.mode == "keep" else (good_h, good_l)
    value = F.when(use_h, half_up(height, rule.decimals))
    source = F.when(use_h, "height")
    if rule.mode == "clamp":
        value, source = value.when(height > rule.max_m, F.lit(rule.max_m)), source.when(height > rule.max_m, "clamped")
    value = value.when(use_l, half_up(levels * rule.m_per_level, rule.decimals)).otherwise(F.lit(rule.default_m))
    source = source.when(use_l, "levels").otherwise("default")
    odd = (height.isNotNull() & ~good_h) | (levels.isNotNull() & ~good_l)
    return {"height_m": value, "h_src": source, "h_outlier": F.when(odd, 1).otherwise(0)}


def lineage(source: Column) -> Column:
    """Where a derived height comes from, in words."""
    return F.when(source == "height", "tag:height").when(source == "levels", "tag:levels").when(source == "clamped", "tag:height:clamped").otherwise("default")


def fixed_bin(x: Column, edges: tuple[float, ...] = HEIGHT_BIN_EDGES) -> Column:
    """Index of the bin; the last is open above and the first takes in what lies below it."""
    out = F.lit(0)
    for k, edge in enumerate(edges[1:], 1):
        out = F.when(x >= edge, F.lit(k)).otherwise(out)
    return out
