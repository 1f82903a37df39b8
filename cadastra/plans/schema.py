"""Declared schemas: typed projection, checks, and the comparison of two releases' fields."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from cadastra.functions.tags import type_family

CASTS = {"String": "string", "Number": "double", "Boolean": "boolean"}


@dataclass(frozen=True)
class TileField:
    name: str
    kind: str  # String | Number | Boolean
    source: str | None = None
    required: bool = False
    copies: tuple[str, ...] = ()


def project(df: DataFrame, fields: tuple[TileField, ...]) -> DataFrame:
    """The fields, cast to their kind; one whose source is missing is null."""
    out = []
    for f in fields:
        source = f.source or f.name
        kind = CASTS[f.kind]
        column = F.col(source).try_cast(kind) if source in df.columns else F.lit(None).cast(kind)
        out += [column.alias(n) for n in (f.name, *f.copies)]
    return df.select(*out)


def check(schema: StructType, fields: tuple[TileField, ...]) -> list[tuple[str, str, str]]:
    """(level, field, problem) where a written layer departs from its declaration."""
    have = {f.name: f.dataType.simpleString() for f in schema}
    families = {"String": ("text", "temporal"), "Number": ("int", "real"), "Boolean": ("bool",)}
    found = []
    for f in fields:
        for name in (f.name, *f.copies):
            if name not in have:
                found.append(("fail" if f.required else "warn", name, "missing"))
            elif type_family(have[name]) not in families[f.kind]:
                found.append(("fail", name, f"type {have[name]}"))
    declared = {n for f in fields for n in (f.name, *f.copies)}
    return found + [("info", n, "not declared") for n in sorted(set(have) - declared)]


def checked_predicate(clause: str) -> str:
    if ";" in clause:
        raise ValueError("a predicate is a single expression")
    return clause


def type_change(a: str, b: str, tiles: bool = False) -> str | None:
    """info, warn or fail for a field whose type goes from a to b; None where it stays."""
    if a == b:
        return None
    x, y = type_family(a), type_family(b)
    if x == y:
        return "info"
    pair = (x, y)
    if pair == ("int", "real"):
        return "info"
    if pair == ("real", "int"):
        return "info" if tiles else "warn"
    if tiles and (set(pair) == {"temporal", "text"} or "bool" in pair and {x, y} <= {"bool", "int", "real"}):
        return "info"
    return "fail"


def schema_diff(a: StructType, b: StructType, required: tuple[str, ...] = (), tiles: bool = False) -> list[tuple[str, str, str, str | None, str | None]]:
    """(code, level, field, type in A, type in B), ordered by code and field."""
    x, y = ({f.name: f.dataType.simpleString() for f in s} for s in (a, b))
    out = []
    for n in sorted(x.keys() - y.keys()):
        out.append(("schema_missing", "fail", n, x[n], None) if n in required else ("schema_missing_optional", "warn", n, x[n], None))
    out += [("schema_added", "info", n, None, y[n]) for n in sorted(y.keys() - x.keys())]
    for n in sorted(x.keys() & y.keys()):
        if level := type_change(x[n], y[n], tiles):
            out.append((f"schema_type_{level}", level, n, x[n], y[n]))
    return sorted(out)
