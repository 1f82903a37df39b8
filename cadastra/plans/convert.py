"""The convert job: which columns go through, what is computed, what is filtered, and the accounting of rows."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cadastra.functions.heights import HeightRule, height_columns, leading_number
from cadastra.plans.schema import checked_predicate

# Columns that a conversion makes, and names that stand for internal columns of a comparison.
HEIGHT_GENERATED = ("height_m", "h_raw", "h_src", "h_outlier")
PARTS_GENERATED = ("has_parts", "is_part")
GENERATED = HEIGHT_GENERATED + PARTS_GENERATED


@dataclass(frozen=True)
class ConvertSpec:
    """One job. columns None: all but generated ones. height and levels name the columns that the rule reads."""

    columns: tuple[str, ...] | None = None
    rule: HeightRule | None = None
    height: str | None = None
    levels: str | None = None
    provenance: str | None = None
    parts: tuple[str, str] | None = None  # id and parent column
    where: str | None = None
    categories: tuple[str, ...] = ()


def passed_through(fields: list[str], spec: ConvertSpec) -> list[str]:
    """The columns that are copied: what was asked for without what is computed anew, and the columns parts need."""
    made = (HEIGHT_GENERATED if spec.rule else ()) + (PARTS_GENERATED if spec.parts else ())
    asked = [f for f in fields if f not in GENERATED] if spec.columns is None else list(spec.columns)
    needed = list(spec.parts or ())
    absent = [c for c in [*asked, *needed] if c not in fields] + [c for c in spec.categories if c not in fields and c not in made]
    if absent:
        raise ValueError(f"no such column: {', '.join(dict.fromkeys(absent))}")
    return list(dict.fromkeys([c for c in asked if c not in made] + needed))


def _number(df: DataFrame, name: str | None):
    if name is None:
        return F.lit(None).cast("double")
    return leading_number(F.col(name)) if dict(df.dtypes)[name] == "string" else F.col(name).try_cast("double")


def filtered(df: DataFrame, where: str | None) -> DataFrame:
    return df.where(checked_predicate(where)) if where and where.strip() else df


def normalised(df: DataFrame, spec: ConvertSpec) -> DataFrame:
    """The converted rows. A height column named height_m is kept as h_raw, as the derived one takes its name.

    Rows for which the predicate is null go, like those for which it is false. Repeated rows stay; an empty table
    gives an empty result.
    """
    columns = [F.col(c) for c in passed_through(df.columns, spec)]
    if spec.rule:
        if spec.height == "height_m":
            columns.append(F.col("height_m").alias("h_raw"))
        provenance = F.col(spec.provenance) if spec.provenance else None
        made = height_columns(spec.rule, _number(df, spec.height), _number(df, spec.levels), provenance)
        columns += [c.alias(name) for name, c in made.items()]
    return filtered(df, spec.where).select(*columns)


def accounting(df: DataFrame, spec: ConvertSpec) -> DataFrame:
    """rows_in, rows_kept, filtered_out in one pass."""
    keep = F.coalesce(F.expr(checked_predicate(spec.where)), F.lit(False)) if spec.where and spec.where.strip() else F.lit(True)
    out = df.agg(F.count(F.lit(1)).alias("rows_in"), F.count_if(keep).alias("rows_kept"))
    return out.withColumn("filtered_out", F.col("rows_in") - F.col("rows_kept"))


def without_reserved(fields: list[str], roles: dict[str, str | None], reserved: tuple[str, ...] = ()) -> list[str]:
    """Fields without internal names; one of these that has a role (id, parent, height ...) is an error."""
    internal = [f for f in fields if f in reserved or f.startswith("__")]
    clash = sorted(set(internal) & {name for name in roles.values() if name})
    if clash:
        raise ValueError(f"columns with a role have internal names: {', '.join(clash)}")
    return [f for f in fields if f not in internal]
