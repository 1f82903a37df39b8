"""Sinks: sorted files, versions with an atomic pointer, review lists, reports, GeoPackage."""

from __future__ import annotations

import json
import os
import sqlite3
import struct
import uuid

from pyspark.sql import DataFrame, SparkSession


def write_sorted(df: DataFrame, path: str, *by: str) -> None:
    """ZSTD Parquet, range-partitioned and sorted, so that statistics prune."""
    df.repartitionByRange(*by).sortWithinPartitions(*by).write.mode("overwrite").option("compression", "zstd").parquet(path)


def write_review(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").partitionBy("family").parquet(path)


def activate(folder: str, version: str) -> None:
    """Point at a version that is completely written; activating an older one rolls back."""
    temporary = os.path.join(folder, "active.json.tmp")
    with open(temporary, "w") as f:
        json.dump({"version": version}, f)
    os.replace(temporary, os.path.join(folder, "active.json"))


def active(folder: str) -> str | None:
    try:
        with open(os.path.join(folder, "active.json")) as f:
            return json.load(f)["version"]
    except FileNotFoundError:
        return None


def grid_features(cells: DataFrame, degrees: float) -> DataFrame:
    """One GeoJSON feature per grid cell (gx, gy and counts), as text."""
    counts = [c for c in cells.columns if c not in ("gx", "gy")]
    x, y = f"gx * {degrees}", f"gy * {degrees}"
    ring = ", ".join(f"array({a}, {b})" for a, b in ((x, y), (f"{x} + {degrees}", y), (f"{x} + {degrees}", f"{y} + {degrees}"), (x, f"{y} + {degrees}"), (x, y)))
    named = ", ".join(f"'{c}', {c}" for c in counts)
    return cells.selectExpr(f"to_json(named_struct('type', 'Feature', 'geometry', named_struct('type', 'Polygon', 'coordinates', array(array({ring}))), 'properties', named_struct({named}))) AS feature")


def markdown(title: str, rows: list[dict]) -> str:
    """A small collected table as Markdown."""
    if not rows:
        return f"## {title}\n\n(none)\n"
    head = list(rows[0])
    lines = ["| " + " | ".join(head) + " |", "|" + "---|" * len(head)]
    lines += ["| " + " | ".join("" if r[c] is None else str(r[c]) for c in head) + " |" for r in rows]
    return f"## {title}\n\n" + "\n".join(lines) + "\n"


def write_geopackage(df: DataFrame, path: str, layer: str, geometry: str = "geometry", srs: int = 4326) -> int:
    """Stream rows into a one-layer GeoPackage on the driver, partition by partition; returns the number of rows."""
    kinds = {"bigint": "INTEGER", "int": "INTEGER", "double": "REAL", "float": "REAL", "boolean": "BOOLEAN", "binary": "BLOB"}
    columns = ", ".join(f'"{n}" {"GEOMETRY" if n == geometry else kinds.get(t, "TEXT")}' for n, t in df.dtypes)
    at, n = df.columns.index(geometry), 0
    with sqlite3.connect(path) as con:
        con.executescript(
            f"""PRAGMA application_id = 1196444487; PRAGMA user_version = 10300;
            CREATE TABLE IF NOT EXISTS gpkg_spatial_ref_sys (srs_name TEXT, srs_id INTEGER PRIMARY KEY, organization TEXT, organization_coordsys_id INTEGER, definition TEXT);
            INSERT OR IGNORE INTO gpkg_spatial_ref_sys VALUES ('srs', {srs}, 'EPSG', {srs}, 'undefined');
            CREATE TABLE IF NOT EXISTS gpkg_contents (table_name TEXT PRIMARY KEY, data_type TEXT, identifier TEXT, srs_id INTEGER);
            CREATE TABLE IF NOT EXISTS gpkg_geometry_columns (table_name TEXT, column_name TEXT, geometry_type_name TEXT, srs_id INTEGER, z INTEGER, m INTEGER);
            INSERT INTO gpkg_contents VALUES ('{layer}', 'features', '{layer}', {srs});
            INSERT INTO gpkg_geometry_columns VALUES ('{layer}', '{geometry}', 'GEOMETRY', {srs}, 0, 0);
            CREATE TABLE "{layer}" (fid INTEGER PRIMARY KEY, {columns});"""
        )
        marks = ", ".join("?" * len(df.columns))
        for row in df.toLocalIterator(prefetchPartitions=True):
            values = list(row)
            if values[at] is not None:
                values[at] = b"GP\x00\x01" + struct.pack("<i", srs) + bytes(values[at])
            con.execute(f'INSERT INTO "{layer}" ({", ".join(chr(34) + c + chr(34) for c in df.columns)}) VALUES ({marks})', values)
            n += 1
    return n


def observed_count(spark: SparkSession, df: DataFrame, name: str):
    """(df, observation): counts rows while they are written, without a further pass; a range partitioning above would run it twice."""
    from pyspark.sql import Observation
    from pyspark.sql import functions as F

    seen = Observation(name)
    return df.observe(seen, F.count(F.lit(1)).alias("rows")), seen


def replace_table(df: DataFrame, path: str) -> None:
    """Write df beside path and put it in its place only when it is whole; a failed write leaves the old table."""
    spark, jvm = df.sparkSession, df.sparkSession._jvm
    place = lambda suffix: jvm.org.apache.hadoop.fs.Path(f"{path.rstrip('/')}{suffix}")
    fs = place("").getFileSystem(spark._jsc.hadoopConfiguration())
    new, old = f".new-{uuid.uuid4().hex}", f".old-{uuid.uuid4().hex}"
    df.write.parquet(f"{path.rstrip('/')}{new}")
    if fs.exists(place("")):
        fs.rename(place(""), place(old))
    if not fs.rename(place(new), place("")):
        raise OSError(f"{path} could not be replaced; the new table is {path}{new}")
    fs.delete(place(old), True)
