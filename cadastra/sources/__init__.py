"""Readers of vector files and answers, as DataFrames of attributes and one WKB geometry."""

from __future__ import annotations

import json
import re
import sqlite3
import struct
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from cadastra.functions.geometry import polygon_area, polygons_centroid, read_wkb, read_wkt, write_wkb
from cadastra.functions.rings import is_closed, polygons, stitch

# The columns of headerless footprint lists, and names that a geometry column may have.
FOOTPRINT_LIST = "latitude double, longitude double, area_in_meters double, confidence double, geometry string, full_plus_code string"
GEOMETRY_NAMES = ("geometry", "geom", "wkb_geometry", "geometry_wkt", "wkt", "the_geom", "shape")


def parquet(spark: SparkSession, path: str, numbered: bool = False) -> DataFrame:
    """Files of a path or glob; numbered adds _pid, unique over all files, from file and row."""
    df = spark.read.parquet(path)
    if not numbered:
        return df
    return df.withColumn("_pid", F.concat_ws("#", "_metadata.file_path", F.col("_metadata.row_index").cast("string")))


def anonymous_s3(spark: SparkSession) -> None:
    """Let s3a read public buckets without credentials."""
    spark.sparkContext._jsc.hadoopConfiguration().set("fs.s3a.aws.credentials.provider", "org.apache.hadoop.fs.s3a.AnonymousAWSCredentialsProvider")


def in_bbox(df: DataFrame, west: float, south: float, east: float, north: float, bbox: str = "bbox") -> DataFrame:
    """Rows whose bbox struct overlaps; nested comparisons that prune Parquet row groups."""
    b = lambda f: F.col(f"{bbox}.{f}")
    return df.where((b("xmin") <= east) & (b("xmax") >= west) & (b("ymin") <= north) & (b("ymax") >= south))


def footprint_list(spark: SparkSession, path: str, bbox: tuple[float, float, float, float] | None = None) -> DataFrame:
    """Typed, headerless CSV, gzip allowed (one task per gzip file: repartition before heavy work)."""
    df = spark.read.schema(FOOTPRINT_LIST).option("header", False).option("quote", '"').csv(path)
    if bbox:
        w, s, e, n = bbox
        df = df.where(F.col("longitude").between(w, e) & F.col("latitude").between(s, n))
    return df


@F.pandas_udf(T.BinaryType())
def wkt_to_wkb(text: pd.Series) -> pd.Series:
    return text.map(lambda t: write_wkb(p) if t and (p := read_wkt(t)) else None)


@F.pandas_udf(T.StructType([*(T.StructField(n, T.DoubleType()) for n in ("area", "cx", "cy", "x0", "y0", "x1", "y1")), T.StructField("pieces", T.IntegerType())]))
def metrics(wkb: pd.Series) -> pd.DataFrame:
    """Planar area, centroid, extent and number of polygons."""
    rows = []
    for raw in wkb:
        found = read_wkb(raw) if raw else []
        c = polygons_centroid(found) if found else None
        if c is None:
            rows.append((None,) * 7 + (len(found),))
            continue
        pts = np.concatenate([p[0] for p in found])
        rows.append((sum(map(polygon_area, found)), *c, *pts.min(0), *pts.max(0), len(found)))
    return pd.DataFrame(rows, columns=["area", "cx", "cy", "x0", "y0", "x1", "y1", "pieces"])


def guess_geometry(schema: T.StructType) -> str | None:
    """The first column with a usual name and a binary or text type."""
    named = {f.name.lower(): f for f in schema}
    return next((named[n].name for n in GEOMETRY_NAMES if n in named and isinstance(named[n].dataType, (T.BinaryType, T.StringType))), None)


def _position_rings(geometry: dict) -> list:
    if geometry.get("type") == "Polygon":
        return [geometry["coordinates"]]
    if geometry.get("type") == "MultiPolygon":
        return geometry["coordinates"]
    return []


@F.pandas_udf(T.BinaryType())
def geojson_to_wkb(text: pd.Series) -> pd.Series:
    def one(t):
        rings = [[np.array(r, float)[:-1, :2] for r in p] for p in _position_rings(json.loads(t))] if t else []
        return write_wkb(rings) if rings else None

    return text.map(one)


def geojson(spark: SparkSession, path: str, lines: bool = False) -> DataFrame:
    """Features of a collection (or one per line): properties as a map of texts, geometry as WKB."""
    text = spark.read.text(path, wholetext=not lines).where("value <> ''")
    one = "struct<geometry:string,properties:map<string,string>>"
    if lines:
        rows = text.select(F.from_json("value", one).alias("f"))
    else:
        rows = text.select(F.explode(F.from_json("value", f"struct<features:array<{one}>>")["features"]).alias("f"))
    return rows.select("f.properties", geojson_to_wkb("f.geometry").alias("geometry"))


OVERPASS = (
    "struct<osm3s:struct<timestamp_osm_base:string>,elements:array<struct<type:string,id:bigint,version:int,timestamp:string,tags:map<string,string>,"
    "geometry:array<struct<lat:double,lon:double>>,members:array<struct<type:string,role:string,geometry:array<struct<lat:double,lon:double>>>>>>>"
)


@F.pandas_udf(T.BinaryType())
def assembled(kind: pd.Series, geometry: pd.Series, members: pd.Series) -> pd.Series:
    """A closed way, or the closed rings of a multipolygon relation with their holes; null without a closed outer ring."""
    points = lambda g: [(p["lon"], p["lat"]) for p in g if p is not None]

    def one(k, g, m):
        if k == "way":
            way = points(g) if g is not None else []
            return write_wkb([[np.array(way[:-1])]]) if is_closed(way) else None
        if m is None:
            return None
        ways = {role: [points(x["geometry"]) for x in m if x["geometry"] is not None and (x["role"] == "inner") == (role == "inner")] for role in ("outer", "inner")}
        (outer, _), (inner, _) = stitch(ways["outer"]), stitch(ways["inner"])
        found = polygons(outer, inner)
        return write_wkb(found) if found else None

    return pd.Series([one(*r) for r in zip(kind, geometry, members)])


def overpass(spark: SparkSession, path: str) -> DataFrame:
    """id (`way/12`), version, timestamp, tags, geometry of an answer; each id once, the newest version."""
    rows = spark.read.text(path, wholetext=True).select(F.explode(F.from_json("value", OVERPASS)["elements"]).alias("e")).select("e.*")
    rows = rows.where(F.col("type").isin("way", "relation")).withColumn("wkb", assembled("type", F.transform("geometry", lambda p: p), F.col("members")))
    best = F.max_by(F.struct("version", "timestamp", "tags", "wkb"), F.coalesce("version", F.lit(0))).alias("r")
    out = rows.groupBy(F.concat_ws("/", "type", F.col("id").cast("string")).alias("id")).agg(best)
    return out.select("id", "r.version", "r.timestamp", "r.tags", F.col("r.wkb").alias("geometry"))


class GeoPackageReader(DataSourceReader):
    """Row ranges of one layer; each task opens the file read-only."""

    def __init__(self, options: dict, schema: T.StructType):
        self.path, self.layer, self.schema = options["path"], options["layer"], schema
        self.step = int(options.get("rows", 100_000))

    def partitions(self):
        with sqlite3.connect(f"file:{self.path}?mode=ro", uri=True) as con:
            low, high = con.execute(f'SELECT coalesce(min(rowid), 0), coalesce(max(rowid), -1) FROM "{self.layer}"').fetchone()
        return [InputPartition((a, min(a + self.step - 1, high))) for a in range(low, high + 1, self.step)]

    def read(self, partition) -> Iterator[tuple]:
        names = ", ".join(f'"{f.name}"' for f in self.schema)
        binary = [isinstance(f.dataType, T.BinaryType) for f in self.schema]
        with sqlite3.connect(f"file:{self.path}?mode=ro", uri=True) as con:
            for row in con.execute(f'SELECT {names} FROM "{self.layer}" WHERE rowid BETWEEN ? AND ?', partition.value):
                yield tuple(strip_header(v) if b and isinstance(v, bytes) and v[:2] == b"GP" else v for v, b in zip(row, binary))


class GeoPackage(DataSource):
    """spark.read.format("cadastra_gpkg").option("path", ...).option("layer", ...)."""

    @classmethod
    def name(cls) -> str:
        return "cadastra_gpkg"

    def schema(self) -> T.StructType:
        kinds = {"INTEGER": T.LongType(), "REAL": T.DoubleType(), "DOUBLE": T.DoubleType(), "BLOB": T.BinaryType(), "BOOLEAN": T.LongType(), "GEOMETRY": T.BinaryType(), "POLYGON": T.BinaryType(), "MULTIPOLYGON": T.BinaryType(), "POINT": T.BinaryType()}
        with sqlite3.connect(f"file:{self.options['path']}?mode=ro", uri=True) as con:
            columns = con.execute(f'PRAGMA table_info("{self.options["layer"]}")').fetchall()
        return T.StructType([T.StructField(c[1], kinds.get(c[2].upper().split("(")[0], T.StringType())) for c in columns])

    def reader(self, schema: T.StructType) -> GeoPackageReader:
        return GeoPackageReader(dict(self.options), schema)


def strip_header(blob: bytes) -> bytes:
    """The WKB of a GeoPackage geometry."""
    return blob[8 + {0: 0, 1: 32, 2: 48, 3: 48, 4: 64}[(blob[3] >> 1) & 7] :]


def envelope(blob: bytes) -> tuple[float, float, float, float] | None:
    """(x0, x1, y0, y1) of a GeoPackage geometry's header, where it has one."""
    if not (blob[3] >> 1) & 7:
        return None
    return struct.unpack_from(("<" if blob[3] & 1 else ">") + "4d", blob, 8)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(GeoPackage)


def sheets(path: str) -> list[str]:
    with zipfile.ZipFile(path) as z:
        return [e.attrib["name"] for e in ElementTree.fromstring(z.read("xl/workbook.xml")).iter() if e.tag.endswith("}sheet")]


def sheet_rows(path: str, sheet: int = 1, limit: int | None = None) -> list[tuple[int, list[str]]]:
    """(row number, cells as text) of a workbook's sheet; empty rows are left out."""
    tag = lambda e, n: e.tag.endswith("}" + n)
    with zipfile.ZipFile(path) as z:
        shared = []
        if "xl/sharedStrings.xml" in z.namelist():
            for si in ElementTree.fromstring(z.read("xl/sharedStrings.xml")):
                shared.append("".join(t.text or "" for t in si.iter() if tag(t, "t")))
        out = []
        for row in ElementTree.fromstring(z.read(f"xl/worksheets/sheet{sheet}.xml")).iter():
            if not tag(row, "row"):
                continue
            cells: list[str] = []
            for c in row:
                at = 0
                for ch in re.match("[A-Z]+", c.attrib["r"])[0]:
                    at = at * 26 + ord(ch) - 64
                value = next((v.text or "" for v in c.iter() if tag(v, "v")), "")
                if c.attrib.get("t") == "s" and value:
                    value = shared[int(value)]
                elif c.attrib.get("t") == "inlineStr":
                    value = "".join(v.text or "" for v in c.iter() if tag(v, "t"))
                cells += [""] * (at - 1 - len(cells)) + [value]
            if any(cells):
                out.append((int(row.attrib["r"]), cells))
            if limit and len(out) >= limit:
                break
        return out


def newest_release(names: list[str]) -> str | None:
    """Of `YYYY-MM-DD.N` the latest, N compared as a number."""
    parts = [(m[1], int(m[2]), n.strip("/")) for n in names if (m := re.fullmatch(r"(\d{4}-\d{2}-\d{2})\.(\d+)", n.strip("/")))]
    return max(parts)[2] if parts else None


def newest_covering(snapshots: DataFrame, west: float, south: float, east: float, north: float) -> DataFrame:
    """The newest snapshot (created, west, south, east, north) that covers a box; of equal age the smallest, then the westernmost."""
    covers = (F.col("west") <= west) & (F.col("south") <= south) & (F.col("east") >= east) & (F.col("north") >= north)
    return snapshots.where(covers).orderBy(F.col("created").desc(), (F.col("east") - F.col("west")) * (F.col("north") - F.col("south")), "west", "south", "east", "north").limit(1)


def resolved(df: DataFrame, wanted: dict[str, tuple[str, ...]], required: tuple[str, ...] = ()) -> DataFrame:
    """Columns by their wanted names, each from the first of its candidates that df has, whatever its case.

    One without a candidate is null, or an error if it is required.
    """
    have = {c.lower(): c for c in reversed(df.columns)}
    found = {name: next((have[c.lower()] for c in candidates if c.lower() in have), None) for name, candidates in wanted.items()}
    absent = [name for name in required if found.get(name) is None]
    if absent:
        raise ValueError(f"no column for {', '.join(absent)}")
    return df.select(*[(F.col(f"`{c}`") if c else F.lit(None)).alias(name) for name, c in found.items()])


def places(df: DataFrame, required: tuple[str, ...] = ("id", "category", "lon", "lat"), deleted: str | None = None) -> DataFrame:
    """Points of interest with their required columns set, without those marked as deleted (an unset mark is none)."""
    absent = [c for c in (*required, *([deleted] if deleted else [])) if c not in df.columns]
    if absent:
        raise ValueError(f"no column {', '.join(absent)}")
    out = df.dropna(subset=list(required))
    return out.where(~F.coalesce(F.col(deleted).try_cast("boolean"), F.lit(False))) if deleted else out
