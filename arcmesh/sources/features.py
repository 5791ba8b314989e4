"""Inputs of every kind to one table of features.

A feature row has its layer, its number there, id, type, properties (JSON, untouched) and geometry
(GeoJSON text). Python inputs are normalised on the driver, since that is where they are; tables and files
never leave Spark.
"""

from __future__ import annotations

import json
from collections.abc import Iterable, Mapping
from typing import Any

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

GEOMETRIES = ("Point", "MultiPoint", "LineString", "MultiLineString", "Polygon", "MultiPolygon", "GeometryCollection")
COLUMNS = "layer int, fid long, id string, id_is_int boolean, type string, properties string, geometry string"


def plain(x: Any) -> Any:
    """Tuples, arrays and objects with a __geo_interface__ as JSON values."""
    if hasattr(x, "__geo_interface__"):
        x = x.__geo_interface__
    if isinstance(x, Mapping):
        return {str(k): plain(v) for k, v in x.items()}
    if isinstance(x, (list, tuple)):
        return [plain(v) for v in x]
    if hasattr(x, "tolist"):
        return x.tolist()
    return x


def crosses_itself(ring: list) -> bool:
    """Whether two segments of a ring properly cross."""
    p = np.array([v[:2] for v in ring], float)
    a, b = p[:-1], p[1:]
    side = lambda o, q, v: np.sign((q[:, 0] - o[:, 0]) * (v[1] - o[:, 1]) - (q[:, 1] - o[:, 1]) * (v[0] - o[:, 0]))
    for u, v in zip(a, b, strict=True):
        apart = np.flatnonzero(side(a, b, u) * side(a, b, v) < 0)
        if len(apart):
            w = v - u
            cut = lambda q: np.sign(w[0] * (q[:, 1] - u[1]) - w[1] * (q[:, 0] - u[0]))
            if (cut(a[apart]) * cut(b[apart]) < 0).any():
                return True
    return False


def valid(geometry: dict | None) -> bool:
    """Whether a geometry given as a dict can take part: known type, and rings that are closed, have four
    points and an area and don't cross themselves."""
    if not isinstance(geometry, dict) or geometry.get("type") not in GEOMETRIES:
        return False
    if geometry["type"] == "GeometryCollection":
        return all(valid(g) for g in geometry.get("geometries", []))
    rings = {"Polygon": [geometry.get("coordinates") or []], "MultiPolygon": geometry.get("coordinates") or []}.get(geometry["type"])
    if rings is None:
        return geometry.get("coordinates") is not None
    for ring in (r for polygon in rings for r in polygon):
        if len(ring) < 4 or list(ring[0]) != list(ring[-1]):
            return False
        if sum(a[0] * b[1] - b[0] * a[1] for a, b in zip(ring, ring[1:], strict=False)) == 0 or crosses_itself(ring):
            return False
    return True


def _feature(fid: int, key: Any, geometry: dict | None, properties: Any = None) -> dict:
    return {"fid": fid, "id": None if key is None else str(key), "id_is_int": isinstance(key, int) and not isinstance(key, bool), "type": (geometry or {}).get("type"), "properties": None if properties is None else json.dumps(properties), "geometry": None if geometry is None else json.dumps(geometry)}


def from_collection(data: dict, ignore_index: bool = False) -> list[dict]:
    """A FeatureCollection: own ids, else feature_<number>, zero-filled to the count's width. A falsy id
    counts as none; repeated ids are an error."""
    found = data.get("features", [])
    width, seen, out = len(str(len(found))), set(), []
    for i, f in enumerate(found):
        f = plain(f)
        key = None if ignore_index else f.get("id")
        key = key or f"feature_{str(i).zfill(width)}"
        if key in seen:
            raise IndexError(f"feature id {key!r} is there twice")
        seen.add(key)
        out.append(_feature(i, key, f.get("geometry"), f.get("properties")))
    return out


def from_items(items: Iterable[tuple[Any, Any]]) -> tuple[list[dict], int]:
    """Geometries by key; what is no valid geometry is left out. Gives the features and how many were."""
    out, lost = [], 0
    for key, value in items:
        geometry, properties = plain(value), None
        if isinstance(geometry, dict) and geometry.get("type") == "Feature":
            properties, geometry = geometry.get("properties"), geometry.get("geometry")
        elif isinstance(geometry, dict) and geometry.get("type") not in GEOMETRIES and "geometry" in geometry:
            properties = {k: v for k, v in geometry.items() if k != "geometry"}
            geometry = plain(geometry["geometry"])
        if isinstance(geometry, dict) and str(geometry.get("type", "")).lower() == "featurecollection":
            geometry = {"type": "GeometryCollection", "geometries": [plain(f)["geometry"] for f in geometry["features"]]}
        if valid(geometry):
            out.append(_feature(len(out), key, geometry, properties))
        else:
            lost += 1
    return out, lost


def normalise(data: Any, ignore_index: bool = False) -> tuple[list[dict], int]:
    """One layer's features and how many were invalid, from whatever a caller has: a collection, feature
    or geometry, as a dict, JSON text or an object with a __geo_interface__; a list; a dict of geometries."""
    if isinstance(data, str):
        data = json.loads(data)
    data = plain(data)
    if isinstance(data, list):
        return from_items(enumerate(data))
    if isinstance(data, Iterable) and not isinstance(data, dict):  # an open collection of features, or any other source of them
        data = {"type": "FeatureCollection", "features": [plain(f) for f in data]}
    if not isinstance(data, dict):
        raise TypeError(f"no geometry can be read from {type(data).__name__}")
    kind = str(data.get("type", "")).lower()
    if kind == "featurecollection":
        return from_collection(data, ignore_index), 0
    if kind == "feature":
        return from_items([("feature_0" if ignore_index or not data.get("id") else data["id"], data)])
    if data.get("type") in GEOMETRIES:
        return [_feature(0, 0, data)], 0
    return from_items(data.items())


def local(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    """A table of driver rows that needs no Python task to be read."""
    import pyarrow as pa
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    arrow = to_arrow_schema(StructType.fromDDL(schema))
    cols = list(zip(*rows, strict=True)) if rows else [()] * len(arrow)
    return spark.createDataFrame(pa.table([pa.array(list(c), f.type) for c, f in zip(cols, arrow, strict=True)], schema=arrow), schema=schema)


def table(spark: SparkSession, layers: list[list[dict]]) -> DataFrame:
    return local(spark, [(k, f["fid"], f["id"], f["id_is_int"], f["type"], f["properties"], f["geometry"]) for k, own in enumerate(layers) for f in own], COLUMNS)


def depth_of(layers: list[list[dict]]) -> int:
    """Levels of collections in features that the driver holds."""
    level = lambda g: 1 + max(map(level, g.get("geometries") or [{}])) if g.get("type") == "GeometryCollection" else 0
    return max((level(json.loads(f["geometry"])) for own in layers for f in own if f["type"] == "GeometryCollection" and f["geometry"]), default=0)


#: Members that a geometry object has itself (fixed values).
RESERVED = ("type", "bbox", "coordinates", "geometries", "geometry", "properties", "features", "arcs")


def properties_foreign(objects: list[dict]) -> list[dict]:
    """objects with their properties as members of their own, in place; if any property has the name of a
    reserved member, all stay where they are."""
    if not any(k in RESERVED for o in objects for k in o.get("properties") or {}):
        for o in objects:
            o.update(o.pop("properties", None) or {})
    return objects


def crs_of(df: DataFrame, geometry: str = "geometry") -> str | None:
    """The coordinate reference system in the metadata of a table's geometry column."""
    return df.schema[geometry].metadata.get("crs") if geometry in df.columns else None


def from_table(df: DataFrame, geometry: str = "geometry", id_col: str | None = None, layer: int = 0, crs: str | None = None) -> DataFrame:
    """Features of a table with a column of GeoJSON text, geometry structs or WKB; the other columns become
    properties. Numbers follow id_col, else the rows' order. crs: as given or as in the column's metadata."""
    from arcmesh.operators.ids import dense_ids
    from arcmesh.sources.wkb import from_wkb

    crs = crs or crs_of(df, geometry)
    if dict(df.dtypes)[geometry] == "binary":
        df = from_wkb(df, geometry)
    kind = dict(df.dtypes)[geometry]
    text = F.col(geometry) if kind == "string" else F.to_json(F.col(geometry))
    others = [c for c in df.columns if c not in (geometry, id_col)]
    own = df.select(F.col(id_col).cast("string").alias("id") if id_col else F.lit(None).cast("string").alias("id"), F.to_json(F.struct(*others), {"ignoreNullFields": "false"}).alias("properties") if others else F.lit(None).cast("string").alias("properties"), text.alias("geometry"), F.col(id_col).alias("_o") if id_col else F.monotonically_increasing_id().alias("_o"))
    placed = dense_ids(own, ["_o"], "fid")
    integers = id_col is None or dict(df.dtypes)[id_col] in ("int", "bigint", "smallint", "tinyint")
    out = placed.select(F.lit(layer).alias("layer"), "fid", F.coalesce("id", F.col("fid").cast("string")).alias("id"), F.lit(integers).alias("id_is_int"), F.get_json_object("geometry", "$.type").alias("type"), "properties", "geometry")
    return out.withMetadata("geometry", {"crs": crs}) if crs else out


def drop_invalid(features: DataFrame) -> DataFrame:
    """features without those whose geometry has an invalid line or ring (see validity.invalid_rings) or is
    of no known type; what `valid` does to geometries that the driver holds."""
    from arcmesh.operators.validity import invalid_rings

    ids = F.concat_ws(":", "layer", "fid", F.concat_ws(".", "geom_path"), "part_idx", "ring_idx")
    own = lines(leaves(features)).select("layer", "fid", ids.alias("ring_id"), "pts", F.col("geom_type").isin("Polygon", "MultiPolygon").alias("is_ring"))
    bad = own.join(invalid_rings(own.select("ring_id", "pts", "is_ring")), "ring_id").select("layer", "fid").distinct()
    return features.filter(F.col("type").isin(*GEOMETRIES)).join(bad, ["layer", "fid"], "left_anti")


def repeated_ids(features: DataFrame) -> DataFrame:
    """layer, id, n: ids that several features have, by a grouped count."""
    return features.groupBy("layer", "id").agg(F.count("*").alias("n")).filter("n > 1")


FEATURE = "struct<type:string,id:string,properties:string,geometry:string>"


def read_geojson(spark: SparkSession, path: str, ignore_index: bool = False, layer: int = 0, by_line: bool | None = None) -> DataFrame:
    """Features of GeoJSON files: one feature per line (by_line), which Spark splits however large a file
    is, or one FeatureCollection per file, which is one value. None: as the first line of the first file
    has it. Ids as for a collection; repeated ids are an error."""
    from arcmesh.operators.ids import dense_ids

    if by_line is None:
        head = spark.read.text(path).filter("trim(value) <> ''").limit(1).select(F.get_json_object("value", "$.type").alias("t")).first()
        by_line = head is not None and str(head.t).lower() == "feature"
    if by_line:
        own = spark.read.text(path).filter("trim(value) <> ''").select(F.from_json("value", FEATURE).alias("f"))
    else:
        own = spark.read.text(path, wholetext=True).select(F.from_json("value", f"struct<type:string,features:array<{FEATURE}>>").alias("c")).select(F.explode("c.features").alias("f"))
    rows = dense_ids(own.withColumn("_o", F.monotonically_increasing_id()), ["_o"], "fid")
    n = rows.count()
    made = F.concat(F.lit("feature_"), F.lpad(F.col("fid").cast("string"), len(str(n)), "0"))
    given = F.when(F.col("f.id").isNotNull() & ~F.col("f.id").isin("", "0"), F.col("f.id"))
    out = rows.select(F.lit(layer).alias("layer"), "fid", (made if ignore_index else F.coalesce(given, made)).alias("id"), F.lit(False).alias("id_is_int"), F.get_json_object("f.geometry", "$.type").alias("type"), F.col("f.properties").alias("properties"), F.col("f.geometry").alias("geometry"))
    twice = repeated_ids(out).limit(1).collect()
    if twice:
        raise IndexError(f"feature id {twice[0].id!r} is there twice")
    return out


def leaves(features: DataFrame, depth: int = 2) -> DataFrame:
    """layer, fid, geom_path, geom_type, geometry: collections opened, down to `depth` levels."""
    now = features.select("layer", "fid", F.array().cast("array<int>").alias("geom_path"), F.col("type").alias("geom_type"), "geometry")
    out = now.filter("geom_type <> 'GeometryCollection'")
    for _ in range(depth):
        inner = now.filter("geom_type = 'GeometryCollection'").select("layer", "fid", "geom_path", F.posexplode(F.from_json(F.get_json_object("geometry", "$.geometries"), "array<string>")).alias("i", "geometry"))
        now = inner.select("layer", "fid", F.concat("geom_path", F.array("i")).alias("geom_path"), F.get_json_object("geometry", "$.type").alias("geom_type"), "geometry")
        out = out.union(now.filter("geom_type <> 'GeometryCollection'"))
    return out


def lines(leaf: DataFrame) -> DataFrame:
    """layer, fid, geom_path, geom_type, part_idx, ring_idx, pts of every line and ring that has points."""
    keep = ["layer", "fid", "geom_path", "geom_type"]
    four, three = "array<array<array<array<double>>>>", "array<array<array<double>>>"
    c = F.get_json_object("geometry", "$.coordinates")
    # every kind as parts of rings of points
    parts = (
        F.when(F.col("geom_type") == "MultiPolygon", F.from_json(c, four))
        .when(F.col("geom_type") == "Polygon", F.array(F.from_json(c, three)))
        .when(F.col("geom_type") == "MultiLineString", F.transform(F.from_json(c, three), lambda v: F.array(v)))
        .when(F.col("geom_type") == "LineString", F.from_json(F.concat(F.lit("[["), c, F.lit("]]")), four))
    )
    own = leaf.filter(F.col("geom_type").isin("LineString", "MultiLineString", "Polygon", "MultiPolygon")).select(*keep, F.posexplode(parts).alias("part_idx", "p")).select(*keep, "part_idx", F.posexplode("p").alias("ring_idx", "c"))
    return own.filter("size(c) > 0").select(*keep, "part_idx", "ring_idx", F.transform("c", lambda v: F.struct(v[0].alias("x"), v[1].alias("y"))).alias("pts"))


def points(leaf: DataFrame) -> DataFrame:
    """layer, fid, geom_path, geom_type, part_idx, x, y of every point."""
    keep = ["layer", "fid", "geom_path", "geom_type"]
    c = F.get_json_object("geometry", "$.coordinates")
    own = F.from_json(F.when(F.col("geom_type") == "Point", F.concat(F.lit("["), c, F.lit("]"))).otherwise(c), "array<array<double>>")
    dots = leaf.filter(F.col("geom_type").isin("Point", "MultiPoint")).select(*keep, F.posexplode(own).alias("part_idx", "p"))
    return dots.filter("size(p) > 1").select(*keep, "part_idx", F.col("p")[0].alias("x"), F.col("p")[1].alias("y"))
