"""The whole plan: features to shared arcs and signed references, and back.

A Topology is immutable: its tables are lazy plans, kept once they are needed, and every operation gives
a new one. Tables: features, rings (one row per line or ring), refs (ring_id, seq, arc_id, signed_ref),
arcs (arc_id, pts in grid or plain coordinates), points. Delta encoding is applied where JSON is written.
"""

from __future__ import annotations

import json
from collections.abc import Callable
from functools import cached_property
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from arcmesh.functions import geom
from arcmesh.operators import cut, decode, dedup, junctions, quantize, simplify
from arcmesh.operators.ids import dense_ids
from arcmesh.operators.lines import collected, vertices
from arcmesh.operators.tables import settled
from arcmesh.options import TopologyOptions, epsilon, quantum
from arcmesh.sources import features as sources

Transform = tuple[float, float, float, float]
STAGES = ("extract", "join", "cut", "dedup", "hashmap", "topology")


def _box(lines: DataFrame, points: DataFrame) -> tuple[float, float, float, float] | None:
    b = quantize.bbox(lines.select(F.explode("pts").alias("p")).select("p.x", "p.y"), points.select("x", "y")).first()
    return None if b is None or b.x0 is None else (b.x0, b.y0, b.x1, b.y1)


def _steps(box: tuple[float, float, float, float], q: float) -> Transform:
    kx, ky = ((b - a) / (q - 1) if b != a else 1.0 for a, b in ((box[0], box[2]), (box[1], box[3])))
    return box[0], box[1], kx, ky


class Topology:
    def __init__(self, data: Any = None, spark: SparkSession | None = None, options: TopologyOptions | None = None, crs: str | None = None, **own):
        """data: anything sources.normalise() takes, a list of such layers if object_name is a list, a
        Spark table of features (see sources.from_table and read_geojson), or encoded topology JSON.
        crs is carried to to_dataframe(); a table of features brings its own."""
        self.options = options or TopologyOptions(**own)
        self.spark = spark or SparkSession.getActiveSession() or SparkSession.builder.getOrCreate()
        self.invalid = 0
        self._depth = 2  # levels of collections that a table may hold
        self._encoded: dict | None = None
        tables = [x for x in (data if isinstance(data, list) else [data]) if isinstance(x, DataFrame)]
        self.crs = crs or next((c for x in tables if (c := sources.crs_of(x))), None)
        if isinstance(data, str):
            data = json.loads(data)
        if isinstance(data, dict) and data.get("type") == "Topology":
            self._load(data)
        elif data is not None:
            self.features = self._read(data)

    # ---- reading

    def _read(self, data: Any) -> DataFrame:
        names = self.options.names
        if isinstance(data, DataFrame):
            return data
        if len(names) == 1:
            layers = [data]
        elif not isinstance(data, list) or len(data) != len(names):
            raise LookupError(f"{len(names)} object names need as many layers")
        else:
            layers = data
        if any(isinstance(x, DataFrame) for x in layers):
            tables = [x.withColumn("layer", F.lit(i)) if isinstance(x, DataFrame) else sources.table(self.spark, [[]] * i + [self._layer(x)]) for i, x in enumerate(layers)]
            out = tables[0]
            for t in tables[1:]:
                out = out.unionByName(t)
            return out
        own = [self._layer(x) for x in layers]
        self._depth = sources.depth_of(own)
        return sources.table(self.spark, own)

    def _layer(self, x: Any) -> list[dict]:
        if isinstance(x, str):
            x = json.loads(x)
        if isinstance(x, dict) and x.get("type") == "Topology":
            x = json.loads(Topology(x, self.spark).to_geojson())
        found, lost = sources.normalise(x, self.options.ignore_index)
        self.invalid += lost
        return found

    def _load(self, doc: dict) -> None:
        """Encoded input: arcs, references and features as they are; nothing is computed again."""
        names = list(doc["objects"])
        self.options = self.options.changed(prequantize=False, presimplify=False, object_name=names)
        t = doc.get("transform")
        plain, arcs = [], []
        for k, arc in enumerate(doc["arcs"]):
            x = y = 0
            pts = []
            for p in arc:
                x, y = (x + p[0], y + p[1]) if t else (p[0], p[1])
                pts.append((float(x), float(y)))
            if t:
                pts = [(px * t["scale"][0] + t["translate"][0], py * t["scale"][1] + t["translate"][1]) for px, py in pts]
            arcs.append((k, pts))
        rows, rings, refs, points = [], [], [], []

        def walk(layer: int, fid: int, g: dict, path: list[int]) -> dict:
            kind = g["type"]
            if kind == "GeometryCollection":
                return {"type": kind, "geometries": [walk(layer, fid, x, [*path, i]) for i, x in enumerate(g.get("geometries", []))]}
            if kind in ("Point", "MultiPoint"):
                for i, p in enumerate([g["coordinates"]] if kind == "Point" else g["coordinates"]):
                    xy = [p[j] * t["scale"][j] + t["translate"][j] if t else p[j] for j in (0, 1)]
                    points.append((layer, fid, path, kind, i, float(xy[0]), float(xy[1])))
            else:
                own = g.get("arcs") or []
                parts = {"LineString": [[own]] if own else [], "MultiLineString": [[x] for x in own], "Polygon": [own], "MultiPolygon": own}[kind]
                for i, part in enumerate(parts):
                    for j, ids in enumerate(part):
                        rings.append((len(rings), layer, fid, path, i, j, kind))
                        refs.extend((len(rings) - 1, s, v if v >= 0 else -v - 1, v) for s, v in enumerate(ids))
            return {"type": kind}

        for layer, name in enumerate(names):
            top = doc["objects"][name]
            for fid, g in enumerate(top["geometries"] if top["type"] == "GeometryCollection" else [top]):
                key = g.get("id", fid)
                rows.append((layer, fid, str(key), isinstance(key, int), g["type"], json.dumps(g["properties"]) if g.get("properties") is not None else None, json.dumps(walk(layer, fid, g, []))))
        make = lambda own, schema: sources.local(self.spark, own, schema)
        self._depth = sources.depth_of([[{"geometry": r[6], "type": r[4]} for r in rows]])
        self.features = make(rows, sources.COLUMNS)
        self.__dict__["rings"] = make(rings, "ring_id long, layer int, fid long, geom_path array<int>, part_idx int, ring_idx int, geom_type string").withColumn("is_ring", F.col("geom_type").isin("Polygon", "MultiPolygon"))
        self.__dict__["refs"] = make(refs, "ring_id long, seq int, arc_id long, signed_ref long")
        self.__dict__["points"] = make(points, "layer int, fid long, geom_path array<int>, geom_type string, part_idx int, x double, y double")
        plain_arcs = make([(k, [{"x": x, "y": y} for x, y in pts]) for k, pts in arcs], "arc_id long, pts array<struct<x:double,y:double>>")
        self._encoded = {"arcs": plain_arcs, "bbox": tuple(doc["bbox"]) if doc.get("bbox") else _box(plain_arcs, self.points)}

    # ---- stages

    @cached_property
    def _lines(self) -> DataFrame:
        """Every line and ring with its points and number, wound and simplified beforehand."""
        own = sources.lines(sources.leaves(self.features, self._depth)).withColumn("is_ring", F.col("geom_type").isin("Polygon", "MultiPolygon"))
        if self.options.winding_order:
            own = own.withColumn("pts", F.when(F.col("is_ring"), geom.ring_winding("pts", F.col("ring_idx") == 0, self.options.winding_order)).otherwise(F.col("pts")))
        own = dense_ids(own, ["layer", "fid", "geom_path", "part_idx", "ring_idx"], "ring_id")
        if e := epsilon(self.options.presimplify, 1.0):
            own = simplify.simplify(own, e, *simplify.chosen(self.options.simplify_with, self.options.simplify_algorithm, self.options.prevent_oversimplify))
        return settled(own)

    @cached_property
    def rings(self) -> DataFrame:
        return self._lines.drop("pts")

    @cached_property
    def _plain_points(self) -> DataFrame:
        return sources.points(sources.leaves(self.features, self._depth))

    @cached_property
    def bbox(self) -> tuple[float, float, float, float] | None:
        if self._encoded is not None:
            return self._encoded["bbox"]
        return _box(self._lines, self._plain_points)

    @cached_property
    def grid(self) -> Transform | None:
        """The grid that lines are put on before junctions are looked for."""
        q = quantum(self.options.prequantize)
        return _steps(self.bbox, q) if q and self.bbox and self._encoded is None else None

    @cached_property
    def _grid_lines(self) -> DataFrame:
        return quantize.quantize(self._lines, self.grid) if self.grid else self._lines

    @cached_property
    def points(self) -> DataFrame:
        return quantize.quantize_xy(self._plain_points, self.grid) if self.grid else self._plain_points

    @cached_property
    def _vertices(self) -> DataFrame:
        return settled(vertices(self._grid_lines.select("ring_id", "is_ring", "pts")).select("ring_id", "pos", "x", "y", "is_ring"))

    @cached_property
    def _cell(self) -> float:
        return junctions.default_cell(self._vertices)

    @cached_property
    def junctions(self) -> DataFrame:
        v = self._vertices
        if not self.options.topology:
            return v.select("x", "y").limit(0)
        if self.options.shared_coords:
            return settled(junctions.coords_connected(v))
        got = v.agg(F.max(F.expr("greatest(abs(x), abs(y))")).alias("far"), F.coalesce(F.bool_and(F.expr("x = rint(x) and y = rint(y)")), F.lit(True)).alias("whole")).first()
        whole = self.grid is not None or (got.whole and (got.far or 0) < 2**53)
        return settled(junctions.path_connected(v, self._cell, whole, whole and (got.far or 0) > junctions.EXACT))

    @cached_property
    def slots(self) -> DataFrame:
        own = collected(self._vertices, ["ring_id", "is_ring"])
        return settled(cut.cut_lines(own, self.junctions, self._cell if self.options.topology and not self.options.shared_coords else None))

    @cached_property
    def _coded(self) -> tuple[DataFrame, DataFrame]:
        own = settled(dedup.merge_contiguous(self.slots)) if self.options.topology else self.slots
        arcs, refs = dedup.arcs_and_refs(own)
        return settled(arcs), settled(refs)

    @cached_property
    def shared_arcs(self) -> DataFrame:
        return self._coded[0].filter("is_shared").select("arc_id")

    @cached_property
    def refs(self) -> DataFrame:
        return self._coded[1]

    @cached_property
    def arcs(self) -> DataFrame:
        """arc_id, pts: absolute, on the grid if there is one, after the options' last steps."""
        return self._final[0]

    @cached_property
    def transform(self) -> Transform | None:
        return self._final[1]

    @cached_property
    def final_bbox(self) -> tuple[float, float, float, float] | None:
        return self._final[2]

    @cached_property
    def _point_steps(self) -> DataFrame:
        return self._final[3]

    @cached_property
    def _final(self) -> tuple:
        now = (self._encoded["arcs"] if self._encoded is not None else self._coded[0].select("arc_id", "pts"), self.grid, self.bbox, self.points)
        if e := epsilon(self.options.toposimplify, 1e-4):
            now = self._simplified(now, e, *simplify.chosen(self.options.simplify_with, self.options.simplify_algorithm, self.options.prevent_oversimplify), quantum(self.options.topoquantize) or quantum(self.options.prequantize))
        if q := quantum(self.options.topoquantize):
            now = self._quantized(now, q)
        return now

    @staticmethod
    def _plain(now: tuple) -> tuple[DataFrame, DataFrame]:
        arcs, t, _, points = now
        if not t:
            return arcs, points
        return quantize.dequantize(arcs, t), points.withColumn("x", F.col("x") * t[2] + t[0]).withColumn("y", F.col("y") * t[3] + t[1])

    def _quantized(self, now: tuple, q: float) -> tuple:
        arcs, points = self._plain(now)
        box = now[2]
        if box is None:
            return now
        t = _steps(box, q)
        return settled(quantize.quantize(arcs, t)), t, box, quantize.quantize_xy(points, t)

    def _simplified(self, now: tuple, e: float, algorithm: str, careful: bool, q: float) -> tuple:
        arcs, points = self._plain(now)
        arcs = settled(simplify.simplify(arcs, e, algorithm, careful))
        box = _box(arcs, points)
        if not q or not now[1] or box is None:
            return arcs, None, box, points
        t = _steps(box, q)
        return settled(quantize.quantize(arcs, t)), t, box, quantize.quantize_xy(points, t)

    def _after(self, final: tuple, options: TopologyOptions) -> Topology:
        out = Topology(spark=self.spark, options=options, crs=self.crs)
        for name in ("features", "rings", "refs", "_depth"):
            out.__dict__[name] = getattr(self, name)
        out.__dict__["_final"] = final
        return out

    def topoquantize(self, quant_factor: float) -> Topology:
        return self._after(self._quantized(self._final, quantum(quant_factor)), self.options.changed(topoquantize=quant_factor))

    def toposimplify(self, epsilon_: float, simplify_algorithm: str | None = None, prevent_oversimplify: bool | None = None, simplify_with: str | None = None) -> Topology:
        careful = self.options.prevent_oversimplify if prevent_oversimplify is None else prevent_oversimplify
        algorithm, careful = simplify.chosen(simplify_with or self.options.simplify_with, simplify_algorithm or self.options.simplify_algorithm, careful)
        q = quantum(self.options.topoquantize) or quantum(self.options.prequantize)
        if not q and self.transform:
            q = 10.0 ** len(str(int((self.final_bbox[2] - self.final_bbox[0]) / self.transform[2])))
        return self._after(self._simplified(self._final, epsilon(epsilon_, 1e-4), algorithm, careful, q), self.options.changed(toposimplify=epsilon_))

    def stage(self, name: str) -> dict[str, Any]:
        """The tables of a stage, for inspection."""
        tables: dict[str, Callable[[], dict]] = {
            "extract": lambda: {"features": self.features, "lines": self._lines, "points": self._plain_points},
            "join": lambda: {"lines": self._grid_lines, "junctions": self.junctions, "bbox": self.bbox, "transform": self.grid},
            "cut": lambda: {"slots": self.slots, "duplicates": dedup.matched(self.slots).filter("keep.ring_id <> ring_id or keep.seq <> seq")},
            "dedup": lambda: {"arcs": self._coded[0], "shared": self.shared_arcs},
            "hashmap": lambda: {"arcs": self._coded[0], "refs": self.refs, "rings": self.rings},
            "topology": lambda: {"arcs": self.arcs, "refs": self.refs, "rings": self.rings, "points": self._point_steps},
        }
        return tables[name]()

    # ---- layers

    def _layer_number(self, object_name: str | int) -> int:
        names = self.options.names
        if isinstance(object_name, int):
            if not -len(names) <= object_name < len(names):
                raise IndexError(f"object {object_name} of {len(names)}")
            return object_name % len(names)
        if object_name not in names:
            raise LookupError(f"object {object_name!r} is none of {names}")
        return names.index(object_name)

    # ---- decoding

    def lines(self) -> DataFrame:
        """rings with their decoded points in plain coordinates."""
        arcs, _ = self._plain(self._final)
        return decode.padded(self.rings.join(decode.stitched(self.refs, arcs), "ring_id"))

    def to_dataframe(self, object_name: str | int = 0, winding_order: str | None = "CCW_CW", decimals: int | None = None, validate: bool = False, geometry: str = "geojson", crs: str | None = None) -> DataFrame:
        """id, properties, type and geometry (GeoJSON text, or WKB of geometry="wkb") of every feature of a
        layer; stays in Spark. validate leaves out features with an invalid ring. The crs, if there is one, is in
        the metadata of the geometry column."""
        layer = self._layer_number(object_name)
        own = self.lines().filter(F.col("layer") == layer)
        if decimals is not None:
            own = own.withColumn("pts", geom.round_points("pts", decimals))
        if winding_order:
            own = own.withColumn("pts", F.when(F.col("is_ring"), geom.ring_winding("pts", F.col("ring_idx") == 0, winding_order)).otherwise(F.col("pts")))
        pairs = lambda c: F.transform(c, lambda v: F.array(v["x"], v["y"]))
        parts = own.groupBy("fid", "geom_path", "geom_type", "part_idx").agg(F.transform(F.array_sort(F.collect_list(F.struct("ring_idx", pairs("pts").alias("c")))), lambda v: v["c"]).alias("rings"))
        whole = parts.groupBy("fid", "geom_path", "geom_type").agg(F.transform(F.array_sort(F.collect_list(F.struct("part_idx", "rings"))), lambda v: v["rings"]).alias("c"))
        flat = F.expr("case geom_type when 'MultiPolygon' then to_json(c) when 'Polygon' then to_json(c[0]) when 'MultiLineString' then to_json(transform(c, r -> r[0])) else to_json(c[0][0]) end")
        _, points = self._plain(self._final)
        dots = points.filter(F.col("layer") == layer).groupBy("fid", "geom_path", "geom_type").agg(F.transform(F.array_sort(F.collect_list(F.struct("part_idx", F.array("x", "y").alias("c")))), lambda v: v["c"]).alias("c"))
        dots = dots.select("fid", "geom_path", "geom_type", F.expr("if(geom_type = 'Point', to_json(c[0]), to_json(c))").alias("coords"))
        leaf = whole.select("fid", "geom_path", "geom_type", flat.alias("coords")).union(dots).select("fid", "geom_path", F.format_string('{"type":"%s","coordinates":%s}', "geom_type", "coords").alias("g"))
        # collections are put together from the deepest level up; each level is kept, as the next reads it twice
        for depth in range(self._depth, 0, -1):
            leaf = settled(leaf)
            deep = leaf.filter(F.size("geom_path") == depth)
            joined = deep.groupBy("fid", F.slice("geom_path", 1, depth - 1).alias("geom_path")).agg(F.concat_ws(",", F.transform(F.array_sort(F.collect_list(F.struct(F.element_at("geom_path", depth).alias("i"), "g"))), lambda v: v["g"])).alias("g"))
            leaf = leaf.filter(F.size("geom_path") < depth).union(joined.select("fid", "geom_path", F.format_string('{"type":"GeometryCollection","geometries":[%s]}', "g")))
        out = self.features.filter(F.col("layer") == layer).drop("geometry").join(leaf.select("fid", F.col("g").alias("geometry")), "fid", "left")
        if validate:
            from arcmesh.operators.validity import invalid_rings

            bad = own.join(invalid_rings(own.select("ring_id", "pts", "is_ring")), "ring_id").select("fid").distinct()
            out = out.join(bad, "fid", "left_anti")
        out = out.select("fid", "id", "id_is_int", "type", "properties", leaf_geometry(out))
        if geometry == "wkb":
            from arcmesh.sources.wkb import to_wkb

            out = to_wkb(out)
        if crs := crs or self.crs:
            out = out.withMetadata("geometry", {"crs": crs})
        return out

    def geojson_rows(self, **how) -> DataFrame:
        """value: a GeoJSON feature per row, for a text sink."""
        own = self.to_dataframe(**how)
        key = F.when(F.col("id_is_int"), F.col("id")).otherwise(F.regexp_extract(F.to_json(F.struct(F.col("id").alias("v"))), r'^\{"v":(.*)\}$', 1))
        return own.select("fid", F.format_string('{"type":"Feature","id":%s,"properties":%s,"geometry":%s}', key, F.coalesce("properties", F.lit("{}")), F.coalesce("geometry", F.lit("null"))).alias("value"))

    def write_geojson(self, path: str, **how) -> None:
        """Features as text files of a feature per line; nothing comes to the driver."""
        self.geojson_rows(**how).orderBy("fid").select("value").write.text(path)

    def write_tables(self, path: str) -> None:
        """features, rings, refs, arcs and points as Parquet, for topologies too large for one document."""
        for name, t in (("features", self.features), ("rings", self.rings), ("refs", self.refs), ("arcs", self.arcs), ("points", self._point_steps)):
            t.write.parquet(f"{path}/{name}")

    # ---- documents of the driver (small results)

    def to_geojson(self, fp: str | None = None, pretty: bool = False, indent: int = 4, **how) -> str | None:
        rows = self.geojson_rows(**how).orderBy("fid").collect()
        doc = {"type": "FeatureCollection", "features": [json.loads(r.value) for r in rows]}
        return _saved(json.dumps(doc, indent=indent if pretty else None), fp)

    @property
    def __geo_interface__(self) -> dict:
        return json.loads(self.to_geojson())

    def to_dict(self, options: bool = False, foreign: bool = False) -> dict:
        """The encoded document. foreign: properties become members of their objects, see
        sources.properties_foreign."""
        names, t = self.options.names, self.transform
        arcs = self.arcs.withColumn("pts", geom.delta_encode("pts")) if t else self.arcs
        number = (lambda v: int(v)) if t else (lambda v: v)
        out: dict[str, Any] = {"type": "Topology", "objects": {}, "bbox": self.final_bbox, "arcs": [[[number(p.x), number(p.y)] for p in r.pts] for r in arcs.orderBy("arc_id").collect()]}
        if t:
            out["transform"] = {"scale": [t[2], t[3]], "translate": [t[0], t[1]]}
        ids: dict[tuple, dict] = {}
        for r in self.rings.join(self.refs.groupBy("ring_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("seq", "signed_ref"))), lambda v: v["signed_ref"]).alias("ids")), "ring_id").collect():
            ids.setdefault((r.layer, r.fid, tuple(r.geom_path)), {}).setdefault(r.part_idx, {})[r.ring_idx] = r.ids
        dots: dict[tuple, dict] = {}
        for r in self._point_steps.collect():
            dots.setdefault((r.layer, r.fid, tuple(r.geom_path)), {})[r.part_idx] = [number(r.x), number(r.y)]

        def build(key: tuple, g: dict) -> dict:
            kind = g["type"]
            if kind == "GeometryCollection":
                return {"type": kind, "geometries": [build((*key[:2], (*key[2], i)), x) for i, x in enumerate(g.get("geometries", []))]}
            if kind in ("Point", "MultiPoint"):
                own = [v for _, v in sorted(dots.get(key, {}).items())]
                return {"type": kind, "coordinates": (own[0] if own else []) if kind == "Point" else own}
            parts = [[v for _, v in sorted(p.items())] for _, p in sorted(ids.get(key, {}).items())]
            if not parts:
                return {"type": kind, "arcs": None}
            shape = {"LineString": lambda: parts[0][0], "MultiLineString": lambda: [p[0] for p in parts], "Polygon": lambda: parts[0], "MultiPolygon": lambda: parts}
            return {"type": kind, "arcs": shape[kind]()}

        for layer, name in enumerate(names):
            out["objects"][name] = {"type": "GeometryCollection", "geometries": []}
        for f in self.features.orderBy("layer", "fid").collect():
            if f.geometry is None:
                continue
            g = build((f.layer, f.fid, ()), json.loads(f.geometry))
            if f.id is not None:
                g["id"] = int(f.id) if f.id_is_int else f.id
            if f.properties is not None:
                g["properties"] = json.loads(f.properties)
            out["objects"][names[f.layer]]["geometries"].append(g)
        if foreign:
            for o in out["objects"].values():
                sources.properties_foreign(o["geometries"])
        if options:
            out["options"] = self.options.to_dict()
        return out

    def to_json(self, fp: str | None = None, options: bool = False, pretty: bool = False, indent: int = 4) -> str | None:
        return _saved(json.dumps(self.to_dict(options), indent=indent if pretty else None), fp)

    def to_svg(self, separate: bool = False, include_junctions: bool = False) -> str:
        """The arcs as an SVG drawing, each in its own if separate."""
        arcs, _ = self._plain(self._final)
        paths = [" ".join(f"{p.x:g},{-p.y:g}" for p in r.pts) for r in arcs.orderBy("arc_id").collect()]
        x0, y0, x1, y1 = self.final_bbox or (0, 0, 1, 1)
        w, h = (x1 - x0) or 1, (y1 - y0) or 1
        dots = ""
        if include_junctions:
            t = self.grid or (0, 0, 1, 1)
            dots = "".join(f'<circle cx="{r.x * t[2] + t[0]:g}" cy="{-(r.y * t[3] + t[1]):g}" r="{max(w, h) / 100:g}"/>' for r in self.junctions.collect())
        open_ = f'<svg xmlns="http://www.w3.org/2000/svg" viewBox="{x0:g} {-y1:g} {w:g} {h:g}">'
        line = lambda p: f'<polyline points="{p}" fill="none" stroke="black" stroke-width="{max(w, h) / 300:g}"/>'
        if separate:
            return "\n".join(f"{open_}{line(p)}</svg>" for p in paths)
        return f"{open_}{''.join(map(line, paths))}{dots}</svg>"

    def to_chart(self, color: str | None = None, tooltip: bool = True, projection: str = "identity", object_name: str | int = 0) -> dict:
        """A Vega-Lite specification of a layer, as a dict."""
        values = json.loads(self.to_geojson(object_name=object_name))
        spec: dict[str, Any] = {"data": {"values": values, "format": {"property": "features"}}, "mark": {"type": "geoshape", "tooltip": {"content": "data"} if tooltip else None}, "projection": {"type": projection, "reflectY": projection == "identity"}}
        if color:
            field, _, kind = color.partition(":")
            spec["encoding"] = {"color": {"field": field, "type": {"Q": "quantitative", "O": "ordinal"}.get(kind, "nominal")}}
        return spec


def leaf_geometry(out: DataFrame):
    """A feature without parts keeps a geometry of its type with nothing in it."""
    return F.coalesce("geometry", F.when(F.col("type") == "GeometryCollection", F.lit('{"type":"GeometryCollection","geometries":[]}')).when(F.col("type").isNotNull(), F.format_string('{"type":"%s","coordinates":[]}', "type"))).alias("geometry")


def _saved(text: str, fp: str | None) -> str | None:
    if fp is None:
        return text
    with open(fp, "w", encoding="utf-8") as f:
        f.write(text)
    return None
