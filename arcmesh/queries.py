"""Queries over the driver's tables, on geometry derived from their keys, with the same in SQL.

Geometry: a mesh of unit squares (key k at (k % W, k div W)), a brick mesh (two wide, odd rows shifted by
one, so corners meet edges), trajectories of users, intervals on horizontal lines, and points.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from arcmesh.functions import geom
from arcmesh.operators import cut, decode, dedup, junctions, lines, quantize, simplify, validity
from arcmesh.plans.encode import encode
from arcmesh.plans.topology import Topology
from arcmesh.sources import features as sources

CORNERS = ((0, 0), (1, 0), (1, 1), (0, 1), (0, 0))
MESHES = {"nation": ("n_nationkey", 5), "customer": ("c_custkey", 50), "orders": ("o_orderkey", 150)}


def read(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def mesh_lines(spark: SparkSession, sf: str, name: str = "customer", brick: bool = False) -> DataFrame:
    """ring_id, pts, is_ring of a mesh."""
    key, w = MESHES[name]
    k = F.col(key).cast("long")
    row = F.floor(k / w)
    wide = 2 if brick else 1
    x, y = (k % w) * wide + (row % 2 if brick else 0), row
    pts = F.array(*[geom.point(x + dx * wide, y + dy) for dx, dy in CORNERS])
    return read(spark, sf, name).select(k.alias("ring_id"), pts.alias("pts"), F.lit(True).alias("is_ring"))


def mesh(spark: SparkSession, sf: str, name: str = "customer", brick: bool = False) -> DataFrame:
    return lines.vertices(mesh_lines(spark, sf, name, brick))


def interval_lines(spark: SparkSession, sf: str) -> DataFrame:
    """Lines of customers: [k % 7, k % 7 + 1 + k % 5] at y = k % 100."""
    k = F.col("c_custkey").cast("long")
    a = k % 7
    pts = F.array(geom.point(a, k % 100), geom.point(a + 1 + k % 5, k % 100))
    return read(spark, sf, "customer").select(k.alias("ring_id"), pts.alias("pts"), F.lit(False).alias("is_ring"))


def intervals(spark: SparkSession, sf: str) -> DataFrame:
    return lines.vertices(interval_lines(spark, sf))


def trajectories(spark: SparkSession, sf: str) -> DataFrame:
    """ring_id (user), event_id, x (seconds), y (value)."""
    return read(spark, sf, "events").select(F.col("user_id").alias("ring_id"), "event_id", F.unix_seconds(F.col("ts").cast("timestamp")).cast("double").alias("x"), F.col("value").alias("y"))


def trajectory_lines(spark: SparkSession, sf: str) -> DataFrame:
    own = F.array_sort(F.collect_list(F.struct("x", "event_id", "y")))
    return trajectories(spark, sf).groupBy("ring_id").agg(F.transform(own, lambda v: geom.point(v["x"], v["y"])).alias("pts"))


def _grid(spark: SparkSession, sf: str, q: float) -> tuple[float, float, float, float]:
    t = quantize.transform_of(quantize.bbox(trajectories(spark, sf)), q).first()
    return t.x0, t.y0, t.kx, t.ky


def _ints(df: DataFrame, *cols: str) -> DataFrame:
    for c in cols:
        df = df.withColumn(c, F.col(c).cast("long"))
    return df


# ---- boxes, grids, deltas


def bbox_union(spark, sf):
    dots = read(spark, sf, "embeddings").select(F.col("embedding")[0].cast("double").alias("x"), F.col("embedding")[1].cast("double").alias("y"))
    return quantize.bbox(mesh(spark, sf), dots)


def grid_transform(spark, sf):
    return quantize.transform_of(quantize.bbox(trajectories(spark, sf)), 1e5)


def quantize_grid(spark, sf):
    return _ints(quantize.quantize_xy(trajectories(spark, sf), _grid(spark, sf, 1e4)).select("event_id", F.col("x").alias("qx"), F.col("y").alias("qy")), "qx", "qy")


def quantize_lines(spark, sf):
    out = quantize.quantize(trajectory_lines(spark, sf), _grid(spark, sf, 300))
    return _ints(lines.vertices(out), "x", "y").withColumn("pos", F.col("pos").cast("long"))


def delta_encode(spark, sf):
    out = quantize.quantize(trajectory_lines(spark, sf), _grid(spark, sf, 300)).withColumn("pts", geom.delta_encode("pts"))
    return _ints(lines.vertices(out), "x", "y").withColumn("pos", F.col("pos").cast("long"))


def delta_roundtrip(spark, sf):
    out = quantize.delta_decode(quantize.quantize(trajectory_lines(spark, sf), _grid(spark, sf, 300)).withColumn("pts", geom.delta_encode("pts")))
    return _ints(lines.vertices(out), "x", "y").withColumn("pos", F.col("pos").cast("long"))


def dequantize_grid(spark, sf):
    t = _grid(spark, sf, 1e4)
    out = quantize.dequantize(quantize.quantize(trajectories(spark, sf).select("event_id", F.array(geom.point(F.col("x"), F.col("y"))).alias("pts")), t), t)
    return out.select("event_id", F.round(F.col("pts")[0]["x"], 3).alias("x"), F.round(F.col("pts")[0]["y"], 6).alias("y"))


def point_quantize(spark, sf):
    dots = read(spark, sf, "customer").select("c_custkey", F.col("c_custkey").cast("double").alias("x"), F.col("c_acctbal").alias("y"))
    t = quantize.transform_of(quantize.bbox(dots), 1e5).first()
    return _ints(quantize.quantize_xy(dots, tuple(t)).select("c_custkey", F.col("x").alias("qx"), F.col("y").alias("qy")), "qx", "qy")


# ---- rings


def _quads(spark, sf):
    """Quadrilaterals of supplier keys, some turned the other way."""
    k = F.col("s_suppkey").cast("long")
    pts = F.array(geom.point(k * 0, k * 0), geom.point(k % 5 + 1, k * 0), geom.point(k % 5 + 1, k % 3 + 1), geom.point(k * 0, k % 4 + 1), geom.point(k * 0, k * 0))
    return read(spark, sf, "supplier").select(k.alias("ring_id"), geom.reverse_if(pts, k % 2 == 1).alias("pts"), F.lit(True).alias("is_ring"))


def signed_area(spark, sf):
    return _quads(spark, sf).select("ring_id", geom.signed_area("pts").alias("area"), geom.is_ccw("pts").alias("ccw"))


def winding_fix(spark, sf):
    own = _quads(spark, sf).withColumn("pts", geom.ring_winding("pts", F.col("ring_id") % 3 != 0, "CW_CCW"))
    return own.select("ring_id", geom.signed_area("pts").alias("area"), F.get("pts", F.lit(1))["x"].alias("x1"), F.get("pts", F.lit(1))["y"].alias("y1"))


def collinear_removal(spark, sf):
    """Brick outlines with the middles of their sides."""
    k = F.col("ring_id")
    more = F.flatten(F.transform(F.sequence(F.lit(0), F.lit(3)), lambda i: F.array(F.get("pts", i), geom.point((F.get("pts", i)["x"] + F.get("pts", i + 1)["x"]) / 2, (F.get("pts", i)["y"] + F.get("pts", i + 1)["y"]) / 2))))
    own = mesh_lines(spark, sf, "customer", True).withColumn("pts", geom.drop_collinear(F.concat(more, F.array(F.get("pts", F.lit(0))))))
    return lines.vertices(own.select(k, "pts")).withColumn("pos", F.col("pos").cast("long"))


def line_lengths(spark, sf):
    return intervals(spark, sf).groupBy("ring_id").agg(F.array_sort(F.collect_list(F.struct("pos", "x", "y"))).alias("v")).select("ring_id", geom.line_length(F.transform("v", lambda p: geom.point(p["x"], p["y"]))).alias("length"))


def valid_rings(spark, sf):
    """Quads and bow ties: invalid are those that cross themselves or have no area."""
    k = F.col("s_suppkey").cast("long")
    bow = F.array(geom.point(k * 0, k * 0), geom.point(k * 0 + 4, k * 0 + 3), geom.point(k * 0 + 4, k * 0), geom.point(k * 0, k * 0 + 2), geom.point(k * 0, k * 0))
    own = read(spark, sf, "supplier").select(k.alias("ring_id"), F.when(k % 4 == 1, bow).when(k % 4 == 2, F.array(geom.point(k * 0, k * 0), geom.point(k * 0 + 1, k * 0), geom.point(k * 0 + 2, k * 0), geom.point(k * 0, k * 0))).otherwise(F.array(*[geom.point(k * 0 + x, k * 0 + y) for x, y in CORNERS])).alias("pts"), F.lit(True).alias("is_ring"))
    return validity.invalid_rings(own, 2.0)


# ---- junctions


def junctions_coords(spark, sf):
    return junctions.lines_coords_connected(mesh_lines(spark, sf, "orders"))


def junctions_paths(spark, sf):
    return junctions.lines_connected(mesh_lines(spark, sf, "customer"), 2.0)


def junctions_bricks(spark, sf):
    return junctions.lines_connected(mesh_lines(spark, sf, "customer", True), 4.0)


def junctions_intervals(spark, sf):
    return junctions.lines_connected(interval_lines(spark, sf), 4.0)


def candidate_pairs(spark, sf):
    return junctions.envelope_pairs(mesh(spark, sf), 2.0)


def shared_directions(spark, sf):
    return junctions.shared_directions(mesh(spark, sf), 2.0)


# ---- cutting


def t_junction_insert(spark, sf):
    own = mesh_lines(spark, sf, "customer", True)
    out = cut.insert_junctions(lines.vertices(own), junctions.lines_connected(own, 4.0), 4.0)
    return out.select("ring_id", F.col("pos").cast("long").alias("pos"), "x", "y")


def _slots(uncut):
    own = cut.cut_lines(uncut, junctions.lines_connected(uncut, 4.0))
    return lines.vertices(own).select("ring_id", F.col("seq").cast("long").alias("seq"), F.col("pos").cast("long").alias("pos"), "x", "y")


def cut_rings_rotated(spark, sf):
    return _slots(mesh_lines(spark, sf))


def cut_lines(spark, sf):
    uncut = interval_lines(spark, sf)
    own = cut.cut_lines(uncut, junctions.lines_connected(uncut, 4.0), 4.0, True)
    return lines.vertices(own).select("ring_id", F.col("seq").cast("long").alias("seq"), F.col("pos").cast("long").alias("pos"), "x", "y")


# ---- arcs and references


def signed_refs(spark, sf):
    return encode(mesh_lines(spark, sf), 2.0).refs.select("ring_id", F.col("seq").cast("long").alias("seq"), F.col("signed_ref").cast("long").alias("signed_ref"))


def signed_refs_bricks(spark, sf):
    return encode(mesh_lines(spark, sf, "customer", True), 4.0).refs.select("ring_id", F.col("seq").cast("long").alias("seq"), F.col("signed_ref").cast("long").alias("signed_ref"))


def topology_encode(spark, sf):
    """The flagship: a whole mesh of orders to signed references."""
    return encode(mesh_lines(spark, sf, "orders"), 2.0).refs.select("ring_id", F.col("seq").cast("long").alias("seq"), F.col("signed_ref").cast("long").alias("signed_ref"))


def arc_numbering(spark, sf):
    return lines.vertices(encode(mesh_lines(spark, sf), 2.0).arcs.select("arc_id", "pts")).select(F.col("arc_id").cast("long").alias("arc_id"), F.col("pos").cast("long").alias("pos"), "x", "y")


def shared_arc_counts(spark, sf):
    return encode(mesh_lines(spark, sf), 2.0).arcs.groupBy("is_shared").agg(F.count("*").alias("arcs"))


def dedup_arcs(spark, sf):
    own = mesh_lines(spark, sf)
    found = dedup.matched(cut.cut_lines(own, junctions.lines_connected(own, 2.0)))
    return found.filter("keep.ring_id <> ring_id or keep.seq <> seq").select(F.col("ring_id"), F.col("seq").cast("long").alias("seq"), F.col("keep.ring_id").alias("keep_ring"), F.col("keep.seq").cast("long").alias("keep_seq"))


def decode_rings(spark, sf):
    """Encoded and decoded again: every vertex of every brick."""
    e = encode(mesh_lines(spark, sf, "customer", True), 4.0)
    return lines.vertices(decode.stitched(e.refs, e.arcs)).withColumn("pos", F.col("pos").cast("long"))


def shared_coords_cut(spark, sf):
    """Slots of a mesh cut where neighbours of a vertex differ."""
    own = encode(mesh_lines(spark, sf), 2.0, shared_coords=True).slots
    return lines.vertices(own).select("ring_id", F.col("seq").cast("long").alias("seq"), F.col("pos").cast("long").alias("pos"), "x", "y")


def topoquantize(spark, sf):
    """Arcs of a mesh on a coarser grid."""
    arcs = encode(mesh_lines(spark, sf), 2.0).arcs.select("arc_id", "pts")
    box = quantize.bbox(lines.vertices(arcs))
    out = quantize.quantize(arcs, tuple(quantize.transform_of(box, 15).first()))
    return _ints(lines.vertices(out), "x", "y").select(F.col("arc_id").cast("long").alias("arc_id"), F.col("pos").cast("long").alias("pos"), "x", "y")


def merge_contiguous(spark, sf):
    """Interval lines with cuts that only other lines needed undone."""
    uncut = interval_lines(spark, sf)
    own = dedup.merge_contiguous(cut.cut_lines(uncut, junctions.lines_connected(uncut, 4.0), 4.0, True))
    return lines.vertices(own).select("ring_id", F.col("seq").cast("long").alias("seq"), F.col("pos").cast("long").alias("pos"), "x", "y")


# ---- simplification, documents


def simplify_dp(spark, sf):
    out = simplify.simplify(trajectory_lines(spark, sf), 50.0, "dp")
    return lines.vertices(out).withColumn("pos", F.col("pos").cast("long"))


def simplify_vw(spark, sf):
    out = simplify.simplify(trajectory_lines(spark, sf), 5000.0, "vw")
    return out.select("ring_id", F.size("pts").cast("long").alias("kept"))


def _nations(spark: SparkSession, sf: str) -> DataFrame:
    """Nations as a table with a GeoJSON column."""
    k = F.col("n_nationkey")
    x, y = k % 5, F.floor(k / 5)
    ring = F.array(*[F.array((x + dx).cast("double"), (y + dy).cast("double")) for dx, dy in CORNERS])
    return read(spark, sf, "nation").select(F.col("n_nationkey"), "n_name", "n_regionkey", F.to_json(F.struct(F.lit("Polygon").alias("type"), F.array(ring).alias("coordinates"))).alias("geometry"))


def nation_topology(spark: SparkSession, sf: str) -> Topology:
    return Topology(sources.from_table(_nations(spark, sf), "geometry", "n_nationkey"), spark, prequantize=False)


def to_geojson(spark, sf):
    """Features decoded from arcs, in Spark: name and the positions of the outline, wound for GeoJSON."""
    out = nation_topology(spark, sf).to_dataframe()
    ring = F.from_json(F.get_json_object("geometry", "$.coordinates"), "array<array<array<double>>>")[0]
    own = out.select("id", F.get_json_object("properties", "$.n_name").alias("name"), F.posexplode(ring).alias("pos", "c"))
    return own.select("id", "name", F.col("pos").cast("long").alias("pos"), F.col("c")[0].alias("x"), F.col("c")[1].alias("y"))


def to_document(spark, sf):
    """The signed references of the encoded document's objects."""
    doc = nation_topology(spark, sf).to_dict()
    rows = [(int(g["id"]), i, int(v)) for g in doc["objects"]["data"]["geometries"] for i, v in enumerate(g["arcs"][0])]
    return spark.createDataFrame(rows, "id long, seq long, signed_ref long")


def layer_filter(spark, sf):
    """Two layers in one topology, nations and their points; the second decoded alone."""
    shapes = sources.from_table(_nations(spark, sf), "geometry", "n_nationkey")
    k = F.col("n_nationkey")
    dots = read(spark, sf, "nation").select("n_nationkey", F.to_json(F.struct(F.lit("Point").alias("type"), F.array((k % 5).cast("double"), F.floor(k / 5).cast("double")).alias("coordinates"))).alias("geometry"))
    both = Topology([shapes, sources.from_table(dots, "geometry", "n_nationkey", 1)], spark, prequantize=False, object_name=["shapes", "dots"])
    xy = F.from_json(F.get_json_object("geometry", "$.coordinates"), "array<double>")
    return both.to_dataframe("dots").select("id", xy[0].alias("x"), xy[1].alias("y"))


def duplicate_ids(spark, sf):
    """Feature ids of a table of features that are there more than once."""
    dot = F.to_json(F.struct(F.lit("Point").alias("type"), F.array(F.col("l_quantity").cast("double"), F.col("l_linenumber").cast("double")).alias("coordinates")))
    own = read(spark, sf, "lineitem").select("l_orderkey", dot.alias("geometry"))
    return sources.repeated_ids(sources.from_table(own, "geometry", "l_orderkey")).select("id", "n")


QUERIES = {
    f.__name__: f
    for f in (
        bbox_union, grid_transform, quantize_grid, quantize_lines, delta_encode, delta_roundtrip, dequantize_grid, point_quantize, signed_area, winding_fix, collinear_removal, line_lengths, valid_rings,
        junctions_coords, junctions_paths, junctions_bricks, junctions_intervals, candidate_pairs, shared_directions, t_junction_insert, cut_rings_rotated, cut_lines, shared_coords_cut, signed_refs, signed_refs_bricks, topology_encode,
        arc_numbering, shared_arc_counts, dedup_arcs, decode_rings, topoquantize, merge_contiguous, simplify_dp, simplify_vw, to_geojson, to_document, layer_filter, duplicate_ids,
    )
}

# ---- the same in SQL


def _sql_mesh(name: str, brick: bool = False) -> str:
    key, w = MESHES[name]
    wide, shift = (2, f" + ({key} // {w}) % 2") if brick else (1, "")
    return f"v AS (SELECT CAST({key} AS BIGINT) AS ring_id, p.pos, CAST(({key} % {w}) * {wide}{shift} + p.dx * {wide} AS DOUBLE) AS x, CAST({key} // {w} + p.dy AS DOUBLE) AS y, true AS is_ring FROM {name} CROSS JOIN (VALUES (0, 0, 0), (1, 1, 0), (2, 1, 1), (3, 0, 1), (4, 0, 0)) p(pos, dx, dy))"


_INTERVALS = "v AS (SELECT CAST(c_custkey AS BIGINT) AS ring_id, p.pos, CAST(c_custkey % 7 + p.pos * (1 + c_custkey % 5) AS DOUBLE) AS x, CAST(c_custkey % 100 AS DOUBLE) AS y, false AS is_ring FROM customer CROSS JOIN (VALUES (0), (1)) p(pos))"
_SEGMENTS = """seg AS (SELECT * FROM (SELECT ring_id, pos, x AS x1, y AS y1, lead(x) OVER w AS x2, lead(y) OVER w AS y2 FROM v WINDOW w AS (PARTITION BY ring_id ORDER BY pos)) WHERE x2 IS NOT NULL AND (x1 <> x2 OR y1 <> y2)),
ax AS (SELECT *, CASE WHEN x1 = x2 THEN 0 ELSE 1 END AS o, CASE WHEN x1 = x2 THEN x1 ELSE y1 END AS c, CASE WHEN x1 = x2 THEN least(y1, y2) ELSE least(x1, x2) END AS lo, CASE WHEN x1 = x2 THEN greatest(y1, y2) ELSE greatest(x1, x2) END AS hi, CASE WHEN x1 = x2 THEN y1 ELSE x1 END AS s1, CASE WHEN x1 = x2 THEN y2 ELSE x2 END AS s2 FROM seg)"""
_JUNCTIONS = f"""{_SEGMENTS},
pc0 AS (SELECT DISTINCT a.ring_id AS la, b.ring_id AS lb, a.o, a.c, greatest(a.lo, b.lo) AS lo, least(a.hi, b.hi) AS hi FROM ax a JOIN ax b ON a.o = b.o AND a.c = b.c AND a.ring_id < b.ring_id AND a.lo < b.hi AND b.lo < a.hi),
len AS (SELECT ring_id, sum(hi - lo) AS n FROM ax GROUP BY 1),
same AS (SELECT la, lb FROM (SELECT la, lb, sum(hi - lo) AS n FROM pc0 GROUP BY 1, 2) s JOIN len x ON x.ring_id = la JOIN len y ON y.ring_id = lb WHERE s.n = x.n AND s.n = y.n),
pc AS (SELECT * FROM pc0 ANTI JOIN same USING (la, lb)),
ends AS (SELECT la, lb, CASE WHEN o = 0 THEN c ELSE t END AS x, CASE WHEN o = 0 THEN t ELSE c END AS y FROM (SELECT la, lb, o, c, unnest([lo, hi]) AS t FROM pc)),
j AS (SELECT DISTINCT x, y FROM (SELECT la, lb, x, y FROM ends GROUP BY 1, 2, 3, 4 HAVING count(*) <> 2))"""
_INSERTED = f"""{_JUNCTIONS},
ins AS (SELECT ring_id, pos + abs(t - s1) / (hi - lo) AS fpos, x, y FROM (SELECT ax.*, j.x, j.y, CASE WHEN o = 0 THEN j.y ELSE j.x END AS t FROM ax JOIN j ON ax.c = CASE WHEN o = 0 THEN j.x ELSE j.y END) WHERE t > lo AND t < hi),
v2 AS (SELECT ring_id, row_number() OVER (PARTITION BY ring_id ORDER BY fpos) - 1 AS pos, x, y FROM (SELECT ring_id, CAST(pos AS DOUBLE) AS fpos, x, y FROM v UNION ALL SELECT ring_id, fpos, x, y FROM ins))"""


_COORDS = """n AS (SELECT x, y, coalesce(lag(struct_pack(x := x, y := y)) OVER w, last_value(struct_pack(x := x, y := y)) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)) AS a, coalesce(lead(struct_pack(x := x, y := y)) OVER w, first_value(struct_pack(x := x, y := y)) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)) AS b FROM v WINDOW w AS (PARTITION BY ring_id ORDER BY pos)),
j AS (SELECT x, y FROM n GROUP BY x, y HAVING count(DISTINCT CASE WHEN a <= b THEN [a, b] ELSE [b, a] END) > 1),
v2 AS (SELECT ring_id, pos, x, y FROM v)"""


def _sql_slots(ring: bool, before: str = _INSERTED) -> str:
    r = "true" if ring else "false"
    return f"""{before},
m AS (SELECT v2.*, j.x IS NOT NULL AS isj FROM v2 LEFT JOIN j USING (x, y)),
m2 AS (SELECT *, max(pos) OVER (PARTITION BY ring_id) AS n, min(pos) FILTER (WHERE isj) OVER (PARTITION BY ring_id) AS fj FROM m),
rot0 AS (SELECT ring_id, x, y, isj, n, CASE WHEN {r} AND fj > 0 THEN (pos - fj + n) % n ELSE pos END AS p FROM m2 WHERE NOT ({r} AND pos = n)),
rot AS (SELECT * FROM rot0 UNION ALL SELECT ring_id, x, y, isj, n, n AS p FROM rot0 WHERE {r} AND p = 0),
num AS (SELECT *, isj AND p > 0 AND p < n AS cut, sum(CASE WHEN isj AND p > 0 AND p < n THEN 1 ELSE 0 END) OVER (PARTITION BY ring_id ORDER BY p) AS seq FROM rot),
pieces AS (SELECT ring_id, CAST(seq AS BIGINT) AS seq, p, x, y FROM num UNION ALL SELECT ring_id, CAST(seq - 1 AS BIGINT), p, x, y FROM num WHERE cut),
thin AS (SELECT * FROM (SELECT *, lag(x) OVER w AS xa, lag(y) OVER w AS ya, lead(x) OVER w AS xb, lead(y) OVER w AS yb FROM pieces WINDOW w AS (PARTITION BY ring_id, seq ORDER BY p)) WHERE xa IS NULL OR xb IS NULL OR (x - xa) * (yb - y) - (y - ya) * (xb - x) <> 0)"""


def _sql_arcs(ring: bool) -> str:
    return f"""{_sql_slots(ring)},
slot AS (SELECT ring_id, seq, ring_id * 1000 + seq AS slot, list(struct_pack(x := x, y := y) ORDER BY p) AS pts FROM thin GROUP BY 1, 2),
canon AS (SELECT *, pts <= list_reverse(pts) AS ahead, CASE WHEN pts <= list_reverse(pts) THEN pts ELSE list_reverse(pts) END AS key FROM slot),
kept AS (SELECT *, max(slot) OVER (PARTITION BY key) AS keep, count(*) OVER (PARTITION BY key) AS copies, arg_max(ahead, slot) OVER (PARTITION BY key) AS kept_ahead FROM canon),
coded AS (SELECT *, dense_rank() OVER (ORDER BY keep) - 1 AS arc_id FROM kept)"""


_VERTEX = "SELECT ring_id, CAST(pos AS BIGINT) AS pos, x, y FROM"
_SLOT_ROWS = "SELECT ring_id, seq, CAST(row_number() OVER (PARTITION BY ring_id, seq ORDER BY p) - 1 AS BIGINT) AS pos, x, y FROM thin"
_REFS = "SELECT ring_id, seq, CAST(CASE WHEN ahead = kept_ahead THEN arc_id ELSE -arc_id - 1 END AS BIGINT) AS signed_ref FROM coded"
_TRAJ = "e AS (SELECT user_id AS ring_id, event_id, CAST(floor(epoch(ts)) AS DOUBLE) AS x, value AS y FROM events)"


def _sql_grid(q: float) -> str:
    return f"t AS (SELECT x0, y0, CASE WHEN x1 = x0 THEN 1.0 ELSE (x1 - x0) / CAST({q - 1} AS DOUBLE) END AS kx, CASE WHEN y1 = y0 THEN 1.0 ELSE (y1 - y0) / CAST({q - 1} AS DOUBLE) END AS ky FROM (SELECT min(x) AS x0, min(y) AS y0, max(x) AS x1, max(y) AS y1 FROM e))"


_QUANT = f"""WITH {_TRAJ}, {_sql_grid(300)},
q AS (SELECT ring_id, row_number() OVER (PARTITION BY ring_id ORDER BY x, event_id) AS n, CAST(round_even((x - x0) / kx, 0) AS BIGINT) AS x, CAST(round_even((y - y0) / ky, 0) AS BIGINT) AS y FROM e, t),
d AS (SELECT *, lag(x) OVER w AS px, lag(y) OVER w AS py FROM q WINDOW w AS (PARTITION BY ring_id ORDER BY n)),
l AS (SELECT ring_id, row_number() OVER (PARTITION BY ring_id ORDER BY n) - 1 AS pos, x, y FROM d WHERE px IS NULL OR x <> px OR y <> py)"""
_QUADS = """k AS (SELECT CAST(s_suppkey AS BIGINT) AS k FROM supplier),
pts AS (SELECT k, CASE WHEN k % 2 = 1 THEN list_reverse(p) ELSE p END AS p FROM (SELECT k, [[0, 0], [k % 5 + 1, 0], [k % 5 + 1, k % 3 + 1], [0, k % 4 + 1], [0, 0]] AS p FROM k)),
a AS (SELECT k, p, (p[1][1] * p[2][2] - p[2][1] * p[1][2] + p[2][1] * p[3][2] - p[3][1] * p[2][2] + p[3][1] * p[4][2] - p[4][1] * p[3][2] + p[4][1] * p[5][2] - p[5][1] * p[4][2]) / 2 AS area FROM pts)"""

#: Outlines of nations as they are encoded: exteriors clockwise.
_CW_NATIONS = _sql_mesh("nation").replace("(1, 1, 0), (2, 1, 1), (3, 0, 1)", "(1, 0, 1), (2, 1, 1), (3, 1, 0)")

ORACLE_SQL = {
    "bbox_union": f"WITH {_sql_mesh('customer')} SELECT min(x) AS x0, min(y) AS y0, max(x) AS x1, max(y) AS y1 FROM (SELECT x, y FROM v UNION ALL SELECT CAST(embedding[1] AS DOUBLE), CAST(embedding[2] AS DOUBLE) FROM embeddings)",
    "grid_transform": f"WITH {_TRAJ}, {_sql_grid(1e5)} SELECT x0, y0, kx, ky FROM t",
    "quantize_grid": f"WITH {_TRAJ}, {_sql_grid(1e4)} SELECT event_id, CAST(round_even((x - x0) / kx, 0) AS BIGINT) AS qx, CAST(round_even((y - y0) / ky, 0) AS BIGINT) AS qy FROM e, t",
    "dequantize_grid": f"WITH {_TRAJ}, {_sql_grid(1e4)} SELECT event_id, round(round_even((x - x0) / kx, 0) * kx + x0, 3) AS x, round(round_even((y - y0) / ky, 0) * ky + y0, 6) AS y FROM e, t",
    "quantize_lines": f"{_QUANT} {_VERTEX} l",
    "delta_roundtrip": f"{_QUANT} {_VERTEX} l",
    "delta_encode": f"{_QUANT} SELECT ring_id, CAST(pos AS BIGINT) AS pos, CAST(x - coalesce(lag(x) OVER w, 0) AS BIGINT) AS x, CAST(y - coalesce(lag(y) OVER w, 0) AS BIGINT) AS y FROM l WINDOW w AS (PARTITION BY ring_id ORDER BY pos)",
    "point_quantize": f"WITH e AS (SELECT c_custkey, CAST(c_custkey AS DOUBLE) AS x, c_acctbal AS y FROM customer), {_sql_grid(1e5)} SELECT c_custkey, CAST(round_even((x - x0) / kx, 0) AS BIGINT) AS qx, CAST(round_even((y - y0) / ky, 0) AS BIGINT) AS qy FROM e, t",
    "signed_area": f"WITH {_QUADS} SELECT k AS ring_id, CAST(area AS DOUBLE) AS area, area >= 0 AS ccw FROM a",
    "winding_fix": f"WITH {_QUADS}, f AS (SELECT k, (area >= 0) = (k % 3 = 0) AS ok, area, p FROM a) SELECT k AS ring_id, CAST(CASE WHEN ok THEN area ELSE -area END AS DOUBLE) AS area, CAST(CASE WHEN ok THEN p[2][1] ELSE p[4][1] END AS DOUBLE) AS x1, CAST(CASE WHEN ok THEN p[2][2] ELSE p[4][2] END AS DOUBLE) AS y1 FROM f",
    "collinear_removal": f"WITH {_sql_mesh('customer', True)} {_VERTEX} v",
    "line_lengths": "SELECT CAST(c_custkey AS BIGINT) AS ring_id, CAST(1 + c_custkey % 5 AS DOUBLE) AS length FROM customer",
    "valid_rings": "SELECT CAST(s_suppkey AS BIGINT) AS ring_id FROM supplier WHERE s_suppkey % 4 IN (1, 2)",
    "junctions_coords": f"WITH {_sql_mesh('orders')}, n AS (SELECT x, y, coalesce(lag(struct_pack(x := x, y := y)) OVER w, last_value(struct_pack(x := x, y := y)) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)) AS a, coalesce(lead(struct_pack(x := x, y := y)) OVER w, first_value(struct_pack(x := x, y := y)) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)) AS b FROM v WINDOW w AS (PARTITION BY ring_id ORDER BY pos)) SELECT x, y FROM n GROUP BY x, y HAVING count(DISTINCT CASE WHEN a <= b THEN [a, b] ELSE [b, a] END) > 1",
    "junctions_paths": f"WITH {_sql_mesh('customer')}, {_JUNCTIONS} SELECT x, y FROM j",
    "junctions_bricks": f"WITH {_sql_mesh('customer', True)}, {_JUNCTIONS} SELECT x, y FROM j",
    "junctions_intervals": f"WITH {_INTERVALS}, {_JUNCTIONS} SELECT x, y FROM j",
    "candidate_pairs": f"WITH {_sql_mesh('customer')}, b AS (SELECT ring_id, min(x) AS x0, min(y) AS y0, max(x) AS x1, max(y) AS y1 FROM v GROUP BY 1) SELECT p.ring_id AS a, q.ring_id AS b FROM b p JOIN b q ON p.ring_id < q.ring_id AND p.x0 <= q.x1 AND q.x0 <= p.x1 AND p.y0 <= q.y1 AND q.y0 <= p.y1",
    "shared_directions": f"WITH {_sql_mesh('customer')}, {_SEGMENTS} SELECT a.ring_id AS la, b.ring_id AS lb, count(*) FILTER (WHERE (a.s2 > a.s1) = (b.s2 > b.s1)) AS forward, count(*) FILTER (WHERE (a.s2 > a.s1) <> (b.s2 > b.s1)) AS backward FROM ax a JOIN ax b ON a.o = b.o AND a.c = b.c AND a.ring_id < b.ring_id AND a.lo < b.hi AND b.lo < a.hi GROUP BY 1, 2",
    "t_junction_insert": f"WITH {_sql_mesh('customer', True)}, {_INSERTED} {_VERTEX} v2",
    "cut_rings_rotated": f"WITH {_sql_mesh('customer')}, {_sql_slots(True)} {_SLOT_ROWS}",
    "cut_lines": f"WITH {_INTERVALS}, {_sql_slots(False)} {_SLOT_ROWS}",
    "signed_refs": f"WITH {_sql_mesh('customer')}, {_sql_arcs(True)} {_REFS}",
    "signed_refs_bricks": f"WITH {_sql_mesh('customer', True)}, {_sql_arcs(True)} {_REFS}",
    "topology_encode": f"WITH {_sql_mesh('orders')}, {_sql_arcs(True)} {_REFS}",
    "arc_numbering": f"WITH {_sql_mesh('customer')}, {_sql_arcs(True)}, o AS (SELECT arc_id, unnest(range(len(pts))) AS pos, pts FROM coded WHERE slot = keep) SELECT CAST(arc_id AS BIGINT) AS arc_id, pos, pts[pos + 1].x AS x, pts[pos + 1].y AS y FROM o",
    "shared_arc_counts": f"WITH {_sql_mesh('customer')}, {_sql_arcs(True)} SELECT copies > 1 AS is_shared, count(*) AS arcs FROM coded WHERE slot = keep GROUP BY 1",
    "dedup_arcs": f"WITH {_sql_mesh('customer')}, {_sql_arcs(True)} SELECT ring_id, seq, keep // 1000 AS keep_ring, keep % 1000 AS keep_seq FROM coded WHERE slot <> keep",
    "decode_rings": f"WITH {_sql_mesh('customer', True)}, {_sql_slots(True)}, o AS (SELECT *, row_number() OVER (PARTITION BY ring_id, seq ORDER BY p) AS k FROM thin) SELECT ring_id, CAST(row_number() OVER (PARTITION BY ring_id ORDER BY seq, p) - 1 AS BIGINT) AS pos, x, y FROM o WHERE seq = 0 OR k > 1",
    "shared_coords_cut": f"WITH {_sql_mesh('customer')}, {_sql_slots(True, _COORDS)} {_SLOT_ROWS}",
    "topoquantize": f"WITH {_sql_mesh('customer')}, {_sql_arcs(True)}, e AS (SELECT arc_id, pos, pts[pos + 1].x AS x, pts[pos + 1].y AS y FROM (SELECT arc_id, unnest(range(len(pts))) AS pos, pts FROM coded WHERE slot = keep)), {_sql_grid(15)}, q AS (SELECT arc_id, pos, CAST(round_even((x - x0) / kx, 0) AS BIGINT) AS x, CAST(round_even((y - y0) / ky, 0) AS BIGINT) AS y FROM e, t), d AS (SELECT *, lag(x) OVER w AS px, lag(y) OVER w AS py FROM q WINDOW w AS (PARTITION BY arc_id ORDER BY pos)), f AS (SELECT *, count(*) FILTER (WHERE px IS NULL OR x <> px OR y <> py) OVER (PARTITION BY arc_id) AS n FROM d) SELECT CAST(arc_id AS BIGINT) AS arc_id, CAST(row_number() OVER (PARTITION BY arc_id ORDER BY pos) - 1 AS BIGINT) AS pos, x, y FROM f WHERE n = 1 OR px IS NULL OR x <> px OR y <> py",
    "merge_contiguous": f"WITH {_INTERVALS}, {_sql_arcs(False)}, sl AS (SELECT ring_id, seq, copies > 1 AS shared, pts[1] AS a, pts[len(pts)] AS b FROM kept), deg AS (SELECT n, count(*) AS d FROM (SELECT a AS n FROM sl UNION ALL SELECT b FROM sl) GROUP BY 1), mg AS (SELECT sl.*, coalesce(shared OR lag(shared) OVER w OR d <> 2, true) AS apart FROM sl JOIN deg ON a = n WINDOW w AS (PARTITION BY ring_id ORDER BY seq)), r AS (SELECT *, sum(CAST(apart AS INTEGER)) OVER (PARTITION BY ring_id ORDER BY seq) AS run FROM mg), g AS (SELECT ring_id, CAST(max(seq) AS BIGINT) AS seq, arg_min(a, seq) AS a, arg_max(b, seq) AS b FROM r GROUP BY ring_id, run) SELECT ring_id, seq, CAST(0 AS BIGINT) AS pos, a.x AS x, a.y AS y FROM g UNION ALL SELECT ring_id, seq, CAST(1 AS BIGINT), b.x, b.y FROM g",
    "simplify_dp": f"""WITH RECURSIVE {_TRAJ},
pt AS (SELECT ring_id, x, y, CAST(row_number() OVER (PARTITION BY ring_id ORDER BY x, event_id) - 1 AS BIGINT) AS n FROM e),
run AS (
  SELECT ring_id, CAST(0 AS BIGINT) AS a, max(n) AS b FROM pt GROUP BY 1
  UNION ALL
  SELECT ring_id, CASE WHEN half = 0 THEN a ELSE far END, CASE WHEN half = 0 THEN far ELSE b END FROM (
    SELECT ring_id, a, b, arg_max(n, [d, -n]) AS far, max(d) AS d FROM (
      SELECT run.ring_id, run.a, run.b, q.n, CASE WHEN l = 0 THEN sqrt((q.x - u.x) * (q.x - u.x) + (q.y - u.y) * (q.y - u.y)) ELSE sqrt(pow(q.x - u.x - t * (w.x - u.x), 2) + pow(q.y - u.y - t * (w.y - u.y), 2)) END AS d
      FROM run JOIN pt u ON u.ring_id = run.ring_id AND u.n = run.a JOIN pt w ON w.ring_id = run.ring_id AND w.n = run.b JOIN pt q ON q.ring_id = run.ring_id AND q.n > run.a AND q.n < run.b,
      LATERAL (SELECT (w.x - u.x) * (w.x - u.x) + (w.y - u.y) * (w.y - u.y) AS l), LATERAL (SELECT CASE WHEN l = 0 THEN 0 ELSE least(1, greatest(0, ((q.x - u.x) * (w.x - u.x) + (q.y - u.y) * (w.y - u.y)) / l)) END AS t)
    ) GROUP BY 1, 2, 3 HAVING max(d) > 50
  ), (VALUES (0), (1)) h(half)
),
kept AS (SELECT DISTINCT ring_id, n FROM (SELECT ring_id, a AS n FROM run UNION ALL SELECT ring_id, b FROM run))
SELECT ring_id, CAST(row_number() OVER (PARTITION BY ring_id ORDER BY n) - 1 AS BIGINT) AS pos, x, y FROM kept JOIN pt USING (ring_id, n)""",
    "to_geojson": f"WITH {_CW_NATIONS}, {_sql_slots(True)}, o AS (SELECT *, row_number() OVER (PARTITION BY ring_id, seq ORDER BY p) AS k FROM thin), d AS (SELECT ring_id, x, y, row_number() OVER (PARTITION BY ring_id ORDER BY seq DESC, p DESC) - 1 AS pos FROM o WHERE seq = 0 OR k > 1) SELECT CAST(ring_id AS VARCHAR) AS id, n_name AS name, CAST(pos AS BIGINT) AS pos, x, y FROM d JOIN nation ON n_nationkey = ring_id",
    "to_document": f"WITH {_CW_NATIONS}, {_sql_arcs(True)} SELECT ring_id AS id, seq, CAST(CASE WHEN ahead = kept_ahead THEN arc_id ELSE -arc_id - 1 END AS BIGINT) AS signed_ref FROM coded",
    "layer_filter": "SELECT CAST(n_nationkey AS VARCHAR) AS id, CAST(n_nationkey % 5 AS DOUBLE) AS x, CAST(n_nationkey // 5 AS DOUBLE) AS y FROM nation",
    "duplicate_ids": "SELECT CAST(l_orderkey AS VARCHAR) AS id, count(*) AS n FROM lineitem GROUP BY 1 HAVING count(*) > 1",
}
