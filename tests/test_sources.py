import pytest

from arcmesh.sources import features as sources

SQUARE = {"type": "Polygon", "coordinates": [[[0, 0], [1, 0], [1, 1], [0, 0]]]}


def test_ids_of_a_collection():
    f = lambda *ids: {"type": "FeatureCollection", "features": [{"type": "Feature", "geometry": SQUARE, **({"id": i} if i is not None else {})} for i in ids]}
    assert [x["id"] for x in sources.from_collection(f("a", None, 0))] == ["a", "feature_1", "feature_2"]
    assert [x["id"] for x in sources.from_collection(f("a", "a"), ignore_index=True)] == ["feature_0", "feature_1"]
    with pytest.raises(IndexError):
        sources.from_collection(f("a", "a"))


def test_invalid_geometries_are_left_out():
    flat = {"type": "Polygon", "coordinates": [[[0, 0], [1, 0], [2, 0], [0, 0]]]}
    found, lost = sources.normalise([SQUARE, flat, {"type": "Nonsense"}, 5])
    assert (len(found), lost) == (1, 3)


def test_kinds_of_input():
    class Geo:
        __geo_interface__ = SQUARE

    for data in (SQUARE, [SQUARE], {"a": SQUARE}, Geo(), '{"type":"Feature","geometry":%s}' % str(SQUARE).replace("'", '"')):
        assert len(sources.normalise(data)[0]) == 1
    assert sources.normalise({"a": SQUARE})[0][0]["id"] == "a"
    with pytest.raises(TypeError):
        sources.normalise(7)


def test_files(spark, tmp_path):
    import json

    (tmp_path / "c.geojson").write_text(json.dumps({"type": "FeatureCollection", "features": [{"type": "Feature", "id": "x", "properties": {"k": 1}, "geometry": SQUARE}, {"type": "Feature", "properties": None, "geometry": SQUARE}]}))
    rows = sources.read_geojson(spark, str(tmp_path / "c.geojson")).orderBy("fid").collect()
    assert [r.id for r in rows] == ["x", "feature_1"] and json.loads(rows[0].properties) == {"k": 1}


def test_rings_that_cross_themselves_are_invalid():
    bow = {"type": "Polygon", "coordinates": [[[0, 0], [4, 3], [4, 0], [0, 2], [0, 0]]]}
    assert sources.valid(SQUARE) and not sources.valid(bow)


def test_well_known_binary():
    import struct

    from arcmesh.sources.wkb import geojson, wkb

    g = {"type": "GeometryCollection", "geometries": [{"type": "Point", "coordinates": [1.0, 2.0]}, {"type": "MultiPolygon", "coordinates": [[[[0.0, 0.0], [1.0, 0.0], [1.0, 1.0], [0.0, 0.0]]]]}, {"type": "MultiLineString", "coordinates": [[[0.0, 1.0], [2.0, 3.0]]]}]}
    assert geojson(wkb(g)) == g
    big = struct.pack(">BII2d", 0, 0x20000001, 4326, 5.0, 6.0)
    assert geojson(big) == {"type": "Point", "coordinates": [5.0, 6.0]}
    deep = struct.pack("<BI3d", 1, 1001, 5.0, 6.0, 7.0)
    assert geojson(deep) == {"type": "Point", "coordinates": [5.0, 6.0]}


def test_tables_carry_a_crs_and_take_wkb(spark):
    from arcmesh.plans.topology import Topology
    from arcmesh.sources.wkb import geojson, wkb

    line = {"type": "LineString", "coordinates": [[0.0, 0.0], [1.0, 2.0]]}
    df = spark.createDataFrame([(7, bytearray(wkb(line)))], "k long, geometry binary")
    topo = Topology(sources.from_table(df, "geometry", "k", crs="EPSG:4326"), spark, prequantize=False)
    out = topo.to_dataframe(geometry="wkb")
    assert topo.crs == out.schema["geometry"].metadata["crs"] == "EPSG:4326"
    assert [(r.id, geojson(bytes(r.geometry))) for r in out.collect()] == [("7", line)]


def test_properties_as_members():
    assert sources.properties_foreign([{"type": "Point", "properties": {"a": 1}}]) == [{"type": "Point", "a": 1}]
    own = [{"type": "Point", "properties": {"arcs": 1}}]
    assert sources.properties_foreign(own) == [{"type": "Point", "properties": {"arcs": 1}}]


def test_files_of_a_feature_per_line(spark, tmp_path):
    import json

    rows = [{"type": "Feature", "id": i, "properties": {"k": i}, "geometry": SQUARE} for i in (0, "a", "b")]
    (tmp_path / "l.geojson").write_text("\n".join(map(json.dumps, rows)) + "\n\n")
    got = sources.read_geojson(spark, str(tmp_path / "l.geojson")).orderBy("fid").collect()
    assert [r.id for r in got] == ["feature_0", "a", "b"] and json.loads(got[2].properties) == {"k": "b"}
