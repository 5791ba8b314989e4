"""Known small cases. The coordinates, numbers of arcs and references are fixed values: any encoder of this
format gives them. Each lies in a place of its own, so that one run encodes them all."""

import json

import pytest

from arcmesh.options import TopologyOptions, stage_options
from arcmesh.plans.topology import Topology


def polygon(*rings):
    return {"type": "Polygon", "coordinates": [[list(p) for p in r] for r in rings]}


def line(*pts):
    return {"type": "LineString", "coordinates": [list(p) for p in pts]}


def moved(g, d):
    walk = lambda c: [c[0] + d, c[1]] if isinstance(c[0], (int, float)) else [walk(x) for x in c]
    return {"type": g["type"], "coordinates": walk(g["coordinates"])}


CASES = {
    "squares": [polygon([(0, 0), (1, 0), (1, 1), (0, 1), (0, 0)]), polygon([(1, 0), (2, 0), (2, 1), (1, 1), (1, 0)])],
    "crossing": [line((4, 0), (2, 2), (0, 0)), line((0, 2), (1, 1), (2, 2), (3, 1), (4, 2))],
    "extra_vertex": [line((0, 0), (1, 0), (2, 0)), line((0, 0), (2, 0))],
    "partial": [line((0, 0), (1, 0), (2, 0), (3, 0)), line((0, 0), (2, 0))],
    "zigzag": [line((0, 0), (10, 0), (10, 5), (20, 5)), line((5, 0), (25, 0), (25, 5), (16, 5), (16, 10), (14, 10), (14, 5), (0, 5))],
    "toy": [line((0, 0), (10, 0), (5, 5), (15, 5)), line((15, 0), (15, 5), (5, 5), (0, 5))],
    "island": [polygon([(0, 0), (3, 0), (3, 3), (0, 3), (0, 0)], [(1, 1), (1, 2), (2, 2), (2, 1), (1, 1)]), polygon([(1, 1), (2, 1), (2, 2), (1, 2), (1, 1)])],
    "triangles": [polygon([(0, 0), (1, 0), (0, 1), (0, 0)]), polygon([(0, 0), (0, 1), (1, 0), (0, 0)])],
}


@pytest.fixture(scope="module")
def encoded(spark):
    data, owner = [], []
    for i, (name, own) in enumerate(CASES.items()):
        for g in own:
            data.append(moved(g, 1000 * i))
            owner.append(name)
    topo = Topology(data, spark, options=stage_options())
    doc = topo.to_dict()
    return topo, doc, owner


def refs(encoded, name):
    _, doc, owner = encoded
    flat = lambda x: [x] if isinstance(x, int) else [v for y in x for v in flat(y)]
    return [flat(g["arcs"]) for g, o in zip(doc["objects"]["data"]["geometries"], owner, strict=True) if o == name]


def unsigned(ids):
    return [v if v >= 0 else -v - 1 for v in ids]


def arcs_of(encoded, name):
    return len({v for ids in refs(encoded, name) for v in unsigned(ids)})


def test_two_squares_share_an_arc(encoded):
    a, b = refs(encoded, "squares")
    assert (a, b) == ([-3, 0], [1, 2])
    assert encoded[1]["arcs"][2] == [[1, 1], [1, 0]]


@pytest.mark.parametrize(("name", "n"), [("squares", 3), ("crossing", 5), ("zigzag", 9), ("toy", 4), ("island", 2), ("triangles", 1)])
def test_number_of_arcs(encoded, name, n):
    assert arcs_of(encoded, name) == n


def test_toy_references(encoded):
    a, b = refs(encoded, "toy")
    low = min(unsigned(a + b))
    assert [v - low if v >= 0 else v + low for v in a] == [0, -3]
    assert [v - low for v in b] == [1, 2, 3]


def test_junctions(encoded):
    where = {}
    for r in encoded[0].junctions.collect():
        name = list(CASES)[int(r.x // 1000)]
        where[name] = where.get(name, 0) + 1
    assert where.get("squares") == 2 and where.get("crossing") == 2 and where.get("partial") == 2 and where.get("zigzag") == 6
    assert "extra_vertex" not in where and "triangles" not in where


def test_decoding_gives_the_input_back(encoded):
    topo, _, owner = encoded
    out = json.loads(topo.to_geojson(winding_order=None))
    for i, (f, name) in enumerate(zip(out["features"], owner, strict=True)):
        if name in ("crossing", "zigzag", "toy"):  # equal but for vertices that cuts have added
            want = moved(CASES[name][i - owner.index(name)], 1000 * list(CASES).index(name))
            got = f["geometry"]["coordinates"]
            flat = [p for i, p in enumerate(got) if p in want["coordinates"] or not _between(got[i - 1], p, got[i + 1])]
            assert flat == want["coordinates"]


def _between(a, b, c):
    return (b[0] - a[0]) * (c[1] - b[1]) == (b[1] - a[1]) * (c[0] - b[0])


def test_points_quantized(spark):
    doc = Topology([polygon([(0, 0), (1, 0), (1, 1), (0, 1), (0, 0)]), {"type": "Point", "coordinates": [-0.5, 1.5]}], spark, topoquantize=True).to_dict()
    point = doc["objects"]["data"]["geometries"][1]
    assert len(doc["arcs"]) == 1 and point["coordinates"] == [0, 99999]
    assert all(isinstance(v, int) for arc in doc["arcs"] for p in arc for v in p)


def test_collections_layers_and_documents(spark):
    nested = {"type": "GeometryCollection", "geometries": [line((0, 0), (1, 1)), {"type": "GeometryCollection", "geometries": [{"type": "Point", "coordinates": [3, 4]}]}]}
    two = {"type": "FeatureCollection", "features": [{"type": "Feature", "id": "own", "properties": {"a": [1, None]}, "geometry": polygon([(0, 0), (1, 0), (1, 1), (0, 0)])}, {"type": "Feature", "properties": None, "geometry": nested}]}
    topo = Topology([two, [line((0, 0), (1, 1))]], spark, object_name=["x", "y"], prequantize=False)
    doc = topo.to_dict(options=True)
    first, second = doc["objects"]["x"]["geometries"]
    assert first["id"] == "own" and first["properties"] == {"a": [1, None]} and second["id"] == "feature_1"
    assert second["geometries"][1]["geometries"][0]["coordinates"] == [3, 4] and len(doc["options"]) == 12
    assert json.loads(topo.to_geojson(object_name="x"))["features"][1]["geometry"] == nested
    with pytest.raises(IndexError):
        topo.to_geojson(object_name=2)
    with pytest.raises(LookupError):
        topo.to_geojson(object_name="z")
    again = Topology(doc, spark)
    assert again.to_dict()["arcs"] == doc["arcs"] and again.bbox == tuple(doc["bbox"])


def test_options():
    with pytest.raises(NameError):
        TopologyOptions(winding_order="CW")
    assert stage_options().prequantize is False and TopologyOptions().winding_order == "CW_CCW"
    assert TopologyOptions().to_dict()["object_name"] == ["data"]
