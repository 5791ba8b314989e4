"""What keeps time and memory in proportion to the input, and the array forms against the vertex forms."""

import random
import re

import pytest

from arcmesh.functions import geom
from arcmesh.operators import cut, junctions, lines

POINTS = "ring_id long, pts array<struct<x:double,y:double>>, is_ring boolean"


def table(spark, rows):
    return spark.createDataFrame([(k, [(float(x), float(y)) for x, y in pts], ring) for k, pts, ring in rows], POINTS)


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def random_lines(n, step=1.0):
    rng, out = random.Random(7), []
    for k in range(n):
        x, y, pts = rng.randint(0, 6), rng.randint(0, 6), []
        for _ in range(rng.randint(1, 7)):
            pts.append((x * step, y * step))
            x, y = (x + rng.choice((-2, -1, 1, 2)), y) if rng.random() < 0.5 else (x, y + rng.choice((-2, -1, 1, 2)))
        ring = len(pts) > 2 and rng.random() < 0.5
        out.append((k, pts + pts[:1] if ring else pts, ring))
    return out


def slot_set(df):
    return sorted((r.ring_id, r.seq, tuple(map(tuple, r.pts))) for r in df.collect())


@pytest.mark.parametrize(("step", "exact"), [(1.0, True), (1.0, False), (0.37, False)])
def test_lines_are_cut_as_vertices_are(spark, step, exact):
    own = table(spark, random_lines(80, step)).cache()
    v, cell = lines.vertices(own), 2.0 * step
    found = junctions.lines_connected(own, cell, exact).cache()
    assert found.count() > 20
    want = slot_set(cut.slots(cut.split(cut.insert_junctions(v, found, cell), found)))
    assert slot_set(cut.cut_lines(own, found, cell, exact)) == want
    assert slot_set(cut.cut_lines(own, found)) == slot_set(cut.slots(cut.split(v, found))) != want


def test_exact_and_near_junctions_agree(spark):
    own = table(spark, random_lines(80))
    got = [sorted(map(tuple, junctions.lines_connected(own, 2.0, exact).collect())) for exact in (True, False)]
    assert got[0] == got[1] == sorted(map(tuple, junctions.path_connected(lines.vertices(own), 3.0).collect()))


def test_an_open_line_is_not_the_ring_of_its_points(spark):
    """Both have the canonical form (0, 0), (0, 4), (4, 0), but the ring goes on."""
    tri = [(0, 0), (0, 4), (4, 0)]
    own = table(spark, [(1, tri, False), (2, [*tri, tri[0]], True)])
    assert sorted(map(tuple, junctions.path_connected(lines.vertices(own), 8.0).collect())) == [(0, 0), (4, 0)]


def test_columns_give_the_canonical_form(spark):
    own = table(spark, random_lines(300)).filter("size(pts) > 0")
    assert geom.with_canonical(own).withColumn("c", geom.canonical("pts")).withColumn("d", geom.is_closed("pts")).filter("not (canon <=> c and closed <=> d)").isEmpty()


def test_methods_of_the_segment_join_can_be_compiled(spark):
    """The JVM interprets methods of over 8,000 bytes; a segment then costs some ten times as much."""
    own = table(spark, random_lines(10))
    spark.conf.set("spark.sql.adaptive.enabled", "false")  # plans are whole before they run
    joined = junctions.overlaps(junctions.line_segments(own.selectExpr("ring_id", "pts", "0D as n")), 2.0)
    text = spark._jvm.org.apache.spark.sql.execution.debug.__getattr__("package$").__getattr__("MODULE$").codegenString(joined._jdf.queryExecution().executedPlan())
    spark.conf.unset("spark.sql.adaptive.enabled")
    sizes = [int(n) for n in re.findall(r"maxMethodCodeSize:(\d+)", text)]
    assert sizes and max(sizes) < 8000


def test_each_pair_of_segments_is_reported_once(spark):
    """Long segments share many cells."""
    own = table(spark, [(k, [(0, 0), (100, 0)], False) for k in range(4)] + [(9, [(50, 0), (150, 0)], False)])
    assert junctions.overlaps(junctions.segments(lines.vertices(own)).selectExpr("*", "0D as n"), 2.0).count() == 10


def test_points_are_grouped_without_sorts_by_tasks_of_bounded_size(spark, monkeypatch):
    own = table(spark, random_lines(60))
    want = sorted(map(tuple, junctions.coords_connected(lines.vertices(own)).collect()))
    vertices, near = lines.vertices(own).collect(), {}
    of = {k: [(r.x, r.y) for r in sorted((r for r in vertices if r.ring_id == k), key=lambda r: r.pos)] for k in {r.ring_id for r in vertices}}
    for pts in of.values():
        for i, p in enumerate(pts):
            near.setdefault(p, set()).add(tuple(sorted((pts[i - 1], pts[(i + 1) % len(pts)]))))
    assert want == sorted(p for p, pairs in near.items() if len(pairs) > 1)
    monkeypatch.setattr(junctions, "EACH", 10)
    for found in (junctions.coords_connected(lines.vertices(own)), junctions.lines_coords_connected(own)):
        assert sorted(map(tuple, found.collect())) == want
        assert "SortAggregate" not in plan(found) and found.rdd.getNumPartitions() == -(-len(vertices) // 10)
