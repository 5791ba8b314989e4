import pytest
from pyspark.sql import functions as F

from arcmesh.functions import geom
from arcmesh.operators import quantize


def one(spark, pts, expr):
    df = spark.sql("SELECT from_json('%s', 'array<struct<x:double,y:double>>') AS pts" % str([{"x": x, "y": y} for x, y in pts]).replace("'", '"'))
    out = df.select(expr).first()[0]
    return [tuple(p) for p in out] if isinstance(out, list) else out


SQUARE = [(0, 0), (4, 0), (4, 3), (0, 3), (0, 0)]


def test_area_and_winding(spark):
    assert one(spark, SQUARE, geom.signed_area("pts")) == 12
    assert one(spark, SQUARE[::-1], geom.signed_area("pts")) == -12
    assert one(spark, SQUARE, geom.ring_winding("pts", F.lit(True), "CW_CCW")) == SQUARE[::-1]
    assert one(spark, SQUARE, geom.ring_winding("pts", F.lit(False), "CW_CCW")) == SQUARE
    with pytest.raises(NameError):
        geom.ring_winding("pts", F.lit(True), "CW")


def test_collinear_points_go_in_one_pass(spark):
    assert one(spark, [(0, 0), (0, 1), (0, 2)], geom.drop_collinear("pts")) == [(0, 0), (0, 2)]
    assert one(spark, [(0, 0), (1, 1), (0, 2)], geom.drop_collinear("pts")) == [(0, 0), (1, 1), (0, 2)]
    assert one(spark, [(0, 0), (1, 0), (0, 0)], geom.drop_collinear("pts")) == [(0, 0), (0, 0)]  # a spike


def test_quantize_and_delta(spark):
    q = lambda pts: one(spark, pts, geom.quantize_points("pts", F.lit(0.0), F.lit(0.0), F.lit(0.0625), F.lit(0.0625)))
    assert q([(0, 0), (0.97, 0), (0.97, 1), (0, 1), (0, 0)]) == [(0, 0), (16, 0), (16, 16), (0, 16), (0, 0)]
    assert q([(0.15625, 0), (0.21875, 0)]) == [(2, 0), (4, 0)]  # halves to even
    assert q([(0, 0), (0.001, 0)]) == [(0, 0), (0, 0)]  # a single point is kept whole
    enc = one(spark, [(0, 16), (16, 16), (16, 0)], geom.delta_encode("pts"))
    assert enc == [(0, 16), (16, 0), (0, -16)]
    lines = spark.createDataFrame([(1, [(0.0, 16.0), (16.0, 0.0), (0.0, -16.0)]), (2, []), (3, None), (4, [(5.0, 1.0)])], "ring_id long, pts array<struct<x:double,y:double>>")
    got = {r.ring_id: r.pts and [tuple(p) for p in r.pts] for r in quantize.delta_decode(lines).collect()}
    assert got == {1: [(0, 16), (16, 16), (16, 0)], 2: [], 3: None, 4: [(5, 1)]}


def test_a_function_computes_its_input_once(spark):
    """Exploding puts a filter on the array below its expression; the time must follow the length."""
    import time

    def took(n):
        df = spark.range(4).select(F.transform(F.sequence(F.lit(1), F.lit(n)), lambda i: geom.point(i * 3 % 7, i)).alias("pts"))
        out = df.select(geom.delta_encode(geom.quantize_points("pts", F.lit(0.0), F.lit(0.0), F.lit(1.0), F.lit(1.0))).alias("pts")).select(F.posexplode("pts"))
        began = time.time()
        out.write.format("noop").mode("overwrite").save()
        return time.time() - began

    took(60)
    assert min(took(4000) for _ in range(2)) < 10  # more than an hour if a point cost the whole line


def test_canonical_form(spark):
    c = lambda pts: one(spark, pts, geom.canonical("pts"))
    assert c(SQUARE) == c(SQUARE[::-1]) == c([SQUARE[2], SQUARE[3], SQUARE[0], SQUARE[1], SQUARE[2]])
    assert c([(0, 0), (1, 1)]) == c([(1, 1), (0, 0)]) != c([(0, 1), (1, 0)])
    eight = [(0, 0), (1, 1), (2, 0), (0, 0), (-1, 1), (-2, 0), (0, 0)]
    assert c(eight) == c(eight[::-1])
