"""Column functions over points arrays (array<struct<x,y>>); all stay in the JVM.

A lambda that looks at its array's other elements would compute the array again for each of them, as the
optimizer puts a column's expression wherever the column is named. `let` binds the array to a variable, so
that every function here costs one evaluation of its input and a pass over it.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def let(x: Column | str, f: Callable[[Column], Column]) -> Column:
    """f(x), with x computed once."""
    return F.get(F.transform(F.array(_c(x)), f), F.lit(0))


def point(x: Column, y: Column) -> Column:
    return F.struct(x.cast("double").alias("x"), y.cast("double").alias("y"))


def signed_area(pts: Column | str) -> Column:
    """Shoelace area; counter-clockwise is positive. An open ring is closed by its first point."""
    zero = F.struct(F.lit(0.0).alias("sum"), F.lit(0.0).alias("x"), F.lit(0.0).alias("y"))

    def whole(p: Column) -> Column:
        last = F.get(p, F.size(p) - 1)
        start = zero.withField("x", last["x"]).withField("y", last["y"])
        step = lambda s, v: F.struct((s["sum"] + (s["x"] * v["y"] - v["x"] * s["y"])).alias("sum"), v["x"].alias("x"), v["y"].alias("y"))
        return F.when(F.size(p) > 0, F.aggregate(p, start, step)["sum"] / 2).otherwise(F.lit(0.0))

    return let(pts, whole)


def is_ccw(pts: Column | str) -> Column:
    """Zero area counts as counter-clockwise."""
    return signed_area(pts) >= 0


def force_winding(pts: Column | str, ccw: Column | bool) -> Column:
    want = F.lit(ccw) if isinstance(ccw, bool) else ccw
    return let(pts, lambda p: F.when(is_ccw(p) == want, p).otherwise(F.reverse(p)))


def ring_winding(pts: Column | str, exterior: Column, order: str) -> Column:
    """CW_CCW: exteriors clockwise, holes counter-clockwise; CCW_CW: the opposite."""
    if order not in ("CW_CCW", "CCW_CW"):
        raise NameError(f"winding order {order!r}: CW_CCW or CCW_CW")
    return force_winding(pts, ~exterior if order == "CW_CCW" else exterior)


def line_length(pts: Column | str) -> Column:
    far = lambda a, b: F.sqrt(F.pow(b["x"] - a["x"], 2) + F.pow(b["y"] - a["y"], 2))
    steps = lambda p: F.zip_with(F.slice(p, F.lit(1), F.size(p) - 1), F.slice(p, F.lit(2), F.size(p) - 1), far)
    return let(pts, lambda p: F.when(F.size(p) > 1, F.aggregate(steps(p), F.lit(0.0), lambda s, d: s + d)).otherwise(F.lit(0.0)))


def drop_repeats(pts: Column | str) -> Column:
    """Without consecutive repeats; where that leaves a single point, all points stay."""
    kept = lambda p: F.filter(p, lambda v, i: (i == 0) | (v != F.get(p, i - 1)))
    return let(pts, lambda p: let(kept(p), lambda k: F.when(F.size(k) > 1, k).otherwise(p)))


def quantize_points(pts: Column | str, x0: Column, y0: Column, kx: Column, ky: Column) -> Column:
    """To the grid, halves to even; consecutive repeats go."""
    return drop_repeats(F.transform(_c(pts), lambda v: point(F.rint((v["x"] - x0) / kx), F.rint((v["y"] - y0) / ky))))


def dequantize_points(pts: Column | str, x0: Column, y0: Column, kx: Column, ky: Column) -> Column:
    return F.transform(_c(pts), lambda v: point(v["x"] * kx + x0, v["y"] * ky + y0))


def round_points(pts: Column | str, decimals: int) -> Column:
    return F.transform(_c(pts), lambda v: point(F.bround(v["x"], decimals), F.bround(v["y"], decimals)))


def delta_encode(pts: Column | str) -> Column:
    """The first point, then differences."""
    step = lambda p: lambda v, i: F.when(i == 0, v).otherwise(let(F.get(p, i - 1), lambda u: point(v["x"] - u["x"], v["y"] - u["y"])))
    return let(pts, lambda p: F.transform(p, step(p)))


def cross(a: Column, b: Column, c: Column) -> Column:
    """Twice the signed area of a triangle: 0 where b lies on the line through a and c."""
    return (b["x"] - a["x"]) * (c["y"] - b["y"]) - (b["y"] - a["y"]) * (c["x"] - b["x"])


def drop_collinear(pts: Column | str) -> Column:
    """One pass: inner points on the line of their original neighbours go, spikes and repeats too."""
    inner = lambda p: F.filter(p, lambda v, i: (i == 0) | (i == F.size(p) - 1) | (cross(F.get(p, i - 1), v, F.get(p, i + 1)) != 0))
    return let(pts, lambda p: F.when(F.size(p) > 2, inner(p)).otherwise(p))


def is_closed(pts: Column | str) -> Column:
    return let(pts, lambda p: (F.size(p) > 2) & (F.get(p, F.lit(0)) == F.get(p, F.size(p) - 1)))


def reverse_if(pts: Column | str, cond: Column) -> Column:
    return let(pts, lambda p: F.when(cond, F.reverse(p)).otherwise(p))


def _least_rotation(open_ring: Column) -> Column:
    """Of the rotations that start at the smallest point (usually one), the smallest."""

    def whole(p: Column) -> Column:
        n = F.size(p)
        starts = let(F.array_min(p), lambda low: F.filter(F.transform(p, lambda v, i: F.when(v == low, i)), lambda i: i.isNotNull()))
        return F.array_min(F.transform(starts, lambda i: F.concat(F.slice(p, i + 1, n - i), F.slice(p, F.lit(1), i))))

    return let(open_ring, whole)


def canonical(pts: Column | str) -> Column:
    """Equal for the same path in either direction and, if closed, from any start."""
    opened = lambda p: F.slice(p, F.lit(1), F.size(p) - 1)
    ring = lambda p: let(opened(p), lambda o: F.least(_least_rotation(o), _least_rotation(F.reverse(o))))
    return let(pts, lambda p: F.when(is_closed(p), ring(p)).otherwise(F.least(p, F.reverse(p))))


def with_canonical(df: DataFrame) -> DataFrame:
    """df with closed (is_closed) and canon (canonical) of its column pts, in steps of plain columns: these are
    compiled, lambdas are interpreted. A ring whose smallest point is there more than once takes canonical."""
    df = df.withColumn("closed", F.expr("coalesce(size(pts) > 2 and get(pts, 0) = get(pts, size(pts) - 1), false)"))
    df = df.withColumn("_o", F.expr("if(closed, slice(pts, 1, size(pts) - 1), null)"))
    df = df.withColumn("_i", F.expr("cast(array_position(_o, array_min(_o)) as int)"))
    df = df.withColumn("_f", F.expr("slice(_o, 1, _i - 1)")).withColumn("_r", F.expr("slice(_o, _i + 1, size(_o))"))
    # from the smallest point onward; the other way round it is the same start and the rest reversed
    df = df.withColumn("_t", F.expr("concat(_r, _f)"))
    again = F.expr("array_position(_t, get(_o, _i - 1)) > 0")
    around = F.expr("concat(slice(_o, _i, 1), least(_t, reverse(_t)))")
    canon = F.when(~F.col("closed"), F.least("pts", F.reverse("pts"))).when(again, canonical("pts")).otherwise(around)
    return df.withColumn("canon", canon).drop("_o", "_i", "_f", "_r", "_t")
