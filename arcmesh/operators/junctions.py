"""Junctions: the points where shared paths start or end.

Two ways. `coords_connected` compares the neighbours of every vertex and needs one shuffle if lines are given. `path_connected`
finds overlapping collinear segments of different lines and keeps the ends of what they share.

Segments that overlap lie on one line, so they are joined on the line's equation and a cell along it: an
equi-join that neither compares all pairs nor depends on how long a line's segments are. Coordinates on an
integer grid (after quantization) give exact keys; else the keys are rounded and a tolerance applies.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from arcmesh.functions import geom
from arcmesh.operators.lines import collected
from arcmesh.operators.tables import dealt, settled


#: Vertices to a task where points are grouped.
EACH = 1_500_000


def _differing(near: DataFrame, rows: int) -> DataFrame:
    """x, y whose neighbours a, b, in either order, are not the same everywhere."""
    pair = near.select("x", "y", F.least("a", "b").alias("lo"), F.greatest("a", "b").alias("hi"))
    parts = [F.col(f"{v}.{c}").alias(v + c) for v in ("lo", "hi") for c in ("x", "y")]
    gaps = F.expr("int(isnull(lo.x)) + 2 * int(isnull(lo.y)) + 4 * int(isnull(hi.x)) + 8 * int(isnull(hi.y))")
    flat = dealt(pair.select("x", "y", *parts, gaps.alias("gaps")), rows, EACH, "x", "y")
    # several pairs exactly if the least and the greatest of a part differ; numbers alone are grouped without a sort
    names = ["lox", "loy", "hix", "hiy", "gaps"]
    ends = flat.groupBy("x", "y").agg(*[f(n).alias(n + k) for n in names for f, k in ((F.min, "0"), (F.max, "1"))])
    return ends.filter(" or ".join(f"{n}0 <> {n}1" for n in names)).select("x", "y")


def lines_coords_connected(lines: DataFrame) -> DataFrame:
    """x, y where a vertex of lines (ring_id, pts) has different pairs of neighbours. Neighbours wrap around
    the line's ends."""
    rows = lines.agg(F.sum(F.greatest(F.size("pts"), F.lit(0)))).first()[0] or 0
    near = lines.select("pts", F.posexplode("pts").alias("pos", "p")).select("p.x", "p.y", F.coalesce(F.get("pts", F.col("pos") - 1), F.get("pts", F.size("pts") - 1)).alias("a"), F.coalesce(F.get("pts", F.col("pos") + 1), F.get("pts", F.lit(0))).alias("b"))
    return _differing(near, rows)


def coords_connected(verts: DataFrame) -> DataFrame:
    """The same of vertices."""
    rows = verts.count()
    w = Window.partitionBy("ring_id").orderBy("pos")
    whole = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    p = F.struct("x", "y")
    near = dealt(verts, rows, EACH, "ring_id").select("x", "y", F.coalesce(F.lag(p).over(w), F.last(p).over(whole)).alias("a"), F.coalesce(F.lead(p).over(w), F.first(p).over(whole)).alias("b"))
    return _differing(near, rows)


def segments(verts: DataFrame) -> DataFrame:
    """ring_id, pos, x1, y1, x2, y2 without those of no length."""
    w = Window.partitionBy("ring_id").orderBy("pos")
    return verts.select("ring_id", "pos", F.col("x").alias("x1"), F.col("y").alias("y1"), F.lead("x").over(w).alias("x2"), F.lead("y").over(w).alias("y2")).filter("x2 is not null and (x1 <> x2 or y1 <> y2)")


def line_segments(lines: DataFrame) -> DataFrame:
    """The same of lines (ring_id, pts, more columns), without a shuffle."""
    more = [c for c in lines.columns if c != "pts"]
    here, there = F.col("p"), F.get("pts", F.col("pos") + 1)
    ends = lines.select(*more, "pts", F.posexplode("pts").alias("pos", "p")).select(*more, "pos", here["x"].alias("x1"), here["y"].alias("y1"), there["x"].alias("x2"), there["y"].alias("y2"))
    return ends.filter("x2 is not null and (x1 <> x2 or y1 <> y2)")


def with_cells(segs: DataFrame, cell: float, pad: float = 0.0) -> DataFrame:
    """segs with the grid cells (cx, cy) that each segment passes, give or take pad: for every column of
    cells along its longer axis those between its two places there, so a segment costs as many rows as it
    is long in cells, not as many as its envelope holds."""
    steep = F.expr("abs(y2 - y1) > abs(x2 - x1)")
    pick = lambda a, b: F.when(steep, F.col(b)).otherwise(F.col(a))
    own = segs.withColumn("_s", steep).withColumn("_a1", pick("x1", "y1")).withColumn("_b1", pick("y1", "x1")).withColumn("_a2", pick("x2", "y2")).withColumn("_b2", pick("y2", "x2"))
    own = own.withColumn("_ca", F.explode(F.expr(f"sequence(floor((least(_a1, _a2) - {pad}) / {cell}), floor((greatest(_a1, _a2) + {pad}) / {cell}))")))
    inside = lambda v: f"greatest(least(_a1, _a2), least(greatest(_a1, _a2), {v}))"
    other = lambda v: f"_b1 + if(_a1 = _a2, 0D, ({inside(v)} - _a1) * ((_b2 - _b1) / (_a2 - _a1)))"
    slack = max(pad, cell * 1e-9)  # places are computed; a wider reach only costs a row
    own = own.withColumn("_u", F.expr(other(f"_ca * {cell} - {slack}"))).withColumn("_v", F.expr(other(f"(_ca + 1) * {cell} + {slack}")))
    own = own.withColumn("_cb", F.explode(F.expr(f"sequence(floor((least(_u, _v) - {slack}) / {cell}), floor((greatest(_u, _v) + {slack}) / {cell}))")))
    return own.withColumn("cx", F.expr("if(_s, _cb, _ca)")).withColumn("cy", F.expr("if(_s, _ca, _cb)")).drop("_s", "_a1", "_a2", "_b1", "_b2", "_ca", "_cb", "_u", "_v")


#: Integers up to here have products, and sums of two of them, that doubles hold exactly.
EXACT = 2.0**25


def _line_keys(exact: bool, wide: bool) -> tuple[Column, Column]:
    """Slope and offset of a segment's line. Integers: both are single divisions of exact numbers, so equal
    lines have equal keys; wide: the products go beyond doubles and are taken as decimals."""
    whole = (lambda c: c.cast("decimal(19,0)")) if wide else (lambda c: c)
    dx, dy = F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1")
    flat = F.abs(dy) <= F.abs(dx)
    run, rise = F.when(flat, dx).otherwise(dy), F.when(flat, dy).otherwise(dx)
    slope = rise / run + F.when(flat, 0.0).otherwise(10.0)  # steep lines have slopes of 9 to 11
    u, v, x, y = (whole(c) for c in (dx, dy, F.col("x1"), F.col("y1")))
    c = F.when(flat, (u * y - v * x) / u).otherwise((v * x - u * y) / v)
    if wide:
        return slope + 0.0, c
    return (slope + 0.0, c + 0.0) if exact else (F.round(slope, 7), F.round(c, 6))


def _celled(segs: DataFrame, cell: float, exact: bool, wide: bool) -> DataFrame:
    slope, offset = _line_keys(exact, wide)
    # never null, as conditions on pairs below aren't: else each column's whole expression is put into a filter
    # on nulls at the segments, a method too long to be compiled
    keyed = segs.withColumn("k1", F.coalesce(slope, F.lit(0.0))).withColumn("k2", F.coalesce(offset, F.lit(0).cast("decimal(38,0)") if wide else F.lit(0.0))).withColumn("flat", F.expr("abs(y2 - y1) <= abs(x2 - x1)"))
    keyed = keyed.withColumn("lo", F.expr("if(flat, least(x1, x2), least(y1, y2))")).withColumn("hi", F.expr("if(flat, greatest(x1, x2), greatest(y1, y2))"))
    # a cell that a segment only touches holds no piece of it; quotients beyond EXACT may be rounded to its edge
    last = F.expr(f"greatest(floor(lo / {cell}), ceil(hi / {cell}) - 1)" if exact and not wide else f"floor(hi / {cell})")
    return keyed.withColumn("cell", F.explode(F.sequence(F.floor(F.col("lo") / cell), last)))


def _exact_overlaps(segs: DataFrame, cell: float, wide: bool) -> DataFrame:
    """la < lb, px, py, qx, qy, same (direction), na, nb: each two segments that overlap once, from the cell in
    which their common piece starts. Ends are ordered along the line, so a piece runs from the later start to
    the earlier end; both are vertices."""
    swap = F.expr("if(flat, x1 > x2, y1 > y2)")
    ends = lambda a, b: F.when(F.col("swap"), F.col(b)).otherwise(F.col(a))
    own = _celled(segs, cell, True, wide).withColumn("swap", swap).select("ring_id", "n", "k1", "k2", "cell", "lo", "hi", ends("x1", "x2"), ends("y1", "y2"), ends("x2", "x1"), ends("y2", "y1"), "swap")
    side = lambda s: own.toDF(f"l{s}", f"n{s}", "k1", "k2", "cell", *[f"{s}{c}" for c in ("lo", "hi", "px", "py", "qx", "qy", "swap")])
    d = (lambda e: f"cast({e} as decimal(19,0))") if wide else (lambda e: f"({e})")
    # different lines may have equal keys
    on = lambda v: f"{d('aqx - apx')} * {d(f'b{v}y - apy')} = {d('aqy - apy')} * {d(f'b{v}x - apx')}"
    both = side("a").join(side("b"), ["k1", "k2", "cell"]).filter(f"coalesce(la < lb and alo < bhi and blo < ahi and floor(greatest(alo, blo) / {cell}) = cell and {on('p')} and {on('q')}, false)")
    start, stop = (lambda c: F.expr(f"if(alo >= blo, ap{c}, bp{c})")), (lambda c: F.expr(f"if(ahi <= bhi, aq{c}, bq{c})"))
    return both.select("la", "lb", start("x").alias("px"), start("y").alias("py"), stop("x").alias("qx"), stop("y").alias("qy"), F.expr("aswap = bswap").alias("same"), "na", "nb")


def _near_overlaps(segs: DataFrame, cell: float) -> DataFrame:
    """The same with rounded keys and a tolerance; two segments may come more than once."""
    celled = _celled(segs, cell, False, False)
    # a line near the edge of a rounding step is found in the next one too
    probe = celled.withColumn("d", F.explode(F.array(F.lit(-1), F.lit(0), F.lit(1)))).withColumn("k2", F.round(F.col("k2") + F.col("d") * 1e-6, 6)).withColumn("e", F.explode(F.array(F.lit(-1), F.lit(0), F.lit(1)))).withColumn("k1", F.round(F.col("k1") + F.col("e") * 1e-7, 7)).drop("d", "e")
    names = ["ring_id", "n", "x1", "y1", "x2", "y2", "k1", "k2", "cell"]
    a = probe.select(names).toDF("la", "na", "ax1", "ay1", "ax2", "ay2", "k1", "k2", "cell")
    b = celled.select(names).toDF("lb", "nb", "bx1", "by1", "bx2", "by2", "k1", "k2", "cell")
    both = a.join(b, ["k1", "k2", "cell"]).filter("la < lb")
    both = both.withColumn("dx", F.expr("ax2 - ax1")).withColumn("dy", F.expr("ay2 - ay1")).withColumn("dd", F.expr("dx * dx + dy * dy"))
    off = lambda p: F.abs(F.expr(f"dx * (by{p} - ay1) - dy * (bx{p} - ax1)")) <= 1e-8 * F.sqrt("dd")
    both = both.filter(off(1) & off(2))
    both = both.withColumn("t1", F.expr("((bx1 - ax1) * dx + (by1 - ay1) * dy) / dd")).withColumn("t2", F.expr("((bx2 - ax1) * dx + (by2 - ay1) * dy) / dd"))
    both = both.withColumn("lo", F.least("t1", "t2")).withColumn("hi", F.greatest("t1", "t2"))
    slack = 1e-9
    both = both.filter(F.least(F.lit(1.0), F.col("hi")) - F.greatest(F.lit(0.0), F.col("lo")) > slack)
    # ends are given as the vertex they come from, never computed
    near, far = F.expr("t1 <= t2"), F.expr("t1 > t2")
    end = lambda cond, ax, first: F.when(cond, F.col(ax)).when(first, F.col("b" + ax[1:2] + "1")).otherwise(F.col("b" + ax[1:2] + "2"))
    p_at_a, q_at_a = F.col("lo") <= slack, F.col("hi") >= 1 - slack
    return both.select(
        "la", "lb",
        end(p_at_a, "ax1", near).alias("px"), end(p_at_a, "ay1", near).alias("py"),
        end(q_at_a, "ax2", far).alias("qx"), end(q_at_a, "ay2", far).alias("qy"),
        F.expr("t2 >= t1").alias("same"), "na", "nb",
    )


def overlaps(segs: DataFrame, cell: float, exact: bool = True, wide: bool = False) -> DataFrame:
    """la < lb and the ends (px, py), (qx, qy) of every piece that segments of two lines share; same: whether
    the two run the same way; na, nb: what segs has as n."""
    return _exact_overlaps(segs, cell, wide) if exact else _near_overlaps(segs, cell)


#: Shared pieces to a task.
PIECES = 500_000


def distinct_paths(lines: DataFrame) -> DataFrame:
    """ring_id, pts of one line of each path (in either direction, closed ones from any start). Equal lines
    have no junctions with each other and the same ones with all others, so however many copies of a line
    there are, one stands for them; copies combine before the shuffle."""
    own = geom.with_canonical(lines.select("ring_id", "pts")).select("ring_id", "closed", F.col("canon").alias("path"))
    one = own.groupBy(F.xxhash64("path").alias("h"), "closed", "path").agg(F.min("ring_id").alias("ring_id"))
    return one.select("ring_id", F.expr("if(closed, concat(path, slice(path, 1, 1)), path)").alias("pts"))


def _ends(pieces: Column) -> Column:
    """The points where other than two of a pair's pieces meet; without any, the smallest point."""
    both = lambda v: F.array(v["p"], v["q"])
    is_at = lambda s, i, v: F.get(s, i).eqNullSafe(v)
    odd = lambda s: F.filter(s, lambda v, i: ~is_at(s, i - 1, v) & ~(is_at(s, i + 1, v) & ~is_at(s, i + 2, v)))
    own = lambda s: geom.let(odd(s), lambda e: F.when(F.size(e) > 0, e).otherwise(F.slice(s, F.lit(1), F.lit(1))))
    return geom.let(F.sort_array(F.flatten(F.transform(pieces, both))), own)


def lines_connected(lines: DataFrame, cell: float, exact: bool = True, wide: bool = False) -> DataFrame:
    """x, y: the ends of the paths that two lines share, of lines (ring_id, pts). exact: all coordinates are
    integers; wide: some are beyond EXACT. A merged path ends where other than two of the pair's pieces meet;
    a shared loop without such an end gives its smallest point. Pairs whose shared pieces are as long as
    either line are equal and have no ends."""
    segs = line_segments(settled(distinct_paths(lines)).withColumn("n", geom.line_length("pts")))
    found = settled(overlaps(segs, cell, exact, wide).drop("same"))
    # most pairs share one piece; it is found by numbers alone, without collecting
    rows = found.count()
    pair = dealt(found, rows, PIECES, "la", "lb").groupBy("la", "lb")
    one = pair.agg(F.count("*").alias("c"), *[F.max(v).alias(v) for v in ("px", "py", "qx", "qy", "na", "nb")]).filter("c = 1")
    one = one.select(F.array(F.struct(F.struct(F.col("px").alias("x"), F.col("py").alias("y")).alias("p"), F.struct(F.col("qx").alias("x"), F.col("qy").alias("y")).alias("q"))).alias("pieces"), "na", "nb")
    p, q = F.struct(F.expr("px + 0D").alias("x"), F.expr("py + 0D").alias("y")), F.struct(F.expr("qx + 0D").alias("x"), F.expr("qy + 0D").alias("y"))
    several = dealt(found, rows, PIECES, "la", "lb").join(pair.agg(F.count("*").alias("c")).filter("c > 1").select("la", "lb"), ["la", "lb"], "left_semi")
    several = several.groupBy("la", "lb").agg(F.collect_set(F.struct(F.least(p, q).alias("p"), F.greatest(p, q).alias("q"))).alias("pieces"), F.max("na").alias("na"), F.max("nb").alias("nb"))
    size = F.aggregate("pieces", F.lit(0.0), lambda s, v: s + F.sqrt(F.pow(v["p"]["x"] - v["q"]["x"], 2) + F.pow(v["p"]["y"] - v["q"]["y"], 2)))
    length = F.sqrt(F.pow(F.expr("pieces[0].p.x - pieces[0].q.x"), 2) + F.pow(F.expr("pieces[0].p.y - pieces[0].q.y"), 2))
    close = lambda n: F.abs(F.col("shared") - F.col(n)) <= 1e-9 * F.col(n)
    ends = lambda pairs, size, at: pairs.withColumn("shared", size).filter(~(close("na") & close("nb"))).select(F.explode(at).alias("e")).select("e.x", "e.y")
    return ends(one, length, F.expr("array(pieces[0].p, pieces[0].q)")).union(ends(several, size, _ends(F.col("pieces")))).distinct()


def path_connected(verts: DataFrame, cell: float, exact: bool = True, wide: bool = False) -> DataFrame:
    """The same of vertices."""
    return lines_connected(collected(verts, ["ring_id"]), cell, exact, wide)


def default_cell(verts: DataFrame) -> float:
    """A cell some segments long: the mean extent of the segments, twice."""
    got = segments(verts).agg(F.avg(F.expr("greatest(abs(x2 - x1), abs(y2 - y1))")).alias("m")).first()
    return 2 * got.m if got and got.m else 1.0


def envelope_pairs(verts: DataFrame, cell: float) -> DataFrame:
    """a < b: lines whose envelopes meet, found by the grid cells of the envelopes; a pair is reported
    from the first cell the two have in common, so no distinct is needed."""
    box = verts.groupBy("ring_id").agg(F.min("x").alias("x0"), F.min("y").alias("y0"), F.max("x").alias("x1"), F.max("y").alias("y1"))
    cells = box.withColumn("cx", F.explode(F.expr(f"sequence(floor(x0 / {cell}), floor(x1 / {cell}))"))).withColumn("cy", F.explode(F.expr(f"sequence(floor(y0 / {cell}), floor(y1 / {cell}))")))
    a = cells.toDF("a", "ax0", "ay0", "ax1", "ay1", "cx", "cy")
    b = cells.toDF("b", "bx0", "by0", "bx1", "by1", "cx", "cy")
    meet = "a < b and ax0 <= bx1 and bx0 <= ax1 and ay0 <= by1 and by0 <= ay1"
    first = f"cx = floor(greatest(ax0, bx0) / {cell}) and cy = floor(greatest(ay0, by0) / {cell})"
    return a.join(b, ["cx", "cy"]).filter(f"{meet} and {first}").select("a", "b")


def shared_directions(verts: DataFrame, cell: float, exact: bool = True) -> DataFrame:
    """la, lb, forward, backward: numbers of shared pieces that run the same and the opposite way."""
    pieces = overlaps(segments(verts).withColumn("n", F.lit(0.0)), cell, exact).distinct()
    return pieces.groupBy("la", "lb").agg(F.count(F.when(F.col("same"), 1)).alias("forward"), F.count(F.when(~F.col("same"), 1)).alias("backward"))
