"""Line simplification: Douglas-Peucker (1973) and Visvalingam-Whyatt (1993) in numpy over Arrow batches.
Each line is simplified alone, so this is a map without a shuffle. End points stay."""

from __future__ import annotations

import heapq
import logging
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T


def douglas_peucker(p: np.ndarray, eps: float) -> np.ndarray:
    """Rows of p that stay: a run goes if no point of it is farther than eps from the chord."""
    keep = np.zeros(len(p), bool)
    keep[[0, -1]] = True
    todo = [(0, len(p) - 1)]
    while todo:
        a, b = todo.pop()
        if b - a < 2:
            continue
        d, q = p[b] - p[a], p[a + 1 : b] - p[a]
        n = float(d @ d)
        if n == 0:
            far = np.hypot(q[:, 0], q[:, 1])
        else:  # distance to the segment, not to its line
            t = np.clip(q @ d / n, 0, 1)
            far = np.hypot(q[:, 0] - t * d[0], q[:, 1] - t * d[1])
        i = int(far.argmax())
        if far[i] > eps:
            keep[a + 1 + i] = True
            todo += [(a, a + 1 + i), (a + 1 + i, b)]
    return keep


def _empty(p: np.ndarray, keep: np.ndarray, i: int, a: int, b: int) -> bool:
    """Whether no other point that stays lies in the triangle of i and its neighbours a and b: then the
    line a to b crosses nothing that i's two sides did not."""
    corners = p[[a, i, b]]
    near = keep & ((p >= corners.min(axis=0)) & (p <= corners.max(axis=0))).all(axis=1)
    q = p[near & ~(p[:, None] == corners[None]).all(axis=2).any(axis=1)]
    if not len(q):
        return True
    side = lambda u, v: (v[0] - u[0]) * (q[:, 1] - u[1]) - (v[1] - u[1]) * (q[:, 0] - u[0])
    s = np.stack([side(corners[0], corners[1]), side(corners[1], corners[2]), side(corners[2], corners[0])])
    return not ((s >= 0).all(axis=0) | (s <= 0).all(axis=0)).any()


def visvalingam(p: np.ndarray, eps: float, careful: bool = False) -> np.ndarray:
    """Rows of p that stay: the point of the smallest triangle with its neighbours goes while its area is
    under eps; areas never fall below that of the last one gone. careful: a point stays while another one
    lies in its triangle, so no crossing comes about."""
    n = len(p)
    left, right = list(range(-1, n - 1)), list(range(1, n + 1))
    area = lambda i: abs((p[i][0] - p[left[i]][0]) * (p[right[i]][1] - p[left[i]][1]) - (p[right[i]][0] - p[left[i]][0]) * (p[i][1] - p[left[i]][1])) / 2
    keep, now = np.ones(n, bool), [np.inf] * n
    heap = []
    for i in range(1, n - 1):
        now[i] = area(i)
        heap.append((now[i], i))
    heapq.heapify(heap)
    while heap:
        a, i = heapq.heappop(heap)
        if not keep[i] or a != now[i]:
            continue
        if a >= eps:
            break
        if careful and not _empty(p, keep, i, left[i], right[i]):
            continue
        keep[i] = False
        left[right[i]], right[left[i]] = left[i], right[i]
        for j in (left[i], right[i]):
            if 0 < j < n - 1:
                now[j] = max(a, area(j))
                heapq.heappush(heap, (now[j], j))
    return keep


def simplified(p: np.ndarray, eps: float, algorithm: str, careful: bool) -> np.ndarray:
    """The points of p that stay. careful: closed lines keep four points, so
    no ring collapses, and with vw nothing comes to cross itself."""
    if len(p) < 3 or eps <= 0:
        return p
    rule = douglas_peucker if algorithm == "dp" else lambda p, eps: visvalingam(p, eps, careful)
    closed = len(p) > 3 and bool((p[0] == p[-1]).all())
    keep = rule(p, eps)
    while careful and closed and keep.sum() < 4 and eps > 1e-300:
        eps /= 2
        keep = rule(p, eps)
    return p[keep]


def chosen(package: str, algorithm: str, careful: bool) -> tuple[str, bool]:
    """The algorithm and carefulness that an option `simplify_with` stands for: with `shapely` there is dp
    alone; with `simplification` dp has no way to prevent oversimplification."""
    if package == "shapely" and algorithm == "vw":
        logging.warning("vw needs simplify_with='simplification'; lines are simplified by dp")
        return "dp", careful
    if package == "simplification" and algorithm == "dp" and careful:
        logging.warning("dp with simplify_with='simplification' does not prevent oversimplification")
        return "dp", False
    return algorithm, careful


def _batches(eps: float, algorithm: str, careful: bool, pts: str) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            column = pa.array(b.column(pts))
            off, body = column.offsets.to_numpy(), column.values
            xy = np.column_stack([body.field("x").to_numpy(), body.field("y").to_numpy()]) if len(body) else np.zeros((0, 2))
            lines = [simplified(xy[a:z], eps, algorithm, careful) for a, z in zip(off, off[1:], strict=False)]
            flat = np.concatenate(lines) if lines else np.zeros((0, 2))
            ends = np.zeros(len(lines) + 1, np.int32)
            np.cumsum([len(x) for x in lines], out=ends[1:])
            new = pa.ListArray.from_arrays(pa.array(ends), pa.StructArray.from_arrays([pa.array(flat[:, 0].copy()), pa.array(flat[:, 1].copy())], ["x", "y"]))
            yield pa.RecordBatch.from_arrays([new if c == pts else b.column(c) for c in b.schema.names], b.schema.names)

    return run


def simplify(lines: DataFrame, eps: float, algorithm: str = "dp", prevent_oversimplify: bool = True, pts: str = "pts") -> DataFrame:
    """lines with simpler pts. eps is a distance for dp and an area for vw."""
    if algorithm not in ("dp", "vw"):
        raise NameError(f"algorithm {algorithm!r}: dp or vw")
    if not eps:
        return lines
    kind = T.ArrayType(T.StructType([T.StructField("x", T.DoubleType()), T.StructField("y", T.DoubleType())]))
    schema = T.StructType([T.StructField(f.name, kind if f.name == pts else f.dataType) for f in lines.schema])
    return lines.mapInArrow(_batches(eps, algorithm, prevent_oversimplify, pts), schema)
