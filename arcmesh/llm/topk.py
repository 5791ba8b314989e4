"""Exact top-k inner-product search by pivot-table elimination.

The table of pivots is made once: every vector is written with its distances to PIVOTS pivots. For a query
q and a candidate x the largest |d(q, p) - d(x, p)| over the pivots bounds d(q, x) from below, and
q.x = (|q|^2 + |x|^2 - d(q, x)^2) / 2 turns that into an upper bound of the score. A task holds each query's
k best so far; candidates whose bound is under the k-th are eliminated, the others are evaluated in the
order of their bound, a slice at a time, until the bound falls below the k-th best score: what is left
cannot enter, and the result is exact for any pivots.

Queries are packed into blocks of about QUERY_BYTES of vectors, which are what is broadcast, SCANS of them
at a time; a scan of the vectors returns k rows per query and partition, and a window keeps the k best.

Vectors become floor(1024 * x). Scores are summed as doubles where no sum can reach 2^53, else as Python
integers, so finite components of any size take part: rows that hold one of WIDE or more after scaling have
no bounds and are always evaluated. The order is that of the exact integers; a score beyond 64 bits is
returned as the nearest 64-bit integer.

Nulls: vectors that are null or hold null or non-finite components take no part, nor do rows without
vec_id; neither do candidates of another length than the query. Ties go to the smaller vec_id; rows with
the query's vec_id are its own. Repeated candidate rows count once each; a repeated query id is searched
once, by its first vector in array order. Empty tables give empty results. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from arcmesh.llm.store import arrow_batches, lean, written

PIVOTS = 16
#: Bytes of the vectors of a block of queries, and blocks searched in one job.
QUERY_BYTES, SCANS = 4 << 20, 8
#: Rows that pivots are picked from; the result does not depend on them.
PIVOT_POOL = 256
#: Candidates evaluated between two looks at the bound.
SLICE = 256
SCALE = 1024
WIDE = 2.0**40
FOUND = "query_id long, vec_id long, score long, exact binary"


def whole_vectors(vectors: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """vec_id, v (array<double>) of the vectors that take part."""
    x = F.col(embedding).cast("array<double>")
    usable = x.isNotNull() & F.col(vec_id).isNotNull() & F.forall(x, lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) != F.lit(float("inf"))))
    return vectors.filter(F.coalesce(usable, F.lit(False))).select(F.col(vec_id).cast("long").alias("vec_id"), x.alias("v"))


def pick_pivots(pool: np.ndarray, n: int) -> np.ndarray:
    """Farthest-first pivots from a pool of vectors."""
    if not len(pool):
        return pool
    at = [0]
    near = np.linalg.norm(pool - pool[0], axis=1)
    while len(at) < min(n, len(pool)):
        at.append(int(near.argmax()))
        near = np.minimum(near, np.linalg.norm(pool - pool[at[-1]], axis=1))
    return pool[at]


def scaled(x: np.ndarray) -> np.ndarray:
    """floor(1024 * x) as doubles, without overflow: where that would leave the doubles, x itself is far
    beyond WIDE, and integers() gives its exact value."""
    with np.errstate(over="ignore"):
        return np.floor(x * SCALE)


def integers(x: np.ndarray) -> list[int]:
    """floor(1024 * x) of one vector, exactly."""
    return [int(np.floor(v * SCALE)) if abs(v) < 2.0**52 else int(v) * SCALE for v in x.tolist()]


def distances(x: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    """Distances of scaled vectors to the pivots; of wide ones none (NaN)."""
    out = np.full((len(x), len(pivots)), np.nan)
    own = np.flatnonzero((np.abs(x) < WIDE).all(axis=1))
    for i, p in enumerate(pivots):
        out[own, i] = np.linalg.norm(x[own] - p, axis=1)
    return out


def by_length(column: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Length, rows and matrix of the vectors of each length."""
    off, flat = column.offsets.to_numpy(), column.values.to_numpy(zero_copy_only=False)
    lengths = np.diff(off)
    for n in np.unique(lengths):
        at = np.flatnonzero(lengths == n)
        yield int(n), at, flat[off[at][:, None] + np.arange(n)[None]]


def _tabled(held):
    """vec_id, v and d: the distances to the pivots of the vector's length."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            d: list = [[]] * batch.num_rows
            for n, at, x in by_length(pa.array(batch.column("v"))):
                for i, row in zip(at.tolist(), distances(scaled(x), held.value.get(n, np.zeros((0, n)))), strict=True):
                    d[i] = row
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), batch.column("v"), pa.array(d, pa.list_(pa.float64()))], ["vec_id", "v", "d"])

    return run


def scores(raw: np.ndarray, rows: np.ndarray, q_raw: np.ndarray, q: np.ndarray) -> list[int]:
    """Exact inner products of candidates and a query, each as given and scaled."""
    if not len(rows):
        return []
    if float(np.abs(rows).max(initial=0)) * float(np.abs(q).sum()) < 2**53:
        return (rows @ q).astype(np.int64).tolist()
    own = integers(q_raw)
    return [sum(a * b for a, b in zip(integers(r), own, strict=True)) for r in raw]


def improved(best: list[tuple[int, int]], q_id: int, q_raw: np.ndarray, q: np.ndarray, ids: np.ndarray, raw: np.ndarray, rows: np.ndarray, k: int, lower: np.ndarray, norms: np.ndarray) -> list[tuple[int, int]]:
    """The k best of (score, vec_id): those so far and the candidates. lower: lower bounds of the distances
    to q, NaN where there is none; norms: the candidates' squared lengths."""
    qq = float(q @ q)
    upper = (qq + norms - lower * lower) / 2
    upper = upper + 1e-9 * (qq + norms) + 1e-6  # the bounds are floating point
    upper = np.where(np.isnan(upper), np.inf, upper)
    alive = np.flatnonzero((ids != q_id) & (upper >= best[-1][0])) if len(best) == k else np.flatnonzero(ids != q_id)
    order = alive[np.argsort(-upper[alive], kind="stable")]
    for a in range(0, len(order), SLICE):
        at = order[a : a + SLICE]
        if len(best) == k and upper[at[0]] < best[-1][0]:
            break
        best = best + list(zip(scores(raw[at], rows[at], q_raw, q), ids[at].tolist(), strict=True))
        best = sorted(best, key=lambda x: (-x[0], x[1]))[:k]
    return best


def sortable(n: int) -> bytes:
    """Bytes that are ordered as the integers are."""
    body = abs(n).to_bytes((abs(n).bit_length() + 7) // 8, "big")
    head = len(body).to_bytes(2, "big")
    return b"\x01" + head + body if n >= 0 else b"\x00" + bytes(255 - x for x in head + body)


def _search(held, k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        queries, pivots = held.value  # length -> (ids, vectors), length -> pivots
        ready = {n: (ids, raw, scaled(raw), distances(scaled(raw), pivots.get(n, np.zeros((0, n))))) for n, (ids, raw) in queries.items()}
        best: dict[int, list[tuple[int, int]]] = {}
        for batch in batches:
            ids, d = batch.column("vec_id").to_numpy(), pa.array(batch.column("d"))
            d_off, d_flat = d.offsets.to_numpy(), d.values.to_numpy(zero_copy_only=False)
            for n, at, raw in by_length(pa.array(batch.column("v"))):
                if n not in ready:
                    continue
                q_ids, q_raw, qs, to_q = ready[n]
                rows, to_x = scaled(raw), d_flat[d_off[at][:, None] + np.arange(to_q.shape[1])[None]]
                with np.errstate(over="ignore", invalid="ignore"):
                    norms = np.where((np.abs(rows) < WIDE).all(axis=1), (rows**2).sum(axis=1), np.nan)
                    for i, q_id in enumerate(q_ids.tolist()):
                        lower = np.abs(to_x - to_q[i]).max(axis=1) if to_q.shape[1] else np.zeros(len(at))
                        best[q_id] = improved(best.get(q_id, []), q_id, q_raw[i], qs[i], ids[at], raw, rows, k, lower, norms)
        out = [(q, x, min(max(s, -(2**63)), 2**63 - 1), sortable(s)) for q, found in best.items() for s, x in found]
        for a in range(0, max(1, len(out)), 50_000):
            cols = list(zip(*out[a : a + 50_000], strict=True)) if out else [()] * 4
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int64(), pa.int64(), pa.binary()), strict=True)], ["query_id", "vec_id", "score", "exact"])

    return run


def top_k(vectors: DataFrame, k: int = 10, every: int = 100, pivots: int = PIVOTS, query_block: int | None = None, scans: int = SCANS) -> DataFrame:
    """query_id, rank, vec_id, score: for each row whose id divides by `every`, the k highest scores.
    query_block: queries in a block, else as many as QUERY_BYTES hold."""
    spark = vectors.sparkSession
    arrow_batches(spark)
    plain = whole_vectors(vectors)
    pool: dict[int, list] = {}
    for r in plain.orderBy(F.xxhash64("vec_id"), "vec_id").limit(PIVOT_POOL).collect():
        pool.setdefault(len(r.v), []).append(r.v)
    tables = {}
    for n, v in pool.items():
        x = scaled(np.array(v, np.float64).reshape(len(v), n))
        tables[n] = pick_pivots(x[(np.abs(x) < WIDE).all(axis=1)], pivots) if n else np.zeros((0, 0))
    rows = written(plain.mapInArrow(lean(_tabled(spark.sparkContext.broadcast(tables))), "vec_id long, v array<double>, d array<double>"), "vectors")
    asked = rows.filter(F.col("vec_id") % every == 0).groupBy("vec_id").agg(F.min("v").alias("v"))
    longest = asked.agg(F.max(F.size("v"))).first()[0] or 1
    size = query_block or max(1, QUERY_BYTES // (8 * longest))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("exact"), "vec_id"))
    out, last, more = [], None, True
    while more:  # blocks of queries in id order, each of a bounded size; some are searched in one job
        found = []
        while more and len(found) < scans:
            block = (asked if last is None else asked.filter(F.col("vec_id") > last)).orderBy("vec_id").limit(size).collect()
            more = len(block) == size
            if not block:
                break
            last = block[-1].vec_id
            by: dict[int, tuple[list, list]] = {}
            for r in block:
                own = by.setdefault(len(r.v), ([], []))
                own[0].append(r.vec_id)
                own[1].append(r.v)
            held = spark.sparkContext.broadcast(({n: (np.array(i, np.int64), np.array(v, np.float64).reshape(len(i), n)) for n, (i, v) in by.items()}, tables))
            found.append(rows.mapInArrow(lean(_search(held, k)), FOUND))
        if found:
            whole = found[0]
            for f in found[1:]:
                whole = whole.union(f)
            ranked = whole.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
            out.append(written(ranked, "found") if more else ranked)
    if not out:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    whole = out[0]
    for f in out[1:]:
        whole = whole.union(f)
    return whole
