"""Mixing sources to target weights as a min-cost flow.

Documents are aggregated by membership pattern (the set of sources that a document belongs to). Token
capacity flows from patterns to source quotas; the first copy of a pattern costs nothing, each further
copy costs more (convex), so nothing is repeated while fresh tokens are left. Then documents of each
pattern are selected in the order of a seeded hash: each that fits what is still open of the pattern's
flow is taken, through all of the pattern, so in the end none that is left fits.

The driver holds one row per pattern (checked against MAX_PATTERNS); everything per document stays in
Spark. Selection needs no global sort: bucket sums of the hash find the bucket where a pattern's share
ends and only that bucket is ordered; this is repeated behind it with what fits the rest.

Nulls: a null text has size 0; a null source is a source of its own, ordered last; a null doc_id is
hashed as such. Ties of the hash go by row key. Empty tables give empty results; other columns are not
read. A document of size 0 is taken 0 words.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from arcmesh.llm.store import arrow_batches, forget, keyed, lean, local, settle, written
from arcmesh.llm.textblocks import word_counts

MAX_PATTERNS = 200_000
#: Hash buckets of a pattern; only the one where its share ends is ordered.
BUCKETS = 4096
#: Comes behind every hash and row key of a bucket.
LAST = 2**63 - 1
CUTS = "pat int, gap double, b int, h long, rk long"
GAPS = pa.schema([("pat", pa.int32()), ("gap", pa.float64()), ("behind", pa.int32())])
PLAN = pa.schema([("pat", pa.int32()), ("sources", pa.list_(pa.string())), ("source_size", pa.int64()), ("target", pa.float64()), ("full", pa.int32()), ("rest", pa.float64())])
TAKEN = pa.schema([("pat", pa.int32()), ("cuts", pa.list_(pa.struct([("gap", pa.float64()), ("b", pa.int32()), ("h", pa.int64()), ("rk", pa.int64())])))])
EDGES = pa.schema([("pat", pa.int32()), ("gap", pa.float64()), ("b", pa.int32()), ("h", pa.int64()), ("rk", pa.int64()), ("after", pa.float64())])
COPIES = 2


def _sizes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        yield pa.RecordBatch.from_arrays([b.column("rk"), b.column("doc_id"), b.column("sources"), pa.array(word_counts(b.column("text")))], ["rk", "doc_id", "sources", "size"])


def sized(docs: DataFrame, sources: str | None = None) -> DataFrame:
    """rk, doc_id, sources (array), size. `sources`: an array column, else the column source."""
    arrow_batches(docs.sparkSession)
    member = F.array_sort(F.array_distinct(F.col(sources))) if sources else F.array(F.col("source"))
    return keyed(docs.select(F.col("doc_id").cast("long").alias("doc_id"), member.cast("array<string>").alias("sources"), F.col("text").cast("binary").alias("text"))).mapInArrow(lean(_sizes), "rk long, doc_id long, sources array<string>, size long")


def targets(sizes: dict[str | None, int], weights: Sequence[float] = (5, 2, 1), share: float = 1.5, most: float = COPIES) -> dict[str | None, float]:
    """Quotas: weights repeat over the sources by code point, null last; a quota above `most` times its
    source's size stops there and the excess is shared again by weight until none is above."""
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    total, out, free = share * sum(sizes.values()), {}, list(order)
    while free:
        left, w = total - sum(out.values()), sum(weight[s] for s in free)
        over = [s for s in free if left * weight[s] / w > most * sizes[s]]
        if not over:
            out |= {s: left * weight[s] / w for s in free}
            break
        out |= {s: float(most * sizes[s]) for s in over}
        free = [s for s in free if s not in out]
    return out


def flow(patterns: dict[tuple, int], quota: dict[str | None, float], copies: int = COPIES) -> dict[tuple, float]:
    """Tokens taken of each pattern: a min-cost flow, copy c of a token costing c. Costs sit on the
    patterns alone, so the copies are routed level by level, each by augmenting paths: from a pattern
    to a source with need, if it must be by sending an earlier pattern's tokens to another of its
    sources."""
    order = sorted(patterns, key=lambda p: [(s is None, s or "") for s in p])
    rank = {p: i for i, p in enumerate(order)}
    taken: dict[tuple, float] = dict.fromkeys(order, 0.0)
    sent: dict[tuple[tuple, str | None], float] = {}
    need = dict(quota)
    users: dict[str | None, set] = {s: set() for s in quota}
    for level in range(copies):
        for p in sorted(order, key=lambda p: (len(p), rank[p])):
            while (cap := (level + 1) * patterns[p] - taken[p]) > 1e-9:
                came: dict[str | None, tuple] = {s: (p, ()) for s in p}  # source -> pattern that reaches it, (the source it leaves)
                queue, found = list(p), []
                for s in queue:
                    if need[s] > 1e-9:
                        found = [s]
                        break
                    for q in sorted(users[s], key=rank.get):
                        for t in q:
                            if t not in came:
                                came[t] = (q, (s,))
                                queue.append(t)
                if not found:
                    break
                path, s = [], found[0]
                while True:
                    q, left = came[s]
                    path.append((q, left, s))
                    if not left:
                        break
                    s = left[0]
                amount = min([cap, need[found[0]], *(sent[q, left[0]] for q, left, _ in path if left)])
                for q, left, s in path:
                    if left:
                        sent[q, left[0]] -= amount
                        if sent[q, left[0]] <= 1e-9:
                            users[left[0]].discard(q)
                    sent[q, s] = sent.get((q, s), 0.0) + amount
                    if len(q) > 1:
                        users[s].add(q)
                taken[p] += amount
                need[found[0]] -= amount
    return taken


def _edges(t: pa.Table) -> pa.Table:
    """Cuts of the bucket where a pattern's share ends: before each document that is too large for what
    is open then but not for what was open at the cut before, and behind the bucket (`after`: what is open there)."""
    t = t.sort_by([("h", "ascending"), ("rk", "ascending")])
    pat, gap, bucket = (t.column(c)[0].as_py() for c in ("pat", "gap", "b"))
    out, left = [], t.column("open")[0].as_py()
    for h, rk, size in zip(*(t.column(c).to_pylist() for c in ("h", "rk", "size")), strict=True):
        if left < size <= gap:
            out.append((pat, gap, bucket, h, rk, left))
            gap = left
        elif size <= gap:
            left -= size
    out.append((pat, gap, bucket, LAST, LAST, left))
    return pa.table([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), EDGES, strict=True)], schema=EDGES)


def _cuts(docs: DataFrame, gaps: dict[int, float]) -> list[tuple]:
    """Rows of CUTS: a document of docs (pat, b, h, rk, size) is taken if it lies before a cut of its pattern and is
    at most that cut's gap. That takes, in the order of b, h and rk, each document that fits what is still open of gaps."""
    spark = docs.sparkSession
    cuts: list[tuple] = []
    behind = dict.fromkeys(gaps, -1)
    while gaps := {k: g for k, g in gaps.items() if g >= 1}:
        settle(spark)
        now = F.broadcast(local(spark, [(k, g, behind[k]) for k, g in gaps.items()], GAPS))
        left = docs.select("pat", "b", "h", "rk", "size").join(now, "pat").filter("b > behind and size <= gap")
        sums = left.groupBy("pat", "b", "gap").agg(F.sum("size").alias("n"))
        upto = sums.withColumn("before", F.sum("n").over(Window.partitionBy("pat").orderBy("b")) - F.col("n"))
        edge = upto.filter("before <= gap and before + n > gap").selectExpr("pat", "b", "gap - before as open")  # a row per pattern at most
        found = left.join(F.broadcast(edge), ["pat", "b"]).groupBy("pat").applyInArrow(_edges, CUTS + ", after double").collect()
        behind = {r.pat: r.b for r in found}
        cuts += [(k, g, BUCKETS, 0, 0) for k, g in gaps.items() if k not in behind]  # all of it fits
        cuts += [tuple(r)[:5] for r in found]
        gaps = {r.pat: r.after for r in found if r.h == r.rk == LAST}
    return cuts


def mix(docs: DataFrame, weights: Sequence[float] = (5, 2, 1), share: float = 1.5, seed: int = 7, sources: str | None = None) -> DataFrame:
    """rk, doc_id, sources, size, source_size, target, taken: the words the mix takes of each document,
    a whole multiple of its size up to 2. source_size and target are those of its first source."""
    spark = docs.sparkSession
    base = written(sized(docs, sources), "sizes")
    seen = base.groupBy("sources").agg(F.sum("size").alias("n")).limit(MAX_PATTERNS + 1).collect()
    if len(seen) > MAX_PATTERNS:
        raise ValueError(f"more than {MAX_PATTERNS} membership patterns; group the sources first")
    patterns = {tuple(r.sources): int(r.n) for r in seen}
    sizes: dict[str | None, int] = {}
    for p, n in patterns.items():
        for s in p:
            sizes[s] = sizes.get(s, 0) + n
    quota = targets(sizes, weights, share)
    taken = flow(patterns, quota)
    rows = []
    for k, (p, n) in enumerate(patterns.items()):
        full = min(COPIES, int(taken[p] // n)) if n else 0
        rows.append((k, list(p), sizes[p[0]] if p else 0, quota[p[0]] if p else 0.0, full, float(taken[p] - full * n) if full < COPIES else 0.0))
    plan = local(spark, rows, PLAN)
    # nulls inside arrays compare equal in a join only through a text form
    text = F.to_json(F.struct(F.col("sources")))
    plan = F.broadcast(plan.withColumn("p", text).drop("sources"))  # at most MAX_PATTERNS rows
    h = F.xxhash64(F.lit(seed), F.col("doc_id"))
    placed = written(base.withColumn("p", text).join(plan, "p").drop("p").withColumn("h", h).withColumn("b", F.shiftrightunsigned("h", 52).cast("int")), "placed")
    forget(base)
    cuts: dict[int, list[dict]] = {}
    for pat, gap, b, h, rk in _cuts(placed.filter("rest > 0 and size > 0"), {k: r[5] for k, r in enumerate(rows) if r[5] > 0}):
        cuts.setdefault(pat, []).append({"gap": gap, "b": b, "h": h, "rk": rk})
    done = placed.join(F.broadcast(local(spark, list(cuts.items()), TAKEN)), "pat", "left")  # a few cuts per pattern
    fits = "exists(cuts, c -> size <= c.gap and (b < c.b or (b = c.b and (h < c.h or (h = c.h and rk < c.rk)))))"
    return done.select("rk", "doc_id", "sources", "size", "source_size", "target", F.expr(f"size * (full + if(rest > 0 and coalesce({fits}, false), 1, 0))").cast("long").alias("taken"))
