"""Exact dedup by skew-safe combining.

Copies are first dropped inside each partition, the remaining ones meet in salted digest groups, and
the winners of the salts meet in one group per digest. The whole (compressed) content is a grouping
key at every stage, so two texts of one digest never merge; two contents that share both digests raise.
So digests stand for contents where the winners go back to the members. A group of copies sends one row
per partition into the shuffle, whatever its size, and its winner goes back to each of the salts that its
members are dealt to.

Nulls: a null text is an empty one; a null doc_id loses ties and is kept as null. Empty texts form one
group. Repeated rows count as members of their group. An empty table gives an empty result. Columns
other than doc_id and text are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from arcmesh.llm.store import arrow_batches, keyed, lean
from arcmesh.llm.textblocks import NOT_SPACE, buffers, chunks

#: Content bytes that a task holds before it hands its local winners on.
HELD = 48 << 20
#: Salts of the middle stage and of the join back; a row's salt follows from its partition.
SALTS = 256


def _normal(batch: pa.RecordBatch) -> Iterator[tuple[int, bytes, bytes, bytes, int]]:
    """Row, digest, second digest, normalised text and code points of the original."""
    off, raw = buffers(batch.column("text"))
    for a, b in chunks(off):
        own, part = off[a : b + 1] - off[a], raw[off[a] : off[b]]
        keep = NOT_SPACE[part]
        cum = np.zeros(len(part) + 1, np.int64)
        np.cumsum(keep, out=cum[1:])
        ends, text = cum[own], part[keep].tobytes()
        np.cumsum((part & 0xC0) != 0x80, out=cum[1:])
        points = np.diff(cum[own])
        for i in range(b - a):
            body = text[ends[i] : ends[i + 1]]
            yield a + i, hashlib.sha256(body).digest(), hashlib.blake2b(body, digest_size=16).digest(), body, int(points[i])


def _members(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = [(d, e) for _, d, e, _, _ in _normal(batch)]
        yield pa.RecordBatch.from_arrays([batch.column("rk"), batch.column("doc_id"), pa.array([r[0] for r in rows], pa.binary()), pa.array([r[1] for r in rows], pa.binary())], ["rk", "doc_id", "digest", "second"])


def _local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Local stage: one row per distinct content that the task has seen since it last handed rows on."""
    import zstandard
    from pyspark import TaskContext

    pack, salt = zstandard.ZstdCompressor(level=3).compress, TaskContext.get().partitionId() % SALTS
    best: dict[tuple[bytes, bytes], list] = {}
    held = 0

    def out() -> pa.RecordBatch:
        rows = [(*k, salt, *v) for k, v in best.items()]
        cols = list(zip(*rows, strict=True)) if rows else [()] * 9
        kinds = (pa.binary(), pa.binary(), pa.int32(), pa.binary(), pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.int64())
        names = ("digest", "second", "salt", "content", "neg", "no_id", "doc_id", "rk", "n")
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], list(names))

    for batch in batches:
        ids, keys = batch.column("doc_id").to_pylist(), batch.column("rk").to_pylist()
        for i, digest, second, body, points in _normal(batch):
            rank = (-points, ids[i] is None, ids[i] if ids[i] is not None else 0, keys[i])
            own = best.get((digest, second))
            if own is None:
                best[digest, second] = own = [pack(body), *rank, 1]
                held += len(own[0]) + 200
            else:
                own[-1] += 1
                if own[0] != pack(body):
                    raise ValueError("two texts share SHA-256 and BLAKE2 digests")
                if rank < tuple(own[1:5]):
                    own[1:5] = rank
        if held > HELD:
            yield out()
            best.clear()
            held = 0
    if best:
        yield out()


def winners(docs: DataFrame) -> DataFrame:
    """digest, second, keep_id, keep_rk, group_size, salts: a row for each distinct normalised text."""
    arrow_batches(docs.sparkSession)
    rows = keyed(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text")))
    local = rows.mapInArrow(lean(_local), "digest binary, second binary, salt int, content binary, neg long, no_id boolean, doc_id long, rk long, n long")
    best = F.min(F.struct("neg", "no_id", "doc_id", "rk")).alias("best")
    salted = local.groupBy("digest", "second", "salt", "content").agg(best, F.sum("n").alias("n")).select("digest", "second", "salt", "content", "best.*", "n")
    whole = salted.repartition("digest", "second").groupBy("digest", "second", "content").agg(best, F.sum("n").alias("n"), F.collect_set("salt").alias("salts"))
    one = whole.groupBy("digest", "second").agg(F.count("*").alias("texts"), F.first("best").alias("best"), F.first("n").alias("group_size"), F.first("salts").alias("salts"))
    sure = F.when(F.col("texts") > 1, F.raise_error(F.lit("two texts share SHA-256 and BLAKE2 digests"))).otherwise(F.col("best.rk"))
    return one.select("digest", "second", F.expr("if(best.no_id, null, best.doc_id)").alias("keep_id"), sure.cast("long").alias("keep_rk"), "group_size", "salts")


def exact_dedup(docs: DataFrame) -> DataFrame:
    """rk, doc_id, keep_id, keep_rk, group_size, kept, text_sha256 for each row of docs. Texts are equal
    without `[\\x20\\x09-\\x0D]`; the row with the most code points, then the smallest doc_id, stays."""
    arrow_batches(docs.sparkSession)
    rows = keyed(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text")))
    members = rows.mapInArrow(lean(_members), "rk long, doc_id long, digest binary, second binary")
    members = members.withColumn("salt", F.pmod(F.shiftright("rk", 33), F.lit(SALTS)).cast("int"))
    back = winners(docs).withColumn("salt", F.explode("salts")).drop("salts")
    return members.join(back, ["digest", "second", "salt"]).select("rk", "doc_id", "keep_id", "keep_rk", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), F.lower(F.hex("digest")).alias("text_sha256"))


def keep_first(docs: DataFrame) -> DataFrame:
    """docs, with all its columns, less every copy: one row of each group stays, repeated rows too."""
    from arcmesh.llm.store import fresh

    rk = fresh(docs, "rk")
    kept = winners(docs).select(F.col("keep_rk").alias(rk))
    return keyed(docs, rk).join(kept, rk, "left_semi").drop(rk)
