"""Token-id output in training order.

Texts become fixed-length sequences of token ids (by default the bytes of the text plus 3, then an end,
as byte-level models have them; 0 pads). Each sequence has a number in corpus order; a keyed Feistel
permutation, walked until it falls inside the range, turns it into its global slot. Slots are cut into
ranges, one shard each, and every shard is written with a fixed stride: slot i is record i % PER_SHARD of
shard i // PER_SHARD, at that times the stride. A reader resumes at any slot without an index.

The ranges are known beforehand, so no sampling pass sorts the data, and the slots of any document are
spread evenly: neither a hot source nor a long document makes a large shard. A record is a header
(doc_id, sequence in the document, its tokens) and the padded ids.

Nulls: a null text is an empty one and gives a sequence of just the end; a null doc_id is kept as null.
Repeated rows give sequences each. An empty table gives no shards. Other columns are not read. The input
must be replayable.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from arcmesh.llm.store import arrow_batches, keyed, lean, parts, written
from arcmesh.llm.textblocks import mix64

LENGTH = 2048
PER_SHARD = 2048
#: Shards that a task writes at most, one after another; a range of slots.
RANGE = 32
PAD, END, SHIFT = 0, 1, 3
NO_ID = -(1 << 63)
HEAD = np.dtype([("doc_id", "<i8"), ("part", "<i4"), ("n", "<i4")])


def feistel(x: np.ndarray, size: int, key: int, rounds: int = 6) -> np.ndarray:
    """A keyed permutation of range(size): a balanced Feistel network over the next even number of bits,
    repeated for the values that leave the range."""
    half = np.uint64(max(1, ((max(size, 2) - 1).bit_length() + 1) // 2))
    mask = np.uint64((1 << int(half)) - 1)
    keys = mix64(np.arange(1, rounds + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(key & (2**64 - 1)))
    out = x.astype(np.uint64)
    todo = np.arange(len(out))
    while len(todo):
        left, right = out[todo] >> half, out[todo] & mask
        for k in keys:
            left, right = right, left ^ (mix64(right + k) & mask)
        out[todo] = (left << half) | right
        todo = todo[out[todo] >= size]
    return out.astype(np.int64)


def _sequences(held, length: int):
    """slot, doc_id, part, n and the bytes of each sequence."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        offsets, total, key = held.value
        at = offsets.get(TaskContext.get().partitionId(), 0)
        for batch in batches:
            rows: list[tuple[int | None, int, int, bytes]] = []
            held_bytes = 0

            def out() -> pa.RecordBatch:
                nonlocal at
                slots = feistel(np.arange(at, at + len(rows)), total, key)
                at += len(rows)
                d, p, n, b = zip(*rows, strict=True)
                return pa.RecordBatch.from_arrays([pa.array(slots), pa.array(d, pa.int64()), pa.array(p, pa.int32()), pa.array(n, pa.int32()), pa.array(b, pa.binary())], ["slot", "doc_id", "part", "n", "body"])

            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text"), strict=True):
                body = text.as_py() or b""
                for p, i in enumerate(range(0, len(body) + 1, length)):
                    rows.append((doc_id, p, min(length, len(body) + 1 - i), body[i : i + length]))
                held_bytes += len(body)
                if held_bytes > 8 << 20:
                    yield out()
                    rows, held_bytes = [], 0
            if rows:
                yield out()

    return run


def _packed(length: int, per_shard: int):
    """Sorted slots to shards: first slot, records and their bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, records, first = None, [], 0

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([shard]), pa.array([first]), pa.array([len(records)], pa.int32()), pa.array([b"".join(records)], pa.large_binary()).cast(pa.binary())], ["shard", "first_slot", "records", "data"])

        for batch in batches:
            for slot, doc_id, part, n, body in zip(*(batch.column(c).to_pylist() for c in ("slot", "doc_id", "part", "n", "body")), strict=True):
                if slot // per_shard != shard:
                    if records:
                        yield out()
                    shard, records, first = slot // per_shard, [], slot
                ids = np.full(length, PAD, "<u2")
                ids[: len(body)] = np.frombuffer(body, np.uint8)
                ids[: len(body)] += SHIFT
                if len(body) < n:
                    ids[n - 1] = END
                records.append(np.array([(NO_ID if doc_id is None else doc_id, part, n)], HEAD).tobytes() + ids.tobytes())
        if records:
            yield out()

    return run


def build(docs: DataFrame, key: int = 20240607, length: int = LENGTH, per_shard: int = PER_SHARD) -> DataFrame:
    """shard, first_slot, records, data: the shards of docs, one row each."""
    spark = docs.sparkSession
    arrow_batches(spark)
    rows = keyed(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text")))
    count = F.expr(f"(coalesce(octet_length(text), 0) div {length}) + 1")
    by_part = rows.select(F.shiftright("rk", 33).alias("p"), count.alias("n")).groupBy("p").agg(F.sum("n").alias("n")).orderBy("p").collect()  # a row per partition
    offsets, total = {}, 0
    for r in by_part:
        offsets[r.p] = total
        total += r.n
    held = spark.sparkContext.broadcast((offsets, total, key))
    sequences = rows.select("doc_id", "text").mapInArrow(lean(_sequences(held, length)), "slot long, doc_id long, part int, n int, body binary")
    shards = max(1, -(-total // per_shard))
    each = min(RANGE, -(-shards // parts(docs)))  # shards of a partition, which are neighbours
    n = -(-shards // each)
    ranges = sequences.withColumn("shard", F.expr(f"slot div {per_shard}")).repartitionById(n, F.expr(f"cast(shard div {each} as int)")).sortWithinPartitions("slot")
    return ranges.mapInArrow(lean(_packed(length, per_shard)), "shard long, first_slot long, records int, data binary")


def save(shards: DataFrame, path: str) -> None:
    """Write shards where any reader of Parquet finds them; files are cut and ordered by shard."""
    shards.write.parquet(path)


def read(spark: SparkSession, path: str, start: int = 0, per_shard: int = PER_SHARD) -> DataFrame:
    """The shards that hold slots from start on; earlier shards are skipped by the scan's filter."""
    return spark.read.parquet(path).filter(F.col("shard") >= start // per_shard)


def records(data: bytes, length: int = LENGTH) -> np.ndarray:
    """A shard's records: header fields and ids."""
    return np.frombuffer(data, np.dtype([*HEAD.descr, ("ids", "<u2", (length,))]))


def digests(shards: DataFrame, length: int = LENGTH, per_shard: int = PER_SHARD) -> DataFrame:
    """slot, shard, doc_id, part, n_tokens, ids_sha256 (the ids as 32-bit integers) of every record."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for shard, first, data in zip(b.column("shard").to_pylist(), b.column("first_slot").to_pylist(), b.column("data"), strict=True):
                found = records(data.as_py(), length)
                sums = [hashlib.sha256(r["ids"][: r["n"]].astype("<u4")).hexdigest() for r in found]
                ids = np.array(found["doc_id"])
                yield pa.RecordBatch.from_arrays(
                    [pa.array(first + np.arange(len(found))), pa.array(np.full(len(found), shard)), pa.array(ids, mask=ids == NO_ID), pa.array(np.array(found["part"])), pa.array(found["n"].astype(np.int64)), pa.array(sums, pa.string())],
                    ["slot", "shard", "doc_id", "part", "n_tokens", "ids_sha256"],
                )

    arrow_batches(shards.sparkSession)
    return shards.select("shard", "first_slot", "data").mapInArrow(lean(run), "slot long, shard long, doc_id long, part int, n_tokens long, ids_sha256 string")


def training_order(docs: DataFrame, key: int = 20240607) -> DataFrame:
    """Materialise the shards of docs in the shared folder and list their records."""
    return digests(written(build(docs, key), "shards"))
