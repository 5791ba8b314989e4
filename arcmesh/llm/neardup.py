"""MinHash near-dedup with tensored banding.

Two small collections of m band hashes (of `rows` minhashes each) are computed per document; the m * m
pairs of one hash from either make the table keys, so m * m tables of 2 * rows minhashes cost 2 * m * rows
minhashes. Documents of equal shingle sets are one class from the start. In each bucket every class is
first held against the bucket's smallest and largest (its hubs); after the links so found, only classes of
a bucket that are still in different components are held against each other, once and only where their
sketches agree, so a large group of near copies costs a link per member and not all pairs. All links are
confirmed on the full shingle sets.

With the defaults a pair of similarity 0.8 shares no table with probability 7e-5. Before the full comparison
pairs are left out by sketches of 64 * LONGS bits. For sets of up to LARGE shingles a bit is the parity of the
shingles of one hash value: two sketches differ in no more bits than the sets do in shingles, so no pair of the
wanted similarity is lost, and few others are left. For larger sets a bit is one of a further minhash: those of
similarity J agree in (1 + J) / 2 of them, and a pair is left out only if they agree 4.5 standard deviations
less often than at 0.8 (4e-6). A pair of either kind is compared in full.

Nulls: a null text has no shingles and is linked with nothing, as are empty texts; a null doc_id is kept
and is a component's id only if no member has one. Repeated rows are one class. Empty tables give empty
results. Other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from arcmesh.llm.graph import components
from arcmesh.llm.store import arrow_batches, forget, fresh, keyed, lean, written
from arcmesh.llm.textblocks import buffers, chunks, hash_words, mix64, rolling, words

#: Band hashes in each of the two collections, and minhashes in a band hash.
BANDS, ROWS = 10, 2
PERCENT = 80
#: Salts that the classes of a bucket are dealt to.
SALTS = 32
#: Bits of a sketch / 64, the shingles beyond which it is of minhashes, and the bits of these that must agree.
LONGS = 16
LARGE = 64 * LONGS
AGREE = int(64 * LONGS * (0.9 - 4.5 * (0.09 / (64 * LONGS)) ** 0.5))


def shingle_sets(texts: pa.Array, width: int) -> Iterator[tuple[int, np.ndarray]]:
    """Row and sorted distinct shingle hashes; fewer words than width make one shingle of them all."""
    off, raw = buffers(texts)
    for a, b in chunks(off):
        found, per = words(off[a : b + 1] - off[a], raw[off[a] : off[b]])
        h = hash_words(found)
        rolled = rolling(h, width)
        ends = np.cumsum(per)
        for i in range(b - a):
            n, end = int(per[i]), int(ends[i])
            if n >= width:
                yield a + i, np.unique(rolled[end - n : end - width + 1])
            elif n:
                yield a + i, mix64(rolling(h[end - n : end], n) + np.uint64(n))
            else:
                yield a + i, np.zeros(0, np.uint64)


def _signatures(width: int, bands: int, rows: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        draw = np.random.default_rng(20240607)
        k = 2 * bands * rows
        mul = draw.integers(0, 1 << 32, k, dtype=np.uint32) | np.uint32(1)
        flip = draw.integers(0, 1 << 32, k, dtype=np.uint32)
        for batch in batches:
            sets = [s for _, s in shingle_sets(batch.column("text"), width)]
            n = np.array([len(s) for s in sets], np.int64)
            least = np.zeros((len(sets), k), np.uint32)
            have = np.flatnonzero(n)
            for at in range(0, len(have), 500):
                own = have[at : at + 500]
                flat = (np.concatenate([sets[i] for i in own]) >> np.uint64(32)).astype(np.uint32)
                starts = np.cumsum(n[own]) - n[own]
                for j in range(k):
                    least[own, j] = np.minimum.reduceat((flat ^ flip[j]) * mul[j], starts)
            digests = [hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None for s in sets]
            flat = pa.array(least.reshape(-1).view(np.int32))
            yield pa.RecordBatch.from_arrays([batch.column("rk"), batch.column("doc_id"), pa.array(n), pa.array(digests, pa.binary()), pa.ListArray.from_arrays(pa.array(np.arange(len(sets) + 1, dtype=np.int32) * k), flat)], ["rk", "doc_id", "n", "digest", "sig"])

    return run


def sketches(sets: list[np.ndarray]) -> np.ndarray:
    """LONGS words of minhash bits of each set (not empty)."""
    draw = np.random.default_rng(7)
    k = 64 * LONGS
    flip, mul, pick = (draw.integers(0, 1 << 32, k, dtype=np.uint32) | np.uint32(f) for f in (0, 1, 1))
    out = np.zeros((len(sets), LONGS), np.uint64)
    for at in range(0, len(sets), 400):
        own = sets[at : at + 400]
        n = np.array([len(x) for x in own])
        flat = (np.concatenate(own) >> np.uint64(32)).astype(np.uint32)
        starts = np.cumsum(n) - n
        for j in range(k):
            least = np.minimum.reduceat((flat ^ flip[j]) * mul[j], starts)
            out[at : at + 400, j // 64] |= (least * pick[j] >> np.uint32(31)).astype(np.uint64) << np.uint64(j % 64)
    return out


def parities(sets: list[np.ndarray]) -> np.ndarray:
    """LONGS words of parity bits of each set: a bit is set if an odd number of shingles falls on it."""
    owner = np.repeat(np.arange(len(sets)), [len(x) for x in sets])
    flat = np.concatenate(sets) if sets else np.zeros(0, np.uint64)
    at = owner * (64 * LONGS) + (flat % np.uint64(64 * LONGS)).astype(np.int64)
    odd = (np.bincount(at, minlength=len(sets) * 64 * LONGS) & 1).astype(np.uint8)
    return np.packbits(odd, bitorder="little").view("<u8").reshape(len(sets), LONGS)


def _sets(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [s for _, s in shingle_sets(batch.column("text"), width)]
            ends = np.zeros(len(sets) + 1, np.int32)
            np.cumsum([len(s) for s in sets], out=ends[1:])
            flat = np.concatenate(sets) if sets else np.zeros(0, np.uint64)
            large = np.diff(ends) > LARGE
            own = parities(sets)
            own[large] = sketches([sets[i] for i in np.flatnonzero(large)])
            bits = pa.ListArray.from_arrays(pa.array(np.arange(len(sets) + 1, dtype=np.int32) * LONGS), pa.array(own.reshape(-1).view(np.int64)))
            yield pa.RecordBatch.from_arrays([batch.column("rk"), pa.array(np.diff(ends).astype(np.int64)), bits, pa.ListArray.from_arrays(pa.array(ends), pa.array(flat.view(np.int64)))], ["cid", "n", "bits", "shingles"])

    return run


def _alike(a: str, b: str):
    """Whether the sizes and sketches of two columns (struct of n and bits) allow the similarity."""
    n, m = F.col(f"{a}.n"), F.col(f"{b}.n")
    apart = sum((F.bit_count(F.get(F.col(f"{a}.bits"), F.lit(i)).bitwiseXOR(F.get(F.col(f"{b}.bits"), F.lit(i)))) for i in range(LONGS)), F.lit(0))
    sizes = 100 * F.least(n, m) >= PERCENT * F.greatest(n, m)
    # sets that differ in d shingles share (n + m - d) / 2 of a union of (n + m + d) / 2
    most = F.when(n > LARGE, F.lit((64 * LONGS - AGREE) * (100 + PERCENT))).otherwise((100 - PERCENT) * (n + m))
    return sizes & (((n > LARGE) != (m > LARGE)) | ((100 + PERCENT) * apart <= most))


def _confirmed(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """pairs (a, b) whose full shingle sets are similar enough."""
    both = pairs.join(sets.toDF("b", "tb"), "b").join(sets.toDF("a", "ta"), "a")
    shared = F.size(F.array_intersect("ta", "tb"))
    return both.withColumn("shared", shared).filter(100 * F.col("shared") >= PERCENT * (F.size("ta") + F.size("tb") - F.col("shared"))).select("a", "b")


def table_key(i, x, j, y):
    """Key of table (i, j): a pair of band hashes, one of each collection."""
    return F.xxhash64(i.cast("int"), x, j.cast("int"), y)


def _salted(keys: DataFrame) -> DataFrame:
    """A row for each salt of the mask."""
    there = F.filter(F.sequence(F.lit(0), F.lit(SALTS - 1)), lambda i: F.expr("mask").bitwiseAND(F.call_function("shiftleft", F.lit(1).cast("long"), i)) != 0)
    return keys.withColumn("salt", F.explode(there)).drop("mask")


def near_dedup(docs: DataFrame, width: int = 5, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """rk, doc_id, n_shingles, component_id, keep_rk, kept for each row of docs: the components of links
    of similarity 0.8 or more between the sets of width-word shingles."""
    arrow_batches(docs.sparkSession)
    texts = keyed(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text")))
    signed = written(texts.mapInArrow(lean(_signatures(width, bands, rows)), "rk long, doc_id long, n long, digest binary, sig array<int>"), "signatures")
    some = signed.filter("n > 0")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "rk")).alias("first")
    classes = written(some.groupBy("digest").agg(F.min("rk").alias("cid"), first, F.first("n").alias("n"), F.first("sig").alias("sig")), "classes")
    half = bands * rows
    # the hashes of both collections are computed once per class, then paired
    halves = classes.select("cid", *[F.array(*[F.xxhash64(F.slice("sig", F.lit(j * rows + base + 1), rows)) for j in range(bands)]).alias(name) for name, base in (("p", 0), ("q", half))])
    keys = halves.select("cid", F.posexplode("p").alias("i", "x"), "q").select("cid", "i", "x", F.posexplode("q").alias("j", "y")).select("cid", table_key(F.col("i"), F.col("x"), F.col("j"), F.col("y")).alias("key"))
    # what a bucket has in common is aggregated, partly before the shuffle, and goes back to each of its salts;
    # merge joins here and below: the planner goes by the size of files, which tells nothing of explodes,
    # lengths of arrays and repeated values, and would broadcast such tables through the driver
    salt = F.pmod("cid", F.lit(SALTS)).cast("int")
    ends = keys.groupBy("key").agg(F.min("cid").alias("hub"), F.max("cid").alias("last"), F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), salt)).alias("mask"))
    buckets = written(keys.withColumn("salt", salt).hint("merge").join(_salted(ends.filter("hub <> last")), ["key", "salt"]).drop("salt"), "buckets")
    wanted = buckets.select(F.col("cid").alias("rk")).distinct()
    sets = written(texts.join(wanted, "rk", "left_semi").select("rk", "text").mapInArrow(lean(_sets(width)), "cid long, n long, bits array<long>, shingles array<long>"), "sets")
    brief = sets.select("cid", F.struct("n", "bits").alias("s"))
    star = buckets.filter("cid <> hub").select(F.col("hub").alias("a"), F.col("cid").alias("b")).union(buckets.filter("cid <> last and cid <> hub").select(F.col("cid").alias("a"), F.col("last").alias("b"))).distinct()
    star = written(star.join(brief.toDF("a", "x").hint("merge"), "a").join(brief.toDF("b", "y").hint("merge"), "b").filter(_alike("x", "y")).select("a", "b"), "star")
    links = written(_confirmed(star, sets.select("cid", "shingles")), "links")
    found = components(links)
    # classes of a bucket that the hubs have not brought together; a pair comes from its first common table
    placed = buckets.join(found.withColumnRenamed("v", "cid").hint("merge"), "cid", "left").select("key", "cid", F.coalesce("label", "cid").alias("comp"))
    apart = placed.groupBy("key").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), salt)).alias("mask")).filter("lo <> hi").select("key", "mask")
    split = placed.withColumn("salt", salt).hint("merge").join(_salted(apart), ["key", "salt"]).select("key", "cid", "comp")
    split = split.join(brief.hint("merge"), "cid").join(halves.hint("merge"), "cid").select("key", "cid", "comp", "s", "p", "q")
    x, y = split.toDF("key", "a", "ca", "x", "xp", "xq"), split.toDF("key", "b", "cb", "y", "yp", "yq")
    same = lambda u, v: F.array_position(F.zip_with(u, v, lambda e, f: e == f), True)
    i, j = same("xp", "yp"), same("xq", "yq")
    first_table = (i > 0) & (j > 0) & (F.col("x_key") == table_key(i - 1, F.element_at("xp", i.cast("int")), j - 1, F.element_at("xq", j.cast("int"))))
    pairs = x.withColumnRenamed("key", "x_key").join(y, (F.col("x_key") == F.col("key")) & F.expr("a < b and ca <> cb") & _alike("x", "y") & first_table)
    rest = pairs.select("a", "b").join(star.hint("merge"), ["a", "b"], "left_anti")
    more = written(_confirmed(rest, sets.select("cid", "shingles")), "links")
    label = components(links.union(more))
    placed = classes.join(label.withColumnRenamed("v", "cid").hint("merge"), "cid", "left").select("digest", "first", F.coalesce("label", "cid").alias("comp"))
    whole = placed.groupBy("comp").agg(F.min("first").alias("keep"))
    by_class = written(placed.join(whole, "comp").select("digest", F.col("keep.doc_id").alias("component_id"), F.col("keep.rk").alias("keep_rk")), "components")
    forget(buckets, sets, star)
    out = signed.drop("sig").join(by_class.hint("merge"), "digest", "left")
    return out.select("rk", "doc_id", F.col("n").alias("n_shingles"), F.expr("if(n > 0, component_id, doc_id)").alias("component_id"), F.expr("if(n > 0, keep_rk, rk)").alias("keep_rk")).withColumn("kept", F.expr("doc_id <=> component_id"))


def keep_first(docs: DataFrame, width: int = 5) -> DataFrame:
    """docs, with all its columns: one row of each component stays."""
    rk = fresh(docs, "rk")
    kept = near_dedup(docs, width).filter("rk = keep_rk").select(F.col("rk").alias(rk))
    return keyed(docs, rk).join(kept, rk, "left_semi").drop(rk)
