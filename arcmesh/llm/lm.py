"""LM scoring with a gated recurrent model.

Counts of every word of every training document give the base score and the open end of the model: the
recurrent model predicts the OUTPUTS most frequent tokens (the end, the frequent words, and SPELLINGS
groups of all other words by their last two bytes); a word of a group has the group's probability times
its own smoothed share of the group's counts, where one share is left for unseen words.

Training is data-parallel: every partition trains a copy on its part of the sequences by truncated
backpropagation, copies are averaged by tokens in a tree of groups, and the next round starts from the
average. Every training document is a sequence of one round; a partition reads its part in pieces of
about PASS tokens, so memory does not grow with it.

Texts are split once, into blocks that are written with their distinct words; counts, sequences and scores
are taken from those. Counts reach each block through a join by distinct word, so nothing of the vocabulary
is broadcast but the model's OUTPUTS words.

Nulls: a null text is empty and is scored as its end token alone; a null doc_id counts as the empty id
(held out) and is kept. Repeated rows are scored and counted each. Without training rows every count is
0. Empty tables give empty results. Other columns are not read.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from arcmesh.llm import gru
from arcmesh.llm.langid import fold
from arcmesh.llm.store import arrow_batches, forget, keyed, lean, written
from arcmesh.llm.textblocks import buffers, words
from arcmesh.llm.wordjoin import BLOCK, PAYLOAD, blocks, by_count, opened, packed, planes, unpacked

OUTPUTS, SPELLINGS, HIDDEN = 2048, 95, 16
ROUNDS = 2
#: Tokens of the sequences that a copy holds at once.
PASS = 1_000_000
#: Bytes of the words that stand for themselves; longer ones are known by a digest, which bounds every key.
LONGEST = 48
#: Weights in a row, and copies averaged in a group, of the averaging tree.
PIECE, FANOUT = 8192, 64


def word_keys(distinct: pa.Array) -> pa.Array:
    """The words, those over LONGEST bytes as a byte that begins no word and their SHA-256."""
    long = pc.greater(pc.binary_length(distinct), LONGEST)
    if pc.any(long).as_py():
        digests = pa.array([b"\xff" + hashlib.sha256(w).digest() for w in distinct.filter(long).to_pylist()], distinct.type)
        distinct = pc.replace_with_mask(distinct, long, digests)
    return distinct.cast(pa.binary())


#: Group of a word by its last two bytes (of a word of one byte, by that).
_TWO = np.array([1 + zlib.crc32(bytes(divmod(x, 256))) % SPELLINGS for x in range(1 << 16)])
_ONE = np.array([1 + zlib.crc32(bytes([x])) % SPELLINGS for x in range(256)])


def spelling_groups(keys: pa.Array) -> np.ndarray:
    """The output that stands for each word that has none of its own."""
    off, raw = buffers(keys)
    if not len(raw):
        return np.ones(len(keys), np.int64)
    last = raw[off[1:] - 1].astype(np.int64)
    return np.where(np.diff(off) > 1, _TWO[raw[np.maximum(off[1:] - 2, 0)].astype(np.int64) * 256 + last], _ONE[last])


def _split(size: int):
    """A block's payload (see wordjoin), its number of training documents, and its distinct words' keys and
    counts in those, packed: one row per block. Every later step reads these rows, so texts are split once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for k, rows, index, distinct in blocks(batches, size, words):
            learn = ~rows.column("held_out").to_numpy()
            n = np.bincount(index[np.repeat(learn, rows.column("words").to_numpy())], minlength=len(distinct))
            own = zstandard.ZstdCompressor(level=1).compress(packed(pa.table({"word": word_keys(distinct), "n": n.astype(np.int64)})))
            index, often = by_count(index, len(distinct))
            parts = (pa.array([x], pa.binary()) for x in (packed(rows), planes(often), planes(index), own))
            yield pa.RecordBatch.from_arrays([pa.array([k]), pa.array([len(distinct)], pa.int32()), *parts, pa.array([int(learn.sum())])], ["block", "distinct", "rows", "often", "index", "own", "learning"])

    return run


def _own(x: bytes) -> pa.Table:
    return unpacked(zstandard.ZstdDecompressor().decompress(x))


def _requests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """word (its key), block, at, n: a block's distinct words and their counts in its training documents."""
    for batch in batches:
        for k, x in zip(batch.column("block").to_pylist(), batch.column("own"), strict=True):
            own = _own(x.as_py())
            for i in range(0, len(own), 50_000):
                part = own.slice(i, 50_000).combine_chunks()
                m = len(part)
                yield pa.RecordBatch.from_arrays([part.column("word").chunk(0), pa.array(np.full(m, k)), pa.array(np.arange(i, i + m, dtype=np.int32)), part.column("n").chunk(0)], ["word", "block", "at", "n"])


def _sequences(held):
    """ids (16-bit) of the training sequences: words, then the end (0)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        top = pa.array(held.value, pa.binary())
        for batch in batches:
            for i in range(len(batch)):
                one = pa.Table.from_batches([batch.slice(i, 1)])
                own = _own(one.column("own")[0].as_py()).column("word").combine_chunks()
                rows, index, _ = opened(one, np.arange(len(own)))
                at = pc.index_in(own, value_set=top).fill_null(-1).to_numpy()
                ids = np.where(at >= 0, at + 1 + SPELLINGS, spelling_groups(own)).astype("<u2")[index]
                per = rows.column("words").to_numpy()
                ids = np.insert(ids, np.cumsum(per), 0)
                ends = np.cumsum(per + 1)
                learn = np.flatnonzero(~rows.column("held_out").to_numpy())
                yield pa.RecordBatch.from_arrays([rows.column("rk").combine_chunks().take(pa.array(learn)), pa.array([ids[ends[d] - per[d] - 1 : ends[d]].tobytes() for d in learn], pa.binary())], ["rk", "ids"])

    return run


def _passes(sequences: Iterator[bytes]) -> Iterator[list[bytes]]:
    """The sequences, some at a time: as many as reach PASS tokens."""
    parts, n = [], 0
    for x in sequences:
        parts.append(x)
        n += len(x) // 2
        if n >= PASS:
            yield parts
            parts, n = [], 0
    if parts:
        yield parts


def _trained(held):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        p, past, seen = held.value, {}, 0
        for parts in _passes(x for b in batches for x in b.column("ids").to_pylist()):
            off = np.cumsum([0, *(len(x) // 2 for x in parts)])
            p = gru.train(p, np.frombuffer(b"".join(parts), "<u2").astype(np.int32), off, past=past)
            seen += int(off[-1])
        if not seen:
            return
        v = gru.flat(p)
        at = range(0, len(v), PIECE)
        k = len(at)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(k, dtype=np.int32)), pa.array(np.full(k, TaskContext.get().partitionId(), np.int64)), pa.array(np.full(k, float(seen))), pa.array([v[i : i + PIECE].astype("<f4").tobytes() for i in at], pa.binary())], ["piece", "copy", "tokens", "v"])

    return run


def _mean(t: pa.Table) -> pa.Table:
    n = t.column("tokens").to_numpy()
    v = sum(w * np.frombuffer(x, "<f4").astype(np.float64) for w, x in zip(n, t.column("v").to_pylist(), strict=True)) / n.sum()
    return pa.table({"piece": t.column("piece").slice(0, 1), "copy": pa.array([t.column("copy")[0].as_py() // FANOUT]), "tokens": pa.array([float(n.sum())]), "v": pa.array([v.astype("<f4").tobytes()], pa.binary())})


def learned(start: gru.Params, sequences: DataFrame, rounds: int = ROUNDS) -> gru.Params:
    """Rounds of data-parallel training over the sequences (rk, ids)."""
    sc, schema = sequences.sparkSession.sparkContext, "piece int, copy long, tokens double, v binary"
    p = start
    for r in range(rounds):
        held = sc.broadcast(p)
        part = sequences.filter(F.pmod(F.xxhash64("rk"), F.lit(rounds)) == r)
        copies = part.mapInArrow(lean(_trained(held)), schema)
        left = max(1, part.rdd.getNumPartitions())
        while left > 1:
            copies = copies.groupBy("piece", F.expr(f"copy div {FANOUT}").alias("g")).applyInArrow(_mean, schema)
            left = -(-left // FANOUT)
        got = copies.orderBy("piece").collect()
        if got:
            p = gru.unflat(np.concatenate([np.frombuffer(x.v, "<f4") for x in got]).copy(), start)
    return p


def score_documents(docs: DataFrame, rounds: int = ROUNDS, block: int = BLOCK) -> DataFrame:
    """rk, doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score for each row of docs."""
    spark = docs.sparkSession
    arrow_batches(spark)
    rows = keyed(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text"), (fold("doc_id", 10) == 0).alias("held_out")))
    # rows of some megabytes, so the writer looks at its size after each one
    payload = written(rows.mapInArrow(lean(_split(block)), f"{PAYLOAD}, own binary, learning long"), "blocks", **{"parquet.block.size.row.check.min": 1, "parquet.page.size.row.check.min": 1})
    asked = payload.select("block", "own").mapInArrow(lean(_requests), "word binary, block long, at int, n long")
    # totals combine before their shuffle; their join back to the blocks is one that Spark splits where a
    # word that every block holds makes a partition large
    counted = written(asked.filter("n > 0").groupBy("word").agg(F.sum("n").alias("total")), "counts")
    ends = payload.agg(F.sum("learning")).first()[0] or 0
    top = [bytes(r.word) for r in counted.orderBy(F.desc("total"), "word").limit(OUTPUTS - 1 - SPELLINGS).collect()]
    ranks = F.broadcast(spark.createDataFrame([(w, i + 1 + SPELLINGS) for i, w in enumerate(top)], "word binary, rank int"))  # OUTPUTS rows at most
    group = (1 + F.crc32(F.expr("substring(word, -2, 2)")) % SPELLINGS).cast("int")
    coded = counted.join(ranks, "word", "left").select("word", "total", F.coalesce("rank", group).alias("code"))
    sums = coded.groupBy("code").agg(F.sum("total").alias("n"), F.count("*").alias("v")).collect()
    n_of, v_of = np.zeros(OUTPUTS), np.zeros(OUTPUTS)
    for r in sums:
        n_of[r.code], v_of[r.code] = r.n, r.v
    n_of[0], v_of[0] = ends, ends > 0
    n_all, v_all = float(n_of.sum()), float(v_of.sum())
    start = gru.new(n_of, HIDDEN)
    sequences = written(payload.drop("learning").mapInArrow(lean(_sequences(spark.sparkContext.broadcast(top))), "rk long, ids binary"), "sequences")
    held = spark.sparkContext.broadcast((learned(start, sequences, rounds), n_of, v_of, n_all, v_all))
    forget(sequences)

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        params, n_of, v_of, n_all, v_all = held.value
        rows, index, place = opened(left, right.column("at").to_numpy())
        total, code = right.column("total").to_numpy()[place], right.column("code").to_numpy()[place]
        # log10 of a word's smoothed share: of all tokens, and of its group's
        base = np.log10(total + 0.1)
        inner = np.where(code <= SPELLINGS, np.log10(total + 0.1) - np.log10(n_of[code] + 0.1 * (v_of[code] + 1)), 0.0)
        per = rows.column("words").to_numpy()
        ends = np.cumsum(per)
        sums = [np.zeros(len(per)) for _ in range(4)]
        a = 0
        while a < len(per):  # documents of about two million words at a time, so that long ones have company
            at = ends[a] - per[a]
            b = max(a + 1, int(np.searchsorted(ends, at + 2_000_000, "right")))
            own = index[at : ends[b - 1]]
            doc = np.repeat(np.arange(b - a), per[a:b])
            for out, x in zip(sums, (base, inner, total > 0), strict=False):
                out[a:b] = np.bincount(doc, x[own], b - a)
            tokens = np.insert(code[own], ends[a:b] - at, 0)
            sums[3][a:b] = gru.score(params, tokens, np.append(0, np.cumsum(per[a:b] + 1))) / np.log(10)
            a = b
        n = per + 1
        columns = [rows.column("rk"), rows.column("doc_id"), rows.column("held_out"), pa.array(n), pa.array(sums[2].astype(np.int64) + (n_of[0] > 0)), pa.array(np.full(len(n), int(n_all))), pa.array(sums[0] + np.log10(n_of[0] + 0.1) - n * np.log10(n_all + 0.1 * (v_all + 1))), pa.array(sums[1] + sums[3])]
        return pa.table(columns, ["rk", "doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"])

    answers = asked.select("word", "block", "at").join(coded, "word", "left").select("block", "at", F.coalesce("total", F.lit(0)).alias("total"), F.coalesce("code", group).alias("code"))
    return payload.drop("own", "learning").groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(run, "rk long, doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")
