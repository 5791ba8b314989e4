"""Blocks of documents and their distinct words, for joins of words against tables of words.

A block is a bounded number of text bytes of one partition. Its distinct words go out to be joined, each
once; the block itself travels as one packed row: its documents and, for each word place, the index into
the distinct words. The join's answers come back by block and index. Blocks are numbered by partition
and place, so the input must be replayable (a file scan or a written table).
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from arcmesh.llm.textblocks import buffers, chunks

BLOCK = 12 << 20
#: A word that stands as often in a block is numbered by frequency there.
OFTEN = 4


def block_number(partition: int) -> int:
    """The first block of a partition; there is room for 16 million of each."""
    return partition << 24


def blocks(batches: Iterator[pa.RecordBatch], size: int, split: Callable) -> Iterator[tuple[int, pa.Table, np.ndarray, pa.Array]]:
    """Block number, rows (the other columns, and words), index of each word into the block's distinct words, those in order."""
    from pyspark import TaskContext

    k, held = block_number(TaskContext.get().partitionId()), 0
    rows: list[pa.RecordBatch] = []
    found: list[pa.Array] = []

    def out() -> tuple[int, pa.Table, np.ndarray, pa.Array]:
        coded = pa.concat_arrays(found).dictionary_encode()
        order = pc.sort_indices(coded.dictionary)  # neighbours that begin alike pack better in a shuffle
        rank = np.empty(len(order), np.int32)
        rank[order.to_numpy()] = np.arange(len(order), dtype=np.int32)
        return k, pa.Table.from_batches(rows), rank[coded.indices.to_numpy()], coded.dictionary.take(order)

    for batch in batches:
        names = [c for c in batch.schema.names if c != "text"]
        off, raw = buffers(batch.column("text"))
        for a, b in chunks(off):
            words, per = split(off[a : b + 1] - off[a], raw[off[a] : off[b]])
            part = batch.slice(a, b - a)
            rows.append(pa.RecordBatch.from_arrays([*(part.column(c) for c in names), pa.array(per)], [*names, "words"]))
            found.append(words)
            held += int(off[b] - off[a]) + 64 * (b - a)
            if held >= size:
                yield out()
                k, held, rows, found = k + 1, 0, [], []
    if rows:
        yield out()


def planes(x: np.ndarray) -> bytes:
    """Indices by byte plane, which packs better."""
    import zstandard

    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(x.astype("<u4").view(np.uint8).reshape(-1, 4).T).tobytes())


def unplanes(x: bytes) -> np.ndarray:
    import zstandard

    return np.ascontiguousarray(np.frombuffer(zstandard.ZstdDecompressor().decompress(x), np.uint8).reshape(4, -1).T).view("<u4").reshape(-1)


def by_count(index: np.ndarray, distinct: int) -> tuple[np.ndarray, np.ndarray]:
    """The index in an order of the words that packs better: those that stand at least OFTEN times first, the
    most frequent one at 0, then the others as they are; and the frequent ones in that order."""
    counts = np.bincount(index, minlength=distinct)
    often = np.flatnonzero(counts >= OFTEN)
    often = often[np.argsort(-counts[often], kind="stable")]
    place = np.empty(distinct, np.uint32)
    place[_order(often, distinct)] = np.arange(distinct)
    return place[index], often


def _order(often: np.ndarray, distinct: int) -> np.ndarray:
    return np.concatenate([often, np.delete(np.arange(distinct), often)]).astype(np.uint32)


def packed(t: pa.Table) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, t.schema) as w:
        w.write_table(t.combine_chunks())
    return sink.getvalue().to_pybytes()


def unpacked(x: bytes) -> pa.Table:
    return pa.ipc.open_stream(x).read_all().combine_chunks()


def payloads(size: int, split: Callable):
    """block, distinct (number of distinct words), rows, often and index (see by_count), packed: one row per block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for k, rows, index, distinct in blocks(batches, size, split):
            index, often = by_count(index, len(distinct))
            yield pa.RecordBatch.from_arrays([pa.array([k]), pa.array([len(distinct)], pa.int32()), *(pa.array([x], pa.binary()) for x in (packed(rows), planes(often), planes(index)))], ["block", "distinct", "rows", "often", "index"])

    return run


PAYLOAD = "block long, distinct int, rows binary, often binary, index binary"


def opened(left: pa.Table, at: np.ndarray) -> tuple[pa.Table, np.ndarray, np.ndarray]:
    """A block's rows, its index, and the place of each distinct word's answer; at: the answers' indices."""
    if left.num_rows != 1 or len(at) != left.column("distinct")[0].as_py() or len(at) and at.max() != len(at) - 1:
        raise ValueError("a block's words came back in other numbers: the input isn't replayable")
    place = np.empty(len(at), np.int64)
    place[at] = np.arange(len(at))
    index = _order(unplanes(left.column("often")[0].as_py()), len(at))[unplanes(left.column("index")[0].as_py())]
    return unpacked(left.column("rows")[0].as_py()), index, place
