"""BPE encoding and decoding through a distinct-word table.

Encoding splits the texts into words, sends each word once per block of documents to the distinct-word
table, encodes each distinct word there once, and joins the ids back by the word's position in its
block. A word reaches the table at most once per block, a bounded number of text bytes, and a word that
every block holds is dealt to SALTS tasks of the table, each of which encodes it once. Decoding joins ids to the table of pieces, whose size is
the vocabulary's.

A split is made only where the tokenizer's own pattern has a piece boundary whatever stands around it:
before a space that a visible character follows, and between an ASCII letter and `,.;:!?`. So joining
the words' ids gives the ids of the whole text.

The input must be replayable (a file scan or a written table): it is scanned twice and its blocks are
matched by partition and place; a mismatch raises. Nulls: a null text is an empty one with no ids;
a null doc_id is kept. Repeated rows give a row each. An empty table gives an empty result. Other columns
are not read.
"""

from __future__ import annotations

import hashlib
import json
import os
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from arcmesh.llm.store import arrow_batches, keyed, lean, parts
from arcmesh.llm.textblocks import buffers
from arcmesh.llm.wordjoin import BLOCK, PAYLOAD, blocks, opened, payloads, planes, unplanes

#: Words handled at a time when a block's ids are laid out.
SPAN = 200_000
#: Tasks that the blocks of one word are dealt to; each encodes the word once.
SALTS = 8
#: Answers that a task of the table gathers before it sends them to their blocks.
ANSWERS = 400_000

_AFTER = np.zeros(256, dtype=bool)  # bytes that may follow the space of a split: no white space starts with them
_AFTER[0x21:0x7F] = True
_AFTER[0xC3:0xF5] = True
_AFTER[[0xE1, 0xE2, 0xE3]] = False
_ALPHA = np.zeros(256, dtype=bool)
_ALPHA[0x41:0x5B] = _ALPHA[0x61:0x7B] = True
_STOP = np.zeros(256, dtype=bool)
_STOP[list(b",.;:!?")] = True


def split(off: np.ndarray, raw: np.ndarray) -> tuple[pa.LargeBinaryArray, np.ndarray]:
    """The words of texts as slices of their buffer, and each text's number of them."""
    start = np.zeros(len(raw) + 1, bool)
    start[:-2] = (raw[:-1] == 0x20) & _AFTER[raw[1:]] if len(raw) > 1 else False
    start[1:-1] |= _STOP[raw[1:]] & _ALPHA[raw[:-1]]
    start[off] = True
    start[-1] = False
    at = np.flatnonzero(start)
    found = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(at), [None, pa.py_buffer(np.append(at, len(raw)).astype(np.int64)), pa.py_buffer(np.ascontiguousarray(raw))])
    return found, np.diff(np.searchsorted(at, off))


def _requests(size: int):
    """word, block and at (its index there) of a block's distinct words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for k, _, _, distinct in blocks(batches, size, split):
            for i in range(0, len(distinct), 50_000):
                own = distinct.slice(i, 50_000)
                yield pa.RecordBatch.from_arrays([own.cast(pa.binary()), pa.array(np.full(len(own), k)), pa.array(np.arange(i, i + len(own), dtype=np.int32))], ["word", "block", "at"])

    return run


class Vocabulary:
    """A tokenizer file, read once by the driver and sent to the tasks as text."""

    def __init__(self, path: str):
        self.text = Path(path).read_text(encoding="utf-8")
        spec = json.loads(self.text)
        spec["truncation"] = spec["padding"] = None
        self.text = json.dumps(spec)
        self.size = max([*spec["model"]["vocab"].values(), *(t["id"] for t in spec["added_tokens"])]) + 1
        # the byte alphabet: printable bytes stand for themselves, the others follow from 256 on
        own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
        byte = {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(x for x in range(256) if x not in set(own))}
        self.pieces: dict[int, bytes] = {}
        for token, i in [*spec["model"]["vocab"].items(), *((t["content"], t["id"]) for t in spec["added_tokens"])]:
            self.pieces[i] = bytes(byte[c] for c in token) if all(c in byte for c in token) else token.encode()

    @property
    def kind(self) -> str:
        return "<u2" if self.size <= 1 << 16 else "<u4"


def _encode(text, kind: str):
    """Sorted words to their ids, every distinct word encoded once. Answers to a block that a task has at
    hand travel in one row: indices, numbers of ids, and ids, by byte plane."""

    def answers(block: np.ndarray, at: np.ndarray, ids: pa.Array) -> pa.RecordBatch:
        order = np.lexsort((at, block))
        block, at, (off, raw) = block[order], at[order], buffers(ids.take(pa.array(order)))
        cut = np.append(np.flatnonzero(np.diff(block, prepend=-1)), len(block))
        flat, off = raw.view(kind), off // np.dtype(kind).itemsize
        firsts = at[cut[:-1]]
        at = np.diff(at, prepend=0)
        at[cut[:-1]] = firsts
        spans = list(zip(cut[:-1], cut[1:], strict=True))
        pack = lambda x: pa.array([planes(y) for y in x], pa.binary())
        return pa.RecordBatch.from_arrays([pa.array(block[cut[:-1]]), pack(at[a:b] for a, b in spans), pack(np.diff(off)[a:b] for a, b in spans), pack(flat[off[a] : off[b]] for a, b in spans)], ["block", "at", "n", "ids"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        tok = Tokenizer.from_str(text.value)
        last: tuple[bytes, bytes] | None = None
        places: list[tuple[np.ndarray, np.ndarray]] = []
        found: list[pa.Array] = []
        held = 0
        for b in batches:
            coded = pa.array(b.column("word")).dictionary_encode()
            own = coded.dictionary.to_pylist()
            known = [last[1]] if last and own and own[0] == last[0] else []
            fresh = tok.encode_batch_fast([w.decode() for w in own[len(known) :]], add_special_tokens=False)
            known += [np.array(e.ids, kind).tobytes() for e in fresh]
            if own:
                last = (own[-1], known[-1])
            places.append((b.column("block").to_numpy(), b.column("at").to_numpy()))
            found.append(pa.array(known, pa.large_binary()).take(coded.indices))
            held += b.num_rows
            if held >= ANSWERS:
                yield answers(*map(np.concatenate, zip(*places, strict=True)), pa.concat_arrays(found))
                places, found, held = [], [], 0
        if places:
            yield answers(*map(np.concatenate, zip(*places, strict=True)), pa.concat_arrays(found))

    return run


def _laid(left: pa.Table, right: pa.Table) -> Iterator[tuple[pa.Table, np.ndarray, np.ndarray]]:
    """For spans of a block's documents: rows (rk, doc_id), the offsets of each in the ids, the ids."""
    whole = lambda c, f=unplanes: np.concatenate([f(x) for x in right.column(c).to_pylist()] or [np.zeros(0, np.uint32)])
    rows, index, place = opened(left, whole("at", lambda x: np.cumsum(unplanes(x), dtype=np.int64)))
    flat, sizes = whole("ids"), whole("n").astype(np.int64)
    first, size = (np.cumsum(sizes) - sizes)[place], sizes[place]
    per = rows.column("words").to_numpy()
    ends = np.cumsum(per)
    a = 0
    while a < len(per):
        base = ends[a] - per[a]
        b = max(a + 1, int(np.searchsorted(ends, base + SPAN, "right")))
        words = index[base : ends[b - 1]]
        n = size[words]
        upto = np.zeros(len(words) + 1, np.int64)
        np.cumsum(n, out=upto[1:])
        ids = flat[np.repeat(first[words] - upto[:-1], n) + np.arange(upto[-1])]
        yield rows.slice(a, b - a), upto[np.append(0, ends[a:b] - base)], ids
        a = b


def _joined(docs: DataFrame, vocabulary: Vocabulary, block: int):
    """The two sides of the join by block and position."""
    arrow_batches(docs.sparkSession)
    rows = keyed(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text")))
    text = docs.sparkSession.sparkContext.broadcast(vocabulary.text)  # the vocabulary's own size
    n = parts(docs)
    salt = F.pmod("block", F.lit(SALTS))
    table = rows.mapInArrow(lean(_requests(block)), "word binary, block long, at int").repartition(n, "word", salt).sortWithinPartitions("word").mapInArrow(lean(_encode(text, vocabulary.kind)), "block long, at binary, n binary, ids binary")
    payload = rows.mapInArrow(lean(payloads(block, split)), PAYLOAD)
    return payload.groupBy("block").cogroup(table.groupBy("block"))


def encode(docs: DataFrame, path: str, block: int = BLOCK) -> DataFrame:
    """rk, doc_id, ids (array<int>) for each row of docs."""
    vocabulary = Vocabulary(path)

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        out = []
        for rows, off, ids in _laid(left, right):
            out.append(pa.RecordBatch.from_arrays([rows.column("rk").combine_chunks(), rows.column("doc_id").combine_chunks(), pa.ListArray.from_arrays(pa.array(off, pa.int32()), pa.array(ids, pa.int32()))], ["rk", "doc_id", "ids"]))
        return pa.Table.from_batches(out)

    return _joined(docs, vocabulary, block).applyInArrow(run, "rk long, doc_id long, ids array<int>")


def pieces(spark, vocabulary: Vocabulary) -> DataFrame:
    """id, piece: the vocabulary as a table."""
    return spark.createDataFrame(sorted(vocabulary.pieces.items()), "id int, piece binary")


def _texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pieces in order, a head with each document's first: the head and the pieces together."""
    head: bytes | None = None
    held: list[bytes] = []

    def whole() -> bytes:
        return b"".join(held).decode("utf-8", "replace").encode()

    for b in batches:
        heads: list[bytes] = []
        texts: list[bytes] = []
        column = pa.array(b.column("head"))
        off, raw = buffers(b.column("piece"))
        edges = [*np.flatnonzero(column.is_valid().to_numpy(zero_copy_only=False)).tolist(), b.num_rows]
        held.append(raw[: off[edges[0]]].tobytes())
        for a, to in zip(edges, edges[1:], strict=False):
            if head is not None:
                heads.append(head)
                texts.append(whole())
            head, held = column[a].as_py(), [raw[off[a] : off[to]].tobytes()]
        if heads:
            yield pa.RecordBatch.from_arrays([pa.array(heads, pa.binary()), pa.array(texts, pa.binary())], ["head", "text"])
    if head is not None:
        yield pa.RecordBatch.from_arrays([pa.array([head], pa.binary()), pa.array([whole()], pa.binary())], ["head", "text"])


def decode_rows(encoded: DataFrame, vocabulary: Vocabulary) -> DataFrame:
    """head (binary), text (UTF-8) from head, ids. Ids are exploded in place, joined to their pieces and
    put together as they come: the join keeps the order of its streamed side, and a document's ids stay
    in its partition. Only a document's first row carries its head."""
    table = F.broadcast(pieces(encoded.sparkSession, vocabulary))  # a row per id of the vocabulary
    rows = encoded.select("head", F.posexplode_outer("ids").alias("pos", "id")).select(F.expr("if(coalesce(pos, 0) = 0, head, null)").alias("head"), "id")
    return rows.join(table, "id", "left").select("head", "piece").mapInArrow(lean(_texts), "head binary, text binary")


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """rk, doc_id, text from rk, doc_id, ids."""
    packed = encoded.select(F.to_json(F.array("rk", "doc_id"), {"ignoreNullFields": "false"}).cast("binary").alias("head"), "ids")
    head = F.from_json(F.col("head").cast("string"), "array<long>")
    return decode_rows(packed, Vocabulary(path)).select(head[0].alias("rk"), head[1].alias("doc_id"), F.col("text").cast("string").alias("text"))


def round_trip(docs: DataFrame, path: str, block: int = BLOCK) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 for each row of docs: encoded, then decoded again."""
    vocabulary = Vocabulary(path)

    def tokens(left: pa.Table, right: pa.Table) -> pa.Table:
        """The head of a document holds its digest columns."""
        out = []
        for rows, off, ids in _laid(left, right):
            wide = ids.astype("<u4")
            heads = [json.dumps([d, int(off[i + 1] - off[i]), hashlib.sha256(wide[off[i] : off[i + 1]]).hexdigest()]).encode() for i, d in enumerate(rows.column("doc_id").to_pylist())]
            out.append(pa.RecordBatch.from_arrays([pa.array(heads, pa.binary()), pa.ListArray.from_arrays(pa.array(off, pa.int32()), pa.array(wide.view(np.int32)))], ["head", "ids"]))
        return pa.Table.from_batches(out)

    rows = _joined(docs, vocabulary, block).applyInArrow(tokens, "head binary, ids array<int>")
    digest = F.from_json(F.col("head").cast("string"), "array<string>")
    out = decode_rows(rows, vocabulary).select(digest.alias("h"), F.sha2("text", 256).alias("decoded_sha256"))
    return out.select(F.col("h")[0].cast("long").alias("doc_id"), F.col("h")[1].cast("long").alias("n_tokens"), F.col("h")[2].alias("ids_sha256"), "decoded_sha256")
