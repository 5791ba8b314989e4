"""Language ID by word-first backoff.

A known word scores each language by its log frequency there; an unseen word backs off to its character
n-grams, longest first: 4, then 3, 2 and 1 characters, until some n-gram of that length is known. Words and
n-grams are known by 64-bit hashes, so the model is a few sorted arrays. The text's language is the best sum over all its words; the score is its posterior.

Learning takes a bounded sample of labelled rows: about SAMPLE bytes of text of each language, whole rows,
chosen by a hash of the row's number. Every word and n-gram of the sample is in the model, so what is
broadcast is bounded by the sample and not by the corpus. Prediction reads every row and whole texts.

Nulls: a null text, an empty one or one without a letter is `und` with score 0; a null lang teaches
nothing; a null doc_id counts as the empty id. Ties go to the language first by code point. Without any
labelled row every text is `und`. Repeated rows are predicted each. An empty table gives an empty result.
Other columns are not read.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from arcmesh.llm.store import arrow_batches, keyed, lean
from arcmesh.llm.textblocks import WORD_CHAR, buffers, chunks, hash_words, rolling, words

#: Bytes of text of each language that teach the model.
SAMPLE = 8 << 20
LONGEST = 4
#: Rows that a task hands on at a time.
FLUSH = 50_000
_LETTERLIKE = re.compile(r"[^\W\d_]")


def has_letter(text: str) -> bool:
    """Whether a character of text is a letter; fractions and other numerals are none."""
    return any(m[0].isalpha() for m in _LETTERLIKE.finditer(text))


def fold(doc_id: str, n: int) -> Column:
    """crc32 of doc_id as text, modulo n; a null counts as the empty text."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")) % n


def _points(words_: pa.LargeBinaryArray) -> tuple[np.ndarray, np.ndarray]:
    """The code points of all words, and each word's number of them."""
    off, raw = buffers(words_)
    lead = np.zeros(len(raw) + 1, np.int64)
    np.cumsum((raw & 0xC0) != 0x80, out=lead[1:])
    n = np.diff(lead[off])
    points = np.frombuffer(raw.tobytes().decode("utf-8", "replace").encode("utf-32-le"), "<u4")
    if len(points) != n.sum():  # bytes that are no UTF-8: each word by itself
        own = [w.decode("utf-8", "replace") for w in words_.to_pylist()]
        points, n = np.frombuffer("".join(own).encode("utf-32-le"), "<u4"), np.array([len(w) for w in own], np.int64)
    return points.astype(np.uint64), n


def gram_keys(words_: pa.LargeBinaryArray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words' n-grams, with < and > around the word for n over 1, and the word of each."""
    points, size = _points(words_)
    if n > 1:
        ends = np.cumsum(size + 2)
        framed = np.zeros(int(ends[-1]) if len(ends) else 0, np.uint64)
        inner = np.ones(len(framed), bool)
        inner[ends - 1] = inner[ends - size - 2] = False
        framed[inner] = points
        framed[ends - size - 2], framed[ends - 1] = ord("<"), ord(">")
        points, size = framed, size + 2
    word = np.repeat(np.arange(len(size)), size)
    h = rolling(points, n)
    inside = np.flatnonzero(word[: len(h)] == word[n - 1 :]) if len(h) else np.zeros(0, np.int64)
    return h[inside], word[inside]


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """kind (0: word, n: n-gram), lang, key (its hash), n: counts, handed on after each chunk of text."""
    for batch in batches:
        langs = np.array(batch.column("lang").to_pylist(), dtype=object)
        off, raw = buffers(batch.column("text"))
        for a, b in chunks(off):
            found, per = words(off[a : b + 1] - off[a], raw[off[a] : off[b]], WORD_CHAR)
            of = np.repeat(langs[a:b], per)
            for lang in sorted(set(langs[a:b])):
                counts = found.filter(pa.array(of == lang)).value_counts()
                own, n = counts.field("values"), counts.field("counts").to_numpy()
                for kind in range(LONGEST + 1):
                    keys, word = gram_keys(own, kind) if kind else (hash_words(own), np.arange(len(own)))
                    keys, at = np.unique(keys, return_inverse=True)
                    sums = np.bincount(at, n[word], len(keys)).astype(np.int64)
                    for i in range(0, len(keys), FLUSH):
                        k = len(keys[i : i + FLUSH])
                        yield pa.RecordBatch.from_arrays([pa.array(np.full(k, kind, np.int32)), pa.array([lang] * k, pa.string()), pa.array(keys[i : i + k].view(np.int64)), pa.array(sums[i : i + k])], ["kind", "lang", "key", "n"])


class Model:
    """Log frequencies by hash of the item: sorted keys, and a row over langs for each; tables[0] has the
    words, tables[n] the n-grams."""

    def __init__(self, langs: list[str], kind: Sequence[int], lang: Sequence[str], key: Sequence[int], n: Sequence[int]):
        """Counts of items, one entry for each kind, lang and key."""
        self.langs, self.tables = langs, []
        kinds, counts = np.asarray(kind, np.int64), np.asarray(n, np.float64)
        column = pa.array(lang, pa.string()).dictionary_encode()
        at = np.array([langs.index(x) for x in column.dictionary.to_pylist()], np.int64)[column.indices.to_numpy()] if len(kinds) else np.zeros(0, np.int64)
        all_keys = np.asarray(key, np.int64).view(np.uint64)
        for k in range(LONGEST + 1):
            own = np.flatnonzero(kinds == k)
            keys, row = np.unique(all_keys[own], return_inverse=True)
            table = np.zeros((len(keys), len(langs)))
            np.add.at(table, (row, at[own]), counts[own])
            self.tables.append((keys, np.log((table + 0.1) / (table.sum(axis=0) + 0.1 * (len(keys) + 1))).astype(np.float32)))

    def _rows(self, kind: int, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which keys the model has, and their rows."""
        known = self.tables[kind][0]
        at = np.searchsorted(known, keys)
        have = np.flatnonzero(known[np.minimum(at, len(known) - 1)] == keys) if len(known) else np.zeros(0, np.int64)
        return have, at[have]

    def vectors(self, words_: pa.LargeBinaryArray) -> np.ndarray:
        """Each word's log frequencies; of an unseen word the mean over its longest known n-grams."""
        out = np.zeros((len(words_), len(self.langs)), np.float32)
        have, rows = self._rows(0, hash_words(words_))
        out[have] = self.tables[0][1][rows]
        left = np.setdiff1d(np.arange(len(words_)), have)
        for n in range(LONGEST, 0, -1):
            if not len(left):
                break
            keys, word = gram_keys(words_.take(pa.array(left)), n)
            have, rows = self._rows(n, keys)
            hits = np.bincount(word[have], minlength=len(left))
            logs, found = self.tables[n][1][rows], np.flatnonzero(hits)
            for i in range(len(self.langs)):
                out[left[found], i] = np.bincount(word[have], logs[:, i], len(left))[found] / hits[found]
            left = left[hits == 0]
        return out


def learn(docs: DataFrame, sample: int = SAMPLE) -> Model:
    """From the rows of docs (text, lang) with a lang; docs holds training rows only. The driver holds a
    row per language and the counts of the sample."""
    arrow_batches(docs.sparkSession)
    rows = keyed(docs.select(F.col("text").cast("binary").alias("text"), F.col("lang").cast("string").alias("lang"))).filter("lang is not null and text is not null")
    sizes = {r.lang: r["n"] for r in rows.groupBy("lang").agg(F.sum(F.octet_length("text")).alias("n")).collect()}
    if not sizes:
        return Model([], [], [], [], [])
    share = F.create_map(*[x for k, n in sizes.items() for x in (F.lit(k), F.lit(min(1.0, sample / max(n, 1))))])[F.col("lang")]
    own = rows.filter(F.pmod(F.xxhash64("rk"), F.lit(1_000_000)) < share * 1_000_000).select("text", "lang")
    items = own.mapInArrow(lean(_count), "kind int, lang string, key long, n long").groupBy("kind", "lang", "key").agg(F.sum("n").alias("n")).toArrow()
    return Model(sorted(sizes), *(items.column(c).combine_chunks() for c in ("kind", "lang", "key", "n")))


def predictor(model: Model):
    """A function of a text column (Arrow) to langs and scores."""

    def predict(texts: pa.Array) -> tuple[list[str], np.ndarray]:
        off, raw = buffers(texts)
        n, size = len(off) - 1, len(model.langs)
        sums = np.zeros((n, size))
        for a, b in chunks(off):
            found, per = words(off[a : b + 1] - off[a], raw[off[a] : off[b]], WORD_CHAR)
            if not len(found) or not size:
                continue
            coded = found.dictionary_encode()
            vectors = model.vectors(coded.dictionary)
            have = np.flatnonzero(per)
            starts = (np.cumsum(per) - per)[have]
            sums[a + have] = np.add.reduceat(vectors[coded.indices.to_numpy()], starts, axis=0, dtype=np.float64)
        langs, scores = [], np.zeros(n)
        best = sums.argmax(axis=1) if size else np.zeros(n, int)
        for i in range(n):
            if size and has_letter(raw[off[i] : off[i + 1]].tobytes().decode("utf-8", "replace")):
                langs.append(model.langs[best[i]])
                scores[i] = 1 / math.fsum(math.exp(max(-700.0, x - sums[i, best[i]])) for x in sums[i])
            else:
                langs.append("und")
        return langs, scores

    return predict


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """rk, doc_id, lang_pred, score for each row of docs."""
    arrow_batches(docs.sparkSession)
    held = docs.sparkSession.sparkContext.broadcast(model)  # what SAMPLE bytes a language hold

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f = predictor(held.value)
        for b in batches:
            langs, scores = f(b.column("text"))
            yield pa.RecordBatch.from_arrays([b.column("rk"), b.column("doc_id"), pa.array(langs, pa.string()), pa.array(scores)], ["rk", "doc_id", "lang_pred", "score"])

    return keyed(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text"))).mapInArrow(lean(run), "rk long, doc_id long, lang_pred string, score double")


def language_id(docs: DataFrame) -> DataFrame:
    """rk, doc_id, held_out, lang_pred, score; learns from rows whose fold of 4 is not 2."""
    model = learn(docs.filter(fold("doc_id", 4) != 2))
    return predict(docs, model).withColumn("held_out", fold("doc_id", 4) == 2)


def with_language(docs: DataFrame, model: Model, name: str) -> DataFrame:
    """docs with its columns and the predicted language as a struct<lang_pred, score> column."""
    held = docs.sparkSession.sparkContext.broadcast(model)
    kind = T.StructType([T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f = predictor(held.value)
        for b in batches:
            langs, scores = f(b.column("text"))
            own = pa.StructArray.from_arrays([pa.array(langs, pa.string()), pa.array(scores)], ["lang_pred", "score"])
            yield pa.RecordBatch.from_arrays([*b.columns, own], [*b.schema.names, name])

    arrow_batches(docs.sparkSession)
    return docs.mapInArrow(lean(run), T.StructType([*docs.schema.fields, T.StructField(name, kind)]))
