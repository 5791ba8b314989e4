"""License scans by diagonal voting.

The words of a text are hashed in rolling k-grams, and every k-gram is joined by its hash to the k-gram
positions of the license templates (a fixed table, so it is broadcast). A hit is verified on the words
themselves and votes for the diagonal `position in the text - position in the template`; votes are
aggregated by text, template and diagonal, neighbouring diagonals (insertions and deletions) are merged
into one span, and the span is verified: a base phrase must have all its k-grams on one diagonal; of any
other template the span must hold the k-grams that name the license and its version, and COVER of the
words of template and insertions.

Nulls: a null or empty text has no words and no labels; a null doc_id is kept. Repeated rows give a row
each. Empty tables give empty results. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from arcmesh.llm.store import arrow_batches, keyed, lean
from arcmesh.llm.textblocks import WORD_CHAR, buffers, chunks, hash_words, rolling, words

K = 3
#: Share of the words, those of the template and those inserted, that a span must hold, and the diagonals
#: between neighbours of one span.
COVER, DRIFT = 0.75, 4
#: The base phrases and their labels (fixed values).
PHRASES = (("under the mit license", "mit"), ("apache license version 2", "apache-2"), ("cc by nc", "cc-by-nc"))
#: Passages of public licenses, as their texts have them, and the three words at a time that must be there.
TEMPLATES = (
    ("permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction", "mit", ()),
    ("licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license", "apache-2", ("license version 2",)),
    ("licensed under the gnu general public license version 3", "gpl-3", ("the gnu general", "license version 3")),
    ("licensed under the gnu general public license version 2", "gpl-2", ("the gnu general", "license version 2")),
    ("this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation", "gpl", ("gnu general public",)),
    ("licensed under the gnu lesser general public license", "lgpl", ("gnu lesser general",)),
    ("redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met", "bsd", ()),
    ("this source code form is subject to the terms of the mozilla public license v 2 0", "mpl-2", ("license v 2",)),
    ("permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted", "isc", ()),
    ("this is free and unencumbered software released into the public domain", "unlicense", ("the public domain",)),
    ("licensed under a creative commons attribution 4 0 international license", "cc-by-4", ("commons attribution 4",)),
    ("licensed under a creative commons attribution sharealike 4 0 international license", "cc-by-sa-4", ("attribution sharealike 4",)),
    ("licensed under a creative commons attribution noncommercial 4 0 international license", "cc-by-nc", ("attribution noncommercial 4",)),
)


def _grams(texts: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray, pa.Array, np.ndarray]]:
    """Rows a to b, words of each, and of each k-gram its row, position and hash; the words, and where each k-gram starts in them."""
    off, raw = buffers(texts)
    for a, b in chunks(off):
        found, per = words(off[a : b + 1] - off[a], raw[off[a] : off[b]], WORD_CHAR)
        h = rolling(hash_words(found), K)
        row = np.repeat(np.arange(b - a), per)
        place = np.arange(len(found)) - np.repeat(np.cumsum(per) - per, per)
        inside = np.flatnonzero(row[: len(h)] == row[K - 1 :]) if len(h) else np.zeros(0, np.int64)
        yield a, b, per, row[inside], place[inside], h[inside].view(np.int64), found, inside


def _joined(found: pa.Array, first: np.ndarray) -> pa.Array:
    """The K words from each of `first` on, with a space between."""
    return pc.binary_join_element_wise(*(found.take(pa.array(first + j)) for j in range(K)), pa.scalar(b" ", pa.large_binary())).cast(pa.binary())


def _emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each k-gram of each text, after a row with no hash per text that gives its number of words."""
    for batch in batches:
        keys, ids = batch.column("rk"), batch.column("doc_id")
        for a, b, per, row, place, h, found, first in _grams(batch.column("text")):
            n = b - a
            yield pa.RecordBatch.from_arrays([keys.slice(a, n), ids.slice(a, n), pa.array(per), pa.array(np.zeros(n, np.int64)), pa.nulls(n, pa.binary())], ["rk", "doc_id", "pos", "h", "gram"])
            for i in range(0, len(row), 50_000):
                at = slice(i, i + 50_000)
                k = len(row[at])
                yield pa.RecordBatch.from_arrays([keys.slice(a, n).take(pa.array(row[at])), pa.nulls(k, pa.int64()), pa.array(place[at]), pa.array(h[at]), _joined(found, first[at])], ["rk", "doc_id", "pos", "h", "gram"])


def template_positions() -> list[tuple]:
    """t, tpos, h, tgram, words (of the template), label, base, must: whether the span needs this k-gram;
    template -1 stands for the row of each text."""
    out: list[tuple] = [(-1, 0, 0, None, 0, "", False, False)]
    for t, (text, label, must) in enumerate([(*x, ()) for x in PHRASES] + list(TEMPLATES)):
        (_, _, per, _, place, h, found, first), = _grams(pa.array([text.encode()]))
        grams = _joined(found, first).to_pylist()
        out += [(t, int(p), int(x), g, int(per[0]), label, t < len(PHRASES), g.decode() in must) for p, x, g in zip(place, h, grams, strict=True)]
    return out


def license_scan(docs: DataFrame) -> DataFrame:
    """rk, doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score for each row."""
    spark = docs.sparkSession
    arrow_batches(spark)
    rows = keyed(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text")))
    table = template_positions()
    needed = {t: sum(x[7] for x in table if x[0] == t) for t, *_ in table}
    places = F.broadcast(spark.createDataFrame([(*x, needed[x[0]]) for x in table], "t int, tpos int, h long, tgram binary, size int, label string, base boolean, must boolean, needed int"))
    hits = rows.mapInArrow(lean(_emit), "rk long, doc_id long, pos long, h long, gram binary").join(places, "h").filter("t < 0 or gram = tgram")
    # votes by diagonal; the row of each text goes along as template -1
    same = [F.max(c).alias(c) for c in ("size", "label", "base", "needed")]
    votes = hits.groupBy("rk", "t", F.expr("if(t < 0, 0, pos - tpos)").alias("diagonal")).agg(
        F.collect_set("tpos").alias("tposs"), F.collect_set(F.when(F.col("must"), F.col("tpos"))).alias("musts"), *same, F.max("doc_id").alias("doc_id"), F.max(F.expr("if(t < 0, pos, 0)")).alias("n_words")
    )
    order = Window.partitionBy("rk", "t").orderBy("diagonal")
    apart = F.coalesce(F.col("diagonal") - F.lag("diagonal").over(order) > DRIFT, F.lit(True)) | F.col("base")
    spans = votes.withColumn("span", F.sum(apart.cast("int")).over(order)).groupBy("rk", "t", "span").agg(
        F.array_distinct(F.flatten(F.collect_list("tposs"))).alias("held"), F.size(F.array_distinct(F.flatten(F.collect_list("musts")))).alias("musts"), *same, F.max("doc_id").alias("doc_id"), F.max("n_words").alias("n_words"),
        F.min("diagonal").alias("start"), (F.max("diagonal") - F.min("diagonal")).alias("inserted"),
    )
    held_words = F.size(F.array_distinct(F.flatten(F.transform("held", lambda p: F.sequence(p, p + K - 1)))))
    share = held_words / (F.col("size") + F.col("inserted"))
    base = F.col("base") & (held_words == F.col("size"))
    other = ~F.col("base") & (F.col("t") >= 0) & (share >= COVER) & (F.col("musts") == F.col("needed"))
    names = lambda cond: F.concat_ws(",", F.array_sort(F.collect_set(F.when(cond, F.col("label")))))
    return spans.groupBy("rk").agg(
        F.max("doc_id").alias("doc_id"), F.max("n_words").alias("n_words"), F.count(F.when(base, 1)).alias("n_base"), F.min(F.when(base, F.col("start"))).alias("first_word"), F.max(F.when(base, F.col("start"))).alias("last_word"),
        names(base).alias("base_labels"), names(base | other).alias("labels"), F.coalesce(F.max(F.when(base, 1.0).when(other, share)), F.lit(0.0)).alias("score"),
    )
