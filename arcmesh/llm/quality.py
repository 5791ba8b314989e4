"""Quality classifier with hierarchical empirical Bayes.

A document's own evidence is the log odds of a small classifier on its bytes and words. Hosts and paths
have labelled documents of their own: the host's rate of good ones is shrunk toward the global rate, the
path's toward its host's, each level with a strength of its own: the one estimated from the spread between
hosts, the other from that between the paths of a host. So a sparse site says little and a rich one much. The score puts the document's evidence on the path's posterior odds. Host and
path rates are grouped aggregates that stay in Spark and are joined back by key.

The classifier is fitted on at most LABELLED labelled rows, chosen by a hash: word log odds on one half
of them, their weight beside the byte frequencies on the other half. Rows of the held-out fold (crc32 of
doc_id as text, modulo 5, is 0) teach neither it nor the rates. The rates count every other label.

Nulls: a null text is an empty one, whose evidence is 0; null host or path is a site of its own; labels
that are null are left out, several labels of a document are averaged, and repeated rows count each. A
null doc_id counts as the empty id (held out) and has no label. Without labels every score is 0.5. Empty
tables give empty results. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from arcmesh.llm.langid import fold
from arcmesh.llm.store import arrow_batches, keyed, lean
from arcmesh.llm.textblocks import buffers, chunks, hash_words, words

LABELLED = 20_000
BUCKETS = 1 << 15


def _features(texts: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray]]:
    """Rows a to b, their byte frequencies, and the word buckets with the row of each."""
    off, raw = buffers(texts)
    for a, b in chunks(off):
        own, part = off[a : b + 1] - off[a], raw[off[a] : off[b]]
        n = np.diff(own)
        row = np.repeat(np.arange(b - a), n)
        freq = np.bincount(row * 256 + part, minlength=(b - a) * 256).reshape(b - a, 256) / np.maximum(n, 1)[:, None]
        found, per = words(own, part)
        yield a, b, freq.astype(np.float32), (hash_words(found) % np.uint64(BUCKETS)).astype(np.int64), np.repeat(np.arange(b - a), per)


def _word_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """bucket, good and bad: documents' shares of words, summed over the batch."""
    for batch in batches:
        good = batch.column("good").to_numpy()
        total = np.zeros((2, BUCKETS))
        for a, b, _, bucket, row in _features(batch.column("text")):
            w = 1 / np.maximum(np.bincount(row, minlength=b - a), 1)[row] if len(row) else np.zeros(0)
            total[0] += np.bincount(bucket, w * good[a:b][row], BUCKETS)
            total[1] += np.bincount(bucket, w * (1 - good[a:b][row]), BUCKETS)
        at = np.flatnonzero(total.any(axis=0))
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[0][at]), pa.array(total[1][at])], ["bucket", "good", "bad"])


def _inputs(texts: pa.Array, odds: np.ndarray) -> np.ndarray:
    """A row per text: mean word log odds, then the byte frequencies (square roots)."""
    out = []
    for a, b, freq, bucket, row in _features(texts):
        n = np.bincount(row, minlength=b - a)
        mean = np.bincount(row, odds[bucket], b - a) / np.maximum(n, 1)
        out.append(np.hstack([mean[:, None], np.sqrt(freq)]))
    return np.concatenate(out).astype(np.float32) if out else np.zeros((0, 257), np.float32)


def _fit(x: np.ndarray, y: np.ndarray, rounds: int = 300, rate: float = 0.3, decay: float = 1e-3) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Logistic regression on standardised inputs; its intercept is dropped with the sample's prior."""
    mid, wide = x.mean(axis=0), x.std(axis=0) + 1e-3
    z = (x - mid) / wide
    w, b = np.zeros(x.shape[1]), 0.0
    share = np.clip(y.mean(), 0.01, 0.99)
    weight = np.where(y > 0.5, 0.5 / share, 0.5 / (1 - share))  # both classes weigh the same: the output is evidence
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(z @ w + b, -30, 30)))
        g = weight * (p - y) / len(y)
        w -= rate * (z.T @ g + decay * w)
        b -= rate * g.sum()
    return w, mid, np.append(wide, b)


def strength(squares: float, freedom: int, size: float, inside: float) -> float:
    """Strength of the beta prior of sites from the spread between them, by moments: squares is the sum of
    squared deviations of their rates by size, of which `freedom` times `inside` is chance."""
    spread = (squares - freedom * inside) / max(size, 1e-9)
    return float(min(max(inside / max(spread, 1e-6) - 1, 2.0), 1000.0))


def quality(docs: DataFrame, labels: DataFrame, host: str = "source", path: Sequence[str] = ("source", "lang"), label: str = "quality", labelled: int = LABELLED) -> DataFrame:
    """rk, doc_id, held_out, doc_evidence, host_rate, path_rate, score, kept for each row of docs."""
    spark = docs.sparkSession
    arrow_batches(spark)
    site = lambda cols: F.to_json(F.array(*[F.col(c).cast("string") for c in cols]))
    rows = keyed(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text"), site([host]).alias("host"), site(path).alias("path"), (fold("doc_id", 5) == 0).alias("held_out")))
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label).cast("double").alias("good")).dropna().groupBy("doc_id").agg(F.avg("good").alias("good")).filter(fold("doc_id", 5) != 0)
    n = known.count()
    share = 1_000_000 * min(1.0, labelled / max(n, 1))
    h = F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000))
    sample = F.broadcast(known.filter(h < share))  # about `labelled` rows
    taught = rows.join(sample, "doc_id").select("text", "good", F.pmod(F.xxhash64("doc_id", F.lit(1)), F.lit(2)).alias("half"))
    counts = taught.filter("half = 0").select("text", "good").mapInArrow(lean(_word_counts), "bucket long, good double, bad double").groupBy("bucket").agg(F.sum("good").alias("good"), F.sum("bad").alias("bad")).collect()
    good, bad = np.zeros(BUCKETS), np.zeros(BUCKETS)
    for r in counts:
        good[r.bucket], bad[r.bucket] = r.good, r.bad
    smooth = 0.05
    odds = np.log((good + smooth) / (good.sum() + smooth * BUCKETS)) - np.log((bad + smooth) / (bad.sum() + smooth * BUCKETS))
    told = spark.sparkContext.broadcast(odds)

    def dense(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = _inputs(b.column("text"), told.value)
            yield pa.RecordBatch.from_arrays([pa.array([r.tobytes() for r in x], pa.binary()), b.column("good")], ["x", "good"])

    half = taught.filter("half = 1").select("text", "good").mapInArrow(lean(dense), "x binary, good double").collect()
    fit = _fit(np.array([np.frombuffer(r.x, np.float32) for r in half]), np.array([r.good for r in half])) if half else (np.zeros(257), np.zeros(257), np.append(np.ones(257), 0.0))
    model = spark.sparkContext.broadcast((odds, *fit))

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        odds, w, mid, wide = model.value
        for b in batches:
            z = ((_inputs(b.column("text"), odds) - mid) / wide[:-1]) @ w + wide[-1]
            empty = np.diff(buffers(b.column("text"))[0]) == 0
            z = np.where(empty, 0.0, np.clip(z, -30, 30))
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in ("rk", "doc_id", "host", "path", "held_out")), pa.array(z)], ["rk", "doc_id", "host", "path", "held_out", "doc_evidence"])

    evidence = rows.mapInArrow(lean(scored), "rk long, doc_id long, host string, path string, held_out boolean, doc_evidence double")
    # grouped aggregation, paths first; a hot host is pre-aggregated by the partial aggregates
    labelled_rows = rows.select("doc_id", "host", "path").join(known, "doc_id")
    paths = labelled_rows.groupBy("host", "path").agg(F.sum("good").alias("pg"), F.count("*").alias("pn"))
    hosts = paths.groupBy("host").agg(F.sum("pg").alias("hg"), F.sum("pn").alias("hn"), F.count("*").alias("k"), F.sum(F.expr("pg * pg / pn")).alias("psq"), F.sum(F.expr("pn * pn")).alias("pnn"))
    total = hosts.agg(F.sum("hg").alias("g"), F.sum("hn").alias("n"), F.count("*").alias("k"), F.sum("k").alias("pk"), F.sum(F.expr("hg * hg / hn")).alias("sq"), F.sum(F.expr("hn * hn")).alias("nn"), F.sum("psq").alias("psq"), F.sum(F.expr("pnn / hn")).alias("pnn")).first()
    if total.n:
        rate = min(max((total.g + 0.5) / (total.n + 1), 1e-3), 1 - 1e-3)
        inside = rate * (1 - rate)
        by_host = strength(total.sq - total.n * rate * rate, total.k - 1, total.n - total.nn / total.n, inside)
        by_path = strength(total.psq - total.sq, total.pk - total.k, total.n - total.pnn, inside)
    else:
        rate, by_host, by_path = 0.5, 2.0, 2.0
    hosts = hosts.select("host", F.expr(f"(hg + {by_host!r} * {rate!r}) / (hn + {by_host!r})").alias("host_rate"))
    paths = paths.join(hosts, "host").select("path", F.expr(f"(pg + {by_path!r} * host_rate) / (pn + {by_path!r})").alias("path_rate"))
    out = evidence.join(hosts, "host", "left").join(paths, "path", "left").withColumn("host_rate", F.coalesce("host_rate", F.lit(rate))).withColumn("path_rate", F.coalesce("path_rate", "host_rate"))
    score = F.expr("1 / (1 + exp(-(doc_evidence + ln(path_rate / (1 - path_rate)))))")
    return out.withColumn("score", score).select("rk", "doc_id", "held_out", "doc_evidence", "host_rate", "path_rate", "score", (F.col("score") >= 0.5).alias("kept"))
