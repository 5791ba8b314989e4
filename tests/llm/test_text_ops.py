"""Operators on documents against brute force, on the edge table and on an empty one."""

import hashlib
import re
import zlib
from collections import Counter
from math import log10

import numpy as np
import pytest

SPACE = re.compile(r"[^\x20\x09-\x0D]+")


def lower(t):
    return (t or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))


def crc(i, n):
    return zlib.crc32(("" if i is None else str(i)).encode()) % n


def by_row(df):
    """Rows in the order of the table: rk counts them within partitions."""
    return df.orderBy("rk").collect()


def test_exact_dedup(docs, raw, none):
    from arcmesh.llm.exactdup import exact_dedup, keep_first

    norm = [re.sub(r"[\x20\x09-\x0D]", "", t or "") for _, t, _, _ in raw]
    rank = lambda k: (-len(raw[k][1] or ""), raw[k][0] is None, raw[k][0] or 0)
    for k, r in enumerate(by_row(exact_dedup(docs))):
        same = [j for j, n in enumerate(norm) if n == norm[k]]
        best = raw[min(same, key=rank)][0]
        assert (r.doc_id, r.keep_id, r.group_size, r.kept, r.text_sha256) == (raw[k][0], best, len(same), raw[k][0] == best, hashlib.sha256(norm[k].encode()).hexdigest())
    left = keep_first(docs)
    assert left.columns == docs.columns and left.count() == len(set(norm))
    assert exact_dedup(none).count() == 0 and keep_first(none).count() == 0


@pytest.mark.parametrize("width", [4, 5])
def test_near_dedup(docs, raw, none, width):
    from arcmesh.llm.neardup import keep_first, near_dedup

    def shingles(t):
        w = SPACE.findall(lower(t))
        return {tuple(w[i : i + width]) for i in range(len(w) - width + 1)} if len(w) >= width else {tuple(w)} if w else set()

    sets = [shingles(t) for _, t, _, _ in raw]
    group = list(range(len(raw)))
    for i, a in enumerate(sets):
        for j in range(i):
            both = len(a & sets[j])
            if a and sets[j] and 100 * both >= 80 * (len(a) + len(sets[j]) - both):
                group = [group[j] if g == group[i] else g for g in group]
    for k, r in enumerate(by_row(near_dedup(docs, width))):
        ids = [raw[j][0] for j in range(len(raw)) if group[j] == group[k] and raw[j][0] is not None]
        want = min(ids, default=None)
        assert (r.n_shingles, r.component_id, r.kept) == (len(sets[k]), want, raw[k][0] == want)
    assert keep_first(docs, width).count() == len(set(group))
    assert near_dedup(none, width).count() == 0


def test_parities_never_differ_more_than_the_sets():
    from arcmesh.llm.neardup import parities

    r = np.random.default_rng(5)
    for n, cut in ((0, 0), (1, 1), (150, 9), (150, 40), (1000, 120), (1024, 600)):
        whole = np.unique(r.integers(0, 1 << 63, n + cut).astype(np.uint64))
        a, b = whole[: len(whole) - cut], whole[cut:]
        x, y = parities([a, b])
        apart = sum(int(v).bit_count() for v in x ^ y)
        differ = len(np.setxor1d(a, b))
        assert apart <= differ and apart % 2 == differ % 2
        if differ <= 20:
            assert apart >= differ - 6
    assert parities([]).shape == (0, 16)


def test_sketches_follow_similarity():
    from arcmesh.llm.neardup import AGREE, LONGS, sketches

    rng = np.random.default_rng(1)
    a = rng.integers(0, 1 << 63, 900, dtype=np.uint64)
    for shared, passes in ((800, True), (450, False)):
        b = np.concatenate([a[:shared], rng.integers(0, 1 << 63, 900 - shared, dtype=np.uint64)])
        x, y = sketches([np.unique(a), np.unique(b)])
        agree = 64 * LONGS - sum(int(v).bit_count() for v in x ^ y)
        assert (agree >= AGREE) is passes


def test_graded_near_copies(spark):
    """A large group whose members differ more and less: components are those of all true links."""
    import random

    from arcmesh.llm.neardup import near_dedup

    r = random.Random(5)
    base = [f"w{r.randrange(10**6)}" for _ in range(160)]
    texts = []
    for i in range(120):
        w = list(base)
        for p in r.sample(range(160), 1 + i % 16):
            w[p] = f"x{r.randrange(10**6)}"
        texts.append(" ".join(w))
    sets = [{tuple(t.split()[k : k + 4]) for k in range(157)} for t in texts]
    group = list(range(120))
    for i in range(120):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if 100 * both >= 80 * (len(sets[i]) + len(sets[j]) - both):
                group = [group[j] if g == group[i] else g for g in group]
    want = {k: min(j for j in range(120) if group[j] == group[k]) for k in range(120)}
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {x.doc_id: x.component_id for x in near_dedup(df, 4).collect()}
    assert sum(got[k] != want[k] for k in want) <= 1  # a link of exactly 0.8 is missed once in 10^4


def test_near_dedup_broadcasts_no_buckets(docs, monkeypatch):
    """A file's size says nothing of the keys that a class explodes to: no plan may send them to the driver."""
    from arcmesh.llm import neardup

    plans, write = {}, neardup.written
    monkeypatch.setattr(neardup, "written", lambda df, name: plans.setdefault(name, df._jdf.queryExecution().executedPlan().toString()) and write(df, name))
    neardup.near_dedup(docs)
    assert "SortMergeJoin" in plans["buckets"] and "SortMergeJoin" in plans["star"]
    assert "Broadcast" not in plans["buckets"] + plans["star"]


def test_labels_are_not_broadcast(spark, monkeypatch):
    """Equal labels pack to almost nothing in files, by which the planner goes."""
    from arcmesh.llm import graph

    plans, write, n = [], graph.written, 20_000
    monkeypatch.setattr(graph, "written", lambda df, name: plans.append(df._jdf.queryExecution().executedPlan().toString()) or write(df, name))
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", str(n * 8))  # over the files, under the rows of 24 bytes
    try:
        found = graph.components(spark.range(1, n).selectExpr("0L as a", "id as b"))
        assert found.filter("label = 0").count() == n
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert len(plans) >= 3 and not any("Broadcast" in x for x in plans)


def test_bpe(docs, raw, none, tokenizer):
    from tokenizers import Tokenizer

    from arcmesh.llm.bpe import decode, encode, round_trip

    tok = Tokenizer.from_file(tokenizer)
    for block in (1000, 1 << 20):
        encoded = encode(docs, tokenizer, block)
        got = [r.ids for r in by_row(encoded)]
        assert got == [tok.encode(t or "", add_special_tokens=False).ids for _, t, _, _ in raw]
    assert [r.text for r in by_row(decode(encoded, tokenizer))] == [t or "" for _, t, _, _ in raw]
    digests = Counter((d, len(i), hashlib.sha256(np.array(i, "<u4").tobytes()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()) for (d, t, _, _), i in zip(raw, got, strict=True))
    assert Counter(tuple(r) for r in round_trip(docs, tokenizer).collect()) == digests
    assert round_trip(none, tokenizer).count() == 0


def test_blocks_travel_by_word_frequency(monkeypatch):
    """Words of a block in a skewed draw: the index comes back whole and takes a tenth less than by sorted rank."""
    import pyarrow as pa

    from arcmesh.llm import wordjoin

    def payload(index, distinct):
        monkeypatch.setattr(wordjoin, "blocks", lambda *_: iter([(0, rows, index, np.arange(distinct))]))
        return next(wordjoin.payloads(1, None)(iter(())))

    r, rows = np.random.default_rng(3), pa.table({"words": [1]})
    for n, distinct in ((200_000, 5000), (3, 3), (1, 1), (0, 0)):
        index = np.concatenate([np.arange(distinct), r.permutation(distinct)[r.zipf(1.3, n) % distinct] if distinct else np.zeros(0, int)]).astype(np.int32)
        _, back, place = wordjoin.opened(pa.Table.from_batches([payload(index, distinct)]), np.arange(distinct))
        assert (back == index).all() and (place == np.arange(distinct)).all()
    index = r.permutation(5000)[r.zipf(1.3, 200_000) % 5000].astype(np.int32)
    batch = payload(index, 5000)
    sent = sum(len(batch.column(c)[0].as_py()) for c in batch.schema.names if c not in ("block", "distinct", "rows"))
    assert sent < 0.9 * len(wordjoin.planes(index))


def test_bpe_splits_only_at_piece_boundaries(tokenizer):
    import random

    import pyarrow as pa
    from tokenizers import Tokenizer

    from arcmesh.llm.bpe import split
    from arcmesh.llm.textblocks import buffers

    tok, r = Tokenizer.from_file(tokenizer), random.Random(3)
    parts = [" ", "  ", "\n", "\n ", "a", "Bc", "é", ",", ".", "!", "'s", "'", "1", " ", " ", "日", "<|endoftext|>", "\t", "\x1c", "?!", "\u0085", "　"]
    for _ in range(300):
        t = "".join(r.choice(parts) for _ in range(12))
        words, n = split(*buffers(pa.array([t])))
        assert n.tolist() == [len(words)] and b"".join(words.to_pylist()).decode() == t
        assert [i for w in words.to_pylist() for i in tok.encode(w.decode(), add_special_tokens=False).ids] == tok.encode(t, add_special_tokens=False).ids


def test_lm_score(docs, raw, none):
    from arcmesh.llm.lm import score_documents

    tokens = [[*SPACE.findall(lower(t)), None] for _, t, _, _ in raw]
    held = [crc(d, 10) == 0 for d, *_ in raw]
    counts = Counter(w for own, h in zip(tokens, held, strict=True) if not h for w in own)
    n, v = sum(counts.values()), len(counts)
    rows = by_row(score_documents(docs, block=20_000))
    for k, r in enumerate(rows):
        base = sum(log10((counts.get(w, 0) + 0.1) / (n + 0.1 * (v + 1))) for w in tokens[k])
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held[k], len(tokens[k]), sum(w in counts for w in tokens[k]), n)
        assert r.base_score == pytest.approx(base) and r.score < 0
    assert sum(r.score for r in rows) > sum(r.base_score for r in rows)
    assert score_documents(none).count() == 0


def test_lm_splits_texts_once(docs):
    from arcmesh.llm.lm import score_documents

    rows = score_documents(docs, block=20_000)
    assert not [f for f in rows.inputFiles() if "documents.parquet" in f]  # scores are made from the blocks that counts were made from
    assert rows.count() == docs.count()


def test_recurrent_model_with_far_biases():
    from arcmesh.llm import gru

    p, tokens, off = gru.new(np.arange(64.0), 4), np.arange(64, dtype=np.int32), np.array([0, 30, 64])
    want = gru.score(p, tokens, off)
    for by in (300, -300):  # no softmax changes, but sums of exponentials would overflow or vanish
        q = p | {"bw": p["bw"] + np.float32(by), "bc": p["bc"] + np.float32(by)}
        assert gru.score(q, tokens, off) == pytest.approx(want, rel=1e-4)
        assert np.isfinite(gru.score(gru.train(q, tokens, off), tokens, off)).all()


def test_lm_learns_from_every_training_document(docs, raw, monkeypatch):
    from arcmesh.llm import gru, lm

    given = []
    monkeypatch.setattr(lm, "learned", lambda start, sequences, rounds: given.extend(sequences.collect()) or start)
    lm.score_documents(docs)
    want = [len(SPACE.findall(lower(t))) + 1 for d, t, _, _ in raw if crc(d, 10)]
    assert sorted(len(r.ids) // 2 for r in given) == sorted(want)
    # a partition's part goes by in pieces, each sequence once, and the optimizer goes on between them
    monkeypatch.setattr(lm, "PASS", 500)
    pieces = list(lm._passes(r.ids for r in given))
    assert len(pieces) > 2 and [x for part in pieces for x in part] == [r.ids for r in given]
    past, p = {}, gru.new(np.ones(64), 4)
    for tokens in (np.arange(40), np.arange(20)):
        p = gru.train(p, tokens.astype(np.int32), np.array([0, len(tokens)]), 1, 10, past=past)
    assert past["i"] == 6


def test_recurrent_model():
    from arcmesh.llm import gru

    rng = np.random.default_rng(0)
    p = gru.new(rng.integers(0, 50, 64).astype(float), 5)
    for k in ("wc", "ww", "x", "u"):
        p[k] = p[k] + rng.standard_normal(p[k].shape).astype(np.float32) * 0.3
    # all continuations of a prefix have probabilities that add up to 1
    prefix = [3, 9, 40]
    tokens = np.array([prefix + [w] for w in range(64)], np.int32).reshape(-1)
    whole = gru.score(p, tokens, np.arange(0, 257, 4), width=7, steps=2)
    assert np.exp(whole - gru.score(p, np.array(prefix, np.int32), np.array([0, 3]))[0]).sum() == pytest.approx(1, abs=1e-4)
    # a document's score does not depend on windows, lanes or its neighbours
    docs = [rng.integers(0, 64, n) for n in (1, 50, 7, 120, 3)]
    off = np.append(0, np.cumsum([len(d) for d in docs]))
    flat = np.concatenate(docs).astype(np.int32)
    alone = [gru.score(p, d.astype(np.int32), np.array([0, len(d)]), 1, 1000)[0] for d in docs]
    assert gru.score(p, flat, off, 3, 4) == pytest.approx(alone, rel=1e-4)
    # gradients against differences
    given, wanted = rng.integers(0, 64, (4, 3)), rng.integers(0, 64, (4, 3))
    reset, real = np.zeros((4, 3), bool), np.ones((4, 3), bool)
    reset[0], reset[2, 1], real[3, 2] = True, True, False
    h = np.zeros((5, 3), np.float32)
    p = {k: v.astype(np.float64) for k, v in p.items()}
    g, _, _ = gru.gradients(p, given, wanted, reset, real, h)
    for k in p:
        at = np.unravel_index(np.abs(g[k]).argmax(), g[k].shape)
        loss = []
        for d in (1e-2, -1e-2):
            q = {n: v.copy() for n, v in p.items()}
            q[k][at] += d
            loss.append(gru.gradients(q, given, wanted, reset, real, h)[2])
        assert (loss[0] - loss[1]) / 2e-2 == pytest.approx(g[k][at], rel=0.05, abs=1e-3), k


def test_license_scan(docs, raw, none):
    from arcmesh.llm.licenses import PHRASES, license_scan

    for k, r in enumerate(by_row(license_scan(docs))):
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(raw[k][1]))
        places = sorted((i, label) for p, label in PHRASES for i in range(len(w)) if w[i : i + len(p.split())] == p.split())
        labels = sorted({x for _, x in places})
        assert (r.doc_id, r.n_words, r.n_base, r.base_labels) == (raw[k][0], len(w), len(places), ",".join(labels))
        assert (r.first_word, r.last_word) == ((places[0][0], places[-1][0]) if places else (None, None))
        assert r.labels == template_labels(raw[k][1]) and 0 <= r.score <= 1
    assert license_scan(none).count() == 0


def template_labels(text):
    """Labels by plain comparison: runs of three equal words by diagonal, merged, and held against the rules."""
    from arcmesh.llm.licenses import COVER, DRIFT, PHRASES, TEMPLATES

    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(text))
    out = {label for p, label in PHRASES if any(w[i : i + len(p.split())] == p.split() for i in range(len(w)))}
    for template, label, must in TEMPLATES:
        t = template.split()
        hits = {(i - j, j) for i in range(len(w) - 2) for j in range(len(t) - 2) if w[i : i + 3] == t[j : j + 3]}
        spans, last = [], None
        for d in sorted({d for d, _ in hits}):
            if last is None or d - last > DRIFT:
                spans.append([])
            spans[-1].append(d)
            last = d
        for span in spans:
            at = {j for d, j in hits if d in span}
            held = {j + k for j in at for k in range(3)}
            named = all(any(t[j : j + 3] == m.split() for j in at) for m in must)
            if named and len(held) / (len(t) + span[-1] - span[0]) >= COVER:
                out.add(label)
    return ",".join(sorted(out))


def test_license_texts_with_edits(spark):
    import random

    from arcmesh.llm.licenses import TEMPLATES, license_scan

    mit = TEMPLATES[0][0].split()
    fixed = ["Foo. " + " ".join(mit) + " bar", " ".join([*mit[:9], "or", "people", *mit[9:]]), " ".join(mit[:9]), "under the GNU General Public License, version 3, licensed under the GNU general public license version 3"]
    fixed += ["licensed under the gnu lesser general public license version 3", "licensed under a creative commons attribution sharealike 4.0 international license", "licensed under the gnu general public license version 4", "licensed now under the gnu general public license version 2"]
    r, texts = random.Random(3), list(fixed)
    for template, _, _ in TEMPLATES:
        w = template.split()
        texts.append(template)
        for edits in (1, 1, 2, 5):
            v = list(w)
            for _ in range(edits):
                at = r.randrange(len(v))
                v[at : at + r.randrange(2)] = [f"x{r.randrange(99)}"] * r.randrange(2)
            texts.append(f"start of it {' '.join(v)} and then {template if edits == 2 else ''}")
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = [r.labels for r in license_scan(df).orderBy("doc_id").collect()]
    assert got[: len(fixed)] == ["mit", "mit", "", "gpl-3", "lgpl", "cc-by-sa-4", "", "gpl-2"]
    assert got == [template_labels(t) for t in texts]
    assert all(label in template_labels(t).split(",") for t, label, _ in TEMPLATES)


def test_source_mix(docs, raw, none):
    from arcmesh.llm.mixing import mix, targets

    sizes = [len(SPACE.findall(t or "")) for _, t, _, _ in raw]
    by = {}
    for (_, _, _, s), n in zip(raw, sizes, strict=True):
        by[s] = by.get(s, 0) + n
    quota = targets(by)
    rows = by_row(mix(docs))
    assert [tuple(r) for r in rows] == [tuple(r) for r in by_row(mix(docs))]
    for k, r in enumerate(rows):
        assert (r.doc_id, r["size"], r.source_size) == (raw[k][0], sizes[k], by[raw[k][3]])
        assert r.target == pytest.approx(quota[raw[k][3]]) and r.taken <= 2 * sizes[k] and (not sizes[k] or r.taken % sizes[k] == 0)
    for s in by:
        got = sum(r.taken for k, r in enumerate(rows) if raw[k][3] == s)
        assert got <= quota[s] + 1e-6 and quota[s] - got <= max(n for (_, _, _, x), n in zip(raw, sizes, strict=True) if x == s)
    assert mix(none).count() == 0


def test_source_mix_leaves_no_document_that_fits(spark):
    from arcmesh.llm.mixing import mix

    # documents of a third of the words stop the hash order early; hundreds of short ones close the gap
    docs = [(i, "w " * 20, "a") for i in range(900)] + [(900, "w " * 5000, "a"), (901, "w " * 4000, "a")]
    df = spark.createDataFrame(docs, "doc_id long, text string, source string").coalesce(2)
    for seed in range(6):
        rows = mix(df, (1,), 0.3, seed).collect()
        gap = rows[0].target - sum(r.taken for r in rows)
        assert 0 <= gap < min((r["size"] for r in rows if not r.taken), default=1e9)


def test_source_mix_holds_its_patterns_in_the_plan(docs, monkeypatch):
    """What the driver holds is broadcast from the plan, without a job; a round of cuts is one query."""
    from arcmesh.llm import mixing

    asked, gaps = [], mixing.local
    monkeypatch.setattr(mixing, "local", lambda spark, rows, schema: asked.append(schema) or gaps(spark, rows, schema))
    plan = mixing.mix(docs)._jdf.queryExecution().executedPlan().toString()
    assert "ExistingRDD" not in plan and "LocalTableScan" in plan
    assert asked[0] is mixing.PLAN and asked[-1] is mixing.TAKEN and mixing.GAPS in asked


def test_the_driver_collects_its_garbage_before_it_writes_a_table(spark):
    from arcmesh.llm.store import written

    beans = spark.sparkContext._jvm.java.lang.management.ManagementFactory.getGarbageCollectorMXBeans
    full = lambda: sum(b.getCollectionCount() for b in beans() if "Old" in b.getName() or "MarkSweep" in b.getName())
    before = full()
    assert written(spark.range(3), "three").count() == 3
    assert full() > before


def test_flow_routes_overlapping_sources(spark):
    from arcmesh.llm.mixing import flow, mix, targets

    # the shared pattern must go to b, since a can be met by its own
    assert flow({("a", "b"): 10, ("a",): 10}, {"a": 10, "b": 10}) == {("a",): 10, ("a", "b"): 10}
    assert flow({("a", "b"): 10, ("b", "c"): 10}, {"a": 0, "b": 10, "c": 10}) == {("a", "b"): 10, ("b", "c"): 10}
    # nothing is repeated while fresh tokens are left
    assert flow({("a",): 5, ("a", "b"): 5}, {"a": 10, "b": 0}) == {("a",): 5, ("a", "b"): 5}
    assert targets({"a": 10, "b": 10, None: 10}) == pytest.approx({"a": 20, "b": 50 / 3, None: 25 / 3})
    df = spark.createDataFrame([(i, "w " * 10, ["a", "b"] if i % 2 else ["a"]) for i in range(20)], "doc_id long, text string, belongs array<string>")
    assert sum(r.taken for r in mix(df, (1,), 1.0, sources="belongs").collect()) == pytest.approx(300, abs=20)


def test_language_id(docs, raw, none):
    """Against word-first backoff by plain dictionaries."""
    import math

    from arcmesh.llm.langid import language_id

    find = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(t))
    grams = lambda w, n: [s[i : i + n] for s in [f"<{w}>" if n > 1 else w] for i in range(len(s) - n + 1)]
    tables: list[dict[str, Counter]] = [{}, {}, {}, {}, {}]
    taught = [(t, x) for d, t, x, _ in raw if crc(d, 4) != 2 and x is not None and t is not None]
    langs = sorted({x for _, x in taught})
    for t, x in taught:
        for w in find(t):
            tables[0].setdefault(w, Counter())[x] += 1
            for n in (1, 2, 3, 4):
                for g in grams(w, n):
                    tables[n].setdefault(g, Counter())[x] += 1
    totals = [{x: sum(c[x] for c in t.values()) for x in langs} for t in tables]
    log = lambda n, item, x: math.log((tables[n][item][x] + 0.1) / (totals[n][x] + 0.1 * (len(tables[n]) + 1)))

    def of(w, x):
        if w in tables[0]:
            return log(0, w, x)
        for n in (4, 3, 2, 1):
            if own := [g for g in grams(w, n) if g in tables[n]]:
                return sum(log(n, g, x) for g in own) / len(own)
        return 0.0

    for k, r in enumerate(by_row(language_id(docs))):
        t = raw[k][1]
        assert r.held_out == (crc(raw[k][0], 4) == 2)
        if t is None or not any(c.isalpha() for c in t):
            assert (r.lang_pred, r.score) == ("und", 0)
            continue
        sums = {x: math.fsum(of(w, x) for w in find(t)) for x in langs}
        top = max(sums.values())
        want = 1 / math.fsum(math.exp(max(-700, v - top)) for v in sums.values())
        assert r.score == pytest.approx(want, abs=1e-3) and sums[r.lang_pred] == pytest.approx(top, abs=1e-3, rel=1e-5)
    assert language_id(none).count() == 0


def test_language_id_on_odd_texts(spark):
    from arcmesh.llm.langid import language_id

    texts = [(1, "the cat and the dog", "en"), (2, "der hund und die katze", "de"), (3, "½ ¾ ② 12", "en"), (4, "x" * 3_000_000 + " the the", None), (5, None, None), (6, "the " * 1_500_000, "en"), (9, "the", None), (11, "½ der", None)]
    df = spark.createDataFrame(texts, "doc_id long, text string, lang string")
    got = {r.doc_id: (r.lang_pred, r.score) for r in language_id(df).collect()}
    assert got[3] == got[5] == ("und", 0) and got[6][0] == got[9][0] == "en" and got[11][0] == "de" and got[4][0] in ("en", "de")


def test_backoff_takes_the_longest_known_grams():
    import pyarrow as pa

    from arcmesh.llm.langid import Model, gram_keys
    from arcmesh.llm.textblocks import hash_words

    column = lambda *w: pa.array([x.encode() for x in w], pa.large_binary())
    gram = lambda g: int(gram_keys(column("0" + g + "0"), len(g))[0].view(np.int64)[2 if len(g) > 1 else 1])
    m = Model(["a", "b"], [0, 3, 1], ["a", "b", "a"], [int(hash_words(column("known")).view(np.int64)[0]), gram("xyz"), gram("x")], [5, 4, 9])
    known, grams, letter, unseen = m.vectors(column("known", "xyz", "x", "q"))
    assert known[0] > known[1] and grams[1] > grams[0]  # 3-grams, not the letter
    assert letter[0] > letter[1] and not unseen.any()


def test_gram_keys_are_those_of_the_characters():
    import pyarrow as pa

    from arcmesh.llm.langid import gram_keys

    own = ["é日x", "a", "", "naïve", "x" * 9]
    for bad in ([], [b"\xff\xfe"]):
        for n in (1, 2, 3, 4):
            keys, word = gram_keys(pa.array([w.encode() for w in own] + bad, pa.large_binary()), n)
            want = [(i, s[j : j + n]) for i, w in enumerate([*own, *(b.decode("utf-8", "replace") for b in bad)]) for s in [f"<{w}>" if n > 1 else w] for j in range(len(s) - n + 1)]
            assert word.tolist() == [i for i, _ in want]
            assert len({(k, g) for k, (_, g) in zip(keys.tolist(), want, strict=True)}) == len({g for _, g in want}) == len(set(keys.tolist()))


def test_quality(spark, docs, raw, none):
    import math
    import random

    from arcmesh.llm.quality import quality

    r = random.Random(8)
    bad = [(1000 + i, " ".join(f"w{i}{j}%%% $$$" for j in range(30)), "en", "bad") for i in range(60)]
    good = [(2000 + i, " ".join(f"word{(i * j) % 50}" for j in range(40)), r.choice(("en", "de")), r.choice(("good", "fair"))) for i in range(90)]
    more = "doc_id long, text string, lang string, source string, n_chars long, rk long, taken long, size long, kept boolean, component_id long, digest string, found string, times int"
    both = docs.unionByName(spark.createDataFrame([(*x, *(None,) * 9) for x in bad + good], more))
    told = [(d, 0) for d, *_ in bad] + [(d, int(s == "good" or r.random() < 0.6)) for d, _, _, s in good]
    labels = spark.createDataFrame([(*x, "clash", 1.0) for x in [*told, (None, 1), (2000, None), (2001, 1)]], "doc_id long, quality int, text string, good double")
    rows = quality(both, labels).collect()
    assert len(rows) == len(raw) + 150 and all(0 <= x.score <= 1 for x in rows)
    sure = [x for x in rows if x.doc_id and x.doc_id >= 1000 and x.held_out]
    assert sure and all(x.kept == (x.doc_id >= 2000) for x in sure if x.doc_id < 2000)
    # the rates again, by plain sums
    known: dict = {}
    for d, q in [*told, (2001, 1)]:
        known.setdefault(d, []).append(q)
    site = {d: (s, l) for d, _, l, s in raw + bad + good}
    seen = [(*site[d], sum(q) / len(q)) for d, q in known.items() if crc(d, 5)]
    group = lambda key: {k: [q for *x, q in seen if key(x) == k] for k in {key(x) for *x, _ in seen}}
    hosts, paths = group(lambda x: x[0]), group(tuple)
    n, total = len(seen), sum(q for *_, q in seen)
    rate = (total + 0.5) / (n + 1)
    inside = rate * (1 - rate)
    sq = lambda g: sum(sum(v) ** 2 / len(v) for v in g.values())
    prior = lambda squares, freedom, size: min(max(inside / max((squares - freedom * inside) / size, 1e-6) - 1, 2.0), 1000.0)
    by_host = prior(sq(hosts) - n * rate * rate, len(hosts) - 1, n - sum(len(v) ** 2 for v in hosts.values()) / n)
    by_path = prior(sq(paths) - sq(hosts), len(paths) - len(hosts), n - sum(len(v) ** 2 / len(hosts[k[0]]) for k, v in paths.items()))
    assert by_host != by_path
    h = {k: (sum(v) + by_host * rate) / (len(v) + by_host) for k, v in hosts.items()}
    p = {k: (sum(v) + by_path * h[k[0]]) / (len(v) + by_path) for k, v in paths.items()}
    for x in rows:
        if x.doc_id is None or x.doc_id < 1000:
            continue
        host, path = h.get(site[x.doc_id][0], rate), p.get(site[x.doc_id], h.get(site[x.doc_id][0], rate))
        assert (x.host_rate, x.path_rate) == (pytest.approx(host), pytest.approx(path))
        assert x.score == pytest.approx(1 / (1 + math.exp(-(x.doc_evidence + math.log(path / (1 - path))))))
    assert {x.score for x in quality(docs, labels.limit(0)).collect()} == {0.5}
    assert quality(none, labels).count() == 0


def test_training_order(spark, docs, raw, none, tmp_path):
    from arcmesh.llm.shards import build, feistel, read, records, save, training_order

    for n in (1, 2, 3, 1000, 4097):
        order = feistel(np.arange(n), n, 5)
        assert sorted(order.tolist()) == list(range(n))
    assert feistel(np.arange(1000), 1000, 5).tolist() != feistel(np.arange(1000), 1000, 6).tolist()
    save(build(docs, length=64, per_shard=16), str(tmp_path / "shards"))
    shards = read(spark, str(tmp_path / "shards"), per_shard=16).orderBy("shard").collect()
    found = [r for s in shards for r in records(bytes(s.data), 64)]
    assert [s.first_slot for s in shards] == [16 * i for i in range(len(shards))] and all(s.records == 16 for s in shards[:-1])
    whole = {}
    for r in found:
        whole.setdefault(int(r["doc_id"]), []).append((int(r["part"]), r["ids"][: r["n"]].tolist()))
    texts = Counter()
    for i, parts in whole.items():
        ids = [v for _, own in sorted(parts) for v in own]
        texts.update((None if i < -100 else i, bytes(v - 3 for v in t)) for t in _cut(ids) if i != 6)
    assert texts == Counter((d, (t or "").encode()) for d, t, _, _ in raw if d != 6)
    assert len(read(spark, str(tmp_path / "shards"), 40, 16).collect()) == len(shards) - 2
    rows = training_order(docs).collect()
    assert sorted(r.slot for r in rows) == list(range(len(rows))) and training_order(none).count() == 0


def test_shard_files_follow_the_slots(spark, docs, tmp_path):
    from arcmesh.llm.shards import build, save

    save(build(docs, length=64, per_shard=16), str(tmp_path / "shards"))
    files = sorted((tmp_path / "shards").glob("part-*.parquet"))
    own = [[r.first_slot for r in spark.read.parquet(str(f)).collect()] for f in files]
    slots = [x for f in own for x in f]
    assert sum(map(bool, own)) > 1 and slots == [16 * i for i in range(len(slots))]


def _cut(ids):
    out, now = [], []
    for v in ids:
        if v == 1:
            out.append(now)
            now = []
        else:
            now.append(v)
    return out
