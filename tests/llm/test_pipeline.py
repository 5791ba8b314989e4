from collections import Counter


def test_stages(spark, docs, raw, tmp_path, tokenizer):
    import hashlib

    import corpus_pipeline

    sf = str(tmp_path)
    docs.write.parquet(f"{sf}/documents.parquet")
    now = spark.read.parquet(f"{sf}/documents.parquet")
    sizes = [now.count()]
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES[:-1]):
        out = stage(spark, now, sf)
        assert out.columns == docs.columns, name
        out.write.parquet(f"{sf}/{i}")
        now = spark.read.parquet(f"{sf}/{i}")
        sizes.append(now.count())
    letters = [t for _, t, _, _ in raw if t and any(c.isalpha() for c in t)]
    distinct = {"".join(t.split()) for t in letters}
    assert sizes[1] == len(letters) and sizes[2] >= len(distinct) - 1 and sizes[3] < sizes[2]
    last = corpus_pipeline.STAGES[-1][1](spark, now, sf).collect()
    texts = Counter((r.doc_id, hashlib.sha256(r.text.encode()).hexdigest()) for r in now.select("doc_id", "text").collect())
    assert Counter((r.doc_id, r.decoded_sha256) for r in last) == texts
    assert Counter(map(tuple, corpus_pipeline.run(spark, sf).collect())) == Counter(map(tuple, last))


def test_the_language_stage_keeps_lettered_texts_without_labels(spark, docs, raw):
    import corpus_pipeline
    from pyspark.sql import functions as F

    letters = Counter((d, t) for d, t, _, _ in raw if t and any(c.isalpha() for c in t))
    for lang in (None, "und"):
        out = corpus_pipeline.language(spark, docs.withColumn("lang", F.lit(lang).cast("string")), "")
        assert Counter((r.doc_id, r.text) for r in out.select("doc_id", "text").collect()) == letters


def test_the_operators_are_registered():
    import __spark_entry__ as entry

    names = [k for k in entry.queries() if k.startswith("op")]
    assert sorted(int(k[2:].split("_")[0]) for k in names) == list(range(1, 11)) and "pipeline" in entry.queries()


def test_stages_on_an_empty_table(spark, none):
    import corpus_pipeline

    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, none, "")
        assert out.count() == 0, name
        assert name == "bpe" or out.columns == none.columns, name
