"""documents, through language ID, exact dedup, near dedup, source mixing and BPE.

Each stage takes (spark, docs, sf_dir), reads every row of docs and returns a DataFrame; all but the last
return the columns of documents. Columns of clashing names stay as they are, and an empty table gives empty
results in every stage. Nulls: a document with a null text has no letter and goes with the first stage; a
null doc_id, source or lang stays a null. Repeated rows count as copies of each other.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from arcmesh.llm import bpe, exactdup, langid, mixing, neardup
from arcmesh.llm.queries import table, tokenizer_path
from arcmesh.llm.store import fresh, give_back, keyed, written


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a letter, which have no language and score 0, go; all others stay, also where no
    row teaches a language."""
    model = langid.learn(docs.filter(langid.fold("doc_id", 4) != 2))
    if not model.langs:
        model = langid.Model(["any"], [], [], [], [])
    name = fresh(docs, "found")
    out = langid.with_language(docs, model, name).filter(F.col(f"{name}.score") > 0).drop(name)
    del model  # it was broadcast; the driver needs its memory for the stages to come
    give_back()
    return out


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts stays."""
    return exactdup.keep_first(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays: five-word shingles, similarity 0.8 or more."""
    return neardup.keep_first(docs, width=5)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A document is there as often as the mix takes it."""
    rk, n = fresh(docs, "rk"), fresh(docs, "times")
    times = mixing.mix(docs).filter("taken > 0").select(F.col("rk").alias(rk), F.expr("cast(taken div size as int)").alias(n))
    return keyed(docs, rk).join(times, rk).withColumn(n, F.explode(F.sequence(F.lit(1), F.col(n)))).drop(rk, n)


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256: the digests of each document's ids and their text."""
    return bpe.round_trip(docs, tokenizer_path())


STAGES = [("language_id", language), ("exact_dedup", exact), ("near_dedup", near), ("source_mix", mixed), ("bpe", encoded)]
#: MinHash, the learned language model and BPE are beyond SQL; tests/llm holds the operators against brute
#: force and run() against its stages.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = written(docs, name)
    return docs
