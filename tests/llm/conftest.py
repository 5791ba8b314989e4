"""Small tables with every edge: nulls, empty and very long texts, ties, repeated rows, clashing columns."""

import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, rk long, taken long, size long, kept boolean, component_id long, digest string, found string, times int"
EN = "the cat sat on the mat and looked at the old house where nobody had lived for many years".split()
DE = "der hund lief durch den garten und sah das alte haus in dem niemand mehr wohnte seit vielen jahren".split()


def text(words, n, seed):
    r = random.Random(seed)
    return " ".join(r.choice(words) + ("," if r.random() < 0.1 else "") for _ in range(n)) + "."


def rows():
    base, long = text(EN, 120, 1), text(EN, 20_000, 2)
    near = base.replace("cat", "dog", 1)
    own = [
        (1, base, "en", "a"), (2, None, "en", "a"), (3, "", None, "b"), (4, " \n\t ", "en", None), (5, base.replace(" ", "  "), "en", "b"), (6, base, "en", "a"), (6, base, "en", "a"), (7, long, "en", "c"), (8, long + " more words here", "en", "c"),
        (9, near, "en", "a"), (None, text(DE, 60, 3), "de", "b"), (11, text(DE, 80, 4) + "\nReleased under the MIT license.", "de", None), (12, "<|endoftext|> Hi  there\n\n  x, é日本 🙂 it's 12345!?", "en", "b"), (13, "one two", "en", "a"), (14, "one two", "en", "a"),
        (15, "123 456", None, "c"), (16, "Apache License, Version 2.0; CC BY-NC 4.0, licensed under the MIT license", "en", "c"), (17, "  x　y\x1c z", None, "a"), (-5, text(EN, 30, 5), "en", ""), (100, text(DE, 30, 6), "de", "a"),
    ]
    own += [(200 + i, text(EN if i % 2 else DE, 40 + i, 100 + i), "en" if i % 2 else "de", "abc"[i % 3]) for i in range(40)]
    return [(*r, len(r[1] or ""), 7, 7, 7, True, 7, "x", "y", 3) for r in own]


@pytest.fixture(scope="session")
def raw():
    """doc_id, text, lang, source."""
    return [r[:4] for r in rows()]


@pytest.fixture(scope="session")
def docs(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("docs") / "documents.parquet")
    spark.createDataFrame(rows(), SCHEMA).coalesce(2).write.parquet(path)
    return spark.read.parquet(path)


@pytest.fixture(scope="session")
def none(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("none") / "documents.parquet")
    spark.createDataFrame([], SCHEMA).write.parquet(path)
    return spark.read.parquet(path)


@pytest.fixture(scope="session")
def tokenizer():
    from arcmesh.llm.queries import tokenizer_path

    return tokenizer_path()
