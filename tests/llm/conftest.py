import random

import pytest
from pyspark.sql import types as T

SCHEMA = T.StructType([
    T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()),
    T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType()),
    # names that operators use inside
    *[T.StructField(c, T.StringType()) for c in ("name", "block", "unit", "row_key", "size", "key", "level", "text_key")],
])
EXTRA = ("x",) * 8
VOCAB = {}


def prose(rng, words):
    return " ".join("".join(rng.choice("abcdefghéöñ") for _ in range(rng.randint(2, 8))) for _ in range(words))


def row(number, text, lang="en", source="src0"):
    return (number, text, lang, source, None if text is None else len(text), *EXTRA)


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Nulls in any column, empty and long texts, ties, repeated rows, shared passages, clashing column names."""
    rng = random.Random(7)
    base = [prose(rng, 60) for _ in range(12)]
    passage = prose(rng, 30)
    rows = [row(k, t) for k, t in enumerate(base)]
    rows += [row(100 + k, base[k]) for k in range(4)]  # copies
    rows += [row(200, base[0]), row(201, base[0]), row(201, base[0])]  # a larger group, and a repeated row
    rows += [row(300 + k, f"{prose(rng, 20)} {passage}\n{prose(rng, 5)}") for k in range(5)]  # a shared passage
    rows += [row(400 + k, base[5] + f" {w}") for k, w in enumerate(("one", "two", "three"))]  # near copies
    rows += [row(500, None), row(501, ""), row(502, " \n\t"), row(503, "!!! ??? ###"), row(504, "日本語の文章"), row(505, "w")]
    rows += [row(None, "no id, but a text that is long enough to be cut somewhere " + passage), row(None, None, None, None)]
    rows += [row(600, prose(rng, 40_000)), row(601, "a" * 60_000), row(602, "<|endoftext|> it's   5½ <s>▁ ")]
    rows += [row(603, "All  rights, RESERVED. Licensed under CC BY-NC 4.0.\nReleased under the MIT License.\ncc by cc by")]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def file():
    public = pytest.importorskip("public_tokenizers")
    return lambda name: str(public.path(name))
