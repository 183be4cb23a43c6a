import random
import sys
from pathlib import Path

import pytest
from pyspark.sql import types as T

sys.path.insert(0, str(Path(__file__).resolve().parents[2]))
SMALL = "/root/testdata/sf0.001"

#: Names that the operators use inside, or return, as extra columns of the input.
CLASHING = ("key", "node", "text_hash", "__hash", "n_words", "fail_bits", "spans", "cell", "group", "bucket", "label", "score",
            "host", "rule", "tokens", "payload", "__leaks", "__k", "token")
DOCS = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()),
                     T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType()),
                     *[T.StructField(c, T.StringType()) for c in CLASHING]])


def docs_frame(spark, rows):
    """Documents from (doc_id, text) with every extra column."""
    return spark.createDataFrame([(i, t, "en", None, len(t or ""), *["x"] * len(CLASHING)) for i, t in rows], DOCS)


def prose(seed, words, vocabulary=400):
    random_ = random.Random(seed)
    return " ".join(f"w{random_.randrange(vocabulary):03d}" for _ in range(words))


BASE = prose(1, 120)
EDGE = [
    (1, BASE), (2, BASE), (3, BASE.replace("w0", "v0", 1)), (4, None), (5, ""), (6, " \n\t "), (7, "one two"), (8, "one two"),
    (9, prose(2, 60_000, 5000)), (None, prose(3, 80)), (None, None), (10, prose(4, 90)), (10, prose(4, 90)), (11, "é́ 日本 😀 " * 30),
]


@pytest.fixture(scope="session")
def edge(spark):
    return docs_frame(spark, EDGE)


@pytest.fixture(scope="session")
def nothing(spark):
    return docs_frame(spark, [])
