"""Documents with every awkward case, and small brute-force helpers."""

import random

from pyspark.sql.types import DoubleType, LongType, StringType, StructField, StructType

FOLDER = "/root/testdata/sf0.001"
SCHEMA = StructType(
    [
        StructField("doc_id", LongType()),
        StructField("text", StringType()),
        StructField("lang", StringType()),
        StructField("source", StringType()),
        StructField("n_chars", LongType()),
        # names that operators use for themselves
        StructField("score", DoubleType()),
        StructField("row", LongType()),
        StructField("fp", StringType()),
        StructField("h", StringType()),
    ]
)


def prose(seed: int, words: int) -> str:
    r = random.Random(seed)
    return " ".join("".join(r.choice("abcdeiourstnlm") for _ in range(r.randint(2, 9))) for _ in range(words))


def rows():
    long = prose(1, 30_000)
    shared = prose(2, 80)
    texts = [
        (1, "A short text, twice."), (1, "A short text, twice."), (2, ""), (3, None), (4, "  \n\t "), (5, long),
        (6, prose(3, 30) + " " + shared + " " + prose(4, 30)), (7, prose(5, 10) + " " + shared), (None, "no id here at all"),
        (8, "x"), (9, "été ▁ 日本語 \x00 𐍈 ﬁn"), (10, "ab " * 200), (11, prose(6, 400)), (12, prose(6, 400)), (13, prose(6, 400) + " end"),
    ]
    out = []
    for i, (d, t) in enumerate(texts):
        out.append((d, t, None if i % 5 == 3 else "en", None if i % 4 == 1 else f"s{i % 2}", None if t is None else len(t), 0.5, 7, "fp", "h"))
    return out


def docs(spark):
    return spark.createDataFrame(rows(), SCHEMA)


def empty(spark):
    return spark.createDataFrame([], SCHEMA)
