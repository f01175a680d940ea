"""Small documents with every awkward case, shared by the tests of this folder."""

from __future__ import annotations

import random

from pyspark.sql import types as T

SCHEMA = T.StructType(
    [
        T.StructField("doc_id", T.LongType()),
        T.StructField("text", T.StringType()),
        T.StructField("lang", T.StringType()),
        # Names that operators use for columns of their own.
        T.StructField("found", T.StringType()),
        T.StructField("_row_hash", T.LongType()),
        T.StructField("name", T.StringType()),
    ]
)


def words(rng: random.Random, n: int) -> list[str]:
    return ["".join(rng.choice("abcdeéß") for _ in range(rng.randint(1, 7))) for _ in range(n)]


def sample_texts(seed: int = 1) -> list[str | None]:
    """Nulls, empties, white space only, a long text, exact and near copies, ties."""
    rng = random.Random(seed)
    base = [" ".join(words(rng, rng.choice([1, 3, 4, 40, 300]))) for _ in range(25)]
    long = " ".join(words(rng, 6000))
    near = []
    for t in base:
        w = t.split(" ")
        for _ in range(3):
            v = list(w)
            v[rng.randrange(len(v))] = "changed"
            near.append(" ".join(v))
    spaced = [t.replace(" ", "  \n") for t in base[:8]]
    return [None, "", "", " \t\n", None, *base, *base[:9], *near, *spaced, long, long, long + "x", "A", "a"]


def frame(spark, texts, ids=None):
    rows = [(i if ids is None else ids[i], t, "en", "f", i, "n") for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, SCHEMA)


def with_repeats(spark, texts):
    """Rows as above, one of them there three times, and two with a null doc_id."""
    docs = frame(spark, texts)
    again = docs.where("doc_id = 7")
    unknown = frame(spark, ["no id at all", None], [None, None])
    return docs.unionAll(again).unionAll(again).unionAll(unknown)
