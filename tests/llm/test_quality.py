from __future__ import annotations

import random
import zlib

import numpy as np
import pytest
from brute import SCHEMA, frame, with_repeats, words

from tidewatch.llm import quality


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(4)
    good = [" ".join(words(rng, rng.randint(20, 200))) + "." for _ in range(150)]
    bad = [" ".join(w.upper() + "!!" for w in words(rng, rng.randint(5, 100))) for _ in range(60)]
    bad += [" ".join(words(rng, 1) * 50) for _ in range(40)]
    return [(t, 1) for t in good] + [(t, 0) for t in bad]


def labels_of(spark, rows):
    return spark.createDataFrame([(i, q, 0) for i, (_, q) in enumerate(rows)], "doc_id long, quality int, toxic int")


def test_held_out_rows_are_told_apart(spark, rows):
    docs = frame(spark, [t for t, _ in rows])
    got = {r.doc_id: r for r in quality.score(docs, labels_of(spark, rows)).collect()}
    assert set(got) == set(range(len(rows)))
    assert all(r.held_out == (zlib.crc32(str(i).encode()) % 5 == 0) for i, r in got.items())
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in got.values())
    held = [i for i, r in got.items() if r.held_out]
    assert np.mean([got[i].predicted == rows[i][1] for i in held]) > 0.95


def test_labels_of_held_out_rows_and_other_columns_change_nothing(spark, rows):
    docs = frame(spark, [t for t, _ in rows])
    labels = labels_of(spark, rows)
    held = {i for i in range(len(rows)) if zlib.crc32(str(i).encode()) % 5 == 0}
    turned = spark.createDataFrame(
        [(i, 1 - q if i in held else q, 1) for i, (_, q) in enumerate(rows)], "doc_id long, quality int, toxic int"
    )
    key = lambda df: sorted((r.doc_id, r.score) for r in df.collect())
    assert key(quality.score(docs, labels)) == key(quality.score(docs, turned))


def test_nulls_conflicts_one_class_and_no_labels(spark, rows):
    docs = with_repeats(spark, [None, "", *[t for t, _ in rows[:20]], "x" * 100_000])
    none = labels_of(spark, [])
    assert {r.score for r in quality.score(docs, none).collect()} == {0.5}
    odd = spark.createDataFrame([(None, 1), (3, None), (4, 0), (4, 1), (5, 7)], "doc_id long, quality int")
    assert {r.score for r in quality.score(docs, odd).collect()} == {0.5}
    ones = spark.createDataFrame([(i, 1) for i in range(1, 20)] * 2, "doc_id long, quality int")
    out = quality.score(docs, ones).collect()
    assert len(out) == docs.count() and all(r.score > 0.8 for r in out)
    kept = quality.accepted(docs, ones)
    assert kept.columns == [f.name for f in SCHEMA] and kept.count() == docs.count()
    assert quality.score(frame(spark, []), ones).count() == 0


def test_descent_reaches_the_hinge_optimum():
    rng = np.random.default_rng(0)
    rows = [np.arange(1, 4) for _ in range(80)]
    values = [rng.normal(size=3) + (2 if i % 2 else -2) for i in range(80)]
    sign = np.where(np.arange(80) % 2, 1.0, -1.0)
    w = quality.descend(rows, values, sign, 1.0)[1:4]

    def loss(v):
        return v @ v / 2 + np.maximum(0, 1 - sign * (np.array(values) @ v)).sum()

    assert all(loss(w) <= loss(w + d) + 1e-2 for d in rng.normal(scale=0.05, size=(200, 3)))


def test_the_shape_of_a_long_word_rests_on_all_of_it():
    start = "a" * 64
    first, other = (quality._words[start + rest] >> 32 for rest in ("-1" * 40, "A." * 40))
    assert first != other
    assert quality._words[start + "b" * 5_000] >> 32 == quality._words["ab"] >> 32
